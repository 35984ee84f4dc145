from __future__ import annotations

import duckdb
import pandas as pd

from duskline.llm import license_join as L
from duskline.llm.queries import SQL

ROWS = [
    (1, "CC  BY-NC 4.0\nx cc-by, all RIGHTS reserved. All rights\nreserved"), (2, None), (3, ""), (4, "Licensed under the Apache License, Version 2.0."),
    (5, "this work is licensed under the GNU general public license"), (6, "cc by cc by"), (7, "ccby acc by cc bye"), (8, "Kelvin ccé by Released Under the mit LICENSE\n\n"),
    (9, "general public\tlicense general public license"), (9, "general public\tlicense general public license"), (None, "cc by"), (11, "Éa çc by " + "the of and " * 5000 + "cc by"),
]


def test_scan_equals_sql(docs_of):
    from pyspark.sql import functions as F

    documents = pd.DataFrame(ROWS, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})  # noqa: F841
    want = duckdb.sql(SQL["op3_license_join"]).fetchall()
    got = L.scan(docs_of(ROWS)).withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")}).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_base"] == 4 and by[1]["base_labels"] == "cc-by,reserved" and by[11]["last_word"] == by[11]["n_words"] - 2
    assert by[5]["labels"] == "gpl" and by[4]["labels"] == "apache-2.0" and by[4]["score"] == 1.0 and by[2]["n_words"] == 0 and by[7]["n_base"] == 0


def labels_of(docs_of, texts):
    return {r["doc_id"]: set(r["labels"]) for r in L.scan(docs_of(list(enumerate(texts)))).collect()}


def test_kin_are_told_apart(docs_of):
    got = labels_of(docs_of, ["Licensed under CC BY 4.0.", "GNU General Public License version 3", "This work is licensed under the GNU General Public License, version 2.",
                              "released under the license", "GNU Affero General Public License, version 3", "Licensed under CC BY-NC 4.0.", "Released under the MIT License.",
                              "Licensed under CC BY-SA 4.0", "GNU Lesser General Public License version 2.1"])
    assert got == {0: {"cc-by", "cc-by-4.0"}, 1: {"gpl"}, 2: {"gpl", "gpl-2.0"}, 3: set(), 4: {"gpl", "agpl-3.0"}, 5: {"cc-by", "cc-by-nc-4.0"}, 6: {"mit"},
                   7: {"cc-by", "cc-by-sa-4.0"}, 8: {"gpl", "lgpl"}}


def test_wrapped_notices_and_scattered_words(docs_of):
    filler = " ".join(f"word{i}" for i in range(300))
    wrapped = {label: [t for t, _ in texts] for label, texts in L.TEMPLATES.items()}
    rows, want = [], []
    for label, texts in wrapped.items():
        for t in texts:
            words = t.split()
            lines = [" * " + " ".join(words[i:i + 7]) for i in range(0, len(words), 7)]
            rows.append(filler + "\n" + "\n".join(lines) + "\n" + filler)
            want.append(label)
    got = labels_of(docs_of, rows)
    assert all(want[i] in got[i] for i in range(len(rows))), [(want[i], got[i]) for i in range(len(rows)) if want[i] not in got[i]]
    scattered = f" {filler} ".join("released under the mit license".split())
    assert labels_of(docs_of, [scattered]) == {0: set()}


def test_every_block_over_the_threshold(docs_of):
    import itertools
    import random

    templates = {"a": [("one two three four five", "two")], "b": [("five six seven", ""), ("six rare", "rare")], "c": [("rare", "")], "d": [("one two three four", "")]}
    words = "one two three four five six seven rare other".split()
    rows = [(i, " ".join(c)) for i, c in enumerate(itertools.chain.from_iterable(itertools.combinations(words, k) for k in range(5)))]
    rnd = random.Random(3)
    rows += [(1000 + i, "\n".join(rnd.choices([*words, *["pad"] * 12], k=rnd.randint(10, 80)))) for i in range(120)]
    got = {r["doc_id"]: set(r["labels"]) for r in L.scan(docs_of(rows), templates=templates, threshold=0.6).collect()}
    for i, t in rows:
        w, held = t.split(), set()
        for start in range(0, len(w) + 1, 8):
            block = set(w[start:start + 16])
            fits = [(len(block & set(x.split())) / len(set(x.split())), len(block & set(x.split())), k) for k, v in templates.items() for x, must in v
                    if set(must.split()) <= block and len(block & set(x.split())) >= 0.6 * len(set(x.split())) - 1e-9]
            held |= {k for p, n, k in fits if (p, n) == max(f[:2] for f in fits)}
        assert got[i] == held, (t, got[i], held)


def test_no_python_and_empty(docs_of):
    df = L.scan(docs_of([], "doc_id long, text string, label string, w string, size int"))
    assert df.count() == 0
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().executedPlan().toString()
