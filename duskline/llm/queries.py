"""The registered queries of the operators, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskline.llm import (
    bpe_duckdb,
    budget_mix,
    conversation_repair,
    divergence,
    license_join,
    pivot_topk,
    quartile_digest,
    simhash_golay,
    suffix_dedup,
    token_counts,
    toxicity_cnn,
    wavelet_store,
    weak_quality,
)
from duskline.llm.common import prepare, table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that repeat an earlier document's 50-byte strings are cut out; digest of what is left."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = suffix_dedup.remove_repeats(docs)
    n = F.octet_length(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long")
    return cut.select("doc_id", n.alias("n_bytes"), (n - F.octet_length("_sd_kept")).alias("n_removed"),
                      F.size("_sd_spans").cast("long").alias("n_spans"), F.sha2("_sd_kept", 256).alias("kept_sha256"))


def op2_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = simhash_golay.near_groups(docs, keep=["doc_id"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("_sg_fp"), 16, "0")).alias("fingerprint"), F.col("_sg_group").alias("component_id"))


def op3_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and template matches of every document."""
    prepare(spark)
    out = license_join.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


def _sql_words(text: str) -> str:
    return f"regexp_extract_all({text}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _op3_sql() -> str:
    places = []
    for phrase, label in license_join.PHRASES.items():
        parts = phrase.split()
        test = " AND ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(parts))
        places.append(f"SELECT k, '{label}' AS label, unnest(list_filter(range(1, len(w) - {len(parts) - 2}), lambda i: {test})) - 1 AS spot FROM docs")
    quoted = lambda words: f"CAST([{', '.join(repr(w) for w in words)}] AS VARCHAR[])"
    templates = ", ".join(f"('{t.label}', {quoted(t.words)}, {quoted(t.must)}, {t.need}, {t.step})" for t in license_join.prepared(license_join.TEMPLATES, license_join.THRESHOLD))
    return f"""
    WITH raw AS (SELECT row_number() OVER () AS k, doc_id, translate(coalesce(text, ''), '{license_join.UPPER}', '{license_join.LOWER}') AS t FROM documents),
    docs AS (SELECT k, doc_id, t, {_sql_words('t')} AS w FROM raw),
    places AS ({' UNION ALL '.join(places)}),
    base AS (SELECT k, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY k),
    templates(label, whole, must, need, step) AS (VALUES {templates}),
    blocks AS (SELECT k, step, start, list_slice(w, start * step + 1, start * step + 2 * step) AS w
               FROM (SELECT k, w, step, unnest(range(len(w) // step + 1)) AS start FROM docs, (SELECT DISTINCT step FROM templates))),
    parts AS (SELECT k, step, start, label, len(list_intersect(whole, w)) / len(whole) AS part, len(list_intersect(whole, w)) AS n, need FROM blocks JOIN templates USING (step)
              WHERE list_has_all(w, must)),
    won AS (SELECT *, rank() OVER (PARTITION BY k, step, start ORDER BY part DESC, n DESC) AS best FROM parts WHERE n >= need),
    more AS (SELECT k, list(DISTINCT label) AS labels, max(part) AS part FROM won WHERE best = 1 GROUP BY k)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
           coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
           coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ','), '') AS labels,
           CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(part, 0.0) END::DOUBLE AS score
    FROM docs LEFT JOIN base USING (k) LEFT JOIN more USING (k)"""


def op4_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; rows that are held out are never learned from."""
    prepare(spark)
    docs, labels = (table(spark, sf_dir, n) for n in ("documents", "labels"))
    scored = toxicity_cnn.classify(docs, labels.where(~toxicity_cnn.held_out(F.col("doc_id"))), keep=["doc_id"])
    return scored.select("doc_id", toxicity_cnn.held_out(F.col("doc_id")).alias("held_out"), F.col("_tx_score").alias("score"),
                         (F.col("_tx_score") >= toxicity_cnn.CUT).cast("int").alias("predicted"))


def op5_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document and of its edited text, and their likeness."""
    prepare(spark)
    return quartile_digest.chain(table(spark, sf_dir, "documents").select("doc_id", "text"))


def token_digests(docs: DataFrame) -> DataFrame:
    """Encode, decode, and digest both; the columns that are not text stay."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    back = bpe_duckdb.round_trip(docs, public_tokenizers.PATTERN, ranks)
    ids = F.array_join(F.col("_bp_ids").cast("array<string>"), " ")
    return back.select(*[c for c in docs.columns if c != "text"], F.size("_bp_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
                       F.sha2("_bp_bytes", 256).alias("decoded_sha256"))


def op6_bpe_duckdb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the bytes they decode to, as digests."""
    prepare(spark)
    return token_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest inner products of every fiftieth vector."""
    prepare(spark)
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), pivot_topk.integer_vector(F.col("embedding")).alias("v"))
    return pivot_topk.top_k(rows, F.col("vec_id") % 50 == 0, 5)


def op8_wavelet_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids written to wavelet-matrix shards and read back."""
    import public_tokenizers

    prepare(spark)
    return wavelet_store.store(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op9_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from weak labels only."""
    prepare(spark)
    out = weak_quality.quality(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return out.select("doc_id", F.col("_wq_score").alias("score"), (F.col("_wq_score") >= 0.5).alias("keep"))


def op10_budget_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", budget_mix.word_count(F.col("text")).alias("size"))
    out = budget_mix.mix(docs, "size")
    return out.select("doc_id", "size", F.col("_bm_source_size").alias("source_size"), F.col("_bm_target").alias("target"),
                      (F.col("_bm_copies") * F.col("size")).alias("taken"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language and the terms that set a source apart."""
    prepare(spark)
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it has more than 1024 tokens."""
    import public_tokenizers

    prepare(spark)
    out = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"])
    return out.select("doc_id", F.col("_tc_bytes").alias("n_bytes"), F.col("_tc_tokens").alias("n_tokens"), (F.col("_tc_tokens") > 1024).alias("over_limit"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after planted damage."""
    prepare(spark)
    rows = table(spark, sf_dir, "conversations")
    return conversation_repair.repaired(conversation_repair.damaged(rows), rows)


OP7_SQL = """
WITH live AS (SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
              WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.k AS k, q.vec_id AS query_id, x.vec_id AS vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(x.v AS DOUBLE[])) AS BIGINT) AS score
           FROM live q JOIN live x ON q.k <> x.k WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5"""

OP11_SQL = f"""
WITH raw AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{license_join.UPPER}', '{license_join.LOWER}') AS t FROM documents),
words AS (SELECT k, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM raw),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT k) >= 10),
langs AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
sizes AS (SELECT lang, source, sum(n) AS n FROM counts GROUP BY lang, source),
groups AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang, source FROM raw) LEFT JOIN sizes USING (lang, source) LEFT JOIN langs USING (lang)),
grid AS (SELECT g.lang, g.source, term, coalesce(c.n, 0) AS n, CAST(1 + 1000000000 * (coalesce(c.n, 0) + 2)::HUGEINT // (g.n + 2 * g.v) AS BIGINT) AS p
         FROM groups g JOIN kept USING (lang) LEFT JOIN counts c USING (lang, source, term)),
whole AS (SELECT lang, term, CAST(1 + 1000000000 * (sum(n) + 2)::HUGEINT // (any_value(total) + 2 * any_value(v)) AS BIGINT) AS q
          FROM counts JOIN langs USING (lang) JOIN (SELECT lang, sum(n) AS total FROM counts GROUP BY lang) USING (lang) GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
          FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
each AS (SELECT lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0) AS value
         FROM groups g JOIN groups h USING (lang) LEFT JOIN pairs ON pairs.lang = g.lang AND pairs.source = g.source AND pairs.item = h.source WHERE g.source <> h.source
         UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM grid JOIN whole USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM each) WHERE part = 'pair' OR rank <= 10"""


def _op13_sql() -> str:
    r = conversation_repair
    name = {2: "user", 3: "assistant"}
    inserts, edits = [], []
    for state in range(4):
        one, two = r._AFTER[state], r._AFTER[r._AFTER[state]]
        inserts += [f"({state}, '', 0, {state}, CAST([] AS VARCHAR[]))", f"({state}, 'I', {r.INSERT}, {one}, ['{name[one]}:'])",
                    f"({state}, 'II', {2 * r.INSERT}, {two}, ['{name[one]}:', '{name[two]}:'])"]
        for initial in "sua?":
            for fault in range(4):
                more = r.TRUNCATED if fault == 3 else 0
                edits.append(f"('{initial}', {fault}, {state}, 'D', {r.DELETE}, {state}, NULL)")
                if fault in (0, 3):
                    edits.append(f"('{initial}', {fault}, {state}, 'R', {r.REROLE + more}, {one}, '{name[one]}')")
                    if (state, initial) in r._NEXT:
                        edits.append(f"('{initial}', {fault}, {state}, 'K', {more}, {r._NEXT[state, initial]}, NULL)")
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    bits = "list_concat([4294967295], flatten(list_transform(range(1, length(s) + 1), lambda i: [ascii(s[i]), 0, 0, 0, 0, 0, 0, 0])))"
    return f"""
    WITH RECURSIVE
    inserts(state, edits, price, after, lines) AS (VALUES {', '.join(inserts)}),
    edits(initial, fault, state, edit, price, after, name) AS (VALUES {', '.join(edits)}),
    convs AS (SELECT conv_id, row_number() OVER () AS k FROM (SELECT DISTINCT conv_id FROM conversations)),
    keyed AS (SELECT k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(c.conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s
              FROM conversations c JOIN convs ON c.conv_id IS NOT DISTINCT FROM convs.conv_id),
    hashed AS (SELECT *, xor(list_reduce({bits}, lambda acc, x: xor(xor(acc, x) >> 1, 3988292384 * (xor(acc, x) & 1))), 4294967295) % 20 AS h FROM keyed),
    damaged AS (SELECT k, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
                       CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy
                FROM hashed WHERE h <> 0),
    faults AS (SELECT *, CASE WHEN rtrim(text, {blanks}) = '' THEN 1
                              WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY turn NULLS FIRST, copy) > 1 THEN 2
                              WHEN right(rtrim(text, {blanks}), 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
                      CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '?' END AS initial FROM damaged),
    placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text, copy) - 1 AS i,
                      lag(initial) OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text, copy) || initial AS two FROM faults),
    best AS (SELECT k, CAST(0 AS BIGINT) AS i, 0 AS state, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM convs
             UNION ALL
             SELECT k, i + 1, state, cost, audit, lines FROM (
                SELECT *, row_number() OVER (PARTITION BY k, state ORDER BY cost, audit) AS choice FROM (
                    SELECT b.k, b.i, e.after AS state, b.cost + n.price + e.price AS cost, b.audit || n.edits || e.edit AS audit,
                           list_concat(b.lines, n.lines, CASE WHEN e.edit = 'D' THEN [] ELSE [coalesce(e.name, p.role) || ':' || p.text] END) AS lines
                    FROM best b JOIN inserts n ON n.state = b.state JOIN placed p ON p.k = b.k AND p.i = b.i
                         JOIN edits e ON e.initial = p.initial AND e.fault = p.fault AND e.state = n.after)) WHERE choice = 1),
    facts AS (SELECT k, count(*) AS n, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps,
                     count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
                     count(*) FILTER (two IS NOT NULL AND two NOT IN ('su', 'ua', 'au')) AS illegal FROM placed GROUP BY k),
    ended AS (SELECT b.k, b.cost + n.price AS cost, b.audit || n.edits AS audit, list_concat(b.lines, n.lines) AS lines,
                     row_number() OVER (PARTITION BY b.k ORDER BY b.cost + n.price, b.audit || n.edits) AS choice
              FROM best b LEFT JOIN facts f ON f.k = b.k JOIN inserts n ON n.state = b.state WHERE b.i = coalesce(f.n, 0) AND n.after IN (0, 3))
    SELECT conv_id, {', '.join(f'CAST(coalesce({c}, 0) AS BIGINT) AS {c}' for c in ('gaps', 'blank', 'duplicate', 'truncated', 'illegal', 'cost'))}, audit,
           sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
    FROM convs LEFT JOIN facts USING (k) JOIN ended ON ended.k = convs.k AND choice = 1"""


QUERIES = {f.__name__: f for f in (
    op1_suffix_dedup, op2_simhash_golay, op3_license_join, op4_toxicity_cnn, op5_quartile_digest, op6_bpe_duckdb, op7_pivot_topk, op8_wavelet_store,
    op9_weak_quality, op10_budget_mix, op11_source_divergence, op12_token_counts, op13_conversation_repair)}
SQL: dict[str, str] = {"op3_license_join": _op3_sql(), "op7_pivot_topk": OP7_SQL, "op11_source_divergence": OP11_SQL, "op13_conversation_repair": _op13_sql()}
