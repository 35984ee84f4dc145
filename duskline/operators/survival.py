"""Right-censored times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def km_curve(df: DataFrame, by, time: str, censored: str) -> DataFrame:
    """Kaplan-Meier survival at every time; events come before censorings at ties.

    Rows are folded to (group, time) counts first, so a group is as long as its
    distinct times. The running product is a running sum of logs, with a
    survival of zero once the last at-risk unit fails.
    """
    by = [by] if isinstance(by, str) else list(by)
    c = df.groupBy(*by, time).agg(F.count("*").alias("at"), F.count_if(~F.col(censored)).alias("events"))
    w = W.partitionBy(*(by or [F.lit(0)])).orderBy(time)
    total = F.sum("at").over(W.partitionBy(*(by or [F.lit(0)])))
    c = c.withColumn("risk", total - F.sum("at").over(w) + F.col("at"))
    step = 1 - F.col("events") / F.col("risk").cast("double")
    logs = F.sum(F.when(step > 0, F.log(step))).over(w)
    dead = F.max((step <= 0).cast("int")).over(w)
    return c.withColumn("survival", F.when(dead == 1, F.lit(0.0)).otherwise(F.exp(F.coalesce(logs, F.lit(0.0)))))


def km_median(df: DataFrame, by, time: str, censored: str, out: str = "km_median") -> DataFrame:
    """First time at which survival is at most one half; NULL if it never is."""
    by = [by] if isinstance(by, str) else list(by)
    s = km_curve(df, by, time, censored)
    return s.groupBy(*by).agg(F.min(F.when(F.col("survival") <= 0.5 + 1e-12, F.col(time))).alias(out),
                              F.sum("at").alias("n"), F.sum("events").alias("n_events"))
