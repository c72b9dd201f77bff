"""Data-quality operators (P-24..P-26, A-19, A-20)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Request ranges of the prediction and recommendation endpoints.
PREDICT_RULES = [
    ("num_ports", "num_ports between 1 and 100", lambda: F.col("num_ports").between(1, 100)),
    ("available_ports", "available_ports between 0 and 100",
     lambda: F.col("available_ports").between(0, 100)),
    ("available_ports", "available_ports must not exceed num_ports",
     lambda: F.col("available_ports") <= F.col("num_ports")),
    ("queue_size", "queue_size between 0 and 200", lambda: F.col("queue_size").between(0, 200)),
    ("hour", "hour between 0 and 23", lambda: F.col("hour").between(0, 23)),
    ("day_of_week", "day_of_week between 0 and 6", lambda: F.col("day_of_week").between(0, 6)),
    ("traffic_score", "traffic_score between 0 and 1", lambda: F.col("traffic_score").between(0, 1)),
    ("precipitation_mm", "precipitation_mm must be >= 0", lambda: F.col("precipitation_mm") >= 0),
]
RECOMMEND_RULES = [
    ("max_detour_km", "max_detour_km between 0.5 and 100",
     lambda: F.col("max_detour_km").between(0.5, 100)),
    ("top_n", "top_n between 1 and 20", lambda: F.col("top_n").between(1, 20)),
]


def violations(df: DataFrame, rules=PREDICT_RULES):
    """Array of the messages of every violated rule (rules on absent columns are skipped).

    A null value violates its rule (pydantic rejects a missing required field).
    """
    checks = [F.when(~F.coalesce(pred(), F.lit(False)), F.lit(msg))
              for col, msg, pred in rules if col in df.columns]
    return F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")


def validate(df: DataFrame, rules=PREDICT_RULES) -> tuple[DataFrame, DataFrame]:
    """P-24: split into (valid, rejected); rejected rows carry ``errors``."""
    tagged = df.withColumn("errors", violations(df, rules))
    return (tagged.where(F.size("errors") == 0).drop("errors"),
            tagged.where(F.size("errors") > 0))


def required_fields(df: DataFrame, required) -> DataFrame:
    """P-25: ``is_valid`` = every required column exists and is not null in the row."""
    if any(c not in df.columns for c in required):
        return df.withColumn("is_valid", F.lit(False))
    ok = F.lit(True)
    for c in required:
        ok = ok & F.col(c).isNotNull()
    return df.withColumn("is_valid", ok)


def detect_anomalies(predictions: DataFrame, wait_threshold: float = 45.0,
                     util_threshold: float = 95.0) -> DataFrame:
    """P-26 / N-04: reasons (1-decimal text), kept when >= 1; critical when both."""
    w = F.coalesce(F.col("predicted_wait_min"), F.lit(0.0))
    u = F.coalesce(F.col("utilization_pct"), F.lit(0.0))
    reasons = F.array_compact(F.array(
        F.when(w > wait_threshold, F.format_string("High wait: %.1f min", w)),
        F.when(u > util_threshold, F.format_string("Over-capacity: %.1f%%", u)),
    ))
    return (predictions.select("station_id", reasons.alias("reasons"))
            .where(F.size("reasons") > 0)
            .withColumn("severity", F.when(F.size("reasons") == 2, "critical").otherwise("warning")))


def duplicate_count(df: DataFrame, cols=None) -> DataFrame:
    """A-19: rows that repeat an earlier row on all (or the given) columns."""
    cols = cols or df.columns
    return (df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
            .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicate_rows")))


def missing_report(df: DataFrame, cols=None) -> DataFrame:
    """A-20: per column null count and percent, only columns with nulls, sorted desc.

    One pass: a single aggregate of ``count_if(isnull)`` per column, then unpivot.
    """
    cols = cols or df.columns
    agg = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = agg.unpivot("_rows", cols, "column", "missing")
    return (long.where(F.col("missing") > 0)
            .select("column", F.col("missing").cast("long").alias("missing"),
                    F.round(F.col("missing") / F.col("_rows") * 100.0, 2).alias("missing_pct"))
            .orderBy(F.col("missing").desc(), "column"))
