"""Order statistics and windows over keys of any size.

Rows are dealt into ranges of (key, order), so a key with many rows spans many
ranges and no task holds it whole.  What a range needs of the ranges before it
(row counts, sums, or the last few rows) is aggregated per (key, range) first;
those tables have one row per key and range.

Range borders are drawn by sampling, so the dealt rows are written once: all
steps see the same ranges, and a lost executor costs a re-read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kiloqueue.session import materialise, shuffle_partitions

PART = "_part"


def in_ranges(df: DataFrame, key: str, order_cols) -> DataFrame:
    """``df`` in ranges of (key, order), numbered upwards in ``_part``, as a written table."""
    n = shuffle_partitions(df.sparkSession)
    return materialise(df.repartitionByRange(n, F.col(key), *order_cols).withColumn(PART, F.spark_partition_id()), "ranges")


def before(per_range: DataFrame, key: str, totals: dict[str, str]) -> DataFrame:
    """Of one row per (key, range): each total summed over the key's earlier ranges."""
    w = Window.partitionBy(key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return per_range.select(key, PART, *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(a) for c, a in totals.items()])


def cumulative_counts(df: DataFrame, columns, group_cols=()) -> DataFrame:
    """``g`` (struct of the group columns and ``column``), value, n, upto (rows of g up to and with the value), total.

    One row per distinct non-null value; sums run inside a range and start from the earlier ranges.
    """
    stacked = df.select(*group_cols, F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])))
    counts = stacked.where(F.col("value").isNotNull()).groupBy(F.struct(*group_cols, "column").alias("g"), "value") \
        .agg(F.count(F.lit(1)).alias("n"))
    ranged = in_ranges(counts, "g", ["value"])
    per = ranged.groupBy("g", PART).agg(F.sum("n").alias("_n"))
    offsets = before(per, "g", {"_n": "_before"}).join(per.groupBy("g").agg(F.sum("_n").alias("total")), "g")
    inside = Window.partitionBy("g", PART).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return (ranged.withColumn("_run", F.sum("n").over(inside)).join(offsets, ["g", PART])
            .select("g", "value", "n", (F.col("_before") + F.col("_run")).alias("upto"), "total"))


def quantiles(df: DataFrame, columns, probs, group_cols=()) -> DataFrame:
    """Exact linear-interpolated quantiles: the group columns, ``column``, ``total``, ``q`` (one entry per prob)."""
    c = cumulative_counts(df, columns, group_cols)
    aggs, places = [F.max("total").alias("total")], []
    for i, p in enumerate(probs):
        at = (F.col("total") - 1) * F.lit(float(p))
        for name, place in ((f"lo{i}", F.floor(at)), (f"hi{i}", F.ceil(at))):
            holds = (F.col("upto") - F.col("n") <= place) & (place < F.col("upto"))
            aggs.append(F.max(F.when(holds, F.col("value"))).alias(name))
        places.append(at)
    picked = c.groupBy("g").agg(*aggs)

    def value(i: int, at: Column) -> Column:
        lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
        between = (F.ceil(at) - at) * lo + (at - F.floor(at)) * hi
        return F.when(lo == hi, lo).otherwise(between)

    return picked.select(*[F.col(f"g.{x}") for x in (*group_cols, "column")], "total",
                         F.array(*[value(i, at) for i, at in enumerate(places)]).alias("q"))


def with_halo(df: DataFrame, key: str, order_cols, halo: int) -> DataFrame:
    """``df`` in ranges, each with copies of the key's last ``halo`` rows before it (``_halo`` true).

    A window over ``Window.partitionBy(key, "_part").orderBy(*order_cols)`` that looks at most
    ``halo`` rows back sees what it would see over the whole key; drop the copies afterwards.
    """
    ranged = in_ranges(df, key, order_cols)
    per = ranged.groupBy(key, PART).agg(F.count(F.lit(1)).alias("_n"))
    starts = before(per, key, {"_n": "_start"}).join(per, [key, PART])
    # the ranges that begin within the halo after a range's end: at most ``halo``, as each holds a row of the key
    after = Window.partitionBy(key).orderBy(PART).rowsBetween(1, halo)
    end = F.col("_start") + F.col("_n")
    reach = starts.withColumn("_next", F.collect_list(F.struct(F.col(PART).alias("to"), F.col("_start").alias("at"))).over(after)) \
        .withColumn("_next", F.filter("_next", lambda r: r["at"] - end < halo)).where(F.size("_next") > 0)
    back = Window.partitionBy(key, PART).orderBy(*[F.col(c).desc() for c in order_cols])
    tail = ranged.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= halo)
    last = tail.join(reach, [key, PART]).withColumn("_pos", end - F.col("_back"))
    near = F.filter("_next", lambda r: r["at"] - F.col("_pos") <= halo)
    copies = last.select(*df.columns, F.explode(near).alias("_to")).select(*df.columns, F.col("_to.to").alias(PART), F.lit(True).alias("_halo"))
    return ranged.withColumn("_halo", F.lit(False)).unionByName(copies)


def halo_window(key: str, order_cols):
    return Window.partitionBy(key, PART).orderBy(*order_cols)


def without_halo(df: DataFrame) -> DataFrame:
    return df.where(~F.col("_halo")).drop("_halo", PART)


def running_moments(df: DataFrame, key: str, order_cols, target: str) -> DataFrame:
    """``df`` with ``run_n``, ``run_mean`` and ``run_std`` (sample) of the target up to and with each row of its key."""
    ranged = in_ranges(df, key, order_cols)
    per = ranged.groupBy(key, PART).agg(F.count(target).alias("_n"), F.sum(target).alias("_s"),
                                        F.coalesce(F.var_pop(target) * F.count(target), F.lit(0.0)).alias("_m2"))
    earlier = Window.partitionBy(key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    # deviations of the ranges' sums from the common mean join their own squared deviations
    n0, s0 = F.coalesce(F.sum("_n").over(earlier), F.lit(0)), F.coalesce(F.sum("_s").over(earlier), F.lit(0.0))
    q0 = F.coalesce(F.sum(F.col("_m2") + F.coalesce(F.try_divide(F.col("_s") * F.col("_s"), F.col("_n")), F.lit(0.0))).over(earlier), F.lit(0.0))
    offsets = per.select(key, PART, n0.alias("_n0"), s0.alias("_s0"), q0.alias("_q0")) \
        .withColumn("_m0", F.col("_q0") - F.coalesce(F.try_divide(F.col("_s0") * F.col("_s0"), F.col("_n0")), F.lit(0.0)))
    w = halo_window(key, order_cols).rowsBetween(Window.unboundedPreceding, 0)
    own = ranged.withColumns({"_n1": F.count(target).over(w), "_a1": F.avg(target).over(w), "_v1": F.var_pop(target).over(w)})
    j = own.join(offsets, [key, PART])
    n = F.col("_n0") + F.col("_n1")
    a1 = F.coalesce(F.col("_a1"), F.lit(0.0))
    mean = F.try_divide(F.col("_s0") + a1 * F.col("_n1"), n)
    gap = a1 - F.coalesce(F.try_divide(F.col("_s0"), F.col("_n0")), F.lit(0.0))
    m2 = F.col("_m0") + F.coalesce(F.col("_v1") * F.col("_n1"), F.lit(0.0)) + F.coalesce(
        gap * gap * F.try_divide((F.col("_n0") * F.col("_n1")).cast("double"), n), F.lit(0.0))
    std = F.when(n > 1, F.sqrt(F.greatest(m2, F.lit(0.0)) / (n - 1)))
    return j.withColumns({"run_n": n, "run_mean": mean, "run_std": std}).drop(
        PART, "_n0", "_s0", "_q0", "_m0", "_n1", "_a1", "_v1")


def row_positions(df: DataFrame, key: str, order_cols) -> DataFrame:
    """``df`` with ``row_pos`` (from 1) and ``key_rows`` of each row in its key."""
    ranged = in_ranges(df, key, order_cols)
    per = ranged.groupBy(key, PART).agg(F.count(F.lit(1)).alias("_n"))
    offsets = before(per, key, {"_n": "_start"}).join(per.groupBy(key).agg(F.sum("_n").alias("key_rows")), key)
    numbered = ranged.withColumn("_i", F.row_number().over(halo_window(key, order_cols)))
    return numbered.join(offsets, [key, PART]).withColumn("row_pos", F.col("_start") + F.col("_i")).drop(PART, "_i", "_start")
