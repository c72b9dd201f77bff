"""Mixing sources to target weights with hash-threshold histograms (operator 1, native).

Each document has a fixed hash; a source's mix is all documents below a hash
threshold, plus whole repeats.  The threshold comes from token sums by (source,
hash bucket): cumulate the buckets, keep the bucket in which the budget ends,
and refine that bucket alone on the next bits of the hash.  Nothing is sorted
but the at most 2**LEVEL_BITS buckets of a source, smaller budgets are nested
in larger ones, and a rerun takes the same documents.

Edge cases: null or empty text has size 0 and is never taken; a null source is
a source of its own, last in order; a null id hashes as the empty text; rows
with the same id share one hash and are taken together; an empty table gives an
empty result.  Only the named columns are read, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kiloqueue.llm.common import WORD, Scratch

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: hash bits used in each of the nested histograms
LEVEL_BITS = 12
LEVELS = 3


def size_in_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_hash(doc_id: Column, seed: int = 0) -> Column:
    """The first 36 bits of md5 over seed and id: the same in every engine."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, LEVEL_BITS * LEVELS // 4), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS,
                   max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: rank, source_size, target.

    Weights repeat over the sources in code point order.  A target stops at
    ``max_repeats`` times its source; the level at which the others share the
    rest is the largest of the levels tried in order of that limit per weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sums = (sized.groupBy("source").agg(F.sum("size").alias("source_size"))
            .withColumn("rank", F.row_number().over(by_name))
            .withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long"))
            .withColumn("top", F.col("source_size") * max_repeats))
    before = (Window.orderBy(F.try_divide(F.col("top").cast("double"), F.col("w").cast("double")), "rank")
              .rowsBetween(Window.unboundedPreceding, -1))
    whole = Window.partitionBy()
    level = ((F.sum("source_size").over(whole) - F.coalesce(F.sum("top").over(before), F.lit(0))).cast("double")
             / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))).cast("double"))
    return (sums.withColumn("level", level)
            .withColumn("target", F.least(F.col("top").cast("double"), F.max("level").over(whole) * F.col("w")))
            .select("source", "rank", "source_size", "target"))


def _refine(docs: DataFrame, bound: DataFrame, level: int) -> DataFrame:
    """Of each source's open bucket (rank, prefix, rest), the sums of its next ``LEVEL_BITS`` bits, cumulated."""
    shift = LEVEL_BITS * (LEVELS - level)
    inside = docs.withColumn("prefix", F.shiftright("h", shift + LEVEL_BITS)).join(bound, ["rank", "prefix"])
    buckets = (inside.groupBy("rank", "rest", F.shiftright("h", shift).alias("bucket"))
               .agg(F.sum("size").alias("words")))
    upto = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return buckets.withColumn("cum", F.sum("words").over(upto))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = 0,
        doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per document: doc_id, source, size, source_size, target (its source's), taken (words the mix takes)."""
    tmp = Scratch(docs.sparkSession, "mix")
    sized = tmp.keep(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                                 size_in_words(F.col(text)).alias("size"), mix_hash(F.col(doc_id), seed).alias("h")), "sized")
    targets = tmp.keep(source_targets(sized, weights, max_repeats), "targets")
    whole = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size").cast("double"))), F.lit(0)).cast("long")
    budget = targets.withColumn("repeats", whole).withColumn("rest", F.col("target") - F.col("repeats") * F.col("source_size"))
    ranked = sized.withColumnRenamed("source", "s").join(budget, F.col("s").eqNullSafe(budget["source"])).drop("s")
    bound = budget.select("rank", F.lit(0).cast("long").alias("prefix"), "rest")
    for level in range(1, LEVELS):
        cum = _refine(ranked.drop("rest"), bound, level)
        first = (cum.filter(F.col("cum") > F.col("rest")).groupBy("rank")
                 .agg(F.min_by(F.struct("bucket", (F.col("rest") - (F.col("cum") - F.col("words"))).alias("rest")), "bucket").alias("b")))
        bound = tmp.keep(first.select("rank", F.col("b.bucket").alias("prefix"), F.col("b.rest").alias("rest")), f"bound{level}")
    # a last-level bucket is in if that brings the sum nearer to the budget
    nearer = F.col("cum") - F.col("words") / 2.0 <= F.col("rest")
    last = (_refine(ranked.drop("rest"), bound, LEVELS).groupBy("rank")
            .agg(F.max(F.when(nearer, F.col("bucket"))).alias("upto")))
    limits = tmp.keep(bound.join(last, "rank", "left").select(
        "rank", F.coalesce("upto", F.shiftleft("prefix", LEVEL_BITS) - 1).alias("upto")), "limits")
    extra = F.when(F.col("h") <= F.col("upto"), 1).otherwise(0)
    return (ranked.join(limits, "rank", "left")
            .select("doc_id", "source", "size", "source_size", "target",
                    (F.col("size") * (F.col("repeats") + F.coalesce(extra, F.lit(0)))).alias("taken")))


#: the same mix in DuckDB
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '')), 1, 9))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((rank - 1) % 3 + 1)::INT]::BIGINT AS w, source_size * 3 AS top FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(top) OVER b, 0))::DOUBLE
            / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE AS level
  FROM w WINDOW b AS (ORDER BY top::DOUBLE / w::DOUBLE, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, least(top::DOUBLE, max(level) OVER () * w) AS target FROM l),
r AS (
  SELECT *, coalesce(floor(target / nullif(source_size, 0)::DOUBLE), 0)::BIGINT AS repeats,
         target - coalesce(floor(target / nullif(source_size, 0)::DOUBLE), 0)::BIGINT * source_size AS rest
  FROM t),
h AS (
  SELECT source, h, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS cum
  FROM d GROUP BY source, h)
SELECT d.doc_id, d.source, d.size, r.source_size, r.target,
       (d.size * (r.repeats + CASE WHEN h.cum - h.words / 2.0 <= r.rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
       JOIN h ON h.source IS NOT DISTINCT FROM d.source AND h.h = d.h
"""
