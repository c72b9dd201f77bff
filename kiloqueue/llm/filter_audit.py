"""How filters interact: what each removes under every order of applying them (operator 11).

A document is reduced to the set of filters that it fails.  For one order, the
step at which it is removed is the least position of a filter that it fails: the
min-plus product of the mask matrix (0 where the filter fails, infinite where it
passes) with the position matrix, whose columns are the inverse permutations of
the orders.  The product is computed once for all masks and orders; counts of
(part, mask) are then scattered to (order, removal step).  What else is asked
follows from the counts: a document that fails a filter goes at that filter's
step or before it, so those removed before are the filter's failures less what
it removes.

The text is read once.  Copies are found by digest: the least doc_id of each
digest is aggregated before the shuffle, and a document is joined to it by
digest and id together, so a text that a third of the rows share is not one
key.  What is collected of a part is at most one row a mask.

Edge cases: null text is the empty text (fails A, and E from the second id on);
null and empty source are the part ""; a row without doc_id has no label, fails
no E and causes none; rows that repeat an id don't count as each other's copies;
of repeated labels of an id any quality = 1 or toxic = 1 counts; equal texts are
those of equal 128-bit digest; an empty table gives an empty result.  Only
doc_id, text, source, quality and toxic are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiloqueue.llm.common import Scratch

LETTERS = "ABCDE"
MIN_WORDS = 50
DISTINCT_PERCENT = 65
CAPITALS_PERCENT = 5
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_MARKS = b"#$%&*|"
#: parts whose rows are made at a time
PARTS = 64
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def own_mask(text: str) -> int:
    """The filters A to D that a text fails, one bit each, lowest first."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at ASCII white space alone
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    return ((len(words) < MIN_WORDS)
            | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
            | (100 * capitals > CAPITALS_PERCENT * len(text)) << 2
            | (len(raw.translate(None, _MARKS)) < len(raw)) << 3)


def own_failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask (filters A to D), digest of the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            digests = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([own_mask(t) for t in texts], pa.int32()), pa.array(digests, pa.binary())],
                ["doc_id", "part", "mask", "digest"])

    rows = docs.select("doc_id", "text", F.coalesce("source", F.lit("")).alias("part"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part string, mask int, digest binary")


def part_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (all five filters), n, good, toxic: documents by the set of filters that they fail."""
    tmp = Scratch(docs.sparkSession, "audit")
    own = tmp.keep(own_failures(docs), "own")
    named = own.filter("doc_id is not null")
    first = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    copy = F.when(F.col("first"), 0).otherwise(1 << LETTERS.index("E"))
    judged = (named.join(first, ["digest", "doc_id"], "left").join(marks, "doc_id", "left")
              .select("part", F.col("mask").bitwiseOR(copy).alias("mask"), "good", "toxic"))
    nameless = own.filter("doc_id is null").select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    return judged.unionByName(nameless).groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))


def removal_steps(letters: str = LETTERS) -> tuple[np.ndarray, np.ndarray]:
    """Orders (a row of filter numbers each), and the removal step (from 0) of each mask under each order; kept: the number of filters."""
    k = len(letters)
    orders = np.array(list(permutations(range(k))))
    position = np.argsort(orders, axis=1).T.astype(float)  # filter x order: the inverse permutations
    masks = np.where(np.arange(1 << k)[:, None] >> np.arange(k) & 1, 0.0, np.inf)  # mask x filter
    steps = (masks[:, :, None] + position[None, :, :]).min(axis=1)
    return orders, np.where(np.isinf(steps), k, steps).astype(np.int64)


def interactions(part: np.ndarray, mask: np.ndarray, weights: np.ndarray, parts: int, letters: str = LETTERS) -> dict[str, np.ndarray]:
    """The counts of ``COUNTS`` as part x order x step, from rows of part number, mask and weights (n, good, toxic)."""
    k = len(letters)
    orders, steps = removal_steps(letters)
    gone = np.zeros((3, parts, len(orders), k + 1), np.int64)
    for w, at in zip(weights, gone):
        np.add.at(at, (part[:, None], np.arange(len(orders))[None, :], steps[mask]), w[:, None])
    removed = gone[0, :, :, :k]
    fails = np.zeros((parts, k), np.int64)
    alone = np.zeros((parts, k), np.int64)
    for f in range(k):
        hit = mask >> f & 1 == 1
        np.add.at(fails[:, f], part[hit], weights[0][hit])
        only = mask == 1 << f
        np.add.at(alone[:, f], part[only], weights[0][only])
    shapley = np.zeros((parts, k), np.int64)
    for f in range(k):
        shapley[:, f] = removed[:, orders == f].sum(axis=1)
    return {
        "kept": gone[0].sum(axis=2, keepdims=True) - removed.cumsum(axis=2), "removed": removed, "redundant": fails[:, orders] - removed,
        "unique_fails": alone[:, orders], "good_lost": gone[1, :, :, :k], "toxic_lost": gone[2, :, :, :k], "shapley": shapley[:, orders]}


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, filter_order and step: the counts of ``COUNTS``."""
    names = ["".join(o) for o in permutations(LETTERS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, PARTS):
                rows = b.slice(lo, PARTS)
                cells = rows.column(1)
                at = np.repeat(np.arange(rows.num_rows), pc.list_value_length(cells).to_numpy())
                mask, *weights = (cells.flatten().field(k).to_numpy() for k in range(4))
                counts = interactions(at, mask, np.stack(weights), rows.num_rows)
                a_part = len(names) * len(LETTERS)
                columns = [
                    rows.column(0).take(pa.array(np.repeat(np.arange(rows.num_rows), a_part))),
                    pa.array(np.tile(np.repeat(names, len(LETTERS)), rows.num_rows)),
                    pa.array(np.tile(np.arange(1, len(LETTERS) + 1, dtype=np.int32), rows.num_rows * len(names)))]
                yield pa.RecordBatch.from_arrays(
                    [*columns, *(pa.array(counts[c].ravel()) for c in COUNTS)], ["part", "filter_order", "step", *COUNTS])

    cells = part_masks(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return cells.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


#: the same audit in DuckDB: documents by failed filters, and for every order the first filter that they fail
AUDIT_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
f AS (
  SELECT doc_id, part,
         CASE WHEN len(words) < 50 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN least < doc_id THEN 'E' ELSE '' END AS fails
  FROM w),
l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
cells AS (
  SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.x <> b.x AND c.x NOT IN (a.x, b.x) AND d.x NOT IN (a.x, b.x, c.x) AND e.x NOT IN (a.x, b.x, c.x, d.x)),
steps AS (SELECT filter_order, s::INT AS step, substr(filter_order, s::INT, 1) AS letter FROM orders, generate_series(1, 5) g(s)),
gone AS (
  SELECT fails, filter_order, coalesce(min(CASE WHEN contains(fails, letter) THEN step END), 6) AS gone_at
  FROM (SELECT DISTINCT fails FROM cells), steps GROUP BY fails, filter_order),
counts AS (
  SELECT part, filter_order, step, letter,
         sum(CASE WHEN gone_at > step THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN gone_at = step THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN gone_at < step AND contains(fails, letter) THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN fails = letter THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN gone_at = step THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN gone_at = step THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM cells JOIN gone USING (fails) JOIN steps USING (filter_order)
  GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM counts
"""
