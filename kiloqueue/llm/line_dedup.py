r"""Line dedup with a suffix array built by distributed prefix doubling (operator 3).

A document is a sequence of line ids (lines with a word, stripped).  A suffix's
rank at depth 2**k is its place among all suffixes ordered by their first 2**k
lines; the rank at depth 2**(k+1) orders the pairs (rank of the suffix, rank of
the suffix 2**k lines on).  Suffixes whose rank nobody shares are settled and
drop out, so from the first round on only repeated lines take part.

The suffixes that share their first m lines are an interval of the suffix array
with longest common prefix m or more; two overlapping ranks of depth 2**k <= m
name that interval.  Each interval's leftmost suffix stays, the same m lines of
the others go.  m is, for every line, the least number of lines from it (and up
to it) with ``min_words`` words or more; together these windows cover exactly
the runs of that many words that occur earlier, so a line goes if and only if it
lies in a run of at least ``min_words`` words that also occurs at an earlier
place (documents in order of doc_id).  As each line has a word, no m exceeds
``min_words``, which bounds the number of rounds.

Edge cases: null and empty texts have no lines and stay as they are; lines
without a word stay; a document may lose all its lines and stays with an empty
text; rows equal in id and text are one document (each gets the same result);
a null doc_id comes first; an empty table gives an empty result.  Other columns
are kept by ``without_copies``; ``n_chars`` is set to the new length.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiloqueue.llm.common import Scratch, fresh

MIN_WORDS = 50


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    return F.xxhash64(doc_id, text)


def windows(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For every line, the least number of lines from it on, and up to it, with ``least`` words; 0 if there are too few."""
    cum = np.concatenate([[0], np.cumsum(words)])
    at = np.arange(len(words))
    end = np.searchsorted(cum, cum[:-1] + least)  # the least e with words of lines [i, e) enough
    ahead = np.where(end <= len(words), end - at, 0)
    begin = np.searchsorted(cum, cum[1:] - least, side="right") - 1
    return ahead, np.where(cum[1:] >= least, at - begin + 1, 0)


def line_table(docs: DataFrame, least: int) -> DataFrame:
    """key, doc_id, seq, line (64-bit id), ahead, back of the lines of documents that have ``least`` words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list[np.ndarray]] = [[], [], [], []]
            owner: list[np.ndarray] = []
            for i, text in enumerate(b.column(2).to_pylist()):
                lines = [x for x in map(bytes.strip, (text or "").encode("utf-8", "surrogatepass").split(b"\n")) if x]
                words = np.array([len(x.split()) for x in lines], np.int64)
                if words.sum() < least:
                    continue
                ids = np.frombuffer(b"".join(blake2b(x, digest_size=8).digest() for x in lines), np.int64)
                for col, x in zip(cols, (np.arange(len(lines), dtype=np.int32), ids, *windows(words, least))):
                    col.append(x)
                owner.append(np.full(len(lines), i))
            if owner:
                at = pa.array(np.concatenate(owner))
                seq, ids, ahead, back = (np.concatenate(c) for c in cols)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), b.column(1).take(at), pa.array(seq), pa.array(ids), pa.array(ahead.astype(np.int32)), pa.array(back.astype(np.int32))],
                    ["key", "doc_id", "seq", "line", "ahead", "back"])

    return docs.select(row_key().alias("key"), "doc_id", "text").mapInArrow(
        run, "key long, doc_id long, seq int, line long, ahead int, back int")


def suffix_ranks(lines: DataFrame, tmp: Scratch, depth: int) -> DataFrame:
    """(key, seq, level, rank): ranks by the first 2**level lines, for suffixes that share them, up to ``depth`` lines."""
    now, found, level = lines.select("key", "seq", F.col("line").alias("rank")), None, 0
    while True:
        level_rows = now.withColumn("level", F.lit(level))
        found = level_rows if found is None else found.unionByName(level_rows)
        if 2 << level > depth:
            return found
        on = now.select("key", (F.col("seq") - (1 << level)).alias("seq"), F.col("rank").alias("next"))
        pairs = tmp.keep(now.join(on, ["key", "seq"]), f"pairs{level}")
        shared = pairs.groupBy("rank", "next").agg(F.count("*").alias("n")).filter("n > 1").select("rank", "next")
        # ids that ascend over sorted ranges are places in the suffix order, equal pairs being one
        places = tmp.keep(shared.repartitionByRange("rank", "next").sortWithinPartitions("rank", "next")
                          .withColumn("place", F.monotonically_increasing_id()), f"places{level}")
        now = tmp.keep(pairs.join(places, ["rank", "next"]).select("key", "seq", F.col("place").alias("rank")), f"ranks{level + 1}")
        tmp.drop(f"pairs{level}", f"places{level}")
        level += 1
        if now.isEmpty():
            return found


def later_copies(docs: DataFrame, tmp: Scratch, least: int) -> DataFrame:
    """(key, start, m): runs of lines to delete."""
    lines = tmp.keep(line_table(docs, least), "lines")
    repeated = lines.groupBy("line").agg(F.count("*").alias("n")).filter("n > 1").select("line")
    active = tmp.keep(lines.join(repeated, "line").dropDuplicates(["key", "seq"]), "active")
    tmp.drop("lines")
    ranks = tmp.keep(suffix_ranks(active, tmp, least), "ranks")
    runs = active.filter("ahead > 0").select("key", "doc_id", F.col("seq").alias("start"), F.col("ahead").alias("m")).unionByName(
        active.filter("back > 0").select("key", "doc_id", (F.col("seq") - F.col("back") + 1).alias("start"), F.col("back").alias("m"))).distinct()
    level = F.floor(F.log2(F.col("m").cast("double")) + 1e-9).cast("int")
    runs = runs.withColumn("level", level).withColumn("tail", F.col("start") + F.col("m") - F.pow(F.lit(2.0), F.col("level")).cast("int"))
    head = ranks.select("key", F.col("seq").alias("start"), "level", F.col("rank").alias("r1"))
    tail = ranks.select("key", F.col("seq").alias("tail"), "level", F.col("rank").alias("r2"))
    named = tmp.keep(runs.join(head, ["key", "start", "level"]).join(tail, ["key", "tail", "level"])
                     .select("key", "doc_id", "start", "m", "r1", "r2"), "intervals")
    place = F.struct("doc_id", "key", "start")
    first = named.groupBy("m", "r1", "r2").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    return named.join(first, ["m", "r1", "r2"]).filter(place != F.col("first")).select("key", "start", "m")


def _cut(text: str, starts, sizes) -> tuple[str, int, int]:
    lines = text.split("\n")
    at = np.array([i for i, x in enumerate(lines) if x.encode("utf-8", "surrogatepass").strip()], np.int64)
    gone = np.zeros(len(at) + 1, np.int64)
    if starts is not None and len(starts):
        s, m = np.asarray(starts, np.int64), np.asarray(sizes, np.int64)
        np.add.at(gone, s, 1)
        np.add.at(gone, s + m, -1)
    out = set(at[np.cumsum(gone[:-1]) > 0].tolist()) if len(at) else set()
    kept = [x for i, x in enumerate(lines) if i not in out]
    return "\n".join(kept), len(at), len(out)


def _rewritten(docs: DataFrame, min_words: int) -> tuple[DataFrame, str]:
    """docs with one more column (its name is returned): the rewritten text, n_lines and n_removed."""
    tmp = Scratch(docs.sparkSession, "lines")
    key, runs, out = fresh(docs, "_key"), fresh(docs, "_runs"), fresh(docs, "_cut")
    gone = tmp.keep(later_copies(docs, tmp, min_words).groupBy("key").agg(F.collect_list(F.struct("start", "m")).alias("runs")), "gone")

    @F.pandas_udf("text string, n_lines long, n_removed long")
    def cut(text: pd.Series, starts: pd.Series, sizes: pd.Series) -> pd.DataFrame:
        rows = [_cut(t, s, m) for t, s, m in zip(text, starts, sizes)]
        return pd.DataFrame(rows, columns=["text", "n_lines", "n_removed"])

    # the same plan at every size: the runs grow with the corpus, so they are never broadcast
    joined = docs.withColumn(key, row_key()).join(gone.select(F.col("key").alias(key), F.col("runs").alias(runs)).hint("merge"), key, "left")
    done = cut(F.coalesce("text", F.lit("")), F.col(f"{runs}.start"), F.col(f"{runs}.m"))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], done.alias(out)), out


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Per row of docs: doc_id, text without later copies of line runs, n_chars, n_lines, n_removed (lines with a word)."""
    done, out = _rewritten(docs, min_words)
    text = F.when(F.col("text").isNotNull(), F.col(f"{out}.text"))
    return done.select("doc_id", text.alias("text"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars"),
                       F.col(f"{out}.n_lines").alias("n_lines"), F.col(f"{out}.n_removed").alias("n_removed"))


def without_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of docs with the text rewritten, n_chars (if there) set anew, and all other columns as they are."""
    done, out = _rewritten(docs, min_words)
    text = F.when(F.col("text").isNotNull(), F.col(f"{out}.text"))
    new = {"text": text, "n_chars": F.when(F.col("text").isNotNull(), F.length(text).cast("long"))}
    return done.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
