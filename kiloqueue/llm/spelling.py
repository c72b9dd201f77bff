"""Spelling variants: words one edit apart, by asymmetric chunks (operator 12).

Of two words one edit apart, the shorter (either, if as long) is cut into two
disjoint chunks, its halves.  The edit touches one of them; the other stands
unchanged in the longer word, at its own place or one code point on.  So the
shorter word gives two chunk rows, the longer one the positional grams of the
chunks' sizes at shift 0 and 1 (the others meet no chunk), and they are joined
on length, place and characters, and verified by edit distance.

A chunk that many words share would make pairs of all of them.  Buckets with
more than ``PAIRS_A_ROW`` pairs a row are not joined: the half that holds the
edit is halved again, and both quarters make new, longer keys (all of the word
but one quarter), and so on until a bucket is small or the open part is one
code point.  Then the bucket's words are near words themselves, of which the
letters allow only a fixed number.  No link is lost on the way: the edit is in
one of the two quarters.

Words are counted per task and again before the shuffle.  A form has at least
ten times its word's n, so chains are at most 18 long and roots are found in at
most five pointer doublings.

Edge cases: null or empty text has no words; a null doc_id is the empty text in
the hashed key; repeated rows count again; words of any length are handled;
ties go to the smallest word in code-point order; an empty table gives an empty
result.  Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiloqueue.llm.common import Scratch

RUN = re.compile("[a-zÀ-ÿ]+")  # applied to text with A-Z lower-cased
DROP_EVERY = 31
MIN_LENGTH = 7
MIN_COUNT = 2
FORM_FACTOR = 10
#: a bucket with more pairs than this for each of its rows is split
PAIRS_A_ROW = 32
#: distinct words that a task holds before it passes their counts on
HELD_WORDS = 1 << 17


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: the letter runs of all texts, with one code point deleted from about one run in 31."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array(list(totals.values()), pa.int64())], ["word", "n"])
            totals.clear()
            return out

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not text:
                    continue
                start = crc32(f"{'' if doc is None else doc}:".encode())
                low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
                for word, n in Counter(RUN.findall(low)).items():
                    if len(word) >= min_length:
                        h = crc32(word.encode(), start)
                        if h % DROP_EVERY == 0:
                            k = h % len(word)
                            word = word[:k] + word[k + 1:]
                            if len(word) < min_length:
                                continue
                        totals[word] += n
                if len(totals) >= HELD_WORDS:
                    yield flush()
        yield flush()

    parts = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows (word, n, longer, size, lo, hi) with the key of what is known of the word: all but places lo to hi of the shorter one.

    ``longer``: 1 if the row stands for the longer word of a pair, whose open part is one code point longer; size: of the shorter word.
    """
    before = F.substring("word", F.lit(1), F.col("lo"))
    after = F.expr("substring(word, hi + longer + 1)")
    return rows.withColumn("key", F.xxhash64("size", "lo", "hi", before, after))


def halved(rows: DataFrame) -> DataFrame:
    """Each row once for the case that the edit is in the first half of the open part and once for the second."""
    mid = F.expr("(lo + hi) div 2").cast("int")
    cuts = F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), F.col("hi").alias("hi")))
    return _keyed(rows.select("word", "n", "longer", "size", F.inline(cuts)))


def near_pairs(words: DataFrame, tmp: Scratch) -> DataFrame:
    """(a, n_a, b, n_b): all pairs of words (word, n) one edit apart, once."""
    size = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("longer")).select(
        "word", "n", "longer", (size - F.col("longer")).alias("size"), F.lit(0).alias("lo"), (size - F.col("longer")).alias("hi"))
    found, level = [], 0
    while True:
        rows = halved(rows)
        buckets = (rows.groupBy("key").agg(F.sum(1 - F.col("longer")).alias("n_own"), F.sum("longer").alias("n_longer"))
                   .withColumn("n_pairs", F.expr("n_own * (n_own - 1) div 2 + n_own * n_longer")).filter("n_pairs > 0"))
        many: Column = F.col("n_pairs") > PAIRS_A_ROW * (F.col("n_own") + F.col("n_longer"))
        met = tmp.keep(rows.join(buckets, "key").withColumn("split", many & (F.col("hi") > F.col("lo") + 1))
                       .drop("n_own", "n_longer", "n_pairs"), f"met{level}")
        ready = met.filter("not split")
        chunks = ready.filter("longer = 0").select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
        grams = ready.select("key", "longer", F.col("word").alias("b"), F.col("n").alias("n_b"))
        pairs = chunks.join(grams, "key").filter((F.col("longer") == 1) | (F.col("a") < F.col("b")))
        found.append(pairs.filter(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b"))
        rows = met.filter("split").select("word", "n", "longer", "size", "lo", "hi")
        if rows.isEmpty():
            break
        level += 1
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links.distinct()


def roots(forms: DataFrame, tmp: Scratch) -> DataFrame:
    """word, root of forms (word, form): the last word that the forms lead to."""
    reach = tmp.keep(forms.select("word", F.col("form").alias("root")), "reach0")
    step = 0
    while True:
        on = reach.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if reach.join(on, "root", "left_semi").isEmpty():
            return reach
        step += 1
        reach = tmp.keep(reach.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), f"reach{step}")


def variants(words: DataFrame, factor: int = FORM_FACTOR) -> DataFrame:
    """Per word of words (word, n): word, n, n_near, form, form_n, root."""
    tmp = Scratch(words.sparkSession, "spelling")
    words = tmp.keep(words.select("word", "n"), "words")
    links = tmp.keep(near_pairs(words, tmp), "links")
    ends = links.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).unionByName(
        links.select(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near"))
    is_form = -F.col("best.minus") >= factor * F.col("n")
    near = tmp.keep(ends.groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best")).select(
        "word", "n_near", F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.minus")).alias("form_n")), "near")
    last = roots(near.filter("form is not null"), tmp)
    return words.join(near, "word", "left").join(last, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The variants of the words of documents: word, n, n_near, form, form_n, root."""
    return variants(word_counts(docs))
