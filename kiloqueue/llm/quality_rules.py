r"""Quality rules and hashed n-gram log-likelihood ratios (operator 6, native).

Two multinomials over hashed uni- and bigrams of words and punctuation runs:
the raw corpus (every document) and a trusted target (documents labelled good,
at most ``max_trusted`` of them, those with the smallest id hash).  A document's
score is the mean over its n-grams of log(p_target / p_raw); ``kept`` is
``score >= threshold`` for documents that pass the base rules.  The target is
smoothed towards the raw corpus, so a bucket without evidence counts 0.

The n-gram counts leave the map tasks as at most ``2**bits`` partial rows each;
the weights (``2**bits`` doubles, 0.5 MB) come back as one scalar.

Edge cases: null text has no words and fails the base rules; an empty text
scores 0; repeated rows get equal results; without labels every score is 0;
empty tables give empty results.  Extra columns of the input are kept by
``filter_documents`` and ignored by ``quality_rules``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiloqueue.llm.common import SPACE_CHARS, Scratch, let

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
BITS = 16
MAX_TRUSTED = 20_000
THRESHOLD = -0.35
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"


def _without(text: Column, chars: str, by: str = "") -> Column:
    """``text`` with each of ``chars`` replaced: plain byte searches, no pattern."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(by))
    return text


def _words(text: Column) -> Column:
    """The words by a split at single spaces, which needs no pattern."""
    return F.array_remove(F.split(_without(text, SPACE_CHARS.replace(" ", ""), " "), " ", -1), "")


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    Windows are packed as (hash bits, position) into longs, so one primitive sort puts equal
    windows side by side; the few candidates are confirmed on their full 64-bit hashes.
    """
    def windows(h: Column) -> Column:
        n = F.size(h) - 2
        full = F.transform(F.slice(h, 1, F.greatest(n, F.lit(0))),
                           lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))
        # most texts repeat no window
        return let(full, lambda f: F.when(F.size(F.array_distinct(f)) == F.size(f), F.lit(0).cast("long")).otherwise(
            pack(f, F.ceil(F.log2(F.greatest(n, F.lit(1)) + 1)).cast("int"))))

    def pack(f: Column, bits: Column) -> Column:
        low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        keys = let(low, lambda m: F.sort_array(F.transform(
            f, lambda x, i: x.bitwiseAND(F.bitwise_not(m)).bitwiseOR(i.cast("long")))))
        near = let(F.struct(keys.alias("k"), low.alias("m"), f.alias("f")), lambda s: F.transform(
            F.filter(s["k"], lambda x, i: twin(x, s["k"], s["m"], i)),
            lambda x: F.struct(F.get(s["f"], x.bitwiseAND(s["m"]).cast("int")).alias("h"), x.bitwiseAND(s["m"]).alias("p"))))
        return let(F.sort_array(near), confirmed)

    def twin(x: Column, keys: Column, m: Column, i: Column) -> Column:
        high = F.bitwise_not(m)
        same = lambda other: F.coalesce(other.bitwiseAND(high) == x.bitwiseAND(high), F.lit(False))
        return same(F.get(keys, i - 1)) | same(F.get(keys, i + 1))

    def confirmed(c: Column) -> Column:
        equal = lambda x, other: F.coalesce(other["h"] == x["h"], F.lit(False))
        at = F.sort_array(F.transform(
            F.filter(c, lambda x, i: equal(x, F.get(c, i - 1)) | equal(x, F.get(c, i + 1))), lambda x: x["p"]))
        # each window covers three words, less those that the next one covers too
        return let(at, lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(p, i + 1) - x, F.lit(3).cast("long")))),
            F.lit(0).cast("long"), lambda a, x: a + x))

    return let(F.transform(words, lambda w: F.xxhash64(w)), windows)


def base_columns(text: Column) -> dict[str, Column]:
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    return {
        "word_chars": F.length(_without(t, SPACE_CHARS)).cast("long"),
        "n_symbols": (F.length(t) - F.length(_without(t, SYMBOLS))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n": let(_words(t), lambda w: F.struct(F.size(w).cast("long").alias("words"), repeat_words(w).alias("repeat"))),
    }


def gram_buckets(text: Column, bits: int = BITS) -> Column:
    """Buckets of all uni- and bigrams of a text, in order."""
    mask = F.lit((1 << bits) - 1).cast("long")
    hashes = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), lambda w: F.xxhash64(w))
    return let(hashes, lambda h: F.concat(
        F.transform(h, lambda x: x.bitwiseAND(mask).cast("int")),
        F.transform(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))),
                    lambda x, i: F.xxhash64(x, F.get(h, i + 1)).bitwiseAND(mask).cast("int"))))


def trusted_ids(labels: DataFrame, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """Ids labelled good: at most ``max_trusted``, the smallest by hash."""
    ids = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_trusted)


def fit_ratio(docs: DataFrame, trusted: DataFrame, bits: int = BITS) -> DataFrame:
    """One row with ``weights``: for each bucket, log(p_target / p_raw)."""
    marked = docs.select("doc_id", "text").join(
        F.broadcast(trusted.withColumn("t", F.lit(1))), "doc_id", "left")  # at most max_trusted ids
    counts = (marked.select(F.explode(gram_buckets(F.col("text"), bits)).alias("bucket"), F.coalesce("t", F.lit(0)).alias("t"))
              .groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("t").alias("good")))
    every = docs.sparkSession.range(1 << bits).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    one = F.struct("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("good", F.lit(0)).alias("good"))
    table = every.agg(F.sort_array(F.collect_list(one)).alias("b"), F.sum("raw").alias("n"), F.sum("good").alias("m"))
    prior = float(1 << bits)
    raw = lambda x: (x["raw"] + 1.0) / (F.coalesce("n", F.lit(0)) + prior)
    return table.select(F.transform("b", lambda x: F.log(
        (x["good"] + prior * raw(x)) / ((F.coalesce("m", F.lit(0)) + prior) * raw(x)))).alias("weights"))


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, bits: int = BITS,
                  max_trusted: int = MAX_TRUSTED, keep: list[str] | None = None) -> DataFrame:
    """Per document: doc_id, base counts, base_failed, score, kept, and the columns named in ``keep``."""
    tmp = Scratch(docs.sparkSession, "quality")
    ids = tmp.keep(trusted_ids(labels, max_trusted), "trusted")
    model = tmp.keep(fit_ratio(docs, ids, bits), "model")
    inside = lambda grams, m: F.when(F.size(grams) > 0, F.aggregate(
        grams, F.lit(0.0), lambda a, g: a + F.get(m, g)) / F.size(grams)).otherwise(F.lit(0.0))
    columns = base_columns(F.col("text"))
    scored = docs.withColumn("_m", model.scalar()).select(
        "doc_id", *(keep or []), *[c.alias(f"_{n}") for n, c in columns.items()],
        let(F.struct(gram_buckets(F.col("text"), bits).alias("g"), F.col("_m").alias("m")),
            lambda s: inside(s["g"], s["m"])).alias("_score"))
    words, repeat = F.col("_n.words"), F.col("_n.repeat")
    failed = (words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * words)
    return scored.select(
        "doc_id", *(keep or []), words.alias("n_words"), F.col("_word_chars").alias("word_chars"),
        F.col("_n_symbols").alias("n_symbols"), F.col("_n_dup_lines").alias("n_dup_lines"),
        repeat.alias("n_repeat_words"), failed.alias("base_failed"), F.col("_score").alias("score"),
        (~failed & (F.col("_score") >= threshold)).alias("kept"))


def filter_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the rules keep, with their columns."""
    columns = docs.columns
    renamed = docs.select(*[F.col(f"`{c}`").alias(c if c in ("doc_id", "text") else f"in_{i}") for i, c in enumerate(columns)])
    kept = quality_rules(renamed, labels, keep=["text"] + [c for c in renamed.columns if c not in ("doc_id", "text")], **options)
    back = {c if c in ("doc_id", "text") else f"in_{i}": c for i, c in enumerate(columns)}
    return kept.filter("kept").select(*[F.col(k).alias(c) for k, c in back.items()])
