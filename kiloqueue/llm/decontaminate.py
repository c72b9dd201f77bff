r"""Benchmark decontamination by latent semantic retrieval (operator 4).

Documents are cut into passages of two 32-word blocks, each block shared by two
passages.  Benchmark texts (cut into passages of at most ``ITEM_WORDS`` words)
are taken in blocks of ``BLOCK`` passages; their words are the terms.

1. Document frequencies of the terms over all passages of the corpus.
2. TF-IDF passages that could reach the cosine threshold with some benchmark
   passage: the cosine is at most the length of the benchmark vector's part on
   the shared terms.  All others cannot be candidates and are not stored.
3. Randomised SVD of the stored passages A: Y = A'(A W) with W the benchmark
   vectors and Gaussian columns, summed over tasks in a tree of fan-in ``FAN``;
   W's benchmark vectors and the ``TOPICS`` strongest left singular vectors of the
   rest of Y span the latent space, so products with a benchmark vector are kept in
   full, whatever A holds.
4. Cosine search in that space: of a passage only the part in the space counts, its
   length too, so words that neither the benchmark texts nor the corpus' strongest
   directions explain don't dilute a copy.  That cosine is never below the TF-IDF
   cosine.  Candidates are confirmed when the longest common
   subsequence with the words around the passage has ``OVERLAP`` of the
   benchmark passage's words, and its last sentence (the answer) at least
   ``ANSWER_OVERLAP`` of its own, which allows paraphrase by words changed,
   added or left out.
5. A short text is a minor part of its passage, so its cosine may be low.  Texts
   of less than ``SHORT`` words are therefore also searched for word by word, by
   the hash of their first words; those of less than ``VECTOR_WORDS`` in this way
   alone, as so few words don't carry a paraphrase.

Edge cases: null and empty texts match nothing; benchmark texts with fewer than
``LEAST_WORDS`` words are ordinary phrases and not searched for; repeated rows get equal results;
with an empty benchmark nothing is contaminated; an empty table gives an empty
result.  Only doc_id and text are read; ``clean_documents`` keeps all columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kiloqueue.llm.common import Scratch, fresh

STEP = 32
ITEM_WORDS = 60
LEAST_WORDS, VECTOR_WORDS, SHORT = 4, 8, 24
#: words whose hash leads to the short texts that begin with them
ANCHOR = 8
BLOCK = 256
GAUSSIAN = 16
SMALL = 0.004
TOPICS = 64
FAN = 8
COSINE = 0.5
OVERLAP = 0.6
ANSWER_OVERLAP = 0.4
WORDS = re.compile(r"\w+")


class Items:
    """One block of benchmark passages: their terms, word numbers and answers."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids, self.words, self.answers, self.terms = [], [], [], {}
        for item, text in rows:
            sentences = [s for s in re.split(r"(?<=[.!?])\s+", text.lower()) if WORDS.search(s)]
            answer = len(WORDS.findall(sentences[-1])) if len(sentences) > 1 else 0
            words = WORDS.findall(text.lower())
            pieces = max(1, -(-len(words) // ITEM_WORDS))
            for k in range(pieces):
                part = words[k * len(words) // pieces: (k + 1) * len(words) // pieces]
                if len(part) >= LEAST_WORDS:
                    self.ids.append(item)
                    self.words.append(np.array([self.terms.setdefault(w, len(self.terms)) for w in part]))
                    self.answers.append(min(answer, len(part) // 2) if k == pieces - 1 else 0)

    def vectors(self, idf: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.words), len(self.terms)))
        for i, w in enumerate(self.words):
            if len(w) >= VECTOR_WORDS:
                out[i] = np.bincount(w, minlength=len(self.terms)) * idf
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def _rolling(numbers: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` numbers in a row."""
    out = np.zeros(max(len(numbers) - width + 1, 0), np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + (numbers[k: k + len(out)] + 2).astype(np.uint64)
    return out


class Verbatim:
    """Short texts by the hash of their first words."""

    def __init__(self, items: Items):
        self.words, self.by_width = items.words, {}
        for i, w in enumerate(items.words):
            if len(w) < SHORT:
                width = min(len(w), ANCHOR)
                self.by_width.setdefault(width, {}).setdefault(int(_rolling(w[:width], width)[0]), []).append(i)
        self.hashes = {k: np.sort(np.array(list(v), np.uint64)) for k, v in self.by_width.items()}

    def find(self, numbers: list[np.ndarray]) -> dict[int, list[int]]:
        """Of several texts: the short texts that each one holds, word by word."""
        found: dict[int, set[int]] = {}
        if not self.by_width or not numbers:
            return {}
        stop = np.array([-1], np.int32)  # no text's word
        every = np.concatenate([x for n in numbers for x in (n, stop)])
        starts = np.cumsum([0, *[len(n) + 1 for n in numbers]])
        for width, known in self.hashes.items():
            rolled = _rolling(every, width)
            near = np.minimum(np.searchsorted(known, rolled), len(known) - 1)
            for at in np.flatnonzero(known[near] == rolled).tolist():
                for i in self.by_width[width][int(rolled[at])]:
                    if np.array_equal(every[at: at + len(self.words[i])], self.words[i]):
                        found.setdefault(int(np.searchsorted(starts, at, side="right")) - 1, set()).add(i)
        return {t: sorted(v) for t, v in found.items()}


def term_numbers(text: str | None, terms: dict[str, int]) -> np.ndarray:
    """The term number of each word of a text, -1 for words that are no terms."""
    words = WORDS.findall((text or "").lower())
    return np.fromiter((terms.get(w, -1) for w in words), np.int32, len(words))


def passages(numbers: list[np.ndarray], n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of several texts: passage, term and frequency of every entry; text and block of every passage."""
    blocks = [max(1, -(-len(x) // STEP)) for x in numbers]
    per_text = np.array([max(1, b - 1) for b in blocks], np.int64)
    first = np.concatenate([[0], np.cumsum(per_text)])
    keys = []
    for i, x in enumerate(numbers):
        at = np.flatnonzero(x >= 0)
        block, term = at // STEP, x[at].astype(np.int64)
        for back in (0, 1):
            p = block - back
            ok = (p >= 0) & (p < per_text[i])
            keys.append((first[i] + p[ok]) * n_terms + term[ok])
    every = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    start = np.flatnonzero(np.diff(every, prepend=-1))
    tf = np.diff(np.append(start, len(every)))
    text = np.repeat(np.arange(len(numbers)), per_text)
    return every[start] // n_terms, every[start] % n_terms, tf, text, np.arange(first[-1]) - first[text]


def _groups(texts: list, size: int = 256) -> Iterator[tuple[int, int]]:
    for lo in range(0, len(texts), size):
        yield lo, min(lo + size, len(texts))


def term_frequencies(docs: DataFrame, items: Items) -> tuple[int, np.ndarray]:
    """Number of passages, and of those with each term."""
    n = len(items.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total = np.zeros(n, np.int64), 0
        for b in batches:
            texts = b.column(0).to_pylist()
            for lo, hi in _groups(texts):
                _, term, _, text, _ = passages([term_numbers(t, items.terms) for t in texts[lo:hi]], n)
                df += np.bincount(term, minlength=n)
                total += len(text)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, n)), pa.array(np.concatenate([[total], df]))], ["term", "n"])

    rows = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # terms of one block
    out = np.zeros(n + 1, np.int64)
    for r in rows:
        out[r["term"] + 1] = r["n"]
    return int(out[0]), out[1:]


class Reach:
    """Upper bounds of the cosine of a passage with each benchmark passage, from the terms it has.

    Terms with less than ``SMALL`` of a benchmark vector's squared length are not looked at
    one by one; the bound takes all of them as present.
    """

    def __init__(self, vectors: np.ndarray):
        share = (vectors**2).T
        big = share >= SMALL
        self.items, self.slack = share.shape[1], np.where(big, 0, share).sum(0)
        self.count = big.sum(1)
        self.start = np.cumsum(self.count) - self.count
        term, self.item = np.nonzero(big)
        self.share = share[term, self.item]

    def passages(self, p: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """The passages (of n) whose bound reaches the threshold for some benchmark passage."""
        times = self.count[term]
        at = np.repeat(self.start[term], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        total = np.bincount(np.repeat(p, times) * self.items + self.item[at], weights=self.share[at], minlength=n * self.items)
        return np.flatnonzero((total.reshape(n, self.items) + self.slack >= COSINE**2).any(1))


def near_passages(docs: DataFrame, items: Items, idf: np.ndarray) -> DataFrame:
    """key, terms, weights (a unit vector) and words around of the passages that may reach the cosine threshold.

    A text that holds short benchmark texts word by word has a row for them, their numbers in ``whole``."""
    n, reach, verbatim = len(items.terms), Reach(items.vectors(idf)), Verbatim(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts, out = b.column(0).to_pylist(), b.column(1).to_pylist(), []
            for lo, hi in _groups(texts):
                numbers = [term_numbers(t, items.terms) for t in texts[lo:hi]]
                out += [(keys[lo + i], b"", b"", b"", np.array(held, np.int32).tobytes()) for i, held in verbatim.find(numbers).items()]
                p, term, tf, text, block = passages(numbers, n)
                weight = tf * idf[term]
                norm = np.sqrt(np.bincount(p, weights=weight**2, minlength=len(text)))
                cut = np.searchsorted(p, np.arange(len(text) + 1))
                for k in reach.passages(p, term, len(text)):
                    own = slice(cut[k], cut[k + 1])
                    x, at = numbers[text[k]], int(block[k]) * STEP
                    out.append((keys[lo + text[k]], term[own].astype(np.int32).tobytes(), (weight[own] / norm[k]).astype(np.float32).tobytes(),
                                x[max(0, at - STEP): at + 3 * STEP].tobytes(), b""))
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["key", "terms", "weights", "around", "whole"])

    return docs.select(F.xxhash64("doc_id", "text").alias("key"), "text").mapInArrow(run, "key long, terms binary, weights binary, around binary, whole binary")


def _sparse(batch) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.frombuffer(t, np.int32), np.frombuffer(w, np.float32)) for t, w in zip(batch.column("terms").to_pylist(), batch.column("weights").to_pylist())]


def _range(columns: np.ndarray, floor: float = 0.0) -> np.ndarray:
    """Orthonormal directions of the columns, strongest first."""
    u, s, _ = np.linalg.svd(columns, full_matrices=False)
    return u[:, s > max(s[0] * 1e-10, floor)]


def latent_space(near: DataFrame, vectors: np.ndarray, start: np.ndarray, tmp: Scratch) -> np.ndarray:
    """Orthonormal basis (term, dimension): the range of ``vectors``' and, of A'A ``start``, the ``TOPICS`` strongest
    directions beside it, by singular value decomposition."""
    shape = start.shape
    own = _range(vectors.T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y = np.zeros(shape)
        for b in batches:
            for terms, w in _sparse(b):
                z = w @ start[terms]
                y[terms] += w[:, None] * z
        if y.any():
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([y.tobytes()], pa.binary())], ["part", "y"])

    def add(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t.column("part").to_pylist(), t.column("y").to_pylist()))
        total = np.sum([np.frombuffer(y, np.float64) for _, y in rows], 0)
        return pa.Table.from_pydict({"part": pa.array([rows[0][0]], pa.int64()), "y": pa.array([total.tobytes()], pa.binary())})

    sums, parts, turn = tmp.keep(near.mapInArrow(run, "part long, y binary"), "sums0"), near.rdd.getNumPartitions(), 0
    while parts > 1:
        parts, turn = -(-parts // FAN), turn + 1
        sums = tmp.keep(sums.groupBy(F.pmod("part", F.lit(parts)).alias("g")).applyInArrow(add, "part long, y binary")
                        .withColumn("part", F.pmod("part", F.lit(parts))), f"sums{turn}")
    rows = sums.collect()  # one matrix
    if not rows:
        return own
    y = np.frombuffer(rows[0]["y"], np.float64).reshape(shape).copy()
    floor = 1e-10 * np.linalg.norm(y)
    y -= own @ (own.T @ y)
    return np.concatenate([own, _range(y - own @ (own.T @ y), floor)[:, :TOPICS]], 1)


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a row of bits per step."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        if m := masks.get(x):
            u = v & m
            v = (v + u) | (v - u)
    return len(a) - (v & full).bit_count()


def confirmed(near: DataFrame, items: Items, vectors: np.ndarray, basis: np.ndarray) -> DataFrame:
    """(key, item_id, overlap) of candidates that pass the subsequence and answer checks."""
    queries, v = (vectors @ basis).astype(np.float32), basis.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, keys, around = [], b.column("key").to_pylist(), b.column("around").to_pylist()
            for key, whole in zip(keys, b.column("whole").to_pylist()):
                out += [(key, items.ids[j], 1.0) for j in np.frombuffer(whole, np.int32)]
            rows = _sparse(b)
            for lo, hi in _groups(rows, 1024):
                latent = np.stack([w @ v[t] for t, w in rows[lo:hi]])
                latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
                for i, j in np.argwhere(latent @ queries.T >= COSINE):
                    text = np.frombuffer(around[lo + i], np.int32)
                    words, answer = items.words[j], items.answers[j]
                    share = common_subsequence(words, text) / len(words)
                    if share >= OVERLAP and (not answer or common_subsequence(words[-answer:], text) >= ANSWER_OVERLAP * answer):
                        out.append((keys[lo + i], items.ids[j], share))
            kinds = (pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["key", "item_id", "overlap"])

    return near.mapInArrow(run, "key long, item_id long, overlap double")


def leaks(docs: DataFrame, benchmark: DataFrame, tmp: Scratch) -> DataFrame:
    """(key, item_id, overlap) of documents (by their key) that hold benchmark texts."""
    numbered = tmp.keep(benchmark.filter("text is not null").select("item_id", "text").distinct()
                        .withColumn("n", F.row_number().over(Window.orderBy("item_id", "text"))), "items")
    found, at = None, 0
    while rows := numbered.filter((F.col("n") > at * BLOCK) & (F.col("n") <= (at + 1) * BLOCK)).orderBy("n").collect():  # one block
        at += 1
        items = Items([(r["item_id"], r["text"]) for r in rows])
        if not items.ids:
            continue
        total, df = term_frequencies(docs, items)
        idf = np.log((total + 1) / (df + 1)) + 1e-6
        vectors = items.vectors(idf)
        near = tmp.keep(near_passages(docs, items, idf), f"near{at}")
        start = np.concatenate([vectors.T, np.random.default_rng(at).normal(0, 1, (len(items.terms), GAUSSIAN))], 1)
        basis = latent_space(near, vectors, start, Scratch(docs.sparkSession, "latent"))
        hits = tmp.keep(confirmed(near, items, vectors, basis), f"hits{at}")
        tmp.drop(f"near{at}")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return docs.sparkSession.createDataFrame([], "key long, item_id long, overlap double")
    return found


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, contaminated, n_items, item_ids (ascending), overlap (the largest)."""
    tmp = Scratch(docs.sparkSession, "decontaminate")
    per_doc = leaks(docs, benchmark, tmp).groupBy("key").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max("overlap").alias("most"))
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key")).join(per_doc, "key", "left")
    return keyed.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
                        F.coalesce("items", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("most", F.lit(0.0)).alias("overlap"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a benchmark text, with their columns."""
    tmp = Scratch(docs.sparkSession, "decontaminate")
    key = fresh(docs, "_key")
    keys = tmp.keep(leaks(docs, benchmark, tmp).select(F.col("key").alias(key)).distinct(), "keys")
    return docs.withColumn(key, F.xxhash64("doc_id", "text")).join(keys, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
