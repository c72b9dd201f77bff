"""Quality classifier with subword embeddings (operator 2).

A document is the mean of learned vectors of its words and of the byte n-grams
inside them, hashed into ``2**BITS`` rows; a softmax layer gives the classes.
A word that follows itself adds one more row, the same for all words.  Training
is stochastic gradient descent in numpy on at most ``MAX_ROWS`` labelled
documents (those with the smallest id hash): each of ``SHARDS`` tasks passes
over its share and the parameters are averaged between rounds.

The output is linear in the mean vector, so the trained model is folded into one
logit per hashed row (0.25 MB), which is what the scoring tasks get; they run
over the bytes of whole texts with no step per word.

Edge cases: null and empty texts have no features and get the bias alone; with
no labels scores are those of the untrained model, all near 0.5, with one class
they lean to it; repeated rows score alike; empty tables give empty results.  Only
doc_id and text of the documents are read, and doc_id not as a feature.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiloqueue.llm.common import Scratch, hash_words, id_bucket, text_blocks

BITS = 16
DIM = 8
NGRAMS = (2, 3, 4)
MAX_ROWS = 8_192
SHARDS = 8
ROUNDS = 4
#: documents seen in training at least; small training sets are passed over more often
SEEN = 20_000
RATE = 0.5
#: a row's share of a document is small, so the vectors take longer steps than the output layer
GAIN = 100
BATCH = 8
#: the row of immediate repetitions
REPEAT = 0
THRESHOLD = 0.7
_MASK = (1 << BITS) - 1


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed rows of all features of ``texts`` (any order inside a text), and the text number of each."""
    words, at = hash_words(texts, lower=False)
    rows, owner = [(words & np.uint64(_MASK)).astype(np.int32)], [np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(at))]
    again = words[1:] == words[:-1]  # a word right after itself: all such pairs share one row
    again[at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(words))] - 1] = False
    rows.append(np.full(int(again.sum()), REPEAT, np.int32))
    owner.append(owner[0][1:][again])
    raw = [b"\n" + (t or "").encode("utf-8", "surrogatepass") + b"\n" for t in texts]  # a text has its own boundaries
    buf = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), [len(r) for r in raw])
    # white space becomes one boundary mark, which n-grams may begin or end with
    gap = (buf == 32) | ((buf >= 9) & (buf <= 13))
    buf[gap] = 32
    code, inner = buf.copy(), np.zeros(len(buf), bool)
    for n in range(2, max(NGRAMS) + 1):
        size = len(buf) - n + 1
        if size <= 0:
            break
        inner = inner[:size] | (gap[n - 2: n - 2 + size] if n > 2 else False)
        code = code[:size] * np.uint32(0x01000193) + buf[n - 1:]
        if n in NGRAMS:
            keep = np.flatnonzero(~inner & ~(gap[:size] & gap[n - 1:] & (n == 2)))
            h = code[keep] * np.uint32(0x9E3779B1) + np.uint32(n)
            rows.append(((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77) >> np.uint32(32 - BITS)).astype(np.int32))
            owner.append(doc[keep])
    return np.concatenate(rows), np.concatenate(owner)


def start_model(seed: int = 7) -> np.ndarray:
    """Embeddings, then the two class vectors, then the two biases, flat."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    return np.concatenate([table.ravel(), rng.normal(0, 0.1, 2 * DIM).astype(np.float32), np.zeros(2, np.float32)])


def _parts(model: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = DIM << BITS
    return model[:n].reshape(-1, DIM), model[n: n + 2 * DIM].reshape(2, DIM), model[-2:]


def train_epoch(model: np.ndarray, bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rate: float, seed: int) -> np.ndarray:
    """One pass of minibatch gradient descent.  bags: (rows, share of each row) per document, see ``_weighted``."""
    model = model.copy()
    table, out, bias = _parts(model)
    order = np.random.default_rng(seed).permutation(len(bags))
    for lo in range(0, len(order), BATCH):
        batch = order[lo: lo + BATCH]
        hidden = np.stack([bags[i][1] @ table[bags[i][0]] if len(bags[i][0]) else np.zeros(DIM, np.float32) for i in batch])
        z = hidden @ out.T + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(batch)), labels[batch]] -= 1  # gradient of the logits
        back = p @ out
        step = rate * (1 - 0.9 * lo / max(len(order), 1))
        out -= step * (p.T @ hidden) / len(batch)
        bias -= step * p.mean(0)
        for i, g in zip(batch, back):
            table[bags[i][0]] -= step * bags[i][1][:, None] * g * GAIN
    return model


def _bag(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and how often each occurs, two bytes each (counts above 65535 stay there)."""
    unique, counts = np.unique(rows, return_counts=True)
    return unique.astype(np.uint16), np.minimum(counts, 65535).astype(np.uint16)


def _weighted(rows: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = np.frombuffer(counts, np.uint16).astype(np.float32)
    return np.frombuffer(rows, np.uint16).astype(np.int32), n / max(n.sum(), 1)


def fit(rows: DataFrame, tmp: Scratch, rounds: int = ROUNDS) -> np.ndarray:
    """The averaged model after ``rounds`` rounds over (text, label, shard); a few MB travel each round."""
    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            bags = []
            for lo, hi in text_blocks(texts):
                r, o = features(texts[lo:hi])
                bags += [_bag(x) for x in np.split(r[np.argsort(o, kind="stable")], np.cumsum(np.bincount(o, minlength=hi - lo))[:-1])]
            yield pa.RecordBatch.from_arrays(
                [b.column(1), b.column(2), pa.array([x[0].tobytes() for x in bags], pa.binary()), pa.array([x[1].tobytes() for x in bags], pa.binary())],
                ["label", "shard", "rows", "counts"])

    made = rows.select("text", "label", "shard").mapInArrow(featurise, "label int, shard int, rows binary, counts binary")
    # one file a shard: a round reads its share in place, without a shuffle
    bags = tmp.keep(made.repartition(SHARDS, "shard"), "bags").select("label", "rows", "counts")
    model = start_model()
    passes = max(1, -(-SEEN // max(rounds * bags.count(), 1)))
    for turn in range(rounds):
        now, rate = model, RATE * (1 - turn / rounds)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = sorted((r, c, y) for b in batches for y, r, c in zip(*(x.to_pylist() for x in b.columns)))  # the same order in every run
            if got:
                after, own, labels = now, [_weighted(r, c) for r, c, _ in got], np.array([y for *_, y in got])
                for k in range(passes):
                    after = train_epoch(after, own, labels, rate, turn * passes + k)
                yield pa.RecordBatch.from_arrays([pa.array([len(own)], pa.int64()), pa.array([after.tobytes()], pa.binary())], ["n", "model"])

        parts = bags.mapInArrow(work, "n long, model binary").collect()  # a model of 2 MB for each file of the bounded sample
        if not parts:
            return model
        parts = sorted(parts, key=lambda r: (r["n"], bytes(r["model"])))
        model = sum(r["n"] * np.frombuffer(r["model"], np.float32).astype(np.float64) for r in parts) / sum(r["n"] for r in parts)
        model = model.astype(np.float32)
    return model


def training_rows(docs: DataFrame, labels: DataFrame, tmp: Scratch, max_rows: int = MAX_ROWS) -> DataFrame:
    """(text, label, shard) of at most ``max_rows`` labelled documents outside the held-out quarter."""
    chosen = tmp.keep(labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (id_bucket(F.col("doc_id"), 4) != 2))
                      .groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
                      .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows), "chosen")
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most max_rows ids
    return joined.select("text", "label", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SHARDS)).cast("int").alias("shard"))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score (of class 1), predicted."""
    tmp = Scratch(docs.sparkSession, "classifier")
    rows = training_rows(docs, labels, tmp)
    table, out, bias = _parts(fit(rows, tmp))
    logit, base = (table @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, means = b.column(2).to_pylist(), []
            for lo, hi in text_blocks(texts):
                r, o = features(texts[lo:hi])
                total = np.bincount(o, weights=logit[r], minlength=hi - lo)
                means.append(total / np.maximum(np.bincount(o, minlength=hi - lo), 1))
            z = (np.concatenate(means) if means else np.zeros(0)) + base
            score = 1 / (1 + np.exp(-z))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                                             ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", (id_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int")
