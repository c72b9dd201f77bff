"""Language identification with a bidirectional gated recurrent network over bytes (operator 10).

Two gated recurrent layers read the bytes of a segment forwards and backwards
and every byte position gets a distribution over the languages; a document's
distribution is the mean over its letters: ASCII letters and the bytes of
characters beyond ASCII; marks, digits and punctuation don't vote.  Segments are
the words with a boundary mark on both sides, longer ones cut every
``SEGMENT`` bytes, so equal words share one run of the network and every byte
of every text is labelled.

Training is back-propagation through time in numpy, on the words of at most
``MAX_ROWS`` labelled documents (those with the smallest id hash); ``SHARDS``
tasks train on their share and the parameters are averaged between rounds.  The
languages are those of these documents.

Edge cases: a null text or one without a letter is ``und`` with score 0; with no
labelled text every text is ``und``; repeated rows get equal results; empty
tables give empty results.  Only doc_id, text and, for learning, lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiloqueue.llm.common import Scratch, id_bucket

HIDDEN = 16
SEGMENT = 32
MAX_ROWS = 4_096
SHARDS = 8
ROUNDS = 4
#: segments seen in training
SEEN = 160_000
BATCH = 64
RATE = 0.02
UNKNOWN = "und"
EDGE = 32  # the boundary mark is a space
#: segments per run of the network, and words that a task keeps the result of
RUN, HELD = 2_048, 200_000


def segments(word: bytes) -> list[bytes]:
    return [word[i: i + SEGMENT] for i in range(0, len(word), SEGMENT)]


def pack(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte matrix (position, segment) with marks at both ends, and the lengths."""
    size = np.array([len(w) + 2 for w in words])
    out = np.full((size.max(), len(words)), EDGE, np.uint8)
    flat = np.frombuffer(b"".join(words), np.uint8)
    column = np.repeat(np.arange(len(words)), size - 2)
    position = np.arange(len(flat)) - np.repeat(np.cumsum(size - 2) - (size - 2), size - 2) + 1
    out[position, column] = flat
    return out, size


def shapes(langs: int) -> list[tuple[int, ...]]:
    one = [(256, 3 * HIDDEN), (HIDDEN, 3 * HIDDEN), (3 * HIDDEN,)]  # of bytes, of the state, bias; update, reset, new
    return [*one, *one, (2 * HIDDEN, langs), (langs,)]


def unpack(flat: np.ndarray, langs: int) -> list[np.ndarray]:
    out, at = [], 0
    for s in shapes(langs):
        n = int(np.prod(s))
        out.append(flat[at: at + n].reshape(s))
        at += n
    return out


def start_model(langs: int, seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.concatenate([(rng.normal(0, 0.3, s) if len(s) > 1 else np.zeros(s)).astype(np.float32).ravel() for s in shapes(langs)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def gru(x: np.ndarray, live: np.ndarray, u: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States of one layer over input sums x (time, segment, 3 * HIDDEN); a segment's state rests where it is not live."""
    steps, n, _ = x.shape
    h, states, trace = np.zeros((n, HIDDEN), np.float32), np.empty((steps, n, HIDDEN), np.float32), []
    for t in range(steps):
        s = h @ u[:, : 2 * HIDDEN]
        zr = _sigmoid(x[t, :, : 2 * HIDDEN] + s)
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        new = np.tanh(x[t, :, 2 * HIDDEN:] + (r * h) @ u[:, 2 * HIDDEN:])
        gate = z * live[t][:, None]
        if keep:
            trace.append((h, z, r, new))
        h = h + gate * (new - h)
        states[t] = h
    return states, trace


def gru_back(grad: np.ndarray, live: np.ndarray, u: np.ndarray, trace: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of x and u from those of the states, back through time."""
    steps, n, _ = grad.shape
    dx, du, dh = np.zeros((steps, n, 3 * HIDDEN), np.float32), np.zeros_like(u), np.zeros((n, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        h, z, r, new = trace[t]
        on = live[t][:, None]
        dh = dh + grad[t]
        dz = dh * (new - h) * on * z * (1 - z)
        dn = dh * z * on * (1 - new * new)
        back = dn @ u[:, 2 * HIDDEN:].T
        dr = back * h * r * (1 - r)
        dx[t] = np.concatenate([dz, dr, dn], 1)
        du[:, : 2 * HIDDEN] += h.T @ dx[t, :, : 2 * HIDDEN]
        du[:, 2 * HIDDEN:] += (r * h).T @ dn
        dh = dh * (1 - z * on) + back * r + dx[t, :, : 2 * HIDDEN] @ u[:, : 2 * HIDDEN].T
    return dx, du


def forward(parts: list[np.ndarray], data: np.ndarray, size: np.ndarray, keep: bool = False):
    """Probabilities (time, segment, language) of every position."""
    wf, uf, bf, wb, ub, bb, out, bias = parts
    live = (np.arange(len(data))[:, None] < size[None, :]).astype(np.float32)
    f, trace_f = gru(wf[data] + bf, live, uf, keep)
    b, trace_b = gru(wb[data[::-1]] + bb, live[::-1], ub, keep)
    both = np.concatenate([f, b[::-1]], 2)
    logits = both @ out + bias
    logits -= logits.max(2, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(2, keepdims=True)
    return p, live, both, trace_f, trace_b


def gradient(parts: list[np.ndarray], data: np.ndarray, size: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean cross-entropy over all live positions, and its gradient, flat."""
    wf, uf, bf, wb, ub, bb, out, _ = parts
    p, live, both, trace_f, trace_b = forward(parts, data, size, True)
    n = live.sum()
    picked = p[:, np.arange(len(labels)), labels]
    loss = float(-(np.log(np.maximum(picked, 1e-9)) * live).sum() / n)
    d = p
    d[:, np.arange(len(labels)), labels] -= 1
    d = d * (live / n)[:, :, None]
    d_out = np.tensordot(both, d, ([0, 1], [0, 1]))
    d_both = d @ out.T
    dxf, duf = gru_back(d_both[:, :, :HIDDEN], live, uf, trace_f)
    dxb, dub = gru_back(d_both[::-1, :, HIDDEN:], live[::-1], ub, trace_b)
    dwf, dwb = np.zeros_like(wf), np.zeros_like(wb)
    np.add.at(dwf, data, dxf)
    np.add.at(dwb, data[::-1], dxb)
    grads = [dwf, duf, dxf.sum((0, 1)), dwb, dub, dxb.sum((0, 1)), d_out, d.sum((0, 1))]
    return loss, np.concatenate([g.ravel() for g in grads]).astype(np.float32)


def train(model: np.ndarray, langs: int, words: list[bytes], labels: np.ndarray, steps: int, rate: float, seed: int) -> np.ndarray:
    """``steps`` Adam steps on random batches of segments."""
    model, m, v = model.copy(), np.zeros_like(model), np.zeros_like(model)
    rng = np.random.default_rng(seed)
    for k in range(1, steps + 1):
        at = rng.integers(0, len(words), BATCH)
        data, size = pack([words[i] for i in at])
        _, g = gradient(unpack(model, langs), data, size, labels[at])
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        model -= rate * (1 - 0.9 * k / steps) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-6)
    return model


def fit(docs: DataFrame, tmp: Scratch) -> tuple[list[str], np.ndarray]:
    """The languages and the averaged model."""
    learn = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_bucket(F.col("doc_id"), 4) != 2))
    chosen = learn.select("doc_id", "lang", "text").withColumn("order", F.xxhash64("doc_id", "lang"))
    ids = chosen.select("order").orderBy("order").limit(MAX_ROWS).agg(F.max("order").alias("m"))
    rows = tmp.keep(chosen.filter(F.col("order") <= ids.scalar()).select("lang", "text", F.pmod("order", F.lit(SHARDS)).cast("int").alias("shard")), "learn")
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().collect())  # of a bounded sample
    if not langs:
        return [], np.zeros(0, np.float32)
    model, number = start_model(len(langs)), {x: i for i, x in enumerate(langs)}
    for turn in range(ROUNDS):
        now = model

        def work(t: pa.Table) -> pa.Table:
            t = t.sort_by([("lang", "ascending"), ("text", "ascending")])
            by_lang: dict[int, list[bytes]] = {}
            for lang, text in zip(t.column("lang").to_pylist(), t.column("text").to_pylist()):
                by_lang.setdefault(number[lang], []).extend(s for w in text.encode("utf-8", "surrogatepass").split() for s in segments(w))
            by_lang = {k: v for k, v in by_lang.items() if v}
            if not by_lang:
                return pa.Table.from_pydict({"n": pa.array([0], pa.int64()), "model": pa.array([now.tobytes()], pa.binary())})
            # the same number of segments of each language
            rng = np.random.default_rng(turn)
            most = min(max(map(len, by_lang.values())), SEEN)
            words, labels = [], []
            for k, v in sorted(by_lang.items()):
                words += [v[i] for i in rng.integers(0, len(v), most)]
                labels += [k] * most
            after = train(now, len(langs), words, np.array(labels), SEEN // (ROUNDS * SHARDS * BATCH), RATE * (1 - turn / ROUNDS), turn)
            return pa.Table.from_pydict({"n": pa.array([1], pa.int64()), "model": pa.array([after.tobytes()], pa.binary())})

        parts = rows.groupBy("shard").applyInArrow(work, "n long, model binary").filter("n > 0").collect()  # at most SHARDS models
        if parts:
            model = np.mean(sorted((np.frombuffer(r["model"], np.float32) for r in parts), key=lambda a: a.tobytes()), 0).astype(np.float32)
    return langs, model


def letter_free(text: str) -> bool:
    return not any(map(str.isalpha, text))


class WordLabels:
    """Summed probabilities of words, over all positions and over letters, run in batches and held for later words of the task."""

    def __init__(self, model: np.ndarray, langs: int):
        self.parts, self.langs = unpack(model, langs), langs
        self.known: dict[bytes, int] = {}
        self.sums = self.letters = np.zeros((0, langs))

    def learn(self, words: list[bytes]) -> None:
        """Run the network over segments that are new, those of like length together."""
        new = sorted((w for w in set(words) if w not in self.known), key=len)
        if len(self.known) + len(new) > HELD:  # bounded memory: forget, and run words again when they come back
            self.known, self.sums, self.letters, new = {}, self.sums[:0], self.letters[:0], sorted(set(words), key=len)
        rows, letters = [], []
        for lo in range(0, len(new), RUN):
            data, size = pack(new[lo: lo + RUN])
            p, live, *_ = forward(self.parts, data, size)
            rows.append((p * live[:, :, None]).sum(0))
            letter = (data >= 128) | ((data | 32) - ord("a") < 26)  # unsigned bytes: below "a" wraps round
            letters.append((p * (live * letter)[:, :, None]).sum(0))
        self.known.update((w, len(self.sums) + i) for i, w in enumerate(new))
        self.sums, self.letters = np.concatenate([self.sums, *rows]), np.concatenate([self.letters, *letters])

    def of(self, texts: list[list[bytes]]) -> np.ndarray:
        """Mean probabilities of the letters of texts given as segments; no letters: zeros."""
        every = [s for t in texts for s in t]
        self.learn(every)
        at = np.fromiter((self.known[s] for s in every), np.int64, len(every))
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        out = np.stack([np.bincount(owner, weights=self.letters[at, k], minlength=len(texts)) for k in range(self.langs)], 1)
        return out / np.maximum(out.sum(1, keepdims=True), 1e-9)


def identify(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score (its pooled probability)."""
    tmp = Scratch(docs.sparkSession, "language")
    langs, model = fit(docs, tmp)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = WordLabels(model, len(langs)) if langs else None
        for b in batches:
            texts = b.column(2).to_pylist()
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if labels and t and not letter_free(t)]
            for lo in range(0, len(known), 256):
                part = known[lo: lo + 256]
                p = labels.of([[s for w in texts[i].encode("utf-8", "surrogatepass").split() for s in segments(w)] for i in part])
                for i, k, s in zip(part, p.argmax(1), p.max(1)):
                    names[i], scores[i] = langs[k], s
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(scores)],
                                             ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", (id_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double")
