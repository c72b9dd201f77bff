"""Bigram language model in Elias-Fano tries (operator 8).

Tokens are the words with A-Z lower-cased and one end mark per document; a start
mark is the first word's context.  Words are known by their 64-bit hashes.

1. Word counts of the training documents, aggregated per task before the
   shuffle.  Words with at least a ``1 / FREQUENT`` share of all tokens (so at
   most ``FREQUENT`` of them) go to every task.
2. Each task packs its texts' bigrams into one row per shard: contexts once,
   successors as 40-bit hashes, document numbers.  A shard is a range of context
   hashes; contexts with more than a quarter of a shard's tokens are split over
   all shards by successor.  Shards grow in number, not in size.
3. A shard counts its training bigrams and builds a trie of two levels over
   them: Elias-Fano coded context hashes and their backoff codes; monotone
   Elias-Fano pointers to each context's successors; successors as their place
   in the shard's own sorted word list, made monotone by the context's number;
   and 16-bit codes of the smoothed log10 probabilities.  The levels are mapped
   from a file, and every distinct bigram of the shard's documents is looked up
   by successor search within its context's range.
4. The shard's sums per document meet again by the batch they came from.

Smoothing: p(w | v) = (c(v w) + PRIOR * q(w)) / (c(v) + PRIOR).  With ``all_words``
q is exact for all words, with the mass of one token for the unknown word: the
counts of the words that are not frequent are joined by word to the shards that
hold them.  Without it they and the unknown word share the rest of the mass
equally.  Either way q sums to 1 and so does p.

Edge cases: a null text is empty and has the end mark only; with no training
document all counts are 0 and scores are those of the unknown word; repeated
rows are scored each; a null doc_id has remainder 0, so it is held out; an empty
table gives an empty result.
"""

from __future__ import annotations

import os
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiloqueue.llm.common import Scratch, hash_words, id_bucket, text_blocks

PRIOR = 32.0
FREQUENT = 1 << 17
SHARD_TOKENS = 1_500_000
BATCH_CHARS = 6 << 20
START, END = np.uint64(0x5354415254000001), np.uint64(0x454E440000000001)
#: log10 probabilities are coded in steps of CODE_STEP from 0 down
CODE_STEP = 2.0**-12
_U = np.uint64
_W_BITS = 40
_W_MASK = _U((1 << _W_BITS) - 1)


# ------------------------------------------------------------- Elias-Fano

def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Values of ``bits`` bits each, side by side in 64-bit words."""
    out = np.zeros(len(values) * bits // 64 + 2, _U)
    if bits:
        at = np.arange(len(values), dtype=np.int64) * bits
        word, off = at >> 6, (at & 63).astype(_U)
        np.bitwise_or.at(out, word, values << off)
        over = np.flatnonzero(off > _U(64 - bits))
        np.bitwise_or.at(out, word[over] + 1, values[over] >> (_U(64) - off[over]))
    return out


def _get(words: np.ndarray, bits: int, at: np.ndarray) -> np.ndarray:
    if not bits:
        return np.zeros(len(at), _U)
    bit = at.astype(np.int64) * bits
    word, off = bit >> 6, (bit & 63).astype(_U)
    low = words[word] >> off
    high = np.where(off > 0, words[word + 1] << ((_U(64) - off) & _U(63)), _U(0))
    return (low | high) & _U((1 << bits) - 1 if bits < 64 else 0xFFFFFFFFFFFFFFFF)


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary with a count of zeros per 64-bit word."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.bits, self.low, self.high, self.zeros = n, bits, low, high, zeros

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        """Of ascending unsigned 64-bit values."""
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = _pack(values & _U((1 << bits) - 1), bits)
        size = (top >> bits) + n + 1
        unary = np.zeros(-(-size // 64) * 64, np.uint8)
        unary[(values >> _U(bits)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(unary, bitorder="little").view(_U)
        zeros = np.cumsum(64 - np.bitwise_count(high).astype(np.int64))
        return cls(n, bits, low, high, zeros)

    def _before(self, h: np.ndarray) -> np.ndarray:
        """How many values have a high part below ``h``: the place of the h-th zero, less the zeros before it."""
        out = np.full(len(h), self.n, np.int64)
        first = h == 0
        out[first] = 0
        some = np.flatnonzero(~first & (h <= int(self.zeros[-1]) if len(self.zeros) else False))
        k = h[some].astype(np.int64) - 1  # the k-th zero, from 0
        word = np.searchsorted(self.zeros, k, side="right")
        k -= np.where(word > 0, self.zeros[np.maximum(word - 1, 0)], 0)
        rest, place = ~self.high[word], np.zeros(len(some), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            inside = np.bitwise_count(rest & _U((1 << width) - 1)).astype(np.int64)
            jump = k >= inside
            k -= np.where(jump, inside, 0)
            place += np.where(jump, width, 0)
            rest = np.where(jump, rest >> _U(width), rest)
        out[some] = np.minimum(word * 64 + place - (h[some].astype(np.int64) - 1), self.n)
        return out

    def successor(self, x: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """The first place in [lo, hi) whose value is not below x (hi if there is none)."""
        h = x >> _U(self.bits)
        a, b = self._before(h), self._before(h + _U(1))
        if lo is not None:
            a, b = np.clip(a, lo, hi), np.clip(b, lo, hi)
        want = x & _U((1 << self.bits) - 1)
        open_ = np.flatnonzero(a < b)
        while len(open_):
            mid = (a[open_] + b[open_]) >> 1
            less = _get(self.low, self.bits, mid) < want[open_]
            a[open_] = np.where(less, mid + 1, a[open_])
            b[open_] = np.where(less, b[open_], mid)
            open_ = open_[a[open_] < b[open_]]
        return a

    def get(self, at: np.ndarray) -> np.ndarray:
        """The values at the given places."""
        ones = np.arange(1, len(self.high) + 1, dtype=np.int64) * 64 - self.zeros
        word = np.searchsorted(ones, at, side="right")
        k = at - np.where(word > 0, ones[np.maximum(word - 1, 0)], 0)
        rest, place = self.high[word], np.zeros(len(at), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            inside = np.bitwise_count(rest & _U((1 << width) - 1)).astype(np.int64)
            jump = k >= inside
            k = k - np.where(jump, inside, 0)
            place += np.where(jump, width, 0)
            rest = np.where(jump, rest >> _U(width), rest)
        return ((word * 64 + place - at).astype(_U) << _U(self.bits)) | _get(self.low, self.bits, at)

    def find(self, x: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """The places of x, -1 where it is absent."""
        at = self.successor(x, lo, hi)
        inside = np.flatnonzero(at < (self.n if hi is None else hi))
        out = np.full(len(x), -1, np.int64)
        hit = self.get(at[inside]) == x[inside]
        out[inside[hit]] = at[inside[hit]]
        return out

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.bits], np.int64), self.low, self.high, self.zeros]


# ------------------------------------------------------------------- trie

class Trie:
    """Contexts, pointers, successors and codes of one shard; ``save`` and ``open`` map it from a file."""

    def __init__(self, arrays: list[np.ndarray]):
        ef = lambda k: EliasFano(int(arrays[k][0]), int(arrays[k][1]), *arrays[k + 1: k + 4])
        self.words, self.contexts, self.pointers, self.successors = ef(0), ef(4), ef(8), ef(12)
        self.codes, self.backoff = arrays[16], arrays[17]
        self.all = arrays

    @classmethod
    def build(cls, contexts: np.ndarray, runs: np.ndarray, successors: np.ndarray, logp: np.ndarray, log_backoff: np.ndarray) -> Trie:
        """From sorted contexts, the number of successors of each, and the successors sorted within each context."""
        words = np.unique(successors)
        number = np.repeat(np.arange(len(contexts), dtype=_U), runs)
        monotone = number * _U(max(len(words), 1)) + np.searchsorted(words, successors).astype(_U)
        pointers = np.concatenate([[0], np.cumsum(runs)]).astype(_U)
        code = lambda x: np.minimum(np.round(-x / CODE_STEP), 65535).astype(np.uint16)
        parts = [EliasFano.build(v).arrays() for v in (words, contexts, pointers, monotone)]
        return cls([*(a for p in parts for a in p), code(logp), code(log_backoff)])

    def save(self, path: str) -> None:
        with open(path, "wb") as f:
            f.write(struct.pack("<18Q", *(len(a) for a in self.all)))
            for a in self.all:
                f.write(a.tobytes() + bytes(-a.nbytes % 8))

    @classmethod
    def open(cls, path: str) -> Trie:
        data = np.memmap(path, np.uint8, "r")
        sizes, at, arrays = struct.unpack("<18Q", data[:144].tobytes()), 144, []
        for i, n in enumerate(sizes):
            kind = np.dtype(np.uint16 if i >= 16 else np.int64 if i % 4 in (0, 3) else _U)
            arrays.append(data[at: at + n * kind.itemsize].view(kind))
            at += -(-n * kind.itemsize // 8) * 8
        return cls(arrays)

    def score(self, contexts: np.ndarray, of: np.ndarray, words: np.ndarray, word: np.ndarray, log_q: np.ndarray) -> np.ndarray:
        """log10 p of the bigrams (contexts[of], words[word]); log_q: log10 q of ``words``."""
        at, ids = self.contexts.find(contexts), self.words.find(words)
        lo = np.where(at >= 0, self.pointers.get(np.maximum(at, 0)).astype(np.int64) if self.contexts.n else 0, 0)
        hi = np.where(at >= 0, self.pointers.get(np.maximum(at, 0) + 1).astype(np.int64) if self.contexts.n else 0, 0)
        back = np.where(at >= 0, -CODE_STEP * self.backoff[np.maximum(at, 0)].astype(np.float64) if self.contexts.n else 0.0, 0.0)
        out = back[of] + log_q[word]
        asked = np.flatnonzero((at[of] >= 0) & (ids[word] >= 0))
        if len(asked):
            c, w = of[asked], word[asked]
            x = at[c].astype(_U) * _U(max(self.words.n, 1)) + ids[w].astype(_U)
            place = self.successors.find(x, lo[c], hi[c])
            seen = place >= 0
            out[asked[seen]] = -CODE_STEP * self.codes[place[seen]].astype(np.float64)
        return out


# ------------------------------------------------------------ Spark steps

class Counts:
    """What every task knows: totals, the frequent words with their counts, the mass of all others."""

    def __init__(self, tokens: int, distinct: int, frequent: list[tuple[int, int]], documents: int, shards: int, all_words: bool = False):
        self.tokens, self.distinct, self.documents, self.shards, self.all_words = tokens, distinct, documents, shards, all_words
        h = np.array([f[0] for f in frequent], np.int64).view(_U)
        order = np.argsort(h)
        self.hash, self.count = h[order], np.array([f[1] for f in frequent], np.int64)[order]
        short = h[order] & _W_MASK
        again = np.argsort(short)
        self.short, self.short_count = short[again], self.count[again]
        others, mass = (0, 0) if all_words else (distinct - len(h), tokens - int(self.count.sum()))
        self.log_rest = float(np.log10((mass + 1) / (tokens + 1) / (others + 1)))
        # contexts with over a quarter of a shard's share are split by successor
        self.split = self.hash[self.count * 4 * shards > tokens] if len(h) else self.hash
        self.split = np.union1d(self.split, np.array([START], _U))

    def of_context(self, v: np.ndarray) -> np.ndarray:
        """Counts of split contexts; -1 for others."""
        out = np.full(len(v), -1, np.int64)
        split = np.isin(v, self.split)
        if len(self.hash):
            at = np.minimum(np.searchsorted(self.hash, v), len(self.hash) - 1)
            out[split] = np.where(self.hash[at] == v, self.count[at], 0)[split]
        else:
            out[split] = 0
        out[v == START] = self.documents
        return out

    def log_q(self, w: np.ndarray, rare: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """log10 of the lower-order probability of successors given by their 40 bits; ``rare``: sorted other words and their counts."""
        out = np.full(len(w), self.log_rest)
        for short, count in ([rare] if rare else []) + [(self.short, self.short_count)]:
            if len(short):
                at = np.minimum(np.searchsorted(short, w), len(short) - 1)
                hit = short[at] == w
                out[hit] = np.log10(count[at[hit]] / (self.tokens + 1))
        return out

    def shard(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The shard of each bigram."""
        spread = np.isin(v, self.split)
        return (((np.where(spread, w, v) >> _U(32)) * _U(self.shards)) >> _U(32)).astype(np.uint32)


def _tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the texts with the end mark after each, and the text number of each token."""
    h, at = hash_words(texts)
    n = np.diff(at)
    h = np.insert(h, at[1:], END)
    return h, np.repeat(np.arange(len(texts)), n + 1)


def word_counts(train: DataFrame) -> DataFrame:
    """(word, n) of all tokens of the texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merge() -> tuple[np.ndarray, np.ndarray]:
            h, c = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(h)
            first = np.flatnonzero(np.diff(h[order], prepend=h[order][:1] + _U(1)))
            return h[order][first], np.add.reduceat(c[order], first)

        def out(part: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(part[0].view(np.int64)), pa.array(part[1])], ["word", "n"])

        for b in batches:
            texts = b.column(0).to_pylist()
            for lo, hi in text_blocks(texts):
                h, c = np.unique(_tokens(texts[lo:hi])[0], return_counts=True)
                held.append((h, c.astype(np.int64)))
                if sum(len(x[0]) for x in held) > 2_000_000:
                    held = [merge()]
                    if len(held[0][0]) > 1_000_000:
                        yield out(held.pop())
        if held:
            yield out(merge())

    return train.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def counts(train: DataFrame, tmp: Scratch, all_words: bool = False) -> tuple[Counts, DataFrame]:
    """What every task knows, and (short, n) of the words that are not frequent."""
    words = tmp.keep(word_counts(train), "words")
    total = words.agg(F.sum("n"), F.count("*")).first()
    tokens, distinct = int(total[0] or 0), int(total[1])
    frequent = words.filter(F.col("n") * FREQUENT >= tokens).collect()  # at most FREQUENT
    end = [r["n"] for r in frequent if r["word"] == int(END.astype(np.int64))] or \
        [r["n"] for r in words.filter(F.col("word") == int(END.astype(np.int64))).collect()]
    known = Counts(tokens, distinct, [(r["word"], r["n"]) for r in frequent], int(end[0]) if end else 0, max(1, -(-tokens // SHARD_TOKENS)), all_words)
    rare = words.filter(F.col("n") * FREQUENT < tokens).groupBy(F.col("word").bitwiseAND(F.lit(int(_W_MASK))).alias("short")).agg(F.sum("n").alias("n"))
    return known, rare


def _bigrams_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, words and text numbers of the bigrams of the texts."""
    parts = [_tokens(texts[lo:hi]) + (lo,) for lo, hi in text_blocks(texts)]
    w = np.concatenate([p[0] for p in parts])
    doc = np.concatenate([p[1] + p[2] for p in parts])
    v = np.concatenate([[START], w[:-1]])
    v[np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1])] = START
    return v, w, doc


def rare_counts(docs: DataFrame, known: Counts, rare: DataFrame) -> DataFrame:
    """(shard, short, n): the counts of the words that are not frequent, for each shard that holds them as successors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            for lo, hi in text_blocks(texts):
                v, w, _ = _bigrams_of(texts[lo:hi])
                own = ~np.isin(w, known.hash)
                v, w = v[own], w[own]
                pair = np.unique(known.shard(v, w).astype(_U) << _U(_W_BITS) | w & _W_MASK)
                yield pa.RecordBatch.from_arrays([pa.array((pair >> _U(_W_BITS)).astype(np.int32)), pa.array((pair & _W_MASK).astype(np.int64))], ["shard", "short"])

    return docs.select("text").mapInArrow(run, "shard int, short long").distinct().join(rare, "short").select("shard", "short", "n")


BIGRAMS = "shard int, batch long, v binary, runs binary, w binary, doc binary, train binary, ids binary, tokens binary"


def bigrams(docs: DataFrame, known: Counts) -> DataFrame:
    """One row per batch of documents and shard.  ids and tokens of the documents ride on a batch's first row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            texts = b.column(2).to_pylist()
            ids = b.column(0)
            held = np.array(b.column(1).to_pylist(), bool)
            for lo, hi in text_blocks(texts, BATCH_CHARS):
                yield pack_batch(texts[lo:hi], ids.slice(lo, hi - lo), ~held[lo:hi], number)
                number += 1

    def pack_batch(texts: list, ids: pa.Array, train: np.ndarray, number: int) -> pa.RecordBatch:
        v, w, doc = _bigrams_of(texts)
        order = np.argsort(v, kind="stable")
        v, w, doc = v[order], w[order], doc[order]
        shard = known.shard(v, w)
        order = np.argsort(shard, kind="stable")
        v, w, doc, shard = v[order], (w[order] & _W_MASK), doc[order].astype(np.uint32), shard[order]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
        tokens = np.bincount(doc, minlength=len(texts)).astype(np.int64)
        small = np.uint16 if len(texts) <= 65536 else np.uint32
        rows = []
        for k, (lo, hi) in enumerate(zip(cut[:-1], cut[1:])):
            first = np.flatnonzero(np.diff(v[lo:hi], prepend=~v[lo: lo + 1]))
            runs = np.diff(np.append(first, hi - lo)).astype(np.uint32)
            bytes5 = w[lo:hi].view(np.uint8).reshape(-1, 8)[:, :5]
            known_ids = b"".join([ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(), ids.is_valid().to_numpy(zero_copy_only=False).tobytes()])
            rows.append((int(shard[lo]), number, v[lo:hi][first].tobytes(), runs.tobytes(), bytes5.tobytes(), doc[lo:hi].astype(small).tobytes(),
                         train.tobytes(), known_ids if k == 0 else None, tokens.tobytes() if k == 0 else None))
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 7]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)],
                                          ["shard", "batch", "v", "runs", "w", "doc", "train", "ids", "tokens"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, BIGRAMS)


SUMS = "batch long, train binary, ids binary, tokens binary, doc binary, known binary, base binary, score binary"


def score_shard(known: Counts, prior: float = PRIOR):
    """The function over one shard's rows (and its words' counts): counts, trie, look-ups, sums per document."""
    def unpack(t: pa.Table):
        v, w, doc, train, at = [], [], [], [], 0
        spans = []
        for vb, rb, wb, db, tb in zip(*(t.column(c).to_pylist() for c in ("v", "runs", "w", "doc", "train"))):
            flags = np.frombuffer(tb, bool)
            wide = np.zeros((len(wb) // 5, 8), np.uint8)
            wide[:, :5] = np.frombuffer(wb, np.uint8).reshape(-1, 5)
            d = np.frombuffer(db, np.uint16 if len(flags) <= 65536 else np.uint32)
            v.append(np.repeat(np.frombuffer(vb, _U), np.frombuffer(rb, np.uint32)))
            w.append(wide.view(_U).ravel())
            doc.append(d.astype(np.int32) + at)
            train.append(flags)
            spans.append((at, len(flags)))
            at += len(flags)
        return np.concatenate(v), np.concatenate(w), np.concatenate(doc), np.concatenate(train), spans

    def run(t: pa.Table, other: pa.Table | None) -> pa.Table:
        rare = None
        if other is not None:
            short, count = other.column("short").to_numpy().astype(_U), other.column("n").to_numpy()
            order = np.argsort(short)
            rare = short[order], count[order]
        v, w, doc, train, spans = unpack(t)
        contexts, of = np.unique(v, return_inverse=True)
        words, word = np.unique(w, return_inverse=True)
        pair = of.astype(_U) * _U(len(words)) + word.astype(_U)
        learned = train[doc]
        of = of.astype(np.int32)
        del v, w, word
        order = np.argsort(pair)
        first = np.flatnonzero(np.diff(pair[order], prepend=~pair[order][:1]))
        distinct = pair[order][first]
        group = np.empty(len(pair), np.int32)
        group[order] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(pair))))
        n = np.add.reduceat(learned[order].astype(np.int64), first)
        pv, pw = (distinct // _U(len(words))).astype(np.int64), (distinct % _U(len(words))).astype(np.int64)
        log_q = known.log_q(words, rare)
        total = np.bincount(of, weights=learned, minlength=len(contexts)).astype(np.int64)
        split = known.of_context(contexts)
        total = np.where(split >= 0, split, total)  # a split context's count is not the shard's own sum
        seen = np.flatnonzero(n > 0)
        with_any = np.unique(pv[seen])
        logp = np.log10((n[seen] + prior * 10.0 ** log_q[pw[seen]]) / (total[pv[seen]] + prior))
        trie = Trie.build(contexts[with_any], np.bincount(pv[seen], minlength=len(contexts))[with_any], words[pw[seen]], logp,
                          np.log10(prior / (total[with_any] + prior)))
        with tempfile.TemporaryDirectory() as folder:
            trie.save(path := os.path.join(folder, "trie"))
            value = Trie.open(path).score(contexts, pv, words, pw, log_q)
        # split contexts that this shard has no trained successor of still back off with their own weight
        missing = (split > 0) & ~np.isin(np.arange(len(contexts)), with_any)
        value += np.where(missing[pv], np.log10(prior / (total[pv] + prior)), 0.0)
        docs = len(train)
        score = np.bincount(doc, weights=value[group], minlength=docs)
        word_context = contexts != START
        base = np.bincount(doc, weights=np.where(word_context, np.log10(total + 0.1), 0.0)[of], minlength=docs)
        hits = np.bincount(doc, weights=(word_context & (total > 0))[of], minlength=docs).astype(np.uint32)
        any_ = np.bincount(doc, minlength=docs) > 0
        rows = []
        for (at, size), batch, tr, ids, tokens in zip(spans, *(t.column(c).to_pylist() for c in ("batch", "train", "ids", "tokens"))):
            own = np.flatnonzero(any_[at: at + size])
            rows.append((batch, tr if ids is not None else None, ids, tokens, own.astype(np.uint32).tobytes(), hits[at: at + size][own].tobytes(),
                         base[at: at + size][own].tobytes(), score[at: at + size][own].astype(np.float32).tobytes()))
        kinds = [pa.int64(), *[pa.binary()] * 7]
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                    names=["batch", "train", "ids", "tokens", "doc", "known", "base", "score"])
    def with_counts(t: pa.Table, other: pa.Table) -> pa.Table:
        return run(t, other)

    def alone(t: pa.Table) -> pa.Table:  # Spark tells the kinds of functions by their number of arguments
        return run(t, None)

    return with_counts if known.all_words else alone


def _finish(known: Counts):
    """The function over one batch's sums: rows per document."""
    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        meta = next(r for r in rows if r["ids"] is not None)
        train, tokens = np.frombuffer(meta["train"], bool), np.frombuffer(meta["tokens"], np.int64)
        n = len(train)
        ids, valid = np.frombuffer(meta["ids"][: 8 * n], np.int64), np.frombuffer(meta["ids"][8 * n:], bool)
        hits, base, score = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        for r in sorted(rows, key=lambda r: (r["doc"], r["score"])):
            at = np.frombuffer(r["doc"], np.uint32)
            hits[at] += np.frombuffer(r["known"], np.uint32)
            base[at] += np.frombuffer(r["base"], np.float64)
            score[at] += np.frombuffer(r["score"], np.float32)
        base += np.log10(known.documents + 0.1) - tokens * np.log10(known.tokens + 0.1 * (known.distinct + 1))
        return pa.Table.from_pydict({
            "doc_id": pa.array(ids, mask=~valid), "held_out": pa.array(~train), "n_tokens": pa.array(tokens),
            "n_known": pa.array(hits + (known.documents > 0)), "train_tokens": pa.array(np.full(n, known.tokens)),
            "base_score": pa.array(base), "score": pa.array(score)})
    return run


def score_documents(docs: DataFrame, mod: int = 10, all_words: bool = False) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    tmp = Scratch(docs.sparkSession, "ngram")
    marked = docs.select("doc_id", (id_bucket(F.col("doc_id"), mod) == 0).alias("held_out"), "text")
    known, rare = counts(marked.filter("not held_out"), tmp, all_words)
    packed = bigrams(marked, known).groupBy("shard")
    if all_words:
        rare = tmp.keep(rare_counts(marked, known, rare), "rare")
        sums = packed.cogroup(rare.groupBy("shard")).applyInArrow(score_shard(known), SUMS)
    else:
        sums = packed.applyInArrow(score_shard(known), SUMS)
    tmp.drop("words")
    return sums.groupBy("batch").applyInArrow(
        _finish(known), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
