"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches (operator 13).

A rank file (base64 token, rank) becomes a model of the tokenizers library:
each byte is written as one printable character, and a token's merge is the
last one that its own bytes go through under the lower ranks.  Text is split by
the pattern, each match is merged on its own and no special token is known, so
their strings are ordinary text.  As matches repeat, a task encodes each of them
once and holds its ids for later (``HELD`` characters of matches, then it
forgets them all); the ids of a text are gathered from its matches.

Offsets count code points of the text.  A token may hold a part of a character
only; it then has the offsets of that whole character.  Decoding goes back from
printable characters to bytes, joins the bytes of all ids and only then reads
UTF-8, so characters split over tokens come back whole; a character that the
ids hold in part only (a cut list of ids) becomes U+FFFD in ``decoded_text``
and stays as it is in ``decoded``.

The driver reads the rank file and sends the model to the tasks: its size is
that of the vocabulary (``MAX_MODEL_BYTES`` at most, otherwise an error), not
of the data.  Each task handles ``BLOCK`` characters at a time.

Edge cases: null or empty text has no ids; a null list of ids, or one with an id
that the vocabulary lacks, decodes to null; repeated rows stay; an empty table
gives an empty result.  Only the named columns are read, so others can't clash.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from kiloqueue.llm.common import text_blocks

#: characters of text that a task handles at a time
BLOCK = 1 << 18
#: characters of distinct matches that a task holds
HELD = 1 << 21
MAX_MODEL_BYTES = 1 << 26


@lru_cache(1)
def byte_chars() -> list[str]:
    """The printable character of each byte: itself if Latin-1 prints it, otherwise the next one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


def _last_merge(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The two parts that the merges of lower rank leave of ``token``."""
    parts = [token[i: i + 1] for i in range(len(token))]
    while len(parts) > 2:
        i = min(range(len(parts) - 1), key=lambda k: (ranks.get(parts[k] + parts[k + 1], len(ranks)), k))
        parts[i: i + 2] = [parts[i] + parts[i + 1]]
    return parts


def read_ranks(rank_file: str) -> dict[bytes, int]:
    if os.path.getsize(rank_file) > MAX_MODEL_BYTES:
        raise ValueError(f"{rank_file} is larger than {MAX_MODEL_BYTES} bytes")
    with open(rank_file, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(4)
def model_json(rank_file: str) -> str:
    """The library's model of a rank file, as its JSON text."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    ranks, chars = read_ranks(rank_file), byte_chars()

    def shown(token: bytes) -> str:
        return "".join([chars[b] for b in token])

    merges = [tuple(map(shown, _last_merge(t, ranks))) for t, _ in sorted(ranks.items(), key=lambda x: x[1]) if len(t) > 1]
    tok = Tokenizer(models.BPE({shown(t): r for t, r in ranks.items()}, merges, cache_capacity=0))
    tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return tok.to_str()


def token_bytes(model: str) -> list[bytes]:
    """The bytes of each id of a model: its printable characters taken back by the byte table; b"" for free ids."""
    value = {c: b for b, c in enumerate(byte_chars())}
    vocabulary = json.loads(model)["model"]["vocab"]
    out = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes([value[c] for c in token])
    return out


@dataclass(frozen=True)
class Vocabulary:
    """A rank file and the pattern that splits text before the merges."""

    rank_file: str
    pattern: str

    @staticmethod
    def public() -> Vocabulary:
        import public_tokenizers

        return Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def _gather(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of the runs that begin at ``start``, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class Matches:
    """The ids of matches, and with ``offsets`` the characters that each id covers, in arrays that grow."""

    def __init__(self, model: str, pattern: str, offsets: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task's work stays in its thread
        from tokenizers import Tokenizer

        self.tok, self.pattern, self.offsets = Tokenizer.from_str(model), regex.compile(pattern), offsets
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.held, self.size = 0, np.zeros(0, np.int64)
        self.columns = [np.zeros(0, np.int32) for _ in range(3 if self.offsets else 1)]  # ids, first and last character

    def learn(self, matches: set[str]) -> None:
        new = [m for m in matches if m not in self.known]
        if self.held and self.held + sum(map(len, new)) > HELD:
            self.forget()
            new = list(matches)
        for lo, hi in text_blocks(new, BLOCK):
            found = (self.tok.encode_batch if self.offsets else self.tok.encode_batch_fast)(new[lo:hi], add_special_tokens=False)
            ids = [e.ids for e in found]
            own = [np.fromiter(chain.from_iterable(ids), np.int32)]
            if self.offsets:
                own += list(np.array([s for e in found for s in e.offsets], np.int32).reshape(-1, 2).T)
            self.columns = [np.concatenate(c) for c in zip(self.columns, own)]
            self.size = np.concatenate([self.size, np.fromiter(map(len, ids), np.int64, len(ids))])
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.held += sum(map(len, new))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """The number of ids of each text, and the columns of all of them."""
        if self.offsets:
            places = [[(m[0], m.start()) for m in self.pattern.finditer(t)] for t in texts]
            found, start = ([[p[k] for p in row] for row in places] for k in (0, 1))
        else:
            found, start = [self.pattern.findall(t) for t in texts], []
        matches = list(chain.from_iterable(found))
        self.learn(set(matches))
        at = np.fromiter(map(self.known.__getitem__, matches), np.int64, len(matches))
        size = self.size[at]
        columns = [c[_gather((np.cumsum(self.size) - self.size)[at], size)] for c in self.columns]
        if self.offsets:
            moved = np.repeat(np.fromiter(chain.from_iterable(start), np.int32, len(matches)), size)
            columns[1:] = [c + moved for c in columns[1:]]
        upto = np.concatenate([[0], np.cumsum(size)])[np.cumsum([0, *map(len, found)])]
        return np.diff(upto), columns


@lru_cache(1)
def _matches(model: str, pattern: str, offsets: bool) -> Matches:
    return Matches(model, pattern, offsets)


def _lists(sizes: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, pa.int32()))


Batches = Iterator[pa.RecordBatch]


def _encoder(spark: SparkSession, vocabulary: Vocabulary, key: str, offsets: bool) -> Callable[[Batches], Batches]:
    """What turns batches of (key, text) into batches of (key, ids[, starts, ends])."""
    model, pattern = spark.sparkContext.broadcast(model_json(vocabulary.rank_file)), vocabulary.pattern
    names = ["ids", "starts", "ends"] if offsets else ["ids"]

    def run(batches: Batches) -> Batches:
        matches = _matches(model.value, pattern, offsets)
        for b in batches:
            for lo, hi in _blocks(b.column(1)):
                sizes, columns = matches.encode([t or "" for t in b.column(1).slice(lo, hi - lo).to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *(_lists(sizes, c) for c in columns)], [key, *names])

    return run


def _blocks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Slices of about ``BLOCK`` bytes (one longer text makes a slice of its own)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BLOCK, side="right")))
        yield lo, hi
        lo = hi


def _decoder(spark: SparkSession, vocabulary: Vocabulary, key: str) -> Callable[[Batches], Batches]:
    """What turns batches of (key, ids) into batches of (key, ids, decoded)."""
    tokens = token_bytes(model_json(vocabulary.rank_file))
    table = spark.sparkContext.broadcast((np.frombuffer(b"".join(tokens), np.uint8), np.array([len(t) for t in tokens], np.int64)))

    def run(batches: Batches) -> Batches:
        raw, size = table.value
        first = np.cumsum(size) - size
        for b in batches:
            lists = b.column(1)
            null = lists.is_null().to_numpy(zero_copy_only=False)
            per_row = np.where(null, 0, pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            at = pc.fill_null(lists.flatten(), -1).to_numpy().astype(np.int64)
            wrong = (at < 0) | (at >= len(size))
            wrong[~wrong] = size[at[~wrong]] == 0
            at[wrong] = 0
            ends = np.concatenate([[0], np.cumsum(per_row)])
            bad = np.diff(np.concatenate([[0], np.cumsum(wrong)])[ends]) > 0
            length = np.where(wrong, 0, size[at])
            joined = raw[_gather(first[at], length)].tobytes()
            cuts = np.concatenate([[0], np.cumsum(length)])[ends]
            out = [None if skip else joined[lo:hi] for skip, lo, hi in zip(null | bad, cuts[:-1].tolist(), cuts[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(out, pa.binary())], [key, "ids", "decoded"])

    return run


def _schema(df: DataFrame, key: str, lists: list[str], *more: StructField) -> StructType:
    return StructType([StructField(key, df.schema[key].dataType), *(StructField(n, ArrayType(IntegerType())) for n in lists), *more])


_DECODED = StructField("decoded", BinaryType())


def encode(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text", offsets: bool = False) -> DataFrame:
    """Per row: ``key``, ids; with ``offsets`` also starts and ends, the code points of the text that each id covers."""
    run = _encoder(docs.sparkSession, vocabulary, key, offsets)
    return docs.select(key, text).mapInArrow(run, _schema(docs, key, ["ids", "starts", "ends"] if offsets else ["ids"]))


def decode(encoded: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per row: ``key``, ids, decoded (the bytes of the ids, joined)."""
    return encoded.select(key, ids).mapInArrow(_decoder(encoded.sparkSession, vocabulary, key), _schema(encoded, key, ["ids"], _DECODED))


def encode_and_decode(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``decode`` of ``encode``, both in one task's process: key, ids, decoded."""
    there, back = _encoder(docs.sparkSession, vocabulary, key, False), _decoder(docs.sparkSession, vocabulary, key)
    return docs.select(key, text).mapInArrow(lambda batches: back(there(batches)), _schema(docs, key, ["ids"], _DECODED))


def decoded_text(decoded: DataFrame) -> DataFrame:
    """``decoded`` with ``decoded_text``: UTF-8 read over all the bytes, U+FFFD for what is no whole character."""
    @F.pandas_udf("string")
    def read(raw: pd.Series) -> pd.Series:
        return raw.map(lambda r: None if r is None else bytes(r).decode("utf-8", "replace"))

    return decoded.withColumn("decoded_text", read("decoded"))


def round_trip(docs: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by a space), decoded_sha256 (of the decoded bytes)."""
    vocabulary = vocabulary or Vocabulary.public()
    return encode_and_decode(docs, vocabulary).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
