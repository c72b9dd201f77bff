"""Helpers shared by the corpus operators: reading, shared scratch folders, hashing of words."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from kiloqueue.session import ensure_checkpoint_dir

#: a word: a maximal run without ASCII white space
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


class Scratch:
    """A fresh folder for intermediate tables below ``spark.checkpoint.dir``.

    ``keep`` writes a table and reads it again, which cuts the lineage: a lost
    executor costs a re-read, not a recomputation.  ``drop`` deletes tables
    that no returned plan needs any more.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("errorifexists").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_counted(self, df: DataFrame, name: str, *more: Column) -> tuple[DataFrame, dict]:
        """``keep``, with ``n``, the number of rows, and other aggregates of them, taken while they are written."""
        seen = Observation()
        kept = self.keep(df.observe(seen, F.count(F.lit(1)).alias("n"), *more), name)
        return kept, seen.get

    def drop(self, *names: str) -> None:
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if the table has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where lambdas use it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def id_bucket(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id is in bucket 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % F.lit(mod)


# ---------------------------------------------------------------- word hashes

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_P = 0xD6E8FEB86659FD93 | 1
_P_INV = pow(_P, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {"p": np.ones(1, _U), "q": np.ones(1, _U)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables["p"]) < n:
        size = 1 << (n - 1).bit_length()
        for key, base in (("p", _P), ("q", _P_INV)):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _tables[key] = np.cumprod(steps, dtype=_U)
    return _tables["p"], _tables["q"]


def lower_words(text: str | None) -> list[bytes]:
    """The words of a text with A-Z lower-cased (other letters stay)."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def hash_words(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of ``texts`` in order, and the offsets of each text in them.

    Polynomial over random byte values modulo 2**64, from prefix sums, so that
    no word costs a Python step; equal words have equal hashes in any text.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64) if raw else np.zeros(0, np.int64)
    data = b"\n".join(raw) + b"\n" if raw else b""
    buf = np.frombuffer(data.lower() if lower else data, np.uint8)
    space = (buf == 32) | ((buf >= 9) & (buf <= 13))
    edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    p, q = _powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, _U)
    np.cumsum(_BYTE[buf] * p[: len(buf)], out=total[1:])
    hashes = mix64((total[last] - total[first]) * q[first])
    offsets = np.concatenate([[0], np.searchsorted(first, ends)]).astype(np.int64)
    return hashes, offsets


def text_blocks(texts: list[str | None], limit: int = 1 << 20):
    """Slices of ``texts`` of about ``limit`` characters (one longer text makes a slice of its own)."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > limit:
            yield start, i
            start, size = i, 0
        size += len(t or "") + 1
    if start < len(texts):
        yield start, len(texts)
