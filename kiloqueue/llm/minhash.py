"""Near-duplicates by one-permutation hashing with optimal densification (operator 9).

One hash per shingle: the top bits choose the bin, the rest is the value, and a
bin keeps its least value.  An empty bin copies the bin that a fixed random walk
of bin numbers reaches first.  Bands of ``rows`` bins make bucket keys; in each
bucket every text is paired with one centre only (a star), and the centre is
drawn anew for each band, so a text meets several centres of its group.  Pairs
whose signatures agree in too few bins (``LIKELY``, over four standard
deviations below the threshold) go, the others are confirmed on the full shingle
sets.  That links most copies.  Buckets that still hold texts of different
components are joined to groups (texts that share buckets, directly or through
others), and in a group all texts of different components are compared on their
full sets, block against block: a task holds two blocks of ``BLOCK`` texts, and
gives out a forest over the components that it found to be one, not the pairs.
Blocks are in order of component, so blocks of one component don't meet.  Groups
of more than ``GROUP`` texts are compared bucket by bucket instead, which leaves
out pairs without a bucket.  So a link is missed only if its two texts share no
bucket (at the threshold 3 in a million), and no others connect them.

Equal sets collapse to one class before any bucket is formed, counts and minima
are aggregated before the shuffle, and components come from large-star /
small-star rounds on the confirmed links.  Each step is a written table.

Edge cases: null or empty text, or text of white space only, has an empty set
and is linked with nothing; a text shorter than a shingle is one shingle; ties
and repeated rows share the component of the smallest doc_id; a null doc_id has
the component of its class, null if no row of the class has an id; an empty
table gives an empty result.  Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiloqueue.functions import ranked
from kiloqueue.llm.common import Scratch, hash_words, mix64, text_blocks

BIN_BITS = 8
ROWS = 6
BANDS = (1 << BIN_BITS) // ROWS
#: percent of the union that the intersection must have
PERCENT = 80
#: texts of a block of a group
BLOCK = 512
#: texts of a group that are compared whatever buckets they share
GROUP = 1 << 14
#: shingles that are compared at a time
COLUMNS = 4096
#: percent of equal bins below which a pair with a centre is not confirmed on its sets
LIKELY = PERCENT - 12
_U = np.uint64


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    for lo, hi in text_blocks(texts):
        words, at = hash_words(texts[lo:hi])
        n = max(len(words) - width + 1, 0)
        rolled = np.zeros(n, _U)
        for k in range(width):
            rolled = mix64(rolled * _U(0x9E3779B97F4A7C15) + words[k: k + n])
        for a, b in zip(at[:-1], at[1:]):
            if b - a >= width:
                yield np.unique(rolled[a: b - width + 1])
            elif b > a:
                yield np.frombuffer(hashlib.blake2b(words[a:b].tobytes(), digest_size=8, salt=b"short").digest(), _U)
            else:
                yield np.zeros(0, _U)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Densified one-permutation signatures of non-empty sets, one row of bins each."""
    bins = 1 << BIN_BITS
    values, full = np.zeros((len(sets), bins), _U), np.zeros((len(sets), bins), bool)
    for i, s in enumerate(sets):
        at = (s >> _U(64 - BIN_BITS)).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))  # sorted, so a bin's first value is its least
        values[i, at[first]] = s[first]
        full[i, at[first]] = True
    row, empty = np.nonzero(~full)
    step = 0
    while len(row):
        step += 1
        to = (mix64(empty.astype(_U) * _U(1 << 20) + _U(step)) >> _U(64 - BIN_BITS)).astype(np.int64)
        hit = full[row, to]
        values[row[hit], empty[hit]] = values[row[hit], to[hit]]
        row, empty = row[~hit], empty[~hit]
    return values


def band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    bands = values.shape[1] // rows
    keys = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=_U)), (len(values), bands)).copy()
    for k in range(rows):
        keys = mix64(keys * _U(0x9E3779B97F4A7C15) + values[:, k: bands * rows: rows])
    return keys


def sketch(docs: DataFrame, width: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, class (128-bit digest of the set), bands (bucket keys), bins (a byte of each); the last three null for empty sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = list(shingle_sets(b.column(1).to_pylist(), width))
            some = [i for i, s in enumerate(sets) if len(s)]
            keys: list[np.ndarray | None] = [None] * len(sets)
            bins: list[bytes | None] = [None] * len(sets)
            for lo in range(0, len(some), 512):
                part = some[lo: lo + 512]
                values = signatures([sets[i] for i in part])
                for i, k, v in zip(part, band_keys(values, rows).view(np.int64), mix64(values).astype(np.uint8)):
                    keys[i], bins[i] = k, v.tobytes()
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())),
                 pa.array(bins, pa.binary())], ["doc_id", "n_shingles", "class", "bands", "bins"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, class binary, bands array<long>, bins binary")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """node, class, shingles of rows (node, class, text) whose text still has that class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = list(shingle_sets(b.column(2).to_pylist(), width))
            same = [i for i, (s, c) in enumerate(zip(sets, b.column(1).to_pylist())) if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == c]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(same, pa.int64())), pa.array([sets[i].tobytes() for i in same], pa.binary())], ["node", "shingles"])

    return docs.mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"])


def _test_pairs(pairs: DataFrame, values: DataFrame, column: str, passes) -> DataFrame:
    """The pairs (a, b) whose values pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = pa.array([i for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())) if passes(x, y)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])

    left = values.select(F.col("node").alias("a"), F.col(column).alias("x"))
    right = values.select(F.col("node").alias("b"), F.col(column).alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose signatures agree in at least ``percent`` of the bins."""
    need = percent << BIN_BITS
    return _test_pairs(pairs, classes, "bins", lambda x, y: 100 * int((np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)).sum()) >= need)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets."""
    def alike(x: bytes, y: bytes) -> bool:
        u, v = np.frombuffer(x, _U), np.frombuffer(y, _U)
        if 100 * min(len(u), len(v)) < percent * max(len(u), len(v)):
            return False
        union = len(np.union1d(u, v))
        return 100 * (len(u) + len(v) - union) >= percent * union

    return _test_pairs(pairs, sets, "shingles", alike)


def components(links: DataFrame, tmp: Scratch, name: str) -> DataFrame:
    """(node, component) of all nodes of the links (a, b): the least node reachable.

    Alternates large-star and small-star steps until they change nothing: then the edges are stars around the
    least nodes.  Whether they changed is seen while they are written, from their number and a checksum.
    """
    def star(edges: DataFrame, larger: bool) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not larger:
            both = both.filter("b < a")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        moved = both.join(least, "a")
        if larger:
            return moved.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = least.filter("a <> m").select("a", F.col("m").alias("b"))
        return moved.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own).distinct()

    edges, step, before = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), 0, None
    while True:
        edges, now = tmp.keep_counted(star(star(edges, True), False), f"{name}-{step}", F.bit_xor(F.xxhash64("a", "b")).alias("sum"))
        if step:
            tmp.drop(f"{name}-{step - 1}")
        if now == before or not now["n"]:
            break
        before, step = now, step + 1
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


def star_pairs(members: DataFrame) -> DataFrame:
    """(a, b): each node of a bucket with the centre of the bucket, the node least after a bit mask of the bucket."""
    mask = F.xxhash64("bucket")
    centres = (members.groupBy("bucket").agg(F.min(F.col("node").bitwiseXOR(mask)).alias("c"), F.min("node").alias("lo"), F.max("node").alias("hi"))
               .filter("lo < hi").select("bucket", F.col("c").bitwiseXOR(mask).alias("centre")))
    return (members.join(centres, "bucket").filter("node <> centre")
            .select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")))


def similar(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Whether 100 * intersection >= percent * union, for every set of ``left`` and of ``right``."""
    sizes = [np.array([len(x) for x in side], np.int64) for side in (left, right)]
    _, column, uses = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(left) + len(right)), np.concatenate(sizes))
    shared = uses[column] > 1
    row, column = row[shared], column[shared]
    order = np.argsort(column, kind="stable")
    row, column = row[order], np.cumsum(np.diff(column[order], prepend=column[order[:1]]) != 0)  # numbered without gaps
    both = np.zeros((len(left), len(right)), np.float32)  # exact below 2**24
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, (lo, lo + COLUMNS))
        dense = np.zeros((len(left) + len(right), COLUMNS), np.float32)
        dense[row[i:j], column[i:j] - lo] = 1
        both += dense[: len(left)] @ dense[len(left):].T
    union = sizes[0][:, None] + sizes[1][None, :] - both
    return 100 * both >= percent * union


def forest(links: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars over the components that ``links`` (rows of component a, columns of b) join to one."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = np.nonzero(links & (a[:, None] != b[None, :]))
    near = np.zeros((len(names), len(names)), bool)
    near[at[: len(a)][i], at[len(a):][j]] = True
    near |= near.T
    label = np.arange(len(names))
    while True:
        least = np.minimum(label, np.where(near, label[None, :], len(names)).min(1, initial=len(names)))
        least = least[least]
        if (least == label).all():
            break
        label = least
    moved = np.flatnonzero(label != np.arange(len(names)))
    return names[moved], names[label[moved]]


def group_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): components that links between the members (node, component, key) of a key join to one.

    Every two blocks of a key that hold more than one component make a group of rows, so no task holds a large
    key, and all pairs across components are compared on their full sets (node, shingles)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def linked(t: pa.Table) -> pa.RecordBatch:
            component, block, i, j = (t.column(c).to_numpy() for c in ("component", "block", "i", "j"))
            found = [np.frombuffer(x, _U) for x in t.column("shingles").to_pylist()]
            left, right = np.flatnonzero(block == i[0]), np.flatnonzero(block == j[0])
            ok = similar([found[k] for k in left], [found[k] for k in right], percent)
            a, b = forest(ok, component[left], component[right])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            t = pa.Table.from_batches(held)
            same = np.ones(t.num_rows - 1, bool)
            for c in ("key", "i", "j"):
                x = t.column(c).to_numpy()
                same &= x[1:] == x[:-1]
            cuts = [0, *(np.flatnonzero(~same) + 1).tolist()]
            for lo, hi in zip(cuts[:-1], cuts[1:]):  # all but the last group are whole
                yield linked(t.slice(lo, hi - lo))
            held = t.slice(cuts[-1]).combine_chunks().to_batches()
        if held:
            yield linked(pa.Table.from_batches(held))

    placed = ranked.row_positions(members, "key", ["component", "node"]).select(
        "node", "component", "key", F.floor((F.col("row_pos") - 1) / BLOCK).cast("int").alias("block"))
    ends = placed.groupBy("key", "block").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    one = ends.select("key", F.col("block").alias("i"), F.col("lo").alias("lo_i"), F.col("hi").alias("hi_i"))
    two = ends.select("key", F.col("block").alias("j"), F.col("lo").alias("lo_j"), F.col("hi").alias("hi_j"))
    met = one.join(two, "key").filter((F.col("i") <= F.col("j")) & (F.least("lo_i", "lo_j") < F.greatest("hi_i", "hi_j"))).select("key", "i", "j")
    both = F.explode(F.array_distinct(F.array("i", "j"))).alias("block")
    rows = placed.join(met.select("key", "i", "j", both), ["key", "block"]).join(sets, "node")
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long").distinct()


def open_groups(members: DataFrame, tmp: Scratch) -> DataFrame:
    """(node, component, key) of the members (node, bucket, component) of buckets of several components: what has to be compared with what."""
    held = members.select("component", "bucket").distinct()
    least = held.groupBy("bucket").agg(F.min("component").alias("b"))
    group = components(held.join(least, "bucket").select(F.col("component").alias("a"), "b").distinct(), tmp, "group")
    group = tmp.keep(group.select(F.col("node").alias("component"), F.col("component").alias("group")), "groups")
    grouped = members.join(group, "component")
    once = tmp.keep(grouped.select("node", "component", "group").distinct(), "grouped")
    large = once.groupBy("group").agg(F.count("*").alias("n")).filter(F.col("n") > GROUP).select("group")
    return (once.join(large, "group", "left_anti").select("node", "component", F.xxhash64(F.lit(0), "group").alias("key"))
            .unionByName(grouped.join(large, "group", "left_semi").select("node", "component", F.xxhash64(F.lit(1), "bucket").alias("key"))))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT, rows: int = ROWS) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept."""
    tmp = Scratch(docs.sparkSession, "minhash")
    sketches = tmp.keep(sketch(docs, width, rows), "sketches")
    classes = tmp.keep(sketches.filter("n_shingles > 0").groupBy("class").agg(
        F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("bins").alias("bins")), "classes")
    named = classes.filter("node is not null")
    buckets = named.select("node", F.explode("bands").alias("bucket"))
    pairs = tmp.keep(star_pairs(buckets).groupBy("a", "b").agg(F.count("*").alias("shared")), "pairs")
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = tmp.keep(asked.join(named.select("node", "class", "bins"), "node"), "wanted")
    texts = wanted.join(docs.select(F.col("doc_id").alias("node"), "text"), "node")
    sets = tmp.keep(full_sets(texts.select("node", "class", "text"), width), "sets")

    # first each node's most promising pair, then those whose ends have not found the same centre
    best = pairs.groupBy(F.col("b").alias("n")).agg(F.max_by("a", "shared").alias("a")).select("a", F.col("n").alias("b"))
    first = tmp.keep(confirm(likely(best, wanted, LIKELY), sets, percent), "links0")
    centre = first.select(F.col("b").alias("node"), F.col("a").alias("component"))
    tried = tmp.keep(likely(_across(pairs, centre), wanted, LIKELY), "likely1")
    links = first.unionByName(tmp.keep(confirm(tried, sets, percent), "links1"))
    found = tmp.keep(components(links, tmp, "star1"), "found1")

    # then all pairs across components of the buckets that are still open
    members, seen = tmp.keep_counted(_mixed(buckets.join(wanted.select("node"), "node", "left_semi"), found), "mixed")
    if seen["n"]:
        links, seen = tmp.keep_counted(group_links(tmp.keep(open_groups(members, tmp), "open"), sets, percent), "links2")
        if seen["n"]:
            found = tmp.keep(_merged(found, links, tmp, "star2"), "found2")

    label = classes.select("class", "node").join(found, "node", "left").select("class", F.coalesce("component", "node").alias("component"))
    out = sketches.select("doc_id", "n_shingles", "class").join(label, "class", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _labels(found: DataFrame, node: str) -> DataFrame:
    return found.select(F.col("node").alias(node), F.col("component").alias(f"c{node}"))


def _across(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs whose ends don't have one label (node, component) yet."""
    joined = pairs.join(_labels(found, "a"), "a", "left").join(_labels(found, "b"), "b", "left")
    return joined.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _merged(found: DataFrame, links: DataFrame, tmp: Scratch, name: str) -> DataFrame:
    """The components after more links: components of the old ones' representatives, carried over to the nodes."""
    ends = links.join(_labels(found, "a"), "a", "left").join(_labels(found, "b"), "b", "left")
    moved = components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), tmp, name)
    moved = tmp.keep(moved.select(F.col("node").alias("component"), F.col("component").alias("to")), f"{name}-moved")
    old = found.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    new = moved.join(found.select(F.col("node").alias("component")), "component", "left_anti")
    return old.unionByName(new.select(F.col("component").alias("node"), F.col("to").alias("component")))


def _mixed(members: DataFrame, found: DataFrame) -> DataFrame:
    """The members (node, bucket, component) of buckets that hold more than one component."""
    labelled = members.join(found, "node", "left").select("node", "bucket", F.coalesce("component", "node").alias("component"))
    several = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    return labelled.join(several.select("bucket"), "bucket")


def keep_first(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """The documents without later near-copies: of each component the row of the smallest doc_id.

    Of equal rows one stays; a null doc_id stays.
    """
    found = near_duplicates(docs, width, percent).filter("not kept and doc_id is not null").select("doc_id").distinct()
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 and doc_id is not null").select("doc_id")
    if not repeated.isEmpty():
        once = docs.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        docs = docs.join(repeated, "doc_id", "left_anti").unionByName(once.select(*docs.columns))
    return docs.join(found, "doc_id", "left_anti")
