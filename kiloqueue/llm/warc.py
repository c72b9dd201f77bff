r"""WARC archives with a two-level capture index (operator 7).

``write_archives`` turns pages into WARC/1.1 records, one gzip member each, and
stores every archive as rows (archive, offset, length, member) of a Parquet
table; members in offset order are the bytes of a ``.warc.gz`` file, and a
range read is a filter on (archive, offset).  Records whose payload equals that
of a record with a smaller page_id are revisits.

``build_index`` parses the archives, sorts one line per record by its
reversed-host URL key into ranges, and packs each range into compressed blocks
of ``BLOCK_LINES`` lines with a sparse directory of first keys.  ``look_up``
sends each wanted key to its range (the ranges' first keys are as few as the
range partitions), binary-searches the directory, opens the blocks that can hold
the key, and binary-searches the lines.

Edge cases: null html is an empty payload; a null url has the key ``-``; a null
page_id is never smaller than another id; repeated rows give one record each,
responses all of them; an empty table gives empty results.  Extra columns are
ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiloqueue.llm.common import Scratch

BLOCK_LINES = 512
MIN_REVISIT_BYTES = 0
#: pages carry no capture time
CAPTURED = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "archive string, offset long, length long, member binary"


def url_key(url: str | None) -> str:
    """Reversed host, path and query, without scheme, www, default port and fragment."""
    if not url:
        return "-"
    try:
        u = urlsplit(url.strip())
        host, port = (u.hostname or "").lower(), u.port
    except ValueError:
        return re.sub(r"\s", "", url.lower()) or "-"
    host = re.sub(r"^www\d*\.", "", host)
    at = "" if port in (None, 80, 443) else f":{port}"
    key = f"{','.join(reversed(host.split('.')))}{at}){u.path or '/'}" + (f"?{u.query}" if u.query else "")
    return re.sub(r"\s", lambda m: quote(m[0]), key)


def sha1_base32(hexed: str) -> str:
    return base64.b32encode(bytes.fromhex(hexed)).decode()


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None) -> bytes:
    """One record: a response, or a revisit if ``refers_to`` is given."""
    uri = lambda u: quote(u, safe="%:/?#[]@!$&'()*+,;=~")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
            f"WARC-Date: {CAPTURED}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response"]
    if url is not None:
        head.append(f"WARC-Target-URI: {uri(url)}")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        if refers_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {uri(refers_url)}")
    body = http + (payload if refers_to is None else b"")
    return "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """The header fields (lower-case names) and the payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    body = rest[: int(fields["content-length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


def page_of(urn: str | None) -> int | None:
    digits = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(digits[1]) if digits else None


def write_archives(pages: DataFrame, tmp: Scratch, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """One WARC record per page, stored as rows of RECORDS; one archive per task."""
    payload = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")) \
        .withColumn("sha1", F.sha1("payload"))
    slim = tmp.keep(payload.select("page_id", "url", "sha1", F.octet_length("payload").alias("n")), "digests")
    first = slim.filter(F.col("n") >= min_bytes).groupBy("sha1").agg(
        F.min("page_id").alias("first"), F.min_by("url", "page_id").alias("first_url"), F.count("*").alias("copies")).filter("copies > 1")
    revisits = tmp.keep(slim.join(first, "sha1").filter(~F.col("page_id").eqNullSafe(F.col("first")))
                        .select(F.col("page_id").alias("p"), F.col("sha1").alias("s"), "first", "first_url").distinct(), "revisits")
    joined = payload.join(revisits, payload["page_id"].eqNullSafe(revisits["p"]) & (payload["sha1"] == revisits["s"]), "left") \
        .select("page_id", "url", "payload", "sha1", "first", "first_url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, at = f"pages-{TaskContext.get().partitionId():06d}.warc.gz", 0
        for b in batches:
            members = [gzip_member(record(i, u, p, sha1_base32(s), f, fu)) for i, u, p, s, f, fu in zip(*(c.to_pylist() for c in b.columns))]
            sizes = [len(m) for m in members]
            offsets = [at + sum_before for sum_before in _before(sizes)]
            at += sum(sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(members), pa.string()), pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64()), pa.array(members, pa.binary())],
                ["archive", "offset", "length", "member"])

    return tmp.keep(joined.mapInArrow(run, RECORDS), "archives")


def _before(sizes: list[int]) -> Iterator[int]:
    total = 0
    for s in sizes:
        yield total
        total += s


def build_index(archives: DataFrame, tmp: Scratch) -> tuple[DataFrame, list[list]]:
    """Blocks (part, block, first_key, lines, data), and the first key and number of each range."""
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for a, o, n, m in zip(*(c.to_pylist() for c in b.columns)):
                f, _ = parse(zlib.decompress(m, 31))
                page = page_of(f["warc-record-id"])
                out.append((f"{url_key(f.get('warc-target-uri'))} {_id_key(page)}", f"{a} {o} {n}"))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], ["key", "place"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, held = TaskContext.get().partitionId(), 0, []

        def emit(rows: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()), "first_key": pa.array([" ".join(rows[0].split(" ")[:2])]),
                "lines": pa.array([len(rows)], pa.int32()), "data": pa.array([zlib.compress("\n".join(rows).encode(), 6)], pa.binary())})
        for b in batches:
            held += [f"{k} {p}" for k, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            while len(held) >= BLOCK_LINES:
                yield emit(held[:BLOCK_LINES])
                held, block = held[BLOCK_LINES:], block + 1
        if held:
            yield emit(held)

    parts = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = archives.mapInArrow(lines, "key string, place string").repartitionByRange(parts, "key").sortWithinPartitions("key")
    blocks = tmp.keep(ordered.mapInArrow(pack, "part int, block int, first_key string, lines int, data binary"), "index")
    tops = blocks.groupBy("part").agg(F.min("first_key").alias("k")).orderBy("k").collect()  # as many as range partitions
    return blocks, [[r["k"] for r in tops], [r["part"] for r in tops]]


def _id_key(page: int | None) -> str:
    return "" if page is None else f"{page + (1 << 63):020d}"


def look_up(wanted: DataFrame, blocks: DataFrame, tops: list[list]) -> DataFrame:
    """The places (archive, offset, length) of the wanted (page_id, url) captures, each key once."""
    firsts, numbers = tops

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [f"{url_key(quote(u, safe=SAFE) if u is not None else None)} {_id_key(p)}" for p, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            at = [numbers[max(0, bisect.bisect_right(firsts, k) - 1)] if firsts else 0 for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(keys, pa.string())], ["part", "key"])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[str, int, int]] = []
        rows = sorted(zip(right.column("first_key").to_pylist(), right.column("data").to_pylist()), key=lambda r: r[0])
        directory, opened, open_at = [r[0] for r in rows], [], -1
        for key in sorted(set(left.column("key").to_pylist())):  # in order, so that one open block is enough
            at = max(0, bisect.bisect_left(directory, key) - 1)
            while at < len(rows) and directory[at] <= key:
                if at != open_at:
                    opened, open_at = zlib.decompress(rows[at][1]).decode().split("\n"), at
                k = bisect.bisect_left(opened, key + " ")
                while k < len(opened) and opened[k].startswith(key + " "):
                    archive, offset, length = opened[k].rsplit(" ", 3)[1:]
                    found.append((archive, int(offset), int(length)))
                    k += 1
                at += 1
        return pa.Table.from_pydict({"archive": pa.array([f[0] for f in found], pa.string()), "offset": pa.array([f[1] for f in found], pa.int64()),
                                     "length": pa.array([f[2] for f in found], pa.int64())})

    routed = wanted.select("page_id", "url").mapInArrow(route, "part int, key string")
    return routed.groupBy("part").cogroup(blocks.select("part", "first_key", "data").groupBy("part")).applyInArrow(
        search, "archive string, offset long, length long")


SAFE = "%:/?#[]@!$&'()*+,;=~"


def read_records(places: DataFrame, archives: DataFrame) -> DataFrame:
    """The records at the given places, parsed: page_id, record_type, refers_to, header digest, payload size and digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for m in b.column(0).to_pylist():
                f, payload = parse(zlib.decompress(m, 31))
                real = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                rows.append((page_of(f["warc-record-id"]), f["warc-type"], page_of(f.get("warc-refers-to")),
                             f["warc-payload-digest"].removeprefix("sha1:"), len(payload), real))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)],
                                             ["page_id", "record_type", "refers_to", "digest", "n", "real"])

    members = archives.join(places.select("archive", "offset"), ["archive", "offset"]).select("member")
    return members.mapInArrow(run, "page_id long, record_type string, refers_to long, digest string, n long, real string")


def round_trip(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write pages as archives, index them, look every page up, read it back.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to;
    a revisit's payload is that of the response it refers to.
    """
    tmp = Scratch(pages.sparkSession, "warc")
    archives = write_archives(pages, tmp, min_bytes)
    blocks, tops = build_index(archives, tmp)
    places = look_up(pages.select("page_id", "url"), blocks, tops)
    rows = tmp.keep(read_records(places, archives), "records")
    own = rows.filter("record_type = 'response'").select(
        "page_id", F.col("n").alias("payload_bytes"), F.col("real").alias("payload_digest"), "record_type", "refers_to")
    full = own.select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("digest"), "payload_bytes").distinct()
    again = rows.filter("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "digest") \
        .join(full, ["refers_to", "digest"], "left")
    return own.unionByName(again.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to"))
