"""Deterministic sharded WARC writer and its reader (operator 2).

Records are sorted by page id across shards, whose bounds come from exact sums of bytes; each shard is written by one task as gzip
members, one per record, and rolls to the next file when the compressed size is reached. Headers, ids
and digests are made anew from the payload, with a fixed date, so the same rows give the same bytes.
Files are written under temporary names; when a shard is complete they get their names, and last its
manifest, which lists files, sizes and digests. Readers only see what a manifest lists. A second try
of a task writes the same names with the same content, hence a lost executor does no harm.

Of records with equal payloads of at least ``min_bytes`` bytes the one with the largest page id is a
``response``; the others are ``revisit`` records without payload that name it. Who revisits whom is
found from digests alone: the pages travel once, to be sorted.

Defined cases: a NULL html is an empty payload, a NULL url an empty one. NULL page ids sort first,
are smallest, and are read back as NULL; in a group of only NULL ids the first row is the response.
Of rows that repeat page id and payload one is written as the response (if the id is the largest), the
others revisit it. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import os
import zlib
from bisect import bisect_right
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tracemill.llm.common import open_folder, shared_path
from tracemill.operators.joins import join_spread
from tracemill.session import durable

ROLL_BYTES = 64 << 20
# Payload bytes of a shard, which one task writes, and cells into which a span of ids is cut at a time.
SHARD_BYTES = 32 << 20
CELLS = 1024
LEVEL = 1
DATE = "2000-01-01T00:00:00Z"
CRLF = b"\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str, n: int) -> str:
    """Id of the ``n``-th record of a page with this payload."""
    return f"<urn:page:{'none' if page_id is None else page_id}:{digest}:{n}>"


def page_of(identifier: str) -> int | None:
    name = identifier.strip("<>").split(":")[2]
    return None if name == "none" else int(name)


def make_record(page_id: int | None, n: int, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP header, whose length is the full payload's."""
    digest = payload_digest(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest, n)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~-._')}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Block-Digest: sha1:{payload_digest(block)}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest, 0)}"]
    head += [f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + CRLF + CRLF + block + CRLF + CRLF


def gzip_member(data: bytes, level: int = LEVEL) -> bytes:
    """A gzip member with no time in its header."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class ShardWriter:
    """Rolling files of one shard, under temporary names until ``commit``."""

    def __init__(self, folder: str, shard: int, roll: int) -> None:
        self.fs, self.path = open_folder(folder)
        self.shard, self.roll, self.files, self.out = shard, roll, [], None
        self.token = os.urandom(6).hex()
        self.fs.create_dir(self.path, recursive=True)

    def _name(self, i: int) -> str:
        return f"part-{self.shard:05d}-{i:05d}.warc.gz"

    def _temporary(self, name: str) -> str:
        return f"{self.path}/.{name}.{self.token}.tmp"

    def write(self, data: bytes) -> None:
        if self.out is not None and self.files[-1]["bytes"] + len(data) > self.roll:
            self.close()
        if self.out is None:
            name = self._name(len(self.files))
            self.files.append({"name": name, "bytes": 0, "records": 0, "sha1": hashlib.sha1()})
            self.out = self.fs.open_output_stream(self._temporary(name), compression=None)
        self.out.write(data)
        now = self.files[-1]
        now["bytes"] += len(data)
        now["records"] += 1
        now["sha1"].update(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None

    def commit(self) -> list[dict]:
        self.close()
        for f in self.files:
            self.fs.move(self._temporary(f["name"]), f"{self.path}/{f['name']}")
            f["sha1"] = f["sha1"].hexdigest()
        name = f"manifest-{self.shard:05d}.json"
        with self.fs.open_output_stream(self._temporary(name)) as out:
            out.write(json.dumps({"shard": self.shard, "files": self.files}).encode())
        self.fs.move(self._temporary(name), f"{self.path}/{name}")
        return self.files


def roles(pages: DataFrame, min_bytes: int) -> DataFrame:
    """``id, digest, response_id`` of the pages that revisit another one; one row for each id and digest."""
    keyed = durable(pages.where(F.octet_length("payload") >= min_bytes).select("id", F.sha1("payload").alias("digest")))
    groups = keyed.groupBy("digest").agg(F.max("id").alias("response_id"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    n = keyed.count()
    pairs = join_spread(keyed, durable(groups), ["digest"], "__n", ["id"], heavy_rows=max(1000, n // 10_000))
    return pairs.select("id", "digest", "response_id").distinct()


_TOP = np.uint64(1 << 63)


def _ordered(ids: pa.Array) -> np.ndarray:
    """Longs as unsigned numbers in the same order, from 0; NULL as 0."""
    return pa.compute.fill_null(ids, -(2**63)).to_numpy(zero_copy_only=False).view(np.uint64) ^ _TOP


def shard_bounds(pages: DataFrame, shard_bytes: int) -> list[int]:
    """Ids, as unsigned numbers in their order, at which a new shard begins: from exact sums of payload bytes,
    and so the same for the same rows.

    The span of all ids is cut into equal cells; a cell with more than a shard's bytes is cut again, until
    it holds a single id. What comes to the driver is a number of cells that the shards bound.
    """
    sc = pages.sparkSession.sparkContext
    ids = pages.where(F.col("id").isNotNull()).select("id", (F.octet_length("payload") + 512).alias("size"))
    spans, cells = [(0, 2**64 - 1)], {}
    while spans:
        # First and last number of the open spans, and the width of their cells; all are cut in one pass.
        widths = [max(1, -(-(b - a + 1) // CELLS)) for a, b in spans]
        shared = sc.broadcast(tuple(np.array(c, np.uint64) for c in ([a for a, _ in spans], [b for _, b in spans], widths)))

        def cell(column: pa.Array) -> pa.Array:
            first, last, width = shared.value
            u = _ordered(column)
            k = np.maximum(np.searchsorted(first, u, side="right") - 1, 0)
            found = first[k] + (u - first[k]) // width[k] * width[k]
            return pa.array((found ^ _TOP).view(np.int64), mask=(u < first[k]) | (u > last[k]))

        cell.__annotations__ = {"column": pa.Array, "return": pa.Array}
        sums = ids.select(arrow_udf("long")(cell)("id").alias("cell"), "size").where("cell IS NOT NULL").groupBy("cell").agg(F.sum("size").alias("size")).collect()
        of_start = {a: (b, w) for (a, b), w in zip(spans, widths)}
        starts = sorted(of_start)
        open_ = []
        for r in sums:
            at = r["cell"] + 2**63
            last, width = of_start[starts[bisect_right(starts, at) - 1]]
            if r["size"] > shard_bytes and width > 1:
                open_.append((at, min(last, at + width - 1)))
            else:
                cells[at] = r["size"]
        spans = sorted(open_)
    bounds, held = [], 0
    for first in sorted(cells):
        if held and held + cells[first] > shard_bytes:
            bounds.append(first)
            held = 0
        held += cells[first]
    return bounds


def _write_shard(folder: str, roll: int):
    def run(batches):
        writer, files = None, []
        page, revisits, written = object(), {}, {}
        for b in batches:
            for row_shard, row_id, kind, digest, response, url, payload in zip(*[b.column(c) for c in ("shard", "id", "kind", "digest", "response_id", "url", "payload")]):
                shard = row_shard.as_py()
                if writer is not None and writer.shard != shard:
                    files += writer.commit()
                    writer, page = None, object()
                key = row_id.as_py()
                if key != page:
                    page, revisits, written = key, {}, {}
                if kind.as_py() == 0:  # roles of a page come before its records
                    revisits[digest.as_py()] = response.as_py()
                    continue
                writer = writer or ShardWriter(folder, shard, roll)
                data = payload.as_py()
                name = hashlib.sha1(data).hexdigest()
                response_id = revisits.get(name, key)
                again = name in revisits and (response_id != key or written.get(name, 0) > 0)
                # A response is the first record of its page with its payload.
                n = written.get(name, 0)
                written[name] = n + 1
                writer.write(gzip_member(make_record(key, n, url.as_py(), data, response_id, again)))
        files += writer.commit() if writer else []
        yield pa.RecordBatch.from_arrays(
            [pa.array([f["name"] for f in files], pa.string()), pa.array([f["bytes"] for f in files], pa.int64()), pa.array([f["records"] for f in files], pa.int64())],
            names=["file", "bytes", "records"],
        )

    return run


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, roll: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the rows ``id, url, payload`` as WARC files and returns ``file, bytes, records`` of them all.

    A shard is a range of ids with about ``shard_bytes`` of payload; it is written by one task, whichever
    partition it is in, so that files and bytes depend on the rows alone. Rows without an id are in the first.
    """
    bounds = shard_bounds(pages, shard_bytes)
    shared = pages.sparkSession.sparkContext.broadcast(np.array(bounds, np.uint64))

    def place(column: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(shared.value, _ordered(column), side="right").astype(np.int32))

    place.__annotations__ = {"column": pa.Array, "return": pa.Array}
    shard = arrow_udf("int")(place)("id")
    listed = roles(pages, min_bytes).select("id", F.lit(0).alias("kind"), "digest", "response_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"))
    records = pages.select("id", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("response_id"), "url", "payload")
    rows = listed.unionByName(records).withColumn("shard", shard)
    # Records of one page are ordered by content, so that the shard's bytes do not depend on arrival.
    ordered = rows.repartitionByRange(len(bounds) + 1, "shard").sortWithinPartitions("shard", "id", "kind", "digest", "url", F.sha1("payload"))
    return durable(ordered.mapInArrow(_write_shard(folder, roll), "file string, bytes long, records long"))


def read_records(stream: io.RawIOBase) -> list:
    """Yields ``(header dict, block)`` of each record of a WARC file of gzip members, one at a time."""
    unzip, pending = zlib.decompressobj(31), b""
    buffer = bytearray()
    while True:
        data = pending or stream.read(1 << 20)
        if not data:
            break
        buffer += unzip.decompress(data)
        pending = unzip.unused_data
        if unzip.eof:
            head, _, rest = bytes(buffer).partition(CRLF + CRLF)
            lines = head.decode().split("\r\n")
            header = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
            header["version"] = lines[0]
            yield header, rest[: int(header["Content-Length"])]
            unzip, buffer = zlib.decompressobj(31), bytearray()
    if buffer:
        raise ValueError("the archive ends within a record")


def parse_record(header: dict, block: bytes) -> dict:
    """The fields of a page; digests and lengths are checked against the content."""
    http, _, payload = block.partition(CRLF + CRLF)
    fields = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    digest = header["WARC-Payload-Digest"].removeprefix("sha1:")
    if header["WARC-Block-Digest"] != "sha1:" + payload_digest(block):
        raise ValueError(f"{header['WARC-Record-ID']}: the block has another digest")
    revisit = header["WARC-Type"] == "revisit"
    size = int(fields["Content-Length"])
    if not revisit and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"{header['WARC-Record-ID']}: the payload has another length or digest")
    return {
        "page_id": page_of(header["WARC-Record-ID"]), "url": header["WARC-Target-URI"], "record_type": header["WARC-Type"],
        "payload_bytes": size, "payload_digest": digest, "refers_to": page_of(header["WARC-Refers-To"]) if revisit else None,
        "payload": None if revisit else payload,
    }


_FIELDS = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")


def read_archives(spark: SparkSession, folder: str, files: DataFrame, payloads: bool = False) -> DataFrame:
    """Pages of the files listed in ``files``; revisits have no payload. One task reads whole files."""
    names = [*_FIELDS, *(["payload"] if payloads else [])]
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}

    def run(batches):
        fs, path = open_folder(folder)
        for b in batches:
            for name in b.column("file").to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for header, block in read_records(stream):
                        rows.append(parse_record(header, block))
                        size += len(block)
                        if len(rows) >= 5000 or payloads and size > 8_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in names], names=names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in names], names=names)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    n = files.count()
    # Files are spread by their number; a listing has one short row per file.
    dealt = files.select("file").repartition(max(1, min(n, 10_000)), "file")
    return dealt.mapInArrow(run, schema + (", payload binary" if payloads else ""))


def archive(pages: DataFrame, page_id: str | Column = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, roll: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the pages and reads them back."""
    spark = pages.sparkSession
    folder = shared_path(spark, "warc")
    rows = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "utf-8").alias("payload"))
    return read_archives(spark, folder, write_archives(rows, folder, min_bytes, roll, shard_bytes))
