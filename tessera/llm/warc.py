"""WARC records in ZIP packages: written with stored members and an index, and range-read without extraction.

A package holds ``archive/data.warc.gz`` (one gzip member for each record) and ``indexes/index.cdxj`` (a line for each
record with its offset and length), both stored, not deflated. The reader finds the end of the central directory, or its
ZIP64 form, parses the entries with their ZIP64 extra fields, locates the members, and reads each record by its range
with few large reads. Files are reached through their URI's file system, so any executor can read any package.

Records of equal payloads: the one with the smallest page_id holds the payload (response), the others point to it
(revisit, without a payload). Digests are bare base32 SHA-1. Payloads under ``least`` bytes are always responses.

Defined cases: null html is an empty payload; a null page_id sorts after all others and is read back as null; of equal
page_ids the smaller url is first, a null one last; rows that repeat wholly become one response and revisits of the same
page_id; an empty table makes no package. A payload of any length is one record, held whole by the task that writes or
reads it. Only page_id, url and html are read, so other columns can't clash, whatever their names. A package is written under a fresh name by
each attempt of a task and counts only once its row is in the committed manifest table, so lost executors leave at most
files that nobody reads.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import file_system, scratch, staged

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Bytes of compressed records after which a package is closed, and bytes that a reader asks for at once.
PACKAGE, READ = 32 << 20, 4 << 20
#: Tasks of a reader at most.
TASKS = 20_000
DATE = "2000-01-01T00:00:00Z"
RECORD = "page_id string, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to string, package string, offset bigint, length bigint"


class Member(NamedTuple):
    name: str
    method: int
    size: int
    start: int  # of its bytes in the package


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def directory(file, size: int) -> list[Member]:
    """The members of a ZIP package, by its central directory. file: has read_at(length, offset)."""
    tail = file.read_at(min(size, 65_557), max(0, size - 65_557))
    at = tail.rfind(b"PK\5\6")
    if at < 0:
        raise ValueError("no end of a central directory")
    n, length, start = struct.unpack_from("<H2I", tail, at + 10)
    end = size - len(tail) + at
    if n == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        sign, _, where = struct.unpack_from("<2IQ", file.read_at(20, end - 20))
        if sign != 0x07064B50:
            raise ValueError("no ZIP64 locator")
        record = file.read_at(56, where)
        if record[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 end of a central directory")
        n, length, start = struct.unpack_from("<3Q", record, 32)
    entries, at, members = file.read_at(length, start), 0, []
    for _ in range(n):
        if entries[at : at + 4] != b"PK\1\2":
            raise ValueError("a broken central directory")
        flags, method = struct.unpack_from("<2H", entries, at + 8)
        packed, full, names, extras, notes = struct.unpack_from("<2I3H", entries, at + 20)
        (local,) = struct.unpack_from("<I", entries, at + 42)
        name = entries[at + 46 : at + 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
        extra = entries[at + 46 + names : at + 46 + names + extras]
        while len(extra) >= 4:
            kind, own = struct.unpack_from("<2H", extra)
            if kind == 1:  # 64-bit values stand for those that are full, in this order
                values = iter(struct.unpack_from(f"<{own // 8}Q", extra, 4))
                full = next(values) if full == 0xFFFFFFFF else full
                packed = next(values) if packed == 0xFFFFFFFF else packed
                local = next(values) if local == 0xFFFFFFFF else local
            extra = extra[4 + own :]
        members.append((name, method, packed, local))
        at += 46 + names + extras + notes
    out = []
    for name, method, packed, local in members:
        head = file.read_at(30, local)
        if head[:4] != b"PK\3\4":
            raise ValueError("a broken local header")
        names, extras = struct.unpack_from("<2H", head, 26)
        out.append(Member(name, method, packed, local + 30 + names + extras))
    return out


def stored(members: list[Member], name: str) -> Member:
    found = [m for m in members if m.name == name]
    if not found:
        raise KeyError(name)
    if found[-1].method:
        raise ValueError(f"{name} is not stored: it can't be read by range")
    return found[-1]


def record(row: dict) -> bytes:
    """One record, uncompressed. Header values are percent-encoded where they hold line ends or non-ASCII text."""
    from urllib.parse import quote

    uri = quote(row["url"] or "", safe=":/?#[]@!$&'()*+,;=%-._~")
    payload = row["payload"] if row["record_type"] == "response" else b""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_bytes"] + payload
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <urn:page:{row['page_id']}>", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{row['payload_digest']}"]
    if row["record_type"] == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{row['refers_to']}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers of the record, headers of the HTTP message, payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    own = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(own["content-length"])]
    inner, _, payload = block.partition(b"\r\n\r\n")
    return own, {k.lower(): v for k, _, v in (x.partition(": ") for x in inner.decode().split("\r\n")[1:])}, payload


def package(rows: list[bytes], index: list[str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in ((DATA, b"".join(rows)), (INDEX, "".join(index).encode())):
            z.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


def write_packages(uri: str, rows: Iterator[dict], limit: int = PACKAGE) -> Iterator[tuple[str, int, int]]:
    """Write packages into a folder; yields name, bytes and records of each."""
    fs, folder = file_system(uri)
    fs.create_dir(folder, recursive=True)
    data, index, held = [], [], 0

    def close() -> tuple[str, int, int]:
        name, made = f"{uuid.uuid4().hex}.wacz", package(data, index)
        with fs.open_output_stream(f"{folder}/{name}") as out:
            out.write(made)
        return name, len(made), len(index)

    for row in rows:
        squeezed = zlib.compressobj(1, wbits=31)
        packed = squeezed.compress(record(row)) + squeezed.flush()
        index.append(json.dumps({"id": row["page_id"], "url": row["url"], "offset": held, "length": len(packed)}) + "\n")
        data.append(packed)
        held += len(packed)
        if held >= limit:
            yield close()
            data, index, held = [], [], 0
    if index:
        yield close()


def read_package(uri: str, name: str, read: int = READ) -> Iterator[dict]:
    """Every record that the index lists, by ranges of about ``read`` bytes."""
    fs, folder = file_system(uri)
    with fs.open_input_file(f"{folder}/{name}") as file:
        members = directory(file, file.size())
        data, index = stored(members, DATA), stored(members, INDEX)
        wanted = [json.loads(x) for x in file.read_at(index.size, index.start).splitlines()]
        at = 0
        while at < len(wanted):
            stop, first = at, wanted[at]["offset"]
            while stop < len(wanted) and (stop == at or wanted[stop]["offset"] + wanted[stop]["length"] - first <= read):
                stop += 1
            size = wanted[stop - 1]["offset"] + wanted[stop - 1]["length"] - first
            held = file.read_at(size, data.start + first)
            for entry in wanted[at:stop]:
                own, http, payload = parsed(zlib.decompress(held[entry["offset"] - first :][: entry["length"]], wbits=31))
                kind, digest = own["warc-type"], own["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"{name}: the payload of {own['warc-record-id']} is damaged")
                page = lambda key: None if (x := own[key][len("<urn:page:") : -1]) == "None" else x
                yield {
                    "page_id": page("warc-record-id"), "url": entry["url"], "record_type": kind, "payload": payload,
                    "payload_bytes": len(payload) if kind == "response" else int(http["content-length"]), "payload_digest": digest,
                    "refers_to": page("warc-refers-to") if kind == "revisit" else None, "package": name, "offset": entry["offset"], "length": entry["length"],
                }
            at = stop


def _decided(rows: DataFrame, least: int) -> DataFrame:
    """(place, page_id, url, sha1, payload_bytes, copies, is_head, refers_to) of each distinct row; no payload is moved.

    A digest that has more than a ten-thousandth of the repeated rows joins by broadcast (there can't be over 10,000 of
    those), the others by digest, so that no task gets all pages of a common payload.
    """
    own = staged(rows.groupBy("place", "page_id", "url", "sha1", "payload_bytes").agg(F.count(F.lit(1)).alias("copies")), "warc-rows")
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("url").isNull().alias("nowhere"), "url", "place")
    heads = own.where(F.col("payload_bytes") >= least).groupBy("sha1", "payload_bytes").agg(F.min(order).alias("head"), F.sum("copies").alias("n"))
    heads = staged(heads.where("n > 1").select("sha1", "payload_bytes", F.col("head.page_id").alias("head_id"), F.col("head.place").alias("head_place"), "n"), "warc-heads")
    often = max(100, (heads.agg(F.sum("n")).first()[0] or 0) // 10_000)
    keys = ["sha1", "payload_bytes"]
    hot = F.broadcast(heads.where(F.col("n") > often).drop("n"))
    both = own.join(hot, keys).unionByName(own.join(hot, keys, "left_anti").join(heads.where(F.col("n") <= often).drop("n"), keys, "left"))
    is_head = F.coalesce(F.col("place") == F.col("head_place"), F.lit(True))
    return staged(both.select("place", "page_id", "url", *keys, "copies", is_head.alias("is_head"), F.col("head_id").alias("refers_to")), "warc-decided")


def records_of(pages: DataFrame, least: int = 0) -> DataFrame:
    """A row for each record: page_id, url, payload (null for revisits), sha1, payload_bytes, record_type, refers_to.

    What becomes of each row is decided on ids and digests alone. Payloads then go through one exchange, by the hash of the
    whole row (page_id, url and digest), where those of responses meet their decisions; revisits have none.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("bigint"))
    rows = rows.withColumn("place", F.sha1(F.to_json(F.struct("page_id", "url", "sha1", "payload_bytes")).cast("binary")))
    decided = _decided(rows, least)
    small = F.col("payload_bytes") < least
    columns = ["page_id", "url", "payload", "sha1", "payload_bytes", "record_type", "refers_to"]
    times = lambda n: F.explode(F.sequence(F.lit(1).cast("bigint"), n))
    whole = decided.where("is_head").withColumn("k", times(F.when(small, F.col("copies")).otherwise(F.lit(1).cast("bigint"))))
    whole = rows.groupBy("place").agg(F.first("payload").alias("payload")).join(whole, "place")
    whole = whole.withColumn("record_type", F.lit("response")).withColumn("refers_to", F.lit(None).cast(pages.schema["page_id"].dataType))
    left = F.when(F.col("is_head"), F.col("copies") - 1).otherwise(F.col("copies"))
    rest = decided.where(~small).withColumn("left", left).where("left > 0").withColumn("k", times(F.col("left")))
    rest = rest.withColumn("payload", F.lit(None).cast("binary")).withColumn("record_type", F.lit("revisit"))
    return whole.select(columns).union(rest.select(columns))


def written(pages: DataFrame, uri: str | None = None, least: int = 0, limit: int = PACKAGE) -> DataFrame:
    """Write packages of all rows of pages (page_id, url, html); the manifest (uri, package, bytes, records)."""
    folder = uri or scratch(pages.sparkSession, "warc")

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (dict(zip(part.schema.names, x, strict=True)) for part in parts for x in zip(*(c.to_pylist() for c in part.columns), strict=True))
        made = list(write_packages(folder, ({**r, "payload_digest": base32(r["sha1"])} for r in rows), limit))
        names, sizes, counts = ([m[k] for m in made] for k in range(3))
        columns = {"uri": pa.array([folder] * len(made), pa.string()), "package": pa.array(names, pa.string()), "bytes": pa.array(sizes, pa.int64()), "records": pa.array(counts, pa.int64())}
        yield pa.RecordBatch.from_pydict(columns)

    return staged(records_of(pages, least).mapInArrow(write, "uri string, package string, bytes bigint, records bigint"), "warc-manifest")


def read(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the manifest's packages, with their payloads if asked for."""
    schema = RECORD + (", payload binary" if payloads else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def load(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        types = [kinds[x.split()[1]] for x in schema.split(", ")]

        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names)

        for part in parts:
            for uri, name in zip(part.column("uri").to_pylist(), part.column("package").to_pylist(), strict=True):
                rows, held = [], 0
                for row in read_package(uri, name):
                    rows.append(row)
                    held += len(row["payload"])
                    if held > READ or len(rows) >= 5000:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    spark = manifest.sparkSession
    n = max(1, manifest.count())
    tasks = min(n, 4 * spark.sparkContext.defaultParallelism) if n < 1000 else min(n, TASKS)
    return manifest.select("uri", "package").repartition(tasks).mapInArrow(load, schema)
