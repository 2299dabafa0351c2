"""WARC records inside ZIP packages: writer, and a reader that only reads ranges.

A package holds ``archive/data.warc.gz`` (records, each a gzip member) and ``indexes/index.jsonl`` (where
each record lies in it), both stored without further compression.  The reader finds the end-of-directory
record (and its ZIP64 form), parses the central directory, locates the stored members, and then fetches
single records by offset and length; nothing is extracted.

Of records with equal payloads of at least ``least`` bytes, that of the smallest id is a response and the
others are revisits that name it; smaller payloads are all responses.  Equal payloads are found by SHA-256
of the whole payload, summed up before any shuffle; only ids and digests are joined.

Nulls: a null html is an empty payload, a null url leaves the target out, a null id is written as "null"
and read back as null.  Repeated rows are records each; repeats of the smallest id itself are responses.
An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, read, store

DATA, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
#: A package is closed and another begun beyond so many bytes.
PACKAGE_BYTES = 512 << 20
_ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
#: The fixed date of a record: pages carry none.
DATE = "1970-01-01T00:00:00Z"


# ---------------------------------------------------------------- ZIP directories


class Package:
    """The stored members of a ZIP file, by ranged reads of a random-access Arrow file."""

    END, END64, LOCATOR, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"

    def __init__(self, f):
        self.f, self.size = f, f.size()
        tail_at = max(0, self.size - 65_557 - 20)
        tail = f.read_at(self.size - tail_at, tail_at)
        at = tail.rfind(self.END)
        if at < 0:
            raise ValueError("no end of central directory")
        count, length, first = struct.unpack("<HII", tail[at + 10 : at + 20])
        if count == 0xFFFF or length == 0xFFFFFFFF or first == 0xFFFFFFFF:
            if tail[at - 20 : at - 16] != self.LOCATOR:
                raise ValueError("no ZIP64 locator")
            (end64,) = struct.unpack("<Q", tail[at - 12 : at - 4])
            head = f.read_at(56, end64)
            if head[:4] != self.END64:
                raise ValueError("no ZIP64 end of central directory")
            count, length, first = struct.unpack("<QQQ", head[32:56])
        self.members = self._entries(f.read_at(length, first), count)

    def _entries(self, raw: bytes, count: int) -> dict[str, tuple[int, int, int]]:
        """name -> (method, size in the package, offset of the local header)."""
        out, at = {}, 0
        for _ in range(count):
            if raw[at : at + 4] != self.ENTRY:
                raise ValueError("broken central directory")
            flags, method = struct.unpack("<HH", raw[at + 8 : at + 12])
            packed, full, n, m, k = struct.unpack("<IIHHH", raw[at + 20 : at + 34])
            (header,) = struct.unpack("<I", raw[at + 42 : at + 46])
            name = raw[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            extra, x = raw[at + 46 + n : at + 46 + n + m], 0
            while x + 4 <= len(extra):
                kind, width = struct.unpack("<HH", extra[x : x + 4])
                if kind == 1:  # ZIP64: those of the three fields that are full in the plain entry, in this order
                    wide, values = x + 4, []
                    for v in (full, packed, header):
                        if v == 0xFFFFFFFF:
                            (v,) = struct.unpack("<Q", extra[wide : wide + 8])
                            wide += 8
                        values.append(v)
                    full, packed, header = values
                x += 4 + width
            out[name] = (method, packed, header)
            at += 46 + n + m + k
        return out

    def locate(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes begin, and how many there are."""
        method, size, header = self.members[name]
        if method != 0:
            raise ValueError(f"{name} isn't stored")
        head = self.f.read_at(30, header)
        if head[:4] != self.LOCAL:
            raise ValueError("broken local header")
        n, m = struct.unpack("<HH", head[26:30])
        return header + 30 + n + m, size

    def range(self, name: str, offset: int, length: int) -> bytes:
        first, size = self.locate(name)
        if offset < 0 or offset + length > size:
            raise ValueError("outside the member")
        return self.f.read_at(length, first + offset)


# ---------------------------------------------------------------- records


def _name(page) -> str:
    return f"<urn:page:{'null' if page is None else page}>"


def _page(name: str):
    page = name.strip("<>").rsplit(":", 1)[1]
    return int(page) if name.startswith("<urn:page:") and page != "null" else None  # records of others have no page's number


def record(page, url, payload: bytes, refers_to) -> bytes:
    """A response or, with ``refers_to``, a revisit; HTTP headers tell the payload's length in both."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {_name(page)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers in lower case, and the payload's bytes (none for a revisit), checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    if fields["warc-type"] == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload of {fields['warc-record-id']}")
    return {"page_id": _page(fields["warc-record-id"]), "payload_bytes": length, "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": _page(fields["warc-refers-to"]) if "warc-refers-to" in fields else None, "url": fields.get("warc-target-uri"), "payload": payload}


# ---------------------------------------------------------------- writing and reading packages


class _Sink:
    def __init__(self, stream):
        self.stream, self.at = stream, 0

    def write(self, data):
        self.stream.write(data)
        self.at += len(data)
        return len(data)

    def flush(self):
        pass


def _write(folder: str, most: int):
    def run(batches):
        fs, base = store(folder)
        out = zipped = member = None
        index, names, at = [], [], 0

        def close():
            member.close()
            zipped.writestr(zipfile.ZipInfo(INDEX), "".join(index))
            zipped.close()
            out.close()

        for b in batches:
            pages, urls, refs = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()
            for k, html in enumerate(b.column(2)):
                if member is None or at >= most:
                    if member is not None:
                        close()
                    names.append(f"{uuid.uuid4().hex}.zip")
                    out, index, at = fs.open_output_stream(f"{base}/{names[-1]}"), [], 0
                    zipped = zipfile.ZipFile(_Sink(out), "w", zipfile.ZIP_STORED, allowZip64=True)
                    member = zipped.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
                payload = (html.as_py() or "").encode()
                raw = gzip.compress(record(pages[k], urls[k], payload, refs[k]), 5, mtime=0)
                member.write(raw)
                index.append(json.dumps({"id": pages[k], "offset": at, "length": len(raw)}) + "\n")
                at += len(raw)
        if member is not None:
            close()
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names)], names=["path"])

    return run


def with_targets(df: DataFrame, least: int = 100) -> DataFrame:
    """id, url, html, refers_to: the id of the first record with an equal payload, null for responses."""
    whole = F.coalesce("html", F.lit(""))
    own = df.select("page_id", F.sha2(whole.cast("binary"), 256).alias("digest")).where(F.octet_length(whole) >= least)
    first = own.groupBy("digest").agg(F.min("page_id").alias("target"), F.count("*").alias("n")).where("n > 1 and target is not null").select("digest", "target")
    refs = own.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("target"))).select(F.col("page_id").alias("by"), F.col("digest").alias("by_digest"), "target").distinct()
    keyed = df.withColumn("digest", F.sha2(whole.cast("binary"), 256))
    return keyed.join(refs, F.col("page_id").eqNullSafe(F.col("by")) & (F.col("digest") == F.col("by_digest")), "left").select("page_id", "url", "html", F.col("target").alias("refers_to"))


def write_packages(df: DataFrame, folder: str, least: int = 100, package_bytes: int = PACKAGE_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> list[str]:
    """Writes the pages as ZIP packages of WARC records; the names of the packages."""
    fs, path = store(folder)
    fs.create_dir(path, recursive=True)
    t = df.select(df[id_col].cast("long").alias("page_id"), df[url_col].cast("string").alias("url"), df[html_col].cast("string").alias("html"))
    return sorted(r["path"] for r in with_targets(t, least).mapInArrow(_write(folder, package_bytes), "path string").collect())


def indexed(package: Package) -> list[tuple[str, int, int]]:
    """(archive member, offset, length) of every record that the package's indexes list, by place.

    Indexes are members of indexes/, plain or gzipped: lines of JSON, or of a key and a time before the JSON (CDXJ).  An
    entry may name its archive; else it is the package's only one.
    """
    archives = sorted(m for m in package.members if m.startswith("archive/") and m.endswith((".warc.gz", ".warc")))
    out = []
    for name in sorted(m for m in package.members if m.startswith("indexes/")):
        raw = package.range(name, 0, package.members[name][1])
        for line in (gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw).splitlines():
            at = line.find(b"{")
            if at < 0 or line.startswith(b"!"):
                continue
            e = json.loads(line[at:])
            if "offset" in e and "length" in e:
                own = f"archive/{e['filename'].rsplit('/', 1)[-1]}" if "filename" in e else archives[0] if len(archives) == 1 else None
                if own not in package.members:
                    raise ValueError(f"an entry of {name} names no archive of the package")
                out.append((own, int(e["offset"]), int(e["length"])))
    return sorted(set(out))


def read_packages(spark, folder: str, names: list[str], ahead: int = 8 << 20) -> DataFrame:
    """One row per record, by ranged reads: neighbours in the index are fetched together, up to ``ahead`` bytes."""

    def run(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                fs, path = store(f"{folder}/{names[k]}")
                with fs.open_input_file(path) as f:
                    package, rows = Package(f), []
                    entries, at = indexed(package), 0
                    starts = {m: package.locate(m)[0] for m in {e[0] for e in entries}}
                    while at < len(entries):
                        member, lo, length = entries[at]
                        end, last = at + 1, lo + length
                        while end < len(entries) and entries[end][0] == member and max(last, sum(entries[end][1:])) - lo <= ahead:
                            last = max(last, sum(entries[end][1:]))
                            end += 1
                        raw = f.read_at(last - lo, starts[member] + lo)
                        for _, offset, length in entries[at:end]:
                            piece = raw[offset - lo : offset - lo + length]
                            r = parse(zlib.decompress(piece, 31) if piece[:2] == b"\x1f\x8b" else piece)
                            del r["payload"]
                            rows.append(r)
                        at = end
                        if len(rows) >= 4096:
                            yield _batch(rows)
                            rows = []
                    if rows:
                        yield _batch(rows)

    return spark.range(0, len(names), 1, max(1, len(names))).mapInArrow(run, _ROWS)


def _batch(rows):
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())]))


def op6_zip_warc(spark, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    return read_packages(spark, folder, write_packages(read(spark, sf_dir, "pages"), folder)).drop("url")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS target FROM q)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> target THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> target THEN target END AS refers_to
FROM r
"""
