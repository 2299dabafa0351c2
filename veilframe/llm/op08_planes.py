"""Token-id files: bit- or byte-plane shuffled blocks under zstandard, with a chunk index.

A shard holds the documents of one range of ids, in ascending order.  Its ids are cut into blocks of a
fixed number; a block's 32-bit little-endian ids are transposed into planes (4 byte planes, or 32 bit
planes), each plane is compressed by itself, and the index says where every plane of every block lies, so
that a reader fetches only the blocks it needs, in ranges.

Layout: MAGIC, planes of block 0, 1, ..., document table, block table, tail.  The document table is two
compressed int64 columns (id, number of ids) with a null flag; the block table holds for each block its
number of ids and the compressed sizes of its planes; the tail is six little-endian int64: offset and size
of both tables, number of documents, number of planes; then MAGIC again.

Nulls: a null text is an empty document, a null id sorts first.  Repeated rows are documents each; an
empty table gives an empty result.  Other columns are not read.  A shard's name carries the attempt that
wrote it, and only names that a finished task returned are read: retried tasks do no harm.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import fresh_path, id_and_text, partitions, read, store
from .tokens import default_path, encoded

MAGIC = b"VFPLANE1"
TAIL = struct.Struct("<6q8s")
BLOCK = 65_536
_SHARD = "path string, lowest long, n_docs long, n_ids long, n_null long"
_ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [raw[:, k].tobytes() for k in range(4)]
    return [np.packbits((raw[:, k] >> b) & 1, bitorder="little").tobytes() for k in range(4) for b in range(8)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    raw = np.zeros((n, 4), np.uint8)
    if len(planes) == 4:
        for k, p in enumerate(planes):
            raw[:, k] = np.frombuffer(p, np.uint8)
    else:
        for k, p in enumerate(planes):
            raw[:, k // 8] |= np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") << (k % 8)
    return raw.reshape(-1).view("<u4")


class Writer:
    """Streams documents into a shard; holds one block and 16 bytes a document."""

    def __init__(self, out, kind: str = "byte", block: int = BLOCK, level: int = 3):
        import zstandard

        self.out, self.kind, self.block, self.z = out, kind, block, zstandard.ZstdCompressor(level=level)
        self.held, self.held_n, self.docs, self.sizes, self.blocks, self.at = [], 0, [], [], [], len(MAGIC)
        out.write(MAGIC)

    def _emit(self, ids: np.ndarray) -> None:
        packed = [self.z.compress(p) for p in to_planes(ids, self.kind)]
        self.blocks.append([len(ids), *map(len, packed)])
        for p in packed:
            self.out.write(p)
            self.at += len(p)

    def add(self, doc_id, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.sizes.append(len(ids) // 4)
        self.held.append(ids)
        self.held_n += len(ids) // 4
        if self.held_n >= self.block:
            all_ids = np.frombuffer(b"".join(self.held), "<u4")
            whole = self.held_n // self.block * self.block
            for i in range(0, whole, self.block):
                self._emit(all_ids[i : i + self.block])
            self.held, self.held_n = [all_ids[whole:].tobytes()], self.held_n - whole

    def close(self) -> None:
        if self.held_n:
            self._emit(np.frombuffer(b"".join(self.held), "<u4"))
        null = np.array([d is None for d in self.docs], np.int64)
        table = self.z.compress(np.array([[0 if d is None else d for d in self.docs], self.sizes, null], "<i8").tobytes())
        index = self.z.compress(np.array(self.blocks, "<i8").tobytes())
        self.out.write(table + index + TAIL.pack(self.at, len(table), self.at + len(table), len(index), len(self.docs), 4 if self.kind == "byte" else 32, MAGIC))


class Reader:
    """Reads a shard in ranges; ``f`` is a random-access Arrow file."""

    def __init__(self, f):
        import zstandard

        self.f, self.z = f, zstandard.ZstdDecompressor()
        size = f.size()
        at, n_at, index, n_index, self.n_docs, self.n_planes, magic = TAIL.unpack(f.read_at(TAIL.size, size - TAIL.size))
        if magic != MAGIC or f.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError("not a shard of this format")
        docs = np.frombuffer(self.z.decompress(f.read_at(n_at, at)) if n_at else b"", "<i8").reshape(3, -1)
        self.docs, self.sizes, self.null = docs[0], docs[1], docs[2].astype(bool)
        self.blocks = np.frombuffer(self.z.decompress(f.read_at(n_index, index)), "<i8").reshape(-1, 1 + self.n_planes)
        self.first = len(MAGIC) + np.concatenate(([0], np.cumsum(self.blocks[:, 1:].sum(1))))
        self.ends = np.cumsum(self.blocks[:, 0])
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))

    def block(self, k: int) -> np.ndarray:
        raw, planes, at = self.f.read_at(int(self.first[k + 1] - self.first[k]), int(self.first[k])), [], 0
        for n in self.blocks[k, 1:]:
            planes.append(self.z.decompress(raw[at : at + int(n)]))
            at += int(n)
        return from_planes(planes, int(self.blocks[k, 0]))

    def documents(self, first: int = 0, last: int | None = None):
        """(id, start in the shard, ids) of documents first..last-1; only their blocks are read."""
        held, at = -1, None
        for i in range(first, self.n_docs if last is None else last):
            lo, hi, parts = int(self.starts[i]), int(self.starts[i + 1]), []
            k = int(np.searchsorted(self.ends, lo, "right"))
            while lo < hi:
                if k != held:
                    held, at = k, self.block(k)
                base = int(self.ends[k]) - len(at)
                parts.append(at[lo - base : hi - base])
                lo = base + min(len(at), hi - base)
                k += 1
            yield None if self.null[i] else int(self.docs[i]), int(self.starts[i]), np.concatenate(parts) if parts else np.zeros(0, "<u4")


def _write(folder: str, tokenizer: str, end_id: int, kind: str, block: int):
    def run(batches):
        fs, path = store(f"{folder}/{uuid.uuid4().hex}.planes")
        out = writer = None
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for row, raw in encoded(batch.column(1), tokenizer):
                if writer is None:
                    out = fs.open_output_stream(path)
                    writer = Writer(out, kind, block)
                writer.add(ids[row], raw + end)
        if writer is not None:
            writer.close()
            out.close()
            known = [d for d in writer.docs if d is not None]
            yield pa.RecordBatch.from_pylist([{"path": path.rsplit("/", 1)[1], "lowest": known[0] if known else None, "n_docs": len(writer.docs), "n_ids": sum(writer.sizes), "n_null": len(writer.docs) - len(known)}], schema=pa.schema([("path", pa.string()), ("lowest", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_null", pa.int64())]))

    return run


def write_token_files(df: DataFrame, folder: str, end_id: int = 2, tokenizer: str | None = None, kind: str = "byte", block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Writes shards in ascending id order; the manifest (a row a shard) in that order, with ``base``, the ids before each."""
    if kind not in ("byte", "bit"):
        raise ValueError(kind)
    spark = df.sparkSession
    fs, path = store(folder)
    fs.create_dir(path, recursive=True)
    docs = id_and_text(df, id_col, text_col).repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id")
    rows = [r.asDict() for r in docs.mapInArrow(_write(folder, tokenizer or default_path(), end_id, kind, block), _SHARD).collect()]
    base = 0
    rows.sort(key=lambda r: (r["n_null"] == 0, r["lowest"] if r["lowest"] is not None else -(1 << 63)))
    for r in rows:
        r["base"] = base
        base += r["n_ids"]
    return rows


def read_token_files(spark, folder: str, manifest: list[dict]) -> DataFrame:
    """One row per document of the shards: doc_id, start, n_tokens, ids_crc32."""
    shards = [(r["path"], r["base"]) for r in manifest]

    def run(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                fs, path = store(f"{folder}/{shards[k][0]}")
                with fs.open_input_file(path) as f:
                    rows = []
                    for doc, start, ids in Reader(f).documents():
                        rows.append((doc, shards[k][1] + start, len(ids), zlib.crc32(ids.tobytes())))
                        if len(rows) == 8192:
                            yield _rows(rows)
                            rows = []
                    if rows:
                        yield _rows(rows)

    return spark.range(0, len(shards), 1, max(1, len(shards))).mapInArrow(run, _ROWS)


def _rows(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op8_plane_files(spark, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "token-files")
    return read_token_files(spark, folder, write_token_files(read(spark, sf_dir, "documents"), folder))
