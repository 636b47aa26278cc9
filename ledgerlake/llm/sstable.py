"""Sorted-string tables of token ids: documents keyed by identifier, found again by binary search.

Documents are range-partitioned by id and sorted within each partition, so every task writes its files in key order
and the files of all tasks in path order hold the whole corpus in key order. A task opens a new file once one
reaches a set size; files are written under a name of their own and then moved to a name that the partition
decides, so a task that runs again (a lost executor, speculation) leaves the same files.

A file is: data blocks | Bloom filter | block index | footer.
  block   entries `varint shared, varint rest, varint value size, key's rest, value`; a key shares its first bytes with
          the key before it, but every 16th starts anew; then u32 offsets of those restarts, u32 their number, u32 crc32
  value   varint n_tokens, u8 width of an id in bytes (2 or 4), ids little-endian
  Bloom   u32 number of probes, then the bit array
  index   per block: u16 key size, last key, u64 offset, u32 size
  footer  u64 index offset, u32 index size, u64 Bloom offset, u32 Bloom size, u64 documents, u64 tokens, u32 crc32, magic
A key is a byte 1 and the id as big-endian 64 bits with the sign bit turned, or a single byte 0 for a null id.

Look-ups test the Bloom filter, search the index for the block and the block's restarts for the key.

Edge cases. Null text: only the end id. Null ids come first. Rows that repeat an id are entries of their own, in the
order of their texts' hashes, and may stand in several files; a look-up returns all. Empty and very long texts are entries like any other. An empty table
gives no files and no rows. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_dir, ids_and_texts, ids_back, table, written
from .tokens import loaded

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
MAGIC = b"LLSSTv1\n"
FOOTER = struct.Struct("<QIQIQQI")
RESTART = 16
BLOCK_BYTES = 64 * 1024
FILE_BYTES = 128 * 1024 * 1024
BLOOM_BITS, BLOOM_PROBES = 10, 7
MANIFEST = "part int, seq int, path string, first_id long, last_id long, n_docs long, n_tokens long, n_bytes long"


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & 0xFFFFFFFFFFFFFFFF)


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int, probes: int) -> list[int]:
    import xxhash

    h = xxhash.xxh64_intdigest(key)
    step = (h >> 33) | 1
    return [(h + i * step) % bits for i in range(probes)]


class TableWriter:
    """Builds one file in memory-bounded blocks; keys must come in order."""

    def __init__(self, sink):
        self.sink, self.at = sink, 0
        self.block, self.restarts, self.n, self.last = bytearray(), [], 0, b""
        self.index: list[bytes] = []
        self.keys: list[bytes] = []
        self.docs = self.tokens = 0

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, key: bytes, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit."""
        import numpy as np

        many = np.frombuffer(ids, "<u4")
        wide = len(many) and int(many.max()) > 0xFFFF
        value = _varint(len(many)) + (b"\4" + ids if wide else b"\2" + many.astype("<u2").tobytes())
        shared = 0
        if self.n % RESTART:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(len(self.block))
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last, self.n = key, self.n + 1
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        self.docs += 1
        self.tokens += len(many)
        if len(self.block) >= BLOCK_BYTES:
            self._end_block()

    def _end_block(self) -> None:
        if not self.n:
            return
        body = bytes(self.block) + struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
        body += struct.pack("<I", zlib.crc32(body))
        self.index.append(struct.pack("<H", len(self.last)) + self.last + struct.pack("<QI", self.at, len(body)))
        self._put(body)
        self.block, self.restarts, self.n, self.last = bytearray(), [], 0, b""

    def close(self) -> None:
        self._end_block()
        bits = max(64, len(self.keys) * BLOOM_BITS)
        bloom = bytearray((bits + 7) // 8)
        bits = len(bloom) * 8
        for key in self.keys:
            for p in _probes(key, bits, BLOOM_PROBES):
                bloom[p >> 3] |= 1 << (p & 7)
        bloom_at, bloom = self.at, struct.pack("<I", BLOOM_PROBES) + bytes(bloom)
        self._put(bloom)
        index_at, index = self.at, b"".join(self.index)
        self._put(index)
        self._put(FOOTER.pack(index_at, len(index), bloom_at, len(bloom), self.docs, self.tokens, zlib.crc32(index + bloom)) + MAGIC)


class TableReader:
    """Reads one file: `source` has seek() and read()."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        end = source.tell()
        tail = self._at(end - FOOTER.size - len(MAGIC), FOOTER.size + len(MAGIC))
        if tail[FOOTER.size :] != MAGIC:
            raise ValueError("not a table of this format")
        index_at, index_size, bloom_at, bloom_size, self.docs, self.tokens, crc = FOOTER.unpack(tail[: FOOTER.size])
        index, self.bloom = self._at(index_at, index_size), self._at(bloom_at, bloom_size)
        if zlib.crc32(index + self.bloom) != crc:
            raise ValueError("damaged index or filter")
        self.last_keys, self.blocks, at = [], [], 0
        while at < len(index):
            (size,) = struct.unpack_from("<H", index, at)
            self.last_keys.append(index[at + 2 : at + 2 + size])
            self.blocks.append(struct.unpack_from("<QI", index, at + 2 + size))
            at += 14 + size

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def _block(self, i: int) -> bytes:
        body = self._at(*self.blocks[i])
        if zlib.crc32(body[:-4]) != struct.unpack("<I", body[-4:])[0]:
            raise ValueError(f"damaged block {i}")
        return body

    @staticmethod
    def _entries(body: bytes, at: int = 0) -> Iterator[tuple[bytes, bytes]]:
        (n,) = struct.unpack_from("<I", body, len(body) - 8)
        end, key = len(body) - 8 - 4 * n, b""
        while at < end:
            shared, at = _read_varint(body, at)
            rest, at = _read_varint(body, at)
            size, at = _read_varint(body, at)
            key = key[:shared] + body[at : at + rest]
            at += rest
            yield key, body[at : at + size]
            at += size

    @staticmethod
    def ids(value: bytes) -> bytes:
        import numpy as np

        _, at = _read_varint(value, 0)
        return value[at + 1 :] if value[at] == 4 else np.frombuffer(value, "<u2", offset=at + 1).astype("<u4").tobytes()

    def scan(self) -> Iterator[tuple[int | None, bytes]]:
        for i in range(len(self.blocks)):
            for key, value in self._entries(self._block(i)):
                yield id_of(key), self.ids(value)

    def get(self, doc_id: int | None) -> list[bytes]:
        """The ids of every document of that id, none if there is none."""
        key = key_of(doc_id)
        bits = (len(self.bloom) - 4) * 8
        if not all(self.bloom[4 + (p >> 3)] >> (p & 7) & 1 for p in _probes(key, bits, struct.unpack_from("<I", self.bloom)[0])):
            return []
        found, i = [], bisect_left(self.last_keys, key)
        while i < len(self.blocks):
            body = self._block(i)
            (n,) = struct.unpack_from("<I", body, len(body) - 8)
            restarts = struct.unpack_from(f"<{n}I", body, len(body) - 8 - 4 * n)
            low = bisect_left(restarts, key, key=lambda at: next(self._entries(body, at))[0])
            for k, value in self._entries(body, restarts[max(low - 1, 0)]):
                if k == key:
                    found.append(self.ids(value))
                elif k > key:
                    return found
            i += 1
        return found


def open_store(uri: str):
    """A file system that executors share, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_tables(docs: DataFrame, out_dir: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the files and return their manifest, one row a file, as a written table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder, end = loaded(tokenizer), struct.pack("<I", end_id)
        store, base = open_store(out_dir)
        store.create_dir(base, recursive=True)
        made, writer, sink, first, last, temp = [], None, None, None, None, ""

        def finish() -> None:
            nonlocal writer
            writer.close()
            sink.close()
            path = f"{base}/table-{part:06d}-{len(made):05d}.sst"
            store.move(temp, path)
            made.append((part, len(made), f"{out_dir}/{path.rpartition('/')[2]}", first, last, writer.docs, writer.tokens, writer.at))
            writer = None

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                doc_id = None if doc_id is None else int(doc_id)
                if writer is None:
                    temp = f"{base}/.{uuid.uuid4().hex}"
                    sink = store.open_output_stream(temp)
                    writer, first = TableWriter(sink), doc_id
                writer.add(key_of(doc_id), encoder.ids(text) + end)
                last = doc_id
                if writer.at >= file_bytes:
                    finish()
        if writer is not None:
            finish()
        yield pd.DataFrame(made, columns=[c.split()[0] for c in MANIFEST.split(", ")]).astype({"first_id": "Int64", "last_id": "Int64"})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # An id of any number of rows is split: ranges go by the text's hash and the row's place beside the id.
    order = ["doc_id", "_hash", "_place"]
    rows = rows.withColumns({"_hash": F.xxhash64("text"), "_place": F.monotonically_increasing_id()})
    ordered = ids_and_texts(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    return written(ordered.mapInPandas(run, MANIFEST), "sst-manifest")


def read_tables(manifest: DataFrame, keep_ids: bool = True) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, path, ids."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # over files, not documents
    based = manifest.select("part", "seq", "path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, base in zip(batch["path"], batch["base"]):
                store, at = open_store(path)
                rows, held, start = [], 0, int(base)
                with store.open_input_file(at) as source:
                    for doc_id, ids in TableReader(source).scan():
                        rows.append((None if doc_id is None else str(doc_id), start, len(ids) // 4, zlib.crc32(ids), path, ids)[: 6 if keep_ids else 5])
                        start += len(ids) // 4
                        held += len(ids) if keep_ids else 100
                        if held >= 16 << 20:
                            yield frame(rows)
                            rows, held = [], 0
                if rows:
                    yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        names = ["doc_id", "start", "n_tokens", "ids_crc32", "path", "ids"]
        return pd.DataFrame(rows, columns=names[: 6 if keep_ids else 5])

    schema = "doc_id string, start long, n_tokens long, ids_crc32 long, path string" + (", ids binary" if keep_ids else "")
    # The manifest is small but the files are not: a task for each, which adaptive execution leaves alone.
    return ids_back(based.repartitionByRange(max(1, manifest.count()), "part", "seq").select("path", "base").mapInPandas(run, schema))


def lookup(manifest: DataFrame, keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id and ids of the asked documents: a search in the files' ranges (one row a file) tells which files may hold a
    key, and each file is opened once a task."""
    files = manifest.select("part", "seq", "path", F.coalesce("first_id", F.lit(-(1 << 63))).alias("first"), F.coalesce("last_id", F.lit(-(1 << 63))).alias("last")).orderBy("part", "seq").toPandas()
    paths, firsts, lasts = files["path"].tolist(), files["first"].to_numpy("int64"), files["last"].to_numpy("int64")

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = batch["doc_id"].to_numpy("int64")
            spans = zip(keys.tolist(), lasts.searchsorted(keys, "left").tolist(), firsts.searchsorted(keys, "right").tolist())
            yield pd.DataFrame([(k, i) for k, a, b in spans for i in range(a, b)], columns=["doc_id", "file"], dtype="int64")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, part in batch.groupby("file"):
                store, at = open_store(paths[i])
                with store.open_input_file(at) as source:
                    reader = TableReader(source)
                    rows = [(int(k), ids) for k in part["doc_id"] for ids in reader.get(int(k))]
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "ids"])

    asked = keys.select(F.col(id_col).cast("long").alias("doc_id")).dropna().distinct()
    paired = asked.mapInPandas(dealt, "doc_id long, file int")
    return paired.repartition(max(1, len(paths)), "file").sortWithinPartitions("file", "doc_id").mapInPandas(run, "doc_id long, ids binary")


def op3_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    out_dir = fresh_dir(spark, "sst")
    manifest = write_tables(table(spark, sf_dir, "documents"), out_dir, public_tokenizers.path(TOKENIZER))
    return read_tables(manifest, keep_ids=False)
