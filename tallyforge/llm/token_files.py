"""Token-ID output: independent zstandard frames with a trailing seek table.

A file is a sequence of independent zstandard frames, an index frame, and a
skippable frame in the public zstd seekable layout: per frame the compressed
size, decompressed size and a checksum (low 32 bits of XXH64 of the decompressed
bytes), then the frame count, a descriptor byte and the magic number.  Any zstd
tool can decompress the whole file; a reader that knows the table fetches single
frames.  The last data frame is the index: first ordinal, count, smallest and
largest document id of every other frame.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

# Fixed values of the public zstd seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
HAS_CHECKSUMS = 0x80

NO_ID = -(2**63)
#: A frame holds about this many tokens, or one document of more; a reader of one document unpacks one frame.
FRAME_TOKENS = 1 << 12
#: A file takes about this many bytes of text, and on small inputs at least the second number of them.
FILE_BYTES, LEAST_BYTES = 128 << 20, 1 << 20
MANIFEST = "part long, path string, n_docs long, n_tokens long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


class Frame(NamedTuple):
    at: int
    packed: int
    unpacked: int
    checksum: int


class Document(NamedTuple):
    doc_id: int | None
    ids: np.ndarray


def _open_fs(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Writer:
    """Writes one file; documents must come in ascending id order (null first)."""

    def __init__(self, sink, frame_tokens: int = FRAME_TOKENS, level: int = 3):
        self.sink, self.frame_tokens = sink, frame_tokens
        self.zstd = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frames: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int, int]] = []
        self.docs: list[tuple[int, bytes]] = []
        self.held = self.n_docs = self.n_tokens = 0

    def _frame(self, data: bytes) -> None:
        packed = self.zstd.compress(data)
        self.sink.write(packed)
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def _flush(self) -> None:
        if not self.docs:
            return
        ids = np.frombuffer(b"".join(d for _, d in self.docs), dtype="<u4")
        narrow = not len(ids) or int(ids.max()) < 65536
        keys = np.array([k for k, _ in self.docs], dtype="<i8")
        lengths = np.array([len(d) // 4 for _, d in self.docs], dtype="<u4")
        self.index.append((self.n_docs - len(self.docs), len(self.docs), int(keys[0]), int(keys[-1])))
        self._frame(struct.pack("<II", len(keys), 2 if narrow else 4) + keys.tobytes() + lengths.tobytes() + (ids.astype("<u2") if narrow else ids).tobytes())
        self.docs, self.held = [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """``ids``: little-endian unsigned 32-bit integers.  A document that would overfill a frame begins the next one."""
        if self.docs and self.held + len(ids) // 4 > self.frame_tokens:
            self._flush()
        self.docs.append((NO_ID if doc_id is None else doc_id, ids))
        self.held += len(ids) // 4
        self.n_docs += 1
        self.n_tokens += len(ids) // 4
        if self.held >= self.frame_tokens or len(self.docs) >= self.frame_tokens:
            self._flush()

    def close(self) -> None:
        self._flush()
        self._frame(np.array(self.index, dtype="<i8").reshape(-1, 4).tobytes())
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), HAS_CHECKSUMS, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)


class Reader:
    """Random access to one file; decompresses only the frames asked for."""

    def __init__(self, source):
        self.source, self.unpacked_frames = source, 0
        size = source.size()
        n, descriptor, magic = struct.unpack("<IBI", self._bytes(size - 9, 9))
        if magic != SEEKABLE_MAGIC or not descriptor & HAS_CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        at, self.frames = 0, []
        for packed, unpacked, checksum in struct.iter_unpack("<III", self._bytes(size - 9 - 12 * n, 12 * n)):
            self.frames.append(Frame(at, packed, unpacked, checksum))
            at += packed
        self.index = np.frombuffer(self._frame(n - 1), dtype="<i8").reshape(-1, 4)

    def _bytes(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _frame(self, k: int) -> bytes:
        f = self.frames[k]
        data = zstandard.ZstdDecompressor().decompress(self._bytes(f.at, f.packed), max_output_size=max(1, f.unpacked))
        self.unpacked_frames += 1
        if len(data) != f.unpacked or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != f.checksum:
            raise ValueError(f"frame {k} is damaged")
        return data

    def _documents(self, k: int) -> Iterator[Document]:
        data = self._frame(k)
        n, width = struct.unpack_from("<II", data)
        keys = np.frombuffer(data, "<i8", n, 8)
        ends = np.cumsum(np.frombuffer(data, "<u4", n, 8 + 8 * n), dtype=np.int64)
        ids = np.frombuffer(data, f"<u{width}", offset=8 + 12 * n)
        begin = 0
        for key, end in zip(keys.tolist(), ends.tolist(), strict=True):
            yield Document(None if key == NO_ID else key, ids[begin:end].astype("<u4"))
            begin = end

    def __iter__(self) -> Iterator[Document]:
        for k in range(len(self.index)):
            yield from self._documents(k)

    def get(self, doc_ids) -> Iterator[Document]:
        """The documents with these ids, reading only frames whose id range holds one."""
        wanted = np.unique(np.array([NO_ID if x is None else x for x in doc_ids], dtype=np.int64))
        low, high = self.index[:, 2], self.index[:, 3]
        for k in np.flatnonzero(np.searchsorted(wanted, low) < np.searchsorted(wanted, high, side="right")).tolist():
            for d in self._documents(k):
                key = NO_ID if d.doc_id is None else d.doc_id
                if (i := np.searchsorted(wanted, key)) < len(wanted) and wanted[i] == key:
                    yield d


def open_reader(uri: str) -> Reader:
    fs, path = _open_fs(uri)
    return Reader(fs.open_input_file(path))


def files_for(n_bytes: int, spark_partitions: int) -> int:
    """How many files hold so many bytes of text: by size, and on small inputs enough to keep the session's tasks busy."""
    return max(1, -(-n_bytes // FILE_BYTES), min(spark_partitions, -(-n_bytes // LEAST_BYTES)))


def write_tokens(docs: DataFrame, out_uri: str, tokenizer_path: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", frame_tokens: int = FRAME_TOKENS) -> DataFrame:
    """Encodes whole texts and writes one file per range of ids; returns the manifest (``MANIFEST``).

    Files follow ascending ids, so file ``part`` holds no larger ids than ``part + 1``.
    Null text counts as empty; null ids come first; rows with equal ids are all
    kept, ordered by a hash of the text, and may lie in several files, as may equal
    rows.  An empty table gives no documents.  The number of files follows the bytes
    of text.  A retried task rewrites the same file by an atomic move.  Extra columns
    are not read.
    """
    text = common.text_of(text_col)
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length(text) + 1), F.lit(0))).first()[0]
    n = files_for(n_bytes, common.shuffle_partitions(docs.sparkSession))
    rows = docs.select(F.col(id_col).cast("long").alias("k"), text.alias("t"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("u"))

    def write(batches):
        part = TaskContext.get().partitionId()
        fs, folder = _open_fs(out_uri)
        fs.create_dir(folder, recursive=True)
        path = f"{folder}/part-{part:06d}.tok.zst"
        encode = common.word_ids(tokenizer_path)
        end = b"" if end_id is None else struct.pack("<I", end_id)
        temporary = f"{folder}/_{uuid.uuid4().hex}"
        with fs.open_output_stream(temporary) as sink:
            writer = Writer(sink, frame_tokens)
            for b in common.rows_of(batches, 1024):
                for key, ids in zip(b.column(0).to_pylist(), encode(b.column(1)), strict=True):
                    writer.add(key, ids.tobytes() + end)
            writer.close()
        fs.move(temporary, path)
        name = f"{out_uri.rstrip('/')}/part-{part:06d}.tok.zst"
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [name], "n_docs": [writer.n_docs], "n_tokens": [writer.n_tokens]}, schema=pa.schema([("part", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    written = rows.repartitionByRange(n, "k", "h", "u").sortWithinPartitions("k", "h", "u").select("k", "t").mapInArrow(write, MANIFEST)
    return common.materialise(written, "token-manifest")


def token_positions(manifest: DataFrame) -> DataFrame:
    """Reads every file back: per document its id, place in the whole sequence, count and CRC-32 of its ids.

    The manifest has one row a file, so the running sum of its counts is small; it
    goes into the readers with each file's name, and documents are not joined.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select("part", "path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))

    def read(batches):
        for b in batches:
            for uri, begin in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
                out = []
                for d in open_reader(uri):
                    out.append((d.doc_id, begin, len(d.ids), zlib.crc32(d.ids.tobytes())))
                    begin += len(d.ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 4)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return starts.repartition(max(1, starts.count()), "part").select("path", "start").mapInArrow(read, READ)
