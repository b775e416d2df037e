"""Token ids in binary files of patched frame-of-reference blocks.

A file holds whole documents in order. Its ids are cut into blocks of equal length (the last one may be shorter). A block
keeps the least id and packs what lies above it at the width that a percentile of the ids needs; ids that need more bits keep
their low bits there, and their places and high bits follow in an exception list. The foot of the file lists where each block
starts, and the ids, ends and nulls of its documents, so a document is read from the few blocks that hold it.

    file   MAGIC, blocks, foot, 40 bytes: block length, blocks, documents, ids, length of the foot, crc32 of the foot (QQQQII)
    block  ids, least, width, exceptions, high width (IIBIB); packed low bits; places (I); packed high bits
    foot   starts of blocks (q), ends of documents (q), document ids (q), null marks (B)

Numbers are little-endian, packed bits fill bytes from the lowest bit up.

Documents are sorted by range, so each task writes the files of one range of ids, a new file when one is full. Files have names
of their own for each attempt and are listed by a stored table that only finished tasks enter, so a lost executor leaves an
unlisted file at most. The folder must be of a kind that pyarrow opens (local or mounted, HDFS, object stores).
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aligngrid.llm import tokens
from aligngrid.llm.common import blocks, python_map, store, table
from aligngrid.session import new_path

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: The id after each document.
END = 0
#: Ids of a block, share of ids that the packed width holds, ids after which a file is closed, bytes of text encoded at once.
BLOCK, PERCENTILE, FILE, TEXT = 8192, 0.98, 1 << 23, 2 << 20
MAGIC = b"PFORIDS1"
_HEAD, _TAIL = struct.Struct("<IIBIB"), struct.Struct("<QQQQII")


def _packed(values: np.ndarray, width: int) -> bytes:
    """The lowest `width` bits of each value in a row."""
    bits = np.unpackbits(values.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(bits[:, :width], bitorder="little").tobytes()


def _unpacked(data: bytes, n: int, width: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    full = np.zeros((n, 32), np.uint8)
    full[:, :width] = bits
    return np.packbits(full, axis=1, bitorder="little").view("<u4").ravel()


def packed_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """A block of at least one id below 2^32."""
    least = int(ids.min())
    above = (ids.astype(np.int64) - least).astype(np.uint32)
    need = np.frexp(above.astype(np.float64))[1]  # bits of each value
    width = int(np.sort(need)[min(int(np.ceil(percentile * len(ids))), len(ids)) - 1])
    places = np.flatnonzero(need > width)
    high = above[places] >> np.uint32(width)
    wide = int(need.max()) - width if len(places) else 0
    return b"".join([_HEAD.pack(len(ids), least, width, len(places), wide), _packed(above, width),
                     places.astype("<u4").tobytes(), _packed(high, wide)])


def unpacked_block(data: bytes) -> np.ndarray:
    n, least, width, some, wide = _HEAD.unpack_from(data)
    at = _HEAD.size
    size = (n * width + 7) // 8
    above = _unpacked(data[at:at + size], n, width)
    if some:
        places = np.frombuffer(data, "<u4", some, at + size)
        above[places] |= _unpacked(data[at + size + 4 * some:], some, wide) << np.uint32(width)
    return above + np.uint32(least)


class Writer:
    """One file; documents are added in order, ids are written block by block."""

    def __init__(self, out, block: int = BLOCK, percentile: float = PERCENTILE):
        self.out, self.block, self.percentile = out, block, percentile
        self.at, self.n, self.crc = len(MAGIC), 0, 0
        self.rest = np.zeros(0, np.uint32)
        self.starts, self.ends, self.docs, self.nulls = [], [], [], bytearray()
        out.write(MAGIC)

    def _flush(self, last: bool = False) -> None:
        stop = len(self.rest) if last else len(self.rest) // self.block * self.block
        for a in range(0, stop, self.block):
            data = packed_block(self.rest[a:min(a + self.block, stop)], self.percentile)
            self.starts.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.rest = self.rest[stop:]

    def add(self, ids: np.ndarray, counts: list[int], docs: list[int | None]) -> None:
        """Documents with all their ids in a row; the id of a document may be null."""
        self.ends += (self.n + np.cumsum(counts)).tolist()
        self.docs += [d or 0 for d in docs]
        self.nulls += bytes(d is None for d in docs)
        self.n += len(ids)
        self.rest = np.concatenate([self.rest, ids.astype(np.uint32)])
        self._flush()

    def close(self) -> None:
        self._flush(last=True)
        foot = b"".join([np.array(x, "<i8").tobytes() for x in (self.starts, self.ends, self.docs)] + [bytes(self.nulls)])
        self.out.write(foot + _TAIL.pack(self.block, len(self.starts), len(self.docs), self.n, len(foot), zlib.crc32(foot)))
        self.out.close()


class Reader:
    """A file opened for reading: the foot is read at once, blocks when they are asked for."""

    def __init__(self, source):
        self.source, size = source, source.size()
        source.seek(size - _TAIL.size)
        self.block, n_blocks, n_docs, self.n, length, crc = _TAIL.unpack(source.read(_TAIL.size))
        source.seek(size - _TAIL.size - length)
        foot = source.read(length)
        source.seek(0)
        if source.read(len(MAGIC)) != MAGIC or zlib.crc32(foot) != crc:
            raise ValueError("not a whole file of token ids")
        self.starts = np.append(np.frombuffer(foot, "<i8", n_blocks), size - _TAIL.size - length)
        self.ends = np.frombuffer(foot, "<i8", n_docs, 8 * n_blocks)
        docs = np.frombuffer(foot, "<i8", n_docs, 8 * (n_blocks + n_docs))
        self.docs = [None if null else d for d, null in zip(docs.tolist(), foot[8 * (n_blocks + 2 * n_docs):])]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from `start` up to `stop` of the file."""
        if start >= stop:
            return np.zeros(0, np.uint32)
        a, b = start // self.block, (stop - 1) // self.block + 1
        self.source.seek(int(self.starts[a]))
        data = self.source.read(int(self.starts[b] - self.starts[a]))
        cut = (self.starts[a:b + 1] - self.starts[a]).tolist()
        flat = np.concatenate([unpacked_block(data[x:y]) for x, y in zip(cut, cut[1:])])
        return flat[start - a * self.block:stop - a * self.block]

    def documents(self, ids: int = 1 << 20) -> Iterator[tuple[int, int, list[np.ndarray]]]:
        """(first document, its start, ids of each) for documents of about `ids` ids together, or one longer one."""
        a, start = 0, 0
        while a < len(self.ends):
            b = max(int(np.searchsorted(self.ends, start + ids, side="right")), a + 1)
            flat = self.ids(start, int(self.ends[b - 1]))
            yield a, start, np.split(flat, self.ends[a:b - 1] - start)
            a, start = b, int(self.ends[b - 1])


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def write_files(df: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", *, tokenizer: str = TOKENIZER,
                special: bool = True, end: int = END, block: int = BLOCK, percentile: float = PERCENTILE,
                file_ids: int = FILE) -> DataFrame:
    """Writes the ids of all texts, each followed by `end`, in ascending order of `id_col`; returns the table of files.

    Result: (task, number, path, n_docs, n_ids), files in the order of (task, number). Null ids come first, rows of one id are
    ordered by their text; a null or empty text has the end alone; a row is written as often as it is there. A file is
    closed after `file_ids` ids, a longer document is whole in its file. Further columns play no part. An empty table gives
    no file. special: whether the strings of special tokens in a text count as these tokens, as the library does by default.
    """
    spec = tokens.read(tokenizer)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # The part of the texts that orders equal ids is a number, so that the sample that finds the ranges holds no texts.
    sorted_ = own.repartitionByRange(parts, "id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder((spec,), special)
        task, run_id = TaskContext.get().partitionId(), uuid.uuid4().hex
        where, folder = _place(path)
        where.create_dir(folder, recursive=True)
        writer, name, done = None, "", []

        def closed():
            writer.close()
            done.append((task, len(done), f"{path}/{name}", len(writer.docs), writer.n))

        for batch in blocks(batches, "text", TEXT):
            (flat, counts), = encoder.encode(batch.column(1).to_pylist())
            ends = np.cumsum(counts)
            flat = np.insert(flat.astype(np.int64), ends, end)  # ids after each document
            ends += np.arange(1, len(ends) + 1)
            docs, a, begin = batch.column(0).to_pylist(), 0, 0
            while a < len(docs):
                if writer is None:
                    name = f"ids-{task:06d}-{len(done):05d}-{run_id}.pfor"
                    writer = Writer(where.open_output_stream(f"{folder}/{name}"), block, percentile)
                b = min(int(np.searchsorted(ends, begin + file_ids - writer.n)) + 1, len(docs))
                writer.add(flat[begin:ends[b - 1]], np.diff(ends[a:b], prepend=begin).tolist(), docs[a:b])
                a, begin = b, int(ends[b - 1])
                if writer.n >= file_ids:
                    closed()
                    writer = None
        if writer is not None:
            closed()
        columns = list(zip(*done)) or [[]] * 5
        types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                         names=["task", "number", "path", "n_docs", "n_ids"])

    return store(python_map(sorted_, run, "task int, number int, path string, n_docs bigint, n_ids bigint"), "token-files")


def starts(files: DataFrame) -> DataFrame:
    """`files` with `start`, the ids of all files before: sums of tasks first, then within a task."""
    of_task = files.groupBy("task").agg(F.sum("n_ids").alias("n"))
    before = of_task.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("before"))
    inside = F.sum("n_ids").over(Window.partitionBy("task").orderBy("number")) - F.col("n_ids")
    return files.join(before, "task").withColumn("start", F.col("before") + inside).drop("before")


def read_files(files: DataFrame, *, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the files, in any order.

    start: ids of all documents before it; ids_crc32: of the ids as little-endian unsigned 32-bit numbers.
    """
    n_files = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                where, name = _place(path)
                with where.open_input_file(name) as source:
                    reader = Reader(source)
                    for first, at, ids in reader.documents():
                        counts = np.array([len(x) for x in ids], np.int64)
                        columns = [
                            pa.array(reader.docs[first:first + len(ids)], pa.int64()),
                            pa.array(start + at + np.cumsum(counts) - counts), pa.array(counts),
                            pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())]
                        if with_ids:
                            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                            columns.append(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids).astype(np.int64))))
                        yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" if with_ids else "")
    return python_map(starts(files).select("path", "start").repartition(n_files, "path"), run, schema)


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, number and checksum of the ids of every document, read back from the files."""
    files = write_files(table(spark, sf_dir, "documents").select("doc_id", "text"), new_path(spark, "ids"))
    return read_files(files, with_ids=False)


QUERIES = {"op12_token_files": op12_token_files}
