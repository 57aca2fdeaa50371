"""Token ids in files of 64-bit words: Simple-8b with selectors, an escape for wide values, and the offsets of blocks for vectorised decoding."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from skygraph.llm import token_ids
from skygraph.llm.common import Scratch, map_slices

# The number of values and the bits of each, by selector, the four highest bits of a word. Selector 1 is the escape: the next word is one value as it is.
COUNTS = (240, 1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (0, 64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 1
_ORDER = [s for s in range(16) if s != ESCAPE]
_LIMITS = np.array([(1 << BITS[s]) - 1 for s in _ORDER], dtype=np.uint64)
_COUNTS = np.array(COUNTS)

MAGIC = b"S8BTOKEN"
BLOCK = 16_384


def _widest(width: np.ndarray, n: int) -> dict[int, np.ndarray]:
    """For each count of values, the greatest width among so many from each of the first ``n`` places on; each from a window of half its size or more."""
    found = {1: width}
    for c in sorted({*COUNTS, 120}):
        if c > 1:
            half = max(x for x in found if 2 * x >= c and x < c)
            held = found[half]
            found[c] = np.maximum(held[: len(held) - (c - half)], held[c - half :])
    return {c: x[:n] for c, x in found.items()}


def encode(values: np.ndarray) -> np.ndarray:
    """Unsigned values as 64-bit words. Each word takes as many values as fit, so the last may hold fewer than its selector says."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    # the first selector, in order, whose bits hold a value; beyond the last: escape. What follows the end is as narrow as can be.
    width = np.zeros(n + 240, dtype=np.uint8)
    width[:n] = np.searchsorted(_LIMITS, values)
    widest = _widest(width, n)
    chosen = np.full(n, ESCAPE, dtype=np.uint8)
    for i in range(len(_ORDER) - 1, -1, -1):
        chosen[widest[COUNTS[_ORDER[i]]] <= i] = _ORDER[i]
    step, starts, i = _COUNTS[chosen].tolist(), [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    starts = np.array(starts)
    chosen = chosen[starts]
    place = np.cumsum(1 + (chosen == ESCAPE)) - 1 - (chosen == ESCAPE)
    out = np.zeros(place[-1] + 1 + (chosen[-1] == ESCAPE), dtype=np.uint64)
    padded = np.append(values, np.zeros(240, dtype=np.uint64))
    for s in np.unique(chosen).tolist():
        own = np.flatnonzero(chosen == s)
        words = np.full(len(own), s << 60, dtype=np.uint64)
        if s == ESCAPE:
            out[place[own] + 1] = values[starts[own]]
        elif BITS[s]:
            each = padded[starts[own][:, None] + np.arange(COUNTS[s])] << (np.arange(COUNTS[s], dtype=np.uint64) * np.uint64(BITS[s]))
            words |= np.bitwise_or.reduce(each, axis=1)
        out[place[own]] = words
    return out


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` values of words of ``encode``."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), dtype=bool)
    for i in np.flatnonzero(selector == ESCAPE).tolist():
        if not raw[i]:
            raw[i + 1] = True
    count = np.where(raw, 0, _COUNTS[selector])
    ends = np.cumsum(count)
    starts = ends - count
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint64)
    for s in np.unique(selector[~raw]).tolist():
        own = np.flatnonzero((selector == s) & ~raw)
        if s == ESCAPE:
            out[starts[own]] = words[own + 1]
        elif BITS[s]:
            each = words[own][:, None] >> (np.arange(COUNTS[s], dtype=np.uint64) * np.uint64(BITS[s])) & np.uint64((1 << BITS[s]) - 1)
            out[starts[own][:, None] + np.arange(COUNTS[s])] = each
    if len(out) < n:
        raise ValueError(f"{len(out)} values in words for {n}")
    return out[:n]


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system and the place in it of a path or URI."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return arrow_fs.FileSystem.from_uri(path)


@dataclass
class Part(WriterCommitMessage):
    """A file that a task has written."""

    partition: int
    name: str
    documents: int
    ids: int


@dataclass
class File(InputPartition):
    name: str
    start: int


class TokenFiles(DataSource):
    """``spark.write.format("simple8b")``: rows (doc_id bigint, ids binary of little-endian 32-bit unsigned ids) in the order of partitions and of rows within them;
    ``spark.read.format("simple8b")``: rows (doc_id, start, ids), start being the number of ids before the document's over all files.

    Each task writes a file of its own; an index of the files of tasks that succeeded is written last, and only files that stand in it are
    read, so retried or aborted tasks leave no row behind. Writing to a folder replaces its index.
    """

    @classmethod
    def name(cls) -> str:
        return "simple8b"

    def schema(self) -> str:
        return "doc_id bigint, start bigint, ids binary"

    def writer(self, schema, overwrite: bool) -> TokenWriter:
        return TokenWriter(self.options["path"])

    def reader(self, schema) -> TokenReader:
        return TokenReader(self.options["path"])


class TokenWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        context = TaskContext.get()
        partition = context.partitionId() if context else 0
        name, system, out = f"part-{partition:06d}-{uuid.uuid4().hex}.s8b", None, None
        held, n_held, words_at, total = [], 0, 0, 0
        blocks, keys, there, sizes = [], [], [], []

        def flush(last: bool):
            nonlocal held, n_held, words_at
            data = np.concatenate(held) if held else np.zeros(0, dtype="<u4")
            whole = len(data) if last else len(data) // BLOCK * BLOCK
            for i in range(0, whole, BLOCK):
                own = data[i : min(i + BLOCK, whole)]
                words = encode(own)
                out.write(words.astype("<u8").tobytes())
                blocks.append((words_at, len(own)))
                words_at += len(words)
            held = [data[whole:]]
            n_held = len(held[0])

        for batch in iterator:
            if not batch.num_rows:
                continue
            if out is None:
                system, place = opened(f"{self.path}/{name}")
                system.create_dir(place.rsplit("/", 1)[0], recursive=True)
                out = system.open_output_stream(place)
                out.write(MAGIC)
            for key, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                ids = np.frombuffer(ids.as_buffer(), dtype="<u4") if ids.is_valid else np.zeros(0, dtype="<u4")
                keys.append(key or 0)
                there.append(key is not None)
                sizes.append(len(ids))
                total += len(ids)
                for i in range(0, len(ids), 1 << 20):
                    # a copy: what it stands in is the batch
                    held.append(ids[i : i + (1 << 20)].copy())
                    n_held += len(held[-1])
                    if n_held >= 16 * BLOCK:
                        flush(last=False)
        if out is None:
            return Part(partition, "", 0, 0)
        flush(last=True)
        sized = encode(np.array(sizes, dtype=np.uint64)).astype("<u8")
        footer = b"".join([np.array(blocks, dtype="<i8").reshape(-1, 2).tobytes(), np.array(keys, dtype="<i8").tobytes(), np.array(there, dtype="u1").tobytes(), sized.tobytes()])
        out.write(footer)
        out.write(np.array([len(blocks), len(keys), len(sized), words_at], dtype="<i8").tobytes() + MAGIC)
        out.close()
        return Part(partition, name, len(keys), total)

    def commit(self, messages: list[Part | None]) -> None:
        system, place = opened(self.path)
        system.create_dir(place, recursive=True)
        files, start = [], 0
        for m in sorted((m for m in messages if m and m.name), key=lambda m: m.partition):
            files.append({"name": m.name, "start": start, "documents": m.documents, "ids": m.ids})
            start += m.ids
        with system.open_output_stream(f"{place}/_index.json") as f:
            f.write(json.dumps({"files": files, "ids": start}).encode())

    def abort(self, messages: list[Part | None]) -> None:
        system, place = opened(self.path)
        for m in messages:
            if m and m.name:
                system.delete_file(f"{place}/{m.name}")


class TokenReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def partitions(self) -> list[File]:
        system, place = opened(self.path)
        with system.open_input_stream(f"{place}/_index.json") as f:
            return [File(x["name"], x["start"]) for x in json.loads(f.read())["files"]] or [File("", 0)]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        system, place = opened(f"{self.path}/{partition.name}")
        with system.open_input_file(place) as f:
            size, tail = f.size(), 32 + len(MAGIC)
            last = f.read_at(tail, size - tail)
            n_blocks, n_docs, n_sized, n_words = np.frombuffer(last[:32], dtype="<i8").tolist()
            if last[32:] != MAGIC or f.read_at(len(MAGIC), 0) != MAGIC:
                raise ValueError(f"{place} is no file of token ids")
            footer = f.read_at(size - tail - len(MAGIC) - 8 * n_words, len(MAGIC) + 8 * n_words)
            blocks = np.frombuffer(footer[: 16 * n_blocks], dtype="<i8").reshape(-1, 2)
            at = 16 * n_blocks
            keys = np.frombuffer(footer[at : at + 8 * n_docs], dtype="<i8")
            there = np.frombuffer(footer[at + 8 * n_docs : at + 9 * n_docs], dtype="u1").astype(bool)
            sizes = decode(np.frombuffer(footer[at + 9 * n_docs :], dtype="<u8")[:n_sized], n_docs).astype(np.int64)
            ends = np.append(blocks[1:, 0], n_words)

            def ids() -> Iterator[np.ndarray]:
                for (first, n), end in zip(blocks.tolist(), ends.tolist()):
                    yield decode(np.frombuffer(f.read_at(8 * (end - first), len(MAGIC) + 8 * first), dtype="<u8"), n).astype("<u4")

            source, left, start = ids(), np.zeros(0, dtype="<u4"), partition.start
            rows: list[tuple] = []
            held = 0
            for key, known, n in zip(keys.tolist(), there.tolist(), sizes.tolist()):
                parts, need = [], n
                while need > len(left):
                    parts.append(left)
                    need -= len(left)
                    left = next(source)
                parts.append(left[:need])
                left = left[need:]
                rows.append((key if known else None, start, b"".join(p.tobytes() for p in parts)))
                start += n
                held += 4 * n
                if held >= 4_000_000 or len(rows) >= 4096:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "start", "ids"])


def encoded(docs: DataFrame, vocabulary: str, end_id: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) of each row, ``end_id`` after them."""
    end = end_id.to_bytes(4, "little") if end_id is not None else b""

    def make():
        encode_all = token_ids.encoder(vocabulary).encode
        return lambda batch: {"doc_id": batch.column("doc_id"), "ids": [x + end for x in encode_all(batch.column("text"))]}

    return map_slices(docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")), make, "doc_id bigint, ids binary", most_bytes=4_000_000, most_rows=8192)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of files written by ``write``."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format("simple8b").load(path)


def write(docs: DataFrame, path: str, *, vocabulary: str | None = None, end_id: int | None = 2, key: str = "doc_id", text: str = "text") -> None:
    """The ids of every text, with ``end_id`` after each, in files under ``path``, in ascending order of the key.

    Rows are dealt by ranges of the key (rows of one key by their text's hash), so no task orders more than its range; nulls come first.
    Null and empty texts are an end id alone; repeated rows and null keys each keep their row, rows of a key in the order of
    their text; texts of any length are encoded whole; other columns are ignored; an empty table gives an index without files.
    """
    docs.sparkSession.dataSource.register(TokenFiles)
    vocabulary = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    dealt = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    encoded(dealt, vocabulary, end_id).write.format("simple8b").mode("append").save(path)


def round_trip(docs: DataFrame, *, vocabulary: str | None = None, end_id: int | None = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, ids) as the files have them, in a new folder of the shared place."""
    scratch = Scratch(docs.sparkSession)
    path = f"{scratch.root}/{uuid.uuid4().hex}-ids"
    write(docs, path, vocabulary=vocabulary, end_id=end_id, key=key, text=text)
    return read(docs.sparkSession, path)
