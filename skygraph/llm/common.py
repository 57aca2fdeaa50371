"""What the text operators share: tables, row sampling, Arrow slices, words and written intermediates."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: ASCII letters and digits (upper case made lower) and every byte of a non-ASCII character are kept, all else separates words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def bounded_batches(spark: SparkSession, size: str = "4m") -> None:
    """Arrow batches of at most ``size``: texts of any length come to Python a few megabytes at a time, whatever the session's number of rows a batch.

    Parquet is decoded 512 rows at a time: 4,096 texts, the default, are one array of 16 MB or more in each task.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", 512)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder_of(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo; -1 for a null key."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(modulus)).cast("int"), F.lit(-1))


def words_of(text: str) -> list[bytes]:
    """Lower-cased runs of letters, digits and non-ASCII characters, as UTF-8."""
    return text.lower().encode("utf-8", "replace").translate(WORD_BYTES).split()


class WordIds(dict):
    """Word -> 64-bit id, the same in every process. Holds at most ``most`` words at a time."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; maps equal values to equal values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def gram_ids(ids: np.ndarray, n: int) -> np.ndarray:
    """Rolling hash of each n consecutive word ids."""
    if len(ids) < n:
        return np.zeros(0, dtype=np.uint64)
    out = ids[: len(ids) - n + 1].astype(np.uint64, copy=True)
    for k in range(1, n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(ids) - n + 1 + k]
    return mix(out)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 2_000_000, most_rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch, balanced by the bytes of one text column; a longer text stands alone."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, b in enumerate(size.tolist()):
        if i > start and (held + b > most_bytes or i - start >= most_rows):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += b
    if start < len(size):
        yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, '' for null."""
    return [x or "" for x in batch.column(column).to_pylist()]


def give_back() -> None:
    """What a task has freed goes back to the system: a worker lives on, beside those of other stages, and would keep it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_slices(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str | StructType, column: str = "text", **limits) -> DataFrame:
    """Apply to each slice the function that ``make()`` returns once a task; it gives a dict of columns."""
    bounded_batches(df.sparkSession)
    fields = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def run(batches):
        apply = make()
        for batch in batches:
            for part in slices(batch, column, **limits):
                columns = apply(part)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, type=f.type) for f in arrow for x in [columns[f.name]]], schema=arrow)
        del apply
        give_back()

    return df.mapInArrow(run, fields)


def sample_documents(docs: DataFrame, most: int, key: Column, most_bytes: int = 32_768) -> DataFrame:
    """At most ``most`` rows in the order of a hash of the key, of texts no longer than ``most_bytes``; for training only."""
    return docs.where(F.octet_length("text").between(1, most_bytes)).withColumn("_order", F.xxhash64(key.cast("string"))).orderBy("_order", key).limit(most).drop("_order")


class KeyFilter:
    """A set of 64-bit keys as bits, 4 MB whatever its size: it may hold more than the keys, and never fewer."""

    BITS = 1 << 25
    CHUNK = 1 << 16

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @classmethod
    def of(cls, keys: DataFrame) -> KeyFilter:
        """Of a table with one bigint column. Tasks make chunks of bits, these are or-ed by chunk, and 64 chunks come to the driver."""
        bounded_batches(keys.sparkSession)
        size, chunk = cls.BITS // 8, cls.CHUNK

        def run(batches):
            bits = np.zeros(size, dtype=np.uint8)
            for batch in batches:
                x = mix(batch.column(0).drop_null().to_numpy(zero_copy_only=False).view(np.uint64))
                np.bitwise_or.at(bits, (x >> np.uint64(42)).astype(np.int64), (1 << (x >> np.uint64(39) & np.uint64(7)).astype(np.int64)).astype(np.uint8))
            at = [i for i in range(size // chunk) if bits[i * chunk : (i + 1) * chunk].any()]
            yield pa.RecordBatch.from_pydict({"chunk": at, "bits": [bits[i * chunk : (i + 1) * chunk].tobytes() for i in at]}, schema=pa.schema([("chunk", pa.int32()), ("bits", pa.binary())]))

        def merge(batches):
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for i, b in zip(batch.column("chunk").to_pylist(), batch.column("bits").to_pylist()):
                    own = np.frombuffer(b, dtype=np.uint8)
                    held[i] = held[i] | own if i in held else own
            yield pa.RecordBatch.from_pydict({"chunk": list(held), "bits": [b.tobytes() for b in held.values()]}, schema=pa.schema([("chunk", pa.int32()), ("bits", pa.binary())]))

        out = np.zeros(size, dtype=np.uint8)
        for r in keys.mapInArrow(run, "chunk int, bits binary").repartition("chunk").mapInArrow(merge, "chunk int, bits binary").collect():
            out[r.chunk * chunk : (r.chunk + 1) * chunk] = np.frombuffer(r.bits, dtype=np.uint8)
        return cls(out)

    def has(self, keys: np.ndarray) -> np.ndarray:
        x = mix(keys.view(np.uint64))
        return (self.bits[(x >> np.uint64(42)).astype(np.int64)] >> (x >> np.uint64(39) & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

    def among(self, spark: SparkSession, column: str) -> Column:
        """Whether a bigint column may be among the keys; null never is. Only the column goes to Python.

        Declared nondeterministic, or Spark infers the same test for the other side of a join by the column, where all
        rows pass it: a second Python worker in each task that has one already.
        """
        shared = spark.sparkContext.broadcast(self)

        @F.pandas_udf("boolean")
        def there(keys: pd.Series) -> pd.Series:
            return pd.Series(shared.value.has(keys.to_numpy(dtype=np.int64)))

        return F.col(column).isNotNull() & there.asNondeterministic()(F.coalesce(column, F.lit(0)))


def without(docs: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    """The rows of ``docs`` that agree with none of ``gone`` in the columns ``on``, the last of them a bigint; nulls agree with nulls but for that one.

    Only rows that may be among those gone, by a filter of the last column, are shuffled.
    """
    column = on[-1]
    marked = docs.withColumn("_maybe", KeyFilter.of(gone.select(column)).among(docs.sparkSession, column))
    there = gone.select(*[F.col(c).alias(f"_gone_{c}") for c in on]).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"_gone_{c}")) for c in on[:-1]] + [F.col(column) == F.col(f"_gone_{column}")]
    return marked.where("not _maybe").unionByName(marked.where("_maybe").join(there, same, "left_anti")).drop("_maybe")


class Scratch:
    """Written tables in the folder that the session names in ``spark.checkpoint.dir``; where none is named, in the warehouse, which executors share too."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        bounded_batches(spark)
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
            root = held.get() if held.isDefined() else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_skygraph"
        self.root = f"{root.rstrip('/')}/tables"

    def save(self, df: DataFrame) -> DataFrame:
        """Write and reread: what follows doesn't depend on the executors that made it."""
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for df in frames:
            if path := getattr(df, "_scratch_path", None):
                jvm = self.spark._jvm
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
