"""Quality by importance resampling: hashed n-gram models of target and raw text, and Gumbel top-k on their ratio."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skygraph.llm.common import Scratch, WordIds, bounded_batches, map_slices, texts, words_of

BUCKETS = 10_000
#: Letters, digits, control and non-ASCII characters separate runs of marks.
MARK_BYTES = bytes(32 if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 or b < 32 else b for b in range(256))


def hashed(text: str, ids: WordIds) -> np.ndarray:
    """Buckets of a text's words and runs of marks, and of pairs of either that follow each other."""
    out = []
    for stream in (words_of(text), text.encode("utf-8", "replace").translate(MARK_BYTES).split()):
        x = ids.array(stream)
        out += [x >> np.uint64(5), (x[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ x[1:]) >> np.uint64(7)]
    return (np.concatenate(out) % np.uint64(BUCKETS)).astype(np.int64)


def bucket_counts(rows: DataFrame) -> DataFrame:
    """n-grams by bucket of all rows (``raw``), and of those flagged ``target``, over whole texts; each task adds up its own before the shuffle."""

    def run(batches):
        ids, held = WordIds(), np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in batches:
            for is_target, x in zip(batch.column("target").to_pylist(), texts(batch)):
                got = np.bincount(hashed(x, ids), minlength=BUCKETS)
                held[1] += got
                if is_target:
                    held[0] += got
        for k in (0, 1):
            at = np.flatnonzero(held[k])
            yield pa.RecordBatch.from_pydict({"raw": [bool(k)] * len(at), "bucket": at, "n": held[k][at]}, schema=pa.schema([("raw", pa.bool_()), ("bucket", pa.int64()), ("n", pa.int64())]))

    bounded_batches(rows.sparkSession)
    return rows.mapInArrow(run, "raw boolean, bucket bigint, n bigint").groupBy("raw", "bucket").agg(F.sum("n").alias("n"))


def log_ratio(counts: DataFrame, smooth: float = 1.0) -> np.ndarray:
    """log p_target - log p_raw by bucket; at most 2 * BUCKETS rows come to the driver. All 0 without target text."""
    n = np.full((2, BUCKETS), smooth)
    for r in counts.collect():
        n[int(r.raw), r.bucket] += r.n
    if n[0].sum() == smooth * BUCKETS:
        return np.zeros(BUCKETS)
    return np.log(n[0] / n[0].sum()) - np.log(n[1] / n[1].sum())


def gumbel(key: Column, seed: int) -> Column:
    """Standard Gumbel noise from a hash of the key."""
    u = (F.pmod(F.xxhash64(key.cast("string"), F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


def score(docs: DataFrame, ratio: np.ndarray, *, seed: int = 17, temperature: float = 1.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_grams, log_weight (mean log ratio of its n-grams), perturbed (log weight of the whole text by temperature, plus Gumbel noise)."""
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def make():
        ids, r = WordIds(), shared.value

        def apply(batch):
            n, total = [], []
            for x in texts(batch):
                at = hashed(x, ids)
                n.append(len(at))
                total.append(float(r[at].sum()))
            return {"doc_id": batch.column("doc_id"), "n_grams": n, "total": total}

        return apply

    found = map_slices(rows, make, "doc_id bigint, n_grams bigint, total double")
    return found.select("doc_id", "n_grams", F.coalesce(F.try_divide(F.col("total"), F.col("n_grams")), F.lit(0.0)).alias("log_weight"), (F.col("total") / temperature + gumbel(F.col("doc_id"), seed)).alias("perturbed"))


def _halves(c: Column) -> list[Column]:
    """A bigint as two numbers that order alike and are exact as doubles."""
    return [F.shiftright(c, 32).cast("double"), c.bitwiseAND(F.lit((1 << 32) - 1)).cast("double")]


def top_k(scored: DataFrame, k: int, order: str = "perturbed", key: str = "doc_id", bins: int = 4096) -> DataFrame:
    """Add ``selected``: exactly the k rows with the largest values, ties by the smaller key, then by the row's place in the written table.

    Counts in ever finer bins find the value at which the k-th row stands, so that no row moves: each pass brings at most
    ``bins`` counts to the driver. Where more rows tie there than are wanted, the same search cuts them by key, and
    rows that repeat a key by their place. Rows without a value are never selected; fewer than k rows are all selected.
    """
    if k <= 0:
        return scored.withColumn("selected", F.lit(False))
    # places are only steady in a written table
    rows = Scratch(scored.sparkSession).save(scored.withColumn("_place", F.monotonically_increasing_id()))

    def cut(rows: DataFrame, c: Column, need: int) -> tuple[float | None, int, int]:
        """The largest v with at least ``need`` rows of c >= v (the least value if there are fewer), how many are above it, and how many are at it."""
        lo, hi, n = rows.agg(F.min(c), F.max(c), F.count(c)).first()
        above = 0
        if lo is None or n <= need:
            return lo, 0, n
        while lo < hi:
            width = (hi - lo) / bins
            if lo + width == lo or hi - width == hi:
                b = c
            else:
                b = F.least(F.floor((c - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))
            held = rows.where(c.between(lo, hi)).groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("count"), F.min(c).alias("lo"), F.max(c).alias("hi")).collect()
            for r in sorted(held, key=lambda r: -r.lo):
                if above + r["count"] >= need:
                    lo, hi, n = r.lo, r.hi, r["count"]
                    break
                above += r["count"]
        return lo, above, n

    def chosen(rows: DataFrame, columns: list[Column], need: int) -> Column:
        c = columns[0]
        at, above, tied = cut(rows, c, need)
        if at is None:
            return F.lit(False)
        if above + tied <= need or len(columns) == 1:
            return c >= F.lit(at)
        return (c > F.lit(at)) | ((c == F.lit(at)) & chosen(rows.where(c == F.lit(at)), columns[1:], need - above))

    by = [F.col(order), *[-x for x in _halves(F.col(key))], *[-x for x in _halves(F.col("_place"))]]
    return rows.withColumn("selected", F.coalesce(chosen(rows.where(F.col(order).isNotNull()), by, k), F.lit(False))).drop("_place")


def resample(docs: DataFrame, labels: DataFrame, *, share: float | None = None, seed: int = 17, temperature: float = 1.0, most_target: int = 20_000, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Per row: key, n_grams, log_weight, perturbed, selected.

    Target text is what ``labels`` marks 1: at most ``most_target`` keys, those first in the order of a hash, so that the keys
    can be broadcast and no text is shuffled. Raw text is all documents. The ``share`` of rows selected is that of
    target rows among labelled ones where none is given (0.5 without labels); exactly that many rows are. Null and empty texts
    have weight 0; whole texts count; ties go to the smaller key; a key labelled twice is target if one of its labels is;
    repeated rows each keep their row and share their noise, and are told apart by their place where only some can be selected; rows with
    a null key have null noise and are never selected; other columns are ignored; an empty table gives an empty one.
    """
    told = labels.select(F.col(key).cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("good")).dropna().groupBy("doc_id").agg(F.max("good").alias("good"))
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    target = told.where("good = 1").orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(most_target).select("doc_id", F.lit(True).alias("target"))
    ratio = log_ratio(bucket_counts(rows.join(F.broadcast(target), "doc_id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))))
    if share is None:
        share = told.agg(F.avg("good")).first()[0]
        share = 0.5 if share is None else share
    return top_k(score(docs, ratio, seed=seed, temperature=temperature, key=key, text=text), round(rows.count() * share))
