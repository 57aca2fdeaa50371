"""Benchmark decontamination: greedy string tiling on shared-token seeds, thresholded on how much of a test is covered."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygraph.llm.common import KeyFilter, WordIds, gram_ids, slices, texts, words_of

#: Benchmark seeds that may be broadcast; beyond, both sides are shuffled by seed.
MOST_BROADCAST_SEEDS = 400_000


def seeds(rows: DataFrame, k: int, keep=None, sizes: list[int] | None = None) -> DataFrame:
    """(id, th, seed, at, n_words): the Karp-Rabin hash of each k consecutive words, where it begins, and the row's words.

    ``rows``: id, th (a hash of the text, which tells rows of one key apart) and text. Rows with fewer than k words have one
    seed, of all of them. Where ``sizes`` are given, seeds have each of these numbers of words instead, and only those
    that pass the filter ``keep`` (a broadcast) come out.
    """
    schema = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("seed", pa.int64()), ("at", pa.int32()), ("n_words", pa.int32())])

    def run(batches):
        ids = WordIds()
        for batch in batches:
            for part in slices(batch, "text"):
                rows, out = [], [[], [], []]
                for row, x in enumerate(texts(part)):
                    words = words_of(x)
                    if not words:
                        continue
                    own = ids.array(words)
                    for size in [min(k, len(words))] if sizes is None else sizes:
                        h = gram_ids(own, size).view(np.int64)
                        at = np.arange(len(h)) if keep is None else np.flatnonzero(keep.value.has(h))
                        if len(at):
                            rows.append(np.full(len(at), row))
                            for column, values in zip(out, (h[at], at, np.full(len(at), len(words)))):
                                column.append(values)
                if rows:
                    of = pa.array(np.concatenate(rows))
                    yield pa.RecordBatch.from_arrays([part.column("id").take(of), part.column("th").take(of), *(pa.array(np.concatenate(c), type=f.type) for c, f in zip(out, list(schema)[2:]))], schema=schema)

    return rows.mapInArrow(run, "id bigint, th bigint, seed bigint, at int, n_words int")


def tile(at: np.ndarray, item_at: np.ndarray, k: int, n_item: int) -> int:
    """Words of the item covered by greedy tiles.

    ``at``, ``item_at``: places in document and item of each seed of k words that they share. Seeds on a diagonal, one
    after another, are one match; the longest unmarked match is marked in both, again and again, until
    none of k words is left.
    """
    k = min(k, n_item)
    pairs = np.unique(np.stack([item_at.astype(np.int64) - at, at]), axis=1)
    p, q = pairs[1], pairs[0] + pairs[1]
    doc, item = np.zeros(int(p.max(initial=0)) + k, dtype=bool), np.zeros(n_item, dtype=bool)
    while len(p):
        start = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1] + 1) | (q[1:] != q[:-1] + 1)]))
        length = np.diff(np.append(start, len(p)))
        size = int(length.max()) + k - 1
        first = start[length == length.max()]
        for i in first[np.lexsort((q[first], p[first]))].tolist():
            d, t = slice(p[i], p[i] + size), slice(q[i], q[i] + size)
            if not doc[d].any() and not item[t].any():
                doc[d] = item[t] = True
        # what is left: seeds of which no word is marked on either side
        marked_doc, marked_item = (np.concatenate([[0], np.cumsum(x)]) for x in (doc, item))
        free = (marked_doc[p + k] == marked_doc[p]) & (marked_item[q + k] == marked_item[q])
        p, q = p[free], q[free]
    return int(item.sum())


def shared_places(at: np.ndarray, seed: np.ndarray, item_at: np.ndarray, item_seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each place in the document with each place in the item of the same seed."""
    order = np.argsort(item_seed, kind="stable")
    low, high = (np.searchsorted(item_seed[order], seed, side=x) for x in ("left", "right"))
    n = high - low
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(at, n), item_at[order][np.repeat(low, n) + within]


def coverage(docs: DataFrame, benchmark: DataFrame, *, k: int = 4, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """(doc_id, text_hash, item_id, covered, n_item) of each text and test that share k consecutive words (or all of a shorter test).

    Words are lower-cased runs of letters, digits and non-ASCII characters. Null and empty texts and tests share nothing; rows
    of one key and different texts are tiled each by itself, as are tests of one key; rows that repeat key and text are tiled once;
    a null document key is one like any other, tests without a key are left out; whole texts of any length count, other columns
    are ignored; empty tables give an empty one.
    """
    spark = docs.sparkSession
    told = lambda df, c: df.select(F.col(c).cast("bigint").alias("id"), F.xxhash64(F.col(text if c == key else "text").cast("string")).alias("th"), F.col(text if c == key else "text").cast("string").alias("text")).where("text is not null")
    tests = seeds(told(benchmark, item).where("id is not null").distinct(), k)
    tests = tests.select(F.col("id").alias("item_id"), F.col("th").alias("item_th"), "seed", F.col("at").alias("item_at"), F.col("n_words").alias("n_item"))
    few = tests.count() <= MOST_BROADCAST_SEEDS
    bounded = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    sizes = sorted(r[0] for r in tests.select(F.least(F.lit(k), "n_item")).distinct().collect())  # at most k of them
    shared = spark.sparkContext.broadcast(KeyFilter.of(tests.select("seed")))
    hits = seeds(told(docs, key), k, shared, sizes).select(F.col("id").alias("doc_id"), F.col("th").alias("text_hash"), "seed", "at")
    # a text's hits are gathered for each test, and the test's own seeds once: not the pairs of both
    both = hits.join(bounded(tests.select("seed", "item_id", "item_th").distinct()), "seed")
    grouped = both.groupBy("doc_id", "text_hash", "item_id", "item_th").agg(F.collect_set(F.struct("at", "seed")).alias("hits"))
    whole = tests.groupBy("item_id", "item_th").agg(F.first("n_item").alias("n_item"), F.collect_list(F.struct("item_at", "seed")).alias("own"))
    rows = grouped.join(bounded(whole), ["item_id", "item_th"]).select("doc_id", "text_hash", "item_id", "n_item", F.col("hits.at").alias("at"), F.col("hits.seed").alias("seed"), F.col("own.item_at").alias("item_at"), F.col("own.seed").alias("item_seed"))

    def covered(batches):
        for batch in batches:
            n = batch.column("n_item").to_pylist()
            places = (tuple(x.values.to_numpy() for x in row) for row in zip(*(batch.column(c) for c in ("at", "seed", "item_at", "item_seed"))))
            got = [tile(*shared_places(*row), k, m) for row, m in zip(places, n)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "text_hash", "item_id")), pa.array(got, type=pa.int32()), batch.column("n_item")], names=["doc_id", "text_hash", "item_id", "covered", "n_item"])

    return rows.mapInArrow(covered, "doc_id bigint, text_hash bigint, item_id bigint, covered int, n_item int")


def contaminated(docs: DataFrame, benchmark: DataFrame, *, k: int = 4, threshold: float = 0.5, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """Per text of which tiles cover at least ``threshold`` of a test: doc_id, text_hash, coverage (largest), item_ids (sorted).

    Rows of one key and different texts are told apart by ``text_hash``, Spark's xxhash64 of the text.
    """
    share = F.col("covered") / F.col("n_item")
    return coverage(docs, benchmark, k=k, key=key, text=text, item=item).where(share >= threshold).groupBy("doc_id", "text_hash").agg(F.max(share).alias("coverage"), F.array_sort(F.collect_set("item_id")).alias("item_ids"))
