"""Near-duplicates by BagMinHash: weighted-Jaccard signatures of word shingle multisets, bands, and a check of the overlap.

For each shingle and each dyadic range of its multiplicity, [0, 1), [1, 2), [2, 4), [4, 8), ..., a Poisson process with the
range's width as its rate gives points in ascending order, each for one of the signature's components. A range that the
multiplicity ends in is split down to whole steps: of its points, those above the multiplicity are passed over. A
component's value is the first point that reaches it, and names that point. A process ends once it is past the last
of its document's components, so most take a point or two, and two components agree with a probability equal to
sum(min) / sum(max) of the multiplicities.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygraph.llm.common import KeyFilter, Scratch, WordIds, give_back, gram_ids, map_slices, mix, slices, texts
from skygraph.llm.components import components, merged

WORDS = 5
BANDS, ROWS = 24, 6
SIZE = BANDS * ROWS
#: Pairs of one text that are checked in one place; those beyond go to further places.
HUB = 400
STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str, ids: WordIds) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Distinct hashes of 5 consecutive words (of all words, if fewer), how often each stands there, and the words.

    Words are lower-cased and separated by white space.
    """
    words = text.lower().encode("utf-8", "replace").split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), words
    g, n = np.unique(gram_ids(ids.array(words), min(WORDS, len(words))), return_counts=True)
    return g, n, words


def signatures(grams: list[np.ndarray], counts: list[np.ndarray], size: int = SIZE) -> np.ndarray:
    """BagMinHash of each multiset: [documents, size] of 32-bit names, all 0 for an empty one."""
    doc = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    g = np.concatenate([*grams, np.zeros(0, np.uint64)]).astype(np.uint64)
    w = np.concatenate([*counts, np.zeros(0, np.int64)]).astype(np.int64)
    # a row for each element and range: the range begins at ``low`` and is as wide, but for the first
    rows = [(np.arange(len(g)), np.zeros(len(g), np.int64), np.ones(len(g), np.int64))]
    low = 1
    while len(at := np.flatnonzero(w > low)):
        rows.append((at, np.full(len(at), low), np.full(len(at), low)))
        low *= 2
    at, low, width = (np.concatenate(x) for x in zip(*rows))
    doc, seed, most = doc[at], mix(g[at] + low.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), w[at]
    value, name = np.full(len(grams) * size, np.inf), np.zeros(len(grams) * size, dtype=np.uint32)
    x, last = np.zeros(len(at)), np.full(len(grams), np.inf)
    while len(doc):
        seed = seed + STEP
        h = mix(seed)
        x = x - np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width
        live = x <= last[doc]
        doc, seed, x, low, width, most, h = (v[live] for v in (doc, seed, x, low, width, most, h))
        h = mix(h ^ np.uint64(0xA0761D6478BD642F))
        inside = low + ((h >> np.uint64(40)).astype(np.int64) & (width - 1)) < most
        cell = doc * size + (h & np.uint64(0xFFFF)).astype(np.int64) % size
        better = inside & (x < value[cell])
        at = np.flatnonzero(better)
        at = at[np.argsort(-x[at], kind="stable")]
        value[cell[at]] = x[at]
        name[cell[at]] = (h[at] >> np.uint64(16)).astype(np.uint32)
        touched = np.unique(doc[at])
        last[touched] = value.reshape(-1, size)[touched].max(axis=1)
    return name.reshape(-1, size)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    parts = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key * STEP + parts[:, :, r] + np.uint64(1))
    return key.view(np.int64)


def multiset(g: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A multiset as a sorted set: the i-th time of a shingle is an element of its own."""
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.sort(mix(np.repeat(g, n) + nth.astype(np.uint64) * STEP))


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, copy_key (16 bytes, the same for texts of the same words), bands; rows without words are left out."""

    def make():
        ids = WordIds()

        def apply(batch):
            held = [shingles(x, ids) for x in texts(batch)]
            there = [i for i, h in enumerate(held) if h[2]]
            keys = band_keys(signatures([held[i][0] for i in there], [held[i][1] for i in there]))
            return {
                "doc_id": batch.column("doc_id").take(pa.array(there, type=pa.int64())),
                "copy_key": [hashlib.blake2b(b" ".join(held[i][2]), digest_size=16).digest() for i in there],
                "bands": list(keys),
            }

        return apply

    return map_slices(docs, make, "doc_id bigint, copy_key binary, bands array<bigint>", most_bytes=1_000_000, most_rows=1024)


def contents(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``wanted`` (doc_id, of a row each) with ``content``: the multiset of the text's shingles as distinct numbers."""

    def make():
        ids = WordIds()

        def apply(batch):
            return {"doc_id": batch.column("doc_id"), "component": batch.column("component"), "content": [multiset(*shingles(x, ids)[:2]).view(np.int64) for x in texts(batch)]}

        return apply

    # of the texts only those that may be wanted are shuffled
    few = docs.where(KeyFilter.of(wanted.select("doc_id")).among(docs.sparkSession, "doc_id"))
    # joined by a shuffle whatever its size: after a broadcast, filter and multisets would be one task with two Python workers
    return map_slices(few.join(wanted.hint("merge"), "doc_id"), make, "doc_id bigint, component bigint, content array<bigint>", most_bytes=1_000_000)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """sum(min) / sum(max) of two multisets, each as distinct elements and how often each stands there."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][i], b[1][j]).sum()
    return float(common / (a[1].sum() + b[1].sum() - common))


def verified(pairs: DataFrame, docs: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """Of distinct pairs (a, b) of distinct texts those whose multisets overlap by the threshold: (a, b, similarity).

    Pairs that share ``a`` meet in one place, those of many pairs in several: the text of ``a`` goes to each of these
    once and stands first there, the others stream past it. So a text moves once for each of its pairs, as text, and no list
    of a group's texts is ever held.
    """
    if pairs.isEmpty():
        return pairs.select("a", "b", F.lit(0.0).alias("similarity"))
    large = scratch.save(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(HUB)).cast("int").alias("parts")).where("parts > 1"))
    part = F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = scratch.save(pairs.select("a", "b").join(large, "a", "left").select("a", "b", part.alias("part")))
    hubs = dealt.select(F.col("a").alias("doc_id"), "a", "part", F.lit(0).alias("role")).distinct()
    routes = hubs.unionByName(dealt.select(F.col("b").alias("doc_id"), "a", "part", F.lit(1).alias("role")))
    few = docs.where(KeyFilter.of(routes.select("doc_id")).among(docs.sparkSession, "doc_id"))
    sent = few.join(routes, "doc_id").repartition("a", "part").sortWithinPartitions("a", "part", "role")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])

    def run(batches):
        ids, at, own = WordIds(), None, []
        for batch in batches:
            for piece in slices(batch, "text"):
                out = []
                for a, part, role, b, x in zip(*(piece.column(c).to_pylist() for c in ("a", "part", "role", "doc_id", "text"))):
                    g = shingles(x or "", ids)[:2]
                    if (a, part) != at:
                        at, own = (a, part), []
                    if role == 0:
                        # a key of several rows has several texts
                        own.append(g)
                    elif len(g[0]) and (s := max((overlap(g, h) for h in own if len(h[0])), default=0.0)) >= threshold:
                        out.append((a, b, s))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out) if out else ([], [], []), schema)], schema=schema)
        del ids, own
        give_back()

    found = sent.select("a", "part", "role", "doc_id", "text").mapInArrow(run, "a bigint, b bigint, similarity double")
    out = scratch.save(found)
    scratch.drop(large, dealt)
    return out


def _ordered(pairs: DataFrame) -> DataFrame:
    """Pairs without regard to which is first, each once."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _stars(open_: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of two components: each member of a bucket with one of its largest component and one by a hash."""
    parts = open_.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), F.min_by("b", F.xxhash64("b", F.lit(1))).alias("b"))
    row = F.struct("b", "component")
    # written by itself, as are the open buckets below, so that a wide bucket's members can be split among the tasks of the join
    chosen = scratch.save(parts.groupBy("bucket").agg(F.array_distinct(F.array(F.max_by(row, F.struct("n", "component")), F.min_by(row, F.xxhash64("b", "bucket")))).alias("pivots")))
    met = open_.join(chosen, "bucket").select("b", "component", F.explode(F.filter("pivots", lambda p: p["component"] != F.col("component"))).alias("p"))
    return met.select(F.col("p.b").alias("a"), "b")


def _prefix_pairs(open_: DataFrame, docs: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of two components that may reach the threshold, among the members of open buckets: none is missed.

    Elements are ordered by how few texts hold them. Of two texts that reach t, the shorter has one of its first
    n - ceil(2 t n / (1 + t)) + 1 elements among the first m - ceil(t m) + 1 of the longer. What many texts share comes last in
    this order, so texts with a passage in common and little else don't meet. Elements of one component alone join nothing.
    """
    held = scratch.save(contents(docs, open_.select(F.col("b").alias("doc_id"), "component").distinct()))
    elements = held.select("doc_id", "component", F.size("content").alias("n"), F.explode("content").alias("e"))
    often = elements.groupBy("e").agg(F.count(F.lit(1)).alias("df"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    # a small excess guards the ceilings against rounding
    probe = F.col("n") - F.ceil(F.col("n") * F.lit(threshold - 1e-9)) + 1
    index = F.col("n") - F.ceil(F.col("n") * F.lit(2 * threshold / (1 + threshold) - 1e-9)) + 1
    ordered = elements.join(often, "e").groupBy("doc_id", "component", "n").agg(F.slice(F.array_sort(F.collect_list(F.struct("df", "e", (F.col("lo") < F.col("hi")).alias("meets")))), F.lit(1), F.first(probe).cast("int")).alias("first"))
    first = ordered.select("doc_id", "component", "n", index.alias("index"), F.posexplode("first").alias("at", "x")).where("x.meets")
    first = scratch.save(first.select("doc_id", "component", "n", (F.col("at") < F.col("index")).alias("indexed"), (F.col("n") - F.col("at")).alias("left"), F.col("x.e").alias("e")))
    short, long = (first.select("e", F.col("doc_id").alias(x), F.col("component").alias(f"c_{x}"), F.col("n").alias(f"n_{x}"), F.col("left").alias(f"left_{x}"), "indexed") for x in "sl")
    met = short.where("indexed").drop("indexed").join(long.drop("indexed"), "e").where((F.col("n_s") <= F.col("n_l")) & (F.col("c_s") != F.col("c_l")) & (F.col("n_s") >= F.col("n_l") * F.lit(threshold)))
    # two texts have no more in common than what is left from their first shared element on
    met = met.where(F.least("left_s", "left_l") >= (F.col("n_s") + F.col("n_l")) * F.lit(threshold / (1 + threshold) - 1e-9))
    out = scratch.save(_ordered(met.select(F.col("s").alias("a"), F.col("l").alias("b"))))
    scratch.drop(first, held)
    return out


def _open(shared: DataFrame, label: DataFrame, scratch: Scratch) -> DataFrame:
    """(bucket, b, component) of the buckets of three members or more that aren't in one component."""
    placed = scratch.save(shared.where("n > 2").select("bucket", "b").join(label.withColumnRenamed("node", "b"), "b", "left").select("bucket", "b", F.coalesce("component", "b").alias("component")))
    apart = scratch.save(placed.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("bucket"))
    out = scratch.save(placed.join(apart, "bucket"))
    scratch.drop(placed, apart)
    return out


def near_duplicates(docs: DataFrame, *, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, component_id (smallest key linked to it, directly or not), kept (doc_id = component_id), n_copies (rows of the same words).

    Rows of the same words are one class; two classes are linked if the multisets of their 5-word shingles overlap by the
    threshold. Candidates are classes that share a band. Each member of a bucket is to meet the bucket's pivot, and first the
    pivot that it shares most buckets with; what these links put into one component needs no further check. Then the pivots of
    other components follow, with members of a bucket's largest component; the rest meets by a prefix filter, which
    misses no pair that reaches the threshold.

    Null and empty texts have no shingles and link with nothing; texts of fewer than 5 words have one shingle; whole texts
    of any length count. A key that stands on several rows is one document, linked by any of its texts; rows with a
    null key are left out; other columns are ignored; an empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).where(F.col("doc_id").isNotNull())
    sketched = scratch.save(sketch(rows))
    reps = scratch.save(sketched.groupBy("copy_key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_copies"), F.first("bands").alias("bands")))
    entries = reps.select(F.col("doc_id").alias("b"), F.explode("bands").alias("bucket"))
    # written by itself, so that a wide bucket's entries can be split among the tasks of the join
    pivots = scratch.save(entries.groupBy("bucket").agg(F.min_by("b", F.xxhash64("b")).alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = scratch.save(entries.join(pivots, "bucket"))
    tries = scratch.save(shared.where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")))
    best = scratch.save(tries.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a")))
    links = verified(best, rows, threshold, scratch)
    label = components(links, scratch)
    at = {x: label.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}")) for x in "ab"}
    others = tries.join(best, ["a", "b"], "left_anti").join(at["a"], "a", "left").join(at["b"], "b", "left").where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")
    open_ = _open(shared, label, scratch)
    tried = scratch.save(_ordered(best.select("a", "b")))
    found = scratch.save(_ordered(others.unionByName(_stars(open_, scratch))).join(tried, ["a", "b"], "left_anti"))
    more = verified(found, rows, threshold, scratch)
    label = merged(label, more, scratch)
    last = _open(shared, label, scratch)
    if not last.isEmpty():
        rest = scratch.save(_prefix_pairs(last, rows, threshold, scratch).join(tried.unionByName(found), ["a", "b"], "left_anti"))
        label = merged(label, verified(rest, rows, threshold, scratch), scratch)
    scratch.drop(pivots, shared, tries, best, links, open_, tried, found, more, last)
    classes = reps.select("copy_key", "n_copies", F.col("doc_id").alias("node")).join(label, "node", "left").select("copy_key", "n_copies", F.coalesce("component", "node").alias("component_id"))
    classes = scratch.save(classes)
    # a plain join of two written tables: the rows of a class of many copies are split among tasks as they come
    told = sketched.select("doc_id", "copy_key").join(classes, "copy_key").groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.max("n_copies").alias("n_copies"))
    out = rows.select("doc_id").distinct().join(told, "doc_id", "left")
    return out.select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"), (F.coalesce("component_id", "doc_id") == F.col("doc_id")).alias("kept"), F.coalesce("n_copies", F.lit(1)).cast("bigint").alias("n_copies"))
