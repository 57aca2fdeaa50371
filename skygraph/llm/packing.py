"""Packing: shallow combinations of piece lengths that fill a window, repeat counts by non-negative least squares, greedy residuals."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skygraph.llm import token_ids
from skygraph.llm.common import Scratch, map_slices

END_ID = 1
#: Parts of texts whose ids a worker keeps: few, as workers of a pipeline also hold what its other stages need.
KEPT_PARTS = 150_000
#: What a sequence's padding costs against a missed or surplus piece, as a multiple of the mean count of a length; lowered step by step.
CHARGES = (1.0, 0.3, 0.1, 0.03, 0.01, 0.003, 0.001)


def encoder(json_path: str, ranks_path: str | None = None):
    """A function from a text to the array of its ids. ``ranks_path`` is kept for callers of old and isn't read: ids are those of ``tokenizers``."""
    own = token_ids.encoder(json_path)
    return lambda text: np.frombuffer(own.encode([text])[0], dtype="<u4")


def measure(docs: DataFrame, window: int, json_path: str, key: str, text: str) -> DataFrame:
    """Per row: doc_id, n (ids with the end), crcs (of each piece of ``window`` ids and of the rest)."""
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def make():
        encode = token_ids.encoder(json_path, KEPT_PARTS).encode
        end, step = END_ID.to_bytes(4, "little"), 4 * window

        def apply(batch):
            n, crcs = [], []
            for ids in encode(batch.column("text")):
                ids += end
                n.append(len(ids) // 4)
                crcs.append([zlib.crc32(ids[i : i + step]) for i in range(0, len(ids), step)])
            return {"doc_id": batch.column("doc_id"), "n": n, "crcs": crcs}

        return apply

    return map_slices(rows, make, "doc_id bigint, n bigint, crcs array<bigint>", most_bytes=1_000_000, most_rows=1024)


def combinations(lengths: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """Fillings of the window by one to three of the given lengths: pairs that leave at most a 128th of it empty, and triples that fill it, of each length with a spread of partners."""
    there = np.zeros(window + 1, dtype=bool)
    there[lengths] = True
    out = {(window,)} if there[window] else set()
    for a in lengths.tolist():
        rest = window - a
        out.update((a, b) for b in range(max(1, rest - window // 128), min(a, rest) + 1) if there[b])
        b = lengths[(lengths <= a) & (2 * lengths >= rest) & (lengths < rest)]
        b = b[there[rest - b]]
        for x in b[:: max(1, len(b) // 12)].tolist():
            out.add(tuple(sorted((a, x, rest - x), reverse=True)))
    return sorted(out, reverse=True)


def priced(price: np.ndarray, window: int) -> set[tuple[int, ...]]:
    """For each length with a positive price, the filling of up to three pieces with it that is worth most."""
    price = np.maximum(price, 0)
    lengths = np.flatnonzero(price > 1e-9).tolist()
    one = np.maximum.accumulate(price)
    # the last place where the running maximum rose is the length it is from
    of_one = np.maximum.accumulate(np.where(price > np.append(-1.0, one[:-1]), np.arange(window + 1), 0))
    two, of_two = one.copy(), np.zeros(window + 1, dtype=np.int64)
    for a in lengths:
        value = price[a] + one[: window + 1 - a]
        better = value > two[a:]
        two[a:][better] = value[better]
        of_two[a:][better] = a
    out = set()
    for a in lengths:
        room, filling = window - a, [a]
        for of in (of_two, of_one):
            if (b := int(of[room])) and price[b] > 0:
                filling.append(b)
                room -= b
        out.add(tuple(sorted(filling, reverse=True)))
    return out


def non_negative_least_squares(combos: list[tuple[int, ...]], histogram: np.ndarray, window: int, charge: float, start: np.ndarray, steps: int = 700) -> tuple[np.ndarray, np.ndarray]:
    """Repeat counts x >= 0 that make the combinations use the histogram up, with a charge on what they leave empty, by accelerated projected gradient; and what stays unused."""
    row = np.array([i for i, c in enumerate(combos) for _ in c])
    at = np.array([a for c in combos for a in c])
    m, bound = len(combos), len(histogram)
    empty = charge * (1 - np.bincount(row, weights=at, minlength=m) / window)
    # the largest eigenvalue is at most the largest row sum times the largest column sum
    step = 1.0 / (3 * np.bincount(at, minlength=bound).max())
    x = y = np.append(start, np.zeros(m - len(start)))
    t = 1.0
    for _ in range(steps):
        over = np.bincount(at, weights=y[row], minlength=bound) - histogram
        new = np.maximum(0, y - step * (np.bincount(row, weights=over[at], minlength=m) + empty))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x, histogram - np.bincount(at, weights=x[row], minlength=bound)


def plan(histogram: np.ndarray, window: int) -> list[tuple[int, tuple[int, ...]]]:
    """(repeats, lengths) of sequences that use each length just as often as the histogram has it.

    Least squares over the combinations, again with a lower charge on padding and with the fillings that are worth most of what the last
    fit left unused; repeat counts are rounded down. Then the residual pieces, longest first, each after the longest that still fits.
    """
    combos, x = combinations(np.flatnonzero(histogram), window), np.zeros(0)
    if not combos:
        return _rounded(histogram, window, combos, x)
    mean = histogram[histogram > 0].mean()
    for charge in CHARGES:
        x, unused = non_negative_least_squares(combos, histogram.astype(float), window, charge * mean, x)
        combos, fitted = combos + sorted(priced(unused, window) - set(combos)), combos
    return _rounded(histogram, window, fitted, x)


def _rounded(histogram: np.ndarray, window: int, combos: list[tuple[int, ...]], x: np.ndarray) -> list[tuple[int, tuple[int, ...]]]:
    left = histogram.astype(np.int64).copy()
    out: list[tuple[int, tuple[int, ...]]] = []
    needs = [np.unique(c, return_counts=True) for c in combos]
    for i in np.argsort(-x, kind="stable").tolist():
        a, need = needs[i]
        n = int(min(np.floor(x[i]), (left[a] // need).min()))
        if n > 0:
            left[a] -= n * need
            out.append((n, combos[i]))
    # the residual is packed by length and count, so the work is bounded by the window, not by the number of pieces
    while left.any():
        room, lengths, take = window, [], np.zeros_like(left)
        while (fit := np.flatnonzero((left[: room + 1] - take[: room + 1]) > 0)).size:
            a = int(fit[-1])
            lengths.append(a)
            take[a] += 1
            room -= a
        use = take > 0
        n = int((left[use] // take[use]).min())
        left -= n * take
        out.append((n, tuple(lengths)))
    return out


def _places(packed: list[tuple[int, tuple[int, ...]]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, sequence of that rank, offset), one for each place of that length in a pattern."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for n, lengths in packed:
        offset = 0
        for a in lengths:
            out.setdefault(a, []).append((used.get(a, 0), sequence, offset))
            used[a] = used.get(a, 0) + n
            offset += a
        sequence += n
    return {a: np.array(x, dtype=np.int64) for a, x in out.items()}


def salts(rows: int) -> int:
    """Parts for so many rows of a group: some 2,000 rows each for a start, and never more than 100,000."""
    return max(1, min(-(-rows // 2_000), max(256, -(-rows // 100_000))))


def _ranked(rows: DataFrame, group: Column, counts: list[int], weight: Column, name: str) -> DataFrame:
    """Add the sum of ``weight`` over the rows before within a group (0 ... len(counts) - 1). A group is split by its number of rows, so tables of parts grow with a 100,000th of the rows."""
    split = F.element_at(F.lit([salts(n) for n in counts]), F.col("_group") + 1)
    salted = rows.withColumn("_group", group.cast("int")).withColumn("_salt", F.pmod(F.xxhash64("doc_id", "_tie"), split).cast("int"))
    part = salted.groupBy("_group", "_salt").agg(F.sum(weight).alias("_sum"))
    before = Window.partitionBy("_group").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select("_group", "_salt", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_group", "_salt").orderBy("doc_id", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    ranked = salted.withColumn("_inside", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return ranked.join(F.broadcast(part), ["_group", "_salt"]).withColumn(name, F.col("_before") + F.col("_inside")).drop("_group", "_salt", "_before", "_inside")


def pack(docs: DataFrame, *, window: int = 2048, json_path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids, and an end id, are cut at each ``window`` ids. Full pieces are sequences of their own; the
    rests fill sequences by ``plan``. Only the histogram of the rests (at most ``window`` counts) comes to the driver, and
    only the plan (bounded by the window too) goes back. Ids are those of ``tokenizers`` for the whole text, however long. Null and
    empty texts are packed as an end id alone; repeated rows and null keys are packed row by row; other columns are ignored; an empty
    table gives an empty one.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
    measured = scratch.save(measure(docs, window, json_path, key, text).withColumn("_tie", F.monotonically_increasing_id()))
    rest = measured.where(F.col("n") % window > 0).withColumn("length", (F.col("n") % window).cast("int"))
    histogram = np.zeros(window + 1, dtype=np.int64)
    for r in rest.groupBy("length").count().collect():
        histogram[r["length"]] = r["count"]
    packed = plan(histogram, window)
    shared = spark.sparkContext.broadcast(_places(packed))
    ranked = _ranked(rest.select("doc_id", "_tie", "length", "n", F.element_at("crcs", -1).alias("ids_crc32")), F.col("length"), histogram.tolist(), F.lit(1), "rank")

    def place(batches):
        places = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for a in np.unique(length).tolist():
                own = length == a
                at = np.searchsorted(places[a][:, 0], rank[own], side="right") - 1
                sequence[own] = places[a][at, 1] + rank[own] - places[a][at, 0]
                offset[own] = places[a][at, 2]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n"), batch.column("length"), batch.column("ids_crc32"), pa.array(sequence), pa.array(offset)], names=["doc_id", "n", "length", "ids_crc32", "sequence_id", "offset"])

    placed = ranked.select("doc_id", "n", "length", "ids_crc32", "rank").mapInArrow(place, "doc_id bigint, n bigint, length int, ids_crc32 bigint, sequence_id bigint, offset bigint")
    rests = placed.select("doc_id", (F.col("n") - F.col("length")).alias("start"), F.col("length").cast("bigint").alias("length"), "ids_crc32", F.col("n").alias("doc_tokens"), "sequence_id", "offset")
    whole = F.floor(F.col("n") / window).cast("bigint")
    long = measured.where(F.col("n") >= window)
    full = _ranked(long, F.lit(0), [long.count()], whole, "before")
    piece = F.posexplode(F.slice("crcs", 1, whole.cast("int"))).alias("_i", "ids_crc32")
    full = full.select("doc_id", "n", "before", piece).select("doc_id", (F.col("_i") * F.lit(window)).cast("bigint").alias("start"), F.lit(window).cast("bigint").alias("length"), "ids_crc32", F.col("n").alias("doc_tokens"), (F.lit(sum(n for n, _ in packed)) + F.col("before") + F.col("_i")).cast("bigint").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return rests.unionByName(full)
