"""Line de-duplication with DataFrame operations alone: a suffix array over line ids by prefix doubling.

A line's id is a hash of 128 bits. Doubling step k ranks the suffixes of all documents by their first 2**k lines,
of those that share these lines with another suffix; a class of suffixes is an interval of the suffix array in which
the longest common prefix is 2**k lines or more: ``rank`` is where it begins, ``n`` its width. Suffixes alone in their
class drop out, so a step works on repeated text only. Runs never cross the end of a document.

Places are ordered by document key and line. A run is a stretch of lines that stands at an earlier place too, the longest
from its beginning over all earlier places. Runs of at least ``min_words`` words are deleted; the first place stays.

What such runs cover is found from their shortest parts of ``min_words`` words, those that begin at a line and those that end
at one: each line of a long enough run lies in one that is part of it, and a part that stands earlier is a run. The interval of
suffixes with a common prefix of t lines, 2**k <= t < 2**(k+1), is known by two ranks, of the first and the last 2**k of these lines; its
first place tells whether the part stands earlier. So doubling goes as deep as the longest part, each part is asked
once, and the maximal runs are the unions of parts that overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skygraph.llm.common import Scratch

PLACE = ["doc", "th", "pos"]
SOURCE = ["f_doc", "f_th", "f_pos"]
#: Classes wider than this share of the suffixes are joined by broadcast: there are at most as many of them.
HOT_PARTS = 1000


def _source() -> list[Column]:
    return [F.col(f"first.{a}").alias(b) for a, b in zip(PLACE, SOURCE)]


def _key(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A document's place among others: its key (null first), then a hash of the text."""
    return docs.withColumn("_doc", F.coalesce(F.col(key).cast("bigint"), F.lit(-(1 << 63)))).withColumn("_th", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))


def line_ids(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc, th, pos, h, g (the line's id), words; one row a line, of keyed documents."""
    lines = docs.select(F.col("_doc").alias("doc"), F.col("_th").alias("th"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("pos", "line"))
    blanks = F.length("line") - F.length(F.replace(F.col("line"), F.lit(" ")))
    return lines.select("doc", "th", "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.lit("second"), "line").alias("g"), F.when(F.col("line") == "", 0).otherwise(blanks + 1).alias("words"))


def _classes(rows: DataFrame, names: list[str]) -> DataFrame:
    """names, n, first: the classes of two suffixes or more. Each task adds up its own before the shuffle."""
    return rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*PLACE)).alias("first")).where("n > 1")


def _ranked(classes: DataFrame, parent: list[str], within: list[str], part: Column) -> DataFrame:
    """Add ``rank``: the parent's, and the widths of the classes before in the order of ``within``.

    Sums by part of the order come first, so that no window holds all of a wide parent's classes.
    """
    parted = classes.withColumn("part", part)
    sums = parted.groupBy(*parent, "part").agg(F.sum("n").alias("sum"))
    before = Window.partitionBy(*parent).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*parent, "part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*parent, "part").orderBy(*within).rowsBetween(Window.unboundedPreceding, -1)
    parted = parted.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    base = F.col(parent[0]) if parent else F.lit(0)
    return parted.join(sums, [*parent, "part"]).withColumn("rank", (base + F.col("before") + F.col("inside")).cast("bigint")).drop("part", "before", "inside")


def _attach(rows: DataFrame, classes: DataFrame, names: list[str], total: int, keep: list[str]) -> DataFrame:
    """Rank and source for each row of a class; the few wide classes by broadcast, the others by shuffle."""
    told = classes.select(*names, "rank", "n", *_source())
    # fewer than HOT_PARTS rows, as their widths add up to ``total`` at most
    hot = told.where(F.col("n") > total // HOT_PARTS + 1)
    flagged = rows.join(F.broadcast(hot), names, "left")
    warm = flagged.where(F.col("rank").isNull()).select(*rows.columns).join(told.where(F.col("n") <= total // HOT_PARTS + 1), names)
    return flagged.where(F.col("rank").isNotNull()).select(*keep, "rank", *SOURCE).unionByName(warm.select(*keep, "rank", *SOURCE))


def suffix_levels(lines: DataFrame, scratch: Scratch, most_levels: int = 40) -> list[DataFrame]:
    """By k < most_levels: doc, th, pos, rank and source of every suffix that shares its first 2**k lines with another."""
    classes = scratch.save(_ranked_first(_classes(lines, ["h", "g"])))
    total = lines.count()
    levels = [scratch.save(_attach(lines, classes, ["h", "g"], total, [*PLACE, "words"]))]
    scratch.drop(classes)
    while len(levels) < most_levels:
        now, reach = levels[-1], 1 << (len(levels) - 1)
        ahead = now.select("doc", "th", (F.col("pos") - reach).alias("pos"), F.col("rank").alias("b"))
        pairs = scratch.save(now.select(*PLACE, F.col("rank").alias("a")).join(ahead, PLACE))
        classes = scratch.save(_ranked(_classes(pairs, ["a", "b"]), ["a"], ["b"], F.floor(F.col("b") * F.lit(64) / F.lit(float(total + 1)))))
        empty = classes.isEmpty()
        if not empty:
            levels.append(scratch.save(_attach(pairs, classes, ["a", "b"], total, PLACE)))
        scratch.drop(pairs, classes)
        if empty:
            break
    return levels


def _ranked_first(classes: DataFrame) -> DataFrame:
    """Ranks of single lines in the order of their ids, by 4096 parts of the id's range."""
    return _ranked(classes, [], ["h", "g"], F.shiftright("h", 52))


def _reached(runs: DataFrame) -> DataFrame:
    """Add ``reached``: where the runs that begin earlier in the document end at most; what a run covers stands earlier from each of its lines on."""
    before = Window.partitionBy("doc", "th").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("reached", F.coalesce(F.max(F.col("pos") + F.col("length")).over(before), F.lit(0)))


def _longest(open_: DataFrame, levels: list[DataFrame], scratch: Scratch) -> DataFrame:
    """``open_`` with the greatest length, of ``length`` to ``most``, for which an earlier place has the same lines.

    A stretch of 2**k to 2**(k+1) lines is known by the ranks of its first and its last 2**k lines. Bit by bit, every suffix
    of a class (k, rank) is grouped by both ranks for each length asked of the class; the first place of the group tells.
    """
    ranks = None
    for k, level in enumerate(levels):
        rows = level.select(F.lit(k).alias("k"), *PLACE, "rank")
        ranks = rows if ranks is None else ranks.unionByName(rows)
    members = scratch.save(ranks.join(open_.select("k", "rank").distinct(), ["k", "rank"], "left_semi"))
    near = scratch.save(ranks.join(members.select("k", "doc", "th").distinct(), ["k", "doc", "th"], "left_semi"))
    last_at = lambda rows: rows.withColumn("_pos", (F.col("pos") + F.col("t") - F.call_function("shiftleft", F.lit(1), F.col("k"))).cast("int")).join(near.select("k", "doc", "th", F.col("pos").alias("_pos"), F.col("rank").alias("last")), ["k", "doc", "th", "_pos"])
    for bit in range(len(levels) - 2, -1, -1):
        asked = open_.withColumn("t", ((F.floor(F.col("length") / F.lit(1 << bit)) + 1) * F.lit(1 << bit)).cast("int")).where("t <= most")
        tests = scratch.save(last_at(asked).select("k", "rank", "t", "last", *PLACE))
        lengths = tests.select("k", "rank", "t").distinct()
        groups = last_at(members.join(lengths, ["k", "rank"])).groupBy("k", "rank", "t", "last").agg(F.min(F.struct(*PLACE)).alias("first"))
        told = tests.join(groups, ["k", "rank", "t", "last"]).where(F.col("first") < F.struct(*PLACE)).select(*PLACE, "t")
        before = open_
        open_ = scratch.save(open_.join(told, PLACE, "left").withColumn("length", F.coalesce("t", "length")).drop("t"))
        scratch.drop(before, tests)
    scratch.drop(members, near)
    return open_


def repeated_runs(lines: DataFrame, scratch: Scratch, min_words: int = 10) -> tuple[DataFrame, list[DataFrame]]:
    """(doc, th, pos, length, words) of the maximal runs that stand at an earlier place too; and the tables to drop after use."""
    levels = suffix_levels(lines, scratch)
    earlier = F.struct(*SOURCE) < F.struct(*PLACE)
    # the deepest level at which a suffix has an earlier source
    cur = None
    for k in range(len(levels) - 1, -1, -1):
        # no run goes on beyond the last of the lines from which 2**k lines stand earlier, nor over 2**(k+1) lines
        found = levels[k].where(earlier)
        by_line = Window.partitionBy("doc", "th").orderBy("pos")
        found = found.withColumn("_gap", F.col("pos") - F.row_number().over(by_line))
        most = F.max("pos").over(Window.partitionBy("doc", "th", "_gap")) - F.col("pos") + F.lit(1 << k)
        found = found.select(*PLACE, *SOURCE, F.lit(1 << k).alias("length"), F.least(most, F.lit((2 << k) - 1)).alias("most"), F.lit(k).alias("k"), "rank")
        if cur is None:
            cur = found
            continue
        # what has a source at this level alone begins here; longer ones may go on by 2**k lines
        more = levels[k].select(*PLACE, F.col("rank"))
        own = more.select(F.col("doc"), F.col("th"), F.col("pos").alias("_end"), F.col("rank").alias("_own"))
        its = more.select(F.col("doc").alias("f_doc"), F.col("th").alias("f_th"), F.col("pos").alias("_f_end"), F.col("rank").alias("_its"))
        longer = cur.withColumn("_end", F.col("pos") + F.col("length")).withColumn("_f_end", F.col("f_pos") + F.col("length"))
        longer = longer.join(own, ["doc", "th", "_end"], "left").join(its, ["f_doc", "f_th", "_f_end"], "left")
        longer = longer.select(*PLACE, *SOURCE, (F.col("length") + F.when(F.col("_own") == F.col("_its"), 1 << k).otherwise(0)).alias("length"), "most", "k", "rank")
        last = cur
        cur = scratch.save(longer.unionByName(found.join(cur.select(*PLACE), PLACE, "left_anti")))
        scratch.drop(last)
    # the first source needn't be the one that goes on longest: what may be longer is settled over all places
    known = scratch.save(_reached(cur).select(*PLACE, F.greatest("length", F.col("reached") - F.col("pos")).alias("length"), "most", "k", "rank"))
    scratch.drop(cur)
    settled = known.where("length >= most")
    open_ = scratch.save(known.where("length < most"))
    if not open_.isEmpty():
        open_ = _longest(open_, levels, scratch)
    # a run that ends no later than one that begins before it is part of that
    starts = _reached(settled.unionByName(open_)).where(F.col("pos") + F.col("length") > F.col("reached")).select(*PLACE, "length")
    words = levels[0].select("doc", "th", F.col("pos").alias("_at"), "words")
    spread = starts.withColumn("_at", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("length") - 1)))
    runs = spread.join(words, ["doc", "th", "_at"]).groupBy(*PLACE, "length").agg(F.sum("words").alias("words")).where(F.col("words") >= min_words)
    return runs, [*levels, known, open_]


def with_parts(lines: DataFrame, min_words: int) -> DataFrame:
    """Add ``parts`` (at, length): the shortest stretch of ``min_words`` words from the line on, and that up to the line if no line has it as its first.

    The words before each line are added up within a document; the count of lines with fewer words before them than
    the line's own and ``min_words`` more is where its stretch ends. The same from the other side.
    """
    document = Window.partitionBy("doc", "th")
    summed = lines.withColumn("upto", F.sum("words").over(document.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    summed = summed.withColumns({"before": F.col("upto") - F.col("words"), "total": F.max("upto").over(document)})
    ahead = document.orderBy("before").rangeBetween(Window.unboundedPreceding, min_words - 1)
    behind = document.orderBy("upto").rangeBetween(Window.unboundedPreceding, -min_words)
    placed = summed.withColumn("end", F.count(F.lit(1)).over(ahead)).withColumns({"start": F.count(F.lit(1)).over(behind), "skipped": F.coalesce(F.max("upto").over(behind), F.lit(0))})
    part = lambda at, end: F.struct(at.cast("int").alias("at"), (end - at).cast("int").alias("length"))
    forward = F.when(F.col("total") - F.col("before") >= min_words, part(F.col("pos"), F.col("end")))
    # fewer than min_words without its last line: the first line has this stretch itself
    backward = F.when(F.col("before") - F.col("skipped") >= min_words, part(F.col("start"), F.col("pos") + 1))
    return placed.select(*lines.columns, F.array_compact(F.array(forward, backward)).alias("parts"))


def repeated_parts(lines: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """(doc, th, at, length) of the parts that stand at an earlier place too; and the tables to drop after use."""
    all_parts = scratch.save(lines.select("doc", "th", F.explode("parts").alias("p")).select("doc", "th", "p.at", "p.length"))
    longest = all_parts.agg(F.max("length")).first()[0] or 0
    if not longest:
        return all_parts.limit(0), [all_parts]
    levels = suffix_levels(lines, scratch, longest.bit_length())
    told = None
    for k, level in enumerate(levels):
        rank = lambda pos, name: level.select("doc", "th", F.col("pos").alias(pos), F.col("rank").alias(name))  # noqa: B023, E731
        own = all_parts.where(F.col("length").between(1 << k, (2 << k) - 1))
        own = own.join(rank("at", "first_rank"), ["doc", "th", "at"])
        if k:
            own = own.withColumn("_last", F.col("at") + F.col("length") - (1 << k)).join(rank("_last", "last_rank"), ["doc", "th", "_last"])
        else:
            own = own.withColumn("last_rank", F.col("first_rank"))
        own = own.select("doc", "th", F.col("at").alias("pos"), "length", "first_rank", "last_rank")
        told = own if told is None else told.unionByName(own)
    told = scratch.save(told)
    names = ["length", "first_rank", "last_rank"]
    classes = scratch.save(_classes(told, names).withColumn("rank", F.col("first_rank")))
    found = _attach(told, classes, names, told.count(), [*PLACE, "length"])
    repeated = scratch.save(found.where(F.struct(*SOURCE) < F.struct(*PLACE)).select("doc", "th", F.col("pos").alias("at"), "length"))
    scratch.drop(told, classes)
    return repeated, [all_parts, *levels, repeated]


def stretches(runs: DataFrame) -> DataFrame:
    """(doc, th, cut): by document its maximal runs in order, as the kept lines before each (``gap``) and its own number of lines (``length``)."""
    document = Window.partitionBy("doc", "th").orderBy("at")
    reached = F.max(F.col("at") + F.col("length")).over(document.rowsBetween(Window.unboundedPreceding, -1))
    # parts that overlap or touch are one stretch of deleted lines
    marked = runs.withColumn("reached", F.coalesce(reached, F.lit(0))).withColumn("new", (F.col("at") > F.col("reached")) | (F.row_number().over(document) == 1))
    numbered = marked.withColumn("nth", F.sum(F.col("new").cast("int")).over(document.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy("doc", "th", "nth").agg(F.min("at").alias("at"), F.max(F.col("at") + F.col("length")).alias("end"))
    last = F.coalesce(F.lag("end").over(Window.partitionBy("doc", "th").orderBy("nth")), F.lit(0))
    gaps = merged.select("doc", "th", F.struct("at", (F.col("at") - last).cast("int").alias("gap"), (F.col("end") - F.col("at")).cast("int").alias("length")).alias("x"))
    return gaps.groupBy("doc", "th").agg(F.array_sort(F.collect_list("x")).alias("cut"))


def dedup_lines(docs: DataFrame, *, min_words: int = 10, longest_runs: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with later copies of repeated line runs cut from the text; adds n_lines, removed (line numbers), longest_run.

    ``longest_run`` is the number of lines of the document's longest run that stands earlier as a whole; without ``longest_runs``
    it isn't measured and the column is left out, which spares the deeper doubling steps.

    A null text stays null and has no lines; an empty text has one empty line; a text of which all lines go becomes ''.
    Texts of any length count as a whole. Rows that agree in key and text are one document, and treated alike; a null key
    comes before all others; other columns are kept as they are; ties can't occur, as places differ; an empty table
    gives an empty one. The columns ``n_lines``, ``removed`` and ``longest_run`` replace any of that name.
    """
    scratch = Scratch(docs.sparkSession)
    kept = docs.drop("n_lines", "removed", "longest_run")
    lines = line_ids(_key(docs.where(F.col(text).isNotNull()), key, text), text)
    # dealt by document once, for what is added up within each
    lines = scratch.save(with_parts(lines.repartition("doc", "th").dropDuplicates(PLACE), min_words))
    repeated, used = repeated_parts(lines, scratch)
    gone = stretches(repeated).select(F.col("doc").alias("_doc"), F.col("th").alias("_th"), "cut")
    if longest_runs:
        runs, more = repeated_runs(lines, scratch, min_words)
        gone = gone.join(runs.groupBy(F.col("doc").alias("_doc"), F.col("th").alias("_th")).agg(F.max("length").alias("longest_run")), ["_doc", "_th"], "left")
        used += more
    gone = scratch.save(gone)
    scratch.drop(lines, *used)
    found = _key(kept, key, text).join(gone, ["_doc", "_th"], "left").withColumn("_split", F.split(F.col(text), "\n", -1))
    whether = F.flatten(F.transform("cut", lambda x: F.concat(F.array_repeat(F.lit(False), x["gap"]), F.array_repeat(F.lit(True), x["length"]))))
    left = F.filter(F.zip_with("_split", whether, lambda x, out: F.when(out, F.lit(None)).otherwise(x)), lambda x: x.isNotNull())
    return found.select(
        *[F.when(F.col("cut").isNull(), F.col(text)).otherwise(F.array_join(left, "\n")).alias(c) if c == text else F.col(c) for c in kept.columns],
        F.coalesce(F.size("_split"), F.lit(0)).alias("n_lines"),
        F.coalesce(F.flatten(F.transform("cut", lambda x: F.sequence(x["at"], x["at"] + x["length"] - 1))), F.array().cast("array<int>")).alias("removed"),
        *([F.coalesce("longest_run", F.lit(0)).alias("longest_run")] if longest_runs else []),
    )
