"""FITS binary tables as a Spark data source: row ranges as partitions, pruned columns, units stitched by position, and a sink.

Only binary tables (BINTABLE) with columns of fixed width are read: logical, byte, 16-, 32- and 64-bit integers, floats and character
strings, with repeat counts, scaling and nulls. Bits, complex numbers and variable-length arrays raise an error when they are asked for.
"""

from __future__ import annotations

import fnmatch
import json
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the format: the size of a block and of a card, and the numpy type of each code of a column.
BLOCK, CARD = 2880, 80
CODES = {"L": "u1", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8"}
#: Offsets that stand for the other signedness: code, offset, type.
UNSIGNED = {("B", -128): T.ByteType(), ("I", 1 << 15): T.IntegerType(), ("J", 1 << 31): T.LongType(), ("K", 1 << 63): T.DecimalType(20, 0)}
TYPES = {"L": T.BooleanType(), "B": T.ShortType(), "I": T.ShortType(), "J": T.IntegerType(), "K": T.LongType(), "E": T.FloatType(), "D": T.DoubleType(), "A": T.StringType()}
ARROW = {T.BooleanType(): pa.bool_(), T.ByteType(): pa.int8(), T.ShortType(): pa.int16(), T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.FloatType(): pa.float32(), T.DoubleType(): pa.float64(), T.StringType(): pa.string(), T.DecimalType(20, 0): pa.decimal128(20, 0)}


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system and the place in it of a path or URI."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return arrow_fs.FileSystem.from_uri(path)


# --- headers -------------------------------------------------------------------------------------
def _value(text: str):
    """The value of a card, without its comment."""
    text = text.strip()
    if text.startswith("'"):
        return re.match(r"'((?:[^']|'')*)'", text)[1].replace("''", "'").rstrip()
    text = text.split("/")[0].strip()
    if text in ("T", "F"):
        return text == "T"
    if re.fullmatch(r"[+-]?\d+", text):
        return int(text)
    try:
        return float(text.replace("D", "E").replace("d", "e"))
    except ValueError:
        return text or None


def card(key: str, value, comment: str = "") -> str:
    if isinstance(value, bool):
        told = f"{'T' if value else 'F':>20}"
    elif isinstance(value, int | float):
        told = f"{value!r:>20}".replace("e", "E")
    else:
        quoted = str(value).replace("'", "''")
        told = f"'{quoted:<8}'"
    line = f"{key.upper():<8}= {told}"
    if len(key) > 8 or len(line) > CARD:
        raise ValueError(f"too long for a card: {key} = {value!r}")
    return (f"{line} / {comment}" if comment else line)[:CARD].ljust(CARD)


def block(cards: list[str]) -> bytes:
    text = "".join([*cards, "END".ljust(CARD)])
    return text.ljust(-(-len(text) // BLOCK) * BLOCK).encode("ascii")


PRIMARY = block([card("SIMPLE", True), card("BITPIX", 8), card("NAXIS", 0), card("EXTEND", True)])


@dataclass(frozen=True)
class Column:
    name: str
    code: str
    repeat: int
    offset: int
    null: int | None = None
    scale: float = 1.0
    zero: float = 0.0

    @property
    def element(self) -> T.DataType:
        if self.code == "A" or self.code not in TYPES:
            return T.StringType()
        if (self.code, self.zero) in UNSIGNED and self.scale == 1:
            return UNSIGNED[self.code, self.zero]
        return TYPES[self.code] if (self.scale, self.zero) == (1, 0) or self.code == "L" else T.DoubleType()

    @property
    def type(self) -> T.DataType:
        return self.element if self.code == "A" or self.repeat == 1 else T.ArrayType(self.element)

    @property
    def stored(self):
        if self.code == "A":
            return f"S{self.repeat}"
        return CODES[self.code] if self.repeat == 1 else (CODES[self.code], (self.repeat,))


@dataclass
class Unit:
    header: dict
    start: int
    row_bytes: int = 0
    rows: int = 0
    columns: dict[str, Column] = field(default_factory=dict)

    @property
    def name(self) -> str:
        return str(self.header.get("EXTNAME", ""))


def _columns(header: dict) -> dict[str, Column]:
    out, offset = {}, 0
    for i in range(1, header["TFIELDS"] + 1):
        form = re.match(r"\s*(\d*)([A-Z])", header[f"TFORM{i}"])
        repeat, code = int(form[1] or 1), form[2]
        name = header.get(f"TTYPE{i}", f"col{i}")
        zero, scale = header.get(f"TZERO{i}", 0), header.get(f"TSCAL{i}", 1)
        out[name] = Column(name, code, repeat, offset, header.get(f"TNULL{i}"), scale, zero)
        offset += (repeat + 7) // 8 if code == "X" else repeat * {"L": 1, "B": 1, "I": 2, "J": 4, "K": 8, "A": 1, "E": 4, "D": 8, "C": 8, "M": 16, "P": 8, "Q": 16}[code]
    return out


def units(path: str) -> list[Unit]:
    """The units of a file, by their headers alone."""
    system, place = opened(path)
    out, at = [], 0
    with system.open_input_file(place) as f:
        size = f.size()
        while at < size:
            header: dict = {}
            done = False
            while not done:
                data = f.read_at(BLOCK, at)
                if len(data) < BLOCK:
                    raise ValueError(f"{path} ends within a header")
                at += BLOCK
                for line in (data[i : i + CARD].decode("ascii", "replace") for i in range(0, BLOCK, CARD)):
                    if done := line.rstrip() == "END":
                        break
                    if line[8:10] == "= ":
                        header.setdefault(line[:8].strip(), _value(line[10:]))
            if not out and header.get("SIMPLE") is not True:
                raise ValueError(f"{path} is no FITS file")
            axes = [header[f"NAXIS{i}"] for i in range(1, header.get("NAXIS", 0) + 1)]
            unit = Unit(header, at)
            if header.get("XTENSION") == "BINTABLE":
                unit.row_bytes, unit.rows, unit.columns = axes[0], axes[1], _columns(header)
            out.append(unit)
            n = abs(header.get("BITPIX", 8)) // 8 * header.get("GCOUNT", 1) * (header.get("PCOUNT", 0) + int(np.prod(axes))) if axes else 0
            at += -(-n // BLOCK) * BLOCK
    return out


def unit_of(path: str, name: str | None) -> Unit:
    """A binary table by its name, or the first one."""
    found = [u for u in units(path) if u.columns and (name is None or u.name.upper() == name.upper())]
    if not found:
        raise KeyError(f"no table {name or ''} in {path}")
    return found[0]


def header(path: str, name: str | None = None) -> dict:
    """Keywords of a unit."""
    return unit_of(path, name).header


def find(folder: str, pattern: str = "*.fits") -> list[str]:
    """Files of a folder whose names match, in order; none if the folder isn't there."""
    system, place = opened(folder)
    found = system.get_file_info(arrow_fs.FileSelector(place, allow_not_found=True))
    return [f"{folder.rstrip('/')}/{x.base_name}" for x in sorted(found, key=lambda x: x.base_name) if x.is_file and fnmatch.fnmatch(x.base_name, pattern)]


# --- reading -------------------------------------------------------------------------------------
@dataclass
class Source:
    """A unit of a file, as far as a task needs it."""

    start: int
    row_bytes: int
    columns: list[Column]


@dataclass
class RowRange(ds.InputPartition):
    path: str
    first: int
    last: int
    sources: list[Source]


def _strings(raw: np.ndarray) -> pa.Array:
    """Text without the spaces that pad it; null where the first byte is zero."""
    if not raw.dtype.itemsize:
        return pa.array([""] * len(raw), type=pa.string())
    raw = np.ascontiguousarray(raw)
    cells = raw.view(np.uint8).reshape(len(raw), -1)
    null = cells[:, 0] == 0
    if cells.size and cells.max() < 128 and not (cells[~null] == 0).any():
        # plain ASCII without a zero byte within, as the sink writes it
        whole = pa.FixedSizeBinaryArray.from_buffers(pa.binary(cells.shape[1]), len(raw), [None, pa.py_buffer(cells)]).cast(pa.binary()).cast(pa.string())
        return pc.utf8_rtrim(pc.if_else(pa.array(null), None, whole) if null.any() else whole, " ")
    # a zero byte ends a string
    data = [None if n else x.split(b"\0", 1)[0] for x, n in zip(raw.tolist(), null.tolist())]
    try:
        return pc.utf8_rtrim(pa.array(data, type=pa.binary()).cast(pa.string()), " ")
    except pa.ArrowInvalid:
        return pc.utf8_rtrim(pa.array([x if x is None else x.decode("utf-8", "replace") for x in data], type=pa.string()), " ")


def decode(column: Column, raw: np.ndarray) -> pa.Array:
    """Cells as the file has them to values."""
    if column.code == "A":
        return _strings(raw)
    kind = ARROW[column.element]
    flat = raw.reshape(-1)
    if column.code == "L":
        cells = pa.array(flat == ord("T"), mask=flat == 0)
    else:
        null = flat == column.null if column.null is not None and column.code in "BIJK" else None
        if isinstance(column.element, T.DecimalType):
            cells = pa.array([None if null is not None and null[i] else Decimal(x + (1 << 63)) for i, x in enumerate(flat.tolist())], type=kind)
        elif (column.scale, column.zero) == (1, 0):
            # in the machine's order of bytes
            cells = pa.array(flat.astype(flat.dtype.newbyteorder("=")), mask=null).cast(kind)
        elif isinstance(column.element, T.DoubleType):
            cells = pa.array(flat.astype(np.float64) * column.scale + column.zero, mask=null)
        else:
            cells = pa.array(flat.astype(np.int64) + int(column.zero), mask=null).cast(kind)
    if column.repeat == 1:
        return cells
    return pa.ListArray.from_arrays(pa.array(np.arange(len(raw) + 1, dtype=np.int32) * column.repeat), cells)


def _passes(f: ds.Filter, cells: pa.Array) -> pa.Array | None:
    """Which cells pass a pushed filter, as Spark compares: NaN is above all numbers. None if it isn't one of those that are known."""
    if isinstance(f, ds.IsNotNull):
        return cells.is_valid()
    if isinstance(f, ds.IsNull):
        return cells.is_null()
    compared = {ds.EqualTo: pc.equal, ds.GreaterThan: pc.greater, ds.GreaterThanOrEqual: pc.greater_equal, ds.LessThan: pc.less, ds.LessThanOrEqual: pc.less_equal}.get(type(f))
    if compared is None or f.value is None or f.value != f.value or not isinstance(f.value, bool | int | float | str):
        return None
    if pa.types.is_floating(cells.type):
        cells = cells.cast(pa.float64())
        passed = compared(cells, pa.scalar(float(f.value), pa.float64()))
        return pc.or_(passed, pc.is_nan(cells)) if isinstance(f, ds.GreaterThan | ds.GreaterThanOrEqual) else passed
    if pa.types.is_nested(cells.type) or pa.types.is_decimal(cells.type) or isinstance(f.value, str) != pa.types.is_string(cells.type):
        return None
    return compared(cells, pa.scalar(f.value))


class FitsReader(ds.DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.layout = Layout(options)
        self.names, self.kinds = schema.names, [_arrow(f.dataType) for f in schema.fields]
        self.filters: list[ds.Filter] = []

    def partitions(self) -> list[RowRange]:
        out: list[RowRange] = []
        for path, found in self.layout.files():
            rows = found[0].rows
            if any(u.rows != rows for u in found):
                raise ValueError(f"units of {path} differ in rows: {[(u.name, u.rows) for u in found]}")
            sources = [Source(u.start, u.row_bytes, list(chosen.values())) for u, chosen in zip(found, self.layout.chosen(path, found))]
            step = max(1, self.layout.partition_bytes // max(1, sum(u.row_bytes for u in found)))
            out += [RowRange(path, i, min(i + step, rows), sources) for i in range(0, rows, step)]
        return out or [RowRange("", 0, 0, [])]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        """Chunks of rows: first the columns that filters look at, then, of rows that pass, the others. Units without such rows aren't read."""
        if not partition.path:
            return
        system, place = opened(partition.path)
        step = max(1, 4_000_000 // max(1, max(s.row_bytes for s in partition.sources)))
        wanted = [f for f in self.filters if hasattr(f, "attribute") and len(f.attribute) == 1]
        with system.open_input_file(place) as f:
            for first in range(partition.first, partition.last, step):
                n = min(step, partition.last - first)
                rows, cells = None, {}
                held: list[np.ndarray | None] = [None] * len(partition.sources)

                def column(i: int, c: Column, held=held, first=first, n=n) -> np.ndarray:
                    s = partition.sources[i]
                    if held[i] is None:
                        kind = np.dtype({"names": [x.name for x in s.columns], "formats": [x.stored for x in s.columns], "offsets": [x.offset for x in s.columns], "itemsize": s.row_bytes})
                        held[i] = np.frombuffer(f.read_at(n * s.row_bytes, s.start + first * s.row_bytes), dtype=kind)
                    return held[i][c.name]

                mask = np.ones(n, dtype=bool)
                for i, s in enumerate(partition.sources):
                    for c in s.columns:
                        if own := [x for x in wanted if x.attribute[0].lower() == c.name.lower()]:
                            cells[c.name] = decode(c, column(i, c))
                            for x in own:
                                if (passed := _passes(x, cells[c.name])) is not None:
                                    mask &= pc.fill_null(passed, False).to_numpy(zero_copy_only=False)
                    if not mask.any():
                        break
                if not mask.any():
                    continue
                rows = None if mask.all() else np.flatnonzero(mask)
                for i, s in enumerate(partition.sources):
                    for c in s.columns:
                        if c.name in cells:
                            cells[c.name] = cells[c.name] if rows is None else cells[c.name].take(pa.array(rows))
                        else:
                            raw = column(i, c)
                            cells[c.name] = decode(c, raw if rows is None else raw[rows])
                at = first + (np.arange(n) if rows is None else rows)
                cells |= {"file_name": pa.array([partition.path] * len(at)), "row_index": pa.array(at, type=pa.int64())}
                yield pa.RecordBatch.from_arrays([cells[x] if x in cells else pa.nulls(len(at), t) for x, t in zip(self.names, self.kinds)], names=self.names)


class FilteringReader(FitsReader):
    def pushFilters(self, filters: list[ds.Filter]):  # noqa: N802  the interface's name
        """Filters are used to leave rows out early, and Spark applies all of them again."""
        self.filters = filters
        return filters


class Layout:
    """What is asked of which files."""

    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.asked: list[tuple[str | None, list[str] | None]] = [tuple(x) for x in json.loads(options.get("units", "[[null, null]]"))]
        self.row_id = options.get("row_id", "false").lower() == "true"
        self.partition_bytes = int(options.get("partition_bytes", 64 << 20))
        self._files: list[tuple[str, list[Unit]]] = []

    def files(self) -> list[tuple[str, list[Unit]]]:
        if not self._files:
            with ThreadPoolExecutor(16) as pool:
                self._files = list(zip(self.paths, pool.map(lambda p: [unit_of(p, u) for u, _ in self.asked], self.paths)))
        return self._files

    def chosen(self, path: str, found: list[Unit]) -> list[dict[str, Column]]:
        """Of each unit the columns asked for, in the file's order. A missing one is an error in a single file; among several it is null where it is missing."""
        out = []
        for unit, (name, columns) in zip(found, self.asked):
            upper = None if columns is None else {c.upper() for c in columns}
            if columns is not None and len(self.paths) == 1 and (missing := upper - {c.upper() for c in unit.columns}):
                raise ValueError(f"no such columns in {unit.name or name} of {path}: {sorted(missing)}")
            out.append({n: c for n, c in unit.columns.items() if upper is None or n.upper() in upper})
            if bad := [c.name for c in out[-1].values() if c.code not in TYPES]:
                raise ValueError(f"columns of a kind that isn't read: {bad}")
        return out

    def schema(self) -> T.StructType:
        """Columns of all files in the order they are met; one name with two types or in two units is an error."""
        kinds: dict[str, T.DataType] = {}
        of: dict[str, int] = {}
        for path, found in self.files():
            for i, columns in enumerate(self.chosen(path, found)):
                for n, c in columns.items():
                    if kinds.setdefault(n, c.type) != c.type:
                        raise ValueError(f"{n} has two types: {kinds[n].simpleString()} and, in {path}, {c.type.simpleString()}")
                    if of.setdefault(n, i) != i:
                        raise ValueError(f"columns stand in more than one table: ['{n}']")
        if missing := {c.upper() for _, columns in self.asked for c in columns or ()} - {n.upper() for n in kinds}:
            raise ValueError(f"no such columns: {sorted(missing)}")
        place = [T.StructField("file_name", T.StringType()), T.StructField("row_index", T.LongType())] if self.row_id else []
        return T.StructType([*place, *[T.StructField(n, t) for n, t in kinds.items()]])


def _arrow(kind: T.DataType) -> pa.DataType:
    return pa.list_(ARROW[kind.elementType]) if isinstance(kind, T.ArrayType) else ARROW[kind]


# --- writing -------------------------------------------------------------------------------------
@dataclass
class Part(ds.WriterCommitMessage):
    partition: int
    files: list[tuple[str, int]]


class FitsWriter(ds.DataSourceArrowWriter):
    """Tasks write whole files of their own to a folder beside the target; the commit moves them to the target's folder, or joins them in one file.

    A failed or repeated task's file is named by no message and goes with that folder (in an object store, which has no folders, a file of
    a task that outlives an aborted write may stay). One file is joined by whoever commits, a few
    megabytes at a time; a folder of files needs no joining and is what large products should be written to.
    """

    MOST = 64 << 20

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        columns = {x[0]: Column(*x) for x in json.loads(options["layout"])}
        named = json.loads(options["units"]) if "units" in options else {options.get("unit", ""): list(columns)}
        #: Of each unit of a file its name and columns.
        self.units = [(name, [columns[c] for c in held]) for name, held in named.items()]
        self.keywords = json.loads(options.get("keywords", "{}"))
        #: Where each value of a column has a file of its own: the column, the names of files by value, and how many rows each has.
        self.by, self.named, self.told = options.get("by"), options.get("names", ""), {int(k): n for k, n in json.loads(options.get("told", "{}")).items()}
        self.single = self.path.endswith(".fits")
        self.staging = f"{self.path}._parts-{uuid.uuid4().hex}"
        self.row_bytes = [sum(np.dtype(c.stored).itemsize for c in columns) for _, columns in self.units]
        if self.single and len(self.units) > 1:
            raise ValueError("a file of several units is a task's own: write them to a folder")
        # made here, on the driver: a task that is still running when the write is aborted then finds no folder to write to
        system, place = opened(self.staging)
        system.create_dir(place, recursive=True)

    def head(self, rows: int, at: int = 0) -> bytes:
        name, columns = self.units[at]
        cards = [card("XTENSION", "BINTABLE"), card("BITPIX", 8), card("NAXIS", 2), card("NAXIS1", self.row_bytes[at]), card("NAXIS2", rows), card("PCOUNT", 0), card("GCOUNT", 1), card("TFIELDS", len(columns))]
        for i, c in enumerate(columns, 1):
            cards += [card(f"TTYPE{i}", c.name), card(f"TFORM{i}", f"{c.repeat}{c.code}")]
            if c.zero:
                cards += [card(f"TSCAL{i}", 1), card(f"TZERO{i}", int(c.zero))]
            if c.null is not None:
                cards.append(card(f"TNULL{i}", c.null))
        return block([*cards, *([card("EXTNAME", name)] if name else []), *[card(k, v) for k, v in self.keywords.items()]])

    def _cells(self, c: Column, cells: pa.Array) -> np.ndarray:
        if c.code == "A":
            if c.repeat and len(cells) and pc.all(pc.string_is_ascii(cells)).as_py() is not False:
                whole = pc.fill_null(pc.ascii_rpad(cells, c.repeat), "\0" * c.repeat).cast(pa.binary()).cast(pa.binary(c.repeat))
                return np.frombuffer(whole.buffers()[1], dtype=f"S{c.repeat}")[whole.offset : whole.offset + len(whole)]
            out = cells.cast(pa.binary()).to_pylist()
            return np.array([b"\0" * c.repeat if x is None else x.ljust(c.repeat) for x in out], dtype=f"S{c.repeat}" if c.repeat else "S1")
        if c.repeat != 1:
            if cells.null_count:
                raise ValueError(f"{c.name}: a null array has no place in a table of fixed width")
            return self._cells(Column(c.name, c.code, 1, 0, c.null, c.scale, c.zero), cells.flatten()).reshape(len(cells), c.repeat)
        if c.code == "L":
            return np.array([0 if x is None else ord("T") if x else ord("F") for x in cells.to_pylist()], dtype=np.uint8)
        if c.code in "ED":
            return pc.fill_null(cells, float("nan")).to_numpy(zero_copy_only=False).astype(CODES[c.code])
        if c.null is not None and pc.any(pc.equal(cells, c.null)).as_py():
            raise ValueError(f"{c.name}: {c.null} stands for null and is a value too")
        filled = pc.fill_null(cells, c.null + int(c.zero) if c.null is not None else 0).to_numpy(zero_copy_only=False)
        return (filled.astype(np.int64) - int(c.zero)).astype(CODES[c.code])

    def _table(self, batch: pa.RecordBatch, at: int = 0) -> bytes:
        _, columns = self.units[at]
        table = np.zeros(batch.num_rows, dtype=np.dtype([(c.name, c.stored) for c in columns]))
        for c in columns:
            table[c.name] = self._cells(c, batch.column(c.name))
        return table.tobytes()

    def _write_each(self, iterator: Iterator[pa.RecordBatch], partition: int) -> Part:
        """Files of one value each, as rows come in its order: heads name the rows told beforehand, so nothing is held."""
        system, staging = opened(self.staging)
        files, out, held, rows = [], None, None, 0

        def close() -> None:
            if out is not None:
                with out:
                    if rows != self.told.get(held):
                        raise ValueError(f"{rows} rows of {self.by} {held} came together, of {self.told.get(held)}")
                    out.write(b"\0" * (-rows * self.row_bytes[0] % BLOCK))
                files.append((name, rows))

        for batch in iterator:
            values = batch.column(self.by).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])).tolist() if len(values) else []
            for at, end in zip(starts, [*starts[1:], len(values)]):
                if out is None or values[at] != held:
                    close()
                    held, rows = int(values[at]), 0
                    name = f"{partition:06d}-{uuid.uuid4().hex[:8]}-{self.named.format(held)}"
                    out = system.open_output_stream(f"{staging}/{name}")
                    out.write(PRIMARY + self.head(self.told.get(held, 0)))
                out.write(self._table(batch.slice(at, end - at)))
                rows += end - at
        close()
        return Part(partition, files)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        context = TaskContext.get()
        if self.by:
            return self._write_each(iterator, context.partitionId() if context else 0)
        partition, files, rows = context.partitionId() if context else 0, [], 0
        held: list[list[bytes]] = [[] for _ in self.units]
        system, staging = opened(self.staging)

        def flush() -> None:
            nonlocal rows
            name = f"part-{partition:06d}-{len(files):04d}-{uuid.uuid4().hex[:8]}.fits"
            with system.open_output_stream(f"{staging}/{name}") as out:
                out.write(PRIMARY)
                for i, own in enumerate(held):
                    out.write(self.head(rows, i))
                    for x in own:
                        out.write(x)
                    out.write(b"\0" * (-rows * self.row_bytes[i] % BLOCK))
                    own.clear()
            files.append((name, rows))
            rows = 0

        for batch in iterator:
            if not batch.num_rows:
                continue
            for i, own in enumerate(held):
                own.append(self._table(batch, i))
            rows += batch.num_rows
            if rows * sum(self.row_bytes) >= self.MOST:
                flush()
        if rows:
            flush()
        return Part(partition, files)

    def commit(self, messages: list[Part | None]) -> None:
        system, target = opened(self.path)
        staging = opened(self.staging)[1]
        parts = [x for m in sorted((m for m in messages if m), key=lambda m: m.partition) for x in m.files]
        try:
            if not self.overwrite and system.get_file_info(target).type != arrow_fs.FileType.NotFound:
                raise FileExistsError(self.path)
            if self.single:
                self._join(system, target, staging, parts)
            else:
                system.create_dir(target, recursive=True)
                for old in system.get_file_info(arrow_fs.FileSelector(target)):
                    if old.base_name.endswith(".fits"):
                        system.delete_file(old.path)
                if not parts:
                    with system.open_output_stream(f"{target}/part-empty.fits") as out:
                        out.write(PRIMARY + b"".join(self.head(0, i) for i in range(len(self.units))))
                for name, _ in parts:
                    system.move(f"{staging}/{name}", f"{target}/{name.split('-', 2)[2] if self.by else name}")
        finally:
            self.abort([])

    def _join(self, system, target: str, staging: str, parts: list[tuple[str, int]]) -> None:
        new = f"{target}.new-{uuid.uuid4().hex[:8]}"
        system.create_dir(target.rsplit("/", 1)[0], recursive=True)
        rows = sum(n for _, n in parts)
        with system.open_output_stream(new) as out:
            out.write(PRIMARY + self.head(rows))
            for name, n in parts:
                with system.open_input_file(f"{staging}/{name}") as f:
                    at, end = len(PRIMARY) + len(self.head(n)), len(PRIMARY) + len(self.head(n)) + n * self.row_bytes[0]
                    while at < end:
                        data = f.read_at(min(8 << 20, end - at), at)
                        out.write(data)
                        at += len(data)
            out.write(b"\0" * (-rows * self.row_bytes[0] % BLOCK))
        system.move(new, target)

    def abort(self, messages: list[Part | None]) -> None:
        system, staging = opened(self.staging)
        if system.get_file_info(staging).type != arrow_fs.FileType.NotFound:
            system.delete_dir(staging)


class Fits(ds.DataSource):
    """``spark.read.format("fits")`` and ``df.write.format("fits")``; ``read`` and ``write`` below set the options."""

    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self) -> T.StructType:
        return Layout(self.options).schema()

    def reader(self, schema: T.StructType) -> FitsReader:
        return (FilteringReader if self.options.get("pushdown") == "true" else FitsReader)(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> FitsWriter:
        return FitsWriter(dict(self.options), overwrite)


def read(spark: SparkSession, *paths: str, units: str | dict[str, list[str] | None] | None = None, columns: list[str] | None = None, row_id: bool = False, partition_bytes: int = 64 << 20) -> DataFrame:
    """Rows of a table in one or several files, by default of the first table of each; only ``columns`` are decoded.

    ``units`` as a dict (name -> columns, None for all) reads several units of the same files side by side by the position of their rows: a task reads the
    same range of rows from each, so nothing is joined or shuffled. ``row_id`` adds file_name (the whole path) and row_index. Where the
    session has spark.sql.python.filterPushdown.enabled, simple filters leave rows out before the other columns are decoded.
    """
    spark.dataSource.register(Fits)
    asked = [[n, c] for n, c in units.items()] if isinstance(units, dict) else [[units, columns]]
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("fits").options(paths=json.dumps(paths), units=json.dumps(asked), row_id=str(row_id).lower(), partition_bytes=str(partition_bytes), pushdown=push).load()


def layout_of(df: DataFrame) -> list[Column]:
    """The columns of a table as a file has them: widths of strings and arrays and the need for null values, from one aggregate over the rows."""
    codes = {"boolean": ("L", 0), "tinyint": ("B", -128), "smallint": ("I", 0), "int": ("J", 0), "bigint": ("K", 0), "float": ("E", 0), "double": ("D", 0), "string": ("A", 0)}
    aggregates = []
    for i, (name, kind) in enumerate(df.dtypes):
        inner = kind[6:-1] if kind.startswith("array<") else kind
        if inner not in codes or (inner == "string" and inner != kind):
            raise ValueError(f"{name}: {kind} has no place in a table of fixed width")
        c = F.col(f"`{name}`")
        if inner != kind:
            aggregates += [F.max(F.size(c)).alias(f"w{i}"), F.min(F.size(c)).alias(f"v{i}"), F.max(F.exists(c, lambda x: x.isNull())).alias(f"n{i}")]
        elif kind == "string":
            aggregates.append(F.max(F.octet_length(c)).alias(f"w{i}"))
        else:
            aggregates.append(F.max(c.isNull()).alias(f"n{i}"))
    told, out, offset = df.agg(*aggregates).first().asDict(), [], 0
    for i, (name, kind) in enumerate(df.dtypes):
        code, zero = codes[kind[6:-1] if kind.startswith("array<") else kind]
        repeat = 1
        if kind.startswith("array<"):
            repeat = told[f"w{i}"] or 0
            if repeat != (told[f"v{i}"] or 0):
                raise ValueError(f"{name}: arrays of {told[f'v{i}']} to {repeat} elements have no place in a table of fixed width")
        elif kind == "string":
            repeat = max(1, told[f"w{i}"] or 0)
        null = {"B": 0, "I": -(1 << 15), "J": -(1 << 31), "K": -(1 << 63)}.get(code) if told.get(f"n{i}") else None
        out.append(Column(name, code, repeat, offset, null, 1, zero))
        offset += np.dtype(out[-1].stored).itemsize
    return out


def write(df: DataFrame, path: str, *, unit: str = "CATALOG", units: dict[str, list[str]] | None = None, keywords: dict | None = None, order: list[str] | None = None, overwrite: bool = True) -> None:
    """A table to one file (a path that ends in .fits) or to a folder of files, a file a task.

    ``units`` (name -> columns) in place of ``unit`` makes several tables of the columns, side by side in each file of a folder.
    Strings are padded to the longest; null strings become zero bytes, null integers the smallest value of their type (an error if it is a
    value too), null logicals zero, null floats NaN, which reads back as NaN. An empty table gives a table without rows. The rows are
    gone through once for the widths before they are written. Nothing is left of a failed write.
    """
    df.sparkSession.dataSource.register(Fits)
    rows = df.orderBy(*order) if order else df
    told = json.dumps([[c.name, c.code, c.repeat, c.offset, c.null, c.scale, c.zero] for c in layout_of(df)])
    named = {"unit": unit} if units is None else {"units": json.dumps(units)}
    rows.write.format("fits").options(path=path, layout=told, keywords=json.dumps(keywords or {}), **named).mode("overwrite" if overwrite else "append").save()


def write_each(df: DataFrame, folder: str, by: str, names: str, *, unit: str = "CATALOG", keywords: dict | None = None) -> None:
    """A file for each value of a whole-number column, which the files leave out, named by ``names`` (a format of the value), all by one job.

    Rows are dealt by the value, and a task writes its files one after the other as their rows come, so that nothing is held; the values and their
    numbers of rows come to the driver, which moves as many files.
    """
    df.sparkSession.dataSource.register(Fits)
    told = {r[0]: r[1] for r in df.groupBy(by).count().collect()}
    if None in told:
        raise ValueError(f"{by}: rows without a value have no file")
    layout = json.dumps([[c.name, c.code, c.repeat, c.offset, c.null, c.scale, c.zero] for c in layout_of(df.drop(by))])
    rows = df.repartition(max(1, len(told)), by).sortWithinPartitions(by)
    rows.write.format("fits").options(path=folder, layout=layout, keywords=json.dumps(keywords or {}), unit=unit, by=by, names=names, told=json.dumps(told)).mode("overwrite").save()


def join_units(path: str, parts: list[str]) -> None:
    """One file with the tables of several, a few megabytes at a time."""
    system, place = opened(path)
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(place) as out:
        out.write(PRIMARY)
        for part in parts:
            at = units(part)[0].start
            with system.open_input_file(opened(part)[1]) as f:
                while data := f.read_at(min(8 << 20, f.size() - at), at):
                    out.write(data)
                    at += len(data)
