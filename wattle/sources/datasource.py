"""One Spark data source for every text format: typed columns, and a reason for each line not kept.

``spark.read.format("wattle_text").option("kind", "points").load(path)`` gives the columns of
the kind (``KINDS``) plus ``line`` (the text) and ``reason``: null for a line that is kept, else
the first thing that is wrong with it (``fields``: too few of them; or the name of the field that
does not parse). Kept and rejected lines together are all lines of the files.

Files are cut into byte ranges (option ``bytes``, 64 MB), one task each; a range owns the lines
that start in it. A task holds one block of a few MB and parses it column by column with Arrow,
so a range, however long, needs little memory, and a lost task reads its range again. Comparisons of
scalar columns with constants are pushed into the tasks: what fails them does not reach Spark,
and text that nobody asked for is not kept (option ``text``, true: set false for no ``line``).

Paths are local or of a store that Arrow opens (``hdfs``, ``s3``, ``gs``); for others use the
readers of ``text``, which go through Spark.

Defined cases: names that start with ``_`` or ``.`` are no input, an empty folder or file has no line,
an empty line is a line, a last line needs no end; ``\\r\\n`` ends a line like ``\\n``; bytes that are no UTF-8 are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition,
                                    IsNotNull, IsNull, LessThan, LessThanOrEqual)

RANGE_BYTES = 64 << 20
BLOCK_BYTES = 4 << 20

#: kind -> (separator, fields in order: name of the field and how it is read)
KINDS = {
    "readings": ("\t", (("meter_id", "int"), ("day", "stamp"), ("reading", "reading"))),
    "points": ("|", (("meter_id", "point"), ("x", "numbers"))),
    "centroids": ("|", (("cid", "int"), ("c", "numbers"))),
    "shares": ("|", (("cid", "int"), ("share", "number"), ("c", "numbers"))),
    "tagged": ("|", (("cid", "int"), ("original", "numbers"), ("shifted", "numbers"))),
    "entropies": ("|", (("meter_id", "int"), ("entropy", "number"))),
    "elbow": ("|", (("k", "int"), ("coverage", "number"), ("ch", "number"))),
    "profiles": ("|", (("meter_id", "int"), ("mean", "numbers"), ("sd", "numbers"))),
}
_TYPES = {"int": "bigint", "number": "double", "reading": "double", "numbers": "array<double>"}
_INT = r"^-?[0-9]{1,18}$"
_NUMBER = r"^(-?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][-+]?[0-9]+)?|NaN|-?Infinity)$"
_READING = r"^-?[0-9]+([.eE][0-9]+)?$"   # what passes the readings' numeric rule and is a number
_STAMP = r"^(?P<day>[0-9]{4}-[0-9]{2}-[0-9]{2}) (?P<hour>[01]?[0-9]|2[0-3])(?::.*)?$"
_POINT = r"^(?P<meter>-?[0-9]{1,18})(?P<day>[0-9]{6})$"


def columns_of(kind: str) -> list[tuple[str, str]]:
    out = []
    for name, how in KINDS[kind][1]:
        if how == "stamp":
            out += [("day", "date"), ("hour", "int")]
        elif how == "point":
            out += [("meter_id", "bigint"), ("day", "date")]
        else:
            out.append((name, _TYPES[how]))
    return out


def _cast(texts, pattern: str, to):
    """The texts that match, as ``to``; null for the others."""
    import pyarrow as pa
    import pyarrow.compute as pc

    good = pc.if_else(pc.match_substring_regex(texts, pattern), texts, pa.scalar(None, pa.string()))
    if pa.types.is_floating(to):
        good = pc.replace_substring(good, "Infinity", "inf")
    return good.cast(to)


def _dates(texts, form: str):
    """Dates of a calendar day; null for others, such as the 31st of April."""
    import pyarrow as pa
    import pyarrow.compute as pc

    t = pc.strptime(texts, form, "s", error_is_null=True)
    same = pc.equal(pc.strftime(t, form), texts)
    return pc.if_else(same, t.cast(pa.date32()), pa.scalar(None, pa.date32()))


def _numbers(texts):
    """Comma-separated numbers as lists; null where one of them is none."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    parts = pc.split_pattern(texts, ",")
    values, owner = _cast(pc.list_flatten(parts), _NUMBER, pa.float64()), pc.list_parent_indices(parts).to_numpy()
    broken = np.bincount(owner[pc.is_null(values).to_numpy(zero_copy_only=False)], minlength=len(texts)) > 0
    return pa.ListArray.from_arrays(parts.offsets, values, mask=pa.array(broken))


def _read(texts, how: str) -> list:
    import pyarrow as pa
    import pyarrow.compute as pc

    if how == "numbers":
        return [_numbers(texts)]
    if how in ("stamp", "point"):
        parts = pc.extract_regex(texts, _STAMP if how == "stamp" else _POINT)
        if how == "stamp":
            return [_dates(pc.struct_field(parts, "day"), "%Y-%m-%d"), pc.struct_field(parts, "hour").cast(pa.int32())]
        day = pc.binary_join_element_wise("20", pc.struct_field(parts, "day"), "")
        return [pc.struct_field(parts, "meter").cast(pa.int64()), _dates(day, "%Y%m%d")]
    return [_cast(texts, {"int": _INT, "number": _NUMBER, "reading": _READING}[how], pa.int64() if how == "int" else pa.float64())]


def parse(lines, kind: str, text: bool = True):
    """Record batch of the columns of ``kind``, ``line`` and ``reason`` from an Arrow array of lines."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    sep, fields = KINDS[kind]
    split = pc.split_pattern(lines, sep)
    enough = np.flatnonzero(pc.list_value_length(split).to_numpy(zero_copy_only=False) >= len(fields))
    back = np.full(len(lines), -1)
    back[enough] = np.arange(len(enough))
    back = pa.array(back, mask=back < 0)
    split = split.take(pa.array(enough))
    reason = pa.nulls(len(enough), pa.string())
    arrays = []
    for i, (name, how) in enumerate(fields):
        made = _read(pc.list_element(split, i) if len(enough) else pa.array([], pa.string()), how)
        for a in made:
            reason = pc.if_else(pc.and_(pc.is_null(reason), pc.is_null(a)), name, reason)
        arrays += made
    kept = pc.is_null(reason)
    arrays = [pc.if_else(kept, a, pa.scalar(None, a.type)).take(back) for a in arrays]   # a rejected line has no values
    reason = pc.if_else(pc.is_null(back), "fields", reason.take(back))
    line = lines if text else pa.nulls(len(lines), pa.string())
    return pa.RecordBatch.from_arrays([*arrays, line, reason], [n for n, _ in columns_of(kind)] + ["line", "reason"])


def _store(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def blocks(path: str, start: int, end: int, block: int = BLOCK_BYTES):
    """Arrow arrays of the lines that start in bytes ``start`` to ``end`` of a file."""
    import pyarrow as pa

    store, name = _store(path)

    def lines(parts):
        return pa.array([p.removesuffix(b"\r").decode("utf-8", "replace") for p in parts], pa.string())

    with store.open_input_file(name) as f:
        at = max(start - 1, 0)      # a line starts at ``start`` if the byte before ends one
        f.seek(at)
        first, rest = start > 0, b""
        while True:
            data = f.read(block)
            if not data:
                break
            rest += data
            if first:
                cut = rest.find(b"\n")
                if cut < 0:
                    at, rest = at + len(rest), b""
                    if at >= end:
                        return
                    continue
                at, rest, first = at + cut + 1, rest[cut + 1:], False
            if at >= end:
                return
            # whole lines of the buffer that start before the end
            last = rest.rfind(b"\n")
            if last < 0:
                continue
            stop = last if at + last < end else rest.find(b"\n", max(end - at - 1, 0))
            parts = rest[:stop].split(b"\n")
            yield lines(parts)
            at, rest = at + stop + 1, rest[stop + 1:]
            if at >= end:
                return
        if rest and not first and at < end:
            yield lines([rest])


_COMPARE = {EqualTo: "equal", GreaterThan: "greater", GreaterThanOrEqual: "greater_equal", LessThan: "less", LessThanOrEqual: "less_equal"}


def _mask(batch, f):
    """Which rows of a batch a pushed filter lets pass (null: not)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = batch.column(f.attribute[0])
    if isinstance(f, IsNull):
        return pc.is_null(column)
    if isinstance(f, IsNotNull):
        return pc.is_valid(column)
    if isinstance(f, In):
        return pc.is_in(column, pa.array(f.value, column.type))
    return pc.call_function(_COMPARE[type(f)], [column, pa.scalar(f.value, column.type)])


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


class TextReader(DataSourceReader):
    def __init__(self, kind: str, path: str, size: int, text: bool):
        self.kind, self.path, self.size, self.text, self.filters = kind, path, size, text, []
        self.exact = {n for n, t in columns_of(kind) if t in ("bigint", "int", "date")} | {"reason"}
        self.known = self.exact | {n for n, _ in columns_of(kind)}

    def pushFilters(self, filters):
        """Comparisons of whole numbers, dates and the reason are done here; the others (numbers
        with fractions, where NaN has an order of Spark's own, text, ``or``) stay with Spark."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            null = isinstance(f, (IsNull, IsNotNull)) and name in self.known
            values = f.value if isinstance(f, In) else (getattr(f, "value", None),)
            if null or (isinstance(f, (In, *_COMPARE)) and name in self.exact and all(v is not None for v in values)):
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        store, name = _store(self.path)
        info = store.get_file_info(name)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == fs.FileType.File:
            files = [(info, "")]
        else:
            found = store.get_file_info(fs.FileSelector(name, recursive=True))
            files = [(i, i.path[len(info.path):].strip("/")) for i in found if i.type == fs.FileType.File]
            files = [(i, rel) for i, rel in files if not any(p[0] in "_." for p in rel.split("/"))]
        ranges = [Range(self.path.rstrip("/") + "/" + rel if rel else self.path, a, min(a + self.size, i.size))
                  for i, rel in sorted(files, key=lambda x: x[1]) for a in range(0, i.size, self.size)]
        return ranges or [Range("", 0, 0)]

    def read(self, part):
        import pyarrow as pa

        for lines in blocks(part.path, part.start, part.end) if part.path else ():
            batch = parse(lines, self.kind, self.text)
            for f in self.filters:
                batch = batch.filter(_mask(batch, f))
            if batch.num_rows:
                yield batch


class TextSource(DataSource):
    @classmethod
    def name(cls):
        return "wattle_text"

    def _kind(self) -> str:
        kind = self.options.get("kind", "")
        if kind not in KINDS:
            raise ValueError(f"unknown kind of text: {kind!r}; one of {', '.join(KINDS)}")
        return kind

    def schema(self):
        return ", ".join(f"{n} {t}" for n, t in [*columns_of(self._kind()), ("line", "string"), ("reason", "string")])

    def reader(self, schema):
        size = int(self.options.get("bytes", RANGE_BYTES))
        if size < 1:
            raise ValueError("bytes is 1 or more")
        return TextReader(self._kind(), self.options["path"], size, self.options.get("text", "true").lower() != "false")


def read(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    """All lines of ``path`` with their columns, ``line`` and ``reason``."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TextSource)
    return spark.read.format("wattle_text").options(kind=kind, **options).load(path)


def kept(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    """The columns of the lines that parse."""
    d = read(spark, path, kind, text="false", **options)
    return d.where("reason is null").drop("line", "reason")


def rejected(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    """``line, reason`` of the lines that do not."""
    return read(spark, path, kind, **options).where("reason is not null").select("line", "reason")
