"""A Spark data source for Common Data Format files (version 3), and its TT2000 times.

``spark.read.format("cdf").option("variables", "a,b").load(path)`` gives a row per record:
path, record and a column per variable. Headers are read on the driver, records in tasks, a
range of records each; only the blocks that hold the range and the variables asked for are read.
"""

from __future__ import annotations

import glob
import io
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the format: first words of a file, kinds of records, codes of types and byte orders.
PLAIN, SQUEEZED, WHOLE = 0xCDF30001, 0xCCCC0001, 0x0000FFFF
GZIP = 5
VXR, VVR, CVVR = 6, 7, 13
TYPES = {1: "i1", 2: "i2", 4: "i4", 8: "i8", 11: "u1", 12: "u2", 14: "u4", 21: "f4", 22: "f8", 31: "f8", 33: "i8", 41: "i1", 44: "f4", 45: "f8", 51: "S", 52: "S"}
LITTLE = (4, 6, 13, 16, 17, 19)

#: Days (UTC) from which TAI - UTC is 10, 11, ... seconds; fixed values.
LEAP_DAYS = (
    "1972-01-01", "1972-07-01", "1973-01-01", "1974-01-01", "1975-01-01", "1976-01-01", "1977-01-01", "1978-01-01", "1979-01-01", "1980-01-01",
    "1981-07-01", "1982-07-01", "1983-07-01", "1985-07-01", "1988-01-01", "1990-01-01", "1991-01-01", "1992-07-01", "1993-07-01", "1994-07-01",
    "1996-01-01", "1997-07-01", "1999-01-01", "2006-01-01", "2009-01-01", "2012-07-01", "2015-07-01", "2017-01-01",
)
#: Unix nanoseconds of 2000-01-01 12:00 terrestrial time, where 32 leap seconds had passed.
EPOCH = 946_727_935_816_000_000
SECOND = 1_000_000_000


def _leap_starts() -> list[int]:
    """Unix nanoseconds from which each count of leap seconds holds."""
    return [int(datetime.fromisoformat(d).replace(tzinfo=timezone.utc).timestamp()) * SECOND for d in LEAP_DAYS]


def tt2000_to_unix_ns(tt: Column) -> Column:
    """Unix nanoseconds of TT2000 times; an inserted second counts as the first of the next day, times before 1972 as with 10 s."""
    starts = [at - EPOCH + (10 + i - 32) * SECOND for i, at in enumerate(_leap_starts())]
    return tt + EPOCH - _leaps(tt, starts) * SECOND


def unix_ns_to_tt2000(ns: Column) -> Column:
    """The inverse of ``tt2000_to_unix_ns`` outside inserted seconds."""
    return ns - EPOCH + _leaps(ns, _leap_starts()) * SECOND


def _leaps(at: Column, starts: list[int]) -> Column:
    """Leap seconds since 2000 at a time; null for null."""
    passed = F.filter(F.array(*[F.lit(s) for s in starts]), lambda s: s <= at)
    return F.when(at.isNotNull(), F.greatest(F.size(passed), F.lit(1)).cast("long") - 1 + (10 - 32))


@dataclass
class Variable:
    name: str
    kind: int
    elements: int
    last: int
    index: int
    squeezed: bool
    varies: bool
    shape: tuple[int, ...]

    @property
    def width(self) -> int:
        """Values in a record."""
        return int(np.prod(self.shape, dtype=int))

    def dtype(self, little: bool) -> np.dtype:
        code = TYPES[self.kind]
        return np.dtype(f"S{self.elements}" if code == "S" else ("<" if little else ">") + code)


class CdfFile:
    """Header, variables and records of an open file."""

    def __init__(self, path: str):
        self.path = path
        self.file = open(path, "rb")
        magic, form = self._at(0, ">II")
        if magic not in (PLAIN, SQUEEZED):
            self.file.close()
            raise ValueError(f"{path} is no CDF file of version 3")
        if form != WHOLE:
            self._unpack()
        gdr, _, _, encoding, flags = self._at(20, ">qiiii")
        if gdr <= 0:
            raise ValueError(f"{path} has a damaged header")
        self.little, self.row_major = encoding in LITTLE, bool(flags & 1)
        r_head, z_head = self._at(gdr + 12, ">qq")
        r_dims = self._at(gdr + 56, ">i")[0]
        r_shape = self._at(gdr + 84, f">{r_dims}i")
        found = [*self._variables(r_head, r_shape), *self._variables(z_head, None)]
        self.variables = {v.name: v for v in found}

    def __enter__(self) -> CdfFile:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def _at(self, offset: int, form: str) -> tuple:
        self.file.seek(offset)
        data = self.file.read(struct.calcsize(form))
        if len(data) < struct.calcsize(form):
            raise ValueError(f"{self.path} ends too early")
        return struct.unpack(form, data)

    def _unpack(self) -> None:
        """Replace a file that is compressed as a whole by its plain bytes."""
        size, _, cpr = self._at(8, ">qiq")
        if self._at(cpr + 12, ">i")[0] != GZIP:
            raise ValueError(f"{self.path} is compressed in another way than gzip")
        self.file.seek(8 + 32)
        plain = zlib.decompress(self.file.read(size - 32), 47)
        self.file.close()
        self.file = io.BytesIO(struct.pack(">II", PLAIN, WHOLE) + plain)

    def _variables(self, at: int, shared: tuple[int, ...] | None) -> Iterator[Variable]:
        while at > 0:
            following, kind, last, index = self._at(at + 12, ">qiiq")
            flags = self._at(at + 44, ">i")[0]
            elements, _, packing = self._at(at + 64, ">iiq")
            name = self._at(at + 84, "256s")[0].split(b"\0")[0].decode().strip()
            place, shape = at + 340, shared
            if shape is None:
                dims = self._at(place, ">i")[0]
                shape, place = self._at(place + 4, f">{dims}i"), place + 4 + 4 * dims
            varying = self._at(place, f">{len(shape)}i")
            if flags & 4 and self._at(packing + 12, ">i")[0] != GZIP:
                raise ValueError(f"{name} is compressed in another way than gzip")
            if kind in TYPES:
                yield Variable(name, kind, elements, last, index, bool(flags & 4), bool(flags & 1), tuple(n for n, v in zip(shape, varying) if v))
            at = following

    def _blocks(self, at: int) -> Iterator[tuple[int, int, int]]:
        """(first, last, offset) of each block of values, through all levels of the index."""
        while at > 0:
            following, room, used = self._at(at + 12, ">qii")
            table = self._at(at + 28, f">{room}i{room}i{room}q")
            for first, last, offset in list(zip(table[:room], table[room : 2 * room], table[2 * room :]))[:used]:
                if self._at(offset + 8, ">i")[0] == VXR:
                    yield from self._blocks(offset)
                else:
                    yield first, last, offset
            at = following

    def records(self, v: Variable, start: int, stop: int) -> list[np.ndarray | None]:
        """Values of the records from ``start`` until before ``stop``, each in row order; None where nothing is stored.

        A variable that doesn't vary has its one record everywhere.
        """
        if not v.varies:
            once = v if v.last < 0 else Variable(**{**vars(v), "varies": True})
            return [*self.records(once, 0, 1)] * (stop - start) if v.last >= 0 else [None] * (stop - start)
        dtype, out = v.dtype(self.little), [None] * (stop - start)
        size = dtype.itemsize * v.width
        for first, last, offset in self._blocks(v.index):
            a, b = max(first, start), min(last + 1, stop)
            if a >= b:
                continue
            kind = self._at(offset + 8, ">i")[0]
            if kind == CVVR:
                length = self._at(offset + 16, ">q")[0]
                self.file.seek(offset + 24)
                data = zlib.decompress(self.file.read(length), 47)[(a - first) * size : (b - first) * size]
            elif kind == VVR:
                self.file.seek(offset + 12 + (a - first) * size)
                data = self.file.read((b - a) * size)
            else:
                raise ValueError(f"{v.name} has a block of kind {kind}")
            if len(data) < (b - a) * size:
                raise ValueError(f"{self.path} ends too early")
            values = np.frombuffer(data, dtype).reshape(b - a, v.width)
            for r, row in enumerate(values, a - start):
                out[r] = row if self.row_major or len(v.shape) < 2 else row.reshape(v.shape, order="F").ravel()
        return out


def _arrow(v: Variable) -> pa.DataType:
    code = TYPES[v.kind][0]
    plain = pa.string() if code == "S" else pa.float64() if code == "f" else pa.int64()
    return pa.list_(plain) if v.shape else plain


def _values(v: Variable, rows: list[np.ndarray | None]) -> pa.Array:
    code = TYPES[v.kind][0]
    to = (lambda row: [x.decode(errors="replace").rstrip() for x in row]) if code == "S" else (lambda row: row.astype("f8" if code == "f" else "i8"))
    made = [None if r is None else to(r) for r in rows]
    return pa.array(made if v.shape else [None if m is None else m[0] for m in made], _arrow(v))


class Records(InputPartition):
    """Records of one file for one task."""

    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class CdfReader(DataSourceReader):
    def __init__(self, paths: list[str], names: list[str], schema: pa.Schema, records: int):
        self.paths, self.names, self.arrow, self.records_each = paths, names, schema, records

    def partitions(self) -> list[Records]:
        parts = []
        for path in self.paths:
            with CdfFile(path) as f:
                total = max((f.variables[n].last + 1 for n in self.names if n in f.variables), default=0)
            parts += [Records(path, a, min(a + self.records_each, total)) for a in range(0, total, self.records_each)]
        return parts or [Records("", 0, 0)]

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        n = partition.stop - partition.start
        if not n:
            return
        with CdfFile(partition.path) as f:
            columns = [pa.array([partition.path] * n), pa.array(range(partition.start, partition.stop), pa.int64())]
            for field in list(self.arrow)[2:]:
                v = f.variables.get(field.name)
                if v is not None and _arrow(v) != field.type:
                    raise ValueError(f"{field.name} has another type in {partition.path}")
                columns.append(pa.nulls(n, field.type) if v is None else _values(v, f.records(v, partition.start, partition.stop)))
        yield pa.RecordBatch.from_arrays(columns, schema=self.arrow)


class CdfSource(DataSource):
    """Options: ``path`` (a file, a folder or a pattern that all executors share), ``variables`` (comma-separated; all that vary if absent), ``records`` a task (64).

    Types come from the first file, in order of path, that has a variable; a file without it
    gives nulls. Records that aren't stored are null; text is cut at its padding; arrays of
    several dimensions are flat, in row order. Variables of the 16-byte time type are left out.
    """

    @classmethod
    def name(cls) -> str:
        return "cdf"

    def _paths(self) -> list[str]:
        path = self.options["path"].removeprefix("file://").removeprefix("file:")
        found = sorted(glob.glob(os.path.join(path, "*.cdf")) if os.path.isdir(path) else glob.glob(path))
        if not found and not os.path.isdir(path):
            raise FileNotFoundError(path)
        return found

    def _fields(self) -> pa.Schema:
        asked = [n.strip() for n in self.options.get("variables", "").split(",") if n.strip()]
        fields: dict[str, pa.DataType] = {}
        for path in self._paths():
            with CdfFile(path) as f:
                for v in f.variables.values():
                    if v.name in asked or not asked and v.varies:
                        fields.setdefault(v.name, _arrow(v))
            if asked and len(fields) == len(set(asked)):
                break
        missing = [n for n in asked if n not in fields]
        if missing:
            raise ValueError(f"no file has {missing}")
        return pa.schema([("path", pa.string()), ("record", pa.int64()), *((n, fields[n]) for n in asked or fields)])

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema

        return from_arrow_schema(self._fields())

    def reader(self, schema) -> CdfReader:
        fields = self._fields()
        return CdfReader(self._paths(), fields.names[2:], fields, int(self.options.get("records", "64")))


def read_cdf(spark: SparkSession, path: str, variables: list[str] | None = None, records: int = 64) -> DataFrame:
    """The records of CDF files; see ``CdfSource``."""
    spark.dataSource.register(CdfSource)
    reader = spark.read.format("cdf").option("records", records)
    return (reader.option("variables", ",".join(variables)) if variables else reader).load(path)


def variable_names(path: str) -> list[str]:
    with CdfFile(path) as f:
        return list(f.variables)


def load_bursts(spark: SparkSession, path: str, kind: str = "dvac", probes: str = "12", records: int = 64) -> DataFrame:
    """(burst_id, i, v, ns): samples of a file's bursts, one a record, with their TT2000 times.

    Kind dvac takes the variable that ends in dvac and the probes; kind vac the difference of
    vac1 and vac2 for probes 12, of vac3 and vac4 for any others. Other kinds are refused.
    """
    if kind not in ("dvac", "vac"):
        raise ValueError("kind must be dvac or vac")
    names = variable_names(path)

    def ending(tail: str) -> str:
        found = [n for n in names if n.lower().endswith(tail.lower())]
        if len(found) != 1:
            raise ValueError(f"{len(found)} variables end in {tail}")
        return found[0]

    voltages = [ending(f"dvac{probes}")] if kind == "dvac" else [ending(f"_vac{p}") for p in ("12" if probes == "12" else "34")]
    times = ending(f"_{kind}_time_series_TT2000")
    rows = read_cdf(spark, path, [*voltages, times], records)
    cells = rows.select(F.col("record").alias("burst_id"), F.posexplode(F.arrays_zip(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate([*voltages, times])])).alias("i", "s"))
    v = F.col("s.c0") if kind == "dvac" else F.col("s.c0") - F.col("s.c1")
    return cells.select("burst_id", "i", v.alias("v"), F.col(f"s.c{len(voltages)}").alias("ns"))
