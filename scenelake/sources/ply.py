"""Binary little-endian PLY vertex tables as a Spark data source, reader and writer.

Records have one length, so a file is split by record range like any splittable format. The file must be on a path that
all executors see; :func:`read_ply` with ``whole=True`` goes through Spark's own file reader instead, for object stores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from scenelake.sources.records import FileWriter, exact

#: PLY scalar types: NumPy code, Spark type. Spark has no unsigned types, so those are widened.
SCALARS = {
    "char": ("<i1", T.ByteType()), "uchar": ("<u1", T.ShortType()), "short": ("<i2", T.ShortType()), "ushort": ("<u2", T.IntegerType()),
    "int": ("<i4", T.IntegerType()), "uint": ("<u4", T.LongType()), "float": ("<f4", T.FloatType()), "double": ("<f8", T.DoubleType()),
}
_ALIASES = {
    "int8": "char", "uint8": "uchar", "int16": "short", "uint16": "ushort", "int32": "int", "uint32": "uint", "float32": "float",
    "float64": "double"
}
INDEX = "gaussian_index"


@dataclass(frozen=True)
class Header:
    count: int
    properties: tuple[tuple[str, str], ...]  # (type, name)
    offset: int

    @property
    def dtype(self) -> np.dtype:
        return np.dtype([(n, SCALARS[t][0]) for t, n in self.properties])

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(INDEX, T.LongType(), False), *(T.StructField(n, SCALARS[t][1]) for t, n in self.properties)])


def parse_header(data: bytes) -> Header:
    """The header of a PLY file from its first bytes; only scalar vertex properties are supported."""
    lines, at = [], 0
    while True:
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("the PLY header has no end")
        lines.append(data[at:end].decode("ascii").strip())
        at = end + 1
        if lines[-1] == "end_header":
            break
    if lines[0] != "ply":
        raise ValueError("not a PLY file")
    count, props, inside, fmt = None, [], False, None
    for line in lines[1:-1]:
        word = line.split()
        if not word or word[0] in ("comment", "obj_info"):
            continue
        if word[0] == "format":
            fmt = word[1:3]
        elif word[0] == "element":
            inside = word[1] == "vertex"
            count = int(word[2]) if inside else count
        elif word[0] == "property" and inside:
            if word[1] == "list":
                raise ValueError(f"list property {word[-1]!r} of vertices is not supported")
            kind = _ALIASES.get(word[1], word[1])
            if kind not in SCALARS:
                raise ValueError(f"unknown PLY type {word[1]!r}")
            props.append((kind, word[2]))
    if fmt != ["binary_little_endian", "1.0"]:
        raise ValueError(f"PLY format {fmt} is not binary_little_endian 1.0")
    if count is None:
        raise ValueError("the PLY file has no vertex element")
    return Header(count, tuple(props), at)


def read_header(path: str) -> Header:
    with open(path, "rb") as f:
        data = b""
        while b"end_header\n" not in data:
            more = f.read(4096)
            if not more:
                break
            data += more
    return parse_header(data)


def _batch(header: Header, raw: bytes, first: int) -> pa.RecordBatch:
    rows = np.frombuffer(raw, header.dtype)
    arrow = {"uchar": pa.int16(), "ushort": pa.int32(), "uint": pa.int64()}
    cols = [pa.array(np.arange(first, first + len(rows), dtype=np.int64))]
    for t, n in header.properties:
        c = pa.array(np.ascontiguousarray(rows[n]))
        cols.append(c.cast(arrow[t]) if t in arrow else c)
    return pa.RecordBatch.from_arrays(cols, [INDEX, *(n for _, n in header.properties)])


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows
        self.header = read_header(path)

    def partitions(self):
        n = self.header.count
        return [_Range(a, min(n, a + self.rows)) for a in range(0, n, self.rows)] or [_Range(0, 0)]

    def read(self, part):
        size = self.header.dtype.itemsize
        with open(self.path, "rb") as f:
            f.seek(self.header.offset + part.first * size)
            for first in range(part.first, part.last, 65_536):
                n = min(65_536, part.last - first)
                raw = f.read(n * size)
                if len(raw) < n * size:
                    raise ValueError(f"{self.path} ends before its {self.header.count} vertices")
                yield _batch(self.header, raw, first)


class _Writer(FileWriter):
    def __init__(self, path: str, properties: list[tuple[str, str]]):
        super().__init__(path)
        self.properties = properties

    def encode(self, batch: pa.RecordBatch) -> bytes:
        dtype = np.dtype([(n, SCALARS[t][0]) for t, n in self.properties])
        out = np.empty(batch.num_rows, dtype)
        for _, n in self.properties:
            out[n] = exact(batch.column(batch.schema.get_field_index(n)), dtype[n], n)
        return out.tobytes()

    def header(self, rows: int) -> bytes:
        lines = [
            "ply", "format binary_little_endian 1.0", f"element vertex {rows}", *(f"property {t} {n}" for t, n in self.properties),
            "end_header"
        ]
        return ("\n".join(lines) + "\n").encode()


class _TextWriter(FileWriter):
    """Lines behind an ASCII header of a position and a byte colour."""

    def encode(self, batch: pa.RecordBatch) -> bytes:
        return "".join(f"{v}\n" for v in batch.column(0).to_pylist()).encode()

    def header(self, rows: int) -> bytes:
        lines = [
            "ply", "format ascii 1.0", f"element vertex {rows}", *(f"property float {c}" for c in "xyz"),
            *(f"property uchar {c}" for c in ("red", "green", "blue")), "end_header"
        ]
        return ("\n".join(lines) + "\n").encode()


class PlyTextDataSource(DataSource):
    """format("plytext"): writes lines; option path."""

    @classmethod
    def name(cls):
        return "plytext"

    def schema(self):
        return "line string"

    def writer(self, schema, overwrite):
        return _TextWriter(self.options["path"])


class PlyDataSource(DataSource):
    """format("ply"): options path, rows (records a partition); writing: properties as "type name, type name"."""

    @classmethod
    def name(cls):
        return "ply"

    def schema(self):
        return read_header(self.options["path"]).schema

    def reader(self, schema):
        return _Reader(self.options["path"], int(self.options.get("rows", 500_000)))

    def writer(self, schema, overwrite):
        told = self.options.get("properties")
        props = [tuple(p.split()) for p in told.split(",")] if told else _properties(schema)
        return _Writer(self.options["path"], props)


#: Columns of whole numbers with these names are bytes, as in files of coloured points.
COLORS = ("red", "green", "blue", "alpha")


def _properties(schema: T.StructType) -> list[tuple[str, str]]:
    """Header types of the columns. PLY has no 64-bit integer: a LONG is written as int, and a value beyond it is an error."""
    kinds = {
        T.ByteType: "char", T.ShortType: "short", T.IntegerType: "int", T.LongType: "int", T.FloatType: "float", T.DoubleType: "double"
    }
    of = lambda f: "uchar" if f.name in COLORS and isinstance(f.dataType, T.IntegralType) else kinds[type(f.dataType)]
    return [(of(f), f.name) for f in schema.fields if f.name != INDEX]


def read_ply(spark: SparkSession, path: str, *, rows: int = 500_000, whole: bool = False) -> DataFrame:
    """gaussian_index and every vertex property in its own type."""
    if whole:
        head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 65_536).alias("h")).first()["h"]
        header = parse_header(bytes(head))

        def run(batches):
            for b in batches:
                for raw in b.column(0).to_pylist():
                    h = parse_header(raw[:65_536])
                    yield _batch(h, raw[h.offset : h.offset + h.count * h.dtype.itemsize], 0)

        return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, header.schema)
    spark.dataSource.register(PlyDataSource)
    return spark.read.format("ply").option("path", path).option("rows", rows).load()


def cloud(table: DataFrame) -> DataFrame:
    """The columns that operators use, as FLOAT; absent optional ones are null."""
    need = ("x", "y", "z")
    if missing := [c for c in need if c not in table.columns]:
        raise ValueError(f"the table has no {missing}")
    optional = ("opacity", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3")
    col = lambda c: (F.col(c) if c in table.columns else F.lit(None)).cast("float").alias(c)
    return table.select(INDEX, *(col(c) for c in (*need, *optional)))


def write_ply(table: DataFrame, path: str, properties: list[tuple[str, str]] | None = None) -> None:
    """Write vertices in order of gaussian_index, with the given header types or those of the columns."""
    spark = table.sparkSession
    spark.dataSource.register(PlyDataSource)
    ordered = table.repartitionByRange(INDEX).sortWithinPartitions(INDEX)
    names = [n for _, n in properties] if properties else [c for c in table.columns if c != INDEX]
    told = properties or _properties(table.schema)
    ordered.select(*names).write.format("ply").option("path", path).option(
        "properties", ",".join(f"{t} {n}" for t, n in told)
    ).mode("append").save()


def write_ascii(table: DataFrame, path: str) -> None:
    """x, y, z and byte colours red, green, blue as an ASCII PLY, in order of gaussian_index."""
    table.sparkSession.dataSource.register(PlyTextDataSource)
    ordered = table.repartitionByRange(INDEX).sortWithinPartitions(INDEX)
    line = F.concat_ws(
        " ", *(F.format_string("%.6f", F.col(c).cast("double")) for c in "xyz"),
        *(F.col(c).cast("int").cast("string") for c in ("red", "green", "blue"))
    )
    ordered.select(line.alias("line")).write.format("plytext").option("path", path).mode("append").save()
