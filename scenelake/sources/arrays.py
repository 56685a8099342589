"""NumPy side files: .npy columns aligned by row number, and .npz votes and edges."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from scenelake.sources.records import FileWriter, exact


class _Slice(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


_SPARK = {
    "b": "boolean", "i1": "tinyint", "i2": "smallint", "i4": "int", "i8": "bigint", "u1": "smallint", "u2": "int", "u4": "bigint",
    "f2": "float", "f4": "float", "f8": "double"
}


def _kind(dtype: np.dtype) -> str:
    key = "b" if dtype.kind == "b" else dtype.str[1:]
    if key not in _SPARK:
        raise ValueError(f"array type {dtype} is not supported")
    return _SPARK[key]


class _Reader(DataSourceReader):
    def __init__(self, path: str, rows: int, index: str):
        self.path, self.rows, self.index = path, rows, index
        self.n = len(np.load(path, mmap_mode="r"))

    def partitions(self):
        return [_Slice(a, min(self.n, a + self.rows)) for a in range(0, self.n, self.rows)] or [_Slice(0, 0)]

    def read(self, part):
        data = np.load(self.path, mmap_mode="r")
        for first in range(part.first, part.last, 65_536):
            rows = np.array(data[first : min(first + 65_536, part.last)])
            if rows.dtype.kind == "u":
                rows = rows.astype({1: np.int16, 2: np.int32, 4: np.int64}[rows.dtype.itemsize])
            if rows.dtype == np.float16:
                rows = rows.astype(np.float32)
            value = pa.array(rows) if rows.ndim == 1 else pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1]).cast(
                pa.list_(pa.from_numpy_dtype(rows.dtype))
            )
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(rows), dtype=np.int64)), value], [self.index, "value"])


class _Writer(FileWriter):
    def __init__(self, path: str, dtype: str):
        super().__init__(path)
        self.dtype = dtype

    def encode(self, batch: pa.RecordBatch) -> bytes:
        return exact(batch.column(0), np.dtype(self.dtype), "value").tobytes()

    def header(self, rows: int) -> bytes:
        out = io.BytesIO()
        np.lib.format.write_array_header_1_0(out, {"descr": np.dtype(self.dtype).str, "fortran_order": False, "shape": (rows,)})
        return out.getvalue()


class NpyDataSource(DataSource):
    """format("npy"): a 1-D array as scalars, a 2-D one as arrays, with the row number; writes a column as a 1-D array."""

    @classmethod
    def name(cls):
        return "npy"

    def schema(self):
        a = np.load(self.options["path"], mmap_mode="r")
        if a.ndim not in (1, 2):
            raise ValueError(f"an array of {a.ndim} dimensions is no column")
        kind = _kind(a.dtype)
        return f"`{self.options.get('index', 'gaussian_index')}` bigint, value {kind if a.ndim == 1 else f'array<{kind}>'}"

    def reader(self, schema):
        return _Reader(self.options["path"], int(self.options.get("rows", 1_000_000)), self.options.get("index", "gaussian_index"))

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], self.options.get("dtype", "<i4"))


def read_npy(spark: SparkSession, path: str, value: str = "value", index: str = "gaussian_index") -> DataFrame:
    """(index, value) of a side file; to be joined on the row number."""
    spark.dataSource.register(NpyDataSource)
    return spark.read.format("npy").option("path", path).option("index", index).load().withColumnRenamed("value", value)


def read_depth(spark: SparkSession, path: str, frame_index: int) -> DataFrame:
    """(frame_index, px, py, d) of a 2-D depth map."""
    rows = read_npy(spark, path, "row", "py")
    return rows.select(
        F.lit(frame_index).alias("frame_index"), F.col("py").cast("int").alias("py"), F.posexplode("row").alias("px", "d")
    ).withColumn("d", F.col("d").cast("double"))


def _npz(spark: SparkSession, path: str, names: dict[str, str], schema: str) -> DataFrame:
    def run(batches):
        for b in batches:
            for raw in b.column(0).to_pylist():
                with np.load(io.BytesIO(raw)) as z:
                    n = len(z[next(iter(names))])
                    for lo in range(0, n, 65_536):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(z[k][lo : lo + 65_536].astype(t)) for k, t in names.items()], list(names)
                        )

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def read_votes(spark: SparkSession, path: str) -> DataFrame:
    """votes from Parquet, or from an .npz of four parallel arrays."""
    if not path.endswith(".npz"):
        return spark.read.parquet(path)
    raw = _npz(
        spark, path, {"frame_indices": "i4", "instance_ids": "i4", "gaussian_indices": "i8", "weights": "f4"},
        "frame_indices int, instance_ids int, gaussian_indices long, weights float"
    )
    return raw.toDF("frame_index", "instance_id", "gaussian_index", "weight")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Association edges from Parquet or .npz: lhs, rhs, shared, overlap_ratio."""
    if not path.endswith(".npz"):
        return spark.read.parquet(path)
    raw = _npz(
        spark, path, {"lhs_local_index": "i4", "rhs_local_index": "i4", "shared_gaussians": "i4", "overlap_ratio": "f4"},
        "lhs_local_index int, rhs_local_index int, shared_gaussians int, overlap_ratio float"
    )
    return raw.toDF("lhs", "rhs", "shared", "overlap_ratio")


def write_npy(df: DataFrame, path: str, value: str, index: str = "gaussian_index", dtype: str = "<i4") -> None:
    """One column as .npy in index order, written by the executors; a value that ``dtype`` cannot hold is an error."""
    df.sparkSession.dataSource.register(NpyDataSource)
    ordered = df.select(index, value).repartitionByRange(index).sortWithinPartitions(index)
    ordered.select(F.col(value).alias("value")).write.format("npy").option("path", path).option("dtype", dtype).mode("append").save()
