"""Writing of one file from many tasks: records in row order behind a header that tells their number."""

from __future__ import annotations

import os
import shutil
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage


@dataclass
class _Part(WriterCommitMessage):
    number: int
    name: str
    rows: int


class FileWriter(DataSourceArrowWriter):
    """Each task writes its records to a file of its own, in a folder beside the output, which is on a path that the driver
    and all executors see; the commit puts the files behind the header in partition order, in blocks, never row by row."""

    def __init__(self, path: str):
        self.path = path
        self.folder = f"{path}.{uuid.uuid4().hex}"

    def encode(self, batch: pa.RecordBatch) -> bytes:
        raise NotImplementedError

    def header(self, rows: int) -> bytes:
        raise NotImplementedError

    def write(self, batches):
        from pyspark import TaskContext

        ctx = TaskContext.get()
        os.makedirs(self.folder, exist_ok=True)
        name = f"{self.folder}/{ctx.partitionId()}-{ctx.taskAttemptId()}"
        rows = 0
        with open(name, "wb") as f:
            for b in batches:
                f.write(self.encode(b))
                rows += b.num_rows
        return _Part(ctx.partitionId(), name, rows)

    def commit(self, messages):
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.number)
        with open(f"{self.folder}.tmp", "wb") as out:
            out.write(self.header(sum(p.rows for p in parts)))
            for p in parts:
                with open(p.name, "rb") as f:
                    shutil.copyfileobj(f, out, 1 << 22)
        os.replace(f"{self.folder}.tmp", self.path)
        shutil.rmtree(self.folder, ignore_errors=True)

    def abort(self, messages):
        shutil.rmtree(self.folder, ignore_errors=True)


def exact(column: pa.Array, dtype: np.dtype, name: str) -> np.ndarray:
    """A column as ``dtype``; a null, or a value that a whole-number type cannot hold, is an error."""
    values = column.to_numpy(zero_copy_only=False)
    if dtype.kind in "iu" and len(values):
        held = np.iinfo(dtype)
        if column.null_count or values.min() < held.min or values.max() > held.max or (
            values.dtype.kind == "f" and (values != np.floor(values)).any()
        ):
            raise ValueError(f"column {name!r} has values that {dtype} cannot hold")
    return values.astype(dtype)
