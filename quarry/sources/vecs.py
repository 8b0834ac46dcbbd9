"""The flat vector formats as Spark data sources: spark.read.format("fvecs") and format("ivecs").

A record is a little-endian uint32 dimension and that many float32 or int32 values; all records of a file have the
dimension of the first.  Reading splits by record ranges; rows are (id, vec) with the record number as id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from quarry.types import VectorError, check_dim

#: Bytes of one read task.
SPLIT_BYTES = 64 << 20


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def record_shape(path: str) -> tuple[int, int]:
    """(records, dimension) of a file, from its first header and its size."""
    fs, at = filesystem(path)
    size = fs.get_file_info(at).size
    if size is None:
        raise VectorError(f"no such file: {path}")
    if size == 0:
        return 0, 0
    if size < 4:
        raise VectorError(f"{path}: truncated header")
    with fs.open_input_file(at) as f:
        dim = check_dim(int(np.frombuffer(f.read_at(4, 0), "<u4")[0]))
    if size % (4 + 4 * dim):
        raise VectorError(f"{path}: {size} bytes are not whole records of dimension {dim}")
    return size // (4 + 4 * dim), dim


def read_records(path: str, first: int, count: int, dim: int, floats: bool) -> np.ndarray:
    """Records first to first + count; an error names a record of another dimension or a non-finite component."""
    fs, at = filesystem(path)
    with fs.open_input_file(at) as f:
        raw = f.read_at(count * (4 + 4 * dim), first * (4 + 4 * dim))
    rows = np.frombuffer(raw, "<u4").reshape(-1, dim + 1)
    wrong = np.flatnonzero(rows[:, 0] != dim)
    if len(wrong):
        raise VectorError(f"{path}: record {first + wrong[0]} has dimension {rows[wrong[0], 0]}, not {dim}")
    values = np.ascontiguousarray(rows[:, 1:]).view("<f4" if floats else "<i4")
    if floats and not np.isfinite(values).all():
        v, c = np.argwhere(~np.isfinite(values))[0]
        raise VectorError(f"{path}: vector {first + v}, component {c} is {values[v, c]}")
    return values


class _Range(InputPartition):
    def __init__(self, first: int, count: int):
        super().__init__((first, count))
        self.first, self.count = first, count


class _Reader(DataSourceReader):
    def __init__(self, path: str, floats: bool):
        self.path, self.floats = path, floats
        self.records, self.dim = record_shape(path)

    def partitions(self) -> list[_Range]:
        step = max(1, SPLIT_BYTES // (4 + 4 * max(self.dim, 1)))
        return [_Range(a, min(step, self.records - a)) for a in range(0, self.records, step)] or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        for at in range(partition.first, partition.first + partition.count, 8192):
            n = min(8192, partition.first + partition.count - at)
            x = read_records(self.path, at, n, self.dim, self.floats)
            kind = pa.float32() if self.floats else pa.int32()
            vec = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * self.dim, pa.int32()), pa.array(x.ravel(), kind))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n), pa.int64()), vec], names=["id", "vec"])


class _Written(WriterCommitMessage):
    def __init__(self, part: str | None, dim: int):
        self.part, self.dim = part, dim


class _Writer(DataSourceWriter):
    """Tasks write parts beside the target; commit joins them in order of partition."""

    def __init__(self, path: str, floats: bool, overwrite: bool):
        self.path, self.floats, self.overwrite = path, floats, overwrite

    def write(self, rows: Iterator) -> _Written:
        from pyspark import TaskContext

        context, dim, f = TaskContext.get(), 0, None
        fs, at = filesystem(self.path)
        part = f"{at}.part-{context.partitionId():06d}-{context.taskAttemptId()}"
        for row in rows:
            vec = np.asarray(row["vec"], "<f4" if self.floats else "<i4")
            if f is None:
                dim, f = check_dim(len(vec)), fs.open_output_stream(part)
            if len(vec) != dim:
                raise VectorError(f"ragged vectors: {len(vec)} after {dim}")
            f.write(np.uint32(dim).astype("<u4").tobytes() + vec.tobytes())
        if f is not None:
            f.close()
        return _Written(part if f is not None else None, dim)

    def commit(self, messages: list[_Written | None]) -> None:
        fs, at = filesystem(self.path)
        done = [m for m in messages if m is not None and m.part]
        if len({m.dim for m in done}) > 1:
            self.abort(messages)
            raise VectorError("ragged vectors")
        if fs.get_file_info(at).type != pafs.FileType.NotFound and not self.overwrite:
            self.abort(messages)
            raise VectorError(f"exists: {self.path}")
        with fs.open_output_stream(f"{at}.tmp") as out:
            for m in sorted(done, key=lambda m: m.part):
                with fs.open_input_stream(m.part) as f:
                    while chunk := f.read(8 << 20):
                        out.write(chunk)
        fs.move(f"{at}.tmp", at)
        self.abort(messages)

    def abort(self, messages: list[_Written | None]) -> None:
        fs, _ = filesystem(self.path)
        for m in messages:
            if m is not None and m.part:
                fs.delete_file(m.part)


class FvecsSource(DataSource):
    floats = True

    @classmethod
    def name(cls) -> str:
        return "fvecs"

    def schema(self) -> str:
        return "id long, vec array<float>"

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"], self.floats)

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], self.floats, overwrite)


class IvecsSource(FvecsSource):
    floats = False

    @classmethod
    def name(cls) -> str:
        return "ivecs"

    def schema(self) -> str:
        return "id long, vec array<int>"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FvecsSource)
    spark.dataSource.register(IvecsSource)


def write_vecs(rows: DataFrame, path: str, kind: str = "fvecs") -> None:
    """Write (id, vec) in order of id as one file; floats as fvecs, ints as ivecs."""
    register(rows.sparkSession)
    rows.repartitionByRange("id").sortWithinPartitions("id").select("id", "vec").write.format(kind).mode("overwrite").save(path)
