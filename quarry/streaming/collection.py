"""A durable collection: versioned Parquet snapshots, a log of immutable batches, and a pointer that is moved in place.

Layout below root: ``snapshot/v=N`` (ext_id, level, vec, metadata), ``batches/v=N`` (names of the batches that went into
it), ``log/v=N/batch=B`` and ``current.json`` (version, snapshot_seq, dim, metric, seed, m, rows and checksum of the
snapshot).  A batch is validated before it is logged, so nothing that could not be replayed gets in.  A batch counts once
its folder has Spark's success mark; a crash before it leaves nothing.  Names make batches idempotent, also after a
checkpoint.  A checkpoint writes the next snapshot and moves the pointer last, so a crash leaves the old state.  Opening
repairs: what stands behind a torn record, an unreadable file or a gap is cut off before anything is appended.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import asdict, dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.kernels import level_of
from quarry.functions.scalars import SyncPolicy
from quarry.functions.validate import require_valid
from quarry.sources.vecs import filesystem
from quarry.streaming import log as wal
from quarry.types import MetricKind, VectorError, check_dim


@dataclass(frozen=True)
class State:
    version: int
    snapshot_seq: int
    dim: int
    metric: str
    m: int = 16
    seed: int = 0
    rows: int | None = None
    checksum: int | None = None


SNAPSHOT = "ext_id long, level int, vec array<float>, metadata binary"


class Collection:
    def __init__(self, spark: SparkSession, root: str, repair: bool = True, sync: str = "always"):
        """Open and, unless told not to, repair; ``dropped`` says how many records that cut off.  sync says when batches are
        flushed to a local disk: always, never or every:N batches (a store of objects is durable by itself)."""
        self.spark, self.root, self.sync = spark, root.rstrip("/"), SyncPolicy.parse(sync)
        self.fs, self.path = filesystem(self.root)
        self._sound: set[str] = set()
        self._unsynced: list[str] = []
        with self.fs.open_input_stream(f"{self.path}/current.json") as f:
            self.state = State(**json.loads(f.read()))
        self.dropped = self.repair() if repair else 0

    @classmethod
    def create(cls, spark: SparkSession, root: str, dim: int, metric: str = "l2", m: int = 16, seed: int = 0, sync: str = "always") -> Collection:
        """An empty collection; the snapshot goes first, the pointer last.  An existing one is an error."""
        check_dim(dim)
        root = root.rstrip("/")
        fs, path = filesystem(root)
        if fs.get_file_info(f"{path}/current.json").type != pafs.FileType.NotFound:
            raise VectorError(f"exists: {root}")
        spark.createDataFrame([], SNAPSHOT).write.mode("overwrite").parquet(f"{root}/snapshot/v=0")
        spark.createDataFrame([], "name string, whole boolean").write.mode("overwrite").parquet(f"{root}/batches/v=0")
        fs.create_dir(path, recursive=True)
        cls._point(fs, path, State(0, 0, dim, MetricKind.parse(metric).name.lower(), m, seed, 0, 0))
        return cls(spark, root, sync=sync)

    @staticmethod
    def _point(fs: pafs.FileSystem, path: str, state: State) -> None:
        name = f"{path}/current.{uuid.uuid4().hex}"
        with fs.open_output_stream(name) as f:
            f.write(json.dumps(asdict(state)).encode())
        _flush(fs, [name])
        fs.move(name, f"{path}/current.json")
        _flush(fs, [path])

    def _finished(self) -> list[str]:
        """Names of the batches of the current log that have their success mark."""
        at = f"{self.path}/log/v={self.state.version}"
        if self.fs.get_file_info(at).type == pafs.FileType.NotFound:
            return []
        folders = [x.base_name for x in self.fs.get_file_info(pafs.FileSelector(at)) if x.type == pafs.FileType.Directory]
        return sorted(x for x in folders if self.fs.get_file_info(f"{at}/{x}/_SUCCESS").type == pafs.FileType.File)

    def _batches(self) -> list[str]:
        """The finished batches before the first with a file that can't be read: a truncated file ends the log."""
        names = self._finished()
        for k, name in enumerate(names):
            if name in self._sound:
                continue
            files = self.fs.get_file_info(pafs.FileSelector(f"{self.path}/log/v={self.state.version}/{name}"))
            try:
                for f in files:
                    if f.base_name.endswith(".parquet"):
                        pq.read_metadata(f.path, filesystem=self.fs)
            except (pa.ArrowInvalid, OSError):
                return names[:k]
            self._sound.add(name)
        return names

    def snapshot(self) -> DataFrame:
        return self.spark.read.schema(SNAPSHOT).parquet(f"{self.root}/snapshot/v={self.state.version}")

    def _names(self) -> DataFrame:
        """(name, whole) of the batches that went into the snapshot; not whole: some of its records were cut off."""
        return self.spark.read.schema("name string, whole boolean").parquet(f"{self.root}/batches/v={self.state.version}")

    def _logged(self) -> DataFrame:
        """The log's records with the folder of their batch."""
        names, at = self._batches(), f"{self.root}/log/v={self.state.version}"
        schema = T.StructType([*wal.LOG.fields, T.StructField("batch", T.StringType())])
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", at).parquet(*[f"{at}/{x}" for x in names])

    def log(self) -> DataFrame:
        return self._logged().select(*wal.LOG.names)

    def vectors(self) -> DataFrame:
        """(ext_id, level, vec, metadata) as recovery sees it: snapshot and the log's valid prefix.  Raises on intact but wrong
        records."""
        return wal.applied(self.snapshot(), wal.require_intact(self.log(), self.state.snapshot_seq), self.state.snapshot_seq)

    def recovery(self) -> dict:
        """skipped, replayed, replayed_inserts, next_seq and what ended the log."""
        rows = self.log()
        return {**wal.replay_split(rows, self.state.snapshot_seq).first().asDict(), **wal.first_bad(rows).first().asDict()}

    def repair(self) -> int:
        """Cut the log to its valid prefix, so that appending goes on after it; returns the records dropped (those of a
        file that can't be read aren't known and count as one)."""
        unread = len(self._finished()) - len(self._batches())
        if not unread and not self._batches():
            return 0
        rows = self.log()
        dropped = rows.count() - wal.require_intact(rows, self.state.snapshot_seq).count() + unread
        if dropped:
            self.checkpoint()
        return dropped

    def verify(self) -> int:
        """Read the snapshot in full and hold it against what the pointer says of it; returns its rows."""
        rows, checksum = _content(self.snapshot())
        if self.state.rows is not None and (rows, checksum) != (self.state.rows, self.state.checksum):
            raise VectorError(f"the snapshot has {rows} rows with checksum {checksum}, not {self.state.rows} with {self.state.checksum}")
        require_valid(self.snapshot().select(F.col("ext_id").alias("id"), "vec"), self.state.dim, zero=self.state.metric == "cosine")
        return rows

    def _known(self, batch: str) -> bool | None:
        """Whether a batch of that name is there: whole, in part (False), or not at all."""
        if any(x.split("-", 1)[1] == batch for x in self._batches()):
            return True
        found = self._names().where(F.col("name") == batch).select("whole").limit(1).collect()
        return found[0]["whole"] if found else None

    def insert(self, rows: DataFrame, batch: str | None = None) -> int:
        """Log inserts (ext_id, vec and maybe metadata) as one batch; returns the records added.

        A batch name that is there already adds nothing, or, where a repair cut off some of its records, these.  Repeated or
        known ext_ids and invalid vectors are errors before anything is logged."""
        batch = batch or uuid.uuid4().hex
        there = self._known(batch)
        if there:
            return 0
        meta = F.col("metadata").cast("binary") if "metadata" in rows.columns else F.lit(None).cast("binary")
        new = rows.select(F.col("ext_id").cast("long").alias("ext_id"), F.col("vec").cast("array<float>").alias("vec"), meta.alias("metadata"))
        if there is False:
            new = new.join(self.vectors().select("ext_id"), "ext_id", "left_anti")
        require_valid(new.select(F.col("ext_id").alias("id"), "vec"), self.state.dim, zero=self.state.metric == "cosine")
        twice = new.groupBy("ext_id").count().where("count > 1 or ext_id is null").limit(1).collect()
        known = new.join(self.vectors().select("ext_id"), "ext_id", "left_semi").limit(1).collect()
        if twice or known:
            raise VectorError(f"ext_id {(twice or known)[0]['ext_id']} is null or there already")
        return self._append(new.withColumn("op", F.lit("insert")).withColumn("level", level_of(F.col("ext_id"), self.state.m, self.state.seed)), batch)

    def delete(self, ids: DataFrame, batch: str | None = None) -> int:
        """Log deletes of ext_ids; a batch name that is there already adds nothing."""
        batch = batch or uuid.uuid4().hex
        if self._known(batch):
            return 0
        rows = ids.select(F.col("ext_id").cast("long").alias("ext_id")).distinct()
        return self._append(rows.select("ext_id", F.lit("delete").alias("op"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("array<float>").alias("vec"), F.lit(None).cast("binary").alias("metadata")), batch)

    def _append(self, rows: DataFrame, batch: str) -> int:
        """Dense sequence numbers by (ext_id): places within range partitions, and one count a partition."""
        found = self.recovery()
        if found["end_seq"] is not None or len(self._finished()) != len(self._batches()):
            self.repair()  # never append behind a torn tail
            found = self.recovery()
        start = found["next_seq"]
        name = f"batch={len(self._batches()):08d}-{batch}"
        target = f"{self.root}/log/v={self.state.version}/{name}"
        staged = f"{self.root}/staged/{uuid.uuid4().hex}"
        rows.repartitionByRange("ext_id").sortWithinPartitions("ext_id").withColumn("at", F.monotonically_increasing_id()).write.parquet(staged)
        held = self.spark.read.parquet(staged)
        part = F.shiftright("at", 33)
        counts = sorted(held.groupBy(part.alias("part")).count().collect())
        bases, total = [], 0
        for c in counts:  # one row a partition
            bases.append((c["part"], start + total))
            total += c["count"]
        if total:
            base = F.broadcast(self.spark.createDataFrame(bases, "part long, base long"))
            dense = held.withColumn("part", part.cast("long")).join(base, "part").withColumn("seq", F.col("base") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
            out = dense.select("seq", "op", "ext_id", "level", "vec", "metadata", F.lit(None).cast("long").alias("snapshot_seq"))
            out.withColumn("crc", wal.checksum()).select(*wal.LOG.names).write.mode("overwrite").parquet(target)
            self._unsynced.append(filesystem(target)[1])
            if self.sync.every and len(self._unsynced) >= self.sync.every:
                self.flush()
        self.fs.delete_dir(filesystem(staged)[1])
        return total

    def flush(self) -> None:
        """Flush the batches written since the last time, with their folders, to a local disk."""
        for folder in self._unsynced:
            _flush(self.fs, [x.path for x in self.fs.get_file_info(pafs.FileSelector(folder)) if x.type == pafs.FileType.File] + [folder, os.path.dirname(folder)])
        self._unsynced = []

    def ingest(self, stream: DataFrame, checkpoint_dir: str, available_now: bool = True):
        """Start a streaming query that logs each micro-batch; its batch id makes a repeated batch a no-op."""
        writer = stream.writeStream.option("checkpointLocation", checkpoint_dir).foreachBatch(lambda df, batch: self.insert(df, f"stream{batch:08d}"))
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def checkpoint(self) -> State:
        """Write what recovery sees as the next snapshot, then move the pointer; the new version's log is empty."""
        found = self.recovery()
        version = self.state.version + 1
        self.vectors().write.mode("overwrite").parquet(f"{self.root}/snapshot/v={version}")
        kept = F.lit(True) if found["end_seq"] is None else F.col("seq") < found["end_seq"]
        done = self._logged().groupBy(F.regexp_replace("batch", r"^\d+-", "").alias("name")).agg(F.count_if(kept).alias("kept"), F.count(F.lit(1)).alias("n"))
        names = self._names().unionByName(done.where("kept > 0").select("name", (F.col("kept") == F.col("n")).alias("whole")))
        names.groupBy("name").agg(F.max("whole").alias("whole")).write.mode("overwrite").parquet(f"{self.root}/batches/v={version}")
        rows, checksum = _content(self.spark.read.schema(SNAPSHOT).parquet(f"{self.root}/snapshot/v={version}"))
        state = State(**{**asdict(self.state), "version": version, "snapshot_seq": found["next_seq"] - 1, "rows": rows, "checksum": checksum})
        self._point(self.fs, self.path, state)
        self.state, self._sound, self._unsynced = state, set(), []
        return state


def _content(snapshot: DataFrame) -> tuple[int, int]:
    """Rows of a snapshot, and a checksum that doesn't depend on their order."""
    own = F.crc32(F.concat_ws("|", "ext_id", "level", F.array_join(F.transform("vec", lambda x: x.cast("string")), ","), F.hex("metadata")).cast("binary"))
    r = snapshot.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(own), F.lit(0)).alias("s")).first()
    return r["n"], r["s"]


def _flush(fs: pafs.FileSystem, paths: list[str]) -> None:
    """fsync files and folders of a local disk."""
    if not isinstance(fs, pafs.LocalFileSystem):
        return
    for path in paths:
        handle = os.open(path, os.O_RDONLY)
        try:
            os.fsync(handle)
        finally:
            os.close(handle)
