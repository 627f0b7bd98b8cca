"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 3_000_000
_own_dir: dict[str, str] = {}
_held: dict = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir, or in local mode a temporary one where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        app = spark.sparkContext.applicationId
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if app not in _own_dir:
            _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="lamella-")
        found = _own_dir[app]
    return found.rstrip("/")


_tracked: ContextVar[list[str] | None] = ContextVar("tracked", default=None)


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/lamella-{name}-{uuid.uuid4().hex}"
    if (paths := _tracked.get()) is not None:
        paths.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession):
    """Deletes the paths that `fresh_path` gives within, at the end; what is made of them must have been written by then."""
    token = _tracked.set([])
    try:
        yield
    finally:
        for path in _tracked.get() or []:
            delete(spark, path)
        _tracked.reset(token)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet to the shared folder and reads it again, so a lost executor costs no recomputation.
    Shuffle files of the writing go when it ends, as nothing reads them again."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.lm_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for t in tables:
        delete(t.sparkSession, t.lm_path)


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, or with underscores added until no column of df has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def row_key(id_col: str, text_col: str) -> Column:
    """Tells rows that share an id but not a text apart; equal rows have the same key, and so the same result."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly over more tasks, if it is read from files of fewer row groups than there are cores (a file's row groups aren't
    split, however many tasks it has). A plan with a shuffle, or with many tasks, is left as it is; else a job counts rows by task."""
    cores, execution = df.sparkSession.sparkContext.defaultParallelism, df._jdf.queryExecution()
    plan = execution.executedPlan().toString()
    if "AdaptiveSparkPlan" in plan or plan.count("Scan parquet") != 1 or execution.toRdd().getNumPartitions() >= 4 * cores:
        return df
    filled = df.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each of few tasks
    return df if len(filled) >= cores or sum(r["n"] for r in filled) < 4 * cores else df.repartition(2 * cores)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def cut(batches, column: int, most_bytes: int = SLICE_BYTES):
    """The rows of Arrow batches in batches of about so many bytes of a text column, so that a worker holds few texts as objects."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < b.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most_bytes, side="right")))
            yield b.slice(start, stop - start)
            start = stop


def held(kind: str, name: str, make):
    """make(name), kept in a Python worker until a model of another kind or name is asked for: workers are used again by other stages,
    whose models and caches would add up."""
    if _held.get("key") != (kind, name):
        _held.clear()
        _held["model"] = make(name)
        _held["key"] = (kind, name)
    return _held["model"]


def freed() -> None:
    """Lets go of a held model and its caches; for tasks that need none, as they run in workers that other stages have used."""
    _held.clear()
    pa.default_memory_pool().release_unused()


class TwoGenerations(dict):
    """A dict for results of pure functions, bounded to about 2 x half entries: recent keys survive, old ones are computed anew."""

    def __init__(self, half: int):
        super().__init__()
        self.half, self.old = half, {}

    def lacking(self, keys) -> list:
        """The keys (each once) that neither generation has; those of the old one move up. Call this before reading keys."""
        if len(self) > self.half:
            self.old = dict(self)
            self.clear()
        new = []
        get = self.old.get
        for k in [k for k in keys if k not in self]:  # set.difference would go through all of a dict of another class
            v = get(k)
            if v is None:
                new.append(k)
            else:
                self[k] = v
        return new
