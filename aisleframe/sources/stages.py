"""Stage tables: results written once and read back, and the partitioned outputs between steps.

A staged table cuts lineage and survives lost executors, because it lies in the cluster's shared
folder. Its size on disk is known to the optimizer, so a later join broadcasts it only while it is
below `spark.sql.autoBroadcastJoinThreshold`. Stage tables written inside a `stage_scope` are dropped at
its end; `StepLog` runs the steps of a job in such scopes and resumes after the last finished one.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_local_dirs: dict[str, str] = {}
_scope: ContextVar[list[str] | None] = ContextVar("stage_scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: `spark.checkpoint.dir`, else the context's checkpoint folder.

    A temporary folder serves only a local master; on a cluster a missing setting is an error.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="aisleframe-")
        atexit.register(shutil.rmtree, _local_dirs[app], ignore_errors=True)
    return _local_dirs[app]


def _located(spark: SparkSession, path: str):
    """File system of a path, and the path as it takes it."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(context._jsc.hadoopConfiguration()), at


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder this library wrote; a missing one is fine."""
    files, at = _located(spark, path)
    files.delete(at, True)


@contextmanager
def stage_scope(spark: SparkSession) -> Iterator[None]:
    """Drop the stage tables written inside when the block ends or fails.

    Frames that read them must be written before the end. In an inner scope only its own tables are dropped.
    """
    paths: list[str] = []
    token = _scope.set(paths)
    try:
        yield
    finally:
        _scope.reset(token)
        for path in paths:
            drop_path(spark, path)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write the frame to the shared folder and return the written table."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/aisleframe/{app}/{name}-{uuid.uuid4().hex}"
    scope = _scope.get()
    if scope is not None:
        scope.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@dataclass
class StepLog:
    """Finished steps of a job: one small table each below the folder, holding the job's key.

    The key states what the job's results depend on; a step finished under another key is not finished.
    """

    spark: SparkSession
    folder: str
    key: str

    def mark(self, step: str) -> str:
        return f"{self.folder.rstrip('/')}/{step}"

    def finished(self, step: str) -> bool:
        files, at = _located(self.spark, f"{self.mark(step)}/_SUCCESS")
        return files.exists(at) and self.spark.read.text(self.mark(step)).first()[0] == self.key

    def run(self, steps: Mapping[str, Callable[[], None]], resume: bool = False) -> list[str]:
        """Run the steps in order, each in a scope of its own; returns the names of those that ran.

        With resume, finished steps before the first unfinished one are skipped. That one and all later
        ones lose their marks before any of them starts, so that a job stopped at any point is never taken
        for a finished one. Steps must overwrite what a stopped run left.
        """
        names = list(steps)
        done = 0
        while resume and done < len(names) and self.finished(names[done]):
            done += 1
        for name in reversed(names[done:]):
            drop_path(self.spark, self.mark(name))
        for name in names[done:]:
            with stage_scope(self.spark):
                steps[name]()
            self.spark.range(1).select(F.lit(self.key).alias("value")).coalesce(1).write.text(self.mark(name))
        return names[done:]


def write_stage(df: DataFrame, path: str, partition_by: tuple[str, ...] = ("group", "year")) -> None:
    """Persist a pipeline step, one folder per category and year.

    The rebalance hint gathers small folders into few files and splits a category that holds a large
    part of the rows over many tasks.
    """
    df.hint("rebalance", *partition_by).write.mode("overwrite").partitionBy(*partition_by).parquet(
        path
    )


def read_stage(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Read a step; category and year filters prune folders.

    The schema is required: inferring the folder keys would turn category "0501" into a number.
    """
    return spark.read.schema(schema).parquet(path)


def write_chunks(df: DataFrame, path: str, n: int, first_year: int, last_year: int) -> None:
    """Stack all categories of a year window into n folders, chunk=0 to n - 1.

    A row's chunk is a hash of its values. Large chunks are split over many tasks and files, so n does
    not bound the number of writers.
    """
    window = df.where(df["year"].between(first_year, last_year))
    chunk = F.pmod(F.xxhash64(*df.columns), F.lit(n)).cast("int")
    window.withColumn("chunk", chunk).hint("rebalance", "chunk").write.mode("overwrite").partitionBy(
        "chunk").parquet(path)


def write_results(df: DataFrame, path: str) -> None:
    """Result sink."""
    df.write.mode("overwrite").parquet(path)
