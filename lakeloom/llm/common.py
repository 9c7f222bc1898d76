"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..functions.batches import freeing  # noqa: F401  its operators' own


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each followed by as many underscores as it takes to differ from all columns, whatever their case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


#: Tables that materialize() wrote and that weren't deleted yet, by the session's application.
_WRITTEN: dict[str, list[str]] = {}
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as spark.checkpoint.dir or the context's checkpoint folder names it.

    Only in local mode, where driver and executors are one process, a temporary folder stands in for a missing one.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    context = spark.sparkContext
    if at := context.getCheckpointDir():
        return at.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share; intermediate tables are written there")
    return _LOCAL.setdefault(context.applicationId, tempfile.mkdtemp(prefix="lakeloom-"))


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


#: Rows of an intermediate file, and files of a table of few rows.
FILE_ROWS, LEAST_FILES = 100_000, 8


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again; survives lost executors.

    rows: a bound of the table's rows, where one is known. It is written in as many files as these need, not in one for
    each shuffle partition.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(LEAST_FILES, -(-rows // FILE_ROWS)))
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written(spark: SparkSession) -> list[str]:
    """The intermediate tables that still exist, oldest first."""
    return list(_WRITTEN.get(spark.sparkContext.applicationId, []))


def drop_written(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete these intermediate tables, or all of them: once the results that read them have been taken."""
    kept = _WRITTEN.setdefault(spark.sparkContext.applicationId, [])
    for path in written(spark) if paths is None else [p for p in paths if p in kept]:
        p, fs = _hadoop_path(spark, path)
        fs.delete(p, True)
        kept.remove(path)


def drop_table(df: DataFrame) -> None:
    """Delete the tables of materialize() that df reads, once nothing reads them any more."""
    folders = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in df.inputFiles()}
    drop_written(df.sparkSession, [p for p in written(df.sparkSession) if p.rsplit("/", 1)[-1] in folders])


@contextmanager
def only_result(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Inside, append to the list the tables that are to stay; what else was materialized is deleted on leaving.

    For results that are materialized themselves; a lazy one still needs what it reads.
    """
    before, keep = set(written(spark)), []
    yield keep
    names = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for df in keep for f in df.inputFiles()}
    drop_written(spark, [p for p in written(spark) if p not in before and p.rsplit("/", 1)[-1] not in names])


@atexit.register
def _at_exit() -> None:
    """In local mode, whatever is left of the temporary folder; a cluster's folder is its owner's to empty, by drop_written()."""
    for path in _LOCAL.values():
        shutil.rmtree(path, ignore_errors=True)
