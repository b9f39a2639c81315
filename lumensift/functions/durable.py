"""Tables written once to the shared folder, so that no lineage is run twice and lost executors cost nothing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"

#: Removes the shuffle files of a write once it has ended: the table stands for them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where none is set (tests on one machine), a temporary one of this session."""
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"{SETTING} names no shared folder")
        found = "file://" + tempfile.mkdtemp(prefix="lumensift-")
        spark.conf.set(SETTING, found)
    return found


#: The open scopes of this thread or task, outermost first; queries that run at once don't see each other's.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are removed at the end, unless they are kept."""
    made: list[str] = []
    mark = _scopes.set((*_scopes.get(), made))
    try:
        yield
    finally:
        _scopes.reset(mark)
        for path in made:
            _delete(spark, path)


def removed(df: DataFrame) -> None:
    """Deletes the files of a table that ``written`` returned."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if path.rsplit("/", 1)[-1].startswith("table-"):
            _delete(df.sparkSession, path)


def written(df: DataFrame, keep: bool = False) -> DataFrame:
    """df, written as Parquet and read again; keep: not removed with the temporary tables."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    scopes = _scopes.get()
    if scopes := scopes[:-1] if keep else scopes:
        scopes[-1].append(path)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
