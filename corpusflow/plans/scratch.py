"""Tables that cut lineage: written to the folder all executors share, then read again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: Open scopes of the thread that runs: one thread's tables are not another's.
_SCOPES: ContextVar[tuple[list[Scratch], ...]] = ContextVar("scopes", default=())


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as the cluster names it; where it is unset, a temporary folder in local runs and an error on a cluster, whose executors share none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="corpusflow-")
    return _LOCAL[app]


@contextmanager
def released() -> Iterator[None]:
    """Delete, at the end, the tables that operators write within: for code that has written its own result by then."""
    scope: list[Scratch] = []
    token = _SCOPES.set((*_SCOPES.get(), scope))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        for work in scope:
            work.drop("")


class Scratch:
    """Intermediate Parquet tables of one operator call; a lost executor costs no recomputation of what was saved."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        for scope in _SCOPES.get():
            scope.append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that no plan still to run reads; all of them for an empty name."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
