"""Tables and files that several executors must see, kept results, and what a session has made of them."""

from __future__ import annotations

import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where a local session has none, a temporary folder is made and set; on a cluster that is an error, since executors
    do not see each other's disks.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="loomery-shared-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a Parquet table in the shared folder and read it back."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    p, files = _path(spark, path)
    files.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p, files = _path(spark, path)
    return files.exists(p)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Remove, at the end, what was made in the shared folder meanwhile, but for the paths in the list that it gives."""
    begin, keep = len(_made), []
    try:
        yield keep
    finally:
        for path in _made[begin:]:
            if path not in keep:
                remove(spark, path)
        _made[begin:] = [p for p in _made[begin:] if p in keep]


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, the scale knob of operators that deal rows themselves."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cached_table(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; made and written there the first time only.

    It is written beside its place and moved there when complete, so a broken run leaves nothing that looks finished.
    """
    if not exists(spark, path):
        part = f"{path.rstrip('/')}.part-{uuid.uuid4().hex}"
        make().write.parquet(part)
        p, files = _path(spark, part)
        if not files.rename(p, _path(spark, path)[0]):
            remove(spark, part)  # another run was first
    return spark.read.parquet(path)


class TableCache:
    """At most ``capacity`` tables persisted, the least recently used one given up."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.tables: OrderedDict[object, DataFrame] = OrderedDict()

    def get(self, key: object, make: Callable[[], DataFrame]) -> DataFrame:
        if key not in self.tables:
            self.tables[key] = make().persist()
            if len(self.tables) > self.capacity:
                self.tables.popitem(last=False)[1].unpersist()
        self.tables.move_to_end(key)
        return self.tables[key]

    def clear(self) -> None:
        while self.tables:
            self.tables.popitem()[1].unpersist()
