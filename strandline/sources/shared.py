"""Tables written to a folder that all machines share."""

from __future__ import annotations

import atexit
import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_root() -> str:
    return tempfile.mkdtemp(prefix="strandline-")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under the shared folder of the cluster.

    ``spark.checkpoint.dir`` names that folder.  Only where it is unset and the
    whole of Spark is on one machine, as in tests, does a temporary folder take
    its place; on a cluster no other machine would see that one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    root = root or _own_root()
    return f"{root.rstrip('/')}/strandline-{uuid.uuid4().hex}"


_written: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def drop_written() -> None:
    """Takes away this process's tables: as it ends, while its session lives,
    or whenever a driver that lives long has read its results."""
    for path, spark in list(_written.items()):
        if spark.sparkContext._jsc is None:
            return
        _delete(spark, path)
        _written.pop(path, None)


class Scratch:
    """Tables written to the shared folder to cut lineage.

    A written table survives the loss of any executor.  ``drop`` removes the
    files of tables that no later step reads; the others go as the driver ends,
    or by ``drop_written``.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.kept: dict[int, tuple[DataFrame, str]] = {}

    def folder(self) -> str:
        """A new folder for other files, which goes as tables do."""
        path = shared_dir(self.spark)
        _written[path] = self.spark
        return path

    def keep(self, df: DataFrame) -> DataFrame:
        path = self.folder()
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.kept[id(kept)] = kept, path
        return kept

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            _, path = self.kept.pop(id(df), (None, None))
            if path:
                _delete(self.spark, path)
                _written.pop(path, None)
