"""The Spark settings that the package expects."""

from __future__ import annotations

import functools
import os
import shutil
import tempfile

from pyspark import SparkContext
from pyspark.sql import SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))


def session(master: str = "local[*]", shuffle_partitions: int = 8, **more: str) -> SparkSession:
    """A session in UTC with adaptive execution; settings in ``more`` have
    underscores for dots."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
    } | {k.replace("_", "."): v for k, v in more.items()}
    return SparkSession.builder.master(master).config(map=conf).getOrCreate()


@functools.cache
def _shipped(context: SparkContext) -> str:
    at = os.path.join(tempfile.mkdtemp(prefix="strandline-package-"), "strandline")
    path = shutil.make_archive(at, "zip", os.path.dirname(PACKAGE), os.path.basename(PACKAGE))
    context.addPyFile(path)
    return path


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers of a session, once: other
    machines need not have it installed, nor its path."""
    _shipped(spark.sparkContext)
