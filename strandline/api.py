"""A client for one log table: put, get, delete, range and the rest."""

from __future__ import annotations

import time

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import compaction, lookup, partitions
from strandline.operators.latest import current
from strandline.sources import log as logs

Text = str | bytes
#: Claims of numbers that stay; older ones go.
KEPT_CLAIMS = 1000


class NotFound(KeyError):
    """No live version of the key."""


class InvalidArgument(ValueError):
    """A request that no table could serve."""


class Client:
    """Keys and values over a folder of log records: texts, or with ``binary``
    bytes, for which ranges within a value count bytes.

    Writes append small files; ``compact`` gathers them into one sorted table.
    Every call reads the log as it is then.

    Any number of clients may write one log.  Each write has a number of its
    own, beyond all that were given before it began, whatever the clocks of the
    machines say: it is claimed by creating a file, which a file system lets
    only one of several do.
    """

    def __init__(self, spark: SparkSession, path: str, binary: bool = False):
        self.spark, self.path, self.binary = spark, path.rstrip("/"), binary
        kind = "binary" if binary else "string"
        self.schema = f"k {kind}, seq long, op int, v {kind}, exp long"
        self.empty: Text = b"" if binary else ""
        claims = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_claims")
        self._files = claims.getFileSystem(spark._jsc.hadoopConfiguration())
        self._claims = self._files.makeQualified(claims)

    def log(self) -> DataFrame:
        if not self._files.exists(self._claims.getParent()):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def _last_claim(self) -> int | None:
        if not self._files.exists(self._claims):
            return None
        return max((int(f.getPath().getName()) for f in self._files.listStatus(self._claims)), default=None)

    def _seq(self) -> int:
        """A number that no other write has, beyond all before it."""
        last = self._last_claim()
        if last is None:  # the log may be a compacted one, or written otherwise
            last = self.log().agg(F.max("seq")).first()[0] or 0
        while True:
            mine = last + 1
            if self._claimed(mine):
                old = self.spark._jvm.org.apache.hadoop.fs.Path(self._claims, str(mine - KEPT_CLAIMS))
                self._files.delete(old, False)
                if self._last_claim() < mine + KEPT_CLAIMS:
                    return mine  # else so late that the first claim of this number may be gone
            last = max(mine, self._last_claim() or 0)  # someone else was first

    def _claimed(self, number: int) -> bool:
        """Whether this client, and no other one, has made the number's file."""
        jvm = self.spark._jvm
        file = jvm.org.apache.hadoop.fs.Path(self._claims, str(number))
        if self._files.getUri().getScheme() == "file":  # Spark's own way looks first and creates then
            self._files.mkdirs(self._claims)
            return jvm.java.io.File(file.toUri().getPath()).createNewFile()
        try:
            self._files.create(file, False).close()
        except Py4JJavaError:
            if not self._files.exists(file):
                raise
            return False
        return True

    def _write(self, key: Text, op: int, value: Text, exp: int) -> None:
        made = self.spark.createDataFrame([(key, self._seq(), op, value, exp)], self.schema)
        logs.append(made.coalesce(1), self.path)

    def put(self, key: Text, value: Text, must_sync: bool = True, ttl_secs: int = 0) -> None:
        """``must_sync`` is accepted for callers that have it; every write here
        is on disk when the call returns."""
        if not key:
            raise InvalidArgument("a key may not be empty")
        self._write(key, logs.PUT, value, int(time.time()) + ttl_secs if ttl_secs > 0 else 0)

    stream_put = put

    def put_many(self, rows: DataFrame, ttl_secs: int = 0) -> None:
        """Put all rows of a DataFrame (k, v)."""
        logs.append(logs.puts(rows, self._seq(), int(time.time()), ttl_secs), self.path)

    def get(self, key: Text) -> Text:
        return self._value(key, F.col("v"))

    def _value(self, key: Text, value) -> Text:
        found = lookup.get(self.log(), key, int(time.time())).select(value).head()
        if not found:
            raise NotFound(key)
        return bytes(found[0]) if self.binary and found[0] is not None else found[0]

    def get_many(self, keys: DataFrame) -> DataFrame:
        return lookup.get_many(self.log(), keys, int(time.time()))

    def get_range(self, key: Text, offset: int, length: int) -> Text:
        """Part of a value, in bytes if binary, else in characters; a length of
        0 is to the end."""
        return self._value(key, lookup.subrange(F.col("v"), offset, length))

    def head(self, key: Text) -> tuple[bool, int]:
        found = lookup.head(self.log().where(F.col("k") == F.lit(key)), int(time.time())).head()
        return (True, found["value_length"]) if found else (False, 0)

    def delete(self, key: Text) -> None:
        """Succeeds whether or not the key is there."""
        self._write(key, logs.DELETE, self.empty, 0)

    def range(self, prefix: Text = "", start: Text = "", limit: int = 100) -> tuple[list[Text], bool]:
        """Keys in order, and whether there may be more."""
        if limit == 0:
            return [], True
        found = lookup.range_keys(self.log(), prefix or self.empty, start or self.empty, limit, int(time.time())).collect()
        keys = [bytes(r[0]) if self.binary else r[0] for r in found]
        return keys, len(keys) == limit

    def batch_delete(self, prefix: Text) -> int:
        """Delete all live keys with a prefix; how many there were."""
        keys = lookup.range_keys(self.log(), prefix, self.empty, now=int(time.time()))
        n = keys.count()
        if n:
            logs.append(logs.deletes(keys, self._seq()), self.path)
        return n

    def compact(self, into: str, major: bool = True) -> Client:
        """A sorted table of what a compaction keeps, under another path."""
        kept = compaction.major(self.log(), now=int(time.time())) if major else compaction.minor(self.log())
        logs.write_sorted(kept, into)
        return Client(self.spark, into, self.binary)

    def split_key(self) -> Text | None:
        return partitions.split_key(current(self.log(), int(time.time())).select("k"))

    def flush(self) -> None:
        """Nothing waits in memory; kept for callers that flush."""

    def close(self) -> None:
        """Nothing is held open."""
