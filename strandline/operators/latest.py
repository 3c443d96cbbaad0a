"""The newest version of every key, and what of it is visible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from strandline.sources.log import DELETE, NOW


def ranked(log: DataFrame, name: str = "rank") -> DataFrame:
    """``log`` with the place of each version among its key's, newest first.

    Of records with one key and seq, which a log should not have, those of the
    greatest op, value and expiry come first, so that all ways agree.
    """
    return log.withColumn(name, F.row_number().over(_newest_first(log)).cast("long"))


def _newest_first(log: DataFrame) -> WindowSpec:
    return W.partitionBy("k").orderBy(F.desc("seq"), *(F.desc(c) for c in ("op", "v", "exp") if c in log.columns))


def newest(log: DataFrame) -> DataFrame:
    """One row per key: the version of the greatest seq, of whatever kind.

    The window form lets Spark keep one row per key and task before the
    shuffle, and push filters on k below it.
    """
    return log.withColumn("_rank", F.row_number().over(_newest_first(log))).where("_rank = 1").drop("_rank")


def newest_by_max(log: DataFrame) -> DataFrame:
    """The same by aggregation; for streams, and when no window is wanted."""
    rest = [c for c in ("op", "v", "exp") if c in log.columns]
    rest += [c for c in log.columns if c not in ("k", "seq", *rest)]
    best = log.groupBy("k").agg(F.max(F.struct("seq", *rest)).alias("_best"))
    return best.select("k", "_best.*").select(*log.columns)


def not_expired(now: int = NOW, exp: str = "exp") -> Column:
    return (F.col(exp) == 0) | (F.col(exp) > now)


def visible(now: int = NOW) -> Column:
    """Of a newest version: neither a delete nor expired.  Never test this
    before ``newest``: an older version would come back."""
    return (F.col("op") != DELETE) & not_expired(now)


def current(log: DataFrame, now: int = NOW) -> DataFrame:
    """The live keys of a log with their newest version."""
    return newest(log).where(visible(now))


def in_range(key: Column, low: Column | str | bytes, high: Column | str | bytes) -> Column:
    """low <= key < high; an empty end is open.  Ends may be texts, bytes for
    binary keys, or columns of texts."""
    above = key >= F.lit(low) if isinstance(low, Column) or low else F.lit(True)
    if isinstance(high, Column):
        return above & ((high == "") | (key < high))
    return above & (key < F.lit(high)) if high else above


def first_wins(ordered_sources: list[DataFrame]) -> DataFrame:
    """Rows of several key lists, each key from the first list that has it."""
    tagged = [df.withColumn("_from", F.lit(i)) for i, df in enumerate(ordered_sources)]
    both = tagged[0]
    for df in tagged[1:]:
        both = both.unionByName(df)
    w = W.partitionBy("k").orderBy("_from")
    return both.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank", "_from")
