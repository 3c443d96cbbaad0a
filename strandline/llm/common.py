"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.sources.shared import Scratch, shared_dir

__all__ = [
    "ASCII_SPACE", "HOT_KEYS", "Scratch", "WORD", "dealt_out", "ids_of", "joined_evenly", "marked", "per_text", "present", "shared_dir",
    "table", "texts", "unmarked", "with_texts",
]

#: The ASCII white space that separates words: space and 0x09 to 0x0D.
ASCII_SPACE = b" \t\n\x0b\x0c\r"
#: One word, as a Java or Python pattern.
WORD = r"[^\x20\x09-\x0D]+"


#: A table of fewer bytes may lie in one row group, which one task would read.
SMALL_TABLE = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose texts take long: a small one dealt to all cores, a larger
    one as it lies in its files, without a shuffle."""
    rows = table(spark, sf_dir, name)
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    size = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return rows.repartition(spark.sparkContext.defaultParallelism) if size < SMALL_TABLE else rows


#: Bytes of texts that go to Python at once, about, and Spark's own number.
BATCH_BYTES, SPARK_BATCH_BYTES = 8 << 20, 64 << 20


def _small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session that hands texts over BATCH_BYTES at a time.

    Spark's batches of 64 MB lie in the executor's memory outside the heap, and
    again in each Python worker.  A session whose setting is not Spark's own
    keeps it."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name).removesuffix("b") == str(SPARK_BATCH_BYTES):
        conf.set(name, str(BATCH_BYTES))
    return df


def per_text(
    df: DataFrame,
    columns: list[str | Column],
    schema: T.StructType,
    make: Callable[[], Callable[[list[list]], list[Iterable]]],
) -> DataFrame:
    """Rows of ``columns`` mapped to rows of ``schema``, an Arrow batch at a time.

    ``make`` runs once per task and returns a function from column lists to
    column lists of the same length.
    """
    arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            # slices bound the Python objects alive at once when texts are long
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                out = f([c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, arrow)], schema=arrow)

    return _small_batches(df).select(*columns).mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def with_texts(
    df: DataFrame,
    text: str,
    make: Callable[[], Callable[[list], tuple[list, list[bool] | None]]],
    length: str | None = None,
) -> DataFrame:
    """All columns of ``df`` with new texts, rows dropped where told.

    ``make`` runs once per task; its function takes texts and returns new texts
    and, optionally, which rows stay.  ``length`` names a column to set to the
    new text's number of code points, where ``df`` has it.
    """
    names = df.columns
    fields = [f for f in df.schema.fields]
    at = names.index(text)
    n_at = names.index(length) if length in names else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                new, stay = f(part.column(at).to_pylist())
                arrays = list(part.columns)
                arrays[at] = pa.array(new, arrays[at].type)
                if n_at >= 0:
                    arrays[n_at] = pa.array([None if x is None else len(x) for x in new], arrays[n_at].type)
                part = pa.RecordBatch.from_arrays(arrays, names=names)
                yield part if stay is None else part.filter(pa.array(stay, pa.bool_()))

    plain = df.toDF(*(f"c{i}" for i in range(len(names))))  # names with dots cannot be passed on
    return _small_batches(plain).mapInArrow(run, T.StructType(fields))


def present(df: DataFrame, name: str, kind: str) -> Column:
    """Column ``name`` as ``kind``; a null of that type where ``df`` lacks it."""
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def ids_of(docs: DataFrame, key: str) -> DataFrame:
    """The distinct ids of documents, by their own name."""
    return docs.select(F.col(key).cast("long").alias(key)).distinct()


def marked(df: DataFrame, **own: Column) -> DataFrame:
    """``df`` with columns of an operator's ``own`` beside its caller's, which
    are called c0, c1 and so on, so that no two names can meet."""
    return df.select("*", *own.values()).toDF(*(f"c{i}" for i in range(len(df.columns))), *own)


def unmarked(rows: DataFrame, like: DataFrame) -> DataFrame:
    """The caller's columns of marked rows, by the names that ``like`` has."""
    return rows.select(*(f"c{i}" for i in range(len(like.columns)))).toDF(*like.columns)


#: A key is hot if it has more than this part of the rows; there are at most so many.
HOT_KEYS = 1024


def joined_evenly(rows: DataFrame, facts: DataFrame, key: str, fact_key: str, n: str, total: int) -> DataFrame:
    """``rows`` joined with their key's one row of ``facts``, where ``n`` says
    how many of all ``total`` rows have the key.

    Rows of hot keys would meet in one task; their facts, at most HOT_KEYS rows
    by definition, are broadcast instead.  Both tables are read twice, so they
    should be written ones.
    """
    same = F.col(key) == F.col(fact_key)
    hot = F.col(n) * HOT_KEYS > total
    many = F.broadcast(facts.where(hot))
    return (
        rows.join(many, same)
        .unionByName(rows.join(many.select(fact_key), same, "left_anti").join(facts.where(~hot), same))
        .drop(fact_key, n)
    )


def dealt_out(df: DataFrame, n: str, most: int, chunk: int = 4096) -> DataFrame:
    """Each row ``n`` times with _copy from 0, in chunks so that no array grows
    with ``n``; ``most`` is the largest ``n``.  The chunks of a row that has
    several are spread over tasks before they become rows."""
    chunks = df.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({n} - 1) div {chunk}"))))
    if most > chunk:
        chunks = chunks.repartition(*chunks.columns)
    first = F.col("_chunk") * chunk
    last = F.least(first + (chunk - 1), F.col(n) - 1)
    return chunks.withColumn("_copy", F.explode(F.sequence(first, last))).drop("_chunk")
