"""The registered queries of this subpackage, each on its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import bpe, embeddings, mixing, pii, quality, quotes, secrets, sharding, simhash, toxicity
from strandline.llm.common import table, texts

SHARDS = 8
WORD_BPE = "word_bpe_49k.json"
#: Of these queries only; whoever uses the operator brings a secret key.
PSEUDONYM_KEY = "registered query"


def tokenizer_path(name: str = WORD_BPE) -> str:
    """Where the public tokenizer files of this machine lie."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(texts(spark, sf_dir, "documents"), words=secrets.ranked_words(tokenizer_path()))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_manifest(texts(spark, sf_dir, "documents"), SHARDS)


def op3_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.linked_vectors(table(spark, sf_dir, "embeddings"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(texts(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "documents")
    return toxicity.score_texts(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_digests(texts(spark, sf_dir, "documents"), tokenizer_path())


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonym_rows(texts(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op8_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.linked_messages(texts(spark, sf_dir, "conversations"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(texts(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "documents")
    return quality.quality_verdicts(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


# what of the operators' results DuckDB can say as well


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of base spans."""
    return op1_secret_scans(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule counts, and what they alone reject."""
    return op10_quality_rules(spark, sf_dir).select("doc_id", *quality.COUNTS, "base_failed")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets, and that no document is taken more than thrice."""
    mix, taken = op9_mixing(spark, sf_dir), F.col("taken")
    return mix.select(
        "doc_id",
        "size",
        "source_size",
        F.round("target", 6).alias("target"),
        ((taken <= 3 * F.col("size")) & (taken >= 0) & ((F.col("size") == 0) | (taken % F.col("size") == 0))).alias("whole_times"),
    )


def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, and what the law of keys promises: slots without gaps, and one
    more shard that takes rows only into itself."""
    rows = op2_sharding(spark, sf_dir)
    slots = rows.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("n_slots"), F.max("slot").alias("last"))
    joined = rows.join(F.broadcast(slots), "shard")  # one row a shard
    return joined.select(
        "doc_id",
        "size",
        (F.col("shard").between(0, SHARDS - 1) & ((F.col("grown_shard") == F.col("shard")) | (F.col("grown_shard") == SHARDS))).alias("stays"),
        ((F.col("n") == F.col("n_slots")) & (F.col("last") == F.col("n") - 1)).alias("gapless"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scans": op1_secret_scans,
        "op2_sharding": op2_sharding,
        "op3_grid_join": op3_grid_join,
        "op4_simhash": op4_simhash,
        "op5_toxicity": op5_toxicity,
        "op6_bpe": op6_bpe,
        "op7_pii": op7_pii,
        "op8_quotes": op8_quotes,
        "op9_mixing": op9_mixing,
        "op10_quality_rules": op10_quality_rules,
        "secret_counts": secret_counts,
        "quality_counts": quality_counts,
        "mix_targets": mix_targets,
        "shard_sizes": shard_sizes,
    }


def _either_case(pattern: str) -> str:
    """Letters as sets of both cases; RE2's own way takes in other letters."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in pattern)


_NAME = _either_case("password|passwd|secret|token|api_?key")
SECRET_SQL = rf"""
SELECT doc_id,
  len(list_filter(regexp_extract_all(t, '({_NAME})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 12)) AS n_assign,
  len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18)) AS n_access,
  len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 16)) AS n_hex
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
QUALITY_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, w, generate_subscripts(w, 1) AS i FROM (SELECT r, {_WORDS} AS w FROM d)),
three AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM w WHERE i + 2 <= len(w)),
twice AS (SELECT r, i FROM three JOIN (SELECT r, x FROM three GROUP BY r, x HAVING count(*) > 1) USING (r, x)),
repeats AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(3) t(k) GROUP BY r),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
c AS (SELECT doc_id, len({_WORDS}) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dups.n, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words
  FROM d LEFT JOIN dups USING (r) LEFT JOIN repeats USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
"""
# sources filled in the order of what they can take by weight; those below the level take all they can
MIX_SQL = rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS}) AS size FROM (SELECT doc_id, source, coalesce(text, '') AS t FROM documents)),
s AS (SELECT source, sum(size) AS n, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
o AS (SELECT *, 3 * n / w AS most, row_number() OVER (ORDER BY 3 * n / w, source) AS i FROM s),
l AS (SELECT i, most, ((SELECT sum(n) FROM s) - coalesce(sum(3 * n) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
x AS (SELECT coalesce(min(level) FILTER (level <= most), 1e300) AS level FROM l WHERE i <= coalesce((SELECT min(i) FROM l WHERE level <= most), 0))
SELECT doc_id, size, CAST(n AS BIGINT) AS source_size, round(least(level * w, 3.0 * n), 6) AS target, true AS whole_times
FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, x
"""
SHARD_SQL = """
SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, true AS stays, true AS gapless FROM documents
"""

OP3_SQL = """
WITH RECURSIVE x AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v,
         label IS NOT NULL AND embedding IS NOT NULL
         AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0
         AND len(list_filter(embedding, lambda c: c <> 0)) > 0 AS ok
  FROM embeddings
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM (SELECT * FROM x WHERE ok) a JOIN (SELECT * FROM x WHERE ok) b
    ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM x
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = vec_id) AS n_links, component_id,
       vec_id = component_id AS kept
FROM x JOIN least ON least.a = x.vec_id
"""


def oracle_sql() -> dict[str, str]:
    """The others use hashes or models that DuckDB lacks; brute force in
    tests/llm stands in."""
    return {
        "op3_grid_join": OP3_SQL,
        "secret_counts": SECRET_SQL,
        "quality_counts": QUALITY_SQL,
        "mix_targets": MIX_SQL,
        "shard_sizes": SHARD_SQL,
    }
