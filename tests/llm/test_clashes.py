"""Operators that give rows back give back columns of any name, unchanged."""

import pytest

from strandline.llm import mixing, pii, quality, secrets, sharding, simhash

#: Names that operators use, or used, for columns of their own.
NAMES = (
    "_id", "_no", "_h", "_own_h", "_own_id", "_own_no", "_key", "_size", "_n", "_pattern", "_order", "_found", "_bucket", "_times",
    "_time", "_more", "_n_email", "d_key", "row", "body", "found", "no", "id", "h", "its_id", "fp", "fp_", "n", "first", "root", "a.b",
    "_rest", "_edge", "_p", "size", "taken",
)
WORDS = " ".join(f"word{i} of{i} text" for i in range(60)) + " "


@pytest.fixture(scope="module")
def docs(spark):
    texts = [WORDS + "mail a.person@example.org, password=Zx9kQ2LmVRt8zz", WORDS, None, "", WORDS * 2000, WORDS]
    rows = [(i, t, f"s{i % 2}", *(f"{c} of {i}" for c in NAMES)) for i, t in enumerate(texts)]
    rows += rows[1:2] * 3
    return spark.createDataFrame(rows, ["doc_id", "text", "source", *NAMES])


def by_id(df):
    return {r[0]: tuple(r) for r in df.collect()}


@pytest.mark.parametrize(
    "operator",
    [
        mixing.mixed_rows,
        simhash.keep_one,
        secrets.redact_secrets,
        lambda df: quality.keep_good(df, quality.QualityModel(None)),
        lambda df: pii.pseudonymised(df, "key"),
    ],
    ids=["mixed_rows", "keep_one", "redact_secrets", "keep_good", "pseudonymised"],
)
def test_columns_come_back(docs, operator):
    out = operator(docs)
    assert out.columns == docs.columns
    before, after = by_id(docs), by_id(out)
    assert after and all(row[2:] == before[i][2:] for i, row in after.items())
    assert operator(docs.limit(0)).count() == 0


def test_columns_that_are_not_read(docs):
    assert sharding.shard_manifest(docs).count() == docs.count()
    assert mixing.mix_sources(docs).count() == docs.count()
    assert pii.pseudonym_rows(docs, "key").count() == docs.count()
    assert simhash.near_duplicates(docs).count() == docs.count()
