"""The pipeline against its stages done plainly, one by one."""

import hashlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from strandline.llm import mixing, quality, secrets, simhash
from strandline.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    rows = {r.doc_id: r for r in docs.collect()}
    columns = docs.columns

    kept = corpus_pipeline.quality_rules(spark, docs, SF)
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    counts = np.array([quality.rule_counts(r.text) for r in rows.values()])
    want = {k for k, ok in zip(rows, model.judge(counts)[2]) if ok}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == columns

    one = corpus_pipeline.near_duplicates(spark, kept, SF)
    ids = sorted(want)
    fps = [simhash.fingerprint(rows[i].text) for i in ids]
    group = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    left = {ids[g] for g in group}
    assert sorted(r.doc_id for r in one.collect()) == sorted(left) and one.columns == columns

    clean = corpus_pipeline.secret_scans(spark, one, SF)
    got = {r.doc_id: r for r in clean.collect()}
    guesses = secrets.Guesses(secrets.ranked_words(tokenizer_path()))
    texts = {i: secrets.redacted(rows[i].text, secrets.spans_of(rows[i].text, guesses)) for i in left}
    assert {i: r.text for i, r in got.items()} == texts and clean.columns == columns
    assert all(r.n_chars == len(r.text) for r in got.values())

    mixed = corpus_pipeline.source_mix(spark, clean, SF)
    times = {r.doc_id: r.taken // r.size for r in mixing.mix_sources(clean).collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in times.items() if n})
    assert mixed.columns == columns

    tokenizer = Tokenizer.from_file(tokenizer_path())
    out = Counter()
    for i, n in times.items():
        encoded = tokenizer.encode(texts[i], add_special_tokens=False).ids
        text = tokenizer.decode(encoded, skip_special_tokens=False)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        out[i, len(encoded), sha(np.array(encoded, "<u4").tobytes()), sha(text.encode())] = n
    got = Counter(tuple(r) for r in corpus_pipeline.token_ids(spark, mixed, SF).collect())
    assert got == +out
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == got


def test_stages_take_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    long = "some words of a text that is long enough to stay " * 40
    odd = [(None, None, None, None, None), (-5, "", "en", None, 0), (-6, long, None, None, 9), (-6, long, None, None, 9),
           (-7, "\x1f " + long.replace("text", "te\x1cxt") + "\n", "en", "web", 5)]
    odd = spark.createDataFrame(odd, docs.schema)
    for some in (docs.unionByName(odd), docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            some = stage(spark, some, SF)
        some.count()
