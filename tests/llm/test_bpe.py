import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strandline.llm import bpe as B
from strandline.llm.queries import tokenizer_path

PATH = tokenizer_path()


@pytest.fixture(scope="module")
def ours():
    with open(PATH, encoding="utf-8") as f:
        return B.WordBpe(f.read())


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(PATH)


def same(ours, theirs, text):
    ids = theirs.encode(text, add_special_tokens=False).ids
    got = ours.encode(text)
    assert np.frombuffer(got, "<u4").tolist() == ids, text
    assert ours.decode(got) == theirs.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize(
    "text",
    ["", " ", "Hello WORLD it's 123 foo!!  <|endoftext|>bar ÉCOLE", "İΣΑΣ ŒUVRE's", "a\u0085b\u001cc d", "<|startoftext|><|endoftext",
     "page one\x1f page two\n", "\x1c", "\x1f \x1e", " \x1d\u2028",
     "a" * 500, "!?" * 300, "é́ 힣 각", "'S 'LL I'VE 'd'd''s", "abܱ᫆cd \U00011935\U00011930 \U0001b125", "Ᲊ ꟋꟌ"],
)
def test_the_library_agrees(ours, theirs, text):
    same(ours, theirs, text)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(alphabet="aetinosr'  .!1éßÀ中я<|>", max_size=60)))
def test_the_library_agrees_on_any_text(ours, theirs, text):
    if any(0xD800 <= ord(c) < 0xE000 for c in text):
        return
    same(ours, theirs, text)


#: White space and separators of every kind, as the one library or the other sees them.
ODD_SPACES = "\x1c\x1d\x1e\x1f\x85\xa0\u2028\u2029\u3000\u200b \t\n\r\x0b\x0c"


@settings(max_examples=400, deadline=None)
@given(
    st.text(alphabet=ODD_SPACES, max_size=4),
    st.text(alphabet="ab.é1'" + ODD_SPACES, max_size=30),
    st.text(alphabet=ODD_SPACES, max_size=4),
)
def test_the_library_agrees_on_any_white_space(ours, theirs, before, text, after):
    same(ours, theirs, before + text + after)


def test_pairs_are_compatible_if_merging_leaves_them(ours):
    """Against merging the joint symbols, lowest rank first."""
    rng = random.Random(2)
    ids = [i for i in ours.length if not ours.pieces[i].endswith("</w>")]
    vocab = {ours._symbols(t): i for i, t in enumerate(ours.pieces) if i in ours.length}

    def merged(symbols):
        row = [vocab[s] for s in symbols]
        while True:
            ranked = [(ours.rank[p], i) for i, p in enumerate(zip(row, row[1:])) if p in ours.rank]
            if not ranked:
                return row
            _, i = min(ranked)
            row[i : i + 2] = [vocab[ours._symbols(ours.pieces[row[i]]) + ours._symbols(ours.pieces[row[i + 1]])]]

    for _ in range(3000):
        a, b = rng.choice(ids[:4000]), rng.choice(ids[:4000])
        assert ours.compatible(a, b) == (merged(ours._symbols(ours.pieces[a]) + ours._symbols(ours.pieces[b])) == [a, b])


def test_rows(spark, theirs):
    texts = ["Hello there", None, "", "x " * 30000, "Hello there", "page one\x1f page two\n"]
    rows = [(i, t, "z") for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, ids string")
    assert B.encoding_digests(df, PATH).count() == len(rows) + 1 == B.encode_documents(df, PATH).count()
    got = {r.doc_id: r for r in B.encoding_digests(df, PATH).collect()}
    ids = {r.doc_id: r.ids for r in B.encode_documents(df, PATH).collect()}
    back = {r.doc_id: r.text for r in B.decode_documents(B.encode_documents(df, PATH), PATH).collect()}
    for i, t in enumerate(texts):
        want = theirs.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        text = theirs.decode(want, skip_special_tokens=False)
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert np.frombuffer(ids[i], "<u4").tolist() == want and back[i] == text
    assert B.encoding_digests(df.limit(0), PATH).count() == 0


def test_caches_stay_small(ours, theirs, monkeypatch):
    for known in (ours._known, ours._known.before, ours._fits):
        known.clear()
    monkeypatch.setattr(B, "KNOWN_CHUNKS", 10)
    monkeypatch.setattr(B, "KNOWN_PAIRS", 10)
    text = " ".join(f"word{i}x" for i in range(100))
    same(ours, theirs, text + " " + text)
    ours.encode(text)
    assert len(ours._known) <= 10 and len(ours._known.before) <= 10 and len(ours._fits) <= 10
