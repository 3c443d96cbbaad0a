import datetime
import hashlib

import pytest
from pyspark.sql import functions as F

from strandline.llm import pii as P

TEXTS = [
    "mail bosbt.42@mail8.example.com and 42.144.35.254, card 4539 1488 0343 6467. ok",
    "+1 (988) 555-2485 x 2024-02-29 or 31.12.1999, 12/05/2001 not 2024-02-30",
    "GB82WEST12345698765432 123-45-6789 666-45-6789 999.1.1.1",
    None,
    "",
    "4041894974608795 4539148803436467 4539148803436467 4539148803436468",
    "no digits",
    "5551234567 1.2.3.4.5 +49 30 1234567",
    "4539148803436467",
    "x " * 40000 + "bosbt.42@mail8.example.com",
]


def slow_permuted(value, key, kind):
    """The same network in plain Python."""
    half = len(value) // 2
    left, right = value[:half], value[half:]
    form = "".join("0" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c for c in value)
    for r in range(P.ROUNDS):
        target, other = (left, right) if r % 2 == 0 else (right, left)
        stream = hashlib.sha256(f"{key}|{kind}|{r}|{form}|{other}".encode()).hexdigest()
        out = ""
        for i, c in enumerate(target):
            by = int(stream[i % 21 * 3 : i % 21 * 3 + 3], 16)
            base, size = (48, 10) if c.isdigit() else (97, 26) if c.islower() else (65, 26) if c.isupper() else (0, 0)
            out += chr((ord(c) - base + by) % size + base) if size else c
        left, right = (out, right) if r % 2 == 0 else (left, out)
    return left + right


def test_the_network_is_the_plain_one_and_goes_back(spark):
    values = ["", "7", "42", "1234567", "ab.C_9", "Zz99" * 12]
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", P.permuted(F.col("v"), "k", "x").alias("p"))
    rows = df.select("v", "p", P.permuted(F.col("p"), "k", "x", backwards=True).alias("b")).collect()
    for r in rows:
        assert r.p == slow_permuted(r.v, "k", "x") and r.b == r.v


@pytest.mark.parametrize("kind, n, value", [("x", 1000, "lpad(cast(id as string), 3, '0')"), ("date", 73049, "cast(date_add(date'1900-01-01', cast(id as int)) as string)"),
                                             ("ssn", 9000, "concat('123-', lpad(cast(id div 100 % 99 + 1 as string), 2, '0'), '-', lpad(cast(id % 100 + 1 as string), 4, '0'))")])
def test_values_stay_apart(spark, kind, n, value):
    v = F.expr(value)
    out = P.permuted(v, "k", "x") if kind == "x" else P.pseudonym(v, F.lit(kind), "k")
    df = spark.range(n).select(v.alias("v"), out.alias("p"))
    assert df.select("p").distinct().count() == df.select("v").distinct().count()
    if kind != "x":
        assert df.where(P.kind_of(F.col("p")).isNull()).count() == 0


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_rows(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, TEXTS[0], None)], "doc_id long, text string, _found string")
    rows = P.pseudonym_rows(df, "key").collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(TEXTS) + 1 and by[None].text == by[0].text
    counts = lambda i: {k: by[i][f"n_{k}"] for k in P.KINDS if by[i][f"n_{k}"]}
    assert counts(0) == {"email": 1, "ip": 1, "card": 1}
    assert counts(1) == {"phone": 1, "date": 3}
    assert counts(2) == {"iban": 1, "ssn": 1}
    assert counts(5) == {"card": 3} and counts(7) == {"phone": 1} and counts(9) == {"email": 1}
    assert by[3].text is None and by[4].text == "" and by[6].text == "no digits"
    # equal values have equal pseudonyms, across documents
    a, b, c, bad = by[5].text.split()
    assert b == c == by[8].text and bad == "4539148803436468" and luhn(a) and luhn(b) and b != "4539148803436467"
    assert by[9].text.split()[-1] == by[0].text.split()[1]
    assert by[2].text.endswith("666-45-6789 999.1.1.1") and "2024-02-30" in by[1].text
    back = P.pseudonymised(spark.createDataFrame(rows), "key", backwards=True).collect()
    assert {r.doc_id: r.text for r in back} == {**dict(enumerate(TEXTS)), None: TEXTS[0]}
    other = {r.doc_id: r.text for r in P.pseudonym_rows(df, "other").collect()}
    assert other[8] != by[8].text
    assert P.pseudonym_rows(df.limit(0), "key").count() == 0


def test_a_plan_without_python(spark):
    plan = P.pseudonym_rows(spark.createDataFrame([(1, "a")], "doc_id long, text string"), "k")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_card_beside_a_short_number(spark):
    card = "4111 1111 1111 1111"
    texts = [f"{card} 123", f"{card} 12/27", f"{card}-123", f"123 {card}", "3782-822463-10005 1234 x", "4111111111111111 12/27", "30569309025904 12"]
    texts += [f"{card} {i:03d}" for i in range(100)]
    rows = {r.doc_id: r for r in P.pseudonym_rows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key").collect()}
    keep = 0
    for i, t in enumerate(texts):
        assert rows[i].n_card == 1 and len(rows[i].text) == len(t) and card not in rows[i].text and "3782-822463-10005" not in rows[i].text
        if i > 6 and not luhn(t.replace(" ", "")):
            new = rows[i].text
            assert new[19:] == t[19:] and luhn(new[:19].replace(" ", "")) and not luhn(new.replace(" ", ""))
            keep += 1
    assert keep == 90
    assert rows[1].text.endswith("/27") and rows[5].text.endswith("/27")
    back = P.pseudonymised(spark.createDataFrame(list(rows.values())), "key", backwards=True).collect()
    assert {r.doc_id: r.text for r in back} == dict(enumerate(texts))
    # a wrong check digit stays
    bad = "4111 1111 1111 1112 123"
    assert not luhn(bad.replace(" ", "")) and P.pseudonym_rows(spark.createDataFrame([(1, bad)], "doc_id long, text string"), "key").first().text == bad


def test_an_iban_in_groups(spark):
    grouped = ["GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947", "BE68 5390 0754 7034"]
    texts = [t for g in grouped for t in (f"to {g}.", f"to {g.replace(' ', '')}.")] + ["to GB82 WEST 1234 5698 7654 33.", "DE89 3704 0044 0532 0130 00 or"]
    rows = {r.doc_id: r for r in P.pseudonym_rows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key").collect()}
    for i in range(0, 2 * len(grouped), 2):
        new = rows[i].text
        assert rows[i].n_iban == rows[i + 1].n_iban == 1 and new != texts[i] and len(new) == len(texts[i])
        assert [len(x) for x in new.split()] == [len(x) for x in texts[i].split()]
        # one account has one pseudonym, however it is written
        assert new.removeprefix("to ").replace(" ", "") == rows[i + 1].text.removeprefix("to ")
    assert rows[8].text == texts[8] and rows[9].n_iban == 1 and rows[9].text.endswith(" or")
    back = P.pseudonymised(spark.createDataFrame(list(rows.values())), "key", backwards=True).collect()
    assert {r.doc_id: r.text for r in back} == dict(enumerate(texts))


def test_dates_with_the_month_first(spark):
    texts = ["born 12/31/1985", "12/31/1985 02/29/2024", "02/30/2024 13/13/1999 00/13/1999", "31/12/1985 1985-12-31"]
    texts += [f"{m:02d}/{d}/20{y:02d}" for y in range(100) for m in (1, 2, 12) for d in (13, 28)]
    rows = {r.doc_id: r for r in P.pseudonym_rows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key").collect()}
    assert rows[0].n_date == 1 and rows[1].n_date == 2 and rows[2].n_date == 0 and rows[2].text == texts[2]
    assert rows[0].text.split()[1] == rows[1].text.split()[0] != "12/31/1985"
    news = [rows[i].text for i in range(4, len(texts))]
    assert len(set(news)) == len(news)
    for new in news:
        m, d, y = map(int, new.split("/"))
        assert 12 < d and datetime.date(y, m, d)
    back = P.pseudonymised(spark.createDataFrame(list(rows.values())), "key", backwards=True).collect()
    assert {r.doc_id: r.text for r in back} == dict(enumerate(texts))
