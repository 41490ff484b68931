"""Surrogates: what is replaced, by what, and that values stay distinct and the same everywhere."""

import random
import re
from collections import defaultdict

import pytest
import regex
from pyspark.sql import functions as F

from tidewheel.llm import pii


def texts(df, **more):
    return {r["doc_id"]: r["text"] for r in pii.replace_entities(df, **more).collect()}


def frame(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def test_names_keep_what_they_share(spark):
    out = texts(frame(spark, "Mr. Smith met Mrs. Smith and Mr. John Smith; Ms. Anna Brown, Mr. John Brown. Frau Smith", "Mrs. Anna Smith, Г-н Иванов, Г-жа Иванов and Herr John Smith"))
    a = re.search(r"Mr\. (\w+) met Mrs\. (\w+) and Mr\. (\w+) (\w+); Ms\. (\w+) (\w+), Mr\. (\w+) (\w+)\. Frau (\w+)$", out[0]).groups()
    b = re.search(r"^Mrs\. (\w+) (\w+), Г-н (\w+), Г-жа (\w+) and Herr (\w+) (\w+)$", out[1]).groups()
    smith, brown, john, anna = a[0], a[5], a[2], a[4]
    assert {a[0], a[1], a[3], a[8], b[1], b[5]} == {smith} and a[7] == brown != smith
    assert a[6] == john == b[4] and b[0] == anna != john and john.endswith("n") and anna.endswith("a")
    assert b[2] == b[3] and re.fullmatch("[а-яА-Я]+", b[2])
    assert not {"Smith", "Brown", "John", "Anna", "Иванов"} & set(re.findall(r"\w+", " ".join(out.values())))


def test_names_that_collide_take_another_key_each_by_itself(spark, monkeypatch):
    plain = pii.surrogate

    def crowded(kind, value, attempt, key):
        return F.when((attempt < 2) & kind.isin("family", "given"), F.lit("Smith")).otherwise(plain(kind, value, attempt, key))

    monkeypatch.setattr(pii, "surrogate", crowded)
    out = texts(frame(spark, "Mr. Smith, Mrs. Smith, Mr. John Brown, Mrs. Brown", "Mr. Brown and Mr. John Smith"))
    a = re.search(r"Mr\. (\w+), Mrs\. (\w+), Mr\. (\w+) (\w+), Mrs\. (\w+)$", out[0]).groups()
    b = re.search(r"Mr\. (\w+) and Mr\. (\w+) (\w+)$", out[1]).groups()
    assert a[0] == a[1] == b[2] and a[3] == a[4] == b[0] != a[0] and a[2] == b[1]
    assert "Smith" not in a + b


def test_crowded_spaces_of_numbers(spark):
    """Every number of five digits occurs: all stay distinct, none stays what it was, and nothing fails."""
    numbers = [f"+1 {i:04d}"[:5] + f" {i % 100:02d}" for i in range(10_000)]
    out = pii.replace_entities(spark.createDataFrame([(i, n) for i, n in enumerate(numbers)], "doc_id long, text string")).collect()
    assert all(r["n_entities"] == 1 and r["text"] != numbers[r["doc_id"]] and re.fullmatch(r"\+\d \d\d \d\d", r["text"]) for r in out)
    by = {}
    for r in out:
        assert by.setdefault(numbers[r["doc_id"]], r["text"]) == r["text"]
    assert len(set(by.values())) == len(by)
    digits = spark.range(100_000).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("n"))
    found = {r["n"]: r["s"] for r in digits.select("n", pii.permuted(F.col("n"), "k", F.lit("s")).alias("s")).collect()}
    assert set(found.values()) == set(found) and all(n != s for n, s in found.items())


def test_hosts_are_permuted(spark):
    rng = random.Random(1)
    hosts = {".".join(str(rng.randrange(256)) for _ in range(4)) for _ in range(300)} | {"255.255.255.255", "0.0.0.0"}
    df = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", pii.surrogate(F.lit("host"), F.col("h"), F.lit(0), "k").alias("s"))
    rows = df.collect()
    assert len({r["s"] for r in rows}) == len(hosts) and all(r["s"] != r["h"] for r in rows)
    assert all(max(map(int, r["s"].split("."))) < 256 and r["s"].count(".") == 3 for r in rows)


def test_keys(spark):
    df = frame(spark, "write to a.b@mail.example.com")
    one, two = texts(df, key="first"), texts(df, key="second")
    assert one != two and texts(df, key="first") == one
    spark.conf.set(pii.KEY_SETTING, "second")
    try:
        assert texts(df) == two
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def test_edges(spark):
    odd = "\x01 a@b.example.com \x02\x04\x02\x03\x01 x $1 \\ é😀"
    rows = [(1, None), (2, ""), (None, "c@d.example.org"), (4, odd), (4, odd), (5, "word " * 30_000 + "a@b.example.com"), (6, "\x02\x04")]
    df = spark.createDataFrame([(i, t, "n", 3, "p", 4) for i, t in rows], "doc_id long, text string, n_entities string, near int, pieces string, id long").repartition(2)
    out = pii.replace_entities(df)
    assert out.columns == ["doc_id", "text", "near", "pieces", "id", "n_entities"]
    got = defaultdict(list)
    for r in out.collect():
        assert (r["near"], r["pieces"], r["id"]) == (3, "p", 4)
        got[r["doc_id"]].append((r["text"], r["n_entities"]))
    assert got[1] == [(None, 0)] and got[2] == [("", 0)] and got[6] == [("\x02\x04", 0)]
    mail = got[4][0][0].split(" ")[1]
    assert got[4] == [(odd.replace("a@b.example.com", mail), 1)] * 2 and got[5] == [("word " * 30_000 + mail, 1)]
    same = pii.replace_entities(df, count_col=None)
    assert same.columns == df.columns and {r["n_entities"] for r in same.collect()} == {"n"}
    assert pii.replace_entities(df.limit(0)).count() == 0


PLAIN = regex.compile(pii.PATTERN)


def normal(raw):
    """(kind, value) in which spellings of one value are equal, for kinds whose format tells them apart."""
    if "@" in raw:
        return "email", raw.lower()
    if regex.match(r"\p{L}+-?\p{L}*\.? \p{Lu}\p{Ll}", raw) and not regex.match(r"[A-Z]{2}\d", raw):
        return "person", raw.split(" ", 1)[1]
    if regex.fullmatch("[0-9a-fA-F]{32,128}", raw):
        return "secret", raw.lower()
    if raw.count(".") == 3 and regex.fullmatch(r"[\d.]+", raw) and all(int(x) < 256 for x in raw.split(".")):
        return "host", raw
    return "number", regex.sub("[^0-9A-Z]", "", raw)


def shape(kind, raw):
    if kind == "number":
        return regex.sub("[0-9]", "9", raw)
    if kind == "secret":
        return len(raw), raw == raw.upper()
    if kind == "person":
        return raw.split(" ")[0], raw.count(" "), bool(regex.search(r"\p{IsCyrillic}", raw))
    return kind


@pytest.fixture(scope="module")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def test_documents_against_a_plain_reading(documents):
    """All else stays as it is, every entity has one stand-in of its own, and that has its format."""
    before = {r["doc_id"]: r["text"] for r in documents.collect()}
    stands, n = {}, 0
    for r in pii.replace_entities(documents).collect():
        old, new = before[r["doc_id"]], r["text"]
        found = list(PLAIN.finditer(old))
        assert r["n_entities"] == len(found)
        n += len(found)
        at, pattern = 0, ""
        for m in found:
            pattern += regex.escape(old[at : m.start()], literal_spaces=True) + "(.+?)"
            at = m.end()
        hit = regex.fullmatch(pattern + regex.escape(old[at:], literal_spaces=True), new, flags=regex.DOTALL)
        assert hit
        for m, stand in zip(found, hit.groups(), strict=True):
            kind, value = normal(m.group())
            assert normal(stand)[0] == kind and shape(kind, stand) == shape(kind, m.group())
            assert stands.setdefault((kind, value), normal(stand)[1]) == normal(stand)[1] != value
    assert n > 10 and len({(k, s) for (k, _), s in stands.items()}) == len(stands)
