"""Operators without shuffles of texts against the libraries or brute force, and their edge cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.llm import decontamination, license_scan, lm_scoring, packing, pii, quality_classifier, quality_rules, substring_dedup, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")

EDGES = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (None, "a text without an id, repeated"), (None, "a text without an id, repeated"), (6, "word " * 3000), (6, "word " * 3000), (7, "é梦 😀 <|endoftext|> <s> naïve space　wide")]


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(i, t, "en", None if i == 4 else "src0", 5, "x", 1, 2, 3) for i, t in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, word long, n long, part long").repartition(2)


@pytest.fixture(scope="module")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def texts_of(df):
    return {r["doc_id"]: r["text"] or "" for r in df.select("doc_id", "text").collect()}


def noise(pieces, n, most, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(most))) for _ in range(n)]


# ---- token counts


def test_token_counts_are_the_librarys():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    with open(path, "rb") as f:
        count = token_counts.TextCounter(token_counts.PieceMerger(f.read()))
    texts = noise(list(" \n\t  abcdehlnorst▁éß梦벨\x00\x01😀<>/0123.,") + ["membres", "s", "er", "▁▁▁", "==", "tion", "<s>"], 1500, 50)
    texts += ["", " ", "a" * 3000, " " * 40 + "x" + " " * 35, " " * 20_000, "membres" * 300, "<unk>", "<0x0A>", "\n" * 50]
    assert count([t.encode() for t in texts]) == [len(x) for x in library.encode(texts, num_threads=1)]


def test_token_counts_edges(edges, spark):
    rows = token_counts.token_counts(edges, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert len(rows) == len(EDGES)
    got = {(r["doc_id"]): r for r in rows}
    assert got[1]["n_tokens"] == got[2]["n_tokens"] == got[1]["n_bytes"] == 0
    assert got[6]["over_limit"] is False or got[6]["n_tokens"] > 4096
    empty = token_counts.token_counts(edges.limit(0), public_tokenizers.path("piece_bpe_32k.model"))
    assert empty.count() == 0


# ---- packing


def test_ids_are_the_librarys():
    from tokenizers import Tokenizer

    with open(packing.vocabulary_path(), encoding="utf-8") as f:
        vocabulary = f.read()
    ids, library = packing.ByteLevelIds(vocabulary), Tokenizer.from_str(vocabulary)
    pieces = ["a", "don't", "'s", " ", "  ", "\n", "\t", " ", "　", "\x1c", "\x85", "é", "1", "23", "!?", "_", "😀", "梦", "<|endoftext|>", "the", " and", "\n ", "\r\n"]
    for text in noise(pieces, 3000, 14):
        assert np.frombuffer(ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def check_packing(rows, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.vocabulary_path())
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids = np.array(library.encode(texts[doc], add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : at].tobytes())
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    return sum(r["length"] for r in rows), len(by_sequence)


def test_packing(documents):
    total, sequences = check_packing(packing.pack_documents(documents, packing.vocabulary_path()).collect(), texts_of(documents))
    assert sequences * 1024 - total <= 0.02 * sequences * 1024


def test_packing_edges(edges):
    rows = packing.pack_documents(edges, packing.vocabulary_path()).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 1) == 1
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert packing.pack_documents(edges.limit(0), packing.vocabulary_path()).count() == 0


def test_histogram_packs_everything_once():
    rng = random.Random(5)
    lengths = [rng.choice([1, 7, 100, 511, 512, 513, 1000, 1023, 1024]) for _ in range(3000)]
    patterns = packing.pack_histogram(Counter(lengths))
    used = Counter()
    for pattern, n in patterns:
        assert sum(pattern) <= 1024 and n > 0
        for length in pattern:
            used[length] += n
    assert used == Counter(lengths)
    assert packing.pack_histogram({}) == []


# ---- quality rules


def brute_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    runs = {}
    for i in range(n - 7):
        runs.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for at in runs.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_quality_rules_measures(documents, edges):
    for df in (documents, edges):
        texts = texts_of(df)
        for r in quality_rules.judge(df).collect():
            assert tuple(r[f] for f in FIELDS) == brute_measures(texts[r["doc_id"]])
            assert not (r["kept"] and r["base_failed"])
    assert quality_rules.judge(edges.limit(0)).count() == 0


def test_quality_rules_reject_depleted_documents(spark):
    rng = random.Random(2)

    def prose(n):
        return " ".join(rng.choice(["sun", "moon", "star", "sea", "hill", "wood"]) + str(rng.randrange(10**6)) for _ in range(n))

    common = " ".join(f"notice{k}" for k in range(40))
    rows = [(i, prose(30) + "\n" + common, "a") for i in range(60)] + [(100, "  " + common.upper() + "\n" + common + "\nbye now", "a"), (101, common + "\nbye now", "b")]
    copied = "\n".join(prose(12) for _ in range(5))
    rows += [(200 + i, copied, "a") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(df.where("doc_id <> 100")).collect()}
    assert all(kept[i] for i in range(60)) and kept[101] and all(kept[200 + i] for i in range(80))
    both = quality_rules.judge(spark.createDataFrame(rows + [(102, common + "\nbye now", "a")], df.schema))
    assert {r["doc_id"] for r in both.collect() if not r["kept"]} >= {102}
    assert {r["doc_id"] for r in quality_rules.keep(df.where("doc_id < 60")).collect()} == set(range(60))


def test_quality_rules_count_documents_that_share_several_lines(spark):
    shared = [" ".join(f"menu{k}x{j}" for j in range(12)) for k in range(10)]
    rows = [(i, "\n".join([f"title {i}", *shared]), "a") for i in range(100)]
    rows += [(1000 + i, "\n".join(["one page", *shared[:2], "copied often"]), "a") for i in range(400)]  # copies count once and hide nothing
    rows += [(2000 + i, "\n".join([f"title {i}", *shared]), "b") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(df).collect()}
    assert not any(kept[i] for i in range(100)) and all(kept[2000 + i] for i in range(20))
    keyed = quality_rules._keyed(df, "doc_id", "text", "source")
    counts = {(r["host"], r["n_docs"]) for r in quality_rules.frequent_lines(quality_rules._lines(keyed), keyed).collect()}
    assert counts == {("a", 100), ("a", 101)}


def test_frequent_lines_are_cut_out(spark):
    rng = random.Random(8)
    own = ["\n".join(" ".join(f"w{rng.randrange(10**6)}" for _ in range(15)) for _ in range(3)) for _ in range(40)]
    menu, bar = "Home  About us Contact", "terms of use apply here"
    rows = [(i, f"{menu}\n{t}\n\n  {bar.upper()}", "a", 0) for i, t in enumerate(own)] + [(100, f"{menu}\n{own[0]}", "b", 7), (None, f"{own[1]}\n{menu}", "a", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    out = {r["doc_id"]: r for r in quality_rules.clean(df).collect()}
    assert len(out) == len(rows) and quality_rules.clean(df).columns == df.columns
    for i, t in enumerate(own):
        assert out[i]["text"] == f"{t}\n" and out[i]["n_chars"] == len(t) + 1
    assert out[100]["text"] == rows[-2][1] and out[100]["n_chars"] == 7 and out[None]["text"] == own[1]
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    assert {r["text"] for r in corpus_pipeline.quality(spark, df, "").collect()} == {r["text"] for r in out.values()}
    assert quality_rules.clean(df.limit(0)).count() == 0


# ---- decontamination


def test_decontamination(spark):
    rng = random.Random(3)

    def word():
        return "".join(rng.choice("abcdefghij") for _ in range(6))

    items = [[word() for _ in range(n)] for n in (30, 15, 59, 7, 3)]
    plain = lambda n: [word() for _ in range(n)]
    changed = list(items[0])
    for k in (4, 13, 21):
        changed[k] = word()
    rows = [(1, [*plain(50), *items[0], *plain(20)]), (2, [*plain(10), *changed, *plain(9)]), (3, plain(300)), (4, [*items[1], *plain(9)]), (5, items[2][:20]), (6, [*plain(4), *items[3], *plain(4)]), (7, items[4]), (8, items[0][:6] + plain(30) + items[2][:7])]
    docs = spark.createDataFrame([(i, " ".join(w).upper() + "!!") for i, w in rows] + [(None, " ".join(items[0])), (9, None), (10, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(9, None)], "item_id long, text string")
    want = {(1, 0), (2, 0), (4, 1), (5, 2), (6, 3), (None, 0)}
    for bits in (1 << 27, 64):  # almost empty and full
        assert {(r["doc_id"], r["item_id"]) for r in decontamination.overlaps(docs, bench, bits=bits).collect()} == want
    assert decontamination.overlaps(docs, bench.limit(0)).count() == 0
    assert decontamination.overlaps(docs.limit(0), bench).count() == 0
    assert {r["doc_id"] for r in decontamination.clean(docs.withColumn("item", F.lit(1)), bench).collect()} == {3, 7, 8, 9, 10}


# ---- license scans


def test_license_scan_against_every_place(documents, edges):
    templates = license_scan.compile_templates(license_scan.TEMPLATES)
    hashes = license_scan.WordHashes()
    for df in (documents, edges):
        got = {(r["doc_id"], r["license"]): r["containment"] for r in license_scan.scan(df).collect()}
        want = {}
        for doc, text in texts_of(df).items():
            items = license_scan.shingles(hashes.of(license_scan.tokens(text.encode())), 5)
            for c in templates:
                for name, template, size in c.templates:
                    share, _ = license_scan._verify(items, template, size, license_scan.CONTAINMENT)
                    if share:
                        want[doc, name] = share
        assert got == want
    assert license_scan.scan(edges.limit(0)).count() == 0
    with pytest.raises(ValueError):
        license_scan.compile_templates({"x": "too short"})


def test_license_scan_tolerates_changes(spark):
    full = license_scan.TEMPLATES["GPL-notice"].split()
    full[3] = "freeish"
    df = spark.createDataFrame([(1, "a b c d " * 40 + " ".join(full) + " e f g h" * 9), (2, "free software " * 50)], "doc_id long, text string")
    assert {(r["doc_id"], r["license"]) for r in license_scan.scan(df).collect()} == {(1, "GPL-notice")}


def test_license_lines_of_documents(spark, documents):
    lines = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0-short", "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    texts = texts_of(documents)
    assert sum(line in t for t in texts.values() for line in lines)
    found = {}
    for r in license_scan.scan(documents).collect():
        found.setdefault(r["doc_id"], set()).add(r["license"])
    for doc, text in texts.items():
        assert found.get(doc, set()) >= {name for line, name in lines.items() if line in text}
    rest = {
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": "CC-BY-NC-SA-4.0-name",
        "Available under the CC BY-NC-ND 4.0 license": "CC-BY-NC-ND-4.0-short",
        "licensed under cc by 3.0": "CC-BY-3.0-short",
        "a Creative Commons Attribution-NoDerivs 3.0 Unported License": "CC-BY-ND-3.0-derivs",
        "Licensed under the GNU General Public License, version 2 only": "GPL-2.0",
        "Licensed under the BSD 3-Clause License": "BSD-3-Clause",
        "Text under a CC BY-SA 4.0 license": "CC-BY-SA-4.0-short",
    }
    df = spark.createDataFrame([(i, f"Some words before it. {line} And some after.") for i, line in enumerate([*rest, *lines])], "doc_id long, text string")
    got = {}
    for r in license_scan.scan(df).collect():
        got.setdefault(r["doc_id"], set()).add(r["license"])
    assert all(name in got[i] for i, name in enumerate([*rest.values(), *lines.values()]))
    for i, line in enumerate([*rest, *lines]):  # none is taken for non-commercial
        assert {"NC" in n for n in got[i]} == {"NC" in line or "NonCommercial" in line}


# ---- personal data


def test_surrogates(spark):
    text = 'Mail hein.19@mail5.example.com or HEIN.19@mail5.example.com, +1 (521) 555-6210; 521-555-6210. ip 13.149.130.89, 4390698575873170 and 4390-6985-7587-3170 token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" Mr. John Smith met Mrs. Anna Smith; Mr. Smith. Г-н Иванов. DE89 3704 0044 0532 0130 00 123-45-6789 end'
    df = spark.createDataFrame([(1, text, 7), (2, "clean text 12 1234 on 2019-10-11, v1.2.3.", 8), (3, None, 9), (None, "", 1), (4, "again hein.19@mail5.example.com", 2)], "doc_id long, text string, n_entities_before long")
    rows = {r["doc_id"]: r for r in pii.replace_entities(df).collect()}
    new = rows[1]["text"]
    for value in re.findall(pii.PATTERN.replace("++", "+").replace(")*+", ")*").split("(?<=\\.")[0], text) or ["hein.19@mail5.example.com"]:
        assert value not in new
    mails = re.findall(r"[\w.]+@[\w.]+", new)
    assert mails[0] == mails[1] and mails[0] in rows[4]["text"] and mails[0].rstrip(".").endswith(".org")
    long, short = re.search(r"\+1 \((\d{3})\) (\d{3})-(\d{4}); (\d{3}-\d{3}-\d{4})", new).group(0).split("; ")
    assert re.sub(r"\D", "", long)[1:] == re.sub(r"\D", "", short)
    card, spaced = re.search(r"(\d{16}) and (\d{4}-\d{4}-\d{4}-\d{4})", new).groups()
    assert card == spaced.replace("-", "")
    names = re.search(r"Mr\. (\w+) (\w+) met Mrs\. (\w+) (\w+); Mr\. (\w+)\.", new).groups()
    assert names[1] == names[3] == names[4] and names[2].endswith("a") and names[0].endswith("n")
    assert re.search(r"Г-н [а-яА-Я]+\.", new) and re.search(r'"[0-9a-f]{40}"', new)
    assert rows[2]["text"] == "clean text 12 1234 on 2019-10-11, v1.2.3." and rows[2]["n_entities"] == 0
    assert rows[3]["text"] is None and rows[None]["text"] == ""
    assert pii.replace_entities(df.limit(0)).count() == 0


def luhn(number):
    digits = [int(c) for c in number][::-1]
    return (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0


def test_card_numbers_stay_valid_and_distinct(spark):
    rng = random.Random(4)
    numbers = {"".join(rng.choice("0123456789") for _ in range(16)) for _ in range(200)}
    df = spark.createDataFrame([(n,) for n in numbers], "n string").select("n", pii.surrogate(F.lit("card"), F.col("n"), F.lit(0), "k").alias("s"))
    rows = df.collect()
    assert len({r["s"] for r in rows}) == len(numbers)
    assert all(luhn(r["n"]) == luhn(r["s"]) for r in rows)


def test_permutation_is_one(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("n")).select(pii.permuted(F.col("n"), "k", F.lit("s")).alias("s"))
    assert {r["s"] for r in df.collect()} == {f"{i:03d}" for i in range(1000)}


def test_collisions_take_another_key(spark, monkeypatch):
    plain = pii.surrogate

    def crowded(kind, value, attempt, key):  # first tries collide
        return F.when(attempt == 0, F.lit("aaaa@b.example.org")).otherwise(plain(kind, value, attempt, key))

    monkeypatch.setattr(pii, "surrogate", crowded)
    df = spark.createDataFrame([(1, "a@x.com and b@x.com"), (2, "b@x.com"), (3, "c@x.com, aaaa@b.example.org")], "doc_id long, text string")
    texts = {r["doc_id"]: re.findall(r"[\w.]+@[\w.]+", r["text"]) for r in pii.replace_entities(df).collect()}
    stand_ins = [*texts[1], *texts[3]]
    assert len(set(stand_ins)) == 4 and "aaaa@b.example.org" not in stand_ins and texts[2] == [texts[1][1]]


# ---- substring dedup


def brute_repeats(docs, length=substring_dedup.RUN):
    seen, gone = set(), {}
    for doc, text in sorted(docs.items()):
        each = [tuple(substring_dedup.tokens(text.encode()[a:b])) for a, b in substring_dedup.sentences(text.encode())]
        for i in range(len(each) - length + 1):
            run = tuple(each[i : i + length])
            if sum(map(len, run)) < substring_dedup.MIN_WORDS:
                continue
            if run in seen:
                gone.setdefault(doc, set()).update(range(i, i + length))
            seen.add(run)
    return {d: sorted(x) for d, x in gone.items()}


def test_repeated_spans(documents):
    got = {r["id"]: r["removed"] for r in substring_dedup.repeated(documents).collect()}
    assert got == brute_repeats(texts_of(documents))


def test_repeats_are_cut_out(spark, edges):
    passage = "One sentence about rivers and seas. Another about mountains! A third one, on cities and towns.\nA fourth, finally, on roads."
    rows = [(1, "Start here. " + passage + " End of one."), (2, "Other words first.\n" + passage), (3, "Nothing shared in here. At all. Truly nothing to see."), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("place", F.lit(1))
    out = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeats(df).collect()}
    assert out[1] == rows[0][1] and out[3] == rows[2][1] and out[4] is None
    assert "rivers" not in out[2] and "roads" not in out[2] and out[2].startswith("Other words first.")
    assert substring_dedup.repeated(df.limit(0)).count() == 0
    assert substring_dedup.remove_repeats(edges).count() == len(EDGES)


def test_passages_repeat_in_differently_begun_text(spark):
    rng = random.Random(7)

    def prose(n):
        return " ".join("w" + str(rng.randrange(10**6)) for _ in range(n))

    passages = [prose(50) for _ in range(20)]
    rows = [(i, f"{prose(i % 16)} {p} {prose(9)}".strip()) for i, p in enumerate(passages)]
    rows += [(100 + i, f"{prose(3 * i % 17)} {p} {prose(i)}".strip()) for i, p in enumerate(passages)]
    short = "Yes. We can. Go. Do it. Now then. Stop. Or not. All right. So."  # no three sentences hold ten words
    rows += [(200, f"{prose(30)}. {short} {prose(30)}."), (201, f"{prose(20)}. {short}"), (202, f"{short} {prose(20)}."), (203, "Yes. We can. Go. " + prose(25))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeats(df).collect()}
    for i, p in enumerate(passages):
        assert out[i] == rows[i][1]
        assert len(set(p.split()) & set(out[100 + i].split())) <= 25  # at least half of it goes
        assert set(rows[20 + i][1].split()) - set(p.split()) <= set(out[100 + i].split())
    assert out[200] == rows[40][1] and out[203] == rows[43][1]
    assert not set(short.split()) & set(out[201].split()) and not set(short.split()) & set(out[202].split())


# ---- quality classifier


def test_resampling_prefers_what_looks_like_the_target(spark):
    rng = random.Random(6)
    good, bad = [f"g{i}" for i in range(40)], [f"b{i}#" for i in range(40)]
    rows = [(i, " ".join(rng.choice(good if i % 4 else bad) for _ in range(60))) for i in range(400)] + [(None, None), (1000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1))
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 400, 3)] + [(None, 1, 0), (5000, 1, None), (7, None, None)], "doc_id long, quality int, toxic int")
    out = quality_classifier.resample(docs, labels, share=0.74).collect()
    assert len(out) == len(rows) and sum(r["kept"] for r in out) == round(0.74 * len(rows))
    assert all(r["doc_id"] % 4 for r in out if r["kept"] and r["doc_id"] is not None and r["doc_id"] < 400)
    again = quality_classifier.resample(docs.repartition(5), labels, share=0.74).collect()
    assert {r["doc_id"] for r in out if r["kept"]} == {r["doc_id"] for r in again if r["kept"]}
    assert quality_classifier.resample(docs.limit(0), labels).count() == 0
    assert all(r["log_weight"] == 0 for r in quality_classifier.resample(docs, labels.limit(0)).collect())


def test_lowest_kept(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([0.0, 1.0, rng.gauss(0, 5)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, score double")
    ordered = sorted(rows, key=lambda r: (-r[1], r[0]))
    for k in (1, 10, 1500, 3000):
        score, i = quality_classifier.lowest_kept(df, k, bins=16, few=50)
        assert (i, score) == ordered[k - 1]
    assert quality_classifier.lowest_kept(df, 0) is None
