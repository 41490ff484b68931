"""Operators and stages against plain versions that share no code with them, and their odd rows."""

import math
import random
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewheel.llm import decontamination, license_scan, quality_classifier, quality_rules, substring_dedup

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def plain_tokens(text):
    return re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))


def prose(rng, n, words=10**6):
    return [f"w{rng.randrange(words)}" for _ in range(n)]


# ---- quality rules


@pytest.mark.parametrize("shared", [1, 2, 3, 5, 10])
def test_lines_that_pages_share(spark, shared):
    """300 pages of one host with some lines in common and one of their own, and copies of a page."""
    rng = random.Random(shared)
    common = [" ".join(prose(rng, 30)) for _ in range(shared)]
    own = [" ".join(prose(rng, 4)) for _ in range(300)]
    rows = [(i, "\n".join([own[i], *common]), "a", 7) for i in range(300)]
    long = [" ".join(prose(rng, 200)) for _ in range(40)]
    rows += [(1000 + i, f"{t}\n  {common[0].upper()}  ", "a", 7) for i, t in enumerate(long)]
    rows += [(2000 + i, "\n".join(["a page", *common]), "b", 7) for i in range(60)]  # copies count once
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    verdict = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality_rules.judge(df).collect()}
    assert all(verdict[i] == (False, False) for i in range(300))
    assert all(verdict[1000 + i] == (False, True) for i in range(40)) and all(verdict[2000 + i][1] for i in range(60))
    out = {r["doc_id"]: r for r in quality_rules.clean(df).collect()}
    assert set(out) == {i for i, (_, kept) in verdict.items() if kept}
    assert all(out[1000 + i]["text"] == long[i] and out[1000 + i]["n_chars"] == len(long[i]) for i in range(40))
    assert all(out[2000 + i]["text"] == rows[340 + i][1] for i in range(60))
    assert {r["doc_id"] for r in quality_rules.keep(df).collect()} == set(out)


# ---- decontamination


def best_overlap(doc, item):
    """The most matches of any run at any alignment in which matches outweigh substitutions, by 1 against 2, the most."""
    best = 0
    for begin in range(-len(item) + 1, len(doc)):
        total, matches, sums = 0, [0], [0]
        for k in range(max(0, -begin), min(len(item), len(doc) - begin)):
            same = doc[begin + k] == item[k]
            total += 1 if same else -2
            sums.append(total)
            matches.append(matches[-1] + same)
        low_at, top = 0, (0, 0, 0)
        for e, x in enumerate(sums):
            if x < sums[low_at]:
                low_at = e
            if x - sums[low_at] > top[0]:
                top = (x - sums[low_at], low_at, e)
        best = max(best, matches[top[2]] - matches[top[1]])
    return best


def seeded(doc, item):
    """Whether an alignment shares what some mask looks at."""
    masks = [(0, 1, 2, 4, 7, 8), (0, 1, 3, 6, 7, 9), (0, 2, 3, 5, 8, 9), (0, 1, 2, 4, 5, 6)] if len(item) >= 10 else [tuple(range(len(item)))]
    for salt in masks:
        there = {tuple(item[i + p] for p in salt) for i in range(len(item) - salt[-1])}
        if any(tuple(doc[i + p] for p in salt) in there for i in range(len(doc) - salt[-1])):
            return True
    return False


def test_overlaps_at_every_alignment(spark):
    rng = random.Random(5)
    items = [prose(rng, n, 40) for n in (5, 7, 9, 10, 14, 30, 50)] + [prose(rng, 8)]
    items.append(list(items[5]))  # equal tokens
    docs = []
    for i in range(60):
        words = prose(rng, rng.randrange(0, 60), 40)
        item = list(rng.choice(items))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
            item[rng.randrange(len(item))] = "changed"
        docs.append((i, words + item[: rng.choice([len(item), len(item), 6])] + prose(rng, 5, 40)))
    docs.append((100, [w if k % 4 else "x" for k, w in enumerate(items[6])]))  # every fourth replaced
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string").withColumns({"lead": F.lit(1), "class": F.lit("c"), "n": F.lit(2)})
    bench = spark.createDataFrame([(f"item{k}", " ".join(w)) for k, w in enumerate(items)] + [(None, None)], "item_id string, text string")
    want = {}
    for i, w in docs:
        for k, item in enumerate(items):
            n = best_overlap(w, item)
            if n >= min(13, max(5, math.ceil(0.8 * len(item)))) and seeded(w, item):
                want[i, f"item{k}"] = n
    got = {(r["doc_id"], r["item_id"]): r["n_match"] for r in decontamination.overlaps(df, bench).collect()}
    assert got.keys() == want.keys() and len(got) > 30 and (100, "item6") in got
    assert sum(got[x] == want[x] for x in got) >= 0.95 * len(got)  # a better run elsewhere may lack a seed
    assert all(got[x] <= want[x] for x in got)
    left = decontamination.clean(df, bench)
    assert left.columns == df.columns and {r["doc_id"] for r in left.collect()} == {i for i, _ in docs} - {i for i, _ in got}


# ---- license scans


def test_containment_of_every_template_at_every_place(documents):
    texts = {r["doc_id"]: plain_tokens(r["text"]) for r in documents.collect()}
    templates = {name: plain_tokens(t) for name, t in license_scan.TEMPLATES.items()}
    want = {}
    for name, t in templates.items():
        sets = {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
        for doc, words in texts.items():
            runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
            if not sets & set(runs):
                continue
            width = len(t) - 4
            best = max(len(sets & set(runs[i : i + width])) for i in range(len(runs)))
            if best >= 0.8 * len(sets):
                want[doc, name] = best / len(sets)
    got = {(r["doc_id"], r["license"]): r["containment"] for r in license_scan.scan(documents).collect()}
    assert got == pytest.approx(want) and got


# ---- substring dedup


def plain_sentences(text):
    out = []
    for line in text.split("\n"):
        for part in re.split(r"(?<=[.!?])[ \t\x0b\f\r]+|(?<=[。！？])[ \t\x0b\f\r]*", line):
            if plain_tokens(part):
                out.append(part)
    return out


def test_runs_of_short_sentences_against_plain_ones(spark):
    """Sentences of at most 16 words are cut nowhere else; runs of three with ten words are repeated or not."""
    rng = random.Random(9)
    pool = [" ".join(prose(rng, rng.randrange(4, 12))).capitalize() + rng.choice(".!?") for _ in range(40)] + ["这是一个关于山川河流的长句子。", "另一个句子说的是城市和道路！", "第三个句子问的是海洋在哪里？", "最后一句话写的是天空与星辰。"]
    rows = []
    for i in range(60):
        at = rng.randrange(len(pool) - 5)
        rows.append((f"d{i:02d}", rng.choice([" ", "\n", "  "]).join(rng.choice([rng.sample(pool, 4), pool[at : at + 5], pool[-4:]]))))
    df = spark.createDataFrame([*rows, (None, rows[0][1]), ("e", None)], "doc_id string, text string").withColumns({"removed": F.lit(1), "its_id": F.lit("x"), "row": F.lit(2)})
    seen, want = set(), {}
    for i, t in [*sorted(rows), (None, rows[0][1])]:
        each = [tuple(plain_tokens(x)) for x in plain_sentences(t)]
        gone = set()
        for k in range(len(each) - 2):
            run = tuple(each[k : k + 3])
            size = sum(len(w) for w in run) + sum(len(re.findall("[぀-鿿]", w)) for x in run for w in x)
            if size >= 10:
                if run in seen:
                    gone.update(range(k, k + 3))
                seen.add(run)
        if gone:
            want[i] = sorted(gone)
    got = {r["id"]: r["removed"] for r in substring_dedup.repeated(df).collect()}
    assert got == want and any("这是" in t for i, t in rows if i in want)
    out = substring_dedup.remove_repeats(df)
    assert out.columns == df.columns and out.where("removed = 1 and its_id = 'x' and row = 2").count() == len(rows) + 2


# ---- quality classifier


def plain_features(text, buckets):
    mask = (1 << 64) - 1

    def mix(x):
        x ^= x >> 32
        x = x * 0x9E3779B97F4A7C15 & mask
        x ^= x >> 29
        x = x * 0xBF58476D1CE4E5B9 & mask
        return x ^ x >> 32

    tokens = re.findall(rb"[0-9A-Za-z_\x80-\xff]+|[^\s0-9A-Za-z_\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), text.encode()))
    h = [xxhash.xxh3_64_intdigest(t) for t in tokens]
    a, b = (xxhash.xxh3_64_intdigest(f"m{i}", seed=61) | 1 for i in range(2))
    return [mix(x) % buckets for x in h] + [mix((x * a + y * b) & mask) % buckets for x, y in zip(h, h[1:], strict=False)]


def noise(i, seed=7):
    """Spark's hash of the seed, then of the id as text, as a number between 0 and 1, then Gumbel's noise."""
    h = xxhash.xxh64_intdigest(struct.pack("<i", seed), 42)
    h = xxhash.xxh64_intdigest(("" if i is None else str(i)).encode(), h)
    return -math.log(-math.log(((h % (1 << 52)) + 0.5) / (1 << 52)))


def test_resampling_against_a_plain_version(spark, small, documents):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    docs = documents.unionByName(spark.createDataFrame([(None, "no id here", "en", "s", 1), (10**6, None, "en", "s", 1), (10**6 + 1, "", "en", "s", 1)], documents.schema)).withColumns({"score": F.lit(1), "good": F.lit(2), "id": F.lit("i")})
    buckets = quality_classifier.BUCKETS
    raw, target = np.zeros(buckets), np.zeros(buckets)
    marked = labels.collect()
    good = {r["doc_id"] for r in marked if r["quality"] == 1 and not r["toxic"]}
    rows = [(r["doc_id"], plain_features(r["text"] or "", buckets)) for r in docs.collect()]
    for i, f in rows:
        for x in f:
            raw[x] += 1
            target[x] += i in good
    p = (raw + 1) / (raw.sum() + buckets)
    q = (target + buckets * p) / (target.sum() + buckets)
    weight = {i: float(np.log(q / p)[f].sum()) if f else 0.0 for i, f in rows}
    share = sum(r["quality"] == 1 for r in marked if r["quality"] is not None) / sum(r["quality"] is not None for r in marked) + 0.05
    order = sorted(weight, key=lambda i: -(weight[i] + noise(i)))
    kept = set(order[: round(share * len(rows))])
    out = quality_classifier.resample(docs, labels).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["log_weight"] == pytest.approx(weight[r["doc_id"]], abs=1e-6) and r["gumbel"] == pytest.approx(noise(r["doc_id"]), abs=1e-6)
        assert r["kept"] == (r["doc_id"] in kept)


def test_ties_are_taken_by_id(spark):
    rows = [(i, float(i % 3 == 0)) for i in range(4000)] + [(None, 1.0)] * 50
    df = spark.createDataFrame(rows, "id long, score double")
    tied = sorted(i for i, s in rows if s == 1.0 and i is not None)
    for k in (1, 700, len(tied)):
        assert quality_classifier.lowest_kept(df, k, bins=16, few=50) == (1.0, tied[k - 1])
    assert quality_classifier.lowest_kept(df, len(tied) + 20, bins=16, few=50) == (1.0, None)


# ---- stages of the pipeline


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, very long, repeated ids and rows, and columns with names of the operators."""
    rng = random.Random(4)
    a, b, c = (" ".join(prose(rng, 60)) for _ in range(3))
    near_b = " ".join(b.split()[:-2] + ["other", "end"])
    rows = [(1, a), (6, a), (6, b), (7, near_b), (8, c), (8, c), (None, c), (9, None), (10, ""), (11, " \n\t"), (12, " ".join(prose(rng, 30_000))), (None, "short text of few words")]
    df = spark.createDataFrame([(i, t, "en", None if k % 3 else "s", len(t or ""), "x", 1, 2.0, {"m": 1}) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, row string, near int, n_entities double, extra map<string,int>")
    return df.withColumns({c: F.lit(3) for c in ("id", "held", "pieces", "text_key", "lead", "first", "component", "gone", "key", "host", "m")})


def texts(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_stages_with_odd_rows(spark, small, odd):
    rows = texts(odd)
    kept = stage("quality rules")(spark, odd, small)
    assert kept.columns == odd.columns
    assert Counter(texts(kept)) == Counter((i, t) for i, t in rows if len((t or "").split()) >= 20)
    near = stage("MinHash near-dedup")(spark, odd, small)
    assert near.columns == odd.columns
    got, by_text = Counter(texts(near)), defaultdict(list)
    for i, t in rows:
        by_text[t].append(i)
    a, b, c = ([t for i, t in rows if i == k][0] for k in (1, 7, 8))
    assert got[1, a] == 1 and got[6, a] == 0 and got[7, b] == 0  # the first of each group
    assert sum(n for (i, t), n in got.items() if i == 6) == 1  # the other text of document 6 stays
    assert got[8, c] == 1 and got[None, c] == 0  # one of equal rows, and of their group
    assert sum(got.values()) == len(rows) - 4 and got[9, None] == got[10, ""] == got[11, " \n\t"] == 1
    for name in ("benchmark decontamination", "PII"):
        out = stage(name)(spark, odd, small)
        assert out.columns == odd.columns and texts(out) == rows, name
    packed = stage("packing")(spark, odd, small).collect()
    assert sum(r["length"] for r in packed if r["start"] == 0) and len({(r["sequence_id"], r["offset"]) for r in packed}) == len(packed)
    assert sum(r["start"] == 0 for r in packed) == len(rows)
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, odd.limit(0), small).count() == 0, name


def test_leaks_are_taken_out_by_row(spark, small):
    item = spark.read.parquet(f"{small}/benchmark.parquet").orderBy(F.length("text").desc()).first()["text"]
    rng = random.Random(2)
    clean = " ".join(prose(rng, 50))
    df = spark.createDataFrame([(5, clean), (5, f"{clean} {item}"), (None, item), (None, clean)], "doc_id long, text string")
    assert texts(stage("benchmark decontamination")(spark, df, small)) == [(5, clean), (None, clean)]


# ---- token counts


def test_token_counts_of_a_table_and_of_long_words(spark, small, documents):
    sentencepiece, public_tokenizers = pytest.importorskip("sentencepiece"), pytest.importorskip("public_tokenizers")
    from tidewheel.llm import token_counts

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    rows = token_counts.op1(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(library.encode(texts[r["doc_id"]]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 4096)
    rng = random.Random(3)
    long = ["".join(rng.choice(alphabet) for _ in range(n)) for alphabet, n in (("abcdefghijklmnopqrstuvwxyz", 20_000), ("acgt", 20_000), ("ABCDEFabcdef0123456789+/=", 100_000), ("ae", 3000), ("aeinorst", 5000))]
    long += ["".join(rng.choice("aeinorst") for _ in range(rng.randrange(1, 200))) for _ in range(300)]
    with open(path, "rb") as f:
        count = token_counts.TextCounter(token_counts.PieceMerger(f.read()))
    assert count([t.encode() for t in long]) == [len(x) for x in library.encode(long, num_threads=1)]
