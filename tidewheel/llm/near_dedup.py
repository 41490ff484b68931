"""Near-duplicate documents by MinHash.

Many universal hash minima form a signature, bands of it find candidates,
signatures then full shingle sets verify them, and connected components by
alternating large-star and small-star give the groups.

Documents with equal shingle sets are one class from the start, so groups of
copies cost one row.  In a bucket every class meets the bucket's first class
(linear in the bucket).  What these links leave in several components is then
compared across components only: pairs in small buckets, and groups of bounded
size in large ones, of which only links come back that join components.  A link
is the same in either: a common bucket, signatures that agree in about enough
places, and full sets that do.  No bucket is cut off, and no pairs within a
component are formed.

A class is known by a 64-bit hash of its 128-bit hash of the set; rows are known by
their id and text, so ids of any type may be null or repeated.

Edge cases: null, empty or white-space texts have an empty set and are linked
with nothing; a row with a null id takes part in links and has a null component
in :func:`near_duplicates` (kept); rows that repeat an id each keep a row there, and
are told apart by their text; :func:`deduplicate` keeps one of equal rows; other
columns are ignored by the former and kept by the latter; very long texts are
taken whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, discard, near, odd_multipliers, shingles, store, table, utf8
from .components import connected_components

WIDTH = 5
BANDS, ROWS = 32, 4  #: at similarity 0.85 a pair misses every band with probability 6e-11, at 0.8 with 5e-8
CHUNK = 1024  #: classes of a large bucket whose sets are compared with as many others at once
FEW = 16  #: a bucket with more classes is large; only how its pairs are dealt out differs
SLACK = 0.17  #: a signature may tell this much less than the threshold: over five standard deviations


def shingle_set(text: bytes, hashes: WordHashes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes of a text: ASCII letters lower-cased, words cut at ASCII white space."""
    return np.unique(shingles(hashes.of(text.lower().split()), width))


class MinHash:
    """Minima of universal hash functions (multiply, add, take the high half)."""

    def __init__(self, size: int):
        self.a = odd_multipliers(size, 21)
        self.b = odd_multipliers(size, 22)

    def __call__(self, items: np.ndarray) -> np.ndarray:
        low = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for k in range(0, len(items), 2048):
            h = items[k : k + 2048, None] * self.a
            h += self.b
            h >>= np.uint64(32)
            np.minimum(low, h.min(axis=0).astype(np.uint32), out=low)
        return low


def _signed(values) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


def describe(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, text_key, n_shingles, set_hi, set_lo, signature) of every row, in a narrow pass."""

    def run(batches):
        hashes, minhash = WordHashes(), MinHash(bands * rows)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                n, hi, lo, sig = [], [], [], []
                for text in part.column(2).to_pylist():
                    items = shingle_set(text, hashes, width)
                    mark = xxhash.xxh3_128_intdigest(items.tobytes())
                    n.append(len(items))
                    hi.append(mark >> 64)
                    lo.append(mark & 0xFFFFFFFFFFFFFFFF)
                    sig.append(minhash(items).tobytes() if len(items) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), _signed(hi), _signed(lo), pa.array(sig, pa.binary())], ["id", "text_key", "n_shingles", "set_hi", "set_lo", "signature"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows_ = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), utf8(text_col).alias("text"))
    return rows_.mapInArrow(run, f"id {kind}, text_key long, n_shingles long, set_hi long, set_lo long, signature binary")


def _buckets(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    """(bucket, id) for every band of every class."""
    each = F.sequence(F.lit(0), F.lit(bands - 1))
    key = F.transform(each, lambda i: F.xxhash64(i, F.substring("signature", i * (4 * rows) + 1, F.lit(4 * rows))))
    return classes.select("id", F.explode(key).alias("bucket"))


def _alike(threshold: int, slack: float, size: int):
    """Filter of (a, b, sig_a, sig_b): pairs whose signatures agree in about enough places."""
    enough = (threshold / 100 - slack) * size

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(batch.num_rows, size) for i in (2, 3))
            agree = (left == right).sum(axis=1)
            out = batch.select(["a", "b"]).append_column("agree", pa.array(agree, pa.int64()))
            yield out.filter(pa.array(agree >= enough))

    return run


def _signature_filter(pairs: DataFrame, classes: DataFrame, threshold: int, slack: float, size: int) -> DataFrame:
    sig = classes.select("id", "signature")
    with_a = pairs.join(sig.select(F.col("id").alias("a"), F.col("signature").alias("sig_a")), "a")
    both = with_a.join(sig.select(F.col("id").alias("b"), F.col("signature").alias("sig_b")), "b").select("a", "b", "sig_a", "sig_b")
    return both.mapInArrow(_alike(threshold, slack, size), "a long, b long, agree long")


def _confirm(pairs: DataFrame, texts: DataFrame, threshold: int, width: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""

    def run(batches):
        hashes, recent = WordHashes(), OrderedDict()

        def items(key: int, text: bytes) -> np.ndarray:
            mark = (key, xxhash.xxh3_64_intdigest(text))
            if mark not in recent:
                if len(recent) >= 64:
                    recent.popitem(last=False)
                recent[mark] = shingle_set(text, hashes, width)
            return recent[mark]

        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                good = []
                for a, b, text_a, text_b in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    x, y = items(a, text_a), items(b, text_b)
                    shared = len(x) + len(y) - len(np.union1d(x, y))
                    good.append(100 * shared >= threshold * (len(x) + len(y) - shared))
                yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    with_b = pairs.select("a", "b").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _texts_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of one row of each wanted class."""
    rep = classes.join(wanted, "id", "left_semi").select("id", "rep_id", "rep_key")
    own = docs.select(F.col(id_col).alias("its_id"), F.xxhash64(text_col).alias("its_key"), utf8(text_col).alias("text"))
    some = near(own, F.xxhash64("its_id", "its_key"), rep.select(F.xxhash64("rep_id", "rep_key").alias("key"))).where("near")
    return some.join(rep, F.col("its_id").eqNullSafe(F.col("rep_id")) & (F.col("its_key") == F.col("rep_key"))).select("id", "text").dropDuplicates(["id"])


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """(id, items) with the shingle sets as bytes."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                items = [shingle_set(t, hashes, width).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(items, pa.binary())], ["id", "items"])

    return texts.mapInArrow(run, "id long, items binary")


def _shared(left: list[np.ndarray], right: list[np.ndarray], step: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets of two chunks, as products over the items that both chunks hold."""
    flat = [np.concatenate(x) for x in (left, right)]
    held = [np.unique(x) for x in flat]
    common = np.intersect1d(*held, assume_unique=True)
    total = np.zeros((len(left), len(right)), np.float32)
    where = []
    for sets, items in zip((left, right), flat, strict=True):
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.searchsorted(common, items)
        hit = at < len(common)
        hit[hit] = common[at[hit]] == items[hit]
        where.append((row[hit], at[hit]))
    for k in range(0, len(common), step):
        sides = []
        for sets, (row, at) in zip((left, right), where, strict=True):
            m = np.zeros((len(sets), min(step, len(common) - k)), np.float32)
            here = (at >= k) & (at < k + step)
            m[row[here], at[here] - k] = 1
            sides.append(m)
        total += sides[0] @ sides[1].T
    return total.astype(np.int64)


def _agree(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """In how many places the signatures of all pairs agree."""
    return np.concatenate([(left[k : k + 64, None] == right).sum(axis=2) for k in range(0, len(left), 64)])


def _linked(threshold: int, slack: float, size: int):
    """Links (a, b) between components, as many as join what full sets show to be joined, of the classes of one cell."""
    enough = (threshold / 100 - slack) * size
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def one(cell: pa.Table) -> pa.Table:
        ids, comps, group, side = (np.array(cell.column(c).to_pylist(), np.int64) for c in ("id", "component", "group", "side"))
        items = [np.frombuffer(x, np.uint64) for x in cell.column("items").to_pylist()]
        a, b, with_lead = (cell.column(c)[0].as_py() for c in ("a", "b", "with_lead"))
        everyone = np.arange(len(ids))
        if with_lead:
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        else:
            left, right = (everyone, everyone) if a == b else (np.flatnonzero(group == a), np.flatnonzero(group == b))
        if not len(left) or not len(right):
            return schema.empty_table()
        signature = np.frombuffer(b"".join(cell.column("signature").to_pylist()), np.uint32).reshape(len(ids), -1)
        alike = (_agree(signature[left], signature[right]) >= enough) & (comps[left][:, None] != comps[right])
        rows, columns = alike.any(axis=1), alike.any(axis=0)
        left, right, alike = left[rows], right[columns], alike[rows][:, columns]
        if not len(left):
            return schema.empty_table()
        both = _shared([items[k] for k in left], [items[k] for k in right])
        sizes = np.array([len(x) for x in items])
        union = sizes[left][:, None] + sizes[right] - both
        parent, found = {}, []

        def root(x):
            while (y := parent.get(x, x)) != x:
                x = y
            return x

        for k, m in zip(*np.nonzero((100 * both >= threshold * union) & alike), strict=True):
            k, m = left[k], right[m]
            x, y = root(comps[k]), root(comps[m])
            if x != y:
                parent[max(x, y)] = min(x, y)
                found.append((min(ids[k], ids[m]), max(ids[k], ids[m])))
        found = np.array(found, np.int64).reshape(-1, 2)
        return pa.Table.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], schema=schema)

    return one


def _across(members: DataFrame, sets_of, linked) -> DataFrame:
    """Links between components within large buckets, from ``members`` (bucket, id, n, component, lead).

    Those that share the component of the bucket's first class are one side; the
    others are compared with that side and among themselves.  Both are dealt into
    groups of bounded size, and a cell is a pair of groups.
    """
    member = members.withColumn("side", (F.col("component") == F.col("lead")).cast("int"))
    counts = member.groupBy("bucket").agg(F.sum(1 - F.col("side")).alias("others"))
    member = member.join(counts, "bucket")
    others, leads = (F.ceil(x / CHUNK).cast("int") for x in (F.col("others"), F.col("n") - F.col("others")))
    group = F.pmod(F.xxhash64("id"), F.when(F.col("side") == 0, others).otherwise(leads)).cast("int")

    def cells(n, a, b, with_lead: int):
        each = F.transform(F.sequence(F.lit(1), n), lambda h: F.struct(a(h - 1).alias("a"), b(h - 1).alias("b"), F.lit(with_lead).alias("with_lead")))
        return F.when(n > 0, each).otherwise(F.slice(each, 1, 0))

    g = F.col("group")
    own = F.concat(cells(F.col("o"), lambda h: F.least(g, h), lambda h: F.greatest(g, h), 0), cells(F.col("l"), lambda h: g, lambda h: h, 1))
    lead = cells(F.col("o"), lambda h: h, lambda h: g, 1)
    dealt = member.select("bucket", "id", "component", "side", group.alias("group"), others.alias("o"), leads.alias("l"))
    dealt = dealt.withColumn("cell", F.explode(F.when(F.col("side") == 0, own).otherwise(lead)))
    dealt = dealt.select("bucket", "id", "component", "side", "group", "cell.*").join(sets_of(member.select("id").distinct()), "id")
    return dealt.groupBy("bucket", "a", "b", "with_lead").applyInArrow(linked, "a long, b long").distinct()


def _groups(docs: DataFrame, id_col: str, text_col: str, threshold: int, width: int, bands: int, rows: int, slack: float) -> tuple[DataFrame, DataFrame]:
    """(described rows, (set_hi, set_lo, rep_id, rep_key) of every class: the first row, by id then text, of its component)."""
    spark = docs.sparkSession
    size = bands * rows
    described, _ = store(describe(docs, id_col=id_col, text_col=text_col, width=width, bands=bands, rows=rows), "sets")
    same = ["set_hi", "set_lo"]
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key")).alias("rep")
    firsts = described.where("n_shingles > 0").groupBy(*same).agg(first, F.min("signature").alias("signature"))
    firsts, firsts_path = store(firsts.select(F.xxhash64(*same).alias("node"), *same, "rep", "signature"), "classes")
    classes = firsts.select(F.col("node").alias("id"), "signature", F.col("rep.id").alias("rep_id"), F.col("rep.text_key").alias("rep_key"))

    buckets = _buckets(classes, bands, rows)
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1")
    members, members_path = store(buckets.join(shared, "bucket").select("bucket", "id", "n", "first"), "members")

    def confirmed(pairs: DataFrame) -> tuple[DataFrame, str]:
        pairs, pairs_path = store(pairs.select("a", "b"), "pairs")
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        texts, texts_path = store(_texts_of(docs, classes, wanted, id_col, text_col), "texts")
        links, links_path = store(_confirm(pairs, texts, threshold, width), "links")
        discard(spark, pairs_path, texts_path)
        return links, links_path

    # each class with the first classes of its buckets; of those with an alike signature, the most alike
    pairs = members.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    best = _signature_filter(pairs, classes, threshold, slack, size).groupBy("b").agg(F.max_by("a", F.struct("agree", -F.col("a"))).alias("a"))
    links, links_path = confirmed(best)
    label, label_path = store(connected_components(links), "labels")

    # buckets that these links leave in several components
    labelled = members.join(label, members["id"] == label["node"], "left").select("bucket", "id", "n", "first", F.coalesce("component", "id").alias("component"))
    labelled, labelled_path = store(labelled, "labelled")
    discard(spark, members_path, label_path)
    split = labelled.groupBy("bucket").agg(F.min("component").alias("lead"), F.max("component").alias("other")).where("lead <> other").select("bucket", "lead")
    mixed = labelled.join(split, "bucket")
    few = mixed.where(F.col("n") <= FEW).select("bucket", "id", "component")
    other = few.select("bucket", F.col("id").alias("b"), F.col("component").alias("c"))
    close = few.withColumnRenamed("id", "a").join(other, "bucket").where("a < b and component <> c").select("a", "b").distinct()
    more, more_path = confirmed(_signature_filter(close, classes, threshold, slack, size))

    def sets_of(wanted: DataFrame) -> DataFrame:
        return _sets(_texts_of(docs, classes, wanted, id_col, text_col), width).join(classes.select("id", "signature"), "id")

    across, across_path = store(_across(mixed.where(F.col("n") > FEW), sets_of, _linked(threshold, slack, size)), "links")
    label, label_path = store(connected_components(links.unionByName(more).unionByName(across)), "labels")
    discard(spark, labelled_path, links_path, more_path, across_path)

    joined = firsts.join(label, "node", "left").select(*same, "rep", F.coalesce("component", "node").alias("component"))
    reps = joined.groupBy("component").agg(F.min("rep").alias("first"))
    group, _ = store(joined.join(reps, "component").select(*same, F.col("first.id").alias("rep_id"), F.col("first.text_key").alias("rep_key")), "groups")
    discard(spark, firsts_path, label_path)
    return described, group


def _of_rows(described: DataFrame, group: DataFrame) -> DataFrame:
    """(id, text_key, n_shingles, rep_id, rep_key) of every row, without a first one for those without shingles."""
    same = ["set_hi", "set_lo"]
    rows = described.select("id", "text_key", "n_shingles", *(F.when(F.col("n_shingles") > 0, F.col(c)).alias(c) for c in same))
    return rows.join(group, same, "left").drop(*same)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: int = 85, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS, slack: float = SLACK) -> DataFrame:
    """One row for each row of ``docs``: its id, ``n_shingles``, ``component_id`` and ``kept``.

    ``threshold``: per cent of the union that the intersection has at least.
    """
    each = _of_rows(*_groups(docs, id_col, text_col, threshold, width, bands, rows, slack))
    known = F.col("id").isNotNull()
    out = each.select(F.col("id").alias(id_col), "n_shingles", F.when(known, F.coalesce("rep_id", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: int = 80, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS, slack: float = SLACK) -> DataFrame:
    """The first row, by id (null after all others) then text, of each group of near-duplicates, all columns; rows without shingles stay.

    Of rows with equal id and text one stays, the first as JSON.
    """
    described, group = _groups(docs, id_col, text_col, threshold, width, bands, rows, slack)
    each = _of_rows(described, group).where("n_shingles > 0")
    first = F.col("id").eqNullSafe(F.col("rep_id")) & (F.col("text_key") == F.col("rep_key"))
    counted = each.groupBy("id", "text_key").agg(F.count("*").alias("n"), F.bool_or(first).alias("first"))
    told, _ = store(counted.where("not first or n > 1").select(F.col("id").alias("its_id"), F.col("text_key").alias("its_key"), "first"), "told")
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"))
    marked = near(own, F.xxhash64("id", "text_key"), told.select(F.xxhash64("its_id", "its_key").alias("key")))
    asked = marked.where("near").join(told, F.col("id").eqNullSafe(F.col("its_id")) & (F.col("text_key") == F.col("its_key")), "left")
    repeated = asked.where("first").groupBy("id", "text_key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    parts = [marked.where(~F.col("near")), asked.where(F.col("first").isNull()), repeated]
    return parts[0].select("row.*").unionByName(parts[1].select("row.*")).unionByName(parts[2].select("row.*"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
