"""Quality rules: per-document measures and cross-document line frequency.

Lines are normalised (lower case, white space runs to one space) and hashed, and
for each host and line the distinct documents that hold it are counted.  Two
documents count as distinct by the hash of their set of lines, so that a group of
copies counts once and is not taken for boilerplate.  A line is
frequent in a host if more documents than the limit hold it; documents of which
frequent lines make up most words are rejected.  :func:`clean` also cuts the
frequent lines out of the others; measures are those of whole texts.

DataFrame functions only.  Hashes of lines are written once and read for counting
and for judging.  Counting is by (host, line, line_set) first and combines on the map
side; what is joined back are frequent lines alone.

Edge cases: null, empty or white-space texts have no words and fail the base
rules; a null host is a host of its own; a null ``doc_id`` stays null; rows that
repeat an id are told apart by their text; equal rows get equal results; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, near, store, table

SPACES = "\t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS, REPEAT_PERCENT = 20, 30
LINE_LIMIT = 20  #: documents of a host that may hold a line
LINE_SHARE = 0.001  #: or this share of the host's documents, if that is more
DEPLETED = 0.8  #: a document loses this share of its words in frequent lines, or more: rejected


def measures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(id, host, text_key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of each row, and its text; narrow."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(host_col), F.lit("")).alias("host"), text.alias("text"))
    df = df.withColumn("words", F.array_remove(F.split(F.translate("text", SPACES, " " * len(SPACES)), " "), ""))
    n = F.size("words")
    hashed = F.transform("words", lambda w: F.xxhash64(w))
    worded_text = F.split("text", "\n")
    df = df.select("id", "host", "text", n.cast("long").alias("n_words"), hashed.alias("hashes"))
    # a hash of each run of eight words, by its place; elements are read one by one, as slices copy the whole array
    last = F.size("hashes") - WINDOW
    runs = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get("hashes", i + k) for k in range(WINDOW)))))
    worded = F.filter(worded_text, lambda x: F.length(F.translate(x, " " + SPACES, "")) > 0)
    df = df.select("id", "host", "text", "n_words", runs.alias("runs"), worded.alias("lines"))
    repeats = F.size(F.array_distinct("runs")) < F.size("runs")
    placed = F.when(repeats, F.sort_array(F.transform("runs", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    lines = F.size("lines")
    df = df.select(
        "id", "host", "text", "n_words", placed.alias("placed"),
        F.xxhash64("text").alias("text_key"),
        F.length(F.translate("text", " " + SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.when(lines > 0, lines - F.size(F.array_distinct("lines"))).otherwise(0).cast("long").alias("n_dup_lines"),
    )
    # neighbours in hash order: a run that equals the one before or after it is repeated
    tail = F.slice("placed", 2, F.greatest(F.size("placed"), F.lit(1)))
    end = F.array(F.struct(F.lit(None).cast("long").alias("h"), F.lit(None).cast("int").alias("i")))
    like_next = F.zip_with("placed", F.concat(tail, end), lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False)))
    df = df.withColumn("like_next", like_next)
    like_last = F.concat(F.array(F.lit(False)), F.slice("like_next", 1, F.greatest(F.size("placed") - 1, F.lit(0))))
    either = F.zip_with("like_next", like_last, lambda x, y: x | y)
    places = F.zip_with("placed", either, lambda x, y: F.when(y, x["i"]))
    df = df.withColumn("places", F.sort_array(F.array_compact(places)))
    following = F.concat(F.slice("places", 2, F.greatest(F.size("places"), F.lit(1))), F.array(F.lit(None).cast("int")))
    # each repeated run covers its words up to the next one
    covered = F.aggregate(F.zip_with("places", following, lambda x, y: F.least(F.lit(WINDOW), y - x)), F.lit(0).cast("long"), lambda total, x: total + x)
    counted = F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    # a one-row generator: filters on the measures stay above it instead of being rewritten into the texts' expressions
    return df.select("id", "host", "text", "text_key", F.explode_outer(F.array(counted)).alias("m")).select("id", "host", "text", "text_key", "m.*")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)


def line_key(line: Column) -> Column:
    normal = F.lower(F.trim(F.regexp_replace(line, "[ \\t\\x0B\\f\\r]+", " ")))
    return F.when(normal != "", F.substring(F.md5(normal), 1, 16))


def _lines(df: DataFrame) -> DataFrame:
    """(id, text_key, host, line, n, all_words, line_set) of every distinct line of ``df`` (id, host, text, text_key)."""
    each = F.transform(F.split("text", "\n"), lambda x: F.struct(line_key(x).alias("line"), F.size(F.array_remove(F.split(F.translate(x, SPACES, " " * len(SPACES)), " "), "")).alias("n")))
    df = df.select("id", "host", "text_key", F.array_distinct(F.filter(each, lambda x: x["line"].isNotNull())).alias("each"))
    keys = F.sort_array(F.array_distinct(F.transform("each", lambda x: x["line"])))
    df = df.select("id", "host", "text_key", "each", F.xxhash64(keys).alias("line_set"), F.aggregate("each", F.lit(0).cast("long"), lambda total, x: total + x["n"]).alias("all_words"))
    df = df.select("id", "host", "text_key", "line_set", "all_words", F.explode_outer("each").alias("x")).where("x is not null")
    return df.select("id", "host", "text_key", F.col("x.line").alias("line"), F.col("x.n").cast("long").alias("n"), "all_words", "line_set")


def frequent_lines(lines: DataFrame, df: DataFrame, *, limit: int = LINE_LIMIT, share: float = LINE_SHARE) -> DataFrame:
    """(host, line, n_docs) of the lines above the limits; ``lines`` of the documents ``df`` (host)."""
    held = lines.select("host", "line", "line_set").distinct()
    counts = held.groupBy("host", "line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > limit)
    hosts = df.groupBy("host").agg(F.count("*").alias("host_docs"))
    return counts.join(hosts, "host").where(F.col("n_docs") > F.col("host_docs") * share).select("host", "line", "n_docs")


def held_lines(lines: DataFrame, frequent: DataFrame, *, depleted_share: float = DEPLETED) -> DataFrame:
    """(id, text_key, host, held, depleted) of the documents with frequent lines; held: those lines' keys."""
    found = lines.join(frequent.select("host", "line"), ["host", "line"])
    found = found.dropDuplicates(["id", "text_key", "host", "line", "n"])
    lost = found.groupBy("id", "text_key", "host").agg(F.sum("n").alias("lost"), F.max("all_words").alias("all_words"), F.collect_set("line").alias("held"))
    return lost.select("id", "text_key", "host", "held", (F.col("lost") >= F.col("all_words") * depleted_share).alias("depleted"))


def depleted(lines: DataFrame, frequent: DataFrame, *, depleted_share: float = DEPLETED) -> DataFrame:
    """(id, text_key, host) of the documents that frequent lines make up."""
    return held_lines(lines, frequent, depleted_share=depleted_share).where("depleted").select("id", "text_key", "host")


def without_lines(text: Column, held: Column) -> Column:
    """The text without the lines whose keys are held; as it is if that is null."""
    rest = F.filter(F.split(text, "\n"), lambda x: ~F.coalesce(F.array_contains(held, line_key(x)), F.lit(False)))
    return F.when(held.isNull(), text).otherwise(F.array_join(rest, "\n"))


def _keyed(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(host_col), F.lit("")).alias("host"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def _depleted_documents(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    keyed = _keyed(docs, id_col, text_col, host_col)
    lines, _ = store(_lines(keyed), "lines")
    return depleted(lines, frequent_lines(lines, keyed))


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row for each row of ``docs``: the measures, ``base_failed`` and ``kept``."""
    gone = _depleted_documents(docs, id_col, text_col, host_col).select(F.col("id").alias("gone_id"), F.col("text_key").alias("gone_key"), F.col("host").alias("gone_host"), F.lit(True).alias("gone"))
    m = measures(docs, id_col=id_col, text_col=text_col, host_col=host_col).drop("text").withColumn("base_failed", base_failed())
    same = F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("text_key") == F.col("gone_key")) & (F.col("host") == F.col("gone_host"))
    out = m.join(gone, same, "left").withColumn("kept", ~F.col("base_failed") & F.col("gone").isNull())
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of ``docs``, all columns, that the rules don't reject, with their texts as they are; see :func:`clean`."""
    gone, _ = store(_depleted_documents(docs, id_col, text_col, host_col), "depleted")
    rest, asked = _told_apart(docs, gone, id_col, text_col, host_col)
    return rest.select("row.*").unionByName(asked.join(gone, _same(asked, gone), "left_anti").select("row.*"))


def clean(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", chars_col: str = "n_chars") -> DataFrame:
    """The rows that :func:`keep` keeps, without frequent lines in their texts; ``chars_col``, where there is one, follows."""
    keyed = _keyed(docs, id_col, text_col, host_col)
    lines, path = store(_lines(keyed), "lines")
    found, _ = store(held_lines(lines, frequent_lines(lines, keyed)), "held")
    discard(docs.sparkSession, path)
    rest, asked = _told_apart(docs, found, id_col, text_col, host_col)
    out = asked.join(found, _same(asked, found), "left").where(~F.coalesce(F.col("depleted"), F.lit(False)))
    text = F.col("row").getField(text_col)
    new = {text_col: without_lines(text, F.col("held"))}
    if chars_col in docs.columns:
        chars = F.length(new[text_col]).cast(docs.schema[chars_col].dataType)
        new[chars_col] = F.when(F.col("held").isNull(), F.col("row").getField(chars_col)).otherwise(chars)
    out = out.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
    return rest.select("row.*").unionByName(out)


def _told_apart(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, host_col: str) -> tuple[DataFrame, DataFrame]:
    """(row, own, text_key, host) of the rows that pass the base rules: those that are not in ``found``, and those to be joined with it."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("own"), F.col(text_col).alias("text"), F.col(host_col).alias("host"))
    key = F.xxhash64("own", F.xxhash64(F.coalesce("text", F.lit(""))), F.coalesce("host", F.lit("")))
    marked = near(rows, key, found.select(F.xxhash64("id", "text_key", "host").alias("key")))
    return _passing(marked.where(~F.col("near"))), _passing(marked.where("near"))


def _passing(rows: DataFrame) -> DataFrame:
    m = measures(rows.withColumn("pair", F.struct("own", "row")), id_col="pair", text_col="text", host_col="host")
    return m.where(~base_failed()).select("id.row", F.col("id.own").alias("own"), "text_key", "host")


def _same(m: DataFrame, found: DataFrame) -> Column:
    return m["own"].eqNullSafe(found["id"]) & (m["text_key"] == found["text_key"]) & (m["host"] == found["host"])


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
