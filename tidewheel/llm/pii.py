"""Surrogates for personal data: keyed, type-consistent and distinct.

Entities are found by one pattern, told apart by kind, and brought to a normal
form in which spellings of one value are equal, so one value has one surrogate
wherever it occurs.  Numbers and host addresses go through a keyed permutation of
those of their length that leaves none in its place, and are put back into their
own punctuation: distinct ones stay distinct whatever share of the space occurs,
and the format stays.  Given names, family names, e-mail addresses and secrets come
from keyed hashes; names keep title, gender and script, and each name stands for
itself, so that "Mr. John Smith", "Mr. Smith" and "Mrs. Smith" keep what they share.
A table of all distinct hashed values checks that no two share a surrogate and
that no surrogate is itself a value of the corpus; those that fail take the next
key, and a longer surrogate, until none does.  A permuted number may equal another
number of the corpus, which is itself replaced.

DataFrame functions only.  The pattern runs once over each text, whose pieces are
written to a working table; the check and the replacement read that.  Only
documents with a value that needed another key are joined; the others pass by, told
apart by a bit table of fixed size.

The key: the argument, else the session's ``spark.tidewheel.pii.key``, else a
constant that only tests should use.

Edge cases: a null text stays null; an empty one stays empty; a null id stays
null; equal rows get equal texts; other columns are kept as they are, one of the
count's name gives way to it; very long texts are handled as others; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, near, store, table

KEY = "tidewheel"  #: for tests; see above
KEY_SETTING = "spark.tidewheel.pii.key"
HASHED = ("email", "given", "family", "secret")  #: kinds whose surrogates are hashes and may collide

_TITLES = {"m": "Mr|Herr|Señor|Monsieur|Г-н", "f": "Mrs|Ms|Miss|Frau|Señora|Madame|Г-жа"}
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: In order: e-mail, secret, address of a host, account (IBAN), card, social security, telephone (three), person.
PATTERN = "|".join(
    (
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+(?<=\.[A-Za-z]{2,24})",
        r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])",
        rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)",
        r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
        r"(?<![\w+-])(?:\d{4}(?:[ -]\d{4}){3}|\d{13,19})(?![\w-])",
        r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
        r"(?<![\w+])\+?\d{0,3}[ .-]?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\w)",
        r"(?<![\w.+-])\+\d{1,3}(?:[ .-]\d{2,4}){2,5}(?![\w-])",
        r"(?<![\w.+-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])",
        rf"(?<!\p{{L}})(?:{_TITLES['m']}|{_TITLES['f']})\.? \p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)?(?!\p{{L}})",
    )
)

#: Letters that hash digits turn into, by script; fixed values of this operator.
_HEX = "0123456789abcdef"
_LETTERS = {"latin": ("bdfghklmnprstvzj", "aeiouaeiouaeioua"), "cyrillic": ("бвгджзклмнпрстфх", "аеиоуаеиоуаеиоуа")}
_ENDINGS = {("latin", "m"): "n", ("latin", "f"): "a", ("cyrillic", "m"): "н", ("cyrillic", "f"): "а"}


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def kind_of(raw: Column) -> Column:
    return (
        F.when(raw.contains("@"), "email")
        .when(raw.rlike(rf"^(?:{_TITLES['m']}|{_TITLES['f']})\.? "), "person")
        .when(raw.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"), "host")
        .when(raw.rlike("^(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})$"), "secret")
        .when(raw.rlike("^[A-Z]{2}"), "account")
        .when(raw.rlike(r"^\d{3}-\d{2}-\d{4}$"), "social")
        .when(raw.rlike(r"^(?:\d{4}[ -]){3}\d{4}$|^\d{13,19}$"), "card")
        .otherwise("phone")
    )


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def normal(kind: Column, raw: Column) -> Column:
    """The form in which spellings of one value are equal; for a person: gender, then the names."""
    gender = F.when(raw.rlike(rf"^(?:{_TITLES['m']})\.? "), "m ").otherwise("f ")
    return (
        F.when(kind == "email", F.lower(raw))
        .when(kind == "person", F.concat(gender, F.regexp_replace(raw, r"^[^ ]+ ", "")))
        .when(kind == "host", raw)
        .when(kind == "secret", F.lower(raw))
        .when(kind == "account", F.regexp_replace(raw, " ", ""))
        .otherwise(_digits(raw))
    )


def _hash(key: str, *parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(key), *parts).cast("binary"))


def _number(hex_text: Column) -> Column:
    return F.conv(F.substring(hex_text, 1, 13), 16, 10).cast("long")


def _ten_to(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("long")


def _shifted(start: Column, step: Callable[[Column, Column], Column], back: Callable[[Column, Column], Column], following: Callable[[Column], Column]) -> Column:
    """Four Feistel rounds, one step further in the order so made, and back: a permutation that leaves nothing in its place."""
    there = F.aggregate(F.array(*map(F.lit, range(1, 5))), start, step, following)
    return F.aggregate(F.array(*map(F.lit, range(4, 0, -1))), there, back)


def permuted(digits: Column, key: str, salt: Column) -> Column:
    """A keyed permutation of the digit strings of each length from 2 to 36, none of which stays in its place."""
    half = F.floor(F.length(digits) / 2).cast("int")
    start = F.struct(F.substring(digits, F.lit(1), half).alias("x"), F.substring(digits, half + 1, F.length(digits)).alias("y"))

    def noise(r: Column, other: Column, n: Column) -> Column:
        return F.pmod(_number(_hash(key, salt, r.cast("string"), other)), _ten_to(n))

    def moved(x: Column, by: Column) -> Column:
        return F.lpad(F.pmod(x.cast("long") + by, _ten_to(F.length(x))).cast("string"), F.length(x), F.lit("0"))

    def step(s: Column, r: Column) -> Column:
        return F.struct(s["y"].alias("x"), moved(s["x"], noise(r, s["y"], F.length(s["x"]))).alias("y"))

    def back(s: Column, r: Column) -> Column:
        return F.struct(moved(s["y"], -noise(r, s["x"], F.length(s["y"]))).alias("x"), s["x"].alias("y"))

    def following(s: Column) -> Column:
        carry = s["y"].cast("long") + 1 == _ten_to(F.length(s["y"]))
        return F.struct(moved(s["x"], carry.cast("long")).alias("x"), moved(s["y"], F.lit(1)).alias("y"))

    return F.when(F.length(digits) >= 2, let(_shifted(start, step, back, following), lambda s: F.concat(s["x"], s["y"]))).otherwise(digits)


def _check_digit(body: Column) -> Column:
    """The digit that makes a card number pass the doubling test."""
    each = F.transform(F.split(F.reverse(body), ""), lambda c, i: F.when(c == "", 0).otherwise(F.coalesce(c.try_cast("int"), F.lit(0)) * (2 - i % 2)))
    return (10 - F.aggregate(each, F.lit(0), lambda t, d: t + F.floor(d / 10).cast("int") + d % 10) % 10) % 10


def _card(digits: Column, key: str, salt: Column) -> Column:
    body, check = F.substring(digits, F.lit(1), F.length(digits) - 1), F.substring(digits, F.length(digits), F.lit(1)).cast("int")
    return let(permuted(body, key, salt), lambda new: F.concat(new, ((_check_digit(new) + check - _check_digit(body) + 10) % 10).cast("string")))


def _host(address: Column, key: str, salt: Column) -> Column:
    octet = [F.split_part(address, F.lit("."), F.lit(k)).cast("long") for k in range(1, 5)]
    start = F.struct((octet[0] * 256 + octet[1]).alias("x"), (octet[2] * 256 + octet[3]).alias("y"))

    def noise(r: Column, other: Column) -> Column:
        return F.pmod(_number(_hash(key, salt, r.cast("string"), other.cast("string"))), F.lit(65536))

    def step(s: Column, r: Column) -> Column:
        return F.struct(s["y"].alias("x"), ((s["x"] + noise(r, s["y"])) % 65536).alias("y"))

    def back(s: Column, r: Column) -> Column:
        return F.struct(F.pmod(s["y"] - noise(r, s["x"]), F.lit(65536)).alias("x"), s["x"].alias("y"))

    def following(s: Column) -> Column:
        return F.struct(((s["x"] + (s["y"] == 65535).cast("long")) % 65536).alias("x"), ((s["y"] + 1) % 65536).alias("y"))

    def text(s: Column) -> Column:
        parts = [F.floor(s["x"] / 256), s["x"] % 256, F.floor(s["y"] / 256), s["y"] % 256]
        return F.concat_ws(".", *(p.cast("long").cast("string") for p in parts))

    return let(_shifted(start, step, back, following), text)


def _syllables(hex_text: Column, n: Column, script: str) -> Column:
    """n syllables, 15 at most."""
    consonants, vowels = _LETTERS[script]
    c, v = F.translate(F.substring(hex_text, 1, 15), _HEX, consonants), F.translate(F.substring(hex_text, 16, 15), _HEX, vowels)
    return F.substring(F.concat(*(F.substring(x, k, 1) for k in range(1, 16) for x in (c, v))), F.lit(1), F.least(n, F.lit(15)) * 2)


def _name(word: Column, n: Column, ending: Callable[[str], Column] | None, *hashed: Column) -> Column:
    """A name in the script of ``word``."""
    spelt = [F.concat(_syllables(_hash(*hashed), n, s), *([ending(s)] if ending else [])) for s in _LETTERS]
    return F.initcap(F.when(word.rlike(r"\p{IsCyrillic}"), spelt[1]).otherwise(spelt[0]))


def _email(value: Column, key: str, salt: Column, attempt: Column) -> Column:
    digits = F.when(F.split_part(value, F.lit("@"), F.lit(1)).rlike("[0-9]"), F.concat(F.lit("."), F.lpad(F.pmod(_number(_hash(key, salt, F.lit("digits"), value)), F.lit(100)).cast("string"), 2, "0"))).otherwise("")
    domain = F.split_part(value, F.lit("@"), F.lit(2))
    return F.concat(_syllables(_hash(key, salt, F.lit("local"), value), attempt + 8, "latin"), digits, F.lit("@"), _syllables(_hash(key, F.lit("domain"), domain), F.lit(5), "latin"), F.lit(".example.org"))


def surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """The stand-in for a normal form; every attempt has its own hashes, and room for longer names."""
    salt = F.concat_ws("|", kind, attempt.cast("string"))
    fixed = F.greatest(F.length(value) - 10, F.lit(0))  # a country's code stays
    long_hash = F.concat(*(_hash(key, salt, F.lit(str(k)), value) for k in range(4)))

    def gender(script: str) -> Column:
        return F.when(F.substring(value, 1, 1) == "m", _ENDINGS[script, "m"]).otherwise(_ENDINGS[script, "f"])

    return (
        F.when(kind == "email", _email(value, key, salt, attempt))
        .when(kind == "given", _name(value, attempt + 5, gender, key, salt, value))
        .when(kind == "family", _name(value, attempt + 5, None, key, salt, value))
        .when(kind == "host", _host(value, key, salt))
        .when(kind == "secret", F.substring(long_hash, F.lit(1), F.length(value)))
        .when(kind == "account", _refill(value, permuted(_digits(value), key, salt)))
        .when(kind == "card", _card(value, key, salt))
        .when(kind == "phone", F.concat(F.substring(value, F.lit(1), fixed), permuted(F.substring(value, fixed + 1, F.lit(10)), key, salt)))
        .otherwise(permuted(value, key, salt))
    )


def parts_of(kind: Column, value: Column) -> Column:
    """An array of (kind, value): what has a surrogate of its own, in order; of a person the given name with the gender, if there is one, and the family name."""
    words = F.split(value, " ")
    family = F.struct(F.lit("family").alias("kind"), F.element_at(words, -1).alias("value"))
    given = F.struct(F.lit("given").alias("kind"), F.concat_ws(" ", F.get(words, F.lit(0)), F.get(words, F.lit(1))).alias("value"))
    person = F.when(F.size(words) > 2, F.array(given, family)).otherwise(F.array(family))
    return F.when(kind == "person", person).otherwise(F.array(F.struct(kind.alias("kind"), value.alias("value"))))


def _refill(shape: Column, fill: Column, places: str = "[0-9]") -> Column:
    """``shape`` with its characters at ``places`` replaced, one after another, by those of ``fill``."""
    start = F.struct(F.lit(1).alias("i"), F.lit("").alias("out"))

    def step(s: Column, c: Column) -> Column:
        here = c.rlike(places)
        return F.struct((s["i"] + here.cast("int")).alias("i"), F.concat(s["out"], F.when(here, F.substring(fill, s["i"], F.lit(1))).otherwise(c)).alias("out"))

    return F.aggregate(F.split(shape, ""), start, step, lambda s: s["out"])


def _worn(kind: Column, raw: Column, stand_in: Column) -> Column:
    """A surrogate in the spelling of the value that it replaces."""
    return (
        F.when(kind == "person", F.concat(F.split_part(raw, F.lit(" "), F.lit(1)), F.lit(" "), stand_in))
        .when(kind.isin("email", "host"), stand_in)
        .when(kind == "secret", F.when(raw == F.upper(raw), F.upper(stand_in)).otherwise(stand_in))
        .when(kind == "account", _refill(raw, stand_in, "[0-9A-Z]"))
        .otherwise(_refill(raw, stand_in))
    )


_MARK, _ESCAPE = "\x01", "\x02"  # control characters, which no entity holds and the pattern doesn't tell apart


def _pieces(text: Column) -> Column:
    """The text cut at its entities: pieces between them at even places, entities at odd ones."""
    plain = F.replace(F.replace(text, F.lit(_ESCAPE), F.lit("\x02\x03")), F.lit(_MARK), F.lit("\x02\x04"))
    return F.split(F.regexp_replace(plain, PATTERN, f"{_MARK}$0{_MARK}"), _MARK, -1)


def _unescaped(piece: Column) -> Column:
    return F.replace(F.replace(piece, F.lit("\x02\x04"), F.lit(_MARK)), F.lit("\x02\x03"), F.lit(_ESCAPE))


def _cut(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, text_key, pieces): row holds the columns but the text."""
    others = [c for c in docs.columns if c != text_col]
    return docs.select(F.struct(*others).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), _pieces(F.col(text_col)).alias("pieces"))


def _found(cut: DataFrame) -> DataFrame:
    """(id, text_key, kind, value) of every entity."""
    found = cut.where(F.size("pieces") > 1).select("id", "text_key", F.explode(F.filter("pieces", lambda x, i: i % 2 == 1)).alias("raw"))
    found = found.withColumn("kind", kind_of(F.col("raw")))
    return found.select("id", "text_key", "kind", normal(F.col("kind"), F.col("raw")).alias("value"))


def entities(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, kind, value) of every entity of every document."""
    return _found(_cut(docs, id_col, text_col))


def _checked(values: DataFrame) -> DataFrame:
    """``values`` with (kind, value) of each part that has a hash for a surrogate."""
    others = [c for c in values.columns if c not in ("kind", "value")]
    parts = values.select(*others, F.explode(parts_of(F.col("kind"), F.col("value"))).alias("part"))
    return parts.select(*others, "part.kind", "part.value").where(F.col("kind").isin(*HASHED))


def tries_needed(values: DataFrame, key: str) -> tuple[DataFrame, str] | None:
    """(kind, value, attempt) of the parts of ``values`` that can't take their first surrogate, and its table; None if all can."""
    spark = values.sparkSession
    kind, value = F.col("kind"), F.col("value")
    now, path = store(_checked(values).distinct().select("kind", "value", F.lit(0).alias("attempt"), surrogate(kind, value, F.lit(0), key).alias("stand_in")), "values")
    for k in count():  # each try has more room than the one before
        now = now.withColumn("space", F.when(kind.isin("given", "family"), "name").otherwise(kind))
        real = now.select("space", F.when(kind == "given", F.substring(value, F.lit(3), F.length(value))).otherwise(value).alias("stand_in")).distinct()
        shared = now.groupBy("space", "stand_in").agg(F.count("*").alias("n"), F.min("value").alias("first"))
        taken = shared.join(real.withColumn("real", F.lit(True)), ["space", "stand_in"], "left").where("n > 1 or real")
        if taken.isEmpty():
            if not k:
                discard(spark, path)
                return None
            return now.where("attempt > 0").select("kind", "value", "attempt"), path
        joined = now.join(taken, ["space", "stand_in"], "left")
        again = F.coalesce(F.col("real"), F.lit(False)) | F.coalesce(value != F.col("first"), F.lit(False))
        moved = joined.select("kind", "value", (F.col("attempt") + again.cast("int")).alias("attempt"))
        after, new_path = store(moved.select("kind", "value", "attempt", surrogate(kind, value, F.col("attempt"), key).alias("stand_in")), "values")
        discard(spark, path)
        now, path = after, new_path


def replace_entities(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", key: str | None = None, count_col: str | None = "n_entities", chars_col: str | None = None) -> DataFrame:
    """``docs`` with surrogates in its texts, and a column with their number unless ``count_col`` is None.

    chars_col: a column that holds the text's length; it follows where a text changes.
    """
    key = key or docs.sparkSession.conf.get(KEY_SETTING, KEY)
    cut, _ = store(_cut(docs, id_col, text_col), "pieces")
    found = _found(cut)
    needed = tries_needed(found.select("kind", "value"), key)
    none = F.lit(None).cast("map<string,int>")
    if needed is None:
        own = cut.select("row", "pieces", none.alias("tries"))
    else:
        found = _checked(found).distinct()
        of_doc = found.join(needed[0], ["kind", "value"]).groupBy("id", "text_key").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "value"), "attempt"))).alias("tries"))
        of_doc, _ = store(of_doc.select(F.col("id").alias("its_id"), F.col("text_key").alias("its_key"), "tries"), "tries")
        marked = near(cut, F.xxhash64("id", "text_key"), of_doc.select(F.xxhash64("its_id", "its_key").alias("key")))
        same = F.col("id").eqNullSafe(F.col("its_id")) & (F.col("text_key") == F.col("its_key"))
        own = marked.where(~F.col("near")).select("row", "pieces", none.alias("tries")).unionByName(marked.where("near").join(of_doc, same, "left").select("row", "pieces", "tries"))

    def of_part(kind: Column, value: Column) -> Column:
        attempt = F.coalesce(F.try_element_at("tries", F.concat_ws("|", kind, value)), F.lit(0))
        return surrogate(kind, value, attempt, key)

    def stand_in(raw: Column) -> Column:
        def with_kind(kind: Column) -> Column:
            return let(F.array_join(F.transform(parts_of(kind, normal(kind, raw)), lambda p: of_part(p["kind"], p["value"])), " "), lambda s: _worn(kind, raw, s))

        return let(kind_of(raw), with_kind)

    changed = F.size("pieces") > 1
    filled = F.array_join(F.transform("pieces", lambda p, i: F.when(i % 2 == 0, _unescaped(p)).otherwise(stand_in(p))), "")
    text = F.when(changed, filled).otherwise(_unescaped(F.get("pieces", F.lit(0))))
    n = F.when(changed, F.floor(F.size("pieces") / 2)).otherwise(0).cast("long")
    # a one-row generator: filters above it don't work the texts out again
    out = own.select("row", F.explode_outer(F.array(F.struct(text.alias("text"), n.alias("n")))).alias("new"))
    columns = []
    for c in docs.columns:
        old = F.col("new.text") if c == text_col else F.col("row").getField(c)
        if c == chars_col:
            old = F.when(F.col("new.n") > 0, F.length("new.text").cast(docs.schema[c].dataType)).otherwise(old)
        if c != count_col:
            columns.append(old.alias(c))
    return out.select(*columns, *([F.col("new.n").alias(count_col)] if count_col else []))


def op10(spark: SparkSession, sf_dir: str, key: str | None = None) -> DataFrame:
    return replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), key=key)
