"""Visually identical text: one consistent form by look-alike maps and an accent-sensitive Unicode collation."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.session import materialize

#: Letters of Greek and Cyrillic that look like a Latin letter (or, last row, like each other).
LOOKALIKES = {
    "A": "ΑА", "B": "ΒВ", "C": "ϹС", "E": "ΕЕ", "G": "Ԍ", "H": "ΗН", "I": "ΙІӀ", "J": "ͿЈ", "K": "ΚК", "M": "ΜМ",
    "N": "Ν", "O": "ΟО", "P": "ΡР", "Q": "Ԛ", "S": "Ѕ", "T": "ΤТ", "V": "Ѵ", "W": "Ԝ", "X": "ΧХ", "Y": "ΥУҮ", "Z": "Ζ",
    "a": "αа", "c": "ϲс", "d": "ԁ", "e": "е", "h": "һ", "i": "ιі", "j": "ϳј", "l": "ӏ", "o": "οо", "p": "ρр",
    "q": "ԛ", "s": "ѕ", "u": "υ", "v": "νѵ", "w": "ԝ", "x": "х", "y": "γуү",
    "к": "κ",
}
#: Single blanks other than the plain one.
BLANKS = "               　"
#: Controls that show as layout, and format characters that show.
_SHOWN = set("\t\n\v\f\r\x85") | set(map(chr, range(0x600, 0x606))) | {"۝", "܏", "࣢"}
_VARIATION = [*range(0x180B, 0x180E), 0x34F, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]


@functools.cache
def char_maps() -> tuple[dict[str, str], dict[str, str]]:
    """Per character its consistent form: one-to-one (or to nothing), and those whose form has several characters.

    Both come from rules over the Unicode data: width forms take their compatibility form, characters without room
    vanish, blanks become a plain one, look-alikes the Latin letter, accented look-alikes that letter with the accent.
    """
    latin = {x: k for k, xs in LOOKALIKES.items() for x in xs}
    one: dict[str, str] = dict.fromkeys(BLANKS, " ") | latin
    many: dict[str, str] = {}
    for code in [*range(0x80, 0x3000), *range(0xA640, 0xA700)]:
        ch = chr(code)
        parts = unicodedata.normalize("NFD", ch)
        if len(parts) > 1 and parts[0] in latin:
            form = unicodedata.normalize("NFC", latin[parts[0]] + parts[1:])
            (one if len(form) == 1 else many)[ch] = form
    for code in range(0xFF00, 0xFFF0):
        ch = chr(code)
        form = unicodedata.normalize("NFKC", ch)
        if form != ch:
            form = {" ゙": "゙", " ゚": "゚"}.get(form, form)
            (one if len(form) == 1 else many)[ch] = form
    one["ﾞ"], one["ﾟ"] = "゙", "゚"
    for code in [*range(0x20), *range(0x7F, 0x20000), *range(0xE0000, 0xE0080), *_VARIATION]:
        ch = chr(code)
        if ch not in _SHOWN and (unicodedata.category(ch) in ("Cc", "Cf") or code in _VARIATION):
            one[ch] = ""
    return one, many


def _translated(c: Column, one: dict[str, str]) -> Column:
    kept = [(a, b) for a, b in one.items() if b] + [(a, b) for a, b in one.items() if not b]
    return F.translate(c, "".join(a for a, _ in kept), "".join(b for _, b in kept))


def consistent_form(c: Column) -> Column:
    """Text with width forms, look-alikes, blanks and characters without room in one form; accents stay as they are written.

    Composed and separate accents are left to the collation that compares the forms. A plain ASCII text without
    control characters is its own form and is not walked through.
    """
    one, many = char_maps()
    wide = "[" + "".join(many) + "]"
    spelled = c
    for ch, form in many.items():
        spelled = F.replace(spelled, F.lit(ch), F.lit(form))
    spelled = F.when(c.rlike(wide), spelled).otherwise(c)
    plain = (F.length(c) == F.octet_length(c)) & ~c.rlike(r"[\x00-\x08\x0e-\x1f\x7f]")
    return F.when(plain, c).otherwise(_translated(spelled, one))


@functools.cache
def _base_map() -> dict[str, str]:
    """Accented character -> its base; accents, Hangul and characters without room -> nothing."""
    out: dict[str, str] = {}
    for code in [*range(0x80, 0xAC00), *range(0xF900, 0xFB50), *range(0xFE20, 0xFE30), *range(0x10000, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0100, 0xE01F0)]:
        ch = chr(code)
        base = unicodedata.normalize("NFD", ch)[0]
        if unicodedata.combining(ch) or unicodedata.category(ch) in ("Mn", "Mc", "Me") or "ᄀ" <= ch <= "ᇿ":
            out[ch] = ""
        elif base != ch:
            out[ch] = "" if unicodedata.combining(base) else base
    return out


def accent_free_key(c: Column) -> Column:
    """A 64-bit key of a consistent form without its accents: forms that the collation holds equal share it."""
    stripped = F.regexp_replace(_translated(c, _base_map()), r"[\x{AC00}-\x{D7FF}]", "")
    return F.xxhash64(F.when(F.length(c) == F.octet_length(c), c).otherwise(stripped))


def _exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pdf["form"] = [t if t is None or t.isascii() else unicodedata.normalize("NFC", t) for t in pdf["form"]]
        yield pdf


_CONFLATED: dict[str, dict[int, str]] = {}


def conflated(spark: SparkSession) -> dict[int, str]:
    """Character -> those of its parts that the collation holds equal to another character that doesn't look like it.

    The UNICODE collation is asked itself, over all assigned characters, once per application: digits of all scripts
    are one to it, so are styled letters and rarely used marks. Canonically equal characters don't count.
    """
    app = spark.sparkContext.applicationId
    if app not in _CONFLATED:

        def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                codes = [c for c in pdf["id"] if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
                yield pd.DataFrame({"c": codes, "s": ["a" + (chr(c) if c else "") + "b" for c in codes]})

        # 0 stands for no character: what is equal to nothing at all shows beside the pair without it.
        known = spark.range(0, 0xE01F0, 1, 8).where("id < 204800 or id >= 917504").mapInPandas(texts, "c int, s string")
        groups = known.groupBy(F.collate("s", "UNICODE")).agg(F.collect_list("c").alias("cs")).where("size(cs) > 1").select("cs").collect()
        # Characters that vanish from every form can't tell texts apart.
        gone = {ch for ch, form in char_maps()[0].items() if not form}
        risky: set[str] = set()
        for (cs,) in groups:
            left = [chr(c) if c else "" for c in cs if chr(c) not in gone]
            if len({unicodedata.normalize("NFC", x) for x in left}) > 1:
                risky.update(x for x in left if x)
        out = {}
        for c in [*range(1, 0x32000), *range(0xE0000, 0xE01F0)]:
            part = "".join(x for x in unicodedata.normalize("NFD", chr(c)) if x in risky)
            if part or chr(c) in risky:
                out[c] = part or chr(c)
        _CONFLATED[app] = out
    return _CONFLATED[app]


def ordered(text: str) -> str:
    """The text with separate accents in canonical order, where they aren't; what is in order stays as it is written.

    The collation holds composed and separate accents equal, but takes accents in the order in which they come.
    """
    if text.isascii():
        return text
    out, at = [], 0
    while at < len(text):
        end = at + 1
        while end < len(text) and unicodedata.combining(text[end]):
            end += 1
        part = text[at:end]
        if end - at > 1:
            apart = "".join(unicodedata.normalize("NFD", x) for x in part)
            if (sorted_part := unicodedata.normalize("NFD", part)) != apart:
                part = sorted_part
        out.append(part)
        at = end
    return "".join(out)


def visual_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """Documents that look like another document: (key, text_id bigint, class_id).

    Two texts look the same when they are equal after width forms, composed or separate accents, characters without
    room, kinds of single blanks and look-alike letters are disregarded. class_id is the least key of the class, its
    canonical member; text_id tells different texts of a class apart and is equal for exact copies. Classes of at least
    two documents come out, also those of exact copies alone. Null and blank texts and null keys are left out. An empty
    table gives no rows.

    Method: one count and least key per different text are taken first, so that many copies of a text weigh as one. A
    64-bit key of the accent-free form finds the few texts that can have a twin; only these move. Their look-alike-mapped
    forms, accents in canonical order, are grouped in SQL under the accent-sensitive UNICODE collation, which decides
    what is equal; an exact check then compares only the characters that the collation is known to conflate. The least key of each class is its
    canonical member, and the class is joined back to all copies. Of the other texts only keys move.
    """
    spark = df.sparkSession
    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key is not null and text is not null")
    form = consistent_form(F.col("text"))
    keyed = docs.where(F.btrim(F.col("text"), F.lit(" \t\n\r\v\f" + BLANKS)) != "").select("key", accent_free_key(form).alias("loose"), F.xxhash64("text").alias("text_id"))
    keyed = materialize(keyed, "loose")
    copies = materialize(keyed.groupBy("loose", "text_id").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")), "copies")
    open_keys = copies.groupBy("loose").agg(F.min("text_id").alias("lo"), F.max("text_id").alias("hi")).where("lo <> hi").select("loose")
    firsts = materialize(copies.join(open_keys, "loose", "left_semi"), "open")
    # Only keys meet first; the few texts are written before their forms are taken, so that no other text is walked again.
    texts = materialize(docs.join(firsts.withColumnRenamed("first", "key"), "key").select("loose", "text_id", "key", "n", "text"), "candidates")
    parts = conflated(spark)

    @F.pandas_udf("form string, residue string")
    def prepared(forms: pd.Series) -> pd.DataFrame:
        shown = [ordered(t) for t in forms]
        return pd.DataFrame({"form": shown, "residue": ["" if t.isascii() else "".join(parts.get(ord(x), "") for x in t) for t in shown]})

    shown = texts.select("loose", "text_id", "key", "n", prepared(form).alias("p")).select("loose", "text_id", "key", "n", "p.form", "p.residue").where(F.btrim("form", F.lit(" \t\n\r\v\f\x85\u2028\u2029")) != "")
    grouped = shown.withColumn("collated", F.collate("form", "UNICODE")).groupBy("loose", "collated", "residue")
    classes = grouped.agg(F.min("key").alias("class_id"), F.collect_set("text_id").alias("text_ids"), F.sum("n").alias("docs")).where("docs > 1")
    alike = classes.select("loose", F.explode("text_ids").alias("text_id"), "class_id")
    same = copies.where("n > 1").join(open_keys, "loose", "left_anti").select("loose", "text_id", F.col("first").alias("class_id"))
    found = materialize(alike.unionByName(same), "alike")
    return keyed.join(found, ["loose", "text_id"]).select(F.col("key").alias(key), "text_id", "class_id")


def consistent_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, form string): the one consistent form of each text, composed, equal for all texts of a visual class; null stays null."""
    rows = df.select(F.col(key), consistent_form(F.col(text)).alias("form"))
    return rows.mapInPandas(_exact, rows.schema)


def visual_pairs(classes: DataFrame, key: str) -> DataFrame:
    """Pairs (key_a, key_b), a < b, of one class whose texts differ. Exact copies of one text form no pair."""
    texts = classes.select("class_id", "text_id").distinct()
    other = texts.select("class_id", F.col("text_id").alias("other"))
    # Different texts are paired before their copies, so that a text with many copies never meets itself.
    differ = texts.join(other, "class_id").where("text_id <> other")
    a = classes.join(differ, ["class_id", "text_id"]).select("class_id", F.col("other").alias("text_id"), F.col(key).alias(f"{key}_a"))
    b = classes.select("class_id", "text_id", F.col(key).alias(f"{key}_b"))
    return a.join(b, ["class_id", "text_id"]).where(F.col(f"{key}_a") < F.col(f"{key}_b")).select(f"{key}_a", f"{key}_b")
