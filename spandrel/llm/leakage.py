"""Evaluation texts leaking into a corpus: prefix-filtered set join over word shingles, verified along alignments."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spandrel.llm.lookalike import LOOKALIKES, char_maps
from spandrel.session import materialize

#: Words of a shingle, and the share of changed words: one in CHANGED.
SHINGLE, CHANGED = 5, 10
#: Bits of the filters that pass on what can match: 2 MB each, whatever the tables; a full one lets all pass.
FILTER_BITS = 24

_ASCII_WORDS, _WORDS = re.compile(r"\w+", re.ASCII), re.compile(r"\w+")
#: Four digits after \u (two such escapes for a surrogate pair), eight after \U, any number in braces, two after \x
#: (several in a row may be the bytes of one character), three octal digits.
_CODED = re.compile(
    r"\\+[uU]\{([0-9a-fA-F]{1,8})\}|\\+u([dD][89abAB][0-9a-fA-F]{2})\\+u([dD][c-fC-F][0-9a-fA-F]{2})|\\+u([0-9a-fA-F]{4})|\\+U([0-9a-fA-F]{8})"
    r"|((?:\\+x[0-9a-fA-F]{2})+)|((?:\\+[0-3][0-7]{2})+)"
)
_LAYOUT = re.compile(r"\\+[ntrbfv0]")
_P = np.uint64(0x9E3779B97F4A7C15)


def _decoded(m: re.Match) -> str:
    if m[2]:
        return chr(0x10000 + ((int(m[2], 16) & 0x3FF) << 10) + (int(m[3], 16) & 0x3FF))
    if m[6] or m[7]:
        codes = [int(x, 16) for x in re.split(r"\\+x", m[6])[1:]] if m[6] else [int(x, 8) for x in re.split(r"\\+", m[7])[1:]]
        try:  # bytes of UTF-8, else a character each
            return bytes(codes).decode()
        except UnicodeDecodeError:
            return "".join(map(chr, codes))
    code = int(m[1] or m[4] or m[5], 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else " "


def _tables() -> tuple[dict, dict]:
    one, many = char_maps()
    first = str.maketrans(one | many)
    # Upper-case look-alikes become a Latin letter before the case goes; their lower-case forms must follow them.
    latin = {x: k for k, xs in LOOKALIKES.items() for x in xs}
    after = {x.lower(): k.lower() for x, k in latin.items() if x.lower() != x and x.lower() not in latin}
    return first, str.maketrans(after)


_FIRST, _AFTER = _tables()


def words_of(text: str) -> list[str]:
    """Words of a text, without layout, escapes, case and look-alikes."""
    if "\\" in text:
        text = _LAYOUT.sub(" ", _CODED.sub(_decoded, text))
    if text.isascii():
        return _ASCII_WORDS.findall(text.lower())
    text = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).translate(_FIRST)).casefold().translate(_AFTER)
    return _WORDS.findall(unicodedata.normalize("NFC", text))


class Codes(dict):
    """Word -> 32-bit code, the same in every process; remembered for a bounded number of words."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        code = self[word] = crc32(word.encode("utf-8", "surrogatepass")) - (1 << 31)
        return code


def longest_match(same: np.ndarray, least: int) -> int:
    """Length of the longest run of positions, at least ``least`` long, with at most one in CHANGED not the same; else 0."""
    n = len(same)
    if n < least:
        return 0
    sums = np.concatenate([[0], np.cumsum(np.where(same, 1, 1 - CHANGED))])
    # The greatest j for each i with sums[j] >= sums[i]: suffix maxima are monotone, so a binary search finds it.
    ahead = np.maximum.accumulate(sums[::-1])[::-1]
    j = np.searchsorted(-ahead, -sums, side="right") - 1
    best = int((j - np.arange(n + 1)).max())
    return best if best >= least else 0


def shingle_codes(ids: np.ndarray) -> np.ndarray:
    """A 64-bit code of each run of SHINGLE word codes."""
    n = len(ids) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    code = np.zeros(n, dtype=np.uint64)
    wide = ids.astype(np.uint64)
    for k in range(SHINGLE):
        code = (code ^ wide[k : k + n]) * _P
        code ^= code >> np.uint64(29)
    return code


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes = Codes()
    get = codes.__getitem__
    for batch in batches:
        arrays = [np.fromiter(map(get, words_of(t)), dtype=np.int32) for t in batch.column(1).to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["key", "ids"])


def _shingles(batches: Iterator[pa.RecordBatch], passing: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """(key, ids) -> (key, code, pos) of the shingles that a filter lets pass."""
    mask = np.uint64((1 << FILTER_BITS) - 1)
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column(1)
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        starts = np.concatenate([[0], ends[:-1]])
        codes = shingle_codes(ids)
        at = np.arange(len(codes)) if passing is None else np.flatnonzero(passing[(codes & mask).astype(np.int64)])
        row = np.searchsorted(ends, at, side="right")
        inside = at + SHINGLE <= ends[np.minimum(row, len(ends) - 1)]
        at, row = at[inside], row[inside]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(codes[at].view(np.int64)), pa.array((at - starts[row]).astype(np.int32))], ["key", "code", "pos"])


def _filter_of(df: DataFrame, code: str) -> np.ndarray:
    """Bits of the low ends of a bigint column, taken together word by word in Spark: at most 2^18 rows come here."""
    low = F.col(code).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = df.groupBy(F.shiftright(low, 6).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({code} & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << FILTER_BITS, dtype=bool)
    if words.num_rows:
        at = words.column(0).to_numpy().astype(np.int64) << 6
        bits = np.unpackbits(words.column(1).to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
        out[(at[:, None] + np.arange(64)).ravel()] = bits.ravel()
    return out


def _prefixes(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(item, [(pos, code, documents with it)] ) -> (item, code, pos) of the shingles of which every match has one.

    A window of ``least`` words with at most least // CHANGED changed ones keeps all but SHINGLE shingles per change,
    so it shares one of its rarest shingles beyond that number; longer matches contain such a window.
    """
    shingles = least - SHINGLE + 1
    prefix = shingles - max(1, shingles - SHINGLE * (least // CHANGED)) + 1
    for batch in batches:
        keys, codes, places = [], [], []
        for key, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own.sort(key=lambda x: x["pos"])
            rarity = [(x["df"], x["code"]) for x in own]
            kept = set()
            for at in range(len(own) - shingles + 1):
                kept.update(c for _, c in sorted(set(rarity[at : at + shingles]))[:prefix])
            for x in own:
                if x["code"] in kept:
                    keys.append(key)
                    codes.append(x["code"])
                    places.append(x["pos"])
        yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), pa.array(codes, pa.int64()), pa.array(places, pa.int32())], ["item", "code", "at"])


def _verify(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(key, item, shifts, ids, words) -> (key, item, longest passage) of the candidates that hold one."""
    for batch in batches:
        found: list[tuple[int, int]] = []
        cols = [batch.column(k) for k in (2, 3, 4)]
        for r in range(batch.num_rows):
            shifts = cols[0][r].as_py()
            ids, words = (c[r].values.to_numpy(zero_copy_only=False) for c in cols[1:])
            best = 0
            for shift in shifts:  # position in the document less position in the item
                begin, end = max(0, -shift), min(len(words), len(ids) - shift)
                if end - begin >= max(least, best + 1):
                    best = max(best, longest_match(ids[begin + shift : end + shift] == words[begin:end], least))
            if best:
                found.append((r, best))
        rows = pa.array([r for r, _ in found], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array([b for _, b in found], pa.int32())], ["key", "item", "words"])


def encoded_words(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ids array<int>): the words of each text as codes, in order; rows with a null key or text are left out."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key is not null and text is not null")
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(_encode, schema)


def leaked(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, least_words: int = 20) -> DataFrame:
    """Documents that contain a passage of an item: (key, item_key bigint, words int), one row per document and item.

    A passage is at least ``least_words`` consecutive words of the item in which at most one word in ten is replaced
    by another. words: the length of the longest such passage. Words are runs of letters, digits and underscores;
    layout, comment and quote signs, escapes, case and look-alike characters don't matter. Null texts or keys and
    items of fewer words never match; repeated items or documents with one key give one row. Empty tables give no rows.
    Words are compared by 32-bit codes: 20 words in place agree by chance in no corpus.

    Method: a set join. Texts are encoded once as word codes, whatever the items. The items' shingles set the bits of a
    filter of fixed size; the corpus's shingles that pass it are joined with them on the code, which gives the number of
    documents with each. Shingles are ordered by that rarity; of each item window only the rarest that no set of changes
    can all destroy, its prefix, are joined with the corpus's. A common shingle fixes the alignment (positional bound)
    and both lengths the room for a passage; each alignment is verified word by word over item-sized windows. Only
    documents with a candidate move, found by a second filter of fixed size over their keys.
    """
    source = materialize(encoded_words(docs, key, text), "encoded")
    key_type = source.schema["key"].dataType
    texts = items.select(F.col(item_key).cast("bigint").alias("k"), F.col(item_text).alias("t"))
    # Texts of one item are told apart by their order of words only: equal ones are one.
    known = materialize(encoded_words(texts, "k", "t").where(F.size("ids") >= least_words).distinct().withColumn("n", F.xxhash64("ids")).select(F.struct("key", "n").alias("key"), "ids"), "items")

    def shingles(df: DataFrame, passing: np.ndarray | None) -> DataFrame:
        schema = T.StructType([df.schema["key"], T.StructField("code", T.LongType()), T.StructField("pos", T.IntegerType())])
        return df.mapInArrow(lambda it: _shingles(it, passing), schema)

    own = materialize(shingles(known, None).withColumnsRenamed({"key": "item", "pos": "at"}), "item_shingles")
    passing = _filter_of(own, "code")
    # What passes the filter: in a corpus without leaks a small share, with a full filter everything; right in any case.
    hits = materialize(shingles(source.where(F.size("ids") >= least_words), passing).join(own.select("code").distinct(), "code", "left_semi"), "hits")
    rarity = hits.select("code", "key").distinct().groupBy("code").agg(F.count(F.lit(1)).alias("df"))
    ranked = own.join(rarity, "code", "left").groupBy("item").agg(F.collect_list(F.struct("at", "code", F.coalesce("df", F.lit(0)).alias("df"))).alias("own"))
    item_type = own.schema["item"].dataType
    listed = ranked.select("item", F.transform("own", lambda x: F.struct(x["at"].alias("pos"), x["code"].alias("code"), x["df"].alias("df"))).alias("own"))
    prefix = listed.mapInArrow(lambda it: _prefixes(it, least_words), T.StructType([T.StructField("item", item_type), T.StructField("code", T.LongType()), T.StructField("at", T.IntegerType())]))
    pairs = hits.join(prefix, "code").groupBy("key", "item").agg(F.collect_set(F.col("pos") - F.col("at")).alias("shifts"))
    pairs = materialize(pairs, "candidates")
    near = _filter_of(pairs.select(F.xxhash64("key").alias("h")), "h")
    mask = (1 << FILTER_BITS) - 1

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = near[b.column(2).to_numpy() & mask]
            if keep.any():
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["key", "ids"]).filter(pa.array(keep))

    wanted = source.select("key", "ids", F.xxhash64("key").alias("h")).mapInArrow(candidates, source.schema)
    rows = pairs.join(wanted, "key").join(known.select(F.col("key").alias("item"), F.col("ids").alias("words")), "item").select("key", "item", "shifts", "ids", "words")
    schema = T.StructType([T.StructField("key", key_type), T.StructField("item", item_type), T.StructField("words", T.IntegerType())])
    found = rows.mapInArrow(lambda it: _verify(it, least_words), schema)
    return found.groupBy("key", F.col("item.key").alias("item_key")).agg(F.max("words").alias("words")).select(F.col("key").alias(key), F.col("item_key").alias(item_key), "words")
