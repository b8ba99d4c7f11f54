"""Character n-gram models of the names in source code, one per language, trained on the corpus itself."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Letters by themselves, any digit as one sign; 0 is the edge of a name. 6 bits a sign, so a trigram has 18.
_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
OTHER, DIGIT, UNDERSCORE, DOLLAR = 53, 54, 55, 56
BITS, GRAMS = 6, 1 << 18
#: Weight of the shorter n-gram when a longer one is smoothed by it.
WEIGHT = 4.0

_CODE = np.full(256, OTHER, dtype=np.int32)
_CODE[[ord(x) for x in _ALPHABET]] = np.arange(1, len(_ALPHABET) + 1)
_CODE[[ord(x) for x in "0123456789"]] = DIGIT
_CODE[ord("_")], _CODE[ord("$")], _CODE[ord("\n")] = UNDERSCORE, DOLLAR, 0

_STRING = r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\''
_BLOCK = r"/\*(?:[^*]|\*(?!/))*(?:\*/)?|//[^\n]*"
#: Comments and strings per language. An open one reaches to the end of the text, so that no text is scanned twice.
_ASIDE = {
    "py": re.compile(r'"""(?:[^"]|"(?!""))*(?:""")?|\'\'\'(?:[^\']|\'(?!\'\'))*(?:\'\'\')?|#[^\n]*|' + _STRING),
    "js": re.compile(_BLOCK + r"|`[^`]*`?|" + _STRING),
    "swift": re.compile(r'"""(?:[^"]|"(?!""))*(?:""")?|' + _BLOCK + r'|"(?:[^"\\\n]|\\.)*"'),
    "c": re.compile(_BLOCK + r"|" + _STRING),
}
_NAME = re.compile(r"[^\W\d][\w$]*|\$[\w$]*")
_DIGITS = re.compile(r"\d+")


def names_of(text: str, language: str) -> Counter:
    """Names of a text with their counts, without those in strings and comments. Key words are names too."""
    return Counter(_NAME.findall(_ASIDE[language].sub(" ", text)))


def shapes(names) -> int:
    """Different names once runs of digits are disregarded: few among many names are a template's."""
    return len(set(_DIGITS.sub("0", "\n".join(names)).split("\n"))) if names else 0


def styles(names) -> list[int]:
    """Names of each style: lower, lowerCamel, UpperCamel, snake, UPPER, of at most two letters, other."""
    out = [0] * len(STYLES)
    for n in names:
        bare = n.strip("_$")
        if len(bare) <= 2:
            k = 5
        elif bare.isupper():
            k = 4
        elif "_" in bare:
            k = 3
        elif bare[0].isupper():
            k = 2
        elif bare.islower():
            k = 0
        else:
            k = 1 if bare.isalnum() else 6
        out[k] += 1
    return out


STYLES = ("lower", "camel", "pascal", "snake", "upper", "short", "other")


def trigrams(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code of each trigram, number of the name it belongs to); a name of n letters has n + 1 trigrams."""
    flat = np.frombuffer(("\n\n" + "\n\n".join(names) + "\n").encode("latin-1", "replace"), dtype=np.uint8)
    code = _CODE[flat]
    grams = (code[:-2] << (2 * BITS)) | (code[1:-1] << BITS) | code[2:]
    # A trigram that ends in the first of two edges closes a name; one that ends in the second belongs to none.
    lengths = np.array([len(n) + 2 for n in names], dtype=np.int64)
    owner = np.repeat(np.arange(len(names)), lengths)[: len(grams)]
    first = np.zeros(len(grams) + 1, dtype=bool)
    first[np.cumsum(lengths)[:-1] - 1] = True
    keep = ~first[: len(grams)]
    return grams[keep], owner[keep]


def count_grams(batches: Iterator[pa.RecordBatch], languages: list[str]) -> Iterator[pa.RecordBatch]:
    """(language, names) of each file -> (language, code, n) of one task: at most one row per language and trigram."""
    sums = {lang: np.zeros(GRAMS, dtype=np.int64) for lang in languages}
    for batch in batches:
        own = batch.column(0).to_pylist()
        for lang, names in zip(own, batch.column(1).to_pylist()):
            if names and lang in sums:
                codes, n = np.unique(trigrams(names)[0], return_counts=True)
                sums[lang][codes] += n
    for lang, total in sums.items():
        code = np.flatnonzero(total)
        if len(code):
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code)), pa.array(code.astype(np.int32)), pa.array(total[code])], ["language", "code", "n"])


def model(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bits of the last letter of each trigram, given the two before it, smoothed by bigram and letter."""
    size = 1 << BITS
    three = np.zeros(GRAMS)
    three[codes] = counts
    three = three.reshape(size, size, size)
    two = three.sum(0)
    one = two.sum(0)
    p1 = (one + 1) / (one.sum() + size)
    p2 = (two + WEIGHT * p1) / (two.sum(1, keepdims=True) + WEIGHT)
    p3 = (three + WEIGHT * p2[None]) / (three.sum(2, keepdims=True) + WEIGHT)
    return -np.log2(p3).astype(np.float32).reshape(GRAMS)


def cross_entropy(names: list[str], bits: np.ndarray) -> float:
    """Mean bits a letter of the names under a model."""
    return float(bits[trigrams(names)[0]].mean()) if names else 0.0
