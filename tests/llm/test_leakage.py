"""Escapes, words, passages, and the join against brute force."""

import random

import numpy as np

from spandrel.llm import leakage
from spandrel.llm.leakage import leaked, longest_match, words_of


def test_escapes():
    cases = {
        r"am\u200dber": ["amber"],
        r"so\u2007although": ["so", "although"],
        r"pr\u00e9c": ["préc"],
        r"pr\\u00e9cis": ["précis"],
        r"\u00e9a1": ["éa1"],
        r"a\u{e9}b \u{1F600} c": ["aéb", "c"],
        r"a\U000000e9b": ["aéb"],
        r"a\ud83d\ude00b": ["a", "b"],
        r"\ud835\udc00": ["𝐀".casefold()],
        r"a\ud83db": ["a", "b"],
        r"a\xe9b": ["aéb"],
        r"caf\xc3\xa9 x": ["café", "x"],
        r"caf\303\251 x": ["café", "x"],
        r"a\nb": ["a", "b"],
    }
    for text, want in cases.items():
        assert words_of(text) == want, (text, words_of(text))


def test_longest_match():
    def brute(same, least):
        n = len(same)
        return max((j - i for i in range(n) for j in range(i + least, n + 1) if 10 * (j - i - sum(same[i:j])) <= j - i), default=0)

    random.seed(6)
    for _ in range(200):
        same = np.array([random.random() < 0.9 for _ in range(random.randint(0, 60))], dtype=bool)
        assert longest_match(same, 20) == brute(same.tolist(), 20)


def test_against_brute_force(spark):
    random.seed(7)
    vocabulary = [f"w{k}" for k in range(300)]

    def text(n):
        return [random.choice(vocabulary) for _ in range(n)]

    opening = text(12)
    items = [(k, opening * (k % 2) + text(random.choice([8, 25, 60]))) for k in range(30)] + [(30, ["same"] * 40)]
    docs = []
    for d in range(120):
        words = text(random.choice([0, 5, 80]))
        if d % 3:
            own = random.choice(items)[1]
            begin = random.randint(0, max(0, len(own) - 15))
            part = list(own[begin : begin + random.choice([15, 19, 20, 21, 40])])
            for _ in range(random.choice([0, 1, 2, 3, 5])):
                if part:
                    part[random.randrange(len(part))] = "changed"
            words = words + part + text(20)
        docs.append((d, words))

    def brute(a, b):
        best = 0
        for shift in range(-len(b), len(a)):
            begin, end = max(0, -shift), min(len(b), len(a) - shift)
            if end - begin >= 20:
                same = np.array([a[k + shift] == b[k] for k in range(begin, end)])
                best = max(best, longest_match(same, 20))
        return best

    want = {(d, i): n for d, a in docs for i, b in items if (n := brute(a, b))}
    signs = [" ", "\n// ", '", "', "  \t"]
    rows = [(d, "".join(w.upper() + random.choice(signs) for w in a)) for d, a in docs] + [(0, "other text"), (None, "x"), (500, None), (501, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    known = spark.createDataFrame([(i, " ".join(b)) for i, b in items] + [(3, " ".join(items[3][1])), (None, "x"), (99, None)], "item_id int, text string")
    got = {(r.doc_id, r.item_id): r.words for r in leaked(df, "doc_id", "text", known, "item_id", "text").collect()}
    assert len(want) > 10 and got == want
    assert leaked(df.limit(0), "doc_id", "text", known, "item_id", "text").count() == 0
    assert leaked(df, "doc_id", "text", known.limit(0), "item_id", "text").count() == 0


def test_codes_are_bounded_and_stable():
    codes = leakage.Codes()
    assert codes["a"] == leakage.Codes()["a"] and codes["a"] != codes["b"]
