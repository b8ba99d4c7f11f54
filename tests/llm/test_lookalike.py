"""Visual classes, forms and pairs."""

import unicodedata

from spandrel.llm import lookalike, queries


def test_classes(spark, folder):
    cyrillic, accent = "pаper", "café"
    rows = {
        1: "copied", 2: "copied", 3: "copied",  # exact copies alone
        4: "paper", 5: cyrillic, 6: "paper",  # twins, one of them copied
        7: "café", 8: accent, 9: "cafe", 10: "cafe",  # the accent shows; copies beside a near text
        11: "alone", 12: " ", 13: " ", 14: None,
    }
    d = folder("documents", list(rows.items()), "doc_id bigint, text string")
    got = {r.doc_id: (r.class_id, r.form) for r in queries.p9_canonical(spark, d).collect()}
    pairs = {tuple(r) for r in queries.p9_found(spark, d).collect()}
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 7, 8: 7, 9: 9, 10: 9, 11: 11, 12: 12, 13: 13, 14: 14}
    assert {k: v[0] for k, v in got.items()} == want, got
    assert got[5][1] == got[4][1] == "paper" and got[7][1] == got[8][1] == "café" and got[9][1] == "cafe" and got[14][1] is None
    assert pairs == {(4, 5), (5, 6), (7, 8)}, pairs


def classes(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return {r.doc_id: r.class_id for r in lookalike.visual_classes(df, "doc_id", "text").collect()}


def test_what_the_collation_decides(spark):
    # Composed and separate accents, Hangul, marks outside the basic plane: equal only by the collation, as forms differ.
    for a in ("naïve", "한글", "ṩ", "\U0001109a", "क़", "が", "أ"):
        b = unicodedata.normalize("NFD", a)
        assert a != b and classes(spark, [a + "x", b + "x"]) == {0: 0, 1: 0}, a
    # Marks in another canonical order are equal, too.
    for a, b in (("q\u0323\u0307", "q\u0307\u0323"), ("\u00e9\u0323", "e\u0323\u0301")):
        assert classes(spark, [a, b]) == {0: 0, 1: 0}, ascii(a)


def test_what_the_exact_check_keeps_apart(spark):
    # The collation holds these equal, the eye doesn't: digits of other scripts, styled letters, odd marks.
    for a, b in (("x1", "x١"), ("x\U0001d41a", "x\U0001d44e"), ("a̍b", "a̎b"), ("a̖b", "a̗b"), ("x²", "x2"), ("A", "a"), ("a b", "a  b"), ("a\nb", "a b")):
        assert classes(spark, [a, b]) == {}, (a, b)


def test_disregarded(spark):
    for a, b in (("Ａｂ", "Ab"), ("a​b", "ab"), ("a b", "a b"), ("АΑA", "AAA"), ("a­b", "ab"), ("﻿x", "x"), ("ｶﾞ", "ガ")):
        assert classes(spark, [a, b]) == {0: 0, 1: 0}, (a, b)
    assert classes(spark, ["​", "﻿", "", None]) == {}  # nothing to see
