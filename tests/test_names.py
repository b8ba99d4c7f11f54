"""Scalar functions case by case."""

from pyspark.sql import functions as F

from spandrel.functions import names as N


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scalars(spark):
    L = F.lit
    null = F.lit(None).cast("string")
    cases = [
        (N.clean_symbol(L(" .frame(width:) ")), "frame"), (N.clean_symbol(L("@State")), "State"), (N.clean_symbol(null), None), (N.clean_repo(L(" A/B.git ")), "a/b"),
        (N.link_repo(L("r.git#x")), "r"), (N.link_repo(L("r?y=1")), "r"), (N.link_repo(L("r),")), "r"), (N.base_name(L("A.B<C.D>")), "B"),
        (N.version_number(L("10.15")), 10.15), (N.version_number(L("26.5")), 26.05), (N.version_number(L("14")), 14.0), (N.version_number(L("x")), 0.0), (N.version_number(null), 0.0),
        (N.version_text(L(26.05)), "26.05"), (N.version_text(L(10.1)), "10.1"), (N.version_text(L(14.0)), "14"), (N.version_text(L(0.0)), None),
        (N.year_of(L("2025-01-02")), 2025), (N.year_of(L("")), 2023), (N.year_of(null), 2023),
        (N.arg_shape(F.array(L("a"), L("_")), L(True)), "(a, _)"), (N.arg_shape(F.array().cast("array<string>"), L(True)), "{ }"), (N.arg_shape(F.array().cast("array<string>"), L(False)), "()"),
        (N.arg_shape(F.lit(None).cast("array<string>"), L(True)), None), (N.is_poor_snippet(L("abc")), True), (N.is_poor_snippet(L("a long snippet {")), True), (N.is_poor_snippet(L("a long snippet")), False),
        (N.is_poor_snippet(null), True), (N.permalink(L("b/"), L("p"), L(3)), "b/p#L3"), (N.is_demo(L("My-DEMO")), True), (N.is_platform_class(L("NSView")), True), (N.is_platform_class(L("NSview")), False),
        (N.tokens(L("Sheet of-x 3"), 2), ["sheet", "of"]), (N.occurrences_of(L("aXbX"), "X"), 2), (N.fenced_code(L("t\n```swift\nx\ny\n```\n")), "x\ny\n"), (N.fenced_code(L("plain")), "plain"),
        (N.relative_path(L("/a/b/c.swift"), L("/a/b")), "c.swift"), (N.relative_path(L("/x/c"), L("/a")), "/x/c"), (N.style_category(L("FooStyle")), "controlStyle"), (N.style_category(null), "other"),
        (N.doc_url(L("environmentKeys"), L("Dismiss")), "https://docs.invalid/swiftui/environmentvalues/dismiss"), (N.example_key(L("r"), L("p"), L(1)), "ex_" + __import__("hashlib").md5(b"r:p:1").hexdigest()[:10]),
        (N.is_public_name(L("_x")), False), (N.is_public_name(L("x1")), True),
    ]
    got = spark.range(1).select(*[c.alias(f"c{k}") for k, (c, _) in enumerate(cases)]).first()
    for k, (_, want) in enumerate(cases):
        assert got[k] == want, (k, got[k], want)


def test_permalink_and_patterns(spark):
    ok = value(spark, N.parse_permalink(F.lit("https://h.org/o/r/blob/abc/a/b.swift#L12")))
    assert (ok.owner, ok.repo, ok.sha, ok.path, ok.line) == ("o", "r", "abc", "a/b.swift", 12)
    assert value(spark, N.parse_permalink(F.lit("https://h.org/o/r"))) is None
    assert N.from_posix("a[[:space:]]+[^[:digit:]]") == r"a\s+[^\d]"
    assert value(spark, F.lit("x .pad(").rlike(N.token_pattern("pad"))) and not value(spark, F.lit("padding").rlike(N.token_pattern("pad")))
