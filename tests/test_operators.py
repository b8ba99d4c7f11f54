"""Operators against brute force: ties, nulls, repeats, empty tables, hot keys."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from spandrel.operators import lint, topk
from spandrel.operators.authority import author_scores, repo_authority, without_bots
from spandrel.operators.latest import latest_per_key
from spandrel.operators.ranks import dense_ids, global_rank
from spandrel.operators.tree_agg import tree_aggregate


def test_tree_aggregate_many_rounds(spark):
    random.seed(5)
    rows = [("hot" if random.random() < 0.5 else None if random.random() < 0.1 else f"k{random.randint(0, 9)}", random.choice([None, random.randint(-5, 5)])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(6)
    # 3,000 rows in chunks of 20 merged by three: five rounds.
    got = {r.k: (r.n, r.c, r.s, r.lo, r.hi) for r in tree_aggregate(df, ["k"], {"n": ("count", "*"), "c": ("count", "v"), "s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v")}, chunk_rows=20, fan_in=3).collect()}
    want = defaultdict(list)
    for k, v in rows:
        want[k].append(v)
    for k, vs in want.items():
        own = [v for v in vs if v is not None]
        assert got[k] == (len(vs), len(own), sum(own), min(own), max(own))
    assert len(got) == len(want)
    assert tree_aggregate(df.limit(0), ["k"], {"n": ("count", "*")}).count() == 0


def test_latest_and_first(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (1, 3, "c"), (2, None, "d"), (None, 1, "e")], "k int, v int, x string")
    assert {(r.k, r.x) for r in latest_per_key(df, ["k"], ["v"], ["x"]).collect()} == {(1, "c"), (2, "d"), (None, "e")}
    assert {(r.k, r.x) for r in topk.first_per_key(df, ["k"], ["v"], ["x"]).collect()} == {(1, "a"), (2, "d"), (None, "e")}


def test_global_rank_and_dense_ids(spark):
    random.seed(2)
    rows = [(random.choice(["hot", "hot", "hot", None, "b"]), k) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, x int").repartition(5)
    got = {r.x: r["rank"] for r in global_rank(df, ["g"], [F.asc("x")]).collect()}
    seen = Counter()
    for g, x in sorted(rows, key=lambda r: r[1]):
        seen[g] += 1
        assert got[x] == seen[g]
    ids = {r.g: r.id for r in dense_ids(df, "g").collect()}
    assert ids == {"b": 0, "hot": 1}


def test_diverse_page_and_fallback(spark):
    rows = [("s", None, 9, "a"), ("s", None, 8, "b"), ("s", "x", 7, "c"), ("s", "x", 6, "d"), ("t", "y", 5, "e")]
    df = spark.createDataFrame(rows, "sym string, shape string, score int, id string")
    order = [F.desc("score"), F.asc("id")]
    got = {(r.sym, r["rank"]): r.id for r in topk.diverse_top_k(df, ["sym"], "shape", order, 3).collect()}
    assert got == {("s", 1): "a", ("s", 2): "c", ("s", 3): "b", ("t", 1): "e"}
    picked = topk.recommended_and_diverse(topk.top_k(df, ["sym"], order, 9), ["sym"], "shape", "rank", 3)
    assert {(r.sym, r.role, r.id) for r in picked.collect()} == {("s", "recommended", "a"), ("s", "diverse", "c"), ("t", "recommended", "e")}
    paged = topk.page(df, ["sym"], order, 2, 2)
    assert [(r.id, r.more) for r in paged.orderBy("rank").collect()] == [("c", False), ("d", False)]
    assert [r.more for r in topk.page(df, ["sym"], order, 1, 3).where("sym = 's'").collect()] == [True] * 3
    kept = topk.keep_or_all(df, ["sym"], F.col("shape") == "x")
    assert {r.id for r in kept.collect()} == {"c", "d", "e"}
    assert topk.diverse_top_k(df.limit(0), ["sym"], "shape", order, 3).count() == 0


def test_authority(spark):
    contribs = spark.createDataFrame([("r", "o", "o", 10), ("r", "o", "p", 30), ("q", "x", "p", 5)], "repo string, owner string, login string, contributions int")
    scores = spark.createDataFrame([("o", 100), ("p", 1000)], "login string, score int")
    got = {r.repo: (r.authority, r.raw_max, r.contributors) for r in repo_authority(contribs, scores, 5).collect()}
    assert got == {"r": (750, 1000, 2), "q": (1000, 1000, 1)}
    bots = spark.createDataFrame([("r", "dependabot[bot]", 99), ("r", "renovate", 98), ("r", "ann", 1)], "repo string, login string, contributions int")
    assert [r.login for r in without_bots(bots, "login", 2, ["repo"], "contributions").collect()] == ["ann"]
    own = spark.createDataFrame([("a", "r1", 5), ("a", "r2", 7)], "login string, repo string, stars int")
    assert author_scores(own, own, 1).first().score == 14


def test_lint(spark):
    text = "import A\n@Relationship\r\n  let x = 1\n\tNavigationView {\nNavigationView { NavigationView {\n"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    rules = [("R1", "hard", r"NavigationView[[:space:]]*\{"), ("R2", "warn", r"^[[:space:]]*let")]
    got = [(r.id, r.line, r.rule, r.snippet) for r in lint.match_lines(df, ["id"], "text", rules).orderBy("line").collect()]
    assert got == [(1, 3, 1, "let x = 1"), (1, 4, 0, "NavigationView {"), (1, 5, 0, "NavigationView { NavigationView {")]
    assert df.where("id = 1").select(lint.lines_after(F.col("text"), "@Relationship", "^[[:space:]]*let[[:space:]]").alias("x")).first().x == [3]
    assert [r.id for r in df.where(lint.absent(F.col("text"), "import", "struct")).collect()] == [1]
    moved = df.select(lint.next_status(F.lit("open"), F.lit("fixed"), F.lit("auto")).alias("a"), lint.next_status(F.lit("open"), F.lit("fixed"), F.lit("manual")).alias("b"), lint.next_status(F.lit("verified"), F.lit("fixed"), F.lit("auto")).alias("c")).first()
    assert (moved.a, moved.b, moved.c) == ("fixed", "open", "verified")


def test_score_caps(spark):
    rows = [("r", "a", 6)] * 5 + [("r", "b", 3)]
    got = lint.capped_score(spark.createDataFrame(rows, "repo string, c string, p int"), ["repo"], "c", "p").first()
    assert (got.score, got.band) == (77, "mostly native")


def test_rule_helpers(spark):
    from spandrel.plans import rules

    assert rules.literal_rules(["a.b("])[0][2] == r"a\.b\("
    found = spark.createDataFrame([(1, "R1")], "doc_id int, rule_id string")
    assert rules.with_tiers(found, None).first().engine == "tier 2 skipped"
    assert {(r.tier, r.engine) for r in rules.with_tiers(found, found).collect()} == {("grep1", "both tiers"), ("structural", "both tiers")}
    repos = spark.createDataFrame([("a/X", 1), ("b/y", 9), ("c/z", 5)], "repo string, stars int")
    assert [r.repo for r in rules.chosen_repos(repos, [], 2).collect()] == ["b/y", "c/z"] and [r.repo for r in rules.chosen_repos(repos, ["A/x"]).collect()] == ["a/X"]
