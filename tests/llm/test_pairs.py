"""Pairs against brute force, baskets cut into blocks among them."""

import random
from collections import Counter
from itertools import combinations

from spandrel.llm import queries
from spandrel.llm.cooccur import co_occurrence


def brute(rows):
    baskets = {}
    for b, s in rows:
        if b is not None and s is not None:
            baskets.setdefault(b, set()).add(s)
    f = Counter(s for own in baskets.values() for s in own)
    c = Counter(p for own in baskets.values() for p in combinations(sorted(own), 2))
    return {(a, b): (n, f[a], f[b], len(baskets)) for (a, b), n in c.items()}


def test_rare_pairs_come_out(spark, folder):
    files = {k: ["a", "b"] for k in range(300)} | {300: ["a", "rare", "rarer"], 301: ["rare", "rarer"], 302: ["lone"]}
    rows = [(k, s) for k, syms in files.items() for s in syms] + [(300, None)]
    d = folder("occurrences", rows, "doc_id bigint, sym string")
    got = {(r.sym_a, r.sym_b): (r.c, r.f_a, r.f_b, r.n_baskets) for r in queries.QUERIES["p1_all_pairs"](spark, d).collect()}
    assert got == brute(rows)


def test_blocks_thresholds_and_empty(spark):
    random.seed(4)
    rows = [(b, f"s{random.randint(0, 60)}") for b in range(20) for _ in range(random.choice([1, 3, 200]))] + [(None, "x"), (3, None), (4, ""), (5, "")]
    df = spark.createDataFrame(rows, "b int, s string").withColumnRenamed("s", "id").repartition(4)
    want = brute(rows)
    for block in (7, 2_048):
        got = {(r.item_a, r.item_b): (r.c, r.f_a, r.f_b, r.n_baskets) for r in co_occurrence(df, "b", "id", block_items=block).collect()}
        assert got == want
    least = {p: v for p, v in want.items() if v[0] >= 3 and v[0] * 4 >= v[3]}
    assert {(r.item_a, r.item_b): (r.c, r.f_a, r.f_b, r.n_baskets) for r in co_occurrence(df, "b", "id", 3, (1, 4)).collect()} == least
    assert co_occurrence(df.limit(0), "b", "id").count() == 0
