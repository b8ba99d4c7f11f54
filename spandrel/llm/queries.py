"""Queries of the operators in this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.functions.names import clean_repo, clean_symbol
from spandrel.llm.capping import cap_per_contributor
from spandrel.llm.cooccur import co_occurrence
from spandrel.llm.leakage import leaked
from spandrel.llm.lookalike import consistent_texts, visual_classes, visual_pairs
from spandrel.llm.origin import file_origins
from spandrel.llm.packing import pack
from spandrel.llm.syntax import broken_files, parse_files
from spandrel.llm.topn import top_n_per_group
from spandrel.operators.latest import latest_per_key
from spandrel.session import materialize
from spandrel.sources.tables import table

#: Fixed values of the queries.
PAIR_LEAST, PAIR_SHARE, PAIR_LIFT = 7, (1, 200), 4
TOP_N, REPO_CAP, REPO_SHARE = 5, 12, 0.02
CONTAINER = 4096
#: Rank file of a public tokenizer; its place is a parameter of the operator.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "occurrences").select("doc_id", clean_symbol("sym").alias("sym"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co_occurrence(_uses(spark, sf_dir), "doc_id", "sym", PAIR_LEAST, PAIR_SHARE)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    far = F.col("c") * F.col("n_baskets") >= PAIR_LIFT * F.col("f_a") * F.col("f_b")
    return _pairs(spark, sf_dir).where(far).select(F.col("item_a").alias("sym_a"), F.col("item_b").alias("sym_b"))


def _measured(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        F.col("item_a").alias("sym_a"), F.col("item_b").alias("sym_b"), "c", "f_a", "f_b", "n_baskets",
        F.round("lift", 4).alias("lift"), F.round("odds_ratio", 3).alias("odds_ratio"),
    )


def p1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs with the support of p1_found, as its SQL has them, with their counts and measures."""
    return _measured(_pairs(spark, sf_dir))


def p1_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair that a file uses, however rare, with its counts and measures."""
    return _measured(co_occurrence(_uses(spark, sf_dir), "doc_id", "sym"))


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "examples").where("example_id is not null")
    one = latest_per_key(rows, ["example_id"], ["captured_at"], ["sym", "repo", "stars", "score"])
    return one.withColumns({"sym": clean_symbol("sym"), "repo": clean_repo("repo")})


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = top_n_per_group(_examples(spark, sf_dir), "sym", "stars", ["repo", "example_id"], TOP_N)
    return best.select("sym", "example_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc_nulls_last("score"), F.desc_nulls_last("stars"), F.asc("example_id")]
    rows = _examples(spark, sf_dir).where(F.col("repo").isNotNull())
    return cap_per_contributor(rows, "repo", order, "example_id", max_count=REPO_CAP).where(~F.col("kept")).select("example_id")


def p3_by_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per clean repo the examples that are kept and removed when none may have more than a fiftieth of all."""
    order = [F.desc_nulls_last("score"), F.desc_nulls_last("stars"), F.asc("example_id")]
    rows = _examples(spark, sf_dir).where(F.col("repo").isNotNull())
    capped = cap_per_contributor(rows, "repo", order, "example_id", max_share=REPO_SHARE)
    return capped.groupBy("repo").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("removed"), F.min(F.when(F.col("kept"), F.col("score"))).alias("least_kept"))


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visual_classes(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visual_pairs(materialize(_classes(spark, sf_dir), "classes"), "doc_id")


def p9_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the canonical member of its class (itself if nothing looks like it) and its consistent form."""
    docs = consistent_texts(table(spark, sf_dir, "documents"), "doc_id", "text")
    found = _classes(spark, sf_dir).select("doc_id", F.col("class_id").alias("found"))
    return docs.join(found, "doc_id", "left").select("doc_id", F.coalesce("found", "doc_id").alias("class_id"), "form")


def p5_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file with its repair cost, the cause and the first line to repair."""
    return parse_files(table(spark, sf_dir, "documents"), "doc_id", "path", "text")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken_files(table(spark, sf_dir, "documents"), "doc_id", "path", "text").where("broken").select("doc_id").distinct()


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per repository and language the files, those that don't parse, their share, and what the scanner skipped."""
    files = broken_files(table(spark, sf_dir, "documents"), "doc_id", "path", "text", ("repo",))
    scans = latest_per_key(table(spark, sf_dir, "source_files").where("doc_id is not null"), ["doc_id"], ["scanned_at", "ingested_at"], ["skipped"])
    joined = files.join(scans, "doc_id", "left")
    broken = F.when(F.col("broken"), 1).otherwise(0)
    counts = joined.groupBy("repo", "language").agg(F.count(F.lit(1)).alias("files"), F.sum(broken).alias("broken"), F.count("skipped").alias("skipped"))
    return counts.withColumn("share", F.round(F.col("broken") / F.col("files"), 4))


def p6_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file with what it is besides hand-written source: tool, minified, third_party, copy or data, else null."""
    return file_origins(table(spark, sf_dir, "documents"), "doc_id", "path", "text", table(spark, sf_dir, "upstream_files"), "text")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_files(spark, sf_dir).where("origin is not null").select("doc_id").distinct()


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text, or each part of one larger than a container, with its container."""
    return pack(table(spark, sf_dir, "documents"), "doc_id", "text", CONTAINER, VOCABULARY)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers and parts, tokens in them, and the share of their room that is filled."""
    per = p7_packed(spark, sf_dir).groupBy("container").agg(F.count(F.lit(1)).alias("parts"), F.sum("tokens").alias("tokens"))
    out = per.agg(F.count(F.lit(1)).alias("containers"), F.sum("parts").alias("parts"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    return out.withColumn("filled", F.round(F.col("tokens") / (F.col("containers") * CONTAINER), 6))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per leaked evaluation item the documents that hold it and its longest passage."""
    return _leaks(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("docs"), F.max("words").alias("longest"))


QUERIES = {"p1_found": p1_found, "p1_pairs": p1_pairs, "p1_all_pairs": p1_all_pairs, "p2_found": p2_found, "p3_found": p3_found, "p3_by_share": p3_by_share, "p5_found": p5_found, "p5_files": p5_files, "p5_rates": p5_rates, "p6_found": p6_found, "p6_files": p6_files, "p7_packed": p7_packed, "p7_fill": p7_fill, "p8_found": p8_found, "p8_items": p8_items, "p9_found": p9_found, "p9_canonical": p9_canonical}

_SYM = r"trim(split_part(regexp_replace(trim(sym, E' \t\n\r'), '^[.@]', ''), '(', 1), E' \t\n\r')"
_REPO = r"regexp_replace(lower(trim(repo, E' \t\n\r')), '\.git$', '')"

_SQL_PAIRS = f"""
    with b as (select distinct doc_id, {_SYM} as sym from occurrences where sym is not null and doc_id is not null),
    n as (select count(distinct doc_id) as n from b),
    f as (select sym, count(*) as f from b group by sym),
    c as (select x.sym as sym_a, y.sym as sym_b, count(*) as c from b x join b y on x.doc_id = y.doc_id and x.sym < y.sym group by all),
    p as (select c.*, fa.f as f_a, fb.f as f_b, n.n as n_baskets from c join f fa on fa.sym = sym_a join f fb on fb.sym = sym_b, n
          where c >= {PAIR_LEAST} and c * {PAIR_SHARE[1]} >= n.n * {PAIR_SHARE[0]})
"""
_SQL_EXAMPLES = f"""
    with l as (
      select *, row_number() over (partition by example_id order by captured_at desc nulls last, sym desc nulls last, repo desc nulls last,
                                   stars desc nulls last, score desc nulls last) as rn
      from examples where example_id is not null),
    e as (select example_id, {_SYM} as sym, {_REPO} as repo, stars, score from l where rn = 1)
"""

_SQL_ALL_PAIRS = f"""
    with b as (select distinct doc_id, {_SYM} as sym from occurrences where sym is not null and doc_id is not null),
    n as (select count(distinct doc_id) as n_baskets from b),
    f as (select sym, count(*) as f from b group by sym),
    c as (select x.sym as sym_a, y.sym as sym_b, count(*) as c from b x join b y on x.doc_id = y.doc_id and x.sym < y.sym group by all)
    select sym_a, sym_b, c, fa.f as f_a, fb.f as f_b, n_baskets, round(c::double * n_baskets / (fa.f::double * fb.f), 4) as lift,
           round((c + 0.5::double) * (n_baskets - fa.f - fb.f + c + 0.5::double) / ((fa.f - c + 0.5::double) * (fb.f - c + 0.5::double)), 3) as odds_ratio
    from c join f fa on fa.sym = sym_a join f fb on fb.sym = sym_b, n
"""

SQL = {
    "p1_all_pairs": _SQL_ALL_PAIRS,
    "p1_found": _SQL_PAIRS + f"select sym_a, sym_b from p where c * n_baskets >= {PAIR_LIFT} * f_a * f_b",
    "p1_pairs": _SQL_PAIRS
    + """select sym_a, sym_b, c, f_a, f_b, n_baskets, round(c::double * n_baskets / (f_a::double * f_b), 4) as lift,
           round((c + 0.5::double) * (n_baskets - f_a - f_b + c + 0.5::double) / ((f_a - c + 0.5::double) * (f_b - c + 0.5::double)), 3) as odds_ratio
         from p""",
    "p2_found": _SQL_EXAMPLES
    + f"""select sym, example_id from (select *, row_number() over (partition by sym order by stars desc nulls last, repo nulls last, example_id) as k
          from e where sym is not null) where k <= {TOP_N}""",
    "p3_found": _SQL_EXAMPLES
    + f"""select example_id from (select *, row_number() over (partition by repo order by score desc nulls last, stars desc nulls last, example_id) as k
          from e where repo is not null) where k > {REPO_CAP}""",
    "p3_by_share": _SQL_EXAMPLES
    + f""", k as (select *, row_number() over (partition by repo order by score desc nulls last, stars desc nulls last, example_id) as k, count(*) over () as n from e where repo is not null),
          j as (select *, k <= greatest(1, floor({REPO_SHARE}::double * n)) as kept from k)
          select repo, count(*) filter (kept) as kept, count(*) filter (not kept) as removed, min(case when kept then score end) as least_kept from j group by repo""",
}
