"""Paired evaluation, the guard over whole edits, and the review of a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.functions.names import fenced_code
from spandrel.plans import base
from spandrel.plans.catalog import consensus_share
from spandrel.plans.rules import RULES, _findings
from spandrel.sources.tables import table
from spandrel.streaming.guard import advisories

#: Symbols that an answer shouldn't name, besides deprecated ones, and the shape that it should have.
FORBIDDEN, SHAPE = ["import", "class", "null"], r"(?i)\b(struct|let|const|def)\b"


def forbidden_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forbidden names and deprecated ones, each once."""
    own = spark.createDataFrame([(t,) for t in FORBIDDEN], "token string")
    return own.union(base.availability(spark, sf_dir).where("deprecated").select("sym")).distinct()


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task, kind, text) of evaluation texts, the first of each; code fences are opened."""
    rows = table(spark, sf_dir, "eval_items").where("task is not null and text is not null")
    first = rows.groupBy("task", "kind").agg(F.min_by("text", "item_id").alias("text"))
    return first.select("task", "kind", fenced_code("text").alias("text"))


def paired_scores(rows: DataFrame, before: str, after: str, tokens: list[str], shape: str) -> DataFrame:
    """(task, kind, text) -> per task with both kinds: forbidden tokens and shape of each."""
    words = F.split("text", r"[^A-Za-z0-9_]+")
    scored = rows.where(F.col("kind").isin(before, after)).select("task", "kind", F.size(F.filter(words, lambda w: w.isin(tokens))).alias("tokens"), F.col("text").rlike(shape).cast("int").alias("shape"))
    a, b = (scored.where(F.col("kind") == k).select("task", F.col("tokens").alias(f"tokens_{n}"), F.col("shape").alias(f"shape_{n}")) for k, n in ((before, "before"), (after, "after")))
    return a.join(b, "task")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = [r[0] for r in forbidden_tokens(spark, sf_dir).orderBy("token").collect()]  # of the shipped catalogue, fixed size
    return paired_scores(answers(spark, sf_dir), "prompt", "solution", tokens, SHAPE)


def paired_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)


def paired_eval_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs, and how many are strictly better afterwards in each measure."""
    return _pairs(spark, sf_dir).agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("tokens_after") < F.col("tokens_before")).alias("token_wins"), F.count_if(F.col("shape_after") > F.col("shape_before")).alias("shape_wins"))


def markdown_table(rows: DataFrame, most: int = 1000) -> str:
    """A result as a Markdown table, at most so many rows."""
    head = f"| {' | '.join(rows.columns)} |\n|{'---|' * len(rows.columns)}\n"
    return head + "".join(f"| {' | '.join('—' if v is None else str(v) for v in r)} |\n" for r in rows.limit(most).collect())


def guard_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The guard over every source file as one whole-file edit; names in lower-case plain words stand for deprecated ones."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    call = F.to_json(F.struct(F.lit("Write").alias("tool_name"), F.struct(F.col("path").alias("file_path"), F.col("text").alias("content")).alias("tool_input")))
    return advisories(docs.select("doc_id", call.alias("event")), "doc_id", "event", [("padding", "safeAreaPadding"), ("isEmpty", "count"), ("NavigationView", "NavigationStack")]).select("doc_id", "hits")


def review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of every file worth a remark: deprecated (1), a shape off the consensus (2), or a rule's advice (3)."""
    old = F.broadcast(base.availability(spark, sf_dir).where("deprecated").select("sym", "renamed"))
    uses = base.matched(spark, sf_dir, "line", "args")
    first = uses.join(old, "sym").select("doc_id", "line", F.lit(1).alias("severity"), "sym", F.coalesce("renamed", F.lit("")).alias("detail"))
    from spandrel.functions.names import arg_shape

    best = consensus_share(spark, sf_dir).where("rank = 1 and percent >= 50").select("dim", "sym", F.col("shape").alias("usual"))
    shaped = uses.withColumn("shape", arg_shape("args", "trailing_closure")).where("shape is not null")
    off = shaped.join(best, ["dim", "sym"]).where("shape <> usual").select("doc_id", "line", F.lit(2).alias("severity"), "sym", F.col("usual").alias("detail"))
    nits = _findings(spark, sf_dir).where("severity = 'adv'").select("doc_id", "line", F.lit(3).alias("severity"), F.col("rule_id").alias("sym"), F.col("domain").alias("detail"))
    return first.unionByName(off).unionByName(nits).distinct()


QUERIES = {f.__name__: f for f in (forbidden_tokens, paired_eval, paired_eval_wins, guard_advice, review)}

_FORB = f"{base.AVAIL_SQL}, tok as (select unnest([{base.quoted(FORBIDDEN)}]) as token union select sym from avail where deprecated)"
_ANS = r"""ans as (select task, kind, case when regexp_matches(text, '(?s)```[A-Za-z]*\r?\n.*?```') then regexp_extract(text, '(?s)```[A-Za-z]*\r?\n(.*?)```', 1) else text end as text
    from (select task, kind, arg_min(text, item_id) as text from eval_items where task is not null and text is not null group by all)),
    sc as (select task, kind, len(list_filter(string_split_regex(text, '[^A-Za-z0-9_]+'), lambda w: list_contains(tl, w)))::int as tokens,
           regexp_matches(text, '(?i)\b(struct|let|const|def)\b')::int as shape from ans, (select list(token) as tl from tok)),
    pr as (select a.task, a.tokens as tokens_before, a.shape as shape_before, b.tokens as tokens_after, b.shape as shape_after from sc a join sc b on a.task = b.task and a.kind = 'prompt' and b.kind = 'solution')"""
_ADV = " union all ".join(f"select doc_id, line, '{i}' as sym, '{d}' as detail from l where regexp_matches(rtrim(raw, E'\\r'), '{p}')" for i, s, p, d in RULES if s == "adv")
SQL = {
    "forbidden_tokens": f"with {_FORB} select token from tok",
    "paired_eval": f"with {_FORB}, {_ANS} select * from pr",
    "paired_eval_wins": f"with {_FORB}, {_ANS} select count(*) as pairs, count(*) filter (tokens_after < tokens_before) as token_wins, count(*) filter (shape_after > shape_before) as shape_wins from pr",
    "guard_advice": r"""with h as (select doc_id, list_filter([case when regexp_matches(text, '(?:[.(]|\b)padding\b') then 'padding' end, case when regexp_matches(text, '(?:[.(]|\b)isEmpty\b') then 'isEmpty' end,
        case when regexp_matches(text, '(?:[.(]|\b)NavigationView\b') then 'NavigationView' end], lambda x: x is not null) as hits from documents where text <> '' and path like '%.swift')
        select doc_id, array_to_string(hits, ',') as hits from h where len(hits) > 0""",
    "review": f"""with {base.USES_SQL}, {base.AVAIL_SQL},
        c as (select dim, sym, {base.SHAPE_SQL} as shape, count(*) as uses from matched where {base.SHAPE_SQL} is not null group by all),
        r as (select *, row_number() over (partition by dim, sym order by uses desc, shape) as rank, sum(uses) over (partition by dim, sym) as total from c),
        k as (select *, sum(uses) over (partition by dim, sym) as stored from r where rank <= 15 and uses * 100 >= total),
        b as (select dim, sym, shape as usual from k where rank = 1 and (200 * uses + stored) // (2 * stored) >= 50),
        t as (select doc_id, repo, path, text from documents where path like '%.swift' and text is not null),
        l as (select doc_id, unnest(ls) as raw, unnest(range(1, len(ls) + 1))::int as line from (select *, string_split(text, E'\\n') as ls from t))
        select distinct doc_id, line, 1 as severity, m.sym, coalesce(renamed, '') as detail from matched m join avail a on a.sym = m.sym and a.deprecated
        union select doc_id, line, 2, m.sym, usual from (select *, {base.SHAPE_SQL} as shape from matched) m join b on b.dim = m.dim and b.sym = m.sym where shape is not null and shape <> usual
        union select doc_id, line, 3, sym, detail from ({_ADV})""",
}
