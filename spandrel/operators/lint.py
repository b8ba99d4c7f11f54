"""Rules over lines and texts. Rules are data: (rule_id, severity, pattern, ...); texts are never moved to match them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spandrel.functions.names import from_posix, occurrences_of

#: Severities of findings, worst first, and their levels elsewhere.
SEVERITIES = ["hard", "warn", "adv"]
_TOOLKIT = {"hard": "hard", "error": "hard", "warning": "warn"}
_LEVEL = {"hard": "error", "warn": "warning"}


def toolkit_severity(structural: Column) -> Column:
    """Severity of a structural rule as a finding's: error and hard are hard, warning is warn, all else adv."""
    out = F.lit("adv")
    for a, b in _TOOLKIT.items():
        out = F.when(structural == a, b).otherwise(out)
    return out


def sarif_level(severity: Column) -> Column:
    out = F.lit("note")
    for a, b in _LEVEL.items():
        out = F.when(severity == a, b).otherwise(out)
    return out


def lines_of(text: Column | str) -> Column:
    """Lines of a text without their ends."""
    t = F.col(text) if isinstance(text, str) else text
    return F.transform(F.split(t, "\n"), lambda x: F.rtrim(x, F.lit("\r")))


def snippet(line: Column) -> Column:
    """A line without blanks at its start, tabs as blanks."""
    return F.regexp_replace(F.replace(line, F.lit("\t"), F.lit(" ")), r"^\s+", "")


def match_lines(texts: DataFrame, keys: list[str], text: str, rules: list[tuple]) -> DataFrame:
    """(keys, line int, rule int, snippet) : one row per rule and matching line, however often the rule matches in it.

    rules: (id, severity, pattern, ...); ``rule`` is the position in the list. A text is first tested as a whole with the
    rules' alternation, so that only texts with a hit are split, and rows are made only of lines with a hit: no rules x
    lines product exists. Null texts have no findings.
    """
    patterns = [from_posix(r[2]) for r in rules]
    some = "|".join(f"(?:{p})" for p in patterns)
    hit = texts.where(F.col(text).rlike(some))
    rows = hit.select(*keys, F.posexplode(lines_of(text)).alias("__pos", "__line")).where(F.col("__line").rlike(some))
    which = F.array_compact(F.array(*[F.when(F.col("__line").rlike(p), F.lit(k)) for k, p in enumerate(patterns)]))
    return rows.select(*keys, (F.col("__pos") + 1).alias("line"), F.explode(which).alias("rule"), snippet(F.col("__line")).alias("snippet"))


def absent(text: Column, present: str, missing: str) -> Column:
    """Whether a text matches one pattern and nowhere the other."""
    return text.rlike(from_posix(present)) & ~text.rlike(from_posix(missing))


def lines_after(text: Column, before: str, line: str) -> Column:
    """Numbers of the lines that match ``line`` and follow one that matches ``before``; within the row, without a window."""
    ls = lines_of(text)
    at = F.when(F.size(ls) > 1, F.sequence(F.lit(2), F.size(ls))).otherwise(F.array().cast("array<int>"))
    return F.filter(at, lambda k: F.element_at(ls, k - 1).rlike(from_posix(before)) & F.element_at(ls, k).rlike(from_posix(line)))


def balance(text: Column) -> Column:
    """struct<open_brace, close_brace, open_paren, close_paren int>"""
    return F.struct(*[occurrences_of(text, m).alias(n) for m, n in (("{", "open_brace"), ("}", "close_brace"), ("(", "open_paren"), (")", "close_paren"))])


def unbalanced(b: str) -> Column:
    return (F.col(f"{b}.open_brace") != F.col(f"{b}.close_brace")) | (F.col(f"{b}.open_paren") != F.col(f"{b}.close_paren"))


def tally(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: findings by severity, all, different rules that hit, and the exit class (2 with a hard finding, else 0)."""
    by = [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    return findings.groupBy(*keys).agg(*by, F.count(F.lit(1)).alias("total"), F.countDistinct("rule_id").alias("rules_hit"), F.when(F.bool_or(F.col("severity") == "hard"), 2).otherwise(0).alias("exit_class"))


def gate_verdict(hard: Column, strict: Column) -> Column:
    return F.when((hard > 0) & strict, "fail").when(hard > 0, "advisory").otherwise("pass")


def resolve_seams(findings: DataFrame, seams: DataFrame, keys: list[str]) -> DataFrame:
    """Findings with ``status``: open, or duplicate-of <rule> where a primary domain found the same line.

    seams: (primary, sibling, verdict demote|keep-both, token): the sibling's finding of a line is demoted if the primary
    has one there too; keep-both leaves both open; a token restricts a seam to lines that contain it (null: any).
    Findings are joined with those of the same line only.
    """
    primary = findings.select(*keys, F.col("domain").alias("primary"), F.col("rule_id").alias("__by"))
    ruled = F.broadcast(seams.where("verdict = 'demote'").select("primary", F.col("sibling").alias("domain"), "token"))
    pairs = findings.select(*keys, "domain", "rule_id", "snippet").join(ruled, "domain").join(primary, [*keys, "primary"])
    pairs = pairs.where(F.col("token").isNull() | F.contains("snippet", "token"))
    demoted = pairs.groupBy(*keys, "domain", "rule_id").agg(F.min("__by").alias("__by"))
    out = findings.join(demoted, [*keys, "domain", "rule_id"], "left")
    return out.withColumn("status", F.when(F.col("__by").isNull(), "open").otherwise(F.concat(F.lit("duplicate-of "), F.col("__by")))).drop("__by")


#: Most points that one category takes, and the least score of each band.
CATEGORY_CAP = 20
BANDS = [(90, "native"), (75, "mostly native"), (50, "reads foreign"), (25, "clearly foreign"), (0, "a port")]


def capped_score(smells: DataFrame, keys: list[str], category: str, points: str) -> DataFrame:
    """100 less the points of each category, at most CATEGORY_CAP a category, at least 0; and its band.

    ``smells`` has one row per distinct site. Keys without a smell aren't here: their score is 100.
    """
    per = smells.groupBy(*keys, category).agg(F.least(F.sum(points), F.lit(CATEGORY_CAP)).alias("__off"))
    score = F.greatest(F.lit(100) - F.sum("__off"), F.lit(0)).cast("int")
    out = per.groupBy(*keys).agg(score.alias("score"))
    band = F.lit(BANDS[-1][1])
    for least, name in reversed(BANDS[:-1]):
        band = F.when(F.col("score") >= least, name).otherwise(band)
    return out.withColumn("band", band)


#: Status of a finding -> statuses it may take next. Only automatic fixes are applied without a person.
TRANSITIONS = {"open": ["fixed", "wont-fix", "duplicate"], "fixed": ["verified", "open"], "verified": [], "wont-fix": ["open"], "duplicate": []}


def next_status(status: Column, wanted: Column, fix: Column) -> Column:
    """``wanted`` if the policy allows it from here, else the status as it is. Applied twice it changes nothing more."""
    allowed = F.lit(False)
    for a, bs in TRANSITIONS.items():
        allowed = allowed | ((status == a) & wanted.isin(bs or [""]))
    return F.when(allowed & ((wanted != "fixed") | (fix == "auto")), wanted).otherwise(status)
