"""The rule engine over source texts: findings, tallies, gates, steering and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.operators import lint
from spandrel.operators.topk import top_k
from spandrel.plans import base
from spandrel.sources.tables import table

#: Text rules (id, severity, pattern, domain). Patterns must match as they are.
RULES = [
    ("R1", "hard", r"NavigationView[[:space:]]*\{", "api-currency"),
    ("R2", "warn", r"\.foregroundColor\(", "api-currency"),
    ("R3", "warn", r"\.cornerRadius\(", "api-currency"),
    ("R4", "warn", r"\.onChange\(of:[^)]*\)[[:space:]]*\{[[:space:]]*[A-Za-z_][A-Za-z0-9_]*[[:space:]]+in", "api-currency"),
    ("R5", "warn", r"\.tabItem[[:space:]]*\{", "api-currency"),
    ("R6", "warn", r"Text\([^)]*\)[[:space:]]*\+[[:space:]]*Text\(", "api-currency"),
    ("R7", "warn", r"\.navigationBarTitle\(|navigationBarTitleDisplayMode", "navigation-toolbars"),
    ("R8", "warn", r"placement:[[:space:]]*\.navigationBar(Leading|Trailing)", "navigation-toolbars"),
    ("R9", "hard", r"\.glassBackground\(|\.liquidGlass\(|\.material\(\.glass|LiquidGlassView", "liquid-glass"),
    ("R10", "warn", r"\.glassBackgroundEffect\(", "liquid-glass"),
    ("R12", "warn", r"#available\(iOS [0-9]", "availability-gating"),
    ("R14", "hard", r"@ObservedObject[[:space:]]+var[[:space:]]+[A-Za-z_][A-Za-z0-9_]*[[:space:]]*=[[:space:]]*[A-Za-z_]", "state-observation"),
    ("R16", "warn", r"@Published", "state-observation"),
    ("R18", "warn", r"@EnvironmentObject", "state-observation"),
    ("R21", "warn", r"DispatchQueue\.main\.async", "concurrency-safety"),
    ("R24", "warn", r"Task\.detached[[:space:]]*\{", "concurrency-safety"),
    ("R27", "warn", r"NSStatusItem", "scenes-windows"),
    ("R33", "warn", r"showSettingsWindow:|Preferences[[:space:]]*\{", "scenes-windows"),
    ("R40", "warn", r"\.dropDestination\(for:[^)]+action:[^)]+isTargeted:", "api-currency"),
    ("R41", "warn", r"MagnificationGesture", "api-currency"),
    ("R42", "warn", r"RotationGesture", "api-currency"),
    ("R43", "warn", r"Font\.system\([^,)]+,[[:space:]]*design:[^,)]+\)", "api-currency"),
    ("R44", "warn", r"\.accentColor\(", "api-currency"),
    ("R53", "warn", r"Data\(contentsOf:|FileManager\.default", "sandbox-files"),
    ("R57", "warn", r"UIPasteboard", "sandbox-files"),
    ("R58", "warn", r"PreviewProvider", "previews"),
    # Our own, for domains without a rule above.
    ("A1", "adv", r"\.foregroundColor\(|\.accentColor\(", "appearance-color"),
    ("A2", "adv", r"\.repeatForever", "animation-motion"),
    ("A3", "adv", r"GeometryReader[[:space:]]*\{", "layout-and-tables"),
    ("A4", "adv", r"\.onAppear[[:space:]]*\{", "async-data"),
    ("A5", "adv", r"\.frame\(", "layout-and-tables"),
    ("A6", "adv", r"@State[[:space:]]", "state-observation"),
    ("A7", "warn", r"\.onTapGesture", "pointer-gestures"),
    ("A8", "adv", r"try![[:space:]]", "concurrency-safety"),
]
DOMAINS = sorted({r[3] for r in RULES} | {"charts", "accessibility"})
#: Seams (primary, sibling, verdict, token): which domain keeps a finding that both have.
SEAMS = [
    ("api-currency", "appearance-color", "demote", None), ("api-currency", "pointer-gestures", "demote", "Gesture"), ("state-observation", "previews", "keep-both", None),
    ("layout-and-tables", "scenes-windows", "demote", ".frame("), ("async-data", "concurrency-safety", "demote", "Task"),
]
#: Steering signals (domain, mode, pattern).
SIGNALS = [
    ("api-currency", "always", None), ("layout-and-tables", "always", None), ("state-observation", "cond", r"@(State|Binding|Observable|ObservedObject)\b"),
    ("charts", "cond", r"import[[:space:]]+Charts"), ("accessibility", "cond", r"accessibility"), ("navigation-toolbars", "cond", r"Navigation(Stack|SplitView|View)|toolbar"),
    ("liquid-glass", "cond", r"glassEffect"), ("concurrency-safety", "cond", r"(^|[^A-Za-z])(async|await|Task)([^A-Za-z]|$)"),
]
#: Files listed per domain; the order of the audit waves.
LISTED = 80
WAVES = [("api-currency", 1), ("state-observation", 1), ("concurrency-safety", 1), ("navigation-toolbars", 2), ("layout-and-tables", 2), ("scenes-windows", 2), ("appearance-color", 3), ("animation-motion", 3), ("charts", 3), ("accessibility", 4), ("previews", 4)]
#: Smells of an app that doesn't feel at home (rule, category, points a site).
SMELLS = [("A5", "density", 2), ("A7", "pointer", 3), ("A3", "grid", 4), ("A6", "shell", 5), ("A4", "menus", 6)]
#: Names that don't exist in the interface, and one that does, so that the report isn't empty.
INVENTED = [".glassBackground(", ".liquidGlass(", "LiquidGlassView", "VStack("]
#: Defects indexed per domain, in all and by severity.
DEFECTS = [
    ("accessibility", 12, 1, 8, 3), ("animation-motion", 11, 0, 6, 5), ("api-currency", 14, 2, 10, 2), ("appearance-color", 8, 1, 5, 2), ("appkit-interop", 10, 0, 9, 1), ("appkit-overuse", 7, 0, 4, 3),
    ("async-data", 10, 0, 7, 3), ("availability-gating", 8, 4, 3, 1), ("charts", 11, 1, 6, 4), ("concurrency-safety", 11, 0, 6, 5), ("controls-forms", 8, 1, 3, 4), ("document-model", 12, 3, 7, 2),
    ("drawing-canvas", 12, 1, 4, 7), ("layout-and-tables", 8, 1, 4, 3), ("liquid-glass", 18, 2, 10, 6), ("localization", 10, 0, 5, 5), ("macos-nativeness", 15, 0, 12, 3), ("menus-commands", 10, 1, 8, 1),
    ("navigation-toolbars", 12, 3, 6, 3), ("pointer-gestures", 12, 2, 7, 3), ("previews", 9, 2, 4, 3), ("sandbox-files", 9, 1, 6, 2), ("scenes-windows", 13, 2, 7, 4), ("state-observation", 12, 0, 7, 5),
    ("state-restoration", 11, 1, 8, 2), ("swiftdata", 12, 4, 6, 2), ("typography-text", 9, 1, 4, 4), ("view-performance", 12, 0, 5, 7),
]
ENTRY, CHROME = r"@main|:[[:space:]]*App([[:space:]]|\{)", r"Settings[[:space:]]*\{|MenuBarExtra|\.commands[[:space:]]*\{"
BRIDGE, UPDATES = r":[[:space:]]*NSViewRepresentable|:[[:space:]]*View([[:space:]]|\{)", r"func[[:space:]]+updateNSView|var[[:space:]]+body"
BEFORE, AFTER = r"@[A-Za-z]+", r"^[[:space:]]*(private )?(let|var|func)[[:space:]]"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("path like '%.swift' and text is not null").select("doc_id", "repo", "path", "text")


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = lint.match_lines(_texts(spark, sf_dir), ["doc_id", "repo"], "text", RULES)
    names = [F.array(*[F.lit(r[k]) for r in RULES])[F.col("rule")].alias(n) for k, n in ((0, "rule_id"), (1, "severity"), (3, "domain"))]
    return hits.select("doc_id", "repo", "line", *names, "snippet")


def lint_tier1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir).drop("repo")


def lint_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.tally(_findings(spark, sf_dir), ["repo"])


def lint_absence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that declare a view or bridge and nowhere the member that it needs."""
    return _texts(spark, sf_dir).where(lint.absent(F.col("text"), BRIDGE, UPDATES)).select("doc_id")


def lint_prev_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations whose attribute is on the line before."""
    return _texts(spark, sf_dir).select("doc_id", F.explode(lint.lines_after(F.col("text"), BEFORE, AFTER)).alias("line"))


def lint_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories with an app entry and no chrome anywhere: two flags, combined per repository before the shuffle."""
    from spandrel.functions.names import from_posix

    flags = _texts(spark, sf_dir).groupBy("repo").agg(F.bool_or(F.col("text").rlike(from_posix(ENTRY))).alias("entry"), F.bool_or(F.col("text").rlike(from_posix(CHROME))).alias("chrome"))
    return flags.where("entry and not chrome").select("repo")


def parse_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose braces or brackets don't add up: at most one finding a file."""
    counted = _texts(spark, sf_dir).select("doc_id", lint.balance(F.col("text")).alias("b"))
    return counted.where(lint.unbalanced("b")).select("doc_id", "b.open_brace", "b.close_brace", "b.open_paren", "b.close_paren")


def deprecated_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per file how often deprecated symbols are named, as whole words. The tokens are those of the shipped catalogue."""
    old = [r[0] for r in base.availability(spark, sf_dir).where("deprecated").select("sym").orderBy("sym").collect()]  # fixed size
    if not old:
        return _texts(spark, sf_dir).limit(0).select("doc_id", F.lit(0).alias("tokens"))
    words = F.split(F.col("text"), r"[^A-Za-z0-9_]+")
    n = F.size(F.filter(words, lambda w: w.isin(old)))
    return _texts(spark, sf_dir).where(F.col("text").rlike("|".join(old))).select("doc_id", n.alias("tokens")).where("tokens > 0")


def _ui(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).where(F.col("text").rlike(r"(?m)^\s*import\s+SwiftUI\b"))


def audit_steering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per domain the files that show its signal and the first of them; domains without any are skipped."""
    from spandrel.functions.names import from_posix

    shown = [F.when(F.lit(True) if m == "always" else F.col("text").rlike("(?m)" + from_posix(p)), F.lit(d)) for d, m, p in SIGNALS]
    hits = _ui(spark, sf_dir).select("path", "repo", F.explode(F.array_compact(F.array(*shown))).alias("domain"))
    counts = hits.groupBy("domain").agg(F.count(F.lit(1)).alias("file_count"))
    first = top_k(hits, ["domain"], [F.asc("path"), F.asc("repo")], LISTED).groupBy("domain").agg(F.min("path").alias("first_file"), F.count(F.lit(1)).alias("listed"))
    known = spark.createDataFrame([(d, m) for d, m, _ in SIGNALS], "domain string, mode string")
    out = known.join(counts, "domain", "left").join(first, "domain", "left")
    return out.select("domain", "mode", F.coalesce("file_count", F.lit(0)).alias("file_count"), F.coalesce("listed", F.lit(0)).alias("listed"), "first_file", F.col("file_count").isNotNull().alias("relevant"))


def gate_rollup(spark: SparkSession, sf_dir: str, strict: bool = True) -> DataFrame:
    """Findings per domain and in all (domain null), with the gate's verdict."""
    by = [F.count_if(F.col("severity") == s).alias(s) for s in lint.SEVERITIES]
    out = _findings(spark, sf_dir).rollup("domain").agg(*by)
    return out.withColumn("verdict", lint.gate_verdict(F.col("hard"), F.lit(strict)))


def finding_dedup_seam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with their status once seams between domains are resolved."""
    seams = spark.createDataFrame(SEAMS, "primary string, sibling string, verdict string, token string")
    return lint.resolve_seams(_findings(spark, sf_dir), seams, ["doc_id", "line"]).select("doc_id", "line", "domain", "rule_id", "status")


def nativeness_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and band per repository; a smell counts once per file, and repositories without any have 100."""
    smells = F.broadcast(spark.createDataFrame(SMELLS, "rule_id string, category string, points int"))
    sites = _findings(spark, sf_dir).select("repo", "doc_id", "rule_id").distinct().join(smells, "rule_id")
    scored = lint.capped_score(sites, ["repo"], "category", "points")
    every = _texts(spark, sf_dir).select("repo").distinct()
    return every.join(scored, "repo", "left").select("repo", F.coalesce("score", F.lit(100)).alias("score"), F.coalesce("band", F.lit(lint.BANDS[0][1])).alias("band"))


def severity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per domain, severity and in all the findings; a domain without any shows as not applicable."""
    rolled = _findings(spark, sf_dir).rollup("domain", "severity").agg(F.count(F.lit(1)).alias("findings"))
    known = spark.createDataFrame([(d,) for d in DOMAINS], "domain string")
    none = known.join(rolled.where("domain is not null").select("domain").distinct(), "domain", "left_anti")
    return rolled.withColumn("applies", F.lit(True)).unionByName(none.select("domain", F.lit(None).cast("string").alias("severity"), F.lit(0).cast("bigint").alias("findings"), F.lit(False).alias("applies")))


def wave_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevant domains in the order of their waves; waves without any drop out and the rest is numbered anew."""
    waves = spark.createDataFrame([(d, w, k) for k, (d, w) in enumerate(WAVES)], "domain string, wave int, place int")
    found = _findings(spark, sf_dir).select("domain").distinct()
    kept = waves.join(found, "domain")
    number = kept.select("wave").distinct()
    renumbered = top_k(number.withColumn("all", F.lit(1)), ["all"], [F.asc("wave")], len(WAVES), "number").select("wave", "number")
    return kept.join(renumbered, "wave").select("domain", "number", "place")


def master_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred open findings, worst first, then by domain."""
    worst = F.array_position(F.array(*map(F.lit, lint.SEVERITIES)), F.col("severity"))
    rows = _findings(spark, sf_dir).withColumn("worst", worst.cast("int"))
    return rows.orderBy("worst", "domain", "doc_id", "line", "rule_id").limit(100).select("worst", "domain", "doc_id", "line", "rule_id")


def sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result of the exchange format per finding, as JSON; lines start at 1."""
    rows = _findings(spark, sf_dir).join(_texts(spark, sf_dir).select("doc_id", "path"), "doc_id")
    place = F.array(F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.greatest("line", F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation")))
    result = F.struct(F.col("rule_id").alias("ruleId"), lint.sarif_level(F.col("severity")).alias("level"), F.struct(F.col("domain").alias("text")).alias("message"), place.alias("locations"))
    return rows.select("doc_id", "line", "rule_id", F.to_json(result).alias("result"))


def lint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON report per domain: counts by severity and whether it blocks."""
    by = [F.count_if(F.col("severity") == s).alias(s) for s in lint.SEVERITIES]
    counts = _findings(spark, sf_dir).groupBy("domain").agg(*by, F.count(F.lit(1)).alias("total"))
    return counts.select("domain", F.to_json(F.struct("domain", F.struct(*lint.SEVERITIES, "total").alias("counts"))).alias("report"))


def fix_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each rule's findings if all are to be fixed: only those that a machine can fix are."""
    rows = _findings(spark, sf_dir).groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("findings"))
    fix = F.when(F.col("severity") == "adv", "manual").otherwise("auto")
    return rows.select("rule_id", "findings", lint.next_status(F.lit("open"), F.lit("fixed"), fix).alias("status"))


def literal_rules(names: list[str]) -> list[tuple[str, str, str]]:
    """Rules for names that don't exist: literal, case-sensitive, always hard."""
    return [(n, "hard", "".join("\\" + x if not x.isalnum() else x for x in n)) for n in names]


def invented_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that name what doesn't exist."""
    hits = lint.match_lines(_texts(spark, sf_dir), ["doc_id"], "text", literal_rules(INVENTED))
    return hits.select("doc_id", "line", F.array(*map(F.lit, INVENTED))[F.col("rule")].alias("name"))


def with_tiers(findings: DataFrame, structural: DataFrame | None) -> DataFrame:
    """Findings of both tiers, or of the first alone where the second can't run; ``engine`` says which."""
    if structural is None:
        return findings.withColumn("tier", F.lit("grep1")).withColumn("engine", F.lit("tier 2 skipped"))
    both = findings.withColumn("tier", F.lit("grep1")).unionByName(structural.withColumn("tier", F.lit("structural")), allowMissingColumns=True)
    return both.withColumn("engine", F.lit("both tiers"))


def defect_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known defects per domain with the findings here; domains without findings show 0."""
    known = spark.createDataFrame(DEFECTS, "domain string, defects int, hard int, warn int, adv int")
    found = _findings(spark, sf_dir).groupBy("domain").agg(F.count(F.lit(1)).alias("findings"))
    return known.join(found, "domain", "left").select("domain", "defects", "hard", "warn", "adv", F.coalesce("findings", F.lit(0)).alias("findings"))


def floor_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols used in repositories that state an older floor than the symbol has: per repository and symbol the uses."""
    from spandrel.functions.names import version_number

    floors = base.examples(spark, sf_dir).where("min_macos is not null and repo is not null").groupBy("repo").agg(F.min(version_number("min_macos")).alias("floor"))
    newer = F.broadcast(base.availability(spark, sf_dir).where("introduced is not null").select("sym", "introduced"))
    uses = base.matched(spark, sf_dir).groupBy("repo", "sym").agg(F.count(F.lit(1)).alias("uses"))
    return uses.join(newer, "sym").join(floors, "repo").where("introduced > floor").select("repo", "sym", "floor", "introduced", "uses")


def gate_report(spark: SparkSession, sf_dir: str, strict: bool = False) -> DataFrame:
    """The gate's verdict and totals as one JSON document."""
    by = [F.count_if(F.col("severity") == s).alias(s) for s in lint.SEVERITIES]
    totals = _findings(spark, sf_dir).agg(*by, F.countDistinct("domain").alias("domains"))
    verdict = lint.gate_verdict(F.col("hard"), F.lit(strict))
    return totals.select(F.to_json(F.struct(F.lit(strict).alias("strict"), verdict.alias("gate"), F.struct(*lint.SEVERITIES).alias("totals"), "domains")).alias("report"))


def chosen_repos(repos: DataFrame, only: list[str], limit: int | None = None) -> DataFrame:
    """The named repositories (all if none is named) without regard to case, most stars first, at most ``limit``."""
    rows = repos.where(F.lower("repo").isin([n.lower() for n in only])) if only else repos
    rows = rows.orderBy(F.desc("stars"), "repo")
    return rows if limit is None else rows.limit(limit)


QUERIES = {
    f.__name__: f
    for f in (
        invented_names, defect_index, floor_violations, gate_report, lint_tier1, lint_tally, lint_absence, lint_prev_line, lint_project, parse_balance, deprecated_token_count, audit_steering, gate_rollup, finding_dedup_seam,
        nativeness_score, severity_rollup, wave_order, master_findings, sarif_results, lint_report, fix_transitions,
    )
}


def _q(text: str | None) -> str:
    return "null" if text is None else "'" + text.replace("'", "''") + "'"


_RULES = "(values " + ", ".join(f"({_q(i)}, {_q(s)}, {_q(p)}, {_q(d)})" for i, s, p, d in RULES) + ") r(rule_id, severity, pattern, domain)"
_T = "t as (select doc_id, repo, path, text from documents where path like '%.swift' and text is not null)"
_L = f"{_T}, l as (select doc_id, repo, path, unnest(ls) as raw, unnest(range(1, len(ls) + 1))::int as line from (select *, string_split(text, E'\\n') as ls from t))"
_MATCH = " union all ".join(f"select doc_id, repo, path, line, {_q(i)} as rule_id, {_q(s)} as severity, {_q(d)} as domain, raw from l where regexp_matches(rtrim(raw, E'\\r'), {_q(p)})" for i, s, p, d in RULES)
_FIND = f"with {_L}, h as ({_MATCH}), f as (select doc_id, repo, path, line, rule_id, severity, domain, regexp_replace(replace(rtrim(raw, E'\\r'), E'\\t', ' '), '^[ \\t\\x0B\\f\\r\\n]+', '') as snippet from h)"
_UI = r"u as (select * from t where regexp_matches(text, '(^|\n)[ \t\x0B\f\r\n]*import[ \t\x0B\f\r\n]+SwiftUI([^A-Za-z0-9_]|$)'))"
_STEER = " union all ".join(f"select '{d}' as domain, '{m}' as mode, path, repo from u" + ("" if m == "always" else f" where regexp_matches(text, {_q('(?m)' + p)})") for d, m, p in SIGNALS)
_BY = ", ".join(f"count(*) filter (severity = '{s}') as {s}" for s in lint.SEVERITIES)
SQL = {
    "invented_names": f"with {_L} " + " union all ".join(f"select doc_id, line, {_q(n)} as name from l where contains(raw, {_q(n)})" for n in INVENTED),
    "defect_index": f"""{_FIND}, k as (select * from (values {", ".join(str(d) for d in DEFECTS)}) k(domain, defects, hard, warn, adv)), c as (select domain, count(*) as findings from f group by domain)
        select k.*, coalesce(findings, 0) as findings from k left join c using (domain)""",
    "floor_violations": f"""with {base.USES_SQL}, {base.AVAIL_SQL}, {base.EXAMPLES_SQL},
        fl as (select repo, min({base.VERSION.format('min_macos')}) as floor from ex where min_macos is not null and repo is not null group by repo),
        u as (select repo, sym, count(*) as uses from matched group by repo, sym)
        select u.repo, u.sym, floor, introduced, uses from u join avail using (sym) join fl on fl.repo = u.repo where introduced > floor""",
    "gate_report": f"""{_FIND}, c as (select {_BY}, count(distinct domain) as domains from f)
        select to_json({{'strict': false, 'gate': case when hard > 0 then 'advisory' else 'pass' end, 'totals': {{'hard': hard, 'warn': warn, 'adv': adv}}, 'domains': domains}})::varchar as report from c""",
    "lint_tier1": f"{_FIND} select doc_id, line, rule_id, severity, domain, snippet from f",
    "lint_tally": f"{_FIND} select repo, {_BY}, count(*) as total, count(distinct rule_id) as rules_hit, (case when bool_or(severity = 'hard') then 2 else 0 end)::int as exit_class from f group by repo",
    "lint_absence": f"with {_T} select doc_id from t where regexp_matches(text, {_q(BRIDGE)}) and not regexp_matches(text, {_q(UPDATES)})",
    "lint_prev_line": f"""with {_L}, p as (select *, lag(raw) over (partition by doc_id order by line) as before from l)
        select doc_id, line from p where regexp_matches(rtrim(before, E'\\r'), {_q(BEFORE)}) and regexp_matches(rtrim(raw, E'\\r'), {_q(AFTER)})""",
    "lint_project": f"with {_T} select repo from t group by repo having bool_or(regexp_matches(text, {_q(ENTRY)})) and not bool_or(regexp_matches(text, {_q(CHROME)}))",
    "parse_balance": f"""with {_T}, c as (select doc_id, {", ".join(f"(length(text) - length(replace(text, '{m}', '')))::int as {n}" for m, n in (('{', 'open_brace'), ('}', 'close_brace'), ('(', 'open_paren'), (')', 'close_paren')))} from t)
        select * from c where open_brace <> close_brace or open_paren <> close_paren""",
    "deprecated_token_count": f"""with {_T}, {base.AVAIL_SQL}, w as (select doc_id, unnest(string_split_regex(text, '[^A-Za-z0-9_]+')) as w from t)
        select doc_id, count(*)::int as tokens from w where w in (select sym from avail where deprecated) group by doc_id""",
    "audit_steering": f"""with {_T}, {_UI}, s as ({_STEER}), r as (select *, row_number() over (partition by domain order by path, repo) as k from s),
        a as (select domain, count(*) as file_count, count(*) filter (k <= {LISTED}) as listed, min(path) as first_file from r group by domain)
        select m.domain, m.mode, coalesce(file_count, 0) as file_count, coalesce(listed, 0) as listed, first_file, file_count is not null as relevant
        from (values {", ".join(f"('{d}', '{m}')" for d, m, _ in SIGNALS)}) m(domain, mode) left join a on a.domain = m.domain""",
    "gate_rollup": f"{_FIND}, g as (select domain, {_BY} from f group by rollup (domain)) select *, case when hard > 0 then 'fail' else 'pass' end as verdict from g",
    "finding_dedup_seam": f"""{_FIND}, s as (select * from (values {", ".join(f"('{p}', '{b}', {_q(t)})" for p, b, v, t in SEAMS if v == 'demote')}) s(prime, sibling, token)),
        d as (select f.doc_id, f.line, f.domain, f.rule_id, min(p.rule_id) as by_rule from f join s on s.sibling = f.domain join f p on p.doc_id = f.doc_id and p.line = f.line and p.domain = s.prime
              where token is null or contains(f.snippet, token) group by all)
        select f.doc_id, f.line, f.domain, f.rule_id, case when by_rule is null then 'open' else 'duplicate-of ' || by_rule end as status from f left join d using (doc_id, line, domain, rule_id)""",
    "nativeness_score": f"""{_FIND}, k as (select distinct repo, doc_id, rule_id from f),
        c as (select repo, category, least(sum(points), {lint.CATEGORY_CAP}) as off_points from k join (values {", ".join(f"('{r}', '{c}', {n})" for r, c, n in SMELLS)}) s(rule_id, category, points) using (rule_id) group by all),
        p as (select repo, greatest(100 - sum(off_points), 0)::int as score from c group by repo),
        q as (select r.repo, coalesce(score, 100)::int as score from (select distinct repo from t) r left join p using (repo))
        select repo, score, case {" ".join(f"when score >= {n} then '{b}'" for n, b in lint.BANDS)} end as band from q""",
    "severity_rollup": f"""{_FIND}, g as (select domain, severity, count(*) as findings from f group by rollup (domain, severity))
        select *, true as applies from g union all select domain, null, 0, false from (values {", ".join(f"('{d}')" for d in DOMAINS)}) d(domain) where domain not in (select domain from f)""",
    "wave_order": f"""{_FIND}, w as (select * from (values {", ".join(f"('{d}', {w}, {k})" for k, (d, w) in enumerate(WAVES))}) w(domain, wave, place) where domain in (select domain from f))
        select domain, dense_rank() over (order by wave)::int as number, place from w""",
    "master_findings": f"""{_FIND} select case severity when 'hard' then 1 when 'warn' then 2 else 3 end as worst, domain, doc_id, line, rule_id from f order by worst, domain, doc_id, line, rule_id limit 100""",
    "sarif_results": f"""{_FIND} select doc_id, line, rule_id, to_json({{'ruleId': rule_id, 'level': case severity when 'hard' then 'error' when 'warn' then 'warning' else 'note' end, 'message': {{'text': domain}},
        'locations': [{{'physicalLocation': {{'artifactLocation': {{'uri': path}}, 'region': {{'startLine': greatest(line, 1)}}}}}}]}})::varchar as result from f""",
    "lint_report": f"""{_FIND}, c as (select domain, {_BY}, count(*) as total from f group by domain)
        select domain, to_json({{'domain': domain, 'counts': {{'hard': hard, 'warn': warn, 'adv': adv, 'total': total}}}})::varchar as report from c""",
    "fix_transitions": f"{_FIND} select rule_id, count(*) as findings, case when severity = 'adv' then 'open' else 'fixed' end as status from f group by rule_id, severity",
}
