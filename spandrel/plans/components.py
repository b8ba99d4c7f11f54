"""What the extractor finds in the sources: occurrences, components, bridges, settings screens, structure and spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.extract import facts as X
from spandrel.functions.names import base_name
from spandrel.operators.topk import top_k
from spandrel.plans import base
from spandrel.sources.tables import table

KEYS = ["doc_id", "repo", "path"]
#: Names of settings screens, what they are made of, and protocols that are counted.
SETTINGS = r"(?i)(setting|preference|config|general|advanced)"
FORM_VOCAB = [
    "Form", "TabView", "GroupBox", "Section", "LabeledContent", "Toggle", "Picker", "TextField", "SecureField", "Slider", "Stepper", "ColorPicker", "DatePicker",
    "Settings", "NavigationSplitView", "List", "Grid", "Table", "KeyboardShortcut", "Divider", "Spacer", "DisclosureGroup",
]
PROTOCOLS = ["View", "App", "Scene", "ViewModifier", "Shape", "Commands", "NSViewRepresentable", "ButtonStyle", "LabelStyle", "ObservableObject", "Identifiable", "Codable", "Hashable", "Equatable", "Sendable", "Layout", "Transferable"]
EXAMPLES = 25
#: Structural rules: a node, and what it must or mustn't have inside or around it.
STRUCTURAL = [
    {"id": "a11y-07", "severity": "warn", "node": "kind = 'call' and name = 'Chart'", "not_has": "kind = 'call' and name rlike '^accessibility(Label|ChartDescriptor)$'"},
    {"id": "anim-01", "severity": "warn", "node": "kind = 'call' and name = 'animation' and size(labels) = 1"},
    {"id": "ac-01", "severity": "warn", "node": "kind = 'call' and name = 'Color' and array_contains(labels, 'red') and array_contains(labels, 'green') and array_contains(labels, 'blue')"},
    {"id": "interop-01", "severity": "warn", "node": "kind = 'type' and detail like '%Representable%'", "has": "kind = 'func' and name rlike '^makeNSView'", "not_has": "kind = 'func' and name rlike '^updateNSView'"},
    {"id": "interop-04", "severity": "warn", "node": "kind = 'func' and name = 'makeNSView'", "has": "kind = 'call' and name rlike 'Controller$'"},
    {"id": "async-01", "severity": "warn", "node": "kind = 'call' and name = 'Task'", "inside": "kind = 'call' and name = 'onAppear'"},
    {"id": "async-07", "severity": "warn", "node": "kind = 'call' and name = 'AsyncImage' and labels = array('url')"},
    {"id": "gate-02", "severity": "hard", "node": "kind = 'if' and detail like '%iOS%'", "has": "kind = 'call' and name rlike '(?i)glass|mesh'"},
    {"id": "charts-02", "severity": "warn", "node": "kind = 'call' and name in ('Rectangle', 'RoundedRectangle', 'Capsule')", "inside": "kind = 'call' and name = 'ForEach'"},
    {"id": "conc-04", "severity": "warn", "node": "kind = 'call' and name = 'Task'", "inside": "kind = 'call' and name in ('onAppear', 'onChange')"},
    {"id": "cf-01", "severity": "warn", "node": "kind = 'call' and name = 'Form'", "not_inside": "kind = 'call' and name = 'formStyle'"},
    {"id": "draw-03", "severity": "warn", "node": "kind = 'call' and name = 'GeometryReader'", "has": "kind = 'call' and name in ('position', 'offset')"},
    {"id": "draw-05", "severity": "warn", "node": "kind = 'call' and name = 'MeshGradient'", "not_inside": "kind = 'if' and detail like '%available%'"},
    {"id": "lt-01", "severity": "warn", "node": "kind = 'call' and name in ('WindowGroup', 'Window')", "not_has": "kind = 'call' and name = 'frame' and (array_contains(labels, 'minWidth') or array_contains(labels, 'idealWidth'))"},
    {"id": "lt-04", "severity": "warn", "node": "kind = 'call' and name = 'Table' and not array_contains(labels, 'sortOrder')"},
    {"id": "glass-05", "severity": "warn", "node": "kind = 'call' and name = 'glassEffect'", "not_inside": "kind = 'call' and name = 'GlassEffectContainer'"},
    {"id": "nat-11", "severity": "warn", "node": "kind = 'call' and name in ('VStack', 'HStack', 'NavigationStack')", "inside": "kind = 'call' and name = 'WindowGroup'"},
    {"id": "menu-04", "severity": "warn", "node": "kind = 'call' and name = 'keyboardShortcut'", "not_inside": "kind = 'call' and name in ('commands', 'CommandMenu', 'CommandGroup')"},
    {"id": "nav-03", "severity": "warn", "node": "kind = 'call' and name = 'NavigationSplitView' and closures = 3", "has": "kind = 'call' and name = 'EmptyView'"},
    {"id": "sf-06", "severity": "warn", "node": "kind = 'call' and name like 'loadItem%'", "inside": "kind = 'call' and name = 'onDrop'"},
    {"id": "sw-07", "severity": "warn", "node": "kind = 'call' and name = 'SettingsLink'", "inside": "kind = 'call' and name = 'MenuBarExtra'"},
    {"id": "state-07", "severity": "adv", "node": "kind = 'var' and name <> 'body' and detail like '%some View%'"},
    {"id": "vperf-01", "severity": "warn", "node": "kind = 'var' and detail like '%some View%'", "has": "kind = 'call' and name rlike 'Formatter$'"},
    {"id": "prev-02", "severity": "hard", "node": "kind = 'macro' and name = 'Preview'", "has": "kind = 'var' and name rlike '^state'"},
    # Shapes that are frequent everywhere, for a sense of the code.
    {"id": "own-01", "severity": "adv", "node": "kind = 'call' and name in ('padding', 'frame', 'background')", "inside": "kind = 'call' and name in ('VStack', 'HStack', 'ZStack')"},
    {"id": "own-02", "severity": "adv", "node": "kind = 'type'", "not_has": "kind = 'call'"},
]


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("path like '%.swift'")
    return X.extract_facts(docs, KEYS, "text")


def extract_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences read out of the sources."""
    return X.exploded(_facts(spark, sf_dir), KEYS, "occurrences").select("doc_id", "sym", "kind", "line", "col", "end_line", "implicit", "args", "trailing_closure", "attach", "scope", "src")


def file_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per source file: what was read, and how much of it."""
    f = _facts(spark, sf_dir)
    return f.select("doc_id", "skipped", F.array_join("imports", ",").alias("imports"), "loc", *[F.size(c).alias(f"n_{c}") for c in ("occurrences", "decls", "nodes")])


def _decls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.exploded(_facts(spark, sf_dir), KEYS, "decls")


def custom_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components and view builders by kind, repository and name."""
    return _decls(spark, sf_dir).select("kind", "repo", "name", "doc_id", "line", F.array_join("conforms", ",").alias("conforms")).orderBy("kind", "repo", "name", "doc_id", "line")


def component_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations per kind; members are view builders, all others true components."""
    return _decls(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("decls"), F.countDistinct("repo").alias("repos"), F.count_if(F.col("kind") == "viewbuilder").alias("members"))


def conformance_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per known protocol: declarations, repositories and the first 25 of them in order of arrival."""
    rows = _decls(spark, sf_dir).select("repo", "doc_id", "line", "name", F.explode("conforms").alias("c")).withColumn("protocol", base_name("c")).where(F.col("protocol").isin(PROTOCOLS))
    counts = rows.groupBy("protocol", "repo").agg(F.count(F.lit(1)).alias("n")).groupBy("protocol").agg(F.sum("n").alias("decls"), F.count("repo").alias("repo_count"))
    first = top_k(rows, ["protocol"], [F.asc("repo"), F.asc("doc_id"), F.asc("line"), F.asc("name")], EXAMPLES)
    listed = first.groupBy("protocol").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]), ",").alias("examples"))
    return counts.join(listed, "protocol")


def bridge_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bridges to the older interface classes per kind they conform to."""
    rows = _decls(spark, sf_dir).where("kind = 'bridge'").select("repo", "name", F.explode("conforms").alias("conforms"))
    return rows.groupBy("conforms").agg(F.count(F.lit(1)).alias("bridges"), F.countDistinct("repo").alias("repos"))


def settings_screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views named like settings with the form vocabulary used in the type of that name, richest first."""
    f = _facts(spark, sf_dir)
    screens = X.exploded(f, KEYS, "decls").where(F.col("kind").isin("view", "viewbuilder") & F.col("name").rlike(SETTINGS)).select("repo", "doc_id", "line", "name")
    words = X.exploded(f, KEYS, "occurrences").where(F.col("sym").isin(FORM_VOCAB) & F.col("scope").isNotNull()).select("repo", F.col("scope").alias("name"), "sym").distinct()
    vocab = words.groupBy("repo", "name").agg(F.array_sort(F.collect_list("sym")).alias("vocab"))
    out = screens.join(vocab, ["repo", "name"], "left").withColumn("vocab", F.coalesce("vocab", F.array().cast("array<string>")))
    return out.select("repo", "doc_id", "line", "name", F.array_join("vocab", ",").alias("vocab"), F.size("vocab").alias("richness")).orderBy(F.desc("richness"), "repo", "doc_id", "line", "name")


def form_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each word of the form vocabulary is in a settings screen."""
    words = settings_screens(spark, sf_dir).where("vocab <> ''").select(F.explode(F.split("vocab", ",")).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("screens"))


def structural_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the structural rules, and chained calls of one kind."""
    from spandrel.session import materialize

    nodes = materialize(X.exploded(_facts(spark, sf_dir), KEYS, "nodes").drop("repo", "path"), "nodes")
    out = None
    for rule in STRUCTURAL:
        found = X.structural(nodes, ["doc_id"], rule)
        out = found if out is None else out.unionByName(found)
    for rule, names in (("glass-04", "glassEffect"), ("pg-11", "gesture"), ("own-03", "padding")):
        out = out.unionByName(X.chained(nodes, ["doc_id"], f"name = '{names}'").select("doc_id", "ord", F.lit(rule).alias("rule_id"), F.lit("warn").alias("severity"), F.col("start_line").alias("line")))
    return out.select("doc_id", "rule_id", "severity", "line", "ord")


def enclosing_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines to show around each extracted type construction, in the four modes."""
    f = _facts(spark, sf_dir)
    anchors = X.exploded(f, KEYS, "occurrences").where("kind = 'type'").select("doc_id", "line").distinct()
    found = X.enclosing_spans(anchors, X.exploded(f, KEYS, "nodes"), ["doc_id"]).join(f.select("doc_id", F.col("loc").alias("count")), "doc_id")
    modes = [X.span_policy(m, F.col("line"), F.col("count")).alias(m) for m in ("smart", "decl", "chain", "full")]
    out = found.select("doc_id", "line", *modes)
    return out.select("doc_id", "line", *[F.concat_ws("-", F.col(f"{m}.a").cast("string"), F.col(f"{m}.b").cast("string")).alias(m) for m in ("smart", "decl", "chain", "full")])


def line_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight lines around the first use of each symbol in each file, with their numbers."""
    first = base.occurrences(spark, sf_dir, "doc_id", "line").groupBy("doc_id", "sym").agg(F.min("line").alias("line"))
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    return first.join(docs, "doc_id").select("doc_id", "sym", "line", X.line_slice(F.col("text"), F.col("line") - X.NEAR, F.col("line") + X.NEAR).alias("slice"))


def heading_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of Markdown files per heading they stand under; lines before any heading are Uncategorized."""
    from spandrel.sources.markdown import lines_under_headings

    docs = table(spark, sf_dir, "documents").where("path like '%.md' and text is not null")
    return lines_under_headings(docs, ["doc_id"], "text").where("btrim(line_text) <> ''").groupBy("doc_id", "heading").agg(F.count(F.lit(1)).alias("lines"), F.min("line").alias("first_line"))


QUERIES = {
    f.__name__: f
    for f in (extract_facts, file_summary, custom_components, component_kinds, conformance_topk, bridge_inventory, settings_screens, form_vocab, structural_findings, enclosing_span, line_slices, heading_context)
}
SQL = {
    "line_slices": f"""with {base.OCC_SQL}, f as (select doc_id, sym, min(line) as line from occ group by all),
        s as (select f.doc_id, sym, line, string_split(text, E'\\n') as ls from f join documents d on d.doc_id = f.doc_id where text is not null),
        b as (select *, greatest(1, line - {X.NEAR}) as a, least(len(ls), line + {X.NEAR}) as z from s)
        select doc_id, sym, line, case when a <= z then array_to_string(list_transform(range(a, z + 1), lambda k: k || E'\\t' || ls[k]), E'\\n') else '' end as slice from b""",
    "heading_context": r"""with t as (select doc_id, string_split(text, E'\n') as ls from documents where path like '%.md' and text is not null),
        l as (select doc_id, rtrim(unnest(ls), E'\r') as line_text, unnest(range(1, len(ls) + 1))::int as line from t),
        h as (select *, case when regexp_matches(line_text, '^#{1,4}[ \t]+') then trim(regexp_replace(regexp_replace(line_text, '^#{1,4}[ \t]+', ''), '[ \t]*#*[ \t]*$', ''), E' \t') end as own from l),
        c as (select *, coalesce(last_value(own ignore nulls) over (partition by doc_id order by line), 'Uncategorized') as heading from h)
        select doc_id, heading, count(*) as lines, min(line) as first_line from c where own is null and trim(line_text) <> '' group by doc_id, heading""",
}
