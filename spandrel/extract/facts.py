"""Facts of all files of a table, and spans of their node table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spandrel.extract.swift import FILE_BYTES, read

OCCURRENCE = "sym string, kind string, line int, col int, end_line int, implicit boolean, args array<string>, trailing_closure boolean, attach string, prop struct<name:string,type:string,init_text:string>, scope string, src string"
DECL = "name string, kind string, conforms array<string>, line int, attributes array<string>, wrappers array<string>, scope string, via string"
NODE = "kind string, name string, start int, `end` int, start_line int, end_line int, labels array<string>, closures int, parent_type string, detail string"


def _struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def extract_facts(files: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, skipped, imports, loc, occurrences, decls, nodes): one row per file, from its whole text.

    A null text is skipped as unreadable, one of more than FILE_BYTES bytes as too large, as the reading program states
    it; both have no facts. imports are distinct and sorted. Repeated rows come out as often as they come.
    """
    rows = files.select(*keys, F.col(text).alias("__text"), F.octet_length(text).alias("__size"))
    schema = T.StructType([*[rows.schema[k] for k in keys], *_struct(f"skipped string, imports array<string>, loc int, occurrences array<struct<{_nested(OCCURRENCE)}>>, decls array<struct<{_nested(DECL)}>>, nodes array<struct<{_nested(NODE)}>>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for b in batches:
            if not b.num_rows:
                continue
            out: list[tuple] = []
            for t, n in zip(b.column(len(keys)).to_pylist(), b.column(len(keys) + 1).to_pylist()):
                if t is None or n > FILE_BYTES:
                    out.append(("unreadable" if t is None else "too large", [], 0, [], [], []))
                else:
                    f = read(t)
                    out.append((None, sorted(f.imports), t.count("\n") + (not t.endswith("\n")) if t else 0, f.occurrences, f.decls, f.nodes))
            columns = [*b.columns[: len(keys)], *[pa.array(c, x.type) for c, x in zip(zip(*out), list(arrow)[len(keys) :])]]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return rows.mapInArrow(run, schema)


def _nested(ddl: str) -> str:
    return ",".join(f"{f.simpleString()}" for f in _struct(ddl).fields)


def exploded(facts: DataFrame, keys: list[str], what: str) -> DataFrame:
    """One row per occurrence, decl or node, with ``ord``, its place in the file's list."""
    return facts.select(*keys, F.posexplode(what).alias("ord", "__x")).select(*keys, "ord", "__x.*")


def enclosing_spans(anchors: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Per anchor (keys, line): the smallest declaration and statement and the widest call around its line, as structs.

    anchors and nodes are joined on the file and the containment of lines, an equi-join with a range on top; a file's
    nodes are bounded by its size.
    """
    pairs = anchors.join(nodes.select(*keys, "kind", "start_line", "end_line"), keys, "left").where(F.col("kind").isNull() | ((F.col("start_line") <= F.col("line")) & (F.col("line") <= F.col("end_line"))))
    size = F.col("end_line") - F.col("start_line")
    place = F.struct(size.alias("size"), "start_line", "end_line")

    def least(*kinds: str) -> Column:
        return F.min(F.when(F.col("kind").isin(*kinds), place))

    widest = F.min(F.when(F.col("kind") == "call", F.struct((-size).alias("size"), "start_line", "end_line")))
    found = pairs.groupBy(*keys, "line").agg(least("var", "func").alias("decl"), least("var", "if", "guard", "call", "macro").alias("stmt"), widest.alias("chain"))
    return anchors.join(found, [*keys, "line"], "left")


#: Longest smart span, and the windows around an anchor where nothing fits.
SMART, AROUND, NEAR = 80, (15, 45), 8


def span_policy(mode: str, line: Column, count: Column) -> Column:
    """struct<a, b int> of lines to show. Columns decl, stmt, chain as in enclosing_spans; always contains the anchor.

    full: all; decl, chain: that span, else 8 lines around; smart: the declaration if it has at most 80 lines, else the
    smaller of statement and chain that has, else 15 lines before to 45 after.
    """

    def span(a: Column, b: Column) -> Column:
        return F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))

    def of(name: str) -> Column:
        return F.when(F.col(name).isNotNull(), span(F.col(f"{name}.start_line"), F.col(f"{name}.end_line")))

    def fits(name: str) -> Column:
        return F.col(f"{name}.end_line") - F.col(f"{name}.start_line") <= SMART

    near = span(F.greatest(F.lit(1), line - NEAR), F.least(count, line + NEAR))
    if mode == "full":
        return span(F.lit(1), count)
    if mode in ("decl", "chain"):
        return F.coalesce(of(mode), near)
    stmt, chain = (F.when(fits(n), F.struct((F.col(f"{n}.end_line") - F.col(f"{n}.start_line")).alias("n"), F.col(f"{n}.start_line").alias("a"), F.col(f"{n}.end_line").alias("b"))) for n in ("stmt", "chain"))
    small = F.least(stmt, chain)
    return F.coalesce(F.when(fits("decl"), of("decl")), F.when(small.isNotNull(), span(small["a"], small["b"])), span(F.greatest(F.lit(1), line - AROUND[0]), F.least(count, line + AROUND[1])))


def line_slice(text: Column, a: Column, b: Column) -> Column:
    """Lines a to b, each with its number and a tab before it; bounds are cut to the text, an empty range gives ''."""
    ls = F.split(text, "\n")
    first, last = F.greatest(F.lit(1), a), F.least(F.size(ls), b)
    picked = F.transform(F.slice(ls, first, last - first + 1), lambda x, k: F.concat((k + first).cast("string"), F.lit("\t"), x))
    return F.when(first <= last, F.array_join(picked, "\n")).otherwise("")


# ---- Structural rules over the node table


def contains(outer: DataFrame, inner: DataFrame, keys: list[str], how: str, which: str) -> DataFrame:
    """Rows of ``which`` (outer: has a descendant; inner: is inside) by interval containment within a file; left_semi or left_anti."""
    o, i = (outer, inner) if which == "outer" else (inner, outer)
    other = i.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("start").alias("__s"), F.col("end").alias("__e"), F.col("ord").alias("__o"))
    same = [F.col(k) == F.col(f"__{k}") for k in keys]
    inside = (F.col("start") <= F.col("__s")) & (F.col("__e") <= F.col("end")) if which == "outer" else (F.col("__s") <= F.col("start")) & (F.col("end") <= F.col("__e"))
    return o.join(other, [*same, inside, F.col("ord") != F.col("__o")], how)


def structural(nodes: DataFrame, keys: list[str], rule: dict) -> DataFrame:
    """(keys, ord, rule_id, severity, line): nodes for which a rule holds.

    rule: id, severity, node (a predicate in SQL over node columns), and any of has, not_has, inside, not_inside (predicates
    of the other node). All hold at any depth; ``any`` is an or in a predicate, ``all`` several rules' intersection.
    """
    out = nodes.where(rule["node"])
    for op, how, which in (("has", "left_semi", "outer"), ("not_has", "left_anti", "outer"), ("inside", "left_semi", "inner"), ("not_inside", "left_anti", "inner")):
        if op in rule:
            other = nodes.where(rule[op])
            out = contains(out, other, keys, how, which) if which == "outer" else contains(other, out, keys, how, which)
    return out.select(*keys, "ord", F.lit(rule["id"]).alias("rule_id"), F.lit(rule["severity"]).alias("severity"), F.col("start_line").alias("line"))


def chained(nodes: DataFrame, keys: list[str], predicate: str) -> DataFrame:
    """Calls that satisfy a predicate and continue a chain with such a call in it: both begin at the same place."""
    calls = nodes.where("kind = 'call'").where(predicate)
    return calls.withColumn("__n", F.row_number().over(W.partitionBy(*keys, "start").orderBy("end"))).where("__n > 1").drop("__n")
