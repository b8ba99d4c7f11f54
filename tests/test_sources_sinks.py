"""Files, framed logs, delimited tables, landed sources, and what is written."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spandrel.sinks import writers
from spandrel.sources import files, landed


def test_scan_files(spark, tmp_path):
    for name, text in {"a/x.swift": "let a = 1", "a/Pods/y.swift": "x", "a/xTests.swift": "x", "b.txt": "x", "big.swift": "x" * 2_000_001}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    (tmp_path / "bad.swift").write_bytes(b"\xff\xfe\xff")
    got = {r.path: (r.text, r.skipped) for r in files.scan_files(spark, str(tmp_path)).collect()}
    assert got == {"a/x.swift": ("let a = 1", None), "big.swift": (None, "too large"), "bad.swift": (None, "unreadable")}


def test_framed(spark, tmp_path):
    (tmp_path / "one.jsonl").write_text('{"type":"repo","full_name":"a/b"}\n{"path":"x","loc":3}\nnot json\n{"type":"done","files":1}\n')
    (tmp_path / "two.jsonl").write_text('{"type":"repo","full_name":"c/d"}\n{"path":"y","loc":4}\n\n')
    (tmp_path / "empty.jsonl").write_text("")
    ddl = T.StructType.fromDDL
    heads, bodies, tails, bad = files.read_framed(spark, str(tmp_path), ddl("full_name string"), ddl("path string, loc int"), ddl("files int"))
    assert {r.full_name for r in heads.collect()} == {"a/b", "c/d"} and bodies.count() == 2 and [r.value for r in bad.collect()] == ["not json"]
    assert [r.full_name for r in files.completed(heads, tails).collect()] == ["a/b"]


def test_delimited_and_graph(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("# c\na\tb\t c\nshort\n\nd\te\tf\tg\n")
    rows = files.read_delimited(spark, str(tmp_path / "t.tsv"), ["x", "y", "z"])
    assert [tuple(r) for r in rows.collect()] == [("a", "b", "c"), ("d", "e", "f\tg")]
    (tmp_path / "p.txt").write_text("api|new|er\n")
    assert [tuple(r) for r in files.read_delimited(spark, str(tmp_path / "p.txt"), ["api", "by"], "|").collect()] == [("api", "new|er")]
    graph = {"symbols": [{"names": {"title": "a(b:)"}, "availability": [{"domain": "iOS"}, {"domain": "macOS", "introduced": {"major": 11, "minor": 3}, "renamed": "z"}, {"domain": "macOS", "introduced": {"major": 9}}]}, {"names": {"title": "n"}}]}
    (tmp_path / "g.json").write_text(json.dumps(graph))
    assert {tuple(r) for r in files.read_symbol_graph(spark, str(tmp_path / "g.json")).collect()} == {("a", "11.3", False, "z"), ("n", None, False, None)}


def test_settings():
    assert files.front_matter(["x", "---\nstrict: true\n---\n"], "strict") == "true"
    assert files.front_matter([""], "strict", "no") == "no"
    assert files.catalog_folder(None, "b", ["c"], {"c/index"}.__contains__) == "c"
    with pytest.raises(LookupError):
        files.catalog_folder(None, None, [], lambda p: False)
    yaml = pytest.importorskip("yaml")
    assert yaml and [r["severity"] for r in files.read_rules(["id: a\nrule: {}\n---\nid: b\nseverity: hard\nrule: {}\n"])] == ["warning", "hard"]
    with pytest.raises(ValueError):
        files.read_rules(["id: a\nseverity: odd\nrule: {}\n"])


def test_landed(spark, tmp_path):
    def fetch(keys):
        if "bad" in keys and len(keys) == 1:
            raise OSError("down")
        return {k: (k != "gone", f"body of {k}", 404 if k == "gone" else 200) for k in keys if k != "bad"}

    keys = spark.createDataFrame([("a",), ("b",), ("gone",), ("bad",), ("a",), (None,)], "k string").coalesce(1)
    got = {r.key: (r.ok, r.status, r.tries) for r in landed.fetch_all(spark, keys, "k", fetch, tries=2, wait=0.0).collect()}
    assert got == {"a": (True, 200, 1), "b": (True, 200, 1), "gone": (False, 404, 1), "bad": (False, 0, 2)}
    cache = str(tmp_path / "cache")
    some = spark.createDataFrame([("a",)], "k string")
    assert [r.body for r in landed.land(spark, some, "k", fetch, cache).collect()] == ["body of a"]
    assert landed.land(spark, some, "k", fetch, cache).count() == 1
    hits = landed.search_terms(spark, ["t", "u"], lambda t: ["x/y", "x/y", f"{t}/z"], 3)
    assert {tuple(r) for r in hits.collect()} == {("t", "x/y", 2), ("t", "t/z", 1), ("u", "x/y", 2), ("u", "u/z", 1)}
    texts = spark.createDataFrame([("o/r", "s", "p.swift", "code")], "repo string, sha string, path string, text string")
    links = spark.createDataFrame([("https://h.org/o/r/blob/s/p.swift#L2",), ("junk",)], "link string")
    assert {(r.text, r.anchor) for r in landed.source_spans(texts, links, "link").collect()} == {("code", 2), (None, None)}
    assert spark.range(1).select(landed.page_key(F.lit("@Color.red(x)")).alias("x")).first().x == "color/red"


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    log = str(tmp_path / "log")
    writers.append_log(rows, log, "k")
    writers.append_log(rows.union(spark.createDataFrame([("c", 3)], "k string, v int")), log, "k")
    assert spark.read.schema("k string, v int").json(log).count() == 3
    out = str(tmp_path / "by")
    writers.write_by(rows, out, "k")
    writers.write_by(spark.createDataFrame([("a", 9)], "k string, v int"), out, "k")
    assert {(r.k, r.v) for r in spark.read.parquet(out).collect()} == {("a", 9), ("b", 2)}
    lines = writers.framed(spark.createDataFrame([("a",)], "k string"), rows, "k").orderBy("k", "o", "s").collect()
    assert [json.loads(r.value).get("type") for r in lines if r.k == "a"] == ["repo", None, "done"]
    writers.write_framed(writers.framed(rows.select("k"), rows, "k"), str(tmp_path / "framed"), "k")
    assert spark.read.text(str(tmp_path / "framed")).count() == 6
    assert json.loads(writers.write_document(rows, "k"))["b"] == {"k": "b", "v": 2}
    with pytest.raises(ValueError):
        writers.write_document(rows, "k", 1)
    found = spark.createDataFrame([("R1", "hard", "m", "f", 0)], "rule_id string, severity string, message string, path string, line int")
    doc = json.loads(writers.sarif(found, "t"))
    assert doc["runs"][0]["results"][0]["level"] == "error" and doc["runs"][0]["results"][0]["locations"][0]["physicalLocation"]["region"] == {"startLine": 1}
    assert "## Severity" in writers.dashboard(rows, rows, rows, rows)
