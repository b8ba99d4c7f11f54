"""The extractor on a sample of our own, spans, structure, headings and slices."""

from pyspark.sql import functions as F

from spandrel.extract import facts as X
from spandrel.extract import swift
from spandrel.sources.markdown import lines_under_headings, links_under_headings

SAMPLE = '''import SwiftUI
import struct Foundation.URL

@Observable
final class Store { var items: [Int] = [] }

struct SettingsView: View {
    @State private var a = 1, b: Int = 2
    @State var c: String?
    @AppStorage("key") var stored = false
    @Environment(\\.dismiss) private var dismiss
    var body: some View {
        VStack(spacing: 4) {
            Text("n \\(store.count(of: 3))").font(.system(size: 12)).padding()
            List<Item>()
            if a.isEmpty { Color.red }
        }
        .environment(\\.locale, .init(x: 1))
        .padding(2)
        .onAppear { Task { await load() } }
    }
    @ViewBuilder func row(_ x: Int = 3) -> some View { Button(action: {}, label: { Text(x) }) }
}
struct GraphView: NSViewRepresentable, Sendable { func makeNSView(c: Context) -> NSView { NSView() } }
extension Foo.Bar<Int>: ButtonStyle {}
#Preview { SettingsView() }
'''


def test_sample():
    f = swift.read(SAMPLE)

    def has(kind, sym, **more):
        return any(o["kind"] == kind and o["sym"] == sym and all(o[k] == v for k, v in more.items()) for o in f.occurrences)

    def decl(kind, name, **more):
        return any(d["kind"] == kind and d["name"] == name and all(d[k] == v for k, v in more.items()) for d in f.decls)

    assert f.imports == {"SwiftUI", "Foundation"}
    assert has("attribute", "ViewBuilder", attach="func") and has("attribute", "Observable", attach="class")
    assert sum(o["kind"] == "attribute" and o["sym"] == "State" for o in f.occurrences) == 3
    assert has("attribute", "AppStorage", args=['"key"']) and has("keypath", "dismiss") and has("keypath", "locale")
    assert has("type", "List") and has("modifier", "system", implicit=True, scope="SettingsView", args=["size"])
    assert has("modifier", "count", implicit=False, line=14) and has("member", "red", implicit=False) and has("macro", "Preview")
    assert has("type", "VStack", trailing_closure=True, args=["spacing"], src="VStack(spacing: 4)")
    assert decl("bridge", "GraphView") and decl("view", "SettingsView", wrappers=["AppStorage", "Environment", "State"])
    assert decl("viewbuilder", "body", scope="SettingsView") and decl("viewbuilder", "row") and decl("style", "Bar", via="extension")
    assert not has("modifier", "init") and not has("type", "View")


def test_odd_texts():
    for text in ("", "\x00", "}}}", "((((", '"' * 7, "struct", "var", "@", "#", "\\.", "let (a, b) = f(", "/*" * 50, "func f<T>(" * 20, "a.b" * 5000, "class func x() {}"):
        swift.read(text)


def test_facts_spans_and_structure(spark):
    df = spark.createDataFrame([(1, SAMPLE), (2, None), (3, "")], "doc_id int, text string")
    facts = X.extract_facts(df, ["doc_id"], "text")
    assert {(r.doc_id, r.skipped) for r in facts.select("doc_id", "skipped").collect()} == {(1, None), (2, "unreadable"), (3, None)}
    nodes = X.exploded(facts, ["doc_id"], "nodes")
    anchors = spark.createDataFrame([(1, 15), (3, 1)], "doc_id int, line int")
    spans = X.enclosing_spans(anchors, nodes, ["doc_id"])
    modes = [X.span_policy(m, F.col("line"), F.lit(27)).alias(m) for m in ("smart", "decl", "chain", "full")]
    got = {r.doc_id: tuple((r[m].a, r[m].b) for m in ("smart", "decl", "chain", "full")) for r in spans.select("doc_id", *modes).collect()}
    assert got[1] == ((12, 21), (12, 21), (13, 20), (1, 27)) and got[3] == ((1, 27), (1, 9), (1, 9), (1, 27))
    task = X.structural(nodes, ["doc_id"], {"id": "x", "severity": "warn", "node": "kind = 'call' and name = 'Task'", "inside": "kind = 'call' and name = 'onAppear'"})
    assert [(r.line, r.rule_id) for r in task.collect()] == [(20, "x")]
    lone = X.structural(nodes, ["doc_id"], {"id": "y", "severity": "warn", "node": "kind = 'type'", "has": "kind = 'func' and name = 'makeNSView'", "not_has": "name = 'updateNSView'"})
    assert [r.line for r in lone.collect()] == [24]
    assert X.structural(nodes, ["doc_id"], {"id": "z", "severity": "warn", "node": "kind = 'call' and name = 'Text'", "not_inside": "name = 'VStack' or name = 'Button'"}).count() == 0
    assert [r.name for r in X.chained(nodes, ["doc_id"], "name in ('padding', 'environment')").collect()] == ["padding"]


def test_slice_and_headings(spark):
    df = spark.createDataFrame([(1, "a\nb\nc"), (2, "")], "id int, text string")
    assert [r.x for r in df.orderBy("id").select(X.line_slice(F.col("text"), F.lit(-2), F.lit(2)).alias("x")).collect()] == ["1\ta\n2\tb", "1\t"]
    assert df.where("id = 1").select(X.line_slice(F.col("text"), F.lit(5), F.lit(9)).alias("x")).first().x == ""
    md = "x\n# Top\n- https://h.org/o/r.git)\n## Sub ##\nsee https://h.org/p/q#a and https://h.org/s/t?x=1.\n##### deep\ny"
    docs = spark.createDataFrame([(1, md)], "id int, text string")
    assert [(r.line, r.heading) for r in lines_under_headings(docs, ["id"], "text").orderBy("line").collect()] == [(1, "Uncategorized"), (3, "Top"), (5, "Sub"), (6, "Sub"), (7, "Sub")]
    assert {(r.owner, r.repo, r.category) for r in links_under_headings(docs, ["id"], "text").collect()} == {("o", "r", "Top"), ("p", "q", "Sub"), ("s", "t", "Sub")}
