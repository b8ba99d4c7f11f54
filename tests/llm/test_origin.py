"""Origins of files: marks alone, names beside them, and the whole operator on a small corpus."""

import random

import numpy as np

from spandrel.llm import naming, origin

LENT = "// Blue - part of Green\n" + "\n".join(f"func f{k}() {{ return {k} }}" for k in range(30))


def test_declarations():
    cases = {
        ("A.swift", "// Code generated by x. DO NOT EDIT.\nlet a = 1\n"): True,
        ("A.swift", "// Automatisch erzeugt mit x. Nicht von Hand bearbeiten.\nlet a = 1\n"): True,
        ("A.swift", "// Shows the generated report\nlet a = \"Do not edit\"\n"): False,
        ("A.swift", "let a = 1\n// Code generated by x. DO NOT EDIT.\n"): False,
        ("a.py", "#!/usr/bin/env python\n# This file is generated by y.\n"): True,
        ("a.md", ""): False,
    }
    for (path, text), want in cases.items():
        assert origin.says_tool(text, origin.extension_of(path)) == want, text
    paths = {"gen/A.pb.swift": "tool", "Pods/x/A.swift": "third_party", "Features/Vendors/A.swift": None, "a/b.min.js": "minified", "x_pb2.py": "tool", "": None, "Features/Dependencies/A.swift": None, "Dependencies/Kit/A.swift": "third_party"}
    for path, want in paths.items():
        assert origin.by_path(path) == want, path


def test_data_share():
    table = "let t = [\n" + "    0x01, 0x02, 0x03, 0x04, 0x05, 0x06, 0x07, 0x08,\n" * 40 + "]\n"
    share, chars = origin.data_share(table)
    assert share > 0.9 and chars > 1000
    assert origin.data_share("let x = 1;\nconst t = [\n  1, 2, 3,\n];\n" + "call(x);\n" * 50)[1] < 100
    assert origin.data_share('let s = "' + "QUJD" * 300 + '"\n')[1] == 1200
    assert origin.data_share("")[0] == 0.0 and origin.data_share("\x00\x01\x02" * 10)[0] == 1.0


def test_copies():
    index = origin.Upstream([LENT, "", "one two"])
    assert index.copied(LENT) == 1.0
    assert index.copied(LENT.replace("f7()", "g()")) > 0.8
    assert index.copied(LENT[:200] + "\nlet own = 2\n" * 60) < 0.5
    assert index.copied("") == 0.0 and origin.Upstream([]).copied(LENT) == 0.0


def test_trigrams_and_model():
    grams, owner = naming.trigrams(["ab", "c"])
    assert [(g >> 12, (g >> 6) & 63, g & 63) for g in grams.tolist()] == [(0, 0, 1), (0, 1, 2), (1, 2, 0), (0, 0, 3), (0, 3, 0)]
    assert owner.tolist() == [0, 0, 0, 1, 1]
    codes, counts = np.unique(naming.trigrams(["counter", "content", "container"] * 50)[0], return_counts=True)
    bits = naming.model(codes, counts)
    assert abs((2.0 ** -bits.reshape(64, 64, 64)).sum(2) - 1).max() < 1e-3  # a distribution per context
    assert naming.cross_entropy(["contain"], bits) < naming.cross_entropy(["xq"], bits)
    assert naming.cross_entropy([], bits) == 0.0


def test_names():
    assert set(naming.names_of('let a1 = "b c" // d\n/* e', "swift")) == {"let", "a1"}
    assert naming.shapes(["x1", "x22", "y"]) == 2 and naming.shapes([]) == 0
    assert naming.styles(["ab", "abc", "abCd", "AbCd", "a_bc", "ABC"]) == [1, 1, 1, 1, 1, 1, 0]


def test_corpus(spark):
    random.seed(3)
    words = ["count", "value", "window", "button", "title", "layer", "model", "screen", "update", "render"]

    def hand(k: int) -> str:
        return "\n".join(f"function {random.choice(words)}{random.choice(words).title()}({random.choice(words)}) {{ return {random.choice(words)}.{random.choice(words)}; }}" for _ in range(30))

    squeezed = "!function(a,b){" + "var zq=xk(7),jv={};function wz(qx){return qx.vj?qx[1]:zk}" * 20 + "}();"
    rows = [(k, f"src/f{k}.js", hand(k)) for k in range(40)]
    rows += [(100, "src/a.js", squeezed), (101, "lib/x_pb2.py", "a = 1"), (102, "src/b.swift", LENT), (103, "src/c.js", None), (104, None, "x"), (None, "src/d.js", "x"), (105, "noext", "x")]
    # A mention of generators counts beside a template's names only.
    rows += [(106, "src/g.js", "let x = 1; // from a generator\n" + " ".join(f"f{k}(v{k});" for k in range(40))), (107, "src/h.js", "let x = 1; // from a generator\n" + hand(1)), (100, "src/a.js", squeezed)]
    df = spark.createDataFrame(rows, "doc_id bigint, path string, text string").repartition(3)
    up = spark.createDataFrame([(LENT,), (None,)], "text string")
    out = origin.file_origins(df, "doc_id", "path", "text", up, "text").collect()
    got = {r.doc_id: r.origin for r in out}
    assert len(out) == len(rows) - 2
    assert {k: v for k, v in got.items() if v} == {100: "minified", 101: "tool", 102: "copy", 106: "tool"}, got
    none = origin.file_origins(df.limit(0), "doc_id", "path", "text", up.limit(0), "text")
    assert none.count() == 0 and none.columns == ["doc_id", "origin", "cross_entropy", "diversity", "foreign"]
