"""Commands over the smallest tables: envelopes, redirects, errors, limits."""

import os

import pytest

from spandrel.api import Catalog, envelope, time_limit

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def cat(spark):
    return Catalog(spark, FOLDER)


def test_lookup(spark, cat):
    with time_limit(spark, "lookup", 120):
        out, code = envelope(lambda: cat.lookup(".PADDING(4)"))
    assert code == 0 and out["ok"] and out["schema_version"] == "v1" and out["error"] is None
    assert out["result"]["api"] == "padding" and out["result"]["kind"] == "modifiers" and out["next_actions"]
    assert envelope(lambda: cat.lookup("NSWindow"))[0]["result"]["out_of_scope"] == "platform_class"
    assert envelope(lambda: cat.lookup("modal sheet"))[0]["result"]["redirect"] == "search"
    lost, code = envelope(lambda: cat.lookup("zzzz"))
    assert code == 3 and lost["error"]["code"] == "UNKNOWN_API" and "did you mean" in lost["error"]["suggestion"] and lost["result"] is None
    assert envelope(lambda: cat.lookup(" "))[1] == 2 and envelope(lambda: cat.lookup("padding", limit=26))[1] == 2


def test_other_commands(cat):
    page = envelope(lambda: cat.examples("padding", limit=1))[0]
    assert len(page["result"]["examples"]) <= 1
    assert envelope(lambda: cat.examples("PADDING"))[1] == 3  # exact names only
    assert envelope(lambda: cat.recipe("BUTTON-ROW"))[0]["result"]["name"] == "button-row" and envelope(lambda: cat.recipe("x"))[1] == 3
    assert envelope(lambda: cat.repo("no/such"))[1] == 3
    assert envelope(lambda: cat.search("button"))[0]["result"]["apis"]
    assert envelope(cat.doctor)[0]["result"]["complete"] and envelope(lambda: Catalog(cat.spark, "/nowhere").doctor())[1] == 5
    assert envelope(cat.stats)[0]["result"]["sizes"]["repos"] > 0
    assert envelope(lambda: cat.rankings("total_apis"))[0]["result"] and envelope(lambda: cat.rankings("x"))[1] == 3
    assert envelope(lambda: cat.insights("x"))[1] == 3 and envelope(lambda: cat.conformances("Vie"))[1] == 3
    some = cat._examples("padding", "any").first()
    if some:
        assert envelope(lambda: cat.file(some.example_id))[0]["result"]["code"]
    assert envelope(lambda: cat.file("ex_none"))[1] == 3 and envelope(lambda: cat.file("x", mode="odd"))[1] == 2
