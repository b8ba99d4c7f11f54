"""The catalog as an interface: commands with a stable envelope, error classes and exit codes."""

from __future__ import annotations

import re
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field
from threading import Timer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.functions.names import doc_url
from spandrel.operators.topk import keep_or_all, recommended_and_diverse, top_k
from spandrel.plans import base, catalog, components, gate, profiles, search

#: Version of the envelope, exit classes, default and greatest limit of results.
SCHEMA, EXITS = "v1", {"ok": 0, "usage": 2, "not_found": 3, "network": 4, "no_data": 5}
DEFAULT, GREATEST = 6, 25


@dataclass
class CatalogError(Exception):
    kind: str
    code: str
    message: str
    retryable: bool = False
    suggestion: str | None = None

    @property
    def exit_code(self) -> int:
        return EXITS[self.kind]


@dataclass
class Answer:
    result: object
    next: list[tuple[str, str]] = field(default_factory=list)


def envelope(run: Callable[[], Answer]) -> tuple[dict, int]:
    """(envelope, exit code) of a command: result and follow-up commands, or an error; one shape for all."""
    out = {"ok": True, "schema_version": SCHEMA, "result": None, "next_actions": [], "error": None}
    try:
        answer = run()
    except CatalogError as e:
        error = {"class": e.kind, "code": e.code, "message": e.message, "retryable": e.retryable, "suggestion": e.suggestion}
        return {**out, "ok": False, "error": error}, e.exit_code
    return {**out, "result": answer.result, "next_actions": [{"cmd": c, "why": w} for c, w in answer.next]}, 0


@contextmanager
def time_limit(spark: SparkSession, tag: str, seconds: float):
    """Run queries under a tag and interrupt them after so many seconds; ``spark.interruptTag(tag)`` cancels them sooner."""
    spark.addTag(tag)
    timer = Timer(seconds, lambda: spark.interruptTag(tag))
    timer.start()
    try:
        yield
    finally:
        timer.cancel()
        spark.removeTag(tag)


def _rows(df: DataFrame, limit: int) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.limit(limit).collect()]


class Catalog:
    """Read-only commands over one data folder. Each collects at most ``limit`` rows; the same plans are there as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    # ---- helpers
    def _limit(self, limit: int) -> int:
        if not 1 <= limit <= GREATEST:
            raise CatalogError("usage", "BAD_LIMIT", f"limit must be 1 to {GREATEST}")
        return limit

    def _name(self, api: str) -> str:
        name = re.sub(r"^[@.]+", "", (api or "").strip()).split("(", 1)[0].strip()
        if not name:
            raise CatalogError("usage", "EMPTY_QUERY", "the name is empty", suggestion="lookup padding")
        return name

    def _one(self, query: str) -> DataFrame:
        return self.spark.createDataFrame([(query,)], "query string")

    def find(self, name: str) -> tuple[str, str] | None:
        """(symbol, dimension): exact, else without regard to case; dimensions in lookup order."""
        row = search.resolve_names(self._one(name), search.symbols(self.spark, self.folder)).first()
        return (row.sym, row.dim) if row else None

    def suggestions(self, name: str, limit: int = search.SUGGESTED) -> list[str]:
        return [r.sym for r in search.suggest(self._one(name), search.symbols(self.spark, self.folder), limit).orderBy("rank").collect()]

    def resolve(self, query: str) -> tuple[list[str], list[str]]:
        apis = search.resolve_intents(self._one(query), search.aliases(self.spark), search.symbols(self.spark, self.folder))
        found = [r.sym for r in apis.orderBy("rank").limit(GREATEST).collect()]
        recipes = [n for n, _ in search.RECIPES if query.lower() in n]
        return found, recipes

    def _examples(self, sym: str, platform: str, shape: str | None = None, repo: str | None = None) -> DataFrame:
        rows = base.examples(self.spark, self.folder).where(F.col("sym") == sym)
        if platform == "macos":
            rows = keep_or_all(rows, ["sym"], F.col("platform") == "macos")
        if shape is not None:
            rows = rows.where(F.col("shape") == shape)
        if repo is not None:
            rows = rows.where(F.lower("repo") == repo.lower())
        order = [F.desc_nulls_last("score"), F.desc_nulls_last("stars"), F.asc("repo"), F.asc("example_id")]
        return top_k(rows, ["sym"], order, 1_000)

    # ---- commands
    def lookup(self, api: str, limit: int = DEFAULT, platform: str = "macos") -> Answer:
        name, limit = self._name(api), self._limit(limit)
        found = self.find(name)
        if found is None:
            return self._redirect(api, name, limit)
        sym, dim = found
        use = catalog.usage_index(self.spark, self.folder).where((F.col("sym") == sym) & (F.col("dim") == dim)).first()
        info = base.availability(self.spark, self.folder).where(F.col("sym") == sym).first()
        shapes = catalog.consensus_share(self.spark, self.folder).where((F.col("sym") == sym) & (F.col("dim") == dim)).orderBy("rank")
        picked = recommended_and_diverse(self._examples(sym, platform), ["sym"], "shape", "rank", 3).orderBy("rank").collect()
        brief = [{k: r[k] for k in ("example_id", "repo", "permalink", "src", "shape", "stars", "score", "role")} for r in picked]
        partners = catalog.cooccurrence_lift(self.spark, self.folder).where(F.col("sym") == sym).orderBy("rank").select("other")
        recipes = [n for n, apis in search.RECIPES if sym in apis]
        url = self.spark.range(1).select(doc_url(F.lit(dim), F.lit(sym)).alias("u")).first().u
        result = {
            "api": sym, "kind": dim, "repo_count": use.repo_count if use else 0, "total_uses": use.total_uses if use else 0, "low_corpus": use.low_corpus if use else True,
            "introduced": info.introduced if info else None, "deprecated": bool(info and info.deprecated), "doc": url,
            "consensus": [{"shape": r["shape"], "percent": r["percent"]} for r in _rows(shapes, GREATEST)],
            "recommended": next((b for b in brief if b["role"] == "recommended"), None), "diverse": [b for b in brief if b["role"] == "diverse"],
            "co_occurs_with": [r["other"] for r in _rows(partners, GREATEST)], "recipes": recipes,
        }
        if result["deprecated"]:
            result["replacement"] = info.renamed
        steps = [(f"file {result['recommended']['example_id']}", "the enclosing code")] if result["recommended"] else []
        steps.append((f"examples {sym} --limit 12", "more uses"))
        steps += [(f"recipe {n}", "the whole pattern") for n in recipes[:1]]
        if result.get("replacement"):
            steps.append((f"lookup {result['replacement']}", "the replacement"))
        return Answer(result, steps)

    def _redirect(self, api: str, name: str, limit: int) -> Answer:
        """A name that nothing has: a recipe's, a platform class, an intent, or an error with suggestions."""
        for recipe, apis in search.RECIPES:
            if name in apis:
                return Answer({"api": name, "redirect": "recipe", "recipe": recipe}, [(f"recipe {recipe}", "the pattern with examples")])
        if re.match(r"(NS|UI)[A-Z]", name):
            return Answer({"api": name, "out_of_scope": "platform_class"}, [(f"search {name}", "related names")])
        apis, recipes = self.resolve(api)
        if apis or recipes:
            return Answer({"api": name, "redirect": "search", "apis": apis[:limit], "recipes": recipes}, [(f"lookup {a}", "its use") for a in apis[:3]])
        near = self.suggestions(name)
        raise CatalogError("not_found", "UNKNOWN_API", f"no use of {name!r}", suggestion=f"did you mean: {', '.join(near)}?" if near else f"search {name}")

    def examples(self, sym: str, limit: int = DEFAULT, page: int = 1, shape: str | None = None, repo: str | None = None, platform: str = "macos") -> Answer:
        limit = self._limit(limit)
        if page < 1:
            raise CatalogError("usage", "BAD_PAGE", "pages start at 1")
        if search.symbols(self.spark, self.folder).where(F.col("sym") == sym).limit(1).count() == 0:
            raise CatalogError("not_found", "UNKNOWN_API", f"no use of {sym!r}", suggestion=f"lookup {sym}")
        rows = _rows(self._examples(sym, platform, shape, repo).where((F.col("rank") > (page - 1) * limit) & (F.col("rank") <= page * limit + 1)).orderBy("rank"), limit + 1)
        more = [(f"examples {sym} --page {page + 1}", "the next page")] if len(rows) > limit else []
        return Answer({"api": sym, "page": page, "examples": rows[:limit]}, more)

    def file(self, where: str, mode: str = "smart", offline: bool = True) -> Answer:
        """The code around an example, by id or permalink, as far as its text has been landed."""
        from spandrel.extract import facts as X

        if mode not in ("smart", "decl", "chain", "full"):
            raise CatalogError("usage", "BAD_MODE", f"unknown mode {mode!r}")
        by = F.col("permalink") == where if "/" in where else F.col("example_id") == where
        row = base.examples(self.spark, self.folder).where(by).first()
        if row is None:
            raise CatalogError("not_found", "UNKNOWN_EXAMPLE", f"no example {where!r}")
        docs = base.table(self.spark, self.folder, "documents").where((F.col("path") == row.path) & F.col("text").isNotNull() & (F.lower("repo") == row.repo)).limit(1)
        facts = X.extract_facts(docs, ["doc_id"], "text")
        anchor = docs.select("doc_id", F.lit(row.line).alias("line"))
        spans = X.enclosing_spans(anchor, X.exploded(facts, ["doc_id"], "nodes"), ["doc_id"]).join(docs.select("doc_id", "text"), "doc_id")
        spans = spans.withColumn("s", X.span_policy(mode, F.col("line"), F.size(F.split("text", "\n"))))
        got = spans.select("s.a", "s.b", X.line_slice(F.col("text"), F.col("s.a"), F.col("s.b")).alias("code")).first()
        if got is None:
            if not offline:
                raise CatalogError("network", "NOT_LANDED", "the source isn't landed", retryable=True, suggestion="land it, then ask again")
            return Answer({"id": row.example_id, "offline": True, "code": row.src})
        return Answer({"id": row.example_id, "repo": row.repo, "path": row.path, "line": row.line, "from": got.a, "to": got.b, "code": got.code}, [(f"lookup {row.sym}", "its use")])

    def recipes(self) -> Answer:
        return Answer([{"name": n, "apis": a} for n, a in search.RECIPES], [(f"recipe {search.RECIPES[0][0]}", "one of them")])

    def recipe(self, name: str, limit: int = DEFAULT) -> Answer:
        for n, apis in search.RECIPES:
            if n == name.lower():
                ids = search.recipe_examples(self.spark, self.folder).where(F.col("recipe") == n).orderBy("example_id")
                return Answer({"name": n, "apis": apis, "examples": [r["example_id"] for r in _rows(ids, self._limit(limit))]}, [(f"lookup {apis[0]}", "its use")])
        raise CatalogError("not_found", "UNKNOWN_RECIPE", f"no recipe {name!r}", suggestion="recipes")

    def repo(self, name: str) -> Answer:
        row = profiles.repo_profile(self.spark, self.folder).where(F.col("repo") == name.lower()).first()
        if row is None:
            raise CatalogError("not_found", "UNKNOWN_REPO", f"no repository {name!r}")
        return Answer(row.asDict(recursive=True))

    def deprecated(self, api: str | None = None, limit: int = DEFAULT) -> Answer:
        rows = profiles.deprecated_usage(self.spark, self.folder)
        if api is None:
            return Answer(_rows(rows.orderBy(F.desc("repos"), "sym"), self._limit(limit)))
        known = base.availability(self.spark, self.folder).where(F.col("sym") == self._name(api)).first()
        if known is None:
            raise CatalogError("not_found", "UNKNOWN_API", f"no entry for {api!r}", suggestion=f"lookup {api}")
        use = rows.where(F.col("sym") == known.sym).first()
        out = {"api": known.sym, "deprecated": known.deprecated, "replacement": known.renamed, "repos": use.repos if use else 0}
        return Answer(out, [(f"lookup {known.renamed}", "the replacement")] if known.deprecated and known.renamed else [])

    def search(self, query: str, limit: int = DEFAULT) -> Answer:
        if not query.strip():
            raise CatalogError("usage", "EMPTY_QUERY", "the query is empty")
        apis, recipes = self.resolve(query)
        return Answer({"query": query, "apis": apis[: self._limit(limit)], "recipes": recipes}, [(f"lookup {a}", "its use") for a in apis[:3]])

    def stats(self) -> Answer:
        sizes = {r["name"]: r["n"] for r in _rows(profiles.corpus_index(self.spark, self.folder), 100)}
        return Answer({"sizes": sizes, "adoption": {r["feature"]: r["percent"] for r in _rows(profiles.adoption_pct(self.spark, self.folder), 100)}})

    def doctor(self) -> Answer:
        """Which tables of the folder can be read, and their columns."""
        out = {}
        for name in ("repos", "source_files", "occurrences", "examples", "symbol_catalog", "documents"):
            try:
                out[name] = len(base.table(self.spark, self.folder, name).columns)
            except Exception:  # noqa: BLE001 - a missing table is what is asked for
                out[name] = None
        if not any(out.values()):
            raise CatalogError("no_data", "NO_CATALOG", f"nothing to read in {self.folder!r}")
        return Answer({"folder": self.folder, "tables": out, "complete": all(out.values())})

    def bridges(self, part: str | None = None, limit: int = DEFAULT) -> Answer:
        rows = components.custom_components(self.spark, self.folder).where("kind = 'bridge'")
        if part:
            low = part.lower()
            rows = rows.where(F.contains(F.lower("conforms"), F.lit(low)) | F.contains(F.lower("name"), F.lit(low)))
        return Answer({"bridges": _rows(rows.orderBy("repo", "name"), self._limit(limit)), "by_kind": _rows(components.bridge_inventory(self.spark, self.folder), 100)})

    def settings(self, limit: int = DEFAULT) -> Answer:
        return Answer({"screens": _rows(components.settings_screens(self.spark, self.folder), self._limit(limit)), "vocabulary": _rows(components.form_vocab(self.spark, self.folder).orderBy(F.desc("screens"), "word"), 20)})

    def conformances(self, protocol: str | None = None, limit: int = DEFAULT) -> Answer:
        rows = components.conformance_topk(self.spark, self.folder).orderBy(F.desc("repo_count"), "protocol")
        if protocol is None:
            return Answer(_rows(rows.drop("examples"), self._limit(limit)))
        row = rows.where(F.lower("protocol") == protocol.lower()).first()
        if row is None:
            near = [p for p in components.PROTOCOLS if protocol.lower() in p.lower()]
            raise CatalogError("not_found", "UNKNOWN_PROTOCOL", f"no conformance to {protocol!r}", suggestion=f"did you mean: {', '.join(near)}?" if near else None)
        return Answer(row.asDict())

    def rankings(self, board: str | None = None, limit: int = DEFAULT) -> Answer:
        rows = profiles.rankings_top(self.spark, self.folder)
        if board is not None:
            rows = rows.where(F.col("board") == board)
        got = _rows(rows.where(F.col("rank") <= self._limit(limit)).orderBy("board", "rank"), 4 * limit)
        if not got:
            raise CatalogError("not_found", "UNKNOWN_BOARD", f"no board {board!r}", suggestion="rankings")
        return Answer(got)

    def insights(self, section: str | None = None, limit: int = DEFAULT) -> Answer:
        """One section of insights, or the size of each."""
        parts = {
            "adoption": lambda: profiles.adoption_pct(self.spark, self.folder).orderBy("feature"), "deprecated": lambda: profiles.deprecated_usage(self.spark, self.folder).orderBy(F.desc("repos"), "sym"),
            "unmatched": lambda: profiles.unmatched_topk(self.spark, self.folder).orderBy("kind", "rank"), "company": lambda: catalog.anchored_comodifiers(self.spark, self.folder).orderBy("anchor", "rank"),
            "categories": lambda: profiles.category_fingerprint(self.spark, self.folder).orderBy(F.desc("avg_modifiers"), "category"), "components": lambda: components.component_kinds(self.spark, self.folder).orderBy("kind"),
        }
        if section is None:
            return Answer({n: p().count() for n, p in parts.items()}, [(f"insights {n}", "this section") for n in parts])
        if section not in parts:
            raise CatalogError("not_found", "UNKNOWN_SECTION", f"no section {section!r}", suggestion=f"one of: {', '.join(parts)}")
        return Answer(_rows(parts[section](), self._limit(limit)))

    def value_builders(self, part: str | None = None, limit: int = DEFAULT) -> Answer:
        rows = catalog.usage_index(self.spark, self.folder).where("dim = 'valueBuilders'")
        if part:
            rows = rows.where(F.contains(F.lower("sym"), F.lit(part.lower())))
        return Answer(_rows(rows.orderBy(F.desc("total_uses"), "sym"), self._limit(limit)))

    def gate(self, limit: int = DEFAULT) -> Answer:
        return Answer({"included": _rows(gate.included_repos(self.spark, self.folder), self._limit(limit)), "reasons": _rows(gate.gate_histogram(self.spark, self.folder), 10)})
