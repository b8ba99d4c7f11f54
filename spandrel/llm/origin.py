"""Files that nobody wrote by hand here, told by models of their names and by what they declare.

Tool output, minified code, third-party code, upstream copies and mere data.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spandrel.llm.naming import STYLES, count_grams, cross_entropy, model, names_of, shapes, styles
from spandrel.session import materialize

#: Words of a shingle, and the least share of shingles that a copy and its upstream file have in common, of either.
SHINGLE, COPY, COPY_FOREIGN = 4, 0.6, 0.5
#: Least share of a file that is one table or literal, and its least characters; a smaller table isn't enough.
DATA_SHARE, DATA_SHARE_TEMPLATE, DATA_CHARS = 0.5, 0.4, 600
#: Bits a letter above the language's median from which names are mangled, and the mean length of mangled names.
MANGLED, SHORT_NAMES, LONG_LINES = 0.4, 4.5, 80
#: Bits a letter above the median from which names of any length are unlike the language's.
STRANGE = 0.6
#: Share of different names without digits below which names are a template's; distance of styles that is foreign.
TEMPLATE, FOREIGN = 0.5, 0.4
#: Names that a file needs for its names to count.
LEAST_NAMES = 20
#: Share of control and undecodable characters from which a text is binary.
BINARY = 0.02
#: Characters of upstream files that are searched for at once; more of them go in further passes.
BLOCK_CHARS = 64_000_000
#: A mention of tools counts in the first characters of a file, and only beside telling names.
HEAD_CHARS = 2_000

LANGUAGES = ["swift", "js", "py", "c"]
CODE = {"swift", "js", "py", "c", "h"}
THIRD_PARTY = {"vendor", "third_party", "thirdparty", "third-party", "3rdparty", "3rd_party", "deps", "submodules", "node_modules", "bower_components", "pods", "carthage", "checkouts", "site-packages"}
#: Ordinary words that name such a folder only if it holds a folder per package.
THIRD_PARTY_WORDS = {"external", "externals", "dependencies"}
TOOL_DIRS = {"generated", "__generated__", "autogen", "gen", "derivedsources", "deriveddata", "dist"}
_TOOL_NAME = re.compile(r"(?i)(?:\.(?:generated|g|gen|pb|pb-c|pb2|designer|bundle)\.\w+|_pb2?(?:_grpc)?\.\w+|[._]generated\.\w+|\+CoreData(?:Class|Properties)\.swift)$|^(?:moc|qrc)_\w+\.(?:c|cc|cpp|h)$|^ui_\w+\.h$")
_MIN_NAME = re.compile(r"(?i)[.\-_]min\.(?:js|css)$")
_SAYS = re.compile(
    r"(?i)@generated\b|<auto-?generated|\bauto-?generated\b|\b(?:automatically|machine)[ -](?:generated|created|written|produced)\b|\b(?:generated|created|written|produced) automatically\b"
    r"|^(?:this )?(?:code|file|source)?(?: (?:was|is))? ?generated (?:by|using|from|with)\b|\bcode generated by\b"
    r"|^do not (?:touch|edit|modify)\b.*\b(?:re)?generat|\boutput of \S+\. .*\boverwritten\b|\bchanges (?:will be|are|get) (?:lost|overwritten)\b"
    r"|\bautomatisch (?:erzeugt|generiert|erstellt)\b|\b(?:produit|généré)e? (?:automatiquement )?par .*\bne pas (?:modifier|éditer)|\bgénéré automatiquement\b"
    r"|\bgenerado (?:automáticamente|por)\b|\bgenerato (?:automaticamente|da)\b|\bgerado (?:automaticamente|por)\b|сгенерирован\w* автоматически|автоматически сгенерирован|自動生成|自动生成"
)
_COMMENT = {"py": re.compile(r"^\s*#+"), "md": re.compile(r"^\s*<!--")}
_SLASHES = re.compile(r"^\s*(?://+!?|/\*+!?|\*+/?)")
_MENTIONS = re.compile(r"(?i)\b(?:auto-?)?generat(?:ed|or)\b|\bdo not (?:edit|modify)\b")
_LITERAL = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|(?<!\w)\d[\w.]*')
_PUNCTUATION = b" \t\r,()[]{}+;:-.=\\_"
_VALUES = {b"true", b"false", b"null", b"None", b"nil", b"True", b"False"}
_STRING = re.compile(r'"((?:[^"\\\s]|\\.)*)"|\'((?:[^\'\\\s]|\\.)*)\'')
_NOISE = re.compile(r"[\x00-\x08\x0e-\x1f\x7f�]")
_WORD = re.compile(r"\w+")


def by_path(path: str) -> str | None:
    *folders, name = path.split("/")
    folders = [f.lower() for f in folders]
    if any(f in THIRD_PARTY for f in folders) or any(f in THIRD_PARTY_WORDS for f in folders[:-1]):
        return "third_party"
    if _TOOL_NAME.search(name) or any(f in TOOL_DIRS for f in folders):
        return "tool"
    return "minified" if _MIN_NAME.search(name) else None


def says_tool(text: str, extension: str) -> bool:
    """Whether the comments at the head of a file say that a tool wrote it; strings and later remarks don't count."""
    comment = _COMMENT.get(extension, _SLASHES)
    inside = False
    for line in text.removeprefix("﻿").splitlines():
        bare = line.strip()
        if not bare or bare.startswith("#!"):
            continue
        m = comment.match(line)
        if not m and not inside:
            return False
        if extension not in ("py", "md"):
            inside = (inside or "/*" in bare) and "*/" not in bare
        if _SAYS.search((line[m.end() :] if m else line).strip(" \t*/#-")):
            return True
    return False

def _noise(text: str) -> bool:
    return _NOISE.search(text) is not None and len(_NOISE.findall(text)) >= BINARY * len(text)


def data_share(text: str) -> tuple[float, int]:
    """(share of the text that its largest table or literal has, that literal's characters); binary content is all data."""
    if _noise(text):
        return 1.0, max(len(text), DATA_CHARS)
    left = _LITERAL.sub("", text).encode("latin-1", "replace").translate(None, _PUNCTUATION).split(b"\n")
    size = best = run = 0
    for line, rest in zip(text.split("\n"), left):
        n = len(line.strip())
        if n:
            size += n
            if rest and rest not in _VALUES:
                run = 0
            else:
                run += n
                if run > best:
                    best = run
    if best < DATA_SHARE * size and max(map(len, text.split())) >= DATA_CHARS:
        best = max(best, max((len(a or b) for a, b in _STRING.findall(text)), default=0))
    return (best / size if size else 0.0), best


class Upstream:
    """Word n-grams of a block of known files, for one process (hashes of words differ between processes)."""

    def __init__(self, texts: list[str]):
        own = [np.unique(shingles(t)) for t in texts]
        self.sizes = np.array([len(c) for c in own], dtype=np.int64)
        codes = np.concatenate([*own, np.zeros(0, np.uint64)])
        files = np.repeat(np.arange(len(own)), [len(c) for c in own])
        order = np.argsort(codes, kind="stable")
        self.codes, self.files = codes[order], files[order]
        # The low bits of the codes that occur: most n-grams of other texts end here.
        self.mask = np.uint64((1 << 22) - 1)
        self.seen = np.zeros(1 << 22, dtype=bool)
        self.seen[(self.codes & self.mask).astype(np.int64)] = True
        self.least = int(self.sizes[self.sizes > 0].min()) if (self.sizes > 0).any() else 0

    def copied(self, text: str) -> float:
        """The share of n-grams in common with one of the files, of the side with more of them; 0 if far too few are."""
        codes = shingles(text)
        hits = np.unique(codes[self.seen[(codes & self.mask).astype(np.int64)]])
        if not len(hits) or len(hits) < COPY_FOREIGN * self.least:
            return 0.0
        lo, hi = np.searchsorted(self.codes, hits, "left"), np.searchsorted(self.codes, hits, "right")
        n = hi - lo
        if not n.any():
            return 0.0
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        common = np.bincount(self.files[at], minlength=len(self.sizes))
        return float((common / np.maximum(self.sizes, len(np.unique(codes)))).max())


def shingles(text: str) -> np.ndarray:
    """A code of each run of SHINGLE words of a text."""
    words = np.fromiter(map(hash, _WORD.findall(text.lower())), dtype=np.int64).view(np.uint64)
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    code = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        code = (code ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
    return code


def extension_of(path: str) -> str:
    name = path.rpartition("/")[2]
    return name.rpartition(".")[2].lower() if "." in name else ""


PROFILE = T.StructType(
    [T.StructField(n, t) for n, t in [
        ("language", T.StringType()), ("path_says", T.StringType()), ("head_says", T.BooleanType()), ("mentions", T.BooleanType()),
        ("line_chars", T.DoubleType()), ("data_share", T.DoubleType()), ("data_chars", T.LongType()), ("copied", T.DoubleType()),
        ("n_names", T.IntegerType()), ("n_distinct", T.IntegerType()), ("n_shapes", T.IntegerType()), ("name_chars", T.LongType()),
        ("styles", T.ArrayType(T.IntegerType())), ("names", T.ArrayType(T.StringType())),
    ]]
)


def profile(path: str, text: str, upstream: Upstream) -> tuple:
    """What the verdict is made of: declarations, layout, literals, copies, and the different names of a file."""
    extension = extension_of(path)
    language = {"h": "c"}.get(extension, extension) if extension in CODE else None
    found = names_of(text, language) if language else Counter()
    names = list(found)
    share, chars = data_share(text) if language else (0.0, 0)
    head = extension != "json" and says_tool(text, extension)
    start = text[:HEAD_CHARS]
    low = start.lower()
    mentions = extension != "json" and not head and ("generat" in low or "do not" in low) and bool(_MENTIONS.search(start))
    lines = text.count("\n") + 1
    return (
        language, by_path(path), head, mentions, len(text) / lines, share, chars, upstream.copied(text),
        sum(found.values()), len(names), shapes(names), sum(map(len, names)), styles(names), names,
    )


def _blocks(upstream: DataFrame, text: str) -> Iterator[list[str]]:
    block, size = [], 0
    for (t,) in upstream.select(text).where(F.col(text).isNotNull()).distinct().toLocalIterator():
        block.append(t)
        size += len(t)
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    yield block


def file_profiles(df: DataFrame, key: str, path: str, text: str, upstream: DataFrame, upstream_text: str) -> DataFrame:
    """(key, fields of PROFILE) per file: one pass over the texts, in which no text moves."""
    rows = df.where(F.col(key).isNotNull() & F.col(path).isNotNull()).select(F.col(key).alias("key"), F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = T.StructType([rows.schema["key"], *PROFILE.fields])

    def profiled(texts: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Upstream(texts)  # here, as hashes of words differ between processes
            arrow = to_arrow_schema(schema)
            for b in batches:
                if b.num_rows:
                    cols = zip(*[profile(p, t, index) for p, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())])
                    yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, f.type) for c, f in zip(cols, list(arrow)[1:])]], schema=arrow)

        return run

    blocks = _blocks(upstream, upstream_text)
    first = materialize(rows.mapInArrow(profiled(next(blocks)), schema), "profiles")
    for texts in blocks:  # further blocks of upstream files only add to ``copied``

        def copies(batches: Iterator[pa.RecordBatch], texts: list[str] = texts) -> Iterator[pa.RecordBatch]:
            index = Upstream(texts)
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([index.copied(t) for t in b.column(2).to_pylist()], pa.float64())], ["key", "more"])

        more = rows.mapInArrow(copies, T.StructType([rows.schema["key"], T.StructField("more", T.DoubleType())])).groupBy("key").agg(F.max("more").alias("more"))
        joined = first.join(more, "key").withColumn("copied", F.greatest("copied", "more"))
        first = materialize(joined.select(*schema.names), "profiles")
    return first


def name_models(profiles: DataFrame) -> dict[str, np.ndarray]:
    """Per language the n-gram model of its names, trained on every file that doesn't declare itself as anything else.

    The counts are of the different names of all such files. At most one row per language and trigram, 18 bits of
    alphabet, comes to the driver, whatever the corpus.
    """
    own = profiles.where("language is not null and path_says is null and not head_says").select("language", "names")
    grams = own.mapInArrow(lambda it: count_grams(it, LANGUAGES), "language string, code int, n bigint").groupBy("language", "code").agg(F.sum("n").alias("n")).toArrow()
    langs, codes, counts = (grams.column(k).to_numpy() for k in range(3))
    return {x: model(codes[langs == x], counts[langs == x]) for x in LANGUAGES}


def file_origins(df: DataFrame, key: str, path: str, text: str, upstream: DataFrame, upstream_text: str) -> DataFrame:
    """Per file (key, origin string, cross_entropy, diversity, foreign double), origin null for hand-written source.

    cross_entropy: mean bits a letter of the file's names under its language's model, less the median of the language;
    diversity: different names without their digits, as a share of the different names; foreign: how far the shares of
    naming styles are from those of the language (0 to 1). The three are null where a file has no names.
    origin: third_party, tool, minified, data or copy. A null text counts as empty; rows with a null key or path are
    left out. Repeated rows come out as often as they come. An empty table gives no rows; without upstream files
    nothing is a copy.

    Method: one pass over the texts takes each file's names and marks. From the names of all files that declare nothing
    a character n-gram model per language is trained; names of high cross-entropy are mangled, names of low diversity
    are a template's, and names in another style than the language's are foreign. Mangled names on long lines are
    minified code; template-like, mangled or foreign names make a tool's or an upstream author's file of one that a
    mention or a lesser likeness to a known file alone would not; a declaration (path by convention, head comment) and
    a whole upstream file count by themselves, as the names of such files may be like any others.
    """
    profiles = file_profiles(df, key, path, text, upstream, upstream_text)
    models = name_models(profiles)
    kind = profiles.schema["key"]
    fields = [kind, T.StructField("cross_entropy", T.DoubleType())]
    rest = [f for f in profiles.schema.fields if f.name not in ("key", "names")]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = {n: k for k, n in enumerate(b.schema.names)}
            pairs = zip(b.column(at["language"]).to_pylist(), b.column(at["names"]).to_pylist())
            bits = pa.array([cross_entropy(names, models[lang]) if lang and names else None for lang, names in pairs], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(at["key"]), bits, *[b.column(at[f.name]) for f in rest]], ["key", "cross_entropy", *[f.name for f in rest]])

    files = materialize(profiles.mapInArrow(scored, T.StructType([*fields, *rest])), "scored")
    style = [F.sum(F.col("styles")[k]).alias(f"s{k}") for k in range(len(STYLES))]
    # One row per language: hundredths of a bit are counted, so that the median is the same on every run.
    norms = files.where("n_distinct > 0 and path_says is null and not head_says").groupBy("language").agg(F.percentile(F.round("cross_entropy", 2), 0.5).alias("norm_bits"), *style)
    total = sum(F.col(f"s{k}") for k in range(len(STYLES)))
    norms = norms.select("language", "norm_bits", F.array(*[F.col(f"s{k}") / total for k in range(len(STYLES))]).alias("norm_styles"))
    files = files.join(F.broadcast(norms), "language", "left")
    own = F.col("n_distinct")
    apart = F.aggregate(F.arrays_zip("styles", "norm_styles"), F.lit(0.0), lambda a, x: a + F.abs(x["styles"] / own - x["norm_styles"])) / 2
    has = own > 0
    files = files.select(
        "key", "path_says", "head_says", "mentions", "line_chars", "data_share", "data_chars", "copied", "language", "n_names",
        F.when(has, F.col("cross_entropy") - F.col("norm_bits")).alias("cross_entropy"),
        F.when(has, F.col("n_shapes") / own).alias("diversity"),
        F.when(has, apart).alias("foreign"),
        F.when(has, F.col("name_chars") / own).alias("name_length"),
    )
    enough = F.col("n_names") >= LEAST_NAMES
    mangled = F.coalesce(enough & (F.col("cross_entropy") >= MANGLED) & (F.col("name_length") <= SHORT_NAMES), F.lit(False))
    template = F.coalesce(enough & (F.col("diversity") < TEMPLATE), F.lit(False))
    foreign = F.coalesce(enough & ((F.col("foreign") >= FOREIGN) | (F.col("cross_entropy") >= STRANGE)), F.lit(False))
    says = F.col("path_says")
    origin = (
        F.when(says == "third_party", "third_party")
        .when((says == "tool") | F.col("head_says") | (F.col("mentions") & (template | foreign)), "tool")
        .when((says == "minified") | (mangled & (F.col("line_chars") >= LONG_LINES)), "minified")
        .when(F.col("language").isNotNull() & (F.col("data_chars") >= DATA_CHARS) & (F.col("data_share") >= F.when(template, DATA_SHARE_TEMPLATE).otherwise(DATA_SHARE)), "data")
        .when(F.col("copied") >= F.when(foreign, COPY_FOREIGN).otherwise(COPY), "copy")
    )
    return files.select(F.col("key").alias(key), origin.alias("origin"), *[F.round(c, 4).alias(c) for c in ("cross_entropy", "diversity", "foreign")])
