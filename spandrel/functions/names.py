"""Normal forms of symbol, repository and version names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_symbol(c: Column | str) -> Column:
    """Trim, drop one leading ``.`` or ``@``, cut at the first ``(``, trim again. Null stays null."""
    s = F.btrim(_col(c), F.lit(BLANKS))
    s = F.when(s.startswith(".") | s.startswith("@"), F.substring(s, 2, 2_000_000_000)).otherwise(s)
    return F.btrim(F.substring_index(s, "(", 1), F.lit(BLANKS))


def clean_repo(c: Column | str) -> Column:
    """Trim, lower case, drop a final ``.git``. Null stays null."""
    return F.regexp_replace(F.lower(F.btrim(_col(c), F.lit(BLANKS))), r"\.git$", "")


def link_repo(c: Column | str) -> Column:
    """Repository name out of a link's path: cut at # and ?, drop a final .git, then punctuation at the end."""
    s = F.regexp_replace(F.btrim(_col(c), F.lit(BLANKS)), r"[#?].*$", "")
    s = F.regexp_replace(s, r"\.git$", "")
    return F.regexp_replace(s, r"[).,;:*\"'`]+$", "")


def base_name(c: Column | str) -> Column:
    """A type's own name: without its generic arguments and the modules or types before it."""
    return F.element_at(F.split(F.substring_index(_col(c), "<", 1), r"\."), -1)


def is_public_name(c: Column | str) -> Column:
    """Whether a name is an identifier that doesn't start with an underscore."""
    return _col(c).rlike(r"^[A-Za-z][A-Za-z0-9_]*$")


def is_platform_class(c: Column | str) -> Column:
    """Names of the older interface classes: NS or UI before a capital."""
    return _col(c).rlike(r"^(NS|UI)[A-Z]")


def is_demo(c: Column | str) -> Column:
    """Names of samples and exercises (fixed words)."""
    return _col(c).rlike(r"(?i)sample|example|tutorial|demo|playground")


def version_number(c: Column | str) -> Column:
    """Major plus a hundredth of the minor number; 0 for null or anything else. 10.15 -> 10.15, 26.5 -> 26.05."""
    parts = F.split(_col(c), r"\.")
    major = parts[0].try_cast("int")
    minor = F.when(F.size(parts) > 1, F.get(parts, F.lit(1)).try_cast("int")).otherwise(F.lit(0))
    return F.coalesce(major + minor / F.lit(100.0), F.lit(0.0))


def version_text(c: Column | str) -> Column:
    """Two decimals without zeros at the end; null for 0 and null. 26.0 -> 26, 10.15 -> 10.15."""
    text = F.format_string("%.2f", _col(c))
    return F.when(_col(c) != 0, F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", ""))


def year_of(c: Column | str, default: int = 2023) -> Column:
    """Year at the start of an ISO date; the default where there is none."""
    return F.coalesce(F.substring(_col(c), 1, 4).try_cast("int"), F.lit(default))


def arg_shape(args: Column | str, trailing: Column | str) -> Column:
    """Labels of a call in brackets; { } for a call with nothing but a closure; null without arguments at all."""
    a = _col(args)
    joined = F.concat(F.lit("("), F.array_join(a, ", "), F.lit(")"))
    return F.when(a.isNull(), F.lit(None)).when((F.size(a) == 0) & F.coalesce(_col(trailing), F.lit(False)), "{ }").otherwise(joined)


def example_key(repo: Column | str, path: Column | str, line: Column | str) -> Column:
    """Stable id of a place in a file: ex_ and ten hex digits of its md5."""
    return F.concat(F.lit("ex_"), F.substring(F.md5(F.concat_ws(":", _col(repo), _col(path), _col(line).cast("string"))), 1, 10))


def permalink(base: Column | str, path: Column | str, line: Column | str) -> Column:
    return F.concat(_col(base), _col(path), F.lit("#L"), _col(line).cast("string"))


_LINK = r"^https?://[^/]+/([^/]+)/([^/]+)/blob/([^/]+)/([^#]+)#L(\d+)"


def parse_permalink(c: Column | str) -> Column:
    """struct<owner, repo, sha, path string, line int>, or null if it isn't a permalink."""
    part = [F.regexp_extract(_col(c), _LINK, k) for k in range(1, 6)]
    fields = F.struct(*[p.alias(n) for p, n in zip(part, ("owner", "repo", "sha", "path"))], part[4].try_cast("int").alias("line"))
    return F.when(_col(c).rlike(_LINK), fields)


def is_poor_snippet(c: Column | str) -> Column:
    """Blank, shorter than 12 characters, or cut off after ( { or ,"""
    s = F.btrim(F.coalesce(_col(c), F.lit("")), F.lit(BLANKS))
    return (s == "") | (F.length(s) < 12) | F.right(s, F.lit(1)).isin("(", "{", ",")


def style_category(parent: Column | str) -> Column:
    """Coarse category of a style value by the name of the type that declares it (fixed names)."""
    p = _col(parent)
    return (
        F.when(p.endswith("Style"), "controlStyle")
        .when(p == "Color", "color")
        .when(p == "Material", "material")
        .when(p.endswith("Alignment") | p.isin("UnitPoint", "Edge", "Axis"), "alignment")
        .when(p == "Edge.Set", "edge")
        .when(p.endswith("Placement"), "placement")
        .when(p.isin("Visibility", "Prominence", "ControlSize", "ContentMode"), "appearance")
        .otherwise("other")
    )


def doc_url(dim: Column | str, sym: Column | str, root: str = "https://docs.invalid/swiftui") -> Column:
    """Address of a symbol's page: modifiers and style values under the view type, environment keys under their values."""
    folder = F.when(_col(dim).isin("types", "valueBuilders", "macros", "propertyWrappers"), "/").when(_col(dim) == "environmentKeys", "/environmentvalues/").otherwise("/view/")
    return F.concat(F.lit(root), folder, F.lower(_col(sym)))


def tokens(c: Column | str, least: int) -> Column:
    """Runs of letters in lower case that are at least so long."""
    return F.filter(F.split(F.lower(_col(c)), r"[^\p{L}]+"), lambda x: F.length(x) >= least)


def occurrences_of(c: Column | str, mark: str) -> Column:
    """How often a text occurs in a string, without overlap."""
    return ((F.length(_col(c)) - F.length(F.replace(_col(c), F.lit(mark), F.lit("")))) / F.lit(len(mark))).cast("int")


def fenced_code(c: Column | str) -> Column:
    """Content of the first code fence of a generated answer, or the whole of it if there is none."""
    inner = F.regexp_extract(_col(c), r"(?s)```[A-Za-z]*\r?\n(.*?)```", 1)
    return F.when(_col(c).rlike(r"(?s)```[A-Za-z]*\r?\n.*?```"), inner).otherwise(_col(c))


def relative_path(c: Column | str, root: Column | str) -> Column:
    """A path without the folder it starts with."""
    folder = F.concat(F.rtrim(_col(root), F.lit("/")), F.lit("/"))
    return F.when(F.startswith(_col(c), folder), F.substr(_col(c), F.length(folder) + 1)).otherwise(_col(c))


#: POSIX classes that Java reads as plain letters.
_POSIX = {"[[:space:]]": r"\s", "[[:digit:]]": r"\d", "[[:alpha:]]": "[A-Za-z]", "[[:alnum:]]": "[A-Za-z0-9]", "[[:upper:]]": "[A-Z]", "[[:lower:]]": "[a-z]", "[[:punct:]]": r"\p{Punct}"}


def from_posix(pattern: str) -> str:
    """A pattern with POSIX classes as Java reads it."""
    for posix, java in _POSIX.items():
        pattern = pattern.replace(posix, java)
    for posix, inner in (("[:space:]", r"\s"), ("[:digit:]", r"\d"), ("[:alpha:]", "A-Za-z"), ("[:alnum:]", "A-Za-z0-9"), ("[:upper:]", "A-Z"), ("[:lower:]", "a-z")):
        pattern = pattern.replace(posix, inner)
    return pattern


def token_pattern(token: str) -> str:
    """Pattern of a forbidden call: after a dot or bracket, or at the start of a word, and not followed by more of a word."""
    return r"(^|[^A-Za-z0-9_])" + _escaped(token) + r"([^A-Za-z0-9_]|$)"


def _escaped(token: str) -> str:
    return "".join("\\" + x if x in r".^$*+?()[]{}|\\" else x for x in token)
