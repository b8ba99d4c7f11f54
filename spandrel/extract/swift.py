"""Facts of Swift source: imports, occurrences, components and a node table, from a tokenizer with a scope stack.

What the tokenizer can't see: types of expressions, code in inactive #if branches as inactive, operators declared by the
file, and regex literals. Members in type annotations, signatures and inheritance lists are no occurrences.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

#: Inherited type -> kind of component; opaque types whose members are view builders.
COMPONENTS = {
    "View": "view", "App": "app", "Scene": "scene", "ViewModifier": "viewmodifier", "PreviewProvider": "preview", "Shape": "shape", "InsettableShape": "shape",
    "Commands": "commands", "ToolbarContent": "toolbarcontent", "CustomizableToolbarContent": "toolbarcontent", "NSViewRepresentable": "bridge",
    "NSViewControllerRepresentable": "bridge", "UIViewRepresentable": "bridge", "UIViewControllerRepresentable": "bridge", "Layout": "layout", "Transferable": "transferable",
}
BUILDERS = ["some View", "some Scene", "some Commands", "some ToolbarContent"]
#: Most characters of a call's head, a line and an attribute's argument; largest file that is read.
HEAD, LINE, ARGUMENT, FILE_BYTES = 240, 200, 120, 2_000_000

_TOKEN = re.compile(
    r"//[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/)?|(?P<string>#*\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"#*|#+\"(?:[^\"\n]|\"(?!#))*\"#+|\"(?:[^\"\\\n]|\\\((?:[^()\n]|\((?:[^()\n]|\([^()\n]*\))*\))*\)|\\.)*\"?)"
    r"|(?P<name>`\w+`|[^\W\d]\w*|\$\w+)|(?P<number>\d[\w.]*)|(?P<sign>->|\.\.\.|\.\.<|[=!<>]=|&&|\|\||\?\?|[^\s\w])"
)
_TYPES = {"struct", "class", "enum", "actor", "extension"}
_MODIFIERS = {
    "public", "private", "fileprivate", "internal", "open", "final", "static", "override", "mutating", "nonmutating", "lazy", "weak", "unowned", "indirect", "required",
    "convenience", "nonisolated", "dynamic", "optional", "isolated", "consuming", "borrowing", "package", "prefix", "postfix", "infix",
}
#: Words after which an expression begins, and those whose condition ends at a brace.
_BEFORE = {"return", "case", "in", "is", "as", "try", "await", "throw", "where", "if", "guard", "while", "switch", "else", "for", "let", "var", "default", "do", "repeat", "some", "any", "inout"}
_CONDITIONS = {"if", "guard", "while", "switch", "for", "catch"}
_DIRECTIVES = {"if", "elseif", "else", "endif", "available", "unavailable", "sourceLocation"}
_ENDS = {")": "(", "]": "[", "}": "{"}


@dataclass
class Facts:
    imports: set[str] = field(default_factory=set)
    occurrences: list[dict] = field(default_factory=list)
    decls: list[dict] = field(default_factory=list)
    nodes: list[dict] = field(default_factory=list)


def base_name(text: str) -> str:
    return text.split("<", 1)[0].rsplit(".", 1)[-1].strip()


def _collapsed(text: str, most: int) -> str:
    return re.sub(r"\s+", " ", text).strip()[:most]


class _Reader:
    def __init__(self, text: str):
        self.text = text
        self.toks: list[tuple[str, str, int]] = []  # kind, text, offset
        for m in _TOKEN.finditer(text):
            kind = m.lastgroup
            if kind:
                self.toks.append((kind, m.group(), m.start()))
        self.starts = [0, *[m.end() for m in re.finditer("\n", text)]]
        self.lines = text.split("\n")
        self.match: dict[int, int] = {}
        stack: list[tuple[str, int]] = []
        for k, (kind, t, _) in enumerate(self.toks):
            if kind == "sign":
                if t in "([{":
                    stack.append((t, k))
                elif t in _ENDS and any(o == _ENDS[t] for o, _ in stack):
                    while stack[-1][0] != _ENDS[t]:
                        stack.pop()
                    self.match[stack.pop()[1]] = k
        self.facts = Facts()
        self.scopes: list[tuple[int, str]] = []  # token after which a scope ends, its name
        self.condition_braces: set[int] = set()
        self.type_spans: list[tuple[int, int]] = []

    # ---- places
    def line_of(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def col_of(self, at: int) -> int:
        return at - self.starts[self.line_of(at) - 1] + 1

    def line_text(self, line: int) -> str:
        return self.lines[line - 1].strip()[:LINE]

    def t(self, k: int) -> str:
        return self.toks[k][1] if 0 <= k < len(self.toks) else ""

    def kind(self, k: int) -> str:
        return self.toks[k][0] if 0 <= k < len(self.toks) else ""

    def at(self, k: int) -> int:
        return self.toks[k][2] if k < len(self.toks) else len(self.text)

    def end(self, k: int) -> int:
        return self.at(k) + len(self.t(k)) if k < len(self.toks) else len(self.text)

    def newline_before(self, k: int) -> bool:
        return k > 0 and "\n" in self.text[self.end(k - 1) : self.at(k)]

    def scope(self) -> str | None:
        return self.scopes[-1][1] if self.scopes else None

    # ---- pieces
    def labels(self, open_at: int) -> list[str]:
        close = self.match.get(open_at)
        if close is None or close == open_at + 1:
            return []
        out, k, first = [], open_at + 1, True
        while k < close:
            if first:
                out.append(self.t(k) if self.kind(k) == "name" and self.t(k + 1) == ":" else "_")
                first = False
            if self.t(k) in "([{" and self.kind(k) == "sign" and k in self.match:
                k = self.match[k]
            elif self.t(k) == ",":
                first = True
            k += 1
        return out

    def generic_end(self, k: int) -> int:
        """Token after a <...> that begins at k, or k if none does."""
        if self.t(k) != "<" or self.at(k) != self.end(k - 1):
            return k
        depth = 0
        for j in range(k, min(k + 200, len(self.toks))):
            t = self.t(j)
            if t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
                if not depth:
                    return j + 1
            elif self.kind(j) != "name" and t not in (".", ",", ":", "&", "[", "]", "?", "(", ")", "->"):
                return k
        return k

    def call(self, k: int) -> tuple[list[str], bool, int, int, int] | None:
        """Call whose callee ends before token k: (labels, closure, token of its argument end or -1, last token, closures)."""
        args: list[str] = []
        close, last = -1, k - 1
        if self.t(k) == "(" and not self.newline_before(k) and k in self.match:
            args, close = self.labels(k), self.match[k]
            last, k = close, close + 1
        closures = 0
        if self.t(k) == "{" and k in self.match and k not in self.condition_braces and not (close < 0 and self.newline_before(k)):
            closures, last, k = 1, self.match[k], self.match[k] + 1
            while self.kind(k) == "name" and self.t(k + 1) == ":" and self.t(k + 2) == "{" and k + 2 in self.match:
                closures, last, k = closures + 1, self.match[k + 2], self.match[k + 2] + 1
        if close < 0 and not closures:
            return None
        return args, closures > 0, close, last, closures

    def head(self, prefix: str, open_at: int, called: tuple) -> str:
        if called[2] >= 0:
            return _collapsed(f"{prefix}({self.text[self.end(open_at) : self.at(called[2])].strip()})", HEAD)
        return _collapsed(prefix + (" { … }" if called[1] else ""), HEAD)

    def type_end(self, k: int) -> int:
        """Token after the type that begins at k: up to = { , ) or a line break where a type can't go on."""
        depth = 0
        begin = k
        while k < len(self.toks):
            t = self.t(k)
            if self.kind(k) == "sign" and t in "([" and k in self.match:
                if k > begin and self.newline_before(k):
                    break
                k = self.match[k] + 1
                continue
            if t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
            elif not depth and (t in ("=", "{", ",", ")", "]", "}", ";") or t == "in"):
                break
            elif not depth and k > begin and self.newline_before(k) and t not in ("->", "&", ".", "where") and self.t(k - 1) not in ("->", "&", ".", ":", "some", "any"):
                break
            k += 1
        return k

    def attributes(self, k: int) -> tuple[list[tuple[str, str | None, int]], int]:
        out = []
        while self.t(k) == "@" and self.kind(k + 1) == "name":
            at, name, j = k, self.t(k + 1), k + 2
            while self.t(j) == "." and self.kind(j + 1) == "name":
                name, j = self.t(j + 1), j + 2
            j = self.generic_end(j)
            arg = None
            if self.t(j) == "(" and self.at(j) == self.end(j - 1) and j in self.match:
                arg = self.text[self.end(j) : self.at(self.match[j])].strip().replace("\n", " ")[:ARGUMENT]
                j = self.match[j] + 1
            out.append((name, arg, at))
            k = j
        return out, k

    def emit(self, sym: str, kind: str, k: int, **more) -> None:
        line = self.line_of(self.at(k))
        row = {"sym": sym, "kind": kind, "line": line, "col": self.col_of(self.at(k)), "end_line": None, "implicit": None, "args": None, "trailing_closure": None, "attach": None, "prop": None, "scope": self.scope(), "src": self.line_text(line)}
        row.update(more)
        self.facts.occurrences.append(row)

    def node(self, kind: str, name: str, begin: int, last: int, **more) -> None:
        row = {"kind": kind, "name": name, "start": self.at(begin), "end": self.end(last), "start_line": self.line_of(self.at(begin)), "end_line": self.line_of(max(self.end(last) - 1, 0)), "labels": [], "closures": 0, "parent_type": self.scope(), "detail": ""}
        row.update(more)
        self.facts.nodes.append(row)

    def emit_attributes(self, attrs: list, attach: str) -> None:
        for name, arg, at in attrs:
            self.emit(name, "attribute", at, args=None if arg is None else [arg], attach=attach)

    # ---- declarations
    def variable(self, begin: int, k: int, attrs: list) -> int:
        """Bindings after var or let at k; returns the token where scanning goes on (initializers are scanned too)."""
        attach, j, bindings, resume = self.t(k), k + 1, [], None
        while True:
            first = j
            if self.t(j) == "(" and j in self.match:
                j = self.match[j] + 1
            elif self.kind(j) == "name":
                j += 1
            else:
                break
            name = self.text[self.at(first) : self.end(j - 1)]
            kind, init = None, None
            if self.t(j) == ":":
                stop = self.type_end(j + 1)
                kind = self.text[self.at(j + 1) : self.end(stop - 1)].strip() if stop > j + 1 else None
                self.type_spans.append((j, stop))
                j = stop
            if self.t(j) == "=":
                stop = self.expression_end(j + 1)
                init = _collapsed(self.text[self.at(j + 1) : self.end(stop - 1)], ARGUMENT) if stop > j + 1 else None
                resume = resume or j + 1
                j = stop
            bindings.append((name, kind, init))
            if self.t(j) != "," or attach not in ("var", "let"):
                break
            j += 1
        last = j - 1
        if self.t(j) == "{" and j in self.match and not (bindings and bindings[-1][2] is not None and self.newline_before(j)):
            last = self.match[j]
            resume = resume or j
        if bindings and bindings[0][1] and any(b in bindings[0][1] for b in BUILDERS):
            self.decl(bindings[0][0], "viewbuilder", [], k, attrs, [], self.scope(), None)
        for name, kind, init in bindings:
            for sym, arg, at in attrs:
                self.emit(sym, "attribute", at, args=None if arg is None else [arg], attach=attach, prop={"name": name, "type": kind, "init_text": init})
        if bindings:
            self.node("var", bindings[0][0], begin, max(last, k), detail=bindings[0][1] or "")
        return resume if resume is not None else max(j, k + 1)

    def expression_end(self, k: int) -> int:
        """Token after the expression that begins at k: a comma, closer or line break at its level ends it."""
        begin = k
        while k < len(self.toks):
            t = self.t(k)
            if self.kind(k) == "sign" and t in "([{" and k in self.match:
                if k > begin and self.newline_before(k):
                    break
                k = self.match[k] + 1
                continue
            if self.kind(k) == "sign" and t in ",)]};":
                break
            if k > begin and self.newline_before(k) and not (self.kind(k) == "sign" and t in (".", "?", ":", "??", "&&", "||", "+", "-", "*", "/", "==", "!=", "<", ">", "=")) and not (self.kind(k - 1) == "sign" and self.t(k - 1) not in (")", "]", "}", "?", "!", ">")):
                break
            k += 1
        return k

    def decl(self, name: str, kind: str, conforms: list[str], k: int, attrs: list, wrappers: list[str], scope: str | None, via: str | None) -> None:
        self.facts.decls.append({"name": name, "kind": kind, "conforms": conforms, "line": self.line_of(self.at(k)), "attributes": [a for a, _, _ in attrs], "wrappers": wrappers, "scope": scope, "via": via})

    def function(self, begin: int, k: int, attrs: list) -> int:
        name, j = self.t(k + 1), k + 2
        if self.kind(k + 1) != "name":
            while self.kind(j) == "sign" and self.t(j) != "(":
                name, j = name + self.t(j), j + 1
        j = self.generic_end(j)
        if self.t(j) == "(" and j in self.match:
            self.type_spans.append((j, self.match[j]))
            j = self.match[j] + 1
        ret = ""
        while self.t(j) in ("async", "throws", "rethrows"):
            j += 1
        if self.t(j) == "->":
            stop = self.type_end(j + 1)
            ret = self.text[self.at(j + 1) : self.end(stop - 1)]
            self.type_spans.append((j, stop))
            j = stop
        self.emit_attributes(attrs, "func")
        if any(b in ret for b in BUILDERS):
            self.decl(name, "viewbuilder", [], k + 1, attrs, [], self.scope(), None)
        body = j if self.t(j) == "{" and j in self.match else None
        self.node("func", name, begin, self.match[body] if body is not None else j - 1, detail=ret)
        return j

    def type_decl(self, begin: int, k: int, attrs: list) -> int:
        word, first, j = self.t(k), k + 1, k + 2
        if self.kind(first) != "name" or word == "class" and self.t(first) in ("func", "var", "let", "subscript"):
            return k + 1
        while self.t(j) == "." and self.kind(j + 1) == "name":
            j += 2
        j = self.generic_end(j)
        name = base_name(self.text[self.at(first) : self.end(j - 1)])
        conforms: list[str] = []
        stop = j
        while stop < len(self.toks) and self.t(stop) != "{":
            if self.newline_before(stop) and self.t(stop) in ("struct", "class", "enum", "func", "var", "let", "import", "@", "}"):
                return j
            stop += 1
        if self.t(j) == ":":
            text = self.text[self.at(j) + 1 : self.at(stop)]
            text = re.split(r"\bwhere\b", text)[0]
            depth, part = 0, ""
            for ch in text + ",":
                depth += ch in "<([" and 1 or (-1 if ch in ">)]" else 0)
                if ch == "," and depth <= 0:
                    conforms += [part.strip()] if part.strip() else []
                    part = ""
                else:
                    part += ch
        self.type_spans.append((first, stop))
        end = self.match.get(stop, len(self.toks) - 1)
        outer = self.scope()
        self.scopes.append((end, name))
        self.emit_attributes(attrs, "extension" if word == "extension" else word)
        self.node("type", name, begin, min(end, len(self.toks) - 1), detail=",".join(conforms))
        kind = None
        for c in conforms:
            own = base_name(c)
            if own in COMPONENTS or own.endswith("Style"):
                kind = COMPONENTS.get(own, "style")
                break
        if kind:
            via = "extension" if word == "extension" else None
            self.decl(name, kind, conforms, first, [] if via else attrs, self.wrappers(stop, end), outer, via)
        return stop + 1

    def wrappers(self, open_at: int, close: int) -> list[str]:
        out, k = set(), open_at + 1
        while k < close:
            if self.t(k) == "@":
                attrs, j = self.attributes(k)
                while self.t(j) in _MODIFIERS:
                    j += 1
                if self.t(j) in ("var", "let"):
                    out.update(a for a, _, _ in attrs)
                k = max(j, k + 1)
            elif self.t(k) == "{" and k in self.match:
                k = self.match[k] + 1
            else:
                k += 1
        return sorted(out)

    # ---- the scan
    def run(self) -> Facts:
        for k, (kind, t, _) in enumerate(self.toks):
            if kind == "name" and t in _CONDITIONS and self.t(k - 1) != "." and self.t(k + 1) != ":":
                j = k + 1
                while j < len(self.toks):
                    if self.kind(j) == "sign" and self.t(j) in "([" and j in self.match:
                        j = self.match[j]
                    elif self.t(j) == "{":
                        self.condition_braces.add(j)
                        break
                    elif self.t(j) == "}" or self.t(j) == ";":
                        break
                    j += 1
                if self.t(j) == "{" and j in self.match and t in ("if", "guard"):
                    self.node(t, "", k, self.match[j], detail=_collapsed(self.text[self.end(k) : self.at(j)], HEAD))
        k, begin, attrs = 0, None, []
        while k < len(self.toks):
            while self.scopes and k > self.scopes[-1][0]:
                self.scopes.pop()
            kind, t, _ = self.toks[k]
            if t == "@" and kind == "sign" and self.kind(k + 1) == "name":
                begin = k if begin is None else begin
                more, j = self.attributes(k)
                attrs += more
                # Arguments of attributes hold expressions, too.
                for inner in range(k, j):
                    self.expression(inner)
                k = j
                continue
            if kind == "name" and self.t(k - 1) != "." or kind == "sign":
                if t in _MODIFIERS and kind == "name":
                    begin = k if begin is None else begin
                    k += 1
                    if self.t(k) == "(" and self.t(k + 1) in ("set", "unsafe", "safe") and k in self.match:
                        k = self.match[k] + 1
                    continue
                if t == "import" and self.kind(k + 1) == "name":
                    j = k + 1
                    if self.t(j) in ("struct", "class", "enum", "protocol", "func", "var", "let", "typealias") and self.kind(j + 1) == "name":
                        j += 1
                    self.facts.imports.add(self.t(j))
                    k = j + 1
                    while self.t(k) == ".":
                        k += 2
                    begin, attrs = None, []
                    continue
                start = k if begin is None else begin
                if t in ("var", "let"):
                    k, begin, attrs = self.variable(start, k, attrs), None, []
                    continue
                if t == "func":
                    k, begin, attrs = self.function(start, k, attrs), None, []
                    continue
                if t in _TYPES and self.kind(k + 1) == "name" and self.t(k + 1) != ":":
                    if t == "class" and self.t(k + 1) in ("func", "var", "let", "subscript"):
                        begin, k = start, k + 1  # a class member
                        continue
                    k, begin, attrs = self.type_decl(start, k, attrs), None, []
                    continue
            begin, attrs = None, []
            self.expression(k)
            k += 1
        return self.facts

    def in_type(self, k: int) -> bool:
        return any(a <= k < b for a, b in self.type_spans[-6:])

    def expression(self, k: int) -> None:
        kind, t, at = self.toks[k]
        if self.in_type(k):
            return
        if kind == "string":
            for m in re.finditer(r"\\\(", t):  # code in interpolations
                depth, stop = 0, None
                for j in range(m.end() - 1, len(t)):
                    depth += t[j] == "(" and 1 or (-1 if t[j] == ")" else 0)
                    if not depth:
                        stop = j
                        break
                if stop:
                    inner = _Reader(t[m.end() : stop])
                    for o in inner.run().occurrences:
                        shift = self.line_of(at + m.end()) - 1
                        line = shift + o["line"]
                        self.facts.occurrences.append({**o, "line": line, "end_line": None if o["end_line"] is None else shift + o["end_line"], "scope": self.scope(), "col": self.col_of(at + m.end()) + o["col"] - 1 if o["line"] == 1 else o["col"]})
        elif t == "\\" and kind == "sign":
            j, last = k + 1, None
            if self.kind(j) == "name":
                j = self.generic_end(j + 1)
            while self.t(j) == "." or self.t(j) in ("?", "!") and self.t(j + 1) == ".":
                if self.t(j) != ".":
                    j += 1
                if self.kind(j + 1) != "name":
                    break
                last, j = self.t(j + 1), j + 2
            if last:
                self.emit(last, "keypath", k)
                self.type_spans.append((k, j))
        elif t == "#" and kind == "sign" and self.kind(k + 1) == "name" and self.end(k) == self.at(k + 1):
            if self.t(k + 1) not in _DIRECTIVES:
                self.emit(self.t(k + 1), "macro", k)
                called = self.call(k + 2)
                self.node("macro", self.t(k + 1), k, called[3] if called else k + 1, closures=called[4] if called else 0)
        elif t == "." and kind == "sign" and self.kind(k + 1) == "name":
            name = self.t(k + 1).strip("`")
            if name in ("self", "init"):
                return
            before = self.kind(k - 1)
            ended = k > 0 and (before in ("string", "number") or before == "name" and self.t(k - 1) not in _BEFORE or before == "sign" and self.t(k - 1) in (")", "]", "}", "?", "!", ">"))
            j = self.generic_end(k + 2)
            called = self.call(j)
            if called:
                end = self.line_of(self.at(called[2])) if called[2] >= 0 else self.line_of(self.at(k + 1))
                self.emit(name, "modifier", k + 1, implicit=not ended, args=called[0], trailing_closure=called[1], end_line=end, src=self.head(f".{name}", j, called))
                self.node("call", name, self.chain_start(k), called[3], labels=called[0], closures=called[4])
            else:
                self.emit(name, "member", k + 1, implicit=not ended)
        elif kind == "name" and t[:1].isupper() and self.t(k - 1) != "." and self.t(k - 1) not in ("@", "#"):
            j = self.generic_end(k + 1)
            called = self.call(j)
            if called:
                end = self.line_of(self.at(called[2])) if called[2] >= 0 else self.line_of(at)
                self.emit(t, "type", k, args=called[0], trailing_closure=called[1], end_line=end, src=self.head(t, j, called))
                self.node("call", t, k, called[3], labels=called[0], closures=called[4])

    def chain_start(self, k: int) -> int:
        """First token of the postfix chain whose dot is at k."""
        opener = {v: u for u, v in self.match.items()} if not hasattr(self, "_openers") else self._openers
        self._openers = opener
        while k > 0:
            p = k - 1
            if self.kind(p) == "sign" and self.t(p) in (")", "]", "}") and p in opener:
                k = opener[p]
            elif self.kind(p) == "sign" and self.t(p) in ("?", "!"):
                k = p
                continue
            elif self.kind(p) in ("name", "string", "number") and self.t(p) not in _BEFORE and not (self.newline_before(k) and self.t(k) != "."):
                k = p
                if self.t(k - 1) == ".":
                    k -= 1
                    continue
                return k
            else:
                return k
            if self.t(k - 1) == "." and self.kind(k - 1) == "sign":
                k -= 1
        return k


def read(text: str) -> Facts:
    """Facts of one file; an empty or null text has none."""
    return _Reader(text or "").run()
