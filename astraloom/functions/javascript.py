"""Facts and rules of JavaScript files.

A file is read once into tokens (`js_tokens`). Comments, strings, regular expressions and the text of JSX are blanked with
lengths and line breaks kept, so offsets are those of the file and lines are true; the rules are regular expressions over
the blanked text. Work is linear in the file and its matches.

Facts come from one of two engines: `v1` knows import and require statements, functions, arrows and classes at the
beginning of a line of blanked text; `v2` walks the tokens with their scopes and also knows dynamic imports, require
anywhere, function expressions and methods, takes a function's name once a file, and keeps the heritage of a class as it
is written. Declarations need a body, and function and class expressions declare nothing but what they are assigned to.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astraloom.functions.js_tokens import BEFORE_OPERAND, Lexed, Token, blanked, lexed

#: What an import, a function, a class and the reported constructs look like.
IMPORTS = tuple(
    re.compile(p, re.MULTILINE)
    for p in (
        r"""^[ \t]*import\s+\w+\s+from\s+['"]([^'"]+)['"]""",
        r"""^[ \t]*import\s+\{[^}]+\}\s+from\s+['"]([^'"]+)['"]""",
        r"""^[ \t]*import\s+\*\s+as\s+\w+\s+from\s+['"]([^'"]+)['"]""",
        r"""^[ \t]*import\s+['"]([^'"]+)['"]""",
        r"""(?:const|let|var)\s+(?:\{[^}]+\}|\w+)\s*=\s*require\(\s*['"]([^'"]+)['"]""",
    )
)
FUNCTION = re.compile(r"^[ \t]*(?:export\s+(?:default\s+)?)?(?:async\s+)?function\s+(\w+)\s*\(", re.MULTILINE)
ARROW = re.compile(r"^[ \t]*(?:export\s+(?:default\s+)?)?const\s+(\w+)\s*=\s*(?:async\s+)?\(?[^)]*\)?\s*=>", re.MULTILINE)
CLASS = re.compile(r"^[ \t]*(?:export\s+(?:default\s+)?)?class\s+(\w+)(?:\s+extends\s+(\w+))?", re.MULTILINE)
#: What a rule reports.
REPORTED = {
    "JS_VAR_DECLARATION": r"(?m)^[ \t]*var\s+\w",
    "JS_LOOSE_EQUALITY": r"(?<![=!<>])(?:==|!=)(?!=)",
    "JS_CONSOLE_LOG": r"\bconsole\.log\s*\(",
    "JS_USEEFFECT_NO_DEPS": r"useEffect\s*\(\s*(?:\([^)]*\)\s*=>|function\s*\([^)]*\))[^,)]*\)",
    "JS_BARE_CATCH": r"catch\s*\(\s*\w*\s*\)\s*\{\s*\}",
    "JS_MISSING_KEY_PROP": r"\.map\s*\(\s*(?:\([^)]*\)|[a-zA-Z_]\w*)\s*=>\s*(?:\(\s*)?<\w+[^/>]*?(?<!key=)\s*>",
}
#: A key within so many characters behind the element is good enough.
KEY_WITHIN = 200
NAMED = {"JS_VAR_DECLARATION": "var", "JS_CONSOLE_LOG": "console.log", "JS_USEEFFECT_NO_DEPS": "useEffect", "JS_BARE_CATCH": "catch", "JS_MISSING_KEY_PROP": "map"}
#: Fixed value: an async function that should guard its awaits.
ASYNC = re.compile(r"async\s+function\s+(\w+)|const\s+(\w+)\s*=\s*async\s*\([^)]*\)\s*=>")
SEVERITY = {
    "JS_VAR_DECLARATION": "low", "JS_LOOSE_EQUALITY": "med", "JS_CONSOLE_LOG": "low", "JS_USEEFFECT_NO_DEPS": "med",
    "JS_BARE_CATCH": "med", "JS_MISSING_KEY_PROP": "med", "JS_ASYNC_NO_CATCH": "low",
}
TEST_PATH = r"/test|tests/|/__tests__/|\.test\.|\.spec\."


def _partners(text: str) -> dict[int, int]:
    """Where each opening brace is closed."""
    open_, found = [], {}
    for m in re.finditer("[{}]", text):
        if m[0] == "{":
            open_.append(m.start())
        elif open_:
            found[open_.pop()] = m.start()
    return found


def unguarded(code: str) -> list[tuple[int, str]]:
    """(offset, name) of the async functions of blanked text whose body neither tries nor catches."""
    out, partners = [], None
    for m in ASYNC.finditer(code):
        if partners is None:
            partners, guards = _partners(code), [(x.start(), x.end()) for x in re.finditer("try|catch", code)]
        start = code.find("{", m.end())
        if start < 0:
            break
        k = bisect_left(guards, (start, 0))
        if k == len(guards) or guards[k][1] > partners.get(start, len(code)) + 1:
            out.append((m.start(), m[1] or m[2]))
    return out


def facts(path: str, text: str) -> list[tuple[str, str, int, str | None]]:
    """(kind, name, offset, extends) of imports, functions and classes."""
    found = lexed(text, path)
    code, bare = blanked(text, found, strings=False), blanked(text, found)
    lead = lambda m: m.start() + len(m[0]) - len(m[0].lstrip(" \t"))
    out = [("import", m[1], lead(m), None) for p in IMPORTS for m in p.finditer(code)]
    out += [("function", m[1], lead(m), None) for p in (FUNCTION, ARROW) for m in p.finditer(bare)]
    return out + [("class", m[1], lead(m), m[2]) for m in CLASS.finditer(bare)]


#: Words in front of a member's name.
MODIFIERS = frozenset("static async get set public private protected override readonly abstract".split())
_OPENERS = ("(", "[", "block{", "object{", "template{", "jsx{")


class Scopes:
    """The tokens of a file that are no comments, with each bracket's partner and the bracket around every token."""

    def __init__(self, text: str, found: Lexed):
        self.text = text
        self.tokens: list[Token] = [t for t in found.tokens if t.kind not in ("comment", "template", "text", "tag")]
        self.partner: dict[int, int] = {}
        self.around: list[int] = []  # -1: none
        self.classes: set[int] = set()  # braces of class bodies
        open_: list[int] = []
        for k, t in enumerate(self.tokens):
            closes = t.kind == "op" and t.word in (")", "]", "}")
            if closes and open_:
                while t.word == "}" and len(open_) > 1 and self.tokens[open_[-1]].word in ("(", "["):
                    open_.pop()
                if (self.tokens[open_[-1]].word[-1], t.word) in (("(", ")"), ("[", "]"), ("{", "}")):
                    self.partner[open_.pop()] = k
            self.around.append(open_[-1] if open_ else -1)
            if t.kind == "op" and t.word in _OPENERS:
                open_.append(k)

    def word(self, k: int) -> str:
        return self.tokens[k].word if 0 <= k < len(self.tokens) and self.tokens[k].kind in ("name", "op", "prop") else ""

    def behind(self, k: int) -> int:
        """The place behind the bracket at k."""
        return self.partner.get(k, len(self.tokens)) + 1

    def type_end(self, k: int, stops: tuple[str, ...]) -> int:
        """From k over a type to the first of stops outside brackets, or to where no type goes on."""
        depth, last = 0, ":"
        while k < len(self.tokens):
            t = self.tokens[k]
            if t.kind == "op":
                if depth <= 0 and t.word in stops and not (t.word == "block{" and last in (":", "|", "&", "=>")):
                    return k
                if t.word in _OPENERS:
                    k = self.behind(k)
                    last = ")"
                    continue
                if t.word in (")", "]", "}", ";"):
                    return k
                depth += (t.word == "<") - (t.word == ">")
            last = t.word
            k += 1
        return k

    def body(self, k: int) -> bool:
        """Do a result type, if any, and a body follow at k?"""
        if self.word(k) == ":":
            k = self.type_end(k + 1, ("block{", "object{", "=>", "=", ","))
            # an object type may stand in front of the body
        return self.word(k) in ("block{", "object{")

    def parameters(self, k: int) -> int:
        """The place behind type parameters and the parenthesis at k, or 0."""
        if self.word(k) == "<":
            k = self.type_end(k + 1, ("(", ">"))
            k += self.word(k) == ">"
        return self.behind(k) if self.word(k) == "(" else 0

    def statement(self, k: int) -> bool:
        """Does a statement begin at k? Two operands do not follow each other, so it does behind one."""
        while k > 0 and self.word(k - 1) in ("export", "default", "async", "declare", "abstract") and self.tokens[k - 1].kind == "name":
            if self.word(k - 1) in ("export", "default"):
                return True
            k -= 1
        if k == 0:
            return True
        t = self.tokens[k - 1]
        if t.kind == "op":
            return t.word in (";", "}", ")", "block{", "]") or t.word == ":" and self.word(self.around[k]) == "block{"
        return t.kind != "name" or t.word in ("else", "do") or t.word not in BEFORE_OPERAND

    def function_value(self, k: int) -> bool:
        """Is what begins at k a function or an arrow function?"""
        k += self.word(k) == "async" and self.word(k + 1) != "=>"
        if self.word(k) == "function":
            return self.word(k + 1) != "*"
        if self.tokens[k : k + 1] and self.tokens[k].kind == "name" and self.word(k + 1) == "=>":
            return True
        end = self.parameters(k) if self.word(k) in ("(", "<") else 0
        if end and self.word(end) == ":":
            end = self.type_end(end + 1, ("=>", "=", ",", "?", ":"))
        return bool(end) and self.word(end) == "=>"

    def quoted(self, k: int) -> str | None:
        t = self.tokens[k] if k < len(self.tokens) else None
        return self.text[t.start + 1 : t.end - 1] if t and t.kind == "str" and t.word != "`" and t.end - t.start > 2 and self.text[t.end - 1] == t.word else None

    def argument(self, k: int) -> str | None:
        """The first argument of the call whose parenthesis is at k that is a string and nothing else."""
        end = self.partner.get(k, len(self.tokens))
        while k < end:
            if self.tokens[k + 1 : k + 2] and self.word(k + 2) in (",", ")") and (name := self.quoted(k + 1)) is not None:
                return name
            k += 1
            while k < end and self.word(k) != ",":
                k = self.behind(k) if self.word(k) in _OPENERS else k + 1
        return None


def facts_v2(path: str, text: str) -> list[tuple[str, str, int, str | None]]:
    """(kind, name, offset, heritage); kind is import, function, class or method."""
    s = Scopes(text, lexed(text, path))
    out: list[tuple[str, str, int, str | None]] = []
    functions: list[tuple[int, str]] = []
    methods: list[tuple[int, str, int]] = []
    for k, t in enumerate(s.tokens):
        follows = s.word(k + 1)
        if t.kind == "name" and t.word == "import" and follows not in ("(", ".", ":"):
            if s.statement(k):
                end = k + 1
                while end < len(s.tokens) and s.tokens[end].kind != "str" and s.word(end) != ";" and not (s.tokens[end].kind == "name" and s.word(end) in ("import", "export", "function", "class", "const", "let", "var")):
                    end += 1
                if name := s.quoted(end):
                    out.append(("import", name, t.start, None))
        elif t.kind == "name" and t.word in ("require", "import") and follows == "(" and s.word(k - 1) not in ("function", "new") and not s.body(s.behind(k + 1)):
            statement_of = s.word(k - 1) == "=" and s.word(k - 3) == "import"  # import x = require("y") is there already
            if not statement_of and (name := s.argument(k + 1)):
                out.append(("import", name, t.start, None))
        elif t.kind == "name" and t.word == "function" and s.tokens[k + 1 : k + 2] and s.tokens[k + 1].kind == "name" and s.statement(k):
            end = s.parameters(k + 2)
            if end and s.body(end):
                functions.append((t.start, s.tokens[k + 1].word))
        elif t.kind == "name" and t.word in ("const", "let", "var") and s.tokens[k + 1 : k + 2] and (s.tokens[k + 1].kind == "name" or s.word(k + 1) in _OPENERS):
            at, home = k + 1, s.around[k]
            while at < len(s.tokens):
                name = s.tokens[at]
                value = s.behind(at) if s.word(at) in _OPENERS else at + 1
                if s.word(value) == ":":
                    value = s.type_end(value + 1, ("=", ",", ";"))
                if s.word(value) == "=" and name.kind == "name" and s.function_value(value + 1):
                    functions.append((name.start, name.word))
                # to the next declarator: a comma outside brackets; a line's end ends the statement where an operand ends
                while value < len(s.tokens) and s.word(value) not in (",", ";", ")", "]", "}"):
                    value = s.behind(value) if s.word(value) in _OPENERS else value + 1
                    if value < len(s.tokens) and s.tokens[value].kind == "name" and s.word(value) in ("const", "let", "var", "function", "class", "import", "export", "if", "for", "while", "return") and s.word(value - 1) not in ("=", "async"):
                        break
                at = value + 1
                if s.word(value) != "," or s.around[value] != home:
                    break
        elif t.kind == "name" and t.word == "class":
            named = s.tokens[k + 1 : k + 2] and s.tokens[k + 1].kind == "name" and s.word(k + 1) not in ("extends", "implements")
            at = k + 1 + bool(named)
            if s.word(at) == "<":
                at = s.type_end(at + 1, (">",)) + 1
            begin = at
            while at < len(s.tokens) and s.word(at) not in ("block{", "object{", ";"):
                at = s.behind(at) if s.word(at) in ("(", "[") else at + 1
            if s.word(at) in ("block{", "object{"):
                s.classes.add(at)
                if named and s.statement(k):
                    heritage = text[s.tokens[begin].start : s.tokens[at].start].strip() if begin < at else ""
                    out.append(("class", s.tokens[k + 1].word, t.start, heritage or None))
        if t.kind in ("name", "str", "num") or t.word == "]":
            home = s.around[k]
            if home >= 0 and (home in s.classes or s.word(home) == "object{") and follows in ("(", "<") and t.word != "function" and s.word(k - 1) != "function" and not (s.word(k - 1) == "*" and s.word(k - 2) == "function"):
                end = s.parameters(k + 1)
                if end and s.body(end):
                    first, name = k, text[t.start : t.end]
                    if t.word == "]" and (opener := next((j for j in range(k - 1, home, -1) if s.partner.get(j) == k), 0)):
                        first, name = opener, text[s.tokens[opener].start : t.end]
                    while first - 1 > home and (s.word(first - 1) in MODIFIERS or s.word(first - 1) == "*"):
                        first -= 1
                    methods.append((s.tokens[first].start, name, t.start))
    seen: set[str] = set()
    for at, name in sorted(functions):
        if name not in seen:
            seen.add(name)
            out.append(("function", name, at, None))
    lines, line, last = set(), 1, 0
    for at, name, _ in sorted(methods):
        line, last = line + text.count("\n", last, at), at
        if (name, line) not in lines:
            lines.add((name, line))
            out.append(("method", name, at, None))
    return out


def _mapped(files: DataFrame, fn, names: tuple[str, ...]) -> DataFrame:
    """path and the columns that fn finds in every file; line is a number, the rest are words."""
    schema = pa.schema([("path", pa.string()), *((n, pa.int64() if n == "line" else pa.string()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(path, *x) for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in fn(path or "", text or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    sql = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in schema)
    return files.select("path", "content").mapInArrow(run, sql)


def reported(path: str, text: str) -> list[tuple[int, str, str]]:
    """(line, rule, symbol) of what the rules report in a file."""
    code = blanked(text, lexed(text, path))
    found: list[tuple[int, str, str]] = []
    for rule, pattern in _COMPILED.items():
        if rule == "JS_CONSOLE_LOG" and re.search(TEST_PATH, path.lower()):
            continue
        for m in pattern.finditer(code):
            if rule != "JS_MISSING_KEY_PROP" or code.find("key=", m.end(), m.end() + KEY_WITHIN) < 0:
                found.append((m.start(), rule, m[0] if rule == "JS_LOOSE_EQUALITY" else NAMED[rule]))
    found += [(at, "JS_ASYNC_NO_CATCH", name) for at, name in unguarded(code)]
    out, line, last = [], 1, 0
    for at, rule, symbol in sorted(found):
        line, last = line + code.count("\n", last, at), at
        out.append((line, rule, symbol))
    return out


_COMPILED = {rule: re.compile(pattern) for rule, pattern in REPORTED.items()}


def js_findings(files: DataFrame) -> DataFrame:
    """tier, path, line, rule, severity, symbol of the JavaScript files."""
    found = _mapped(files, reported, ("line", "rule", "symbol"))
    severity = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    return found.select(F.lit("lint").alias("tier"), "path", "line", "rule", severity[F.col("rule")].alias("severity"), "symbol")


ENGINES = {"v1": facts, "v2": facts_v2}


def js_nodes(files: DataFrame, engine: str = "v1") -> DataFrame:
    """path, kind, name, line, extends of the JavaScript files' imports, functions, classes and (v2) methods."""
    facts_of = ENGINES[engine]

    def fn(path: str, text: str) -> list[tuple]:
        out, line, last = [], 1, 0
        for at, kind, name, extends in sorted(((at, kind, name, extends) for kind, name, at, extends in facts_of(path, text)), key=lambda x: x[0]):
            line, last = line + text.count("\n", last, at), at
            out.append((kind, name, line, extends))
        return out

    return _mapped(files, fn, ("kind", "name", "line", "extends"))


def js_graph(files: DataFrame, engine: str = "v1") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with ids of their own grammar: file::, fn::, class::; imports stay module:: and resolve to nothing."""
    found = js_nodes(files, engine)
    whole = files.select(F.concat(F.lit("file::"), "path").alias("id"), F.lit("file").alias("type"), "path", F.element_at(F.split("path", "/"), -1).alias("name"), F.lit(1).cast("long").alias("line_start"), F.lit(None).cast("string").alias("parent_id"), F.lit(None).cast("string").alias("docstring"))
    kind = F.when(F.col("kind") == "class", "class").otherwise("function")
    # methods of one name are told apart by their lines
    own = F.when(F.col("kind") == "method", F.concat(F.lit("method:"), "name", F.lit("@"), "line")).otherwise(F.col("name"))
    doc = F.col("extends") if engine == "v2" else F.concat(F.lit("extends "), "extends")
    inner = found.filter("kind <> 'import'").select(
        F.concat(F.when(kind == "class", "class::").otherwise("fn::"), "path", F.lit("::"), own).alias("id"), kind.alias("type"), "path", "name", F.col("line").alias("line_start"),
        F.concat(F.lit("file::"), "path").alias("parent_id"), doc.alias("docstring"),
    )
    edges = found.filter("kind = 'import'").select(F.concat(F.lit("file::"), "path").alias("source"), F.concat(F.lit("module::"), "name").alias("target"), F.lit("import").alias("type"), "line")
    return whole.unionByName(inner), edges


def merged(nodes: DataFrame, edges: DataFrame, js_nodes: DataFrame, js_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The map's nodes and edges with those of the JavaScript files behind them: appended after resolution, so ids of the two never meet and counts of the map stay those of Python."""
    return nodes.select("id", "type", "path", "name", F.col("line_start").cast("long").alias("line_start"), "parent_id", "docstring").unionByName(js_nodes), edges.select("source", "target", "type", F.col("line").cast("long").alias("line")).unionByName(js_edges)
