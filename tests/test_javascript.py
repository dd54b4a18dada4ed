"""The JavaScript lexer and what is found on its tokens."""

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from astraloom.functions import javascript, js_tokens

facts = lambda text, path="a.jsx": sorted((kind, name, text.count("\n", 0, at) + 1, more) for kind, name, at, more in javascript.facts_v2(path, text))
TAIL = "function after() {}\nclass Last {}\nif (a == b) c();\n"


@pytest.mark.parametrize(
    "head",
    [
        "export const A = () => <p>Don't stop</p>;\n", 'const r = /["]/;\n', "x = /[/'`]/.test(y) / 2;\n", "const t = `it's ${ {a: `'${b}`}['a'] } \"`;\n", "const u = <a title='\"' {...p}>it's {xs.map(x => <b key={x}>`{x}</b>)} <br/> don't</a>;\n",
        "const v = <>it's</>;\n", "a = b / c / '/*' ;\n", "if (x) /'/.test(y);\n", "// don't\n/* don't */\n", "s = 'unclosed\n", "const w = x < y && z > 1;\n", "f(<T,>(x) => x);\n", "const g = a ? <i>'</i> : <b>\"</b>;\n", "#!/usr/bin/env 'node\n",
        "const h = [...'`'], j = {...`\"`};\n", "y = a++ / 2; z = b / '\"'.length;\n", "return /don't/\n", "type X = Array<'a' | \"b\">;\n", "m = `${`${`'`}`}`;\n", "q = x => { return <p>{/* it's */}isn't</p> };\n",
    ],
)
def test_what_stands_behind_is_still_seen(head):
    lines = head.count("\n")
    found = facts(head + TAIL)
    assert ("function", "after", lines + 1, None) in found and ("class", "Last", lines + 2, None) in found
    assert (lines + 3, "JS_LOOSE_EQUALITY", "==") in javascript.reported("a.jsx", head + TAIL)
    assert {("function", "after"), ("class", "Last")} <= {x[:2] for x in javascript.facts("a.jsx", head + TAIL)}


#: Text, and the kinds and names it declares; {n} is a number of its own.
PIECES = [
    ("function f{n}(a, {{b}}, c = {{d: 1}}) {{ {inner} }}", [("function", "f{n}")]),
    ("async function g{n}() {{ {inner} }}", [("function", "g{n}")]),
    ("export default class C{n} extends B.D {{ static async m{n}(x) {{ {inner} }}\n  get p{n}() {{ return 1 }} }}", [("class", "C{n}"), ("method", "m{n}"), ("method", "p{n}")]),
    ("const h{n} = (a) => {{ {inner} }}, k{n} = function () {{ {inner} }}, no{n} = (1 + 2);", [("function", "h{n}"), ("function", "k{n}")]),
    ("let i{n} = async y => y;", [("function", "i{n}")]),
    ("const o{n} = {{ q{n}(x) {{ {inner} }}, r: function s() {{}} }};", [("method", "q{n}")]),
    ("import A, {{ B as C }} from 'mod{n}';", [("import", "mod{n}")]),
    ("const z{n} = require(\"req{n}\");", [("import", "req{n}")]),
    ("x = import('dyn{n}');", [("import", "dyn{n}")]),
    ("(function iife() {{ {inner} }})();", []),
    ("if (a) {{ {inner} }} else {{ {inner} }}", []),
    ("call(x => {{ {inner} }});", []),
    ("v = `a ${{ (() => {{ {inner} }})() }} function no() {{}} '`;", []),
    ("w = <div a=\"'\" b={{() => {{ {inner} }}}}>function no() {{'{{'}} it's</div>;", []),
    ("x = /function [/'] no\\(/.test(y);", []),
    ("// function no() {{}} '", []),
    ("/* class No {{ */", []),
    ("s = 'function no() {{ \\' ';", []),
    ("for (let i = 0; i < 3; i++) {{ {inner} }}", []),
]


def composed(r, depth, count):
    text, want = [], []
    for _ in range(r.randint(0, 3) if depth else r.randint(1, 8)):
        count[0] += 1
        n = count[0]
        piece, names = r.choice(PIECES)
        parts = piece.split("{inner}")
        inner = []
        for _ in parts[1:]:
            t, w = composed(r, depth + 1, count) if depth < 3 else ("", [])
            inner.append(t + "\n")
            want += w
        whole = parts[0].format(n=n)
        for t, p in zip(inner, parts[1:]):
            whole += t + p.format(n=n)
        text.append(whole)
        want += [(kind, name.format(n=n)) for kind, name in names]
    return "\n".join(text), want


def test_facts_of_composed_texts():
    """Statements within functions, classes, templates and tags, in any order: every declaration is found, nothing else is."""
    for seed in range(400):
        text, want = composed(random.Random(seed), 0, [0])
        assert sorted(x[:2] for x in javascript.facts_v2("a.jsx", text)) == sorted(want), text


def test_typescript():
    text = (
        "function g(a: number): { b: string } { return a; }\nabstract class A<T> extends B<T> implements C, D { async m<T>(x: T): Promise<void> { } abstract n(): void;\n get [Symbol.iterator]() { return 1 } x = foo(a)\n y() {} }\n"
        "import type { X } from './x';\nimport y = require('y');\nconst z: (a: number) => void = (a) => {}, w = <any>1;\nfunction over(a): string;\nfunction over(a): number;\nfunction over(a) { }\ninterface I { m(): void }\ndeclare function d(): void;\n"
    )
    assert facts(text, "a.ts") == sorted(
        [
            ("function", "g", 1, None), ("class", "A", 2, "extends B<T> implements C, D"), ("method", "m", 2, None), ("method", "[Symbol.iterator]", 3, None), ("method", "y", 4, None), ("import", "./x", 5, None), ("import", "y", 6, None),
            ("function", "z", 7, None), ("function", "over", 10, None),
        ]
    )


def test_arguments_and_places():
    text = "new require('no');\na.require('no');\nrequire('a' + b, 'z');\nrequire(`t`);\nexport { x } from 'no';\nexport function* gen() {}\nconst K = class L { p() {} };\nfunction twice() {}\nfunction twice() {}\nclass M { a() {} a() {}\n a() {} }\n"
    assert facts(text) == sorted([("import", "z", 3, None), ("method", "p", 7, None), ("function", "twice", 8, None), ("class", "M", 10, None), ("method", "a", 10, None), ("method", "a", 11, None)])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["'", '"', "`", "${", "{", "}", "(", ")", "<", "</", "/>", ">", "/", "\\", "[", "]", "\n", " ", "a", "function", "class", "=", "=>", "import", "async", ":", ",", ";", "*", "//", "<a ", "if", "const"]), max_size=60))
def test_any_text_is_read(parts):
    text = "".join(parts)
    for path in ("a.js", "a.ts"):
        found = js_tokens.lexed(text, path)
        assert all(a.end <= b.start for a, b in zip(found.tokens, found.tokens[1:])) and all(t.start < t.end for t in found.tokens)
        covered = {i for t in found.tokens for i in range(t.start, t.end)}
        assert all(text[i].isspace() for i in range(len(text)) if i not in covered)
        for strings in (True, False):
            blank = js_tokens.blanked(text, found, strings)
            assert len(blank) == len(text) and [i for i, c in enumerate(blank) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"]
        javascript.facts_v2(path, text)
        javascript.reported(path, text)


def test_work_is_linear_in_the_file():
    for make in (
        lambda n: "a == b;\n" * n, lambda n: "=/[" * n, lambda n: "`${" * n, lambda n: "async function f() {" * n, lambda n: "(" * n + "}" * n, lambda n: "(<a " * n, lambda n: "class A {" * n, lambda n: "const a = '" * n, lambda n: "class A { f(" * n,
        lambda n: "let a = (x, " * n, lambda n: "({ f() { return " * n, lambda n: "const a: b = c => d\n" * n, lambda n: "import a\n" * n, lambda n: "require(" * n,
    ):
        began = time.process_time()
        javascript.reported("a.js", make(40_000))
        javascript.facts_v2("a.js", make(40_000))
        assert time.process_time() - began < 12
    began = time.process_time()
    assert len(javascript.reported("a.js", "x == y;" * 400_000)) == 400_000
    assert time.process_time() - began < 30
