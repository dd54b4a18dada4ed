"""Tokens of JavaScript and TypeScript text: a pushdown lexer.

What a slash, a brace or an angle bracket means depends on where it stands, so a stack of frames is kept: brackets, blocks and object
literals, template literals and the code within them, tags and children of JSX and the code within those. A regular expression begins
where an operand is expected; after a closing parenthesis that depends on the word before the opening one, after a closing brace on
whether it closed a block. Work is linear in the text: a line on which one regular expression does not end has no further ones, quotes end
with their line, and a text whose JSX does not end is read once more without JSX.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # name, prop (behind a dot), num, str, op, re, comment, template (its text), text (of JSX), tag (a word of a JSX tag)
    start: int
    end: int
    word: str  # names and operators; in front of '{' the kind of brace (block, object, template, jsx); of strings the quote


class Lexed(NamedTuple):
    tokens: list[Token]
    templates: list[tuple[int, int]]  # where the outermost template literals lie, with their backticks


_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"#?(?:[^\W\d]|\$)[\w$]*")
_NUMBER = re.compile(r"\.?\d(?:[\w.]|(?<=[eE])[+-])*")
_STRING = {q: re.compile(rf"{q}(?:\\(?:\r\n|[\s\S])|[^\\\n{q}])*{q}?") for q in "'\""}
_REGEX = re.compile(r"/(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
_OPERATOR = re.compile(r"=>|\.\.\.|\?\.(?!\d)|===|!==|==|!=|<=|>=|&&|\|\||\?\?|\+\+|--|[-+*/%&|^!~<>=?:;,.@(){}\[\]]|.", re.DOTALL)
_TEMPLATE = re.compile(r"(?:\\[\s\S]|[^\\`$]|\$(?!\{))*")
_TAG = re.compile(r"[^\s=<>{}/'\"]+")
_ATTRIBUTE = {q: re.compile(f"{q}[^{q}]*{q}?") for q in "'\""}
_KIDS = re.compile(r"[^<{]+")
_ELEMENT = re.compile(r"<(?:>|(?:[^\W\d]|\$)[\w$.:-]*(?=[\s/>])(?!\s+extends\b))")
#: After these words an operand follows.
BEFORE_OPERAND = frozenset("return typeof case do else in instanceof new void delete throw yield await of default extends".split())
BEFORE_BLOCK = frozenset("else do try finally".split())
HEADS = frozenset("if while for with".split())
_CLOSED_BY = {")": "(", "]": "["}


def _wants_operand(last: Token | None, after: bool) -> bool:
    """Is an operand expected behind last? after: what its frame says if last closes one."""
    if last is None:
        return True
    if last.kind == "name":
        return last.word in BEFORE_OPERAND
    if last.kind == "op":
        return after if last.word in (")", "}") else last.word not in ("]", "++", "--")
    return False


def _brace(last: Token | None, label: bool, frame: str) -> str:
    """What an opening brace behind last opens."""
    if last is None or last.kind != "op":
        return "object" if last is not None and last.kind == "name" and last.word in BEFORE_OPERAND - BEFORE_BLOCK - {"extends"} else "block"
    if last.word == ":":
        return "block" if label else "object"
    if last.word[-1] == "{":
        return "object" if frame in ("jsx", "template") else "block"
    return "block" if last.word in (";", "}", ")", "=>", ">", "]") else "object"


def _lex(text: str, jsx: bool) -> tuple[Lexed, bool]:
    """What is found, and whether all JSX has ended."""
    out: list[Token] = []
    templates: list[tuple[int, int]] = []
    begun = [0, 0]  # templates that are open, where the outermost one began
    stack: list[list] = []  # [frame, what is behind its end: is an operand expected there?, is a case open?]
    last: Token | None = None
    after = label = False
    deaf = at = 0  # deaf: no regular expression begins before here
    n = len(text)

    def add(kind: str, end: int, word: str = "", real: bool = True) -> None:
        nonlocal at, last
        token = Token(kind, at, end, word)
        out.append(token)
        at = end
        if real:
            last = token

    if text.startswith("#!"):
        add("comment", n if (end := text.find("\n")) < 0 else end, real=False)
    while at < n:
        frame = stack[-1][0] if stack else "block"
        if frame == "quasi":  # text of a template
            end = _TEMPLATE.match(text, at).end()
            if end > at:
                add("template", end, real=False)
            if at < n and text[at] == "`":
                stack.pop()
                add("str", at + 1, "`")
                begun[0] -= 1
                if not begun[0]:
                    templates.append((begun[1], at))
            elif at < n:
                add("op", at + 2, "template{")
                stack.append(["template", False, False])
            continue
        if frame == "kids" and text[at] not in "<{":
            add("text", _KIDS.match(text, at).end(), real=False)
            continue
        if space := _SPACE.match(text, at):
            at = space.end()
            continue
        c = text[at]
        if c == "/" and frame != "kids" and text[at + 1 : at + 2] in ("/", "*") and (frame not in ("tag", "end") or text[at + 1] == "*"):
            line = text[at + 1] == "/"
            end = text.find("\n" if line else "*/", at + 2)
            add("comment", n if end < 0 else end if line else end + 2, real=False)
            continue
        if frame in ("tag", "end", "kids"):
            if c == "{":
                add("op", at + 1, "jsx{")
                stack.append(["jsx", False, False])
            elif frame == "kids":
                end_tag = text.startswith("</", at)
                add("op", at + 1 + end_tag, "<")
                stack.append(["end" if end_tag else "tag", False, False])
            elif c in "'\"":
                add("tag", _ATTRIBUTE[c].match(text, at).end())
            elif c == ">":
                stack.pop()
                if frame == "tag":
                    stack.append(["kids", False, False])
                elif stack:
                    stack.pop()  # the children that end here
                add("num", at + 1)  # an element is an operand
            elif c == "/" and text.startswith("/>", at):
                stack.pop()
                add("num", at + 2)
            else:
                m = _TAG.match(text, at)
                add("tag", m.end() if m else at + 1)
            continue
        if m := _NAME.match(text, at):
            word = m[0]
            if stack and word in ("case", "default") and not (last and last.word in (".", "?.")):
                stack[-1][2] = True
            add("prop" if last and last.word in (".", "?.") else "name", m.end(), word)
            continue
        if m := _NUMBER.match(text, at):
            add("num", m.end())
            continue
        if c in "'\"":
            add("str", _STRING[c].match(text, at).end(), c)
            continue
        if c == "`":
            if not begun[0]:
                begun[1] = at
            begun[0] += 1
            add("str", at + 1, "`")
            stack.append(["quasi", False, False])
            continue
        operand = _wants_operand(last, after)
        if c == "/" and operand and at >= deaf:
            if m := _REGEX.match(text, at):
                add("re", m.end())
                continue
            deaf = n if (end := text.find("\n", at)) < 0 else end
        if c == "<" and jsx and operand and not (last and last.word == "}") and _ELEMENT.match(text, at):
            add("op", at + 1, "<")
            stack.append(["tag", False, False])
            continue
        word = _OPERATOR.match(text, at)[0]
        if word == "{":
            kind = _brace(last, label, frame)
            add("op", at + 1, f"{kind}{{")
            stack.append([kind, kind == "block", False])
        elif word in "([":
            stack.append([word, word == "(" and last is not None and last.kind == "name" and last.word in HEADS, False])
            add("op", at + 1, word)
        elif word in ")]}":
            # a bracket without its partner is passed over; a brace ends what was left open within
            opened = ("block", "object", "template", "jsx") if word == "}" else (_CLOSED_BY[word],)
            after = False
            while word == "}" and stack and stack[-1][0] in ("(", "["):
                stack.pop()
            if stack and stack[-1][0] in opened:
                after = stack.pop()[1]
            add("op", at + 1, word)
        else:
            label = word == ":" and bool(stack) and stack[-1][2]
            if label or word == ";" and stack:
                stack[-1][2] = False
            add("op", at + len(word), word)
    if begun[0]:
        templates.append((begun[1], n))
    return Lexed(out, templates), not any(x[0] in ("tag", "end", "kids") for x in stack)


def lexed(text: str, path: str = "") -> Lexed:
    """All tokens of the text, comments too. Angle brackets are no JSX in .ts files, and nowhere in a text whose JSX does not end."""
    if path.endswith((".ts", ".mts", ".cts")):
        return _lex(text, False)[0]
    found, ended = _lex(text, True)
    return found if ended else _lex(text, False)[0]


_VISIBLE = re.compile(r"[^\n]")


def blanked(text: str, found: Lexed, strings: bool = True) -> str:
    """The text with comments, regular expressions and the text of JSX as spaces, and with `strings` what stands between quotes; line ends stay.

    Templates are blanked whole, with the code in them; quotes and the slashes of regular expressions stay."""
    parts: list[str] = []
    at = 0

    def space(low: int, high: int) -> None:
        nonlocal at
        parts.extend((text[at:low], _VISIBLE.sub(" ", text[low:high])))
        at = high

    templates = iter(found.templates if strings else ())
    begin, end = next(templates, (len(text), len(text)))
    for t in found.tokens:
        if t.start >= end:
            begin, end = next(templates, (len(text), len(text)))
        if t.start >= begin:
            if t.start == begin:
                space(begin + 1, max(begin + 1, end - (text[end - 1] == "`")))
            continue
        if t.kind == "str" and strings:
            space(t.start + 1, max(t.start + 1, t.end - (text[t.end - 1] == t.word)))
        elif t.kind == "re":
            space(t.start + 1, text.rindex("/", t.start, t.end))
        elif t.kind in ("comment", "text"):
            space(t.start, t.end)
    parts.append(text[at:])
    return "".join(parts)
