"""Secret scan through a trigram index.

Every rule's regex is read into a Boolean query over the trigrams that any match must contain. A segment (a batch
of texts) is indexed once: the trigrams of all its texts are listed, and those that some query asks for get posting
lists of the texts that hold them. Queries intersect and unite posting lists; only texts that a rule's query lets
through are scanned with its regex. A rule without mandatory trigrams scans every text of the segment.

Index and query use the text's bytes with A-Z lowered. Where a regex ignores case beyond ASCII, letters that match
characters outside ASCII (k, s, i among them), like such characters themselves, are mandatory in no trigram, so no
match is missed.

Segments are local to a task: nothing is shuffled, and memory is one batch. Null and empty texts have no spans; long
texts are scanned whole; repeated rows and ids and null ids are rows like others; an empty table gives none. Spans that
start at one place stand in the order of rules. Other columns are left out, or kept as they are by `redact`.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astraloom.llm.common import map_batches, sliced

try:  # the name of the standard library's regex parser since 3.11
    from re import _parser as sre
except ImportError:  # pragma: no cover
    import sre_parse as sre


@dataclass(frozen=True)
class Rule:
    """A kind of secret; `keep` decides on a match (base rules drop failing matches after matching)."""

    kind: str
    pattern: str
    least: int = 0  # characters of the match, or of `group` if that is set
    group: int = 0
    base: bool = False


#: The base rules, in the order of kinds.
BASE_RULES = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20, 0, True),
    Rule("hex", r"[0-9a-f]+", 24, 0, True),
)
#: A private key from its BEGIN line to its END line; without one, to the last line of base64 (a short last line included).
PEM = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[^-]*(?:-(?!----)[^-]*)*-----END [A-Z ]{0,40}PRIVATE KEY-----"
    r"|(?:\s+[A-Z][A-Za-z-]+: [^\n]*)*(?:(?:\s|\\[nr])+[A-Za-z0-9+/]{16,}={0,2}(?![A-Za-z0-9+/=]))+(?:\r?\n[A-Za-z0-9+/]+={0,2}(?=[ \t\r]*(?:\n|\Z)))?|)"
)
#: Further kinds, by the public formats of common credentials.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("apikey", r"sk-[A-Za-z0-9_-]{20,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", PEM),
    Rule("userinfo", r"[a-z]{2,12}://[A-Za-z0-9._~-]{1,64}:[^\s:/@]{3,128}@[A-Za-z0-9.-]+"),
)
RULES = BASE_RULES + MORE_RULES

#: Most strings that are followed exactly while a regex is read; beyond it the query is only less strict.
EXACT_MOST = 64
ALL: tuple = ("all",)


def _all_of(parts: list[tuple]) -> tuple:
    parts = list(dict.fromkeys(p for p in parts if p != ALL))
    return ALL if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _any_of(parts: list[tuple]) -> tuple:
    parts = list(dict.fromkeys(parts))
    return ALL if ALL in parts or not parts else parts[0] if len(parts) == 1 else ("or", *parts)


def _of_strings(strings: set[str]) -> tuple:
    """Any of the strings, each through all its trigrams."""
    return _any_of([_all_of([("tri", s[i : i + 3]) for i in range(len(s) - 2)]) for s in sorted(strings)])


@functools.cache
def folding_letters() -> frozenset[str]:
    """The ASCII letters that match a character outside ASCII when cases are ignored, as the regex engine itself has it."""
    outside = "".join(chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000)
    hits = "".join(re.findall("(?i)[a-z]", outside))
    return frozenset(c for c in "abcdefghijklmnopqrstuvwxyz" if re.search(f"(?i){c}", hits))


def _one(code: int, wide: bool) -> set[str] | None:
    """The character as the index has it, if the index tells it; wide: cases are ignored beyond ASCII."""
    c = chr(code)
    return {c.lower()} if c.isascii() and not (wide and c.lower() in folding_letters()) else None


def _class_members(items, wide: bool) -> set[str] | None:
    """The characters of a small class, lowered; None if it is large or negated, or the index does not tell them."""
    found: set[str] = set()
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            codes = range(arg, arg + 1)
        elif name == "RANGE" and arg[1] - arg[0] < 8:
            codes = range(arg[0], arg[1] + 1)
        else:
            return None
        for code in codes:
            if (own := _one(code, wide)) is None:
                return None
            found |= own
    return found if len(found) <= 8 else None


def _read(items, flags: int) -> tuple[set[str] | None, tuple]:
    """(exact strings or None, query) of a parsed sequence under the flags."""
    run: set[str] = {""}
    found: list[tuple] = []
    exact = True
    wide = bool(flags & re.IGNORECASE) and not flags & re.ASCII

    def cut() -> None:
        nonlocal run, exact
        found.append(_of_strings(run))
        run, exact = {""}, False

    for op, arg in items:
        name, strings, query = str(op), None, ALL
        if name == "LITERAL":
            strings = _one(arg, wide)
        elif name == "IN":
            strings = _class_members(arg, wide)
        elif name == "SUBPATTERN":
            strings, query = _read(arg[3], (flags | arg[1]) & ~arg[2])
        elif name == "ATOMIC_GROUP":
            strings, query = _read(arg, flags)
        elif name == "BRANCH":
            read = [_read(x, flags) for x in arg[1]]
            strings = set().union(*(s for s, _ in read)) if all(s is not None for s, _ in read) else None
            query = _any_of([_all_of([q, _of_strings(s)]) if s is not None else q for s, q in read])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inner = arg
            s, q = _read(inner, flags)
            if high == 1 and s is not None:
                strings = s | ({""} if low == 0 else set())
            elif low == high and s is not None and len(s) ** low <= EXACT_MOST:
                strings = {""}
                for _ in range(low):
                    strings = {a + b for a in strings for b in s}
            elif low:
                query = _all_of([q, _of_strings(s)]) if s is not None else q
        elif name in ("AT", "ASSERT", "ASSERT_NOT"):
            continue
        if strings is None:
            cut()
            found.append(query)
        else:
            joined = {a + b for a in run for b in strings}
            if len(joined) > EXACT_MOST:
                cut()
                joined = strings
            run = joined
    if exact:
        return run, _all_of(found)
    found.append(_of_strings(run))
    return None, _all_of(found)


def trigram_query(pattern: str) -> tuple:
    """The Boolean query: ("tri", t), ("and", ...), ("or", ...), or ALL where nothing is mandatory."""
    parsed = sre.parse(pattern)
    exact, query = _read(parsed, parsed.state.flags)
    return _all_of([query, _of_strings(exact)]) if exact is not None else query


def asked_trigrams(query: tuple) -> set[str]:
    return {query[1]} if query[0] == "tri" else set().union(*map(asked_trigrams, query[1:])) if query != ALL else set()


class Vocabulary:
    """The trigrams that some query asks for, numbered; `of` gives each 24-bit code its number, or -1."""

    def __init__(self, queries: list[tuple]):
        names = sorted(set().union(*map(asked_trigrams, queries)))
        self.number = {t: i for i, t in enumerate(names)}
        self.of = np.full(1 << 24, -1, np.int16 if len(names) < 1 << 15 else np.int32)
        for t, i in self.number.items():
            self.of[int.from_bytes(t.encode(), "big")] = i


class Segment:
    """Posting lists of a batch of texts (bytes, A-Z lowered): per trigram of the vocabulary the texts that hold it, ascending."""

    #: Bytes whose trigrams are listed at once.
    STRETCH = 1 << 20

    def __init__(self, texts: list[bytes], words: Vocabulary):
        self.words, self.n = words, len(texts)
        stops = np.cumsum(np.fromiter(map(len, texts), np.int64, self.n)) if texts else np.zeros(0, np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        met: list[np.ndarray] = []
        for at in range(0, len(data) - 2, self.STRETCH):
            part = data[at : at + self.STRETCH + 2].astype(np.int32)
            number = words.of[part[:-2] << 16 | part[1:-1] << 8 | part[2:]]
            place = np.flatnonzero(number >= 0)
            text = np.searchsorted(stops, place + at, "right")
            whole = place + at + 2 < stops[text]  # not across the end of a text
            met.append(np.unique(number[place[whole]].astype(np.int64) * self.n + text[whole]))
        pairs = np.unique(np.concatenate(met)) if met else np.zeros(0, np.int64)
        bounds = np.searchsorted(pairs, np.arange(len(words.number) + 1) * self.n)
        self.lists = [pairs[a:b] - k * self.n for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]

    def answer(self, query: tuple) -> np.ndarray | None:
        """The texts that satisfy the query, ascending; None for all."""
        if query == ALL:
            return None
        if query[0] == "tri":
            return self.lists[self.words.number[query[1]]]
        parts = [self.answer(part) for part in query[1:]]
        if query[0] == "or":
            return None if any(p is None for p in parts) else np.unique(np.concatenate(parts))
        found = None
        for part in sorted((p for p in parts if p is not None), key=len):  # the shortest first
            found = part if found is None else np.intersect1d(found, part, assume_unique=True)
        return found


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.compiled = [re.compile(r.pattern) for r in rules]
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.words = Vocabulary(self.queries)
        # what a regex cannot match shorter than its limit is not worth a step of Python
        self.fast = [re.compile(r"[0-9a-f]{24,}") if r.pattern == "[0-9a-f]+" and r.least == 24 else c for r, c in zip(rules, self.compiled, strict=True)]

    def scan(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """Per text its spans (start, rule, end) in code points, by start, then rule."""
        texts = [t or "" for t in texts]
        segment = Segment([t.encode("utf-8", "surrogatepass").lower() for t in texts], self.words)
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, regex, query) in enumerate(zip(self.rules, self.fast, self.queries, strict=True)):
            through = segment.answer(query)
            for i in range(len(texts)) if through is None else through.tolist():
                for m in regex.finditer(texts[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found[i].append((m.start(), k, m.end()))
        for spans in found:
            spans.sort()
        return found


def _joined(spans, rules) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in spans)


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_<kind> of each base kind, base_sha256 and spans as text."""
    bases = [k for k, r in enumerate(rules) if r.base]

    def make():
        scanner = Scanner(rules)

        def fn(batch: pa.RecordBatch) -> dict:
            found = scanner.scan(batch.column(1).to_pylist())
            base = [[x for x in spans if rules[x[1]].base] for spans in found]
            out = {id_col: batch.column(0)}
            for k in bases:
                out[f"n_{rules[k].kind}"] = [sum(x[1] == k for x in spans) for spans in base]
            out["base_sha256"] = [hashlib.sha256(_joined(spans, rules).encode()).hexdigest() for spans in base]
            out["spans"] = [_joined(spans, rules) for spans in found]
            return out

        return fn

    kind = docs.schema[id_col].dataType.simpleString()
    counts = ", ".join(f"n_{rules[k].kind} long" for k in bases)
    return map_batches(docs.select(id_col, text_col), f"{id_col} {kind}, {counts}, base_sha256 string, spans string", make)


def redacted(text: str | None, spans: list[tuple[int, int, int]], mask: Callable[[str], str], rules=RULES) -> str | None:
    """The text with each stretch that spans cover (overlaps joined) replaced by the mask of its first kind."""
    if not text or not spans:
        return text
    out, at, open_to, kind = [], 0, -1, ""
    start = -1
    for a, k, b in [*spans, (len(text) + 1, -1, len(text) + 1)]:
        if a >= open_to or k < 0:
            if start >= 0:
                out.append(mask(kind))
                at = open_to
            if k < 0:
                break
            out.append(text[at:a])
            start, open_to, kind = a, b, rules[k].kind
        else:
            open_to = max(open_to, b)
    out.append(text[at:])
    return "".join(out)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """All documents with all columns; secrets in the text become <kind>, and chars_col (if there) the new length."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        scanner = Scanner(rules)
        for batch in sliced(batches):
            texts = batch.column(at).to_pylist()
            new = [redacted(t, s, lambda kind: f"<{kind}>", rules) for t, s in zip(texts, scanner.scan(texts), strict=True)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    done = docs.mapInArrow(run, docs.schema)
    if chars_col and chars_col in names:
        kind = docs.schema[chars_col].dataType
        done = done.withColumn(chars_col, F.length(text_col).cast(kind))
    return done
