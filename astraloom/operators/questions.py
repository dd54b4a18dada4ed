"""Questions for a reviewer, derived from facts; answers come from an injected function.

Every generator is a query that yields path, start_line, end_line, symbol, question and snippet. `functions` are all
function definitions of a file, nested ones too, with their text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from astraloom.functions.calls import Client, Limits, ask_all
from astraloom.functions.tables import cut, dealt, numbered, sql
from astraloom.functions.words import mentions
from astraloom.operators.lint import DEFS, UNDER

QUERY_WORDS = "query|filter|select|execute|[.]all[(][)]|[.]first[(][)]"
DISPATCH = "ensure_future|create_task|asyncio[.]gather|run_in_executor"
WRITE_WORDS = "pikepdf|write|save|set_alt|apply|remediat"
FIELD_WORDS = "alt[.]text|alt_text"
#: Limits that one file enforces and others may bypass; claims of a notes file and where they belong.
LIMITS = (("[:147]", "150-char truncation"), ("[:125]", "125-char truncation"))
CLAIMS = (("MAX_RETRIES", "link_checker"), ("Semaphore", "link_checker"), ("deleted_at", "ada_checker"), ("cli.py", "cli"))
SNIPPET = 3000

_FUNCTIONS = f"""functions AS (SELECT d.path, d.name, d.line, d.depth, d.pre, coalesce(d.end_line, d.line) AS end_line,
  array_join(slice(split(f.content, '\\r\\n|\\n|\\r'), d.line, coalesce(d.end_line, d.line) - d.line + 1), '\\n') AS text FROM n d JOIN f ON f.path = d.path WHERE d.kind IN {DEFS})"""
_OUT = "path, CAST({0} AS BIGINT) AS start_line, CAST({1} AS BIGINT) AS end_line, {2} AS symbol, '{3}' AS signal, {4} AS snippet"
_FN = _OUT.format("line", "end_line", "name", "{0}", "text")


def _graph_functions(where: str) -> str:
    """Functions of the graph with their text."""
    return f"""SELECT d.path, d.name, d.line_start AS line, d.line_end AS end_line, d.seq, array_join(slice(split(f.content, '\\r\\n|\\n|\\r'), d.line_start, d.line_end - d.line_start + 1), '\\n') AS text
FROM nodes d JOIN f ON f.path = d.path WHERE d.type {where}"""


#: What generators look for in texts first: of each name the words, the texts as rows with a column `text`, and that column. `mentions` gives the
#: generator a frame of that name, with `found`.
SOUGHT: dict[str, dict[str, tuple[str, str]]] = {
    "soft_delete": {
        "asking": (
            """SELECT DISTINCT t FROM (SELECT d.path, explode(d.tables) AS t FROM nodes d WHERE d.type = 'file') x JOIN f ON f.path = x.path
WHERE contains(f.content, 'deleted_at') AND contains(f.content, '__tablename__') AND NOT startswith(t, 'rel:') AND NOT contains(t, 'via')""",
            f"WITH {_FUNCTIONS} SELECT path, name, line, end_line, text, lower(text) AS words FROM functions LEFT SEMI JOIN f ON f.path = functions.path AND NOT contains(f.content, 'deleted_at') WHERE lower(text) RLIKE '{QUERY_WORDS}'",
        )
    },
    "constraints": {"marked": (" UNION ALL ".join(f"SELECT '{a}' AS word" for a, _ in LIMITS), "SELECT path, content AS words FROM f")},
    "claims": {
        "told": (" UNION ALL ".join(f"SELECT lower('{a}') AS word" for a, _ in CLAIMS), "SELECT lower(item) AS words FROM done"),
        "placed": (" UNION ALL ".join(f"SELECT '{b}' AS word" for _, b in CLAIMS), "SELECT path, parts, path AS words FROM f"),
    },
}
GENERATORS: dict[str, str] = {
    "connectivity": f"""
WITH g AS ({_graph_functions("= 'function'")}) SELECT {_FN.format('connectivity')} FROM g LEFT SEMI JOIN status s ON s.path = g.path AND s.status = 'incomplete'
WHERE (NOT startswith(name, '_') OR name = '__init__') AND length(text) >= 20""",
    "xref": f"""
WITH g AS ({_graph_functions("IN ('function', 'class')")}), w AS (SELECT g.*, row_number() OVER (PARTITION BY g.path, x.symbol ORDER BY g.seq) AS r FROM g JOIN xref_findings x
  ON x.rule = 'XREF_IMPORTED_NOT_CALLED' AND x.path = g.path AND x.symbol = element_at(split(g.name, '[.]'), -1))
SELECT {_FN.format('xref')} FROM w WHERE r = 1""",
    "soft_delete": f"SELECT DISTINCT {_FN.format('soft_delete')} FROM asking WHERE size(found) > 0",
    "expiry": f"WITH {_FUNCTIONS} SELECT {_FN.format('expiry')} FROM functions WHERE contains(lower(text), 'expires') AND text RLIKE 'datetime[.](now|utcnow)' AND NOT contains(text, 'timedelta')",
    "temporal": f"""
WITH {_FUNCTIONS} SELECT {_FN.format('temporal: commit')} FROM functions WHERE text RLIKE '{DISPATCH}' AND contains(text, '.commit()')
UNION ALL SELECT {_FN.format('temporal: close')} FROM functions WHERE text RLIKE '{DISPATCH}' AND contains(text, '.close()')""",
    "constraints": f"""
WITH {_FUNCTIONS}, enforced AS (SELECT m.path, l.what FROM (SELECT path, explode(found) AS mark FROM marked) m JOIN (VALUES {', '.join(f"('{a}', '{b}')" for a, b in LIMITS)}) AS l(mark, what) ON m.mark = l.mark),
limits AS (SELECT DISTINCT what FROM enforced),
w AS (SELECT /*+ BROADCAST(l) */ functions.*, l.what FROM functions CROSS JOIN limits l LEFT SEMI JOIN f ON f.path = functions.path AND lower(f.content) RLIKE '{WRITE_WORDS}' WHERE lower(text) RLIKE '{FIELD_WORDS}')
SELECT {_OUT.format('line', 'end_line', "concat(name, ': ', what)", 'constraints', 'text')} FROM w LEFT ANTI JOIN enforced e ON e.path = w.path AND e.what = w.what""",
    "claims": f"""
WITH c AS (SELECT l.* FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in CLAIMS)}) AS l(claim, place) LEFT SEMI JOIN (SELECT explode(found) AS claim FROM told) d ON d.claim = lower(l.claim)),
p AS (SELECT place, min_by(path, parts) AS path FROM (SELECT explode(found) AS place, path, parts FROM placed) GROUP BY place),
t AS (SELECT c.claim, c.place, p.path FROM c LEFT JOIN p ON p.place = c.place)
SELECT coalesce(t.path, concat('(missing: *', place, '*)')) AS path, CAST(IF(t.path IS NULL, 0, 1) AS BIGINT) AS start_line, CAST(IF(t.path IS NULL, 0, least(f.n_lines, 100)) AS BIGINT) AS end_line, claim AS symbol, 'claims' AS signal,
  IF(t.path IS NULL, 'FILE NOT FOUND', substr(f.content, 1, {SNIPPET})) AS snippet FROM t LEFT JOIN f ON f.path = t.path""",
    "contracts": f"""
WITH {_FUNCTIONS}, r AS (SELECT path, f AS pre, count(*) AS returns FROM {UNDER} WHERE kind = 'Return' AND exists(kids, k -> k.field = 'value') GROUP BY path, f),
w AS (SELECT x.*, r.returns, row_number() OVER (PARTITION BY x.path, x.name ORDER BY x.depth, x.pre) AS first FROM functions x JOIN usage u ON u.path = x.path AND u.name = x.name AND u.type = 'function' AND u.n_called >= 2 LEFT JOIN r ON r.path = x.path AND r.pre = x.pre)
SELECT {_FN.format('contracts')} FROM w WHERE first = 1 AND returns >= 2""",
    "error_handling": f"""
WITH g AS ({_graph_functions("= 'function'")}), raisers AS (SELECT element_at(split(name, '[.]'), -1) AS short, max_by(struct(path, line), seq) AS r FROM g WHERE contains(text, 'raise ') AND NOT contains(text, 'HTTPException') GROUP BY 1),
w AS (SELECT e.path, e.line, f.n_lines, f.content, f.parts, e.pre, r.short FROM edges e JOIN raisers r ON r.short = {{0}} JOIN f ON f.path = e.path WHERE e.type = 'call' AND e.path <> r.r.path AND contains(f.content, 'try'))
SELECT {_OUT.format('greatest(0, line - 5) + 1', 'least(n_lines, line + 10)', 'short', 'error_handling', "array_join(slice(split(content, '\\r\\n|\\n|\\r'), greatest(0, line - 5) + 1, 15), '\\n')")} FROM w ORDER BY parts, pre LIMIT 20""",
}
#: The frames that each generator reads.
NEEDS: dict[str, tuple[str, ...]] = {
    "connectivity": ("f", "nodes", "status"), "xref": ("f", "nodes", "xref_findings"), "soft_delete": ("n", "f", "nodes"), "expiry": ("n", "f"), "temporal": ("n", "f"),
    "constraints": ("n", "f"), "claims": ("f", "done"), "contracts": ("n", "f", "usage"), "error_handling": ("f", "nodes", "edges"),
}
#: As it stands the last segment of a resolved call is taken behind its last dot, so functions outside classes are never found; strict=False takes it behind the colon too.
_SHORT = {True: "element_at(split(replace(e.target, 'call:', ''), '[.]'), -1)", False: "element_at(split(e.target, '[.:]'), -1)"}


def ask(kind: str, strict: bool = True, **frames: DataFrame) -> DataFrame:
    """The questions of one generator; frames: n, f and what it names (nodes, edges, usage, status, xref_findings, done)."""
    text, spark = GENERATORS[kind].replace("{0}", _SHORT[strict]), next(iter(frames.values())).sparkSession
    sought = {name: mentions(sql(spark, texts, **frames), "words", sql(spark, words, **frames)) for name, (words, texts) in SOUGHT.get(kind, {}).items()}
    return sql(spark, text, **frames, **sought)


def shortened(snippet):
    """At most SNIPPET characters, cut at a line's end and marked."""
    head = F.substring(snippet, 1, SNIPPET)
    whole = F.regexp_extract(head, r"(?s)^(.+)\n", 1)
    return F.when(F.length(snippet) <= SNIPPET, snippet).when(whole == "", head).otherwise(F.concat(whole, F.lit("\n# [truncated]")))


def outermost(text: str | None) -> dict:
    """The JSON object from the first brace to the last; {} if there is none."""
    if not text or "{" not in text:
        return {}
    try:
        found = json.loads(text[text.index("{") : text.rindex("}") + 1])
        return found if isinstance(found, dict) else {}
    except ValueError:
        return {}


def verify(questions: DataFrame, client: Client, limits: Limits = Limits(), folder: str | None = None) -> DataFrame:
    """Findings from answers: client takes a prompt and returns text with a JSON object. No or false is a finding; no answer at all after all attempts is one tool failure.

    limits and folder are those of `calls.ask_all`.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            asked = list(batch.itertuples())
            answers = ask_all(client, [f"{q.path}:{q.start_line}-{q.end_line} {q.signal} {q.symbol}\n{q.snippet}" for q in asked], limits, folder)
            for q, answer in zip(asked, answers, strict=True):
                if answer is None:
                    out.append(("verified", q.path, q.start_line, "tool_failure", "high", q.symbol))
                elif str(outermost(answer).get("answer", "")).lower() in ("no", "false"):
                    out.append(("verified", q.path, q.start_line, q.signal, "high", q.symbol))
            yield pd.DataFrame(out, columns=["tier", "path", "line", "rule", "severity", "symbol"])

    found = questions.withColumn("snippet", shortened(F.col("snippet"))).mapInPandas(run, "tier string, path string, line long, rule string, severity string, symbol string")
    # one sentinel however many questions went unanswered
    failed = found.filter("rule = 'tool_failure'").groupBy("rule").agg(F.first("tier").alias("tier"), F.min("path").alias("path"), F.min("line").alias("line"), F.first("severity").alias("severity"), F.min("symbol").alias("symbol"))
    return found.filter("rule <> 'tool_failure'").unionByName(failed.select(*found.columns))


def roles(nodes: DataFrame, routes: DataFrame, status: DataFrame) -> DataFrame:
    """path and role of every file: endpoints, sub-routers, up to five tables, what connectivity says, the docstring; 'utility module' without any."""
    return sql(
        nodes.sparkSession,
        """
WITH r AS (SELECT path, count_if(method IS NOT NULL) AS endpoints, count_if(type = 'include_router') AS routers FROM routes GROUP BY path)
SELECT f.path, coalesce(nullif(array_join(filter(array(IF(r.endpoints > 0, concat(r.endpoints, ' API endpoints'), NULL), IF(r.routers > 0, concat('registers ', r.routers, ' sub-routers'), NULL),
    IF(size(f.tables) > 0, concat('touches tables: ', array_join(slice(f.tables, 1, 5), ', ')), NULL), CASE s.status WHEN 'unreachable' THEN 'UNREACHABLE (dead code)' WHEN 'incomplete' THEN 'INCOMPLETE WIRING (connected but chain is broken)' END,
    IF(coalesce(f.docstring, '') <> '', concat('purpose: ', f.docstring), NULL)), x -> x IS NOT NULL), '; '), ''), 'utility module') AS role
FROM nodes f LEFT JOIN r ON r.path = f.path LEFT JOIN status s ON s.path = f.path WHERE f.type = 'file'""",
        nodes=nodes, routes=routes, status=status,
    )


def review_context(files: DataFrame, findings: DataFrame, usage: DataFrame, users: DataFrame | None = None, roles: DataFrame | None = None, n_issues: int = 15, n_refs: int = 20) -> DataFrame:
    """Per file worth a review (5 lines or more, no package file): role, known issues and how its symbols are used, all bounded.

    users: path, name, how, file, line of up to three importers and callers of a symbol (`CrossReferences.users`).
    """
    none = files.sparkSession.createDataFrame([], "path string, name string, how string, file string, line int")
    return sql(
        files.sparkSession,
        f"""
WITH i AS (SELECT path, transform(array_sort(collect_list(struct(r, t))), x -> x.t) AS issues FROM (SELECT path, concat('[', severity, '] line ', line, ': ', rule, ': ', symbol) AS t, row_number() OVER (PARTITION BY path ORDER BY line, rule, symbol) AS r FROM found) WHERE r <= {n_issues} GROUP BY path),
by_symbol AS (SELECT path, name, how, array_join(transform(array_sort(collect_list(struct(file, line))), x -> IF(how = 'called', concat(x.file, ':', x.line), x.file)), ', ') AS list FROM users GROUP BY path, name, how),
ways AS (SELECT u.path, u.line, u.name, 0 AS kind, concat(u.name, ': imported by ', b.list) AS t FROM usage u JOIN by_symbol b ON b.path = u.path AND b.name = u.name AND b.how = 'imported'
  UNION ALL SELECT u.path, u.line, u.name, 1, concat(u.name, ': called from ', b.list) FROM usage u JOIN by_symbol b ON b.path = u.path AND b.name = u.name AND b.how = 'called'
  UNION ALL SELECT path, line, name, 2, concat(name, ': NEVER USED outside this file') FROM usage WHERE n_imported + n_called + n_referenced = 0
  UNION ALL SELECT file, CAST(NULL AS INT), name, 3, concat('this file imports ', name, ' from ', path) FROM users WHERE how = 'imported'),
u AS (SELECT path, transform(array_sort(collect_list(struct(r, t))), x -> x.t) AS refs FROM (SELECT path, t, row_number() OVER (PARTITION BY path ORDER BY kind = 3, line, name, kind, t) AS r FROM ways) WHERE r <= {n_refs} GROUP BY path)
SELECT f.path, coalesce(o.role, 'utility module') AS role, coalesce(u.refs, CAST(array() AS ARRAY<STRING>)) AS refs, coalesce(i.issues, CAST(array() AS ARRAY<STRING>)) AS issues FROM f LEFT JOIN i ON i.path = f.path LEFT JOIN u ON u.path = f.path LEFT JOIN roles o ON o.path = f.path
WHERE f.n_lines >= 5 AND f.stem <> '__init__'""",
        f=files, found=findings, usage=usage, users=none if users is None else users,
        roles=files.sparkSession.createDataFrame([], "path string, role string") if roles is None else roles,
    )


def answered(answer: str | None, default_path: str | None = None) -> list[tuple]:
    """(path, line, category, severity, text) of an answer's findings: those of `findings` that are objects with a desc."""
    out = []
    listed = outermost(answer).get("findings", [])
    for f in listed if isinstance(listed, list) else []:
        if isinstance(f, dict) and "desc" in f:
            line = f.get("line")
            line = int(line) if isinstance(line, (int, float)) or isinstance(line, str) and line.isdigit() else 0
            text = lambda key, other: str(f[key]) if f.get(key) is not None else other  # noqa: E731, B023
            out.append((default_path or text("file", "-"), line, text("category", "review"), text("severity", "med"), str(f["desc"])))
    return out


_REVIEWED = "tier string, path string, line long, rule string, severity string, symbol string, source string"


#: A review takes longer than a question.
REVIEW = Limits(seconds=120.0)
#: Files that a task asks about.
REVIEWED_AT_ONCE = 20_000


def review(files: DataFrame, context: DataFrame, client: Client, second: Client | None = None, limits: Limits = REVIEW, folder: str | None = None) -> DataFrame:
    """Findings of a review of each file; with a second client, files with findings are asked about again, what was found among their context.

    limits and folder are those of `calls.ask_all`; the two clients keep their answers apart.
    """
    deeper = f"{folder}/second" if folder else None

    def prompt(q, known: list[tuple]) -> str:
        parts = [f"File: {q.path}", f"Role: {q.role}", "Uses:", *q.refs, "Known issues:", *q.issues]
        return "\n".join(parts + (["Found so far:", *(f"[{s}] line {line}: {text}" for _, line, _, s, text in known)] if known else []) + ["Source:", q.content])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            asked = list(batch.itertuples())
            known = [answered(a, q.path) for a, q in zip(ask_all(client, [prompt(q, []) for q in asked], limits, folder), asked, strict=True)]
            out = [("review", *x, "triage") for first in known for x in first]
            if second is not None:
                again = [(q, first) for q, first in zip(asked, known, strict=True) if first]
                answers = ask_all(second, [prompt(q, first) for q, first in again], limits, deeper)
                out += [("review", *x, "deep") for a, (q, _) in zip(answers, again, strict=True) for x in answered(a, q.path)]
            yield pd.DataFrame(out, columns=["tier", "path", "line", "rule", "severity", "symbol", "source"])

    return dealt(cut(context.join(files.select("path", "content"), "path")), REVIEWED_AT_ONCE, "path").mapInPandas(run, _REVIEWED)


def flagged(files: DataFrame, status: DataFrame, findings: DataFrame) -> DataFrame:
    """The files that a review across files reads: those with findings, and those that are unreachable or incomplete."""
    return files.join(findings.select("path").union(status.filter("status IN ('unreachable', 'incomplete')").select("path")).distinct(), "path", "left_semi")


def across_context(stats: DataFrame, blocks: DataFrame | None, status: DataFrame, routes: DataFrame, findings: DataFrame | None, claims: DataFrame | None = None, n_findings: int = 50, n_lines: int = 200) -> DataFrame:
    """part, at, text: the lines of the context of a review across files. Prior findings (the first by path and line) and claims of the notes are bounded.

    Parts whose frame is None are left out: blocks and findings are not worth making for who reads only the others.
    """
    frames = {"stats": stats, "status": numbered(status.filter("status IN ('unreachable', 'incomplete')"), [F.col("status") == "incomplete", F.col("path")]), "routes": numbered(routes, [F.col("path"), F.col("place")])}
    frames |= {} if blocks is None else {"blocks": numbered(blocks.select("block", F.size("members").alias("n")), [F.length("block"), F.col("block")])}
    frames |= {name: frame for name, frame in (("found", findings), ("claims", claims)) if frame is not None}
    parts = {
        "stats": "SELECT 'map' AS part, 1 AS at, concat('Files: ', files, ', Functions: ', functions, ', Edges: ', edges) AS text FROM stats",
        "blocks": "SELECT 'blocks', number, concat('[', block, '] ', n, ' files') FROM blocks",
        "status": "SELECT 'connectivity', number, concat(upper(status), ': ', path) FROM status",
        "routes": "SELECT 'routes', number, IF(method IS NOT NULL, concat(method, ' ', coalesce(route, '?'), ' to ', path, ':', handler), concat_ws(' ', concat('include_router prefix=', coalesce(prefix, 'NO PREFIX'), ' to ', path), warning)) FROM routes",
        "found": f"SELECT 'findings', r, text FROM (SELECT row_number() OVER (ORDER BY path, line, rule, symbol) AS r, concat('[', severity, '] ', path, ':', line, ' ', rule, ' ', symbol) AS text FROM (SELECT * FROM found ORDER BY path, line, rule, symbol LIMIT {n_findings}))",
        "claims": f"SELECT 'claims', line, trim(text) FROM claims WHERE line <= {n_lines} AND text RLIKE 'DONE|FIXED|OPEN|REGRESSED|SHIPPED'",
    }
    return sql(stats.sparkSession, " UNION ALL ".join(text for name, text in parts.items() if name in frames), **frames)


def review_across(context: DataFrame, sources: DataFrame, client: Client | None, limits: Limits = Limits(seconds=180.0), folder: str | None = None, n_lines: int = 5000) -> DataFrame:
    """Findings of one question about all flagged files; sources: path, taken, source (`source_budget`). Without a client one finding says that nobody was asked.

    Sources with a `part` (`source_parts`) are one question a part, each with the same context, asked by tasks. The context's first n_lines lines are shown,
    part by part, and how many more there are.
    """
    spark = context.sparkSession
    if client is None:
        return spark.createDataFrame([("review", "-", 0, "tool_failure", "high", "no reviewer", "across")], _REVIEWED)
    lines = [r["text"] for r in context.orderBy("part", "at").limit(n_lines).collect()]
    if len(lines) == n_lines and (more := context.count() - n_lines):
        lines.append(f"({more} more lines)")
    shown = lambda path, taken, source: f"=== {path} ({taken} lines) ===\n{source}"
    if "part" in sources.columns:

        def run(part: pd.DataFrame) -> pd.DataFrame:
            texts = [shown(r.path, r.taken, r.source) for r in part.sort_values("path").itertuples()]
            found = answered(ask_all(client, ["\n".join([*lines, *texts])], limits, folder)[0])
            return pd.DataFrame([("review", *x, "across") for x in found], columns=["tier", "path", "line", "rule", "severity", "symbol", "source"])

        return sources.groupBy("part").applyInPandas(run, _REVIEWED)
    texts = [shown(r["path"], r["taken"], r["source"]) for r in sources.orderBy("path").collect()]  # bounded by the budget's lines
    found = answered(ask_all(client, ["\n".join([*lines, *texts])], limits, folder)[0])
    return spark.createDataFrame([("review", *x, "across") for x in found], _REVIEWED)


def source_parts(files: DataFrame, lines: int = 5000) -> DataFrame:
    """path, taken, source and part of all files with lines, whole: files that follow each other by path share a part until it has so many lines.

    Lines are summed within range partitions, where parts begin anew, so no task sees all files.
    """
    rows = files.filter("n_lines > 0").select("path", "parts", "n_lines", "content").repartitionByRange("parts").sortWithinPartitions("parts")
    placed = cut(rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_of", F.shiftright("_at", 33)))
    before = Window.partitionBy("_of").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("_before", F.coalesce(F.sum("n_lines").over(before), F.lit(0)))
    part = F.struct("_of", F.floor(F.col("_before") / lines).alias("_part")).alias("part")
    return summed.select("path", F.col("n_lines").cast("long").alias("taken"), F.array_join(F.slice(F.split("content", "\r\n|\n|\r"), F.lit(1), F.col("n_lines")), "\n").alias("source"), part)


def source_budget(files: DataFrame, lines: int = 5000, least: int = 30) -> DataFrame:
    """path, first lines that fit: files in order of path until the lines are used up; the last is cut if more than `least` remain.

    The running sum is taken over the few files that can fit: more than `lines` files of a line or more never do.
    """
    return sql(
        files.sparkSession,
        f"""
WITH o AS (SELECT path, parts, n_lines, content FROM f WHERE n_lines > 0 ORDER BY parts LIMIT {lines}),
s AS (SELECT *, sum(n_lines) OVER (ORDER BY parts ROWS UNBOUNDED PRECEDING) - n_lines AS before FROM o)
SELECT path, CAST(least(n_lines, {lines} - before) AS BIGINT) AS taken, array_join(slice(split(content, '\\r\\n|\\n|\\r'), 1, CAST(least(n_lines, {lines} - before) AS INT)), '\\n') AS source
FROM s WHERE before + n_lines <= {lines} OR {lines} - before > {least} AND before < {lines}""",
        f=files,
    )
