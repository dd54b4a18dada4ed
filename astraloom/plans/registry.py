"""All queries of the code engine with their DuckDB oracles.

The corpora are made of the driver's tables (see `sources.corpus`), so an oracle states what must be found by key
arithmetic and never looks at code.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from astraloom.functions import javascript
from astraloom.functions.tables import shared_folder, written
from astraloom.operators import code_graph, findings, fixes, graph, lint, patterns, questions, xref
from astraloom.plans import bundles
from astraloom.sources import corpus, tree
from astraloom.sources.corpus import K, NEXT, PROJECT_PATH, R
from astraloom.sources.snippets import variants
from astraloom.streaming.current import CurrentGraph

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a query under its function's name, with its oracle when SQL can express it."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


# -- rules over the snippet corpus -----------------------------------------------------------------------------------


def _lint_query(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows, files = corpus.parsed(spark, sf_dir)
        return lint.findings(rows, files, [name]).select("path", "line", "symbol")

    return run


for _name in lint.RULES:
    QUERIES[f"lint_{_name.lower()}"] = _lint_query(_name)
    ORACLES[f"lint_{_name.lower()}"] = corpus.expected(_name)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unused imports of the snippet corpus."""
    return QUERIES["lint_dead_import"](spark, sf_dir)


SEVERE = ("GOD_FILE", "GOD_CLASS", "UNREACHABLE_CODE", "UNSATISFIABLE_CONDITION", "MUTABLE_DEFAULT_ARG", "BARE_EXCEPT", "ZIP_WITHOUT_STRICT", "COMPARE_TO_NONE_WITH_EQ")


def _severe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, files = corpus.parsed(spark, sf_dir)
    return lint.findings(rows, files, list(SEVERE))


_EXPECTED = " UNION ALL ".join(f"SELECT '{r}' AS rule, '{lint.RULES[r].severity}' AS severity, path, line, symbol FROM ({corpus.expected(r)})" for r in SEVERE)


@query(f"SELECT count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'med') AS med, count(*) FILTER (severity = 'low') AS low, 0::BIGINT AS other FROM ({_EXPECTED})")
def findings_by_severity(spark: SparkSession, sf_dir: str, of=_severe) -> DataFrame:
    return findings.by_severity(of(spark, sf_dir))


@query(f"SELECT rule, severity, path, line, symbol FROM ({_EXPECTED}) ORDER BY CASE severity WHEN 'high' THEN 3 WHEN 'med' THEN 2 ELSE 1 END DESC, path, line, rule, symbol LIMIT 25")
def findings_most_severe(spark: SparkSession, sf_dir: str, of=_severe) -> DataFrame:
    return findings.most_severe(of(spark, sf_dir)).select("rule", "severity", "path", "line", "symbol")


@query(f"SELECT change, rule, path, line, symbol, severity FROM (SELECT *, CASE WHEN line % 2 = 0 AND path NOT LIKE 'pkg3/%' THEN 'new' WHEN path NOT LIKE 'pkg3/%' THEN 'unchanged' WHEN line % 2 = 1 THEN 'resolved' END AS change FROM (SELECT DISTINCT * FROM ({_EXPECTED}))) WHERE change IS NOT NULL")
def findings_diff(spark: SparkSession, sf_dir: str, of=_severe) -> DataFrame:
    """Now: all but pkg3; then: findings on odd lines."""
    found = written(of(spark, sf_dir), "findings")  # read twice
    return findings.diff(found.filter("path NOT LIKE 'pkg3/%'"), found.filter("line % 2 = 1")).select("change", "rule", "path", "line", "symbol", "severity")


@query(f"SELECT count(*) FILTER (severity = 'high') > 0 AS fails_high, count(*) FILTER (severity IN ('high', 'med')) > 0 AS fails_med, count(*) > 0 AS fails_low FROM ({_EXPECTED})")
def findings_gate(spark: SparkSession, sf_dir: str, of=_severe) -> DataFrame:
    found = written(of(spark, sf_dir), "findings")
    return spark.createDataFrame([tuple(findings.gate(found, s) for s in ("high", "med", "low"))], "fails_high boolean, fails_med boolean, fails_low boolean")


def _suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.findings(*corpus.parsed(spark, sf_dir))


_SUITE_EXPECTED = " UNION ALL ".join(f"SELECT '{r}' AS rule, '{lint.RULES[r].severity}' AS severity, path, line, symbol FROM ({corpus.expected(r)})" for r in lint.RULES)


def _suite_query(name: str) -> Query:
    return lambda spark, sf_dir: QUERIES[name](spark, sf_dir, of=_suite)


#: The same over every rule, where the four above see those of SEVERE.
for _name in ("findings_by_severity", "findings_most_severe", "findings_diff", "findings_gate"):
    QUERIES[f"{_name}_suite"] = _suite_query(_name)
    ORACLES[f"{_name}_suite"] = ORACLES[_name].replace(_EXPECTED, _SUITE_EXPECTED)


PATTERNS = [
    {"id": "zip", "pattern": "zip(...)"},
    {"id": "now", "pattern": "datetime.now(...)", "severity": "high", "exclude_files": ["pkg1/*"]},
    {"id": "bare", "pattern": "except:..."},
    {"id": "fifty", "pattern": "$X = 50"},
    {"id": "eval", "pattern": "eval(x)"},
    {"id": "text", "pattern": "no such form"},
]


def _pattern_oracle() -> str:
    def at(rule: str, severity: str, hits: list[tuple[str, int, str]], where: str = "true") -> str:
        values = []
        for i, v in enumerate(variants()):
            for j, s in enumerate(v):
                for n, line in enumerate(s.text.split("\n"), 1):
                    values += [f"({i}, {j}, {n}, '{symbol}')" for text, _, symbol in hits if text in line]
        return f"SELECT {corpus.SNIPPET_PATH} AS path, v.line::BIGINT AS line, 'PATTERN:{rule}' AS rule, '{severity}' AS severity, v.symbol FROM part JOIN (VALUES {', '.join(values)}) v(family, variant, line, symbol) ON p_partkey % {corpus.N} = v.family AND (p_partkey // {corpus.N}) % 3 = v.variant WHERE {where}"

    return " UNION ALL ".join(
        [
            at("zip", "med", [(" zip(", 0, "zip")]),
            at("now", "high", [(" datetime.now(", 0, "now")], "p_partkey % 7 <> 1"),
            at("bare", "med", [("except:", 0, "")]),
            at("fifty", "med", [("LIMIT = 50", 0, "50"), ("b = 50", 0, "50")]),
            at("eval", "med", [(" eval(", 0, "eval")]),
        ]
    )


@query(_pattern_oracle())
def pattern_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = corpus.parsed(spark, sf_dir)
    return patterns.pattern_findings(rows, PATTERNS).select("path", "line", "rule", "severity", "symbol")


@query(f"""
SELECT {corpus.SNIPPET_PATH} AS path, CASE p_partkey % {corpus.N} WHEN 0 THEN 1 ELSE 0 END::BIGINT AS dead_imports, CASE p_partkey % {corpus.N} WHEN 1 THEN 2 ELSE 0 END::BIGINT AS unused_params,
  CASE p_partkey % {corpus.N} WHEN 0 THEN 'import a.b as c' || chr(10) || 'from m import (x,' || chr(10) || '    y)' || chr(10) || 'from z import *' || chr(10) || 'print(c, x)' || chr(10)
    ELSE 'def f(a, _b, *, _c=1, _d=2, **kw):' || chr(10) || '    return a' || chr(10) || 'def _g(x):' || chr(10) || '    return 1' || chr(10) END AS content
FROM part WHERE p_partkey % {corpus.N} IN (0, 1) AND (p_partkey // {corpus.N}) % 3 = 0""")
def autofix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes of all modules; by the oracle only those of the first two families have what the two rules report."""
    rows, files = corpus.parsed(spark, sf_dir)
    return fixes.fixed(files, lint.findings(rows, files, ["DEAD_IMPORT", "UNUSED_PARAM"])).select("path", "dead_imports", "unused_params", "content")


# -- the project corpus --------------------------------------------------------------------------------------------------

_GRAPHS: dict[tuple[str, str], code_graph.CodeGraph] = {}
_XREFS: dict[tuple[str, str], xref.CrossReferences] = {}


def _graph(spark: SparkSession, sf_dir: str) -> code_graph.CodeGraph:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _GRAPHS:
        _GRAPHS[key] = code_graph.build(*corpus.parsed(spark, sf_dir, "project"))
    return _GRAPHS[key]


def _xref(spark: SparkSession, sf_dir: str) -> xref.CrossReferences:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _XREFS:
        _XREFS[key] = xref.CrossReferences(*corpus.parsed(spark, sf_dir, "project"), _graph(spark, sf_dir))
    return _XREFS[key]


_P = PROJECT_PATH
_Q = PROJECT_PATH.replace(K, f"({NEXT})")
_B = f"({K} // 50)"
_CLASS = f"CASE WHEN {R} = 3 THEN 'Model_' ELSE 'Plain_' END || {K}"
_TAIL = f"CASE WHEN {K} % 50 = 4 THEN 'helper_' || {_B} ELSE 'other_' || {K} END"
#: helper_B lives in the file whose key is 50 B + 4; calls of it resolve where that file exists.
_HELPER = f"EXISTS (SELECT 1 FROM supplier h WHERE h.s_suppkey = ({K} // 50) * 50 + 4)"
_NODES = f"""
SELECT 'file:' || {_P} AS id, 'file' AS type, 1 AS line_start, 14 AS line_end, 0 AS complexity FROM supplier
UNION ALL SELECT 'func:' || {_P} || ':work_' || {K}, 'function', 5, 6, 1 FROM supplier
UNION ALL SELECT 'class:' || {_P} || ':' || {_CLASS}, 'class', 7, 11, 0 FROM supplier
UNION ALL SELECT 'func:' || {_P} || ':' || {_CLASS} || '.save', 'function', 9, 11, 1 FROM supplier
UNION ALL SELECT 'func:' || {_P} || ':' || {_TAIL}, 'function', 13, 14, 1 FROM supplier"""


@query(_NODES)
def code_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).nodes.select("id", "type", "line_start", "line_end", "complexity")


@query(f"""
SELECT 'file:' || {_P} AS source, 'file:' || {_Q} AS target, 'import' AS type, 2 AS line FROM supplier WHERE {R} IN (1, 2, 3, 5, 6, 7)
UNION ALL SELECT 'class:' || {_P} || ':' || {_CLASS}, 'class_ref:Root_' || {K} % 3, 'inheritance', 7 FROM supplier WHERE {R} <> 3
UNION ALL SELECT 'file:' || {_P}, 'func:' || {_Q} || ':work_' || ({NEXT}), 'call', 6 FROM supplier WHERE {R} IN (1, 3, 5, 6)
UNION ALL SELECT 'file:' || {_P}, 'func:' || {PROJECT_PATH.replace(K, f"(({K} // 50) * 50 + 4)")} || ':helper_' || {_B}, 'call', 12 FROM supplier WHERE {_HELPER}""")
def code_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).edges.select("source", "target", "type", "line")


@query(f"""
SELECT count(*) AS files, count(*) AS classes, 3 * count(*) AS functions, 0::BIGINT AS stubs,
  (count(*) FILTER ({R} IN (1, 2, 3, 5, 6, 7)) + count(*) FILTER ({R} <> 3) + count(*) FILTER ({R} IN (1, 2, 3, 5, 6)) + count(*) + count(*) FILTER ({R} = 1))::BIGINT AS edges, count(DISTINCT {K} // 20) FILTER ({R} IN (3, 4)) AS n_tables FROM supplier""")
def code_map_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_graph.map_stats(_graph(spark, sf_dir)).withColumn("n_tables", F.size("tables").cast("long")).drop("tables")


_CURRENT: dict[tuple[str, str], CurrentGraph] = {}


def _current(spark: SparkSession, sf_dir: str) -> CurrentGraph:
    """The project by four rounds of changes: at first with modules that are missing, with others' texts, and with more that claim their names."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CURRENT:
        kept = CurrentGraph(spark, re.sub("^file:/(?=[^/])", "file:///", shared_folder(spark, "current")), ["DEAD_IMPORT"])
        files = corpus.project_files(spark, sf_dir).select("path", "content").withColumn("k", F.regexp_extract("path", r"mod(\d+)", 1).cast("long"))
        at = lambda n: F.timestamp_seconds(F.lit(n)).alias("at")
        first = files.filter("k % 11 <> 0").select("path", F.expr("IF(k % 7 = 0, 'import app\\n', content)").alias("content"), at(1))
        thieves = files.filter("k % 5 = 0").select(F.expr("concat('app/aa/mod', k, '.py')").alias("path"), "content")
        kept.update(first.unionByName(thieves.withColumn("at", at(1))))
        kept.update(files.filter("k % 11 = 0 OR k % 7 = 0").select("path", "content", at(2)))
        kept.update(thieves.select("path", F.lit(None).cast("string").alias("content"), at(3)))
        kept.update(files.filter("k % 3 = 0").select("path", F.lit("late = 1\n").alias("content"), at(0)))
        _CURRENT[key] = kept
    return _CURRENT[key]


@query(ORACLES["code_nodes"])
def current_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _current(spark, sf_dir).graph().nodes.select("id", "type", "line_start", "line_end", "complexity")


@query(ORACLES["code_edges"])
def current_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _current(spark, sf_dir).graph().edges.select("source", "target", "type", "line")


@query(f"SELECT {_P} AS path, 'GET' AS method, '/m/' || {K} AS route, 'work_' || {K} AS handler, 5 AS line FROM supplier WHERE {R} = 1")
def code_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).routes.select("path", "method", "route", "handler", "line")


_CALLS_OF_HELPER = f"(SELECT count(*) FROM supplier h WHERE h.s_suppkey // 50 = supplier.s_suppkey // 50 AND h.s_suppkey <> supplier.s_suppkey)"


@query(f"""
SELECT {_P} AS path, 'work_' || {K} AS name, 'function' AS type, 5 AS line, CASE WHEN {R} IN (1, 2, 5, 6, 8) THEN 1 ELSE 0 END::BIGINT AS n_imported, CASE WHEN {R} IN (1, 2, 3, 5, 6) THEN 1 ELSE 0 END::BIGINT AS n_called, 0::BIGINT AS n_referenced FROM supplier
UNION ALL SELECT {_P}, {_CLASS}, 'class', 7, 0, 0, 0 FROM supplier
UNION ALL SELECT {_P}, 'save', 'function', 9, 0, 0, 0 FROM supplier
UNION ALL SELECT {_P}, {_TAIL}, 'function', 13, 0, CASE WHEN {K} % 50 = 4 THEN {_CALLS_OF_HELPER} ELSE 0 END, 0 FROM supplier
UNION ALL SELECT {_P}, 'LIMIT_' || {K}, 'constant', 3, 0, 0, 0 FROM supplier
UNION ALL SELECT {_P}, 'TOTAL', 'constant', 12, 0, 0, 0 FROM supplier""")
def xref_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _xref(spark, sf_dir).usage.select("path", "name", "type", "line", "n_imported", "n_called", "n_referenced")


@query(f"""
SELECT 'XREF_UNUSED_SYMBOL' AS rule, {_P} AS path, 5::BIGINT AS line, 'work_' || {K} AS symbol FROM supplier WHERE {R} IN (0, 4, 7, 9)
UNION ALL SELECT 'XREF_UNUSED_SYMBOL', {_P}, 7, {_CLASS} FROM supplier
UNION ALL SELECT 'XREF_UNUSED_SYMBOL', {_P}, 9, 'save' FROM supplier
UNION ALL SELECT 'XREF_UNUSED_SYMBOL', {_P}, 13, 'other_' || {K} FROM supplier WHERE {K} % 50 <> 4
UNION ALL SELECT 'XREF_UNUSED_CONSTANT', {_P}, 3, 'LIMIT_' || {K} FROM supplier
UNION ALL SELECT 'XREF_UNUSED_CONSTANT', {_P}, 12, 'TOTAL' FROM supplier
UNION ALL SELECT 'XREF_IMPORTED_NOT_CALLED', {_P}, 5, 'work_' || {K} FROM supplier WHERE {R} = 8
UNION ALL SELECT 'XREF_DUPLICATE_FUNCTION', {_P}, 9, 'save' FROM supplier s WHERE (SELECT count(*) FROM supplier t WHERE t.s_suppkey % 4 = s.s_suppkey % 4) >= 2
UNION ALL SELECT 'XREF_SHOTGUN_SURGERY', {_P}, 13, 'helper_' || {_B} FROM supplier WHERE {K} % 50 = 4 AND {_CALLS_OF_HELPER} >= 5""".replace("FROM supplier s WHERE (SELECT", "FROM (SELECT * FROM supplier) s WHERE (SELECT").replace(_P + ", 9, 'save' FROM (SELECT", _P.replace(K, "s.s_suppkey") + ", 9, 'save' FROM (SELECT"))
def xref_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _xref(spark, sf_dir).findings.select("rule", "path", F.col("line").cast("long").alias("line"), "symbol")


@query("SELECT ''::VARCHAR AS rule, ''::VARCHAR AS path, 0::BIGINT AS line, ''::VARCHAR AS symbol WHERE false")
def xref_feature_envy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _xref(spark, sf_dir).envy.select("rule", "path", "line", "symbol")


@query(f"SELECT path, name, n_imported + n_called + n_referenced AS uses FROM ({ORACLES['xref_usage']}) ORDER BY uses DESC, string_split(path, '/'), line LIMIT 5")
def xref_top_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _xref(spark, sf_dir).top(5)


@query(f"""
SELECT {_P} AS path, CASE WHEN {R} IN (1, 2, 3) THEN 'reachable' ELSE 'unreachable' END AS status, CASE WHEN {R} IN (1, 2, 3) THEN 0 WHEN {R} IN (5, 6, 8) THEN 80 ELSE 100 END AS dead_confidence FROM supplier""")
def graph_connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.connectivity(_graph(spark, sf_dir))


@query(f"SELECT count(*) FILTER (status = 'reachable') AS reachable, count(*) FILTER (status = 'unreachable') AS unreachable, count(*) FILTER (status = 'incomplete') AS incomplete FROM ({ORACLES['graph_connectivity']})")
def graph_connectivity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.connectivity_summary(graph.connectivity(_graph(spark, sf_dir)))


def _cycle(*offsets: int) -> str:
    return " || ',' || ".join(PROJECT_PATH.replace(K, f"({K} + {o})") for o in offsets)


@query(f"""
SELECT {PROJECT_PATH.replace(K, f"({K} + 1)")} AS path, 'high' AS severity, 3 AS cycle_length, 3 AS scc_size, {_cycle(1, 2, 0)} AS cycle FROM supplier WHERE {R} = 1
UNION ALL SELECT {PROJECT_PATH.replace(K, f"({K} + 1)")}, 'med', 2, 2, {_cycle(1, 0)} FROM supplier WHERE {R} = 5""")
def graph_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cycles(_graph(spark, sf_dir)).select("path", "severity", "cycle_length", "scc_size", F.concat_ws(",", "cycle").alias("cycle"))


def _least_first(*offsets: int) -> str:
    """The cycle from its least path, which is a word."""
    paths = [PROJECT_PATH.replace(K, f"({K} + {o})") for o in offsets]
    turns = [" || ',' || ".join(paths[k:] + paths[:k]) for k in range(len(paths))]
    return "CASE " + " ".join(f"WHEN {paths[k]} = least({', '.join(paths)}) THEN {turns[k]}" for k in range(len(paths))) + " END"


@query(f"SELECT {_least_first(0, 1, 2)} AS cycle, 3 AS length FROM supplier WHERE {R} = 1 UNION ALL SELECT {_least_first(0, 1)}, 2 FROM supplier WHERE {R} = 5")
def graph_circular_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cycle of imports of up to five files; there is nothing beyond."""
    found, beyond = graph.circular_dependencies(_graph(spark, sf_dir))
    return found.select(F.concat_ws(",", "cycle").alias("cycle"), "length").join(beyond.select(F.col("path").alias("cycle")), "cycle", "left_anti")


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT c.c_nationkey AS a, s.s_nationkey AS b FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey JOIN supplier s ON s.s_suppkey = l.l_suppkey WHERE l.l_quantity = 50 AND c.c_nationkey <> s.s_nationkey AND (c.c_nationkey + s.s_nationkey) % 3 = 0),
w(first, last, path) AS (SELECT a, b, [a, b] FROM e WHERE a < b UNION ALL SELECT w.first, e.b, list_append(w.path, e.b) FROM w JOIN e ON e.a = w.last WHERE e.b > w.first AND NOT list_contains(w.path, e.b) AND len(w.path) < 4)
SELECT array_to_string(w.path, ',') AS cycle, len(w.path)::INTEGER AS length FROM w JOIN e ON e.a = w.last AND e.b = w.first""")
def graph_trade_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles of up to four nations whose customers buy from each other's suppliers in bulk."""
    t = {name: corpus.read(spark, sf_dir, name) for name in ("lineitem", "orders", "customer", "supplier")}
    bulk = t["lineitem"].filter("l_quantity = 50").select("l_orderkey", "l_suppkey").join(t["orders"].select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), "l_orderkey")
    both = bulk.join(t["customer"].select("c_custkey", "c_nationkey"), "c_custkey").join(t["supplier"].select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    edges = both.filter("(c_nationkey + s_nationkey) % 3 = 0").select(F.format_string("%02d", "c_nationkey").alias("src"), F.format_string("%02d", "s_nationkey").alias("dst"))
    found, _ = graph.simple_cycles(edges, longest=4)
    return found.select(F.array_join(F.transform("cycle", lambda x: x.cast("int").cast("string")), ",").alias("cycle"), "length")


_LABEL = f"CASE WHEN {R} IN (1, 2, 3, 4) THEN 'a' || {K} // 20 WHEN {R} IN (5, 6) THEN 'b' || {K} // 10 WHEN {R} IN (7, 8) THEN 'c' || {K} // 10 ELSE 'utilities' END"


@query(f"SELECT {_P} AS path, count(*) OVER (PARTITION BY {_LABEL}) AS block_size, {_LABEL} = 'utilities' AS utilities FROM supplier")
def graph_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = graph.cluster_labels(_graph(spark, sf_dir))
    return labels.select(F.expr("substr(id, 6)").alias("path"), F.col("n").alias("block_size"), (F.col("label") == "~").alias("utilities"))


@query(ORACLES["graph_clusters"])
def graph_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities by modularity: the project's clusters are small and dense, so none is split and none are joined."""
    labels = graph.cluster_labels(_graph(spark, sf_dir), resolution=1.0)
    return labels.select(F.expr("substr(id, 6)").alias("path"), F.col("n").alias("block_size"), (F.col("label") == "~").alias("utilities"))


@query("""
WITH f AS (SELECT s_suppkey AS k, s_suppkey // 10 AS g, 'file:mod' || s_suppkey || '.py' AS id FROM supplier)
SELECT id, min(id) OVER (PARTITION BY g) AS label, count(*) OVER (PARTITION BY g) AS n FROM f""")
def graph_bridged_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of ten that share a table, every two tens bridged by one import: communities are the tens, components would be the bridged pairs.

    The resolution grows with the number of tens: at 1, modularity joins what is small beside the whole.
    """
    files = corpus.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.floor(F.col("s_suppkey") / 10).alias("g"))
    name = lambda k: F.concat(F.lit("file:mod"), k.cast("string"), F.lit(".py"))
    nodes = files.select(name(F.col("k")).alias("id"), F.lit("file").alias("type"), F.array(F.concat(F.lit("t"), F.col("g").cast("string"))).alias("tables"))
    edges = files.filter("k % 20 = 9").select(name(F.col("k")).alias("source"), name(F.col("k") + 1).alias("target"), F.lit("import").alias("type"))
    edges = edges.join(nodes.select(F.col("id").alias("target")), "target", "left_semi").select("source", "target", "type")
    tens = files.agg(F.count_distinct("g")).first()[0]
    made = code_graph.CodeGraph(nodes, edges, edges, nodes.limit(0))
    return graph.cluster_labels(made, merge_singletons=False, resolution=float(max(1, tens // 2))).select("id", "label", "n")


@query(f"""
WITH c AS (SELECT o_orderkey % (SELECT count(*) FROM supplier) + 1 AS s_suppkey, count(*) AS churn FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 180 DAY GROUP BY 1),
b AS (SELECT coalesce(s.s_suppkey, c.s_suppkey) AS s_suppkey, CASE WHEN s.s_suppkey IS NULL THEN 0 ELSE 3 END AS complexity, coalesce(churn, 0) AS churn FROM supplier s FULL JOIN c ON c.s_suppkey = s.s_suppkey)
SELECT {_P} AS path, complexity::BIGINT AS complexity, churn::BIGINT AS churn, round_even(complexity / 3.0::DOUBLE, 3) AS complexity_norm, round_even(churn::DOUBLE / (SELECT max(churn) FROM c), 3) AS churn_norm,
  round_even(complexity / 3.0::DOUBLE * (churn::DOUBLE / (SELECT max(churn) FROM c)), 3) AS score FROM b""")
def graph_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Churn of the last 180 days of the log."""
    log = corpus.commits(spark, sf_dir)
    last = log.agg(F.max("ts").alias("ts")).first()["ts"]
    found = graph.hotspots(_graph(spark, sf_dir), tree.churn(log, F.lit(last)))
    return found.select("path", F.col("complexity").cast("long").alias("complexity"), F.col("churn").cast("long").alias("churn"), "complexity_norm", "churn_norm", "score")


@query(f"SELECT {_P} AS path, 2::BIGINT AS complexity, CASE WHEN {R} IN (1, 2, 3, 5, 6, 7) THEN 1 ELSE 0 END::BIGINT AS n_imports, CASE WHEN {R} IN (1, 2, 3, 5, 6, 8) THEN 1 ELSE 0 END::BIGINT AS n_imported_by FROM supplier")
def graph_file_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.file_view(_graph(spark, sf_dir))


@query(f"SELECT {_P} AS path, 'mod' || {K} AS label, CASE WHEN {R} IN (1, 2, 3, 5, 6, 7) THEN {_Q} ELSE '' END AS imports FROM supplier")
def graph_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbourhood(_graph(spark, sf_dir)).select("path", "label", F.concat_ws(",", "imports").alias("imports"))


@query(f"SELECT {_P} AS path, 5::BIGINT AS start_line, 6::BIGINT AS end_line, 'work_' || {K} AS symbol, 'xref' AS signal FROM supplier WHERE {R} = 8")
def questions_xref(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, files = corpus.parsed(spark, sf_dir, "project")
    return questions.ask("xref", n=rows, f=files, nodes=_graph(spark, sf_dir).nodes, xref_findings=_xref(spark, sf_dir).findings).drop("snippet")


@query(f"SELECT {_P} AS path, least(14, greatest(0, 5000 - 14 * (row_number() OVER (ORDER BY {K} % 5, 'mod' || {K} || '.py') - 1)))::BIGINT AS taken FROM supplier QUALIFY taken = 14 OR 5000 - 14 * (row_number() OVER (ORDER BY {K} % 5, 'mod' || {K} || '.py') - 1) > 30")
def review_source_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions.source_budget(corpus.parsed(spark, sf_dir, "project")[1]).select("path", "taken")


@query(corpus.expected_js())
def js_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return javascript.js_findings(corpus.js_files(spark, sf_dir)).select("path", "line", "rule", "symbol")


@query(f"""
SELECT stage, path FROM (SELECT p_partkey, {corpus.SCAN_PATH} AS path FROM part) JOIN (VALUES ('map'), ('lint'), ('js')) s(stage) ON true
WHERE p_partkey % 8 NOT IN (0, 1) AND CASE stage WHEN 'js' THEN p_partkey % 5 = 1 WHEN 'map' THEN p_partkey % 5 IN (3, 4) AND p_partkey % 8 <> 2 ELSE p_partkey % 5 IN (3, 4) END""")
def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each stage reads of the same tree, with `gen` ignored."""
    files = corpus.scan_files(spark, sf_dir)
    of = lambda stage: tree.select_files(files, stage, ignored=("gen",)).select(F.lit(stage).alias("stage"), "path")
    return of("map").union(of("lint")).union(of("js"))


# -- the same operators on the driver's own tables ----------------------------------------------------------------------


@query("SELECT 'page' || page_id || '.js' AS path, 1::BIGINT AS line, 'JS_VAR_DECLARATION' AS rule, 'var' AS symbol FROM pages WHERE regexp_matches(regexp_extract(html, '<script>([^<]*)', 1), '^[ \\t]*var\\s+[0-9A-Za-z_]')")
def js_rules_on_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JavaScript rules over every script of every page, whole; a page's second script is a module of its own, pageN-2.js."""
    return javascript.js_findings(corpus.page_scripts(spark, sf_dir)).select("path", "line", "rule", "symbol")


@query("""
WITH b AS (SELECT doc_id, source, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> ''), chr(10))) AS body FROM documents),
g AS (SELECT body FROM b GROUP BY body HAVING count(*) >= 2 AND count(DISTINCT source) >= 2)
SELECT doc_id, source FROM b WHERE body IN (SELECT body FROM g)""")
def duplicate_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The duplicate-function query on documents: bodies equal up to indentation and empty lines that occur in two sources."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: x != "")
    docs = corpus.read(spark, sf_dir, "documents").select("doc_id", "source", F.md5(F.array_join(lines, "\n")).alias("body"))
    same = docs.groupBy("body").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources")).filter("n >= 2 AND sources >= 2").select("body")
    return docs.join(same, "body", "left_semi").select("doc_id", "source")


@query("""
WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders),
w(id) AS (SELECT 'r1' UNION SELECT dst FROM e JOIN w ON e.src = w.id) SELECT id FROM w""")
def reach_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reachability from a region over nations and customers to orders."""
    edge = lambda t, a, x, b, y: corpus.read(spark, sf_dir, t).select(F.concat(F.lit(a), x).alias("src"), F.concat(F.lit(b), y).alias("dst"))
    edges = edge("nation", "r", "n_regionkey", "n", "n_nationkey").union(edge("customer", "n", "c_nationkey", "c", "c_custkey")).union(edge("orders", "c", "o_custkey", "o", "o_orderkey"))
    return graph.reach(edges, spark.createDataFrame([("r1",)], "id string"))


@query("""
WITH e AS (SELECT user_id, count(*) AS churn, sum(value) AS total FROM events GROUP BY user_id), m AS (SELECT max(churn) AS c, max(total) AS t FROM e)
SELECT user_id, churn::BIGINT AS churn, (churn::DOUBLE / m.c) * (total / m.t) > 0.5 AS hot FROM e, m""")
def hot_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hotspots of the event log: count times value, each over its maximum."""
    e = corpus.read(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("churn"), F.sum("value").alias("total"))
    m = e.agg(F.max("churn").alias("c"), F.max("total").alias("t"))
    return e.crossJoin(F.broadcast(m)).select("user_id", "churn", ((F.col("churn") / F.col("c")) * (F.col("total") / F.col("t")) > 0.5).alias("hot"))  # one row


@query("""
SELECT doc_id, CASE WHEN length(text) <= 3000 THEN length(text) WHEN pos = 0 OR pos = 3000 THEN 3000 ELSE 3000 - pos + 14 END::BIGINT AS n_chars
FROM (SELECT doc_id, text, strpos(reverse(substr(text, 1, 3000)), chr(10)) AS pos FROM documents)""")
def prompt_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document a question would show: cut at a line's end and marked."""
    return corpus.read(spark, sf_dir, "documents").select("doc_id", F.length(questions.shortened(F.col("text"))).cast("long").alias("n_chars"))


def queries() -> dict[str, Query]:
    return QUERIES | bundles.QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES | bundles.ORACLES
