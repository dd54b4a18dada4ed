"""Files, classes and functions as nodes; imports, calls and inheritance as edges; names resolved to nodes.

All from syntax rows (`n`) and files (`f`). The order of nodes is that of paths by components, then of places in
the file; where several nodes claim a name, resolution keys say whether the first or the last of that order wins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astraloom.functions.tables import cut, sql
from astraloom.operators.lint import DEFS, UNDER, among, kid, some

#: Calls of these are no edges.
BUILTIN_CALLS = among(
    "print len range int str float bool list dict set tuple type isinstance issubclass hasattr getattr setattr delattr super property staticmethod classmethod "
    "enumerate zip map filter sorted reversed min max sum any all abs round repr id hash next iter open format vars dir callable input"
)
ROUTE_VERBS = among("get post put delete patch head options")
PLAIN_BASES = among("object Base BaseModel")
COMPREHENSIONS = "('ListComp', 'SetComp', 'DictComp', 'GeneratorExp')"

_BODY = "filter(d.kids, k -> k.field = 'body')"
STUB = f"""(size({_BODY}) = 0
  OR (size({_BODY}) = 1 AND (get({_BODY}, 0).kind = 'Pass' OR (get({_BODY}, 0).kind = 'Expr' AND get({_BODY}, 0).value_kind = 'Constant') OR (get({_BODY}, 0).kind = 'Return' AND get({_BODY}, 0).value_kind IS NULL)))
  OR (size({_BODY}) = 2 AND get({_BODY}, 0).kind = 'Expr' AND get({_BODY}, 0).value_kind = 'Constant' AND get({_BODY}, 1).kind IN ('Pass', 'Return')))"""

TABLES = f"""
WITH named AS (SELECT a.path, a.depth, a.pre, {kid('value', kids='a.kids')}.const_str AS t FROM n a
    WHERE a.kind = 'Assign' AND {some('targets', "k.kind = 'Name' AND k.name = '__tablename__'", 'a.kids')} AND {kid('value', kids='a.kids')}.const_type = 'str'),
related AS (SELECT path, depth, pre, k.idx, k.const_str AS v FROM n LATERAL VIEW explode(filter(kids, k -> k.field = 'args' AND k.const_type = 'str')) AS k WHERE kind = 'Call' AND name = 'relationship')
SELECT path, transform(array_sort(collect_list(struct(depth, pre, idx, t))), x -> x.t) AS tables FROM (
  SELECT path, depth, pre, 0 AS idx, t FROM named
  UNION ALL SELECT r.path, r.depth, r.pre, r.idx, concat('rel:', r.v) FROM related r LEFT ANTI JOIN named s ON r.path = s.path AND r.v = s.t AND (s.depth, s.pre) < (r.depth, r.pre)) GROUP BY path"""

_DECORATED = f"""
SELECT d.path, d.pre AS def_pre, d.depth, d.name AS handler, d.line, c.pre, c.idx, c.name AS verb, {kid('args', kids='c.kids')} AS first FROM n d JOIN n c ON c.path = d.path AND c.parent = d.pre
WHERE d.kind IN {DEFS} AND c.field = 'decorator_list' AND c.kind = 'Call'"""
ROUTES = f"""
WITH m AS (SELECT l.path, l.gp AS call, array_join(transform(filter(l.kids, e -> e.field = 'elts' AND e.const_type = 'str'), e -> upper(e.const_str)), '/') AS verbs
    FROM n l JOIN n k ON k.path = l.path AND k.pre = l.parent WHERE l.kind IN ('List', 'Tuple') AND k.kind = 'keyword' AND k.name = 'methods')
SELECT path, struct(0 AS part, depth AS depth, pre AS pre, idx AS idx) AS place, method, route, handler, line, 'route' AS type, CAST(NULL AS STRING) AS prefix, CAST(NULL AS STRING) AS warning FROM (
  SELECT d.path, d.depth, d.def_pre AS pre, d.idx, d.handler, d.line, d.first.const_str AS route,
    CASE WHEN d.verb IN {ROUTE_VERBS} THEN upper(d.verb) WHEN d.verb = 'route' THEN coalesce(nullif(m.verbs, ''), 'GET') END AS method
  FROM ({_DECORATED}) d LEFT JOIN m ON m.path = d.path AND m.call = d.pre WHERE d.first.kind = 'Constant') WHERE method IS NOT NULL
UNION ALL
SELECT path, struct(1, depth, pre, 0), NULL, NULL, NULL, line, 'include_router',
  CASE WHEN p IS NULL THEN NULL WHEN p.value_kind = 'Constant' THEN p.const_str ELSE '<dynamic>' END,
  CASE WHEN p IS NULL THEN 'include_router called without prefix' WHEN p.value_kind = 'Constant' THEN NULL ELSE 'include_router prefix is dynamic' END
FROM (SELECT *, get(filter(kids, k -> k.field = 'keywords' AND k.name = 'prefix'), 0) AS p FROM n WHERE kind = 'Call' AND name = 'include_router' AND {kid('func')}.kind = 'Attribute')"""

NODES = f"""
WITH c AS (SELECT path, f, sum(CASE WHEN kind = 'BoolOp' THEN size(filter(kids, k -> k.field = 'values')) - 1 ELSE 1 END) AS branches FROM {UNDER}
    WHERE kind IN ('If', 'While', 'For', 'ExceptHandler', 'BoolOp') OR kind IN {COMPREHENSIONS} GROUP BY path, f),
d AS (SELECT *, IF(kind = 'ClassDef', 'class', 'function') AS type, IF(parent_kind = 'ClassDef', concat(cls_name, '.', name), name) AS full FROM n
    WHERE (kind IN {DEFS} OR kind = 'ClassDef') AND (parent_kind = 'Module' OR (kind IN {DEFS} AND parent_kind = 'ClassDef' AND gp_kind = 'Module')) AND field = 'body')
SELECT concat('file:', f.path) AS id, 'file' AS type, f.path, f.stem AS name, 1 AS line_start, f.n_lines AS line_end, m.doc AS docstring, CAST(array() AS ARRAY<STRING>) AS decorators,
  coalesce(t.tables, CAST(array() AS ARRAY<STRING>)) AS tables, coalesce(r.n_routes, 0) AS n_routes, CAST(NULL AS STRING) AS parent_id, 0 AS complexity, false AS is_stub, struct(f.parts, 0 AS pre) AS seq
FROM f JOIN n m ON m.path = f.path AND m.pre = 0 LEFT JOIN code_tables t ON t.path = f.path LEFT JOIN (SELECT path, CAST(count(*) AS INT) AS n_routes FROM code_routes GROUP BY path) r ON r.path = f.path
UNION ALL
SELECT concat(IF(d.type = 'class', 'class:', 'func:'), d.path, ':', d.full), d.type, d.path, d.full, d.line, coalesce(d.end_line, d.line), d.doc,
  transform(filter(d.kids, k -> k.field = 'decorator_list'), k -> coalesce(k.qual, concat('None.', k.name), 'unknown')), CAST(array() AS ARRAY<STRING>), 0,
  IF(d.parent_kind = 'Module', concat('file:', d.path), concat('class:', d.path, ':', d.cls_name)), IF(d.type = 'function', CAST(1 + coalesce(c.branches, 0) AS INT), 0), d.type = 'function' AND {STUB}, struct(split(d.path, '/'), d.pre)
FROM d LEFT JOIN c ON c.path = d.path AND c.f = d.pre"""

_PACKAGE = "slice(trail, 1, greatest(size(trail) - i.level, 0))"
EDGES = f"""
WITH i AS (SELECT a.path, a.pre, a.parent_line, a.name, a.source_name, a.idx, a.parent_kind, s.module, coalesce(s.level, 0) AS level, a.fn IS NOT NULL AS in_function, a.in_try, IF(a.name <> a.source_name AND a.name <> split(a.source_name, '[.]')[0], a.name, NULL) AS alias,
    {kid('names', kids='s.kids')} AS first FROM n a JOIN n s ON s.path = a.path AND s.pre = a.parent WHERE a.kind = 'alias' AND s.kind IN ('Import', 'ImportFrom')),
trails AS (SELECT i.*, IF(element_at(parts, -1) = '__init__', slice(parts, 1, size(parts) - 1), parts) AS trail FROM (SELECT i.*, split(replace(path, '.py', ''), '/') AS parts FROM i) i),
r AS (SELECT i.*, CASE WHEN level = 0 THEN coalesce(module, '') ELSE array_join(filter(concat({_PACKAGE}, array(coalesce(module, ''))), x -> x <> ''), '.') END AS resolved FROM trails i)
SELECT concat('file:', path) AS source, CASE WHEN parent_kind = 'Import' THEN concat('module:', source_name) WHEN source_name = '*' THEN concat('module:', resolved)
    ELSE concat('module:', IF(resolved = '', '', concat(resolved, '.')), source_name) END AS target, 'import' AS type,
  filter(array(IF(in_function, 'function_scope', NULL), IF(in_try, 'conditional', NULL), IF(source_name = '*', 'dynamic', NULL)), x -> x IS NOT NULL) AS flags, alias, parent_line AS line, path, pre
FROM r
UNION ALL
SELECT concat('class:', c.path, ':', c.name), concat('class_ref:', b.ref), 'inheritance', CAST(array() AS ARRAY<STRING>), NULL, c.line, c.path, c.pre FROM n c
LATERAL VIEW explode(filter(kids, k -> k.field = 'bases' AND k.kind IN ('Name', 'Attribute') AND k.ref NOT IN {PLAIN_BASES})) AS b WHERE c.kind = 'ClassDef' AND c.parent_kind = 'Module'
UNION ALL
SELECT concat('file:', path), concat('call:', call), 'call', CAST(array() AS ARRAY<STRING>), NULL, line, path, pre FROM (
  SELECT *, concat(coalesce(concat(base, '.'), ''), name) AS call FROM n WHERE kind = 'Call' AND {kid('func')}.kind IN ('Name', 'Attribute')) WHERE split(call, '[.]')[0] NOT IN {BUILTIN_CALLS}"""



def _claim(key: str, over: bool = False, of_file: bool = False) -> str:
    return f"named_struct('key', {key}, 'over', {str(over).lower()}, 'of_file', {str(of_file).lower()})"


#: What nodes say they are called, in one scan of them; the claims of a file follow from its own nodes.
CLAIMS = f"""
SELECT c.key, IF(c.of_file, concat('file:', path), id) AS id, IF(c.of_file, struct(seq.parts AS parts, 0 AS pre), seq) AS seq, c.over FROM (
  SELECT id, path, seq, explode(concat(array({_claim('id', over=True)}),
    CASE type WHEN 'file' THEN concat(array({_claim("concat('module:', dotted)", over=True)}),
      filter(array({_claim("concat('module:', regexp_replace(dotted, '[.]?__init__$', ''))", over=True)}), x -> dotted RLIKE '(^|[.])__init__$'),
      transform(sequence(1, size(split(dotted, '[.]'))), k -> {_claim("concat('module:', array_join(slice(split(dotted, '[.]'), 1, k), '.'))")}))
    WHEN 'function' THEN array({_claim("concat('call:', short)")}, {_claim("concat('call:', name)")}) ELSE array({_claim("concat('class_ref:', name)")}) END,
    filter(array({_claim("concat('module:', dotted, '.', short)", of_file=True)}), x -> startswith(coalesce(parent_id, ''), 'file:')))) AS c
  FROM (SELECT *, replace(regexp_replace(path, '[.]py$', ''), '/', '.') AS dotted, element_at(split(name, '[.]'), -1) AS short FROM nodes))"""
#: What a name means: of the claims that overwrite the last wins, and only without any the first of the others.
KEYS = """
SELECT key, coalesce(max_by(id, seq) FILTER (WHERE over), min_by(id, seq) FILTER (WHERE NOT over)) AS id FROM claims GROUP BY key"""

#: The files that a module's name may mean, in turn.
TRIES = """
WITH parts AS (SELECT target, split(substr(target, 8), '[.]') AS p FROM open_ones)
SELECT target, concat('file:', array_join(p, '/'), '.py') AS id, 0 AS turn FROM parts
UNION ALL SELECT target, concat('file:', array_join(p, '/'), '/__init__.py'), 1 FROM parts
UNION ALL SELECT target, concat('file:', array_join(slice(p, 1, k), '/'), '.py'), 2 + size(p) - k FROM parts LATERAL VIEW explode(sequence(1, size(p))) AS k"""
#: Exact names first; modules then by path, shortening the name. Calls without a node go, other edges keep their target.
RESOLVED = f"""
WITH open_ones AS (SELECT DISTINCT e.target FROM raw_edges e LEFT ANTI JOIN keys k ON e.target = k.key WHERE startswith(e.target, 'module:')),
tries AS ({TRIES}),
found AS (SELECT t.target, min_by(t.id, t.turn) AS id FROM tries t JOIN nodes d ON d.id = t.id GROUP BY t.target)
SELECT e.source, coalesce(k.id, f.id, e.target) AS target, e.type, e.flags, e.alias, e.line, e.path, e.pre, coalesce(k.id, f.id) IS NOT NULL AS resolved
FROM raw_edges e LEFT JOIN keys k ON e.target = k.key LEFT JOIN found f ON e.target = f.target WHERE e.type <> 'call' OR k.id IS NOT NULL"""

#: rel:Model becomes the table of the class's file; of classes with one name the last in order wins.
RELATED = """
WITH models AS (SELECT c.name AS model, max_by(element_at(filter(f.tables, t -> NOT startswith(t, 'rel:')), -1), c.seq) AS t FROM nodes c JOIN nodes f ON f.id = c.parent_id AND f.type = 'file'
  WHERE c.type = 'class' AND exists(f.tables, t -> NOT startswith(t, 'rel:')) GROUP BY c.name)
SELECT d.id, transform(array_sort(collect_list(struct(d.at, IF(m.t IS NULL, d.t, concat(m.t, ' (via ', m.model, ')')) AS t))), x -> x.t) AS tables
FROM (SELECT id, at, t FROM nodes LATERAL VIEW posexplode(tables) AS at, t) d LEFT JOIN models m ON d.t = concat('rel:', m.model) GROUP BY d.id"""


@dataclass
class CodeGraph:
    nodes: DataFrame
    raw_edges: DataFrame
    edges: DataFrame
    routes: DataFrame


def facts(rows: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and routes as each file has them by itself: names are not resolved."""
    spark = rows.sparkSession
    frames = {"n": rows, "f": files}
    routes = cut(sql(spark, ROUTES, **frames))
    tables = sql(spark, TABLES, **frames)
    nodes = cut(sql(spark, NODES, code_tables=tables, code_routes=routes, **frames))
    return nodes, cut(sql(spark, EDGES, **frames)), routes


def with_related_tables(nodes: DataFrame) -> DataFrame:
    spark = nodes.sparkSession
    related = sql(spark, RELATED, nodes=nodes).withColumnRenamed("tables", "resolved_tables")
    return sql(spark, "SELECT n2.* EXCEPT (tables), coalesce(r.resolved_tables, n2.tables) AS tables FROM nodes n2 LEFT JOIN related r ON n2.id = r.id", nodes=nodes, related=related)


def resolved(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with names resolved. Only names that an edge asks for are decided, once."""
    spark = raw.sparkSession
    asked = raw.select(F.col("target").alias("key")).distinct()
    keys = cut(sql(spark, KEYS, claims=sql(spark, CLAIMS, nodes=nodes).join(asked, "key", "left_semi")))
    return sql(spark, RESOLVED, raw_edges=raw, keys=keys, nodes=nodes)


def build(rows: DataFrame, files: DataFrame) -> CodeGraph:
    """The graph of the files (path, parts, stem, content, n_lines) with these syntax rows."""
    spark = rows.sparkSession
    nodes, raw, routes = facts(rows, files)
    edges = cut(resolved(raw, nodes))
    return CodeGraph(cut(with_related_tables(nodes)), raw, edges, routes)


def node(graph: CodeGraph, id: str) -> DataFrame:
    return graph.nodes.filter(F.col("id") == id)


def edges_from(graph: CodeGraph, id: str) -> DataFrame:
    return graph.edges.filter(F.col("source") == id)


def edges_to(graph: CodeGraph, id: str) -> DataFrame:
    return graph.edges.filter(F.col("target") == id)


def map_stats(graph: CodeGraph) -> DataFrame:
    """Counts of the map: files, classes, functions, stubs, raw edges and the distinct tables."""
    return sql(
        graph.nodes.sparkSession,
        """SELECT count_if(type = 'file') AS files, count_if(type = 'class') AS classes, count_if(type = 'function') AS functions, count_if(is_stub) AS stubs,
        (SELECT count(*) FROM raw_edges) AS edges, (SELECT array_sort(collect_set(t)) FROM nodes LATERAL VIEW explode(tables) AS t) AS tables FROM nodes""",
        nodes=graph.nodes, raw_edges=graph.raw_edges,
    )
