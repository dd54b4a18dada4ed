"""Cross references: who imports, calls and names a symbol, and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame

from astraloom.functions.tables import cut, sql
from astraloom.operators.code_graph import CodeGraph
from astraloom.operators.lint import DEFS, UPPER, among, kid

#: Decorators whose functions are called by a framework; names that are injected or overridden.
HANDLERS = "array" + among("get post put delete patch head options route websocket on_event middleware property cached_property lru_cache cache staticmethod classmethod register listener event signal task celery")
INJECTED = among("get_db get_current_user require_admin require_permission get_session get_token")
OVERRIDES = among(
    "handle_starttag handle_endtag handle_data handle_startendtag handle_comment handle_decl handle_pi handle_charref handle_entityref feed close reset "
    "setUp tearDown setUpClass tearDownClass test_ do_GET do_POST do_PUT do_DELETE do_HEAD do_OPTIONS do_PATCH do_TRACE do_CONNECT "
    "log_message log_request log_error version_string send_error send_response send_header end_headers "
    "__enter__ __exit__ __repr__ __str__ __init__ __del__ __hash__ __eq__ __lt__ __gt__ __le__ __ge__ __ne__ __call__ __iter__ __next__ __len__ __getitem__ __setitem__ __delitem__ __contains__ __aenter__ __aexit__"
)

SYMBOLS = f"""
WITH defined AS (SELECT path, element_at(split(name, '[.]'), -1) AS name, max_by(struct(type, line_start AS line, decorators, name AS full), seq) AS s FROM nodes WHERE type IN ('function', 'class') GROUP BY 1, 2),
assigned AS (SELECT path, name, min_by(struct(CASE WHEN {UPPER.format('name')} OR (contains(name, '_') AND {UPPER.format('substr(name, 1, 1)')}) THEN 'constant' ELSE 'variable' END AS type, parent_line AS line), pre) AS s
  FROM n WHERE kind = 'Name' AND field = 'targets' AND parent_kind = 'Assign' AND gp_kind = 'Module' AND (NOT startswith(name, '_') OR startswith(name, '__')) GROUP BY path, name)
SELECT path, name, s.type, s.line, s.decorators FROM defined
UNION ALL SELECT a.path, a.name, a.s.type, a.s.line, CAST(array() AS ARRAY<STRING>) FROM assigned a LEFT ANTI JOIN defined d ON a.path = d.path AND a.name = d.name"""

#: Names that their own file uses: on another line than the definition, as an object, or in any function.
INTERNAL = f"""
WITH lines AS (SELECT path, name, max_by(line, pre) AS line FROM (
  SELECT path, name, parent_line AS line, pre FROM n WHERE kind = 'Name' AND field = 'targets' AND parent_kind = 'Assign' AND gp_kind = 'Module'
  UNION ALL SELECT path, name, line, pre FROM n WHERE (kind IN {DEFS} OR kind = 'ClassDef') AND parent_kind = 'Module') GROUP BY path, name)
SELECT DISTINCT v.path, v.name FROM n v LEFT SEMI JOIN symbols s ON s.path = v.path AND s.name = v.name LEFT JOIN lines l ON l.path = v.path AND l.name = v.name
WHERE v.kind = 'Name' AND (v.line <> coalesce(l.line, 0) OR v.parent_kind = 'Attribute' OR size(v.fns) > 0)"""

#: Per name and file how often the name is imported, called and referenced; a reference of a name that the file itself defines is none.
USES = f"""
SELECT name, file, sum(n_imported) AS n_imported, sum(n_called) AS n_called, sum(n_referenced) AS n_referenced, min(IF(n_imported > 0, line, NULL)) AS import_line, min(IF(n_called > 0, line, NULL)) AS call_line FROM (
  SELECT source_name AS name, path AS file, count(*) AS n_imported, 0 AS n_called, 0 AS n_referenced, min(parent_line) AS line FROM n WHERE kind = 'alias' AND parent_kind = 'ImportFrom' GROUP BY source_name, path
  UNION ALL SELECT name, path, 0, count(*), 0, min(line) FROM n WHERE kind = 'Call' AND {kid('func')}.kind IN ('Name', 'Attribute') GROUP BY name, path
  UNION ALL SELECT v.name, v.path, 0, 0, 1, v.line FROM (SELECT path, name, min(line) AS line FROM n WHERE kind = 'Name' GROUP BY path, name) v LEFT ANTI JOIN symbols own ON own.path = v.path AND own.name = v.name) u
LEFT SEMI JOIN (SELECT DISTINCT name FROM symbols) s ON s.name = u.name GROUP BY u.name, file"""

#: A symbol's uses are those of its name less those of its own file; names are counted once, however many files define them.
USAGE = """
WITH totals AS (SELECT name, sum(n_imported) AS n_imported, sum(n_called) AS n_called, sum(n_referenced) AS n_referenced, count_if(n_imported + n_called > 0) AS n_dependents FROM uses GROUP BY name)
SELECT s.path, s.name, s.type, s.line, s.decorators, coalesce(t.n_imported, 0) - coalesce(o.n_imported, 0) AS n_imported, coalesce(t.n_called, 0) - coalesce(o.n_called, 0) AS n_called,
  IF(s.type IN ('constant', 'variable'), coalesce(t.n_referenced, 0), 0) AS n_referenced, coalesce(t.n_dependents, 0) - IF(coalesce(o.n_imported + o.n_called, 0) > 0, 1, 0) AS n_dependents, i.name IS NOT NULL AS internal
FROM symbols s LEFT JOIN totals t ON t.name = s.name LEFT JOIN uses o ON o.name = s.name AND o.file = s.path LEFT JOIN internal i ON i.path = s.path AND i.name = s.name"""

#: The first files by name that import or call a symbol, so many at most: its own file may be among those of the name.
USERS = """
WITH some AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name, how ORDER BY file) AS r FROM (
  SELECT name, file, import_line AS line, 'imported' AS how FROM uses WHERE n_imported > 0 UNION ALL SELECT name, file, call_line, 'called' FROM uses WHERE n_called > 0)) WHERE r <= {0} + 1)
SELECT path, name, how, file, line FROM (SELECT s.path, s.name, u.how, u.file, u.line, row_number() OVER (PARTITION BY s.path, s.name, u.how ORDER BY u.file) AS r
  FROM symbols s JOIN some u ON u.name = s.name AND u.file <> s.path) WHERE r <= {0}"""

FINDINGS = f"""
WITH asked AS (SELECT * FROM usage WHERE NOT startswith(name, '_') AND name <> 'main' AND name NOT IN {INJECTED} AND name NOT IN {OVERRIDES}
  AND NOT (type = 'function' AND exists(decorators, d -> arrays_overlap(split(lower(d), '[.]'), {HANDLERS})))),
bodies AS (SELECT d.path, d.line_start AS line, element_at(split(d.name, '[.]'), -1) AS name, d.line_end - d.line_start + 1 AS n_lines,
  array_join(filter(transform(slice(split(f.content, '\\r\\n|\\n|\\r'), d.line_start + 1, d.line_end - d.line_start), x -> regexp_replace(x, '^\\\\s+|\\\\s+$', '')), x -> x <> ''), '\\n') AS body
  FROM nodes d JOIN f ON f.path = d.path WHERE d.type = 'function' AND (NOT startswith(d.name, '_') OR d.name = '__init__')),
same AS (SELECT md5(body) AS hash FROM bodies WHERE n_lines >= 3 AND length(body) >= 30 GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT path) >= 2)
SELECT 'XREF_UNUSED_SYMBOL' AS rule, 'med' AS severity, path, line, name AS symbol FROM asked WHERE type IN ('function', 'class') AND n_imported + n_called + n_referenced = 0 AND NOT internal
UNION ALL SELECT 'XREF_UNUSED_CONSTANT', 'low', path, line, name FROM asked WHERE type = 'constant' AND n_imported + n_called + n_referenced = 0 AND NOT internal
UNION ALL SELECT 'XREF_IMPORTED_NOT_CALLED', 'low', path, line, name FROM asked WHERE type = 'function' AND n_imported > 0 AND n_called = 0 AND n_referenced = 0 AND NOT internal
UNION ALL SELECT 'XREF_DUPLICATE_FUNCTION', 'med', b.path, b.line, b.name FROM bodies b JOIN same s ON md5(b.body) = s.hash WHERE b.n_lines >= 3 AND length(b.body) >= 30
UNION ALL SELECT 'XREF_SHOTGUN_SURGERY', 'low', path, line, name FROM usage WHERE n_dependents >= 5"""

#: As calls resolve to functions and never to files, envy as it stands finds nothing; the second asks what was meant, through the function's file.
ENVY = """SELECT 'XREF_FEATURE_ENVY' AS rule, 'med' AS severity, e.path, 1L AS line, e.target AS symbol FROM edges e WHERE e.type = 'call' AND startswith(e.target, 'file:') AND false"""
ENVY_INTENT = """
WITH calls AS (SELECT e.path, d.path AS callee, count(*) AS n FROM edges e JOIN nodes d ON d.id = e.target WHERE e.type = 'call' GROUP BY 1, 2),
top AS (SELECT path, max_by(callee, struct(n, callee)) AS callee, max(n) AS n FROM calls WHERE path <> callee GROUP BY path)
SELECT 'XREF_FEATURE_ENVY_INTENT' AS rule, 'med' AS severity, t.path, 1L AS line, t.callee AS symbol FROM top t LEFT JOIN calls o ON o.path = t.path AND o.callee = t.path WHERE t.n > 5 AND t.n > 2 * coalesce(o.n, 0)"""


class CrossReferences:
    def __init__(self, rows: DataFrame, files: DataFrame, graph: CodeGraph):
        spark = rows.sparkSession
        self.symbols = cut(sql(spark, SYMBOLS, n=rows, nodes=graph.nodes))
        internal = sql(spark, INTERNAL, n=rows, symbols=self.symbols)
        self.uses = cut(sql(spark, USES, n=rows, symbols=self.symbols))
        self.usage = cut(sql(spark, USAGE, symbols=self.symbols, uses=self.uses, internal=internal))
        self.findings = sql(spark, FINDINGS, usage=self.usage, nodes=graph.nodes, f=files)
        self.envy = sql(spark, ENVY, edges=graph.edges)
        self.envy_intent = sql(spark, ENVY_INTENT, edges=graph.edges, nodes=graph.nodes)

    def users(self, n: int = 3) -> DataFrame:
        """path, name, how (imported or called), file, line: the first n files by name that use each symbol."""
        return sql(self.usage.sparkSession, USERS.format(int(n)), symbols=self.symbols, uses=self.uses)

    def top(self, n: int = 5) -> DataFrame:
        """The most used symbols."""
        return sql(self.usage.sparkSession, f"SELECT path, name, n_imported + n_called + n_referenced AS uses FROM usage ORDER BY uses DESC, split(path, '/'), line LIMIT {int(n)}", usage=self.usage)
