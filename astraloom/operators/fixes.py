"""Automatic fixes as row-level rewrites: all are decided against the original line numbers in one pass; lines keep their own ends."""

from __future__ import annotations

from pyspark.sql import DataFrame

from astraloom.functions.tables import sql

#: A line that is one import of one name.
ONE_IMPORT = r"^\\s*(import\\s+[A-Za-z0-9_.]+|from\\s+[A-Za-z0-9_.]+\\s+import\\s+\\w+)(\\s+as\\s+\\w+)?\\s*$"
SIGNATURE = r"^(\\s*(?:def|async\\s+def)\\s+\\w+\\s*\\()([^)]*)(\\).*)$"
FUTURE = r"^\\s*from\\s+__future__\\s+import\\s+annotations\\s*$"


def fixed(files: DataFrame, findings: DataFrame, rules: tuple[str, ...] = ("DEAD_IMPORT", "UNUSED_PARAM", "DEAD_FUTURE_IMPORT")) -> DataFrame:
    """path, content after the fixes, and how often each was made, for files that change.

    DEAD_IMPORT drops a line that imports one name; UNUSED_PARAM puts an underscore before a parameter's first place
    in a one-line signature; DEAD_FUTURE_IMPORT drops the annotations import in every file outside hidden folders.
    """
    want = {r: str(r in rules).lower() for r in ("DEAD_IMPORT", "UNUSED_PARAM", "DEAD_FUTURE_IMPORT")}
    return sql(
        files.sparkSession,
        f"""
WITH lines AS (SELECT path, at + 1 AS line, regexp_extract(piece, '^([^\\r\\n]*)', 1) AS text, regexp_extract(piece, '([\\r\\n]*)$', 1) AS ending FROM f LATERAL VIEW posexplode(split(content, '(?<=\\n)|(?<=\\r)(?!\\n)')) AS at, piece),
hits AS (SELECT path, line, max(rule = 'DEAD_IMPORT') AS dead, array_sort(collect_set(IF(rule = 'UNUSED_PARAM' AND NOT startswith(symbol, '_'), symbol, NULL))) AS params FROM found WHERE rule IN ('DEAD_IMPORT', 'UNUSED_PARAM') GROUP BY path, line),
marked AS (SELECT l.path, l.line, l.text, l.ending, {want['DEAD_IMPORT']} AND coalesce(h.dead, false) AND l.text RLIKE '{ONE_IMPORT}' AS drop_import,
  {want['DEAD_FUTURE_IMPORT']} AND l.text RLIKE '{FUTURE}' AND NOT exists(split(l.path, '/'), p -> startswith(p, '.') OR p IN ('__pycache__', 'node_modules')) AS drop_future,
  IF({want['UNUSED_PARAM']} AND l.text RLIKE '{SIGNATURE}', coalesce(h.params, CAST(array() AS ARRAY<STRING>)), CAST(array() AS ARRAY<STRING>)) AS params FROM lines l LEFT JOIN hits h ON h.path = l.path AND h.line = l.line),
renamed AS (SELECT *, aggregate(params, named_struct('sig', regexp_extract(text, '{SIGNATURE}', 2), 'n', 0),
  (s, p) -> IF(regexp_like(s.sig, concat('\\\\b', p, '\\\\b')), named_struct('sig', concat(regexp_extract(s.sig, concat('^(.*?)\\\\b', p, '\\\\b'), 1), '_', substr(s.sig, length(regexp_extract(s.sig, concat('^(.*?)\\\\b', p, '\\\\b'), 1)) + 1)), 'n', s.n + 1), s)) AS s FROM marked)
SELECT path, array_join(transform(array_sort(collect_list(IF(drop_import OR drop_future, NULL, struct(line, concat(IF(s.n > 0, concat(regexp_extract(text, '{SIGNATURE}', 1), s.sig, regexp_extract(text, '{SIGNATURE}', 3)), text), ending) AS t)))), x -> x.t), '') AS content,
  count_if(drop_import) AS dead_imports, CAST(sum(s.n) AS BIGINT) AS unused_params, count_if(drop_future AND NOT drop_import) AS future_imports
FROM renamed GROUP BY path HAVING dead_imports + unused_params + future_imports > 0""",
        f=files, found=findings,
    )
