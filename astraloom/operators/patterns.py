"""User-defined pattern rules: a small language compiled on the driver, matched as a join.

    f(...)     a call of f or of any attribute f        except:...   a bare except
    m.f(...)   a call of f on the name m                $X = V       an assignment of a constant written V
    f(arg)     as f(...) but only by name; the argument is not looked at
    anything else is text, which matches nothing
"""

from __future__ import annotations

import fnmatch
import logging
import re

from pyspark.sql import DataFrame

from astraloom.functions.tables import sql
from astraloom.operators.lint import kid, some

log = logging.getLogger(__name__)
_CALL = re.compile(r"([\w.]+)\((.+)\)")
_ASSIGN = re.compile(r"\$\w+\s*=\s*(.+)")


def compiled(rule: dict) -> tuple | None:
    """(id, severity, form, base, name, value, globs as one regex) or None for a rule without id or pattern."""
    if "id" not in rule or "pattern" not in rule:
        log.warning("a pattern rule needs id and pattern: %s", rule)
        return None
    text = rule["pattern"].strip()
    form, base, name, value = "text", None, None, None
    if text == "except:...":
        form = "bare"
    elif (m := _CALL.fullmatch(text)) and (m[2] == "..." or not _ASSIGN.fullmatch(text)):
        parts = m[1].split(".")
        if len(parts) <= 2:
            form = ("call" if m[2] == "..." else "named") if len(parts) == 1 else "method"
            base, name = (None, parts[0]) if len(parts) == 1 else parts
    elif m := _ASSIGN.fullmatch(text):
        form, value = "assign", m[1].strip()
    globs = rule.get("exclude_files") or []
    return f"PATTERN:{rule['id']}", rule.get("severity", "med"), form, base, name, value, "|".join(f"(?:{_java(g)})" for g in globs) or None


def _java(glob: str) -> str:
    return re.sub(r"\\[zZ]$", "", fnmatch.translate(glob)).replace("(?>", "(?:")


def pattern_findings(rows: DataFrame, rules: list[dict]) -> DataFrame:
    """tier, path, line, rule, severity, symbol of every match."""
    spark = rows.sparkSession
    known = [c for r in rules if (c := compiled(r))]
    table = spark.createDataFrame(known, "rule string, severity string, form string, base string, name string, value string, skip string")
    return sql(
        spark,
        f"""
WITH facts AS (
  SELECT path, line, pre, 'call' AS form, base, name, CAST(NULL AS STRING) AS a, CAST(NULL AS STRING) AS b, {kid('func')}.kind AS by FROM n WHERE kind = 'Call' AND {kid('func')}.kind IN ('Name', 'Attribute')
  UNION ALL SELECT path, line, pre, 'bare', NULL, NULL, NULL, NULL, NULL FROM n WHERE kind = 'ExceptHandler' AND NOT {some('type', 'true')}
  UNION ALL SELECT s.path, s.line, s.pre, 'assign', NULL, NULL, c.const_str, c.const_repr, NULL FROM n s JOIN n c ON c.path = s.path AND c.parent = s.pre AND c.field = 'value' WHERE s.kind = 'Assign' AND c.kind = 'Constant')
SELECT 'pattern' AS tier, f.path, CAST(f.line AS BIGINT) AS line, r.rule, r.severity, coalesce(f.name, f.a, '') AS symbol FROM facts f JOIN pattern_rules r
  ON f.form = IF(r.form IN ('named', 'method'), 'call', r.form)
  AND CASE r.form WHEN 'call' THEN f.name = r.name WHEN 'named' THEN f.name = r.name AND f.by = 'Name' WHEN 'method' THEN f.name = r.name AND f.base = r.base
    WHEN 'assign' THEN f.a = r.value OR f.b = r.value WHEN 'bare' THEN true ELSE false END
WHERE NOT coalesce(regexp_like(f.path, concat('^(?:', r.skip, ')$')), false)""",
        n=rows, pattern_rules=table,
    )
