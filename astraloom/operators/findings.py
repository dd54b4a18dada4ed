"""Algebra of findings: collect, gate, compare, count, rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("tier", "path", "line", "rule", "severity", "symbol")
#: Which tiers the gate looks at and which a comparison does.
GATE_TIERS = ("lint", "xref", "ai", "verified", "claude")
DIFF_TIERS = (*GATE_TIERS, "pattern")


def collect(*frames: DataFrame, tiers: tuple[str, ...] = DIFF_TIERS) -> DataFrame:
    """All findings of the tiers, with missing columns as nulls."""
    out: DataFrame | None = None
    for frame in frames:
        for name in COLUMNS:
            if name not in frame.columns:
                frame = frame.withColumn(name, F.lit(None).cast("long" if name == "line" else "string"))
        frame = frame.select(*COLUMNS)
        out = frame if out is None else out.unionByName(frame)
    return out.filter(F.col("tier").isin(*tiers))


def rank(severity: Column) -> Column:
    """low 1, med 2, high 3; anything else, such as crit, 0."""
    return F.when(severity == "low", 1).when(severity == "med", 2).when(severity == "high", 3).otherwise(0)


def gate(found: DataFrame, threshold: str) -> bool:
    """True if a finding is as severe as the threshold."""
    least = {"low": 1, "med": 2, "high": 3}[threshold]
    return not found.filter(F.col("tier").isin(*GATE_TIERS) & (rank(F.col("severity")) >= least)).limit(1).isEmpty()


KEY = ("rule", "path", "line", "symbol")


def diff(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings by rule, path, line and symbol, each once: change is new, resolved or unchanged."""
    match = lambda a, b: [a[k].eqNullSafe(b[k]) for k in KEY]
    # of findings with one key the most severe stays, so that the result does not depend on order
    one = lambda df: df.groupBy(*KEY).agg(F.max_by("severity", rank(F.col("severity"))).alias("severity"))
    now, then = one(current), one(baseline)
    new = now.join(then, match(now, then), "left_anti").withColumn("change", F.lit("new"))
    same = now.join(then, match(now, then), "left_semi").withColumn("change", F.lit("unchanged"))
    gone = then.join(now, match(then, now), "left_anti").withColumn("change", F.lit("resolved"))
    return new.unionByName(same).unionByName(gone)


def regressed(changes: DataFrame) -> bool:
    """True if a new finding is high."""
    return not changes.filter("change = 'new' AND severity = 'high'").limit(1).isEmpty()


def by_severity(found: DataFrame) -> DataFrame:
    """One row: high, med, low and other."""
    s = F.lower(F.coalesce("severity", F.lit("")))
    return found.agg(*(F.count_if(s == x).alias(x) for x in ("high", "med", "low")), F.count_if(~s.isin("high", "med", "low")).alias("other"))


def most_severe(found: DataFrame, n: int = 25) -> DataFrame:
    """The first n by severity, then by place."""
    return found.orderBy(rank(F.col("severity")).desc(), "path", "line", "rule", "symbol").limit(n)
