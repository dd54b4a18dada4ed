"""Mixing sources to target weights: hierarchical budgets and seeded token prefixes, DataFrame operations only.

The tree is domain, language, source. A budget of tokens goes down by weights: at every node the children share their
parent's budget in proportion to their weights, a child that holds less than its share gives the rest to its
siblings, and since a node never gets more than its subtree holds, what siblings cannot take has gone to the
ancestors' other children already. In the order of capacity over weight the children that saturate form a prefix,
the others share what is left. All in integers; floors leave a few tokens unspent.

No node's children are sorted in one task: sums per class of capacity over weight (classes are about 1 in 90 wide), at most
some thousands a node, tell in which class the prefix ends; there children of one capacity and weight count together.

A leaf holds its tokens once per epoch, up to `epochs`. Whole epochs take all its documents; the last one takes
the prefix of a seeded order whose documents start within the rest of the budget. The prefix is found in two
steps, so that no leaf is sorted in one task: tokens per leaf and hash bucket, then running sums of the one bucket
where the budget ends, in which rows of one id and size count together.

Null domains, languages and sources count as 'none'. Null, empty and wordless texts have no tokens; they are taken with
the place in the order that they have. Very long texts count whole. A null id's place follows from its text, and rows
that repeat an id are rows like others, so a budget may end between them. Ties in size or name go by name. An empty
table gives no rows. Other columns are left out, or kept as they are by `keep_mixed`, whatever they are called.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from astraloom.llm.common import bounded, release, written

LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class Mix:
    """Weights by name per level (others get `other`); the budget is `share` hundredths of all tokens."""

    domain: tuple[tuple[str, int], ...] = (("web", 5), ("reference", 3), ("forum", 2))
    lang: tuple[tuple[str, int], ...] = (("en", 5), ("de", 2), ("es", 2), ("fr", 2))
    source: tuple[tuple[str, int], ...] = (("src0", 3),)
    other: int = 1
    share: int = 60
    epochs: int = 3
    seed: str = "mix-1"
    bucket_digits: int = 3  # of the hash in hexadecimal: 16 ** 3 buckets in a leaf


def domain_of(source: Column) -> Column:
    """The domain of a source of `documents`: by the first digit of its hash."""
    digit = F.substring(F.md5(source), 1, 1)
    return F.when(source.isNull(), F.lit(None)).when(digit < "8", "web").when(digit < "d", "reference").otherwise("forum")


def _weight(level: str, mix: Mix) -> Column:
    found = F.lit(mix.other)
    for name, weight in reversed(getattr(mix, level)):
        found = F.when(F.col(level) == name, weight).otherwise(found)
    return found.cast("long")


#: Classes of capacity over weight per doubling. Plans of leaves of at most so many rows are broadcast, after they are counted.
CLASSES, FEW = 64, 100_000


def _exact(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def _per(nodes: DataFrame, parents: list[str], plan: DataFrame) -> DataFrame:
    """nodes with their parents' row of the plan; adaptive execution broadcasts a small plan and splits a large parent."""
    return nodes.join(plan, parents) if parents else nodes.join(F.broadcast(plan), F.lit(True))  # without parents the plan is one row


def share_out(nodes: DataFrame, parents: list[str], level: str) -> DataFrame:
    """nodes: parents, level, weight, capacity and parent_budget; adds the node's budget."""
    ratio = F.col("capacity") / F.col("weight")
    nodes = nodes.withColumn("ratio", ratio).withColumn("class", F.when(F.col("capacity") > 0, F.floor(F.log2(ratio) * CLASSES)).otherwise(F.lit(-(1 << 20))).cast("int"))
    sums = nodes.groupBy(*parents, "class").agg(
        F.sum("capacity").alias("c"), F.sum("weight").alias("w"), F.max(F.struct("ratio", level, "capacity", "weight")).alias("last"), F.first("parent_budget").alias("b")
    )
    by = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    upto = by.orderBy("class").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = sums.withColumn("c_before", F.sum("c").over(upto) - F.col("c")).withColumn("w_before", F.sum("w").over(upto) - F.col("w")).withColumn("w_all", F.sum("w").over(by))
    # a class saturates if its last child does
    left = F.col("b") - (F.col("c_before") + F.col("c") - F.col("last.capacity"))
    rest = F.col("w_all") - (F.col("w_before") + F.col("w") - F.col("last.weight"))
    run = run.withColumn("full", _exact(F.col("last.capacity")) * _exact(rest) <= _exact(F.col("last.weight")) * _exact(left))
    ends = run.groupBy(*parents).agg(
        F.min(F.when(~F.col("full"), F.struct("class", "c_before", "w_before"))).alias("end"), F.first("w_all").alias("w_all"), F.first("b").alias("b"),
        F.coalesce(F.sum(F.when(F.col("full"), F.col("c"))), F.lit(0)).alias("taken"), F.coalesce(F.sum(F.when(~F.col("full"), F.col("w"))), F.lit(0)).alias("open"),
    )
    ends = ends.select(*parents, F.col("end.class").alias("end"), "end.c_before", "end.w_before", "w_all", "b", "taken", "open")
    alike = _per(nodes.drop("parent_budget"), parents, ends).filter(F.col("class") == F.col("end")).groupBy(*parents, "capacity", "weight", "ratio").agg(
        F.count(F.lit(1)).alias("n"), *(F.first(x).alias(x) for x in ("c_before", "w_before", "w_all", "b"))
    )
    before = by.orderBy("ratio", "capacity").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c_run = F.col("c_before") + F.sum(F.col("n") * F.col("capacity")).over(before) - F.col("n") * F.col("capacity")
    w_run = F.col("w_before") + F.sum(F.col("n") * F.col("weight")).over(before) - F.col("n") * F.col("weight")
    full = alike.withColumn("full", _exact(F.col("capacity")) * _exact(F.col("w_all") - w_run) <= _exact(F.col("weight")) * _exact(F.col("b") - c_run)).filter("full")
    more = full.groupBy(*parents).agg(F.max("ratio").alias("last_ratio"), F.sum(F.col("n") * F.col("capacity")).alias("c_more"), F.sum(F.col("n") * F.col("weight")).alias("w_more"))
    plan = ends.join(more, parents, "left") if parents else ends.join(F.broadcast(more), F.lit(True), "left")
    taken, opened = F.col("taken") + F.coalesce("c_more", F.lit(0)), F.col("open") - F.coalesce("w_more", F.lit(0))
    plan = plan.select(*parents, "end", "last_ratio", taken.alias("taken"), F.greatest(opened, F.lit(1)).alias("open"), "b")
    saturates = F.col("end").isNull() | (F.col("class") < F.col("end")) | F.coalesce((F.col("class") == F.col("end")) & (F.col("ratio") <= F.col("last_ratio")), F.lit(False))
    shared = F.call_function("div", _exact(F.col("weight")) * _exact(F.col("b") - F.col("taken")), _exact(F.col("open")))
    found = _per(nodes, parents, plan).withColumn("budget", F.when(saturates, F.col("capacity")).otherwise(shared).cast("long"))
    return found.select(*nodes.drop("ratio", "class").columns, "budget")


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """leaves: domain, lang, source, tokens. Adds each leaf's budget."""
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()["n"]
    found = leaves.withColumn("capacity", F.col("tokens") * mix.epochs).withColumn("parent_budget", F.lit(int(total) * mix.share // 100).cast("long"))
    for depth, level in enumerate(LEVELS):
        parents = list(LEVELS[:depth])
        own = found.groupBy(*parents, level).agg(F.sum("capacity").alias("capacity"), F.first("parent_budget").alias("parent_budget")).withColumn("weight", _weight(level, mix))
        shared = share_out(own, parents, level).select(*parents, level, F.col("budget").alias("own_budget"))
        last, found = found, written(found.join(shared, [*parents, level]).withColumn("parent_budget", F.col("own_budget")).drop("own_budget"), "mix-budgets")
        release(last)
    return found.select(*LEVELS, "tokens", F.col("parent_budget").alias("budget"))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _mark(id_col: str, text_col: str = "text") -> Column:
    """What a row's place in the seeded order follows from."""
    return F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))


def _key(mix: Mix, mark: Column, whole: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(mix.seed), whole.cast("string"), mark))


def _planned(docs: DataFrame, mix: Mix, id_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: a mark per row; a plan per leaf (budget, whole epochs, rest, the bucket where the rest ends and the tokens before it);
    of the rows in that bucket, by key and size, how many there are and how many start within the rest."""
    named = docs.select(id_col, *(F.coalesce(F.col(x), F.lit("none")).alias(x) for x in LEVELS), n_words(F.col("text")).alias("n_tokens"), _mark(id_col).alias("mark"))
    marks = written(named, "mix-marks")
    leaves = written(marks.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "mix-leaves")
    whole = F.when(F.col("tokens") > 0, F.call_function("div", F.col("budget"), F.col("tokens"))).otherwise(0).cast("int")
    first = written(budgets(leaves, mix).withColumn("whole", whole).withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens")), "mix-plan")
    # where in the seeded order the rest of each leaf's budget ends
    keyed = marks.join(bounded(first.filter("rest > 0"), FEW), list(LEVELS)).withColumn("key", _key(mix, F.col("mark"), F.col("whole"))).withColumn("bucket", F.substring("key", 1, mix.bucket_digits))
    heap = keyed.groupBy(*LEVELS, "bucket", "rest").agg(F.sum("n_tokens").alias("inside"))
    before = F.sum("inside").over(Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("inside")
    edge = heap.withColumn("before", before).filter("before < rest and before + inside >= rest").select(*LEVELS, F.col("bucket").alias("edge"), "before")
    plan = written(first.join(edge, list(LEVELS), "left"), "mix-plan")
    inside = marks.join(bounded(plan.filter("edge is not null"), FEW), list(LEVELS)).withColumn("key", _key(mix, F.col("mark"), F.col("whole"))).filter(F.col("key").startswith(F.col("edge")))
    alike = inside.groupBy(*LEVELS, id_col, "key", "n_tokens", "before", "rest").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(*LEVELS).orderBy("key", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.col("rest") - (F.col("before") + F.sum(F.col("n") * F.col("n_tokens")).over(upto) - F.col("n") * F.col("n_tokens"))
    fit = F.when(left <= 0, 0).when(F.col("n_tokens") == 0, F.col("n")).otherwise(F.least("n", F.call_function("div", left + F.col("n_tokens") - 1, F.greatest("n_tokens", F.lit(1)))))
    ends = written(alike.withColumn("fit", fit.cast("long")).select(*LEVELS, id_col, "key", "n_tokens", "n", "fit"), "mix-ends")
    release(first)
    release(leaves)
    return marks, plan, ends


def mixed(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id") -> DataFrame:
    """docs: id, text, domain, lang, source. One row per taken document and epoch: id, domain, lang, source, epoch, n_tokens, budget of the leaf."""
    marks, plan, ends = _planned(docs, mix, id_col)
    bucket = F.substring(_key(mix, F.col("mark"), F.col("whole")), 1, mix.bucket_digits)
    part = F.when(F.col("rest") <= 0, 0).when(F.col("bucket") < F.col("edge"), 1).otherwise(0)
    rows = marks.join(bounded(plan, FEW), list(LEVELS)).withColumn("bucket", bucket).filter("edge is null or bucket <> edge").withColumn("part", part)
    last = ends.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).withColumn("part", (F.col("copy") <= F.col("fit")).cast("int")).drop("n", "fit", "copy", "key")
    last = last.join(bounded(plan, FEW), list(LEVELS))
    fields = [id_col, *LEVELS, "n_tokens", "budget", "whole", "part"]
    taken = last.select(*fields).unionByName(rows.select(*fields)).withColumn("epochs", F.col("whole") + F.col("part")).filter("epochs > 0")
    return taken.select(id_col, *LEVELS, F.explode(F.sequence(F.lit(0), F.col("epochs").cast("int") - 1)).alias("epoch"), "n_tokens", "budget")


def mix_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The query over `documents`, whose domain follows from the source."""
    return mixed(docs.select("doc_id", "text", domain_of(F.col("source")).alias("domain"), "lang", "source"), mix)


def keep_mixed(docs: DataFrame, mix: Mix) -> DataFrame:
    """The rows that the mix takes, once, with all their columns as they were.

    Plans travel to the rows, so texts don't move. Of rows that share id and size where a budget ends, the least by the hash of their text stay.
    """
    _, plan, ends = _planned(docs.select("doc_id", "text", domain_of(F.col("source")).alias("domain"), "lang", "source"), mix, "doc_id")
    own = {level: F.coalesce(c, F.lit("none")) for level, c in zip(LEVELS, (domain_of(F.col("source")), F.col("lang"), F.col("source")), strict=True)}
    rows = docs
    for level, c in own.items():
        rows = rows.withColumn(f"_mix_{level}", c)
    renamed = plan.select(*(F.col(c).alias(f"_mix_{c}") for c in (*LEVELS, "whole", "edge", "rest")))
    leaf = [f"_mix_{x}" for x in LEVELS]
    rows = rows.join(bounded(renamed, FEW), leaf).withColumn("_mix_key", _key(mix, _mark("doc_id"), F.col("_mix_whole")))
    rows = rows.withColumn("_mix_bucket", F.substring("_mix_key", 1, mix.bucket_digits))
    surely = (F.col("_mix_whole") > 0) | F.coalesce((F.col("_mix_rest") > 0) & (F.col("_mix_bucket") < F.col("_mix_edge")), F.lit(False))
    # the size matters only where a budget ends
    size = F.when(F.col("_mix_bucket") == F.col("_mix_edge"), n_words(F.col("text")))
    counted = ends.select(*(F.col(x).alias(f"_mix_{x}") for x in (*LEVELS, "key", "n_tokens", "n", "fit")))
    rows = rows.withColumn("_mix_n_tokens", size).join(bounded(counted, FEW), [*leaf, "_mix_key", "_mix_n_tokens"], "left").withColumn("_mix_sure", surely)
    some = (F.col("_mix_fit") > 0) & (F.col("_mix_fit") < F.col("_mix_n")) & ~F.col("_mix_sure")
    kept = rows.filter(F.col("_mix_sure") | F.coalesce(F.col("_mix_fit") == F.col("_mix_n"), F.lit(False)))
    if ends.filter("fit > 0 and fit < n").limit(1).count():
        order = Window.partitionBy(*leaf, "_mix_key", "_mix_n_tokens").orderBy(F.xxhash64("text"))
        kept = kept.unionByName(rows.filter(some).withColumn("_mix_at", F.row_number().over(order)).filter("_mix_at <= _mix_fit").drop("_mix_at"))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def oracle(mix: Mix = Mix()) -> str:
    """DuckDB SQL for mix_documents."""

    def weight(level: str) -> str:
        return "CASE " + " ".join(f"WHEN {level} = '{n}' THEN {w}" for n, w in getattr(mix, level)) + f" ELSE {mix.other} END"

    levels = ""
    before = "leaves0"
    for depth, level in enumerate(LEVELS):
        parents = ", ".join(LEVELS[:depth])
        by = f"PARTITION BY {parents}" if parents else ""
        keys = ", ".join([*LEVELS[:depth], level])
        levels += f""",
own{depth} AS (SELECT {keys}, sum(capacity)::HUGEINT AS capacity, any_value(parent_budget)::HUGEINT AS parent_budget, ({weight(level)})::HUGEINT AS weight FROM {before} GROUP BY {keys}),
run{depth} AS (SELECT *, sum(capacity) OVER (w ROWS UNBOUNDED PRECEDING) - capacity AS c_before, sum(weight) OVER (w ROWS UNBOUNDED PRECEDING) - weight AS w_before,
  sum(weight) OVER ({by}) AS w_all FROM own{depth} WINDOW w AS ({by} ORDER BY capacity / weight, {level})),
full{depth} AS (SELECT *, capacity * (w_all - w_before) <= weight * (parent_budget - c_before) AS is_full FROM run{depth}),
shared{depth} AS (SELECT {keys}, CASE WHEN is_full THEN capacity ELSE (weight * (parent_budget - sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER ({by}))) //
  greatest(sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({by}), 1) END AS budget FROM full{depth}),
leaves{depth + 1} AS (SELECT l.domain, l.lang, l.source, l.tokens, l.capacity, s.budget AS parent_budget FROM {before} l JOIN shared{depth} s USING ({keys}))"""
        before = f"leaves{depth + 1}"
    return f"""
WITH marks AS (SELECT doc_id, CASE WHEN source IS NULL THEN 'none' WHEN substr(md5(source), 1, 1) < '8' THEN 'web' WHEN substr(md5(source), 1, 1) < 'd' THEN 'reference' ELSE 'forum' END AS domain,
  coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, ''))) AS mark, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens FROM documents),
leaves0 AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS tokens, sum(n_tokens)::HUGEINT * {mix.epochs} AS capacity, (sum(sum(n_tokens)) OVER () * {mix.share})::HUGEINT // 100 AS parent_budget FROM marks GROUP BY ALL){levels},
plan AS (SELECT domain, lang, source, parent_budget AS budget, CASE WHEN tokens > 0 THEN parent_budget // tokens ELSE 0 END AS whole,
  parent_budget - CASE WHEN tokens > 0 THEN parent_budget // tokens ELSE 0 END * tokens AS rest FROM {before}),
keyed AS (SELECT m.*, p.budget, p.whole, p.rest, md5('{mix.seed}:' || p.whole || ':' || m.mark) AS k FROM marks m JOIN plan p USING (domain, lang, source)),
placed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k, n_tokens ROWS UNBOUNDED PRECEDING) - n_tokens AS start,
  sum(n_tokens) OVER (PARTITION BY domain, lang, source, substr(k, 1, {mix.bucket_digits})) AS inside,
  substr(k, 1, {mix.bucket_digits}) AS bucket FROM keyed),
taken AS (SELECT *, whole + CASE WHEN rest > 0 AND start < rest THEN 1 ELSE 0 END AS epochs FROM placed)
SELECT doc_id, domain, lang, source, epoch::INTEGER AS epoch, n_tokens, budget::BIGINT AS budget
FROM taken, unnest(range(0, epochs::BIGINT)) AS e(epoch) WHERE epochs > 0
"""
