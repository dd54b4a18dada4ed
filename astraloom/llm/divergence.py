"""How far the sources of a language differ in their words, in exact integer arithmetic.

Texts become posting rows (lang, source, term, n) with map-side sums of a batch's tokens. Everything else follows from the postings:

- Pairs of sources. f of two terms that both have is the only part that needs the terms themselves. With p0 the probability of a
  count of zero, the sum over all V terms is
  sum over a's terms of f(p_a, p0_b) + the same of b + (V - |a| - |b|) f(p0_a, p0_b)
  + sum over common terms of f(p_a, p_b) - f(p_a, p0_b) - f(p0_a, p_b) + f(p0_a, p0_b).
  The first two depend on counts alone, so they are summed over a group's count buckets; the last is accumulated term by term over
  the posting lists, in tiles of sources: a task holds one tile of numbers, and no pair is written per term.
- Top terms. p depends on a term's count in the group, f falls in the language's q up to p. So a group's terms with one count are
  a bucket whose least q bounds f, and is reached. Buckets are taken best first until they hold k terms; what is unseen is looked at
  only where its bound is not strictly below the k-th value found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from astraloom.llm.common import release, written

#: Fixed: the scale of probabilities.
SCALE = 1_000_000_000
#: Sources of one side of a tile; a tile holds TILE * TILE numbers.
TILE = 256
#: Bytes of text whose tokens are summed at once.
BATCH = 6 << 20
#: Lower-cases A-Z; all bytes that no term holds become spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _tokens(texts: pa.Array) -> pa.ListArray:
    """The terms of every text. Folding keeps the length of UTF-8, so the offsets stay."""
    texts = texts if texts.offset == 0 else pa.concat_arrays([texts])
    _, offsets, data = texts.buffers()
    folded = pa.Array.from_buffers(texts.type, len(texts), [None, offsets, pa.py_buffer((data.to_pybytes() if data else b"").translate(_FOLD))])
    return pc.ascii_split_whitespace(folded)


def _sums(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    """(lang, source, term, n, docs) of a batch of (lang, source, text): occurrences, and rows with the term."""
    lists = _tokens(pc.fill_null(batch.column("text"), ""))
    doc, flat = np.asarray(pc.list_parent_indices(lists), np.int64), pc.list_flatten(lists)
    full = np.asarray(pc.binary_length(flat)) > 0  # splitting leaves empty terms at the ends
    doc, flat = doc[full], flat.filter(pa.array(full))
    if not len(flat):
        return None
    coded = flat.dictionary_encode()
    size = len(coded.dictionary)
    groups = pa.StructArray.from_arrays([pc.fill_null(batch.column(c), "") for c in ("lang", "source")], ["lang", "source"])
    known: dict[tuple, int] = {}
    group = np.array([known.setdefault((g["lang"], g["source"]), len(known)) for g in groups.to_pylist()], np.int64)
    cells, tf = np.unique(doc * size + np.asarray(coded.indices, np.int64), return_counts=True)  # (document, term)
    key = group[cells // size] * size + cells % size  # (group, term)
    order = np.argsort(key, kind="stable")
    key, tf = key[order], tf[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    names = list(known)
    owner = pa.array((key[first] // size).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([a for a, _ in names], pa.string()).take(owner), pa.array([b for _, b in names], pa.string()).take(owner), coded.dictionary.take(pa.array(key[first] % size)),
            pa.array(np.add.reduceat(tf, first)), pa.array(np.diff(np.r_[first, len(key)])),
        ],
        ["lang", "source", "term", "n", "docs"],
    )


def _count(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The sums of about `most` bytes of text at a time."""
    kept: list[pa.RecordBatch] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if kept:
            table = pa.Table.from_batches(kept).combine_chunks()
            kept.clear()
            found = _sums(table.to_batches()[0])
            if found is not None:
                yield found

    for batch in batches:
        step = max(1, int(batch.num_rows * min(1.0, most / max(1, batch.nbytes))))
        for at in range(0, batch.num_rows, step):
            kept.append(batch.slice(at, step))
            if sum(b.nbytes for b in kept) >= most:
                yield from flush()
    yield from flush()


def postings(docs: DataFrame, least_docs: int = 10) -> DataFrame:
    """(lang, source, term, n, lang_n, first) of the terms in at least least_docs rows of the language; first marks one row per language and term."""
    most = BATCH
    sums = docs.select("lang", "source", "text").mapInArrow(lambda batches: _count(batches, most), "lang string, source string, term string, n long, docs long")
    each = sums.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")  # a row per source at most
    return each.select(
        "lang", "source", "term", "n", F.sum("n").over(term).alias("lang_n"), F.sum("docs").over(term).alias("lang_docs"), (F.row_number().over(term.orderBy("source")) == 1).alias("first")
    ).filter(F.col("lang_docs") >= least_docs).drop("lang_docs")


def _wide(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)); null if there are no terms."""
    whole = total + terms * 2
    short = F.call_function("div", (count + 2) * F.lit(SCALE), whole)  # within a long up to some 9 * 10^9 occurrences
    return F.when(whole > 0, F.when(count < SCALE, short).otherwise(F.call_function("div", _wide(count + 2) * F.lit(SCALE), _wide(whole))) + 1)


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); at most 10^18 before the division."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def groups(docs: DataFrame, posts: DataFrame) -> DataFrame:
    """Every occurring (lang, source): total, distinct (kept terms it has), lang_total, terms (V), p0, number (of the source in the language, from 0)."""
    every = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    own = posts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct"), F.sum(F.col("first").cast("long")).alias("firsts"))
    lang = own.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("firsts").alias("terms"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    found = every.join(own, ["lang", "source"], "left").join(lang, "lang", "left").select("lang", "source", *map(zero, ("total", "distinct", "lang_total", "terms")))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1  # a row per source
    return found.withColumn("p0", probability(F.lit(0), F.col("total"), F.col("terms"))).withColumn("number", number)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def _common(batches: Iterator[pa.RecordBatch], side: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of (lang, row, col, term): what common terms add for every two sources of a tile of a language; side: sources of a tile's side."""
    now: tuple | None = None
    tile = np.zeros((side, side), np.int64)
    left: pa.Table | None = None

    def done() -> Iterator[pa.RecordBatch]:
        a, b = np.nonzero(tile)
        if now is not None and len(a):
            yield pa.RecordBatch.from_arrays([pa.array([now[0]] * len(a), pa.string()), pa.array((a + now[1] * side).astype(np.int32)), pa.array((b + now[2] * side).astype(np.int32)), pa.array(tile[a, b])], ["lang", "a", "b", "value"])

    def add(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        nonlocal now
        tiles = list(zip(*(rows[c].to_pylist() for c in ("lang", "row", "col"))))
        term = rows["term"].to_pylist()
        number, p, p0 = (rows[c].to_numpy() for c in ("number", "p", "p0"))
        start = 0
        while start < len(tiles):
            end, of, at = start, [], -1
            while end < len(tiles) and tiles[end] == tiles[start]:
                at += end == start or term[end] != term[end - 1]
                of.append(at)
                end += 1
            if tiles[start] != now:
                yield from done()
                now = tiles[start]
                tile[:] = 0
            gather(np.array(of), number[start:end], p[start:end], p0[start:end])
            start = end

    def gather(of: np.ndarray, n: np.ndarray, x: np.ndarray, x0: np.ndarray) -> None:
        """Adds the terms `of` (from 0, in order) with their sources' numbers and probabilities to the tile."""
        _, row, col = now
        known, first, place = np.unique(n, return_index=True, return_inverse=True)
        zero = x0[first]
        terms = of[-1] + 1
        if 8 * len(n) >= terms * len(known):  # most sources have most terms: a table of them, where an absent one adds nothing
            table = np.broadcast_to(zero, (terms, len(known))).copy()
            table[of, place] = x
            parts = [(table, known, zero)]
        else:
            starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True])
            parts = [(x[None, a:b], n[a:b], x0[a:b]) for a, b in zip(starts, starts[1:])]
        for table, who, zero in parts:
            down, across = np.flatnonzero(who // side == row), np.flatnonzero(who // side == col)
            b, j = table[:, across], zero[across]
            for k in down.tolist():
                a, i = table[:, k : k + 1], zero[k]
                value = _f(a, b).sum(axis=0) - _f(a, j).sum(axis=0) - _f(i, b).sum(axis=0) + len(table) * _f(i, j)
                later = who[across] > who[k]
                tile[who[k] - row * side, who[across][later] - col * side] += value[later]

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if left is None else pa.concat_tables([left, rows])
        last = tuple(rows[c][-1].as_py() for c in ("lang", "row", "col", "term"))
        whole = rows.num_rows
        while whole and tuple(rows[c][whole - 1].as_py() for c in ("lang", "row", "col", "term")) == last:
            whole -= 1
        left = rows.slice(whole)  # the term may go on; its rows are one per source of two blocks at most
        if whole:
            yield from add(rows.slice(0, whole))
    if left is not None and left.num_rows:
        yield from add(left)
    yield from done()


def common_terms(posts: DataFrame, known: DataFrame) -> DataFrame:
    """(lang, a, b, value) by numbers of sources, a < b: what the terms add that both have. A source goes to every tile of its row and column."""
    side = TILE
    blocks = known.groupBy("lang").agg(F.max(F.floor(F.col("number") / side)).alias("most"))
    own = posts.join(known.join(blocks, "lang").select("lang", "source", "number", "p0", "total", "terms", "most"), ["lang", "source"])
    block = F.floor(F.col("number") / side)
    dealt = own.select("lang", "term", "number", probability(F.col("n"), F.col("total"), F.col("terms")).alias("p"), "p0", block.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), "most")).alias("other"))
    rows = dealt.select("lang", F.least("block", "other").cast("int").alias("row"), F.greatest("block", "other").cast("int").alias("col"), "term", "number", "p", "p0")
    sums = rows.repartition("lang", "row", "col", "term").sortWithinPartitions("lang", "row", "col", "term", "number").mapInArrow(lambda batches: _common(batches, side), "lang string, a int, b int, value long")
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def pairs(posts: DataFrame, known: DataFrame) -> DataFrame:
    """(lang, source, item, value): for every two sources of a language the sum of f over its kept terms."""
    me = known.select("lang", "source", "number", "distinct", "p0", "total", "terms")
    other = me.select("lang", *(F.col(c).alias(f"o_{c}") for c in ("source", "number", "distinct", "p0")))
    two = me.join(other, "lang").filter("number <> o_number")  # the result has a row for each
    buckets = posts.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("m"))
    one_side = two.join(buckets, ["lang", "source"]).select(
        "lang", "number", "o_number", (distance(probability(F.col("n"), F.col("total"), F.col("terms")), F.col("o_p0")) * F.col("m")).alias("value")
    ).groupBy("lang", "number", "o_number").agg(F.sum("value").alias("value"))
    flat = two.select("lang", "number", "o_number", F.when(F.col("terms") > 0, (F.col("terms") - F.col("distinct") - F.col("o_distinct")) * distance(F.col("p0"), F.col("o_p0"))).otherwise(0).alias("value"))
    both = common_terms(posts, known)
    turned = lambda df, a, b: df.select("lang", F.col(a).alias("number"), F.col(b).alias("o_number"), "value")
    parts = [flat, one_side, turned(one_side, "o_number", "number"), turned(both, "a", "b"), turned(both, "b", "a")]
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    summed = total.groupBy("lang", "number", "o_number").agg(F.sum("value").cast("long").alias("value"))
    names = known.select("lang", "number", "source")
    named = summed.join(names, ["lang", "number"]).join(names.select("lang", F.col("number").alias("o_number"), F.col("source").alias("item")), ["lang", "o_number"])
    return named.select("lang", "source", "item", "value")


def top_terms(posts: DataFrame, known: DataFrame, k: int = 10) -> DataFrame:
    """(lang, source, item, value): each group's k terms of greatest f among those with p > q, ties to the lesser term."""
    stats = known.select("lang", "source", "total", "lang_total", "terms")
    live = posts.join(stats, ["lang", "source"]).select(
        "lang", "source", "term", "n", probability(F.col("n"), F.col("total"), F.col("terms")).alias("p"), probability(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q")
    ).filter("p > q")
    bucket = live.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("m"), F.first("p").alias("p"), F.min("q").alias("least"))
    group = Window.partitionBy("lang", "source")  # a row per count that occurs
    best = group.orderBy(F.col("bound").desc()).rangeBetween(Window.unboundedPreceding, -1)
    bounds = written(bucket.select("lang", "source", "n", "m", distance(F.col("p"), F.col("least")).alias("bound")).withColumn("before", F.coalesce(F.sum("m").over(best), F.lit(0))), "bounds")

    def evaluated(buckets: DataFrame) -> DataFrame:
        """The k best of the given buckets' terms."""
        rows = live.join(buckets.select("lang", "source", "n"), ["lang", "source", "n"]).select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
        return rows.withColumn("r", F.row_number().over(group.orderBy(F.col("value").desc(), "item"))).filter(F.col("r") <= k).drop("r")

    seen = written(evaluated(bounds.filter(F.col("before") < k)), "seen")
    kth = seen.groupBy("lang", "source").agg(F.when(F.count(F.lit(1)) == k, F.min("value")).otherwise(-1).alias("kth"))
    rest = evaluated(bounds.filter(F.col("before") >= k).join(kth, ["lang", "source"]).filter("bound >= kth"))
    return seen.unionByName(rest).withColumn("r", F.row_number().over(group.orderBy(F.col("value").desc(), "item"))).filter(F.col("r") <= k).drop("r")


def audit(docs: DataFrame, least_docs: int = 10, k: int = 10) -> DataFrame:
    """docs (lang, source, text): lang, source, part, item, value, rank.

    part `pair`: every other source of the language; part `term`: the group's k most characteristic terms. Null lang, source and text
    are ''. Every row is a document, those that repeat an id too. Groups without kept terms have pairs (value 0 where the language
    keeps none) and no terms. A text of any length is summed in one task's batch. An empty table gives none; other columns are not used.
    """
    posts = written(postings(docs, least_docs), "postings")
    known = written(groups(docs, posts), "groups")
    found = written(
        pairs(posts, known).select("lang", "source", F.lit("pair").alias("part"), "item", "value").unionByName(top_terms(posts, known, k).select("lang", "source", F.lit("term").alias("part"), "item", "value")), "audit"
    )
    release(posts)
    release(known)
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    return found.withColumn("rank", rank.cast("int"))


def oracle() -> str:
    return r"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), sides AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), kept AS (
  SELECT lang, term, count(*) AS c FROM words GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 10
), langs AS (SELECT lang, sum(c)::HUGEINT AS n, count(*)::HUGEINT AS v FROM kept GROUP BY lang
), own AS (
  SELECT w.lang, w.source, w.term, count(*) AS c FROM words w JOIN kept k USING (lang, term) GROUP BY ALL
), totals AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM own GROUP BY ALL
), dense AS (
  SELECT s.lang, s.source, k.term, coalesce(o.c, 0) AS c, (1 + (1000000000::HUGEINT * (coalesce(o.c, 0) + 2)) // (coalesce(t.n, 0) + 2 * l.v))::BIGINT AS p,
    (1 + (1000000000::HUGEINT * (k.c + 2)) // (l.n + 2 * l.v))::BIGINT AS q
  FROM sides s JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN totals t ON t.lang = s.lang AND t.source = s.source
  LEFT JOIN own o ON o.lang = s.lang AND o.source = s.source AND o.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM sides a JOIN sides b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM dense WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found
) WHERE part = 'pair' OR rank <= 10"""
