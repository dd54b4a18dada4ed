"""The trie of conversations' shared beginnings, from the sorted conversations and the array of their common prefixes.

1. Turns are numbered and cut into chunks of `CHUNK` digests, so that no conversation has to fit into a row or a task.
2. Conversations are sorted by their digests: by the first chunk, then by the rank of what follows, found by doubling (ranks of one
   chunk, of two, of four ...), then by id. `v[i]` is the number of turns that conversation i shares with the one before it.
3. The Cartesian tree of v comes from all nearest smaller values, in parallel: a task takes a block of ranks, closes every interval
   whose two smaller neighbours lie within the block, merges equal values, and hands on only what the minima of the block's
   beginnings and ends leave open, with the aggregates of what lies between. `FAN` blocks meet in a task of the next level. What a
   block leaves open are strictly falling and strictly rising values; as each is a number of shared turns, a level's task holds no
   more than some 2 * sqrt(2 * turns) of them.
4. Tree nodes stand for the depths above them up to their parent's, which are spelled out by chunks.

Aggregates (least id, leaves, saved tokens) are folded while intervals close; digests of the conversations that end at a node are made
from strings of up to `STRING` ids, read in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from astraloom.llm.common import release, written

#: Turns of a chunk; bytes of a turn's digest.
CHUNK, WIDTH = 256, 16
#: Ranks of a block, blocks that meet at the next level, ids of a string.
BLOCK, FAN, STRING = 512, 64, 1024
EMPTY = hashlib.sha256(b"").hexdigest()


def _placed(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df sorted over all partitions, as a table with part and at: the partition and the place in it."""
    at = F.monotonically_increasing_id()
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", at)
    return written(rows.withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND((1 << 33) - 1)), name)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with i, the row's number from 0 in the order of all rows."""
    placed = _placed(df, order, name)
    parts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    return placed.join(F.broadcast(parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))), "part").withColumn("i", F.col("at") + F.col("offset")).drop("part", "at", "offset")


def numbered_within(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """df with pos, the row's number from 1 within its key. A key's rows may lie in many partitions."""
    placed = _placed(df, [key, *order], name)
    parts = placed.groupBy(key, "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("low"))
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition of the key
    return placed.join(parts.select(key, "part", (1 - F.col("low") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("offset")), [key, "part"]).withColumn("pos", F.col("at") + F.col("offset")).drop("part", "at", "offset")


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, t, chars) of turns with an id: t is a digest of role and text, chars the text's code points."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    return turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.substring(F.sha2(whole, 256), 1, 2 * WIDTH)).alias("t"), F.char_length(text).cast("long").alias("chars"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as the contract rebuilds them: (c, d, t, chars) with d from 1, and (c) of all, turnless ones too."""
    rows = numbered_within(digests(turns), "conv_id", ["turn", "t"], "turns")
    own = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    h = F.crc32(F.col("conv_id").cast("string")) % 6
    base = F.col("conv_id") - F.col("conv_id") % 100
    lengths = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    plan = written(own.select("conv_id", h.alias("h"), base.alias("base")).join(lengths, "base", "left").select("conv_id", "h", "base", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken")), "plan")
    heads = rows.filter("pos <= 5 AND conv_id % 100 = 0").select(F.col("conv_id").alias("base"), "pos", "t", "chars")  # five rows at most meet 199 ids
    first = plan.join(heads, "base").filter("pos <= taken").select(F.col("conv_id").alias("c"), F.col("pos").alias("d"), "t", "chars")
    rest = rows.join(plan.select("conv_id", "h", "taken"), "conv_id").filter("pos > h").select(F.col("conv_id").alias("c"), (F.col("pos") - F.col("h") + F.col("taken")).alias("d"), "t", "chars")
    return first.unionByName(rest), plan.select(F.col("conv_id").alias("c"))


def chunks(rows: DataFrame) -> DataFrame:
    """(c, j, key, len, starts, total): the digests of up to CHUNK turns, the characters before each of them, and those up to the chunk's end."""
    j = F.floor((F.col("d") - 1) / CHUNK)
    above = Window.partitionBy("c", "j").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)  # CHUNK rows
    start = F.coalesce(F.sum("chars").over(above), F.lit(0))
    grouped = rows.withColumn("j", j).withColumn("start", start).groupBy("c", "j").agg(F.array_sort(F.collect_list(F.struct("d", "t", "start"))).alias("x"), F.sum("chars").alias("own"))
    before = Window.partitionBy("c").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)  # a row per CHUNK turns
    sums = grouped.withColumn("before", F.coalesce(F.sum("own").over(before), F.lit(0)))
    starts = F.transform("x", lambda x: F.col("before") + x["start"])
    key = F.unhex(F.array_join(F.transform("x", lambda x: F.hex(x["t"])), ""))
    return sums.select("c", "j", key.alias("key"), F.size("x").alias("len"), starts.alias("starts"), (F.col("before") + F.col("own")).alias("total"))


def _ranks(values: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct rows of values with r, their number from 1 in order."""
    return numbered(values.select(*columns).distinct(), columns, "ranks").withColumn("r", F.col("i") + 1).drop("i")


def rest_ranks(parts: DataFrame) -> DataFrame:
    """(c, rest): the rank of everything behind a conversation's first chunk, for those that have more than one."""
    more = parts.filter("j > 0").select("c", (F.col("j") - 1).alias("j"), "key")
    now = written(more.join(_ranks(more, ["key"]), "key").select("c", "j", "r"), "rest")
    while (most := now.agg(F.max("j")).first()[0]) is not None and most > 0:
        # both halves of a pair lie in one group of two rows at most; a missing one sorts first
        pair = now.groupBy("c", F.floor(F.col("j") / 2).alias("j")).agg(F.max(F.when(F.col("j") % 2 == 0, F.col("r"))).alias("a"), F.coalesce(F.max(F.when(F.col("j") % 2 == 1, F.col("r"))), F.lit(0)).alias("b"))
        last, now = now, written(pair.join(_ranks(pair, ["a", "b"]), ["a", "b"]).select("c", "j", "r"), "rest")
        release(last)
    return now.select("c", F.col("r").alias("rest"))


def _shared(a: bytes | None, b: bytes | None) -> int:
    """Turns that two chunks begin with alike."""
    if not a or not b:
        return 0
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[: WIDTH * mid] == b[: WIDTH * mid] else (low, mid - 1)
    return low


def prefix_array(ranked: DataFrame, parts: DataFrame) -> DataFrame:
    """(i, c, len, total, v, cum): v turns are shared with conversation i - 1, with cum characters; v of the first is 0."""
    rows = parts.join(ranked.select("c", "i"), "c")
    before = rows.select((F.col("i") + 1).alias("i"), "j", F.col("key").alias("last"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, last, starts, total, size = (batch.column(c).to_pylist() for c in ("key", "last", "starts", "total", "len"))
            alike = [_shared(a, b) for a, b in zip(keys, last)]
            cum = [t if k == n else s[k] for k, n, s, t in zip(alike, size, starts, total)]
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("j"), batch.column("len"), pa.array(alike, pa.int64()), pa.array(cum, pa.int64()), batch.column("total")], ["i", "j", "len", "alike", "cum", "total"])

    met = rows.select("i", "j", "key", "len", "starts", "total").join(before, ["i", "j"], "left").select("i", "j", "key", "last", "starts", "total", F.col("len").cast("long").alias("len"))
    found = met.mapInArrow(compare, "i long, j long, len long, alike long, cum long, total long")
    stop = F.when(F.col("alike") < CHUNK, F.struct("j", (F.col("j") * CHUNK + F.col("alike")).alias("v"), "cum"))
    each = found.groupBy("i").agg(F.sum("len").alias("len"), F.max("total").alias("total"), F.min(stop).alias("stop"))
    v, cum = F.coalesce("stop.v", "len"), F.coalesce("stop.cum", "total")  # all chunks are full and alike
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return ranked.select("i", "c").join(each.select("i", "len", "total", v.alias("v"), cum.alias("cum")), "i", "left").select("i", "c", *(zero(F.col(x)).alias(x) for x in ("len", "total", "v", "cum")))


FOUND = "kind string, id long, v long, u long, up long, l long, r long, low long, leaves long, saved long, cum long"


class _Entry:
    """A value of the stack: the positions id to last have it; what lies before last, and behind it up to the next entry, is folded."""

    __slots__ = ("id", "v", "cum", "last", "head", "tail", "known")

    def __init__(self, at: int, v: int, cum: int, own: tuple):
        self.id, self.v, self.cum, self.last, self.head, self.tail = at, v, cum, at, None, own


def _fold(a: tuple | None, b: tuple) -> tuple:
    """(least id, leaves, saved) of two neighbouring stretches of ranks."""
    return b if a is None else (min(a[0], b[0]), a[1] + b[1], a[2] + b[2])


def close(rows: list[tuple], n: int, level: int, whole: bool) -> list[tuple]:
    """rows (i, v, cum, low, leaves, saved, len, total, ahead) in order, at level 0 with the first row behind the block, if any: closed nodes, the
    items that are open at the block's ends, and under which entry a position went that may have had one of its own on the level below."""
    out: list[tuple] = []
    stack: list[_Entry] = []
    if whole or (level == 0 and rows[-1][0] == n - 1):  # nothing is shared with what comes last
        rows = [*rows, (n, -1, 0, 0, 0, 0, 0, 0, True)]
    for k, (i, v, cum, low, leaves, saved, _, _, ahead) in enumerate(rows):
        if level == 0 and k:  # the conversation before this position
            before = rows[k - 1]
            if before[6] > max(before[1], v):  # has turns of its own: a leaf
                top = stack[-1]
                here = v > before[1]
                out.append(("node", None, before[6], max(before[1], v), i if here else top.id, before[0], before[0], before[3], 1, 0, before[7]))
                top.tail = (top.tail[0], 1, 0)
        if ahead and not whole:
            break
        while stack and stack[-1].v > v:
            t = stack.pop()
            if not stack and not ahead:  # open to the left
                out.append(("item", t.id, t.v, None, None, None, None, *_fold(t.head, t.tail), t.cum))
                continue
            s = stack[-1] if stack else None
            own = _fold(t.head, t.tail)
            if s is not None:
                own = _fold(s.tail, own)
            l, own = (s.last if s else 0), (own[0], max(own[1], 1), own[2])
            u, up, ucum = (-1, None, 0) if s is None else (s.v, s.id, s.cum) if s.v >= v else (v, i, cum)
            out.append(("node", t.id, t.v, u, up, l, i - 1, own[0], own[1], own[2], t.cum))
            if s is not None:
                s.tail = (own[0], own[1], own[2] + (i - 1 - l) * (t.cum - ucum))
        if ahead:
            break
        if stack and stack[-1].v == v:
            t = stack[-1]
            t.head, t.tail, t.last = _fold(t.head, t.tail), (low, leaves, saved), i
            if level:
                out.append(("same", i, None, None, t.id, None, None, None, None, None, None))
        else:
            stack.append(_Entry(i, v, cum, (low, leaves, saved)))
    if not whole:
        for t in stack:
            if t.head is not None:
                out.append(("item", t.id, t.v, None, None, None, None, *t.head, t.cum))
            out.append(("item", t.last, t.v, None, None, None, None, *t.tail, t.cum))
    return out


def _closing(n: int, level: int, whole: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(block: pd.DataFrame) -> pd.DataFrame:
        rows = block.sort_values(["i", "ahead"])
        columns = (rows[c].tolist() for c in ("i", "v", "cum", "low", "leaves", "saved", "len", "total", "ahead"))
        out = pd.DataFrame(close(list(zip(*columns)), n, level, whole), columns=[c.split()[0] for c in FOUND.split(", ")])
        return out.astype({c: "Int64" for c in out.columns if c != "kind"})

    return run


def tree(array: DataFrame, n: int) -> DataFrame:
    """(id, v, u, up, l, r, low, leaves, saved, cum): the nodes of the Cartesian tree and its leaves. A node spans ranks l to r and the
    depths u + 1 to v; up is its parent's id (leaves have none of their own); saved counts what lies below depth v."""
    size, level = BLOCK, 0
    whole = n <= size
    items = array.select("i", "v", "cum", F.col("c").alias("low"), F.lit(0).alias("leaves"), F.lit(0).alias("saved"), "len", "total", F.lit(False).alias("ahead"), F.floor(F.col("i") / size).alias("block"))
    if not whole:  # the leaf at a block's end needs the value behind it
        ahead = items.filter((F.col("i") % size == 0) & (F.col("i") > 0)).withColumn("block", F.col("block") - 1).withColumn("ahead", F.lit(True))
        items = items.unionByName(ahead)
    found: list[DataFrame] = []
    while True:
        level_rows = written(items.groupBy("block").applyInPandas(_closing(n, level, whole), FOUND), "intervals")
        found.append(level_rows)
        if whole:
            break
        size, level = size * FAN, level + 1
        whole = n <= size
        items = level_rows.filter("kind = 'item'").select(F.col("id").alias("i"), "v", "cum", "low", "leaves", "saved", F.lit(0).alias("len"), F.lit(0).alias("total"), F.lit(False).alias("ahead"), F.floor(F.col("id") / size).alias("block"))
    nodes = found[0].filter("kind = 'node'").drop("kind")
    for k in range(1, len(found)):
        # an entry that was open on the levels below may have gone under an earlier one
        moved = found[k].filter("kind = 'same'").select(F.col("id").alias("up"), F.col("up").alias("to"))
        nodes = nodes.join(moved, "up", "left").withColumn("up", F.coalesce("to", "up")).drop("to")
        nodes = nodes.unionByName(found[k].filter("kind = 'node'").drop("kind"))
    return nodes


def ends(ranked: DataFrame) -> DataFrame:
    """(l, d, ends): the digest of the ids of the conversations that are wholly alike, by the first one's rank and their turns."""
    strings = ranked.groupBy("alike", F.floor(F.col("i") / STRING).alias("block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda x: x["c"].cast("string")), ",").alias("ids"), F.min("i").alias("i"), F.first("len").alias("d")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = digest = None
        l = d = 0
        for batch in batches:
            out: list[tuple] = []
            for alike, ids, i, size in zip(*(batch.column(c).to_pylist() for c in ("alike", "ids", "i", "d"))):
                if alike == now:
                    digest.update(b"," + ids.encode())
                    continue
                if now is not None:
                    out.append((l, d, digest.hexdigest()))
                now, l, d, digest = alike, i, size, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["l", "d", "ends"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([l]), pa.array([d]), pa.array([digest.hexdigest()])], ["l", "d", "ends"])

    return strings.repartition("alike").sortWithinPartitions("alike", "block").mapInArrow(run, "l long, d long, ends string")


def prefix_trie(turns: DataFrame, rebuild=rebuilt) -> DataFrame:
    """turns (conv_id, turn, role, text): a row per trie node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn, null first, and turns of one number by their digest; repeated rows are turns of their own. A null role or
    text is empty; rows without conv_id are left out. Conversations may have any number of turns, and any number of them may be alike.
    An empty table has no nodes, not even a root. Other columns are not used.
    """
    rows, every = rebuild(turns)
    parts = written(chunks(rows), "chunks")
    lens = parts.groupBy("c").agg(F.sum("len").alias("len"))
    keyed = every.join(parts.filter("j = 0").select("c", "key"), "c", "left").join(rest_ranks(parts), "c", "left").join(lens, "c", "left")
    sortable = keyed.select("c", F.coalesce("key", F.unhex(F.lit(""))).alias("key"), F.coalesce("rest", F.lit(0)).alias("rest"), F.coalesce("len", F.lit(0)).cast("long").alias("len"))
    alike = F.unhex(F.substring(F.sha2(F.concat("key", F.lit(" ").cast("binary"), F.col("rest").cast("string").cast("binary")), 256), 1, 2 * WIDTH))
    ranked = written(numbered(sortable, ["key", "rest", "c"], "ranked").select("i", "c", "len", alike.alias("alike")), "ranked")
    n = ranked.count()
    nodes = written(tree(prefix_array(ranked, parts), n), "nodes") if n else None
    if nodes is None:
        return turns.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    below = nodes.filter("up IS NOT NULL").groupBy("up").agg(F.count(F.lit(1)).alias("children"))
    inner = nodes.filter("id IS NOT NULL").select(F.col("id").alias("up"), F.col("low").alias("up_low"))
    full = nodes.join(below.withColumnRenamed("up", "id"), "id", "left").join(inner, "up", "left")
    # the depths of a node lie in the chunks of its first conversation
    spelled = full.filter("v > 0").withColumn("j", F.explode(F.sequence(F.floor(F.greatest("u", F.lit(0)) / CHUNK), F.floor((F.col("v") - 1) / CHUNK))))
    texts = parts.select("c", "j", "starts").join(ranked.select("c", F.col("i").alias("l")), "c").drop("c")
    low, high = F.greatest(F.col("u"), F.col("j") * CHUNK), F.least(F.col("v"), (F.col("j") + 1) * CHUNK)
    size = (high - low).cast("int")
    deep = spelled.join(texts, ["l", "j"]).withColumn("low_d", low).select("*", F.posexplode(F.slice("starts", (low - F.col("j") * CHUNK + 1).cast("int"), size)).alias("k", "start"))
    n_convs = F.col("r") - F.col("l") + 1
    inside = deep.withColumn("depth", F.col("low_d") + F.col("k") + 1).select(
        "l", F.col("low").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("u") + 1, F.col("up_low")).otherwise(F.col("low")).alias("parent_conv_id"), n_convs.alias("n_convs"),
        F.when(F.col("depth") < F.col("v"), F.lit(1)).otherwise(F.coalesce("children", F.lit(0))).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("saved") + (n_convs - 1) * (F.col("cum") - F.col("start"))).alias("saved_tokens"),
    )
    root = full.filter("v = 0").select(
        "l", F.col("low").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), n_convs.alias("n_convs"),
        F.coalesce("children", F.lit(0)).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
    )
    last = ends(ranked).withColumnRenamed("d", "depth")
    return inside.unionByName(root).join(last, ["l", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(EMPTY))).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


def oracle() -> str:
    # crc32 bit by bit: eight steps a byte, from the last byte's remainder
    step = "list_reduce([x::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, CASE WHEN a % 2 = 1 THEN 3988292384 ELSE 0 END))"
    return f"""
WITH turns AS (
  SELECT conv_id, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list(t ORDER BY pos) AS ts FROM turns GROUP BY conv_id
), hashed AS (
  SELECT conv_id, ts, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda s, c: {step.replace("x::BIGINT", "xor(s, c)")}), 4294967295) % 6 AS h
  FROM own
), whole AS (
  SELECT o.conv_id AS c, list_concat(list_slice(coalesce(b.ts, []), 1, o.h), list_slice(o.ts, o.h + 1, len(o.ts))) AS ts
  FROM hashed o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100
), prefixes AS (
  SELECT c, u.d, list_slice(ts, 1, u.d) AS p, len(ts) AS n FROM whole, unnest(range(0, len(ts) + 1)) AS u(d)
), nodes AS (
  SELECT d, p, min(c) AS c, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends, list_slice(p, 1, d - 1) AS up FROM prefixes GROUP BY d, p
), children AS (SELECT up, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL
), sums AS (
  SELECT a.d, a.p, count(*) FILTER (WHERE k.n IS NULL) AS n_leaves, sum(CASE WHEN b.d = 0 THEN 0 ELSE (b.n_convs - 1) * length(b.p[b.d].text) END) AS saved
  FROM nodes a JOIN nodes b ON b.d >= a.d AND list_slice(b.p, 1, a.d) = a.p LEFT JOIN children k ON k.up = b.p AND k.d = b.d GROUP BY ALL
)
SELECT x.c AS conv_id, x.d AS depth, u.c AS parent_conv_id, x.n_convs, coalesce(k.n, 0) AS n_children, s.n_leaves, s.saved::BIGINT AS saved_tokens, x.ends AS ends_sha256
FROM nodes x JOIN sums s ON s.d = x.d AND s.p = x.p LEFT JOIN nodes u ON u.d = x.d - 1 AND u.p = x.up LEFT JOIN children k ON k.up = x.p AND k.d = x.d"""
