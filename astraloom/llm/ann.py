"""Approximate nearest neighbours by multi-index hashing.

Codes. Vectors are centred and rotated; signs of the rotated coordinates are bits. Rotations are learned on a bounded
sample by alternating between codes and the orthogonal map that best fits them (iterative quantisation); several
rotations from different seeds make one long code.

Index and search. A code is split into substrings of 16 bits. Every row is posted once per substring, under the
substring's leading bits, and a query goes to every leading value that differs from its own in at most `depth` bits;
the task of a leading value lists its postings by the rest of the substring and looks up the ball that is left of the
depth. By the pigeonhole principle this finds every code within m * (depth + 1) - 1 bits of m substrings, and some of
those beyond. A pair that meets in several substrings counts in the first. What is found is checked on whole codes, to
the `reach`, and reranked on the original vectors in double precision; a task hands on k rows a query at most.

Depth and reach are fitted on true neighbours: those of a bounded set of probe vectors among all rows, found in
one pass. The depth is the least that finds `within` of them, the reach holds `checked` of what is found. Queries for
which the index finds fewer than k rows are compared with every row instead, in blocks.

The postings of a leading value are dealt to parts of `block` rows at most by a hash of the id, and queries to parts
of `chunk`, so copies of one vector spread evenly and no task grows with them.

Vectors that are null or zero or hold null or non-finite components take no part, nor do rows without an id. Vectors
of different lengths are no candidates for each other: the most frequent length is indexed, the others are compared
with all rows of their length, in blocks. Rows that repeat an id count once, at their nearest, and never for their own
id; a query that repeats an id with other vectors gets the nearest over all of them. Ties go to the smaller id. Empty
tables and tables without queries give no rows. Other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from astraloom.llm.common import written

FOUND = "query_id long, vec_id long, score double"


@dataclass(frozen=True)
class Settings:
    k: int = 10
    sample: int = 4096  # rows to learn from
    probes: int = 256  # vectors whose true neighbours fit depth and reach
    rotations: int = 7  # each gives as many bits as the vectors have dimensions
    rounds: int = 20
    within: float = 0.94  # of the probes' true neighbours, found by the index
    checked: float = 0.985  # of those found, within the reach
    block: int = 8192  # rows of a part
    chunk: int = 4096  # queries of a part
    seed: int = 3


WIDTH = 16
_LOW = np.bitwise_count(np.arange(1 << WIDTH, dtype=np.uint16)).astype(np.int64)


@dataclass
class Model:
    mean: np.ndarray
    maps: np.ndarray  # (dimensions, bits)
    settings: Settings
    depth: int = 0
    reach: int = 0

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(n, substrings) of 16-bit numbers."""
        bits = np.packbits((x - self.mean) @ self.maps > 0, axis=1, bitorder="little")
        if bits.shape[1] % 2:
            bits = np.pad(bits, ((0, 0), (0, 1)))
        return np.ascontiguousarray(bits).view("<u2")


def learn(x: np.ndarray, settings: Settings = Settings()) -> Model:
    """x: the sample, one vector a row."""
    x = np.unique(x, axis=0)
    mean = x.mean(axis=0)
    c = x - mean
    rng = np.random.default_rng(settings.seed)
    maps = []
    for _ in range(settings.rotations):
        r = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))[0]
        for _ in range(settings.rounds):
            u, _, v = np.linalg.svd(np.where(c @ r > 0, 1.0, -1.0).T @ c)
            r = (u @ v).T
        maps.append(r)
    return Model(mean, np.concatenate(maps, axis=1), settings)


def fit(model: Model, pairs: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Sets depth and reach from (vector, its true neighbours)."""
    apart = [np.bitwise_count(model.codes(near) ^ model.codes(one[None])).astype(np.int64) for one, near in pairs if len(near)]
    model.depth, model.reach = WIDTH, model.maps.shape[1]
    if apart:
        every = np.concatenate(apart)
        model.depth = int(np.quantile(every.min(axis=1), model.settings.within, method="higher"))
        found = every[every.min(axis=1) <= model.depth].sum(axis=1)
        model.reach = int(np.quantile(found, model.settings.checked, method="higher")) + 1


def nearest(ids: np.ndarray, x: np.ndarray, own: int, q: np.ndarray, k: int) -> list[tuple[int, float]]:
    """The k nearest rows of other ids: by distance, then id; an id once."""
    distance = np.sqrt(((x - q) ** 2).sum(axis=1))
    order = np.lexsort((ids, distance))
    got: dict[int, float] = {}
    for r in order:
        if ids[r] != own:
            got.setdefault(int(ids[r]), float(distance[r]))
            if len(got) == k:
                break
    return list(got.items())


def _vectors(column, size: int) -> np.ndarray:
    """Doubles from the bytes of vectors of `size` components, floats or doubles."""
    return np.stack([np.frombuffer(x, np.float32 if len(x) == 4 * size else np.float64) for x in column]).astype(np.float64)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vector (its components as bytes, floats where the table has floats) and size of the rows that take part."""
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = np.float32 if element == "float" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i is not None and v and None not in v:
                    x = np.array(v, kind)
                    if np.isfinite(x).all() and x.any():
                        rows.append((i, x.tobytes(), len(x)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, (pa.int64(), pa.binary(), pa.int32()), strict=True)], names=["vec_id", "vector", "size"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>" if element == "float" else "array<double>")).mapInArrow(run, "vec_id long, vector binary, size int")


def compared(rows: DataFrame, asked: DataFrame, settings: Settings) -> DataFrame:
    """Every one of `asked` against every one of `rows` of its size, in blocks: FOUND, at most k rows a query and block."""
    asked = _renewed(asked)
    count = rows.groupBy("size").agg(F.count(F.lit(1)).alias("n")).join(asked.groupBy("size").agg(F.count(F.lit(1)).alias("q")), "size")
    plan = count.select("size", F.ceil(F.col("n") / settings.block).alias("blocks"), F.ceil(F.col("q") / settings.chunk).alias("chunks"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    mine = rows.join(plan, "size").select("size", F.pmod(F.xxhash64("vec_id", "vector"), F.col("blocks")).alias("block"), upto("chunks").alias("chunk"), "vec_id", "vector")
    theirs = asked.join(plan, "size").select("size", upto("blocks").alias("block"), F.pmod(F.xxhash64("vec_id", "vector", F.lit(7)), F.col("chunks")).alias("chunk"), "vec_id", "vector")

    def meet(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            ids, x = left["vec_id"].to_numpy(), _vectors(left["vector"], int(key[0]))
            for own, q in zip(right["vec_id"].tolist(), _vectors(right["vector"], int(key[0]))):
                found += [(own, i, d) for i, d in nearest(ids, x, own, q, settings.k)]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    keys = ("size", "block", "chunk")
    return mine.groupBy(*keys).cogroup(theirs.groupBy(*keys)).applyInPandas(meet, FOUND)


def _renewed(df: DataFrame) -> DataFrame:
    """df with columns of its own, so that it can meet what it was made of."""
    return df.select(*(F.col(c).alias(c) for c in df.columns))


def best(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def meet_part(model: Model, j: int, lead: int, bits: int, ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray) -> list[tuple[int, int, float]]:
    """One part of a leading value's postings in substring j against the queries that come to it."""
    codes, asked = model.codes(x), model.codes(q)
    rest = WIDTH - bits
    mask = (1 << rest) - 1
    low = codes[:, j].astype(np.int64) & mask
    order = np.argsort(low, kind="stable")
    values, starts = np.unique(low[order], return_index=True)
    stops = np.append(starts[1:], len(order))
    left = model.depth - _LOW[asked[:, j].astype(np.int64) >> rest ^ lead]
    out: list[tuple[int, int, float]] = []
    for i in np.flatnonzero(left >= 0).tolist():
        hit = np.flatnonzero(_LOW[values ^ (int(asked[i, j]) & mask)] <= left[i])  # the directory lists what occurs
        if not len(hit):
            continue
        rows = np.concatenate([order[starts[h] : stops[h]] for h in hit.tolist()])
        apart = np.bitwise_count(codes[rows] ^ asked[i]).astype(np.int64)
        keep = apart.sum(axis=1) <= model.reach
        if j:
            keep &= (apart[:, :j] > model.depth).all(axis=1)  # else an earlier substring has the pair
        rows = rows[keep]
        if len(rows):
            own = int(query_ids[i])
            out += [(own, r, d) for r, d in nearest(ids[rows], x[rows], own, q[i], model.settings.k)]
    return out


def indexed(rows: DataFrame, asked: DataFrame, count: int, model: Model) -> DataFrame:
    """FOUND for the queries `asked` through the index over `rows`; both of one size."""
    spark, s = rows.sparkSession, model.settings
    m = -(-model.maps.shape[1] // WIDTH)
    bits = min(WIDTH, max(2, math.ceil(math.log2(max(1, count / s.block))) + 1))
    held = spark.sparkContext.broadcast(model)  # bounded by dimensions and bits
    size = len(model.mean)
    flips = np.flatnonzero(_LOW[: 1 << bits] <= model.depth)

    def posted(is_query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    batch = whole.slice(at, 512)
                    if not batch.num_rows:
                        continue
                    lead = held.value.codes(_vectors(batch.column(1).to_pylist(), size)).astype(np.int64) >> (WIDTH - bits)  # (rows, m)
                    if is_query:
                        lead = (lead[:, :, None] ^ flips).reshape(len(lead), -1)
                    sub = np.repeat(np.arange(m), lead.shape[1] // m)
                    take = pa.array(np.repeat(np.arange(len(lead)), lead.shape[1]))
                    key = (lead + (sub << bits)[None, :]).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0).take(take), batch.column(1).take(take)], names=["key", "vec_id", "vector"])

        return run

    schema = "key long, vec_id long, vector binary"
    mine = rows.select("vec_id", "vector").mapInArrow(posted(False), schema)
    theirs = _renewed(asked).select("vec_id", "vector").mapInArrow(posted(True), schema)
    # parts per key: at most m * 2 ** bits keys
    sizes = mine.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(theirs.groupBy("key").agg(F.count(F.lit(1)).alias("q")), "key")
    plan = written(sizes.select("key", F.ceil(F.col("n") / s.block).alias("blocks"), F.ceil(F.col("q") / s.chunk).alias("chunks")), "index-parts")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    few = F.broadcast(plan) if m << bits <= 1 << 17 else plan
    mine = mine.join(few, "key").select("key", F.pmod(F.xxhash64("vec_id", "vector"), F.col("blocks")).alias("block"), upto("chunks").alias("chunk"), "vec_id", "vector")
    theirs = theirs.join(few, "key").select("key", upto("blocks").alias("block"), F.pmod(F.xxhash64("vec_id", "vector", F.lit(7)), F.col("chunks")).alias("chunk"), "vec_id", "vector")

    def meet(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            j, lead = divmod(int(key[0]), 1 << bits)
            found = meet_part(held.value, j, lead, bits, left["vec_id"].to_numpy(), _vectors(left["vector"], size), right["vec_id"].to_numpy(), _vectors(right["vector"], size))
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    keys = ("key", "block", "chunk")
    return mine.groupBy(*keys).cogroup(theirs.groupBy(*keys)).applyInPandas(meet, FOUND)


def true_neighbours(rows: DataFrame, probes: list[tuple[int, bytes]], size: int, settings: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """(vector, its k nearest among all rows) of each probe, in one pass: a task hands on k rows a probe at most."""
    held = rows.sparkSession.sparkContext.broadcast(probes)  # bounded by settings.probes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = _vectors([v for _, v in held.value], size)
        kept: list[list[tuple[float, int, bytes]]] = [[] for _ in held.value]
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                ids, raw = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                x = _vectors(raw, size)
                far = (asked**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * asked @ x.T
                for p, (own, _) in enumerate(held.value):
                    some = np.argpartition(far[p], min(len(ids) - 1, settings.k + 1))[: settings.k + 2]
                    kept[p] = sorted(kept[p] + [(float(far[p, r]), ids[r], raw[r]) for r in some.tolist() if ids[r] != own])[: settings.k]
        flat = [(p, d, i, v) for p, own in enumerate(kept) for d, i, v in own]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat) if flat else [[]] * 4, (pa.int32(), pa.float64(), pa.int64(), pa.binary()), strict=True)], names=["probe", "far", "vec_id", "vector"])

    order = Window.partitionBy("probe").orderBy("far", "vec_id")
    found = rows.select("vec_id", "vector").mapInArrow(run, "probe int, far double, vec_id long, vector binary")
    near = found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= settings.k).select("probe", "vector").collect()  # bounded by probes * k
    out: dict[int, list[bytes]] = {}
    for r in near:
        out.setdefault(r["probe"], []).append(r["vector"])
    return [(_vectors([probes[p][1]], size)[0], _vectors(v, size)) for p, v in out.items()]


def neighbours(vectors: DataFrame, is_query, settings: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the k nearest found for each row that is_query (a condition on vec_id) selects."""
    spark = vectors.sparkSession
    rows = written(usable(vectors), "vectors")
    per_size = rows.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q"), F.count_distinct("vec_id").alias("ids"))
    main = per_size.orderBy(F.desc("n"), "size").first()
    if main is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    same, others = rows.filter(F.col("size") == main["size"]), rows.filter(F.col("size") != main["size"])
    found = compared(others, others.filter(is_query), settings)
    if main["q"]:
        by_hash = same.orderBy(F.xxhash64("vec_id", F.lit(settings.seed)), "vec_id", "vector")
        sample = [(r["vec_id"], r["vector"]) for r in by_hash.limit(settings.sample).collect()]  # bounded by settings.sample
        model = learn(_vectors([v for _, v in sample], main["size"]), settings)
        fit(model, true_neighbours(same, sample[: settings.probes], main["size"], settings))
        asked = same.filter(is_query)
        met = written(indexed(same, asked, main["n"], model), "met")
        most = min(settings.k, main["ids"] - 1)
        full = met.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n")).filter(F.col("n") >= most).select(F.col("query_id").alias("vec_id"))
        short = written(asked.join(full, "vec_id", "left_anti"), "short")
        found = found.unionByName(met).unionByName(compared(same, short, settings))
    return best(found, settings.k)
