"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints. A text's word shingles are hashed; a bit of the fingerprint is 1 if it is set in over half of the hashes.

Links. Two fingerprints of at most 2h differing bits have a variant in common that differs from either in at most h
bits. So every distinct fingerprint stands for all variants within h bits, variants are shuffled, and what meets on
one is a candidate. To keep the shuffle small the variants of a fingerprint travel together: the shuffle's key is
the leading `k` bits of the variant, and one row per key that the ball touches carries the fingerprint; the task
that owns the key spells the remaining bits out, again in slices of bounded size. k follows from the number of
fingerprints and only deals the work. Texts with one fingerprint are one row throughout, so copies cost nothing.

Candidates are verified on whole fingerprints. With one block over all bits two that meet are within 2h bits by the
triangle inequality. With several blocks of a wider fingerprint two are linked if they agree to 2h bits in some block
and to `radius` bits on the whole; all pairs within `blocks * (2h + 1) - 1` bits do the first. A task hands on a
spanning forest of the links it has found, which keeps every connection; the forests are joined by `components`.

Near-duplicates proper (`near_groups`, the pipeline's stage) are pairs of texts whose sets of 5-word shingles have a
Jaccard similarity of 0.8 or more, and what chains of them reach. Ball hashing of 256-bit fingerprints of the sets,
in eight blocks, gives groups of candidates; within a group whole shingle sets decide, in integers. Texts with one
shingle set are one class. A large group is cut into parts, and every two parts meet in a task of bounded size.

Null, empty and wordless texts have the zero fingerprint and are one class. Very long texts are taken whole. Repeated
rows and ids are rows like others; null ids take no part in a component's least id, and a component of nulls only has a
null id. Empty tables give no rows. Other columns of the input are left out, or kept as they are by `keep_one`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astraloom.llm.common import bounded, map_batches, release, written
from astraloom.llm.components import SALTS, components


@dataclass(frozen=True)
class Scheme:
    """words per shingle; bits of the fingerprint cut into `blocks`; `half` bits per ball in a block; links at `radius` bits or fewer on the whole.

    A block's width bounds the chance meetings: n fingerprints put n * ball / 2 ** width variants on a number, so blocks of
    32 bits suit up to some 1e9 texts and need wider blocks (and then a smaller radius) beyond.
    """

    words: int = 4
    bits: int = 64
    blocks: int = 1
    half: int = 2
    radius: int = 4
    seed: int = 42

    def __post_init__(self):
        if self.bits % 64 or self.bits % (8 * self.blocks) or self.width > 64 or (self.blocks == 1 and self.radius > 2 * self.half):
            raise ValueError("the balls do not cover the radius, or blocks do not divide the fingerprint into bytes")

    @property
    def width(self) -> int:
        return self.bits // self.blocks


#: The query's contract: 4 words, 64 bits, 4 differing bits.
CONTRACT = Scheme()
#: Candidates of 5-word shingle sets. At a Jaccard similarity of 0.8 fingerprints differ in 39 of 256 bits, with a deviation of 6, and a
#: pair meets in one of the eight blocks with probability 0.992; at 0.85 with 0.999.
NEAR = Scheme(words=5, bits=256, blocks=8, half=2, radius=60)
#: Similarity that links, as a fraction.
SIMILAR = (4, 5)


def shingle_texts(text: str | None, k: int) -> Iterator[bytes]:
    """Every shingle of k words, repeats included; a text of fewer words is one shingle, a text without words has none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if len(words) >= k:
        return map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False))
    return iter([b" ".join(words)] if words else [])


def fingerprint(text: str | None, scheme: Scheme = CONTRACT) -> bytes:
    """Big-endian 64-bit fingerprint of the shingles, repeats included; a text without words has only zeros."""
    raw = b"".join(map(xxhash.xxh64_digest, shingle_texts(text, scheme.words), repeat(scheme.seed)))
    return _majority(np.frombuffer(raw, np.uint8).reshape(-1, 8))


def _majority(rows: np.ndarray) -> bytes:
    """rows: (n, bytes). The bits that are set in over half of the rows."""
    ones = np.zeros(rows.shape[1] * 8, np.int64)
    for at in range(0, len(rows), 4096):
        ones += np.unpackbits(rows[at : at + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(rows)).tobytes()


def shingle_set(text: str | None, scheme: Scheme = NEAR) -> np.ndarray:
    """The hashes of the distinct shingles, sorted."""
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingle_texts(text, scheme.words), repeat(scheme.seed)), np.uint64))


def set_fingerprint(sets: np.ndarray, scheme: Scheme = NEAR) -> bytes:
    """Fingerprint of a shingle set: each hash is mixed into as many 64-bit words as the fingerprint has."""
    steps = np.arange(1, scheme.bits // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = sets[:, None] + steps[None, :]
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return _majority((z ^ (z >> np.uint64(31))).astype(">u8").view(np.uint8).reshape(len(sets), scheme.bits // 8))


def fingerprints(docs: DataFrame, scheme: Scheme = CONTRACT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp (binary) of every document."""

    def make():
        def fn(batch: pa.RecordBatch) -> dict:
            return {id_col: batch.column(0), "fp": [fingerprint(t, scheme) for t in batch.column(1).to_pylist()]}

        return fn

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), f"{id_col} {kind}, fp binary", make)


def ball(width: int, half: int) -> int:
    return sum(math.comb(width, i) for i in range(half + 1))


def masks(width: int, half: int) -> np.ndarray:
    """Every mask of at most `half` of `width` bits, by their number."""
    return np.array([sum(1 << i for i in c) for n in range(half + 1) for c in combinations(range(width), n)], np.uint64)


def block_values(raw: np.ndarray, scheme: Scheme, block: int) -> np.ndarray:
    """The block of each fingerprint as a number; raw: (n, bytes)."""
    size = scheme.width // 8
    out = np.zeros(len(raw), np.uint64)
    for i in range(size):
        out = out << np.uint64(8) | raw[:, block * size + i]
    return out


#: About how many variants a key's task spells out, and how many of them at once.
SHARE, SLICE = 16_000_000, 1_000_000


class Forest:
    """Union of found links; the least index is a tree's root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _apart(raw: np.ndarray, a: np.ndarray | int, b: np.ndarray) -> np.ndarray:
    """Differing bits; raw: (n, words of 64 bits)."""
    return np.bitwise_count(raw[a] ^ raw[b]).sum(axis=-1, dtype=np.int64)


#: Up to so many members a bucket's pairs are measured at once.
ALL_PAIRS = 64


def _meet(variants: np.ndarray, owners: np.ndarray, raw: np.ndarray, radius: int, always: bool, forest: Forest) -> None:
    """Links what meets on a variant and is within the radius. Pairs are only looked at here, never handed on."""
    order = np.argsort(variants)
    variants, owners = variants[order], owners[order]
    new = np.append(True, variants[1:] != variants[:-1])
    if new.all():
        return
    heads = np.flatnonzero(new)
    sizes = np.diff(np.append(heads, len(owners)))
    n = len(raw)
    if always:  # a bucket is a clique: its head stands for it
        rest = np.flatnonzero(~new)
        _link_near(np.unique(owners[heads[np.cumsum(new) - 1][rest]].astype(np.int64) * n + owners[rest]), raw, None, forest)
        return
    # pairs at every distance within buckets of a moderate size
    small = (sizes > 1) & (sizes <= ALL_PAIRS)
    left = np.repeat(np.where(small, sizes - 1, 0), sizes)  # how far the bucket reaches behind each row
    left -= np.where(left > 0, np.arange(len(owners)) - np.repeat(heads, sizes), 0)
    step = 1
    rows = np.flatnonzero(left >= 1)
    while len(rows):
        _link_near(np.unique(owners[rows].astype(np.int64) * n + owners[rows + step]), raw, radius, forest)
        step += 1
        rows = rows[left[rows] >= step]
    # in larger ones each member that is reached is compared with those that are not
    seen: set[bytes] = set()
    for k in np.flatnonzero(sizes > ALL_PAIRS).tolist():
        members = np.unique(owners[heads[k] : heads[k] + sizes[k]])
        if members.tobytes() in seen:
            continue
        seen.add(members.tobytes())
        todo: list[int] = []
        while len(members):
            if todo:
                at = todo.pop()
            else:
                at, members = int(members[0]), members[1:]
            hit = _apart(raw, at, members) <= radius
            for j in members[hit].tolist():
                forest.link(at, j)
                todo.append(j)
            members = members[~hit]


def _link_near(codes: np.ndarray, raw: np.ndarray, radius: int | None, forest: Forest) -> None:
    a, b = codes // len(raw), codes % len(raw)
    if radius is not None:
        near = _apart(raw, a, b) <= radius
        a, b = a[near], b[near]
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        forest.link(i, j)


def _spell(low: np.ndarray, members: np.ndarray, budget: np.ndarray, width: int, half: int, raw: np.ndarray, radius: int, always: bool, forest: Forest) -> None:
    """Spells the variants of `low` (numbers of `width` bits) within each one's budget, in slices by their leading bits."""
    if len(members) < 2:
        return
    total = sum(int((budget == r).sum()) * ball(width, r) for r in range(half + 1))
    if total > SLICE and width > 8:
        cut = np.uint64(width - 3)
        lead, tail = low >> cut, low & np.uint64((1 << (width - 3)) - 1)
        for key in range(8):
            left = budget - np.bitwise_count(lead ^ np.uint64(key)).astype(np.int64)
            ok = left >= 0
            _spell(tail[ok], members[ok], left[ok], width - 3, half, raw, radius, always, forest)
        return
    variants, owners = [], []
    for r in range(half + 1):
        own = np.flatnonzero(budget == r)
        if len(own):
            m = masks(width, r)
            variants.append((low[own, None] ^ m[None, :]).ravel())
            owners.append(np.repeat(members[own], len(m)))
    _meet(np.concatenate(variants), np.concatenate(owners), raw, radius, always, forest)


def link_forest(fps: DataFrame, scheme: Scheme, count: int) -> DataFrame:
    """fps: distinct fp. Edges (a, b) whose connections are those of all pairs within the radius."""
    k = min(scheme.width - 8, max(4, math.ceil(math.log2(max(1, count) * ball(scheme.width, scheme.half) / SHARE))))
    size, half, always = scheme.bits // 8, scheme.half, scheme.blocks == 1 and scheme.radius == 2 * scheme.half

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = masks(k, half)
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                col = whole.column(0).slice(at, 4096)
                raw = np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, size)
                for block in range(scheme.blocks):
                    keys = (block_values(raw, scheme, block) >> np.uint64(scheme.width - k))[:, None] ^ flips[None, :]
                    parts = (keys.ravel().astype(np.int64)) * scheme.blocks + block
                    fp = col.take(pa.array(np.repeat(np.arange(len(raw)), len(flips))))
                    yield pa.RecordBatch.from_arrays([pa.array(parts), fp], names=["part", "fp"])

    def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lead, block = divmod(int(key[0]), scheme.blocks)
        fp = sorted(rows["fp"])
        raw = np.frombuffer(b"".join(fp), np.uint8).reshape(-1, size)
        values = block_values(raw, scheme, block)
        rest = scheme.width - k
        budget = half - np.bitwise_count((values >> np.uint64(rest)) ^ np.uint64(lead)).astype(np.int64)
        forest = Forest(len(fp))
        _spell(values & np.uint64((1 << rest) - 1), np.arange(len(fp)), budget, rest, half, raw.view(np.uint64).reshape(len(fp), -1), scheme.radius, always, forest)
        roots = [forest.root(i) for i in range(len(fp))]
        return pd.DataFrame({"a": [fp[r] for i, r in enumerate(roots) if r != i], "b": [fp[i] for i, r in enumerate(roots) if r != i]})

    spark = fps.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min((1 << k) * scheme.blocks, count // 4096))
    dealt = fps.select("fp").mapInArrow(deal, "part long, fp binary").repartition(tasks, "part")
    return dealt.groupBy("part").applyInPandas(meet, "a binary, b binary")


def near_duplicates(docs: DataFrame, scheme: Scheme = CONTRACT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp and component_id of every document: the smallest id that its links reach, itself included."""
    marks = written(fingerprints(docs, scheme, id_col, text_col), "fingerprints")
    classes = written(marks.groupBy("fp").agg(F.min(id_col).alias("least")), "classes")
    return marks.join(_component_ids(classes, "fp", link_forest(classes, scheme, classes.count())), "fp").select(id_col, "fp", "component_id")


def _component_ids(classes: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """classes: key and least (id). key and component_id of each, a written table."""
    roots = components(edges).select(F.col("node").alias(key), "root")
    linked = written(classes.select(key, "least").join(roots, key), "linked")
    # a table of its own: then both sides of the join are plain exchanges, and adaptive execution can split a large component
    least = written(linked.groupBy("root").agg(F.min("least").alias("component_id")), "least-ids")
    of_linked = linked.join(least, "root").select(key, "component_id")
    found = written(classes.join(of_linked, key, "left").select(key, F.coalesce("component_id", "least").alias("component_id")), "component-of")
    release(linked)
    release(least)
    return found


def near_duplicate_query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def class_of(sets: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(sets.tobytes())


def linked_sets(sets: list[np.ndarray], similar: tuple[int, int] = SIMILAR) -> list[int]:
    """Per set a number that it shares with exactly those that links of the similarity reach; sets are not empty.

    A set that is reached is compared with those that are not yet, so near copies cost about their number.
    """
    num, den = similar
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in order], np.int64)
    _, flat = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    starts = np.append(0, np.cumsum(sizes))
    own = [flat[a:b] for a, b in zip(starts, starts[1:])]
    mark = np.zeros(int(flat.max()) + 1, np.int64)
    rest, root = np.arange(len(order)), np.full(len(order), -1)
    while len(rest):
        first, rest = int(rest[0]), rest[1:]
        todo = [first]
        root[first] = first
        while todo and len(rest):
            at = todo.pop()
            # sets of other sizes can't reach the similarity; `rest` stays sorted by size
            lo, hi = np.searchsorted(den * sizes[rest], num * sizes[at]), np.searchsorted(num * sizes[rest], den * sizes[at], "right")
            if lo == hi:
                continue
            some = rest[lo:hi]
            mark[own[at]] = 1
            held = mark[np.concatenate([own[i] for i in some])]
            mark[own[at]] = 0
            both = np.add.reduceat(held, np.append(0, np.cumsum(sizes[some])[:-1]))
            hit = den * both >= num * (sizes[at] + sizes[some] - both)
            root[some[hit]] = first
            todo += some[hit].tolist()
            rest = np.concatenate([rest[:lo], some[~hit], rest[hi:]])
    out = [0] * len(sets)
    for i, r in zip(order, root.tolist(), strict=True):
        out[i] = order[r]
    return out


#: A part of a group of candidates has about so many classes and bytes of text at most; two parts meet in a task.
PART_CLASSES, PART_BYTES = 1000, 16 << 20
#: Rows of a side that is broadcast, after they are counted.
FEW = 200_000


def near_groups(docs: DataFrame, scheme: Scheme = NEAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and component_id of every document: the smallest id that links of the similarity reach, itself included."""
    kind = docs.schema[id_col].dataType.simpleString()
    row = F.xxhash64(id_col, text_col).alias("row")

    def make():
        def fn(batch: pa.RecordBatch) -> dict:
            sets = [shingle_set(t, scheme) for t in batch.column(2).to_pylist()]
            return {
                id_col: batch.column(0), "row": batch.column(1), "class": [class_of(s) for s in sets],
                "fp": [set_fingerprint(s, scheme) if len(s) else None for s in sets], "n": [8 * len(s) for s in sets],
            }

        return fn

    marks = written(map_batches(docs.select(id_col, row, text_col), f"{id_col} {kind}, row long, class binary, fp binary, n long", make), "marks")
    # a class's fingerprint is that of any of its rows; its least row speaks for it
    classes = written(marks.groupBy("class").agg(F.min(id_col).alias("least"), F.min("row").alias("row"), F.min("fp").alias("fp"), F.max("n").alias("n")), "classes")
    fps = written(classes.filter("fp is not null").select("fp").distinct(), "fps")
    roots = components(link_forest(fps, scheme, fps.count()))
    grouped = classes.filter("fp is not null").join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("class", "row", "n", F.coalesce("root", "fp").alias("root"))
    grouped = written(grouped, "grouped")
    # as in components, a large group is dealt over sub-keys, and its totals go back to them
    dealt = grouped.withColumn("salt", F.pmod(F.xxhash64("class"), F.lit(SALTS)))
    some = dealt.groupBy("root", "salt").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("bytes"))
    sizes = some.groupBy("root").agg(F.sum("members").alias("members"), F.sum("bytes").alias("bytes"), F.collect_set("salt").alias("salts")).filter("members > 1")
    parts = F.greatest(F.ceil(F.col("members") / PART_CLASSES), F.ceil(F.col("bytes") / PART_BYTES), F.lit(1)).cast("long")
    back = sizes.select("root", parts.alias("parts"), F.explode("salts").alias("salt"))
    members = written(dealt.join(back, ["root", "salt"]).select("class", "row", "root", "parts"), "members")
    # a class goes to the meetings of its part with every part of its group
    mine = F.pmod(F.xxhash64("class"), F.col("parts"))
    texts = docs.select(row, F.col(text_col).alias("text")).join(bounded(members, FEW), "row")
    once = texts.dropDuplicates(["class", "row"])
    met = once.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    met = met.select("root", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "class", "text")

    def decide(rows: pd.DataFrame) -> pd.DataFrame:
        sets: dict[bytes, np.ndarray] = {}
        for name, text in zip(rows["class"], rows["text"], strict=True):
            if name not in sets and class_of(found := shingle_set(text, scheme)) == name:
                sets[name] = found
        names = sorted(sets)
        heads = linked_sets([sets[x] for x in names]) if names else []
        return pd.DataFrame({"a": [names[r] for i, r in enumerate(heads) if r != i], "b": [names[i] for i, r in enumerate(heads) if r != i]})

    edges = written(met.groupBy("root", "i", "j").applyInPandas(decide, "a binary, b binary"), "links")
    found = _component_ids(classes, "class", edges)
    for done in (classes, fps, grouped, members, edges):
        release(done)
    return marks.join(found, "class").select(id_col, "component_id")


def keep_one(docs: DataFrame, scheme: Scheme = NEAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component the documents with its smallest id stay, with all their columns; null ids and repeated ids stay too.

    Decisions travel as ids: texts only move where those that go are too many to be broadcast.
    """
    marks = near_groups(docs, scheme, id_col, text_col)
    gone = written(marks.filter(F.col(id_col) != F.col("component_id")).select(id_col).distinct(), "gone")
    return docs.join(bounded(gone, 10 * FEW), id_col, "left_anti")
