"""Shared lines, divergence of sources and the trie of conversations against plain versions of what they must return."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from astraloom.llm import divergence, line_dedup, prefix_trie, registry

STRIP = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_prefix_trie", "op13_line_dedup"])
def test_oracles(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = registry.queries()[name](spark, sf)
    want = con.sql(registry.oracle_sql()[name])
    assert got.columns == want.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


# Lines


def plain_lines(docs, least_docs=3, least_chars=20):
    key = lambda line: line.strip(STRIP).translate(LOWER)
    size = lambda i: (i is not None, i or 0)  # noqa: E731  a null id is less than all
    holders = defaultdict(set)
    for i, text in docs:
        for line in (text or "").split("\n"):
            holders[key(line)].add(size(i))
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least_chars or len(holders[key(x)]) < least_docs or max(holders[key(x)]) == size(i)]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=repr)


def check_lines(spark, docs):
    df = spark.createDataFrame([(i, t, "a", 7) for i, t in docs], "doc_id long, text string, h string, places int")
    assert sorted(map(tuple, line_dedup.line_dedup_query(df).collect()), key=repr) == plain_lines(docs)


def test_lines_of_odd_documents(spark):
    line = "This line is long enough, at least"
    docs = [
        (1, None), (2, ""), (3, "\n\n"), (4, f"  {line}\t\r\nown"), (5, line.upper()), (6, f"{line}\n{line}\nown"), (7, "É" * 20), (8, "É" * 20), (9, "é" * 20), (10, "É" * 20), (11, "É" * 19), (12, "É" * 19), (13, "É" * 19),
        (14, f"x\n{line}\n" * 3), (14, f"{line}\nagain"), (None, line), (None, "a line of rows without an id\n"), (15, "a line of rows without an id"), (16, "a line of rows without an id"), (17, "y" * 300_000), (18, "y" * 300_000), (19, "y" * 300_000),
        (20, "x" * 19), (21, "x" * 19), (22, "x" * 19), (23, "\x00" * 25), (24, "\x00" * 25), (25, "\x00" * 25), (26, f"\xa0{line}"), (27, f"{line}\n" * 5000),
    ]
    check_lines(spark, docs)
    check_lines(spark, docs[:1])
    assert line_dedup.line_dedup_query(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_lines_at_random(spark):
    r = random.Random(5)
    lines = [("%s shared line number %d" % (r.choice("aAbB"), k % 40)).ljust(r.choice([15, 20, 30])) for k in range(80)]
    check_lines(spark, [(r.randint(0, 200), "\n".join(r.choice(lines) for _ in range(r.randint(0, 12)))) for _ in range(300)])
    # one line that every document has
    check_lines(spark, [(k, f"a header that all documents have\nown {k}") for k in range(500)])


def test_text_that_stays(spark):
    docs = spark.createDataFrame([(k, "the very same line of text\nrow %d" % k, "z") for k in range(3)], "doc_id string, text string, n_lines string")
    assert sorted(map(tuple, line_dedup.without_shared_lines(docs).collect())) == [("0", "row 0", 2, 1), ("1", "row 1", 2, 1), ("2", "the very same line of text\nrow 2", 2, 0)]
    assert line_dedup.without_shared_lines(docs, least_docs=4).filter("n_dropped > 0").count() == 0


# Divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_audit(rows, least_docs=10, k=10):
    rows = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for lang, source, text in rows]
    docs, own = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in rows:
        docs[lang].update(set(terms))
        own[lang, source].update(terms)
    out, f = [], lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {x[0] for x in rows}:
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        sides = sorted(s for a, s in own if a == lang)

        def chances(count):
            n = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 2) // (n + 2 * len(kept)) for t in kept}

        total = chances(sum((own[lang, s] for s in sides), Counter()))
        p = {s: chances(own[lang, s]) for s in sides}
        for s in sides:
            pair = [(-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sides if o != s]
            term = [(-f(p[s][t], total[t]), t) for t in kept if own[lang, s][t] and p[s][t] > total[t]]
            for part, found in (("pair", sorted(pair, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(term, key=lambda x: (x[0], x[1].encode()))[:k])):
                out += [(lang, s, part, item, -v, rank) for rank, (v, item) in enumerate(found, 1)]
    return sorted(out, key=repr)


def check_audit(spark, rows, least_docs=10):
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "lang string, source string, text string, n int, term int")
    assert sorted(map(tuple, divergence.audit(df, least_docs).collect()), key=repr) == plain_audit(rows, least_docs)


def test_divergence_of_odd_rows(spark):
    rows = [(None, None, None), ("en", None, "a b a"), ("en", "s", "A É é \x00 a-b_c"), ("de", "s", ""), ("de", "t", None), ("fr", "only", "x"), ("en", "s", "A É é \x00 a-b_c"), ("en", "t", "\U0001f600x y" + " w" * 100_000), ("en", "empty", "1 2 3")]
    check_audit(spark, rows, 1)
    check_audit(spark, rows, 2)
    check_audit(spark, rows)
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_divergence_at_random(spark, monkeypatch):
    r = random.Random(11)
    words = ["w" * (1 + k % 3) + chr(97 + k // 3) for k in range(60)] + ["é", "É", "ü"]
    rows = [(r.choice(["en", "de", None]), r.choice(["a", "b", "ä", "hot", "hot", "hot", None]), " ".join(r.choices(words, [1 / (k + 1) for k in range(len(words))], k=r.randint(0, 60)))) for _ in range(300)]
    check_audit(spark, rows, 3)
    monkeypatch.setattr(divergence, "TILE", 2)  # several tiles
    monkeypatch.setattr(divergence, "BATCH", 2000)  # several batches
    check_audit(spark, rows, 3)


def test_ties_of_top_terms_go_to_the_lesser(spark):
    """More terms with one bound than are wanted: all of the bucket is looked at."""
    rows = [("en", "a", " ".join(f"t{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(200)))] * 3 + [("en", "b", "other words")] * 3
    check_audit(spark, rows, 1)


def test_splits_of_terms_by_arrow():
    import pyarrow as pa

    texts = ["", "  ", "a", " Ab, c", "é É", "x\ny\x00z", "123"]
    for array in (pa.array(texts), pa.array(["zz", *texts]).slice(1)):
        assert [[t for t in x if t] for x in divergence._tokens(array).to_pylist()] == [TERM.findall(t.translate(LOWER)) for t in texts]


# Conversations


def plain_rebuilt(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append(((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()), (role, text)))
    own = {c: [t for _, t in sorted(x, key=lambda y: y[0])] for c, x in turns.items()}
    out = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(np.fmod(c, 100)), [])[:h] + x[h:]
    return out


def plain_trie(whole):
    members = defaultdict(list)
    for c, x in whole.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted(
        (
            (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], sha(",".join(str(c) for c in sorted(m) if len(whole[c]) == len(p))))
            for p, m in members.items()
        ),
        key=repr,
    )


def trie_of(spark, rows):
    df = spark.createDataFrame([(*x, "extra", 1) for x in rows], "conv_id long, turn long, role string, text string, depth string, v int")
    return sorted(map(tuple, prefix_trie.prefix_trie(df).collect()), key=repr)


def test_trie_of_odd_rows(spark):
    rows = [
        (0, 0, "user", "hi"), (0, 1, None, None), (0, None, "user", "first"), (1, 0, "user", "hi"), (100, 5, "a", "x"), (100, 5, "a", "x"), (100, 5, "a", "y"), (101, 1, "", ""), (None, 1, "user", "hi"),
        (-5, 0, "user", "hi"), (-5, 1, "user", "hi"), (7, 0, "us", "er1"), (8, 0, "user", "1"), (2**60 + 1, 0, "user", "\U0001f600" * 100_000), (2**60 + 3, 0, "user", "\U0001f600" * 100_000), *((300, k, "u", "long") for k in range(700)),
    ]
    assert trie_of(spark, rows) == plain_trie(plain_rebuilt(rows))
    assert trie_of(spark, rows[:1]) == plain_trie(plain_rebuilt(rows[:1]))
    assert trie_of(spark, []) == []


def random_conversations(seed, n):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        c = r.choice([r.randint(0, 250), r.randint(0, 60_000)])
        rows += [(c, k, "u", r.choice(["a", "a", "a", "bb", "ccc"])) for k in range(r.choice([1, 2, 3, 5, 9]))]
    return rows


@pytest.mark.parametrize("block,fan,chunk", [(512, 64, 256), (4, 2, 2), (2, 3, 1)])
def test_trie_at_random(spark, monkeypatch, block, fan, chunk):
    """Small blocks take several levels, small chunks several doublings."""
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "FAN", fan)
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    monkeypatch.setattr(prefix_trie, "STRING", 3)
    rows = random_conversations(block, 150)
    assert trie_of(spark, rows) == plain_trie(plain_rebuilt(rows))


def closed(v, sizes, block, fan):
    """The tree by levels, as the tasks build it, without Spark."""
    n = len(v)
    level, size, nodes = 0, block, []
    items = [(i, v[i], v[i], i, 0, 0, sizes[i], sizes[i], False) for i in range(n)]
    while True:
        whole, rows = n <= size, []
        for b in sorted({x[0] // size for x in items}):
            group = [x for x in items if x[0] // size == b]
            ahead = [(*x[:8], True) for x in items if level == 0 and x[0] == (b + 1) * size]
            rows += prefix_trie.close(group + ahead, n, level, whole)
        same = {x[1]: x[4] for x in rows if x[0] == "same"}
        nodes = [(*x[:4], same.get(x[4], x[4]), *x[5:]) for x in nodes] + [x for x in rows if x[0] == "node"]
        if whole:
            return nodes
        items = [(x[1], x[2], x[10], *x[7:10], 0, 0, False) for x in rows if x[0] == "item"]
        size, level = size * fan, level + 1


def test_nearest_smaller_values_by_blocks():
    r = random.Random(3)
    for _ in range(400):
        n = r.randint(1, 40)
        v = [0] + [r.randint(0, r.choice([1, 3, 8])) for _ in range(n - 1)]
        sizes = [max(a, b) + r.choice([0, 0, 2]) for a, b in zip(v, [*v[1:], 0])]
        want = set()
        for i in range(n):
            l, h = i, i
            while l > 0 and v[l] >= v[i] and i:
                l -= 1
            while h < n - 1 and v[h + 1] >= v[i]:
                h += 1
            want.add((0, n - 1, 0) if v[i] == 0 else (l, h, v[i]))
            if sizes[i] > max(v[i], v[i + 1] if i + 1 < n else -1):
                want.add((i, i, sizes[i]))
        for block, fan in ((2, 2), (3, 4), (8, 2), (64, 2)):
            nodes = closed(v, sizes, block, fan)
            found = [(x[5], x[6], x[2]) for x in nodes]
            assert len(found) == len(set(found)) and set(found) == want
            place = {x[1]: x for x in nodes if x[1] is not None}
            for x in nodes:
                if x[2] > 0:
                    up = place[x[4]]
                    assert up[2] == x[3] and up[5] <= x[5] and x[6] <= up[6]
                assert x[7] == x[5]  # the least id is the first rank's here


def test_numbers_within_keys_that_fill_partitions(spark):
    df = spark.createDataFrame([(7 if k % 3 else k, k) for k in range(3000)], "key long, x long").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = prefix_trie.numbered_within(df, "key", ["x"], "n").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = defaultdict(list)
    for r in got:
        rows[r["key"]].append((r["x"], r["pos"]))
    assert all([p for _, p in sorted(x)] == list(range(1, len(x) + 1)) for x in rows.values()) and len(got) == 3000
    assert [r["i"] for r in prefix_trie.numbered(df, ["x"], "n").orderBy("x").collect()] == list(range(3000))
    assert prefix_trie.numbered(df.filter(F.lit(False)), ["x"], "n").count() == 0
