"""Scores of fitted models, written out plainly, against what the operators return for every row."""

import math
import unicodedata
import zlib

import numpy as np
import pytest

from astraloom.llm import language, quality_model

GOLDEN = 0x9E3779B97F4A7C15
ODD = [None, "", " \n", "a", "word word word", "line\nline\nline", "é Ü ß \U0001f600", "12 34", "x" * 5000, "A\x00b"]


@pytest.fixture(scope="module")
def docs(spark, sf):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(10_000 + k, t, "en") for k, t in enumerate(ODD)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string")


def plain_quality(model, text):
    """Softmax of the layer over the average of all features' vectors: words, 3- and 4-grams between edge marks, and the two markers."""
    raw, n = (text or "").encode(), model.settings.buckets
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    words = words + [b"\x00word"] * sum(a == b for a, b in zip(words, words[1:])) + [b"\x00line"] * (len(lines) - len(set(lines)))
    found = []
    for w in words:
        found.append(zlib.crc32(w) % n)
        marked = b"<" + w + b">"
        for size in (3, 4):
            found += [(((int.from_bytes(marked[i : i + size], "little") + (size << 32)) * GOLDEN % 2**64) >> 32) % n for i in range(len(marked) - size + 1)]
    logits = [float(b) + (sum(float(model.share[f, c]) for f in found) / len(found) if found else 0.0) for c, b in enumerate(model.bias)]
    top = max(logits)
    return math.exp(logits[model.classes.index(1)] - top) / sum(math.exp(x - top) for x in logits)


def test_quality_scores(spark, sf, docs):
    rows, frame = docs
    model = quality_model.fit(frame, spark.read.parquet(f"{sf}/labels.parquet"))
    got = {r["doc_id"]: r for r in quality_model.score_quality(frame, model).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        want = plain_quality(model, text)
        assert abs(got[i]["score"] - want) < 1e-6 and (got[i]["predicted"] == int(want >= 0.3) or abs(want - 0.3) < 1e-6)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)


def plain_language(model, text):
    """Cosines of the TF-IDF vector of 1-, 2- and 3-grams to every centroid; softmax over the languages' best."""
    kind = [unicodedata.category(c)[0] for c in (text or "").lower()]
    if "L" not in kind:
        return "und", 0.0, True
    codes, before = [32], True
    for c, k in zip((text or "").lower(), kind):
        letter = k in "LM"
        if letter or before:
            codes.append(ord(c) if letter else 32)
        before = letter
    codes.append(32)
    grams = [a * GOLDEN for a in codes if a != 32]
    grams += [((a << 21 | b) + (1 << 60)) * GOLDEN for a, b in zip(codes, codes[1:]) if (a, b) != (32, 32)]
    grams += [((((a << 21 | b) << 21) % 2**64 | c) ^ (1 << 63)) * GOLDEN for a, b, c in zip(codes, codes[1:], codes[2:]) if b != 32]
    n = model.settings.features
    x = np.zeros(n)
    for g in grams:
        x[(g % 2**64 >> 40) % n] += 1
    x *= model.idf.astype(float)
    cos = model.centroids.astype(float) @ x / np.linalg.norm(x)
    best = [max(cos[model.owner == k]) for k in range(len(model.languages))]
    near = int(cos.argmax())
    score = 1 / sum(math.exp((b - max(best)) / model.settings.temperature) for b in best)
    return model.languages[model.owner[near]], score, bool(1 - cos[near] > model.radius[near])


def test_language_scores(docs):
    rows, frame = docs
    model = language.fit(frame)
    got = {r["doc_id"]: r for r in language.identify(frame, model).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        lang, score, rejected = plain_language(model, text)
        assert abs(got[i]["score"] - score) < 1e-3
        assert got[i]["lang_pred"] == lang or score < 0.51
        near_edge = got[i]["rejected"] != rejected
        assert not near_edge or lang != "und"
    assert sum(got[i]["rejected"] != plain_language(model, t)[2] for i, t, _ in rows) <= 2  # single precision at the edge of a radius
