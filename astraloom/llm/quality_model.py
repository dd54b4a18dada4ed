"""Quality classifier by supervised subword embeddings.

A text is a bag of hashed features: its words, the character 3- and 4-grams of each word between edge marks, and two
marker words (a word that repeats the one before it, a line that repeats an earlier one). Each feature has a learned
vector; a document is the average of its features' vectors and a softmax layer reads the classes from it. Vectors
and layer are trained by stochastic gradient descent in numpy on a bounded sample of labelled rows: of the texts of up
to `Settings.longest` bytes that have a label, the `Settings.rows` with the least hashes of text and label, equal ones once. As the layer is linear in the average, a feature's share of every class is one
number; scoring sums these over the whole text, with the sums of seen words remembered up to a bound.

Texts without words (null, empty, white space) get the layer's bias. Without labelled rows every score is 0.5; if class 1
was never seen it is 0. Texts of any length are scored whole. Rows that repeat an id are scored one by one; in the sample each
of an id's texts stands with each of its labels. Null ids count as held out. An empty table has no scores. Other columns are left out.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astraloom.llm.common import held_out, map_batches


@dataclass(frozen=True)
class Settings:
    rows: int = 5000  # most labelled rows to learn from
    longest: int = 1 << 15  # bytes of the longest text to learn from
    buckets: int = 1 << 17
    size: int = 8
    epochs: int = 6  # at least; few rows are gone through until `steps` batches are done
    steps: int = 500
    batch: int = 32
    rate: float = 4.0
    seed: int = 11
    remember: int = 300_000  # words whose sums a task keeps


REPEATED_WORD, REPEATED_LINE = b"\x00word", b"\x00line"


def tokens(text: str | None) -> list[bytes]:
    """Words of the whole text, then a marker for each repetition."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    again = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return words + [REPEATED_WORD] * again + [REPEATED_LINE] * (len(lines) - len(set(lines)))


def features(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(features of all words in order, how many each word has)."""
    joined = b"".join(b"<%b>" % w for w in words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    data = np.frombuffer(joined, np.uint8).astype(np.uint64)
    word_of = np.repeat(np.arange(len(words)), sizes)
    stops = np.cumsum(sizes)
    left = stops[word_of] - np.arange(len(data))  # bytes from here to the word's end
    found = [np.fromiter(map(zlib.crc32, words), np.uint64, len(words))]
    owner = [np.arange(len(words))]
    code = data[:-2] | data[1:-1] << np.uint64(8) | data[2:] << np.uint64(16) if len(data) > 2 else data[:0]
    for n in (3, 4):
        if n == 4:
            code = code[:-1] | data[3:] << np.uint64(24) if len(data) > 3 else code[:0]
        at = np.flatnonzero(left[: len(code)] >= n)
        found.append((code[at] + np.uint64(n << 32)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32))
        owner.append(word_of[at])
    owners = np.concatenate(owner)
    order = np.argsort(owners, kind="stable")
    return (np.concatenate(found) % np.uint64(buckets)).astype(np.int64)[order], np.bincount(owners, minlength=len(words))


@dataclass
class Model:
    """share: per feature its part of each class's logit; bias; classes in order."""

    share: np.ndarray
    bias: np.ndarray
    classes: list
    settings: Settings

    def scorer(self):
        """A function from texts to class probabilities that remembers words."""
        known: dict[bytes, int] = {}
        sums = np.zeros((self.settings.remember, len(self.classes)))
        counts = np.zeros(self.settings.remember)

        def learn(words: list[bytes]) -> None:
            fs, sizes = features(words, self.settings.buckets)
            starts = np.cumsum(sizes) - sizes
            at = len(known)
            sums[at : at + len(words)] = np.add.reduceat(self.share[fs], starts, axis=0)
            counts[at : at + len(words)] = sizes
            known.update(zip(words, range(at, at + len(words)), strict=True))

        def score(texts: list[str | None]) -> np.ndarray:
            out = np.tile(self.bias, (len(texts), 1)).astype(float)
            for i, text in enumerate(texts):
                words = tokens(text)
                total, n = np.zeros(len(self.classes)), 0.0
                # a text of more words than a task may keep is taken in parts
                for k in range(0, len(words), self.settings.remember // 2):
                    part = words[k : k + self.settings.remember // 2]
                    new = [w for w in dict.fromkeys(part) if w not in known]
                    if len(known) + len(new) > self.settings.remember:
                        known.clear()
                        new = list(dict.fromkeys(part))
                    if new:
                        learn(new)
                    at = np.fromiter(map(known.__getitem__, part), np.int64, len(part))
                    total += sums[at].sum(axis=0)
                    n += counts[at].sum()
                if n:
                    out[i] += total / n
            out = np.exp(out - out.max(axis=1, keepdims=True))
            return out / out.sum(axis=1, keepdims=True)

        return score


#: Components of vectors and layer stay within it, so that contradictory samples don't diverge.
BOUND = np.float32(32)


def train(texts: list[str | None], labels: list, settings: Settings = Settings()) -> Model:
    """Learns vectors and layer; texts in any order give one model for one order."""
    classes = sorted(set(labels))
    rng = np.random.default_rng(settings.seed)
    dim, n_classes = settings.size, len(classes)
    vectors = rng.uniform(-1 / dim, 1 / dim, (settings.buckets, dim)).astype(np.float32)
    layer = np.zeros((dim, n_classes), np.float32)
    bias = np.zeros(n_classes, np.float32)
    docs: list[tuple[np.ndarray, np.ndarray]] = []
    for text in texts:
        words = tokens(text)
        if not words:
            docs.append((np.zeros(0, np.int64), np.zeros(0, np.float32)))
            continue
        fs, _ = features(words, settings.buckets)
        ids, count = np.unique(fs, return_counts=True)
        docs.append((ids, (count / count.sum()).astype(np.float32)))
    target = np.array([classes.index(x) for x in labels])
    batches = max(1, -(-len(docs) // settings.batch))
    epochs = max(settings.epochs, -(-settings.steps // batches))
    steps, done = epochs * batches, 0
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), settings.batch):
            batch = order[at : at + settings.batch]
            rate = settings.rate * (1 - done / steps)
            done += 1
            ids = np.concatenate([docs[i][0] for i in batch])
            weight = np.concatenate([docs[i][1] for i in batch])
            owner = np.repeat(np.arange(len(batch)), [len(docs[i][0]) for i in batch])
            average = np.zeros((len(batch), dim), np.float32)
            if len(ids):
                weighted = vectors[ids] * weight[:, None]
                for d in range(dim):
                    average[:, d] = np.bincount(owner, weighted[:, d], minlength=len(batch))
            logits = average @ layer + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(batch)), target[batch]] -= 1
            back = p @ layer.T
            layer = np.clip(layer - rate / len(batch) * (average.T @ p), -BOUND, BOUND)
            bias -= rate / len(batch) * p.sum(axis=0)
            if len(ids):
                order_of = np.argsort(ids, kind="stable")
                step = (rate * weight[:, None] * back[owner])[order_of]
                heads = np.flatnonzero(np.append(True, np.diff(ids[order_of])))
                moved = ids[order_of][heads]
                vectors[moved] = np.clip(vectors[moved] - np.add.reduceat(step, heads, axis=0), -BOUND, BOUND)
    return Model((vectors.astype(float) @ layer), bias.astype(float), classes, settings)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", settings: Settings = Settings()) -> Model | None:
    """A model from labelled rows that are not held out; None if there are none."""
    chosen = (
        labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("label").isNotNull() & ~held_out())
        .distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(settings.rows)
    )
    short = docs.select("doc_id", "text").filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= settings.longest)
    # an id may have any number of rows: what is broadcast is bounded by settings.rows, what is collected by rows * longest
    found = short.join(F.broadcast(chosen), "doc_id").select("text", "label", F.xxhash64("text", "label").alias("hash"))
    rows = found.groupBy("hash").agg(F.first("text").alias("text"), F.first("label").alias("label")).orderBy("hash").limit(settings.rows).collect()
    if not rows:
        return None
    return train([r["text"] for r in rows], [r["label"] for r in rows], settings)


def score_quality(docs: DataFrame, model: Model | None, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (probability of class 1) and predicted for every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by settings.buckets

    def make():
        model = held.value
        score = model.scorer() if model else None
        one = model.classes.index(1) if model and 1 in model.classes else None

        def fn(batch: pa.RecordBatch) -> dict:
            if score is None:
                p = [0.5] * batch.num_rows
            elif one is None:
                p = [0.0] * batch.num_rows
            else:
                p = score(batch.column(2).to_pylist())[:, one].tolist()
            return {"doc_id": batch.column(0), "held_out": batch.column(1), "score": p, "predicted": [int(x >= threshold) for x in p]}

        return fn

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", held_out().alias("held_out"), "text"), f"doc_id {kind}, held_out boolean, score double, predicted int", make)
