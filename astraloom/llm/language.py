"""Language identification by nearest centroid.

A text's letters, lowered, with one space for anything between words, give counts of hashed 1-, 2- and 3-grams that
do not span a space inside. Counts become normalised TF-IDF vectors; each language has several centroids from
spherical k-means over its sample, and a text goes to the language of the centroid with the largest cosine. A
centroid rejects a text that is farther (1 - cosine) than nearly all of its own sample is; the general result says
so in `rejected`. The score is a softmax over the languages' best cosines.

Document frequencies, centroids and radii come from a bounded sample of texts of up to `Settings.longest` bytes: of each
language those with the least hashes of id and text, equal rows once (`Settings.rows` in all, shared among the languages;
where there are more languages than that, the most frequent ones). A null text or one without a letter is `und` with
score 0; so is every text where nothing was learned. Texts of any length are read whole. Rows that repeat an id are
rows like others; null ids count as held out. Ties go to the language that sorts first. An empty table has no
predictions. Other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from astraloom.llm.common import held_out, map_batches

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    rows: int = 4000  # most rows, and languages, to learn from
    longest: int = 1 << 15  # bytes of the longest text to learn from
    features: int = 8192
    centroids: int = 4
    rounds: int = 8
    quantile: float = 0.995  # of the distances of a centroid's own sample: its radius
    slack: float = 0.1
    temperature: float = 0.05
    seed: int = 5


_TABLE: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Per code point 2 for a letter, 1 for a mark that belongs to a word, else 0."""
    if not _TABLE:
        import unicodedata

        _TABLE.append(np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8))
    return _TABLE[0]


def counts(text: str | None, n_features: int, table: np.ndarray) -> np.ndarray | None:
    """Counts of hashed n-grams; None without a letter."""
    if not text:
        return None
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = table[code]
    if not (kind == 2).any():
        return None
    is_letter = kind > 0
    code = np.where(is_letter, code, 32).astype(np.uint64)
    keep = is_letter | np.append(True, is_letter[:-1])
    code = np.concatenate(([32], code[keep], [32])).astype(np.uint64)
    space = code == 32
    golden = np.uint64(0x9E3779B97F4A7C15)
    one = code[~space]
    two = code[:-1] << np.uint64(21) | code[1:]
    three = (two[:-1] << np.uint64(21) | code[2:])[~space[1:-1]]
    two = two[~(space[:-1] & space[1:])]
    grams = np.concatenate([one * golden, (two + np.uint64(1 << 60)) * golden, (three ^ np.uint64(1 << 63)) * golden])
    return np.bincount((grams >> np.uint64(40)).astype(np.int64) % n_features, minlength=n_features)


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray  # one row each, normalised
    owner: np.ndarray  # language of each centroid
    radius: np.ndarray
    languages: list[str]
    settings: Settings

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, rejected) of each text."""
        table = letters()
        found: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, True)] * len(texts)
        for at in range(0, len(texts), 256):
            rows, where = [], []
            for i, text in enumerate(texts[at : at + 256], at):
                c = counts(text, self.settings.features, table)
                if c is not None:
                    rows.append(c)
                    where.append(i)
            if not rows:
                continue
            x = np.array(rows, np.float32) * self.idf
            cos = (x @ self.centroids.T) / np.linalg.norm(x, axis=1, keepdims=True)
            best = np.stack([cos[:, self.owner == k].max(axis=1) for k in range(len(self.languages))], 1)
            near = cos.argmax(axis=1)
            p = np.exp((best - best.max(axis=1, keepdims=True)) / self.settings.temperature)
            p = p.max(axis=1) / p.sum(axis=1)
            far = 1 - cos[np.arange(len(near)), near] > self.radius[near]
            for i, k, score, out in zip(where, near.tolist(), p.tolist(), far.tolist(), strict=True):
                found[i] = self.languages[self.owner[k]], min(1.0, score), out
        return found


def train(texts: list[str], langs: list[str], settings: Settings = Settings()) -> Model | None:
    table = letters()
    x = np.empty((len(texts), settings.features), np.float32)
    of_rows: list[str] = []
    for text, lang in zip(texts, langs, strict=True):
        found = counts(text, settings.features, table)
        if found is not None:
            x[len(of_rows)] = found
            of_rows.append(lang)
    if not of_rows:
        return None
    x, of = x[: len(of_rows)], np.array(of_rows)
    df = (x > 0).sum(axis=0)
    idf = (np.log((1 + len(x)) / (1 + df)) + 1).astype(np.float32)
    x *= idf
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rng = np.random.default_rng(settings.seed)
    languages = sorted(set(of.tolist()))
    centroids, owner, radius = [], [], []
    for k, lang in enumerate(languages):
        own = x[of == lang]
        n = min(settings.centroids, len(own))
        c = own[rng.choice(len(own), n, replace=False)]
        for _ in range(settings.rounds):
            nearest = (own @ c.T).argmax(axis=1)
            for j in range(n):
                if (mine := nearest == j).any():
                    mean = own[mine].sum(axis=0)
                    c[j] = mean / np.linalg.norm(mean)
        cos = own @ c.T
        nearest = cos.argmax(axis=1)
        for j in range(n):
            if (mine := nearest == j).any():
                centroids.append(c[j])
                owner.append(k)
                radius.append(float(np.quantile(1 - cos[mine, j], settings.quantile)) + settings.slack)
    return Model(idf, np.array(centroids, np.float32), np.array(owner), np.array(radius), languages, settings)


def fit(docs: DataFrame, settings: Settings = Settings()) -> Model | None:
    """A model from the text and lang of rows that are not held out; None if there are none."""
    hashed = F.xxhash64("doc_id", "text")
    known = F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out() & (F.octet_length("text") <= settings.longest)
    rows = docs.filter(known).select("lang", hashed.alias("hash"), "text")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(settings.rows).collect()  # bounded by settings.rows
    if not sizes:
        return None
    share = max(1, settings.rows // len(sizes))
    # the hash thins large languages out to some four shares before the window ranks them, and equal rows become one, so no language gathers in a task
    limits = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 4 * share / r["n"])) for r in sizes], "lang string, part double")
    thin = rows.join(F.broadcast(limits), "lang").filter(F.pmod(F.col("hash"), F.lit(1_000_000)) / 1e6 < F.col("part"))
    order = Window.partitionBy("lang").orderBy("hash")
    chosen = thin.groupBy("lang", "hash").agg(F.first("text").alias("text")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= share)
    found = sorted(chosen.select("lang", "hash", "text").collect())  # bounded by settings.rows and settings.longest
    return train([r["text"] for r in found], [r["lang"] for r in found], settings)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected for every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by settings.features and the languages

    def make():
        model = held.value

        def fn(batch: pa.RecordBatch) -> dict:
            texts = batch.column(2).to_pylist()
            found = model.predict(texts) if model else [(UNKNOWN, 0.0, True)] * len(texts)
            return {"doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": [x[0] for x in found], "score": [x[1] for x in found], "rejected": [x[2] for x in found]}

        return fn

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", held_out().alias("held_out"), "text"), f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean", make)
