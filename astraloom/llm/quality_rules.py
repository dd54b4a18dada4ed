"""Quality rules by compression bands.

A text is compressed with zstandard as a whole and in fixed chunks. Repetitive text compresses far below
what prose of its length does, random text far above. Each length class has its own band; a text is
rejected if its whole ratio leaves the band of its length, or if more than `max_bad_chunks` of its
chunks leave the band of a chunk. Chunks are full; where they leave a rest, a last one ends where the text ends. Before the bands stand two base rules: too few words, or too many of
them in three-word windows that return.

Null, empty and wordless texts have no words and fail the base rules; the ratios of null and empty ones are null. Texts of
any length are measured whole, chunk by chunk. A ratio on the edge of its band is inside. Repeated rows and ids and null
ids are rows like others; an empty table gives no rows; other columns are left out, or kept as they are by `keep_good`.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from astraloom.llm.common import map_batches, sliced

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Bands:
    """Ratios are compressed bytes over bytes; limits holds (bytes below, least ratio, largest ratio)."""

    limits: tuple[tuple[float, float, float], ...] = (
        (256, 0.36, 1.30),
        (512, 0.34, 0.98),
        (1024, 0.32, 0.88),
        (2048, 0.30, 0.80),
        (4096, 0.28, 0.74),
        (16384, 0.26, 0.72),
        (float("inf"), 0.24, 0.72),
    )
    chunk: int = 2048
    chunk_band: tuple[float, float] = (0.20, 0.80)
    max_bad_chunks: float = 0.34
    level: int = 3

    def of(self, n: int) -> tuple[float, float]:
        return next((low, high) for below, low, high in self.limits if n < below)


def repeated_words(words: list[bytes]) -> int:
    """How many words stand in a three-word window that occurs twice or more, its first place included."""
    n = len(words)
    if n < 4:
        return 0
    ids: defaultdict = defaultdict()
    ids.default_factory = ids.__len__
    w = np.fromiter(map(ids.__getitem__, words), np.int64, n)
    k = len(ids)
    if k == n:
        return 0
    two = w[:-1] * k + w[1:]
    if k > 2_000_000:  # three ids no longer fit into 63 bits
        two = np.unique(two, return_inverse=True)[1].astype(np.int64)
    three = two[:-1] * k + w[2:]
    _, inverse, count = np.unique(three, return_inverse=True, return_counts=True)
    again = count[inverse] > 1
    if not again.any():
        return 0
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= again
    return int(covered.sum())


def measure(text: str | None, bands: Bands, press: zstandard.ZstdCompressor) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ratio, bad_chunks)"""
    if not text:
        return 0, 0, 0, 0, 0, True, False, None, None
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n_words = len(words)
    word_chars = len(text) - sum(map(text.count, SPACES))
    n_symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    n_dup_lines = len(lines) - len(set(lines))
    n_repeat = repeated_words(words)
    base_failed = n_words < 50 or 100 * n_repeat > 50 * n_words
    ratio = len(press.compress(raw)) / len(raw)
    low, high = bands.of(len(raw))
    full = len(raw) // bands.chunk
    bad = 0
    if full:
        view = memoryview(raw)
        least, most = bands.chunk_band
        starts = [k * bands.chunk for k in range(full)] + [len(raw) - bands.chunk] * (len(raw) % bands.chunk > 0)
        for at in starts:
            r = len(press.compress(view[at : at + bands.chunk])) / bands.chunk
            bad += not least <= r <= most
    bad_share = bad / len(starts) if full else 0.0
    kept = not base_failed and low <= ratio <= high and bad_share <= bands.max_bad_chunks
    return n_words, word_chars, n_symbols, n_dup_lines, n_repeat, base_failed, kept, ratio, bad_share


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "bad_chunks")
TYPES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunks double"


def quality_rules(docs: DataFrame, bands: Bands = Bands(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id and the measures above. No shuffle; memory is one batch."""

    def make():
        press = zstandard.ZstdCompressor(level=bands.level)

        def fn(batch: pa.RecordBatch) -> dict:
            rows = [measure(t, bands, press) for t in batch.column(1).to_pylist()]
            return {id_col: batch.column(0)} | dict(zip(FIELDS, map(list, zip(*rows)), strict=True))

        return fn

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), f"{id_col} {kind}, {TYPES}", make)


def keep_good(docs: DataFrame, bands: Bands = Bands(), text_col: str = "text") -> DataFrame:
    """The documents that pass, with all their columns as they were."""
    at = docs.columns.index(text_col)

    def run(batches):
        press = zstandard.ZstdCompressor(level=bands.level)
        for batch in sliced(batches):
            yield batch.filter(pa.array([measure(t, bands, press)[6] for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
