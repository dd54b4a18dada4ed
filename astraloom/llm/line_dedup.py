"""Lines that many documents share stay in one document only.

Lines are exploded, a line's key (stripped, ASCII lower case) is hashed to 128 bits, documents are counted per hash, and what is over
the threshold is dropped. The shuffles carry hashes and ids; a text moves once, to its own hashes, and is put together again in order.
A key that a large part of all documents holds is counted by (key, document) first and is on the side of the join that adaptive
execution splits. A task holds one document's hashes at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astraloom.llm.common import map_batches, sliced, written

STRIP = b" \t\n\x0b\x0c\r"


def key_of(line: bytes, least_chars: int) -> bytes | None:
    """The line without white space at its ends, A-Z in lower case; None if it has fewer code points than least_chars."""
    key = line.strip(STRIP).lower()  # of bytes: ASCII letters only
    if len(key) < least_chars or (len(key) < 4 * least_chars and sum(b & 0xC0 != 0x80 for b in key) < least_chars):
        return None
    return key


def hash_of(line: bytes, least_chars: int) -> bytes | None:
    key = key_of(line, least_chars)
    return None if key is None else xxhash.xxh3_128_digest(key)


def _bytes(column: pa.Array) -> list[bytes]:
    return pc.fill_null(column, "").cast(pa.binary()).to_pylist()


def line_keys(docs: DataFrame, least_chars: int = 20) -> DataFrame:
    """A row per row and key: doc_id, h (128-bit hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced([batch]):
                rows, hashes = [], []
                for row, text in enumerate(_bytes(part.column("text"))):
                    found = {hash_of(line, least_chars) for line in text.split(b"\n")} - {None}
                    rows += [row] * len(found)
                    hashes += found
                ids = part.column("doc_id").take(pa.array(rows, pa.int32()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(hashes, pa.binary())], ["doc_id", "h"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, h binary")


def shared_hashes(docs: DataFrame, least_docs: int = 3, least_chars: int = 20) -> DataFrame:
    """doc_id and drop, the hashes of its lines that go: their key is in at least least_docs documents and this is not the largest of them."""
    # a document is an id; null ids are one document, the smallest: structs compare so
    lines = line_keys(docs, least_chars).select(F.struct("doc_id").alias("doc"), "h")
    shared = lines.groupBy("h").agg(F.count_distinct("doc").alias("n"), F.max("doc").alias("last")).filter(F.col("n") >= least_docs).select("h", "last")
    shared = written(shared, "shared-lines")  # small beside the lines; both sides of the join are then plain shuffles, which can be split
    gone = lines.join(shared, "h").filter(F.col("doc") < F.col("last"))
    return gone.groupBy("doc").agg(F.collect_set("h").alias("drop")).select(F.col("doc.doc_id").alias("doc_id"), "drop")


def without_shared_lines(docs: DataFrame, least_docs: int = 3, least_chars: int = 20) -> DataFrame:
    """docs (doc_id, text): doc_id, text (the lines that stay, joined by a line end), n_lines, n_dropped; a row per input row.

    Null and empty texts are one empty line. A document is a doc_id: rows that repeat an id, or have none, count as one document, and of
    a key's documents the largest id keeps all its lines, in all its rows; null is less than every id. Lines are ended by \\n only. A
    text of any length is one row of one task. An empty table gives none; other columns are left out.
    """
    drops = shared_hashes(docs, least_docs, least_chars).withColumnRenamed("doc_id", "_id")
    both = docs.select("doc_id", "text").join(drops, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("doc_id", "text", "drop")

    def reduced(batch: pa.RecordBatch) -> dict[str, list]:
        texts, counts, dropped = [], [], []
        for text, drop in zip(_bytes(batch.column("text")), batch.column("drop").to_pylist()):
            lines = text.split(b"\n")
            gone = set(drop or ())
            kept = [line for line in lines if hash_of(line, least_chars) not in gone] if gone else lines
            texts.append(b"\n".join(kept))
            counts.append(len(lines))
            dropped.append(len(lines) - len(kept))
        return {"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.binary()), "n_lines": counts, "n_dropped": dropped}

    return map_batches(both, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, n_lines long, n_dropped long", lambda: reduced)


def line_dedup_query(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_lines, n_dropped and kept_sha256, the digest of the text that stays."""
    return without_shared_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def oracle() -> str:
    return """
WITH lines AS (
  SELECT d.doc_id, u.pos, d.parts[u.pos] AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d, unnest(range(1, len(d.parts) + 1)) AS u(pos)
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), shared AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.*, s.k IS NOT NULL AND l.doc_id < s.last AS gone FROM keyed l LEFT JOIN shared s ON s.k = l.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
