"""Which of many words occur in a text: one walk per text over an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words and characters of words that one automaton may hold; what is more is dealt over several, and the texts are walked once for each.
WORDS, LETTERS = 200_000, 4_000_000


def automaton(words: list[str]) -> ahocorasick.Automaton | None:
    made = ahocorasick.Automaton()
    for word in words:
        if word:
            made.add_word(word, word)
    if not len(made):
        return None
    made.make_automaton()
    return made


def dealt(words: DataFrame) -> list[list[str]]:
    """The distinct words in parts that an automaton can hold. Each part is collected by itself; nulls are no words."""
    known = words.toDF("word").filter("word IS NOT NULL").distinct()
    n, letters = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("word")), F.lit(0))).first()
    parts = max(-(-n // WORDS), -(-letters // LETTERS), 1)
    return [[r["word"] for r in known.filter(F.pmod(F.xxhash64("word"), F.lit(parts)) == k).collect()] for k in range(parts)]


def mentions(texts: DataFrame, column: str, words: DataFrame) -> DataFrame:
    """texts with found: the distinct words (of the only column of words) that occur in `column`, in order; the empty word occurs in all but null texts.

    The words are broadcast in parts whose size is checked; a text never meets the words one by one, so words with a common beginning cost
    no more than others. A null text mentions nothing.
    """
    spark = texts.sparkSession
    names = texts.columns
    for k, part in enumerate(dealt(words)):
        held = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], held=held, first=not k) -> Iterator[pa.RecordBatch]:
            walk, empty = automaton(held.value), "" in held.value
            for batch in batches:
                before = [[]] * batch.num_rows if first else batch.column("found").to_pylist()
                found = []
                for text, old in zip(batch.column(column).to_pylist(), before):
                    seen = {w for _, w in walk.iter(text)} if text and walk else set()
                    found.append(sorted({*old, *seen, *([""] if empty and text is not None else [])}))
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found, pa.list_(pa.string()))], [*names, "found"])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields if f.name in names)
        texts = texts.mapInArrow(run, f"{kinds}, found array<string>")
    return texts
