"""Occurrences of the entries of a table in texts, in one pass per text (c06-c08).

The entries (phrases, names, tags) become an Aho-Corasick automaton: a text is read once
however many entries there are.  The driver takes the entries in blocks of at most
``ENTRIES`` and ``LETTERS``, builds a block's automaton, broadcasts it, and writes what
the tasks find before it takes the next block, so neither the driver nor a task ever
holds more than one block.  Texts stay where they are: no join, no shuffle.

Two ways of counting:

``each``     every entry by itself: its occurrences from left to right that do not
             overlap one another, as ``replace`` would take them out
``longest``  entries compete: from left to right the longest one that starts first; a
             name inside a longer name is not reported

``whole`` asks for no letter, digit or joiner (``-``, ``_``) beside an occurrence.
Null and empty entries and texts have no occurrence; entries that repeat count once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

#: entries and characters of one automaton
ENTRIES, LETTERS = 500_000, 16_000_000


def _automaton(entries: list[str]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for i, e in enumerate(entries):
        out.add_word(e, i)
    out.make_automaton()
    return out


def _joined(c: str) -> bool:
    return c.isalnum() or c in "-_"


def _stands_alone(text: str, start: int, end: int) -> bool:
    """No letter, digit or joiner goes on before ``start`` or after ``end`` (inclusive)."""
    return not ((start > 0 and _joined(text[start - 1]) and _joined(text[start]))
                or (end + 1 < len(text) and _joined(text[end + 1]) and _joined(text[end])))


def count_entries(text: str, automaton, entries: list[str], mode: str, whole: bool) -> dict[int, int]:
    counts: dict[int, int] = {}
    if mode == "each":
        ends: dict[int, int] = {}
        for end, i in automaton.iter(text):
            start = end - len(entries[i]) + 1
            if start > ends.get(i, -1) and not (whole and not _stands_alone(text, start, end)):
                ends[i] = end
                counts[i] = counts.get(i, 0) + 1
        return counts
    # the longest entry at each start, then the starts from left to right
    best: dict[int, tuple[int, int]] = {}
    for end, i in automaton.iter(text):
        start = end - len(entries[i]) + 1
        if (start not in best or end > best[start][0]) and not (whole and not _stands_alone(text, start, end)):
            best[start] = (end, i)
    at = -1
    for start in sorted(best):
        if start > at:
            at, i = best[start]
            counts[i] = counts.get(i, 0) + 1
    return counts


def _blocks(entries: DataFrame) -> Iterator[list[str]]:
    block, letters = [], 0
    for r in entries.orderBy("entry").toLocalIterator():
        if block and (len(block) >= ENTRIES or letters + len(r["entry"]) > LETTERS):
            yield block
            block, letters = [], 0
        block.append(r["entry"])
        letters += len(r["entry"])
    if block:
        yield block


def occurrences(docs: DataFrame, entries: DataFrame, entry: str = "entry", mode: str = "each",
                whole: bool = False, fold_case: bool = False) -> DataFrame:
    """(doc_id, entry, occurrences) of the entries that each text of ``docs`` (doc_id,
    text) holds.  ``longest`` needs the entries in one block and raises beyond it."""
    if mode not in ("each", "longest"):
        raise ValueError(f"unknown mode {mode!r}")
    spark = docs.sparkSession
    fold = F.lower if fold_case else (lambda c: c)
    names = entries.select(fold(F.col(entry)).alias("entry")).where("entry <> ''").distinct()
    texts = docs.where("text IS NOT NULL").select("doc_id", fold(F.col("text")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, entry string, occurrences long"
    path = scratch_path(spark, f"occurrences-{uuid.uuid4().hex[:10]}")
    done = 0
    for block in _blocks(names):
        if done and mode == "longest":
            raise ValueError(f"entries that compete must fit one block of {ENTRIES} entries and {LETTERS} characters")
        shared = spark.sparkContext.broadcast((_automaton(block), block))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automaton, held = shared.value
            for batch in batches:
                row, found, n = [], [], []
                for at, text in enumerate(batch.column(1).to_pylist()):
                    for i, k in count_entries(text, automaton, held, mode, whole).items():
                        row.append(at)
                        found.append(held[i])
                        n.append(k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int64())), pa.array(found, pa.string()),
                     pa.array(n, pa.int64())], names=["doc_id", "entry", "occurrences"])

        texts.mapInArrow(scan, schema).write.mode("append").parquet(path)
        shared.destroy()
        done += 1
    return spark.read.schema(schema).parquet(path) if done else spark.createDataFrame([], schema)
