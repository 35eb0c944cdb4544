"""Retrieval packing over a sharded BM25 inverted index.

1. Every text is encoded once; its ids (and the closing id) are stored.  Windows
   that a long document fills alone are cut from it at once, without a shuffle;
   only its rest of less than a window goes on.
2. Document frequencies of all ids are counted by the encoding tasks, which store
   them beside their rows, and summed; the vocabulary bounds their number.
3. Documents are dealt by range of a lexical key (the least hashes of their
   ids, then a hash of doc_id): a shard is a stretch of about
   ``SHARD_TOKENS`` tokens of alike documents, and a text that a third of all
   rows share spreads over as many shards as it fills.
4. In a shard, sorted by key and doc_id, an inverted index of its distinct texts is
   built.  A seed document opens a window; the index returns its unused neighbours by
   BM25 over all terms of the seed and these fill the window greedily; the piece that
   crosses the end is cut there, and its rest is the next window's seed.  With no
   neighbour left, the next unused document follows.  So only the last window of a
   shard is padded.

The search is local: a seed sees its own shard only, and a long document is
indexed and queried by its rest, with frequencies and mean length of whole texts.

So a row of a shard is always less than a window, and shards hold alike many
tokens, however long single texts are.

Edge cases: null and empty texts are the closing id alone; rows that repeat a
doc_id are packed each; a null doc_id is kept as null; texts of equal score go in the
order of the shard, copies one after the other; very long texts are encoded and packed
whole; only doc_id and text are read, so other columns may have any name; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import U, mix
from .common import stored, table
from .tokens import encoder as encoder_of, vocabulary

WINDOW, CLOSING = 2048, 1
SHARD_TOKENS = 4_000_000
K1, B = 1.2, 0.75
#: the best are asked for so many at a time, and again when these are used
NEIGHBOURS = 32
#: a term is common when one of so many documents of the shard holds it; and so
#: many products of two documents are kept at once
COMMON, PRODUCTS = 8, 32_000_000
NONE = (1 << 16) - 1
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _encode(files: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(files)
        # a fixed random order of the ids, by rank; no id has the rank NONE
        by_rank = np.argsort(mix(np.arange(NONE, dtype=U) + U(0x632BE59BD9B4E019)))
        rank = np.argsort(by_rank).astype(np.uint16)
        held = np.zeros(NONE, np.int64)  # documents by rank
        for names, bounds, ids in encoder.batches(batches):
            for low in range(0, len(names), 1000):
                high = min(len(names), low + 1000)
                own = bounds[low: high + 1] - bounds[low]
                rows = np.insert(ids[bounds[low]: bounds[high]], own[1:], CLOSING).astype(np.uint16)
                sizes = np.diff(own) + 1
                # distinct ranks of each row, rising
                ranks = np.repeat(np.arange(high - low, dtype=np.uint32) << np.uint32(16), sizes) | rank[rows]
                ranks = np.sort(ranks)
                ranks = ranks[np.append(True, ranks[1:] != ranks[:-1])]
                held += np.bincount(ranks & NONE, minlength=NONE)
                first = np.searchsorted(ranks, np.arange(high - low + 1) << 16)
                ranks = (ranks & NONE).astype(np.int64)
                keys = np.zeros(high - low, np.int64)  # the three least ranks name the neighbourhood
                for i in range(3):
                    at = np.minimum(first[:-1] + i, len(ranks) - 1)
                    keys = keys << 16 | np.where(first[:-1] + i < first[1:], ranks[at], 0)
                ends = np.append(0, np.cumsum(2 * sizes)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [names.slice(low, high - low).cast(pa.int64()), pa.array(keys << 15), pa.array(sizes, pa.int64()),
                     pa.Array.from_buffers(pa.binary(), high - low, [None, pa.py_buffer(ends), pa.py_buffer(rows)])],
                    names=["doc_id", "key", "n", "ids"])
        terms = np.flatnonzero(held)
        if len(terms):
            df = np.stack([by_rank[terms], held[terms]]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64())] * 3 + [pa.array([df.tobytes()], pa.binary())],
                names=["doc_id", "key", "n", "ids"])
    return run


def encode(docs: DataFrame, files: dict | None = None) -> DataFrame:
    """(doc_id, key, n, ids) of every row; the vocabulary must fit 16 bits.  A task adds a
    row without ``n``: which ids its documents hold, and how many of them (64 bits each)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(texts.mapInArrow(_encode(files or vocabulary()), "doc_id long, key long, n long, ids binary"),
                  "ids")


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for held in batch.column(0):
            term, count = np.frombuffer(held.as_buffer(), np.int64).reshape(2, -1)
            df[term] += count
    term = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(term, pa.int32()), pa.array(df[term])], names=["term", "df"])


class Index:
    """BM25 of one shard by all terms of the seed, with statistics of all documents.

    Equal documents are one entry.  Terms that a ``COMMON``-th of the entries hold are
    scored by a matrix product in single precision, all others by their postings;
    entries whose documents are used up leave both from time to time.  Entries that can
    be among the best within the rounding are scored again exactly.
    """

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        kinds: dict[bytes, int] = {}
        self.kind = np.array([kinds.setdefault(ids.tobytes(), len(kinds)) for ids in docs])
        self.n = len(kinds)
        self.member = np.argsort(self.kind, kind="stable")  # documents, entry by entry
        self.count = np.bincount(self.kind, minlength=self.n)  # unused ones
        self.end = np.cumsum(self.count)
        self.next = self.end - self.count
        self.seen = np.zeros(len(docs), bool)
        size = np.array([len(text) // 2 for text in kinds])
        word = np.frombuffer(b"".join(kinds), np.uint16)
        pair = np.repeat(np.arange(self.n, dtype=U) << U(16), size)
        pair |= word
        pair.sort()
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))  # of a term in an entry
        tf = np.diff(np.append(first, len(pair)))
        self.term = (pair[first] & U(0xFFFF)).astype(np.int64)
        self.owner = (pair[first] >> U(16)).astype(np.int64)
        norm = K1 * (1 - B + B * size / mean)
        self.weight = idf[self.term] * tf * (K1 + 1) / (tf + norm[self.owner])
        self.first = np.searchsorted(self.owner, np.arange(self.n + 1))
        common = np.flatnonzero(np.bincount(self.term, minlength=1 << 16) * COMMON >= self.n)
        column = np.full(1 << 16, -1)
        column[common] = np.arange(len(common))
        column = column[self.term]
        rare = column < 0
        self.left = np.zeros((self.n, len(common)), np.float32)
        self.left[self.owner[~rare], column[~rare]] = self.weight[~rare]
        self.held = (self.left > 0).astype(np.float32)
        self.products = None
        if self.n * self.n <= PRODUCTS:
            self.products, self.left, self.held = self.held @ self.left.T, None, None
        # a product is off by one rounding of its weights and one of each sum at most
        self.margin = 4 * (len(common) + 2) * 2.0 ** -24
        self.sought = np.zeros(1 << 16, bool)
        # postings of rare terms; entries go by their place among ``rows``
        self.rows = np.arange(self.n)
        term = self.term[rare]
        order = np.argsort(term.astype(np.uint16), kind="stable")
        self.doc = self.owner[rare][order]
        self.posting = self.weight[rare][order]
        self.start = np.searchsorted(term[order], np.arange((1 << 16) + 1))

    def _shrink(self) -> None:
        """Keep the entries with unused documents and their postings of rare terms."""
        open_ = self.count[self.rows] > 0
        if self.products is None:
            self.left = self.left[open_]
        keep = open_[self.doc]
        self.start = np.append(0, np.cumsum(keep))[self.start]
        self.doc = (np.cumsum(open_) - 1)[self.doc[keep]]
        self.posting = self.posting[keep]
        self.rows = self.rows[open_]

    def scores(self, seed: int, entries: np.ndarray) -> np.ndarray:
        """Exact BM25 of ``entries`` for all terms of the entry ``seed``."""
        terms = self.term[self.first[seed]: self.first[seed + 1]]
        sizes = self.first[entries + 1] - self.first[entries]
        at = np.cumsum(sizes) - sizes
        place = np.repeat(self.first[entries] - at, sizes) + np.arange(sizes.sum())
        self.sought[terms] = True
        found = np.add.reduceat(self.weight[place] * self.sought[self.term[place]], at)
        self.sought[terms] = False
        return found

    def neighbours(self, seed: int, used: np.ndarray) -> list[int]:
        """Unused documents by falling score, without those that share no term."""
        fresh = np.flatnonzero(used & ~self.seen)
        self.seen[fresh] = True
        np.subtract.at(self.count, self.kind[fresh], 1)
        if 4 * np.count_nonzero(self.count) < 3 * len(self.rows):
            self._shrink()
        seed = self.kind[seed]
        terms = self.term[self.first[seed]: self.first[seed + 1]]
        if self.products is None:
            score = (self.left @ self.held[seed]).astype(float)
        else:
            score = self.products[seed][self.rows].astype(float)
        first = self.start[terms]
        sizes = self.start[terms + 1] - first
        at = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        score += np.bincount(self.doc[at], self.posting[at], len(score))
        score[self.count[self.rows] == 0] = 0
        n = len(score)
        least = np.partition(score, n - NEIGHBOURS)[n - NEIGHBOURS] if n > NEIGHBOURS else 0.0
        best = self.rows[(score > 0) & (score >= least * (1 - self.margin))]
        if not len(best):
            return []
        out: list[int] = []
        for entry in best[np.lexsort((best, -self.scores(seed, best)))].tolist():
            at, end = int(self.next[entry]), int(self.end[entry])
            while at < end and used[self.member[at]]:
                at += 1
            self.next[entry] = at
            while at < end and len(out) < NEIGHBOURS:
                if not used[self.member[at]]:
                    out.append(int(self.member[at]))
                at += 1
            if len(out) == NEIGHBOURS:
                break
        return out


def fill(sizes: list[int], neighbours, window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, window number, offset), window by window.
    ``neighbours(seed, used)`` returns unused documents, best first."""
    used = np.zeros(len(sizes), bool)
    follow = iter(range(len(sizes)))
    number, room, start = 0, window, 0
    seed = asked = None  # the document at work; the one whose neighbours fill the window
    queue: list[int] = []
    while True:
        if seed is None:  # a window goes on with a neighbour, or with the next unused document
            while queue and used[queue[0]]:
                queue.pop(0)
            if queue:
                seed = queue.pop(0)
            elif asked is not None:
                queue = neighbours(asked, used)
                if not queue:
                    asked = None
                continue
            else:
                seed = next((d for d in follow if not used[d]), None)
                if seed is None:
                    return
                asked = seed
            used[seed], start = True, 0
        take = min(room, sizes[seed] - start)
        yield seed, start, take, number, window - room
        start, room = start + take, room - take
        rest = start < sizes[seed]
        if room == 0:
            number, room, queue = number + 1, window, []
            asked = seed if rest else None
        if not rest:
            seed = None


def _pack(idf: np.ndarray, mean: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, shard = [], 0
        for batch in batches:
            rows += zip(batch.column("key").to_pylist(), batch.column("doc_id").to_pylist(),
                        batch.column("start").to_pylist(), [bytes(x.as_buffer()) for x in batch.column("ids")])
            if batch.num_rows:
                shard = batch.column("shard")[0].as_py()
        if not rows:
            return
        # the order does not hang on how the shuffle's blocks came in
        rows.sort(key=lambda r: (r[0], r[1] is None, r[1] or 0, r[2], r[3]))
        _, names, before, docs = zip(*rows)
        docs = [np.frombuffer(x, np.uint16) for x in docs]
        index, out = Index(docs, idf, mean), []
        for d, start, length, number, offset in fill([len(x) for x in docs], index.neighbours):
            ids = docs[d][start: start + length].astype("<u4").tobytes()
            out.append((names[d], before[d] + start, length, ids, before[d] + len(docs[d]),
                        (shard << 32) + number, offset))
            if len(out) == 4000:
                yield _pieces(out)
                out = []
        if out:
            yield _pieces(out)
    return run


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows that a document fills alone."""
    number = 0
    for batch in batches:
        out = []
        for name, ids, n, part in zip(*(batch.column(c) for c in ("doc_id", "ids", "n", "part"))):
            ids = np.frombuffer(ids.as_buffer(), np.uint16)
            for start in range(0, len(ids) - WINDOW + 1, WINDOW):
                out.append((name.as_py(), start, WINDOW, ids[start: start + WINDOW].astype("<u4").tobytes(),
                            n.as_py(), (1 << 61) + (part.as_py() << 32) + number, 0))
                number += 1
                if len(out) == 1000:
                    yield _pieces(out)
                    out = []
        if out:
            yield _pieces(out)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                      names=[x.split()[0] for x in PIECES.split(", ")])


def pack(docs: DataFrame, files: dict | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Pieces of all documents with their ids (little-endian 32 bit)."""
    rows = encode(docs, files)
    encoded = rows.where("n IS NOT NULL")
    whole = encoded.agg(F.count("*").alias("rows"), F.sum("n").alias("tokens")).first()
    df = np.zeros(1 << 16)
    for r in (rows.where("n IS NULL").select("ids").mapInArrow(_frequencies, "term int, df long")
              .groupBy("term").agg(F.sum("df").alias("df")).collect()):  # one row per id of the vocabulary
        df[r["term"]] = r["df"]
    n = whole["rows"]
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    mean = (whole["tokens"] or 1) / max(n, 1)
    start = F.col("n") - F.col("n") % WINDOW
    alone = (encoded.where(F.col("n") >= WINDOW)
             .select("doc_id", "ids", "n", F.spark_partition_id().cast("long").alias("part"))
             .mapInArrow(_whole, PIECES))
    rests = encoded.where(F.col("n") % WINDOW > 0)
    tokens = rests.agg(F.sum(F.col("n") % WINDOW)).first()[0] or 1
    shards = max(1, -(-tokens // shard_tokens))
    # the low bits tell copies of a text apart, so that they spread over shards
    low = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 15))
    tail = F.expr(f"substring(ids, cast(n - n % {WINDOW} as int) * 2 + 1, {2 * WINDOW})")
    dealt = (rests.select("doc_id", start.alias("start"), tail.alias("ids"), (F.col("key") + low).alias("key"))
             .repartitionByRange(shards, "key").withColumn("shard", F.spark_partition_id().cast("long")))
    return dealt.select("doc_id", "start", "ids", "key", "shard").mapInArrow(_pack(idf, mean), PIECES).unionByName(alone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces_with_crc(pack(table(spark, sf_dir, "documents")))


def pieces_with_crc(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")
