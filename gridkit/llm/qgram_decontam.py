"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are compared with letters lowered (ASCII and Latin-1)
and white space folded.
An item of m bytes may differ by k = floor(RATE * m) edits.  An alignment within
the budget shares at least m + 1 - Q * (k + 1) q-grams with the item, all on
diagonals (place in text minus place in item) that lie within k of each other,
so inside one of the overlapping bands of 2 * (k + 1) diagonals that start at
every multiple of k + 1.  Bands that reach the count are verified by a banded
alignment; all others are proven to be over the budget.

Counting goes in two steps, so that a q-gram that thousands of items and a text's
hundreds of lines share is never expanded whole.  First, for each distinct q-gram of a
text, the items' places that hold it are counted by item, once however often the text
repeats it: an item with fewer such places than its bound cannot reach it in any band.
The others are counted by band, pair by pair.  Both work in slices of ``SLICE`` entries.

The benchmark is a query set: it is read in blocks of at most ``BLOCK`` bytes; each
block meets every whole text in one pass without a shuffle, and what it finds is
written before the next block is read.

Items for which the lemma gives no bound (14 to 17 bytes, one edit) are looked up
by budget + 1 pieces, of which an alignment within the budget leaves one whole, and
verified in the same way; these pieces and items without a budget are found by one
probe per place and length, however many they are.

Edge cases: null or empty texts and items match nothing; items without a budget
(shorter than 14 bytes) must occur exactly; very long texts and items are read whole;
of alignments with equally few edits the first is reported, and equal items (also of one
item_id) are reported each; rows that repeat a doc_id are searched each; a null doc_id
is reported as null; an empty table gives an empty result; only doc_id, item_id and text
are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import _LOWER, _WHITE, U, flat, mix, pieces
from .common import stored, table, union_all, without

Q, RATE = 9, 0.075
#: bytes of benchmark text in one block
BLOCK = 4 << 20
_BITS = 20
#: index entries expanded at once in a task
SLICE = 1 << 20
FOUND = "doc_id long, item_id long, start long, stop long, edits int"


def fold(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowered bytes with white space folded to single spaces, and where each stood."""
    white = _WHITE[data]
    keep = ~white
    keep[1:] |= white[1:] & ~white[:-1]
    keep[:1] = True
    where = np.flatnonzero(keep)
    out = _LOWER[data[where]]
    out[white[where]] = 32
    # capitals of Latin-1 are C3 80 to C3 9E in UTF-8, without C3 97 (the times sign)
    after = np.flatnonzero(out[:-1] == 0xC3) + 1
    capital = after[(out[after] <= 0x9E) & (out[after] != 0x97)]
    out[capital] += 0x20
    return out, where


def grams(data: np.ndarray) -> np.ndarray:
    """The hash of the Q = 9 bytes from each place on."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, U)
    x = data.astype(U)
    two = x[:-1] | (x[1:] << U(8))
    four = two[:-2] | (two[2:] << U(16))
    eight = four[:-4] | (four[4:] << U(32))
    return mix(eight[:n] * U(0x9E3779B97F4A7C15) + x[Q - 1: Q - 1 + n])


@dataclass
class Items:
    """A block of the benchmark with its q-gram index."""

    ids: list
    texts: list
    budget: np.ndarray
    need: np.ndarray
    codes: np.ndarray     # sorted distinct hashes
    start: np.ndarray     # of each hash's places in item / place
    item: np.ndarray
    place: np.ndarray
    seen: np.ndarray      # bitmap over the low bits of the hashes
    own_slot: np.ndarray  # item by item: the q-grams (places in codes), sorted
    own_place: np.ndarray
    own_start: np.ndarray
    short: dict           # length -> (sorted codes, start of each code's entries, item, place in item)


def index(rows: list[tuple]) -> Items:
    ids, texts = [], []
    for item_id, text in rows:
        folded = fold(np.frombuffer((text or "").encode(), np.uint8))[0].tobytes().strip()
        if folded:
            ids.append(item_id)
            texts.append(folded)
    size = np.array([len(t) for t in texts], np.int64)
    budget = (size * RATE).astype(np.int64)
    need = size + 1 - Q * (budget + 1)
    codes, item, place = [], [], []
    for i, t in enumerate(texts):
        if budget[i] and need[i] >= 1:
            g = grams(np.frombuffer(t, np.uint8))
            codes.append(g)
            item.append(np.full(len(g), i, np.int64))
            place.append(np.arange(len(g)))
    code = np.concatenate(codes) if codes else np.zeros(0, U)
    order = np.argsort(code, kind="stable")
    item = (np.concatenate(item) if item else np.zeros(0, np.int64))[order]
    place = (np.concatenate(place) if place else np.zeros(0, np.int64))[order]
    distinct, first = np.unique(code[order], return_index=True)
    seen = np.zeros(1 << _BITS, bool)
    seen[(distinct & U((1 << _BITS) - 1)).astype(np.int64)] = True
    first = np.append(first, len(code))
    slot = np.repeat(np.arange(len(distinct)), np.diff(first))
    by_item = np.lexsort((slot, item))
    own_start = np.searchsorted(item[by_item], np.arange(len(texts) + 1))
    return Items(ids, texts, budget, need, distinct, first, item, place, seen, slot[by_item], place[by_item],
                 own_start, _short(texts, budget, need))


def windows(data: np.ndarray, length: int) -> np.ndarray:
    """A code of the ``length`` bytes from each place on."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, U)
    x, code, rest = data.astype(U), np.zeros(n, U), np.zeros(n, U)
    for j in range(length):
        if j < 8:
            code |= x[j: j + n] << U(8 * j)
        else:
            rest = rest * U(0x9E3779B97F4A7C15) + x[j: j + n] + U(1)
    return mix(code) + rest


def _short(texts: list[bytes], budget: np.ndarray, need: np.ndarray) -> dict:
    """Whole items without a budget, and the pieces of items without a bound, by length."""
    entries: dict[int, list[tuple[int, int, int]]] = {}
    for i, t in enumerate(texts):
        k = int(budget[i])
        if not k or need[i] < 1:
            cuts = [len(t) * j // (k + 1) for j in range(k + 2)]
            for low, high in zip(cuts, cuts[1:]):
                code = windows(np.frombuffer(t[low:high], np.uint8), high - low)[0]
                entries.setdefault(high - low, []).append((int(code), i, low))
    out = {}
    for length, rows in entries.items():
        rows.sort()
        codes, start = np.unique(np.array([r[0] for r in rows], U), return_index=True)
        out[length] = (codes, np.append(start, len(rows)), [r[1] for r in rows], [r[2] for r in rows])
    return out


def align(item: bytes, text: bytes, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """Least edits of ``item`` against a stretch of ``text`` that starts on a
    diagonal in [low, high): (start, stop, edits), or None above the budget."""
    low, high = low - budget, high + budget
    at = text.find(item, max(0, low), high + len(item))
    if at >= 0:
        return at, at + len(item), 0
    m, width = len(item), high - low
    pad = np.zeros(m + width, np.int16) - 1
    a, b = max(0, low), min(len(text), high + m)
    if b <= a:
        return None
    pad[a - low: b - low] = np.frombuffer(text[a:b], np.uint8)
    diag = np.arange(width)
    row, source = np.zeros(width, np.int64), diag.copy()
    for i in range(m):
        best = row + (pad[i: i + width] != item[i])
        origin = source.copy()
        if width > 1:
            skip = row[1:] + 1 < best[:-1]
            best[:-1][skip] = row[1:][skip] + 1
            origin[:-1][skip] = source[1:][skip]
        # an extra byte of the text costs one step along the row
        lead = best - diag
        least = np.minimum.accumulate(lead)
        comes = np.maximum.accumulate(np.where(lead == least, diag, 0))
        row, source = least + diag, origin[comes]
    end = int(np.argmin(row))
    if row[end] > budget:
        return None
    start, stop = low + int(source[end]), low + end + m
    return max(0, start), min(len(text), stop), int(row[end])


def _entries(column: np.ndarray, start: np.ndarray, slot: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``column`` at all index entries of the q-grams ``slot``, ``size`` of each."""
    return column[np.repeat(start[slot] - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def _search(items: Items):
    """Function of a task: texts in, found regions out."""

    def regions(offsets: np.ndarray, data: np.ndarray) -> Iterator[tuple]:
        folded, where = fold(data)
        bounds = np.searchsorted(where, offsets)
        g = grams(folded)
        hit = np.flatnonzero(items.seen[(g & U((1 << _BITS) - 1)).astype(np.int64)])
        slot = np.searchsorted(items.codes, g[hit])
        slot[slot == len(items.codes)] = 0
        ok = items.codes[slot] == g[hit] if len(items.codes) else np.zeros(len(hit), bool)
        hit, slot = hit[ok], slot[ok]
        text = np.searchsorted(bounds, hit, side="right") - 1
        inside = hit + Q <= bounds[text + 1]
        hit, slot, text = hit[inside], slot[inside], text[inside]
        if not len(hit):
            return
        first = np.searchsorted(text, np.arange(len(bounds)))  # the hits of each text
        for t, i in candidates(text, slot):
            part = slice(first[t], first[t + 1])
            a, z = int(bounds[t]), int(bounds[t + 1])
            k, reach = int(items.budget[i]), None
            for d in bands(hit[part] - a, slot[part], i, z - a):
                if reach is not None and reach >= d * (k + 1):
                    continue  # the region before reaches into this band
                got = align(items.texts[i], folded[a:z].tobytes(), d * (k + 1), (d + 2) * (k + 1), k)
                if got:
                    yield t, i, int(where[a + got[0]]), int(where[a + got[1] - 1]) + 1, got[2]
                    reach = got[0] + k

    def candidates(text: np.ndarray, slot: np.ndarray) -> Iterator[tuple[int, int]]:
        """(text, item) where enough of the item's places hold q-grams of the text."""
        n = len(items.ids)
        # every q-gram of a text once, text by text
        once = np.unique(text * len(items.codes) + slot)
        text, slot = np.divmod(once, len(items.codes))
        size = items.start[slot + 1] - items.start[slot]
        total = np.cumsum(size)
        low = 0
        while low < len(once):
            high = int(np.searchsorted(total, total[low] - size[low] + SLICE, side="right"))
            if high < len(once):  # whole texts, or a part of one that fills a slice
                whole = int(np.searchsorted(text, text[high]))
                high = whole if whole > low else high
            high = max(high, low + 1)
            if text[low] == text[high - 1]:  # one text: counts by item, slice by slice
                t, end = int(text[low]), int(np.searchsorted(text, text[low], side="right"))
                counts = np.zeros(n, np.int64)
                while low < end:
                    high = min(end, max(low + 1, int(np.searchsorted(total, total[low] - size[low] + SLICE, "right"))))
                    counts += np.bincount(_entries(items.item, items.start, slot[low:high], size[low:high]), minlength=n)
                    low = high
                for i in np.flatnonzero((counts >= items.need) & (counts > 0)).tolist():
                    yield t, i
                continue
            item = _entries(items.item, items.start, slot[low:high], size[low:high])
            pair, count = np.unique(np.repeat(text[low:high], size[low:high]) * n + item, return_counts=True)
            for p in pair[count >= items.need[pair % n]].tolist():
                yield divmod(p, n)
            low = high

    def bands(hit: np.ndarray, slot: np.ndarray, i: int, size: int) -> list[int]:
        """The bands of item ``i`` in a text of ``size`` bytes that reach its bound."""
        own = slice(items.own_start[i], items.own_start[i + 1])
        slots, places = items.own_slot[own], items.own_place[own]
        low = np.searchsorted(slots, slot)
        times = np.searchsorted(slots, slot, side="right") - low
        keep = times > 0
        hit, low, times = hit[keep], low[keep], times[keep]
        step, total = int(items.budget[i]) + 1, np.cumsum(times)
        least = -len(items.texts[i]) // step - 2
        counts = np.zeros(size // step + 3 - least, np.int64)
        a = 0
        while a < len(hit):
            b = max(a + 1, int(np.searchsorted(total, total[a] - times[a] + SLICE, side="right")))
            n = times[a:b]
            place = places[np.repeat(low[a:b], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            band = (np.repeat(hit[a:b], n) - place) // step - least
            counts += np.bincount(band, minlength=len(counts)) + np.bincount(band - 1, minlength=len(counts))
            a = b
        return (np.flatnonzero(counts >= items.need[i]) + least).tolist()

    def whole(offsets: np.ndarray, data: np.ndarray) -> Iterator[tuple]:
        for t in range(len(offsets) - 1):
            folded, where = fold(data[offsets[t]: offsets[t + 1]])
            raw, place = folded.tobytes(), lambda at: int(offsets[t] + where[at])  # noqa: B023
            last: dict[int, int] = {}  # where each item's last region leaves off
            starts: set[tuple[int, int]] = set()  # (diagonal, item) of pieces found
            for length, (codes, start, item, low) in items.short.items():
                code = windows(folded, length)
                slot = np.searchsorted(codes, code)
                slot[slot == len(codes)] = 0
                for at in np.flatnonzero(codes[slot] == code).tolist():
                    for e in range(start[slot[at]], start[slot[at] + 1]):
                        i = item[e]
                        if raw[at: at + length] != items.texts[i][low[e]: low[e] + length]:
                            continue
                        if items.budget[i]:
                            starts.add((at - low[e], i))
                        elif at >= last.get(i, 0):
                            last[i] = at + length
                            yield t, i, place(at), place(at + length - 1) + 1, 0
            reach: dict[int, int] = {}
            for d, i in sorted(starts):
                k = int(items.budget[i])
                if i in reach and reach[i] + k >= d:
                    continue  # the region before reaches here
                got = align(items.texts[i], raw, d, d + 1, k)
                if got:
                    yield t, i, place(got[0]), place(got[1] - 1) + 1, got[2]
                    reach[i] = got[0]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = flat(batch.column(1))
            ids, out = batch.column(0).to_pylist(), []
            for a, b in pieces(offsets):
                off, part = offsets[a: b + 1] - offsets[a], data[offsets[a]: offsets[b]]
                found = list(regions(off, part)) if len(part) else []
                if items.short and len(part):
                    found += whole(off, part)
                for t, i, start, stop, edits in found:
                    lead = part[off[t]: stop]
                    chars = np.cumsum((lead & 0xC0) != 0x80)  # bytes to code points
                    s = int(chars[start - off[t]]) - 1
                    out.append((ids[a + t], items.ids[i], s, int(chars[-1]), edits))
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in cols[:4]] + [pa.array(cols[4], pa.int32())],
                names=["doc_id", "item_id", "start", "stop", "edits"])

    return search


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per region of a text that holds an item within its edit budget:
    doc_id, item_id, start, stop (code points of the text) and edits."""
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = []
    for b in range(blocks):
        block = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = sorted(((r["item_id"], r["text"]) for r in block.collect()), key=repr)
        out.append(stored(texts.mapInArrow(_search(index(rows)), FOUND), "regions"))
    return union_all(out)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item."""
    return without(docs, contaminated(docs, benchmark).select("doc_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
