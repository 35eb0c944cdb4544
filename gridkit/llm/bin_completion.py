"""Best-fit packing by bin completion: documents in as few sequences as can be found.

1. Tasks encode whole texts and cut only those longer than a sequence: whole
   windows from the end, so that the first piece may be shorter.  A piece is
   numbered among the pieces of its length in its task; the numbers are written
   with it, and running sums of (task, length) counts make them global.  So a
   length that a third of all rows share is never in one task.
2. How many pieces have each length is a table of at most ``window`` rows, whatever
   the size of the data; only this comes to the driver.
3. The driver seeks fillings (lengths of one sequence) and how often to use each,
   by branch and bound over the counts: around the largest length left it
   enumerates the fillings that no other one dominates, fullest and of fewest pieces first, uses one as
   often as it goes (or once), and leaves a branch whose waste bound (Martello and
   Toth's L2 of the rest) cannot beat the incumbent.  Incumbents are best-fit
   decreasing completions of the nodes.  It ends when the incumbent meets the bound
   of the whole, which proves it least, or after ``effort`` nodes; effort changes
   how hard it seeks, never which pieces are packed.
4. Piece ``number`` of a length goes to the place that the plan gives to this number.
   The plan's size depends on ``window`` alone.

Edge cases: null and empty texts are the closing id alone; a text of any length is
cut into as many windows as it fills; rows that repeat (also a doc_id) are packed
each; a null doc_id is kept as null; ties among fillings go to the one enumerated
first, ties among documents to the order in which tasks read them; an empty table
gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table
from .tokens import encoder as encoder_of, vocabulary

WINDOW, CLOSING = 1024, 2
#: nodes of the search, fillings kept at a node, and nodes between best-fit completions
EFFORT, WIDTH, COMPLETE = 4000, 4, 16
CUT = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, number long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _cut(files: dict, window: int, closing: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = encoder_of(files), TaskContext.get().partitionId()
        seen = [0] * (window + 1)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in CUT.split(", ")] + ["ids"]
        if not with_ids:
            kinds, names = kinds[:-1], names[:-1]

        def rows(out):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

        for doc_ids, bounds, tokens in encoder.batches(batches):
            out = []
            for i, doc in enumerate(doc_ids.to_pylist()):
                ids = np.append(tokens[bounds[i]: bounds[i + 1]], closing).astype("<u4").tobytes()
                n = len(ids) // 4
                start, piece = 0, 0
                while start < n:
                    length = window if piece else (n % window or window)
                    own = ids[4 * start: 4 * (start + length)]
                    row = (doc, piece, start, length, zlib.crc32(own), part, seen[length])
                    out.append(row + (own,) if with_ids else row)
                    seen[length] += 1
                    start, piece = start + length, piece + 1
                    if len(out) == 4000:
                        yield rows(out)
                        out = []
            if out:
                yield rows(out)
    return run


# -- the plan over counts by length -----------------------------------------

Filling = tuple[tuple[int, int], ...]  # (length, copies), longest first


def lower_bound(counts: np.ndarray, window: int) -> int:
    """Martello and Toth's L2: no packing of these counts has fewer sequences."""
    sizes = np.arange(window + 1)
    n, total = np.cumsum(counts), np.cumsum(counts * sizes)
    half = window // 2
    a = np.arange(half + 1)  # lengths below a are left out of account
    large = n[-1] - n[half]
    room = (n[window - a] - n[half]) * window - (total[window - a] - total[half])
    small = total[half] - np.where(a > 0, total[a - 1], 0)
    return int(large + np.maximum(0, -(-(small - room) // window)).max())


def best_fit(counts: np.ndarray, window: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing over counts: like sequences are handled together."""
    open_: dict[int, list[tuple[Filling, int]]] = {}  # by room left
    rooms: list[int] = []

    def add(room: int, filling: Filling, times: int) -> None:
        if times:
            if room not in open_:
                open_[room] = []
                rooms.append(room)
            open_[room].append((filling, times))

    for size in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[size])
        for room in sorted(r for r in rooms if r >= size):
            fit = room // size
            while left and open_[room]:
                filling, times = open_[room].pop()
                full = min(times, left // fit)
                add(room - fit * size, filling + ((size, fit),), full)
                left -= full * fit
                if full < times:  # less than ``fit`` are left: they go into one more
                    if left:
                        add(room - left * size, filling + ((size, left),), 1)
                    add(room, filling, times - full - (left > 0))
                    left = 0
            if not left:
                break
        fit = window // size
        add(window - fit * size, ((size, fit),), left // fit)
        if left % fit:
            add(window - left % fit * size, ((size, left % fit),), 1)
        rooms[:] = [r for r in rooms if open_[r] and r]
        for r in [r for r in open_ if not open_[r]]:
            del open_[r]
    return [x for group in open_.values() for x in group]


def _dominated(filling: list[int], slack: int, spare: int) -> bool:
    """Whether a spare length (bit set) could stand for some of ``filling``'s pieces
    (whose first, the largest, is fixed) and fill no less."""
    one, more = 1, 0  # sums of subsets; of those with two pieces or more
    for size in filling[1:]:
        more |= (one & ~1) << size
        one |= one << size
    if more & spare:
        return True
    sums = one & ~1
    return any(sums & (spare >> d) for d in range(1, slack + 1))


def fillings(counts: np.ndarray, window: int, width: int = WIDTH) -> list[Filling]:
    """Undominated fillings around the largest length, fullest first.  They are sought
    from long to short pieces, until ``width`` are kept or ``4 * width`` were full."""
    sizes = np.flatnonzero(counts)[::-1].tolist()
    left = dict(zip(sizes, counts[sizes].tolist()))
    largest = sizes[0]
    left[largest] -= 1
    room = window - largest
    if left.get(room):
        return [tuple({largest: 1 + (room == largest), room: 1 + (room == largest)}.items())]  # dominates all others
    # place of the longest length that fits into a room
    fits = (len(sizes) - np.searchsorted(np.array(sizes[::-1]), np.arange(window + 1), "right")).tolist()
    spare = sum(1 << s for s in sizes)
    kept: list[tuple[int, Filling]] = []
    tried, chosen = 0, [largest]

    def grow(at: int, room: int) -> None:
        nonlocal tried
        for i in range(max(at, fits[room]), len(sizes)):
            size = sizes[i]
            if left[size]:
                if tried >= 4 * width or len(kept) >= width:
                    return
                left[size] -= 1
                chosen.append(size)
                grow(i, room - size)
                chosen.pop()
                left[size] += 1
        if any(left[s] for s in sizes[fits[room]:]):
            return  # not full
        tried += 1
        free = spare
        for s in set(chosen):
            if not left[s]:
                free &= ~(1 << s)
        if not _dominated(chosen, room, free):
            parts: dict[int, int] = {}
            for s in chosen:
                parts[s] = parts.get(s, 0) + 1
            kept.append((room, tuple(parts.items())))

    # the filling that always takes the longest piece; many short ones are taken together
    greedy, rest = {largest: 1}, room
    for s in sizes[fits[rest]:]:
        take = min(left[s], rest // s)
        if take:
            greedy[s] = greedy.get(s, 0) + take
            rest -= take * s
    if sum(greedy.values()) <= 64:
        grow(0, room)
    kept.sort(key=lambda x: (x[0], sum(c for _, c in x[1])))
    found = [f for _, f in kept]
    first = tuple(greedy.items())
    return found if first in found else found + [first]


def plan(counts: np.ndarray, window: int = WINDOW, effort: int = EFFORT,
         width: int = WIDTH) -> list[tuple[Filling, int]]:
    """Fillings with their numbers that use up ``counts`` (by length, 0..window)."""
    counts = counts.astype(np.int64)
    best = best_fit(counts, window)
    least, target = sum(t for _, t in best), lower_bound(counts, window)
    stack = [(counts, (), 0)]  # what is left, the fillings used (linked), their number
    nodes = 0
    while stack and least > target and nodes < effort:
        left, used, n = stack.pop()
        if n + lower_bound(left, window) >= least:
            continue
        nodes += 1
        if nodes % COMPLETE == 0 or np.count_nonzero(left) <= 4 * COMPLETE:
            rest = best_fit(left, window)
            if n + sum(t for _, t in rest) < least:
                least = n + sum(t for _, t in rest)
                best = rest
                at = used
                while at:
                    at, step = at
                    best.append(step)
        children = []
        for filling in fillings(left, window, width) if left.any() else ():
            times = min(int(left[s]) // c for s, c in filling)
            for k in (times, 1) if times > 1 else (1,):
                after = left.copy()
                for s, c in filling:
                    after[s] -= c * k
                children.append((after, (used, (filling, k)), n + k))
        stack.extend(reversed(children))
    return best


def _places(found: list[tuple[Filling, int]]) -> np.ndarray:
    """(length, first number, first sequence, copies, offset) by length and number."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for filling, times in found:
        offset = 0
        for size, copies in filling:
            rows.append((size, taken.get(size, 0), sequence, copies, offset))
            taken[size] = taken.get(size, 0) + copies * times
            offset += copies * size
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _place(places: np.ndarray, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = np.searchsorted(places[:, 0], np.arange(places[-1, 0] + 2)) if len(places) else None
        for batch in batches:
            if not batch.num_rows:
                continue
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            order = np.lexsort((number, length))
            at = np.empty(len(order), np.int64)
            for size in np.unique(length).tolist():
                own = order[np.searchsorted(length[order], size): np.searchsorted(length[order], size, "right")]
                low, high = bounds[size], bounds[size + 1]
                at[own] = low + np.searchsorted(places[low:high, 1], number[own], "right") - 1
            _, first, sequence, copies, offset = places[at].T
            sequence_id = sequence + (number - first) // copies
            offset = offset + (number - first) % copies * length
            extra = {"sequence_id": pa.array(sequence_id), "offset": pa.array(offset)}
            yield pa.RecordBatch.from_arrays([extra[c] if c in extra else batch.column(c) for c in names], names=names)
    return run


def pack(docs: DataFrame, window: int = WINDOW, closing: int = CLOSING, files: dict | None = None,
         with_ids: bool = False, effort: int = EFFORT) -> DataFrame:
    """Pieces of all documents and their places; ``with_ids`` adds the ids
    (little-endian 32 bit), which ``sequences`` joins."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = ", ids binary" if with_ids else ""
    cut = stored(texts.mapInArrow(_cut(files or vocabulary(), window, closing, with_ids), CUT + ids), "pieces")
    per_task = stored(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    counts = np.zeros(window + 1, np.int64)
    for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``window`` rows
        counts[r["length"]] = r["n"]
    places = _places(plan(counts, window, effort))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = cut.join(base, ["part", "length"]).withColumn("number", F.col("base") + F.col("number"))
    names = [x.split()[0] for x in (PLACED + ids).split(", ")]
    return numbered.select(*[c for c in names if c not in ("sequence_id", "offset")], "number").mapInArrow(
        _place(places, names), PLACED + ids)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n, ids): the joined ids of each sequence of ``pack(..., with_ids=True)``;
    a sequence has at most ``window`` pieces."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(inside, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), joined.alias("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
