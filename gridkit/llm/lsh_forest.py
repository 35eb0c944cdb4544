"""Near duplicates by a MinHash LSH forest.

A text's set is its distinct five-word shingles.  Texts with equal sets are one
class; one representative goes on.  Its signature has ``STEP * TREES`` values and is
read in ``TREES`` orders, tree t from value ``STEP * t`` on and round to its start: a
tree is the prefix tree of these paths, and its leaves in order are the sorted paths.
Texts whose paths share the first ``STEP`` values are a region.

Candidates are neighbours in a sorted order: of all paths, those before and after
share the longest prefixes with a path.  Depth so follows from the region: neighbours
in a thin region part soon after ``STEP`` values, those in a crowded one only at the
depth that tells them apart, up to the whole signature.  A path is the neighbour of
two, so candidates are linear in the members, whatever the size of a group.  The
orders are range-sorted; the ends of ranges meet on the driver.  The first ``EARLY``
orders are confirmed at once, and of the others only neighbours that no chain of
links holds together by then.

Candidates are confirmed on full sets.  Regions that are not of one component by then
are measured against their first member.  A region is settled when its members
outside the first one's component are of one component and too far from the first
for a link to any member of its component in the region, also to one that only a
chain of links holds there (by the triangle inequality of the Jaccard distance and
the measured distances of all members to the first).  All texts of unsettled regions
then go through an exact prefix-filter join: with shingles ordered by rarity among
them, two texts of n_x >= n_y shingles and similarity t share one of the first
n_x - ceil(t n_x) + 1 of x and the first n_y - ceil(2t / (1 + t) n_y) + 1 of y, and
from it on either has enough left.  Texts of one component are never paired: at each
shingle, its largest component meets the others only.

So the two texts of every linked pair that shares a region end in one component,
whatever the size of the region: the trees find a pair of similarity s with
probability 1 - (1 - s**STEP)**TREES, 0.9999 at s = 0.75.

Edge cases: texts without words have an empty set, no links and themselves as
component; a text of fewer than five words is one shingle; rows that repeat a
doc_id are one node; a null doc_id joins its class but never names a component; of a
component the smallest doc_id names it; very long texts give all their shingles; only
doc_id and text are read, so other columns may have any name; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import U, Powers, Words, flat, mix, pieces, shingles
from .common import HEAVY, discard, join_counted, only, same, stored, table, union_all
from .components import components

WORDS, THRESHOLD = 5, 75
STEP, TREES = 4, 24
#: bytes of a value in a path (the low half of a MinHash value)
WIDTH = 2
#: orders whose neighbours are confirmed first
EARLY = 4

_SIGNS = "doc_id long, n_shingles long, set_a long, set_b long, path binary"


def _signature(values: np.ndarray, mult: np.ndarray, add: np.ndarray) -> np.ndarray:
    """MinHash under len(mult) hash functions, a block of shingles at a time."""
    low = (values >> U(32)).astype(np.uint32)
    best = np.full(len(mult), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 4096):
        part = low[i: i + 4096]
        np.minimum(best, (mult[:, None] * part[None, :] + add[:, None]).min(axis=1), out=best)
    return best


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rng = np.random.default_rng(20240229)
    n = STEP * TREES
    mult = rng.integers(1, 1 << 32, n, dtype=np.uint32) | np.uint32(1)
    add = rng.integers(0, 1 << 32, n, dtype=np.uint32)
    powers = Powers()
    for batch in batches:
        offsets, data = flat(batch.column(1))
        for a, b in pieces(offsets):
            words = Words(offsets[a: b + 1] - offsets[a], data[offsets[a]: offsets[b]], powers)
            counts, one, two, paths = [], [], [], []
            for s in shingles(words, WORDS):
                counts.append(len(s))
                one.append(int(mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U).view(np.int64)))
                two.append(int(mix(s + U(0x14057B7EF767814F)).sum(dtype=U).view(np.int64)))
                low = _signature(s, mult, add) if len(s) else np.zeros(0, np.uint32)
                paths.append((low ^ (low >> np.uint32(16))).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array(counts, pa.int64()),
                 pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(paths, pa.binary())],
                names=["doc_id", "n_shingles", "set_a", "set_b", "path"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for batch in batches:
        offsets, data = flat(batch.column(1))
        for a, b in pieces(offsets):
            words = Words(offsets[a: b + 1] - offsets[a], data[offsets[a]: offsets[b]], powers)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a).cast(pa.int64()),
                 pa.array([s.tobytes() for s in shingles(words, WORDS)], pa.binary())],
                names=["doc_id", "members"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shared, union = [], []
        for x, y in zip(batch.column("x"), batch.column("y")):
            x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            k = int((both[1:] == both[:-1]).sum())
            shared.append(k)
            union.append(len(both) - k)
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array(shared, pa.int64()),
             pa.array(union, pa.int64())], names=["a", "b", "shared", "joint"])


def classes_of(docs: DataFrame) -> DataFrame:
    """One row per document: size and hash of its set, and its signature."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(texts.mapInArrow(_sign, _SIGNS), "signatures")


def paths_of(signs: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc, path) of each representative: its signature, the path in the first tree."""
    reps = classes.where("rep is not null").select("set_a", "set_b", "n_shingles", F.col("rep").alias("doc_id"))
    return (signs.join(reps, ["doc_id", "set_a", "set_b", "n_shingles"], "left_semi")
            .select(F.col("doc_id").alias("doc"), "path"))


def regions_of(paths: DataFrame) -> DataFrame:
    """(region, tree, doc, n, first): texts whose paths in a tree share the first ``STEP``
    values, of regions of two and more; ``first`` is the least of a region."""
    start = lambda t: F.substr(F.col("path"), F.lit(t * STEP * WIDTH + 1), F.lit(STEP * WIDTH))
    keys = F.array(*(F.xxhash64(F.lit(t), start(t)) for t in range(TREES)))
    members = paths.select("doc", keys.alias("keys")).select("doc", F.posexplode("keys").alias("tree", "region"))
    shared = (members.groupBy("region").agg(F.count("*").alias("n"), F.min("doc").alias("first"))
              .where("n > 1"))
    return members.join(shared, "region").select("region", "tree", "doc", "n", "first")


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Values that each row of x and of y have in common from the start."""
    differ = np.concatenate([x != y, np.ones((len(x), 1), bool)], axis=1)
    return differ.argmax(axis=1)


def _adjacent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours (a, b) of a sorted range; its first and its last row with their paths."""
    part = TaskContext.get().partitionId()
    last = None

    def out(tree, a, b, depth, parts, path):
        return pa.RecordBatch.from_arrays(
            [pa.array(tree, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
             pa.array(depth, pa.int32()), pa.array(parts, pa.int32()), pa.array(path, pa.binary())],
            names=["tree", "a", "b", "depth", "part", "path"])

    for batch in batches:
        if not batch.num_rows:
            continue
        tree, doc = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        path = flat(batch.column(1))[1].reshape(len(doc), -1).view(np.uint16)
        if last is None:
            yield out(tree[:1], [None], doc[:1], [0], [part], [path[0].tobytes()])
        else:
            tree, doc, path = (np.concatenate([x, y]) for x, y in zip(last, (tree, doc, path)))
        depth = _common(path[:-1], path[1:])
        near = np.flatnonzero((depth >= STEP) & (tree[:-1] == tree[1:]) & (doc[:-1] != doc[1:]))
        yield out(tree[near], doc[near], doc[near + 1], depth[near], [None] * len(near), [None] * len(near))
        last = tree[-1:], doc[-1:], path[-1:]
    if last is not None:
        yield out(last[0], last[1], [None], [0], [part], [last[2][0].tobytes()])


def _ends(edges: list) -> list[tuple]:
    """Neighbours across ranges: the last row of each and the first of the next."""
    spans = {}
    for r in edges:
        spans.setdefault(r["part"], {})["last" if r["b"] is None else "first"] = r
    order = sorted(spans.values(), key=lambda x: (x["first"]["tree"], bytes(x["first"]["path"]), x["first"]["b"]))
    met = []
    for x, y in zip(order, order[1:]):
        x, y = x["last"], y["first"]
        one, two = (np.frombuffer(bytes(r["path"]), np.uint16)[None] for r in (x, y))
        depth = int(_common(one, two)[0])
        if x["tree"] == y["tree"] and depth >= STEP and x["a"] != y["b"]:
            met.append((x["tree"], x["a"], y["b"], depth))
    return met


def members_of(regions: DataFrame) -> DataFrame:
    """(doc, trees): one row per text of any region; bit t of ``trees`` is set where
    its region in tree t has more than two texts."""
    return regions.groupBy("doc").agg(F.expr("bit_or(if(n > 2, shiftleft(1L, tree), 0L))").alias("trees"))


def neighbours(paths: DataFrame, regions: DataFrame, members: DataFrame) -> DataFrame:
    """(tree, a, b, depth), a < b: neighbours in the sorted order of each tree that share
    at least ``STEP`` values, and how many they share (two alone in a region are
    neighbours without a sort; their depth is not read)."""
    stride = STEP * WIDTH
    turned = F.expr(f"concat(substring(path, tree * {stride} + 1), substring(path, 1, tree * {stride}))")
    leaves = (members.where("trees <> 0").join(paths, "doc")
              .withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))))
              .where("shiftright(trees, tree) & 1 = 1").select("tree", turned.alias("path"), "doc"))
    met = stored(leaves.repartitionByRange("tree", "path", "doc").sortWithinPartitions("tree", "path", "doc")
                 .mapInArrow(_adjacent, "tree int, a long, b long, depth int, part int, path binary"), "sorted")
    edges = met.where("part is not null").collect()  # two rows a range
    kinds = "tree int, a long, b long, depth int"
    across = paths.sparkSession.createDataFrame(_ends(edges), kinds)
    alone = (regions.where("n = 2 and doc <> first")
             .select("tree", F.col("first").alias("a"), F.col("doc").alias("b"), F.lit(STEP).alias("depth")))
    every = met.where("part is null").select("tree", "a", "b", "depth").unionByName(across).unionByName(alone)
    return every.select("tree", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "depth")


def _component_of(df: DataFrame, comp: DataFrame, node: str, name: str) -> DataFrame:
    """With column ``name``: the component of ``node``, itself where it has no link."""
    own = comp.select(F.col("node").alias(node), F.col("component").alias(name))
    return df.join(own, node, "left").withColumn(name, F.coalesce(name, node))


def mixed(regions: DataFrame, comp: DataFrame) -> DataFrame:
    """(region, doc, first) of regions that are not of one component."""
    placed = _component_of(regions.select("region", "doc", "first"), comp, "doc", "component")
    several = (placed.groupBy("region").agg(F.min("component").alias("low"), F.max("component").alias("high"))
               .where("low < high").select("region"))
    return placed.join(several, "region", "left_semi").select("region", "doc", "first")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, members): the full shingle sets of the wanted documents, stored."""
    return stored(only(docs, wanted).mapInArrow(_sets, "doc_id long, members binary"), "sets")


def confirm(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Sizes of intersection and union on full sets, for distinct pairs (a < b)."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("members").alias("x"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("members").alias("y"))
    return stored(pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")
                  .mapInArrow(_compare, "a long, b long, shared long, joint long"), "compared")


def unsettled(regions: DataFrame, done: DataFrame, comp: DataFrame) -> DataFrame:
    """(doc, component) of the texts in regions that the first comparison leaves open."""
    own = comp.select(F.col("node").alias("doc"), "component")
    lead = comp.select(F.col("node").alias("first"), F.col("component").alias("lead"))
    far = done.select("a", "b", (1 - F.col("shared") / F.col("joint")).alias("far"))
    far = far.select(F.col("a").alias("first"), F.col("b").alias("doc"), "far")  # the first is the least
    placed = (regions.join(own, "doc", "left").join(lead, "first", "left").join(far, ["first", "doc"], "left")
              .withColumn("component", F.coalesce("component", "doc"))
              .withColumn("lead", F.coalesce("lead", "first")))
    away = F.col("component") != F.col("lead")
    # a link to a near member is no longer than 1 - THRESHOLD, so the first is no
    # farther from its other end than that and the near member's own distance
    reach = 1 - THRESHOLD / 100 + 1e-9
    state = placed.groupBy("region").agg(
        F.min(F.when(away, F.col("component"))).alias("low"), F.max(F.when(away, F.col("component"))).alias("high"),
        F.min(F.when(away, F.col("far"))).alias("mid"),
        F.max(F.when(~away & (F.col("doc") != F.col("first")), F.col("far"))).alias("near"))
    opened = state.where((F.col("low") < F.col("high")) | (F.col("mid") <= F.col("near") + reach)).select("region")
    return placed.join(opened, "region", "left_semi").select("doc", "component").distinct()


def _all_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for members in batch.column(0):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(members.as_buffer(), np.int64))],
                                             names=["shingle"])


def _prefix_parts(heavy: np.ndarray, light: bool):
    """Members of a text that are not heavy; or the heavy ones that its prefix
    needs, with their rank: heavy ones come last, in the order of their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, component, members in zip(*(batch.column(i) for i in range(3))):
                s = np.frombuffer(members.as_buffer(), np.int64)
                common = np.isin(s, heavy)
                n, few = len(s), int((~common).sum())
                need = n - -(-n * THRESHOLD // 100) + 1 - few
                part = s[~common] if light else np.sort(s[common])[:max(0, need)]
                columns = [np.full(len(part), doc.as_py()), np.full(len(part), component.as_py()),
                           np.full(len(part), n), part]
                if not light:
                    columns.append(few + 1 + np.arange(len(part)))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                                 names=["doc", "component", "size", "shingle", "rank"][:len(columns)])
    return run


def prefix_candidates(sets: DataFrame, opened: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts in different components that can reach the threshold.

    Shingles are ordered by rarity among these texts.  The heavy ones (at most
    ``HEAVY``) need no count: they rank behind all others by their hash, and a text
    adds those that its prefix still needs; these meet in the join like any other.
    """
    named = stored(sets.join(opened.withColumnRenamed("doc", "doc_id"), "doc_id")
                   .select("doc_id", "component", "members"), "open-sets")
    df = stored(named.select("members").mapInArrow(_all_members, "shingle long")
                .groupBy("shingle").agg(F.count("*").alias("df")), "df")
    total = df.agg(F.sum("df")).first()[0] or 0
    least = max(2, total // HEAVY)
    heavy = np.array([r["shingle"] for r in df.where(F.col("df") >= least).collect()], np.int64)
    kinds = "doc long, component long, size long, shingle long"
    rank = F.row_number().over(Window.partitionBy("doc").orderBy("df", "shingle"))
    light = (named.mapInArrow(_prefix_parts(heavy, True), kinds)
             .join(df.where(F.col("df") < least), "shingle").withColumn("rank", rank.cast("long"))
             .where("df > 1").drop("df"))
    common = named.mapInArrow(_prefix_parts(heavy, False), kinds + ", rank long")
    t = THRESHOLD
    probe = F.col("size") - F.ceil(F.col("size") * t / 100) + 1
    index = F.col("size") - F.ceil(F.col("size") * (2 * t) / (100 + t)) + 1
    parts = stored(light.unionByName(common).where(F.col("rank") <= probe)
                   .withColumn("indexed", F.col("rank") <= index), "prefixes")
    held = parts.groupBy("shingle", "component").agg(F.count("*").alias("n"))
    tops = (held.groupBy("shingle").agg(F.max_by("component", F.struct("n", "component")).alias("top"),
                                        F.count("*").alias("kinds")).where("kinds > 1").drop("kinds"))
    parts = stored(parts.join(tops, "shingle"), "prefixes")
    minor = F.col("component") != F.col("top")
    x = lambda df: df.select("shingle", F.col("doc").alias("x"), F.col("component").alias("cx"),
                             F.col("size").alias("nx"), F.col("rank").alias("ix"))
    y = lambda df: df.where("indexed").select("shingle", F.col("doc").alias("y"),
                                              F.col("component").alias("cy"), F.col("size").alias("ny"),
                                              F.col("rank").alias("iy"))
    # at the first shingle that two texts share, no more can follow than either has left
    fits = (f"cx <> cy and nx >= ny and ny * 100 >= nx * {t} and "
            f"(least(nx - ix, ny - iy) + 1) * {100 + t} >= {t} * (nx + ny)")
    found = (x(parts).join(y(parts.where(minor)), "shingle").where(fits)
             .unionByName(x(parts.where(minor)).join(y(parts.where(~minor)), "shingle").where(fits)))
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def link(docs: DataFrame, signs: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, component) of all representatives that have a link."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    paths = paths_of(signs, classes)
    if not signs.groupBy("doc_id").count().where("count > 1").isEmpty():
        docs, paths = docs.dropDuplicates(["doc_id"]), paths.distinct()  # rows of one id are one node
    paths = stored(paths, "paths")
    regions = stored(regions_of(paths), "regions")
    members = stored(members_of(regions), "members")
    sets = sets_of(docs, members.select(F.col("doc").alias("doc_id")))
    comp = _settle(sets, neighbours(paths, regions, members), regions)
    discard(sets)
    return comp


def _settle(sets: DataFrame, near: DataFrame, regions: DataFrame) -> DataFrame:
    """(node, component): neighbours first, then the first members of mixed regions,
    then the exact join of what is open."""
    early = near.where(F.col("tree") < EARLY).select("a", "b").distinct()
    done = confirm(sets, early)
    comp = stored(components(_linked(done)), "near-comp")
    late = near.where(F.col("tree") >= EARLY).select("a", "b").distinct()
    late = _component_of(_component_of(late, comp, "a", "ca"), comp, "b", "cb").where("ca <> cb").select("a", "b")
    regions = stored(mixed(regions, comp), "regions")
    leads = regions.where("doc <> first").select(F.col("first").alias("a"), F.col("doc").alias("b"))
    more = stored(late.unionByName(leads).distinct().join(done, ["a", "b"], "left_anti"), "pairs")
    if more.isEmpty():
        return comp
    done = done.unionByName(confirm(sets, more))
    links = _linked(done)
    comp = stored(components(links), "near-comp")
    opened = stored(unsettled(regions, done, comp), "unsettled")
    if opened.isEmpty():
        return comp
    more = stored(prefix_candidates(sets, opened).join(done.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    if more.isEmpty():
        return comp
    return stored(components(links.unionByName(_linked(confirm(sets, more)))), "near-comp")


def _linked(compared: DataFrame) -> DataFrame:
    near = compared.where(F.col("shared") * 100 >= F.col("joint") * THRESHOLD)
    return near.select(F.col("a").alias("u"), F.col("b").alias("v"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    signs = classes_of(docs)
    ids = ["set_a", "set_b", "n_shingles"]
    classes = stored(signs.where("n_shingles > 0").groupBy(*ids)
                     .agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes")
    comp = link(docs, signs, classes)
    named = stored(classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left")
                   .select(*ids, "n", F.coalesce("component", "rep").alias("component")), "classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    filled = signs.where("n_shingles > 0").select("doc_id", *ids)
    bare = signs.where("n_shingles = 0").select("doc_id", *ids).withColumn(
        "component", F.lit(None).cast("long"))
    out = join_counted(filled, named, ids, "n", total).drop("n").unionByName(bare)
    out = out.withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id",
                      same(F.col("doc_id"), F.col("component_id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
