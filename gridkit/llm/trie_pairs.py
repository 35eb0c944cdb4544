"""Spelling variants by a dictionary of trie-node pairs.

1. Letter runs of whole texts are counted (partial counts before the shuffle).
2. The distinct words are numbered as paths of two tries, one of the words and
   one of the reversed words.  Words are dealt by range and sorted; a word shares
   the nodes of its longest common prefix with the word before it, and the rest of
   it are new nodes, numbered in turn.  What a range's first word shares with the
   range before is passed on by the driver: one path a range.  Numbers rise with
   the order of the words, so the node at a word's end is its id.
3. A word of L letters enters the dictionary with the pairs (prefix node, suffix
   node) around each of its L letters (``skip``) and at each of its L + 1 gaps.
   Two words that differ by one replaced letter share a skip pair; if one letter
   is inserted, a skip pair of the longer is a gap pair of the shorter.  Every
   such match is a neighbour and none is missed.  Replaced letters match at one
   place only; the longer word of an insertion is asked at the first of equal
   letters only, so that each link is found once.
4. Links are counted and their best kept per word; forms are followed by pointer
   doubling, whose length is bounded because ``n`` grows tenfold at each step.

No pair is hot: a pair spells a word but for one letter, so it holds at most as
many words as the alphabet (90) and one gap.

Edge cases: null and empty texts have no words; a null doc_id counts as an empty
one in the hashed name; rows that repeat count each; words and texts of any
length are read whole (work is linear in a word's length); ties go to the
smaller word; an empty table gives an empty result; of ``docs`` only doc_id and
text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import pieces
from .common import UPPER, discard, n_shuffle, stored, table

#: contract: runs, the hashed damage, words that count, and the ratio of a form
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
DAMAGE, LEAST_LENGTH, LEAST_COUNT, RATIO = 31, 7, 2, 10
#: a range's nodes are numbered from its place times this
RANGE = 1 << 40
PATHS = "part int, word string, n long, path array<long>"
PAIRS = "p long, s long, id long, n long, gap boolean, first boolean"


def words(docs: DataFrame) -> DataFrame:
    """(word, n) of the runs that count, one letter lost in some of them."""
    run = F.explode(F.regexp_extract_all(F.translate("text", UPPER, UPPER.lower()), F.lit(RUN), 0))
    runs = (docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), run.alias("run"))
            .where(F.length("run") >= LEAST_LENGTH))
    h, length = F.col("h"), F.length("run")
    at = F.pmod(h, length).cast("int")
    damaged = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, length))
    word = F.when(F.pmod(h, F.lit(DAMAGE)) == 0, damaged).otherwise(F.col("run"))
    return (runs.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")))
            .select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
            .where((F.col("n") >= LEAST_COUNT) & (F.length("word") >= LEAST_LENGTH)))


def _shared(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node numbers along each sorted word, from 1 in each range."""
    path, last, used = [], "", 0
    for batch in batches:
        flat, ends = [], [0]
        for word in batch.column("word").to_pylist():
            k = _shared(last, word)
            del path[k:]
            path.extend(range(used + 1, used + 1 + len(word) - k))
            used += len(word) - k
            last = word
            flat.extend(path)
            ends.append(len(flat))
        paths = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("part", "word", "n")] + [paths],
                                         names=["part", "word", "n", "path"])


def trie(found: DataFrame, ranges: int) -> DataFrame:
    """(word, n, path) with the trie nodes of every non-empty prefix of each word."""
    spark = found.sparkSession
    ordered = (found.repartitionByRange(ranges, "word").sortWithinPartitions("word")
               .select(F.spark_partition_id().alias("part"), "word", "n"))
    local = stored(ordered.mapInArrow(_number, PATHS), "trie")
    edges = (local.groupBy("part").agg(F.min("word").alias("low"), F.max("word").alias("high"))
             .orderBy("part").collect())  # two words a range
    ends = {r["part"]: r["path"] for r in local.join(
        local.groupBy("part").agg(F.max("word").alias("word")), ["part", "word"], "left_semi")
        .select("part", "path").collect()}  # one path a range
    carried, before, rows = [], "", []
    for part, low, high in edges:
        carried = carried[:_shared(before, low)]
        rows.append((part, carried))
        path = np.array(ends[part], np.int64)
        carried = [carried[x - 1] if x <= len(carried) else part * RANGE + x for x in path.tolist()]
        before = high
    carry = spark.createDataFrame(rows, "part int, carry array<long>")
    whole = F.transform("path", lambda x: F.when(x <= F.size("carry"), F.get("carry", (x - 1).cast("int")))
                        .otherwise(F.col("part") * F.lit(RANGE) + x))
    return local.join(carry, "part").select("word", "n", whole.alias("path"))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The dictionary entries of each word."""
    for batch in batches:
        letters = np.frombuffer("".join(batch.column("word").to_pylist()).encode("utf-32-le"), np.uint32)
        ahead, back = (batch.column(c).flatten().to_numpy() for c in ("ahead", "back"))
        n = batch.column("n").to_numpy()
        ends = np.concatenate([[0], np.cumsum(batch.column("ahead").value_lengths().to_numpy())]).astype(np.int64)
        for a, b in pieces(ends, 1 << 19):
            start, size = ends[a:b], np.diff(ends[a: b + 1])
            ids = ahead[start + size - 1]
            for gap in (False, True):
                rows = size + gap
                word = np.repeat(np.arange(b - a), rows)
                i = np.arange(rows.sum()) - np.repeat(np.cumsum(rows) - rows, rows)
                after = size[word] - i - (not gap)  # letters of the suffix
                p = np.where(i > 0, ahead[start[word] + np.maximum(i - 1, 0)], 0)
                s = np.where(after > 0, back[start[word] + np.maximum(after - 1, 0)], 0)
                place = start[word] + np.minimum(i, size[word] - 1)
                first = (i == 0) | (letters[place] != letters[np.maximum(place - 1, 0)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p), pa.array(s), pa.array(ids[word]), pa.array(n[a:b][word]),
                     pa.array(np.full(len(p), gap)), pa.array(first)],
                    names=["p", "s", "id", "n", "gap", "first"])


def numbered(found: DataFrame, ranges: int) -> DataFrame:
    """(word, n, ahead, back): the paths of each word in both tries."""
    ahead = trie(found, ranges).withColumnRenamed("path", "ahead")
    back = trie(found.select(F.reverse("word").alias("word"), "n"), ranges)
    return ahead.join(back.select(F.reverse("word").alias("word"), F.col("path").alias("back")), "word")


def links(dictionary: DataFrame) -> DataFrame:
    """(id, n, near, near_n): every pair of near words, both ways."""
    skip = dictionary.where(~F.col("gap")).select("p", "s", "id", "n", "first")
    other = dictionary.select("p", "s", F.col("id").alias("near"), F.col("n").alias("near_n"), "gap")
    met = skip.join(other, ["p", "s"]).where(
        (F.col("id") != F.col("near")) & (~F.col("gap") | F.col("first")))
    both = F.array(F.struct("id", "n", "near", "near_n"),
                   F.struct(F.col("near").alias("id"), F.col("near_n").alias("n"),
                            F.col("id").alias("near"), F.col("n").alias("near_n")))
    # two skips meet in both orders already
    ways = F.when(F.col("gap"), both).otherwise(F.slice(both, 1, 1))
    return met.select(F.inline(ways))


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) of the words that have a form (id, form), by pointer doubling."""
    at = forms.select("id", F.col("form").alias("root"))
    table_ = stored(at, "roots")
    while True:
        ahead = table_.select(F.col("id").alias("root"), F.col("root").alias("next"))
        step = stored(table_.join(ahead, "root", "left")
                      .select("id", F.coalesce("next", "root").alias("root"),
                              F.col("next").isNotNull().alias("moved")), "roots")
        discard(table_)
        table_ = step
        if table_.where("moved").isEmpty():
            return table_.select("id", "root")


def variants(docs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of ``docs``."""
    found = stored(words(docs), "words")
    paths = stored(numbered(found, n_shuffle(docs.sparkSession)), "paths")
    discard(found)
    dictionary = paths.mapInArrow(_pairs, PAIRS)
    best = F.max(F.struct("near_n", (-F.col("near")).alias("least")))
    near = stored(links(dictionary).groupBy("id", "n").agg(F.count("*").alias("n_near"), best.alias("best")),
                  "near")
    is_form = F.col("best.near_n") >= ratio * F.col("n")
    forms = near.where(is_form).select("id", (-F.col("best.least")).alias("form"), F.col("best.near_n").alias("form_n"))
    ids = paths.select(F.element_at("ahead", -1).alias("id"), "word", "n")
    names = ids.select("id", "word")
    end = roots(forms)
    named = (forms.join(end, "id")
             .join(names.withColumnsRenamed({"id": "form", "word": "form_word"}), "form")
             .join(names.withColumnsRenamed({"id": "root", "word": "root_word"}), "root")
             .select("id", "form_word", "form_n", "root_word"))
    return (ids.join(near.select("id", "n_near"), "id", "left").join(named, "id", "left")
            .select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                    F.col("form_word").alias("form"), "form_n",
                    F.coalesce("root_word", "word").alias("root")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


def oracle(steps: int = 10) -> str:
    """The same in plain SQL: CRC-32 byte by byte, neighbours by words with a hole, and
    chains of at most ``steps`` forms (``n`` grows tenfold at each)."""
    step = "CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    # the remainders of the 256 byte values, eight steps each
    tables = ["t0 AS (SELECT i, CAST(i AS BIGINT) AS x FROM range(256) AS r(i))"]
    tables += [f"t{k + 1} AS (SELECT i, {step} AS x FROM t{k})" for k in range(8)]
    ends = ", ".join(f"f{k}.form" for k in range(steps, 0, -1))
    chain = "\n".join(f"LEFT JOIN forms f{k} ON f{k}.word = f{k - 1 if k > 1 else ''}.form"
                      for k in range(1, steps + 1))
    return f"""WITH {', '.join(tables)},
crc AS (SELECT list(x ORDER BY i) AS t FROM t8),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'),
                                                 '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL),
bytes AS (
  SELECT run, n, flatten(list_transform(string_split(doc || ':' || run, ''), lambda c:
           CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)]
                ELSE [CAST(192 + (unicode(c) >> 6) AS BIGINT), CAST(128 + (unicode(c) & 63) AS BIGINT)] END)) AS b
  FROM runs),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b),
           lambda a, x: xor(a >> 8, crc.t[(xor(a, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, n
    FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
holes AS (
  SELECT word, n, i, word[: i] AS a, word[i + 2 :] AS b
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT x.word, x.n, y.word AS near, y.n AS near_n
  FROM holes x JOIN holes y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, x.n, w.word, w.n FROM holes x JOIN words w ON w.word = x.a || x.b
  UNION SELECT w.word, w.n, x.word, x.n FROM holes x JOIN words w ON w.word = x.a || x.b),
best AS (
  SELECT word, count(*) AS n_near,
         first(near ORDER BY near_n DESC, near) AS form, max(near_n) AS form_n, any_value(n) AS n
  FROM near GROUP BY word),
forms AS (SELECT word, form, form_n FROM best WHERE form_n >= 10 * n)
SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, f.form, f.form_n,
       coalesce({ends}, f.form, w.word) AS root
FROM words w LEFT JOIN best b USING (word) LEFT JOIN forms f USING (word)
{chain}"""


ORACLE = oracle()
