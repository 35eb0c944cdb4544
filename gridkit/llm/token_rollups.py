"""Token counts as delta-maintained rollups.

A ledger of signed changes by document.  ``commit`` turns a batch of requests (upserts
with a new count, deletes) into deltas against what the ledger holds: an insert adds
(+1 document, +n tokens), a delete takes both back, a revised count does both, under the
source, language and tokenizer version that each count belongs to.  The deltas of a
batch are aggregated before they are written, and totals are sums of deltas.

The ledger is a versioned table in buckets by hash of doc_id.  A commit reads the
buckets that its documents fall into and appends to them; a bucket of more than ``FAN``
appended folders is netted into one, so what is read follows the documents that stand
in the touched buckets and not the number of commits.  Deltas are netted the same way.

Commits are idempotent: both tables skip a batch id that they hold.  The deltas are
published first and the changes last, so a commit cut off between the two is computed
again from the same state when its batch is sent again, and counted once.

Edge cases: null texts count 0 tokens; texts of any length are counted whole; null
source and language are groups of their own; of several requests for a document in a
batch the last by ``seq`` counts, ties go to the larger count; deletes of unknown
documents do nothing; a null doc_id is an id like any other; groups whose documents have
all gone are left out; an empty table gives an empty result; only doc_id, text, source
and lang are read, so other columns may have any name.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.versioned import VersionedTable
from .arrays import flat
from .common import ID_BOUND, discard, only, stored, table
from .tokens import encoder as encoder_of, vocabulary

GROUP = ["source", "lang", "tokenizer"]
STATE = ["doc_id", *GROUP, "tokens"]
#: buckets of a new ledger, and commits to a bucket before it is netted
BUCKETS, FAN = 16, 8


def _count(files: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(files)
        for batch in batches:
            offsets, data = flat(batch.column(1))
            n = [len(encoder.ids(data[a:b].tobytes())) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), *batch.columns[2:]],
                names=["doc_id", "tokens", *batch.schema.names[2:]])
    return run


def count_tokens(docs: DataFrame, version: str, files: dict | None = None) -> DataFrame:
    """(doc_id, tokens, source, lang, tokenizer) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang")
    return rows.mapInArrow(_count(files or vocabulary()), "doc_id long, tokens long, source string, lang string"
                           ).withColumn("tokenizer", F.lit(version))


def count_words(docs: DataFrame, version: str = "words-1") -> DataFrame:
    """The same by a tokenizer that cuts at white space, without Python."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("tokens"), "source", "lang",
                       F.lit(version).alias("tokenizer"))


class Ledger:
    """Signed changes by document in buckets, and their sums by group."""

    _CHANGES = "doc_id long, source string, lang string, tokenizer string, tokens long, sign int, bucket int"
    _DELTAS = "source string, lang string, tokenizer string, documents long, tokens long"

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS):
        self.spark = spark
        self.path = path or scratch_path(spark, f"llm-ledger-{uuid.uuid4().hex}")
        self.changes = VersionedTable(spark, f"{self.path}/changes")
        self.deltas = VersionedTable(spark, f"{self.path}/deltas")
        if not self.changes.versions():  # the number of buckets is the table's for good
            empty = spark.createDataFrame([], self._CHANGES)
            self.changes.commit(empty, partition_by=["bucket"], note={"buckets": buckets})
        self.buckets = self.changes.manifest().note["buckets"]

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int")

    @staticmethod
    def _net(changes: DataFrame) -> DataFrame:
        """One row per count that stands; a row that repeats stands as often."""
        net = changes.groupBy(*STATE, "bucket").agg(F.sum("sign").cast("int").alias("sign"))
        return net.where("sign <> 0")

    def state(self, buckets: list[int] | None = None) -> DataFrame:
        """The counts that stand (in some of the buckets): changes that were not taken back."""
        rows = self.changes.read()
        rows = rows if buckets is None else rows.where(F.col("bucket").isin(buckets))
        return self._net(rows).where("sign > 0").select(*STATE)

    def commit(self, batch: str, requests: DataFrame) -> bool:
        """``requests``: doc_id, op ('put' or 'delete'), seq, tokens, source, lang,
        tokenizer.  False if the batch had been committed before."""
        if self.changes.committed(batch):
            return False
        rank = F.struct(F.col("seq"), F.coalesce("tokens", F.lit(-1)).alias("tokens"), F.col("op"),
                        *[F.col(c) for c in GROUP])
        last = (requests.select("doc_id", rank.alias("r")).groupBy("doc_id").agg(F.max("r").alias("r"))
                .select("doc_id", "r.op", "r.tokens", *[f"r.{c}" for c in GROUP]))
        last = stored(last, "requests")
        put = last.where("op = 'put'").select(*STATE, F.lit(1).alias("sign"))
        held = {int(p.split("=")[1]) for p in self.changes.manifest().parts}
        touched = [r["bucket"] for r in last.select(self._bucket().alias("bucket")).distinct().collect()]
        if held & set(touched):
            ids = last.select(F.col("doc_id").alias("id"))
            old = self.state(sorted(held & set(touched)))
            old = old.join(ids, old["doc_id"].eqNullSafe(ids["id"]), "left_semi")
            put = put.unionByName(old.select(*STATE, F.lit(-1).alias("sign")))
        put = stored(put.withColumn("bucket", self._bucket()), "changes")
        deltas = put.groupBy(*GROUP).agg(F.sum("sign").cast("long").alias("documents"),
                                         F.sum(F.col("sign") * F.col("tokens")).alias("tokens"))
        self.deltas.commit(deltas.coalesce(1), "append", batch=batch)
        self.changes.commit(put, "append", batch=batch)
        discard(last, put)
        self._compact()
        return True

    def _compact(self) -> None:
        """Net the buckets, and the deltas, that more than ``FAN`` commits wrote to."""
        full = [p for p, folders in self.changes.manifest().parts.items() if len(folders) > FAN]
        if full:
            rows = self.changes.read().where(F.col("bucket").isin([int(p.split("=")[1]) for p in full]))
            self.changes.commit(self._net(rows), "partitions", replace=full)
        if len(self.deltas.manifest().parts.get("", [])) > FAN:
            self.deltas.commit(self._sums().coalesce(1))

    def _sums(self) -> DataFrame:
        return self.deltas.read().groupBy(*GROUP).agg(F.sum("documents").alias("documents"),
                                                      F.sum("tokens").alias("tokens"))

    def totals(self) -> DataFrame:
        """documents and tokens by source, language and tokenizer version."""
        if not self.deltas.versions():
            return self.spark.createDataFrame([], self._DELTAS)
        return self._sums().where("documents > 0")


def requests(counts: DataFrame, op: str = "put", seq: int = 0) -> DataFrame:
    return counts.select("doc_id", F.lit(op).alias("op"), F.lit(seq).alias("seq"), "tokens", *GROUP)


def maintain(docs: DataFrame, labels: DataFrame, ledger: Ledger) -> DataFrame:
    """Three batches over whole tables: all documents come in; those labelled
    low quality go; toxic ones are recounted under another tokenizer version.
    The second batch is sent twice."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic")
    ledger.commit("load", requests(count_tokens(docs, "byte_bpe_50k")))
    low = ids.where("quality = 0").select("doc_id").distinct()
    none = F.lit(None)
    gone = low.select("doc_id", F.lit("delete").alias("op"), F.lit(0).alias("seq"),
                      none.cast("long").alias("tokens"), *[none.cast("string").alias(c) for c in GROUP])
    ledger.commit("remove-low", gone)
    ledger.commit("remove-low", gone)
    again = ids.where("toxic = 1 and quality <> 0").select("doc_id").distinct()
    # a bounded list picks the texts before they are counted; a longer one the
    # counts afterwards, so that texts are never shuffled
    few = again.count() <= ID_BOUND
    toxic = count_words(only(docs, again)) if few else only(stored(count_words(docs), "words"), again)
    ledger.commit("recount-toxic", requests(toxic))
    return ledger.totals()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Ledger(spark))
