"""Sinks: table writes, CTAS, temp views, column comments, JSON extracts,
and the markdown-corpus reader.

Paths for intermediate tables come from ``session.scratch_path`` (the
shared ``spark.checkpoint.dir``), never a machine-local folder.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import Files
from .versioned import VersionedTable


def write_table(df: DataFrame, path: str, mode: str = "overwrite",
                partition_by: Sequence[str] = (), batch: str | None = None) -> int:
    """s02 / s03: overwrite (schema replaced), append, or swap partitions of the
    versioned table at ``path``; returns its version.  Readers of ``read_table`` see the
    version before until the new one is whole, and a ``batch`` sent again is skipped."""
    return VersionedTable(df.sparkSession, path).commit(df, mode, partition_by, batch)


def read_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The last (or the named) version of a table written by ``write_table``."""
    return VersionedTable(spark, path).read(version)


def create_table_as(spark: SparkSession, df: DataFrame, path: str,
                    partition_by: Sequence[str] = ()) -> DataFrame:
    """s04: create-or-replace a materialised table and return a scan of it.

    Writing cuts the lineage: downstream plans start at the parquet scan
    (with partition pruning on ``partition_by``), and a lost executor only
    re-reads files instead of recomputing the whole upstream job.  Rows are
    clustered by ``partition_by`` first, so a day is a few files and not one
    from every task; the rebalance splits days that are larger than a task.
    """
    write_table(df, path, "overwrite", partition_by)
    return read_table(spark, path)


def register_views(tables, names: Sequence[str]) -> None:
    """s05: expose logical tables as session temp views for ``spark.sql``."""
    for n in names:
        tables[n].createOrReplaceTempView(n)


def sql_quote(text: str) -> str:
    """f15: escape a string for a single-quoted SQL literal."""
    return text.replace("'", "''")


def with_comments(df: DataFrame, comments: dict[str, str]) -> DataFrame:
    """s06: attach column comments as column metadata (kept by table writes
    and shown by ``DESCRIBE``)."""
    return df.select(*[F.col(c).alias(c, metadata={"comment": comments[c]})
                       if c in comments else F.col(c) for c in df.columns])


def comment_table_sql(table: str, comment: str, columns: dict[str, str]) -> list[str]:
    """s06: DDL statements commenting a catalog table and its columns."""
    out = [f"COMMENT ON TABLE {table} IS '{sql_quote(comment)}'"]
    out += [f"ALTER TABLE {table} ALTER COLUMN {c} COMMENT '{sql_quote(t)}'"
            for c, t in columns.items()]
    return out


def comment_table(spark: SparkSession, table: str, comment: str, columns: dict[str, str]) -> DataFrame:
    """s06: comment a catalog table and its columns, and read the comments back
    as ``(col_name, comment)`` (the table's own under its name)."""
    for ddl in comment_table_sql(table, comment, columns):
        spark.sql(ddl)
    said = spark.sql(f"DESCRIBE TABLE EXTENDED {table}")
    own = said.filter(F.col("col_name") == "Comment").select(F.lit(table).alias("col_name"),
                                                             F.col("data_type").alias("comment"))
    cols = said.filter(F.col("col_name").isin(*columns) & F.col("comment").isNotNull())
    return own.unionByName(cols.select("col_name", "comment"))


def write_json_extract(df: DataFrame, path: str) -> None:
    """s07: result set -> JSON lines with ISO dates and timestamps."""
    (df.write.mode("overwrite")
       .option("dateFormat", "yyyy-MM-dd")
       .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss")
       .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss")
       .json(path))


#: files of more bytes are read in parts
LARGE_FILE = 64 << 20
#: endings of files that Spark's text reader unpacks
PACKED = {"gz", "bz2", "deflate", "lz4", "snappy", "zst", "zstd", "xz", "passthrough"}
#: characters that a folder ``column=value`` of Spark holds as %XX, and its value for null
_ESCAPED = re.compile(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""")
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def _files(directory: str):
    """A task's rows as files of a folder, which gets its name when it is whole: of
    attempts at one task the first counts, and readers see none of the others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draft, rows = f"{directory}/.{uuid.uuid4().hex}", 0
        for batch in batches:
            if batch.num_rows:
                os.makedirs(draft, exist_ok=True)
            for name, text in zip(*(c.to_pylist() for c in batch.columns)):
                name = _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", name)
                with open(f"{draft}/doc_id={name}.txt", "ab") as f:
                    f.write(text + b"\n")
            rows += batch.num_rows
        if rows:
            whole = f"{directory}/task={TaskContext.get().partitionId()}"
            try:
                os.rename(draft, whole)
            except OSError:
                if not os.path.isdir(whole):
                    raise
                shutil.rmtree(draft, ignore_errors=True)
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], names=["rows"])
    return run


def write_corpus(docs: DataFrame, directory: str, tasks: int) -> None:
    """s09: the texts of ``(doc_id, text)`` as files in a new ``directory``, which
    ``read_corpus`` reads with ``CORPUS_FILES`` and ``CORPUS_NAME``.

    An id is one file in the folder of a task; of its rows each ends with a line feed.
    Where the store is a file system of the machines, tasks write the files themselves:
    Spark's writer makes a folder and starts two processes for each.
    """
    files = Files(docs.sparkSession)
    dealt = docs.repartition(tasks, "doc_id")
    folder = files.local(directory)
    if folder is None:
        dealt.select(F.spark_partition_id().alias("task"), "doc_id", "text").write.partitionBy("task", "doc_id").text(directory)
        return
    if not files.make(directory):
        raise FileExistsError(directory)
    name = F.coalesce(F.nullif(F.col("doc_id").cast("string"), F.lit("")), F.lit(_NO_VALUE))
    written = dealt.select(name, F.col("text").cast("binary")).mapInArrow(_files(folder), "rows long")
    written.agg(F.sum("rows")).collect()


CORPUS_FILES = "*.txt"
#: a document is a file, or the folder of one
CORPUS_NAME = r"doc_id=([^/]+?)(?:\.txt|/[^/]+)$"


def _parts(limit: int):
    """Consecutive lines of a stretch of a file joined to parts of about ``limit`` characters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size, number = None, [], 0, 0

        def part():
            return pa.RecordBatch.from_arrays(
                [pa.array([at[0]]), pa.array([at[1]]), pa.array([number]), pa.array(["\n".join(held)])],
                names=["path", "block", "number", "text"])

        for batch in batches:
            for path, block, line in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (path, block) or (held and size + len(line) > limit):
                    if held:
                        yield part()
                    number = number + 1 if at == (path, block) else 0
                    at, held, size = (path, block), [], 0
                held.append(line)
                size += len(line) + 1
        if held:
            yield part()
    return run


def read_corpus(spark: SparkSession, directory: str, pattern: str = "*.md", large: int = LARGE_FILE,
                name: str = r"([^/]+?)(\.[^./]+)?$", tasks: int | None = None) -> DataFrame:
    """s09: ``(doc_id, part, text, cut)`` of the files in ``directory``; doc_id is what
    ``name`` finds in the path (by default the file's stem).

    A file is one row, part 0.  One of more than ``large`` bytes does not become one row:
    it is read by lines, in as many tasks as it has blocks, and given back in parts of
    about ``large`` characters (``cut``); joined by line feeds in the order of ``part``
    they are the file, without a last line feed.  A single longer line is one part.
    A file of no bytes has no row.  By default Spark gives a task 128 MB, counting a file
    as 4 MB at least; with ``tasks``, both kinds of files are read in so many at most.
    """
    files = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    where, size = F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size")
    ending = re.search(r"\.(\w+)$", pattern)
    if ending and ending[1] not in PACKED:
        # the text reader copies the configuration for each file, tasks of one executor in turn
        few, text = files.format("binaryFile").load(directory), F.col("content").cast("string")
    else:
        few, text = files.text(directory, wholetext=True), F.col("value")
    whole = few.where(size <= large).select(where, F.lit(0).alias("part"), text.alias("text"), F.lit(False).alias("cut"))
    # a second listing of all files would hold them on the driver twice
    index = files.format("binaryFile").load(directory) if ending is None or ending[1] in PACKED else few
    long = [re.sub(r"([*?\[\]{}\\])", r"\\\1", r.path) for r in index.where(size > large).select("path").collect()]
    doc = F.regexp_extract(F.url_decode("path"), name, 1)
    if not long:
        return (whole.coalesce(tasks) if tasks else whole).select(doc.alias("doc_id"), "part", "text", "cut")
    lines = files.text(long, lineSep="\n").where(size > large).select(
        where, F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    if tasks:
        whole, lines = whole.coalesce(tasks), lines.coalesce(tasks)
    cut = lines.mapInArrow(_parts(large), "path string, block long, number long, text string")
    order = F.row_number().over(Window.partitionBy("path").orderBy("block", "number")) - 1
    parts = cut.select("path", order.alias("part"), "text", F.lit(True).alias("cut"))
    return whole.unionByName(parts).select(doc.alias("doc_id"), "part", "text", "cut")
