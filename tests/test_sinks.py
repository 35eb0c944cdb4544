"""Sinks: overwrite / append, CTAS, comments, JSON extracts, corpus reader."""

import datetime as dt
import json
import os
import tempfile

from pyspark.sql import functions as F

from gridkit.functions.scalars import sql_quote_col
from gridkit.sources import sinks


def test_write_append_ctas_and_comments(spark):
    d = tempfile.mkdtemp(prefix="gridkit-sink-")
    a = spark.createDataFrame([(1, "x")], "id long, v string")
    b = spark.createDataFrame([(2, "y")], "id long, v string")
    p = os.path.join(d, "t")
    sinks.write_table(a, p)
    sinks.write_table(b, p, mode="append")
    sinks.write_table(b, p, mode="append", batch="b2")
    sinks.write_table(b, p, mode="append", batch="b2")
    assert sorted(r.id for r in sinks.read_table(spark, p).collect()) == [1, 2, 2]
    assert sinks.read_table(spark, p, 1).count() == 1
    sinks.write_table(b.withColumn("extra", F.lit(1)), p)             # overwrite replaces schema
    assert sinks.read_table(spark, p).columns == ["id", "v", "extra"]
    c = sinks.create_table_as(spark, a.unionByName(b), os.path.join(d, "c"), partition_by=["v"])
    assert c.count() == 2
    cm = sinks.with_comments(a, {"v": "it's a value"})
    assert cm.schema["v"].metadata["comment"] == "it's a value"
    ddl = sinks.comment_table_sql("t", "the 'table'", {"v": "it's"})
    assert ddl[0] == "COMMENT ON TABLE t IS 'the ''table'''"
    assert ddl[1].endswith("COMMENT 'it''s'")
    assert spark.range(1).select(sql_quote_col(F.lit("a'b")).alias("q")).first().q == "a''b"


def test_json_extract_and_corpus_reader(spark):
    d = tempfile.mkdtemp(prefix="gridkit-json-")
    df = spark.createDataFrame([(dt.date(2025, 3, 1), dt.datetime(2025, 3, 1, 4, 5, 6))],
                               "d date, ts timestamp_ntz")
    sinks.write_json_extract(df, os.path.join(d, "out"))
    line = spark.read.text(os.path.join(d, "out")).first().value
    rec = json.loads(line)
    assert rec["d"] == "2025-03-01" and rec["ts"].startswith("2025-03-01T04:05:06")
    md = os.path.join(d, "md")
    os.makedirs(md)
    for name, text in (("OIR-2025-001.md", "# A\nbody"), ("CAR-2025-004.md", "x")):
        with open(os.path.join(md, name), "w") as f:
            f.write(text)
    docs = {r.doc_id: r.text for r in sinks.read_corpus(spark, md).collect()}
    assert docs == {"OIR-2025-001": "# A\nbody", "CAR-2025-004": "x"}


def test_large_files_come_in_parts(spark):
    md = os.path.join(tempfile.mkdtemp(prefix="gridkit-large-"), "md")
    os.makedirs(md)
    rng = __import__("random").Random(2)
    big = "\n".join("w" * rng.randint(0, 90) + str(i) for i in range(40000))
    texts = {"big one": big, "small": "a\r\nb\n\n", "line": "x" * 300_000, "none": "", "edges": "\n\n" + "y\n" * 90_000}
    for name, text in texts.items():
        with open(os.path.join(md, f"{name}.md"), "w", newline="") as f:
            f.write(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")  # several blocks a file
    try:
        parts = sinks.read_corpus(spark, md, large=100_000).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    found = {}
    for r in sorted(parts, key=lambda r: r.part):
        found.setdefault(r.doc_id, []).append(r.text)
    assert len(found["big one"]) > 10 and all(len(t) <= 100_200 for t in found["big one"])
    assert found["small"] == [texts["small"]] and "none" not in found
    for name in ("big one", "line"):
        assert "\n".join(found[name]) == texts[name]
    assert "\n".join(found["edges"]) == texts["edges"][:-1]
