"""Versioned tables: whole versions, idempotent batches, partition swaps."""

import os

import pytest
from pyspark.sql import functions as F

from gridkit.session import scratch_path
from gridkit.sources.versioned import Conflict, Manifest, VersionedTable


@pytest.fixture
def table(spark, request):
    return VersionedTable(spark, scratch_path(spark, f"versioned-{request.node.name}"))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)



def day(spark, *data):
    return spark.createDataFrame(list(data), "id long, day string, v string").withColumn("day", F.to_date("day"))


def test_overwrite_append_and_old_versions(spark, table):
    with pytest.raises(FileNotFoundError):
        table.read()
    assert table.commit(spark.range(3)) == 1
    assert table.commit(spark.range(3, 5), "append") == 2
    assert table.commit(spark.range(2).select(F.col("id").alias("other"))) == 3
    assert rows(table.read(1)) == [(0,), (1,), (2,)] and table.read(2).count() == 5
    assert table.read().columns == ["other"]
    with pytest.raises(ValueError):
        table.commit(spark.range(1), "append")
    assert table.versions() == [1, 2, 3]


def test_a_write_killed_midway_leaves_the_old_rows(spark, table):
    table.commit(spark.range(4))
    broken = spark.range(0, 1000, 1, 4).select(
        F.when(F.col("id") < 900, F.col("id")).otherwise(F.raise_error(F.lit("lost")).cast("long")).alias("id"))
    for mode in ("overwrite", "append"):
        with pytest.raises(Exception, match="lost"):
            table.commit(broken, mode)
        assert table.read().count() == 4 and table.versions() == [1]
    # a writer that dies between its data and its manifest
    dead = VersionedTable(spark, table.path)
    dead._publish = lambda *a: (_ for _ in ()).throw(KeyboardInterrupt())
    with pytest.raises(KeyboardInterrupt):
        dead.commit(spark.range(9))
    assert table.read().count() == 4
    assert len(table.vacuum()) >= 1 and table.read().count() == 4


def test_the_same_batch_twice_counts_once(spark, table):
    assert table.commit(spark.range(2), "append", batch="a") == 1
    assert table.commit(spark.range(2), "append", batch="a") == 1
    assert table.commit(spark.range(2, 4), "append", batch="b") == 2
    assert table.commit(spark.range(2), "append", batch="a") == 2
    assert table.read().count() == 4
    # the writer of the last version died before it left its marker
    table.files.delete(table._marker("b"))
    assert table.commit(spark.range(2, 4), "append", batch="b") == 2
    table.commit(spark.range(4, 5), "append", batch="c")
    assert table.files.exists(table._marker("b")) and table.commit(spark.range(2, 4), "append", batch="b") == 3
    assert table.read().count() == 5


def test_of_two_writers_one_must_try_again(spark, table):
    table.commit(spark.range(1))
    late = VersionedTable(spark, table.path)
    seen = late.manifest()
    table.commit(spark.range(2))
    with pytest.raises(Conflict):
        late._publish(seen, Manifest(seen.version + 1, seen.schema, (), seen.parts, None))
    assert table.read().count() == 2
    left = [n for n in os.listdir(f"{table.path}/manifests") if n.startswith(".") and n.endswith("json")]
    assert left == []


def test_partitions_are_swapped_alone(spark, table):
    a = day(spark, (1, "2025-01-01", "x"), (2, "2025-01-02", "y"), (3, "2025-01-03", "z"), (4, None, "n"))
    table.commit(a, partition_by=["day"])
    before = table.manifest().parts
    table.commit(day(spark, (5, "2025-01-02", "new")), "partitions", replace=["day=2025-01-03"])
    after = table.manifest().parts
    assert rows(table.read().select("id", "v")) == [(1, "x"), (4, "n"), (5, "new")]
    assert after["day=2025-01-01"] == before["day=2025-01-01"] and "day=2025-01-03" not in after
    assert table.read().schema["day"].dataType.simpleString() == "date"
    assert rows(table.read(1).select("id")) == [(1,), (2,), (3,), (4,)]
    pruned = table.read().where("day = DATE'2025-01-02'")
    assert len(pruned.inputFiles()) >= 1 and rows(pruned.select("v")) == [("new",)]
    with pytest.raises(ValueError):
        VersionedTable(spark, table.path + "-flat").commit(spark.range(1), "partitions")


def test_compaction_and_vacuum_keep_the_rows(spark, table):
    for i in range(4):
        table.commit(day(spark, (i, "2025-01-01", "a"), (i, f"2025-01-0{i + 2}", "b")), "append",
                     partition_by=["day"] if i == 0 else ())
    want = rows(table.read())
    assert len(table.manifest().parts["day=2025-01-01"]) == 4
    table.compact()
    assert len(table.manifest().parts["day=2025-01-01"]) == 1 and rows(table.read()) == want
    table.vacuum(keep=1)
    assert table.versions() == [5] and rows(table.read()) == want
    table.commit(day(spark, (9, "2025-02-01", "c")), "append")
    assert table.read().count() == len(want) + 1


def test_empty_tables(spark, table):
    table.commit(day(spark).limit(0), partition_by=["day"])
    assert rows(table.read()) == [] and table.read().columns == ["id", "day", "v"]
    table.commit(day(spark, (1, "2025-01-01", "x")), "append")
    assert table.read().count() == 1
