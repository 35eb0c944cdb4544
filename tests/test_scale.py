"""What a task holds or writes is bounded, whatever the size of the input."""

import datetime as dt
import hashlib
import os
import types

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF001
from gridkit.plans import q_quality, registry
from gridkit.sources import sinks
from gridkit.streaming import replay as P
from gridkit.streaming import streams as S


def test_corpus_files_lie_in_a_folder_per_task(spark, tmp_path, monkeypatch):
    """the commit moves task folders, and tasks are as many as the files need."""
    registry.load_all()
    texts = ["a\nb\n", "", "x" * 40_000, "\n".join("line %d" % i for i in range(9000))] + [f"t {i}" for i in range(9)]
    pq.write_table(pa.table({"doc_id": list(range(len(texts))), "text": texts}), tmp_path / "documents.parquet")
    scratch = str(tmp_path / "files")
    monkeypatch.setattr(q_quality, "_scratch", lambda spark, name: scratch)
    monkeypatch.setattr(q_quality, "FILES_A_TASK", 3)
    got = {r.doc_id: r.n_chars for r in registry.QUERIES["s09_corpus_read"](spark, str(tmp_path)).collect()}
    assert got == {str(i): len(t) for i, t in enumerate(texts)}
    tasks = [f for f in os.listdir(scratch) if f.startswith("task=")]
    assert 2 <= len(tasks) <= 5
    assert not [f for f in os.listdir(scratch) if f.startswith("doc_id=")]


def test_a_document_costs_one_file(spark, tmp_path, monkeypatch):
    """no folder, checksum or process for each document, and reading tasks follow the
    number of files; texts come back whole, the long one of wide letters with its end too."""
    registry.load_all()
    texts = ["", "a", "a\n\n", "é" * 20_000 + "\n", "x" * 40_000 + "\n", "b\r\nc"] + ["t%d" % i for i in range(94)]
    ids = [*range(99), None]
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": texts}), tmp_path / "documents.parquet")
    scratch = str(tmp_path / "files")
    monkeypatch.setattr(q_quality, "_scratch", lambda spark, name: scratch)
    monkeypatch.setattr(q_quality, "FILES_A_TASK", 50)
    out = registry.QUERIES["s09_corpus_read"](spark, str(tmp_path))
    got = {r.doc_id: (r.n_chars, r.md5) for r in out.collect()}
    want = {str(i): (len(t), hashlib.md5(t.encode()).hexdigest()) for i, t in zip(ids, texts)}
    want["__HIVE_DEFAULT_PARTITION__"] = want.pop("None")
    assert got == want
    names = [f for t in os.listdir(scratch) for f in os.listdir(f"{scratch}/{t}")]
    assert len(names) == 100 and all(f.startswith("doc_id=") and f.endswith(".txt") for f in names)
    files = spark.read.text(scratch, wholetext=True, recursiveFileLookup=True)
    read = sinks.read_corpus(spark, scratch, "*.txt", 32 << 10, sinks.CORPUS_NAME, tasks=2).where("NOT cut")
    assert files.rdd.getNumPartitions() > 2 and read.rdd.getNumPartitions() == 2


def test_corpus_on_a_store_that_tasks_do_not_open(spark, tmp_path, monkeypatch):
    """there Spark's writer makes the files, a folder for each; they are read alike."""
    monkeypatch.setattr(sinks.Files, "local", lambda self, path: None)
    docs = spark.createDataFrame([(1, "a\nb"), (2, "c\n")], "doc_id long, text string")
    sinks.write_corpus(docs, str(tmp_path / "files"), 2)
    got = sinks.read_corpus(spark, str(tmp_path / "files"), sinks.CORPUS_FILES, name=sinks.CORPUS_NAME).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [("1", "a\nb\n"), ("2", "c\n\n")]


def test_a_task_done_twice_leaves_its_files_once(tmp_path, monkeypatch):
    """of two attempts at a task the first counts."""
    monkeypatch.setattr(sinks.TaskContext, "get", staticmethod(lambda: types.SimpleNamespace(partitionId=lambda: 3)))
    rows = pa.RecordBatch.from_arrays([pa.array(["1", "a/b", "1"]), pa.array([b"x", b"y", b"z"])], names=["d", "t"])
    for _ in range(2):
        assert [b.to_pydict() for b in sinks._files(str(tmp_path))(iter([rows]))] == [{"rows": [3]}]
    assert os.listdir(tmp_path) == ["task=3"]
    assert {f.name: f.read_bytes() for f in (tmp_path / "task=3").iterdir()} == {
        "doc_id=1.txt": b"x\nz\n", "doc_id=a%2Fb.txt": b"y\n"}


def test_expiring_state_is_a_few_buckets(spark, tmp_path, monkeypatch):
    """many keys share a state; keys are exact, and the marker of the end gives no row."""
    monkeypatch.setattr(S, "BUCKETS", 4)
    folder = tmp_path / "events.parquet"
    folder.mkdir()
    big, start = (1 << 53) + 1, dt.datetime(2024, 1, 1)
    for i in range(3):
        ts = [start + dt.timedelta(minutes=25 * i + j % 2) for j in range(122)]
        users = [big + j // 2 for j in range(120)] + [None, None]
        kinds = ["view"] * 60 + [None] * 60 + ["view", None]
        pq.write_table(pa.table({"ts": pa.array(ts, pa.timestamp("us")), "user_id": pa.array(users, pa.int64()),
                                 "event_type": pa.array(kinds, pa.string())}), folder / f"part-{i}.parquet")
    states, real = [], S.run_available_now

    def watched(spark, df, name, mode="append", paths=None):
        out = real(spark, df, name, mode, paths)
        states.append(spark.read.format("statestore").load(paths[1]).count())
        return out

    monkeypatch.setattr(S, "run_available_now", watched)
    got = P.replay(spark, str(tmp_path), lambda read, delay: S.ttl_expiring_stream(read(), watermark=delay), "b",
                   close=True).collect()
    # of a key's times 0, 1, 25, 26, 50 and 51 minutes only the first is stored
    want = [(big + j, "view" if j < 30 else None, start) for j in range(60)] + [
        (None, "view", start), (None, None, start + dt.timedelta(minutes=1))]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert 1 <= max(states) <= 4


def test_shuffle_reads_are_small(spark):
    """F3 to F11, F13, F14: what one task reads of a shuffle does not grow with it."""
    out = spark.range(4_000_000).select(F.xxhash64("id").alias("h")).groupBy("h").count()
    assert out.rdd.getNumPartitions() >= 4


def test_asset_days_are_not_shuffled(spark):
    """the asset x day rows come last, after all joins."""
    for name in ("d07_asset_pnl", "d08_curtailment"):
        plan = E.queries()[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
        above = plan[: plan.index("Generate posexplode")]
        assert "Exchange" not in above and "Join" not in above and "Sort " not in above
