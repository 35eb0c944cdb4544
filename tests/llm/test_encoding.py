"""The encoder keeps no words, and frequencies come from the tasks that encode."""

import os
import sys
import tracemalloc
import types

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from gridkit.llm import bin_completion, retrieval_packing, tokens


def test_encoder_keeps_no_words():
    encoder = tokens.Encoder(tokens.vocabulary())
    encoder.ids(b"a first text")
    rng = np.random.default_rng(5)
    texts = [" ".join("".join(map(chr, w)) for w in rng.integers(97, 123, (400, 9))).encode() for _ in range(40)]
    tracemalloc.start()
    try:
        for text in texts:
            encoder.ids(text)
        assert tracemalloc.get_traced_memory()[0] < 200_000
    finally:
        tracemalloc.stop()


def test_runs_of_one_character():
    from tokenizers import Tokenizer

    files = tokens.vocabulary()
    encoder, slow = tokens.Encoder(files), Tokenizer.from_file(files["json"])
    slow.encode_special_tokens = True
    for text in (" " * 60_000, "\n" * 60_000, "!" * 60_000, " \t" * 30_000 + "b", "a " * 30_000):
        assert encoder.ids(text.encode()).tolist() == slow.encode(text, add_special_tokens=False).ids


def test_encoding_tasks_count_their_ids(spark):
    texts = ["one two two", None, "", "two", "ж two", "1 2 3 " * 500] * 3
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = retrieval_packing.encode(docs)
    encoder = tokens.Encoder(tokens.vocabulary())
    want = np.zeros(1 << 16, int)
    for t in texts:
        want[np.unique(np.append(encoder.ids((t or "").encode()), retrieval_packing.CLOSING))] += 1
    held = out.where("n IS NULL").select("ids").mapInArrow(retrieval_packing._frequencies, "term int, df long")
    got = {r["term"]: r["df"] for r in held.groupBy("term").agg(F.sum("df").alias("df")).collect()}
    assert got == {i: int(want[i]) for i in np.flatnonzero(want).tolist()}
    assert out.where("n IS NOT NULL").count() == len(rows)


def batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())],
                                      names=["doc_id", "text"])


def encoded(encoder, *batches):
    return [ids[a:b].tolist() for _, bounds, ids in encoder.batches(iter(batches))
            for a, b in zip(bounds[:-1], bounds[1:])]


def test_batches_agree_with_tokenizers(monkeypatch):
    from tokenizers import Tokenizer

    files = tokens.vocabulary()
    encoder, slow = tokens.Encoder(files), Tokenizer.from_file(files["json"])
    slow.encode_special_tokens = True
    rng = np.random.default_rng(11)
    near = ([" "] * 8 + list("\t\n\r\x0b\x0c\x1c\x85\xa0") + ["\u0120", "\u010a", "''", "'", "'s", "'re", "'ll", "'T"]
            + list("abstdlZ19,.-_<|>\xe9\xc2\xb2\xbd\u01c5\u0250\u027f") + ["the", " of", "<|endoftext|>"])
    texts = [None, "", " ", "\n", "\xa0", "\x85 ", " \xa0x", "x\xa0 ", "a  ", "  a", "don't 's ''s  's", "\xc2\xa0 \xc3\xa0"]
    for beyond in ([], ["\u0280", "\u2003", "\u3000", "\u4e16", "\U0001f600"]):
        symbols = near + beyond
        texts += ["".join(symbols[i] for i in rng.integers(0, len(symbols), n)) for n in rng.integers(0, 40, 3000)]
    texts += ["a long text \n\n" * 200, "", "\u4e16 and " * 200]
    want = [slow.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert encoded(encoder, batch(texts)) == want
    assert [encoder.ids((t or "").encode()).tolist() for t in texts] == want
    monkeypatch.setattr(tokens, "BATCH", 500)  # batches are joined and cut
    assert encoded(encoder, *(batch(texts[i: i + 7]) for i in range(0, len(texts), 7))) == want
    assert encoded(encoder) == encoded(encoder, batch([])) == []
    assert encoded(encoder, batch([None, ""])) == [[], []]
    assert encoded(encoder, batch([" ", None, "\n\n"])) == [encoder.ids(b" ").tolist(), [], encoder.ids(b"\n\n").tolist()]


@pytest.mark.parametrize("module", [retrieval_packing, bin_completion])
def test_words_of_a_batch_are_encoded_once(module, monkeypatch):
    encoder, sizes = tokens.Encoder(tokens.vocabulary()), []

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        def encode_to_numpy(self, text, **options):
            sizes.append(len(text))
            return self.inner.encode_to_numpy(text, **options)

    for name in ("fast", "lines"):
        if hasattr(encoder, name):
            setattr(encoder, name, Counted(getattr(encoder, name)))
    monkeypatch.setattr(module, "encoder_of", lambda files: encoder)
    rng = np.random.default_rng(3)
    texts = [" ".join(f"wórd{'x' * i}" for i in rng.integers(0, 50, 400)) for _ in range(100)]
    if module is retrieval_packing:
        task = retrieval_packing._encode({})
    else:
        monkeypatch.setattr(module.TaskContext, "get", lambda: types.SimpleNamespace(partitionId=lambda: 0))
        task = bin_completion._cut({}, 1024, 2, False)
    assert sum(b.num_rows for b in task(iter([batch(texts[:50]), batch(texts[50:])]))) >= len(texts)
    assert sum(sizes) < sum(map(len, texts)) / 100


def test_index_drops_used_entries():
    rng = np.random.default_rng(8)
    docs = [rng.integers(0, 3000, 40).astype(np.uint16) for _ in range(400)]
    index = retrieval_packing.Index(docs, np.ones(1 << 16), 40.0)
    used = np.arange(400) < 120  # 280 of 400 are left
    used[200] = True
    index.neighbours(200, used)
    assert index.rows.tolist() == np.flatnonzero(~used).tolist()
    assert len(index.doc) == index.start[-1] < len(index.term)
    for place, entry in enumerate(index.rows.tolist()):
        held = np.repeat(np.arange(1 << 16), np.diff(index.start))[index.doc == place]
        assert set(held.tolist()) <= set(docs[entry].tolist())
