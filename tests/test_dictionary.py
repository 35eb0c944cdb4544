"""Dictionary occurrences equal a plain count, at any number of entries and blocks."""

import time

import numpy as np
import pytest

from gridkit.operators import corpus as C
from gridkit.operators import dictionary as D

TEXTS = [(1, "aaaa aa aaa"), (2, None), (3, ""), (4, "the North Site and North Site-2, north site"),
         (5, "xNorth Site North Site_1 (North Site)"), (6, "naïve NAÏVE café"), (7, "ab" * 40000), (7, "abab"),
         (None, "aa North Site"), (8, "abcabcab bcab")]
ENTRIES = ["aa", "a", "aaa", "North Site", "North Site-2", "Site", "naïve", "ab", "abab", "bca", "abcab", None, "", "aa"]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frames(spark):
    return (spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3),
            spark.createDataFrame([(e,) for e in ENTRIES], "entry string"))


@pytest.mark.parametrize("block", [2, 500_000])
def test_each_entry_is_counted_as_replace_would(spark, monkeypatch, block):
    monkeypatch.setattr(D, "ENTRIES", block)
    docs, entries = frames(spark)
    want = [(d, e, t.count(e)) for d, t in TEXTS for e in sorted({e for e in ENTRIES if e}) if t and t.count(e)]
    assert rows(D.occurrences(docs, entries)) == sorted(want, key=repr)


def test_case_and_whole_names(spark):
    docs, entries = frames(spark)
    folded = {(d, e): n for d, e, n in rows(D.occurrences(docs, entries, fold_case=True))}
    assert folded[4, "north site"] == 3 and folded[6, "naïve"] == 2
    whole = {(d, e): n for d, e, n in rows(D.occurrences(docs, entries, whole=True)) if d in (4, 5, None)}
    assert whole == {(4, "North Site"): 1, (4, "North Site-2"): 1, (5, "North Site"): 1, (5, "Site"): 2,
                     (4, "Site"): 1, (None, "North Site"): 1, (None, "aa"): 1, (None, "Site"): 1}


def test_the_longest_name_wins(spark):
    docs, entries = frames(spark)
    got = {(d, e): n for d, e, n in rows(D.occurrences(docs, entries, mode="longest")) if d in (1, 4, 8)}
    assert got == {(1, "aaa"): 2, (1, "a"): 1, (1, "aa"): 1, (4, "North Site"): 1, (4, "North Site-2"): 1,
                   (8, "abcab"): 1, (8, "bca"): 1, (4, "a"): 1} | {k: v for k, v in got.items() if k[1] == "ab"}


def test_longest_needs_one_block(spark, monkeypatch):
    docs, entries = frames(spark)
    monkeypatch.setattr(D, "ENTRIES", 3)
    with pytest.raises(ValueError):
        D.occurrences(docs, entries, mode="longest")


def test_empty_tables(spark):
    docs, entries = frames(spark)
    assert rows(D.occurrences(docs.where("false"), entries)) == []
    assert rows(D.occurrences(docs, entries.where("false"))) == []


def test_a_hundred_thousand_entries_cost_one_pass(spark):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghij"), 7)) for _ in range(120_000)]
    entries = spark.createDataFrame([(w,) for w in sorted(set(words))[:100_000]], "entry string")
    held = {r["entry"] for r in entries.collect()}
    texts = [(i, " ".join(rng.choice(words, 200))) for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    start = time.time()
    got = rows(D.occurrences(docs, entries, whole=True))
    assert time.time() - start < 60
    want = {}
    for d, t in texts:
        for w in t.split():
            if w in held:
                want[d, w] = want.get((d, w), 0) + 1
    assert got == sorted(((d, w, n) for (d, w), n in want.items()), key=repr)


def test_phrase_list_and_dictionary_agree(spark):
    docs = spark.createDataFrame([(i, f"{p} x {p.upper()} {p}{p}") for i, p in enumerate(C.BANNED_PHRASES)],
                                 "doc_id long, text string")
    entries = spark.createDataFrame([(p,) for p in C.BANNED_PHRASES], "entry string")
    a = rows(C.banned_phrases(docs).select("doc_id", "phrase", "occurrences"))
    assert a == rows(D.occurrences(docs, entries, fold_case=True))
