import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidewatch.llm import minhash_dedup as mh
from tidewatch.llm.components import components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if len(words) >= 5 else frozenset([tuple(words)])


def brute(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    label = {i: i for i in texts}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(texts)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if 100 * both >= 75 * (len(sets[x]) + len(sets[y]) - both):
                    a, b = find(x), find(y)
                    label[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    base = [f"b{rng.randrange(400)}" for _ in range(100)]
    passage = [f"p{i}" for i in range(60)]
    texts = {i: edited(base, rng.randrange(1, 7), rng) for i in range(90)}  # a dense group whose pairs straddle the threshold
    texts |= {100 + i: " ".join(passage + [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 60))]) for i in range(60)}
    chain = [f"c{i}" for i in range(40)]
    for i in range(20):
        chain = chain[2:] + [f"d{i}", f"e{i}"]
        texts[300 - i] = " ".join(chain)
    texts |= {i: "Exact Copy of  a text\nwith words" for i in range(400, 430)} | {430: "exact copy of a text with words"}
    texts |= {500: None, 501: "", 502: " \t", 503: "one", 504: "ONE", 505: "one two", 506: "x " * 5000, 507: "y" * 300 + " z", 508: "é à ü ö ß", 509: "É à ü ö ß"}
    return texts


def test_sets_equal_brute_force(corpus):
    data, bounds = mh.utf8_buffers(pa.array(list(corpus.values())))
    sets = mh.shingle_sets(data, bounds)
    want = [shingles(t) for t in corpus.values()]
    assert [len(s) for s in sets] == [len(w) for w in want]
    for a in range(0, len(sets), 7):
        for b in range(a, len(sets), 11):
            assert len(np.intersect1d(sets[a], sets[b])) == len(want[a] & want[b])


@pytest.mark.parametrize("block", [512, 16])
def test_groups_equal_brute_force(spark, documents, corpus, block, monkeypatch):
    monkeypatch.setattr(mh, "BLOCK", block)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in mh.near_groups(documents(corpus)).collect()}
    assert got == brute(corpus)


def test_repeated_and_missing_ids(spark, documents):
    docs = documents({1: "a b c d e f g", 2: "a b c d e f g", 3: "other words in here now"})
    both = docs.unionByName(docs.filter("doc_id = 2")).unionByName(docs.filter("doc_id = 3").withColumn("doc_id", mh.F.lit(None).cast("long")))
    assert sorted((r["doc_id"], r["component_id"]) for r in mh.near_groups(both).collect()) == [(1, 1), (2, 1), (2, 1), (3, 3)]
    assert mh.near_groups(docs.limit(0)).count() == 0


def test_pruning_bounds():
    least = mh.least_matches()
    assert list(least) == sorted(least) and least[-1] < 0.75 * mh.HASHES
    rng = np.random.default_rng(0)
    left = rng.integers(0, 65536, (4000, mh.HASHES)).astype(np.uint16)
    right = np.where(rng.random(left.shape) < 0.75, left, rng.integers(0, 65536, left.shape)).astype(np.uint16)
    assert mh.plausible(left, right).all()
    assert not mh.plausible(left, np.roll(left, 1, axis=0)).any()


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(200, 260)] + [(0, i) for i in range(1, 50)] + [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(200)] + [(7, 7)]
    label = {}

    def find(i):
        label.setdefault(i, i)
        while label[i] != i:
            i = label[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            label[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in label}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
