import math
import pickle
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidewatch.llm import kneser_ney as kn
from tidewatch.llm import sharded_grams as sg


def grams(text, order):
    padded = "\n" * (sg.ORDER - 1) + text
    return [padded[i - order + 1 : i + 1] for i in range(sg.ORDER - 1, len(padded))]


def brute(texts):
    """Plain interpolated modified Kneser-Ney over dictionaries of strings."""
    counts = {sg.ORDER: Counter(g for t in texts for g in grams(t, sg.ORDER))}
    for order in range(sg.ORDER - 1, 0, -1):
        counts[order] = Counter(g[1:] for g in counts[order + 1])

    def discounts(order):
        n = Counter(counts[order].values())
        n1, n2, n3, n4 = (max(1, n[i]) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        return [min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1)]

    found = {order: discounts(order) for order in counts}

    def p(gram):
        if not gram:
            return 1 / sg.SYMBOLS
        order, d = len(gram), found[len(gram)]
        inside = {g: n for g, n in counts[order].items() if g[:-1] == gram[:-1]}
        if not inside:
            return p(gram[1:])
        total = sum(inside.values())
        weight = sum(d[min(n, 3) - 1] for n in inside.values()) / total
        n = counts[order].get(gram, 0)
        return (n - d[min(n, 3) - 1] if n else 0) / total + weight * p(gram[1:])

    return p


@pytest.mark.parametrize(("rows", "full"), [(0, False), (40, False), (40, True), (1 << 19, False)])
def test_scores_equal_brute_force(spark, documents, monkeypatch, rows, full):
    """With no cache, a small one, a sieve that lets all grams through, and all rows cached."""
    monkeypatch.setattr(sg, "CACHE_ROWS", rows)
    texts = ["the cat sat on the mat.", "the dog sat on the log.", "a cat and a dog", "", "été 12, THE end! 😀", "кот и пёс"] * 2
    counts = sg.count_grams(spark.createDataFrame([(t,) for t in texts], "text string")).selectExpr("gram", "n0 + n1 AS n")
    model = sg.fit_grams(sg.stage_table(counts, "counts"), kn.discounts)
    model.known |= -int(full)
    p = brute(texts)
    asked = {1: texts[0], 2: "unseen zebra?", 3: "cat\ncat", 4: "пёс и кот 😀", 5: "猫", 6: "", 7: None, 8: "nul\0\0", 9: texts[0]}
    got = {r["doc_id"]: r for r in sg.score_grams(documents(asked), model, ["doc_id", "key"]).collect()}
    assert len(got) == len(asked)
    for i, text in asked.items():
        want = sum(-math.log(p(g)) for g in grams(text or "", sg.ORDER))
        assert got[i]["n_symbols"] == len(text or "") and got[i]["nll"] == pytest.approx(want, abs=1e-6)


def test_counts_keep_code_points_apart(spark):
    """Folded to 44 symbols, all these texts are the same one."""
    texts = [chr(0x430 + i % 32) + chr(0x4E00 + i) for i in range(400)]
    counts = sg.count_grams(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert counts.count() == 32 + 400


def test_junk_in_another_script(spark, documents):
    """Letters of good Cyrillic text in another order, which the folded alphabet cannot tell from it."""
    good = "съешь ещё этих мягких французских булок, да выпей чаю. "
    clean = {i: good * (i % 5 + 3) for i in range(200)}
    letters = list(good.replace(" ", "") * 6)
    np.random.default_rng(1).shuffle(letters)
    junk = "".join(c + " " * (i % 6 == 5) for i, c in enumerate(letters))
    docs = documents(clean | {900: junk}, dict.fromkeys([*clean, 900], "ru"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)], "doc_id long, quality int, toxic int")
    model = kn.fit(kn.trusted_documents(docs, labels))
    assert [r["doc_id"] for r in kn.classify(docs, model, ["doc_id"]).filter("not accepted").collect()] == [900]


def test_every_language_has_its_own_limit(spark, documents):
    """Fewer than 50 held-out documents, and more languages than 1000, still give limits."""
    texts = {i: f"text number {i} of its kind" for i in range(4400)}
    docs = documents(texts, {i: f"l{i % 2200}" for i in texts})
    model = kn.fit(docs)
    held = {r["lang"] for r in docs.filter("pmod(xxhash64(doc_id), 2) = 1").select("lang").distinct().collect()}
    limits = {r["lang"]: r["limit"] for r in model.limits.collect()}
    assert set(limits) == held and len(held) > 1000 and len(set(limits.values())) > 100
    got = kn.classify(docs.limit(200), model, ["doc_id", "lang"]).collect()
    assert all(r["limit"] == limits.get(r["lang"], model.default) for r in got) and len(got) == 200


def test_memory_of_a_worker():
    """What a worker needs to load a full cache and sieve and to resolve one run of text."""
    rng = np.random.default_rng(1)
    keys = np.sort(rng.integers(0, 1 << 63, sg.CACHE_ROWS, dtype=np.uint64) << np.uint64(1))
    sent = pickle.dumps(((keys, np.zeros(len(keys)), np.zeros(len(keys))), np.full(1 << sg.SIEVE_LOG - 6, -1, np.int64)))
    data = rng.integers(97, 123, sg.SCORED_BYTES, dtype=np.uint8)
    tracemalloc.start()
    try:
        resolver = sg._Resolver(*pickle.loads(sent), -14.0)
        padded, starts = sg.code_points(data, np.array([0, len(data)]))
        found, ends, _ = sg._distinct(padded, sg._ends(starts))
        resolver.resolve(found, padded, ends)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 100 << 20


def test_counts_of_small_runs_are_added_up(monkeypatch):
    """Counting a run needs little memory, and gives each gram once whatever part of the text it stands in."""
    rng = np.random.default_rng(2)
    column = pa.array(["".join(map(chr, rng.integers(97, 103, 1000))) for _ in range(2000)] + ["é€\0x", "", None])
    data, bounds = sg.utf8_buffers(column)
    parts = (np.arange(len(column)) % 2).astype(np.int32)
    tracemalloc.start()
    try:
        found, zero, one = sg.counted(data, bounds, parts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 110 << 20 and len(set(found.to_pylist())) == len(found) and zero.sum() + one.sum() == 2_000_004
    monkeypatch.setattr(sg, "SCORED_BYTES", 1 << 30)
    whole = sg.counted(data, bounds, parts)
    assert [x.tolist() for x in (found, zero, one)] == [x.tolist() for x in whole]
    assert [len(x) for x in sg.counted(*sg.utf8_buffers(pa.array(["", None])), parts[:2])] == [0, 0, 0]
