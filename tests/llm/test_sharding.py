import zlib
from collections import Counter

import numpy as np
import pytest

from tidewatch.llm import shard_permutation as sharding


@pytest.mark.parametrize("size", [1, 2, 3, 16, 17, 1000, 4097])
def test_feistel_is_a_permutation(size):
    out = sharding.feistel(np.arange(size), size, 5)
    assert sorted(out.tolist()) == list(range(size))
    if size > 100:
        assert (out == np.arange(size)).mean() < 0.05
        assert (out != sharding.feistel(np.arange(size), size, 6)).any()


def test_frame(spark, documents):
    texts = {i: f"text {i}" for i in range(500)} | {600: None, 601: "", 602: "é", 603: "x" * 50_000}
    docs = documents(texts)
    rows = sharding.shard_documents(docs.unionByName(docs.filter("doc_id < 40"))).collect()
    counts = Counter(r["shard"] for r in rows)
    assert len(rows) == 544 and max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(16))
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s])) for s in counts)
    one = {r["doc_id"]: r for r in rows}
    assert (one[600]["size"], one[600]["text_crc32"], one[602]["size"], one[602]["text_crc32"]) == (1, 0, 3, zlib.crc32("é".encode()))
    again = sharding.shard_documents(docs.unionByName(docs.filter("doc_id < 40")).repartition(3)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert sharding.shard_documents(docs.limit(0)).count() == 0
