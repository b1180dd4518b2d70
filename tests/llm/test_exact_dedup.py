import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import exact_dedup


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=9000), max_size=4))
def test_fingerprints_combine(parts):
    whole = (0, 0, 0)
    for part in parts:
        whole = exact_dedup.combine(whole, exact_dedup.fingerprint(part))
    assert whole == exact_dedup.fingerprint(b"".join(parts))


def test_fingerprint_is_the_polynomial():
    data = bytes(range(256)) * 40
    for i in (0, 1):
        value = 0
        for byte in data:
            value = (value * exact_dedup.BASES[i] + byte) % exact_dedup.PRIMES[i]
        assert exact_dedup.fingerprint(data)[i] == value


def brute(texts):
    norm = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t in texts.items()}
    out = {}
    for i, t in norm.items():
        same = [j for j in norm if norm[j] == t]
        keep = min(same, key=lambda j: (-len(texts[j] or ""), j))
        out[i] = (keep, len(same), keep == i, hashlib.sha256(t.encode()).hexdigest())
    return out


def test_groups(spark, documents):
    texts = {1: "a b", 2: "ab", 3: "a  b", 4: None, 5: "", 6: " \n", 7: "x" * 200_000, 8: "x" * 100_000 + " " + "x" * 100_000, 9: "é b", 10: "éb", 11: "other", 12: "a b"}
    texts |= {i: "copy" for i in range(100, 140)}
    got = {r["doc_id"]: tuple(r[1:5]) for r in exact_dedup.exact_groups(documents(texts)).collect()}
    assert got == brute(texts)
    assert exact_dedup.exact_groups(documents({1: "x"}).limit(0)).count() == 0


def test_equal_fingerprints_of_unlike_texts_are_split(spark, documents, monkeypatch):
    texts = {1: "abcd", 2: "wxyz", 3: "abcd", 4: "wxyz", 5: "alone"}
    real = exact_dedup.fingerprint
    same = lambda data: (1, 2, len(data)) if len(data) == 4 else real(data)
    monkeypatch.setattr(exact_dedup, "fingerprint", same)
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(exact_dedup)
    try:
        got = {r["doc_id"]: tuple(r[1:5]) for r in exact_dedup.exact_groups(documents(texts)).collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(exact_dedup)
    assert got == brute(texts)
