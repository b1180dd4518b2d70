"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, free, gathered, mix64, quoted, release, row_runs, spread, stage_table, utf8_buffers, without

#: Hash buckets; the model is a matrix of this many rows and a column per language.
BUCKETS = 1 << 16
#: Orders of the character n-grams.
ORDERS = (1, 2, 3)
#: Languages of one block of the matrix (16 MiB); the driver gathers the counts of one block at a time.
LANGUAGE_BLOCK = 64
#: Bytes of a text that are lower-cased at once; a longer one is cut into runs whose counts are added.
LONG = 1 << 20
#: Bytes of short texts, and code points of a long one, whose n-grams are held at once.
HASHED = 1 << 17
#: Prediction of a text without letters.
UNDETERMINED = "und"
_SALTS = mix64(np.arange(101, 101 + max(ORDERS), dtype=np.uint64))


def gram_buckets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all texts, one after the other, and the n + 1 offsets of the texts.

    Texts are lower-cased, each run of other characters than letters counts as one separator, and separators stand at both
    ends, so that no n-gram reaches into the next text."""
    closing = " " * (max(ORDERS) - 1)
    lowered = [f" {(t or '').lower()}{closing}" for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) for t in lowered])
    firsts = np.r_[0, ends][:-1]
    letter = is_letter(codes)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first character after a letter is the separator
    keep[firsts] = True
    shut = np.zeros(len(codes), bool)
    for j in range(1, max(ORDERS)):
        shut[ends - j] = True
    keep |= shut
    codes = np.where(letter, codes, 32)[keep].astype(np.uint64)
    counts = np.r_[0, np.cumsum(keep & ~shut)]
    starts = counts[np.r_[firsts, len(letter)]]
    places = np.flatnonzero(~shut[keep])
    padded = np.r_[codes, np.full(max(ORDERS), 32, np.uint64)]
    grams = np.empty((len(places), len(ORDERS)), np.int64)
    state = np.zeros(len(codes), np.uint64)
    for j in range(max(ORDERS)):
        state = mix64(state + padded[j : j + len(codes)] * _SALTS[j] + np.uint64(j + 1))
        if j + 1 in ORDERS:
            grams[:, ORDERS.index(j + 1)] = (state >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)[places]
    return grams.ravel(), starts * len(ORDERS)


_LETTERS = np.zeros(0x110000, bool)


def is_letter(codes: np.ndarray) -> np.ndarray:
    if not _LETTERS[97]:
        _LETTERS[:] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTERS[np.minimum(codes, 0x10FFFF)]


def _hashed(codes: np.ndarray) -> np.ndarray:
    """Buckets of the n-grams that start at each of the given normalised codes but the last max(ORDERS) - 1."""
    n = len(codes) - max(ORDERS) + 1
    out, state = np.empty((n, len(ORDERS)), np.int64), np.zeros(n, np.uint64)
    for j in range(max(ORDERS)):
        state = mix64(state + codes[j : j + n] * _SALTS[j] + np.uint64(j + 1))
        if j + 1 in ORDERS:
            out[:, ORDERS.index(j + 1)] = (state >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
    return out.ravel()


def long_buckets(data: np.ndarray) -> Iterator[tuple[np.ndarray, bool]]:
    """Buckets of the n-grams of one text in UTF-8, HASHED code points at a time, and whether their run has a letter. Together
    they are the n-grams of the whole text: what the next ones need is carried over."""
    held, after, low = np.array([32], np.uint64), False, 0
    while low < len(data):
        high = min(len(data), low + LONG)
        while high < len(data) and (data[high] & 0xC0) == 0x80:
            high -= 1
        codes = np.frombuffer(data[low:high].tobytes().decode(errors="replace").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = is_letter(codes)
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[:1] |= after
        after, low = bool(letter[-1]), high
        lettered, codes = bool(letter.any()), np.where(letter, codes, 32)[keep]
        for cut in range(0, len(codes), HASHED):
            held = np.r_[held, codes[cut : cut + HASHED].astype(np.uint64)]
            if len(held) >= max(ORDERS):
                yield _hashed(held), lettered
                held = held[len(held) - max(ORDERS) + 1 :]
    yield _hashed(np.r_[held, np.full(max(ORDERS) - 1, 32, np.uint64)]), False


def sparse_counts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows of a text column: the first row's number, whether each row has a letter, and the bucket counts of the
    rows as row, bucket and n of a sparse matrix in order of rows. A text of more than HASHED bytes comes in several runs."""
    data, bounds = utf8_buffers(column)
    most = min(LONG, HASHED)

    def counted(owner: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pairs = np.sort(owner * BUCKETS + grams)
        first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
        return pairs[first] // BUCKETS, pairs[first] % BUCKETS, np.diff(np.r_[first, len(pairs)])

    for low, high in row_runs(bounds, most):
        if bounds[high] - bounds[low] > most:
            for grams, lettered in long_buckets(data[bounds[low] : bounds[high]]):
                yield low, np.array([lettered]), *counted(np.zeros(len(grams), np.int64), grams)
        else:
            texts = [data[bounds[i] : bounds[i + 1]].tobytes().decode(errors="replace") for i in range(low, high)]
            grams, starts = gram_buckets(texts)
            lettered = np.fromiter((any(map(str.isalpha, t)) for t in texts), bool, len(texts))
            yield low, lettered, *counted(np.repeat(np.arange(high - low), np.diff(starts)), grams)


@dataclass
class LanguageModel:
    languages: list[str]
    blocks: list[np.ndarray]  # log probabilities, BUCKETS x LANGUAGE_BLOCK at most, float32
    log_prior: np.ndarray


def count_grams(documents: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, bucket (-1: documents) and n over all rows with a language; counted in each task first, in a matrix of
    LANGUAGE_BLOCK languages that is sent off when another language comes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for name, counts in sums.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(np.where(at == BUCKETS, -1, at), pa.int32()), pa.array(counts[at], pa.int64())], names=["lang", "bucket", "n"])
            sums.clear()

        for batch in batches:
            langs, codes = np.unique(batch.column(0).to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
            for code, n in enumerate(np.bincount(codes, minlength=len(langs)).tolist()):
                if len(sums) >= LANGUAGE_BLOCK and langs[code] not in sums:
                    yield from flush()
                sums.setdefault(str(langs[code]), np.zeros(BUCKETS + 1, np.int64))[-1] += n
            for low, _, row, bucket, n in sparse_counts(batch.column(1)):
                of = codes[low + row]
                for code in np.unique(of).tolist():
                    if len(sums) >= LANGUAGE_BLOCK and langs[code] not in sums:
                        yield from flush()
                    mine = of == code
                    sums.setdefault(str(langs[code]), np.zeros(BUCKETS + 1, np.int64))[:-1] += np.bincount(bucket[mine], n[mine], BUCKETS).astype(np.int64)
        yield from flush()
        release()

    rows = spread(documents.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text")))
    return rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(documents: DataFrame, smoothing: float = 0.5, text: str = "text", lang: str = "lang") -> LanguageModel:
    """A model of all languages in the given rows. The driver receives BUCKETS + 1 counts for each language of a block at once;
    the model has 256 KiB a language."""
    counts = stage_table(count_grams(documents, text, lang), "language-counts")
    docs = {r["lang"]: r["n"] for r in counts.filter("bucket = -1").collect()}
    languages, blocks = sorted(docs), []
    for low in range(0, len(languages), LANGUAGE_BLOCK):
        own = languages[low : low + LANGUAGE_BLOCK]
        found = gathered(counts.filter("bucket >= 0").filter(F.col("lang").between(own[0], own[-1])))
        matrix = np.full((BUCKETS, len(own)), smoothing)
        place = {name: i for i, name in enumerate(own)}
        matrix[found["bucket"].astype(int), [place[x] for x in found["lang"].tolist()]] += found["n"]
        blocks.append(np.log(matrix / matrix.sum(axis=0)).astype(np.float32))
    drop_table(counts)
    share = np.array([docs[x] for x in languages], float)
    return LanguageModel(languages, blocks, np.log(share / share.sum()) if languages else share)


def score_texts(column: pa.Array, model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """For each text the number of the most probable language (-1: no letter, or a model of no language) and its posterior
    probability (then 0). The sparse counts are multiplied with the matrix some thousand entries at a time."""
    rows, languages = len(column), len(model.languages)
    sums, lettered = np.zeros((rows, languages)) + model.log_prior, np.zeros(rows, bool)
    for low, has_letter, row, bucket, n in sparse_counts(column):
        lettered[low : low + len(has_letter)] |= has_letter
        for cut in range(0, len(row), 1 << 14):
            part = slice(cut, cut + (1 << 14))
            own = row[part]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            for k, block in enumerate(model.blocks):
                to = slice(k * LANGUAGE_BLOCK, k * LANGUAGE_BLOCK + block.shape[1])
                sums[low + own[first], to] += np.add.reduceat(block[bucket[part]] * n[part, None], first, axis=0, dtype=np.float64)
    if not languages:
        return np.full(rows, -1), np.zeros(rows)
    best = sums.argmax(axis=1)
    score = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
    return np.where(lettered, best, -1), np.where(lettered, score, 0.0)


def predict(documents: DataFrame, model: LanguageModel, keep: list[str]) -> DataFrame:
    """The columns `keep` of the documents with lang_pred and score (0 to 1), which replace columns of these names.

    A text that is null or has no letter gives `und` and 0, as does any text under a model of no language. Rows that repeat a
    doc_id, and those without one, are predicted each for itself; an empty table gives an empty result. A text of any length is
    read whole, LONG bytes at a time."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in keep if c not in ("lang_pred", "score")]
    (text,) = free(documents, "text_")
    rows = documents.select(*map(quoted, keep), F.col("text").alias(text))
    schema = ", ".join([*(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "lang_pred string, score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*shared.value.languages, UNDETERMINED], pa.string())
        for batch in batches:
            best, scores = score_texts(batch.column(batch.num_columns - 1), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], names.take(pa.array(np.where(best < 0, len(names) - 1, best))), pa.array(scores)], names=[*keep, "lang_pred", "score"])
        release()

    return spread(rows).mapInArrow(run, schema)


def recognised(documents: DataFrame, model: LanguageModel, least: float) -> DataFrame:
    """The documents, all columns as they are, but those without a letter or whose best language has a posterior probability
    under `least`. The decision rests on the text alone, so hashes of it name the rows that go: texts are neither sent back from
    workers nor shuffled, but for the few that the sieve of rejected ones hits."""
    names = free(documents, "h1_", "h2_")
    marked = documents.withColumns(dict(zip(names, (F.xxhash64("text"), F.xxhash64(F.lit(7), "text")), strict=True)))
    gone = predict(marked.select(*names, "text"), model, names).filter(f"lang_pred = '{UNDETERMINED}' or score < {least}").select(*names).distinct()
    return without(marked, stage_table(gone, "unrecognised"), names).drop(*names)


def held_out(doc_id: str = "doc_id"):
    """True for the quarter of documents from which nothing is learnt."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, from a model of those that are not held out and have a language."""
    model = fit(documents.filter(~held_out()))
    return predict(documents.withColumn("held_out", held_out()), model, ["doc_id", "held_out"])
