"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, free, id_bit, quoted, sieve_words, sieved, spread, stage_table, without
from .sharded_grams import GramModel, count_grams, fit_grams, score_grams

#: Characters of average text that are added to each document, so that short ones need strong evidence.
PRIOR_CHARS = 120.0
#: Quantile of trusted held-out perplexity, per language, and the factor on it above which a document is rejected.
QUANTILE = 0.999
MARGIN = 1.05
#: Held-out documents of a language that weigh as much as the limit of all languages together.
SHRINKAGE = 10.0


def discounts(n: dict[int, int]) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from how many grams were counted once, twice, three and four times."""
    n1, n2, n3, n4 = (max(1, n.get(i, 0)) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    bound = lambda k, d: min(max(d, 0.05), k - 0.05)
    return bound(1, 1 - 2 * y * n2 / n1), bound(2, 2 - 3 * y * n3 / n2), bound(3, 3 - 4 * y * n4 / n3)


@dataclass
class QualityModel:
    grams: GramModel
    typical: float  # mean negative log probability of a trusted symbol
    limits: DataFrame | None  # lang and limit, the greatest accepted log perplexity, of every language held out
    default: float


def shrunk(typical: float):
    """Log perplexity with PRIOR_CHARS symbols of typical text added."""
    return (F.col("nll") + F.lit(PRIOR_CHARS * typical)) / (F.col("n_symbols") + F.lit(PRIOR_CHARS))


def language(column: str = "lang"):
    return F.coalesce(F.col(column), F.lit("und"))


def fit(trusted: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> QualityModel:
    """A model of trusted documents (doc_id, text, lang). All of them are counted. A model of one half, by hashed id, scores
    the other half, whose quantile of perplexity per language is the limit.

    Every language has its own limit, moved towards the one of all by SHRINKAGE documents: the fewer it has, the further.
    Without trusted text every document is accepted."""
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    counts = stage_table(count_grams(trusted, half), "counts")
    other = trusted.filter(half == 1).select("text", language().alias("lang"))
    of_half = fit_grams(counts.filter("n0 > 0").select("gram", F.col("n0").alias("n")), discounts)
    scored = stage_table(score_grams(other, of_half, ["lang"]), "held-out")
    drop_table(of_half.table)
    del of_half  # its rows in the driver make room for the next model's
    grams = fit_grams(counts.select("gram", (F.col("n0") + F.col("n1")).alias("n")), discounts)
    drop_table(counts)
    sums = scored.agg(F.sum("nll").alias("nll"), F.sum("n_symbols").alias("n")).first()
    if not sums["n"]:
        return QualityModel(grams, 0.0, None, float("inf"))
    typical = sums["nll"] / sums["n"]
    limit = (F.percentile_approx(shrunk(typical), quantile, 100000) + float(np.log(margin))).alias("limit")
    overall = scored.agg(limit).first()["limit"]
    own = scored.groupBy("lang").agg(F.count("*").alias("n"), limit)
    mixed = (F.col("n") * F.col("limit") + F.lit(SHRINKAGE * overall)) / (F.col("n") + F.lit(SHRINKAGE))
    return QualityModel(grams, typical, stage_table(own.select("lang", mixed.alias("limit")), "limits"), overall)


def classify(documents: DataFrame, model: QualityModel, keep: list[str]) -> DataFrame:
    """The columns `keep` with n_symbols, log_perplexity, limit and accepted, which replace columns of these names.

    Empty and null texts have typical perplexity and so are accepted; unknown and null languages have the limit of all. A null
    doc_id and rows that repeat one are scored like any other row. An empty table gives an empty result. Texts of any length
    are scored whole; one that is longer than a run is a run of its own."""
    keep = [c for c in keep if c not in ("n_symbols", "nll", "log_perplexity", "limit", "accepted")]
    lang, own = free(documents, "lang_", "own_")
    scored = score_grams(documents.select(*(quoted(c) for c in dict.fromkeys([*keep, "text"])), language().alias(lang)), model.grams, [*keep, lang])
    out = scored.withColumn("log_perplexity", shrunk(model.typical)).withColumn("limit", F.lit(model.default))
    if model.limits is not None:
        limits = model.limits.select(F.col("lang").alias(lang), F.col("limit").alias(own))
        out = out.join(limits, lang, "left").withColumn("limit", F.coalesce(own, "limit")).drop(own)
    return out.withColumn("accepted", F.col("log_perplexity") <= F.col("limit")).drop("nll", lang)


def accepted(documents: DataFrame, model: QualityModel) -> DataFrame:
    """The documents, all columns as they are, without those that classify rejects.

    The decision rests on text and language alone. So hashes of these name the rejected rows, and texts are neither sent back
    from workers nor shuffled, but for the few that the sieve of rejected ones hits."""
    names = free(documents, "h1_", "h2_", "of_")
    marked = documents.withColumns(dict(zip(names, (F.xxhash64("text"), F.xxhash64(F.lit(7), "text"), language()), strict=True)))
    gone = classify(marked.select(*names, "text", "lang"), model, names).filter("not accepted").select(*names).distinct()
    return without(marked, stage_table(gone, "rejected"), names).drop(*names)


def trusted_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, lang of documents that a label calls good, without shuffling their texts.

    A first sieve holds the good ids; a second one those ids of documents that pass the first but are not good (found by a
    join of ids alone). A document in the first and not in the second is good for certain; only the few in both are joined."""
    good = stage_table(labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "good")
    docs = spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").filter("doc_id is not null"))
    first = sieve_words(good.select(id_bit("doc_id")))
    ids = sieved(documents.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null"), "doc_id", first)
    second = sieve_words(ids.join(good, "doc_id", "left_anti").select(id_bit("doc_id")))
    certain = sieved(docs, "doc_id", first, second)
    return certain.unionByName(sieved(docs, "doc_id", first, second, within=True).join(good, "doc_id", "left_semi"))
