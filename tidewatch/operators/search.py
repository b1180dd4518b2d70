"""Feature-hash vectors and vector search with filters and exact-match boosting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.indicators import has_indicator, indicators, matches, query_indicators

DIMENSION = 384
TOKEN = r"[A-Za-z0-9_\-.:/#]+"
EXACT_SCORE = 1.5


def _bucket(digest: Column, digits: int, dim: int) -> Column:
    """A hexadecimal digest modulo dim. Three times a power of two up to 256 needs the last two digits and the sum of digits (16 leaves 1
    modulo 3); other sizes go by limbs of seven digits."""
    two = dim // 3
    if dim % 3 == 0 and two & (two - 1) == 0 and 2 <= two <= 256:
        low = F.conv(F.substring(digest, digits - 1, 2), 16, 10).cast("int") % two
        ones, twos = (F.lit(digits) - F.length(F.translate(digest, letters, "")) for letters in ("147ad", "258be"))
        inverse = pow(two, -1, 3)
        return (low + two * F.pmod((ones + 2 * twos - low) * inverse, F.lit(3))).cast("long")
    out = F.lit(0).cast("long")
    for at in range(0, digits, 7):
        size = min(7, digits - at)
        out = (out * F.lit(16**size % dim) + F.conv(F.substring(digest, at + 1, size), 16, 10).cast("long")) % dim
    return out


def _sign(digest: Column, digits: int) -> Column:
    return F.when(F.substring(digest, digits, 1).isin(*"13579bdf"), 1.0).otherwise(-1.0)


def weights(rows: DataFrame, key: str, text: str, dim: int = DIMENSION) -> DataFrame:
    """Sparse vectors by signed feature hashing, not yet of unit length: key, bucket, w. Each token adds to two buckets. Texts without
    tokens have no rows. Tokens are counted per row first, so a frequent word is hashed once a text."""
    tokens = rows.select(key, F.explode(matches(F.lower(F.col(text)), TOKEN)).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))
    h1, h2 = F.md5(F.col("token").cast("binary")), F.sha1(F.col("token").cast("binary"))
    hashed = tokens.select(key, "n", h1.alias("h1"), h2.alias("h2"))
    parts = F.explode(F.array(F.struct(_bucket(F.col("h1"), 32, dim).alias("bucket"), (_sign(F.col("h1"), 32) * F.col("n")).alias("w")), F.struct(_bucket(F.col("h2"), 40, dim).alias("bucket"), (_sign(F.col("h2"), 40) * F.col("n")).alias("w"))))
    return hashed.select(key, parts.alias("p")).groupBy(key, F.col("p.bucket").alias("bucket")).agg(F.sum("p.w").alias("w")).filter("w <> 0")


def embed(rows: DataFrame, key: str, text: str, dim: int = DIMENSION) -> DataFrame:
    """The vectors of `weights` at unit length: key, bucket, weight. A row's buckets, `dim` at most, come together once for their norm."""
    each = weights(rows, key, text, dim).groupBy(key).agg(F.collect_list(F.struct("bucket", "w")).alias("v"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return each.select(key, "norm", F.explode("v").alias("x")).select(key, "x.bucket", (F.col("x.w") / F.col("norm")).alias("weight"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double; 0 if either vector is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def search_vectors(vectors: DataFrame, query: DataFrame, k: int = 5, least: float | None = None, where: Column | None = None) -> DataFrame:
    """The k vectors most similar to one query vector (a single row, column `embedding`), by score, ties by id.

    The one-row query is broadcast; the ordering with a limit keeps k rows per task."""
    rows = vectors if where is None else vectors.filter(where)
    one = query.select(F.col("embedding").alias("_query")).limit(1)
    scored = rows.join(F.broadcast(one)).withColumn("score", cosine(F.col("embedding"), F.col("_query"))).drop("_query")
    if least:
        scored = scored.filter(F.col("score") >= least)
    return scored.orderBy(F.desc("score"), "vec_id").limit(k)


def payload_filter(tags: list[str] = (), source: str | None = None, doc_id=None, after=None, before=None) -> Column:
    """All conditions given: each tag, the source, the document, a closed range of published_at_ts."""
    out = F.lit(True)
    for tag in tags:
        out = out & F.array_contains("tags", tag)
    if source is not None:
        out = out & (F.col("source") == source)
    if doc_id is not None:
        out = out & (F.col("doc_id") == doc_id)
    if after is not None:
        out = out & (F.col("published_at_ts") >= after)
    if before is not None:
        out = out & (F.col("published_at_ts") <= before)
    return out


def exact_hits(documents: DataFrame, terms: str) -> DataFrame:
    """doc_id of the documents that hold an indicator of the search string, in any case."""
    wanted = query_indicators(F.lit(terms))
    values = F.filter(F.concat(wanted["cves"], wanted["ips"], wanted["hashes"], wanted["domains"]), lambda v: v != "")
    return documents.filter(F.exists(values, lambda v: F.contains(F.upper("text"), F.upper(v)))).select("doc_id")


def merged(documents: DataFrame, terms: str, scored: DataFrame, k: int, least: float = 0.0, has_ioc: bool = False) -> DataFrame:
    """doc_id, score, stage: exact hits first (score 1.5), then the scored documents (doc_id, score) that reach the least score, and with
    has_ioc hold an indicator themselves; each document once, k in all, by stage, score and doc_id."""
    exact = exact_hits(documents, terms).select("doc_id", F.lit(EXACT_SCORE).alias("score"), F.lit(0).alias("stage"))
    near = scored.filter(F.col("score") >= least).select("doc_id", F.col("score").cast("double").alias("score"), F.lit(1).alias("stage"))
    if has_ioc:
        found = documents.filter(has_indicator(indicators(F.col("text")), F.array().cast("array<string>"))).select("doc_id")
        near = near.join(found, "doc_id", "left_semi")
    first = exact.unionByName(near).groupBy("doc_id").agg(F.min_by(F.struct("score", "stage"), "stage").alias("h"))
    return first.select("doc_id", "h.score", "h.stage").orderBy("stage", F.desc(F.round("score", 9)), "doc_id").limit(k)


def hybrid_search(documents: DataFrame, terms: str, k: int = 10, least: float = 0.0, vectors: DataFrame | None = None, has_ioc: bool = False) -> DataFrame:
    """doc_id, score, stage: documents that hold an indicator of the search string first (score 1.5), then by cosine of
    feature-hash vectors; each document once, k in all. Give the stored vectors (`embed` of the documents) where there are many
    searches: without them each search hashes the whole corpus."""
    spark = documents.sparkSession
    query = spark.range(1).select(F.lit(-1).cast("long").alias("doc_id"), F.lit(terms).alias("text"))
    q = embed(query, "doc_id", "text").select("bucket", F.col("weight").alias("q"))  # two buckets a word of the search string
    vectors = embed(documents, "doc_id", "text") if vectors is None else vectors
    near = vectors.join(F.broadcast(q), "bucket").groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("q")).alias("score"))
    return merged(documents, terms, near, k, least, has_ioc)


def hybrid_score(dense: Column, sparse: Column, exact: Column, age_days: Column, rate: float = 0.05) -> Column:
    """0.6 dense + 0.4 sparse + 1 per exact hit, plus a bonus that decays with age."""
    return 0.6 * dense + 0.4 * sparse + exact.cast("double") + F.exp(-rate * age_days)
