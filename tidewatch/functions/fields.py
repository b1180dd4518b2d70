"""Small column functions on payload fields, scores, products, prices and times."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .classify import severity

EMPTY = "array<string>"


def zero_vector(size: int) -> Column:
    """A vector of zeros, for points that have no model yet."""
    return F.array_repeat(F.lit(0.0), size)


def checked_vector(vector: Column, size: int) -> Column:
    """The vector; a row of another size fails the query. The check is part of the value, so it cannot be pruned while that is used."""
    message = F.concat(F.lit(f"a vector of {size} components is expected, found "), F.size(vector).cast("string"))
    return F.when(F.size(vector) == size, vector).otherwise(F.raise_error(message))


def match_any(field: Column, values: list, is_list: bool) -> Column:
    """Whether a field (a list, or a single value) has any of the values."""
    wanted = F.array(*map(F.lit, values))
    found = F.arrays_overlap(field, wanted) if is_list else F.array_contains(wanted, field)
    return F.coalesce(found, F.lit(False))


def without_null_times(payload: Column) -> Column:
    """A map without the entries whose key ends in _ts and whose value is null; other nulls stay."""
    return F.map_filter(payload, lambda k, v: ~(k.endswith("_ts") & v.isNull()))


def tag_list(value: Column, kind: str) -> Column:
    """Tags as a list: a list stays, a single value (of Spark type `kind`) becomes the only entry, null gives an empty list."""
    if kind.startswith("array"):
        return F.coalesce(value.cast(EMPTY), F.array().cast(EMPTY))
    return F.when(value.isNull(), F.array().cast(EMPTY)).otherwise(F.array(value.cast("string")))


def map_update(left: Column, right: Column) -> Column:
    """Both maps' entries; where both have a key, the right one's value."""
    mine = F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k))
    return F.when(left.isNull(), right).when(right.isNull(), left).otherwise(F.map_concat(mine, right))


def relevance_band(score: Column) -> Column:
    """primary from 0.95, related from 0.7, contextual from 0.3, else reference."""
    return F.when(score >= 0.95, "primary").when(score >= 0.7, "related").when(score >= 0.3, "contextual").otherwise("reference")


def enriched(score: Column, found: Column, cut: float = 0.5) -> Column:
    """A severity for ids that are relevant enough, NOT_ENRICHED for the others."""
    return F.when(score >= cut, F.coalesce(found, F.lit("UNKNOWN"))).otherwise("NOT_ENRICHED")


def v2_severity(score: Column) -> Column:
    return F.when(score >= 7, "HIGH").when(score >= 4, "MEDIUM").otherwise("LOW")


def cvss(v31: Column, v31_name: Column, v3: Column, v3_name: Column, v2: Column) -> Column:
    """score and severity from the newest version that has a score other than 0; names that are none of the four give way to buckets."""
    has = lambda c: F.coalesce(c, F.lit(0.0)) != 0
    score = F.when(has(v31), v31).when(has(v3), v3).when(has(v2), v2).otherwise(0.0)
    name = F.when(has(v31), v31_name).when(has(v3), v3_name).when(has(v2), v2_severity(v2))
    up = F.upper(name)
    return F.struct(score.alias("score"), F.when(up.isin("CRITICAL", "HIGH", "MEDIUM", "LOW"), up).otherwise(severity(score)).alias("severity"))


def title_case(text: Column) -> Column:
    """Each run of letters with its first one in capitals, whatever stands between."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0)), F.initcap), "")


def cpe_fields(criteria: Column, deprecated: Column | None = None) -> Column:
    """vendor, product, version, update and a readable name of a platform id (format 2.3); null for others and deprecated ones. The
    name is null for wildcards, and so are version and update."""
    at = lambda k: F.split_part(criteria, F.lit(":"), F.lit(k))
    star = lambda c: F.when((c != "*") & (c != ""), c)
    vendor, product = at(4), at(5)
    named = star(vendor).isNotNull() & star(product).isNotNull()
    name = F.when(named, F.concat(title_case(vendor), F.lit(" "), title_case(product)))
    good = criteria.startswith("cpe:2.3:") & (F.size(F.split(criteria, ":")) >= 6)
    if deprecated is not None:
        good = good & ~F.coalesce(deprecated, F.lit(False))
    return F.when(good, F.struct(vendor.alias("vendor"), product.alias("product"), star(at(6)).alias("version"), star(at(7)).alias("update"), name.alias("name")))


def patch_likely(published: Column, as_of: Column) -> Column:
    """Whether an id was published more than 30 days before; null times say no."""
    return F.coalesce(F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(published)) / 86400) > 30, F.lit(False))


def model_cost(model: Column, prompt: Column, completion: Column) -> Column:
    """Cost of a call by the model's name, from prices of a thousand tokens in and out."""
    _, low, high = P.MODEL_PRICES[0]
    out = (prompt * low + completion * high) / 1000
    for word, low, high in reversed(P.MODEL_PRICES):
        out = F.when(F.contains(F.lower(model), F.lit(word)), (prompt * low + completion * high) / 1000).otherwise(out)
    return out


def seconds_of(text: Column, dates: tuple[str, ...] = ()) -> Column:
    """Unix seconds of an ISO time (with Z, an offset, or none for UTC; a date counts from midnight) or of a time in one of the
    formats given; null for others and for blanks."""
    clean = F.regexp_replace(F.trim(text), "[zZ]$", "+00:00")
    tries = [F.try_to_timestamp(clean), *(F.try_to_timestamp(F.trim(text), F.lit(f)) for f in dates)]
    return F.unix_timestamp(F.coalesce(*tries))


def epoch_seconds(value: Column) -> Column:
    """Unix seconds of a number of seconds or milliseconds, or of an ISO time."""
    number = value.try_cast("double")
    return F.when(number > 1e11, F.floor(number / 1000)).when(number.isNotNull(), F.floor(number)).otherwise(seconds_of(value)).cast("long")


def token_limit(agent: str, settings: dict[str, str] | None = None) -> int:
    """Tokens that an agent's input may have: the setting of its name, or the default; what is no number counts as not set."""
    setting = (settings or {}).get(P.TOKEN_SETTINGS.get(agent, P.TOKEN_SETTINGS["general"]))
    default = P.TOKEN_LIMITS.get(agent, P.TOKEN_LIMITS["general"])
    return int(setting) if setting and setting.strip().lstrip("+-").isdigit() else default


def merged(*lists: Column) -> Column:
    """Lists put together, nulls as empty."""
    return F.concat(*(F.coalesce(x, F.array().cast(EMPTY)) for x in lists))


def known(value: Column, names: tuple[str, ...], default: str) -> Column:
    """The value in lower case if it is one of the names, else the default."""
    low = F.lower(F.trim(value))
    return F.when(low.isin(*names), low).otherwise(default)


def any_of(*flags: Column) -> Column:
    return reduce(lambda a, b: a | b, flags)
