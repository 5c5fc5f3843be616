"""Vector arithmetic on array columns, as built-in higher-order functions over doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(x: Column) -> Column:
    return x.cast("double")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: _d(x) * _d(y)), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + _d(x) * _d(x)))


def cosine(a: Column, b: Column) -> Column:
    """Null if a norm is 0."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine(a, b)


def negative_inner_product(a: Column, b: Column) -> Column:
    return -dot(a, b)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (_d(x) - _d(y)) * (_d(x) - _d(y))), F.lit(0.0), lambda s, x: s + x))


def normalize(a: Column, eps: float = 1e-12) -> Column:
    """The norm is bound to a lambda's variable, so it is computed once and not for each element."""
    return F.get(F.transform(F.array(F.greatest(norm(a), F.lit(eps))), lambda n: F.transform(a, lambda x: _d(x) / n)), F.lit(0))


def truncate(a: Column, n: int) -> Column:
    """The first n dimensions, not normalised again."""
    return F.slice(a, 1, n)


def finite(x: Column) -> Column:
    return ~(F.isnan(_d(x)) | (F.abs(_d(x)) == float("inf")))


def validate(values, dim: int, name: str = "embedding") -> list[float]:
    """A request's vector as floats; raises with a message where it has another size or numbers that aren't finite."""
    import math

    if not isinstance(values, (list, tuple)) or not all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values):
        raise ValueError(f"{name} must be an array of numbers")
    if len(values) != dim:
        raise ValueError(f"{name} must have {dim} dimensions, received {len(values)}")
    if not all(map(math.isfinite, values)):
        raise ValueError(f"{name} must contain only finite numbers")
    return [float(v) for v in values]


def masked_mean(states: Column, mask: Column) -> Column:
    """Mean pooling: the mean of the token states (an array of vectors) whose mask isn't 0; zeros where there is none."""
    kept = F.transform(F.filter(F.arrays_zip(states.alias("state"), mask.alias("mask")), lambda t: t["mask"] != 0), lambda t: t["state"])
    places = F.sequence(F.lit(1), F.size(F.get(states, F.lit(0))))
    n = F.greatest(F.size(kept), F.lit(1))
    return F.get(F.transform(F.array(kept), lambda k: F.transform(places, lambda i: F.aggregate(k, F.lit(0.0), lambda s, v: s + _d(F.get(v, i - 1))) / n)), F.lit(0))


def sanitize(a: Column) -> tuple[Column, Column]:
    """NaN and infinities as 0, and whether there were any."""
    return F.transform(a, lambda x: F.when(finite(x), _d(x)).otherwise(0.0)), F.exists(a, lambda x: ~finite(x))


def parse(s: Column) -> Column:
    """[v1,v2,...] as array of double; entries that aren't finite numbers are left out; another form is empty."""
    body = F.regexp_extract(F.trim(s), r"^\[(.*)\]$", 1)
    values = F.transform(F.split(body, ","), lambda x: F.trim(x).try_cast("double"))
    return F.when(F.trim(s).rlike(r"^\[.*\]$"), F.filter(values, lambda x: x.isNotNull() & finite(x))).otherwise(F.array().cast("array<double>"))


def fixed(x: Column, digits: int) -> Column:
    """A number with so many decimals, as C's printf: the double's exact value rounded, ties to the even digit. (format_string rounds the shortest
    decimal form, ties up.) Digits after the 17th are zeros; null stays null."""
    x = _d(x)
    odd = F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
    return F.when(x.isNotNull(), F.coalesce(odd, F.call_function("format_number", x, F.lit("0." + "0" * digits))))


def joined(a: Column, digits: int = 6) -> Column:
    return F.array_join(F.transform(a, lambda x: fixed(x, digits)), ",")


def render(a: Column, digits: int = 8) -> Column:
    return F.concat(F.lit("["), joined(a, digits), F.lit("]"))


def derive_hnsw(explicit: Column, embedding: Column, dim: int, hnsw_dim: int) -> Column:
    """The explicit vector, else the embedding's first hnsw_dim dimensions."""
    if dim < hnsw_dim:
        raise ValueError("embedding dimension cannot be smaller than embeddingHnsw dimension")
    return F.coalesce(explicit, truncate(embedding, hnsw_dim))


def backfill_hnsw(embedding: Column, legacy: Column, dim: int, hnsw_dim: int) -> Column:
    """Null unless the source has dim or hnsw_dim dimensions and at least hnsw_dim."""
    source = F.coalesce(embedding, legacy)
    fits = (F.size(source).isin(dim, hnsw_dim)) & (F.size(source) >= hnsw_dim)
    return F.when(source.isNotNull() & fits, truncate(source, hnsw_dim))
