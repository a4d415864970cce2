"""Vector expressions on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def bound(value: Column, use) -> Column:
    """`use` of a value that is computed once, however often a lambda inside looks at it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def unit(a: Column) -> Column:
    return bound(a, lambda v: bound(norm(v), lambda n: F.transform(v, lambda x: x.cast("double") / F.greatest(n, F.lit(1e-12)))))


def mean_pool(tokens: Column, mask: Column) -> Column:
    """Masked mean of token vectors (array of arrays, array of 0/1), then of unit length."""
    used = F.filter(F.arrays_zip(tokens.alias("v"), mask.alias("m")), lambda t: t["m"] > 0)
    width = F.size(F.element_at(tokens, 1))
    total = lambda u: F.aggregate(u, F.array_repeat(F.lit(0.0), width), lambda s, t: F.zip_with(s, t["v"], lambda a, b: a + b.cast("double")))
    return bound(used, lambda u: bound(total(u), lambda s: unit(F.transform(s, lambda x: x / F.greatest(F.size(u), F.lit(1e-9))))))


def cls_pool(tokens: Column) -> Column:
    """The first token's vector, of unit length."""
    return unit(F.element_at(tokens, 1))


def memory_estimate(model_bytes: Column, tokens: Column, width: int) -> Column:
    """Bytes that embedding a batch takes: model, activations, a fixed reserve."""
    return model_bytes + tokens * width * 4 * 16 + 512 * 1024 * 1024
