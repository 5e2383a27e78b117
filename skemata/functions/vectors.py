"""Vector expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vector width, and bytes of an md5 digest.
DIMENSIONS = 384
DIGEST_BYTES = 16


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def hash_embedding(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Unit vector made from the md5 digest of the whole text.

    The digest bytes repeat, so the norm is taken over 16 values and scaled.
    """
    digest = F.md5(text.cast("binary"))
    base = F.transform(
        F.sequence(F.lit(0), F.lit(DIGEST_BYTES - 1)),
        lambda i: F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 127.5
        - 1.0,
    )
    repeats = -(-dimensions // DIGEST_BYTES)
    scale = F.nullif(norm(base) * F.sqrt(F.lit(float(dimensions) / DIGEST_BYTES)), F.lit(0.0))
    unit = F.transform(base, lambda v: v / F.coalesce(scale, F.lit(1.0)))
    full = F.flatten(F.array_repeat(unit, repeats))
    return full if dimensions % DIGEST_BYTES == 0 else F.slice(full, 1, dimensions)
