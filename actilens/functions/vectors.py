"""Vector expressions: clipping, seeded noise and masks."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def l2_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x))


def l2_clip(vector: Column, clip_norm: float = 10.0) -> Column:
    """Scale the vector down to ``clip_norm`` when it is longer."""
    bound = max(1e-6, clip_norm)
    norm = l2_norm(vector)
    factor = F.when(norm > bound, F.lit(bound) / norm).otherwise(1.0)
    return F.transform(vector, lambda x: x * factor)


def _uniform(key: Column, position: Column, seed: int, stream: int) -> Column:
    """A number in (0, 1) from the first 52 bits of SHA-256 over seed, stream, key and position: a draw is a function of its
    counter, so a recomputed task, another engine or another machine gets the same."""
    counter = F.concat_ws("|", F.lit(str(seed)), F.lit(str(stream)), key, position.cast("string"))
    bits = F.conv(F.substring(F.sha2(counter, 256), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(2**52)


def laplace_noise(key: Column, position: Column, scale: float, seed: int) -> Column:
    if scale <= 0:
        return F.lit(0.0)
    u = _uniform(key, position, seed, 1) - 0.5
    return -scale * F.signum(u) * F.log(1 - 2 * F.abs(u))


def gaussian_noise(key: Column, position: Column, sigma: float, seed: int) -> Column:
    if sigma <= 0:
        return F.lit(0.0)
    u1, u2 = _uniform(key, position, seed, 2), _uniform(key, position, seed, 3)
    return sigma * F.sqrt(-2 * F.log(u1)) * F.cos(2 * math.pi * u2)


def with_laplace(vector: Column, key: Column, scale: float, seed: int) -> Column:
    return F.transform(vector, lambda x, i: x + laplace_noise(key, i, scale, seed))


def gaussian_mask(vector: Column, key: Column, sigma: float, seed: int) -> Column:
    """A random vector of the same length."""
    return F.transform(vector, lambda _, i: gaussian_noise(key, i, sigma, seed))


def add(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: a + b)
