"""Samples that aren't graphs: integers, points on and in spheres, Dirichlet vectors. Draws are hashes of the seed and the row."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.plans.random_graphs import uniform

#: Tries for a gamma variate; each fails with a chance under 0.05.
TRIES = 24


def normal(*what) -> Column:
    """A standard normal variate, by Box and Muller."""
    return F.sqrt(-2 * F.log(uniform(*what, 1))) * F.cos(2 * math.pi * uniform(*what, 2))


def random_sample(spark: SparkSession, low: int, high: int, length: int, seed: int = 0) -> DataFrame:
    """(x): ``length`` distinct integers from low to high, each set equally likely: a permutation of the interval, by four Feistel rounds over the next power of four and walks back into it, of 0 .. length - 1."""
    size = high - low + 1
    if not 0 <= length <= size:
        raise ValueError("more than the interval has")
    half = max(1, (max(1, size - 1).bit_length() + 1) // 2)

    def mixed(x: Column) -> Column:
        left, right = F.shiftright(x, half), x.bitwiseAND((1 << half) - 1)
        for r in range(4):
            left, right = right, left.bitwiseXOR(F.pmod(F.xxhash64(right, F.lit(r), F.lit(seed)), F.lit(1 << half)))
        return F.shiftleft(left, half).bitwiseOR(right)

    # a value outside the interval is permuted on until it is inside; each step is inside with a chance of a quarter at least
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(200)), mixed(F.col("id")), lambda a, _: F.when(a >= size, mixed(a)).otherwise(a))
    return spark.range(length).select((walked + low).alias("x"))


def _directions(spark: SparkSession, dims: int, n: int, seed: int, positive: bool) -> DataFrame:
    if dims < 1:
        raise ValueError("a sphere has one dimension at least")
    drawn = F.transform(F.sequence(F.lit(1), F.lit(dims)), lambda k: normal(F.col("id"), k, seed))
    drawn = F.transform(drawn, F.abs) if positive else drawn
    t = spark.range(n).select("id", drawn.alias("x"))
    return t.withColumn("norm", F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, x: s + x * x)))


def sample_sphere_surface(spark: SparkSession, dims: int, n: int, radius: float = 1.0, positive: bool = False, seed: int = 0) -> DataFrame:
    """(id, x): n points on a sphere, in the positive part only if asked for."""
    return _directions(spark, dims, n, seed, positive).select("id", F.transform("x", lambda x: x * radius / F.col("norm")).alias("x"))


def sample_sphere_volume(spark: SparkSession, dims: int, n: int, radius: float = 1.0, positive: bool = False, seed: int = 0) -> DataFrame:
    """(id, x): n points in a ball: directions, at a root of a uniform draw."""
    far = F.pow(uniform(F.col("id"), "far", seed), 1.0 / dims)
    return _directions(spark, dims, n, seed, positive).select("id", F.transform("x", lambda x: x * radius * far / F.col("norm")).alias("x"))


def gamma(shape: float, *what) -> Column:
    """A gamma variate by Marsaglia and Tsang's squeeze: the first of TRIES that is accepted; shapes under one by the power of one more."""
    d = (shape if shape >= 1 else shape + 1) - 1 / 3
    c = 1 / math.sqrt(9 * d)

    def step(found: Column, k: Column) -> Column:
        x = normal(*what, k)
        v = F.pow(1 + c * x, 3)
        ok = (v > 0) & (F.log(uniform(*what, k, "u")) < 0.5 * x * x + d - d * v + d * F.log(F.greatest(v, F.lit(1e-300))))
        return F.when(found.isNull() & ok, d * v).otherwise(found)

    drawn = F.coalesce(F.aggregate(F.sequence(F.lit(1), F.lit(TRIES)), F.lit(None).cast("double"), step), F.lit(d))
    return drawn if shape >= 1 else drawn * F.pow(uniform(*what, "power"), 1 / shape)


def sample_dirichlet(spark: SparkSession, alpha: list[float], n: int, seed: int = 0) -> DataFrame:
    """(id, x): n vectors that sum to 1."""
    if not alpha or min(alpha) <= 0:
        raise ValueError("concentrations must be positive")
    t = spark.range(n).select("id", F.array(*[gamma(float(a), F.col("id"), i, seed) for i, a in enumerate(alpha)]).alias("x"))
    total = F.aggregate("x", F.lit(0.0), lambda s, x: s + x)
    return t.withColumn("total", total).select("id", F.transform("x", lambda x: x / F.col("total")).alias("x"))
