"""Samples of an exact size, the same on every run and engine: the keys with the smallest seeded hashes."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.sources.scratch import written

#: A hash has so many bits, found out so many at a time; so many keys are sorted at most.
BITS, STEP, SORTED = 48, 12, 10_000


def seeded_hash(key: Column, seed: int) -> Column:
    """The first 48 bits of the MD5 of 'seed:key': other engines have the same function.  NULL is the empty key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, BITS // 4), 16, 10).cast("bigint")


def sample_keys(keys: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n of the distinct rows of a one-column table (all, if fewer), ties to the smaller key.

    Histograms of the hashes' leading bits find the bin in which the n-th smallest lies, then its own bins, until few keys
    are left in it; those alone are sorted.
    """
    (column,) = keys.columns
    hashed = written(keys.distinct().select(column, seeded_hash(F.col(column), seed).alias("__h")), "hashed")
    low, need, shift = 0, n, BITS
    while True:
        inside = hashed.where((F.col("__h") >= low) & (F.col("__h") < low + (1 << shift)))
        if shift == 0 or need <= 0:
            break
        shift -= STEP
        bins = {r["bin"]: r["count"] for r in inside.groupBy(F.shiftright(F.col("__h") - low, shift).alias("bin")).count().collect()}  # 2^STEP rows at most
        at, before = 0, 0
        for b in sorted(bins):
            if before + bins[b] >= need:
                at = b
                break
            before += bins[b]
        else:
            return hashed.select(column)  # fewer than n keys
        low, need = low + (at << shift), need - before
        if bins[at] <= SORTED:
            inside = hashed.where((F.col("__h") >= low) & (F.col("__h") < low + (1 << shift)))
            break
    edge = inside.orderBy("__h", F.col(column).cast("string")).limit(max(0, need))
    return hashed.where(F.col("__h") < low).unionByName(edge).select(column)


def sample_by_key(facts: Mapping[str, DataFrame], dim: DataFrame, key: str, fraction: float, seed: int = 42) -> dict[str, DataFrame]:
    """Facts restricted to one sample of the dimension's keys, rounded up to whole keys, so that all keep the same ones."""
    every = dim.select(key).distinct()
    kept = written(sample_keys(every, math.ceil(round(fraction * every.count(), 9)), seed), "sampled-keys")
    return {name: df.join(kept, key, "left_semi") for name, df in facts.items()}


def bernoulli_sample(df: DataFrame, fraction: float, key: str, seed: int = 42) -> DataFrame:
    """Each row by itself, by the hash of its key: its chance is `fraction`, and the same row always fares alike."""
    return df.where(seeded_hash(F.col(key), seed) < int(fraction * (1 << BITS)))
