"""Randomness as a function of a seed, a row key and a slot: the same on every run, partitioning and retry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column | str) -> Column:
    """In [0, 1): the upper 53 bits of a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / F.lit(float(1 << 53))


def pick(options: list, seed: int, *keys: Column | str) -> Column:
    """One of the values, all alike in chance."""
    return F.element_at(F.array(*[F.lit(o) for o in options]), (F.floor(uniform(seed, *keys) * len(options)) + 1).cast("int"))


def weighted(options: list[tuple], seed: int, *keys: Column | str) -> Column:
    """One of the values (value, weight) by weight."""
    total, at, out = float(sum(w for _, w in options)), 0.0, None
    u = uniform(seed, *keys)
    for value, weight in options[:-1]:
        at += weight / total
        out = F.when(u < at, F.lit(value)) if out is None else out.when(u < at, F.lit(value))
    return F.lit(options[-1][0]) if out is None else out.otherwise(F.lit(options[-1][0]))


def rank_key(seed: int, *keys: Column | str) -> Column:
    """An order that SQL engines share: the hex digest of the seed and the keys."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]), 256)
