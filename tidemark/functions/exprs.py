"""Column expressions that stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round2(x: Column) -> Column:
    """Half-away-from-zero to cents in double arithmetic; F.round goes through decimal and differs."""
    return F.signum(x) * F.floor(F.abs(x) * F.lit(100.0) + F.lit(0.5)).cast("double") / F.lit(100.0)


def days_between(start: Column, end: Column) -> Column:
    """Whole days from start to end as bigint."""
    return F.datediff(end, start).cast("bigint")


def to_date_utc(x: Column) -> Column:
    """Calendar date of a timestamp under the session zone, which is pinned to UTC."""
    return x.cast("date")


def md5_mod(text: Column, n: int) -> Column:
    """The MD5 digest of text, read as a little-endian 128-bit integer, modulo n (n < 2^31)."""
    digest = F.md5(text.cast("string"))
    step = (1 << 32) % n
    acc = F.lit(0).cast("bigint")
    for limb in (3, 2, 1, 0):
        pairs = [F.substring(digest, limb * 8 + 2 * k + 1, 2) for k in (3, 2, 1, 0)]
        acc = (acc * F.lit(step) + F.conv(F.concat(*pairs), 16, 10).cast("bigint")) % F.lit(n)
    return acc.cast("int")


def hash_pick(key: Column, tag: str, seed: int, n: int) -> Column:
    """A deterministic draw from 0..n-1 for a key; independent of row order and partitioning."""
    return md5_mod(F.concat(key.cast("string"), F.lit(f"|{tag}|{seed}")), n)
