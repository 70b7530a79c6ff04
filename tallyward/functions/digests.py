"""Checksums, fingerprints and reproducible sampling, all from md5.

md5 is used where a result must be reproducible across runs, executors and engines;
it replaces random number generators throughout.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS = 10_000
DRAWS = 1 << 60


def word32(digest: Column) -> Column:
    """First 32 bits of a hex digest as a non-negative bigint."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def hash32(salt: str, key: Column) -> Column:
    return word32(F.md5(F.concat(F.lit(f"{salt}|"), key.cast("string"))))


def hash60(salt: str, key: Column) -> Column:
    """First 60 bits of the salted digest, for draws from tables of any length."""
    digest = F.md5(F.concat(F.lit(f"{salt}|"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def bucket(salt: str, key: Column, buckets: int = BUCKETS) -> Column:
    return hash32(salt, key) % F.lit(buckets)


def sampled(salt: str, key: Column, rate: float | Column) -> Column:
    """Bernoulli sample with the given rate, decided by 60 bits of a hash of the row's own key.

    Where the rate is a column, rows with rate 0 are decided without hashing. A null key is in no sample.
    """
    if isinstance(rate, Column):
        share = (rate.cast("double") * F.lit(float(DRAWS))).cast("bigint")
        return (share > 0) & F.coalesce(hash60(salt, key) < share, F.lit(False))
    return F.coalesce(hash60(salt, key) < F.lit(int(rate * DRAWS)), F.lit(False))


def between(salt: str, key: Column, low: int, high: int) -> Column:
    """Uniform integer in low..high."""
    return bucket(salt, key, high - low + 1) + F.lit(low)


def event_checksum(event_id: Column, customer_id: Column, amount: Column, event_time: Column) -> Column:
    """md5 over the four payload fields; ``amount`` is the canonical text. Null where a field is null."""
    bar = F.lit("|")
    return F.md5(F.concat(event_id, bar, customer_id, bar, amount, bar, event_time))


def row_digest(columns: Sequence[str]) -> Column:
    r"""md5 over ``name=length:value`` items in name order, null written as ``name=\N``.

    The length keeps a separator inside a value, or the text ``\N``, from looking like something else.
    """
    items = []
    for name in sorted(columns):
        value = F.col(f"`{name}`").cast("string")
        tagged = F.concat(F.length(value).cast("string"), F.lit(":"), value)
        items.append(F.concat(F.lit(f"{name}="), F.coalesce(tagged, F.lit("\\N"))))
    return F.md5(F.concat_ws("|", *items))
