"""Column expressions used by the workloads; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The syllables of generated last names, by digit.
NAME_SYLLABLES = ["BAR", "OUGHT", "ABLE", "PRI", "PRES", "ESE", "ANTI", "CALLY", "ATION", "EING"]


def cents(x: Column) -> Column:
    """Money in whole cents, rounded half up."""
    return F.round(x * 100).cast("long")


def last_name(number: Column) -> Column:
    """The three-syllable last name of a number from 0 to 999."""
    syllables = F.array(*map(F.lit, NAME_SYLLABLES))
    digit = lambda d: F.element_at(syllables, ((F.floor(number / F.lit(d)) % F.lit(10)) + F.lit(1)).cast("int"))
    return F.concat(digit(100), digit(10), digit(1))


def pct_change(new: Column, old: Column) -> Column:
    """Percent change, 0 where the old value is 0."""
    return F.when(old != 0, F.lit(100) * (new / old - F.lit(1))).otherwise(F.lit(0.0))


def toggle(x: Column, a: str, b: str) -> Column:
    """Replace a by b where a occurs, else b by a."""
    return F.when(F.instr(x, a) > 0, F.replace(x, F.lit(a), F.lit(b))).otherwise(F.replace(x, F.lit(b), F.lit(a)))


def number_of(ts: Column) -> Column:
    """A timestamp as whole microseconds since 1970."""
    return F.unix_micros(ts)


def time_of(number: Column) -> Column:
    """The timestamp of whole microseconds since 1970."""
    return F.timestamp_micros(number)


def prefix(raw: Column, n: int) -> Column:
    """The first n bytes."""
    return F.substring(raw, 1, n)


def shifted(raw: Column, n: int) -> Column:
    """The bytes without the first n."""
    return F.substring(raw, n + 1, 2**31 - 1)


def random(seed: Column, salt: int) -> Column:
    """A repeatable number in [0, 1) for a whole number and a salt: two steps of a linear congruential generator, which any database can take."""
    step = lambda x: F.pmod(x * F.lit(1103515245) + F.lit(12345), F.lit(2**31))
    return F.pmod(F.shiftright(step(step(F.pmod(seed + F.lit(salt * 7919), F.lit(2**31)))), 8), F.lit(2**20)).cast("double") / F.lit(float(2**20))


def uniform(u: Column, low: int, high: int) -> Column:
    """A key of [low, high] from u in [0, 1)."""
    return (F.floor(u * F.lit(high - low + 1)) + F.lit(low)).cast("long")


def nurand(u: Column, v: Column, a: int, c: int, low: int, high: int) -> Column:
    """The non-uniform key of the order-entry workload: some keys come more often, in a pattern set by a and c."""
    return F.pmod(uniform(u, 0, a).bitwiseOR(uniform(v, low, high)) + F.lit(c), F.lit(high - low + 1)) + F.lit(low)


def hot(u: Column, v: Column, low: int, high: int, share: float = 0.8, part: float = 0.2) -> Column:
    """A key that lies in the first `part` of [low, high] with probability `share`."""
    n = int((high - low + 1) * part)
    return F.when(u < share, uniform(v, low, low + n - 1)).otherwise(uniform(v, low + n, high))


def zipf(u: Column, n: int, theta: float = 0.99) -> Column:
    """A rank of [1, n], rank k with a probability in proportion to about k ** -theta, by inversion in closed form; two sums over n are taken here."""
    zeta = sum(k**-theta for k in range(1, n + 1))
    alpha, eta = 1 / (1 - theta), (1 - (2 / n) ** (1 - theta)) / (1 - (1 + 0.5**theta) / zeta)
    x = F.floor(F.lit(n) * F.pow(F.lit(eta) * u - F.lit(eta) + F.lit(1.0), F.lit(alpha))) + 1
    return F.when(u * zeta < 1, 1).when(u * zeta < 1 + 0.5**theta, 2).otherwise(F.least(x, F.lit(n))).cast("long")
