"""Scalar expressions: vertex references, mixed radix numbers, colours, and draws that don't hang on layout."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def pack_reference(owner: Column, local: Column) -> Column:
    """(owner, local id) in one long, the owner in the high half."""
    return F.shiftleft(owner.cast("long"), 32).bitwiseOR(local.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def reference_owner(reference: Column) -> Column:
    return F.shiftright(reference, 32).cast("int")


def reference_local(reference: Column) -> Column:
    return F.shiftright(F.shiftleft(reference, 32), 32).cast("int")


def reference_name(owner: Column, local: Column) -> Column:
    """`id@owner`; the null reference is `nullnode`."""
    null = owner.isNull() | local.isNull() | ((owner == -1) & (local == -1))
    return F.when(null, F.lit("nullnode")).otherwise(F.concat_ws("@", local.cast("string"), owner.cast("string")))


def encode_radix(digits: Column, base: int) -> Column:
    """Number of an array of digits, the first one least."""
    return F.aggregate(F.reverse(digits), F.lit(0).cast("long"), lambda acc, d: acc * base + d.cast("long"))


def decode_radix(number: Column, base: int, length: int) -> Column:
    """The first `length` digits of a number, the least first."""
    powers = F.array(*[F.lit(base**k).cast("long") for k in range(length)])
    return F.transform(powers, lambda p: F.floor(number / p).cast("long") % base)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.when(whole != 0, 100 * part / whole), digits)


def state_hash(state: Column) -> Column:
    return F.xxhash64(state)


def state_owner(state: Column, parts: int) -> Column:
    """A partition for a state by its hash."""
    return F.pmod(F.xxhash64(state), F.lit(parts)).cast("int")


def size_colour(size: Column, largest: Column) -> Column:
    """A colour name `#rrggbb` from blue (small) to red (as large as the largest)."""
    level = F.round(255 * size / F.greatest(largest, F.lit(1))).cast("int")
    two = lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))
    return F.concat(F.lit("#"), two(level), F.lit("40"), two(F.lit(255) - level))


def uniform(seed: int, *keys: Column | str) -> Column:
    """A draw in [0, 1) from a hash of the keys: the same whatever the partitions."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / F.lit(float(1 << 53))


def normal(seed: int, *keys: Column | str) -> Column:
    """A standard normal draw by the polar transform of two uniform ones."""
    u, v = uniform(seed, F.lit(1), *keys), uniform(seed, F.lit(2), *keys)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)


def log_normal(mu: float, sigma: float, seed: int, *keys: Column | str) -> Column:
    return F.exp(mu + sigma * normal(seed, *keys))


def pareto(xm: float, alpha: float, seed: int, *keys: Column | str) -> Column:
    return xm / F.pow(1 - uniform(seed, *keys), F.lit(1 / alpha))


def between(low: float, high: float, seed: int, *keys: Column | str) -> Column:
    return low + (high - low) * uniform(seed, *keys)


def discrete_between(low: int, high: int, seed: int, *keys: Column | str) -> Column:
    """A whole number from low to high, both included."""
    return F.floor(low + (high - low + 1) * uniform(seed, *keys))


def power_law(low: float, high: float, exponent: float, seed: int, *keys: Column | str) -> Column:
    """A draw with density proportional to x ** exponent between low and high (exponent not -1)."""
    e = exponent + 1
    return F.pow(low**e + (high**e - low**e) * uniform(seed, *keys), F.lit(1 / e))


def binomial_steps(n: int, p: float) -> tuple[int, list[float]]:
    """(least, probabilities of at most least, least + 1, ...) of the binomial law, as far as a draw of 53 bits can tell."""
    if p <= 0 or n <= 0:
        return 0, [1.0]
    if p >= 1:
        return n, [1.0]
    base = math.lgamma(n + 1)
    chance = lambda k: math.exp(base - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    mode = min(n, int((n + 1) * p))
    low = high = mode
    while low > 0 and chance(low - 1) > 1e-20:
        low -= 1
    while high < n and chance(high + 1) > 1e-20:
        high += 1
    each = [chance(k) for k in range(low, high + 1)]
    whole = math.fsum(each)
    out, total = [], 0.0
    for x in each:
        total += x / whole
        out.append(min(total, 1.0))
    out[-1] = 1.0
    return low, out


def binomial(n: int, p: float, seed: int, *keys: Column | str) -> Column:
    """Successes among n trials, by inversion of the law's distribution function for any n: a binary search of one uniform draw."""
    least, steps = binomial_steps(n, p)
    if len(steps) == 1:
        return F.lit(least)
    size = 1 << (len(steps) - 1).bit_length()
    table, draw = F.array(*[F.lit(x) for x in steps]), uniform(seed, *keys)
    halves = F.array(*[F.lit(size >> k) for k in range(1, size.bit_length())])
    at = F.aggregate(halves, F.lit(0), lambda low, h: F.when((low + h < len(steps)) & (F.try_element_at(table, low + h) <= draw), low + h).otherwise(low))
    return F.lit(least) + at


def binomial_by_normal(n: int, p: float, seed: int, *keys: Column | str) -> Column:
    """Successes among n trials by the normal approximation, rounded and kept within 0..n."""
    mean, deviation = n * p, math.sqrt(max(0.0, n * p * (1 - p)))
    return F.least(F.greatest(F.round(mean + deviation * normal(seed, *keys)), F.lit(0.0)), F.lit(float(n)))
