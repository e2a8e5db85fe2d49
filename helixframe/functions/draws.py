"""Multinomial draws as column expressions, by a generator that counts: a key's draw is the same wherever it is made."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numerics import bind

#: Below this mean a binomial is drawn by its exact sums, of which so many are enough for any uniform number of 52 bits.
SMALL, SUMS = 30.0, 120


def uniform(key: Column) -> Column:
    """A number between 0 and 1 by the first 52 bits of the key's MD5."""
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _by_sums(n: Column, q: Column, u: Column) -> Column:
    """The least k whose binomial sum reaches ``u``."""
    none = F.exp(n * F.ln(1 - q))

    def step(s: Column, t: Column) -> Column:
        term = s["term"] * (n - t + 1) / t * (q / (1 - q))
        return F.when(u > s["total"], F.struct(term.alias("term"), (s["total"] + term).alias("total"), t.alias("k"))).otherwise(s)

    start = F.struct(none.alias("term"), none.alias("total"), F.lit(0).cast("long").alias("k"))
    return F.least(F.aggregate(F.sequence(F.lit(1).cast("long"), F.lit(SUMS - 1).cast("long")), start, step)["k"], n.cast("long"))


def _by_normal(n: Column, q: Column, u: Column, v: Column) -> Column:
    """A normal draw with the binomial's mean, deviation and skewness, rounded."""

    def of(z: Column) -> Column:
        x = F.floor(n * q + F.sqrt(n * q * (1 - q)) * z + (1 - 2 * q) * (z * z - 1) / 6 + 0.5)
        return F.greatest(F.lit(0.0), F.least(x.cast("double"), n)).cast("long")

    return bind(F.sqrt(-2 * F.ln(u)) * F.cos(2 * pi * v), of)


def binomial(n: Column, share: Column, rest: Column, key: Column) -> Column:
    """A draw of how many of ``n`` fall to a cell of ``share`` out of ``rest``: exact for small means, else to the third moment."""

    def of(x: Column) -> Column:
        draw = F.when(x["n"] * x["q"] <= SMALL, _by_sums(x["n"], x["q"], x["u"])).otherwise(_by_normal(x["n"], x["q"], x["u"], x["v"]))
        return bind(draw, lambda d: F.when(x["p"] > 0.5, x["n"].cast("long") - d).otherwise(d))

    p = share.cast("double") / F.when(rest > 0, rest).otherwise(1)
    given = F.struct(n.cast("double").alias("n"), p.alias("p"), F.least(p, 1 - p).alias("q"), uniform(key).alias("u"), uniform(F.concat(key, F.lit("/v"))).alias("v"))
    return F.when((n == 0) | (share == 0), F.lit(0).cast("long")).when(share >= rest, n).otherwise(bind(given, of))


def multinomial(counts: Column, key: Column) -> Column:
    """As many draws as ``counts`` add up to, dealt to its cells by their shares, one binomial after the other."""

    def step(s: Column, x: Column) -> Column:
        drawn = binomial(s["n"], x["c"], s["rest"], F.concat(key, F.lit("/"), x["k"].cast("string")))
        return bind(drawn, lambda d: F.struct((s["n"] - d).alias("n"), (s["rest"] - x["c"]).alias("rest"), F.array_append(s["out"], d).alias("out")))

    def of(total: Column) -> Column:
        start = F.struct(total.alias("n"), total.alias("rest"), F.array().cast("array<long>").alias("out"))
        return F.aggregate(F.transform(counts, lambda c, k: F.struct(c.alias("c"), k.alias("k"))), start, step)["out"]

    return bind(F.aggregate(counts, F.lit(0).cast("long"), lambda a, c: a + c), of)
