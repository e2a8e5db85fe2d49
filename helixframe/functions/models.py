"""Evolutionary distances from 4x4 substitution counts, as column expressions."""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numerics import NAN, bind, c_div, c_ln, not_below_zero
from .sequence import CELLS

MODELS = ("raw", "jc", "kimura", "logdet", "ani")
#: Models that count an equal run by fourths instead of by letters.
BY_FOURTHS = frozenset({"raw", "jc", "kimura"})


def model_name(name: str) -> str:
    """A model's name in lower case; an unknown one raises ValueError."""
    if name.lower() not in MODELS:
        raise ValueError(f"unknown model {name!r}: one of {', '.join(MODELS)}")
    return name.lower()


def _cells(counts: Column) -> dict[str, Column]:
    return {c: counts[k].cast("double") for k, c in enumerate(CELLS)}


def _sum(xs: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, xs)


def total(counts: Column) -> Column:
    return _sum([counts[k] for k in range(len(CELLS))])


def coverage(counts: Column, seq_len: Column) -> Column:
    """Compared letters over the query's length."""
    return c_div(total(counts), seq_len)


def raw(counts: Column) -> Column:
    """Share of differing letters; NaN below four compared letters."""
    c = _cells(counts)
    return F.when(total(counts) <= 3, F.lit(NAN)).otherwise(c_div(_sum([c[k] for k in CELLS if k[0] != k[1]]), total(counts)))


def jc(counts: Column) -> Column:
    """Jukes-Cantor: above a raw distance of 3/4 NaN, at it infinity."""
    return not_below_zero(F.lit(-0.75) * c_ln(F.lit(1.0) - F.lit(4.0 / 3.0) * raw(counts)))


def kimura(counts: Column) -> Column:
    """Kimura's two parameters: transitions (A-G, C-T) and transversions."""
    c, n = _cells(counts), total(counts)
    transitions = ("AG", "GA", "CT", "TC")
    p = c_div(_sum([c[k] for k in transitions]), n)
    q = c_div(_sum([c[k] for k in CELLS if k[0] != k[1] and k not in transitions]), n)

    def of_shares(v: Column) -> Column:
        rest = F.lit(1.0) - F.lit(2.0) * v["p"] - v["q"]
        return F.lit(-0.25) * c_ln((F.lit(1.0) - F.lit(2.0) * v["q"]) * rest * rest)

    return not_below_zero(bind(F.struct(p.alias("p"), q.alias("q")), of_shares))


def _determinant(c: dict[str, Column]) -> Column:
    """The 4x4 determinant as its 24 signed products, whole-number letters in their order."""
    terms = []
    for order in permutations(range(4)):
        sign = (-1) ** sum(order[i] > order[j] for i in range(4) for j in range(i + 1, 4))
        product = reduce(lambda a, b: a * b, [c["ACGT"[i] + "ACGT"[j]] for i, j in enumerate(order)])
        terms.append(product * F.lit(float(sign)))
    return _sum(terms)


def logdet(counts: Column) -> Column:
    """Paralinear (LogDet) distance; no least number of letters."""

    def of_shares(p: Column) -> Column:
        c = {k: p[i] for i, k in enumerate(CELLS)}
        margins = [c_ln(_sum([c[k] for k in CELLS if k[side] == x])) for side in (0, 1) for x in "ACGT"]
        return F.lit(-0.25) * (c_ln(_determinant(c)) - F.lit(0.5) * _sum(margins))

    return not_below_zero(bind(bind(total(counts), lambda n: F.transform(counts, lambda c: c_div(c, n))), of_shares))


def ani(counts: Column) -> Column:
    """Average nucleotide identity in percent: more is nearer."""
    return (F.lit(1.0) - raw(counts)) * F.lit(100.0)


def distance(model: str, counts: Column) -> Column:
    return {"raw": raw, "jc": jc, "kimura": kimura, "logdet": logdet, "ani": ani}[model_name(model)](counts)
