"""Mixing sources to target weights: iterative proportional fitting of token weights, then calibrated sampling.

Documents are counted by cell, that is by source, language and topic. Raking scales the cells' token weights until each
of the three marginals has its target shares. A cell's weight over its tokens, times a common factor, is the probability with
which each of its documents is kept. The factor is the one that keeps a given share of all tokens; cells that are asked
for more than they have are kept whole. The draw is a hash of the document, so it repeats.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_materialized, free_prefix, materialize

AXES = ("source", "lang", "topic")
ROUNDS, TOLERANCE, SEED = 60, 1e-6, 23
#: Cells beyond this many are raked by Spark instead of numpy on the driver.
DRIVER_CELLS = 50_000
#: Share of all tokens that is kept.
KEEP = 0.6
#: Without given targets an axis aims at the observed shares to this power, which lifts its small values.
SMOOTHING = 0.8


def topic() -> Column:
    """A coarse topic by the form of a text, for tables without a topic column."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return (
        F.when(text == "", "empty")
        .when(text.rlike("@[A-Za-z0-9.]+\\.[a-z]{2}|\\+?[0-9]{3}[-) ][0-9 -]{6}"), "contact")
        .when(text.rlike("[0-9]{6}|[=:/][\"/]"), "technical")
        .when(text.rlike("\\|[^|]*\\|"), "table")
        .when(F.length(text) < 600, "short")
        .otherwise("prose")
    )


def tokens() -> Column:
    """Words of a text: its runs of characters other than white space."""
    return F.coalesce(F.regexp_count("text", F.lit("\\S+")), F.lit(0)).cast("long")


def _with_cells(docs: DataFrame, own: str) -> DataFrame:
    """``docs`` with source, lang, topic and tokens, and the keys of a cell, under names that begin with ``own``.

    A key is the value behind =, or empty for null, which is a value of its own.
    """
    values = {a: F.col(a).cast("string") if a in docs.columns else (topic() if a == "topic" else F.lit(None).cast("string")) for a in AXES}
    return docs.select("*", *(v.alias(f"{own}{a}") for a, v in values.items()), *(_key(v).alias(f"{own}key_{a}") for a, v in values.items()), tokens().alias(f"{own}tokens"))


def _key(value: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), value), F.lit(""))


def _value(key: Column) -> Column:
    return F.when(key != "", F.substring(key, 2, 1 << 30))


def rake(seed: np.ndarray, index: np.ndarray, targets: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Weights of cells whose sums along each axis have the ``targets``' shares; index[k]: a cell's value on axis k.

    Values without tokens are left out and the others' targets scaled up. Inconsistent targets settle on the last axis.
    """
    w = seed.astype(float)
    if w.sum() <= 0:
        return np.zeros_like(w)
    for _ in range(rounds):
        before = w.copy()
        for at, goal in zip(index, targets, strict=True):
            now = np.bincount(at, w, len(goal))
            goal = np.where(now > 0, goal, 0.0)
            goal = goal / goal.sum() if goal.sum() > 0 else now / now.sum()
            w = w * np.divide(goal, now, out=np.zeros_like(now), where=now > 0)[at]
        if np.abs(w - before / max(before.sum(), 1e-300)).max() < tolerance * w.max():
            break
    return w


def _shares(total: dict[str, float], given: Mapping[str, float] | None) -> dict[str, float]:
    """Target shares of an axis: those given (others: none), or smoothed ones."""
    return {v: float(given.get(v, 0.0)) for v in total} if given else {v: t**SMOOTHING if t > 0 else 0.0 for v, t in total.items()}


def _rake_on_driver(cells: DataFrame, targets: Mapping[str, Mapping[str, float]]) -> DataFrame:
    rows = cells.orderBy(*(f"__{a}" for a in AXES)).toPandas()
    seed = rows["n"].to_numpy(float)
    index, goals = [], []
    for a in AXES:
        values, at = np.unique(rows[f"__{a}"].to_numpy(str), return_inverse=True)
        share = _shares(dict(zip(values, np.bincount(at, seed, len(values)), strict=True)), targets.get(a))
        index.append(at)
        goals.append(np.array([share[v] for v in values], float))
    rows["weight"] = rake(seed, np.array(index), goals)
    # as Arrow: a list of rows would go through Python workers on the executors, which stay there for a while
    kinds = [*((f"__{a}", pa.string()) for a in AXES), ("n", pa.int64()), ("weight", pa.float64())]
    return cells.sparkSession.createDataFrame(pa.table([pa.array(rows[name], kind) for name, kind in kinds], names=[name for name, _ in kinds]))


def _rake_on_spark(cells: DataFrame, targets: Mapping[str, Mapping[str, float]], rounds: int) -> DataFrame:
    """The same fitting for any number of cells: a sum and a join for each axis, written after each round."""
    spark = cells.sparkSession
    # cells without tokens stay, with weight 0, as on the driver
    now = materialize(cells.withColumn("weight", F.col("n").cast("double")), "cells")
    goals = {}
    for a in AXES:
        k = f"__{a}"
        if targets.get(a):
            goal = spark.createDataFrame([(v, float(t)) for v, t in targets[a].items()], f"{k} string, goal double")
            goal = now.select(k).distinct().join(goal, k, "left").fillna(0.0, ["goal"])
        else:
            goal = now.groupBy(k).agg(F.pow(F.sum("weight"), F.lit(SMOOTHING)).alias("goal"))
        goal = materialize(goal, "goal")
        goals[a] = goal.withColumn("goal", F.col("goal") / F.lit(goal.agg(F.sum("goal")).first()[0] or 1.0))
    for _ in range(rounds):
        new = now.withColumn("old", F.col("weight"))
        for a in AXES:
            k = f"__{a}"
            scale = new.groupBy(k).agg(F.sum("weight").alias("sum")).join(goals[a], k)
            # goals of values whose weight is gone go to the others; without any goal left, shares stay as they are
            there, all_ = scale.filter("sum > 0").agg(F.sum("goal"), F.sum("sum")).first()
            share = F.col("goal") / F.lit(there) if there else F.col("sum") / F.lit(all_ or 1.0)
            scale = scale.select(k, F.when(F.col("sum") > 0, share / F.col("sum")).otherwise(0.0).alias("by"))
            new = new.join(scale, k).withColumn("weight", F.col("weight") * F.col("by")).drop("by")
        new = materialize(new, "cells")
        moved, most = new.agg(F.max(F.abs(F.col("weight") - F.col("old"))), F.max("weight")).first()
        drop_materialized(now)
        now = new.drop("old")
        if moved is None or moved < TOLERANCE * most:
            break
    return now


def _factor(cells: DataFrame, keep: float | None, small: bool) -> float:
    """The factor f for which min(1, f * ratio) keeps this share of the tokens; None: the largest that cuts no cell short."""
    most, least, total = cells.agg(F.max("ratio"), F.min(F.when(F.col("ratio") > 0, F.col("ratio"))), F.sum("n")).first()
    if not most:
        return 0.0
    lo, hi = 0.0, 1 / least
    if keep is None:
        return 1 / most
    few = cells.select("n", "ratio").toPandas() if small else None

    def kept(f: float) -> float:
        if few is not None:
            return float((few["n"] * np.minimum(1.0, few["ratio"].fillna(0) * f)).sum())
        return cells.agg(F.sum(F.col("n") * F.least(F.lit(1.0), F.col("ratio") * f))).first()[0]

    for _ in range(40):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if kept(mid) < keep * total else (lo, mid)
        if hi - lo < 1e-6 * hi:
            break
    return hi


def _weights(rows: DataFrame, own: str, targets: Mapping[str, Mapping[str | None, float]] | None, driver_cells: int, keep: float | None) -> DataFrame:
    """(__source, __lang, __topic, n, weight, probability) by cell keys."""
    targets = {a: {"" if v is None else f"={v}": t for v, t in goal.items()} for a, goal in (targets or {}).items()}
    cells = materialize(rows.groupBy(*(F.col(f"{own}key_{a}").alias(f"__{a}") for a in AXES)).agg(F.sum(f"{own}tokens").alias("n")), "cells")
    small = cells.limit(driver_cells + 1).count() <= driver_cells
    raked = _rake_on_driver(cells, targets) if small else _rake_on_spark(cells, targets, ROUNDS)
    raked = materialize(raked.withColumn("ratio", F.when(F.col("n") > 0, F.col("weight") / F.col("n"))).coalesce(8), "ratios")
    factor = _factor(raked, keep, small)
    drop_materialized(cells)
    return raked.withColumn("probability", F.coalesce(F.least(F.col("ratio") * F.lit(factor), F.lit(1.0)), F.lit(1.0))).drop("ratio")


def mixing_weights(docs: DataFrame, targets: Mapping[str, Mapping[str | None, float]] | None = None, driver_cells: int = DRIVER_CELLS, keep: float | None = KEEP) -> DataFrame:
    """(__source, __lang, __topic, n, weight, probability) of each cell; n: tokens, weight: share of the mixture.

    ``targets``: shares of an axis's values (None: of null). ``keep``: the share of tokens to keep, or None for as many as
    leave every share exact. Cells without tokens are kept.
    """
    own = free_prefix(docs.columns)
    found = _weights(_with_cells(docs, own), own, targets, driver_cells, keep)
    return found.select(*(_value(F.col(f"__{a}")).alias(f"__{a}") for a in AXES), "n", "weight", "probability")


def mix_sources(docs: DataFrame, targets: Mapping[str, Mapping[str | None, float]] | None = None, seed: int = SEED, driver_cells: int = DRIVER_CELLS, keep: float | None = KEEP) -> DataFrame:
    """``docs`` with __source, __lang, __topic, __tokens, __probability and __kept (boolean).

    If names of ``docs`` begin with __, the new ones have more underscores (``free_prefix``). The draw depends on doc_id,
    text and ``seed`` alone: repeated rows are kept or left together. Null or empty texts carry no tokens and are kept; a
    null source or language is a value of its own, other than an empty string. An empty table gives an empty one.
    """
    own = free_prefix(docs.columns)
    rows, keys = _with_cells(docs, own), [f"{own}key_{a}" for a in AXES]
    cells = _weights(rows, own, targets, driver_cells, keep).select(*(F.col(f"__{a}").alias(f"{own}key_{a}") for a in AXES), F.col("probability").alias(f"{own}probability"))
    # cells are few (checked): broadcast; otherwise a plain join
    few = cells.limit(driver_cells + 1).count() <= driver_cells
    rows = rows.join(F.broadcast(cells) if few else cells, keys, "left")
    draw = F.pmod(F.xxhash64("doc_id", F.crc32(F.coalesce("text", F.lit(""))), F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return rows.select(*docs.columns, *(f"{own}{a}" for a in AXES), f"{own}tokens", f"{own}probability", (draw < F.col(f"{own}probability")).alias(f"{own}kept"))
