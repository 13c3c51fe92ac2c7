"""Synthetic rows from models, as pure functions of a row number.

Every value is computed from the row's id, a stream number and a seed, so a
lost partition comes back with the same rows, and any engine with integer
arithmetic can repeat them.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradframe.functions import vec
from gradframe.functions.models import Model
from gradframe.operators.scoring import score

# fixed values: prime moduli and multipliers of two published Lehmer generators
M1, A1 = 2147483647, 48271
M2, A2 = 2147483399, 40692


def uniform(number: Column | str, stream: int | Column, seed: int) -> Column:
    """Uniform in (0, 1) from a row number, a stream number and a seed.

    The part of a row number beyond the modulus enters between two rounds, so rows 2^31
    apart do not repeat; numbers below the modulus are not changed by it.
    """
    n = F.col(number) if isinstance(number, str) else number
    s = stream if isinstance(stream, Column) else F.lit(stream)
    h = F.pmod((F.pmod(n.cast("bigint"), F.lit(M1)) + F.lit(seed % M1 + 1)) * F.lit(A1), F.lit(M1))
    beyond = F.pmod(F.floor(n.cast("bigint") / F.lit(M1)) * F.lit(A1), F.lit(M2))
    h = F.pmod((h + beyond + s.cast("bigint") * F.lit(7919) + F.lit(1)) * F.lit(A2), F.lit(M2))
    h = F.pmod((h + F.lit(seed % M1)) * F.lit(A1), F.lit(M1))
    return (h + F.lit(0.5)) / F.lit(float(M1))


def normal(number: Column | str, stream: int | Column, seed: int) -> Column:
    """Standard normal from two uniforms."""
    s = stream if isinstance(stream, Column) else F.lit(stream)
    radius = F.sqrt(F.lit(-2.0) * F.log(uniform(number, s * 2, seed)))
    return radius * F.cos(F.lit(2 * math.pi) * uniform(number, s * 2 + 1, seed))


def noise(
    number: Column | str,
    kind: str = "none",
    params: tuple[float, ...] = (),
    offset: float = 0.0,
    seed: int = 0,
    stream: int | Column = 0,
) -> Column:
    """``none``, ``exp`` (rate), ``norm`` (mean, std) or ``uni`` (from, to), plus an offset."""
    if kind in ("none", ""):
        return F.lit(float(offset))
    if kind == "exp":
        value = -F.log(uniform(number, stream, seed)) / F.lit(float(params[0]))
    elif kind == "norm":
        value = F.lit(float(params[0])) + F.lit(float(params[1])) * normal(number, stream, seed)
    elif kind == "uni":
        lo, hi = params
        value = F.lit(float(lo)) + F.lit(float(hi - lo)) * uniform(number, stream, seed)
    else:
        raise ValueError(f"unknown noise: {kind}")
    return F.lit(float(offset)) + value


def generate_rows(
    ids: DataFrame, model: Model, w: np.ndarray, sigma: float = 0.0, seed: int = 0
) -> DataFrame:
    """Labelled rows ``(id, x, y)`` for every id.

    x is uniform in (-1, 1), y the class the model gives it; then noise of
    deviation ``sigma`` is added to x (none for 0).
    """
    position = F.sequence(F.lit(0), F.lit(model.inputs - 1))
    draw = F.transform(position, lambda j: F.lit(2.0) * uniform("id", j, seed) - F.lit(1.0))
    rows = ids.select(F.col("id").cast("bigint").alias("id"), draw.alias("x"))
    scored = score(rows, model, w, keep=["id", "x"])
    y = F.transform("p", vec.classify)
    x = F.col("x")
    if sigma:
        shift = F.transform(
            position, lambda j: F.lit(float(sigma)) * normal("id", j + F.lit(model.inputs), seed)
        )
        x = F.zip_with("x", shift, lambda a, b: a + b)
    return scored.select("id", x.alias("x"), y.alias("y"))


def generate_blobs(ids: DataFrame, centres: np.ndarray, sigma: float, seed: int = 0) -> DataFrame:
    """Rows ``(id, c, x)``: a centre picked evenly plus normal noise."""
    k = len(centres)
    pick = F.least(F.floor(uniform("id", 0, seed) * k), F.lit(k - 1)).cast("int")
    rows = ids.select(F.col("id").cast("bigint").alias("id"), pick.alias("c"))
    shift = lambda v, j: v + F.lit(float(sigma)) * normal("id", j + 1, seed)
    return rows.select("id", "c", F.transform(_centre(centres), shift).alias("x"))


def generate_uneven(
    ids: DataFrame,
    centres: np.ndarray,
    shares: np.ndarray,
    seed: int = 0,
    spread: tuple[float, float] = (0.01, 0.51),
) -> DataFrame:
    """Rows ``(id, c, x)``: a centre picked by share, uniform noise of the row's own width."""
    bounds = np.cumsum(shares) / np.sum(shares)
    u = uniform("id", 0, seed)
    pick = sum([(u >= F.lit(float(b))).cast("int") for b in bounds[:-1]], F.lit(0))
    width = F.lit(spread[0]) + F.lit(spread[1] - spread[0]) * uniform("id", 1, seed)
    rows = ids.select(F.col("id").cast("bigint").alias("id"), pick.alias("c"), width.alias("_d"))
    shift = lambda v, j: v + F.col("_d") * (F.lit(2.0) * uniform("id", j + 2, seed) - F.lit(1.0))
    return rows.select("id", "c", F.transform(_centre(centres), shift).alias("x"))


def _centre(centres: np.ndarray) -> Column:
    table = F.array(*[vec.vector(c) for c in centres])
    return F.get(table, F.col("c"))
