"""Vector arithmetic on ``ARRAY<DOUBLE>`` columns, all as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LOG_LOSS = 100.0  # fixed value: loss of a certain but wrong prediction


def _c(v: Column | str | float) -> Column:
    if isinstance(v, Column):
        return v
    return F.col(v) if isinstance(v, str) else F.lit(v)


def vector(values) -> Column:
    """A literal ``ARRAY<DOUBLE>``."""
    return F.lit([float(v) for v in values])


# --- reductions of one vector -------------------------------------------------


def total(v) -> Column:
    return F.aggregate(_c(v), F.lit(0.0), lambda s, e: s + e)


def mean(v) -> Column:
    """Mean; 0 for an empty vector."""
    v = _c(v)
    return F.when(F.size(v) == 0, F.lit(0.0)).otherwise(total(v) / F.size(v))


def hmean(v) -> Column:
    """Harmonic mean; 0 for an empty vector."""
    v = _c(v)
    inverse = F.aggregate(v, F.lit(0.0), lambda s, e: s + F.try_divide(F.lit(1.0), e))
    return F.when(F.size(v) == 0, F.lit(0.0)).otherwise(F.try_divide(F.size(v), inverse))


def smallest(v, init: float) -> Column:
    return F.least(F.coalesce(F.array_min(_c(v)), F.lit(init)), F.lit(init))


def largest(v, init: float) -> Column:
    return F.greatest(F.coalesce(F.array_max(_c(v)), F.lit(init)), F.lit(init))


# --- norms and products -------------------------------------------------------


def dot(a, b) -> Column:
    products = F.zip_with(_c(a), _c(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, e: s + e)


def axpy(a, b, factor) -> Column:
    """``a + factor * b``."""
    f = _c(factor)
    return F.zip_with(_c(a), _c(b), lambda x, y: x + f * y)


def minus(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def l1(a, b=None, avg: bool = False) -> Column:
    """Sum (or mean) of absolute values of ``a`` or ``a - b``."""
    v = _c(a) if b is None else minus(a, b)
    s = F.aggregate(v, F.lit(0.0), lambda t, e: t + F.abs(e))
    return s / F.size(v) if avg else s


def sq(a, b=None, avg: bool = False) -> Column:
    """Sum (or mean) of squares of ``a`` or ``a - b``; no root is taken."""
    v = _c(a) if b is None else minus(a, b)
    s = F.aggregate(v, F.lit(0.0), lambda t, e: t + e * e)
    return s / F.size(v) if avg else s


def dist(a, b) -> Column:
    return F.sqrt(sq(a, b))


def centre_distance(x, sums, count) -> Column:
    """Distance from ``x`` to the centre ``sums / count``; null if it is empty."""
    n = _c(count)
    gap = F.zip_with(_c(x), _c(sums), lambda v, s: v - F.try_divide(s, n))
    return F.when(n > 0, F.sqrt(sq(gap)))


# --- activations --------------------------------------------------------------


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


def dsigmoid(x=None, y=None) -> Column:
    """Derivative at ``x``, or from the output ``y`` where it is known."""
    s = _c(y) if y is not None else sigmoid(x)
    return s * (F.lit(1.0) - s)


def relu(x) -> Column:
    return F.greatest(_c(x), F.lit(0.0))


def drelu(x) -> Column:
    return F.when(_c(x) >= 0, F.lit(1.0)).otherwise(F.lit(0.0))


def tanh(x) -> Column:
    return F.tanh(_c(x))


def dtanh(x=None, y=None) -> Column:
    t = _c(y) if y is not None else tanh(x)
    return F.lit(1.0) - t * t


def arctan(x) -> Column:
    return F.atan(_c(x))


def darctan(x) -> Column:
    return F.lit(1.0) / (_c(x) * _c(x) + F.lit(1.0))


def softplus(x) -> Column:
    return F.greatest(_c(x), F.lit(0.0)) + F.log1p(F.exp(-F.abs(_c(x))))


def dsoftplus(x) -> Column:
    return sigmoid(x)


def softmax(v) -> Column:
    """Shifted by the maximum, which leaves the result and avoids overflow."""
    v = _c(v)
    top = F.array_max(v)
    weights = F.transform(v, lambda e: F.exp(e - top))
    norm = F.aggregate(weights, F.lit(0.0), lambda s, e: s + e)
    return F.transform(weights, lambda e: e / norm)


def softmax_jacobian(v) -> Column:
    """Rows of d softmax_i / d v_j from the input vector."""
    p = softmax(v)
    return F.transform(
        p,
        lambda a, i: F.transform(
            p, lambda b, j: F.when(i == j, a * (F.lit(1.0) - a)).otherwise(-a * b)
        ),
    )


# --- losses, classes, labels --------------------------------------------------


def squared_loss(p, y) -> Column:
    return sq(p, y)


def log_loss(p, y) -> Column:
    """Negative log-likelihood of a 0/1 label; capped where the log is infinite."""
    hit = F.when(_c(y) == 0, F.lit(1.0) - _c(p)).otherwise(_c(p))
    return F.when(hit <= 0, F.lit(MAX_LOG_LOSS)).otherwise(-F.log(hit))


def classify(p) -> Column:
    return F.when(_c(p) >= 0.5, F.lit(1.0)).otherwise(F.lit(0.0))


def one_hot(label, k: int) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)), lambda c: (c == _c(label)).cast("double")
    )


def with_bias(x) -> Column:
    return F.concat(_c(x), F.array(F.lit(1.0)))


# --- priority decay -----------------------------------------------------------


def decay_linear(p, a, version, now) -> Column:
    """``p * exp(a * (now - version))``."""
    return _c(p) * F.exp(_c(a) * (_c(now) - _c(version)))


def decay_quadratic(p, a, b, version, now) -> Column:
    """``p * exp(a * (now^2 - version^2) + b * (now - version))``."""
    n, v = _c(now).cast("double"), _c(version).cast("double")
    return _c(p) * F.exp(_c(a) * (n * n - v * v) + _c(b) * (n - v))
