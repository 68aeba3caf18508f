"""Array kernels as Column functions: normalisation, rotary position, gates, softmax.

Arguments are ``array<double>`` columns. A value that every element needs is bound once per
row by ``let``, so a kernel over d elements does O(d) work: an expression named inside a
lambda would otherwise be evaluated for every element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_EPS = 1e-6


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def doubles(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("array<double>")


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def scaled(x: Column, factor: Column) -> Column:
    return let(factor, lambda f: F.transform(x, lambda v: v * f))


def rms_scale(x: Column, eps: float = NORM_EPS) -> Column:
    """1 / sqrt(mean(x^2) + eps)."""
    return F.lit(1.0) / F.sqrt(dot(x, x) / F.size(x) + F.lit(eps))


def rmsnorm(x: Column, weight: Column | None = None, eps: float = NORM_EPS) -> Column:
    normed = scaled(x, rms_scale(x, eps))
    return normed if weight is None else F.zip_with(normed, weight, lambda v, w: v * w)


def rmsnorm_dx(x: Column, dy: Column, weight: Column | None = None, eps: float = NORM_EPS) -> Column:
    """Gradient of ``rmsnorm`` for x: with g = dy * w and r the scale, r * g - x * r^3 * sum(g x) / n."""
    g = dy if weight is None else F.zip_with(dy, weight, lambda d, w: d * w)
    return let(
        F.struct(rms_scale(x, eps).alias("r"), (dot(g, x) / F.size(x)).alias("c")),
        lambda s: F.zip_with(x, g, lambda v, gv: s["r"] * (gv - v * s["r"] * s["r"] * s["c"])),
    )


def rope(x: Column, position: Column, base: float = 10_000.0, inverse: bool = False) -> Column:
    """Rotate the pairs (i, i + d/2) by position * base^(-2 i / d); the inverse turns back."""
    sign = F.lit(-1.0 if inverse else 1.0)

    def turned(s: Column) -> Column:
        d = F.size(x)
        half = (d / 2).cast("int")

        def one(i: Column) -> Column:
            pair = i % half
            angle = s * F.pow(F.lit(base), -2.0 * pair / d)
            other = F.when(i < half, -F.get(x, i + half)).otherwise(F.get(x, i - half))
            return F.get(x, i) * F.cos(angle) + other * sign * F.sin(angle)

        return F.transform(F.sequence(F.lit(0), d - 1), one)

    return let(position.cast("double"), turned)


def sigmoid(v: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-v))


def swiglu(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * sigmoid(x) * y)


def swiglu_grad_a(a: Column, b: Column, dy: Column) -> Column:
    """dy * b * s * (1 + a (1 - s)), s the sigmoid of a."""
    gate = F.transform(a, lambda x: let(sigmoid(x), lambda s: s * (1 + x * (1 - s))))
    return F.zip_with(F.zip_with(gate, b, lambda g, y: g * y), dy, lambda v, d: v * d)


def swiglu_grad_b(a: Column, dy: Column) -> Column:
    return F.zip_with(F.transform(a, lambda x: x * sigmoid(x)), dy, lambda v, d: v * d)


def logsumexp(x: Column) -> Column:
    return let(F.array_max(x), lambda m: m + F.log(total(F.transform(x, lambda v: F.exp(v - m)))))


def log_softmax(x: Column) -> Column:
    return let(logsumexp(x), lambda z: F.transform(x, lambda v: v - z))


def softmax(x: Column, temperature: float = 1.0) -> Column:
    y = x if temperature == 1.0 else F.transform(x, lambda v: v / F.lit(float(temperature)))
    return F.transform(log_softmax(y), F.exp)


def top_k_masked(x: Column, k: int) -> Column:
    """Logits below the k-th largest become -infinity; ties at the threshold stay."""
    kth = F.element_at(F.sort_array(x, asc=False), F.least(F.lit(k), F.size(x)))
    return let(kth, lambda t: F.transform(x, lambda v: F.when(v < t, F.lit(float("-inf"))).otherwise(v)))


def argmax(x: Column) -> Column:
    """0-based index of the largest element; the first of equal ones."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def causal_window(length: Column, window: int | None = None) -> Column:
    """Pairs (i, j) with j <= i, and i - j < window if given, as an array of structs."""
    first = lambda i: F.lit(0) if window is None else F.greatest(F.lit(0), i - (window - 1))
    rows = F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.transform(F.sequence(first(i), i), lambda j: F.struct(i.alias("i"), j.alias("j"))))
    return F.flatten(rows)


def stable(x: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero: for results that are compared by value."""
    return F.round(x, digits) + F.lit(0.0)
