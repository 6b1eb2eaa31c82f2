"""Weights of coalitions by their size."""

from __future__ import annotations

from math import gamma

from pyspark.sql import Column
from pyspark.sql import functions as F


def factorial(k: Column) -> Column:
    return F.factorial(k.cast("int")).cast("double")


def choose(n: Column, k: Column) -> Column:
    """Binomial coefficient as a double; 0 outside 0 <= k <= n."""
    return F.when((k >= 0) & (k <= n), factorial(n) / (factorial(k) * factorial(n - k))).otherwise(F.lit(0.0))


def wide_choose(n: Column, k: int) -> Column:
    """Binomial coefficient of a fixed `k`, for an n too great for factorials."""
    value = F.lit(1.0)
    for j in range(k):
        value = value * (n - j) / float(j + 1)
    return value


def size_law(n: Column, z: Column) -> Column:
    """(n - 1) / (z (n - z)), in proportion to which sizes are drawn; 0 at both ends."""
    inner = (z > 0) & (z < n)
    return F.when(inner, (n - 1).cast("double") / F.when(inner, (z * (n - z)).cast("double"))).otherwise(F.lit(0.0))


def shap_kernel(n: Column, z: Column, ends: float = 0.0) -> Column:
    """The regression weight whose linear fit gives Shapley values; `ends` is that of the empty and the full coalition."""
    inner = (z > 0) & (z < n)
    return F.when(inner, size_law(n, z) / choose(n, F.when(inner, z).otherwise(F.lit(0)))).otherwise(F.lit(ends))


def size_kernel(n: Column, z: Column) -> Column:
    """C(n - 1, z), not normalised."""
    return choose(n - 1, z)


def shap_kernel_mean_one(n: Column, z: Column, ends: float = 1000.0) -> Column:
    """shap_kernel() over its mean on the sizes 0 to n."""
    sizes = F.sequence(F.lit(0), n.cast("int"))
    total = F.aggregate(sizes, F.lit(0.0), lambda s, k: s + shap_kernel(n, k, ends))
    return shap_kernel(n, z, ends) * (n + 1) / total


def size_kernel_share(n: Column, z: Column) -> Column:
    """size_kernel() over its sum on all sizes, 2 ** (n - 1)."""
    return size_kernel(n, z) / F.pow(F.lit(2.0), n - 1)


def shapley_weight(n: Column, s: Column) -> Column:
    """Weight of a marginal contribution to a coalition of size s among n items."""
    return factorial(s) * factorial(n - s - 1) / factorial(n)


def pair_weight(n: Column, s: Column) -> Column:
    """Weight of a pair's second difference at a coalition of size s."""
    return factorial(s) * factorial(n - s - 2) / factorial(n - 1)


def beta_weight(n: Column, k: Column, alpha: float, beta: float) -> Column:
    """Density of Beta(alpha, beta) at k / (n - 1), at one half for n = 1; where it isn't finite, 1e6."""
    x = F.when(n > 1, k.cast("double") / F.when(n > 1, n - 1)).otherwise(F.lit(0.5))
    if alpha == beta == 1:
        return F.lit(1.0)
    edge = ((x == 0) & F.lit(alpha < 1)) | ((x == 1) & F.lit(beta < 1))
    scale = gamma(alpha + beta) / (gamma(alpha) * gamma(beta))
    inner = F.when(edge, F.lit(0.5)).otherwise(x)
    return F.when(edge, F.lit(1e6)).otherwise(scale * F.pow(inner, F.lit(alpha - 1.0)) * F.pow(1 - inner, F.lit(beta - 1.0)))
