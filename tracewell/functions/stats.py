"""Interval estimates on counted results."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import constants as K
from tracewell.functions.scalars import let


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def ratio(part, whole) -> Column:
    """part / whole, NULL when the whole is 0."""
    return F.try_divide(_c(part).cast("double"), _c(whole).cast("double"))


def wilson_low(k, n, z: float = K.Z_ROUNDED, clamp: bool = False) -> Column:
    center, half = _wilson(k, n, z)
    low = center - half
    return F.greatest(F.lit(0.0), low) if clamp else low


def wilson_high(k, n, z: float = K.Z_ROUNDED, clamp: bool = False) -> Column:
    center, half = _wilson(k, n, z)
    high = center + half
    return F.when(high.isNotNull(), F.least(F.lit(1.0), high)) if clamp else high


def _wilson(k, n, z):
    n = _c(n).cast("double")
    p = F.try_divide(_c(k).cast("double"), n)
    zz = F.lit(z * z)
    denom = 1 + F.try_divide(zz, n)
    center = F.try_divide(p + F.try_divide(zz, 2 * n), denom)
    half = F.try_divide(
        F.lit(z) * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(zz, 4 * n * n)), denom)
    return center, half


def _log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x of 1 or more: Stirling's series, eight steps further on."""
    z = x + 8
    steps = F.log(x * (x + 1) * (x + 2) * (x + 3)) + F.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, F.lit(5.0))) - 1 / (1680 * F.pow(z, F.lit(7.0)))
    return (z - 0.5) * F.log(z) - z + F.lit(0.9189385332046728) + series - steps


def _beta_tail(a: Column, b: Column, log_beta: Column, x: Column) -> Column:
    """Regularised incomplete beta function I_x(a, b) for 0 < x < 1: Lentz's form of its continued fraction as a fold."""
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b), F.when(swap, 1 - x).otherwise(x)
    safe = lambda v: F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)

    def whole(args: Column) -> Column:
        p, q, y = args["p"], args["q"], args["y"]
        front = F.exp(p * F.log(y) + q * F.log1p(-y) - log_beta) / p
        start = 1 / safe(1 - (p + q) * y / (p + 1))

        def step(s: Column, i: Column) -> Column:
            m = F.floor((i + 1) / 2)
            even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
            e = F.when(i % 2 == 1, even).otherwise(odd)
            next_ = F.struct((1 / safe(1 + e * s["d"])).alias("d"), safe(1 + e / s["c"]).alias("c"), s["f"].alias("f"))
            return let(next_, lambda t: F.struct(t["d"].alias("d"), t["c"].alias("c"), (t["f"] * t["d"] * t["c"]).alias("f")))

        # The fraction settles after some multiple of the root of the larger parameter.
        rounds = F.sequence(F.lit(1), 2 * (30 + F.ceil(6 * F.sqrt(F.least(F.greatest(p, q), F.lit(1e10)))).cast("int")))
        fraction = F.aggregate(rounds, F.struct(start.alias("d"), F.lit(1.0).alias("c"), start.alias("f")), step)["f"]
        return front * fraction

    value = let(F.struct(p.alias("p"), q.alias("q"), y.alias("y")), whole)
    return F.when(swap, 1 - value).otherwise(value)


def clopper_pearson_lower(k, n, alpha, steps: int = 48) -> Column:
    """Exact lower bound of a success rate: the alpha quantile of Beta(k, n - k + 1), 0 without a success.

    Newton's steps inside a bracket that halves where they leave it. A fold over columns, some thousand
    operations a row; meant for distinct counts (`with_lower_bound`).
    """
    alpha = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    k, n = _c(k).cast("double"), _c(n).cast("double")

    def bound(s: Column) -> Column:
        a, b, target = s["a"], s["b"], s["target"]

        def solve(log_beta: Column) -> Column:
            def step(at: Column, _: Column) -> Column:
                def move(v: Column) -> Column:
                    below = v["tail"] < target
                    low, high = F.when(below, at["x"]).otherwise(at["low"]), F.when(below, at["high"]).otherwise(at["x"])
                    slope = F.exp((a - 1) * F.log(at["x"]) + (b - 1) * F.log1p(-at["x"]) - log_beta)
                    newton = at["x"] - F.try_divide(v["tail"] - target, slope)
                    inside = (newton > low) & (newton < high)
                    return F.struct(low.alias("low"), high.alias("high"), F.when(inside, newton).otherwise((low + high) / 2).alias("x"))
                return let(F.struct(_beta_tail(a, b, log_beta, at["x"]).alias("tail")), move)
            start = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"), (a / (a + b)).alias("x"))
            return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)["x"]

        return let(_log_gamma(a) + _log_gamma(b) - _log_gamma(a + b), solve)

    # With n successes of n the quantile has a closed form.
    inner = let(F.struct(k.alias("a"), (n - k + 1).alias("b"), alpha.alias("target")), bound)
    return F.when((F.coalesce(k, F.lit(0.0)) <= 0) | (F.coalesce(n, F.lit(0.0)) <= 0), F.lit(0.0)).when(k >= n, F.pow(alpha, 1 / n)).otherwise(inner)


def with_lower_bound(df: DataFrame, k: str, n: str, alpha: float, out: str) -> DataFrame:
    """Add the exact lower bound of k successes of n, worked out once for every distinct pair of counts."""
    pairs = df.select(F.col(k).alias("_k"), F.col(n).alias("_n")).distinct()
    bounds = pairs.withColumn(out, clopper_pearson_lower("_k", "_n", alpha))
    return df.join(bounds, F.col(k).eqNullSafe(F.col("_k")) & F.col(n).eqNullSafe(F.col("_n")), "left").drop("_k", "_n")
