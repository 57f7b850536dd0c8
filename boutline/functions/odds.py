"""Odds and probability columns."""

from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def implied_prob(moneyline) -> Column:
    """Raw implied probability of an American moneyline."""
    m = _c(moneyline)
    return F.when(m < 0, -m / (100.0 - m)).otherwise(100.0 / (m + 100.0))


def devig(p_home, p_away) -> Column:
    """Home probability with the bookmaker's margin removed; NULL without both sides."""
    h, a = _c(p_home), _c(p_away)
    return F.when(h + a > 0, h / (h + a))


def spread_prob(spread, scale: float = 13.45) -> Column:
    return 1.0 / (1.0 + F.exp(-_c(spread) / scale))


def prob_to_odds(p) -> Column:
    """Fair American odds of a probability."""
    p = _c(p)
    return F.when(p >= 0.5, -100.0 * p / (1.0 - p)).otherwise(100.0 * (1.0 - p) / p)


def clamp(c, lo: float, hi: float) -> Column:
    c = _c(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def logit(p, eps: float = 1e-6) -> Column:
    q = clamp(p, eps, 1.0 - eps)
    return F.log(q / (1.0 - q))


def sigmoid(x) -> Column:
    return 1.0 / (1.0 + F.exp(-_c(x)))


def log_loss(p, y, eps: float = 1e-6) -> Column:
    p, y = _c(p), _c(y)
    # The probability given to what happened; one logarithm per row.
    return -F.log(clamp(F.when(y == 1, p).when(y == 0, 1.0 - p), eps, 1.0 - eps))


def brier(p, y) -> Column:
    d = _c(p) - _c(y)
    return d * d


def hit(p, y) -> Column:
    """1.0 when the side picked at p >= 0.5 won."""
    return ((_c(p) >= 0.5).cast("int") == _c(y)).cast("double")


def confidence(p) -> Column:
    p = _c(p)
    return F.greatest(p, 1.0 - p)


def wilson(k, n, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson score interval; NULL when n is 0."""
    k, n = _c(k).cast("double"), _c(n).cast("double")
    p = F.try_divide(k, n)
    denom = 1.0 + F.try_divide(F.lit(z * z), n)
    centre = (p + F.try_divide(F.lit(z * z), 2.0 * n)) / denom
    half = z * F.sqrt(F.try_divide(p * (1.0 - p) + F.try_divide(F.lit(z * z), 4.0 * n), n)) / denom
    return centre - half, centre + half


def normal_cdf(z) -> Column:
    """Standard normal CDF by the complementary-error-function rational fit (relative error < 1.2e-7)."""
    x = _c(z) / F.lit(-(2.0 ** 0.5))
    t = 1.0 / (1.0 + 0.5 * F.abs(x))
    # Chebyshev coefficients of the erfc fit, constant term first.
    coefficients = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
                    0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    poly = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        poly = F.lit(c) + t * poly
    tail = t * F.exp(-x * x + poly)
    return 0.5 * F.when(x >= 0, tail).otherwise(2.0 - tail)


def normal_wp(margin, frac, mu: float, sigma: float) -> Column:
    """P(final margin > 0) when the rest of the margin is Normal(mu f, sigma^2 f)."""
    m, f = _c(margin).cast("double"), clamp(frac, 0.0, 1.0)
    live = normal_cdf((m + mu * f) / F.greatest(F.lit(1e-6), sigma * F.sqrt(f)))
    over = F.when(m > 0, 1.0).when(m < 0, 0.0).otherwise(0.5)
    return F.when(f <= 1e-6, over).otherwise(live)


def winpct_to_elo(p) -> Column:
    p = _c(p)
    return 1500.0 + 400.0 * F.log10(p / (1.0 - p))


def pythag(gf, ga) -> Column:
    gf, ga = _c(gf), _c(ga)
    return F.try_divide(gf * gf, gf * gf + ga * ga)
