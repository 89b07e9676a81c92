"""Unbiased Pass@k and its helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gradeframe.functions.text import ColumnLike, as_column

# Below this many factors the product is evaluated term by term.
_DIRECT_FACTORS = 64
# So many factors are written out, which is compiled; a fold over a sequence is interpreted.
_PLAIN_FACTORS = 8


def _as_double(value: ColumnLike | int) -> Column:
    return (F.lit(value) if isinstance(value, int) else as_column(value)).cast("double")


def binomial(n: ColumnLike | int, k: ColumnLike | int) -> Column:
    """C(n, k) as DOUBLE, 0 outside 0 <= k <= n. Meant for moderate k."""
    n, k = _as_double(n), _as_double(k)
    short = F.least(k, n - k)
    product = F.aggregate(
        F.sequence(F.lit(1), short.cast("int")), F.lit(1.0),
        lambda acc, i: F.round(acc * (n - short + i) / i))
    return (F.when((k < 0) | (n < 0) | (k > n), F.lit(0.0))
            .when(short == 0, F.lit(1.0)).otherwise(product))


def exact_binomial(n: ColumnLike | int, k: ColumnLike | int) -> Column:
    """C(n, k) as DECIMAL(38, 0), every digit; 0 outside 0 <= k <= n, NULL where a step needs over 32 digits.

    Each step multiplies and divides, and every quotient is a binomial, so no
    remainder is lost.
    """
    n, k = ((F.lit(x) if isinstance(x, int) else as_column(x)).cast("long") for x in (n, k))
    whole = lambda x: x.cast("decimal(38,0)")
    short = F.greatest(F.least(k, n - k), F.lit(0))
    room = F.lit("1" + "0" * 32).cast("decimal(38,0)")  # a quotient keeps 32 digits before its point

    def step(acc: Column, i: Column) -> Column:
        product = F.try_multiply(acc, (n - short + i).cast("decimal(20,0)")).try_cast("decimal(38,0)")
        return whole(F.try_divide(F.when(product < room, product), i.cast("decimal(10,0)")))

    product = F.aggregate(F.sequence(F.lit(1), short.cast("int")), whole(F.lit(1)), step)
    return (F.when((k < 0) | (n < 0) | (k > n), whole(F.lit(0)))
            .when(short == 0, whole(F.lit(1))).otherwise(product))


def _stirling_tail(x: Column) -> Column:
    return 1 / (12 * x) - 1 / (360 * x * x * x)


def _all_fail(n: Column, c: Column, k: Column) -> Column:
    """C(n-c, k) / C(n, k) for 1 <= c and k <= n - c.

    The ratio is symmetric in c and k, hence a product over the smaller of the
    two. Long products use Stirling's series, arranged so that the large terms
    cancel inside ``log1p``; cost per row stays constant however many samples
    an example has.
    """
    few, many = F.least(c, k), F.greatest(c, k)
    plain = F.lit(1.0)
    for j in range(_PLAIN_FACTORS):
        plain = plain * F.when(few > j, 1 - many / (n - j)).otherwise(1.0)
    direct = F.aggregate(
        F.sequence(F.lit(0), F.least(few, F.lit(float(_DIRECT_FACTORS))).cast("int") - 1),
        F.lit(1.0), lambda acc, j: acc * (1 - many / (n - j)))
    rest = F.greatest(n - c - k, F.lit(1.0))
    log_ratio = ((n + 0.5) * F.log1p(c * k / (n * rest))
                 + c * F.log1p(-k / (n - c)) + k * F.log1p(-c / (n - k))
                 + _stirling_tail(n - c) - _stirling_tail(n)
                 - _stirling_tail(rest) + _stirling_tail(n - k))
    # With both c and k large and nothing left over, the ratio is below 1e-30.
    return (F.when(few <= _PLAIN_FACTORS, plain).when(few <= _DIRECT_FACTORS, direct)
            .when(n - c - k < 1, F.lit(0.0)).otherwise(F.exp(log_ratio)))


def pass_at_k(n: ColumnLike | int, c: ColumnLike | int, k: ColumnLike | int) -> Column:
    """Chance that k of n samples, c of them correct, hold a correct one."""
    n, c = _as_double(n), _as_double(c)
    k = F.least(F.greatest(_as_double(k), F.lit(0.0)), n)
    return (F.when((n <= 0) | (k <= 0) | (c <= 0), F.lit(0.0))
            .when(k > n - c, F.lit(1.0))
            .otherwise(1 - _all_fail(n, c, k)))


def annealing_weight(step: ColumnLike, mix_steps: int) -> Column:
    """Explorer share at a step: 1 at step 1, 0 from ``mix_steps`` on."""
    step = as_column(step).cast("double")
    if mix_steps <= 1:
        return F.when(step <= mix_steps, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(step <= mix_steps, 1 - (step - 1) / (mix_steps - 1)).otherwise(F.lit(0.0))


def percent_text(value: ColumnLike) -> Column:
    return F.format_string("%.2f%%", as_column(value).cast("double") * 100)


def score_text(value: ColumnLike) -> Column:
    return F.format_string("%.4f", as_column(value).cast("double"))
