"""Vector functions over ``ARRAY<DOUBLE>`` columns, JVM-side (higher-order functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value, body) -> Column:
    """``body`` of a value that is computed once per row.

    A plain expression used inside a lambda is evaluated again for every element;
    the variable of an outer one-element ``transform`` is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def _zero() -> Column:
    return F.lit(0.0).cast("double")


def _total(xs) -> Column:
    return F.aggregate(xs, _zero(), lambda acc, x: acc + x)


def _shifted(xs, body) -> Column:
    """``body(xs, maximum, exponentials of xs - maximum)``, each computed once."""
    return let(
        F.struct(_c(xs).alias("x"), F.array_max(_c(xs)).alias("m")),
        lambda s: let(
            F.struct(s["x"].alias("x"), s["m"].alias("m"), F.transform(s["x"], lambda v: F.exp(v - s["m"])).alias("e")),
            lambda t: body(t["x"], t["m"], t["e"]),
        ),
    )


def log_sum_exp(xs) -> Column:
    return _shifted(xs, lambda x, m, e: m + F.log(_total(e)))


def softmax(xs) -> Column:
    """Max-shifted softmax of a vector."""
    return _shifted(xs, lambda x, m, e: let(F.struct(e.alias("e"), _total(e).alias("n")), lambda s: F.transform(s["e"], lambda v: v / s["n"])))


def log_softmax(xs) -> Column:
    return _shifted(
        xs, lambda x, m, e: let(F.struct(x.alias("x"), (m + F.log(_total(e))).alias("n")), lambda s: F.transform(s["x"], lambda v: v - s["n"]))
    )


def one_hot(index, n: int) -> Column:
    """0-based index -> 0/1 vector of length n."""
    index = _c(index)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == index).cast("double"))


def argmax(xs) -> Column:
    """0-based index of the largest value; the first one on ties."""
    xs = _c(xs)
    return (F.array_position(xs, F.array_max(xs)) - 1).cast("int")


def cross_entropy(logits, target) -> Column:
    """-log softmax(logits)[target] with a 0-based target."""
    logits = _c(logits)
    target = _c(target)
    return log_sum_exp(logits) - F.element_at(logits, target + 1)


def round_half_even(x, digits: int = 3) -> Column:
    return F.bround(_c(x), digits)
