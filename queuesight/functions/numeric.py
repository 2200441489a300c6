"""Number expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBER = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)\s*$"


def coerce_double(df: DataFrame, name: str, default: float | None = 0.0) -> Column:
    """Column as double; text that is no number, NaN and null become `default`."""
    c = df[name]
    if isinstance(df.schema[name].dataType, T.StringType):
        # Java would also read `1.5d` and hexadecimal floats.
        number = F.when(c.rlike(_NUMBER), c.try_cast("double"))
    else:
        number = c.cast("double")
    number = F.when(~F.isnan(number), number)
    return number if default is None else F.coalesce(number, F.lit(default))


def count_reached(c: Column, cutoffs: Sequence[float], strict: bool = False) -> Column:
    """How many of the cutoffs the value reaches (or, if strict, exceeds).

    A sum of comparisons stays inside generated code; a lambda over an array would not.
    """
    total = F.lit(0)
    for cutoff in cutoffs:
        hit = c > F.lit(float(cutoff)) if strict else c >= F.lit(float(cutoff))
        total = total + hit.cast("int")
    return total


def clip_unit(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def ratio(numerator: Column, denominator: Column, empty: float | None = None) -> Column:
    """Quotient as double; `empty` where the denominator is 0."""
    value = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return value if empty is None else F.coalesce(value, F.lit(empty))


def round_exact(c: Column, digits: int) -> Column:
    """Python's round(): half to even, judged on the exact binary value of the double.

    Spark's round() and bround() judge the shortest decimal text instead, so 0.285 would
    give 0.29. Here the error of `c * 10^digits` is recovered by splitting both factors
    into halves whose products are exact; it decides only when the product looks like a tie.
    """
    scale = float(10**digits)
    splitter = 134217729.0  # 2^27 + 1

    def halves(x):
        spread = x * splitter
        high = spread - (spread - x)
        return high, x - high

    scale_high, scale_low = halves(scale)
    high, low = halves(c)
    product = c * F.lit(scale)
    error = ((high * scale_high - product) + high * scale_low + low * scale_high) + low * scale_low
    # rint is half-even already; only a product rounded onto a tie needs its error.
    nearest = F.rint(product)
    onto_tie = F.abs(product - nearest) == 0.5
    whole = F.when(onto_tie & (error > 0), F.ceil(product)).when(onto_tie & (error < 0), F.floor(product))
    rounded = F.coalesce(whole.cast("double"), nearest) / F.lit(scale)
    return F.when(F.abs(product) < 2.0**52, rounded).otherwise(c)


def round_scaled(c: Column, digits: int) -> Column:
    """Rounding as data frames do it: the scaled double to the nearest even whole number."""
    scale = F.lit(float(10**digits))
    return F.rint(c * scale) / scale


def round_columns(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Round the named columns for display (all double columns if none is named)."""
    chosen = set(names) or {f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)}
    return df.select(*[round_exact(df[n], digits).alias(n) if n in chosen else df[n] for n in df.columns])


def softmax(logits: Column) -> Column:
    """Max-shifted softmax of an array of doubles.

    The maximum and the total are bound once per row, by a one-element array each; written
    inside the lambda they would be worked out again for every element.
    """

    def bind(value: Column, use) -> Column:
        return F.transform(F.array(value), use)[0]

    weights = bind(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top)))
    total = F.aggregate(weights, F.lit(0.0), lambda acc, x: acc + x)
    return bind(F.struct(weights.alias("w"), total.alias("t")), lambda s: F.transform(s["w"], lambda x: x / s["t"]))


def binary_confidence(p: Column) -> tuple[Column, Column]:
    """0/1 prediction and confidence of a positive-class probability."""
    return (p >= 0.5).cast("int"), round_exact(F.greatest(p, 1 - p), 4)
