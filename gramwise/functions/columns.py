"""Column expressions.  All of them stay inside Spark's code generation."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from itertools import chain

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quarter_label(date: Column) -> Column:
    """``Q4 2017`` for a date in the fourth quarter of 2017."""
    return F.concat(F.lit("Q"), F.quarter(date).cast("string"), F.lit(" "), F.year(date).cast("string"))


def parse_date(text: Column, fmt: str, bad: str = "error") -> Column:
    """String to date with an explicit format; ``bad="null"`` turns unreadable values into null."""
    if bad == "null":
        return F.try_to_timestamp(text, F.lit(fmt)).cast("date")
    return F.to_date(text, fmt)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, null where the denominator is zero."""
    return F.try_divide(numerator, denominator)


def log_positive(value: Column) -> Column:
    """Natural logarithm, null for zero and below."""
    return F.when(value > 0, F.ln(value))


def log_ratio(numerator: Column, denominator: Column) -> Column:
    return log_positive(ratio(numerator, denominator))


def rescaled(value: Column, unit: float) -> Column:
    return value / F.lit(float(unit))


def interaction(left: Column, right: Column) -> Column:
    return left * right


def cap_above(value: Column, cap: Column | float) -> Column:
    """Upper clip that keeps null null (``least`` would return the cap)."""
    cap = cap if isinstance(cap, Column) else F.lit(float(cap))
    return F.when(value > cap, cap).otherwise(value)


def recode(value: Column, mapping: Mapping) -> Column:
    """Dictionary lookup; keys absent from the dictionary give null."""
    if not mapping:
        raise ValueError("recode needs at least one entry")
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])[value]


def change(value: Column, base: Column) -> Column:
    return value - base


def percent_change(value: Column, base: Column) -> Column:
    """``100 (value - base) / base``.  The base keeps its sign, so a loss as the base flips the sign."""
    return F.try_divide(F.lit(100.0) * (value - base), base)


def count_where(predicate: Column) -> Column:
    """Rows for which the predicate is true; null counts as false."""
    return F.count_if(F.coalesce(predicate, F.lit(False)))


def first_max(value: Column, at: Column) -> Column:
    """The largest value and where it is, as a struct; the smallest ``at`` wins a tie."""
    return F.max_by(F.struct(at.alias("at"), value.alias("value")), F.struct(value, -at))


NULL_LEVEL = "\0missing"  # stands for missing values among categories; texts that start with a zero character get another one
MISSING_NAME = "nan"


def level(category: Column) -> Column:
    """The category as text; missing values form a category of their own that no text can name."""
    text = category.cast("string")
    return F.coalesce(F.when(F.startswith(text, F.lit("\0")), F.concat(F.lit("\0"), text)).otherwise(text), F.lit(NULL_LEVEL))


def level_names(values: Iterable[str]) -> dict[str, str]:
    """How the levels of one column are printed: as their text, missing ones by a name that no other level has."""
    names = {v: v.removeprefix("\0") for v in values if v != NULL_LEVEL}
    name = MISSING_NAME
    while name in names.values():
        name += "_"
    return names | {NULL_LEVEL: name}


def in_level_order(values: Iterable[str]) -> list[str]:
    """Sorted, with the category of missing values at the end."""
    return sorted(values, key=lambda v: (v == NULL_LEVEL, v))


def indicator(category: Column, value: str) -> Column:
    """1.0 where the category equals the value, else 0.0."""
    return (level(category) == F.lit(value)).cast("double")


def bucket_above(df: DataFrame, column: str, cuts: Sequence[float], out: str) -> DataFrame:
    """Add ``out``: how many of the ascending ``cuts`` are strictly below the value.

    ``Bucketizer`` finds the bucket by binary search, so the cost per row grows with log(cuts).  Its buckets
    are closed on the left; looking up the negated value closes them on the right.
    """
    if not cuts:
        return df.withColumn(out, F.lit(0))
    cuts = [c + 0.0 for c in cuts]  # no negative zero: the search tells it from zero
    negated = f"__neg_{out}"
    splits = [float("-inf"), *(-c for c in reversed(cuts)), float("inf")]
    bucketizer = Bucketizer(splits=splits, inputCol=negated, outputCol=out, handleInvalid="keep")
    return (
        bucketizer.transform(df.withColumn(negated, -F.col(column)))
        .drop(negated)
        .withColumn(out, F.lit(len(cuts)) - F.col(out).cast("int"))
    )


def round_half_even(df: DataFrame, digits: int) -> DataFrame:
    """Round every floating-point column, ties to even."""
    floating = {name for name, kind in df.dtypes if kind in ("double", "float")}
    return df.select([F.bround(c, digits).alias(c) if c in floating else F.col(c) for c in df.columns])


# Wichura's rational approximation of the normal quantile (algorithm AS 241, PPND16).  Fixed values.
_CENTRE_NUM = (
    3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
    4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3,
)
_CENTRE_DEN = (
    1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
    2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3,
)
_MIDDLE_NUM = (
    1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
    1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4,
)
_MIDDLE_DEN = (
    1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
    1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9,
)
_TAIL_NUM = (
    6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
    2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7,
)
_TAIL_DEN = (
    1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
    7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15,
)


def _polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    value = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        value = value * x + F.lit(c)
    return value


def normal_quantile(p: Column) -> Column:
    """Inverse standard normal distribution, accurate to about 1e-15, without leaving the JVM."""
    q = p - F.lit(0.5)
    r_centre = F.lit(0.180625) - q * q
    centre = q * _polynomial(r_centre, _CENTRE_NUM) / _polynomial(r_centre, _CENTRE_DEN)
    r = F.sqrt(-F.ln(F.when(q < 0, p).otherwise(F.lit(1.0) - p)))
    middle = _polynomial(r - 1.6, _MIDDLE_NUM) / _polynomial(r - 1.6, _MIDDLE_DEN)
    tail = _polynomial(r - 5.0, _TAIL_NUM) / _polynomial(r - 5.0, _TAIL_DEN)
    outer = F.when(r <= 5.0, middle).otherwise(tail)
    return F.when(F.abs(q) <= 0.425, centre).when(q < 0, -outer).otherwise(outer)
