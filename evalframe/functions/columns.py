"""Scalar column expressions, all built from ``pyspark.sql.functions`` so they
stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType, NumericType

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: ColumnOrName) -> Column:
    """Fold NaN into SQL NULL (pandas' only missing marker is NaN; Spark's is NULL)."""
    c = _col(c)
    return F.when(~F.isnan(c), c)


# decimal numbers as text; what else the JVM parses (1.5d, 3f, 0x1p3) is not a number here
NUMBER = r"(?i)^\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|inf(?:inity)?|nan)\s*$"


def parse_number(c: ColumnOrName) -> Column:
    """Text -> double, NULL when it is not a decimal number (or inf, nan)."""
    c = _col(c).cast("string")
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def clean_number(c: ColumnOrName, source_type: DataType | None = None) -> Column:
    """P10: text or number -> double; unparsable, NaN and +-inf become NULL."""
    c = _col(c)
    d = c.cast("double") if isinstance(source_type, NumericType) else parse_number(c)
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)


def normalize_label(c: ColumnOrName, strip_dots: bool = False) -> Column:
    """Strip every leading/trailing whitespace character; optionally also
    every trailing dot (``'>50K.'`` -> ``'>50K'``)."""
    c = F.regexp_replace(_col(c).cast("string"), r"^\s+|\s+$", "")
    if strip_dots:
        c = F.regexp_replace(c, r"\.+$", "")
    return c


def lower_trim(c: ColumnOrName) -> Column:
    """Key normalisation used by the results reader: strip blanks, lower case."""
    return F.lower(F.regexp_replace(_col(c).cast("string"), r"^\s+|\s+$", ""))


# Conventional Cohen's d magnitude thresholds and their names.
EFFECT_THRESHOLDS = ((0.2, "negligible"), (0.5, "small"), (0.8, "medium"))
EFFECT_LARGE = "large"
EFFECT_MISSING = "not estimable"


def effect_label(c: ColumnOrName) -> Column:
    """Magnitude label of an effect size; NULL/NaN/inf -> 'not estimable'."""
    v = clean_number(_col(c), DoubleType())
    m = F.abs(v)
    out = F.when(v.isNull(), F.lit(EFFECT_MISSING))
    for bound, name in EFFECT_THRESHOLDS:
        out = out.when(m < bound, F.lit(name))
    return out.otherwise(F.lit(EFFECT_LARGE))


def fixed(c: ColumnOrName, digits: int) -> Column:
    """Fixed-point text rounded from the exact binary value, half to even (as
    Python's and C's ``%.Nf``).  ``format_string('%.Nf')`` is not used: the
    JVM rounds the shortest decimal string half-up (0.125 -> '0.13')."""
    return F.regexp_replace(F.format_number(_col(c), digits), ",", "")


def fmt_number(c: ColumnOrName, digits: int = 4) -> Column:
    """Fixed-point text with ``digits`` decimals, ``NA`` when not a finite number."""
    v = clean_number(_col(c), DoubleType())
    return F.when(v.isNull(), F.lit("NA")).otherwise(fixed(v, digits))


def fmt_p(c: ColumnOrName) -> Column:
    """P-value text: ``NA``, ``<0.001`` or four decimals."""
    v = clean_number(_col(c), DoubleType())
    return (F.when(v.isNull(), F.lit("NA"))
            .when(v < 0.001, F.lit("<0.001"))
            .otherwise(fixed(v, 4)))


def is_float_type(t: DataType) -> bool:
    return isinstance(t, (DoubleType, FloatType))
