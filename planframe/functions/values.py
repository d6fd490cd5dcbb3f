"""How cells are read: blanks, comparison keys, numbers and dates. Everything is a built-in expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Marks of currency that a number may carry.
CURRENCY = r"(?i)₹|\$|€|£|,|\s|\brs\.?|\binr\b"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: Date patterns, the first that fits wins; day before month.
DATES = ["yyyy-M-d", "d/M/yyyy", "d/M/yy", "d MMM yyyy", "MMM d, yyyy", "MMM d yyyy"]


#: The white space of Unicode, ends of lines and no-break spaces included.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACE_RUN = "[" + SPACES + "]+"


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def kind_of(df: DataFrame, name: str) -> str:
    """number, date, bool or text."""
    t = df.schema[name].dataType
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return "bool" if isinstance(t, T.BooleanType) else "text"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(SPACES))


def is_blank(c: Column, kind: str = "text") -> Column:
    """NULL, empty and white space are one thing; so is NaN."""
    if kind == "text":
        return F.coalesce(strip(c) == "", F.lit(True))
    return c.isNull() | F.coalesce(F.isnan(c.cast("double")), F.lit(False)) if kind == "number" else c.isNull()


def text_of(c: Column, kind: str = "text") -> Column:
    """Text of a cell; whole numbers without a fraction, dates as yyyy-MM-dd."""
    if kind == "number":
        whole = c.cast("double") == F.floor(c.cast("double")).cast("double")
        return F.when(whole & (F.abs(c.cast("double")) < 9e15), c.cast("bigint").cast("string")).otherwise(c.cast("string"))
    return F.date_format(c, "yyyy-MM-dd") if kind == "date" else c.cast("string")


def norm(c: Column, kind: str = "text") -> Column:
    """Key for comparing text: trimmed, lower case."""
    return F.lower(strip(text_of(c, kind)))


def match_key(c: Column, kind: str = "text") -> Column:
    """Key for lookups: as ``norm``, 101.0 like 101, blank is NULL."""
    return F.nullif(F.regexp_replace(norm(c, kind), r"^([+-]?[0-9]+)\.0+$", "$1"), F.lit(""))


def read_number(c: Column) -> Column:
    """Number in a text, or NULL."""
    bare = F.regexp_replace(c, CURRENCY, "")
    return F.when(bare.rlike(NUMBER), bare.try_cast("double"))


def read_date(c: Column, kind: str = "text") -> Column:
    """Date in a text by DATES, or NULL; dates as they are."""
    if kind == "date":
        return c.cast("date")
    t = F.regexp_replace(strip(c.cast("string")), r"[T ][0-9]{1,2}:.*$", "")
    t = F.when(t.rlike(r"^[0-9]{1,2}[./-]"), F.regexp_replace(t, "[.-]", "/")).otherwise(t)
    month = F.try_to_timestamp(F.concat(F.lit("1 "), t), F.lit("d MMM yyyy")).cast("date")
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(p)).cast("date") for p in DATES], month)


def to_number(c: Column, kind: str) -> Column:
    return F.nanvl(c.cast("double"), F.lit(None).cast("double")) if kind == "number" else c.cast("double") if kind == "bool" else read_number(c.cast("string"))


def half_even(x: Column, digits: int | Column = 0) -> Column:
    scale = F.pow(F.lit(10.0), digits if isinstance(digits, Column) else F.lit(float(digits)))
    return F.rint(x * scale) / scale


def title(c: Column) -> Column:
    """Every run of letters capitalised."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x)))), "")


def months_between(a: Column, b: Column) -> Column:
    """Whole calendar months from a to b: one less where the day of b comes before that of a."""
    whole = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    return whole - F.when(F.dayofmonth(b) < F.dayofmonth(a), 1).otherwise(0)
