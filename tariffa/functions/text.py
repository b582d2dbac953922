"""String helpers shared by the column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def once(df: DataFrame, **columns) -> DataFrame:
    """Add columns that are computed one time per row.

    The optimizer copies a projected expression into every later use of it. A
    one-element `inline` keeps the value, which matters for patterns over whole pages.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def bind(value: Column, body) -> Column:
    """`body(value)` with the value computed one time.

    Branches of a `when` or `coalesce` do not share work, so an expression over a whole
    page would run once for every branch.
    """
    return F.transform(F.array(value), body)[0]


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def decimal(c) -> Column:
    """Plain decimal text to a finite double, anything else to null.

    A cast alone also takes suffixes such as `1d`, and the words for infinity.
    """
    value = F.when(col(c).rlike(NUMBER), col(c).try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def text(c) -> Column:
    """The column as text, with null as ''."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def strip(c) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(col(c), F.lit(WHITESPACE))


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def contains_any(c: Column, words) -> Column:
    """A chain of byte searches; several times faster than one pattern of alternatives."""
    return any_of(c.contains(w) for w in words)


def first_contained(c: Column, words) -> Column:
    """The first word of the list that the text contains, else null."""
    return F.coalesce(*[F.when(c.contains(w), F.lit(w)) for w in words])


def case(pairs, otherwise=None) -> Column:
    """`when` chain from (condition, value) pairs; the first true condition wins."""
    out = F
    for cond, value in pairs:
        out = out.when(cond, value if isinstance(value, Column) else F.lit(value))
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def identity(c) -> Column:
    """Lower case, hyphens as blanks, runs of white space as one blank."""
    return strip(F.regexp_replace(F.translate(F.lower(text(c)), "-", " "), r"(?U)\s+", " "))


def plain_money(c) -> Column:
    """Drop thousands commas (1,234 becomes 1234)."""
    return F.regexp_replace(text(c), r"(\d),(\d{3})", "$1$2")


def to_int(c: Column) -> Column:
    """Digits with commas to int."""
    return F.replace(c, F.lit(","), F.lit("")).try_cast("int")


def fields_contain(columns, needle: str) -> Column:
    """Case-insensitive free-text test over several columns; null reads as 'null'."""
    return any_of(
        F.lower(F.coalesce(col(c).cast("string"), F.lit("null"))).contains(needle.lower()) for c in columns
    )
