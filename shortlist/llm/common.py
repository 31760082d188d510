"""Column helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The characters that separate words: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
#: A word, as a regular expression for Spark, Python and DuckDB alike.
WORD = r"[^\x20\x09-\x0D]+"


def col(name: str) -> Column:
    """A column by its literal name (dots and backticks included)."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame, alias: str = "__row") -> Column:
    """All columns as one struct, so that helper columns cannot clash with
    extra columns of the input."""
    return F.struct(*[col(c) for c in df.columns]).alias(alias)


def unpack(df: DataFrame, columns: list[str], alias: str = "__row") -> DataFrame:
    """The columns of ``whole_row`` again, in their order."""
    return df.select(*[F.col(alias).getField(c).alias(c) for c in columns])


def text_or_empty(name: str = "text") -> Column:
    """The text; a null counts as empty."""
    return F.coalesce(col(name), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words, bigint."""
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


#: A group with more than this share of all rows is hot; there are at most
#: 1 / HOT_SHARE such groups.
HOT_SHARE = 1 / 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """rows joined to the one row that ``groups`` has for their ``key`` (not
    null, and with its number of rows in ``size``). Hot groups, a thousand at
    most, are broadcast, so that their rows stay where they are; all others
    meet by a shuffle of bounded groups."""
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = F.broadcast(groups.filter(F.col(size) > total * HOT_SHARE))
    cold = groups.filter(F.col(size) <= total * HOT_SHARE)
    rest = rows.join(hot.select(key), key, "left_anti").join(cold, key)
    return rows.join(hot, key).unionByName(rest)
