"""Column functions on text, with the semantics of the statistics environment the results must match."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space at both ends (tabs and line ends too, which ``trim`` leaves)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def squish(c: Column) -> Column:
    """strip, and each run of white space inside as one space."""
    return strip(F.regexp_replace(c, r"\s+", " "))


def signif(c: Column, digits: int = 3) -> Column:
    """Rounded to so many significant digits; 0 stays 0."""
    power = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(c))))
    return F.when(c == 0, F.lit(0.0)).otherwise(F.round(c * power) / power)


def ngrams(tokens: Column, least: int, most: int, sep: str = " ") -> Column:
    """All runs of least..most neighbouring tokens, each joined by sep; sizes under 1 are skipped.

    The token array is bound to a lambda variable, so that it is made once a row and not once an n-gram.
    """

    def of(row: Column) -> Column:
        parts = [size_n(row, n) for n in range(max(1, least), most + 1)]
        return F.concat(*parts) if parts else F.array().cast("array<string>")

    def size_n(row: Column, n: int) -> Column:
        # the lambda has one parameter: a second one, even with a default, would be given the index
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(row) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(row, i, n), sep))
        return F.when(F.size(row) >= n, runs).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(F.array(tokens), of))


def char_cosine(a: Column, b: Column) -> Column:
    """Cosine of the character counts of two strings; null if either is empty or null."""
    chars = F.array_distinct(F.split(F.concat(a, b), ""))
    count = lambda s, ch: F.length(s) - F.length(F.replace(s, ch, F.lit("")))
    products = F.transform(F.filter(chars, lambda ch: ch != ""), lambda ch: F.struct((count(a, ch) * count(b, ch)).alias("ab"), (count(a, ch) * count(a, ch)).alias("aa"), (count(b, ch) * count(b, ch)).alias("bb")))
    total = lambda f: F.aggregate(products, F.lit(0).cast("bigint"), lambda acc, x: acc + x[f])
    return F.when((F.length(a) > 0) & (F.length(b) > 0), total("ab") / F.sqrt(total("aa").cast("double") * total("bb").cast("double")))


def require(columns: list[str], *needed: str) -> None:
    """ValueError if a needed column is missing."""
    if missing := [c for c in needed if c not in columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
