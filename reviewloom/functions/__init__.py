"""Column helpers that more than one operator needs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(n: Column, d: Column) -> Column:
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))


def finite(x: Column) -> Column:
    """x, or 0 where it is null, NaN or infinite."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def week_of(date: Column) -> Column:
    return F.date_trunc("week", date).cast("date")


def day_number(date: Column) -> Column:
    return F.datediff(date, F.lit("1970-01-01"))


def quartile(rank: Column, n: Column) -> Column:
    """Quarter, 0 to 3, of a rank from 1 among n, cut at linear quantiles of the ranks themselves."""
    return F.when(n > 1, F.greatest(F.lit(0), F.ceil(4 * (rank - 1) / (n - 1)) - 1)).otherwise(0).cast("long")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 if either is all zero, within -1 and 1."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, clip(dot(a, b) / norm, -1.0, 1.0)).otherwise(F.lit(0.0))


def bin_right(x: Column, cuts: list[float]) -> Column:
    """How many cuts are at or below x."""
    return sum((F.when(x >= c, 1).otherwise(0) for c in cuts), F.lit(0))


def text_columns(text: Column) -> dict[str, Column]:
    """Surface features of a text; words are parted by Unicode white space."""
    t = F.coalesce(text, F.lit(""))
    words = F.size(F.filter(F.split(t, r"(?U)\s+"), lambda w: w != ""))
    least_one = F.greatest(words, F.lit(1))
    chars = F.length(t)
    return {
        "char_len": chars.cast("long"),
        "word_len": words.cast("long"),
        "log_word_len": F.log1p(words),
        "short_review_flag": (chars <= 100).cast("long"),
        "unique_token_ratio": F.size(F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit("[a-z0-9']+"), 0))) / least_one,
        "avg_token_len": F.length(F.regexp_replace(t, r"(?U)\s+", "")) / least_one,
        "numeric_token_flag": t.rlike(r"(?U)\d").cast("long"),
        "upper_ratio": F.regexp_count(t, F.lit("[A-Z]")) / F.greatest(chars, F.lit(1)),
        "exclamation_count": F.regexp_count(t, F.lit("!")).cast("long"),
        "question_count": F.regexp_count(t, F.lit(r"\?")).cast("long"),
        "text_hash": F.md5(t),
    }
