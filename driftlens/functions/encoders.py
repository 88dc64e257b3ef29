"""Texts as vectors. No encoder model ships: any function of a text column that gives an array of doubles can be passed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.functions import text as T

Encoder = Callable[[Column], Column]
WIDTH = 64


def slots(text: Column, width: int = WIDTH) -> Column:
    """The slot of each word of a text, in lower case: the first byte of the word's MD5 digest, by ``width`` (256 at most)."""
    return F.transform(T.words(F.lower(text)), lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 2), 16, 10).cast("int") % width)


def hashed_bag(text: Column, width: int = WIDTH) -> Column:
    """How many words of a text fall on each slot; null counts as empty."""
    found = slots(F.coalesce(text, F.lit("")), width)
    return T.let(found, lambda at: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda d: F.size(F.filter(at, lambda i: i == d)).cast("double")))


def encoded(df: DataFrame, text: str, encoder: Encoder = hashed_bag, out: str = "embedding", once: bool = False) -> DataFrame:
    """``df`` with the vector of ``text``. With ``once`` each distinct text is encoded once and joined back, which pays for a slow encoder."""
    if not once:
        return df.withColumn(out, encoder(F.col(text)))
    known = df.select(F.col(text).alias("_t")).where("_t IS NOT NULL").distinct().withColumn(out, encoder(F.col("_t")))
    return df.join(known, F.col(text) == F.col("_t"), "left").drop("_t")
