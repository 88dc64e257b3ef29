"""Account ids: one key for every spelling of an id, and the name an account goes by in results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Full-width forms U+FF01..U+FF5E stand for the ASCII characters 0xFEE0 below them.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))

INVISIBLE = r"[\p{Cf}\p{Cc}]"
EDGES = r"^[\p{Z}\s\"'`<>()\[\]]+|[\p{Z}\s\"'`<>()\[\]]+$"
NAMESPACE = r"^[a-z]+[:/=#][\p{Z}\s]*"
SEPARATORS = r"[\p{Pd}\p{Z}\s_.−]+"
PARTS = r"^([a-z]+[0-9]{2})-?0*([0-9]+)(?:-?([a-z]+))?$"


def account_key(user_id: Column) -> Column:
    """The same string for every spelling of one account id; null for null or blank ids.

    Case, full-width forms, invisible characters, quotes and blanks at the ends, a name-space prefix
    (``user:``, ``acct/``), the kind of separator and leading zeros of the number don't count. A letter that
    follows the number does: ``u00-000123`` and ``u00-000123-b`` are two accounts.
    """
    s = F.lower(F.translate(user_id, _WIDE, _NARROW))
    s = F.regexp_replace(s, r"[\t\r\n]", " ")
    s = F.regexp_replace(s, INVISIBLE, "")
    s = F.regexp_replace(s, EDGES, "")
    s = F.regexp_replace(s, NAMESPACE, "")
    s = F.regexp_replace(s, SEPARATORS, "-")
    s = F.regexp_replace(s, PARTS, "$1-$2-$3")
    return F.when(s != "", s)


def account_names(messages: DataFrame, users: DataFrame, user_id: str = "user_id") -> DataFrame:
    """``(account, account_id)``: the key of each account in ``messages`` or ``users`` and its id in results.

    The id is the one of ``users``; for an account that ``users`` lacks, the spelling that most rows have,
    among equals the smallest. Both inputs are aggregated to distinct spellings before anything moves.
    """
    known = (
        users.select(F.col("user_id").alias("spelling"))
        .where(F.col("spelling").isNotNull())
        .distinct()
        .select(account_key(F.col("spelling")).alias("account"), "spelling", F.lit(0).alias("_rank"), F.lit(0).cast("long").alias("_n"))
    )
    seen = (
        messages.groupBy(F.col(user_id).alias("spelling"))
        .agg(F.count(F.lit(1)).alias("_n"))
        # The key depends on the count, so that the optimizer can't move it, and its patterns, below the aggregate.
        .select(F.when(F.col("_n") > 0, account_key(F.col("spelling"))).alias("account"), "spelling", F.lit(1).alias("_rank"), "_n")
    )
    return (
        known.unionByName(seen)
        .where(F.col("account").isNotNull())
        .groupBy("account")
        .agg(F.min(F.struct("_rank", (-F.col("_n")).alias("_m"), "spelling")).alias("_best"))
        .select("account", F.col("_best.spelling").alias("account_id"))
    )
