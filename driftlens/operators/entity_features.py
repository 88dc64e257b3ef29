"""Problem 2: one row per account with counts, recency and totals for every event type.

``apply`` is the operator: state, known versions and a batch of deliveries in, the new state and versions out. A batch whose
deliveries come later than those known costs what it holds itself; the state of all deliveries is the one that starts from nothing.

Features are kept by signed deltas. A delivery of a message inserts it (+1); a later delivery of the same
message that differs retracts the earlier version (-1) and inserts its own. Counts and totals are sums of
signed values, so new deltas are added to an old state without reading old events; of these only the current version of
each event is kept with the state, which a later batch's retractions are derived against. First and latest event
aren't sums: they are taken from the inserts, and only for the account and event type pairs whose extreme is
touched by a retraction they are worked out again from the surviving events.

Defined results
* Null or blank ``user_id``: the row belongs to no account and is left out.
* Null, unreadable or impossible ``timestamp``: the row is left out. A readable one counts as written.
* Null or blank intent is ``unknown``; a risk outside low, medium, high, critical is ``unset``.
* Null text has 0 characters. Equal instants are ordered by ``message_id``.
* Equal deliveries of a message count once, whatever their number; rows with a null ``message_id`` can't be
  matched with others and are left out.
* Empty tables give empty results. Extra columns are ignored; no column is added to the input under a name it
  might have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.functions.accounts import account_key, account_names
from driftlens.functions.timestamps import iso_instant
from driftlens.storage import cut

#: The risk levels that count as such.
RISKS = ("low", "medium", "high", "critical")
KEYS = ["account", "event_type"]


def event_type(intent: Column, risk: Column) -> Column:
    """``<intent>:<risk>`` in lower case and without outer blanks; ``unknown`` and ``unset`` where missing."""
    i, r = F.lower(F.trim(intent)), F.lower(F.trim(risk))
    return F.concat_ws(":", F.when(i != "", i).otherwise("unknown"), F.when(r.isin(*RISKS), r).otherwise("unset"))


def deliveries(messages: DataFrame) -> DataFrame:
    """The columns that features need of each delivery; narrow, as these are what is shuffled."""
    return messages.select(
        F.col("message_id").alias("event_id"),
        F.col("ingested_at").alias("version"),
        account_key(F.col("user_id")).alias("account"),
        event_type(F.col("detected_intent"), F.col("operation_risk")).alias("event_type"),
        iso_instant(F.col("timestamp")).alias("at"),
        F.coalesce(F.length("message_text"), F.lit(0)).cast("long").alias("chars"),
    ).where(F.col("event_id").isNotNull())


#: What a version of an event is told apart by, after its arrival.
VERSION = ["account", "event_type", "at", "chars"]


def current(delivered: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The version of each event that counts, of ``delivered`` and of those ``known`` before; in the form of ``deliveries``."""
    rows = delivered if known is None else delivered.unionByName(known)
    return rows.groupBy("event_id").agg(F.max(F.struct("version", *VERSION)).alias("v")).select("event_id", "v.*")


def event_deltas(delivered: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``(event_id, account, event_type, at, chars, sign)`` from deliveries: one shuffle, on the event's id.

    Per event, in order of arrival: +1 for the first version, nothing for an equal one, -1 for the version
    replaced and +1 for the new one otherwise. Versions without account or instant insert nothing. ``known`` has the
    current version of events of earlier batches: it is in the state already, and what is older than it comes too late.
    """
    fields = ["account", "event_type", "at", "chars"]
    version = F.struct(*fields)
    by_event = Window.partitionBy("event_id").orderBy(F.col("version").asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in fields])
    pair = ["event_id", version.alias("now"), F.lag(version).over(by_event).alias("was")]
    if known is None:
        seen = delivered.select(*pair)
    else:
        marked = delivered.withColumn("_known", F.lit(False)).unionByName(known.withColumn("_known", F.lit(True)))
        settled = F.max("_known").over(by_event.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        seen = marked.select(*pair, settled.alias("_settled")).where(~F.col("_settled"))

    def counts(v: str) -> Column:
        return F.col(f"{v}.account").isNotNull() & F.col(f"{v}.at").isNotNull()

    def signed(v: str, sign: int) -> Column:
        return F.struct(F.lit(sign).cast("long").alias("sign"), F.col(v).alias("v"))

    # The first row and equal rows make one entry at most; explode isn't needed for them, so it stays cheap.
    out = F.when(F.col("was").isNull(), F.array(signed("now", 1))).when(F.col("was").eqNullSafe(F.col("now")), F.array().cast(
        "array<struct<sign:bigint,v:struct<account:string,event_type:string,at:timestamp,chars:bigint>>>"
    )).otherwise(F.array(signed("was", -1), signed("now", 1)))
    return (
        seen.where(counts("now") | counts("was"))
        .select("event_id", F.explode(out).alias("d"))
        .select("event_id", "d.v.*", "d.sign")
        .where(F.col("account").isNotNull() & F.col("at").isNotNull())
    )


def fold(deltas: DataFrame) -> DataFrame:
    """The state per account and event type: signed sums, and the extremes of inserts and of retractions.

    Spark combines rows on the map side first, so that an account with a third of all rows sends a row per
    event type and task.
    """
    when = F.struct(F.col("at"), F.col("event_id"))
    ins, ret = F.when(F.col("sign") > 0, when), F.when(F.col("sign") < 0, when)
    return deltas.groupBy(*KEYS).agg(
        F.sum("sign").alias("n"),
        F.sum(F.col("sign") * F.col("chars")).alias("total_chars"),
        F.min(ins).alias("first"),
        F.max(ins).alias("last"),
        F.min(ret).alias("first_gone"),
        F.max(ret).alias("last_gone"),
    )


def merge(state: DataFrame, added: DataFrame) -> DataFrame:
    """Two states made one: counts and totals add, extremes combine. Nothing is read again."""
    return (
        state.unionByName(added)
        .groupBy(*KEYS)
        .agg(
            F.sum("n").alias("n"),
            F.sum("total_chars").alias("total_chars"),
            F.min("first").alias("first"),
            F.max("last").alias("last"),
            F.min("first_gone").alias("first_gone"),
            F.max("last_gone").alias("last_gone"),
        )
    )


def touched(state: DataFrame) -> Column:
    """Whether a retraction reaches the first or the latest event of the pair."""
    return F.coalesce((F.col("last_gone") >= F.col("last")) | (F.col("first_gone") <= F.col("first")), F.lit(False))


def settle(state: DataFrame, deltas: DataFrame) -> DataFrame:
    """``(account, event_type, n, total_chars, first, last)``, with extremes worked out again where touched.

    Only the touched pairs are joined back to their deltas; what survives of them is aggregated by event first
    and by pair then, each with map-side combination.
    """
    hit = cut(state.where(touched(state)).select(*KEYS), "touched")  # its size decides how it is joined
    alive = (
        deltas.join(hit, KEYS, "left_semi")
        .groupBy(*KEYS, "event_id", "at")
        .agg(F.sum("sign").alias("s"))
        .where("s > 0")
        .groupBy(*KEYS)
        .agg(F.min(F.struct("at", "event_id")).alias("first_again"), F.max(F.struct("at", "event_id")).alias("last_again"))
    )
    left = state.where("n > 0")
    return left.join(alive, KEYS, "left").select(
        *KEYS,
        "n",
        "total_chars",
        F.when(touched(left), F.col("first_again")).otherwise(F.col("first")).alias("first"),
        F.when(touched(left), F.col("last_again")).otherwise(F.col("last")).alias("last"),
    )


def repeated(messages: DataFrame, event_id: str = "message_id") -> DataFrame:
    """``(event_id)``: the events that are delivered more than once; only ids are read and shuffled. Written, so that its size is known."""
    counts = messages.where(F.col(event_id).isNotNull()).groupBy(F.col(event_id).alias("event_id")).agg(F.count(F.lit(1)).alias("n"))
    return cut(counts.where("n > 1").select("event_id"), "repeated")


def batch_deltas(messages: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``event_deltas`` of a batch, written once, as both the sums and the extremes are made of them.

    An event that is delivered once, and that no earlier batch knows, inserts itself: only the others are shuffled by event.
    """
    again = repeated(messages)
    if known is not None:
        ids = messages.where("message_id IS NOT NULL").select(F.col("message_id").alias("event_id"))
        again = cut(again.unionByName(known.select("event_id").join(ids, "event_id", "left_semi")).distinct(), "repeated")
    rows = deliveries(messages)
    # Rows without account or instant are left out after the table is written: a filter here would work out both a second time.
    able = F.col("account").isNotNull() & F.col("at").isNotNull()
    once = rows.join(again, "event_id", "left_anti").select("event_id", *VERSION, F.when(able, F.lit(1)).cast("long").alias("sign"))
    more = event_deltas(rows.join(again, "event_id", "left_semi"), None if known is None else known.join(again, "event_id", "left_semi"))
    return cut(once.unionByName(more.select(*once.columns)), "deltas").where("sign IS NOT NULL")


def apply(state: DataFrame | None, known: DataFrame | None, messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state, versions) after a batch of messages.

    ``state`` has ``account, event_type, n, total_chars, first, last`` of each pair, ``known`` the current version of each event (as
    ``deliveries``). A pair whose extreme is retracted is worked out again from its current versions; all others from sums alone.
    """
    deltas = batch_deltas(messages, known)
    added = fold(deltas)
    if state is not None:
        gone = [F.lit(None).cast(dict(added.dtypes)[c]).alias(c) for c in ("first_gone", "last_gone")]
        added = merge(state.select(*KEYS, "n", "total_chars", "first", "last", *gone), added)
    added = cut(added, "state")
    versions = current(deliveries(messages), known)
    source = deltas if known is None else cut(versions, "versions").where("account IS NOT NULL AND at IS NOT NULL").withColumn("sign", F.lit(1).cast("long"))
    return settle(added, source), versions


def named(state: DataFrame, messages: DataFrame, users: DataFrame) -> DataFrame:
    """A state with the account's id in results in place of its key."""
    return state.join(account_names(messages, users), "account").select(F.col("account_id").alias("user_id"), "event_type", "n", "total_chars", "first", "last")


def features(messages: DataFrame, users: DataFrame) -> DataFrame:
    """``(user_id, event_type, n, total_chars, first, last)`` for all accounts in ``messages``."""
    return named(apply(None, None, messages)[0], messages, users)


def feature_table(messages: DataFrame, users: DataFrame) -> DataFrame:
    """One row per account: totals over all types and, by type, count, first and latest instant, characters.

    The map has an entry per event type that the account has, a few hundred at most, as rows are aggregated
    by pair before they meet in one row.
    """
    return features(messages, users).groupBy("user_id").agg(
        F.sum("n").alias("n_messages"),
        F.sum("total_chars").alias("n_chars"),
        F.min("first.at").alias("first_at"),
        F.max("last.at").alias("last_at"),
        F.map_from_entries(
            F.array_sort(
                F.collect_list(
                    F.struct("event_type", F.struct("n", F.col("first.at").alias("first_at"), F.col("last.at").alias("last_at"), "total_chars").alias("f"))
                )
            )
        ).alias("by_type"),
    )


def p2_found(messages: DataFrame, users: DataFrame) -> DataFrame:
    return features(messages, users).select(
        "user_id", "event_type", F.col("first.event_id").alias("first_message_id"), F.col("last.event_id").alias("last_message_id")
    )
