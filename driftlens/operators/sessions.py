"""Problem 4: sessions from event times, by a Cartesian tree over the gaps of each account.

The events of an account in order of instant have a gap between each two neighbours. The Cartesian tree of the
gaps (largest gap at the root) holds every session split there is: a node stands for the run of events that is
joined by gaps no larger than its own. Cutting at a threshold picks the nodes whose gap is within it while
their parent's isn't; one tree serves any number of settings without another shuffle.

Events are range-partitioned by account, instant and id, so an account with a third of all rows is spread over
as many tasks as its rows need. A task builds the tree of its chunk with one stack. A node that isn't bounded by a
larger gap on both sides within the chunk (the chunk's spine) stays open; the spines of an account's chunks,
and nothing else, are merged in a second step. A spine is a run of falling gaps at either end of a chunk: about
the logarithm of the chunk's rows, and never more than the square root of twice the spanned time.

Defined results
* Null or blank account, null or unreadable timestamp: the row is left out; implausible dates count as written.
* A row delivered more than once (same id) counts once: the latest delivery, where there is an arrival time.
* Equal instants are ordered by id; the gap between them is 0. A null id is left out.
* A gap equal to the threshold stays within the session. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.functions.accounts import account_key, account_names
from driftlens.functions.timestamps import iso_instant, micros
from driftlens.storage import cut as write_cut

#: A gap larger than any: the edge of an account's history.
EDGE = int(np.iinfo(np.int64).max)
#: What a single event has in place of a gap.
LEAF = -1
NODES = "record_set string, account string, gap long, parent_gap long, first_id long, last_id long, start_us long, end_us long, n long"
ORDER = ["record_set", "account", "us", "event_id"]


def events_of(table: DataFrame, record_set: str, event_id: str, account: Column, instant: Column, version: Column | None = None) -> DataFrame:
    """``(record_set, account, event_id, us)``, a row per event: the latest version of each id that has both."""
    rows = table.select(
        F.col(event_id).cast("long").alias("event_id"),
        (F.lit(None).cast("timestamp") if version is None else version).alias("version"),
        account.alias("account"),
        micros(instant).alias("us"),
    ).where(F.col("event_id").isNotNull())
    latest = rows.groupBy("event_id").agg(F.max(F.struct("version", "account", "us")).alias("v"))
    return latest.where("v.account IS NOT NULL AND v.us IS NOT NULL").select(F.lit(record_set).alias("record_set"), "v.account", "event_id", "v.us")


def _nodes(gaps: list[int], left: int, right: int, lo: int, out: tuple[list, list, list, list]) -> None:
    """Appends the nodes of a run of events to ``out`` (gaps, parents, first and last positions).

    ``gaps`` are those within the run, which starts at position ``lo`` and lies between the gaps ``left`` and
    ``right``. A node's parent gap is the smaller of the two gaps that bound its run.
    """
    gap, parent, first, last = out
    before = left
    for i, g in enumerate([*gaps, right]):
        gap.append(LEAF)
        parent.append(before if before < g else g)
        first.append(lo + i)
        last.append(lo + i)
        before = g
    stack: list[tuple[int, int]] = []  # (gap, first position of its run), gaps falling
    end = len(gaps)
    for i in range(end + 1):
        g = gaps[i] if i < end else EDGE
        start = i
        while stack and stack[-1][0] <= g:
            top, start = stack.pop()
            a = stack[-1][0] if stack else left
            b = g if i < end else right
            gap.append(top)
            parent.append(a if a < b else b)
            first.append(lo + start)
            last.append(lo + i)
        stack.append((g, start))


def _records(gaps: np.ndarray) -> np.ndarray:
    """Positions of the gaps that are larger than all before or than all after them: the spine."""
    if not len(gaps):
        return np.empty(0, dtype=np.int64)
    up = np.maximum.accumulate(gaps)
    down = np.maximum.accumulate(gaps[::-1])[::-1]
    left = np.concatenate([[True], gaps[1:] > up[:-1]])
    right = np.concatenate([gaps[:-1] > down[1:], [True]])
    return np.flatnonzero(left | right)


def _frame(keys: tuple, us: np.ndarray, ids: np.ndarray, out: tuple[list, list, list, list]) -> pd.DataFrame:
    gap, parent, first, last = (np.asarray(x, dtype=np.int64) for x in out)
    return pd.DataFrame(
        {
            "record_set": keys[0], "account": keys[1], "gap": gap, "parent_gap": parent,
            "first_id": ids[first], "last_id": ids[last], "start_us": us[first], "end_us": us[last], "n": last - first + 1,
        }
    )


def _chunk(keys: tuple, us: np.ndarray, ids: np.ndarray, whole: bool) -> pd.DataFrame:
    """The nodes of one account's events in one task.

    If the account may go on in other tasks, the run is split at its spine: the inner nodes of each block
    between two spine gaps are final, the blocks themselves (``parent_gap`` -1 marks them) go to the merge.
    """
    gaps = np.diff(us)
    out: tuple[list, list, list, list] = ([], [], [], [])
    if whole:
        _nodes(gaps.tolist(), EDGE, EDGE, 0, out)
        return _frame(keys, us, ids, out)
    spine = _records(gaps)
    starts = np.concatenate([[0], spine + 1])
    ends = np.concatenate([spine, [len(us) - 1]])
    every = gaps.tolist()
    last = len(starts) - 1
    for k, (lo, hi) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        if k not in (0, last):  # these two are single events at the ends of the chunk
            _nodes(every[lo:hi], every[lo - 1], every[hi], lo, out)
    for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True):
        for x, v in zip(out, (0, LEAF, lo, hi), strict=True):
            x.append(v)
    frame = _frame(keys, us, ids, out)
    frame.iloc[[len(frame) - 1 - last, len(frame) - 1], 2] = LEAF
    return frame


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over a sorted partition. Its first and last account may go on in the neighbouring partitions."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    keys: tuple | None = None
    first = True

    def close(whole: bool) -> pd.DataFrame:
        return _chunk(keys, np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held]), whole)

    for batch in batches:
        if not len(batch):
            continue
        a, s = batch["account"].to_numpy(), batch["record_set"].to_numpy()
        us, ids = batch["us"].to_numpy(), batch["event_id"].to_numpy()
        cuts = np.flatnonzero((a[1:] != a[:-1]) | (s[1:] != s[:-1])) + 1
        made = []
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(a)], strict=True):
            if keys != (s[lo], a[lo]):
                if keys is not None:
                    made.append(close(whole=not first))
                    first = False
                keys, held = (s[lo], a[lo]), []
            held.append((us[lo:hi], ids[lo:hi]))
        if made:
            yield pd.concat(made, ignore_index=True)
    if keys is not None:
        yield close(whole=False)


def _merge(blocks: pd.DataFrame) -> pd.DataFrame:
    """The nodes above the blocks of one account: the stack again, with blocks in place of events."""
    b = blocks.sort_values(["start_us", "first_id"], kind="stable")
    start, end = b["start_us"].to_numpy(), b["end_us"].to_numpy()
    first, last, n = b["first_id"].to_numpy(), b["last_id"].to_numpy(), np.concatenate([[0], np.cumsum(b["n"].to_numpy())])
    out: tuple[list, list, list, list] = ([], [], [], [])
    _nodes((start[1:] - end[:-1]).tolist(), EDGE, EDGE, 0, out)
    gap, parent, lo, hi = (np.asarray(x, dtype=np.int64) for x in out)
    single = (gap == LEAF) & (b["gap"].to_numpy() == LEAF)[lo]
    keep = (gap != LEAF) | single  # the nodes of inner blocks are there already
    gap, parent, lo, hi = gap[keep], parent[keep], lo[keep], hi[keep]
    return pd.DataFrame(
        {
            "record_set": b["record_set"].iloc[0], "account": b["account"].iloc[0], "gap": gap, "parent_gap": parent,
            "first_id": first[lo], "last_id": last[hi], "start_us": start[lo], "end_us": end[hi], "n": n[hi + 1] - n[lo],
        }
    )


def gap_tree(events: DataFrame) -> DataFrame:
    """The Cartesian trees of all accounts in ``events`` (record_set, account, event_id, us), as a table of nodes.

    A node is the run of events from ``first_id`` to ``last_id`` that gaps up to ``gap`` join (-1: one event);
    ``parent_gap`` is the smallest gap that would join it to more.
    """
    parts = write_cut(
        events.select(*ORDER).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).mapInPandas(_chunks, NODES), "gap-chunks"
    )
    upper = parts.where(F.col("parent_gap") == LEAF).groupBy("record_set", "account").applyInPandas(_merge, NODES)
    return parts.where(F.col("parent_gap") != LEAF).unionByName(upper)


def cut(tree: DataFrame, gap_seconds: float) -> DataFrame:
    """Sessions at a threshold: the nodes within it whose parent isn't. A filter, without a shuffle."""
    limit = int(gap_seconds * 1_000_000)
    return tree.where((F.col("gap") <= limit) & (F.col("parent_gap") > limit)).select(
        "record_set", "account", "first_id", "last_id", "start_us", "end_us", "n"
    )


def account_events(messages: DataFrame, message_records: DataFrame) -> DataFrame:
    """The events of both tables, each set taken apart."""
    return events_of(
        messages, "messages", "message_id", account_key(F.col("user_id")), iso_instant(F.col("timestamp")), F.col("ingested_at")
    ).unionByName(events_of(message_records, "message_records", "record_id", account_key(F.col("user_id")), iso_instant(F.col("timestamp"))))


def sessions(messages: DataFrame, message_records: DataFrame, users: DataFrame, gap_seconds: float = 1800) -> DataFrame:
    """``(record_set, user_id, first_id, last_id, started_at, ended_at, duration_seconds, n_messages)``."""
    names = account_names(messages.select("user_id").unionByName(message_records.select("user_id")), users)
    found = cut(gap_tree(account_events(messages, message_records)), gap_seconds)
    return found.join(names, "account").select(
        "record_set",
        F.col("account_id").alias("user_id"),
        "first_id",
        "last_id",
        F.timestamp_micros("start_us").alias("started_at"),
        F.timestamp_micros("end_us").alias("ended_at"),
        ((F.col("end_us") - F.col("start_us")) / 1e6).alias("duration_seconds"),
        F.col("n").alias("n_messages"),
    )


def p4_found(messages: DataFrame, message_records: DataFrame, users: DataFrame) -> DataFrame:
    return sessions(messages, message_records, users).select("record_set", "user_id", "first_id", "last_id")
