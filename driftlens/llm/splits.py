"""Problem 3: splits that keep together all records of an account, however its id is written.

Records that share an entity are joined: rows with the same spelling of ``user_id``, spellings with the same
account key, and deliveries of one message. Connected components come from alternating large-star and
small-star steps; the split follows from a hash of the component's id, laid on ranges proportional to the
targets.

Only distinct pairs of entities enter the graph, so a spelling that a third of the rows has is one node. In both
star steps the neighbours of a node are never gathered in one row: the smallest neighbour is an aggregate
(combined before the shuffle) that is joined back to the edges, and AQE splits a hot node's join partition.

The split of a component depends on its id alone, so that it stays where it is when the tables grow. Where one component is so
large that the hash could miss the targets, ``heavy_share`` may be given: components with more than that share of all rows (at most
1 / heavy_share of them) are placed first, each on the split that lacks most, and the hash ranges of the others are those that then
remain. Such a placement belongs to one version of the tables; store it with them, as another version may place components elsewhere.

Defined results
* Null or blank ``user_id``: the row belongs to no account; its message is a component of its own.
* Deliveries of one message with different spellings join these. Rows with null ``message_id`` and ``user_id`` are a
  component together. Null or negative shares count as 0; no usable share at all is an error.
* An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.functions.accounts import account_key
from driftlens.storage import cut, release

#: More rounds than any graph with 2**60 nodes needs; reached only by an error.
MAX_ROUNDS = 60


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``(node, component)`` for all nodes of ``edges``; the component is its smallest node.

    Large-star links every larger neighbour of a node to the smallest of its neighbourhood, small-star the
    node and its smaller neighbours to the smallest of these; they alternate until neither changes an edge. Each
    round is written to the shared folder, so that a lost executor doesn't bring back earlier rounds.
    """
    nodes = edges.select(F.col(u).alias("node")).union(edges.select(F.col(v))).where("node IS NOT NULL").distinct()
    now = edges.select(F.greatest(u, v).alias("hi"), F.least(u, v).alias("lo")).where("hi IS NOT NULL AND lo IS NOT NULL AND hi != lo").distinct()
    now = cut(now, "edges")
    is_now = _signature(now)
    for _ in range(MAX_ROUNDS):
        was, before = is_now, now
        now = cut(_small_star(_large_star(before)), "edges")
        release(before)
        is_now = _signature(now)
        if is_now == was:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("component"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _signature(edges: DataFrame) -> tuple:
    h = F.xxhash64("hi", "lo")
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(h), F.lit(0)), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("hi").alias("n"), F.col("lo").alias("m")).union(edges.select("lo", "hi"))
    least = both.groupBy("n").agg(F.min("m").alias("s")).select("n", F.least("n", "s").alias("s"))
    return both.where(F.col("m") > F.col("n")).join(least, "n").select(F.col("m").alias("hi"), F.col("s").alias("lo")).where("hi != lo").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("s"))
    linked = edges.join(least, "hi")
    return (
        linked.where(F.col("lo") != F.col("s"))
        .select(F.col("lo").alias("hi"), F.col("s").alias("lo"))
        .union(least.select("hi", F.col("s").alias("lo")))
        .distinct()
    )


def _spelled(user_id: Column) -> Column:
    return F.concat(F.lit("s:"), user_id)


def entity_edges(messages: DataFrame) -> DataFrame:
    """Distinct pairs of entities that a record links: spelling and account, and spellings of one message."""
    spelled = messages.where(F.col("user_id").isNotNull()).select("message_id", "user_id")
    key = account_key(F.col("user_id"))  # worked out once for each spelling, not for each row
    # It depends on the count, so that the optimizer can't move it below the aggregate.
    counted = spelled.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).withColumn("key", F.when(F.col("n") > 0, key))
    same_account = counted.where(F.col("key").isNotNull()).select(_spelled(F.col("user_id")).alias("u"), F.concat(F.lit("k:"), F.col("key")).alias("v"))
    # A message's spellings in order make a chain, which links them all.
    by_message = Window.partitionBy("message_id").orderBy("user_id")
    linked = (
        spelled.where(F.col("message_id").isNotNull())
        .withColumn("before", F.lag("user_id").over(by_message))
        .where("before != user_id")
        .groupBy("before", "user_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > 0) & F.when(F.col("n") > 0, key).isNotNull() & F.when(F.col("n") > 0, account_key(F.col("before"))).isNotNull())
        .select(_spelled(F.col("before")).alias("u"), _spelled(F.col("user_id")).alias("v"))
    )
    return same_account.union(linked)


def spelling_components(messages: DataFrame) -> DataFrame:
    """``(user_id, component)`` for every distinct spelling that denotes an account."""
    found = components(entity_edges(messages))
    return found.where(F.col("node").startswith("s:")).select(F.expr("substring(node, 3)").alias("user_id"), "component")


def _unit(id_: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(id_, F.lit("split")), F.lit(1 << 30)) / float(1 << 30)


def assign_splits(messages: DataFrame, targets: DataFrame, heavy_share: float | None = None) -> DataFrame:
    """``messages`` with its ``split_name``: a row in, a row out.

    Where the table has a ``split_name`` already, the new one replaces it.
    """
    wanted = sorted((r["split_name"], float(r["target_share"])) for r in targets.select("split_name", "target_share").collect() if r["split_name"] and (r["target_share"] or 0) > 0)
    if not wanted:
        raise ValueError("no split has a share")
    whole = sum(s for _, s in wanted)
    shares = {n: s / whole for n, s in wanted}
    spelled = cut(spelling_components(messages), "spellings")
    left, placed = dict(shares), {}
    if heavy_share is not None:
        counted = messages.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
        total = messages.count()
        sizes = counted.join(spelled, "user_id").groupBy("component").agg(F.sum("n").alias("n"))
        # At most 1 / heavy_share rows reach the driver.
        heavy = sizes.where(F.col("n") > heavy_share * total).orderBy(F.desc("n"), "component").collect()
        left = {n: s * total for n, s in shares.items()}
        for r in heavy:
            best = max(left, key=lambda n: (left[n], n))
            placed[r["component"]] = best
            left[best] -= r["n"]
    free = {n: max(0.0, x) for n, x in left.items()}
    if not sum(free.values()):
        free = dict(shares)
    last = [n for n, _ in wanted if free[n] > 0][-1]
    edge, split = 0.0, None
    for n, _ in wanted:
        edge += free[n] / sum(free.values())
        if n != last and free[n] > 0:
            within = _unit(F.col("_component")) < edge
            split = F.when(within, F.lit(n)) if split is None else split.when(within, F.lit(n))
    split = F.lit(last) if split is None else split.otherwise(F.lit(last))
    if placed:
        fixed = F.create_map(*[x for k, v in placed.items() for x in (F.lit(k), F.lit(v))])
        split = F.coalesce(F.element_at(fixed, F.col("_component")), split)
    return (
        messages.drop("split_name")
        .join(spelled.withColumnRenamed("component", "_component"), "user_id", "left")
        .withColumn("_component", F.coalesce("_component", F.concat(F.lit("m:"), F.col("message_id").cast("string")), F.lit("m:")))
        .withColumn("split_name", split)
        .drop("_component")
    )


def p3_found(messages: DataFrame) -> DataFrame:
    """Pairs of different strings that denote the same account, from the components; the smaller one first.

    A component has as many spellings as people and clients invent for one id, not as many as it has rows.
    """
    spelled = cut(spelling_components(messages), "spellings")
    a = spelled.select("component", F.col("user_id").alias("user_id_a"))
    b = spelled.select("component", F.col("user_id").alias("user_id_b"))
    return a.join(b, "component").where(F.col("user_id_a") < F.col("user_id_b")).select("user_id_a", "user_id_b")
