"""Problem 7: a mixture of sources at target shares of all tokens, by Pareto order sampling.

A source that must give more tokens than it has gives whole copies of every document first. What is left to its
need is a sample without replacement of unequal probabilities: each document gets the odds of a uniform random
number divided by the odds of its inclusion probability, and documents are taken in that order up to the tokens
needed. Random numbers are hashes of the document's id and a seed, so a mixture can be made again.

The order isn't made by sorting a source in one task: documents fall into ``BUCKETS`` ranges of the order, tokens are
summed by source and range (combined before the shuffle), and only the one range of a source where its need is met
is sorted, a few thousandths of its documents.

Without ``total_tokens`` the mixture is the largest that reaches all shares exactly, given the repeats: the source that is scarcest for its share
sets the total, and what the others could give beyond it is not used. ``total_tokens`` sets the total instead; then a source that can't
give its part gives all it may and the others keep their targets, so that one small source doesn't shrink the mixture.

Defined results
* Sources that the targets lack, and documents with null source, text, id or an empty text, aren't used.
* Shares null or not positive, and null sources, are left out; shares are scaled to sum to 1 over the sources that
  have tokens, so a source without documents leaves its share to the others in proportion. A null ``max_repeats`` is 1; one below 1 bars the source.
* A source listed twice has the sum of its shares and the larger number of repeats.
* No usable source or no documents: empty results. Extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftlens.sources.tables import spread
from driftlens.storage import cut

BUCKETS = 4096
#: Fixed value: how the public vocabulary splits text before it merges bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "byte_bpe_50k.tiktoken"


def tokenizer_path(name: str = VOCABULARY) -> str:
    """Where the public tokenizer's file lies on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def with_tokens(documents: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``documents`` with ``_tokens``: the number of tokens of the whole text in a public byte-level BPE.

    The vocabulary is the file at ``path``, or at the setting ``spark.driftlens.tokenizer``, or the installed public one. The driver
    reads it, some megabytes, and sends it to the workers, which needn't have it.
    """
    spark = documents.sparkSession
    file = path or spark.conf.get("spark.driftlens.tokenizer", None) or tokenizer_path()
    with open(file, "rb") as f:
        held = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, held.value.splitlines())}
        coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for texts in batches:
            yield pd.Series([len(coder.encode_ordinary(t)) if t else 0 for t in texts.tolist()])

    return documents.withColumn("_tokens", count(F.col(text)))


def plan(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Per source: ``share`` (scaled), ``have``, ``need``, whole copies ``whole`` and the sample's ``rest`` tokens."""
    listed = (
        targets.where(F.col("source").isNotNull() & (F.col("target_share") > 0) & (F.coalesce("max_repeats", F.lit(1)) >= 1))
        .groupBy("source")
        .agg(F.sum("target_share").alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).cast("long").alias("max_repeats"))
    )
    have = sized.groupBy("source").agg(F.sum("_tokens").alias("have"), F.count(F.lit(1)).alias("n_docs")).where("have > 0")
    rows = listed.join(have, "source")
    whole = rows.agg(F.sum("share").alias("all_share"))
    rows = rows.crossJoin(F.broadcast(whole)).withColumn("share", F.col("share") / F.col("all_share"))  # one row
    reach = rows.agg(F.min(F.col("have") * F.col("max_repeats") / F.col("share")).alias("reach"))
    total = F.col("reach") if total_tokens is None else F.lit(float(total_tokens))
    rows = rows.crossJoin(F.broadcast(reach))  # one row
    need = F.least(total * F.col("share"), (F.col("have") * F.col("max_repeats")).cast("double"))
    return (
        rows.withColumn("need", need)
        .withColumn("whole", F.least(F.floor(F.col("need") / F.col("have") + 1e-9), F.col("max_repeats")))
        .withColumn("rest", F.greatest(F.lit(0.0), F.col("need") - F.col("whole") * F.col("have")))
        .select("source", "share", "max_repeats", "n_docs", "have", "need", "whole", "rest")
    )


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, weight: str | None = None, seed: int = 17, path: str | None = None) -> DataFrame:
    """``(doc_id, source, n_tokens, copies)``: the documents of the mixture and how often each is in it.

    ``weight`` names a positive column that inclusion probabilities are proportional to; all are alike without it.
    """
    used = documents.where(F.col("doc_id").isNotNull() & F.col("source").isNotNull() & (F.length("text") > 0))
    listed = cut(targets.where("target_share > 0 AND source IS NOT NULL").select("source").distinct(), "sources")
    used = used.join(listed, "source", "left_semi")  # its size is known, and decides how it is joined
    sized = cut(
        with_tokens(spread(used), path=path).select("doc_id", "source", "_tokens", (F.lit(1.0) if weight is None else F.greatest(F.col(weight).cast("double"), F.lit(1e-9))).alias("_w")).where("_tokens > 0"), "sized"
    )
    mass = sized.groupBy("source").agg(F.sum(F.col("_w") * F.col("_tokens")).alias("mass"))
    per = cut(plan(sized, targets, total_tokens).join(mass, "source"), "plan")
    if weight is not None:
        per = cut(_renewed(sized, per), "plan")
    # inclusion probabilities that make the expected tokens the rest; certain ones come first in the order
    p = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-12), F.col("_w") * F.col("rest") / F.col("mass")))
    u = (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    odds = (u / (1 - u)) / (p / (1 - p))
    ranked = sized.join(per.select("source", "whole", "rest", "mass"), "source").withColumn("_q", odds / (1 + odds))
    ranked = ranked.withColumn("_b", F.least(F.floor(F.col("_q") * BUCKETS), F.lit(BUCKETS - 1)))
    sums = ranked.groupBy("source", "_b").agg(F.sum("_tokens").alias("_t"), F.first("rest").alias("_r"), F.first("whole").alias("_k"))
    before = F.coalesce(F.sum("_t").over(Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Of a source, the ranges before the one that reaches the rest are in, those after it out: that one row says it all.
    edges = sums.withColumn("_before", before).where((F.col("_before") < F.col("_r")) & (F.col("_before") + F.col("_t") >= F.col("_r")))
    edges = cut(edges.select("source", F.col("_b").alias("_edge"), "_before"), "edges")
    placed = ranked.join(edges, "source", "left")
    at = F.coalesce(F.col("_edge"), F.when(F.col("rest") > 0, F.lit(BUCKETS)).otherwise(F.lit(-1)))  # without an edge all are in, or none
    clear = placed.where(F.col("_b") != at).select("doc_id", "source", "_tokens", (F.col("whole") + (F.col("_b") < at).cast("long")).alias("copies"))
    within = Window.partitionBy("source").orderBy("_q", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the last document is taken where that comes nearer to the need than leaving it out
    so_far = F.col("_before") + F.sum("_tokens").over(within)
    edge = placed.where(F.col("_b") == at).withColumn("_in", (so_far - F.col("_tokens") / 2 <= F.col("rest")).cast("long"))
    edge = edge.select("doc_id", "source", "_tokens", (F.col("whole") + F.col("_in")).alias("copies"))
    return clear.unionByName(edge).where("copies > 0").withColumnRenamed("_tokens", "n_tokens")


def _renewed(sized: DataFrame, per: DataFrame) -> DataFrame:
    """``per`` with the mass by which the probabilities that stay below 1 make up for those that would be above it.

    A document is certain if its weight times rest over mass is 1 or more. What the certain ones give is taken off the rest and
    their weight off the mass, again until none is added: the mass is scaled so that the order's formula holds as it is.
    """
    now = per.withColumn("_mass", F.col("mass"))
    for _ in range(5):
        sure = F.col("_w") * F.col("rest") >= F.col("_mass")
        sums = sized.join(now.select("source", "rest", "_mass"), "source").groupBy("source").agg(F.sum(F.when(sure, F.col("_tokens")).otherwise(0)).alias("_given"), F.sum(F.when(sure, 0.0).otherwise(F.col("_w") * F.col("_tokens"))).alias("_free"))
        left = F.greatest(F.col("rest") - F.col("_given"), F.lit(1e-9))
        renewed = F.when((F.col("_given") > 0) & (F.col("_free") > 0), F.col("rest") * F.col("_free") / left).otherwise(F.col("_mass"))
        now = cut(now.join(sums, "source").withColumn("_was", F.col("_mass")).withColumn("_mass", renewed).drop("_given", "_free"), "mass")
        done = now.where(F.abs(F.col("_mass") - F.col("_was")) > 1e-9 * F.col("_was")).isEmpty()
        now = now.drop("_was")
        if done:
            break
    return now.withColumn("mass", F.col("_mass")).drop("_mass")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, target_share, n_docs, n_records, n_tokens, actual_share)`` for every listed source."""
    got = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("copies").alias("n_records"), F.sum(F.col("copies") * F.col("n_tokens")).alias("n_tokens"))
    total = F.sum("n_tokens").over(Window.partitionBy(F.lit(0)))  # a row per listed source
    return (
        targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("target_share").alias("target_share")).join(got, "source", "left").na.fill(0, ["n_docs", "n_records", "n_tokens"])
        .withColumn("actual_share", F.when(total > 0, F.col("n_tokens") / total).otherwise(0.0))
    )
