"""Problem 8: documents spoilt by template residue, filler, error pages or script notices.

Records made from one template agree but in its slots. A sign whose form tells by itself (``{{name}}``, ``[Your Name]``,
``XX/XX/XXXX``) is an unfilled slot. Other signs - one that is quoted or spoken of, a bare default (null, N/A), a blank
that has left a trace, a bare variable name that the corpus has in a sign elsewhere - are decided by alignment:
the records with the same three words or marks on either side are of one template. The place is a slot if most of these
records fill it, and no filling stands in more than half of those that do; then the sign is what was left in it.
Else it is wording (a sentence about syntax). Both are shares, so the size of the table says nothing.

Messages of error pages, script notices and filler are recognised by their forms alone, not by their repetition: one
message makes its document a case, and a sentence that many documents share is mostly an ordinary one.

Two passes over the texts in Arrow batches. The second only keeps what stands in the places of the first's open signs
(by a bitmap of 2 MB, which may let others pass; the join is exact), so that facts and fillings are what is shuffled.
A template that a third of all documents has is combined before the shuffle. Copies of a place with the segments around
count once.

Defined results: null and empty texts hold nothing; rows with a null id are left out; repeated documents are
each listed. ``clean`` keeps all columns, null texts and rows with a null id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm.residue_forms import facts, fillings, places
from driftlens.sources.tables import spread
from driftlens.storage import cut

#: Words of the bitmap of places, a power of two; a word has 64 bits.
BITMAP = 1 << 18
_VARIABLE = r"([A-Za-z]+(?:_[A-Za-z]+)+|[a-z]+[A-Z][A-Za-z]+)"


def residue_facts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, kind, template, value, beside, place)``; hashes in place of the texts of template and surroundings."""

    @F.pandas_udf("array<struct<kind:string,template:string,value:string,beside:string,place:long>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[f._asdict() for f in facts(t) + places(t)] if t else [] for t in texts.tolist()])

    rows = spread(documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_t")))
    return rows.select("doc_id", F.explode(found(F.col("_t"))).alias("f")).select(
        "doc_id", "f.kind", F.xxhash64("f.template").alias("template"), "f.value", F.xxhash64("f.beside").alias("beside"), "f.place"
    )


def slots(documents: DataFrame, open_: DataFrame, text: str = "text") -> DataFrame:
    """``(place)``: those places of the open signs that most records fill, and fill with varying values."""
    words = open_.groupBy(F.expr(f"cast(shiftrightunsigned(place, 6) & {BITMAP - 1} AS int)").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 AS int))")).alias("bits")).collect()
    wanted = np.zeros(BITMAP, dtype=np.uint64)
    for r in words:
        wanted[r["w"]] = np.uint64(r["bits"] & (1 << 64) - 1)
    if not words:
        return open_.select("place")
    shared = documents.sparkSession.sparkContext.broadcast(wanted)

    @F.pandas_udf("array<struct<place:long,value:long,beside:long>>")
    def filled(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"place": p, "value": v, "beside": b} for p, v, b in fillings(t, shared.value)] for t in texts.tolist()])

    held = spread(documents.where(F.length(text) > 0).select(F.col(text).alias("_t"))).select(F.explode(filled(F.col("_t"))).alias("f")).select("f.*").distinct()
    by_place = held.groupBy("place", "value").agg(F.count(F.lit(1)).alias("n")).groupBy("place").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    left = open_.select("place", "beside").distinct().groupBy("place").agg(F.count(F.lit(1)).alias("n_open"))
    return left.join(by_place, "place").where((2 * F.col("most") <= F.col("n")) & (F.col("n") > F.col("n_open"))).select("place")


def spoilt(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, kinds)``: the spoilt documents and what spoils them."""
    found = cut(residue_facts(documents, doc_id, text), "residue")
    known = found.where("kind = 'slot'").select(F.regexp_extract("value", _VARIABLE, 1).alias("value")).where("value != ''").distinct()
    names = found.where("kind = 'name'").join(known, "value", "left_semi").select("doc_id", "place", "beside")
    open_ = found.where("kind = 'open'").select("doc_id", "place", "beside").unionByName(names)
    unfilled = open_.join(slots(documents, open_, text), "place", "left_semi").select("doc_id", F.lit("slot").alias("kind"))
    return (
        unfilled.unionByName(found.where("kind NOT IN ('open', 'name')").select("doc_id", "kind"))
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    )


def clean(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` without the spoilt ones."""
    bad = spoilt(documents, doc_id, text).select(F.col("doc_id").alias("_bad"))
    return documents.join(bad, F.col(doc_id) == F.col("_bad"), "left_anti")


def p8_found(documents: DataFrame) -> DataFrame:
    return spoilt(documents).select("doc_id")
