"""Problem 5: personal information in free text, found and replaced by typed placeholders.

Information-theoretic sanitisation: the corpus itself says how strongly a term reveals a protected entity.

1. Forms (``pii_forms``) give candidates. Some forms tell by themselves (an address with street and number, +44 ...,
   a surname after a title): these are the protected entities whose company is observed.
2. For every term - the words before a number (or above and after it, where it begins a line), the words inside and around a run of capitalised words - the
   corpus-wide counts of its candidates and of the self-telling ones among them give its disclosure: the
   information, in bits, that seeing the term gives about a protected entity being there, log2 of P(entity | term)
   over P(entity). It spreads once from names known by a title to the words that keep company with them.
3. An open candidate whose terms disclose an entity beyond the threshold is one; one among terms that don't
   (batch 204881937, Main Street) stays as it is. What is found is generalised to its type.

Texts are read once, in Arrow batches, and only those that can hold a candidate leave the JVM. What moves are
candidates, a few per hundred texts, and counts that are combined before the shuffle. Term tables grow with the
vocabulary; they are joined, never collected.

Defined results: null, empty and blank texts hold nothing. Deliveries of one message are read each; an
occurrence at the same place counts once. Rows with a null id are replaced like others but not listed. Texts of any
length are read whole. Empty tables give empty results. ``sanitise`` keeps all other columns; ``sanitised``
has a row for each delivery.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.llm.pii_forms import ADDRESS, EMAIL, ID, JVM_FILTER, PERSON, PHONE, candidates
from driftlens.storage import cut

#: Bits that a term must give: a sixteenth of the information rate of a self-telling form's own company.
MIN_BITS = -4.0
#: A term seen less often than this decides nothing by itself.
MIN_SEEN = 5
#: Share of a word's occurrences that lie beside a known name, from which it is taken for one.
COMPANY = 0.6
#: Share of self-telling persons in a context from which the context alone suffices.
TELLING_CONTEXT = 0.12
#: Open forms so unusual that they are taken for an identity number where the corpus knows no term around.
RARE_FORMS = ("3 2 4", "2.3.3")
PLACEHOLDERS = {EMAIL: "[EMAIL]", PHONE: "[PHONE]", ID: "[ID_NUMBER]", ADDRESS: "[ADDRESS]", PERSON: "[PERSON]"}
_FOUND = "kind string, form string, start int, end int, seed boolean, context array<string>, terms array<struct<t:string,p:int>>"


def extract(df: DataFrame, record_set: str, row_id: str, text: str) -> DataFrame:
    """Candidates of each text: ``(record_set, row_id, text_key, kind, form, start, end, seed, context, terms)``.

    ``text_key`` is a hash of the text that they were found in.
    """

    @F.pandas_udf(f"array<struct<{_FOUND.replace(' string', ':string').replace(' int,', ':int,').replace(' boolean', ':boolean').replace(' array', ':array')}>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts.tolist():
                rows = []
                for c in candidates(t) if t else ():
                    left = c.left
                    if c.kind == PERSON:
                        ctx = [f"L:{' '.join(left[-2:])}", f"R:{c.right}"]
                    else:
                        ctx = [f"L{k}:{' '.join(left[-k:])}" for k in (3, 2, 1) if len(left) >= k]
                        ctx += [f"A{k}:{' '.join(c.above[-k:])}" for k in (2, 1) if len(c.above) >= k] + ([f"R:{c.right}"] if c.right else [])
                    rows.append(
                        {"kind": c.kind, "form": c.form, "start": c.start, "end": c.end, "seed": c.seed, "context": ctx, "terms": [{"t": t, "p": p} for t, p in zip(c.terms, c.places)]}
                    )
                out.append(rows)
            yield pd.Series(out)

    able = df.where(F.col(text).rlike(JVM_FILTER)).select(F.lit(record_set).alias("record_set"), F.col(row_id).cast("long").alias("row_id"), F.col(text).alias("_t"))
    return able.select("record_set", "row_id", F.xxhash64("_t").alias("text_key"), F.explode(found("_t")).alias("c")).select("record_set", "row_id", "text_key", "c.*")


AT = ["record_set", "row_id", "text_key", "start"]


def bits(hits: Column, seen: Column, base: Column) -> Column:
    """The disclosure of a term: log2 of the share of entities among its candidates over the overall share.

    Null, so nothing, for a term that never stood by an entity.
    """
    return F.when(hits > 0, F.log2(hits / seen / base))


def _numbers(found: DataFrame) -> DataFrame:
    """Open numbers whose context discloses a phone or an identity number, with the kind it discloses more."""
    family = found.where(F.col("kind").isin(PHONE, ID, "number"))
    told = F.col("seed")
    stats = (
        family.select(F.explode("context").alias("term"), (told & (F.col("kind") == PHONE)).cast("int").alias("a"), (told & (F.col("kind") == ID)).cast("int").alias("b"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("n_phone"), F.sum("b").alias("n_id"))
        .where(F.col("n") >= MIN_SEEN)
    )
    base = family.agg(F.coalesce(F.avg((told & (F.col("kind") == PHONE)).cast("double")), F.lit(0.0)).alias("base_phone"), F.coalesce(F.avg((told & (F.col("kind") == ID)).cast("double")), F.lit(0.0)).alias("base_id"))
    open_ = family.where(~told)
    # The longest context that the corpus knows speaks for the number; the line before and the word after only where none stands before it.
    first = ~F.exists("context", lambda t: t.startswith("L"))
    spoken = (
        open_.select(*AT, first.alias("first"), F.posexplode("context").alias("rank", "term"))
        .where(F.col("term").startswith("L") | F.col("first"))
        .join(stats, "term")
        .groupBy(*AT)
        .agg(F.min(F.struct("rank", "n", "n_phone", "n_id")).alias("s"))
    )
    one = F.greatest(F.lit(1e-6), F.col("base_phone")), F.greatest(F.lit(1e-6), F.col("base_id"))
    phone = F.coalesce(bits(F.col("s.n_phone"), F.col("s.n"), one[0]), F.lit(-99.0))
    ident = F.coalesce(bits(F.col("s.n_id"), F.col("s.n"), one[1]), F.lit(-99.0))
    judged = open_.join(spoken, AT, "left").crossJoin(F.broadcast(base)).withColumn("phone_bits", phone).withColumn("id_bits", ident)  # base is one row
    own = F.when(F.col("kind") == PHONE, F.col("phone_bits")).when(F.col("kind") == ID, F.col("id_bits")).otherwise(F.greatest("phone_bits", "id_bits"))
    kind = F.when(F.col("kind") != "number", F.col("kind")).when(F.col("phone_bits") > F.col("id_bits"), PHONE).otherwise(ID)
    unknown = (F.col("s").isNull() | first) & F.col("form").isin(*RARE_FORMS)
    return judged.where((own > MIN_BITS) | unknown).select(*AT[:3], "start", "end", kind.alias("kind"))


def _persons(found: DataFrame) -> DataFrame:
    """Open runs of capitalised words that hold disclosed names, from the first to the last of these."""
    people = found.where(F.col("kind") == PERSON)
    terms = people.select(F.explode(F.transform("terms", lambda x: F.concat(F.lit("T:"), x["t"]))).alias("term"), F.col("seed").cast("int").alias("hit"))
    around = people.select(F.explode("context").alias("term"), F.col("seed").cast("int").alias("hit"))
    stats = terms.unionAll(around).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"))
    base = F.greatest(F.lit(1e-6), F.col("base"))
    known = (
        stats.where(F.col("term").startswith("T:") & (F.col("hits") > 0))
        .crossJoin(F.broadcast(people.agg(F.coalesce(F.avg(F.col("seed").cast("double")), F.lit(0.0)).alias("base"))))  # base is one row
        .where(bits(F.col("hits"), F.col("n"), base) > MIN_BITS + 4)
        .select(F.expr("substring(term, 3)").alias("t"), F.lit(True).alias("known"))
    )
    telling = stats.where(~F.col("term").startswith("T:") & (F.col("n") >= 2 * MIN_SEEN) & (F.col("hits") / F.col("n") >= TELLING_CONTEXT)).select("term", F.lit(1).alias("tells"))
    open_ = people.where(~F.col("seed"))
    words = open_.select(*AT, F.posexplode("terms").alias("i", "w")).select(*AT, "i", F.col("w.t").alias("t"), F.col("w.p").alias("p"))
    row = F.array_sort(F.collect_list(F.struct("i", "t", "p", F.coalesce("known", F.lit(False)).alias("known"))))
    runs = words.join(known, "t", "left").groupBy(*AT).agg(row.alias("row"))
    beside = F.transform("row", lambda x: F.struct(x["t"].alias("t"), x["known"].alias("known"), F.exists("row", lambda y: y["known"] & (F.abs(y["i"] - x["i"]) == 1)).alias("beside")))
    company = (
        runs.select(F.explode(beside).alias("b"))
        .where(~F.col("b.known"))
        .groupBy(F.col("b.t").alias("t"))
        .agg(F.avg(F.col("b.beside").cast("double")).alias("share"))
        .where(F.col("share") >= COMPANY)
        .select("t", F.lit(True).alias("near"))
    )
    again = F.array_sort(F.collect_list(F.struct("i", "p", (F.coalesce("known", F.lit(False)) | F.coalesce("near", F.lit(False))).alias("name"))))
    named = words.join(known, "t", "left").join(company, "t", "left").groupBy(*AT).agg(again.alias("row"))
    spoken = open_.select(*AT, F.explode("context").alias("term")).join(telling, "term").groupBy(*AT).agg(F.max("tells").alias("tells"))
    names = F.filter("row", lambda x: x["name"])
    judged = open_.join(named, AT).join(spoken, AT, "left").withColumn("names", names)
    least = F.when(F.col("form") == "initial", 1).otherwise(2)
    inside = F.size("names") >= least
    outside = F.col("tells").isNotNull() & (F.size("terms") <= 3) & (F.size("names") > 0)
    first = F.when(F.col("names")[0]["i"] == 0, F.col("start")).otherwise(F.col("names")[0]["p"])
    begins = F.when(inside & (F.col("form") == "run"), first).otherwise(F.col("start"))
    last = F.element_at("names", -1)
    to = F.when(inside & (F.col("form") == "run"), F.least(F.col("end"), last["p"] + F.length(F.element_at("terms", last["i"] + 1)["t"]))).otherwise(F.col("end"))
    return judged.where(inside | outside).select(*AT[:3], begins.cast("int").alias("start"), to.cast("int").alias("end"), F.lit(PERSON).alias("kind"))


def find(found: DataFrame) -> DataFrame:
    """``(record_set, row_id, text_key, start, end, kind)`` of the entities among the candidates of a corpus."""
    found = cut(found.dropDuplicates(AT), "pii-candidates")
    told = found.where(F.col("seed")).select(*AT[:3], "start", "end", "kind")
    return told.unionByName(_numbers(found)).unionByName(_persons(found))


def replaced(df: DataFrame, spans: DataFrame, row_id: str, text: str, also: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the entities of ``spans`` (as ``find`` gives them) in ``text`` replaced by placeholders of their type.

    Rows meet their spans by id and text (and the columns ``also``), so that neither null texts nor a text that many rows have
    come together in one task; where the spans are few they are sent to the rows.
    """
    keys = [*also, "row_id", "text_key"]
    marked = cut(spans.groupBy(*keys).agg(F.collect_set(F.struct("start", "end", "kind")).alias("_spans")), "pii-spans").select(*[F.col(k).alias(f"_{k}") for k in keys], "_spans")

    @F.pandas_udf("string")
    def filled(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, marks in zip(texts.tolist(), spans.tolist(), strict=True):
            if t is not None and marks is not None:
                last = len(t) + 1
                for m in sorted(marks, key=lambda m: -m["start"]):
                    if m["end"] <= last:
                        t = t[: m["start"]] + PLACEHOLDERS[m["kind"]] + t[m["end"] :]
                        last = m["start"]
            out.append(t)
        return pd.Series(out, dtype=object)

    same = F.col(row_id).cast("long").eqNullSafe(F.col("_row_id")) & (F.xxhash64(F.col(text)) == F.col("_text_key"))
    for c in also:
        same = same & (F.col(c) == F.col(f"_{c}"))
    joined = df.join(marked, same, "left")
    held = F.when(F.col("_spans").isNotNull(), filled(F.col(text), F.col("_spans"))).otherwise(F.col(text))
    return joined.withColumn(text, held).select(*df.columns)


def sanitise(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """``df`` with the entities in ``text`` replaced by placeholders of their type; all else stays as it is."""
    return replaced(df, find(extract(df, "", row_id, text)), row_id, text)


def extract_both(messages: DataFrame, message_records: DataFrame) -> DataFrame:
    """The candidates of both tables, which are one corpus."""
    return extract(messages, "messages", "message_id", "message_text").unionByName(extract(message_records, "message_records", "record_id", "text"))


def sanitised(messages: DataFrame, message_records: DataFrame) -> DataFrame:
    """``(record_set, row_id, text)``: a row for each of both tables, decided by what the two hold together."""
    rows = messages.select(F.lit("messages").alias("record_set"), F.col("message_id").cast("long").alias("row_id"), F.col("message_text").alias("text")).unionByName(
        message_records.select(F.lit("message_records").alias("record_set"), F.col("record_id").cast("long").alias("row_id"), "text")
    )
    return replaced(rows, find(extract_both(messages, message_records)), "row_id", "text", ("record_set",))


def p5_found(messages: DataFrame, message_records: DataFrame) -> DataFrame:
    return find(extract_both(messages, message_records)).where(F.col("row_id").isNotNull()).select("record_set", "row_id", "kind", F.col("start").alias("start_pos")).distinct()
