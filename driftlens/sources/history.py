"""Reading and writing of histories, inputs and profiles.

Histories and inputs come as JSON lines or documents with a declared schema; nothing is inferred. Lines that are no
JSON are kept apart, not lost. Profiles are a Parquet table, in buckets by a hash of the user's id: a lookup reads one
bucket, an update rewrites the buckets it touches.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftlens.functions import lexicons as X
from driftlens.functions.timestamps import iso_instant
from driftlens.operators.profiles import COLD_HOURS, COLD_START, COLD_TOPICS
from driftlens.storage import cut
from driftlens.streaming import online

HISTORY = "user_id string, text string, message string, timestamp string, session_id string, is_anomaly boolean, operation_risk string, _corrupt_record string"
BUCKETS = 64
DATASET = {
    "users": "array<struct<user_id:string,account_age_days:int,typical_topics:array<string>>>",
    "messages": "array<struct<user_id:string,message_text:string,timestamp:string,session_id:string,is_anomaly:boolean,should_flag:boolean,anomaly_type:string,attack_phase:string,operation_type:string,operation_risk:string>>",
    "splits": "struct<train:struct<user_ids:array<string>>,test:struct<user_ids:array<string>>>",
}


def read_history(spark: SparkSession, path: str, now: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, bad lines) of a JSON-lines history. Blank lines are skipped; ``text`` falls back on ``message``.

    A missing timestamp becomes ``now`` (the current time, if not given), a missing session 'default'.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", HISTORY, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    good = parsed.where(F.col("r").isNotNull() & F.col("r._corrupt_record").isNull()).select("r.*")
    at = F.lit(now) if now else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    risk = F.lower(F.trim("operation_risk"))
    records = good.select(
        "user_id", F.coalesce("text", "message", F.lit("")).alias("text"), F.coalesce("timestamp", at).alias("timestamp"), F.coalesce("session_id", F.lit("default")).alias("session_id"),
        F.coalesce("is_anomaly", F.lit(False)).alias("is_anomaly"), F.when(risk.isin("low", "medium", "high", "critical"), risk).alias("operation_risk"),
    )
    return records, parsed.where(F.col("r").isNull() | F.col("r._corrupt_record").isNotNull()).select("value")


def read_dataset(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """An evaluation dataset, one JSON document: ``users``, ``messages`` (with ``seq``, its place) and ``splits``."""
    schema = ", ".join(f"{k} {v}" for k, v in DATASET.items())
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    return {
        "users": doc.select(F.explode("users").alias("u")).select("u.*"),
        "messages": doc.select(F.posexplode("messages").alias("seq", "m")).select("seq", "m.*"),
        "splits": doc.select(F.explode(F.array(*[F.struct(F.lit(n).alias("split"), F.col(f"splits.{n}.user_ids").alias("ids")) for n in ("train", "test")])).alias("s")).select("s.split", F.explode("s.ids").alias("user_id")),
    }


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """Measures at four places, as CSV with a header."""
    rounded = [F.round(c, 4).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*rounded).coalesce(1).write.mode("overwrite").option("header", True).csv(path)  # a row per method


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """``(path, checksum)``: the first twelve hex digits of each file's SHA-256."""
    return spark.read.format("binaryFile").load(path).select("path", F.substring(F.sha2("content", 256), 1, 12).alias("checksum"))


def code_hash(spark: SparkSession, folder: str) -> str:
    """The first twelve hex digits of the SHA-256 of the files' own digests, in order of their paths: the version of a code base."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.py").option("recursiveFileLookup", "true").load(folder)
    digests = [r[0] for r in files.select("path", F.sha2("content", 256).alias("d")).orderBy("path").select("d").toLocalIterator()]
    return hashlib.sha256("".join(digests).encode()).hexdigest()[:12]


def safe_name(user_id: Column) -> Column:
    """The id with everything but letters, digits, underscore, hyphen and full stop replaced."""
    return F.regexp_replace(user_id, r"[^\p{L}\p{N}_\-.]", "_")


class ProfileStore:
    """A table of profiles by user at a path."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _read(self) -> DataFrame | None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return None
        try:
            return self.spark.read.parquet(self.path)
        except AnalysisException:  # a store whose last user was deleted has no file to take columns from
            return None

    def table(self) -> DataFrame | None:
        held = self._read()
        return None if held is None else held.drop("_bucket", "_saved_at")

    def save(self, profiles: DataFrame) -> None:
        """Inserts and replaces by user: the newest row of each wins. Only the touched buckets are rewritten."""
        new = profiles.withColumn("_saved_at", F.current_timestamp()).withColumn("_bucket", F.pmod(F.xxhash64("user_id"), F.lit(BUCKETS)).cast("int"))
        held = self._read()
        if held is not None:
            touched = new.select("_bucket").distinct()
            old = held.join(F.broadcast(touched), "_bucket", "left_semi")  # at most BUCKETS rows
            new = old.unionByName(new, allowMissingColumns=True)
        newest = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("_saved_at")))
        kept = cut(new.withColumn("_r", newest).where("_r = 1").drop("_r"), "profiles")
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(self.path)

    def update(self, records: DataFrame) -> None:
        """Folds new records into the stored profiles of their users, or into cold ones, and stores the outcome. Columns that the fold doesn't keep stay as stored."""
        held = self.table()
        folded = cut(online.replay(records, held), "updated")
        if held is not None:
            rest = [c for c in held.columns if c not in folded.columns]
            folded = folded.join(held.select("user_id", *rest), "user_id", "left")
        self.save(folded)

    def load(self, user_id: str) -> DataFrame | None:
        held = self._read()
        if held is None:
            return None
        return held.where((F.col("_bucket") == F.pmod(F.xxhash64(F.lit(user_id)), F.lit(BUCKETS))) & (F.col("user_id") == user_id)).drop("_bucket", "_saved_at")

    def exists(self, user_id: str) -> bool:
        row = self.load(user_id)
        return row is not None and not row.isEmpty()

    def delete(self, user_ids: DataFrame) -> None:
        """Rewrites the table without the users."""
        held = self._read()
        if held is not None:
            kept = cut(held.join(user_ids.select("user_id"), "user_id", "left_anti"), "profiles")
            kept.write.mode("overwrite").partitionBy("_bucket").parquet(self.path)

    def user_ids(self) -> DataFrame | None:
        held = self.table()
        return None if held is None else held.select("user_id").orderBy("user_id")

    def with_cold_start(self, users: DataFrame) -> DataFrame:
        """``users`` joined to their profiles; the cold-start profile where there is none."""
        held = self.table()
        rows = users if held is None else users.join(held, "user_id", "left")
        for c, v in (COLD_START | {"hours": COLD_HOURS, "topics": COLD_TOPICS}).items():
            cold = F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)
            rows = rows.withColumn(c, F.coalesce(F.col(c), cold) if c in rows.columns else cold)
        return rows


def validate(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_errors``: what is wrong with each input; empty for a valid one.

    Needed: user_id, text, a readable timestamp; operation type and risk within their sets, where given.
    """

    def missing(c: str) -> Column:
        return F.when(F.col(c).isNull(), F.lit(f"{c}: Field required"))

    checks = [missing("user_id"), missing("text"), missing("timestamp")]
    checks.append(F.when(F.col("timestamp").isNotNull() & iso_instant(F.col("timestamp")).isNull(), F.lit("timestamp: not a date-time")))
    for c, allowed in (("operation_type", X.OPERATION_TYPES), ("operation_risk", ["low", "medium", "high", "critical"])):
        if c in rows.columns:
            checks.append(F.when(F.col(c).isNotNull() & ~F.col(c).isin(*allowed), F.lit(f"requested_operation -> {c}: Input should be one of {', '.join(allowed)}")))
    return rows.withColumn("_errors", F.array_compact(F.array(*checks)))


def split_valid(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rows kept apart with their errors)."""
    checked = validate(rows)
    return checked.where(F.size("_errors") == 0).drop("_errors"), checked.where(F.size("_errors") > 0)
