"""Command line: build, apply and update profiles, evaluate messages and detectors, check texts, run queries.

    python -m driftlens.cli evaluate INPUTS.jsonl OUT [--learned]
    python -m driftlens.cli build-profile HISTORY.jsonl STORE
    python -m driftlens.cli update-profile HISTORY.jsonl STORE
    python -m driftlens.cli run-evaluation FOLDER OUT [--datasets A,B] [--methods M,N] [--users 20] [--bootstrap 1000]
    python -m driftlens.cli reproduce FOLDER OUT
    python -m driftlens.cli content-check TEXT
    python -m driftlens.cli query NAME FOLDER OUT
    python -m driftlens.cli version
"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

import driftlens
from driftlens.operators import detectors, evaluation, explain, metrics, profiles, scoring
from driftlens.plans import catalog
from driftlens.session import get_session
from driftlens.sources import history, inputs
from driftlens.sources.tables import tables
from driftlens.storage import cut


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="driftlens", description="Behavioural anomaly scoring on Spark")
    top.add_argument("--master", default="local[*]")
    sub = top.add_subparsers(dest="command", required=True)
    arguments = {
        "evaluate": ("inputs", "out"), "build-profile": ("history", "store"), "update-profile": ("history", "store"), "run-evaluation": ("folder", "out"), "reproduce": ("folder", "out"),
        "content-check": ("text",), "query": ("name", "folder", "out"), "version": (),
    }
    made = {name: sub.add_parser(name) for name in arguments}
    for name, args in arguments.items():
        for a in args:
            made[name].add_argument(a)
    made["evaluate"].add_argument("--learned", action="store_true")
    made["run-evaluation"].add_argument("--datasets")
    made["run-evaluation"].add_argument("--methods", default=",".join((evaluation.FULL, "rule_based", "content_safety")))
    made["run-evaluation"].add_argument("--users", type=int, default=20)
    made["run-evaluation"].add_argument("--bootstrap", type=int, default=0)
    return top


def evaluate_inputs(spark: SparkSession, path: str, learned: bool = False) -> tuple:
    """(results, bad inputs) of a file of inputs; each is scored against its own profile, under its own settings."""
    good, bad = inputs.read_inputs(spark, path)
    messages, held, settings = inputs.as_rows(cut(good, "inputs"))
    run = scoring.evaluate_learned if learned else scoring.evaluate
    own = settings.withColumnRenamed("message_id", "id").withColumn("overrides", F.lit(True))
    return explain.as_json(explain.result(run(messages, held, own), stamped=True, model="hashed_bag" if learned else None)), bad


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.command == "version":
        print(driftlens.__version__)
        return 0
    spark = get_session(args.master)
    if args.command == "content-check":
        found = detectors.content_safety(F.lit(args.text))
        row = spark.range(1).select(F.round(found["score"], 3).alias("anomaly_score"), found["is_anomaly"].alias("is_anomaly"), found["categories"].alias("triggered_categories"), found["category_scores"].alias("category_scores")).first()
        print(json.dumps(row.asDict()))
        return int(row["is_anomaly"])
    if args.command == "query":
        history.write_json(catalog.QUERIES[args.name](spark, args.folder), args.out)
        return 0
    if args.command == "evaluate":
        made, bad = evaluate_inputs(spark, args.inputs, args.learned)
        made.select(F.col("json").alias("value")).write.mode("overwrite").text(args.out)
        wrong = bad.count()
        print(json.dumps({"results": spark.read.text(args.out).count(), "bad_inputs": wrong}))
        return int(wrong > 0)
    if args.command in ("run-evaluation", "reproduce"):
        messages, users = tables(spark, args.folder, "messages", "users")
        given = vars(args)
        out = evaluation.run(
            messages, users, tuple(given["methods"].split(",")) if "methods" in given else (evaluation.FULL, *evaluation.BASELINES), given["datasets"].split(",") if given.get("datasets") else None, given.get("users", 20)
        )
        for name, rows in out.items():
            if name != "predictions":
                history.write_metrics(rows, f"{args.out}/{name}")
        if given.get("bootstrap"):
            history.write_metrics(metrics.bootstrap(out["predictions"].where(F.col("method") == evaluation.FULL), given["bootstrap"]), f"{args.out}/bootstrap")
        if args.command == "reproduce":
            marks = history.checksums(spark, f"{args.folder}/*.parquet").select(F.element_at(F.split("path", "/"), -1).alias("file"), "checksum").collect()
            print(json.dumps({"code": history.code_hash(spark, str(Path(__file__).parent)), "tables": {r["file"]: r["checksum"] for r in marks}}))
        return 0
    records, bad = history.read_history(spark, args.history)
    records = cut(records.withColumn("record_id", F.monotonically_increasing_id()), "records")
    store = history.ProfileStore(spark, args.store)
    if args.command == "build-profile":
        users = records.select("user_id").distinct().select("user_id", F.lit(0).alias("account_age_days"), F.current_timestamp().alias("updated_at"))
        store.save(profiles.build(records, users))
    else:
        store.update(records)
    print(json.dumps({"profiles": store.table().count(), "bad_lines": bad.count()}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
