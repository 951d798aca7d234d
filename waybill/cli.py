"""Command line: check documents, route a batch, score submissions, on one Spark session."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from waybill.functions.text import episode_text
from waybill.operators import records, report, routing, scoring
from waybill.sources import documents

ROUTERS = {"light": lambda e, p: routing.constant_route(e, list(p.tiers), p.light), "rules": lambda e, p: routing.rule_route(e), "budget": lambda e, p: routing.budget_route(e, policy=p)}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="waybill")
    commands = out.add_subparsers(dest="command", required=True)
    check = commands.add_parser("check", help="list the broken rules of documents")
    check.add_argument("kind", choices=["input", "outcomes", "submission"])
    check.add_argument("path")
    route = commands.add_parser("route", help="write a submission for one tier")
    route.add_argument("router", choices=sorted(ROUTERS))
    route.add_argument("--input", required=True)
    route.add_argument("--tier", required=True, choices=list(scoring.PUBLIC.tiers))
    route.add_argument("--output", required=True)
    score = commands.add_parser("score", help="print the report of a submission for each tier")
    for name in ("--input", "--outcomes"):
        score.add_argument(name, required=True)
    score.add_argument("--submissions", nargs="+", required=True)
    return out


def header_of(spark: SparkSession, path: str) -> dict:
    return spark.read.text(path, wholetext=True).select(F.from_json("value", f"struct<{documents.HEADER}, policy_id: string, tier: string>").alias("h")).select("h.*").first().asDict()


def read(spark: SparkSession, path: str | list[str], kind: str) -> object:
    docs = documents.documents(spark, path)
    found = [r.asDict() for r in documents.problems(docs, kind).limit(5).collect()]
    if found:
        raise ValueError(f"{kind} document: {found}")
    return {"input": documents.episodes, "outcomes": documents.outcomes, "submission": documents.decisions}[kind](docs)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """The exit code: 0 if all went well, 2 if a document breaks a rule."""
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("waybill").getOrCreate()
    try:
        if a.command == "check":
            found = [r.asDict() for r in documents.problems(documents.documents(spark, a.path), a.kind).orderBy("path", "rule").collect()]
            print(documents.report(found), end="")
            return 2 if found else 0
        episodes = read(spark, a.input, "input").withColumn("text", episode_text(F.col("prompt"), F.col("messages"))).withColumn("n_messages", F.coalesce(F.size("messages"), F.lit(1)))
        episodes = episodes.withColumn("n_messages", F.when(F.col("n_messages") > 0, F.col("n_messages")).otherwise(1))
        header = header_of(spark, a.input)
        if a.command == "route":
            chosen = ROUTERS[a.router](episodes, scoring.PUBLIC).filter(F.col("tier") == a.tier).join(episodes.select("episode_id", "pos"), "episode_id")
            head = {k: header[k] for k in ("schema_version", "challenge_id", "split")} | {"policy_id": scoring.PUBLIC.policy_id}
            records.published(a.output, documents.report(json.loads(documents.submission_rows(chosen, ["tier"], head).first()["json"])))
            return 0
        outcomes, decisions = read(spark, a.outcomes, "outcomes"), read(spark, a.submissions, "submission")
        wrong = report.header_problems(header, header_of(spark, a.outcomes), [header_of(spark, s) for s in a.submissions])
        if wrong or len(a.submissions) != len(scoring.PUBLIC.tiers):
            raise ValueError(f"headers differ or a tier is missing: {wrong}")
        outcomes = outcomes.withColumn("score", F.col("score").cast("decimal(20,10)"))
        report.guarded(episodes, outcomes, decisions)
        print(documents.report(json.loads(report.final_report(decisions, outcomes, header).select(F.to_json(F.struct("*"))).first()[0])), end="")
        return 0
    except ValueError as problem:
        print(problem, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
