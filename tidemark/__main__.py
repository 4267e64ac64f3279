"""Commands: list, sql NAME, run NAME FOLDER OUT, report NAME FOLDER [OUT], plan PRODUCT FIRST LAST [OUT]."""

from __future__ import annotations

import argparse
import json
from datetime import date

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries")
    commands.add_parser("sql", help="the SQL that gives a query's rows").add_argument("name")
    run = commands.add_parser("run", help="write a query's rows as Parquet")
    for x in ("name", "folder", "out"):
        run.add_argument(x)
    rep = commands.add_parser("report", help="write a report as JSON, or print it as text")
    rep.add_argument("name")
    rep.add_argument("folder")
    rep.add_argument("out", nargs="?")
    plan = commands.add_parser("plan", help="requests for a product's contracts between two days, in stretches of a week at most")
    plan.add_argument("product")
    plan.add_argument("first", type=date.fromisoformat)
    plan.add_argument("last", type=date.fromisoformat)
    plan.add_argument("out", nargs="?")
    own = parser.parse_args(args)

    from tidemark.plans import catalogue, reports

    if own.command == "list":
        print("\n".join(sorted(catalogue.QUERIES)))
        return 0
    if own.command == "sql":
        print(catalogue.ORACLE_SQL[own.name].strip())
        return 0
    spark = SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if own.command == "run":
        catalogue.QUERIES[own.name](spark, own.folder).write.mode("overwrite").parquet(own.out)
    elif own.command == "report":
        from tidemark.sources.sinks import replace_file

        if own.out:
            replace_file(own.out, json.dumps(reports.report(spark, own.folder, own.name), indent=1).encode())
        else:
            print(reports.text(spark, own.folder, own.name))
    else:
        from tidemark.operators import rolls

        contracts = rolls.inventory(spark, own.product, own.first, own.last).withColumn("first_day", F.lag("planned_roll", 1, own.first).over(rolls.W.orderBy("expiry")))
        wanted = contracts.select("symbol", F.greatest("first_day", F.lit(own.first)).alias("first_day"), F.least("planned_roll", F.lit(own.last)).alias("last_day")).where("first_day <= last_day")
        requests = rolls.chunks(wanted)
        if own.out:
            requests.write.mode("overwrite").json(own.out)
        else:
            requests.orderBy("chunk_start").show(1000, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
