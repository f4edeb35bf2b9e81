"""``python -m causeway COMMAND``: experiments, the register, a road file's QA, a district, the service."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from causeway import api
from causeway.operators import network
from causeway.plans import experiments
from causeway.plans.district import build_district
from causeway.register import Register
from causeway.session import ship
from causeway.sources import files


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="causeway")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("allocation", "network_effects", "robustness"):
        p = sub.add_parser(name)
        p.add_argument("--config")
        p.add_argument("--out")
    p = sub.add_parser("deterioration", help="over a folder of inspection sheets")
    p.add_argument("folder")
    p.add_argument("--config")
    p.add_argument("--out")
    sub.add_parser("register")
    p = sub.add_parser("qa", help="coverage and components of a GraphML road file")
    p.add_argument("graphml")
    p.add_argument("--structures", help="Parquet folder for tagged structures")
    p = sub.add_parser("district", help="structures and a report out of map layers")
    p.add_argument("graphml")
    p.add_argument("--layers", default=".", help="folder of water.parquet, places.parquet, facilities.parquet")
    p.add_argument("--out", required=True)
    p = sub.add_parser("serve")
    p.add_argument("--port", type=int, default=8000)
    p.add_argument("--folder", default=".")
    given = parser.parse_args(args)
    if given.command == "register":
        print(Register.default().to_markdown())
        return
    spark = SparkSession.builder.appName("causeway").getOrCreate()
    ship(spark)
    if given.command == "serve":
        api.serve(spark, given.port, given.folder).serve_forever()
    elif given.command == "district":
        print(json.dumps(build_district(spark, given.graphml, given.layers, given.out)))
    elif given.command == "qa":
        nodes, edges = files.load_graphml(spark, given.graphml)
        coverage = network.tag_coverage(edges).collect()[0].asDict()
        sizes = network.components(nodes, edges).groupBy("component").agg(F.count("*").alias("n")).agg(F.count("*").alias("components"), F.max("n").alias("largest")).collect()[0].asDict()
        print(json.dumps({"nodes": nodes.count(), **coverage, **sizes}))
        if given.structures:
            files.write_table(files.structures_table(edges), given.structures)
    else:
        cfg = experiments.load_config({}, given.config)
        if given.command == "deterioration":
            result = experiments.deterioration(files.load_sheets(spark, given.folder), cfg)
        else:
            result = getattr(experiments, given.command)(spark, cfg)
        print(text := experiments.report(result))
        if given.out:
            files.write_results(result, given.out, text)


if __name__ == "__main__":
    main()
