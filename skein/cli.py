"""python -m skein.cli build|cluster|query|status|init-config"""

from __future__ import annotations

import argparse
import json
import sys

from skein.sources import settings


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="skein")
    parser.add_argument("-v", "--verbose", action="store_true")
    parser.add_argument("-q", "--quiet", action="store_true")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, more in (("build", ("root",)), ("cluster", ()), ("query", ("question",)), ("status", ("root",)), ("init-config", ("root",))):
        one = commands.add_parser(name)
        for positional in more:
            one.add_argument(positional)
        if name != "init-config":
            one.add_argument("--out", default="graph-out")
        if name == "build":
            one.add_argument("--no-cluster", action="store_true")
        if name == "cluster":
            one.add_argument("--root")
    own = parser.parse_args(args)
    settings.set_up_logging(own.verbose, own.quiet)
    if own.command == "init-config":
        settings.write_example(own.root)
        return 0
    from pyspark.sql import SparkSession

    from skein.plans import project

    spark = SparkSession.builder.appName("skein").getOrCreate()
    if own.command == "build":
        nodes, edges = project.build(spark, own.root, own.out, not own.no_cluster)
        settings.log.info("%d nodes, %d edges", nodes.count(), edges.count())
    elif own.command == "cluster":
        project.cluster(spark, own.out, own.root)
    elif own.command == "query":
        print(project.query(spark, own.out, own.question))
    else:
        print(json.dumps(project.status(spark, own.root, own.out), indent=2, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
