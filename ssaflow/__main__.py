"""python -m ssaflow: export, build, explain, run, version."""

from __future__ import annotations

import argparse
import importlib
import json
from pathlib import Path

from ssaflow import __version__


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="ssaflow")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, what in (("export", "write the portable form of every workflow of a module"), ("explain", "print a workflow's graph"), ("run", "run a workflow and print its results as JSON lines"), ("build", "write a project's manifests and bundles")):
        sub = commands.add_parser(name, help=what)
        sub.add_argument("--module", default="ssaflow.workflows", help="where the workflows are declared")
        if name == "export":
            sub.add_argument("folder")
        elif name == "build":
            sub.add_argument("project")
        else:
            sub.add_argument("workflow", help="a workflow's id; for run also the path of a bundle or portable form")
        if name == "run":
            sub.add_argument("--input", help="Parquet files whose rows are the contexts")
            sub.add_argument("--keep", default="", help="columns that results carry, by commas")
            sub.add_argument("--errors", action="store_true", help="print what failed as well")
    commands.add_parser("version", help="print the version")
    args = parser.parse_args(argv)
    if args.command == "version":
        print(__version__)
        return 0
    importlib.import_module(args.module)
    from ssaflow.plans import ir
    from ssaflow.plans.trace import workflows

    if args.command == "export":
        for path in ir.export_all({n: w.ir for n, w in workflows.items()}, args.folder):
            print(path)
    elif args.command == "build":
        from ssaflow.sources.bundles import build, load_project

        for path in build(load_project(args.project), {n: w.ir for n, w in workflows.items()}):
            print(path)
    elif args.command == "explain":
        print(workflows[args.workflow].explain())
    else:
        from pyspark.sql import SparkSession

        from ssaflow.engine import Engine

        wf = workflows[args.workflow].ir if args.workflow in workflows else _from_file(args.workflow)
        spark = SparkSession.builder.getOrCreate()
        root = spark.read.parquet(args.input) if args.input else None
        done = Engine(spark).run(wf, root, [c for c in args.keep.split(",") if c])
        for frame in [done.results, *([done.errors] if args.errors else [])]:
            for line in frame.toJSON().toLocalIterator():
                print(line)
    return 0


def _from_file(path: str):
    from ssaflow.plans import ir

    d = json.loads(Path(path).read_text(encoding="utf-8"))
    return ir.from_dict(d.get("ir", d))


if __name__ == "__main__":
    raise SystemExit(main())
