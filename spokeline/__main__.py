"""python -m spokeline score|export|validate|targets|config: exit codes 0, 1 (differences found), 2 (usage or settings)."""

from __future__ import annotations

import argparse
import json
import sys

from spokeline.config import Config


def _pairs(items: list[str]) -> dict[str, str]:
    return dict(i.split("=", 1) for i in items)


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="spokeline")
    commands = parser.add_subparsers(dest="command", required=True)
    score = commands.add_parser("score", help="score the city of a folder of tables")
    score.add_argument("folder")
    score.add_argument("out")
    score.add_argument("--to-stage")
    score.add_argument("--set", action="append", default=[], metavar="PATH=VALUE")
    out = commands.add_parser("export", help="export a bundle or a target from scored tables")
    out.add_argument("folder")
    out.add_argument("out")
    out.add_argument("name")
    out.add_argument("--format", default="csv")
    validate = commands.add_parser("validate", help="compare two copies of a table")
    validate.add_argument("reference")
    validate.add_argument("computed")
    validate.add_argument("--key", action="append", required=True)
    validate.add_argument("--tolerance", type=float, default=1e-6)
    commands.add_parser("targets", help="list export targets")
    show = commands.add_parser("config", help="show the settings")
    show.add_argument("--set", action="append", default=[], metavar="PATH=VALUE")
    options = parser.parse_args(arguments)
    if options.command == "targets":
        from spokeline.sinks.export import BUNDLES, list_targets

        print("\n".join([*list_targets(), *(f"bundle {b}" for b in BUNDLES)]))
        return 0
    try:
        config = Config.build(overrides=_pairs(getattr(options, "set", [])))
    except (ValueError, KeyError) as e:
        print(e, file=sys.stderr)
        return 2
    if options.command == "config":
        print(json.dumps(config.values, indent=2))
        return 0
    from spokeline.session import build_session

    spark = build_session()
    if options.command == "score":
        from spokeline.pipeline import read_inputs, score_city

        result = score_city(read_inputs(spark, options.folder), config, to_stage=options.to_stage)
        result.write(options.out)
        print("\n".join(result.ran))
        return 0
    if options.command == "export":
        from spokeline.sinks import export

        import os

        tables = {n: spark.read.parquet(f"{options.folder}/{n}") for n in os.listdir(options.folder)}
        export.export_bundle(options.name, tables, options.out, options.format) if options.name in export.BUNDLES else export.export_target(options.name, tables, options.out, options.format)
        return 0
    from spokeline.operators.table_diff import diff_report, diff_tables

    report = diff_report(diff_tables(spark.read.parquet(options.reference), spark.read.parquet(options.computed), options.key, tolerance=options.tolerance)).collect()
    for r in sorted(report, key=lambda r: r["diff"]):
        print(f"{r['diff']}\t{r['n_differ']}")
    return 1 if report else 0


if __name__ == "__main__":
    sys.exit(main())
