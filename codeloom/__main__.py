"""Analyzes source files: python -m codeloom analyze PATH [--out FOLDER] [--rules FILE] [-v], config-show, version."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys

VERSION = "0.2.0"
#: By how often -v is given
LEVELS = (logging.WARNING, logging.INFO, logging.DEBUG)


def log_level(verbose: int) -> int:
    return LEVELS[max(0, min(verbose, len(LEVELS) - 1))]


def analyze(spark, path: str, out: str | None = None, rules_file: str | None = None, kept: str | None = None) -> int:
    """Runs all detectors on the files, prints the text report, writes JSON and HTML to `out`; 1 if anything is critical. With a
    folder of kept facts, only files are parsed that no run before has seen. "default" as rules are those of the library."""
    from pyspark.sql import functions as F

    from .detect import engine, rules
    from .operators import findings, project, render, results, scoring
    from .sources.fact_store import FactStore
    from .sources.store import stored
    from .sources.trees import source

    extra = {"custom_rules": rules.detector(rules.default_rules() if rules_file == "default" else rules.load_rules(rules_file))} if rules_file else {}
    with source(spark, path) as reader:
        files = reader.files()
        if kept:
            found = FactStore(spark, kept, *engine.DETECTORS).facts(files)
            found = found.unionByName(engine.facts(files, extra=extra)) if extra else found
        else:
            found = engine.facts(files, *engine.DETECTORS, extra=extra)
        found = stored(found, "facts")
        names = [*engine.DETECTORS, *extra]
        issues = findings.with_snippets(engine.issues(found), files).select("analyzer", "severity", F.col("analyzer").alias("category"), "title", F.col("file_id").alias("file_path"), "line_number", "rule_id", "snippet", F.xxhash64("file_id", "seq").alias("emit_seq"))
        metrics, said = None, None
        for name in names:
            own = project.metrics(found, name).withColumnsRenamed({"value": "value_num"})
            text = project.insights(project.wide_metrics(found, name), name)
            metrics = own if metrics is None else metrics.unionByName(own)
            said = text if said is None else said.unionByName(text)
        scores = scoring.overall(scoring.analyzer_scores(issues, metrics))
        print(render.TextReporter("").text(*render.TextReporter("").collect(scores, issues, said)))
        for kind in (render.JsonReporter, render.HtmlReporter) if out else ():
            print(kind(out).generate(scores, issues, said))
        return results.exit_code(issues).first()["code"]


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="codeloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("analyze")
    run.add_argument("path")
    run.add_argument("--out")
    run.add_argument("--rules", help='a YAML file, or "default"')
    run.add_argument("--kept", help="a folder of facts kept between runs")
    run.add_argument("-v", "--verbose", action="count", default=0)
    show = commands.add_parser("config-show")
    show.add_argument("--config")
    commands.add_parser("version")
    args = parser.parse_args(arguments)
    if args.command == "version":
        print(VERSION)
        return 0
    if args.command == "config-show":
        from .operators.results import config_errors, load_config

        config = load_config(args.config, dict(os.environ))
        print(json.dumps(config, indent=2, default=str))
        errors = config_errors(config)
        print("\n".join(errors))
        return 2 if errors else 0
    logging.basicConfig(level=log_level(args.verbose))
    from pyspark.sql import SparkSession

    return analyze(SparkSession.builder.appName("codeloom").getOrCreate(), args.path, args.out, args.rules, args.kept)


if __name__ == "__main__":
    sys.exit(main())
