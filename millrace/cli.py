"""Command line: parse logs, build ground truth, score results, choose examples.

    python -m millrace.cli parse LOG FORMAT OUT [--url ENDPOINT] [--examples JSON]
    python -m millrace.cli groundtruth LOG FORMAT ANNOTATIONS OUT
    python -m millrace.cli evaluate TRUTH RESULT TRUTH_TEMPLATES RESULT_TEMPLATES
    python -m millrace.cli examples TRUTH OUT
"""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from millrace.operators.evaluate import evaluate
from millrace.operators.groundtruth import build_groundtruth
from millrace.plans.engine import Miner, outputs
from millrace.plans.examples import choose, with_contrasts
from millrace.plans.providers import Heuristic, Http
from millrace.session import session
from millrace.sources import readers, sinks


def parse(spark, args) -> None:
    lines = readers.load_log(spark, args.log, args.format).persist()
    known = []
    if args.examples:
        for e in readers.load_examples(spark, args.examples).orderBy("id").collect():
            known.append({"content": e.content, "template": e.template, "positive": e.Postive_Example, "negative": e.Negative_Example})
    miner = Miner(Http(url=args.url) if args.url else Heuristic(), threshold=args.threshold, examples=known)
    structured, templates = outputs(miner.mine(lines))
    sinks.write_structured(structured, f"{args.out}/structured", "overwrite")
    sinks.write_templates(templates, f"{args.out}/templates", "overwrite")
    print(f"{len(miner.live())} templates, {miner.asked} proposals and {miner.asked_same} merges asked for")


def groundtruth(spark, args) -> None:
    lines = readers.load_log(spark, args.log, args.format)
    notes = readers.load_annotations(spark, args.annotations)
    structured, templates = build_groundtruth(lines, notes)
    sinks.write_structured(structured, f"{args.out}/structured", "overwrite")
    sinks.write_csv(templates, f"{args.out}/templates", "overwrite")


def score(spark, args) -> None:
    truth, result = (readers.load_groundtruth(spark, p) for p in (args.truth, args.result))
    evaluate(truth, result, readers.load_templates(spark, args.truth_templates), readers.load_templates(spark, args.result_templates)).show()


def examples(spark, args) -> None:
    truth = readers.load_groundtruth(spark, args.truth)
    sinks.write_examples(with_contrasts(choose(truth, args.n), truth), args.out, "overwrite")


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = top.add_subparsers(required=True)
    for name, run, places in (
        ("parse", parse, ["log", "format", "out"]),
        ("groundtruth", groundtruth, ["log", "format", "annotations", "out"]),
        ("evaluate", score, ["truth", "result", "truth_templates", "result_templates"]),
        ("examples", examples, ["truth", "out"]),
    ):
        command = commands.add_parser(name)
        command.set_defaults(run=run)
        for place in places:
            command.add_argument(place)
        if name == "parse":
            command.add_argument("--url")
            command.add_argument("--examples")
            command.add_argument("--threshold", type=float, default=0.5)
        if name == "examples":
            command.add_argument("-n", type=int, default=32)
    args = top.parse_args(argv)
    args.run(session(), args)


if __name__ == "__main__":
    main()
