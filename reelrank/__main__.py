"""The command line: python -m reelrank inspect | transform | evaluate (QY7)."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from reelrank.operators import corpus as cp
from reelrank.operators import evaluation as ev
from reelrank.operators import validation as va
from reelrank.runtime import local_session
from reelrank.sources import readers, sinks


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="reelrank", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    inspect = sub.add_parser("inspect", help="check a dataset and count it")
    inspect.add_argument("dataset")
    inspect.add_argument("--split", default="test")
    transform = sub.add_parser("transform", help="make a corpus of the four CSV tables")
    transform.add_argument("source")
    transform.add_argument("output")
    evaluate = sub.add_parser("evaluate", help="measure a run against a dataset")
    evaluate.add_argument("dataset")
    evaluate.add_argument("run")
    evaluate.add_argument("--split", default="test")
    evaluate.add_argument("--k", type=int, default=10)
    evaluate.add_argument("--recall-k", type=int, default=100)
    evaluate.add_argument("--output")
    for name in ("corpus", "queries", "qrels"):
        evaluate.add_argument(f"--{name}")
    evaluate.add_argument("--require-fully-judged-at-k", action="store_true")
    return parser


def _evaluate(spark: SparkSession, args: argparse.Namespace) -> None:
    files = (args.corpus, args.queries, args.qrels)
    if any(files) and not all(files):
        raise readers.DataError("corpus, queries and qrels are given together or not at all")
    ds = readers.load_dataset_files(spark, *files) if all(files) else readers.load_dataset(spark, args.dataset, args.split)
    run = readers.load_run(spark, args.run)
    unknown = va.violations(ds.documents.selectExpr("_id as doc_id"), ds.queries.selectExpr("_id as query_id"), ds.qrels, ev.ranked(run)).where("rule = 'unknown_run_document'").collect()  # a row a rule
    if unknown:
        raise readers.DataError(f"the run names unknown documents: {unknown[0].sample}")
    report = ev.summarize(ev.evaluate(ds.qrels, run, args.k, args.recall_k, ds.queries.selectExpr("_id as query_id", "category")))
    print(sinks.report_markdown(report, "Evaluation"))
    if args.output:
        sinks.write_jsonl(report, args.output)
    if args.require_fully_judged_at_k:
        least = report.select("minimum_judged_at_k").first()[0]
        if least is None or least < 1:
            raise readers.DataError(f"every query must be fully judged at {args.k}; the least share is {least}")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0, or 2 where the data or the gate fails."""
    args = build_parser().parse_args(argv)
    spark = spark or SparkSession.getActiveSession() or local_session("*")
    try:
        if args.command == "inspect":
            ds = readers.load_dataset(spark, args.dataset, args.split)
            print(sinks.report_markdown(va.summary(ds.documents, ds.queries, ds.qrels), "Dataset"))
        elif args.command == "transform":
            sinks.write_jsonl(cp.build_corpus(*(readers.read_csv(spark, f"{args.source}/{n}.csv", n) for n in ("movies", "ratings", "tags", "links"))), args.output)
        else:
            _evaluate(spark, args)
        return 0
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    raise SystemExit(main())
