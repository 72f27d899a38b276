"""python -m plumbline profile|plan|prompts FILE, search QUESTION, evaluate.

profile: the report of a CSV or Parquet file; plan: a cleaning script for it; prompts:
the requests a plan makes; search: passages of advice for a question; evaluate: checks
of the retrieval, with status 1 if one fails.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .functions.storage import shared_path
from .operators import evaluation
from .operators.advice import corpus, read_corpus
from .operators.retrieval import Index
from .plans.cleaning import Templates
from .plans.report import profile_csv, profile_table, to_json
from .plans.suggest import Planner, build_prompt, build_script, plan_requests, select_issues


def annotate(spark, issues: list[dict], k: int = 3, cutoff: float | None = None) -> list[dict]:
    """Issues of a report with the passages that answer them."""
    index = Index(spark, shared_path(spark, "index"))
    index.build(corpus())
    asked = spark.createDataFrame([(i["rank"], i["issue_type"], i["rag_query"]) for i in issues], "rank int, issue_type string, rag_query string")
    hits = {r["rank"]: [h.asDict() for h in r["retrieved_context"]] for r in index.retrieve_for_issues(asked, k, index.embedder.cutoff if cutoff is None else cutoff).collect()}
    return [{**i, "retrieved_context": hits.get(i["rank"], [])} for i in issues]


def search(spark, question: str, k: int, cutoff: float | None, corpus_path: str | None) -> list[dict]:
    index = Index(spark, shared_path(spark, "index"))
    index.build(read_corpus(spark, corpus_path) if corpus_path else corpus())
    asked = spark.createDataFrame([("q", question)], "query_id string, rag_query string")
    return [r.asDict() for r in index.search(asked, k, index.embedder.cutoff if cutoff is None else cutoff).orderBy("rank").collect()]


def main(argv: list[str] | None = None) -> int:
    args = argparse.ArgumentParser(prog="plumbline", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    what = args.add_subparsers(dest="what", required=True)
    for name in ("profile", "plan", "prompts"):
        own = what.add_parser(name)
        own.add_argument("file")
        own.add_argument("--target", help="the label column, which takes part in no issue")
        if name != "profile":
            own.add_argument("--top", type=int, default=5, help="issues to plan for, with all others on their columns")
    own = what.add_parser("search")
    own.add_argument("question")
    own.add_argument("--top", type=int, default=3)
    own.add_argument("--cutoff", type=float)
    own.add_argument("--corpus", help="a text of one's own with '## ' headings")
    what.add_parser("evaluate").add_argument("--json", action="store_true")
    a = args.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.what == "evaluate":
        found = evaluation.evaluate(spark)
        print(json.dumps(found, indent=2) if a.json else evaluation.told(found))
        return 0 if found["passed"] else 1
    if a.what == "search":
        for hit in search(spark, a.question, a.top, a.cutoff, a.corpus):
            print(f"{hit['rank']}. {hit['section']} ({hit['similarity']:.3f})\n{hit['text']}\n")
        return 0
    report = profile_table(spark.read.parquet(a.file), a.file, a.target) if a.file.endswith(".parquet") else profile_csv(spark, a.file, target=a.target)
    if a.what == "profile":
        print(to_json(report))
        return 0
    issues = annotate(spark, select_issues(report["issues"], a.top)) if report["issues"] else []
    if a.what == "prompts":
        for r in plan_requests(report, issues):
            print(*build_prompt(r["stats"], r["context"], r["task"]), sep="\n\n")
        return 0
    print(build_script(Planner(Templates()).plan(report, issues), a.file, report["dataset"]["column_names"], report.get("source", {}).get("read_call")))
    return 0


if __name__ == "__main__":
    sys.exit(main())
