"""Command line: ``python -m sablevec.plans.cli build|search ...``."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sablevec.operators.index import invert
from sablevec.plans.config import Config, Search
from sablevec.plans.sparse_index import SparseIndex, build_from_tokens
from sablevec.session import configure
from sablevec.sources.text import read_corpus, write_results


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sablevec")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build")
    b.add_argument("input")
    b.add_argument("output")
    for name, default in (("n-postings", 3500), ("block-size", 10), ("representatives", 400), ("nknn", 0), ("seed", 7)):
        b.add_argument(f"--{name}", type=int, default=default)
    for name, default in (("summary-energy", 0.4), ("centroid-fraction", 0.1), ("max-fraction", 1.5)):
        b.add_argument(f"--{name}", type=float, default=default)
    b.add_argument("--pruning", choices=("fixed", "global"), default="fixed")
    b.add_argument("--blocking", choices=("chunks", "round_robin", "representatives"), default="chunks")
    b.add_argument("--metric", choices=("max", "centroid"), default="max")
    b.add_argument("--transform", choices=("identity", "jlt"), default="identity")
    s = sub.add_parser("search")
    s.add_argument("index")
    s.add_argument("queries")
    s.add_argument("output")
    for name, default in (("k", 10), ("cut", 10), ("n-knn", 0), ("n-queries", -1)):
        s.add_argument(f"--{name}", type=int, default=default)
    for name, default in (("heap-factor", 0.7), ("alpha", 0.0)):
        s.add_argument(f"--{name}", type=float, default=default)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> float:
    """Returns the seconds taken."""
    a = vars(parser().parse_args(argv))
    spark = configure(spark or SparkSession.builder.appName("sablevec").getOrCreate())
    began = time.time()
    if a.pop("command") == "build":
        source, output = a.pop("input"), a.pop("output")
        corpus = read_corpus(spark, source)
        (build_from_tokens(corpus, Config(**a)) if "token" in corpus.columns else SparseIndex.build(invert(corpus), Config(**a))).save(output)
    else:
        index = SparseIndex.load(spark, a.pop("index"))
        source, output, limit = a.pop("queries"), a.pop("output"), a.pop("n_queries")
        if source.endswith((".json", ".jsonl")):
            from sablevec.sources.text import read_queries

            found = index.search_tokens(read_queries(spark, source), Search(**a))
        else:
            q = invert(read_corpus(spark, source)).withColumnRenamed("d", "q")
            found = index.search(q if limit < 0 else q.where(F.col("q") < limit), Search(**a))
        write_results(found, output)
    return time.time() - began


if __name__ == "__main__":
    print(f"{main():.1f} s")
