"""python -m lectern PATH search TEXT | get DOCUMENT REF | topic ID | sources [SCOPE] | eval GOLDEN.yaml; prints JSON lines."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.knowledge import KnowledgeBase
from lectern.operators import audit

HITS = 5


def evaluate(kb: KnowledgeBase, golden: DataFrame, k: int = HITS) -> DataFrame:
    """One row a golden question: hit, first_rank. A place is a document and a section, or one of its also_in."""
    asked = golden.select("query_id", "query").distinct()
    found = kb.search(asked, limit=k).withColumn("label", F.concat_ws(" ", "document_id", "section_ref"))
    places = found.select("query_id", F.col("result_no").alias("rank"), F.explode(F.concat(F.array("label"), "also_in")).alias("place"))
    places = places.select("query_id", "rank", F.regexp_extract("place", r"^(\S+) (?s:(.*))$", 1).alias("document"), F.regexp_extract("place", r"^(\S+) (?s:(.*))$", 2).alias("ref"))
    return asked.join(audit.glob_hits(places, golden, k), "query_id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lectern", description=__doc__)
    parser.add_argument("path")
    parser.add_argument("command", choices=["search", "get", "topic", "sources", "eval"])
    parser.add_argument("words", nargs="*")
    parser.add_argument("--limit", type=int, default=10)
    parser.add_argument("--scope", action="append")
    parser.add_argument("--tag", action="append")
    parser.add_argument("--min", type=float, default=0.9)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("lectern").getOrCreate()
    kb = KnowledgeBase(spark, args.path)
    if args.command == "search":
        asked = spark.createDataFrame([(1, " ".join(args.words))], "query_id int, query string")
        out = kb.search(asked, args.scope, args.tag, limit=args.limit).orderBy("result_no")
    elif args.command == "get":
        out = kb.section(args.words[0], " ".join(args.words[1:]))
    elif args.command == "topic":
        out = kb.topic(args.words[0], args.tag, args.limit).orderBy("place")
    elif args.command == "sources":
        out = kb.sources_full(*args.words[:1])
    else:
        from lectern.sources import registry_files

        out = evaluate(kb, registry_files.golden(spark, args.words[0]))
    rows = out.select(F.to_json(F.struct("*"))).collect()  # a page of results
    for r in rows:
        print(r[0])
    if args.command == "eval":
        return int(sum('"hit":true' in r[0] for r in rows) < args.min * len(rows))
    return int(args.command == "get" and '"error":' in rows[0][0])


if __name__ == "__main__":
    sys.exit(main())
