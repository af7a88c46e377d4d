"""Command line: ingest, search, match, ask, investigate, link, export, and the evaluation commands."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="trawl")
    out.add_argument("--db", default="data/store", help="folder of the store")
    sub = out.add_subparsers(dest="cmd", required=True)

    def add(name: str, *arguments: tuple) -> None:
        one = sub.add_parser(name)
        for names, options in arguments:
            one.add_argument(*names.split(), **options)

    k = lambda n: ("-k", {"type": int, "default": n})
    add("ingest", ("paths", {"nargs": "+"}), ("--limit", {"type": int}))
    add("search", ("query", {}), k(10), ("--expand", {"action": "store_true"}))
    add("match", ("name", {}), k(10), ("--min-score", {"type": float, "default": 0.0}))
    add("ask", ("question", {}), k(8))
    add("investigate", ("question", {}), ("-n", {"type": int, "default": 3}))
    add("link", ("a", {}), ("b", {}), ("--hops", {"type": int, "default": 3}))
    add("export-vault", ("--out", {"default": "vault"}), ("--all", {"action": "store_true"}), ("--seed", {}), ("--hops", {"type": int, "default": 2}))
    add("build-eval", ("--out", {"default": "data/eval/queries"}), ("--per-family", {"type": int, "default": 75}))
    add("evaluate", ("--queries", {"default": "data/eval/queries"}), ("--out", {"default": "data/eval/results.json"}))
    add("train-rerank", ("--test-queries", {"default": "data/eval/queries"}), ("--per-family", {"type": int, "default": 150}), ("--pool", {"type": int, "default": 100}), ("--out", {"default": "data/eval/weights.json"}))
    add("gate", ("--results", {"default": "data/eval/results.json"}), ("--baseline", {"default": "baseline.json"}), ("--tolerance", {"type": float, "default": 0.02}))
    add("adjudicate", ("--queries", {"default": "data/eval/queries"}), ("--decisions", {"required": True}), ("--model", {"default": "cache"}), k(10))
    add("serve", ("--port", {"type": int, "default": 8000}))
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("trawl").getOrCreate()
    if args.cmd == "gate":
        return _gate(spark, args)
    from trawl.plans import agent, answer, evaluate, export
    from trawl.plans.pipeline import Pipeline
    from trawl.sources.records import Store, append_json, load, read_queries

    store = Store(spark, args.db)
    if args.cmd == "ingest":
        print(json.dumps(load(store, *args.paths, limit=args.limit), indent=2))
    elif args.cmd == "export-vault":
        seed = args.seed
        if seed and store.get(seed) is None:  # a name, not an id
            best = Pipeline.build(spark, args.db).search(seed, k=1).first()
            if best is None:
                raise SystemExit(f"no entity matches {args.seed!r}")
            seed = best.doc_id
        made = export.export(store.entities, store.relations, args.out, "all" if args.all else "connected", seed, args.hops)
        print(f"wrote {made['notes']} notes, {made['relations']} relations -> {args.out}/")
    elif args.cmd == "match":
        from trawl.operators.names import MEASURES, NameMatcher

        asked = spark.createDataFrame([("0", args.name)], "query_id string, query string")
        found = NameMatcher().index(store.entities).matches(asked, args.k, args.min_score)
        for r in found.join(store.entities.select(F.col("id").alias("doc_id"), "caption"), "doc_id").orderBy("rank").collect():
            print(f"{r.score:5.1f}  {r.caption[:44]:45s} via {r.matched_name[:34]!r:37s} " + "  ".join(f"{m}={r[m]:.0f}" for m in MEASURES))
    elif args.cmd == "build-eval":
        append_json(evaluate.build_queries(store.entities, args.per_family), args.out, "overwrite")
        print(f"{read_queries(spark, args.out).count()} queries -> {args.out}")
    else:
        p = Pipeline.build(spark, args.db)
        if args.cmd == "search":
            for r in p.hits(p.search(args.query, args.k, expand=args.expand)).collect():
                print(f"{r.score:7.4f}  {r.schema:13s} {r.caption:55s} {','.join(r.topics[:2]) or '-'}")
        elif args.cmd == "ask":
            q = p.queries(args.question)
            print(answer.answer(q, p.search(q, args.k, expand=True), p.entities, args.k).first().text)
        elif args.cmd == "investigate":
            report = agent.investigate(p, args.question, args.n)
            print(report["report"] + "\n\n--- trace")
            for step in report["trace"]:
                print("  {kind:15s} {detail:78.76s} hits={hits}".format(**step))
            print("  stopped: {stopped_because} after {iterations} iteration(s)".format(**report))
        elif args.cmd == "link":
            print(json.dumps(agent.link(p, args.a, args.b, args.hops), indent=2, ensure_ascii=False))
        elif args.cmd == "evaluate":
            found = evaluate.run(p, read_queries(spark, args.queries), path=args.out)
            print(evaluate.as_table(spark, found) + "\n\nby family (recall@5):")
            for family, systems in sorted(found["by_family"].items()):
                print(f"  {family:10s} " + "  ".join(f"{s}={m['recall@5']:.2f}" for s, m in systems.items()))
        elif args.cmd == "train-rerank":
            from trawl.plans.training import train

            print(json.dumps(train(p, read_queries(spark, args.test_queries), args.per_family, args.pool, path=args.out), indent=2))
        elif args.cmd == "adjudicate":
            _adjudicate(p, args, read_queries(spark, args.queries))
        elif args.cmd == "serve":
            from trawl.http import serve

            serve(p, args.port)
    return 0


def _gate(spark: SparkSession, args) -> int:
    from trawl.plans.evaluate import gate, long

    with open(args.results, encoding="utf-8") as f, open(args.baseline, encoding="utf-8") as g:
        results, baseline = json.load(f), json.load(g)
    for system, m in results.get("overall", {}).items():
        print(f"  {system:20s} recall@10={m.get('recall@10', 0):.3f}  mrr@10={m.get('mrr@10', 0):.3f}")
    worse = gate(long(spark, results), long(spark, baseline), args.tolerance, baseline.get("primary", "hybrid+rerank"))
    failures = [r.failure for r in worse.orderBy("failure").collect()]
    print("\nquality gate " + ("FAILED:\n" + "\n".join(f"  - {x}" for x in failures) if failures else "passed"))
    return int(bool(failures))


def _adjudicate(p, args, labelled) -> None:
    from trawl.plans import adjudicate, evaluate
    from trawl.sources.records import read_decisions

    queries = labelled.select(F.col("id").alias("query_id"), "query", "family")
    run = p.search(queries, args.k).cache()
    asked = adjudicate.keyed(adjudicate.prompts(queries, run, p.entities), args.model)
    decisions = adjudicate.judged(asked, read_decisions(p.spark, args.decisions)).cache()
    relevant = evaluate.qrels(labelled)
    adjudicate.sweep(run, decisions, relevant, queries).orderBy("margin").show()
    outcomes = adjudicate.outcome(run, decisions, relevant, queries)
    adjudicate.summary(outcomes).show()
    adjudicate.by_confidence(outcomes).show()


if __name__ == "__main__":
    sys.exit(main())
