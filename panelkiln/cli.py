"""Command line: panelkiln <command>. Needs a Spark session's usual configuration and nothing else."""

from __future__ import annotations

import argparse
import json
import sys
import uuid
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from panelkiln.analysis import frontier, reports
from panelkiln.explain.card import Canned, Client
from panelkiln.explain.client import live
from panelkiln.explain.runner import explain
from panelkiln.functions import splits, stats
from panelkiln.knowledge.corpus import read_corpus
from panelkiln.knowledge.retriever import Retriever
from panelkiln.plans.compiler import evaluate
from panelkiln.plans.tree import parse, to_text
from panelkiln.search.coach import ModelCoach
from panelkiln.search.fitness import Fitness
from panelkiln.search.loop import Config, search
from panelkiln.search.primitives import Primitives
from panelkiln.sources import ledger, panel, runs, synthetic
from panelkiln.sources.registry import Registry, default_registry, read_registry


def _session() -> SparkSession:
    return SparkSession.builder.appName("panelkiln").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _registry(a) -> Registry:
    return read_registry(a.registry) if a.registry else default_registry()


def _client(a) -> Client:
    """The service that the environment names, or the reply kept in a file."""
    if not a.reply:
        return live()
    with open(a.reply, encoding="utf-8") as f:
        return Canned([f.read()])


def registry_list(a, spark):
    for source, n in sorted(_registry(a).source_counts().items(), key=lambda x: -x[1]):
        print(f"{n:5d}  {source}")


def gen_synthetic(a, spark):
    print("\n".join(synthetic.generate(spark, a.out, a.entities, a.months, a.seed)))


def eval_(a, spark):
    df = panel.join_labels(evaluate(panel.read_long(spark, a.panel), a.expr, _registry(a), duplicates=a.duplicates), spark.read.parquet(a.labels), a.label)
    if a.lag:
        df = splits.lag_features(df, ["value"], a.lag)
    if a.split != "all":
        df = splits.with_split(df, splits.cuts(df)).where(F.col("split") == a.split)
    got = stats.score(df, "value", "label").collect()
    print(json.dumps(got[0].asDict() if got else {"n": 0}, ensure_ascii=False))


def search_(a, spark):
    registry = _registry(a)
    long = panel.read_long(spark, a.panel)
    ids = [r[0] for r in long.select("metric_id").distinct().collect() if r[0] in registry]
    wide = panel.join_labels(panel.to_wide(long, ids, duplicates=a.duplicates), spark.read.parquet(a.labels), a.label)
    if a.industry:
        wide = wide.where(F.col("industry") == a.industry)
    config = Config(size=a.size, generations=a.generations, seed=a.seed)
    baselines = [registry.resolve(b).id for b in a.baselines]
    fitness = Fitness(wide, registry, across_splits=a.across_splits, baselines=baselines)
    try:
        result = search(fitness, Primitives(registry, ids), config, ModelCoach(_client(a)) if a.coach or a.reply else None, label=a.label, industry=a.industry)
    finally:
        fitness.close()
    for x in result.front[: a.topk]:
        print(f"{x.fitness[0]:.4f} {x.fitness[1]:.4f}  {to_text(x.tree)}")
    if a.out:
        print(runs.save_run(a.out, uuid.uuid4().hex[:12], result, config, label=a.label, industry=a.industry))
    if a.ledger:
        ledger.append(spark, a.ledger, [ledger.run_row(result, a.label, a.industry, config, ledger.panel_signature(long), registry)])


def explain_(a, spark):
    e = explain(panel.read_long(spark, a.panel), spark.read.parquet(a.labels), a.expr, a.label, _registry(a), _client(a))
    print(runs.save_card(a.out, parse(a.expr), e, a.label, a.industry))
    print("\n".join(e.warnings))


def ledger_list(a, spark):
    for r in ledger.read(spark, a.ledger, a.industry, a.label, a.since).collect():
        print(r["timestamp"], r["run_id"], r["label"], r["industry"], len(json.loads(r["pareto_entries"])))


def frontier_(a, spark):
    rows = frontier.skyline(ledger.entries(ledger.read(spark, a.ledger, a.industry, a.label))).collect()
    print(frontier.markdown(rows))


def report_(a, spark):
    known = [r.asDict() for r in ledger.read(spark, a.ledger).select("run_id", "label", "industry", "seed", "timestamp").collect()] if a.ledger else []
    print(reports.report_markdown(reports.report([runs.load_card(c) for c in a.cards], known, _client(a))))


def suspect(a, spark):
    cards = [runs.load_card(c) for c in a.cards]
    retriever = Retriever(read_corpus(spark, a.corpus)) if a.corpus else None
    print(reports.suspicion_markdown(reports.suspicion(cards, _client(a), retriever, spark), [e.card.metric_name_cn for e, _, _ in cards]))


def knowledge_build(a, spark):
    read_corpus(spark, a.corpus).groupBy("industry").count().orderBy("industry").show(truncate=False)


def knowledge_query(a, spark):
    chunks = read_corpus(spark, a.corpus)
    hits = Retriever(chunks).query(spark.createDataFrame([(0, a.text)], "query_id long, query string"), a.topk, industry=a.industry)
    for r in hits.join(chunks, "chunk_id").orderBy("rank").collect():
        print(f"{r['score']:.3f}  {r['chunk_id']}  {r['text'][:100]}")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("panelkiln", description=__doc__)
    p.add_argument("--registry", help="CSV inventory of metrics")
    sub = p.add_subparsers(required=True)

    def command(name: str, run, *options: tuple) -> None:
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        for flag, kw in options:
            c.add_argument(flag, **kw)

    need, text = {"required": True}, {"default": None}
    data = [("--panel", need), ("--labels", need), ("--label", need), ("--duplicates", {"default": "strict", "choices": ["strict", "warn", "max"]})]
    number = lambda n: {"type": int, "default": n}
    command("registry-list", registry_list)
    command("gen-synthetic", gen_synthetic, ("--out", need), ("--entities", number(500)), ("--months", number(24)), ("--seed", number(42)))
    command("eval", eval_, ("--expr", need), *data, ("--lag", number(0)), ("--split", {"default": "all", "choices": ["all", "train", "valid", "oot"]}))
    command("search", search_, *data, ("--industry", text), ("--size", number(60)), ("--generations", number(15)), ("--seed", number(0)), ("--topk", number(10)), ("--out", text), ("--ledger", text), ("--baselines", {"nargs": "*", "default": []}), ("--across-splits", {"action": "store_true"}), ("--coach", {"action": "store_true"}), ("--reply", text))
    command("explain", explain_, ("--expr", need), *data, ("--industry", text), ("--reply", text), ("--out", need))
    command("ledger-list", ledger_list, ("--ledger", need), ("--industry", text), ("--label", text), ("--since", text))
    command("frontier", frontier_, ("--ledger", need), ("--industry", text), ("--label", text))
    command("report", report_, ("--cards", {"nargs": "+", "required": True}), ("--ledger", text), ("--reply", text))
    command("suspect", suspect, ("--cards", {"nargs": "+", "required": True}), ("--corpus", text), ("--reply", text))
    command("knowledge-build", knowledge_build, ("--corpus", need))
    command("knowledge-query", knowledge_query, ("--corpus", need), ("--text", need), ("--industry", text), ("--topk", number(5)))
    return p


def main(argv: Sequence[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(a, _session())


if __name__ == "__main__":
    main(sys.argv[1:])
