"""The ledger of search runs: Parquet, appended to, partitioned by industry. Nested parts are JSON text."""

from __future__ import annotations

import json
import logging
import subprocess
import uuid
from collections.abc import Iterable
from dataclasses import asdict
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkiln.plans.tree import to_json, to_text
from panelkiln.search.loop import Config, Result

from .registry import Registry

log = logging.getLogger(__name__)

VERSION = 1
NO_INDUSTRY = "__none__"
SCHEMA = (
    "run_id string, timestamp string, label string, seed bigint, schema_version bigint, gp_config string, fitness_config string, "
    "panel_signature string, registry_sha string, git_sha string, pareto_entries string, history string, industry string"
)
ENTRY = "array<struct<expr_json: string, expr_sexpr: string, fitness: array<double>, rank: int, crowding: double>>"


def panel_signature(panel: DataFrame) -> str:
    """16 hex digits that change with the columns' names or any row, not with the order of rows."""
    names = sorted(panel.columns)
    r = panel.agg(F.count("*"), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in names]).cast("decimal(38,0)"))).first()
    return f"{abs(hash_of([*names, str(r[0]), str(r[1])])):016x}"


def hash_of(parts: Iterable[str]) -> int:
    import hashlib

    return int(hashlib.sha256("\x1f".join(parts).encode()).hexdigest()[:16], 16)


def registry_sha(registry: Registry) -> str:
    return f"{hash_of([repr(m) for m in registry]):016x}"


def git_sha() -> str | None:
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=5).stdout.strip() or None
    except OSError:
        return None


def run_row(result: Result, label: str, industry: str | None, config: Config, signature: str, registry: Registry, fitness_config: dict | None = None) -> dict:
    entries = [{"expr_json": to_json(x.tree), "expr_sexpr": to_text(x.tree), "fitness": list(x.fitness), "rank": x.rank, "crowding": x.crowding} for x in result.front]
    return {
        "run_id": uuid.uuid4().hex, "timestamp": datetime.now(UTC).isoformat(), "label": label, "seed": config.seed, "schema_version": VERSION, "gp_config": json.dumps(asdict(config)),
        "fitness_config": json.dumps(fitness_config or {}), "panel_signature": signature, "registry_sha": registry_sha(registry), "git_sha": git_sha(),
        "pareto_entries": json.dumps(entries, ensure_ascii=False), "history": json.dumps(result.history), "industry": industry or NO_INDUSTRY,
    }


def append(spark: SparkSession, path: str, rows: Iterable[dict]) -> None:
    names = [c.strip().split()[0] for c in SCHEMA.split(",")]
    spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA).coalesce(1).write.mode("append").partitionBy("industry").parquet(path)


def read(spark: SparkSession, path: str, industry: str | None = None, label: str | None = None, since: str | None = None) -> DataFrame:
    """Runs, newest first. industry None: all partitions; a name prunes to its partition. since: ISO time, inclusive."""
    df = spark.read.schema(SCHEMA).parquet(path)
    for wanted in (None if industry is None else F.col("industry") == industry, None if label is None else F.col("label") == label, None if since is None else F.to_timestamp("timestamp") >= F.to_timestamp(F.lit(since))):
        df = df if wanted is None else df.where(wanted)
    return df.orderBy(F.to_timestamp("timestamp").desc(), "run_id")


def latest(spark: SparkSession, path: str, n: int, **where) -> DataFrame:
    """The n latest runs by their own timestamps; a file's time would change with every copy of the ledger."""
    return read(spark, path, **where).limit(n)


def entries(runs: DataFrame) -> DataFrame:
    """One row an entry of a front: the run's columns, and expr_json, expr_sexpr, fitness, rank, crowding."""
    return runs.select("run_id", "label", "industry", "panel_signature", F.inline(F.from_json("pareto_entries", ENTRY)))


def newer(runs: DataFrame) -> DataFrame:
    """Runs written by a later version than this one."""
    return runs.where(F.col("schema_version") > VERSION)


