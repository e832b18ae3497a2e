"""A made-up panel with a known signal, made by Spark row by row from seeded hashes: any size, the same on any cluster.

Three in ten entities go bad: from month 12 their revenue falls and their leverage rises, from month 14 court cases and a bad
balance appear, and events follow in months 14 to 22.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import Metric

#: (fixed values) the metrics the panel has, by their ids in the example inventory
METRICS = tuple(
    Metric(i, source, name, business, grain, missing="distinguish_zero")
    for i, source, name, business, grain in (
        ("FIN_0001", "财务", "营业收入", "金额", "quarter"),
        ("FIN_0004", "财务", "净利润", "金额", "quarter"),
        ("FIN_0012", "财务", "资产负债率", "比率", "quarter"),
        ("FIN_0017", "财务", "营业收入同比增长率", "比率", "quarter"),
        ("LOAN_0003", "行内信贷", "合同总金额", "金额", "day"),
        ("LOAN_0006", "行内信贷", "贷款余额", "金额", "day"),
        ("CRD_0001", "征信", "未结清不良类表内信贷余额", "金额", "day"),
        ("CRD_0007", "征信", "近期征信查询次数", "计数", "day"),
        ("JUD_0001", "司法", "近一年被执行案件数量", "计数", "event"),
        ("BIZ_0001", "工商", "注册资本", "金额", "day"),
    )
)
INDUSTRIES = ("制造", "批零", "建筑")
LEAST_MONTHS = 23


def _uniform(seed: int, *of) -> Column:
    return (F.xxhash64(F.lit(seed), *[F.lit(x) if isinstance(x, str) else x for x in of]).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)


def _normal(seed: int, name: str, *of) -> Column:
    return F.sqrt(-2 * F.ln(_uniform(seed, name, "r", *of))) * F.cos(2 * 3.141592653589793 * _uniform(seed, name, "a", *of))


def entities(spark: SparkSession, n: int, seed: int) -> DataFrame:
    e = spark.range(n).withColumnRenamed("id", "k")
    return e.select("k", F.format_string("CUST%05d", "k").alias("entity_id"), F.element_at(F.array(*map(F.lit, INDUSTRIES)), (F.col("k") % 3 + 1).cast("int")).alias("industry"), (_uniform(seed, "bad", F.col("k")) < 0.3).alias("bad"))


def generate_wide(spark: SparkSession, n: int = 500, months: int = 24, seed: int = 42) -> DataFrame:
    if months < LEAST_MONTHS:
        raise ValueError(f"the course of a bad entity takes {LEAST_MONTHS} months, not {months}")
    k, m = F.col("k"), F.col("m")
    late = F.greatest(F.lit(0), m - 12)
    bad = lambda a, b: F.when(F.col("bad"), a).otherwise(b)
    scale = F.when(F.col("industry") == INDUSTRIES[0], 1.2).when(F.col("industry") == INDUSTRIES[1], 0.8).otherwise(1.0)
    base = (1e7 + 1.5e6 * _normal(seed, "base", k)) * scale
    fall = lambda at: bad(F.greatest(F.lit(0.4), 1 - 0.04 * F.greatest(F.lit(0), at - 12)), F.lit(1.0))
    revenue = lambda at: base * (1 + 0.05 * _normal(seed, "rev", k, at)) * fall(at)
    contract = (5e6 + 1e6 * _normal(seed, "contract", k)) * scale
    counted = lambda name, mean: F.floor(F.greatest(F.lit(0.0), mean + F.sqrt(mean) * _normal(seed, name, k, m) + 0.5)).cast("double")
    rev, before = revenue(m), revenue((m - 12).cast("int"))
    columns = {
        "FIN_0001": rev,
        "FIN_0004": rev * (0.1 + 0.02 * _normal(seed, "margin", k, m) - bad(0.005 * late, F.lit(0.0))),
        "FIN_0012": F.least(F.lit(0.99), F.greatest(F.lit(0.1), 0.55 + 0.05 * _normal(seed, "lev", k, m) + bad(0.01 * late, F.lit(0.0)))),
        "FIN_0017": F.when(m >= 12, (rev - before) / before),
        "LOAN_0003": contract,
        "LOAN_0006": contract * F.least(F.lit(1.0), F.greatest(F.lit(0.1), 0.7 + 0.03 * _normal(seed, "balance", k, m))),
        "CRD_0001": bad(F.when(m >= 15, F.greatest(F.lit(0.0), (m - 14) * 8e4 + 2e4 * _normal(seed, "npl", k, m))).otherwise(0.0), F.lit(0.0)),
        "CRD_0007": counted("queries", bad(F.lit(3.5), F.lit(1.0))),
        "JUD_0001": bad(F.when(m.between(14, 18), counted("cases", F.lit(2.0))).otherwise(0.0), F.lit(0.0)),
        "BIZ_0001": 2e7 + 5e6 * _normal(seed, "capital", k),
    }
    rows = entities(spark, n, seed).withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(months - 1))))
    return rows.select("entity_id", F.last_day(F.add_months(F.lit("2024-01-31").cast("date"), m)).alias("observation_date"), "industry", *[c.alias(i) for i, c in columns.items()])


def generate_panel(spark: SparkSession, n: int = 500, months: int = 24, seed: int = 42) -> DataFrame:
    wide = generate_wide(spark, n, months, seed)
    return wide.unpivot(["entity_id", "observation_date", "industry"], [m.id for m in METRICS], "metric_id", "value").select("entity_id", "observation_date", "industry", "metric_id", "value")


def generate_events(spark: SparkSession, n: int = 500, months: int = 24, seed: int = 42) -> DataFrame:
    """entity_id, event_date, event_type."""
    k = F.col("k")
    at = lambda m: F.last_day(F.add_months(F.lit("2024-01-31").cast("date"), m))
    event = lambda month, kind, chance=1.0: F.when(_uniform(seed, kind, k) < chance, F.struct(at(F.lit(month)).alias("event_date"), F.lit(kind).alias("event_type")))
    course = F.array(event(14, "judicial_adverse"), event(15, "credit_adverse"), event(17, "overdue30"), event(20, "downgrade", 0.7), event(22, "npl", 0.4))
    stray = F.array(F.when(_uniform(seed, "stray", k) < 0.05, F.struct(at(F.floor(_uniform(seed, "when", k) * months).cast("int")).alias("event_date"), F.lit("overdue30").alias("event_type"))))
    all_ = F.when(F.col("bad"), F.filter(course, lambda x: x.isNotNull())).otherwise(F.filter(stray, lambda x: x.isNotNull()))
    return entities(spark, n, seed).select("entity_id", F.inline(all_))


def generate(spark: SparkSession, folder: str, n: int = 500, months: int = 24, seed: int = 42) -> tuple[str, str]:
    """Writes panel.parquet and labels.parquet under the folder; their paths."""
    from .labels import build_labels

    panel, labels = f"{folder}/panel.parquet", f"{folder}/labels.parquet"
    generate_panel(spark, n, months, seed).write.mode("overwrite").parquet(panel)
    dates = spark.range(months).select(F.last_day(F.add_months(F.lit("2024-01-31").cast("date"), F.col("id").cast("int"))).alias("observation_date"))
    build_labels(generate_events(spark, n, months, seed), dates).write.mode("overwrite").parquet(labels)
    return panel, labels
