"""Queries over the engine's other parts - storage, ledger, fronts, rules, fitness, search - with the SQL that gives the same rows.

Those about single expressions or cards have few rows, whose expected values stand in the SQL as VALUES.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelkiln.analysis import frontier
from panelkiln.explain import consistency
from panelkiln.explain.card import Card, json_of
from panelkiln.functions import relations, splits
from panelkiln.functions.columns import rounded
from panelkiln.knowledge import retriever
from panelkiln.plans import tree
from panelkiln.plans.typecheck import TypeCheckError, check
from panelkiln.queries import _H, _WIDE, METRICS, _table, long_panel, panel_duplicates, wide_panel
from panelkiln.search import fitness, loop, nsga
from panelkiln.search.primitives import Primitives
from panelkiln.sources import ledger, panel, registry, synthetic


def _home(spark: SparkSession) -> str:
    """A new folder's name where all executors can write."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="panelkiln-")
    return f"{shared}/{uuid.uuid4().hex}"


def _values(rows: list[tuple]) -> str:
    def text(x) -> str:
        return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else repr(x) + "::DOUBLE" if isinstance(x, float) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"

    return "VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)


QUERIES, ORACLES = {}, {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


# ---- storage


@_query(f"WITH {_WIDE} SELECT entity_id, observation_date::VARCHAR AS observation_date, industry, metric_id, value FROM (SELECT *, 'M1' AS metric_id, M1 AS value FROM w UNION ALL SELECT *, 'M5', M5 FROM w)")
def long_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as a long panel and read again with two metrics, whose filter reaches the scan."""
    home = _home(spark)
    panel.write_long(long_panel(spark, sf_dir), home, METRICS)
    return panel.read_long(spark, home, ["M1", "M5"]).withColumn("observation_date", F.col("observation_date").cast("string"))


@_query("SELECT l_suppkey::VARCHAR AS entity_id, l_shipdate::DATE::VARCHAR AS observation_date, 'x' AS industry, 'M1' AS metric_id, l_extendedprice AS value FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_suppkey, l_shipdate::DATE) > 1")
def dirty_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that pivoting with `warn` writes aside."""
    home = _home(spark)
    panel.to_wide(panel_duplicates(spark, sf_dir), ["M1"], duplicates="warn", dirty_path=home)
    return spark.read.parquet(home).withColumn("observation_date", F.col("observation_date").cast("string"))


@_query("SELECT l_suppkey::VARCHAR AS entity_id, l_shipdate::DATE::VARCHAR AS observation_date, 'x' AS industry, max(l_extendedprice) AS M1 FROM lineitem GROUP BY ALL")
def duplicates_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem")
    long = lines.select(F.col("l_suppkey").cast("string").alias("entity_id"), F.to_date("l_shipdate").alias("observation_date"), F.lit("x").alias("industry"), F.lit("M1").alias("metric_id"), F.col("l_extendedprice").alias("value"))
    return panel.to_wide(long, ["M1"], duplicates="warn").withColumn("observation_date", F.col("observation_date").cast("string"))


@_query("SELECT 'strict' AS policy, count(*) > 0 AS raised FROM (SELECT 1 FROM lineitem GROUP BY l_suppkey, l_shipdate::DATE HAVING count(*) > 1)")
def duplicates_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    try:
        panel.to_wide(panel_duplicates(spark, sf_dir), ["M1"])
        raised = False
    except panel.DuplicateCells:
        raised = True
    return spark.createDataFrame([("strict", raised)], "policy string, raised boolean")


@_query("SELECT c AS metric_id, r AS refused FROM (VALUES ('M1', FALSE), ('T1', TRUE)) AS v(c, r)")
def sink_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the long panel's sink refuses a metric: text can't be a number."""
    known = registry.Registry([*METRICS, registry.Metric("T1", "lines", "note", "文本", "day")])
    long, out = long_panel(spark, sf_dir).limit(1), []
    for m in ("M1", "T1"):
        try:
            panel.write_long(long.withColumn("metric_id", F.lit(m)), _home(spark), known)
            out.append((m, False))
        except ValueError:
            out.append((m, True))
    return spark.createDataFrame(out, "metric_id string, refused boolean")


@_query("SELECT 'lines' AS source, 6::BIGINT AS n")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(METRICS.source_counts().items()), "source string, n long")


@_query(_values([("M1", "price", "金额", "numeric"), ("M2", "quantity", "金额", "numeric"), ("M3", "discount", "比率", "ratio"), ("M4", "lines", "计数", "int"), ("M5", "returns", "计数", "int"), ("M6", "tax", "比率", "ratio")]).join(("SELECT * FROM (", ") AS v(metric_id, name, business, kind)")))
def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return METRICS.frame(spark).select("metric_id", "name", "business", F.lower("kind").alias("kind"))


@_query("SELECT 50::BIGINT AS entities, 24::BIGINT AS dates, TRUE AS again")
def synthetic_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generated panel's size, and whether the same seed gives the same rows."""
    signatures = []
    for _ in range(2):
        home = _home(spark)
        paths = synthetic.generate(spark, home, 50, 24, 42)
        long = spark.read.parquet(next(p for p in paths if "panel" in p))
        signatures.append(ledger.panel_signature(long))
    return long.agg(F.countDistinct("entity_id").alias("entities"), F.countDistinct("observation_date").alias("dates")).withColumn("again", F.lit(signatures[0] == signatures[1]))


# ---- ledger

_RUNS = """r AS (SELECT n_name AS run_id, '2024-01-' || lpad((n_nationkey + 1)::VARCHAR, 2, '0') || 'T00:00:00+00:00' AS timestamp, CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS label, n_nationkey AS seed, r_name AS industry
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def _ledger(spark: SparkSession, sf_dir: str) -> str:
    home = _home(spark)
    rows = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name").collect()  # a row a nation
    front = '[{"expr_json": "{}", "expr_sexpr": "(A)", "fitness": [0.5, 1.0], "rank": 0, "crowding": 2.0}, {"expr_json": "{}", "expr_sexpr": "(B)", "fitness": [1.5, %d.0], "rank": 1, "crowding": 1.0}]'
    ledger.append(spark, home, [
        {"run_id": r["n_name"], "timestamp": f"2024-01-{r['n_nationkey'] + 1:02d}T00:00:00+00:00", "label": "odd" if r["n_nationkey"] % 2 else "even", "seed": int(r["n_nationkey"]), "schema_version": 1, "gp_config": "{}",
         "fitness_config": "{}", "panel_signature": "p", "registry_sha": "r", "git_sha": None, "pareto_entries": front % r["n_nationkey"], "history": "[]", "industry": r["r_name"]}
        for r in rows
    ])
    return home


@_query(f"WITH {_RUNS} SELECT run_id, timestamp, label, seed::BIGINT AS seed, industry FROM r WHERE industry = 'ASIA' AND label = 'even' AND timestamp >= '2024-01-05'")
def ledger_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appended, then read by industry (a partition), label and time."""
    return ledger.read(spark, _ledger(spark, sf_dir), industry="ASIA", label="even", since="2024-01-05T00:00:00+00:00").select("run_id", "timestamp", "label", "seed", "industry")


@_query(f"WITH {_RUNS} SELECT run_id, (row_number() OVER (ORDER BY timestamp DESC, run_id))::INT AS place FROM r QUALIFY place <= 5")
def ledger_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five latest runs, with their places in the order given."""
    got = ledger.latest(spark, _ledger(spark, sf_dir), 5).select("run_id").collect()
    return spark.createDataFrame([(r["run_id"], i) for i, r in enumerate(got, 1)], "run_id string, place int")


@_query(f"WITH {_RUNS} SELECT run_id, industry, x AS expr_sexpr, CASE x WHEN '(A)' THEN 1.0 ELSE seed::DOUBLE END::DOUBLE AS second, CASE x WHEN '(A)' THEN 0 ELSE 1 END AS rank FROM r, (VALUES ('(A)'), ('(B)')) AS v(x)")
def ledger_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ledger.entries(ledger.read(spark, _ledger(spark, sf_dir)))
    return got.select("run_id", "industry", "expr_sexpr", F.element_at("fitness", 2).alias("second"), "rank")


@_query("SELECT TRUE AS same_in_any_order, FALSE AS same_after_a_change, FALSE AS same_without_a_column")
def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = wide_panel(spark, sf_dir)
    own = ledger.panel_signature(w)
    changed = w.withColumn("M1", F.when(F.col("entity_id") == "1", F.col("M1") + 1).otherwise(F.col("M1")))
    rows = [(ledger.panel_signature(w.repartition(3).select(*reversed(w.columns))) == own, ledger.panel_signature(changed) == own, ledger.panel_signature(w.drop("M6")) == own)]
    return spark.createDataFrame(rows, "same_in_any_order boolean, same_after_a_change boolean, same_without_a_column boolean")


# ---- affiliates

_EDGES = "SELECT a.s_suppkey::VARCHAR AS src, b.s_suppkey::VARCHAR AS dst FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey % 3 = b.s_suppkey % 3 AND a.s_suppkey <> b.s_suppkey"


@_query(f"WITH {_WIDE}, e AS ({_EDGES}) SELECT src AS entity_id, observation_date::VARCHAR AS observation_date, round(sum(M1), 2) AS affil_sum, bool_or(M5 <> 0) AS affil_has FROM e JOIN w ON entity_id = dst GROUP BY ALL")
def affiliates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AffilSum of revenue and AffilHas of returns, over the suppliers of a nation with the same remainder by three."""
    s = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"))
    a, b = s.toDF("src", "n").withColumn("m", F.col("src") % 3), s.toDF("dst", "n").withColumn("m", F.col("dst") % 3)
    edges = a.join(b, ["n", "m"]).where("src <> dst").select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    w = wide_panel(spark, sf_dir)
    got = relations.over_affiliates(w, edges, "M1").drop("affil_has").join(relations.over_affiliates(w, edges, "M5").drop("affil_sum"), ["entity_id", "observation_date"])
    return got.select("entity_id", F.col("observation_date").cast("string").alias("observation_date"), rounded(F.col("affil_sum"), 2).alias("affil_sum"), "affil_has")


# ---- fronts

_POINTS = f"{_WIDE}, s AS (SELECT entity_id, round(sum(M1), 2) AS a, -sum(M5) AS b, round(sum(M6), 2) AS c, entity_id::INT % 2 AS new FROM w GROUP BY entity_id)"
_BEATS = "{0}.a >= {1}.a AND {0}.b >= {1}.b AND {0}.c >= {1}.c AND ({0}.a > {1}.a OR {0}.b > {1}.b OR {0}.c > {1}.c)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = wide_panel(spark, sf_dir).groupBy("entity_id").agg(rounded(F.sum("M1"), 2).alias("a"), (-F.sum("M5")).alias("b"), rounded(F.sum("M6"), 2).alias("c"))
    return w.select("entity_id", F.array("a", "b", "c").alias("fitness"), (F.col("entity_id").cast("int") % 2).alias("new"))


@_query(f"WITH {_POINTS} SELECT entity_id FROM s WHERE EXISTS (FROM s o WHERE {_BEATS.format('o', 's')})")
def dominated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that some entry of the front dominates."""
    p = _points(spark, sf_dir)
    return frontier.dominated_by(p, frontier.skyline(p)).select("entity_id")


@_query(f"""WITH {_POINTS}, o AS (SELECT * FROM s WHERE new = 0), n AS (SELECT * FROM s WHERE new = 1),
f AS (SELECT * FROM o x WHERE NOT EXISTS (FROM o y WHERE {_BEATS.format('y', 'x')})),
g AS (SELECT count(*) AS added FROM n x WHERE NOT EXISTS (FROM s y WHERE {_BEATS.format('y', 'x')})),
l AS (SELECT count(*) AS lost FROM f x WHERE EXISTS (FROM n y WHERE {_BEATS.format('y', 'x')}))
SELECT added AS new_on_front, lost AS existing_dominated, added - lost AS net_added, FALSE AS same_panel, TRUE AS usual_panel FROM g, l""")
def expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the odd suppliers change on the front of the even ones; one earlier entry saw another panel, most saw the same."""
    p = _points(spark, sf_dir)
    old = p.where("new = 0").withColumn("panel_signature", F.when(F.col("entity_id") == "2", "q").otherwise("p"))
    got = frontier.expansion(old, p.where("new = 1").withColumn("panel_signature", F.lit("p")))
    return spark.createDataFrame([got], "new_on_front long, existing_dominated long, net_added long, same_panel boolean, usual_panel boolean")


_INF = float("inf")
_FRONTS = [(0, 4.0, 1.0, 0, _INF), (1, 3.0, 3.0, 0, 2.0), (2, 1.0, 4.0, 0, _INF), (3, 2.0, 2.0, 1, _INF), (4, 1.0, 1.0, 2, _INF), (5, 3.0, 1.0, 1, _INF), (6, 3.0, 3.0, 0, None)]


@_query("SELECT * FROM (VALUES (0, 0, TRUE), (1, 0, FALSE), (2, 0, TRUE), (3, 1, TRUE), (4, 2, TRUE), (5, 1, TRUE)) AS v(id, front, at_an_end)")
def fronts_and_crowding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-dominated sorting of six points, and which have all the room of their front."""
    points = [x[1:3] for x in _FRONTS[:6]]
    out = []
    for rank, front in enumerate(nsga.fronts(points)):
        out += [(i, rank, bool(np.isinf(room))) for i, room in zip(front, nsga.crowding([points[i] for i in front]), strict=True)]
    return spark.createDataFrame(out, "id int, front int, at_an_end boolean")


# ---- trees and rules

_TREES = [
    ("(GT (PctChange returns 12) -0.1)", "(GT (PctChange returns 12) -0.1)", 3, "returns", '{"args":[{"args":[{"field":"returns"},{"literal":12}],"op":"PctChange"},{"literal":-0.1}],"op":"GT"}'),
    ("( Mean   price 2.0 )", "(Mean price 2.0)", 2, "price", '{"args":[{"field":"price"},{"literal":2}],"op":"Mean"}'),
    ("(Ratio `a b` `12`)", "(Ratio `a b` `12`)", 2, "a b,12", '{"args":[{"field":"a b"},{"field":"12"}],"op":"Ratio"}'),
    ("(Add price (Add price tax))", "(Add price (Add price tax))", 3, "price,tax", '{"args":[{"field":"price"},{"args":[{"field":"price"},{"field":"tax"}],"op":"Add"}],"op":"Add"}'),
]


@_query(f"SELECT * FROM ({_values([(t, s, n, f, c, True) for t, s, n, f, c in _TREES])}) AS v(given, text, leaves, fields, canonical, back)")
def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed and written again: text, leaves, fields, canonical JSON, and whether text, dictionary and JSON give the tree back."""
    out = []
    for given, *_ in _TREES:
        t = tree.parse(given)
        back = tree.parse(tree.to_text(t)) == t and tree.from_dict(tree.to_dict(t)) == t and tree.from_json(tree.to_json(t)) == t
        out.append((given, tree.to_text(t), tree.leaf_count(t), ",".join(tree.field_names(t)), tree.canonical(t), back))
    return spark.createDataFrame(out, "given string, text string, leaves int, fields string, canonical string, back boolean")


#: expression, and what checking it gives: the kind, or why not.
_CHECKED = [
    ("(GT price 1)", "bool"), ("(Ratio price quantity)", "ratio"), ("(PeerRank price)", "ratio"), ("(Delta price)", "arity"), ("(Mean price 0)", "window"), ("(Mean price 1.5)", "window"), ("(Mean price -3)", "window"),
    ("(AND price (GT price 1))", "argument"), ("(GT price quantity)", "literal"), ("(Ratio price lines)", "dimension"), ("(Add price nothing)", "unknown field"), ("(Nothing price)", "parse"), ("(GT price 1", "parse"),
    ("(Add (Add (Add (Add (Add (Add (Add price price) price) price) price) price) price) price)", "size"), ("(Count (GT returns 1) 6)", "int"),
]


@_query(f"SELECT * FROM ({_values(_CHECKED)}) AS v(expression, verdict)")
def typecheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arity, argument types, literal slots, windows, dimensions, sizes, unknown names."""
    reasons = {"takes": "arity", "literals": "literal", "argument": "argument", "window": "window", "amount": "dimension", "depth": "size"}
    out = []
    for text, _ in _CHECKED:
        try:
            verdict = str(check(tree.parse(text), METRICS).kind).lower().removeprefix("kind.")
        except TypeCheckError as e:
            verdict = next(v for k, v in reasons.items() if k in str(e))
        except KeyError:
            verdict = "unknown field"
        except tree.ParseError:
            verdict = "parse"
        out.append((text, verdict))
    return spark.createDataFrame(out, "expression string, verdict string")


# ---- fitness

_RULES = ["(GT (PctChange returns 1) 0.3)", "(LT (ZScore price 6) -0.5)", "(AND (GT (PeerRank price) 0.5) (GT returns 1))", "(GT (TsRank returns 6) 0.9)"]


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    later = F.lead("M5").over(Window.partitionBy("entity_id").orderBy("observation_date"))
    return wide_panel(spark, sf_dir).withColumn("label", (later > 2).cast("int")).where("label IS NOT NULL")


def _fitness_sql(baseline: str | None) -> str:
    h, g = "PARTITION BY split, entity_id ORDER BY observation_date", "PARTITION BY split, industry, observation_date"
    six = f"({h} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"
    rules = [
        f"(M5 - lag(M5) OVER ({h})) / lag(M5) OVER ({h}) > 0.3::DOUBLE",
        f"(M1 - avg(M1) OVER {six}) / stddev_samp(M1) OVER {six} < -0.5::DOUBLE",
        f"(CASE WHEN M1 IS NOT NULL THEN rank() OVER ({g} ORDER BY M1 NULLS LAST) + (count(*) OVER ({g}, M1) - 1) / 2.0::DOUBLE END) / count(*) OVER ({g}) > 0.5::DOUBLE AND M5 > 1",
        f"len(list_filter(list(M5) OVER {six}, lambda v: v <= M5)) / count(*) OVER {six} > 0.9::DOUBLE",
    ]
    leaves = [tree.leaf_count(tree.parse(r)) for r in _RULES]
    each = " UNION ALL ".join(f"SELECT {i} AS k, r{i}::INT AS x, y, split, base FROM v WHERE r{i} IS NOT NULL" for i in range(4))
    redundancy = "0.0::DOUBLE" if baseline is None else "0.0::DOUBLE - coalesce(abs(s.corr), 0)"
    return f"""WITH {_WIDE}, l AS (SELECT *, (lead(M5) OVER ({_H}) > 2)::INT AS y FROM w), k AS (SELECT * FROM l WHERE y IS NOT NULL),
d AS (SELECT observation_date AS d, row_number() OVER (ORDER BY observation_date) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT observation_date FROM k)),
p AS (SELECT k.*, CASE WHEN i <= floor(n * 0.6::DOUBLE) THEN 'train' WHEN i <= floor(n * 0.8::DOUBLE) THEN 'valid' ELSE 'oot' END AS split FROM k JOIN d ON d = observation_date),
v AS (SELECT split, y, {baseline or 'NULL::DOUBLE'} AS base, {', '.join(f'{r} AS r{i}' for i, r in enumerate(rules))} FROM p),
u AS (SELECT * FROM ({each}) WHERE split <> 'valid'),
c AS (SELECT k, count(*) FILTER (split = 'oot' AND x = 1 AND y <> 0)::DOUBLE AS p1, count(*) FILTER (split = 'oot' AND x = 1 AND y = 0)::DOUBLE AS n1, count(*) FILTER (split = 'oot' AND x = 0 AND y <> 0)::DOUBLE AS p0,
  count(*) FILTER (split = 'oot' AND x = 0 AND y = 0)::DOUBLE AS n0, count(*) FILTER (split = 'train' AND x = 0)::DOUBLE AS e0, count(*) FILTER (split = 'train')::DOUBLE AS e FROM u GROUP BY k),
z AS (SELECT *, p0 + p1 AS pos, n0 + n1 AS neg, p0 + n0 AS a0, p1 + n1 AS a1, p0 + n0 + p1 + n1 AS n,
  list_distinct(list_transform(range(0, 11), lambda q: CASE WHEN floor(q / 10 * (e - 1)) >= e0 THEN 1.0 WHEN ceil(q / 10 * (e - 1)) >= e0 THEN q / 10 * (e - 1) - floor(q / 10 * (e - 1)) ELSE 0.0 END::DOUBLE)) AS edges FROM c),
i AS (SELECT *, CASE WHEN len(edges) > 2 THEN ((e0 + 1e-6) / (e + 2e-6) - (a0 + 1e-6) / (n + 2e-6)) * ln(((e0 + 1e-6) / (e + 2e-6)) / ((a0 + 1e-6) / (n + 2e-6)))
    + ((e - e0 + 1e-6) / (e + 2e-6) - (a1 + 1e-6) / (n + 2e-6)) * ln(((e - e0 + 1e-6) / (e + 2e-6)) / ((a1 + 1e-6) / (n + 2e-6))) ELSE 0 END AS psi,
  CASE WHEN a0 > 0 THEN ((p0 + 0.5::DOUBLE) / (pos + 1e-9) - (n0 + 0.5::DOUBLE) / (neg + 1e-9)) * ln(((p0 + 0.5::DOUBLE) / (pos + 1e-9)) / ((n0 + 0.5::DOUBLE) / (neg + 1e-9))) ELSE 0 END
  + CASE WHEN a1 > 0 THEN ((p1 + 0.5::DOUBLE) / (pos + 1e-9) - (n1 + 0.5::DOUBLE) / (neg + 1e-9)) * ln(((p1 + 0.5::DOUBLE) / (pos + 1e-9)) / ((n1 + 0.5::DOUBLE) / (neg + 1e-9))) ELSE 0 END AS iv FROM z),
t AS (SELECT k, rank() OVER (PARTITION BY k ORDER BY x) + (count(*) OVER (PARTITION BY k, x) - 1) / 2 AS a, rank() OVER (PARTITION BY k ORDER BY base) + (count(*) OVER (PARTITION BY k, base) - 1) / 2 AS b FROM u WHERE split = 'oot'),
s AS (SELECT k, corr(a, b) AS corr FROM t GROUP BY k),
f AS (SELECT i.k, CASE WHEN n < 20 OR pos = 0 THEN [-1.0, -1.0, -1.0, -1.0, -1.0, -1.0] ELSE [iv, CASE WHEN pos > 0 AND neg > 0 THEN abs(p0 / pos - n0 / neg) ELSE 0 END, CASE WHEN e < 20 THEN 0 ELSE 1 / (1 + greatest(psi, 0)) END,
  CASE WHEN a0 > 0 AND a1 > 0 THEN abs(p1 / a1 - p0 / a0) ELSE 0 END, -[{', '.join(map(str, leaves))}][i.k + 1], {redundancy}] END::DOUBLE[] AS f FROM i JOIN s USING (k))
SELECT r.rule, {', '.join(f'round(coalesce(f[{j + 1}], -1.0::DOUBLE), 6) + 0.0::DOUBLE AS {o}' for j, o in enumerate(fitness.OBJECTIVES))}
FROM ({_values([(i, r) for i, r in enumerate(_RULES)])}) AS r(k, rule) LEFT JOIN f USING (k)"""


def _fitness(spark: SparkSession, sf_dir: str, baselines: list[str]) -> DataFrame:
    f = fitness.Fitness(_labelled(spark, sf_dir), METRICS, baselines=baselines)
    try:
        got = f.of([tree.parse(r) for r in _RULES])
    finally:
        f.close()
    return spark.createDataFrame([(r, *(round(float(v), 6) + 0.0 for v in x)) for r, x in zip(_RULES, got, strict=True)], "rule string, " + ", ".join(f"{o} double" for o in fitness.OBJECTIVES))


@_query(_fitness_sql(None))
def gp_fitness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six objectives of some candidate rules, evaluated in one batch."""
    return _fitness(spark, sf_dir, [])


@_query(_fitness_sql("M2"))
def gp_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a baseline that candidates should not repeat."""
    return _fitness(spark, sf_dir, ["M2"])


@_query("SELECT * FROM (VALUES ('M1', 3::BIGINT), ('M5', 1::BIGINT)) AS v(source, n)")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a front mentions each source of metrics."""
    front = [loop.Individual(tree.parse(t)) for t in ("(GT price 1)", "(GT (Delta price 1) 2)", "(Gt2 price returns)")]
    return spark.createDataFrame(sorted(loop.coverage(front, Primitives(METRICS, ["M1", "M5"])).items()), "source string, n long")


@_query(f"WITH {_WIDE}, d AS (SELECT observation_date AS d, row_number() OVER (ORDER BY observation_date) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT observation_date FROM w)) SELECT max(CASE WHEN i <= floor(n * 0.6::DOUBLE) THEN d END)::VARCHAR AS train, max(CASE WHEN i <= floor(n * 0.8::DOUBLE) THEN d END)::VARCHAR AS valid, max(d)::VARCHAR AS oot FROM d")
def split_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = splits.cuts(wide_panel(spark, sf_dir))
    return spark.createDataFrame([(str(c.train), str(c.valid), str(c.oot))], "train string, valid string, oot string")


# ---- cards and knowledge

_CARDS = [
    (0, "(LT price 1)", "price 上升", 0.2, 0.3, "LT against 上升", "", ""), (1, "(GT price 1)", "price 上升,IV 0.50", 0.2, 0.3, "", "IV 0.50, measured 0.200", ""),
    (2, "(GT price 1)", "price 与 tax", 0.2, 0.3, "", "", "tax"), (3, "(GT price 1)", "price KS: 0.31", 0.2, 0.3, "", "", ""),
]


@_query(f"SELECT * FROM ({_values([(k, d, f, n) for k, _, _, _, _, d, f, n in _CARDS])}) AS v(card, direction, figures, unknown)")
def card_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What cards are found to say that their rules and figures don't."""
    out = []
    for k, rule, said, iv, ks, *_ in _CARDS:
        t, card = tree.parse(rule), Card("name", said, "n", "n", "n", ["c"], [])
        out.append((k, ";".join(consistency.wrong_direction(card, t)), ";".join(consistency.wrong_figures(card, iv, ks)), ";".join(consistency.unknown_fields(card, t, METRICS))))
    return spark.createDataFrame(out, "card int, direction string, figures string, unknown string")


@_query("SELECT * FROM (VALUES (0, '1'), (1, '2'), (2, 'none')) AS v(reply, a)")
def json_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The object found in a model's reply."""
    out = []
    for k, reply in enumerate(('{"a": 1}', 'Here:\n```json\n{"a": 2}\n```', "no object")):
        try:
            out.append((k, str(json_of(reply)["a"])))
        except ValueError:
            out.append((k, "none"))
    return spark.createDataFrame(out, "reply int, a string")


@_query("""WITH d AS (SELECT doc_id AS id, lang, text FROM documents WHERE lang = 'en' OR lang IS NULL OR lang = 'all'), q AS (SELECT item_id AS id, text FROM benchmark)
SELECT count(*) > 0 AS found, coalesce(bool_and(lang IS NULL OR lang IN ('en', 'all')), TRUE) AS only_the_industry FROM d""")
def tfidf_industry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a query with an industry finds chunks of that industry, and no others."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.col("lang").alias("industry"))
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    hits = retriever.Retriever(docs).query(items, 3, industry="en").join(docs, "chunk_id")
    return hits.agg((F.count("*") > 0).alias("found"), F.coalesce(F.bool_and(F.col("industry").isNull() | F.col("industry").isin("en", "all")), F.lit(True)).alias("only_the_industry"))
