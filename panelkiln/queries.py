"""One query an operator over the driver's tables, with the SQL that gives the same rows.

The panel: suppliers by month, industry = the region of the supplier's nation, metrics = sums of the month's lines (as exact
decimals, so that the order of summation shows nowhere).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkiln.analysis import frontier
from panelkiln.functions import splits, stats
from panelkiln.functions.columns import rounded
from panelkiln.knowledge import corpus, retriever
from panelkiln.operators import Frame
from panelkiln.plans.compiler import evaluate, evaluate_wide
from panelkiln.sources import labels, panel
from panelkiln.sources.registry import Metric, Registry

METRICS = Registry(
    Metric(i, "lines", name, business, "day")
    for i, name, business in (("M1", "price", "金额"), ("M2", "quantity", "金额"), ("M3", "discount", "比率"), ("M4", "lines", "计数"), ("M5", "returns", "计数"), ("M6", "tax", "比率"))
)
_SUMS = {
    "M1": ("sum(cast(l_extendedprice AS DECIMAL(18,2)))", "sum(l_extendedprice::DECIMAL(18,2))"),
    "M2": ("sum(cast(l_quantity AS DECIMAL(18,2)))", "sum(l_quantity::DECIMAL(18,2))"),
    "M3": ("sum(cast(l_discount AS DECIMAL(18,2)))", "sum(l_discount::DECIMAL(18,2))"),
    "M4": ("count(*)", "count(*)"),
    "M5": ("sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)", "sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)"),
    "M6": ("sum(cast(l_tax AS DECIMAL(18,2)))", "sum(l_tax::DECIMAL(18,2))"),
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by month, one column a metric: aggregated before the suppliers are joined, the line items once. A supplier that is there n times counts n times, as in a join of the lines."""
    lines = _table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.last_day("l_shipdate").alias("observation_date")).agg(*[F.expr(s).alias(m) for m, (s, _) in _SUMS.items()])
    where = _table(spark, sf_dir, "supplier").join(_table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    where = where.groupBy("s_suppkey", "r_name").agg(F.count("*").alias("times"))
    df = lines.join(where, F.col("l_suppkey") == F.col("s_suppkey"))
    return df.select(F.col("l_suppkey").cast("string").alias("entity_id"), "observation_date", F.col("r_name").alias("industry"), *[(F.col(m) * F.col("times")).cast("double").alias(m) for m in _SUMS])


def long_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_panel(spark, sf_dir).unpivot(list(panel.KEYS), list(_SUMS), "metric_id", "value").select(*panel.KEYS, "metric_id", "value")


_WIDE = f"""w AS (SELECT l_suppkey::VARCHAR AS entity_id, last_day(l_shipdate)::DATE AS observation_date, r_name AS industry,
  {', '.join(f'({q})::DOUBLE AS {m}' for m, (_, q) in _SUMS.items())}
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)"""
_H = "PARTITION BY entity_id ORDER BY observation_date"
_G = "PARTITION BY industry, observation_date"


def _lag(x: str, n: int) -> str:
    return f"lag({x}, {n}) OVER ({_H})"


def _trail(n: int) -> str:
    return f"({_H} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _rank(x: str) -> str:
    return f"(CASE WHEN {x} IS NOT NULL THEN rank() OVER ({_G} ORDER BY {x} NULLS LAST) + (count(*) OVER ({_G}, {x}) - 1) / 2.0::DOUBLE END) / count(*) OVER ({_G})"


#: query: (expression, its SQL over w, decimals kept or None for results that aren't doubles)
EXPRESSIONS = {
    "delta": ("(Delta price 3)", f"M1 - {_lag('M1', 3)}", 6),
    "pct_change": ("(PctChange returns 1)", f"(M5 - {_lag('M5', 1)}) / {_lag('M5', 1)}", 6),
    "roll_mean": ("(Mean price 6)", f"avg(M1) OVER {_trail(6)}", 4),
    "roll_std": ("(Std price 6)", f"stddev_samp(M1) OVER {_trail(6)}", 3),
    "zscore": ("(ZScore quantity 6)", f"(M2 - avg(M2) OVER {_trail(6)}) / stddev_samp(M2) OVER {_trail(6)}", 6),
    "slope": ("(Slope price 4)", f"(M1 - {_lag('M1', 3)}) / 3.0::DOUBLE", 6),
    "ts_rank": ("(TsRank price 6)", f"len(list_filter(list(M1) OVER {_trail(6)}, lambda v: v <= M1)) / count(*) OVER {_trail(6)}", 6),
    "event_count": ("(Count (GT returns 1) 6)", f"sum((M5 > 1)::INT) OVER {_trail(6)}::BIGINT", None),
    "days_since": ("(DaysSince (GT returns 4))", f"(observation_date - max(CASE WHEN M5 > 4 THEN observation_date END) OVER ({_H} ROWS UNBOUNDED PRECEDING))::DOUBLE", None),
    "peer_rank": ("(PeerRank returns)", _rank("M5"), 6),
    "peer_deviation": ("(PeerDeviation price)", f"(M1 - avg(M1) OVER ({_G})) / stddev_samp(M1) OVER ({_G})", 6),
    "gt": ("(GT (PctChange returns 1) 0.3)", f"(M5 - {_lag('M5', 1)}) / {_lag('M5', 1)} > 0.3::DOUBLE", None),
    "lt": ("(LT price 200000)", "M1 < 200000", None),
    "and": ("(AND (GT returns 1) (LT price 200000))", "M5 > 1 AND M1 < 200000", None),
    "or": ("(OR (GT (Delta returns 1) 1) (LT price 100000))", f"M5 - {_lag('M5', 1)} > 1 OR M1 < 100000", None),
    "not": ("(NOT (GT (Delta returns 1) 0))", f"NOT (M5 - {_lag('M5', 1)} > 0)", None),
    "if_then_else": ("(IfThenElse (GT (Delta returns 1) 0) price quantity)", f"CASE WHEN M5 - {_lag('M5', 1)} > 0 THEN M1 ELSE M2 END", 6),
    "gt2": ("(Gt2 price (Mean price 3))", f"M1 > avg(M1) OVER {_trail(3)}", None),
    "lt2": ("(Lt2 returns (Delta lines 1))", f"M5 < M4 - {_lag('M4', 1)}", None),
    "ratio": ("(Ratio lines returns)", "CASE WHEN M5 = 0 THEN NULL ELSE M4 / M5 END", 6),
    "inconsistency": ("(Inconsistency returns lines)", "CASE WHEN abs(M5) + abs(M4) = 0 THEN 0 ELSE abs(M5 - M4) / ((abs(M5) + abs(M4)) / 2.0::DOUBLE) END", 6),
    "add": ("(Add price quantity)", "M1 + M2", 6),
    "subtract": ("(Subtract price quantity)", "M1 - M2", 6),
    "multiply": ("(Multiply discount tax)", "M3 * M6", 6),
    "min": ("(Min lines returns)", "least(M4, M5)", 6),
    "max": ("(Max (Delta lines 1) (Delta returns 1))", f"greatest(M4 - {_lag('M4', 1)}, M5 - {_lag('M5', 1)})", 6),
    "nested_windows": ("(Mean (Delta price 1) 3)", None, 4),
}


def _expression(text: str, digits: int | None):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = evaluate_wide(wide_panel(spark, sf_dir), {"value": text}, METRICS, Frame())
        return df if digits is None else df.withColumn("value", rounded(F.col("value"), digits))

    return query


def _expression_sql(sql: str, digits: int | None) -> str:
    value = sql if digits is None else f"round({sql}, {digits})"
    return f"WITH {_WIDE} SELECT entity_id, observation_date, industry, {value} AS value FROM w"


def panel_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = long_panel(spark, sf_dir).where(~((F.col("metric_id") == "M5") & (F.col("value") == 0)))
    return panel.to_wide(long, ["M1", "M5"], duplicates="max")


def panel_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the line items themselves, as a panel by supplier, day and part: several lines a cell are duplicates."""
    lines = _table(spark, sf_dir, "lineitem")
    long = lines.select(F.col("l_suppkey").cast("string").alias("entity_id"), F.to_date("l_shipdate").alias("observation_date"), F.lit("x").alias("industry"), F.lit("M1").alias("metric_id"), F.col("l_extendedprice").alias("value"))
    return panel.dirty_rows(long)


def expression_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the long panel: type check, pruning, duplicate check, pivot, compilation."""
    df = evaluate(long_panel(spark, sf_dir), "(Ratio (Delta price 1) (Mean price 12))", METRICS)
    return df.withColumn("value", rounded(F.col("value"), 6))


HORIZONS = (labels.Label("error_1d", 1, ("error",)), labels.Label("error_3d", 3, ("error",)), labels.Label("buy_2d", 2, ("purchase", "signup")))


def labels_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("entity_id"), F.to_date("ts").alias("event_date"), "event_type")
    return labels.build_labels(events, events.select(F.col("event_date").alias("observation_date")), HORIZONS).withColumn("label_value", F.col("label_value").cast("int"))


LABELS_SQL = """
WITH e AS (SELECT user_id::VARCHAR AS entity_id, ts::DATE AS d, event_type FROM events),
g AS (SELECT * FROM (SELECT DISTINCT entity_id FROM e), (SELECT DISTINCT d AS observation_date FROM e)),
l(label_name, days, kinds) AS (VALUES ('error_1d', 1, ['error']), ('error_3d', 3, ['error']), ('buy_2d', 2, ['purchase', 'signup']))
SELECT g.entity_id, g.observation_date, label_name, (count(e.d) > 0)::INT AS label_value
FROM g CROSS JOIN l LEFT JOIN e ON e.entity_id = g.entity_id AND e.d > g.observation_date AND e.d <= g.observation_date + l.days::INTEGER AND list_contains(kinds, e.event_type)
GROUP BY ALL
"""


def label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel's rows with the label `next month has more than two returns`."""
    w = wide_panel(spark, sf_dir)
    own = w.where("M5 > 2").select("entity_id", "observation_date", F.lit("busy").alias("label_name"), (F.col("M5") > 4).cast("int").alias("label_value"))
    return panel.join_labels(w.select("entity_id", "observation_date", "industry", "M1"), own, "busy")


def time_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = wide_panel(spark, sf_dir)
    return splits.with_split(w, splits.cuts(w)).groupBy("split").agg(F.count("*").alias("n"), F.min("observation_date").alias("first"), F.max("observation_date").alias("last"))


SPLIT_SQL = f"""WITH {_WIDE}, d AS (SELECT observation_date AS d, row_number() OVER (ORDER BY observation_date) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT observation_date FROM w)),
s AS (SELECT w.observation_date, CASE WHEN i <= floor(n * 0.6::DOUBLE) THEN 'train' WHEN i <= floor(n * 0.8::DOUBLE) THEN 'valid' ELSE 'oot' END AS split FROM w JOIN d ON d = observation_date)
SELECT split, count(*) AS n, min(observation_date) AS first, max(observation_date) AS last FROM s GROUP BY split"""


def lag_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = wide_panel(spark, sf_dir).select("entity_id", "observation_date", "M1", "M5")
    return splits.lag_features(w, ["M1", "M5"], 2)


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    return docs.join(_table(spark, sf_dir, "labels"), "doc_id")


_LABELLED = "r AS (SELECT n_chars::DOUBLE AS v, quality AS y, lang FROM documents JOIN labels USING (doc_id) WHERE n_chars IS NOT NULL AND quality IS NOT NULL)"


def _sql_bins(n: int, rows: str = "r", by: str = "") -> str:
    """edges: list of different quantiles of rows.v; b: rows with bin."""
    q = ", ".join(str(k / n) for k in range(n + 1))
    return f"q AS (SELECT list_sort(list_distinct(quantile_cont(v, [{q}]))) AS e FROM {rows})"


_BIN = "len(list_filter(e[2:len(e) - 1], lambda x: x <= v))"


def score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """iv, ks, gini, n, n_pos, trigger of the length of documents against quality."""
    out = stats.score(_labelled(spark, sf_dir), "n_chars", "quality")
    return out.select("n", "n_pos", *[rounded(F.col(c), 6).alias(c) for c in ("iv", "ks", "gini")], F.col("trigger").cast("double").alias("trigger"))


SCORE_SQL = f"""WITH {_LABELLED}, {_sql_bins(10)},
b AS (SELECT {_BIN} AS bin, count(*) FILTER (y <> 0) AS pos, count(*) FILTER (y = 0) AS neg FROM r, q GROUP BY 1),
t AS (SELECT count(*) AS n, count(*) FILTER (y <> 0) AS p, count(*) FILTER (y = 0) AS m FROM r),
i AS (SELECT sum(((pos + 0.5::DOUBLE) / (p + 1e-9) - (neg + 0.5::DOUBLE) / (m + 1e-9)) * ln(((pos + 0.5::DOUBLE) / (p + 1e-9)) / ((neg + 0.5::DOUBLE) / (m + 1e-9)))) AS iv FROM b, t),
d AS (SELECT v, count(*) FILTER (y <> 0) AS pos, count(*) FILTER (y = 0) AS neg FROM r GROUP BY v),
c AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn FROM d WINDOW w AS (ORDER BY v))
SELECT any_value(n) AS n, any_value(p) AS n_pos, round(any_value(iv), 6) AS iv, round(max(abs(cp / p - cn / m)), 6) AS ks,
  round(2 * sum(pos * (cn - neg + neg / 2)) / (any_value(p)::DOUBLE * any_value(m)) - 1, 6) AS gini, NULL::DOUBLE AS trigger FROM c, t, i"""


def score_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, a sample for each language in one job; 0/1 values (long or not), so two bins."""
    rows = _labelled(spark, sf_dir).withColumn("long", (F.col("n_chars") > 1500).cast("int"))
    out = stats.score(rows, "long", "quality", by=["lang"])
    return out.select("lang", "n", "n_pos", *[rounded(F.col(c), 6).alias(c) for c in ("iv", "ks", "gini", "trigger")])


SCORE_BY_SQL = f"""WITH {_LABELLED}, x AS (SELECT lang, (v > 1500)::INT AS v, y FROM r),
t AS (SELECT lang, count(*) AS n, count(*) FILTER (y <> 0) AS p, count(*) FILTER (y = 0) AS m, avg(v) AS trigger,
  count(*) FILTER (y <> 0 AND v = 0) AS p0, count(*) FILTER (y = 0 AND v = 0) AS m0 FROM x GROUP BY lang),
b AS (SELECT lang, v, count(*) FILTER (y <> 0) AS pos, count(*) FILTER (y = 0) AS neg FROM x GROUP BY lang, v),
i AS (SELECT lang, sum(((pos + 0.5::DOUBLE) / (p + 1e-9) - (neg + 0.5::DOUBLE) / (m + 1e-9)) * ln(((pos + 0.5::DOUBLE) / (p + 1e-9)) / ((neg + 0.5::DOUBLE) / (m + 1e-9)))) AS iv FROM b JOIN t USING (lang) GROUP BY lang)
SELECT lang, n, p AS n_pos, round(iv, 6) AS iv, CASE WHEN p = 0 OR m = 0 THEN 0 ELSE round(abs(p0 / p - m0 / m), 6) END AS ks,
  CASE WHEN p = 0 OR m = 0 THEN 0 ELSE round(2 * (p0 * (m0 / 2) + (p - p0) * (m0 + (m - m0) / 2)) / (p::DOUBLE * m) - 1, 6) END AS gini, round(trigger, 6) AS trigger FROM t JOIN i USING (lang)"""


def _two_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.where(F.col("lang").isin("en", "de")).select(F.col("n_chars").cast("double").alias("v"), F.when(F.col("lang") == "en", "expected").otherwise("actual").alias("side"))


def psi_kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.divergence(_two_sides(spark, sf_dir), "v", "side").select(rounded(F.col("psi"), 6).alias("psi"), rounded(F.col("kl"), 6).alias("kl"), "n_expected", "n_actual")


PSI_SQL = f"""WITH x AS (SELECT n_chars::DOUBLE AS v, lang FROM documents WHERE lang = 'en'), a AS (SELECT n_chars::DOUBLE AS v FROM documents WHERE lang = 'de'),
{_sql_bins(10, 'x')}, k AS (SELECT unnest(range(0, len(e) - 1)) AS bin FROM q),
p AS (SELECT k.bin, (SELECT count(*) FROM x, q WHERE {_BIN} = k.bin) + 1e-6 AS p, (SELECT count(*) FROM a, q WHERE v BETWEEN e[1] AND e[len(e)] AND {_BIN} = k.bin) + 1e-6 AS q FROM k),
n AS (SELECT p / sum(p) OVER () AS p, q / sum(q) OVER () AS q FROM p)
SELECT round(sum((p - q) * ln(p / q)), 6) AS psi, round(sum(p * ln(p / q)), 6) AS kl, (SELECT count(*) FROM x) AS n_expected, (SELECT count(*) FROM a) AS n_actual FROM n"""


def wasserstein(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.wasserstein(_two_sides(spark, sf_dir), "v", "side").select(rounded(F.col("wasserstein"), 4).alias("wasserstein"))


WASSERSTEIN_SQL = """WITH x AS (SELECT n_chars::DOUBLE AS v, count(*) FILTER (lang = 'en') AS e, count(*) FILTER (lang = 'de') AS a FROM documents WHERE lang IN ('en', 'de') GROUP BY 1),
c AS (SELECT lead(v) OVER w - v AS gap, sum(e) OVER w / sum(e) OVER () - sum(a) OVER w / sum(a) OVER () AS d FROM x WINDOW w AS (ORDER BY v))
SELECT round(sum(gap * abs(d)), 4) AS wasserstein FROM c"""


def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.spearman(wide_panel(spark, sf_dir), "M1", "M5", by=["industry"]).select("industry", rounded(F.col("spearman"), 6).alias("spearman"), "n")


SPEARMAN_SQL = f"""WITH {_WIDE}, k AS (SELECT industry, rank() OVER (PARTITION BY industry ORDER BY M1) + (count(*) OVER (PARTITION BY industry, M1) - 1) / 2 AS a,
  rank() OVER (PARTITION BY industry ORDER BY M5) + (count(*) OVER (PARTITION BY industry, M5) - 1) / 2 AS b FROM w)
SELECT industry, round(corr(a, b), 6) AS spearman, count(*) AS n FROM k GROUP BY industry"""


def monotonicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = wide_panel(spark, sf_dir).withColumn("y", (F.col("M5") > 2).cast("int"))
    return stats.monotonicity(w, "M1", "y", by=["industry"]).select("industry", rounded(F.col("monotonicity"), 6).alias("monotonicity"))


MONOTONICITY_SQL = f"""WITH {_WIDE}, q AS (SELECT industry, list_sort(list_distinct(quantile_cont(M1, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e FROM w GROUP BY industry),
b AS (SELECT industry, len(list_filter(e[2:len(e) - 1], lambda x: x <= M1)) AS bin, avg((M5 > 2)::INT) AS rate FROM w JOIN q USING (industry) GROUP BY ALL),
k AS (SELECT industry, rank() OVER (PARTITION BY industry ORDER BY bin) AS a, rank() OVER (PARTITION BY industry ORDER BY rate) + (count(*) OVER (PARTITION BY industry, rate) - 1) / 2 AS b FROM b)
SELECT industry, CASE WHEN count(*) < 5 OR stddev_pop(b) = 0 THEN 0 ELSE round(abs(corr(a, b)), 6) END AS monotonicity FROM k GROUP BY industry"""

def skyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that none beats in revenue, in few returns and in tax at once."""
    w = wide_panel(spark, sf_dir).groupBy("entity_id").agg(F.sum("M1").alias("a"), (-F.sum("M5")).alias("b"), F.sum("M6").alias("c"))
    rows = w.select("entity_id", F.array(rounded(F.col("a"), 2), "b", rounded(F.col("c"), 2)).alias("fitness"))
    front = frontier.skyline(rows)
    return front.select("entity_id", *[F.element_at("fitness", k + 1).alias(c) for k, c in enumerate("abc")])


SKYLINE_SQL = f"""WITH {_WIDE}, s AS (SELECT entity_id, round(sum(M1), 2) AS a, -sum(M5) AS b, round(sum(M6), 2) AS c FROM w GROUP BY entity_id)
SELECT * FROM s WHERE NOT EXISTS (FROM s o WHERE o.a >= s.a AND o.b >= s.b AND o.c >= s.c AND (o.a > s.a OR o.b > s.b OR o.c > s.c))"""


def md_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", corpus.plain(F.col("text")).alias("text"))


_MD = "coalesce(text, '')"
for _pattern, _stays in corpus.REWRITES:
    _MD = f"regexp_replace({_MD}, '{_pattern}', '{_stays.replace('$', chr(92))}', 'g')"
MD_SQL = f"SELECT doc_id, trim({_MD}) AS text FROM documents"


def chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as Markdown in which a line's first word, if capitalised, is a heading above the rest of it."""
    docs = _table(spark, sf_dir, "documents")
    marked = F.regexp_replace("text", "(?m)^([A-Z][a-z]+) ", "# $1\n")
    return corpus.to_chunks(docs.select("doc_id", F.col("lang").alias("industry"), marked.alias("text"))).select("chunk_id", "industry", F.array_join("headings", "/").alias("headings"), "text")


CHUNK_SQL = f"""WITH l AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
m AS (SELECT *, regexp_matches(line, '^[A-Z][a-z]+ ') AS h, sum(regexp_matches(line, '^[A-Z][a-z]+ ')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM l),
s AS (SELECT doc_id, any_value(lang) AS industry, g, coalesce(max(CASE WHEN h THEN regexp_extract(line, '^([A-Z][a-z]+) ', 1) END), '') AS headings,
  string_agg(regexp_replace(line, '^[A-Z][a-z]+ ', ''), chr(10) ORDER BY i) AS text FROM m GROUP BY doc_id, g),
b AS (SELECT doc_id, industry, g, headings, trim({_MD}) AS body FROM s),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS n FROM b WHERE body <> '')
SELECT doc_id || '#' || n AS chunk_id, industry, headings, trim(headings || ' ' || body) AS text FROM n"""


def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three documents nearest to each benchmark item."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.col("lang").alias("industry"))
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return retriever.Retriever(docs).query(items, 3).select("query_id", "chunk_id", rounded(F.col("score"), 6).alias("score"), "rank")


TFIDF_SQL = """WITH d AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'q', item_id, text FROM benchmark),
w AS (SELECT kind, id, ' ' || unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) || ' ' AS w FROM d),
c AS (SELECT kind, id, w, count(*) AS m FROM w GROUP BY ALL),
g AS (SELECT kind, id, m, unnest(list_transform(range(1, length(w) - n + 2), lambda i: substring(w, i, n))) AS gram FROM c, (VALUES (2), (3), (4)) AS t(n) WHERE length(w) >= n),
f AS (SELECT kind, id, gram, sum(m)::BIGINT AS tf FROM g GROUP BY ALL),
i AS (SELECT gram, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM f WHERE kind = 'd' GROUP BY gram),
x AS (SELECT kind, id, gram, tf * idf AS w FROM f JOIN i USING (gram)),
v AS (SELECT kind, id, gram, w / sqrt(sum(w * w) OVER (PARTITION BY kind, id)) AS w FROM x),
s AS (SELECT q.id AS query_id, d.id AS chunk_id, round(sum(q.w * d.w), 9) AS score FROM v q JOIN v d ON q.gram = d.gram AND q.kind = 'q' AND d.kind = 'd' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s WHERE score > 0)
SELECT query_id, chunk_id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 3"""


QUERIES = {name: _expression(text, digits) for name, (text, _, digits) in EXPRESSIONS.items()}
QUERIES |= {f.__name__: f for f in (panel_pivot, panel_duplicates, expression_long, labels_range_join, label_join, time_split, lag_features, score, score_by_language, psi_kl, wasserstein, spearman, monotonicity, skyline, md_strip, chunk, tfidf_topk)}
ORACLES = {name: _expression_sql(sql, digits) for name, (_, sql, digits) in EXPRESSIONS.items() if sql}
ORACLES |= {
    "nested_windows": f"WITH {_WIDE}, d AS (SELECT *, M1 - {_lag('M1', 1)} AS x FROM w) SELECT entity_id, observation_date, industry, round(avg(x) OVER {_trail(3)}, 4) AS value FROM d",
    "panel_pivot": f"WITH {_WIDE} SELECT entity_id, observation_date, industry, M1, nullif(M5, 0) AS M5 FROM w",
    "panel_duplicates": "SELECT l_suppkey::VARCHAR AS entity_id, l_shipdate::DATE AS observation_date, 'x' AS industry, 'M1' AS metric_id, l_extendedprice AS value FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_suppkey, l_shipdate::DATE) > 1",
    "expression_long": f"WITH {_WIDE} SELECT entity_id, observation_date, industry, round((M1 - {_lag('M1', 1)}) / nullif(avg(M1) OVER {_trail(12)}, 0), 6) AS value FROM w",
    "labels_range_join": LABELS_SQL,
    "label_join": f"WITH {_WIDE} SELECT entity_id, observation_date, industry, M1, (M5 > 4)::INT AS label FROM w WHERE M5 > 2",
    "time_split": SPLIT_SQL,
    "lag_features": f"WITH {_WIDE} SELECT entity_id, observation_date, {_lag('M1', 2)} AS M1, {_lag('M5', 2)} AS M5 FROM w",
    "score": SCORE_SQL,
    "score_by_language": SCORE_BY_SQL,
    "psi_kl": PSI_SQL,
    "wasserstein": WASSERSTEIN_SQL,
    "spearman": SPEARMAN_SQL,
    "monotonicity": MONOTONICITY_SQL,
    "skyline": SKYLINE_SQL,
    "md_strip": MD_SQL,
    "chunk": CHUNK_SQL,
    "tfidf_topk": TFIDF_SQL,
}


def _plain_dates(query):
    """Dates as text, so that both engines' results compare as they are."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        return df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date"})

    return run


def _plain_dates_sql(sql: str) -> str:
    found = [c for c in ("observation_date", "first", "last") if f"{c}," in sql.rpartition("SELECT")[2] or f"AS {c}" in sql.rpartition("SELECT")[2]]
    return f"SELECT * REPLACE ({', '.join(f'{c}::VARCHAR AS {c}' for c in found)}) FROM ({sql}) AS result" if found else sql


QUERIES = {name: _plain_dates(q) for name, q in QUERIES.items()}
ORACLES = {name: _plain_dates_sql(q) for name, q in ORACLES.items()}
