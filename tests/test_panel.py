"""Panels, operators, expressions, labels, splits and statistics on small rows and against plain Python."""

import datetime as dt
import math
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelkiln import queries
from panelkiln.functions import relations, splits, stats
from panelkiln.operators import REGISTRY, Frame, operator
from panelkiln.plans import tree
from panelkiln.plans.compiler import Compiler, evaluate, evaluate_wide
from panelkiln.plans.typecheck import TypeCheckError, check
from panelkiln.plans.types import Kind
from panelkiln.sources import labels, panel, synthetic
from panelkiln.sources.registry import COLUMNS, Metric, Registry, read_registry

REG = Registry(
    [
        Metric("A", "s", "amt", "金额", "day", missing="distinguish"), Metric("B", "s", "amt2", "金额", "day"), Metric("C", "t", "cnt", "计数", "day"),
        Metric("R", "t", "rat", "比率", "day"), Metric("F", "t", "flag", "布尔", "day"), Metric("T", "t", "kind", "分类", "day"), Metric("N", "t", "two words", "金额", "day"),
    ]
)
NAN, INF = float("nan"), float("inf")


def series(spark, **columns):
    """One entity, months from January, a column a metric."""
    n = len(next(iter(columns.values())))
    rows = [("E", dt.date(2024, 1, 1) + dt.timedelta(days=30 * i), "x", *[None if c[i] is None else float(c[i]) for c in columns.values()]) for i in range(n)]
    return spark.createDataFrame(rows, "entity_id string, observation_date date, industry string, " + ", ".join(f"{k} double" for k in columns))


def value(df, text):
    return [r["value"] for r in evaluate_wide(df, {"value": text}, REG).orderBy("entity_id", "observation_date").collect()]


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert (g is None) == (w is None), (got, want)
        if w is not None:
            assert g == w or (w != w and g != g) or g == pytest.approx(w), (got, want)


@pytest.mark.parametrize(
    ("text", "x", "want"),
    [
        ("(PctChange amt 1)", [10] * 5, [None, 0, 0, 0, 0]),
        ("(PctChange amt 1)", [0, 0, 3, -3], [None, NAN, INF, -2]),
        ("(Delta amt 1)", [1, 2, 4, 7], [None, 1, 2, 3]),
        ("(Mean amt 3)", [1, 2, None, 4, 5], [1, 1.5, 1.5, 3, 4.5]),
        ("(Std amt 3)", [1, 2, 3, 3], [None, math.sqrt(0.5), 1, math.sqrt(1 / 3)]),
        ("(ZScore amt 3)", [5] * 3, [None, NAN, NAN]),
        ("(Slope amt 3)", [10, 20, 30, 40], [None, None, 10, 10]),
        ("(TsRank amt 3)", [3, 1, 2, None, 2], [1, 0.5, 2 / 3, 0, 2 / 3]),
        ("(Count (GT amt 1) 2)", [1, 2, 3, None], [0, 1, 2, 1]),
        ("(DaysSince (GT amt 1))", [1, 2, None, 0], [None, 0, 30, 60]),
        ("(GT (PctChange amt 1) 0.3)", [0, 5], [None, True]),
        ("(Mean (Delta amt 1) 2)", [1, 2, 4, 8], [None, 1, 1.5, 3]),
    ],
)
def test_windows(spark, text, x, want):
    same(value(series(spark, A=x), text), want)


def test_pct_change_rounds_and_counts_as_its_sql(spark, tmp_path):
    """Ties of the sixth decimal (-333/640), and a supplier that is there twice."""
    con = duckdb.connect()
    con.execute("CREATE TABLE region AS SELECT 0 AS r_regionkey, 'R' AS r_name; CREATE TABLE nation AS SELECT 0 AS n_nationkey, 'N' AS n_name, 0 AS n_regionkey")
    con.execute("CREATE TABLE supplier AS SELECT unnest([1, 2, 2])::BIGINT AS s_suppkey, 0 AS s_nationkey")
    con.execute("CREATE TABLE n AS SELECT unnest([640, 307, 640, 1281, 640, 963]) AS n, unnest(range(1, 7)) AS month")
    con.execute("""CREATE TABLE lineitem AS SELECT s.k AS l_suppkey, make_timestamp(2024, month, 3, 0, 0, 0) AS l_shipdate, 1.5::DOUBLE AS l_extendedprice, 2.0::DOUBLE AS l_quantity, 0.1::DOUBLE AS l_discount, 0.2::DOUBLE AS l_tax, 'R' AS l_returnflag
        FROM n, range(n) AS r(i), (VALUES (1::BIGINT), (2)) AS s(k)""")
    for t in ("region", "nation", "supplier", "lineitem"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    for q in ("pct_change", "add", "panel_pivot"):
        got = sorted(map(tuple, queries.QUERIES[q](spark, str(tmp_path)).collect()), key=str)
        assert got == sorted(con.execute(queries.ORACLES[q]).fetchall(), key=str)


def test_entities_and_splits_keep_apart(spark):
    df = series(spark, A=[1, 2]).union(series(spark, A=[100, 200]).withColumn("entity_id", F.lit("Z")))
    same(value(df, "(Delta amt 1)"), [None, 1, None, 100])
    df = df.withColumn("split", F.date_format("observation_date", "dd"))
    got = df.select(Compiler(REG, Frame(within=("split",))).column(tree.parse("(Delta amt 1)")).alias("v")).collect()
    assert all(r["v"] is None for r in got)


def test_peers(spark):
    rows = [(e, dt.date(2024, 1, 31), "x", v) for e, v in zip("abcde", [1.0, 2.0, 2.0, None, 4.0], strict=True)] + [("z", dt.date(2024, 1, 31), "y", 7.0)]
    df = spark.createDataFrame(rows, "entity_id string, observation_date date, industry string, A double")
    same(value(df, "(PeerRank amt)"), [0.2, 0.5, 0.5, None, 0.8, 1.0])
    x = np.array([1.0, 2, 2, 4])
    same(value(df, "(PeerDeviation amt)"), [*((x - x.mean()) / x.std(ddof=1))[:3], None, (4 - x.mean()) / x.std(ddof=1), None])


def test_logic_and_arithmetic(spark):
    df = series(spark, A=[10, None, 3, 0, 0], B=[4, 2, None, 0, 5], F=[1, 0, None, 0, 1])
    same(value(df, "(Subtract amt amt2)"), [6, None, None, 0, -5])
    same(value(df, "(Multiply amt amt2)"), [40, None, None, 0, 0])
    same(value(df, "(Add amt amt2)"), [14, None, None, 0, 5])
    same(value(df, "(Min amt amt2)"), [4, 2, 3, 0, 0])
    same(value(df, "(Max amt amt2)"), [10, 2, 3, 0, 5])
    same(value(df, "(Ratio amt amt2)"), [2.5, None, None, None, 0])
    same(value(df, "(Inconsistency amt amt2)"), [6 / 7, None, None, 0, 2])
    same(value(df, "(AND flag (GT amt 5))"), [True, False, False, False, False])
    same(value(df, "(OR flag (GT amt 5))"), [True, None, None, False, True])
    same(value(df, "(NOT flag)"), [False, True, None, True, False])
    same(value(df, "(IfThenElse flag amt amt2)"), [10, 2, None, 0, 0])
    same(value(df, "(Gt2 amt amt2)"), [True, None, None, False, False])
    same(value(df, "(Lt2 amt amt2)"), [False, None, None, False, True])
    same(value(df, "(LT amt 5)"), [False, None, True, True, True])


def test_inventory_of_operators():
    assert len(REGISTRY) == 28
    with pytest.raises(NotImplementedError):
        Compiler(REG).column(tree.parse("(AffilSum amt)"))
    with pytest.raises(ValueError):
        operator("Add", (Kind.NUMERIC,), Kind.NUMERIC)(lambda f, x: x)


def test_affiliates(spark):
    v = series(spark, A=[1]).union(series(spark, A=[5]).withColumn("entity_id", F.lit("Z")))
    e = spark.createDataFrame([("Q", "E"), ("Q", "Z"), ("Q", "Z"), ("E", "Z")], "src string, dst string")
    got = {r["entity_id"]: (r["affil_sum"], r["affil_has"]) for r in relations.over_affiliates(v, e, "A").collect()}
    assert got == {"Q": (6.0, True), "E": (5.0, True)}


# ---- language


@pytest.mark.parametrize("text", ["(GT (PctChange 营业收入 12) -0.1)", "amt", '(GT "a b" 1)', "(Add `two words` `12`)", "(Delta x 1e3)", "(GT x 2.0)"])
def test_text_and_json_round_trip(text):
    t = tree.parse(text)
    assert tree.parse(tree.to_text(t)) == t and tree.from_json(tree.to_json(t)) == t


@pytest.mark.parametrize(("text", "at"), [("", 0), ("(GT x", 0), (")", 0), ("x y", 2), ("(Nope x)", 1), ("()", 1), ('(GT "a', 4), ("(GT x 1) 2", 9)])
def test_parse_errors_say_where(text, at):
    with pytest.raises(tree.ParseError) as e:
        tree.parse(text)
    assert e.value.at == at


@given(st.recursive(st.one_of(st.integers(-99, 99).map(tree.Literal), st.floats(allow_nan=False, allow_infinity=False).map(tree.Literal), st.text("ab 1.-_é", min_size=1, max_size=6).map(tree.Field)), lambda t: st.tuples(st.sampled_from(["Add", "Min"]), t, t).map(lambda x: tree.Call(x[0], x[1:])), max_leaves=6))
@settings(max_examples=80, deadline=None)
def test_any_tree_round_trips(t):
    assert tree.parse(tree.to_text(t)) == t and tree.from_json(tree.to_json(t)) == t


def test_canonical_and_fields():
    assert tree.canonical(tree.parse("(GT x 2.0)")) == tree.canonical(tree.parse("(GT x 2)")) != tree.canonical(tree.parse("(GT x 2.5)"))
    t = tree.parse("(Add (Delta b 3) (Add a b))")
    assert tree.field_names(t) == ["b", "a"] and tree.leaf_count(t) == 4


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("(GT amt)", TypeCheckError), ("(GT amt amt2)", TypeCheckError), ("(AND amt flag)", TypeCheckError), ("(Delta amt 0)", TypeCheckError), ("(Delta amt -1.0)", TypeCheckError), ("(Delta amt 1.5)", TypeCheckError),
        ("(Mean kind 3)", TypeCheckError), ("(GT nope 1)", KeyError), *[(f"({op} amt cnt)", TypeCheckError) for op in ("Ratio", "Add", "Subtract", "Multiply", "Min", "Max", "Gt2")],
        ("(Mean (Mean (Mean (Mean (Mean amt 3) 3) 3) 3) 3)", TypeCheckError),
    ],
)
def test_rejected(text, error):
    with pytest.raises(error):
        check(tree.parse(text), REG)


def test_accepted():
    assert check(tree.parse("(Inconsistency amt cnt)"), REG).kind == Kind.RATIO
    assert check(tree.parse("(Ratio (Mean amt 3) cnt)"), REG).depth == 3
    assert check(tree.parse("(Lt2 amt 100)"), REG).warnings and check(tree.parse("(GT cnt 1)"), REG).leaves == 2


# ---- panels


def long_rows(spark, rows):
    return spark.createDataFrame([(e, dt.date(2025, 1, 31), "x", m, v) for e, m, v in rows], panel.SCHEMA)


def test_duplicates(spark, tmp_path, caplog):
    long = long_rows(spark, [("E1", "A", 100.0), ("E1", "A", 200.0), ("E2", "A", 300.0)])
    with pytest.raises(panel.DuplicateCells):
        panel.to_wide(long, ["A"])
    got = panel.to_wide(long, ["A", "B"], duplicates="warn", dirty_path=str(tmp_path / "dirty"))
    assert {r["entity_id"]: (r["A"], r["B"]) for r in got.collect()} == {"E1": (200.0, None), "E2": (300.0, None)}
    assert spark.read.parquet(str(tmp_path / "dirty")).count() == 2 and "duplicate" in caplog.text
    assert panel.to_wide(long, ["A"], duplicates="max").count() == 2


def test_write_contract(spark, tmp_path):
    with pytest.raises(ValueError, match="T"):
        panel.write_long(long_rows(spark, [("E", "T", 1.0)]), str(tmp_path / "p"), REG)
    with pytest.raises(ValueError, match="columns"):
        panel.write_long(long_rows(spark, [("E", "A", 1.0)]).drop("industry"), str(tmp_path / "p"), REG)
    panel.write_long(long_rows(spark, [("E", "A", 1.0), ("E", "unknown", 2.0)]), str(tmp_path / "p"), REG)
    df = panel.read_long(spark, str(tmp_path / "p"), ["A"])
    assert df.count() == 1 and "PushedFilters: [In(metric_id, [A])]" in df._jdf.queryExecution().toString().replace("EqualTo(metric_id,A)", "In(metric_id, [A])").replace("IsNotNull(metric_id), ", "")


def test_evaluate_reads_only_what_it_needs(spark):
    long = long_rows(spark, [("E", "A", 4.0), ("E", "B", 2.0), ("E", "C", 1.0), ("E", "C", 1.0)])
    assert evaluate(long, "(Ratio amt amt2)", REG).collect()[0]["value"] == 2.0
    with pytest.raises(ValueError, match="lacks"):
        evaluate_wide(series(spark, A=[1]), {"v": "(Add amt amt2)"}, REG)


def test_registry_file(tmp_path):
    head = ",".join(COLUMNS)
    (tmp_path / "m.csv").write_text(f'﻿{head}\nX1,财务,收入,金额,季,q,"[0, 1)",tag,无记录、0值和缺失需区分\nX2,财务,收入,计数,日,,,,?\n', encoding="utf-8")
    r = read_registry(tmp_path / "m.csv")
    assert len(r) == 2 and r.resolve("收入").id == "X1" and r.resolve("X2").missing == "other" and r.by_id["X1"].range == "[0, 1)" and r.source_counts() == {"财务": 2}
    with pytest.raises(KeyError):
        r.resolve("no")
    with pytest.raises(ValueError):
        Registry([*r, *r])
    (tmp_path / "bad.csv").write_text(f"{head}\nX1,s,n,what,季,,,,\n", encoding="utf-8")
    with pytest.raises(ValueError, match="X1"):
        read_registry(tmp_path / "bad.csv")


def test_labels(spark):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    ev = spark.createDataFrame([("a", day(10), "overdue30"), ("a", day(103), "overdue30"), ("b", day(5), "npl"), ("b", day(5), "npl"), ("c", None, "npl")], "entity_id string, event_date date, event_type string")
    dates = spark.createDataFrame([(day(n),) for n in (0, 10, 11)], "observation_date date")
    got = {(r["entity_id"], r["observation_date"], r["label_name"]): r["label_value"] for r in labels.build_labels(ev, dates).collect()}
    assert len(got) == 3 * 3 * 4
    assert [got["a", day(n), "Y_overdue_3m"] for n in (0, 10, 11)] == [1, 1, 1] and got["b", day(0), "Y_npl_12m"] == 1 and got["b", day(10), "Y_npl_12m"] == 0
    assert got["a", day(0), "Y_npl_12m"] == 0 and got["c", day(0), "Y_npl_12m"] == 0
    ev2 = ev.where("event_date = date'2024-04-13'")
    assert [r["label_value"] for r in labels.build_labels(ev2, dates).where("label_name = 'Y_overdue_3m'").orderBy("observation_date").collect()] == [0, 1, 1]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10])
def test_splits(spark, n):
    df = series(spark, A=list(range(max(n, 1)))).limit(n)
    if n < 3:
        with pytest.raises(ValueError):
            splits.time_split(df)
        return
    a, b, c, cuts = splits.time_split(df)
    assert [a.count(), b.count(), c.count()] == {3: [1, 1, 1], 10: [6, 2, 2]}[n] and cuts.train < cuts.valid < cuts.oot
    assert [r["A"] for r in splits.lag_features(df, ["A"], 1).orderBy("observation_date").collect()][:2] == [None, 0.0]
    with pytest.raises(ValueError):
        splits.cuts(df, 0.7, 0.3)


# ---- statistics


def frame(spark, **columns):
    keys = list(columns)
    return spark.createDataFrame([tuple(None if x is None else float(x) for x in r) for r in zip(*columns.values(), strict=True)], ", ".join(f"{k} double" for k in keys))


def plain_score(v, y, bins=10):
    v, y = np.array(v, float), np.array(y)
    ok = np.isfinite(v)
    v, y = v[ok], y[ok]
    p, n = (y == 1).sum(), (y == 0).sum()
    if set(np.unique(v)) <= {0.0, 1.0}:
        where = v.astype(int)
    else:
        where = np.digitize(v, np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)))[1:-1])
    iv = 0.0
    for b in np.unique(where):
        a, c = ((where == b) & (y == 1)).sum(), ((where == b) & (y == 0)).sum()
        a, c = (a + 0.5) / (p + 1e-9), (c + 0.5) / (n + 1e-9)
        iv += (a - c) * math.log(a / c)
    cuts = np.unique(v)
    ks = max(abs((v[y == 1] <= x).mean() - (v[y == 0] <= x).mean()) for x in cuts)
    wins = sum((v[y == 0] < x).sum() + 0.5 * (v[y == 0] == x).sum() for x in v[y == 1])
    return iv, ks, 2 * wins / (p * n) - 1


@pytest.mark.parametrize("kind", ["normal", "ties", "binary", "wide"])
def test_score(spark, kind):
    r = np.random.default_rng(0)
    y = (r.random(600) < 0.5).astype(int)
    v = {"normal": r.normal(0.8 * y), "ties": np.round(r.normal(0.8 * y)), "binary": (r.random(600) < 0.3 + 0.3 * y).astype(float), "wide": np.sign(r.normal(size=600)) * 10.0 ** r.uniform(-9, 9, 600)}[kind]
    v = [None, NAN, INF, *v]
    y = [1, 0, 1, *y]
    got = stats.score(frame(spark, v=v, y=y), "v", "y").collect()[0]
    assert (got["iv"], got["ks"], got["gini"]) == pytest.approx(plain_score([NAN if x is None else x for x in v], y))
    assert got["n"] == 600 and (got["trigger"] is not None) == (kind == "binary")


def test_score_of_odd_samples(spark):
    got = stats.score(frame(spark, v=[1, 2, 3], y=[1, 1, 1]), "v", "y").collect()[0]
    assert got["ks"] == 0 and got["gini"] == 0
    assert stats.score(frame(spark, v=[1.0], y=[1]).limit(0), "v", "y").count() == 0
    same_ = stats.score(frame(spark, v=[7] * 9, y=[1, 0] * 4 + [1]), "v", "y").collect()[0]
    assert same_["ks"] == 0 and same_["gini"] == 0 and abs(same_["iv"]) < 0.1
    noise = np.random.default_rng(1)
    assert stats.score(frame(spark, v=noise.normal(size=2000), y=noise.integers(0, 2, 2000)), "v", "y").collect()[0]["iv"] < 0.05


def two(spark, e, a):
    return frame(spark, v=[*e, *a], s=[0] * len(e) + [1] * len(a)).withColumn("side", F.when(F.col("s") == 0, "expected").otherwise("actual"))


def plain_divergence(e, a):
    edges = np.unique(np.quantile(e, np.linspace(0, 1, 11)))
    if len(edges) < 3:
        return 0.0, 0.0
    p, q = (np.histogram(x, edges)[0] + 1e-6 for x in (e, a))
    p, q = p / p.sum(), q / q.sum()
    return float(((p - q) * np.log(p / q)).sum()), float((p * np.log(p / q)).sum())


def test_divergence_and_distance(spark):
    r = np.random.default_rng(3)
    for e, a in ((r.normal(size=500), r.normal(size=400)), (r.normal(size=500), r.normal(2, 1, 400)), (r.integers(0, 4, 90).astype(float), r.integers(0, 6, 70).astype(float)), (np.array([0.0, 1] * 20), np.array([0.0, 1, 1] * 20))):
        got = stats.divergence(two(spark, e, a), "v", "side").collect()[0]
        assert (got["psi"], got["kl"]) == pytest.approx(plain_divergence(e, a), abs=1e-9)
        xs = np.sort(np.concatenate([e, a]))
        area = sum((y - x) * abs((e <= x).mean() - (a <= x).mean()) for x, y in zip(xs, xs[1:], strict=False))
        assert stats.wasserstein(two(spark, e, a), "v", "side").collect()[0][0] == pytest.approx(area)
    empty = stats.divergence(two(spark, [1, 2, 3], []), "v", "side").collect()[0]
    assert math.isnan(empty["psi"]) and math.isnan(stats.wasserstein(two(spark, [1, 2], []), "v", "side").collect()[0][0])
    assert stats.wasserstein(two(spark, [1, 2, 9], [9, 2, 1]), "v", "side").collect()[0][0] == 0


def rank(x):
    x = np.array(x)
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def test_rank_statistics(spark):
    r = np.random.default_rng(4)
    x = np.round(r.normal(size=200), 1)
    y = np.round(x + r.normal(size=200), 1)
    assert stats.spearman(frame(spark, x=x, y=y), "x", "y").collect()[0]["spearman"] == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])
    assert stats.spearman(frame(spark, x=[1] * 9, y=range(9)), "x", "y").collect()[0]["spearman"] == 0
    assert stats.spearman(frame(spark, x=[1, 2], y=[1, 2]), "x", "y").collect()[0]["spearman"] == 0
    late = (r.random(400) < np.linspace(0, 1, 400)).astype(int)
    assert stats.monotonicity(frame(spark, v=range(400), y=late), "v", "y").collect()[0]["monotonicity"] == pytest.approx(1)
    assert stats.monotonicity(frame(spark, v=[0, 0, 1, 1], y=[0, 1, 1, 1]), "v", "y").collect()[0]["monotonicity"] == pytest.approx(0.5)
    assert stats.monotonicity(frame(spark, v=[1, 2, 3] * 20, y=[0, 1, 1] * 20), "v", "y").collect()[0]["monotonicity"] == 0


def test_bands_keep_the_order(spark):
    r = random.Random(1)
    v = sorted([0.0, -0.0, 1e-300, -1e-300, 1e300, 1.0, 1.0000001, 2.0, -2.0] + [r.choice([-1, 1]) * 10 ** r.uniform(-20, 20) for _ in range(500)])
    got = [x["b"] for x in frame(spark, v=v).select(stats.band(F.col("v")).alias("b"), "v").orderBy("v").collect()]
    assert got == sorted(got)


# ---- the made-up panel, end to end


def test_signal_is_found(spark, tmp_path):
    p, lab = synthetic.generate(spark, str(tmp_path), 120, 24, 42)
    long, y = panel.read_long(spark, p), spark.read.parquet(lab)
    assert long.count() == 120 * 24 * 10 and y.select("label_name").distinct().count() == 4
    reg = Registry(synthetic.METRICS)
    got = stats.score(panel.join_labels(evaluate(long, "(PctChange 营业收入 12)", reg), y, "Y_overdue_3m"), "value", "label").collect()[0]
    assert got["iv"] >= 0.1 and got["ks"] >= 0.15
    got = stats.score(panel.join_labels(evaluate(long, "(Count (GT 近一年被执行案件数量 0) 6)", reg), y, "Y_npl_12m"), "value", "label").collect()[0]
    assert got["iv"] >= 0.05
    with pytest.raises(ValueError):
        synthetic.generate_wide(spark, 10, 22)
