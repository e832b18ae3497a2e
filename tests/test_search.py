"""Search, ledger, fronts, retrieval, explanations, streams and the command line."""

import datetime as dt
import json
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkiln import cli
from panelkiln.analysis import frontier, reports
from panelkiln.explain import card, consistency, runner
from panelkiln.functions import splits, stats
from panelkiln.knowledge import corpus, retriever
from panelkiln.operators import Frame
from panelkiln.plans import tree
from panelkiln.plans.compiler import Compiler
from panelkiln.plans.typecheck import check
from panelkiln.plans.types import Kind
from panelkiln.search import coach, fitness, loop, nsga, variation
from panelkiln.search.primitives import NoTree, Primitives
from panelkiln.sources import ledger, panel, runs, synthetic
from panelkiln.sources.registry import Metric, Registry
from panelkiln.streaming import events

REG = Registry(synthetic.METRICS)
PRIMS = Primitives(REG)


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    return synthetic.generate(spark, str(tmp_path_factory.mktemp("data")), 60, 24, 42)


@pytest.fixture(scope="module")
def labelled(spark, data):
    wide = panel.to_wide(panel.read_long(spark, data[0]), [m.id for m in synthetic.METRICS])
    return panel.join_labels(wide, spark.read.parquet(data[1]), "Y_npl_12m")


# ---- trees by chance


def test_first_population_is_valid_and_different():
    rng = np.random.default_rng(0)
    trees = variation.ramped(PRIMS, 50, rng)
    assert len({tree.canonical(t) for t in trees}) == 50 and all(check(t, REG).kind == Kind.BOOL for t in trees)
    few = Primitives(Registry([Metric("T", "s", "t", "文本", "day")]))
    assert [m.id for m in few.unsupported] == ["T"]
    with pytest.raises(NoTree):
        variation.ramped(few, 3, rng)


def test_changes_stay_valid():
    rng = np.random.default_rng(1)
    trees = variation.ramped(PRIMS, 30, rng)
    changed = 0
    for a, b in zip(trees, trees[1:], strict=False):
        for t in (*variation.crossover(a, b, PRIMS, rng), variation.regrow(a, PRIMS, rng), variation.other_operator(a, PRIMS, rng), variation.other_literal(a, PRIMS, rng)):
            assert check(t, REG).kind == Kind.BOOL
            changed += t not in (a, b)
    assert changed > 40


def test_fronts_and_crowding():
    v = [(0.9, 0.1), (0.5, 0.5), (0.1, 0.9), (0.4, 0.4), (0, 0)]
    assert nsga.fronts(v) == [[0, 1, 2], [3], [4]] and nsga.fronts([]) == []
    assert nsga.dominates((1, 1), (1, 0)) and not nsga.dominates((1, 1), (1, 1))
    room = nsga.crowding(v[:3])
    assert room[0] == room[2] == float("inf") and room[1] == 2.0 and nsga.crowding(v[:2]) == [float("inf")] * 2
    assert nsga.tournament([3, 0, 2], [0, 0, 0], np.random.default_rng(0), 50) == 1


# ---- fitness


def test_batch_fitness_is_that_of_single_rules(spark, labelled):
    rules = [tree.parse(t) for t in ("(GT (PctChange 营业收入 1) -0.02)", "(GT 未结清不良类表内信贷余额 0)", "(Slope 营业收入 1)", "(GT 营业收入 -1.0)")]
    f = fitness.Fitness(labelled, REG, baselines=["FIN_0012"])
    try:
        got = f.of(rules)
        assert f.of(rules[:2]) == got[:2] and len(f.known) == 4
    finally:
        f.close()
    assert got[2] == fitness.INVALID
    oot = splits.with_split(labelled, splits.cuts(labelled))
    one = oot.select("split", "label", Compiler(REG, Frame(within=("split",))).column(rules[0]).cast("int").alias("v")).where("split = 'oot'")
    want = stats.score(one, "v", "label").collect()[0]
    assert got[0][:2] == pytest.approx((want["iv"], want["ks"])) and got[0][4] == -3 and got[0][2] == pytest.approx(1.0)
    assert got[0][3] == pytest.approx(stats.monotonicity(one, "v", "label").collect()[0][0]) and -1 <= got[0][5] <= 0


def test_two_values_are_scored_as_any(spark):
    """The driver's figures of 0/1 values against the general aggregations, a decile between the values included."""
    r = np.random.default_rng(3)
    for share in (0.1, 0.5, 0.93):
        rows = [(float(r.random() < share), int(r.random() < 0.4), "e" if r.random() < 0.5 else "a") for _ in range(101 if share == 0.5 else 150)]
        c = lambda v, y: float(sum(x[0] == v and x[1] == y and x[2] == "a" for x in rows))
        e = lambda v: float(sum(x[0] == v and x[2] == "e" for x in rows))
        got = fitness.of_two((c(0, 1), c(0, 0), e(0)), (c(1, 1), c(1, 0), e(1)))
        df = spark.createDataFrame(rows, "v double, y int, s string")
        late = df.where("s = 'a'")
        a, b = stats.score(late, "v", "y").collect()[0], stats.divergence(df.withColumn("side", F.when(F.col("s") == "e", "expected").otherwise("actual")), "v", "side").collect()[0]
        assert (got["n"], got["n_pos"]) == (a["n"], a["n_pos"])
        assert (got["iv"], got["ks"], got["psi"], got["monotonicity"]) == pytest.approx((a["iv"], a["ks"], b["psi"], stats.monotonicity(late, "v", "y").collect()[0][0]))


class Eager(loop.NeutralCoach):
    def seeds(self, *a):
        return [tree.parse("(GT 未结清不良类表内信贷余额 0)"), tree.parse("(GT nothing 0)")]

    def critique(self, trees):
        raise RuntimeError("down")


def test_search(labelled):
    f = fitness.Fitness(labelled, REG)
    try:
        got = loop.search(f, PRIMS, loop.Config(size=10, generations=2, seed=0), coach=Eager())
    finally:
        f.close()
    assert got.front and all(x.fitness != fitness.INVALID for x in got.front) and len(got.history) == 3
    best = [h["best_iv"] for h in got.history]
    assert best == sorted(best) and len({tree.canonical(x.tree) for x in got.population}) == len(got.population) == 10
    assert sum(loop.coverage(got.front, PRIMS).values()) >= len(got.front)


# ---- ledger and fronts


def some_result(scale=1.0):
    people = [loop.Individual(tree.parse(f"(GT 营业收入 {i}.0)"), tuple(scale * x for x in f), 0, float("inf")) for i, f in enumerate([(0.3, 0.1, 1, 0, -2, 0), (0.1, 0.3, 1, 0, -2, 0)])]
    return loop.Result(people, people, [{"generation": 0}])


def test_ledger_and_front(spark, tmp_path):
    path = str(tmp_path / "ledger")
    c = loop.Config()
    rows = [ledger.run_row(some_result(s), lab, ind, c, "sig", REG) for s, lab, ind in ((0.5, "Y1", None), (0.8, "Y2", "制造"))]
    ledger.append(spark, path, rows[:1])
    ledger.append(spark, path, rows[1:])
    df = ledger.read(spark, path)
    assert [r["label"] for r in df.collect()] == ["Y2", "Y1"] and {r["industry"] for r in df.collect()} == {"__none__", "制造"}
    assert ledger.read(spark, path, industry="制造").count() == 1 and ledger.read(spark, path, label="Y1").count() == 1 and ledger.read(spark, path, since="2999-01-01").count() == 0
    assert ledger.latest(spark, path, 1).collect()[0]["label"] == "Y2" and ledger.newer(df).count() == 0
    e = ledger.entries(df)
    assert e.count() == 4 and e.collect()[0]["crowding"] == float("inf")
    new, old = e.where("label = 'Y2'"), e.where("label = 'Y1'")
    got = frontier.expansion(old, new)
    assert got["existing_dominated"] == 0 and got["same_panel"]  # fewer leaves count for the weaker ones
    assert frontier.markdown(frontier.skyline(e).collect()).count("\n| ") == 6


def test_skyline_against_brute_force(spark):
    r = np.random.default_rng(2)
    v = np.round(r.random((300, 3)), 1).tolist() + [[1.0], [2.0], None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, fitness array<double>").repartition(6)
    got = sorted(x["i"] for x in frontier.skyline(df).collect())
    want = [i for i, x in enumerate(v) if x is None or not any(y and len(y) == len(x) and nsga.dominates(y, x) for y in v)]
    assert got == want
    assert frontier.dominated_by(df, frontier.skyline(df)).count() == len(v) - len(want)


def test_signature(spark):
    df = spark.range(20).withColumn("x", F.col("id") * 2)
    assert ledger.panel_signature(df) == ledger.panel_signature(df.repartition(3).select("x", "id")) != ledger.panel_signature(df.where("id > 0"))


# ---- knowledge

TEXT = "---\na: b\n---\nintro *one*\n# Top\n## Empty\n## Part [link](http://x)\n- item **bold** `code`\n1. two\n# Next\nlast\n"


def test_chunks(spark):
    df = spark.createDataFrame([("d", None, TEXT), ("e", "x", "no heading"), ("f", "x", "")], "doc_id string, industry string, text string")
    got = {r["chunk_id"]: (r["headings"], r["text"]) for r in corpus.to_chunks(df).collect()}
    assert got == {"d#0": ([], "intro one"), "d#1": (["Top", "Part [link](http://x)"], "Top Part [link](http://x) item bold code two"), "d#2": (["Next"], "Next last"), "e#0": ([], "no heading")}


def test_corpus_files_and_retrieval(spark, tmp_path):
    for name, text in (("industries/制造/a.md", "# 产能\n产能利用率 下降 风险"), ("industries/建筑/b.md", "# 工程\n工程 回款 风险"), ("common.md", "# 宏观\n宏观 利率 风险"), ("_skip.md", "# no\nno"), ("bad.md", None)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"\xff\xfe\xfa" if text is None else text.encode())
    chunks = corpus.read_corpus(spark, str(tmp_path))
    assert sorted((r["doc_id"], r["industry"]) for r in chunks.collect()) == [("a", "制造"), ("b", "建筑"), ("common", None)]
    q = spark.createDataFrame([(0, "工程 回款"), (1, "zzz")], "query_id long, query string")
    fit = retriever.Retriever(chunks)
    got = fit.query(q, 3).orderBy("rank").collect()
    assert got[0]["chunk_id"].startswith("b#") and {r["query_id"] for r in got} == {0}
    assert all(not r["chunk_id"].startswith("b#") for r in fit.query(q, 3, industry="制造").collect())


@pytest.mark.parametrize("most", [retriever.MOST_GRAMS, 10])
def test_retrieval_against_its_definition(spark, monkeypatch, most):
    """Both ways to multiply, blocks of two queries, odd characters, ties, repeated and NULL keys, and no join that lists n-grams of chunks."""
    monkeypatch.setattr(retriever, "MOST_GRAMS", most)
    monkeypatch.setattr(retriever, "BLOCK_QUERIES", 2)
    texts = [(1, "ab  abc\n\tabc a", "x"), (2, "ab abc abc a", None), (3, "\U0001f600\U0001f601 ab \0z", "x"), (4, "zq", "y"), (5, "", "x"), (6, None, "x"), (7, "abc", "y"), (7, "\U0001f600 zq", "y"), (None, "ab abc", "x")]
    asked = [(10, "abc a"), (11, "\U0001f600\U0001f601"), (12, "zq \0z"), (13, "nothing? 什么"), (14, " ")]

    def cut(t):
        words = [f" {w} " for w in (t or "").split()]
        return Counter(w[i : i + n] for w in words for n in (2, 3, 4) for i in range(len(w) - n + 1))

    chunks = {k: sum((cut(t) for j, t, _ in texts if j == k), Counter()) for k, _, _ in texts}
    df = Counter(g for c in chunks.values() for g in c)
    idf = {g: math.log((1 + len(texts)) / (1 + n)) + 1 for g, n in df.items()}
    unit = lambda c: {g: n * idf[g] / math.sqrt(sum((m * idf[h]) ** 2 for h, m in c.items() if h in idf)) for g, n in c.items() if g in idf}
    fit = retriever.Retriever(spark.createDataFrame(texts, "chunk_id long, text string, industry string").repartition(3))
    for industry in (None, "x"):
        want = {}
        for q, t in asked:
            v = unit(cut(t))
            near = sorted((-round(sum(w * unit(c).get(g, 0) for g, w in v.items()), 9), k) for k, c in chunks.items() if k is not None and (not industry or any(j == k and i in (None, industry) for j, _, i in texts)))
            want |= {(q, rank): (k, pytest.approx(-s, abs=2e-9)) for rank, (s, k) in enumerate(near[:3], 1) if s < 0}
        got = fit.query(spark.createDataFrame(asked, "query_id long, query string"), 3, industry=industry)
        assert {(r["query_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in got.collect()} == want
        assert most == 10 or "Generate" not in got._jdf.queryExecution().executedPlan().toString()


def test_grams(spark):
    df = spark.createDataFrame([("a bcd",), ("",)], "t string").select(retriever.grams(F.col("t")).alias("g"))
    assert [r["g"] for r in df.collect()] == [[" a", "a ", " a ", " b", "bc", "cd", "d ", " bc", "bcd", "cd ", " bcd", "bcd "], []]


# ---- explanations

CARD = {"metric_name_cn": "收入下滑", "business_explanation": "营业收入同比增长率 上升 时触发, IV=0.50", "use_cases": "u", "diff_vs_existing": "KS 0.20", "threshold_advice": "t", "review_checklist": ["x"], "referenced_fields": []}


def test_cards():
    assert card.json_of('said ```json\n{"a": {"b": 1}}\n``` end {') == {"a": {"b": 1}}
    with pytest.raises(ValueError):
        card.json_of("nothing {")
    for wrong in ({"metric_name_cn": "x" * 16}, {"review_checklist": []}, {"use_cases": 3}, {"review_checklist": ["x"] * 11}):
        with pytest.raises(card.CardError):
            card.card_of(CARD | wrong)


def test_consistency():
    c, t = card.card_of(CARD), tree.parse("(LT 营业收入 0)")
    assert consistency.unknown_fields(c, t, REG) == ["营业收入同比增长率"] and consistency.wrong_direction(c, t) and not consistency.wrong_direction(c, tree.parse("(GT 营业收入 0)"))
    assert len(consistency.wrong_figures(c, 0.1, 0.21)) == 1 and not consistency.wrong_figures(c, 0.49, 0.2)
    assert consistency.unknown_fields(card.card_of(CARD | {"referenced_fields": ["注册资本", "营业收入"]}), t, REG) == ["注册资本"]


def test_retries():
    class Flaky:
        n = 0

        def complete(self, system, user, max_tokens=0):
            self.n += 1
            if self.n < 3:
                raise card.Transient
            return "ok"

    waited = []
    assert card.Retrying(Flaky(), sleep=waited.append).complete("", "") == "ok" and waited == [1.0, 2.0]
    with pytest.raises(card.Transient):
        card.Retrying(Flaky(), retries=1, sleep=waited.append).complete("", "")


def test_reports_survive_bad_replies():
    cards = [(card.Explanation(card.card_of(CARD)), "(LT 营业收入 0)", None)]
    good = '{"industry_fit": 0.2, "drift_risk": 0.9, "spurious_risk": 0.1, "flags": ["f"]}'
    assert reports.suspicion(cards, card.Canned([good]))[0].composite == 0.9
    assert reports.suspicion(cards, card.Canned(["no"]))[0].flags == ["no_corpus", "llm_parse_failed"]
    assert reports.suspicion(cards, card.Canned(['{"industry_fit": 7, "drift_risk": 0, "spurious_risk": 0}']))[0].industry_fit == 0.5
    assert reports.suspicion(cards, None)[0].flags == ["no_corpus", "llm_failed"]
    r = reports.report(cards, [], card.Canned(['{"coverage_gaps": ["g"], "other": 1}']))
    assert r.coverage_gaps == ["g"] and "- g" in reports.report_markdown(r) and reports.report(cards, [], card.Canned(["?"])).raw == "?"
    assert "0.50" in reports.suspicion_markdown([reports.Verdict()], ["n"])


# ---- streams and the command line


def test_stream_counts(spark, tmp_path):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    rows = [("a", day(0), "npl"), ("a", day(1), "npl"), ("a", day(1), "other"), ("b", day(2), "npl"), ("a", day(60), "npl")]
    spark.createDataFrame(rows, "entity_id string, event_time timestamp, event_type string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("entity_id string, event_time timestamp, event_type string").parquet(str(tmp_path / "in"))
    q = events.start(events.windowed_counts(stream, ["npl"], "2 days", "2 days", "1 day"), str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    q.awaitTermination(120)
    got = {(r["entity_id"], r["window_start"].day): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert sum(got.values()) == 3


def test_command_line(spark, data, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "_session", lambda: spark)
    common = ["--panel", data[0], "--labels", data[1], "--label", "Y_npl_12m"]
    cli.main(["registry-list"])
    cli.main(["eval", "--expr", "(PctChange 营业收入 12)", *common, "--lag", "1", "--split", "oot"])
    out = capsys.readouterr().out
    assert "财务" in out and json.loads(out.strip().splitlines()[-1])["n"] > 0
    cli.main(["search", *common, "--size", "6", "--generations", "1", "--out", str(tmp_path / "runs"), "--ledger", str(tmp_path / "ledger")])
    (tmp_path / "rules.json").write_text('{"rules": ["(GT (PctChange 营业收入 3) 0.1)"]}', encoding="utf-8")
    cli.main(["search", *common, "--size", "4", "--generations", "1", "--across-splits", "--baselines", "营业收入", "--reply", str(tmp_path / "rules.json")])
    cli.main(["ledger-list", "--ledger", str(tmp_path / "ledger")])
    cli.main(["frontier", "--ledger", str(tmp_path / "ledger")])
    out = capsys.readouterr().out
    assert "# Frontier" in out and "Y_npl_12m" in out and (tmp_path / "runs/index.jsonl").exists()
    (tmp_path / "reply.json").write_text(json.dumps(CARD | {"coverage_gaps": ["gap"], "industry_fit": 0.1, "drift_risk": 0.2, "spurious_risk": 0.3}), encoding="utf-8")
    cli.main(["explain", "--expr", "(LT (PctChange 营业收入 12) 0.0)", *common, "--reply", str(tmp_path / "reply.json"), "--out", str(tmp_path / "cards")])
    saved = next((tmp_path / "cards").glob("*.json"))
    assert runs.load_card(str(saved))[1] == "(LT (PctChange 营业收入 12) 0.0)"
    (tmp_path / "kb").mkdir()
    (tmp_path / "kb/a.md").write_text("# 收入\n收入下滑", encoding="utf-8")
    cli.main(["report", "--cards", str(saved), "--reply", str(tmp_path / "reply.json")])
    cli.main(["suspect", "--cards", str(saved), "--reply", str(tmp_path / "reply.json"), "--corpus", str(tmp_path / "kb")])
    cli.main(["knowledge-build", "--corpus", str(tmp_path / "kb")])
    cli.main(["knowledge-query", "--corpus", str(tmp_path / "kb"), "--text", "收入"])
    out = capsys.readouterr().out
    assert "- gap" in out and "0.30" in out and "a#0" in out


def test_explain_scores_the_whole_panel(spark, data):
    client = card.Canned([json.dumps(CARD, ensure_ascii=False)])
    got = runner.explain(panel.read_long(spark, data[0]), spark.read.parquet(data[1]), "(LT (PctChange 营业收入 12) 0.0)", "Y_npl_12m", REG, client)
    assert "(LT (PctChange 营业收入 12) 0.0)" in client.asked[0][1] and any("direction" in w for w in got.warnings)


def test_model_coach_reads_what_it_can():
    rule = tree.parse("(GT 营业收入 1.0)")
    c = coach.ModelCoach(card.Canned(['{"rules": ["(GT 营业收入 1.0)", "(Nope", 3]}', '{"scores": [7]}', "?", '{"scores": [0.1, 0.2]}']))
    assert c.seeds("Y", None, [], [], 5) == [rule] and c.critique([rule]) == [1.0]
    assert c.cross_source({}, [], [], 5) == [] and c.critique([rule]) == [0.5] and coach.ModelCoach(None).critique([rule]) == [0.5]


def test_fronts_are_merged_over_partitions(spark):
    """Against comparing all with all, however many partitions there are; NULL, NaN and other lengths stay."""
    rng = np.random.default_rng(4)
    points = [[float(x) for x in rng.integers(0, 12, 3)] for _ in range(400)] + [None, [1.0, float("nan"), 2.0], [], [3.0]]
    best = [p for p in points if not p or len(p) != 3 or any(x != x for x in p) or not any(q and len(q) == 3 and nsga.dominates(q, p) for q in points if q and not any(x != x for x in q))]
    for parts in (1, 5, 40):
        got = frontier.skyline(spark.createDataFrame([(i, p) for i, p in enumerate(points)], "i int, fitness array<double>").repartition(parts)).collect()
        assert sorted(str(r["fitness"]) for r in got) == sorted(map(str, best))


def test_chat_client(monkeypatch):
    """The request it makes, what it takes for an answer, and which failures it tries again."""
    import io
    import json
    import urllib.error

    from panelkiln.explain import client
    from panelkiln.explain.card import Retrying

    asked, replies = [], [urllib.error.HTTPError("u", 429, "slow down", {}, None), urllib.error.URLError("gone"), io.BytesIO(b'{"choices": [{"message": {"content": "yes"}}]}')]

    def urlopen(request, timeout):
        asked.append((request.full_url, json.loads(request.data), request.get_header("Authorization")))
        reply = replies.pop(0)
        if isinstance(reply, Exception):
            raise reply
        return reply

    monkeypatch.setattr(client.urllib.request, "urlopen", urlopen)
    monkeypatch.setenv("PANELKILN_LLM_MODEL", "m")
    waits = []
    got = Retrying(client.ChatClient(url="http://x/v1/", key="k"), sleep=waits.append).complete("s", "u", 7)
    assert got == "yes" and waits == [1.0, 2.0] and len(asked) == 3
    assert asked[0][0] == "http://x/v1/chat/completions" and asked[0][1]["messages"][1] == {"role": "user", "content": "u"} and asked[0][1]["max_tokens"] == 7 and asked[0][2] == "Bearer k"
    replies.append(urllib.error.HTTPError("u", 401, "no", {}, None))
    with pytest.raises(urllib.error.HTTPError):
        Retrying(client.ChatClient(url="http://x", key="k"), sleep=waits.append).complete("s", "u")
    with pytest.raises(ValueError):
        client.ChatClient().complete("s", "u")
