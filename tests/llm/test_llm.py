"""The training-data operators against brute force, round trips and planted cases."""

import hashlib
import json
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from panelkiln.llm import chat_format, common, gru_lm, license_scan, line_dedup, mixing, page_text, quality_rules, sentencepiece_sampling, simhash, telephony

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and tion ber ment qui para osta schön ehre nicht für élan naïve 日本 cat dog tree house river stone bread".split()


def made_up(n, seed=1, least=60, most=120):
    r = random.Random(seed)
    return [" ".join(r.choice(WORDS) + str(r.randrange(300)) for _ in range(r.randrange(least, most))).replace(" tree", "\ntree") for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """NULLs in every column, empty and very long texts, repeated rows and ids."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, None, "en", "a", 0), (None, "one two three", None, None, None), (3, "", "en", "b", 0), (4, long, "en", "a", 1), (5, "same text here ok", "en", "a", 1), (5, "same text here ok", "en", "a", 1), (6, "\n\n \t\n", None, "b", 2)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def stored(df, tmp_path):
    df.write.parquet(str(tmp_path / "t"))
    return df.sparkSession.read.parquet(str(tmp_path / "t"))


# ---- 1


def test_pieces_round_trip_and_reproducible(spark, odd, none):
    got = sentencepiece_sampling.encode(odd)
    rows = got.collect()
    assert len(rows) == odd.count() and all(r["lossless"] for r in rows)
    texts = Counter(r["text"] for r in sentencepiece_sampling.decode(got).collect())
    assert texts == Counter((r["text"] or "") for r in odd.collect())
    again = sentencepiece_sampling.encode(odd.repartition(5)).collect()
    assert Counter(map(str, rows)) == Counter(map(str, again))
    assert sentencepiece_sampling.encode(none).count() == 0


def test_pieces_in_chunks_of_any_size(spark):
    """What else is in a chunk or partition changes nothing."""
    p = sentencepiece_sampling.pieces(sentencepiece_sampling.MODEL, 1.0)
    texts = [t.replace(" ber", "    ber") for t in made_up(200, 6)]
    keys = [f"k{i}" for i in range(200)]
    def split(t, k):
        ids, n = sentencepiece_sampling.encode_all(t, k, p)
        return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    whole = split(texts, keys)
    for size in (1, 20):
        assert [x for i in range(0, 200, size) for x in split(texts[i : i + size], keys[i : i + size])] == whole
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one, many = ({x["doc_id"]: x["ids"] for x in sentencepiece_sampling.encode(df.repartition(n)).collect()} for n in (1, 7))
    assert one == many == dict(enumerate(whole))
    assert any(p.bytes[i] == b"   " for x in whole for i in x)  # runs of spaces are pieces too


@pytest.mark.parametrize("text", ["▁ ▁▁", "a\u0000b", "  two  spaces \n\n x", "😀日本語テキスト", "é ​", "\n", " ", "x" * 5000])
def test_pieces_of_hard_texts(text):
    p = sentencepiece_sampling.pieces(sentencepiece_sampling.MODEL, 1.0)
    ids, n = sentencepiece_sampling.encode_all([text, "plain"], ["k1", "k2"], p)
    assert sentencepiece_sampling.decode_ids(ids[: n[0]].tolist(), p) == text.encode()


def test_sampling_follows_the_lattice():
    """Sampled segmentations of a word against all of its segmentations and their weights."""
    p = sentencepiece_sampling.pieces(sentencepiece_sampling.MODEL, 1.0)
    known = {}
    for n, (_, _, ids, cps, logs) in p.by_len.items():
        for i, c, w in zip(ids, cps, logs, strict=True):
            known["".join(map(chr, c[:n]))] = (int(i), float(w))
    word = " there"
    def every(s):
        if not s:
            yield (), 0.0
        for k in range(1, len(s) + 1):
            if s[:k] in known:
                for rest, w in every(s[k:]):
                    yield (known[s[:k]][0], *rest), w + known[s[:k]][1]
    weights = {seg: np.exp(w) for seg, w in every(word)}
    total = sum(weights.values())
    n = 6000
    ids, size = sentencepiece_sampling.encode_all(["there"] * n, [f"k{i}" for i in range(n)], p)
    found = Counter(tuple(x.tolist()) for x in np.split(ids, np.cumsum(size)[:-1]))
    assert set(found) <= set(weights)
    for seg, w in weights.items():
        assert abs(found[seg] / n - w / total) < 0.03
    assert len(found) > 1


# ---- 2


def brute_base(rows, folds=7, held=2):
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or "")) + ["\n"]
    train = Counter()
    for k, t in rows:
        if zlib.crc32(("" if k is None else str(k)).encode()) % folds != held:
            train.update(tokens(t))
    n, v = sum(train.values()), len(train)
    for k, t in rows:
        w = tokens(t)
        yield k, len(w), sum(train[x] > 0 for x in w), n, sum(np.log10((train[x] + 1) / (n + v + 1)) for x in w)


SMALL = gru_lm.Settings(vocab=64, per_class=16, hidden=8, head=100, segment=16, chunk=5000, streams=16, train_streams=8)


def test_lm_base_counts_and_learning(spark, odd):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice([["red", "sky"], ["blue", "sea"], ["rare%d" % r.randrange(400)]])[0] for _ in range(50)) + " Tail Ähre") for i in range(150)]
    rows = [(i, " ".join(x for _ in range(20) for x in (("red", "sky") if r.random() < 0.5 else ("blue", "sea"))) + f" rare{r.randrange(400)}") for i, _ in rows]
    rows += [(x["doc_id"], x["text"]) for x in odd.collect()]
    got = gru_lm.score(spark.createDataFrame(rows, "doc_id long, text string"), settings=SMALL).collect()
    want = sorted((str(k), n, known, total, round(base, 6)) for k, n, known, total, base in brute_base(rows))
    assert sorted((str(x["doc_id"]), x["n_tokens"], x["n_known"], x["train_tokens"], round(x["base_score"], 6)) for x in got) == want
    got = gru_lm.score(spark.createDataFrame(rows[:150], "doc_id long, text string"), settings=SMALL).collect()
    held = [x for x in got if x["held_out"]]
    assert len(held) > 10 and sum(x["score"] for x in held) > sum(x["base_score"] for x in held)


def test_lm_is_a_distribution():
    """Over all words of the vocabulary and the class of the others, probabilities sum to one in any state."""
    m = gru_lm.Model(SMALL, [(b"w%d" % i, 100 - i) for i in range(80)], 6000, 500)
    m.set_counts(50)
    rare = m.n_classes * SMALL.per_class
    h = np.random.default_rng(0).normal(size=(3, SMALL.hidden)).astype(np.float32)
    for state in h:
        ys = np.array([*range(len(m.words)), rare], np.int32)
        lp, _ = gru_lm.output_logp(m.p, SMALL, np.repeat(state[None], len(ys), 0), ys)
        assert abs(np.exp(lp.astype(float)).sum() - 1) < 1e-4


def test_lm_gradients_against_differences():
    m = gru_lm.Model(SMALL, [(b"w%d" % i, 100 - i) for i in range(40)], 6000, 500)
    m.set_counts(50)
    p = {k: (v.astype(np.float64) if k != "bo" else v.astype(np.float64)) for k, v in m.p.items()}
    r = np.random.default_rng(1)
    p["wo"] += r.normal(0, 0.1, p["wo"].shape)
    p["wc"] += r.normal(0, 0.1, p["wc"].shape)
    x = r.integers(0, 41, (5, 3))
    y = np.where(x >= len(m.words), m.n_classes * SMALL.per_class, x)
    h = r.normal(0, 0.3, (3, SMALL.hidden))
    _, _, grad = gru_lm.train_window(p, SMALL, x, y, h)
    for k in ("wh", "wx", "b", "wc", "bc"):
        for at in [tuple(r.integers(0, n) for n in p[k].shape) for _ in range(4)]:
            old = p[k][at]
            p[k][at] = old + 1e-5
            up = gru_lm.train_window(p, SMALL, x, y, h)[0]
            p[k][at] = old - 1e-5
            down = gru_lm.train_window(p, SMALL, x, y, h)[0]
            p[k][at] = old
            assert abs((up - down) / 2e-5 - grad[k][at]) < 1e-4


def test_lm_state_is_carried_over_windows_and_streams():
    m = gru_lm.Model(SMALL, [(b"w%d" % i, 100 - i) for i in range(40)], 6000, 500)
    m.set_counts(50)
    r = np.random.default_rng(2)
    m.p["wc"] += r.normal(0, 0.3, m.p["wc"].shape).astype(np.float32)
    seqs = [r.integers(0, 41, n).astype(np.int32) for n in (700, 1, 3, 90, 41, 41, 5)] * 6
    got = gru_lm.state_logp(m, seqs)
    for s, g in zip(seqs, got, strict=True):
        h, prev, total = np.zeros((1, SMALL.hidden), np.float32), 0, 0.0
        gates = m.p["emb"] @ m.p["wx"] + m.p["b"]
        for t in s:
            h = gru_lm._step(gates[[prev]], h, m.p["wh"], SMALL.hidden)[0]
            y = np.array([t if t < len(m.words) else m.n_classes * SMALL.per_class])
            total += gru_lm.output_logp(m.p, SMALL, h, y)[0][0]
            prev = t
        assert abs(total / np.log(10) - g) < 1e-2 + 1e-4 * abs(g)


def test_lm_learns_every_token_once_in_order():
    """Windows hold all tokens of all texts, a text's in order in one stream, but for the last ones, which are dealt out in segments."""
    r = np.random.default_rng(3)
    texts = [np.arange(1, n + 1, dtype=np.int32) + 1000 * i for i, n in enumerate(r.integers(1, 200, 60))] + [np.arange(1, 900, dtype=np.int32) + 1_000_000]
    seen, breaks = Counter(), 0
    last = np.full(SMALL.train_streams, -1)
    for x, fresh, real in gru_lm.windows(SMALL, texts):
        for t in range(len(x)):
            for j in np.nonzero(real[t])[0]:
                seen[int(x[t, j])] += 1
                if x[t, j] != last[j] + 1:
                    assert fresh[t, j]
                    breaks += x[t, j] % 1000 != 1
                last[j] = x[t, j]
    assert seen == Counter(int(v) for t in texts for v in t) and 0 < breaks <= 900 // SMALL.segment + 2 * SMALL.train_streams


def test_lm_gradients_with_texts_that_begin_and_end():
    m = gru_lm.Model(SMALL, [(b"w%d" % i, 100 - i) for i in range(40)], 6000, 500)
    m.set_counts(50)
    r = np.random.default_rng(1)
    p = {k: v.astype(np.float64) + (r.normal(0, 0.1, v.shape) if k != "bo" else 0) for k, v in m.p.items()}
    x, y, h = r.integers(0, 41, (6, 3)), r.integers(0, 41, (6, 3)), r.normal(0, 0.3, (3, SMALL.hidden)).astype(np.float32)
    fresh, real = np.zeros((6, 3), bool), np.ones((6, 3), bool)
    fresh[2, 0] = fresh[0, 1] = True
    real[4:, 2] = False
    _, _, grad = gru_lm.train_window(p, SMALL, x, y, h, fresh, real)
    for k in ("wh", "wx", "b", "emb", "wc"):
        for at in [tuple(r.integers(0, n) for n in p[k].shape) for _ in range(4)]:
            old, loss = p[k][at], []
            for d in (1e-3, -1e-3):
                p[k][at] = old + d
                loss.append(gru_lm.train_window(p, SMALL, x, y, h, fresh, real)[0])
            p[k][at] = old
            assert abs((loss[0] - loss[1]) / 2e-3 - grad[k][at]) < 1e-3


def test_lm_empty(none):
    assert gru_lm.score(none, settings=SMALL).count() == 0


# ---- 3


def test_quality_on_odd_rows(odd, none):
    q = {r["doc_id"]: r["quality"] for r in quality_rules.judge(odd).collect()}
    assert not q[1]["kept"] and q[1]["n_words"] == 0 and q[1]["base_failed"]
    assert q[4]["n_words"] == 30_000 and q[4]["n_repeat_words"] == 30_000 and q[4]["base_failed"]
    assert quality_rules.judge(odd).count() == odd.count() and quality_rules.keep(none).count() == 0


def test_quality_order_changes_no_verdict(spark):
    texts = made_up(30) + ["### $$$ " * 60, "a b " * 20 + " ".join(f"word{i}" for i in range(60)), "LOUD" + " WORDS%d" * 1 % 3 + " ".join(f"SHOUT{chr(65 + i % 26)}{chr(65 + i // 26)}" for i in range(90))]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    one = {r["doc_id"]: r["v"] for r in df.select("doc_id", quality_rules.rejected_by(F.col("text"), quality_rules.RULES).isNull().alias("v")).collect()}
    two = {r["doc_id"]: r["v"] for r in df.select("doc_id", quality_rules.rejected_by(F.col("text"), quality_rules.RULES[::-1]).isNull().alias("v")).collect()}
    assert one == two and all(one[i] for i in range(30)) and not one[30]
    assert [x["selectivity"] for x in quality_rules.ordered(df)] and set(df.columns) == set(quality_rules.keep(df).columns)


# ---- 4


def test_telephony(odd, none):
    stored_ = telephony.store(odd)
    rows = telephony.expand(stored_).collect()
    assert len(rows) == odd.count()
    by = defaultdict(list)
    for r, media in zip(rows, stored_.collect(), strict=True):
        by[r["doc_id"]].append(r)
        assert r["media_bytes"] == len(media["media"]) and r["media_sha256"] == hashlib.sha256(media["media"]).hexdigest()
    for d in odd.collect():
        b = (d["text"] or "").encode()
        pad = b + b"\xff" * (-len(b) % 576 if b else 576)
        r = by[d["doc_id"]][0]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-32:]))
        sound = telephony.samples_of(bytes(r["pcm"]))
        heard = [int(telephony.MU[x]) for x in pad[:3000]]
        assert len(sound) == 4 * len(pad) and list(np.frombuffer(sound, "<i2")[: 2 * len(heard) : 2]) == heard
        feature = dict(x.split("=") for x in r["feature"].split(";"))
        if len(pad) <= 3000:
            loud = lambda x: round((sum(int(v) ** 2 for v in x) / len(x)) ** 0.5)
            turns = sum((a < 0) != (b < 0) for a, b in zip(heard, heard[1:], strict=False))
            blocks = telephony.decode_adpcm(np.frombuffer(pad, np.uint8).reshape(-1, 36)).ravel()
            assert feature == {"mu": str(loud(heard)), "turns": str(turns), "a": str(loud([telephony.A[x] for x in pad])), "adpcm": str(loud(blocks)), "pcm16k": f"{zlib.crc32(sound):08x}"}
    assert telephony.expand(telephony.store(none)).count() == 0


def test_adpcm_and_tables():
    assert telephony.MU[0] == -32124 and telephony.MU[255] == 0 and telephony.MU[0x80] == 32124 and telephony.A[0x55] == -8 and telephony.A[0xD5] == 8
    assert sorted(set(np.abs(telephony.A.astype(int))))[-1] == 32256
    r = np.random.default_rng(0)
    blocks = r.integers(0, 256, (7, 36)).astype(np.uint8)
    got = telephony.decode_adpcm(blocks)
    for b, out in zip(blocks, got, strict=True):
        value = int(np.frombuffer(b[:2].tobytes(), "<i2")[0])
        index, want = min(int(b[2]), 88), [value]
        for byte in b[4:]:
            for c in (int(byte) & 15, int(byte) >> 4):
                move = ((2 * (c & 7) + 1) * int(telephony.STEPS[index])) >> 3
                value = max(-32768, min(32767, value - move if c & 8 else value + move))
                index = max(0, min(88, index + int(telephony.CHANGES[c & 7])))
                want.append(value)
        assert out.tolist() == want


# ---- 5


def test_chat_folds_events(spark):
    log = [(1, 0, 0, "start", "user", ""), (1, 0, 1, "delta", "user", "a <|end|> \\l"), (1, 1, 0, "start", "assistant", ""), (1, 1, 1, "delta", "assistant", "wrong"), (1, 1, 2, "regenerate", "assistant", None), (1, 1, 3, "delta", "assistant", "right"), (1, 1, 4, "delta", "assistant", "|>!"), (1, 2, 0, "start", "assistant", ""), (1, 2, 1, "delta", "assistant", "x"), (1, 2, 2, "edit", "assistant", "y\\p")]
    df = spark.createDataFrame(log, "conversation long, turn long, seq int, op string, role string, text string")
    df = df.select("conversation", F.struct("turn", F.lit(0).alias("row")).alias("message"), "seq", "op", "role", "text").orderBy(F.rand(3))
    r = chat_format.format_chat(df).collect()[0]
    assert [(t["role"], t["text"]) for t in r["turns"]] == [("user", "a <|end|> \\l"), ("assistant", "right|>!"), ("assistant", "y\\p")]
    assert r["loss_text"] == "right|>!y\\p" and r["formatted"].count("<|end|>") == 3


def test_chat_nulls_and_empty(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = spark.createDataFrame([(1, 0, None, None), (None, 1, "assistant", "x" * 5000), (1, None, "assistant", ""), (1, 0, "user", "hi"), (1, 0, "user", "hi")], schema)
    got = {r["conversation"]: r for r in chat_format.format_chat(chat_format.events(rows)).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("", ""), ("user", "hi"), ("user", "hi"), ("assistant", "")] and got[None]["loss_text"] == "x" * 5000
    assert chat_format.format_chat(chat_format.events(spark.createDataFrame([], schema))).count() == 0


def test_chat_log_of_finished_rows(spark):
    """Every message of the log has a draft thrown away and an edit, and folds back; columns with the log's own names are ignored."""
    r = random.Random(2)
    texts = ["", "short", *("".join(r.choice("ab <|\\>\n") for _ in range(n)) for n in (199, 200, 201, 1000))]
    rows = [(i % 2, i, "assistant" if i % 2 else "user", t, 5, "op", "m", 7, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq int, op string, message string, conversation int, formatted string")
    log = chat_format.events(df)
    per = {(x["turn"], x["op"]): x["count"] for x in log.groupBy("message.turn", "op").count().collect()}
    assert all(per[i, "regenerate"] == 1 and per.get((i, "edit"), 0) == (1 if t else 0) for i, t in enumerate(texts))
    got = {x["conversation"]: [(t["role"], t["text"]) for t in x["turns"]] for x in chat_format.format_chat(log.orderBy(F.rand(1))).collect()}
    assert got == {k: [(x[2], x[3]) for x in rows if x[0] == k] for k in (0, 1)}


# ---- 6

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p><article>";</script></head><body class="page"><nav><ul><li>Home</li></ul></nav>
<div class="cookie-notice"><p>We use cookies</p></div><!-- <p>no</p> --><article class="post"><h1>Title &amp; more</h1><p><b>First   line.<br>still<p>Second&nbsp;one</p><div class="ad">Buy</div><form><p>mail</p></form><aside>side</aside>
<section class="comments"><p>nice</p></section></article><footer>&copy; me</footer></body></html>"""


def test_page_blocks():
    blocks, marked = page_text.blocks_of(PAGE)
    assert marked and blocks == ["Title & more", "First line. still", "Second one"]
    assert page_text.blocks_of(None) == ([], False) and page_text.blocks_of("<p>a<p>b") == (["a", "b"], False)
    assert page_text.blocks_of("<article><p>x</p><p>cut of")[0] == ["x", "cut of"]
    page_text.blocks_of("<a " + 'x="y" ' * 5000)
    odd = '<article><p title="hidden menu" data-class="ad">stays</p><div class=\'site-notice\'>goes</div><p hidden>goes</p><header><h2>own</h2></header><div role=navigation>goes</div></article>'
    assert page_text.blocks_of(odd)[0] == ["stays", "own"]


@pytest.mark.parametrize("table", [4, page_text.TABLE])
def test_lcs_against_table(monkeypatch, table):
    monkeypatch.setattr(page_text, "TABLE", table)
    r = random.Random(2)
    for _ in range(60):
        a, b = ([r.choice("abcde") for _ in range(r.randrange(0, 14))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        got = page_text.common(a, b)
        assert len(got) == t[-1][-1]
        left = iter(b)
        assert all(a[i] in left for i in sorted(got))


def test_pages_are_differenced(spark):
    body = "<html><body><div>Site name</div><div>{}</div><div>Contact us</div></body></html>"
    rows = [(i, f"http://h.com/p/{i}", body.format(f"text {i}")) for i in range(4)] + [(9, None, None), (10, "http://other.org/x", body.format("alone")), (11, "bad", "")]
    got = {r["page_id"]: r["text"] for r in page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
    assert [got[i] for i in range(4)] == [f"text {i}" for i in range(4)] and got[9] == "" and got[10] == "Site name\n\nalone\n\nContact us" and len(got) == 7
    assert page_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_pages_against_brute_force(spark, parts):
    """The whole query, however the table is split: neighbours in the order of host and path among different pages, copies, equal paths, odd rows."""
    r = random.Random(12)
    rows = []
    for i in range(80):
        host = r.choice(["a.com", "a.com", "A.com", "b.org", "c.net"])
        lines = ["Menu of " + host.lower(), "Today", *(r.choice([f"own {i}.{k}", f"passage {r.randrange(5)}"]) for k in range(r.randrange(1, 6))), "Contact"]
        body = "".join(f"<div>{x}</div>" for x in lines)
        rows.append((i, f"https://{host}/{r.randrange(30)}?x={i}", f"<article>{body}</article>" if i % 10 == 0 else body))
    rows += [(3, rows[3][1], rows[3][2]), (None, "https://b.org/1", rows[7][2]), (90, rows[5][1], rows[9][2]), (91, None, "<p>alone"), (92, "https://c.net/5", None), (93, "https://c.net/5", "<p>" + "word " * 50_000)]

    def plain(page):
        return [" ".join(x.split()) for x in re.sub(r"</?(article|div|p)>", "\n", page or "").split("\n") if x.strip()]

    def place(url):
        m = re.match(r"https://([^/]*)([^?]*)", url or "")
        return (m[1].lower(), m[2]) if m else ("", "")

    def lcs(a, b):
        """Places in a, chosen as the operator does among equally long ones: from the end, matches first, then the shorter a."""
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        out, i, j = set(), len(a), len(b)
        while i and j:
            if a[i - 1] == b[j - 1]:
                i, j = i - 1, j - 1
                out.add(i)
            elif t[i - 1][j] >= t[i][j - 1]:
                i -= 1
            else:
                j -= 1
        return out

    first = {}
    for _, url, page in rows:
        if page and "<article>" not in page:
            host, path = place(url)
            k = (host, tuple(plain(page)))
            first[k] = min(first.get(k, path), path)
    order = sorted((host, path, hashlib.blake2b("\n\n".join(b).encode(), digest_size=16).digest(), b) for (host, b), path in first.items())
    want = {}
    for i, (host, _, _, b) in enumerate(order):
        gone = set()
        for k in (i - 1, i + 1):
            if 0 <= k < len(order) and order[k][0] == host:
                gone |= lcs(b, order[k][3])
        want[host, b] = "\n\n".join(x for j, x in enumerate(b) if j not in gone)
    expected = Counter((k, url, "\n\n".join(plain(page)) if not page or "<article>" in page else want[place(url)[0], tuple(plain(page))]) for k, url, page in rows)
    df = spark.createDataFrame([(*x, 1, "y", "z") for x in rows], "page_id long, url string, html string, n int, path string, text string").repartition(parts)
    assert Counter((x["page_id"], x["url"], x["text"]) for x in page_text.extract(df).collect()) == expected


def test_marked_pages_are_differenced(spark):
    """A template inside marked articles goes; a passage that neighbours share, near copies and hosts with few pages keep all."""
    page = "<article><p>Read our daily letter</p><p>{}</p>{}<p>All rights kept by us</p></article>"
    shared = [i // 2 for i in range(24)]
    rows = [(i, f"https://a.com/{i:03}", page.format(f"article number {i} with a text of its own that is long enough", f"<p>passage {shared[i]} of two neighbours, a good deal of text too</p>")) for i in range(24)]
    rows += [(100 + i, f"https://few.com/{i}", page.format(f"own {i}", "")) for i in range(4)]
    rows += [(200 + i, f"https://copies.com/{i:03}", f"<main><p>{'one long text in all copies ' * 9}</p><p>but {i}</p></main>") for i in range(12)]
    got = {x["page_id"]: x["text"] for x in page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert all(got[i] == f"article number {i} with a text of its own that is long enough\n\npassage {shared[i]} of two neighbours, a good deal of text too" for i in range(24))
    assert all(got[100 + i] == f"Read our daily letter\n\nown {i}\n\nAll rights kept by us" for i in range(4))
    assert all(got[200 + i].endswith(f"\n\nbut {i}") and got[200 + i].startswith("one long") for i in range(12)) and len(got) == 40


# ---- 7


def test_license_scan(spark, odd, none):
    lines = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0."]
    other = ["He lost his driving license in May.", "nothing to see", "All rights to the permission were granted."]
    df = spark.createDataFrame([(0, "\n".join(x for p in zip(lines, other + ["z"], strict=True) for x in p)), (1, "\n".join(other))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan(df).collect()}
    assert [x["family"] for x in got[0]["found"] if x["family"] != "unknown"] == ["mit", "apache-2.0", "gpl", "cc-by-nc"]
    assert [x["paragraph"] for x in got[0]["found"] if x["family"] != "unknown"] == [0, 2, 3, 5]
    assert not [x for x in got[1]["found"] if x["family"] != "unknown"]
    assert license_scan.trained().accuracy > 0.95
    assert license_scan.scan(odd).count() == odd.count() and license_scan.scan(none).count() == 0


WRAPPED = {
    "mit": """/*
 * Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal
 * in the Software without restriction, including without limitation the rights
 * to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
 * copies of the Software, and to permit persons to whom the Software is
 * furnished to do so, subject to the following conditions:
 */""",
    "bsd": """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions
# are met:
# 1. Redistributions of source code must retain the above copyright
#    notice, this list of conditions and the following disclaimer.""",
    "gpl": """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.""",
    "isc": """// Permission to use, copy, modify, and/or distribute this software for any
// purpose with or without fee is hereby granted, provided that the above
// copyright notice and this permission notice appear in all copies.""",
    "apache-2.0": """;; Licensed under the Apache License, Version 2.0 (the "License");
;; you may not use this file except in compliance with the License.
;; You may obtain a copy of the License at

;;     http://www.apache.org/licenses/LICENSE-2.0""",
}


def test_license_scan_of_wrapped_texts(spark):
    """Among other paragraphs, in a paragraph of thousands of words, and with columns of clashing names."""
    far = " ".join(f"word{i}" for i in range(3000))
    texts = list(WRAPPED.items()) + [(f, far + " " + t.replace("\n", " ").replace("*", "") + " " + far) for f, t in list(WRAPPED.items())[2:4]]
    rows = [(i, f"Some words here.\n\n{t}\n\nint main() {{}}", 1, 2, "x") for i, (_, t) in enumerate(texts)]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, found int, n_scanned int, paragraph string")).collect()}
    for i, (family, _) in enumerate(texts):
        assert {x["family"] for x in got[i]["found"]} - {"unknown"} == {family}
        assert all(x["paragraph"] >= 1 for x in got[i]["found"])


def test_license_scan_prefilter_loses_nothing(spark):
    """Every set of words that holds CONFIRM of a piece's 2-grams holds a telling one; and SQL scores as the model does."""
    m = license_scan.trained()
    r = random.Random(3)
    for _, w in m.pieces:
        two = license_scan.two_grams(w)
        for _ in range(20):
            assert set(r.sample(two, max(1, int(np.ceil(0.6 * len(two) - 1e-9))))) & set(m.telling) or len(two) < 2
    words = [w for _, w in m.pieces[:12]]
    x = np.zeros((len(words), len(m.number)))
    for i, w in enumerate(words):
        for g in license_scan.grams(w):
            x[i, m.number[g]] = 1
    want = m.predict(x)[:, :-1]
    got = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w array<string>").select("i", license_scan.classified(F.col("w"), m).alias("c")).collect()
    for row in got:
        assert abs(row["c"]["probability"] - want[row["i"]].max()) < 1e-3 and row["c"]["template_share"] == 1.0


def test_license_probabilities_are_calibrated():
    """On new paragraphs: in each band of probability, the share that is right lies near it."""
    m = license_scan.trained()
    x, y = m.sample(4000)
    p = m.predict(x)
    top, right = p.max(axis=1), p.argmax(axis=1) == y
    error = sum(abs(top[at].mean() - right[at].mean()) * at.mean() for lo in np.arange(0, 1, 0.1) for at in [(top >= lo) & (top < lo + 0.1 + 1e-9)] if at.any())
    assert error < 0.03
    unknown = y == len(m.families) - 1
    assert (p[unknown, :-1].max(axis=1) >= m.threshold).mean() <= 0.03


# ---- 8


def brute_classes(fps):
    root = list(range(len(fps)))
    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= 2:
                root[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(fps))]


def brute_fp(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    s = [" ".join(w)] if 0 < len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(spark, odd, none, tmp_path):
    r = random.Random(5)
    texts = made_up(30, 3)
    for t in list(texts[:6]):
        for _ in range(14):
            w = t.split(" ")
            w[r.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    texts += ["", None, texts[0], texts[0], "a b", "A b"]
    df = stored(spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"), tmp_path)
    got = {x["doc_id"] - 100: x for x in simhash.near_duplicates(df).collect()}
    fps = [brute_fp(t) for t in texts]
    assert [got[i]["fp"] & (2**64 - 1) for i in range(len(texts))] == fps
    assert [got[i]["component_id"] - 100 for i in range(len(texts))] == brute_classes(fps)
    split = {x["doc_id"] - 100: x["component_id"] - 100 for x in simhash.near_duplicates(df, crowded=3).collect()}
    assert [split[i] for i in range(len(texts))] == brute_classes(fps)
    assert simhash.near_duplicates(odd).count() == odd.count() and simhash.dedup(none).count() == 0


@pytest.mark.parametrize("dense", [1, 64])
def test_simhash_tally_within_a_list(dense):
    """Lists in which 4 and 2 positions vary, tallied as a whole and by sublists."""
    r = random.Random(6)
    base = r.getrandbits(64)
    few = lambda: r.getrandbits(8) & r.getrandbits(8) & r.getrandbits(8)
    for varying in [*simhash._VARYING, *simhash._TWO]:
        fps = list({base ^ sum(few() << 8 * i for i in varying) for _ in range(60)})
        order = sorted(simhash._signed(x) for x in fps)
        links = dict(simhash.link(np.array(order, np.int64)[::-1], varying, dense))
        want = brute_classes(order)
        assert {x: links.get(x, x) for x in order} == {x: order[k] for x, k in zip(order, want, strict=True)}


def test_simhash_couples_cover_two_bytes():
    assert all(any(set(two) <= set(v) for v in simhash._VARYING) for two in simhash._TWO) and len(simhash._TWO) == 28


# ---- 9


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def line_dedup_eligible(s):
    return bool(re.search(r"[^\x00-\x20]", s))


def brute_lines(texts, similarity=0.8):
    """Of all different normalised lines, by edit similarity alone: first places and groups."""
    norm = lambda s: re.sub(r"[\W_]+", " ", s.lower()).strip() or s.strip()
    first = {}
    for row, t in enumerate(texts):
        for pos, line in enumerate((t or "").split("\n") if t is not None else []):
            if line_dedup_eligible(line):
                first.setdefault(norm(line), (row, pos))
    lines = list(first)
    root = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            if root[i] != root[j] and abs(len(lines[i]) - len(lines[j])) <= 0.2 * max(len(lines[i]), len(lines[j])) and distance(lines[i], lines[j]) <= int(max(len(lines[i]), len(lines[j])) * (1 - similarity) + 1e-9):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if x == old else x for x in root]
    return first, Counter(root)


def test_lines_against_brute_force(spark, tmp_path):
    r = random.Random(8)
    base = [" ".join(r.choice(WORDS[:12]) + str(r.randrange(50)) for _ in range(30)) for _ in range(6)]
    texts = []
    for k in range(40):
        lines = []
        for s in r.sample(base, 3):
            w = s.split(" ")
            if r.random() < 0.7:
                w[r.randrange(30)] = r.choice(["x1", "y2", "z3"])
            lines.append(" ".join(w))
        texts.append("\n".join([*lines, "Yes.", "", "--- ---", hashlib.md5(b"%d" % k).hexdigest()]))
    texts += [None, "", "only\n \nshort", texts[0].upper(), "日本語の文章です、これは短い", "日本語の文章です、これも短い", "=== ==="]
    df = stored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), tmp_path)
    got = {x["doc_id"]: x for x in line_dedup.dedup(df).collect()}
    first, groups = brute_lines(texts)
    kept = sum(line_dedup_eligible(line) for x in got.values() for line in (x["text"] or "").split("\n"))
    assert kept == len(groups) and len(first) > len(groups)
    assert sum(x["__removed"] for x in got.values()) == sum(line_dedup_eligible(s) for t in texts for s in (t or "").split("\n")) - len(groups)
    for i, t in enumerate(texts):
        left = iter((t or "").split("\n"))
        assert all(s in left for s in (got[i]["text"] or "").split("\n")) or got[i]["text"] == ""
    assert got[40]["text"] is None and got[41]["text"] == "" and got[42]["text"] == "only\n \nshort" and got[43]["text"] == "" and got[45]["text"] == ""


def test_lines_on_odd_rows(spark, odd, none, tmp_path):
    got = line_dedup.dedup(stored(odd.coalesce(1), tmp_path)).collect()
    assert len(got) == odd.count() and sorted(x["__removed"] for x in got) == [0] * 6 + [1]
    assert line_dedup.dedup(none).count() == 0
    assert sum(x["__removed"] for x in line_dedup.dedup(odd.repartition(3)).collect()) == 1  # rows that are not stored


def test_lines_with_changed_words_meet(spark, tmp_path):
    """Against edit similarity alone: a word changed in lines of 5 to 100 words, and lines that are nobody's copy."""
    r = random.Random(4)
    word = lambda n=None: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n or r.randrange(2, 10)))
    texts, like = [], []
    for n in (5, 8, 12, 20, 40, 100):
        for _ in range(60):
            w = [word() for _ in range(n)]
            other = list(w)
            k = r.randrange(n)
            other[k] = word(len(w[k]))
            texts += [" ".join(w), " ".join(other)]
            like.append(distance(*texts[-2:]) <= int(max(map(len, texts[-2:])) * 0.2 + 1e-9))
    df = stored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), tmp_path)
    got = {x["doc_id"]: x["__removed"] for x in line_dedup.dedup(df).collect()}
    found = [got[2 * i] + got[2 * i + 1] for i in range(len(like))]
    assert all(f <= y for f, y in zip(found, like, strict=True))
    for k in range(6):
        part = slice(60 * k, 60 * k + 60)
        assert sum(found[part]) >= 0.9 * sum(like[part])


def test_long_lines_by_one_rule(spark, tmp_path):
    """Every word counts, whatever the line's length; and near copies of long lines go."""
    w = [f"w{i * 7919 % 30011}" for i in range(24_600)]
    lines = [" ".join(w[:n]) for n in (16_380, 16_390, 24_570, 24_580)]
    df = stored(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").coalesce(1), tmp_path)
    assert sorted(x["__removed"] for x in line_dedup.dedup(df).collect()) == [0, 0, 1, 1]


def test_long_similar_lines_without_common_marks(spark, tmp_path):
    """A tenth of the characters changed, evenly: no mark of 16 is left, yet the edit similarity is over 0.8."""
    r = random.Random(3)
    texts = []
    for n in (50, 110, 300):
        long = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(n)]
        texts += [" ".join(f"{w} {d}" for w in long) for d in (1, 2)]
        assert distance(*texts[-2:]) == n <= 0.1 * len(texts[-1])
    df = stored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), tmp_path)
    got = {x["doc_id"]: x["__removed"] for x in line_dedup.dedup(df).collect()}
    assert [got[k] + got[k + 1] for k in (0, 2, 4)] == [1] * 3


def test_pairs_of_large_blocks(spark):
    """Two large groups that meet in blocks, dealt with by hubs and by the lines that are in no hub's group."""
    plane = line_dedup._plane()
    assert len({frozenset(x) for x in plane}) == 20 and all(sum({a, b} <= set(x) for x in plane) == 1 for a in range(16) for b in range(a))
    rows = line_dedup.hub_rows(spark.createDataFrame([(i, 10 + i, [7]) for i in range(5)] + [(9, 1, [8])], "id long, size int, blocks array<long>"))
    assert {tuple(x) for x in rows.collect()} == {(i, 10 + i, 7, 0, 10) for i in range(1, 5)}
    active = spark.createDataFrame([(i, 10, 7, 0 if i < 40 else 40 + i % 3, 0) for i in range(50)], "id long, size int, block long, root long, top long")
    pairs = {(x["a"], x["b"]) for x in line_dedup.other_pairs(active, 0.8).collect()}
    root = lambda i: 0 if i < 40 else 40 + i % 3
    assert pairs == {(a, b) for b in range(50) for a in range(b) if root(a) != root(b)}


def test_pairs_of_several_blocks_come_once(spark):
    """Lines that share many blocks, as around a common passage: the join makes each pair once; with the hubs' pairs none that shares a block is left out."""
    r = random.Random(21)
    rows = [(i, 10, *[r.choice([0, 0, 0, 100 + i]) for _ in range(16)]) for i in range(80)]
    lines = spark.createDataFrame(rows, "id long, size int, " + ", ".join(f"m{k} int" for k in range(16)))
    rooted = line_dedup.with_roots(line_dedup.hub_rows(line_dedup.blocks_of(lines)), spark.createDataFrame([(7, 3)], "node long, root long"))
    got = [(x["a"], x["b"]) for x in line_dedup.other_pairs(line_dedup.with_earlier(rooted.drop("hub", "hub_size"), lines), 0.8).collect()]
    shared = {(a, b): n for b in range(80) for a in range(b) if (n := sum(all(rows[a][2 + k] == rows[b][2 + k] for k in ks) for ks in line_dedup._plane()))}
    hubs = {(x["a"], x["b"]) for x in line_dedup.hub_pairs(line_dedup.hub_rows(line_dedup.blocks_of(lines)), 0.8).collect()}
    assert sum(n > 1 for n in shared.values()) > 100 and len(got) == len(set(got)) > 100
    assert set(got) | hubs | {(3, 7)} == set(shared) | {(3, 7)} and (3, 7) not in got


def test_next_pairs(spark):
    """Each line with the next of its block only, and with none that agrees in too few words or is in its group."""
    lanes = sum(63 << 7 * j for j in range(8))
    rows = [(i, 10, 7, i % 2, 0, 0) for i in range(50)] + [(60 + i, 10, 8, 60, 0, 0) for i in range(9)] + [(80, 10, 9, 80, 0, 0), (81, 10, 9, 81, lanes, lanes)]
    active = spark.createDataFrame(rows, "id long, size int, block long, root long, s0 long, s1 long")
    for turn in range(line_dedup.TURNS):
        pairs = {(x["a"], x["b"]) for x in line_dedup.next_pairs(active, 0.8, turn).collect()}
        assert 0 < len(pairs) < 50 and all(a < b < 50 and (a + b) % 2 for a, b in pairs)


def test_distance_by_parts(spark):
    """Never less than the distance, and small enough where a few words change; repeated passages too."""
    r = random.Random(9)
    pairs = []
    for n in (3, 30, 80, 150):
        for _ in range(10):
            a = [r.choice("abcdef") * r.randrange(1, 3) + str(r.randrange(90)) for _ in range(n)] * r.choice([1, 1, 2])
            b = [r.choice("xyz") * r.randrange(1, 4) if r.random() < 0.04 else x for x in a]
            if r.random() < 0.4:
                b.insert(r.randrange(len(b) + 1), "b")
            pairs.append((" ".join(a), " ".join(b)))
    df = spark.createDataFrame(pairs, "x string, y string")
    most = F.lit(10_000)
    got = df.select(line_dedup.distance_by_parts(F.col("x"), F.col("y"), most).alias("d"), F.levenshtein("x", "y").alias("e")).collect()
    assert all(x["d"] >= x["e"] for x in got) and sum(x["d"] <= 0.2 * max(map(len, p)) or x["e"] > 0.1 * max(map(len, p)) for x, p in zip(got, pairs, strict=True)) >= 0.95 * len(got)


# ---- 10


def brute_targets(sizes, weights=(3, 1, 2), total=1.5, epochs=2):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    free, left, out = set(names), total * sum(sizes.values()), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > epochs * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = epochs * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_mixing(spark, odd, none):
    r = random.Random(7)
    rows = [(i, "w " * r.choice([0, 1, 5, 50, 400]), "en", r.choice(["a"] * 20 + ["b", "c", "d", None]), 0) for i in range(1500)]
    got = mixing.repetitions(spark.createDataFrame(rows, SCHEMA)).collect()
    sizes = Counter()
    for x in got:
        sizes[x["source"]] += x["size"]
    want, taken = brute_targets(sizes), Counter()
    for x in got:
        assert x["target"] == pytest.approx(want[x["source"]]) and 0 <= x["repeats"] <= 2
        taken[x["source"]] += x["repeats"] * x["size"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 400 + 0.01 * t
    again = mixing.repetitions(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((x["doc_id"], x["repeats"]) for x in got) == sorted((x["doc_id"], x["repeats"]) for x in again)
    assert mixing.repetitions(odd).count() == odd.count() and mixing.repetitions(none).count() == 0 and mixing.mix(none).count() == 0
    assert set(mixing.mix(odd).columns) == set(odd.columns)


# ---- shared


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5)]
    got = dict(map(tuple, common.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()))
    assert all(got[i] == 0 for i in range(301)) and all(got[1000 + i] == 1000 for i in range(200)) and len(got) == 501


def test_row_keys_survive_another_plan(spark, tmp_path):
    """The same key in both scans, however many cores plan them."""
    rows = [(i, f"own words of row {i}\nshared line of many words here {i % 7}", "en", "abc"[i % 3], 0) for i in range(400)]
    spark.createDataFrame(rows, SCHEMA).repartition(12).write.parquet(str(tmp_path / "t"))
    seen = []
    for n in ("3", "7"):
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", n)
        spark.conf.set("spark.sql.files.maxPartitionBytes", f"{int(n) * 1000}")
        try:
            df = common.keyed(spark.read.parquet(str(tmp_path / "t")).select("doc_id", "text"))
            seen.append({tuple(x["__row"]): x["doc_id"] for x in df.collect()})
            lines = line_dedup.dedup(spark.read.parquet(str(tmp_path / "t")))
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", "5")
            spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
            out = lines.collect()
            assert all(f"own words of row {x['doc_id']}" in x["text"] or x["__removed"] for x in out) and sum(x["__removed"] for x in out)
        finally:
            spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen[0] == seen[1] and len(seen[0]) == 400


def test_components_of_hubs(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    edges = [(i % 3, 10 + i) for i in range(60)] + [(200, 10), (200, 11), (300, 301)]
    got = dict(map(tuple, common.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()))
    assert {k for k, v in got.items() if v == 0} == {k for k in got if k < 300 and (k in (0, 1, 200) or (k - 10) % 3 < 2 and k >= 10)}
    assert got[301] == 300 and got[2] == 2


def test_extra_columns_with_clashing_names(spark, tmp_path):
    schema = SCHEMA + ", row long, pos int, norm string, sim long, id long, size long, quality string, key string, fp long, target double, repeats int, ids string"
    rows = [(i, t, "en", "s", 0, 1, 2, "n", 3, 4, 5, "q", "k", 6, 1.0, 1, "x") for i, t in enumerate(made_up(5))]
    df = stored(spark.createDataFrame(rows, schema), tmp_path)
    assert quality_rules.keep(df).columns == df.columns and quality_rules.judge(df, name="verdict").columns == [*df.columns, "verdict"]
    assert line_dedup.dedup(df).drop("__removed").columns == df.columns
    assert simhash.dedup(df).columns == df.columns and mixing.mix(df).columns == df.columns
    for out in (sentencepiece_sampling.encode(df), gru_lm.score(df, settings=SMALL), telephony.expand(telephony.store(df)), license_scan.scan(df), mixing.repetitions(df)):
        assert out.count() == 5
