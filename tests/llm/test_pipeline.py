"""The pipeline against a plain version of its stages."""

import hashlib
import math
import random
from collections import Counter

import corpus_pipeline
from panelkiln.llm import sentencepiece_sampling

from .test_llm import SCHEMA, brute_classes, brute_fp, brute_targets, line_dedup_eligible


def plain_pipeline(rows):
    """doc_id, text and how often: texts of one line a sentence, without symbols or near lines, so that rules and lines are simple to tell."""
    rows = [r for r in rows if r[1] and len(r[1].split()) >= 50 and "###" not in r[1]]
    seen, docs = set(), []
    for r in rows:
        kept = []
        for line in r[1].split("\n"):
            key = " ".join("".join(c if c.isalnum() else " " for c in line.lower()).split())
            key = key or line.strip()
            if not line_dedup_eligible(line) or key not in seen:
                kept.append(line)
            seen.add(key) if line_dedup_eligible(line) else None
        docs.append((r[0], "\n".join(kept), r[3]))
    classes = brute_classes([brute_fp(t) for _, t, _ in docs])
    docs = [d for i, d in enumerate(docs) if classes[i] == i]
    size = lambda t: len(t.split())
    sources = Counter()
    for _, t, s in docs:
        sources[s] += size(t)
    targets = brute_targets(sources)
    out = {}
    for s in sources:
        mine = sorted((len(f"{size(t):b}"), hashlib.md5(f"{k}:17".encode()).hexdigest(), k, t) for k, t, own in docs if own == s)
        rate = targets[s] / sources[s]
        whole, part = math.floor(rate), rate - math.floor(rate)
        for i, (_, _, k, t) in enumerate(mine, 1):
            n = whole + math.floor(i * part + 0.5) - math.floor((i - 1) * part + 0.5)
            if n:
                out[k] = (t, n)
    return out


def test_pipeline(spark, tmp_path):
    r = random.Random(11)
    sentence = lambda: " ".join("".join(r.choice("aeioumnrst") for _ in range(r.randrange(3, 9))) for _ in range(25))
    shared = [sentence() for _ in range(4)]
    rows = []
    for i in range(60):
        lines = [sentence() for _ in range(r.randrange(3, 7))] + r.sample(shared, 1) + ["Yes."]
        r.shuffle(lines)
        rows.append((i, "\n".join(lines), "en", r.choice("aaabc"), 0))
    rows += [(60, rows[0][1], "en", "b", 0), (61, rows[5][1] + " ### " * 60, "en", "a", 0), (62, "too short", "en", "a", 0), (63, None, "en", "a", 0), (64, rows[7][1].upper(), "en", "c", 0)]
    rows = [x for x in rows if x[0] != 64]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = plain_pipeline(rows)
    assert Counter(x["doc_id"] for x in got) == {k: n for k, (_, n) in want.items()}
    p = sentencepiece_sampling.pieces(sentencepiece_sampling.MODEL, 1.0)
    assert all(x["lossless"] and sentencepiece_sampling.decode_ids(x["ids"], p).decode() == want[x["doc_id"]][0] for x in got)


def test_stages_keep_the_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, "")
        assert out.columns == empty.columns and out.count() == 0, name


def test_near_copies_go(spark, tmp_path):
    """Against brute force on similarity alone: words changed in texts of 100 to 1000 words."""
    r = random.Random(13)
    texts = []
    for n in (100, 300, 1000):
        for _ in range(6):
            w = [f"w{r.randrange(5000)}" for _ in range(n)]
            texts.append(" ".join(w))
            for k in (1, n // 100, n // 50, n // 20):
                other = list(w)
                for _ in range(k):
                    other[r.randrange(n)] = f"x{r.randrange(5000)}"
                texts.append(" ".join(other))
    texts += [texts[0], "", None, "a b", "A  b"]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").lower().split() for t in texts)]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if x == old else x for x in root]
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "t"))
    got = {x["doc_id"] for x in corpus_pipeline.near_duplicates(spark, spark.read.parquet(str(tmp_path / "t")), "").collect()}
    assert got == set(root) and len(got) < len(texts) // 2


def test_line_stage_keeps_long_links(spark, tmp_path):
    """Long similar lines without common marks: the stage decides by the whole distance and keeps one of two."""
    r = random.Random(5)
    long = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(200)]
    rows = [(d, " ".join(f"{w} {d}" for w in long), "en", "web", 0) for d in (1, 2)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "docs"))
    got = corpus_pipeline.lines(spark, spark.read.parquet(str(tmp_path / "docs")), "").collect()
    assert sorted(len(x["text"]) for x in got) == [0, len(rows[0][1])]
