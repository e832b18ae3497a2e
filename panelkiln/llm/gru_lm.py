"""Language-model scoring with a gated recurrent network over words.

Learning, from the rows whose crc32(key as text) mod `folds` is not `held`:
1. Every word of every learning text is counted (partial counts in the scan, one shuffle of word counts). The counts give
   the base model, the vocabulary and the classes.
2. The output softmax is factored by class: the `vocab` most frequent tokens, by frequency, into classes of `per_class`,
   and one class for all other words, seen or not. P(token) = P(class | state) P(token | class, state); inside
   the class of other words the probability is (count + 1) / (all their counts + their number + 1).
3. The network learns by backpropagation in numpy, truncated at `window` steps, from every learning text, each in one of
   `rounds` rounds (by a hash of its key). Many streams advance in step; a stream takes the next text when one ends, and carries a
   text's state over all its windows. Of the last texts of a partition, when most streams have run dry, the rests are dealt out to all streams in
   segments of `segment` tokens, each with a fresh state. Every partition trains its own copy (Adam); the copies are averaged by their number
   of tokens in a tree, and the next round starts from the average. So the weights, and with them the scores, depend on how the
   table is split; counts and base scores don't.

Scoring reads whole texts: streams of texts advance in step, longest first, and each text's state is carried over
all its windows, from its first word to its end token.

What the driver holds is bounded by parameters: `head` frequent words with their counts, the weights of a `vocab`-word
network, and MOST_SETS sets of weights at once. Counts of all rarer words stay distributed and
meet the texts' rare words in a join.

NULL and empty texts are the end token alone; texts of any length are learned and scored whole. A NULL key counts as the empty string. Repeated rows are scored and learned
each. An empty table gives no rows. Other columns are ignored. With no learning text at all, the counts are zero and the untrained network scores.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key, written

#: The end token as a word: no word holds a line feed.
END = b"\n"
#: Sets of weights that reach the driver; more are averaged on the way.
MOST_SETS = 32
_F = np.float32


@dataclass(frozen=True)
class Settings:
    vocab: int = 4096
    per_class: int = 64
    hidden: int = 16
    head: int = 1 << 18
    window: int = 32
    segment: int = 128
    rounds: int = 2
    streams: int = 512
    train_streams: int = 512
    rate: float = 0.03
    chunk: int = 3_000_000
    folds: int = 7
    held: int = 2


def crc_of(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")))


# ---- counts


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(c: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c.keys()), pa.binary()), pa.array(list(c.values()), pa.int64())], ["word", "c"])

    c: Counter = Counter()
    for b in batches:
        for t in b.column(0).cast(pa.binary()):
            c.update((t.as_py() or b"").lower().split())
            c[END] += 1
            if len(c) > 300_000:
                yield out(c)
                c = Counter()
    if c:
        yield out(c)


def word_counts(texts: DataFrame) -> DataFrame:
    """word (binary), c: over the one text column."""
    return texts.mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def head_of(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The frequent words, at most that many: all whose count is in a high enough band. Two bounded results, no sort."""
    band = F.floor(F.log2("c") * 16).cast("int")
    held, least = 0, None
    for b, n in sorted(counts.groupBy(band.alias("band")).agg(F.count("*")).collect(), reverse=True):
        if held + n > most:
            break
        held, least = held + n, b
    if least is None:
        return []
    rows = counts.where(band >= least).collect()
    return sorted(((bytes(r["word"]), r["c"]) for r in rows), key=lambda x: (-x[1], x[0]))


# ---- the network


class Model:
    """Parameters in `p`, and what is known of words: `number` (in the vocabulary's order) and counts."""

    def __init__(self, s: Settings, head: list[tuple[bytes, int]], total: int, distinct: int) -> None:
        head = [x for x in head if x[0] != END]
        self.s, self.total, self.distinct = s, total, distinct
        self.words = [END] + [w for w, _ in head[: s.vocab - 1]]
        self.count = dict(head)
        self.number = {w: i for i, w in enumerate(self.words)}
        self.n_classes = -(-len(self.words) // s.per_class)

    def set_counts(self, end_count: int) -> None:
        s = self.s
        self.count[END] = end_count
        self.index = {w: i for i, w in enumerate(self.count)}
        known = np.array([self.count.get(w, 0) for w in self.words], np.float64)
        self.rare_total = self.total - int(known.sum())
        self.rare_words = max(0, self.distinct - sum(1 for w in self.words if self.count.get(w, 0)))
        self.rare_norm = float(np.log10(self.rare_total + self.rare_words + 1))
        size = self.n_classes * s.per_class
        inner = np.full(size, -1e9)
        inner[: len(known)] = np.log(known + 1)
        inner = inner.reshape(self.n_classes, s.per_class)
        per_class = np.append(np.exp(inner).sum(axis=1), self.rare_total + 1.0)
        rng = np.random.default_rng(5)
        h, v = s.hidden, len(self.words) + 1  # the last input is any other word
        r = lambda *n: rng.normal(0, 0.1, n).astype(_F)
        self.p = {
            "emb": r(v, h), "wx": r(h, 3 * h), "wh": r(h, 3 * h), "b": np.zeros(3 * h, _F),
            "wc": np.zeros((h, self.n_classes + 1), _F), "bc": np.log(per_class / per_class.sum()).astype(_F),
            "wo": np.zeros((self.n_classes, h, s.per_class), _F), "bo": inner.astype(_F),
        }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place where that can be: x is the caller's own sum."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _exponentials(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits, their exponentials and the sums of these by row. Where none can overflow and no sum vanishes, rows need no shift."""
    if logits.max() < 60:
        e = np.exp(logits)
        z = e @ np.ones(logits.shape[1], logits.dtype)
        if z.min() > 1e-30:
            return logits, e, z
    logits = logits - logits.max(axis=1, keepdims=True)
    e = np.exp(logits)
    return logits, e, e.sum(axis=1)


def _softmax_loss(logits: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Natural log-probability of the targets, and the softmax itself."""
    logits, e, z = _exponentials(logits)
    e /= z[:, None]
    return logits[np.arange(len(target)), target] - np.log(z), e


def _logp(logits: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The same log-probability alone."""
    logits, _, z = _exponentials(logits)
    return logits[np.arange(len(target)), target] - np.log(z)


def output_logp(p: dict, s: Settings, h: np.ndarray, target: np.ndarray, grad: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """ln P of each target given its state; targets from the vocabulary's size on are other words (their class only). With grad, adds gradients of the negative mean and returns that of h."""
    n_classes = p["wo"].shape[0]
    cls = np.minimum(target // s.per_class, n_classes)
    logits, dh = h @ p["wc"] + p["bc"], None
    if grad is None:
        out = _logp(logits, cls)
    else:
        out, soft = _softmax_loss(logits, cls)
        soft[np.arange(len(cls)), cls] -= 1
        soft /= len(cls)
        grad["wc"] += h.T @ soft
        grad["bc"] += soft.sum(axis=0)
        dh = soft @ p["wc"].T
    # rows sorted by class: each class's are a slice
    order = np.argsort(cls.astype(np.int16) if n_classes < 1 << 15 else cls, kind="stable")
    edges = np.searchsorted(cls[order], np.arange(n_classes + 1))
    order = order[: edges[-1]]
    hs, inner = h[order], target[order] % s.per_class
    lp = np.empty(len(order), out.dtype)
    dhs = None if grad is None else np.empty_like(hs)
    for c in np.nonzero(np.diff(edges))[0]:
        at = slice(edges[c], edges[c + 1])
        hc, y = hs[at], inner[at]
        logits = hc @ p["wo"][c] + p["bo"][c]
        if grad is None:
            lp[at] = _logp(logits, y)
        else:
            lp[at], soft = _softmax_loss(logits, y)
            soft[np.arange(len(y)), y] -= 1
            soft /= len(cls)
            grad["wo"][c] += hc.T @ soft
            grad["bo"][c] += soft.sum(axis=0)
            dhs[at] = soft @ p["wo"][c].T
    out[order] += lp
    if grad is not None:
        dh[order] += dhs
    return out, dh


def _step(gx: np.ndarray, h: np.ndarray, wh: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """A gated recurrent step: gx is the input's part of the gates."""
    gh = h @ wh
    zr = _sigmoid(gx[:, : 2 * n] + gh[:, : 2 * n])
    z, r = zr[:, :n], zr[:, n:]
    c = np.tanh(gx[:, 2 * n :] + r * gh[:, 2 * n :])
    return z * h + (1 - z) * c, z, r, c, gh[:, 2 * n :]


def train_window(p: dict, s: Settings, x: np.ndarray, y: np.ndarray, h: np.ndarray, fresh: np.ndarray | None = None, real: np.ndarray | None = None) -> tuple[float, np.ndarray, dict]:
    """x, y: (window, streams) inputs and targets; fresh: where a text begins, so that the state starts from zero; real: which places count (all). The loss
    (mean negative ln P), the last state and the gradients."""
    n, steps = s.hidden, len(x)
    emb = p["emb"][x]
    gx = emb @ p["wx"] + p["b"]
    keep = None if fresh is None or not fresh.any() else (~fresh).astype(_F)[:, :, None]
    kept, hs = [], np.empty((steps, x.shape[1], n), _F)
    for t in range(steps):
        if keep is not None:
            h = h * keep[t]
        hs[t], z, r, c, u = _step(gx[t], h, p["wh"], n)
        kept.append((h, z, r, c, u))
        h = hs[t]
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    flat = hs.reshape(-1, n)
    if real is None or real.all():
        lp, dh_out = output_logp(p, s, flat, y.reshape(-1), grad)
    else:
        at = np.nonzero(real.reshape(-1))[0]
        dh_out = np.zeros_like(flat)
        lp, dh_out[at] = output_logp(p, s, flat[at], y.reshape(-1)[at], grad)
    dh_out = dh_out.reshape(hs.shape)
    dgx = np.empty_like(gx)
    dgh = np.empty_like(gx)
    dh = np.zeros_like(h)
    for t in range(steps - 1, -1, -1):
        h0, z, r, c, u = kept[t]
        dh = dh + dh_out[t]
        dn = dh * (1 - z)
        dc = dn * (1 - c * c)
        gate, own = dgh[t], dgx[t]
        np.multiply(dn * z, h0 - c, out=own[:, :n])
        np.multiply(dc * u * r, 1 - r, out=own[:, n : 2 * n])
        own[:, 2 * n :] = dc
        gate[:, : 2 * n] = own[:, : 2 * n]
        np.multiply(dc, r, out=gate[:, 2 * n :])
        dh = dh * z + gate @ p["wh"].T
        if keep is not None:
            dh *= keep[t]
    before = np.stack([k[0] for k in kept]).reshape(-1, n)
    grad["wh"] += before.T @ dgh.reshape(-1, 3 * n)
    rows = dgx.reshape(-1, 3 * n)
    grad["wx"] += emb.reshape(-1, n).T @ rows
    grad["b"] += rows.sum(axis=0)
    de, at = p["wx"] @ rows.T, x.reshape(-1)
    grad["emb"] = np.stack([np.bincount(at, weights=d, minlength=len(p["emb"])) for d in de], axis=1).astype(rows.dtype)
    return float(-lp.mean()), h, grad


class Adam:
    def __init__(self, p: dict, rate: float) -> None:
        self.m, self.v, self.t, self.rate = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0, rate

    def update(self, p: dict, grad: dict) -> None:
        self.t += 1
        rate = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grad.items():
            g = np.clip(g, -1, 1)
            self.m[k] += _F(0.1) * (g - self.m[k])
            self.v[k] += _F(0.001) * (g * g - self.v[k])
            p[k] -= _F(rate) * self.m[k] / (np.sqrt(self.v[k]) + _F(1e-8))


# ---- learning over partitions


def pack(p: dict) -> bytes:
    return np.concatenate([p[k].ravel() for k in sorted(p)]).astype(_F).tobytes()


def unpack(raw: bytes, like: dict) -> dict:
    flat, out, at = np.frombuffer(raw, _F), {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out


def numbers(model: Model, toks: list[bytes]) -> np.ndarray:
    other, get = len(model.words), model.number.get
    return np.array([get(w, other) for w in toks], np.int32)


def windows(s: Settings, texts: Iterable[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(tokens, fresh, real), each (window, streams), of all texts: each stream goes on with its text from window to window.

    fresh: places where a text, or a segment of a last one, begins; real: places that hold a token.
    """
    texts = iter(texts)
    rest: list[np.ndarray] = [np.zeros(0, np.int32)] * s.train_streams
    began = [True] * s.train_streams  # whether the rest begins a text

    def window() -> tuple | None:
        x = np.zeros((s.train_streams, s.window), np.int32)
        fresh = np.zeros(x.shape, bool)
        fill = [0] * s.train_streams
        nonlocal dry
        for j in range(s.train_streams):
            at = 0
            while at < s.window:
                if not len(rest[j]):
                    if dry:
                        break
                    following = next(texts, None)
                    if following is None:
                        dry = True
                        break
                    rest[j], began[j] = following, True
                k = min(s.window - at, len(rest[j]))
                x[j, at : at + k] = rest[j][:k]
                fresh[j, at] |= began[j]
                rest[j], began[j] = rest[j][k:], False
                at += k
            fill[j] = at
        real = np.arange(s.window)[:, None] < np.array(fill)[None, :]
        return (x.T, fresh.T, real) if real.any() else None

    dry = dealt = False
    while True:
        if dry and not dealt and sum(1 for r in rest if len(r)) < s.train_streams // 4:
            dealt = True
            texts = iter([r[k : k + s.segment] for r in rest for k in range(0, len(r), s.segment)])
            rest, dry = [np.zeros(0, np.int32)] * s.train_streams, False
        got = window()
        if got is None:
            return
        yield got


def train_on(model: Model, texts: Iterable[np.ndarray]) -> tuple[dict, int, float]:
    """The weights after all texts (numbers of their tokens, the end included), the number of tokens and their summed loss."""
    s = model.s
    p = {k: v.copy() for k, v in model.p.items()}
    adam, tokens, loss = Adam(p, s.rate), 0, 0.0
    rare = model.n_classes * s.per_class  # any other word's target
    h, last = np.zeros((s.train_streams, s.hidden), _F), np.zeros(s.train_streams, np.int32)
    for x, fresh, real in windows(s, texts):
        before = np.where(fresh, 0, np.vstack([last[None], x[:-1]]))  # a text's first input is an end token
        n = int(real.sum())
        part, h, grad = train_window(p, s, before, np.where(x >= len(model.words), rare, x), h, fresh, real)
        adam.update(p, grad)
        last = x[-1]
        tokens += n
        loss += part * n
    return p, tokens, loss


def _train(shared):
    def go(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value

        def texts() -> Iterator[np.ndarray]:
            for b in batches:
                for t in b.column(0).cast(pa.binary()):
                    yield numbers(model, (t.as_py() or b"").lower().split() + [END])

        p, n, loss = train_on(model, texts())
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([pack(p)], pa.binary()), pa.array([n], pa.int64()), pa.array([loss])], ["weights", "n", "loss"])

    return go


def _average(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n, loss = None, 0, 0.0
    for b in batches:
        for raw, k, part in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            w = np.frombuffer(raw.as_py(), _F).astype(np.float64) * k
            total = w if total is None else total + w
            n, loss = n + k, loss + part
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([(total / n).astype(_F).tobytes()], pa.binary()), pa.array([n], pa.int64()), pa.array([loss])], ["weights", "n", "loss"])


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id", settings: Settings | None = None) -> tuple[Model, DataFrame]:
    """The model, and the stored table of all word counts."""
    s = settings or Settings()
    spark = docs.sparkSession
    learning = docs.select(crc_of(F.col(key)).alias("crc"), F.col(text).alias("text")).where(F.col("crc") % s.folds != s.held)
    counts = written(word_counts(learning.select("text")), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = counts.where(F.col("word") == F.lit(END)).collect()
    model = Model(s, head_of(counts, s.head), total, distinct)
    model.set_counts(ends[0]["c"] if ends else 0)
    schema = "weights binary, n long, loss double"
    for r in range(s.rounds):
        shared = spark.sparkContext.broadcast(model)
        mine = learning.where(F.pmod(F.xxhash64("crc"), F.lit(s.rounds)) == r).select("text")
        trained = mine.mapInArrow(_train(shared), schema)
        few = max(1, round(len(docs.inputFiles()) ** 0.5))
        averaged = trained.repartition(few).mapInArrow(_average, schema)
        if few > MOST_SETS:
            averaged = averaged.repartition(MOST_SETS).mapInArrow(_average, schema)
        merged = averaged.collect()
        whole = pa.RecordBatch.from_arrays([pa.array([bytes(x["weights"]) for x in merged], pa.binary()), pa.array([x["n"] for x in merged], pa.int64()), pa.array([x["loss"] for x in merged], pa.float64())], ["weights", "n", "loss"])
        for b in _average([whole]):
            model.p = unpack(b.column(0)[0].as_py(), model.p)
            model.loss = b.column(2)[0].as_py() / b.column(1)[0].as_py()
        shared.unpersist()
    return model, counts


# ---- scoring


def state_logp(model: Model, seqs: list[np.ndarray]) -> np.ndarray:
    """For each text (numbers of its tokens, the end included) log10 P of its tokens; other words count their class only."""
    s, p = model.s, model.p
    n, words = s.hidden, len(model.words)
    rare = model.n_classes * s.per_class
    gates = p["emb"] @ p["wx"] + p["b"]
    order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
    # texts are laid end to end in streams: longest first, always into the shortest stream
    k = min(s.streams, len(order))
    loads = np.zeros(k, np.int64)
    streams: list[list[int]] = [[] for _ in range(k)]
    for i in order:
        j = int(loads.argmin())
        streams[j].append(i)
        loads[j] += len(seqs[i])
    ranked = np.argsort(-loads, kind="stable")
    streams, loads = [streams[j] for j in ranked], loads[ranked]
    steps = int(loads[0])
    flat = np.concatenate([seqs[i] for st in streams for i in st])
    owner = np.concatenate([np.full(len(seqs[i]), i, np.int32) for st in streams for i in st])
    fresh = np.concatenate([[True], owner[1:] != owner[:-1]])
    first = np.cumsum(loads) - loads
    alive = np.searchsorted(-loads, -np.arange(steps), side="left")  # streams with more than t tokens
    h = np.zeros((k, n), _F)
    score = np.zeros(len(seqs))
    states, places, held = [], [], 0

    def flush() -> None:
        nonlocal held
        if states:
            at = np.concatenate(places)
            y = flat[at]
            lp, _ = output_logp(p, s, np.concatenate(states), np.where(y >= words, rare, y))
            score[:] += np.bincount(owner[at], weights=lp.astype(np.float64), minlength=len(seqs))
            states.clear(), places.clear()
            held = 0

    prev = np.zeros(k, np.int32)
    for t in range(steps):
        a = int(alive[t])
        at = first[:a] + t
        new = fresh[at]
        prev = np.where(new, 0, prev[:a])
        h = h[:a] * ~new[:, None]
        h = _step(gates[prev], h, p["wh"], n)[0]
        states.append(h)
        places.append(at)
        held += a
        prev = flat[at]
        if held >= 1 << 15:
            flush()
    flush()
    return score / np.log(10)


def _score(shared):
    names = ["row", "word", "tf", "key", "n_tokens", "n_known", "base", "score"]

    def go(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        words, get, count = len(model.words), model.index.get, model.count
        # by the head's own numbers, the last for words that are not in it
        log_of = np.log10(np.append(np.array(list(count.values()), np.float64), 0.0) + 1)
        number = np.append(np.array([model.number.get(w, words) for w in count], np.int32), np.int32(words))
        none = len(count)
        rows: list = []
        seqs: list[np.ndarray] = []
        held = 0

        def done() -> Iterator[pa.RecordBatch]:
            score = state_logp(model, seqs)
            for at in range(0, len(rows), 4000):
                out: list[list] = [[] for _ in names]
                for (row, key, n, known, base, extra, tail), sc in zip(rows[at : at + 4000], score[at : at + 4000].tolist(), strict=True):
                    k = len(tail)
                    out[0] += [row] * (k + 1)
                    out[1] += [b"\n%d" % row, *tail.keys()]
                    out[2] += [0, *tail.values()]
                    out[3] += [key] + [None] * k
                    for j, v in ((4, n), (5, known), (6, base), (7, sc + extra)):
                        out[j] += [v] + [0] * k
                kinds = [pa.int64(), pa.binary(), pa.int64(), kind, pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names)
            rows.clear(), seqs.clear()

        for b in batches:
            kind = b.column(1).type
            for row, key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()), strict=True):
                toks = (t.as_py() or b"").lower().split()
                toks.append(END)
                at = np.fromiter(map(get, toks, repeat(none)), np.int32, len(toks))
                num, lg, rare = number[at], log_of[at], at == none
                tail = Counter([toks[i] for i in np.nonzero(rare)[0].tolist()])
                other = num == words
                zero = model.count[END] == 0
                rows.append((row, key, len(toks), len(toks) - int(rare.sum()) - zero, float(lg.sum()), float(lg[other].sum()) - int(other.sum()) * model.rare_norm, tail))
                seqs.append(num)
                held += len(toks)
                if held >= model.s.chunk:
                    yield from done()
                    held = 0
        if rows:
            yield from done()

    return go


def score(docs: DataFrame, text: str = "text", key: str = "doc_id", settings: Settings | None = None) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    s = settings or Settings()
    model, counts = fit(docs, text, key, s)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()
    parts = docs.select(row_key().alias("row"), F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        _score(shared), f"row long, word binary, tf long, key {kind}, n_tokens long, n_known long, base double, score double"
    )
    rest = parts.join(counts, "word", "left")
    c = F.coalesce("c", F.lit(0))
    log = F.col("tf") * F.log10(c + 1)
    got = rest.groupBy("row").agg(
        F.max("key").alias("key"), F.sum("n_tokens").alias("n_tokens"), (F.sum("n_known") + F.sum(F.when(c > 0, F.col("tf")).otherwise(0))).alias("n_known"),
        (F.sum("base") + F.sum(log)).alias("base"), (F.sum("score") + F.sum(log)).alias("score"),
    )
    norm = float(np.log10(model.total + model.distinct + 1))
    return got.select(
        F.col("key").alias(key), (crc_of(F.col("key")) % s.folds == s.held).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * norm).alias("base_score"), "score",
    )
