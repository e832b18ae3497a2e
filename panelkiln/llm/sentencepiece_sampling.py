"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice, and decoding.

The vocabulary comes from a SentencePiece model file. Its merge ranks give piece probabilities by a Zipf-Mandelbrot law,
p ~ (rank + OFFSET) ** -1: a unigram model over the given pieces, with a temperature. A character without a piece falls back to
its UTF-8 bytes, which are pieces too.

Spaces become part of the piece that follows, as in SentencePiece. No piece reaches over a line feed, or over a space after another
character; so the lattice of a text falls apart into units (a word with the spaces before it, spaces at the end of a line, a line feed). Each different unit of a
chunk gets its lattice once: substrings of up to 16 characters are hashed by length, looked up in the vocabulary and compared
with it; forward filtering runs over all units at once, one end position at a time. Backward sampling then walks all
occurrences at once from their ends: each step draws one edge into the present state with the edge's posterior probability.
The random numbers are a hash of the seed, the row's key, the unit's place in the text and the step: a row's segmentation
is the same in any batch, partition or rerun: edges into a place are in a fixed order, and their shares are sums of these edges alone.

Decoding joins the pieces' bytes and gives the text back exactly, whatever it holds (U+2581 itself is written as bytes).

NULL and empty texts have no pieces and decode to the empty text. Rows with equal keys and texts are segmented alike; a NULL
key is a key of its own. Other columns are ignored. Work goes by chunks of `CHUNK` characters or one text, if it is longer.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
OFFSET = 3.0
TEMPERATURE = 1.0
SEED = 11
CHUNK = 3 << 19
_UNIT = re.compile(r" *[^ \n]+| +|\n")
_P = np.uint64(0x9E3779B97F4A7C15)
_BITS = 20


class Pieces:
    """The vocabulary as tables."""

    def __init__(self, model: str, temperature: float) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        texts, logs, ids = [], [], []
        self.byte_id = np.zeros(256, np.int32)
        self.bytes: list[bytes] = [b""] * sp.vocab_size()
        total = sum(1.0 / (r + OFFSET) for r in range(sp.vocab_size()))
        for i in range(sp.vocab_size()):
            if sp.is_byte(i):
                b = int(sp.id_to_piece(i)[3:5], 16)
                self.byte_id[b] = i
                self.bytes[i] = bytes([b])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                t = sp.id_to_piece(i).replace("▁", " ")
                self.bytes[i] = t.encode()
                if " " in t.lstrip(" ") or "\n" in t:
                    continue  # reaches over a unit's edge: never drawn
                texts.append(t)
                ids.append(i)
                logs.append(-np.log((-sp.get_score(i) + OFFSET) * total) / temperature)
        self.fallback = -np.log(1e6) / temperature
        self.max_len = max(map(len, texts))
        lens = np.array([len(t) for t in texts])
        cps = np.zeros((len(texts), self.max_len), np.uint32)
        for k, t in enumerate(texts):
            cps[k, : len(t)] = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        self.by_len: dict[int, tuple] = {}
        for n in range(1, self.max_len + 1):
            at = np.nonzero(lens == n)[0]
            if not len(at):
                continue
            h = np.zeros(len(at), np.uint64)
            for j in range(n):
                h = _longer(h, cps[at, j].astype(np.uint64) + np.uint64(1), j)
            order = np.argsort(h)
            at, h = at[order], h[order]
            slot = np.full(1 << _BITS, -1, np.int32)
            slot[_slot(h)] = np.arange(len(at), dtype=np.int32)
            self.by_len[n] = (slot, h, np.array(ids, np.int64)[at], cps[at, :n], np.array(logs)[at])


def _longer(h: np.ndarray, c: np.ndarray, before: int) -> np.ndarray:
    """A substring's number with one more character (its code point plus 1). Up to three characters it is exact, then a hash."""
    return (h << np.uint64(21)) + c if before < 3 else h * _P + c


def _slot(h: np.ndarray) -> np.ndarray:
    return ((h * _P) >> np.uint64(64 - _BITS)).astype(np.int64)


def _sums(v: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Sums from each head to the next, added one by one in order: the same bits wherever a group lies."""
    size = np.diff(np.append(heads, len(v)))
    out = v[heads]
    for k in range(1, int(size.max())):
        more = np.nonzero(size > k)[0]
        out[more] += v[heads[more] + k]
    return out


@lru_cache(2)
def pieces(model: str, temperature: float) -> Pieces:
    return Pieces(model, temperature)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Lattice:
    """All units' lattices. A state is a place between characters; unit w with n characters has n + 1 of them."""

    def __init__(self, units: list[str], p: Pieces) -> None:
        n = np.array([len(u) for u in units], np.int64)
        cp = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        first = np.cumsum(n) - n
        unit = np.repeat(np.arange(len(units)), n)
        offset = np.arange(len(cp)) - first[unit]
        left = n[unit] - offset
        state = np.arange(len(cp)) + unit
        self.start, self.end = first + np.arange(len(units)), first + np.arange(len(units)) + n
        src, dst, at, item, score = [], [], [], [], []
        covered = np.zeros(len(cp), bool)
        wide = cp.astype(np.uint64) + np.uint64(1)
        h = np.zeros(len(cp), np.uint64)
        longest = int(n.max()) if len(n) else 0
        for k in range(1, min(p.max_len, longest) + 1):
            h = _longer(h[: len(cp) - k + 1], wide[k - 1 :], k - 1)  # of the k characters from each place on
            if k not in p.by_len:
                continue
            slot, hashes, ids, cps, logs = p.by_len[k]
            found = slot[_slot(h)]
            here = np.nonzero((found >= 0) & (left[: len(h)] >= k))[0]
            found, own = found[here], h[here]
            ok = hashes[found] == own
            if not ok.all():  # another piece may hide behind the one in the slot
                no = np.nonzero(~ok)[0]
                other = np.minimum(np.searchsorted(hashes, own[no]), len(hashes) - 1)
                found[no] = other
                ok[no] = hashes[other] == own[no]
                here, found = here[ok], found[ok]
            if k > 3:
                ok = (cp[here[:, None] + np.arange(k)] == cps[found]).all(axis=1)
                here, found = here[ok], found[ok]
            if k == 1:
                covered[here] = True
            src.append(state[here]), dst.append(state[here] + k), at.append(offset[here] + k), item.append(ids[found]), score.append(logs[found])
        bare = np.nonzero(~covered)[0]
        size = 1 + (cp[bare] >= 0x80) + (cp[bare] >= 0x800) + (cp[bare] >= 0x10000)
        src.append(state[bare]), dst.append(state[bare] + 1), at.append(offset[bare] + 1), item.append(-1 - cp[bare].astype(np.int64)), score.append(size * p.fallback)
        src, dst, at, item, score = (np.concatenate(x) for x in (src, dst, at, item, score))
        # stable: edges into one place stay in the order of their lengths, whatever else the chunk holds
        order = np.argsort(at * np.int64(len(cp) + len(units) + 1) + dst, kind="stable")
        src, dst, at, item, score = (x[order] for x in (src, dst, at, item, score))
        new = np.concatenate([[True], dst[1:] != dst[:-1]]) if len(dst) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        heads = np.nonzero(new)[0]
        alpha = np.zeros(len(cp) + len(units))
        p_edge = np.empty(len(dst))
        # forward filtering: by end position, all units at once
        steps = np.searchsorted(at, np.arange(1, (int(n.max()) if len(n) else 0) + 2))
        head_at = np.searchsorted(heads, steps)
        for a, b, ga, gb in zip(steps[:-1], steps[1:], head_at[:-1], head_at[1:], strict=True):
            if a == b:
                continue
            v = alpha[src[a:b]] + score[a:b]
            r = heads[ga:gb] - a
            most = np.maximum.reduceat(v, r)
            g = group[a:b] - group[a]
            total = most + np.log(_sums(np.exp(v - most[g]), r))
            alpha[dst[heads[ga:gb]]] = total
            p_edge[a:b] = np.exp(v - total[g])
        # each place's own running sums: a sum over the chunk would round differently from place to place
        upto = p_edge.copy()
        tails = np.concatenate([heads[1:], [len(dst)]]) - 1 if len(heads) else heads
        on = heads[heads < tails] + 1
        while len(on):
            upto[on] += upto[on - 1]
            on = on[on < tails[group[on]]] + 1
        upto[tails] = 1.0
        self.upto, self.heads, self.src, self.item = upto, heads, src, item
        self.group = np.full(len(alpha), -1, np.int64)
        self.group[dst[heads]] = np.arange(len(heads))
        self.log_z = alpha

    def sample(self, occurrence: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each occurrence (a unit's number) with its 64-bit seed: items in order, and how many each has."""
        cur, who = self.end[occurrence], np.arange(len(occurrence))
        length = np.zeros(len(occurrence), np.int64)
        steps = []
        k = 0
        while len(who):
            u = (_mix(seed[who] + np.uint64(k * int(_P) & (2**64 - 1))) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            e = self.heads[self.group[cur]]
            on = np.nonzero(self.upto[e] <= u)[0]
            while len(on):  # the edge whose share of [0, 1) holds u
                e[on] += 1
                on = on[self.upto[e[on]] <= u[on]]
            steps.append((who, self.item[e]))
            length[who] += 1
            cur = self.src[e]
            going = self.group[cur] >= 0
            who, cur = who[going], cur[going]
            k += 1
        end = np.cumsum(length)
        out = np.empty(int(end[-1]) if len(end) else 0, np.int64)
        for k, (who, item) in enumerate(steps):
            out[end[who] - 1 - k] = item
        return out, length


def _bytes_out(items: np.ndarray, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Items as piece ids, and how many ids each item has."""
    size = np.ones(len(items), np.int64)
    bare = np.nonzero(items < 0)[0]
    if not len(bare):
        return items.astype(np.int32), size
    cp = -1 - items[bare]
    size[bare] = 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)
    out = np.repeat(items, size)
    at = (np.cumsum(size) - size)[bare]
    for i, c in zip(at.tolist(), cp.tolist(), strict=True) if len(bare) < 64 else ():
        b = chr(c).encode()
        out[i : i + len(b)] = p.byte_id[list(b)]
    if len(bare) >= 64:
        raw = np.frombuffer(cp.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        n = size[bare]
        place = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(len(raw))
        out[place] = p.byte_id[raw]
    return out.astype(np.int32), size


def encode_all(texts: list[str], keys: list[str], p: Pieces, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts, and how many each text has."""
    number: dict[str, int] = {}
    occurrence: list[int] = []
    counts = []
    for t in texts:
        units = _UNIT.findall(" " + t) if t else []
        counts.append(len(units))
        occurrence += [number.setdefault(u, len(number)) for u in units]
    if not occurrence:
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    counts = np.array(counts, np.int64)
    rows = np.array([xxhash.xxh64_intdigest(k.encode(), seed) for k in keys], np.uint64)
    first = np.cumsum(counts) - counts
    place = np.arange(len(occurrence)) - np.repeat(first, counts)
    seeds = _mix(np.repeat(rows, counts) + place.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    items, n = Lattice(list(number), p).sample(np.array(occurrence, np.int64), seeds)
    ids, size = _bytes_out(items, p)
    to = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(n)])]  # ids before each occurrence
    edges = to[np.concatenate([[0], np.cumsum(counts)])]
    return ids, np.diff(edges)


def decode_ids(ids: list[int], p: Pieces) -> bytes:
    return b"".join([p.bytes[i] for i in ids])[1:]


def _encode_batches(model: str, temperature: float, seed: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model, temperature)

        def done(keys: list, texts: list[str]) -> pa.RecordBatch:
            ids, n = encode_all(texts, ["" if k is None else f"k{k}" for k in keys], p, seed)
            at = np.concatenate([[0], np.cumsum(n)])
            listed = ids.tolist()
            same = [decode_ids(listed[a:b], p) == t.encode() for a, b, t in zip(at[:-1], at[1:], texts, strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids, pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(keys, kind), lists, pa.array(n, pa.int64()), pa.array(same)], ["key", "ids", "n_tokens", "lossless"])

        for b in batches:
            kind = b.column(0).type
            keys, texts, size = [], [], 0
            for k, t in zip(b.column(0), b.column(1), strict=True):
                t = t.as_py() or ""
                if texts and size + len(t) > CHUNK:
                    yield done(keys, texts)
                    keys, texts, size = [], [], 0
                keys.append(k.as_py()), texts.append(t)
                size += len(t)
            if texts:
                yield done(keys, texts)

    return run


def encode(docs: DataFrame, text: str = "text", key: str = "doc_id", model: str = MODEL, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """key, ids (array<int>), n_tokens, lossless (whether decoding the ids gave the text back)."""
    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key), F.col(text)).mapInArrow(_encode_batches(model, temperature, seed), f"key {kind}, ids array<int>, n_tokens long, lossless boolean")
    return out.withColumnRenamed("key", key)


def decode(encoded: DataFrame, ids: str = "ids", key: str = "doc_id", model: str = MODEL) -> DataFrame:
    """key and text."""
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model, 1.0)
        for b in batches:
            texts = [decode_ids(x.as_py() or [], p).decode() for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["key", "text"])

    return encoded.select(key, ids).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)
