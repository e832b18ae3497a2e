"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint has 8 positional bytes. Two fingerprints that differ in at most 2 bits differ in at most 2 bytes, so they share
at least 6 of them: the guaranteed minimum. A list for each single (position, byte) would hold 1/256 of all fingerprints, so
the index intersects lists beforehand: the positions form four couples, and a fingerprint is posted under the bytes of each
two couples, 6 lists in all. Two bytes touch at most two couples, so fingerprints that share 6 bytes meet in a list. There the
shared positional bytes of each pair are tallied, pairs that reach 6 are retained, and these are verified on their bits.

A list with more than `DENSE` members is tallied by its own index: those that share 2 of the 4 other bytes form sublists, and in
a sublist, where only 2 bytes vary, each member looks up its 137 neighbours within 2 bits. That finds the same pairs in time
in proportion to the list. Lists with more than `CROWDED` members, the hot ones, are split into such sublists before anything is
gathered; a sublist has at most 65,536 different fingerprints, whatever the table's size. Each member gets one link to its class's
smallest, not all pairs. Equal fingerprints are one entry of the index.

NULL and empty texts have fingerprint zero, linked like any other. Texts of any length are read whole. Repeated rows are separate rows of one class. A NULL doc_id
never names a component unless the component has no other. Extra columns are ignored; an empty table gives no rows.

`dedup` is for corpora: near duplicates there are texts whose sets of different 5-word shingles have a Jaccard similarity of 0.8 or more. Texts
that similar are 10 bits apart on average, so the index above finds a part of them only; the others meet by MinHash (16 orders, the 20 blocks of
`line_dedup`; if 10 of 16 agree they always meet). Every candidate is verified on the sets themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, components, keyed, tidy, written
from .line_dedup import FEW, ORDERS, PLANE, hub_pairs, hub_rows, merged, other_pairs, still_apart, with_roots

SEED = 42
SHINGLE = 3
MAX_BITS = 2
#: Shared positional bytes that two fingerprints within MAX_BITS have at least.
MIN_SHARED = 8 - MAX_BITS
DENSE = 64
CROWDED = 1 << 16
SIMILARITY = 0.8
WIDE_SHINGLE = 5
_CHUNK = 255 * 256


def shingles(text: bytes, n: int = SHINGLE) -> list[bytes]:
    w = text.lower().split()
    if len(w) < n:
        return [b" ".join(w)] if w else []
    if n == 3:
        return [b"%b %b %b" % x for x in zip(w, w[1:], w[2:], strict=False)]
    return [b" ".join(x) for x in zip(*(w[i:] for i in range(n)), strict=False)]


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits; bytes are summed 255 at a time so that no sum overflows a byte."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        h = hashes[at : at + _CHUNK]
        h = np.concatenate([h, np.zeros(-len(h) % 255, np.uint64)])
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return total


def bits_of(h: np.ndarray) -> int:
    """The fingerprint of shingles with these hashes, as a signed 64-bit number."""
    if not len(h):
        return 0
    bits = (2 * bit_counts(h) > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def hashes(text: bytes | None, n: int = SHINGLE) -> np.ndarray:
    s = shingles(text or b"", n)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(x, SEED) for x in s), np.uint64, len(s))


def fingerprint(text: bytes | None) -> int:
    return bits_of(hashes(text))


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).cast(pa.binary())
        fp = [fingerprint(x.as_py()) for x in texts]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, fp for each row."""
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), F.col(text)).mapInArrow(_fingerprints, f"doc_id {kind}, fp long")


#: Each choice of 2 of the 4 couples of positions: the 4 positions that vary in its lists.
_VARYING = [(2 * i, 2 * i + 1, 2 * j, 2 * j + 1) for i, j in combinations(range(4), 2)]
#: Each choice of 2 varying positions, for sublists.
_TWO = list(combinations(range(8), 2))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _agreeing(varying: tuple[int, ...]) -> int:
    return _signed(~sum(255 << 8 * i for i in varying) & (2**64 - 1))


def postings(fps: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """The index's lists with more than one member: varying (the positions that vary), key, members."""
    def keys(choices: list) -> Column:
        return F.array(*[F.struct(F.array(*[F.lit(i).cast("byte") for i in v]).alias("varying"), F.col("fp").bitwiseAND(F.lit(_agreeing(v))).alias("key")) for v in choices])

    # a fingerprint is few bytes, its postings are not: dealt out before they are made
    parts = max(2, int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    fps = checkpoint(fps.repartition(parts, "fp"))
    posted = fps.select("fp", F.inline(keys(_VARYING)))
    hot = checkpoint(posted.groupBy("varying", "key").agg(F.count("*").alias("n")).where(F.col("n") > crowded).drop("n"))
    n_hot = hot.count()
    if n_hot:
        hot = F.broadcast(hot) if n_hot <= FEW else hot
        heavy = posted.join(hot, ["varying", "key"], "left_semi").select("fp").distinct()
        posted = posted.join(hot, ["varying", "key"], "left_anti").unionByName(heavy.select("fp", F.inline(keys(_TWO))))
    return posted.groupBy("varying", "key").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1).select("varying", "members")


_NEAR = np.array([0] + [sum(1 << b for b in x) for n in (1, 2) for x in combinations(range(16), n)], np.int32)


def tallied(members: np.ndarray, varying: tuple[int, ...]) -> np.ndarray:
    """Pairs (places in members) that share at least MIN_SHARED positional bytes and differ in at most MAX_BITS bits."""
    raw = members.view(np.uint8).reshape(-1, 8)[:, list(varying)]
    shared = np.full((len(members), len(members)), 8 - len(varying))
    for k in range(len(varying)):
        shared += raw[:, k, None] == raw[None, :, k]
    a, b = np.nonzero(np.triu(shared >= MIN_SHARED, 1))
    near = np.bitwise_count(members[a] ^ members[b]) <= MAX_BITS
    return np.stack([a[near], b[near]], axis=1)


def tabled(members: np.ndarray, varying: tuple[int, int]) -> np.ndarray:
    """The same for members that differ in two bytes only: each has a place in a table of these 16 bits. Pairs come twice."""
    i, j = varying
    low = (((members >> np.uint64(8 * i)) & np.uint64(255)) | (((members >> np.uint64(8 * j)) & np.uint64(255)) << np.uint64(8))).astype(np.int32)
    place = np.full(1 << 16, -1, np.int32)
    place[low] = np.arange(len(members), dtype=np.int32)
    near = place[low[:, None] ^ _NEAR[None, 1:]]
    a, k = np.nonzero(near >= 0)
    return np.stack([a, near[a, k]], axis=1)


def pairs_of(members: np.ndarray, varying: tuple[int, ...], dense: int = DENSE) -> np.ndarray:
    if len(members) <= dense:
        return tallied(members, varying)
    if len(varying) == 2:
        return tabled(members, varying)
    found = [np.zeros((0, 2), np.int64)]
    for two in combinations(varying, 2):
        key = members & np.uint64(_agreeing(two) & (2**64 - 1))
        order = np.argsort(key)
        edges = np.nonzero(np.diff(key[order]))[0] + 1
        for part in np.split(order, edges):
            if len(part) > 1:
                found.append(part[pairs_of(members[part], two, dense)])
    return np.concatenate(found)


def link(members: np.ndarray, varying: tuple[int, ...], dense: int = DENSE) -> list[tuple[int, int]]:
    """For each member with a neighbour within MAX_BITS bits, a link to the smallest member it can reach in this list."""
    members = np.sort(members)
    pairs = pairs_of(members.view(np.uint64), varying, dense)
    root = np.arange(len(members))
    a, b = np.concatenate([pairs, pairs[:, ::-1]]).T if len(pairs) else (root[:0], root[:0])
    while True:
        least = root.copy()
        np.minimum.at(least, a, root[b])
        least = least[least]
        if (least == root).all():
            break
        root = least
    hit = np.nonzero(root != np.arange(len(members)))[0]
    return list(zip(members[hit].tolist(), members[root[hit]].tolist(), strict=True))


def _links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found: list[tuple[int, int]] = []
        for varying, members in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            found += link(np.array(members.values), tuple(varying))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def linked(fps: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Links (a, b) between different fingerprints: every class of the whole relation is one component of them."""
    return postings(fps, crowded).mapInArrow(_links, "a long, b long")


def classes(rows: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """From (doc_id, fp): for each fp its class and, the same for the whole class, `first`: the smallest doc_id, NULL last."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first")
    reps = checkpoint(rows.groupBy("fp").agg(first))
    found = components(linked(reps.select("fp"), crowded), "a", "b")
    reps = reps.join(found, reps["fp"] == found["node"], "left").select("fp", F.coalesce("root", "fp").alias("class"), "first")
    top = reps.groupBy("class").agg(F.min("first").alias("first"))
    return reps.select("fp", "class").join(top, "class")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", crowded: int = CROWDED) -> DataFrame:
    """One row a document: doc_id, fp and component_id (the class's smallest doc_id)."""
    rows = checkpoint(fingerprints(docs, text, key))
    return rows.join(classes(rows, crowded), "fp").select("doc_id", "fp", F.col("first.doc_id").alias("component_id"))


# ---- near duplicates by the similarity of their sets of shingles

_ORDERS = np.array(ORDERS, np.int64).view(np.uint64)


def _signatures(n: int):
    def go(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, same, prints, blocks = [], [], [], []
            for t in b.column(2).cast(pa.binary()):
                h = np.unique(hashes(t.as_py(), n))
                size.append(len(h))
                same.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                prints.append(bits_of(h))
                least = np.array([(h ^ c).min() for c in _ORDERS]) if len(h) else None
                blocks.append([] if least is None else [xxhash.xxh64_intdigest(least[ks].tobytes(), k) - (1 << 63) for k, ks in enumerate(PLANE)])
            columns = [b.column(0), b.column(1), pa.array(size, pa.int32()), pa.array(same, pa.binary()), pa.array(prints, pa.int64()), pa.array(blocks, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["__row", "doc_id", "size", "same", "fp", "blocks"])

    return go


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if both else 0.0


def _alike(least: float, n: int):
    def go(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = zip(b.column(2).cast(pa.binary()), b.column(3).cast(pa.binary()), strict=True)
            ok = pa.array([similarity(np.unique(hashes(x.as_py(), n)), np.unique(hashes(y.as_py(), n))) >= least for x, y in pairs], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], ["a", "b"])

    return go


def verified(pairs: DataFrame, places: DataFrame, rows: DataFrame, least: float, n: int) -> DataFrame:
    """The pairs (a, b) whose texts have the similarity. Their places are sent to the rows if they are few."""
    pairs = checkpoint(pairs)
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    some = checkpoint(places.join(ids, "id", "left_semi"))
    texts = checkpoint(rows.join(F.broadcast(some) if some.count() <= FEW else some, "__row").select("id", "text"))
    parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    both = pairs.repartition(parts, "a").join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b")
    return both.select("a", "b", "x", "y").mapInArrow(_alike(least, n), "a long, b long")


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = SIMILARITY, n: int = WIDE_SHINGLE) -> DataFrame:
    """One document of each group of near duplicates, the smallest key's, with the columns it came with.

    Texts with equal sets of shingles are one from the start; a text of fewer words than a shingle is one shingle; NULL and empty texts are equal.
    A row without a key stays only where its group has no other.
    """
    docs, columns = keyed(docs), docs.columns
    rows = docs.select("__row", F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    signed = rows.mapInArrow(_signatures(n), f"__row struct<f: bigint, r: bigint>, doc_id {kind}, size int, same binary, fp long, blocks array<long>")
    signed = written(signed.select(F.monotonically_increasing_id().alias("id"), "*"), "signatures")
    reps = checkpoint(signed.groupBy("same").agg(F.min("id").alias("rep")))
    one = signed.join(reps.select(F.col("rep").alias("id")), "id", "left_semi")
    places, rows = signed.select("id", "__row"), rows.select("__row", "text")
    # by the fingerprints: each text with the first that has its own, and those with the ones the index links them to
    prints = checkpoint(one.groupBy("fp").agg(F.min("id").alias("first")))
    side = lambda fp, name: prints.select(F.col("fp").alias(fp), F.col("first").alias(name))
    by_print = one.join(prints, "fp").where("id != first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    by_index = linked(prints.select("fp")).join(side("a", "x"), "a").join(side("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    # by MinHash: each text with its blocks' smallest, then those still apart
    active = written(hub_rows(one.select("id", "size", "blocks")), "active")
    hubs = checkpoint(hub_pairs(active, least))
    tidy(docs.sparkSession)
    check = lambda pairs: checkpoint(verified(pairs, places, rows, least, n))
    found = check(hubs.where("best").select("a", "b").union(by_print).union(by_index).distinct())
    stars = checkpoint(components(found, "a", "b"))
    more = check(still_apart(hubs.where("not best").select("a", "b"), stars))
    last = check(other_pairs(checkpoint(with_roots(active, merged(stars, more))), least))
    found = components(stars.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")).union(more).union(last), "a", "b")
    members = signed.select("id", "__row", "doc_id", "same").join(reps, "same").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id", "__row")).alias("first")
    kept = members.groupBy(F.coalesce("root", "rep").alias("class")).agg(first).select("first.__row")
    return docs.join(kept, "__row", "left_semi").select(*[F.col(f"`{c}`") for c in columns])
