"""Fuzzy line de-duplication over the whole table, in SQL functions only.

1. Every line that is not blank is normalised: lower case, and everything but letters, marks and digits one space; a line without any of these is
   itself, trimmed. Equal normalised lines collapse by a 128-bit hash, keeping their first place (file, row, position).
2. Candidates meet by MinHash of a line's different words. Of each of 16 orders a line has the first word; a long word comes first
   more often than a short one, as it is more of the line's text. Lines in scripts without spaces (over two bytes a
   character) have pairs of characters for words. Length doesn't change the rule. Lines are joined on the 20 lines of
   four points that the affine plane of 16 points has: if 10 of the 16 agree they always meet, and mostly with 8. Of lines
   that meet those are candidates that agree in 7 or more of the 16; similar lines hardly ever do in fewer.
   (SimHash, 64 bits: lines with a similarity of 0.8 are up to 14 bits apart, too many for selective blocks.)
3. Each line is paired with the one line that is first in most of its blocks; then, if not in one group with it yet, with the first of each
   block; then, twice, with the next of each block in an order by hash; then lines of a block that are not in one group yet with each other,
   each pair in the first of the blocks that both are in.
4. Pairs stand if the edit similarity of the normalised lines, 1 - distance / longer length, is at least 0.8. Texts are
   compared part by part first, which may find a larger distance, never a smaller one, and settles most similar pairs; where it finds too much,
   the whole distance decides, whatever the length.
5. Of each connected group one line stays, at its first place; the texts are put together from what is left.

No line's text is shuffled but of lines that have a candidate, and the documents once at the end.

A NULL text stays NULL, an empty one empty; blank lines stay; a text all of whose lines go keeps its blank lines, its row stays.
Repeated rows are rows of their own: the first keeps the lines. Extra columns are carried along. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, components, forget, keyed, let, tidy, written

SIMILARITY = 0.8
#: Ids of lines with their places (32 bytes each) that may be broadcast; with more of them both sides are shuffled.
FEW = 1_000_000
_GAP = "[^\\p{L}\\p{M}\\p{N}]+"
_EDGE = "^[\\x00-\\x20]+|[\\x00-\\x20]+$"
#: Characters between two marks, and of a mark: see `distance_by_parts`.
PART, MARK = 100, 16
#: Of the 16 first words, those that a pair must have in common.
AGREE = 7
#: Rounds of `next_pairs` before the rest of a block is paired.
TURNS = 2
#: A place as one number: file (62 bits), then row in the file and position in the text in a long.
_FILES = str(1 << 63)
_POSITIONS = 1 << 31


def eligible(line: Column) -> Column:
    return line.rlike("[^\\x00-\\x20]")


def normalised(line: Column) -> Column:
    """Empty for blank lines alone."""
    words = F.trim(F.regexp_replace(F.lower(line), _GAP, " "))
    return let(words, lambda w: F.when(w != "", w).otherwise(F.regexp_replace(line, _EDGE, "")))


def words_of(norm: Column) -> Column:
    pairs = F.regexp_extract_all(norm, F.lit("(?s)(?=(..))"), F.lit(1))
    return F.when((F.octet_length(norm) > 2 * F.length(norm)) & (F.length(norm) > 1), pairs).otherwise(F.split(norm, " "))


#: Orders of the words: each word's hash is compared after an exclusive or with one of these.
ORDERS = [int.from_bytes(hashlib.sha256(b"order %d" % k).digest()[:8], "big", signed=True) for k in range(16)]


def _plane() -> list[list[int]]:
    """The 20 lines of the affine plane over the field of four elements; point (x, y) is 4 x + y."""
    times = lambda a, b: 0 if not a or not b else (a + b - 2) % 3 + 1
    return [[4 * x + (times(m, x) ^ c) for x in range(4)] for m in range(4) for c in range(4)] + [[4 * x + y for y in range(4)] for x in range(4)]


PLANE = _plane()


def distinct_lines(rows: DataFrame, text: str = "text") -> DataFrame:
    """Each different normalised line: id, its first place (f, r, pos), size and the first words' hashes m0 .. m15.

    Words are unnested and aggregated by the line's hash where they are read, so that numbers alone are shuffled.
    """
    lines = rows.select("__row", F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line"))
    lines = lines.where(eligible(F.col("line"))).select("__row.f", (F.col("__row.r") * _POSITIONS + F.col("pos")).alias("rp"), normalised(F.col("line")).alias("norm"))
    lines = lines.select("f", "rp", F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(1), "norm").alias("h2"), F.length("norm").alias("size"), F.posexplode(words_of(F.col("norm"))).alias("k", "w"))
    # a word twice as long is four times as likely to come first, up to eight characters
    weight = F.least(F.floor(F.length("w") / 2), F.lit(4)).cast("int")
    lines = lines.select("f", "rp", "h1", "h2", "size", "k", F.xxhash64("w").alias("h"), (33 + weight).alias("down"))
    at = F.col("f").cast("decimal(19,0)") * F.lit(_FILES).cast("decimal(19,0)") + F.col("rp")
    least = [F.min(F.call_function("shiftrightunsigned", F.col("h").bitwiseXOR(F.lit(c)), F.col("down")).cast("int")).alias(f"m{i}") for i, c in enumerate(ORDERS)]
    got = lines.groupBy("h1", "h2", "size").agg(F.min(F.when(F.col("k") == 0, at.cast("decimal(38,0)"))).alias("at"), *least)
    rp = F.pmod("at", F.lit(_FILES).cast("decimal(19,0)")).cast("long")
    got = got.select("size", ((F.col("at") - rp) / F.lit(_FILES).cast("decimal(19,0)")).cast("long").alias("f"), rp.alias("rp"), *[f"m{i}" for i in range(len(ORDERS))])
    return got.select(F.monotonically_increasing_id().alias("id"), "f", F.floor(F.col("rp") / _POSITIONS).alias("r"), F.pmod("rp", F.lit(_POSITIONS)).cast("int").alias("pos"), "size", *[f"m{i}" for i in range(len(ORDERS))])


def hub_rows(posted: DataFrame) -> DataFrame:
    """id, size, block, hub, hub_size: of (id, size, blocks) all but the first of each block, with that first one."""
    by_block = Window.partitionBy("block").orderBy("id")
    rows = posted.select("id", "size", F.explode("blocks").alias("block"))
    rows = rows.select("*", F.first("id").over(by_block).alias("hub"), F.first("size").over(by_block).alias("hub_size"))
    return rows.where(F.col("id") != F.col("hub"))


def _blocks() -> Column:
    return F.array(*[F.xxhash64(F.lit(n), *[F.col(f"m{k}") for k in ks]) for n, ks in enumerate(PLANE)])


def blocks_of(lines: DataFrame) -> DataFrame:
    return lines.select("id", "size", _blocks().alias("blocks"))


def _lengths_near(size: str, size2: str, similarity: float) -> Column:
    return F.abs(F.col(size) - F.col(size2)) <= F.greatest(size, size2) * F.lit(round(1 - similarity, 9)) + F.lit(1e-9)


def hub_pairs(active: DataFrame, similarity: float) -> DataFrame:
    """Each line with its blocks' smallest, and `best` for the one that most of its blocks have."""
    near = active.where(_lengths_near("size", "hub_size", similarity)).groupBy("hub", "id").agg(F.count("*").alias("n"))
    best = near.groupBy("id").agg(F.max(F.col("n") * F.lit(1 << 57) - F.col("hub")).alias("most"))
    return near.join(best, "id").select(F.col("hub").alias("a"), F.col("id").alias("b"), (F.col("n") * F.lit(1 << 57) - F.col("hub") == F.col("most")).alias("best"))


def labels(found: DataFrame) -> DataFrame:
    """(node, root): each line that stands paired with a hub, and that hub, or the hub's own. Most of a group has one root then, without a search for components."""
    up = found.groupBy("b").agg(F.min("a").alias("a"))
    over = up.select(F.col("b").alias("a"), F.col("a").alias("top"))
    return up.join(over, "a", "left").select(F.col("b").alias("node"), F.coalesce("top", "a").alias("root"))


def still_apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) whose lines have not got one root yet."""
    side = lambda key: roots.select(F.col("node").alias(key), F.col("root").alias(f"root_{key}"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return both.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def merged(roots: DataFrame, found: DataFrame) -> DataFrame:
    """roots (node, root) after further pairs stood: their lines' roots are joined as `labels` joins lines. What that misses costs candidates that needn't be, no more."""
    side = lambda key: roots.select(F.col("node").alias(key), F.col("root").alias(f"root_{key}"))
    both = found.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("root_a", "a").alias("u"), F.coalesce("root_b", "b").alias("v"))
    up = checkpoint(labels(both.where("u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))))
    over = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
    known = roots.join(over, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return checkpoint(known.union(up.join(roots, "node", "left_anti")))


def with_roots(active: DataFrame, roots: DataFrame) -> DataFrame:
    """active with `root`, that of the line, and `top`, that of the block's hub."""
    side = lambda key, root: roots.select(F.col("node").alias(key), F.col("root").alias(root))
    both = active.join(side("id", "root"), "id", "left").join(side("hub", "top"), "hub", "left")
    return both.withColumns({"root": F.coalesce("root", "id"), "top": F.coalesce("top", "hub")})


def next_pairs(active: DataFrame, similarity: float, turn: int) -> DataFrame:
    """Lines next to each other in a block, in an order by hash of its own for each turn, that are not in one group yet: no more pairs than rows.

    A line that is near some of a large group, but not near its hub, may find one of it so, before `other_pairs` would pair it with all of it."""
    order = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(turn), "x.id"), "x.id")
    rows = active.select(F.struct("id", "size", "root", "s0", "s1").alias("x"), "block").select("x", F.lag("x").over(order).alias("y"))
    near = (F.col("x.root") != F.col("y.root")) & _lengths_near("x.size", "y.size", similarity) & (_agreeing("x", "y") >= AGREE)
    return rows.where(near).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def with_earlier(active: DataFrame, lines: DataFrame) -> DataFrame:
    """The rows of blocks that have a line outside their hub's group (no others have pairs left), with `earlier`: those of the line's blocks that come before the row's own in the plane."""
    left = active.join(active.where(F.col("root") != F.col("top")).select("block").distinct(), "block", "left_semi")
    both = left.join(lines.select("id", *[f"m{k}" for k in range(len(ORDERS))]), "id")
    earlier = let(_blocks(), lambda keys: F.slice(keys, F.lit(1), F.array_position(keys, F.col("block")).cast("int") - 1))
    return both.select(*left.columns, earlier.alias("earlier"))


def other_pairs(active: DataFrame, similarity: float, alike: Column | None = None) -> DataFrame:
    """Pairs of lines of a block that are not in one group (`root`) yet. One of such a pair is not in the group of the block's hub
    (`top`), and few are in a large block: they are joined with all, not all with all. alike: what else a pair must have, on the structs x and y of both rows' columns.

    With `earlier`, a pair comes from the first block that both lines are in, and from no other. Nothing is lost by that: where that block has no
    row of one of them, this one is its hub, and `hub_pairs` had the pair; where both rows are there, they are joined, as they have different roots."""
    x, y = F.struct(*[F.col(c) for c in active.columns]).alias("x"), F.struct(*[F.col(c) for c in active.columns]).alias("y")
    one, two = active.where(F.col("root") != F.col("top")).select("block", x), active.select("block", y)
    once = (F.col("y.root") == F.col("y.top")) | (F.col("x.id") < F.col("y.id"))
    near = once & (F.col("x.root") != F.col("y.root")) & _lengths_near("x.size", "y.size", similarity)
    on = (one["block"] == two["block"]) & near
    on = on if alike is None else on & alike
    if "earlier" in active.columns:
        return one.join(two, on & ~F.arrays_overlap("x.earlier", "y.earlier")).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    return one.join(two, on).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def distance_by_parts(x: Column, y: Column, most: Column) -> Column:
    """The edit distance, if it is found to be `most` at most; a larger number else.

    Marks out of x, one every `PART` characters, are looked for in y in order, near where they should be; the distances between one mark found and the
    next add up. That is never less than the distance itself, equal to it for texts of one part, and takes time by the length, not its square.
    """
    def distance(a: Column, b: Column) -> Column:
        """Of one part. A part without marks for long has nothing in common."""
        within = lambda t: F.call_function("levenshtein", a, b, t)
        far = let(within(most), lambda d: F.when(d < 0, most + 1).otherwise(d))
        # a small threshold, tried first, settles most parts at a fraction of the time
        d = let(within(F.least(F.lit(8), most)), lambda d: F.when(d < 0, far).otherwise(d))
        return let(F.greatest(F.length(a), F.length(b)), lambda size: F.when(size > 4 * PART, size).otherwise(d))

    def next_mark(z: Column, at: Column) -> Column:
        mark, ahead = F.substring(x, at + F.lit(1), F.lit(MARK)), at - z["x"]
        find = lambda start: F.call_function("locate", mark, y, start + F.lit(1)) - 1

        def step(q: Column) -> Column:
            near = (q >= z["y"]) & (q - z["y"] <= 2 * ahead + PART)
            part = distance(F.substring(x, z["x"] + F.lit(1), ahead), F.substring(y, z["y"] + F.lit(1), q - z["y"]))
            return F.when(near, F.struct(at.alias("x"), q.alias("y"), (z["sum"] + part).alias("sum"))).otherwise(z)

        # where nothing was put in or left out first: texts that repeat themselves have a mark many times
        due = let(find(z["y"] + F.greatest(F.lit(0), ahead - PART // 4)), lambda q: F.when((q >= 0) & (q - z["y"] <= ahead + PART // 4), q).otherwise(find(z["y"])))
        return F.when(z["sum"] > most, z).otherwise(let(due, step))

    marks = F.when(F.length(x) > PART + MARK, F.sequence(F.lit(PART), F.greatest(F.length(x) - MARK, F.lit(PART)), F.lit(PART))).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("sum"))
    rest = lambda z: F.when(z["sum"] > most, z["sum"]).otherwise(z["sum"] + distance(F.substring(x, z["x"] + F.lit(1), F.length(x)), F.substring(y, z["y"] + F.lit(1), F.length(y))))
    return F.aggregate(marks, start, next_mark, rest)


def sketches() -> list[Column]:
    """The 16 first words in two longs: six bits of each, in lanes of seven."""
    lane = lambda i, j: F.shiftleft(F.col(f"m{i}").bitwiseAND(F.lit(63)).cast("long"), 7 * j)
    return [sum((lane(8 * k + j, j) for j in range(1, 8)), lane(8 * k, 0)).alias(f"s{k}") for k in range(2)]


def _agreeing(x: str, y: str) -> Column:
    """How many of the 16 lanes are equal: a lane's seventh bit is set by adding 63 unless it is zero."""
    every = lambda v: F.lit(sum(v << 7 * j for j in range(8))).cast("long")
    other = lambda k: F.bit_count((F.col(f"{x}.s{k}").bitwiseXOR(F.col(f"{y}.s{k}")) + every(63)).bitwiseAND(every(64)))
    return F.lit(16) - other(0) - other(1)


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= FEW else df


def agreeing(pairs: DataFrame, places: DataFrame) -> DataFrame:
    """The pairs that agree in enough of the first words."""
    pairs = checkpoint(pairs)
    some = _of(pairs, places)
    side = lambda c, v: _few(some).select(F.col("id").alias(c), F.struct("s0", "s1").alias(v))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").where(_agreeing("x", "y") >= AGREE).select("a", "b")


def _of(pairs: DataFrame, places: DataFrame) -> DataFrame:
    """The places of the pairs' lines."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    return checkpoint(places.join(ids, "id", "left_semi"))


def verified(pairs: DataFrame, places: DataFrame, rows: DataFrame, text: str, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose lines have the similarity. Texts are read again from the rows; their places are sent there if they are few."""
    pairs = checkpoint(pairs)
    some = _of(pairs, places).select("id", "f", "r", "pos")
    lines = rows.select(F.col("__row.f").alias("f"), F.col("__row.r").alias("r"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line"))
    texts = checkpoint(lines.join(_few(some), ["f", "r", "pos"]).select("id", normalised(F.col("line")).alias("norm")))
    one = texts.select(F.col("id").alias("a"), F.col("norm").alias("x"))
    two = texts.select(F.col("id").alias("b"), F.col("norm").alias("y"))
    most = F.floor(F.greatest(F.length("x"), F.length("y")) * F.lit(round(1 - similarity, 9)) + F.lit(1e-9)).cast("int")
    both = pairs.join(one, "a").join(two, "b").withColumn("most", most).where(F.abs(F.length("x") - F.length("y")) <= F.col("most"))

    def near(d: Column) -> Column:
        # one part is the whole text
        whole = (F.length("x") > PART + MARK) & (F.call_function("levenshtein", F.col("x"), F.col("y"), F.col("most")) >= 0)
        return (d <= F.col("most")) | whole

    # bound inside the condition: as a column of its own it would be worked out anew wherever the pushed-down condition names it
    sure = let(distance_by_parts(F.col("x"), F.col("y"), F.col("most")), near)
    return both.where(sure).select("a", "b")


def groups(lines: DataFrame, rows: DataFrame, text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(node, root): the connected groups of lines with near texts that share a block.

    Hubs come first: each line is compared with one line, then with its blocks' smallest, which joins most of a group with no more
    pairs than rows. Only lines that are then in different groups are compared with each other, so a large group's pairs are never listed.
    """
    places = lines.select("id", "f", "r", "pos", *sketches())
    check = lambda pairs: checkpoint(verified(pairs, places, rows, text, similarity))
    active = written(hub_rows(blocks_of(lines)), "active")
    hubs = checkpoint(hub_pairs(active, similarity))
    tidy(lines.sparkSession)
    first = check(agreeing(hubs.where("best").select("a", "b"), places))
    stars = checkpoint(components(first, "a", "b"))
    found = check(agreeing(still_apart(hubs.where("not best").select("a", "b"), stars), places))
    roots = merged(stars, found)
    # the sketches come along, so that windows and the join itself tell which pairs agree in enough words
    sketched = checkpoint(active.join(places.select("id", "s0", "s1"), "id"))
    forget(active)
    for turn in range(TURNS):
        more = check(next_pairs(with_roots(sketched, roots), similarity, turn))
        roots, found = merged(roots, more), found.union(more)
        tidy(lines.sparkSession)
    rooted = checkpoint(with_roots(sketched, roots).drop("hub", "hub_size"))
    rooted = checkpoint(with_earlier(rooted, lines))
    third = check(other_pairs(rooted, similarity, _agreeing("x", "y") >= AGREE))
    # what only the rounds needed goes before the search for components
    del active, hubs, sketched, rooted, roots, more
    tidy(lines.sparkSession)
    return components(stars.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")).union(found).union(third), "a", "b")


def dedup(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs with `text` reduced to the lines that stay, and __removed, the number of lines that went."""
    docs, columns = keyed(docs), docs.columns
    rows = docs.select("__row", F.col(text))
    lines = written(distinct_lines(rows, text), "lines")
    lost = groups(lines, rows, text, similarity).where(F.col("node") != F.col("root")).select(F.col("node").alias("id"))
    kept = lines.select("id", "f", "r", "pos").join(lost, "id", "left_anti")
    kept = kept.groupBy(F.struct("f", "r").alias("__row")).agg(F.collect_list("pos").alias("__pos"))
    whole = F.split(F.col(text), "\n", -1)

    def put_together(x: Column) -> Column:
        free = F.filter(F.transform(x, lambda s, i: F.when(~eligible(s), i)), lambda i: i.isNotNull())
        stay = F.array_sort(F.concat(F.coalesce(F.col("__pos"), F.array().cast("array<int>")), free))
        return F.struct(F.array_join(F.transform(stay, lambda i: F.get(x, i)), "\n").alias("text"), (F.size(x) - F.size(stay)).alias("removed"))

    out = docs.join(kept.hint("shuffle_hash"), "__row", "left").withColumn("__new", let(whole, put_together))
    columns = [F.col("__new.text").alias(text) if c == text else F.col(f"`{c}`") for c in columns]
    return out.select(*columns, F.coalesce("__new.removed", F.lit(0)).cast("long").alias("__removed"))
