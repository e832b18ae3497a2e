"""Discrimination and stability statistics as grouped aggregations.

All of them work on a table of different values (value, counts), made by one aggregation that combines in the scan. What needs a
global order (running counts, quantiles) runs in two levels: values fall into order-preserving bands (64 an octave), running
totals over the bands' few rows give each band's offset, and the order within a band is the business of its own task. No
statistic sorts all values in one task, and `by` (one candidate's key, or several columns) makes one job of many samples.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import finite

SMOOTH, GUARD, FLOOR = 0.5, 1e-9, 1e-6
BINS = 10


def band(v: Column) -> Column:
    """A whole number that never falls as v rises."""
    size = F.floor(F.log2(F.abs(v)) * 64) + 100_000
    return F.when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size).cast("int")


def value_table(rows: DataFrame, value: str, by: Sequence[str] = (), **counts: Column) -> DataFrame:
    """by..., v, and the sum of each count over the rows that have the value; NULL and non-finite values are left out."""
    v = F.col(value).cast("double")
    return rows.where(finite(F.col(value))).groupBy(*by, (v + F.lit(0.0)).alias("v")).agg(*[F.sum(c).cast("double").alias(n) for n, c in counts.items()])


def running(table: DataFrame, by: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """Adds, for each count c: c_before (the sum over smaller values) and c_all (over the whole group)."""
    table = table.withColumn("band", band(F.col("v")))
    whole = Window.partitionBy(*by)
    lower = whole.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    bands = table.groupBy(*by, "band").agg(*[F.sum(c).alias(c) for c in counts])
    bands = bands.select(*by, "band", *[F.coalesce(F.sum(c).over(lower), F.lit(0.0)).alias(f"{c}_below") for c in counts], *[F.sum(c).over(whole).alias(f"{c}_all") for c in counts])
    inside = Window.partitionBy(*by, "band").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    table = table.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0.0)).alias(f"{c}_inside") for c in counts]).join(bands, [*by, "band"])
    return table.select(*by, "band", "v", *counts, *[(F.col(f"{c}_below") + F.col(f"{c}_inside")).alias(f"{c}_before") for c in counts], *[f"{c}_all" for c in counts])


def quantiles(ranked: DataFrame, by: Sequence[str], count: str, bins: int) -> DataFrame:
    """by..., edges: the different values of the quantiles 0, 1/bins ... 1, by linear interpolation, ascending."""
    first, last = F.col(f"{count}_before"), F.col(f"{count}_before") + F.col(count)

    def at(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank < last), F.col("v")))

    points, parts = [], []
    for k in range(bins + 1):
        place = (F.col(f"{count}_all") - 1) * F.lit(k / bins)
        low = F.floor(place)
        points += [at(low).alias(f"lo{k}"), at(F.ceil(place)).alias(f"hi{k}")]
        parts.append(F.max(place - low).alias(f"t{k}"))
    got = ranked.where(F.col(count) > 0).groupBy(*by).agg(*points, *parts)
    edges = [F.when(F.col(f"t{k}") == 0, F.col(f"lo{k}")).otherwise(F.col(f"lo{k}") + (F.col(f"hi{k}") - F.col(f"lo{k}")) * F.col(f"t{k}")) for k in range(bins + 1)]
    return got.select(*by, F.array_sort(F.array_distinct(F.array(*edges))).alias("edges"))


def bin_of(v: Column, edges: Column) -> Column:
    """How many of the inner edges are at most v."""
    inner = F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0)))
    return F.size(F.filter(inner, lambda e: e <= v))


def _keyed(rows: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str], bool]:
    return (rows, list(by), False) if by else (rows.withColumn("__all", F.lit(0)), ["__all"], True)


def score(rows: DataFrame, value: str, label: str, by: Sequence[str] = (), bins: int = BINS) -> DataFrame:
    """One row a group: n, n_pos, iv, ks, gini, trigger (the mean of a value that is only 0 or 1, else NULL).

    iv: equal-frequency bins by the quantiles' different values; a 0/1 value has two bins. Occupied bins only, half a case added to
    each. ks: the largest distance of the classes' distribution functions, 0 if a class is empty. gini: 2 AUC - 1, ties by half.
    """
    rows, keys, alone = _keyed(rows.where(F.col(label).isNotNull()), by)
    hit = (F.col(label) != 0).cast("double")
    as_number = rows.withColumn("__v", F.col(value).cast("double"))
    out = score_table(value_table(as_number, "__v", keys, pos=hit, neg=1 - hit), keys, bins)
    return out.drop("__all") if alone else out


def score_table(table: DataFrame, keys: Sequence[str], bins: int = BINS) -> DataFrame:
    """score of a table of different values: keys..., v, pos, neg."""
    ranked = running(table.withColumn("n", F.col("pos") + F.col("neg")).where("n > 0"), keys, ["pos", "neg", "n"])
    edges = quantiles(ranked, keys, "n", bins)
    two = ranked.groupBy(*keys).agg(F.min("v").alias("lowest"), F.max("v").alias("highest"), F.max(F.when(~F.col("v").isin(0.0, 1.0), 1).otherwise(0)).alias("other"))
    binned = ranked.join(edges.join(two, keys), keys).withColumn("bin", F.when(F.col("other") == 0, F.col("v").cast("int")).otherwise(bin_of(F.col("v"), F.col("edges"))))
    p = (F.col("pos") + SMOOTH) / (F.col("pos_all") + GUARD)
    q = (F.col("neg") + SMOOTH) / (F.col("neg_all") + GUARD)
    iv = binned.groupBy(*keys, "bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.max("pos_all").alias("pos_all"), F.max("neg_all").alias("neg_all"))
    iv = iv.withColumns({"p": p, "q": q}).groupBy(*keys).agg(F.sum((F.col("p") - F.col("q")) * F.ln(F.col("p") / F.col("q"))).alias("iv"))
    above = F.abs((F.col("pos_before") + F.col("pos")) * F.try_divide(F.lit(1.0), F.col("pos_all")) - (F.col("neg_before") + F.col("neg")) * F.try_divide(F.lit(1.0), F.col("neg_all")))
    wins = F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)
    rest = ranked.groupBy(*keys).agg(
        F.sum("n").cast("long").alias("n"), F.sum("pos").cast("long").alias("n_pos"), F.coalesce(F.max(above), F.lit(0.0)).alias("ks"),
        F.coalesce(F.try_divide(2 * F.sum(wins), F.max("pos_all") * F.max("neg_all")) - 1, F.lit(0.0)).alias("gini"),
        F.when(F.max(F.when(~F.col("v").isin(0.0, 1.0), 1).otherwise(0)) == 0, F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("trigger"),
    )
    return rest.join(iv, keys)


def divergence(rows: DataFrame, value: str, side: str, by: Sequence[str] = (), bins: int = BINS) -> DataFrame:
    """psi, kl and n_expected, n_actual of the rows with side = 'actual' against those with side = 'expected'.

    Bins by the expected side's quantiles, the last one closed; actual values outside of them count nowhere. Shares are of counts plus a
    millionth. NaN if a side is empty, 0 if there are fewer than three different edges.
    """
    rows, keys, alone = _keyed(rows, by)
    expected = (F.col(side) == "expected").cast("double")
    out = divergence_table(value_table(rows, value, keys, e=expected, a=1 - expected), keys, bins)
    return out.drop("__all") if alone else out


def divergence_table(table: DataFrame, keys: Sequence[str], bins: int = BINS) -> DataFrame:
    """divergence of a table of different values: keys..., v, e (expected), a (actual)."""
    ranked = running(table, keys, ["e", "a"])
    edges = quantiles(ranked, keys, "e", bins)
    sums = ranked.groupBy(*keys).agg(F.sum("e").alias("ne"), F.sum("a").alias("na"))
    binned = ranked.join(edges, keys).where((F.col("v") >= F.element_at("edges", 1)) & (F.col("v") <= F.element_at("edges", -1)))
    got = binned.groupBy(*keys, "edges", bin_of(F.col("v"), F.col("edges")).alias("bin")).agg(F.sum("e").alias("e"), F.sum("a").alias("a"))
    got = got.groupBy(*keys, "edges").agg(F.collect_list(F.struct("bin", "e", "a")).alias("got"))  # at most `bins` entries
    full = F.transform(F.sequence(F.lit(0), F.greatest(F.size("edges") - 2, F.lit(0))), lambda k: F.coalesce(F.get(F.filter("got", lambda x: x["bin"] == k), 0), F.struct(k.alias("bin"), F.lit(0.0).alias("e"), F.lit(0.0).alias("a"))))
    got = got.withColumn("full", full)
    total = lambda c: F.aggregate("full", F.lit(0.0), lambda s, x: s + x[c] + FLOOR)
    got = got.withColumns({"te": total("e"), "ta": total("a")})
    p, q = lambda x: (x["e"] + FLOOR) / F.col("te"), lambda x: (x["a"] + FLOOR) / F.col("ta")
    psi = F.aggregate("full", F.lit(0.0), lambda s, x: s + (p(x) - q(x)) * F.ln(p(x) / q(x)))
    kl = F.aggregate("full", F.lit(0.0), lambda s, x: s + p(x) * F.ln(p(x) / q(x)))
    few = F.size("edges") < 3
    got = got.select(*keys, F.when(few, 0.0).otherwise(psi).alias("psi"), F.when(few, 0.0).otherwise(kl).alias("kl"))
    empty = (F.col("ne") == 0) | (F.col("na") == 0)
    return sums.join(got, keys, "left").select(
        *keys, *[F.when(empty, float("nan")).otherwise(F.col(c)).alias(c) for c in ("psi", "kl")], F.col("ne").cast("long").alias("n_expected"), F.col("na").cast("long").alias("n_actual")
    )


def wasserstein(rows: DataFrame, value: str, side: str, by: Sequence[str] = ()) -> DataFrame:
    """The area between the two sides' distribution functions; NaN if a side is empty. Gaps inside a band are summed there, gaps between bands over the bands."""
    rows, keys, alone = _keyed(rows, by)
    expected = (F.col(side) == "expected").cast("double")
    ranked = running(value_table(rows, value, keys, e=expected, a=1 - expected), keys, ["e", "a"])
    apart = F.abs(F.try_divide(F.col("e_before") + F.col("e"), F.col("e_all")) - F.try_divide(F.col("a_before") + F.col("a"), F.col("a_all")))
    inside = Window.partitionBy(*keys, "band").orderBy("v")
    ranked = ranked.withColumns({"apart": apart, "gap": F.lead("v").over(inside) - F.col("v")})
    bands = ranked.groupBy(*keys, "band").agg(F.sum(F.col("gap") * F.col("apart")).alias("area"), F.min("v").alias("low"), F.max(F.struct("v", "apart")).alias("high"), F.max("e_all").alias("e_all"), F.max("a_all").alias("a_all"))
    nxt = F.lead("low").over(Window.partitionBy(*keys).orderBy("band"))
    bands = bands.withColumn("between", (nxt - F.col("high.v")) * F.col("high.apart"))
    empty = (F.max("e_all") == 0) | (F.max("a_all") == 0)
    out = bands.groupBy(*keys).agg(F.when(empty, float("nan")).otherwise(F.coalesce(F.sum("area"), F.lit(0.0)) + F.coalesce(F.sum("between"), F.lit(0.0))).alias("wasserstein"))
    return out.drop("__all") if alone else out


def ranks(rows: DataFrame, value: str, by: Sequence[str], as_: str) -> DataFrame:
    """rows with the average rank of `value` in its group; rows without a finite value have NULL."""
    table = running(value_table(rows, value, by, n=F.lit(1.0)), by, ["n"])
    table = table.select(*by, F.col("v").alias("__v"), (F.col("n_before") + (F.col("n") + 1) / 2).alias(as_))
    keyed = rows.withColumn("__v", F.when(finite(F.col(value)), F.col(value).cast("double") + F.lit(0.0)))
    return keyed.join(table, [*by, "__v"], "left").drop("__v")


def correlation(rows: DataFrame, x: str, y: str, by: Sequence[str] = (), as_: str = "spearman") -> DataFrame:
    """Pearson's correlation, 0 for fewer than 5 pairs or a constant side."""
    rows = rows.where(finite(F.col(x)) & finite(F.col(y)))
    flat = (F.stddev_pop(x) == 0) | (F.stddev_pop(y) == 0) | (F.count(F.lit(1)) < 5)
    safe = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return rows.groupBy(*by).agg(F.when(flat, 0.0).otherwise(safe).alias(as_), F.count(F.lit(1)).alias("n"))


def spearman(rows: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank correlation over the rows where both are finite: spearman, n."""
    rows, keys, alone = _keyed(rows.where(finite(F.col(x)) & finite(F.col(y))), by)
    out = correlation(ranks(ranks(rows, x, keys, "__rx"), y, keys, "__ry"), "__rx", "__ry", keys)
    return out.drop("__all") if alone else out


def monotonicity(rows: DataFrame, value: str, label: str, by: Sequence[str] = (), bins: int = 5) -> DataFrame:
    """How steadily the event rate moves with the value: for a 0/1 value the distance of both rates, else |rank correlation| of bin number and event rate, 0 unless 5 bins are occupied."""
    rows, keys, alone = _keyed(rows.where(F.col(label).isNotNull()), by)
    hit = (F.col(label) != 0).cast("double")
    out = monotonicity_table(value_table(rows.withColumn("__v", F.col(value).cast("double")), "__v", keys, pos=hit, n=F.lit(1.0)), keys, bins)
    return out.drop("__all") if alone else out


def monotonicity_table(table: DataFrame, keys: Sequence[str], bins: int = 5) -> DataFrame:
    """monotonicity of a table of different values: keys..., v, pos, n."""
    ranked = running(table.where("n > 0"), keys, ["pos", "n"])
    other = ranked.groupBy(*keys).agg(F.max(F.when(~F.col("v").isin(0.0, 1.0), 1).otherwise(0)).alias("other"))
    binned = ranked.join(quantiles(ranked, keys, "n", bins).join(other, keys), keys)
    binned = binned.withColumn("bin", F.when(F.col("other") == 0, F.col("v").cast("int")).otherwise(bin_of(F.col("v"), F.col("edges"))))
    rates = binned.groupBy(*keys, "other", "bin").agg((F.sum("pos") / F.sum("n")).alias("rate"))
    g = Window.partitionBy(*keys)  # a group has at most `bins` rows here
    rates = rates.withColumn("rb", F.rank().over(g.orderBy("bin")).cast("double")).withColumn("rr", F.rank().over(g.orderBy("rate")) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, "rate")) - 1) / 2)
    two = F.max(F.when(F.col("bin") == 1, F.col("rate"))) - F.max(F.when(F.col("bin") == 0, F.col("rate")))
    flat = (F.stddev_pop("rr") == 0) | (F.count(F.lit(1)) < 5)
    rho = F.when(flat, 0.0).otherwise(F.try_divide(F.covar_pop("rb", "rr"), F.stddev_pop("rb") * F.stddev_pop("rr")))
    return rates.groupBy(*keys).agg(F.when(F.max("other") == 0, F.coalesce(F.abs(two), F.lit(0.0))).otherwise(F.abs(rho)).alias("monotonicity"))
