"""Quality rules as a short-circuit cascade, in SQL functions only.

Every rule looks at a text through a few features. A sample of the table gives each rule's selectivity (the share it
rejects) and cost (measured seconds a text, without those of a run with no rule); the rules then run in the order of rejection per cost, and a text that one
rule rejects is not shown to the later ones (CASE WHEN stops at the first hit). The order changes the time, never the verdict.

NULL and empty texts have no words and fail the base rule; texts of any length are judged whole; an empty table gives no rows. Repeated rows are
judged alike, each by itself. Other columns, whatever their names, are carried along untouched, but for `judge`'s own: one named as its result is replaced.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words

MIN_WORDS = 50
MAX_REPEATED = 0.5
SYMBOL = "[#*$%&|<>]"
#: Rows that costs and selectivities are estimated on; verdicts cover every row.
SAMPLE_ROWS = 1500
TIMES = 3


@dataclass(frozen=True)
class Rule:
    """rejects: from the words, the lines and the text to a boolean."""

    name: str
    rejects: Callable[[Column, Column, Column], Column]


def _share(part: Column, whole: Column, most: float) -> Column:
    return part > whole * F.lit(most)


RULES = (
    Rule("symbols", lambda w, lines, t: _share(F.length(t) - F.length(F.regexp_replace(t, SYMBOL, "")), F.size(w), 0.3)),
    Rule("word_length", lambda w, lines, t: let(F.length(F.array_join(w, "")), lambda n: (n < F.size(w) * 2) | (n > F.size(w) * 20))),
    Rule("letters", lambda w, lines, t: F.size(F.filter(w, lambda x: x.rlike("\\p{L}"))) < F.size(w) * F.lit(0.7)),
    Rule("shouting", lambda w, lines, t: _share(F.length(F.regexp_replace(t, "[^A-Z]", "")), F.length(t), 0.5)),
    Rule("repeated_lines", lambda w, lines, t: _share(F.size(lines) - F.size(F.array_distinct(lines)), F.size(lines), 0.5)),
    Rule("bullets", lambda w, lines, t: (F.size(lines) > 3) & _share(F.size(F.filter(lines, lambda x: x.rlike("^[\\x20\\x09-\\x0D]*[-*•‣]"))), F.size(lines), 0.9)),
    Rule("ellipses", lambda w, lines, t: (F.size(lines) > 3) & _share(F.size(F.filter(lines, lambda x: x.rlike("(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*\\z"))), F.size(lines), 0.5)),
)


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))


def _repeat_words(w: Column) -> Column:
    """Words in 3-word windows that occur twice or more.

    The windows' hashes are sorted with their places; neighbours with equal hashes are the repeated windows. A text all of
    whose hashes differ (checked on plain longs first) needs no sort.
    """
    def repeated(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        def spread(s: Column) -> Column:
            same = lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i + 1 < F.size(s)) & (F.get(s, i + 1)["h"] == x["h"]))
            return F.size(F.array_distinct(F.flatten(F.transform(F.filter(s, same), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
        return let(placed, spread)

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(repeated(h)))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(some)


def base_features(text: Column) -> Column:
    """One struct of the counts that the base rule and its report need, the words split once."""
    t = F.coalesce(text, F.lit(""))
    return let(words(text), lambda w: let(_lines(text), lambda lines: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, SYMBOL, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeat_words(w).cast("long").alias("n_repeat_words"),
    )))


def rejected_by(text: Column, rules) -> Column:
    """The name of the first rule, in the given order, that rejects the text; NULL if none does."""
    t = F.coalesce(text, F.lit(""))

    def cascade(w: Column, lines: Column) -> Column:
        out = None
        for r in rules:
            hit = F.coalesce(r.rejects(w, lines, t), F.lit(False))
            out = F.when(hit, F.lit(r.name)) if out is None else out.when(hit, F.lit(r.name))
        return out

    return let(words(text), lambda w: let(_lines(text), lambda lines: cascade(w, lines)))


def sample_of(docs: DataFrame, column: str, rows: int = SAMPLE_ROWS, most: int = 8) -> DataFrame:
    """About that many rows, from at most `most` of the table's files, spread evenly over it: the estimate costs no second pass over the table."""
    spark, files = docs.sparkSession, docs.inputFiles()
    if len(files) > most:
        files = sorted(files)
        docs = spark.read.schema(docs.schema).parquet(*[files[(2 * i + 1) * len(files) // (2 * most)] for i in range(most)])
    total = docs.count()
    return docs.select(column).sample(min(1.0, rows / max(total, 1)), seed=7)


def ordered(docs: DataFrame, text: str = "text", rules=RULES, rows: int = SAMPLE_ROWS) -> list[dict]:
    """Each rule's cost and selectivity on a sample, best rejection per cost first.

    A job's own time would drown a rule's: the sample is gone through `TIMES` times in a job, the second of two such jobs is timed (the first compiles), and
    the time of the same job without a rule is taken off.
    """
    # sized once; the sample has a fixed number of rows however large the table is
    sample = sample_of(docs, text, rows).persist()
    often = sample.select(text, F.explode(F.sequence(F.lit(1), F.lit(TIMES))).alias("__time"))

    def timed(hit: Column) -> tuple[float, int]:
        for _ in range(2):
            began = time.perf_counter()
            hits = often.agg(F.sum(hit.cast("int"))).first()[0] or 0
            took = time.perf_counter() - began
        return took, hits

    try:
        total = max(sample.count(), 1) * TIMES
        idle, _ = timed(F.length(text) < 0)
        found = []
        for r in rules:
            took, hits = timed(rejected_by(F.col(text), [r]).isNotNull())
            found.append({"rule": r, "cost": max(took - idle, 1e-4) / total, "selectivity": hits / total})
    finally:
        sample.unpersist()
    return sorted(found, key=lambda x: (-x["selectivity"] / x["cost"], x["cost"]))


def base_failed(f: Column) -> Column:
    return (f["n_words"] < MIN_WORDS) | (f["n_repeat_words"] * 100 > f["n_words"] * int(100 * MAX_REPEATED))


def judge(docs: DataFrame, text: str = "text", rules=RULES, name: str = "quality") -> DataFrame:
    """Adds a struct `name`: the base counts, base_failed, rejected_by and kept. A text that fails the base rule meets no other."""
    order = [x["rule"] for x in ordered(docs, text, rules)]
    out = docs.withColumn("__base", base_features(F.col(text))).withColumn("__failed", base_failed(F.col("__base")))
    out = out.withColumn("__by", F.when(F.col("__failed"), F.lit("base")).otherwise(rejected_by(F.col(text), order)))
    return out.withColumn(name, F.struct("__base.*", F.col("__failed").alias("base_failed"), F.col("__by").alias("rejected_by"), F.col("__by").isNull().alias("kept"))).drop("__base", "__failed", "__by")


def keep(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The rows that no rule rejects, with the columns they came with."""
    order = [x["rule"] for x in ordered(docs, text, rules)]
    t = F.col(f"`{text}`")
    # one expression: a condition over columns made before it would repeat them wherever it names them
    return docs.where(let(base_features(t), lambda b: ~base_failed(b) & rejected_by(t, order).isNull()))
