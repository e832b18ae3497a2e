"""From Markdown files to chunks, in SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rewrites that leave plain text, in their order: pattern and what stays.
REWRITES = (
    ("\\A---[ \\t]*\\n(?s:.*?)\\n---[ \\t]*\\n", ""),
    ("\\[([^\\]]+)\\]\\([^)]+\\)", "$1"),
    ("`([^`]+)`", "$1"),
    ("\\*\\*([^*]+)\\*\\*", "$1"),
    ("\\*([^*]+)\\*", "$1"),
    ("(?m)^\\s*[-*+]\\s+", ""),
    ("(?m)^\\s*[0-9]+\\.\\s+", ""),
    ("(?m)^#+\\s+", ""),
    ("\\s+", " "),
)


def plain(text: Column) -> Column:
    """Markdown without its marks; the words of headings stay."""
    for pattern, stays in REWRITES:
        text = F.regexp_replace(text, pattern, stays)
    return F.trim(text)


def chunks(text: Column) -> Column:
    """array<struct<headings, text>>: one chunk for each heading that has a body, and one for what comes before the first heading.

    Each carries the path of headings above it, and begins with their words.
    """
    body = F.regexp_replace(text, REWRITES[0][0], "")
    parts = F.split(F.concat(F.lit("\n"), body), "(?m)(?=^#+[ \\t]+\\S)")
    head = lambda p: F.regexp_extract(p, "\\A(#+)[ \\t]+([^\\n]*)", 1)
    title = lambda p: F.trim(F.regexp_extract(p, "\\A(#+)[ \\t]+([^\\n]*)", 2))
    rest = lambda p: plain(F.regexp_replace(p, "\\A#+[ \\t]+[^\\n]*\\n?", ""))
    cut = F.transform(parts, lambda p: F.struct(F.length(head(p)).alias("level"), title(p).alias("title"), rest(p).alias("body")))
    path_type = "array<struct<level:int,title:string>>"
    start = F.struct(F.array().cast(path_type).alias("path"), F.array().cast("array<struct<headings:array<string>,text:string>>").alias("out"))

    def step(s: Column, c: Column) -> Column:
        path = F.when(c["level"] > 0, F.concat(F.filter(s["path"], lambda h: h["level"] < c["level"]), F.array(F.struct(c["level"].alias("level"), c["title"].alias("title"))))).otherwise(s["path"])
        names = F.transform(path, lambda h: h["title"])
        made = F.array(F.struct(names.alias("headings"), F.trim(F.concat_ws(" ", F.array_join(names, " "), c["body"])).alias("text")))
        return F.struct(path.alias("path"), F.when(c["body"] != "", F.concat(s["out"], made)).otherwise(s["out"]).alias("out"))

    return F.aggregate(cut, start, step, lambda s: s["out"])


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """chunk_id, doc_id, industry (the folder below `industries`, else NULL), headings, text of all *.md files below a folder.

    Files whose names begin with _ and files that aren't UTF-8 are skipped.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(folder)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    name = F.element_at(F.split("path", "/"), -1)
    industry = F.regexp_extract("path", "/industries/([^/]+?)(?:\\.md)?(?:/|$)", 1)
    df = files.where(~name.startswith("_")).select(F.regexp_replace(name, "\\.md$", "").alias("doc_id"), F.when(industry != "", industry).alias("industry"), text.alias("text")).where("text IS NOT NULL")
    return to_chunks(df)


def to_chunks(docs: DataFrame) -> DataFrame:
    """From (doc_id, industry, text)."""
    return docs.select("doc_id", "industry", F.posexplode(chunks(F.col("text"))).alias("n", "c")).select(F.concat_ws("#", F.col("doc_id").cast("string"), F.col("n").cast("string")).alias("chunk_id"), "doc_id", "industry", F.col("c.headings").alias("headings"), F.col("c.text").alias("text"))
