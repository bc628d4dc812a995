"""Knowledge files: header grammar, raw scan, writers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.functions.text import safe_filename, strip
from lorewell.sources.sinks import write_file

# Header markers, and the defaults of missing fields.
MARKS = {"title": "# ", "source": "【来源】", "url": "【URL】", "character": "【人物】", "category": "【分类】"}
DEFAULTS = {"title": "", "source": "未知", "url": "", "character": "", "category": "biography"}
HEADER_LINES = 10
# Fixed value: how names of built-in files end.
BUILTIN = "内置"


def _file_name() -> Column:
    """The name of the file that a row comes from; Spark gives it in the form of a URI."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Whole files with their names; header included."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("value").alias("content"), _file_name().alias("file"))


def parse(files: DataFrame, compat_prefix: bool = False) -> DataFrame:
    """S2 on columns (file, content): title, source, url, character, category, file, content.

    compat_prefix cuts 【人物】 and 【分类】 one character too far, as older indexes were built.
    Files that are not valid UTF-8 must be dropped before (read_knowledge does so). A null content
    counts as empty; a file without a line starting --- has an empty body.
    """
    lines = F.split(F.replace(F.coalesce("content", F.lit("")), F.lit("\r\n"), F.lit("\n")), "\n")
    head = F.slice(F.col("_lines"), 1, HEADER_LINES)

    def field(name: str) -> Column:
        mark = MARKS[name]
        cut = len(mark) + (1 if compat_prefix and name in ("character", "category") else 0)
        last = F.try_element_at(F.filter(head, lambda x: F.startswith(x, F.lit(mark))), F.lit(-1))
        return F.coalesce(strip(F.substring(last, cut + 1, 1_000_000)), F.lit(DEFAULTS[name]))

    is_rule = F.transform("_lines", lambda x: F.startswith(x, F.lit("---")))
    at = F.array_position(is_rule, True)
    body = F.filter(F.slice(F.col("_lines"), F.greatest(at, F.lit(1)).cast("int"), F.size("_lines")), lambda x: ~F.startswith(x, F.lit("---")))
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    found = files.withColumn("_lines", lines).select("file", *[field(n).alias(n) for n in MARKS], F.when(at > 0, strip(F.array_join(body, "\n"))).otherwise("").alias("content"))
    return found.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), stem))


def read_knowledge(spark: SparkSession, path: str, compat_prefix: bool = False) -> DataFrame:
    """The *.txt files right below path; files with invalid UTF-8 are skipped."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    text = files.where(F.is_valid_utf8(F.col("content").cast("string"))).select(F.col("content").cast("string").alias("content"), _file_name().alias("file"))
    return parse(text, compat_prefix)


def render(rows: DataFrame, tag: Column | None = None) -> DataFrame:
    """K1 and K2: (file, value) for rows with title, source, url, category, character, content; tag ends the file name, as a rule the source."""
    name = safe_filename(F.concat_ws("_", "category", "character", F.col("source") if tag is None else tag))
    # The file template.
    value = F.concat(
        F.lit("# "), "title", F.lit("\n\n【来源】"), "source", F.lit("\n【URL】"), "url", F.lit("\n【分类】"), "category", F.lit("\n【人物】"), "character", F.lit("\n\n---\n\n"), "content", F.lit("\n"),
    )
    return rows.select(F.concat(name, F.lit(".txt")).alias("file"), value.alias("value"))


def builtin_rows(corpus: DataFrame) -> DataFrame:
    """K2: (name, dynasty, content) as knowledge rows; render them with BUILTIN as the tag."""
    return corpus.select(F.col("name").alias("title"), F.lit("内置知识库").alias("source"), F.lit("").alias("url"), F.lit("biography").alias("category"), F.col("name").alias("character"), "content")


def write_files(rendered: DataFrame, path: str) -> int:
    """K1-K3: one file per name right below path, written by the executors; their number.

    Of several rows of one name the greatest value stays. Files of other names stay as they are.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"bytes": [write_file(path, f, [v.encode()]) for f, v in zip(batch["file"], batch["value"], strict=True)]})

    rows = rendered.where("file is not null").groupBy("file").agg(F.coalesce(F.max("value"), F.lit("")).alias("value"))
    return rows.mapInPandas(run, "bytes long").count()


def raw_rows(rows: DataFrame) -> DataFrame:
    """K3: body only; slashes in the source become underscores."""
    return rows.select(F.concat(F.replace("source", F.lit("/"), F.lit("_")), F.lit(".txt")).alias("file"), F.col("content").alias("value"))
