"""YAML catalog scan."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.operators.catalog import last_wins

TEXTS = ["name", "dynasty", "title", "years", "avatar", "personality", "speaking_style"]
LISTS = ["knowledge_focus", "famous_quotes"]
SCHEMA = ", ".join([f"{c} string" for c in TEXTS] + [f"{c} array<string>" for c in LISTS] + ["path string", "error string"])


def parse_character(content: bytes) -> dict:
    """One record; a missing text or an unknown key is an error, missing lists are empty."""
    import yaml

    data = yaml.safe_load(content.decode("utf-8"))
    if not isinstance(data, dict):
        raise ValueError("not a mapping")
    if wrong := set(data) - {*TEXTS, *LISTS}:
        raise ValueError(f"unknown keys {sorted(map(str, wrong))}")
    if missing := set(TEXTS) - set(data):
        raise ValueError(f"missing keys {sorted(missing)}")
    return {c: None if data[c] is None else str(data[c]) for c in TEXTS} | {c: [str(x) for x in data.get(c) or []] for c in LISTS}


def read_all(spark: SparkSession, path: str) -> DataFrame:
    """Every *.yaml below path, with an error text in place of the record for bad files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.yaml").load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows.append(parse_character(content) | {"path": p, "error": None})
                except Exception as e:  # noqa: BLE001  a bad file is quarantined
                    rows.append(dict.fromkeys([*TEXTS, *LISTS]) | {"path": p, "error": str(e)})
            yield pd.DataFrame(rows, columns=[*TEXTS, *LISTS, "path", "error"], dtype=object)

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """S1 + A8: good files only, the last path of a name wins."""
    return last_wins(read_all(spark, path).where("error is null").drop("error"), "path")
