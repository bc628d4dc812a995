"""The recursive splitter as expressions (X1): level by level, then one ordered aggregate; no row reaches Python.

A text starts as one open item. At the level of a separator every open item that has it is cut there, the separator going with what
follows; pieces of at least the chunk size stay open for finer separators, the others are closed. A closed piece knows whether it
starts a run: whether it comes first, or behind an open piece. Runs are merged greedily, with a tail of at most the overlap.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.functions.text import SEPARATORS, strip
from lorewell.session import free_name

STATE = "struct<out:array<string>,win:array<string>,total:int>"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), which is computed once however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _level(items: Column, separator: str, size: int) -> Column:
    def cut(text: Column) -> Column:
        raw = F.split(text, re.escape(separator) if separator else "", -1)
        kept = F.filter(F.transform(raw, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(separator), p))), lambda p: p != "")
        long = lambda p: F.char_length(p) >= size
        return _let(kept, lambda ps: F.transform(ps, lambda p, i: F.struct(p.alias("t"), long(p).alias("open"), (F.when(i == 0, True).otherwise(long(F.get(ps, i - 1)))).alias("starts"))))

    has = (lambda t: F.lit(True)) if separator == "" else (lambda t: F.contains(t, F.lit(separator)))
    return F.flatten(F.transform(items, lambda x: F.when(x["open"] & has(x["t"]), cut(x["t"])).otherwise(F.array(x))))


def _merged(items: Column, size: int, overlap: int) -> Column:
    join = lambda win: strip(F.array_join(win, ""))

    def tail(win: Column, most: Column) -> Column:
        """The longest end of a window of at most so many characters."""
        first = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("n"), F.lit(False).alias("full"))

        def back(a: Column, p: Column) -> Column:
            fits = ~a["full"] & (a["n"] + F.char_length(p) <= most)
            took = F.struct(F.concat(F.array(p), a["kept"]).alias("kept"), (a["n"] + F.char_length(p)).alias("n"), F.lit(False).alias("full"))
            return F.when(fits, took).otherwise(F.struct(a["kept"].alias("kept"), a["n"].alias("n"), F.lit(True).alias("full"))).cast("struct<kept:array<string>,n:int,full:boolean>")

        return F.aggregate(F.reverse(win), first.cast("struct<kept:array<string>,n:int,full:boolean>"), back)

    def step(a: Column, x: Column) -> Column:
        fresh = F.struct(F.when(F.size(a["win"]) > 0, F.concat(a["out"], F.array(join(a["win"])))).otherwise(a["out"]).alias("out"), F.array().cast("array<string>").alias("win"), F.lit(0).alias("total")).cast(STATE)

        def add(b: Column) -> Column:
            n = F.char_length(x["t"])
            plain = F.struct(b["out"].alias("out"), F.concat(b["win"], F.array(x["t"])).alias("win"), (b["total"] + n).alias("total")).cast(STATE)

            def full(end: Column) -> Column:
                return F.struct(F.concat(b["out"], F.array(join(b["win"]))).alias("out"), F.concat(end["kept"], F.array(x["t"])).alias("win"), (end["n"] + n).alias("total")).cast(STATE)

            return F.when((b["total"] + n > size) & (F.size(b["win"]) > 0), _let(tail(b["win"], F.least(F.lit(overlap), F.lit(size) - n)), full)).otherwise(plain)

        return _let(F.when(x["starts"], fresh).otherwise(a), add)

    empty = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("win"), F.lit(0).alias("total")).cast(STATE)
    return F.aggregate(items, empty, step, lambda a: F.filter(F.concat(a["out"], F.array(join(a["win"]))), lambda c: c != ""))


def split_columns(docs: DataFrame, column: str = "content", chunk_size: int = 500, chunk_overlap: int = 100, separators: list[str] | None = None) -> DataFrame:
    """X1 over a DataFrame, in the JVM: one row per chunk, all columns kept, with chunk_id from 0; equal to text.split_documents().

    Null and empty texts give no chunk. The last separator has to be the empty one and chunks take two characters at least, so
    that every piece ends closed.
    """
    seps = SEPARATORS if separators is None else separators
    if seps[-1] != "" or chunk_size < 2:
        raise ValueError("the last separator must be empty, and chunk_size at least 2")
    items = free_name(docs.columns, "_items")
    out = docs.where(F.col(column) != "").withColumn(items, F.array(F.struct(F.col(column).alias("t"), F.lit(True).alias("open"), F.lit(True).alias("starts"))))
    for s in seps:
        out = out.withColumn(items, _level(F.col(items), s, chunk_size))
    out = out.withColumn(items, _merged(F.col(items), chunk_size, chunk_overlap))
    names = [c for c in docs.columns if c != column]
    cut = out.select(*names, F.posexplode(items).alias("chunk_id", column))
    return cut.select(*docs.columns, "chunk_id")
