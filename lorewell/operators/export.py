"""Transcript export."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.operators.context import UNKNOWN


def filename(name: Column, ext: Column, at: Column) -> Column:
    """K9."""
    return F.concat(F.lit("对话_"), F.translate(name, "/\\", "__"), F.lit("_"), F.date_format(at, "yyyyMMdd_HHmmss"), F.lit("."), ext)


def markdown(msgs: DataFrame, session: str, order: str, name: Column, at: Column, info: Column | None = None, sources: str | None = None) -> DataFrame:
    """K7 + X13: one Markdown text per session.

    msgs has role, text, and optionally an array of titles per message. info: a struct of dynasty, title, years.
    Every entry ends with a line break and entries are joined by another.
    """
    # The layout.
    who = F.when(F.col("role") == "user", F.lit("👤 用户")).otherwise(F.concat(F.lit("🎭 "), name))
    body = F.concat(F.lit("### "), who, F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n\n"))
    if sources:
        titles = F.array_join(F.transform(sources, lambda t: F.coalesce(t, F.lit(UNKNOWN))), " | ")
        body = F.concat(body, F.when(F.size(sources) > 0, F.concat(F.lit("*参考资料*: "), titles, F.lit("\n\n"))).otherwise(""))
    body = F.concat(body, F.lit("---\n"))
    head = F.concat(F.lit("# 与"), name, F.lit("的对话\n\n**导出时间**: "), F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit("\n\n"))
    if info is not None:
        who_is = [F.coalesce(info[c], F.lit(UNKNOWN)) for c in ("dynasty", "title", "years")]
        head = F.concat(head, F.lit("## 人物信息\n\n- **朝代**: "), who_is[0], F.lit("\n- **身份**: "), who_is[1], F.lit("\n- **生卒年**: "), who_is[2], F.lit("\n\n"))
    head = F.concat(head, F.lit("## 对话记录\n\n---\n\n"))
    rows = F.array_sort(F.collect_list(F.struct(order, F.col("_b").alias("b"))))
    said = F.array_join(F.transform("_rows", lambda r: r["b"]), "\n")
    grouped = msgs.withColumns({"_b": body, "_h": head}).groupBy(session).agg(F.first("_h").alias("_h"), rows.alias("_rows"))
    return grouped.select(session, F.concat("_h", said, F.lit("\n\n*由「历史人物对话」系统生成*\n")).alias("markdown"))


def _pdf(text: str) -> bytes:
    """A plain PDF of the lines: UTF-16 text in a CID font that viewers substitute, A4, 48 lines a page."""
    lines = text.split("\n")
    pages = [lines[i : i + 48] for i in range(0, len(lines), 48)] or [[]]
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Count {len(pages)} /Kids [{' '.join(f'{4 + 2 * i} 0 R' for i in range(len(pages)))}] >>"]
    objects.append("<< /Type /Font /Subtype /Type0 /BaseFont /STSong-Light /Encoding /UniGB-UCS2-H /DescendantFonts [<< /Type /Font /Subtype /CIDFontType0 /BaseFont /STSong-Light /CIDSystemInfo << /Registry (Adobe) /Ordering (GB1) /Supplement 2 >> >>] >>")
    for i, page in enumerate(pages):
        drawn = "\n".join(f"<{line.encode('utf-16-be').hex()}> Tj T*" for line in page)
        stream = f"BT /F1 10 Tf 14 TL 50 790 Td\n{drawn}\nET"
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents {5 + 2 * i} 0 R >>")
        objects.append(f"<< /Length {len(stream)} >>\nstream\n{stream}\nendstream")
    out, at = b"%PDF-1.4\n", []
    for i, o in enumerate(objects, 1):
        at.append(len(out))
        out += f"{i} 0 obj\n{o}\nendobj\n".encode()
    table = "".join(f"{x:010d} 00000 n \n" for x in at)
    return out + f"xref\n0 {len(at) + 1}\n0000000000 65535 f \n{table}trailer << /Size {len(at) + 1} /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF\n".encode()


def pdf(exported: DataFrame, text: str = "markdown", into: str = "pdf") -> DataFrame:
    """K8: a PDF for each exported text."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([_pdf(t or "") for t in texts])

    return exported.withColumn(into, run(text))
