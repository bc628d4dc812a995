"""Citations, evidence and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Defaults of missing citation fields.
UNKNOWN = "未知"

# The persona prompt, its blanks in braces.
PERSONA = """你现在扮演中国历史人物【{name}】。

## 人物信息
- 朝代：{dynasty}
- 身份：{title}
- 生卒年：{years}

## 人物性格
{personality}

## 说话风格
{speaking_style}

## 知识领域
你精通以下历史内容：
{focus}

## 名言
{quotes}

## 回复要求
1. 始终以{name}的身份回答，不要跳出角色
2. 回答要符合历史事实，基于真实史料
3. 语言风格要符合你的身份和时代特点
4. 如果问到超出你知识范围的问题，可以表示不知，但要保持角色
5. 回答要有深度，展现历史人物的智慧和见解
"""

# The evidence block of the system prompt.
EVIDENCE = """

## 相关历史史料
以下是从史料中检索到的相关信息，请参考这些内容回答，并在回答末尾标注引用来源：

{context}

## 引用格式要求
回答时请在末尾添加引用标注，格式如：
【参考史料】[1]《标题》- 来源

如果史料内容与问题相关，请优先使用史料中的信息。如果史料与问题无关，可以忽略。
"""


def fill(template: str, **blanks: Column) -> Column:
    """The template with columns in its blanks, as one concat()."""
    parts: list[Column] = []
    rest = template
    while "{" in rest:
        text, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [F.lit(text), F.coalesce(blanks[name], F.lit(""))]
    return F.concat(*parts, F.lit(rest))


def persona_prompt() -> Column:
    """X2 over the columns of a character."""
    plain = {c: F.col(c) for c in ("name", "dynasty", "title", "years", "personality", "speaking_style")}
    focus = F.array_join(F.transform("knowledge_focus", lambda x: F.concat(F.lit("- "), x)), "\n")
    quotes = F.array_join(F.transform("famous_quotes", lambda x: F.concat(F.lit('"'), x, F.lit('"'))), "\n")
    return fill(PERSONA, **plain, focus=focus, quotes=quotes)


def citations(hits: DataFrame) -> DataFrame:
    """index and the four cited fields; only missing (null) fields get defaults."""
    return hits.withColumns(
        {
            "index": F.col("rank"),
            "title": F.coalesce("title", F.lit(UNKNOWN)),
            "source": F.coalesce("source", F.lit(UNKNOWN)),
            "url": F.coalesce("url", F.lit("")),
            "character": F.coalesce("character", F.lit("")),
        }
    )


def evidence(cited: DataFrame, by: list[str], content: str = "content") -> DataFrame:
    """X4 + A7: the numbered evidence of each group in index order."""
    entry = F.concat(F.lit("[史料"), F.col("index").cast("string"), F.lit("] 来源: "), "source", F.lit(" - "), "title", F.lit("\n"), content)
    return ordered_text(cited.withColumn("_entry", entry), by, "index", "_entry", "\n\n", "context_text")


def ordered_text(df: DataFrame, by: list[str], order: str | list[str], value: str, sep: str, into: str) -> DataFrame:
    """An ordered, separated string for each group. Groups are bounded by k or N, so an array is safe."""
    order = [order] if isinstance(order, str) else order
    rows = F.array_sort(F.collect_list(F.struct(*order, value)))
    return df.groupBy(*by).agg(F.array_join(F.transform(rows, lambda r: r[value]), sep).alias(into))


def system_prompt(base: Column, context: Column) -> Column:
    """The base alone when there is no context."""
    return F.concat(base, F.when(context.isNull(), "").otherwise(fill(EVIDENCE, context=context)))


def messages(system: Column, history: Column, user: Column) -> Column:
    """System, history oldest first, then the input; history is an array of (role, content)."""

    def message(role: str, content: Column) -> Column:
        return F.array(F.struct(F.lit(role).alias("role"), content.alias("content")))

    return F.concat(message("system", system), F.coalesce(history, F.expr("cast(array() as array<struct<role:string,content:string>>)")), message("user", user))


def source_line(sources: Column) -> Column:
    """Titles joined by ' | '."""
    return F.array_join(F.transform(sources, lambda s: F.coalesce(s["title"], F.lit(UNKNOWN))), " | ")


def source_panel() -> Column:
    """One line per citation, the title as a link where there is a url."""
    title = F.when(F.col("url") != "", F.concat(F.lit("["), "title", F.lit("]("), "url", F.lit(")"))).otherwise(F.col("title"))
    return F.concat(F.lit("["), F.col("index").cast("string"), F.lit("] "), title, F.lit(" - "), "source")
