"""Fetched web pages to documents."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.sources.sinks import write_file

MIN_CHARS, MAX_CHARS = 50, 5000


def item_url(name: Column) -> Column:
    """H1."""
    return F.concat(F.lit("https://baike.baidu.com/item/"), name)


def without_tags(html: Column) -> Column:
    """Text of a fragment: tags out, the common entities resolved, outer space out."""
    text = F.regexp_replace(html, r"(?s)<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def title(html: Column, fallback: Column) -> Column:
    """H3 in regex form: the first <h1>, else the fallback."""
    return F.coalesce(F.nullif(without_tags(F.regexp_extract(html, r"(?s)<h1[^>]*>(.*?)</h1>", 1)), F.lit("")), fallback)


def clean_text(html: Column, drop: tuple[str, ...] = ("script", "style", "sup", "a")) -> Column:
    """H4-H6 in regex form: the <article>, unwanted elements out, paragraphs on lines."""
    body = F.regexp_extract(html, r"(?s)<article[^>]*>(.*?)</article>", 1)
    for tag in drop:
        body = F.regexp_replace(body, rf"(?s)<{tag}[ >].*?</{tag}>", "")
    paragraphs = F.transform(F.split(body, r"</p>"), lambda p: without_tags(p))
    return F.array_join(F.filter(paragraphs, lambda p: p != ""), "\n")


def gate(docs: DataFrame, column: str = "content") -> DataFrame:
    """F4 before F10."""
    return docs.where(F.char_length(column) >= MIN_CHARS).withColumn(column, F.left(column, F.lit(MAX_CHARS)))


@dataclass(frozen=True)
class Selectors:
    """What a site is read by; (tag, class) with class None for any."""

    # The selectors of the first site.
    title: tuple[tuple[str, str | None], ...] = (("h1", None), ("dd", "lemmaWgt-lemmaTitle-title"))
    root: tuple[tuple[str, str | None], ...] = (("div", "main-content"), ("div", "lemma-summary"), ("div", "para"))
    drop: tuple[str, ...] = ("script", "style", "sup", "a")
    paragraphs: bool = True
    keep_empty: bool = False
    #: A root without paragraphs is one paragraph.
    whole: bool = True
    separator: str = ""


# The selectors of the other two sites.
#: The other two sites: S12 keeps empty paragraphs, S13 joins all text nodes of the root by line.
WIKI = Selectors(root=(("div", "mw-parser-output"),), drop=(), keep_empty=True, whole=False)
BAIKE_V1 = Selectors(drop=("script", "style", "sup"), root=(("div", "main-content"),), paragraphs=False, separator="\n")
ARTICLE = Selectors(root=(("article", None),))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


@dataclass
class Node:
    tag: str
    classes: frozenset[str] = frozenset()
    children: list = field(default_factory=list)

    def walk(self) -> Iterator[Node]:
        stack: list = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def texts(self, drop: tuple[str, ...]) -> list[str]:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node.strip())
            elif node is self or node.tag not in drop:
                stack += reversed(node.children)
        return [t for t in out if t]


class _Tree(HTMLParser):
    """A lenient tree: an unclosed <p> ends at the next <p> or at its parent's end."""

    def __init__(self) -> None:
        super().__init__()
        self.open = [Node("#root")]

    def handle_starttag(self, tag, attrs):
        if tag == "p":
            self._close("p", within=("div", "article", "td", "li", "section", "body"))
        node = Node(tag, frozenset((dict(attrs).get("class") or "").split()))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag))

    def _close(self, tag, within=()):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag in within:
                return

    def handle_endtag(self, tag):
        self._close(tag)

    def handle_data(self, data):
        self.open[-1].children.append(data)


def extract(html: str | None, name: str, sel: Selectors = ARTICLE) -> tuple[str, str | None]:
    """H3-H6 on a parsed tree: (title, content); content is None without a content root."""
    tree = _Tree()
    tree.feed(html or "")
    nodes = list(tree.open[0].walk())

    def first(wanted):
        return next((n for tag, cls in wanted for n in nodes if n.tag == tag and (cls is None or cls in n.classes)), None)

    head, root = first(sel.title), first(sel.root)
    heading = "".join(head.texts(())) if head else name
    if root is None:
        return heading, None
    if not sel.paragraphs:
        return heading, sel.separator.join(root.texts(sel.drop))
    inner = [n for n in root.walk() if n.tag == "p"] or [root] * sel.whole
    lines = ["".join(p.texts((*sel.drop, "p"))) for p in inner]
    return heading, "\n".join(x for x in lines if x or sel.keep_empty)


def extract_pages(pages: DataFrame, sel: Selectors = ARTICLE, name: str = "url", carry: list[str] | None = None) -> DataFrame:
    """H3-H6 over (url, html): url, title, content, ok, and the carried columns; `name` names a page without a title."""
    columns = list(dict.fromkeys(["url", "html", name, *(carry or [])]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [extract(h, n, sel) for n, h in zip(batch[name], batch["html"], strict=True)]
            out = {"url": batch["url"], "title": [t for t, _ in found], "content": [c for _, c in found], "ok": [c is not None and len(c) >= MIN_CHARS for _, c in found]}
            yield pd.DataFrame(out | {c: batch[c] for c in carry or []})

    schema = "".join(f", `{c}` {pages.schema[c].dataType.simpleString()}" for c in carry or [])
    return pages.select(*columns).mapInPandas(run, f"url string, title string, content string, ok boolean{schema}")


def crawl_rows(extracted: DataFrame, character: Column, source: str = "百度百科", category: str = "biography") -> DataFrame:
    """S11 + F14: gated crawl results with their six fields."""
    rows = extracted.select("title", "content", F.lit(source).alias("source"), "url", character.alias("character"), F.lit(category).alias("category"))
    return gate(rows)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """(url, title, time) of a JSON object; an empty object gives no row."""
    text = spark.read.text(path, wholetext=True)
    seen = F.from_json("value", "map<string, struct<title: string, time: string>>")
    return text.select(F.explode(seen).alias("url", "v")).select("url", "v.title", "v.time")


def merge_cache(cache: DataFrame, crawled: DataFrame, day: str) -> DataFrame:
    """K4 + A8: the cache with newly crawled urls; a url crawled again takes the newer entry."""
    new = crawled.select("url", "title", F.lit(day).alias("time"))
    both = cache.select("url", "title", "time").withColumn("o", F.lit(0)).unionByName(new.withColumn("o", F.lit(1)))
    return both.groupBy("url").agg(F.max_by(F.struct("title", "time"), F.struct("o", "time", "title")).alias("v")).select("url", "v.*")


def write_cache(cache: DataFrame, path: str) -> None:
    """K4: the cache as one JSON object at path, by url. One task writes it row by row, as the format is one file; an empty cache is {}."""
    folder, _, name = path.rpartition("/")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def parts() -> Iterator[bytes]:
            mark = "{\n"
            for batch in batches:
                for url, title, time in zip(batch["url"], batch["title"], batch["time"], strict=True):
                    entry = json.dumps({"title": title, "time": time}, ensure_ascii=False)
                    yield f"{mark}  {json.dumps(url, ensure_ascii=False)}: {entry}".encode()
                    mark = ",\n"
            yield b"{}\n" if mark[0] == "{" else b"\n}\n"

        yield pd.DataFrame({"bytes": [write_file(folder, name, parts())]})

    rows = cache.where("url is not null").select("url", "title", "time").coalesce(1).sortWithinPartitions("url")
    if not rows.mapInPandas(run, "bytes long").count():
        write_file(folder, name, [b"{}\n"])
