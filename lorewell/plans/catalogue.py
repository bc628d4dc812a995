"""The registered queries over the reference's own operators, each with SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorewell.functions import text as tx
from lorewell.functions.embed import embed
from lorewell.functions.splitter import split_columns
from lorewell.operators import catalog, chat, context, export, generations, index, ivf, knn, ledger, memory
from lorewell.plans import events  # noqa: F401  registers its queries
from lorewell.plans.registry import ORACLE, QUERIES, query, read_back  # noqa: F401  what the driver asks for
from lorewell.session import settled, table
from lorewell.sources import catalog_files, datasource, fetch, files, knowledge, pages

STRIPPED = "regexp_replace(text, '^[\\s\\x{3000}]+|[\\s\\x{3000}]+$', '', 'g')"


def _probe(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id = 0").select("embedding")


def _round(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


# --- corpus (S2, A1, A2, A4) ---


@query("SELECT doc_id, lang, source, n_chars, length(text) AS chars FROM documents")
def corpus_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", F.char_length("text").cast("long").alias("chars"))


@query("SELECT count(*) AS n FROM documents")
def corpus_count(spark, d):
    return table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS chars, max(length(text))::BIGINT AS longest FROM documents GROUP BY lang")
def corpus_stats_by_lang(spark, d):
    n = F.char_length("text")
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(n).alias("chars"), F.max(n).cast("long").alias("longest"))


# --- vector search (T1-T5) ---

DIST = "list_sum(list_transform(range(1, 65), lambda i: (e.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE) * (e.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE)))"
SCORED = f"WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0), s AS (SELECT e.vec_id, e.label, {DIST} AS score FROM embeddings e, q)"


@query(f"{SCORED} SELECT vec_id, row_number() OVER (ORDER BY score, vec_id)::INTEGER AS rank FROM s ORDER BY score, vec_id LIMIT 4")
def knn_topk(spark, d):
    return knn.topk(table(spark, d, "embeddings"), _probe(spark, d), 4).select("vec_id", "rank")


@query(f"{SCORED} SELECT vec_id, round(score, 6) AS score, row_number() OVER (ORDER BY score, vec_id)::INTEGER AS rank FROM s ORDER BY rank LIMIT 4")
def knn_with_score(spark, d):
    return _round(knn.topk(table(spark, d, "embeddings"), _probe(spark, d), 4).select("vec_id", "score", "rank"))


@query(f"{SCORED} SELECT vec_id, round(score, 6) AS score, row_number() OVER (ORDER BY score, vec_id)::INTEGER AS rank FROM s WHERE label = 3 ORDER BY rank LIMIT 3")
def knn_filtered(spark, d):
    return _round(knn.topk(table(spark, d, "embeddings"), _probe(spark, d), 3, {"label": 3}).select("vec_id", "score", "rank"))


def _linked(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "lang", "source", F.col("text").alias("content"))
    return table(spark, d, "embeddings").join(docs, "vec_id")


@query(f"{SCORED} SELECT s.vec_id, lang, row_number() OVER (ORDER BY score, vec_id)::INTEGER AS rank FROM s JOIN documents d ON d.doc_id = s.vec_id WHERE lang = 'de' ORDER BY rank LIMIT 3")
def knn_category(spark, d):
    return knn.topk(_linked(spark, d), _probe(spark, d), 3, {"lang": "de"}).select("vec_id", "lang", "rank")


FALLBACK = SCORED + " SELECT vec_id, round(score, 6) AS score, row_number() OVER (ORDER BY score, vec_id)::INTEGER AS rank, {was} AS fallback FROM s WHERE {cond} ORDER BY rank LIMIT 3"


@query(FALLBACK.format(was="false", cond="label = 5"))
def knn_fallback_hit(spark, d):
    return _round(knn.topk_with_fallback(table(spark, d, "embeddings"), _probe(spark, d), 3, {"label": 5}).select("vec_id", "score", "rank", "fallback"))


@query(FALLBACK.format(was="true", cond="true"))
def knn_fallback_miss(spark, d):
    return _round(knn.topk_with_fallback(table(spark, d, "embeddings"), _probe(spark, d), 3, {"label": -1}).select("vec_id", "score", "rank", "fallback"))


def _hundredths(spark, d):
    """The query set of batched searches: every row whose id is divisible by 100, against all rows."""
    return table(spark, d, "embeddings").where("vec_id % 100 = 0").select("label", F.col("embedding").alias("q"), F.col("vec_id").alias("query_id"))


HUNDREDTHS = "q AS (SELECT label, vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 100 = 0)"


@query(f"WITH {HUNDREDTHS}, s AS (SELECT q.query_id, e.vec_id, {DIST} AS score FROM embeddings e, q) SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 6")
def knn_batch(spark, d):
    return _round(knn.batch_topk(table(spark, d, "embeddings"), _hundredths(spark, d), 6))


@query(f"WITH {HUNDREDTHS}, s AS (SELECT q.query_id, e.vec_id, {DIST} AS score FROM embeddings e JOIN q ON e.label = q.label) SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 3")
def knn_batch_filtered(spark, d):
    return _round(knn.batch_topk(table(spark, d, "embeddings"), _hundredths(spark, d), 3, by=["label"]))


@query()
def ann_knn(spark, d):
    """Approximate T1 through an inverted file that is written first; a test measures its recall against knn_batch."""
    return read_back(spark, lambda p: ivf.build(table(spark, d, "embeddings"), p, k=6), lambda p: _round(ivf.search(spark, p, _hundredths(spark, d), 6)))


# --- citations and prompts (F12, X2-X5) ---

HITS = f"""{SCORED}, h AS (SELECT vec_id, row_number() OVER (ORDER BY score, vec_id)::INTEGER AS rank FROM s WHERE vec_id IN (SELECT doc_id FROM documents) ORDER BY rank LIMIT 3),
c AS (SELECT h.rank, h.vec_id, coalesce('doc ' || d.doc_id, '未知') AS title, coalesce(d.source, '未知') AS source, d.text AS content FROM h JOIN documents d ON d.doc_id = h.vec_id)"""


def _cited(spark, d):
    hits = knn.topk(_linked(spark, d), _probe(spark, d), 3)
    named = hits.withColumns({"title": F.concat(F.lit("doc "), "vec_id"), "url": F.lit(None).cast("string"), "character": F.lit(None).cast("string")})
    return context.citations(named)


@query(f'{HITS} SELECT rank AS "index", title, source, \'\' AS url, \'\' AS character FROM c')
def rag_sources(spark, d):
    return _cited(spark, d).select("index", "title", "source", "url", "character")


@query(f"{HITS} SELECT '[' || rank || '] ' || CASE WHEN rank = 1 THEN '[' || title || '](http://x/' || vec_id || ')' ELSE title END || ' - ' || source AS line FROM c")
def rag_source_panel(spark, d):
    linked = _cited(spark, d).withColumn("url", F.when(F.col("index") == 1, F.concat(F.lit("http://x/"), "vec_id")).otherwise(""))
    return linked.select(context.source_panel().alias("line"))


@query("SELECT conv_id, string_agg('item ' || turn, ' | ' ORDER BY turn) AS line FROM conversations WHERE role <> 'user' GROUP BY conv_id")
def rag_source_line(spark, d):
    """X12's short form: each reply cites one title."""
    cited = table(spark, d, "conversations").where("role <> 'user'").withColumn("title", F.concat(F.lit("item "), "turn"))
    rows = cited.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "title"))).alias("sources"))
    return rows.select("conv_id", context.source_line(F.col("sources")).alias("line"))


CONTEXT = HITS + ", x AS (SELECT string_agg('[史料' || rank || '] 来源: ' || source || ' - ' || title || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS context_text FROM c)"


@query(f"{CONTEXT} SELECT context_text FROM x")
def rag_context(spark, d):
    return context.evidence(_cited(spark, d), [])


EVIDENCE_SQL = "'" + context.EVIDENCE.replace("'", "''").replace("{context}", "' || context_text || '") + "'"


@query(f"{CONTEXT} SELECT conv_id, turn, 'BASE' || {EVIDENCE_SQL} || chr(10) || text AS prompt FROM conversations, x WHERE role = 'user'")
def rag_prompts(spark, d):
    ctx = F.broadcast(context.evidence(_cited(spark, d), []))
    asked = table(spark, d, "conversations").where("role = 'user'").join(ctx)
    return asked.select("conv_id", "turn", F.concat(context.system_prompt(F.lit("BASE"), F.col("context_text")), F.lit("\n"), "text").alias("prompt"))


NORMAL = "CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END"


@query(f"""WITH m AS (SELECT conv_id, turn, turn AS asked, 0 AS o, 'system' AS role, 'BASE' AS content FROM conversations
UNION ALL SELECT a.conv_id, b.turn, a.turn, 1, CASE WHEN b.role = 'user' THEN 'user' ELSE 'assistant' END, b.text FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn < a.turn AND b.turn >= a.turn - 10
UNION ALL SELECT conv_id, turn, turn, 2, 'user', text FROM conversations)
SELECT conv_id, asked AS turn, row_number() OVER (PARTITION BY conv_id, asked ORDER BY o, turn)::INTEGER - 1 AS pos, role, content FROM m""")
def rag_messages(spark, d):
    turns = memory.as_of(table(spark, d, "conversations"), 10)
    msgs = turns.withColumn("m", context.messages(F.lit("BASE"), F.col("history"), F.col("text")))
    return msgs.select("conv_id", "turn", F.posexplode("m").alias("pos", "m")).select("conv_id", "turn", "pos", "m.role", "m.content")


# --- memory (W1, W1', M1, M2, X6, X7) ---


@query("SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def memory_last_n(spark, d):
    return memory.last_n(table(spark, d, "conversations"), 3)


@query(f"SELECT a.conv_id, a.turn, count(b.turn)::INTEGER AS n, coalesce(string_agg({NORMAL.replace('role', 'b.role')} || ':' || b.text, '|' ORDER BY b.turn), '') AS history FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn < a.turn AND b.turn >= a.turn - 3 GROUP BY a.conv_id, a.turn")
def memory_asof(spark, d):
    h = F.array_join(F.transform("history", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    return memory.as_of(table(spark, d, "conversations"), 3).select("conv_id", "turn", F.size("history").alias("n"), h.alias("history"))


@query("WITH l AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 10) SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN '用户' ELSE '我' END || ': ' || text, chr(10) ORDER BY turn) AS history FROM l GROUP BY conv_id")
def memory_history_string(spark, d):
    return memory.history_string(table(spark, d, "conversations"), 10)


@query("SELECT c.conv_id, c.turn, c.role, c.text FROM conversations c LEFT JOIN (SELECT conv_id, max(turn) AS t FROM conversations WHERE turn = 2 GROUP BY conv_id) k ON k.conv_id = c.conv_id WHERE k.t IS NULL OR c.turn > k.t")
def memory_after_clear(spark, d):
    return memory.after_clear(table(spark, d, "conversations"), F.col("turn") == 2)


@query(f"SELECT {NORMAL} AS role, count(*) AS n FROM conversations GROUP BY 1")
def memory_roles(spark, d):
    return table(spark, d, "conversations").select(memory.normal_role(F.col("role")).alias("role")).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, count(*) AS shown, count(*) FILTER (WHERE turn % 3 <> 1) AS remembered FROM conversations GROUP BY conv_id")
def memory_transcript(spark, d):
    """M4 with every reply of turn 1, 4, 7, ... failing."""
    shown, kept = memory.transcript(table(spark, d, "conversations"), F.col("turn") % 3 == 1)
    n = shown.groupBy("conv_id").agg(F.count(F.lit(1)).alias("shown"))
    return n.join(kept.groupBy("conv_id").agg(F.count(F.lit(1)).alias("remembered")), "conv_id", "left").fillna(0)


# --- chunking (X1) ---


@query("SELECT doc_id, i::INTEGER AS chunk_id, substr(text, i * 400 + 1, 500) AS chunk FROM (SELECT doc_id, text, unnest(range(0, greatest(0, ceil((length(text) - 100) / 400.0)::BIGINT - 1) + 1)) AS i FROM documents WHERE length(text) > 0)")
def chunk_fixed(spark, d):
    return tx.chunk_fixed(table(spark, d, "documents"), "text").select("doc_id", "chunk_id", "chunk")


def _level_sql(separator: str, size: int) -> str:
    """One level of the splitter: open items that have the separator are cut there."""
    sep = f"'{separator}'" if separator.strip() or separator in ("", " ") else " || ".join(["chr(10)"] * len(separator))
    has = "true" if separator == "" else f"contains(x.t, {sep})"
    raw = f"list_filter(list_transform(string_split(x.t, {sep}), lambda p, i: CASE WHEN i = 1 THEN p ELSE {sep} || p END), lambda p: p <> '')"
    cut = f"list_transform([{raw}], lambda ps: list_transform(ps, lambda p, i: {{'t': p, 'open': length(p) >= {size}, 'starts': i = 1 OR length(ps[i - 1]) >= {size}}}))[1]"
    return f"flatten(list_transform(items, lambda x: CASE WHEN x.open AND {has} THEN {cut} ELSE [x] END))"


def _merge_sql(size: int, overlap: int) -> str:
    """Closed items merged run by run into chunks."""
    join = lambda win: STRIPPED.replace("text", f"array_to_string({win}, '')", 1)
    none = "[]::VARCHAR[]"
    state = lambda out, win, total: f"{{'out': {out}, 'win': {win}, 'total': {total}}}"
    fresh = state(f"CASE WHEN len(a.win) > 0 THEN list_append(a.out, {join('a.win')}) ELSE a.out END", none, "0::BIGINT")
    took = "{'kept': list_prepend(p, e.kept), 'n': e.n + length(p), 'full': false}"
    tail = f"list_reduce(list_reverse(b.win), lambda e, p: CASE WHEN NOT e.full AND e.n + length(p) <= least({overlap}, {size} - length(x.t)) THEN {took} ELSE {{'kept': e.kept, 'n': e.n, 'full': true}} END, {{'kept': {none}, 'n': 0::BIGINT, 'full': false}})"
    full = state(f"list_append(b.out, {join('b.win')})", "list_append(e.kept, x.t)", "e.n + length(x.t)")
    plain = state("b.out", "list_append(b.win, x.t)", "b.total + length(x.t)")
    add = f"CASE WHEN b.total + length(x.t) > {size} AND len(b.win) > 0 THEN list_transform([{tail}], lambda e: {full})[1] ELSE {plain} END"
    return f"list_reduce(items, lambda a, x: list_transform([CASE WHEN x.starts THEN {fresh} ELSE a END], lambda b: {add})[1], {state(none, none, '0::BIGINT')})"


def _split_sql(size: int = 500, overlap: int = 100) -> str:
    """The recursive splitter, level by level, over all documents."""
    levels = "".join(f", l{i + 1} AS (SELECT doc_id, {_level_sql(s, size)} AS items FROM l{i})" for i, s in enumerate(tx.SEPARATORS))
    last = STRIPPED.replace("text", "array_to_string(m.win, '')", 1)
    return f"""WITH l0 AS (SELECT doc_id, [{{'t': text, 'open': true, 'starts': true}}] AS items FROM documents WHERE text <> ''){levels},
m AS (SELECT doc_id, {_merge_sql(size, overlap)} AS m FROM l{len(tx.SEPARATORS)}),
c AS (SELECT doc_id, list_filter(list_append(m.out, {last}), lambda c: c <> '') AS cs FROM m)
SELECT doc_id, unnest(cs) AS text, (unnest(range(len(cs))))::INTEGER AS chunk_id FROM c"""


@query(_split_sql())
def chunk_recursive(spark, d):
    return tx.split_documents(table(spark, d, "documents").select("doc_id", "text"), "text")


@query(_split_sql())
def chunk_columns(spark, d):
    """X1 in the JVM alone."""
    return split_columns(table(spark, d, "documents").select("doc_id", "text"), "text")


@query()
def chunk_embeddings(spark, d):
    """E1 over X1: what the index build writes."""
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    return embed(index.chunks_of(docs), "content").select("doc_id", "chunk_id", "vec_id", F.size("embedding").alias("dim"))


# --- pages (H1-H7, J4, F4, F10) ---

UNTAG = "regexp_replace(replace(replace(replace(replace(replace(regexp_replace({x}, '<[^>]*>', '', 'gs'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '^\\s+|\\s+$', '', 'g')"
TITLE = f"coalesce(nullif({UNTAG.format(x="regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1, 's')")}, ''), url)"
BODY = "regexp_extract(html, '<article[^>]*>(.*?)</article>', 1, 's')"
for _tag in ("script", "style", "sup", "a"):
    BODY = f"regexp_replace({BODY}, '<{_tag}[ >].*?</{_tag}>', '', 'gs')"
CLEAN = f"array_to_string(list_filter(list_transform(string_split({BODY}, '</p>'), lambda p: {UNTAG.format(x='p')}), lambda p: p <> ''), chr(10))"


@query(f"SELECT page_id, {TITLE} AS title FROM pages")
def page_title(spark, d):
    return table(spark, d, "pages").select("page_id", pages.title(F.col("html"), F.col("url")).alias("title"))


@query(f"SELECT page_id, {CLEAN} AS content FROM pages")
def page_clean_text(spark, d):
    return table(spark, d, "pages").select("page_id", pages.clean_text(F.col("html")).alias("content"))


@query(f"SELECT page_id, substr(content, 1, 5000) AS content FROM (SELECT page_id, {CLEAN} AS content FROM pages) WHERE length(content) >= 50")
def page_gate(spark, d):
    return pages.gate(page_clean_text(spark, d))


@query("SELECT p.page_id, p.url FROM pages p WHERE p.url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def page_uncrawled(spark, d):
    """J4 with a cache that holds every third page."""
    p = table(spark, d, "pages")
    return catalog.not_cached(p, p.where("page_id % 3 = 0")).select("page_id", "url")


@query(f"SELECT count(*) FILTER (WHERE length(content) >= 50) AS success, count(*) AS total FROM (SELECT {CLEAN} AS content FROM pages)")
def page_success_ratio(spark, d):
    return page_clean_text(spark, d).agg(*catalog.success_ratio(F.char_length("content") >= 50))


@query()
def page_extract_dom(spark, d):
    return pages.extract_pages(table(spark, d, "pages"))


@query()
def page_load_urls(spark, d):
    return files.load_urls(table(spark, d, "pages"))


@query("""WITH old AS (SELECT url, min(page_id) AS p, 'old' AS title, '2024-01-01' AS time, 0 AS o FROM pages WHERE page_id % 2 = 0 GROUP BY url),
new AS (SELECT url, min(page_id) AS p, 'new' AS title, '2024-02-02' AS time, 1 AS o FROM pages WHERE page_id % 3 = 0 GROUP BY url)
SELECT url, arg_max(title, o) AS title, arg_max(time, o) AS time FROM (SELECT * FROM old UNION ALL SELECT * FROM new) GROUP BY url""")
def page_cache_merge(spark, d):
    p = table(spark, d, "pages")
    old = p.where("page_id % 2 = 0").select("url", F.lit("old").alias("title"), F.lit("2024-01-01").alias("time")).distinct()
    new = p.where("page_id % 3 = 0").select("url", F.lit("new").alias("title"))
    return pages.merge_cache(old, new, "2024-02-02")


@query("SELECT DISTINCT 'https://baike.baidu.com/item/' || c_name AS url FROM customer")
def page_item_urls(spark, d):
    return table(spark, d, "customer").select(pages.item_url(F.col("c_name")).alias("url")).distinct()


@query("SELECT c.conv_id, count(*) AS n FROM conversations c WHERE c.conv_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY c.conv_id")
def coverage_semi(spark, d):
    """J2 for existence: sessions that have a counterpart."""
    good = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("name"))
    rows = table(spark, d, "conversations").withColumnRenamed("conv_id", "name")
    return catalog.lookup(rows, good, "left_semi").groupBy(F.col("name").alias("conv_id")).agg(F.count(F.lit(1)).alias("n"))


# --- knowledge files (S2, K1, 2.10) ---


def _rows(spark, d):
    doc = table(spark, d, "documents")
    return doc.select(F.concat(F.lit("doc "), "doc_id").alias("title"), "source", F.lit("").alias("url"), F.col("lang").alias("category"), F.concat(F.lit("黄帝"), "doc_id").alias("character"), F.col("text").alias("content"), "doc_id")


def _kb(spark, d, compat):
    rendered = knowledge.render(_rows(spark, d)).withColumnRenamed("value", "content")
    return knowledge.parse(rendered, compat)


KB = "SELECT 'doc ' || doc_id AS title, source, '' AS url, {c} AS character, {k} AS category, lang || '_黄帝' || doc_id || '_' || source || '.txt' AS file, {t} AS content FROM documents"
# lines that start with --- end nowhere: the parser drops every one of them
NO_RULES = "array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT starts_with(x, '---')), chr(10))"


@query(KB.format(c="'黄帝' || doc_id", k="lang", t=STRIPPED.replace("text", NO_RULES, 1)))
def kb_header_roundtrip(spark, d):
    return _kb(spark, d, False).select("title", "source", "url", "character", "category", "file", "content")


@query(KB.format(c="'帝' || doc_id", k="substr(lang, 2)", t=STRIPPED.replace("text", NO_RULES, 1)))
def kb_header_compat(spark, d):
    return _kb(spark, d, True).select("title", "source", "url", "character", "category", "file", "content")


@query("SELECT regexp_replace(url, '[\\\\/:*?\"<>|]', '_', 'g') AS file FROM pages")
def safe_filenames(spark, d):
    return table(spark, d, "pages").select(tx.safe_filename(F.col("url")).alias("file"))


@query("SELECT replace(source, '/', '_') || '.txt' AS file, text AS value FROM documents")
def kb_raw_sink(spark, d):
    return knowledge.raw_rows(table(spark, d, "documents").withColumnRenamed("text", "content"))


# --- catalog (A3-A5, J1-J3, L5-L7) ---

# A small hand-written catalog, the same on both sides.
CHARS = [
    ("孔子", "春秋", "思想家", "前551年-前479年", "仁者爱人。", "温和", ["论语", "礼乐"], ["学而时习之"]),
    ("秦始皇", "秦朝", "皇帝", "前259年-前210年", "雄才大略。", "威严", ["统一六国"], ["朕为始皇帝", "书同文"]),
    ("李白", "唐朝", "诗人", "701年-762年", "豪放。", "飘逸", ["唐诗"], ["天生我材必有用"]),
    ("杜甫", "唐朝", "诗人", "712年-770年", "忧国忧民。", "沉郁", ["唐诗", "安史之乱"], []),
    ("苏轼", "北宋", "词人", "1037年-1101年", "旷达。", "风趣", ["宋词"], ["大江东去"]),
    ("荆轲", "燕国", "刺客", "？-前227年", "勇敢。", "慷慨", [], ["风萧萧兮易水寒"]),
]
CHAR_COLS = ["name", "dynasty", "title", "years", "personality", "speaking_style", "knowledge_focus", "famous_quotes"]
CHAR_TYPES = "name string, dynasty string, title string, years string, personality string, speaking_style string, knowledge_focus array<string>, famous_quotes array<string>"


def chars(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CHARS, CHAR_TYPES)


def people(spark: SparkSession, d: str) -> DataFrame:
    """A catalog of the given tables: suppliers as characters, their nations as groups."""
    s, nation = table(spark, d, "supplier"), table(spark, d, "nation")
    rows = s.join(nation, s.s_nationkey == nation.n_nationkey)
    key = F.col("s_suppkey").cast("string")
    return rows.select(
        F.col("s_name").alias("name"), F.col("n_name").alias("dynasty"), F.concat(F.lit("title "), F.col("s_nationkey").cast("string")).alias("title"), key.alias("years"),
        F.concat(F.lit("kind "), key).alias("personality"), F.lit("brief").alias("speaking_style"), F.array(F.lit("trade"), F.col("n_name")).alias("knowledge_focus"),
        F.when(F.col("s_suppkey") % 3 > 0, F.array(F.concat(F.lit("said by "), F.col("s_name")), F.lit("sold"))).otherwise(F.array().cast("array<string>")).alias("famous_quotes"),
    )


def group_order(spark: SparkSession, d: str) -> DataFrame:
    """Nations of the first regions in the order of their keys; the others have no place."""
    return table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_name").alias("dynasty"), F.col("n_nationkey").alias("ord"))


CHARS_SQL = """chars AS (SELECT s_name AS name, n_name AS dynasty, 'title ' || s_nationkey AS title, s_suppkey::VARCHAR AS years, 'kind ' || s_suppkey AS personality, 'brief' AS speaking_style,
['trade', n_name] AS knowledge_focus, CASE WHEN s_suppkey % 3 > 0 THEN ['said by ' || s_name, 'sold'] ELSE []::VARCHAR[] END AS famous_quotes FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


@query(f"WITH {CHARS_SQL} SELECT c.dynasty, coalesce(any_value(o.n_nationkey), 2147483647)::INTEGER AS ord, string_agg(c.name, ',' ORDER BY c.name) AS names, count(*) AS n FROM chars c LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) o ON o.n_name = c.dynasty GROUP BY c.dynasty ORDER BY ord, c.dynasty")
def catalog_grouped(spark, d):
    return catalog.grouped(people(spark, d), group_order(spark, d)).withColumn("names", F.array_join("names", ","))


@query(f"WITH {CHARS_SQL} SELECT v.name, c.dynasty, c.title FROM (SELECT DISTINCT replace(c_name, 'Customer', 'Supplier') AS name FROM customer) v LEFT JOIN chars c USING (name)")
def catalog_lookup(spark, d):
    """Names of which some are in the catalog."""
    asked = table(spark, d, "customer").select(F.replace("c_name", F.lit("Customer"), F.lit("Supplier")).alias("name")).distinct()
    return catalog.lookup(asked, people(spark, d)).select("name", "dynasty", "title")


@query(f"WITH {CHARS_SQL}, rec AS (SELECT n_nationkey AS pos, 'Supplier#' || lpad((7 * n_nationkey)::VARCHAR, 9, '0') AS name, n_name AS shown FROM nation) SELECT pos::INTEGER AS pos, name, shown, dynasty FROM rec JOIN chars USING (name)")
def catalog_recommended(spark, d):
    """One recommended name a nation, of which the catalog may lack some."""
    name = F.concat(F.lit("Supplier#"), F.lpad((7 * F.col("n_nationkey")).cast("string"), 9, "0"))
    shown = table(spark, d, "nation").select(F.col("n_nationkey").alias("pos"), name.alias("name"), F.col("n_name").alias("shown"))
    return catalog.recommended(spark, people(spark, d), shown).select("pos", "name", "shown", "dynasty")


@query(f"WITH {CHARS_SQL} SELECT name, dynasty, title, years, (i - 1)::INTEGER AS pos, famous_quotes[i] AS quote FROM chars, (SELECT unnest(range(1, 3)) AS i) WHERE name = 'Supplier#000000001'")
def catalog_profile(spark, d):
    return catalog.profile(people(spark, d), "Supplier#000000001")


@query(f"WITH {CHARS_SQL} SELECT (SELECT count(*) FROM chars) AS characters, (SELECT count(DISTINCT dynasty) FROM chars) AS dynasties, (SELECT count(*) FROM documents) AS chunks")
def catalog_kpis(spark, d):
    return catalog.kpis(people(spark, d), table(spark, d, "documents"))


PERSONA_SQL = "'" + context.PERSONA.replace("'", "''") + "'"
for _name in ("name", "dynasty", "title", "years", "personality", "speaking_style"):
    PERSONA_SQL = PERSONA_SQL.replace("{" + _name + "}", f"' || {_name} || '")
PERSONA_SQL = PERSONA_SQL.replace("{focus}", "' || coalesce(array_to_string(list_transform(knowledge_focus, lambda x: '- ' || x), chr(10)), '') || '").replace("{quotes}", "' || coalesce(array_to_string(list_transform(famous_quotes, lambda x: '\"' || x || '\"'), chr(10)), '') || '")


@query(f"WITH {CHARS_SQL} SELECT name, {PERSONA_SQL} AS prompt FROM chars")
def persona_prompt(spark, d):
    return people(spark, d).select("name", context.persona_prompt().alias("prompt"))


@query("SELECT source, label, max(doc_id) AS doc_id, arg_max(lang, doc_id) AS lang FROM (SELECT source, lang, doc_id, doc_id % 2 AS label FROM documents) GROUP BY source, label")
def last_writer_wins(spark, d):
    doc = table(spark, d, "documents").select(F.struct("source", (F.col("doc_id") % 2).alias("label")).alias("name"), "lang", "doc_id", F.col("doc_id").alias("o"))
    return catalog.last_wins(doc, "o").select("name.source", "name.label", "doc_id", "lang")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def coverage_anti(spark, d):
    return catalog.without_knowledge(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").select("doc_id", "lang")


@query("SELECT text, source, NULL::VARCHAR AS url FROM documents UNION ALL SELECT text, NULL, NULL FROM benchmark UNION ALL SELECT html, NULL, url FROM pages")
def union_sources(spark, d):
    parts = [table(spark, d, "documents").select("text", "source"), table(spark, d, "benchmark").select("text"), table(spark, d, "pages").select(F.col("html").alias("text"), "url")]
    return catalog.union_all(parts).select("text", "source", "url")


# --- export (K7-K9, X9-X12) ---

AT = "2024-05-06 07:08:09"
MD = f"""'# 与' || {{name}} || '的对话' || chr(10) || chr(10) || '**导出时间**: {AT}' || chr(10) || chr(10) || '## 对话记录' || chr(10) || chr(10) || '---' || chr(10) || chr(10)
|| string_agg('### ' || CASE WHEN role = 'user' THEN '👤 用户' ELSE '🎭 ' || {{name}} END || chr(10) || chr(10) || text || chr(10) || chr(10) || '---' || chr(10), chr(10) ORDER BY turn) || chr(10) || chr(10) || '*由「历史人物对话」系统生成*' || chr(10)"""


@query(f"SELECT conv_id, {MD.format(name='(\'C\' || conv_id)')} AS markdown FROM conversations GROUP BY conv_id")
def export_markdown(spark, d):
    return export.markdown(table(spark, d, "conversations"), "conv_id", "turn", F.concat(F.lit("C"), "conv_id"), F.lit(AT).cast("timestamp"))


@query("SELECT page_id, '对话_' || translate(url, '/\\', '__') || '_20240506_070809.md' AS file FROM pages")
def export_filename(spark, d):
    return table(spark, d, "pages").select("page_id", export.filename(F.col("url"), F.lit("md"), F.lit(AT).cast("timestamp")).alias("file"))


@query()
def export_pdf(spark, d):
    return export.pdf(export_markdown(spark, d)).select("conv_id", F.length("pdf").alias("bytes"))


ERRORS = "CASE page_id % 4 WHEN 0 THEN 'Connection refused ' WHEN 1 THEN 'read TIMEOUT ' WHEN 2 THEN 'bad Api_Key ' ELSE 'connection reset ' END || url"


@query(f"SELECT page_id, CASE WHEN contains(m, 'Connection') OR contains(lower(m), 'timeout') THEN 'network' WHEN contains(lower(m), 'api_key') OR contains(lower(m), 'unauthorized') THEN 'auth' ELSE 'generic' END AS kind FROM (SELECT page_id, {ERRORS} AS m FROM pages)")
def error_class(spark, d):
    return table(spark, d, "pages").selectExpr("page_id", f"{ERRORS} AS m").select("page_id", tx.error_class(F.col("m")).alias("kind"))


@query("SELECT doc_id, replace(text, chr(10), '<br>') AS html, substr(text, 1, 60) || '...' AS preview FROM documents")
def text_views(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.line_breaks(F.col("text")).alias("html"), tx.preview(F.col("text")).alias("preview"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t, strftime(ts, '%Y%m%d_%H%M%S') AS f FROM events")
def timestamps(spark, d):
    return table(spark, d, "events").select("event_id", tx.timestamp_text(F.col("ts")).alias("t"), tx.timestamp_text(F.col("ts"), "yyyyMMdd_HHmmss").alias("f"))


# --- a whole chat turn (E1-E4, T5, X2-X5) ---


@query()
def chat_turns(spark, d):
    """Each conversation talks to one character of the catalog; benchmark items are the knowledge."""
    names = F.array(*[F.lit(r[0]) for r in CHARS])
    turns = table(spark, d, "conversations").withColumn("name", F.element_at(names, (F.col("conv_id") % len(CHARS) + 1).cast("int")))
    rows = table(spark, d, "benchmark").select(F.concat(F.lit("item "), "item_id").alias("title"), F.lit("benchmark").alias("source"), F.lit("").alias("url"), F.element_at(names, (F.col("item_id") % 3 + 1).cast("int")).alias("character"), F.col("text").alias("content"))
    idx = settled(embed(index.chunks_of(rows), "content"))
    said = chat.chat(turns, chars(spark), idx)
    return said.select("conv_id", "turn", "name", "reply", F.size("messages").alias("n_messages"))


# --- files and fetching: written to the shared folder by the sinks, read back by the sources (S1, S2, S9, S16, F5, H8, K1, K4, K5, L1) ---


@query("SELECT 'biography_item ' || item_id || '_benchmark.txt' AS file, 'item ' || item_id AS title, 'benchmark' AS source, '' AS url, 'item ' || item_id AS character, 'biography' AS category, text AS content FROM benchmark")
def kb_files(spark, d):
    """One named file an item."""
    name = F.concat(F.lit("item "), "item_id")
    rows = table(spark, d, "benchmark").select(name.alias("title"), F.lit("benchmark").alias("source"), F.lit("").alias("url"), F.lit("biography").alias("category"), name.alias("character"), F.col("text").alias("content"))
    return read_back(spark, lambda p: knowledge.write_files(knowledge.render(rows), p), lambda p: knowledge.read_knowledge(spark, p).select("file", "title", "source", "url", "character", "category", "content"))


@query("SELECT n_name AS name, 'region ' || n_regionkey AS dynasty, 'nation ' || n_nationkey AS title FROM nation")
def catalog_files_read(spark, d):
    """A YAML file for each nation (JSON is YAML)."""
    rest = [F.lit("x").alias(c) for c in catalog_files.TEXTS[3:]]
    record = F.struct(F.col("n_name").alias("name"), F.concat(F.lit("region "), "n_regionkey").alias("dynasty"), F.concat(F.lit("nation "), "n_nationkey").alias("title"), *rest)
    rows = table(spark, d, "nation").select(F.concat("n_nationkey", F.lit(".yaml")).alias("file"), F.to_json(record).alias("value"))
    return read_back(spark, lambda p: knowledge.write_files(rows, p), lambda p: catalog_files.read_catalog(spark, p).select("name", "dynasty", "title"))


@query("SELECT item_id || CASE item_id % 3 WHEN 0 THEN '.txt' ELSE '.MD' END AS file, 0 AS page, text AS content FROM benchmark WHERE item_id % 3 < 2")
def directory_scan(spark, d):
    """Files of two known suffixes and an unknown one."""
    suffix = F.element_at(F.array(F.lit(".txt"), F.lit(".MD"), F.lit(".csv")), (F.col("item_id") % 3 + 1).cast("int"))
    rows = table(spark, d, "benchmark").select(F.concat("item_id", suffix).alias("file"), F.col("text").alias("value"))
    return read_back(spark, lambda p: knowledge.write_files(rows, p), lambda p: files.load_directory(spark, p).select(F.substring_index("source_file", "/", -1).alias("file"), "page", "content"))


@query("SELECT item_id || CASE item_id % 3 WHEN 0 THEN '.txt' ELSE '.MD' END AS file, 0 AS page, text AS content FROM benchmark WHERE item_id % 3 = 0")
def directory_format(spark, d):
    """The same files through a format of spark.read, whose scan opens those of the asked suffix alone."""
    datasource.register(spark)
    suffix = F.element_at(F.array(F.lit(".txt"), F.lit(".MD"), F.lit(".csv")), (F.col("item_id") % 3 + 1).cast("int"))
    rows = table(spark, d, "benchmark").select(F.concat("item_id", suffix).alias("file"), F.col("text").alias("value"))

    def found(path):
        read = spark.read.format("lorewell_documents").load(path).where("suffix = '.txt'")
        return read.select(F.substring_index("source", "/", -1).alias("file"), "page", "content")

    return read_back(spark, lambda p: knowledge.write_files(rows, p), found)


@query("SELECT url, 'page ' || min(page_id) AS title, '2024-01-01' AS time FROM pages GROUP BY url")
def page_cache_file(spark, d):
    """The cache as a JSON file."""
    cache = table(spark, d, "pages").groupBy("url").agg(F.concat(F.lit("page "), F.min("page_id")).alias("title"), F.lit("2024-01-01").alias("time"))
    return read_back(spark, lambda p: pages.write_cache(cache, f"{p}/cache.json"), lambda p: pages.read_cache(spark, f"{p}/cache.json"))


def _by_length(url: str) -> tuple[int, str | None]:
    if len(url) % 3 == 1:
        raise ConnectionError(url)
    return (403, None) if len(url) % 3 == 0 else (200, url.upper())


@query("SELECT page_id, CASE length(url) % 3 WHEN 0 THEN 403 WHEN 2 THEN 200 END AS status, CASE length(url) % 3 WHEN 2 THEN 1 ELSE 3 END AS attempts, CASE length(url) % 3 WHEN 2 THEN upper(url) END AS html FROM pages")
def page_fetch(spark, d):
    """F5, H8 with a plug-in whose answer is told by the url's length."""
    got = fetch.fetch(table(spark, d, "pages").select("page_id", "url"), _by_length, blocked_wait=0, error_wait=0)
    return got.select("page_id", "status", "attempts", "html")


@query("SELECT page_id, CASE length(url) % 3 WHEN 0 THEN 403 WHEN 2 THEN 200 END AS status, CASE length(url) % 3 WHEN 2 THEN 1 ELSE 3 END AS attempts, CASE length(url) % 3 WHEN 2 THEN upper(url) END AS html FROM pages")
def page_fetch_politely(spark, d):
    """The same through queues by host and rounds that are written."""

    def take(path):
        return fetch.fetch_politely(table(spark, d, "pages").select("page_id", "url"), path, _by_length, spacing=0, round_wait=0)

    return read_back(spark, take, take).select("page_id", "status", "attempts", "html")


@query("SELECT 'S11' AS crawl, page_id, upper(url) AS content FROM pages WHERE length(url) % 3 = 2 AND length(url) >= 50")
def page_crawl(spark, d):
    """A crawl whose site is played by the plug-in: the pages' urls stand for names, and what is fetched is their capitals in a page."""
    names = table(spark, d, "pages").select("page_id", F.col("url").alias("name"))

    def page(url):
        name = url.removeprefix("https://baike.baidu.com/item/")
        status, text = _by_length(name)
        return status, text and f'<h1>t</h1><div class="main-content"><p>{text.replace("&", "&amp;")}</p></div>'

    got = read_back(spark, lambda p: fetch.crawl(names, p, page, blocked_wait=0, error_wait=0), lambda p: fetch.crawl(names, p, page, blocked_wait=0, error_wait=0))
    return got.join(names, F.col("character") == F.col("name")).select(F.lit("S11").alias("crawl"), "page_id", "content")


@query("SELECT conv_id, turn, coalesce(text, '') AS reply, true AS once FROM conversations WHERE role = 'user'")
def ledger_replies(spark, d):
    """Replies through a ledger, which two runs fill with one call a different request."""
    asked = table(spark, d, "conversations").where("role = 'user'")
    asked = asked.withColumn("messages", F.array(F.struct(F.lit("user").alias("role"), F.coalesce("text", F.lit("")).alias("content"))))

    def found(path):
        replies = ledger.generate_once(asked, path)
        said = ledger.summary(spark, path)
        return replies.select("conv_id", "turn", "reply", F.lit(said["calls"] == said["requests"] == said["replies"]).alias("once"))

    return read_back(spark, found, found)


@query("SELECT doc_id, lang FROM documents WHERE regexp_matches(text, '\\S')")
def index_documents(spark, d):
    """K5, L1: the documents that a written index holds after it was ensured twice."""
    docs = table(spark, d, "documents").select("doc_id", "lang", F.col("text").alias("content"))

    def write(path):
        for _ in range(2):
            index.ensure(spark, path, docs)

    return read_back(spark, write, lambda p: index.read(spark, p).select("doc_id", "lang").distinct())


@query("""SELECT source AS doc_source, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents WHERE lang <> 'de' OR doc_id % 2 = 0 GROUP BY source""")
def index_generations(spark, d):
    """K5, K6: documents written in two generations, some deleted by id and half of them written again, compacted, then read."""
    docs = table(spark, d, "documents").select("doc_id", "lang", F.col("source").alias("doc_source"))

    def write(path):
        generations.replace(docs.where("doc_id % 3 = 0"), path)
        generations.append(docs.where("doc_id % 3 > 0"), path)
        generations.delete(docs.where("lang = 'de'").select("doc_id"), path, "doc_id")
        generations.append(docs.where("lang = 'de' AND doc_id % 2 = 0"), path)
        generations.compact(spark, path)
        generations.vacuum(spark, path)

    rows = read_back(spark, write, lambda p: generations.read(spark, p))
    return rows.groupBy("doc_source").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


# --- extensions (X in the survey): relational shapes the reference lacks ---


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def x_cube(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.count(F.lit(1)).alias("n"))


@query("WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM e) SELECT user_id, session::BIGINT AS session, count(*) AS n, min(ts) AS began, max(ts) AS ended FROM s GROUP BY user_id, session")
def x_sessions(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts") - F.lag("ts").over(w) <= F.expr("interval 30 minutes")
    e = table(spark, d, "events").withColumn("new", F.when(gap, 0).otherwise(1))
    s = e.withColumn("session", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("began"), F.max("ts").alias("ended"))


@query("SELECT n_name, o_orderpriority, sum(round(l_extendedprice * (1 - l_discount) * 100)::BIGINT)::BIGINT AS cents FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, o_orderpriority")
def x_star_join(spark, d):
    li, o, c, n = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    # whole cents add up alike in any order
    rev = F.sum(F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("long")).alias("cents")
    return li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name", "o_orderpriority").agg(rev)
