"""A batch of chat turns: retrieve, assemble, generate (E4, E6, J6; section 3.1 of the survey)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.functions.embed import Embedder, embed, extractive_reply, generate, hashed_ngrams
from lorewell.operators import context, knn, ledger, memory


def prompts(turns: DataFrame, chars: DataFrame, index: DataFrame, k: int = 3, n: int = 10, embedder: Embedder = hashed_ngrams) -> DataFrame:
    """messages for every user turn of (conv_id, turn, role, text, name); turns of unknown names are left out.

    The evidence is the character's own chunks, or any chunk if there is none.
    """
    asked = memory.as_of(turns, n).where("role = 'user'").join(chars, "name")
    asked = asked.withColumns({"query_id": F.xxhash64("conv_id", "turn"), "character": F.col("name")})
    q = embed(asked, "text", "q", embedder)
    hits = knn.batch_topk_with_fallback(index, q, k, by=["character"])
    meta = index.select("vec_id", "content", "title", "source", "url", "character")
    cited = context.citations(hits.join(meta, "vec_id"))
    block = context.evidence(cited, ["query_id"])
    system = context.system_prompt(context.persona_prompt(), F.col("context_text"))
    return asked.join(block, "query_id", "left").withColumn("messages", context.messages(system, F.col("history"), F.col("text")))


def chat(turns: DataFrame, chars: DataFrame, index: DataFrame, generator=extractive_reply, replies: str | None = None, **kw) -> DataFrame:
    """Replies; those that failed have null and an error, and are not to enter memory.

    replies: the path of a ledger. What it has is not generated again, so a rerun makes no call; it is filled when this is called.
    """
    asked = prompts(turns, chars, index, **kw)
    return ledger.generate_once(asked, replies, generator) if replies else generate(asked, generator=generator)
