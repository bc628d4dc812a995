"""One object over the operators: catalog, index, search, memory, chat and export.

Tables live under one folder of any file system that Spark writes: <home>/index, <home>/memory and <home>/replies (of the
last call of chat).
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.config import Settings, get_settings
from lorewell.functions.embed import Embedder, embed, extractive_reply, hashed_ngrams
from lorewell.operators import catalog, chat, export, index, knn, memory
from lorewell.sources import catalog_files, files, knowledge

MESSAGE = "conv_id string, turn long, role string, text string"


class Engine:
    def __init__(self, spark: SparkSession, home: str, characters: DataFrame | None = None, embedder: Embedder = hashed_ngrams, generator=extractive_reply, settings: Settings | None = None, replies_once: bool = False) -> None:
        self.spark, self.home = spark, home.rstrip("/")
        self.embedder, self.generator = embedder, generator
        self.settings = settings or get_settings()
        # with a ledger, a call of chat that is repeated after a failure generates no reply anew
        self.ledger = f"{self.home}/ledger" if replies_once else None
        self.characters = characters
        self.index_path = f"{self.home}/index"

    # --- catalog ---

    def load_characters(self, path: str) -> DataFrame:
        self.characters = catalog_files.read_catalog(self.spark, path)
        return self.characters

    def character(self, name: str) -> DataFrame:
        return self.characters.where(F.col("name") == name)

    def names(self) -> DataFrame:
        return self.characters.select("name")

    def by_dynasty(self) -> DataFrame:
        return catalog.grouped(self.characters, catalog.dynasty_order(self.spark))

    def profile(self, name: str) -> DataFrame:
        return catalog.profile(self.characters, name)

    def recommended(self) -> DataFrame:
        return catalog.recommended(self.spark, self.characters)

    # --- knowledge ---

    def load_knowledge(self, path: str, compat_prefix: bool = False) -> DataFrame:
        return knowledge.read_knowledge(self.spark, path, compat_prefix)

    def load_directory(self, path: str) -> DataFrame:
        return files.load_directory(self.spark, path)

    def add_documents(self, docs: DataFrame) -> int:
        """Chunks that the index lacked; documents have content and the six metadata columns."""
        return index.append(docs, self.index_path, self.embedder)

    def rebuild(self, docs: DataFrame) -> int:
        return index.build(docs, self.index_path, self.embedder)

    def ensure(self, docs: DataFrame) -> int:
        return index.ensure(self.spark, self.index_path, docs, self.embedder)

    def count(self) -> int:
        return index.count(self.spark, self.index_path)

    def clear_index(self) -> None:
        index.clear(self.spark, self.index_path)

    def use_index(self, path: str) -> None:
        """Another store for all later calls."""
        self.index_path = path

    @property
    def index(self) -> DataFrame:
        return index.read(self.spark, self.index_path)

    # --- search ---

    def _query(self, text: str) -> DataFrame:
        return embed(self.spark.createDataFrame([(text,)], "text string"), "text", embedder=self.embedder).select("embedding")

    def search(self, text: str, k: int = 4, filters: dict | None = None) -> DataFrame:
        return knn.topk(self.index, self._query(text), k, filters).drop("embedding").orderBy("rank")

    def search_by_character(self, text: str, name: str, k: int = 3) -> DataFrame:
        return self.search(text, k, {"character": name})

    def search_by_category(self, text: str, category: str, k: int = 3) -> DataFrame:
        return self.search(text, k, {"category": category})

    def retrieve(self, text: str, name: str) -> DataFrame:
        """The character's own chunks or, if there are none, any."""
        return knn.topk_with_fallback(self.index, self._query(text), self.settings.rag_top_k, {"character": name}).drop("embedding").orderBy("rank")

    def smoke(self) -> DataFrame:
        return index.smoke(self.spark, self.index_path, embedder=self.embedder)

    # --- chat and memory ---

    @property
    def _memory_path(self) -> str:
        return f"{self.home}/memory"

    def messages(self) -> DataFrame:
        """All remembered messages; none before the first chat."""
        try:
            return self.spark.read.schema(MESSAGE).parquet(self._memory_path)
        except AnalysisException:
            return self.spark.createDataFrame([], MESSAGE)

    def history(self, session: str | None = None) -> DataFrame:
        """The last messages since the last clear."""
        rows = self.messages() if session is None else self.messages().where(F.col("conv_id") == session)
        return memory.last_n(memory.after_clear(rows, F.col("role") == "clear"), self.settings.max_history)

    def chat(self, asked: DataFrame) -> DataFrame:
        """E4 for one input per session: (conv_id, name, text) to (conv_id, name, text, reply, reply_error, context_text).

        The input and the reply enter memory only where the reply succeeded.
        """
        old = self.history()
        place = self.messages().groupBy("conv_id").agg((F.max("turn") + 1).alias("turn"))
        new = asked.join(place, "conv_id", "left").withColumn("turn", F.coalesce("turn", F.lit(0).cast("long"))).withColumn("role", F.lit("user"))
        turns = old.join(asked.select("conv_id", "name"), "conv_id").unionByName(new.select("conv_id", "turn", "role", "text", "name"))
        said = chat.chat(turns, self.characters, self.index, generator=self.generator, replies=self.ledger, k=self.settings.rag_top_k, n=self.settings.max_history, embedder=self.embedder)
        # written first: what is generated must not be generated anew once memory has grown
        said.join(new.select("conv_id", "turn"), ["conv_id", "turn"]).select("conv_id", "turn", "name", "text", "reply", "reply_error", "context_text").write.mode("overwrite").parquet(f"{self.home}/replies")
        said = self.spark.read.parquet(f"{self.home}/replies")
        rows = said.where("reply is not null").select("conv_id", F.explode(F.array(F.struct("turn", F.lit("user").alias("role"), "text"), F.struct((F.col("turn") + 1).alias("turn"), F.lit("assistant").alias("role"), F.col("reply").alias("text")))).alias("m"))
        rows.select("conv_id", "m.*").write.mode("append").parquet(self._memory_path)
        return said.select("conv_id", "name", "text", "reply", "reply_error", "context_text")

    def clear(self, session: str) -> None:
        """M2: a marker after which the session starts anew."""
        last = self.messages().where(F.col("conv_id") == session).agg(F.max("turn")).first()[0]
        if last is not None:
            self.spark.createDataFrame([(session, last + 1, "clear", None)], MESSAGE).write.mode("append").parquet(self._memory_path)

    def clear_all(self) -> None:
        """M3."""
        self.spark.createDataFrame([], MESSAGE).write.mode("overwrite").parquet(self._memory_path)

    def history_text(self, session: str) -> DataFrame:
        return memory.history_string(self.history(session), self.settings.max_history)

    # --- export ---

    def export_markdown(self, session: str, name: str, at: dt.datetime) -> DataFrame:
        return export.markdown(self.messages().where((F.col("conv_id") == session) & (F.col("role") != "clear")), "conv_id", "turn", F.lit(name), F.lit(at))

    def export_pdf(self, session: str, name: str, at: dt.datetime) -> DataFrame:
        return export.pdf(self.export_markdown(session, name, at))

    def kpis(self) -> DataFrame:
        return catalog.kpis(self.characters, self.index)
