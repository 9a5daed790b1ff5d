"""One object over a knowledge base: questions in, results, contexts and answers out."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions.text import words
from lodestack.operators import context as cx
from lodestack.operators import graph as g
from lodestack.operators import services as sv
from lodestack.operators import strategies as st
from lodestack.session import cut


@dataclass
class Result:
    """What a batch of questions gave: found rows by kind, contexts, references and answers, each with query_id."""

    found: st.Found
    contexts: DataFrame | None = None
    references: DataFrame | None = None
    responses: DataFrame | None = None


class Engine:
    """Retrieval and answers over a Store.

    embed gives vectors of texts, model answers prompts; both may be absent for what doesn't
    need them. The cache (id, return_value) is replaced as calls are made.
    """

    def __init__(
        self, spark: SparkSession, store: st.Store, embed: Callable[[list[str]], np.ndarray] | None = None, dim: int = 64,
        model: sv.Model | None = None, options: st.Options | None = None, cache: DataFrame | None = None,
    ):
        self.spark, self.store, self.embed, self.dim, self.model = spark, store, embed, dim, model
        self.options = options or st.Options()
        self.cache = cache if cache is not None else spark.createDataFrame([], "id string, return_value string")

    def questions(self, texts: Sequence[str] | DataFrame) -> DataFrame:
        """(query_id, question) of given texts."""
        if isinstance(texts, DataFrame):
            return texts
        return self.spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id bigint, question string")

    def _keep(self, new: DataFrame) -> None:
        self.cache = cut(self.cache.select("id", "return_value").unionByName(new.select("id", "return_value")))

    def vectors(self, questions: DataFrame, hyde: bool = False) -> DataFrame:
        """(query_id, query) of the questions, or of passages made up for them."""
        if self.embed is None:
            raise ValueError("searching needs an embedder")
        if hyde:
            out, new = sv.hypothetical(questions, self.cache, self._model(), self.embed, self.dim)
            self._keep(new)
            return cut(out)
        return cut(sv.embed_column(questions.select("query_id", "question"), "question", self.embed, self.dim, "query").select("query_id", "query"))

    def _model(self, call: Callable | None = None) -> sv.Model:
        if self.model is None and call is None:
            raise ValueError("this needs a model")
        return sv.overridden(self.model or sv.Model(call), call)

    def retrieve(self, texts: Sequence[str] | DataFrame, mode: str = "hybrid_mix", hyde: bool = False, **options) -> st.Found:
        """Entities, relations and chunks of the questions by a mode."""
        plan = st.strategy(mode)
        if mode == "bypass":
            return st.Found()
        o = replace(self.options, **options)
        questions = cut(self.questions(texts))
        terms = questions.select("query_id", F.explode(words("question")).alias("term"))
        return plan(self.store, self.vectors(questions, hyde), o, questions, terms)

    def query_data(self, texts: Sequence[str] | DataFrame, mode: str = "hybrid_mix", **options) -> Result:
        """What retrieve() finds, and the contexts and references made of it."""
        found = self.retrieve(texts, mode, **options)
        if mode == "bypass":
            return Result(found)
        options.pop("hyde", None)
        o = replace(self.options, **options)
        refs = st.cited_chunks(self.store, found.chunks, o.total_tokens)[1] if found.chunks is not None else None
        return Result(found, st.contexts(found, self.store, o), refs)

    def query_llm(self, texts: Sequence[str] | DataFrame, mode: str = "hybrid_mix", call: Callable | None = None, user_prompt: str = "", response_type: str = "Multiple Paragraphs", **options) -> Result:
        """query_data() and the model's answers; `call` replaces the model for this batch."""
        questions = cut(self.questions(texts))
        result = self.query_data(questions, mode, **options)
        empty = self.spark.createDataFrame([], "query_id bigint, context string")
        contexts = empty if result.contexts is None else result.contexts
        result.responses, new = sv.answers(contexts, questions, self.cache, self._model(call), mode, user_prompt, response_type)
        result.responses = cut(result.responses)
        self._keep(new)
        return result

    def query(self, texts: Sequence[str] | DataFrame, mode: str = "hybrid_mix", **options) -> DataFrame:
        """query_id and response."""
        return self.query_llm(texts, mode, **options).responses

    def query_parts(self, texts: Sequence[str] | DataFrame, mode: str = "hybrid_mix", **options) -> DataFrame:
        """Results of the sub-questions of each question as one list: question_id, what, key, position, reference_id."""
        questions = self.questions(texts)
        parts, new = sv.decomposed(questions, self.cache, self._model())
        self._keep(new)
        parts = cut(parts.withColumn("query_id", F.col("question_id") * 1000 + F.col("sub")))
        found = self.retrieve(parts.select("query_id", "question"), mode, **options)
        rows = None
        for what, df, key in (("entity", found.entities, F.col("label")), ("relation", found.relations, F.concat_ws("<SEP>", "src", "tgt")), ("chunk", found.chunks, F.col("chunk_id"))):
            if df is not None:
                part = df.select("query_id", F.lit(what).alias("what"), key.alias("key"), "rank")
                rows = part if rows is None else rows.unionByName(part)
        paths = self.store.chunks.select(F.lit("chunk").alias("what"), F.col("chunk_id").alias("key"), "file_path")
        rows = rows.join(parts.select("query_id", "question_id", "sub"), "query_id").join(paths, ["what", "key"], "left")
        return cx.merged_queries(rows)

    def keywords(self, texts: Sequence[str] | DataFrame, mode: str = "hybrid") -> DataFrame:
        out, new = sv.keywords(self.questions(texts), self.cache, self._model(), mode)
        out = cut(out)
        self._keep(new)
        return out

    def labels(self) -> DataFrame:
        """All labels in order."""
        return self.store.nodes.select("label").distinct().orderBy(F.lower("label"), "label")

    def subgraph(self, label: str, hops: int = 3, most: int = 1000) -> tuple[DataFrame, DataFrame, bool]:
        """Nodes and edges around a label, or with * of the largest degrees, and whether there would be more."""
        if label == "*":
            ranked = g.degrees(self.store.edges, self.store.nodes).orderBy(F.desc("degree"), "label").limit(most + 1)
            found = cut(ranked.select("label", F.lit(0).alias("depth")))
        else:
            found = cut(g.bounded_search(self.store.edges, label, hops, most + 1))
        cut_off = found.count() > most
        nodes = found.limit(most) if not cut_off else cut(g.first_nodes(found, self.store.edges, most))
        return nodes, g.induced(self.store.edges, nodes), cut_off

    def clear_cache(self, kinds: Sequence[str] = ()) -> None:
        """Forget cached answers: all, or those of some kinds."""
        kind = F.split("id", ":")[1]
        self.cache = cut(self.cache.filter(~kind.isin(*kinds)) if kinds else self.cache.limit(0))
