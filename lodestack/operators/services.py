"""Seams to models, with deterministic stand-ins, the cache around them, and what is asked through them."""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, fields, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions.text import cache_key, sanitize, string_list, without_echo, without_thoughts
from lodestack.operators import extraction as ex
from lodestack.session import cut, env_int, reachable


@dataclass(frozen=True)
class Model:
    """How a model is called: `call` takes prompts and gives as many answers, in any worker.

    Calls are made by at most `at_once` threads a task, `batch` prompts each, and repeated up
    to `retries` times with doubled waits from `wait` to `most_wait` seconds. Lower
    `priority` goes first where several jobs share a cluster with fair pools.
    """

    call: Callable[[list[str]], list[str]]
    at_once: int = 4
    batch: int = 1
    retries: int = 3
    wait: float = 0.5
    most_wait: float = 30.0
    priority: int = 10


def bound_options(defaults, given: dict[str, str], prefix: str = ""):
    """A dataclass of settings with those of `given` (such as the environment) put in, read by the default's kind."""
    out = {}
    for f in fields(defaults):
        raw, old = given.get(f"{prefix}{f.name}".upper()), getattr(defaults, f.name)
        if raw is None:
            continue
        if isinstance(old, bool):
            out[f.name] = raw.strip().lower() in ("1", "true", "yes", "on")
        elif isinstance(old, int):
            out[f.name] = env_int(raw, old, 0)
        elif isinstance(old, float):
            out[f.name] = float(raw)
        else:
            out[f.name] = raw
    return replace(defaults, **out)


def overridden(model: Model, call: Callable[[list[str]], list[str]] | None) -> Model:
    """The model, or the same settings with another call for one query."""
    return model if call is None else replace(model, call=call)


def pool_of(spark: SparkSession, model: Model) -> None:
    """Run the next jobs of this thread in the fair pool of the model's priority."""
    spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"priority-{model.priority}")


def insistent(model: Model, prompts: list[str]) -> list[str]:
    """Answers to prompts, tried again after failures; the last failure is raised."""
    wait = model.wait
    for turn in range(model.retries + 1):
        try:
            out = model.call(prompts)
            if len(out) != len(prompts):
                raise ValueError(f"{len(prompts)} prompts gave {len(out)} answers")
            return list(out)
        except Exception:
            if turn == model.retries:
                raise
            time.sleep(wait)
            wait = min(model.most_wait, 2 * wait)
    return []


def asked(prompts: DataFrame, model: Model, key: str = "id", prompt: str = "prompt") -> DataFrame:
    """key and return_value of every prompt, calls of a task side by side within the model's bound."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(model.at_once) as pool:
            for rows in batches:
                texts = rows[prompt].fillna("").tolist()
                parts = [texts[lo : lo + model.batch] for lo in range(0, len(texts), model.batch)]
                answers = [a for part in pool.map(lambda p: insistent(model, p), parts) for a in part]
                yield pd.DataFrame({key: rows[key], "return_value": answers})

    reachable(prompts.sparkSession)
    return prompts.select(key, prompt).mapInPandas(run, f"`{key}` {dict(prompts.dtypes)[key]}, return_value string")


class Calls:
    """Counts of calls and of cache hits over a session, by accumulators."""

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._counts = {k: spark.sparkContext.accumulator(0) for k in ("llm_call", "llm_cache", "embed_call", "prompt_tokens", "answer_tokens")}

    def add(self, **more: int) -> None:
        for k, n in more.items():
            self._counts[k].add(int(n))

    def counts(self) -> dict[str, int]:
        return {k: a.value for k, a in self._counts.items()}

    def append_csv(self, path: str) -> None:
        """One more row of the counts so far in a folder of CSV files."""
        row = [(time.strftime("%Y-%m-%d %H:%M:%S"), *self.counts().values())]
        schema = "at string, " + ", ".join(f"{k} bigint" for k in self._counts)
        self._spark.createDataFrame(row, schema).coalesce(1).write.mode("append").option("header", True).csv(path)


def embed_column(df: DataFrame, text: str, embed: Callable[[list[str]], np.ndarray], dim: int, out: str = "vector", batch: int = 16) -> DataFrame:
    """df with vectors of a text column; longer vectors are cut to dim, a wrong number of vectors fails the task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            vectors = []
            for lo in range(0, len(rows), batch):
                texts = rows[text].iloc[lo : lo + batch].fillna("").tolist()
                got = np.asarray(embed(texts), np.float32)
                if len(got) != len(texts) or got.shape[1] < dim:
                    raise ValueError(f"{len(texts)} texts gave vectors of shape {got.shape}, {dim} wanted")
                vectors.extend(got[:, :dim].tolist())
            yield rows.assign(**{out: vectors})

    reachable(df.sparkSession)
    kinds = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInPandas(run, f"{kinds}, `{out}` array<float>")


def vector_upsert(old: DataFrame, rows: DataFrame, text: str, embed: Callable[[list[str]], np.ndarray], dim: int, keys: Sequence[str] = ("id",)) -> DataFrame:
    """A table of vectors (keys, text, vector, ...) with rows embedded and put in place of those of equal keys."""
    new = embed_column(rows.dropDuplicates(list(keys)), text, embed, dim)
    return old.join(rows.select(*keys).distinct(), list(keys), "left_anti").unionByName(new.select(*old.columns))


def counted_tokens(df: DataFrame, text: str, count: Callable[[list[str]], list[int]], out: str = "n_tokens") -> DataFrame:
    """df with the number of tokens of a text column by a tokenizer; null texts have 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(**{out: count(rows[text].fillna("").tolist())})

    reachable(df.sparkSession)
    kinds = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInPandas(run, f"{kinds}, `{out}` bigint")


def hash_embed(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """The stand-in embedder: words hashed to signed places, unit norm."""

    def embed(texts: list[str]) -> np.ndarray:
        x = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                x[i, h % dim] += 1 if h >> 31 else -1
            x[i, 0] += 1e-3
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    return embed


def rerank_column(df: DataFrame, question: str, content: str, score: Callable[[str, list[str], int], list[tuple[int, float]]], groups: Sequence[str] = ("query_id",)) -> DataFrame:
    """df with rerank_score, by a model that takes a question, its contents and how many to rate, and gives places and scores.

    Places it leaves out, and all of a question for which it fails, have no score. A group is
    the candidate list of one query.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = np.full(len(rows), np.nan)
        try:
            for at, s in score(rows[question].iloc[0], rows[content].fillna("").tolist(), len(rows)):
                if 0 <= at < len(rows):
                    out[at] = s
        except Exception:
            out[:] = np.nan
        return rows.assign(rerank_score=[None if np.isnan(v) else float(v) for v in out])

    reachable(df.sparkSession)
    kinds = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.groupBy(*groups).applyInPandas(run, f"{kinds}, rerank_score double")


def payload(model: str, question: str, documents: list[str], top_n: int | None = None, extra: dict | None = None) -> dict:
    """What a reranking service is sent: how many to rate is always a number."""
    return {"model": model, "query": question, "documents": documents, "top_n": int(top_n) if top_n else len(documents), **(extra or {})}


def cached_calls(prompts: DataFrame, cache: DataFrame, call: Callable[[list[str]], list[str]] | Model, mode: str, kind: str, calls: Calls | None = None) -> tuple[DataFrame, DataFrame]:
    """Answers for prompts (id, prompt, and where given system and history): from the cache where it has them, else by the model.

    The key is made of the cleaned prompt, system prompt and history. Gives all answers (id,
    cache_id, return_value) and the new cache rows (id, return_value, original_prompt,
    cache_type). Equal prompts are asked once. The cache has id and return_value.
    """
    model = call if isinstance(call, Model) else Model(call, batch=16)
    have = [c for c in ("system", "history") if c in prompts.columns]
    parts = [sanitize("prompt"), *[F.coalesce(F.col(c), F.lit("")) for c in have]]
    keyed = prompts.withColumn("cache_id", cache_key(F.lit(mode), F.lit(kind), *parts))
    whole = F.concat_ws("\n", *have, "prompt") if have else F.col("prompt")
    known = cache.select(F.col("id").alias("cache_id"), "return_value").dropDuplicates(["cache_id"])
    lacking = keyed.select("cache_id", whole.alias("prompt")).dropDuplicates(["cache_id"]).join(known, "cache_id", "left_anti")
    new = cut(asked(lacking, model, "cache_id").join(lacking.withColumnRenamed("prompt", "original_prompt"), "cache_id"))
    if calls is not None:
        n = new.count()
        calls.add(llm_call=n, llm_cache=keyed.select("cache_id").distinct().count() - n)
    answers = keyed.select("id", "cache_id").join(known.unionByName(new.select("cache_id", "return_value")), "cache_id")
    return answers, new.select(F.col("cache_id").alias("id"), "return_value", "original_prompt", F.lit(kind).alias("cache_type"))


KEYWORDS = "Name the broad themes and the particular things of this question as JSON with the lists high_level_keywords and low_level_keywords.\n\nQuestion: "
DECOMPOSE = "Split this question into the fewest questions that can be answered on their own. Give a JSON array of strings.\n\nQuestion: "
HYPOTHESIS = "Write a short passage that would answer this question.\n\nQuestion: "
EXTRACT = (
    "List the entities and relations of the text, a record a line, fields divided by <|#|>, <|COMPLETE|> at the end.\n"
    "entity<|#|>name<|#|>type<|#|>description\nrelation<|#|>name<|#|>name<|#|>keywords<|#|>description\n\nText:\n"
)
GLEAN = "Some entities and relations were missed or written wrongly. List only these, in the same form."
ANSWER = "Answer from the context only and cite its files by number.\n\n"
IMAGE = "Describe what this image of a document shows: "


def keywords(questions: DataFrame, cache: DataFrame, model: Model, mode: str = "hybrid") -> tuple[DataFrame, DataFrame]:
    """query_id, high and low keywords of questions (query_id, question), and new cache rows.

    A question for which neither list comes out has itself as low keyword if it is short.
    """
    prompts = questions.select(F.col("query_id").cast("string").alias("id"), F.concat(F.lit(KEYWORDS), "question").alias("prompt"))
    answers, new = cached_calls(prompts, cache, model, mode, "keywords")
    lists = answers.select(F.col("id").cast("bigint").alias("query_id"), *[_named(k).alias(a) for k, a in (("high_level_keywords", "high"), ("low_level_keywords", "low"))])
    rows = questions.select("query_id", "question").join(lists, "query_id", "left")
    none = (F.coalesce(F.size("high"), F.lit(0)) < 1) & (F.coalesce(F.size("low"), F.lit(0)) < 1)
    low = F.when(none & (F.length("question") < 50), F.array("question")).otherwise(F.col("low"))
    empty = F.array().cast("array<string>")
    return rows.select("query_id", F.coalesce("high", empty).alias("high"), F.coalesce(low, empty).alias("low")), new


def _named(key: str) -> Column:
    """A list of a JSON object in an answer, with whatever stands around the object."""
    body = F.regexp_extract(F.regexp_replace(without_thoughts("return_value"), r"```[a-z]*", ""), r"(?s)(\{.*\})", 1)
    return F.filter(F.coalesce(F.from_json(body, f"`{key}` array<string>")[key], F.array().cast("array<string>")), lambda x: F.trim(x) != "")


def decomposed(questions: DataFrame, cache: DataFrame, model: Model) -> tuple[DataFrame, DataFrame]:
    """question_id, sub and question of sub-questions of (query_id, question); a question without any is its own."""
    prompts = questions.select(F.col("query_id").cast("string").alias("id"), F.concat(F.lit(DECOMPOSE), "question").alias("prompt"))
    answers, new = cached_calls(prompts, cache, model, "default", "decompose")
    parts = answers.select(F.col("id").cast("bigint").alias("query_id"), string_list("return_value", "questions").alias("parts"))
    rows = questions.join(parts, "query_id", "left")
    own = F.when(F.coalesce(F.size("parts"), F.lit(0)) < 1, F.array("question")).otherwise(F.col("parts"))
    return rows.select(F.col("query_id").alias("question_id"), F.posexplode(own).alias("sub", "question")), new


def hypothetical(questions: DataFrame, cache: DataFrame, model: Model, embed: Callable[[list[str]], np.ndarray], dim: int) -> tuple[DataFrame, DataFrame]:
    """query_id and query: vectors of passages that a model makes up for the questions."""
    prompts = questions.select(F.col("query_id").cast("string").alias("id"), F.concat(F.lit(HYPOTHESIS), "question").alias("prompt"))
    answers, new = cached_calls(prompts, cache, model, "default", "hyde")
    return embed_column(answers.select(F.col("id").cast("bigint").alias("query_id"), "return_value"), "return_value", embed, dim, "query").select("query_id", "query"), new


def extractions(chunks: DataFrame, cache: DataFrame, model: Model, glean: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities and relations (chunk_id, ...) of chunks (chunk_id, content), and new cache rows.

    With glean a second call sees the first answer; of an entity or relation that both have,
    the longer description stays.
    """
    prompts = chunks.select(F.col("chunk_id").alias("id"), F.concat(F.lit(EXTRACT), "content").alias("prompt"))
    first, new = cached_calls(prompts, cache, model, "default", "extract")
    passes = [first]
    if glean > 0:
        history = F.to_json(F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("return_value").alias("content"))))
        again = prompts.join(first.select("id", "return_value"), "id").select("id", F.lit(GLEAN).alias("prompt"), history.alias("history"))
        second, more = cached_calls(again, cache, model, "default", "extract")
        passes.append(second)
        new = new.unionByName(more)
    parsed = [cut(ex.records(p.select(F.col("id").alias("chunk_id"), "return_value"), "return_value", ["chunk_id"])) for p in passes]
    out = []
    for read, keys, rest in ((ex.entities, ["chunk_id", "name"], ["type", "description"]), (ex.relations, ["chunk_id", "src", "tgt"], ["keywords", "description", "weight"])):
        rows = None
        for turn, p in enumerate(parsed):
            part = read(p, ["chunk_id"]).withColumn("turn", F.lit(turn))
            rows = part if rows is None else rows.unionByName(part)
        best = F.max_by(F.struct(*rest), F.struct(F.length("description"), -F.col("turn"), -F.col("pos")))
        out.append(rows.groupBy(*keys).agg(best.alias("x")).select(*keys, "x.*"))
    return out[0], out[1], new


def answers(contexts: DataFrame, questions: DataFrame, cache: DataFrame, model: Model, mode: str, user_prompt: str = "", response_type: str = "Multiple Paragraphs") -> tuple[DataFrame, DataFrame]:
    """query_id and response of questions over their contexts (none: the question alone), and new cache rows."""
    extra = f"\n\n{user_prompt}" if user_prompt else ""
    given = questions.select("query_id", "question").join(contexts.select("query_id", "context"), "query_id", "left")
    ground = F.when(F.coalesce("context", F.lit("")) != "", F.concat(F.lit(ANSWER), "context", F.lit(f"\n\nForm: {response_type}\n\nQuestion: "))).otherwise(F.lit(""))
    prompts = given.select(F.col("query_id").cast("string").alias("id"), F.concat(ground, "question", F.lit(extra)).alias("prompt"), "question")
    got, new = cached_calls(prompts.select("id", "prompt"), cache, model, mode, "query")
    rows = got.join(prompts, "id")
    return rows.select(F.col("id").cast("bigint").alias("query_id"), without_echo(without_thoughts("return_value"), "prompt", "question").alias("response")), new


def with_image_texts(pages: DataFrame, cache: DataFrame, model: Model) -> tuple[DataFrame, DataFrame]:
    """Pages (id, page_number, content, images) with what a model sees in their images at the end of the text, and new cache rows."""
    each = pages.select("id", "page_number", F.posexplode("images").alias("pos", "image"))
    prompts = each.select(F.to_json(F.struct("id", "page_number", "pos")).alias("id"), F.concat(F.lit(IMAGE), "image").alias("prompt"))
    got, new = cached_calls(prompts, cache, model, "default", "image_summary")
    key = F.from_json("id", "id string, page_number int, pos int").alias("k")
    texts = got.select(key, "return_value").groupBy("k.id", "k.page_number").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k.pos", "return_value"))), lambda x: x.return_value), "\n").alias("seen")
    )
    rows = pages.join(texts, ["id", "page_number"], "left")
    return rows.withColumn("content", F.concat_ws("\n", "content", "seen")).drop("seen"), new
