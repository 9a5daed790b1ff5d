"""Descriptions of an item as one: joined where they are few and short, else by a model, group by group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestack.functions.text import SEP, estimated_tokens
from lodestack.session import cut

MOST_TOKENS, MOST_PARTS, CONTEXT_TOKENS = 1200.0, 8, 12_000.0


def summary_plan(rows: DataFrame, most_tokens: float = MOST_TOKENS, most_parts: int = MOST_PARTS) -> DataFrame:
    """name, tokens, plan and summary: single, joined or model, with the text where no model is needed.

    rows are (name, description). Descriptions are only counted and summed; those of items
    that fewer than most_parts of them make are gathered, which bounds each list.
    """
    each = rows.filter("description <> ''").select("name", "description").distinct()
    sums = each.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum(estimated_tokens("description")).alias("tokens"))
    plan = F.when(F.col("n") == 1, "single").when((F.col("n") < most_parts) & (F.col("tokens") < most_tokens), "joined").otherwise("model")
    sums = sums.select("name", "tokens", plan.alias("plan"))
    few = each.join(sums.filter("plan <> 'model'").select("name"), "name", "left_semi").groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("description")), SEP).alias("summary"))
    return sums.join(few, "name", "left")


def greedy_groups(descriptions: Column, most_tokens: float = CONTEXT_TOKENS) -> Column:
    """A list of descriptions as lists of at least two that fit a number of tokens, in order; one alone only at the end.

    A single description over the limit takes the next one along.
    """
    empty = F.array().cast("array<string>")
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), empty.alias("now"), F.lit(0.0).alias("tokens"))

    def add(a: Column, d: Column) -> Column:
        n, over = estimated_tokens(d), (a.tokens + estimated_tokens(d) > most_tokens) & (F.size(a.now) > 0)
        alone = over & (F.size(a.now) == 1)
        one = F.array(d)
        done = F.when(alone, F.concat(a.done, F.array(F.concat(a.now, one)))).when(over, F.concat(a.done, F.array(a.now))).otherwise(a.done)
        now = F.when(alone, empty).when(over, one).otherwise(F.concat(a.now, one))
        return F.struct(done.alias("done"), now.alias("now"), F.when(alone, 0.0).when(over, n).otherwise(a.tokens + n).alias("tokens"))

    return F.aggregate(descriptions, start, add, lambda a: F.when(F.size(a.now) > 0, F.concat(a.done, F.array(a.now))).otherwise(a.done))


def summarised(
    rows: DataFrame, ask: Callable[[DataFrame], DataFrame], most_tokens: float = MOST_TOKENS, most_parts: int = MOST_PARTS, context: float = CONTEXT_TOKENS, most_listed: int = 300
) -> DataFrame:
    """name, summary and used_model of items (name, description, ord): joined, or reduced by a model until one text is left.

    ask takes (id, prompt) and gives (id, return_value). Of an item the last most_listed
    descriptions count, which bounds its list. Every round asks once for all items that are
    not done, and at least halves the lists of those that don't fit.
    """
    each = rows.filter("description <> ''").groupBy("name", "description").agg(F.min("ord").alias("ord"))
    last = F.row_number().over(W.partitionBy("name").orderBy(F.desc("ord"), F.desc("description")))
    each = each.withColumn("n", last).filter(F.col("n") <= most_listed)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", "description"))), lambda x: x.description)
    left = cut(each.groupBy("name").agg(listed.alias("d")).withColumn("used", F.lit(False)))
    done = None
    while True:
        tokens = F.aggregate("d", F.lit(0.0), lambda s, d: s + estimated_tokens(d))
        few = (F.size("d") == 1) | ((F.size("d") < most_parts) & (tokens < most_tokens))
        last_call = ~few & ((tokens <= context) | (F.size("d") <= 2))
        state = left.withColumn("few", few).withColumn("last", last_call)
        ready = state.filter("few").select("name", F.array_join("d", SEP).alias("summary"), F.col("used").alias("used_model"))
        done = ready if done is None else done.unionByName(ready)
        rest = cut(state.filter("NOT few"))
        if rest.isEmpty():
            return done
        groups = F.when(F.col("last"), F.array(F.col("d"))).otherwise(greedy_groups(F.col("d"), context))
        parts = rest.select("name", "last", F.posexplode(groups).alias("pos", "g"))
        asked = parts.filter("size(g) > 1").select(F.to_json(F.struct("name", "pos")).alias("id"), prompt_of("name", "g").alias("prompt"), "name", "pos", "last")
        answers = cut(ask(asked.select("id", "prompt")).join(asked.select("id", "name", "pos", "last"), "id"))
        done = done.unionByName(answers.filter("last").select("name", F.col("return_value").alias("summary"), F.lit(True).alias("used_model")))
        new = answers.filter("NOT last").select("name", "pos", F.col("return_value").alias("t")).unionByName(parts.filter("NOT last AND size(g) = 1").select("name", "pos", F.col("g")[0].alias("t")))
        left = cut(new.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x.t).alias("d")).withColumn("used", F.lit(True)))


def prompt_of(name: str, descriptions: str) -> Column:
    return F.concat(F.lit("Write one description of "), F.col(name), F.lit(" that keeps every fact of these:\n"), F.array_join(F.transform(descriptions, lambda d: F.concat(F.lit("- "), d)), "\n"))
