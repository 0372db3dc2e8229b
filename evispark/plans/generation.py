"""Text generation and embedding behind providers; the validate-and-repair loop.

Nothing here is needed by the deterministic operators. A provider is a plain callable, so tests and other
services plug in.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from .schema import Gate, with_problems

#: Fixed: seconds between calls of a run from the command line.
PAUSE = 65.0
#: Fixed: tries on a rate limit, the wait before try r (seconds), attempts at a valid output, texts per embedding call.
TRIES, ATTEMPTS, BATCH = 5, 3, 100


class RateLimited(Exception):
    pass


def wait(r: int) -> int:
    return min(2**r * 30, 120)


def _one_line(answer: str) -> str:
    """An answer that is JSON without its layout; others as they are."""
    try:
        return json.dumps(json.loads(answer), ensure_ascii=False)
    except ValueError:
        return answer


def ask(provider: Callable[[str], str], prompt: str, tries: int = TRIES, sleep: Callable[[float], None] = time.sleep) -> str:
    """The provider's answer; rate limits are waited out, more and more, ``tries`` times in all."""
    for r in range(tries):
        try:
            return provider(prompt)
        except RateLimited:
            if r == tries - 1:
                raise
            sleep(wait(r))
    raise AssertionError


@dataclass(frozen=True)
class Asking:
    """How prompts are asked.

    ``pause``: seconds between calls, over all tasks together. ``store``: a folder of answers, by attempt and the hash of
    their prompt, that every executor can reach; what is there isn't asked again, so a run that was ended goes on where it was. Answers
    are written in waves of ``wave`` prompts: that many, at most, are lost with a run.
    """

    pause: float = 0.0
    store: str | None = None
    tasks: int = 4
    wave: int = 200


_ANSWERS = "prompt_hash string, json string"


def stored(spark: SparkSession, store: str) -> DataFrame:
    """(prompt_hash, json): the answers in a store, one for each prompt; none if the store isn't there yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(_ANSWERS).parquet(store).dropDuplicates(["prompt_hash"]) if there else spark.createDataFrame([], _ANSWERS)


def answered(prompts: DataFrame, provider: Callable[[str], str], asking: Asking, attempt: int = 0) -> DataFrame:
    """``prompts`` (…, prompt) with ``json``: every different prompt that the store doesn't have of this attempt is asked once, and stored."""
    # an attempt has a folder of its own: Spark takes two reads of one folder in a plan for the same, whatever was added
    spark, store = prompts.sparkSession, f"{asking.store}/attempt-{attempt}"
    hashed = prompts.withColumn("prompt_hash", F.sha2("prompt", 256))
    fresh = lambda: hashed.select("prompt_hash", "prompt").dropDuplicates(["prompt_hash"]).join(stored(spark, store).select("prompt_hash"), "prompt_hash", "left_anti")

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        calls = 0
        place = TaskContext.get().partitionId()
        for b in batches:
            for h, p in zip(b["prompt_hash"], b["prompt"], strict=True):
                if asking.pause:  # the tasks take turns
                    time.sleep(asking.pause * (tasks if calls else place))
                calls += 1
                yield pd.DataFrame({"prompt_hash": [h], "json": [_one_line(ask(provider, p))]})

    while n := fresh().count():
        waves, tasks = -(-n // asking.wave), min(n, asking.tasks)
        now = fresh().where(F.pmod(F.xxhash64("prompt_hash"), F.lit(waves)) == 0) if waves > 1 else fresh()
        if waves > 1 and not now.take(1):  # the hashes left are few and uneven
            now = fresh().orderBy("prompt_hash").limit(asking.wave)
        now.repartition(tasks, "prompt_hash").mapInPandas(asked, _ANSWERS).write.mode("append").parquet(store)
    return hashed.join(stored(spark, store), "prompt_hash").drop("prompt_hash")


def generate_all(prompts: DataFrame, provider: Callable[[str], str], key: str, gate: Gate | None = None, attempts: int = ATTEMPTS, asking: Asking | None = None) -> DataFrame:
    """(key, json): answers to a table of prompts, asked on the executors.

    With a ``gate`` the answers with problems are asked again, the problems named, until there are none or the attempts
    are used up: each attempt is a round over the prompts that are left. Then the last answer that is JSON stands, right
    or not. A prompt that has no such answer is an error.
    """
    spark = prompts.sparkSession
    asking = asking or Asking()
    asking = asking if asking.store else replace(asking, store=f"{shared_folder(spark)}/answers-{uuid.uuid4().hex}")
    rows = prompts.select(F.col(key).cast("string").alias("k"), F.col("prompt").alias("first"))
    left, rounds = rows.withColumn("prompt", F.col("first")), []
    for attempt in range(attempts if gate else 1):
        judged = with_problems(answered(left, provider, asking, attempt), gate or Gate())
        rounds.append(judged.select("k", F.lit(attempt).alias("attempt"), "json", F.try_parse_json("json").isNotNull().alias("parsed")))
        wrong = judged.where(F.size("problems") > 0)
        if not gate or not wrong.take(1):
            break
        lines = F.array_join(F.transform("problems", lambda p: F.concat(F.lit("- "), p)), "\n")
        again = F.concat("first", F.lit("\n\n## Problems of the previous answer\n"), lines, F.lit("\nReturn corrected JSON only.\n"))
        left = wrong.select("k", "first", again.alias("prompt"))
    every = reduce(DataFrame.unionByName, rounds)
    best = every.groupBy("k").agg(F.max_by("json", F.struct("parsed", "attempt")).alias("json"), F.max("parsed").alias("parsed"))
    if none := best.where(~F.col("parsed")).first():
        raise ValueError(f"not valid JSON: the answer to {none['k']}")
    return best.select(F.col("k").alias(key), "json")


def embed(snippets: DataFrame, provider: Callable[[list[str]], list[list[float]]], text: str = "text", batch: int = BATCH) -> DataFrame:
    """Adds ``embedding``: ``batch`` texts per call, on the executors, in the order they came."""

    @F.pandas_udf("array<double>")
    def vectors(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            out: list = []
            for i in range(0, len(s), batch):
                out += provider(s.iloc[i : i + batch].tolist())
            yield pd.Series(out)

    return snippets.withColumn("embedding", vectors(F.col(text)))
