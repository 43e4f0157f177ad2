"""Model calls that are kept: equal prompts are asked once, and what has been answered is not asked again."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedra.operators.joins import left_join_hot
from sedra.sources.shared import drop, exists, new_table

Model = Callable[[list[str]], list[str]]
CALLS = "digest string, reply string, error string"


@dataclass(frozen=True)
class CallTable:
    """Calls at a path that driver and executors share, keyed by the SHA-256 of the model's name and the prompt.

    Prompts without a stored reply are dealt into rounds of about `per_round` by their digest, and a round is stored before
    the next one starts: a lost task repeats its own calls of that round alone, and a job that failed goes on, when it is run
    again, where the last stored round ended. At most `in_flight` tasks call the model at once, each with up to `batch`
    prompts; a call that fails is repeated `tries` times in all, after `wait` seconds, then twice as many, and so on. What
    still fails is reported, and asked again the next time. Each round writes a
    folder of its own, so jobs can run side by side; they may then ask the same, and the least reply in order counts.
    """

    path: str
    model: str = "model"
    per_round: int = 100_000
    in_flight: int = 64
    batch: int = 32
    tries: int = 3
    wait: float = 1.0

    def __post_init__(self) -> None:
        if min(self.per_round, self.in_flight, self.batch, self.tries) < 1 or self.wait < 0:
            raise ValueError("per_round, in_flight, batch and tries are 1 at least, wait is not negative")

    def _stored(self, like: DataFrame) -> DataFrame:
        spark = like.sparkSession
        return spark.read.schema(CALLS).parquet(self.path).select("digest", "reply", "error") if exists(spark, self.path) else spark.createDataFrame([], CALLS)

    def replies(self, asked: DataFrame, load: Callable[[], Model]) -> DataFrame:
        """(query_id, reply, error) for every row of asked (query_id, prompt); a null prompt is not asked and has neither."""
        keyed = asked.select("query_id", "prompt", F.sha2(F.concat(F.lit(f"{self.model}\n"), "prompt"), 256).alias("digest"))
        self._ask(keyed, load)
        known = self._stored(asked).groupBy("digest").agg(F.min("reply").alias("reply"), F.max("error").alias("error"))
        known = known.select("digest", "reply", F.when(F.col("reply").isNull(), F.col("error")).alias("error"))
        return left_join_hot(keyed.select("query_id", "digest"), known, "digest", "query_id").select("query_id", "reply", "error")

    def _ask(self, keyed: DataFrame, load: Callable[[], Model]) -> None:
        spark, path = keyed.sparkSession, new_table(keyed.sparkSession)
        done = self._stored(keyed).where("reply is not null").select("digest").distinct()
        new = keyed.where("prompt is not null").select("digest", "prompt").dropDuplicates(["digest"]).join(done, "digest", "left_anti")
        new.write.parquet(f"{path}/new")
        new = spark.read.schema("digest string, prompt string").parquet(f"{path}/new")
        rounds = -(-new.count() // self.per_round)
        if rounds:
            new.withColumn("round", F.pmod(F.xxhash64("digest"), F.lit(rounds)).cast("int")).write.partitionBy("round").parquet(f"{path}/rounds")
            drop(spark, f"{path}/new")
            for k in range(rounds):
                own = f"{path}/rounds/round={k}"
                if exists(spark, own):
                    batches = spark.read.schema("digest string, prompt string").parquet(own).repartition(self.in_flight, "digest")
                    batches.mapInPandas(self._calls(load), CALLS).write.parquet(f"{self.path}/run={uuid.uuid4().hex}")
        drop(spark, path)

    def _calls(self, load: Callable[[], Model]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        batch, tries, wait = self.batch, self.tries, self.wait

        def call(model: Model, prompts: list[str]) -> tuple[list[str] | None, str | None]:
            for k in range(tries):
                if k:
                    time.sleep(wait * 2 ** (k - 1))
                try:
                    replies = list(model(prompts))
                    if len(replies) == len(prompts) and None not in replies:
                        return replies, None
                    error = f"{len(prompts)} prompts, {len(replies) - replies.count(None)} replies"
                except Exception as e:
                    error = str(e) or type(e).__name__
            return None, error

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = None
            for frame in frames:
                for low in range(0, len(frame), batch):
                    part = frame.iloc[low : low + batch]
                    model = model or load()
                    replies, error = call(model, part["prompt"].tolist())
                    yield pd.DataFrame({"digest": part["digest"].tolist(), "reply": replies, "error": error}, dtype=object)

        return run
