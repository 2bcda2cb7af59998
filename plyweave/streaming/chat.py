"""Conversation state as a stream: position and context shift by conversation."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.kv import shifted


def context_shift_stream(turns: DataFrame, max_seq: int = 8192, max_tokens: int = 256, far: int = 1024) -> DataFrame:
    """conv_id, turn, pos_after, discarded for each new turn (conv_id, turn, n); turns of a batch are taken in order."""

    def step(key, frames, state: GroupState):
        pos = state.get[0] if state.exists else 0
        got = pd.concat(list(frames)).sort_values("turn")
        rows = []
        for t, n in zip(got.turn, got.n, strict=True):
            pos, drop = shifted(int(pos), int(n), max_seq, max_tokens, far)
            rows.append((key[0], int(t), pos, drop))
        state.update((pos,))
        yield pd.DataFrame(rows, columns=["conv_id", "turn", "pos_after", "discarded"])

    return turns.groupBy("conv_id").applyInPandasWithState(
        step, "conv_id long, turn long, pos_after long, discarded long", "pos long", "append", GroupStateTimeout.NoTimeout
    )


def folder(spark: SparkSession) -> str:
    """Where a stream's output and state go: spark.checkpoint.dir, or in plain local mode a folder of this run."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file://" + tempfile.mkdtemp(prefix="plyweave-stream-")


def drained(stream: DataFrame, name: str) -> DataFrame:
    """All that a finite stream gives, written by the executors and read again."""
    spark = stream.sparkSession
    at = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    to = stream.writeStream.outputMode("append").format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state")
    to.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")
