"""Upload batches of exactly N sessions on a stream.

A micro-batch finishes any number of sessions; uploads have N of them. What doesn't fill
a batch waits in a queue, a written table of fewer than N rows beside the counters of
what went out: the next push takes it first, releases as many full batches as there
are and numbers them on. A push is written under the number of its micro-batch and
starts from the push before, so a retry releases the same rows under the same ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.keys import session_id_text
from ..operators.common import delete_path, materialize
from ..operators.ids import BATCH_SIZE, SESSION_COUNTER_START, with_sequence_number
from ..operators.sessionize import emission_order
from ..sources.sinks import read_or_none


class BatchQueue:
    def __init__(self, spark: SparkSession, path: str, batch_size: int = BATCH_SIZE, id_start: int = SESSION_COUNTER_START) -> None:
        if batch_size < 1:
            raise ValueError("a batch has a session or more")
        self.spark, self.path, self.size, self.id_start = spark, path.rstrip("/"), batch_size, id_start

    def _at(self, push: int, name: str) -> str:
        return f"{self.path}/push={push}/{name}"

    def _before(self, push: int) -> tuple[DataFrame | None, int, int]:
        """Waiting sessions, sessions released and next batch id, after the push before."""
        for k in range(push - 1, max(-1, push - 3), -1):  # pushes may leave out a number (a flush)
            counters = read_or_none(self.spark, self._at(k, "counters"))  # written last
            if counters is not None:
                row = counters.first()
                return self.spark.read.parquet(self._at(k, "waiting")), row.released, row.batches
        return None, 0, 0

    def push(self, sessions: DataFrame, push: int, last: bool = False) -> DataFrame:
        """``sessions`` of one micro-batch, with the columns of ``emission_order`` -> those of
        all waiting ones that fill batches, with ``batch_id`` and ``session_id``; ``last``
        releases the rest as a batch of its own. Pushes count on by one or two."""
        waiting, released, batches = self._before(push)
        new = sessions.withColumn("_turn", F.lit(push).cast("bigint"))
        every = new if waiting is None else waiting.unionByName(new)
        # the waiting ones came first, each push in its own order
        order = [F.col("_turn"), *emission_order()]
        numbered = with_sequence_number(every, order, out="_idx")
        n = every.count()
        full = n if last else n - n % self.size
        number = F.lit(batches) + F.floor(F.col("_idx") / F.lit(self.size))
        out = materialize(numbered.where(F.col("_idx") < full).select(
            *sessions.columns, number.cast("bigint").alias("batch_id"),
            session_id_text(F.lit(self.id_start + released) + F.col("_idx")).alias("session_id")), "released")
        numbered.where(F.col("_idx") >= full).drop("_idx").write.mode("overwrite").parquet(self._at(push, "waiting"))
        counters = self.spark.createDataFrame([(released + full, batches + -(-full // self.size))], "released long, batches long")
        counters.coalesce(1).write.mode("overwrite").parquet(self._at(push, "counters"))
        for k in (push - 3, push - 4):  # no retry reads them any more
            delete_path(self.spark, f"{self.path}/push={k}")
        return out
