"""A round that goes on while events arrive (ST3, ST4, A4).

Each batch of a stream is counted by itself and written as partial sums by round, party, counter and bin,
in a folder of the batch's number. A batch that runs again overwrites its own folder, so nothing counts twice,
whatever was killed when. A round is closed once the watermark has passed its end; its total is the sum
modulo 2^70 of all partial sums, worked out from the folders alone. What arrives for a closed round is counted
as late and left out. The watermark of a batch is that of the batches before it, as written in their folders,
so a batch that runs again judges its rows as it did the first time.

    RUN/partials/batch=7/    round, party, counter, bin_idx, count
    RUN/marks/batch=7/       latest (of the batch's times), late, events, watermark (that the batch was judged by)
    RUN/totals/round=3/      counter, bin_idx, count
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilcount.functions.scalars import signed
from veilcount.operators.binning import modular_sum
from veilcount.operators.rounds import round_of

PARTIALS = "round long, party string, counter string, bin_idx int, count decimal(38,0), batch long"
MARKS = "latest double, late long, events long, watermark double, batch long"
TOTALS = "counter string, bin_idx int, count decimal(38,0), round long"


class ContinuingRound:
    """Rounds of `period` seconds from `start`, of events with a party and a time in seconds.

    count: events (with their round) to round, party, counter, bin_idx, count, as any of the fan-outs can. lateness: how
    long after its end a round still takes events. rounds: how many there are; without, they go on.
    """

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        count: Callable[[DataFrame], DataFrame],
        period: float,
        start: float = 0.0,
        lateness: float = 0.0,
        rounds: int | None = None,
        time: str = "ts",
    ) -> None:
        self.spark, self.folder, self.count = spark, folder.rstrip("/"), count
        self.period, self.start, self.lateness, self.rounds, self.time = period, start, lateness, rounds, time
        # An empty batch before the first, so that every folder can be read.
        if not self._exists("marks/batch=-1"):
            self._write(spark.createDataFrame([], PARTIALS).drop("batch"), "partials/batch=-1")
            self._write(spark.createDataFrame([(None, 0, 0, None)], "latest double, late long, events long, watermark double"), "marks/batch=-1")

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _write(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")

    def partials(self) -> DataFrame:
        return self.spark.read.schema(PARTIALS).option("basePath", f"{self.folder}/partials").parquet(f"{self.folder}/partials")

    def marks(self) -> DataFrame:
        return self.spark.read.schema(MARKS).option("basePath", f"{self.folder}/marks").parquet(f"{self.folder}/marks")

    def watermark(self, before: int | None = None) -> float | None:
        """The latest time of the batches (before one), less the lateness."""
        seen = self.marks() if before is None else self.marks().where(F.col("batch") < before)
        latest = seen.agg(F.max("latest")).first()[0]
        return None if latest is None else latest - self.lateness

    def add(self, batch: DataFrame, number: int) -> None:
        """One batch's partial sums; for foreachBatch, and safe to run again."""
        mark = self.watermark(number)
        round_no = round_of(F.col(self.time), self.start, self.period, self.rounds)
        closed = F.lit(False) if mark is None else self.start + (round_no + 1) * self.period <= mark
        rows = batch.withColumn("round", round_no).withColumn("_late", F.coalesce(closed, F.lit(False)))
        rows.persist()
        try:
            self._write(self.count(rows.where("round is not null and not _late").drop("_late")), f"partials/batch={number}")
            seen = rows.agg(F.max(self.time).cast("double").alias("latest"), F.count_if("_late").alias("late"), F.count("*").alias("events"))
            # Last: a batch without its mark has not been.
            self._write(seen.withColumn("watermark", F.lit(mark).cast("double")), f"marks/batch={number}")
        finally:
            rows.unpersist()

    def whole(self) -> DataFrame:
        """Partial sums of batches that have their marks."""
        return self.partials().join(self.marks().select("batch"), "batch", "left_semi")

    def closed(self) -> list[int]:
        """Numbers of rounds with events that the watermark has passed."""
        mark = self.watermark()
        if mark is None:
            return []
        done = self.whole().where(self.start + (F.col("round") + 1) * self.period <= mark)
        return sorted(r[0] for r in done.select("round").distinct().collect())  # a number a round

    def tallied(self, partials: DataFrame | None = None) -> DataFrame:
        """A4: round, counter, bin_idx and signed count over all batches and parties."""
        sums = (self.whole() if partials is None else partials).groupBy("round", "counter", "bin_idx").agg(modular_sum(F.col("count")).alias("count"))
        return sums.withColumn("count", signed(F.col("count")))

    def publish(self, flush_last: bool = False) -> list[int]:
        """Write totals of closed rounds that have none yet; with flush_last, of the open ones too (ST3). Returns the new ones."""
        due = self.closed() if not flush_last else sorted(r[0] for r in self.whole().select("round").distinct().collect())
        new = [r for r in due if not self._exists(f"totals/round={r}")]
        for r in new:
            self._write(self.tallied(self.whole().where(F.col("round") == r)).drop("round"), f"totals/round={r}")
        return new

    def totals(self) -> DataFrame:
        if not self._exists("totals/round=-1"):
            self._write(self.spark.createDataFrame([], TOTALS).drop("round"), "totals/round=-1")
        return self.spark.read.schema(TOTALS).option("basePath", f"{self.folder}/totals").parquet(f"{self.folder}/totals")

    def run(self, events: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """The stream of events into this round; closed rounds are published after each batch."""

        def each(batch: DataFrame, number: int) -> None:
            self.add(batch, number)
            self.publish()

        writer = events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()


def by_round(count: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """A fan-out that counts by party, made to count by round and party."""

    def run(events: DataFrame) -> DataFrame:
        # A round and a party travel as one name, which no fan-out looks into.
        both = F.concat_ws(":", F.col("round").cast("string"), F.coalesce("party", F.lit("")))
        found = count(events.withColumn("party", both).drop("round"))
        named = F.split("party", ":", 2)
        return found.select(F.get(named, F.lit(0)).cast("long").alias("round"), F.get(named, F.lit(1)).alias("party"), "counter", "bin_idx", "count")

    return run
