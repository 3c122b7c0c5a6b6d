"""Structured Streaming: incremental ingest and windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellon.operators import entities, index


def stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    """A stream of the Parquet files below path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _versions(spark: SparkSession, target: str, kind: str) -> list[int]:
    """Numbers of the tables of a kind below target whose writing ended, ascending."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(target)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    ended = [str(f.getPath().getParent().getName()) for f in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{target}/{kind}-*/_SUCCESS"))]
    return sorted(int(n.rsplit("-", 1)[1]) for n in ended)


def _drop(spark: SparkSession, target: str, kind: str, numbers: list[int]) -> None:
    jvm = spark.sparkContext._jvm
    for n in numbers:
        p = jvm.org.apache.hadoop.fs.Path(_at(target, kind, n))
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _at(target: str, kind: str, number: int) -> str:
    return f"{target}/{kind}-{number:012d}"


def read_index(spark: SparkSession, target: str, upto: int | None = None) -> DataFrame | None:
    """The index below target: its last whole base with the deltas that came after it, of each chunk the row of the last batch; None if nothing was written yet."""
    last = lambda kind: [n for n in _versions(spark, target, kind) if upto is None or n <= upto]
    base = last("base")[-1:]
    parts = [_at(target, "base", n) for n in base] + [_at(target, "delta", n) for n in last("delta") if not base or n > base[0]]
    if not parts:
        return None
    rows = None
    for p in parts:
        part = spark.read.parquet(p)
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    return index.newest(rows, "chunk_id", [F.desc("_batch")]).drop("_batch") if len(parts) > 1 else rows.drop("_batch")


def write_batch(batch: DataFrame, number: int, target: str, compact_every: int = 16) -> None:
    """Takes a batch of chunks into the index below target. Only what changes is written, as a delta; every compact_every batches base and deltas become a new base.

    A table counts once its writing has ended, so a crash at any point leaves
    the index as it was before, and a batch that comes again changes nothing.
    Chunks of another document under an arriving chunk's dataset_id and
    source_key stop being the latest.
    """
    spark = batch.sparkSession
    if any(number <= n for n in _versions(spark, target, "base")) or number in _versions(spark, target, "delta"):
        return
    order = [F.col(c).desc_nulls_last() for c in ("ingested_at", "created_at") if c in batch.columns] + [F.col("content").asc_nulls_last()]
    fresh = index.newest(batch, "chunk_id", order)
    now = read_index(spark, target, number - 1)
    if now is not None and {"dataset_id", "source_key", "doc_id", "is_latest"} <= set(batch.columns):
        keys = fresh.where("source_key is not null and is_latest").groupBy("dataset_id", "source_key").agg(F.max("doc_id").alias("_doc"))
        older = now.where("is_latest").join(keys, ["dataset_id", "source_key"]).where("doc_id <> _doc").drop("_doc").withColumn("is_latest", F.lit(False))
        fresh = older.join(fresh.select("chunk_id"), "chunk_id", "left_anti").unionByName(fresh, allowMissingColumns=True)
    fresh.withColumn("_batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(_at(target, "delta", number))
    if (number + 1) % compact_every == 0:
        read_index(spark, target, number).withColumn("_batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(_at(target, "base", number))
        # what the base before this one had replaced can't be read any more
        bases = _versions(spark, target, "base")
        _drop(spark, target, "delta", [n for n in _versions(spark, target, "delta") if len(bases) > 1 and n <= bases[-2]])
        _drop(spark, target, "base", bases[:-2])


def ingest_chunks(arrivals: DataFrame, target: str, checkpoint: str, compact_every: int = 16):
    """A query that upserts a stream of chunks into the Parquet index at target by write_batch; arrival order decides. A target belongs to one checkpoint."""
    return arrivals.writeStream.foreachBatch(lambda batch, number: write_batch(batch, number, target, compact_every)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_entities(old: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Entities so far with a batch of new ones: frequencies added, sources united."""
    columns = ["entity_name", "entity_type", "frequency", "source_docs", "source_chunks"]
    return entities.merge(batch.select(*columns) if old is None else old.select(*columns).unionByName(batch.select(*columns)))


def read_state(spark: SparkSession, target: str) -> DataFrame | None:
    """What fold_batch wrote last."""
    done = _versions(spark, target, "state")
    return spark.read.parquet(_at(target, "state", done[-1])) if done else None


def fold_batch(batch: DataFrame, number: int, target: str, fold: Callable[[DataFrame | None, DataFrame], DataFrame]) -> None:
    """Writes fold(state so far, batch) as the next state; a batch that comes again changes nothing, the last two states stay."""
    spark = batch.sparkSession
    done = _versions(spark, target, "state")
    if done and number <= done[-1]:
        return
    fold(read_state(spark, target), batch).write.mode("overwrite").parquet(_at(target, "state", number))
    _drop(spark, target, "state", done[:-1])


def merge_entities(arrivals: DataFrame, target: str, checkpoint: str):
    """A query that merges a stream of entities into the state at target."""
    return arrivals.writeStream.foreachBatch(lambda batch, number: fold_batch(batch, number, target, merged_entities)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_contents(arrivals: DataFrame, time: str, late: str = "1 day") -> DataFrame:
    """A stream without contents that came before within the watermark, by their hash."""
    return arrivals.withWatermark(time, late).withColumn("content_hash", F.sha2("content", 256)).dropDuplicatesWithinWatermark(["content_hash"])


def windowed(events: DataFrame, size: str = "10 minutes", slide: str | None = None, late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """(started, event_type, n, total): events in tumbling or sliding windows; an addition to the operators of the document engine."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("started"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", time: str = "ts") -> DataFrame:
    """(user_id, started, ended, n): sessions of users that end after a pause."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(time, gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")
