"""The newest change per entity, and the current state, kept over a stream of changes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.instants import instant_micros
from strandline.operators.feed import normal_changes
from strandline.operators.lsm import MergeTree
from strandline.session import files, scratch_path


def latest_state(changes: DataFrame) -> DataFrame:
    """As extract.latest_per_entity, over a stream: one row of state per entity, in any order of arrival, without a watermark."""
    rank = F.struct(instant_micros(F.col("change_timestamp")).alias("at"), "revid", "property_id", (-F.col("feed_pos")).alias("first"))
    kept = F.struct("property_id", "revid", "new_value", "change_timestamp", "feed_pos")
    return changes.groupBy("entity_id").agg(F.max_by(kept, rank).alias("row")).select("entity_id", "row.*")


def stream_latest(spark: SparkSession, folder: str, schema, files_per_batch: int = 4) -> DataFrame:
    """Runs latest_state over all files of a folder that are there now, in micro-batches, and gives the last state as a table.

    A batch writes the entities that it changed and no others, below the shared folder; the table is the last row written of each.
    """
    out, marks = scratch_path(spark, "latest"), scratch_path(spark, "marks")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    state = latest_state(stream)

    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    query = state.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", marks).foreachBatch(keep).start()
    query.awaitTermination()
    if not files(spark).names(out):
        return latest_state(spark.createDataFrame([], schema))
    written = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    kept = [c for c in state.columns if c != "entity_id"]
    return written.groupBy("entity_id").agg(F.max_by(F.struct(*kept), "batch").alias("row")).select("entity_id", "row.*")


def stream_state(spark: SparkSession, folder: str, schema, files_per_batch: int = 4, path: str | None = None, fanout: int = 4, buckets: int | None = None) -> MergeTree:
    """Appends every micro-batch of a stream of changes to a merge tree as a run; read() gives the state after the last one.

    With `path` the tree and the marks of the stream stay there, and a later call goes on where an earlier one ended or broke off: the
    tree's manifest knows the last batch that it has, so a batch played again after a failure adds nothing.
    """
    path = path or scratch_path(spark, "stream-lsm")
    tree = MergeTree(spark, f"{path}/tree", buckets, fanout)

    def append(batch: DataFrame, number: int) -> None:
        tree.append(normal_changes(batch), batch=number)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    query = stream.writeStream.queryName(f"state_{uuid.uuid4().hex}").trigger(availableNow=True).option("checkpointLocation", f"{path}/marks").foreachBatch(append).start()
    query.awaitTermination()
    return tree


def until_enough(changes: DataFrame, most: int, checkpoint: str) -> list[str]:
    """Entities of a stream in order of arrival until `most` different ones were met; then the query stops. Bounded by `most`."""
    met: dict[str, None] = {}
    holder: list = []

    def look(batch: DataFrame, _: int) -> None:
        if len(met) < most:
            fresh = batch.groupBy("entity_id").agg(F.min("feed_pos").alias("pos")).orderBy("pos").limit(most).collect()
            for row in fresh:
                if len(met) < most:
                    met.setdefault(row["entity_id"])
        if len(met) >= most and holder:
            holder[0].stop()

    holder.append(changes.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(look).start())
    holder[0].awaitTermination()
    return list(met)
