"""Current state of a table from a change feed, by a log-structured merge tree on bucketed, sorted runs.

A run holds the newest version of each of its keys, deletions as tombstones, in one sorted file per bucket. Runs are only ever
added. All runs of a tree share their buckets, so k runs are merged on read by merge joins that neither shuffle nor sort: of each run
those keys that no earlier run has, beside their versions in the later ones. When a level holds `fanout` runs, they are merged
into one run of the next level.

What runs there are stands in a manifest beside them, written anew with every change; a tree is opened again by its path.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.feed import normal_changes
from strandline.session import files, scratch_path

KEY = ("entity_id", "property_id")
#: Rows of a feed for which a bucket is worth its files, up to one bucket per shuffle partition.
BUCKET_ROWS = 50_000
#: Before every instant: the place of changes whose instant can't be read.
NEVER = -(1 << 62)
#: A version, in the order that decides which is newest.
VERSION = "struct<at: bigint, revid: bigint, undelivered: bigint, value: string, tombstone: boolean>"
RUN = f"entity_id string, property_id string, newest {VERSION}"


def _stored(key: str) -> Column:
    """A key that is never NULL, as merge joins need it."""
    return F.coalesce(F.concat(F.lit("="), F.col(key)), F.lit(""))


def _given(key: str) -> Column:
    return F.when(F.col(key) != "", F.substr(F.col(key), F.lit(2)))


class MergeTree:
    """A merge tree below `path`, made there if there is none.

    One writer at a time; readers see whole runs only, since a run counts once the manifest names it. A run that a lost
    executor leaves half written is written again by Spark's task retries. `buckets` and `fanout` are those of the manifest
    if there is one.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, fanout: int = 4) -> None:
        # One sorted file per bucket is read as sorted.
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
        self.spark, self.path, self.files = spark, path, files(spark)
        self.buckets, self.fanout = buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), fanout
        self.levels: dict[int, list[str]] = {}
        self.made, self.batch, self.saved = 0, -1, 0
        manifests = sorted(int(n.rpartition("-")[2]) for n in self.files.names(path) if n.startswith("manifest-"))
        if manifests:
            kept = json.loads(self.files.text(f"{path}/manifest-{manifests[-1]:09d}"))
            self.buckets, self.fanout, self.made, self.batch, self.saved = (kept[k] for k in ("buckets", "fanout", "made", "batch", "saved"))
            self.levels = {int(level): runs for level, runs in kept["levels"].items()}

    def _save(self) -> None:
        self.saved += 1
        kept = {"buckets": self.buckets, "fanout": self.fanout, "made": self.made, "batch": self.batch, "saved": self.saved, "levels": self.levels}
        self.files.write(f"{self.path}/manifest-{self.saved:09d}", json.dumps(kept))
        self.files.delete(f"{self.path}/manifest-{self.saved - 2:09d}")

    def _table(self, run: str) -> DataFrame:
        """A run, known to the session's catalog by its place and buckets."""
        name = f"run_{abs(hash((self.path, run))):x}"
        clustered = f"CLUSTERED BY ({', '.join(KEY)}) SORTED BY ({', '.join(KEY)}) INTO {self.buckets} BUCKETS"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({RUN}) USING parquet {clustered} LOCATION '{self.path}/{run}'")
        return self.spark.table(name)

    def _write(self, versions: DataFrame, stretches: int) -> list[str]:
        """Writes versions (stretch, *KEY, newest) as runs, one per stretch, in one job; one file per bucket, sorted by the write."""
        batch, self.made = f"runs-{self.made:06d}", self.made + 1
        name = f"new_{abs(hash((self.path, batch))):x}"
        (
            versions.write.partitionBy("stretch").bucketBy(self.buckets, *KEY).sortBy(*KEY)
            .option("path", f"{self.path}/{batch}").format("parquet").mode("overwrite").saveAsTable(name)
        )
        self.spark.sql(f"DROP TABLE {name}")  # of the catalog; the files stay
        there = set(self.files.names(f"{self.path}/{batch}"))
        return [f"{batch}/stretch={i}" for i in range(stretches) if f"stretch={i}" in there]

    def append(self, changes: DataFrame, stretch: Column | None = None, stretches: int = 1, batch: int | None = None) -> None:
        """Adds changes (as normal_changes gives them) as a run, or as one per stretch (0 to stretches - 1); then merges the levels that are full.

        `batch`: a number of a stream's; a batch that is not after the last one is there already.
        """
        if batch is not None and batch <= self.batch:
            return
        version = F.struct(
            F.coalesce("at", F.lit(NEVER)).alias("at"), "revid", (-F.col("feed_pos")).alias("undelivered"), F.col("new_value").alias("value"), (F.col("kind") == "deleted").alias("tombstone")
        ).cast(VERSION)
        rows = changes.select((F.lit(0) if stretch is None else stretch).cast("int").alias("stretch"), *[_stored(k).alias(k) for k in KEY], version.alias("v"))
        # A column per stretch, so that versions are combined before the one shuffle, which is by key and lays out the buckets.
        newest = rows.groupBy(*KEY).agg(*[F.max(F.when(F.col("stretch") == i, F.col("v"))).alias(f"v{i}") for i in range(stretches)])
        if self.buckets != int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            newest = newest.repartition(self.buckets, *KEY)
        each = F.array(*[F.struct(F.lit(i).alias("stretch"), F.col(f"v{i}").alias("newest")) for i in range(stretches)])
        runs = self._write(newest.select(*KEY, F.inline(each)).where(F.col("newest").isNotNull()).select("stretch", *KEY, "newest"), stretches)
        self.batch = self.batch if batch is None else batch
        self.levels.setdefault(0, []).extend(runs)
        self._save()
        level = 0
        while level <= max(self.levels):
            while len(self.levels.get(level, [])) >= self.fanout:
                self.compact(level)
            level += 1

    def compact(self, level: int) -> None:
        """Merges the first `fanout` runs of a level into a run of the next one. Tombstones stay: older runs may lie deeper."""
        runs = self.levels.get(level, [])[: self.fanout]
        if len(runs) < 2:
            return
        merged = self._merged(runs).repartition(self.buckets, *KEY).select(F.lit(0).alias("stretch"), *KEY, "newest")
        new = self._write(merged, 1)
        self.levels[level] = self.levels[level][len(runs) :]
        self.levels.setdefault(level + 1, []).extend(new)
        self._save()
        for run in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS run_{abs(hash((self.path, run))):x}")
            self.files.delete(f"{self.path}/{run}")

    def _merged(self, runs: list[str]) -> DataFrame:
        """(*KEY, newest): the newest version per key of sorted runs, by merge joins bucket by bucket."""
        parts = []
        for i, run in enumerate(runs):
            part, versions = self._table(run), ["newest"]
            for j, other in enumerate(runs):
                if j < i:
                    part = part.join(self._table(other).select(*KEY).hint("merge"), list(KEY), "left_anti")
                elif j > i:
                    part = part.join(self._table(other).withColumnRenamed("newest", f"newest_{j}").hint("merge"), list(KEY), "left")
                    versions.append(f"newest_{j}")
            parts.append(part.select(*KEY, (F.greatest(*versions) if len(versions) > 1 else F.col("newest")).alias("newest")))
        together = parts[0]
        for part in parts[1:]:
            together = together.unionAll(part)
        return together

    def read(self) -> DataFrame:
        """(entity_id, property_id, current_value) of the keys whose newest change is not a deletion."""
        runs = [run for level in sorted(self.levels, reverse=True) for run in self.levels[level]]
        if not runs:
            return self.spark.createDataFrame([], "entity_id string, property_id string, current_value string")
        there = self._merged(runs).where(~F.coalesce("newest.tombstone", F.lit(False)))
        return there.select(*[_given(k).alias(k) for k in KEY], F.col("newest.value").alias("current_value"))

    def drop(self) -> None:
        """Deletes the tree."""
        for run in (run for runs in self.levels.values() for run in runs):
            self.spark.sql(f"DROP TABLE IF EXISTS run_{abs(hash((self.path, run))):x}")
        self.levels = {}
        self.files.delete(self.path)


def current_state(changes: DataFrame, runs: int = 10, buckets: int | None = None) -> DataFrame:
    """(entity_id, property_id, current_value): the newest value of each key that its newest change doesn't delete.

    The feed is taken in `runs` stretches of arrival (feed_pos), as it would come over time, more than the tree's fanout, so
    that runs are merged into deeper ones, and read through the merge of what runs there are then. Newest is by instant, then revid; of
    copies of a change the first delivered counts. A change whose instant can't be read is older than all others; a NULL revid is older
    than others of its instant; a NULL change type is no deletion. NULL keys are keys. Empty input gives an empty result; further
    columns are ignored. The tree lies in the shared folder until that is cleared, as the result is read from it.
    """
    spark = changes.sparkSession
    feed = normal_changes(changes)
    first, last, rows = feed.agg(F.min("feed_pos"), F.max("feed_pos"), F.count(F.lit(1))).first()
    buckets = buckets or min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // BUCKET_ROWS + 1)
    tree = MergeTree(spark, scratch_path(spark, "lsm"), buckets)
    width = ((last or 0) - (first or 0)) // runs + 1
    tree.append(feed, F.coalesce(F.floor((F.col("feed_pos") - F.lit(first or 0)) / F.lit(width)), F.lit(0)), runs)
    return tree.read()
