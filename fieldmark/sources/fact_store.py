"""Facts in tables bucketed and sorted by cell: lookups prune files and row groups, joins by cell move no
facts, and the last write of a key is found inside its bucket.

A store is a folder of generations. Appends add files to the newest one; compaction writes the next, with
one sorted file per bucket and without superseded bodies, and only then becomes what readers open, so a
job that dies on the way leaves the store as it was.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.operators.lookup import latest_facts

#: Cells of a lookup that are pushed down as values; more meet the store in a join.
PUSHED_CELLS = 1_000


@dataclass(frozen=True)
class FactStore:
    """One generation: a bucketed table of ``schema`` at ``path``/g<generation>."""

    spark: SparkSession
    path: str
    buckets: int
    generation: int
    table: str

    @staticmethod
    def create(facts: DataFrame, path: str, buckets: int = 64) -> FactStore:
        """A new store with the rows of ``facts`` at an empty path."""
        store = FactStore(facts.sparkSession, path, buckets, 0, _name())
        store._write(facts, "error")
        return store

    @staticmethod
    def open(spark: SparkSession, path: str, schema: str, buckets: int) -> FactStore:
        """The newest complete generation of the store at ``path``."""
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = [p.getPath() for p in fs.listStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))]
        done = [int(p.getName()[1:]) for p in found if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        store = FactStore(spark, path, buckets, max(done), _name())
        spark.sql(f"CREATE TABLE {store.table} ({schema}) USING parquet CLUSTERED BY (cell) SORTED BY (cell, band, tslot) INTO {buckets} BUCKETS LOCATION '{store.place}'")
        return store

    def __post_init__(self) -> None:
        # joins by (cell, band, ...) may then use the bucketing by cell as it is
        self.spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")

    @property
    def place(self) -> str:
        return f"{self.path}/g{self.generation}"

    def _write(self, facts: DataFrame, mode: str) -> None:
        # one file per bucket and write: rows are dealt by the hash that the buckets are made of
        dealt = facts.repartition(self.buckets, "cell")
        dealt.write.mode(mode).format("parquet").bucketBy(self.buckets, "cell").sortBy("cell", "band", "tslot").option("path", self.place).saveAsTable(self.table)

    def append(self, facts: DataFrame) -> None:
        """Add bodies; the last write of a key counts on reading."""
        self._write(facts.select(*self.spark.table(self.table).columns), "append")

    def compacted(self) -> FactStore:
        """The next generation: the last write of every key and all derivatives, one sorted file a bucket."""
        rows = self.bodies()
        kept = latest_facts(rows)
        if "kind" in rows.columns:
            kept = kept.unionByName(rows.where("kind = 'derivative'"))
        after = FactStore(self.spark, self.path, self.buckets, self.generation + 1, _name())
        after._write(kept, "error")
        return after

    def bodies(self) -> DataFrame:
        """All stored rows."""
        return self.spark.table(self.table)

    def latest(self) -> DataFrame:
        """The last write of every key, found without moving facts."""
        return latest_facts(self.bodies())

    def lookup(self, cells: DataFrame, bands: list[str] | None = None, tslots: tuple[int, int] | None = None) -> DataFrame:
        """Bodies of the given cells, bands and slots. A few cells are pushed to the scan, which then opens
        their buckets only and skips row groups by their range of cells; many are joined bucket by bucket."""
        rows = self.bodies()
        if bands is not None:
            rows = rows.where(F.col("band").isin(bands))
        if tslots is not None:
            rows = rows.where(F.col("tslot").between(*tslots))
        named = cells.select("cell").where("cell is not null").distinct()
        few = named.limit(PUSHED_CELLS + 1).collect()
        if len(few) <= PUSHED_CELLS:
            return rows.where(F.col("cell").isin([r["cell"] for r in few]))
        return rows.join(named, "cell", "left_semi")


def _name() -> str:
    return f"facts_{uuid.uuid4().hex}"
