"""The block store: typed tables as Parquet, partitioned by time block, with retention.

A table is a directory; a block is a partition (block=<number>) that one write replaces whole, so
readers see complete blocks. What a block holds is never subtracted: counts come from the blocks
that are there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: The place of a line in what was fed, as log_lines() has it.
PLACE = "struct<time:timestamp,path:string,block:bigint,place:bigint>"

# The tables of an analysis.
TABLES = {
    "terms": "block long, term string, count long",
    "log_groups": "block long, group_id long, bucket long, count long, created long, updated long, display string, last_message string",
    "pattern_keys": f"block long, pattern_key string, ord {PLACE}, epoch long, matched boolean, group_id long",
    "pattern_tags": f"block long, pattern_key string, name string, value string, ord {PLACE}",
}


def block_of(bucket: Column, unit: int) -> Column:
    """The block number of a time bucket: one block for a unit of time."""
    return F.floor(bucket / unit).cast("long")


class Store:
    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str] = TABLES):
        self.spark, self.path, self.schemas = spark, path.rstrip("/"), schemas

    def _files(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def exists(self, table: str) -> bool:
        files, path = self._files()
        return files.exists(path(f"{self.path}/{table}"))

    def create(self, table: str, schema: str | None = None, if_not_exists: bool = True) -> None:
        if self.exists(table):
            if if_not_exists:
                return
            raise ValueError(f"table {table!r} exists")
        if schema:
            self.schemas = {**self.schemas, table: schema}
        self.spark.createDataFrame([], self.schemas[table]).write.parquet(f"{self.path}/{table}")

    def drop(self, table: str) -> None:
        files, path = self._files()
        files.delete(path(f"{self.path}/{table}"), True)

    def drop_all(self) -> None:
        files, path = self._files()
        files.delete(path(self.path), True)

    def tables(self) -> list[str]:
        files, path = self._files()
        return sorted(s.getPath().getName() for s in files.listStatus(path(self.path))) if files.exists(path(self.path)) else []

    def read(self, table: str, blocks: list[int] | None = None) -> DataFrame:
        """All rows, or those of some blocks (other partitions aren't read)."""
        try:
            rows = self.spark.read.schema(self.schemas[table]).parquet(f"{self.path}/{table}")
        except AnalysisException:
            rows = self.spark.createDataFrame([], self.schemas[table])
        return rows if blocks is None else rows.where(F.col("block").isin(blocks))

    def append(self, table: str, rows: DataFrame) -> None:
        """Add rows; columns that they lack are null, unknown ones raise."""
        self._checked(table, rows).write.mode("append").partitionBy("block").parquet(f"{self.path}/{table}")

    def overwrite_blocks(self, table: str, rows: DataFrame) -> None:
        """Put rows in place of the blocks that they belong to; other blocks stay."""
        self._checked(table, rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("block").parquet(f"{self.path}/{table}")

    def _checked(self, table: str, rows: DataFrame) -> DataFrame:
        schema = self.spark.createDataFrame([], self.schemas[table]).schema
        unknown = set(rows.columns) - set(schema.names)
        if unknown or "block" not in rows.columns:
            raise ValueError(f"table {table!r}: unknown columns {sorted(unknown)}" if unknown else "rows need a block")
        return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])

    def blocks(self, table: str) -> list[int]:
        """The numbers of the blocks that are there, from the partitions' names."""
        files, path = self._files()
        root = path(f"{self.path}/{table}")
        names = [s.getPath().getName() for s in files.listStatus(root)] if files.exists(root) else []
        return sorted(int(n.removeprefix("block=")) for n in names if n.startswith("block="))

    def status(self, table: str) -> DataFrame:
        """(block, rows, completed) of the blocks that are there: all but the last are complete."""
        rows = self.read(table).groupBy("block").agg(F.count("*").alias("rows"))
        last = self.blocks(table)[-1:] or [0]
        return rows.select("block", "rows", (F.col("block") < last[0]).alias("completed"))

    def read_completed(self, table: str) -> DataFrame:
        """The rows of complete blocks; the last partition is not read."""
        return self.read(table, self.blocks(table)[:-1])

    def retain(self, table: str, keep: int) -> list[int]:
        """Drop blocks that are `keep` or more before the last; 0 keeps all. Returns those dropped."""
        there = self.blocks(table)
        gone = [b for b in there if keep and b <= there[-1] - keep] if there else []
        files, path = self._files()
        for b in gone:
            files.delete(path(f"{self.path}/{table}/block={b}"), True)
        return gone


def ring(blocks: DataFrame, most: int) -> DataFrame:
    """(last_index, block_no, block_id) of numbered blocks in a ring of `most`: later ones take the places of the first."""
    place = F.col("last_index") % most
    return blocks.withColumns({"block_no": place, "block_id": F.format_string("BLK%010d", place)})


def surviving(blocks: DataFrame, most: int) -> DataFrame:
    """The blocks that a ring of `most` still holds: the last ones."""
    last = blocks.agg(F.max("last_index").alias("_last"))
    return blocks.crossJoin(F.broadcast(last)).where(F.col("last_index") > F.col("_last") - most).drop("_last")  # one row


def kept(blocks: DataFrame, keep: int, unit: int) -> DataFrame:
    """Blocks whose last_epoch is within `keep` units of the latest; 0 keeps all."""
    if not keep:
        return blocks
    last = blocks.agg(F.max("last_epoch").alias("_last"))
    return blocks.crossJoin(F.broadcast(last)).where(F.col("last_epoch") >= F.col("_last") - keep * unit + 1).drop("_last")  # one row


def completed(rows: DataFrame, status: DataFrame) -> DataFrame:
    """Rows of the blocks that the status table (block, completed) says are complete."""
    return rows.join(F.broadcast(status.where("completed").select("block")), "block", "left_semi")
