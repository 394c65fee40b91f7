"""Tables of spans, chunks, turns and documents as Parquet, partitioned by a hash of the document id.

Changes are Spark's own dynamic partition overwrite: only partitions that lose or get rows are read and written again.
A reader that starts while one is committed may see some partitions before and some after it, and a table takes one
writer at a time; where that isn't enough, give the tables to a format with transactions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.spans import last_wins
from .embed import embedded
from .scratch import cut

ROWS = 1_000_000


class Store:
    """One folder with a table for each name, in partitions of=<how many buckets>/bucket=<number>: reads by document open one of them."""

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None, embed=None):
        """buckets: of tables made from now on; by default one for each ROWS they start with, 16 at least. embed: a function from texts to vectors, called in tasks for what is written to spans, source_chunks and chunks."""
        self.spark, self.root, self.buckets, self.embed = spark, root.rstrip("/"), buckets, embed

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _names(self, path: str) -> list[str]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _all(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self._path(table))

    def _placed(self, rows: DataFrame, of: int) -> DataFrame:
        return rows.withColumns({"of": F.lit(of), "bucket": F.pmod(F.xxhash64("document_id"), F.lit(of)).cast("int")})

    def _write(self, rows: DataFrame, table: str, mode: str) -> None:
        # the hint lets adaptive execution split the rows of a large bucket over several tasks and files
        rows.hint("rebalance", "bucket").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("of", "bucket").parquet(self._path(table))

    def _of(self, table: str) -> int:
        found = [n[3:] for n in self._names(self._path(table)) if n.startswith("of=")]
        if not found:
            raise FileNotFoundError(f"no table {table} in {self.root}")
        return int(found[0])

    def _replace(self, table: str, touched: set[int], rows: DataFrame) -> None:
        """rows (placed) are from now on all that the touched buckets hold."""
        rows = cut(rows)
        left = self._touched(rows)
        self._write(rows, table, "overwrite")
        for bucket in touched - left:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._path(table)}/of={self._of(table)}/bucket={bucket}")
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def _touched(self, rows: DataFrame) -> set[int]:
        return {r[0] for r in rows.select("bucket").distinct().collect()}  # bucket numbers

    def _with_vectors(self, table: str, rows: DataFrame) -> tuple[DataFrame, dict]:
        if self.embed is None or table not in ("spans", "source_chunks", "chunks"):
            return rows, {}
        seen = Observation("embedding")
        made = embedded(rows.drop("embedding"), self.embed).observe(seen, F.count("*").alias("rows"), F.count_if(F.col("embedding").isNull()).alias("failed"))
        return cut(made), seen.get

    # tables

    def create(self, table: str, rows: DataFrame) -> dict:
        """Writes a new table. With embed: how many rows there were and how many have no vector."""
        rows, told = self._with_vectors(table, rows)
        of = self.buckets or max(16, rows.count() // ROWS)
        if self.exists(table):
            raise FileExistsError(f"there is a table {table} in {self.root}")
        # an empty file keeps the columns when all rows are gone
        rows.limit(0).coalesce(1).write.parquet(f"{self._path(table)}/of={of}/bucket=-1")
        self._write(self._placed(rows, of), table, "append")
        return told

    def exists(self, table: str) -> bool:
        return any(n.startswith("of=") for n in self._names(self._path(table)))

    def read(self, table: str) -> DataFrame:
        return self._all(table).drop("of", "bucket")

    def by_document(self, table: str, document_id: str) -> DataFrame:
        """A document's rows in the order of ids. The condition on the bucket is one on partitions alone: the others aren't opened."""
        here = F.col("bucket") == F.pmod(F.xxhash64(F.lit(document_id)), F.col("of"))
        return self._all(table).where(here & (F.col("document_id") == document_id)).drop("of", "bucket").orderBy("id")

    def get(self, table: str, key: str) -> DataFrame:
        """The row of an id, if there is one: a scan of that column, narrowed by the files' statistics."""
        return self.read(table).where(F.col("id") == key)

    def upsert(self, table: str, rows: DataFrame, order: str | None = None) -> dict:
        """Rows replace those of the same id, wherever they are; of several new ones of an id the last by `order` counts (without it the one of the highest hash). With embed: as create()."""
        new, told = self._with_vectors(table, last_wins(rows, ["id"], order or rows.columns[0]))
        old = self._all(table)
        new = self._placed(new, self._of(table)).select(*old.columns)
        ids = new.select("id")
        touched = self._touched(new) | self._touched(old.join(ids, "id", "left_semi"))
        self._replace(table, touched, old.where(F.col("bucket").isin(*touched)).join(ids, "id", "left_anti").unionByName(new))
        return told

    def append(self, table: str, rows: DataFrame) -> dict:
        """New rows; an id that is there already, or comes twice, is an error."""
        twice = rows.groupBy("id").count().where("count > 1").select("id").union(rows.join(self._all(table).select("id"), "id", "left_semi").select("id"))
        found = twice.first()
        if found:
            raise ValueError(f"id {found[0]} is there already")
        rows, told = self._with_vectors(table, rows)
        self._write(self._placed(rows, self._of(table)).select(*self._all(table).columns), table, "append")
        return told

    def delete_documents(self, table: str, ids: DataFrame) -> None:
        """ids(document_id): all rows of these documents go, by one anti-join over the buckets they are in. A null isn't an id."""
        ids = ids.where("document_id IS NOT NULL").select("document_id").distinct()
        touched = self._touched(self._placed(ids, self._of(table)))
        rows = self._all(table).where(F.col("bucket").isin(*touched))
        self._replace(table, touched, rows.join(ids.withColumnRenamed("document_id", "_gone"), F.col("document_id") == F.col("_gone"), "left_anti"))

    def delete_document(self, table: str, document_id: str) -> None:
        self.delete_documents(table, self.spark.range(1).select(F.lit(document_id).alias("document_id")))

    def delete_source(self, document_id: str, tables: tuple[str, ...] = ("spans", "source_chunks")) -> None:
        """A document's spans and chunks go."""
        for table in tables:
            if self.exists(table):
                self.delete_document(table, document_id)

    def save_document(self, rows: DataFrame, cascade: bool = False) -> None:
        """Documents(id, ..) replace those of the same id. cascade: their chunks go, as a foreign key with cascading deletes has it; off unless asked for."""
        rows = rows.withColumn("document_id", F.col("id"))
        if not self.exists("documents"):
            self.create("documents", rows)
        else:
            self.upsert("documents", rows)
        if cascade and self.exists("chunks"):
            self.delete_documents("chunks", rows)

    def save_section(self, rows: DataFrame) -> bool:
        """Section checkpoints(id, document_id, ..); a failure to save is told, not raised."""
        try:
            self.upsert("sections", rows) if self.exists("sections") else self.create("sections", rows)
            return True
        except Exception:  # noqa: BLE001  (a checkpoint is never worth a run)
            return False


def search_documents(df: DataFrame, kind: str = "", holder: str = "", number: str = "", carrier: str = "", quote: str = "", json: str | None = None) -> DataFrame:
    """Filters joined by AND; an empty one doesn't count. Holder and carrier are matched anywhere, without regard to case; numbers have to be equal. json: the column of a JSON text that carrier, holder and numbers are read from."""
    of = lambda name, path: F.get_json_object(json, path) if json else F.col(name)
    if kind:
        df = df.where(F.col("kind") == kind)
    if holder:
        df = df.where(of("holder", "$.insuredName").ilike(f"%{holder}%"))
    if carrier:
        df = df.where(of("carrier", "$.carrier").ilike(f"%{carrier}%"))
    if number:
        df = df.where(of("number", "$.policyNumber") == number)
    if quote:
        df = df.where(of("quote", "$.quoteNumber") == quote)
    return df


def list_templates(df: DataFrame, status: str = "", title: str = "", kind: str = "") -> DataFrame:
    """Templates or applications by status, by words of the title, by type."""
    df = df.where(F.col("status") == status) if status else df
    df = df.where(F.col("title").ilike(f"%{title}%")) if title else df
    return df.where(F.col("type") == kind) if kind else df
