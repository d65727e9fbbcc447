"""Exact deduplication with a persistent digest index.

The index is a table of one row for each distinct text (digest, keep_id, group_size), bucketed and sorted by
digest. New documents are reduced to one row a digest (partial aggregation before the shuffle, so that a
group of copies of any size is a few rows), a sort-merge anti-join against the buckets finds those that the
index lacks, and they are appended. The index side is read in bucket order without a shuffle.

Defined cases: a null text is the empty text; empty texts are equal to each other; of rows with the same id and
text one stays (the first by a hash of all its columns); ids are of any type that sorts; a null id stays only in a group without any other id; an empty table adds nothing; other columns
are never looked at, whatever they are called.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sqlverdict.llm._spark import BLANKS, content_hash, load, new_path, text_of, unused, written


def digest(text: Column) -> Column:
    """SHA-256 of the text with each run of white space as one space."""
    return F.sha2(F.encode(F.regexp_replace(text, BLANKS, " "), "UTF-8"), 256)


class DigestIndex:
    """A persistent table of the digests seen so far, bucketed and sorted by digest."""

    def __init__(self, spark: SparkSession, table: str, buckets: int | None = None, id_type: str = "bigint", path: str | None = None) -> None:
        """An existing table keeps its buckets, ids and place; a new one has a bucket for each shuffle partition, 64 at least.

        A bucket is one task's share of the anti-join: choose buckets so that the digests that the table will have come
        to some 10 million each. path: a shared folder for the table, else it lies in the session's warehouse.
        """
        self.spark, self.table, self.path = spark, table, path
        if spark.catalog.tableExists(table):
            told = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect()}
            self.buckets, self.path = int(told["Num Buckets"]), None if path is None else told.get("Location", path)
            self.schema = spark.table(table).schema
        else:
            self.buckets = buckets or max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
            empty = spark.createDataFrame([], f"digest string, keep_id {id_type}, keep_row bigint, group_size bigint")
            self.schema = empty.schema
            self._write(empty, "errorifexists")

    def _write(self, rows: DataFrame, mode: str) -> None:
        writer = rows.write.mode(mode).format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
        (writer.option("path", self.path) if self.path else writer).saveAsTable(self.table)

    def read(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def missing(self, groups: DataFrame) -> DataFrame:
        """The groups whose digest is not in the index: a sort-merge anti-join in bucket order."""
        return groups.join(self.read().select("digest").hint("merge"), "digest", "left_anti")

    def add(self, groups: DataFrame) -> None:
        """Append the groups that the index lacks; each digest is in the index once."""
        # the job reads the table that it appends to, so what is new is written down first
        new = written(self.missing(groups).select("digest", "keep_id", "keep_row", "group_size"), "new-digests")
        self._write(new.repartition(self.buckets, "digest"), "append")

    def drop(self) -> None:
        """Remove the table and its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table} PURGE")
        if self.path:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def files(self) -> DataFrame:
        """The index without its bucketing, for joins whose hot keys are to be split at run time."""
        self.spark.catalog.refreshTable(self.table)
        places = self.spark.table(self.table).inputFiles()
        if not places:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*sorted({p.rsplit("/", 1)[0] for p in places}))


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, keep_id, group_size, kept, text_sha256, after its texts were added to the index.

    A document stays if no document of an earlier call had its text and it has the smallest id of this call's
    documents with that text. Without an index there are no earlier calls: one is made in the shared folder and removed.
    """
    spark = docs.sparkSession
    if index is None:
        kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
        own = DigestIndex(spark, f"digests_{uuid.uuid4().hex}", id_type=kind, path=new_path(spark, "index"))
        try:
            return written(deduplicate(docs, own, id_col, text_col), "deduplicated")
        finally:
            own.drop()
    rows = docs.select(F.col(id_col).alias("id"), digest(text_of(text_col)).alias("digest"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "digests")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    groups = rows.groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"))
    groups = written(groups.select("digest", F.col("first.id").cast(index.schema["keep_id"].dataType).alias("keep_id"), F.col("first.row").alias("keep_row"), "group_size"), "groups")
    fresh = written(index.missing(groups).select("digest", F.lit(True).alias("fresh")), "fresh")
    index.add(groups)
    state = index.files().select("digest", F.col("keep_id"), "keep_row").join(groups.select("digest", "group_size"), "digest").join(fresh, "digest", "left")
    return rows.join(state, "digest").select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        (F.coalesce("fresh", F.lit(False)) & (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that deduplicate() keeps, with all their columns."""
    own_id, own_digest, nth, mine, by = (unused(f"llm_{x}", tuple(docs.columns)) for x in ("id", "digest", "nth", "mine", "by"))
    kept = deduplicate(docs, None, id_col, text_col).where("kept").select(F.col(id_col).alias(own_id), F.col("text_sha256").alias(own_digest))
    joined = docs.withColumn(mine, digest(text_of(text_col))).join(kept, F.col(id_col).eqNullSafe(F.col(own_id)) & (F.col(mine) == F.col(own_digest)))
    # rows that repeat both id and text: the first by their content
    order = Window.partitionBy(own_id, own_digest).orderBy(by)
    return joined.withColumn(by, content_hash(docs)).withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(load(spark, sf_dir, "documents").select("doc_id", "text"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents),
g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.h AS text_sha256
FROM d JOIN g ON d.h = g.h
"""
