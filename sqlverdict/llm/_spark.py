"""What the operators share on the Spark side: settings, the shared folder, written stages, columns."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space, the separators of words in every operator of this package.
BLANKS = r"[\x20\x09-\x0D]+"
ROOT = Path(__file__).resolve().parents[2]


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers hold, and see that the workers find this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    known = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    context = spark.sparkContext
    if str(ROOT) in known or Path.cwd() == ROOT or getattr(context, "_llm_shipped", False):
        return
    package = Path(tempfile.mkdtemp()) / f"{ROOT.name}_llm.zip"
    with zipfile.ZipFile(package, "w") as z:
        for p in (ROOT / "sqlverdict").rglob("*.py"):
            z.write(p, p.relative_to(ROOT))
    context.addPyFile(str(package))
    context._llm_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver see: spark.checkpoint.dir, or one set here where that is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = f"file:///tmp/checkpoints/{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *frames: DataFrame) -> None:
    """Remove the files under tables that written() made and nothing reads any more."""
    for path in {os.path.dirname(p) for df in frames for p in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def text_of(column: str = "text") -> Column:
    """A document's text; null is the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold_of(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.pmod(F.crc32(F.encode(F.col(column).cast("string"), "UTF-8")), F.lit(folds))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def unused(prefix: str, columns: tuple[str, ...]) -> str:
    """A column name that clashes with none of the given ones, whatever the case."""
    taken = {c.lower() for c in columns}
    name = prefix
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_sha(column: str = "text") -> Column:
    """SHA-256 of a document's text as it is."""
    return F.unhex(F.sha2(text_of(column).cast("binary"), 256))


def content_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row, of whatever types (maps have no hash of their own)."""
    from pyspark.sql.types import AtomicType

    plain = [F.col(f"`{f.name}`") if isinstance(f.dataType, AtomicType) else F.to_json(F.struct(F.col(f"`{f.name}`").alias("c"))) for f in df.schema if f.dataType.typeName() != "variant"]
    return F.xxhash64(*plain) if plain else F.lit(0).cast("long")


def restricted(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs whose id and text's SHA-256 kept has (id, sha), one of each such pair, with all columns."""
    own, own_sha, mine, order, nth = (unused(f"llm_{x}", tuple(docs.columns)) for x in ("id", "sha", "mine", "order", "nth"))
    pairs = kept.select(F.col("id").alias(own), F.col("sha").alias(own_sha))
    joined = docs.withColumn(mine, text_sha(text_col)).join(pairs, F.col(f"`{id_col}`").eqNullSafe(F.col(own)) & (F.col(mine) == F.col(own_sha)))
    # rows that repeat both id and text: the first by their content
    placed = joined.withColumn(order, content_hash(docs))
    first = Window.partitionBy(own, own_sha).orderBy(order)
    return placed.withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
