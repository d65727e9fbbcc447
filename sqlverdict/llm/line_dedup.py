"""Removal of boilerplate lines: lines that many distinct sites share.

Each line hash gets a HyperLogLog sketch of its sites; partial sketches are merged by the aggregation, so that a
line in a third of all documents is a few rows in the shuffle. An estimate well away from the threshold decides;
a line whose estimate is within five standard errors of it gets an exact count of its sites. Lines on at least
min_sites sites are removed from every document; the other lines stay, in order.

Defined cases: a null text or site is the empty one; blank lines are never boilerplate and stay; documents
without boilerplate keep their text byte by byte; rows with the same id each keep their own text; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlverdict.llm._spark import load, text_of, unused

MIN_SITES = 10
LG_K = 12
#: White space around lines. Trimmed without a regular expression, which takes several times as long, is quadratic in
#: a run of blanks within a line, and whose $ also matches before a last U+0085, U+2028 or U+2029.
_BLANKS = " \t\n\x0b\f\r"


def _full(line: Column) -> Column:
    """Whether a line isn't blank; looks no further than its first other character."""
    return F.ltrim(line, F.lit(_BLANKS)) != ""


def _hash(line: Column) -> Column:
    """A line's 64-bit hash, without the white space around it."""
    return F.xxhash64(F.btrim(line, F.lit(_BLANKS)))


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """One row for each line that isn't blank: id, site, hash."""
    site = F.coalesce(F.col(site_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), site.alias("site"), F.explode(F.split(text_of(text_col), "\n")).alias("line"))
    return rows.where(_full(F.col("line"))).select("id", "site", _hash(F.col("line")).alias("hash"))


def boilerplate(found: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """The hashes of lines on at least min_sites sites: hash, sites (estimated), exact (null where not needed)."""
    band = max(1.0, 5 * 1.04 / math.sqrt(2**lg_k) * min_sites)
    spread = found.groupBy("hash").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.count(F.lit(1)).alias("n"))
    # a line that occurs less often than min_sites times has fewer sites
    wide = spread.where(F.col("n") >= min_sites).select("hash", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites - band)
    near = wide.where(F.col("sites") <= min_sites + band).select("hash")
    exact = found.select("hash", "site").join(near, "hash").groupBy("hash", "site").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("one").alias("exact"))
    return wide.join(exact, "hash", "left").where(F.coalesce("exact", "sites") >= min_sites)


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", counts: bool = False) -> DataFrame:
    """docs without the boilerplate lines; counts adds n_lines (not blank) and n_removed."""
    found = lines(docs, id_col, text_col, site_col)
    own_id, hits = (unused(f"llm_{x}", tuple(docs.columns)) for x in ("id", "hits"))
    bad = boilerplate(found, min_sites).select("hash")
    by_doc = found.select("id", "hash").join(bad, "hash").groupBy(F.col("id").alias(own_id)).agg(F.collect_set("hash").alias(hits))
    joined = docs.join(by_doc, F.col(id_col).eqNullSafe(F.col(own_id)), "left")
    parts = F.split(text_of(text_col), "\n")
    stay = F.filter(parts, lambda x: ~(_full(x) & F.array_contains(hits, _hash(x))))
    text = F.when(F.col(hits).isNull(), text_of(text_col)).otherwise(F.array_join(stay, "\n"))
    extra = []
    if counts:
        extra = [F.size(F.filter(parts, _full)).cast("long").alias("n_lines"), F.when(F.col(hits).isNull(), 0).otherwise(F.size(parts) - F.size(stay)).cast("long").alias("n_removed")]
    return joined.select(*[(text if c == text_col else F.col(f"`{c}`")).alias(c) for c in docs.columns], *extra)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return remove_boilerplate(docs, counts=True).select("doc_id", "n_lines", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH l AS (
  SELECT doc_id, coalesce(source, '') AS site, i, line, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS core
  FROM (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)
), b AS (SELECT core FROM l WHERE core <> '' GROUP BY core HAVING count(DISTINCT site) >= 10)
SELECT l.doc_id, count(*) FILTER (WHERE l.core <> '')::BIGINT AS n_lines, count(b.core)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE b.core IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN b ON l.core = b.core GROUP BY l.doc_id
"""
