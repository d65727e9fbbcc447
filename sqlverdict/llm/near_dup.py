"""Near duplicates by ProbMinHash over weighted word shingles, with banding and exact verification.

A text is a set of shingles of five words, each weighted 1 + ln(occurrences). The similarity of two texts is the
probability Jaccard of the weights; for texts that repeat no shingle it is the Jaccard similarity of their sets.
Each shingle is a Poisson process with its weight as rate: its arrivals fall into random registers, and each register
keeps the shingle that arrives first. Arrivals come in order, so a shingle is dropped as soon as it is later than
the last register's first arrival: after the registers are filled most shingles are done with their first arrival.
Two texts agree in a register with a probability equal to their similarity.

1. Texts with the same words are one node, so that exact copies cost no pairs.
2. Bands of registers make buckets. All of a bucket are compared with one member, its pivot: no pairs within it.
3. A pair whose signatures differ in too many registers is passed over (at similarity 0.8: 5 in 10^9); the others are
   verified exactly from their texts, and the links merge components.
4. Buckets with members of different components that weren't compared yet are open. Their texts are brought together
   (a bucket of more than a task's share in blocks, each pair of blocks a group of its own), and every pair of different
   components is settled there: the weight that two texts share bounds their similarity, and pairs that the bound
   doesn't rule out are verified. A pair is looked at in the first bucket that it shares only, and not any more once
   other links have made its texts one component, so that a group gives at most as many links as it has members.

Every pair of a bucket is then compared or in one class: no link is lost to the pivots, and only pairs with a pivot are rows.

Defined cases: null and empty texts are one class; a text of one to four words is one shingle; rows with equal ids
are nodes of their own; the member with the smallest id stays (a null id only if there is no other); an empty table gives no rows;
texts of any length are used whole; only id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlverdict.llm import _bytes as B
from sqlverdict.llm._graph import components
from sqlverdict.llm._spark import dropped, load, prepare, restricted, written

WORDS = 5
THRESHOLD = 0.8
#: What rounding may take from a similarity: far above the error of its sums, far below the distance of two similarities of texts.
MARGIN = 1e-9
BANDS, ROWS = 36, 7
REGISTERS = BANDS * ROWS
#: Longs that hold a short signature.
SHORT = -(-REGISTERS // 16)
#: Compressed bytes of texts of an open bucket in a block.
BLOCK = 2 << 20
#: Compressed bytes of texts that are verified at a time (a pair of longer ones alone).
AT_ONCE = 1 << 20
#: Registers whose short forms (4 bits) two signatures may differ in, to be verified: 6 standard deviations above the mean at 0.8.
DIFFER = 85
NIBBLES = 0x1111111111111111
_STEP = 0xD1B54A32D192ED03


def _times(k: int) -> np.uint64:
    return np.uint64(_STEP * k & (1 << 64) - 1)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of texts, sorted by text: (text, hash, weight); and two 64-bit digests of each text's words."""
    starts, ends, counts = B.words(data, offsets)
    h = B.ranges(B.prefix(data), starts, ends)
    doc, n, total = B.spread(counts), len(h), len(counts)
    place = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
    digests = np.zeros((total, 2), np.uint64)
    for lane in range(2):
        np.add.at(digests[:, lane], doc, B.mix(h + np.uint64(_STEP) * (place.astype(np.uint64) * np.uint64(2) + np.uint64(lane + 1))))
    digests[:, 0] = B.mix(digests[:, 0] + counts.astype(np.uint64))
    # a shingle begins at each word with four after it, and at the first word of a short text
    left = np.repeat(counts, counts) - place
    rolled = np.zeros(n, np.uint64)
    for k in range(WORDS):
        m = n - k
        if m > 0:
            rolled[:m] += np.where(left[:m] > k, B.mix(h[k:] + _times(k + 7)), np.uint64(0))
    begins = (left >= WORDS) | ((place == 0) & (np.repeat(counts, counts) < WORDS))
    doc, h = doc[begins], B.mix(rolled[begins])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    times = np.diff(np.append(at, len(h)))
    return doc[at], h[at], 1 + np.log(times), digests


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, total: int, registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash: for each text and register the shingle that arrives first (0 for a text without any)."""
    best = np.full(total * registers, np.inf)
    who = np.zeros(total * registers, np.uint64)
    time, live, turn = np.zeros(len(h)), np.arange(len(h)), 0
    while len(live):
        turn += 1
        r = B.mix(h[live] + _times(turn))
        time[live] += -np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[live]
        at = doc[live] * registers + (B.mix(r) % np.uint64(registers)).astype(np.int64)
        t = time[live]
        np.minimum.at(best, at, t)
        won = best[at] == t
        who[at[won]] = h[live[won]]
        last = best.reshape(total, registers).max(axis=1)
        live = live[t < last[doc[live]]]
    return who.reshape(total, registers)


def similarity(h1: np.ndarray, w1: np.ndarray, h2: np.ndarray, w2: np.ndarray) -> float:
    """The probability Jaccard of two texts, from their sorted shingles and weights."""
    if not len(h1) or not len(h2):
        return float(len(h1) == len(h2))
    both, i, j = np.intersect1d(h1, h2, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = w1 / w1.sum(), w2 / w2.sum()
    # sum over j of max(x_j / x_i, y_j / y_i): the first where x_j / y_j >= x_i / y_i, the second elsewhere
    xi, yi = x[i], y[j]
    ratio = np.round(np.log(xi) - np.log(yi), 12)
    order = np.argsort(-ratio, kind="stable")
    ratio, xi, yi = ratio[order], xi[order], yi[order]
    only_x, rest = 1 - xi.sum(), np.cumsum(yi)
    upto = np.searchsorted(-ratio, -ratio, "right") - 1  # ties count as equal
    sx, sy = only_x + np.cumsum(xi)[upto], 1 - rest[upto]
    return float((1 / (sx / xi + np.maximum(sy, 0) / yi)).sum())


def _sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row a document: id, words' digests, bands, short signature, compressed text and the SHA-256 of the text."""
    from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

    kind = docs.select(id_col).schema[0].dataType
    seeds = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for part, data, offsets in B.chunks(batches):
            doc, h, weight, digests = shingles(data, offsets)
            total = part.num_rows
            who = signatures(doc, h, weight, total)
            none = np.bincount(doc, minlength=total) == 0
            banded = seeds[None, :].repeat(total, 0)
            for k in range(ROWS):
                banded = B.mix(banded + who[:, k::ROWS][:, :BANDS])
            flat = pa.array(banded[~none].reshape(-1).view(np.int64))
            at = np.concatenate([[0], np.cumsum(np.where(none, 0, BANDS))])
            short = np.zeros((total, SHORT * 16), np.uint64)
            short[:, :REGISTERS] = who >> np.uint64(60)
            short = np.bitwise_or.reduce(short.reshape(total, SHORT, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=2)
            raw = data.tobytes()
            texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            bodies, shas = [pack.compress(t) for t in texts], [hashlib.sha256(t).digest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *[pa.array(np.ascontiguousarray(digests[:, k]).view(np.int64)) for k in range(2)], pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat), pa.FixedSizeListArray.from_arrays(pa.array(short.reshape(-1).view(np.int64)), SHORT).cast(pa.list_(pa.int64())), pa.array(bodies, pa.binary()), pa.array(shas, pa.binary())],
                ["id", "d1", "d2", "bands", "sig", "body", "sha"],
            )

    schema = StructType([StructField("id", kind), StructField("d1", LongType()), StructField("d2", LongType()), StructField("bands", ArrayType(LongType())), StructField("sig", ArrayType(LongType())), StructField("body", BinaryType()), StructField("sha", BinaryType())])
    text = F.col(text_col).cast("string").alias("text")
    return docs.select(F.col(id_col).alias("id"), text).mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())


def differing(x: Column, y: Column) -> Column:
    """In how many registers two short signatures differ."""
    total = F.lit(0)
    for k in range(SHORT):
        d = F.get(x, F.lit(k)).bitwiseXOR(F.get(y, F.lit(k)))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseAND(F.lit(NIBBLES))
        total = total + F.bit_count(d)
    return total


def _sets(bodies: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The shingles and weights of compressed texts."""
    unpack = zstandard.ZstdDecompressor()
    texts = [unpack.decompress(b) for b in bodies]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    doc, h, w, _ = shingles(np.frombuffer(b"".join(texts), np.uint8), offsets)
    at = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [(h[i:j], w[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]


def _portions(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of AT_ONCE bytes at most, or of one row."""
    start, held = 0, 0
    for k, size in enumerate(sizes):
        if k > start and held + size > AT_ONCE:
            yield start, k
            start, held = k, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def _verified(pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b, ta, tb: compressed texts) of at least the threshold's similarity: a, b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            a, b, ta, tb = (part.column(k).to_pylist() for k in range(4))
            good = []
            for i, j in _portions([len(x) + len(y) for x, y in zip(ta, tb, strict=True)]):
                texts = dict(zip(a[i:j], ta[i:j], strict=True)) | dict(zip(b[i:j], tb[i:j], strict=True))  # a pivot is many pairs' text
                sets = dict(zip(texts, _sets(list(texts.values())), strict=True))
                good += [similarity(*sets[x], *sets[y]) >= threshold - MARGIN for x, y in zip(a[i:j], b[i:j], strict=True)]
            yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def _linked(near: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """The links among pairs a, b of rows that held (row, body) has."""
    text = lambda side: held.select(F.col("row").alias(side), F.col("body").alias(f"t{side}")).hint("merge")
    return written(_verified(near.join(text("a"), "a").join(text("b"), "b"), threshold), "links")


def settled(key: int, sides: np.ndarray, rows: np.ndarray, comps: np.ndarray, bands: np.ndarray, sets: list[tuple[np.ndarray, np.ndarray]], threshold: float) -> list[tuple[int, int]]:
    """Links between texts of different components of one bucket, as few as connect what they connect.

    sides: the block of each text; texts of one block alone are compared with each other, else with the other block's.
    bands: the buckets of each text; a pair is compared if key is the first that both have.
    """
    sizes = np.array([len(h) for h, _ in sets])
    at = np.concatenate([[0], np.cumsum(sizes)])
    token = np.unique(np.concatenate([h for h, _ in sets]), return_inverse=True)[1]
    weight = np.concatenate([w / w.sum() for _, w in sets])
    mark = np.zeros(len(token) + 1)
    comps, two, found = comps.copy(), sides.min() != sides.max(), []
    place = np.arange(len(rows))
    for i in place:
        other = (comps != comps[i]) & ((sides > sides[i]) if two else (place > i))
        js = np.flatnonzero(other)
        if not len(js):
            continue
        same = bands[js] == bands[i]
        js = js[bands[i][same.argmax(axis=1)] == key]
        if not len(js):
            continue
        mine = slice(at[i], at[i + 1])
        mark[token[mine]] = weight[mine]
        upto = np.cumsum(sizes[js])
        where = np.arange(upto[-1]) + np.repeat(at[js] - upto + sizes[js], sizes[js])
        hit = mark[token[where]]
        begin = upto - sizes[js]
        x, y = np.add.reduceat(hit, begin), np.add.reduceat(np.where(hit > 0, weight[where], 0), begin)
        mark[token[mine]] = 0
        # sum over j of max(x_j / x_i, y_j / y_i) is at least 1 / x_i + (1 - y) / y_i and 1 / y_i + (1 - x) / x_i, so at least
        # their mean; harmonic means are concave, so the similarity is at most that of one shared token of weights x and y
        with np.errstate(divide="ignore"):
            can = 1 / np.maximum(1 / x + 1 / y - 1, 1e-12) >= threshold - MARGIN
        for j in js[can & (x > 0)]:
            if comps[j] != comps[i] and similarity(*sets[i], *sets[j]) >= threshold - MARGIN:
                found.append((int(rows[i]), int(rows[j])))
                comps[comps == comps[j]] = comps[i]
    return found


def _settled(rest: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) of untested pairs between components: rows (key, row, comp) of open buckets, held with their texts."""
    held = written(held.select("row", "bands", "body").join(rest.hint("merge"), "row"), "open texts")
    sizes = written(held.groupBy("key").agg(F.ceil(F.sum(F.length("body")) / BLOCK).cast("int").alias("blocks")), "blocks")
    placed = held.join(sizes.hint("merge"), "key").withColumn("side", F.pmod(F.xxhash64("row", "key"), F.col("blocks")).cast("int"))
    # a block meets each block of its bucket once, and a lone one itself
    meets = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with")
    groups = placed.select("key", "row", "comp", "bands", "body", "side", meets).withColumns({"low": F.least("side", "with"), "high": F.greatest("side", "with")})
    schema = ["key", "low", "high", "side", "row", "comp", "bands", "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(block: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(block)
            rows, comps, sides = (t.column(c).to_numpy() for c in ("row", "comp", "side"))
            found = []
            if comps.min() != comps.max():
                bands = np.array(t.column("bands").to_pylist(), np.int64)
                found = settled(t.column("key")[0].as_py(), sides, rows, comps, bands, _sets(t.column("body").to_pylist()), threshold)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], ["a", "b"])

        block: list[pa.RecordBatch] = []
        last = None
        for part in batches:
            keys = [part.column(k).to_numpy() for k in range(3)]
            cut = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
            for i, j in zip([0, *cut.tolist()], [*cut.tolist(), part.num_rows], strict=True):
                group = tuple(int(k[i]) for k in keys) if i < j else last
                if block and group != last:
                    yield links(block)
                    block = []
                last = group
                if i < j:
                    block.append(part.slice(i, j - i))
        if block:
            yield links(block)

    dealt = groups.select(*schema).repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    found = written(dealt.mapInArrow(run, "a bigint, b bigint"), "links")
    dropped(rest.sparkSession, held, sizes)
    return found


def _merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Rows with their components (row, comp) after links (a, b) between rows; a row that no link has isn't listed."""
    own = lambda side: comps.select(F.col("row").alias(side), F.col("comp").alias(f"c{side}"))
    placed = links.join(own("a"), "a", "left").join(own("b"), "b", "left").select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
    moved = components(placed.select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b"))
    ends = placed.select(F.col("a").alias("row"), F.col("ca").alias("comp")).union(placed.select("b", "cb"))
    rows = comps.select("row", "comp").union(ends).distinct()
    found = written(rows.join(moved.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("row", F.coalesce("to", "comp").alias("comp")), "components")
    dropped(links.sparkSession, moved)
    return found


def _classed(docs: DataFrame, threshold: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The sketched rows, and for each node (d1, d2) class_id, class_size and the row that its class keeps."""
    spark = docs.sparkSession
    prepare(spark)
    all_rows = written(_sketched(docs, id_col, text_col), "sketches")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    nodes = all_rows.groupBy("d1", "d2").agg(first.alias("first"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"))
    nodes = written(nodes.select("d1", "d2", F.col("first.id").alias("id"), F.col("first.row").alias("row"), "n", "bands"), "nodes")
    every = nodes.select("row", F.explode("bands").alias("key"))
    # most keys are one row's alone. Sums by key are written before they are joined, so that a hot key's join can be split.
    # Hints keep joins from turning into broadcasts of what grows with the input
    shared = written(every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    members = written(every.join(shared.hint("merge"), "key").select("key", "row", "n"), "members")
    # who meets most others is most likely what they were copied from: the first pivot of its buckets
    weight = written(members.groupBy("row").agg(F.sum("n").alias("w")), "weights")
    # the one time that texts move: those of rows that share a bucket
    held = written(all_rows.select("row", "bands", "sig", "body").join(weight.select("row").hint("shuffle_hash"), "row", "left_semi"), "texts")
    tested = written(members.join(weight.hint("merge"), "row").groupBy("key").agg(F.max_by("row", F.struct("w", -F.col("row"))).alias("row")), "pivots")
    met = members.join(tested.select("key", F.col("row").alias("pivot")).hint("merge"), "key").where("row <> pivot")
    pairs = written(met.select(F.least("row", "pivot").alias("a"), F.greatest("row", "pivot").alias("b")).distinct(), "met")
    sig = lambda side: held.select(F.col("row").alias(side), F.col("sig").alias(f"s{side}")).hint("merge")
    signed = pairs.join(sig("a"), "a").join(sig("b"), "b")
    near = written(signed.where(differing(F.col("sa"), F.col("sb")) <= DIFFER).select("a", "b"), "pairs")
    links = _linked(near, held, threshold)
    dropped(spark, shared, weight, pairs, near)
    one = _merged(links.select(F.col("a").alias("row"), F.col("a").alias("comp")).where("false"), links)
    # who was a pivot has been compared with all of its bucket; the other pairs matter only between components
    rest = members.join(tested.hint("merge"), ["key", "row"], "left_anti").join(one.hint("merge"), "row", "left").select("key", "row", F.coalesce("comp", "row").alias("comp"))
    open_ = _open(rest)
    more = _settled(open_, held, threshold)
    comps = _merged(one, more)
    dropped(spark, links, more, one, open_)
    grouped = nodes.drop("bands").join(comps.hint("merge"), "row", "left").withColumn("comp", F.coalesce("comp", "row"))
    best = written(grouped.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best"), F.sum("n").alias("class_size")), "best")
    found = written(grouped.join(best.hint("merge"), "comp").select("d1", "d2", F.col("best.id").alias("class_id"), F.col("best.row").alias("kept_row"), "class_size"), "classes")
    dropped(spark, nodes, members, tested, held, comps, best)
    return all_rows, found


def _open(rows: DataFrame) -> DataFrame:
    """The rows (key, row, comp) of buckets that have rows of different components."""
    rows = written(rows, "rest")
    split = written(rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key"), "split")
    found = written(rows.join(split.hint("merge"), "key", "left_semi"), "open")
    dropped(rows.sparkSession, rows, split)
    return found


def classes(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, class_id (the smallest id of its class), class_size, kept."""
    all_rows, found = _classed(docs, threshold, id_col, text_col)
    return all_rows.select("id", "d1", "d2", "row").join(found.hint("merge"), ["d1", "d2"]).select(F.col("id").alias(id_col), "class_id", F.col("class_size").cast("long").alias("class_size"), (F.col("row") == F.col("kept_row")).alias("kept"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, with all its columns: the one that classes() keeps, told by its id and text."""
    all_rows, found = _classed(docs, threshold, id_col, text_col)
    kept = all_rows.select("id", "sha", "row").join(found.select(F.col("kept_row").alias("row")).hint("merge"), "row", "left_semi")
    return restricted(docs, kept, id_col, text_col)


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(load(spark, sf_dir, "documents"))
