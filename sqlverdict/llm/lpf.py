"""Repeated passages, found with longest-previous-factor arrays over blocks of suffixes.

A passage is a string of LENGTH bytes that starts at two places at least. Suffixes of a whole corpus don't fit one
task, so the places that can match are brought together first, without loss:

1. Anchors. Of the GRAM-byte strings in each LENGTH-byte window the one with the smallest hash is an anchor. Equal
   windows have the same anchor at the same offset, so every match is between places around equal anchors; an
   anchor stands for at most SPAN windows, and there is about one anchor in 70 bytes.
2. Only anchors whose hash occurs twice go on. Those whose whole context (the bytes that their windows cover) is equal
   are copies throughout: an aggregation settles them, whatever their number.
3. Of the distinct contexts of an anchor the bytes are fetched, and in blocks of whole groups the suffixes are sorted (prefix
   doubling), adjacent common prefixes give the longest previous factor of each place by its previous and next smaller
   positions in suffix order, and a factor of LENGTH or more marks the place as a later copy, its source as an earlier one.
4. An anchor with more distinct contexts than a block takes is split by ranges of offsets: the windows of a range share
   the bytes between its ends, so its groups are told apart by them; ranges halve until the groups are small. A range of
   one window has one context a group, so this ends.

Bytes of later copies are removed, and with keep_first=False those of the first copy, too. Places are judged on the input.

Defined cases: a null text is empty; texts shorter than LENGTH lose nothing; matches never cross documents; a text that
repeats itself counts; rows with equal id and text are told from others by a 64-bit hash of both and treated alike (each
is a copy of the other, or, with keep_first, both count as one); an empty table gives no rows; only id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlverdict.llm import _bytes as B
from sqlverdict.llm._spark import dropped, load, prepare, written

LENGTH, GRAM = 200, 64
SPAN = LENGTH - GRAM + 1
#: Distinct contexts of one anchor that go into one block.
GROUP = 256
#: Bytes of contexts in a block.
BLOCK = 1 << 17


def anchors(data: np.ndarray, offsets: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of texts: (text, place in data, hash)."""
    begin, end = offsets[:-1], offsets[1:]
    found: list[np.ndarray] = []
    step = 1 << 21
    n = len(data) - LENGTH + 1
    legal = np.zeros(max(n, 0) + 1, np.int32)
    long = end - begin >= LENGTH
    np.add.at(legal, begin[long], 1)
    np.add.at(legal, end[long] - LENGTH + 1, -1)
    legal = np.cumsum(legal)[:-1] > 0
    for at in range(0, max(n, 0), step):
        m = min(step, n - at)
        if not legal[at : at + m].any():
            continue
        grams = np.arange(at, at + m + SPAN - 1)
        h = B.ranges(p, grams, grams + GRAM)
        # 40 bits of hash, then the place: the smallest, and of equal ones the first
        x = (h >> np.uint64(24) << np.uint64(24)) | (grams - at).astype(np.uint64)
        pad = -len(x) % SPAN
        x = np.append(x, np.full(pad, np.uint64(2**64 - 1))).reshape(-1, SPAN)
        ahead = np.minimum.accumulate(x, axis=1).reshape(-1)
        back = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        low = np.minimum(back[:m], ahead[SPAN - 1 : SPAN - 1 + m])
        found.append(np.unique((low[legal[at : at + m]] & np.uint64((1 << 24) - 1)).astype(np.int64)) + at)
    place = np.unique(np.concatenate([*found, np.zeros(0, np.int64)]))
    return np.searchsorted(offsets, place, "right") - 1, place, B.ranges(p, place, place + GRAM)


def _anchored(docs: DataFrame) -> DataFrame:
    """A row for each anchor: h, full (hash of its context), key (of the row), pos, before and after (bytes of context)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in B.chunks(batches):
            p = B.prefix(data)
            doc, q, h = anchors(data, offsets, p)
            before = np.minimum(SPAN - 1, q - offsets[doc])
            after = np.minimum(LENGTH, offsets[doc + 1] - q)
            full = B.mix(B.ranges(p, q - before, q + after) + (before * 256 + after).astype(np.uint64))
            columns = [h.view(np.int64), full.view(np.int64), B.row_keys(data, offsets, part.column(0), p)[doc], (q - offsets[doc]).astype(np.int32), before.astype(np.int16), after.astype(np.int16)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "full", "key", "pos", "before", "after"])

    return docs.mapInArrow(run, "h bigint, full bigint, key bigint, pos int, before smallint, after smallint")


def _bodies(docs: DataFrame) -> DataFrame:
    """key, id and compressed text of each row."""
    from pyspark.sql.types import BinaryType, LongType, StructField, StructType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for part, data, offsets in B.chunks(batches):
            raw = data.tobytes()
            bodies = [pack.compress(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(B.row_keys(data, offsets, part.column(0))), part.column(0), pa.array(bodies, pa.binary())], ["key", "id", "body"])

    return docs.mapInArrow(run, StructType([StructField("key", LongType()), StructField("id", docs.schema["id"].dataType), StructField("body", BinaryType())]))


def _contexts(rows: DataFrame) -> DataFrame:
    """The bytes around anchors: rows (key, body, at: list of h, m, pos, before, after), one row an anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for part in batches:
            out: list[tuple] = []
            for key, body, at in zip(*[part.column(k).to_pylist() for k in range(3)], strict=True):
                text = unpack.decompress(body)
                out += [(x["h"], x["m"], key, x["pos"], x["before"], text[x["pos"] - x["before"] : x["pos"] + x["after"]]) for x in at]
            for k in range(0, len(out), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + 4096], strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["grp", "m", "key", "pos", "before", "ctx"])

    return rows.select("key", "body", "at").mapInArrow(run, "grp bigint, m bigint, key bigint, pos int, before int, ctx binary")


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each key, from 1, and the order of the keys."""
    order = np.argsort(key)
    ordered = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.append(True, ordered[1:] != ordered[:-1])) if len(key) else rank
    return rank, order


def suffix_order(symbols: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """The order of suffixes by their first 224 symbols, and for 7 and its doubles the ranks of the substrings of that length.

    Symbols are 0 to 256. With wanted, a flag for each place, the order is of those wanted places alone that share
    their first 112 symbols with another; the two longest substrings are ranked only where that order needs them.
    """
    n = len(symbols)
    x = np.zeros(n + 256, np.int64)
    x[:n] = symbols
    key = x[:n].copy()
    for k in range(1, 7):
        key = key << 9 | x[k : n + k]
    ranks: dict[int, np.ndarray] = {}
    width, places = 7, np.arange(n)
    while True:
        rank = np.zeros(n + 256, np.int64)
        rank[places], order = _ranked(key)
        ranks[width] = rank
        if width == 224:
            return places[order], ranks
        if wanted is not None and width == 56:
            needed = wanted.copy()
            needed[112:] |= wanted[:-112]
            places = np.flatnonzero(needed)
        elif wanted is not None and width == 112:
            places = np.flatnonzero(wanted)
            places = places[np.bincount(rank[:n])[rank[places]] > 1]
        key = rank[places] * (n + 1) + rank[places + width]
        width *= 2


def common(symbols: np.ndarray, ranks: dict[int, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The lengths of the common prefixes of suffixes, as far as 223."""
    size = np.zeros(len(i), np.int64)
    for width in (112, 56, 28, 14, 7):
        size += width * (ranks[width][i + size] == ranks[width][j + size])
    same = np.ones(len(i), dtype=bool)
    for _ in range(6):
        same &= symbols[i + size] == symbols[j + size]
        size += same
    return size


def longest_previous(order: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous factors of positions given in suffix order: (length, source or -1), aligned with order.

    lcp[k] is the common prefix of order[k - 1] and order[k]. The nearest smaller positions before and after in suffix
    order are found with one stack; the common prefix with each is the least on the way.
    """
    n = len(order)
    size, source = np.zeros(n, np.int64), np.full(n, -1)
    at, common_ = order.tolist(), lcp.tolist()
    stack: list[tuple[int, int]] = []  # (index in suffix order, common prefix with the element below it)
    for k in range(n):
        shared = common_[k] if k else 0
        while stack and at[stack[-1][0]] > at[k]:  # at[k] is the next smaller position of the top
            top, below = stack.pop()
            if shared > size[top]:
                size[top], source[top] = shared, at[k]
            shared = min(shared, below)
        if stack and shared > size[k]:  # the top is the previous smaller position of k
            size[k], source[k] = shared, at[stack[-1][0]]
        stack.append((k, shared))
    return size, source


def block_matches(contexts: list[bytes], first: np.ndarray, last: np.ndarray, owner: np.ndarray | None = None, origin: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places first..last of each context that start a passage: (context, place, whether an equal one is before it).

    Contexts can overlap in their text: owner is the text of each, origin where in it the context starts. A place of a
    text counts once, in the first context that has it.
    """
    lengths = np.array([len(c) for c in contexts])
    base = np.concatenate([[0], np.cumsum(lengths + 1)])
    symbols = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8).astype(np.int64) + 1
    symbols[base[1:] - 1] = 0
    size = np.maximum(last - first + 1, 0)
    at = np.repeat(np.arange(len(contexts)), size)
    place = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size) + first[at]
    if owner is not None and origin is not None:
        once = np.unique(owner[at] << 32 | (origin[at] + place), return_index=True)[1]
        at, place = at[once], place[once]
    wanted = np.zeros(len(symbols), dtype=bool)
    wanted[base[at] + place] = True
    order, ranks = suffix_order(symbols, wanted)
    lcp = np.zeros(len(order), np.int64)
    if len(order) > 1:
        lcp[1:] = common(np.append(symbols, np.zeros(256, np.int64)), ranks, order[:-1], order[1:])
    # runs of equal passages in suffix order; elsewhere no factor is long enough
    deep = lcp >= LENGTH
    run = deep | np.append(deep[1:], False)
    order, lcp = order[run], np.where(deep, lcp, 0)[run]
    size, source = longest_previous(order, lcp)
    later = size >= LENGTH
    # a place that is a later copy of one may be the source of another
    place, index = np.unique(np.concatenate([order[later], source[later]]), return_index=True)
    is_later = index < later.sum()
    ctx = np.searchsorted(base, place, "right") - 1
    return ctx, place - base[ctx], is_later


def _matched(rows: DataFrame, keep_first: bool) -> DataFrame:
    """Spans of passages: rows (grp, m, key, pos, before, ctx, low, high), whole groups in a partition; key, start, end."""

    def spans(block: list[tuple]) -> Iterator[tuple]:
        block.sort(key=lambda r: (r[2], r[3]))  # text order: the first copy is the one with the smallest key and place
        before, high = np.array([r[4] for r in block]), np.array([r[7] for r in block])
        low = np.maximum(np.array([r[6] for r in block]), LENGTH + before - np.array([len(r[5]) for r in block]))
        high = np.minimum(high, before)
        owner = np.unique([r[2] for r in block], return_inverse=True)[1]
        ctx, place, later = block_matches([r[5] for r in block], before - high, before - low, owner, np.array([r[3] for r in block]) - before)
        if keep_first:
            ctx, place = ctx[later], place[later]
        if not len(ctx):
            return
        cut = np.flatnonzero((np.diff(ctx) != 0) | (np.diff(place) != 1)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(ctx)], strict=True):
            r = block[ctx[a]]
            if keep_first or r[1] == 1:
                at = r[3] - r[4]
                yield r[2], at + int(place[a]), at + int(place[b - 1]) + LENGTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        size, group = 0, None
        for part in batches:
            out: list[tuple] = []
            for r in zip(*[c.to_pylist() for c in part.columns], strict=True):
                if r[0] != group and size >= BLOCK:
                    out += spans(block)
                    block, size = [], 0
                group = r[0]
                block.append(r)
                size += len(r[5]) + 1
            yield _spans(out)
        if block:
            yield _spans(list(spans(block)))

    def _spans(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32()), strict=True)], ["key", "start", "end"])

    dealt = rows.select("grp", "m", "key", "pos", "before", "ctx", "low", "high").repartition("grp").sortWithinPartitions("grp")
    return dealt.mapInArrow(run, "key bigint, start int, end int")


def _halved(rows: DataFrame, keep_first: bool) -> tuple[DataFrame, DataFrame]:
    """Rows of large groups by the halves of their ranges: (spans settled on the way, one row for each distinct context)."""
    low, high, before = F.col("low"), F.col("high"), F.col("before")
    middle = F.floor((low + high) / 2).cast("int")
    halves = rows.withColumn("half", F.explode(F.array(F.struct(low.alias("a"), middle.alias("b")), F.struct((middle + 1).alias("a"), high.alias("b")))))
    a, b = F.col("half.a"), F.col("half.b")
    after = F.length("ctx") - before
    # offsets that the context allows within the range
    halves = halves.where((a <= b) & (F.greatest(a, LENGTH - after) <= F.least(b, before)))
    shared = F.expr("substring(ctx, before - half.a + 1, half.a + 200 - half.b)")
    left, right = F.least(b, before), F.least(LENGTH - a, after)
    whole = F.xxhash64(F.expr("substring(ctx, before - least(half.b, before) + 1, least(half.b, before) + least(200 - half.a, length(ctx) - before))"), left, right)
    parts = halves.select(F.xxhash64("grp", a, b, shared).alias("grp"), whole.alias("whole"), "m", "key", "pos", "before", "ctx", a.alias("low"), b.alias("high"))
    parts = written(parts, "halves")
    sums = parts.groupBy("grp", "whole").agg(F.sum("m").alias("sum"), F.min(F.struct("key", "pos")).alias("first"))
    joined = parts.join(sums, ["grp", "whole"])
    is_first = (F.col("key") == F.col("first.key")) & (F.col("pos") == F.col("first.pos"))
    copy = (F.col("sum") > 1) & (~is_first if keep_first else F.col("m") == 1)
    top, bottom = F.least(F.col("high"), before), F.greatest(F.col("low"), LENGTH - (F.length("ctx") - before))
    spans = joined.where(copy).select("key", (F.col("pos") - top).cast("int").alias("start"), (F.col("pos") - bottom + LENGTH).cast("int").alias("end"))
    return spans, joined.where(is_first).select("grp", F.col("sum").alias("m"), "key", "pos", "before", "ctx", "low", "high")


def _without_spans(rows: DataFrame, kind: str, texts: bool) -> DataFrame:
    """What is left of each text: rows (id, body, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for part in batches:
            n, gone, runs, shas, left = [], [], [], [], []
            for body, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                text = unpack.decompress(body)
                kept, removed, count = text, 0, 0
                if spans:
                    spans.sort(key=lambda s: s["start"])
                    pieces, at, top = [], 0, -1
                    for s in spans:
                        if s["start"] > top:
                            count += 1
                        if s["start"] > at:
                            pieces.append(text[at : s["start"]])
                        at = top = max(at, s["end"])
                    pieces.append(text[at:])
                    kept = b"".join(pieces)
                    removed = len(text) - len(kept)
                n.append(len(text))
                gone.append(removed)
                runs.append(count)
                shas.append(hashlib.sha256(kept).hexdigest())
                left.append(kept if texts else None)
            columns = [part.column(0), *[pa.array(x, pa.int64()) for x in (n, gone, runs)], pa.array(shas, pa.string())] + ([pa.array(left, pa.binary())] if texts else [])
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if texts else [])])

    return rows.select("id", "body", "spans").mapInArrow(run, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if texts else ""))


def remove_repeats(docs: DataFrame, keep_first: bool = True, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """One row a document: id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and with texts the bytes kept."""
    spark = docs.sparkSession
    prepare(spark)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = written(_anchored(own), "all-anchors")
    # counts are written before they are joined, so that the join of a hot anchor can be split
    twice = written(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "twice")
    shared = written(found.join(twice.hint("merge"), "h"), "anchors")
    dropped(spark, found, twice)
    cls = written(shared.groupBy("h", "full").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("key", "pos", "before", "after")).alias("first")), "contexts")
    copies = shared.join(cls.where("m > 1"), ["h", "full"])
    if keep_first:
        copies = copies.where("key <> first.key OR pos <> first.pos")
    spans = written(copies.select("key", (F.col("pos") - F.col("before")).cast("int").alias("start"), (F.col("pos") + F.col("after")).cast("int").alias("end")), "spans")
    dropped(spark, shared)
    groups = written(cls.groupBy(F.col("h").alias("grp")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "groups")
    firsts = cls.join(groups.select(F.col("grp").alias("h")).hint("merge"), "h").select("h", "m", "first.*").groupBy("key").agg(F.collect_list(F.struct("h", "m", "pos", "before", "after")).alias("at"))
    contexts = _contexts(firsts.join(_bodies(own), "key"))
    contexts = written(contexts.dropDuplicates(["grp", "key", "pos"]).withColumn("low", F.lit(0)).withColumn("high", F.lit(SPAN - 1)), "bytes")
    small = contexts.join(groups.where(F.col("n") <= GROUP), "grp").drop("n")
    large = contexts.join(groups.where(F.col("n") > GROUP), "grp").drop("n")
    while not (large := written(large, "large")).isEmpty():
        settled, rows = _halved(large, keep_first)
        spans = spans.union(written(settled, "spans"))
        rows = written(rows, "rows")
        groups = written(rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "groups")
        small = small.union(rows.join(groups.where(F.col("n") <= GROUP), "grp").select(*small.columns))
        large = rows.join(groups.where(F.col("n") > GROUP), "grp").select(*rows.columns)
    spans = spans.union(_matched(small, keep_first))
    by_row = spans.distinct().groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return _without_spans(_bodies(own).join(by_row, "key", "left"), docs.select(id_col).schema[0].dataType.simpleString(), texts).withColumnRenamed("id", id_col)


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(load(spark, sf_dir, "documents"), keep_first=False)
