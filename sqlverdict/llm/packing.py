"""Order-preserving packing of documents into training sequences by dynamic programming.

The documents of a partition are one stream of tokens in their order. Where the stream is cut into windows is
chosen by dynamic programming: a window that ends at place j and began at place i costs its padding and a
penalty for what the cut at j truncates (nothing at the end of a document, a little at the end of a sentence,
more inside one). With g(i) = f(i) + place(i),

    f(j) = size - place(j) + penalty(j) + min { g(i) : place(j) - place(i) <= size }

and a monotone queue gives the minimum over the moving range of i, so that the work is linear in the places. Inside
a sentence only every few tokens is a place. The stream is worked on in blocks; what follows a block's last whole
window is carried over, so memory is bounded by a block and the longest document. The rest of a partition is cut
into powers of two, which need no padding, where that is cheaper than padding it.

Defined cases: a null or empty text is one end token; a document longer than a sequence is cut; rows with equal
ids are documents of their own; an empty table gives no pieces; columns other than id and text are not used.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from sqlverdict.llm._spark import load, prepare
from sqlverdict.llm.bpe import encoder, tokenizer_file

SIZE = 2048
END = 1
#: Tokens of padding that a cut inside a sentence, and one at its end, is worth.
INSIDE, SENTENCE = 6.0, 1.0
#: Places inside a sentence: every so many tokens.
STRIDE = 16
#: Tokens worked on at a time.
BLOCK = 1 << 18


class Tokens:
    """Ids of whole texts, and which ids end a sentence. One in each Python worker."""

    def __init__(self, path: str) -> None:
        import tiktoken

        own = encoder(path)
        self.fast = tiktoken.Encoding("packing", pat_str=own.pattern.pattern, mergeable_ranks=own.vocab, special_tokens=own.special)
        self.slow = own
        self.ends = np.array([s.rstrip().endswith((b".", b"!", b"?")) or b"\n" in s for s in own.strings])

    def ids(self, text: str) -> np.ndarray:
        try:
            found = np.asarray(self.fast.encode_to_numpy(text, allowed_special="all"), dtype=np.uint32)
        except BaseException as e:  # its pattern matcher gives up on some very long pieces
            if isinstance(e, (KeyboardInterrupt, SystemExit)):
                raise
            found = np.frombuffer(self.slow.encode(text).tobytes(), np.uint32)
        return np.append(found, np.uint32(END))


_tokens: dict[str, Tokens] = {}


def places(ends: np.ndarray, sentence: np.ndarray, n: int, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Where a stream of n tokens may be cut (0 first), and what each cut costs; ends: of documents, sentence: whether a token ends one."""
    cost = np.full(n + 1, np.inf)
    marks = np.zeros(n + 1, dtype=bool)
    marks[1:] = sentence
    marks[ends] = True
    marks[0] = True
    at = np.flatnonzero(marks)
    since = np.arange(n + 1) - np.repeat(at, np.diff(np.append(at, n + 1)))
    cost[since % stride == 0] = INSIDE
    cost[1:][sentence] = SENTENCE
    cost[ends] = 0.0
    cost[0] = 0.0
    found = np.flatnonzero(cost < np.inf)
    return found, cost[found]


def cuts(pos: np.ndarray, penalty: np.ndarray, size: int = SIZE, whole: bool = False) -> list[int]:
    """The cheapest cuts of a stream (its ends left out, unless whole): at most size apart, each at one of the places.

    whole: the last window ends at the last place; else at the cheapest place of the last size tokens.
    """
    p, cost = pos.tolist(), penalty.tolist()
    m = len(p)
    f, parent = [0.0] * m, [0] * m
    queue, value = [0] * m, [0.0] * m  # the monotone queue: places with rising g, from head to tail
    head, tail = 0, 0
    for j in range(1, m):
        g = f[j - 1] + p[j - 1]
        while tail > head and value[tail - 1] >= g:
            tail -= 1
        queue[tail], value[tail] = j - 1, g
        tail += 1
        low = p[j] - size
        while p[queue[head]] < low:
            head += 1
        f[j] = size - p[j] + cost[j] + value[head]
        parent[j] = queue[head]
    j = m - 1
    if not whole:
        first = int(np.searchsorted(pos, p[-1] - size, "right"))
        j = min(range(max(1, first), m), key=lambda k: f[k] - (p[-1] - p[k]) * 1e-9) if m > 1 else 0
    out = []
    while j > 0:
        out.append(p[j])
        j = parent[j]
    return out[::-1]


def tail_cuts(n: int, size: int = SIZE) -> list[int]:
    """Cuts of the last n < size tokens: powers of two, where their cuts cost less than the padding."""
    parts = [1 << b for b in reversed(range(n.bit_length())) if n >> b & 1]
    if INSIDE * (len(parts) - 1) < size - n:
        return np.cumsum(parts).tolist()
    return [n]


class Stream:
    """Documents in, pieces of sequences out."""

    def __init__(self, tokens: Tokens, first_sequence: int, with_ids: bool) -> None:
        self.tokens, self.sequence, self.with_ids = tokens, first_sequence, with_ids
        self.docs: list[tuple[object, np.ndarray, int]] = []  # id, all its tokens, how many of them are out
        self.waiting = 0

    def add(self, key: object, text: str) -> None:
        ids = self.tokens.ids(text)
        self.docs.append((key, ids, 0))
        self.waiting += len(ids)

    def flush(self, last: bool) -> Iterator[tuple]:
        """The pieces of all whole windows; with last, of everything."""
        if not self.docs:
            return
        stream = np.concatenate([ids[done:] for _, ids, done in self.docs])
        n = len(stream)
        ends = np.cumsum([len(ids) - done for _, ids, done in self.docs])
        pos, cost = places(ends, self.tokens.ends[stream], n)
        found = cuts(pos, cost)
        if last:
            at = found[-1] if found else 0
            if n - at:
                found += [at + x for x in tail_cuts(n - at)]
        at = k = 0
        for cut in found:
            offset, length = 0, cut - at
            while at < cut:
                key, ids, done = self.docs[k]
                take = min(cut - at, len(ids) - done)
                piece = ids[done : done + take]
                row = (key, done, take, zlib.crc32(piece), len(ids), self.sequence, offset, length)
                yield (*row, piece.tolist()) if self.with_ids else row
                at, offset = at + take, offset + take
                if done + take == len(ids):
                    k += 1
                else:
                    self.docs[k] = (key, ids, done + take)
            self.sequence += 1
        del self.docs[:k]
        self.waiting = n - at


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row a piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length (and the ids)."""
    prepare(docs.sparkSession)
    kind = docs.select(id_col).schema[0].dataType
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _tokens:
            _tokens[path] = Tokens(path)
        # a sequence's number: its partition's, then its own
        stream = Stream(_tokens[path], TaskContext.get().partitionId() << 36, with_ids)
        id_type = None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(columns[0], id_type), *[pa.array(c, pa.int64()) for c in columns[1:8]]]
            arrays += [pa.array(columns[8], pa.list_(pa.int64()))] if with_ids else []
            return pa.RecordBatch.from_arrays(arrays, ["id", *names, *(["ids"] if with_ids else [])])

        for part in batches:
            id_type = part.column(0).type
            for key, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                stream.add(key, text.as_py() or "")
                if stream.waiting >= BLOCK and (rows := list(stream.flush(False))):
                    yield batch(rows)
        if rows := list(stream.flush(True)):
            yield batch(rows)

    schema = f"id {kind.simpleString()}, " + ", ".join(f"`{x}` bigint" for x in names) + (", ids array<bigint>" if with_ids else "")
    return docs.select(id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"), tokenizer_file())
