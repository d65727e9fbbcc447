"""A hidden Markov language model trained by Baum-Welch over the whole corpus.

A token is a word (ASCII letters in lower case) or the end of a text. Its symbol is the word itself for the HEAD most
frequent tokens, else a class of its last bytes; a hidden state emits symbols, and a word has the share of its
smoothed count among the words of its symbol. So the probability of a text is

    P(symbols of the text by the hidden Markov model) * product over tokens of P(word | symbol)

which sums to one over all token sequences with the unknown word as one token more (an unknown word counts as the
unknown word of its class, a part of that event, so its probability is never overstated).

Counts of all words of the training texts are summed by hash; the frequent ones are sent to all executors (a number
bounded by KNOWN), the others meet their occurrences in a join. Baum-Welch runs over all training texts in each
iteration: every partition adds up expected counts of its texts, cut into pieces of PIECE tokens, and only these
sums, whose size is fixed, are merged. Each token and each transition, those across cuts too, is counted in one piece,
which reads LEAD tokens more on both sides, so that the messages over a cut are those of the text but for what the
states tell over LEAD tokens; starts are counted at the starts of texts alone. Scoring is the exact scaled forward
recursion over whole texts.

Defined cases: a null or empty text is one end token; without training texts every word is unknown; a text of any
length is scored whole; a null id is held out; repeated rows score alike; only id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlverdict.llm import _bytes as B
from sqlverdict.llm._spark import fold_of, load, prepare, written

STATES, ITERATIONS = 8, 4
#: Tokens that are symbols of their own, and symbols that the other words share.
HEAD, TAILS = 2048, 2048
#: Tokens whose counts every executor holds (16 bytes each).
KNOWN = 65_536
PIECE = 256
#: Tokens that a piece reads before and after those that it counts.
LEAD = 16
#: Tokens worked on at a time in training.
BATCH = 1 << 18
ALPHA = 0.1
END = np.uint64(0x454E44)
_LN10 = np.log(10)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens of texts in order: (hash, class of its last bytes, number by text, with the end)."""
    data = B.LOWER[data]
    starts, ends, counts = B.words(data, offsets)
    h = B.ranges(B.prefix(data), starts, ends)
    last = data[ends - 1].astype(np.uint64) if len(ends) else np.zeros(0, np.uint64)
    before = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.uint64) if len(ends) else last
    tail = (B.mix((last << np.uint64(8)) | before) % np.uint64(TAILS - 1)).astype(np.int64) + 1
    # the end follows the last word of each text
    total = len(counts)
    to = np.arange(len(h)) + B.spread(counts)
    all_h, all_tail = np.full(len(h) + total, END), np.zeros(len(h) + total, np.int64)
    all_h[to], all_tail[to] = h, tail
    return all_h, all_tail, counts + 1


class Table:
    """Look-up of hashes in a sorted array, by their leading bits."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.append(keys, np.uint64(2**64 - 1))
        self.bits = np.uint64(44)
        self.start = np.searchsorted(keys, np.arange(1 << 20, dtype=np.uint64) << self.bits)
        self.deep = int(np.diff(np.append(self.start, len(keys))).max(initial=0))

    def find(self, h: np.ndarray) -> np.ndarray:
        """The index of each hash, or -1."""
        at = self.start[(h >> self.bits).astype(np.int64)]
        found = np.full(len(h), -1)
        for k in range(self.deep):
            place = np.minimum(at + k, len(self.keys) - 1)
            hit = self.keys[place] == h
            found[hit] = place[hit]
        return found


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.coalesce(fold_of(id_col, 10) == 0, F.lit(True)).alias("out"), F.col(text_col).cast("string").alias("text"))


def _word_counts(texts: DataFrame) -> DataFrame:
    """h, tail, c of all tokens of the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs: list[np.ndarray] = []
        tails: list[np.ndarray] = []

        def summed() -> pa.RecordBatch:
            h, first, n = np.unique(np.concatenate(hs), return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.concatenate(tails)[first].astype(np.int32)), pa.array(n)], ["h", "tail", "c"])

        for part, data, offsets in B.chunks(batches):
            h, tail, n = tokens(data, offsets)
            seen = np.repeat(~np.asarray(part.column(1)), n)
            hs.append(h[seen])
            tails.append(tail[seen])
            if sum(map(len, hs)) > 2_000_000:
                yield summed()
                hs, tails = [], []
        if hs:
            yield summed()

    return texts.select("id", "out", "text").mapInArrow(run, "h bigint, tail int, c bigint").groupBy("h").agg(F.max("tail").alias("tail"), F.sum("c").alias("c"))


class Symbols:
    """What all executors know: the counts of frequent tokens and which symbol each token is."""

    def __init__(self, h: np.ndarray, c: np.ndarray) -> None:
        order = np.argsort(h)
        self.h, self.c = h[order], c[order]
        rank = np.empty(len(h), np.int64)
        rank[np.argsort(-self.c, kind="stable")] = np.arange(len(h))
        self.symbol = np.where(rank < HEAD, rank + TAILS, -1)
        self.table: Table | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}

    def look_up(self, h: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol of each token and its index among the frequent ones, or -1."""
        self.table = self.table or Table(self.h)
        at = self.table.find(h)
        own = self.symbol[at] if len(self.symbol) else np.full(len(h), -1)
        return np.where((at >= 0) & (own >= 0), own, tail), at


def _sequences(texts: DataFrame, shared: Callable[[], Symbols]) -> DataFrame:
    """The symbols of each training text, as bytes."""
    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, pack = shared(), zstandard.ZstdCompressor(level=1)
        for part, data, offsets in B.chunks(batches):
            h, tail, n = tokens(data, offsets)
            seen = ~np.asarray(part.column(1))
            own = symbols.look_up(h, tail)[0][np.repeat(seen, n)].astype(np.uint16)
            yield pa.RecordBatch.from_arrays([pa.array([pack.compress(own.tobytes())], pa.binary()), pa.array([n[seen].astype(np.int32).tobytes()], pa.binary())], ["symbols", "sizes"])

    return texts.select("id", "out", "text").mapInArrow(run, "symbols binary, sizes binary")


class Model:
    """Initial, transition and emission probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, mass: np.ndarray, states: int = STATES, seed: int = 7) -> Model:
        """States that stay and that each lean to some symbols."""
        rng = np.random.default_rng(seed)
        emit = mass / mass.sum() * rng.gamma(1.0, 1.0, (states, len(mass)))
        move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(axis=1, keepdims=True))

    def steady(self) -> np.ndarray:
        """The share of each state far from the start."""
        return np.linalg.matrix_power(self.move, 1024)[0]

    def expected(self, seqs: list[np.ndarray], begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Expected counts of one set of sequences: starts, moves, emissions and the log likelihood, flat.

        Only the tokens from begin to end of each, and the moves to them, are counted; where begin is 0 a text starts.
        """
        k, m = self.emit.shape
        sizes = np.array([len(s) for s in seqs])
        order = np.argsort(-sizes, kind="stable")
        seqs, sizes = [seqs[i] for i in order], sizes[order]
        begin = np.zeros(len(seqs), np.int64) if begin is None else np.asarray(begin)[order]
        end = sizes if end is None else np.asarray(end)[order]
        top, n = int(sizes[0]), len(seqs)
        live = np.searchsorted(-sizes, -np.arange(1, top + 1), "right")  # sequences longer than t, which come first
        obs = np.zeros((top, n), np.int64)
        for i, s in enumerate(seqs):
            obs[: len(s), i] = s
        by_symbol = np.ascontiguousarray(self.emit.T)
        mask = (np.arange(top)[:, None] >= begin) & (np.arange(top)[:, None] < end)
        first = np.where((begin == 0)[:, None], self.start, self.steady())
        alpha, scale = np.zeros((top, n, k)), np.ones((top, n))
        for t in range(top):
            a = live[t]
            x = (first if t == 0 else alpha[t - 1, :a] @ self.move) * by_symbol[obs[t, :a]]
            scale[t, :a] = x.sum(axis=1)
            alpha[t, :a] = x / scale[t, :a, None]
        beta = np.ones((n, k))
        emits, moves = np.zeros((m, k)), np.zeros((k, k))
        gammas = np.zeros((top, n, k))
        for t in range(top - 1, -1, -1):
            a = live[t]
            gammas[t, :a] = alpha[t, :a] * beta[:a]
            if t:
                back = by_symbol[obs[t, :a]] * beta[:a] / scale[t, :a, None]
                moves += (alpha[t - 1, :a] * mask[t, :a, None]).T @ back
                beta[:a] = back @ self.move.T
        moves *= self.move
        for s in range(k):
            emits[:, s] = np.bincount(obs[mask], gammas[..., s][mask], m)
        return np.concatenate([gammas[0][begin == 0].sum(axis=0), moves.ravel(), emits.T.ravel(), [np.log(scale[mask]).sum()]])

    def updated(self, counts: np.ndarray, mass: np.ndarray) -> Model:
        """The maximum of the expected counts, with a little of the corpus's own shares in every state."""
        k, m = self.emit.shape
        start, move, emit = counts[:k] + 1e-3, counts[k : k + k * k].reshape(k, k) + 1e-3, counts[k + k * k : -1].reshape(k, m)
        emit = emit + 0.5 * mass / mass.sum() * HEAD
        return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))

    def log_likelihoods(self, obs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The scaled forward recursion over whole sequences, one after another in obs."""
        n = len(sizes)
        order = np.argsort(-sizes, kind="stable")
        begin, size = (np.cumsum(sizes) - sizes)[order], sizes[order]
        by_symbol = np.ascontiguousarray(self.emit.T)
        out, alpha = np.zeros(n), np.zeros((n, len(self.start)))
        live = np.searchsorted(-size, -np.arange(1, (size[0] if n else 0) + 1), "right")
        for t, a in enumerate(live.tolist()):
            x = (self.start if t == 0 else alpha[:a] @ self.move) * by_symbol[obs[begin[:a] + t]]
            scale = x.sum(axis=1)
            out[:a] += np.log(scale)
            alpha[:a] = x / scale[:, None]
        back = np.empty(n)
        back[order] = out
        return back


def _pieces(symbols: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[list[np.ndarray], list[int], list[int]]]:
    """Pieces of texts, with the tokens that each counts, in sets of about BATCH tokens."""
    pieces, begin, end, held, at = [], [], [], 0, 0
    for size in sizes.tolist():
        for k in range(at, at + size, PIECE):
            low = max(at, k - LEAD)
            pieces.append(symbols[low : min(k + PIECE + LEAD, at + size)])
            begin.append(k - low)
            end.append(min(k + PIECE, at + size) - low)
            held += len(pieces[-1])
            if held >= BATCH:
                yield pieces, begin, end
                pieces, begin, end, held = [], [], [], 0
        at += size
    if pieces:
        yield pieces, begin, end


def _step(seqs: DataFrame, model: Model) -> np.ndarray:
    """One pass over all training texts: the sums of the expected counts of all partitions."""
    import zstandard

    spark = seqs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    width = len(model.start) + model.move.size + model.emit.size + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, total = zstandard.ZstdDecompressor(), np.zeros(width)
        for part in batches:
            for packed, sizes in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                own, n = np.frombuffer(unpack.decompress(packed), np.uint16), np.frombuffer(sizes, np.int32)
                for pieces, begin, end in _pieces(own, n):
                    total += sent.value.expected(pieces, begin, end)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(0, width, 4096) // 4096, pa.int32()), pa.array([total[k : k + 4096].tolist() for k in range(0, width, 4096)], pa.list_(pa.float64()))], ["k", "x"])

    def add(table: pa.Table) -> pa.Table:
        x = table.column("x").combine_chunks()
        total = x.values.to_numpy().reshape(table.num_rows, -1).sum(axis=0)
        return pa.table({"k": table.column("k").slice(0, 1), "x": pa.array([total.tolist()], pa.list_(pa.float64()))})

    # what meets in a task is one slice of the counts of each partition
    rows = seqs.mapInArrow(run, "k int, x array<double>").groupBy("k").applyInArrow(add, "k int, x array<double>").orderBy("k").collect()
    sent.unpersist()
    return np.concatenate([np.array(r.x) for r in rows]) if rows else np.zeros(width)


class Language:
    """A trained model with the statistics of its corpus."""

    def __init__(self, symbols: Symbols, model: Model, mass: np.ndarray, n: int, v: int, likelihoods: list[float]) -> None:
        self.symbols, self.model, self.mass, self.n, self.v, self.likelihoods = symbols, model, mass, n, v, likelihoods


def fit(texts: DataFrame, counts: DataFrame, states: int = STATES, iterations: int = ITERATIONS) -> Language:
    """Train on all texts that aren't held out; counts: their words, as written by _word_counts."""
    spark = texts.sparkSession
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = counts.orderBy(F.desc("c"), "h").limit(KNOWN).select("h", "c").toArrow()
    symbols = Symbols(top.column("h").to_numpy().view(np.uint64), top.column("c").to_numpy())
    # the smoothed counts of each symbol: of the frequent tokens one by one, of the others by class
    mass = np.zeros(TAILS + HEAD)
    mass[:TAILS] = ALPHA  # the unknown word of each class
    heads = symbols.symbol >= 0
    mass[symbols.symbol[heads]] = symbols.c[heads] + ALPHA
    for tail, c in counts.groupBy("tail").agg(F.sum(F.col("c") + F.lit(ALPHA))).collect():
        mass[tail] += c
    taken = counts.join(F.broadcast(spark.createDataFrame([(int(x),) for x in symbols.h[heads].view(np.int64)], "h bigint")), "h").groupBy("tail").agg(F.sum(F.col("c") + F.lit(ALPHA)))
    for tail, c in taken.collect():
        mass[tail] -= c
    mass[:TAILS] = np.maximum(mass[:TAILS], ALPHA)
    mass[TAILS + int(heads.sum()) :] = 1e-9  # symbols without a token
    sent = spark.sparkContext.broadcast(symbols)
    seqs = written(_sequences(texts, lambda: sent.value), "symbols")
    model, likelihoods = Model.first(mass, states), []
    for _ in range(iterations if n else 0):
        sums = _step(seqs, model)
        likelihoods.append(float(sums[-1]))
        model = model.updated(sums, mass)
    return Language(symbols, model, mass, n, v, likelihoods)


def score(texts: DataFrame, counts: DataFrame, language: Language) -> DataFrame:
    """id, out, n_tokens, n_known, train_tokens, base_score, score of all texts."""
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast(language)
    kind = texts.schema["id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        own = sent.value
        for part, data, offsets in B.chunks(batches):
            h, tail, n = tokens(data, offsets)
            symbol, at = own.symbols.look_up(h, tail)
            yield part, B.row_keys(data, offsets, part.column(0)), h, symbol, at, n

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        log_c = np.log10(np.append(own.symbols.c, 0) + ALPHA)
        log_m = np.log10(own.mass)
        for part, key, h, symbol, at, n in rows(batches):
            doc, known = B.spread(n), at >= 0
            total = part.num_rows
            of = lambda w, doc=doc, total=total: np.bincount(doc, w, total)
            # what is sure here: the frequent tokens' counts, and the shares' denominators
            hmm = own.model.log_likelihoods(symbol, n) / _LN10 - of(log_m[symbol])
            columns = [part.column(0), part.column(1), pa.array(key), pa.array(n), pa.array(of(known).astype(np.int64)), pa.array(of(np.where(known, log_c[at], 0.0))), pa.array(hmm)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "out", "key", "n_tokens", "known", "log_c", "hmm"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, key, h, _, at, n in rows(batches):
            rare = at < 0
            k, w = np.repeat(key, n)[rare], h[rare]
            order = np.lexsort((w, k))
            k, w = k[order], w[order]
            first = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (w[1:] != w[:-1]))) if len(k) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(k))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(k[first]), pa.array(w[first].view(np.int64)), pa.array(times)], ["key", "h", "times"])

    own = texts.select("id", "out", "text")
    sure = own.mapInArrow(heads, f"id {kind}, out boolean, key bigint, n_tokens bigint, known bigint, log_c double, hmm double")
    rare = own.mapInArrow(others, "key bigint, h bigint, times int").join(counts.select("h", "c"), "h")
    # rows with equal id and text have one key and the same words, which count once
    once = rare.groupBy("h", "key").agg(F.max("times").alias("times"), F.max("c").alias("c"))
    sums = once.groupBy("key").agg(F.sum("times").alias("rare"), F.sum(F.col("times") * F.log10(F.col("c") + F.lit(ALPHA))).alias("rare_log"))
    unknown = F.log10(F.lit(ALPHA))
    known = F.col("known") + F.coalesce("rare", F.lit(0))
    log_c = F.col("log_c") + F.coalesce("rare_log", F.lit(0.0)) + (F.col("n_tokens") - known) * unknown
    base = log_c - F.col("n_tokens") * F.log10(F.lit(language.n + ALPHA * (language.v + 1)))
    return sure.join(sums, "key", "left").select("id", "out", "n_tokens", known.cast("long").alias("n_known"), F.lit(language.n).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("hmm") + log_c).alias("score"))


def language_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability)."""
    prepare(docs.sparkSession)
    texts = _texts(docs, id_col, text_col)
    counts = written(_word_counts(texts), "words")
    found = score(texts, counts, fit(texts, counts))
    return found.withColumnRenamed("id", id_col).withColumnRenamed("out", "held_out")


def op7_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(load(spark, sf_dir, "documents"))
