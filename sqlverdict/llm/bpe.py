"""Byte-level byte-pair encoding and decoding with a published vocabulary.

Each piece of a text is encoded by a priority queue of merge ranks over a doubly linked list of symbols: the
best-ranked pair is merged, its neighbours' new pairs are queued, and entries that a merge made stale are
skipped when they surface. Pieces repeat, so each Python worker keeps a bounded table of pieces it has encoded.
Ids are decoded by concatenating the byte strings of the vocabulary.

Texts are cut into pieces at single spaces between non-blank characters first (a cut there never divides a
piece), then by the vocabulary's pattern. Special tokens' strings in a text become those tokens, as the
tokenizers library has it by default.

Defined cases: a null text is the empty text, with no ids; texts of any length are encoded whole; a piece of any
length costs n log n; repeated rows get equal results; columns other than id and text are not used.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from sqlverdict.llm._spark import load, prepare

#: Entries of a worker's table of encoded pieces; it is emptied when full.
CACHE = 300_000
#: Pieces longer than this are not kept.
LONGEST = 64


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """Where a public vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself where it is printable, else the next from U+0100."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """A vocabulary with its merge ranks, as read from a tokenizers JSON file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = byte_letters()
        to_bytes = lambda t: bytes(letters[c] for c in t)
        model = data["model"]
        self.vocab: dict[bytes, int] = {to_bytes(t): i for t, i in model["vocab"].items() if all(c in letters for c in t)}
        self.special: dict[str, int] = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        for t in self.special:
            self.vocab.pop(t.encode(), None)
        self.strings: list[bytes] = [b""] * (1 + max([*self.vocab.values(), *self.special.values()]))
        for t, i in self.vocab.items():
            self.strings[i] = t
        for t, i in self.special.items():
            self.strings[i] = t.encode()
        ids = {t: self.vocab[to_bytes(t)] for t in model["vocab"] if to_bytes(t) in self.vocab} if all(c in letters for t in model["vocab"] for c in t) else {t: i for t, i in model["vocab"].items()}
        #: (left id << 20 | right id): rank; and the id that each merge makes
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.ranks[ids[a] << 20 | ids[b]] = rank
            self.merged.append(ids[a + b])
        self.single = [self.vocab[bytes([b])] for b in range(256)]
        self.pattern = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pieces: dict[str, list[int]] = {}

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        n = len(piece)
        single = self.single
        ids = [single[b] for b in piece]
        if n < 2:
            return ids
        rank_of, merged = self.ranks.get, self.merged
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        after[-1] = 0  # no symbol follows: place 0 is nobody's successor
        # an entry is a rank and a place in one number, and so is a pair of ids
        bits = n.bit_length()
        mask = (1 << bits) - 1
        queue = [r << bits | i for i, x in enumerate(zip(ids, ids[1:])) if (r := rank_of(x[0] << 20 | x[1])) is not None]
        heapify(queue)
        while queue:
            e = heappop(queue)
            i = e & mask
            j = after[i]
            if not j or rank_of(ids[i] << 20 | ids[j]) != e >> bits:  # stale: the pair there is another now
                continue
            new = ids[i] = merged[e >> bits]
            k = after[i] = after[j]
            after[j] = 0
            ids[j] = -1
            if k:
                before[k] = i
                if (r := rank_of(new << 20 | ids[k])) is not None:
                    heappush(queue, r << bits | i)
            if i and (r := rank_of(ids[h := before[i]] << 20 | new)) is not None:
                heappush(queue, r << bits | h)
        return [x for x in ids if x >= 0]

    def _packed(self, part: str) -> bytes:
        """The ids of a stretch of text, packed: pieces of the pattern, each looked up or encoded."""
        packed = self.older.get(part)
        if packed is None:
            out = array("I")
            for piece in self.pattern.findall(part):
                ids = self.pieces.get(piece)
                if ids is None:
                    ids = self.encode_piece(piece.encode("utf-8"))
                    if len(piece) <= LONGEST:
                        if len(self.pieces) >= CACHE:
                            self.pieces.clear()
                        self.pieces[piece] = ids
                out.extend(ids)
            packed = out.tobytes()
        if len(part) <= LONGEST:
            if len(self.known) >= CACHE:  # the last table stays for a while, so that frequent parts move on
                self.known, self.older = {}, self.known
            self.known[part] = packed
        return packed

    def _plain(self, text: str) -> bytes:
        packed = self._packed
        parts = text.split(" ")
        # a space that has white space on both sides, or before it and the end after it, belongs to a run: no cut there
        if "" in parts or any(p[-1].isspace() or p[0].isspace() for p in parts if not (p[0].isalnum() and p[-1].isascii() and p[-1] > " ")):
            return b"".join([packed(p) for p in self._careful(text)])
        parts[1:] = map(" ".__add__, parts[1:])
        known = self.known
        return b"".join([known.get(p) or packed(p) for p in parts])

    def _careful(self, text: str) -> Iterator[str]:
        at = 0
        for m in regex.finditer(r"(?<=\S) (?=\S)", text):
            yield text[at : m.start()]
            at = m.start()
        if at < len(text):
            yield text[at:]

    def encode(self, text: str) -> array:
        """The ids of a whole text."""
        out, at = array("I"), 0
        if not text:
            return out
        if self.cut is not None and (found := list(self.cut.finditer(text))):
            for m in found:
                if m.start() > at:
                    out.frombytes(self._plain(text[at : m.start()]))
                out.append(self.special[m[0]])
                at = m.end()
        if at < len(text):
            out.frombytes(self._plain(text[at:] if at else text))
        return out

    def decode(self, ids: array) -> bytes:
        """The concatenated vocabulary strings of the ids."""
        return b"".join(map(self.strings.__getitem__, ids))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, one in each Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """One row a document: id, n_tokens, digests of the ids and of the decoded text; ids adds both themselves."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(path)
        for batch in batches:
            n, i_sha, d_sha, full, texts = [], [], [], [], []
            for value in batch.column(1):
                found = codec.encode(value.as_py() or "")
                text = codec.decode(found).decode("utf-8", "replace")
                n.append(len(found))
                i_sha.append(hashlib.sha256(found).hexdigest())
                d_sha.append(hashlib.sha256(text.encode("utf-8")).hexdigest())
                if ids:
                    full.append(found.tolist())
                    texts.append(text)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(i_sha, pa.string()), pa.array(d_sha, pa.string())]
            columns += [pa.array(full, pa.list_(pa.int64())), pa.array(texts, pa.string())] if ids else []
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if ids else [])])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<bigint>, decoded string" if ids else "")
    return docs.select(id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(load(spark, sf_dir, "documents"), tokenizer_file())
