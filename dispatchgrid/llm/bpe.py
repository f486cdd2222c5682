"""Byte-level BPE as a streaming transducer, and its decoder as a byte-to-text state machine.

A token is stable once nothing to its right can change it. How far to its right that can be follows from the merge list
alone: a token, or a part of its right edge before the merge that hides it, can be taken by a merge (s, z) of a lower rank,
which depends on the bytes of z and on what can in turn take z's right edge before that rank. `lookahead` is the longest
such reach over all tokens, found in one pass over the merges by rank. So the transducer holds a window of a few times that
reach, merges it, emits the tokens that end at least the reach before the window's end, drops their bytes and reads on:
memory doesn't grow with a word. A text is read in segments, each encoded, digested and decoded before the next, so memory
doesn't grow with the text either but for the text itself. Results of short words are kept in a table of two bounded
generations.

Nulls and empty texts: no tokens, the empty text. Null doc_id, repeated rows and ties: each row on its own. Very long texts
and words: segments and windows as above. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import batch, small_batches, texts

GENERATION = 200_000
SHORT = 64
_NEVER = 1 << 60
#: Fixed value: the pre-tokenisation pattern of byte-level BPE.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Texts whose only white space is single blanks and line feeds between words divide before each of these.
_UNEVEN = re.compile(r"[^\S \n]|\s\s|^\s|\s$|\x01")


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary file: printable ones themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def pieces(text: str) -> list[str] | None:
    """Keys of the pieces of text, divided at word starts so that each is a sequence of whole pre-tokens: a word stands for
    itself after a blank, one marked by \x01 for itself alone. None where white space isn't even."""
    first = "\x01"
    if text[:1] == " ":
        text, first = text[1:], ""
    if _UNEVEN.search(text):
        return None
    return (first + text).replace("\n", " \n \x01").split(" ") if text else [] if first else None


def segments(text: str, size: int = 1 << 16) -> Iterator[str]:
    """The text in parts of about `size` characters, divided before single blanks, where a pre-token begins in any case."""
    at = 0
    while len(text) - at > size:
        i = text.find(" ", at + size)
        while 0 <= i < len(text) - 1 and (text[i - 1].isspace() or text[i + 1].isspace()):
            i = text.find(" ", i + 1)
        if not 0 <= i < len(text) - 1:
            break
        yield text[at:i]
        at = i
    yield text[at:]


def piece_text(key: str) -> str:
    return key if key == "\n" else key[1:] if key[0] == "\x01" else " " + key


class Memo(dict):
    """Piece to result, kept in two generations of bounded size."""

    def __init__(self, compute, size: int = GENERATION):
        super().__init__()
        self.compute, self.size, self.old = compute, size, {}

    def __missing__(self, key):
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        out = self.old.get(key)
        if out is None:
            out = self.compute(key)
        self[key] = out
        return out


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_symbols()
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.bytes_of = {i: bytes(symbols[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.first = [vocab[c] for c, _ in sorted(symbols.items(), key=lambda x: x[1])]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for r, m in enumerate(merges):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank[vocab[a], vocab[b]] = r
            self.made.append(vocab[a + b])
        self.lookahead = self._reach()
        self.window = max(SHORT, 2 * (self.lookahead + max(map(len, self.bytes_of.values()))))
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words = Memo(self._word)
        self.memo = Memo(self._piece)

    def _reach(self) -> int:
        best: dict[int, int] = {}  # of a token: reach of the merges so far that take it from the right
        edge: dict[int, int] = {}  # of a token: reach of what could take a part of its right edge before it was made
        for (s, z), made in zip(self.rank, self.made, strict=True):
            reach = len(self.bytes_of[z]) + max(best.get(z, 0), edge.get(z, 0))
            edge[made] = max(edge.get(made, 0), best.get(z, 0), edge.get(z, 0))
            best[s] = max(best.get(s, 0), reach)
        return max([0, *best.values(), *edge.values()])

    def merge(self, data: bytes) -> list[int]:
        """Tokens of data merged by rank."""
        first, get = self.first, self.rank.get
        ids = [first[b] for b in data]
        ranks = [get(p, _NEVER) for p in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == _NEVER:
                break
            i = ranks.index(low)
            ids[i : i + 2] = (self.made[low],)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), _NEVER)
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), _NEVER)
        return ids

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Tokens of one pre-token that arrives in chunks, each as soon as it is stable."""
        held = bytearray()
        for chunk in chunks:
            held += chunk
            while len(held) >= self.window:
                end, safe = 0, self.window - self.lookahead
                for t in self.merge(bytes(held[: self.window])):
                    if end + len(self.bytes_of[t]) > safe:
                        break
                    end += len(self.bytes_of[t])
                    yield t
                del held[:end]
        yield from self.merge(bytes(held))

    def _word(self, word: str) -> tuple[int, ...]:
        return tuple(self.stream((word.encode(),)))

    def _piece(self, key: str) -> tuple[int, ...]:
        words = _WORDS.findall(piece_text(key))
        if len(words) == 1 and len(key) <= SHORT:
            return self._word(words[0])
        return tuple(chain.from_iterable(map(self._pretoken, words)))

    def _pretoken(self, word: str) -> Iterable[int]:
        if len(word) <= SHORT:
            return self.words[word]
        data = word.encode()
        return self.stream(data[i : i + self.window] for i in range(0, len(data), self.window))

    def _plain(self, text: str) -> Iterator[int]:
        parts = pieces(text)
        if parts is None:
            for m in _WORDS.finditer(text):
                yield from self._pretoken(m[0])
        else:
            memo = self.memo
            for p in parts:
                yield from memo[p] if len(p) <= SHORT else self._piece(p)

    def _segment(self, text: str) -> list[int]:
        parts = pieces(text)
        if parts is not None and max(map(len, parts), default=0) <= SHORT:
            return list(chain.from_iterable(map(self.memo.__getitem__, parts)))
        return list(self._plain(text))

    def encode_parts(self, text: str) -> Iterator[list[int]]:
        """Ids of a whole text, some at a time, each as soon as it is stable; strings of special tokens become their ids."""
        at = 0
        for m in self._special.finditer(text) if self._special is not None else ():
            for x in segments(text[at : m.start()]):
                yield self._segment(x)
            yield [self.special[m[0]]]
            at = m.end()
        for x in segments(text[at:] if at else text):
            yield self._segment(x)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.encode_parts(text)))

    def decode(self, ids: Iterable[int], chunk: int = 1 << 14) -> Iterator[str]:
        """Text of ids piece by piece; a character whose bytes are split over tokens is held until it is whole, and bytes that
        form none become U+FFFD."""
        machine, ids = self.machine(), iter(ids)
        while part := list(islice(ids, chunk)):
            yield machine.decode(self.joined(part))
        yield machine.decode(b"", True)

    def joined(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    @staticmethod
    def machine() -> codecs.IncrementalDecoder:
        return codecs.getincrementaldecoder("utf-8")("replace")


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
_DECODED = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids: the tokens of each whole text; null is empty and has none. A narrow map: no row moves."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            for part in _parts(b):
                yield batch(_ENCODED, doc_id=part.column("doc_id"), ids=[bpe.encode(x) for x in part.column("text").to_pylist()])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of doc_id, ids; null ids are no tokens."""
    small_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            yield batch(_DECODED, doc_id=b.column("doc_id"), text=["".join(bpe.decode(x or ())) for x in b.column("ids").to_pylist()])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode in one pass, digests fed as both go."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        shown = {i: str(i) for i in bpe.bytes_of}
        for b in batches:
            n, coded, decoded = [], [], []
            for text in b.column("text").to_pylist():
                size, machine, of_ids, of_text = 0, bpe.machine(), hashlib.sha256(), hashlib.sha256()
                for ids in bpe.encode_parts(text):
                    if ids:
                        of_ids.update(("," * (size > 0) + ",".join(map(shown.__getitem__, ids))).encode())
                        of_text.update(machine.decode(bpe.joined(ids)).encode())
                        size += len(ids)
                of_text.update(machine.decode(b"", True).encode())
                n.append(size)
                coded.append(of_ids.hexdigest())
                decoded.append(of_text.hexdigest())
            yield batch(_DIGESTS, doc_id=b.column("doc_id"), n_tokens=n, ids_sha256=coded, decoded_sha256=decoded)

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _parts(b: pa.RecordBatch, rows: int = 100) -> Iterator[pa.RecordBatch]:
    for i in range(0, b.num_rows, rows):
        yield b.slice(i, rows)
