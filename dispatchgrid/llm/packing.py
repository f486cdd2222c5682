"""Token sequences of equal length, filled by bounded-space online best-fit.

`pieces` encodes each document, appends an end id and cuts what is longer than a sequence into whole sequences and a rest;
other documents stay in one piece. `place` deals the pieces out evenly, without their ids, and packs each share in one pass:
BINS sequences are open, and a bitset has a bit for every free space that an open one has. A piece goes where it leaves the
least room: the lowest bit at or above its length. Where it fits nowhere a new sequence is opened, and if BINS are open
already, the fullest one (the lowest bit of all) is closed first. At the end of a share its open sequences, a fixed number, are
packed anew, longest pieces first, and the better of both packings is taken. So a share holds BINS sequences in memory
whatever its size, and what it leaves empty is a part of one sequence or so. `sequences` brings ids and places together.

A share has at least SHARE tokens where the input is small, and at most MOST.

Nulls and empty texts: the end id alone. A null doc_id is packed like others and stays null. Repeated rows and doc_ids: each row
is a document of its own. Ties: pieces come in the order of a hash of doc_id and piece, then by all columns;
among sequences with the same room the one that got it last is taken. Very long texts: many pieces. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batch, small_batches, texts

SEQUENCE, BINS, END_ID = 4096, 256, 1
SHARE, MOST = 1 << 22, 1 << 26
#: Words whose ids a worker keeps, and how many odd ones go to the library in a line.
WORDS, LINE, TOGETHER = 600_000, 2000, 8 << 20

#: Letters whose lower case and normal form are the same in all libraries: ASCII and Latin-1.
_LETTERS = "a-zA-Z\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{ff}"
#: A sign that is a token of its own between blanks; it sets words apart in a line.
_APART = "\x02"
_TEXT = pa.large_string()
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
_PIECES_SQL = "doc_id long, piece int, start long, length long, ids binary"


def _byte_letters() -> dict[int, str]:
    """Each byte's letter in byte-level vocabularies: printable Latin-1 signs stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Words:
    """The ids of texts by a tokenizer that drops white space, so that words between blanks are encoded on their own.

    Each distinct word of a batch is asked of the library once: plain words of its model, others (as lines of many) of the whole
    tokenizer. A full stop or comma after a letter and before a blank is a token of its own, so it is cut off first.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks already use the cores
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.model, self.letters = self.lib.model, _byte_letters()
        self.apart = self._ids(_APART)
        if len(self.apart) != 1 or self._ids(f"a {_APART} b\n{_APART}")[1:].tolist()[::2] != [self.apart[0]] * 2:
            raise ValueError("the tokenizer doesn't take words one by one")
        self.keys, self.flat, self.start, self.size = pa.array([], _TEXT), np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, np.uint16)

    def _plain(self, words: pa.Array) -> list[np.ndarray]:
        shown = "\n".join(words.to_pylist()).encode().decode("latin-1").translate({**self.letters, 10: "\n"}).split("\n") if len(words) else []
        return [np.array([t.id for t in self.model.tokenize(w)], np.uint16) for w in shown]

    def _odd(self, words: pa.Array) -> list[np.ndarray]:
        many, out = words.to_pylist(), []
        for i in range(0, len(many), LINE):
            line = many[i : i + LINE]
            if any(_APART in w for w in line):
                out += [self._ids(w) for w in line]
            else:
                ids = np.array(self.lib.encode(f" {_APART} ".join(line), add_special_tokens=False).ids, np.uint16)
                cut = np.flatnonzero(ids == self.apart[0])
                out += [x[k > 0 :] for k, x in enumerate(np.split(ids, cut))]
        return out

    def _learn(self, fresh: pa.Array, plain: np.ndarray) -> None:
        ids: list = [None] * len(fresh)
        for mask, found in ((plain, self._plain), (~plain, self._odd)):
            for i, x in zip(np.flatnonzero(mask).tolist(), found(fresh.filter(pa.array(mask))), strict=True):
                ids[i] = x
        size = np.array([len(x) for x in ids], np.int64)
        self.keys = pa.concat_arrays([self.keys, fresh])
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, *ids])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a line, and where each text's begin, with their number at the end."""
        if len(self.keys) > WORDS:
            self.keys, self.flat, self.start, self.size = self.keys.slice(0, 0), self.flat[:0], self.start[:0], self.size[:0]
        spaced = pc.replace_substring_regex(pc.replace_substring(column, "\n", " "), f"([{_LETTERS}])([.,])( |\\z)", "\\1 \\2\\3")
        words = pc.split_pattern(spaced, " ")
        coded = words.flatten().dictionary_encode()
        own = coded.dictionary
        plain = pc.match_substring_regex(own, f"\\A[{_LETTERS}]+\\z")
        own = pc.if_else(plain, pc.utf8_lower(own), own)
        plain = plain.to_numpy(zero_copy_only=False).astype(bool)
        index = pc.fill_null(pc.index_in(own, value_set=self.keys), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        if (index < 0).any():
            new = pa.array(index < 0)
            fresh = own.filter(new).dictionary_encode()
            kind = np.zeros(len(fresh.dictionary), bool)
            at = fresh.indices.to_numpy(zero_copy_only=False)
            kind[at] = plain[index < 0]
            index[index < 0] = len(self.keys) + at
            self._learn(fresh.dictionary, kind)
        place = index[coded.indices.to_numpy(zero_copy_only=False)]
        size = self.size[place]
        before = np.cumsum(size) - size
        total = int(size.sum())
        ids = self.flat[np.arange(total) + np.repeat(self.start[place] - before, size)]
        return ids, np.append(before, total)[words.offsets.to_numpy()] if len(column) else np.zeros(1, np.int64)


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    return Words(path)


def _large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches joined to TOGETHER bytes or more."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= TOGETHER:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def pieces(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit integers) of each piece of each document."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _large(batches):
            doc_ids, column = t.column("doc_id").to_pylist(), t.column("text").cast(_TEXT).combine_chunks()
            column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
            ids, ends = words(tokenizer).encode(column)
            out: list[list] = [[] for _ in _PIECES]
            held = 0
            for d, i, j in zip(doc_ids, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                own = np.append(ids[i:j], end_id).astype("<u4")
                for k, at in enumerate(range(0, len(own), size)):
                    cut = own[at : at + size]
                    for c, v in zip(out, (d, k, at, len(cut), cut.tobytes()), strict=True):
                        c.append(v)
                    held += cut.nbytes
                if held > TOGETHER:
                    yield batch(_PIECES, **dict(zip(_PIECES.names, out, strict=True)))
                    out, held = [[] for _ in _PIECES], 0
            if out[0]:
                yield batch(_PIECES, **dict(zip(_PIECES.names, out, strict=True)))

    return texts(docs).mapInArrow(run, _PIECES_SQL)


class OpenBins:
    """Open sequences by free space; `put` gives the place of a piece, `closed` has the sequences that are done."""

    def __init__(self, size: int, most: int | None):
        self.size, self.most = size, most
        self.free, self.mask, self.n, self.closed = {}, 0, 0, []

    def _take(self, free: int) -> list:
        stack = self.free[free]
        out = stack.pop()
        if not stack:
            del self.free[free]
            self.mask ^= 1 << free
        self.n -= 1
        return out

    def put(self, item, length: int) -> None:
        fits = self.mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            own = self._take(free)
        else:
            if self.n == self.most:
                self.closed.append(self._take((self.mask & -self.mask).bit_length() - 1))
            own, free = [], self.size
        own.append((item, length))
        left = free - length
        if left == 0:
            self.closed.append(own)
            return
        self.free.setdefault(left, []).append(own)
        self.mask |= 1 << left
        self.n += 1

    def rest(self) -> list[list]:
        """The open sequences, packed anew with the longest pieces first if that takes fewer; none is open after."""
        held = [own for stack in self.free.values() for own in stack]
        self.free, self.mask, self.n = {}, 0, 0
        anew = OpenBins(self.size, None)
        for item, length in sorted((x for own in held for x in own), key=lambda x: -x[1]):
            anew.put(item, length)
        better = anew.closed + [own for stack in anew.free.values() for own in stack]
        return better if len(better) < len(held) else held


def _shares(tokens: int, usual: int) -> int:
    return max(1, min(usual, tokens // SHARE), -(-tokens // MOST))


def place(cut: DataFrame, size: int = SEQUENCE, bins: int = BINS) -> DataFrame:
    """The rows of a table of pieces (doc_id, piece, length, others carried) with sequence_id and offset.

    The table should be a written one: it is read twice, and shares are dealt by the order of its rows."""
    spark = cut.sparkSession
    if not cut.where(F.col("length") > size).isEmpty():
        raise ValueError(f"a piece is longer than {size}")
    tokens = cut.agg(F.sum("length")).first()[0] or 0
    shares = _shares(tokens, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut.repartition(shares).sortWithinPartitions(F.xxhash64("doc_id", "piece"), *cut.columns).withColumn("__share", F.spark_partition_id())
    fields = [f for f in dealt.schema if f.name != "__share"]
    out_sql = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, number, share, schema = OpenBins(size, bins), 0, 0, None

        def done(full: list[list]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            rows, seq, offset = [], [], []
            for own in full:
                at = 0
                for item, length in own:
                    rows.append(item)
                    seq.append((share << 40) + number)
                    offset.append(at)
                    at += length
                number += 1
            if rows:
                columns = [pa.array([r[i] for r in rows], type=schema.field(i).type) for i in range(len(schema) - 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(seq, pa.int64()), pa.array(offset, pa.int64())], names=[*schema.names[:-1], "sequence_id", "offset"])

        for b in batches:
            if b.num_rows:
                schema, share = b.schema, b.column("__share")[0].as_py()
                lengths = b.column("length").to_pylist()
                for item, length in zip(zip(*(c.to_pylist() for c in b.columns[:-1]), strict=True), lengths, strict=True):
                    open_.put(item, length)
                yield from done(open_.closed)
                open_.closed = []
        yield from done(open_.rest())

    return dealt.mapInArrow(run, out_sql)


def pack(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, bins: int = BINS, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece."""
    kept = Scratch(docs.sparkSession, "packing").keep(pieces(docs, tokenizer, size, end_id).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return place(kept, size, bins)


def sequences(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, bins: int = BINS, end_id: int = END_ID) -> DataFrame:
    """The packed sequences: sequence_id, ids, and the doc_id and length of each piece in their order."""
    kept = Scratch(docs.sparkSession, "packing").keep(pieces(docs, tokenizer, size, end_id), "ids")
    placed = place(kept, size, bins)
    own = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids"))).alias("p"))  # at most size pieces
    return own.select("sequence_id", F.aggregate("p.ids", F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"))
