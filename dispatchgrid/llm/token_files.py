"""Token ids in static range-ANS files.

A first pass encodes texts to 16-bit ids, chunk by chunk in ascending doc_id order; counts of all ids become one frequency
table, shared by every block. A second, narrow pass turns each chunk into blocks. A block is coded on its own: LANES
interleaved states of 52 bits take its ids in turn, give 32-bit words to one stream, and end as its checkpoint. So blocks, and
lanes within them, decode side by side; numpy runs over all lanes of a batch of blocks at once. Each block carries the
crc32 of its words and of its ids.

File format (`dispatchgrid-rans-2`), a Parquet table with one row per chunk, and beside it one of the frequency table:
  part, chunk        place of the chunk: chunks in this order hold documents in ascending doc_id order
  start              ids before the chunk's first, over the whole corpus
  doc_ids, lengths   the chunk's documents in order and how many ids each has, the end id included
  blocks             per block: n ids, states (LANES little-endian uint64), words (little-endian uint32), words_crc, ids_crc
Ids must lie under 65,536. Frequencies are scaled to 2**SCALE_BITS, each id that occurs having at least 1.

Nulls and empty texts: the end id alone. Null doc_id: dropped. Repeated doc_ids: each row is a document; their order among
themselves is that of their texts' digests. A text longer than a chunk makes a longer chunk of many blocks. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, batch, small_batches, texts

LANES = 64
BLOCK = 1 << 14
CHUNK = 1 << 20
SCALE_BITS = 20
END_ID = 2
#: Pieces of text whose ids a worker keeps, how many new ones go to the library in a line, and bytes of text at a time.
PIECES, LINE, TOGETHER = 1_200_000, 2000, 8 << 20

#: White space other than blanks and line feeds, and the sign that marks pieces without a blank before them.
_ODD_SPACE = "[\\x01\\x09\\x0b-\\x0d\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_TEXT, _ALWAYS = pa.large_string(), np.iinfo(np.int64).max
#: States lie from 2**20 to below 2**52, so that whole numbers of 64-bit floats hold them and quotients round down right.
_RANGE, _WORD = float(1 << SCALE_BITS), float(1 << 32)
_UNRANGE, _UNWORD, _LOW, PAD = 1 / _RANGE, 1 / _WORD, _RANGE, 1 << 16
_CHUNKS = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("ids", pa.binary())])
_BLOCK = pa.struct([("n", pa.int64()), ("states", pa.binary()), ("words", pa.binary()), ("words_crc", pa.int64()), ("ids_crc", pa.int64())])
_CODED = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("blocks", pa.list_(_BLOCK))])
_CODED_SQL = "part long, chunk long, start long, doc_ids array<long>, lengths array<long>, blocks array<struct<n:long,states:binary,words:binary,words_crc:long,ids_crc:long>>"
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


class Tables:
    """The shared frequency table: scaled counts, their running sums, and the id of each slot."""

    def __init__(self, counts: np.ndarray):
        total = 1 << SCALE_BITS
        used = np.flatnonzero(counts)
        f = np.zeros(len(counts), np.int64)
        if len(used):
            f[used] = np.maximum(1, counts[used].astype(np.float64) / counts.sum() * total).astype(np.int64)
            over = int(f.sum()) - total
            order = used[np.argsort(-f[used], kind="stable")]
            i = 0
            while over:  # the commonest ids give or take what rounding left over
                j = order[i % len(order)]
                step = max(-over, 0) or min(over, max(1, int(f[j]) // 2), int(f[j]) - 1)
                f[j] += step if over < 0 else -step
                over = int(f.sum()) - total
                i += 1
        self.freq = np.append(f, total).astype(np.float64)  # the last is PAD's
        self.base = np.append(np.cumsum(f) - f, 0).astype(np.float64)
        self._ids = None

    @property
    def ids(self) -> np.ndarray:
        if self._ids is None:
            self._ids = np.repeat(np.arange(PAD, dtype=np.uint16), self.freq[:PAD].astype(np.int64))
        return self._ids


def encode_blocks(ids: np.ndarray, t: Tables) -> list[dict]:
    """Blocks of a chunk's ids, all coded side by side."""
    count = -(-len(ids) // BLOCK)
    n = np.full(count, BLOCK)
    n[-1] = len(ids) - (count - 1) * BLOCK
    steps = -(-int(n.max()) // LANES)
    # Places beyond the last id hold a sign that has the whole range, so coding it changes nothing.
    flat = np.full(count * steps * LANES, PAD, np.int64)
    if count == 1:
        flat[: len(ids)] = ids
    else:
        flat.reshape(count, -1)[:, :BLOCK].reshape(-1)[: len(ids)] = ids
    sym = np.ascontiguousarray(flat.reshape(count, steps, LANES).transpose(1, 0, 2))
    freq, base = t.freq[sym], t.base[sym]
    state = np.full((count, LANES), _LOW)
    words, given = np.zeros(sym.shape, "<u4"), np.zeros(sym.shape, bool)
    for s in range(steps - 1, -1, -1):
        f = freq[s]
        out = state >= f * _WORD
        high = np.floor(state * _UNWORD)
        words[s] = state - high * _WORD
        given[s] = out
        x = np.where(out, high, state)
        q = np.floor(x / f)
        state = q * _RANGE + (x - q * f) + base[s]
    blocks = []
    for i in range(count):
        w = words[:, i, :][given[:, i, :]].tobytes()
        own = ids[i * BLOCK : i * BLOCK + n[i]].astype("<u2").tobytes()
        blocks.append({"n": int(n[i]), "states": state[i].astype("<u8").tobytes(), "words": w, "words_crc": zlib.crc32(w), "ids_crc": zlib.crc32(own)})
    return blocks


def decode_blocks(blocks: list[dict], t: Tables) -> np.ndarray:
    """Ids of blocks, from their checkpoints side by side; raises ValueError where a checksum fails."""
    for b in blocks:
        if zlib.crc32(b["words"]) != b["words_crc"]:
            raise ValueError("a block's words don't match their checksum")
    n = np.array([b["n"] for b in blocks])
    stream = np.frombuffer(b"".join(b["words"] for b in blocks) + b"\0" * 4 * LANES, "<u4").astype(np.float64)
    sizes = np.array([len(b["words"]) // 4 for b in blocks])
    at = (np.cumsum(sizes) - sizes)[:, None]
    state = np.frombuffer(b"".join(b["states"] for b in blocks), "<u8").reshape(len(blocks), LANES).astype(np.float64)
    steps, whole = -(-int(n.max()) // LANES), int(n.min()) // LANES
    out = np.zeros((steps, len(blocks), LANES), np.uint16)
    lane = np.arange(LANES)
    for s in range(steps):
        high = np.floor(state * _UNRANGE)
        slot = state - high * _RANGE
        sym = t.ids[slot.astype(np.int64)]
        out[s] = sym
        x = t.freq[sym] * high + slot - t.base[sym]
        take = x < _LOW
        if s >= whole:  # lanes beyond a block's last id stay as they are
            live = (s * LANES + lane)[None, :] < n[:, None]
            x, take = np.where(live, x, state), take & live
        rank = np.cumsum(take, axis=1)
        word = stream[np.minimum(at + rank - take, len(stream) - 1)]
        state = np.where(take, x * _WORD + word, x)
        at = at + rank[:, -1:]
    parts = []
    for i, b in enumerate(blocks):
        ids = np.ascontiguousarray(out[:, i, :]).reshape(-1)[: b["n"]]
        if zlib.crc32(ids.astype("<u2").tobytes()) != b["ids_crc"]:
            raise ValueError("a block's ids don't match their checksum")
        parts.append(ids)
    return np.concatenate(parts)


class _Library:
    """The tokenizers library, asked once for each piece of text that its pre-tokeniser would part anyway.

    Texts whose white space is even are divided at blanks and line feeds for a whole batch at once, the distinct pieces are
    looked up in a column of known ones, those that are new go to the library side by side in lines of some length (byte
    lengths of the ids tell them apart again), and ids are gathered by place. Other texts go to the library as they are."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks already use the cores
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        vocab = self.lib.get_vocab(with_added_tokens=False)
        self.width = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
        for t, i in vocab.items():
            self.width[i] = len(t)  # each character of a byte-level token is a byte
        special = [re.escape(t.content) for t in self.lib.get_added_tokens_decoder().values()]
        self.uneven = "|".join([_ODD_SPACE, r"[ \n][ \n]", r"\A[ \n]", r"[ \n]\z", *special])
        # What is known of pieces, in the order of learning: the line feed and the empty piece at a text's start come first.
        feed = self._ids("\n")
        self.keys = pa.array(["\n", "\x01"], _TEXT)
        self.flat, self.start, self.size = feed, np.zeros(2, np.int64), np.array([len(feed), 0])
        self.used, self.turn = np.array([_ALWAYS, _ALWAYS]), 0

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.lib.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint16)

    def whole(self, text: str) -> bytes:
        return self._ids(text).astype("<u2").tobytes()

    def learn(self, fresh: pa.Array) -> None:
        """Have the library encode pieces that aren't known, side by side in lines."""
        head = pc.starts_with(fresh, "\x01")
        blank = pc.binary_join_element_wise(pa.scalar(" ", _TEXT), fresh, pa.scalar("", _TEXT))
        shown = pc.if_else(head, pc.utf8_replace_slice(fresh, 0, 1, "\n"), blank)
        n = len(shown)
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array([*range(0, n, LINE), n], pa.int32()), shown.cast(pa.string())), "")
        ids = np.concatenate([np.array(e.ids, np.uint16) for e in self.lib.encode_batch_fast(lines.to_pylist(), add_special_tokens=False)])
        # A piece after a line feed begins behind it; the line feed is an id of its own.
        width, feed = pc.binary_length(shown).to_numpy(zero_copy_only=False), head.to_numpy(zero_copy_only=False)
        stop, ends = np.cumsum(width), np.cumsum(self.width[ids])
        first, last = np.searchsorted(ends, stop - width + feed, "right"), np.searchsorted(ends, stop, "right")
        self.keys = pa.concat_arrays([self.keys, fresh])
        self.start = np.concatenate([self.start, first + len(self.flat)])
        self.size = np.concatenate([self.size, last - first])
        self.used = np.concatenate([self.used, np.full(n, self.turn)])
        self.flat = np.concatenate([self.flat, ids])

    def forget(self) -> None:
        """Keep the half of PIECES that was seen last."""
        keep = np.sort(np.argsort(-self.used, kind="stable")[: PIECES // 2])
        size = self.size[keep]
        stop = np.cumsum(size)
        self.flat = self.flat[np.arange(int(size.sum())) + np.repeat(self.start[keep] - stop + size, size)]
        self.keys, self.start, self.size, self.used = self.keys.take(pa.array(keep)), stop - size, size, self.used[keep]

    def encode(self, many: list[str]) -> Iterator[bytes]:
        column = pa.array(many, _TEXT)
        odd = pc.match_substring_regex(column, self.uneven)
        lines = pc.replace_substring(pc.binary_join_element_wise(pa.scalar("\x01", _TEXT), column.filter(pc.invert(odd)), pa.scalar("", _TEXT)), "\n", " \n \x01")
        words = pc.split_pattern(lines, " ")
        coded = words.flatten().dictionary_encode()
        self.turn += 1
        known = pc.index_in(coded.dictionary, value_set=self.keys)
        index = pc.fill_null(known, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        fresh = index < 0
        if fresh.any():
            index[fresh] = len(self.keys) + np.arange(int(fresh.sum()))
            self.learn(coded.dictionary.filter(pa.array(fresh)))
        self.used[index] = np.maximum(self.used[index], self.turn)
        place = index[coded.indices.to_numpy(zero_copy_only=False)]
        own = self.size[place]
        before = np.cumsum(own) - own
        total = int(own.sum())
        ids = self.flat[np.arange(total) + np.repeat(self.start[place] - before, own)].astype("<u2").tobytes()
        upto = np.append(before, total)[words.offsets.to_numpy()].tolist() if len(words) else [0]
        if len(self.keys) > PIECES:
            self.forget()
        even = iter(zip(upto, upto[1:], strict=False))
        for text, whole in zip(many, odd.to_pylist(), strict=True):
            if whole:
                yield self.whole(text)
            else:
                i, j = next(even)
                yield ids[2 * i : 2 * j]


@lru_cache(maxsize=2)
def library(path: str) -> _Library:
    return _Library(path)


def _in_order(docs: DataFrame) -> DataFrame:
    """Documents in ascending doc_id order over partitions; those that lie so already aren't moved."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        good = True
        for b in batches:
            x = b.column("doc_id").to_numpy(zero_copy_only=False)
            if len(x):
                good = good and (high is None or high < x[0]) and bool((np.diff(x) > 0).all())
                low, high = int(x[0]) if low is None else low, int(x[-1])
        if low is not None:
            yield pa.RecordBatch.from_pydict({"low": [low], "high": [high], "good": [good]})

    spans = docs.select("doc_id").mapInArrow(look, "low long, high long, good boolean")
    before = F.max("high").over(Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1))
    bad = spans.withColumn("before", before).where("not good or before >= low").limit(1).count()
    if not bad:
        return docs
    n = max(docs.rdd.getNumPartitions(), 1)
    return docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches joined to TOGETHER bytes or more, so that what a look-up costs once is shared by more texts."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= TOGETHER:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _chunks(docs: DataFrame, encode: Callable[[list[str]], Iterable[bytes]], end_id: int) -> DataFrame:
    end = np.array([end_id], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, before, ids, lengths, held, size = None, 0, 0, [], [], [], 0
        for b in _together(batches):
            for i, x in zip(b.column("doc_id").to_pylist(), encode(b.column("text").to_pylist()), strict=True):
                part = i if part is None else part
                ids.append(i)
                held.append(x + end)
                lengths.append(len(held[-1]) // 2)
                size += lengths[-1]
                if size >= CHUNK:
                    yield batch(_CHUNKS, part=[part], chunk=[chunk], before=[before], doc_ids=[ids], lengths=[lengths], ids=[b"".join(held)])
                    chunk, before, ids, lengths, held, size = chunk + 1, before + size, [], [], [], 0
        if ids:
            yield batch(_CHUNKS, part=[part], chunk=[chunk], before=[before], doc_ids=[ids], lengths=[lengths], ids=[b"".join(held)])

    return docs.mapInArrow(run, "part long, chunk long, before long, doc_ids array<long>, lengths array<long>, ids binary")


def id_counts(chunks: DataFrame) -> np.ndarray:
    """Occurrences of each id over all chunks; at most 65,536 rows come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            for x in b.column("ids"):
                total += np.bincount(np.frombuffer(x.as_buffer(), "<u2"), minlength=1 << 16)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": used, "n": total[used]})

    counts = np.zeros(1 << 16, np.int64)
    for r in chunks.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["id"]] = r["n"]
    return counts


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, encode: Callable[[list[str]], Iterable[bytes]] | None = None) -> None:
    """Encode every document and write the files under path."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "token-files")
    ordered = _in_order(texts(docs).where("doc_id is not null"))
    chunks = scratch.keep(_chunks(ordered, encode or (lambda many: library(tokenizer).encode(many)), end_id), "chunks")
    counts = id_counts(chunks)
    first, total = {}, 0  # ids before each part: one entry per input partition
    for r in chunks.groupBy("part").agg(F.max(F.col("before") + F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("size")).orderBy("part").toLocalIterator():
        first[r["part"]] = total
        total += r["size"]
    shared = spark.sparkContext.broadcast((counts, first))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, first = shared.value
        t = Tables(counts)
        for b in batches:
            for r in b.to_pylist():
                yield batch(_CODED, part=[r["part"]], chunk=[r["chunk"]], start=[first[r["part"]] + r["before"]], doc_ids=[r["doc_ids"]], lengths=[r["lengths"]], blocks=[encode_blocks(np.frombuffer(r["ids"], "<u2"), t)])

    chunks.mapInArrow(code, _CODED_SQL).write.mode("overwrite").option("compression", "none").parquet(f"{path}/chunks")
    spark.createDataFrame([(int(i), int(n)) for i, n in enumerate(counts) if n], "id long, n long").coalesce(1).write.mode("overwrite").parquet(f"{path}/table")
    scratch.drop("chunks")


def read(spark, path: str, consume: Callable[[np.ndarray, np.ndarray], list[int]] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of files under path, each document's ids decoded and handed to the checksum."""
    small_batches(spark)
    counts = np.zeros(1 << 16, np.int64)
    for r in spark.read.parquet(f"{path}/table").toLocalIterator():
        counts[r["id"]] = r["n"]
    shared = spark.sparkContext.broadcast(counts)
    consume = consume or crc32_of_documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tables(shared.value)
        for b in batches:
            for r in b.to_pylist():
                ends = np.cumsum(r["lengths"])
                yield batch(_READ, doc_id=r["doc_ids"], start=ends - r["lengths"] + r["start"], n_tokens=r["lengths"], ids_crc32=consume(decode_blocks(r["blocks"], t), ends))

    return spark.read.schema(_CODED_SQL).parquet(f"{path}/chunks").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def crc32_of_documents(ids: np.ndarray, ends: np.ndarray) -> list[int]:
    data = memoryview(ids.astype("<u4").tobytes())
    begins = [0, *(4 * ends[:-1]).tolist()]
    return [zlib.crc32(data[i:j]) for i, j in zip(begins, (4 * ends).tolist(), strict=True)]
