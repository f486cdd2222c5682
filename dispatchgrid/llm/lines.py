"""Substring deduplication by hashing lines and paragraphs.

A text is divided into lines (at \\n) and these into sentences (at full stops and the like before white space). The units
that are hashed are paragraphs of them: from each sentence on, as many as make up MIN_WORDS words or more, and likewise
back from each sentence. A line of MIN_WORDS words is such a unit by itself; short lines count only together with their
neighbours, so that a heading which many texts share stays where it is. Units are normalised (lower case, ASCII punctuation
dropped, white space collapsed) and hashed to 128 bits. Digests are grouped over the whole corpus; the occurrence of smallest
(doc_id, sentence) of each stays, and the sentences of every other go. What goes is there once more at an earlier rank, so
by induction some copy of it stays. Spans of what goes are offsets in code points into the original text, so the original
can be put together again from the cleaned text and them. A line feed goes with the whole of its line only.

Why MIN_WORDS = 25: meant are repeated passages of more than 50 words; one that is set in the middle of sentences loses its
first and last to its surroundings, and half of it still makes a unit.

First digests alone are counted, by 64 bits and with a map-side combine; only those found twice take their places along.
A digest that a third of all documents share is one row per task before the first shuffle, and the joins back are such that
adaptive execution splits them. Texts that lose nothing aren't moved but for false hits of a bitmap whose size follows the
number of those that do, up to a bound; the join after it is exact.

Nulls and empty texts: no units, kept as empty. Null doc_id: kept as it is, and nothing is removed on its account. Repeated
rows of one doc_id: their equal units have the same rank, so each row keeps those it would keep alone. Ties: there are none
besides. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bitmap, Scratch, batch, small_batches, texts

MIN_WORDS = 25
_PUNCTUATION = string.punctuation.encode()
_BLANK = r"[ \t\n\x0b\f\r]"
#: A look-behind, so that a run of full stops without a blank after it is passed over once.
_BREAK = {"sentence": re.compile(rf"(?<=[.!?]){_BLANK}+|\n"), "line": re.compile("\n")}
_UNITS = pa.schema([("doc_id", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64())])
_SPANS = "array<struct<begin:long,stop:long,kept_in:long,kept_unit:long>>"
_CLEAN = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("removed", pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64()), ("kept_in", pa.int64()), ("kept_unit", pa.int64())])))])


def sentences(text: str, by: str = "sentence") -> list[tuple[int, int]]:
    """Spans that part the text, each with the separator after it."""
    ends = [m.end() for m in _BREAK[by].finditer(text)]
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    return list(zip([0, *ends[:-1]], ends, strict=True)) if ends else []


def paragraphs(text: str, by: str = "sentence", least: int = MIN_WORDS) -> list[tuple[int, int, bytes]]:
    """(first, last, digest): runs of sentences that just reach `least` words, from each first one on and to each last one."""
    words = [text[b:e].lower().encode().translate(None, _PUNCTUATION).split() for b, e in sentences(text, by)]
    total = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=total[1:])
    if total[-1] < least:
        return []
    flat = b" ".join(x for w in words for x in w)
    size = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) + sum(map(len, w)) for w in words], out=size[1:])
    spans = set(zip(range(len(words)), (np.searchsorted(total, total[:-1] + least) - 1).tolist(), strict=True))
    spans |= set(zip((np.searchsorted(total, total[1:] - least, "right") - 1).tolist(), range(len(words)), strict=True))
    at, has = size.tolist(), [bool(w) for w in words]
    n = len(words)
    return [(i, j, xxhash.xxh3_128_digest(flat[at[i] : at[j + 1] - 1])) for i, j in spans if 0 <= i <= j < n and has[i] and has[j]]


def _signed(x: bytes) -> int:
    return int.from_bytes(x, "little", signed=True)


def unit_table(docs: DataFrame, by: str = "sentence", least: int = MIN_WORDS) -> DataFrame:
    """doc_id, first, last, d1, d2: every unit of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 100):
                some = b.slice(at, 100)
                ids, first, last, digests = [], [], [], []
                for i, text in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist(), strict=True):
                    for p, q, d in paragraphs(text, by, least):
                        ids.append(i)
                        first.append(p)
                        last.append(q)
                        digests.append(d)
                if ids:
                    d = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                    yield batch(_UNITS, doc_id=ids, first=first, last=last, d1=np.ascontiguousarray(d[:, 0]), d2=np.ascontiguousarray(d[:, 1]))

    return docs.mapInArrow(run, "doc_id long, first int, last int, d1 long, d2 long")


def repeated_units(docs: DataFrame, by: str = "sentence", least: int = MIN_WORDS) -> DataFrame:
    """doc_id, first, last, kept_in, kept_unit: sentences of every unit that goes, and where the one that stays begins."""
    small_batches(docs.sparkSession)
    every = unit_table(texts(docs).where("doc_id is not null"), by, least)
    scratch = Scratch(docs.sparkSession, "lines")
    # Both sides of a join are written tables, so that a hot digest's rows can be dealt to many tasks.
    often = scratch.keep(every.groupBy("d1").agg(F.count("*").alias("n")).where("n > 1").select("d1"), "often")
    held = scratch.keep(every.join(often, "d1"), "held")
    first = held.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "first")).alias("lo"), F.max(F.struct("doc_id", "first")).alias("hi")).where("lo <> hi")
    first = scratch.keep(first.select("d1", "d2", "lo"), "first")
    gone = held.join(first, ["d1", "d2"]).where("not (doc_id = lo.doc_id and first = lo.first)")
    return gone.select("doc_id", "first", "last", F.col("lo.doc_id").alias("kept_in"), F.col("lo.first").cast("long").alias("kept_unit"))


def cut(text: str, gone: list[dict], by: str = "sentence") -> tuple[str, list[dict]]:
    """The text without the sentences of `gone`, and the spans that went, each with the kept place of its first unit."""
    spans = sentences(text, by)
    why: dict[int, dict] = {}
    for g in sorted(gone, key=lambda g: (g["first"], g["last"])):
        for k in range(g["first"], g["last"] + 1):
            why.setdefault(k, g)
    out, runs = [], []
    for k in sorted(why):
        if runs and runs[-1][1] == spans[k][0]:
            runs[-1][1] = spans[k][1]
        else:
            runs.append([*spans[k], why[k]])
    at, removed = 0, []
    for begin, stop, g in runs:
        if begin and text[begin - 1] != "\n":
            tail = len(text[begin:stop].rstrip(" \t\n\x0b\f\r")) + begin
            feed = text.find("\n", tail, stop)
            stop = stop if feed < 0 else feed
        out.append(text[at:begin])
        removed.append({"begin": begin, "stop": stop, "kept_in": g["kept_in"], "kept_unit": g["kept_unit"]})
        at = stop
    return "".join([*out, text[at:]]), removed


def without_repeats(docs: DataFrame, by: str = "sentence", least: int = MIN_WORDS) -> DataFrame:
    """doc_id, text, removed (array of begin, stop, kept_in, kept_unit): every document, without what it repeats."""
    scratch = Scratch(docs.sparkSession, "lines")
    gone = scratch.keep(repeated_units(docs, by, least), "gone")
    lists = gone.groupBy("doc_id").agg(F.collect_set(F.struct("first", "last", "kept_in", "kept_unit")).alias("gone"))
    every = texts(docs)
    held = Bitmap(gone.select("doc_id").distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 50):
                some = b.slice(at, 50)
                rows = [cut(x, g, by) if g else (x, []) for x, g in zip(some.column("text").to_pylist(), some.column("gone").to_pylist(), strict=True)]
                yield batch(_CLEAN, doc_id=some.column("doc_id"), text=[x for x, _ in rows], removed=[r for _, r in rows])

    changed = held.split(every).join(lists, "doc_id", "left").mapInArrow(run, f"doc_id long, text string, removed {_SPANS}")
    as_they_are = held.split(every, False).withColumn("removed", F.array().cast(_SPANS))
    return changed.union(as_they_are)


_NORMAL = "trim(regexp_replace(translate(lower(part), '" + string.punctuation.replace("'", "''") + "', ''), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))"
#: The same over joins of each document's sentences with themselves; spans as begin-stop, joined by commas.
ORACLE = rf"""
with t as (select doc_id, coalesce(text, '') as text from documents),
l as (select doc_id, list_filter(regexp_extract_all(text, '(?s).*?(?:[.!?]+[ \t\n\x0b\f\r]+|\n|\z)'), lambda x: x <> '') as parts from t where doc_id is not null),
p as (select doc_id, unnest(parts) as part, generate_subscripts(parts, 1) as u from l),
n as (select doc_id, u, part, {_NORMAL} as norm,
      coalesce(sum(length(part)) over (partition by doc_id order by u rows between unbounded preceding and 1 preceding), 0)::bigint as begin from p),
c as (select *, case when norm = '' then 0 else len(string_split(norm, ' ')) end as w from n),
s as (select *, sum(w) over (partition by doc_id order by u) as upto from c),
f as (select a.doc_id, a.u as first, min(b.u) as last from s a join s b on a.doc_id = b.doc_id and b.u >= a.u and b.upto - a.upto + a.w >= {MIN_WORDS} where a.w > 0 group by all
      union
      select b.doc_id, max(a.u) as first, b.u as last from s b join s a on a.doc_id = b.doc_id and a.u <= b.u and b.upto - a.upto + a.w >= {MIN_WORDS} where b.w > 0 group by b.doc_id, b.u),
d as (select f.doc_id, f.first, f.last, md5(string_agg(s.norm, ' ' order by s.u) filter (s.norm <> '')) as digest from f join s on s.doc_id = f.doc_id and s.u between f.first and f.last group by all),
k as (select digest, min(struct_pack(doc_id := doc_id, first := first)) as lo, max(struct_pack(doc_id := doc_id, first := first)) as hi from d group by digest having lo <> hi),
g as (select d.doc_id, d.first, d.last from d join k on k.digest = d.digest where not (d.doc_id = k.lo.doc_id and d.first = k.lo.first)),
o as (select distinct s.doc_id, s.u, s.begin, s.begin + length(s.part) as stop from s join g on s.doc_id = g.doc_id and s.u between g.first and g.last),
r as (select doc_id, min(begin) as begin, max(stop) as stop from (select *, u - row_number() over (partition by doc_id order by u) as run from o) group by doc_id, run),
x as (select r.doc_id, begin, stop, text, substr(text, begin, 1) as before, substr(text, begin + 1, stop - begin) as body from r join t on t.doc_id = r.doc_id),
y as (select doc_id, text, begin, case when begin > 0 and before <> chr(10) and contains(regexp_extract(body, '[ \t\n\x0b\f\r]*$'), chr(10))
        then begin + length(regexp_replace(body, '[ \t\n\x0b\f\r]*$', '')) + position(chr(10) in regexp_extract(body, '[ \t\n\x0b\f\r]*$')) - 1 else stop end as stop from x),
z as (select doc_id, text, begin, stop, lag(stop, 1, 0) over (partition by doc_id order by begin) as before, row_number() over (partition by doc_id order by begin desc) as back from y),
m as (select doc_id, string_agg(substr(text, before + 1, begin - before) || case when back = 1 then substr(text, stop + 1) else '' end, '' order by begin) as text,
      string_agg(begin || '-' || stop, ',' order by begin) as removed, count(*)::bigint as n_removed from z group by doc_id)
select t.doc_id, coalesce(m.text, t.text) as text, coalesce(m.n_removed, 0)::bigint as n_removed, coalesce(m.removed, '') as removed from t left join m on m.doc_id = t.doc_id"""
