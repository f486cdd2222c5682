"""N-gram Jaccard self-join by a token-group matrix.

Documents of equal sets form one class, and the smallest doc_id of a class stands for it. Two sets of Jaccard similarity t
or more share at least l of the first ``n - ceil(t*n) + l`` tokens of each, under any one order of tokens, for the smaller
l of the two. The order takes tokens of rarer hash buckets first, so that passages in many documents come last; l grows
with the set (`share`), so that documents with no more than a passage in common part early. Rows of leading tokens that no
other class has go, then documents left with too few, in turn. The rest are dealt into groups: by the document with which
each shares the most leading tokens, a level of set size, and a salt, about GROUP_SIZE members or GROUP_TOKENS tokens a group however
large the cluster. A group is first opened by itself, with the document it is dealt by beside it, which links most copies.

The matrix has a row for each leading token and group; groups that lie within one component of those links are one column
together. Rows that two columns have in common bound what any member of one can share with any of the other; only pairs
that reach the bound meet, once. There the group's whole token union bounds each query document's overlap, and only groups
that qualify are opened, member by member, exactly. Components of the links that hold give the result.

Nothing is capped: long postings only make more groups. Broadcast are the bucket counts (2**BUCKET_BITS integers) and a
bitmap of candidate ids, both of bounded size; a crowded bitmap only lets more sets through to a join that is exact.

Nulls and empty texts: an empty set, linked with nothing. Null doc_id: dropped, since it cannot be named in the result.
Repeated rows of one doc_id count once, under their smallest set digest. Ties: the smallest doc_id. An empty table gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bitmap, Scratch, batch, small_batches, texts
from .components import components
from .shingles import shingle_set

GROUP_SIZE, GROUP_TOKENS = 64, 1 << 16
BUCKET_BITS = 22
CHUNK = 1 << 14
PRUNINGS = 2

_SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("least", pa.int64()), ("prefix", pa.list_(pa.int64()))])
_COUNTS = pa.schema([("chunk", pa.int32()), ("counts", pa.binary())])
_MEMBERS = pa.schema([("doc_id", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("tokens", pa.binary())])
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def needed(n: int, num: int, den: int) -> int:
    """The least overlap that a set of n can have with one that it links to."""
    return -(-num * n // den)


def share(n: int, num: int, den: int) -> int:
    """How many leading tokens a set of n has beyond those that one shared token would need, and that one."""
    return 1 + n * (den - num) // (5 * den)


def least_shared(n: int, num: int, den: int) -> int:
    """The leading tokens that a set of n shares with any set it links to, the smallest that fits included."""
    return share(needed(n, num, den), num, den)


def digest(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def bucket_counts(docs: DataFrame, k: int) -> np.ndarray:
    """How many shingles of all documents fall into each hash bucket."""
    mask = np.uint64((1 << BUCKET_BITS) - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for b in batches:
            for text in b.column("text").to_pylist():
                s = shingle_set(text, k)
                np.add.at(total, (s & mask).astype(np.int64), 1)
        parts = total.reshape(-1, CHUNK)
        used = np.flatnonzero(parts.any(axis=1))
        yield batch(_COUNTS, chunk=used.tolist(), counts=[zlib.compress(parts[i].astype("<u4").tobytes(), 1) for i in used])

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.uint64)
        for x in t.column("counts"):
            total += np.frombuffer(zlib.decompress(x.as_py()), "<u4")
        return pa.table([t.column("chunk").slice(0, 1), [np.minimum(total, 2**32 - 1).astype("<u4").tobytes()]], schema=_COUNTS)

    out = np.zeros((1 << BUCKET_BITS) // CHUNK * CHUNK, np.uint32).reshape(-1, CHUNK)
    schema = "chunk int, counts binary"
    for r in docs.select("text").mapInArrow(count, schema).groupBy("chunk").applyInArrow(add, schema).toLocalIterator():
        out[r["chunk"]] = np.frombuffer(r["counts"], "<u4")
    return out.reshape(-1)


def set_table(docs: DataFrame, k: int, num: int, den: int, order: np.ndarray) -> DataFrame:
    """Per document: set size, 128-bit digest of the set and its leading tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(order)
    mask = np.uint64((1 << BUCKET_BITS) - 1)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for b in batches:
            n, c1, c2, least, prefix = [], [], [], [], []
            for text in b.column("text").to_pylist():
                s = shingle_set(text, k)
                d = digest(s)
                n.append(len(s))
                c1.append(d[0])
                c2.append(d[1])
                lead = s[np.argsort(order[(s & mask).astype(np.int64)], kind="stable")[: len(s) - needed(len(s), num, den) + share(len(s), num, den)]] if len(s) else s
                least.append(least_shared(len(s), num, den))
                prefix.append(lead.view(np.int64))
            yield batch(_SETS, doc_id=b.column("doc_id"), n=n, c1=c1, c2=c2, least=least, prefix=prefix)

    return docs.mapInArrow(build, "doc_id long, n long, c1 long, c2 long, least long, prefix array<long>")


def member_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """The sets of documents whose id may be among `wanted` (exactly so after a join on doc_id)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 50):
                some = b.slice(at, 50)
                rows = [(i, *digest(s := shingle_set(x, k)), s.tobytes()) for i, x in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist(), strict=True)]
                yield batch(_MEMBERS, **dict(zip(_MEMBERS.names, zip(*rows, strict=True), strict=True)))

    return Bitmap(wanted.select("doc_id")).split(docs).mapInArrow(build, "doc_id long, c1 long, c2 long, tokens binary")


class _Group:
    """One group's column of the matrix: members by size and the union of their tokens."""

    def __init__(self, members: list):
        self.ids = [m["doc_id"] for m in members]
        self.sets = [np.frombuffer(m["tokens"], np.uint64) for m in members]
        self.sizes = np.array([len(s) for s in self.sets])
        self.union = np.unique(np.concatenate(self.sets)) if self.sets else np.zeros(0, np.uint64)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


class _Links:
    """Links found so far in a task, as a forest: a link inside one tree adds nothing to the components."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.top(x), self.top(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _open(q: _Group, i: int, g: _Group, num: int, den: int, links: _Links, start: int = 0) -> Iterator[tuple[int, int]]:
    """Links between member i of q and the members of g, unless the bound on g's union rules them all out."""
    n = len(q.sets[i])
    fits = (g.sizes * den >= num * n) & (num * g.sizes <= den * n)
    fits[:start] = False
    if not fits.any() or _common(q.sets[i], g.union) < needed(n, num, den):
        return
    for j in np.flatnonzero(fits):
        if links.top(q.ids[i]) == links.top(g.ids[j]):
            continue
        both = _common(q.sets[i], g.sets[j])
        if den * both >= num * (n + int(g.sizes[j]) - both) and links.join(q.ids[i], g.ids[j]):
            yield q.ids[i], g.ids[j]


def _edges_within(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for members in b.column("members"):
                g, links = _Group(members.as_py()), _Links()
                for i in range(len(g.ids)):
                    found += _open(g, i, g, num, den, links, i + 1)
            yield batch(_EDGES, a=[x for x, _ in found], b=[y for _, y in found])

    return run


def _edges_between(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for left, right in zip(b.column("members"), b.column("others"), strict=True):
                q, g, links = _Group(left.as_py()), _Group(right.as_py()), _Links()
                for i in range(len(q.ids)):
                    found += _open(q, i, g, num, den, links)
            yield batch(_EDGES, a=[x for x, _ in found], b=[y for _, y in found])

    return run


def _shared(postings: DataFrame) -> DataFrame:
    """Postings of tokens that two or more documents have, with the smallest of them as center. The centers are dealt out once
    more, so that adaptive execution can split a token that very many documents have."""
    held = postings.groupBy("token").agg(F.min("doc_id").alias("center"), F.max("doc_id").alias("last")).where("center <> last").select("token", "center")
    return postings.join(held.repartition("token"), "token")


def _columns(dealt: DataFrame, roots: DataFrame) -> DataFrame:
    """g, root, col: root where a group's members are all of one component, whose groups then form one column together."""
    own = dealt.select("doc_id", "g").join(roots, dealt["doc_id"] == roots["node"], "left").select("g", F.coalesce("root", "doc_id").alias("root"))
    pure = own.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    return pure.select("g", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("root")).withColumn("col", F.when(F.col("root").isNotNull(), F.xxhash64(F.lit("component"), "root")).otherwise(F.col("g")))


def _meeting(rows: DataFrame) -> DataFrame:
    """Pairs of columns (a < b) that have as many tokens in common as any link between their members needs."""
    matrix = rows.groupBy("token", "col").agg(F.min("least").alias("least"), F.min("level").alias("lo"), F.max("level").alias("hi"))
    side = lambda x: matrix.select("token", F.col("col").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("least", "lo", "hi")))
    met = side("a").join(side("b"), "token").where("a < b and lo_a <= hi_b + 1 and lo_b <= hi_a + 1")
    enough = met.groupBy("a", "b").agg(F.count("*").alias("have"), F.min("least_a").alias("least_a"), F.min("least_b").alias("least_b"))
    return enough.where("have >= least_a and have >= least_b").select("a", "b")


def _pairs(rows: DataFrame, columns: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs of groups (a < b) that may hold a link between two components.

    Groups within one component are one column of the matrix, so a cluster of any size meets itself not at all and others
    once; the groups of columns that do meet are then told apart over the tokens of those columns alone."""
    rows = scratch.keep(rows.join(columns.select("g", "col"), "g"), "rows")
    met = scratch.keep(_meeting(rows), "met")
    both = met.union(met.select(F.col("b").alias("a"), F.col("a").alias("b")))
    some = rows.join(both.select(F.col("a").alias("col")).distinct(), "col", "left_semi")
    matrix = some.groupBy("token", "g", "col").agg(F.min("least").alias("least"), F.min("level").alias("level"))
    left = matrix.join(met, matrix["col"] == met["a"]).select("token", F.col("g").alias("ga"), "a", "b", F.col("least").alias("least_a"), F.col("level").alias("lo"))
    right = matrix.select("token", F.col("g").alias("gb"), F.col("col").alias("b"), F.col("least").alias("least_b"), F.col("level").alias("hi"))
    near = left.join(right, ["token", "b"]).where("abs(lo - hi) <= 1").groupBy("ga", "gb").agg(F.count("*").alias("have"), F.min("least_a").alias("la"), F.min("least_b").alias("lb"))
    return scratch.keep(near.where("have >= la and have >= lb").select(F.col("ga").alias("g"), F.col("gb").alias("h")), "pairs")


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id: components of links with den * intersection >= num * union over k-word shingles."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "token-groups")
    docs = texts(docs).where("doc_id is not null")

    sets = scratch.keep(set_table(docs, k, num, den, bucket_counts(docs, k)), "sets")
    own = scratch.keep(sets.groupBy("doc_id").agg(F.min(F.struct("c1", "c2", "n")).alias("s")).select("doc_id", "s.*"), "own")
    classes = scratch.keep(own.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")), "classes")

    lead = sets.join(classes.where("n > 0").select(F.col("rep").alias("doc_id"), "c1", "c2"), ["doc_id", "c1", "c2"], "left_semi")
    shared = _shared(lead.select("doc_id", "least", F.explode("prefix").alias("token")))
    for i in range(PRUNINGS):
        shared = scratch.keep(shared, f"shared-{i}")
        if not i:
            scratch.drop("sets")
        scratch.release()
        enough = shared.groupBy("doc_id").agg(F.count("*").alias("have"), F.max("least").alias("least")).where("have >= least").select("doc_id")
        shared = _shared(shared.drop("center").join(enough, "doc_id", "left_semi"))
    shared = scratch.keep(shared, "shared")
    scratch.release()

    votes = shared.groupBy("doc_id", "center").agg(F.count("*").alias("votes"), F.max("least").alias("least"))
    chosen = votes.groupBy("doc_id").agg(F.max(F.struct("votes", (-F.col("center")).alias("c"))).alias("best"), F.max("least").alias("least"))
    chosen = chosen.select("doc_id", (-F.col("best.c")).alias("center"), (F.col("best.votes") >= F.col("least")).alias("near"))
    chosen = chosen.join(classes.select(F.col("rep").alias("doc_id"), "c1", "c2", "n"), "doc_id")
    sizes = chosen.groupBy("center").agg(F.count("*").alias("size"), F.sum("n").alias("tokens"))
    salt = F.pmod(F.xxhash64("doc_id"), F.greatest(F.floor(F.col("size") / GROUP_SIZE), F.floor(F.col("tokens") / GROUP_TOKENS)) + 1)
    # Sets that link differ in size by the ratio at most, so their levels are equal or next to each other.
    level = F.floor(F.log("n") / math.log(den / num) + 1e-9)
    dealt = chosen.join(sizes, "center").select("doc_id", "c1", "c2", "center", "near", level.alias("level"), F.xxhash64("center", level, salt).alias("g"))
    dealt = scratch.keep(dealt, "dealt")

    # Each group is opened once by itself, with its center beside it: that joins most of a cluster before any groups meet.
    seat = dealt.where("near and center <> doc_id").select("g", F.col("center").alias("doc_id")).distinct()
    seats = dealt.select("g", "doc_id", "c1", "c2").union(seat.join(classes.select(F.col("rep").alias("doc_id"), "c1", "c2"), "doc_id").select("g", "doc_id", "c1", "c2")).distinct()
    members = scratch.keep(member_sets(docs, dealt.select("doc_id"), k).join(seats, ["doc_id", "c1", "c2"]), "members")
    groups = members.groupBy("g").agg(F.collect_list(F.struct("doc_id", "tokens")).alias("members"))
    within = scratch.keep(groups.where(F.size("members") > 1).select("members").mapInArrow(_edges_within(num, den), "a long, b long"), "within")
    roots = components(within, scratch, "star")

    rows = shared.select("token", "doc_id", "least").join(dealt.select("doc_id", "g", "level"), "doc_id").select("token", "g", "level", "least")
    pairs = _pairs(rows, _columns(dealt, roots), scratch)
    scratch.drop("shared", "rows", "met", *(f"shared-{i}" for i in range(PRUNINGS)))
    scratch.release()
    asked = members.join(pairs.select("g").union(pairs.select(F.col("h").alias("g"))).distinct(), "g", "left_semi")
    groups = scratch.keep(asked.groupBy("g").agg(F.collect_list(F.struct("doc_id", "tokens")).alias("members")), "groups")
    scratch.drop("members")
    between = pairs.join(groups, "g").join(groups.select(F.col("g").alias("h"), F.col("members").alias("others")), "h").select("members", "others").mapInArrow(_edges_between(num, den), "a long, b long")
    roots = components(within.union(between), scratch)

    named = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("c1", "c2", F.coalesce("root", "rep").alias("component_id"))
    out = own.join(named, ["c1", "c2"])
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


#: op10 by joining every two texts that share a shingle, and components by the smallest reachable doc_id.
ORACLE = r"""
with recursive t as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') as w from documents where doc_id is not null),
l as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s from t),
g as (select doc_id, unnest(s) as x from l),
p as (select a.doc_id as a, b.doc_id as b, count(*) as shared from g a join g b on a.x = b.x and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
e as (select p.a, p.b from p join l x on x.doc_id = p.a join l y on y.doc_id = p.b where 100 * shared >= 90 * (len(x.s) + len(y.s) - shared)),
d as (select a, b from e union all select b, a from e),
r as (select a as node, b as seen from d union select r.node, d.b from r join d on d.a = r.seen)
select doc_id, len(s)::bigint as n_shingles, least(doc_id, coalesce((select min(seen) from r where r.node = l.doc_id), doc_id))::bigint as component_id from l"""
