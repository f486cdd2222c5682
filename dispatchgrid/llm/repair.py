"""Repair of conversation structure by weighted finite-state composition.

Three machines are composed: an acceptor of a conversation's turns in order, a transducer of edits (Keep 0, Rerole 3, Delete 4,
Insert 3; an undeleted truncated turn 3 more) and an acceptor of the roles that a repaired conversation may have,
`(s?(ua)+)?` over their initials. The composition is never built: its states are a place between turns and a state of the
grammar, of which there are four, and its arcs follow from the next turn. As places only grow, and an insertion only leads on
within a place, the states are in topological order; one pass from the end gives the least cost to go of each, and a walk from
the start that takes the least label among the arcs on a least path gives the path of least (cost, labels), since a label from a
state leads to one state only.

A long conversation is spread over range partitions. A partition solves the conversations that lie wholly inside it. Of the
first and the last one it gives, for each pair of grammar states, the least (cost, labels) from the one to the other through
its turns; these 4 x 4 matrices of one conversation are multiplied in order. Of two label strings of equal cost through the
same turns neither begins with the other (what follows would be insertions, which cost), so least strings stay least in the
product. The edited turns are then written out, or hashed, in one stream a conversation: a digest of the whole is sequential,
so for that a conversation's turns pass one task one by one, with only its labels in memory.

Nulls: a null role or text is one space, null turns come first, a null conv_id is a conversation of its own. Ties: turns of
equal number come by role, then by a digest of the text. Repeated rows are duplicates. Empty texts are blank. Very long texts
are looked at by built-in functions and hashed once. An empty table gives no rows; a conversation without turns gives zeros, no
labels and the digest of nothing. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batch, small_batches

#: States of the grammar: at the start, after s, after u, after a. What follows by role initial, and the roles that edits give.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
GIVEN = ((2, "user"), (2, "user"), (3, "assistant"), (2, "user"))
FINAL = (0, 3)
STATES, NONE = range(4), 1 << 60
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
_BLANKS = " \t\n\x0b\x0c\r"
_ORDER = ["key", "turn", "role", "digest", "rid"]

_PARTS = pa.schema([("key", pa.string()), ("part", pa.int64()), ("whole", pa.bool_()), ("n", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64()), ("costs", pa.list_(pa.int64())), ("labels", pa.list_(pa.string()))])
_PARTS_SQL = "key string, part long, whole boolean, n long, first string, last string, illegal long, costs array<long>, labels array<string>"
_TURNS = pa.schema([("key", pa.string()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
_TURNS_SQL = "key string, place long, edit string, role string, text string"


@dataclass(frozen=True, slots=True)
class Turn:
    """What the edit transducer asks of a turn."""

    initial: str
    gone: bool  # blank or duplicate: only deletion is open to it
    truncated: bool

    def arcs(self, q: int) -> Iterator[tuple[str, int, int]]:
        """Label, cost and next grammar state of each edit that consumes the turn, in the order of labels."""
        yield "D", DELETE, q
        if not self.gone:
            more = TRUNCATED if self.truncated else 0
            if self.initial in NEXT[q]:
                yield "K", more, NEXT[q][self.initial]
            yield "R", REROLE + more, GIVEN[q][0]


def to_go(turns: list[Turn], end: list[int]) -> list[list[int]]:
    """Least costs from each place and grammar state, given those behind the last turn."""

    def insertions(row: list[int]) -> list[int]:
        # 2 and 3 lead to each other, 0 and 1 to 2: at most two insertions in a line are of use.
        a = [min(row[q], INSERT + row[GIVEN[q][0]]) for q in STATES]
        return [min(row[q], INSERT + a[GIVEN[q][0]]) for q in STATES]

    out = [insertions(end)]
    for t in reversed(turns):
        after = out[-1]
        out.append(insertions([min(c + after[to] for _, c, to in t.arcs(q)) for q in STATES]))
    return out[::-1]


def walk(turns: list[Turn], costs: list[list[int]], end: list[int], q: int) -> str:
    """The least label string on a path of least cost from a grammar state."""
    labels, i = [], 0
    while i < len(turns) or costs[i][q] != end[q]:
        want = costs[i][q]
        arcs = [*(turns[i].arcs(q) if i < len(turns) else ()), ("I", INSERT, GIVEN[q][0])]
        for label, c, to in sorted(arcs):
            if want == c + (costs[i] if label == "I" else costs[i + 1])[to]:
                labels.append(label)
                q, i = to, i + (label != "I")
                break
    return "".join(labels)


def solve(turns: list[Turn]) -> tuple[int, str]:
    end = [0 if q in FINAL else NONE for q in STATES]
    costs = to_go(turns, end)
    return costs[0][0], walk(turns, costs, end, 0)


def matrix(turns: list[Turn]) -> tuple[list[int], list[str | None]]:
    """Least (cost, labels) through the turns from each grammar state to each, row by row."""
    least, labels = [[0] * 4 for _ in STATES], [[None] * 4 for _ in STATES]
    for t in STATES:
        end = [0 if q == t else NONE for q in STATES]
        costs = to_go(turns, end)
        for s in STATES:
            least[s][t] = min(costs[0][s], NONE)
            labels[s][t] = walk(turns, costs, end, s) if costs[0][s] < NONE else None
    return [c for row in least for c in row], [x for row in labels for x in row]


def product(a: tuple, b: tuple) -> tuple:
    out = [min(((a[0][4 * s + m] + b[0][4 * m + t], a[1][4 * s + m] + b[1][4 * m + t]) for m in STATES if a[0][4 * s + m] < NONE and b[0][4 * m + t] < NONE), default=(NONE, None)) for s in STATES for t in STATES]
    return [c for c, _ in out], [x for _, x in out]


def illegal(initials: list[str]) -> int:
    return sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:], strict=False))


def _parts(ordered: DataFrame) -> DataFrame:
    """Conversations of sorted partitions: those inside solved, the first and the last of a partition as matrices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, part, held, first = None, None, [], True

        def give(whole: bool) -> pa.RecordBatch:
            costs, labels = ([x] for x in solve(held)) if whole else matrix(held)
            initials = [t.initial for t in held]
            return batch(_PARTS, key=[key], part=[part], whole=[whole], n=[len(held)], first=[initials[0]], last=[initials[-1]], illegal=[illegal(initials)], costs=[costs], labels=[labels])

        for b in batches:
            for k, p, i, g, t in zip(*(b.column(c).to_pylist() for c in ("key", "part", "initial", "gone", "truncated")), strict=True):
                if held and k != key:
                    yield give(whole=not first)
                    held, first = [], False
                key, part = k, p
                held.append(Turn(i, g, t))
        if held:
            yield give(whole=False)

    return ordered.mapInArrow(run, _PARTS_SQL)


def _multiplied(parts: DataFrame) -> DataFrame:
    """key, cost, audit, illegal of conversations that reach a partition's edge; a row a partition that one touches."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        total, seen, last = None, 0, None
        for r in rows.itertuples():
            own = ([int(c) for c in r.costs], list(r.labels))
            total = own if total is None else product(total, own)
            seen += int(r.illegal) + (0 if last is None else illegal([last, r.first]))
            last = r.last
        cost, audit = min((total[0][t], total[1][t]) for t in FINAL if total[0][t] < NONE)
        return pd.DataFrame({"key": [rows["key"].iloc[0]], "cost": [cost], "audit": [audit], "illegal": [seen]})

    return parts.where("not whole").groupBy("key").applyInPandas(run, "key string, cost long, audit string, illegal long")


def _edited(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """key, place, edit, role, text of each turn that is left, a conversation's turns in order in one partition."""
    labels = audits.select("key", F.lit(0).alias("kind"), F.col("audit").alias("text"))
    turns = rows.select(*_ORDER, F.lit(1).alias("kind"), "text")
    both = labels.unionByName(turns, allowMissingColumns=True).repartition("key").sortWithinPartitions("key", "kind", *_ORDER[1:]).select("key", "kind", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, audit, i, q, place = None, "", 0, 0, 0

        def step(role: str | None, text: str | None) -> Iterator[tuple]:
            """Insertions before the next turn, then that turn if there is one."""
            nonlocal i, q, place
            while i < len(audit):
                label, i = audit[i], i + 1
                if label == "I":
                    made = ("I", GIVEN[q][1], "")
                elif label == "D":
                    return
                else:
                    made = (label, role if label == "K" else GIVEN[q][1], text)
                q = NEXT[q][made[1][:1]]
                place += 1
                yield (key, place, *made)
                if label != "I":
                    return

        for b in batches:
            out = []
            for k, kind, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind == 0:
                    out += step(None, None)
                    key, audit, i, q, place = k, text, 0, 0, 0
                else:
                    out += step(role, text)
            if out:
                yield batch(_TURNS, **dict(zip(_TURNS.names, map(list, zip(*out, strict=True)), strict=True)))
        if out := [*step(None, None)]:
            yield batch(_TURNS, **dict(zip(_TURNS.names, map(list, zip(*out, strict=True)), strict=True)))

    return both.mapInArrow(run, _TURNS_SQL)


class Repair:
    """The faults and cheapest repairs of conversations: `report` has a row each, `turns` the repaired turns."""

    def __init__(self, rows: DataFrame):
        spark = rows.sparkSession
        small_batches(spark)
        scratch = Scratch(spark, "repair")
        text, role = F.coalesce(F.col("text").cast("string"), F.lit(" ")), F.coalesce(F.col("role").cast("string"), F.lit(" "))
        last = F.right(F.rtrim(F.col("text"), F.lit(_BLANKS)), F.lit(1))
        own = rows.select(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("key"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
        own = own.select("*", F.sha2("text", 256).alias("digest"), last.alias("end"), F.monotonically_increasing_id().alias("rid"))
        self.rows = scratch.keep(own, "rows")
        slim = self.rows.select(*_ORDER, F.substring("role", 1, 1).alias("initial"), (F.col("end") == "").alias("blank"), (~F.col("end").isin(".", "!", "?")).alias("unended"))
        # The first of equal turns, found with a combine in each task; the join on row numbers is even whatever repeats.
        seen = slim.groupBy("key", "role", "digest").agg(F.min(F.struct("turn", "rid")).alias("m")).select(F.col("m.rid").alias("rid"), F.lit(True).alias("new"))
        slim = slim.join(seen, "rid", "left").withColumn("duplicate", ~F.col("blank") & F.col("new").isNull())
        slim = slim.select(*_ORDER, "initial", "blank", "duplicate", (~F.col("blank") & ~F.col("duplicate") & F.col("unended")).alias("truncated"))
        self.faults = slim = scratch.keep(slim, "faults")
        ordered = slim.withColumn("gone", F.col("blank") | F.col("duplicate")).repartitionByRange(*[F.col(c).asc_nulls_first() for c in _ORDER]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in _ORDER])
        parts = scratch.keep(_parts(ordered.select("key", F.spark_partition_id().cast("long").alias("part"), "initial", "gone", "truncated")), "parts")
        whole = parts.where("whole").select("key", F.col("costs")[0].alias("cost"), F.col("labels")[0].alias("audit"), "illegal")
        self.audits = scratch.keep(whole.unionByName(_multiplied(parts)), "audits")

    def turns(self) -> DataFrame:
        """conv_id as text (null: one space), place, edit, role, text of the repaired turns."""
        return _edited(self.rows, self.audits).withColumnRenamed("key", "conv_id")

    def digests(self) -> DataFrame:
        """key and the sha256 of the repaired `role:text`, joined by line feeds."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, h = None, None
            for b in batches:
                keys, out = [], []
                for k, role, text in zip(*(b.column(c).to_pylist() for c in ("key", "role", "text")), strict=True):
                    if k != key:
                        if h is not None:
                            keys.append(key)
                            out.append(h.hexdigest())
                        key, h = k, hashlib.sha256()
                    else:
                        h.update(b"\n")
                    h.update(f"{role}:{text}".encode())
                if keys:
                    yield pa.RecordBatch.from_pydict({"key": keys, "repaired_sha256": out})
            if h is not None:
                yield pa.RecordBatch.from_pydict({"key": [key], "repaired_sha256": [h.hexdigest()]})

        return _edited(self.rows, self.audits).mapInArrow(run, "key string, repaired_sha256 string")

    def report(self, convs: DataFrame) -> DataFrame:
        """Counts of faults, cost, labels and digest of each conversation of `convs` (conv_id), with turns or without."""
        counts = self.faults.groupBy("key").agg(
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"),
            *[F.count_if(F.col(c)).alias(c) for c in ("blank", "duplicate", "truncated")],
        )
        all_ = convs.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("key")).distinct()
        out = all_.join(counts, "key", "left").join(self.audits, "key", "left").join(self.digests(), "key", "left")
        zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with planted faults, by a hash of conversation and turn: left out, emptied, without sentence ends, repeated, from the user."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20).cast("int")
    own = rows.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), h.alias("h")).where("h <> 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    return own.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("h") == 3, 2).otherwise(1))).alias("copy")).drop("copy")
