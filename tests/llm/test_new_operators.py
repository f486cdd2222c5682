"""Packing, conversation repair and the as-of join, against brute force and on odd tables."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dispatchgrid.llm import asof, packing, repair
from dispatchgrid.llm import queries as Q
from dispatchgrid.llm.common import table
from tests.conftest import DATA

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)

TEXTS = [
    None, "", " \n\t ", "It's here, isn't it? Yes. No,no. 3,4.", "Straße ÀÉÎ éa éa İstanbul ΣΑΣ ǅ", "a b c\x1cd\x85e", "x\x02y \x02 z", "<|endoftext|>a <|STARTOFTEXT|> b<|startoftext|>,",
    "漢字かな 🙂🙂 \U0001d54f ‍", "a. b, c.\nd.", "word" * 3000, "the cat. " * 3000, "\x00 \x7f", "'s 't 're'll", "end.", "end,",
]


def expected(docs, size):
    out = defaultdict(list)
    for i, text in docs:
        ids = np.array(LIB.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        for k, at in enumerate(range(0, len(ids), size)):
            out[i, k].append((at, len(ids[at : at + size]), zlib.crc32(ids[at : at + size].tobytes())))
    return {k: sorted(v) for k, v in out.items()}


def check_packing(rows, docs, size):
    got, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r["doc_id"], r["piece"]].append((r["start"], r["length"], r["ids_crc32"]))
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {k: sorted(v) for k, v in got.items()} == expected(docs, size)
    for own in seqs.values():
        own.sort()
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1].tolist()] and sum(n for _, n in own) <= size
    return len(seqs), -(-sum(r["length"] for r in rows) // size)


@pytest.mark.parametrize("size,bins", [(4096, 256), (64, 4), (7, 2)])
def test_packing_of_odd_texts(spark, size, bins):
    docs = [*enumerate(TEXTS), (3, TEXTS[3]), (None, "no id"), (None, None)]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, piece int, offset string").repartition(3)
    check_packing(packing.pack(frame, PATH, size, bins).collect(), docs, size)


def test_packing_of_a_table(spark):
    docs = [tuple(r) for r in table(spark, DATA, "documents").select("doc_id", "text").collect()]
    n, bound = check_packing(Q.op11_best_fit_packing(spark, DATA).collect(), docs, 4096)
    assert n <= bound + 2
    whole = packing.sequences(table(spark, DATA, "documents"), PATH).collect()
    assert len(whole) == n and all(len(r["ids"]) == 4 * sum(r["lengths"]) for r in whole)
    one = next(r for r in whole if len(r["doc_ids"]) > 1 and r["lengths"][0] < 4096)
    ids = LIB.encode(dict(docs)[one["doc_ids"][0]] or "", add_special_tokens=False).ids + [1]
    cut = np.frombuffer(one["ids"], "<u4")[: one["lengths"][0]].tolist()
    assert cut in [ids[at : at + 4096] for at in range(0, len(ids), 4096)]


def test_no_documents_no_sequences(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_best_fit_by_search():
    """The bitset finds the same bin as a search of all of them, and closes the fullest."""
    rng = random.Random(5)
    bins, plain = packing.OpenBins(50, 5), []
    for i in range(3000):
        n = rng.randint(1, 50)
        fits = [b for b in plain if b[0] >= n]
        bins.put(i, n)
        if fits:
            own = min(fits, key=lambda b: b[0])
        else:
            if len(plain) == 5:
                plain.remove(min(plain, key=lambda b: b[0]))
            own = [50]
            plain.append(own)
        own[0] -= n
        plain = [b for b in plain if b[0]]
        assert sorted(b[0] for b in plain) == sorted(f for f, s in bins.free.items() for _ in s)
    assert sorted(x for own in bins.closed + bins.rest() for x, _ in own) == list(range(3000))


def brute_repair(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = re.sub("[\\x20\\x09-\\x0D]+\\Z", "", text)
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, labels, i, last, out = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            break
        if (i, last) in done:
            continue
        done.add((i, last))
        may = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        for x, name in (("u", "user"), ("a", "assistant")):
            if x in may:
                heapq.heappush(heap, (cost + 3, labels + "I", i, x, (*out, name + ":")))
        if i < len(rows):
            heapq.heappush(heap, (cost + 4, labels + "D", i + 1, last, out))
            if faults[i] not in ("b", "d"):
                more, x = 3 * (faults[i] == "t"), rows[i][1][:1]
                if x and x in may:
                    heapq.heappush(heap, (cost + more, labels + "K", i + 1, x, (*out, f"{rows[i][1]}:{rows[i][2]}")))
                for x, name in (("u", "user"), ("a", "assistant")):
                    if x in may:
                        heapq.heappush(heap, (cost + 3 + more, labels + "R", i + 1, x, (*out, f"{name}:{rows[i][2]}")))
    return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, labels, hashlib.sha256("\n".join(out).encode()).hexdigest())


def brute_damage(rows):
    out, part = {}, lambda v: " " if v is None else str(v)
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        h = zlib.crc32(f"{part(conv)}:{part(turn)}".encode()) % 20
        role, text = part(role), part(text)
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        if h:
            own += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return {k: brute_repair(v) for k, v in out.items()}


def odd_conversations(seed, n=400):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    texts = ["Yes.", "No!", "Why?", "cut", " \t", "", None, "Done. \n", "é.\x0b", "x" * 20000 + "."]
    return [(rng.choice([None, 1, 2, 3, *range(4, 40)]), rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("seed,parts", [(1, 4), (2, 37)])
def test_repair(spark, seed, parts):
    """Many partitions: conversations reach over edges, so matrices are multiplied."""
    rows = odd_conversations(seed)
    frame = spark.createDataFrame([(*r, 9, "k") for r in rows], "conv_id long, turn long, role string, text string, cost int, key string").repartition(3)
    held = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        report = repair.Repair(repair.damaged(frame)).report(frame)
        got = {r["conv_id"]: (*r[1:],) for r in report.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held[1])
    assert got == brute_damage(rows)


def test_repair_of_a_table(spark):
    rows = [tuple(r) for r in table(spark, DATA, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: (*r[1:],) for r in Q.op12_conversation_repair(spark, DATA).collect()}
    assert got == brute_damage(rows)


def test_repaired_turns_obey_the_grammar(spark):
    rows = odd_conversations(7)
    fixed = repair.Repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    by = defaultdict(list)
    for r in fixed.turns().collect():
        by[r["conv_id"]].append((r["place"], r["role"][:1], r["edit"]))
    for own in by.values():
        assert re.fullmatch("(s?(ua)+)?", "".join(x for _, x, _ in sorted(own)))
    audits = {r["key"]: r["audit"].replace("D", "") for r in fixed.audits.collect()}
    assert {k: "".join(e for _, _, e in sorted(v)) for k, v in by.items()} == {k: v for k, v in audits.items() if v}


def test_matrices_multiply_to_the_whole():
    rng = random.Random(3)
    for _ in range(300):
        turns = [repair.Turn(rng.choice("suat "), rng.random() < 0.2, rng.random() < 0.2) for _ in range(rng.randint(1, 9))]
        cut = rng.randint(0, len(turns))
        costs, labels = repair.product(repair.matrix(turns[:cut]), repair.matrix(turns[cut:]))
        assert (costs, labels) == repair.matrix(turns)
        assert min((costs[t], labels[t]) for t in repair.FINAL if costs[t] < repair.NONE) == repair.solve(turns)


def test_no_conversations(spark):
    rows = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.Repair(repair.damaged(rows)).report(rows).count() == 0


def brute_asof(clicks, sales, tolerance=72 * 3600 * 10**6):
    hashed = lambda v: None if v is None else zlib.crc32(str(v).encode())
    micros = lambda t: None if t is None else (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    floor = lambda t, h: t if t is None or h is None or h % 2 == 0 else t - t % asof.DAY_US
    orders = []
    for sale, client, total, sold, priority in sales:
        h = hashed(sale)
        own = (client, floor(micros(sold), h), priority, sale, None if total is None else int(np.floor(100 * total + 0.5)))
        orders.append(own)
        if h is not None and h % 3:
            orders.append((client, own[1], None if priority is None else 6 - priority, -1 - sale, own[4]))
    out = []
    for click, ts, client in set(clicks):
        t = floor(micros(ts), hashed(click))
        near = [o for o in orders if client is not None and t is not None and o[0] == client and o[1] is not None and t - tolerance <= o[1] <= t]
        if near:
            tied = [o for o in near if o[1] == max(o[1] for o in near)]
            best = min(tied, key=lambda o: (o[2] is None, -(o[2] or 0), o[3] is None, o[3] or 0))
            out.append((click, client, t, best[3], t - best[1], best[4], len(tied)))
        else:
            out.append((click, client, t, None, None, None, 0))
    return sorted(out, key=str)


def test_asof_on_odd_tables(spark):
    rng = random.Random(11)
    start = datetime(2024, 2, 27)
    when = lambda: rng.choice([None, start, *(start + timedelta(seconds=rng.randint(0, 9 * 86400), microseconds=rng.choice([0, 1, 999999])) for _ in range(6))])
    clicks = [(i, when(), rng.choice([None, 1, 1, 1, 2, 3])) for i in range(300)]
    clicks += clicks[:40] + [(None, when(), 1) for _ in range(5)]
    sales = [(rng.choice([None, i, i, i, i]), rng.choice([None, 1, 1, 2]), rng.choice([None, 1.005, 2.5, 0.0, 99.99]), when(), rng.choice([None, 1, 3, 5])) for i in range(200)]
    sales += sales[:20]
    c = spark.createDataFrame([(*r, "x") for r in clicks], "click_id long, ts timestamp_ntz, client_id long, sale_id string").repartition(3)
    s = spark.createDataFrame([(*r, 1) for r in sales], "sale_id long, client_id long, total double, sold_at timestamp_ntz, priority int, click_id int").repartition(3)
    got = asof.match_clicks(c, s).select("click_id", "client_id", "ts_us", "sale_id", "lag_us", "total_cents", "n_tied").collect()
    assert sorted(map(tuple, got), key=str) == brute_asof(clicks, sales)
    none = asof.match_clicks(c, s.limit(0)).where(F.col("n_tied") > 0).count()
    assert none == 0 and asof.match_clicks(c.limit(0), s).count() == 0


def test_asof_sql_on_a_table(spark):
    c = duckdb.connect()
    for name in ("clicks", "sales"):
        c.execute(f"create view {name} as select * from read_parquet('{DATA}/{name}.parquet')")
    found = c.execute(asof.ORACLE)
    names = [d[0] for d in found.description]
    got = Q.op13_tolerant_asof(spark, DATA).select(*names).collect()
    assert sorted(map(tuple, got), key=str) == sorted(found.fetchall(), key=str)
