import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from dispatchgrid.llm import bpe, language, licenses, lines, quality, secrets, surrogates, tiling, token_files
from dispatchgrid.llm import queries as Q
from dispatchgrid.llm.common import Scratch, table
from dispatchgrid.llm.token_groups import jaccard_components
from tests.conftest import DATA
from tests.oracle import connect, same

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = " ".join(f"w{i}x" for i in range(60))
ODD = [
    (1, BASE), (2, BASE), (3, BASE.upper()), (4, BASE.replace("w30x", "other")), (5, None), (6, ""), (7, "   \n\t "), (8, "one"), (9, "one"),
    (10, "one two"), (11, "ONE  two"), (12, "a b c a b c a b c a b c"), (13, " ".join(f"v{i % 977}y" for i in range(20000))), (14, "ends with blank "),
    (15, "a b\x1cc d"), (16, "<|endoftext|> in <|endoftext|>text"), (17, "\U0001f600 ́x \x00 \r\n\r\n  z"), (18, "-" * 700 + "a" * 700),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeats, and extra columns with names that clash."""
    rows = [(i, t, "n", 7, "g") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, n string, token int, component_id string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()


def brute_components(docs, k, num, den):
    sets = {i: shingles(t, k) for i, t in docs}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    inverted = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            inverted[x].add(i)
    for i, s in sets.items():
        for j in set().union(*(inverted[x] for x in s)) if s else ():
            both = len(s & sets[j])
            if j < i and den * both >= num * (len(s) + len(sets[j]) - both):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), top(i)) for i, s in sets.items()}


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 80, 100)])
def test_jaccard_components(spark, odd, k, num, den):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(odd, k, num, den).collect()}
    assert got == brute_components(ODD, k, num, den)


def test_jaccard_on_data(spark):
    docs = table(spark, DATA, "documents")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs, 3, 90, 100).collect()}
    assert got == brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], 3, 90, 100)


def test_jaccard_cluster_of_near_copies(spark):
    rng = np.random.default_rng(5)
    docs = []
    for i in range(150):
        w = BASE.split()
        for j in rng.integers(0, 60, int(rng.integers(0, 4))):
            w[j] = f"q{rng.integers(1000)}"
        docs.append((i, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), 3, 90, 100).collect()}
    assert got == brute_components(docs, 3, 90, 100)


def test_jaccard_empty(empty):
    assert jaccard_components(empty).count() == 0


def test_bpe_digests(odd, empty):
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe.round_trip_digests(odd, PATH).collect()}
    for i, t in ODD:
        ids = LIB.encode(t or "", add_special_tokens=False).ids
        text = LIB.decode(ids, skip_special_tokens=False)
        assert got[i] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()), i
    assert bpe.round_trip_digests(empty, PATH).count() == 0


def test_bpe_round_trip_and_stream(odd):
    got = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(odd, PATH), PATH).collect()}
    assert got == {i: t or "" for i, t in ODD}
    b = bpe.load(PATH)
    rng = np.random.default_rng(0)
    for alphabet in ("etaoinshrd", "-=_*#", "ab", "éñü中"):
        data = "".join(rng.choice(list(alphabet), 3000)).encode()
        assert list(b.stream(data[i : i + 7] for i in range(0, len(data), 7))) == b.merge(data)


def test_bpe_segments_of_long_texts():
    b, rng = bpe.load(PATH), np.random.default_rng(8)
    words = [f"w{i}'s" for i in range(500)] + ["é中😀", "-" * 90, "\n", "\t", "", "<|endoftext|>", "a,b.", "\u00a0x"]
    for size in (1, 7, 64, 1000):
        text = " ".join(words[i] for i in rng.integers(0, len(words), 3000))
        assert "".join(bpe.segments(text, size)) == text
        ids = [i for x in bpe.segments(text.replace("<|endoftext|>", "e"), size) for i in b._segment(x)]
        assert ids == LIB.encode(text.replace("<|endoftext|>", "e"), add_special_tokens=False).ids
        assert b.encode(text) == LIB.encode(text, add_special_tokens=False).ids
    assert b.encode(" lead") == LIB.encode(" lead", add_special_tokens=False).ids and b.encode(" ") == LIB.encode(" ", add_special_tokens=False).ids
    long = "word " * 200_000
    assert max(map(len, b.encode_parts(long))) < 70_000


def test_bpe_decodes_any_ids():
    rng = np.random.default_rng(1)
    for _ in range(50):
        ids = rng.integers(0, 50257, 30).tolist()
        assert "".join(bpe.load(PATH).decode(ids, 4)) == LIB.decode(ids, skip_special_tokens=False)


def test_token_files(spark, odd, empty):
    for docs, rows in ((odd, ODD), (empty, [])):
        path = Scratch(spark, "test").path("files")
        token_files.write(docs, path, PATH)
        got = {r["doc_id"]: tuple(r)[1:] for r in token_files.read(spark, path).collect()}
        start = 0
        for i, t in sorted(rows):
            ids = LIB.encode(t or "", add_special_tokens=False).ids + [2]
            assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), i
            start += len(ids)
        assert len(got) == len(rows)


def test_token_files_of_unsorted_and_repeated_ids(spark):
    rng = np.random.default_rng(3)
    docs = [(int(i), f"text {i} of {'many ' * int(rng.integers(0, 30))}words\nand  more\u00a0{i % 3}") for i in rng.permutation(300)]
    docs += [(7, "a second text of one id"), (7, "a second text of one id"), (None, "no id")]
    path = Scratch(spark, "test").path("files")
    token_files.write(spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, chunk int, ids string").repartition(5), path, PATH)
    got = sorted(tuple(r) for r in token_files.read(spark, path).collect())
    assert len(got) == len(docs) - 1 and [r[0] for r in sorted(got, key=lambda r: r[1])] == sorted(i for i, _ in docs if i is not None)
    want = {(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, t in docs if i is not None for x in [LIB.encode(t, add_special_tokens=False).ids + [2]]}
    assert {(r[0], r[2], r[3]) for r in got} == want
    assert all(a[1] + a[2] == b[1] for a, b in zip(sorted(got, key=lambda r: r[1]), sorted(got, key=lambda r: r[1])[1:], strict=False))


def test_pieces_equal_the_library(monkeypatch):
    rng = np.random.default_rng(5)
    alphabet = list("ab'sté中😀 \n.,-!12\t x\x01")
    many = ["".join(rng.choice(alphabet, int(rng.integers(0, 60)))) for _ in range(3000)] + ["", "\n", " ", "<|endoftext|> a", "a\x85b", "don't 've"]
    monkeypatch.setattr(token_files, "PIECES", 500)
    own = token_files._Library(PATH)
    for at in range(0, len(many), 250):
        for text, got in zip(many[at : at + 250], own.encode(many[at : at + 250]), strict=True):
            assert np.frombuffer(got, "<u2").tolist() == LIB.encode(text, add_special_tokens=False).ids, text
    assert len(own.keys) <= 500 and list(own.encode([])) == []


def test_blocks_round_trip_and_checksums():
    rng = np.random.default_rng(2)
    for n in (1, 63, 64, 65, token_files.BLOCK + 5, 3 * token_files.BLOCK):
        ids = (rng.zipf(1.3, n) % 50257).astype(np.uint16)
        t = token_files.Tables(np.bincount(ids, minlength=1 << 16))
        blocks = token_files.encode_blocks(ids, t)
        assert (token_files.decode_blocks(blocks, t) == ids).all()
    if blocks[0]["words"]:
        bad = bytes([blocks[0]["words"][0] ^ 1]) + blocks[0]["words"][1:]
        with pytest.raises(ValueError):
            token_files.decode_blocks([blocks[0] | {"words": bad}], t)


def test_quality_counts(odd, empty):
    got = {r["doc_id"]: r for r in quality.quality(odd).collect()}
    for i, t in ODD:
        t = t or ""
        w = WORD.findall(t)
        own = [x for x in t.split("\n") if WORD.search(x)]
        seen = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        covered = {p for j in range(len(w) - 4) if seen[tuple(w[j : j + 5])] > 1 for p in range(j, j + 5)}
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(own) - len(set(own)), len(covered)), i
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
    assert {r["doc_id"] for r in quality.kept_rows(odd).collect()} == {i for i, r in got.items() if r["kept"]}
    assert quality.quality(empty).count() == 0


def test_quality_of_long_runs_of_blanks(spark):
    docs = [(1, "a" + " " * 300_000 + "b " * 10), (2, "\t\n " * 50_000)]
    got = {r["doc_id"]: r["n_words"] for r in quality.quality(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: 11, 2: 0}


def test_licence_units_by_their_distinct_bigrams(spark):
    docs = [(n, "Released under the MIT License. " * n) for n in (1, 2, 25, 30, 3000)] + [(31, " ".join(f"word{i}" for i in range(5000)) + " under the MIT License"), (32, ("Released under the MIT License.\n" + "x y z\n") * 40)]
    frame = spark.createDataFrame([(*d, "a", 1) for d in docs], "doc_id long, text string, low string, norm int").union(spark.createDataFrame([(1, docs[0][1], "b", 2)], "doc_id long, text string, low string, norm int"))
    rows = licenses.scan(frame).collect()
    got = {r["doc_id"]: (r["license"], r["dice"], r["n_matches"]) for r in rows}
    assert len(rows) == len(docs) + 1 and got[1] == ("MIT", 1.0, 1) and got[31] == (None, None, 0) and got[32][::2] == ("MIT", 40)
    assert all(got[n][0] == "MIT" and got[n][1] == 0.888889 for n in (2, 25, 30, 3000))


def test_licenses(spark, empty):
    docs = [(1, "some prose that goes on for a while\nReleased under the MIT License."), (2, "Licensed under the Apache License, Version 2.0."), (3, "no licence here at all"), (4, None), (5, ""), (6, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.")]
    got = {r["doc_id"]: (r["license"], r["n_matches"]) for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", 1), 2: ("Apache-2.0", 1), 3: (None, 0), 4: (None, 0), 5: (None, 0), 6: ("CC-BY-NC-4.0", 2)}
    assert licenses.scan(empty).count() == 0


def test_every_template_finds_itself(spark):
    docs = [(n, x) for n, (_, x) in enumerate(licenses.TEMPLATES)]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {n: i for n, (i, _) in enumerate(licenses.TEMPLATES)}


def test_tiling_catches_reordered_passages(spark, odd, empty):
    item = "the quick brown fox jumps over the lazy dog while seven wizards mix up strange blue potions under a pale moon tonight"
    w = item.split()
    docs = [(1, "before " + item.upper() + " after."), (2, " ".join(w[11:] + ["x"] + w[:11])), (3, " ".join(w[:8])), (4, " ".join(sorted(w))), (5, None), (6, "")]
    bench = spark.createDataFrame([(9, item), (10, "too short"), (11, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["coverage"] for r in tiling.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {(1, 9): 1.0, (2, 9): 1.0}
    assert tiling.contaminated(empty, bench).count() == 0
    assert tiling.contaminated(odd, bench.limit(0)).count() == 0


def test_tiles_equal_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(60):
        a, b = rng.integers(0, 4, 20).astype(np.uint64), rng.integers(0, 4, 40).astype(np.uint64)
        least = 3
        got = tiling.tile(a, b, least)
        ma, mb, want = [0] * 20, [0] * 40, []
        while True:
            best = 0
            found = []
            for p in range(20):
                for q in range(40):
                    n = 0
                    while p + n < 20 and q + n < 40 and a[p + n] == b[q + n] and not ma[p + n] and not mb[q + n]:
                        n += 1
                    if n >= least and n > best:
                        best, found = n, [(p, q)]
                    elif n >= least and n == best:
                        found.append((p, q))
            if not found:
                break
            for p, q in found:
                if not any(ma[p : p + best]) and not any(mb[q : q + best]):
                    ma[p : p + best] = mb[q : q + best] = [1] * best
                    want.append((p, q, best))
        assert got == want


def brute_lines(docs, least):
    """Sentences that go, by comparing every run of sentences that just reaches `least` words with all earlier ones."""
    parts, norm = {}, {}
    for i, text in docs:
        parts[i] = [x for x in re.findall(r"(?s).*?(?:[.!?]+[ \t\n\x0b\f\r]+|\n|\Z)", text or "") if x]
        norm[i] = [re.sub(r"[^\w\s]|_", "", x.lower(), flags=re.A).split() for x in parts[i]]
    seen, gone = set(), {i: set() for i, _ in docs}
    for i, _ in sorted(docs):
        w = norm[i]
        runs = set()
        for a in range(len(w)):
            ends = [b for b in range(a, len(w)) if w[a] and sum(map(len, w[a : b + 1])) >= least]
            starts = [b for b in range(a + 1) if w[a] and sum(map(len, w[b : a + 1])) >= least]
            runs |= {(a, ends[0])} if ends else set()
            runs |= {(starts[-1], a)} if starts else set()
        for a, b in sorted(runs):
            key = tuple(x for y in w[a : b + 1] for x in y)
            if key in seen:
                gone[i] |= set(range(a, b + 1))
            seen.add(key)
    return {i: ["" if k in gone[i] else x for k, x in enumerate(parts[i])] for i, _ in docs}


def test_lines_equal_brute_force(spark, empty):
    rng = np.random.default_rng(7)
    pool = [" ".join(f"w{rng.integers(40)}" for _ in range(rng.integers(1, 9))) for _ in range(30)]
    docs = [(i, "".join(pool[j] + [". ", "\n", ".\n", "! "][rng.integers(4)] for j in rng.integers(0, 30, rng.integers(0, 25)))) for i in range(60)]
    docs += [(60, docs[3][1]), (61, docs[4][1] * 3), (62, None), (63, ""), (64, "\n\n"), (65, "".join(f"long{i % 4000} " for i in range(9000)))]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, gone string, first int").repartition(3)
    for least in (3, 6, 12):
        got = {r["doc_id"]: r for r in lines.without_repeats(frame, least=least).collect()}
        want = brute_lines(docs, least)
        for i, text in docs:
            text = text or ""
            assert got[i]["text"].split() == "".join(want[i]).split(), (least, i)
            gone = [range(x["begin"], x["stop"]) for x in got[i]["removed"]]
            assert "".join(c for k, c in enumerate(text) if not any(k in g for g in gone)) == got[i]["text"]
    assert lines.without_repeats(empty).count() == 0


def test_lines_of_passages_and_headings(spark):
    passage = " ".join(f"Sentence {i} of a passage that many share." for i in range(8))
    docs = [(1, "A heading\nown text here"), (2, f"before it {passage} after it"), (3, f"A heading\nx {passage}\nlast line"), (4, passage.upper()), (None, passage), (5, passage), (5, passage)]
    rows = lines.without_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    got = {r["doc_id"]: r["text"] for r in rows}
    assert len(rows) == len(docs) and got[1] == docs[0][1] and got[2] == docs[1][1] and got[None] == passage
    assert got[3] == "A heading\nx Sentence 0 of a passage that many share. \nlast line" and got[4] == "SENTENCE 0 OF A PASSAGE THAT MANY SHARE. " and got[5] == ""
    assert {x["kept_in"] for r in rows for x in r["removed"]} == {2, 4}


def test_surrogates(spark, empty):
    card, ip, mail = "4111111111111111", "193.195.198.107", "john.smith@mail.example.com"
    docs = [(1, f"Mr. John Smith {mail} +1 (310) 555-4510"), (2, f"{ip} 4111 1111 1111 1111 {card} {mail.upper()}"), (3, None), (4, ""), (5, "order 9870157079875996, 2020"), (None, f"to {ip}."), (2, f"{ip} 4111 1111 1111 1111 {card} {mail.upper()}"), (6, "Mrs Ann Lee met Госпожа Иванова")]
    rows = surrogates.replace_pii(spark.createDataFrame([(*d, "extra") for d in docs], "doc_id long, text string, kind string")).collect()
    assert len(rows) == len(docs)
    got = {r["doc_id"]: r["text"] for r in rows}
    assert got[3] is None and got[4] == "" and got[5] == docs[4][1]
    joined = " ".join(t for t in got.values() if t)
    for x in (card, ip, mail, "John", "4510", "Ann Lee", "Иванова"):
        assert x not in joined
    new_card = re.search(r"\d{16}", got[2])[0]
    assert re.search(r"\d{4} \d{4} \d{4} \d{4}", got[2])[0].replace(" ", "") == new_card and new_card[0] == "4"
    luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(new_card)))
    assert luhn % 10 == 0
    assert got[None][3:-1] in got[2]
    assert re.search(r"\S+@\S+", got[1])[0] == re.search(r"\S+@\S+", got[2])[0]
    assert re.search(r"Mrs (\S+)", got[6])[1] in surrogates.GIVEN["latin", "f"] and re.search("Госпожа [А-Яа-яЁё]+$", got[6])
    assert surrogates.replace_pii(empty).count() == 0


def test_surrogates_stay_distinct(spark):
    docs = [(i, f"Mr {a}{b}") for i, (a, b) in enumerate((x, y) for x in "ABCDEFGHIJ" for y in ("bar", "bel", "bor", "dun", "fal", "gim", "hol", "kes", "lun", "mir"))]
    got = surrogates.replace_pii(spark.createDataFrame([(i, t.replace("Mr ", "Mr ").title()) for i, t in docs], "doc_id long, text string")).collect()
    assert len({r["text"] for r in got}) == len(docs)


def test_language_held_out(spark):
    docs = table(spark, DATA, "documents")
    model = language.fit(docs.where("doc_id % 2 = 0"))
    held = docs.where("doc_id % 2 = 1 and n_chars > 60").collect()
    good = sum(model.langs[int(model.log_likelihood(r["text"]).argmax())] == r["lang"] for r in held)
    assert good >= 0.97 * len(held)
    pages = [(1, "http://a.example.de/x", f'<html lang="de"><p>{"der die das und ist nicht " * 3}</p>'), (2, None, None), (3, "", ""), (4, "not a url", "<p>x"), (None, "http://a.example.de/y", "<p>und der die</p>")]
    out = {r["page_id"]: r for r in language.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), model).collect()}
    assert len(out) == 5 and out[1]["lang"] == "de" and out[None]["host"] == "a.example.de"
    assert language.identify(spark.createDataFrame([], "page_id long, url string, html string"), model).count() == 0
    with pytest.raises(ValueError):
        language.fit(docs.limit(0))


def test_secrets_held_out(spark, odd, empty):
    held = secrets.labelled_findings(600, seed=99)
    forest = secrets.trained()
    score = forest.score(np.array([secrets.features(t, b, s) for t, b, s, _ in held]))
    assert ((score >= secrets.THRESHOLD) == np.array([y for *_, y in held])).mean() > 0.95
    text = 'x token = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2" y 9870157079875996 z'
    got = secrets.find(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).collect()
    assert [(r["doc_id"], text[r["begin"] : r["stop"]]) for r in got] == [(1, "f33e61083db5dbdf4bd2369d2f80176e57f7fda2")]
    assert secrets.find(empty).count() == 0
    found = [(r["doc_id"], r["begin"], r["stop"]) for r in secrets.find(odd).collect()]
    want = {(i, b, s) for i, x in ODD for b, s in secrets.candidates(x or "") if forest.score(np.array([secrets.features(x, b, s)]))[0] >= secrets.THRESHOLD}
    assert set(found) == want and len(found) == len(want)
    real = ["password = 'kT9!vq#2Lz'", "db_password: hR7$wPz2mQ", "secret=\"qWmZkLpTrVbNxY\"", "API_KEY = \"a1b2c3d4e5f6a7b8c9d0\""]
    fake = ["password = '********'", "token: <your-token>", "secret = \"changeme\"", "password = \"${DB_PASSWORD}\"", "the token = short"]
    rows = secrets.find(spark.createDataFrame([(i, f"some words {x} and more") for i, x in enumerate(real + fake)], "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in rows} == set(range(len(real)))


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_same_as_sql(spark, name):
    same(Q.queries()[name](spark, DATA), connect(DATA).execute(Q.oracle_sql()[name]))


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = table(spark, DATA, "documents")
    scratch = Scratch(spark, "test-pipeline")
    for name, stage in P.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = scratch.keep(stage(spark, docs, DATA), name)
        after = {r["doc_id"]: r for r in docs.collect()}
        if name == "ngram_jaccard_join":
            groups = brute_components([(i, r["text"]) for i, r in before.items()], 5, 80, 100)
            assert set(after) == {i for i, (_, root) in groups.items() if root == i}
        if name == "bpe_encoding":
            assert {i: r["ids"] for i, r in after.items()} == {i: LIB.encode(r["text"] or "", add_special_tokens=False).ids for i, r in before.items()}
        else:
            assert set(docs.columns) == set(table(spark, DATA, "documents").columns)
        assert set(after) <= set(before)
