"""Queries that SQL can't express, against plain versions that look at every row of a small table."""

import math
import re
from collections import Counter, defaultdict

import numpy as np

from dispatchgrid.llm import language, secrets, surrogates, tiling
from dispatchgrid.llm import queries as Q
from dispatchgrid.llm.common import table
from tests.conftest import DATA

ODD = [(None, "no id"), (900001, None), (900002, ""), (900003, "long " * 30000)]


#: Marks and the declared language by one plain pattern each, which take long on odd texts only.
SKIP = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[#\w]+;", re.S | re.I)
LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)


def test_secret_scan(spark):
    forest, larger = secrets.trained(), DATA.replace("sf0.001", "sf0.01")  # the smallest table holds no secret
    want = set()
    for i, text in ((r["doc_id"], r["text"] or "") for r in table(spark, larger, "documents").collect()):
        for begin, stop in secrets.candidates(text):
            score = float(forest.score(np.array([secrets.features(text, begin, stop)]))[0])
            if score >= secrets.THRESHOLD:
                want.add((i, begin, stop, round(score, 9)))
    got = [(r["doc_id"], r["begin"], r["stop"], round(r["score"], 9)) for r in Q.op4_secret_scan(spark, larger).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def plain_tiles(a, b, least):
    """Greedy tiling by looking at all pairs of places each time."""
    used_a, used_b, tiles = set(), set(), []
    while True:
        runs = []
        for p in range(len(a)):
            for q in range(len(b)):
                n = 0
                while p + n < len(a) and q + n < len(b) and a[p + n] == b[q + n] and p + n not in used_a and q + n not in used_b:
                    n += 1
                if n >= least:
                    runs.append((-n, p, q))
        if not runs:
            return tiles
        longest = min(runs)[0]
        for n, p, q in sorted(runs):
            if n == longest and not used_a & set(range(p, p - n)) and not used_b & set(range(q, q - n)):
                used_a |= set(range(p, p - n))
                used_b |= set(range(q, q - n))
                tiles.append((p, q, -n))


def test_decontamination(spark):
    rng = np.random.default_rng(11)
    item = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 60, n))
    items = [(i, item(int(rng.integers(4, 30)))) for i in range(12)] + [(50, None), (51, ""), (0, "a second item of one id that is long enough")]
    texts = []
    for i in range(40):
        w = items[int(rng.integers(0, 12))][1].split()
        cut = int(rng.integers(0, len(w)))
        texts.append((i, " ".join([item(int(rng.integers(0, 12))), *w[cut:], item(int(rng.integers(0, 4))), *w[:cut], item(3)])))
    texts += [texts[3], (40, texts[4][1].upper().replace(" ", ", ")), (None, texts[5][1]), (41, None), (42, "")]
    frame = spark.createDataFrame([(*t, 7, "x") for t in texts], "doc_id long, text string, item_id int, coverage string").repartition(3)
    got = Counter((r["doc_id"], r["item_id"], round(r["coverage"], 9), r["tiles"], r["longest"]) for r in tiling.contaminated(frame, spark.createDataFrame(items, "item_id long, text string")).collect())
    words = lambda x: re.sub(r"[^\w\s]|_", "", (x or "").lower(), flags=re.A).split()
    want = Counter()
    for d, text in texts:
        for i, x in items:
            a = words(x)
            tiles = plain_tiles(a, words(text), tiling.MIN_MATCH) if d is not None and len(a) >= tiling.MIN_MATCH else []
            if tiles and sum(n for *_, n in tiles) >= tiling.COVERAGE * len(a):
                want[d, i, round(sum(n for *_, n in tiles) / len(a), 9), len(tiles), max(n for *_, n in tiles)] += 1
    assert got == want and want


def test_language_fusion(spark):
    model = language.fit(table(spark, DATA, "documents"))
    pages = [(r["page_id"], r["url"], r["html"]) for r in table(spark, DATA, "pages").collect()]
    pages += [(None, None, None), (900001, "", ""), (900002, "no address", "<p>x"), *pages[:3], (900003, "http://one.example.fr/", "<html lang=fr>" + "le la les " * 20000)]
    n, langs = len(model.langs), model.langs
    rows = []
    for i, url, html in pages:
        m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", url or "")
        host = m[1].lower() if m else ""
        declared = m[1].lower() if (m := LANG.search(html or "")) else ""
        ll = model.log_likelihood(SKIP.sub(" ", html or ""))
        e = np.exp(ll - ll.max())
        rows.append((i, host, ".".join(host.split(".")[-2:]) if "." in host else "", host.split(".")[-1], declared, ll, e / e.sum()))
    sums = [defaultdict(lambda: np.zeros(n)) for _ in range(4)]
    for _, host, domain, suffix, declared, _, t in rows:
        for s, key in zip(sums, (host, domain, suffix, declared), strict=True):
            s[key] += t
    total = sum(t for *_, t in rows)
    base = (total + 1) / (len(rows) + n)
    want = Counter()
    for i, host, domain, suffix, declared, ll, t in rows:
        h, d, s, c = (x[key] - t for x, key in zip(sums, (host, domain, suffix, declared), strict=True))
        prior = (h + language.KAPPA * (d + language.KAPPA * base) / (d.sum() + language.KAPPA)) / (h.sum() + language.KAPPA)
        given = lambda x, t=t: (x + (x.sum() + 1) / len(rows)) / (total - t + 1)
        logs = ll + np.log(prior) + np.log(given(c)) + np.log(given(s))
        p = np.exp(logs - logs.max())
        want[i, langs[int(p.argmax())], round(float((p / p.sum()).max()), 4), host] += 1
    frame = spark.createDataFrame([(*p, "x", 1.0) for p in pages], "page_id long, url string, html string, lang string, t0 double").repartition(3)
    got = Counter((r["page_id"], r["lang"], round(r["confidence"], 4), r["host"]) for r in language.identify(frame, model).collect())
    close = lambda c: Counter((*k[:2], round(k[2], 2), k[3]) for k in c.elements())
    assert close(got) == close(want) and all(math.isfinite(k[2]) for k in got)


def test_surrogates_of_a_whole_table(spark):
    """Each text is rebuilt from what stands between the matches, and equal entities get equal surrogates, others others."""
    source = table(spark, DATA, "documents").select("doc_id", "text").union(spark.createDataFrame(ODD, "doc_id long, text string"))
    out = surrogates.replace_pii(source).collect()
    before = sorted(((r["doc_id"], r["text"]) for r in source.collect()), key=str)
    assert len(out) == len(before)
    pairs = defaultdict(set)
    after = {r["doc_id"]: (r["text"], r["pii_kinds"]) for r in out}
    for i, text in before:
        new, kinds = after[i]
        if text is None or not kinds:
            assert new == text
            continue
        mails, news = re.findall(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", text), re.findall(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", new)
        assert len(mails) == len(news) == kinds.count("email")
        for a, b in zip(mails, news, strict=True):
            pairs[a.lower()].add(b)
    assert pairs and all(len(v) == 1 for v in pairs.values()) and len({next(iter(v)) for v in pairs.values()}) == len(pairs)
    assert not {next(iter(v)) for v in pairs.values()} & set(pairs)
