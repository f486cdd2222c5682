"""Secret scan: high-recall candidates, and a random forest that removes the false ones.

A candidate is a run of 16 or more of A-Z a-z 0-9 + / = _ - with a digit in it, or a value of eight signs or more of any
alphabet that is assigned to a name such as token, secret or password. Its features: length, transitions between character
classes, shares of the classes, distinct characters, what a dictionary covers of it, whether it lies in a path,
and the words and signs beside it. The forest is trained on labelled findings: LABELLED rows made by a seeded generator,
half secrets of known formats in the settings where they leak, half look-alikes (numbers, checksums, identifiers, paths,
placeholders). Training is on the driver and bounded by LABELLED; scanning is one narrow pass and no row moves.

Nulls and empty texts: no candidates. Null doc_id: reported with a null id. Repeated rows and findings: each is reported.
Ties: a score of exactly the threshold is a finding. Very long texts: scanned whole. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch, small_batches, texts

LABELLED = 3000
TREES, DEPTH, LEAF = 40, 9, 3
THRESHOLD = 0.5

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/=_-]*[0-9])[A-Za-z0-9+/=_-]{16,}(?![A-Za-z0-9+/_-])")
#: A value assigned to a telling name, quoted or up to the next blank; group 1 is the value.
ASSIGNED = re.compile(r"(?i)(?<![a-z])(?:token|secret|passw(?:or)?d|pwd|passphrase|api_?key|access_?key|private_?key|credentials?)[\"']?\s{0,3}[=:]\s{0,3}(?:\"([^\"\s]{8,})\"|'([^'\s]{8,})'|([^\"'\s]{8,}))")
#: Words that come before a secret, words that come before a look-alike, and words found inside look-alikes.
ASSIGNING = "token secret key apikey api_key access_key secret_key password passwd pwd auth authorization bearer credential credentials private".split()
HARMLESS = "commit sha sha1 sha256 md5 checksum digest hash etag uuid guid id order invoice phone isbn version revision build integrity account number".split()
DICTIONARY = "example test sample demo dummy placeholder changeme your insert image images data file files user users admin static assets index main page home content version release public html http https www com org net src lib bin usr local docs blog post article category product item list view edit update create delete search result session report summary chapter section figure table".split()

_CLASSES = str.maketrans("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/=_-", "a" * 26 + "A" * 26 + "0" * 10 + "." * 5)
_BEFORE = re.compile(r"([A-Za-z_][A-Za-z0-9_]*)\W{0,8}$")
_AFTER = re.compile(r"^\W{0,4}([A-Za-z_]\w*)")
_COVER = re.compile("|".join(sorted(DICTIONARY, key=len, reverse=True)), re.I)
_REACH = 48


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Spans to judge, in order, none inside another: assigned values go before bare runs."""
    spans = {m.span(next(g for g in (1, 2, 3) if m[g] is not None)) for m in ASSIGNED.finditer(text)}
    taken = sorted(spans)
    at = 0
    for m in CANDIDATE.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if at == len(taken) or taken[at][0] >= m.end():
            spans.add(m.span())
    yield from sorted(spans)


def features(text: str, begin: int, stop: int) -> list[float]:
    c = text[begin:stop]
    n = len(c)
    kinds = c.translate(_CLASSES)
    moves = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    left, right = text[max(0, begin - _REACH) : begin], text[stop : stop + _REACH]
    before = m[1].lower() if (m := _BEFORE.search(left)) else ""
    after = m[1].lower() if (m := _AFTER.search(right)) else ""
    return [
        n,
        moves / max(n - 1, 1),
        kinds.count("0") / n,
        kinds.count("a") / n,
        kinds.count("A") / n,
        kinds.count(".") / n,
        len(set(c)) / min(n, 36),
        float(bool(re.fullmatch("[0-9a-f]+|[0-9A-F]+", c))),
        float(kinds == "0" * n),
        sum(len(m[0]) for m in _COVER.finditer(c)) / n,
        c.count("/") / n,
        float(left.endswith(("/", "\\")) or right.startswith((".", "/"))),
        float(any(w in ASSIGNING for w in (before, *before.split("_"))) ),
        float(before in HARMLESS),
        float(after in HARMLESS or after in ASSIGNING),
        float(bool(re.search(r"[=:]\s*[\"']?$", left))),
        float(left[-1:] in ("\"", "'") and right[:1] in ("\"", "'")),
        c.count("-") / n,
        sum(not (x.isalnum() or x in "+/=_-") for x in c) / n,
    ]


class Forest:
    """Bagged trees of Gini splits on random feature subsets, held as flat arrays."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, leaf: int = LEAF, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.trees = [self._grow(x, y, rng.integers(0, len(x), len(x)), depth, leaf, rng) for _ in range(trees)]

    @staticmethod
    def _grow(x, y, rows, depth, leaf, rng) -> tuple[np.ndarray, ...]:
        feature, cut, left, right, share = [], [], [], [], []

        def node(rows, depth) -> int:
            k = len(feature)
            feature.append(-1), cut.append(0.0), left.append(k), right.append(k), share.append(float(y[rows].mean()))
            if depth == 0 or len(rows) < 2 * leaf or share[k] in (0.0, 1.0):
                return k
            best = None
            for f in rng.choice(x.shape[1], max(2, int(x.shape[1] ** 0.5) + 1), replace=False):
                order = rows[np.argsort(x[rows, f], kind="stable")]
                v, t = x[order, f], np.cumsum(y[order])
                n = np.arange(1, len(order))
                ok = (v[1:] > v[:-1]) & (n >= leaf) & (len(order) - n >= leaf)
                if not ok.any():
                    continue
                a, b = t[:-1] / n, (t[-1] - t[:-1]) / (len(order) - n)
                gini = np.where(ok, n * a * (1 - a) + (len(order) - n) * b * (1 - b), np.inf)
                i = int(gini.argmin())
                if best is None or gini[i] < best[0]:
                    best = (gini[i], f, (v[i] + v[i + 1]) / 2)
            if best is not None:
                _, feature[k], cut[k] = best
                low = x[rows, feature[k]] <= cut[k]
                left[k], right[k] = node(rows[low], depth - 1), node(rows[~low], depth - 1)
            return k

        node(rows, depth)
        return np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(share)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, left, right, share in self.trees:
            at = np.zeros(len(x), np.int64)
            while (live := feature[at] >= 0).any():
                f = np.maximum(feature[at], 0)
                go = np.where(x[np.arange(len(x)), f] <= cut[at], left[at], right[at])
                at = np.where(live, go, at)
            total += share[at]
        return total / len(self.trees)


def labelled_findings(rows: int = LABELLED, seed: int = 0) -> list[tuple[str, int, int, int]]:
    """text, begin, stop, is_secret."""
    r = np.random.default_rng(seed)
    pick = lambda values: values[int(r.integers(len(values)))]
    chars = lambda alphabet, n: "".join(alphabet[i] for i in r.integers(0, len(alphabet), n))
    hexa, digit = "0123456789abcdef", "0123456789"
    low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    alnum = low + up + digit
    words = lambda n: " ".join(chars(low, int(r.integers(2, 9))) for _ in range(n))
    real = [
        lambda: chars(hexa, pick([32, 40, 48, 64])),
        lambda: chars(alnum + "+/", pick([40, 44, 64])),
        lambda: pick(["AKIA", "ASIA"]) + chars(up + digit, 16),
        lambda: pick(["ghp_", "gho_", "xoxb-", "sk-", "pk_live_"]) + chars(alnum, pick([24, 36, 48])),
        lambda: "eyJ" + chars(alnum, 33) + "_" + chars(alnum + "-_", 43),
        lambda: chars(alnum, pick([20, 24, 32])),
        lambda: chars(alnum + "!@#$%^&*()?.,;", int(r.integers(8, 15))),
        lambda: chars(low, int(r.integers(3, 7))) + pick("!@#$%&*") + chars(up, 2) + chars(digit + alnum, int(r.integers(3, 6))),
        lambda: chars(low + up, int(r.integers(12, 24))),
    ]
    false = [
        lambda: (chars(digit, pick([16, 17, 18, 20])), pick(["", "number ", "order ", "account ", words(1) + " "])),
        lambda: (chars(hexa, pick([32, 40, 64])), pick(["commit ", "sha ", "md5 ", "checksum: ", "sha256:", "etag: ", "integrity="])),
        lambda: ("-".join(chars(hexa, k) for k in (8, 4, 4, 4, 12)), pick(["uuid ", "id: ", "guid=", words(1) + " "])),
        lambda: ("/".join(pick(DICTIONARY) for _ in range(4)) + chars(digit, 3), pick(["", "/", "path /"])),
        lambda: (pick(["example", "your", "test", "dummy", "changeme"]) + "_" + pick(["key", "token", "secret"]) + "_" + chars(digit, 6), pick(["token = \"", "key: ", ""])),
        lambda: ("x" * int(r.integers(15, 30)) + chars(digit, 1), pick(["token = \"", "key=", ""])),
        lambda: ("-".join(chars(low, int(r.integers(3, 8))) for _ in range(4)) + "-" + chars(digit, 2), pick(["", words(1) + " ", "/"])),
        lambda: (chars(low, int(r.integers(15, 30))) + chars(digit, 1), ""),
        lambda: (pick(["*", "x", ".", "0", "-", "#", "X"]) * int(r.integers(8, 20)), pick(["password = \"", "token: ", "secret=\"", "api_key = '"])),
        lambda: (pick(["<your-password>", "changeme", "password", "${DB_PASSWORD}", "{{secret}}", "%(token)s", "os.environ", "placeholder", "example-token", "your_token_here", "undefined", "required", "config.get('key')"]), pick(["password = \"", "token: ", "secret=\"", "api_key = "])),
        lambda: (pick(DICTIONARY) + pick(["_", "-", "."]) + pick(DICTIONARY), pick(["password: ", "token = \"", "secret = '"])),
    ]
    out = []
    for i in range(rows):
        if i % 2:
            name = pick(["token", "secret", "api_key", "apikey", "password", "access_key", "auth_token", "secret_key", "Authorization: Bearer", "private_key"])
            sign = "" if "Bearer" in name else pick([" = ", "=", ": ", "="])
            quote = pick(["\"", "\"", "'", ""])
            c, before = pick(real)(), f"{words(6)} {name}{sign or ' '}{quote}"
            after = quote + " " + words(4)
        else:
            c, lead = pick(false)()
            quote = lead[-1:] if lead.endswith(("\"", "'")) else ""
            before, after = f"{words(6)} {lead}", quote + pick([" ", ". ", ", "]) + words(4)
        out.append((before + c + after, len(before), len(before) + len(c), i % 2))
    return out


@lru_cache(maxsize=2)
def trained(rows: int = LABELLED, seed: int = 0) -> Forest:
    found = labelled_findings(rows, seed)
    return Forest(np.array([features(t, b, s) for t, b, s, _ in found]), np.array([y for *_, y in found], float), seed=seed)


_FOUND = pa.schema([("doc_id", pa.int64()), ("begin", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())])


def find(docs: DataFrame, forest: Forest | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, begin, stop, score: candidates that the forest holds for secrets, as offsets in code points."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(forest or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, x = [], []
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                for begin, stop in candidates(text):
                    spans.append((i, begin, stop))
                    x.append(features(text, begin, stop))
            if spans:
                score = shared.value.score(np.array(x))
                rows = [(*s, float(p)) for s, p in zip(spans, score, strict=True) if p >= threshold]
                if rows:
                    yield batch(_FOUND, **dict(zip(_FOUND.names, zip(*rows, strict=True), strict=True)))

    return texts(docs).mapInArrow(run, "doc_id long, begin long, stop long, score double")
