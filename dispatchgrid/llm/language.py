"""Language of web pages by fusing evidence in Bayes' form.

Evidence of a page: the likelihood of its text under hashed byte-trigram models, the language its markup declares, its
address suffix, and a prior for its host. The trigram models are fitted on a bounded, documented sample of labelled
documents (TRAIN_ROWS, those of smallest hashed id), and how much a text's evidence counts on one half held out from the
other. Everything else comes from all pages by grouped aggregation of the
text posteriors: how often each declared value and suffix goes with each language, and host priors smoothed up a hierarchy:
a host's counts are added to KAPPA times its domain's shares, which are smoothed likewise by the corpus's. A page's own
text is taken out of the counts that serve as its prior.

Aggregates are small rows per host, domain, suffix and declared value, combined before their shuffles; adaptive execution
splits the joins back on a host that a third of all pages share.

Nulls and empty texts: a null url, html or attribute is the value ''; a text without trigrams has equal likelihoods, so the
other evidence decides. Null page_id: kept. Repeated rows: each counts. Ties: the language that sorts first. No labelled
documents: ValueError. An empty page table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches

TRAIN_ROWS = 3000
BUCKETS = 1 << 15
KAPPA = 5.0
#: Neighbouring trigrams share bytes, so the log-likelihood counts by a share, and up to some number of trigrams: the pair of
#: these that predicts the languages of held-out labelled documents best.
WEIGHTS, MOST = (0.05, 0.1, 0.2, 0.3, 0.5, 1.0), (50, 100, 200, 400, 800)

_MARK = re.compile(r"<(?:(script|style)\b|(!--))?|&[#\w]+;", re.I)
_ENDS = {"script": re.compile(r"</script\s*>", re.I), "style": re.compile(r"</style\s*>", re.I), "!--": re.compile("-->"), "": re.compile(">")}
_HTML, _LANG = re.compile(r"<html\b", re.I), re.compile(r"\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)


def without_marks(html: str) -> str:
    """Text without scripts, comments, tags and references. One cursor moves on; a kind whose end isn't found once has none
    further on either, so it isn't looked for again."""
    out, at, missing = [], 0, set()
    while m := _MARK.search(html, at):
        stop = m.end() if m[0][0] == "&" else None
        for kind, begin in ((((m[1] or m[2] or "").lower(), m.end()), ("", m.start() + 1)) if stop is None else ()):
            if kind not in missing:
                if end := _ENDS[kind].search(html, begin):
                    stop = end.end()
                    break
                missing.add(kind)
        out.append(html[at : m.start() if stop else m.start() + 1])
        out.append(" " if stop else "")
        at = stop or m.start() + 1
    return "".join(out) + html[at:]


def declared_language(html: str) -> str:
    """The language that the first html tag with one declares, in small letters, or nothing."""
    at = 0
    while m := _HTML.search(html, at):
        stop = html.find(">", m.end())
        if found := _LANG.search(html, m.end(), len(html) if stop < 0 else stop):
            return found[1].lower()
        if stop < 0:
            break
        at = stop
    return ""


def trigrams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of the lower-cased text, digits and ASCII punctuation as blanks."""
    b = np.frombuffer(re.sub(r"[\W\d_]+", " ", text.lower()).encode(), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    return (((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int64)


class TextModel:
    """Log-probabilities of trigram buckets by language."""

    def __init__(self, langs: list[str], counts: np.ndarray, weight: float = 0.3, most: int = 200):
        self.langs, self.weight, self.most = langs, weight, most
        c = counts + 0.5
        self.log = np.log(c / c.sum(axis=1, keepdims=True))

    def mean_log(self, text: str) -> tuple[np.ndarray, int]:
        """The mean log-probability of a trigram by language, and how many there are."""
        g = trigrams(text)
        return (self.log[:, g].mean(axis=1) if len(g) else np.zeros(len(self.langs))), len(g)

    def log_likelihood(self, text: str) -> np.ndarray:
        mean, n = self.mean_log(text)
        return mean * min(n, self.most) * self.weight


def fit(labelled: DataFrame, rows: int = TRAIN_ROWS) -> TextModel:
    """labelled: doc_id, text, lang. The sample is the `rows` rows of smallest hashed doc_id; only it comes to the driver."""
    sample = labelled.where("lang is not null and text is not null").select("text", "lang", F.xxhash64("doc_id").alias("h")).orderBy("h").limit(rows)
    sample = [(r["text"], r["lang"]) for r in sample.toLocalIterator()]
    if not sample:
        raise ValueError("no labelled documents to fit languages on")
    langs = sorted({lang for _, lang in sample})
    place = {lang: i for i, lang in enumerate(langs)}

    def counts(some: list) -> np.ndarray:
        out = np.zeros((len(langs), BUCKETS))
        for text, lang in some:
            out[place[lang]] += np.bincount(trigrams(text), minlength=BUCKETS)
        return out

    return TextModel(langs, counts(sample), *_calibrated(TextModel(langs, counts(sample[::2])), sample[1::2], place))


def _calibrated(model: TextModel, held: list, place: dict[str, int]) -> tuple[float, int]:
    """The weight and number of trigrams under which held-out documents' languages are likeliest; ties to the smaller ones.
    Short parts of long documents count too, as pages may be short."""
    cases = [(*model.mean_log(x), place[lang]) for text, lang in held for x in (text, text[:100], text[:30])]
    if not cases:
        return model.weight, model.most
    mean, n, own = np.array([c[0] for c in cases]), np.array([c[1] for c in cases]), np.array([c[2] for c in cases])
    best = None
    for weight in WEIGHTS:
        for most in MOST:
            logs = mean * (np.minimum(n, most) * weight)[:, None]
            score = float((logs[np.arange(len(own)), own] - np.logaddexp.reduce(logs, axis=1)).sum())
            if best is None or score > best[0] + 1e-9:
                best = score, weight, most
    return best[1:]


_TEXT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("declared", pa.string()), ("ll", pa.list_(pa.float64()))])


def text_evidence(pages: DataFrame, model: TextModel) -> DataFrame:
    """page_id, url, declared, ll: what each page says of itself."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            html = b.column("html").to_pylist()
            declared = [declared_language(x) for x in html]
            ll = [model.log_likelihood(without_marks(x)) for x in html]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(declared), pa.array(ll, pa.list_(pa.float64()))], schema=_TEXT)

    small_batches(pages.sparkSession)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return own.mapInArrow(run, "page_id long, url string, declared string, ll array<double>")


def _posterior(logs: list[Column]) -> list[Column]:
    top = F.greatest(*logs)
    e = [F.exp(x - top) for x in logs]
    total = sum(e[1:], e[0])
    return [x / total for x in e]


def _sums(df: DataFrame, key: str, n: int, prefix: str) -> DataFrame:
    """Sums by a key, dealt out once more so that adaptive execution can split a hot key of the join back."""
    return df.groupBy(key).agg(*(F.sum(f"t{i}").alias(f"{prefix}{i}") for i in range(n))).repartition(key)


def identify(pages: DataFrame, model: TextModel) -> DataFrame:
    """page_id, lang, confidence, text_lang, declared, suffix, host for every page."""
    langs, n = model.langs, len(model.langs)
    scratch = Scratch(pages.sparkSession, "language")
    e = text_evidence(pages, model)
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    e = e.select("page_id", "declared", host.alias("host"), *(F.get("ll", i).alias(f"l{i}") for i in range(n)))
    e = e.withColumn("suffix", F.regexp_extract("host", r"([^.]+)$", 1)).withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1))
    own = _posterior([F.col(f"l{i}") for i in range(n)])
    e = scratch.keep(e.select("*", *(p.alias(f"t{i}") for i, p in enumerate(own))), "evidence")

    total = e.agg(F.count("*").alias("n"), *(F.sum(f"t{i}").alias(f"g{i}") for i in range(n))).first()
    size = max(total["n"], 1)
    base = [((total[f"g{i}"] or 0.0) + 1.0) / (size + n) for i in range(n)]
    joined = e
    for key, prefix in (("host", "h"), ("domain", "d"), ("suffix", "s"), ("declared", "c")):
        joined = joined.join(_sums(e, key, n, prefix), key, "left")

    t, col = [F.col(f"t{i}") for i in range(n)], F.col
    d_total = sum((col(f"d{i}") - t[i] for i in range(1, n)), col("d0") - t[0])
    h_total = sum((col(f"h{i}") - t[i] for i in range(1, n)), col("h0") - t[0])
    logs = []
    for i in range(n):
        domain = (col(f"d{i}") - t[i] + KAPPA * base[i]) / (d_total + KAPPA)
        prior = (col(f"h{i}") - t[i] + KAPPA * domain) / (h_total + KAPPA)
        mass = (total[f"g{i}"] or 0.0) - t[i]
        # P(value | language), with one more pseudo-count spread as the value is spread over all languages.
        given = lambda p: (col(f"{p}{i}") - t[i] + sum((col(f"{p}{j}") - t[j] for j in range(n)), F.lit(1.0)) / size) / (mass + 1.0)  # noqa: E731, B023
        logs.append(col(f"l{i}") + F.log(prior) + F.log(given("c")) + F.log(given("s")))
    post = _posterior([F.coalesce(x, F.lit(-1e9)) for x in logs])
    best = F.greatest(*post)
    lang, text_lang = F.lit(langs[-1]), F.lit(langs[-1])
    text_best = F.greatest(*t)
    for i in reversed(range(n - 1)):
        lang = F.when(col(f"p{i}") == col("best"), F.lit(langs[i])).otherwise(lang)
        text_lang = F.when(t[i] == text_best, F.lit(langs[i])).otherwise(text_lang)
    out = joined.select("*", *(p.alias(f"p{i}") for i, p in enumerate(post)), best.alias("best"))
    return out.select("page_id", lang.alias("lang"), F.round("best", 6).alias("confidence"), text_lang.alias("text_lang"), "declared", "suffix", "host")
