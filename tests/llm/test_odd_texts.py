"""One odd text must not stall a task or end a process: worst cases of millions of signs, in time that follows their length."""

import time

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from dispatchgrid.llm import bpe, language, licenses, lines, secrets, surrogates, tiling

N = 10_000_000


def scan(f):
    return lambda x: sum(1 for _ in f(x))


CASES = [
    ("letters and digits", scan(secrets.candidates), "a0"),
    ("names without values", scan(secrets.candidates), "token="),
    ("open quotes", scan(secrets.candidates), "token='"),
    ("dashes", scan(secrets.candidates), "a-"),
    ("full stops", scan(lines.sentences), "."),
    ("blanks", scan(lines.sentences), ". "),
    ("open tags", language.without_marks, "<"),
    ("open comments", language.without_marks, "<!-- "),
    ("open scripts", language.without_marks, "<script "),
    ("open references", language.without_marks, "&a"),
    ("open html tags", language.declared_language, "<html "),
    ("half attributes", language.declared_language, "<html lang "),
]


@pytest.mark.parametrize("what,f,unit", CASES, ids=[c[0] for c in CASES])
def test_linear(what, f, unit):
    def took(n):
        text = unit * (n // len(unit))
        began = time.thread_time()
        f(text)
        return time.thread_time() - began

    small, large = took(N // 10), took(N)
    assert large < 60 and large < 30 * max(small, 0.05), (what, small, large)


def test_marks_by_cases():
    assert language.without_marks("a<b>c</b>&amp;<script x>1<2</script >d<!-- > -->e<f") == "a c   d e<f"
    assert language.declared_language("<html><HTML class=x lang='FR-be'>") == "fr"
    assert language.declared_language("<html lang") == ""


def test_surrogates_of_odd_texts(spark):
    n = N // 10
    odd = ["x@" + "a." * (n // 2), "token=" * (n // 6), "token='" * (n // 7), "+1" * (n // 2), "Mrs " * (n // 4), "1.1." * (n // 4), "AB12 " * (n // 5), "a" * n + "@", "see a.b@c.example.org..."]
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    began = time.time()
    got = dict(surrogates.replace_pii(docs).select("doc_id", F.struct("text", "pii_kinds")).collect())
    assert time.time() - began < 240
    assert all(got[i]["text"] == odd[i] for i in (0, 1, 2, 7))  # no domain, no values, no closing quotes
    assert got[8]["pii_kinds"] == ["email"] and got[8]["text"].endswith("..."), got[8]


def test_given_names_differ_from_real_ones(spark):
    given = surrogates.GIVEN["latin", "f"]
    docs = spark.createDataFrame([(i, f"Mrs {g} Foo{'abcdefghijklmnop'[i]} came.") for i, g in enumerate(given)], "doc_id long, text string")
    out = [r["text"].split()[1] for r in surrogates.replace_pii(docs).collect()]
    assert not set(out) & set(given) and len(set(out)) == len(given)


def test_licence_headers_in_their_usual_layout(spark):
    """Wrapped at 70 signs and behind comment marks, as they stand in files."""
    header = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details."""
    title = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble

  The GNU General Public License is a free, copyleft license for
software and other kinds of works."""
    docs = spark.createDataFrame([(1, header), (2, title), (3, "This program shows the terms of the public."), (None, header)], "doc_id long, text string")
    got = {r["doc_id"]: r["license"] for r in licenses.scan(docs).collect()}
    assert got == {1: "GPL-3.0-or-later", 2: "GPL-3.0", 3: None, None: "GPL-3.0-or-later"}


def test_every_token_comes_out_of_the_stream(spark, monkeypatch):
    """Merging happens inside the transducer only, and what it emits is what the encoding holds."""
    machine, inside, emitted = bpe.Bpe(public_tokenizers.path("byte_bpe_50k.json")), [], []
    stream, merge = bpe.Bpe.stream, bpe.Bpe.merge

    def watched(self, chunks):
        for t in stream(self, chunks):
            emitted.append(t)
            yield t

    monkeypatch.setattr(bpe.Bpe, "stream", watched)
    monkeypatch.setattr(bpe.Bpe, "merge", lambda self, data: inside.append(__import__("sys")._getframe(1).f_code.co_name) or merge(self, data))
    texts = ["The cat sat on the mat. The cat!", "a" * 5000 + " " + "xyz" * 300, "Größe 12 <|endoftext|>\n\n  end"]
    for text in texts:
        emitted.clear()
        machine.words.clear(), machine.memo.clear()
        fresh = machine.encode(text)
        assert set(fresh) - set(machine.special.values()) <= set(emitted)
    assert set(inside) == {"stream"}


def test_hot_seeds_in_tiling():
    """A text of one word over and over against an item of the same word, and against many items of it."""
    bench = tiling.Benchmark([(i, tiling.words_of("so " * n)) for i, n in enumerate((5, 40, 400))])

    def took(n):
        text = tiling.words_of("so " * n)
        began = time.thread_time()
        assert list(bench.find(text, 0.5)) == [(0, 1.0, 1, 5), (1, 1.0, 1, 40), (2, 1.0, 1, 400)]
        return time.thread_time() - began

    small, large = took(100_000), took(1_000_000)
    assert large < 60 and large < 30 * max(small, 0.05), (small, large)
    # Half the item's places have a free place in the text: the tiles take the earlier ones.
    item, text = tiling.words_of("a b c d e " * 4), tiling.words_of("a b c d e x a b c d e y")
    assert tiling.tile(item, text) == [(0, 0, 5), (5, 6, 5)]
