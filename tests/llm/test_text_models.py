import hashlib

import pytest
from helpers import LONG, ROWS, clashing, docs, table
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import licenses, sentencepiece_bpe, token_counts
from loomgraph.llm.tokens import vocabulary

MODEL = vocabulary("piece_bpe_32k.model")
TEXT = st.text(alphabet=st.one_of(st.sampled_from("ab tion\n ▁  　.,é🙂日\x00"), st.characters(codec="utf-8")), max_size=40)


@settings(max_examples=300, deadline=None)
@given(text=TEXT)
def test_same_pieces_as_sentencepiece(text):
    c = sentencepiece_bpe.coder(MODEL)
    assert c.encode(text) == c.library.encode(text)


@pytest.mark.parametrize("chunk", ["▁internationalization", "aaaaaaaaaaaaaaaa", "▁thethethethe", "ionionion", "▁" + "xyz" * 20])
def test_table_and_merging_agree(chunk):
    c = sentencepiece_bpe.coder(MODEL)
    assert c.tokens(chunk) == c._merged(chunk)[0]


def test_op6(spark, tmp_path):
    lib = sentencepiece_bpe.coder(MODEL).library
    got = sorted(map(tuple, sentencepiece_bpe.op6_sentencepiece(spark, table(spark, tmp_path, documents=clashing(docs(spark)))).collect()), key=repr)
    want = []
    for doc_id, text, *_ in ROWS:
        ids = lib.encode(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert sentencepiece_bpe.op6_sentencepiece(spark, table(spark, tmp_path, documents=docs(spark, []))).collect() == []


def test_round_trip(spark):
    rows = [r for r in ROWS if r[1]]
    back = sentencepiece_bpe.decode(sentencepiece_bpe.encode(docs(spark, rows), MODEL), MODEL).collect()
    assert sorted((r["text"] for r in back)) == sorted(r[1].replace("▁", " ") for r in rows)


def unigram():
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.Unigram(token_counts.piece_scores(MODEL), unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


def test_same_counts_as_the_library():
    t, c = unigram(), token_counts.counter(MODEL)

    @settings(max_examples=300, deadline=None)
    @given(text=TEXT)
    def check(text):
        assert c.count(text) == len(t.encode(text, add_special_tokens=False).ids)

    check()


def test_op5(spark, tmp_path):
    t = unigram()
    got = sorted(map(tuple, token_counts.op5_token_counts(spark, table(spark, tmp_path, documents=clashing(docs(spark)))).collect()), key=repr)
    assert got == sorted([(i, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, *_ in ROWS], key=repr)
    assert token_counts.op5_token_counts(spark, table(spark, tmp_path, documents=docs(spark, []))).collect() == []


def test_licenses_against_all_templates():
    s = licenses.Scanner(licenses.TEMPLATES, licenses.THRESHOLD)
    lines = ["Nothing here.", "Released under the MIT License.", "released under MIT license", "Some words. Licensed under CC BY-NC 4.0. More words", "Licensed under the Apache License, Version 2.0.\n\nAnd more", LONG, "", "under", "This work is licensed under the GNU General Public License, version 2."]
    lines += [t for ts in licenses.TEMPLATES.values() for t in ts] + ["\n".join(t for ts in licenses.TEMPLATES.values() for t in ts)]
    for text in lines:
        every = [(n, a, b, licenses.dice(licenses.bigrams(text[a:b]), g)) for a, b in licenses.passages(text) for n, g in s.templates]
        kept = []
        for f in sorted([f for f in every if f[3] >= licenses.THRESHOLD], key=lambda f: (-f[3], f[2] - f[1], f[1], f[0])):
            if all(f[2] <= k[1] or f[1] >= k[2] for k in kept):
                kept.append(f)
        assert s.scan(text) == sorted(kept, key=lambda f: f[1])
    assert [f[0] for f in s.scan("See below. This work is licensed under the GNU General Public License, version 2.")] == ["gpl-2.0"]


def test_op4(spark, tmp_path):
    rows = [*ROWS, (20, "x\nReleased under the MIT License.\ny", "en", "a", 1), (None, "Licensed under CC BY-NC 4.0.", "en", "a", 1), (20, "x\nReleased under the MIT License.\ny", "en", "a", 1)]
    got = sorted(map(tuple, licenses.op4_licenses(spark, table(spark, tmp_path, documents=clashing(docs(spark, rows)))).collect()), key=repr)
    assert got == sorted([(20, "mit", 2, 33, 1.0), (20, "mit", 2, 33, 1.0), (None, "cc-by-nc-4.0", 0, 28, 1.0)], key=repr)
    assert licenses.op4_licenses(spark, table(spark, tmp_path, documents=docs(spark, []))).collect() == []


def test_batches_are_bounded(spark):
    from loomgraph.llm import batches

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "10000")
    batches.bounded(docs(spark))
    assert spark.conf.get(key) == str(batches.ROWS)
    spark.conf.set(key, "50")
    batches.bounded(docs(spark))
    assert spark.conf.get(key) == "50"
    spark.conf.unset(key)


def test_notice_amid_other_prose():
    header = " ".join(licenses.TEMPLATES["apache-2.0"][1:])
    prose = "The parts of this package were put together by several people over many years, and each of them keeps what they wrote in their own name."
    own = {"apache-2.0": licenses.TEMPLATES["apache-2.0"], "whole": (header,)}
    for sep in (" ", "\n"):
        text = sep.join(["Copyright 2020 Foo Inc.", prose, header, prose])
        text = text if sep == " " else "\n".join(text.split(" ")[i] + " " + " ".join(text.split(" ")[i + 1 : i + 9]) for i in range(0, len(text.split(" ")), 9))
        got = licenses.Scanner(own, 0.8).scan(text)
        assert [(n, round(s, 6)) for n, _, _, s in got] == [("whole", 1.0)]
        assert text[got[0][1] : got[0][2]].split() == header.rstrip(".").split()
        assert {n for n, *_ in licenses.Scanner(licenses.TEMPLATES, 0.8).scan(text)} == {"apache-2.0"}
    text = "\u0130\u0130 we note that it is licensed\nunder the MIT License as of today"
    (name, a, b, score), = licenses.Scanner(licenses.TEMPLATES, 0.8).scan(text)
    assert (name, text[a:b], score) == ("mit", "licensed\nunder the MIT License", 1.0)


WORD = st.lists(st.sampled_from("a b c d e f".split()), max_size=14)


@settings(max_examples=300, deadline=None)
@given(words=WORD, one=WORD, other=WORD)
def test_windows_against_all_spans(words, one, other):
    """Greedy choice over every run of words, against the heap."""
    own = {"one": (" ".join(one),), "other": (" ".join(other),)}
    s, text = licenses.Scanner(own, 0.8), " ".join(words)
    every = [(-licenses.dice(licenses.bigrams(text[a:b]), g), 0, b - a, a, n, b) for a, b in licenses.passages(text) for n, g in s.templates]
    for k, (n, g) in enumerate(s.templates):
        for i in range(len(words) - 1):
            for j in range(i + 2, min(len(words), i + 1 + int(s.lengths[k] * 1.5 + 1e-9)) + 1):
                if (words[i], words[i + 1]) in g and (words[j - 2], words[j - 1]) in g:
                    every.append((-licenses.dice(licenses.bigrams(" ".join(words[i:j])), g), 1, 1 - 2 * (j - i), 2 * i, n, 2 * j - 1))
    kept = []
    while True:
        free = [f for f in every if f[0] <= -0.8 and all(f[5] <= k[3] or f[3] >= k[5] for k in kept)]
        if not free:
            break
        kept.append(min(free))
    assert s.scan(text) == sorted(((f[4], f[3], f[5], -f[0]) for f in kept), key=lambda f: f[1])


def test_full_texts(spark):
    full = licenses.full_texts()
    assert {"agpl-3.0", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "gpl-2.0", "gpl-3.0", "isc", "lgpl-2.1", "mit", "mpl-2.0"} <= set(full)
    s = licenses.Scanner(licenses.TEMPLATES, licenses.THRESHOLD, full)
    for name, (text,) in full.items():
        found = s.scan(f"Copyright 2020 Foo Inc. All our own work.\n{text}\nThe end of it.")
        assert [(n, score) for n, _, _, score in found] == [(name, 1.0)], name
    two = full["bsd-2-clause"][0]
    opening = two[: two.index("1.")]
    assert [f[0] for f in s.scan(opening)] == ["bsd"]
    rows = [(i, full[n][0], "en", "a", 1) for i, n in enumerate(("gpl-3.0", "agpl-3.0", "bsd-2-clause"))]
    assert sorted((r["doc_id"], r["license"]) for r in licenses.scan(docs(spark, rows)).collect()) == [(0, "gpl-3.0"), (1, "agpl-3.0"), (2, "bsd-2-clause")]


SIBLINGS = {
    "gpl-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
}


def test_siblings_are_told_apart():
    s = licenses.Scanner(licenses.TEMPLATES, licenses.THRESHOLD, licenses.full_texts())
    full = {n: licenses.full_texts()[n][0] for n in ("bsd-2-clause", "bsd-3-clause", "mit", "isc", "bsl-1.0", "gpl-2.0", "gpl-3.0", "agpl-3.0")}
    for name, text in [*SIBLINGS.items(), *full.items()]:
        assert [f[0] for f in s.scan(f"# Some project\n\nWords before it.\n\n{text}\n\nAnd after.")] == [name]


def test_long_runs_of_spaces():
    import time

    coder = sentencepiece_bpe.coder(vocabulary("piece_bpe_32k.model"))
    text = " " * 200_000 + "end  of it"
    began = time.perf_counter()
    ids = coder.encode(text)
    assert time.perf_counter() - began < 5 and ids == coder.library.encode(text)
