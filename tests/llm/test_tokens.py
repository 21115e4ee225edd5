import zlib

import numpy as np
import pytest
from helpers import ROWS, clashing, docs, table
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import packing, sstable
from loomgraph.llm.tokens import encoder, vocabulary

FILES = (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True))


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    t.encode_special_tokens = True
    return lambda text: np.array(t.encode(text or "", add_special_tokens=False).ids, "<u4")


@pytest.mark.parametrize("name,words", FILES)
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab C'st., \n\t|\0İΣé́🙂日 "), st.characters(codec="utf-8")), max_size=30), max_size=8))
def test_same_ids_as_the_library(name, words, texts):
    lib = library(name)
    assert encoder(vocabulary(name), words)(texts) == [lib(t).tobytes() for t in texts]


def test_encoder_forgets_and_stays_right(monkeypatch):
    from loomgraph.llm import tokens

    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    e, lib = tokens.Encoder(vocabulary("byte_bpe_50k.json"), False), library("byte_bpe_50k.json")
    for _ in range(3):
        for t in ("one two three four five", "five six seven", "two  blanks\n\nlines"):
            assert e([t]) == [lib(t).tobytes()]


def test_tables_against_the_library(spark, tmp_path):
    path, lib = table(spark, tmp_path, documents=clashing(docs(spark))), library("byte_bpe_50k.json")
    got = sorted(map(tuple, sstable.op2_sstable(spark, path).collect()), key=lambda r: r[1])
    start, want = 0, []
    for doc_id, text, *_ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.append(lib(text), 0).astype("<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_tables_of_nothing(spark, tmp_path):
    assert sstable.op2_sstable(spark, table(spark, tmp_path, documents=docs(spark, []))).collect() == []


def test_lookup(spark, tmp_path):
    rows = [(i * 3, f"text number {i} " * (1 + i % 40), "en", "s", 0) for i in range(2000)] + [(6, "again", "en", "s", 0)]
    sstable.write_tables(docs(spark, rows), f"{tmp_path}/t", vocabulary("byte_bpe_50k.json"), shards=3)
    files = [r["content"] for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{tmp_path}/t").collect()]
    readers, lib = [sstable.TableReader(f) for f in files], library("byte_bpe_50k.json")
    assert sum(r.entries for r in readers) == len(rows) and any(len(r.blocks) > 1 for r in readers)
    found = lambda key: [ids for r in readers for ids in r.get(sstable.key_of(key))]
    for i in (0, 1, 57, 1999):
        assert any(np.array_equal(x, np.append(lib(rows[i][1]), 0)) for x in found(rows[i][0]))
    assert len(found(6)) == 2 and found(1) == [] and found(None) == []
    assert sum(r.may_hold(sstable.key_of(k)) for r in readers for k in range(100_001, 101_001)) < 100


def test_damage_is_noticed(spark, tmp_path):
    w = sstable.TableWriter(0, 2)
    data = b"".join(s + b"\n" for part in (w.add(sstable.key_of(4), np.arange(9)), w.finish()) for s in part)
    assert [list(v) for _, v in sstable.TableReader(data)] == [list(range(9))]
    with pytest.raises(ValueError):
        list(sstable.TableReader(data[:5] + bytes([data[5] ^ 1]) + data[6:]))
    with pytest.raises(ValueError):
        sstable.TableReader(data[:-3] + b"??\n")


@settings(max_examples=60, deadline=None)
@given(lengths=st.lists(st.integers(1, 64), max_size=120))
def test_bins_hold_every_piece_once(lengths):
    counts = np.bincount(lengths, minlength=65) if lengths else np.zeros(65, int)
    plan = packing.bins(counts)
    held = np.zeros(65, int)
    for repeats, content in plan:
        assert sum(content) <= 64
        for n in content:
            held[n] += repeats
    assert (held == counts).all()


def test_two_fit_improves_on_greedy():
    counts = np.zeros(101, int)
    for n in (51, 30, 25, 24):
        counts[n] += 1
    assert packing.bins(counts)[0] == (1, [51, 25, 24])


def test_packing_against_the_library(spark, tmp_path):
    path, lib = table(spark, tmp_path, documents=clashing(docs(spark))), library("word_bpe_49k.json")
    got = packing.op9_packing(spark, path).collect()
    texts = {}
    for doc_id, text, *_ in ROWS:
        ids = np.append(lib(text), 0).astype("<u4")
        for piece, start in enumerate(range(0, len(ids), 2048)):
            own = ids[start : start + 2048]
            texts.setdefault((doc_id, piece, start, len(own), zlib.crc32(own.tobytes())), []).append(1)
    assert sorted([r[:5] for r in map(tuple, got)], key=repr) == sorted([k for k, v in texts.items() for _ in v], key=repr)
    ends = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 2048 and len(ends) == -(-sum(r["length"] for r in got) // 2048)


def test_packing_of_nothing(spark, tmp_path):
    assert packing.op9_packing(spark, table(spark, tmp_path, documents=docs(spark, []))).collect() == []


def test_wide_ids(spark):
    """Ids that don't fit are refused; with four bytes they come back as they were."""
    with pytest.raises(ValueError):
        list(sstable.TableWriter(0, 2).add(sstable.key_of(1), np.array([70_000], "<u4")))
    w = sstable.TableWriter(0, 4)
    data = b"".join(s + b"\n" for s in [*w.add(sstable.key_of(1), np.array([70_000, 3], "<u4")), *w.finish()])
    assert [list(map(int, ids)) for ids in sstable.TableReader(data).get(sstable.key_of(1))] == [[70_000, 3]]
