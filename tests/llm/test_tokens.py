from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirespark.llm import packing, token_files, tokens
from quirespark.llm.elias_fano import EliasFano

public = pytest.importorskip("public_tokenizers")
BYTES, WORDS = public.path("byte_bpe_50k.json"), public.path("word_bpe_49k.json")
MARKS = st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "a", " ", "\n", "b c", ".", "<|"]), max_size=12).map("".join)
TEXTS = st.one_of(MARKS, st.text(max_size=80), st.text(alphabet="aB é.,'s\n\t ß中 12<|>", max_size=80))
ODD = [" a  b\n\n\nc ", "x\n", "x\n\n", "\n\nx", "a\n\nb", " 's 't don't  I'll", "<|endoftext|> hi", "a<|endoftext|>b", "x <|startoftext|> y", "<|ENDOFTEXT|>", "Σας ΣΑΣ", "é ́x", "", "   ", "İstanbul ﬁne", "a" * 70 + " " + "b" * 70]


@pytest.fixture(scope="module", params=[(BYTES, True), (BYTES, False), (WORDS, True), (WORDS, False)])
def encoder(request):
    return tokens.TextIds(*request.param)


def test_marks_are_text_or_tokens():
    assert tokens.TextIds(BYTES, False)("a<|endoftext|>").tolist()[-1] == 50256 != tokens.TextIds(BYTES)("a<|endoftext|>").tolist()[-1]


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_same_as_the_library(encoder, data):
    text = data.draw(TEXTS)
    assert encoder(text).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(encoder, text):
    assert encoder(text).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_long_texts_and_full_table(encoder, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 50)
    monkeypatch.setattr(tokens, "RENEWED", 500)
    monkeypatch.setattr(tokens, "CUT", 1000)
    for text in (" ".join(f"word{chr(97 + i % 26)}x{'y' * (i % 9)}," for i in range(3000)), "\tx y" * 2000, "x" * 5000):
        assert encoder(text).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3000), max_size=400), st.integers(0, 2**33))
def test_elias_fano(steps, start):
    values = np.cumsum(np.array([start, *steps]))
    e = EliasFano.frombytes(EliasFano.encode(values).tobytes())
    assert e.values().tolist() == values.tolist()
    for i in {0, len(values) - 1, len(values) // 2, min(64, len(values) - 1)}:
        assert e[i] == values[i] and e.values(i).tolist() == values[i:].tolist()


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(0).integers(1, 2000, 100_000))
    assert len(EliasFano.encode(values).tobytes()) * 8 / len(values) < 2 + np.log2(1000) + 1.5
    assert EliasFano.frombytes(EliasFano.encode(np.array([], int)).tobytes()).values().tolist() == []
    with pytest.raises(ValueError):
        EliasFano.encode(np.array([2, 1]))


ROWS = [(5, "five words are in here"), (2, None), (2, "two"), (None, "none"), (9, ""), (7, "long " * 9000), (7, "long " * 9000)]


def brute(path, rows, end):
    t = tokens.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [(d, [*t.encode(x or "", add_special_tokens=False).ids, end]) for d, x in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("files", [1, 3, None])
def test_round_trip(spark, files):
    docs = spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id long, text string, start string")
    manifest = token_files.write_token_files(docs, BYTES, files=files)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(manifest).collect()))
    ids = brute(BYTES, ROWS, 0)
    assert sorted(((r[1], r[2], r[3]) for r in got), key=repr) == sorted(((d, len(x), crc(x)) for d, x in ids), key=repr)
    assert [r[0] for r in got] == np.cumsum([0, *[r[2] for r in got]])[:-1].tolist()
    order = [-1 if r[1] is None else r[1] for r in got]
    assert order == sorted(order)


def test_blocks_and_single_documents(spark, monkeypatch):
    """Many blocks, stretches and documents by their number; negative and far doc_ids, nulls and repeated ones."""
    for name, n in (("BLOCK", 7), ("SELECT", 3), ("READ", 40)):
        monkeypatch.setattr(token_files, name, n)
    doc_ids = [None] * 9 + [-(2**63), -5, -5, 0, 3, 2**40, 2**63 - 1] * 3
    docs = spark.createDataFrame([(d, "word " * (i % 6)) for i, d in enumerate(doc_ids)], "doc_id long, text string").coalesce(1)
    blocks, total, known = [], 0, sorted(doc_ids, key=lambda d: -(2**64) if d is None else d)
    for i in range(0, len(known), 7):
        ends = np.cumsum([total, *[k % 5 + 1 for k in range(i, min(i + 7, len(known)))]])[1:].tolist()
        blocks.append((token_files.Block(token_files.Block.tobytes(total, known[i : i + 7], ends)), known[i : i + 7], [total, *ends]))
        total = ends[-1]
    for block, ids, bounds in blocks:
        for a in range(block.count):
            for b in range(a + 1, block.count + 1):
                assert block.doc_ids(a, b) == ids[a:b] and block.bounds(a, b).tolist() == bounds[a : b + 1]
    manifest = token_files.write_token_files(docs, BYTES, files=1).first()
    monkeypatch.undo()
    whole = list(token_files.documents_of(manifest.file, manifest.dtype))
    assert [d for d, *_ in whole] == known and len(whole) == manifest.n_docs
    for i in (0, 1, 8, 9, 15, len(whole) - 1):
        d, start, ids = token_files.document(manifest.file, manifest.dtype, i)
        assert (d, start, ids.tolist()) == (whole[i][0], whole[i][1], whole[i][2].tolist())


def test_index_is_small():
    """About a quarter of the 16 bytes that a 64-bit offset and a 64-bit doc_id take."""
    ends = np.cumsum(np.random.default_rng(0).integers(1, 2000, 60_000)).tolist()
    assert len(token_files.Block.tobytes(0, list(range(0, 180_000, 3)), ends)) < 2.6 * 60_000


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.read_token_files(token_files.write_token_files(none, BYTES)).count() == 0
    assert packing.pack(packing.token_pieces(none, WORDS)).count() == 0


def test_packing_against_brute_force(spark):
    docs = spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id long, text string, piece string")
    pieces = packing.token_pieces(docs, WORDS, length=64, end_id=1)
    rows = packing.pack(pieces, length=64, shard=100).collect()
    want = [(d, k, at, x[at : at + 64]) for d, x in brute(WORDS, ROWS, 1) for k, at in enumerate(range(0, len(x), 64))]
    assert sorted(((r.doc_id, r.piece, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in rows), key=repr) == sorted(want, key=repr)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    table = spark.createDataFrame(rows)
    whole = {r.sequence_id: r for r in packing.sequences(table.drop("sequence_id", "offset"), table).collect()}
    assert {k: r.n_tokens for k, r in whole.items()} == {k: sum(x for _, x in v) for k, v in by.items()}
    assert all(len(r.ids) == 4 * r.n_tokens for r in whole.values())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=150))
def test_every_piece_is_placed(lengths):
    x = np.array(lengths, np.int64)
    s, o = packing.pack_shard(x, 100)
    for k in set(s.tolist()):
        order = np.argsort(o[s == k])
        assert (np.cumsum(x[s == k][order]) - x[s == k][order] == o[s == k][order]).all() and x[s == k].sum() <= 100
    assert (s >= 0).all()


@pytest.mark.parametrize("seed", range(3))
def test_packing_is_tight(seed):
    rng = np.random.default_rng(seed)
    x = np.minimum(4096, rng.lognormal(6.5, 0.9, 8000).astype(int) + 1)
    assert packing.pack_shard(x, 4096)[0].max() + 1 <= 1.002 * x.sum() / 4096 + 1


def test_configurations_of_thirds():
    counts = packing.best_configuration(np.array([50, 34]), np.array([0.5, 0.34]), 100)
    assert counts.tolist() == [2, 0]
    plan = packing.configurations(np.array([60, 40]), np.array([10.0, 10.0]), 100)
    assert round(sum(n for _, n in plan), 6) == 10


def test_shards_share_their_emptiest_sequences(spark):
    """Packed in 30 shards, whose part-filled sequences add up unless they are packed together; every piece has one place, sequences are gapless."""
    x = np.minimum(4096, np.random.default_rng(5).lognormal(6.5, 0.9, 6000).astype(int) + 1)
    pieces = spark.createDataFrame([(i, 0, int(n), "x") for i, n in enumerate(x)], "row long, piece int, length long, shard string")
    rows = packing.pack(pieces, shard=200).toPandas()
    assert list(rows.columns) == ["row", "piece", "length", "shard", "sequence_id", "offset"] and sorted(rows["row"]) == list(range(6000))
    for _, own in rows.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert (own["length"].cumsum() - own["length"] == own["offset"]).all() and own["length"].sum() <= 4096
    apart = packing.pack(pieces, shard=200, again=0).select("sequence_id").distinct().count()
    assert -(-x.sum() // 4096) <= rows["sequence_id"].nunique() <= -(-x.sum() // 4096) + 5 < apart - 5


def test_a_sequence_of_many_pieces_stays_closed(spark):
    pieces = spark.createDataFrame([(i, 0, 1) for i in range(1000)], "row long, piece int, length long")
    assert packing.pack(pieces, shard=100).groupBy("sequence_id").count().count() == 10
    assert packing.emptiest(np.array([0, 0, 1, 2]), np.array([1, 1, 1, 5]), 2, 3).tolist() == [True, True, True, False]
