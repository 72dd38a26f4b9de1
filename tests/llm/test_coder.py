"""Token ids in coded files: exact round trips, damage, and the file's order."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from rows import documents, odd_documents

from sparkloom.llm.coder import BLOCK, MAGIC, decode_blocks, encode_blocks, read_file, round_trip, write_documents, write_file, write_ids
from sparkloom.llm.tokens import BatchEncoder, Encoder, tokenizer_path


def plain_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 50_256), st.integers(0, 3)), max_size=120), max_size=6))
def test_blocks_come_back(blocks):
    arrays = [np.array(b, np.uint32) for b in blocks]
    coded = encode_blocks(arrays)
    back = decode_blocks(coded, [len(b) for b in blocks])
    assert [list(map(int, b)) for b in back] == blocks


def test_each_block_stands_alone():
    rng = np.random.default_rng(1)
    blocks = [rng.integers(0, 50_000, n).astype(np.uint32) for n in (500, 3, 0, 900)]
    together = encode_blocks(blocks)
    for b, c in zip(blocks, together):
        (alone,) = encode_blocks([b])
        assert (alone == c).all()


def test_predictable_ids_take_few_bits():
    text = np.tile(np.array([11, 262, 318, 407, 262, 1110, 13], np.uint32), 300)
    (coded,) = encode_blocks([text])
    assert 2 * len(coded) < 0.2 * len(text)  # bytes an id; 4 as they are
    assert (decode_blocks([coded], [len(text)])[0] == text).all()


def test_real_ids_take_clearly_fewer_bits_than_zlib(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(400).collect()]
    ids = np.concatenate([np.array([*x, 0], np.uint32) for x in plain_ids(texts)])
    blocks = [ids[lo : lo + BLOCK] for lo in range(0, len(ids), BLOCK)]
    coded = encode_blocks(blocks)
    assert all((a == b).all() for a, b in zip(decode_blocks(coded, [len(b) for b in blocks]), blocks))
    assert 2 * sum(map(len, coded)) < 0.9 * sum(len(zlib.compress(b.astype("<u2").tobytes(), 9)) for b in blocks)


def test_sections_of_one_file(tmp_path, monkeypatch):
    monkeypatch.setattr("sparkloom.llm.coder.LANES", 2)
    rng = np.random.default_rng(4)
    ids = [rng.zipf(1.3, n).clip(0, 50_000).astype("<u4").tobytes() for n in (3000, 30_000, 1, 0, 9000, 500)]
    path = str(tmp_path / "x.ids")
    assert write_documents(path, zip(range(6), ids)) == (6, sum(map(len, ids)) // 4)
    assert [x for _, x in read_file(path)] == ids


def test_one_doc_id_does_not_stay_in_one_slice(spark):
    rows = [(None, f"text {k % 50}", "xx", "s", 0, "c", 1, 2, 3) for k in range(400)]
    folder, files = write_ids(documents(spark, rows), slice_chars=200)
    assert len(files) > 8 and sum(n for _, n, _ in files) == 400 and max(n for _, n, _ in files) < 100


def test_file_round_trip_and_damage(tmp_path):
    ids = [np.array(x, "<u4").tobytes() for x in ([5, 0], [0], list(range(9000)) + [0], [7, 7, 7, 0])]
    path = str(tmp_path / "x.ids")
    write_file(path, [4, None, 9, 9], ids)
    assert list(read_file(path)) == list(zip([4, None, 9, 9], ids))
    raw = bytearray(open(path, "rb").read())
    raw[-40] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(ValueError, match="damaged"):
        list(read_file(path))


def check(rows, out):
    order = sorted(rows, key=lambda r: r[0])
    want = {}
    lengths, at = defaultdict(list), 0
    for r, ids in zip(order, plain_ids([r[1] for r in order])):
        lengths[r[0]].append((len(ids) + 1, zlib.crc32(np.array([*ids, 0], "<u4").tobytes())))
        want.setdefault(r[0], at)
        at += len(ids) + 1
    got = defaultdict(list)
    for r in sorted(out, key=lambda r: r.start):
        got[r.doc_id].append(r)
    assert set(got) == set(lengths)
    for d, found in got.items():
        assert sorted((r.n_tokens, r.ids_crc32) for r in found) == sorted(lengths[d])
        start = want[d]
        for r in found:
            assert r.start == start
            start += r.n_tokens


def test_odd_documents(spark):
    rows = odd_documents()
    check(rows, round_trip(documents(spark, rows)).collect())


def test_many_slices_keep_the_order(spark):
    rows = odd_documents()
    folder, files = write_ids(documents(spark, rows), slice_chars=3000)
    assert len(files) > 20
    found = [x for number, _, _ in files for x in read_file(f"{folder}/{number:06d}.ids")]
    assert [d for d, _ in found] == sorted(r[0] for r in rows)
    assert [n for _, n, _ in files] == [sum(1 for _ in read_file(f"{folder}/{number:06d}.ids")) for number, _, _ in files]


def test_empty_table(spark):
    assert round_trip(documents(spark, [])).collect() == []


def test_encoder_equals_the_library():
    texts = [r[1] for r in odd_documents()] + ["a  b", " a", "a ", "a \n b", "it's  don't", "<|endoftext|> x <|endoftext|>", "x y z", "1 22 333", "é è　ê", "\ta b\n", "a​ b", "🙂 🙂🙂"]
    got = Encoder.of(tokenizer_path()).encode(texts)
    assert [list(np.frombuffer(g, "<u4")) for g in got] == plain_ids(texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab'sS  1\n\té.,!🙂 　"), max_size=30), max_size=5))
def test_encoder_equals_the_library_on_any_text(texts):
    got = Encoder.of(tokenizer_path()).encode(texts)
    assert [list(np.frombuffer(g, "<u4")) for g in got] == plain_ids(texts)


def test_a_step_takes_ids_of_all_strands(monkeypatch):
    from sparkloom.llm import coder

    steps = []
    predict = coder.Models.predict
    monkeypatch.setattr(coder.Models, "predict", lambda self, width: (steps.append(len(width)), predict(self, width))[1])
    rng = np.random.default_rng(7)
    blocks = [rng.zipf(1.3, BLOCK).clip(0, 50_000).astype(np.uint32) for _ in range(3)]
    coded = encode_blocks(blocks)
    assert len(steps) <= 600 and sum(steps) == 3 * BLOCK  # a step for each id of a block before
    back = decode_blocks(coded, [BLOCK] * 3)
    assert all((a == b).all() for a, b in zip(back, blocks)) and len(steps) <= 1200


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 2**32 - 1), st.lists(st.sampled_from([1, 511, 512, 1023, 1024, 1025, 1537, 2600, 5000]), min_size=1, max_size=5), st.sampled_from([3, 300, 65_534]))
def test_blocks_of_strands_come_back(seed, sizes, most):
    rng = np.random.default_rng(seed)
    blocks = [rng.integers(0, most + 1, n).astype(np.uint32) for n in sizes]
    coded = encode_blocks(blocks)
    assert all((a == b).all() for a, b in zip(decode_blocks(coded, sizes), blocks))
    for b, c in zip(blocks, coded):
        assert (encode_blocks([b])[0] == c).all()


def test_damaged_words_never_pass(tmp_path):
    rng = np.random.default_rng(3)
    path = str(tmp_path / "x.ids")
    write_file(path, [1], [rng.zipf(1.3, 6000).clip(0, 50_000).astype("<u4").tobytes()])
    raw = open(path, "rb").read()
    for at in range(len(MAGIC) + 33 + 12, len(raw) - 1, 97):  # heads of strands and words
        for bit in (1, 128):
            open(path, "wb").write(raw[:at] + bytes([raw[at] ^ bit]) + raw[at + 1 :])
            with pytest.raises(ValueError, match="damaged"):
                list(read_file(path))


def test_real_ids_take_fewer_bits_than_with_small_blocks(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(400).collect()]
    ids = np.concatenate([np.array([*x, 0], np.uint32) for x in plain_ids(texts)])
    coded = encode_blocks([ids[lo : lo + BLOCK] for lo in range(0, len(ids), BLOCK)])
    assert 16 * sum(map(len, coded)) < 8.1 * len(ids)  # 8.14 before on sf0.001


ODD = ["a  b", " a", "a ", "a \n b", "it's  don't", "x it's 'twas o'er rock'n'roll", "<|endoftext|> x <|endoftext|>", "x <|endoftext|>.", "x y z", "1 22 a333 b-4", "é è　ê", "\ta b\n", "a​ b", "🙂 🙂🙂 a🙂b",
       "x end.\nThe next", "x a,b;c a.,;b a\nb a.\n", "x " + "q" * 60 + "." + " y", "x straße. Ωmega, naïve! ſ. aΩ. áb", "x " + "w," * 9000]


def test_batch_encoder_equals_the_library():
    texts = [r[1] for r in odd_documents()] + ODD
    for most in (500_000, 3):
        encoder = BatchEncoder(tokenizer_path())
        encoder.most_pieces = most
        for _ in range(3):
            assert [list(np.frombuffer(g, "<u4")) for g in encoder.encode(texts)] == plain_ids(texts)
        assert len(encoder.pieces) <= most
        assert [list(np.frombuffer(g, "<u4")) for g in encoder.encode(pa.array(["x", *texts, None]).slice(1))] == plain_ids([*texts, None])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abéß'sSΩ1  \n\té.,!🙂 　"), max_size=30), max_size=5))
def test_batch_encoder_equals_the_library_on_any_text(texts):
    assert [list(np.frombuffer(g, "<u4")) for g in BatchEncoder.of(tokenizer_path()).encode(texts)] == plain_ids(texts)


def test_batch_encoder_asks_for_a_stem_once(monkeypatch):
    asked = []
    led = BatchEncoder._led
    monkeypatch.setattr(BatchEncoder, "_led", lambda self, pieces, lead=" ": (asked.extend(pieces), led(self, pieces, lead))[1])
    encoder = BatchEncoder(tokenizer_path())
    encoder.encode(["x hend hend, hend. hend;", "x hend, hend.\nAnd"])
    encoder.encode(["y hend!"])
    assert asked.count("hend") == 1 and not any(x.startswith("hend") and x != "hend" for x in asked)
