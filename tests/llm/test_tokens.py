"""Token ids: exact against the libraries; files and packing round-trip."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import packing, spm, tokenout
from tessera.llm.byte_bpe import ByteBpe
from tessera.llm.common import scratch
from tessera.llm.queries import BYTE_BPE, PIECE_BPE, op3_packing, op4_sentencepiece, op10_tokens, tokenizer_path
from tessera.llm.spm import PieceBpe

ODD = ["", " ", "  ", "a  b", "a\n\nb", "\n", "\n\n\n x", "x\n", " \n a", "\ta\tb  c", "don't it's  ", "日本語 テスト　x", "a<|endoftext|>b", "<s> </s> <0x0A>", "▁▁ a▁b", "😀😀 é", "x" * 3000, "    " * 50, "a\x1cb \x1cc", "..., !!! ---", "123 456  789\r\n\r\n x", "'s 's'll", "\x00\x01", " lead", "trail ", "foo \n bar"]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def byte_bpe():
    return ByteBpe(tokenizer_path(BYTE_BPE))


@pytest.fixture(scope="module")
def piece_bpe():
    return PieceBpe(tokenizer_path(PIECE_BPE), cap=50)


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]


def reference_ids(bpe, text):
    return bpe.whole.encode(text or "", add_special_tokens=False).ids


def test_byte_bpe_is_exact(byte_bpe, texts):
    for t in ODD + texts:
        assert np.frombuffer(byte_bpe.encode(t), "<u4").tolist() == reference_ids(byte_bpe, t)
    assert byte_bpe.encode(None) == b""
    for t in (" " * 5000 + "x", "a" + "\n" * 1999 + "b", "y" * 50_000, "1" * 9000 + " " * 2500, "!?" * 20_000):
        assert np.frombuffer(byte_bpe.encode(t), "<u4").tolist() == reference_ids(byte_bpe, t)


def test_byte_bpe_on_every_kind_of_character(byte_bpe):
    """Both expressions put characters into the classes that the library puts them into."""
    import random

    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 997):
        some = [chr(c) for c in points[at : at + 997 : 4]]
        for t in ("".join(f"a{c}b1{c}2!{c}?" for c in some), " ".join(f"a{c}1{c} {c}{c}x  {c}\n" for c in some)):
            assert np.frombuffer(byte_bpe.encode(t), "<u4").tolist() == reference_ids(byte_bpe, t)
    rng = random.Random(1)
    for _ in range(5000):
        t = "".join(rng.choice("ab'strevdlm 1 9\n\t\r \u3000\xa0\x85\x1cé日😀!.") for _ in range(rng.randint(1, 14)))
        assert np.frombuffer(byte_bpe.encode(t), "<u4").tolist() == reference_ids(byte_bpe, t)


def test_piece_bpe_is_exact(piece_bpe, texts):
    for t in ODD + texts[:80]:
        assert piece_bpe.encode(t) == piece_bpe.library.encode(t)
        ids, joined = piece_bpe.encode_joined(t)
        assert joined == ",".join(map(str, ids))


def test_compatibility_is_what_merging_gives(piece_bpe):
    import random

    random.seed(5)
    keys = list(piece_bpe.right_edge)
    for _ in range(5000):
        a, b = random.choice(keys), random.choice(keys)
        assert piece_bpe._compatible((a, b)) == (piece_bpe.merge(a + b) == [a, b])
    for s in ("aaaaabaaab", "thethethe", "naïveté", "▁unbelievably"):
        assert piece_bpe.backtrack(s) == piece_bpe.merge(s) == piece_bpe._merge_long(s)


def test_op4(spark, odd_docs, no_docs, piece_bpe):
    rows = spm.round_trip(odd_docs, tokenizer_path(PIECE_BPE)).collect()
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    assert len(rows) == 11 and spm.round_trip(no_docs, tokenizer_path(PIECE_BPE)).count() == 0
    for r in rows:
        ids = piece_bpe.library.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(piece_bpe.library.decode(ids).encode()).hexdigest()
    back = spm.decode(spm.encode(odd_docs, tokenizer_path(PIECE_BPE)), tokenizer_path(PIECE_BPE)).collect()
    assert {r.doc_id: r.text for r in back} == {k: piece_bpe.library.decode(piece_bpe.library.encode(v)) for k, v in texts.items()}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op4_sentencepiece(spark, SF).collect()
    assert len(rows) == len(texts) == 200
    for r in rows:
        ids = piece_bpe.library.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(piece_bpe.library.decode(ids).encode()).hexdigest()


def check_tokens(rows, docs, bpe, end):
    expected = sorted(((r.doc_id is not None, r.doc_id or 0), reference_ids(bpe, r.text) + [end]) for r in docs)
    at = 0
    own = sorted(rows, key=lambda r: r.start)
    assert [(r.doc_id is not None, r.doc_id or 0) for r in own] == [k for k, _ in expected]
    left = defaultdict(list)
    for k, ids in expected:
        left[k].append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for r in own:
        assert r.start == at
        left[(r.doc_id is not None, r.doc_id or 0)].remove((r.n_tokens, r.ids_crc32))
        at += r.n_tokens


def test_op10(spark, odd_docs, no_docs, byte_bpe):
    path = scratch(spark, "t")
    tokenout.write_tokens(odd_docs.repartition(4), path, tokenizer_path(BYTE_BPE), 2, 50257, part_bytes=2000, shard_bytes=500)
    check_tokens(tokenout.read_tokens(spark, path).collect(), odd_docs.collect(), byte_bpe, 2)
    assert tokenout.read_document(spark, path, 9) == reference_ids(byte_bpe, "日本語 テキスト 😀 naïve café") + [2]
    assert tokenout.read_document(spark, path, 4) is None
    hot = spark.range(600).selectExpr("if(id % 3 = 0, 7, id) as doc_id", "concat('text ', id, repeat(' and more', 50)) as text")
    several = scratch(spark, "t")
    tokenout.write_tokens(hot, several, tokenizer_path(BYTE_BPE), 2, 50257, part_bytes=20_000, shard_bytes=500)
    check_tokens(tokenout.read_tokens(spark, several).collect(), hot.collect(), byte_bpe, 2)
    assert spark.read.parquet(f"{several}/shards").filter("first_doc = 7 and last_doc = 7").select("part").distinct().count() > 2  # a shared id is dealt to several
    shard = spark.read.parquet(f"{path}/shards").first()
    with pytest.raises(ValueError):
        tokenout.Shard(bytes(shard.content), b"another dictionary")
    empty = scratch(spark, "t")
    tokenout.write_tokens(no_docs, empty, tokenizer_path(BYTE_BPE), 2, 50257)
    assert tokenout.read_tokens(spark, empty).count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_tokens(op10_tokens(spark, SF).collect(), docs.collect(), byte_bpe, 2)


def check_packing(rows, docs, bpe, end, capacity):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    texts = defaultdict(list)
    for d in docs:
        texts[d.doc_id].append(np.array(reference_ids(bpe, d.text) + [end], "<u4"))
    assert set(by_doc) == set(texts)
    for k, arrays in texts.items():
        covered = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by_doc[k])
        assert sum(c[1] for c in covered) == sum(map(len, arrays))
        if len(arrays) == 1:
            at = 0
            for start, n, crc, total in covered:
                assert start == at and total == len(arrays[0]) and crc == zlib.crc32(arrays[0][start : start + n].tobytes())
                at += n
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= capacity


def test_op3(spark, odd_docs, no_docs, byte_bpe):
    rows = packing.pack(odd_docs.repartition(3), tokenizer_path(BYTE_BPE), 1, 64).collect()
    check_packing(rows, odd_docs.collect(), byte_bpe, 1, 64)
    assert packing.pack(no_docs, tokenizer_path(BYTE_BPE)).count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = op3_packing(spark, SF).collect()
    check_packing(rows, docs.collect(), byte_bpe, 1, 2048)
    used, sequences = sum(r.length for r in rows), len({r.sequence_id for r in rows})
    assert used / (2048 * sequences) > 0.97
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append(r["class"])
    closed = [b for b in bins.values() if len(set(b)) == 1 and len(b) == b[0]]
    assert len(closed) > 0.8 * len(bins)  # a bin of class k holds k pieces


def test_cut_lengths_and_best_fit():
    for n in range(1, 5000, 7):
        parts = packing.cut_lengths(n, 2048, 1 / 64)
        assert sum(parts) == n
        assert all(2048 // (2048 // p) - p <= 2048 // (2048 // p) / 64 for p in parts)
    place = packing.best_fit([5, 3, 7, 2, 9], 10)
    filled = defaultdict(int)
    for (b, o), n in sorted(zip(place, [5, 3, 7, 2, 9], strict=True), key=lambda x: x[0]):
        assert o == filled[b]
        filled[b] += n
    assert max(filled.values()) <= 10 and len(filled) == 3
