"""Operators 2 and 10 against the tokenizer itself and brute force."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from cuegrain.llm import packing as P
from cuegrain.llm import token_files as T
from cuegrain.llm import tokens as K

TEXTS = ["", None, " ", "a  b", " a", "a ", "\n\nx \n y", "don't 's  's", "<|endoftext|> hi <|endoftext|>", "é ñ 日本 語 　 z", "a\x1c b", "… ​ x", "😀 😀b 1a 2", "a\tb c\td", "x end. end, end end!' a<|endoftext|>. <|endoftext|>'s 12, é! €. a€. it's. 's' -- b-", "word " * 5000, "x" * 20_000, "same", "same"]


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(K.tokenizer_path())
    return lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, K.END_ID]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "x", 3, 4) for i, t in enumerate(texts)], "doc_id long, text string, ids string, start int, row int")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_parts_give_the_ids_of_the_whole(spark, plain):
    real = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts = TEXTS + real
    got = K.Encoder(K.tokenizer_path()).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [plain(t) for t in texts]


def test_bounded_memory_changes_nothing(monkeypatch, plain):
    monkeypatch.setattr(K, "KNOWN_WORDS", 3)
    monkeypatch.setattr(K, "CHARS", 40)
    e = K.Encoder(K.tokenizer_path())
    for _ in range(2):
        assert [np.frombuffer(g, "<u4").tolist() for g in e.encode(TEXTS)] == [plain(t) for t in TEXTS]


@pytest.mark.parametrize("bits", [1, 3, 8, 15, 16, 17, 20, 32])
def test_blobs_round_trip(bits):
    rng = np.random.default_rng(bits)
    lists = [rng.integers(0, 1 << bits, n, dtype=np.uint64).astype("<u4") for n in (0, 1, 5000, 7, 4096, 100)]
    blob = T.Blob(T.write_blob([x.tobytes() for x in lists], bits))
    assert [blob.document(k).tolist() for k in range(6)] == [x.tolist() for x in lists]
    whole = np.concatenate(lists)
    for lo, hi in ((0, len(whole)), (4095, 4097), (17, 17), (9000, 9209)):
        assert blob.range(lo, hi).tolist() == whole[lo:hi].tolist()


def test_ids_take_the_fewest_bits():
    assert [T.id_bits(n) for n in (1, 2, 3, 256, 257, 50_257)] == [1, 1, 2, 8, 9, 16]
    with pytest.raises(ValueError):
        T.Blob(b"x" * 64)


@pytest.mark.parametrize("options", [{}, {"blob_ids": 50}, {"blob_ids": 1, "partitions": 1}])
def test_token_files(spark, plain, options):
    got = {r.id: (r.start, r.n_tokens, r.ids_crc32) for r in T.token_files(docs(spark), **options).collect()}
    start = 0
    for i, t in enumerate(TEXTS):
        ids = plain(t)
        assert got[i] == (start, len(ids), crc(ids))
        start += len(ids)


def test_token_files_of_nothing_and_of_repeats(spark):
    assert T.token_files(docs(spark, [])).count() == 0
    twice = docs(spark, ["a", None]).union(docs(spark, ["a"])).selectExpr("CASE WHEN doc_id = 0 THEN doc_id END AS doc_id", "text")
    assert sorted((r.id is None, r.start, r.n_tokens) for r in T.token_files(twice).collect()) == [(False, 1, 2), (False, 3, 2), (True, 0, 1)]


def check_packing(placed, want, room=P.ROOM):
    assert {(r.id, r.piece): (r.start, r.length, r.ids_crc32) for r in placed} == want
    bins = {}
    for r in placed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for its in bins.values():
        at = 0
        for offset, length in sorted(its):
            assert offset == at
            at += length
        assert at <= room
    return len(bins)


def test_packing(spark, plain):
    want = {}
    for i, t in enumerate(TEXTS):
        ids = plain(t)
        first = len(ids) % P.ROOM or P.ROOM
        cuts = [0, *range(first, len(ids) + 1, P.ROOM)] if len(ids) > P.ROOM else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i, k] = (a, b - a, crc(ids[a:b]))
    placed = P.best_fit_packing(docs(spark)).collect()
    total = sum(n for _, n, _ in want.values())
    assert check_packing(placed, want) <= -(-total // P.ROOM) + 1
    assert P.best_fit_packing(docs(spark, [])).count() == 0


def test_packing_in_groups_and_of_repeated_rows(spark, plain):
    rng = random.Random(1)
    texts = ["word " * rng.randint(0, 900) for _ in range(60)]
    placed = P.best_fit_packing(docs(spark, texts), group_pieces=10).collect()
    lengths = {i: len(plain(t)) for i, t in enumerate(texts)}
    want = {(r.id, r.piece): (r.start, r.length, r.ids_crc32) for r in placed}
    assert {i: sum(n for (k, _), (_, n, _) in want.items() if k == i) for i in lengths} == lengths
    bins, groups = check_packing(placed, want), len({r.sequence_id >> 32 for r in placed})
    assert groups > 3 and bins <= -(-sum(lengths.values()) // P.ROOM) + 3 * groups
    twice = docs(spark, ["same", None]).union(docs(spark, ["same", None])).selectExpr("CASE WHEN doc_id = 0 THEN 7 END AS doc_id", "text")
    few = P.best_fit_packing(twice, known_words=3).collect()
    assert sorted((r.id or 0, r.length) for r in few) == [(0, 1), (0, 1), (7, 2), (7, 2)] and sorted(r.offset for r in few) == [0, 2, 4, 5]


def test_best_fit_decreasing_against_a_plain_search():
    rng = random.Random(4)
    for _ in range(30):
        room = rng.choice([10, 64, 100])
        lengths = [rng.randint(1, room) for _ in range(rng.randint(1, 120))]
        where, offset = P.best_fit(np.array(lengths), room)
        left, bins = [], []
        for n in sorted(lengths, reverse=True):
            fits = [b for b in range(len(left)) if left[b] >= n]
            b = min(fits, key=lambda b: left[b]) if fits else len(left)
            if not fits:
                left.append(room)
                bins.append([])
            left[b] -= n
            bins[b].append(n)
        mine = {}
        for n, b, o in sorted(zip(lengths, where, offset, strict=True), key=lambda x: (x[1], x[2])):
            assert o == sum(mine.get(b, []))
            mine.setdefault(b, []).append(n)
        # bins with equal room are interchangeable, so fills agree though contents need not
        assert sorted(map(sum, mine.values())) == sorted(map(sum, bins)) and sorted(sum(mine.values(), [])) == sorted(lengths)
