import random
import zlib
from collections import Counter

import pytest
from tokenizers import Tokenizer

from hawser.llm import packing, token_count

DOCS = "doc_id long, text string, n_bytes string"  # n_bytes clashes with a result column


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(token_count.tokenizer_path())


@pytest.fixture(scope="module")
def spec():
    with open(token_count.tokenizer_path(), encoding="utf-8") as f:
        return f.read()


def odd_texts(n=3000):
    rng = random.Random(5)
    parts = list("ab ,.'s\n\t \r  éß1٣!$̀　𐐀") + ["<|endoftext|>", " the", "\n\n", "  ", "ᲊ", "'ll", "\x1c", "\x85", "ⅷ"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_encoder_equals_library(library, spec):
    encoder = token_count.Encoder(spec, token_count.frequent_pieces(spec), cache_entries=500)
    for text in odd_texts():
        assert encoder.ids(text) == token_count.ids_bytes(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_merging_agrees_where_it_is_used(spec):
    encoder = token_count.Encoder(spec, {})
    for cp in range(0x530):
        for piece in (chr(cp), "a" + chr(cp), "1" + chr(cp), "!" + chr(cp), " " + chr(cp), "'" + chr(cp) + "a"):
            assert encoder.merging.encode_ordinary(piece) == encoder.library.encode(piece, add_special_tokens=False).ids


def test_counts(spark, library):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a b", None), (3, "word " * 600, "x"), (3, "word " * 600, "x"), (4, "<|endoftext|>", "x"), (5, "y" * 200_000, "x")]
    got = token_count.count_tokens(spark.createDataFrame(rows, DOCS), token_count.tokenizer_path()).collect()
    assert len(got) == len(rows)
    for r in got:
        text = r.text or ""
        n = len(library.encode(text, add_special_tokens=False).ids) if len(text) < 100_000 else None
        assert r.n_bytes == len(text.encode()) and (n is None or r.n_tokens == n) and r.over_limit == (r.n_tokens > 512)
    assert token_count.count_tokens(spark.createDataFrame([], DOCS), token_count.tokenizer_path()).count() == 0


def test_other_tokenizers(spark):
    docs = spark.createDataFrame([(1, "Hello wide  world")], "doc_id long, text string")
    word = Tokenizer.from_file(token_count.tokenizer_path("word_bpe_49k.json"))
    assert token_count.count_tokens(docs, token_count.tokenizer_path("word_bpe_49k.json")).first().n_tokens == len(word.encode("Hello wide  world", add_special_tokens=False).ids)
    import sentencepiece

    piece = sentencepiece.SentencePieceProcessor(model_file=token_count.tokenizer_path("piece_bpe_32k.model"))
    assert token_count.count_tokens(docs, token_count.tokenizer_path("piece_bpe_32k.model")).first().n_tokens == len(piece.encode("Hello wide  world"))


def plain_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms[rooms.index(min(fits))] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(40))
def test_histogram_packing_equals_one_by_one(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 20, 64, 1024])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 300))]
    bins = {}
    for n, first, count, first_bin, per, offset in packing.best_fit_decreasing(Counter(lengths), capacity):
        for i in range(count):
            bins.setdefault(first_bin + i // per, []).append((offset + (i % per) * n, n))
    for held in bins.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= capacity
    assert sorted(capacity - sum(n for _, n in b) for b in bins.values()) == plain_best_fit(lengths, capacity)


def check_packing(rows, docs, library, capacity):
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc_id, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        pieces = sorted(by_doc[doc_id], key=lambda r: r.piece)
        at = 0
        for k, r in enumerate(pieces):
            assert r.piece == k and r.start == at
            assert r.ids_crc32 == zlib.crc32(token_count.ids_bytes(ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
        assert all(r.length == capacity for r in pieces[1:]) and (len(pieces) > 1) == (len(ids) > capacity)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in sequences.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= capacity
    assert sorted(capacity - sum(n for _, n in b) for b in sequences.values()) == plain_best_fit([r.length for r in rows], capacity)


def test_pack_documents(spark, library):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "γ"]) for _ in range(rng.randint(0, 60)))) for i in range(200)] + [(500, None), (501, ""), (502, "word " * 300)]
    rows = packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string"), token_count.tokenizer_path(), capacity=64).collect()
    check_packing(rows, docs, library, 64)
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), token_count.tokenizer_path()).count() == 0


def test_ranks_are_whole_when_salted(spark):
    rows = [(i, 0, 3) for i in range(500)] + [(None, 0, 3)] * 5 + [(7, 0, 3)] * 5
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, piece int, length long"), 10, rows_per_group=20).collect()
    assert len(got) == 510 and len({(r.sequence_id, r.offset) for r in got}) == 510 and len({r.sequence_id for r in got}) == 170


def test_a_tokenizer_is_read_and_broadcast_once(spark, monkeypatch):
    read = []
    pieces = token_count.frequent_pieces
    monkeypatch.setattr(token_count, "_broadcasts", {})
    monkeypatch.setattr(token_count, "frequent_pieces", lambda spec: read.append(1) or pieces(spec))
    path = token_count.tokenizer_path()
    one, other = token_count.SharedTokenizer(spark, path), token_count.SharedTokenizer(spark, path, 100)
    assert one.shared is other.shared and len(read) == 1 and one.key != other.key
    assert one.encoder().ids("the word") == other.encoder().ids("the word")
