import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.cases import documents, edge_texts, nothing, rows, some_texts
from textloom.llm import packing, token_counts
from textloom.llm.tokenizing import WordEncoder, encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["<|endoftext|> and <|STARTOFTEXT|>", "J̌ ǰ J̌", "Σας ΣΑΣ", "İstanbul", "a\u0301 A\u0301", "ﬁne ½ 10x", "it's IT'S 's", "日本 語", "\u00a0x\u2003y\x1cz", "e\u0301\u0301 \u0301 x"]


def library(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="abAB' .,<|>éÉß\u0301\n\t1½", max_size=40))
def test_word_encoder_equals_the_library(text):
    data = text.encode("utf-8", "ignore")
    e = encoder(PATH)
    assert isinstance(e, WordEncoder)
    assert e.ids(data) == e.whole(data)


def test_odd_texts():
    for text in ODD:
        assert np.frombuffer(encoder(PATH).ids(text.encode()), dtype="<u4").tolist() == library(text)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abAB' .,é\u0301\n\t1<|>", max_size=40))
def test_normal_form_keeps_the_count(text):
    data = text.encode()
    assert encoder(PATH).count(data) == encoder(PATH).count(token_counts.normal_form(data, True))


def test_counts_equal_the_library(spark):
    texts = some_texts(30) + edge_texts() + ODD
    got = token_counts.count_tokens(documents(spark, texts), PATH, token_counts.new_cache(spark), limit=100).collect()
    want = [(r[0], len((r[1] or "").encode()), n := len(library(r[1])), n > 100) for r in rows(texts)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_cache_is_added_to_and_read(spark):
    cache = token_counts.new_cache(spark)
    docs = documents(spark, some_texts(20))
    first = sorted(map(tuple, token_counts.count_tokens(docs, PATH, cache).collect()), key=repr)
    n = token_counts.read_cache(spark, cache).count()
    assert sorted(map(tuple, token_counts.count_tokens(docs, PATH, cache).collect()), key=repr) == first
    assert token_counts.read_cache(spark, cache).count() == n
    token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), cache).count()
    assert token_counts.read_cache(spark, cache).select("tokenizer").distinct().count() == 2


def test_empty_tables(spark):
    assert token_counts.count_tokens(nothing(spark), PATH, token_counts.new_cache(spark)).count() == 0
    assert packing.pack_documents(nothing(spark), PATH).count() == 0


def check_packing(pieces, wanted, window):
    """Every id once, gapless sequences, no more than a window."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert sorted(by_doc, key=repr) == sorted(wanted, key=repr)
    for doc, ids in wanted.items():
        at = 0
        for p in sorted(by_doc[doc], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            at += p["length"]
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[p["start"] : at], dtype="<u4").tobytes())
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window


def test_packing_round_trip(spark):
    texts = some_texts(30) + [t for t in edge_texts() if t != "same text twice"]
    docs = documents(spark, texts).where("doc_id is not null").dropDuplicates(["doc_id"]).coalesce(2)
    pieces = packing.pack_documents(docs, PATH, window=64).collect()
    check_packing(pieces, {i: [*library(t), 1] for i, t in enumerate(texts)}, 64)
    used = len({p["sequence_id"] for p in pieces})
    assert used * 64 - sum(p["length"] for p in pieces) <= 2 * 64


def brute_level(level, size, window):
    best = None
    for h in range(0, window - size + 1):
        if h and not level[h]:
            continue
        new = list(level)
        if h:
            new[h] -= 1
        if h + size < window:
            new[h + size] += 1
        cost = sum(x * x for x in new[1:window])
        if best is None or cost <= best[0]:
            best = (cost, h)
    return best[1]


def test_best_level_is_the_least_sum_of_squares():
    rng = np.random.default_rng(0)
    p = packing.Packer(16)
    for _ in range(300):
        size = int(rng.integers(1, 16))
        assert p.best_level(size) == brute_level(p.level, size, 16)
        p.place((0, 0, b"\0" * 4 * size, size), size)


def test_open_windows_are_bounded():
    p = packing.Packer(16, open_windows=5)
    for i in range(200):
        p.add(i, b"\1\0\0\0" * 9)
        assert p.n_open <= 5
    p.pour()
    assert sum(x[2] for x in p.out) == 1800
