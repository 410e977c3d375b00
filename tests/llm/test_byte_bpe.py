import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from shelfsight.llm.byte_bpe import MatchTable, as_bytes, as_piece, bpe_digests, bpe_ids, bpe_texts, read_ranks, serialise, vocabulary_model

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def odd_texts(n):
    rng = random.Random(2)
    alphabet = list("  \n\t▁abcdeé中\U0001f600ßthe.,0123​ \x00\r<>s'Ā") + ["the ", "   ", "'ll", "<|endoftext|>", "ation", "\x85", "　", "é"]
    texts = ["", " ", "\n", "a", "  a", "a  ", "'s", "don't  we'LL", "é" * 3000, "x" * 5000, " " * 300, "ab " * 3000, "0" * 700, "\x00\x01"]
    return texts + ["".join(rng.choices(alphabet, k=rng.randint(1, 80))) for _ in range(n)]


def test_equal_to_the_library(library):
    model = vocabulary_model(PATH, PATTERN)
    for rows in (50, 100_000):
        table = MatchTable(model, PATTERN, table_rows=rows)
        for t in odd_texts(2500):
            ids = library.encode_ordinary(t)
            assert table.ids(t).tolist() == ids, repr(t)
            assert table.decode(ids) == t.encode() == table.encode(t)[2]


def test_every_code_point_is_cut_alike(library):
    table = MatchTable(vocabulary_model(PATH, PATTERN), PATTERN)
    points = [c for c in range(0x3500) if not 0xD800 <= c < 0xE000] + list(range(0xE000, 0x110000, 997))
    for k in range(0, len(points), 64):
        text = "".join(f"a{chr(c)}b1{chr(c)}2 {chr(c)} {chr(c)}{chr(c)}!x" for c in points[k : k + 64])
        assert table.ids(text).tolist() == library.encode_ordinary(text)


def test_every_token_decodes_to_its_bytes():
    ranks = read_ranks(PATH)
    table = MatchTable(serialise(ranks), PATTERN)
    assert table.whole_tokens() and all(table.bytes_of[r] == t for t, r in ranks.items())
    assert as_bytes(as_piece(bytes(range(256)))) == bytes(range(256))
    with pytest.raises(IndexError):
        table.decode([-1])


def test_refused_vocabularies():
    ranks = {bytes([b]): b for b in range(256)}
    MatchTable(serialise(ranks | {b"ab": 256}), PATTERN)
    for bad in ({b"a": 0}, ranks | {b"ab": 300}):
        with pytest.raises(ValueError):
            serialise(bad)
    # "abc" can't be reached by merges of two tokens
    assert not MatchTable(serialise(ranks | {b"abc": 256}), PATTERN).whole_tokens()


def test_table(spark, library):
    texts = [None, *odd_texts(60)]
    rows = [(i, t, 5) for i, t in enumerate(texts)] + [(3, texts[3], 5), (None, "the end", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    want = []
    for i, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    order = lambda r: (r[0] is not None, r)
    assert sorted(map(tuple, bpe_digests(docs, PATH, PATTERN).collect()), key=order) == sorted(want, key=order)
    ids = bpe_ids(docs, PATH, PATTERN)
    back = {r.doc_id: r.text for r in bpe_texts(ids, PATH, PATTERN).collect()}
    assert back == {i: t or "" for i, t, _ in rows}
    assert bpe_digests(docs.limit(0), PATH, PATTERN).count() == 0
