import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from contactgrid.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    return bpe.loaded(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


PARTS = [" ", "  ", "\n", "\t", " ", "\x1c", "\x85", "a", "the", "é", "'s", "'", "19", "$", "<|endoftext|>", "中", "​", "\r\n", "ß", "ing", "er", "🙂"]


def test_random_texts_as_the_library(encoder, library):
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12)))
        assert encoder[1](text).tolist() == library.encode_ordinary(text), text


def test_long_runs(encoder, library):
    for text in ("a" * 3000, " " * 2000, "ab" * 1500, "\n" * 500 + "x", "1" * 999):
        assert encoder[1](text).tolist() == library.encode_ordinary(text)


def test_appends_and_edits(encoder):
    rng = random.Random(2)
    for _ in range(120):
        data = bytes(rng.choice(b"abcdeghinorst  ") for _ in range(150))
        table = bpe.PrefixTable(encoder[0], data)
        lo = rng.randint(0, 149)
        filled = table.replace(lo, min(150, lo + rng.randint(0, 5)), bytes(rng.choice(b"theirs") for _ in range(rng.randint(0, 6))))
        assert filled <= len(table.data)
        assert table.last == bpe.PrefixTable(encoder[0], table.data).last
        table.append(b"ing")
        assert table.last == bpe.PrefixTable(encoder[0], table.data).last
        assert encoder[0].decode(table.ids()) == table.data


def test_bounded_caches_change_nothing(encoder, library):
    small = bpe.UnitEncoder(lambda piece: encoder[0].encode(piece.encode()), P.PATTERN, limit=3)
    text = "one two, three. four five\nsix  seven one two, " * 5
    assert small(text).tolist() == library.encode_ordinary(text)


def test_documents(spark, library):
    texts = [None, "", "a b", "a b", "  x\n", "ü" * 5000]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(2, "a b", "y")], "doc_id long, text string, n_tokens string")
    rows = {r.id: r for r in bpe.digests(docs, PATH, P.PATTERN).collect()}
    for k, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert rows[k].n_tokens == len(ids)
        assert rows[k].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    encoded = bpe.encode_documents(docs, PATH, P.PATTERN)
    assert {bytes(r.data) for r in bpe.decode_documents(encoded, PATH).collect()} == {(t or "").encode() for t in texts}
    assert bpe.digests(docs.limit(0), PATH, P.PATTERN).count() == 0
