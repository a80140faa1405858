import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from contactgrid.llm import token_counts, token_files
from contactgrid.llm.tokens import UnitEncoder, library_encoder

PATH = P.path("byte_bpe_50k.json")
TEXTS = {7: "a b c", 3: None, 1: "", 9: "x " * 4000, 4: "a b c", 12: "  two\n\nlines <|endoftext|>"}


@pytest.fixture(scope="module")
def ids():
    """As ordinary text, the added token too: what separates documents must not come from a text."""
    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    return {k: tok.encode(t or "", add_special_tokens=False).ids for k, t in TEXTS.items()}


LINES = ["a\n\nb", "a\n\n\nb c", "\nx", "x\n", "x \n y", "a\r\nb", "a\x00b c", "\x00\n", "é\nÉ, ok.\nThen", "don't\nwon't x.y", "a,\nb 12\n34", "t\u2028\nq", "w\n" * 50, "one  two\tthree", "wörd " * 3000, "\n\n", "", "?!\n?!", "a\x0b\nb"]


@pytest.mark.parametrize("most", [1, 40, 1 << 21])
def test_lines_and_slices_as_the_library(most):
    tok = Tokenizer.from_file(PATH)
    encode = library_encoder(PATH, added=True)
    texts = [*LINES, None, *(a + b for a in LINES for b in LINES)]
    got = [x.tolist() for x in encode.batch(pa.array(texts, pa.string()), most)]
    assert got == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_caches_are_bounded():
    encode = UnitEncoder(lambda piece: [len(piece)], P.PATTERN, limit=50)
    for k in range(40):
        text = " ".join(f"w{k}x{j}, q" for j in range(20))
        assert sum(encode(text).tolist()) == len(text)
        assert max(map(len, (encode.known, encode.older, encode.spaced, encode.older_spaced))) < 50 + 4 * 20


def test_a_word_is_one_unit_with_and_without_marks():
    made = []
    encode = UnitEncoder(lambda piece: made.append(piece) or [len(piece)], P.PATTERN)
    marked = [f"{w}{m}" for w in ("one", "Ünd", "12") for m in ("", *".,;:!?")]
    got = encode("x " + " ".join(marked)).tolist()
    assert got == [len(m) for m in encode.matches("x " + " ".join(marked))]
    assert sorted(made) == sorted(["x", " x", " one", " Ünd", " 12", *".,;:!?"])
    assert sorted(encode.spaced) == sorted(["x", "one", "Ünd", "12", *(f"\0{m}" for m in ".,;:!?")])


def test_marks_after_every_letter_as_the_library():
    tok = Tokenizer.from_file(PATH)
    letters = [c for c in map(chr, range(1, 0x110000)) if c.isalnum() or ord(c) < 0x3000 and not c.isspace()]
    texts = [" ".join(f"a{c},x {c}. {c};\n{c}9?!" for c in letters[k : k + 512]) for k in range(0, len(letters), 512)]
    encode = library_encoder(PATH, added=True)
    assert [x.tolist() for x in encode.batch(pa.array(texts))] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, 0) for k, t in TEXTS.items()], "doc_id long, text string, start int")


def test_unit_encoder_is_the_library(ids):
    encode = library_encoder(PATH)
    assert all(encode(t or "").tolist() == ids[k] for k, t in TEXTS.items())


@pytest.mark.parametrize("shard_ids", [1, 50, 1 << 20])
def test_files_round_trip(spark, docs, ids, tmp_path, shard_ids):
    path = str(tmp_path / "tokens")
    token_files.write_tokens(docs, path, PATH, shard_ids=shard_ids)
    rows = {r.id: r for r in token_files.read_tokens(spark, path).collect()}
    at = 0
    for k in sorted(TEXTS):
        own = np.array([*ids[k], 0], dtype="<u4")
        assert (rows[k].start, rows[k].n_tokens, rows[k].ids_crc32) == (at, len(own), zlib.crc32(own.tobytes()))
        at += len(own)


def test_empty_table(spark, docs, tmp_path):
    token_files.write_tokens(docs.limit(0), str(tmp_path / "t"), PATH)
    assert token_files.read_tokens(spark, str(tmp_path / "t")).count() == 0


def test_grammar_round_trips():
    rng = np.random.default_rng(0)
    for _ in range(150):
        many = [rng.integers(0, 3, rng.integers(0, 80)).astype(np.uint16) for _ in range(rng.integers(0, 8))]
        shard = token_files.Shard(token_files.pack(many, 3))
        assert [d.tolist() for d in shard.all()] == [d.tolist() for d in many]
        for k, d in enumerate(many):
            assert shard.document(k).tolist() == d.tolist()
            assert [shard.token(k, j) for j in range(len(d))] == d.tolist()


def test_grammar_shortens_repeats():
    docs = [np.tile(np.arange(20, dtype=np.uint16), 50)] * 20
    assert len(token_files.Shard(token_files.pack(docs, 100)).symbols) < 2000


@pytest.mark.parametrize(("step", "buckets", "run"), [(1, 1, 1), (2, 3, 2), (3, 18, 5), (1 << 15, 2, 1 << 16)])
def test_grammar_in_any_steps(monkeypatch, step, buckets, run):
    """Runs of one symbol over the ends of steps, pairs that share a bucket, empty documents."""
    for name, value in (("_STEP", step), ("_BUCKETS", buckets), ("_RUN", run)):
        monkeypatch.setattr(token_files, name, value)
    rng = np.random.default_rng(step)
    for _ in range(40):
        many = [np.repeat(rng.integers(0, 3, rng.integers(0, 20)), rng.integers(1, 9)).astype(np.uint16) for _ in range(rng.integers(0, 9))]
        shard = token_files.Shard(token_files.pack(many, 3))
        assert [d.tolist() for d in shard.all()] == [d.tolist() for d in many]
        assert all(shard.document(k).tolist() == d.tolist() for k, d in enumerate(many))


def test_grammar_takes_pairs_that_stand_often_and_none_over_an_end():
    docs = [np.array(d, dtype=np.uint16) for d in [[0, 1, 2], [3, 0, 1]] * 8 + [[4, 5]] * 7]
    ends = np.cumsum([len(d) for d in docs])
    symbols, rules, symbol_ends = token_files.grammar(np.concatenate(docs), ends, 6, rounds=1)
    assert rules.tolist() == [[0, 1], [1, 2], [3, 0]]
    assert symbols.tolist() == [6, 2, 8, 1] * 8 + [4, 5] * 7
    assert symbol_ends.tolist() == list(range(2, len(symbols) + 1, 2))
    ids = np.full(4000, 65535, dtype=np.uint16)
    symbols, rules, _ = token_files.grammar(ids, np.array([4000]), 1 << 16)
    assert symbols.tolist() == ids.tolist() and not len(rules)


@pytest.mark.parametrize("block_ids", [1, 3, 64, 1 << 19])
def test_counts(spark, docs, ids, tmp_path, block_ids):
    path = str(tmp_path / "flat")
    token_counts.write_flat(docs.coalesce(2), path, PATH, 50256, block_ids=block_ids)
    table = spark.read.parquet(path)
    got = token_counts.count_documents(table.where("block is not null").select("file", "block", "data"), 50256)
    assert sorted(r.n_tokens for r in got.collect()) == sorted(map(len, ids.values()))
    assert got.where("not complete").count() == 0


def test_each_document_gets_its_own_count(spark, ids, tmp_path):
    """The rows of the query against the library; ids that repeat, nulls and clashing columns."""
    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    texts = [*TEXTS.values(), *LINES, "a <|endoftext|> b", "x " * 9]
    rows = [(k // 2 if k > 9 else k, t, "d", 7) for k, t in enumerate(texts)] + [(None, "no id", "d", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, data string, file long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in token_counts.op4_token_counts(spark, str(tmp_path)).collect())
    assert got == sorted((-1 if k is None else k, len(tok.encode(t or "", add_special_tokens=False).ids)) for k, t, *_ in rows)
    path = str(tmp_path / "none")
    token_counts.write_flat(docs.limit(0), path, PATH, 50256)
    assert token_counts.named_counts(spark, path, 50256).count() == 0


def test_counts_of_ragged_blocks(spark):
    rng = np.random.default_rng(1)
    rows, want = [], []
    for file in range(6):
        flat = rng.integers(0, 4, rng.integers(0, 40)).astype("<u2")
        cuts = sorted(rng.integers(0, len(flat) + 1, 5).tolist())
        rows += [(file, k, bytearray(p.tobytes())) for k, p in enumerate(np.split(flat, cuts))]
        doc, start = 0, 0
        for at in np.flatnonzero(flat == 0).tolist():
            want.append((file, doc, at - start, True))
            doc, start = doc + 1, at + 1
        if start < len(flat):
            want.append((file, doc, len(flat) - start, False))
    rows.append((9, 0, None))
    blocks = spark.createDataFrame(rows, "file int, block long, data binary")
    got = [(r.file, r.doc_no, r.n_tokens, r.complete) for r in token_counts.count_documents(blocks, 0).collect()]
    assert sorted(got) == sorted(want)
    assert token_counts.count_documents(blocks.limit(0), 0).count() == 0


ADDED = ["a<|endoftext|>b", "<|endoftext|>", "<|endoftext|><|endoftext|> x", " y  <|endoftext|>\n z", "<|endoftext|", "plain words", "", None, "a <|endoftext|> b."]


def test_added_tokens_as_plain_encode():
    tok = Tokenizer.from_file(PATH)
    encode = library_encoder(PATH, added=True)
    for t in ADDED:
        assert encode(t or "").tolist() == tok.encode(t or "", add_special_tokens=False).ids, t


def test_op9_finds_added_tokens(spark, tmp_path):
    tok = Tokenizer.from_file(PATH)
    docs = spark.createDataFrame(list(enumerate(ADDED)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in token_files.op9_token_files(spark, str(tmp_path)).collect()}
    at = 0
    for k, t in enumerate(ADDED):
        own = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        assert (rows[k].start, rows[k].n_tokens, rows[k].ids_crc32) == (at, len(own), zlib.crc32(own.tobytes()))
        at += len(own)


def test_repeated_ids_have_an_order(spark, tmp_path):
    """The same rows in other partitions give the same files; no text is lost."""
    rows = [(k % 5, f"text {k} " * (k % 7), 1) for k in range(60)] + [(None, "a b", 1), (None, None, 1), (3, None, 1), (3, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    found = []
    for n in (1, 5):
        path = str(tmp_path / f"t{n}")
        token_files.write_tokens(docs.repartition(n), path, PATH, shard_ids=100)
        found.append(sorted(map(tuple, token_files.read_tokens(spark, path).collect()), key=lambda r: r[1]))
    assert found[0] == found[1] and len(found[0]) == len(rows)
    assert [r[0] for r in found[0]] == sorted((k for k, *_ in rows), key=lambda k: -1 if k is None else k)
