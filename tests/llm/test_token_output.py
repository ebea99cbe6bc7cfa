import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from termforge.llm import token_output, tokens
from tokenizers import Tokenizer

WHOLE = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(text):
    return WHOLE.encode(text, add_special_tokens=False).ids


def test_whole_table_against_the_tokenizer(spark, small):
    rows = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    found = {r["doc_id"]: r for r in token_output.op9_token_output(spark, small).collect()}
    at = 0
    for doc, text in rows:
        ids, r = [*ids_of(text), 2], found.pop(doc)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), doc
        at += len(ids)
    assert not found


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text("aB éßİ.,!?'\"()-#$&*|\n\t 　０中文́ﬁ1", max_size=60)), min_size=1, max_size=5))
def test_pieces_give_the_ids_of_whole_texts(texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    for sentences in (False, True):
        ids, lengths, _ = tokens.encoder_for(tokens.TOKENIZER).encode(texts, sentences)
        cuts = np.cumsum(lengths)[:-1]
        assert [x.tolist() for x in np.split(ids, cuts)] == [ids_of(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, (1 << 32) - 1)), max_size=50))
def test_coding_round_trip(ranks):
    ranks = np.array(ranks, np.uint32)
    control, data = token_output.encode_ranks(ranks)
    assert (token_output.decode_ranks(control, data, len(ranks)) == ranks).all()
    assert len(control) == -(-len(ranks) // 4)


def test_files(spark, tmp_path):
    rows = [(5, None), (1, "b b"), (1, "a"), (None, "n"), (9, ""), (7, "long text, " * 60_000), (8, "\U0001f600퟿")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS part", "2 AS ids", "3 AS seq")
    token_output.write_token_files(docs, str(tmp_path / "t"))
    found = sorted(token_output.read_token_files(spark, str(tmp_path / "t")).collect(), key=lambda r: r["start"])
    order = [(None, "n"), (1, "a"), (1, "b b"), (5, ""), (7, "long text, " * 60_000), (8, "\U0001f600퟿"), (9, "")]
    at = 0
    for r, (doc, text) in zip(found, order, strict=True):
        ids = [*ids_of(text), 2]
        assert r["doc_id"] == doc and np.frombuffer(r["ids"], "<u4").tolist() == ids and r["start"] == at
        at += len(ids)


def test_frequent_ids_are_short(spark, tmp_path):
    docs = spark.createDataFrame([(i, "the the the the of of rare" + str(i)) for i in range(50)], "doc_id bigint, text string")
    token_output.write_token_files(docs, str(tmp_path / "t"))
    ranked = np.frombuffer(spark.read.parquet(str(tmp_path / "t/ranks")).first()[0], "<u4")
    assert ranked[0] == ids_of("the")[0]


def test_empty_table(spark, tmp_path):
    token_output.write_token_files(spark.createDataFrame([], "doc_id bigint, text string"), str(tmp_path / "t"))
    assert token_output.read_token_files(spark, str(tmp_path / "t")).collect() == []


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5])
def test_sizes_around_a_control_byte(n):
    ranks = np.arange(n) * 70_000
    assert token_output.decode_ranks(*token_output.encode_ranks(ranks), n).tolist() == ranks.tolist()


def test_words_outlive_forgotten_pieces(monkeypatch):
    """What is forgotten is only looked up again, the ids stay those of the tokenizer, and an encoder keeps no lists."""
    monkeypatch.setattr(tokens, "MOST_PIECES", 3)
    encoder, asked = tokens.PieceEncoder(), []
    model = encoder.model
    encoder.model = type("Model", (), {"tokenize": lambda self, word: asked.append(word) or model.tokenize(word)})()
    texts = ["Alpha beta, gamma!", "alpha Beta gamma? é1", "(Gamma) \u00e9t\u00e9. beta", "ALPHA, \U0001f600 beta"]
    for _ in range(3):
        for text in texts:
            assert encoder.encode([text], sentences=False)[0].tolist() == ids_of(text)
    assert len(asked) == len(set(asked)) and "alpha" in asked
    assert all(type(x) is bytes for kept in (encoder.words, encoder.marks) for x in kept.values())
    monkeypatch.setattr(tokens, "MOST_WORDS", 2)
    assert encoder.encode(["delta epsilon zeta eta"], sentences=False)[0].tolist() == ids_of("delta epsilon zeta eta")
    assert encoder.encode(["theta"], sentences=False)[0].tolist() == ids_of("theta") and list(encoder.words) == ["theta"]


def test_common_pieces_are_encoded_once_and_ids_stay_right_at_the_limits(monkeypatch):
    """Pieces beyond the limit are forgotten, but not those that came again; ids are those of the whole tokenizer."""
    from termforge.llm import tokens

    monkeypatch.setattr(tokens, "MOST_PIECES", 60)
    monkeypatch.setattr(tokens, "MOST_WORDS", 40)
    encoder, given = tokens.PieceEncoder(), []
    ids = encoder._ids
    monkeypatch.setattr(encoder, "_ids", lambda pieces: given.extend(pieces) or ids(pieces))
    for n in range(12):
        texts = [f"common Common, again? É{n} " + " ".join(f"rare{chr(97 + n)}{chr(97 + i)}" for i in range(25)), "common again? \n common Common,"]
        found, lengths, _ = encoder.encode(texts, sentences=False)
        want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert found.tolist() == sum(want, []) and lengths.tolist() == list(map(len, want))
    assert given.count("common") == given.count("Common,") == given.count("again?") == 1
    assert len(encoder.known) <= 60 + 60
