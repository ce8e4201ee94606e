from __future__ import annotations

import hashlib
import random

import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor

from verbarium.llm.piece_bpe import Pieces, decode, encode
from verbarium.llm.queries import op12_pieces, tokenizer_path

from .conftest import ODD_ROWS, multiset

LETTERS = " aabbcetnihs  \n\t▁<>0x41é漢あ\U0001f600\x00ß'.,  "


@pytest.fixture(scope="module")
def path():
    return tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(path):
    return SentencePieceProcessor(model_file=path)


@pytest.fixture(scope="module")
def pieces(path):
    return Pieces(path)


def test_random_texts(pieces, library):
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choices(LETTERS, k=rng.randint(0, 30)))
        assert pieces.ids(text).tolist() == library.encode(text, add_eos=True), text


def test_texts_of_random_pieces(pieces, library):
    rng = random.Random(2)
    names = list(pieces.id_of)
    for _ in range(20_000):
        text = "".join(rng.choices(names, k=rng.randint(1, 8)))
        assert pieces.ids(text).tolist() == library.encode(text, add_eos=True), text


def test_runs_of_blanks(pieces, library):
    for n in range(70):
        for tail in ("", "x", "the", " the", "\n", "漢"):
            for text in (" " * n + tail, "a" + " " * n + tail + " " * n):
                assert pieces.ids(text).tolist() == library.encode(text, add_eos=True)


def test_long_stretch_without_blanks(pieces, library):
    rng = random.Random(3)
    for letters in ("ab", "aaaab", "etaoin", "漢あx"):
        text = "".join(rng.choices(letters, k=30_000))
        assert pieces.ids(text).tolist() == library.encode(text, add_eos=True)


def test_compatible_pairs_are_what_the_merges_make(pieces):
    """Every pair: apart just if merging the two joined texts leaves the two."""
    rng = random.Random(4)
    ids = [i for i in pieces.left]
    kept = 0
    for _ in range(20_000):
        a, b = rng.choice(ids), rng.choice(ids)
        if pieces.piece[b].startswith("▁"):
            continue
        apart = pieces.merged(pieces.piece[a] + pieces.piece[b]) == [a, b]
        assert pieces.fits(a, b) == apart
        kept += apart
    assert kept > 1000


def test_full_tables_are_emptied(path, library, monkeypatch):
    from verbarium.llm import piece_bpe

    monkeypatch.setattr(piece_bpe, "KNOWN_PARTS", 5)
    monkeypatch.setattr(piece_bpe, "KNOWN_PAIRS", 5)
    small = Pieces(path)
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choices(LETTERS, k=40))
        assert small.ids(text).tolist() == library.encode(text, add_eos=True)


def expected(library, rows):
    out = []
    for r in rows:
        ids = library.encode(r["text"] or "", add_eos=True)
        texts = (" ".join(map(str, ids)), library.decode(ids))
        out.append((r["doc_id"], len(ids), *(hashlib.sha256(t.encode()).hexdigest() for t in texts)))
    return out


def query_rows(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    return op12_pieces(spark, str(tmp_path)).select(names).collect()


def test_query_on_odd_rows(spark, odd_docs, library, tmp_path):
    found = query_rows(spark, odd_docs, tmp_path)
    assert len(found) == len(ODD_ROWS)
    assert multiset(found) == multiset(expected(library, odd_docs.collect()))


def test_query_on_given_rows(spark, small_docs, library, tmp_path):
    assert multiset(query_rows(spark, small_docs, tmp_path)) == multiset(expected(library, small_docs.collect()))


def test_empty_table(spark, no_docs, tmp_path):
    assert query_rows(spark, no_docs, tmp_path) == []


def test_decode_gives_the_text_back(spark, path):
    rows = [(1, "a text  with\nlines and 漢字 \U0001f600"), (2, ""), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    back = decode(encode(docs, path), path)
    assert back.columns == ["doc_id", "ids", "text"]
    assert multiset(back.select("doc_id", "text").collect()) == multiset([(i, t or "") for i, t in rows])
    empty = spark.createDataFrame([(1, None)], "doc_id int, ids array<int>")
    assert decode(empty, path).first()["text"] is None


def test_other_files_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as file:
        model.ParseFromString(file.read())
    model.normalizer_spec.remove_extra_whitespaces = True
    other = tmp_path / "other.model"
    other.write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="not a plain BPE model"):
        Pieces(str(other))


def test_query_takes_one_python_pass(spark, odd_docs, tmp_path):
    odd_docs.write.parquet(f"{tmp_path}/documents.parquet")
    plan = op12_pieces(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_few_rows_leave_at_a_time(spark, path):
    from verbarium.llm import piece_bpe

    batch = pa.RecordBatch.from_pydict({"n": list(range(600))})
    parts = list(piece_bpe._few_rows([batch, batch.slice(0, 0), batch]))
    assert max(part.num_rows for part in parts) == piece_bpe.ROWS
    assert [n for part in parts for n in part["n"].to_pylist()] == 2 * list(range(600))
    docs = spark.range(0, 700, 1, 1).selectExpr("id AS doc_id", "concat('text  ', id, ' 漢') AS text")
    assert encode(docs, path, decoded=True).collect() == decode(encode(docs, path), path).collect()
