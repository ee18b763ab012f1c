"""Token files and packing against the tokenizers library itself."""

import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tests.llm.corpora import FOLDER, clashing, documents, prose
from tidewatch.llm import packing, token_files, token_ids
from tidewatch.llm.frames import table
from tidewatch.llm.queries import QUERIES
from tidewatch.llm.token_ids import encoder

BYTES, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"
ODD = ["", " ", "a", "a  b", " a ", "a \n b", "\n", "it's 5 o'clock", "<|endoftext|> x", "é é ́",
       "İ İx, aΣ Σ.", "a b 　c", "x\x1c y", "漢字 かな", "a,b. c!! \U0001f600", "word " * 5000]


@lru_cache
def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def direct(name, texts):
    return [e.ids for e in library(name).encode_batch(texts, add_special_tokens=False)]


def by_words(name, texts):
    ids, ends = encoder(name).encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]


@pytest.mark.parametrize("name", [BYTES, WORD])
def test_word_by_word_equals_the_library(name):
    assert by_words(name, ODD) == direct(name, ODD)
    assert by_words(name, ODD[::-1]) == direct(name, ODD[::-1])  # what was met before is the same
    assert by_words(name, []) == []


@pytest.mark.parametrize("name", [BYTES, WORD])
def test_special_tokens_are_read_as_the_library_does(name):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|startoftext|>y", "A <|ENDOFTEXT|> b", "<|endof text|>"]
    assert by_words(name, texts) == direct(name, texts)
    assert 50256 in by_words(BYTES, texts)[0] and 49407 in by_words(WORD, texts)[0]


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_ids, "REMEMBERED", 3)
    for name in (BYTES, WORD):
        tool, texts = token_ids.Encoder(name), [prose(i, 30) for i in range(4)]
        for _ in range(3):
            ids, ends = tool.encode(pa.array(texts))
            assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == direct(name, texts)


def test_slices_hold_every_row_once(monkeypatch):
    monkeypatch.setattr(token_ids, "SLICE_BYTES", 100)
    for sizes in ([], [0], [0, 0, 0], [500], [30] * 20, [99, 1, 1, 250, 0, 100, 3]):
        batch = pa.record_batch([pa.array(range(len(sizes)), pa.int64()),
                                 pa.array(["x" * n for n in sizes], pa.string())], names=["doc_id", "text"])
        found = list(token_ids.slices(batch))
        assert [i for s in found for i in s["doc_id"].to_pylist()] == list(range(len(sizes)))
        assert all(len(s) == 1 or sum(map(len, s["text"].to_pylist()[:-1])) < 200 for s in found)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aB é́'!.1\n\t  Σİ漢", max_size=20), min_size=1, max_size=5))
def test_any_text_equals_the_library(texts):
    for name in (BYTES, WORD):
        assert by_words(name, texts) == direct(name, texts)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_query(spark):
    rows = sorted(QUERIES["op3_token_files"](spark, FOLDER).collect())
    texts = {r.doc_id: r.text for r in table(spark, FOLDER, "documents").collect()}
    start = 0
    for row, ids in zip(rows, direct(BYTES, [texts[d] or "" for d in sorted(texts)])):
        ids = [*ids, 0]
        assert tuple(row) == (row.doc_id, start, len(ids), crc(ids))
        start += len(ids)
    assert [r.doc_id for r in rows] == sorted(texts)


def test_token_files_read_in_part(spark, tmp_path):
    path, texts = str(tmp_path / "ids"), [prose(i, 50) for i in range(300)]
    df = clashing(documents(spark, texts, [(None, "null id"), (5, "again"), (400, None)]))
    token_files.write_tokens(df.repartition(7), path, BYTES, page_rows=64)
    part = token_files.tokens(spark, path, 100, 119)
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,100)" in (
        part._jdf.queryExecution().executedPlan().toString())
    got = {r.doc_id: r.tokens for r in part.collect()}
    assert got == {i: [*direct(BYTES, [texts[i]])[0], 0] for i in range(100, 120)}
    scan = token_files.metadata(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "tokens:array" not in scan
    rows = token_files.digests(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in rows[:3]] == [None, 0, 1] and len(rows) == 303
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    assert (rows[-1].doc_id, rows[-1].n_tokens) == (400, 1)
    files = sorted((tmp_path / "ids").glob("*.parquet"))
    columns = [pq.ParquetFile(f).metadata.row_group(0).column(i) for f in files for i in range(5)
               if pq.ParquetFile(f).metadata.num_row_groups]
    assert {c.has_column_index and c.has_offset_index for c in columns if "tokens" not in c.path_in_schema} == {True}
    assert any("DELTA" in str(c.encodings) for c in columns)
    assert any("DICTIONARY" in str(c.encodings) for c in columns)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 4095, 4096, 4097, 13000])
def test_pieces(n):
    owner, length = packing.pieces(np.array([n, 5, n]), 4096)
    for i, size in enumerate((n, 5, n)):
        own = length[owner == i].tolist()
        assert own == [4096] * (size // 4096) + [1 << b for b in range(11, -1, -1) if size >> b & 1]
    assert owner.tolist() == sorted(owner.tolist())


def test_packing_query(spark):
    rows = QUERIES["op9_packing"](spark, FOLDER).collect()
    texts = {r.doc_id: r.text for r in table(spark, FOLDER, "documents").collect()}
    ids = {d: [*x, 2] for d, x in zip(texts, direct(WORD, [t or "" for t in texts.values()]))}
    ends = dict.fromkeys(ids, 0)
    for row in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        own = ids[row.doc_id]
        assert row.start == ends[row.doc_id] and row.doc_tokens == len(own)
        assert row.ids_crc32 == crc(own[row.start:row.start + row.length])
        assert row.offset == 0 and row.length & (row.length - 1) == 0
        ends[row.doc_id] += row.length
    assert ends == {d: len(x) for d, x in ids.items()}
    by_number = sorted(rows, key=lambda r: r.sequence_id)
    assert [r.sequence_id for r in by_number] == list(range(len(rows)))
    assert [r.length for r in by_number] == sorted(r.length for r in rows)


def test_packing_edge_cases(spark, tmp_path):
    df = clashing(documents(spark, ["", None, "a b"], [(None, "a b"), (2, "a b")]))
    packing.write_sequences(df, str(tmp_path / "a"))
    rows = packing.packed(spark, str(tmp_path / "a")).collect()
    assert sum(r.length for r in rows) == 1 + 1 + 3 * 3 and len({r.sequence_id for r in rows}) == len(rows)
    packing.write_sequences(documents(spark, []), str(tmp_path / "b"))
    assert packing.packed(spark, str(tmp_path / "b")).count() == 0
    token_files.write_tokens(documents(spark, []), str(tmp_path / "c"))
    assert token_files.digests(spark, str(tmp_path / "c")).count() == 0
