"""Every registered query on the smallest tables: contract columns, and results against SQL,
the library or brute force where there is one."""

import collections
import hashlib
import zlib

import numpy as np
import pytest

from ticklake.llm import common, queries
from tests.oracle import assert_same, connect

SF = "/root/testdata/sf0.001"
CONTRACT = {
    "op1_piece_dropout": ["doc_id", "n_ids", "ids_crc32", "lossless"],
    "op2_quality_classifier": ["doc_id", "held_out", "score", "predicted"],
    "op3_jaccard_join": ["doc_id", "class_id", "n_links"],
    "op4_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op5_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op6_vector_links": ["vec_id", "n_links", "component_id", "kept"],
    "op7_token_store": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op8_line_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op9_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op10_html_text": ["page_id", "url", "text", "n_chars"],
}


@pytest.fixture(scope="module")
def results(spark):
    got = {name: (df := run(spark, SF)).columns and df.collect() for name, run in queries.queries().items()}
    yield got
    common.cleanup(spark)


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def ids(texts):
    from tokenizers import Tokenizer

    from ticklake.llm.tokens import default_path

    library = Tokenizer.from_file(default_path())
    library.encode_special_tokens = True
    return {d: library.encode(t, add_special_tokens=False).ids for d, t in texts.items()}


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_contract(results, texts):
    assert set(results) == set(CONTRACT)
    for name, rows in results.items():
        assert rows and [c for c in rows[0].asDict()][: len(CONTRACT[name])] == CONTRACT[name]
        if name not in ("op6_vector_links", "op9_packing", "op10_html_text"):
            assert sorted(r.doc_id for r in rows) == sorted(texts)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    assert_same(queries.queries()[name](spark, SF), connect(SF), queries.oracle_sql()[name])


def test_pieces(results):
    assert all(r.lossless for r in results["op1_piece_dropout"])


def test_held_out(results):
    for name in ("op2_quality_classifier", "op4_language_id"):
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in results[name])


def test_repeats_by_windows(results, texts):
    seen = collections.Counter()
    for t in texts.values():
        raw = t.encode()
        seen.update(raw[i : i + 400] for i in range(len(raw) - 399))
    for r in results["op5_suffix_dedup"]:
        raw = texts[r.doc_id].encode()
        edge = np.zeros(len(raw) + 1, int)
        for i in range(len(raw) - 399):
            if seen[raw[i : i + 400]] > 1:
                edge[i] += 1
                edge[i + 400] -= 1
        gone = np.cumsum(edge)[:-1] > 0
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum())
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
        assert r.text == kept.decode("utf-8", "ignore")


def test_tokens_equal_library(results, ids):
    at = 0
    for r in sorted(results["op7_token_store"], key=lambda r: r.doc_id):
        want = [*ids[r.doc_id], 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(want), _crc(want))
        at += len(want)


def test_packing_equals_library(results, ids):
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in results["op9_packing"]:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(by) == set(ids)
    for d, pieces in by.items():
        want, at = [*ids[d], 0], 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(want), _crc(want[at : at + r.length]))
            at += r.length
        assert at == len(want)
    assert sorted(sequences) == list(range(len(sequences)))
    padded = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        padded += at < 1024
    assert padded <= 4  # one for each range partition


def test_pages(spark, results):
    pages = spark.read.parquet(f"{SF}/pages.parquet").count()
    got = results["op10_html_text"]
    assert len(got) == pages and all(r.n_chars == len(r.text) and "<" not in r.text for r in got)
