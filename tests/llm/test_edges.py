"""Each operator on nulls, empty and very long texts, repeated rows, empty tables and
extra columns whose names clash with its own."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticklake.llm import html_text, jaccard, language, line_rules, packing, pieces, quality, repeats, token_store, vectors

LONG = " ".join(f"word{i % 977} other{i % 31}" for i in range(30_000))
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, hash bigint, score double, kept string, ids string, x int, owner string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, None, None, "k", 1, 0.5, "k", "i", 3, "o") for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, " \n ", None), (4, LONG, "en"), (5, "the same text once more and again for all", "en"), (5, "the same text once more and again for all", "en"), (6, "☃ ☃", "de"), (None, "no id here at all but words", "en"), (7, "der hund und die katze sind im haus", "de")]
    return docs(spark, rows).cache()


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(4, 8)] + [(4, 1, 0), (None, 1, 0), (5, None, None)], "doc_id bigint, quality int, toxic int")


def test_pieces(odd, none):
    got = pieces.decode_pieces(pieces.encode_pieces(odd, dropout=0.2)).collect()
    assert len(got) == odd.count()
    assert all(r.decoded == (r.text or "") for r in got)
    assert pieces.encode_pieces(none).count() == 0


def test_quality(odd, none, labels):
    got = quality.classify(odd, labels).collect()
    assert len(got) == odd.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert quality.classify(none, labels).count() == 0
    assert {r.score for r in quality.classify(odd, labels.limit(0)).collect()} == {0.5}


def test_jaccard(odd, none):
    got = jaccard.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert [(r.class_id, r.n_links) for r in got if r.doc_id == 5] == [(5, 1), (5, 1)]
    assert sorted((r.class_id, r.n_links) for r in got if r.doc_id in (1, 2, 3)) == [(1, 0), (2, 0), (3, 0)]
    assert jaccard.near_duplicates(none).count() == 0


def test_language(odd, none):
    got = {r.doc_id: r for r in language.identify(odd, language.fit(odd)).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 6)] == ["und"] * 4
    assert language.fit(none) is None
    assert language.identify(none, None).count() == 0
    assert {r.lang_pred for r in language.identify(odd, None).collect()} == {"und"}


def test_repeats(odd, none):
    got = repeats.remove_repeats(odd, length=20, gram=8).collect()
    assert len(got) == odd.count()
    assert [bytes(r.kept) for r in got if r.doc_id == 5] == [b"", b""]
    assert [r.n_bytes for r in got if r.doc_id in (1, 2)] == [0, 0]
    assert repeats.remove_repeats(none).count() == 0


def test_vectors(spark):
    schema = "vec_id bigint, embedding array<float>, label int, nid bigint, raw string, near string"
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [float("inf"), 1.0]), (8, []), (9, [1.0, 0.0, 0.0]), (10, [0.0, 1.0]), (11, [-0.0, 1.0]), (12, [1e-30, 1e-30]), (13, [1.0, 1.0])]
    got = vectors.link_vectors(spark.createDataFrame([(i, e, 0, 1, "r", "n") for i, e in rows], schema)).collect()
    assert len(got) == len(rows)
    n = {r.vec_id: (r.n_links, r.component_id) for r in got}
    assert n == {1: (2, 1), 2: (2, 1), 3: (0, 3), 4: (0, 4), 5: (0, 5), 6: (0, 6), 7: (0, 7), 8: (0, 8), 9: (0, 9), 10: (1, 10), 11: (1, 10), 12: (1, 12), 13: (1, 12)}
    assert vectors.link_vectors(spark.createDataFrame([], schema)).count() == 0


def test_token_store(spark, odd, none, tmp_path):
    for n, rows in enumerate((odd, none)):
        path = str(tmp_path / f"t{n}")
        token_store.write_tokens(rows, path)
        got = token_store.read_tokens(spark, path).orderBy("start").collect()
        assert len(got) == rows.count()
        assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])])[: len(got)].tolist()
        if got:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(token_store.default_path())
            texts = {(r.doc_id, r.text or "") for r in rows.select("doc_id", "text").collect()}
            want = sorted((-1 if d is None else d, library.encode(t, add_special_tokens=False).ids + [2]) for d, t in texts)
            assert sorted({(-1 if r.doc_id is None else r.doc_id, tuple(r.ids)) for r in got}) == [(d, tuple(x)) for d, x in want]
            digests = {(r.start, r.ids_crc32) for r in token_store.read_tokens(spark, path, digest=True).collect()}
            assert digests == {(r.start, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in got}


def test_line_rules(odd, none, labels):
    got = line_rules.judge(odd, line_rules.fit_field(odd, labels)).collect()
    assert len(got) == odd.count()
    assert all(r.base_failed and not r.kept for r in got if r.doc_id != 4)
    assert line_rules.judge(none, line_rules.Field()).count() == 0


def test_packing(odd, none):
    got = packing.pack_documents(odd).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces_ in by.values():
        at = 0
        for offset, length in sorted(pieces_):
            assert offset == at
            at += length
        assert at <= 1024
    assert sorted(by) == list(range(len(by)))
    assert sum(r.length for r in got) == sum(r.doc_tokens for r in got if r.start == 0)
    assert packing.pack_documents(none).count() == 0


def test_html(spark):
    schema = "page_id bigint, url string, html string, host string, wrapper string, text string"
    page = "<html><head><title>t</title></head><body><nav>menu</nav><article><h1>A &amp; B</h1><p>one<br>two<p>three</article><footer>f</footer>"
    rows = [(1, "http://a.org/1", page), (1, "http://a.org/1", page), (2, None, None), (3, "nonsense", ""), (4, "http://b.org/", "<p>x</p>" * 20_000), (5, "http://a.org/2", "<<<>>&#;<article"), (None, "http://c.org", "<div class='comments'>no</div><p>yes")]
    got = html_text.extract_text(spark.createDataFrame([(*r, "h", "w", "t") for r in rows], schema)).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    assert text[1] == "A & B\none two\nthree"
    assert (text[2], text[3], text[None]) == ("", "", "yes")
    assert text[4].count("x") == 20_000
    assert html_text.extract_text(spark.createDataFrame([], schema)).count() == 0


def test_pipeline_keeps_rows_that_share_an_id(spark):
    import corpus_pipeline as pipeline

    long = " ".join(f"passage{i}" for i in range(90))
    texts = [(None, "one text about cats and dogs in the house"), (None, "another text on boats and trains by the sea"), (None, "one text about cats and dogs in the house"), (7, "third text of mountains and rivers in spring"), (7, "fourth text of cities and roads in winter"), (8, "Fourth text of cities, and roads in winter"), (None, None), (None, None), (9, f"nine {long} end"), (9, f"start {long} ten")]
    given = docs(spark, [(i, t, "en") for i, t in texts])
    got = pipeline.table(pipeline.duplicates_stage(spark, given, ""), "kept")
    want = [(None, texts[0][1]), (None, texts[1][1]), (7, texts[3][1]), (7, texts[4][1]), (None, None), (None, None), (9, min(texts[8][1], texts[9][1], key=lambda t: hashlib.sha256(t.encode()).hexdigest()))]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(want, key=repr)
    cut = pipeline.repeats_stage(spark, given, "").collect()
    assert len(cut) == len(texts)
    assert sorted(r.text for r in cut if r.doc_id == 7) == sorted(t for i, t in texts if i == 7)
    assert sorted(r.text for r in cut if r.doc_id == 9) == ["nineend", "startten"]


def test_pipeline_on_odd_tables(spark, tmp_path, odd, none, labels):
    """Each stage on nulls, empty and very long texts, repeated rows, extra columns and an
    empty table; all but the last give the columns of documents."""
    import corpus_pipeline as pipeline

    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for n, rows in enumerate((odd, none)):
        ids = {r.doc_id for r in rows.collect()}
        for name, stage in pipeline.STAGES:
            left = stage(spark, rows, str(tmp_path))
            left.write.parquet(f"{tmp_path}/{name}-{n}")
            got = spark.read.parquet(f"{tmp_path}/{name}-{n}")
            assert {r.doc_id for r in got.collect()} <= ids
            if name != "packing":
                assert left.columns == list(pipeline.COLUMNS)
            if name == "repeats":
                assert got.count() == rows.count()
            if name == "packing":
                assert sum(r.length for r in got.collect()) == sum(r.doc_tokens for r in got.collect() if r.start == 0)


def test_repeats_carry_columns(odd):
    got = {(r.doc_id, r.rest.lang, r.kept_text) for r in repeats.remove_repeats(odd, 20, 8, more=("lang", "key")).collect()}
    assert (1, "en", None) in got and (2, "en", "") in got and (7, "de", "der hund und die katze sind im haus") in got


def test_repeats_of_equal_and_partly_equal_texts(spark):
    a, b = "x" * 5 + "0123456789abcdefghij" + "y" * 5, "0123456789abcdefghij"
    given = spark.createDataFrame([(1, a), (2, a), (3, "p" + b + "q"), (4, "short"), (5, "short")], "doc_id bigint, text string")
    got = {r.doc_id: bytes(r.kept) for r in repeats.remove_repeats(given, 20, 8).collect()}
    # copies of 20 bytes or more go whole, shorter ones stay; a passage that copies hold goes elsewhere too
    assert got == {1: b"", 2: b"", 3: b"pq", 4: b"short", 5: b"short"}
