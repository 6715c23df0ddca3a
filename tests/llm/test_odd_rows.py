"""Nulls in any column, empty and very long texts, repeated rows, empty tables, and other columns with clashing names."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stradale.llm import decontaminate, html_text, language_id, licenses, near_dups, quality_classifier, quality_rules, sentencepiece, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = " ".join(f"word{k}" for k in range(80))
ROWS = [
    (1, None, "en", "s", None), (2, "", None, "s", 0), (3, " \t\n ", "en", None, 4), (None, PROSE, "en", "s", 1), (None, None, None, None, None), (4, "1234 !!", "en", "s", 7),
    (5, PROSE + " é 日本", "en", "s", 1), (5, PROSE + " é 日本", "en", "s", 1), (6, "a" * 200_000, None, "s", 1), (7, "x y " * 40_000, "fr", "s", 1), (8, PROSE.upper(), "en", "s", 1), (9, "\x00\x01 bad", "en", "s", 1),
]
#: Names that operators use themselves.
CLASH = ("id", "b", "i", "g", "t", "k0", "k1", "rid", "sid", "sig", "name", "key", "body", "score", "lang_pred", "failures", "n_words", "token_ids", "exact", "item_id", "component_id", "n", "m", "comp", "payload", "digest", "refers_to", "page_id", "record_type", "y")


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in CLASH if c not in df.columns})


@pytest.fixture(scope="module")
def docs(spark):
    return clashing(spark.createDataFrame(ROWS, SCHEMA))


@pytest.fixture(scope="module")
def ids():
    return sorted(str(r[0]) for r in ROWS)


def per_row(docs, out, ids):
    """A row per row, and none for an empty table."""
    assert sorted(str(r.doc_id) for r in out(docs).select("doc_id").collect()) == ids
    assert out(docs.limit(0)).count() == 0


def test_near_copies(docs, ids):
    per_row(docs, near_dups.ngram_jaccard_join, ids)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in near_dups.ngram_jaccard_join(docs).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (6, 1, 6), (7, 2, 7), (5, 78, 5), (8, 76, 5), (None, 76, 5), (None, 0, None)} <= got


def test_rules_language_and_tokens(docs, ids):
    per_row(docs, quality_rules.ledger, ids)
    model = language_id.fit(docs)
    per_row(docs, lambda d: language_id.identify(d, model), ids)
    per_row(docs, lambda d: language_id.identify(d, language_id.fit(docs.limit(0))), ids)
    told = {(r.doc_id, r.lang_pred) for r in language_id.identify(docs, model, keep=["doc_id"]).collect()}
    assert {(k, "und") for k in (1, 2, 3, 4, None)} <= told
    pieces = sentencepiece.load()
    per_row(docs, lambda d: sentencepiece.encode(d, pieces, ["doc_id", "source"]), ids)
    coded = sentencepiece.encode(docs, pieces, ["doc_id"])
    assert coded.where("not exact").count() == 0
    assert sorted(str(r.text or "") for r in sentencepiece.decode(coded, pieces, ["doc_id"]).collect()) == sorted(r[1] or "" for r in ROWS)


def test_classifiers(spark, docs, ids):
    labels = clashing(spark.createDataFrame([(k, 1 if k < 5 else 0, None if k == 6 else k % 2) for k in range(1, 10)] + [(None, 1, 1), (5, 0, 1)], "doc_id long, quality int, toxic int"))
    from stradale.llm.sampling import labelled_texts

    for name, fit, score in (("toxic", toxicity.train, toxicity.score), ("quality", quality_classifier.Model, quality_classifier.score)):
        for told in (labels, labels.limit(0)):
            model = fit(*labelled_texts(docs, told, name, 2))
            per_row(docs, lambda d: score(d, model), ids)
            assert score(docs, model).where("score is null or isnan(score) or score < 0 or score > 1").count() == 0


def test_items_and_licenses(spark, docs):
    items = clashing(spark.createDataFrame([(1, PROSE), (1, PROSE), (2, None), (None, "word3 word4 word5"), (3, "")], "item_id long, text string"))
    found = sorted(((r.doc_id, r.item_id) for r in decontaminate.find_items(docs, items).collect()), key=str)
    assert found == sorted([(d, i) for d in (None, 5, 5, 8) for i in (1, 1, None)], key=str)
    assert decontaminate.remove_contaminated(docs, items).count() == len(ROWS) - 4
    assert decontaminate.remove_contaminated(docs, items).columns == docs.columns
    assert decontaminate.remove_contaminated(docs, items.limit(0)).count() == len(ROWS)
    assert decontaminate.find_items(docs.limit(0), items).count() == 0
    assert licenses.scan_licenses(docs).count() == 0 and licenses.scan_licenses(docs.limit(0)).count() == 0


PAGES = [(1, None, None), (None, "u", "<p>" + "x" * 1200), (2, "u\r\nContent-Length: 3\r\n\r\nWARC/1.0", "<p>" + "x" * 1200), (3, "", ""), (4, "u", "<p>" + "x" * 1200), (5, "u", "plain"), (5, "u", "plain"), (6, "v" * 150_000, "<div>" * 3000 + "deep"), (7, "u", "<p>" + "long " * 60_000)]


def test_pages(spark):
    pages = clashing(spark.createDataFrame(PAGES, "page_id long, url string, html string"))
    out = html_text.extract_pages(pages).collect()
    assert len(out) == len(PAGES) and all(r.text is not None and r.n_chars == len(r.text) for r in out)
    assert html_text.extract_pages(pages.limit(0)).count() == 0
    got = warc.round_trip(pages, 4096).collect()
    assert sorted(str(r.page_id) for r in got) == sorted(str(p[0]) for p in PAGES)
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in got}
    assert {(2, "revisit", 4), (4, "response", None), (None, "response", None), (5, "response", None)} <= kinds
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_archive_that_breaks_off(spark, tmp_path):
    parts = [warc.record(k, f"http://h/{k}", b"z" * 900, None) for k in range(20)]
    data = b"".join(parts)
    for cut, whole in ((len(data), 20), (len(data) - 300, 19), (len(data) - len(parts[-1]) + 20, 19), (len(parts[0]) - 5, 0), (sum(map(len, parts[:7])) + 3, 7)):
        folder = tmp_path / str(cut)
        os.makedirs(folder)
        (folder / "a.warc").write_bytes(data[:cut])
        archives = spark.createDataFrame([(str(folder / "a.warc"), cut)], "path string, bytes long")
        for split in (1500, 1 << 20):
            assert sorted(r.page_id for r in warc.read_warc(archives, f"file://{folder}", split).collect()) == list(range(whole))


def test_pipeline_keeps_one_of_each_group_whatever_the_ids(spark, tmp_path):
    other = " ".join(f"other{k}" for k in range(80))
    rows = [(1, PROSE), (1, PROSE), (1, other), (2, PROSE + " end"), (None, other), (None, PROSE), (3, ""), (4, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, docs, str(tmp_path)).collect()]
    assert sorted(kept, key=str) == sorted([(1, PROSE), (1, other), (3, ""), (4, None), (None, None)], key=str)
    assert corpus_pipeline.near_copies(spark, docs.limit(0), str(tmp_path)).count() == 0
    spark.createDataFrame([(1, PROSE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_stages_keep_columns_whatever_their_names(spark, docs, tmp_path):
    spark.createDataFrame([(1, "word3 word4 word5 word6 word7 word8"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name == "tokens":
            assert len(set(out.columns)) == len(out.columns) and {"token_ids", "exact"} <= set(out.columns) and out.count() == len(ROWS)
            continue
        assert out.columns == docs.columns
        assert out.where(" or ".join(f"`{c}` <> 'clash'" for c in CLASH if c not in plain.columns)).count() == 0
        key = lambda df: sorted(str(tuple(r)) for r in df.select(*plain.columns).collect())  # noqa: E731, B023
        assert key(out) == key(stage(spark, plain, str(tmp_path)))
