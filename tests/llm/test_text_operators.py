import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from stradale.llm import decontaminate, html_text, language_id, licenses, quality_classifier, quality_rules, sentencepiece, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, "en", None, 0), (2, "", None, "s", 0), (3, " \n ", "en", "s", 3), (4, "1234 !!", "en", "s", 7), (None, "word " * 60, "en", "s", 300), (5, "a" * 50_000, "en", "s", 50_000), (5, "a" * 50_000, "en", "s", 50_000)]


def repeated(tokens):
    windows = [tuple(tokens[i : i + 3]) for i in range(len(tokens) - 2)]
    return len({i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)})


def test_quality_measures(spark):
    r = random.Random(1)
    for _ in range(200):
        text = " ".join(r.choice("abc#é") for _ in range(r.randint(0, 30)))
        assert quality_rules.measure(text.encode())[4] == repeated(text.split())
    assert quality_rules.measure("é# x\n\né# x\ny".encode())[:5] == (5, 7, 2, 1, 0)
    rows = quality_rules.ledger(spark.createDataFrame(ODD, SCHEMA), keep=["doc_id", "lang"])
    assert rows.count() == len(ODD) and quality_rules.ledger(spark.createDataFrame([], SCHEMA)).count() == 0
    table = {x.rule: x for x in quality_rules.ablations(rows, "v2").collect()}
    assert table["few_words"].n_failed == 6 and table["few_words"].n_kept == 0


def test_items_in_documents(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([3, 5, 16, 40, 60])] + [(9, None), (10, "")]
    docs = [(k, " ".join(word() for _ in range(200))) for k in range(20)]
    docs += [(100 + k, docs[k][1] + " " + (t or "").upper() + " " + docs[k][1]) for k, t in items]
    cut = items[3][1].split()
    docs += [(200, " ".join(cut[:38])), (201, " ".join(cut[:20])), (202, None), (203, "")]

    def grams(t, n):
        w = t.lower().split()
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    want = set()
    for i, t in items:
        n = min(5, len((t or "").split()))
        for d, text in docs:
            if n and text and len(grams(t, n) & grams(text, n)) * 100 >= 80 * len(grams(t, n)):
                want.add((d, i))
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontaminate.find_items(a, b).collect()} == want
    assert {x.doc_id for x in decontaminate.remove_contaminated(a, b).collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert decontaminate.find_items(a, b.limit(0)).count() == 0


def test_pages():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header>Top</header><nav><a href=x>Home</a></nav><div class="cookie-notice">We</div>
    <div id=content><h1>A &amp; B</h1><p>One  two<b>three</b></p><p>Four &#233;</p></div><aside>Side</aside><form>Send</form><div class="comments"><p>Nice post, thanks a lot for it</p></div><script>var t="</p>"</script><footer>(c)</footer></body></html>"""
    assert html_text.extract(page) == "A & B\nOne twothree\nFour é"
    assert html_text.extract("<nav>m</nav><article><p>x<p>y<br>z</article><p>later") == "x\ny\nz"
    assert html_text.extract(None) == "" and html_text.extract("<p") == "" and html_text.extract("plain") == "plain"


def test_warc_round_trip_with_records_in_payloads(spark):
    trap = warc.record(99, "http://trap", b"y" * 50).decode("latin-1")
    rows = [(k, f"http://h/{k}", ("é" * 700 if k % 3 == 0 else f"page {k} " * 40) + (trap if k % 4 == 0 else "")) for k in range(60)] + [(70, None, None), (71, "u v", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(pages, 2048).collect()}
    assert set(got) == {r[0] for r in rows}
    for k, _, text in rows:
        r = got[k]
        same = [j for j, _, t in rows if t == text] if len((text or "").encode()) >= 1000 else [k]
        assert r.record_type == ("response" if k == max(same) else "revisit") and r.refers_to == (None if k == max(same) else max(same))
        assert r.length == len((text or "").encode()) and (r.payload is None or bytes(r.payload).decode() == (text or ""))
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_sentencepiece_against_one_at_a_time():
    model = sentencepiece.load()
    r, known = random.Random(4), {}
    texts = ["", " ", "  a  b\n\n c ", "▁x▁▁ y", "日本語 🙂🙃", "\x00\x01é", "a" * 300 + " " * 20] + ["".join(r.choice("ab é▁\n the日") for _ in range(r.randint(1, 60))) for _ in range(200)]
    model.learn(texts, known)
    for t in texts:
        ids = np.frombuffer(model.encode(t, known), "<i4").tolist()
        assert model.decode(ids) == t and ids == (model.viterbi(" " + t) if t else [])


def test_patience_alignment():
    scan = licenses.Scanner(licenses.TEMPLATES).scan
    notice = licenses.TEMPLATES["mit"]
    assert [x[0] for x in scan(f"the of {notice} and {notice.upper()} the".encode())] == ["mit", "mit"]
    assert scan(b"nothing here is licensed") == [] and scan(None) == [] and scan(b"") == []
    long = licenses.TEMPLATES["mit-text"].replace("sublicense, ", "").replace("deal in", "work with")
    assert "mit-text" in {x[0] for x in scan(("Words before. " + long + " after").encode())}
    r = random.Random(5)
    for _ in range(300):
        a, b = ([r.choice(b"abcdefgh") for _ in range(r.randint(0, 12))] for _ in "xy")
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p < q and s < t for (p, s), (q, t) in zip(pairs, pairs[1:]))


def corpus(spark):
    r = random.Random(6)
    kinds = {"en": "the and of to in that with".split(), "fr": "le la une des et dans pour".split()}
    rows, labels = [], []
    for k in range(240):
        lang = "en" if k % 3 else "fr"
        words = [r.choice(kinds[lang]) + r.choice(["", "x", "yz"]) for _ in range(80)]
        toxic = k % 5 == 0
        if toxic:
            words[10:10] = [r.choice(["blorgh", "blorghy", "blorrgh"])]
        junk = k % 7 == 0
        rows.append((k, " ".join(w + "###" if junk else w for w in words), lang, "s", 1))
        labels.append((k, int(not junk), int(toxic)))
    return spark.createDataFrame(rows + ODD, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {x[0]: x for x in labels}


def test_classifiers_on_held_out_rows(spark):
    from stradale.llm.sampling import fold, labelled_texts

    docs, labels, truth = corpus(spark)
    held = {r.doc_id for r in docs.where(fold("doc_id", 4) == 2).collect()} & set(truth)
    for name, column, fit, module in (("toxic", 2, toxicity.train, toxicity), ("quality", 1, quality_classifier.Model, quality_classifier)):
        scores = module.score(docs, fit(*labelled_texts(docs, labels, name, 2))).collect()
        assert len(scores) == docs.count() and all(0 <= r.score <= 1 for r in scores)
        got = {r.doc_id: r.score for r in scores if r.doc_id in held}
        right = [got[i] for i in held if truth[i][column] == 1]
        wrong = [got[i] for i in held if truth[i][column] == 0]
        assert np.mean([x > y for x in right for y in wrong]) > 0.9
        assert module.score(docs, fit([], [], 0.5)).count() == docs.count()
    told = {r.doc_id: (r.lang, r.lang_pred) for r in language_id.identify(docs, language_id.fit(docs)).collect()}
    assert all(a == b for i, (a, b) in told.items() if i in truth and i > 5)
    odd = language_id.identify(spark.createDataFrame(ODD[:4], SCHEMA), language_id.fit(docs))
    assert {r.lang_pred for r in odd.collect()} == {"und"}


def test_pipeline_stages(spark, tmp_path):
    docs, _, _ = corpus(spark)
    copies = docs.where("doc_id = 1").withColumn("doc_id", F.lit(1000).cast("long"))
    docs.unionByName(copies).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(docs.where("doc_id = 2").first().text.split()[:20]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert 1 in out and not {1000, 2} & set(out) and all(r.exact for r in out.values())
    assert set(out) - {None} == {i for i in texts if i is not None and i % 7 and i != 2}
    assert len(out[1].token_ids) > 80
