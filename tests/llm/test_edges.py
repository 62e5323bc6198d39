"""Each operator on messy and on empty tables: nothing crashes, rows are as defined."""

from tideline.llm import decontaminate, fingerprint, langid, linededup, quality, secrets, sentencepiece_bridge, simhash, substring, urlfilter

LABELS = "doc_id long, quality int, toxic int"
ITEMS = "item_id long, text string"


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, None), (5, 0, 0), (8, None, 0), (None, 1, 1), (9, 1, 0), (9, 0, 0)], LABELS)


def items(spark):
    return spark.createDataFrame([(1, "w0 w1 w2 w3 w4 w5 w6 w7"), (2, None), (3, ""), (None, "the quick brown fox jumps over it"), (4, "short one")], ITEMS)


def test_quality(spark, messy, empty):
    got = quality.score(messy, labels(spark)).toPandas()
    assert len(got) == 13 and got.score.between(0, 1).all() and set(got.predicted) <= {0, 1}
    assert got.held_out.notna().all()
    assert quality.score(empty, labels(spark)).count() == 0
    assert (quality.score(messy, labels(spark).limit(0)).toPandas().score == 0.5).all()
    assert quality.keep_good(messy, labels(spark)).columns == messy.columns


def test_decontamination(spark, messy, empty):
    got = decontaminate.contaminated(messy, items(spark)).toPandas()
    assert len(got) == 13 and set(got[got.contaminated].doc_id) == {5, 6}
    assert decontaminate.contaminated(empty, items(spark)).count() == 0
    assert not decontaminate.contaminated(messy, items(spark).limit(0)).toPandas().contaminated.any()
    assert decontaminate.keep_clean(messy, items(spark)).count() == 11


def test_substring(messy, empty):
    got = substring.dedup_substrings(messy).toPandas()
    by = {(r.doc_id, r.n_words): r for r in got.itertuples()}
    assert len(got) == 13 and by[(6.0, 30_000)].n_removed == 30_000 and by[(5.0, 30_000)].n_removed == 0
    assert by[(6.0, 30_000)].kept == "" and len(got[got.doc_id == 1]) == 3 and got[got.doc_id == 4].kept.tolist() == [""]
    assert substring.dedup_substrings(empty).count() == 0


def test_lines(messy, empty):
    got = linededup.dedup_lines(messy).toPandas()
    assert len(got) == 13 and got[got.doc_id == 2].n_removed.tolist() == [1]
    # A null id is first in document order: the copies with an id lose the line.
    assert got[got.doc_id.isna() & got.text.notna()].n_removed.tolist() == [0]
    assert got[got.doc_id == 7].text.tolist() == [" \n\t \n"] and got[got.doc_id == 4].text.isna().all()
    assert linededup.dedup_lines(empty).count() == 0


def test_simhash(messy, empty):
    got = simhash.near_duplicates(messy).toPandas()
    assert len(got) == 13 and set(got[got.doc_id.isin([1, 2])].component_id) <= {1, 9}
    assert got[got.doc_id == 3].fingerprint.tolist() == ["0" * 16]
    assert set(got[got.doc_id.isin([3, 4, 7])].component_id) == {3}
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(messy)
    assert kept.columns == messy.columns and kept.count() == len({(r.fingerprint) for r in got.itertuples()})


def test_langid(messy, empty):
    got = langid.predict(messy).toPandas()
    assert len(got) == 13 and (got[got.doc_id.isin([3, 4, 7, 8])].lang_pred == "und").all()
    assert (got[got.doc_id.isin([2, 9])].lang_pred == "en").all() and got.score.between(0, 1).all()
    assert langid.predict(empty).count() == 0


def test_fingerprints(messy, empty):
    got = fingerprint.edit_likeness(messy).toPandas()
    assert len(got) == 13 and got[got.doc_id == 1].fingerprint.nunique() == 2
    assert got.near_edited.between(0, 1).all() and got.near_next.between(0, 1).all()
    assert fingerprint.edit_likeness(empty).count() == 0


def test_encoding(spark, messy, empty):
    model = sentencepiece_bridge.model_bytes(spark, sentencepiece_bridge.default_model())
    got = sentencepiece_bridge.encode(messy, model, parity_every=1)
    rows = got.toPandas()
    full = rows[rows.text.notna()]
    assert len(rows) == 13 and full.parity.all() and rows[rows.text.isna()].ids.isna().all()
    assert full.round_trip.tolist() == [x.find("▁") < 0 for x in full.text]
    back = sentencepiece_bridge.decode(got, model).toPandas()
    assert all(r.decoded == r.text for r in back[back.round_trip == True].itertuples())  # noqa: E712
    assert sentencepiece_bridge.encode(empty, model).count() == 0


def test_secrets(spark, messy, empty):
    findings = secrets.labelled_findings(spark, 400)
    words = secrets.dictionary(secrets.default_vocabulary())
    extra = spark.createDataFrame([(21, 'x token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" y', "src1"), (22, "card 4785380592391139 and mail8.example.com", None), (23, 'x token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" y', None)], "doc_id long, text string, source string")
    got = secrets.scan(messy.select("doc_id", "text", "source").unionByName(extra), findings, words)
    rows = got.toPandas()
    assert set(rows[rows.secret].doc_id) == {21, 23} and set(rows.doc_id) == {21, 22, 23}
    assert all(r.candidate == extra.toPandas().set_index("doc_id").text[r.doc_id][r.start : r.end] for r in rows.itertuples())
    assert "[secret]" in secrets.redact(extra, got).toPandas().set_index("doc_id").text[21]
    assert secrets.scan(empty, findings, words).count() == 0


def test_urls(spark):
    rows = [(1, "HTTP://A.Example.COM/en/7x?q#z"), (2, None), (3, "no scheme"), (4, "http://x.net"), (5, ""), (None, "https://www.EXAMPLE.net/de/8"), (7, "http://com/en/1"), (7, "http://com/en/1"), (8, "http://xcom/en/"), (9, "ftp://a.org/es/#x"), (10, "http://b.net/de/9/ü")]
    pages = spark.createDataFrame([(i, u, "h", "clash") for i, u in rows], "page_id long, url string, html string, host string")
    got = urlfilter.judge(pages).toPandas().sort_values("page_id", kind="stable")
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.itertuples()}
    assert len(got) == len(rows) and by[1] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert by[2][:3] == ("", "", None) and by[3][:3] == ("", "", None) and by[4] == ("x.net", "", None, "allow")
    assert by[7] == ("com", "/en/1", "com/en/", "block") and by[8][2] is None and by[9][2:] == ("org/es/", "block") and by[10][2:] == ("net/de/", "block")
    assert got[got.page_id.isna()].verdict.tolist() == ["allow"]
    assert urlfilter.judge(pages.limit(0)).count() == 0
