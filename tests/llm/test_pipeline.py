import corpus_pipeline
from tideline.llm.common import table


def test_stages(spark, folder):
    docs = table(spark, folder, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5
    out = corpus_pipeline.run(spark, folder).toPandas()
    assert list(out.columns)[: len(docs.columns)] == docs.columns
    assert out.doc_id.is_unique and out.round_trip.all() and not (out.parity == False).any()  # noqa: E712
    assert (out.n_chars == out.text.str.len()).all() and 0 < len(out) < docs.count()


def test_stages_on_messy_and_empty_tables(spark, folder, messy, empty):
    """Nulls, empty and very long texts, ties, repeated rows and clashing columns pass every stage but the last with
    their columns; an empty table stays empty."""
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, messy, folder)
        want = messy.columns if name != "sentencepiece encoding" else None
        assert want is None or got.columns == want, name
        n = got.count()
        assert 0 < n <= messy.count(), name
        if name in ("line dedup", "sentencepiece encoding"):
            assert n == messy.count()
    for name, stage in corpus_pipeline.STAGES[:2] + corpus_pipeline.STAGES[4:]:
        assert stage(spark, empty, folder).count() == 0, name
