"""The pipeline's near-dedup goes through SimHash balls, and loses no pair of the similarity."""

import corpus_pipeline
from test_nearcopy import kept_by_all_pairs

from tideline.llm import simhash


def test_stage_links_by_fingerprints_and_keeps_all_pairs(spark, folder, monkeypatch):
    base = "one two three four five six seven eight nine ten".split()
    word = lambda i, j: f"{base[(i * 7 + j * 3) % 10]}{(i * 31 + j * j) % 97}"
    rows = []
    for i in range(12):
        words = [word(i, j) for j in range(120)]
        for k, cut in enumerate((0, 1, 2, 4, 9, 30)):  # of the last words that differ
            rows.append((10 * i + k, " ".join(words[: 120 - cut] + [f"x{i}{k}{j}" for j in range(cut)])))
    rows += [(900, ""), (901, None), (902, rows[0][1])]
    seen = []
    links = simhash.links
    monkeypatch.setattr(simhash, "links", lambda fps, radius: seen.append((fps.count(), radius, links(fps, radius).count())) or links(fps, radius))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, folder)
    assert {r.doc_id for r in kept.collect()} == kept_by_all_pairs(rows)
    (fingerprints, radius, linked), = seen
    assert fingerprints > 12 and radius == 3 and linked > 0
