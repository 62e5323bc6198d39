"""The pipeline's near-duplicate stage against all pairs of shingle sets."""

import re

import pyarrow as pa

import corpus_pipeline
from tideline.llm import nearcopy

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(x):
    w = WORD.findall((x or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def kept_by_all_pairs(texts):
    sets = sorted((i, shingles(x)) for i, x in texts)
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if 10 * both >= 8 * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i for i in root if find(i) == i}


def test_stage_against_all_pairs(spark, folder, docs, texts):
    rows = [(i, x) for i, x in texts]
    # Copies with a few words changed, of similarity from about 0.6 to 1, and copies of those copies.
    for i, x in texts[:60]:
        w = x.split()
        for k, share in enumerate((0.005, 0.015, 0.025, 0.05)):
            v = list(w)
            for at in range(7 + k, len(v), max(1, int(1 / share))):
                v[at] = f"changed{k}"
            rows.append((100_000 + 10 * i + k, " ".join(v)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, table, folder).collect()}
    assert got == kept_by_all_pairs(rows)


def test_dense_groups_against_all_pairs(spark, folder):
    """Chains and clusters around the threshold, where a leader links only some of those that share its hashes."""
    base = [f"w{i}" for i in range(104)]
    rows = []
    for i in range(120):
        v = list(base)
        for at in range(i % 12):
            v[(i * 7 + at * 9) % 104] = f"x{i}y{at}"
        rows.append((i, " ".join(v)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in nearcopy.keep_one(table).collect()} == kept_by_all_pairs(rows)


def test_sets_do_not_depend_on_the_batch(texts):
    rows = pa.array([None, "", *[x for _, x in texts], "Two words", "TWO words"])
    whole = [s.tolist() for s in nearcopy.shingle_sets(rows, 5)]
    assert whole == [next(nearcopy.shingle_sets(rows.slice(i, 1), 5)).tolist() for i in range(len(rows))]
    assert whole == [s.tolist() for at in range(0, len(rows), 7) for s in nearcopy.shingle_sets(rows.slice(at, 7), 5)]
    assert [len(s) for s in whole[2:-2]] == [len(shingles(x)) for _, x in texts] and whole[-1] == whole[-2]
