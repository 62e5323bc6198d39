"""Toxicity: held-out accuracy, lengths against single calls of the library, and messy tables."""

import random

import numpy as np
import pyarrow as pa
import zstandard

from tideline.llm import toxicity

LABELS = "doc_id long, toxic int, quality int"


def area(score, label):
    """Area under the ROC curve."""
    order = np.argsort(score, kind="stable")
    _, inverse, times = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(times) - (times - 1) / 2)[inverse]
    n = label.sum()
    assert len(order) == len(label)
    return (rank[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


def test_held_out(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == docs.count()
    rows = got.where("held_out").join(labels, "doc_id").toPandas()
    y = rows.toxic.to_numpy()
    assert len(rows) > 700 and area(rows.score.to_numpy(), y) > 0.93
    assert rows[y == 1].predicted.mean() > 0.85 and rows[y == 0].predicted.mean() < 0.06
    assert ((rows.score >= 0.5) == (rows.predicted == 1)).all()


def words(r, k):
    return ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(k)]


def texts(toxic, n=120, seed=0):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        w = words(r, 60)
        for _ in range(3 if toxic else 0):
            w.insert(r.randrange(len(w)), r.choice(["grobian", "schuft", "zzyzx"]))
        out.append(" ".join(w))
    return out


def test_small_corpus(spark, messy, empty):
    """Planted words tell, wherever they stand and in texts of any length; other texts stay clean."""
    m = toxicity.fit(texts(True), texts(False, seed=1))
    long = texts(False, 1, 9)[0] + " "
    fresh = texts(True, 40, 5) + texts(False, 40, 6)
    s = m.score(pa.array([*fresh, None, "", " \n", long * 300, "Schuft grobian, SCHUFT!", "x" * 100_000 + "grobian"], pa.string()))
    assert (s[:40] >= 0.5).mean() > 0.95 and (s[40:80] >= 0.5).mean() < 0.05
    assert (s[80:84] < 0.5).all() and s[84] >= 0.5 and np.isfinite(s).all() and ((s >= 0) & (s <= 1)).all()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(fresh)], "doc_id long, text string")
    alarms = toxicity.windows_of(docs, m).toPandas()
    assert set(alarms.text) >= {"grobian", "schuft", "zzyzx"} and (alarms.advantage >= m.threshold).all()
    assert all(fresh[r.doc_id].split()[r.window] == r.text for r in alarms.itertuples())


def test_lengths():
    """Batches of windows against single calls, and windows of several words."""
    m = toxicity.dictionaries(texts(True), texts(False, seed=1), 1)
    some = ["grobian", "abc", "ü\U0001f600", "w" * 300]
    off, diff = m.advantages(pa.array([" ".join(some), None, "abc abc"]))
    assert off.tolist() == [0, 4, 4, 6] and diff[1] == diff[4] == diff[5]

    def length(content, piece):
        how = toxicity.Lengths(b"").params
        d = zstandard.ZstdCompressionDict(toxicity.widened(content), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress(toxicity.widened(piece) + toxicity.PAD))

    for w, d in list(zip(some, diff))[:3]:
        piece = b" " + w.encode()
        assert d == length(m.ordinary, piece) - length(m.toxic, piece)
    assert diff[0] > 0 >= diff[1]
    off, flat = toxicity.windows(pa.array(["A b  c", None, "", "d e f g h"]), 2)
    assert off.tolist() == [0, 2, 2, 2, 5] and flat.to_pylist() == ["a b", "c", "d e", "f g", "h"]


def test_near_copies_count_once():
    base = texts(False, 1, 3)[0].split()
    copies = [" ".join([*base[:k], "changed", *base[k + 1 :]]) for k in range(0, 60, 2)]
    assert len(toxicity.unlike(copies)) <= 5 and len(toxicity.unlike(texts(False, 30))) == 30
    assert toxicity.unlike(["", " ", "a", "a"]) == ["", "a"]


def test_messy(spark, messy, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, None), (5, 0, 0), (8, None, 0), (None, 1, 1), (9, 1, 0), (9, 0, 0)], LABELS)
    got = toxicity.score(messy, labels).toPandas()
    assert len(got) == 13 and got.score.between(0, 1).all() and set(got.predicted) <= {0, 1} and got.held_out.notna().all()
    assert toxicity.score(empty, labels).count() == 0
    assert (toxicity.score(messy, labels.limit(0)).toPandas().score == 0.5).all()
    same = toxicity.score(messy, labels).toPandas()
    assert sorted(map(tuple, same[["score"]].values)) == sorted(map(tuple, got[["score"]].values))
