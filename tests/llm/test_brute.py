"""Operators against plain versions and held-out accuracy on small tables."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tideline.llm import components, decontaminate, fingerprint, langid, linededup, quality, registry, secrets, sentencepiece_bridge, simhash, substring, urlfilter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def auc(y, s):
    rank = s.rank().to_numpy()
    good = y.sum()
    return (rank[y.to_numpy() == 1].sum() - good * (good + 1) / 2) / (good * (len(y) - good))


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.01"
    got = registry.op1_quality(spark, folder).toPandas().merge(spark.read.parquet(f"{folder}/labels.parquet").toPandas(), on="doc_id")
    out = got[got.held_out]
    assert auc(out.quality, out.score) > 0.97 and out[out.quality == 1].predicted.mean() > 0.97


def test_langid_held_out(spark):
    folder = "/root/testdata/sf0.01"
    got = registry.op9_langid(spark, folder).toPandas().merge(spark.read.parquet(f"{folder}/documents.parquet").toPandas(), on="doc_id")
    out = got[got.held_out]
    assert (out.lang == out.lang_pred).mean() > 0.97


def test_forward_backward():
    r = np.random.default_rng(0)
    crf = langid.Crf(["a", "b", "c"], [[], [], []])
    crf.move = r.normal(size=(3, 3))
    score = r.normal(size=(4, 3))
    m, moves = crf.marginals(score, np.array([0, 4]), pairs=True)
    paths = np.array(np.meshgrid(*[range(3)] * 4)).reshape(4, -1)
    weight = np.exp([sum(score[t, p[t]] for t in range(4)) + sum(crf.move[p[t], p[t + 1]] for t in range(3)) for p in paths.T])
    weight /= weight.sum()
    want = np.array([[weight[paths[t] == j].sum() for j in range(3)] for t in range(4)])
    assert np.allclose(m, want) and np.isclose(moves.sum(), 3)


def test_substring(spark, folder, texts):
    got = {r["doc_id"]: r for r in registry.op5_substring(spark, folder).collect()}
    first = {}
    for i, x in texts:
        w = WORD.findall(x or "")
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if first.setdefault(tuple(w[j : j + 13]), i) < i:
                gone[j : j + 13] = [True] * 13
        kept = " ".join(a for a, g in zip(w, gone, strict=True) if not g)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(w), sum(gone), sha(kept))


@pytest.mark.parametrize("most", [20, 200, 10_000])
def test_index_against_search(most):
    r = np.random.default_rng(most)
    for _ in range(20):
        k = int(r.integers(1, 30))
        size = r.integers(13, 22, k)
        words = r.integers(0, 3, size.sum()).astype(np.uint64)
        words[r.random(len(words)) < 0.9] = 0
        ends, least = np.concatenate([[0], np.cumsum(size)]), r.integers(0, 50, k)
        windows = size - 12
        first = {}
        keys = [(i, tuple(words[ends[i] + j : ends[i] + j + 13])) for i in range(k) for j in range(windows[i])]
        for i, q in keys:
            first[q] = min(first.get(q, 99), least[i])
        assert substring.first_docs(words, ends, windows, least, most=most).tolist() == [first[q] for _, q in keys]


def test_lines(spark, docs, texts):
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs).select("doc_id", "text").collect()}
    seen, holders = [], defaultdict(list)
    for i, x in texts:
        kept = []
        for line in x.split("\n"):
            s = frozenset(WORD.findall(line))
            common = defaultdict(int)
            for w in s:
                for j in holders[w]:
                    common[j] += 1
            if not s or not any(c / (len(s) + len(seen[j]) - c) >= 0.8 for j, c in common.items()):
                kept.append(line)
            if s:
                seen.append(s)
                for w in s:
                    holders[w].append(len(seen) - 1)
        assert got[i] == "\n".join(kept)


def test_simhash(spark, folder, texts):
    def fp(x):
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x or ""))
        if not w:
            return 0
        runs = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
        h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    f = [(i, fp(x)) for i, x in texts]
    root = {i: i for i, _ in f}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in f:
        for j, b in f:
            if i < j and (a ^ b).bit_count() <= 3:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in registry.op8_simhash(spark, folder).collect()}
    assert got == {i: (f"{x:016x}", find(i)) for i, x in f}


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201)]
    got = {r[0]: r[1] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(51)} == {0} and {got[i] for i in range(100, 160)} == {100} and got[201] == 200


def test_fingerprint_is_homomorphic(spark):
    rows = spark.createDataFrame([("ab", "one two\nthree four"), ("ba", "three four\n\none two"), ("a", "one two"), ("b", "three four"), ("c", "three fours")], "k string, text string")
    v = {r["k"]: r["vector"] for r in fingerprint.fingerprints(rows, ["k"]).collect()}
    assert v["ab"] == v["ba"] and v["b"] != v["c"]
    frame = spark.createDataFrame([(v["ab"], v["a"], v["b"])], "x array<long>, a array<long>, b array<long>")
    got = frame.select(fingerprint.insert(frame.a, frame.b), fingerprint.delete(frame.x, frame.a)).first()
    assert got[0] == v["ab"] and got[1] == v["b"]


def test_edited_texts(spark, folder, texts):
    got = {r["doc_id"]: r for r in registry.op10_fingerprint(spark, folder).collect()}
    for (i, x), (_, nxt) in zip(texts, texts[1:] + texts[:1], strict=True):
        n = len(x) // 4
        edited = x[: len(x) - n] + nxt[:n]
        assert got[i]["n_chars"] == len(x) and got[i]["edited_sha256"] == sha(edited)
        assert (got[i]["fingerprint"] == got[i]["edited_fingerprint"]) == (x == edited)
    near = np.mean([r["near_edited"] for r in got.values()]) - np.mean([r["near_next"] for r in got.values()])
    assert near > 0.3


def test_decontamination(spark, folder, texts):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    runs = lambda x, k=8: {tuple(w[i : i + k]) for w in [x.split()] for i in range(len(w) - k + 1)}
    every = set().union(*(runs(x) for x in items.values()))
    want = {i for i, x in texts if runs(x) & every}
    got = registry.op4_decontaminate(spark, folder).where("contaminated").toPandas()
    assert set(got.doc_id) == want


def test_reparameterised_question(spark):
    item = spark.createDataFrame([(1, "If Alice has 12 apples and she gives 5 apples to Bob then how many km did Alice walk with 12 kg of fruit")], "item_id long, text string")
    ask = "we ask: if {a} has {n} apples and she gives 7 apples to Dave then how many km did {b} walk with {m} kg of fruit"
    docs = spark.createDataFrame([(1, ask.format(a="Carol", b="Carol", n=99, m=99)), (2, ask.format(a="Carol", b="Erin", n=99, m=98))], "doc_id long, text string")
    got = {r["doc_id"]: r["contaminated"] for r in decontaminate.contaminated(docs, item).collect()}
    assert got == {1: True, 2: False}


def test_unigram_model_is_rebuilt():
    def field(number, kind, data):
        return bytes([number << 3 | kind]) + (bytes([len(data)]) + data if kind == 2 else data)

    import struct

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("▁", -2.0, 1), ("▁ab", -1.0, 1), ("a", -3.0, 1), ("b", -3.5, 1), ("c", -4.0, 1), ("bc", -3.6, 1)]
    model = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([k]))) for p, s, k in pieces)
    model += field(2, 2, field(3, 0, b"\x01")) + field(3, 2, field(1, 2, b"identity") + field(3, 0, b"\x01") + field(4, 0, b"\x01"))
    m = sentencepiece_bridge.parse(model)
    assert m.kind == 1 and m.extra_spaces_removed and len(m.pieces) == 9
    ours, theirs = sentencepiece_bridge.Backend(model), sentencepiece_bridge.original(model)
    texts = ["ab c", "abc", "  ab   bc ", "", "a b"]
    assert ours.encode(texts)[0].to_pylist() == theirs.encode(texts)


def test_forest_on_labelled_findings(spark):
    words = secrets.dictionary(secrets.default_vocabulary())
    held = secrets.labelled_findings(spark, 600, seed=77).toPandas()
    make = secrets.Features(words)
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = spark.createDataFrame([(make.row(r.candidate, r.before, r.after, r.path), int(r.label)) for r in held.itertuples()], "features array<double>, label int")
    got = secrets.train(secrets.labelled_findings(spark, 1500), words).transform(rows.withColumn("features", array_to_vector("features"))).select("label", vector_to_array("probability")[1].alias("p")).toPandas()
    assert ((got.p >= 0.5) == (got.label == 1)).mean() > 0.95


def test_url_models(spark, folder):
    got = urlfilter.judge(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")).toPandas()
    free = got[got.rule.isna()]
    bad = free.host.str.contains(r"casino|bets|pills|ads-track|adult|spam")
    assert (free[bad].verdict == "block").mean() > 0.95 and (free[~bad].verdict == "allow").mean() > 0.99


def test_labels_of_mixed_text(spark):
    """Words of lines of two languages get their own labels; a 70th language is learned too."""
    r = np.random.default_rng(3)
    sounds = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "ter"], "cc": ["ión", "que", "ñas"]}
    word = lambda k: "".join(r.choice(sounds[k], 3))
    line = lambda k, n: " ".join(word(k) for _ in range(n))
    rows = [(i, "\n".join(line(k, 8) for _ in range(5)), k) for i, k in enumerate(sorted(sounds) * 30)]
    rows += [(1000 + i, f"zz{i} yy{i} xx{i}", f"l{i:02}") for i in range(70)]
    crf = langid.trained(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(crf.languages) > 40
    mixed = spark.createDataFrame([(1, line("aa", 400) + " " + line("bb", 300)), (2, "12 ?"), (3, line("cc", 5))], "doc_id long, text string")
    got = {x.doc_id: x for x in langid.identify(mixed, crf).collect()}
    assert [(x.first, x.last, x.lang) for x in got[1].labels] == [(0, 399, "aa"), (400, 699, "bb")] and got[1].switches == 1 and got[1].lang_pred == "aa"
    assert got[2].labels == [] and got[2].lang_pred == "und" and got[3].lang_pred == "cc"
