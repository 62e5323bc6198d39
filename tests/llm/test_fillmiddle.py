"""Fill-in-middle against a version that lists the units, and on messy tables."""

import hashlib
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideline.llm import fillmiddle

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text, fim_rate=50, spm_rate=80, units=TOKEN.findall):
    text = text or ""
    t = units(text)
    d = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    one, two = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim_rate:
        return len(t), "plain", None, None, text
    p, m, s = "".join(t[:one]), "".join(t[one:two]), "".join(t[two:])
    form = "spm" if h[3] % 100 < spm_rate else "psm"
    return len(t), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def rows_of(df):
    made = df.withColumn("back", fillmiddle.restored(F.col("output"), F.col("form")))
    return [(r.doc_id, r.text, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output), r.back) for r in made.collect()]


def same(rows, **how):
    assert rows
    for doc_id, text, got, back in rows:
        assert got == plain(doc_id, text, **how) and back == (text or "")


def test_whole_table(docs):
    rows = rows_of(fillmiddle.transform(docs))
    same(rows)
    assert {r[2][1] for r in rows} == {"plain", "psm", "spm"}


def test_messy(messy, empty):
    same(rows_of(fillmiddle.transform(messy)))
    got = fillmiddle.transform(messy.withColumn("n", F.lit("clash")), fim_rate=100, spm_rate=0)
    same(rows_of(got), fim_rate=100, spm_rate=0)
    assert got.columns == [*messy.columns, "n", "form", "prefix_chars", "middle_chars", "output"]
    assert fillmiddle.transform(empty).count() == 0


def test_marks_and_characters(spark):
    """Texts that hold a mark or parts of one, and cuts between any two characters."""
    texts = ["a <P> b", "x<S>", "<M>", "<P", "<", "<S<M <P", "S>P>M> <<", "ü<\U0001f600 >", " \t", "a", "a\x00b \x85c d"]
    rows = spark.createDataFrame([(i, t) for t in texts for i in range(40)], "doc_id long, text string")
    same(rows_of(fillmiddle.transform(rows, fim_rate=100)), fim_rate=100)
    same(rows_of(fillmiddle.transform(rows, fim_rate=100, units="character")), fim_rate=100, units=list)
    with pytest.raises(ValueError):
        fillmiddle.transform(rows, units="line")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n\tabü\U0001f600 <"), max_size=12), min_size=1, max_size=5))
def test_cuts(texts):
    for units, listed in (("token", TOKEN.findall), ("character", list)):
        r = fillmiddle.Runs(pa.array(texts), units)
        t = [listed(x) for x in texts]
        assert r.count().tolist() == [len(x) for x in t]
        for k in range(max(map(len, t)) + 1):
            want = [min(k, len(x)) for x in t]
            at = r.cuts(pa.array(want).to_numpy())
            assert at.tolist() == [len("".join(x[:u])) for x, u in zip(t, want)]
