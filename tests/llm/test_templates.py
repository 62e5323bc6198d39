"""Items that windows of plain words, whole lines, or both ways to join find."""

import pytest

from tideline.llm import decontaminate

ITEM = "If Alice has 12 apples and she gives 5 apples to Bob then how many km did Alice walk with 12 kg of fruit"
ASK = "we ask: if {a} has {n} apples and she gives 7 apples to Dave then how many km did {b} walk with {m} kg of fruit"


@pytest.mark.parametrize("most", [0, 250_000])
def test_items(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", most)
    items = spark.createDataFrame([(1, ITEM), (2, "12 34 56 78 90 11"), (3, "Paris"), (4, "red, green blue"), (5, None), (6, "!!!"), (None, "zig zag zog zug zeg")], "item_id long, text string")
    bad, copy = ASK.format(a="Carol", b="Erin", n=99, m=98), ITEM
    rows = [
        (1, f"{bad}\n{copy}", [1]),
        (2, f"{copy}\n{bad}", [1]),
        (3, bad, []),
        (4, "so 12 34 56 78 90 11 it was", [2]),
        (5, "so 12 34 56 78 91 it was 1 2 3 4 5 6", []),
        (6, "the answer is\n Paris!\nof course", [3]),
        (7, "Paris is a town", []),
        (8, "Red green, blue", [4]),
        (9, "red green blue yellow", []),
        (10, None, []),
        (11, "", []),
        (None, "Paris", [3]),
    ]
    docs = spark.createDataFrame([(i, t, 1) for i, t, _ in rows], "doc_id long, text string, item_id int")
    got = decontaminate.contaminated(docs, items).collect()
    assert {r.doc_id: (r.contaminated, r.item_ids) for r in got} == {i: (bool(w), w) for i, _, w in rows}
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0
    kept = decontaminate.keep_clean(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _, w in rows if not w}


def test_a_stray_window_does_not_pass_for_an_alignment(spark):
    """Slots are checked over the run that matched: five words of the item elsewhere change nothing."""
    ask = "In the morning Alice walks 5 km and then Bob walks 7 km so then how many km did Alice walk in all"
    right = "In the morning Carla walks 8 km and then David walks 2 km so then how many km did Carla walk in all"
    wrong = "In the morning Carla walks 8 km and then David walks 8 km so then how many km did David walk in all"
    stray = "then how many km did"
    half = len(wrong.split()) // 2
    inside = " ".join([*wrong.split()[:half], stray, *wrong.split()[half:]])
    texts = [right, wrong, f"{stray} it is. {wrong}", f"{wrong}. so {stray} it", inside, ask, f"so we say here {ask} and more", f"{wrong} and what then {right}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, ask)], "item_id long, text string")
    got = {r.doc_id: r.contaminated for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {0: True, 1: False, 2: False, 3: False, 4: False, 5: True, 6: True, 7: True}


def test_words_put_in_or_left_out(spark):
    """A run goes on over some words more or less; windows far apart are no run."""
    words = [f"word{chr(97 + i // 5)}{chr(97 + i % 5)}" for i in range(24)]
    ask = " ".join(words)
    more = " ".join([*words[:12], "odd", "ones", *words[12:]])
    less = " ".join([*words[:11], *words[13:]])
    apart = " ".join([*words[:9], *["filler"] * 60, *words[15:]])
    docs = spark.createDataFrame(list(enumerate([more, less, apart])), "doc_id long, text string")
    got = {r.doc_id: r.contaminated for r in decontaminate.contaminated(docs, spark.createDataFrame([(1, ask)], "item_id long, text string")).collect()}
    assert got == {0: True, 1: True, 2: False}


def test_a_text_that_repeats_an_item_very_often(spark):
    ask = "the quick brown fox jumps over the lazy dog again"
    docs = spark.createDataFrame([(1, " ".join([ask] * 1500)), (2, "nothing at all")], "doc_id long, text string")
    got = {r.doc_id: r.contaminated for r in decontaminate.contaminated(docs, spark.createDataFrame([(1, ask)], "item_id long, text string")).collect()}
    assert got == {1: True, 2: False}
