"""Decontamination looks at each place of a text that holds an item's template."""

from tideline.llm import decontaminate

A = "If Alice has 12 apples and she gives 5 apples to Bob then how many km did Alice walk with 12 kg of fruit"
B = "If Carol has 31 apples and she gives 5 apples to Bob then how many km did Erin walk with 84 kg of fruit"


def test_second_place_of_a_template(spark):
    items = spark.createDataFrame([(1, A), (2, B)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"{B} . so then we ask again : {A}"), (2, B.replace("84", "85").replace("Bob", "Carol"))], "doc_id long, text string")
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {1: [1, 2], 2: []}
    one = {r["doc_id"] for r in decontaminate.contaminated(docs, items.where("item_id = 1")).where("contaminated").collect()}
    assert one == {1}
