"""What the contract of the round fixes, by its own words."""

from tideline.llm import urlfilter


def test_each_rule_says_what_the_contract_says(spark):
    """block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/; hosts and all subdomains."""
    rows = {1: ("http://a.com/en/1", "com/en/", "block"), 2: ("http://w.example.com/en/70", "example.com/en/7", "allow"), 3: ("http://casino.net/de/1", "net/de/", "allow"), 4: ("http://example.net/de/80?x", "example.net/de/8", "block"), 5: ("http://b.org/es/#x", "org/es/", "block"), 6: ("http://W.Example.NET/de/7", "net/de/", "allow")}
    pages = spark.createDataFrame([(i, u) for i, (u, *_) in rows.items()], "page_id long, url string")
    assert {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(pages).collect()} == {i: w[1:] for i, w in rows.items()}
