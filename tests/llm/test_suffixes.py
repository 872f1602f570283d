"""Public suffixes and registered domains from a table of rules, and reputation by them."""

from pyspark.sql import functions as F

from voxmill.llm import url_filter

RULES = ["com", "uk", "co.uk", "sch.uk", "*.sch.uk", "a.b.c", "*.ck", "!www.ck", "*.x.jp", "!city.x.jp", "x.jp", "jp"]


def plain(host):
    """(suffix, domain) by going through all rules."""
    labels, best, exception = host.split("."), 1, None
    for rule in RULES:
        parts = rule.lstrip("!").split(".")
        if len(parts) <= len(labels) and all(p in ("*", x) for p, x in zip(parts, labels[-len(parts) :])):
            if rule[0] == "!":
                exception = len(parts) - 1
            best = max(best, len(parts))
    n = best if exception is None else exception
    return ".".join(labels[-n:]), ".".join(labels[-n - 1 :])


def test_longest_rule_wildcards_and_exceptions(spark):
    hosts = ["", "com", "a.com", "b.a.com", "co.uk", "x.co.uk", "y.x.co.uk", "uk", "q.uk", "sch.uk", "town.sch.uk", "s.town.sch.uk", "b.s.town.sch.uk", "a.b.c", "z.a.b.c", "b.c", "ck", "foo.ck", "bar.foo.ck", "www.ck", "a.www.ck", "x.jp", "k.x.jp", "m.k.x.jp", "city.x.jp", "n.city.x.jp", "unknown", "a.unknown", "..", ".com"]
    data = spark.createDataFrame([(h,) for h in hosts], "host string")
    table = spark.createDataFrame([(r, i) for i, r in enumerate([*RULES, "com"])], "rule string, size int")
    got = {r.host: (r.suffix, r.domain) for r in url_filter.registered(data, table).collect()}
    assert got == {h: plain(h) for h in hosts}
    assert got["n.city.x.jp"] == ("x.jp", "city.x.jp") and got["s.town.sch.uk"] == ("town.sch.uk", "s.town.sch.uk")
    none = url_filter.registered(data, table.limit(0)).where("host = 'y.x.co.uk'").head()
    assert tuple(none) == ("y.x.co.uk", "uk", "co.uk")


def test_reputation_follows_the_table(spark):
    """Hosts under one registered domain share its bad name; under a suffix of many owners they don't."""
    pages = [(i, f"http://h{i % 50}.farm.example/p{i}", 1) for i in range(300)] + [(1000 + i, f"http://h{i % 50}.good{i % 7}.example/p{i}", 0) for i in range(600)] + [(9000, "http://new.farm.example/", None)]
    data = spark.createDataFrame(pages, "page_id long, url string, bad int")
    verdict = lambda rules: {r.page_id: (r.verdict, r.rate) for r in url_filter.judge(data, data["bad"], suffixes=spark.createDataFrame([(x,) for x in rules], "rule string")).where(F.col("page_id") == 9000).collect()}[9000]
    one, many = verdict(["example"]), verdict(["example", "*.example"])
    assert one[0] == "block" and one[1] > 0.8 and many[1] >= 0 and one != many
