from pyspark.sql import functions as F

from playmetry.llm import urls

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "x.com", ""))


def test_rules_and_edges(llm):
    told = {
        None: ("", "", None, "allow"), "no scheme/x": ("", "", None, "allow"), "http://A.Example.ORG/es/1?q": ("a.example.org", "/es/1", "example.org/es/", "block"),
        "http://example.org": ("example.org", "", None, "allow"), "http://Éx.org/a#b": ("Éx.org", "/a", "org/", "allow"), "http://notx.com/": ("notx.com", "/", None, "allow"),
        "s://u.x.com?a/b": ("u.x.com", "", "x.com", "block"), "http://www.bad.net/p.html": ("www.bad.net", "/p.html", None, "block"), "https://bad.net/p/#x": ("bad.net", "/p/", None, "block"),
        "http://bad.net/q": ("bad.net", "/q", None, "allow"), "http://a://b/c": ("a:", "//b/c", None, "allow"),
    }
    rows = [(i, u) for i, u in enumerate(told)] * 2
    pages = llm.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'z' canonical", "'z' block")
    listed = llm.createDataFrame([("bad.net/p",), ("bad.net/p",), (None,)], "canonical string")
    got = urls.filter_urls(pages, listed, RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == list(told.values())[r.page_id]
    empty = urls.filter_urls(pages, listed.limit(0), RULES)
    assert empty.where("listed").count() == 0 and urls.filter_urls(pages.limit(0), listed, RULES).count() == 0


def test_false_positives_go(llm, monkeypatch):
    """With one block for all keys nearly everything passes the filter, and the join still tells."""
    monkeypatch.setattr(urls, "MOST_BLOCKS", 1)
    rows = llm.range(4000).select(F.concat(F.lit("k"), "id").alias("k"), "id")
    listed = rows.where("id % 7 = 0").select("k")
    got = urls.is_listed(rows, "k", listed).collect()
    assert len(got) == 4000 and all(r.listed == (r.id % 7 == 0) for r in got)
