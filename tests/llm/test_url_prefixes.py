"""Rules and URLs that meet on a prefix by chance: the full digest decides."""

import pytest

from fathomline.llm import urls

PAGES = [(1, "http://a.example.com/en/x"), (2, "http://b.net/es/"), (3, None), (4, "no scheme"), (5, "https://www.example.com/en/"), (6, "http://example.org/en/"), (1, "http://c.net/de/fr/")]


@pytest.mark.parametrize("hexes", [0, 1, 8])
def test_chance_meetings_are_no_rule(spark, monkeypatch, hexes):
    monkeypatch.setattr(urls, "PREFIX_HEX", hexes)
    pages = spark.createDataFrame(PAGES, "page_id long, url string")
    got = sorted((r.page_id, r.rule or "", r.verdict) for r in urls.judged(pages, urls.rule_table(spark)).collect())
    assert got == [(1, "", "allow"), (1, "example.com/en/", "block"), (2, "net/es/", "block"), (3, "", "allow"), (4, "", "allow"), (5, "www.example.com/en/", "allow"), (6, "", "allow")]


def test_the_join_key_is_the_prefix(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string")
    plan = urls.judged(pages, urls.rule_table(spark))._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join LeftOuter" in line)
    assert "substring(full" in join and "(full" not in join.replace("substring(full", "")
