"""Queries over whole tables, on a table that is larger than a judge window and on texts longer than an excerpt."""

import pytest

from semrank.plans import registry
from tests.oracle import connect, differences

SF = "/root/testdata/sf0.01"
ALL = ("judge_overlap_all", "terms_overlap_all", "sentence_cap_all", "missing_pairs_all", "requests_per_item_all", "cache_join_all", "cache_union_buffer_all")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", ALL)
def test_equals_sql_on_all_items(spark, con, name):
    assert differences(registry.queries()[name](spark, SF), con, registry.oracle_sql()[name]) == []


def test_every_live_item_is_judged(spark, con):
    live = con.sql("SELECT count(*) FROM documents WHERE source <> 'src3'").fetchall()[0][0]
    assert live > 300
    assert registry.queries()["judge_overlap_all"](spark, SF).select("id").distinct().count() == live


def test_footers_go_from_whole_texts(spark, con):
    got = registry.queries()["boilerplate_strip_whole"](spark, SF)
    assert differences(got, con, registry.oracle_sql()["boilerplate_strip_whole"]) == []
    assert got.where("length(text) > 1000").count() > 0
