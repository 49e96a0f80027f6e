"""Dispatch to sources, remote ones in tasks, failures as rows, point reads."""

import pytest
from pyspark.sql import functions as F

from corpusflow.queries import federation as fq
from corpusflow.sources.registry import Sources
from corpusflow.sources.remote import RemoteSource, search_args, sort_expression


def test_arguments_have_safe_values():
    assert search_args({}) == {"words": ["paper"], "limit": 5, "date_from": None, "sort": "relevance", "order": "descending"}
    got = search_args({"words": ["a  b", "", "a b", "c", "d", "e", "f"], "limit": "99", "year_from": 2020, "sort_by": "submittedDate", "sort_order": "up"})
    assert got == {"words": ["a b", "c", "d", "e"], "limit": 5, "date_from": "20200101", "sort": "submittedDate", "order": "descending"}
    assert search_args({"limit": 0, "date_from": "2021-05"})["limit"] == 1


def test_calls_by_name(spark, sf):
    sources = Sources(spark)
    sources.add("Open-Pages", fq.page_source(spark, sf))
    sources.add("flaky", RemoteSource(spark, "flaky", fq.Flaky()))
    assert sources.names() == ["flaky", "open_pages"] and sources.tools().where("required").count() == 5
    one = sources.call("get_external_paper_detail", {"source": "open-pages", "external_id": "P7"})
    assert [r["external_id"] for r in one.collect()] == ["P7"]
    far = sources.call("get_external_paper_detail", {"source": "flaky", "external_id": "abc-1"})
    assert [(r["external_id"], r["title"]) for r in far.collect()] == [("abc-1", "abc")]
    text = sources.call("resolve_external_fulltext", {"source": "flaky", "external_id": "abc-1"}).collect()
    assert [(r["pdf_url"], r["is_open_access"]) for r in text] == [("https://f.org/abc-1.pdf", True)]
    found = sources.call("search_external_papers", {"query": ["odd"], "sources": ["flaky"], "limit": 3})
    assert sorted(r["external_id"] for r in found.collect()) == ["odd-0", "odd-1", "odd-2"]
    for tool, args in (("nothing", {}), ("get_external_paper_detail", {"source": "flaky"}), ("get_external_paper_detail", {"source": "who", "external_id": "x"})):
        with pytest.raises(ValueError):
            sources.call(tool, args)


def test_a_point_read_asks_for_one_record(spark):
    class Counted:
        def search(self, **args):
            raise AssertionError("a point read searches nothing")

        def detail(self, external_id):
            return {"external_id": external_id, "title": "t"} if external_id == "x" else None

        def fulltext(self, record):
            raise RuntimeError("gone")

    source = RemoteSource(spark, "counted", Counted())
    assert source.detail("x").count() == 1 and source.detail("y").count() == 0
    assert [r["message"] for r in source.fulltext(source.detail("x")).collect()] == ["gone"]
    assert source.detail("x").where(F.col("title") == "other").count() == 0


def test_sort_expressions():
    assert [sort_expression(*x) for x in ((None, None), ("publicationDate", "ascending"), (" submittedDate ", "x"), ("odd", "ascending"))] == ["relevance_score:desc", "publication_date:asc", "publication_date:desc", "relevance_score:asc"]
