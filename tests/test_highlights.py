"""Highlights in every shape a text column can hold."""

import json
from dataclasses import replace

import pytest

from tariffscope.plans import highlights

from conftest import role_frame, rows_of

# text, status, highlights with their places
TEXTS = [
    ('["SSO", "Audit log"]', "listed", [(1, "SSO"), (2, "Audit log")]),
    (' [ " spaced " , "" , null, "x"] ', "listed", [(1, "spaced"), (4, "x")]),
    ('["a", "a", "a"]', "listed", [(1, "a"), (2, "a"), (3, "a")]),
    ('[1, true, 2.5, {"k": "v"}, ["n"]]', "listed", [(1, "1"), (2, "true"), (3, "2.5"), (4, '{"k":"v"}'), (5, '["n"]')]),
    ('["quote \\" and \\\\", "caf\\u00e9"]', "listed", [(1, 'quote " and \\'), (2, "café")]),
    (json.dumps(["x" * 50_000, "y"]), "listed", [(1, "x" * 50_000), (2, "y")]),
    ("[]", "empty", []),
    ('["", null, "  "]', "empty", []),
    (None, "missing", []),
    ("", "missing", []),
    ("   ", "missing", []),
    ("null", "missing", []),
    ('["cut off', "malformed", []),
    ('["a",]', "malformed", []),
    ('["a"] trailing', "malformed", []),
    ('["a"], "more": ["b"]', "malformed", []),
    ('{"a": 1}', "malformed", []),
    ('"a"', "malformed", []),
    ("['a']", "malformed", []),
    ("a, b", "malformed", []),
]


@pytest.fixture(scope="module")
def told(spark, catalogue):
    rows = [
        {"offer_id": i, "entity_id": i % 4 or None, "plan_name": "p", "features": text, "price_monthly": None if i == 2 else float(i)}
        for i, (text, _, _) in enumerate(TEXTS)
    ]
    return replace(catalogue, offer=role_frame(spark, "offer", rows))


def test_status_of_every_text(told):
    found = rows_of(highlights.with_highlights(told.offer).orderBy("offer_id"), "highlight_status")
    assert found == [(status,) for _, status, _ in TEXTS]


def test_places_and_texts(told):
    expected = [(i, i % 4 or None, "p", at, text) for i, (_, _, listed) in enumerate(TEXTS) for at, text in listed]
    assert sorted(rows_of(highlights.offer_highlights(told)), key=repr) == sorted(expected, key=repr)


def test_counts(told):
    counts = {r.highlight: tuple(r)[1:] for r in highlights.highlight_counts(told).collect()}
    assert counts["x"] == (1, 1, 1.0)
    assert counts["a"] == (1, 1, None)  # listed three times by one offer without a price
    assert set(counts) == {text for _, _, listed in TEXTS for _, text in listed}


def test_an_entity_counts_once_and_missing_ones_do_not(spark, catalogue):
    rows = [{"offer_id": i, "entity_id": e, "features": '["h"]', "price_monthly": p} for i, (e, p) in
            enumerate([(1, 10.0), (1, 20.0), (2, None), (None, 0.0)])]
    c = replace(catalogue, offer=role_frame(spark, "offer", rows))
    assert rows_of(highlights.highlight_counts(c)) == [("h", 4, 2, 10.0)]


def test_formats_and_empty_tables(spark, catalogue, told):
    assert set(rows_of(highlights.highlight_formats(told))) == {
        ("listed", 6, 30.0), ("malformed", 8, 40.0), ("missing", 4, 20.0), ("empty", 2, 10.0)
    }
    nothing = replace(catalogue, offer=role_frame(spark, "offer", []))
    for plan in (highlights.offer_highlights, highlights.highlight_counts, highlights.highlight_formats):
        assert rows_of(plan(nothing)) == []
