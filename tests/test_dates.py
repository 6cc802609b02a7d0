import pytest

from lodestone.functions import dates

BASE = "2024-10-15 09:30:00"


FORMS = [
    ("October 13, 2024", "2024-10-13T00:00:00-04:00"),
    ("Oct. 13th, 2024", "2024-10-13T00:00:00-04:00"),
    ("Sunday, 13 October 2024", "2024-10-13T00:00:00-04:00"),
    ("10/13/2024", "2024-10-13T00:00:00-04:00"),
    ("1/2/99", "1999-01-02T00:00:00-05:00"),
    ("2024-01-05", "2024-01-05T00:00:00-05:00"),
    ("January 5, 2024 at 7:05 PM EST", "2024-01-05T19:05:00-05:00"),
    ("January 5, 2024 12:05 am", "2024-01-05T00:05:00-05:00"),
    ("2024-10-13T08:00:00Z", "2024-10-13T04:00:00-04:00"),
    ("2024-10-13T08:00:00+02:00", "2024-10-13T02:00:00-04:00"),
    ("2024-10-13T08:00:00", "2024-10-13T08:00:00-04:00"),
    ("March 2024", "2024-03-01T00:00:00-05:00"),
    ("2023", "2023-12-01T00:00:00-05:00"),
    ("October 13", "2024-10-13T00:00:00-04:00"),
    ("13 of October", "2024-10-13T00:00:00-04:00"),
    ("yesterday", "2024-10-14T09:30:00-04:00"),
    ("3 days ago", "2024-10-12T09:30:00-04:00"),
    ("in 2 weeks", "2024-10-29T09:30:00-04:00"),
    ("a month ago", "2024-09-15T09:30:00-04:00"),
    ("2 hours ago", "2024-10-15T07:30:00-04:00"),
]
NO_DATES = ["", "hello", "13/45/2024", "February 30, 2024", "99999"]


def test_forms(spark):
    rows = spark.createDataFrame([(w,) for w, _ in FORMS], "t string").coalesce(1)
    got = dict(map(tuple, rows.select("t", dates.parse_date("t", BASE)).collect()))
    assert got == dict(FORMS)


def test_no_date(spark):
    rows = spark.createDataFrame([(w,) for w in NO_DATES], "t string").coalesce(1)
    assert [r[0] for r in rows.select(dates.parse_date("t", BASE)).collect()] == [None] * len(NO_DATES)


def test_strict_mode_fails(one):
    with pytest.raises(Exception, match="not a date"):
        one(dates.parse_date("t", BASE, strict=True), t="")


def test_relative_words_need_a_base(one):
    assert one(dates.parse_date("t"), t="yesterday") is None


def test_find_in_text(one):
    said = "Held on October 13, 2024 and\nagain 11/02/2024; tickets since yesterday. Not 13/45/2024."
    assert one(dates.find_dates("t", BASE), t=said) == [
        "2024-10-13T00:00:00-04:00", "2024-11-02T00:00:00-04:00", "2024-10-14T09:30:00-04:00",
    ]
    assert one(dates.find_dates("t"), t="nothing") == []


def test_day_terms(one):
    assert one(dates.date_term("t"), t="2024-10-13T08:00:00-04:00") == "2024-10-13"
    assert one(dates.date_term("t"), t="soon") is None


def test_session_zone_does_not_matter(spark, one):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        assert one(dates.parse_date("t", BASE), t="Oct 13, 2024 2:00 pm") == "2024-10-13T14:00:00-04:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_dates_in_text_end_at_words(one):
    found = lambda text: one(dates.find_dates("x"), x=text)
    assert found("dismay 10, 2020") == [] and found("ref 112/25/20239 v1.10/5/24") == []
    assert [d[:10] for d in found("on 10/5/24, 12 May 2020 and (2021-03-04)")] == ["2024-10-05", "2020-05-12", "2021-03-04"]
