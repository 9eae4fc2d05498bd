"""Timestamps: each way of writing, zones, and the operator's edge cases."""

from __future__ import annotations

import datetime as dt
import zoneinfo

import numpy as np
import pytest

from peneira.functions.times import parse, plan_of, to_utc, transitions
from peneira.operators.timestamps import instants

NY, SP, LX = "America/New_York", "America/Sao_Paulo", "Europe/Lisbon"


def one(text: str, zone: str = "UTC", day_first: bool = True, observed: int = -1, late: bool = False) -> str | None:
    us, ok = parse([text.encode()], np.array([zone], object), np.array([day_first]), np.array([observed]), late)
    return (dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=int(us[0]))).isoformat() if ok[0] else None


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("2026-05-31T12:31:56Z", "2026-05-31T12:31:56"),
        ("2026-05-07T12:44:00.3019120Z", "2026-05-07T12:44:00.301912"),
        ("2026-03-06T04:50:18-05:00", "2026-03-06T09:50:18"),
        ("2026-08-10T12:37:19,289+0000", "2026-08-10T12:37:19.289000"),
        ("2026-04-15T20:11:50-03:00[America/Sao_Paulo]", "2026-04-15T23:11:50"),
        ("2026-04-15T20:11:50[America/Sao_Paulo]", "2026-04-15T23:11:50"),
        ("20260705T012133Z", "2026-07-05T01:21:33"),
        ("2026-06-15T08Z", "2026-06-15T08:00:00"),
        ("2026-06-15", "2026-06-15T00:00:00"),
        ("14/01/2026", "2026-01-14T00:00:00"),
        ("14.01.2026 17:18", "2026-01-14T17:18:00"),
        ("Publicada em 22/04/2026", "2026-04-22T00:00:00"),
        ("27 de junho de 2026", "2026-06-27T00:00:00"),
        ("15 ago 2026", "2026-08-15T00:00:00"),
        ("3 ago 2026", "2026-08-03T00:00:00"),
        ("Fri, 08 May 2026 01:39:38 -0300", "2026-05-08T04:39:38"),
        ("Wed, 17 Jun 2026 16:01:49 WEST", "2026-06-17T15:01:49"),
        ("Jul 21, 2026 11:40 AM EDT", "2026-07-21T15:40:00"),
        ("Jul 21, 2026 12:40 AM GMT", "2026-07-21T00:40:00"),
        ("20240101123000", "2024-01-01T12:30:00"), ("20240101123000Z", "2024-01-01T12:30:00"), ("20240101123000-0300", "2024-01-01T15:30:00"), ("20241301123000", None),
        ("publicada " * 60 + "em 22/04/2026", "2026-04-22T00:00:00"), ("1950-06-01 12:00 -03:00", "1950-06-01T15:00:00"), ("  2026-06-15\n", "2026-06-15T00:00:00"),
        ("1788928187", "2026-09-09T04:29:47"),
        ("1777348904322", "2026-04-28T04:01:44.322000"),
        ("31/02/2026", None), ("0000-00-00", None), ("2026-13-40T00:00:00Z", None), ("2026-01-01T24:00:00Z", None), ("13:10 PM", None),
        ("TBA", None), ("a combinar", None), ("", None), ("-", None), ("2026", None), ("x" * 100_000, None),
    ],
)
def test_ways_of_writing(text, expected):
    assert one(text) == expected


def test_day_order_and_ages():
    assert one("03/07/2026", day_first=False) == "2026-03-07T00:00:00"
    assert one("03/30/2026", day_first=True) is None
    at = 1_780_000_000
    for text, back in (("há 2 dias", 2 * 86400), ("há 13 horas", 13 * 3600), ("8 days ago", 8 * 86400), ("Publicada há 5 minutos", 300), ("ontem", 86400), ("hace 2 semanas", 14 * 86400), ("há um dia", 86400)):
        assert one(text, observed=at) == dt.datetime.fromtimestamp(at - back, dt.UTC).replace(tzinfo=None).isoformat(), text
    assert one("há 2 dias") is None


def test_local_times_through_changes():
    assert one("2026-03-08 02:32:06", NY) == "2026-03-08T07:32:06"  # skipped: the offset before the change
    assert one("2026-11-01 01:30:00", NY) == "2026-11-01T05:30:00"  # twice: the first
    assert one("2026-03-29 01:30:00", LX) == "2026-03-29T01:30:00"
    assert one("2026-05-01", SP, late=True) == "2026-05-02T02:59:59"


@pytest.mark.parametrize("zone", [NY, SP, LX, "Asia/Kolkata", "Australia/Lord_Howe"])
def test_transition_tables_agree_with_zoneinfo(zone):
    tz = zoneinfo.ZoneInfo(zone)
    rng = np.random.default_rng(7)
    local = np.sort(rng.integers(0, 4_000_000_000, 3000))
    got = to_utc(local, zone)
    for seconds, utc in zip(local.tolist(), got.tolist()):
        wall = dt.datetime(1970, 1, 1) + dt.timedelta(seconds=seconds)
        assert utc == int(wall.replace(tzinfo=tz, fold=0).timestamp()), wall


def test_unknown_zone_and_masks():
    assert len(transitions("No/Where")[0]) == 0
    assert plan_of("?? ?") is None and plan_of("y-d-d")[0] == "absolute"


def test_operator_edges(spark):
    dim = spark.createDataFrame([("a", SP, True, 1), ("b", NY, False, 2)], "code string, tz string, day_first boolean, utc_us int")
    rows = spark.createDataFrame(
        [(1, "a", "01/02/2026", "x", None), (1, "a", "01/02/2026", "x", None), (2, "b", "01/02/2026", None, None), (3, "zz", "01/02/2026", "2026-01-01", None), (4, "a", None, None, None), (5, None, "2026-01-01T00:00:00Z", "", "2026-01-02T00:00:00+00:00"), (6, "a", "ontem", "", "2026-01-02T00:00:00+00:00")],
        "rec_id bigint, source string, first string, last string, observed_at string",
    ).selectExpr("*", "rec_id as raw", "source as field")
    got = sorted((r["row_id"], r["field"], r["utc_us"], r["canonical"]) for r in instants(rows, dim, "rec_id", {"first": False, "last": True}, "observed_at").collect())
    assert [g[0] for g in got] == [1, 1, 2, 3, 3, 5, 6]
    assert got[0] == got[1] and got[5][3] and not got[0][3]
    assert got[2][2] == 1_767_330_000_000_000 and got[6][2] == 1_767_225_600_000_000
    assert instants(rows.limit(0), dim, "rec_id", {"first": False}).count() == 0


def test_zones_before_1970():
    assert one("1950-07-01 12:00", zone=LX) == "1950-07-01T11:00:00"  # summer time of that year
    assert one("1950-01-15 12:00", zone=LX) == "1950-01-15T12:00:00"
    for zone in (NY, SP, LX):
        tz = zoneinfo.ZoneInfo(zone)
        for year in range(1915, 1970, 5):
            at = dt.datetime(year, 7, 3, 12, tzinfo=tz).astimezone(dt.UTC).replace(tzinfo=None)
            assert one(f"{year}-07-03 12:00", zone=zone) == at.isoformat(), (zone, year)
