import datetime as dt
from zoneinfo import ZoneInfo

import pytest

from weftline.operators.instants import estimate_zones, to_moments

PUB = [("us", "United States", "America/New_York", "mdy"), ("uk", "United Kingdom", "Europe/London", "dmy"), ("ie", "Ireland", "Europe/London", "dmy"), ("in", "India", "Asia/Kolkata", "dmy"), ("au", "Australia", "Australia/Sydney", "dmy")]
UTC = dt.timezone.utc


def us(*a, tz=UTC):
    return int(dt.datetime(*a, tzinfo=tz).timestamp() * 1_000_000)


CASES = [
    ("20260521T060000Z", "us", us(2026, 5, 21, 6)),
    ("20260521060000", "in", us(2026, 5, 21, 6)),
    ("2026-05-21T08:00:00+02:00", "us", us(2026, 5, 21, 6)),
    ("Thu, 21 May 2026 06:00:00 +0000", "us", us(2026, 5, 21, 6)),
    (" 2026-05-21 06:00:00z\t", "us", us(2026, 5, 21, 6)),
    ("1781657794", "us", 1781657794_000000),
    ("1781657794123", "us", 1781657794_123000),
    ("03/04/2026 05:00 AM", "us", us(2026, 3, 4, 5, tz=ZoneInfo("America/New_York"))),
    ("03/04/2026 05:00", "uk", us(2026, 4, 3, 5, tz=ZoneInfo("Europe/London"))),
    ("April 9, 2026 at 12:25 AM EDT", "us", us(2026, 4, 9, 4, 25)),
    ("9 July 2026, 13:48", "in", us(2026, 7, 9, 8, 18)),
    ("Mon, 06 Jul 2026 13:48:00 IST", "in", us(2026, 7, 6, 8, 18)),
    ("Mon, 06 Jul 2026 13:48:00 IST", "ie", us(2026, 7, 6, 12, 48)),
    ("2026-01-10 06:00 AEDT", "au", us(2026, 1, 9, 19)),
    ("2025-12-06 04:29 America/New_York", "uk", us(2025, 12, 6, 9, 29)),
    ("2025-12-06T04:29[Australia/Sydney]", "uk", us(2025, 12, 5, 17, 29)),
    ("2025-09-12 23:17:48.4-03:00", "uk", us(2025, 9, 13, 2, 17, 48, 400000)),
    ("November 29, 2025 12:25 a.m.", "us", us(2025, 11, 29, 5, 25)),
    ("2026-03-08 02:30:00", "us", None),  # skipped
    ("2025-11-02 01:30:00", "us", None),  # twice
    ("2025-11-02 01:30:00 EST", "us", us(2025, 11, 2, 6, 30)),
    ("2026-02-30 10:15:00", "us", None),
    ("2026-04-30T25:10:00", "us", None),
    ("1999-12-31T23:59:59Z", "us", None),
    ("2026-01-10", "us", None),
    ("24 March", "us", None),
    ("yesterday", "us", None),
    ("n/a", "us", None),
    ("", "us", None),
    (None, "us", None),
    ("2026-05-21T08:00:00", "nobody", None),
    ("2026-05-21T08:00:00Z", "nobody", us(2026, 5, 21, 8)),
    ("2026-05-21T08:00:00Z", None, us(2026, 5, 21, 8)),
]


@pytest.fixture(scope="module")
def publishers(spark):
    return spark.createDataFrame(PUB, "source_domain string, sourcecountry string, tz string, date_order string")


def test_forms(spark, publishers):
    rows = spark.createDataFrame([(i, t, s, "x") for i, (t, s, _) in enumerate(CASES)], "id long, seen string, src string, tz string")
    got = {r.id: (r.utc_us, r.tz) for r in to_moments(rows, "seen", "src", publishers).collect()}
    assert len(got) == len(CASES)
    for i, (t, s, want) in enumerate(CASES):
        assert got[i] == (want, "x"), (t, s)


def test_every_hour_of_a_year_against_zoneinfo(spark, publishers):
    """Walls of every half hour around clock changes: what happens once, never or twice."""
    zone = ZoneInfo("America/New_York")
    walls = [dt.datetime(2025, 11, 1) + dt.timedelta(minutes=30 * k) for k in range(96)] + [dt.datetime(2026, 3, 7) + dt.timedelta(minutes=30 * k) for k in range(96)]
    rows = spark.createDataFrame([(i, w.strftime("%Y-%m-%d %H:%M:%S"), "us") for i, w in enumerate(walls)], "id long, seen string, src string")
    got = {r.id: r.utc_us for r in to_moments(rows, "seen", "src", publishers).collect()}
    for i, w in enumerate(walls):
        ways = {u for fold in (0, 1) if (u := w.replace(tzinfo=zone, fold=fold).astimezone(UTC)).astimezone(zone).replace(tzinfo=None) == w}
        want = int(ways.pop().timestamp() * 1e6) if len(ways) == 1 else None
        assert got[i] == want, w


def test_zone_from_ingestion_times(spark, publishers):
    """A source without zone is read in the zone under which it was ingested soon after, never before."""
    rows = []
    for k in range(60):
        moment = dt.datetime(2026, 5, 1, 10, tzinfo=UTC) + dt.timedelta(hours=7 * k)
        rows.append((k, moment.astimezone(ZoneInfo("Asia/Kolkata")).strftime("%Y-%m-%d %H:%M:%S"), "new", int(moment.timestamp() * 1e6) + 600_000_000))
    df = spark.createDataFrame(rows, "id long, seen string, src string, got long")
    out = to_moments(df, "seen", "src", publishers, "got").collect()
    assert all(r.utc_us == r.got - 600_000_000 for r in out)


def test_empty(spark, publishers):
    none = spark.createDataFrame([], "id long, seen string, src string, got long")
    assert to_moments(none, "seen", "src", publishers, "got").count() == 0
    walls = spark.createDataFrame([], "s string, w long, g long")
    assert estimate_zones(walls, "s", "w", "g", ["Asia/Tokyo"]).count() == 0


def test_masked_zones_are_found(spark):
    """Every declared zone is masked and estimated from arrivals: of sources with five zoneless rows or more nine in ten come out right."""
    from weftline.plans.moments import p5_zones

    rows = [r for r in p5_zones(spark, "/root/testdata/sf0.01").collect() if r.rows >= 5]
    assert len(rows) > 20 and sum(r.tz == r.est_tz for r in rows) >= 0.9 * len(rows)


def test_a_few_wrong_clocks_do_not_move_a_zone(spark):
    walls = [("s", us(2026, 5, 1, 10) + 9 * 3_600_000_000 + k * 7_200_000_000, us(2026, 5, 1, 10) + k * 7_200_000_000 + (1_200_000_000 if k % 20 else -900_000_000)) for k in range(60)]
    df = spark.createDataFrame([*walls, (None, 1, 1), ("t", None, 5), ("u", 5, None)], "s string, w long, g long")
    got = estimate_zones(df, "s", "w", "g", ["Asia/Tokyo", "Asia/Kolkata", "Asia/Shanghai", "Australia/Sydney", "Europe/Berlin"]).collect()
    assert [(r.s, r.est_tz, r.violations, r.rows) for r in got] == [("s", "Asia/Tokyo", 3, 60)]
