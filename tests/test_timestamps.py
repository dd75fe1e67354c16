from datetime import datetime, timedelta, timezone

import pytest

from cohortloom.operators import timestamps as T

FIELDS = "id string, date string, user_id string, received_at timestamp, time_zone string, locale string"
AT = datetime(2021, 6, 1)


def us(*a, off=0.0):
    return int((datetime(*a, tzinfo=timezone.utc) - timedelta(hours=off) - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds() * 1_000_000)


CASES = [
    ("2020-03-01 20:46:57.406951+00:00", None, "en_GB", us(2020, 3, 1, 20, 46, 57, 406951)),
    ("2020-03-01T20:46:57Z", "Asia/Tokyo", "ja_JP", us(2020, 3, 1, 20, 46, 57)),
    ("2020-03-01 20:46:57", "Asia/Tokyo", "ja_JP", us(2020, 3, 1, 20, 46, 57, off=9)),
    ("2020-03-01 20:46:57", None, "en_GB", us(2020, 3, 1, 20, 46, 57)),
    ("2020-03-01 20:46:57", "Nowhere/Land", "en_GB", us(2020, 3, 1, 20, 46, 57)),
    ("03/04/2020 13:37", "UTC", "en_US", us(2020, 3, 4, 13, 37)),
    ("03/04/2020 13:37", "UTC", "en_GB", us(2020, 4, 3, 13, 37)),
    ("03/04/2020 13:37", "UTC", None, us(2020, 4, 3, 13, 37)),
    ("2020/03/04 06:04:39", "UTC", "en_US", us(2020, 3, 4, 6, 4, 39)),
    ("2020-03-01 14:06:20+00.00", "Asia/Tokyo", "x", us(2020, 3, 1, 14, 6, 20)),
    ("2020-03-08T20:10:46+1300", None, "x", us(2020, 3, 8, 20, 10, 46, off=13)),
    ("2020-03-05T17:45:30-08", None, "x", us(2020, 3, 5, 17, 45, 30, off=-8)),
    ("20200303T230839Z", None, "x", us(2020, 3, 3, 23, 8, 39)),
    ("Tue, 03 Mar 2020 12:25:52 +0100", None, "x", us(2020, 3, 3, 12, 25, 52, off=1)),
    ("04-Mar-2020 04:59:18", "UTC", "x", us(2020, 3, 4, 4, 59, 18)),
    ("10. März 2020 02:58", "Europe/Berlin", "de_DE", us(2020, 3, 10, 2, 58, off=1)),
    ("11 March 2020 04:42", "UTC", "x", us(2020, 3, 11, 4, 42)),
    ("Mar 22, 2020 12:11:39 AM", "UTC", "en_US", us(2020, 3, 22, 0, 11, 39)),
    ("3/16/2020 12:50 PM", "UTC", "en_US", us(2020, 3, 16, 12, 50)),
    ("2020-07-01 12:00:00 BST", "Europe/London", "x", us(2020, 7, 1, 12, off=1)),
    ("2020-07-01 12:00:00 IST", "Asia/Kolkata", "x", us(2020, 7, 1, 12, off=5.5)),
    ("2020-07-01T12:00:00[Europe/Berlin]", None, "x", us(2020, 7, 1, 12, off=2)),
    ("2020-07-01T12:00:00+01:00[Europe/Berlin]", None, "x", us(2020, 7, 1, 12, off=1)),
    ("1583587538", "Asia/Tokyo", "x", 1583587538000000), ("1583425741402", None, "x", 1583425741402000), ("1583720091.654", None, "x", 1583720091654000),
    (" 2020-03-01 ", "UTC", "x", us(2020, 3, 1)),
    # twice: the first; skipped: the offset before
    ("2020-10-25 01:30:00", "Europe/London", "x", us(2020, 10, 25, 1, 30, off=1)),
    ("2020-03-29 01:30:00", "Europe/London", "x", us(2020, 3, 29, 1, 30)),
    ("2021-02-30 10:15:00", None, "x", None), ("31/11/2020 09:20", None, "en_GB", None), ("2021-06-12 27:40:00", None, "x", None), ("2020-13-04 08:00:00", None, "x", None),
    ("13/13/2020 1:00 PM", None, "en_US", None), ("3/16/2020 13:50 PM", None, "en_US", None), ("0000-00-00 00:00:00", None, "x", None), ("yesterday", None, "x", None),
    ("", None, "x", None), ("   ", None, "x", None), (None, None, None, None), ("2020-07-01 12:00:00 QQQ", None, "x", None), ("2020-07-01T12:00:00[No/Where]", None, "x", None),
    ("9" * 5000, None, "x", None), ("2020-07-01 12:00:60", None, "x", None),
]


@pytest.fixture(scope="module")
def read(spark):
    df = spark.createDataFrame([(str(i), c[0], "u", AT, c[1], c[2]) for i, c in enumerate(CASES)], FIELDS)
    return {int(r.id): r.utc_us for r in T.normalise_timestamps(df).collect()}


@pytest.mark.parametrize("i", range(len(CASES)), ids=[str(c[0])[:30] for c in CASES])
def test_writing(read, i):
    assert read[i] == CASES[i][3]


def test_missing_zone_is_estimated_from_arrivals(spark):
    rows = []
    for k in range(60):
        at = datetime(2021, 6, 1) + timedelta(hours=7 * k)
        rows.append((f"t{k}", (at + timedelta(hours=9)).strftime("%Y-%m-%d %H:%M:%S"), "tokyo", at + timedelta(seconds=40), None, "ja_JP"))
        rows.append((f"u{k}", at.strftime("%Y-%m-%d %H:%M:%S"), "utc", at + timedelta(seconds=40), None, "en_GB"))
    df = spark.createDataFrame(rows, FIELDS)
    got = {r.id: r.utc_us for r in T.normalise_timestamps(df).collect()}
    for k in range(60):
        want = int((datetime(2021, 6, 1) + timedelta(hours=7 * k) - datetime(1970, 1, 1)).total_seconds() * 1_000_000)
        assert got[f"t{k}"] == want and got[f"u{k}"] == want


def test_columns_clash_and_tables_are_empty(spark):
    df = spark.createDataFrame([("1", "2020-03-01T20:46:57Z", "u", AT, None, "x", 1, 2)], FIELDS + ", _form int, utc_us int")
    out = T.normalise_timestamps(df)
    assert out.columns == df.columns and out.collect()[0].utc_us == us(2020, 3, 1, 20, 46, 57)
    assert T.normalise_timestamps(df.limit(0)).collect() == []


def test_estimate_knows_all_regions(spark):
    rows, want = [], {}
    for user, minutes in (("shanghai", 480), ("nairobi", 180), ("kathmandu", 345), ("kolkata", 330), ("honolulu", -600), ("utc", 0)):
        for k in range(30):
            at = datetime(2021, 6, 1) + timedelta(hours=7 * k)
            want[f"{user}{k}"] = us(at.year, at.month, at.day, at.hour, at.minute)
            rows.append((f"{user}{k}", (at + timedelta(minutes=minutes)).strftime("%Y-%m-%d %H:%M:%S"), user, at + timedelta(seconds=40 + k), None, "x"))
    got = {r.id: r.utc_us for r in T.normalise_timestamps(spark.createDataFrame(rows, FIELDS)).collect()}
    assert got == want


def stripped(seed, moves, days=200, per_day=2.0, late=0.03):
    """Rows of a phone whose zone was lost: (local text, instant, arrival), by the zones it was in from the days on."""
    import random
    from zoneinfo import ZoneInfo

    rng, out, t = random.Random(seed), [], datetime(2021, 1, 4, tzinfo=timezone.utc)
    end = t + timedelta(days=days)
    first = t
    while t < end:
        t += timedelta(days=rng.expovariate(per_day))
        zone = ZoneInfo([z for d, z in moves if t >= first + timedelta(days=d)][-1])
        lag = timedelta(days=rng.uniform(1, 20)) if rng.random() < late else timedelta(seconds=rng.expovariate(1 / 60))
        out.append((t.astimezone(zone).strftime("%Y-%m-%d %H:%M:%S"), t.replace(microsecond=0), (t + lag).replace(tzinfo=None)))
    return out


PHONES = {
    "berlin": [(0, "Europe/Berlin")], "tokyo": [(0, "Asia/Tokyo")], "sydney": [(0, "Australia/Sydney")], "new york": [(0, "America/New_York")], "kathmandu": [(0, "Asia/Kathmandu")],
    "moved once": [(0, "Europe/Berlin"), (90, "America/Los_Angeles")], "moved and came back": [(0, "Europe/London"), (60, "Asia/Kolkata"), (130, "Europe/London")], "home": [(0, "UTC")], "away for long": [(0, "UTC"), (80, "Asia/Shanghai")],
}


def instants(spark, rows, **more):
    df = spark.createDataFrame([(f"{u}-{k}", text, u, at, None, "x", k) for u, r in rows.items() for k, (text, _, at) in enumerate(r)], FIELDS + ", place int")
    return {r.id: r.utc_us for r in T.normalise_timestamps(df, **more).collect()}


def test_histories_of_phones_without_a_zone_are_recovered(spark):
    rows = {u: stripped(k, moves) for k, (u, moves) in enumerate(PHONES.items())}
    got, right = instants(spark, rows), {}
    for u, r in rows.items():
        right[u] = sum(got[f"{u}-{k}"] == int(t.timestamp()) * 1_000_000 for k, (_, t, _) in enumerate(r)) / len(r)
    assert min(right.values()) >= 0.9 and sum(right.values()) / len(right) >= 0.95, right
    assert right["home"] == 1.0


def test_sequence_stands_in_for_missing_arrivals(spark):
    rows = {u: stripped(30 + k, PHONES[u], per_day=40, days=30, late=0) for k, u in enumerate(("tokyo", "new york", "home"))}
    rows = {u: [(text, t, at if k % 3 == 0 else None) for k, (text, t, at) in enumerate(r)] for u, r in rows.items()}
    for sequence in ("place", None):
        got = instants(spark, rows, sequence=sequence)
        assert all(got[f"{u}-{k}"] == int(t.timestamp()) * 1_000_000 for u, r in rows.items() for k, (_, t, _) in enumerate(r))
    alone = {"tokyo": [(text, t, at if k % 40 == 0 else None) for k, (text, t, at) in enumerate(rows["tokyo"])]}
    alone = {"tokyo": [(text, t, t.replace(tzinfo=None) + timedelta(seconds=30) if k % 2 == 0 and k < 30 else None) for k, (text, t, _) in enumerate(alone["tokyo"])]}
    right = lambda got: sum(got[f"tokyo-{k}"] == int(t.timestamp()) * 1_000_000 for k, (_, t, _) in enumerate(alone["tokyo"][:30]))
    assert right(instants(spark, alone, sequence="place")) == 30 and right(instants(spark, alone)) == 0
