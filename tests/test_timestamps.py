import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
import pytest

from marketloom.functions.zones import transitions, utc_seconds
from marketloom.operators.timestamps import instants, parser_of, to_utc_micros


def at(*parts):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp() * 1_000_000)


IST, NYC, LON = "Asia/Kolkata", "America/New_York", "Europe/London"
CASES = [
    ("2020-01-21 10:35:29", IST, "DMY", at(2020, 1, 21, 5, 5, 29)),
    ("16-01-2024 11:11", IST, "DMY", at(2024, 1, 16, 5, 41)),
    ("02-03-2022 20:32", NYC, "MDY", at(2022, 2, 4, 1, 32)),
    ("13-05-2022 20:32", NYC, "MDY", None),
    ("2021-08-18T11:41:33+05:30", None, None, at(2021, 8, 18, 6, 11, 33)),
    ("2022-04-08T13:10:44.714Z", None, None, at(2022, 4, 8, 13, 10, 44) + 714_000),
    ("25-May-2020 03:02:21", NYC, "MDY", at(2020, 5, 25, 7, 2, 21)),
    ("10-SEP-2023 22:19:24", IST, "DMY", at(2023, 9, 10, 16, 49, 24)),
    ("1552039995", None, None, 1552039995 * 10**6),
    ("1555098782235", None, None, 1555098782235 * 1000),
    ("1680802687431331", None, None, 1680802687431331),
    ("20230430", IST, "DMY", at(2023, 4, 29, 18, 30)),
    ("11.27.20 08:05", NYC, "MDY", at(2020, 11, 27, 13, 5)),
    ("Feb 19, 2024 16:32:29 IST", IST, "DMY", at(2024, 2, 19, 11, 2, 29)),
    ("2021-08-30 06:03:01.626780 Asia/Kolkata", None, None, at(2021, 8, 30, 0, 33, 1) + 626780),
    ("2021-09-30T21:30:58,083", NYC, "MDY", at(2021, 10, 1, 1, 30, 58) + 83_000),
    ("20191119T231001+0000", None, None, at(2019, 11, 19, 23, 10, 1)),
    ("17/3/2022 4:00 PM", IST, "DMY", at(2022, 3, 17, 10, 30)),
    ("5/3/2019 12:36 AM", LON, "DMY", at(2019, 3, 5, 0, 36)),
    ("5/3/2019 13:36 PM", LON, "DMY", None),
    ("Thu, 01 Dec 2022 03:36:24 +0000", None, None, at(2022, 12, 1, 3, 36, 24)),
    ("2022-230", LON, "DMY", at(2022, 8, 17, 23)),
    ("2021-366", LON, "DMY", None),
    ("12 Nov 2021", LON, "DMY", at(2021, 11, 12)),
    (" 2020-05-22 23:55:42 GMT+05:30  ", None, None, at(2020, 5, 22, 18, 25, 42)),
    ("2020-11-01 01:30:00", NYC, "MDY", at(2020, 11, 1, 5, 30)),  # occurs twice: the earlier
    ("2021-03-14 02:30:00", NYC, "MDY", at(2021, 3, 14, 7, 30)),  # skipped: moved on by the gap
    ("2021-02-31 10:00:00", IST, "DMY", None),
    ("25:61", IST, "DMY", None),
    ("0000-00-00", IST, "DMY", None),
    ("2020-01-21 10:35:29", None, None, None),
    ("2020-01-21 10:35:29", "No/Where", "DMY", None),
    ("pending", IST, "DMY", None),
    ("", IST, "DMY", None),
    (None, IST, "DMY", None),
    ("9" * 100_000, IST, "DMY", None),
    ("２０２０-01-21 10:35:29", IST, "DMY", None),
]


@pytest.mark.parametrize("text,zone,order,want", CASES, ids=range(len(CASES)))
def test_forms(text, zone, order, want):
    got = to_utc_micros(pd.Series([text], dtype=object), pd.Series([zone], dtype=object), pd.Series([order], dtype=object))[0]
    assert (None if got is pd.NA else int(got)) == want


def test_batch_equals_single():
    t, z, o, w = zip(*CASES)
    got = to_utc_micros(pd.Series(t, dtype=object), pd.Series(z, dtype=object), pd.Series(o, dtype=object))
    assert [None if v is pd.NA else int(v) for v in got] == list(w)


def test_tables_and_masks():
    assert transitions("Asia/Kolkata").offsets[-1] == 19800 and transitions("No/Where") is None and transitions("../etc/passwd") is None
    assert parser_of("9999-99-99") and parser_of("AAAA") is None


def test_instants(spark):
    rows = spark.createDataFrame([(1, "2020-01-21", "a", 0), (1, "2020-01-21", "a", 0), (2, "1552039995", None, 0), (3, None, "a", 0), (4, "2020-01-21", None, 0), (5, "2020-01-21", "b", 0)], "id long, t string, f string, tz_name int")
    feeds = spark.createDataFrame([("a", IST, "DMY"), ("a", IST, "DMY")], "feed string, tz_name string, day_order string")
    got = sorted(tuple(r) for r in instants(rows, feeds, row_id="id", text="t", feed="f").collect())
    assert got == [(1, at(2020, 1, 20, 18, 30)), (2, 1552039995 * 10**6)]
    assert instants(rows.limit(0), feeds, row_id="id", text="t", feed="f").collect() == []


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/New_York", "Australia/Lord_Howe", "Africa/Casablanca", "America/Santiago", "Asia/Kolkata", "Pacific/Apia"])
def test_tables_equal_the_zone_database_in_every_century(zone):
    rng = random.Random(zone)
    local = [datetime(1, 1, 2) + timedelta(seconds=rng.randrange(int(9990 * 365.2425 * 86400))) for _ in range(500)]
    local += [datetime(1900, 1, 1) + timedelta(seconds=rng.randrange(300 * 365 * 86400)) for _ in range(1500)] + [datetime(1947, 7, 1, 12), datetime(2150, 7, 1, 12)]
    seconds = np.array([int((t - datetime(1970, 1, 1)).total_seconds()) for t in local])
    want = [int(s - t.replace(tzinfo=ZoneInfo(zone)).utcoffset().total_seconds()) for s, t in zip(seconds, local)]
    assert utc_seconds(seconds, zone)[0].tolist() == want


def test_letters_choose_between_the_two_readings_of_a_repeated_hour():
    def read(text):
        return int(to_utc_micros(pd.Series([text]), pd.Series(["America/New_York"]), pd.Series(["MDY"]))[0])

    early, late = at(2023, 11, 5, 5, 30), at(2023, 11, 5, 6, 30)
    assert read("Nov 5, 2023 01:30:00 EDT") == early == read("2023-11-05 01:30:00") == read("Nov 5, 2023 01:30:00 XYZ")
    assert read("Nov 5, 2023 01:30:00 EST") == late
    assert read("Jul 5, 2023 01:30:00 EST") == at(2023, 7, 5, 5, 30)  # letters of another season mean the zone


def test_long_texts_are_read():
    spaced = " " * 500 + "2020-01-21 00:00:00" + "\t" * 500
    assert int(to_utc_micros(pd.Series([spaced]), pd.Series(["Etc/UTC"]), pd.Series(["DMY"]))[0]) == at(2020, 1, 21)
    long_zone = "2020-01-21 00:00:00 America/" + "A" * 90
    assert to_utc_micros(pd.Series([long_zone]), pd.Series(["Etc/UTC"]), pd.Series(["DMY"]))[0] is pd.NA
    assert to_utc_micros(pd.Series(["9" * 100_000]), pd.Series(["Etc/UTC"]), pd.Series(["DMY"]))[0] is pd.NA
