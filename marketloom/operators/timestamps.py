"""Mixed timestamp texts as one instant.

Each text is reduced to a shape mask (digits to 9, letters to A). A mask is matched once against
the layouts below and becomes a parser of fixed positions; all texts of a batch with that mask
are then cut and converted as arrays, and local times go through zone transition tables.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from marketloom.functions.zones import utc_seconds

# Layouts over masks. Y year, y two-digit year, m month, d day, a and b day and month in the feed's
# order, n month name, j day of the year, H M S time, f fraction, p half of the day, t a letter T,
# z the letter Z, o offset, g letters before an offset, w zone letters, r zone name, e epoch.
_TIME = r"(?P<H>99?):(?P<M>99)(?::(?P<S>99)(?:[.,](?P<f>9{1,9}))?)?(?: ?(?P<p>AA)(?!A))?"
_TIME24 = r"(?P<H>99?):(?P<M>99)(?::(?P<S>99)(?:[.,](?P<f>9{1,9}))?)?"
_ZONE = r"(?: ?(?<!A)(?P<z>A)| ?(?P<o>[+-]99:?99)| (?P<g>AAA)(?P<o2>[+-]99:?99)| (?P<w>A{2,5})| (?P<r>A+(?:[_/-]A+)*/A+(?:[_-]A+)*))?"
LAYOUTS = tuple(
    re.compile(p)
    for p in (
        r"(?P<e>9{10}|9{13}|9{16})",
        rf"(?P<Y>9999)-(?P<m>99)-(?P<d>99)(?:(?:(?P<t>A)| ){_TIME24}{_ZONE})?",
        r"(?P<Y>9999)(?P<m>99)(?P<d>99)(?:(?P<t>A)(?P<H>99)(?P<M>99)(?P<S>99)" + _ZONE + ")?",
        r"(?P<Y>9999)-(?P<j>999)",
        rf"(?P<a>99?)(?P<s>[-./])(?P<b>99?)(?P=s)(?:(?P<Y>9999)|(?P<y>99))(?: {_TIME}{_ZONE})?",
        rf"(?P<d>99?)[- ](?P<n>A{{3,9}})[- ](?P<Y>9999)(?: {_TIME}{_ZONE})?",
        rf"(?P<n>A{{3,9}}) (?P<d>99?), (?P<Y>9999)(?: {_TIME}{_ZONE})?",
        rf"AAA, (?P<d>99?) (?P<n>AAA) (?P<Y>9999) {_TIME24}{_ZONE}",
    )
)
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_MONTH = {name: i for i, full in enumerate(MONTHS, 1) for name in {full, full[:3]}} | {"sept": 9}
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")


def mask_of(text: str) -> str:
    """The character-class shape of a text."""
    return _LETTER.sub("A", _DIGIT.sub("9", text))


@lru_cache(maxsize=4096)
def parser_of(mask: str) -> dict[str, tuple[int, int]] | None:
    """Positions of the fields, found once per mask; None for a shape that is no timestamp."""
    for layout in LAYOUTS:
        if hit := layout.fullmatch(mask):
            return {k: hit.span(k) for k, v in hit.groupdict().items() if v is not None}
    return None


def _cut(texts: list[str], fields: dict[str, tuple[int, int]], utc: np.ndarray, good: np.ndarray, zones: np.ndarray, orders: np.ndarray) -> None:
    """Fill utc and good for texts of one mask."""
    n, width = len(texts), len(texts[0])
    chars = np.array(texts, dtype=f"U{width}").view("U1").reshape(n, width)
    codes = chars.view(np.uint32).reshape(n, width).astype(np.int64) - 48

    def number(k: str, default: int = 0) -> np.ndarray:
        if k not in fields:
            return np.full(n, default, dtype=np.int64)
        lo, hi = fields[k]
        out = np.zeros(n, dtype=np.int64)
        for i in range(lo, hi):
            out = out * 10 + codes[:, i]
        return out

    def word(k: str) -> list[str]:
        lo, hi = fields[k]
        return [t[lo:hi] for t in texts]

    good[:] = True
    if "e" in fields:
        lo, hi = fields["e"]
        utc[:] = number("e") * {10: 1_000_000, 13: 1_000, 16: 1}[hi - lo]
        return
    year = number("Y") if "Y" in fields else 2000 + number("y")
    month, day = number("m", 1), number("d", 1)
    if "a" in fields:
        first, second, dmy = number("a"), number("b"), orders == "DMY"
        day, month = np.where(dmy, first, second), np.where(dmy, second, first)
        good &= dmy | (orders == "MDY")
    if "n" in fields:
        month = np.array([_MONTH.get(w.lower(), 0) for w in word("n")], dtype=np.int64)
    good &= (month >= 1) & (month <= 12) & (year >= 1)
    base = ((year - 1970) * 12 + np.where(good, month, 1) - 1).astype("datetime64[M]")
    days = base.astype("datetime64[D]").astype(np.int64)
    if "j" in fields:
        length = (base + 12).astype("datetime64[D]").astype(np.int64) - days
        day = number("j")
    else:
        length = (base + 1).astype("datetime64[D]").astype(np.int64) - days
    good &= (day >= 1) & (day <= length)
    hour, minute, second = number("H"), number("M"), number("S")
    if "p" in fields:
        half = np.array([w.upper() for w in word("p")])
        good &= ((half == "AM") | (half == "PM")) & (hour >= 1) & (hour <= 12)
        hour = hour % 12 + np.where(half == "PM", 12, 0)
    good &= (hour < 24) & (minute < 60) & (second < 60)
    if "t" in fields:
        good &= np.char.upper(chars[:, fields["t"][0]]) == "T"
    micros = np.zeros(n, dtype=np.int64)
    if "f" in fields:
        lo, hi = fields["f"]
        micros = number("f") * 10**6 // 10 ** (hi - lo)
    local = (days + day - 1) * 86400 + hour * 3600 + minute * 60 + second

    seconds = np.zeros(n, dtype=np.int64)
    if "z" in fields:
        good &= np.char.upper(chars[:, fields["z"][0]]) == "Z"
        seconds[:] = local
    elif "o" in fields or "o2" in fields:
        lo, hi = fields.get("o") or fields["o2"]
        off_minutes = codes[:, hi - 2] * 10 + codes[:, hi - 1]
        off = (codes[:, lo + 1] * 10 + codes[:, lo + 2]) * 3600 + off_minutes * 60
        good &= (off <= 18 * 3600) & (off_minutes < 60)
        if "g" in fields:
            good &= np.isin(np.array([w.upper() for w in word("g")]), ["GMT", "UTC"])
        seconds[:] = local - np.where(chars[:, lo] == "-", -off, off)
    else:
        names = np.array(word("r"), dtype=object) if "r" in fields else zones
        letters = np.array([w.upper() for w in word("w")], dtype=object) if "w" in fields else None
        for name in set(names.tolist()):
            rows = names == name
            if name is None or not isinstance(name, str):
                good &= ~rows
                continue
            seconds[rows], known = utc_seconds(local[rows], name, letters[rows] if letters is not None else None)
            if not known:
                good &= ~rows
    utc[:] = seconds * 1_000_000 + micros


def to_utc_micros(texts: pd.Series, zones: pd.Series, orders: pd.Series) -> pd.Series:
    """Instants of texts in microseconds since 1970; null where a text names no existing time."""
    n = len(texts)
    values, good = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    stripped = [t.strip() if isinstance(t, str) else "" for t in texts]
    by_mask: dict[str, list[int]] = {}
    for i, t in enumerate(stripped):
        if t and t.isascii():
            by_mask.setdefault(mask_of(t), []).append(i)
    zone_of, order_of = zones.to_numpy(dtype=object), orders.to_numpy(dtype=object)
    for mask, rows in by_mask.items():
        if (fields := parser_of(mask)) is None:
            continue
        at = np.array(rows)
        utc, ok = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=bool)
        _cut([stripped[i] for i in rows], fields, utc, ok, zone_of[at], order_of[at])
        values[at], good[at] = utc, ok
    return pd.Series(pd.array(values, dtype="Int64")).where(pd.Series(good))


def utc_micros(text: Column, zone: Column, day_order: Column) -> Column:
    """BIGINT column of instants; zone is an IANA name, day_order DMY or MDY, either may be null.

    A text with an offset, Z, zone name or epoch needs no zone; zone letters stand for the given
    zone, and in an hour that occurs twice for the offset they name; a day alone is its first
    midnight; two-digit years are 20xx. Of a local time that occurs twice the earlier instant
    counts otherwise; a skipped one moves on by the gap's length. Texts of any length are read,
    years of any century follow the zone database's own transitions and rules. Null, empty,
    unreadable and non-existing times, and those that need a missing zone or order, give null.
    """

    def convert(texts, zones, orders):
        return to_utc_micros(texts, zones, orders)

    from pyspark.sql.functions import pandas_udf

    convert.__annotations__ = {"texts": pd.Series, "zones": pd.Series, "orders": pd.Series, "return": pd.Series}
    return pandas_udf(convert, returnType=LongType())(text, zone, day_order)


def instants(rows, feeds, *, row_id: str, text: str, feed: str):
    """(row_id, utc_micros) of every readable text; copies of a row count once."""
    asked = rows.select(F.col(row_id).alias("_id"), F.col(text).alias("_text"), F.col(feed).alias("_feed")).where("_text is not null").distinct()
    zones = feeds.select(F.col("feed").alias("_feed"), "tz_name", "day_order").where("_feed is not null").dropDuplicates(["_feed"])
    read = asked.join(zones, "_feed", "left").select("_id", utc_micros(F.col("_text"), F.col("tz_name"), F.col("day_order")).alias("utc_micros"))
    return read.where("utc_micros is not null").select(F.col("_id").alias(row_id), "utc_micros").distinct()
