"""Zone transition tables, built once per process, zone and version of the zone database.

The table of a zone holds every transition of its compiled file; past the last of them the file's
own rule is laid out for 400 years, after which the calendar and so the rule repeats. Nothing is
assumed about a first or a last year.
"""

from __future__ import annotations

import os
import re
import struct
from dataclasses import dataclass
from functools import lru_cache
from importlib import resources
from zoneinfo import TZPATH

import numpy as np

#: Seconds of 400 Gregorian years, a whole number of weeks.
CYCLE = 146_097 * 86_400


@dataclass(frozen=True)
class ZoneTable:
    """starts: local seconds from which an offset holds; offsets in seconds; names: its letters.

    An offset holds for local times from (instant of change + greater of the two offsets): a local
    time that occurs twice thus gets the earlier instant, and one that is skipped moves on by the
    length of the gap. From repeat_from on the table repeats every CYCLE seconds.
    """

    starts: np.ndarray
    offsets: np.ndarray
    names: np.ndarray
    repeat_from: int


def database_version() -> str:
    """Version of the zone database in use, from the folder that the zones are read from."""
    for folder in TZPATH:
        for name in ("tzdata.zi", "+VERSION", "version"):
            try:
                with open(os.path.join(folder, name), encoding="ascii", errors="replace") as f:
                    return f.readline().removeprefix("# version").strip()
            except OSError:
                continue
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "unknown"


def _compiled(name: str) -> bytes | None:
    """The compiled file of a zone, from the system's folders or else from the tzdata package."""
    if not re.fullmatch(r"[A-Za-z0-9_+-]+(?:/[A-Za-z0-9_+-]+)*", name):
        return None
    for folder in TZPATH:
        path = os.path.join(folder, *name.split("/"))
        if os.path.isfile(path):
            with open(path, "rb") as f:
                return f.read()
    try:
        return resources.files("tzdata").joinpath("zoneinfo", *name.split("/")).read_bytes()
    except (ImportError, OSError):
        return None


def _explicit(blob: bytes) -> tuple[list[int], list[tuple[int, str]], str]:
    """(instants of change, regimes as (offset, letters) with one more, rule text) of a compiled file."""
    head = struct.Struct(">4sc15x6l")
    _, _, utc, std, leap, times, types, chars = head.unpack_from(blob, 0)
    at = head.size + times * 5 + types * 6 + chars + leap * 8 + std + utc
    _, _, utc, std, leap, times, types, chars = head.unpack_from(blob, at)
    at += head.size
    instants = list(struct.unpack_from(f">{times}q", blob, at))
    kinds = blob[at + 8 * times : at + 9 * times]
    at += 9 * times
    letters = blob[at + 6 * types : at + 6 * types + chars]

    def regime(k: int) -> tuple[int, str]:
        offset, _, where = struct.unpack_from(">lBB", blob, at + 6 * k)
        return offset, letters[where : letters.index(b"\0", where)].decode("ascii")

    at_rule = at + 6 * types + chars + 12 * leap + std + utc
    return instants, [regime(0), *[regime(k) for k in kinds]], blob[at_rule:].strip(b"\n").decode("ascii")


_CLOCK = r"[+-]?\d{1,3}(?::\d\d){0,2}"
_RULE = re.compile(rf"(?P<std><[^>]+>|[A-Za-z]+)(?P<off>{_CLOCK})(?P<dst><[^>]+>|[A-Za-z]+)(?P<ahead>{_CLOCK})?,(?P<begin>[^,/]+)(?:/(?P<at>{_CLOCK}))?,(?P<end>[^,/]+)(?:/(?P<till>{_CLOCK}))?")


def _clock(text: str | None, default: int) -> int:
    """Seconds of a clock of the rule text."""
    if text is None:
        return default
    sign = -1 if text.startswith("-") else 1
    return sign * sum(int(x) * w for x, w in zip(text.lstrip("+-").split(":"), (3600, 60, 1)))


def _days_of(rule: str, years: np.ndarray) -> np.ndarray:
    """Days since 1970 on which a date of the rule falls in each year."""
    jan = (years - 1970).astype("datetime64[Y]").astype("datetime64[D]").astype(np.int64)
    if rule.startswith("M"):
        month, week, weekday = map(int, rule[1:].split("."))
        months = ((years - 1970) * 12 + month - 1).astype("datetime64[M]")
        first = months.astype("datetime64[D]").astype(np.int64)
        day = first + (weekday - (first + 4)) % 7 + 7 * (week - 1)  # 1970-01-01 was a Thursday
        return np.where(day >= (months + 1).astype("datetime64[D]").astype(np.int64), day - 7, day)
    leap = (years % 4 == 0) & ((years % 100 != 0) | (years % 400 == 0))
    if rule.startswith("J"):  # counts no 29 February
        n = int(rule[1:])
        return jan + n - 1 + (leap & (n > 59))
    return jan + int(rule)


def _by_rule(rule: str, since: int) -> list[tuple[int, tuple[int, str]]]:
    """Changes after an instant by the zone's rule, for a cycle of years and one year beyond it."""
    hit = _RULE.fullmatch(rule)
    if hit is None:
        return []
    std = -_clock(hit["off"], 0)
    dst = -_clock(hit["ahead"], -(std + 3600))
    first = int(np.datetime64(since, "s").astype("datetime64[Y]").astype(int)) + 1970
    years = np.arange(first, first + 403)
    into = _days_of(hit["begin"], years) * 86_400 + _clock(hit["at"], 7200) - std
    out_of = _days_of(hit["end"], years) * 86_400 + _clock(hit["till"], 7200) - dst
    changes = [(int(t), (dst, hit["dst"].strip("<>"))) for t in into] + [(int(t), (std, hit["std"].strip("<>"))) for t in out_of]
    return sorted(c for c in changes if c[0] > since)


@lru_cache(maxsize=1024)
def transitions(name: str, version: str | None = None) -> ZoneTable | None:
    """The table of a zone; None for an unknown one. version separates entries of different databases."""
    blob = _compiled(name)
    if blob is None or blob[:4] != b"TZif" or blob[4:5] < b"2":
        return None
    instants, regimes, rule = _explicit(blob)
    begin = max(instants[-1] if instants else 0, 0)
    if "," in rule:
        later = _by_rule(rule, begin)
        instants += [t for t, _ in later]
        regimes += [r for _, r in later]
    offsets = np.array([o for o, _ in regimes], dtype=np.int64)
    starts = np.r_[np.iinfo(np.int64).min // 4, np.array(instants, dtype=np.int64) + np.maximum(offsets[1:], offsets[:-1])]
    return ZoneTable(starts, offsets, np.array([n.upper() for _, n in regimes], dtype=object), begin + 200 * 86_400)


def utc_seconds(local: np.ndarray, name: str, letters: np.ndarray | None = None) -> tuple[np.ndarray, bool]:
    """UTC seconds of local seconds in a zone; False where the zone is unknown.

    Letters that name the later of the two offsets of a local time that occurs twice choose the
    later instant; any others change nothing.
    """
    table = transitions(name, database_version())
    if table is None:
        return local, False
    folded = local - np.maximum((local - table.repeat_from) // CYCLE, 0) * CYCLE
    at = np.searchsorted(table.starts, folded, side="right") - 1
    if letters is not None:
        after = np.minimum(at + 1, len(table.starts) - 1)
        twice = (table.offsets[after] < table.offsets[at]) & (folded >= table.starts[after] - (table.offsets[at] - table.offsets[after]))
        at = np.where(twice & (letters == table.names[after]) & (letters != table.names[at]), after, at)
    return local - table.offsets[at], True
