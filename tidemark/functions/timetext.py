"""Reading of date and time texts in many notations, before any zone is applied."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

NONE, INSTANT, WALL, DAY = 0, 1, 2, 3
EPOCH = datetime(1970, 1, 1)
MICRO = timedelta(microseconds=1)

#: Zone abbreviations with one offset in minutes (fixed values, public civil-time names).
OFFSETS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "BST": 60, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "SGT": 480, "HKT": 480, "JST": 540, "KST": 540, "AEST": 600, "AEDT": 660,
}
#: Names of zones whose offset depends on the day (fixed values).
REGIONS = {"ET": "America/New_York", "CT": "America/Chicago", "MT": "America/Denver", "PT": "America/Los_Angeles"}
MONTHS = {m: i + 1 for i, m in enumerate(["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"])}
LONG_MONTHS = {m: i + 1 for i, m in enumerate(["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"])}
WEEKDAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]

NUMBER = re.compile(r"(\d{10})(?:\.(\d+))?$|(\d{13})$|(\d{16})$|(\d{19})$")
NAMED_DAY = re.compile(r"([A-Za-z]{3,9})\.?,? +(?=\d|[A-Za-z])")
DATES = [
    re.compile(r"(?P<y>\d{4})(?P<s>[-/.])(?P<m>\d{1,2})(?P=s)(?P<d>\d{1,2})(?!\d)"),
    re.compile(r"(?P<y>\d{4})(?P<m>\d\d)(?P<d>\d\d)(?=\d{4}(?:\d\d)?(?!\d)|\D|$)"),
    re.compile(r"(?P<a>\d{1,2})(?P<s>[-/.])(?P<b>\d{1,2})(?P=s)(?P<y>\d{4})(?!\d)"),
    re.compile(r"(?P<d>\d{1,2})(?P<s>[- ])(?P<n>[A-Za-z]{3,9})\.?(?P=s)(?P<y>\d{4}|\d\d)(?!\d)"),
    re.compile(r"(?P<n>[A-Za-z]{3,9})\.? (?P<d>\d{1,2}),? (?P<y>\d{4})(?!\d)"),
]
TIME = re.compile(
    r"(?:[T ]|, )?(?P<h>\d{1,2})(?::(?P<mi>\d\d)(?::(?P<s>\d\d)(?:[.,](?P<f>\d+))?)?|(?P<cmi>\d\d)(?P<cs>\d\d)?)(?: ?(?P<half>[AaPp])\.?[Mm]\.?)?"
    r"(?: ?(?P<sign>[+-])(?P<oh>\d\d)(?::?(?P<om>\d\d))?| ?(?P<abbr>[A-Za-z]{1,4}))?(?:\[(?P<region>[A-Za-z_/+-]+\d*)\])?$"
)


#: Zone names seen before, at most ZONES_KEPT; it only saves work. (A wrapped cache would be pickled by reference.)
ZONES: dict[str | None, str | None] = {}
ZONES_KEPT = 4096


def known_zone(name: str | None) -> str | None:
    """The zone's name if it is one, else null."""
    if name not in ZONES:
        if len(ZONES) >= ZONES_KEPT:
            ZONES.clear()
        try:
            ZONES[name] = ZoneInfo(name.strip()) and name.strip() if name else None
        except (KeyError, ValueError, OSError):
            ZONES[name] = None
    return ZONES[name]


def read_day(match: re.Match, order: str | None) -> date | None:
    g = match.groupdict()
    year = int(g["y"])
    if "a" in g:
        if order not in ("mdy", "dmy"):
            return None
        month, day = (int(g["a"]), int(g["b"])) if order == "mdy" else (int(g["b"]), int(g["a"]))
    elif "n" in g:
        name = g["n"].lower()
        month, day = MONTHS.get(name) or LONG_MONTHS.get(name) or (9 if name == "sept" else 0), int(g["d"])
        year += 2000 if len(g["y"]) == 2 else 0
    else:
        month, day = int(g["m"]), int(g["d"])
    try:
        return date(year, month, day)
    except ValueError:
        return None


def read_time_text(text: str | None, order: str | None) -> tuple[int, int, str | None]:
    """(form, value, zone) of a text: an INSTANT in microseconds, a WALL time in microseconds with
    the zone it names (or null), a DAY number, or NONE if it denotes none of them.

    ``order`` is the source's order of all-numeric dates (mdy, dmy; any other leaves such dates unread).
    """
    if text is None:
        return NONE, 0, None
    s = " ".join(text.split())
    m = NUMBER.match(s)
    if m:
        sec, frac, ms, us, ns = m.groups()
        value = int(sec) * 10**6 + int((frac or "0")[:6].ljust(6, "0")) if sec else int(ms) * 1000 if ms else int(us) if us else int(ns) // 1000
        return INSTANT, value, None
    weekday = None
    m = NAMED_DAY.match(s)
    if m and m.group(1)[:3].lower() in WEEKDAYS and m.group(1).lower() not in LONG_MONTHS:
        weekday, s = WEEKDAYS.index(m.group(1)[:3].lower()), s[m.end() :]
    for pattern in DATES:
        m = pattern.match(s)
        if m:
            break
    else:
        return NONE, 0, None
    day, rest = read_day(m, order), s[m.end() :]
    if day is None or (weekday is not None and day.weekday() != weekday):
        return NONE, 0, None
    if not rest:
        return DAY, (day - EPOCH.date()).days, None
    m = TIME.match(rest)
    if not m or (m["cmi"] and rest[0].isdigit() and not re.match(r"\d{8}", s)):
        return NONE, 0, None
    hour, minute, second = int(m["h"]), int(m["mi"] or m["cmi"]), int(m["s"] or m["cs"] or 0)
    if m["half"]:
        if not 1 <= hour <= 12:
            return NONE, 0, None
        hour = hour % 12 + (12 if m["half"] in "Pp" else 0)
    try:
        wall = datetime(day.year, day.month, day.day, hour, minute, second)
    except ValueError:
        return NONE, 0, None
    value = (wall - EPOCH) // MICRO + int((m["f"] or "0")[:6].ljust(6, "0"))
    region = known_zone(m["region"])
    if m["region"] and not region:
        return NONE, 0, None
    if m["sign"]:
        minutes = int(m["oh"]) * 60 + int(m["om"] or 0)
        if minutes > 18 * 60 or int(m["om"] or 0) > 59:
            return NONE, 0, None
        return INSTANT, value - (minutes if m["sign"] == "+" else -minutes) * 60_000_000, None
    if m["abbr"]:
        name = m["abbr"].upper()
        if name in REGIONS:
            return WALL, value, REGIONS[name]
        if name not in OFFSETS:
            return NONE, 0, None
        return INSTANT, value - OFFSETS[name] * 60_000_000, None
    return WALL, value, region
