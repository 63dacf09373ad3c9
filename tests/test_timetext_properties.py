"""Round trips: an instant written in any notation is read back as that instant."""

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.functions.timetext import DAY, INSTANT, OFFSETS, WALL, read_time_text

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
instants = st.datetimes(datetime(2002, 1, 1), datetime(2049, 12, 31)).map(lambda d: d.replace(tzinfo=timezone.utc))
offsets = st.integers(-11 * 4, 12 * 4).map(lambda q: timedelta(minutes=15 * q))


def micros(d):
    return (d - EPOCH) // timedelta(microseconds=1)


def sign(o, colon=True):
    m = int(o.total_seconds() // 60)
    return f"{'-' if m < 0 else '+'}{abs(m) // 60:02}{':' if colon else ''}{abs(m) % 60:02}"


@settings(max_examples=300, deadline=None)
@given(instants, offsets, st.sampled_from(["T", " "]), st.booleans(), st.sampled_from(["", " "]), st.sampled_from([".", ","]))
def test_offset_notations(d, offset, sep, colon, gap, point):
    local = d.astimezone(timezone(offset))
    text = f"{local:%Y-%m-%d}{sep}{local:%H:%M:%S}{point}{local.microsecond:06}789{gap}{sign(offset, colon)}"
    assert read_time_text(text, None) == (INSTANT, micros(d), None)


@settings(max_examples=200, deadline=None)
@given(instants)
def test_epochs(d):
    n = micros(d)
    assert read_time_text(str(n), None) == (INSTANT, n, None)
    assert read_time_text(str(n // 1000), None) == (INSTANT, n // 1000 * 1000, None)
    assert read_time_text(f"  {n // 10**6}\t", None) == (INSTANT, n // 10**6 * 10**6, None)
    assert read_time_text(f"{n // 10**6}.{n % 10**6:06}", None) == (INSTANT, n, None)


@settings(max_examples=300, deadline=None)
@given(instants, st.sampled_from(["mdy", "dmy"]), st.sampled_from("/-."), st.booleans(), st.sampled_from([" AM", " pm", " p.m."]), st.sampled_from(sorted(OFFSETS)))
def test_numeric_and_half_day_notations(d, order, mark, padded, half, zone):
    d = d.replace(second=0, microsecond=0)
    a, b = (d.month, d.day) if order == "mdy" else (d.day, d.month)
    day = f"{a:02}{mark}{b:02}{mark}{d.year}" if padded else f"{a}{mark}{b}{mark}{d.year}"
    wall = micros(d)
    assert read_time_text(f"{day} {d:%H:%M}", order) == (WALL, wall, None)
    shown = {"a": "AM", "p": "PM"}["a" if d.hour < 12 else "p"]
    text = half.replace("AM", shown).replace("pm", shown.lower()).replace("p.m.", f"{shown[0].lower()}.m.")
    assert read_time_text(f"{day} {(d.hour - 1) % 12 + 1}:{d:%M}{text}", order) == (WALL, wall, None)
    assert read_time_text(f"{day}  {d:%H:%M:%S} {zone}", order) == (INSTANT, wall - OFFSETS[zone] * 60_000_000, None)
    assert read_time_text(day, order) == (DAY, (d.date() - EPOCH.date()).days, None)


@settings(max_examples=200, deadline=None)
@given(instants, st.sampled_from(["Asia/Tokyo", "Europe/Berlin", "America/New_York", "Australia/Sydney"]))
def test_named_months_regions_and_mail_dates(d, name):
    d = d.replace(microsecond=0)
    local = d.astimezone(ZoneInfo(name))
    offset = local.utcoffset()
    assert read_time_text(f"{local:%Y-%m-%dT%H:%M:%S}{sign(offset)}[{name}]", None) == (INSTANT, micros(d), None)
    assert read_time_text(f"{local:%a, %d %b %Y %H:%M:%S} {sign(offset, False)}", None) == (INSTANT, micros(d), None)
    wall = micros(local.replace(tzinfo=timezone.utc))
    for form in ("%d-%b-%Y %H:%M:%S", "%d-%b-%y %H:%M:%S", "%b %d, %Y %H:%M:%S", "%B %d %Y %H:%M:%S", "%d %B %Y %H:%M:%S", "%Y%m%d %H:%M:%S", "%Y%m%dT%H%M%S", "%Y%m%d%H%M%S", "%Y/%m/%d %H:%M:%S"):
        assert read_time_text(local.strftime(form), None) == (WALL, wall, None), form
    assert read_time_text(f"{local:%d-%b-%Y, %H:%M:%S}".upper(), None) == (WALL, wall, None)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_any_text_is_read_or_refused(text):
    form, value, zone = read_time_text(text, "mdy")
    assert form in (0, 1, 2, 3) and isinstance(value, int)
