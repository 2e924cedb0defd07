"""Dates as text, read and written in Columns. Values are wall-clock times: nothing depends on the session's zone."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strptime and strftime letters and the Java letters that read the same.
_JAVA = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "p": "a", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "z": "xx", "%": "%"}
# English names, and the words that may stand in a date without meaning.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
DAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
FILLERS = ("at", "on", "and", "ad", "m", "t", "of", "st", "nd", "rd", "th")
#: Directives of digits that strptime reads with one digit as well as with two.
_LOOSE = set("mdHIMS")


def _directives(fmt: str) -> list[tuple[str, str]]:
    """('%', letter) for directives and ('', text) for what stands between."""
    out = []
    for m in re.finditer(r"%(.)|([^%]+)|%$", fmt, re.DOTALL):
        if m[0] == "%" or (m[1] and m[1] not in _JAVA):
            raise ValueError(f"date format {m[0]} is not supported")
        out.append(("%", m[1]) if m[1] else ("", m[2]))
    return out


def java_pattern(fmt: str, reading: bool = False) -> str:
    """The Java pattern of a strptime or strftime format. When ``reading``, months, days and times may have one digit,
    unless two directives touch."""
    parts, out = _directives(fmt), []
    for i, (mark, x) in enumerate(parts):
        if not mark:
            out.append("".join(f"'{w}'" if w[0].isalpha() else "''" if w == "'" else w for w in re.findall(r"[^\W\d_]+|[\W\d_]", x)))
            continue
        touched = any(0 <= k < len(parts) and parts[k][0] and parts[k][1] != "%" for k in (i - 1, i + 1))
        out.append(_JAVA[x][0] if reading and x in _LOOSE and not touched else _JAVA[x])
    return "".join(out)


def read_date(c: Column, fmt: str, fail: bool) -> tuple[Column, Column]:
    """(wall-clock time, offset text or '') of text in a format. Text in another form fails the job, or is null.

    An offset (``%z``: +hhmm, +hh:mm or Z) is kept as text and does not move the time. Two-digit years from 69 are of
    the last century.
    """
    offset = F.lit("")
    if "%z" in fmt:
        if not fmt.endswith("%z"):
            raise ValueError("%z must stand at the end of an input format")
        found = F.regexp_extract(c, r"(Z|[+-]\d\d:?\d\d)$", 1)
        offset = F.when(found == "Z", "+0000").otherwise(F.translate(found, ":", ""))
        # without an offset the text is not of this format
        c = F.when(found != "", F.substring(c, F.lit(1), F.length(c) - F.length(found))).otherwise(F.when(c.isNotNull(), F.lit("no offset")))
        fmt = fmt.removesuffix("%z")
    # Read as UTC, so that the zone of the session and its gaps play no part; a marker keeps space at the end.
    c, pattern = F.concat(c, F.lit("|+0000")), java_pattern(fmt, True) + "'|'xx"
    instant = F.to_timestamp(c, pattern) if fail else F.try_to_timestamp(c, F.lit(pattern))
    wall = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + (instant - F.expr("TIMESTAMP'1970-01-01 00:00:00+00:00'"))
    if "%y" in fmt:
        wall = F.when(F.year(wall) >= 2069, wall - F.expr("INTERVAL 100 YEAR")).otherwise(wall)
    return wall, offset


def write_date(wall: Column, fmt: str, offset: Column | None = None) -> Column:
    """A wall-clock time as text in a strftime format."""
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    names = lambda words, at: F.element_at(F.array(*map(F.lit, words)), at)
    half = F.pmod(F.hour(wall) + 11, F.lit(12)) + 1
    write = {
        "Y": lambda: F.lpad(F.year(wall).cast("string"), 4, "0"), "y": lambda: two(F.year(wall) % 100), "m": lambda: two(F.month(wall)), "d": lambda: two(F.dayofmonth(wall)),
        "H": lambda: two(F.hour(wall)), "I": lambda: two(half), "M": lambda: two(F.minute(wall)), "S": lambda: two(F.second(wall)), "f": lambda: F.lpad((F.date_part(F.lit("SECOND"), wall) * 1000000 % 1000000).cast("int").cast("string"), 6, "0"),
        "p": lambda: F.when(F.hour(wall) < 12, "AM").otherwise("PM"), "b": lambda: F.substring(names(MONTHS, F.month(wall)), 1, 3), "B": lambda: names(MONTHS, F.month(wall)),
        "a": lambda: F.substring(names(DAYS, F.dayofweek(wall)), 1, 3), "A": lambda: names(DAYS, F.dayofweek(wall)), "j": lambda: F.lpad(F.dayofyear(wall).cast("string"), 3, "0"),
        "z": lambda: F.lit("") if offset is None else offset, "%": lambda: F.lit("%"),
    }
    if fmt == "%Y-%m-%d":
        return wall.cast("date").cast("string")
    if not fmt:
        return F.when(wall.isNotNull(), "")
    return F.concat(*[write[x]() if mark else F.lit(x) for mark, x in _directives(fmt)])


def any_date(c: Column) -> Column:
    """The date that a text names, in any usual form; null where it names none. A time and a zone may stand with it.

    The text is stripped of time, zone, weekday and filler words; what is left must be three numbers, or a month's name
    and two numbers. A number of three or more digits is the year. Without names the order is month, day, year, unless
    the first is a year or over 31 (year, month, day) or over 12 (day, month, year); beside a name the other two are
    told by place, a number over 31 being the year. Years of two digits are those within fifty years of now. Texts that
    leave out the day or the year have no date.
    """
    month = "|".join(f"{m[:3]}(?:{m[3:]})?".lower() if m != "September" else "sep(?:t(?:ember)?)?" for m in MONTHS)
    day = "|".join(f"{d[:3]}(?:{d[3:]})?".lower() for d in DAYS)
    clock = r"(?i)(?:(?<=\d)T|(?<![\d:.]))\s*\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?(?:\s*[ap]\.?m\b\.?)?|(?i)(?<![\d:.])\d{1,2}\s*[ap]m\b|(?i)(?<=\d)T\d{2}(?:\d{2}(?:\d{2}(?:\.\d+)?)?)?(?!\d)"
    behind = r"(?-i:\s*(?:(?:UTC|GMT|Z)\b)?\s*(?:[+-]\d{1,2}(?::?\d{2})?(?!\d))?(?:\s*\([A-Za-z ]+\))?)"
    name = rf"(?<![a-z])(?:{month})(?![a-z])"

    def words(x: Column) -> Column:
        """Without time and zone, weekday and fillers, in lower case; zone names count behind a time only, as capitals."""
        timeless = F.regexp_replace(x, rf"(?:{clock}){behind}", " @ ")
        timeless = F.when(F.contains(x, F.lit(":")) | F.regexp_like(x, F.lit(r"(?i)\d\s*[ap]m\b|\dT\d")), F.regexp_replace(timeless, r"@ +(?-i:(?!AM\b|PM\b)[A-Z]{3,5})\b", "@ ")).otherwise(x)
        bare = F.regexp_replace(F.lower(F.replace(timeless, F.lit("@"), F.lit(" "))), rf"(?<![a-z])(?:{day})(?![a-z])\.?|(?<=\d)(?:st|nd|rd|th)(?![a-z])|(?<![a-z])(?:{'|'.join(FILLERS)})(?![a-z])", " ")
        # 8 digits are year, month, day; 6 are three pairs; 12 and 14 hold a time, too.
        bare = F.regexp_replace(bare, r"^\s*(\d{4})(\d{2})(\d{2})(?:\d{4}(?:\d{2})?)?\s*$", "$1 $2 $3")
        return F.regexp_replace(bare, r"^\s*(\d{2})(\d{2})(\d{2})\s*$", "$1 $2 $3")

    def split(bare: Column) -> Column:
        return F.struct(F.regexp_extract_all(bare, F.lit(rf"{name}|\d+"), F.lit(0)).alias("parts"), F.regexp_replace(bare, rf"{name}\.?|\d+|[\s,;./'-]+", "").alias("rest"))

    def date_of(s: Column) -> Column:
        p = lambda i: F.get(s["parts"], i)
        named = [F.regexp_like(p(i), F.lit("^[a-z]")) for i in range(3)]
        number = [F.when(~named[i], p(i)).try_cast("int") for i in range(3)]
        yearly = [F.length(p(i)) > 2 for i in range(3)]
        big = lambda i: yearly[i] | (number[i] > 31)
        order = lambda *ymd: F.array(*[F.lit(i) for i in ymd])
        places = (
            F.when(named[0], F.when(big(1), order(1, 0, 2)).otherwise(order(2, 0, 1)))
            .when(named[1], F.when(big(0), order(0, 1, 2)).otherwise(order(2, 1, 0)))
            .when(named[2], F.when(big(1), order(1, 2, 0)).when(yearly[0] | ~yearly[1], order(0, 2, 1)).otherwise(order(1, 2, 0)))
            .when(big(0), order(0, 1, 2))
            .when(number[0] > 12, order(2, 1, 0))
            .otherwise(order(2, 0, 1))
        )
        names = sum((n.cast("int") for n in named[1:]), named[0].cast("int"))
        picked = F.transform(places, lambda i: F.get(s["parts"], i))
        return F.when((F.size(s["parts"]) == 3) & (s["rest"] == "") & (names <= 1), once(picked, dated))

    def dated(ymd: Column) -> Column:
        pick = lambda k: F.get(ymd, k - 1)
        y, now = pick(1), F.year(F.current_date())
        year = y.try_cast("int")
        near = F.floor(now / 100) * 100 + year
        year = F.when(F.length(y) > 2, year).when(near >= now + 50, near - 100).when(near < now - 50, near + 100).otherwise(near)
        m = pick(2)
        name_at = F.array_position(F.array(*[F.lit(w[:3].lower()) for w in MONTHS]), F.substring(m, 1, 3))
        month_no = F.when(F.regexp_like(m, F.lit("^[a-z]")), name_at).otherwise(m.try_cast("int"))
        text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month_no.cast("string"), 2, "0"), F.lpad(pick(3), 2, "0"))
        return F.when(F.length(text) == 10, text.try_cast("date"))

    # What Spark reads itself is the fast path; it would make up a day for a year and a month.
    fast = F.when(F.length(F.trim(c)) >= 8, c.try_cast("timestamp_ntz").cast("date"))
    return F.coalesce(fast, once(F.trim(c), lambda x: once(words(x), lambda bare: once(split(bare), date_of))))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it: it goes through an array of one."""
    return F.transform(F.array(value), use)[0]
