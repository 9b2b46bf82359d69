"""Readings of a timestamp text as arrays of UTC instants, all JVM-side.

A text is first brought to one canonical field list by a single regular
expression of its family, then validated once by a cast. Families: year first
(``2025-03-06T01:02:03.5-03:00[Zone/Id]``), day or month first
(``06/03/2025 01:02:03 PM``, ``06.03.2025 01:02``), month by name
(``Thu, 06 Mar 2025 01:02:03 +0000``), compact digits (``20250306010203``) and
epoch numbers of 10, 13 or 16 digits (seconds, milli-, microseconds).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom.functions.plan import computed_once

SEP = "\x01"
# fixed values: English month names
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

PLAIN = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_TAIL = r"\s*([AaPp][Mm])?\s*(.*)$"
_YEAR_FIRST = r"^(\d{4})([-/.])(\d{1,2})[-/.](\d{1,2})(?:[Tt]|\s+)" + _CLOCK + _TAIL
_DAY_FIRST = r"^(\d{1,2})([-/.])(\d{1,2})[-/.](\d{4})(?:[Tt]|,?\s+)" + _CLOCK + _TAIL
_NAMED = r"^(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})[\s-]+([A-Za-z]{3})[A-Za-z]*\.?[\s-]+(\d{4}),?\s+" + _CLOCK + _TAIL
_COMPACT = r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$"

#: Codes of the written form, for the format-switch penalty.
FORMS = {"Y": 1, "D": 2, "N": 3, "C": 4, "E": 5}
READING = "array<struct<us:bigint,form:tinyint,rank:tinyint>>"


def _fields(kind: str, *groups: str) -> str:
    return SEP.join([kind, *groups])


def canonical_fields(value: Column) -> Column:
    """Kind, year, a, b, hour, minute, second, fraction, am/pm, zone, or one unusable field."""
    text = F.trim(F.regexp_replace(value, r"^\s+|\s+$", ""))
    digits = text.rlike(r"^\d+$")
    third, second, fifth = (F.substring(text, i, 1) for i in (3, 2, 5))
    marks = ("-", "/", ".")
    return F.split(
        F.when(fifth.isin(*marks), F.regexp_replace(text, _YEAR_FIRST, _fields("Y", "$1", "$3", "$4", "$5", "$6", "$7", "$8", "$9", "$10")))
        .when(
            third.isin(*marks) | second.isin(*marks),
            F.regexp_replace(text, _DAY_FIRST, _fields("D", "$4", "$3", "$1", "$5", "$6", "$7", "$8", "$9", "$10")),
        )
        .when(digits & (F.length(text) == 14), F.regexp_replace(text, _COMPACT, _fields("C", "$1", "$2", "$3", "$4", "$5", "$6", "", "", "")))
        .when(digits & F.length(text).isin(10, 13, 16), F.concat(F.lit("E" + SEP), text))
        .when(text.rlike(_NAMED), F.regexp_replace(text, _NAMED, _fields("N", "$3", "$2", "$1", "$4", "$5", "$6", "$7", "$8", "$9")))
        .otherwise(F.lit("")),
        SEP,
    )


def _wall_us(p: Column, month: Column, day: Column) -> Column:
    """Microseconds of the wall clock read as if it were UTC; null where no such date or time exists."""
    hour = F.get(p, F.lit(4)).try_cast("int")
    half = F.lower(F.get(p, F.lit(8)))
    hour = (
        F.when(half == "", hour)
        .when(~hour.between(1, 12), F.lit(None).cast("int"))
        .when(half == "pm", hour % 12 + 12)
        .otherwise(hour % 12)
    )
    second = F.get(p, F.lit(6))
    text = F.concat(
        F.get(p, F.lit(1)), F.lit("-"), month, F.lit("-"), day, F.lit("T"), hour.cast("string"), F.lit(":"), F.get(p, F.lit(5)),
        F.lit(":"), F.when(second == "", F.lit("00")).otherwise(second), F.lit("Z"),
    )
    fraction = F.get(p, F.lit(7))
    micros = F.when(fraction == "", F.lit(0)).otherwise(F.rpad(F.substring(fraction, 1, 6), 6, "0").try_cast("int"))
    return F.unix_micros(text.try_cast("timestamp")) + micros


def _zone_offset(p: Column) -> Column:
    """Offset in microseconds of an explicit zone; null where the text has none or one of no meaning."""
    zone = F.get(p, F.lit(9))
    sign = F.when(F.substring(zone, 1, 1) == "-", F.lit(-60_000_000)).otherwise(F.lit(60_000_000))
    hhmm = F.regexp_replace(F.regexp_replace(zone, r"^(?i:UTC|GMT)?([+-])(\d{2}):?(\d{2})?(?:\[.*\]|\s*\(.*\))?$", "$2$3"), r"^(\d{2})$", "$100")
    number = F.when(F.length(hhmm) == 4, hhmm.try_cast("int"))
    return (
        F.when(zone == "", F.lit(None).cast("bigint"))
        .when(F.upper(zone).isin("Z", "UTC", "GMT"), F.lit(0).cast("bigint"))
        .when(number <= 1859, (F.floor(number / 100) * 60 + number % 100).cast("bigint") * sign)
    )


def zoned_instants(wall_us: Column, zone: Column) -> Column:
    """All instants at which a clock of the zone shows the wall time, the earlier first.

    A time skipped by a clock change takes the offset before the change; a time
    shown twice gives two instants. Null zone: empty.
    """
    as_ts = F.timestamp_micros(wall_us)
    first = F.unix_micros(F.to_utc_timestamp(as_ts, zone))
    probe = first + F.lit(3 * 3_600_000_000)
    after = F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(probe), zone)) - probe
    again = wall_us - after
    doubled = (again > first) & (F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(again), zone)) == wall_us)
    return (
        F.when(zone.isNull() | wall_us.isNull(), F.array().cast("array<bigint>"))
        .when(zone == "UTC", F.array(wall_us))
        .when(doubled, F.array(first, again))
        .otherwise(F.array(first))
    )


def with_readings(df: DataFrame, source: str, out: str, zone: Column | None = None) -> DataFrame:
    """Add ``out``: every valid reading of the text as array<struct<us, form, rank>>.

    ``zone`` is the zone of zone-less texts (null: such a text has no reading);
    without it they are UTC. ``rank`` 1 marks month before day where day before
    month is also possible. Also adds ``out_named``: whether the text names an
    existing date with a time of day, placeable or not. Null, blank and
    unreadable texts give an empty array and false.
    """
    c, p, d, m, o = (f"__{out}_{x}" for x in "cpdmo")
    text = F.col(source)
    # most texts have the plainest form: one match and one cast instead of the families
    df = df.withColumn(c, F.coalesce(text.rlike(PLAIN), F.lit(False)))
    df = df.withColumn(p, F.when(~F.col(c), canonical_fields(text)))
    plain, fields = F.col(c), F.col(p)
    kind = F.get(fields, F.lit(0))
    a, b = F.get(fields, F.lit(2)), F.get(fields, F.lit(3))
    month = F.when(kind == "N", _month_number(a)).otherwise(a)
    number = F.when(kind == "E", F.get(fields, F.lit(1)).try_cast("bigint"))
    width = F.length(F.get(fields, F.lit(1)))
    epoch = number * F.when(width == 10, F.lit(1_000_000)).when(width == 13, F.lit(1000)).otherwise(F.lit(1))
    df = df.withColumns(
        {
            d: F.when(plain, F.unix_micros(F.concat(text, F.lit("Z")).try_cast("timestamp"))).when(kind == "E", epoch).when(kind != "", _wall_us(fields, month, b)),
            m: F.when((kind == "D") & (a != b), _wall_us(fields, b, a)),
            o: F.when(kind == "E", F.lit(0).cast("bigint")).when(kind != "", _zone_offset(fields)),
        }
    )
    no_zone = F.coalesce(F.get(F.col(p), F.lit(9)), F.lit("")) == ""
    form = F.when(plain, F.lit(FORMS["Y"]).cast("tinyint"))
    for name, code in FORMS.items():
        form = form.when(F.get(F.col(p), F.lit(0)) == name, F.lit(code).cast("tinyint"))
    none = F.array().cast(READING)

    def readings(wall: Column, rank: Column) -> Column:
        one = lambda us: F.struct(us.alias("us"), form.alias("form"), rank.cast("tinyint").alias("rank"))
        offset = F.col(o)
        stated = F.when(wall.isNull(), none).when(offset.isNotNull(), F.array(one(wall - offset))).when(~no_zone, none)
        if zone is None:
            return stated.otherwise(F.array(one(wall)))
        return stated.when(zone == "UTC", F.array(one(wall))).when(zone.isNull(), none).otherwise(F.transform(zoned_instants(wall, zone), one))

    first = readings(F.col(d), F.lit(0))
    both = F.col(d).isNotNull()
    return computed_once(
        df,
        **{
            out: F.when(F.col(m).isNull(), first).otherwise(F.concat(first, readings(F.col(m), F.when(both, F.lit(1)).otherwise(F.lit(0))))),
            f"{out}_named": (F.col(d).isNotNull() | F.col(m).isNotNull()) & (no_zone | F.col(o).isNotNull()),
        },
    ).drop(c, p, d, m, o)


def _month_number(name: Column) -> Column:
    at = F.instr(F.lit("".join(MONTHS)), F.lower(name))
    return F.when((at > 0) & (at % 3 == 1), F.floor((at - 1) / 3 + 1).cast("string"))


def device_key(value: Column) -> Column:
    """A device serial without spaces and leading M; null where nothing is left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(value, r"\s+", ""), "^M", ""), F.lit(""))
