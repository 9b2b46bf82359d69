"""SQL twins of the timestamp readings: an independent way to the same instants."""

from __future__ import annotations

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?\s*([AaPp][Mm])?\s*(.*)"
_NAMES = "'h', 'mi', 's', 'f', 'ap', 'z'"
_MONTHS = "['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec']"


def _family(pattern: str, names: str) -> str:
    return f"CASE WHEN regexp_full_match(t, '{pattern}') THEN regexp_extract(t, '^{pattern}$', [{names}]) END"


def _wall(y: str, mo: str, d: str) -> str:
    hour = "CASE WHEN g.ap = '' THEN TRY_CAST(g.h AS INT) WHEN TRY_CAST(g.h AS INT) BETWEEN 1 AND 12 THEN TRY_CAST(g.h AS INT) % 12 + CASE WHEN lower(g.ap) = 'pm' THEN 12 ELSE 0 END END"
    text = f"{y} || '-' || {mo} || '-' || {d} || ' ' || ({hour}) || ':' || g.mi || ':' || CASE WHEN g.s = '' THEN '00' ELSE g.s END"
    return f"CASE WHEN ({hour}) < 24 THEN epoch_us(TRY_CAST({text} AS TIMESTAMP)) + CASE WHEN g.f = '' THEN 0 ELSE CAST(rpad(g.f[:6], 6, '0') AS BIGINT) END END"


def readings(source: str, value: str, name: str) -> str:
    """CTEs ending in ``name``: the rows of ``source`` with day_first and month_first (microseconds of the
    wall clock), offset (null: no zone stated) and zone_ok, from the text column ``value``."""
    year_first = _family(r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?:[Tt]|\s+)" + _CLOCK, f"'y', 'mo', 'd', {_NAMES}")
    day_first = _family(r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})(?:[Tt]|,?\s+)" + _CLOCK, f"'d', 'mo', 'y', {_NAMES}")
    by_name = _family(r"(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})[\s-]+([A-Za-z]{3})[A-Za-z]*\.?[\s-]+(\d{4}),?\s+" + _CLOCK, f"'d', 'mo', 'y', {_NAMES}")
    compact = r"regexp_extract(regexp_replace(t, '^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$', '\1-\2-\3 \4:\5:\6'), '^(\d{4})-(\d\d)-(\d\d) (\d\d):(\d\d):(\d\d)()()()$', ['y', 'mo', 'd', 'h', 'mi', 's', 'f', 'ap', 'z'])"
    return rf"""
{name}_a AS (SELECT *, regexp_replace({value}, '^\s+|\s+$', '', 'g') AS t FROM {source}),
{name}_b AS (
  SELECT *, regexp_full_match(t, '\d{{10}}|\d{{13}}|\d{{16}}') AS is_epoch, coalesce({year_first}, CASE WHEN regexp_full_match(t, '\d{{14}}') THEN {compact} END) AS ymd,
    {day_first} AS dmy, {by_name} AS named
  FROM {name}_a),
{name}_c AS (
  SELECT * EXCLUDE (ymd, dmy, named), {{'y': coalesce(ymd.y, dmy.y, named.y), 'mo': coalesce(ymd.mo, dmy.mo, CAST(list_position({_MONTHS}, lower(named.mo)) AS VARCHAR)), 'd': coalesce(ymd.d, dmy.d, named.d),
    'h': coalesce(ymd.h, dmy.h, named.h), 'mi': coalesce(ymd.mi, dmy.mi, named.mi), 's': coalesce(ymd.s, dmy.s, named.s), 'f': coalesce(ymd.f, dmy.f, named.f),
    'ap': coalesce(ymd.ap, dmy.ap, named.ap), 'z': coalesce(ymd.z, dmy.z, named.z)}} AS g, dmy IS NOT NULL AS either
  FROM {name}_b),
{name} AS (
  SELECT rn, CASE WHEN is_epoch THEN TRY_CAST(t AS BIGINT) * CASE length(t) WHEN 10 THEN 1000000 WHEN 13 THEN 1000 ELSE 1 END ELSE {_wall('g.y', 'g.mo', 'g.d')} END AS day_first,
    CASE WHEN either THEN {_wall('g.y', 'g.d', 'g.mo')} END AS month_first,
    CASE WHEN is_epoch OR upper(g.z) IN ('Z', 'UTC', 'GMT') THEN 0
      WHEN regexp_full_match(g.z, '[+-]\d{{2}}:?\d{{2}}(\[.*\])?') THEN (TRY_CAST(g.z[2:3] AS BIGINT) * 60 + TRY_CAST(regexp_extract(g.z, '^.\d\d:?(\d\d)', 1) AS BIGINT)) * CASE WHEN g.z[1] = '-' THEN -60000000 ELSE 60000000 END END AS off_us,
    is_epoch OR g.z = '' OR upper(g.z) IN ('Z', 'UTC', 'GMT') OR regexp_full_match(g.z, '[+-]\d{{2}}:?\d{{2}}(\[.*\])?') AS zone_ok
  FROM {name}_c)"""


_SHOWN = "epoch_us((make_timestamptz({0})) AT TIME ZONE zone)"


def placed(source: str = "tracker_logs") -> str:
    """CTEs ending in ``placed``: source rows with tm_us, ds_us, tm_named and ds_named."""
    zones = [f"wall - ({h * 1_800_000_000}::BIGINT)" for h in range(-28, 29)]
    return rf"""
numbered AS (SELECT row_number() OVER () AS rn, * FROM {source}),
{readings('numbered', '"TM_STAMP"', 'tm')},
{readings('numbered', '"DATA_SERVIDOR"', 'ds')},
both_texts AS (
  SELECT numbered.*, coalesce(tm.day_first, tm.month_first) AS wall, tm.off_us AS tm_off, coalesce(tm.zone_ok AND coalesce(tm.day_first, tm.month_first) IS NOT NULL, false) AS tm_named,
    CASE WHEN ds.zone_ok THEN coalesce(ds.day_first, ds.month_first) - coalesce(ds.off_us, 0) END AS ds_us, coalesce(ds.zone_ok AND coalesce(ds.day_first, ds.month_first) IS NOT NULL, false) AS ds_named,
    zones.zone
  FROM numbered JOIN tm USING (rn) JOIN ds USING (rn)
  LEFT JOIN (SELECT device_serial, min(zone_name) AS zone FROM device_clocks GROUP BY 1) zones ON zones.device_serial = nullif(regexp_replace(regexp_replace("S/N ou IMEI", '\s+', '', 'g'), '^M', ''), '')),
candidates AS (SELECT rn, zone, wall, ds_us, unnest([{', '.join(zones)}]) AS us FROM both_texts WHERE tm_named AND tm_off IS NULL AND zone IS NOT NULL),
fitting AS (
  SELECT rn, arg_min(us, (abs(us - coalesce(ds_us, us)), us)) AS us FROM candidates
  WHERE {_SHOWN.format('us')} = wall GROUP BY rn),
skipped AS (
  SELECT rn, wall - ({_SHOWN.format('wall - 86400000000')} - (wall - 86400000000)) AS us FROM both_texts WHERE tm_named AND tm_off IS NULL AND zone IS NOT NULL),
placed AS (
  SELECT both_texts.*, CASE WHEN tm_named THEN CASE WHEN tm_off IS NOT NULL THEN wall - tm_off ELSE coalesce(fitting.us, skipped.us) END END AS tm_us
  FROM both_texts LEFT JOIN fitting USING (rn) LEFT JOIN skipped USING (rn))"""


P7 = f"""WITH {placed()},
texts AS (SELECT row_id, 'TM_STAMP' AS field, tm_us AS utc_us, "TM_STAMP" AS shown FROM placed UNION SELECT row_id, 'DATA_SERVIDOR', ds_us, "DATA_SERVIDOR" FROM placed)
SELECT DISTINCT row_id, field, utc_us FROM texts WHERE utc_us IS NOT NULL AND (utc_us % 1000000 <> 0 OR shown <> strftime(make_timestamp(utc_us), '%Y-%m-%d %H:%M:%S'))"""

P4 = f"""WITH {placed()},
dated AS (SELECT batch_id, row_id, CAST(make_timestamp(coalesce(tm_us, ds_us)) AS DATE) AS event_day, TRY_CAST(ingestion_date AS DATE) AS arrived FROM placed)
SELECT batch_id, row_id, strftime(event_day, '%Y-%m-%d') AS event_date, CASE WHEN arrived - event_day <= 7 THEN 'corrects' ELSE 'dropped' END AS verdict FROM dated WHERE arrived - event_day >= 2"""

P4_DAILY = f"""WITH {placed()},
rows AS (
  SELECT regexp_replace(source_file, '_?[0-9]{{8,}}|_rev|\\.csv$', '', 'g') AS source, CAST(make_timestamp(coalesce(tm_us, ds_us)) AS DATE) AS event_day, TRY_CAST(ingestion_date AS DATE) AS arrived FROM placed),
loads AS (SELECT DISTINCT source, arrived FROM rows WHERE arrived IS NOT NULL),
calendar AS (SELECT DISTINCT CAST(arrived + i AS DATE) AS day FROM loads, unnest([0, 1, 2, 3]) t(i)),
low AS (
  SELECT day, min(last) AS low FROM (SELECT day, source, max(arrived) AS last FROM calendar JOIN loads ON arrived <= day GROUP BY 1, 2) WHERE day - last <= 3 GROUP BY day),
marks AS (SELECT day, max(low) OVER (ORDER BY day) - 7 AS mark FROM low),
days AS (
  SELECT event_day, count(*) FILTER (arrived - event_day < 2) AS on_time_count, count(*) FILTER (arrived - event_day BETWEEN 2 AND 7) AS corrected_count, count(*) FILTER (arrived - event_day > 7) AS dropped_count,
    count(DISTINCT arrived) FILTER (arrived - event_day BETWEEN 2 AND 7) AS revisions
  FROM rows WHERE event_day IS NOT NULL AND arrived IS NOT NULL GROUP BY event_day)
SELECT strftime(event_day, '%Y-%m-%d') AS event_date, on_time_count, corrected_count, dropped_count, on_time_count + corrected_count AS total_count, revisions,
  (SELECT strftime(min(day), '%Y-%m-%d') FROM marks WHERE mark > event_day) AS closed_on
FROM days"""

P4_DIVERTED = f"""{P4_DAILY[: P4_DAILY.index('days AS (')]}
closed AS (SELECT event_day, arrived, (SELECT min(day) FROM marks WHERE mark > event_day) AS closed_on FROM rows WHERE arrived - event_day > 7)
SELECT strftime(event_day, '%Y-%m-%d') AS event_date, strftime(any_value(closed_on), '%Y-%m-%d') AS closed_on, count(*) FILTER (closed_on IS NULL OR arrived < closed_on) AS before_closing_count,
  count(*) FILTER (arrived >= closed_on) AS after_closing_count
FROM closed GROUP BY event_day"""

_FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'


def _field(i: int) -> str:
    raw = f"regexp_extract(line_text, '^(?:{_FIELD},){{{i}}}({_FIELD})', 1)"
    return f"CASE WHEN {raw}[1] = '\"' THEN replace({raw}[2:-2], '\"\"', '\"') ELSE {raw} END"


P5 = rf"""WITH lines AS (
  SELECT line_key AS record_key, regexp_full_match(line_text, '{_FIELD}(?:,{_FIELD})*') AS sound, length(regexp_replace(regexp_replace(line_text, '"(?:[^"]|"")*"', '', 'g'), '[^,]', '', 'g')) AS commas,
    {_field(3)} AS kind, {_field(1)} AS tm, {_field(0)} AS ds, {_field(6)} AS serial
  FROM raw_lines WHERE line_text IS NOT NULL AND NOT regexp_full_match(line_text, '\s*')),
rows AS (
  SELECT row_number() OVER () AS rn, * FROM (
    SELECT record_key, CASE WHEN NOT sound THEN 'BROKEN_QUOTING' WHEN commas <> 36 THEN 'COLUMN_COUNT' END AS defect, kind, tm AS tm_text, ds AS ds_text, serial FROM lines
    UNION ALL SELECT row_id, NULL, "MESS_TYPE", "TM_STAMP", "DATA_SERVIDOR", "S/N ou IMEI" FROM tracker_logs)),
{readings('rows', 'tm_text', 'a')},
{readings('rows', 'ds_text', 'b')},
judged AS (
  SELECT rows.record_key, CASE WHEN rows.defect IS NOT NULL THEN rows.defect WHEN coalesce(trim(rows.kind), '') = '' THEN 'MISSING_MESSAGE_TYPE'
    WHEN NOT regexp_full_match(trim(rows.kind), 'T[0-9]+') THEN 'INVALID_MESSAGE_TYPE'
    WHEN NOT (coalesce(a.zone_ok AND coalesce(a.day_first, a.month_first) IS NOT NULL, false) OR coalesce(b.zone_ok AND coalesce(b.day_first, b.month_first) IS NOT NULL, false)) THEN 'MISSING_OR_INVALID_TIMESTAMP'
    WHEN coalesce(trim(rows.serial), '') = '' THEN 'MISSING_DEVICE_SERIAL' END AS reason
  FROM rows JOIN a USING (rn) JOIN b USING (rn))
SELECT record_key, min(reason) AS reason FROM judged WHERE reason IS NOT NULL GROUP BY record_key"""
