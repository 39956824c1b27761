"""Text and time-text helpers."""

import datetime as dt

_BLANKS = " \t\n\r\x0b\x0c" + chr(0xA0) + chr(0xFEFF)  # space-like characters


def strip(text: str) -> str:
    """Trim every kind of blank, not only spaces."""
    return f"btrim({text}, '{_BLANKS}')"


def empty_to_null(text: str) -> str:
    return f"nullif({text}, '')"


def or_else(text: str, fallback: str) -> str:
    """The text, or the fallback expression when it is null or empty."""
    return f"coalesce(nullif({text}, ''), {fallback})"


def json_text_or_null(text: str) -> str:
    """The text when it parses as JSON other than ``null``, else null.

    The variant parser refuses objects that repeat a key; those count as
    JSON too. As the only element of an array such a text is read to its end;
    quotes outside its strings then tell that it is no strict JSON.
    """
    value = f"try_parse_json({text})"
    bare = rf"regexp_replace({text}, r'\x22(?:[^\x22\\]|\\.)*+\x22', '')"
    repeated = f"{value} is null and json_array_length(concat('[', {text}, ']')) = 1 and instr({bare}, chr(39)) = 0"
    return f"(case when {value} is not null and not is_variant_null({value}) or {repeated} then {text} end)"


def utc_literal(when: dt.datetime) -> str:
    """A zone-less time as it is, untouched by the session or machine time zone."""
    return f"timestamp_ntz'{when}'"


def utc_of_instant(instant: str) -> str:
    """A timestamp with time zone as zone-less UTC time, whatever the session zone."""
    return f"timestampadd(MICROSECOND, unix_micros({instant}), timestamp_ntz'1970-01-01 00:00:00')"


_MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"


def _iso(text: str) -> str:
    """Time text of a browser or a sheet (``2024/01/05 10:00:00``, ``Fri Jan 05 2024 10:00:00 GMT-0300 (x)``) as ISO text."""
    shown = r"r'^[A-Z][a-z]{2} ([A-Z][a-z]{2}) ([0-9]{2}) ([0-9]{4})(?: ([0-9:]{8})(?: ?(?:GMT|UTC)([+-][0-9]{2})?([0-9]{2})?)?)?.*$'"
    part = [f"regexp_extract({text}, {shown}, {i})" for i in range(7)]
    month = f"lpad(cast((locate({part[1]}, '{_MONTHS}') + 2) / 3 as int), 2, '0')"
    clock = f"coalesce(nullif({part[4]}, ''), '00:00:00')"
    zone = f"case when {part[5]} != '' then concat({part[5]}, ':', {part[6]}) when {text} rlike '(GMT|UTC)' then 'Z' else '' end"
    slashed = r"r'^([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})'"
    return (
        f"(case when {text} rlike r'^[0-9]{{4}}-' then {text}"
        f" when {text} rlike {shown} then concat({part[3]}, '-', {month}, '-', {part[2]}, ' ', {clock}, {zone})"
        f" when {text} rlike {slashed} then regexp_replace({text}, {slashed}, '$1-$2-$3') else {_iso_of_words(text)} end)"
    )


def _iso_of_words(text: str) -> str:
    """``Jan 5, 2024``, ``5 January 2024 10:00 PM``, ``1/5/2024 10:00`` (month first) or a mail header's time as ISO text; else null.

    A weekday in front and a remark in brackets behind are passed over.
    """
    day_first = r"r'^(?:[A-Z][a-z]+,? )?([0-9]{1,2})[ -]([A-Z][a-z]{2})[a-z]*[.]?[ -]([0-9]{4})'"
    numbers = r"r'^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})'"
    # all forms with the month in front
    front = f"regexp_replace(regexp_replace({text}, {day_first}, '$2 $1 $3'), {numbers}, '$1 $2 $3')"
    form = (
        r"r'^(?:[A-Z][a-z]+,? )?([A-Z][a-z]{2}|[0-9]{1,2})[a-z]*[.]? ([0-9]{1,2}),? ([0-9]{4})"
        r"(?:,? ([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?(?: ?([AaPp])[Mm])? ?(GMT|UTC|Z)?(?:([+-][0-9]{2}):?([0-9]{2}))?)?(?: [(].*[)])?$'"
    )
    month, day, year, hour, minute, second, half, utc, ahead, rest = (f"regexp_extract(f, {form}, {i})" for i in range(1, 11))
    month = f"if({month} rlike '^[0-9]', {month}, cast((locate({month}, '{_MONTHS}') + 2) / 3 as int))"
    whole = f"cast({hour} as int)"
    of_half = f"case when {whole} between 1 and 12 then {whole} % 12 + if(lower({half}) = 'p', 12, 0) end"
    clock = f"if({hour} = '', '00:00:00', concat(lpad(if({half} = '', {whole}, {of_half}), 2, '0'), ':', {minute}, ':', coalesce(nullif({second}, ''), '00')))"
    zone = f"case when {ahead} != '' then concat({ahead}, ':', {rest}) when {utc} != '' then 'Z' else '' end"
    iso = f"case when f rlike {form} then concat({year}, '-', lpad({month}, 2, '0'), '-', lpad({day}, 2, '0'), ' ', {clock}, {zone}) end"
    return f"get(transform(array({front}), f -> {iso}), 0)"


def utc_timestamp(text: str, zone: str = "UTC") -> str:
    """Text to a zone-less UTC timestamp, null when it is no date.

    Text with an offset is moved to UTC, text without one is a time of
    ``zone``, whatever the session time zone is.
    """
    raw = "t"
    offset = r"r'[0-9]{2}:[0-9]{2}.*(Z|[+-][0-9]{2}:?[0-9]{2})$'"
    instant = utc_of_instant(f"try_cast({raw} as timestamp)")
    # named once, so that the long text is not repeated in every branch
    read = (
        f"(case when {raw} rlike {offset} then {instant} "
        f"when {raw} rlike r'^[0-9]{{4}}(-|$)' then convert_timezone('{zone}', 'UTC', try_cast({raw} as timestamp_ntz)) end)"
    )
    return f"get(transform(array({strip(text)}), t -> get(transform(array({_iso('t')}), t -> {read}), 0)), 0)"
