"""MySQL's scalar functions where they differ from Spark's, as built-in expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date format letters and the pattern letters that mean the same. %D, %U and the like have no twin.
DATE_LETTERS = {
    "a": "EEE", "b": "MMM", "c": "M", "d": "dd", "e": "d", "f": "SSSSSS", "H": "HH", "h": "hh", "I": "hh", "i": "mm",
    "j": "DDD", "k": "H", "l": "h", "M": "MMMM", "m": "MM", "p": "a", "r": "hh:mm:ss a", "S": "ss", "s": "ss",
    "T": "HH:mm:ss", "W": "EEEE", "Y": "yyyy", "y": "yy", "%": "%",
}


def date_pattern(pattern: str) -> str:
    """Spark's datetime pattern for a MySQL one, its plain text quoted."""
    out, plain, i = [], "", 0

    def flush() -> None:
        nonlocal plain
        if plain:
            out.append("'" + plain.replace("'", "''") + "'" if any(c.isalpha() or c in "'#{}[]" for c in plain) else plain)
            plain = ""

    while i < len(pattern):
        if pattern[i] == "%" and i + 1 < len(pattern):
            letters = DATE_LETTERS.get(pattern[i + 1])
            if letters is None:
                raise ValueError(f"date format letter %{pattern[i + 1]} has no counterpart")
            if letters == "%":
                plain += "%"
            else:
                flush()
                out.append(letters)
            i += 2
        else:
            plain += pattern[i]
            i += 1
    flush()
    return "".join(out)


def date_format(column: Column, pattern: str) -> Column:
    return F.date_format(column, date_pattern(pattern))


def length(column: Column) -> Column:
    """Bytes, as MySQL counts; ``char_length`` counts characters."""
    return F.octet_length(column)


def truth(column: Column) -> Column:
    """0 or 1 for a comparison, null where it is unknown."""
    return column.cast("int")


def to_signed(column: Column) -> Column:
    return column.cast("bigint")


def to_unsigned(column: Column) -> Column:
    """Unsigned 64-bit; negative numbers wrap as in two's complement."""
    whole = column.cast("decimal(20,0)")
    return F.when(whole < 0, whole + F.lit(Decimal(1 << 64))).otherwise(whole).cast("decimal(20,0)")


# ---- SQL texts, for the dialect. A value used several times is named once, as the argument of a lambda. -------------

#: Values of 64-bit numbers with and without a sign wrap at these.
_HALF, _WHOLE = 1 << 63, 1 << 64


def _named(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _number_sql(value: str) -> str:
    """The value as a whole number: numbers are rounded, texts read as far as they are a number, times by their digits."""
    text = f"CAST({value} AS STRING)"
    lead = f"regexp_extract({text}, '^ *([+-]?[0-9]+)', 1)"
    return (
        f"CAST(CASE WHEN {value} IS NULL THEN NULL WHEN typeof({value}) = 'string' THEN coalesce(nullif({lead}, ''), '0') "
        f"WHEN typeof({value}) = 'boolean' THEN IF({text} = 'true', '1', '0') "
        f"WHEN typeof({value}) IN ('date', 'timestamp', 'timestamp_ntz') THEN regexp_replace(substring({text}, 1, 19), '[^0-9]', '') "
        f"ELSE {text} END AS DECIMAL(38, 0))"
    )


def signed_sql(value: str) -> str:
    """CAST .. AS SIGNED: beyond 64 bits the number wraps."""
    wrapped = f"CAST(pmod({_number_sql(value)} + {_HALF}BD, {_WHOLE}BD) - {_HALF}BD AS BIGINT)"
    return f"CASE WHEN typeof({value}) IN ('tinyint', 'smallint', 'int', 'bigint') THEN CAST({value} AS BIGINT) ELSE {wrapped} END"


def unsigned_sql(value: str) -> str:
    """CAST .. AS UNSIGNED: a negative number wraps."""
    return f"CAST(pmod({_number_sql(value)}, {_WHOLE}BD) AS DECIMAL(20, 0))"


def time_us(text: str) -> str:
    """Microseconds of a time as text: [-][days ]hours:minutes[:seconds[.fraction]], or digits hhmmss; a date before it is dropped."""
    clock = f"regexp_replace(trim({text}), '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}([ T]|$)', '')"
    bare = "regexp_replace(s, '^-', '')"
    days = f"coalesce(CAST(nullif(regexp_extract({bare}, '^([0-9]+) ', 1), '') AS BIGINT), 0L)"
    rest = f"regexp_replace({bare}, '^[0-9]+ +', '')"
    part = lambda i: f"coalesce(CAST(nullif(regexp_extract(c, '^([0-9]*):?([0-9]*):?([0-9]*)', {i}), '') AS BIGINT), 0L)"
    fraction = "coalesce(CAST(rpad(nullif(regexp_extract(c, '[.]([0-9]{1,6})', 1), ''), 6, '0') AS BIGINT), 0L)"
    digits = "coalesce(CAST(nullif(regexp_extract(c, '^([0-9]+)', 1), '') AS BIGINT), 0L)"
    # 'days hours' has a blank and no colon.
    seconds = f"CASE WHEN contains(c, ':') THEN {part(1)} * 3600 + {part(2)} * 60 + {part(3)} WHEN contains(s, ' ') THEN {digits} * 3600 ELSE {digits} div 10000 * 3600 + {digits} div 100 % 100 * 60 + {digits} % 100 END"
    return _named(clock, "s", f"IF(s IS NULL, NULL, IF(startswith(s, '-'), -1L, 1L) * ({days} * 86400000000 + " + _named(rest, "c", f"({seconds}) * 1000000 + {fraction}") + "))")


def time_text(us: str) -> str:
    """The text of a time in microseconds."""
    two = lambda n: f"lpad(CAST({n} AS STRING), 2, '0')"
    hours = "CAST(abs(u) div 3600000000 AS STRING)"
    fraction = "IF(abs(u) % 1000000 = 0, '', concat('.', lpad(CAST(abs(u) % 1000000 AS STRING), 6, '0')))"
    return _named(us, "u", f"concat(IF(u < 0, '-', ''), lpad({hours}, greatest(2, length({hours})), '0'), ':', {two('abs(u) div 60000000 % 60')}, ':', {two('abs(u) div 1000000 % 60')}, {fraction})")


def weekday_sql(value: str) -> str:
    """Day of the week, 0 for Sunday, as text."""
    return f"CAST(dayofweek({value}) - 1 AS STRING)"


def ordinal_day_sql(value: str) -> str:
    """Day of the month with its English ending."""
    day = f"dayofmonth({value})"
    return f"concat(CAST({day} AS STRING), CASE WHEN {day} IN (11, 12, 13) THEN 'th' WHEN {day} % 10 = 1 THEN 'st' WHEN {day} % 10 = 2 THEN 'nd' WHEN {day} % 10 = 3 THEN 'rd' ELSE 'th' END)"


def interval_sql(count: str, unit: str) -> str | None:
    """An interval of so many units; None for a unit of several parts."""
    months = {"MONTH": 1, "QUARTER": 3, "YEAR": 12}
    if unit in months:
        return f"make_ym_interval(0, CAST(({count}) * {months[unit]} AS INT))"
    days = {"DAY": 1, "WEEK": 7}
    if unit in days:
        return f"CAST(CAST(({count}) * {days[unit]} AS INT) AS INTERVAL DAY)"
    seconds = {"HOUR": "3600", "MINUTE": "60", "SECOND": "1", "MICROSECOND": "0.000001"}
    return f"make_dt_interval(0, 0, 0, CAST(({count}) * {seconds[unit]} AS DECIMAL(18, 6)))" if unit in seconds else None


# ---- columns -------------------------------------------------------------------------------------------------------


def addtime(moment: Column, text: str) -> Column:
    """Adds a time written as [days ]hours:minutes:seconds[.fraction], with an optional minus sign."""
    sign, rest = (-1, text.strip()[1:]) if text.strip().startswith("-") else (1, text.strip())
    days, _, clock = rest.rpartition(" ")
    parts = [float(x) for x in clock.split(":")]
    seconds = sum(x * 60**i for i, x in enumerate(reversed(parts))) + 86400 * int(days or 0)
    return moment + F.make_dt_interval(secs=F.lit(round(sign * seconds, 6)).cast("decimal(18,6)"))


def same_text(a: Column, b: Column) -> Column:
    """Equality under MySQL's default collation, which ignores letter case."""
    return F.collate(a, "UTF8_LCASE") == F.collate(b, "UTF8_LCASE")


def match_against(columns: list[Column], query: str) -> Column:
    """Full-text match of plain words: a row matches if any column holds any of the words.

    An n-gram index finds a word wherever it stands, in Chinese text as in any other, so containment is the test;
    letter case is ignored. A null column holds nothing.
    """
    words = query.lower().split() or [""]
    found = F.lit(False)
    for c in columns:
        for w in words:
            found = found | F.coalesce(F.contains(F.lower(c), F.lit(w)), F.lit(False))
    return found
