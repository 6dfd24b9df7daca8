"""Column expressions on log lines: trimming and parsing."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobtrail.functions.scalars import let

# The characters with the Unicode White_Space property.
SPACE = (
    "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# A structured application line holds these three fields in this order. The first time, the first
# level after it and any message after that decide, so each is looked for once: a line of any length takes linear time.
STRUCTURED_LINE = r'\A(?>(?s:.*?)time="[^"]*+")(?>[^\n]*?level="[^"]*+")[^\n]*?msg="[^"]*+"'

_RFC3339 = r"^(\d{4}-\d{2}-\d{2})T(\d{1,2}):(\d{2}:\d{2})(?:[.,](\d+))?(Z|[+-](?:[01]\d|2[0-4]):[0-5]\d)\z"


def trim_space(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def is_structured(line: Column) -> Column:
    # The plain substring tests spare most lines the regular expression.
    hints = line.contains('time="') & line.contains('level="') & line.contains('msg="')
    return hints & line.rlike(STRUCTURED_LINE)


def rfc3339(text: Column) -> Column:
    """Instant of an RFC 3339 text, to the microsecond; NULL for anything else."""
    # Spark reads all of these texts but for a decimal comma and zones beyond 18 hours.
    plain = F.translate(text, ",", ".")
    far = text.rlike(r"[+-](?:18:(?!00)|19|2[0-4]):?[0-5]\d\z")
    return F.when(text.rlike(_RFC3339), F.when(far, _far_zone(plain)).otherwise(plain.try_cast("timestamp")))


def _far_zone(text: Column) -> Column:
    at = F.length(text) - 5
    utc = F.concat(F.substring(text, F.lit(1), at), F.lit("Z")).try_cast("timestamp")
    zone = F.substring(text, at + 1, F.lit(6))
    offset = F.substring(zone, 2, 2).try_cast("bigint") * 3600 + F.substring(zone, 5, 2).try_cast("bigint") * 60
    signed = F.when(zone.startswith("-"), -offset).otherwise(offset)
    return F.timestamp_micros(F.unix_micros(utc) - signed * F.lit(1_000_000))


def rfc3339_nanos(text: Column) -> Column:
    """Nanosecond of the second, for order below the microsecond that timestamps keep."""
    digits = F.rpad(F.substring(F.regexp_extract(text, _RFC3339, 4), 1, 9), 9, "0")
    return F.when(rfc3339(text).isNotNull(), digits.cast("int"))


def parse_line(line: Column, fallback_ts: Column) -> Column:
    """struct(ts, message, kind) of one trimmed line; kind is structured, simple or fallback.

    ``fallback_ts`` stands in where a line carries no readable time of its own.
    """

    def with_time(line_parts: Column) -> Column:
        pieces, structured = line_parts["p"], line_parts["structured"]
        embedded = F.regexp_replace(F.get(pieces, F.lit(1)), r'^time="|"\z', "")
        ts = rfc3339(F.when(structured, embedded).otherwise(F.get(pieces, F.lit(0))))
        # Without a time, or cut too short, a line is its own message.
        whole = F.when(structured, F.size(pieces) < 3).otherwise(ts.isNull())
        return let(F.struct(pieces.alias("p"), structured.alias("structured"), ts.alias("ts"), whole.alias("whole")), entry)

    def entry(x: Column) -> Column:
        # Of a simple line, everything after the first blank is the message.
        rest = F.substring(line, F.length(F.get(x["p"], F.lit(0))) + 2, F.length(line))
        message = F.when(x["whole"], line).when(x["structured"], F.get(x["p"], F.lit(2))).otherwise(rest)
        kind = F.when(x["whole"] | x["ts"].isNull(), "fallback").when(x["structured"], "structured").otherwise("simple")
        ts = F.coalesce(F.when(~x["whole"], x["ts"]), fallback_ts)
        return F.struct(ts.alias("ts"), message.alias("message"), kind.alias("kind"))

    pieces = F.split(line, " ", 3)
    return let(F.struct(pieces.alias("p"), is_structured(line).alias("structured")), with_time)
