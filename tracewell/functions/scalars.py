"""Column functions: little-endian numbers, packed dates, Unix times, ISO text, digests and formatting."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def le_uint(content: Column, at: int, size: int) -> Column:
    """The unsigned little-endian number of 1 to 7 bytes at a place (0-based) of a binary value; null past its end."""
    byte = lambda k: F.conv(F.hex(F.substring(content, at + k + 1, 1)), 16, 10).cast("long") * F.lit(256**k)
    total = byte(0)
    for k in range(1, size):
        total = total + byte(k)
    return F.when(F.octet_length(content) >= at + size, total)


def packed_datetime(raw: Column) -> Column:
    """A 32-bit packed date (second, minute, hour, day, month, year from 2000; 6+6+5+5+4+6 bits upwards) as a timestamp
    without zone; null where the fields are no date."""
    bits = lambda n, width: F.shiftright(raw, n).bitwiseAND(F.lit((1 << width) - 1)).cast("int")
    return F.when(
        bits(0, 6) < 60, F.try_make_timestamp_ntz(bits(26, 6) + 2000, bits(22, 4), bits(17, 5), bits(12, 5), bits(6, 6), bits(0, 6).cast("decimal(16,6)"))
    )


def micros(moment: Column) -> Column:
    """A timestamp without zone as microseconds since 1970."""
    return F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), moment)


#: Unix times accepted as device times, and the mark of a recording in progress.
UNIX_LOW, UNIX_HIGH, RECORDING_NOW = 946_684_800, 4_102_444_800, 0x7FFFFFFF


def unix_local(raw: Column) -> Column:
    """Unix seconds as a device's wall clock; null outside 2000 to 2100 and for a recording in progress."""
    fits = (raw >= UNIX_LOW) & (raw < UNIX_HIGH) & (raw != RECORDING_NOW)
    return F.when(fits, F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(secs=raw.cast("decimal(18,6)")))


def iso_local(moment: Column) -> Column:
    """A timestamp as YYYY-MM-DDTHH:MM:SS, with six digits of fraction only where there is one."""
    whole = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(moment, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat_ws(".", whole, micros))


def rfc3339(moment: Column) -> Column:
    """A UTC timestamp as YYYY-MM-DDTHH:MM:SS.ffffffZ (the session's zone must be UTC)."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def digests(content: Column) -> Column:
    """MD5, SHA-1 and SHA-256 of a value in lower-case hex."""
    return F.struct(F.md5(content).alias("md5"), F.sha1(content).alias("sha1"), F.sha2(content, 256).alias("sha256"))


def human_bytes(n: Column) -> Column:
    """Bytes in binary units, one digit after the point from KiB on."""
    units = ["KiB", "MiB", "GiB", "TiB"]
    out = F.concat(n.cast("long").cast("string"), F.lit(" B"))
    for k, unit in enumerate(units, 1):
        out = F.when(n >= 1024**k, F.format_string(f"%.1f {unit}", F.bround(n / F.lit(float(1024**k)), 1))).otherwise(out)
    return out


def human_duration(seconds: Column) -> Column:
    """Whole hours, minutes and seconds: 1 h 02 min 03 s."""
    s = F.rint(seconds).cast("long")
    h, m = F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long")
    return F.when(h > 0, F.format_string("%d h %02d min %02d s", h, m, s % 60)).when(m > 0, F.format_string("%d min %02d s", m, s % 60)).otherwise(F.format_string("%d s", s % 60))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole to two digits, 0 for no whole."""
    return F.when(whole != 0, F.round(100.0 * part / whole, 2)).otherwise(0.0)


def numbered(prefix: str, rank: Column, digits: int = 3) -> Column:
    """An identifier of a prefix and a zero-padded number."""
    return F.format_string(f"{prefix}-%0{digits}d", rank)


def sorted_map(m: Column) -> Column:
    """A map with its entries in key order."""
    return F.map_from_entries(F.array_sort(F.map_entries(m)))


def crc32_mpeg2(content: Column) -> Column:
    """CRC-32/MPEG-2 of a binary value: polynomial 04C11DB7, bits in order, no final complement.

    It is the common CRC-32 of the bytes with their bits reversed, complemented and with its own bits reversed."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else int(f"{zlib.crc32(v.translate(_MIRRORED)) ^ 0xFFFFFFFF:032b}"[::-1], 2)).astype("Int64")

    return F.pandas_udf(run, "long")(content)


_MIRRORED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
