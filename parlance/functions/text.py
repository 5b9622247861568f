"""Text expressions with the semantics of Python's ``re`` and ``str.strip``, and portable hashes. All stay in the JVM."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One turn a line: speaker(uN): text. Flags: multi-line, only \n ends a line, Unicode classes.
TURN = r"(?mdU)^(agent|customer)\(u(\d+)\):[\s\x1c-\x1f]*(.+)$"
#: Stand-in tokens: a marker, or a run of anything but white space and "<", or a lone "<".
TOKEN = r"<\|/?[a-z]+\|>|[^ \n<]+|<"
STOPS = r"<\|customer\|>|<\|/conversation\|>|<\|agent\|>"
RESERVED = 16


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def hash32(c: Column) -> Column:
    """First 32 bits of the MD5 of a text, as a number; DuckDB can compute the same."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 8), 16, 10).cast("long")


def rounded(c: Column, places: int) -> Column:
    """A double rounded as DuckDB rounds it: the nearest whole of c * 10^places, halves away from zero.

    Spark's own goes by the shortest decimal, so 0.32985 gives 0.3299 there; as a double it is less, and gives 0.3298 here.
    """
    scaled = c.cast("double") * F.lit(float(10**places))
    whole = F.floor(F.abs(scaled))
    return F.signum(scaled) * (whole + F.when(F.abs(scaled) - whole >= 0.5, 1.0).otherwise(0.0)) / F.lit(float(10**places)) + F.lit(0.0)


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def token_ids(token_array: Column, markers: tuple[str, ...]) -> Column:
    """Stand-in ids: 0 ends a text and pads, 1.. are the markers, others a hash."""
    known = F.array(*[F.lit(f"<|{m}|>") for m in markers])

    def one(t: Column) -> Column:
        at = F.array_position(known, t)
        return F.when(at > 0, at).otherwise(F.pmod(hash32(t), F.lit(50_000)) + RESERVED).cast("int")

    return F.transform(token_array, one)


@lru_cache(maxsize=1)
def _digits() -> tuple[str, str]:
    """All decimal digits beyond ASCII and what they mean."""
    found = [chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]
    return "".join(found), "".join(str(unicodedata.decimal(c)) for c in found)


def integer(c: Column) -> Column:
    """A text of decimal digits of any script as an int; null if it is none or too large."""
    return F.translate(c, *_digits()).try_cast("int")


def rating(c: Column) -> Column:
    """A judge's answer as 1 to 5; what is no integer counts as 3."""
    n = strip(c).try_cast("int")
    return F.when(n.isNull(), 3).otherwise(F.greatest(F.lit(1), F.least(F.lit(5), n)))


def trim_response(c: Column, eos: str | None = None) -> Column:
    """Generated text up to the first stop marker or a non-empty ``eos``, stripped."""
    stops = STOPS + (f"|\\Q{eos}\\E" if eos else "")
    return strip(F.element_at(F.split(c, stops, 2), 1))


def preview(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)
