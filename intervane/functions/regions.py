"""Region strings such as ``chr1:1,000-2_000``."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from intervane.errors import NotARegion

#: A region begins with a name without a colon, then a colon and two numbers with a hyphen between; what follows is not looked at.
_NAME, _DIGITS = "[^:]+", "[0-9,_]+"
_PARTS = {"seqname": f"^({_NAME}):{_DIGITS}-{_DIGITS}", "start_": f"^{_NAME}:({_DIGITS})-{_DIGITS}", "end_": f"^{_NAME}:{_DIGITS}-({_DIGITS})"}


def region_column(text: Column, strip_prefix: bool = False) -> Column:
    """Struct of seqname, start_, end_ read from the beginning of ``text``; null where it is no region.

    Separators within the numbers are dropped; ``strip_prefix`` drops a leading ``chr``.
    """
    part = {c: F.regexp_extract(text, pattern, 1) for c, pattern in _PARTS.items()}
    sequence = F.regexp_replace(part["seqname"], "^chr", "") if strip_prefix else part["seqname"]
    number = {c: F.translate(part[c], ",_", "").try_cast("bigint").alias(c) for c in ("start_", "end_")}
    return F.when(text.rlike(_PARTS["seqname"]), F.struct(sequence.alias("seqname"), number["start_"], number["end_"]))


def read_region(text: str) -> tuple[str, int, int]:
    """One region given as a setting: its name up to the first colon, and two whole numbers."""
    name, colon, rest = text.partition(":")
    low, hyphen, tail = rest.partition("-")
    high = re.match(_DIGITS, tail)
    if not (name and colon and hyphen and high and re.fullmatch(_DIGITS, low)):
        raise NotARegion(text)
    bounds = [x.translate({ord(","): None, ord("_"): None}) for x in (low, high[0])]
    if not all(bounds):
        raise NotARegion(text)
    return name, int(bounds[0]), int(bounds[1])


def with_chr(seqname: Column) -> Column:
    """Sequence name with the prefix ``chr``."""
    return F.when(seqname.startswith("chr"), seqname).otherwise(F.concat(F.lit("chr"), seqname))
