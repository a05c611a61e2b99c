"""Labels in one spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Full-width ASCII and the blanks that a label may hold, by rule.
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　     "
PLAIN = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " " * 6
PLACEHOLDERS = ("und", "none", "null", "unknown", "unk", "na", "n/a", "xx", "zxx", "mis", "?")


def label(c: Column) -> Column:
    """A label without width, case, kind of separator and outer blanks: ' Multi-Hop' gives 'multi_hop'; blank and NULL give NULL."""
    plain = F.regexp_replace(F.lower(F.trim(F.translate(c, WIDE, PLAIN))), r"[\s_\-]+", "_")
    return F.nullif(plain, F.lit(""))


def language_label(c: Column) -> Column:
    """The code that a language label names, without region tag; placeholders give NULL."""
    code = F.split(label(c), "_")[0]
    return F.when(~code.isin(*PLACEHOLDERS), code)


def answerability_label(c: Column) -> Column:
    return F.upper(F.regexp_replace(label(c), "^class_", ""))


def split_label(c: Column) -> Column:
    """train, dev or test; anything else gives NULL."""
    s = label(c)
    return F.when(s.isin("train", "training"), "train").when(s.isin("dev", "valid", "validation", "val"), "dev").when(s.isin("test", "testing"), "test")


def group_id(parallel_id: Column, qid: Column) -> Column:
    """parallel_id as 'ins-000042' whatever its spelling; where it is missing, the one in the qid ('en-ins-000042-v2')."""
    pattern = r"^([a-z]+)_?([0-9]+)$"
    own, named = label(parallel_id), F.regexp_extract(F.lower(F.trim(qid)), r"^[a-z]+-([a-z]+-[0-9]+)", 1)
    digits = F.regexp_extract(own, pattern, 2)
    tidy = F.when(own.rlike(pattern), F.concat_ws("-", F.regexp_extract(own, pattern, 1), F.when(F.length(digits) < 6, F.lpad(digits, 6, "0")).otherwise(digits)))
    return F.coalesce(tidy, F.regexp_replace(own, "_", "-"), F.nullif(named, F.lit("")))
