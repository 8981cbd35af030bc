"""Text expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import HASH_BUCKETS_IP, HASH_BUCKETS_SIGNATURE


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def contains_any(text: Column, words) -> Column:
    """True when any word occurs in ``text``; false for NULL text or no words.

    A word that contains another one of the list needs no test of its own.
    """
    tests = [text.contains(w) for w in words if not any(o != w and o in w for o in words)]
    return F.coalesce(reduce(or_, tests), F.lit(False)) if tests else F.lit(False)


def starts_with_any(text: Column, prefixes) -> Column:
    return F.coalesce(reduce(or_, [text.startswith(p) for p in prefixes]), F.lit(False))


def hash32(c) -> Column:
    """First 32 bits of the SHA-256 digest of the UTF-8 text, as a BIGINT."""
    return F.conv(F.substring(F.sha2(_c(c), 256), 1, 8), 16, 10).cast("bigint")


def signature_length(c) -> Column:
    return F.length(F.trim(F.coalesce(_c(c), F.lit(""))))


def signature_hash(c) -> Column:
    s = F.trim(F.coalesce(_c(c), F.lit("")))
    return F.when(s == "", F.lit(0).cast("bigint")).otherwise(hash32(s) % HASH_BUCKETS_SIGNATURE)


def ip_hash(c) -> Column:
    return hash32(F.coalesce(_c(c), F.lit(""))) % HASH_BUCKETS_IP


def clean_text(c) -> Column:
    """Line breaks become blanks; NULL becomes ''."""
    return F.translate(F.coalesce(_c(c), F.lit("")), "\r\n", "  ")


def join_list(c) -> Column:
    """List as ``;``-joined text in sorted order; NULL becomes ''."""
    return F.coalesce(F.array_join(F.array_sort(_c(c)), ";"), F.lit(""))


def first_truthy(*cols, empty) -> Column:
    """First value that is neither NULL nor ``empty``; NULL when there is none."""
    return F.coalesce(*[F.nullif(_c(c), F.lit(empty)) for c in cols])


def first_present(*cols) -> Column:
    """First value that is not NULL ('' and 0 count as values)."""
    return F.coalesce(*[_c(c) for c in cols])
