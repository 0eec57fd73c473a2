"""Clean identifiers: DOI and preprint numbers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_doi(doi: Column) -> Column:
    """The DOI proper, in lower case: URL prefixes, escapes, ``?query`` and closing full stops removed.

    Null for null and for whatever is no DOI (``n/a``, ``-``, ``pending``, the empty string and so on).
    """
    s = F.lower(F.trim(doi))
    s = F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s)
    s = F.regexp_extract(s, r"(10\.\d{4,9}/[^\s?#]+)", 1)
    s = F.regexp_replace(s, r"[.,;]+$", "")
    return F.nullif(s, F.lit(""))


def clean_arxiv(arxiv_id: Column) -> Column:
    """The preprint number without prefix, version and category; null for null and stand-ins.

    All digits behind the dot count: a month of 100,000 preprints and more has numbers of six.
    """
    s = F.regexp_extract(F.lower(arxiv_id), r"(\d{4}\.\d{4,}|[a-z\-]{2,10}(?:\.[a-z]{2})?/\d{7})", 1)
    return F.nullif(s, F.lit(""))
