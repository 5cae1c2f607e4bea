"""Host and site of a URL, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOST_PATTERN = r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#\s]+)"


def site_of(url: Column) -> Column:
    """Lower-case host of a URL without a leading `www.`; null for null, blank or host-less values."""
    host = F.lower(F.regexp_extract(url, HOST_PATTERN, 1))
    bare = F.regexp_replace(F.regexp_replace(host, r"\.$", ""), r"^www\.", "")
    return F.when(bare != "", bare)
