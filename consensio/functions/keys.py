"""Normalisation of string keys."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind, with the zero-width characters that look like none.
_EDGE = r"^[\s\p{Z}\x{200B}\x{2060}\x{FEFF}]+|[\s\p{Z}\x{200B}\x{2060}\x{FEFF}]+$"


def norm_key(c: Column | str) -> Column:
    """The key without case and outer white space; NULL where it is null or blank."""
    c = F.col(c) if isinstance(c, str) else c
    k = F.lower(F.regexp_replace(c, _EDGE, ""))
    return F.when(k != "", k)


def sql_norm_key(c: str) -> str:
    """The same as text for DuckDB."""
    return rf"nullif(lower(regexp_replace({c}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), '')"


def norm_endpoint(c: Column | str) -> Column:
    """An endpoint with scheme and host in lower case and no trailing slashes; '' for the default one."""
    c = F.col(c) if isinstance(c, str) else c
    c = F.rtrim(F.coalesce(F.regexp_replace(c, _EDGE, ""), F.lit("")), F.lit("/"))
    head = F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", 0)
    return F.concat(F.lower(head), F.substr(c, F.length(head) + 1))
