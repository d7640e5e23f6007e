"""URL parts and the canonical form used for document identity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_AUTHORITY = r"^(?:[^:/?#]+:)?//([^/?#]*)"


def _squeezed(c: Column) -> Column:
    return F.regexp_replace(c, r"[\t\r\n]|^[\x00-\x20]+", "")


def scheme(c: Column) -> Column:
    return F.lower(F.regexp_extract(_squeezed(c), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def authority(c: Column) -> Column:
    return F.regexp_extract(_squeezed(c), _AUTHORITY, 1)


def _host_port(c: Column) -> Column:
    return F.substring_index(authority(c), "@", -1)


def host(c: Column) -> Column:
    """Lower-cased host without user info, port or IPv6 brackets."""
    return F.lower(F.translate(F.regexp_extract(_host_port(c), r"^(\[[^\]]*\]|[^:]*)", 1), "[]", ""))


def port(c: Column) -> Column:
    return F.regexp_extract(_host_port(c), r":(\d+)$", 1).try_cast("int")


def _raw_path(c: Column) -> Column:
    return F.regexp_extract(_squeezed(c), r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)", 1)


def path(c: Column) -> Column:
    """Path without parameters; ``/`` when empty."""
    bare = F.regexp_replace(_raw_path(c), r";[^/]*$", "")
    return F.when(bare == "", "/").otherwise(bare)


def query_string(c: Column) -> Column:
    return F.regexp_extract(_squeezed(c), r"^[^?#]*\?([^#]*)", 1)


def registrable_domain(host_col: Column) -> Column:
    """Last two labels of a host."""
    return F.substring_index(F.lower(host_col), ".", -2)


def canonical_url(c: Column) -> Column:
    """Lower-case scheme and host, no default port, fragment or user info, no trailing slash below the root."""
    default_port = ((scheme(c) == "http") & (port(c) == 80)) | ((scheme(c) == "https") & (port(c) == 443))
    shown_port = F.when(
        port(c).isNull() | (port(c) == 0) | F.coalesce(default_port, F.lit(False)), ""
    ).otherwise(F.concat(F.lit(":"), port(c).cast("string")))
    trimmed = F.when(path(c) == "/", "/").otherwise(F.regexp_replace(path(c), "/+$", ""))
    params = F.regexp_extract(_raw_path(c), r"(;[^/]+)$", 1)
    query = F.when(query_string(c) == "", "").otherwise(F.concat(F.lit("?"), query_string(c)))
    front = F.when(scheme(c) == "", "").otherwise(F.concat(scheme(c), F.lit(":")))
    site = F.when(authority(c) == "", "").otherwise(F.concat(F.lit("//"), host(c), shown_port))
    return F.concat(front, site, trimmed, params, query)
