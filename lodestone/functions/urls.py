"""Web addresses as Column expressions; what is no valid address gives null."""
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Syntax of addresses, hosts and ids.
HOST = r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)*[A-Za-z](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.?|\d{1,3}(?:\.\d{1,3}){3}|\[[0-9A-Fa-f:.]+\]"
ADDRESS = rf"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@\[\]]*@)?({HOST})(?::(\d*))?((?:/[^?#]*)?)(\?[^#]*)?(?:#[^#]*)?$"
ILLEGAL = r"[\x00-\x20\x7f<>\"{}|\\^`]|%(?![0-9A-Fa-f]{2})"
URL_START = r"^[A-Za-z][A-Za-z0-9+.-]*://"
SITE_ID, POST_ID = r"^[a-z0-9-]{1,40}$", r"(?s)^([^:]*):(.*)$"


def _part(c: Column, k: int) -> Column:
    return F.regexp_extract(c, ADDRESS, k)


def valid(c: Column) -> Column:
    return c.isNotNull() & ~c.rlike(ILLEGAL) & c.rlike(ADDRESS)


def scheme(c: Column) -> Column:
    return F.when(valid(c), F.lower(_part(c, 1)))


def host(c: Column) -> Column:
    return F.when(valid(c), F.lower(_part(c, 2)))


def _form(c: Column, port: Column) -> Column:
    at = F.when((port == "") | (port == "443"), "").otherwise(F.concat(F.lit(":"), port))
    return F.concat(F.lit("https://"), host(c), at, F.regexp_replace(_part(c, 4), "/$", ""), _part(c, 5))


def normalised(c: Column) -> Column:
    """Comparable form of an https address: lower-case host, no port 443, fragment, user or one trailing slash."""
    return F.when(scheme(c) == "https", _form(c, _part(c, 3)))


def look_up(c: Column) -> Column:
    """Comparable form of an http or https address; http stands for https, without its port 80."""
    port = F.when((scheme(c) == "http") & (_part(c, 3) == "80"), "").otherwise(_part(c, 3))
    return F.when(scheme(c).isin("http", "https"), _form(c, port))


def on_site(link: Column, site_host: Column) -> Column:
    return F.coalesce((scheme(link) == "https") & (host(link) == F.lower(site_host)), F.lit(False))


def reference_kind(c: Column) -> Column:
    """URL, ID, or what is wrong with a post reference."""
    t = F.regexp_replace(c, r"^\s+|\s+$", "")
    sound = F.regexp_extract(t, POST_ID, 1).rlike(SITE_ID) & ~F.regexp_extract(t, POST_ID, 2).rlike(r"^\s*$")
    url = F.when(look_up(t).isNotNull(), "URL").otherwise("INVALID_URL")
    return F.when(F.coalesce(t, F.lit("")) == "", "BLANK").when(t.rlike(URL_START), url).when(sound, "ID").otherwise("INVALID_ID")


def resolve(base: str | None, link: str | None) -> str | None:
    """A link as seen from the base address; null where it cannot be read."""
    try:
        return None if link is None or any(x in link for x in " <>\"{}|\\^`") else urljoin(base or "", link)
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def resolved(base: pd.Series, link: pd.Series) -> pd.Series:
    return pd.Series([resolve(b, x) for b, x in zip(base, link, strict=True)], dtype=object)
