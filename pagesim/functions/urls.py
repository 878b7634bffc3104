"""Column functions on URLs."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Endings of paths that no page has.
SKIPPED_ENDINGS = "jpg jpeg png gif svg webp pdf zip tar gz css js json xml mp4 mp3 avi mov doc docx xls xlsx ppt pptx".split()
#: Patterns of URLs that an audit may leave out.
EXCLUDED = ["/tag/", "/category/", "/author/", r"\?page=", "#"]
_SKIPPED = rf"\.({'|'.join(SKIPPED_ENDINGS)})$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def netloc(url: Column) -> Column:
    """Host with port and user, as written."""
    return F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the netloc, without the fragment."""
    return F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"\?(.*)$", 1)


def full_path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^([^?]*)", 1)


def path(url: Column) -> Column:
    """Path without the ;parameters of its last segment."""
    return F.regexp_replace(full_path(url), r";[^/]*$", "")


def normalized(url: Column) -> Column:
    """Without fragment, parameters and one trailing slash of the whole (unless the path is just /)."""
    base = F.concat(scheme(url), F.lit("://"), netloc(url), path(url), F.when(query(url) != "", F.concat(F.lit("?"), query(url))).otherwise(""))
    return F.when(base.endswith("/") & (path(url) != "/"), F.substring(base, F.lit(1), F.length(base) - 1)).otherwise(base)


def problem(url: Column) -> Column:
    """Why a URL is not acceptable, null if it is."""
    host = F.regexp_replace(F.regexp_replace(netloc(url), "^.*@", ""), r":[^:\]]*$", "")
    port = F.regexp_extract(netloc(url), r":([^:\]@]*)$", 1)
    return (
        F.when(F.coalesce(url, F.lit("")) == "", "URL must be a non-empty string")
        .when(~scheme(url).isin("http", "https"), "only http:// and https:// URLs are supported")
        .when(host == "", "URL must include a hostname")
        .when(F.contains(netloc(url), F.lit("@")), "credentials in URLs are not allowed")
        .when((port != "") & (~port.rlike("^[0-9]{1,6}$")), F.concat(F.lit("invalid URL port: "), port))
        .when(port.rlike("^[0-9]{1,6}$") & (F.coalesce(port.try_cast("int"), F.lit(0)) > 65535), F.concat(F.lit("invalid URL port: "), port))
    )


def crawlable_ending(url: Column) -> Column:
    return ~F.lower(path(url)).rlike(_SKIPPED)


def same_site(a: Column, b: Column) -> Column:
    """The same netloc, port and case included."""
    return netloc(a) == netloc(b)


def excluded(url: Column) -> Column:
    return url.rlike("|".join(EXCLUDED))


def first_segment(url: Column) -> Column:
    """First segment of a path with two slashes or more, else root."""
    p = path(url)
    return F.when(F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit(""))) > 1, F.get(F.split(p, "/"), F.lit(1))).otherwise("root")


@F.arrow_udf(T.StringType())
def _joined(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for base, href in batches:
        yield pa.array((urljoin(b, h) if b is not None and h is not None else None for b, h in zip(base.to_pylist(), href.to_pylist())), pa.string())


def join_any(base: Column, href: Column) -> Column:
    """The standard resolution of any reference, dot segments included."""
    return _joined(base, href)


def join(base: Column, href: Column) -> Column:
    """Resolution of absolute, //host, /path, ?query, #fragment and plain relative references, without Python.

    For references with dot segments use join_any.
    """
    root = F.concat(F.regexp_extract(base, r"^([^:/?#]+:)//", 1), F.lit("//"), netloc(base))
    directory = F.regexp_replace(full_path(base), "[^/]*$", "")
    whole = F.regexp_replace(base, "#.*$", "")
    return (
        F.when(href == "", base)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([^:/?#]+:)", 1), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?"), F.concat(root, full_path(base), href))
        .when(href.startswith("#"), F.concat(whole, href))
        .otherwise(F.concat(root, F.when(directory == "", "/").otherwise(directory), href))
    )
