"""Path parsing as Column expressions.

The user of an image is the name of the folder that directly contains it,
with its last ``.suffix`` removed (``john.doe`` -> ``john``; ``.hid``, ``a.``
keep their names; ``a.b.c`` -> ``a.b``); files directly in the input root
belong to ``'undefined'``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from imprint.functions.bits import _c

UNDEFINED_USER = "undefined"
STEM_PATTERN = r"^(.+)\.[^.]+$"


def stem(name) -> Column:
    """Name without its last suffix, with the leading-dot and trailing-dot rules of path stems."""
    return F.regexp_replace(_c(name), STEM_PATTERN, "$1")


def _user_of_relative(rel: Column) -> Column:
    parts = F.split(rel, "/")
    return F.when(F.size(parts) <= 1, F.lit(UNDEFINED_USER)).otherwise(stem(F.element_at(parts, -2)))


def relative_path(path, root: str) -> Column:
    """Path relative to ``root``; both may carry a ``file:`` scheme, repeated slashes are collapsed."""
    p = F.regexp_replace(F.regexp_replace(_c(path), r"^file:(//)?", ""), "/+", "/")
    r = root.replace("file://", "").replace("file:", "").rstrip("/") + "/"
    while "//" in r:
        r = r.replace("//", "/")
    return F.when(p.startswith(r), F.substr(p, F.lit(len(r) + 1))).otherwise(
        F.raise_error(F.concat(F.lit("path outside the input root: "), p)))


def decode_origin(origin) -> Column:
    """``image.origin`` is percent-encoded; ``binaryFile.path`` is not.  Keep '+' literal."""
    return F.url_decode(F.regexp_replace(_c(origin), r"\+", "%2B"))


def user_from_path(path, root: str) -> Column:
    """P1 for file paths under ``root``."""
    return _user_of_relative(relative_path(path, root))


def user_from_url(url) -> Column:
    """P1 with a URL treated as a path below ``scheme://``: query and fragment dropped,
    trailing and repeated slashes removed, then the folder rule."""
    p = F.regexp_replace(_c(url), r"[?#].*$", "")
    p = F.regexp_replace(p, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    p = F.regexp_replace(p, "/+", "/")
    p = F.regexp_replace(p, "/$", "")
    return _user_of_relative(p)


def content_path(root: str, digest) -> Column:
    """``<root>/<digest>.png`` for a content-addressed variant."""
    return F.concat(F.lit(root.rstrip("/") + "/"), _c(digest), F.lit(".png"))
