"""URL and path functions as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ROOT = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)"


def url_root(url: Column) -> Column:
    """Scheme and host, empty for a plain path."""
    return F.regexp_extract(url, _ROOT, 1)


def url_path(url: Column) -> Column:
    """The path of a URL, or a plain path without query and fragment."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^?#]*)", 1)


def url_tail(url: Column) -> Column:
    """Query and fragment with their marks."""
    return F.regexp_extract(url, r"^[^?#]*(.*)$", 1)


def dirname(path: Column) -> Column:
    """The part before the last slash; the root stays a slash."""
    return F.regexp_replace(F.regexp_extract(path, r"^(.*/)?[^/]*$", 1), r"(?<=[^/])/+$", "")


def url_dir(url: Column) -> Column:
    """the URL with its path cut to the directory."""
    return F.concat(url_root(url), dirname(url_path(url)), url_tail(url))


def url_file(url: Column) -> Column:
    """the file name of a URL's path."""
    return F.regexp_extract(url_path(url), r"([^/]*)$", 1)


def url_dir_base(url: Column) -> Column:
    """the URL's directory without query and fragment; ``file`` is the scheme of plain (absolute) paths."""
    root = F.coalesce(F.nullif(url_root(url), F.lit("")), F.lit("file://"))
    return F.concat(root, dirname(url_path(url)))


def normal_path(path: Column) -> Column:
    """``.`` and ``..`` parts resolved, double slashes folded; never above the root."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(
            F.concat(acc, F.array(x))
        ),
    )
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))


def url_merge(base: Column, url: Column) -> Column:
    """``url`` with scheme and host of ``base`` where it has none; a relative path goes below the base's path and
    is normalised, an absolute one stands; query and fragment come from ``url`` alone."""
    root = F.coalesce(F.nullif(url_root(url), F.lit("")), url_root(base))
    own = url_path(url)
    below = normal_path(F.concat(F.regexp_replace(url_path(base), "/$", ""), F.lit("/"), own))
    return F.concat(root, F.when(own.startswith("/"), own).otherwise(below), url_tail(url))


def repo_parts(url: Column) -> Column:
    """struct(owner, name): the last two parts of a repository URL."""
    parts = F.filter(F.split(url, "/"), lambda x: x != "")
    return F.struct(F.try_element_at(parts, F.lit(-2)).alias("owner"), F.try_element_at(parts, F.lit(-1)).alias("name"))


def query_id(s: Column, key: str = "v") -> Column:
    """the value of the last ``key=`` of a web address, otherwise the text itself."""
    return F.when(s.startswith("http"), F.regexp_extract(s, rf"^.*{key}=([^&]+)", 1)).otherwise(s)


def output_path(url: Column, output: Column) -> Column:
    """a null output means the URL's last part; one that ends in '/' is a folder; anything else stands."""
    name = F.regexp_extract(url, r"([^/]*)$", 1)
    return F.when(output.isNull(), name).when(output.endswith("/"), F.concat(output, name)).otherwise(output)


def local_name(url: Column) -> Column:
    """A cache file name: ``data__<hash of the directory URL>__<file name>``."""
    d = F.substring(F.translate(F.base64(F.unhex(F.sha2(url_dir(url), 256))), "+/", "-_"), 1, 16)
    return F.concat(F.lit("data__"), d, F.lit("__"), url_file(url))


def quoted_name(url: Column) -> Column:
    """A cache file name that is the URL, percent-encoded (letters, digits and ``_.-~+`` stay)."""
    return F.replace(F.replace(F.replace(F.url_encode(url), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
