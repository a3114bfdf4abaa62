"""Scalar functions on text: cleaning, names, hashes, numbers, clocks, versions. All are native Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the punctuation that is blanked before tokenizing
NOISY_CHARS = ',/"-;.&?!()'
# fixed values: suffixes of thousands
SUFFIXES = ["", "k", "M", "G", "T", "E"]


#: The public version scheme of Python packages: release (1), pre-release and its number (2, 3), post-release and its number
#: (4, with 5 or 6), development release (7).
VERSION = (
    r"^v?(?:\d+!)?(\d+(?:\.\d+)*)(?:[-_.]?(alpha|beta|preview|pre|rc|a|b|c)[-_.]?(\d*))?"
    r"(-(\d+)|[-_.]?(?:post|rev|r)[-_.]?(\d*))?([-_.]?dev[-_.]?\d*)?(?:\+[a-z0-9]+(?:[-_.][a-z0-9]+)*)?$"
)


def zero_padded(x: Column, width: int) -> Column:
    """A number as text of at least ``width`` digits; a longer one is left as it is."""
    s = x.cast("string")
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)


def delete_noisy_chars(s: Column, chars: str = NOISY_CHARS) -> Column:
    """each noisy character becomes a space; ends are trimmed."""
    return F.trim(F.translate(s, chars, " " * len(chars)))


def split_tokens(s: Column) -> Column:
    """cleaned, lower case, split on (Unicode) white space; no empty tokens."""
    return F.filter(F.split(F.lower(delete_noisy_chars(s)), r"(?U)\s+"), lambda t: t != "")


SAMPLE_NAME = r"^((?:.*/)?[^./]*)(\.[^/]*)$"


def split_name(name: Column) -> Column:
    """struct(base, ext): ext is everything from the first dot of the last path part, dot included."""
    return F.struct(
        F.nullif(F.regexp_extract(name, SAMPLE_NAME, 1), F.lit("")).alias("base"),
        F.nullif(F.regexp_extract(name, SAMPLE_NAME, 2), F.lit("")).alias("ext"),
    )


def shorten_name(s: Column) -> Column:
    """word runs in first-seen order without repeats, numbers and blanks, joined by '-'."""
    parts = F.filter(F.split(s, r"\W+"), lambda x: (x != "") & ~x.rlike("^[0-9]+$"))
    return F.array_join(F.array_distinct(parts), "-")


def one_decimal(x: Column) -> Column:
    """A double's exact value to one decimal, a half to the even digit, as C and Python print it.

    Java's formats round the shortest text of the number half up. Ten times a fraction is kept as a sum and its rounding
    error, so no half is made or lost.
    """

    def tenths(part: Column) -> Column:
        a, b = part * 8, part * 2
        ten = a + b
        error = b - (ten - a)
        low = F.floor(ten)
        over = ten - low - 0.5
        up = (over > 0) | ((over == 0) & ((error > 0) | ((error == 0) & (low % 2 == 1))))
        return low + up.cast("long")

    def made(v: Column) -> Column:
        whole = F.floor(F.abs(v))
        digit = bound(F.abs(v) - whole, tenths)
        sign = F.when(F.signum(v).cast("string").startswith("-"), "-").otherwise("")
        return bound(digit, lambda d: F.concat(sign, (whole + (d == 10).cast("long")).cast("string"), F.lit("."), (d % 10).cast("string")))

    # what is no number, or none of 64 bits, is left to the format
    return bound(x, lambda v: F.when(F.abs(v) >= 2.0**63, F.format_string("%.1f", v)).otherwise(made(v)))


def bound(x: Column, fn) -> Column:
    """``fn`` of a value that is computed once, however often ``fn`` names it."""
    return F.get(F.transform(F.array(x), fn), F.lit(0))


def format_with_suffix(num: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """one decimal and a suffix per factor 1000 (k, M, G, T, E); the last one takes all larger numbers."""
    last = len(suffixes) - 1
    x, suffix = num / F.lit(1000.0**last), F.lit(suffixes[last])
    for p in range(last - 1, -1, -1):
        below = F.abs(num) < 1000.0 ** (p + 1)
        x, suffix = F.when(below, num / F.lit(1000.0**p)).otherwise(x), F.when(below, F.lit(suffixes[p])).otherwise(suffix)
    return F.concat(one_decimal(x), suffix)


def expand_braces(pattern: str) -> list[str]:
    """names of a pattern with ``{a..b}`` number ranges (zero padding kept) and ``{x,y}`` choices; driver side."""
    start = pattern.find("{")
    if start < 0:
        return [pattern]
    end = pattern.index("}", start)
    inner, head, tail = pattern[start + 1 : end], pattern[:start], expand_braces(pattern[end + 1 :])
    if ".." in inner:
        lo, hi = inner.split("..")
        width = len(lo) if lo.startswith("0") and len(lo) > 1 else 0
        options = [str(k).zfill(width) for k in range(int(lo), int(hi) + 1)]
    else:
        options = inner.split(",")
    return [head + o + t for o in options for t in tail]


def str_hash(s: Column, length: int = 16) -> Column:
    """the first hex digits of SHA-256."""
    return F.substring(F.sha2(s, 256), 1, length)


def file_hash(content: Column, head: int = 40960) -> Column:
    """MD5 of a file's first bytes."""
    return F.md5(F.substring(content, 1, head))


def content_md5(content: Column) -> Column:
    """F16: MD5 of a whole file's content."""
    return F.md5(content)


def dataset_hash(name: Column, length: int = 16) -> Column:
    """characters of the URL-safe base64 of SHA-256."""
    return F.substring(F.translate(F.base64(F.unhex(F.sha2(name, 256))), "+/", "-_"), 1, length)


def clock_to_seconds(s: Column) -> Column:
    """``S``, ``M:S`` or ``H:M:S`` (fraction allowed, hours below 24) to seconds; anything else is null."""
    ok = s.rlike(r"^(?:(?:(?:[01]?\d|2[0-3]):)?[0-5]?\d:)?\d+(?:\.\d+)?$")
    total = F.aggregate(F.split(s, ":"), F.lit(0.0), lambda acc, x: acc * 60.0 + F.coalesce(x.try_cast("double"), F.lit(0.0)))
    return F.when(ok, total)


def time_range(s: Column) -> Column:
    """``st-ed`` to struct(st, ed) seconds; ``inf`` is open-ended."""

    def side(k: int) -> Column:
        x = F.get(F.split(s, "-"), F.lit(k))
        return F.when(F.lower(x) == "inf", F.lit(float("inf"))).otherwise(clock_to_seconds(x))

    return F.struct(side(0).alias("st"), side(1).alias("ed"))


def digit_version(v: Column, length: int = 4) -> Column:
    """a version as a comparable array of integers: ``length`` release numbers, then stage and its number.

    Stages order dev < a < b < rc < none < post; a local part (``+cu118``) does not count. Text that is no version is null.
    """
    parts = F.lower(F.trim(v))

    def part(k: int) -> Column:
        return F.regexp_extract(parts, VERSION, k)

    def number(k: int) -> Column:
        return F.coalesce(F.nullif(part(k), F.lit("")).cast("int"), F.lit(0))

    pre, post, dev = part(2), part(4) != "", part(7) != ""
    release = F.transform(F.split(part(1), r"\."), lambda x: x.cast("int"))
    padded = F.slice(F.concat(release, F.array_repeat(F.lit(0), length)), 1, length)
    stage = F.when(pre.isin("a", "alpha"), -3).when(pre.isin("b", "beta"), -2).when(pre != "", -1).when(dev, -4).when(post, 1).otherwise(0)
    count = F.when(pre != "", number(3)).when(dev, 0).when(post, F.greatest(number(5), number(6))).otherwise(0)
    return F.when(parts.rlike(VERSION), F.concat(padded, F.array(stage, count)))


def map_to_text(m: Column, delim: str = ", ", sep: str = "=", fmt: str | None = None, plain: tuple[str, ...] = ()) -> Column:
    """``key<sep>value`` pairs in key order; ``fmt`` formats values but those of ``plain`` keys."""

    def value(e: Column) -> Column:
        if fmt is None:
            return e["value"].cast("string")
        made = F.format_string(fmt, e["value"])
        return F.when(e["key"].isin(*plain), e["value"].cast("string")).otherwise(made) if plain else made

    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit(sep), value(e))), delim)


def cell(values: Column, width: int = 5, sep: str = "|") -> Column:
    """numbers zero-padded to ``width`` and joined by ``sep``."""
    return F.array_join(F.transform(values, lambda x: zero_padded(x, width)), sep)


def fill(template: str, *columns: Column) -> Column:
    """a name or URL from a printf template."""
    return F.format_string(template, *columns)


def shifted_time(ts: Column, zone: str = "+08:00", fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """a UTC time as text of another zone."""
    return F.date_format(F.from_utc_timestamp(ts, zone), fmt)


def default(value: Column, otherwise: Column) -> Column:
    """a value where the first is null."""
    return F.coalesce(value, otherwise)
