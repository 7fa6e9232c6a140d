"""Scalar text functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the white space that browsers' \s stands for.
WS = "[\\t-\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
#: An ASCII word boundary; Java's own also counts letters beyond ASCII as word characters.
AB = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.transform(F.array(value), body)[0]


def trim_all(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+\\z", "")


def compact_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, WS + "+", " "))


def slugify(c: Column, fallback: str = "conversation", longest: int = 72) -> Column:
    """Dashes for all but a-z and 0-9; cut last, so a slug may end in a dash."""
    plain = F.regexp_replace(F.lower(c), "https?://", "")
    slug = F.substring(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+\\z", ""), 1, longest)
    return F.when(F.coalesce(slug, F.lit("")) == "", F.lit(fallback)).otherwise(slug)


def escape_html(c: Column, quotes: bool = True, apostrophes: bool = True) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")] + [('"', "&quot;")] * quotes + [("'", "&#039;")] * apostrophes
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def anonymous_url(c: Column) -> Column:
    """Origin and path of http(s) URLs, lower-case host, default port and credentials dropped; empty if invalid."""
    scheme = F.lower(F.try_parse_url(c, F.lit("PROTOCOL")))
    host = F.regexp_replace(F.regexp_replace(F.lower(F.try_parse_url(c, F.lit("AUTHORITY"))), "^[^@]*@", ""), ":(80|443)\\z", "")
    path = F.try_parse_url(c, F.lit("PATH"))
    whole = F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path))
    return F.coalesce(F.when(scheme.isin("http", "https"), whole), F.lit(""))


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a over UTF-16 units, in linear time: characters one by one, 1,024 of them held at once; null for null."""
    parts = F.regexp_extract_all(c, F.lit("(?s).{1,1024}"), F.lit(0))
    codes = lambda part: F.transform(F.split(part, ""), lambda x: F.ascii(x))
    # What is multiplied is below 2**32, so the product stays within a long.
    unit = lambda h, u: (h.bitwiseXOR(u) * 16777619).bitwiseAND(F.lit(4294967295))
    pair = lambda h, u: unit(unit(h, F.shiftright(u, 10) + 0xD7C0), u.bitwiseAND(F.lit(0x3FF)) + 0xDC00)
    step = lambda h, u: F.when(u < 0x10000, unit(h, u)).otherwise(pair(h, u))
    return F.aggregate(parts, F.lit(2166136261).cast("long"), lambda h, part: F.aggregate(codes(part), h, step))


def stable_id(prefix: str | Column, c: Column) -> Column:
    head = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.concat(head, F.lit("-"), F.lower(F.conv(fnv1a(c).cast("string"), 10, 36)))


def prefix_lines(c: Column, prefix: str = ">") -> Column:
    """Quote each line; blank lines get the bare prefix."""
    return F.array_join(F.transform(F.split(c, "\n"), lambda x: F.when(trim_all(x) == "", F.lit(prefix)).otherwise(F.concat(F.lit(prefix + " "), x))), "\n")


def json_string(c: Column) -> Column:
    return F.regexp_extract(F.to_json(F.array(c)), "(?s)^\\[(.*)\\]\\z", 1)


def json_object(fields: dict[str, Column], level: int = 0) -> Column:
    """A JSON object with two spaces of indent a level, from values that are JSON already; null values are left out."""
    pad = "  " * (level + 1)
    lines = F.array_compact(F.array(*(F.concat(F.lit(f'{pad}"{k}": '), v) for k, v in fields.items())))
    return F.when(F.size(lines) == 0, F.lit("{}")).otherwise(F.concat(F.lit("{\n"), F.array_join(lines, ",\n"), F.lit("\n" + "  " * level + "}")))


def json_array(values: Column, level: int = 0) -> Column:
    """A JSON array with a line for each value, which is JSON already."""
    pad = "  " * (level + 1)
    lines = F.array_join(F.transform(values, lambda v: F.concat(F.lit(pad), v)), ",\n")
    return F.when(F.size(values) == 0, F.lit("[]")).when(values.isNotNull(), F.concat(F.lit("[\n"), lines, F.lit("\n" + "  " * level + "]")))


def safe_url(c: Column) -> Column:
    """Whether a link may be shown: http(s), mail, an anchor or a path."""
    return F.coalesce(c.rlike("(?i)^(https?:|mailto:|#|/)"), F.lit(False))


def hostname(c: Column) -> Column:
    """Host of a URL, else the text itself."""
    return F.coalesce(F.lower(F.try_parse_url(c, F.lit("HOST"))), c)


def mime_of_data_url(c: Column) -> Column:
    """MIME type of a base64 data URL, else null."""
    found = F.regexp_extract(c, "^data:([^;]+);base64,", 1)
    return F.when(found != "", found)


def crc32(c: Column) -> Column:
    """IEEE CRC-32 of the UTF-8 bytes of a text or of a binary value."""
    return F.crc32(c.cast("binary"))


def data_url_bytes(c: Column) -> Column:
    return F.unbase64(F.coalesce(F.get(F.split(c, ","), F.lit(1)), F.lit("")))


def image_extension(mime: Column, filename: Column) -> Column:
    known = F.when(mime == "image/jpeg", "jpg").when(mime == "image/png", "png").when(mime == "image/webp", "webp").when(mime == "image/gif", "gif")
    tail = F.lower(F.regexp_extract(F.coalesce(filename, F.lit("")), "\\.([A-Za-z0-9]{2,5})\\z", 1))
    return F.coalesce(known, F.when(tail != "", tail), F.lit("png"))


def filename_of_url(c: Column) -> Column:
    parts = F.filter(F.split(F.try_parse_url(c, F.lit("PATH")), "/"), lambda x: x != "")
    return F.element_at(parts, -1)


def compare_form(c: Column) -> Column:
    """Lower case without button words, for fuzzy comparison."""
    bare = F.regexp_replace(F.lower(c), f"{AB}(copy|copied|retry|edit|share|like|dislike){AB}", " ")
    return compact_whitespace(bare)


def looks_like_full_message(copied: Column, visible: Column) -> Column:
    """Whether copied text plausibly is the whole visible message."""

    def judge(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        words = F.array_distinct(F.filter(F.split(a, " "), lambda w: F.length(w) > 3))
        share = F.size(F.array_intersect(words, F.split(b, " "))) / F.size(words)
        return F.when(F.length(a) < 20, False).when(F.contains(b, F.substring(a, 1, 160)), True).when(F.size(words) < 5, False).otherwise(share > 0.45)

    return bind(F.struct(compare_form(copied).alias("a"), compare_form(visible).alias("b")), judge)
