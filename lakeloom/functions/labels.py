"""Ids, labels, paths and other scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strftime codes and their Java patterns.
STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%B": "MMMM", "%b": "MMM", "%j": "DDD", "%p": "a", "%I": "hh"}


def make_label(name: Column) -> Column:
    """Words of a name: no .csv, other signs than letters and digits as blanks, camel case split, lower case."""
    words = F.regexp_replace(F.regexp_replace(name, ".csv", ""), "[^0-9a-zA-Z]+", " ")
    return F.lower(F.trim(F.regexp_replace(words, "((?<=[a-z])[A-Z]|(?<!\\A)[A-Z](?=[a-z]))", " $1")))


def quote(c: Column) -> Column:
    """Form encoding that leaves letters, digits and -_.~ alone."""
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def path_id(*parts: Column) -> Column:
    """Encoded parts of an id, joined by slashes."""
    return F.concat_ws("/", *[quote(p) for p in parts])


def component_id(*parts: Column) -> Column:
    return F.crc32(F.concat(*parts))


def strip_prefix(uri: Column, prefix: str) -> Column:
    return F.when(F.startswith(uri, F.lit(prefix)), F.substr(uri, F.lit(len(prefix) + 1))).otherwise(uri)


def library_prefixes(path: Column) -> Column:
    """['a', 'a.b', 'a.b.c'] of 'a.b.c'."""
    parts = F.split(path, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))


def expand_ranges(tokens: Column) -> Column:
    """['s1', 's2', 's3', 's8'] of ['s1-s3', 's8']; a token that isn't a range is kept."""

    def one(t: Column) -> Column:
        a, b = (F.regexp_extract(t, r"^s(\d+)-s(\d+)$", i) for i in (1, 2))
        return F.when(a != "", F.transform(F.sequence(a.cast("int"), F.when(a != "", b).cast("int")), lambda n: F.concat(F.lit("s"), n.cast("string")))).otherwise(F.array(t))

    return F.flatten(F.transform(tokens, one))


def one_of(c: Column, allowed: list[str], other: str = "other") -> Column:
    """The lower-cased value if it is allowed, else `other`; null too."""
    return F.when(F.lower(c).isin(allowed), F.lower(c)).otherwise(other)


def library_of(call: Column) -> Column:
    """The first part of a dotted call; null for none and for built-ins."""
    first = F.split_part(call, F.lit("."), F.lit(1))
    return F.when((first != "") & (first != "builtin"), first)


def module_of(call: Column) -> Column:
    """The part after the library; null where there is none."""
    return F.nullif(F.split_part(call, F.lit("."), F.lit(2)), F.lit(""))


def statement_no(uri: Column) -> Column:
    return F.regexp_extract(uri, r"/s(\d+)$", 1).try_cast("int")


def convert(c: Column, to: str) -> Column:
    """int, float, str, bool or datetime; what doesn't parse is null. bool is truthiness: any non-empty text is true,
    also 'False', and null is false for text. str writes null as 'nan'."""
    return {
        "int": c.try_cast("double").try_cast("long"),
        "float": c.try_cast("double"),
        "str": F.coalesce(c.cast("string"), F.lit("nan")),
        "bool": F.coalesce(c.cast("string"), F.lit("")) != "",
        "datetime": F.try_to_timestamp(c.cast("string")),
    }[to]


def format_datetime(c: Column, pattern: str) -> Column:
    """A parsed time in a strftime pattern; null for what doesn't parse."""
    for code, java in STRFTIME.items():
        pattern = pattern.replace(code, java)
    return F.date_format(F.try_to_timestamp(c.cast("string")), pattern)


def html_to_text(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags gone, common entities decoded, white space run together."""
    out = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    # Entities and their characters; the ampersand last.
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " "))


def chunks(text: Column, most: int = 8191, overlap: float = 0.1) -> Column:
    """Pieces of up to `most` characters that overlap by the given share; [] for an empty text."""
    step = most - int(most * overlap)
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(most)))


def sections(text: Column, mark: str = "---") -> Column:
    return F.split(text, mark)
