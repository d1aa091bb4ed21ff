"""Scalar text functions as Column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"([\p{L}\p{N}\p{Co}]+)"
SPACE = r"[\s\p{Z}\x{85}]"


@lru_cache
def accent_maps() -> tuple[str, str]:
    """Precomposed letters and the letters they carry marks on, of the Latin, Greek and Cyrillic blocks; marks go."""
    source, target = [], []
    for code in [*range(0x00C0, 0x0530), *range(0x1E00, 0x2000)]:
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if len(plain) == 1 and plain != c and plain.lower() == plain and unicodedata.category(c)[0] == "L":
            source.append(c)
            target.append(plain)
    return "".join(source), "".join(target)


def fold(text: Column) -> Column:
    """Lower case without accents: translate() takes the letters, the marks that stand alone are removed; ASCII has neither."""
    source, target = accent_maps()
    low = F.lower(text)
    return F.when(low.rlike(r"[^\x00-\x7f]"), F.regexp_replace(F.translate(low, source, target), r"\p{Mn}", "")).otherwise(low)


def tokens(text: Column) -> Column:
    """Maximal runs of letters and digits, folded; none for null."""
    return folded_tokens(fold(F.coalesce(text, F.lit(""))))


def folded_tokens(folded: Column) -> Column:
    return F.regexp_extract_all(folded, F.lit(TOKEN), 1)


def slugify(collection: Column, path: Column) -> Column:
    joined = F.concat(collection, F.lit("--"), path)
    for mark, to in (("/", "--"), (".", "-"), (" ", "-")):
        joined = F.replace(joined, F.lit(mark), F.lit(to))
    return F.lower(joined)


def chunk_slug(slug: Column, index: Column) -> Column:
    return F.concat_ws("--", slug, index.cast("string"))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def snippet(text: Column, most: int = 50) -> Column:
    """The text, or its first ``most`` characters and three dots."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit("...")))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """With its dot; empty if the name has none."""
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def trimmed(text: Column) -> Column:
    """Without white space of any script at both ends (trim() only takes blanks)."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def worth_embedding(text: Column) -> Column:
    """Whether at least three bytes are left once white space is gone from the ends."""
    return F.octet_length(trimmed(F.coalesce(text, F.lit("")))) >= 3


def line_range(text: Column, start: int, end: int) -> Column:
    """Lines ``start`` to ``end`` (from 1, inclusive); the end is clamped, an impossible range is an error."""
    lines = F.split(text, "\n")
    fine = (F.lit(start) >= 1) & (F.lit(start) <= F.size(lines)) & (F.lit(end) >= start)
    taken = F.array_join(F.slice(lines, start, max(1, end - start + 1)), "\n")
    return F.when(fine, taken).otherwise(F.raise_error(F.lit(f"no lines {start} to {end}")).cast("string"))


def sigmoid(x: Column, center: float, left: float, right: float) -> Column:
    """A logistic step at ``center`` with another steepness on each side."""
    steep = F.when(x < center, F.lit(left)).otherwise(F.lit(right))
    return 1 / (1 + F.exp(-steep * (x - center)))


def heading_level(line: Column) -> Column:
    """Number of marks of a Markdown heading line; 0 if it is none."""
    return F.length(F.regexp_extract(line, r"^[ \t]*(#+|▼+)[ \t]", 1))


def heading_title(line: Column) -> Column:
    """The heading with its marks, without white space around it."""
    return trimmed(line)


def fence(line: Column) -> Column:
    """Whether a line opens or closes a fenced block."""
    return line.rlike(r"^\s*(?:```|~~~)")


def metadata(path: Column) -> Column:
    return F.to_json(F.struct(path.alias("path")))
