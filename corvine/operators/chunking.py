"""From documents to chunks: Markdown sections, code pieces, and the fixed splitter for what is too long.

The fixed splitter and the line functions are plain SQL expressions. The Markdown and code chunkers carry state from line
to line and run as Arrow functions; each looks at one document at a time.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvine.functions.text import fence, heading_level, heading_title
from corvine.session import prepare

# Bounds in characters.
LONGEST = 1500
SHORTEST = 200

PIECE = pa.struct([("chunk_index", pa.int32()), ("text_content", pa.string()), ("total_chars", pa.int32()), ("line_start", pa.int32()), ("line_end", pa.int32()), ("section_num", pa.int32()), ("section_title", pa.string())])
PIECE_DDL = "chunk_index int, text_content string, total_chars int, line_start int, line_end int, section_num int, section_title string"

_HEADING = re.compile(r"^[ \t]*(#+|▼+)[ \t]")
_WHITE = "\t\n\v\f\r \x85\xa0                　"
_LAST_STOP = re.compile(r"[.!?](?=[^.!?]*$)", re.S)
_LAST_SPACE = re.compile(f"[{_WHITE}](?=[^{_WHITE}]*$)")


def in_fence(lines: list[str]) -> list[bool]:
    """Whether each line belongs to a fenced block, its fences included; either fence closes either."""
    marks = [line.strip(_WHITE).startswith(("```", "~~~")) for line in lines]
    before = itertools.accumulate(marks, lambda open_, mark: open_ ^ mark, initial=False)
    return [mark or open_ for mark, open_ in zip(marks, before)]


class Section:
    """What has been gathered and not yet given out: lines ``first`` to ``last`` (exclusive), the first from ``offset`` on."""

    def __init__(self, lines: list[str]):
        self.lines = lines
        self.sums = [0, *itertools.accumulate(len(x) + 1 for x in lines)]
        self.fenced = in_fence(lines)
        self.first = self.last = self.offset = 0

    @property
    def size(self) -> int:
        """Characters with a line end after each line."""
        return self.sums[self.last] - self.sums[self.first] - self.offset

    def before(self, line: int) -> int:
        return self.sums[line] - self.sums[self.first] - self.offset

    def cut(self, longest: int = LONGEST, shortest: int = SHORTEST) -> tuple[int, int]:
        """Where to end a piece: the line, and how many of its characters are left for the next piece.

        The last place counts whose head is within the bounds; a blank line outside of fences is better than the end of
        a sentence, that than white space, that than any place. If there is none, the first line ends the piece.
        """
        for i in range(self.last - 1, self.first - 1, -1):
            if shortest <= self.before(i) <= longest and not self.fenced[i] and not self.lines[i].strip(_WHITE):
                return i - 1, 0
        for wanted in (_LAST_STOP, _LAST_SPACE, None):
            for i in range(self.last - 1, self.first - 1, -1):
                line, head = self.lines[i], self.before(i) + 2  # the head's own line end counts
                low, high = max(0, shortest - head), min(len(line), longest - head + 1)
                if low >= high:
                    continue
                if wanted is None:
                    return i, len(line) - high
                if m := wanted.search(line[low:high]):
                    return i, len(line) - (low + m.start()) - 1
        return self.first, 0

    def take(self, line: int, left: int, strict: bool) -> tuple[str, int, int]:
        """Give out the lines up to ``line`` but for ``left`` characters of it: text, first line, last line, both from 1.

        A piece that ends within its own first line holds that line's rest, unless ``strict``.
        """
        span = self.lines[self.first : line + 1]
        if span:
            if left and (strict or line > self.first):
                span[-1] = span[-1][: len(span[-1]) - left]
            span[0] = span[0][self.offset :]
        out = "\n".join(span), self.first + 1, line + 1
        self.first, self.offset = (line + 1, 0) if left == 0 else (line, len(self.lines[line]) - left)
        return out


def markdown_pieces(text: str, strict: bool = False, longest: int = LONGEST, shortest: int = SHORTEST) -> list[tuple]:
    """The pieces of a Markdown text as (index, text, characters, first line, last line, section, title).

    A heading ends a piece of at least ``shortest`` characters; a longer one than ``longest`` is cut. A piece has the number
    and title of the last heading gathered before it was given out. An empty text is one empty piece.
    """
    buffer = Section(text.split("\n"))
    out: list[tuple] = []
    number, title, seen = 0, "", 0

    def give(line: int, left: int) -> None:
        piece, start, end = buffer.take(line, left, strict)
        out.append((len(out), piece, len(piece), start, end, number, title))

    for i, line in enumerate(buffer.lines):
        if not buffer.fenced[i] and _HEADING.match(line):
            if buffer.size >= shortest:
                give(i - 1, 0)
            seen += 1
            buffer.last = i + 1
            number, title = seen, line.strip(_WHITE)
            continue
        buffer.last = i + 1
        while buffer.size - 1 > longest:
            give(*buffer.cut(longest, shortest))
    give(buffer.last - 1, 0)
    return out


def code_pieces(text: str, longest: int = LONGEST) -> list[tuple]:
    """The pieces of a source text: whole blocks (split before lines without indent that follow a blank line) up to ``longest``.

    A block that is longer by itself is split evenly. Blank pieces are left out.
    """
    lines = text.split("\n")
    starts = [0, *(i for i in range(1, len(lines)) if not lines[i - 1].strip() and lines[i][:1].strip())]
    sums = [0, *itertools.accumulate(len(x) + 1 for x in lines)]
    out: list[tuple] = []

    def give(a: int, b: int) -> None:
        piece = "\n".join(lines[a:b])
        if piece.strip():
            for part, start, end in even_parts(piece, a + 1, b, longest):
                out.append((len(out), part, len(part), start, end, 0, ""))

    begin = 0
    for start, stop in zip(starts, [*starts[1:], len(lines)]):
        if stop > begin and start > begin and sums[stop] - sums[begin] - 1 > longest:
            give(begin, start)
            begin = start
    give(begin, len(lines))
    return out


def even_parts(text: str, start: int, end: int, longest: int = LONGEST) -> list[tuple[str, int, int]]:
    """The fixed splitter on one text: as few parts of equal length as are needed, each with its lines."""
    n = len(text)
    if n <= longest:
        return [(text, start, end)]
    size = -(-n // -(-n // longest))
    breaks = [i for i, c in enumerate(text) if c == "\n"]
    parts = []
    for a in range(0, n, size):
        first = start + bisect.bisect_left(breaks, a)
        parts.append((text[a : a + size], first, min(end, start + bisect.bisect_left(breaks, a + size))))
    return parts


PARSERS: dict[str, Callable[[str], list[tuple]]] = {"markdown": markdown_pieces, "code": code_pieces}


def register_parser(name: str, parser: Callable[[str], list[tuple]]) -> None:
    """Add a parser: a function from a text to pieces, as ``markdown_pieces`` returns them."""
    PARSERS[name] = parser


def chunked(documents: DataFrame, text: str, keys: list[str], parser: str = "markdown", **options) -> DataFrame:
    """One row per piece of each document: ``keys`` and the columns of ``PIECE_DDL``. A null text counts as empty."""
    prepare(documents.sparkSession)
    parse = PARSERS[parser]
    names = [f.name for f in PIECE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, pieces = [], []
            for i, t in enumerate(batch.column(0).to_pylist()):
                own = parse(t or "", **options)
                at += [i] * len(own)
                pieces += own
            take = pa.array(at, pa.int64())
            columns = list(zip(*pieces)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([*(batch.column(k + 1).take(take) for k in range(len(keys))), *(pa.array(c, PIECE.field(n).type) for c, n in zip(columns, names))], names=[*keys, *names])

    schema = ", ".join(f"`{k}` {documents.schema[k].dataType.simpleString()}" for k in keys)
    return documents.select(text, *keys).mapInArrow(run, f"{schema}, {PIECE_DDL}")


def fixed_split(chunks: DataFrame, text: str, start: str, end: str, longest: int = LONGEST) -> DataFrame:
    """The fixed splitter as SQL: every row becomes its parts, with ``part``, ``text_content``, ``total_chars``, ``line_start``, ``line_end``.

    A null text has no parts. The other columns stay; the ones of the names above are replaced.
    """
    content, n = F.col(text), F.length(text)
    parts = F.ceil(F.greatest(n, F.lit(1)) / F.lit(longest))
    size = F.ceil(n / parts).cast("int")
    newlines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    out = chunks.where(content.isNotNull()).select(
        *[c for c in chunks.columns if c not in (text, start, end, "part", "total_chars", "text_content", "line_start", "line_end")],
        content.alias("_text"), F.col(start).alias("_start"), F.col(end).alias("_end"), size.alias("_size"), parts.alias("_parts"),
        F.explode(F.sequence(F.lit(0), parts.cast("int") - 1)).alias("part"),
    )
    own = F.substring(F.col("_text"), F.col("part") * F.col("_size") + 1, F.col("_size"))
    head = F.substring(F.col("_text"), F.lit(1), F.col("part") * F.col("_size"))
    out = out.withColumn("text_content", own).withColumn("line_start", (F.col("_start") + newlines(head)).cast("int"))
    last = F.when(F.col("_parts") == 1, F.col("_end")).otherwise(F.least(F.col("line_start") + newlines(F.col("text_content")), F.col("_end")))
    return out.withColumn("line_end", last.cast("int")).withColumn("total_chars", F.length("text_content")).drop("_text", "_start", "_end", "_size", "_parts")


def lines_of(documents: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """One row per line of each document: ``keys``, ``line_no`` from 1, ``line``."""
    return documents.where(F.col(text).isNotNull()).select(*keys, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def fence_map(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``in_code``: a fence, or between two of them, by the parity of the fences before."""
    above = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    mark = fence(F.col("line"))
    return lines.withColumn("in_code", mark | (F.coalesce(F.sum(mark.cast("int")).over(above), F.lit(0)) % 2 == 1))


def sections(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``level`` (0 if no heading), ``section_num`` (headings so far) and ``section_title`` (the last one's) to lines with ``in_code``."""
    so_far = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    level = F.when(F.col("in_code"), F.lit(0)).otherwise(heading_level(F.col("line")))
    lines = lines.withColumn("level", level)
    title = F.when(F.col("level") > 0, heading_title(F.col("line")))
    return lines.withColumn("section_num", F.sum((F.col("level") > 0).cast("int")).over(so_far)).withColumn("section_title", F.coalesce(F.last(title, ignorenulls=True).over(so_far), F.lit("")))


def heading_at(headings: Column, line: Column) -> Column:
    """As-of: the title of the last of ``headings`` (array of struct line_no, title) at or before ``line``; empty if none."""
    before = F.filter(headings, lambda h: h["line_no"] <= line)
    return F.coalesce(F.array_max(before)["title"], F.lit(""))
