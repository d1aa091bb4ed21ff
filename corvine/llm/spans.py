"""Long exact spans shared between records, by recompression.

1. Every text is recompressed (see ``recompress``); its top symbols that depend on no more than ``least`` characters are
   its anchors. An anchor inside a span stands in every record that holds the span, whatever surrounds it.
2. Anchors named in only one text refute every window of ``least`` characters that contains the stretch they depend on.
   What is left are runs of shared anchors, and stretches without anchors; both are intervals of a text.
3. The windows of these intervals are hashed (Karp-Rabin) and those found in two texts verify the spans, to the character.

Texts are told apart by a 64-bit content hash, so copies of one text are parsed into the same rows, which are merged before
they are grouped, and a copy under another id shares the whole text. Texts that one id alone holds count as one where that
id has several, as a span must stand under another id. Names and windows are only ever aggregated to a least
and a greatest text, never listed, so a name that a third of all records hold is no heavier than its rows.

Rows with a null id or text hold nothing; rows of the same id and text are one record; texts under ``least`` characters share
no span. Lengths and places are code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.llm.recompress import parse
from corvine.llm.words import Rolling, mix
from corvine.session import materialize, prepare

LEAST = 200
PARSE_CHARS = 250_000  # parsed at once


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) <= PARSE_CHARS):
            n += len(texts[j])
            j += 1
        yield i, j
        i = j


def _anchor_rows(texts: list[str], keys: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(name, key, number in the text, after, before, whether it stands for a stretch without anchors).

    Windows that begin after ``after`` and end before ``before`` contain no other anchor than the row's own.
    """
    s = parse(texts)
    begin, end = s.bounds[s.text], s.bounds[s.text + 1]
    usable = np.flatnonzero((s.low >= begin) & (s.high <= end) & (s.high - s.low <= least))
    text, low, high, name = s.text[usable], (s.low - begin)[usable], (s.high - begin)[usable], s.name[usable]
    n, size = len(usable), np.diff(s.bounds)
    per = np.bincount(text, minlength=len(texts))
    first = np.cumsum(per) - per
    number = np.arange(n) - first[text]
    is_first, is_last = number == 0, number == per[text] - 1
    after, before = np.full(n, -1), size[text] + 1
    after[~is_first] = low[np.flatnonzero(~is_first) - 1]
    before[~is_last] = high[np.flatnonzero(~is_last) + 1]
    # Stretches without anchors: up to the first, between two, from the last on, and texts that have none.
    gap_text = np.concatenate([text, text[is_last], np.flatnonzero(per == 0)])
    gap_after = np.concatenate([after, low[is_last], np.full((per == 0).sum(), -1)])
    gap_before = np.concatenate([high, before[is_last], size[per == 0] + 1])
    wide = gap_before - gap_after - 2 >= least
    gap_text, gap_after, gap_before = gap_text[wide], gap_after[wide], gap_before[wide]
    gap = np.zeros(n + len(gap_text), dtype=bool)
    gap[n:] = True
    # a gap's number is negative and even, so that it joins no run
    return (
        np.concatenate([name.astype(np.int64), np.zeros(len(gap_text), dtype=np.int64)]),
        np.concatenate([keys[text], keys[gap_text]]),
        np.concatenate([number, -2 * (gap_after + 2)]),
        np.concatenate([after, gap_after]),
        np.concatenate([before, gap_before]),
        gap,
    )


def _anchors(least: int):
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = batch.column(1).to_pylist(), batch.column(0).to_numpy()
            for i, j in _slices(texts):
                *columns, gap = _anchor_rows(texts[i:j], keys[i:j], least)
                arrays = [pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(columns, kinds)]
                arrays[0] = pa.array(columns[0], pa.int64(), mask=gap)
                yield pa.RecordBatch.from_arrays(arrays, names=["name", "key", "number", "after", "before"])

    return run, "name long, key long, number int, after int, before int"


def _intervals(least: int):
    """Per text, the intervals left by its runs of shared anchors and its stretches without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1)
            flat, per = rows.flatten(), np.diff(rows.offsets.to_numpy())
            text = np.repeat(np.arange(len(per)), per)
            number, after, before = (flat.field(k).to_numpy() for k in range(3))
            order = np.lexsort((number, text))
            text, number, after, before = text[order], number[order], after[order], before[order]
            head = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (number[1:] != number[:-1] + 1)])) if len(text) else np.zeros(0, dtype=int)
            if not len(head):
                continue
            begin, end = np.minimum.reduceat(after, head) + 1, np.maximum.reduceat(before, head) - 1
            wide = end - begin >= least
            of = text[head][wide]
            bounds = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(per)))]).astype(np.int32)
            has = np.flatnonzero(np.diff(bounds))
            spans = pa.StructArray.from_arrays([pa.array(begin[wide].astype(np.int32)), pa.array(end[wide].astype(np.int32))], names=["begin", "stop"])
            lists = pa.ListArray.from_arrays(pa.array(bounds), spans)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(has)), lists.take(pa.array(has))], names=["key", "intervals"])

    return run, "key long, intervals array<struct<begin: int, stop: int>>"


def _windows(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, holder, text, intervals in zip(*(batch.column(c).to_pylist() for c in range(4))):
                codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
                covered = np.zeros(len(codes) + 1, dtype=np.int32)
                for x in intervals:
                    covered[max(0, x["begin"])] += 1
                    covered[min(len(codes), x["stop"]) - least + 1] -= 1
                at = np.flatnonzero(np.cumsum(covered)[: len(codes) - least + 1] > 0)
                hashes = mix(Rolling(codes).runs(least)[at]).astype(np.int64)
                holders = pa.nulls(len(at), pa.int64()) if holder is None else pa.array(np.full(len(at), holder))
                yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(np.full(len(at), key)), pa.array(at.astype(np.int32)), holders], names=["window", "key", "at", "holder"])

    return run, "window long, key long, at int, holder long"


def _merged(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for starts in batch.column(1).to_pylist():
                starts = np.sort(np.array(starts))
                cut = np.flatnonzero(np.diff(starts) > least)  # touching spans are one
                out.append([{"begin": int(starts[a]), "stop": int(starts[b]) + least} for a, b in zip([0, *(cut + 1)], [*cut, len(starts) - 1])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.struct([("begin", pa.int32()), ("stop", pa.int32())])))], names=["key", "spans"])

    return run, "key long, spans array<struct<begin: int, stop: int>>"


def _twice(rows: DataFrame, by: str, holder: Column) -> DataFrame:
    """The values of ``by`` that at least two holders have."""
    return rows.groupBy(by).agg(F.min(holder).alias("least"), F.max(holder).alias("most")).where("least <> most").select(by)


def shared_spans(records: DataFrame, text: str, key: str, least: int = LEAST) -> DataFrame:
    """(key, spans, shared_chars, share) of the records with a span of at least ``least`` characters that another record holds.

    ``spans`` are the maximal intervals covered by such spans, as (begin, stop) from 0.
    """
    prepare(records.sparkSession)
    rows = records.where(F.col(key).isNotNull() & (F.length(text) >= least)).select(F.col(key).alias("id"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))
    texts = rows.groupBy("key").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    several = rows.groupBy("id").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b").select(F.col("id").alias("first_id"), F.xxhash64(F.lit("id"), "id").alias("of_id"))

    anchors = materialize(rows.select("key", "text").mapInArrow(*_anchors(least)), "anchors")
    shared = anchors.join(_twice(anchors.where("name IS NOT NULL"), "name", F.col("key")), "name", "left_semi").unionByName(anchors.where("name IS NULL"))
    places = shared.groupBy("key").agg(F.collect_set(F.struct("number", "after", "before")).alias("places"))  # copies merge here
    left = places.mapInArrow(*_intervals(least)).join(texts, "key").join(several, "first_id", "left")
    left = left.select(F.col("first_id").alias("id"), "key", F.when(F.col("first_id") == F.col("last_id"), F.col("of_id")).alias("holder"), "intervals")

    candidates = left.join(rows, ["id", "key"]).dropDuplicates(["key"]).select("key", "holder", "text", "intervals")
    windows = materialize(candidates.mapInArrow(*_windows(least)), "windows")
    starts = windows.join(_twice(windows, "window", F.coalesce("holder", "key")), "window", "left_semi").groupBy("key").agg(F.collect_set("at").alias("starts"))
    spans = starts.mapInArrow(*_merged(least))

    ids = rows.select("id", "key", F.length("text").alias("chars")).distinct()
    whole = F.array(F.struct(F.lit(0).alias("begin"), F.col("chars").alias("stop")))
    of_text = texts.where("first_id <> last_id").select("key", F.lit(True).alias("copied")).join(spans, "key", "full")
    found = ids.join(of_text, "key").withColumn("spans", F.when(F.col("copied"), whole).otherwise(F.col("spans")))
    chars = F.aggregate("spans", F.lit(0), lambda n, s: n + s["stop"] - s["begin"])
    # an id with several texts keeps the one with most in common
    best = F.max_by(F.struct("spans", "shared_chars", "share"), F.struct("shared_chars", "key"))
    return found.withColumn("shared_chars", chars).withColumn("share", F.col("shared_chars") / F.col("chars")).groupBy(F.col("id").alias(key)).agg(best.alias("m")).select(key, "m.*")
