"""Evaluation texts leaking into training text, by greedy string tiling.

Seeds are runs of ``min(run, words of the item)`` words. A document that shares a seed with an item is tiled against it: the
longest matches of words not yet marked are marked first, found by running Karp-Rabin with a shrinking length, and the
marked share of the item's words is its coverage, which also counts passages in another order. The longest tile decides
``p9_found`` (seeds of 13 words), the coverage ``p9_reordered`` (seeds of ``TILE`` words).

Items are few against the corpus; where their size is within ``BROADCAST_BYTES`` each worker holds their seeds. Beyond that
each worker holds a table of bits that turns nearly all places of the corpus away (``Seeds.BITS``), and what is left is
joined with the seeds; that gives the same rows.

Null and wordless texts hold and leak nothing; repeated rows give repeated work but one result per (document, item).
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.llm.words import Rolling, words
from corvine.session import materialize, prepare

RUN = 13
TILE = 5  # the shortest tile that counts towards the coverage
BROADCAST_BYTES = 16 << 20
RESULT = "long_run int, tiles int, covered_words int, item_words int, coverage double"


def _codes(tokens: list[str]) -> np.ndarray:
    return np.fromiter(map(hash, tokens), dtype=np.int64, count=len(tokens))  # PYTHONHASHSEED is the same for all workers


def tile(document: list[str], item: list[str], least: int = TILE) -> list[tuple[int, int, int]]:
    """Non-overlapping matches (place in document, place in item, words), the longest first; none is under ``least`` words.

    Of equally long matches the one that stands first in the document, then in the item, is taken.
    """
    marked_d, marked_i = np.zeros(len(document), dtype=bool), np.zeros(len(item), dtype=bool)
    hashes = (Rolling(_codes(document)), Rolling(_codes(item)))
    tiles: list[tuple[int, int, int]] = []
    least = min(least, len(item)) or 1
    length = min(len(document), len(item))
    while length >= least:
        # The longest match among the free words: its length is found by bisection, since a match holds all shorter ones.
        low, high, found = least, length, []
        while low <= high:
            s = (low + high) // 2
            got = _matches(hashes, marked_d, marked_i, s)
            if got:
                found, low = got, s + 1
            else:
                high = s - 1
        if not found:
            break
        length, before = high, len(tiles)
        for a, b in found:
            if document[a : a + length] != item[b : b + length] or marked_d[a : a + length].any() or marked_i[b : b + length].any():
                continue
            marked_d[a : a + length] = marked_i[b : b + length] = True
            tiles.append((a, b, length))
        if len(tiles) == before:
            length -= 1  # equal hashes of unequal runs
    return tiles


def _matches(hashes: tuple[Rolling, Rolling], marked_d: np.ndarray, marked_i: np.ndarray, s: int) -> list[tuple[int, int]]:
    def free(marked: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(marked)])
        return np.flatnonzero(sums[s:] == sums[:-s])

    d, i = free(marked_d), free(marked_i)
    if not len(d) or not len(i):
        return []
    at: dict[int, list[int]] = defaultdict(list)
    of_item, of_document = hashes[1].runs(s)[i], hashes[0].runs(s)[d]
    for p, h in zip(i.tolist(), of_item.tolist()):
        at[h].append(p)
    hits = np.flatnonzero(np.isin(of_document, of_item))
    # At the greatest length repeats on both sides are few; each place takes part at most once per round anyway.
    out: list[tuple[int, int]] = []
    used: dict[int, int] = defaultdict(int)
    for k in hits.tolist():
        h = int(of_document[k])
        places = at[h]
        out.append((int(d[k]), places[min(used[h], len(places) - 1)]))
        used[h] += 1
    return out


class Seeds:
    """The seeds of all items, with a bit table that turns most places away before the search."""

    BITS = 22

    def __init__(self, items: list[tuple[int, list[str]]], run: int = RUN):
        self.items = {i: w for i, w in items if w}
        by_length: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, w in self.items.items():
            s = min(run, len(w))
            by_length[s] += [(h, i) for h in Rolling(_codes(w)).runs(s).tolist()]
        self.tables = []
        for s, pairs in by_length.items():
            pairs.sort()
            h = np.array([p[0] for p in pairs], dtype=np.uint64)
            table = np.zeros(1 << self.BITS, dtype=bool)
            table[(h >> np.uint64(64 - self.BITS)).astype(np.int64)] = True
            self.tables.append((s, h, np.array([p[1] for p in pairs], dtype=np.int64), table))

    def hits(self, rolling: Rolling) -> Iterator[tuple[int, int, int]]:
        """(place, length, item) wherever a seed matches."""
        for s, h, item, table in self.tables:
            runs = rolling.runs(s)
            maybe = np.flatnonzero(table[(runs >> np.uint64(64 - self.BITS)).astype(np.int64)])
            left, right = np.searchsorted(h, runs[maybe], "left"), np.searchsorted(h, runs[maybe], "right")
            for k in np.flatnonzero(right > left).tolist():
                for i in range(left[k], right[k]):
                    yield int(maybe[k]), s, int(item[i])


def _results(found: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*found)) if found else [[]] * 7
    kinds = [key_type, pa.int64(), *[pa.int32()] * 4, pa.float64()]
    names = ["key", "item_id", "long_run", "tiles", "covered_words", "item_words", "coverage"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _measure(document: list[str], item: list[str]) -> tuple:
    tiles = tile(document, item)
    covered = sum(t[2] for t in tiles)
    return max((t[2] for t in tiles), default=0), len(tiles), covered, len(item), covered / len(item)


def leaks(documents: DataFrame, text: str, key: str, items: DataFrame, item_text: str = "text", item_key: str = "item_id", run: int = RUN) -> DataFrame:
    """(key, item_id, long_run, tiles, covered_words, item_words, coverage) of every document that shares a seed with an item.

    ``long_run`` is the length in words of the longest run common to both.
    """
    prepare(documents.sparkSession)
    kind = documents.schema[key].dataType.simpleString()
    items = items.where(F.col(item_key).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_key).cast("long").alias("item_id"), F.col(item_text).alias("item_text"))
    size = items.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0
    docs = documents.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    if size <= BROADCAST_BYTES:
        held = [(i, t) for i, t in items.toLocalIterator()]
        found = docs.mapInArrow(_against(held, run), f"key {kind}, item_id long, {RESULT}")
    else:
        found = _joined(docs, items, kind, run)
    best = F.max_by(F.struct("long_run", "tiles", "covered_words", "item_words", "coverage"), F.struct("long_run", "covered_words"))
    return found.groupBy("key", "item_id").agg(best.alias("m")).select(F.col("key").alias(key), "item_id", "m.*")


def _against(held: list[tuple[int, str]], length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = Seeds([(i, words(t)) for i, t in held], length)
        for batch in batches:
            tokens: list[str] = []
            ends = []
            for text in batch.column(1).to_pylist():
                tokens += words(text)
                ends.append(len(tokens))
            bounds = np.array([0, *ends])
            hits: dict[int, set[int]] = defaultdict(set)
            for place, size, item in seeds.hits(Rolling(_codes(tokens))):
                row = int(np.searchsorted(bounds, place, "right")) - 1
                if place + size <= bounds[row + 1]:  # else it runs over the text's end
                    hits[row].add(item)
            keys = batch.column(0)
            found = []
            for row, wanted in sorted(hits.items()):
                document = tokens[bounds[row] : bounds[row + 1]]
                for item in sorted(wanted):
                    found.append((keys[row].as_py(), item, *_measure(document, seeds.items[item])))
            yield _results(found, keys.type)

    return run


def _item_seeds(run: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hashes, sizes = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = words(text)
                if tokens:
                    h = np.unique(Rolling(_codes(tokens)).runs(min(run, len(tokens)))).astype(np.int64)
                    keys += [key] * len(h)
                    hashes += h.tolist()
                    sizes += [min(run, len(tokens))] * len(h)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(hashes, pa.int64()), pa.array(sizes, pa.int32())], names=["item_id", "seed", "length"])

    return rows, "item_id long, seed long, length int"


def _place(h: np.ndarray, bits: int) -> np.ndarray:
    return (h.astype(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def _document_seeds(tables: dict[int, bytes], bits: int, kind: str):
    """The seeds of documents that the tables of bits, one per length, don't turn away."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {s: np.frombuffer(zlib.decompress(t), dtype=np.uint8) for s, t in tables.items()}
        for batch in batches:
            at, hashes, sizes = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                tokens = words(text)
                rolling = Rolling(_codes(tokens))
                for s, table in known.items():
                    h = rolling.runs(s)
                    place = _place(h, bits)
                    h = np.unique(h[(table[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1]).astype(np.int64)
                    at += [i] * len(h)
                    hashes += h.tolist()
                    sizes += [s] * len(h)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(hashes, pa.int64()), pa.array(sizes, pa.int32())], names=["key", "seed", "length"])

    return rows, f"key {kind}, seed long, length int"


FILTER_BITS = 24  # 2 MB a length


def _joined(docs: DataFrame, items: DataFrame, kind: str, run: int) -> DataFrame:
    """For items beyond the bound: seeds that pass the tables of bits are joined on their hash, then each pair is tiled."""
    seeds = materialize(items.mapInArrow(*_item_seeds(run)), "seeds")
    tables = {s: np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8) for (s,) in seeds.select("length").distinct().collect()}  # ``run`` lengths at most
    places = seeds.select("length", F.shiftrightunsigned("seed", 64 - FILTER_BITS).alias("place")).distinct()  # at most 2**FILTER_BITS a length
    for s, place in places.toLocalIterator():
        tables[s][place >> 3] |= 1 << (place & 7)
    packed = {s: zlib.compress(t.tobytes(), 1) for s, t in tables.items()}
    # a seed that a large share of documents hold is split by AQE's skew join; pairs are few after it
    pairs = docs.mapInArrow(*_document_seeds(packed, FILTER_BITS, kind)).join(seeds, ["seed", "length"]).select("key", "item_id").distinct()

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, i, *_measure(words(t), words(u))) for k, i, t, u in zip(*(batch.column(c).to_pylist() for c in range(4)))]
            yield _results(found, batch.column(0).type)

    return pairs.join(docs, "key").join(items, "item_id").select("key", "item_id", "text", "item_text").mapInArrow(measured, f"key {kind}, item_id long, {RESULT}")


def leaked(measured: DataFrame) -> DataFrame:
    """The rows with a run of 13 words, or of all the item's words where it has fewer."""
    return measured.where(F.col("long_run") >= F.least(F.lit(RUN), F.col("item_words")))


def covered(measured: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows in which at least ``least`` of the item's words are covered by tiles, in whatever order they stand."""
    return measured.where(F.col("coverage") >= least)
