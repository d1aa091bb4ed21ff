"""Repetition inside a single document, as a cascade of rules that stops at the first that settles a text.

``measure`` gives the exact shares of every document. ``repetitive`` only asks whether the share reaches a threshold: each
rule is a condition that every case meets, so a text that fails one is settled without the dearer ones, and the exact share
decides about the rest. On a sample of texts the time and the rejections of each rule are taken, and the rules are put in
order of rejections per second. The order never changes a result.

Null, empty and short texts have the share 0. Repeated rows come out as often as they are given.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.llm.words import Rolling, words
from corvine.session import prepare

RUN = 8
THRESHOLD = 0.3
SAMPLE_ROWS = 400  # only the order of the rules comes from these


class _Text:
    """What the rules look at; made when first needed."""

    def __init__(self, text: str | None):
        self.words = words(text)
        self._rolling: Rolling | None = None

    @property
    def rolling(self) -> Rolling:
        if self._rolling is None:
            self._rolling = Rolling(np.fromiter(map(hash, self.words), dtype=np.int64, count=len(self.words)))
        return self._rolling


def repeated(x: _Text, run: int) -> tuple[int, int]:
    """How many runs of ``run`` words equal an earlier one, and how many there are."""
    n = len(x.words) - run + 1
    return (n - len(np.unique(x.rolling.runs(run))), n) if n > 0 else (0, 0)


def _long_enough(x: _Text, run: int, least: float) -> bool:
    n = len(x.words) - run + 1
    return n > 1 and (n - 1) / n >= least


def _few_words(x: _Text, run: int, least: float) -> bool:
    # A word's first place starts a new run, but for the last run - 1 places: distinct words <= new runs + run - 1.
    n = len(x.words) - run + 1
    return n > 0 and (n - max(0, len(set(x.words)) - run + 1)) / n >= least


def _repeats(size: int) -> Callable[[_Text, int, float], bool]:
    def rule(x: _Text, run: int, least: float) -> bool:
        # Where a long run is repeated, so is the short one at its start.
        n = len(x.words) - run + 1
        return n > 0 and repeated(x, size)[0] / n >= least

    return rule


RULES: dict[str, Callable[[_Text, int, float], bool]] = {"long_enough": _long_enough, "few_words": _few_words, "repeats_2": _repeats(2), "repeats_4": _repeats(4)}


def exact_share(x: _Text, run: int) -> float:
    again, n = repeated(x, run)
    return again / n if n else 0.0


def order_rules(sample: list[str | None], run: int = RUN, least: float = THRESHOLD) -> list[str]:
    """The rules by rejections per second on the sample; those that reject nothing there stay out, as the exact share follows."""
    gain = {}
    for name, rule in RULES.items():
        texts = [_Text(t) for t in sample]
        began = time.perf_counter()
        rejected = sum(not rule(x, run, least) for x in texts)
        gain[name] = rejected / (time.perf_counter() - began + 1e-9)
    return [n for n in sorted(gain, key=gain.get, reverse=True) if gain[n] > 0]


def repetitive(documents: DataFrame, text: str, key: str, run: int = RUN, least: float = THRESHOLD) -> DataFrame:
    """(key, share) of the documents whose share of repeated runs of ``run`` words is at least ``least`` (above 0)."""
    prepare(documents.sparkSession)
    order = order_rules([t for (t,) in documents.select(text).limit(SAMPLE_ROWS).toLocalIterator()], run, least)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, shares = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                x = _Text(t)
                if all(RULES[name](x, run, least) for name in order) and (share := exact_share(x, run)) >= least:
                    rows.append(i)
                    shares.append(share)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(shares, pa.float64())], names=[key, "share"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(go, f"`{key}` {kind}, share double")


def measure(documents: DataFrame, text: str, key: str, run: int = RUN) -> DataFrame:
    """Of every document the share of repeated word runs, and of characters in repeated lines and paragraphs."""
    prepare(documents.sparkSession)

    def parts(text: str, by: str) -> float:
        own = [p for p in (x.strip() for x in text.split(by)) if p]
        seen: set[str] = set()
        again = sum(len(p) for p in own if p in seen or seen.add(p))
        return again / total if (total := sum(map(len, own))) else 0.0

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            shares = [exact_share(_Text(t), run) for t in texts]
            lines, paragraphs = ([parts(t, by) if t else 0.0 for t in texts] for by in ("\n", "\n\n"))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.float64()) for c in (shares, lines, paragraphs))], names=[key, "run_share", "line_share", "paragraph_share"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(go, f"`{key}` {kind}, run_share double, line_share double, paragraph_share double")
