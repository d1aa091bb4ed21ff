"""Encoding of the whole corpus with a public byte-level BPE tokenizer.

Words (the tokenizer's pre-tokens) are counted over all texts; the most frequent ones are compiled with their ids into a
minimal acyclic transducer, a file in the shared folder that the workers map into memory. A batch's distinct words walk it
together; the words it doesn't hold are merged by the tokenizer's ranks. Which words the lexicon holds never changes a
result, only the time it takes.

Null and empty texts give an empty list. Blank texts are encoded like any other; strings of special tokens are ordinary
text. Rows come out one for one, repeated ones too.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.llm.lexicon import Lexicon, build, to_bytes
from corvine.session import local_file, prepare, scratch_path

# Fixed value: how this family of vocabularies splits text into words.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
LEXICON_WORDS = 32_768  # a bound on the file and on what reaches the driver
WORD_BYTES = 48  # longer words stay out of the lexicon
FLUSH_AT = 200_000  # distinct words a counting task keeps before it hands them on
_FAR = 1 << 60


def vocabulary_path(name: str = "byte_bpe_50k") -> str:
    """Where the box keeps the ranks of a public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken")


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ids, from a file of base64 tokens and ranks, or a tokenizer JSON of a byte-level BPE."""
    if not path.endswith(".json"):
        with open(path, "rb") as f:
            return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f.read().splitlines())}
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    letters = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    return {bytes(map(letters.__getitem__, token)): i for token, i in vocabulary.items() if all(c in letters for c in token)}


def merge(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """The ids of one word: the adjacent pair of lowest rank, the leftmost first, is merged until none has a rank."""
    if word in rank:
        return [rank[word]]
    n = len(word)
    end = list(range(1, n + 1))  # of the piece that begins here
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(rank[p], i, i + 2) for i in range(n - 1) if (p := word[i : i + 2]) in rank]
    heapq.heapify(heap)
    while heap:
        _, i, to = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != to:
            continue  # one of the two has been merged since
        end[i], alive[j] = to, False
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := rank.get(word[i : end[after[i]]], _FAR)) < _FAR:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if (h := before[i]) >= 0 and (r := rank.get(word[h:to], _FAR)) < _FAR:
            heapq.heappush(heap, (r, h, to))
    return [rank[word[i : end[i]]] for i in range(n) if alive[i]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        kept = [w for w in seen if len(w) <= WORD_BYTES]
        return pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array([seen[w] for w in kept], pa.int64())], names=["word", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                seen.update(WORDS.findall(text))
        if len(seen) > FLUSH_AT:
            yield out()
            seen.clear()
    yield out()


def frequent_words(texts: DataFrame, column: str, most: int = LEXICON_WORDS) -> list[str]:
    """The words that occur most often in all texts, at most ``most`` of them."""
    counts = texts.select(column).mapInArrow(_count, "word string, n long")
    top = counts.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "word").limit(most)
    return [w for (w,) in top.select("word").toLocalIterator()]


def compile_lexicon(spark: SparkSession, words: list[str], vocabulary: str) -> tuple[str, bool]:
    """Write the transducer; its path, and whether executors read it there or get it as a file of the application."""
    rank = ranks(vocabulary)
    coded = [w.encode() for w in words]
    data = to_bytes(build(coded, [merge(w, rank) for w in coded]))
    target = scratch_path(spark, "lexicon")
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(target)
    fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.deleteOnExit(at)
    if plain := local_file(target):
        fs.mkdirs(at.getParent())
        with open(plain, "wb") as f:
            f.write(data)
        return plain, True
    out = fs.create(at, True)
    for i in range(0, len(data), 1 << 20):
        out.write(bytearray(data[i : i + (1 << 20)]))
    out.close()
    sc.addFile(target)
    return target.rsplit("/", 1)[1], False


_workers: dict[tuple[str, str], tuple[Lexicon, dict[bytes, int], dict[bytes, list[int]]]] = {}


def _worker(path: str, shared: bool, vocabulary: str):
    if (path, vocabulary) not in _workers:
        from pyspark import SparkFiles

        _workers.clear()
        _workers[path, vocabulary] = (Lexicon(path if shared else SparkFiles.get(path)), ranks(vocabulary), {})
    return _workers[path, vocabulary]


def encode_batch(texts: list[str | None], lexicon: Lexicon, rank: dict[bytes, int], unseen: dict[bytes, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts one after another, and where each text's begin and end."""
    number: dict[str, int] = {}
    codes: list[int] = []
    words_in = np.zeros(len(texts) + 1, dtype=np.int64)
    for i, text in enumerate(texts):
        if text:
            codes.extend([number.setdefault(w, len(number)) for w in WORDS.findall(text)])
        words_in[i + 1] = len(codes)
    coded = [w.encode() for w in number]
    at = lexicon.index(coded)
    begins = np.where(at >= 0, lexicon.start[at], 0).astype(np.int64)
    lengths = np.where(at >= 0, lexicon.start[at + 1] - lexicon.start[at], 0).astype(np.int64)
    extra: list[int] = []
    for i in np.flatnonzero(at < 0):
        word = coded[i]
        got = unseen.get(word)
        if got is None:
            got = merge(word, rank)
            if len(unseen) < FLUSH_AT and len(word) <= WORD_BYTES:
                unseen[word] = got
        begins[i], lengths[i] = len(lexicon.ids) + len(extra), len(got)
        extra.extend(got)
    pool = np.concatenate([lexicon.ids, np.array(extra, dtype=np.int32)])
    code = np.array(codes, dtype=np.int64)
    each = lengths[code]
    ends = np.cumsum(each)
    total = int(ends[-1]) if len(ends) else 0
    shift = begins[code] - (ends - each)
    flat = pool[np.arange(total) + np.repeat(shift, each)]
    bounds = np.concatenate([[0], ends])[words_in]
    return flat, bounds


def encode(texts: DataFrame, text: str, key: str, vocabulary: str | None = None) -> DataFrame:
    """(key, ids) of every row of ``texts``."""
    spark = texts.sparkSession
    prepare(spark)
    vocabulary = vocabulary or vocabulary_path()
    path, shared = compile_lexicon(spark, frequent_words(texts, text), vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, rank, unseen = _worker(path, shared, vocabulary)
        for batch in batches:
            flat, bounds = encode_batch(batch.column(1).to_pylist(), lexicon, rank, unseen)
            ids = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
