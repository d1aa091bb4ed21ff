"""Token ids for embedding models: WordPiece and Unigram vocabularies from a tokenizer file, padded to a fixed length."""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST_WORD = 50  # characters; a longer word is unknown as a whole
_SPACE = re.compile(r"[\s\x85\xa0]+")
TENSORS = "struct<input_ids: array<bigint>, attention_mask: array<bigint>, token_type_ids: array<bigint>>"


class _Table(dict):
    """A table for ``str.translate`` that is filled as characters come up."""

    def __init__(self, rule: Callable[[str], str | None]):
        self.rule = rule

    def __missing__(self, code: int) -> str | None:
        out = self[code] = self.rule(chr(code))
        return out


_PLAIN = _Table(lambda c: None if unicodedata.category(c) == "Mn" or (c < " " and c not in "\t\n\r") else c)
_APART = _Table(lambda c: f" {c} " if unicodedata.category(c)[0] == "P" else c)
KNOWN_WORDS = 200_000  # words a tokenizer remembers


class WordPiece:
    """Greedy longest pieces of words; a word that can't be pieced together is unknown as a whole."""

    def __init__(self, model: dict):
        self.vocab: dict[str, int] = model["vocab"]
        self.join = model.get("continuing_subword_prefix", "##")
        self.unknown = self.vocab.get("[UNK]", 0)
        self.first, self.last, self.pad = (self.vocab.get(t, 0) for t in ("[CLS]", "[SEP]", "[PAD]"))
        self._known: dict[str, list[int]] = {}

    @staticmethod
    def normalize(text: str) -> str:
        return unicodedata.normalize("NFKD", text.lower()).translate(_PLAIN)

    @staticmethod
    def words(text: str) -> list[str]:
        """Split at white space; every punctuation mark is a word of its own, symbols such as ``$`` are not."""
        return [w for w in _SPACE.split(text.translate(_APART)) if w]

    def pieces(self, word: str) -> list[int]:
        if len(word) > LONGEST_WORD:
            return [self.unknown]
        out, at = [], 0
        while at < len(word):
            lead = self.join if at else ""
            end = next((e for e in range(len(word), at, -1) if lead + word[at:e] in self.vocab), None)
            if end is None:
                return [self.unknown]
            out.append(self.vocab[lead + word[at:end]])
            at = end
        return out

    def ids(self, text: str) -> list[int]:
        known = self._known
        out: list[int] = []
        for w in self.words(self.normalize(text)):
            got = known.get(w)
            if got is None:
                got = self.pieces(w)
                if len(known) < KNOWN_WORDS:
                    known[w] = got
            out += got
        return out


class Unigram:
    """The most likely segmentation under independent piece scores."""

    def __init__(self, model: dict):
        self.vocab, self.score = {}, {}
        for i, entry in enumerate(model["vocab"]):
            if len(entry) >= 2 and isinstance(entry[0], str) and isinstance(entry[1], (int, float)):
                self.vocab[entry[0]], self.score[entry[0]] = i, float(entry[1])
        self.unknown = int(model.get("unk_id") or 0)
        name = next((t for t, i in self.vocab.items() if i == self.unknown), "<unk>")
        self.unknown_score = self.score.get(name, 0.0)
        self.first, self.last, self.pad = (self.vocab.get(t, 0) for t in ("<s>", "</s>", "<pad>"))
        self.longest = max(map(len, self.vocab), default=0)

    def words(self, text: str) -> list[str]:
        """A blank is written as a mark and one is put before the text; other white space splits."""
        return [w for w in _SPACE.split((" " + text).replace(" ", "▁")) if w] if text else []

    def pieces(self, word: str) -> list[int]:
        """Where no piece starts, one character is unknown, even if a piece already ended behind it."""
        n = len(word)
        best: list[tuple[float, int, int]] = [(0.0, 0, 0)] + [(-math.inf, 1, self.unknown)] * n
        for i in range(n):
            if best[i][0] == -math.inf:
                continue
            known = [e for e in range(i + 1, min(n, i + self.longest) + 1) if word[i:e] in self.vocab]
            for e in known:
                total = best[i][0] + self.score[word[i:e]]
                if total > best[e][0]:
                    best[e] = (total, e - i, self.vocab[word[i:e]])
            if not known:
                best[i + 1] = (best[i][0] + self.unknown_score, 1, self.unknown)
        out, at = [], n
        while at:
            _, size, piece = best[at]
            out.append(piece)
            at -= size
        return out[::-1]

    def ids(self, text: str) -> list[int]:
        return [i for w in self.words(unicodedata.normalize("NFKC", text.lower())) for i in self.pieces(w)]


def load(path: str) -> WordPiece | Unigram:
    """The tokenizer of a tokenizer JSON, by its model's type; another type is an error."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    kinds = {"WordPiece": WordPiece, "Unigram": Unigram}
    if model.get("type") not in kinds:
        raise ValueError(f"unsupported tokenizer type: {model.get('type')!r}")
    return kinds[model["type"]](model)


def tensors(tokenizer: WordPiece | Unigram, text: str, length: int) -> tuple[list[int], list[int], list[int]]:
    """Ids with a first and a last mark, cut and padded to ``length``; the attention mask; type ids of zero."""
    ids = [tokenizer.first, *tokenizer.ids(text)[: length - 2], tokenizer.last][:length]
    blank = length - len(ids)
    return ids + [tokenizer.pad] * blank, [1] * len(ids) + [0] * blank, [0] * length


def encode(text: Column, tokenizer: WordPiece | Unigram, length: int = 512) -> Column:
    """The tensors of each text; a null text counts as empty."""

    @F.pandas_udf(TENSORS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([tensors(tokenizer, t or "", length) for t in texts], columns=["input_ids", "attention_mask", "token_type_ids"])

    return run(text)
