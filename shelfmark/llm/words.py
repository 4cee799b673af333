"""Distinct-word tables: work is done once for each distinct word and gathered by index for each text."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# How a tokenizers file must normalize and split, for encoders that work word by word.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
# What such a file says of its model and its added tokens.
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
ADDED = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}

# Words of lower-case letters up to U+024F, where NFC changes nothing and each letter but U+0130 has one lower-case letter;
# texts of other characters than these and common signs; and signs that make one piece with a comma or full stop after them.
LOWER_LETTERS = re.compile(f"[{''.join(c for c in map(chr, range(0x250)) if c.isalpha() and c.lower() == c)}]+")
OTHER_CHARACTERS = r"[^\x{0}-\x{12F}\x{131}-\x{24F}\x{2010}-\x{2027}]"
SIGNS_TOGETHER = r"[^\pL\pN ][,.] "


def word_tokenizer(tokenizer_file: str) -> dict[str, Any]:
    """The content of a tokenizers file whose texts can be encoded word by word; another file raises ValueError."""
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    wrong = [k for k, want in (("normalizer", NORMALIZER), ("pre_tokenizer", PRE_TOKENIZER)) if spec.get(k) != want]
    wrong += [f"model.{k}" for k, want in MODEL.items() if model.get(k) != want]
    wrong += ["model.continuing_subword_prefix"] * bool(model.get("continuing_subword_prefix")) + ["model.end_of_word_suffix"] * (not model.get("end_of_word_suffix"))
    wrong += [f"added token {t['content']}" for t in spec["added_tokens"] if any(t.get(k) != want for k, want in ADDED.items())]
    wrong += ["decoder"] * (spec.get("decoder") is not None)
    if wrong:
        raise ValueError(f"{tokenizer_file} isn't of the kind that is encoded word by word: {', '.join(wrong)}")
    return spec


class WordIndex(dict):
    """word -> row number; looking up a new word gives it the next row and notes it as new."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = row = len(self)
        self.new.append(word)
        return row

    def rows(self, words: Sequence[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def split_words(text: str) -> list[str]:
    """Pieces between single spaces and line feeds; may hold empty pieces and other white space."""
    return text.replace("\n", " ").split(" ")


def lower_words(texts: pa.Array, whole: Sequence[str]) -> pa.ListArray:
    """Words between spaces and line feeds, in lower case and without the comma or full stop after them where the library gives the same ids for that.

    whole: the added tokens, which are in no case but their own.
    """
    raw = pc.replace_substring(pc.binary_join_element_wise(texts, *(pa.scalar(t, texts.type) for t in ("", " "))), "\n", " ")
    lower = pc.utf8_lower(raw)
    differ = pc.match_substring_regex(raw, OTHER_CHARACTERS)
    for token in whole:
        differ = pc.or_(differ, pc.match_substring(lower, token.lower()))
    lower = pc.if_else(differ, raw, lower)
    apart = pc.replace_substring(pc.replace_substring(lower, ", ", " , "), ". ", " . ")
    return pc.split_pattern(pc.if_else(pc.or_(differ, pc.match_substring_regex(lower, SIGNS_TOGETHER)), lower, apart), " ")


class Ragged:
    """Rows of integers of any length, appended in blocks and gathered by row number."""

    def __init__(self, dtype: type = np.int32) -> None:
        self.flat, self.offsets, self.used, self.n = np.empty(1 << 16, dtype), np.zeros(1 << 14, np.int64), 0, 0

    def append(self, rows: Sequence[Sequence[int]]) -> None:
        lens = np.fromiter(map(len, rows), np.int64, len(rows))
        self.extend(np.fromiter((x for row in rows for x in row), self.flat.dtype, int(lens.sum())), lens)

    def extend(self, values: np.ndarray, lens: np.ndarray) -> None:
        """Append rows given as all their values in order and how many each row has."""
        while self.used + len(values) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.n + len(lens) + 1 > len(self.offsets):
            self.offsets = np.concatenate([self.offsets, np.zeros_like(self.offsets)])
        self.flat[self.used : self.used + len(values)] = values
        self.offsets[self.n + 1 : self.n + len(lens) + 1] = self.used + np.cumsum(lens)
        self.used += len(values)
        self.n += len(lens)

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of these rows in order, and how many each row has."""
        starts = self.offsets[rows]
        lens = self.offsets[rows + 1] - starts
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(starts - (ends - lens), lens) + np.arange(total)
        return self.flat[at], lens


class RaggedWords:
    """A bounded cache from words to rows of integers, filled by `encode` for the distinct new words of a batch."""

    def __init__(self, encode: Callable[[list[str]], Sequence[Sequence[int]]], limit: int) -> None:
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.index, self.table = WordIndex(), Ragged()

    def _rows(self, texts: Sequence[str]) -> list[np.ndarray]:
        if len(self.index) > self.limit:
            self.clear()
        out = [self.index.rows(split_words(t)) for t in texts]
        if self.index.new:
            self.table.append(self.encode(self.index.new))
            self.index.new = []
        return out

    def batch(self, texts: Sequence[str]) -> list[np.ndarray]:
        """The encoded integers of each text."""
        return [self.table.gather(rows)[0] for rows in self._rows(texts)]

    def flat(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The encoded integers of all texts in order, and where each text's begin, with the end of the last."""
        rows = self._rows(texts)
        values, lens = self.table.gather(np.concatenate([np.zeros(0, np.int64), *rows]))
        words = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        return values, np.concatenate([[0], np.cumsum(lens)])[words]


class CountedWords:
    """A bounded cache from words of Arrow arrays to rows of integers, filled by `encode` (all values, and each word's length) for the new words.

    When full it forgets the words met only once since it was last full, and the rarest beyond half its limit. Words are found by
    Arrow, which hashes those kept once for each array, so arrays should have some hundred thousand words.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int) -> None:
        self.encode, self.limit = encode, limit
        self.words, self.table, self.uses = pa.array([], pa.string()), Ragged(), np.zeros(0, np.int64)

    def forget(self) -> None:
        most = np.argsort(-self.uses, kind="stable")[: self.limit // 2]
        kept = np.sort(most[self.uses[most] > 1])
        values, lens = self.table.gather(kept)
        self.words, self.table, self.uses = self.words.take(pa.array(kept)), Ragged(), self.uses[kept] // 2
        self.table.extend(values, lens)

    def flat(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The encoded integers of all words in order, and how many each word has."""
        if len(self.words) > self.limit:
            self.forget()
        known = self.words.cast(words.type)
        found = pc.index_in(words, value_set=known)
        rows = found.fill_null(0).to_numpy().astype(np.int64)
        if found.null_count:
            is_new = found.is_null()
            new = words.filter(is_new).dictionary_encode()
            self.table.extend(*self.encode(new.dictionary.to_pylist()))
            rows[is_new.to_numpy(zero_copy_only=False)] = len(known) + new.indices.to_numpy()
            self.words = pa.concat_arrays([known, new.dictionary])
            self.uses = np.concatenate([self.uses, np.zeros(len(new.dictionary), np.int64)])
        self.uses += np.bincount(rows, minlength=len(self.uses))
        return self.table.gather(rows)


class WordRows:
    """A bounded cache from words to rows of arrays, which `scored` makes for the distinct new words of a batch."""

    def __init__(self, scored: Callable[[list[str]], tuple[np.ndarray, ...]], limit: int) -> None:
        self.scored, self.limit = scored, limit
        self.index, self.arrays, self.used = WordIndex(), (), 0

    def batch(self, split: Sequence[Sequence[str]]) -> tuple[list[np.ndarray], tuple[np.ndarray, ...]]:
        """Row numbers of each text's words, and the arrays that these rows are of."""
        if len(self.index) > self.limit:
            self.index, self.arrays, self.used = WordIndex(), (), 0
        rows = [self.index.rows(words) for words in split]
        if self.index.new:
            new = self.scored(self.index.new)
            self.arrays = self.arrays or tuple(np.empty((0, *x.shape[1:]), x.dtype) for x in new)
            n = self.used + len(self.index.new)
            if n > len(self.arrays[0]):
                # By half as much again each time, so rows are copied few times and little is empty.
                room = max(n, len(self.arrays[0]) * 3 // 2)
                self.arrays = tuple(np.concatenate([old[: self.used], np.empty((room - self.used, *old.shape[1:]), old.dtype)]) for old in self.arrays)
            for array, x in zip(self.arrays, new, strict=True):
                array[self.used : n] = x
            self.used, self.index.new = n, []
        return rows, self.arrays
