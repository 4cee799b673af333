"""BPE encoding by a prefix-sharing trie, and decoding.

Sorted, distinct words are a trie's paths depth first. The walk keeps, for each prefix on its path, the last token of that prefix's
encoding: the only vocabulary entry t ending there such that t may follow the last token u of the prefix before it,
which holds when no merge across their border would come before the merges that build u and t. A shared prefix is
so encoded once, and a word's ids are read backwards along these tokens. The entries that end at a letter are those of
a state of a second trie, that of the vocabulary, with links to the longest suffix that is in it too. Texts then gather their words' encodings.

Defined results: null and empty texts have no ids and decode to ''; every row is kept, repeated or not; an empty table
gives no rows; other columns are ignored. A tokenizers file that normalizes or splits otherwise is refused.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from shelfmark.llm.frames import by_bytes, merged, small_batches, two_columns, worker_slot
from shelfmark.llm.words import LOWER_LETTERS, CountedWords, Ragged, lower_words, split_words, word_tokenizer

#: Distinct words, pieces of words, and pairs of tokens that a Python worker keeps.
WORDS_KEPT, PIECES_KEPT, PAIRS_KEPT = 250_000, 80_000, 200_000
#: Bytes of text that are encoded at once.
CHUNK = 1 << 20
#: New words whose ids are lists at once.
AT_ONCE = 10_000
NEVER = 1 << 60

# White space of Unicode, and the pieces that the public vocabulary's splitter keeps.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    table = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class TrieBpe:
    """Encoder for a tokenizers file with a byte-level BPE model and an end-of-word suffix."""

    def __init__(self, tokenizer_file: str) -> None:
        spec = word_tokenizer(tokenizer_file)
        model = spec["model"]
        end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.text = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text |= {i: t for t, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pieces = regex.compile(PIECES)
        self.letters = byte_letters()
        self.spelling = {b: x for b, x in enumerate(self.letters) if b != ord("\n")}
        self.inner = {t: i for t, i in self.vocab.items() if not t.endswith(end)}
        self.final = {t[: -len(end)]: i for t, i in self.vocab.items() if t.endswith(end)}
        self.length = {i: len(t) for t, i in self.inner.items()} | {i: len(t) for t, i in self.final.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, both = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rank.setdefault((left, right), r)
            self.parts.setdefault(both, (left, right, r))
        self.may: dict[tuple[int, int], bool] = {}
        self.right_edges: dict[int, list[tuple[int, int]]] = {}
        self.left_edges: dict[int, list[tuple[int, int]]] = {}
        #: Pieces met so far in words that aren't all lower-case letters -> ids.
        self.known: dict[str, list[int]] = {}
        self._automaton()

    def _automaton(self) -> None:
        """The vocabulary's trie. Of each state: the states after it by letter, that of its longest suffix in the trie, and the
        entries (id, length) that it ends with, longest first, for the inside and for the end of a word."""
        leaf: dict[str, int] = {}
        self.after, self.shorter = [{}], [0]
        depth = [0]
        own: list[dict[int, tuple[int, int]]] = [{}, {}]
        for kind, tokens in enumerate((self.inner, self.final)):
            for text, token in tokens.items():
                at = 0
                for letter in text:
                    if (to := self.after[at].get(letter)) is None:
                        to = len(self.after)
                        if self.after[at] is leaf:
                            self.after[at] = {}
                        self.after[at][letter] = to
                        self.after.append(leaf)
                        depth.append(depth[at] + 1)
                    at = to
                own[kind][at] = (token, len(text))
        self.shorter = [0] * len(depth)
        self.ends: list[list[tuple[tuple[int, int], ...]]] = [[()] * len(depth), [()] * len(depth)]
        level = [0]
        while level:
            for at in level:
                for letter, to in self.after[at].items():
                    self.shorter[to] = back = self._step(self.shorter[at], letter) if at else 0
                    for ends, found in zip(self.ends, own, strict=True):
                        ends[to] = (found[to], *ends[back]) if to in found else ends[back]
            level = [to for at in level for to in self.after[at].values()]

    def _step(self, state: int, letter: str) -> int:
        while (to := self.after[state].get(letter)) is None and state:
            state = self.shorter[state]
        return to or 0

    def _edges(self, token: int, side: int, known: dict[int, list[tuple[int, int]]]) -> list[tuple[int, int]]:
        """The symbols that are at this side of the token while it is built, each with the rank of the merge that uses it up."""
        if token not in known:
            found, now, used = [], token, NEVER
            while True:
                found.append((now, used))
                if now not in self.parts:
                    break
                used, now = self.parts[now][2], self.parts[now][side]
            known[token] = found
        return known[token]

    def follows(self, u: int, t: int) -> bool:
        """Whether t stays as it is right after u: no merge over their border comes first."""
        key = (u, t)
        if key not in self.may:
            ok = True
            for x, x_used in self._edges(u, 1, self.right_edges):
                for y, y_used in self._edges(t, 0, self.left_edges):
                    r = self.rank.get((x, y), NEVER)
                    # Of equal merges the left one comes first.
                    if r < x_used and r <= y_used and r != NEVER:
                        ok = False
            self.may[key] = ok
        return self.may[key]

    def encode_words(self, words: Iterable[str]) -> Iterator[list[int]]:
        """The ids of each of some sorted, distinct words, which are strings of byte letters."""
        if len(self.may) > PAIRS_KEPT:
            self.may.clear()
        after, shorter, inner, follows, may = self.after, self.shorter, self.ends[0], self.follows, self.may
        last, states, before = [-1], [0], ""
        for word in words:
            # Prefixes that the word before has too, but its whole, whose last token was not needed.
            shared, most = 0, min(len(last) - 1, len(word) - 1)
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], states[shared + 1 :]
            state, depth = states[-1], shared
            for letter in word[shared:-1]:
                depth += 1
                while (to := after[state].get(letter)) is None and state:
                    state = shorter[state]
                states.append(state := to or 0)
                found = -1
                for t, n in inner[state]:
                    if n == depth:
                        found = t
                        break
                    u = last[depth - n]
                    ok = may.get((u, t))
                    if ok or (ok is None and follows(u, t)):
                        found = t
                        break
                last.append(found)
            yield self._read_back(word, self._step(state, word[-1]), last)
            before = word

    def _last(self, state: int, depth: int, last: list[int]) -> int:
        """The last token of a prefix."""
        return next((t for t, n in self.ends[0][state] if n == depth or self.follows(last[depth - n], t)), -1)

    def _read_back(self, word: str, state: int, last: list[int]) -> list[int]:
        """A word's ids, by its end's state and the last tokens of its shorter prefixes."""
        ids, at = [], len(word)
        for t, n in self.ends[1][state]:
            if n == at or self.may.get((last[at - n], t)) or self.follows(last[at - n], t):
                ids.append(t)
                at -= n
                break
        else:
            # No entry is for the end of a word that ends so.
            ids.append(t := self._last(state, at, last))
            at -= self.length[t]
        while at:
            ids.append(last[at])
            at -= self.length[last[at]]
        return ids[::-1]

    def pieces_of(self, raw: str) -> list[str | int]:
        """What the tokenizer's normalizer and splitter make of a text: byte-letter strings, and ids of special tokens."""
        if raw.isascii():
            # The usual words: letters, and a comma or full stop after them.
            if raw.isalpha():
                return [raw.lower()]
            if raw[:-1].isalpha() and raw[-1] in ",.":
                return [raw[:-1].lower(), raw[-1]]
        parts: list[str | int] = []
        for k, part in enumerate(self.cut.split(raw) if self.cut and "<" in raw else [raw]):
            if k % 2:
                parts.append(self.special[part])
            elif part:
                parts += map(self.spell, self.split(part))
        return parts

    def split(self, part: str) -> list[str]:
        """Each letter is lower-cased by itself, so a final sigma isn't special."""
        return self.pieces.findall(part.lower() if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())

    def spell(self, piece: str) -> str:
        if piece.isascii():
            return piece if "\x7f" not in piece and min(piece) > " " else "".join(map(self.letters.__getitem__, piece.encode()))
        return "".join(map(self.letters.__getitem__, piece.encode()))

    def learn(self, raw: list[str]) -> list[list[str | int]]:
        """The pieces of each string; those that aren't known yet are encoded together."""
        if len(self.known) > PIECES_KEPT:
            self.known.clear()
        split = [self.pieces_of(text) for text in raw]
        new = sorted({p for parts in split for p in parts if isinstance(p, str)} - self.known.keys())
        self.known.update(zip(new, self.encode_words(new), strict=True))
        return split

    def encode_pieces(self, raw: list[str]) -> list[list[int]]:
        """The ids of each string."""
        return [[i for p in parts for i in (self.known[p] if isinstance(p, str) else (p,))] for parts in self.learn(raw)]

    def flat(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words in order, and how many each word has."""
        letters = [LOWER_LETTERS.fullmatch(w) is not None for w in words]
        plain, other = ([k for k, is_plain in enumerate(letters) if is_plain == kind] for kind in (True, False))
        table, rows = Ragged(), np.empty(len(words), np.int64)
        # Lower-case letters are one piece as they are, and a new line stays between words.
        spelled = "\n".join([words[k] for k in plain]).encode().decode("latin-1").translate(self.spelling).split("\n")
        order = sorted(range(len(plain)), key=spelled.__getitem__)
        rows[np.array(plain, np.int64)[order]] = np.arange(len(plain))
        for at in range(0, len(order), AT_ONCE):
            table.append(list(self.encode_words([spelled[k] for k in order[at : at + AT_ONCE]])))
        rows[other] = table.n + np.arange(len(other))
        for at in range(0, len(other), AT_ONCE):
            table.append(self.encode_pieces([words[k] for k in other[at : at + AT_ONCE]]))
        return table.gather(rows)

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.encode_pieces(split_words(text)) for i in ids]

    def decode(self, ids: list[int]) -> str:
        """As the tokenizers library decodes where the file names no decoder: tokens joined by one space."""
        return " ".join(self.text[i] for i in ids)


class _Encoded:
    """Ids of the words that one worker has met, as integers in one array; and each id's digits and token."""

    def __init__(self, bpe: TrieBpe) -> None:
        self.words, self.whole = CountedWords(bpe.flat, WORDS_KEPT), list(bpe.special)
        most = max(bpe.text) + 1
        self.digits = pa.array([str(i) for i in range(most)])
        self.tokens = pa.array([bpe.text.get(i, "") for i in range(most)])

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, and where each text's begin, with the end of the last."""
        words = lower_words(texts, self.whole)
        ids, lens = self.words.flat(pc.list_flatten(words))
        ends = np.cumsum(pc.list_value_length(words).to_numpy(), dtype=np.int64)
        return ids, np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)[np.concatenate([[0], ends])]

    def joined(self, ids: np.ndarray, starts: np.ndarray, of: pa.Array) -> pa.Array:
        """Each text's digits or tokens, joined by one space."""
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(starts, pa.int64()), of.take(pa.array(ids))), " ")


def worker_words(tokenizer_file: str) -> _Encoded:
    return worker_slot(("trie", tokenizer_file), lambda: _Encoded(TrieBpe(tokenizer_file)))


def encode_and_decode(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256); with texts, ids and decoded text themselves (ids, decoded) as well."""
    word_tokenizer(tokenizer_file)
    small_batches(docs.sparkSession)
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if texts:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = worker_words(tokenizer_file)
        ids, starts = known.flat(batch.column(1))
        digits, decoded = known.joined(ids, starts, known.digits), known.joined(ids, starts, known.tokens)
        digests = lambda x: pa.array([hashlib.sha256(t).hexdigest() for t in x.cast(pa.binary()).to_pylist()], pa.string())
        arrays = [batch.column(0), pa.array(np.diff(starts)), digests(digits), digests(decoded)]
        if texts:
            arrays += [pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids)), decoded]
        return pa.RecordBatch.from_arrays(arrays, [f.name for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(each, merged(by_bytes(batches, 1, CHUNK), 1, CHUNK))

    return two_columns(docs, id_col, text_col).mapInArrow(run, T.StructType(fields))
