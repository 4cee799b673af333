"""Token counts by offset-mapped attribution.

A whole document is encoded once. Token lengths in bytes give each token's character span, and an interval join of these
spans with the document's sections, both in order, gives each section its tokens. A section is a line with its line feed;
sections cover the text. A token that crosses a border goes by an explicit rule:

- `most`: to the section that holds most of its characters, the earlier one if equal;
- `first`: to the section that holds its first character;
- `share`: to each section by its share of the token's characters.

A character belongs to the token that holds its first byte; a token with no such character goes where the character it
continues is. Counts of a document's sections always add up to its tokens.

Defined results: null and empty texts have one empty section with 0 tokens; every row is kept, repeated or not; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from shelfmark.llm.frames import TEXT_ROWS, sliced, small_batches, two_columns, worker_slot

RULES = ("most", "first", "share")


def byte_encoder(ranks_file: str, pattern: str) -> tuple[Callable[[str], np.ndarray], np.ndarray]:
    """A function from text to ids, and the length in bytes of each id; made once for a worker."""
    return worker_slot(("bytes", ranks_file, pattern), lambda: _byte_encoder(ranks_file, pattern))


def _byte_encoder(ranks_file: str, pattern: str) -> tuple[Callable[[str], np.ndarray], np.ndarray]:
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    encoding = tiktoken.Encoding("shelfmark", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return (lambda text: np.array(encoding.encode_ordinary(text), np.int64)), lengths


def attribute(text: str, token_bytes: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, counts) of a text's sections in characters, given its tokens' lengths in bytes."""
    raw = np.frombuffer(text.encode(), np.uint8)
    begins = (raw & 0xC0) != 0x80
    char_of_byte = np.concatenate([[0], np.cumsum(begins)])  # characters that begin before each byte
    n = int(char_of_byte[-1])
    breaks = char_of_byte[np.flatnonzero(raw == 10)] + 1
    starts = np.concatenate([[0], breaks[breaks < n]]).astype(np.int64)
    ends = np.concatenate([starts[1:], [n]]).astype(np.int64)
    stops = np.cumsum(token_bytes)
    first, last = char_of_byte[stops - token_bytes], char_of_byte[stops]
    # A token of continuation bytes only stays with the character before.
    first = np.where(last > first, first, np.maximum(first - 1, 0))
    last = np.maximum(last, first + 1)
    low, high = np.searchsorted(starts, first, "right") - 1, np.searchsorted(starts, last - 1, "right") - 1
    counts = np.zeros(len(starts), np.float64)
    crossing = low != high
    np.add.at(counts, low[~crossing] if rule != "first" else low, 1)
    if rule != "first":
        for t in np.flatnonzero(crossing):
            parts = np.arange(low[t], high[t] + 1)
            held = np.minimum(ends[parts], last[t]) - np.maximum(starts[parts], first[t])
            if rule == "most":
                counts[parts[int(np.argmax(held))]] += 1
            else:
                counts[parts] += held / (last[t] - first[t])
    return starts, ends, counts


def section_tokens(docs: DataFrame, ranks_file: str, pattern: str, rule: str = "most", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, section, start_char, end_char, n_tokens, doc_tokens): a row for each section of each document."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}")
    small_batches(docs.sparkSession)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("section", "start_char", "end_char")), T.StructField("n_tokens", T.DoubleType() if rule == "share" else T.LongType()), T.StructField("doc_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, lengths = byte_encoder(ranks_file, pattern)
        for big in batches:
            for batch in sliced(big, TEXT_ROWS):
                rows, parts = [], []
                for k, text in enumerate(batch.column(1).to_pylist()):
                    ids = encode(text)
                    starts, ends, counts = attribute(text, lengths[ids], rule)
                    rows.append(np.full(len(starts), k))
                    parts.append((np.arange(len(starts)), starts, ends, counts, np.full(len(starts), len(ids))))
                section, start, end, count, total = (np.concatenate(x) for x in zip(*parts, strict=True))
                counted = count if rule == "share" else count.astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(rows))), *map(pa.array, (section, start, end, counted, total))], schema.fieldNames())

    return two_columns(docs, id_col, text_col).mapInArrow(run, schema)
