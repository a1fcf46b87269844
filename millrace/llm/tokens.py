"""Token counts by section, from one encoding of each whole document.

The document is encoded once, so tokens are the same as a model would see. Each
token's span of characters follows from the byte lengths of the tokens before
it; sections are spans of characters, too. Joining the two lists of intervals
by position gives each token to the section that holds most of its characters,
the earlier one if two hold as many. So counts of sections add up to the
document's count, which encoding sections by themselves does not give.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, given_ids, table, tokenizer_dir
from .repeats import texts_of

VOCABULARY = "byte_bpe_50k.tiktoken"
#: How the vocabulary's texts are cut before merging; a fixed value that belongs to it.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Fixed value: white space as the pattern has it.
BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters that the encoder gets at once, and the longest run of white space that its pattern is given.
PIECE, RUN = 1_000_000, 20_000
BORDER = re.compile(rf"(?<=[^{BLANK}]) ")
LONG_RUN = re.compile(rf"[{BLANK}]{{{RUN},}}")


class Encoder:
    """Byte-level BPE with the spans of its tokens."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("millrace", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def pieces(self, text: str):
        """Cuts of a text at places where the pattern always ends a word: before a blank after something else."""
        at = 0
        while len(text) - at > PIECE:
            border = BORDER.search(text, at + PIECE)
            if border is None:
                break
            yield text[at : border.start()]
            at = border.start()
        yield text[at:]

    def ids(self, text: str) -> np.ndarray:
        """Tokens of a whole text, as `encode_ordinary` would give them.

        The pattern fails on very long runs of white space, so those are cut out
        as it would cut them: a run is one word, but for its last character if
        something follows.
        """
        if len(text) <= RUN:
            return np.array(self.encoding.encode_ordinary(text), dtype=np.int64)
        parts, at = [], 0
        for run in LONG_RUN.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            parts += [self.encoding.encode_ordinary(p) for p in self.pieces(text[at : run.start()])]
            parts.append(self.encoding._encode_single_piece(text[run.start() : end]))
            at = end
        parts += [self.encoding.encode_ordinary(p) for p in self.pieces(text[at:])]
        return np.concatenate([np.array(p, dtype=np.int64) for p in parts])

    def spans(self, text: str, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character of each token and the one after its last. Tokens inside one character share it."""
        ends = np.cumsum(self.lengths[self.ids(text)])
        if not len(ends):
            return ends, ends
        character = np.cumsum((data & 0xC0) != 0x80) - 1
        return character[np.concatenate(([0], ends[:-1]))], character[ends - 1] + 1


def sections(data: np.ndarray) -> np.ndarray:
    """Characters at which sections start: 0, after each line break, and after a stop and a blank."""
    character = np.cumsum((data & 0xC0) != 0x80)  # characters up to each byte
    stop = (data == 0x2E) | (data == 0x21) | (data == 0x3F)
    last = data == 0x0A
    last[1:] |= stop[:-1] & (data[1:] == 0x20)
    starts = character[np.flatnonzero(last)]
    if len(starts) and starts[-1] == character[-1]:
        starts = starts[:-1]
    return np.concatenate(([0], starts))


def attribute(first: np.ndarray, end: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, int]:
    """(tokens of each section, tokens that cross a border), by most characters, ties to the earlier."""
    left = np.searchsorted(starts, first, side="right") - 1
    right = np.searchsorted(starts, end - 1, side="right") - 1
    best, most = left.copy(), np.zeros(len(first), dtype=np.int64)
    borders = np.append(starts, np.iinfo(np.int64).max)
    across = np.flatnonzero(left != right)
    for k in range(int((right - left).max(initial=0)) + 1 if len(across) else 0):
        at = across[left[across] + k <= right[across]]
        s = left[at] + k
        share = np.minimum(end[at], borders[s + 1]) - np.maximum(first[at], borders[s])
        better = share > most[at]
        best[at[better]], most[at[better]] = s[better], share[better]
    return np.bincount(best, minlength=len(starts)), len(across)


def token_counts(df: DataFrame, directory: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per document: (doc_id, n_tokens, n_sections, n_crossing, section_tokens).

    Whole texts are encoded, very long ones in pieces cut where no token crosses,
    with the same tokens (memory: some 100 bytes a character of the longest
    text). Null and empty texts have no tokens and one section
    of none. Repeated rows and null ids: see `common`. An empty table gives an
    empty result.
    """
    path = os.path.join(directory or tokenizer_dir(), vocabulary)

    def count(batches):
        encoder = Encoder(path)
        for batch in batches:
            out = []
            for doc_id, data in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                text = data.tobytes().decode()
                starts = sections(data) if len(data) else np.zeros(1, np.int64)
                first, end = encoder.spans(text, data)
                counts, crossing = attribute(first, end, starts)
                out.append((doc_id, len(first), len(starts), crossing, counts))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            names = ["doc_id", "n_tokens", "n_sections", "n_crossing", "section_tokens"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    docs = documents(df)
    counted = docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_tokens long, n_sections long, n_crossing long, section_tokens array<long>")
    return given_ids(counted, docs)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
