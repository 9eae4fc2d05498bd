"""Splitting oversized items at natural boundaries by lexical cohesion (p10).

The text of an item is cut into sentences; between two sentences the words of
the block before and of the block after are compared. Where their similarity
has a valley the topic changes. Of the boundaries a piece can end at, the one
with the deepest valley is taken; without a sentence boundary in reach the
piece ends at a word, without a word at a character. The next piece begins so
many tokens before the end of the last as the overlap asks for.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peneira.llm.tokens import TOKENIZER, encoder, shipped


@dataclass(frozen=True)
class Limits:
    """size: most tokens of a piece; overlap: tokens two pieces share; block: sentences on each side of a boundary;
    window: a piece ends in the last part of its room, from this share of the size on, if there is a boundary."""

    size: int = 1024
    overlap: int = 64
    block: int = 4
    window: float = 0.5


_SENTENCE = re.compile(r"(?:[.!?…]+[\"'”’)\]]*(?=\s|<|$)|</(?:p|li|ul|ol|div|h[1-6]|tr|table)\s*>|<br\s*/?>|\n+)")
_WORD = re.compile(r"[^\W_]+")


def _sentence_starts(text: str) -> list[int]:
    """Positions at which a sentence begins, the first not among them."""
    return sorted({m.end() for m in _SENTENCE.finditer(text) if 0 < m.end() < len(text)})


def valleys(text: str, starts: list[int], block: int) -> np.ndarray:
    """The depth of the valley of block similarity at each sentence boundary."""
    edges = [0, *starts, len(text)]
    known: dict[str, int] = {}
    rows = [[known.setdefault(w, len(known)) for w in _WORD.findall(text[a:b].casefold())] for a, b in zip(edges, edges[1:])]
    n = len(starts)
    similar = np.zeros(n)
    left, right = [0] * len(known), [0] * len(known)
    dot = left_norm = right_norm = 0

    # The bags, their product and their norms change by a few sentences from boundary to boundary.
    for words in rows[1 : 1 + block]:
        for w in words:
            right_norm += 2 * right[w] + 1
            right[w] += 1
    for i in range(n):
        for w in rows[i]:  # into the left bag, out of the right one
            left_norm += 2 * left[w] + 1
            left[w] += 1
            dot += right[w]
            if i:
                right_norm -= 2 * right[w] - 1
                right[w] -= 1
                dot -= left[w]
        if i >= block:
            for w in rows[i - block]:
                left_norm -= 2 * left[w] - 1
                left[w] -= 1
                dot -= right[w]
        if i and i + block < len(rows):
            for w in rows[i + block]:
                right_norm += 2 * right[w] + 1
                right[w] += 1
                dot += left[w]
        similar[i] = dot / (left_norm * right_norm) ** 0.5 if left_norm and right_norm else 0.0
    if not n:
        return similar
    # The hills to either side: as far as the similarity doesn't fall.
    hill_left, hill_right = similar.copy(), similar.copy()
    for i in range(1, n):
        hill_left[i] = hill_left[i - 1] if similar[i - 1] >= similar[i] else similar[i]
        hill_right[n - 1 - i] = hill_right[n - i] if similar[n - i] >= similar[n - 1 - i] else similar[n - 1 - i]
    return hill_left + hill_right - 2 * similar


def split(text: str, limits: Limits = Limits(), path: str = TOKENIZER) -> list[tuple[int, int, int, str]]:
    """Pieces (first character, end, tokens, kind of the cut at the end) of a text; one piece if it is within the size.

    Consecutive pieces share the overlap in tokens of the whole text, or a
    little more where a token is cut or that many begin within a character. A
    piece has at most the size in tokens, encoded by itself. Every character
    is in a piece.
    """
    enc = encoder(path)
    octets = len(text.encode())
    tokens = enc.encode_ordinary(text) if octets > limits.size else []
    if len(tokens) <= limits.size:
        return [(0, len(text), len(tokens) if tokens else len(enc.encode_ordinary(text)), "end")]
    parts = enc.decode_tokens_bytes(tokens)
    n = len(tokens)
    at = np.concatenate([[0], np.cumsum([len(b) for b in parts])])
    raw = np.frombuffer(text.encode(), np.uint8)
    begun = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    char_at = begun[at]  # characters begun before each token
    whole = (np.append(raw, 0)[at] & 0xC0) != 0x80  # tokens that begin with a character
    # Where the pre-tokenizer surely begins anew: tokens on either side are the same whatever lies on the other.
    safe = [i for i in range(1, n) if parts[i][:1].isspace() and not parts[i - 1][-1:].isspace()]
    starts = _sentence_starts(text)
    depth = valleys(text, starts, limits.block)
    reach = np.searchsorted(char_at, starts).tolist()  # tokens begun before each boundary
    words = [m.end() for m in re.finditer(r"\S(?=\s)", text)]

    def own(begin: int, end: int, stop: int) -> int:
        """Tokens of a piece encoded by itself: only its ends can differ from the whole."""
        i, j = bisect_left(safe, begin), bisect_left(safe, end) - 1
        if j <= i:
            return len(enc.encode_ordinary(text[char_at[begin] : stop]))
        head, tail = safe[i], safe[j]
        first = len(enc.encode_ordinary(text[char_at[begin] : char_at[head]])) if head > begin else 0
        return first + tail - head + len(enc.encode_ordinary(text[char_at[tail] : stop]))

    out, begin = [], 0
    while True:
        room = limits.size
        while True:
            if n - begin <= room:
                end, kind, stop = n, "end", len(text)
            else:
                end, kind, stop = _cut(begin, begin + room, limits, reach, starts, depth, words, char_at, whole)
            size = own(begin, end, stop)
            if size <= limits.size:
                break
            room -= size - limits.size
        out.append((int(char_at[begin]), int(stop), size, kind))
        if end == n:
            return out
        back = end - limits.overlap - int(char_at[end] > stop)
        while back > begin and not whole[back]:
            back -= 1
        begin = max(back, begin + 1)
        while not whole[begin]:
            begin += 1


def _cut(begin: int, most: int, limits: Limits, reach: list[int], starts: list[int], depth: np.ndarray, words: list[int], char_at: np.ndarray, whole: np.ndarray) -> tuple[int, str, int]:
    """(tokens begun before the cut, kind, character) of the end of a piece that begins at a token and ends at most at
    another: the deepest valley in the window, else the last sentence, word or character in reach."""
    least = begin + max(limits.overlap + 2, int((most - begin) * limits.window))
    low, high = bisect_left(reach, least), bisect_right(reach, most)
    if low < high:
        best = max(range(low, high), key=lambda i: (depth[i], i))
        return reach[best], "sentence", starts[best]
    earlier = bisect_left(reach, begin + limits.overlap + 2)
    if earlier < low:
        return reach[low - 1], "sentence", starts[low - 1]
    last = bisect_right(words, int(char_at[most])) - 1
    if last >= 0:
        end = int(np.searchsorted(char_at, words[last]))
        if begin + limits.overlap + 2 <= end <= most:
            return end, "word", words[last]
    while most > begin + 1 and not whole[most]:
        most -= 1
    return most, "character", int(char_at[most])


def pieces(rows: DataFrame, doc_id: str, text: str, limits: Limits = Limits(), path: str = TOKENIZER) -> DataFrame:
    """(doc_id, piece, first, end, tokens, cut, text) of every document of more than the limit's tokens.

    Documents within the limit, nulls and empty texts give no row: they need no
    cutting. A text of at most so many bytes as the limit has tokens is within
    it, since a token has at least a byte; it isn't encoded. Whole texts of any
    length are read; repeated rows give their pieces again; other columns are
    not read. One scan, no shuffle.
    """
    shipped(rows.sparkSession, path)
    own = rows.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text_")).where(F.octet_length("text_") > limits.size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                whole = batch.column("text_")[i].as_py()
                cut = split(whole, limits, path)
                if len(cut) > 1:
                    first, end, tokens, kind = zip(*cut)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch.column("doc_id")[i].as_py()] * len(cut), pa.int64()), pa.array(range(len(cut)), pa.int32()), pa.array(first, pa.int64()), pa.array(end, pa.int64()), pa.array(tokens, pa.int64()), pa.array(kind), pa.array([whole[a:b] for a, b in zip(first, end)])],
                        ["doc_id", "piece", "first", "end", "tokens", "cut", "text"],
                    )

    return own.mapInArrow(run, "doc_id bigint, piece int, first bigint, end bigint, tokens bigint, cut string, text string")
