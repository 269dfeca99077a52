"""Statistics of whole texts, a slice of a batch at a time.

Words are runs of characters other than the six ASCII white-space characters.
A null text counts as empty, for which every statistic is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from shiftspark.llm.common import byte_slices

WINDOW_WORDS = 8
SLICE_BYTES = 8 << 20

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = [
    "log_words", "mean_word_chars", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "upper_share",
    "digit_share", "mark_share", "pipe_share", "bang_share", "words_a_line", "stop_share", "space_share",
]

_SPACE, _SYMBOLS = list(b"\t\n\x0b\x0c\r "), list(b"#*$%&|<>")
_UPPER, _LOWER, _DIGIT, _MARK = list(range(65, 91)), list(range(97, 123)), list(range(48, 58)), list(b".,;:!?\"'()-")
_FOLLOWS = list(range(0x80, 0xC0))  # bytes within a code point
_MULTIPLIERS = np.random.default_rng(20_240_701).integers(1, 2**63, WINDOW_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _repeat_words(codes: np.ndarray) -> int:
    """Words inside windows of WINDOW_WORDS that a text holds twice or more."""
    n = len(codes) - WINDOW_WORDS + 1
    if n < 2:
        return 0
    c = codes.astype(np.uint64)
    h = c[:n] * _MULTIPLIERS[0]
    for k in range(1, WINDOW_WORDS):
        h += c[k : k + n] * _MULTIPLIERS[k]
    s = np.sort(h)
    if (s[1:] != s[:-1]).all():  # windows of different hashes differ
        return 0
    # exact: number pairs, then fours, then eights of words
    ids, step = codes, 1
    while step < WINDOW_WORDS:
        pair = ids[:-step].astype(np.int64) * (int(ids.max()) + 1) + ids[step:]
        ids, step = np.unique(pair, return_inverse=True)[1], 2 * step
    starts = np.bincount(ids)[ids] > 1
    edge = np.zeros(len(codes) + 1, np.int64)
    at = np.flatnonzero(starts)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW_WORDS, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def _lines(text: str) -> tuple[int, int]:
    """(lines with a word, those that equal an earlier one)"""
    lines = [x for x in text.split("\n") if x.strip("\t\x0b\x0c\r ")]
    return len(lines), len(lines) - len(set(lines))


def of_texts(texts: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS (int64) and RATIOS (float64) of each text."""
    n = len(texts)
    raw = pc.fill_null(texts, "").cast(pa.string())
    lists = pc.ascii_split_whitespace(raw)
    encoded = lists.flatten().dictionary_encode()
    dictionary, index = encoded.dictionary, np.asarray(encoded.indices)
    blank = np.flatnonzero(np.asarray(pc.equal(dictionary, ""))) if len(dictionary) else []
    ends = np.asarray(lists.offsets).astype(np.int64)
    ends = ends - ends[0]
    if len(blank):
        keep = index != blank[0]
        kept = np.concatenate(([0], np.cumsum(keep)))
        index, ends = index[keep], kept[ends]
    histogram = np.zeros((n, 256), np.int64)
    lines, twice, repeats, distinct = (np.zeros(n, np.int64) for _ in range(4))
    for i, text in enumerate(raw.to_pylist()):
        histogram[i] = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
        codes = index[ends[i] : ends[i + 1]]
        lines[i], twice[i] = _lines(text)
        distinct[i] = len(np.unique(codes))
        if distinct[i] < len(codes):
            repeats[i] = _repeat_words(codes)
    words = np.diff(ends)
    total = lambda chars: histogram[:, chars].sum(axis=1)
    points, space = histogram.sum(axis=1) - total(_FOLLOWS), total(_SPACE)
    chars, symbols, upper, lower = points - space, total(_SYMBOLS), total(_UPPER), total(_LOWER)
    share = lambda a, b: a / np.maximum(b, 1)
    return {
        "n_words": words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": twice, "n_repeat_words": repeats,
        "log_words": np.log1p(words), "mean_word_chars": share(chars, words), "symbol_share": share(symbols, chars),
        "dup_line_share": share(twice, lines), "repeat_share": share(repeats, words), "distinct_share": share(distinct, words),
        "upper_share": share(upper, upper + lower), "digit_share": share(total(_DIGIT), chars), "mark_share": share(total(_MARK), chars),
        "pipe_share": share(histogram[:, ord("|")], words), "bang_share": share(histogram[:, ord("!")], words), "words_a_line": np.log1p(share(words, lines)),
        "stop_share": share(histogram[:, ord(".")], words), "space_share": share(space, points),
    }


def slices(batch: pa.RecordBatch, text: int = 1) -> Iterator[tuple[int, int, dict[str, np.ndarray]]]:
    """(first, count, statistics) over a batch whose column ``text`` holds the texts."""
    for first, n in byte_slices(batch.column(text), SLICE_BYTES):
        yield first, n, of_texts(batch.column(text).slice(first, n))


def matrix(stats: dict[str, np.ndarray]) -> np.ndarray:
    return np.column_stack([stats[k] for k in RATIOS]).astype(np.float64)
