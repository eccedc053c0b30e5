"""Runs of words as byte ranges: words joined by single spaces, and n-grams within rows."""

from __future__ import annotations

import numpy as np

from causeway.llm.tokens import Words


def respaced(w: Words, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(data, start, end): the words of a chunk one after the other with one space after each; words i to j are
    ``data[start[i]:end[j]]``. ``member``: the bytes that belong to words."""
    end = np.cumsum(w.end - w.start + 1) - 1
    start = end - (w.end - w.start)
    data = np.full(int(end[-1]) + 1 if len(end) else 0, 0x20, np.uint8)
    filled = np.ones(len(data), bool)
    filled[end] = False
    data[filled] = w.data[member[w.data]]
    return data, start, end


def grams_of(first: np.ndarray, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, last word, row) of the n-grams of each row, whose words are ``first[i]:first[i + 1]``.

    With ``short``, a row of fewer words, but not none, is one gram.
    """
    size = np.diff(first)
    count = np.maximum(size - n + 1, (size > 0).astype(size.dtype) if short else 0)
    row = np.repeat(np.arange(len(size)), count)
    at = first[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return at, np.minimum(at + n, first[1:][row]) - 1, row


def texts_at(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a binary column whose values are ``data[start:end]``."""
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)])
    return offsets, data[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])]
