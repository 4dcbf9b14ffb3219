"""Hashed n-grams of many texts at once, in numpy: whole texts, a bounded number of characters a step."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Characters that are worked on at once; a longer text is a step of its own.
STEP = 1 << 19
#: Classes of code points: other, white space, upper, lower, digit; punctuation stands for itself.
OTHER, SPACE, UPPER, LOWER, DIGIT = 0, 1, 2, 3, 4
#: Unicode's category L.
LETTER = np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)
_M = np.uint64(0x9E3779B97F4A7C15)
_POWERS = [np.ones(1, np.uint64)]


def _classes() -> np.ndarray:
    out = np.zeros(1 << 16, np.uint8)
    for i in range(1 << 16):
        c = chr(i)
        if c.isspace() or i == 0:
            out[i] = SPACE
        elif c.isupper():
            out[i] = UPPER
        elif c.isalpha():
            out[i] = LOWER
        elif c.isdigit():
            out[i] = DIGIT
        elif 32 < i < 127:
            out[i] = i
    return out


CLASS = _classes()


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd multiplier, modulo 2**64."""
    if len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            _POWERS[0] = np.cumprod(np.concatenate(([np.uint64(1)], np.full(2 * n, _M, np.uint64))), dtype=np.uint64)
    return _POWERS[0][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A finisher for 64-bit hashes."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def steps(texts: list[str | None]) -> Iterator[list[str]]:
    """texts (null: empty) in order, in lists of about STEP characters."""
    part, size = [], 0
    for text in texts:
        text = text or ""
        if part and size + len(text) > STEP:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text) + 1
    if part:
        yield part


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by a line break, and where each text starts."""
    starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    return codes, starts


def looked_up(table: np.ndarray, codes: np.ndarray, above) -> np.ndarray:
    """table[codes], or `above` beyond the table."""
    return np.where(codes < len(table), table[np.minimum(codes, len(table) - 1)], above)


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


def run_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int | None = None) -> np.ndarray:
    """A hash of each run's code points, or of its first `most`."""
    if not len(starts):
        return np.empty(0, np.uint64)
    stop = ends if most is None else np.minimum(ends, starts + most)
    lens = stop - starts
    first = np.concatenate(([0], np.cumsum(lens)[:-1]))
    offset = np.arange(lens.sum()) - np.repeat(first, lens)
    terms = codes[np.repeat(starts, lens) + offset].astype(np.uint64) * powers(int(lens.max()))[offset]
    return mixed(np.add.reduceat(terms, first) + lens.astype(np.uint64))


def text_of(starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The number of the text that each position lies in."""
    return np.searchsorted(starts, at, "right") - 1


def terms(texts: list[str], prefix: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every word (run of letters, lower-cased) and of the first `prefix`
    letters of every longer one. Repeats are kept; sorted by text."""
    codes, starts = points([t.lower() for t in texts])
    a, b = runs(LETTER[codes])
    if not len(a):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    text, whole = text_of(starts, a), run_hashes(codes, a, b)
    stem = run_hashes(codes, a, b, prefix) ^ np.uint64(0x5DEECE66D)
    keep = b - a > prefix
    return np.concatenate([text, text[keep]]), np.concatenate([whole, stem[keep]])


def quality_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of word n-grams: words and pairs of words (lower-cased), and 1 to 3-grams
    of word shapes. A shape has the runs of character classes (upper, lower, digit, other, each
    punctuation mark) and whether the word repeats the one before it."""
    codes, starts = points(texts)
    kinds = looked_up(CLASS, codes, OTHER)
    a, b = runs(kinds != SPACE)
    if not len(a):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    text = text_of(starts, a)
    lower, low_starts = points([t.lower() for t in texts])
    if len(lower) == len(codes):
        words = run_hashes(lower, a, b)
    else:  # lower-casing changed a length: runs are found anew, or kept as they are where they differ
        c, d = runs(looked_up(CLASS, lower, OTHER) != SPACE)
        words = run_hashes(lower, c, d) if len(c) == len(a) else run_hashes(codes, a, b)
    turn = np.concatenate(([True], kinds[1:] != kinds[:-1]))
    turn[a] = True
    at = np.flatnonzero(turn & (kinds != SPACE))
    first = np.searchsorted(at, a)
    shapes = run_hashes(kinds[at], first, np.concatenate((first[1:], [len(at)])))
    same = np.zeros(len(a), bool)
    same[1:] = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
    shapes = mixed(shapes * np.uint64(2) + same.astype(np.uint64))
    out_text, out = [text, text], [words, shapes ^ np.uint64(0xA5A5)]
    pair = text[1:] == text[:-1]
    out_text.append(text[1:][pair])
    out.append(mixed(words[:-1] * np.uint64(3) + words[1:])[pair])
    two = mixed(shapes[:-1] * np.uint64(5) + shapes[1:])
    out_text.append(text[1:][pair])
    out.append(two[pair])
    three = mixed(two[:-1] * np.uint64(7) + shapes[2:])
    triple = text[2:] == text[:-2]
    out_text.append(text[2:][triple])
    out.append(three[triple])
    return np.concatenate(out_text), np.concatenate(out)


def distinct(text: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text, id) pairs, by text. ids below 2**32, texts of a step below 2**31."""
    both = np.unique((text.astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64))
    return (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def by_batch(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches (without copies) with their texts, in steps of about STEP characters."""
    for batch in batches:
        at = 0
        for part in steps(batch.column(column).to_pylist()):
            yield batch.slice(at, len(part)), part
            at += len(part)
