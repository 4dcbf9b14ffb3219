"""SentencePiece encoding and decoding with seeded merge-dropout.

Pieces are joined as in byte-pair encoding, best score first, but each candidate merge that the
agenda brings up may be skipped by a keyed hash. So one text has many segmentations, the same for the
same seed on every run and partitioning, and every one of them decodes to the text exactly.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kind_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: No merge crosses the front of a run of blanks or a line break (checked when a model is loaded).
UNIT = re.compile(r"\n| +[^ \n]*|[^ \n]+")
#: Longer units aren't remembered. When the remembered runs take so many bytes, all are forgotten.
LONGEST, REMEMBERED = 24, 64 << 20
#: Longer units are worked on one by one. The place of a pair that is no piece.
ABREAST, NEVER = 32, 1 << 30
#: Characters of texts that are encoded together.
STEP = 1 << 20
GOLDEN, PLACE = 0x9E3779B97F4A7C15, (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


class Vocabulary:
    """Pieces of a byte-fallback BPE model: their merge scores, ids and bytes.

    A blank stands as U+2581 in pieces; that character itself in a text is spelled in bytes, which
    keeps decoding exact.
    """

    def __init__(self, pieces: list[tuple[str, float]], byte_ids: list[int], skipped: set[int]):
        self.byte_ids = byte_ids
        spelled = {i: bytes([b]) for b, i in enumerate(byte_ids)}
        self.bytes = [spelled.get(i, b"" if i in skipped else p.replace(MARK, " ").encode()) for i, (p, _) in enumerate(pieces)]
        # As in the texts: blanks, no marks.
        self.ids = {p.replace(MARK, " "): i for i, (p, _) in enumerate(pieces) if i not in skipped and i not in spelled}
        self.scores = [s for _, s in pieces]
        # A merge's place in the agenda: pieces by falling score.
        places = {x: k for k, x in enumerate(sorted({-self.scores[i] for i in self.ids.values()}))}
        self.order = {p: places[-self.scores[i]] for p, i in self.ids.items()}
        self.single = {p: i for p, i in self.ids.items() if len(p) == 1}
        self.letters = frozenset(self.single)
        self.letter_ids = np.zeros(1 + max(map(ord, self.single), default=0), np.int32)
        self.letter_ids[[ord(c) for c in self.single]] = list(self.single.values())
        pairs = sorted(
            ((self.ids[p[:k]] << 16) | self.ids[p[k:]], self.order[p], i)
            for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids
        )
        self.pairs, self.pair_order, self.pair_id = (np.array([x[c] for x in pairs] or [-1], np.int64) for c in range(3))
        wide = [p for p in self.ids if "\n" in p or " " in p.lstrip(" ")]
        if wide or len(pieces) > 1 << 16:
            raise ValueError(f"pieces across blanks or line breaks, or over 65536 pieces: {wide[:3]}")
        self.runs = _Runs()

    def __getstate__(self) -> dict:
        """Without the remembered runs: each task's copy gathers its own, and they go with it."""
        return {**self.__dict__, "runs": _Runs()}

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        skipped = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        return cls([(sp.id_to_piece(i), sp.get_score(i)) for i in range(n)], byte_ids, skipped)

    def segment(self, unit: str, dropout: float = 0.0, key: int = 0) -> bytes:
        """unit's piece ids, two bytes each. Candidate merges wait in an agenda by score, then from the
        left; one that comes up is skipped for good if the hash of key, place and piece falls below dropout."""
        ids, known = array("H"), self.ids
        for s in self._heaped(unit, int(dropout * (1 << 32)), key):
            at = known.get(s)
            if at is None:
                ids.extend([self.byte_ids[b] for b in s.encode()])
            else:
                ids.append(at)
        return ids.tobytes()

    def segment_all(self, units: list[str], dropout: float, keys: list[int]) -> list[bytes]:
        """segment() of many units. Short units of known characters go side by side as rows of arrays:
        each turn takes every row's next candidate from its agenda."""
        out: list[bytes] = [b""] * len(units)
        rows, single = self._by_width(units)
        for k in single:
            out[k] = self.segment(units[k], dropout, keys[k])
        for width, which in rows.items():
            for at in range(0, len(which), 1 << 14):
                part = which[at : at + (1 << 14)]
                ids, lens = self._abreast([units[k] for k in part], width, int(dropout * (1 << 32)), np.array([keys[k] for k in part], np.uint64))
                data, ends = ids.tobytes(), np.cumsum(lens) * 2
                for k, a, b in zip(part, (ends - lens * 2).tolist(), ends.tolist(), strict=True):
                    out[k] = data[a:b]
        return out

    def _by_width(self, units: list[str]) -> tuple[dict[int, list[int]], list[int]]:
        """Numbers of the units that can go side by side, by row width, and of the others."""
        lens = np.fromiter(map(len, units), np.int64, len(units))
        fits = lens <= ABREAST
        if not self.letters.issuperset("".join(units)):
            fits &= np.fromiter(map(self.letters.issuperset, units), bool, len(units))
        width = np.where(fits, -(-lens // 4) * 4, -1)
        return {w: np.flatnonzero(width == w).tolist() for w in np.unique(width).tolist() if w >= 0}, np.flatnonzero(~fits).tolist()

    def _joined(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Agenda places and ids of the pieces that pairs of pieces make; NEVER where they make none."""
        pair = (a.astype(np.int64) << 16) | b
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        hit = self.pairs[at] == pair
        return np.where(hit, self.pair_order[at], NEVER), self.pair_id[at]

    def _abreast(self, units: list[str], width: int, limit: int, keys: np.ndarray, seen: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another, and how many each row has. seen gets (rows, their candidates) of
        every turn."""
        n = len(units)
        lens = np.fromiter(map(len, units), np.int64, n)
        inside = np.arange(width + 1)[None, :] < lens[:, None]
        ids = np.zeros((n, width + 1), np.int32)
        ids[inside] = self.letter_ids[np.frombuffer("".join(units).encode("utf-32-le"), "<u4")]
        after = np.tile(np.arange(1, width + 2, dtype=np.int32), (n, 1))
        before = np.tile(np.arange(-1, width, dtype=np.int32), (n, 1))
        order, makes = np.full((n, width + 1), NEVER, np.int32), np.zeros((n, width + 1), np.int32)
        r, j = np.nonzero(inside[:, 1:])
        order[r, j], makes[r, j] = self._joined(ids[r, j], ids[r, j + 1])
        open_ = np.arange(n)
        while len(open_):
            left = order[open_].argmin(1)
            best = order[open_, left]
            going = best < NEVER
            open_, left, best = open_[going], left[going], best[going]
            right = after[open_, left]
            if seen is not None:
                seen.append((open_, _places(left, right, best)))
            if limit:
                skip = _keyed_all(keys[open_], left, right, best) < limit
                order[open_[skip], left[skip]] = NEVER
                take = ~skip
            else:
                take = np.ones(len(open_), bool)
            r, i, k = open_[take], left[take], right[take]
            ids[r, i] = makes[r, i]
            inside[r, k] = False
            order[r, k] = order[r, i] = NEVER
            nxt = after[r, k]
            after[r, i] = nxt
            there = nxt < lens[r]
            x, y, z = r[there], i[there], nxt[there]
            before[x, z] = y
            order[x, y], makes[x, y] = self._joined(ids[x, y], ids[x, z])
            prev = before[r, i]
            there = prev >= 0
            x, y, z = r[there], prev[there], i[there]
            order[x, y], makes[x, y] = self._joined(ids[x, y], ids[x, z])
        return ids[inside].astype(np.uint16), inside.sum(1)

    def _heaped(self, unit: str, limit: int, key: int, seen: list | None = None) -> list[str]:
        of, symbols, n = self.order.get, list(unit), len(unit)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(order, i, i + 1, unit[i : i + 2]) for i in range(n - 1) if (order := of(unit[i : i + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            order, left, right, pair = heapq.heappop(agenda)
            # A stale candidate: one side was merged away or has grown since.
            if after[left] != right or symbols[left] + symbols[right] != pair or not symbols[left]:
                continue
            if seen is not None:
                seen.append((left, right, order))
            if limit and _keyed_int(key, left, right, order) < limit:
                continue
            symbols[left], symbols[right] = pair, ""
            after[left] = nxt = after[right]
            after[right] = -1
            if nxt < n:
                before[nxt] = left
                wider = pair + symbols[nxt]
                if (order := of(wider)) is not None:
                    heapq.heappush(agenda, (order, left, nxt, wider))
            prev = before[left]
            if prev >= 0:
                wider = symbols[prev] + pair
                if (order := of(wider)) is not None:
                    heapq.heappush(agenda, (order, prev, left, wider))
        return [s for s in symbols if s]

    def encode_all(self, texts: list[str], keys: list[int], dropout: float = 0.0, seed: int = 0, copies: list[int] | None = None) -> list[np.ndarray]:
        """Piece ids of whole texts (uint16), each behind one blank, as the model expects, and none for
        an empty text.

        Every unit has a key of its own, from seed, the text's key and copy number, and the unit's number,
        and is segmented as by segment() with that key. Remembered are only runs without a skip, with the
        candidates they bring up; a key that skips none of these takes such a run as it is, all others are
        worked out side by side.
        """
        limit = int(dropout * (1 << 32))
        if self.runs.size >= REMEMBERED:
            self.runs = _Runs()
        runs = self.runs
        units, drawn, ends = [], [], [0]
        for text, key, copy in zip(texts, keys, copies or [0] * len(texts), strict=True):
            some = UNIT.findall(" " + text) if text else []
            units += some
            ends.append(len(units))
            if limit and some:
                start = _keyed_int(_keyed_int(seed, copy, 0, 0, 64), key, 1, 0, 64)
                h = np.arange(len(some), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(start)
                h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                drawn.append(h ^ (h >> np.uint64(29)))
        runs.add(self, [u for u in dict.fromkeys(units) if u not in runs.roots and len(u) <= LONGEST])
        node = np.fromiter(map(runs.roots.get, units, repeat(-1)), np.int64, len(units))
        alone = np.flatnonzero(node < 0)
        if limit and units:
            key = np.concatenate(drawn)
            open_ = np.flatnonzero(node >= 0)
            first = runs.first_skip(node[open_], key[open_], limit)
            alone = np.concatenate((alone, open_[first >= 0]))
            keyed = key[alone].tolist()
        else:
            keyed = [0] * len(alone)
        ids = runs.ids or [b""]
        found = list(map(ids.__getitem__, node.tolist()))  # -1: anything, replaced below
        for k, one in zip(alone.tolist(), self.segment_all([units[k] for k in alone.tolist()], dropout, keyed), strict=True):
            found[k] = one
        return [np.frombuffer(b"".join(found[a:b]), np.uint16) for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def encode(self, text: str, dropout: float = 0.0, seed: int = 0, key: int = 0) -> np.ndarray:
        return self.encode_all([text], [key], dropout, seed)[0]

    def decode(self, ids: list[int]) -> str:
        """The text of ids. Control pieces spell nothing; bytes that aren't UTF-8 become U+FFFD, which
        no encoding of a text leads to."""
        table = self.bytes
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace").removeprefix(" ")


class _Runs:
    """Remembered runs over units without a skip: their ids, and the candidates that came up."""

    def __init__(self):
        self.roots: dict[str, int] = {}
        self.ids: list[bytes] = []
        self.begin, self.ends, self.places = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        #: Bytes, about: texts and ids, their objects, entries of dictionaries and lists, places.
        self.size = 0

    def add(self, words: Vocabulary, units: list[str]) -> None:
        if not units:
            return
        ids: list[bytes] = [b""] * len(units)
        places: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(units)
        rows, single = words._by_width(units)
        for k in single:
            out, seen = array("H"), []
            for s in words._heaped(units[k], 0, 0, seen):
                one = words.ids.get(s)
                out.extend([words.byte_ids[b] for b in s.encode()] if one is None else [one])
            ids[k] = out.tobytes()
            places[k] = _places(*np.array(seen or np.zeros((0, 3)), np.int64).T)
        for width, which in rows.items():
            for at in range(0, len(which), 1 << 14):
                part, turns = which[at : at + (1 << 14)], []
                found, lens = words._abreast([units[k] for k in part], width, 0, np.zeros(0), turns)
                data, ends = found.tobytes(), np.cumsum(lens) * 2
                row = np.concatenate([r for r, _ in turns] or [np.zeros(0, np.int64)])
                came = np.concatenate([x for _, x in turns] or [np.zeros(0, np.uint64)])[np.argsort(row, kind="stable")]
                upto = np.cumsum(np.bincount(row, minlength=len(part)))
                for k, a, b, c, d in zip(part, (ends - lens * 2).tolist(), ends.tolist(), [0, *upto.tolist()], upto.tolist(), strict=False):
                    ids[k], places[k] = data[a:b], came[c:d]
        self.roots.update(zip(units, range(len(self.ids), len(self.ids) + len(units)), strict=True))
        self.ids += ids
        lens = np.fromiter(map(len, places), np.int64, len(places))
        ends = np.cumsum(lens) + len(self.places)
        self.begin = np.concatenate((self.begin, ends - lens))
        self.ends = np.concatenate((self.ends, ends))
        self.places = np.concatenate([self.places, *places])
        self.size += sum(map(len, units)) + sum(map(len, ids)) + 8 * int(lens.sum()) + 200 * len(units)

    def first_skip(self, runs: np.ndarray, keys: np.ndarray, limit: int) -> np.ndarray:
        """Of each run, the number of the first candidate that its key skips, or -1."""
        lens = self.ends[runs] - self.begin[runs]
        row = np.repeat(np.arange(len(runs)), lens)
        number = np.arange(len(row)) - np.repeat(np.cumsum(lens) - lens, lens)
        hit = np.flatnonzero(_mixed(keys[row] * np.uint64(GOLDEN) ^ self.places[self.begin[runs][row] + number]) < limit)
        out = np.full(len(runs), -1, np.int64)
        out[row[hit][::-1]] = number[hit][::-1]
        return out


def _places(left: np.ndarray, right: np.ndarray, order: np.ndarray) -> np.ndarray:
    h = np.zeros(len(left), np.uint64)
    for x, by in zip((left, right, order), PLACE, strict=True):
        h = h ^ (x.astype(np.uint64) * np.uint64(by))
    return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))) & np.uint64(0xFFFFFFFF)


def _keyed_all(key: np.ndarray, left: np.ndarray, right: np.ndarray, order: np.ndarray) -> np.ndarray:
    """32 bits that depend on all arguments, which are whole numbers."""
    return _mixed(key.astype(np.uint64) * np.uint64(GOLDEN) ^ _places(left, right, order))


def _keyed_int(key: int, left: int, right: int, order: int, bits: int = 32) -> int:
    """The same of single numbers, or up to 64 bits."""
    h = (key * GOLDEN ^ left * PLACE[0] ^ right * PLACE[1] ^ order * PLACE[2]) & ((1 << 64) - 1)
    h = (h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 & ((1 << 64) - 1)
    return (h ^ (h >> 32)) & ((1 << bits) - 1)


def copy_numbers(docs: DataFrame) -> DataFrame:
    """docs with column copy: 0, 1, ... of rows with the same doc_id and text."""
    same = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id")
    return docs.withColumn("copy", F.row_number().over(same) - 1)


def steps(rows: Iterator[tuple], size: int = STEP) -> Iterator[list[tuple]]:
    """Rows (doc_id, text or None, ...) in lists of about `size` characters."""
    part, chars = [], 0
    for row in rows:
        part.append(row)
        chars += len(row[1] or "") + 1
        if chars >= size:
            yield part
            part, chars = [], 0
    if part:
        yield part


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, key): key is a whole-number id itself (a null one 0), of other ids a hash."""
    whole = kind_of(docs, "doc_id") in ("tinyint", "smallint", "int", "bigint")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(0)) if whole else F.xxhash64("doc_id")
    return docs.select("doc_id", "text", key.alias("key"))


def encode(docs: DataFrame, vocabulary: Vocabulary, dropout: float = 0.1, seed: int = 1, vary_copies: bool = False) -> DataFrame:
    """(doc_id, ids): the pieces of every whole text. A null text has null ids, an empty one none.

    The segmentation depends on the text, doc_id and seed alone: repeated rows give repeated rows. With
    vary_copies it depends on the number of the copy too, so they are segmented each in its way. A
    null doc_id counts as 0. Other columns of docs are ignored. dropout 0 gives the model's own
    segmentation, 1 single characters. The vocabulary (at most 65536 pieces) goes by broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            for part in steps(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                ids = words.encode_all([t or "" for _, t, *_ in part], [k % (1 << 64) for _, _, k, _ in part], dropout, seed, [c for *_, c in part])
                ends = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)), mask=pa.array([t is None for _, t, *_ in part]))
                yield pa.RecordBatch.from_arrays([pa.array([i for i, *_ in part], batch.schema.field(0).type), lists], ["doc_id", "ids"])

    rows = keyed(docs)
    rows = copy_numbers(rows) if vary_copies else rows.withColumn("copy", F.lit(0))
    return rows.mapInArrow(run, f"doc_id {kind_of(docs, 'doc_id')}, ids array<int>")


def decode(tokens: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give a null text."""
    shared = tokens.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [None if x is None else words.decode(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind_of(tokens, 'doc_id')}, text string")


def digests(docs: DataFrame, vocabulary: Vocabulary, dropout: float = 0.1, seed: int = 1) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids_sha256 (of the ids, two bytes each, low byte first) and
    lossless (decoding the ids gives the text again); a null text counts as empty. Every text is
    encoded and decoded in one task, so ids don't travel."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            for part in steps(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                texts = [t or "" for _, t, _ in part]
                ids = words.encode_all(texts, [k % (1 << 64) for *_, k in part], dropout, seed)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([i for i, *_ in part], batch.schema.field(0).type),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x.astype("<u2").tobytes()).hexdigest() for x in ids], pa.string()),
                        pa.array([words.decode(x.tolist()) == t for x, t in zip(ids, texts, strict=True)], pa.bool_()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "lossless"],
                )

    return keyed(docs).mapInArrow(run, f"doc_id {kind_of(docs, 'doc_id')}, n_tokens long, ids_sha256 string, lossless boolean")
