"""SimHash near-dedup: fingerprints of word shingles, linked by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits share a variant: some value within r bits of both.
So each fingerprint emits all its variants within r bits (2081 of 64 bits for r = 2), equal variants
meet, and colliding fingerprints are verified. Variants are dealt by a linear hash f, and since
f(x ^ e) = f(x) ^ f(e), it is known beforehand which buckets a fingerprint's variants go to: the
shuffle carries the fingerprint once per bucket and its variants are formed inside the bucket, which
saves most of the volume and none of the work.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, kind_of, maybe_in, packed, stored
from .components import components

BITS, SEED = 64, 42
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15
#: Fingerprints in a row of the scatter; a bucket's variants that are sorted at once; buckets at least.
CHUNK, VARIANTS, BUCKETS = 1 << 15, 1 << 21, 256
#: Below so many fingerprints all of them fit a task (8 bytes each), and BUCKETS suffices.
IN_TASK = 1 << 24


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The SimHash of a whole text: words are runs outside ASCII white space, A-Z lower-cased.

    A bit is 1 if over half of the shingles' hashes (repeats counted) have it. Null or no word: 0.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    line, n = b" ".join(words), max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1))
    ends = ends[min(shingle, len(words)) - 1 :]
    counts = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        spans = zip(starts[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist(), strict=True)
        hashes = np.array([digest(line[a:b], SEED) for a, b in spans], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(counts * 2 > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. doc_id may be of any type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind_of(docs, 'doc_id')}, fp long")


class Ball:
    """All masks of at most `radius` bits, and a linear hash of 64-bit values to 2**bits values."""

    def __init__(self, radius: int, bits: int):
        rng = np.random.default_rng(7)
        of_bit = rng.integers(0, 1 << bits, BITS, dtype=np.int64)
        flips = [c for k in range(radius + 1) for c in combinations(range(BITS), k)]
        self.masks = np.array([sum(1 << i for i in c) for c in flips], np.uint64)
        self.bits = bits
        self.tables = np.zeros((8, 256), np.int64)
        for byte in range(8):
            for value in range(256):
                for i in range(8):
                    if value >> i & 1:
                        self.tables[byte, value] ^= of_bit[byte * 8 + i]
        self.mask_hash = self.hash(self.masks)

    def hash(self, values: np.ndarray) -> np.ndarray:
        parts = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)
        out = np.zeros(len(parts), np.int64)
        for byte in range(8):
            out ^= self.tables[byte][parts[:, byte]]
        return out


def links_in(fps: np.ndarray, ball: Ball, target: int, differing: int) -> np.ndarray:
    """Links (rows of two fingerprints) between those of fps that share a variant of hash target.

    All that share one variant lie within `differing` bits of each other, so linking each to the
    smallest of them joins the same components as all their pairs, at a row per fingerprint.
    """
    classes = ball.hash(fps)
    order = np.argsort(classes, kind="stable")
    fps, classes = fps[order], classes[order]
    wanted = ball.mask_hash ^ target
    lo, hi = np.searchsorted(classes, wanted, "left"), np.searchsorted(classes, wanted, "right")
    parts = [(fps[a:b], mask) for a, b, mask in zip(lo.tolist(), hi.tolist(), ball.masks, strict=True) if b > a]
    none = np.empty((0, 2), np.uint64)
    if not parts:
        return none
    variants = np.concatenate([x ^ mask for x, mask in parts])
    owners = np.concatenate([x for x, _ in parts])
    ordered = np.sort(variants)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return none
    table = np.zeros(1 << 16, bool)
    table[(twice & np.uint64(0xFFFF)).astype(np.int64)] = True
    near = table[(variants & np.uint64(0xFFFF)).astype(np.int64)]
    variants, owners = variants[near], owners[near]
    order = np.lexsort((owners, variants))
    variants, owners = variants[order], owners[order]
    first = np.concatenate(([True], variants[1:] != variants[:-1]))
    smallest = owners[np.maximum.accumulate(np.where(first, np.arange(len(owners)), 0))]
    links = np.unique(np.stack([owners, smallest], 1)[owners != smallest], axis=0)
    return links[np.bitwise_count(links[:, 0] ^ links[:, 1]) <= differing]


def fingerprint_links(distinct: DataFrame, count: int, differing: int = 4) -> DataFrame:
    """(a, b): links that join all of distinct's fp values at `differing` or fewer bits, verified.

    An odd `differing` takes the next even ball and the verification trims it; links then stand for
    their own pair only, so every pair of a variant is compared. count: rows of distinct, for sizing.
    """
    if differing % 2:
        raise ValueError("an even number of differing bits")
    radius = differing // 2
    size = sum(1 for k in range(radius + 1) for _ in combinations(range(BITS), k))
    buckets = BUCKETS
    while count > IN_TASK and buckets * IN_TASK < count * size:
        buckets *= 2
    inner = 1
    while buckets * inner * VARIANTS < count * size:
        inner *= 2
    bits = (buckets * inner).bit_length() - 1
    deep = inner.bit_length() - 1

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ball, held, rows = Ball(radius, bits), [], 0
        reach = np.unique(ball.mask_hash >> deep)

        def flush():
            fps = np.concatenate(held)
            classes = ball.hash(fps) >> deep
            order = np.argsort(classes, kind="stable")
            fps, classes = fps[order], classes[order]
            if len(reach) == buckets:
                yield from ((bucket, fps) for bucket in range(buckets))
                return
            for at in range(0, len(fps), 1024):
                part, to = fps[at : at + 1024], classes[at : at + 1024, None] ^ reach[None, :]
                rank = np.argsort(to, axis=None, kind="stable")
                flat = to.ravel()[rank]
                edges = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1], [True])))
                who = part[rank // len(reach)]
                yield from ((int(flat[a]), who[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))

        def pack(pairs):
            keys, blobs, size = [], [], 0
            for key, blob in pairs:
                keys.append(key)
                blobs.append(blob.tobytes())
                size += len(blobs[-1])
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "fps"])
                    keys, blobs, size = [], [], 0
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "fps"])

        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            rows += batch.num_rows
            if rows >= CHUNK:
                yield from pack(flush())
                held, rows = [], 0
        if rows:
            yield from pack(flush())

    def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ball = Ball(radius, bits)
        fps = np.frombuffer(b"".join(rows["fps"]), np.uint64)
        found = [links_in(fps, ball, (int(key[0]) << deep) | sub, differing) for sub in range(inner)]
        links = np.unique(np.concatenate(found), axis=0).view(np.int64)
        return pd.DataFrame({"a": links[:, 0], "b": links[:, 1]})

    sent = distinct.select("fp").mapInArrow(scatter, "bucket int, fps binary")
    return sent.groupBy("bucket").applyInPandas(meet, "a long, b long").distinct()


def near_dedup(docs: DataFrame, shingle: int = 4, differing: int = 4) -> DataFrame:
    """One row per document: doc_id, fp, component_id (smallest doc_id reachable), kept.

    Fingerprints link at `differing` or fewer bits, equal ones always; component_id follows links
    through others. Null and empty texts have fingerprint 0 and link like any other. Rows that share
    a doc_id are separate nodes with one name. kept: doc_id is its component's id (null ids: the
    component's id is null only if all its ids are). Other columns of docs are ignored; an empty
    table gives an empty result.
    """
    prints = stored(fingerprints(docs, shingle), "simhash")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "simhash-classes")
    count = classes.count()
    roots = components(fingerprint_links(classes, count, differing))
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = stored(rooted.select("fp", "n", "root").join(ids, "root").select("fp", "n", "component_id"), "simhash-components")
    return attach(prints, named, "fp", max(prints.count(), 1)).select(
        "doc_id", "fp", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def near_deduplicated(docs: DataFrame, **options) -> DataFrame:
    """docs, all columns, without those whose component holds a smaller doc_id.

    Rows with a null id, and rows repeated with the id that stays, all stay; texts without a word are
    alike, so the one with the smallest id stays; an empty table stays empty; other columns may have any name.
    """
    gone = near_dedup(docs, **options).where(~F.col("kept")).select("doc_id").where("doc_id is not null")
    gone = stored(gone.distinct(), "simhash-gone")
    rows = packed(docs, "doc_id")
    far = maybe_in(rows, "doc_id", gone, inside=False)
    return far.unionByName(maybe_in(rows, "doc_id", gone).join(gone, "doc_id", "left_anti").select(*rows.columns)).select("row.*")
