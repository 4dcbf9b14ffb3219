"""Embedding near-dedup by collision-counting projections.

Every vector is projected on many random lines. A line's two ends are sorted lists of the vectors that
project far out on it; around each vector (the query) in a list stands a window, and whoever is inside
collides with it. Vectors of a high cosine collide in many lists, others in almost none. The number of
lists and the least number of collisions are calibrated so that a pair of exactly the threshold's
cosine passes with a stated recall; pairs that pass are verified by their cosine in double precision.

Lists are ends of lines, not whole lines, because a whole line tells little: at cosine 0.9 a window that
half of the linked pairs stand in holds a sixth of all others too, so a line would cost n * n / 12 pairs.
A list of n * share vectors costs (n * share)**2 / 2, which is n / 22 for the share taken here.

A list's task has its members' vectors and all their places, so it knows of every pair in how many
earlier lists it has collided, and verifies it in the very list where its count reaches the least.
So no table of pairs exists: tasks give sums of links and one edge per member. Lists are counted first;
those with very many members (a large group of near vectors) are cut into blocks, and every pair of
blocks is a task of its own.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, stored
from .components import components

#: Lines that are drawn from one seed; lists in a task's group; cells of a count block; vectors that are
#: projected at once.
BLOCK, TOGETHER, CELLS, BATCH = 1024, 16, 1 << 22, 4096
#: Groups of lists with more members are cut into blocks of about so many.
MEMBERS = 1 << 14


class Plan:
    """How far out a list begins, its window, the number of lines, and the least count.

    A list holds a share of about 0.3 / sqrt(n) of n vectors, which balances the work of projecting
    (n / share) with that of the lists (n * n * share): n to the power 1.5 in all. Projections of unit
    vectors on Gaussian lines are bivariate normal with the cosine as correlation, so collision
    probabilities are exact for any data.
    """

    def __init__(self, n: int, cosine: float, expected: float = 8.0, recall: float = 0.995):
        share = min(0.05, 0.3 / math.sqrt(max(n, 1)))
        self.cosine = cosine
        self.start = NormalDist().inv_cdf(1 - share)
        self.window = 2.5 * math.sqrt(2 * (1 - cosine))
        collide = self.collision(cosine)
        lists = expected / collide
        self.lines = BLOCK * math.ceil(lists / 2 / BLOCK)
        self.least, tail, term = 1, 1.0, math.exp(-2 * self.lines * collide)
        for k in range(1, 50):  # P(count >= k) of a Poisson count
            tail -= term
            if tail < recall:
                break
            self.least, term = k, term * 2 * self.lines * collide / k

    def collision(self, cosine: float) -> float:
        """The probability that a pair of this cosine collides in a given list."""
        unit, spread = NormalDist(), math.sqrt(1 - cosine * cosine) or 1e-9
        total, step = 0.0, 0.01
        for i in range(600):
            x = self.start + (i + 0.5) * step
            lo, hi = max(self.start, x - self.window), x + self.window
            total += step * unit.pdf(x) * (unit.cdf((hi - cosine * x) / spread) - unit.cdf((lo - cosine * x) / spread))
        return total


def unit_rows(blobs: list[bytes], kind: str) -> np.ndarray:
    x = np.stack([np.frombuffer(b, kind) for b in blobs]).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # squares of extreme components stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def places(units: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, list, value) of every place, by row: list 2 * line + end, value the projection outward."""
    rows, lists, values = [], [], []
    small = units.astype(np.float32)
    for block in range(plan.lines // BLOCK):
        lines = np.random.default_rng((3, units.shape[1], block)).standard_normal((units.shape[1], BLOCK), dtype=np.float32)
        p = small @ lines
        row, line = np.nonzero(np.abs(p) >= plan.start)
        value = p[row, line]
        rows.append(row)
        lists.append((block * BLOCK + line) * 2 + (value < 0))
        values.append(np.abs(value))
    rows, lists, values = np.concatenate(rows), np.concatenate(lists), np.concatenate(values)
    order = np.argsort(rows, kind="stable")
    return rows[order], lists[order].astype(np.int32), values[order].astype(np.float32)


def links_of(units: np.ndarray, values: np.ndarray, near: list[tuple[np.ndarray, np.ndarray]], plan: Plan, block: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of a list's members whose collision count reaches plan.least in this list and
    whose cosine is high enough. near: of each earlier list, members of this one in it and values there.
    block: if given, only pairs of members of different blocks."""
    n, first, second = len(units), [], []
    high = max(1, CELLS // n)
    for at in range(0, n, high):
        end = min(n, at + high)
        count = np.zeros((end - at, n), np.uint8)
        for members, there in near:
            a, b = np.searchsorted(members, (at, end))
            if a < b:
                hit = np.abs(there[a:b, None] - there[None, :]) <= plan.window
                cells = np.ix_(members[a:b] - at, members)
                count[cells] = np.minimum(count[cells] + hit, 254)
        here = np.abs(values[at:end, None] - values[None, :]) <= plan.window
        i, j = np.nonzero(here & (count == plan.least - 1))
        i += at
        keep = i < j
        if block is not None:
            keep &= block[i] != block[j]
        i, j = i[keep], j[keep]
        for k in range(0, len(i), 1 << 16):
            a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            ok = np.einsum("ij,ij->i", units[a], units[b]) >= plan.cosine
            first.append(a[ok])
            second.append(b[ok])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *first]), np.concatenate([none, *second])


def rooted(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Each node's smallest reachable node."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def link_sums(classes: DataFrame, count: int, kind: str, cosine: float) -> DataFrame:
    """(cid, links, root) from every list: rows linked to a class there, and a class it hangs with.

    classes: (cid, dim, blob, n), one row per distinct vector; vectors meet only within one dim.
    """
    plan = Plan(count, cosine)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(dim, columns of its vectors, all their places, and of each list group that a vector has a place
        in: vector's number, group)."""
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                cid, dim, n = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3))
                blob = np.array(part.column(2).to_pylist(), object)
                for d in np.unique(dim):
                    own = np.flatnonzero(dim == d)
                    row, lists, values = places(unit_rows(list(blob[own]), kind), plan)
                    group = np.unique(np.stack([row, lists // TOGETHER], 1), axis=0)
                    yield d, (cid[own], n[own], blob[own]), (row, lists, values), (group[:, 0], group[:, 1])

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[tuple[int, int]] = Counter()
        for d, _, _, (_, groups) in placed(batches):
            found.update({(int(d), int(g)): int(m) for g, m in zip(*np.unique(groups, return_counts=True), strict=True)})
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((*zip(*found, strict=True), list(found.values())) if found else ((), (), ()), (pa.int32(), pa.int32(), pa.int64()), strict=True)], ["dim", "part", "m"])

    vectors = classes.select("cid", "dim", "blob", "n")
    counts = vectors.mapInArrow(sizes, "dim int, part int, m long").groupBy("dim", "part").agg(F.sum("m").alias("m"))
    # A row per large group of lists, whose number the plan bounds.
    blocks = {(r["dim"], r["part"]): -(-r["m"] // MEMBERS) for r in counts.where(F.col("m") > MEMBERS).collect()}

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, (cid, n, blob), (row, lists, values), (who, groups) in placed(batches):
            cuts = np.searchsorted(row, np.arange(len(cid) + 1))
            at_lists = np.array([lists[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], object)
            at_values = np.array([values[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], object)
            many = np.array([blocks.get((int(d), g), 1) for g in groups.tolist()], np.int64)
            # A member of block x of m is dealt to the m pairs of blocks that x is in.
            own = (cid[who].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % many
            turn = np.repeat(np.arange(len(who)), many)
            other = np.arange(len(turn)) - np.repeat(np.cumsum(many) - many, many)
            tile = np.minimum(own[turn], other) * many[turn] + np.maximum(own[turn], other)
            for at in range(0, len(turn), BATCH):
                k = turn[at : at + BATCH]
                to = who[k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(k), d, np.int32)), pa.array(groups[k].astype(np.int32)), pa.array(tile[at : at + BATCH]), pa.array(own[k]), pa.array(cid[to]), pa.array(n[to]),
                     pa.array(blob[to].tolist(), pa.binary()), pa.array(at_lists[to].tolist(), pa.binary()), pa.array(at_values[to].tolist(), pa.binary())],
                    ["dim", "part", "tile", "own", "cid", "n", "blob", "lists", "places"],
                )

    def gather(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        units, cid, n, block = unit_rows(list(rows["blob"]), kind), rows["cid"].to_numpy(), rows["n"].to_numpy(), rows["own"].to_numpy()
        many = blocks.get((int(key[0]), int(key[1])), 1)
        apart = key[2] // many != key[2] % many
        sizes = np.array([len(b) // 4 for b in rows["lists"]])
        owner = np.repeat(np.arange(len(rows)), sizes)
        lists, values = np.frombuffer(b"".join(rows["lists"]), np.int32), np.frombuffer(b"".join(rows["places"]), np.float32)
        order = np.lexsort((owner, lists))
        owner, lists, values = owner[order], lists[order], values[order]
        out = []
        for this in range(key[1] * TOGETHER, (key[1] + 1) * TOGETHER):
            a, b = np.searchsorted(lists, (this, this + 1))
            if b - a < 2:
                continue
            who = owner[a:b]
            local = np.full(len(rows), -1)
            local[who] = np.arange(b - a)
            mine = local[owner[:a]] >= 0
            at, old, there = local[owner[:a][mine]], lists[:a][mine], values[:a][mine]
            edges = np.flatnonzero(np.concatenate(([True], old[1:] != old[:-1], [True]))) if len(old) else np.zeros(1, int)
            near = [(at[x:y], there[x:y]) for x, y in zip(edges[:-1], edges[1:], strict=True) if y - x > 1]
            if len(near) < plan.least - 1:
                continue
            i, j = links_of(units[who], values[a:b], near, plan, block[who] if apart else None)
            if len(i):
                links = np.bincount(i, n[who][j], b - a) + np.bincount(j, n[who][i], b - a)
                root, there = rooted(b - a, i, j), np.flatnonzero(links)
                out.append(pd.DataFrame({"cid": cid[who][there], "links": links[there].astype(np.int64), "root": cid[who][root[there]]}))
        return pd.concat(out) if out else pd.DataFrame({"cid": [], "links": [], "root": []})

    sent = vectors.mapInArrow(
        scatter, "dim int, part int, tile long, own long, cid long, n long, blob binary, lists binary, places binary"
    )
    return sent.groupBy("dim", "part", "tile").applyInPandas(gather, "cid long, links long, root long")


def near_vectors(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """One row per row of vectors (vec_id, embedding): vec_id, n_links, component_id, kept.

    n_links counts the other rows at this cosine or more that were found (recall 0.995 by calibration
    at exactly the threshold, higher above it), none below. component_id is the smallest vec_id
    reachable over links, itself included; kept: vec_id is that. Vectors of different lengths don't
    link. Null, empty and zero vectors and those with a null or non-finite component link with nothing,
    copies of themselves included. Equal vectors are compared once for all their rows. Rows that share
    a vec_id stay separate rows. Labels and other columns are ignored; an empty table gives an empty result.
    """
    double = dict(vectors.dtypes)["embedding"] == "array<double>"
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    usable = F.coalesce(finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    rows = vectors.select("vec_id", "embedding", usable.alias("usable"))
    alone = rows.where("not usable").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
    )
    rows = rows.where("usable").select("vec_id", "embedding")
    classes = rows.groupBy("embedding").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"))
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "vectors")
    count, total = classes.count(), rows.count()
    if not count:
        return alone
    kind = "<f8" if double else "<f4"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [np.array(x, kind).tobytes() for x in batch.column(1).to_pylist()]
            dims = [len(b) // int(kind[2]) for b in blobs]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(dims, pa.int32()), pa.array(blobs, pa.binary()), batch.column(2)], ["cid", "dim", "blob", "n"]
            )

    packed = classes.select("cid", "embedding", "n").mapInArrow(pack, "cid long, dim int, blob binary, n long")
    found = stored(link_sums(packed, count, kind, cosine), "vector-links")
    roots = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy(F.col("cid").alias("of")).agg(F.sum("links").alias("links"))
    named = (
        classes.join(roots, F.col("cid") == F.col("node"), "left")
        .join(sums, F.col("cid") == F.col("of"), "left")
        .select("embedding", "n", "first_id", F.coalesce("root", "cid").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    )
    ids = named.groupBy(F.col("root").alias("of")).agg(F.min("first_id").alias("component_id"))
    named = stored(named.join(ids, F.col("root") == F.col("of")).select("embedding", "n", "n_links", "component_id"), "vector-components")
    linked = attach(rows, named, "embedding", total).select(
        "vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    )
    return linked.unionByName(alone)
