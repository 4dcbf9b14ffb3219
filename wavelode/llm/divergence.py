"""How far sources of a language differ in their words, over a vocabulary kept as minimal transducers.

A first pass over the texts counts the documents of each term, in batches before the shuffle. The kept
terms are sorted by range, numbered by language and built into transducers of BLOCK terms each, rows of
a table. A second pass counts the texts' terms again; they stream to the transducer that their place
in the order belongs to, which drops terms that aren't kept and gives the others' ordinals. From there on
terms are numbers, whose order is that of the terms.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .transducer import Transducer

#: Bytes of a term: A-Z, a-z and in UTF-8 every byte of a character beyond ASCII; and what A-Z become.
LETTER, LOWER = np.zeros(256, bool), np.arange(256, dtype=np.uint8)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
LOWER[65:91] += 32
#: Bytes of whole texts whose terms are found side by side in arrays.
PART = 1 << 22
#: Terms of a transducer. What the driver knows of the vocabulary is the first term of each.
BLOCK = 16_384
#: A task hands its counts on when it holds so many different terms, or has met so many tokens or bytes of terms.
MOST_COUNTED, MOST_TOKENS, MOST_BYTES = 400_000, 6_000_000, 1 << 28
#: Bytes of a source's terms and counts in a row of the shuffle, but for one term that is longer: Spark hands
#: Python 10 000 rows at once. Terms looked up side by side.
ROW_BYTES, SIDE_BY_SIDE = 4096, 1 << 18
#: Documents to a salt: the terms of so many meet in one stream of a transducer.
DOCS_A_SALT = 500_000
#: Terms and sources of a tile in which distributions are compared as one block of numbers.
TILE_TERMS, TILE_SOURCES = 4096, 256
SCALE = 1_000_000_000


def prepared(docs: DataFrame) -> DataFrame:
    """lang, source and text of docs, nulls as empty texts."""
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def _begins(line: np.ndarray) -> np.ndarray:
    """Where a sorted array's different values begin."""
    return np.flatnonzero(np.append(True, line[1:] != line[:-1])[: len(line)])


def _by(column: pa.Array):
    """Each value of a column of texts, with the places that have it."""
    found = column.dictionary_encode()
    at = found.indices.to_numpy()
    for k, value in enumerate(found.dictionary.to_pylist()):
        yield value, np.flatnonzero(at == k)


def _parts(texts: pa.Array):
    """(first, texts): binary texts in parts of about PART bytes, none cut."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    edges = [*_begins((ends[:-1] - ends[0]) // PART).tolist(), len(texts)]
    for a, b in zip(edges, edges[1:], strict=False):
        yield a, texts[a:b]


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Of binary texts: their different terms, A-Z lower-cased and nothing else, and each token's term and text, as places."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    letter = LETTER[data]
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    new = ends[:-1][ends[:-1] < len(data)]
    first[new] = letter[new]  # a text's first letter doesn't go on with the text before
    text = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(np.flatnonzero(first), ends)))
    letters = LOWER[data[letter]]
    bounds = np.append(np.flatnonzero(first[letter]), len(letters)).astype(np.int32)
    tokens = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(letters)]).dictionary_encode()
    return tokens.dictionary, tokens.indices.to_numpy(), text


class _Counts:
    """Numbers by language, group (a whole number) and term, in parts that are merged when they are many."""

    def __init__(self):
        self.parts: dict[str, list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]] = {}
        self.terms = self.tokens = self.bytes = 0

    def add(self, lang: str, terms: pa.Array, group: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        self.parts.setdefault(lang, []).append((terms, group, at, n))
        self.terms += len(terms)
        self.tokens += int(n.sum())
        self.bytes += terms.nbytes

    def full(self) -> bool:
        if self.terms > 2 * MOST_COUNTED:
            self.parts = {lang: [self.of(lang)] for lang in self.parts}
            self.terms = sum(len(parts[0][0]) for parts in self.parts.values())
            if self.terms > MOST_COUNTED:
                return True
        return self.tokens > MOST_TOKENS or self.bytes > MOST_BYTES

    def of(self, lang: str) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """A language's different terms, and group, place among the terms and number of each pair that occurs, in this order."""
        parts = self.parts[lang]
        known = pa.concat_arrays([p[0] for p in parts]).dictionary_encode()
        place, size = known.indices.to_numpy().astype(np.int64), max(1, len(known.dictionary))
        before = np.cumsum([0, *(len(p[0]) for p in parts)])
        key = np.concatenate([p[1] * size + place[before[k] + p[2]] for k, p in enumerate(parts)])
        order = np.argsort(key)
        key = key[order]
        first = _begins(key)
        n = np.add.reduceat(np.concatenate([p[3] for p in parts])[order], first) if len(first) else first
        return known.dictionary, key[first] // size, key[first] % size, n


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(lang, term, df): documents of a language that have a term; a task counts many before it hands them on."""

    def work(batches):
        def handed():
            for lang in held.parts:
                terms, _, _, n = held.of(lang)
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(terms)), terms.cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "term", "df"])

        held = _Counts()
        for batch in batches:
            for lang, rows in _by(batch.column(0)):
                for _, texts in _parts(batch.column(1).take(pa.array(rows))):
                    terms, at, text = terms_of(texts)
                    if not len(terms):
                        continue
                    key = np.sort(text * len(terms) + at)
                    df = np.bincount(key[_begins(key)] % len(terms))
                    held.add(lang, terms, np.zeros(len(terms), np.int64), np.arange(len(terms)), df)
                    if held.full():
                        yield from handed()
                        held = _Counts()
        yield from handed()

    partial = docs.select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(work, "lang string, term string, df long")
    return partial.groupBy("lang", "term").agg(F.sum("df").alias("df"))


def numbered(terms: DataFrame) -> DataFrame:
    """(lang, term, ordinal, block), written: a language's terms from 0 in the order of their UTF-8 bytes.

    Terms are sorted by range; a part's first number is the sum of the counts of the parts before it, a
    window with a row for each part of a language.
    """
    line = terms.select("lang", "term").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    line = line.withColumn("place", F.monotonically_increasing_id())
    line = stored(line.withColumn("part", F.shiftright("place", 33)), "vocabulary-order")
    parts = line.groupBy("lang", "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    rows = line.join(F.broadcast(parts), ["lang", "part"])  # a row for each range partition and language
    rows = rows.withColumn("ordinal", F.col("base") + F.col("place") - F.col("first"))
    return stored(rows.select("lang", "term", "ordinal", F.floor(F.col("ordinal") / BLOCK).alias("block")), "vocabulary")


def transducers(vocabulary: DataFrame) -> DataFrame:
    """(lang, block, first, machine), written: a minimal transducer of each block of a language's terms."""

    def work(table: pa.Table) -> pa.Table:
        terms = sorted(t.encode() for t in table.column("term").to_pylist())
        return pa.table({"lang": table.column("lang")[:1], "block": table.column("block")[:1], "first": pa.array([terms[0].decode()]), "machine": pa.array([Transducer.build(terms).packed()], pa.binary())})

    return stored(vocabulary.groupBy("lang", "block").applyInArrow(work, "lang string, block long, first string, machine binary"), "transducers")


#: Bits of a source's hash in a row's sort key, and of the mark that comes before it.
SOURCE_BITS = 29


def recounted(docs: DataFrame, machines: DataFrame, salts: int) -> DataFrame:
    """(lang, source, ordinal, place, n): occurrences of the kept terms, from a pass of all texts through the transducers.

    A task counts its texts' terms by language and source and sends each to its block, many of a source in a row;
    there the transducer comes first in a sorted stream of such rows, so a task holds one transducer and one source's counts.
    Rows are sorted by one number: block, salt, then a hash of the source. place numbers the terms of all languages.
    """
    firsts: dict[str, list[bytes]] = {}
    base: dict[str, int] = {}
    for k, row in enumerate(machines.select("lang", "block", "first").orderBy("lang", "block").toLocalIterator()):  # a row for BLOCK terms
        firsts.setdefault(row["lang"], []).append(row["first"].encode())
        base.setdefault(row["lang"], k)
    starts = docs.sparkSession.createDataFrame(sorted(base.items()), "lang string, base long")  # a row for each language

    def count(batches):
        flushes = TaskContext.get().partitionId() if TaskContext.get() else 0

        def handed():
            names, hashes = pa.array(sources, pa.string()), np.array([zlib.crc32(s.encode()) % (1 << SOURCE_BITS) for s in sources], np.int64)
            for lang in held.parts:
                terms, source, at, n = held.of(lang)
                marks = pa.array(firsts[lang], pa.binary())
                order = pc.array_sort_indices(pa.concat_arrays([marks, terms])).to_numpy().astype(np.int64)
                mark = order < len(marks)  # stands before the term that is the same
                blocks, order = (np.cumsum(mark) - 1)[~mark], order[~mark] - len(marks)
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                at = place[at]
                line = np.argsort(source * len(order) + at)
                line = line[blocks[at[line]] >= 0]  # below the first kept term there is none
                source, at, n = source[line], at[line], n[line]
                block = blocks[at]
                new = _begins(source * (len(marks) + 1) + block)
                texts = terms.take(pa.array(order[at])).cast(pa.string())
                size = np.cumsum(np.append(0, pc.binary_length(texts).to_numpy() + 12))  # with an offset and a count
                within = (size[:-1] - np.repeat(size[new], np.diff(np.append(new, len(at))))) // ROW_BYTES
                new = np.union1d(new, 1 + np.flatnonzero(within[1:] != within[:-1]))
                bounds = pa.array(np.append(new, len(at)), pa.int32())
                spot = (block[new] + base[lang]) * salts + flushes % salts
                key = (spot << SOURCE_BITS + 1) + (1 << SOURCE_BITS) + hashes[source[new]]
                lists = [pa.ListArray.from_arrays(bounds, x) for x in (texts, pa.array(n, pa.int64()))]
                rows = pa.RecordBatch.from_arrays([pa.array(spot), pa.array(key), names.take(pa.array(source[new])), *lists], names=["spot", "line", "source", "terms", "n"])
                edges = [*_begins(new // SIDE_BY_SIDE).tolist(), len(new)]
                for a, b in zip(edges, edges[1:], strict=False):
                    yield rows[a:b]

        held, sources = _Counts(), {}
        for batch in batches:
            for lang, rows in _by(batch.column(0)):
                if lang not in firsts:
                    continue
                spoken = batch.column(1).take(pa.array(rows)).dictionary_encode()
                for k, texts in _parts(batch.column(2).take(pa.array(rows))):
                    terms, at, text = terms_of(texts)
                    if not len(terms):
                        continue
                    number = np.array([sources.setdefault(s, len(sources)) for s in spoken.dictionary.to_pylist()], np.int64)
                    key = np.sort(number[spoken.indices.to_numpy()[k + text]] * len(terms) + at)
                    first = _begins(key)
                    held.add(lang, terms, key[first] // len(terms), key[first] % len(terms), np.diff(np.append(first, len(key))))
                    if held.full():
                        yield from handed()
                        held, sources, flushes = _Counts(), {}, flushes + 1
        yield from handed()

    def walk(batches):
        machine = sums = source = lang = None
        block = place = 0
        names = ["lang", "source", "ordinal", "place", "n"]

        def made():
            at = np.flatnonzero(sums)
            k = len(at)
            return pa.RecordBatch.from_arrays([pa.repeat(lang, k), pa.repeat(source, k), pa.array(at + block * BLOCK), pa.array(at + place * BLOCK), pa.array(sums[at])], names=names)

        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns, strict=True))
            ends = np.cumsum(pc.list_value_length(column["terms"]).to_numpy())
            heads = np.flatnonzero(column["machine"].is_valid().to_numpy(zero_copy_only=False))
            new = pc.not_equal(column["source"][1:], column["source"][:-1]).to_numpy(zero_copy_only=False)
            edges = np.unique([*heads, *_begins(ends // SIDE_BY_SIDE), batch.num_rows]).tolist()
            for a, b in zip([0, *edges], edges, strict=False):
                if a == b:
                    continue
                packed = column["machine"][a].as_py()
                if packed is not None:
                    if sums is not None:
                        yield made()
                    machine, sums, source = Transducer.unpacked(packed), None, None
                    place, lang = column["spot"][a].as_py() // salts, column["source"][a].as_py()
                    block = place - base[lang]
                    a += 1
                    if a == b:
                        continue
                terms, n = column["terms"][a:b].flatten(), column["n"][a:b].flatten().to_numpy()
                offsets = np.frombuffer(terms.buffers()[1], np.int32)[terms.offset : terms.offset + len(terms) + 1].astype(np.int64)
                found = machine.ordinals(offsets, np.frombuffer(terms.buffers()[2] or b"", np.uint8))
                start = ends[a - 1] if a else 0
                runs = [a, *(a + 1 + np.flatnonzero(new[a : b - 1])).tolist(), b]
                for i, j in zip(runs, runs[1:], strict=False):
                    now = column["source"][i].as_py()
                    if now != source:
                        if sums is not None:
                            yield made()
                        sums, source = np.zeros(machine.size, np.int64), now
                    here = slice((ends[i - 1] if i else 0) - start, ends[j - 1] - start)
                    some = found[here] >= 0
                    np.add.at(sums, found[here][some], n[here][some])
        if sums is not None:
            yield made()

    text = docs.select("lang", "source", F.col("text").cast("binary").alias("text"))
    rows = text.mapInArrow(count, "spot long, line long, source string, terms array<string>, n array<long>").withColumn("machine", F.lit(None).cast("binary"))
    heads = machines.join(starts, "lang").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spot = (F.col("base") + F.col("block")) * salts + F.col("salt")
    heads = heads.select(spot.alias("spot"), F.shiftleft(spot, SOURCE_BITS + 1).alias("line"), F.col("lang").alias("source"), F.array().cast("array<string>").alias("terms"), F.array().cast("array<long>").alias("n"), "machine")
    line = heads.unionByName(rows).repartition("spot").sortWithinPartitions("line")
    sums = line.mapInArrow(walk, "lang string, source string, ordinal long, place long, n long")
    return sums.groupBy("place", "source", "lang", "ordinal").agg(F.sum("n").alias("n"))


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exactly."""
    wide = lambda c: c.cast("decimal(20,0)")
    return 1 + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(count + 1), wide(total + terms)).cast("long")


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def pair_sums(weights: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value): for each two sources of a language, by their numbers, divergence() summed over all kept terms.

    weights: lang, nth (a source's number), ordinal, p of terms that occur; groups: lang, nth, none (what p is
    for a term that doesn't occur) and terms. Tiles of terms and sources are dense blocks of numbers of
    bounded size, and each gives a sum for a pair of sources, so no pair is a row for a term.
    """

    def work(table: pa.Table) -> pa.Table:
        lang, low, high, chunk = (table.column(c)[0].as_py() for c in ("lang", "low", "high", "chunk"))
        nth, ordinal, p = (table.column(c).to_numpy() for c in ("nth", "ordinal", "p"))
        here = ordinal < 0
        members, none = nth[here], p[here]
        order = np.argsort(members)
        members, none = members[order], none[order]
        width = int(table.column("terms")[int(np.flatnonzero(here)[0])].as_py()) - chunk * TILE_TERMS
        block = np.repeat(none[:, None], min(width, TILE_TERMS), 1)
        block[np.searchsorted(members, nth[~here]), ordinal[~here] - chunk * TILE_TERMS] = p[~here]
        tile = members // TILE_SOURCES
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i, a in enumerate(members):
            others = np.flatnonzero((tile == (high if tile[i] == low else low)) & (members != a))
            gap = block[i] - block[others]
            out.append((np.full(len(others), a), members[others], (gap * gap // block[others]).sum(1)))
        a, b, value = (np.concatenate(c) if out else np.zeros(0, np.int64) for c in zip(*out, strict=True))
        return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "value": pa.array(value, pa.int64())})

    tiles = lambda n: F.floor(n / TILE_SOURCES).cast("int")
    sizes = groups.groupBy(F.col("lang").alias("l")).agg(F.max("nth").alias("last"))
    rows = weights.join(sizes, F.col("lang") == F.col("l")).select("lang", "nth", "ordinal", "p", F.lit(0).cast("long").alias("terms"), F.floor(F.col("ordinal") / TILE_TERMS).alias("chunk"), "last")
    spread = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("terms") / TILE_TERMS) - 1))
    blank = groups.where("terms > 0").join(sizes, F.col("lang") == F.col("l")).select("lang", "nth", F.lit(-1).cast("long").alias("ordinal"), F.col("none").alias("p"), "terms", spread.alias("chunk"), "last")
    both = rows.unionByName(blank).withColumn("other", F.explode(F.sequence(F.lit(0), tiles(F.col("last"))))).withColumn("own", tiles(F.col("nth")))
    both = both.select("lang", "chunk", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "nth", "ordinal", "p", "terms")
    sums = both.groupBy("lang", "chunk", "low", "high").applyInArrow(work, "lang string, a long, b long, value long")
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): of each source of each language, part `pair`, all other sources of the
    language by how far its words are distributed from theirs, and part `term`, the `top` kept terms that
    stand out most against the whole language.

    A language keeps the terms that at least least_docs of its documents have. Null text, lang and source
    are ''. Equal values rank by item's UTF-8 bytes, for terms by ordinal. A repeated document counts each
    time; a source without terms has its pairs; a language without kept terms has pairs of value 0; an empty
    table gives an empty result. Only the three columns are read.
    """
    docs = prepared(docs)
    groups = docs.groupBy("lang", "source").agg(F.count("*").alias("docs"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1  # a language's sources, not rows
    groups = stored(groups.withColumn("nth", nth.cast("long")), "sources")
    vocabulary = numbered(document_frequencies(docs).where(F.col("df") >= least_docs))
    salts = 1 + (groups.agg(F.sum("docs")).first()[0] or 0) // DOCS_A_SALT
    counts = stored(recounted(docs, transducers(vocabulary), salts), "term-counts")

    terms = vocabulary.groupBy(F.col("lang").alias("l")).agg(F.count("*").alias("terms"))
    totals = counts.groupBy(F.col("lang").alias("tl"), F.col("source").alias("ts")).agg(F.sum("n").alias("total"))
    known = groups.join(totals, (F.col("lang") == F.col("tl")) & (F.col("source") == F.col("ts")), "left").join(terms, F.col("lang") == F.col("l"), "left")
    known = known.select("lang", "source", "nth", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"))
    none = F.when(F.col("terms") > 0, probability(F.lit(0).cast("long"), F.col("total"), F.col("terms")))
    whole = Window.partitionBy("lang")
    known = stored(known.withColumn("none", none).withColumn("lang_total", F.sum("total").over(whole)), "source-totals")

    at_all = F.sum("n").over(Window.partitionBy("place"))  # a row for each source that has the term
    rows = counts.withColumn("at_all", at_all).join(known.drop("none"), ["lang", "source"])
    p, q = probability(F.col("n"), F.col("total"), F.col("terms")), probability(F.col("at_all"), F.col("lang_total"), F.col("terms"))
    weights = stored(rows.select("lang", "source", "nth", "ordinal", p.alias("p"), q.alias("q")), "term-weights")

    sums = pair_sums(weights.select("lang", "nth", "ordinal", "p"), known.select("lang", "nth", "none", "terms"))
    ends = [known.select(F.col("lang").alias(f"l{x}"), F.col("nth").alias(x), F.col("source").alias(f"s{x}")) for x in "ab"]
    pairs = ends[0].join(ends[1], (F.col("la") == F.col("lb")) & (F.col("a") != F.col("b")))  # the result's rows
    pairs = pairs.select(F.col("la").alias("lang"), "a", "b", "sa", "sb").join(sums, ["lang", "a", "b"], "left")
    pairs = pairs.select("lang", F.col("sa").alias("source"), F.lit("pair").alias("part"), F.col("sb").alias("item"), F.coalesce("value", F.lit(0)).alias("value"))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")))

    best = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "ordinal"))
    over = weights.where("p > q").select("lang", "source", "ordinal", divergence(F.col("p"), F.col("q")).alias("value")).withColumn("rank", best).where(F.col("rank") <= top)
    named = over.join(vocabulary.select("lang", "ordinal", F.col("term").alias("item")), ["lang", "ordinal"])
    return ranked.unionByName(named.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
