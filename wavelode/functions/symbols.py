"""Symbolic words of windows: SAX letters from Gaussian cuts, SFA letters from learned Fourier bins."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.storage import stored
from . import kernels as K
from . import sliding
from .sliding import Words

LETTERS = "abcdefghijklmnopqrst"
UNFILLED = 1.7976931348623157e308


def gaussian_cuts(alphabet: int) -> list[float]:
    """Breakpoints that split the normal distribution into `alphabet` equal parts, 2 to 20 of them."""
    if not 2 <= alphabet <= 20:
        raise ValueError("an alphabet of 2 to 20 letters")
    cuts = [NormalDist().inv_cdf(k / alphabet) for k in range(1, alphabet)]
    return [0.0 if abs(c) < 1e-15 else c for c in cuts]


def symbol(value: Column, cuts: list[float] | list[Column]) -> Column:
    """Number of cuts at or below value: one that equals a cut goes up."""
    return K.added([(value >= c).cast("int") for c in cuts]) if cuts else F.lit(0)


def letter(value: Column, cuts: list[float]) -> Column:
    return F.substring(F.lit(LETTERS), symbol(value, cuts) + 1, F.lit(1))


def sax_words(series: DataFrame, width: int, parts: int, alphabet: int = 4, flat: float = 0.001) -> DataFrame:
    """A word per window: offset and word. No run of equal words is shortened."""
    rows = K.windows(series, width)
    mu, sigma = K.window_moments(F.col("w"), width, sample=True)
    rows = rows.withColumn("mu", mu).withColumn("sigma", sigma)
    if width > K.WIDE:
        rows = rows.withColumn("z", K.znorm_sample("w", flat))
        z = [F.col("z")[i] for i in range(width)]
    else:
        z = [F.when(F.col("sigma") < flat, 0.0).otherwise((F.col("w")[i] - F.col("mu")) / F.col("sigma")) for i in range(width)]
    means = rows.withColumn("p", F.array(*K.paa(z, parts)))
    letters = [letter(F.col("p")[i], gaussian_cuts(alphabet)) for i in range(min(parts, width))]
    return means.withColumn("word", F.concat(*letters)).drop("w", "z", "mu", "sigma", "p")


def word_code(word: Column, longest: int, alphabet: int = 20) -> Column:
    """A struct of longs in which the k-th letter sets k of its bits, so that the bits in which two words'
    codes differ are their letters' distances. Words of fewer than `longest` letters end in zeros."""
    bits = alphabet - 1
    per = 63 // bits
    parts = []
    for at in range(0, longest, per):
        letters = range(at, min(at + per, longest))
        masks = F.array(*[F.lit((1 << k) - 1).cast("long") for k in range(alphabet)])
        number = lambda i: F.greatest(F.ascii(F.substring(word, i + 1, 1)) - 97, F.lit(0))
        marks = [F.shiftleft(F.element_at(masks, number(i) + 1), bits * (i - at)) for i in letters]
        parts.append(K.added(marks).alias(f"c{at // per}"))
    return F.struct(*parts)


def word_l1(a: Column, b: Column, longest: int, alphabet: int = 20) -> Column:
    """Sum over letters of their distances, of two word_code() columns: the fuzzy match of two words."""
    return K.added([F.bit_count(a[f"c{k}"].bitwiseXOR(b[f"c{k}"])) for k in range(-(-longest // (63 // (alphabet - 1))))])


def least_l1(word: Column, words: Column, longest: int, alphabet: int = 20) -> Column:
    """The least word_l1 of a code to an array of codes."""
    return F.array_min(F.transform(words, lambda w: word_l1(word, w, longest, alphabet)))


def mindist(a: Column, b: Column, length: int, width: int, alphabet: int = 4) -> Column:
    """Lower bound of two windows' Euclidean distance from their words: neighbouring letters count 0."""
    cuts = F.array(*[F.lit(c) for c in gaussian_cuts(alphabet)])
    terms = []
    for i in range(length):
        p, q = (F.ascii(F.substring(w, i + 1, 1)) - 97 for w in (a, b))
        hi, lo = F.greatest(p, q), F.least(p, q)
        gap = F.when(hi - lo <= 1, 0.0).otherwise(F.element_at(cuts, F.greatest(hi, F.lit(1))) - F.element_at(cuts, lo + 1))
        terms.append(gap * gap)
    return F.sqrt(K.added(terms) * (width / length))


def per_window(series: DataFrame, fields: list[tuple[str, str]], work: Callable[[np.ndarray], Iterable[dict]], x: str = "x") -> DataFrame:
    """A row per window: series' columns but x, and fields (name, type). work takes a stack of equally long series
    and gives dicts of arrays (rows, windows, ...), several for several kinds of window. Null series have none."""
    kept = [c for c in series.columns if c != x]
    schema = T.StructType([*[series.schema[c] for c in kept], *T._parse_datatype_string(", ".join(f"{n} {t}" for n, t in fields)).fields])

    def column(values: np.ndarray) -> pa.Array:
        if values.ndim == 3:
            rows, n, k = values.shape
            return pa.ListArray.from_arrays(pa.array(np.arange(0, rows * n * k + 1, k), pa.int32()), pa.array(values.reshape(-1)))
        flat = pa.array(values.reshape(-1), pa.binary()) if values.dtype.kind == "S" else pa.array(values.reshape(-1))
        return flat.cast(pa.string()) if values.dtype.kind == "S" else flat

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.names.index(x))
            lens = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            starts, values = np.cumsum(lens) - lens, lists.flatten().to_numpy(zero_copy_only=False).astype(float)
            rest = batch.select(kept)
            for n in np.unique(lens[lens > 0]):
                at = np.flatnonzero(lens == n)
                for made in work(values[starts[at][:, None] + np.arange(n)]):
                    per = next(iter(made.values())).shape[1]
                    own = rest.take(pa.array(np.repeat(at, per)))
                    yield pa.RecordBatch.from_arrays([*own.columns, *[column(made[f]) for f, _ in fields]], names=[*kept, *[f for f, _ in fields]])

    return series.select(*kept, x).mapInArrow(run, schema)


def _offsets(rows: int, windows: int) -> np.ndarray:
    return np.broadcast_to(np.arange(windows, dtype=np.int32), (rows, windows))


def fourier_windows(series: DataFrame, width: int, length: int, norm_mean: bool = False, disjoint: bool = False) -> DataFrame:
    """Fourier values c of all windows, or of whole blocks (then `block` numbers them), each divided by its deviation.
    With norm_mean the constant part is skipped. The values come from running sums."""
    name, step = ("block", width) if disjoint else ("offset", 1)

    def work(a):
        if a.shape[1] >= width:
            c = sliding.fourier(a, width, length, norm_mean, step)
            yield {name: _offsets(*c.shape[:2]), "c": np.ascontiguousarray(c)}

    return per_window(series, [(name, "int"), ("c", "array<double>")], work)


def value_histograms(train: DataFrame, params: list[Words], *keys: str) -> DataFrame:
    """(param_id, keys, coef, value, n): training blocks' Fourier values to two decimals under every parameter, from
    one scan and one aggregation. As many rows as there are different values: cuts need no list of all, and a task
    counts equal values of the rows at hand before they leave it."""
    schema = T.StructType([T.StructField("param_id", T.IntegerType()), *[train.schema[k] for k in keys], *T._parse_datatype_string("coef int, value double, n long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.names.index("x"))
            lens = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            starts, values = np.cumsum(lens) - lens, lists.flatten().to_numpy(zero_copy_only=False).astype(float)
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(lens.tolist(), *[batch.column(batch.schema.names.index(k)).to_pylist() for k in keys], strict=True)):
                groups.setdefault(key, []).append(i)
            for (length, *key), at in groups.items():
                a = values[starts[at][:, None] + np.arange(length)]
                for k, p in enumerate(params):
                    if length < max(1, p.width):
                        continue
                    c = sliding.rounded(sliding.fourier(a, p.width, p.length, p.norm_mean, p.width)).reshape(-1, p.length)
                    found = [np.unique(v, return_counts=True) for v in np.ascontiguousarray(c.T)]
                    sizes = [len(v) for v, _ in found]
                    columns = [pa.repeat(pa.scalar(x, kind), sum(sizes)) for x, kind in zip((k, *key), batch_kinds, strict=True)]
                    columns += [pa.array(np.repeat(np.arange(p.length, dtype=np.int32), sizes)), pa.array(np.concatenate([v for v, _ in found])), pa.array(np.concatenate([n for _, n in found]))]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    batch_kinds = [to_arrow_type(field.dataType) for field in schema.fields[: 1 + len(keys)]]
    counted = train.select(*keys, "x").mapInArrow(run, schema)
    return counted.groupBy("param_id", *keys, "coef", "value").agg(F.sum("n").alias("n"))


def value_histogram(train: DataFrame, width: int, length: int, norm_mean: bool = False) -> DataFrame:
    """(coef, value, n) under one parameter."""
    return value_histograms(train, [Words("SFA", width, length, norm_mean=norm_mean)]).drop("param_id")


def _beyond(need: Column, last: Column | None):
    return lambda t: (t["upto"] > need) if last is None else (t["upto"] > need) & (t["value"] > last)


def equi_depth_bins(histogram: DataFrame, alphabet: int = 4, keys: tuple[str, ...] = ("coef",)) -> DataFrame:
    """(keys, cuts): each cut is the smallest value above the last cut that has more than
    ceil(depth * its number) values up to it; cuts that no value reaches are the largest double."""
    histogram = stored(histogram, "histogram")
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum("n").over(Window.partitionBy(*keys))
    runs = histogram.withColumn("upto", upto).withColumn("total", whole)
    lists = runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("value", "upto"))).alias("r"), F.first("total").alias("total"))
    cuts: list[Column] = []
    for k in range(1, alphabet):
        need = F.ceil(F.col("total") / alphabet * k)
        fits = F.filter("r", _beyond(need, cuts[-1] if cuts else None))
        lists = lists.withColumn(f"b{k}", F.coalesce(F.try_element_at(fits, F.lit(1))["value"], F.lit(UNFILLED)))
        cuts.append(F.col(f"b{k}"))
    return lists.select(*keys, F.array(*cuts).alias("cuts"))


def equi_width_bins(histogram: DataFrame, alphabet: int = 4) -> DataFrame:
    """(coef, cuts) that split each coefficient's range evenly."""
    ends = histogram.groupBy("coef").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    step = (F.col("hi") - F.col("lo")) / alphabet
    return ends.select("coef", F.array(*[step * k + F.col("lo") for k in range(1, alphabet)]).alias("cuts"))


def gain_bins(histogram: DataFrame, alphabet: int = 4, keys: tuple[str, ...] = ("coef",), least: int = 3) -> DataFrame:
    """(keys, cuts): each coefficient's values parted where that tells most of the classes, and each part again,
    until there are parts for the largest power of two of letters that the alphabet has.

    histogram: keys, value, label, n. A part is cut at the value with the largest gain of entropy (of equal gains,
    to nine decimals, the largest value), the value itself above the cut; parts with under 2 * least values, one class
    or no gain stay whole. Cuts that aren't made are the largest double. All parts of all coefficients are cut in
    one step a level. Entropy comes from running sums of c log2 c over the classes' counts, of which a value changes
    only those of its own classes, so there is no grid of values and classes.
    """
    by = [*keys, "part"]
    rows = stored(histogram, "class-histogram").withColumn("part", F.lit(0))
    term = lambda c: F.when(c > 0, c * F.log2(c)).otherwise(0.0)
    levels = []
    for level in range(alphabet.bit_length() - 1):
        own = Window.partitionBy(*by, "label")
        line = own.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        marked = rows.withColumn("l", F.sum("n").over(line)).withColumn("all", F.sum("n").over(own))
        at = marked.groupBy(*by, "value").agg(
            F.sum("n").alias("n"), F.sum(term(F.col("l")) - term(F.col("l") - F.col("n"))).alias("left"),
            F.sum(term(F.col("all") - F.col("l")) - term(F.col("all") - F.col("l") + F.col("n"))).alias("right"),
            F.sum(F.when(F.col("l") == F.col("n"), term(F.col("all"))).otherwise(0.0)).alias("whole"),
        )
        part, upto = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        sums = at.select(
            *by, F.lead("value").over(Window.partitionBy(*by).orderBy("value")).alias("cut"), F.sum("n").over(upto).alias("nl"), F.sum("n").over(part).alias("total"),
            F.sum("left").over(upto).alias("left"), F.sum("whole").over(part).alias("whole"), F.sum("right").over(upto).alias("right"),
        )
        nr = F.col("total") - F.col("nl")
        inside = term(F.col("nl")) - F.col("left") + term(nr) - F.col("whole") - F.col("right")
        gain = F.round((term(F.col("total")) - F.col("whole") - inside) / F.col("total"), 9)
        fit = sums.where((F.col("nl") >= least) & (nr >= least) & F.col("cut").isNotNull()).withColumn("gain", gain).where("gain > 0")
        best = stored(fit.groupBy(*by).agg(F.max(F.struct("gain", "cut")).alias("b")).select(*by, F.col("b.cut").alias("cut")), "gain-cuts")
        levels.append(best.select(*keys, "cut"))
        side = F.when(F.col("cut").isNotNull() & (F.col("value") >= F.col("cut")), 1).otherwise(0)
        rows = rows.join(best, by, "left").withColumn("part", F.col("part") * 2 + side).drop("cut")
    cuts = reduce(DataFrame.unionByName, levels).groupBy(*keys).agg(F.array_sort(F.collect_list("cut")).alias("c"))
    every = histogram.select(*keys).distinct().join(cuts, list(keys), "left")
    padded = F.slice(F.concat(F.coalesce("c", F.array().cast("array<double>")), F.array(*[F.lit(UNFILLED)] * (alphabet - 1))), 1, alphabet - 1)
    return every.select(*keys, padded.alias("cuts"))


def sfa_words(series: DataFrame, bins: DataFrame, width: int, length: int, alphabet: int = 4, norm_mean: bool = False) -> DataFrame:
    """A word per window: offset, word and code (the letters packed, the first one lowest). bins has `length`
    rows, which tasks get as they are."""
    p = Words("SFA", width, length, alphabet, norm_mean)
    cuts = np.array([r["cuts"] for r in bins.orderBy("coef").collect()], float).reshape(-1, alphabet - 1)
    bits = max(1, (alphabet - 1).bit_length())

    def work(a):
        if a.shape[1] >= width and len(cuts):
            numbers = sliding.sfa(a, p, cuts)
            code = sum(numbers[..., i].astype(np.int64) << bits * i for i in range(length))
            yield {"offset": _offsets(*numbers.shape[:2]), "word": sliding.spelled(numbers), "code": code}

    return per_window(series, [("offset", "int"), ("word", "string"), ("code", "long")], work)


def learned_cuts(train: DataFrame, params: list[Words]) -> dict[int, np.ndarray]:
    """The cuts of every parameter by its place in the list: Gaussian ones for SAX, equi-depth bins of the training
    series for SFA, all of them from one scan. As many numbers as the parameters have letters and symbols."""
    cuts = {k: np.array(gaussian_cuts(p.alphabet)) for k, p in enumerate(params) if p.kind == "SAX"}
    for alphabet in sorted({p.alphabet for p in params if p.kind == "SFA"}):
        places = [k for k, p in enumerate(params) if p.kind == "SFA" and p.alphabet == alphabet]
        found = equi_depth_bins(value_histograms(train, [params[k] for k in places]), alphabet, ("param_id", "coef"))
        for k in places:
            cuts[k] = np.full((params[k].length, alphabet - 1), UNFILLED)
        for r in found.collect():
            cuts[places[r["param_id"]]][r["coef"]] = r["cuts"]
    return cuts


def parameter_words(series: DataFrame, params: list[Words], cuts: dict[int, np.ndarray]) -> DataFrame:
    """A word per parameter and window, from one scan of the series: param_id (place in the list), offset, word."""

    def work(a):
        for k, p in enumerate(params):
            if a.shape[1] >= p.width:
                numbers = sliding.letters(a, p, cuts[k])
                yield {"param_id": np.full(numbers.shape[:2], k, np.int32), "offset": _offsets(*numbers.shape[:2]), "word": sliding.spelled(numbers)}

    return per_window(series, [("param_id", "int"), ("offset", "int"), ("word", "string")], work)


def bag(words: DataFrame) -> DataFrame:
    """(series_id, word, n)."""
    return words.groupBy("series_id", "word").agg(F.count("*").alias("n"))


def tfidf(words: DataFrame) -> DataFrame:
    """(label, word, tfidf): ln(1 + tf) * ln(classes / classes with the word)."""
    tf = stored(words.groupBy("label", "word").agg(F.count("*").alias("tf")), "tf")
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    classes = tf.select("label").distinct().agg(F.count("*").alias("classes"))
    weight = F.log(1 + F.col("tf")) * F.log(F.col("classes") / F.col("df"))
    return tf.join(df, "word").crossJoin(F.broadcast(classes)).select("label", "word", weight.alias("tfidf"))


def bag_distance(bags: DataFrame, queries: DataFrame, block: int = 16_384) -> DataFrame:
    """(query_id, example_id, d): sum over the query's words of squared count differences, of every query
    with every series of bags.

    d is the query's own sum of squares, corrected for the words a pair shares; pairs without one have that sum alone.
    Queries are cut into blocks of about `block`, and series, a row each with their bag, dealt over salts. Where a block's
    series stream through a task its queries come first, as lists by word; sums of pairs are numbers in an array
    there, so what is shuffled is bags, once a block, and a pair is a row only in the result.
    """
    spark = bags.sparkSession
    kind = bags.schema["series_id"].dataType
    schema = T.StructType([T.StructField("query_id", kind), T.StructField("example_id", kind), T.StructField("d", T.LongType())])
    rows = lambda df: df.groupBy("series_id").agg(F.collect_list(F.struct("word", F.col("n").cast("long").alias("n"))).alias("b")).select("series_id", F.col("b.word").alias("words"), F.col("b.n").alias("n"))
    asked = stored(rows(queries), "bag-queries")
    blocks = max(1, -(-asked.count() // block))
    salts = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, heads, lists = None, [], None
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns, strict=True))
            spots = np.stack([column[c].to_numpy() for c in ("block", "salt", "kind")], 1)
            edges = [0, *(np.flatnonzero((spots[1:] != spots[:-1]).any(1)) + 1).tolist(), len(spots)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                own = batch.select(["series_id", "words", "n"]).slice(a, b - a)
                if spots[a, 2] == 0:
                    if tuple(spots[a, :2]) != key:
                        key, heads = tuple(spots[a, :2]), []
                    heads.append(own)
                    lists = None
                elif tuple(spots[a, :2]) == key:
                    lists = lists or _by_word(pa.Table.from_batches(heads))
                    yield from pairs(*lists, own)

    def pairs(ids, sums, known, starts, at, counts, own, cells=1 << 18):
        step = max(1, cells // len(ids))
        for low in range(0, own.num_rows, step):
            series, words, n = (own.column(c).slice(low, step) for c in range(3))
            row = np.repeat(np.arange(len(series)), pc.list_value_length(words).to_numpy())
            place = pc.index_in(words.flatten(), value_set=known)
            met = place.is_valid().to_numpy(zero_copy_only=False)
            row, e, place = row[met], n.flatten().to_numpy()[met], place.drop_null().to_numpy()
            many = starts[place + 1] - starts[place]
            line = np.arange(many.sum()) + np.repeat(starts[place] - (np.cumsum(many) - many), many)
            e = np.repeat(e, many)
            more = np.bincount(np.repeat(row, many) * len(ids) + at[line], weights=e * (e - 2 * counts[line]), minlength=len(series) * len(ids))
            d = np.tile(sums, len(series)) + more.astype(np.int64)  # whole numbers far below 2^53
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.tile(np.arange(len(ids)), len(series)))), series.take(pa.array(np.repeat(np.arange(len(series)), len(ids)))), pa.array(d)], names=schema.names)

    deal = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    dealt = lambda k, seed: F.pmod(F.xxhash64("series_id", F.lit(seed)), F.lit(k)).cast("int")
    first = asked.select(dealt(blocks, 0).alias("block"), "*").select("block", deal(salts).alias("salt"), F.lit(0).alias("kind"), "series_id", "words", "n")
    body = rows(bags).select(deal(blocks).alias("block"), dealt(salts, 1).alias("salt"), F.lit(1).alias("kind"), "series_id", "words", "n")
    line = first.unionByName(body).repartitionById(blocks * salts, F.col("block") * salts + F.col("salt")).sortWithinPartitions("block", "salt", "kind")
    return line.mapInArrow(run, schema)


def _by_word(queries: pa.Table) -> tuple[pa.Array, np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of query bags: ids, sums of squared counts, the different words, and by word (from starts[k] to starts[k + 1]) the
    queries that have it and their counts."""
    ids, words, n = (queries.column(c).combine_chunks() for c in range(3))
    row = np.repeat(np.arange(len(ids)), pc.list_value_length(words).to_numpy())
    counts, coded = n.flatten().to_numpy(), words.flatten().dictionary_encode()
    sums = np.bincount(row, weights=counts * counts, minlength=len(ids)).astype(np.int64)
    some = coded.is_valid().to_numpy(zero_copy_only=False)  # no word equals a null one
    place, row, counts = coded.indices.drop_null().to_numpy(), row[some], counts[some]
    order = np.argsort(place, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(coded.dictionary)))])
    return ids, sums, coded.dictionary, starts, row[order], counts[order]
