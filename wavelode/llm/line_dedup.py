"""Line dedup: lines within a few edits of each other, by a segment-partition edit join; DataFrame functions only.

A line of l bytes is cut into most + 1 segments. A line within `most` edits leaves one of them whole,
at a place that the difference of lengths and the segment's number confine to few starts. So every
line is indexed by its segments and probes with its substrings at those starts, for each length it may
meet. Keys are hashes of (length, segment number, bytes). Lines that share a key with many others get a
sketch of character counts, of which an edit changes at most two bits, and one of the counts of pairs
of neighbours, of which it changes at most four; pairs further apart than that don't leave the join.
Such keys are also split by fifths of the first sketch (for two edits), of which close lines share one.
What is left is verified by a banded bit-parallel edit distance on the pair's bytes, after their common
ends are cut off.

deduplicated() carries the classes back to every line of every document: of a class one line stays, and
the texts are built again without the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT, distilled, kind_of, maybe_in, stored
from .components import components
from .exact_dedup import located

MOST_EDITS, MIN_BYTES = 2, 20
#: members() and deduplicated() allow a line an edit for every so many bytes, MOST_EDITS at most.
BYTES_PER_EDIT = 10
#: Trimmed from both ends of a line; lines end at \n.
BLANKS = " \t\r\f\v"
#: Classes of characters, and of pairs of them, that a sketch counts in two bits each.
CLASSES, PAIR_CLASSES = 31, 62
#: Keys of more lines than HOT_ROWS are split by sketches, but at most HOT_KEYS of them, the fullest
#: ones: so many rows of 9 bytes are broadcast, however large the input is.
HOT_ROWS, HOT_KEYS = 8, 1 << 18
#: A row's Parquet file and its number there.
PLACE = ["file", "at"]
#: Columns after which the verification looks whether a pair can still be within bounds.
BLOCK = 16


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, line): the lines of every text, trimmed, empty ones left out; null texts have none."""
    split = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return split.withColumn("line", F.btrim("line", F.lit(BLANKS))).where("line <> ''")


def sketches(line: Column) -> Column:
    """Struct of three longs: counts of characters (one) and of pairs of neighbours (two, three), by class
    of their code points, modulo 4 in Gray code, so that one more or fewer flips one bit.

    An edit of one byte touches one character of each line at most, so it changes two counts of
    characters and four of pairs at most, in any script.
    """
    add = lambda s, at: f"({s} & ~shiftleft(3L, 2 * ({at}))) | shiftleft((shiftright({s}, 2 * ({at})) + 1L) & 3L, 2 * ({at}))"
    pair = f"int(pmod((a.last * 1000003L + p) % 2147483647L * 69621L, {PAIR_CLASSES * 1021}L) / 1021)"
    half = PAIR_CLASSES // 2
    step = let("p", "ascii(c)", let("q", pair, f"""named_struct('last', int(p),
      'one', {add("a.one", f"p % {CLASSES}")}, 'two', if(q < {half}, {add("a.two", "q")}, a.two),
      'three', if(q < {half}, a.three, {add("a.three", f"q - {half}")}))"""))  # fmt: skip
    counts = f"aggregate(split(x, ''), named_struct('last', 0, 'one', 0L, 'two', 0L, 'three', 0L), (a, c) -> {step})"
    gray = lambda v: f"({v} ^ (shiftright({v}, 1) & 6148914691236517205L))"
    return F.expr(let("x", line, let("s", counts, f"named_struct('one', {gray('s.one')}, 'two', {gray('s.two')}, 'three', {gray('s.three')})")))


def segment_rows(base: DataFrame, most: int, probing: bool) -> DataFrame:
    """(id, size, key) of base (id, bytes, size): keys of its own segments, or those it probes with.

    Of a line shorter by `less`, segment i (from 0) may lie off by -i to i, counted from the left,
    and by less - (most - i) to less + (most - i), counted from the right. These choices are rows of a
    constant array and the key one expression of them, so that the generated code stays small.
    """
    choices = [
        (less, i, off)
        for less in range(most + 1 if probing else 1)
        for i in range(most + 1)
        for off in (range(max(-i, less - most + i), min(i, less + most - i) + 1) if probing else (0,))
    ]
    field = lambda k: F.shiftright("choice", 8 * k).bitwiseAND(255)
    packed = F.array(*[F.lit(less | i << 8 | off + most << 16) for less, i, off in choices])
    rows = base.select("id", "size", "bytes", F.explode(packed).alias("choice"))
    length, i = F.col("size") - field(0), field(1)
    rows = rows.select("id", "size", "bytes", length.alias("length"), i.alias("i"), (field(2) - most).alias("off"))
    short, longer = F.expr(f"length div {most + 1}").cast("int"), F.col("length") % (most + 1)
    start = short * F.col("i") + F.greatest(F.lit(0), F.col("i") - (most + 1 - longer)) + F.col("off")
    long = short + F.when(F.col("i") >= most + 1 - longer, 1).otherwise(0)
    rows = rows.where((start >= 0) & (start + long <= F.col("size")))
    return rows.select("id", "size", F.xxhash64("length", "i", F.substring("bytes", start + 1, long)).alias("key"))


def hot_keys(index: DataFrame) -> DataFrame:
    """(key, hot): the keys that more than HOT_ROWS lines are indexed by, or if these exceed HOT_KEYS,
    those of them above the next power of two that leaves no more."""
    many = stored(index.groupBy("key").count().where(F.col("count") > HOT_ROWS), "line-hot-keys")
    least, kept = HOT_ROWS, 0
    for row in many.groupBy(F.floor(F.log2("count")).alias("power")).agg(F.count("*").alias("keys")).orderBy(F.desc("power")).collect():
        kept += row["keys"]
        if kept > HOT_KEYS:
            least = 2 ** (row["power"] + 1) - 1
            break
    return many.where(F.col("count") > least).select("key", F.lit(True).alias("hot"))


def split_hot(rows: DataFrame, marks: DataFrame, most: int) -> DataFrame:
    """(id, size, key, one, two, three): rows (id, size, key) with their sketches, by parts of the first."""
    parts, width = 2 * most + 1, 2 * CLASSES // (2 * most + 1)
    part = lambda p: F.shiftright("one", width * p).bitwiseAND((1 << width) - 1)
    fine = F.array(*[F.xxhash64("key", F.lit(p), part(p)) for p in range(parts)])
    return rows.join(marks, "id").select("id", "size", "one", "two", "three", F.explode(fine).alias("key"))


def candidates(distinct: DataFrame, most: int) -> DataFrame:
    """(a, b): pairs of ids of distinct (id, line) that share a segment, by a hot key only those with
    close sketches; a pair stands once. Lines themselves don't travel with their keys."""
    base = distinct.select("id", F.col("line").cast("binary").alias("bytes"), F.octet_length("line").alias("size"))
    index, probes = segment_rows(base, most, probing=False), segment_rows(base, most, probing=True)
    hot = hot_keys(index)
    order = (F.col("i.size") < F.col("p.size")) | ((F.col("i.size") == F.col("p.size")) & (F.col("i.id") < F.col("p.id")))
    meet = (F.col("i.key") == F.col("p.key")) & order & (F.col("p.size") - F.col("i.size") <= most)
    few = [rows.join(F.broadcast(hot), "key", "left_anti") for rows in (index, probes)]
    pairs = few[0].alias("i").join(few[1].alias("p"), meet).select(F.col("i.id").alias("a"), F.col("p.id").alias("b"))
    many = [stored(rows.join(F.broadcast(hot), "key", "left_semi").select("id", "size", "key"), "line-hot-rows") for rows in (index, probes)]
    if not many[0].isEmpty():
        ids = many[0].select("id").unionByName(many[1].select("id")).distinct()
        lines = maybe_in(distinct.select("id", "line"), "id", ids).join(ids, "id", "left_semi")
        marks = stored(lines.select("id", sketches("line").alias("s")).select("id", "s.*"), "line-sketches")
        i, p = (split_hot(rows, marks, most).alias(name) for rows, name in zip(many, "ip", strict=True))
        apart = lambda *names: sum((F.bit_count(F.col(f"i.{n}").bitwiseXOR(F.col(f"p.{n}"))) for n in names), F.lit(0))
        near = (apart("one") <= 2 * most) & (apart("two", "three") <= 4 * most)
        pairs = pairs.unionByName(i.join(p, meet & near).select(F.col("i.id").alias("a"), F.col("p.id").alias("b")))
    return pairs.distinct()


def let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def edit_distance(x: str, y: str, most: int) -> Column:
    """The edit distance of two binary columns where it is at most `most`; otherwise some larger number.

    One long holds the vertical differences of a column of the distance table within `most` of the
    diagonal, rows j - most to j + most, moved down a row at each column j; d is the distance in the
    lowest of them. Rows past the end of x match nothing, and are taken off again at the end.
    """
    k, wide = most, (1 << 2 * most + 1) - 1
    powers = "reverse(sequence(0, int(log2(greatest(1, least(octet_length(x), octet_length(y)))))))"
    ahead = f"""aggregate({powers}, 0, (p, s) -> if(p + shiftleft(1, s) <= least(octet_length(x), octet_length(y))
      and substring(x, p + 1, shiftleft(1, s)) = substring(y, p + 1, shiftleft(1, s)), p + shiftleft(1, s), p))"""
    behind = f"""aggregate({powers}, 0, (q, s) -> if(q + shiftleft(1, s) <= least(octet_length(x), octet_length(y)) - p
      and substring(x, octet_length(x) - q - shiftleft(1, s) + 1, shiftleft(1, s))
        = substring(y, octet_length(y) - q - shiftleft(1, s) + 1, shiftleft(1, s)), q + shiftleft(1, s), q))"""
    core = lambda v: f"substring({v}, p + 1, octet_length({v}) - p - q)"
    match = " | ".join(f"if(get(c.xs, j - {k + 1 - o}) = get(c.ys, j - 1), {1 << o}L, 0L)" for o in range(2 * k + 1))
    horizontal = let("hp", f"(a.vn | ~(d0 | a.vp)) & {wide}L", f"""named_struct(
      'vp', ((d0 & a.vp) | ~(shiftright(d0, 1) | hp)) & {wide}L, 'vn', shiftright(d0, 1) & hp,
      'd', a.d + 1 - int(shiftright(d0, {2 * k}) & 1L))""")
    column = let("m", match, let("d0", f"((((m & a.vp) + a.vp) ^ a.vp) | m | a.vn) & {wide}L", horizontal))
    begin = f"named_struct('vp', {sum(1 << o for o in range(2 * k + 1) if 1 - k + o >= 1)}L, 'vn', 0L, 'd', {k})"
    table = f"""aggregate(sequence(1, c.n, {BLOCK}), {begin}, (b, at) -> if(b.d - bit_count(b.vp) > {k}, b,
      aggregate(sequence(at, least(c.n, at + {BLOCK - 1})), b, (a, j) -> {column})),
      e -> if(e.d - bit_count(e.vp) > {k}, {k + 1},
        e.d - bit_count(e.vp & (shiftleft(1L, {2 * k}) - shiftleft(1L, c.m - c.n + {k})))
            + bit_count(e.vn & (shiftleft(1L, {2 * k}) - shiftleft(1L, c.m - c.n + {k})))))"""
    verified = let("c", f"""named_struct('m', octet_length({core('x')}), 'n', octet_length({core('y')}),
      'xs', split(decode({core('x')}, 'ISO-8859-1'), ''), 'ys', split(decode({core('y')}, 'ISO-8859-1'), ''))""",
      f"if(c.m = 0 or c.n = 0, greatest(c.m, c.n), {table})")
    inner = let("p", ahead, let("q", behind, verified))
    whole = let("x", x, let("y", y, f"if(abs(octet_length(x) - octet_length(y)) > {k}, {k + 1}, {inner})"))
    return F.expr(whole)


def line_links(distinct: DataFrame, most: int) -> DataFrame:
    """(a, b): ids of all pairs of distinct (id, line) within `most` edits, each once."""
    pairs = stored(candidates(distinct, most), "line-candidates")
    of_a = maybe_in(distinct, "id", pairs.select(F.col("a").alias("id"))).select(F.col("id").alias("a"), F.col("line").cast("binary").alias("left_bytes"))
    of_b = maybe_in(distinct, "id", pairs.select(F.col("b").alias("id"))).select(F.col("id").alias("b"), F.col("line").cast("binary").alias("right_bytes"))
    texts = pairs.join(of_a, "a").join(of_b, "b")
    return texts.where(edit_distance("left_bytes", "right_bytes", most) <= most).select("a", "b")


def close_links(distinct: DataFrame, most: int, min_bytes: int, per_edit: int | None) -> DataFrame:
    """(a, b): ids of linked lines, each pair once. Lines under min_bytes take part with per_edit alone: the
    shorter line of a pair then allows an edit for every per_edit bytes."""
    size, rows = F.octet_length("line"), distinct.select("id", "line")
    links = line_links(rows.where(size >= min_bytes), most)
    if per_edit is None:
        return links
    for edits in range(1, most):  # the lines that allow so many edits, and those that are longer by so many bytes
        links = links.unionByName(line_links(rows.where((size >= per_edit * edits) & (size < per_edit * (edits + 1) + edits)), edits))
    return links.distinct()


def line_classes(docs: DataFrame, most: int = MOST_EDITS, min_bytes: int = MIN_BYTES, per_edit: int | None = None) -> DataFrame:
    """One row per different line of all texts: line, line_md5, n (times it stands), first_doc (smallest
    doc_id), n_links (other lines within `most` edits), class_id (smallest line_md5 reachable over
    links, itself included), class_doc (smallest doc_id of any line of the class).

    Lines end at a newline, are trimmed of ASCII blanks and compared as they are; empty ones don't
    count. Edits insert, delete or replace one byte of UTF-8, so an accent more or less takes up to two.
    Lines under min_bytes link with nothing, unless per_edit is given: then the shorter line of a pair
    allows an edit for every per_edit bytes, up to `most`. Null and empty texts have no lines, null doc_ids count in
    n and are never first, other columns are ignored; an empty table gives an empty result.
    """
    if min_bytes <= most:
        raise ValueError("min_bytes must exceed the edits, so that no segment is empty")
    if per_edit is not None and (per_edit < 2 or per_edit * most != min_bytes):
        raise ValueError("min_bytes must be where `most` edits begin")
    groups = lines(docs).groupBy("line").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
    distinct = stored(groups.withColumn("id", F.monotonically_increasing_id()), "lines")
    links = stored(close_links(distinct, most, min_bytes, per_edit), "line-links")
    ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("n_links"))
    linked = ends.join(components(links).withColumnRenamed("node", "id"), "id")
    rows = distinct.withColumn("line_md5", F.md5(F.col("line").cast("binary")))
    inside = stored(maybe_in(rows, "id", linked.select("id")).join(linked, "id").select("id", "line_md5", "first_doc", "n_links", "root"), "line-members")
    classes = inside.groupBy("root").agg(F.min("line_md5").alias("class_id"), F.min("first_doc").alias("class_doc"))
    named = stored(inside.select("id", "n_links", "root").join(classes, "root").drop("root"), "line-named")
    near = maybe_in(rows, "id", named.select("id")).join(named, "id", "left")
    far = maybe_in(rows, "id", named.select("id"), inside=False)
    alone = [F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("string").alias("class_id"), F.lit(None).cast(kind_of(docs, "doc_id")).alias("class_doc")]
    everything = near.select(*far.columns, "n_links", "class_id", "class_doc").unionByName(far.select("*", *alone))
    return everything.select(
        "line", "line_md5", "n", "first_doc", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("class_id", "line_md5").alias("class_id"), F.coalesce("class_doc", "first_doc").alias("class_doc"),
    )


def numbered(docs: DataFrame) -> DataFrame:
    """(file, at, doc_id, text): a Parquet file and the row in it tell rows apart, as ids may repeat or be
    null. Rows that don't come straight from files, or share a file's row, are written first."""
    rows = located(docs)
    if rows.select("locator").distinct().count() < rows.count():
        rows = located(stored(docs.select("doc_id", "text"), "line-docs"))
    return rows.select(F.col("locator.file").alias("file"), F.col("locator.row").alias("at"), "doc_id", "text")


def placed_lines(base: DataFrame) -> DataFrame:
    """(file, at, doc_id, pos, h, digest): every line of numbered rows; h is a hash of its text, digest the line's MD5."""
    split = base.select(*PLACE, "doc_id", F.xxhash64("text").alias("h"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    split = split.withColumn("line", F.btrim("line", F.lit(BLANKS))).where("line <> ''")
    return split.select(*PLACE, "doc_id", "pos", "h", F.unhex(F.md5(F.col("line").cast("binary"))).alias("digest"))


def occurrences(base: DataFrame, most: int, per_edit: int) -> DataFrame:
    """(file, at, pos, class, h, leads), written: the lines of numbered rows that repeat or have links; leads:
    the row has the smallest id of the class. Lines are told apart by their MD5, as in line_classes."""

    def several() -> DataFrame:
        rows = line_classes(base, most, per_edit * most, per_edit).where("n > 1 or n_links > 0")
        return rows.select(F.unhex("line_md5").alias("digest"), "n", F.unhex("class_id").alias("class"), "class_doc")

    # What the search for links wrote, all lines among it, isn't needed after this.
    known = distilled(several, "line-several")
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # Lines with over 1 / HOT of these places, HOT at most, are dealt over salts.
    hot = F.broadcast(known.where(F.col("n") > total / HOT).select("digest", F.ceil(F.col("n") * HOT / F.lit(max(total, 1))).cast("int").alias("salts")))
    salts = F.coalesce("salts", F.lit(1))
    keys = known.join(hot, "digest", "left").select("digest", "class", "class_doc", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    rows = placed_lines(base).join(hot, "digest", "left").withColumn("salt", F.pmod(F.xxhash64(*PLACE, "pos"), salts).cast("int"))
    found = rows.join(keys, ["digest", "salt"])
    return stored(found.select(*PLACE, "pos", "class", "h", F.col("doc_id").eqNullSafe(F.col("class_doc")).alias("leads")), "line-places")


def firsts(found: DataFrame) -> DataFrame:
    """(file, at, pos) of the line that stays of each class: the first place in the smallest id; of rows with
    that id, by the hash of their texts."""
    first = F.min(F.struct("pos", "h", *PLACE)).alias("first")
    return found.where("leads").groupBy("class").agg(first).select("first.file", "first.at", "first.pos")


def members(docs: DataFrame, most: int = MOST_EDITS, per_edit: int = BYTES_PER_EDIT) -> DataFrame:
    """Every line of every row of docs: doc_id, pos (from 0, empty lines counted), line_md5, class_id and kept.

    Lines and classes as in line_classes, but a pair may differ by an edit for every per_edit bytes of
    its shorter line, up to `most`. Of each class one line is kept: the first one in the smallest doc_id
    (null ids come last). Repeated rows give repeated rows, of which one at most is kept.
    """
    base, at = numbered(docs), [*PLACE, "pos"]
    found = occurrences(base, most, per_edit)
    # By place, not by class: one class may hold a large part of all lines.
    marked = found.select(*at, "class").join(firsts(found).withColumn("first", F.lit(True)), at, "left")
    every = placed_lines(base).join(marked, at, "left")
    hexed = lambda c: F.lower(F.hex(c))
    return every.select(
        "doc_id", "pos", hexed("digest").alias("line_md5"), hexed(F.coalesce("class", "digest")).alias("class_id"),
        F.coalesce("first", F.col("class").isNull()).alias("kept"),
    )


def deduplicated(docs: DataFrame, most: int = MOST_EDITS, per_edit: int = BYTES_PER_EDIT) -> DataFrame:
    """Per row of docs: doc_id, text without the lines that members() doesn't keep, n_lines and n_kept.

    Other lines, empty ones too, stay as they are and in order. A null text stays null. Texts are
    shuffled once, to the places of the lines that go.
    """
    base = numbered(docs)
    found = occurrences(base, most, per_edit)
    places = found.groupBy(*PLACE).agg(F.collect_list("pos").alias("places"))
    stay = firsts(found).groupBy(*PLACE).agg(F.collect_list("pos").alias("stay"))
    gone = F.when(F.col("stay").isNull(), F.col("places")).otherwise(F.array_except("places", "stay"))
    marks = places.join(stay, PLACE, "left").select(*PLACE, gone.alias("gone"))
    n_lines = F.coalesce(F.expr("cast(size(filter(split(text, '\n', -1), x -> btrim(x, ' \t\r\f\u000B') <> '')) as long)"), F.lit(0).cast("long"))
    rest = let("p", "split(text, '\n', -1)", "array_join(transform(array_except(sequence(0, size(p) - 1), gone), i -> get(p, i)), '\n')")
    rows = base.join(marks.hint("shuffle_hash"), PLACE, "left").withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(n_lines))
    return rows.select(
        "doc_id", F.when(F.size("gone") > 0, F.expr(rest)).otherwise(F.col("text")).alias("text"),
        "n_lines", (F.col("n_lines") - F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))).alias("n_kept"),
    )
