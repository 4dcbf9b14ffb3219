"""Secrets in texts: patterns that tell by themselves, and weak candidates that tell only together.

A password, an access key or a long hexadecimal run is reported wherever it stands. Names of accounts,
opaque tokens and addresses stand in many harmless texts; such a weak part is reported only where parts
that complete it, an identifier, a secret and maybe an endpoint, lie within reach in the same paragraph.
The parts meet in an interval join on document, paragraph and stretch of text.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kind_of, stored


def either_case(words: str) -> str:
    """Alternatives whose ASCII letters may have either case; nothing else folds."""
    return "(?:" + re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words) + ")"


VALUE = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = either_case("password|passwd|secret|token|api_?key") + VALUE + "([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"  # what a run of fewer than 20 would take, no later match could use
HEX = "[0-9a-f]{24,}"
IDENT = either_case("(?:access|account|client|user|app)[_-]?(?:id|key_?id|name)") + VALUE + "([A-Za-z0-9@/_.+-]+)"
OPAQUE = "[A-Za-z0-9+/_=-]{16,}"
ENDPOINT = r"""[A-Za-z][A-Za-z0-9+.-]*://[^\x20\x09-\x0D"'<>]+|""" + either_case("endpoint|hostname|host|server") + VALUE + "[A-Za-z0-9._:/-]{4,}"
#: Where a paragraph ends.
BREAK = r"\n[\x20\x09\x0B-\x0D]*\n"
#: In the order of equal starts. The first three are the patterns that tell by themselves.
KINDS = ("assign", "access", "hex", "ident", "opaque", "endpoint")
LEAST_VALUE = {"assign": 6, "ident": 4}
#: Code points between a weak part and one that completes it, at most; also the length of a stretch.
REACH = 200

_RE = {k: re.compile(p.encode()) for k, p in zip(KINDS, (ASSIGN, ACCESS, HEX, IDENT, OPAQUE, ENDPOINT), strict=True)}
_BREAK = re.compile(BREAK.encode())
#: One of these stands in lower-cased bytes that the pattern can match; others needn't be searched.
_SIGNS = {"assign": (b"passw", b"secret", b"token", b"apikey", b"api_key"), "ident": (b"access", b"account", b"client", b"user", b"app")}
_DIGIT, _LETTER = re.compile(rb"[0-9]"), re.compile(rb"[A-Za-z]")


def matches(kind: str, data: bytes) -> list[tuple[int, int]]:
    """Leftmost non-overlapping byte spans of a kind, without those that fail its other conditions."""
    found = _RE[kind].finditer(data)
    if kind in LEAST_VALUE:
        return [m.span() for m in found if m.end() - m.start(1) >= LEAST_VALUE[kind]]
    if kind == "opaque":
        return [m.span() for m in found if _DIGIT.search(m[0]) and _LETTER.search(m[0])]
    return [m.span() for m in found]


def apart(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans that overlap none of taken."""
    ends, taken = [], sorted(taken)
    for _, end in taken:
        ends.append(max(end, ends[-1] if ends else 0))
    starts = [s for s, _ in taken]
    return [(a, b) for a, b in spans if (k := bisect_left(starts, b)) == 0 or ends[k - 1] <= a]


def scanned(data: bytes) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, int]]]:
    """Base spans (kind, start, end) of a UTF-8 text in code points, and the parts (kind, start, end,
    paragraph) of a text in which some weak part may be completed."""
    low = data.lower()  # bytes: A-Z only
    may = lambda kind: any(s in low for s in _SIGNS[kind])
    found = {"assign": matches("assign", data) if may("assign") else [], "access": matches("access", data) if b"AKIA" in data else [], "hex": matches("hex", data)}
    base = [s for spans in found.values() for s in spans]
    found["ident"] = apart(matches("ident", data), base) if (b"=" in data or b":" in data) and may("ident") else []
    parts = []
    if found["access"] or found["ident"]:  # nothing is completed without an identifier
        found["endpoint"] = matches("endpoint", data)
        found["opaque"] = apart(matches("opaque", data), base + found["ident"] + found["endpoint"])
        parts = [(k, *s) for k, spans in found.items() for s in spans]
    if not base and not parts:
        return [], []
    breaks = [m.start() for m in _BREAK.finditer(data)] if parts else []
    offsets = sorted({p for _, *span in parts for p in span} | {p for span in base for p in span})
    points, at, count = {}, 0, 0
    for p in offsets:
        count += len(data[at:p].decode(errors="surrogateescape"))
        points[p], at = count, p
    spans = [(k, points[a], points[b]) for k in KINDS[:3] for a, b in found[k]]
    return spans, [(k, points[a], points[b], bisect_left(breaks, a)) for k, a, b in parts]


def spelled(spans: str) -> str:
    """An expression: an array of (start, place in KINDS, end) as kind:start:end, in order, joined by commas."""
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform(array_sort({spans}), s -> concat_ws(':', element_at(array({kinds}), s.kind + 1), s.start, s.end)), ',')"


SPANS = "array<struct<start:int,kind:int,end:int>>"
PARTS = "array<struct<kind:int,start:int,end:int,scope:int>>"


def located(docs: DataFrame) -> DataFrame:
    """(row, doc_id, base, parts) of each row of docs, written: `row` numbers the rows, also repeated ones."""

    def work(batches):
        kinds = {k: i for i, k in enumerate(KINDS)}
        for batch in batches:
            base, parts = [], []
            for text in batch.column(2).to_pylist():
                spans, some = scanned(text or b"")
                base.append([{"start": a, "kind": kinds[k], "end": b} for k, a, b in spans])
                parts.append([{"kind": kinds[k], "start": a, "end": b, "scope": s} for k, a, b, s in some])
            i = pa.int32()
            types = [pa.list_(pa.struct([(n, i) for n in names])) for names in (("start", "kind", "end"), ("kind", "start", "end", "scope"))]
            columns = [batch.column(0), batch.column(1), pa.array(base, types[0]), pa.array(parts, types[1])]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "base", "parts"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("binary").alias("t"))
    return stored(rows.mapInArrow(work, f"row long, doc_id {kind_of(docs, 'doc_id')}, base {SPANS}, parts {PARTS}"), "secret-parts")


def linked(rows: DataFrame, reach: int = REACH) -> DataFrame:
    """(row, more): the weak parts of located() rows that others complete, as spans.

    An opaque token needs an access key within reach, or a named account and an endpoint; a named account
    needs an assignment or hexadecimal run, or an opaque token and an endpoint; an endpoint needs an
    identifier and a secret of whatever strength. All lie in one paragraph.

    Each part is registered in every stretch of `reach` code points that it touches. Per stretch and kind
    only the least start and the greatest end are kept, which tell exactly whether any part lies within
    reach: two parts of one stretch can't lie on different sides of what is that far from both. So no
    pair of parts becomes a row, however many stand together.
    """
    kind = {k: i for i, k in enumerate(KINDS)}
    parts = rows.where("size(parts) > 0").select("row", F.explode("parts").alias("p")).select("row", "p.*")
    touched = parts.withColumn("stretch", F.explode(F.expr(f"sequence(start div {reach}, (end - 1) div {reach})")))
    groups = {"id": ["access"], "name": ["ident"], "strong": ["assign", "hex"], "token": ["opaque"], "place": ["endpoint"]}
    ends = []
    for name, kinds in groups.items():
        own = F.col("kind").isin(*[kind[k] for k in kinds])
        ends += [F.min(F.when(own, F.col("start"))).alias(f"{name}_from"), F.max(F.when(own, F.col("end"))).alias(f"{name}_to")]
    summary = touched.groupBy("row", "scope", "stretch").agg(*ends)
    weak = parts.where(F.col("kind").isin(kind["ident"], kind["opaque"], kind["endpoint"]))
    probes = weak.withColumn("stretch", F.explode(F.expr(f"sequence(greatest(start - {reach}, 0) div {reach}, (end + {reach}) div {reach})")))
    met = probes.join(summary, ["row", "scope", "stretch"])
    near = {n: F.coalesce(F.bool_or((F.col(f"{n}_from") <= F.col("end") + reach) & (F.col(f"{n}_to") >= F.col("start") - reach)), F.lit(False)).alias(n) for n in groups}
    seen = met.groupBy("row", "scope", "kind", "start", "end").agg(*near.values())
    of = lambda k: F.col("kind") == kind[k]
    whole = (
        (of("opaque") & (F.col("id") | (F.col("name") & F.col("place"))))
        | (of("ident") & (F.col("strong") | (F.col("token") & F.col("place"))))
        | (of("endpoint") & (F.col("id") | F.col("name")) & (F.col("strong") | F.col("token")))
    )
    return seen.where(whole).groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))


def find(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """(doc_id, base, spans) of each row of docs: arrays of (start, kind, end), kind as a place in KINDS, in
    code points, ends exclusive; base has what tells by itself, spans also completed weak parts.

    A null text is an empty one and has no spans; repeated rows have each their own; whole texts of any
    length are searched; other columns are ignored. An empty table gives an empty result.
    """
    rows = located(docs)
    more = linked(rows, reach).withColumnRenamed("row", "r")
    joined = rows.join(more, F.col("row") == F.col("r"), "left")
    spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", "more"))
    return joined.select("doc_id", "base", spans.alias("spans"))


def digests(docs: DataFrame) -> DataFrame:
    """find() as counts by base kind, the base spans' hash and all spans as text."""
    rows = find(docs)
    counts = [F.size(F.expr(f"filter(base, s -> s.kind = {i})")).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:3])]
    return rows.select("doc_id", *counts, F.sha2(F.expr(spelled("base")).cast("binary"), 256).alias("base_sha256"), F.expr(spelled("spans")).alias("spans"))
