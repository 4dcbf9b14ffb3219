"""Helpers shared by the corpus operators: skew-proof lookups, sampling; storage is the library's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelode.sources.storage import distilled, shared_folder, stored

__all__ = ["distilled", "shared_folder", "stored"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words are runs of anything but these six characters, in Java's and RE2's notation.
WORD = r"[^\x20\x09-\x0D]+"
#: attach() broadcasts only the keys that hold more than one in HOT of all rows: at most HOT keys.
HOT = 1000
#: Bits of maybe_in()'s filter, 64 a row: at most FILTER_BITS / 64 rows of 16 bytes are broadcast,
#: however large the input is.
FILTER_BITS = 1 << 22


def packed(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """Column `row`, a struct of all of docs' columns, beside copies of those named. So an operator's own
    columns can't clash with docs'; select("row.*") gives docs' rows back."""
    return docs.select(F.struct("*").alias("row"), *columns)


def kind_of(rows: DataFrame, column: str) -> str:
    """A column's type, for a schema."""
    return dict(rows.dtypes)[column]


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else. lower() does just that to pure ASCII, and faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def attach(rows: DataFrame, groups: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with groups (unique key, and n: the rows that have it) without skew.

    Keys with more than total / HOT rows, at most HOT of them by counting, go by broadcast; no
    other key is large enough to slow the shuffled join of the rest. Null keys match nothing.
    """
    hot = groups.where(F.col("n") > total / HOT)
    cold = groups.where(F.col("n") <= total / HOT)
    return rows.join(F.broadcast(hot), key).unionByName(
        rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    )


def maybe_in(rows: DataFrame, key: str, members: DataFrame, inside: bool = True) -> DataFrame:
    """The rows whose key's hash is among the hashes of members' keys, or with inside=False the others.

    A filter before a join, so that rows that cannot match don't go through its shuffle. All rows with
    a key among members are inside, and some others; when the bitmap is full, all rows are. rows have no
    column named _bit, _slot or _mask.
    """
    bit = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    words = members.select(bit.alias("_bit")).groupBy(F.shiftright("_bit", 6).alias("_slot")).agg(
        F.bit_or(F.expr("shiftleft(1L, int(_bit & 63))")).alias("_mask")
    )
    found = rows.withColumn("_bit", bit).withColumn("_slot", F.shiftright("_bit", 6)).join(F.broadcast(words), "_slot", "left")
    hit = F.expr("coalesce(getbit(_mask, int(_bit & 63)) = 1, false)")
    return found.where(hit if inside else ~hit).select(*rows.columns)


def smallest(rows: DataFrame, hashed: Column, most: int, *ties: str) -> DataFrame:
    """The `most` rows with the smallest 30 bits of a hash (all, if there are fewer), the same ones on every run.

    A limit takes `most` rows from every task to one place, so rows whose hash is too large to be among
    them are left out first, by a bound with a fourfold margin, which widens where many rows repeat a
    few hashes. rows have no column named _h. The result is written.
    """
    bits = 1 << 30
    rows = rows.withColumn("_h", F.pmod(hashed, F.lit(bits)))
    total = rows.count()
    bound = min(bits, 4 * most * bits // max(total, 1))
    while True:
        found = stored(rows.where(F.col("_h") < bound).orderBy("_h", *ties).limit(most).drop("_h"), "sample")
        if bound == bits or found.count() >= min(most, total):
            return found
        bound = min(bits, bound * 16)


def labelled_sample(labels: DataFrame, label: str, keep: Column, most: int) -> DataFrame:
    """At most `most` rows (doc_id, label 0/1) of labels that pass keep, the same ones on every run.

    Rows without id or label are left out. Chosen by a hash of the id, so any order of the input
    gives the same rows; rows of one id stand side by side and count one each.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(
        keep & F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()
    )
    return smallest(rows, F.xxhash64("doc_id"), most, "doc_id", "label")


def id_remainder(column: str, by: int) -> Column:
    """crc32 of the id as text, modulo `by`; ids that are null count as the text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % by
