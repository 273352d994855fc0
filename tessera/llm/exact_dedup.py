"""Exact deduplication by progressive refinement, in column expressions only.

Texts are equal when they are identical without white space. Rows are first grouped by length and by the hash of a prefix,
for which only the beginning of a text is normalised, as a rule; only groups of two or more survive. Survivors are marked
in a bitmap of fixed size over row keys, so that the second pass normalises and hashes the full content of surviving rows
alone, without moving any text: a false hit in the bitmap costs one more hash and nothing else. Full hashes then decide.
Where every row's hash is asked for, one pass gives all three.

Defined cases: a null text is empty, and empty texts equal each other; of equal texts the one with the most code points
stays, then the smallest id (null ids come last); rows that repeat an id and its text are flagged alike where no row key
is given, while ``dedup`` keeps exactly one row of each group; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, keyed, materialise, text_or_empty

#: White space that does not count.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
#: Characters that the prefix hash covers, and those at the beginning of a text in which they are looked for first.
PREFIX, BEGINNING = 128, 512
#: Words of 64 bits in the survivors' bitmap: 1 MB at most, whatever the input. A full bitmap means hashing every row.
WORDS = 1 << 17


def normalised(text: Column) -> Column:
    for c in SPACE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _length(text: Column) -> Column:
    """Code points of the normalised text. White space has one byte each, so that bytes tell how many there are."""
    return F.length(text) - (F.octet_length(text) - F.octet_length(normalised(text)))


def _prefix(text: Column) -> Column:
    """The first ``PREFIX`` characters of the normalised text, from its beginning where that holds so many."""
    begun = F.substring(normalised(F.substring(text, 1, BEGINNING)), 1, PREFIX)
    enough = (F.length(begun) == PREFIX) | (F.length(text) <= BEGINNING)
    return F.when(enough, begun).otherwise(F.substring(normalised(text), 1, PREFIX))


_BIT = f"cast(pmod(xxhash64(row), {WORDS * 64}) as int)"


def _bitmap(rows: DataFrame) -> DataFrame:
    """Rows (word, bits): the words of the bitmap in which some bit of ``rows`` (row) is set; at most ``WORDS``."""
    return rows.select(F.expr(_BIT).alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, bit & 63)")).alias("bits"))


def _survivors(rows: DataFrame) -> DataFrame:
    """``rows`` with ``candidate``: whether another row shares length and prefix hash."""
    group = ["length", "prefix_hash"]
    # Written out, so that the join has an exchange on either side and a hot group's partition can be split.
    surviving = materialise(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n").withColumn("candidate", F.lit(True)), "surviving")
    return rows.join(surviving, group, "left").withColumn("candidate", F.coalesce("candidate", F.lit(False)))


def _keys(docs: DataFrame, id_col: str, text_col: str, row_col: str | None, digest_all: bool) -> DataFrame:
    """doc_id, row (where asked for), points, length, prefix_hash, candidate, full_hash: null for rows that aren't candidates, unless all are asked for."""
    text = text_or_empty(text_col)
    row = [] if row_col is None else [F.col(row_col).alias("row")]
    narrow = [F.col(id_col).alias("doc_id"), *row, F.length(text).alias("points")]
    if digest_all or not row:
        whole = docs.select(*narrow, normalised(text).alias("norm")).select(
            "doc_id", *(["row"] if row else []), "points", F.length("norm").alias("length"), F.xxhash64(F.substring("norm", 1, PREFIX)).alias("prefix_hash"), F.sha2("norm", 256).alias("full_hash")
        )
        keys = _survivors(materialise(whole, "digests"))
        return keys if digest_all else keys.withColumn("full_hash", F.when(F.col("candidate"), F.col("full_hash")))
    first = materialise(docs.select(*narrow, _length(text).alias("length"), F.xxhash64(_prefix(text)).alias("prefix_hash")), "prefixes")
    keys = materialise(_survivors(first), "candidates")
    bits = _bitmap(keys.where("candidate"))
    marked = docs.select(row[0], text.alias("text")).withColumn("word", F.shiftright(F.expr(_BIT), 6)).join(F.broadcast(bits), "word").where(F.expr(f"bits & shiftleft(1L, {_BIT} & 63)") != 0)
    hashed = materialise(marked.select("row", F.sha2(normalised(F.col("text")), 256).alias("full_hash")), "digests")
    return keys.join(hashed, "row", "left").withColumn("full_hash", F.when(F.col("candidate"), F.col("full_hash")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False, row_col: str | None = None) -> DataFrame:
    """Per row: doc_id, keep_id (the row of its group that stays), group_size, kept, and full_hash.

    With ``row_col``, a column that tells all rows apart, ``row`` comes too and ``kept`` holds for one row of each group:
    of rows with one id and equally long texts the least ``row``.

    ``full_hash`` is the SHA-256 of the normalised text for rows that reached the last refinement, else null;
    ``digest_all`` asks for it on every row, for callers that return it.
    """
    row = [] if row_col is None else ["row"]
    keys = materialise(_keys(docs, id_col, text_col, row_col, digest_all), "keys")
    group = ["length", "prefix_hash", "full_hash"]
    stays = F.max(F.struct("points", F.col("doc_id").isNotNull().alias("known"), (-F.col("doc_id")).alias("low"), *((-F.col(r)).alias(r) for r in row)))
    # Written out, so that the join below has an exchange on either side and a hot group's partition can be split.
    groups = materialise(
        keys.where("candidate").groupBy(*group).agg(F.count(F.lit(1)).alias("group_size"), stays.alias("stays")).where("group_size > 1"),
        "groups",
    )
    kept = F.col("group_size").isNull() | (F.col("row") == -F.col("stays.row")) if row else F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return (
        keys.join(groups, group, "left")
        .withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(-F.col("stays.low")))
        .select("doc_id", *row, "keep_id", F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), "full_hash")
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with all their columns."""
    rows = keyed(docs)
    dropped = exact_groups(rows, id_col, text_col, row_col=ROW).where("not kept").select(F.col("row").alias(ROW))
    return rows.join(dropped, ROW, "left_anti").select(*docs.columns)
