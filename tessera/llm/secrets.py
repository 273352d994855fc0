"""Secret scans with corpus-wide ownership frequency, in column expressions only.

Patterns give candidate spans. The hash of each candidate's value is counted over the corpus by distinct repositories
and distinct owners: a value that many repositories share is a copied example, one that stays with few is live-looking.
Spans of the fixed patterns are always reported; free-standing random-looking strings are reported only where their
value is owner-specific.

Owners are distinct ids: a document's own copies don't make its secret a common one.

Defined cases: a null text is empty; a null repository counts as one repository, and all rows without an id as one owner;
repeated rows get the same spans each; ``redact`` replaces each row's own spans, whether its id is null or repeated, and
keeps null texts null; an empty table gives an empty result; further columns are kept by ``redact`` and ignored by
``scan``. Spans are in code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ROW, keyed, materialise, text_or_empty

# Kinds in report order, their patterns, the group that holds the value, and its least length. Maximal runs
# that are too short are no match of the second and third, which changes no other match.
KINDS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
]
#: Kinds that the method adds.
MORE_KINDS = [("random", r"[A-Za-z0-9+/_=-]{24,}", 0, 24)]
#: For speed: no text without a match of this holds a span (a run of hex digits under 16 can't become one).
ANY = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{14}|[0-9a-f]{16}|[A-Za-z0-9+/_=-]{24}"""

#: A value in at least so many repositories, of at least so many owners, is a copied example.
COPIED_REPOSITORIES, COPIED_OWNERS = 3, 3
#: What takes a live-looking secret's place.
PLACEHOLDER = "[SECRET]"

#: Code points of a block in which ``redact`` replaces spans.
BLOCK = 4096


def _pieces(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """Matches of one kind in order: kind, length of the gap before, length, whether its value is kept, and the value's hash."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.slice(F.split(text, pattern), 1, F.size(whole))
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[A-Z]") & v.rlike("[a-z]")
    keep = lambda v: (F.length(v) >= least) & (mixed(v) if kind >= len(KINDS) else F.lit(True))
    return F.transform(
        F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), value.alias("value")),
        lambda p: F.struct(
            F.lit(kind).alias("kind"), F.length(p["gap"]).alias("gap"), F.length(p["whole"]).alias("length"),
            F.when(keep(p["value"]), F.sha2(p["value"], 256)).alias("hash"),
        ),
    )


def may_hold_spans(text: Column) -> Column:
    return text.rlike(ANY)


def matches(text: Column) -> Column:
    """All matches of a text, kind by kind; positions follow from sums of the lengths (see ``_spans``)."""
    found = F.concat(*(_pieces(text, i, *k[1:]) for i, k in enumerate(KINDS + MORE_KINDS)))
    return F.when(may_hold_spans(text), found).otherwise(F.array().cast("array<struct<kind:int,gap:int,length:int,hash:string>>"))


def _spans(rows: DataFrame) -> DataFrame:
    """Spans of ``rows`` (row, pieces, ...): kind, start, end, hash; added kinds only where they overlap none of the fixed ones.

    Sums and bounds run in windows over a row's matches, so that the work grows with their number.
    """
    rest = [c for c in rows.columns if c != "pieces"]
    each = rows.where(F.size("pieces") > 0).select(*rest, F.posexplode("pieces").alias("place", "p")).select(*rest, "place", "p.*")
    before = Window.partitionBy("row", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("gap") + F.col("length")).over(before), F.lit(0)) + F.col("gap")
    spans = each.withColumn("start", start.cast("int")).withColumn("end", F.col("start") + F.col("length")).where("hash is not null")
    fixed = F.col("kind") < len(KINDS)
    so_far = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, -1)
    # Of the fixed spans that begin no later, one reaches in; or the next one begins inside.
    met = (F.max(F.when(fixed, F.col("end"))).over(so_far) > F.col("start")) | (F.min(F.when(fixed, F.col("start"))).over(later) < F.col("end"))
    return spans.withColumn("met", met).where(fixed | ~F.coalesce("met", F.lit(False))).select(*rest, "kind", "start", "end", "hash")


def ownership(found: DataFrame) -> DataFrame:
    """hash, repositories, owners (both distinct) of every candidate value in ``found`` (hash, repo, owner). Counted before rows of a value meet."""
    return found.groupBy("hash").agg(F.count_distinct("repo").alias("repositories"), F.count_distinct("owner").alias("owners"))


def judged_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, pieces) of every row, and (row, doc_id, kind, start, end, copied) of every candidate span.

    The texts are read once and leave the scan as lengths and hashes of matches.
    """
    rows = materialise(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.coalesce(F.col(repo_col), F.lit("")).alias("repo"),
            F.coalesce(F.col(owner_col or id_col).cast("string"), F.lit("")).alias("owner"),
            matches(text_or_empty(text_col)).alias("pieces"),
        ).withColumn("row", F.monotonically_increasing_id()),
        "matches",
    )
    spans = materialise(_spans(rows), "spans")
    # Written out, so that the join has an exchange on either side and the partition of a very common value can be split.
    owned = materialise(ownership(spans), "ownership")
    copied = (F.col("repositories") >= COPIED_REPOSITORIES) & (F.col("owners") >= COPIED_OWNERS)
    return rows.select("row", "doc_id", "pieces"), spans.join(owned, "hash").select("row", "doc_id", "kind", "start", "end", copied.alias("copied"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str | None = None) -> DataFrame:
    """Per row: doc_id and spans, an array of (start, kind, end, copied) without the values; each id is an owner, unless ``owner_col`` names one."""
    rows, judged = judged_spans(docs, id_col, text_col, repo_col, owner_col)
    reported = judged.where((F.col("kind") < len(KINDS)) | ~F.col("copied"))
    spans = reported.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "copied"))).alias("spans"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,copied:boolean>>").alias("spans")
    some = rows.where(F.size("pieces") > 0).select("row", "doc_id").join(spans, "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))
    return some.unionByName(rows.where(F.size("pieces") == 0).select("doc_id", none))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts and span lists of ``scan``'s rows as plain columns."""
    names = F.array(*(F.lit(k[0]) for k in KINDS + MORE_KINDS))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] < len(KINDS))
    count = lambda f: F.size(F.filter("spans", f)).cast("long")
    of_kind = lambda i: lambda s: s["kind"] == i
    return scanned.select(
        "doc_id",
        *(count(of_kind(i)).alias(f"n_{k[0]}") for i, k in enumerate(KINDS)),
        F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
        count(lambda s: ~s["copied"]).alias("n_live"),
        count(lambda s: s["copied"]).alias("n_copied"),
    )


def _merged(spans: DataFrame) -> DataFrame:
    """Disjoint stretches (row, start, end) of spans that overlap."""
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    new = (F.col("start") >= F.coalesce(F.max("end").over(before), F.lit(0))).cast("int")
    numbered = spans.withColumn("new", new).withColumn("stretch", F.sum("new").over(upto))
    return numbered.groupBy("row", "stretch").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("stretch")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source") -> DataFrame:
    """All rows, in which live-looking secrets are replaced; only rows that may hold some take part in a join.

    A text is cut into blocks, whose stretches are replaced apart: the work grows with the text, not with its square.
    """
    maybe, new = "_tessera_maybe", "_tessera_text"
    every = keyed(docs.withColumn(maybe, may_hold_spans(text_or_empty(text_col))))
    rows = every.where(F.col(maybe))
    found = judged_spans(rows.withColumn("_owner", F.col(id_col)), ROW, text_col, repo_col, owner_col="_owner")[1].where(~F.col("copied"))
    stretches = materialise(_merged(found.select(F.col("doc_id").alias("row"), "start", "end")), "stretches")
    inside = stretches.withColumn("block", F.explode(F.sequence(F.expr(f"start div {BLOCK}"), F.expr(f"(end - 1) div {BLOCK}"))))
    low = F.col("block") * BLOCK
    cut = F.struct(F.greatest(F.col("start") - low, F.lit(0)).alias("start"), F.least(F.col("end") - low, F.lit(BLOCK)).alias("end"), (F.col("start") >= low).alias("first"))
    cuts = inside.groupBy("row", "block").agg(F.array_sort(F.collect_list(cut)).alias("cuts"))
    texts = rows.select(F.col(ROW).alias("row"), F.col(text_col).alias("text")).join(stretches.select("row").distinct(), "row", "left_semi")
    blocks = texts.select("row", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))).alias("block", "part"))

    def step(state: Column, s: Column) -> Column:
        kept = F.substring(F.col("part"), state["at"] + 1, (s["start"] - state["at"]).cast("int"))
        return F.struct(F.concat(state["out"], kept, F.when(s["first"], PLACEHOLDER).otherwise("")).alias("out"), s["end"].cast("int").alias("at"))

    end = lambda s: F.concat(s["out"], F.substring(F.col("part"), s["at"] + 1, F.lit(BLOCK)))
    replaced = F.aggregate("cuts", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, end)
    done = blocks.join(cuts, ["row", "block"], "left").select("row", F.struct("block", F.when(F.col("cuts").isNull(), F.col("part")).otherwise(replaced).alias("part")).alias("p"))
    texts = done.groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["part"]), "").alias(new)).withColumnRenamed("row", ROW)
    changed = rows.join(texts, ROW, "left").withColumn(text_col, F.coalesce(new, text_col))
    return changed.select(*docs.columns).unionByName(every.where(~F.col(maybe)).select(*docs.columns))
