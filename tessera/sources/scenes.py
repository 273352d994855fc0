"""Scene documents by their sections: what each holds, which are missing, repeated or unknown, and values that fit no domain.

A document is parsed once, each section to a map of its children's names and contents. Which sections there are, and which
a document must have, is a fixed list; what stands inside them is left to readers of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import in_domain

# The sections of a scene by their parent, and whether a document must have them.
SECTIONS = {
    "SceneSettings": {
        "RecorderSettings": True, "TimeStepperSettings": True, "ContactParameterMap": True, "GlobalGeometries": False, "GlobalInitialCondition": False,
        "ExternalForces": False, "GlobalSelectiveIds": False, "Visualization": False, "MPISettings": False,
    },
    "SceneObjects": {"RigidBodies": True},
}
#: Sections of which a document may have several.
MANY = {"RigidBodies"}


def _names(xml: Column, parent: str) -> Column:
    """Names of the children of ``parent`` in order: the elements one level below its own."""
    inner = F.regexp_extract(xml, rf"(?s)<{parent}(?:\s[^>]*)?>(.*)</{parent}>", 1)
    marks = F.regexp_extract_all(F.regexp_replace(inner, r"(?s)<!--.*?-->", ""), F.lit(r"<(/?[A-Za-z_][\w.-]*)(?:\s[^>]*?)?(/?)>"), F.lit(0))

    def step(state: Column, mark: Column) -> Column:
        closes, empty = mark.startswith("</"), mark.endswith("/>")
        name = F.regexp_extract(mark, r"^<([\w.-]+)", 1)
        top = ~closes & (state["depth"] == 0)
        return F.struct(
            (state["depth"] + F.when(closes, -1).when(empty, 0).otherwise(1)).alias("depth"),
            F.when(top, F.concat(state["names"], F.array(name))).otherwise(state["names"]).alias("names"),
        )

    return F.aggregate(marks, F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("names")), step, lambda s: s["names"])


def sections(texts: DataFrame, text_col: str = "xml") -> DataFrame:
    """The other columns of ``texts``, parent, section and count: a row for each known section, and for each other child of a parent."""
    rest = [c for c in texts.columns if c != text_col]
    each = []
    for parent, known in SECTIONS.items():
        found = texts.select(*rest, F.lit(parent).alias("parent"), _names(F.col(text_col), parent).alias("names"))
        listed = F.array_union(F.array(*map(F.lit, known)), F.col("names"))
        count = lambda s: F.size(F.filter("names", lambda n: n == s))
        each.append(found.select(*rest, "parent", F.explode(F.transform(listed, lambda s: F.struct(s.alias("section"), count(s).alias("count")))).alias("s")).select(*rest, "parent", "s.*"))
    return each[0].unionByName(each[1])


def violations(texts: DataFrame, text_col: str = "xml") -> DataFrame:
    """The other columns of ``texts``, parent, section and what is wrong with it: missing, repeated or unknown."""
    known = F.array(*(F.lit(s) for of in SECTIONS.values() for s in of))
    needed = F.array(*(F.lit(s) for of in SECTIONS.values() for s, must in of.items() if must))
    wrong = (
        F.when(~F.array_contains(known, F.col("section")), "unknown").when((F.col("count") == 0) & F.array_contains(needed, F.col("section")), "missing")
        .when((F.col("count") > 1) & ~F.array_contains(F.array(*map(F.lit, MANY)), F.col("section")), "repeated")
    )
    return sections(texts, text_col).withColumn("wrong", wrong).where("wrong is not null").drop("count")


def domain_violations(texts: DataFrame, domains: dict[str, str], text_col: str = "xml") -> DataFrame:
    """The other columns of ``texts``, path, domain and value of what lies at an XPath and isn't in its domain (see ``functions.scalars``)."""
    rest = [c for c in texts.columns if c != text_col]
    read = F.array(*(F.struct(F.lit(path).alias("path"), F.lit(domain).alias("domain"), F.xpath(F.col(text_col), F.lit(path)).alias("values")) for path, domain in domains.items()))
    rows = texts.select(*rest, F.explode(read).alias("d")).select(*rest, "d.path", "d.domain", F.explode("d.values").alias("value"))
    fits = F.lit(None).cast("boolean")
    for domain in set(domains.values()):
        fits = F.when(F.col("domain") == domain, in_domain(F.col("value"), domain)).otherwise(fits)
    return rows.where(~fits)
