"""Parsers of side files: performance tables, meshes, transform sequences, scenes and job settings."""

from __future__ import annotations

import argparse
import configparser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.scalars import tokens

#: The part of a header that names a column: words, '#' and blanks, up to the last word character of them.
NAME = r"^[\w#\s]*\w"


def performance_table(texts: DataFrame, names: list[str], text_col: str = "text") -> DataFrame:
    """Tab-separated numbers, '#' comments, of each row's text: line and one double per name; another column count fails the job."""
    kept = texts.select(*[c for c in texts.columns if c != text_col], F.posexplode(F.split(F.col(text_col), r"\r?\n")).alias("line", "raw"))
    kept = kept.where(~F.trim("raw").startswith("#") & (F.trim("raw") != "")).withColumn("v", F.split(F.trim("raw"), "\t"))
    fits = F.size("v") == len(names)
    value = lambda i: F.when(fits, F.get("v", F.lit(i)).cast("double")).otherwise(F.raise_error(F.lit("a line has another number of columns")))
    return kept.select(*[c for c in texts.columns if c != text_col], "line", *(value(i).alias(n) for i, n in enumerate(names)))


def performance_xml(texts: DataFrame, text_col: str = "xml") -> DataFrame:
    """description (map), names and data (array of arrays) of performance documents."""
    names = F.xpath(F.col(text_col), F.lit("//DataTable/Header/Column/text()"))
    name = lambda c: F.coalesce(F.nullif(F.regexp_extract(F.trim(c), NAME, 0), F.lit("")), F.raise_error(F.lit("a column has no name")))
    lines = F.filter(F.split(F.xpath_string(F.col(text_col), F.lit("//DataTable/Data")), r"\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("#"))
    inner = F.regexp_extract(F.col(text_col), r"(?s)<Description>(.*?)</Description>", 1)
    described = F.from_xml(F.concat(F.lit("<d><all>"), inner, F.lit("</all></d>")), "all map<string,string>")["all"]
    return texts.select(
        described.alias("description"),
        F.transform(names, name).alias("names"),
        F.transform(lines, lambda x: F.transform(F.split(F.trim(x), "\t"), lambda v: v.cast("double"))).alias("data"),
    )


def mesh(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Vertices, texture coordinates, normals and faces of OBJ files; faces that haven't four corners are left out, indices count from 0.

    Rows keep their file and line, which order them.
    """
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "raw"))
    lines = lines.where(~F.col("raw").startswith("#")).select("file", "line", tokens(F.col("raw")).alias("t")).where(F.size("t") > 0)
    kind = lambda k: lines.where(F.col("t")[0] == k)
    rest = F.slice("t", F.lit(2), F.size("t"))
    floats = lambda k: kind(k).select("file", "line", F.transform(rest, lambda x: x.cast("double")).alias("v"))
    corners = F.transform(rest, lambda c: F.transform(F.split(c, "/"), lambda i: i.try_cast("int") - 1))
    return {"vertices": floats("v"), "texcoords": floats("vt"), "normals": floats("vn"), "faces": kind("f").where(F.size("t") == 5).select("file", "line", corners.alias("corners"))}


def transform_sequence(steps: Column) -> Column:
    """``struct(position, rotation)`` of an array of (trans, axis, deg, rad): each step moves along the axes turned so far, then turns.

    A zero axis fails the job, as does a step without an angle; degrees win over radians.
    """
    zero = V.vec(0, 0, 0)
    start = F.struct(zero.alias("position"), V.vec(0, 0, 0, 1).alias("rotation"))

    def step(s: Column, x: Column) -> Column:
        angle = F.coalesce(F.radians(x["deg"]), x["rad"], F.raise_error(F.lit("a step needs deg or rad")).cast("double"))
        turn = F.coalesce(V.quaternion(x["axis"], angle), F.raise_error(F.lit("a step has a zero axis")).cast("array<double>"))
        return F.struct(V.add(s["position"], V.rotate(s["rotation"], x["trans"])).alias("position"), V.quaternion_product(s["rotation"], turn).alias("rotation"))

    return F.aggregate(steps, start, step)


def scene(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Elements ``row_tag`` of scene files under an explicit schema; attributes have the prefix '_'. Missing required parts show as nulls."""
    return spark.read.format("xml").option("rowTag", row_tag).option("attributePrefix", "_").schema(schema).load(path)


def first_of_group(bodies: DataFrame, settings: DataFrame, order: str) -> DataFrame:
    """Each body with the first settings (by ``order``) of its group, later ones don't replace it; nulls where the group has none."""
    rest = [c for c in settings.columns if c != "group_nr"]
    first = settings.groupBy("group_nr").agg(F.min_by(F.struct(*rest), F.col(order)).alias("s"))
    return bodies.join(first, "group_nr", "left").select(*bodies.columns, *(F.col(f"s.{c}").alias(c) for c in rest if c not in bodies.columns))


@dataclass
class Job:
    name: str
    run_time: float
    memory: float
    processes: int
    jobs: int
    parent: int
    command: str


def job(text: str, section: str = "Cluster") -> Job:
    """Job settings of an ini text."""
    ini = configparser.ConfigParser(interpolation=None)
    ini.read_string(text)
    s = {k.lower(): v for k, v in ini[section].items()}
    return Job(s.get("jobname", ""), float(s.get("runtime", 0)), float(s.get("ram", s.get("rampercore", 0))), int(s.get("nprocesses", 1)), int(s.get("njobs", 1)), int(s.get("jobidxparent", -1)), s.get("submitcommand", ""))


class _Options(argparse.ArgumentParser):
    def convert_arg_line_to_args(self, arg_line: str) -> list[str]:
        return arg_line.split()


def options(arguments: list[str]) -> dict[str, str]:
    """Long options with a value each; ``@file`` is replaced by that file's options, in place."""
    parser = _Options(fromfile_prefix_chars="@", add_help=False)
    parser.add_argument("rest", nargs="*")
    expanded = parser._read_args_from_files(arguments)
    return {k.removeprefix("--"): v for k, v in zip(expanded[::2], expanded[1::2], strict=True)}
