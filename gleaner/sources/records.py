"""JSON tables of patterns and histories, keyword maps, source trees and dense matrices."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.edges import from_dense
from gleaner.session import ship

PATTERNS = "id long, pattern array<double>, strength double, access_count long, ts double, metadata map<string,string>"
HISTORY = "ts timestamp, isolation double, precision double, deleteability double, overall double"


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """Patterns of JSON files; records that can't be read are left out, missing fields have their defaults."""
    rows = spark.read.schema(PATTERNS).option("mode", "DROPMALFORMED").json(path)
    return rows.fillna({"strength": 1.0, "access_count": 0, "ts": 0.0})


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY).option("mode", "DROPMALFORMED").json(path)


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    """(cluster, keyword, weight) of a JSON object of objects."""
    rows = spark.read.schema("value string").option("wholetext", True).text(path)
    clusters = F.from_json("value", "map<string,map<string,double>>")
    return rows.select(F.explode(clusters).alias("cluster", "words")).select("cluster", F.explode("words").alias("keyword", "weight"))


def read_matrix(spark: SparkSession, rows: list[list[float]]) -> DataFrame:
    """Edges of a dense matrix that the driver holds."""
    return from_dense(spark.createDataFrame(list(enumerate(rows)), "id long, row array<double>"))


def read_triplets(spark: SparkSession, rows: list[int], cols: list[int], data: list[float]) -> DataFrame:
    return spark.createDataFrame(list(zip(rows, cols, data, strict=True)), "src long, dst long, w double")


#: Folders that a source tree's scan leaves out.
SKIPPED = ("_vendor", "__pycache__")


def read_sources(spark: SparkSession, root: str, skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """(path, value): the Python files under a folder."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.py").text(root, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return rows.filter(~F.col("path").rlike("/(" + "|".join(skipped) + ")/"))


def _imported(source: str) -> list[str]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    found = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            found += [a.name for a in node.names]
        elif isinstance(node, ast.ImportFrom) and node.module and not node.level:
            found += [node.module, *[f"{node.module}.{a.name}" for a in node.names]]
    return found


def import_graph(sources: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Modules (id, module) of sources (path, value), and edges to the modules they import, by references.

    An imported name belongs to the module that is its longest prefix.
    """
    ship(sources.sparkSession)
    relative = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", f"^.*{root}/", ""), r"(/__init__)?\.py$", ""), "/", ".")
    rows = sources.select(relative.alias("module"), "value")

    def run(batches):
        for batch in batches:
            found = [(m, n) for m, s in zip(batch["module"], batch["value"], strict=True) for n in _imported(s)]
            yield pd.DataFrame(found, columns=["module", "name"])

    modules = rows.select("module").distinct().withColumn("id", F.xxhash64("module"))
    names = rows.mapInPandas(run, "module string, name string")
    cut = F.split("name", r"\.")
    prefixes = names.select("module", "name", F.monotonically_increasing_id().alias("ref"), F.explode(F.transform(F.sequence(F.lit(1), F.size(cut)), lambda n: F.array_join(F.slice(cut, 1, n), "."))).alias("prefix"))
    target = prefixes.join(modules.select(F.col("module").alias("prefix"), F.col("id").alias("dst")), "prefix").groupBy("module", "ref").agg(F.max_by("dst", F.length("prefix")).alias("dst"))
    edges = target.join(modules, "module").select(F.col("id").alias("src"), "dst").filter("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    return modules.select("id", "module"), edges
