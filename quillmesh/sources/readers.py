"""Readers of the raw layer: text tables, JSON lines, directories of JSON files, texts, GraphML, hosted tables."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p) not in (None, []) and len(
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    ) > 0


def read_text(spark: SparkSession, path: str) -> str:
    """A small file of any file system the cluster knows, on the driver."""
    rows = spark.read.text(path, wholetext=True).take(1)
    return rows[0][0] if rows else ""


def csv_text(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file, every value a string, missing ones ''; a byte-order mark before the first column name is dropped."""
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, quote='"', escape='"')
    plain = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    return plain.na.fill("")


def csv_typed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a missing file is an empty table, blank and malformed lines are left out."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_folder(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """One JSON document a file, with ``file`` for their order; files that do not parse are left out."""
    if not _exists(spark, pattern):
        return spark.createDataFrame([], schema + ", file string")
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(pattern, multiLine=True).withColumn("file", F.input_file_name())


def texts(spark: SparkSession, pattern: str) -> DataFrame:
    """``(doc_id, text)`` of a folder with one text a file, named by its document."""
    raw = spark.read.text(pattern, wholetext=True)
    return raw.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("doc_id"), F.col("value").alias("text"))


def graph_tables(nodes: DataFrame, edges: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Node and edge text tables ready for walks: blank ids and incomplete edges dropped, the last node row of an id kept.

    ``order`` names the column with the place of a row; without it rows count in the order of the file, which holds for
    tables read from one file."""
    place = F.col(order).cast("bigint") if order else F.monotonically_increasing_id()
    numbered = nodes.withColumn("row", place).where(F.trim("node_id") != "")
    last = numbered.groupBy("node_id").agg(F.max_by("node_type", "row").alias("node_type"), F.max_by("label", "row").alias("label"))
    whole = edges.where((F.trim("src_id") != "") & (F.trim("relation") != "") & (F.trim("dst_id") != ""))
    at = F.struct(F.lit(0).alias("stage"), place.alias("ord"), F.lit(0).alias("sub"))
    return last, whole.select("src_id", "relation", "dst_id", at.alias("edge_order"))


def hosted(spark: SparkSession, url: str, name: str, columns: list[str], equal: dict[str, str] | None = None, **options: str) -> DataFrame:
    """A table of a relational mirror over JDBC; projection and equality filters are pushed down."""
    df = spark.read.format("jdbc").options(url=url, dbtable=name, fetchsize="1000", **options).load().select(*columns)
    for c, v in (equal or {}).items():
        df = df.where(F.col(c) == v)
    return df


def communities_json(spark: SparkSession, path: str) -> DataFrame:
    """``(community_id, label, members)`` of a JSON list or of a wrapper with the list under ``communities``."""
    record = "array<struct<community_id:string,label:string,members:array<string>>>"
    raw = spark.read.text(path, wholetext=True)
    rows = F.coalesce(F.from_json("value", f"struct<communities:{record}>")["communities"], F.from_json("value", record))
    checked = raw.select(F.when(rows.isNull(), F.raise_error(F.lit("no list of communities"))).otherwise(rows).alias("c"))
    return checked.select(F.inline("c"))


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of one GraphML file, read on the driver: such files are drawings of small graphs."""
    ns = "{http://graphml.graphdrawing.org/xmlns}"
    root = ET.fromstring(read_text(spark, path))
    names = {k.get("id"): k.get("attr.name") for k in root.iter(ns + "key")}
    data = lambda x: {names.get(d.get("key"), d.get("key")): d.text or "" for d in x.iter(ns + "data")}
    nodes = [(x.get("id"), data(x)) for x in root.iter(ns + "node")]
    edges = [(x.get("source"), x.get("target"), data(x)) for x in root.iter(ns + "edge")]
    props = "map<string,string>"
    return (
        spark.createDataFrame(nodes, f"node_id string, props {props}"),
        spark.createDataFrame(edges, f"src_id string, dst_id string, props {props}"),
    )


def strings(columns: list[str]) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


def layer_csv(spark: SparkSession, path: str) -> DataFrame:
    """The node or edge table of a layer; a missing path is an error with its name."""
    return csv_text(spark, path)


def community_map(communities: DataFrame) -> DataFrame:
    """``(doc, community)`` of ``(community_id, members, ord)``; of a document in several the last community counts."""
    each = communities.select("community_id", "ord", F.explode("members").alias("doc"))
    return each.groupBy("doc").agg(F.max_by("community_id", "ord").alias("community"))


def first_community(communities: DataFrame) -> DataFrame:
    """``(doc, community)``, of a document in several the first community."""
    each = communities.select("community_id", "ord", F.explode("members").alias("doc"))
    return each.groupBy("doc").agg(F.min_by("community_id", "ord").alias("community"))


def texts_of(documents: DataFrame, hosted_texts: DataFrame | None, local: DataFrame) -> DataFrame:
    """``(doc_id, text)`` of the documents: the hosted text, where there is none the local one, else NULL."""
    out = documents.select("doc_id").distinct().join(local.select("doc_id", F.col("text").alias("local_text")), "doc_id", "left")
    if hosted_texts is None:
        return out.withColumnRenamed("local_text", "text")
    h = hosted_texts.select("doc_id", F.col("text").alias("hosted_text"))
    return out.join(h, "doc_id", "left").select("doc_id", F.coalesce("hosted_text", "local_text").alias("text"))


def memories(spark: SparkSession, path: str, communities: DataFrame) -> DataFrame:
    """``(community_id, label, rules)`` of all communities: the stored memory, else a fresh one with the community's label."""
    stored = json_lines(spark, path, "community_id string, rules map<string,string>").groupBy("community_id").agg(F.first("rules").alias("rules"))
    none = F.create_map().cast("map<string,string>")
    return communities.select("community_id", "label").join(stored, "community_id", "left").withColumn("rules", F.coalesce("rules", none))


def by_ids(table_: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of a table whose key is among the ids."""
    return table_.join(ids.select(key).distinct(), key, "left_semi")
