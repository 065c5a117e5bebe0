"""Writers: text tables, JSON lines and documents, GraphML and GEXF, merge by key. Paths are of any file system the cluster knows."""

from __future__ import annotations

import json
import uuid
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.session import materialize


def csv_table(df: DataFrame, path: str, columns: list[str]) -> None:
    """Fixed columns in order, missing ones empty; other columns are left out."""
    df.select(*[F.col(c) if c in df.columns else F.lit("").alias(c) for c in columns]).write.mode("overwrite").csv(path, header=True, escape='"')


def json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def merge_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with rows of ``new`` added or in their place; of several new rows of a key the first by all columns is kept."""
    columns = [c for c in new.columns if c not in keys]
    one = new.groupBy(*keys).agg(F.min(F.struct(*columns)).alias("r"))
    fresh = one.select(*keys, "r.*")
    return old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh.select(*old.columns))


def replace_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Every row of a key of ``new`` taken out of ``old``, then ``new`` appended."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, replaced as a whole."""
    fs, p = _file_system(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def json_document(spark: SparkSession, path: str, value) -> None:
    """A JSON document: two blanks of indent, ASCII, a line end."""
    write_text(spark, path, json.dumps(value, indent=2, ensure_ascii=True) + "\n")


def report_document(spark: SparkSession, path: str, totals: DataFrame, tables: dict[str, DataFrame], most: int = 10_000) -> None:
    """A JSON report: the one row of ``totals`` and under each name the rows of a small table; larger ones are refused."""
    first = totals.first()
    out = first.asDict(recursive=True) if first else {}
    for name, df in tables.items():
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{name} has more than {most} rows")
        out[name] = [r.asDict(recursive=True) for r in rows]
    json_document(spark, path, json.loads(json.dumps(out, default=str)))


def replace_json_lines(df: DataFrame, path: str) -> None:
    """JSON lines replaced as a whole: written beside, then renamed, so a reader sees the old lines or the new ones."""
    fs, target = _file_system(df.sparkSession, path)
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.json(beside)
    old = f"{beside}.old"
    if fs.exists(target):
        fs.rename(target, _file_system(df.sparkSession, old)[1])
    fs.rename(_file_system(df.sparkSession, beside)[1], target)
    fs.delete(_file_system(df.sparkSession, old)[1], True)


def indexed_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """A CSV table in order with the number of the row first; the numbers come from counts of sorted parts."""
    spark = df.sparkSession
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), 33))
    ranged = materialize(ranged, "ranged")
    counts = {r[0]: r[1] for r in ranged.groupBy("part").agg(F.max("at") + 1).collect()}
    before, total = [], 0
    for part in sorted(counts):
        before.append((part, total))
        total += counts[part]
    offsets = spark.createDataFrame(before, "part int, before bigint") if before else spark.createDataFrame([], "part int, before bigint")
    out = ranged.join(F.broadcast(offsets), "part").select((F.col("before") + F.col("at")).alias("index"), *df.columns)
    out.repartitionByRange("index").sortWithinPartitions("index").write.mode("overwrite").csv(path, header=True, escape='"')


def person_lists(edges: DataFrame, path: str) -> None:
    """``{"doc": …, "persons": […]}`` a line: the people of every document, in order of the edges; a document's list is as
    long as it has people."""
    rows = edges.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "person"))), lambda x: x["person"]).alias("persons"))
    rows.write.mode("overwrite").json(path)


def link_map(documents: DataFrame, path: str) -> None:
    """``{"doc": …, "link": …}`` a line; of a document's rows the last with a link counts."""
    linked = documents.where(F.trim(F.coalesce("link", F.lit(""))) != "")
    linked.groupBy("doc").agg(F.max_by("link", "ord").alias("link")).write.mode("overwrite").json(path)


def _drawn(df: DataFrame, most: int) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a drawing of more than {most} nodes or edges")
    return rows


def graphml(nodes: DataFrame, edges: DataFrame, path: str, most: int = 200_000) -> None:
    """A GraphML file for drawing; NULL attributes are empty, parallel edges kept. Larger graphs are refused."""
    node_keys = [c for c in nodes.columns if c != "node_id"]
    edge_keys = [c for c in edges.columns if c not in ("src_id", "dst_id")]
    data = lambda r, keys, p: "".join(f'<data key="{p}{i}">{escape("" if r[k] is None else str(r[k]))}</data>' for i, k in enumerate(keys))
    out = ['<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n']
    for p, kind, keys in (("n", "node", node_keys), ("e", "edge", edge_keys)):
        out += [f'<key id="{p}{i}" for="{kind}" attr.name={quoteattr(k)} attr.type="string"/>\n' for i, k in enumerate(keys)]
    out.append('<graph edgedefault="directed">\n')
    out += [f"<node id={quoteattr(r['node_id'])}>{data(r, node_keys, 'n')}</node>\n" for r in _drawn(nodes, most)]
    out += [f"<edge source={quoteattr(r['src_id'])} target={quoteattr(r['dst_id'])}>{data(r, edge_keys, 'e')}</edge>\n" for r in _drawn(edges, most)]
    write_text(nodes.sparkSession, path, "".join([*out, "</graph>\n</graphml>\n"]))


def gexf(nodes: DataFrame, edges: DataFrame, path: str, most: int = 200_000) -> None:
    """A GEXF file of the same, with the labels of the nodes and the relations of the edges."""
    label = lambda r, c: quoteattr("" if c not in r or r[c] is None else str(r[c]))
    out = ['<?xml version="1.0" encoding="utf-8"?>\n<gexf xmlns="http://gexf.net/1.3" version="1.3">\n<graph defaultedgetype="directed">\n<nodes>\n']
    out += [f"<node id={quoteattr(r['node_id'])} label={label(r, 'label')}/>\n" for r in _drawn(nodes, most)]
    out.append("</nodes>\n<edges>\n")
    out += [f"<edge id=\"{i}\" source={quoteattr(r['src_id'])} target={quoteattr(r['dst_id'])} label={label(r, 'relation')}/>\n" for i, r in enumerate(_drawn(edges, most))]
    write_text(nodes.sparkSession, path, "".join([*out, "</edges>\n</graph>\n</gexf>\n"]))


def graph_file(nodes: DataFrame, edges: DataFrame, folder: str, name: str, form: str = "graphml") -> None:
    """A graph file by name and form; nothing is written for a form that is not known."""
    if form in ("graphml", "gexf"):
        {"graphml": graphml, "gexf": gexf}[form](nodes, edges, f"{folder.rstrip('/')}/{name}.{form}")
