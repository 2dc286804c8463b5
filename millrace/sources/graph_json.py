"""Property graphs kept as JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources import large_json

GRAPH_SCHEMA = (
    "graph struct<mode:string,"
    "vertices:array<struct<name:string,type:string,_id:bigint,_type:string>>,"
    "edges:array<struct<_id:bigint,_type:string,_outV:bigint,_inV:bigint,_label:string>>>"
)


VERTEX_SCHEMA = "name string, type string, _id bigint, _type string"
EDGE_SCHEMA = "_id bigint, _type string, _outV bigint, _inV bigint, _label string"


def scan_large_graph(
    spark: SparkSession, root: str, chunk_bytes: int = large_json.CHUNK_BYTES
) -> tuple[DataFrame, DataFrame]:
    """Vertex and edge tables of documents of any size, each read by many tasks."""
    found = large_json.array_elements(spark, root, 3, chunk_bytes)
    return (
        large_json.elements_as(found, "vertices", VERTEX_SCHEMA),
        large_json.elements_as(found, "edges", EDGE_SCHEMA),
    )


def scan_property_graph(
    spark: SparkSession, path: str, schema: str = GRAPH_SCHEMA, one_document_per_file: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Vertex and edge tables of a graph.

    A large graph is kept as many documents, each with some vertices and edges, either
    one per file or one per line; both tables are the union over all documents.
    """
    docs = spark.read.schema(schema).option("multiLine", one_document_per_file).json(path)
    return (
        docs.select(F.inline("graph.vertices")),
        docs.select(F.inline("graph.edges")),
    )
