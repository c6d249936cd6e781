"""Reading and writing: Parquet snapshots of a lineage graph, JSON reports, file digests, and health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..schema import ARTIFACTS, EDGES


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def save_graph(artifacts: DataFrame, edges: DataFrame, path: str) -> None:
    """One immutable snapshot: a verification that reads it sees no later write."""
    artifacts.write.parquet(f"{path}/artifacts")
    edges.write.parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(ARTIFACTS).parquet(f"{path}/artifacts"), spark.read.schema(EDGES).parquet(f"{path}/edges")


def write_report(df: DataFrame, path: str) -> None:
    df.write.json(path)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(``path``, ``sha256``) of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def ready(spark: SparkSession) -> bool:
    return spark.range(1).count() == 1


def query(spark: SparkSession, text: str, params: dict) -> DataFrame:
    """A parameterised statement; parameters are never spliced into the text."""
    return spark.sql(text, args=params)


def single_value(df: DataFrame):
    """The one cell of a frame of one row and one column; anything else is an error."""
    rows = df.limit(2).collect()
    if len(df.columns) != 1 or len(rows) != 1:
        raise ValueError("expected one row of one column")
    return rows[0][0]


def decode_results(raw: DataFrame, schema: str) -> DataFrame:
    """Rows of a result set in JSON text (column ``raw``): ``columns`` and ``rows`` of cells with ``type`` and ``value``, to columns of ``schema``.

    A cell of type ``null`` is null, whatever its value.  Other columns than
    the schema's, in its order, or a row of another length are an error.
    """
    kind = T.StructType.fromDDL(schema)
    cells = "array<array<struct<type:string,value:string>>>"
    r = F.col("r")
    good = (r["columns"] == F.array(*map(F.lit, kind.fieldNames()))) & F.forall(r["rows"], lambda row: F.coalesce(F.size(row) == len(kind), F.lit(False)))
    rows = F.when(F.coalesce(good, F.lit(False)), r["rows"]).otherwise(F.raise_error(F.lit("unexpected result shape")).cast(cells))
    out = raw.select(F.from_json("raw", f"columns array<string>, rows {cells}").alias("r")).select(F.explode(rows).alias("row"))
    cell = lambda k: F.col("row")[k]
    return out.select(*(F.when(cell(k)["type"] != "null", cell(k)["value"]).cast(f.dataType).alias(f.name) for k, f in enumerate(kind)))


def decode_paths(raw: DataFrame) -> DataFrame:
    """(``nodes``, ``relationships``) of a result set of one column of paths; a cell of another type, or nodes that aren't one more, are an error."""
    path = "struct<nodes:array<struct<id:bigint,properties:map<string,string>>>,relationships:array<struct<src:bigint,dst:bigint,edge_type:string,properties:map<string,string>>>>"
    cells = f"array<array<struct<type:string,value:{path}>>>"
    out = raw.select(F.explode(F.from_json("raw", f"columns array<string>, rows {cells}")["rows"]).alias("row")).select(F.col("row")[0].alias("c"))
    good = (F.col("c.type") == "path") & (F.size("c.value.nodes") == F.size("c.value.relationships") + 1)
    value = F.when(F.coalesce(good, F.lit(False)), F.col("c.value")).otherwise(F.raise_error(F.lit("expected a path")).cast(path))
    return out.select(value.alias("p")).select("p.nodes", "p.relationships")
