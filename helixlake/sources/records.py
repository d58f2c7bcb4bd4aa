"""Sources and sinks: sparse matrices, observation records, connectors, pathway documents, order files, benchmark labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.functions import text as x

#: Column names under which a dataset may carry each field.
OBS_ALIASES = {
    "cluster": ["cluster", "leiden", "louvain", "clusters"],
    "cell_type": ["cell_type", "celltype", "annotation"],
    "batch": ["batch", "batch_id"],
    "sample": ["sample", "sample_id"],
    "condition": ["condition", "treatment", "group"],
    "replicate": ["replicate", "rep"],
}
NODE_TYPES = ["metabolite", "enzyme", "gene", "complex", "cofactor", "impurity", "intermediate", "unknown"]
EDGE_TYPES = ["catalyzes", "produces", "consumes", "activates", "inhibits", "converts", "transports", "regulates", "unknown"]


def alias_column(columns: list[str], names: list[str]) -> str | None:
    """The first of ``names`` among the columns, whatever its case."""
    have = {c.lower(): c for c in reversed(columns)}
    return next((have[n.lower()] for n in names if n.lower() in have), None)


def obs_records(obs: DataFrame, key: str) -> DataFrame:
    """(cell, cluster, cell_type, batch, sample, condition, replicate, metadata): aliases resolved, the rest as a map of strings."""
    found = {k: alias_column(obs.columns, names) for k, names in OBS_ALIASES.items()}
    rest = [c for c in obs.columns if c != key and c not in found.values()]
    own = [F.col(f"`{c}`").cast("string").alias(k) if c else F.lit(None).cast("string").alias(k) for k, c in found.items()]
    pairs = [e for c in rest for e in (F.lit(c), F.col(f"`{c}`").cast("string"))]
    metadata = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
    return obs.select(F.col(key).alias("cell"), *own, metadata.alias("metadata"))


def sparse_rows(matrix: DataFrame, cell: str, values: str) -> DataFrame:
    """(cell, indices, values): the non-zero places of dense rows; null and NaN count as zero."""
    clean = F.transform(values, lambda v: F.coalesce(F.nanvl(v.cast("double"), F.lit(0.0)), F.lit(0.0)))
    at = F.filter(F.transform(clean, lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda e: e["v"] != 0)
    return matrix.select(F.col(cell).alias("cell"), F.transform(at, lambda e: e["i"]).alias("indices"), F.transform(at, lambda e: e["v"]).alias("values"))


def sparse_long(rows: DataFrame) -> DataFrame:
    """(cell, gene, value) of sparse rows."""
    return rows.select("cell", F.explode(F.arrays_zip("indices", "values")).alias("e")).select("cell", F.col("e.indices").alias("gene"), F.col("e.values").alias("value"))


def coordinates(points: DataFrame, key: str, point: str) -> DataFrame:
    """(cell, x, y, z) of points with two or three components; others are dropped."""
    p = points.where(F.size(point).isin(2, 3))
    return p.select(F.col(key).alias("cell"), *[F.try_element_at(point, F.lit(i)).alias(n) for i, n in ((1, "x"), (2, "y"), (3, "z"))])


def save_artifact(tables: dict[str, DataFrame], path: str) -> None:
    """One folder per table of an artifact family, partitioned by artifact, earlier versions of the same artifacts replaced."""
    for name, t in tables.items():
        t.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("artifact_id").parquet(f"{path}/{name}")


def connector(rows: DataFrame, source: str, fields: dict[str, str | Column], most: int = 5) -> DataFrame:
    """A dump's first ``most`` rows by id as articles of a source; ``fields`` maps article columns to its own."""
    own = [(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()]
    return rows.select(*own, F.lit(source).alias("source")).orderBy("id").limit(most)


def add_missing(rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Additive migration: absent columns with their default."""
    return rows.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in rows.columns})


def benchmark_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True)


def primer_order(primers: DataFrame, path: str) -> None:
    """An order file: booleans as YES or no."""
    flags = [f.name for f in primers.schema if f.dataType.typeName() == "boolean"]
    primers.withColumns({c: F.when(F.col(c), "YES").otherwise("no") for c in flags}).write.mode("overwrite").csv(path, header=True)


def pathway_nodes(raw: DataFrame) -> DataFrame:
    """(doc, id, label, type, confidence, risk, efficiency): nodes with an id and a label, ids made canonical, scores held within bounds, unknown types as such."""
    hold = lambda c, top: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(top)))
    ok = raw.where("id IS NOT NULL AND trim(id) <> '' AND label IS NOT NULL")
    kind = F.when(F.col("type").isin(*NODE_TYPES), F.col("type")).otherwise("unknown")
    return ok.select("doc", x.node_id(F.col("id")).alias("id"), F.substring("label", 1, 32).alias("label"), kind.alias("type"), hold("confidence", 1.0).alias("confidence"), hold("risk", 1.0).alias("risk"), hold("efficiency", 100.0).alias("efficiency"))


def pathway_edges(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc, a, b, type): edges both of whose canonical ends are nodes of the document."""
    kind = F.when(F.col("type").isin(*EDGE_TYPES), F.col("type")).otherwise("unknown")
    e = raw.select("doc", x.node_id(F.col("a")).alias("a"), x.node_id(F.col("b")).alias("b"), kind.alias("type"))
    ids = nodes.select("doc", "id").distinct()
    return e.join(ids.withColumnRenamed("id", "a"), ["doc", "a"], "left_semi").join(ids.withColumnRenamed("id", "b"), ["doc", "b"], "left_semi").select("doc", "a", "b", "type")


def bottlenecks(nodes: DataFrame) -> DataFrame:
    """(doc, id, efficiency, loss): enzymes under 40 % efficiency."""
    return nodes.where("type = 'enzyme' AND efficiency < 40").select("doc", "id", (F.floor(F.col("efficiency") * 10 + 0.5) / 10).alias("efficiency"), F.greatest(F.lit(0.0), F.floor(100 - F.col("efficiency") + 0.5)).alias("loss"))


def graph_stats(nodes: DataFrame) -> DataFrame:
    """(doc, n, mean_confidence, high_risk, types): defaults of 0.7 for a missing confidence; high risk is above 0.7."""
    g = nodes.groupBy("doc").agg(F.count("*").alias("n"), F.avg(F.coalesce("confidence", F.lit(0.7))).alias("mean_confidence"), F.count_if(F.col("risk") > 0.7).alias("high_risk"), F.count_distinct("type").alias("types"))
    return g


def present(c: Column, kind: str) -> Column:
    """Whether a value counts as present: not null, not '', not an empty list, a finite number."""
    if kind == "string":
        return F.coalesce(c != "", F.lit(False))
    if kind == "array":
        return F.coalesce(F.size(c) > 0, F.lit(False))
    return F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))
