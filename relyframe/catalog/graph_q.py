"""O: lineage, impact and cycles over the dependency edges."""

from pyspark.sql import functions as F

from relyframe.catalog.registry import query
from relyframe.operators import graph
from relyframe.session import fact_table
from relyframe.sources import inputs
from relyframe.sources.tables import table


def _counts(spark, root):
    return fact_table(spark, root, "reach_counts", lambda: graph.reach_counts(inputs.edges(spark, root)))


def _asked(spark, root):
    """Datasets in the red: those whose lineage is asked for."""
    return table(spark, root, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("root"))


def _names(spark, root):
    return table(spark, root, "customer").select(F.col("c_custkey").alias("k"), "c_name")


@query(
    "o01_upstream_closure",
    """SELECT r.root, e.src, e.dst, e.relationship, coalesce(c_name, 'Unknown') AS dataset_name
       FROM (SELECT node AS root, root AS at FROM reach_v UNION SELECT dst, dst FROM edges_v) r JOIN edges_v e ON e.dst = r.at
       LEFT JOIN customer ON c_custkey = e.src WHERE r.root IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""",
)
def upstream_closure(spark, root):
    back = graph.flipped(inputs.edges(spark, root))
    asked = _asked(spark, root)
    met = graph.closure_edges(back, graph.reached(back, asked), asked)
    met = met.select("root", F.col("dst").alias("src"), F.col("src").alias("dst"), "relationship")
    n = _names(spark, root).withColumnRenamed("k", "src")
    return met.join(n, "src", "left").select("root", "src", "dst", "relationship", F.coalesce("c_name", F.lit("Unknown")).alias("dataset_name"))


@query(
    "o02_downstream_closure",
    """SELECT r.root, e.src, e.dst, e.relationship, coalesce(c_name, 'Unknown') AS dataset_name
       FROM (SELECT root, node AS at FROM reach_v UNION SELECT src, src FROM edges_v) r JOIN edges_v e ON e.src = r.at
       LEFT JOIN customer ON c_custkey = e.dst WHERE r.root IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""",
)
def downstream_closure(spark, root):
    asked, edges = _asked(spark, root), inputs.edges(spark, root)
    met = graph.closure_edges(edges, graph.reached(edges, asked), asked)
    n = _names(spark, root).withColumnRenamed("k", "dst")
    return met.join(n, "dst", "left").select("root", "src", "dst", "relationship", F.coalesce("c_name", F.lit("Unknown")).alias("dataset_name"))


@query("o03_blast_radius", "SELECT root, count(DISTINCT node) AS blast_radius FROM reach_v GROUP BY root")
def blast_radius(spark, root):
    return graph.blast_radius(_counts(spark, root))


@query(
    "o04_impact_risk",
    """SELECT root, change_type, n AS affected, n * 2 AS affected_reports, CASE WHEN n > 3 THEN 'CRITICAL' WHEN n > 1 OR (change_type = 'schema_change' AND n > 0) THEN 'HIGH' WHEN n = 1 THEN 'MEDIUM' ELSE 'LOW' END AS risk
       FROM (SELECT c_custkey AS root, CASE WHEN c_custkey % 2 = 0 THEN 'schema_change' ELSE 'data_change' END AS change_type,
                    (SELECT count(DISTINCT node) FROM reach_v WHERE reach_v.root = c_custkey AND node <> c_custkey) AS n FROM customer)""",
)
def impact_risk(spark, root):
    nodes = table(spark, root, "customer").select(F.col("c_custkey").alias("root"))
    change = F.when(F.col("root") % 2 == 0, "schema_change").otherwise("data_change")
    return graph.impact(_counts(spark, root), nodes, change)


@query(
    "o05_cycle_detection",
    """SELECT n.node, n.node IN (SELECT root FROM reach_v WHERE root = node) OR n.node IN (SELECT r.root FROM reach_v r WHERE r.node IN (SELECT root FROM reach_v WHERE root = node)) AS meets_cycle
       FROM (SELECT src AS node FROM edges_v UNION SELECT dst FROM edges_v) n""",
)
def cycle_detection(spark, root):
    return graph.meets_cycle(inputs.edges(spark, root))


@query(
    "o06_version_lineage",
    """SELECT dataset_id, version_number, CAST(coalesce(CASE WHEN version_number = 5 THEN 2 END, lag(version_number) OVER (PARTITION BY dataset_id ORDER BY version_number), 0) AS INTEGER) AS parent_version FROM versions_v""",
)
def version_lineage(spark, root):
    """Version 5 names version 2 as its parent; a first version has parent 0 here."""
    v = inputs.versions(spark, root)
    named = v.where("version_number = 5").select("dataset_id", "version_number", F.lit(2).alias("parent_version"))
    return graph.version_lineage(v, named).na.fill(0, ["parent_version"])
