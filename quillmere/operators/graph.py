"""Property graphs as two tables: nodes (id, type) and edges (src, dst, relation, ...)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local master may choose a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='quillmere-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage through a table in the folder that all executors share."""
    path = f"{shared_folder(df.sparkSession)}/quillmere/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def latest(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The last row of every key."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(seq).desc()))
    return rows.withColumn("turn_", turn).where("turn_ = 1").drop("turn_")


def merge_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, seq) with the last type each, edges (src, dst, relation, seq) with the last relation.

    Ends that are no node are added with type ``unknown``.
    """
    last_edges = latest(edges, ["src", "dst"])
    ends = last_edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    known = latest(nodes, ["id"]).select("id", "type")
    missing = ends.join(known, "id", "left_anti").select("id", F.lit("unknown").alias("type"))
    return known.unionByName(missing), last_edges.drop("seq")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.*").distinct()


#: Edges of a node that one task follows at once (a node of more is split), and pairs that a task makes, about.
FAN, TASK_PAIRS = 1024, 2_000_000


def _followed(frontier: DataFrame, edges: DataFrame) -> tuple[DataFrame, int]:
    """(seed, id) at the end of every edge that leaves a frontier's ``id``, and the tasks that they are work for.

    A hub's edges are dealt into parts, which the frontier meets in turn.
    """
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / FAN).cast("int"))
    met = frontier.join(degree, frontier.id == degree.src).drop("src")
    # Few bytes may be many rows, so the number of partitions goes by the rows and they are not put together.
    tasks = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(met.agg(F.sum("n")).first()[0] or 0) // TASK_PAIRS))
    out = edges.join(degree, "src").select(F.col("src").alias("id"), "dst", F.pmod(F.xxhash64("dst"), "parts").cast("int").alias("part"))
    asked = met.select("seed", "id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    joined = asked.repartition(tasks, "id", "part").join(out.repartition(tasks, "id", "part"), ["id", "part"])
    return joined.select("seed", F.col("dst").alias("id")), tasks


def within_hops(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, id, hops) of what a seed reaches in at most ``depth`` steps of ``edges``, fewest hops each."""
    edges = written(edges.select("src", "dst"))
    own = seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("hops"))
    seen = own
    for step in range(1, depth + 1):
        reached, tasks = _followed(seen.where(F.col("hops") == step - 1).select("seed", "id"), edges)
        every = seen.unionByName(reached.withColumn("hops", F.lit(step))).repartition(tasks, "seed", "id")
        seen = every.groupBy("seed", "id").agg(F.min("hops").alias("hops"))
        if step < depth:
            seen = written(seen)
    return own.unionByName(seen.where("hops > 0"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (id)."""
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, id) of everything a seed reaches, by frontiers until none is new; each is written once."""
    seen = frontier = written(seeds.select(F.col("id").alias("seed"), "id").distinct())
    while True:
        step = frontier.join(edges, frontier.id == edges.src).select("seed", F.col("dst").alias("id")).distinct()
        frontier = written(step.join(seen, ["seed", "id"], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def paths(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, id, hops, relations) over directed paths, the least path of fewest hops each.

    A frontier holds one row for every pair it reaches first, so what is kept grows
    with the pairs, not with the paths.
    """
    frontier = seeds.select(F.col("id").alias("seed"), "id", F.lit("").alias("relations")).distinct()
    seen, found = frontier.select("seed", "id"), None
    for hops in range(1, depth + 1):
        step = frontier.join(edges, frontier.id == edges.src)
        path = F.when(F.col("relations") == "", F.col("relation")).otherwise(F.concat_ws(">", "relations", "relation"))
        reached = step.select("seed", F.col("dst").alias("id"), path.alias("relations")).groupBy("seed", "id").agg(F.min("relations").alias("relations"))
        frontier = written(reached.join(seen, ["seed", "id"], "left_anti"))
        level = frontier.select("seed", "id", F.lit(hops).alias("hops"), "relations")
        seen, found = seen.unionByName(frontier.select("seed", "id")), level if found is None else found.unionByName(level)
    return found


def two_least_sources(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, way, source), at most two rows a node and way: the two least of ``sources`` (id) that paths along ``edges`` join to it.

    ``way`` 1 are paths from the source to the node, 0 paths from the node to it.
    A source reaches itself. Both ways go on together. Every round passes on only what is new, and a node
    keeps two sources, so the tables grow with the nodes, not with the pairs of the
    transitive closure; a task drops what is beyond its own two least before the
    shuffle. Ends when a round brings nothing new.
    """
    ways = F.explode(F.array(F.struct(F.lit(1).alias("way"), F.col("src").alias("id"), F.col("dst").alias("next")), F.struct(F.lit(0).alias("way"), F.col("dst").alias("id"), F.col("src").alias("next"))))
    steps = written(edges.select(ways.alias("w")).select("w.*").distinct())
    kept = written(sources.select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("way"), F.col("id").alias("source"), F.lit(True).alias("new")).distinct())
    order = Window.partitionBy("id", "way").orderBy("source")
    while not kept.where("new").isEmpty():
        passed = kept.where("new").join(steps, ["id", "way"]).select(F.col("next").alias("id"), "way", "source", F.lit(True).alias("new"))
        best = kept.withColumn("new", F.lit(False)).unionByName(passed).withColumn("place", F.dense_rank().over(order)).where("place <= 2")
        kept = written(best.groupBy("id", "way", "source").agg(F.every("new").alias("new")))
    return kept.drop("new")


def common_nodes(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, first, second) of nodes that a path joins to two sources at least, whichever way it runs; the two least ones."""
    met = two_least_sources(edges, sources).select("id", "source").distinct().join(sources.select("id"), "id", "left_anti")
    place = met.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("source"))).where("place <= 2")
    ends = place.groupBy("id").agg(F.min("source").alias("first"), F.max("source").alias("second"))
    return ends.where("first <> second")


def conflicts(edges: DataFrame) -> DataFrame:
    """(src, dst, kind): pairs with several relations, and relations that run both ways."""
    several = edges.groupBy("src", "dst").agg(F.count_distinct("relation").alias("n")).where("n > 1").select("src", "dst", F.lit("several_relations").alias("kind"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation").distinct()
    circular = edges.join(back, ["src", "dst", "relation"], "left_semi").where("src < dst").select("src", "dst").distinct().withColumn("kind", F.lit("circular"))
    return several.unionByName(circular)


def relationship_score(kind, confidence, has_ends):
    """Confidence with a bonus by kind; nothing without both ends."""
    bonus = F.when(kind.isin("entity_overlap", "cross_reference"), 0.2).when(kind == "temporal", 0.1).otherwise(0.0)
    return F.when(has_ends, F.least(confidence + bonus, F.lit(1.0))).otherwise(F.lit(0.0))
