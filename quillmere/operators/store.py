"""The metadata store as immutable tables: merges, deletes, paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import latest


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """``current`` with ``changes`` merged: the last row of each key wins."""
    return latest(current.unionByName(changes), keys, order)


def delete(current: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return current.join(keys, on, "left_anti")


def cascade_delete(parents: DataFrame, children: DataFrame, gone: DataFrame, parent_key: str, child_ref: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children left when the parents in ``gone`` go, with all that hangs on them."""
    return parents.join(gone, parent_key, "left_anti"), children.join(gone.withColumnRenamed(parent_key, child_ref), child_ref, "left_anti")


def folder_paths(folders: DataFrame) -> DataFrame:
    """(id, root, depth, path) from (id, parent, name); a folder that comes round again ends its path."""
    spark = folders.sparkSession
    return spark.sql(
        """with recursive tree(id, root, depth, path, seen) as (
             select id, id, 0, cast(name as string), array(id) from {folders} where parent is null
             union all
             select f.id, t.root, t.depth + 1, concat(t.path, '/', f.name), concat(t.seen, array(f.id))
             from {folders} f join tree t on f.parent = t.id where not array_contains(t.seen, f.id))
           select id, root, depth, path from tree""",
        folders=folders,
    )


def vector_rows(chunks: DataFrame, routed: str = "unstructured_native") -> DataFrame:
    """Chunks as vector-store rows: source file, folder, time range, and the router's file type."""
    return chunks.withColumns({"source_file_id": F.col("file_id"), "timestamp_end": F.coalesce("timestamp_end", "timestamp_start"), "file_type": F.coalesce(F.col("category"), F.lit(routed))})
