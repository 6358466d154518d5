"""Content ids, Merkle roots and paths, and audits. Ids are SHA-256 over the row as JSON.

Trees are folded in runs of ``RUN`` hashes, so that no row holds more than a run at any batch size; a
batch of more than a run takes another round over the roots of its runs. The result is that of
folding the whole batch level by level.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldmark.functions.ship import ship

#: Hashes folded in one row, a power of two, and its levels.
RUN, LEVELS = 1024, 10


def content_id(*columns: str) -> Column:
    """Injective: names, values and nulls are told apart by the JSON."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def with_cid(facts: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with their content id; equal rows collapse."""
    return facts.withColumn("cid", content_id(*columns)).dropDuplicates(["cid"])


def _fold(level: Column) -> Column:
    """Neighbours hashed together, an odd last one with itself."""
    pairs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int"))
    return F.transform(pairs, lambda i: F.sha2(F.concat(F.get(level, 2 * i), F.coalesce(F.get(level, 2 * i + 1), F.get(level, 2 * i))), 256))


def _rounds(leaves: DataFrame) -> tuple[DataFrame, int]:
    """((batch, i, m, h): leaf hashes in order, hashed once more, and their number; rounds of runs)."""
    sizes = leaves.groupBy("batch").agg(F.count("*").alias("m"))
    most = sizes.agg(F.max("m")).first()[0] or 1
    order = Window.partitionBy("batch").orderBy("leaf")
    numbered = leaves.select("batch", "leaf", (F.row_number().over(order) - 1).cast("long").alias("i"))
    nodes = numbered.join(sizes, "batch").select("batch", "i", "m", "leaf", F.sha2("leaf", 256).alias("h"))
    return nodes, max(1, math.ceil(round(math.log(most, RUN), 9)))


def _runs(nodes: DataFrame) -> DataFrame:
    """(batch, run, m, levels): all levels of every run's tree, the leaves first. A batch of one run
    ends with its root, the runs of a larger one after all LEVELS."""
    level = F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"])
    runs = nodes.groupBy("batch", F.floor(F.col("i") / RUN).alias("run"), "m").agg(level.alias("level"))
    depth = F.when(F.col("m") > RUN, LEVELS).otherwise(F.ceil(F.log2(F.greatest(F.size("level"), F.lit(1)))).cast("int"))
    steps = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    levels = F.aggregate(steps, F.array("level"), lambda all_, _: F.concat(all_, F.array(_fold(F.element_at(all_, -1)))))
    return runs.select("batch", "run", "m", levels.alias("levels"))


def _above(runs: DataFrame) -> DataFrame:
    """The runs' roots as the nodes of the next round."""
    root = F.get(F.element_at("levels", -1), F.lit(0))
    return runs.select("batch", F.col("run").alias("i"), F.ceil(F.col("m") / RUN).alias("m"), root.alias("h"))


def _whole(leaves: DataFrame) -> DataFrame | None:
    """(batch, leaves, levels): every batch's leaf hashes in order and all levels of its tree, by one grouping;
    none where a batch holds more than a run."""
    largest = leaves.groupBy("batch").agg(F.count("*").alias("m")).agg(F.max("m")).first()[0] or 0
    if largest > RUN:
        return None
    g = leaves.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("leaf"))).alias("leaves"))
    depth = F.ceil(F.log2(F.size("leaves").cast("double"))).cast("int")
    steps = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    first = F.transform("leaves", lambda x: F.sha2(x["leaf"], 256))
    return g.select("batch", "leaves", F.aggregate(steps, F.array(first), lambda all_, _: F.concat(all_, F.array(_fold(F.element_at(all_, -1))))).alias("levels"))


def _beside(levels: Column, p: Column, k: Column) -> Column:
    """The hash beside node ``p >> k`` of a level, and whether it stands to the right."""
    here = F.call_function("shiftright", p, k)
    row = F.get(levels, k)
    return F.struct(F.coalesce(F.get(row, here.bitwiseXOR(F.lit(1))), F.get(row, here)).alias("hash"), (here.bitwiseAND(F.lit(1)) == 0).alias("right"))


def merkle_roots(leaves: DataFrame) -> DataFrame:
    """(batch, root, n): leaf hashes sorted, each hashed once more, neighbours hashed together level by
    level, an odd last one with itself."""
    if (whole := _whole(leaves)) is not None:
        return whole.select("batch", F.get(F.element_at("levels", -1), F.lit(0)).alias("root"), F.size("leaves").cast("long").alias("n"))
    nodes, rounds = _rounds(leaves)
    level = nodes.select("batch", "i", "m", "h")
    for _ in range(rounds):
        level = _above(_runs(level))
    return level.select("batch", F.col("h").alias("root")).join(leaves.groupBy("batch").agg(F.count("*").alias("n")), "batch")


def merkle_paths(leaves: DataFrame) -> DataFrame:
    """(batch, leaf, i, path): the hashes beside the way from a leaf to the root, the leaf's own first,
    with ``right`` where the hash stands to the right."""
    if (whole := _whole(leaves)) is not None:
        steps = F.when(F.size("levels") > 1, F.sequence(F.lit(0), F.size("levels") - 2)).otherwise(F.array().cast("array<int>"))
        each = whole.select("batch", "levels", steps.alias("steps"), F.posexplode("leaves").alias("p", "l"))
        return each.select("batch", "l.leaf", F.col("p").cast("long").alias("i"), F.transform("steps", lambda k: _beside(F.col("levels"), F.col("p"), k)).alias("path"))
    nodes, rounds = _rounds(leaves)
    out = nodes.select("batch", "leaf", "i", F.col("i").alias("at"), F.array().cast("array<struct<hash:string,right:boolean>>").alias("path"))
    level = nodes.select("batch", "i", "m", "h")
    for _ in range(rounds):
        runs = _runs(level)
        depth = F.size("levels") - 1
        steps = F.when(depth > 0, F.sequence(F.lit(0), depth - 1)).otherwise(F.array().cast("array<int>"))
        ways = F.transform(
            F.get("levels", F.lit(0)),
            lambda _, p: F.struct(p.alias("p"), F.transform(steps, lambda k: _beside(F.col("levels"), p, k)).alias("way")),
        )
        ways = runs.select("batch", "run", F.explode(ways).alias("w")).select("batch", (F.col("run") * RUN + F.col("w.p")).alias("at"), "w.way")
        out = out.join(ways, ["batch", "at"]).select("batch", "leaf", "i", F.floor(F.col("at") / RUN).alias("at"), F.concat("path", "way").alias("path"))
        level = _above(runs)
    return out.select("batch", "leaf", "i", "path")


def proven_root(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, F.sha2(leaf, 256), lambda h, s: F.sha2(F.when(s["right"], F.concat(h, s["hash"])).otherwise(F.concat(s["hash"], h)), 256))


def audit_batches(roots: DataFrame, declared: DataFrame) -> DataFrame:
    """Batches whose declared root differs from the recomputed one."""
    return declared.join(roots, "batch", "left").where(~F.col("root").eqNullSafe(F.col("declared"))).select("batch", "declared", "root")


def audit_proofs(proofs: DataFrame, declared: DataFrame) -> DataFrame:
    """(batch, n, n_ok): inclusion proofs (batch, leaf, path) that lead to the batch's declared root."""
    ok = proven_root(F.col("leaf"), F.col("path")) == F.col("declared")
    return proofs.join(declared.select("batch", "declared"), "batch", "left").groupBy("batch").agg(
        F.count("*").alias("n"), F.sum(F.coalesce(ok, F.lit(False)).cast("long")).alias("n_ok")
    )


def audit_segments(records: DataFrame, segments: DataFrame) -> DataFrame:
    """Per segment the hash of its record hashes in order against the stored trailer. Records stream
    through their task in order, so a segment of any length takes a constant amount of memory."""
    ship(records.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segment, n, digest = None, 0, hashlib.sha256()
        for batch in batches:
            done = []
            for own, part in batch.groupby("segment", sort=False):
                if n and own != segment:
                    done.append((segment, digest.hexdigest(), n))
                    n, digest = 0, hashlib.sha256()
                segment, n = own, n + len(part)
                digest.update("".join(part["hash"]).encode())
            yield pd.DataFrame(done, columns=["segment", "found", "n"])
        if n:
            yield pd.DataFrame([(segment, digest.hexdigest(), n)], columns=["segment", "found", "n"])

    kind = records.schema["segment"].dataType.simpleString()
    rows = records.select("segment", "pos", "hash").repartition("segment").sortWithinPartitions("segment", "pos", "hash")
    g = rows.mapInPandas(run, f"segment {kind}, found string, n long")
    return segments.join(g, "segment", "left").select("segment", "n", F.coalesce(F.col("found") == F.col("trailer"), F.lit(False)).alias("ok"))


def change_rows(facts: DataFrame) -> DataFrame:
    """The change feed of a finished table: old value, new value and delta at every write of a key."""
    w = Window.partitionBy("cell", "band").orderBy("signed_at", "event_id")
    j = facts.withColumn("old", F.lag("num").over(w)).where("old is not null")
    return j.select("event_id", "old", F.col("num").alias("new"), (F.col("num") - F.col("old")).alias("delta"))
