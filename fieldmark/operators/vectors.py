"""Vector comparison and search over (cell, tslot, vec): cosine, sketches, rerank, consensus."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .grid import with_center
from .nearest import COSINE, HAMMING, nearest, ranked
from .tables import small_side, written

def dot(a: Column, b: Column) -> Column:
    """Over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def pick_vector(vecs: DataFrame, how: str) -> DataFrame:
    pick = F.max if how == "newest" else F.min
    return vecs.groupBy("cell").agg(pick(F.struct("tslot", "vec")).alias("r")).select("cell", "r.tslot", "r.vec")


def state_diff(vecs: DataFrame, t0: int, t1: int) -> DataFrame:
    """Residual, L2 and cosine of two vintages of every cell that has both."""
    a = vecs.where(F.col("tslot") == t0).select("cell", F.col("vec").alias("a"))
    b = vecs.where(F.col("tslot") == t1).select("cell", F.col("vec").alias("b"))
    return a.join(b, "cell").select("cell", F.zip_with("a", "b", lambda x, y: y - x).alias("residual"), l2(F.col("a"), F.col("b")).alias("l2"), cosine(F.col("a"), F.col("b")).alias("cosine"))


def _newest(vecs: DataFrame, name: str) -> DataFrame:
    return vecs.where("vec is not null").groupBy("cell", "band").agg(F.max_by("vec", "tslot").alias(f"v_{name}"), F.max("tslot").alias(f"t_{name}"))


def compare_vectors(pairs: DataFrame, vecs: DataFrame, family: str = "") -> DataFrame:
    """Per pair (a, b): vector bands that both cells have, each one's cosine (in the order of names), and
    one cosine over all of them together, each band cut to the shorter length; null where none is
    shared. ``family`` keeps the bands whose names begin so."""
    v = vecs.where(F.col("band").startswith(family))
    x = pairs.join(_newest(v, "a").withColumnRenamed("cell", "a"), "a")
    y = pairs.join(_newest(v, "b").withColumnRenamed("cell", "b"), "b").select("a", "b", "band", "v_b")
    n = F.least(F.size("v_a"), F.size("v_b"))
    p, q = F.slice("v_a", 1, n), F.slice("v_b", 1, n)
    j = x.join(y, ["a", "b", "band"]).select("a", "b", "band", dot(p, q).alias("pq"), dot(p, p).alias("pp"), dot(q, q).alias("qq"), cosine(F.col("v_a"), F.col("v_b")).alias("cosine"))
    g = j.groupBy("a", "b").agg(
        F.array_sort(F.collect_list(F.struct("band", "cosine"))).alias("bands"), F.sum("pq").alias("pq"), F.sum("pp").alias("pp"), F.sum("qq").alias("qq")
    )
    whole = F.when(F.col("pp") * F.col("qq") > 0, F.col("pq") / F.sqrt(F.col("pp") * F.col("qq"))).otherwise(0.0)
    told = g.select("a", "b", "bands", whole.alias("cosine"))
    return pairs.join(told, ["a", "b"], "left")


def compare_vector_bands(requests: DataFrame, vecs: DataFrame) -> DataFrame:
    """Cosine, L2 and per-dimension delta of two bands of a cell, at the request's slot or each band's
    newest, and the predicate's verdict: true, false, or incomparable where a side has no vector.
    ``requests``: (cell, band_a, band_b, tslot, predicate, threshold)."""

    def side(name: str) -> DataFrame:
        fixed = vecs.where("vec is not null").select("cell", F.col("band").alias(f"band_{name}"), F.col("tslot"), F.col("vec").alias(f"f_{name}"))
        newest = _newest(vecs, name).withColumnRenamed("band", f"band_{name}")
        return fixed, newest

    j = requests
    for name in "ab":
        fixed, newest = side(name)
        j = j.join(fixed, ["cell", f"band_{name}", "tslot"], "left").join(newest, ["cell", f"band_{name}"], "left")
        j = j.withColumns({f"v_{name}": F.when(F.col("tslot").isNull(), F.col(f"v_{name}")).otherwise(F.col(f"f_{name}")), f"t_{name}": F.coalesce("tslot", f"t_{name}")}).drop(f"f_{name}")
    n = F.least(F.size("v_a"), F.size("v_b"))
    a, b = F.slice("v_a", 1, n), F.slice("v_b", 1, n)
    both = F.col("v_a").isNotNull() & F.col("v_b").isNotNull()
    j = j.select(
        "cell", "band_a", "band_b", F.when(F.col("v_a").isNotNull(), F.col("t_a")).alias("tslot_a"), F.when(F.col("v_b").isNotNull(), F.col("t_b")).alias("tslot_b"), "predicate", "threshold",
        F.when(both, cosine(F.col("v_a"), F.col("v_b"))).alias("cosine"), F.when(both, l2(a, b)).alias("l2"), F.when(both, F.zip_with(a, b, lambda x, y: y - x)).alias("delta"),
    )
    ok = F.when(F.col("predicate") == "cosine_ge", F.col("cosine") >= F.col("threshold")).when(F.col("predicate") == "cosine_gt", F.col("cosine") > F.col("threshold")).when(
        F.col("predicate") == "l2_le", F.col("l2") <= F.col("threshold")
    )
    return j.withColumn("verdict", F.coalesce(ok.cast("string"), F.lit("incomparable"))).drop("threshold")


def diff_vectors(requests: DataFrame, vecs: DataFrame) -> DataFrame:
    """Derivative rows vec(tslot_b) - vec(tslot_a), cut to the shorter length, of requests (cell, band,
    tslot_a, tslot_b) with two different slots."""
    q = requests.where("tslot_a <> tslot_b")
    for name in "ab":
        q = q.join(vecs.where("vec is not null").select("cell", "band", F.col("tslot").alias(f"tslot_{name}"), F.col("vec").alias(f"v_{name}")), ["cell", "band", f"tslot_{name}"])
    n = F.least(F.size("v_a"), F.size("v_b"))
    delta = F.zip_with(F.slice("v_a", 1, n), F.slice("v_b", 1, n), lambda x, y: y - x)
    return q.select("cell", "band", "tslot_a", "tslot_b", F.lit("delta").alias("op"), delta.alias("vec"), F.lit(1.0).alias("confidence"), F.lit("nd.delta@1").alias("fn_key"))


def find_similar(queries: DataFrame, vecs: DataFrame, k: int = 10) -> DataFrame:
    """Top k cells by cosine for every query vector, its own cell left out; best slot per cell. Null
    vectors have no score, vectors with NaN or null components none either, zero vectors 0; of
    vectors of unequal length the longer one's rest counts in its norm only."""
    q = queries.where("vec is not null").select(F.col("cell").alias("q"), F.col("vec").alias("key"))
    v = vecs.where("vec is not null").select("cell", F.col("vec").alias("key"))
    return ranked(nearest(q, v, k, COSINE), k)


def similar_places(found: DataFrame, k: int, places: DataFrame | None = None, max_km: float = 300.0) -> DataFrame:
    """Neighbours (q, cell, score, rank) of grid cells with each one's centre, how many were asked for and
    found, and the nearest of ``places`` (id, lat, lng) within ``max_km``."""
    from .spatial import nearest_place

    told = with_center(found).join(found.groupBy("q").agg(F.count("*").alias("returned_k")), "q").withColumn("requested_k", F.lit(k))
    if places is None:
        return told
    centres = with_center(found.select("cell").distinct()).withColumnRenamed("cell", "id")
    near = nearest_place(centres, places, max_km, 5.0).select(F.col("id").alias("cell"), "place", "km")
    return told.join(near, "cell", "left")


def find_similar_where(queries: DataFrame, vecs: DataFrame, claim: dict, facts: DataFrame, k: int = 10) -> DataFrame:
    """``find_similar`` among the cells that satisfy a claim (band, op, value, and vals, tslot, win_lo, win_hi or
    agg as ``verify`` takes them); each cell is judged once, by its facts."""
    from .lookup import verify

    kinds = {"band": "string", "op": "string", "value": "double", "vals": "array<double>", "tslot": "bigint", "win_lo": "bigint", "win_hi": "bigint", "agg": "string"}
    cells = vecs.select("cell").distinct()

    def term(name: str) -> Column:
        v = claim.get(name)
        return (F.array(*map(F.lit, v)) if isinstance(v, list | tuple) else F.lit(v)).cast(kinds[name]).alias(name)

    claims = cells.select(F.col("cell").alias("claim_id"), "cell", *map(term, kinds))
    admitted = verify(claims, facts).where("verdict").select(F.col("claim_id").alias("cell"))
    return find_similar(queries, vecs.join(written(admitted), "cell", "left_semi"), k)


def pack_bits(vecs: DataFrame) -> DataFrame:
    """(cell, tslot, dims, bits): sign bits (>= 0 is 1) of all components, the first one highest, in words
    of 64 bits, the last padded with zeros; a null vector has null bits."""
    n = F.size("vec")
    padded = F.concat(F.col("vec").cast("array<double>"), F.array_repeat(F.lit(-1.0), F.pmod(-n, F.lit(64)).cast("int")))
    starts = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(64))).otherwise(F.array().cast("array<int>"))
    word = lambda at: F.aggregate(
        F.transform(F.slice(F.col("padded"), at, 64), lambda v: F.when(v >= 0, F.lit(1)).otherwise(0).cast("bigint")), F.lit(0).cast("bigint"),
        lambda a, b: F.shiftleft(a, 1).bitwiseOR(b),
    )
    rows = vecs.select("cell", "tslot", F.when(F.col("vec").isNotNull(), n).alias("dims"), padded.alias("padded"), starts.alias("starts"))
    return rows.select("cell", "tslot", "dims", F.when(F.col("dims").isNotNull(), F.transform("starts", word)).alias("bits"))


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    """Seeded orthogonal matrix."""
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))[0]


def rotate(vecs: DataFrame, r: np.ndarray) -> DataFrame:
    """Vectors times the rotation."""
    rows = F.array(*[F.array(*map(F.lit, map(float, row))) for row in r.T])
    return vecs.withColumn("vec", F.transform(rows, lambda row: dot(F.col("vec"), row)))


def find_similar_hamming(queries: DataFrame, bits: DataFrame, k: int) -> DataFrame:
    """Nearest sketches of the same number of dimensions: distance, score 1 - 2 d / dims, one row per
    cell. ``queries``: (q, dims, bits), ``bits``: (cell, dims, bits)."""
    key = F.concat(F.array(F.col("dims").cast("long")), "bits").alias("key")
    asked = queries.where("bits is not null")
    near = nearest(asked.select("q", key), bits.where("bits is not null").select("cell", key), k, HAMMING)
    return ranked(near.join(asked.select("q", "dims"), "q").withColumn("d", F.round((1 - F.col("score")) * F.col("dims") / 2).cast("int")).drop("dims"), k)


def triage_size(k: int, recall: float | None) -> int:
    return k * (4 if not recall else min(max(int(np.ceil(1 / recall)), 4), 16))


def rerank(triage: DataFrame, queries: DataFrame, vecs: DataFrame, k: int) -> DataFrame:
    """Hamming candidates ordered by cosine of the candidates' vectors."""
    best = triage.join(vecs.select("cell", "vec"), "cell", "left").join(queries.select(F.col("cell").alias("q"), F.col("vec").alias("qv")), "q")
    s = best.groupBy("q", "cell").agg(F.max(F.coalesce(cosine(F.col("qv"), F.col("vec")), F.col("score"))).alias("score"))
    return ranked(s, k)


def triage_recall(triage: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """Share of the exact top k that the triage list's top k holds."""
    hit = exact.join(triage.where(F.col("rank") <= k).select("q", "cell", F.lit(1).alias("hit")), ["q", "cell"], "left")
    return hit.groupBy("q").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"))


def recall_ewma(recalls: DataFrame, alpha: float = 0.05, warm: int = 50) -> DataFrame:
    """(q, ewma, warm): the running average of recalls in the order of queries, begun by the first one,
    and whether enough of them were seen. Null recalls are left out.

    Rows are cut into ranges of q, one per task. Over a range the average is a linear function of the
    average before it, so one pass gives each range's sum, factor and count, the driver chains these (one
    row a range), and a second pass runs every range from its own start."""
    cut = recalls.where("recall is not null").select("q", F.col("recall").cast("double").alias("recall"))
    rows = written(cut.repartitionByRange("q").withColumn("range", F.spark_partition_id()))

    def steps(x: np.ndarray, start: float | None) -> np.ndarray:
        out = np.empty(len(x))
        for i, v in enumerate(x):
            start = v if start is None else (1 - alpha) * start + alpha * v
            out[i] = start
        return out

    def sums(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values(["q", "recall"])["recall"].to_numpy()
        told = (rows["range"].iloc[0], rows["q"].min(), len(x), steps(x, None)[-1], steps(x, 0.0)[-1], (1 - alpha) ** len(x))
        return pd.DataFrame([told], columns=["range", "from", "n", "begun", "sum", "factor"])

    ends = rows.groupBy("range").applyInPandas(sums, "range int, from long, n long, begun double, sum double, factor double").orderBy("from").collect()
    starts: dict[int, float | None] = {}
    before: dict[int, int] = {}
    at, seen = None, 0
    for r in ends:
        starts[r["range"]], before[r["range"]] = at, seen
        at, seen = (r["begun"] if at is None else r["sum"] + r["factor"] * at), seen + r["n"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, own = rows.sort_values(["q", "recall"]), rows["range"].iloc[0]
        place = before[own] + np.arange(1, len(rows) + 1)
        return pd.DataFrame({"q": rows["q"], "ewma": steps(rows["recall"].to_numpy(), starts[own]), "warm": place >= warm})

    return rows.groupBy("range").applyInPandas(run, "q long, ewma double, warm boolean")


def consensus(lists: list[DataFrame]) -> DataFrame:
    """How many lists of (q, cell) hold each cell."""
    u = lists[0].select("q", "cell")
    for x in lists[1:]:
        u = u.union(x.select("q", "cell"))
    n = u.groupBy("q", "cell").agg(F.count("*").alias("n"))
    label = F.when(F.col("n") == 3, "all_three").when(F.col("n") == 2, "two_of_three").otherwise("one_or_none")
    return n.withColumn("agreement", label)


def classify_archetype(vecs: DataFrame, centroids: DataFrame) -> DataFrame:
    """Nearest labelled centroid by cosine and its margin. ``centroids``: (label, centre), a few."""
    j = vecs.select("vec_id", "vec").join(small_side(centroids), how="cross").select("vec_id", "label", cosine(F.col("vec"), F.col("centre")).alias("s"))
    g = j.groupBy("vec_id").agg(F.slice(F.sort_array(F.collect_list(F.struct(F.round("s", 9).alias("s"), (-F.col("label")).alias("l"))), False), 1, 2).alias("t"))
    return g.select("vec_id", (-F.get("t", F.lit(0))["l"]).alias("archetype"), (F.get("t", F.lit(0))["s"] - F.get("t", F.lit(1))["s"]).alias("margin"))


def state_cube(rows: DataFrame, bands: list[tuple[str, int]]) -> DataFrame:
    """Concatenation of bands (name, dims) in order, zeros for gaps, and the list of missing bands."""
    g = rows.groupBy("cell").pivot("band", [b for b, _ in bands]).agg(F.max_by("vec", "tslot"))
    parts = [F.coalesce(F.col(b), F.array_repeat(F.lit(0.0), n)) for b, n in bands]
    gone = F.array_compact(F.array(*[F.when(F.col(b).isNull(), F.lit(b)) for b, _ in bands]))
    return g.select("cell", F.concat(*parts).alias("cube"), gone.alias("missing"))


def state_multi(rows: DataFrame, encoders: list[str]) -> DataFrame:
    """Map encoder -> newest vector per cell, and the encoders without one."""
    newest = rows.groupBy("cell", "band").agg(F.max_by("vec", "tslot").alias("vec"))
    g = newest.groupBy("cell").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("band", "vec")))).alias("state"))
    return g.withColumn("missing", F.array_except(F.array(*map(F.lit, encoders)), F.map_keys("state")))


def change_consensus(rows: DataFrame, gate: float = 0.15) -> DataFrame:
    """Per cell the change 1 - cos of every encoder between the newest two vintages, their root mean
    square, the votes over the gate and a label."""
    w = Window.partitionBy("cell", "band").orderBy(F.desc("tslot"))
    two = rows.withColumn("rn", F.row_number().over(w)).where("rn <= 2")
    g = two.groupBy("cell", "band").agg(F.max(F.when(F.col("rn") == 1, F.col("vec"))).alias("a"), F.max(F.when(F.col("rn") == 2, F.col("vec"))).alias("b"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - cosine(F.col("a"), F.col("b"))))
    s = g.where("b is not null").select("cell", score.alias("s"))
    e = s.groupBy("cell").agg(F.sqrt(F.avg(F.col("s") * F.col("s"))).alias("ensemble"), F.sum((F.col("s") > gate).cast("bigint")).alias("votes"), F.count("*").alias("n"))
    label = F.when(F.col("votes") == F.col("n"), "changed").when(F.col("votes") > 0, "mixed").otherwise("stable")
    return e.select("cell", "ensemble", "votes", label.alias("label"))


def rerank_by_centroid(hotspots: DataFrame, vecs: DataFrame) -> DataFrame:
    """Candidates of a group by cosine to the group's mean vector where three or more have a vector,
    else in their scalar order."""
    j = hotspots.join(vecs.select("cell", "vec"), "cell", "left")
    mean = (
        j.where("vec is not null").select("grp", F.posexplode("vec").alias("i", "x")).groupBy("grp", "i").agg(F.avg("x").alias("m"))
        .groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))
    )
    n = j.groupBy("grp").agg(F.count("vec").alias("with_vec"))
    k = j.join(n, "grp").join(mean, "grp", "left")
    by = F.when((F.col("with_vec") >= 3) & F.col("vec").isNotNull(), F.round(cosine(F.col("vec"), F.col("centre")), 9))
    w = Window.partitionBy("grp").orderBy(F.desc_nulls_last("by"), F.desc("value"), "cell")
    return k.withColumn("by", by).select("grp", "cell", F.row_number().over(w).alias("rank"), F.when(F.col("with_vec") >= 3, "centroid").otherwise("scalar").alias("reason"))


def fuse_elevation(rows: DataFrame) -> DataFrame:
    """Land surface on land, sea floor on water, and whether the two disagree by more than 5."""
    water = F.col("mask") == 1
    return rows.select("id", F.when(water, F.col("sea")).otherwise(F.col("land")).alias("elevation"), F.when(water, "sea").otherwise("land").alias("source"), (F.abs(F.col("sea") - F.col("land")) > 5).alias("disagree"))


# Gates of the change variants by domain.
VARIANT_GATE = {"forest": 0.20, "wetland": 0.10, "urban": 0.20, "coast": 0.12}


def change_variant(rows: DataFrame, domain: str, extra: DataFrame) -> DataFrame:
    """``change_consensus`` at the domain's gate with an uplift tag. ``extra``: (cell, leg), the domain's
    own measure: loss mask, recurrence points, building delta, or elevation."""
    c = change_consensus(rows, VARIANT_GATE[domain]).join(extra, "cell", "left")
    leg = F.coalesce("leg", F.lit(0.0))
    tag = {
        "forest": leg > 0,
        "wetland": F.abs(leg) >= 15,
        "urban": F.abs(leg) > 0,
        "coast": leg.between(-5, 5),
    }[domain]
    return c.select("cell", "ensemble", "votes", "label", ((F.col("votes") > 0) & tag).alias("uplift"))
