"""Reading, keying, looking up and checking facts: whole tables of requests against whole tables of facts.

A fact is (cell, band, tslot, num, kind, fact_cid, signed_at, ...); kind is primary, absence or
derivative. A stored absence is a row; it is neither null nor a missing row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .grid import CELL_PREFIX, LAT_BITS, LNG_BITS, parent_cell
from .tables import small_side, top_k, written

KEY = ("cell", "band", "tslot")
#: A window is cut into pieces of RADIX ** level slots, of PIECE_LEVELS levels.
RADIX, PIECE_LEVELS = 16, 9


def read_facts(spark: SparkSession, path: str, bands: list[str] | None = None, cells: DataFrame | None = None, tslots: tuple[int, int] | None = None) -> DataFrame:
    """Facts pruned by band set, slot range (both pushed to the scan) and a table of cells."""
    df = spark.read.parquet(path)
    if bands is not None:
        df = df.where(F.col("band").isin(bands))
    if tslots is not None:
        df = df.where(F.col("tslot").between(*tslots))
    return df if cells is None else df.join(cells.select("cell").distinct(), "cell", "left_semi")


def latest_facts(facts: DataFrame, order: tuple[str, ...] = ("signed_at", "event_id"), key: tuple[str, ...] = KEY) -> DataFrame:
    """Last write of every key; derivatives are never keyed. Grouping keeps one row per key and task
    before the shuffle."""
    if "kind" in facts.columns:
        facts = facts.where("kind is null or kind <> 'derivative'")
    rest = [c for c in facts.columns if c not in key]
    best = facts.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*[F.col(c) if c in key else F.col(f"r.{c}").alias(c) for c in facts.columns])


def append_facts(facts: DataFrame, path: str) -> None:
    """Append bodies by band; readers resolve the last write with ``latest_facts``."""
    facts.repartition("band", F.pmod(F.hash("cell"), F.lit(16))).write.mode("append").partitionBy("band").parquet(path)


def first_available(providers: list[DataFrame], key: list[str], value: str = "value") -> DataFrame:
    """The first provider in order that has a value, and its position."""
    ranked = None
    for i, df in enumerate(providers):
        rows = df.where(F.col(value).isNotNull()).select(*key, value, F.lit(i).alias("provider"))
        ranked = rows if ranked is None else ranked.unionByName(rows)
    assert ranked is not None
    best = ranked.groupBy(*key).agg(F.min(F.struct("provider", value)).alias("r"))
    return best.select(*key, F.col(f"r.{value}").alias(value), F.col("r.provider").alias("provider"))


def missing_slots(cells: DataFrame, facts: DataFrame, lo: int, hi: int, most: int = 64) -> DataFrame:
    """Slots in [lo, hi] that each (cell, band) of ``cells`` has no fact for, oldest first, at most
    ``most`` (1 to 1024) per pair."""
    most = min(max(most, 1), 1024)
    grid = cells.select("cell", "band", F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("tslot"))
    gaps = grid.join(facts.select(*KEY), list(KEY), "left_anti")
    return top_k(gaps, ["cell", "band"], [F.col("tslot")], most).drop("rank")


def missing_slots_between(cells: DataFrame, facts: DataFrame, tempos: DataFrame, start: int, end: int, most: int = 64) -> DataFrame:
    """``missing_slots`` of a window in Unix seconds: every band has slots of its own length. ``tempos``:
    (band, seconds), 0 for a static band, whose only slot is 0; bands without a tempo are left out."""
    most = min(max(most, 1), 1024)
    step = F.greatest("seconds", F.lit(1))
    first, last = (F.when(F.col("seconds") == 0, 0).otherwise(F.floor(F.lit(t) / step)).cast("bigint") for t in (start, end))
    ranged = cells.select("cell", "band").join(small_side(tempos), "band").where(F.lit(start <= end)).select("cell", "band", F.explode(F.sequence(first, last)).alias("tslot"))
    gaps = ranged.join(facts.select(*KEY), list(KEY), "left_anti")
    return top_k(gaps, ["cell", "band"], [F.col("tslot")], most).drop("rank")


def purge(facts: DataFrame, fn_keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows kept, dry-run counts per purged recipe key)."""
    stale = F.col("fn_key").isin(fn_keys)
    return facts.where(~stale), facts.where(stale).groupBy("fn_key").agg(F.count("*").alias("n"))


def stale_grid(cell: Column) -> Column:
    """Whether a cell lies outside the present grid: other bits where the grid's prefix stands."""
    return F.shiftright(cell, LAT_BITS + LNG_BITS) != CELL_PREFIX >> (LAT_BITS + LNG_BITS)


def purge_plan(index: DataFrame, bodies: DataFrame, fn_keys: list[str], grid: bool = True, orphans: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(index rows kept, bodies kept, dry-run counts by reason). An index row goes for its recipe key,
    then for a stale grid cell; a body goes if no row that is kept points to it. Nulls are kept."""
    why = F.when(F.col("fn_key").isin(fn_keys), "fn_key")
    if grid:
        why = why.when(stale_grid(F.col("cell")), "stale_grid")
    judged = index.withColumn("reason", why)
    kept = judged.where("reason is null").drop("reason")
    gone = judged.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))
    if not orphans:
        return kept, bodies, gone
    lost = orphan_bodies(bodies, kept).agg(F.lit("orphan").alias("reason"), F.count("*").alias("n")).where("n > 0")
    return kept, bodies.join(kept.select("fact_cid"), "fact_cid", "left_semi"), gone.unionByName(lost)


def apply_purge(kept: DataFrame, path: str) -> DataFrame:
    """Write the rows kept to a new path, which readers then take instead of the old one."""
    kept.write.parquet(path)
    return kept.sparkSession.read.schema(kept.schema).parquet(path)


def orphan_bodies(bodies: DataFrame, index: DataFrame) -> DataFrame:
    """Bodies that no key points to."""
    return bodies.join(index.select("fact_cid"), "fact_cid", "left_anti")


def recall(requests: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts of (req_id, cell, bands, tslots) requests; null bands or tslots mean all. A request
    without a match gives one row of nulls; every row lists the bands stored at the cell. Requests that
    name bands meet the facts by (cell, band), only the others by cell."""
    stored = facts.groupBy("cell").agg(F.array_sort(F.collect_set("band")).alias("bands_at_cell"))
    f = facts.select("cell", "band", "tslot", "num", "fact_cid")
    named = requests.where("bands is not null").select("req_id", "cell", F.explode(F.array_distinct("bands")).alias("band"), "tslots")
    whole = requests.where("bands is null").select("req_id", "cell", "tslots")
    asked = F.col("tslots").isNull() | F.array_contains("tslots", F.col("tslot"))
    columns = ["req_id", "band", "tslot", "num", "fact_cid"]
    hits = named.join(f, ["cell", "band"]).where(asked).select(*columns).union(whole.join(f, "cell").where(asked).select(*columns))
    return requests.select("req_id", "cell").join(hits, "req_id", "left").join(stored, "cell", "left")


def _claim_test(op: Column, num: Column, value: Column, values: Column) -> Column:
    """A row's verdict; a row without a number differs from every value (ne is true, all else false)."""
    missing = num.isNull()
    nan = F.isnan(num)
    return (
        F.when(op == "eq", ~missing & (num == value))
        .when(op == "ne", missing | (num != value))
        .when(op == "lt", ~missing & ~nan & (num < value))
        .when(op == "le", ~missing & ~nan & (num <= value))
        .when(op == "gt", ~missing & ~nan & (num > value))
        .when(op == "ge", ~missing & ~nan & (num >= value))
        .when(op == "in", ~missing & values.isNotNull() & F.coalesce(F.array_contains(values, num), F.lit(False)))
        .when(op == "ni", ~missing & values.isNotNull() & ~F.coalesce(F.array_contains(values, num), F.lit(False)))
        .otherwise(F.lit(False))
    )


def _multiple(x: Column, unit: int) -> Column:
    """The largest multiple of ``unit`` up to x."""
    return x - F.pmod(x, F.lit(unit).cast("bigint"))


def window_pieces(windows: DataFrame, lo: str, hi: str) -> DataFrame:
    """One row per piece (piece_level, piece) of each window [lo, hi]: whole runs of RADIX ** level slots,
    the widest that fit, at most 2 * RADIX a level; so the pieces grow with the logarithm of the window. An
    empty window has none, nor has one without both ends."""
    first, last = F.col(lo).cast("bigint"), F.least(F.col(hi).cast("bigint"), F.lit((1 << 62) - 1))
    levels = F.array(*[F.struct(F.lit(k).alias("__level"), F.lit(RADIX**k).cast("bigint").alias("__unit"), F.lit(RADIX ** (k + 1)).cast("bigint").alias("__wide")) for k in range(PIECE_LEVELS)])
    w = windows.where(F.col(lo) <= F.col(hi)).select("*", first.alias("__first"), (last + 1).alias("__end"), F.inline(levels))
    level, unit, wide = F.col("__level"), F.col("__unit"), F.col("__wide")

    def whole(size: Column) -> tuple[Column, Column]:
        """Ends of the whole runs of a size inside the window."""
        return F.col("__first") + F.pmod(-F.col("__first"), size), F.col("__end") - F.pmod(F.col("__end"), size)

    (a, b), (wide_a, wide_b) = whole(unit), whole(wide)
    w = w.withColumns({"__a": a, "__b": b, "__wa": wide_a, "__wb": wide_b})
    # what the next level's runs leave over to the left and to the right, or all where it has none
    some = (level < PIECE_LEVELS - 1) & (F.col("__wa") <= F.col("__wb"))
    w = w.where("__a < __b").withColumns({"__left": F.when(some, F.col("__wa")).otherwise(F.col("__b")), "__right": F.when(some, F.col("__wb")).otherwise(F.col("__b"))})

    def run(x: str, y: str) -> Column:
        numbers = F.sequence(F.call_function("div", F.col(x), unit), F.call_function("div", F.col(y), unit) - 1)
        return F.when(F.col(x) < F.col(y), numbers).otherwise(F.array().cast("array<bigint>"))

    pieces = F.explode(F.concat(run("__a", "__left"), run("__right", "__b")))
    return w.select(*[F.col(f"`{c}`") for c in windows.columns], level.alias("piece_level"), pieces.alias("piece"))


def in_windows(windows: DataFrame, facts: DataFrame, lo: str, hi: str, slot: str = "tslot") -> DataFrame:
    """Each window (cell, band, lo, hi, ...) with the facts of its cell and band in [lo, hi]. Facts of the
    cells and bands asked for carry their piece at every level in use and meet the windows by equality: no
    window is spread over its slots, and none meets the facts of its (cell, band) that lie outside."""
    keys = ["cell", "band"]
    cut = written(window_pieces(windows, lo, hi))
    used = sorted(r["piece_level"] for r in cut.select("piece_level").distinct().collect())
    if not used:
        return cut.drop("piece_level", "piece").join(facts, keys)
    wanted = facts.join(windows.select(*keys).distinct(), keys, "left_semi")
    levels = F.array(*[F.struct(F.lit(k).alias("piece_level"), F.call_function("div", _multiple(F.col(slot), RADIX**k), F.lit(RADIX**k).cast("bigint")).alias("piece")) for k in used])
    pieces = wanted.where(F.col(slot).isNotNull()).select("*", F.inline(levels))
    return cut.join(pieces, [*keys, "piece_level", "piece"]).drop("piece_level", "piece")


def verify(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """(claim_id, verdict, n_values, evidence) of claims (claim_id, cell, band, op, value, vals,
    tslot, win_lo, win_hi, agg). A slot beats a window; neither means all slots; an unknown agg means
    any; min and max skip NaN; derivatives count for nothing."""
    f = facts.where("kind in ('primary', 'absence')").select("cell", "band", F.col("tslot").alias("f_tslot"), "num", "kind", "fact_cid")
    window = claims.where("tslot is null and win_lo is not null")
    parts = (
        claims.where("tslot is not null").withColumn("f_tslot", F.col("tslot")).join(f, ["cell", "band", "f_tslot"]),
        in_windows(window, f, "win_lo", "win_hi", "f_tslot"),
        claims.where("tslot is null and win_lo is null").join(f, ["cell", "band"]),
    )
    columns = ["claim_id", "op", "value", "vals", "num", "kind", "fact_cid"]
    j = parts[0].select(*columns).union(parts[1].select(*columns)).union(parts[2].select(*columns))
    value = F.col("kind") == "primary"
    num = F.when(value, F.col("num"))
    test = _claim_test(F.col("op"), num, F.col("value"), F.col("vals"))
    clean = F.when(value & ~F.isnan("num"), F.col("num"))
    found = j.groupBy("claim_id").agg(
        F.sum(value.cast("bigint")).alias("n_values"),
        F.sum((F.col("kind") == "absence").cast("bigint")).alias("n_absent"),
        F.bool_or(F.when(value, test)).alias("any"),
        F.bool_and(F.when(value, test)).alias("all"),
        F.avg(num).alias("mean"),
        F.min(clean).alias("min"),
        F.max(clean).alias("max"),
        F.array_sort(F.collect_list(F.when(value, F.col("fact_cid")))).alias("evidence"),
    )
    none = {"n_values": F.lit(0).cast("bigint"), "n_absent": F.lit(0).cast("bigint"), "any": F.lit(False), "all": F.lit(False), "evidence": F.array().cast("array<string>")}
    g = claims.select("claim_id", "op", "agg", "value", "vals").join(found, "claim_id", "left").withColumns({c: F.coalesce(c, v) for c, v in none.items()})
    folded = F.when(F.col("agg") == "mean", F.col("mean")).when(F.col("agg") == "min", F.col("min")).otherwise(F.col("max"))
    verdict = (
        F.when(F.col("op") == "exists", F.col("n_values") > 0)
        .when(F.col("op") == "absent", F.col("n_absent") > 0)
        .when(F.col("n_values") == 0, F.lit(False))
        .when(F.col("agg").isin("mean", "min", "max"), _claim_test(F.col("op"), folded, F.col("value"), F.col("vals")))
        .when(F.col("agg") == "all", F.col("all"))
        .otherwise(F.col("any"))
    )
    return g.select("claim_id", verdict.alias("verdict"), "n_values", "evidence")


def verify_resolve_plan(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """Claims that name a single slot with nothing stored: what has to be materialised first."""
    slot = F.coalesce("tslot", F.when(F.col("win_lo") == F.col("win_hi"), F.col("win_lo")))
    one = claims.withColumn("slot", slot).where("slot is not null")
    stored = facts.select("cell", "band", F.col("tslot").alias("slot"))
    return one.join(stored, ["cell", "band", "slot"], "left_anti").select("claim_id", "cell", "band", "slot")


def enforce_privacy(facts: DataFrame, bands: DataFrame, level: int, l2: bool = False, parent=None) -> DataFrame:
    """Facts that may be shown at a grid ``level`` with ``action`` permit or snap; refused ones are left
    out. A snapped row (level finer than the band's min_level) carries the coarser cell
    ``parent(cell, min_level)`` instead of its own. ``bands``: (band, privacy, min_level)."""
    action = (
        F.when(F.col("privacy") == "prohibited", "refuse")
        .when((F.col("privacy") == "l2_only") & F.lit(not l2), "refuse")
        .when((F.col("privacy") == "aggregate_only") & (F.lit(level) < F.col("min_level")), "snap")
        .otherwise("permit")
    )
    j = facts.join(small_side(bands), "band", "left").withColumn("action", action).where("action <> 'refuse'")
    snapped = F.col("action") == "snap"
    coarse = (parent or parent_cell)(F.col("cell"), F.col("min_level"))
    return j.withColumns({"cell": F.when(snapped, coarse).otherwise(F.col("cell")), "privacy_snapped": snapped}).drop("privacy", "min_level")


# Sensor tiers with the bands and the beginnings of bands that belong to them.
TIERS: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = (
    ("S1", ("sentinel1_raw",), ("s1.",)),
    ("S2", ("prithvi_eo2", "galileo_base", "clay_v1"), ("s2.", "indices.", "geotessera", "prithvi_eo2.", "galileo_base.", "clay_v1.")),
    ("Landsat", (), ("landsat.",)),
    ("Iot", (), ("iot.",)),
    ("OtherSat", (), ("modis.", "cams.", "marine.", "viirs.")),
)


def with_tier(facts: DataFrame, tiers=TIERS, default: str = "Static") -> DataFrame:
    """Facts with the sensor tier of their band; ``default`` for all others, also without a band."""
    band, tier = F.col("band"), F.lit(default)
    for name, bands, prefixes in reversed(tiers):
        own = band.isin(*bands) if bands else F.lit(False)
        for prefix in prefixes:
            own = own | band.startswith(prefix)
        tier = F.when(own, name).otherwise(tier)
    return facts.withColumn("tier", tier)


def mark_absence(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows outside their band's area or slots become absences with a reason. ``rules``: (band,
    max_abs_lat, slot_lo, slot_hi)."""
    j = df.join(small_side(rules), "band", "left")
    reason = F.when(F.abs("lat") > F.col("max_abs_lat"), "outside_area").when(
        ~F.col("tslot").between(F.col("slot_lo"), F.col("slot_hi")), "outside_time"
    )
    out = j.withColumn("reason", reason)
    return out.withColumns(
        {
            "kind": F.when(F.col("reason").isNotNull(), "absence").otherwise(F.col("kind")),
            "num": F.when(F.col("reason").isNull(), F.col("num")),
        }
    ).drop("max_abs_lat", "slot_lo", "slot_hi")


def loss_year(code: Column) -> Column:
    """Loss byte k to 2000 + k; 0 is no loss."""
    return F.when(code > 0, code + 2000)


# Classes of what drove a loss.
DRIVERS = {
    1: "Permanent agriculture", 2: "Hard commodities", 3: "Shifting cultivation", 4: "Logging", 5: "Wildfire", 6: "Settlements and infrastructure",
    7: "Other natural disturbances",
}
COMMODITY_DRIVERS, NATURAL_DRIVERS = (1, 2, 3), (5, 7)


def driver_label(code: Column) -> Column:
    """Name of a driver class; null for codes that are none."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in DRIVERS.items() for x in kv]), code.cast("int"))


def driver_group(code: Column) -> Column:
    """Commodity, natural or other; null for codes that are no class."""
    return F.when(code.isin(*COMMODITY_DRIVERS), "commodity").when(code.isin(*NATURAL_DRIVERS), "natural").when(code.isin(*DRIVERS), "other")


def disturbance_table(df: DataFrame) -> DataFrame:
    """Losses per year, driver class and group from (loss, driver) codes, and the first and last alert of
    the ordinal dates in ``alert``; cells without a loss are left out."""
    year = loss_year(F.col("loss"))
    keys = [year.alias("loss_year"), driver_label(F.col("driver")).alias("driver"), driver_group(F.col("driver")).alias("driver_group")]
    day = ordinal_date(F.col("alert"), (2019, 2100))
    return df.where("loss > 0").groupBy(*keys).agg(F.count("*").alias("n"), F.count(day).alias("alerts"), F.min(day).alias("first_alert"), F.max(day).alias("last_alert"))


def ordinal_date(code: Column, years: tuple[int, int] = (1, 9999)) -> Column:
    """YYYYDDD to a date; null outside the years or the year's days."""
    year, day = F.floor(code / 1000).cast("int"), (code % 1000).cast("int")
    first = F.make_date(F.when(year.between(*years), year), F.lit(1), F.lit(1))
    found = F.date_add(first, day - 1)
    return F.when(year.between(*years) & (day >= 1) & (F.year(found) == year), found)


HANDLE = r"^memt:(\d+):([A-Za-z0-9]+)$"


def resolve_tokens(tokens: DataFrame, facts: DataFrame) -> DataFrame:
    """``memt:<cell>:<cid>`` handles with status ok, unknown or malformed."""
    part = F.regexp_extract("token", HANDLE, 1), F.regexp_extract("token", HANDLE, 2)
    t = tokens.withColumn("cell", F.when(part[0] != "", part[0]).cast("bigint")).withColumn("fact_cid", F.when(part[1] != "", part[1]))
    j = t.join(facts.select("cell", "fact_cid", "band", "num", F.lit(True).alias("hit")), ["cell", "fact_cid"], "left")
    status = F.when(F.col("cell").isNull(), "malformed").when(F.col("hit"), "ok").otherwise("unknown")
    return j.select("token", status.alias("status"), "band", "num")


def trajectory(requests: DataFrame, facts: DataFrame, most: int = 64) -> DataFrame:
    """(req_id, points, stored_slots): ordered primary points in the window [lo, hi]; where there are
    none, the first ``most`` slots that hold something. Only points inside a window, and the slots of
    requests without one, are gathered."""
    f = facts.where("kind = 'primary'").select("cell", "band", "tslot", "num")
    inside = in_windows(requests, f, "lo", "hi").groupBy("req_id").agg(
        F.array_sort(F.collect_list(F.struct("tslot", "num"))).alias("points")
    )
    rest = requests.join(inside.select("req_id"), "req_id", "left_anti")
    slots = rest.join(f.select("cell", "band", "tslot").distinct(), ["cell", "band"])
    first = slots.withColumn("rn", F.row_number().over(Window.partitionBy("req_id").orderBy("tslot"))).where(F.col("rn") <= most)
    stored = first.groupBy("req_id").agg(F.array_sort(F.collect_list("tslot")).alias("slots"))
    j = requests.select("req_id").join(inside, "req_id", "left").join(stored, "req_id", "left")
    points = F.coalesce("points", F.array().cast(inside.schema["points"].dataType))
    empty = F.array().cast(stored.schema["slots"].dataType)
    return j.select("req_id", points.alias("points"), F.when(F.col("points").isNull(), F.coalesce("slots", empty)).alias("stored_slots"))


def pick_slot(facts: DataFrame, how: str = "newest", carry: tuple[str, ...] = ()) -> DataFrame:
    """Newest or oldest primary value of every (cell, band), with the columns named in ``carry``."""
    f = facts.where("kind = 'primary'")
    pick = F.max if how == "newest" else F.min
    best = f.groupBy("cell", "band").agg(pick(F.struct("tslot", "event_id", "num", *carry)).alias("r"))
    return best.select("cell", "band", "r.tslot", "r.num", *[f"r.{c}" for c in carry])


def diff(requests: DataFrame, facts: DataFrame) -> DataFrame:
    """Derivative rows value(tslot_b) - value(tslot_a) of requests with two different slots."""
    f = facts.where("kind = 'primary'")
    a = f.select("cell", "band", F.col("tslot").alias("tslot_a"), F.col("num").alias("num_a"), F.col("fact_cid").alias("cid_a"))
    b = f.select("cell", "band", F.col("tslot").alias("tslot_b"), F.col("num").alias("num_b"), F.col("fact_cid").alias("cid_b"))
    q = requests.where("tslot_a <> tslot_b")
    return q.join(a, ["cell", "band", "tslot_a"]).join(b, ["cell", "band", "tslot_b"]).select(
        "cell", "band", "tslot_a", "tslot_b", F.lit("delta").alias("op"), (F.col("num_b") - F.col("num_a")).alias("num"),
        F.array("cid_a", "cid_b").alias("parents"), F.lit(1.0).alias("confidence"), F.lit("nd.delta@1").alias("fn_key"),
    )


def compare_bands(requests: DataFrame, facts: DataFrame) -> DataFrame:
    """Delta of two bands of a cell at their newest slots, and the predicate's verdict: true, false or
    incomparable. ``requests``: (cell, band_a, band_b, predicate, threshold), and tslot where a request
    names its slot; a null one takes the newest."""
    newest = pick_slot(facts)

    def side(of: DataFrame, s: str) -> DataFrame:
        last = newest.select("cell", F.col("band").alias(f"band_{s}"), F.col("tslot").alias(f"tslot_{s}"), F.col("num").alias(f"num_{s}"))
        if "tslot" not in requests.columns:
            return of.join(last, ["cell", f"band_{s}"], "left")
        # a request without a slot never meets the slots, one with a slot never the newest
        at = facts.where("kind = 'primary'").groupBy("cell", "band", "tslot").agg(F.max(F.struct("event_id", "num")).alias("r"))
        at = at.select("cell", F.col("band").alias(f"band_{s}"), F.col("tslot"), F.col("tslot").alias(f"tslot_{s}"), F.col("r.num").alias(f"num_{s}"))
        free = of.where("tslot is null").join(last, ["cell", f"band_{s}"], "left")
        return free.unionByName(of.where("tslot is not null").join(at, ["cell", f"band_{s}", "tslot"], "left"))

    j = side(side(requests, "a"), "b")
    delta = F.col("num_b") - F.col("num_a")
    ok = F.when(F.col("predicate") == "abs_diff_le", F.abs(delta) <= F.col("threshold")).when(F.col("predicate") == "abs_diff_lt", F.abs(delta) < F.col("threshold"))
    return j.select(
        "cell", "band_a", "band_b", "tslot_a", "tslot_b", delta.alias("delta"), "predicate",
        F.coalesce(ok.cast("string"), F.lit("incomparable")).alias("verdict"),
    )


def compare_cells(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Per pair: band lists shared / only_a / only_b and b - a of the newest value of shared bands."""
    newest = pick_slot(facts)
    a = pairs.join(newest.select(F.col("cell").alias("a"), "band", F.col("num").alias("num_a")), "a")
    b = pairs.join(newest.select(F.col("cell").alias("b"), "band", F.col("num").alias("num_b")), "b")
    j = a.join(b, ["a", "b", "band"], "full")
    has_a, has_b = F.col("num_a").isNotNull(), F.col("num_b").isNotNull()
    return j.groupBy("a", "b").agg(
        F.array_join(F.array_sort(F.collect_list(F.when(has_a & has_b, F.col("band")))), ",").alias("shared"),
        F.array_join(F.array_sort(F.collect_list(F.when(has_a & ~has_b, F.col("band")))), ",").alias("only_a"),
        F.array_join(F.array_sort(F.collect_list(F.when(has_b & ~has_a, F.col("band")))), ",").alias("only_b"),
        F.sum(F.col("num_b") - F.col("num_a")).alias("sum_delta"),
    )
