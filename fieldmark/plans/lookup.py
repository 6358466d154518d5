"""Queries over facts: reading, keying, recall, claims, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.operators import grid as G
from fieldmark.operators import lookup as L
from fieldmark.sources import fixtures as X
from fieldmark.sources.fixtures import scratch

from .base import catalog

QUERIES, SQL, query = catalog()


def latest(spark: SparkSession, d: str) -> DataFrame:
    return L.latest_facts(X.facts(spark, d))


@query(X.with_("facts") + "SELECT cell, band, tslot, num, fact_cid FROM facts WHERE band IN ('click','purchase') AND tslot BETWEEN 19728 AND 19740 AND cell IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)")
def a01_read_facts(spark, d):
    cells = X.read(spark, d, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("cell"))
    path = scratch(spark)
    L.append_facts(X.facts(spark, d), path)
    f = L.read_facts(spark, path, ["click", "purchase"], cells, (19728, 19740))
    return f.select("cell", "band", "tslot", "num", "fact_cid")


def store(spark, d):
    """Half of the facts, then the other half appended."""
    from fieldmark.sources.fact_store import FactStore

    f = X.facts(spark, d)
    s = FactStore.create(f.where("event_id % 2 = 0"), scratch(spark), 8)
    s.append(f.where("event_id % 2 = 1"))
    return s


@query(X.with_("facts", "latest") + "SELECT cell, band, tslot, num, fact_cid FROM latest WHERE band IN ('click','purchase') AND tslot BETWEEN 19728 AND 19740 AND cell IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)")
def a01_store_lookup(spark, d):
    cells = X.read(spark, d, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("cell"))
    return store(spark, d).compacted().lookup(cells, ["click", "purchase"], (19728, 19740)).select("cell", "band", "tslot", "num", "fact_cid")


@query(X.with_("facts", "latest") + "SELECT cell, band, tslot, num, fact_cid, kind FROM latest")
def a02_store_latest(spark, d):
    return store(spark, d).latest().select("cell", "band", "tslot", "num", "fact_cid", "kind")


@query(X.with_("facts", "latest") + "SELECT cell, band, tslot, num, fact_cid, kind FROM latest")
def a02_latest_facts(spark, d):
    return latest(spark, d).select("cell", "band", "tslot", "num", "fact_cid", "kind")


@query(
    X.with_("facts")
    + """, p AS (SELECT 0 AS provider, cell, tslot, max(num) AS value FROM facts WHERE band='purchase' GROUP BY ALL
    UNION ALL SELECT 1, cell, tslot, max(num) FROM facts WHERE band='click' GROUP BY ALL UNION ALL SELECT 2, cell, tslot, max(num) FROM facts WHERE band='view' GROUP BY ALL)
    SELECT cell, tslot, value, provider FROM p QUALIFY row_number() OVER (PARTITION BY cell, tslot ORDER BY provider)=1"""
)
def a07_first_available(spark, d):
    f = X.facts(spark, d)
    by = [f.where(F.col("band") == b).groupBy("cell", "tslot").agg(F.max("num").alias("value")) for b in ("purchase", "click", "view")]
    return L.first_available(by, ["cell", "tslot"])


@query(
    X.with_("facts")
    + """, g AS (SELECT cell, band, unnest(range(19723, 19754)) AS tslot FROM (SELECT DISTINCT cell, band FROM facts))
    SELECT cell, band, CAST(tslot AS BIGINT) AS tslot FROM g WHERE NOT EXISTS (SELECT 1 FROM facts f WHERE f.cell=g.cell AND f.band=g.band AND f.tslot=g.tslot)
    QUALIFY row_number() OVER (PARTITION BY cell, band ORDER BY tslot) <= 16"""
)
def a09_missing_slots(spark, d):
    f = X.facts(spark, d)
    return L.missing_slots(f.select("cell", "band").distinct(), f, 19723, 19753, 16).withColumn("tslot", F.col("tslot").cast("bigint"))


@query(
    X.with_("facts")
    + """, t(band, seconds) AS (VALUES ('click', 86400), ('purchase', 691200), ('view', 0), ('error', 2592000)), f AS (SELECT cell, band, CASE WHEN seconds=0 THEN 0 ELSE (tslot*86400)//seconds END AS tslot, seconds FROM facts JOIN t USING (band)),
    g AS (SELECT cell, band, unnest(CASE WHEN seconds=0 THEN [0] ELSE range(CAST(1704000000//seconds AS BIGINT), CAST(1706600000//seconds AS BIGINT)+1) END) AS tslot FROM (SELECT DISTINCT cell, band, seconds FROM f))
    SELECT cell, band, CAST(tslot AS BIGINT) AS tslot FROM g WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.cell=g.cell AND f.band=g.band AND f.tslot=g.tslot) QUALIFY row_number() OVER (PARTITION BY cell, band ORDER BY tslot) <= 5"""
)
def a09_missing_slots_by_tempo(spark, d):
    rows = [("click", 86400), ("purchase", 691200), ("view", 0), ("error", 2592000)]
    tempos = spark.createDataFrame(rows, "band string, seconds long")
    slot = F.when(F.col("seconds") == 0, 0).otherwise(F.floor(F.col("tslot") * 86400 / F.greatest("seconds", F.lit(1))))
    f = X.facts(spark, d).join(tempos, "band").withColumn("tslot", slot.cast("bigint"))
    return L.missing_slots_between(f.select("cell", "band").distinct(), f, tempos, 1704000000, 1706600000, 5)


@query(X.with_("facts") + "SELECT fn_key, count(*) AS n FROM facts WHERE fn_key IN ('f1','f3') GROUP BY fn_key")
def a10_purge_dry_run(spark, d):
    return L.purge(X.facts(spark, d), ["f1", "f3"])[1]


# every third user has a cell of the present grid
GRID_FACTS = f"g AS (SELECT fact_cid, fn_key, band, CASE WHEN cell%3=0 THEN {G.CELL_PREFIX}+cell ELSE cell END AS cell FROM facts), i AS (SELECT *, CASE WHEN fn_key IN ('f1','f3') THEN 'fn_key' WHEN (cell>>43)<>({G.CELL_PREFIX}>>43) THEN 'stale_grid' END AS reason FROM g)"


def grid_facts(spark, d):
    f = X.facts(spark, d).select("fact_cid", "fn_key", "band", "cell")
    return f.withColumn("cell", F.when(F.col("cell") % 3 == 0, F.col("cell") + G.CELL_PREFIX).otherwise(F.col("cell")))


@query(X.with_("facts", extra=GRID_FACTS) + "SELECT reason, count(*) AS n FROM i WHERE reason IS NOT NULL GROUP BY 1 UNION ALL SELECT 'orphan', count(*) FROM i WHERE reason IS NOT NULL HAVING count(*)>0")
def a10_purge_plan(spark, d):
    f = grid_facts(spark, d)
    return L.purge_plan(f, f.select("fact_cid"), ["f1", "f3"])[2]


@query(X.with_("facts", extra=GRID_FACTS) + "SELECT fact_cid, fn_key, band, cell FROM i WHERE reason IS NULL")
def a10_apply_purge(spark, d):
    f = grid_facts(spark, d)
    return L.apply_purge(L.purge_plan(f, f.select("fact_cid"), ["f1", "f3"])[0], scratch(spark))


@query(X.with_("facts", "latest") + "SELECT fact_cid, cell, band FROM facts WHERE fact_cid NOT IN (SELECT fact_cid FROM latest)")
def a10_orphan_bodies(spark, d):
    f = X.facts(spark, d)
    return L.orphan_bodies(f, L.latest_facts(f)).select("fact_cid", "cell", "band")


@query(
    X.with_("facts", "latest")
    + """, q AS (SELECT c_custkey AS req_id, c_custkey AS cell, CASE WHEN c_nationkey%2=0 THEN ['click','error'] END AS bands, CASE WHEN c_nationkey%3=0 THEN [19725,19730] END AS tslots FROM customer),
    b AS (SELECT cell, string_agg(DISTINCT band, ',' ORDER BY band) AS bands_at_cell FROM latest GROUP BY cell)
    SELECT q.req_id, q.cell, f.band, f.tslot, f.num, f.fact_cid, b.bands_at_cell FROM q LEFT JOIN latest f ON f.cell=q.cell AND (q.bands IS NULL OR list_contains(q.bands, f.band)) AND (q.tslots IS NULL OR list_contains(q.tslots, f.tslot)) LEFT JOIN b ON b.cell=q.cell"""
)
def c01_recall(spark, d):
    c = X.read(spark, d, "customer")
    q = c.select(
        F.col("c_custkey").alias("req_id"),
        F.col("c_custkey").alias("cell"),
        F.when(F.col("c_nationkey") % 2 == 0, F.array(F.lit("click"), F.lit("error"))).alias("bands"),
        F.when(F.col("c_nationkey") % 3 == 0, F.array(F.lit(19725).cast("bigint"), F.lit(19730).cast("bigint"))).alias("tslots"),
    )
    return L.recall(q, latest(spark, d)).withColumn("bands_at_cell", F.array_join("bands_at_cell", ","))


CLAIMS_SQL = """claims AS (SELECT o_orderkey AS claim_id, o_custkey % 150 AS cell, ['click','purchase','error','view'][o_orderkey%4+1] AS band,
  ['eq','ne','lt','le','gt','ge','exists','absent'][o_orderkey%8+1] AS op, CAST(o_orderkey%500 AS DOUBLE) AS value,
  CASE WHEN o_orderkey%3=0 THEN 19723+o_orderkey%30 END AS tslot, CASE WHEN o_orderkey%3=1 THEN 19725 END AS win_lo, CASE WHEN o_orderkey%3=1 THEN 19725+o_orderkey%10 END AS win_hi,
  ['any','all','mean','min','max'][o_orderkey%5+1] AS agg FROM orders)"""


def claims(spark, d) -> DataFrame:
    k = F.col("o_orderkey")

    def pick(values, n):
        return F.element_at(F.array(*map(F.lit, values)), (k % n + 1).cast("int"))

    return X.read(spark, d, "orders").select(
        k.alias("claim_id"),
        (F.col("o_custkey") % 150).alias("cell"),
        pick(("click", "purchase", "error", "view"), 4).alias("band"),
        pick(("eq", "ne", "lt", "le", "gt", "ge", "exists", "absent"), 8).alias("op"),
        (k % 500).cast("double").alias("value"),
        F.lit(None).cast("array<double>").alias("vals"),
        F.when(k % 3 == 0, 19723 + k % 30).alias("tslot"),
        F.when(k % 3 == 1, F.lit(19725)).cast("bigint").alias("win_lo"),
        F.when(k % 3 == 1, 19725 + k % 10).alias("win_hi"),
        pick(("any", "all", "mean", "min", "max"), 5).alias("agg"),
    )


def _test_sql(num: str) -> str:
    return f"CASE op WHEN 'eq' THEN {num}=value WHEN 'ne' THEN {num}<>value WHEN 'lt' THEN {num}<value WHEN 'le' THEN {num}<=value WHEN 'gt' THEN {num}>value WHEN 'ge' THEN {num}>=value END"


@query(
    X.with_("facts", "latest", extra=CLAIMS_SQL)
    + f""", j AS (SELECT c.*, f.num, f.kind, f.fact_cid FROM claims c LEFT JOIN latest f ON f.cell=c.cell AND f.band=c.band AND CASE WHEN c.tslot IS NOT NULL THEN f.tslot=c.tslot WHEN c.win_lo IS NOT NULL THEN f.tslot BETWEEN c.win_lo AND c.win_hi ELSE true END),
    g AS (SELECT claim_id, any_value(op) AS op, any_value(agg) AS agg, any_value(value) AS value, count(*) FILTER (kind='primary') AS n_values, count(*) FILTER (kind='absence') AS n_absent,
      bool_or({_test_sql("num")}) FILTER (kind='primary') AS t_any, bool_and({_test_sql("num")}) FILTER (kind='primary') AS t_all, avg(num) FILTER (kind='primary') AS m, min(num) FILTER (kind='primary') AS lo, max(num) FILTER (kind='primary') AS hi,
      coalesce(string_agg(fact_cid, ',' ORDER BY fact_cid) FILTER (kind='primary'), '') AS evidence FROM j GROUP BY claim_id),
    h AS (SELECT *, CASE agg WHEN 'mean' THEN m WHEN 'min' THEN lo ELSE hi END AS folded FROM g)
    SELECT claim_id, n_values, evidence, CASE WHEN op='exists' THEN n_values>0 WHEN op='absent' THEN n_absent>0 WHEN n_values=0 THEN false WHEN agg IN ('mean','min','max') THEN {_test_sql("folded")} WHEN agg='all' THEN t_all ELSE t_any END AS verdict FROM h"""
)
def c02_verify(spark, d):
    return L.verify(claims(spark, d), latest(spark, d)).withColumn("evidence", F.array_join("evidence", ","))


@query(
    X.with_("facts", "latest", extra=CLAIMS_SQL)
    + """SELECT claim_id, cell, band, coalesce(tslot, CASE WHEN win_lo=win_hi THEN win_lo END) AS slot FROM claims c WHERE coalesce(tslot, CASE WHEN win_lo=win_hi THEN win_lo END) IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM latest f WHERE f.cell=c.cell AND f.band=c.band AND f.tslot=coalesce(c.tslot, c.win_lo))"""
)
def c03_verify_resolve_plan(spark, d):
    return L.verify_resolve_plan(claims(spark, d), latest(spark, d))


PRIVACY = [("click", "public", 0), ("purchase", "aggregate_only", 8), ("error", "prohibited", 0), ("view", "l2_only", 0)]


@query(
    X.with_("facts")
    + """SELECT CASE WHEN band='purchase' THEN cell//8*8 ELSE cell END AS cell, band, fact_cid, num, CASE band WHEN 'purchase' THEN 'snap' ELSE 'permit' END AS action, band='purchase' AS privacy_snapped FROM facts WHERE band NOT IN ('error','view')"""
)
def c04_enforce_privacy(spark, d):
    bands = spark.createDataFrame(PRIVACY, "band string, privacy string, min_level int")
    blocks = lambda cell, level: F.floor(cell / level).cast("bigint") * level  # noqa: E731 - these cells are plain numbers
    out = L.enforce_privacy(X.facts(spark, d), bands, level=4, parent=blocks)
    return out.select("cell", "band", "fact_cid", "num", "action", "privacy_snapped")


TIERED = {
    "S1": ("sentinel1_raw", "s1.vv"), "S2": ("s2.B04", "indices.ndvi", "geotessera", "geotessera.2024", "prithvi_eo2", "prithvi_eo2.mean", "galileo_base", "galileo_base.a", "clay_v1", "clay_v1.5"),
    "Landsat": ("landsat.b4",), "Iot": ("iot.pm25",), "OtherSat": ("modis.ndvi_mean", "cams.no2", "marine.sst", "viirs.dnb"),
    "Static": ("sentinel1_raw2", "s1", "s2", "indices", "prithvi_eo2x", "clay_v12", "landsat", "era5.t2m", "power.ghi", "soilgrids.ph", "hansen.loss", "modisx"),
}
TIER_BANDS = [b for names in TIERED.values() for b in names]
TIER_SQL = "tiers (band, tier) AS (VALUES " + ", ".join(f"('{b}', '{t}')" for t, names in TIERED.items() for b in names) + ")"


@query(
    f"WITH {TIER_SQL}, e AS (SELECT ["
    + ", ".join(f"'{b}'" for b in TIER_BANDS)
    + f"][event_id%{len(TIER_BANDS)}+1] AS band FROM events) SELECT band, tier, count(*) AS n FROM e JOIN tiers USING (band) GROUP BY ALL"
)
def c05_with_tier(spark, d):
    names = F.array(*map(F.lit, TIER_BANDS))
    e = X.read(spark, d, "events").select(F.element_at(names, (F.col("event_id") % len(TIER_BANDS) + 1).cast("int")).alias("band"))
    return L.with_tier(e).groupBy("band", "tier").agg(F.count("*").alias("n"))


@query(
    X.with_("facts")
    + f""", p AS (SELECT *, {X.point_sql("cell")} FROM facts)
    SELECT fact_cid, reason, CASE WHEN reason IS NOT NULL THEN 'absence' ELSE kind END AS kind, CASE WHEN reason IS NULL THEN num END AS num FROM (
    SELECT *, CASE WHEN band='click' AND abs(lat)>50 THEN 'outside_area' WHEN band='purchase' AND abs(lat)>30 THEN 'outside_area' WHEN band='click' AND tslot NOT BETWEEN 19725 AND 19745 THEN 'outside_time' WHEN band='purchase' AND tslot NOT BETWEEN 0 AND 19740 THEN 'outside_time' END AS reason FROM p)"""
)
def c06_mark_absence(spark, d):
    rules = spark.createDataFrame([("click", 50.0, 19725, 19745), ("purchase", 30.0, 0, 19740)], "band string, max_abs_lat double, slot_lo long, slot_hi long")
    return L.mark_absence(X.with_point(X.facts(spark, d), "cell"), rules).select("fact_cid", "reason", "kind", "num")


@query(
    """SELECT 2000 + code AS loss_year, count(*) AS n, min(CAST(make_date(2000+code,1,1) + CAST(day-1 AS INTEGER) AS DATE)) AS first_day FROM (SELECT year(l_shipdate)-1990 AS code, 1+l_orderkey%365 AS day FROM lineitem WHERE l_returnflag='R') GROUP BY 1"""
)
def c07_decode_loss(spark, d):
    li = X.read(spark, d, "lineitem").where("l_returnflag = 'R'")
    rows = li.select((F.year("l_shipdate") - 1990).cast("bigint").alias("code"), (1 + F.col("l_orderkey") % 365).alias("day"))
    return rows.groupBy(L.loss_year(F.col("code")).alias("loss_year")).agg(
        F.count("*").alias("n"), F.min(L.ordinal_date((2000 + F.col("code")) * 1000 + F.col("day"))).alias("first_day")
    )


@query(
    """WITH c AS (SELECT CASE WHEN l_returnflag='R' THEN year(l_shipdate)-1985 ELSE 0 END AS loss, l_linenumber+l_suppkey%3 AS driver, (2017+l_orderkey%5)*1000+l_partkey%400 AS alert FROM lineitem),
    o AS (SELECT *, CASE WHEN alert//1000>=2019 AND alert%1000>=1 AND alert%1000<=CASE WHEN alert//1000=2020 THEN 366 ELSE 365 END THEN CAST(make_date(CAST(alert//1000 AS INT),1,1) + CAST(alert%1000-1 AS INTEGER) AS DATE) END AS day FROM c WHERE loss>0)
    SELECT 2000+loss AS loss_year, ['Permanent agriculture','Hard commodities','Shifting cultivation','Logging','Wildfire','Settlements and infrastructure','Other natural disturbances'][driver] AS driver,
    CASE WHEN driver<=3 THEN 'commodity' WHEN driver IN (5,7) THEN 'natural' WHEN driver<=7 THEN 'other' END AS driver_group, count(*) AS n, count(day) AS alerts, min(day) AS first_alert, max(day) AS last_alert FROM o GROUP BY 1,2,3"""
)
def c07_disturbance_table(spark, d):
    loss = F.when(F.col("l_returnflag") == "R", F.year("l_shipdate") - 1985).otherwise(0).cast("bigint")
    driver, alert = F.col("l_linenumber") + F.col("l_suppkey") % 3, (2017 + F.col("l_orderkey") % 5) * 1000 + F.col("l_partkey") % 400
    return L.disturbance_table(X.read(spark, d, "lineitem").select(loss.alias("loss"), driver.alias("driver"), alert.alias("alert")))


@query(
    X.with_("facts")
    + """, t AS (SELECT CASE WHEN o_orderkey%7=0 THEN 'memt:' || o_orderkey ELSE 'memt:' || (o_orderkey%150) || ':' || (o_orderkey%10000) END AS token FROM orders),
    p AS (SELECT token, TRY_CAST(regexp_extract(token, '^memt:(\\d+):([A-Za-z0-9]+)$', 1) AS BIGINT) AS cell, regexp_extract(token, '^memt:(\\d+):([A-Za-z0-9]+)$', 2) AS cid FROM t)
    SELECT p.token, CASE WHEN p.cell IS NULL THEN 'malformed' WHEN f.fact_cid IS NOT NULL THEN 'ok' ELSE 'unknown' END AS status, f.band, f.num FROM p LEFT JOIN facts f ON f.cell=p.cell AND f.fact_cid=p.cid"""
)
def c08_resolve_tokens(spark, d):
    k = F.col("o_orderkey")
    token = F.when(k % 7 == 0, F.concat(F.lit("memt:"), k.cast("string"))).otherwise(F.concat_ws(":", F.lit("memt"), (k % 150).cast("string"), (k % 10000).cast("string")))
    return L.resolve_tokens(X.read(spark, d, "orders").select(token.alias("token")), X.facts(spark, d))


PAIRS_SQL = "pairs AS (SELECT c_custkey % 150 AS a, (c_custkey*7+3) % 150 AS b FROM customer WHERE c_custkey % 150 <> (c_custkey*7+3) % 150 GROUP BY ALL)"
NEWEST_SQL = "newest AS (SELECT cell, band, tslot, num FROM facts WHERE kind='primary' QUALIFY row_number() OVER (PARTITION BY cell, band ORDER BY tslot DESC, event_id DESC)=1)"


@query(
    X.with_("facts", extra=f"{PAIRS_SQL}, {NEWEST_SQL}")
    + """, x AS (SELECT p.a, p.b, n.band, n.num FROM pairs p JOIN newest n ON n.cell=p.a), y AS (SELECT p.a, p.b, n.band, n.num FROM pairs p JOIN newest n ON n.cell=p.b),
    j AS (SELECT coalesce(x.a,y.a) AS a, coalesce(x.b,y.b) AS b, coalesce(x.band,y.band) AS band, x.num AS na, y.num AS nb FROM x FULL JOIN y ON x.a=y.a AND x.b=y.b AND x.band=y.band)
    SELECT a, b, coalesce(string_agg(band, ',' ORDER BY band) FILTER (na IS NOT NULL AND nb IS NOT NULL),'') AS shared, coalesce(string_agg(band, ',' ORDER BY band) FILTER (nb IS NULL),'') AS only_a,
    coalesce(string_agg(band, ',' ORDER BY band) FILTER (na IS NULL),'') AS only_b, round(sum(nb-na),6) AS sum_delta FROM j GROUP BY a, b"""
)
def d01_compare(spark, d):
    a, b = F.col("c_custkey") % 150, (F.col("c_custkey") * 7 + 3) % 150
    pairs = X.read(spark, d, "customer").select(a.alias("a"), b.alias("b")).where("a <> b").distinct()
    return L.compare_cells(pairs, X.facts(spark, d)).withColumn("sum_delta", F.round("sum_delta", 6))


@query(
    X.with_("facts", extra=NEWEST_SQL)
    + """, q AS (SELECT DISTINCT cell, 'click' AS band_a, 'purchase' AS band_b FROM facts) SELECT q.cell, q.band_a, q.band_b, a.tslot AS tslot_a, b.tslot AS tslot_b, round(b.num-a.num,6) AS delta, 'abs_diff_le' AS predicate,
    coalesce(CAST(abs(b.num-a.num)<=50.0 AS VARCHAR),'incomparable') AS verdict FROM q LEFT JOIN newest a ON a.cell=q.cell AND a.band=q.band_a LEFT JOIN newest b ON b.cell=q.cell AND b.band=q.band_b"""
)
def d02_compare_bands(spark, d):
    f = X.facts(spark, d)
    q = f.select("cell").distinct().select("cell", F.lit("click").alias("band_a"), F.lit("purchase").alias("band_b"), F.lit("abs_diff_le").alias("predicate"), F.lit(50.0).alias("threshold"))
    return L.compare_bands(q, f).withColumn("delta", F.round("delta", 6))


@query(
    X.with_("facts", extra=NEWEST_SQL)
    + """, q AS (SELECT DISTINCT cell, 'click' AS band_a, 'view' AS band_b, CASE WHEN cell%4<>0 THEN tslot END AS tslot FROM facts),
    s AS (SELECT cell, band, tslot, arg_max(num, event_id) AS num FROM facts WHERE kind='primary' GROUP BY ALL),
    v AS (SELECT cell, band, tslot AS asked, tslot, num FROM s UNION ALL SELECT cell, band, NULL, tslot, num FROM newest)
    SELECT q.cell, q.band_a, q.band_b, a.tslot AS tslot_a, b.tslot AS tslot_b, round(b.num-a.num,6) AS delta, 'abs_diff_lt' AS predicate, coalesce(CAST(abs(b.num-a.num)<30.0 AS VARCHAR),'incomparable') AS verdict
    FROM q LEFT JOIN v a ON a.cell=q.cell AND a.band=q.band_a AND a.asked IS NOT DISTINCT FROM q.tslot LEFT JOIN v b ON b.cell=q.cell AND b.band=q.band_b AND b.asked IS NOT DISTINCT FROM q.tslot"""
)
def d02_compare_bands_at_slot(spark, d):
    f = X.facts(spark, d)
    asked = f.select("cell", F.when(F.col("cell") % 4 != 0, F.col("tslot")).alias("tslot")).distinct()
    q = asked.select("cell", "tslot", F.lit("click").alias("band_a"), F.lit("view").alias("band_b"), F.lit("abs_diff_lt").alias("predicate"), F.lit(30.0).alias("threshold"))
    return L.compare_bands(q, f).withColumn("delta", F.round("delta", 6))


@query(
    X.with_("facts", "latest")
    + """SELECT a.cell, a.band, a.tslot AS tslot_a, b.tslot AS tslot_b, 'delta' AS op, round(b.num-a.num,6) AS num, a.fact_cid || ',' || b.fact_cid AS parents, 1.0::DOUBLE AS confidence, 'nd.delta@1' AS fn_key
    FROM latest a JOIN latest b ON a.cell=b.cell AND a.band=b.band AND b.tslot=a.tslot+1 WHERE a.kind='primary' AND b.kind='primary'"""
)
def d03_diff(spark, d):
    f = latest(spark, d)
    q = f.select("cell", "band", F.col("tslot").alias("tslot_a"), (F.col("tslot") + 1).alias("tslot_b"))
    return L.diff(q, f).withColumn("parents", F.array_join("parents", ",")).withColumn("num", F.round("num", 6))


@query(
    X.with_("facts", "latest")
    + """, q AS (SELECT DISTINCT cell AS req_id, cell, 'click' AS band, 19730 AS lo, 19730 + cell%4 AS hi FROM facts), j AS (SELECT q.req_id, q.lo, q.hi, f.tslot, f.num FROM q LEFT JOIN latest f ON f.cell=q.cell AND f.band=q.band AND f.kind='primary')
    SELECT req_id, count(*) FILTER (tslot BETWEEN lo AND hi) AS n_points, min(tslot) FILTER (tslot BETWEEN lo AND hi) AS first_slot, CASE WHEN count(*) FILTER (tslot BETWEEN lo AND hi)=0 THEN count(DISTINCT tslot) END AS n_stored FROM j GROUP BY req_id"""
)
def g01_trajectory(spark, d):
    f = latest(spark, d)
    q = f.select("cell").distinct().select(F.col("cell").alias("req_id"), "cell", F.lit("click").alias("band"), F.lit(19730).alias("lo"), (19730 + F.col("cell") % 4).alias("hi"))
    t = L.trajectory(q, f)
    return t.select(
        "req_id", F.size("points").cast("bigint").alias("n_points"), F.get("points", F.lit(0))["tslot"].alias("first_slot"),
        F.when(F.col("stored_slots").isNotNull(), F.size("stored_slots")).cast("bigint").alias("n_stored"),
    )


@query(X.with_("facts", extra=NEWEST_SQL) + "SELECT * FROM newest")
def g02_pick_newest(spark, d):
    return L.pick_slot(X.facts(spark, d), "newest")


@query(X.with_("facts") + "SELECT cell, band, tslot, num FROM facts WHERE kind='primary' QUALIFY row_number() OVER (PARTITION BY cell, band ORDER BY tslot, event_id)=1")
def g02_pick_oldest(spark, d):
    return L.pick_slot(X.facts(spark, d), "oldest")
