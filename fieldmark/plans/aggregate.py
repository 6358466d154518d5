"""Queries over regions, months, formulas, series and result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmark.operators import aggregate as A
from fieldmark.operators import formula as M
from fieldmark.operators import series as S
from fieldmark.sources import fixtures as X

from .base import catalog
from .grid import DENSE, dense
from .lookup import latest

QUERIES, SQL, query = catalog()


REGION_SQL = "regions AS (SELECT DISTINCT user_id AS cell, user_id % 12 AS region FROM events)"
P90 = "CAST(floor((count(*)-1)*0.9+0.5) AS BIGINT)"


def regions(spark, d):
    return X.facts(spark, d).select("cell", (F.col("cell") % 12).alias("region")).distinct()


@query(
    X.with_("facts", "latest", extra=REGION_SQL)
    + """, r AS (SELECT region, band, num FROM latest JOIN regions USING (cell) WHERE kind='primary'), k AS (SELECT *, row_number() OVER (PARTITION BY region, band ORDER BY num)-1 AS rn, count(*) OVER (PARTITION BY region, band) AS c FROM r)
    SELECT region, band, count(*) AS n, round(avg(num)+1e-9,6) AS mean, round(median(num),6) AS median, max(num) FILTER (rn = CAST(floor((c-1)*0.9+0.5) AS BIGINT)) AS p90 FROM k GROUP BY region, band"""
)
def f02_query_region(spark, d):
    r = A.query_region(regions(spark, d), latest(spark, d))
    return r.select("region", "band", "n", F.round(F.col("mean") + 1e-9, 6).alias("mean"), F.round("median", 6).alias("median"), "p90")


@query(
    X.with_("facts", "latest", extra=REGION_SQL)
    + "SELECT region, band, round(avg(num)+1e-9,6) AS mean, round(median(num),6) AS median, min(num) AS min, max(num) AS max, round(stddev_pop(num),5) AS std FROM latest JOIN regions USING (cell) WHERE kind='primary' GROUP BY ALL"
)
def f03_zonal_stats(spark, d):
    return A.zonal_stats(regions(spark, d), latest(spark, d)).withColumns({"mean": F.round(F.col("mean") + 1e-9, 6), "median": F.round("median", 6), "std": F.round("std", 5)})


@query(
    X.with_("facts", "latest", extra=REGION_SQL)
    + "SELECT region, round(avg(num) FILTER (band='click')+1e-9,6) AS click, round(avg(num) FILTER (band='purchase')+1e-9,6) AS purchase, round(median(num) FILTER (band='click')+1e-9,6) AS click_median, round(median(num) FILTER (band='purchase')+1e-9,6) AS purchase_median FROM latest JOIN regions USING (cell) WHERE kind='primary' GROUP BY region"
)
def f04_place_profile(spark, d):
    p = A.place_profile(regions(spark, d), latest(spark, d), ["click", "purchase"])
    return p.select("region", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in p.columns[1:]])


@query(
    X.with_("vecs", extra="regions AS (SELECT DISTINCT cell, cell % 12 AS region FROM vecs)")
    + """, e AS (SELECT region, band, generate_subscripts(vec,1) AS i, unnest(vec) AS x FROM vecs JOIN regions USING (cell)), m AS (SELECT region, band, i, avg(x) AS m FROM e GROUP BY ALL), n AS (SELECT region, band, count(*) AS n FROM vecs JOIN regions USING (cell) GROUP BY ALL)
    SELECT region, band, n, list(round(m,6) ORDER BY i) AS centroid FROM m JOIN n USING (region, band) GROUP BY ALL"""
)
def f02_region_centroids(spark, d):
    v = X.vecs(spark, d)
    r = A.region_centroids(v.select("cell", (F.col("cell") % 12).alias("region")).distinct(), v)
    return r.withColumn("centroid", F.transform("centroid", lambda x: F.round(x, 6)))


@query(X.with_("facts", "latest", extra=REGION_SQL) + "SELECT region, cell, band, tslot, num FROM latest JOIN regions USING (cell) WHERE kind='primary'")
def f03_zonal_cells(spark, d):
    return A.zonal_cells(regions(spark, d), latest(spark, d))


@query(
    X.with_("samples")
    + "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((cop-swr)/nullif(cop+swr,0),6) AS ndvi, round(2.5*(cop-swr)/nullif(cop+6*swr-7.5*rh+1,0),4) AS evi, round((rh-cop)/nullif(rh+cop,0),6) AS ndwi FROM samples"
)
def f05_spectral_indices(spark, d):
    s = X.samples(spark, d)
    return s.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(A.ratio_index(F.col("cop"), F.col("swr")), 6).alias("ndvi"),
        F.round(A.enhanced_vegetation(F.col("rh"), F.col("swr"), F.col("cop")), 4).alias("evi"),
        F.round(A.ratio_index(F.col("rh"), F.col("cop")), 6).alias("ndwi"),
    )


@query(
    X.with_("samples")
    + """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(1e-9+0.55*(swr/100)+0.25*(CASE WHEN abs(cop-gmrt)>5 THEN 0.5 ELSE 1 END)*(greatest(50-cop,0)/50)+0.2*(1/(1+exp(-((-15-s1)/2)))),6) AS flood_risk,
    round(1/(1+exp(-((-15-s1)/2))),6) AS water FROM samples"""
)
def f01_evaluate(spark, d):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    out = M.evaluate(X.samples(spark, d), {k: M.RECIPES[k] for k in ("flood_risk", "water")}, keys)
    return out.select(*keys, F.round(F.col("flood_risk") + 1e-9, 6).alias("flood_risk"), F.round("water", 6).alias("water"))


@query(
    X.with_("samples")
    + """SELECT l_partkey%50 AS g, round(avg(0.6108*exp(17.27*temp/(temp+237.3))*(1-rh/100)),5) AS vpd, sum(CASE WHEN ndvi<0 THEN 0 ELSE least(4, 1+(ndvi>0.1)::INT+(ndvi>0.3)::INT+(ndvi>0.5)::INT) END)::DOUBLE AS vegetation,
    sum(CASE WHEN precip<0.1 THEN 0 WHEN precip<1 THEN 1 WHEN precip<5 THEN 2 WHEN precip<10 THEN 3 WHEN precip<60 THEN 4 ELSE 5 END)::DOUBLE AS precipitation FROM samples GROUP BY 1"""
)
def f10_recipe_pack(spark, d):
    s = X.samples(spark, d).withColumn("g", F.col("l_partkey") % 50)
    out = M.evaluate(s, {k: M.RECIPES[k] for k in ("vpd", "vegetation", "precipitation")}, ["g"])
    return out.groupBy("g").agg(F.round(F.avg("vpd"), 5).alias("vpd"), F.sum("vegetation").alias("vegetation"), F.sum("precipitation").alias("precipitation"))


OBS = "obs AS (SELECT user_id AS cell, event_type AS band, CAST(date_trunc('week', ts) AS DATE) AS month, value AS num FROM events)"


def obs(spark, d):
    e = X.read(spark, d, "events")
    return e.select(F.col("user_id").alias("cell"), F.col("event_type").alias("band"), F.to_date(F.date_trunc("week", F.col("ts").cast("timestamp"))).alias("month"), F.col("value").alias("num"))


@query(f"WITH {OBS} SELECT cell, band, month, round(median(num),6) AS median, round(avg(num),6) AS mean, count(*) AS n FROM obs GROUP BY ALL")
def f07_monthly_composite(spark, d):
    return A.monthly_composite(obs(spark, d)).withColumns({"median": F.round("median", 6), "mean": F.round("mean", 6)})


@query(f"WITH {OBS} SELECT cell, band, month, 'absence' AS kind, 'below_threshold' AS reason FROM obs GROUP BY ALL HAVING max(num)<20")
def f08_derive_absence(spark, d):
    return A.derive_absence(obs(spark, d), 20.0)


@query(
    X.with_("facts")
    + """, n AS (SELECT cell, band, count(*) AS n FROM facts GROUP BY ALL) SELECT cell, first(band ORDER BY n DESC, band) AS mode, round(max(n)/sum(n),6) AS share, count(*) AS classes FROM n GROUP BY cell"""
)
def f09_class_profile(spark, d):
    return A.class_profile(X.facts(spark, d), ["cell"], "band").withColumn("share", F.round("share", 6))


@query(X.with_("facts") + "SELECT cell, " + ", ".join(f"round(count(*) FILTER (band='{c}')/count(*),6) AS {c}" for c in ("click", "error", "purchase", "view")) + " FROM facts GROUP BY cell")
def f09_class_shares(spark, d):
    shares = A.class_shares(X.facts(spark, d), ["cell"], "band", ["click", "error", "purchase", "view"])
    return shares.select("cell", *[F.round(c, 6).alias(c) for c in shares.columns[1:]])


@query(
    """SELECT ['veg_closed','veg_open','crop_annual','crop_perennial','built','bare','water','cryo'][least(code//8,7)+1] AS family, 'lcv-1.f' || (code//8) || '.l' || (code%8) AS id, count(*) AS n FROM (SELECT l_partkey%80 AS code FROM lineitem) GROUP BY ALL"""
)
def f09_landcover_family(spark, d):
    code = F.col("l_partkey") % 80
    return X.read(spark, d, "lineitem").groupBy(A.landcover_family(code).alias("family"), A.landcover_id(code).alias("id")).agg(F.count("*").alias("n"))


@query(
    """WITH p AS (SELECT l_suppkey AS plot, l_quantity*2 AS canopy, CASE WHEN l_returnflag='R' THEN year(l_shipdate)+20 ELSE 0 END AS loss_year, l_linestatus='F' AS base2020 FROM lineitem),
    c AS (SELECT plot, CASE WHEN NOT (base2020 OR (canopy>10 AND (loss_year=0 OR loss_year>2020))) THEN 3 WHEN loss_year>2020 THEN 2 ELSE 1 END AS v FROM p)
    SELECT plot, count(*) AS cells, round(sum((v=2)::INT)/count(*),6) AS failing_share, CASE WHEN sum((v=2)::INT)>0 THEN 'fail' WHEN sum((v=1)::INT)>0 THEN 'pass' ELSE 'not_in_scope' END AS verdict FROM c GROUP BY plot"""
)
def f11_screen_plots(spark, d):
    li = X.read(spark, d, "lineitem")
    p = li.select(
        F.col("l_suppkey").alias("plot"), (F.col("l_quantity") * 2).alias("canopy"), F.when(F.col("l_returnflag") == "R", F.year("l_shipdate") + 20).otherwise(0).alias("loss_year"),
        (F.col("l_linestatus") == "F").alias("base2020"), F.lit(0).alias("other_loss"),
    )
    return A.screen_plots(p).withColumn("failing_share", F.round("failing_share", 6))


PLOTS = "p AS (SELECT l_partkey AS plot, l_orderkey || '-' || l_linenumber AS fact_cid, CASE WHEN l_partkey%50<>0 THEN l_quantity*2 END AS canopy, CASE WHEN l_returnflag='R' THEN year(l_shipdate)+27 ELSE 0 END AS loss_year, l_linestatus='F' AS base2020 FROM lineitem)"
FOREST = "(base2020 OR (canopy>10 AND (loss_year=0 OR loss_year>2020)))"


def small_plots(spark, d):
    return X.read(spark, d, "lineitem").select(
        F.col("l_partkey").alias("plot"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("fact_cid"), F.when(F.col("l_partkey") % 50 != 0, F.col("l_quantity") * 2).alias("canopy"),
        F.when(F.col("l_returnflag") == "R", F.year("l_shipdate") + 27).otherwise(0).alias("loss_year"), (F.col("l_linestatus") == "F").alias("base2020"), F.lit(0).alias("other_loss"),
    )


@query(
    f"""WITH {PLOTS}, c AS (SELECT plot, CASE WHEN {FOREST} IS NULL THEN NULL WHEN NOT {FOREST} THEN 3 WHEN loss_year>2020 THEN 2 ELSE 1 END AS v FROM p), g AS (SELECT plot, count(*) AS cells, count(v) AS known, count(*) FILTER (v=1) AS v1, count(*) FILTER (v=2) AS v2 FROM c GROUP BY plot)
    SELECT plot, cells, round(v2/cells,6) AS failing_share, CASE WHEN known<cells THEN 'indeterminate' WHEN v2*0.09>=0.5 THEN 'fail' WHEN v2>0 THEN 'fail_below_de_minimis' WHEN v1>0 THEN 'pass' ELSE 'not_in_scope' END AS verdict FROM g"""
)
def f11_screen_small_plots(spark, d):
    return A.screen_plots(small_plots(spark, d), 0.09).withColumn("failing_share", F.round("failing_share", 6))


@query(f"WITH {PLOTS} SELECT DISTINCT plot, fact_cid FROM p WHERE {FOREST} AND loss_year>2020")
def f11_screening_evidence(spark, d):
    return A.screening_evidence(small_plots(spark, d))


@query(
    X.with_("monthly")
    + """, y AS (SELECT key, year(month) AS y, sum(num) AS total, count(*) AS m FROM monthly WHERE year(month) BETWEEN 1995 AND 2000 GROUP BY ALL HAVING count(*)=12) SELECT key, round(avg(total),6) AS normal, count(*) AS years FROM y GROUP BY key"""
)
def f17_annual_normal(spark, d):
    return A.annual_normal(X.monthly(spark, d), 1995, 2000).withColumn("normal", F.round("normal", 6))


@query(X.with_("monthly") + "SELECT key, month(month) AS moy, round(avg(num),6) AS normal, count(*) AS years FROM monthly WHERE year(month) BETWEEN 1995 AND 2000 GROUP BY ALL")
def f17_monthly_normal(spark, d):
    return A.monthly_normal(X.monthly(spark, d), 1995, 2000).withColumn("normal", F.round("normal", 6))


@query(
    """SELECT user_id AS cell, count(*) AS n, max(value) AS max_frp, round(sum(value),4) AS sum_frp, CAST(floor(epoch(max(ts))) AS BIGINT) AS last, max(user_id%101) AS max_confidence, CAST(bit_or(1<<(event_id%4)::INT) AS BIGINT) AS sensors,
    sum((hour(ts) BETWEEN 6 AND 17)::INT)::BIGINT*255//count(*) AS day_share FROM events GROUP BY user_id"""
)
def f18_fire_summary(spark, d):
    e = X.read(spark, d, "events")
    fires = e.select(
        F.col("user_id").alias("cell"), F.col("value").alias("frp"), F.expr("unix_timestamp(ts)").alias("acquired"), (F.col("user_id") % 101).alias("confidence"),
        F.when(F.hour("ts").between(6, 17), "D").otherwise("N").alias("daynight"), F.expr("shiftleft(1L, cast(event_id % 4 as int))").alias("sensor"),
    )
    return A.fire_summary(fires).withColumn("sum_frp", F.round("sum_frp", 4))


@query(X.with_("facts") + "SELECT band, count(*) AS n_facts, count(DISTINCT cell) AS n_cells, min(tslot) AS from_slot, max(tslot) AS to_slot, max(signed_at) AS newest, bool_or(kind='primary') AS has_values FROM facts GROUP BY band")
def f19_coverage_matrix(spark, d):
    return A.coverage_matrix(X.facts(spark, d))


@query(
    X.with_("facts")
    + """, r(band, tempo, has_source) AS (VALUES ('click','fast',true), ('purchase','slow',false), ('radar','d8',true), ('relief','static',false)), s(tempo, tempo_seconds) AS (VALUES ('fast',86400), ('slow',31536000), ('d8',691200), ('static',0)),
    c AS (SELECT band, count(*) AS n_facts, count(DISTINCT cell) AS n_cells, min(tslot) AS from_slot, max(tslot) AS to_slot, max(signed_at) AS newest FROM facts GROUP BY band)
    SELECT coalesce(c.band, r.band) AS band, tempo, CAST(tempo_seconds AS BIGINT) AS tempo_seconds, coalesce(has_source,false) AS has_source, coalesce(n_facts,0) AS n_facts, coalesce(n_cells,0) AS n_cells, from_slot, to_slot, newest, coalesce(has_source,false) OR coalesce(n_facts,0)>0 AS answers FROM c FULL JOIN r ON r.band=c.band LEFT JOIN s USING (tempo)"""
)
def f19_coverage_registry(spark, d):
    rows = [("click", "fast", True), ("purchase", "slow", False), ("radar", "d8", True), ("relief", "static", False)]
    return A.coverage_registry(X.facts(spark, d), spark.createDataFrame(rows, "band string, tempo string, has_source boolean"))


@query(X.with_("facts") + "SELECT count(DISTINCT cell) AS cells, count(DISTINCT band) AS bands, count(*) AS facts FROM facts")
def f20_corpus_stats(spark, d):
    return A.corpus_stats(X.facts(spark, d))


@query(X.with_("facts") + "SELECT band, count(*) AS facts FROM facts GROUP BY band ORDER BY facts DESC, band LIMIT 3")
def f20_top_bands(spark, d):
    return A.top_bands(X.facts(spark, d), 3)


@query(f"WITH {DENSE.replace('/1000.0','')} SELECT CAST(floor(lat) AS BIGINT) AS lat_bin, CAST(floor(lng) AS BIGINT) AS lng_bin, count(*) AS n, round(ln(1+count(*)),6) AS level FROM pts GROUP BY 1,2")
def f21_density_bins(spark, d):
    p = X.with_point(X.read(spark, d, "events"), "event_id")
    return A.density_bins(p).withColumn("level", F.round("level", 6))


@query(
    """WITH b AS (SELECT l_orderkey AS batch_id, l_orderkey%50 AS attester, l_partkey AS cell, l_shipdate AS seen FROM lineitem), p AS (SELECT attester, batch_id, count(*) AS facts, count(DISTINCT cell) AS cells, min(seen) AS lo, max(seen) AS hi FROM b GROUP BY ALL),
    c AS (SELECT l_suppkey%50 AS attester, count(*) AS n FROM lineitem GROUP BY 1) SELECT attester, count(*) AS attestations, sum(facts)::BIGINT AS facts, sum(cells)::BIGINT AS unique_cells, min(lo) AS first_seen, max(hi) AS last_seen, any_value(coalesce(n,0)) AS citations,
    round(any_value(coalesce(n,0))+8*ln(1+sum(facts))+4*ln(1+count(*)),6) AS score FROM p LEFT JOIN c USING (attester) GROUP BY attester ORDER BY score DESC, attester LIMIT 20"""
)
def f22_contributors(spark, d):
    li = X.read(spark, d, "lineitem")
    b = li.select(F.col("l_orderkey").alias("batch_id"), (F.col("l_orderkey") % 50).alias("attester"), F.col("l_partkey").alias("cell"), F.col("l_shipdate").alias("seen"))
    c = li.groupBy((F.col("l_suppkey") % 50).alias("attester")).agg(F.count("*").alias("n"))
    return A.contributors(b, c, 20).withColumn("score", F.round("score", 6))


def report_sql(by: str) -> str:
    rank = "CAST(floor((c-1)*{p}+0.5) AS BIGINT)"
    return (
        X.with_("results")
        + f""", w AS (SELECT *, user_id%12 AS region, CASE volume WHEN 'very_high' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS w FROM results), k AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY elapsed)-1 AS rn, count(*) OVER (PARTITION BY {by}) AS c FROM w)
    SELECT {by}, count(*) AS n, round(avg(pass::INT),6) AS accuracy, round(sum(pass::INT*w)/sum(w),6) AS weighted_accuracy, sum((1-pass::INT)*severity)::BIGINT AS miss_cost, round(avg(elapsed),6) AS mean_elapsed,
    max(elapsed) FILTER (rn={rank.format(p=0.5)}) AS p50, max(elapsed) FILTER (rn={rank.format(p=0.95)}) AS p95 FROM k GROUP BY {by}"""
    )


def report(spark, d, by):
    r = A.eval_report(X.results(spark, d).withColumn("region", F.col("user_id") % 12), by)
    return r.withColumns({c: F.round(c, 6) for c in ("accuracy", "weighted_accuracy", "mean_elapsed")})


@query(report_sql("domain"))
def f23_eval_report(spark, d):
    return report(spark, d, "domain")


@query(report_sql("volume"))
def f23_eval_by_volume(spark, d):
    return report(spark, d, "volume")


@query(report_sql("region"))
def f23_eval_by_region(spark, d):
    return report(spark, d, "region")


@query(
    X.with_("results")
    + """, w AS (SELECT *, user_id%12 AS region, CASE volume WHEN 'very_high' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS w FROM results),
    g AS (SELECT CASE WHEN grouping(domain)=0 THEN 'domain' WHEN grouping(volume)=0 THEN 'volume' WHEN grouping(region)=0 THEN 'region' ELSE 'all' END AS cut, coalesce(domain, volume, CAST(region AS VARCHAR), '') AS part,
      count(*) AS n, round(avg(pass::INT),6) AS accuracy, round(sum(pass::INT*w)/sum(w),6) AS weighted_accuracy, sum((1-pass::INT)*severity)::BIGINT AS miss_cost, round(avg(elapsed),6) AS mean_elapsed, list(elapsed ORDER BY elapsed) AS v
      FROM w GROUP BY GROUPING SETS ((domain), (volume), (region), ()))
    SELECT * EXCLUDE (v), v[CAST(floor((n-1)*0.5+0.5) AS BIGINT)+1] AS p50, v[CAST(floor((n-1)*0.95+0.5) AS BIGINT)+1] AS p95 FROM g"""
)
def f23_eval_cuts(spark, d):
    r = A.eval_report_cuts(X.results(spark, d).withColumn("region", F.col("user_id") % 12))
    return r.withColumns({c: F.round(c, 6) for c in ("accuracy", "weighted_accuracy", "mean_elapsed")})


@query(
    """WITH e AS (SELECT event_id AS id, list_sort(list_distinct([event_id%7, user_id%5, 3])) AS a, list_sort(list_distinct([event_id%5, user_id%7, 3])) AS t FROM events)
    SELECT id, a=t AS exact, round(len(list_intersect(a,t))/len(t),6) AS overlap FROM e"""
)
def f24_grade_lists(spark, d):
    e = X.read(spark, d, "events")
    k, u = F.col("event_id"), F.col("user_id")
    three = F.lit(3).cast("bigint")
    g = A.grade_lists(e.select(k.alias("id"), F.array(k % 7, u % 5, three).alias("ids")), e.select(k.alias("id"), F.array(k % 5, u % 7, three).alias("ids")))
    return g.withColumn("overlap", F.round("overlap", 6))


@query("SELECT event_id AS id, coalesce(value BETWEEN 10 AND 10+user_id%90, false) AS ok FROM events")
def f24_grade(spark, d):
    e = X.read(spark, d, "events").withColumnRenamed("event_id", "id")
    return A.grade(e.select("id", F.col("value").alias("answer")), e.select("id", F.lit(10).alias("lo"), (10 + F.col("user_id") % 90).alias("hi")))


def request_log(spark, d):
    platform = F.element_at(F.array(*map(F.lit, ("cli", "web", "sdk"))), (F.col("user_id") % 3 + 1).cast("int"))
    path = F.concat(F.lit("/v"), (F.col("event_id") % 4).cast("string"))
    return X.read(spark, d, "events").select(F.col("event_type").alias("tool"), platform.alias("platform"), path.alias("path"), F.col("value").alias("elapsed"))


@query("SELECT event_type AS tool, ['cli','web','sdk'][user_id%3+1] AS platform, count(*) AS calls FROM events GROUP BY 1,2")
def f25_usage_stats(spark, d):
    return A.usage_stats(request_log(spark, d))


@query("SELECT '/v' || (event_id%4) AS path, (value>=10)::INT+(value>=50)::INT+(value>=200)::INT AS bucket, count(*) AS calls FROM events GROUP BY 1,2")
def f25_latency_histogram(spark, d):
    return A.latency_histogram(request_log(spark, d), [10.0, 50.0, 200.0])


SERIES = "s AS (SELECT key, (year(month)*12+month(month))::BIGINT AS t, num/1000 AS num FROM monthly)"


def series(spark, d):
    return X.monthly(spark, d).select("key", (F.year("month") * 12 + F.month("month")).cast("bigint").alias("t"), (F.col("num") / 1000).alias("num"))


@query(X.with_("monthly", extra=SERIES) + "SELECT key, round(regr_slope(num,t),9) AS slope, count(*) AS parents FROM s GROUP BY key HAVING count(*)>=3")
def g03_trend(spark, d):
    return S.trend(series(spark, d)).withColumn("slope", F.round("slope", 9))


@query(
    X.with_("monthly", extra=SERIES)
    + """, c AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY t DESC)<=24), g AS (SELECT key, max(t) AS lt, arg_max(num,t) AS ln, avg(num) AS m, coalesce(regr_slope(num,t),0) AS sl FROM c GROUP BY key),
    n AS (SELECT g.key, c.num FROM g JOIN c ON c.key=g.key AND abs(c.t-(g.lt-12))<=1 QUALIFY row_number() OVER (PARTITION BY g.key ORDER BY abs(c.t-(g.lt-12)), c.t)=1)
    SELECT g.key, round(greatest(least(0.6*coalesce(n.num,m)+0.3*(ln+sl)+0.1*m,1.0),-1.0),6) AS forecast FROM g LEFT JOIN n ON n.key=g.key"""
)
def g04_seasonal_forecast(spark, d):
    return S.seasonal_forecast(series(spark, d), lookback=24).withColumn("forecast", F.round("forecast", 6))


@query(
    X.with_("vecs")
    + """, y AS (SELECT cell, tslot AS year FROM vecs), p AS (SELECT cell, year FROM y WHERE (SELECT count(*) FROM y z WHERE z.cell=y.cell AND z.year BETWEEN y.year-3 AND y.year-1)=3)
    SELECT p.cell, year, year=max(year) OVER (PARTITION BY p.cell) AS held_out, list_transform(v.vec, lambda x: round(x,6)+0.0) AS target, (SELECT list(list_transform(b.vec, lambda x: round(x,6)+0.0) ORDER BY b.tslot) FROM vecs b WHERE b.cell=p.cell AND b.tslot BETWEEN p.year-3 AND p.year-1) AS inputs FROM p JOIN vecs v ON v.cell=p.cell AND v.tslot=p.year"""
)
def g05_lag_pairs(spark, d):
    v = X.vecs(spark, d).withColumnRenamed("tslot", "year")
    plain = lambda v: F.transform(v, lambda x: F.round(x, 6) + 0.0)
    return S.lag_pairs(v).select("cell", "year", "held_out", plain(F.col("target")).alias("target"), F.transform("inputs", plain).alias("inputs"))


@query(X.with_("vecs") + "SELECT cell, max(tslot)+1 AS year, round(list_sum(arg_max(vec, tslot)),5) AS total FROM vecs GROUP BY cell HAVING count(DISTINCT tslot)>=3")
def g06_persistence_forecast(spark, d):
    f = S.persistence_forecast(X.vecs(spark, d).withColumnRenamed("tslot", "year"))
    return f.select("cell", "year", F.round(F.aggregate("forecast", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query(
    X.with_("vecs")
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY tslot DESC) AS rn, count(*) OVER (PARTITION BY cell) AS n FROM vecs)
    SELECT a.cell, a.tslot AS year, round(list_dot_product(a.vec,b.vec)/(sqrt(list_dot_product(a.vec,a.vec))*sqrt(list_dot_product(b.vec,b.vec))),6) AS cosine, round(list_sum(list_transform(list_zip(a.vec,b.vec), lambda z: (z[1]-z[2])*(z[1]-z[2]))),5) AS squared_error
    FROM r a JOIN r b ON a.cell=b.cell AND a.rn=1 AND b.rn=2 WHERE a.n>=3"""
)
def g06_persistence_score(spark, d):
    s = S.persistence_score(X.vecs(spark, d).withColumnRenamed("tslot", "year"))
    return s.select("cell", "year", F.round("cosine", 6).alias("cosine"), F.round("squared_error", 5).alias("squared_error"))


@query(
    X.with_("facts")
    + """, f AS (SELECT * REPLACE (CASE WHEN band='view' AND event_id%4=0 THEN 0 ELSE tslot END AS tslot) FROM facts), p AS (SELECT * FROM f WHERE kind='primary'),
    snap AS (SELECT cell, arg_max(num, tslot*1000000000+event_id) AS v FROM p WHERE band='click' AND tslot<=19745 GROUP BY cell)
    SELECT cell, 'click' AS band, 'short' AS purpose, round(sum(num),6) AS value FROM p JOIN snap USING (cell) WHERE band='click' AND tslot BETWEEN 19736 AND 19745 AND v>=50 GROUP BY cell
    UNION ALL SELECT cell, 'purchase', 'long', round(arg_max(num, tslot*1000000000+event_id),6) FROM p WHERE band='purchase' AND tslot BETWEEN 19726 AND 19745 GROUP BY cell
    UNION ALL SELECT cell, 'view', 'base', round(avg(num),6) FROM p WHERE band='view' AND tslot=0 GROUP BY cell"""
)
def g07_temporal_recipe(spark, d):
    steps = [("click", 10, "sum", "short", 50.0), ("purchase", 20, "latest", "long", None), ("view", 0, "mean", "base", None)]
    recipe = spark.createDataFrame(steps, "band string, lookback long, aggregator string, purpose string, trigger double")
    static = (F.col("band") == "view") & (F.col("event_id") % 4 == 0)  # some facts of a static band
    facts = X.facts(spark, d).withColumn("tslot", F.when(static, F.lit(0).cast("bigint")).otherwise(F.col("tslot")))
    return S.temporal_recipe(facts, recipe, 19745).withColumn("value", F.round("value", 6))


@query(
    X.with_("facts")
    + """, w AS (SELECT event_id, num, avg(num) OVER k AS m, stddev_samp(num) OVER k AS sd, count(num) OVER k AS c FROM facts WINDOW k AS (PARTITION BY cell, band ORDER BY tslot, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
    SELECT event_id, round(CASE WHEN c=5 AND sd>0 THEN (num-m)/sd END,4) AS z FROM w"""
)
def g08_rolling_zscore(spark, d):
    return S.rolling_zscore(X.facts(spark, d), 5).withColumn("z", F.round("z", 4))
