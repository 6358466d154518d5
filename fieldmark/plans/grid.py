"""Queries over grid and time keys, neighbourhoods and rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmark.operators import aggregate as A
from fieldmark.operators import grid as G
from fieldmark.sources import fixtures as X

from .base import catalog

QUERIES, SQL, query = catalog()


POINTS = f"pts AS (SELECT c_custkey AS id, c_acctbal AS num, {X.point_sql('c_custkey')} FROM customer)"
DENSE = f"pts AS (SELECT event_id AS id, value AS num, {X.point_sql('event_id', True)} FROM events)"
LATQ = f"CAST(floor((lat+90)/180*{G.LAT_MAX}+0.5) AS BIGINT)"
LNGQ = f"CAST(floor((lng+180)/360*{G.LNG_MAX}+0.5) AS BIGINT)"
CELLS = f"cells AS (SELECT *, {G.CELL_PREFIX} + ({LATQ} << 22) + CASE WHEN {LNGQ}={G.LNG_MAX} OR {LATQ} IN (0,{G.LAT_MAX}) THEN 0 ELSE {LNGQ} END AS cell FROM pts)"


def points(spark, d):
    return X.with_point(X.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("num")), "id")


def dense(spark, d):
    return X.with_point(X.read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("value").alias("num"), F.col("event_type").alias("band")), "id", dense=True)


@query(f"WITH {POINTS}, {CELLS} SELECT cell, count(*) AS n, round(sum(num),4) AS total FROM cells GROUP BY cell")
def b01_to_cell(spark, d):
    return G.to_cell(points(spark, d)).groupBy("cell").agg(F.count("*").alias("n"), F.round(F.sum("num"), 4).alias("total"))


BANDED = f"pts AS (SELECT event_id AS id, value AS num, event_type AS band, {X.point_sql('event_id', True)} FROM events)"
# a digit is written as base 21, 10, 21, 10 letters; the cells' upper digits are fixed by the prefix
DIGITS = ["(cell >> 48) & 65535", "(cell >> 32) & 65535", "(cell >> 16) & 65535", "cell & 65535"]
CELL_TEXT = " || '.' || ".join(
    f"CASE WHEN ({x})<44100 THEN substr('{G.CONSONANTS}',({x})//2100+1,1) || substr('{G.VOWELS}',({x})//210%10+1,1) || substr('{G.CONSONANTS}',({x})//10%21+1,1) || substr('{G.VOWELS}',({x})%10+1,1) ELSE format('z{{:04x}}',{x}) END"
    for x in DIGITS
)
CENTRE = f"(SELECT *, ((cell >> 22) & {G.LAT_MAX})/{G.LAT_MAX}.0*180-90 AS clat, (cell & {G.LNG_MAX})/{G.LNG_MAX}.0*360-180 AS clng FROM cells)"


@query(
    f"""WITH {BANDED}, {CELLS} SELECT cell, count(*) AS n_facts, count(DISTINCT band) AS n_bands, round(any_value(clat),6) AS lat, round(any_value(clng),6) AS lng,
    round(any_value(clat)-90.0/{G.LAT_MAX},6) AS lat_min, round(any_value(clat)+90.0/{G.LAT_MAX},6) AS lat_max, round(any_value(clng)-180.0/{G.LNG_MAX},6) AS lng_min, round(any_value(clng)+180.0/{G.LNG_MAX},6) AS lng_max, {CELL_TEXT} AS text FROM {CENTRE} GROUP BY cell"""
)
def b02_cell_dim(spark, d):
    dim = G.cell_dim(G.to_cell(dense(spark, d)))
    return dim.withColumns({c: F.round(c, 6) for c in dim.columns[3:] if c != "text"})


@query(
    f"""WITH {DENSE}, {CELLS}, l AS (SELECT *, unnest([8,10,12]) AS level FROM cells)
    SELECT level, {G.CELL_PREFIX} + (((((cell>>22)&{G.LAT_MAX})>>level)<<level)<<22) + (((cell&{G.LNG_MAX})>>level)<<level) AS parent, count(*) AS n, round(avg(num),6) AS mean, min(num) AS min, max(num) AS max FROM l GROUP BY 1,2"""
)
def b03_coarsen(spark, d):
    return G.coarsen(G.to_cell(dense(spark, d)), [8, 10, 12]).withColumn("mean", F.round("mean", 6))


@query(
    """SELECT event_type AS band, tslot, slot_start, count(*) AS n FROM (SELECT *, tslot*step AS slot_start FROM (SELECT *, CAST(floor(epoch(ts)/step) AS BIGINT) AS tslot FROM (SELECT *, CASE event_type WHEN 'click' THEN 3600 WHEN 'purchase' THEN 86400 WHEN 'error' THEN 691200 ELSE 2592000 END AS step FROM events))) GROUP BY ALL"""
)
def b04_to_tslot(spark, d):
    e = X.read(spark, d, "events").select(F.col("event_type").alias("band"), F.expr("unix_timestamp(ts)").alias("unix"))
    tempo = spark.createDataFrame([("click", "ultra"), ("purchase", "fast"), ("error", "d8"), ("view", "medium"), ("signup", "medium")], "band string, tempo string")
    return G.to_tslot(e, "unix", tempo).groupBy("band", "tslot", "slot_start").agg(F.count("*").alias("n"))


N9 = """n9 AS (SELECT p."row", p.col, p.value AS v4, a.value AS v0, b.value AS v1, c.value AS v2, e.value AS v3, f.value AS v5, g.value AS v6, h.value AS v7, i.value AS v8 FROM pixels p
 LEFT JOIN pixels a ON a."row"=p."row"-1 AND a.col=p.col-1 LEFT JOIN pixels b ON b."row"=p."row"-1 AND b.col=p.col LEFT JOIN pixels c ON c."row"=p."row"-1 AND c.col=p.col+1
 LEFT JOIN pixels e ON e."row"=p."row" AND e.col=p.col-1 LEFT JOIN pixels f ON f."row"=p."row" AND f.col=p.col+1
 LEFT JOIN pixels g ON g."row"=p."row"+1 AND g.col=p.col-1 LEFT JOIN pixels h ON h."row"=p."row"+1 AND h.col=p.col LEFT JOIN pixels i ON i."row"=p."row"+1 AND i.col=p.col+1)"""


@query(X.with_("pixels", extra=N9) + 'SELECT "row", col, v0, v1, v2, v3, v4, v5, v6, v7, v8 FROM n9')
def b05_neighbours3x3(spark, d):
    n9 = G.neighbours3x3(X.pixels(spark, d))
    return n9.select("row", "col", *[F.get("n9", F.lit(i)).alias(f"v{i}") for i in range(9)])


BOXES = f"boxes AS (SELECT id AS box_id, lng AS lon_min, lat AS lat_min, lng + (id%7) AS lon_max, lat + (id%5) AS lat_max FROM (SELECT s_suppkey AS id, {X.point_sql('s_suppkey')} FROM supplier))"


def boxes(spark, d):
    p = X.with_point(X.read(spark, d, "supplier").select(F.col("s_suppkey").alias("box_id")), "box_id")
    return p.select("box_id", F.col("lng").alias("lon_min"), F.col("lat").alias("lat_min"), (F.col("lng") + F.col("box_id") % 7).alias("lon_max"), (F.col("lat") + F.col("box_id") % 5).alias("lat_max"))


@query(
    f"""WITH {BOXES}, r AS (SELECT *, CAST(floor(lat_min/0.5) AS BIGINT) r0, CAST(floor(lat_max/0.5) AS BIGINT) r1, CAST(floor(lon_min/0.5) AS BIGINT) c0, CAST(floor(lon_max/0.5) AS BIGINT) c1 FROM boxes WHERE abs(lat_max)<=90 AND abs(lon_max)<=180),
    s AS (SELECT *, unnest(range(r0, r1+1)) AS "row" FROM r WHERE (r1-r0+1)*(c1-c0+1)<=100), t AS (SELECT *, unnest(range(c0, c1+1)) AS col FROM s) SELECT box_id, "row", col FROM t"""
)
def b06_cover_bbox(spark, d):
    return G.cover_bbox(boxes(spark, d), 0.5, 100)[0]


SMALL_BOXES = f"""sb AS (SELECT s_suppkey AS box_id, lng AS lon_min, lat AS lat_min, lng + (s_suppkey%9)*0.0001 - CASE WHEN s_suppkey%10=3 THEN 1 ELSE 0 END AS lon_max, lat + (s_suppkey%7)*0.00013 AS lat_max FROM (SELECT s_suppkey, {X.point_sql("s_suppkey")} FROM supplier)),
  i AS (SELECT *, unnest(range(0, CAST(floor((lat_max-lat_min)/(180.0/2097152)) AS BIGINT)+1)) AS i FROM sb WHERE lon_min<=lon_max AND abs(lon_min)<=180 AND abs(lon_max)<=180), j AS (SELECT *, unnest(range(0, CAST(floor((lon_max-lon_min)/(360.0/4194304)) AS BIGINT)+1)) AS j FROM i),
  pts AS (SELECT box_id AS id, lat_min+i*(180.0/2097152) AS lat, lon_min+j*(360.0/4194304) AS lng FROM j UNION ALL SELECT box_id, y, x FROM (SELECT box_id, unnest([lat_min,lat_min,lat_max,lat_max]) AS y, unnest([lon_min,lon_max,lon_min,lon_max]) AS x FROM sb WHERE lon_min<=lon_max AND abs(lon_min)<=180 AND abs(lon_max)<=180))"""


def small_boxes(spark, d):
    p = X.with_point(X.read(spark, d, "supplier").select(F.col("s_suppkey").alias("box_id")), "box_id")
    k = F.col("box_id")
    lon = F.col("lng") + (k % 9) * 0.0001 - F.when(k % 10 == 3, 1).otherwise(0)
    return p.select("box_id", F.col("lng").alias("lon_min"), F.col("lat").alias("lat_min"), lon.alias("lon_max"), (F.col("lat") + (k % 7) * 0.00013).alias("lat_max"))


@query(f"WITH {SMALL_BOXES}, {CELLS} SELECT DISTINCT id AS box_id, cell FROM cells")
def b06_cover_cells(spark, d):
    return G.cover_cells(small_boxes(spark, d))[0]


@query(
    f"""WITH {POINTS}, t AS (SELECT *, CAST(floor(lat/10)*10 AS INTEGER) s, CAST(floor(lng/10)*10 AS INTEGER) w FROM pts)
    SELECT CASE WHEN s>=0 THEN 'N' ELSE 'S' END || lpad(CAST(abs(s) AS VARCHAR),2,'0') || CASE WHEN w>=0 THEN 'E' ELSE 'W' END || lpad(CAST(abs(w) AS VARCHAR),3,'0') AS tile, count(*) AS n FROM t GROUP BY 1"""
)
def b07_tile_key(spark, d):
    return points(spark, d).groupBy(G.tile_key(F.col("lat"), F.col("lng"), 10).alias("tile")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {POINTS}, t AS (SELECT *, CAST(ceil(lat/10)*10 AS INTEGER) n, CAST(floor(lng/10)*10 AS INTEGER) w FROM pts), e AS (SELECT *, CASE WHEN n>=0 THEN 'N' ELSE 'S' END AS ns, CASE WHEN w>=0 THEN 'E' ELSE 'W' END AS ew FROM t)
    SELECT lpad(CAST(abs(n) AS VARCHAR),2,'0') || ns || '_' || lpad(CAST(abs(w) AS VARCHAR),3,'0') || ew AS tile, abs(n) || ns || '_' || abs(w) || ew AS plain, count(*) AS n FROM e GROUP BY 1,2"""
)
def b07_corner_tile(spark, d):
    at = F.col("lat"), F.col("lng")
    return points(spark, d).groupBy(G.corner_tile(*at).alias("tile"), G.corner_tile(*at, padded=False).alias("plain")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {POINTS}, t AS (SELECT *, CAST(floor(lat/3)*3 AS INTEGER) s, CAST(floor(lng/3)*3 AS INTEGER) w FROM pts)
    SELECT printf('%s%02d%s%03d', CASE WHEN s>=0 THEN 'N' ELSE 'S' END, abs(s), CASE WHEN w>=0 THEN 'E' ELSE 'W' END, abs(w)) AS tile, count(*) AS n, round(sum(num),4) AS total FROM t GROUP BY 1"""
)
def b07_tile_3_degrees(spark, d):
    p = points(spark, d)
    return p.groupBy(G.tile_key(F.col("lat"), F.col("lng"), 3).alias("tile")).agg(F.count("*").alias("n"), F.round(F.sum("num"), 4).alias("total"))


@query(
    f"""WITH {POINTS} SELECT CAST(floor((lng+180)/360*256) AS BIGINT) AS x, CAST(floor((1-ln(tan(radians(lat))+1/cos(radians(lat)))/pi())/2*256) AS BIGINT) AS y, count(*) AS n FROM pts GROUP BY 1,2"""
)
def b07_mercator_tile(spark, d):
    x, y = G.mercator_tile(F.col("lat"), F.col("lng"), 8)
    return points(spark, d).groupBy(x.alias("x"), y.alias("y")).agg(F.count("*").alias("n"))


@query(None)
def b08_hilbert_key(spark, d):
    p = X.pixels(spark, d)
    return p.select("row", "col", G.hilbert_key(F.col("row"), F.col("col"), 16).alias("key"))


@query(
    X.with_("pixels", extra=N9)
    + """SELECT "row", col, round(degrees(atan(sqrt(dx*dx+dy*dy))),6) AS slope, round((degrees(atan2(-dx,dy))+360)%360,4) AS aspect, round(v4 - (v0+v1+v2+v3+v4+v5+v6+v7+v8)/9,6) AS tpi FROM (SELECT *, ((v2+2*v5+v8)-(v0+2*v3+v6))/8 dx, ((v6+2*v7+v8)-(v0+2*v1+v2))/8 dy FROM n9) WHERE v0+v1+v2+v3+v4+v5+v6+v7+v8 IS NOT NULL"""
)
def f06_terrain(spark, d):
    return A.terrain(X.pixels(spark, d)).withColumns({"slope": F.round("slope", 6), "aspect": F.round("aspect", 4), "tpi": F.round("tpi", 6)})


@query(
    X.with_("pixels", extra=N9)
    + """, s AS (SELECT "row", col, v4, list_filter([v0,v1,v2,v3,v5,v6,v7,v8], lambda x: x IS NOT NULL) AS a FROM n9), z AS (SELECT *, list_avg(a) m, list_stddev_pop(a) sd FROM s WHERE len(a)>0)
    SELECT "row", col, round(CASE WHEN sd>0 THEN (v4-m)/sd END,5) AS z, coalesce(abs(CASE WHEN sd>0 THEN (v4-m)/sd END)>2,false) AS flag FROM z"""
)
def f14_neighbour_anomaly(spark, d):
    return A.neighbour_anomaly(X.pixels(spark, d)).withColumn("z", F.round("z", 5))


@query(
    X.with_("pixels", extra=N9)
    + """SELECT "row", col, round(s/4 + pow(1-4*0.2, 3)*(v4-s/4),6) AS value, greatest(v0,v1,v2,v3,v4,v5,v6,v7,v8)-least(v0,v1,v2,v3,v4,v5,v6,v7,v8)<0.01 AS uniform FROM (SELECT *, coalesce(v1,v4)+coalesce(v3,v4)+coalesce(v5,v4)+coalesce(v7,v4) AS s FROM n9)"""
)
def f15_relax_stencil(spark, d):
    return A.relax_stencil(X.pixels(spark, d), 0.2, 3).withColumn("value", F.round("value", 6))


@query(
    X.with_("pixels", extra=N9)
    + """SELECT "row", col, round(s/4 + pow(1-4*(0.04*216000/432/100), 432)*(v4-s/4)+1e-7,5) AS value, greatest(v0,v1,v2,v3,v4,v5,v6,v7,v8)-least(v0,v1,v2,v3,v4,v5,v6,v7,v8)<0.01 AS uniform, 432 AS steps,
    list_filter([CASE WHEN v0 IS NULL THEN 0 END, CASE WHEN v1 IS NULL THEN 1 END, CASE WHEN v2 IS NULL THEN 2 END, CASE WHEN v3 IS NULL THEN 3 END, CASE WHEN v4 IS NULL THEN 4 END, CASE WHEN v5 IS NULL THEN 5 END, CASE WHEN v6 IS NULL THEN 6 END, CASE WHEN v7 IS NULL THEN 7 END, CASE WHEN v8 IS NULL THEN 8 END], lambda x: x IS NOT NULL) AS imputed
    FROM (SELECT *, coalesce(v1,v4)+coalesce(v3,v4)+coalesce(v5,v4)+coalesce(v7,v4) AS s FROM n9)"""
)
def f15_relax_hours(spark, d):
    return A.relax_hours(X.pixels(spark, d), 0.04, 60.0).withColumn("value", F.round(F.col("value") + 1e-7, 5))


@query(X.with_("pixels") + 'SELECT "row"//4 AS "row", col//4 AS col, round(avg(value)+1e-9,5) AS value, count(*) AS n FROM pixels GROUP BY 1,2')
def f16_downsample(spark, d):
    return A.downsample(X.pixels(spark, d), 4).withColumn("value", F.round(F.col("value") + 1e-9, 5))


RESIZED = (40, 30)


@query(
    X.with_("pixels")
    + """, s AS (SELECT max("row")+1 AS h, max(col)+1 AS w FROM pixels), t AS (SELECT r AS "row", c AS col, r*(h-1)/39.0 AS fy, c*(w-1)/29.0 AS fx, h, w FROM s, range(40) a(r), range(30) b(c)),
    k AS (SELECT *, CAST(floor(fy) AS BIGINT) AS y0, CAST(floor(fx) AS BIGINT) AS x0 FROM t), q AS (SELECT *, least(y0+1,h-1) AS y1, least(x0+1,w-1) AS x1, fy-y0 AS dy, fx-x0 AS dx FROM k)
    SELECT q."row", q.col, round((a.value*(1-dx)+b.value*dx)*(1-dy)+(c.value*(1-dx)+d.value*dx)*dy,5) AS value FROM q LEFT JOIN pixels a ON a."row"=y0 AND a.col=x0 LEFT JOIN pixels b ON b."row"=y0 AND b.col=x1 LEFT JOIN pixels c ON c."row"=y1 AND c.col=x0 LEFT JOIN pixels d ON d."row"=y1 AND d.col=x1"""
)
def f16_resize(spark, d):
    px = X.pixels(spark, d)
    size = px.agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w")).first()
    return A.resize(px, (size["h"], size["w"]), RESIZED).withColumn("value", F.round("value", 5))


# one raster of 150 rows of 100 pixels; low values are nodata
RASTER = [("r", 0.0, 0.0, 1.0, -1.0, 100, 150, -9999.0)]


def raster(spark, d):
    header = spark.createDataFrame(RASTER, "raster string, x0 double, y0 double, dx double, dy double, width int, height int, nodata double")
    px = X.pixels(spark, d).select(F.lit("r").alias("raster"), "row", "col", F.when(F.col("value") < 100, -9999.0).otherwise(F.col("value")).alias("value"))
    return px, header


@query(
    X.with_("pixels")
    + """, q AS (SELECT c_custkey AS id, CAST(floor((-c_acctbal/100)/-1.0+0.5) AS BIGINT) AS r, CAST(floor((c_custkey%1200)/12.0+0.5) AS BIGINT) AS c FROM customer), b AS (SELECT *, unnest(['plain','twice']) AS band FROM q),
    j AS (SELECT b.id, b.band, CASE WHEN r<0 OR r>149 OR c<0 OR c>99 THEN 'outside_image' WHEN p.value IS NULL OR p.value<100 THEN 'nodata' END AS reason, CASE band WHEN 'plain' THEN p.value ELSE 2*p.value END AS v FROM b LEFT JOIN pixels p ON p."row"=b.r AND p.col=b.c)
    SELECT id, band, CASE WHEN reason IS NULL THEN v END AS value, CASE WHEN reason IS NULL THEN 'primary' ELSE 'absence' END AS kind, reason FROM j"""
)
def d13_sample_points(spark, d):
    px, header = raster(spark, d)
    twice = F.when(F.col("value") == -9999, F.col("value")).otherwise(2 * F.col("value"))
    px = px.withColumn("band", F.lit("plain")).unionByName(px.withColumns({"band": F.lit("twice"), "value": twice}))
    q = X.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("r").alias("raster"), ((F.col("c_custkey") % 1200) / 12).alias("x"), (-F.col("c_acctbal") / 100).alias("y"))
    return G.sample_points(q, px, header, ["plain", "twice"])


@query(
    X.with_("pixels")
    + """, q AS (SELECT s_suppkey AS id, s_suppkey%150 AS r, (s_suppkey*3)%100 AS c FROM supplier), o AS (SELECT *, unnest(range(-1,2)) AS dr FROM q), w AS (SELECT *, unnest(range(-2,3)) AS dc FROM o)
    SELECT w.id, list(CASE WHEN p.value>=100 THEN p.value ELSE 0 END ORDER BY dr, dc) AS "window" FROM w LEFT JOIN pixels p ON p."row"=w.r+dr AND p.col=w.c+dc GROUP BY w.id"""
)
def d14_sample_windows(spark, d):
    px, header = raster(spark, d)
    k = F.col("s_suppkey")
    q = X.read(spark, d, "supplier").select(k.alias("id"), F.lit("r").alias("raster"), (k * 3 % 100).cast("double").alias("x"), (-(k % 150)).cast("double").alias("y"))
    return G.sample_windows(q, px, header, 5, 3)
