"""Queries over points, boxes, lines and polygons."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmark.operators import spatial as E
from fieldmark.sources import fixtures as X

from .base import catalog

QUERIES, SQL, query = catalog()


# A square, an L-shape, a square with a hole, and a shape of two parts, as rings of (lng, lat).
POLYS = {
    "square": [[(0, 0), (40, 0), (40, 40), (0, 40), (0, 0)]],
    "ell": [[(-60, -60), (-10, -60), (-10, -30), (-30, -30), (-30, -5), (-60, -5), (-60, -60)]],
    "hole": [[(60, -50), (120, -50), (120, 10), (60, 10), (60, -50)], [(80, -30), (100, -30), (100, -10), (80, -10), (80, -30)]],
    "parts": [[(-150, 10), (-120, 10), (-120, 50), (-150, 50), (-150, 10)], [(-100, 20), (-90, 20), (-90, 60), (-100, 60), (-100, 20)]],
}


def polys(spark):
    rows = [(k, [[(float(x), float(y)) for x, y in ring] for ring in rings]) for k, rings in POLYS.items()]
    return spark.createDataFrame(rows, "poly_id string, rings array<array<struct<lng:double,lat:double>>>")


EDGES = "edges(poly_id, ring, x0, y0, x1, y1) AS (VALUES " + ", ".join(
    f"('{k}',{r},{a[0]}.0,{a[1]}.0,{b[0]}.0,{b[1]}.0)" for k, rings in POLYS.items() for r, ring in enumerate(rings) for a, b in zip(ring, ring[1:], strict=False)
) + ")"
EDGES = EDGES.replace("edges(", "edges (", 1)


def points(spark, d):
    return X.with_point(X.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value")), "id")


PTS = f"pts AS (SELECT c_custkey AS id, c_acctbal AS value, {X.point_sql('c_custkey')} FROM customer)"
INSIDE = "ins AS (SELECT id, value, lat, lng, poly_id FROM pts CROSS JOIN edges GROUP BY ALL HAVING count(*) FILTER ((y0>lat)<>(y1>lat) AND lng < x0+(lat-y0)/nullif(y1-y0,0)*(x1-x0)) % 2 = 1)"


@query(f"WITH {PTS}, {EDGES}, {INSIDE} SELECT id, poly_id FROM ins")
def e01_points_in_polygons(spark, d):
    return E.points_in_polygons(points(spark, d), polys(spark)).select("id", "poly_id")


BOX = f"boxes AS (SELECT s_suppkey AS box_id, lng AS lng_min, lat AS lat_min, lng+10 AS lng_max, lat+8 AS lat_max FROM (SELECT s_suppkey, {X.point_sql('s_suppkey')} FROM supplier))"


def boxes(spark, d):
    s = X.with_point(X.read(spark, d, "supplier").select(F.col("s_suppkey").alias("box_id")), "box_id")
    return s.select("box_id", F.col("lng").alias("lng_min"), F.col("lat").alias("lat_min"), (F.col("lng") + 10).alias("lng_max"), (F.col("lat") + 8).alias("lat_max"))


@query(f"WITH {PTS}, {BOX} SELECT box_id, count(id) AS n FROM boxes LEFT JOIN pts ON lng BETWEEN lng_min AND lng_max AND lat BETWEEN lat_min AND lat_max GROUP BY box_id")
def e05_count_in_boxes(spark, d):
    return E.count_in_boxes(points(spark, d), boxes(spark, d))


@query(
    f"""WITH {PTS}, p AS (SELECT s_suppkey AS place, {X.point_sql("s_suppkey")} FROM supplier),
    j AS (SELECT pts.id, place, round(2*6371.0088*asin(sqrt(least(1.0, pow(sin(radians(p.lat-pts.lat)/2),2)+cos(radians(pts.lat))*cos(radians(p.lat))*pow(sin(radians(p.lng-pts.lng)/2),2)))),5) AS km FROM pts JOIN p ON abs(p.lat-pts.lat)<10)
    SELECT id, place, km FROM j WHERE km<=300 QUALIFY row_number() OVER (PARTITION BY id ORDER BY km, place)=1"""
)
def e04_nearest_place(spark, d):
    s = X.with_point(X.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), "id")
    return E.nearest_place(points(spark, d), s, 300.0, 5.0).select("id", "place", F.round("km", 5).alias("km"))


# one field of five corners per order, of a size that its price sets
CORNERS = ((0, 0), (4, 1), (5, 3), (2, 5), (-1, 2))


def fields(spark, d):
    o = X.with_point(X.read(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 1e7).alias("size")), "o_orderkey")
    ring = F.array(*[F.struct((F.col("lng") + F.col("size") * x).alias("lng"), (F.col("lat") + F.col("size") * y).alias("lat")) for x, y in (*CORNERS, CORNERS[0])])
    return o.select(F.col("o_orderkey").alias("poly_id"), F.array(ring).alias("rings"))


FIELD = f"fo AS (SELECT o_orderkey, o_totalprice/1e7 AS size, {X.point_sql('o_orderkey')} FROM orders), fv AS (" + " UNION ALL ".join(
    f"SELECT o_orderkey AS poly_id, lng+size*{x} AS x, lat+size*{y} AS y, {i} AS i FROM fo" for i, (x, y) in enumerate((*CORNERS, CORNERS[0]))
) + """), fe AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM fv WINDOW w AS (PARTITION BY poly_id ORDER BY i)),
    fm AS (SELECT poly_id, avg(y) AS lat, min(x) AS x_lo, max(x) AS x_hi, min(y) AS y_lo, max(y) AS y_hi FROM fv GROUP BY 1),
    fs AS (SELECT poly_id, sum(x*y1-x1*y) AS a2, sum((x+x1)*(x*y1-x1*y)) AS cx, sum((y+y1)*(x*y1-x1*y)) AS cy FROM fe WHERE x1 IS NOT NULL GROUP BY 1),
    fa AS (SELECT poly_id, abs(a2/2)*111132.92*(111412.84*cos(radians(lat))-93.5*cos(3*radians(lat))) AS area, cx/(3*a2) AS lng, cy/(3*a2) AS lat FROM fs JOIN fm USING (poly_id) WHERE x_hi>=-100 AND x_lo<=100 AND y_hi>=-60 AND y_lo<=60)"""


@query(
    f"""WITH {FIELD}, {BOX}, m AS (SELECT poly_id, avg(x) AS lng, avg(y) AS lat FROM fv GROUP BY 1)
    SELECT box_id, count(poly_id) AS n FROM boxes LEFT JOIN m ON lng BETWEEN lng_min AND lng_max AND lat BETWEEN lat_min AND lat_max GROUP BY box_id"""
)
def e05_count_mean_centres(spark, d):
    # a small triangle beside each field is its second part
    near = lambda x, y: F.struct((F.col("rings")[0][0]["lng"] + x).alias("lng"), (F.col("rings")[0][0]["lat"] + y).alias("lat"))
    triangle = F.array(F.array(near(20.0, 0.0), near(20.1, 0.0), near(20.0, 0.1), near(20.0, 0.0)))
    f = fields(spark, d)
    return E.count_centroids_in_boxes(f.select(F.array(triangle, F.col("rings")).alias("parts")), boxes(spark, d))


FIRE_BOX = "asks AS (SELECT *, 1704067200 + (box_id%30)*86400 AS t0, 1704067200 + (box_id%30)*86400 + 604800 AS t1 FROM boxes)"


@query(
    f"""WITH {BOX}, {FIRE_BOX}, f AS (SELECT value AS frp, CAST(floor(epoch(ts)) AS BIGINT) AS acquired, user_id%101 AS confidence, hour(ts) BETWEEN 6 AND 17 AS day, CAST(1<<(event_id%4)::INT AS BIGINT) AS sensor, {X.point_sql('event_id')} FROM events),
    g AS (SELECT box_id, count(*) AS n, max(frp) AS max_frp, sum(frp) AS sum_frp, max(acquired) AS last, max(confidence) AS max_confidence, bit_or(sensor) AS sensors, sum(day::INT)::BIGINT*255//count(*) AS day_share FROM asks JOIN f ON lng BETWEEN lng_min AND lng_max AND lat BETWEEN lat_min AND lat_max AND acquired BETWEEN t0 AND t1 GROUP BY 1),
    k AS (SELECT box_id, t1 >= (SELECT max(acquired) FROM f)-86400 AS known FROM asks)
    SELECT box_id, known, CASE WHEN known THEN coalesce(n,0) END AS n, CASE WHEN known THEN coalesce(max_frp,0) END AS max_frp, CASE WHEN known THEN round(coalesce(sum_frp,0),4) END AS sum_frp, CASE WHEN known THEN coalesce(last,0) END AS last, CASE WHEN known THEN coalesce(max_confidence,0) END AS max_confidence, CASE WHEN known THEN coalesce(sensors,0) END AS sensors, CASE WHEN known THEN coalesce(day_share,0) END AS day_share FROM k LEFT JOIN g USING (box_id)"""
)
def f18_fires_in_boxes(spark, d):
    e = X.with_point(X.read(spark, d, "events"), "event_id")
    fires = e.select(
        "lng", "lat", F.col("value").alias("frp"), F.expr("unix_timestamp(ts)").alias("acquired"), (F.col("user_id") % 101).alias("confidence"),
        F.when(F.hour("ts").between(6, 17), "D").otherwise("N").alias("daynight"), F.expr("shiftleft(1L, cast(event_id % 4 as int))").alias("sensor"),
    )
    start = F.lit(1704067200) + (F.col("box_id") % 30) * 86400
    asks = boxes(spark, d).withColumns({"t0": start, "t1": start + 604800})
    return E.fires_in_boxes(asks, fires, 5.0).withColumn("sum_frp", F.round("sum_frp", 4))


@query(f"WITH {FIELD} SELECT poly_id, round(area/1e6,3) AS area_km2, round(lng,4) AS lng, round(lat,4) AS lat FROM fa")
def e07_field_areas(spark, d):
    f = E.field_areas(fields(spark, d), (-100.0, -60.0, 100.0, 60.0))
    return f.select("poly_id", F.round(F.col("area_m2") / 1e6, 3).alias("area_km2"), F.round("lng", 4).alias("lng"), F.round("lat", 4).alias("lat"))


@query(f"WITH {FIELD} SELECT floor(lat/10)::BIGINT AS zone, count(*) AS fields, round(sum(area)/1e6,1) AS area_km2, round(max(area)/1e6,3) AS largest_km2 FROM fa GROUP BY 1")
def e07_field_totals(spark, d):
    f = E.field_areas(fields(spark, d), (-100.0, -60.0, 100.0, 60.0)).withColumn("zone", F.floor(F.col("lat") / 10))
    t = E.field_totals(f, "zone")
    return t.select("zone", "fields", F.round(F.col("area_m2") / 1e6, 1).alias("area_km2"), F.round(F.col("largest_m2") / 1e6, 3).alias("largest_km2"))


# areas over the polygons, several on some of them: area, polygon, tags
AREAS = [
    ("a1", "square", {"iucn_level": "II", "name": "Square", "protected_area": "national_park", "ISO3166-1:alpha3": "KEN"}),
    ("a2", "square", {"protect_class": " 1b ", "name": "Carre", "name:en": "Core", "boundary": "protected_area", "addr:country": "KE"}),
    ("a3", "square", {"iucn_level": "Ia", "name": "", "leisure": "nature_reserve", "marine": "yes"}),
    ("b1", "hole", {"iucn_level": "", "protect_class": "5", "boundary": "", "leisure": "park", "maritime": "no"}),
    ("b2", "hole", {"iucn_level": "9", "protect_class": "1"}),
    ("c1", "ell", {"protect_class": "VI", "name": "Ell", "maritime": "yes"}),
    ("d1", "parts", {"name:en": "Parts"}),
]
# what the rules make of them: area, polygon, rank, category, name, designation, country, marine
AREA_ROWS = [
    ("a1", "square", 1, "II", "Square", "national_park", "KEN", False), ("a2", "square", 0, "Ia", "Core", "protected_area", "KE", False),
    ("a3", "square", 0, "Ia", "OSM area a3", "nature_reserve", "", True), ("b1", "hole", 4, "V", "OSM area b1", "park", "", False),
    ("b2", "hole", 6, "Not Reported", "OSM area b2", "", "", False), ("c1", "ell", 5, "VI", "Ell", "", "", True), ("d1", "parts", 6, "Not Reported", "Parts", "", "", False),
]
AREAS_SQL = "areas (area_id, poly_id, rank, category, name, designation, country, marine) AS (VALUES " + ", ".join(
    "(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in AREA_ROWS
) + ")"


@query(
    f"""WITH {PTS}, {EDGES}, {INSIDE}, {AREAS_SQL} SELECT id, area_id, category, name, designation, country, marine FROM ins JOIN areas USING (poly_id) QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank, area_id)=1"""
)
def e08_protected_status(spark, d):
    areas = spark.createDataFrame(AREAS, "area_id string, poly_id string, tags map<string, string>")
    hits = E.points_in_polygons(points(spark, d), polys(spark)).join(F.broadcast(areas), "poly_id")
    return E.protected_status(hits.select("id", "area_id", "tags"))


SEG = f"seg AS (SELECT lng AS x0, lat AS y0, lead(lng) OVER w AS x1, lead(lat) OVER w AS y1 FROM (SELECT event_id, user_id, {X.point_sql('event_id')} FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"


def _entry(v: str, lo: str, hi: str, d: str, end: int) -> str:
    pick = "least" if end == 0 else "greatest"
    return f"CASE WHEN {d}=0 THEN CASE WHEN {v} BETWEEN {lo} AND {hi} THEN {end}.0 ELSE {2 if end == 0 else -1}.0 END ELSE {pick}(({lo}-{v})/nullif({d},0),({hi}-{v})/nullif({d},0)) END"


@query(
    f"""WITH {BOX}, {SEG}, j AS (SELECT *, x1-x0 AS dx, y1-y0 AS dy FROM seg JOIN boxes ON least(x0,x1)<=lng_max AND greatest(x0,x1)>=lng_min AND least(y0,y1)<=lat_max AND greatest(y0,y1)>=lat_min WHERE x1 IS NOT NULL),
    t AS (SELECT *, greatest(0.0, least(1.0, {_entry("x0", "lng_min", "lng_max", "dx", 1)}, {_entry("y0", "lat_min", "lat_max", "dy", 1)}) - greatest(0.0, {_entry("x0", "lng_min", "lng_max", "dx", 0)}, {_entry("y0", "lat_min", "lat_max", "dy", 0)})) AS t FROM j),
    m AS (SELECT box_id, t*sqrt(pow(dx*111320.0*cos(radians((lat_min+lat_max)/2)),2)+pow(dy*111320.0,2)) AS m FROM t)
    SELECT box_id, round(sum(m)/1000,3) AS km FROM m GROUP BY box_id HAVING sum(m)>0"""
)
def e06_line_length_in_boxes(spark, d):
    from pyspark.sql.window import Window

    e = X.with_point(X.read(spark, d, "events").select("event_id", "user_id"), "event_id")
    w = Window.partitionBy("user_id").orderBy("event_id")
    seg = e.select(F.col("lng").alias("x0"), F.col("lat").alias("y0"), F.lead("lng").over(w).alias("x1"), F.lead("lat").over(w).alias("y1")).where("x1 is not null")
    return E.line_length_in_boxes(seg, boxes(spark, d)).select("box_id", F.round(F.col("metres") / 1000, 3).alias("km"))


@query(f"WITH {FIELD}, {BOX} SELECT box_id, count(poly_id) AS n FROM boxes LEFT JOIN fa ON lng BETWEEN lng_min AND lng_max AND lat BETWEEN lat_min AND lat_max GROUP BY box_id")
def e05_count_centroids(spark, d):
    f = E.field_areas(fields(spark, d), (-100.0, -60.0, 100.0, 60.0))
    return E.count_in_boxes(f.select(F.col("poly_id").alias("id"), "lng", "lat"), boxes(spark, d))


DIV = """divs AS (SELECT 'n' || n_nationkey AS division, lower(n_name) AS name, 2 AS admin_rank, 300.0 AS area, (n_nationkey%5)*20-50.0 AS x, (n_nationkey//5)*15-40.0 AS y, 20.0 AS w, 15.0 AS h FROM nation
 UNION ALL SELECT 'r' || r_regionkey, lower(r_name), 1, 1500.0, r_regionkey*20-50.0, -40.0, 20.0, 75.0 FROM region)"""


def divisions(spark, d):
    n = X.read(spark, d, "nation").select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("division"), F.lower("n_name").alias("name"), F.lit(2).alias("admin_rank"), F.lit(300.0).alias("area"),
        ((F.col("n_nationkey") % 5) * 20 - 50.0).alias("lng_min"), (F.expr("n_nationkey div 5") * 15 - 40.0).alias("lat_min"), F.lit(20.0).alias("w"), F.lit(15.0).alias("h"),
    )
    r = X.read(spark, d, "region").select(
        F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("division"), F.lower("r_name").alias("name"), F.lit(1).alias("admin_rank"), F.lit(1500.0).alias("area"),
        (F.col("r_regionkey") * 20 - 50.0).alias("lng_min"), F.lit(-40.0).alias("lat_min"), F.lit(20.0).alias("w"), F.lit(75.0).alias("h"),
    )
    u = n.union(r)
    return u.withColumns({"lng_max": F.col("lng_min") + F.col("w"), "lat_max": F.col("lat_min") + F.col("h")}).drop("w", "h")


@query(
    f"""WITH {PTS}, {DIV}, h AS (SELECT id, ['a','asia','china','zz'][id%4+1] AS query, divs.* FROM pts JOIN divs ON lng>=x AND lng<x+w AND lat>=y AND lat<y+h),
    t AS (SELECT *, CASE WHEN name=query THEN 0 WHEN contains(name,query) THEN 1 ELSE 2 END AS tier FROM h)
    SELECT id, division, tier FROM t QUALIFY row_number() OVER (PARTITION BY id ORDER BY tier, CASE WHEN tier=0 THEN admin_rank END NULLS LAST, CASE WHEN tier=0 THEN -area ELSE area END, division)=1"""
)
def e02_resolve_division(spark, d):
    q = points(spark, d).withColumn("query", F.element_at(F.array(*map(F.lit, ("a", "asia", "china", "zz"))), (F.col("id") % 4 + 1).cast("int")))
    p = q.withColumns({"tx": F.floor(F.col("lng") / 10), "ty": F.floor(F.col("lat") / 10)})
    hit = (F.col("lng") >= F.col("lng_min")) & (F.col("lng") < F.col("lng_max")) & (F.col("lat") >= F.col("lat_min")) & (F.col("lat") < F.col("lat_max"))
    hits = p.join(E.tiles_of(divisions(spark, d), 10.0), ["tx", "ty"]).where(hit)
    return E.resolve_division(hits).select("id", "division", "tier")


# what is asked for, and how the names are compared
ASKED = (("a", "a"), ("Ásia!", "asia"), ("CHINA", "china"), ("zz", "zz"), ("the United-States  of", "the united states of"), ("Perú", "peru"), ("", ""))


@query(
    f"""WITH {PTS}, {DIV}, k AS (SELECT *, CASE admin_rank WHEN 2 THEN 'locality' ELSE 'region' END AS subtype, replace(name, '-', ' ') AS n FROM divs),
    h AS (SELECT id, [{", ".join(f"'{n}'" for _, n in ASKED)}][id%{len(ASKED)}+1] AS q, k.* FROM pts JOIN k ON lng>=x AND lng<x+w AND lat>=y AND lat<y+h),
    t AS (SELECT *, w*h AS box, CASE WHEN q='' THEN 2 WHEN n=q THEN 0 WHEN contains(n,q) OR contains(q,n) THEN 1 ELSE 2 END AS tier FROM h)
    SELECT id, division, name, subtype, tier FROM t QUALIFY row_number() OVER (PARTITION BY id ORDER BY tier, CASE WHEN tier=0 THEN admin_rank ELSE 0 END, CASE WHEN tier=0 THEN -box ELSE box END, division)=1"""
)
def e02_division_near(spark, d):
    u = divisions(spark, d)
    corner = lambda x, y: F.struct(F.col(x).cast("double").alias("lng"), F.col(y).cast("double").alias("lat"))
    ring = F.array(corner("lng_min", "lat_min"), corner("lng_max", "lat_min"), corner("lng_max", "lat_max"), corner("lng_min", "lat_max"), corner("lng_min", "lat_min"))
    areas = u.select("division", "name", F.when(F.col("admin_rank") == 2, "locality").otherwise("region").alias("subtype"), F.array(ring).alias("rings"))
    query = F.element_at(F.array(*[F.lit(q) for q, _ in ASKED]), (F.col("id") % len(ASKED) + 1).cast("int"))
    return E.division_near(points(spark, d).withColumn("query", query), areas)


@query(
    f"""WITH {PTS}, px AS (SELECT o_orderkey%360-180.0 AS lng, (o_orderkey//360)%160-80.0 AS lat, o_totalprice/1000 AS value FROM orders),
    j AS (SELECT id, px.value FROM pts JOIN px ON px.lat BETWEEN pts.lat-2 AND pts.lat+2 AND px.lng BETWEEN pts.lng-2/greatest(cos(radians(pts.lat)),0.05) AND pts.lng+2/greatest(cos(radians(pts.lat)),0.05))
    SELECT id, round(sum(value)+1e-7,4) AS total, count(*) AS pixels FROM j GROUP BY id"""
)
def e09_window_density(spark, d):
    o = X.read(spark, d, "orders")
    px = o.select((F.col("o_orderkey") % 360 - 180.0).alias("lng"), (F.expr("o_orderkey div 360") % 160 - 80.0).alias("lat"), (F.col("o_totalprice") / 1000).alias("value"))
    return E.window_density(points(spark, d), px, 2.0, 4.0).withColumn("total", F.round(F.col("total") + 1e-7, 4))


@query(
    X.with_("pixels")
    + """, p AS (SELECT "row", col, greatest(-(value-200),0.0) AS depth FROM pixels), st(k,dr,dc) AS (VALUES (0,-1,0),(1,1,0),(2,0,-1),(3,0,1)),
    b AS (SELECT l."row" AS r0, l.col AS c0, dr, dc FROM p l CROSS JOIN st JOIN p w ON w."row"=l."row"+dr AND w.col=l.col+dc WHERE l.depth=0 AND w.depth>0 QUALIFY row_number() OVER (PARTITION BY l."row", l.col ORDER BY w.depth DESC, k)=1),
    w AS (SELECT r0, c0, i, depth FROM (SELECT *, unnest(range(1,65)) AS i FROM b) x LEFT JOIN p ON p."row"=r0+i*dr AND p.col=c0+i*dc), s AS (SELECT r0, c0, min(i) AS stop FROM w WHERE depth IS NULL OR depth=0 GROUP BY ALL),
    g AS (SELECT w.r0, w.c0, count(*) AS n, max(depth) AS deepest, sum(30.0/sqrt(9.81*greatest(depth,0.01))) AS seconds, avg((depth>1)::INT) AS ocean FROM w LEFT JOIN s ON s.r0=w.r0 AND s.c0=w.c0 WHERE depth IS NOT NULL AND (stop IS NULL OR i<stop) GROUP BY ALL)
    SELECT r0 AS "row", c0 AS col, n, round(deepest,6) AS deepest, round(seconds+1e-9,4) AS seconds, CASE WHEN deepest<=5 THEN 'too_shallow' WHEN ocean<0.5 THEN 'low_ocean_fraction' ELSE 'oceanic' END AS class FROM g WHERE n>=3"""
)
def e10_seaward_profile(spark, d):
    elev = X.pixels(spark, d).withColumn("value", F.col("value") - 200)
    out = E.seaward_profile(elev)
    return out.withColumns({"deepest": F.round("deepest", 6), "seconds": F.round(F.col("seconds") + 1e-9, 4)})
