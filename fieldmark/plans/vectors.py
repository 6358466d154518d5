"""Queries over vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmark.operators import vectors as V
from fieldmark.operators.grid import LAT_MAX, LNG_MAX, to_cell
from fieldmark.operators.lookup import latest_facts
from fieldmark.sources import fixtures as X

from .base import catalog
from .grid import CELLS

QUERIES, SQL, query = catalog()


COS = "list_dot_product({a},{b})/(sqrt(list_dot_product({a},{a}))*sqrt(list_dot_product({b},{b})))"


def cos(a, b):
    return COS.format(a=a, b=b)


# query cells are those divisible by 10, each with its oldest vector
Q = "q AS (SELECT cell AS q, arg_min(vec, tslot) AS qv FROM vecs WHERE cell % 10 = 0 GROUP BY cell)"
KNN = f"s AS (SELECT q, cell, max({cos('qv','vec')}) AS score FROM q JOIN vecs ON q<>cell GROUP BY ALL), knn AS (SELECT q, cell, score, row_number() OVER (PARTITION BY q ORDER BY round(score,9) DESC, cell) AS rank FROM s QUALIFY rank<=5)"
BITS = "bits AS (SELECT cell, tslot, vec_id, list_reduce(list_transform(vec, lambda v: CASE WHEN v>=0 THEN '1' ELSE '0' END), lambda a, b: a || b) AS bits FROM vecs)"
HAM = "qb AS (SELECT cell AS q, arg_min(bits, tslot) AS qbits FROM bits WHERE cell%10=0 GROUP BY cell), hd AS (SELECT q, cell, min(hamming(bits, qbits)) AS d FROM qb JOIN bits ON q<>cell GROUP BY ALL), ham AS (SELECT *, 1-2*d/64.0 AS score, row_number() OVER (PARTITION BY q ORDER BY d, cell) AS rank FROM hd)"


def queries(v):
    return V.pick_vector(v.where("cell % 10 = 0"), "oldest")


def knn(spark, d, k=5):
    v = X.vecs(spark, d)
    return V.find_similar(queries(v), v, k)


def ham(spark, d, k):
    b = V.pack_bits(X.vecs(spark, d))
    q = b.where("cell % 10 = 0").groupBy(F.col("cell").alias("q")).agg(F.min_by("dims", "tslot").alias("dims"), F.min_by("bits", "tslot").alias("bits"))
    return V.find_similar_hamming(q, b, k)


@query(X.with_("vecs") + f"SELECT a.cell, round(sqrt(list_sum(list_transform(list_zip(a.vec,b.vec), lambda z: (z[1]-z[2])*(z[1]-z[2])))),5) AS l2, round({cos('a.vec','b.vec')},6) AS cosine, list_transform(list_zip(a.vec,b.vec), lambda z: round(z[2]-z[1],6)+0.0) AS residual FROM vecs a JOIN vecs b ON a.cell=b.cell AND a.tslot=2017 AND b.tslot=2021")
def d04_state_diff(spark, d):
    return V.state_diff(X.vecs(spark, d), 2017, 2021).select(
        "cell", F.round("l2", 5).alias("l2"), F.round("cosine", 6).alias("cosine"), F.transform("residual", lambda x: F.round(x, 6) + 0.0).alias("residual")
    )


@query(X.with_("vecs", extra=f"{Q}, {KNN}") + "SELECT q, cell, rank, round(score,6) AS score FROM knn")
def d05_find_similar(spark, d):
    return knn(spark, d).select("q", "cell", "rank", F.round("score", 6).alias("score"))


@query(
    X.with_("vecs", extra=Q)
    + f""", ok AS (SELECT DISTINCT cell FROM vecs WHERE label<5), s AS (SELECT q, cell, max({cos("qv", "vec")}) AS score FROM q JOIN vecs ON q<>cell WHERE cell IN (SELECT cell FROM ok) GROUP BY ALL)
    SELECT q, cell, row_number() OVER (PARTITION BY q ORDER BY round(score,9) DESC, cell) AS rank, round(score,6) AS score FROM s QUALIFY rank<=5"""
)
def d06_find_similar_claim(spark, d):
    v = X.vecs(spark, d)
    admitted = v.where("label < 5").select("cell").distinct()
    return V.find_similar(queries(v), v.join(admitted, "cell", "left_semi"), 5).select("q", "cell", "rank", F.round("score", 6).alias("score"))


@query(
    X.with_("vecs", "facts", "latest", extra=Q)
    + f""", ok AS (SELECT DISTINCT cell FROM latest WHERE band='click' AND kind='primary' AND num>=40), s AS (SELECT q, cell, max({cos("qv", "vec")}) AS score FROM q JOIN vecs ON q<>cell WHERE cell IN (SELECT cell FROM ok) GROUP BY ALL)
    SELECT q, cell, row_number() OVER (PARTITION BY q ORDER BY round(score,9) DESC, cell) AS rank, round(score,6) AS score FROM s QUALIFY rank<=5"""
)
def d06_find_similar_where(spark, d):
    v = X.vecs(spark, d)
    found = V.find_similar_where(queries(v), v, {"band": "click", "op": "ge", "value": 40.0}, latest_facts(X.facts(spark, d)), 5)
    return found.select("q", "cell", "rank", F.round("score", 6).alias("score"))


#: The vectors' cells on the grid, and the places of the suppliers.
ON_GRID = f"""pts AS (SELECT DISTINCT cell AS id, {X.point_sql("cell")} FROM vecs), {CELLS}, m AS (SELECT id, cell AS grid, ((cell >> 22) & {LAT_MAX})/{LAT_MAX}.0*180-90 AS lat, (cell & {LNG_MAX})/{LNG_MAX}.0*360-180 AS lng FROM cells),
  place AS (SELECT s_suppkey AS place, {X.point_sql("s_suppkey").replace(" AS lat", " AS plat").replace(" AS lng", " AS plng")} FROM supplier),
  near AS (SELECT id, place, round(2*6371.0088*asin(sqrt(least(1.0, pow(sin(radians(plat-lat)/2),2)+cos(radians(lat))*cos(radians(plat))*pow(sin(radians(plng-lng)/2),2)))),5) AS km FROM m JOIN place ON abs(plat-lat)<10 QUALIFY km<=300 AND row_number() OVER (PARTITION BY id ORDER BY km, place)=1)"""


@query(
    X.with_("vecs", extra=f"{ON_GRID}, {Q}")
    + f""", s AS (SELECT q, cell, max({cos("qv", "vec")}) AS score FROM q JOIN vecs ON q<>cell GROUP BY ALL), g AS (SELECT a.grid AS q, b.grid AS cell, b.id, b.lat, b.lng, score FROM s JOIN m a ON a.id=s.q JOIN m b ON b.id=s.cell),
    k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score,9) DESC, cell) AS rank FROM g QUALIFY rank<=5)
    SELECT q, cell, rank, round(score,6) AS score, round(lat,9) AS lat, round(lng,9) AS lng, count(*) OVER (PARTITION BY q) AS returned_k, 5 AS requested_k, place, km FROM k LEFT JOIN near USING (id)"""
)
def d05_similar_places(spark, d):
    v = to_cell(X.with_point(X.vecs(spark, d).withColumn("id", F.col("cell")), "cell"))
    places = X.with_point(X.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), "id")
    asked = V.pick_vector(v.where("id % 10 = 0"), "oldest")
    found = V.similar_places(V.find_similar(asked, v.select("cell", "tslot", "vec"), 5), 5, places)
    return found.select("q", "cell", "rank", F.round("score", 6).alias("score"), F.round("lat", 9).alias("lat"), F.round("lng", 9).alias("lng"), "returned_k", "requested_k", "place", F.round("km", 5).alias("km"))


@query(X.with_("vecs", extra=BITS) + "SELECT cell, tslot, bits FROM bits")
def d07_pack_bits(spark, d):
    words = F.array_join(F.transform("bits", lambda b: F.lpad(F.bin(b), 64, "0")), "")
    return V.pack_bits(X.vecs(spark, d)).select("cell", "tslot", F.substring(words, F.lit(1), F.col("dims")).alias("bits"))


@query(None)
def d07_pack_bits_rotated(spark, d):
    return V.pack_bits(V.rotate(X.vecs(spark, d), V.rotation(64))).select("cell", "tslot", "dims", F.array_join(F.transform("bits", lambda b: F.hex(b)), "").alias("bits"))


@query(X.with_("vecs", extra=f"{BITS}, {HAM}") + "SELECT q, cell, d, rank, round(score,6) AS score FROM ham WHERE rank<=5")
def d08_find_similar_hamming(spark, d):
    return ham(spark, d, 5).select("q", "cell", "d", "rank", F.round("score", 6).alias("score"))


RERANK = f"re AS (SELECT t.q, t.cell, max({cos('q.qv','v.vec')}) AS score FROM ham t JOIN q ON q.q=t.q JOIN vecs v ON v.cell=t.cell WHERE t.rank<=20 GROUP BY ALL), rr AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score,9) DESC, cell) AS rank FROM re QUALIFY rank<=5)"


@query(X.with_("vecs", extra=f"{Q}, {BITS}, {HAM}, {RERANK}") + "SELECT q, cell, rank, round(score,6) AS score FROM rr")
def d09_rerank(spark, d):
    v = X.vecs(spark, d)
    return V.rerank(ham(spark, d, V.triage_size(5, None)), queries(v), v, 5).select("q", "cell", "rank", F.round("score", 6).alias("score"))


@query(X.with_("vecs", extra=f"{Q}, {BITS}, {HAM}, {RERANK}") + "SELECT rr.q, round(count(h.cell)/count(*),6) AS recall FROM rr LEFT JOIN ham h ON h.q=rr.q AND h.cell=rr.cell AND h.rank<=5 GROUP BY rr.q")
def d10_triage_recall(spark, d):
    v = X.vecs(spark, d)
    t = ham(spark, d, 20)
    return V.triage_recall(t, V.rerank(t, queries(v), v, 5), 5).withColumn("recall", F.round("recall", 6))


@query(
    X.with_("vecs", extra=f"{Q}, {BITS}, {HAM}, {RERANK}")
    + """, rc AS (SELECT rr.q, count(h.cell)/count(*) AS recall FROM rr LEFT JOIN ham h ON h.q=rr.q AND h.cell=rr.cell AND h.rank<=5 GROUP BY rr.q)
    SELECT q, round(list_reduce(list(recall) OVER w, lambda a, x: 0.95*a+0.05*x),6) AS ewma, row_number() OVER (ORDER BY q)>=50 AS warm FROM rc WINDOW w AS (ORDER BY q ROWS BETWEEN 999 PRECEDING AND CURRENT ROW)"""
)
def d10_recall_ewma(spark, d):
    v = X.vecs(spark, d)
    t = ham(spark, d, 20)
    return V.recall_ewma(V.triage_recall(t, V.rerank(t, queries(v), v, 5), 5)).withColumn("ewma", F.round("ewma", 6))


PARTS = ((1, 32), (17, 48), (33, 64))


def _part(lo, hi, i):
    q = f"q{i} AS (SELECT cell AS q, arg_min(vec[{lo}:{hi}], tslot) AS qv FROM vecs WHERE cell%10=0 GROUP BY cell)"
    s = f"k{i} AS (SELECT q, cell FROM (SELECT q, cell, max({cos('qv', f'vec[{lo}:{hi}]')}) AS score FROM q{i} JOIN vecs ON q<>cell GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(score,9) DESC, cell)<=10)"
    return f"{q}, {s}"


def part(v, lo, hi):
    return v.withColumn("vec", F.slice("vec", lo, hi - lo + 1))


@query(
    X.with_("vecs", extra=", ".join(_part(a, b, i) for i, (a, b) in enumerate(PARTS)))
    + "SELECT q, cell, count(*) AS n, CASE count(*) WHEN 3 THEN 'all_three' WHEN 2 THEN 'two_of_three' ELSE 'one_or_none' END AS agreement FROM (SELECT * FROM k0 UNION ALL SELECT * FROM k1 UNION ALL SELECT * FROM k2) GROUP BY q, cell"
)
def d11_consensus(spark, d):
    v = X.vecs(spark, d)
    return V.consensus([V.find_similar(queries(part(v, a, b)), part(v, a, b), 10) for a, b in PARTS])


@query(
    X.with_("vecs")
    + f""", e AS (SELECT label, generate_subscripts(vec,1) AS i, unnest(vec) AS x FROM vecs), m AS (SELECT label, i, avg(x) AS m FROM e GROUP BY ALL), c AS (SELECT label, list(m ORDER BY i) AS centre FROM m GROUP BY label),
    s AS (SELECT vec_id, c.label, round({cos("vec", "centre")},9) AS s FROM vecs CROSS JOIN c), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS rn FROM s)
    SELECT vec_id, max(label) FILTER (rn=1) AS archetype, round(max(s) FILTER (rn=1)-max(s) FILTER (rn=2),6) AS margin FROM r GROUP BY vec_id"""
)
def d12_classify_archetype(spark, d):
    v = X.vecs(spark, d)
    m = v.select("label", F.posexplode("vec").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    c = m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))
    return V.classify_archetype(v, c).withColumn("margin", F.round("margin", 6))


def encoders(v):
    out = None
    for i, (a, b) in enumerate(PARTS):
        rows = part(v, a, b).withColumn("band", F.lit(f"e{i}")).where(f"(cell + {i}) % 4 <> 0")
        out = rows if out is None else out.unionByName(rows)
    return out


ENC = "enc AS (" + " UNION ALL ".join(f"SELECT cell, tslot, 'e{i}' AS band, vec[{a}:{b}] AS vec FROM vecs WHERE (cell+{i})%4<>0" for i, (a, b) in enumerate(PARTS)) + ")"


@query(
    X.with_("vecs", extra=ENC)
    + """, n AS (SELECT cell, band, arg_max(vec,tslot) AS vec FROM enc GROUP BY ALL), z AS (SELECT cell, unnest(['e0','e1','e2']) AS band FROM (SELECT DISTINCT cell FROM enc)),
    c AS (SELECT z.cell, list_transform(flatten(list(coalesce(n.vec, list_transform(range(32), lambda i: 0.0)) ORDER BY z.band)), lambda x: round(x,6)+0.0) AS cube FROM z LEFT JOIN n ON n.cell=z.cell AND n.band=z.band GROUP BY z.cell)
    SELECT cell, any_value(c.cube) AS cube, 96 AS dims, (count(*) FILTER (band='e0')=0)::INT+(count(*) FILTER (band='e1')=0)::INT+(count(*) FILTER (band='e2')=0)::INT AS missing FROM n JOIN c USING (cell) GROUP BY cell"""
)
def d15_state_cube(spark, d):
    c = V.state_cube(encoders(X.vecs(spark, d)), [("e0", 32), ("e1", 32), ("e2", 32)])
    return c.select("cell", F.transform("cube", lambda x: F.round(x, 6) + 0.0).alias("cube"), F.size("cube").alias("dims"), F.size("missing").alias("missing"))


@query(
    X.with_("vecs", extra=ENC)
    + """SELECT cell, string_agg(DISTINCT band, ',' ORDER BY band) AS have, concat_ws(',', CASE WHEN count(*) FILTER (band='e0')=0 THEN 'e0' END, CASE WHEN count(*) FILTER (band='e1')=0 THEN 'e1' END, CASE WHEN count(*) FILTER (band='e2')=0 THEN 'e2' END) AS missing FROM enc GROUP BY cell"""
)
def d16_state_multi(spark, d):
    m = V.state_multi(encoders(X.vecs(spark, d)), ["e0", "e1", "e2"])
    return m.select("cell", F.array_join(F.array_sort(F.map_keys("state")), ",").alias("have"), F.array_join("missing", ",").alias("missing"))


@query("SELECT l_orderkey AS id, l_partkey, l_suppkey, round(CASE WHEN l_orderkey%3=1 THEN l_quantity*2 ELSE l_quantity END,6) AS elevation, CASE WHEN l_orderkey%3=1 THEN 'sea' ELSE 'land' END AS source, l_quantity>5 AS disagree FROM lineitem")
def d17_fuse_elevation(spark, d):
    li = X.read(spark, d, "lineitem")
    rows = li.select(
        F.struct("l_orderkey", "l_partkey", "l_suppkey").alias("id"), (F.col("l_quantity") * 2).alias("sea"), F.col("l_quantity").alias("land"),
        (F.col("l_orderkey") % 3).alias("mask"),
    )
    out = V.fuse_elevation(rows)
    return out.select(F.col("id.l_orderkey").alias("id"), F.col("id.l_partkey").alias("l_partkey"), F.col("id.l_suppkey").alias("l_suppkey"), F.round("elevation", 6).alias("elevation"), "source", "disagree")


@query(
    X.with_("vecs", extra=ENC)
    + f""", r AS (SELECT *, row_number() OVER (PARTITION BY cell, band ORDER BY tslot DESC) AS rn FROM enc), s AS (SELECT a.cell, greatest(0.0, least(1.0, 1-{cos("a.vec", "b.vec")})) AS s FROM r a JOIN r b ON a.cell=b.cell AND a.band=b.band AND a.rn=1 AND b.rn=2)
    SELECT cell, round(sqrt(avg(s*s)),6) AS ensemble, count(*) FILTER (s>0.15) AS votes, CASE WHEN count(*) FILTER (s>0.15)=count(*) THEN 'changed' WHEN count(*) FILTER (s>0.15)>0 THEN 'mixed' ELSE 'stable' END AS label FROM s GROUP BY cell"""
)
def f12_change_consensus(spark, d):
    return V.change_consensus(encoders(X.vecs(spark, d))).withColumn("ensemble", F.round("ensemble", 6))


@query(
    X.with_("vecs")
    + f""", h AS (SELECT label AS grp, vec_id AS cell, vec_id%17 AS value, vec FROM vecs), e AS (SELECT grp, generate_subscripts(vec,1) AS i, unnest(vec) AS x FROM h WHERE cell%6<>0),
    m AS (SELECT grp, i, avg(x) AS m FROM e GROUP BY ALL), c AS (SELECT grp, list(m ORDER BY i) AS centre FROM m GROUP BY grp)
    , z AS (SELECT h.grp, h.cell, h.value, round({cos("h.vec", "c.centre")},9) AS s FROM h JOIN c USING (grp) WHERE h.cell%6<>0 UNION ALL SELECT grp, cell, value, NULL FROM h WHERE cell%6=0)
    SELECT grp, cell, row_number() OVER (PARTITION BY grp ORDER BY s DESC NULLS LAST, value DESC, cell) AS rank, 'centroid' AS reason FROM z"""
)
def h04_rerank_by_centroid(spark, d):
    v = X.vecs(spark, d)
    h = v.select(F.col("label").alias("grp"), F.col("vec_id").alias("cell"), (F.col("vec_id") % 17).alias("value"))
    return V.rerank_by_centroid(h, v.where("vec_id % 6 <> 0").select(F.col("vec_id").alias("cell"), "vec"))


@query(
    X.with_("vecs", extra=ENC)
    + f""", r AS (SELECT *, row_number() OVER (PARTITION BY cell, band ORDER BY tslot DESC) AS rn FROM enc), s AS (SELECT a.cell, greatest(0.0, least(1.0, 1-{cos("a.vec", "b.vec")})) AS s FROM r a JOIN r b ON a.cell=b.cell AND a.band=b.band AND a.rn=1 AND b.rn=2)
    SELECT cell, round(sqrt(avg(s*s)),6) AS ensemble, count(*) FILTER (s>0.2) AS votes, CASE WHEN count(*) FILTER (s>0.2)=count(*) THEN 'changed' WHEN count(*) FILTER (s>0.2)>0 THEN 'mixed' ELSE 'stable' END AS label, count(*) FILTER (s>0.2)>0 AND cell%3>0 AS uplift FROM s GROUP BY cell"""
)
def f13_change_variant(spark, d):
    v = X.vecs(spark, d)
    mask = v.select("cell").distinct().select("cell", (F.col("cell") % 3).cast("double").alias("leg"))
    return V.change_variant(encoders(v), "forest", mask).withColumn("ensemble", F.round("ensemble", 6))


# the other domains: gate, uplift test of the leg, and the leg itself, in SQL and as a column
VARIANTS = {
    "wetland": (0.1, "abs(cell%40-20)>=15", lambda cell: cell % 40 - 20),
    "urban": (0.2, "cell%3<>1", lambda cell: cell % 3 - 1),
    "coast": (0.12, "cell%21 BETWEEN 5 AND 15", lambda cell: cell % 21 - 10),
}


def _variant(domain: str, leg) -> None:
    gate, test, _ = VARIANTS[domain]
    sql = SQL["f13_change_variant"].replace("s>0.2", f"s>{gate}").replace("cell%3>0", test)

    def run(spark, d):
        v = X.vecs(spark, d)
        legs = v.select("cell").distinct().select("cell", leg(F.col("cell")).cast("double").alias("leg"))
        return V.change_variant(encoders(v), domain, legs).withColumn("ensemble", F.round("ensemble", 6))

    run.__name__ = f"f13_change_{domain}"
    query(sql)(run)


for _domain, (_, _, _leg) in VARIANTS.items():
    _variant(_domain, _leg)

NEW = "nw AS (SELECT cell, band, arg_max(vec,tslot) AS vec, max(tslot) AS tslot FROM enc GROUP BY ALL)"


@query(
    X.with_("vecs", extra=f"{ENC}, {NEW}")
    + f""", pr AS (SELECT DISTINCT cell AS a, cell+1 AS b FROM vecs), j AS (SELECT a, b, x.band, {cos("x.vec", "y.vec")} AS c, list_dot_product(x.vec,y.vec) AS pq, list_dot_product(x.vec,x.vec) AS pp, list_dot_product(y.vec,y.vec) AS qq FROM pr JOIN nw x ON x.cell=a JOIN nw y ON y.cell=b AND y.band=x.band)
    SELECT a, b, string_agg(band || '=' || CAST(round(c*10000) AS BIGINT), ',' ORDER BY band) AS bands, round(sum(pq)/sqrt(sum(pp)*sum(qq)),6) AS cosine FROM pr LEFT JOIN j USING (a, b) GROUP BY a, b"""
)
def d01_compare_vectors(spark, d):
    v = X.vecs(spark, d)
    pairs = v.select(F.col("cell").alias("a"), (F.col("cell") + 1).alias("b")).distinct()
    out = V.compare_vectors(pairs, encoders(v))
    bands = F.array_join(F.transform("bands", lambda s: F.concat(s["band"], F.lit("="), F.round(s["cosine"] * 10000).cast("bigint").cast("string"))), ",")
    return out.select("a", "b", bands.alias("bands"), F.round("cosine", 6).alias("cosine"))


@query(
    X.with_("vecs", extra=f"{ENC}, {NEW}")
    + f""", q AS (SELECT DISTINCT cell, CASE WHEN cell%2=0 THEN 2019 END AS ts, ['cosine_ge','cosine_gt','l2_le'][cell%3+1] AS predicate, [0.0,0.1,1.3][cell%3+1] AS threshold FROM vecs),
    s AS (SELECT q.*, CASE WHEN ts IS NULL THEN n0.vec ELSE e0.vec END AS va, CASE WHEN ts IS NULL THEN n1.vec ELSE e1.vec END AS vb, CASE WHEN ts IS NULL THEN n0.tslot ELSE e0.tslot END AS tslot_a, CASE WHEN ts IS NULL THEN n1.tslot ELSE e1.tslot END AS tslot_b
      FROM q LEFT JOIN nw n0 ON n0.cell=q.cell AND n0.band='e0' LEFT JOIN nw n1 ON n1.cell=q.cell AND n1.band='e1' LEFT JOIN enc e0 ON e0.cell=q.cell AND e0.band='e0' AND e0.tslot=q.ts LEFT JOIN enc e1 ON e1.cell=q.cell AND e1.band='e1' AND e1.tslot=q.ts),
    c AS (SELECT *, {cos("va", "vb")} AS cosine, sqrt(list_sum(list_transform(list_zip(va,vb), lambda z: (z[1]-z[2])*(z[1]-z[2])))) AS l2, list_sum(list_transform(list_zip(va,vb), lambda z: z[2]-z[1])) AS moved FROM s)
    SELECT cell, tslot_a, tslot_b, predicate, round(cosine,6) AS cosine, round(l2,5) AS l2, round(moved,5) AS moved, coalesce(CAST(CASE predicate WHEN 'cosine_ge' THEN cosine>=threshold WHEN 'cosine_gt' THEN cosine>threshold ELSE l2<=threshold END AS VARCHAR),'incomparable') AS verdict FROM c"""
)
def d02_compare_vector_bands(spark, d):
    v = X.vecs(spark, d)
    kind = (F.col("cell") % 3 + 1).cast("int")
    q = v.select("cell").distinct().select(
        "cell", F.lit("e0").alias("band_a"), F.lit("e1").alias("band_b"), F.when(F.col("cell") % 2 == 0, F.lit(2019)).cast("bigint").alias("tslot"),
        F.element_at(F.array(*map(F.lit, ("cosine_ge", "cosine_gt", "l2_le"))), kind).alias("predicate"), F.element_at(F.array(*map(F.lit, (0.0, 0.1, 1.3))), kind).alias("threshold"),
    )
    out = V.compare_vector_bands(q, encoders(v).select("cell", "band", F.col("tslot").cast("bigint").alias("tslot"), "vec"))
    moved = F.aggregate("delta", F.lit(0.0), lambda a, x: a + x)
    return out.select("cell", "tslot_a", "tslot_b", "predicate", F.round("cosine", 6).alias("cosine"), F.round("l2", 5).alias("l2"), F.round(moved, 5).alias("moved"), "verdict")


@query(
    X.with_("vecs", extra=ENC)
    + "SELECT a.cell, a.band, a.tslot AS tslot_a, b.tslot AS tslot_b, 'delta' AS op, list_transform(list_zip(a.vec,b.vec), lambda z: round(z[2]-z[1],6)+0.0) AS vec, 1.0::DOUBLE AS confidence, 'nd.delta@1' AS fn_key FROM enc a JOIN enc b ON a.cell=b.cell AND a.band=b.band AND b.tslot=a.tslot+1"
)
def d03_diff_vectors(spark, d):
    e = encoders(X.vecs(spark, d))
    q = e.select("cell", "band", F.col("tslot").alias("tslot_a"), (F.col("tslot") + 1).alias("tslot_b"))
    return V.diff_vectors(q, e).withColumn("vec", F.transform("vec", lambda x: F.round(x, 6) + 0.0))
