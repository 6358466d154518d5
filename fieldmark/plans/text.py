"""Queries over questions, hotspots, integrity and streams, and file ingests."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmark.operators import integrity as K
from fieldmark.operators import lookup as L
from fieldmark.operators import routing as R
from fieldmark.operators.grid import LAT_MAX, LNG_MAX, to_cell
from fieldmark.sources import fixtures as X
from fieldmark.sources import ingest as G
from fieldmark.sources.fixtures import scratch
from fieldmark.streaming import jobs as J

from .base import catalog
from .aggregate import REGION_SQL, regions
from .grid import CELLS

QUERIES, SQL, query = catalog()


# Topics and their aliases, topics and their bands.
TOPICS = [("cold", "cold"), ("cold", "frozen"), ("blue", "blue anvil"), ("blue", "blue"), ("widget", "widget"), ("metal", "steel"), ("metal", "copper"), ("red", "red"), ("green", "green")]
TOPIC_BANDS = [("cold", "click"), ("cold", "view"), ("blue", "purchase"), ("widget", "click"), ("widget", "error"), ("metal", "view"), ("red", "signup"), ("green", "purchase")]


def values(name: str, columns: str, rows: list[tuple]) -> str:
    return f"{name} ({columns}) AS (VALUES " + ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows) + ")"


QS = "questions AS (SELECT p_partkey AS qid, p_name AS text FROM part)"
ROUTE = f"{values('topics', 'topic, alias', TOPICS)}, s AS (SELECT qid, topic, max(strlen(alias)/strlen(text)) AS score FROM questions JOIN topics ON contains(lower(text), alias) GROUP BY ALL), routed AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, topic) AS rank FROM s QUALIFY rank<=5)"
ASK = "asked AS (SELECT p_partkey AS qid, ['find ','how recent is ','what changed in ','places similar to ','value of '][p_partkey%5+1] || p_name || [' in ',' near ',' over '][p_partkey%3+1] || 'Region ' || (p_partkey%7) || '?' AS text FROM part)"


def questions(spark, d):
    return X.read(spark, d, "part").select(F.col("p_partkey").alias("qid"), F.col("p_name").alias("text"))


def asked(spark, d):
    k = F.col("p_partkey")

    def pick(words, n):
        return F.element_at(F.array(*map(F.lit, words)), (k % n + 1).cast("int"))

    text = F.concat(pick(("find ", "how recent is ", "what changed in ", "places similar to ", "value of "), 5), F.col("p_name"), pick((" in ", " near ", " over "), 3), F.lit("Region "), (k % 7).cast("string"), F.lit("?"))
    return X.read(spark, d, "part").select(k.alias("qid"), text.alias("text"))


def topics(spark):
    return spark.createDataFrame(TOPICS, "topic string, alias string")


@query(f"WITH {QS}, {ROUTE} SELECT qid, topic, rank, round(score,6) AS score FROM routed")
def i01_route_keyword(spark, d):
    return R.route_keyword(questions(spark, d), topics(spark)).withColumn("score", F.round("score", 6))


DENIED = (*R.OUT_OF_SCOPE, "idiot", "license")
DENIED_SQL = " OR ".join("contains(lower(text),'" + p.replace("'", "''") + "')" for p in DENIED)


@query(f"SELECT doc_id AS qid, length(trim(text))>0 AND NOT ({DENIED_SQL}) AS in_scope FROM documents")
def i02_in_scope(spark, d):
    return R.in_scope(X.read(spark, d, "documents").select(F.col("doc_id").alias("qid"), "text"), DENIED)


@query(f"SELECT conv_id, turn, length(trim(text))>0 AND NOT ({DENIED_SQL}) AS in_scope FROM conversations")
def i02_conversations_in_scope(spark, d):
    turns = X.read(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("qid"), "text")
    return R.in_scope(turns, DENIED).select("qid.conv_id", "qid.turn", "in_scope")


@query(
    X.with_("vecs", extra=f"{QS}, {ROUTE}")
    + """, e AS (SELECT 't' || label AS topic, generate_subscripts(vec,1) AS i, unnest(vec) AS x FROM vecs), m AS (SELECT topic, i, avg(x) AS m FROM e GROUP BY ALL), c AS (SELECT topic, list(m ORDER BY i) AS c FROM m GROUP BY topic),
    n AS (SELECT vec_id AS qid, topic, round(list_dot_product(vec,c)/(sqrt(list_dot_product(vec,vec))*sqrt(list_dot_product(c,c))),9) AS score FROM vecs CROSS JOIN c),
    u AS (SELECT qid, topic, score, 0 AS src FROM routed UNION ALL SELECT qid, topic, score, 1 FROM n WHERE score>=0.35)
    SELECT qid, topic, row_number() OVER (PARTITION BY qid ORDER BY src, score DESC, topic) AS rank FROM u QUALIFY rank<=5"""
)
def i03_route_embedding(spark, d):
    v = X.vecs(spark, d)
    aliases = v.select(F.concat(F.lit("t"), F.col("label").cast("string")).alias("topic"), "vec")
    keyword = R.route_keyword(questions(spark, d), topics(spark))
    return R.route_embedding(v.select(F.col("vec_id").alias("qid"), "vec"), aliases, keyword).select("qid", "topic", "rank")


def has_sql(phrases) -> str:
    return "(" + " OR ".join("contains(t,'" + p.replace("'", "''") + "')" for p in phrases) + ")"


INTENT_SQL = "CASE " + " ".join(f"WHEN {has_sql(cues)} THEN '{name}'" for name, cues in R.INTENTS) + " ELSE 'recall' END"
EVERYWHERE = (
    "where do you have", "where you have", "global coverage", "global coverage map", "world coverage", "world-wide coverage", "worldwide coverage", "coverage map",
    "show me your coverage", "show me the coverage", "what cells do you have", "what cells are attested", "all the cells", "every cell you have",
    "how much data do you have", "how dense is the corpus", "how dense is data",
)
AUDIT_SQL = f"CASE WHEN {has_sql(R.FRESHNESS)} THEN 'freshness' WHEN {has_sql(R.CORPUS_WORDS)} THEN CASE WHEN {has_sql(R.CORPUS_PREPOSITIONS)} THEN 'regional_density' ELSE 'global_coverage' END WHEN {has_sql(EVERYWHERE)} THEN 'global_coverage' END"
EVENT_SQL = (
    f"CASE WHEN {has_sql(R.HUNT_VERBS)} OR ({has_sql(R.HUNT_PREPOSITIONS)} AND NOT {has_sql(R.PAST)}) THEN CASE "
    + " ".join(f"WHEN {has_sql(cues)}" + (f" AND NOT {has_sql(unless)}" if unless else "") + f" THEN '{name}'" for name, cues, unless in R.EVENTS)
    + " END END"
)


@query(f"WITH {ASK} SELECT qid, {INTENT_SQL} AS intent, {AUDIT_SQL} AS audit, {EVENT_SQL} AS event FROM (SELECT qid, lower(text) AS t FROM asked)")
def i04_classify_questions(spark, d):
    return R.classify_questions(asked(spark, d))


# question templates: every phrase of the rules meets every opening and ending
OPENINGS = ("find ", "", "tell me about ", "where has ")
PHRASES = (*(p for _, cues, unless in R.EVENTS for p in (*cues, *unless)), *R.FRESHNESS, *R.CORPUS_WORDS, *EVERYWHERE, *(p for _, cues in R.INTENTS for p in cues))
ENDINGS = ("", " in ", " since 2020 near ", " for ")


def words_sql(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


TEMPLATES = f"asked AS (SELECT o_orderkey AS qid, lower({words_sql(OPENINGS)}[o_orderkey%{len(OPENINGS)}+1] || {words_sql(PHRASES)}[o_orderkey//{len(OPENINGS)}%{len(PHRASES)}+1] || {words_sql(ENDINGS)}[o_custkey%{len(ENDINGS)}+1] || o_orderpriority) AS t FROM orders)"


@query(f"WITH {TEMPLATES} SELECT qid, {INTENT_SQL} AS intent, {AUDIT_SQL} AS audit, {EVENT_SQL} AS event FROM asked")
def i04_question_rules(spark, d):
    def pick(words, k):
        return F.element_at(F.array(*map(F.lit, words)), (k % len(words) + 1).cast("int"))

    k = F.col("o_orderkey")
    text = F.concat(pick(OPENINGS, k), pick(PHRASES, F.floor(k / len(OPENINGS))), pick(ENDINGS, F.col("o_custkey")), "o_orderpriority")
    return R.classify_questions(X.read(spark, d, "orders").select(k.alias("qid"), text.alias("text")))


@query(f"WITH {ASK} SELECT qid, 'Region ' || (qid%7) AS anchor FROM asked")
def i05_region_anchor(spark, d):
    return R.region_anchor(asked(spark, d))


@query(
    X.with_("facts", extra=f"{QS}, {ROUTE}, {values('tb', 'topic, band', TOPIC_BANDS)}")
    + """, w AS (SELECT DISTINCT qid, qid%300 AS cell, band FROM routed JOIN tb USING (topic)), h AS (SELECT DISTINCT cell, band FROM facts WHERE kind='primary')
    SELECT qid, coalesce(string_agg(w.band, ',' ORDER BY w.band) FILTER (h.cell IS NOT NULL),'') AS observed, coalesce(string_agg(w.band, ',' ORDER BY w.band) FILTER (h.cell IS NULL),'') AS missing FROM w LEFT JOIN h ON h.cell=w.cell AND h.band=w.band GROUP BY qid"""
)
def i06_answer_plan(spark, d):
    routed = R.route_keyword(questions(spark, d), topics(spark)).select("qid", (F.col("qid") % 300).alias("cell"), "topic")
    return R.answer_plan(routed, spark.createDataFrame(TOPIC_BANDS, "topic string, band string"), X.facts(spark, d))


TOPIC_ALGORITHMS = [("cold", "frost_days"), ("cold", "degree_days"), ("blue", "water_index"), ("metal", "soil_metal"), ("green", "water_index"), ("green", "greenness")]


@query(
    X.with_("facts", extra=f"{QS}, {ROUTE}, {values('tb', 'topic, band', TOPIC_BANDS)}, {values('ta', 'topic, algorithm', TOPIC_ALGORITHMS)}")
    + """, w AS (SELECT DISTINCT qid, qid%300 AS cell, band FROM routed JOIN tb USING (topic)), h AS (SELECT DISTINCT cell, band FROM facts WHERE kind='primary'),
    p AS (SELECT qid, string_agg(w.band, ',' ORDER BY w.band) FILTER (h.cell IS NOT NULL) AS observed, string_agg(w.band, ',' ORDER BY w.band) FILTER (h.cell IS NULL) AS missing FROM w LEFT JOIN h ON h.cell=w.cell AND h.band=w.band GROUP BY qid),
    g AS (SELECT qid, string_agg(DISTINCT algorithm, ',' ORDER BY algorithm) AS algorithms FROM routed JOIN ta USING (topic) GROUP BY qid)
    SELECT qid, coalesce(observed,'') AS observed, coalesce(missing,'') AS missing, coalesce(algorithms,'') AS algorithms FROM p FULL JOIN g USING (qid)"""
)
def i06_plan_algorithms(spark, d):
    routed = R.route_keyword(questions(spark, d), topics(spark)).select("qid", (F.col("qid") % 300).alias("cell"), "topic")
    bands = spark.createDataFrame(TOPIC_BANDS, "topic string, band string")
    return R.answer_plan(routed, bands, X.facts(spark, d), spark.createDataFrame(TOPIC_ALGORITHMS, "topic string, algorithm string"))


#: Real grid cells: every user's point, its cell and its region.
GRID_SQL = f"""pts AS (SELECT DISTINCT user_id AS id, {X.point_sql("user_id")} FROM events), {CELLS}, regions AS (SELECT DISTINCT cell, id % 12 AS region FROM cells),
  gnewest AS (SELECT c.cell, f.band, f.num, f.fact_cid, f.tslot FROM facts f JOIN cells c ON c.id=f.cell WHERE kind='primary' QUALIFY row_number() OVER (PARTITION BY c.cell, f.band ORDER BY f.tslot DESC, f.event_id DESC)=1),
  smp AS (SELECT cell, region, ((cell >> 22) & {LAT_MAX})/{LAT_MAX}.0*180-90 AS lat, (cell & {LNG_MAX})/{LNG_MAX}.0*360-180 AS lng, row_number() OVER (PARTITION BY region ORDER BY md5(CAST(cell AS VARCHAR)), cell) AS sampled FROM regions)"""


def grid_facts(spark, d):
    """Facts whose cells are those of their user's point."""
    return to_cell(X.with_point(X.facts(spark, d), "cell")).drop("lat", "lng")


def grid_regions(spark, d):
    users = X.with_point(X.read(spark, d, "events").select("user_id").distinct(), "user_id")
    return to_cell(users).select("cell", (F.col("user_id") % 12).alias("region")).distinct()


def rounded_centre(df):
    return df.withColumns({"lat": F.round("lat", 9), "lng": F.round("lng", 9)})


@query(
    X.with_("facts", extra=GRID_SQL)
    + """, v AS (SELECT 'surge' AS event, s.region, s.cell, lat, lng, n.num AS value, g.num AS gate_value, n.fact_cid, true AS dn FROM smp s JOIN gnewest n ON n.cell=s.cell AND n.band='purchase' JOIN gnewest g ON g.cell=s.cell AND g.band='click' AND g.num>=20 WHERE sampled<=8
    UNION ALL SELECT 'calm', s.region, s.cell, lat, lng, n.num, NULL, n.fact_cid, false FROM smp s JOIN gnewest n ON n.cell=s.cell AND n.band='view' WHERE sampled<=3),
    r AS (SELECT event, region, cell, round(lat,9) AS lat, round(lng,9) AS lng, value, gate_value, fact_cid, row_number() OVER (PARTITION BY event, region ORDER BY CASE WHEN dn THEN -value ELSE value END, cell) AS rank FROM v QUALIFY rank<=3)
    SELECT *, 'ranked' AS status FROM r UNION ALL SELECT e, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'not_yet_implemented' FROM (VALUES ('oil_slick'), ('tremor')) t(e)"""
)
def h01_hunt(spark, d):
    registry = spark.createDataFrame([("surge", "purchase", "click", ">=", 20.0, True, False), ("calm", "view", None, None, None, False, True), ("oil_slick", None, None, None, None, None, False)], R.EVENT_SCHEMA)
    asked = spark.createDataFrame([("surge",), ("calm",), ("oil_slick",), ("tremor",)], "event string")
    return rounded_centre(R.hunt(R.event_bands(asked, registry), grid_regions(spark, d), grid_facts(spark, d), most=3, sample=8, slow_sample=3))


@query(
    X.with_("facts", extra=GRID_SQL)
    + """, e(event, op, bound) AS (VALUES ('lt','<',40.0), ('le','<=',40.0), ('gt','>',40.0), ('other','~',40.0)), v AS (SELECT event, s.region, s.cell, lat, lng, n.num AS value, g.num AS gate_value, n.fact_cid FROM e CROSS JOIN smp s JOIN gnewest n ON n.cell=s.cell AND n.band='purchase' JOIN gnewest g ON g.cell=s.cell AND g.band='click'
      WHERE sampled<=8 AND CASE op WHEN '<' THEN g.num<bound WHEN '<=' THEN g.num<=bound WHEN '>' THEN g.num>bound ELSE false END)
    SELECT event, region, cell, round(lat,9) AS lat, round(lng,9) AS lng, value, gate_value, fact_cid, 'ranked' AS status, row_number() OVER (PARTITION BY event, region ORDER BY value DESC, cell) AS rank FROM v QUALIFY rank<=3"""
)
def h01_hunt_gates(spark, d):
    rows = [("lt", "purchase", "click", "<", 40.0, True), ("le", "purchase", "click", "<=", 40.0, True), ("gt", "purchase", "click", ">", 40.0, True), ("other", "purchase", "click", "~", 40.0, True)]
    events = spark.createDataFrame(rows, "event string, band string, gate string, gate_op string, gate_min double, descending boolean")
    return rounded_centre(R.hunt(events, grid_regions(spark, d), grid_facts(spark, d), most=3, sample=8))


# the published bands of the named events stand for bands of the test table here
STAND_INS = {"indices.ndvi": "click", "indices.ndwi": "view", "hansen.tree_cover_2000": "purchase", "sentinel1_raw": "signup", "modis.lst_day_8day": "purchase"}
BY_EVENT = [("algal_bloom", "click", "view", ">", 0.0, True), ("deforestation", "click", "purchase", ">=", 30.0, False), ("crop_stress", "click", None, None, None, False), ("urban_heat_island", "purchase", None, None, None, True)]


@query(
    X.with_("facts", extra=GRID_SQL)
    + ", v AS ("
    + " UNION ALL ".join(
        f"SELECT '{event}' AS event, s.region, s.cell, n.num AS value, {'g.num' if gate else 'NULL'} AS gate_value, n.fact_cid, {'-' if down else ''}n.num AS o FROM smp s JOIN gnewest n ON n.cell=s.cell AND n.band='{band}'"
        + (f" JOIN gnewest g ON g.cell=s.cell AND g.band='{gate}' AND g.num{op}{least}" if gate else "")
        + f" WHERE sampled<={8 if event == 'urban_heat_island' else 32}"
        for event, band, gate, op, least, down in BY_EVENT
    )
    + """) SELECT event, region, cell, value, gate_value, fact_cid, row_number() OVER (PARTITION BY event, region ORDER BY o, cell) AS rank, 'ranked' AS status FROM v QUALIFY rank<=8
    UNION ALL SELECT 'oil_slick', NULL, NULL, NULL, NULL, NULL, NULL, 'not_yet_implemented'"""
)
def h01_named_events(spark, d):
    asked = spark.createDataFrame([(e[0],) for e in BY_EVENT] + [("oil_slick",)], "event string")
    names = F.create_map(*[F.lit(x) for kv in STAND_INS.items() for x in kv])
    bands = R.event_bands(asked).withColumns({c: F.when(F.col(c).isNotNull(), names[F.col(c)]) for c in ("band", "gate")})
    return R.hunt(bands, grid_regions(spark, d), grid_facts(spark, d)).drop("lat", "lng")


@query(X.with_("facts", extra=GRID_SQL) + "SELECT region, cell FROM smp WHERE sampled<=8")
def h02_sample_cells(spark, d):
    return R.sample_cells(grid_regions(spark, d), 8).select("region", "cell")


@query(
    X.with_("facts", extra=GRID_SQL)
    + """, v AS (SELECT s.region, s.cell, n.band, row_number() OVER (PARTITION BY s.region, n.band ORDER BY n.num DESC, s.cell) AS rank FROM smp s JOIN gnewest n ON n.cell=s.cell AND n.band IN ('view','click','purchase') WHERE sampled<=8)
    SELECT region, cell, count(*) AS hunts, string_agg(band, ',' ORDER BY band) AS events, min(rank) AS best_rank FROM v WHERE rank<=4 GROUP BY ALL HAVING count(*)>1"""
)
def h03_hotspot_overlap(spark, d):
    rows = [(b, b, None, None, True) for b in ("view", "click", "purchase")]
    events = spark.createDataFrame(rows, "event string, band string, gate string, gate_min double, descending boolean")
    return R.hotspot_overlap(R.hunt(events, grid_regions(spark, d), grid_facts(spark, d), most=4, sample=8))


@query(X.with_("facts", extra=REGION_SQL) + "SELECT region, count(*) AS uncovered FROM regions r WHERE NOT EXISTS (SELECT 1 FROM facts f WHERE f.cell=r.cell AND f.band='error' AND f.tslot>=19740) GROUP BY region")
def h03_uncovered_cells(spark, d):
    seen = X.facts(spark, d).where("band = 'error' and tslot >= 19740").select("cell").distinct()
    return regions(spark, d).join(seen, "cell", "left_anti").groupBy("region").agg(F.count("*").alias("uncovered"))


CID = "sha256(CAST(to_json({'cell': cell, 'band': band, 'tslot': tslot, 'kind': kind}) AS VARCHAR))"


@query(X.with_("facts") + f"SELECT DISTINCT cell, band, tslot, kind, {CID} AS cid FROM facts")
def k01_with_cid(spark, d):
    return K.with_cid(X.facts(spark, d).select("cell", "band", "tslot", "kind"), ["cell", "band", "tslot", "kind"])


def leaves(spark, d):
    li = X.read(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("batch"), F.sha2(F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey"), 256).alias("leaf"))


LEAVES = "leaves AS (SELECT l_orderkey AS batch, sha256(l_orderkey || '|' || l_linenumber || '|' || l_partkey) AS leaf FROM lineitem)"
MERKLE = LEAVES + """, l0 AS (SELECT batch, list_transform(list(leaf ORDER BY leaf), lambda x: sha256(x)) AS v, count(*) AS n FROM leaves GROUP BY batch)""" + "".join(
    f", l{i+1} AS (SELECT batch, n, CASE WHEN len(v)>1 THEN list_transform(range(0,(len(v)+1)//2), lambda i: sha256(v[2*i+1] || coalesce(v[2*i+2], v[2*i+1]))) ELSE v END AS v FROM l{i})" for i in range(6)
)


@query(f"WITH {MERKLE} SELECT batch, v[1] AS root, n FROM l6")
def k02_merkle_roots(spark, d):
    return K.merkle_roots(leaves(spark, d))


@query(f"WITH {MERKLE} SELECT batch, CASE WHEN batch%100=0 THEN 'bad' ELSE v[1] END AS declared, v[1] AS root FROM l6 WHERE batch%100=0")
def k03_audit_batches(spark, d):
    roots = K.merkle_roots(leaves(spark, d))
    declared = roots.select("batch", F.when(F.col("batch") % 100 == 0, "bad").otherwise(F.col("root")).alias("declared"))
    return K.audit_batches(roots, declared)


WAY = "concat_ws(','" + "".join(
    f", CASE WHEN len(l{k}.v)>1 THEN CASE WHEN (p>>{k})%2=0 THEN '>' ELSE '<' END || coalesce(l{k}.v[CAST(xor(p>>{k},1) AS INT)+1], l{k}.v[CAST(p>>{k} AS INT)+1]) END" for k in range(6)
) + ")"


@query(
    f"WITH {MERKLE}, o AS (SELECT batch, leaf, row_number() OVER (PARTITION BY batch ORDER BY leaf)-1 AS p FROM leaves) SELECT batch, leaf, p AS i, {WAY} AS path FROM o "
    + " ".join(f"JOIN l{k} USING (batch)" for k in range(6))
)
def k02_merkle_paths(spark, d):
    way = F.transform("path", lambda s: F.concat(F.when(s["right"], ">").otherwise("<"), s["hash"]))
    return K.merkle_paths(leaves(spark, d)).select("batch", "leaf", "i", F.array_join(way, ",").alias("path"))


@query(f"WITH {MERKLE} SELECT batch, n, CASE WHEN batch%100=0 THEN 0 ELSE n END AS n_ok FROM l6")
def k03_audit_proofs(spark, d):
    roots = K.merkle_roots(leaves(spark, d))
    declared = roots.select("batch", F.when(F.col("batch") % 100 == 0, "bad").otherwise(F.col("root")).alias("declared"))
    return K.audit_proofs(K.merkle_paths(leaves(spark, d)), declared)


@query(
    """WITH r AS (SELECT o_custkey AS segment, o_orderkey AS pos, sha256(CAST(o_orderkey AS VARCHAR)) AS hash FROM orders), g AS (SELECT segment, sha256(string_agg(hash,'' ORDER BY pos, hash)) AS f, count(*) AS n FROM r GROUP BY segment)
    SELECT segment, n, segment%10<>0 AS ok FROM g"""
)
def k04_audit_segments(spark, d):
    o = X.read(spark, d, "orders")
    r = o.select(F.col("o_custkey").alias("segment"), F.col("o_orderkey").alias("pos"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("hash"))
    trailer = r.groupBy("segment").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "hash"))), lambda x: x["hash"]), ""), 256).alias("t"))
    return K.audit_segments(r, trailer.select("segment", F.when(F.col("segment") % 10 == 0, "bad").otherwise(F.col("t")).alias("trailer")))


@query(X.with_("facts", "latest") + "SELECT cell, band, tslot, num, fact_cid FROM latest")
def j01_ingest_stream(spark, d):
    s = J.fact_stream(spark, d, "events.parquet")
    return J.ingest(s, scratch(spark), scratch(spark)).select("cell", "band", "tslot", "num", "fact_cid")


@query("SELECT time_bucket(INTERVAL 300 SECONDS, ts) AS start, count(*) AS facts FROM events GROUP BY 1")
def j02_corpus_ticks(spark, d):
    t = J.corpus_ticks(J.fact_stream(spark, d, "events.parquet"), 300)
    return J.finish_counts(t, scratch(spark), scratch(spark), ["start"]).select(F.col("start").cast("timestamp_ntz").alias("start"), "facts")


@query("WITH w AS (SELECT date_trunc('hour', ts) + INTERVAL 1 HOUR * unnest(range(1,25)) AS \"end\", value FROM events) SELECT \"end\", count(*) AS n, max(value) AS largest FROM w GROUP BY 1")
def j03_fire_stream(spark, d):
    w = J.fire_windows(J.fact_stream(spark, d, "events.parquet"))
    return J.finish_counts(w, scratch(spark), scratch(spark), ["end"]).select(F.col("end").cast("timestamp_ntz").alias("end"), "n", "largest")


@query(
    """WITH b AS (SELECT time_bucket(INTERVAL 300 SECONDS, ts) AS start, event_type AS band, count(*) AS facts FROM events GROUP BY ALL)
    SELECT start, band, facts, rank FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY facts DESC, band) AS rank FROM b) WHERE rank<=3"""
)
def j02_top_bands(spark, d):
    t = J.band_ticks(J.fact_stream(spark, d, "events.parquet"), 300)
    told = J.finish_counts(t, scratch(spark), scratch(spark), ["start", "band"])
    return J.top_bands(told, 3).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT time_bucket(INTERVAL 300 SECONDS, ts) AS start, count(*) AS facts, count(DISTINCT user_id) AS cells FROM events GROUP BY 1")
def j02_exact_ticks(spark, d):
    f = X.facts(spark, d).withColumn("signed_at", F.col("signed_at").cast("timestamp"))
    return J.exact_ticks(f, 300).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT event_id, CASE WHEN late THEN 'absence' ELSE 'primary' END AS kind, CASE WHEN late THEN 'outside_window' END AS reason, CASE WHEN NOT late THEN value END AS num FROM (SELECT *, ts < (SELECT max(ts) FROM events) - INTERVAL 24 HOURS AS late FROM events)")
def j03_late_fires(spark, d):
    rows = J.fire_rows(J.fact_stream(spark, d, "events.parquet"), scratch(spark), scratch(spark))
    return rows.select("event_id", "kind", "reason", "num")


@query("SELECT user_id%7 AS signer, count(*) AS citations, max(ts) AS last_cited FROM events GROUP BY 1")
def j04_citation_counts(spark, d):
    c = J.citation_counts(J.fact_stream(spark, d, "events.parquet"))
    return J.finish_counts(c, scratch(spark), scratch(spark), ["signer"]).withColumn("last_cited", F.col("last_cited").cast("timestamp_ntz"))


@query("SELECT event_id, old, value AS new, round(value-old,6) AS delta FROM (SELECT *, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS old FROM events) WHERE old IS NOT NULL")
def j05_change_feed(spark, d):
    c = J.run_change_feed(J.fact_stream(spark, d, "events.parquet"), scratch(spark), scratch(spark))
    return c.withColumn("delta", F.round("delta", 6))


@query(
    """SELECT event_id%1000 AS pixel, count(*) AS n, max(CASE user_id%3 WHEN 0 THEN least(100, user_id) WHEN 1 THEN 20 ELSE 90 END)::INT AS confidence, CAST(max(floor(epoch(date_trunc('minute', ts)))) AS BIGINT) AS last FROM events GROUP BY 1"""
)
def a03_read_fires(spark, d):
    e = X.read(spark, d, "events")
    k = F.col("user_id")
    conf = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, "l").otherwise("h")
    rows = e.select(
        (F.col("event_id") % 1000).alias("pixel"), F.lit(300.5).alias("bright_ti4"), F.date_format("ts", "yyyy-MM-dd").alias("acq_date"),
        (F.hour("ts") * 100 + F.minute("ts")).cast("string").alias("acq_time"), conf.alias("confidence"), F.col("value").alias("frp"),
    )
    path = scratch(spark)
    rows.write.option("header", True).csv(path)
    f = G.read_fires(spark, path, "viirs")
    return f.groupBy("pixel").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"), F.max("acquired").alias("last"))


@query(X.with_("monthly") + "SELECT key, count(*) AS n, round(sum(num*0.1+5),4) AS total FROM monthly WHERE num<>500 GROUP BY key")
def a04_unpack_series(spark, d):
    m = X.monthly(spark, d).select("key", F.col("num").alias("stored"))
    u = G.unpack_series(m, "stored", 0.1, 5.0, 500.0)
    return u.groupBy("key").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT DISTINCT p_partkey AS id, trim(regexp_replace(lower(unnest([p_name, p_type, p_brand])), '[^a-z0-9]+', ' ', 'g')) AS key FROM part")
def a05_gazetteer_keys(spark, d):
    p = X.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("asciiname"), F.col("p_brand").alias("alternates"))
    return G.gazetteer_keys(p)


def theme(spark, d):
    o = X.with_point(X.read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey")
    box = F.struct((F.col("lng") - 5).alias("xmin"), (F.col("lng") + 5).alias("xmax"), (F.col("lat") - 5).alias("ymin"), (F.col("lat") + 5).alias("ymax"))
    return o.select(F.col("o_orderkey").alias("id"), box.alias("bbox"), F.col("o_orderdate").alias("datetime"), (F.col("o_orderkey") % 100).alias("cloud"))


THEME = f"th AS (SELECT o_orderkey AS id, o_orderdate AS datetime, o_orderkey%100 AS cloud, {X.point_sql('o_custkey')} FROM orders)"


@query(f"WITH {THEME} SELECT id, datetime FROM th WHERE lng-5<=20 AND lng+5>=-20 AND lat-5<=10 AND lat+5>=-10")
def a06_read_theme(spark, d):
    path = scratch(spark)
    theme(spark, d).write.parquet(path)
    return G.read_theme(spark, path, (-20.0, -10.0, 20.0, 10.0), ["id", "datetime"])


@query(
    f"""WITH {THEME}, p AS (SELECT s_suppkey AS pid, {X.point_sql("s_suppkey").replace(" AS lat", " AS plat").replace(" AS lng", " AS plng")} FROM supplier)
    SELECT pid, id AS scene FROM p JOIN th ON plng BETWEEN lng-5 AND lng+5 AND plat BETWEEN lat-5 AND lat+5 WHERE cloud<30 QUALIFY row_number() OVER (PARTITION BY pid ORDER BY datetime DESC, id DESC)=1"""
)
def a08_pick_scene(spark, d):
    p = X.with_point(X.read(spark, d, "supplier").select(F.col("s_suppkey").alias("pid")), "pid")
    return G.pick_scene(p, theme(spark, d), 30)


@query("SELECT qid, id, population FROM (SELECT c_custkey AS qid, b.p_partkey AS id, b.p_size*1000+b.p_partkey AS population, row_number() OVER (PARTITION BY c_custkey ORDER BY b.p_size*1000+b.p_partkey DESC, b.p_partkey) AS rn FROM customer JOIN part a ON a.p_partkey=c_custkey JOIN part b ON lower(b.p_name)=lower(a.p_name)) WHERE rn<=3")
def e03_lookup_places(spark, d):
    p = X.read(spark, d, "part")
    asked = p.select(F.col("p_partkey").alias("c_custkey"), F.col("p_name").alias("query"))
    q = X.read(spark, d, "customer").join(asked, "c_custkey").select(F.col("c_custkey").alias("qid"), "query")
    places = p.select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("key"), (F.col("p_size") * 1000 + F.col("p_partkey")).alias("population"))
    return G.lookup_places(q, places, 3).select("qid", "id", "population")
