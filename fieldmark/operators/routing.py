"""Routing of question tables to topics, intents and answer plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from .grid import with_center
from .tables import small_side, top_k


def route_keyword(questions: DataFrame, topics: DataFrame, most: int = 5) -> DataFrame:
    """(qid, topic, score): topics with an alias inside the lower-cased text; the score is the longest
    alias's share of the text's bytes. ``topics``: (topic, alias), a registry of a few hundred rows."""
    q = questions.select("qid", F.lower("text").alias("t"))
    hit = q.join(small_side(topics), F.contains("t", "alias"))
    s = hit.groupBy("qid", "topic").agg(F.max(F.octet_length("alias") / F.octet_length("t")).alias("score"))
    return top_k(s, ["qid"], [F.desc("score"), F.col("topic")], most)


def any_of(text: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in phrases])


# Phrases of questions that are out of scope.
OUT_OF_SCOPE = (
    "who won", "election", "elections", "who is the president", "current president", "current prime minister", "world cup", "super bowl",
    "olympic medal", "meaning of life", "what's the meaning", "tell me a joke", "write a poem", "are you sentient", "are you conscious",
    "stock price", "stock market", "share price", "crypto price", "bitcoin price", "ethereum price", "nasdaq", "what should i eat",
    "recipe for", "how do i lose weight", "ignore previous", "system prompt", "you are now",
)


def in_scope(questions: DataFrame, denied: tuple[str, ...] = OUT_OF_SCOPE) -> DataFrame:
    """Whether a question has text and none of the denied phrases."""
    t = F.lower(F.btrim("text"))
    return questions.select("qid", F.coalesce((F.length(t) > 0) & ~any_of(t, denied), F.lit(False)).alias("in_scope"))


def topic_centroids(alias_vecs: DataFrame) -> DataFrame:
    """Unit mean vector per topic, from (topic, vec)."""
    m = alias_vecs.select("topic", F.posexplode("vec").alias("i", "x")).groupBy("topic", "i").agg(F.avg("x").alias("m"))
    g = m.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    norm = F.sqrt(F.aggregate("c", F.lit(0.0), lambda a, x: a + x * x))
    return g.withColumn("norm", norm).select("topic", F.transform("c", lambda x: x / F.col("norm")).alias("centre"))


def route_embedding(question_vecs: DataFrame, alias_vecs: DataFrame, keyword: DataFrame, floor: float = 0.35, most: int = 5) -> DataFrame:
    """Keyword hits first, then topics whose centroid has cosine >= ``floor``; most of them in all."""
    from .vectors import cosine

    s = question_vecs.join(F.broadcast(topic_centroids(alias_vecs)), how="cross").select("qid", "topic", F.round(cosine(F.col("vec"), F.col("centre")), 9).alias("score"))
    near = s.where(F.col("score") >= floor).join(keyword.select("qid", "topic"), ["qid", "topic"], "left_anti")
    u = keyword.select("qid", "topic", "score", F.lit(0).alias("src")).union(near.select("qid", "topic", "score", F.lit(1)))
    return top_k(u, ["qid"], [F.col("src"), F.desc("score"), F.col("topic")], most)


# Cue phrases of question intents.
INTENTS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("similarity", (
        "find places like", "places like", "similar to", "looks like", "where else", "analog of", "analogue of", "look-alike", "lookalike",
        "comparable to", "find similar", "what's similar", "what is similar",
    )),
    ("change", (
        "what changed", "what has changed", "year over year", "year-over-year", "since last year", "in the last year", "deforestation",
        "deforested", "forest loss", "new construction", "urban expansion", "wetland change", "coastline change", "coastal erosion",
        "shoreline retreat",
    )),
)
# Phrases of questions about the corpus itself.
FRESHNESS = (
    "how fresh", "data freshness", "last attested", "last signed", "when did you last", "how recent", "how stale", "how up to date",
    "how up-to-date",
)
CORPUS_WORDS = (
    "your corpus", "your coverage", "your data", "your facts", "your cells", "your attestations", "attested cells", "signed facts",
    "fact coverage", "coverage",
)
CORPUS_PREPOSITIONS = (" over ", " in ", " across ", " for ", " inside ", " within ")
GLOBAL_COVERAGE = (
    "where do you have", "where you have", "global coverage", "global coverage map", "world coverage", "world-wide coverage", "worldwide coverage",
    "coverage map", "show me your coverage", "show me the coverage", "what cells do you have", "what cells are attested", "all the cells",
    "every cell you have", "how much data do you have", "how dense is the corpus", "how dense is data",
)
# Verbs, prepositions and time phrases of event hunts, and the kinds of event with the
# phrases that name them and those that rule them out.
HUNT_VERBS = ("find ", "show me ", "where is ", "where are ", "where has", "where have", "where do ", "spot ", "identify ", "locate ", "hunt ", "any ", "list ")
HUNT_PREPOSITIONS = (" in ", " over ", " across ", " throughout ", " around ", " near ")
PAST = ("last year", "in the last", "since")
EVENTS: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = (
    ("algal_bloom", ("algal bloom", "algae bloom", "harmful bloom", "cyanobacteria", "chlorophyll bloom"), ()),
    ("oil_slick", ("oil spill", "oil slick"), ()),
    ("methane_plume", ("methane plume", "methane leak", "methane emission", "ghg leak", "super-emitter"), ()),
    ("deforestation", ("deforestation", "forest loss", "forest clearing", "tree loss", "logging"), ()),
    ("wildfire", ("burn scar", "burned area", "wildfire", "forest fire", "bushfire", "burn severity", "fire-affected"), ("wildfire risk", "fire risk")),
    ("urban_heat_island", ("urban heat", "heat island"), ("heat risk", "uhi risk")),
    ("landslide", ("landslide", "mudslide", "debris flow", "slope failure"), ()),
    ("flood", ("flood extent", "inundation", "flooded fields", "flooded area", "flood-affected", "flood damage"), ()),
    ("flood", ("flood",), ("flood risk",)),
    ("drought", ("drought", "dry spell", "rainfall deficit"), ("drought risk",)),
    ("soil_salinity", ("salinity", "salinized soil"), ()),
    ("crop_stress", ("crop stress", "stressed crops", "crop damage", "yellowing crops"), ("crop stress risk", "crop risk")),
    ("water_turbidity", ("turbidity", "sediment plume", "muddy water"), ()),
)


def question_intent(text: Column) -> Column:
    """Similarity or change, else recall."""
    kind: Column = F.lit("recall")
    for name, cues in reversed(INTENTS):
        kind = F.when(any_of(text, cues), name).otherwise(kind)
    return kind


def corpus_audit(text: Column) -> Column:
    """What a question asks of the corpus itself: freshness before density in a region before coverage of
    the world; null for other questions."""
    about = any_of(text, CORPUS_WORDS)
    return (
        F.when(any_of(text, FRESHNESS), "freshness").when(about & any_of(text, CORPUS_PREPOSITIONS), "regional_density")
        .when(about | any_of(text, GLOBAL_COVERAGE), "global_coverage")
    )


def event_kind(text: Column) -> Column:
    """Kind of event that a question hunts for: it needs a verb, or a place and no time of the past; null
    for other questions."""
    kind: Column = F.lit(None).cast("string")
    for name, cues, unless in reversed(EVENTS):
        named = any_of(text, cues) & ~any_of(text, unless) if unless else any_of(text, cues)
        kind = F.when(named, name).otherwise(kind)
    return F.when(any_of(text, HUNT_VERBS) | (any_of(text, HUNT_PREPOSITIONS) & ~any_of(text, PAST)), kind)


def classify_questions(questions: DataFrame) -> DataFrame:
    """(qid, intent, audit, event) of questions; a null text is a recall."""
    t = F.lower("text")
    return questions.select("qid", question_intent(t).alias("intent"), corpus_audit(t).alias("audit"), event_kind(t).alias("event"))


# Prepositions that introduce a place.
PREPOSITIONS = (" in ", " near ", " around ", " over ", " across ", " at ", " within ")


def region_anchor(questions: DataFrame, most_bytes: int = 80) -> DataFrame:
    """Text after the right-most preposition, without closing punctuation, up to ``most_bytes`` long."""
    t = F.concat(F.lit(" "), F.col("text"), F.lit(" "))
    back = F.reverse(F.lower(t))
    # the right-most match is the first in the reversed text
    at = F.least(*[F.nullif(F.instr(back, p[::-1]), F.lit(0)) for p in PREPOSITIONS])
    tail = F.rtrim(F.regexp_replace(F.btrim(F.substring(t, F.length(t) - at + 2, F.length(t))), r"[?.!,;: ]+$", ""))
    ok = (F.octet_length(tail) > 0) & (F.octet_length(tail) <= most_bytes)
    return questions.select("qid", F.when(at.isNotNull() & ok, tail).alias("anchor"))


def answer_plan(routed: DataFrame, topic_bands: DataFrame, facts: DataFrame, topic_algorithms: DataFrame | None = None) -> DataFrame:
    """Observed and missing bands of every routed question; ``routed``: (qid, cell, topic),
    ``topic_bands``: (topic, band). With ``topic_algorithms``, (topic, algorithm), also the algorithms of
    its topics; both registries hold a few rows per topic."""
    want = routed.join(small_side(topic_bands), "topic").select("qid", "cell", "band").distinct()
    have = facts.where("kind = 'primary'").select("cell", "band", F.lit(True).alias("hit")).distinct()
    j = want.join(have, ["cell", "band"], "left")
    plan = j.groupBy("qid").agg(
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("hit"), F.col("band")))), ",").alias("observed"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("hit").isNull(), F.col("band")))), ",").alias("missing"),
    )
    if topic_algorithms is None:
        return plan
    ways = routed.join(small_side(topic_algorithms), "topic").groupBy("qid").agg(F.array_join(F.array_sort(F.collect_set("algorithm")), ",").alias("algorithms"))
    return plan.join(ways, "qid", "full").select("qid", *[F.coalesce(c, F.lit("")).alias(c) for c in ("observed", "missing", "algorithms")])


def _gate(op: Column, value: Column, bound: Column) -> Column:
    tests = {">=": value >= bound, ">": value > bound, "<=": value <= bound, "<": value < bound, "=": value == bound}
    out = F.lit(False)
    for name, ok in tests.items():
        out = F.when(op == name, ok).otherwise(out)
    return out


# Bands that an event is hunted with: the ranked band, a gate band with its test, whether
# large values come first, and whether the band is slow to read. Directions and gates that are not
# published are choices made here; an oil slick has no bands yet.
EVENT_BANDS: tuple[tuple[str, str | None, str | None, str | None, float | None, bool | None, bool], ...] = (
    ("algal_bloom", "indices.ndvi", "indices.ndwi", ">", 0.0, True, False),
    ("deforestation", "indices.ndvi", "hansen.tree_cover_2000", ">=", 30.0, False, False),
    ("flood", "sentinel1_raw", None, None, None, False, False),
    ("wildfire", "indices.nbr", None, None, None, False, False),
    ("urban_heat_island", "modis.lst_day_8day", None, None, None, True, True),
    ("methane_plume", "s2.B11", None, None, None, True, False),
    ("landslide", "sentinel1_raw", None, None, None, False, False),
    ("drought", "chirps.precip_monthly", None, None, None, False, False),
    ("soil_salinity", "s2.B04", None, None, None, True, False),
    ("crop_stress", "indices.ndvi", None, None, None, False, False),
    ("water_turbidity", "s2.B04", "indices.ndwi", ">", 0.0, True, False),
    ("oil_slick", None, None, None, None, None, False),
)
EVENT_SCHEMA = "event string, band string, gate string, gate_op string, gate_min double, descending boolean, slow boolean"


def event_bands(asked: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Bands of every event in ``asked`` (event), by a registry of EVENT_SCHEMA; null bands for an event
    that it lacks."""
    known = asked.sparkSession.createDataFrame(list(EVENT_BANDS), EVENT_SCHEMA) if registry is None else registry
    return asked.select("event").distinct().join(small_side(known), "event", "left")


def hunt(events: DataFrame, cells: DataFrame, facts: DataFrame, most: int = 8, sample: int = 32, slow_sample: int = 8) -> DataFrame:
    """Top cells of every (event, region) with their centre, value, gate value and fact id: at most
    ``sample`` cells per region in hash order (``slow_sample`` for slow bands), the newest primary value of
    the event's band, an optional gate band, ranked up or down. ``events`` has EVENT_SCHEMA, of which
    gate_op (default ``>=``) and slow (default false) may be missing; a gate operator other than ``>=``,
    ``>``, ``<=``, ``<`` and ``=`` lets nothing through. An event without a band gives one row of status
    ``not_yet_implemented``."""
    from .lookup import pick_slot

    chosen = sample_cells(cells, max(sample, slow_sample))
    newest = pick_slot(facts, carry=("fact_cid",))
    for name, value in (("gate_op", ">="), ("slow", False)):
        events = events if name in events.columns else events.withColumn(name, F.lit(value))
    e = small_side(events.where("band is not null"))
    values = newest.select("cell", "band", F.col("num").alias("value"), "fact_cid")
    v = chosen.join(values, "cell").join(e, "band").where(F.col("sampled") <= F.when(F.coalesce("slow", F.lit(False)), slow_sample).otherwise(sample))
    g = newest.select("cell", F.col("band").alias("gate"), F.col("num").alias("gate_value"))
    j = v.join(g, ["cell", "gate"], "left").where(F.col("gate").isNull() | _gate(F.col("gate_op"), F.col("gate_value"), F.col("gate_min")))
    order = F.when(F.col("descending"), -F.col("value")).otherwise(F.col("value"))
    ranked = with_center(top_k(j, ["event", "region"], [order.asc_nulls_last(), F.col("cell")], most))
    columns = ["event", "region", "rank", "cell", "lat", "lng", "value", "gate_value", "fact_cid"]
    told = ranked.select(*columns, F.lit("ranked").alias("status"))
    kind = dict(told.dtypes)
    unknown = events.where("band is null").select("event", *[F.lit(None).cast(kind[c]).alias(c) for c in columns[1:]], F.lit("not_yet_implemented").alias("status"))
    return told.unionByName(unknown.distinct())


def sample_cells(cells: DataFrame, n: int) -> DataFrame:
    """At most n cells per region in the fixed pseudo-random order of a hash of the cell's number, with
    their place in it (``sampled``)."""
    return top_k(cells, ["region"], [F.md5(F.col("cell").cast("string").cast("binary")), F.col("cell")], n, "sampled")


def hotspot_overlap(hunts: DataFrame, least: int = 2) -> DataFrame:
    """Cells of a region that are ranked in ``least`` hunts or more: how many, which, and the best rank."""
    g = hunts.groupBy("region", "cell").agg(
        F.count_distinct("event").alias("hunts"), F.array_join(F.array_sort(F.collect_set("event")), ",").alias("events"), F.min("rank").alias("best_rank")
    )
    return g.where(F.col("hunts") >= least)
