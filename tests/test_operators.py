"""Fixed numbers and invariants of single operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmark.operators import aggregate, formula, grid, lookup, routing, spatial, vectors
from fieldmark.sources import ingest
from fieldmark.streaming import jobs


def one(df):
    return df.collect()[0]


def test_flood_risk_sample(spark):
    df = spark.createDataFrame([(40.0, 30.0, 28.0, -18.0)], "swr double, cop double, gmrt double, s1 double")
    assert one(formula.evaluate(df, {"r": formula.RECIPES["flood_risk"]}, []))["r"] == pytest.approx(0.4836, abs=0.005)


def test_missing_and_undefined_inputs_are_null(spark):
    df = spark.createDataFrame([(None, -1.0)], "a double, b double")
    out = one(formula.evaluate(df, {"x": ["add", ["band", "a"], 1], "y": ["sqrt", ["band", "b"]], "z": ["div", 1, 0], "w": ["max", ["band", "a"], 3]}, []))
    assert [out[c] for c in "xyzw"] == [None] * 4
    assert out["x_skip"] == "missing_input:a" and out["y_skip"] is None


def test_precipitation_classes(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.1, 1.0, 5.0, 10.0, 60.0)], "precip double")
    assert [r["p"] for r in formula.evaluate(df, {"p": formula.RECIPES["precipitation"]}, []).collect()] == [0, 1, 2, 3, 4, 5]


def test_hilbert_neighbours_are_adjacent(spark):
    n = 16
    df = spark.range(n * n).select(F.expr(f"id div {n}").alias("r"), (F.col("id") % n).alias("c"))
    rows = df.select("r", "c", grid.hilbert_key(F.col("r"), F.col("c"), 4).alias("k")).collect()
    path = sorted((x["k"], x["r"], x["c"]) for x in rows)
    assert [p[0] for p in path] == list(range(n * n))
    assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(path, path[1:], strict=False))


def test_cell_round_trip_and_canonical_edges(spark):
    pts = [(48.85, 2.35), (-33.9, 151.2), (90.0, 10.0), (90.0, 20.0), (0.0, 180.0), (0.0, -180.0), (float("nan"), 0.0)]
    rows = grid.with_center(grid.to_cell(spark.createDataFrame(pts, "lat double, lng double")).withColumnsRenamed({"lat": "a", "lng": "b"})).collect()
    for r in rows[:2]:
        assert abs(r["lat"] - r["a"]) < 1e-4 and abs(r["lng"] - r["b"]) < 1e-4
    assert rows[2]["cell"] == rows[3]["cell"] and rows[4]["cell"] == rows[5]["cell"]
    assert all(r["cell"] > 0 for r in rows)


def test_nearest_rank_rounds_half_up(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(6)], "k string, v double")
    assert one(aggregate.nearest_rank(df, ["k"], "v", 0.9, "p"))["p"] == 5.0


def test_polygon_holes_and_parts(spark):
    ring = lambda pts: [(float(x), float(y)) for x, y in pts]
    polys = spark.createDataFrame(
        [("h", [ring([(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]), ring([(4, 4), (6, 4), (6, 6), (4, 6), (4, 4)])])],
        "poly_id string, rings array<array<struct<lng:double,lat:double>>>",
    )
    pts = spark.createDataFrame([(1, 5.0, 5.0), (2, 1.0, 1.0), (3, 11.0, 1.0)], "id long, lng double, lat double")
    assert [r["id"] for r in spatial.points_in_polygons(pts, polys).collect()] == [2]


def test_rotation_is_orthogonal():
    r = vectors.rotation(64)
    assert np.abs(r @ r.T - np.eye(64)).max() < 1e-4


def test_negated_vector_is_at_full_distance(spark):
    v = np.random.default_rng(0).standard_normal(100)
    df = spark.createDataFrame([(1, 0, v.tolist()), (2, 0, (-v).tolist()), (3, 0, v[:64].tolist()), (4, 0, None), (5, 0, [])], "cell long, tslot long, vec array<double>")
    bits = vectors.pack_bits(df)
    q = bits.where("cell = 1").withColumnRenamed("cell", "q")
    r = one(vectors.find_similar_hamming(q, bits, 5))
    assert (r["cell"], r["d"], r["score"]) == (2, 100, -1.0)


def test_sketches_read_every_component(spark):
    df = spark.createDataFrame([(1, 0, [1.0] * 65), (2, 0, [1.0] * 64 + [-1.0])], "cell long, tslot long, vec array<double>")
    a, b = (r["bits"] for r in vectors.pack_bits(df).orderBy("cell").collect())
    assert a == [-1, -(2**63)] and b == [-1, 0]


def test_many_queries_give_what_few_do(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, t, rng.standard_normal(8).tolist()) for i in range(40) for t in (0, 1)]
    rows += [(50, 0, None), (51, 0, [float("nan")] * 8), (52, 0, [0.0] * 8), (53, 0, rows[0][2][:3]), (54, 0, [None] + rows[1][2][1:]), (55, 0, rows[2][2] + [1.0])]
    df = spark.createDataFrame(rows, "cell long, tslot long, vec array<double>")
    q = vectors.pick_vector(df, "oldest")
    bits = vectors.pack_bits(df)
    asked = bits.where("tslot = 0").withColumnRenamed("cell", "q")

    def found():
        near = vectors.find_similar(q, df, 6).collect() + vectors.find_similar_hamming(asked, bits, 6).select("q", "cell", "score", "rank").collect()
        return sorted((r["q"], r["cell"], round(r["score"], 9), r["rank"]) for r in near)

    few = found()
    from fieldmark.operators import nearest

    monkeypatch.setattr(nearest.nearest, "__defaults__", (0,))
    monkeypatch.setattr(nearest, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 20)
    monkeypatch.setattr(nearest, "ROWS_OF_PIVOT", 9)
    assert found() == few
    y = {i: np.array(v, dtype=float) for i, t, v in rows if v is not None and t == 0}
    cos = {}
    for i, t, v in rows:
        if i != 3 and v is not None and not np.isnan(np.array(v, dtype=float)).any():
            n = min(len(y[3]), len(v))
            norm = np.linalg.norm(y[3]) * np.linalg.norm(v)
            s = float(np.dot(y[3][:n], v[:n]) / norm) if norm else 0.0
            cos[i] = max(cos.get(i, -2), s)
    want = sorted(cos, key=lambda i: (-round(cos[i], 9), i))[:6]
    assert [r["cell"] for r in vectors.find_similar(q.where("cell = 3"), df, 6).orderBy("rank").collect()] == want


def test_content_ids_tell_rows_apart(spark):
    from fieldmark.operators import integrity

    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "x"), ("", "x")], "p string, q string")
    assert integrity.with_cid(df, ["p", "q"]).count() == 4


def test_merkle_trees_of_more_than_a_run(spark, monkeypatch):
    import hashlib

    from fieldmark.operators import integrity

    monkeypatch.setattr(integrity, "RUN", 8)
    monkeypatch.setattr(integrity, "LEVELS", 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    sizes = {1: 1, 2: 2, 3: 7, 4: 8, 5: 9, 6: 17, 7: 64, 8: 65, 9: 100}
    rows = [(b, sha(f"{b}/{i}")) for b, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "batch long, leaf string")
    want = {}
    for b in sizes:
        level = [sha(x) for x in sorted(x for c, x in rows if c == b)]
        while len(level) > 1:
            level = [sha(level[i] + level[min(i + 1, len(level) - 1)]) for i in range(0, len(level), 2)]
        want[b] = level[0]
    roots = integrity.merkle_roots(df)
    assert {r["batch"]: r["root"] for r in roots.collect()} == want
    declared = roots.select("batch", F.col("root").alias("declared"))
    assert {(r["n"], r["n_ok"]) for r in integrity.audit_proofs(integrity.merkle_paths(df), declared).collect()} == {(n, n) for n in sizes.values()}


def test_medians_skip_nan_and_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("a", 4.0), ("a", float("nan")), ("a", None), ("a", 9.0), ("b", 2.0), ("b", 3.0), ("c", None)], "k string, v double")
    assert {r["k"]: r["median"] for r in aggregate.counted_median(df, ["k"], "v").collect()} == {"a": 4.0, "b": 2.5}


def test_privacy_coarsens_and_refuses(spark):
    df = grid.to_cell(spark.createDataFrame([("p", 48.85, 2.35), ("x", 48.85, 2.35), ("o", 48.85, 2.35)], "band string, lat double, lng double"))
    bands = spark.createDataFrame([("p", "aggregate_only", 10), ("x", "prohibited", 0), ("o", "public", 0)], "band string, privacy string, min_level int")
    got = {r["band"]: r["cell"] for r in lookup.enforce_privacy(df, bands, 4).collect()}
    fine = one(df)["cell"]
    assert set(got) == {"p", "o"} and got["o"] == fine and got["p"] != fine
    assert got["p"] == one(grid.coarsen(df.withColumn("num", F.lit(1.0)), [10]))["parent"]


def test_claims_on_missing_and_nan_values(spark):
    facts = spark.createDataFrame(
        [(1, "a", 1, 2.0, "primary", "x"), (1, "a", 2, float("nan"), "primary", "y"), (1, "b", 1, None, "absence", "z"), (1, "c", 1, 1.0, "derivative", "w")],
        "cell long, band string, tslot long, num double, kind string, fact_cid string",
    )
    cols = "claim_id long, cell long, band string, op string, value double, vals array<double>, tslot long, win_lo long, win_hi long, agg string"
    claims = [
        (1, 1, "a", "eq", 2.0, None, None, None, None, "max"),
        (2, 1, "a", "lt", 5.0, None, 2, None, None, "any"),
        (3, 1, "b", "absent", None, None, None, None, None, "any"),
        (4, 1, "c", "exists", None, None, None, None, None, "any"),
        (5, 1, "a", "in", None, [2.0], 1, None, None, "any"),
        (6, 1, "a", "ge", 2.0, None, None, None, None, "all"),
    ]
    got = {r["claim_id"]: r["verdict"] for r in lookup.verify(spark.createDataFrame(claims, cols), facts).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True, 6: False}


def test_diffusion_closed_form_equals_steps(spark):
    px = spark.createDataFrame([(r, c, float(r * 3 + c * c)) for r in range(3) for c in range(3)], "row long, col long, value double")
    got = {(r["row"], r["col"]): r["value"] for r in aggregate.relax_stencil(px, 0.2, 4).collect()}
    u, s = 4.0, sum(v for v in (1.0, 3.0, 7.0, 7.0))
    for _ in range(4):
        u += 0.2 * (s - 4 * u)
    assert math.isclose(got[(1, 1)], u)


def test_cell_text(spark):
    older_grid = (1 << 60) | (12 << 52) | (0xAB << 44)
    cells = [0, 44099, 44100, 65535, older_grid, grid.CELL_PREFIX + 123456789, (1 << 63) - 1, -1]
    df = spark.createDataFrame([(c,) for c in cells], "cell long").withColumn("text", grid.cell_text(F.col("cell")))
    rows = df.withColumn("back", grid.cell_of_text(F.col("text"))).collect()
    assert [r["back"] for r in rows] == cells
    assert rows[0]["text"] == "baba.baba.baba.baba" and rows[1]["text"].endswith(".zUzU") and rows[2]["text"].endswith(".zac44")
    assert rows[4]["text"].startswith("damO.zb000.") and rows[5]["text"].startswith("defi.zb000.")
    bad = spark.createDataFrame([("baba.baba.baba",), ("baba.baba.baba.zzzz",), ("baba.baba.baba.z0000",), ("",), (None,)], "t string")
    assert {r["c"] for r in bad.select(grid.cell_of_text(F.col("t")).alias("c")).collect()} == {None}


def test_tiles_of_edges(spark):
    df = spark.createDataFrame([(42.0, -93.4), (-0.5, 0.0), (0.0, -0.1), (-42.0, 170.0)], "lat double, lng double")
    got = df.select(grid.corner_tile(F.col("lat"), F.col("lng")).alias("a"), grid.corner_tile(F.col("lat"), F.col("lng"), padded=False).alias("b")).collect()
    assert [tuple(r) for r in got] == [("50N_100W", "50N_100W"), ("00N_000E", "0N_0E"), ("00N_010W", "0N_10W"), ("40S_170E", "40S_170E")]


def test_resize(spark):
    px = spark.createDataFrame([(r, c, float(10 * r + c)) for r in range(3) for c in range(3)], "row long, col long, value double")
    same = {(r["row"], r["col"]): r["value"] for r in aggregate.resize(px, (3, 3), (3, 3)).collect()}
    assert same == {(r, c): 10.0 * r + c for r in range(3) for c in range(3)}
    half = {(r["row"], r["col"]): r["value"] for r in aggregate.resize(px, (3, 3), (5, 2)).collect()}
    assert half == {(r, c): pytest.approx(5.0 * r + 2 * c) for r in range(5) for c in range(2)}
    holed = aggregate.resize(px.where("row <> 0"), (3, 3), (2, 2)).collect()
    assert {(r["row"], r["value"] is None) for r in holed} == {(0, True), (1, False)}
    assert {(r["row"], r["col"]): r["value"] for r in aggregate.resize(px, (3, 3), (1, 1)).collect()} == {(0, 0): 0.0}


def test_late_fires_follow_the_newest_of_all_triggers(spark, tmp_path):
    hours = [(0, 0), (1, 30), (2, 10), (3, 5), (4, 40), (5, 15), (6, None)]
    for i in range(0, 7, 2):
        part = spark.createDataFrame(hours[i : i + 2], "event_id long, h long").select(
            "event_id", F.lit(1).cast("bigint").alias("user_id"), F.lit("fire").alias("event_type"), F.timestamp_seconds(F.col("h") * 3600).alias("ts"), F.lit(2.0).alias("value")
        )
        part.coalesce(1).write.parquet(str(tmp_path / "part"), mode="append")
    s = jobs.fact_stream(spark, str(tmp_path / "part"), "*.parquet", 1)
    rows = {r["event_id"]: r for r in jobs.fire_rows(s, str(tmp_path / "out"), str(tmp_path / "state")).collect()}
    assert sorted(rows) == list(range(7))
    # files are read oldest first: the newest is 30, 30, 40 and 40 hours, so rows before 6, 6, 16 and 16 are late
    assert [i for i in sorted(rows) if rows[i]["kind"] == "absence"] == [0, 3, 5]
    assert rows[0]["reason"] == "outside_window" and rows[0]["num"] is None and rows[1]["num"] == 2.0 and rows[6]["kind"] == "primary"


def test_question_rules(spark):
    asked = {
        "find deforestation": ("change", None, "deforestation"), "Deforestation since 2020 in Peru": ("change", None, None), "flood risk in Goa": ("recall", None, None),
        "flood damage and flood risk in Goa": ("recall", None, "flood"), "forest fire risk near X": ("recall", None, None), "urban heat risk in Y": ("recall", None, None),
        "how fresh is your data in Spain": ("recall", "freshness", None), "ndvi coverage over the amazon": ("recall", "regional_density", None),
        "show me your coverage": ("recall", "global_coverage", None), "where do you have facts in Peru": ("recall", "global_coverage", None),
        "What looks like Mt Fuji": ("similarity", None, None), "": ("recall", None, None), None: ("recall", None, None),
    }
    df = spark.createDataFrame(list(enumerate(asked)), "qid long, text string")
    got = {r["qid"]: (r["intent"], r["audit"], r["event"]) for r in routing.classify_questions(df).collect()}
    assert [got[i] for i in range(len(asked))] == list(asked.values())


def test_ordinal_dates(spark):
    df = spark.createDataFrame([(2020366,), (2021366,), (2018001,), (2101001,), (2019000,), (None,)], "d long")
    got = [r["x"] and r["x"].isoformat() for r in df.select(lookup.ordinal_date(F.col("d"), (2019, 2100)).alias("x")).collect()]
    assert got == ["2020-12-31", None, None, None, None, None]


def test_normal_names(spark):
    names = {"São Paulo": "sao paulo", "München": "munchen", "New-York,  NY": "new york ny", "  ": "", "Straße Ægir ŒUVRE": "strasse aegir oeuvre", "東京 1": "1", None: None}
    df = spark.createDataFrame(list(enumerate(names)), "i long, n string")
    assert [r["k"] for r in df.select("i", ingest.normal_name("n").alias("k")).orderBy("i").collect()] == list(names.values())


def test_vertex_centroid_takes_the_part_with_most_corners(spark):
    square, other = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)], [(10.0, 10.0), (14.0, 10.0), (14.0, 14.0), (10.0, 10.0)]
    line, hole = [(50.0, 50.0), (51.0, 51.0)], [(1.0, 1.0)] * 9
    rows = [([[line], [square, hole], [other]],), ([],), ([[[]]],), (None,)]
    df = spark.createDataFrame(rows, "parts array<array<array<struct<lng: double, lat: double>>>>")
    lng, lat = spatial.vertex_centroid(F.col("parts"))
    got = [tuple(r) for r in df.select(lng.alias("x"), lat.alias("y")).collect()]
    assert got == [(2.0, 1.0), (None, None), (None, None), (None, None)]


def test_purge_plan(spark):
    here = grid.CELL_PREFIX + 5
    index = spark.createDataFrame([("a", "f1", here), ("b", "f2", here), ("c", "f2", 7), ("d", None, here), ("e", "f1", 7)], "fact_cid string, fn_key string, cell long")
    bodies = spark.createDataFrame([(c,) for c in "abcdex"], "fact_cid string")
    kept, left, counts = lookup.purge_plan(index, bodies, ["f1"])
    assert {r["fact_cid"] for r in kept.collect()} == {"b", "d"} == {r["fact_cid"] for r in left.collect()}
    assert {r["reason"]: r["n"] for r in counts.collect()} == {"fn_key": 2, "stale_grid": 1, "orphan": 4}
    kept, left, counts = lookup.purge_plan(index, bodies, [], grid=False, orphans=False)
    assert kept.count() == 5 and left.count() == 6 and counts.count() == 0


def test_protected_status_of_points(spark):
    hits = [(1, "x", {"iucn_level": "II"}), (1, "y", {"protect_class": "1a"}), (2, "x", {}), (2, "w", {"iucn_level": "?"}), (3, "z", None)]
    df = spark.createDataFrame(hits, "id long, area_id string, tags map<string, string>")
    got = {r["id"]: (r["area_id"], r["category"], r["name"], r["designation"], r["marine"]) for r in spatial.protected_status(df).collect()}
    assert got[1] == ("y", "Ia", "OSM area y", "", False) and got[2] == ("w", "Not Reported", "OSM area w", "", False) and got[3][1] == "Not Reported"


def test_edge_index_equals_all_rings(spark):
    """A ring of 100,000 edges, a world-wide box, a comb, rings with holes and tiny ones; points on corners."""
    import math

    n = 100_000
    big = [(30 * math.cos(2 * math.pi * k / n), 20 * math.sin(2 * math.pi * k / n)) for k in range(n)]
    comb = [(k / 10, 40.0 if k % 2 else -40.0) for k in range(300)] + [(29.9, -50.0), (0.0, -50.0)]
    rings = {
        "big": [big], "world": [[(-180.0, -90.0), (180.0, -90.0), (180.0, 90.0), (-180.0, 90.0)]], "comb": [comb],
        "hole": [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)], [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0)]], "tiny": [[(1.0, 1.0), (1.001, 1.0), (1.0, 1.001)]],
        "line": [[(0.0, 0.0), (1.0, 1.0)]], "empty": [], "none": [[]],
    }
    closed = {k: [r + r[:1] for r in v] for k, v in rings.items()}
    polys = spark.createDataFrame(list(closed.items()), "poly_id string, rings array<array<struct<lng:double,lat:double>>>")
    rng = random.Random(1)
    pts = [(i, rng.uniform(-40, 40), rng.uniform(-60, 60)) for i in range(150)] + [(200 + i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (10, 10), (4, 4), (5, 5), (1, 1), (1.0002, 1.0002), (-180, -90), (179.9, 89.9), (6, 5), (0.05, 39.0)])]
    pts += [(300, None, 1.0), (301, float("nan"), 2.0)]
    df = spark.createDataFrame(pts, "id long, lng double, lat double").withColumns({"poly": F.lit(1), "edges": F.lit("x")})
    got = spatial.points_in_polygons(df, polys)
    assert got.columns == [*df.columns, "poly_id"]

    def inside(x, y, v):
        if x is None or x != x:
            return False
        return sum((a[1] > y) != (b[1] > y) and x < a[0] + (y - a[1]) / (b[1] - a[1]) * (b[0] - a[0]) for r in v for a, b in zip(r, r[1:], strict=False)) % 2 == 1

    want = sorted((i, k) for k, v in closed.items() for i, x, y in pts if inside(x, y, v))
    assert sorted((r["id"], r["poly_id"]) for r in got.collect()) == want
    strips = spatial.polygon_strips(polys)
    most = {r["poly_id"]: r["m"] for r in strips.groupBy("poly_id").agg(F.max(F.size("edges")).alias("m")).collect()}
    assert most["big"] < 2000 and strips.where("poly_id = 'world'").count() <= 16
    assert spatial.points_in_polygons(df, polys.limit(0)).count() == 0


def test_division_names():
    from pyspark.sql import SparkSession

    s = SparkSession.getActiveSession()
    df = s.createDataFrame([("São Paulo",), ("New-York,  NY",), ("",), (None,), ("ÎLE d'Oléron",)], "n string")
    assert [r["x"] for r in df.select(spatial.division_name(F.col("n")).alias("x")).collect()] == ["sao paulo", "new york ny", "", None, "ile d oleron"]


def test_windows_are_cut_into_few_pieces(spark):
    rng = random.Random(4)
    windows = [(i, *sorted((rng.randint(-5000, 5000), rng.randint(-5000, 5000)))) for i in range(60)]
    windows += [(100, 5, 5), (101, 5, 4), (102, 0, 15), (103, -16, -1), (104, None, 3), (105, 3, None), (106, -(2**50), 2**50 + 3), (107, 1, 1_000_001)]
    df = spark.createDataFrame(windows, "id long, lo long, hi long").withColumns({"cell": F.col("id") % 2, "band": F.lit("b")})
    pieces = lookup.window_pieces(df.where("id < 104 or id = 107"), "lo", "hi").collect()
    for i, lo, hi in windows:
        if i < 104:
            covered = sorted(s for r in pieces if r["id"] == i for s in range(r["piece"] * 16 ** r["piece_level"], (r["piece"] + 1) * 16 ** r["piece_level"]))
            assert covered == list(range(lo, hi + 1))
    assert sum(r["id"] == 107 for r in pieces) < 120
    facts = spark.range(900).select((F.col("id") % 3).alias("cell"), F.lit("b").alias("band"), (F.col("id") * 37 % 9000 - 4500).alias("tslot"), F.col("id").alias("n"))
    got = sorted((r["id"], r["n"]) for r in lookup.in_windows(df, facts, "lo", "hi").collect())
    known = facts.collect()
    assert got == sorted((i, f["n"]) for i, lo, hi in windows if lo is not None and hi is not None for f in known if f["cell"] == i % 2 and lo <= f["tslot"] <= hi)


def test_change_feed_keeps_its_state_over_restarts(spark, tmp_path):
    days = [[(1, "a", 1.0), (2, "a", 5.0), (1, "a", 2.5)], [(1, "a", 4.0), (3, "b", 1.0)], [(2, "a", 6.0), (1, "a", None), (3, "b", 0.5)]]
    n = 0
    (tmp_path / "in").mkdir()
    for day in days:  # every run is a new query on the same checkpoint
        rows = []
        for user, kind, value in day:
            rows.append((n, user, kind, value, 1_700_000_000 + n))
            n += 1
        df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, at long").withColumn("ts", F.timestamp_seconds("at").cast("timestamp_ntz")).drop("at")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = jobs.run_change_feed(jobs.fact_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
        found = sorted((r["event_id"], r["old"], r["new"]) for r in got.collect())
    assert [(e, o) for e, o, _ in found] == [(2, 1.0), (3, 2.5), (5, 5.0), (6, 4.0), (7, 1.0)]
    assert "providerClass" not in str(spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""))
    # every key's writes lie 2 to 4 seconds apart: a short life forgets between two files, a long one does not
    long = jobs.run_change_feed(jobs.fact_stream(spark, str(tmp_path / "in")), str(tmp_path / "out2"), str(tmp_path / "cp2"), ttl_ms=3_600_000)
    assert sorted(r["event_id"] for r in long.collect()) == [2, 3, 5, 6, 7]
    short = jobs.run_change_feed(jobs.fact_stream(spark, str(tmp_path / "in")), str(tmp_path / "out3"), str(tmp_path / "cp3"), ttl_ms=500)
    assert sorted(r["event_id"] for r in short.collect()) == [2, 3, 6, 7]  # only the last write but one of (2, a) is over two lives old


def test_change_feed_of_many_triggers_starts_no_python_and_keeps_few_states(spark, tmp_path):
    rng = random.Random(5)
    seen, want = {}, []
    (tmp_path / "in").mkdir()
    for day in range(11):
        rows = [(100 * day + k, rng.randrange(6) or None, rng.choice("ab"), rng.choice([None, 1.0, 2.0, 4.0]), rng.randrange(50)) for k in range(12)]
        for e, user, kind, value, _ in sorted(rows, key=lambda r: (r[4], r[0])):
            if seen.get((user, kind)) is not None:
                want.append((e, seen[user, kind], value))
            seen[user, kind] = value
        df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, at long").withColumn("ts", F.timestamp_seconds("at").cast("timestamp_ntz")).drop("at")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if day % 3 == 1 or day == 10:
            got = jobs.run_change_feed(jobs.fact_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted((r["event_id"], r["old"], r["new"]) for r in got.collect()) == sorted(want)
    assert jobs.runs_of_triggers(11) == [11, 10, 8] and max(len(jobs.runs_of_triggers(n)) for n in range(1024)) == 10
    r = spark.read.parquet(str(tmp_path / "in")).select(F.col("user_id").alias("cell"), F.col("event_type").alias("band"), F.col("value").alias("num"), F.col("ts").alias("signed_at"), "event_id", F.lit(1).alias("trigger"))
    plan = jobs.change_feed(r, r.drop("event_id").limit(0))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
