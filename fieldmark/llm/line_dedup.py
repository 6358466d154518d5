"""Line dedup by winnowing (native: DataFrame functions only).

Lines with a word are numbered, counted in words and hashed. The gram of a line is the hash of the
line hashes from it on, up to the line that completes ``min_words`` words. A winnowing window holds
the grams that start within ``sure_words - min_words`` words; its least gram is selected as a
fingerprint. A run of ``sure_words`` words or more that two places share holds a whole window, so both
places select the same fingerprint; nothing shorter than ``min_words`` words matches.

Only selected fingerprints are joined, each to the first place (smallest doc_id, then line) with the
same gram. Overlapping matches on one diagonal are one run, every run is extended line by line both
ways, and the later place loses the run's lines. The first place of a run stays, so what remains
holds no run of ``sure_words`` words whose lines stand unbroken at an earlier place.

Defined cases: a null text stays null and has no lines; an empty table gives an empty result; rows
that share id and text are edited alike and are not compared with each other; rows that share an id
but not the text are different documents; rows with a null id come last in the order of places; lines
are compared without surrounding white space; blank lines inside a deleted run go with it; of a run
that overlaps its own repetition the first period stays. Extra columns, whatever their names, pass
through ``line_dedup`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_side, spread, stage

MIN_WORDS, SURE_WORDS = 40, 50
WORD_GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"
#: Edited documents, or hot keys, that are broadcast; more are joined by shuffle.
BROADCAST_EDITS = 100_000
#: Rows of a key above which a join spreads them over so many parts.
HOT_ROWS, SALTS = 1000, 64


def text_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, th, p, h, n): every line with a word, its place, hash and words; th tells apart the
    texts of one id."""
    texts = spread(docs.select("doc_id", F.col(text_col).alias("text")))
    split = texts.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("p", "line"))
    trimmed = split.select("doc_id", "th", "p", F.btrim("line", F.lit(GAP_CHARS)).alias("line")).where("line <> ''")
    return trimmed.select(
        "doc_id", "th", "p", F.xxhash64("line").alias("h"), F.size(F.split("line", WORD_GAP)).alias("n")
    )


def fingerprints(lines: DataFrame, min_words: int, sure_words: int) -> DataFrame:
    """(doc_id, th, key, i, e): the selected grams; i and e number their first and last lines from 0."""
    doc = Window.partitionBy("doc_id", "th")
    placed = lines.withColumns(
        {
            "i": F.row_number().over(doc.orderBy("p")) - 1,
            "b": F.sum("n").over(doc.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"),
        }
    )
    gram = doc.orderBy("b").rangeBetween(0, min_words - 1)
    grams = placed.select(
        "doc_id",
        "th",
        "i",
        "b",
        F.sum("n").over(gram).alias("words"),
        F.max("i").over(gram).alias("e"),
        F.xxhash64(F.collect_list("h").over(gram)).alias("key"),
    ).where(F.col("words") >= min_words)
    window = doc.orderBy("b").rangeBetween(0, sure_words - min_words)
    least = F.min(F.struct("key", "i", "e")).over(window)
    return grams.select("doc_id", "th", least.alias("f")).select("doc_id", "th", "f.*").distinct()


def spread_join(many: DataFrame, single: DataFrame, keys: list[str], counts: DataFrame) -> DataFrame:
    """``many`` joined with ``single`` (one row per key, keys may be null); rows of ``many`` whose key has
    more than HOT_ROWS rows in ``counts`` (keys, n) are spread over SALTS copies of their one row."""
    hot = small_side(counts.where(F.col("n") > HOT_ROWS).select(*[F.col(k).alias(f"hot_{k}") for k in keys]), BROADCAST_EDITS)

    def marked(df: DataFrame) -> DataFrame:
        same = [F.col(k).eqNullSafe(F.col(f"hot_{k}")) for k in keys]
        return df.join(hot.withColumn("is_hot", F.lit(True)), same, "left").drop(*[f"hot_{k}" for k in keys])

    rest = [c for c in many.columns if c not in keys]
    salt = F.when(F.col("is_hot"), F.pmod(F.xxhash64(*rest), F.lit(SALTS)).cast("int")).otherwise(0)
    left = marked(many).withColumn("salt", salt).drop("is_hot")
    copies = F.when(F.col("is_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = marked(single).withColumn("r_salt", F.explode(copies)).drop("is_hot")
    right = right.select(*[F.col(k).alias(f"r_{k}") if k in keys else F.col(k) for k in right.columns])
    met = [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in keys] + [F.col("salt") == F.col("r_salt")]
    return left.join(right, met).drop("salt", "r_salt", *[f"r_{k}" for k in keys])


def _matching(hs: Column, there: Column, at: Column, at_there: Column, step: int) -> Column:
    """Lines that agree in a row from the two places on, going by ``step``."""
    room = F.least(at, at_there) if step < 0 else F.least(F.size(hs) - 1 - at, F.size(there) - 1 - at_there)
    run = F.aggregate(
        F.sequence(F.lit(1), room),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda a, j: F.when(
            a["on"] & (F.get(hs, at + step * j)["h"] == F.get(there, at_there + step * j)["h"]),
            F.struct((a["n"] + 1).alias("n"), F.lit(True).alias("on")),
        ).otherwise(F.struct(a["n"].alias("n"), F.lit(False).alias("on"))),
    )["n"]
    return F.when(room < 1, F.lit(0)).otherwise(run)


def repeated_runs(lines: DataFrame, min_words: int = MIN_WORDS, sure_words: int = SURE_WORDS) -> DataFrame:
    """(doc_id, th, cuts): line places [lo, hi] that repeat an earlier run. ``lines`` is read several
    times: pass a table."""
    prints = stage(fingerprints(lines, min_words, sure_words), "prints")
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "th", "i")
    first = prints.groupBy("key").agg(F.min(place).alias("src"), F.max(place).alias("last"), F.count("*").alias("n"))
    first = stage(first.where("src <> last").select("key", "src", "n"), "first")
    met = spread_join(prints, first.select("key", "src"), ["key"], first).where(place != F.col("src"))
    matches = met.select(
        "doc_id", "th", "i", "e", F.col("src.doc_id").alias("d0"), F.col("src.th").alias("t0"), F.col("src.i").alias("i0"),
        (F.col("i") - F.col("src.i")).alias("shift"),
    )
    diagonal = Window.partitionBy("doc_id", "th", "d0", "t0", "shift").orderBy("i")
    runs = (
        matches.withColumn("new", F.coalesce((F.col("i") > F.lag("e").over(diagonal) + 1).cast("int"), F.lit(1)))
        .withColumn("run", F.sum("new").over(diagonal))
        .groupBy("doc_id", "th", "d0", "t0", "shift", "run")
        .agg(F.min("i").alias("i"), F.max("e").alias("e"), F.min("i0").alias("i0"))
        .drop("shift", "run")
    )
    runs = stage(runs, "runs")
    sources = runs.groupBy("d0", "t0").agg(F.count("*").alias("n"))
    edited = runs.groupBy("doc_id", "th").agg(F.count("*").alias("n"))
    named = edited.select(F.col("doc_id").alias("id"), F.col("th").alias("t")).union(sources.select("d0", "t0")).distinct()
    arrays = stage(
        lines.join(named, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("t")), "left_semi")
        .groupBy("doc_id", "th")
        .agg(F.array_sort(F.collect_list(F.struct("p", "h"))).alias("hs")),
        "arrays",
    )
    there = arrays.select(F.col("doc_id").alias("d0"), F.col("th").alias("t0"), F.col("hs").alias("hs0"))
    wide = spread_join(runs, there, ["d0", "t0"], sources)
    wide = spread_join(wide.drop("d0", "t0"), arrays, ["doc_id", "th"], edited)
    e0 = F.col("i0") + F.col("e") - F.col("i")
    left = _matching(F.col("hs"), F.col("hs0"), F.col("i"), F.col("i0"), -1)
    right = _matching(F.col("hs"), F.col("hs0"), F.col("e"), e0, 1)
    cut = F.struct(
        F.get("hs", F.col("i") - left)["p"].alias("lo"), F.get("hs", F.col("e") + right)["p"].alias("hi")
    )
    return wide.select("doc_id", "th", cut.alias("cut")).groupBy("doc_id", "th").agg(F.collect_set("cut").alias("cuts"))


def line_dedup(
    docs: DataFrame,
    min_words: int = MIN_WORDS,
    sure_words: int = SURE_WORDS,
    text_col: str = "text",
    report: bool = False,
    drop_emptied: bool = False,
) -> DataFrame:
    """The documents with later repeated runs deleted from their text. ``report`` adds n_lines,
    n_removed_lines and emptied (lost its last word); ``drop_emptied`` leaves those documents out."""
    lines = stage(text_lines(docs, text_col).dropDuplicates(["doc_id", "th", "p"]), "lines")
    cuts = stage(repeated_runs(lines, min_words, sure_words), "cuts")
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("whole"), F.col("doc_id").alias("id"), F.xxhash64(text_col).alias("t"))
    joined = rows.join(small_side(cuts, BROADCAST_EDITS), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("th")), "left")
    kept = F.filter(
        F.split("whole", "\n"),
        lambda _, p: ~F.exists("cuts", lambda c: (p >= c["lo"]) & (p <= c["hi"])),
    )
    edited = F.when(F.col("cuts").isNull(), F.col("whole")).otherwise(F.array_join(kept, "\n"))
    lines_in = F.coalesce(F.size(F.split("whole", "\n")), F.lit(0)).cast("bigint")
    lost = F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(lines_in - F.size(kept)).cast("bigint")
    emptied = F.col("cuts").isNotNull() & (F.btrim(edited, F.lit(GAP_CHARS)) == "")
    if drop_emptied:
        joined = joined.where(~emptied)
    counts = [lines_in.alias("n_lines"), lost.alias("n_removed_lines"), emptied.alias("emptied")] if report else []
    told = joined.select("row", edited.alias("edited"), F.struct(*counts).alias("told") if report else F.lit(None).alias("told"))
    columns = [F.col("edited").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return told.select(*columns, *(["told.*"] if report else []))
