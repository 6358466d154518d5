"""Quality rules with risk-controlled cutoffs (native: DataFrame functions only).

Every rule is a badness ratio of one text. A rule's cutoff in a stratum is certified on the
labelled rows: with k of n good documents above the cutoff, the exact binomial tail
P(Bin(n, alpha_rule) <= k) must not exceed delta / (rules * strata). Cutoffs of one rule are tested
in a fixed order, lenient to strict, and testing stops at the first failure (fixed-sequence
testing), so the only correction needed is Bonferroni over rules and strata; ``alpha`` is shared
evenly by the rules, so that all rules together falsely reject at most ``alpha`` of a stratum's
good documents with probability 1 - delta. Among certified cutoffs the one that removes most bad
minus good labelled documents is used, the most lenient on ties; where nothing is certified or
nothing is gained, the rule is off.

The guarantee is on the certified cutoffs; documents that fail the base rules (too short, too much
repetition) are rejected besides, labelled good or not.

Defined cases: a null text has no words; null and empty strata are one stratum, named ''; an empty
table gives an empty result; repeated rows are judged one by one; repeated labels of a document
count once (lowest quality); labels without a quality are ignored. Extra columns, whatever their
names, pass through ``quality_filter`` untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import let, small_side, spread, stage

WORD_GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: rule -> cutoffs from lenient to strict
RULES: dict[str, tuple[float, ...]] = {
    "symbol_ratio": (1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.075, 0.05),
    "upper_ratio": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2),
    "shout_ratio": (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.075, 0.05),
    "dup_line_ratio": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
    "repeat_ratio": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1),
}
#: A cutoffs table beyond this many strata is joined instead of written into the plan.
MAX_INLINE_STRATA = 256
#: Labelled ids and strata that are broadcast; more are joined by shuffle.
BROADCAST_LABELS, BROADCAST_STRATA = 1_000_000, 100_000


@dataclass(frozen=True)
class RiskControl:
    alpha: float = 0.02  # false rejection allowed per stratum, all rules together
    delta: float = 0.1  # probability that any guarantee fails


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def repeated_window_words(words: Column, width: int = 5) -> Column:
    """Number of words inside a window of ``width`` words that the text holds twice or more.

    Windows are hashed; a text without a repeated hash (the usual case) costs one distinct. Else
    the windows are sorted by hash, those beside an equal one are kept, and their positions give
    the words covered."""
    n = F.size(words)

    def covered(h: Column) -> Column:
        ranked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        same = lambda s: F.sort_array(
            F.transform(
                F.filter(
                    s,
                    lambda x, i: (F.get(s, i - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, i + 1)["h"].eqNullSafe(x["h"])),
                ),
                lambda x: x["p"],
            )
        )
        at = let(ranked, same)
        return let(
            at,
            lambda p: F.aggregate(
                p,
                F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end")),
                lambda a, x: F.struct(
                    (a["n"] + x + width - F.greatest(a["end"], x)).alias("n"), (x + width).alias("end")
                ),
            )["n"],
        )

    hashes = F.transform(F.sequence(F.lit(1), n - width + 1), lambda i: F.xxhash64(F.slice(words, i, width)))
    return F.when(n < width, F.lit(0).cast("bigint")).otherwise(
        let(
            hashes,
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(covered(h)),
        )
    )


def quality_features(docs: DataFrame, text_col: str = "text") -> Column:
    """Struct of the base counts and rule ratios of one text."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def removed(chars: str) -> Column:
        return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("bigint")

    def counts(words: Column) -> Column:
        n = F.size(words).cast("bigint")
        word_chars = F.length(F.translate(text, GAP_CHARS, "")).cast("bigint")
        lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, GAP_CHARS, "")) > 0)
        n_lines = let(lines, lambda v: F.struct(F.size(v).cast("bigint").alias("n"), F.size(F.array_distinct(v)).cast("bigint").alias("d")))
        return F.struct(
            n.alias("n_words"),
            word_chars.alias("word_chars"),
            removed(SYMBOLS).alias("n_symbols"),
            n_lines.alias("lines"),
            repeated_window_words(words).alias("n_repeat_words"),
            removed("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
            removed("!").alias("n_shout"),
        )

    def ratios(c: Column) -> Column:
        def per(a: Column, b: Column) -> Column:
            return F.when(b > 0, a / b).otherwise(F.lit(0.0))

        dup = c["lines"]["n"] - c["lines"]["d"]
        return F.struct(
            c["n_words"].alias("n_words"),
            c["word_chars"].alias("word_chars"),
            c["n_symbols"].alias("n_symbols"),
            dup.alias("n_dup_lines"),
            c["n_repeat_words"].alias("n_repeat_words"),
            ((c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])).alias("base_failed"),
            per(c["n_symbols"], c["word_chars"]).alias("symbol_ratio"),
            per(c["n_upper"], c["word_chars"]).alias("upper_ratio"),
            per(c["n_shout"], c["n_words"]).alias("shout_ratio"),
            per(dup, c["lines"]["n"]).alias("dup_line_ratio"),
            per(c["n_repeat_words"], c["n_words"]).alias("repeat_ratio"),
        )

    return let(let(_words(text), counts), ratios)


def _log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1: Stirling's series after shifting the argument by 8."""
    y = x + 8.0
    shift = sum((F.log(x + float(i)) for i in range(1, 8)), F.log(x))
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k). Terms are summed from k down to 40 standard deviations below it; what lies
    below is smaller than double precision."""
    n, k = n.cast("double"), k.cast("double")
    low = F.greatest(F.lit(0.0), F.floor(F.least(k, n * p) - 40 * F.sqrt(n * p * (1 - p)) - 50))
    terms = F.sequence(low.cast("bigint"), F.least(k, n).cast("bigint"))

    def term(j: Column) -> Column:
        j = j.cast("double")
        return F.exp(
            _log_gamma(n + 1) - _log_gamma(j + 1) - _log_gamma(n - j + 1)
            + j * F.log(F.lit(p)) + (n - j) * F.log(F.lit(1 - p))
        )

    return F.least(F.lit(1.0), F.aggregate(terms, F.lit(0.0), lambda a, j: a + term(j)))


def certified_cutoffs(features: DataFrame, labels: DataFrame, stratum: str = "stratum", risk: RiskControl = RiskControl()) -> DataFrame:
    """(stratum, rule, cutoff, n_good, k_good, k_bad) of every rule that is on in a stratum.

    ``features`` has doc_id, the stratum and the rule ratios; ``labels`` doc_id and quality. The
    labelled rows are counted per (stratum, rule, number of cutoffs exceeded) before anything is
    gathered, so what follows has strata * rules * cutoffs rows at most."""
    known = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    seen = features.select("doc_id", F.coalesce(F.col(stratum), F.lit("")).alias("stratum"), *RULES).join(known, "doc_id")
    levels = F.array(
        *[
            F.struct(
                F.lit(rule).alias("rule"),
                sum(((F.col(rule) > c).cast("int") for c in cuts), F.lit(0)).alias("level"),
            )
            for rule, cuts in RULES.items()
        ]
    )
    counted = (
        seen.select("stratum", (F.col("quality") > 0).alias("good"), F.explode(levels).alias("x"))
        .groupBy("stratum", "x.rule", "x.level")
        .agg(
            F.sum(F.col("good").cast("bigint")).alias("good"),
            F.sum((~F.col("good")).cast("bigint")).alias("bad"),
        )
    )
    grid = F.explode(
        F.array(
            *[
                F.struct(F.lit(rule).alias("rule"), F.lit(i + 1).alias("level"), F.lit(len(cuts) - i).alias("exceeded"), F.lit(c).alias("cutoff"))
                for rule, cuts in RULES.items()
                for i, c in enumerate(cuts)
            ]
        )
    )
    strata = seen.groupBy("stratum").agg(F.sum((F.col("quality") > 0).cast("bigint")).alias("n_good"))
    n_strata = strata.groupBy().agg(F.count("*").alias("n_strata")).first()["n_strata"]
    tests = max(1, n_strata * len(RULES))
    per = strata.select("*", grid.alias("g")).select("stratum", "n_good", "g.*")
    above = (
        per.join(counted.withColumnRenamed("level", "has"), ["stratum", "rule"], "left")
        .groupBy("stratum", "rule", "level", "cutoff", "n_good")
        .agg(
            F.coalesce(F.sum(F.when(F.col("has") >= F.col("exceeded"), F.col("good"))), F.lit(0)).alias("k_good"),
            F.coalesce(F.sum(F.when(F.col("has") >= F.col("exceeded"), F.col("bad"))), F.lit(0)).alias("k_bad"),
        )
    )
    tail = binomial_tail(F.col("n_good"), F.col("k_good"), risk.alpha / len(RULES))
    passed = above.withColumn("ok", (F.col("n_good") > 0) & (tail <= risk.delta / tests))
    in_order = Window.partitionBy("stratum", "rule").orderBy("level")
    best = Window.partitionBy("stratum", "rule").orderBy((F.col("k_bad") - F.col("k_good")).desc(), "level")
    return (
        passed.withColumn("all_ok", F.min("ok").over(in_order))
        .where("all_ok and k_bad > k_good")
        .withColumn("r", F.row_number().over(best))
        .where("r = 1")
        .select("stratum", "rule", "cutoff", "n_good", "k_good", "k_bad")
    )


def _inline(cutoffs: DataFrame, stratum: Column):
    """Function from a struct of ratios to whether a cutoff of its stratum is exceeded, with the cutoffs
    of at most MAX_INLINE_STRATA strata (strata * rules numbers) written into the plan."""
    rows = sorted(cutoffs.limit(MAX_INLINE_STRATA * len(RULES) + 1).collect(), key=lambda r: (r["stratum"], r["rule"]))

    def over(q: Column) -> Column:
        out = F.lit(False)
        for r in rows:
            out = out | ((stratum == r["stratum"]) & (q[r["rule"]] > r["cutoff"]))
        return out

    return over


def _judged(docs: DataFrame, stratum: Column, q: Column, cutoffs: DataFrame) -> DataFrame:
    """(row, q, kept) of every row of ``docs``: the row, its features and the verdict. Few cutoffs are
    written into the plan, many are joined by stratum; both judge row by row."""
    packed = docs.select(F.struct("*").alias("row"), stratum.alias("stratum"), q.alias("q"))
    most = MAX_INLINE_STRATA * len(RULES)
    if cutoffs.limit(most + 1).count() <= most:
        over = _inline(cutoffs, F.col("stratum"))
        return packed.select("row", "q", (~(F.col("q.base_failed") | over(F.col("q")))).alias("kept"))
    cuts = cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts"))
    joined = packed.join(small_side(cuts, BROADCAST_STRATA), "stratum", "left")
    over = F.lit(False)
    for r in RULES:
        over = over | F.coalesce(F.col("q")[r] > F.col("cuts")[r], F.lit(False))
    return joined.select("row", "q", (~(F.col("q.base_failed") | over)).alias("kept"))


def quality_rules(docs: DataFrame, labels: DataFrame, stratum_col: str = "lang", text_col: str = "text", risk: RiskControl = RiskControl()) -> DataFrame:
    """One row per document: doc_id, the base counts, the ratios, base_failed and kept."""
    features = stage(_features(docs, stratum_col, text_col), "quality")
    cutoffs = stage(certified_cutoffs(features, labels, risk=risk), "cutoffs")
    q = F.struct(*[c for c in features.columns if c not in ("doc_id", "stratum")])
    return _judged(features, F.col("stratum"), q, cutoffs).select("row.*", "kept")


def _features(docs: DataFrame, stratum_col: str, text_col: str) -> DataFrame:
    rows = spread(docs.select("doc_id", F.coalesce(F.col(stratum_col), F.lit("")).alias("stratum"), F.col(text_col).alias("text")))
    return rows.select("doc_id", "stratum", quality_features(rows, "text").alias("q")).select("doc_id", "stratum", "q.*")


def quality_filter(docs: DataFrame, labels: DataFrame, stratum_col: str = "lang", text_col: str = "text", risk: RiskControl = RiskControl()) -> DataFrame:
    """The documents that ``quality_rules`` keeps, with all their columns. Cutoffs come from the
    labelled documents; the verdict is a column of one pass over all, so no text is shuffled unless
    labels or strata are too many to broadcast."""
    known = small_side(labels.where("quality is not null and doc_id is not null").select("doc_id").distinct(), BROADCAST_LABELS)
    features = stage(_features(docs.join(known, "doc_id", "left_semi"), stratum_col, text_col), "quality")
    cutoffs = stage(certified_cutoffs(features, labels, risk=risk), "cutoffs")
    docs, stratum = spread(docs), F.coalesce(F.col(stratum_col), F.lit(""))
    if cutoffs.limit(MAX_INLINE_STRATA * len(RULES) + 1).count() <= MAX_INLINE_STRATA * len(RULES):
        over = _inline(cutoffs, stratum)
        # one expression, so that the features are computed once per row
        return docs.where(let(quality_features(docs, text_col), lambda q: ~(q["base_failed"] | over(q))))
    return _judged(docs, stratum, quality_features(docs, text_col), cutoffs).where("kept").select("row.*")
