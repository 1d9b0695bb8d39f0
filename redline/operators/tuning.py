"""Choosing similarity thresholds on labelled pairs, and drawing pairs to label.

The grid search never meets labels with grid points: similarities are first counted between the cut
points of the grid, which leaves at most a few dozen rows however many labels there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redline.operators.changes import classify_similarity
from redline.operators.ranking import rank_within, top_per_key

CLASSES = ["unchanged", "modified_minor", "modified_major"]
UNCHANGED_GRID = [round(x / 100, 2) for x in range(85, 100, 2)]
MINOR_GRID = [round(x / 100, 2) for x in range(65, 95, 2)]
DEFAULTS = (0.95, 0.80)     # too few labels
NO_WINNER = (0.94, 0.80)    # no grid point scored above zero
MIN_LABELS = 20


def classify_with(similarity: Column, unchanged, minor) -> Column:
    """Class under candidate thresholds: everything from 0 up to ``minor`` is a major change."""
    return classify_similarity(similarity, unchanged, minor, 0.0)


def _ratio(a, b):
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def evaluate_grid(labels: DataFrame, grid: list[tuple[float, float]], classes: list[str] | None = None) -> DataFrame:
    """Scores of every (unchanged, minor): per class, pooled over classes (micro) and averaged (macro).

    ``labels``: (similarity, label).
    """
    classes = CLASSES if classes is None else classes
    cuts = sorted({0.0} | {t for point in grid for t in point})
    at_or_below = F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: F.coalesce(F.col("similarity"), F.lit(0.0)) >= c)
    # the largest cut not above the similarity stands for it: every threshold compares the same way
    counted = (labels.withColumn("level", F.coalesce(F.array_max(at_or_below), F.lit(-1.0)))
               .groupBy("level", "label").agg(F.count(F.lit(1)).alias("n")))
    # one literal array; built as text because hundreds of column objects cost more than the query
    points = F.expr("array(" + ", ".join(f"named_struct('grid_order', {i}, 'unchanged', {u}D, 'minor', {m}D)"
                                         for i, (u, m) in enumerate(grid)) + ")")
    met = counted.select("level", "label", "n", F.explode(points).alias("g")).select("level", "label", "n", "g.*")
    met = met.withColumn("predicted", classify_with(F.col("level"), F.col("unchanged"), F.col("minor")))
    sums = []
    for c in classes:
        hit, said = F.col("label").eqNullSafe(c), F.col("predicted") == c
        for name, cond in (("tp", hit & said), ("fp", said & ~hit), ("fn", hit & ~said)):
            sums.append(F.sum(F.when(cond, F.col("n")).otherwise(0)).alias(f"{c}_{name}"))
    out = met.groupBy("grid_order", "unchanged", "minor").agg(*sums)

    def scores(prefix, tp, fp, fn):
        p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
        return {f"{prefix}_precision": p, f"{prefix}_recall": r, f"{prefix}_f1": _ratio(2 * p * r, p + r)}

    cols = {}
    for c in classes:
        cols.update(scores(c, *[F.col(f"{c}_{x}") for x in ("tp", "fp", "fn")]))
    cols.update(scores("micro", *[sum((F.col(f"{c}_{x}") for c in classes[1:]), F.col(f"{classes[0]}_{x}"))
                                  for x in ("tp", "fp", "fn")]))
    out = out.withColumns(cols)
    for m in ("precision", "recall", "f1"):
        out = out.withColumn(f"macro_{m}", sum((F.col(f"{c}_{m}") for c in classes[1:]),
                                               F.col(f"{classes[0]}_{m}")) / len(classes))
    return out


def reject_unknown_labels(labels: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """Labels outside the vocabulary: to be fixed by hand, never silently scored."""
    return labels.filter(~F.coalesce(F.col("label").isin(classes or CLASSES), F.lit(False)))


def default_grid() -> list[tuple[float, float]]:
    return [(u, m) for u in UNCHANGED_GRID for m in MINOR_GRID if m < u]


def holdout_split(labels: DataFrame, id_col: str, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test): max(10, n / 5) test rows chosen by a seeded hash, the same on any partitioning."""
    n_test = max(10, labels.count() // 5)
    h = F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))))
    ranked = rank_within(labels.withColumn("_h", h), [], [F.col("_h"), F.col(id_col)], "_rank",
                         levels=[F.substring("_h", 1, 3), F.substring("_h", 4, 3)])
    return (ranked.filter(F.col("_rank") >= n_test).drop("_h", "_rank"),
            ranked.filter(F.col("_rank") < n_test).drop("_h", "_rank"))


def grid_search(labels: DataFrame, id_col: str = "change_id", grid: list[tuple[float, float]] | None = None,
                seed: int = 42) -> dict:
    """Best thresholds on the training part with their held-out scores; the earliest grid point wins ties."""
    if labels.limit(MIN_LABELS).count() < MIN_LABELS:
        return {"unchanged": DEFAULTS[0], "minor": DEFAULTS[1], "held_out_precision": 0.0, "held_out_recall": 0.0}
    train, test = holdout_split(labels, id_col, seed)
    best = evaluate_grid(train, grid or default_grid()).orderBy(F.col("micro_f1").desc(), "grid_order").first()
    if best is None or best["micro_f1"] <= 0:
        point, out = NO_WINNER, {"unchanged": NO_WINNER[0], "minor": NO_WINNER[1]}
    else:
        point, out = (best["unchanged"], best["minor"]), best.asDict()
    held = evaluate_grid(test, [point]).first()
    return {**out, **{f"held_out_{m}": held[f"micro_{m}"] for m in ("precision", "recall", "f1")}}


def stratified_sample(records: DataFrame, sections: list[str] | None = None, pairs: list[tuple[str, str]] | None = None,
                      n_combos: int | None = None, target_total: int = 50, seed: int = 42,
                      combo: tuple[str, ...] = ("ticker", "anchor", "y_old", "y_new"),
                      id_col: str = "change_id") -> DataFrame:
    """A label sample balanced over section pairs and, inside each, over similarity and class buckets.

    Buckets of changed rows are cut on similarity (0.80, 0.95) for the modified ones, so an added row also
    counts as a large modification. Left-over quota is refilled from changed rows; the total is capped.
    Choice is by seeded hash; ``bucket`` tells why a row was drawn.
    """
    combo = list(combo)
    if sections is not None:
        records = records.filter(F.col("anchor").isin(sections))
    if pairs is not None:
        wanted = [f"{a}|{b}" for a, b in pairs]
        records = records.filter(F.concat_ws("|", "y_old", "y_new").isin(wanted))
    if n_combos is None:
        n_combos = records.select(*combo).distinct().count()
    quota = max(1, target_total // max(1, n_combos))
    cls, sim = F.col("classification"), F.coalesce(F.col("similarity"), F.lit(0.0))
    changed = cls != "unchanged"
    buckets = F.array_compact(F.array(
        F.when(~changed, "unchanged"), F.when(changed & (sim >= 0.80) & (sim < 0.95), "modified_minor"),
        F.when(changed & (sim < 0.80), "modified_major"), F.when(cls == "added", "added"),
        F.when(cls == "removed", "removed")))
    h = F.md5(F.concat_ws("|", F.col(id_col), F.lit(str(seed))))
    rows = records.withColumn("_h", h)
    in_bucket = rows.withColumn("bucket", F.explode(buckets))
    sizes = in_bucket.groupBy(*combo, "bucket").agg(F.count(F.lit(1)).alias("n"))
    per = sizes.groupBy(*combo).agg(F.count(F.lit(1)).alias("nb"), F.collect_list("n").alias("ns")).withColumn(
        "per_bucket", F.greatest(F.lit(1), F.floor(F.lit(quota) / F.col("nb")))).withColumn(
        "leftover", F.lit(quota) - F.aggregate(F.transform("ns", lambda x: F.least(x, F.col("per_bucket"))),
                                               F.lit(0).cast("long"), lambda a, x: a + x))
    per = per.select(*combo, "per_bucket", "leftover")
    order = [F.col("_h"), F.col(id_col)]
    drawn = (top_per_key(in_bucket, [*combo, "bucket"], order, quota, "_r").join(per, combo)
             .filter(F.col("_r") <= F.col("per_bucket")))
    refill = (top_per_key(rows.filter(changed).withColumn("bucket", F.lit("refill")), combo, order, quota, "_r")
              .join(per, combo).filter(F.col("_r") <= F.col("leftover")))
    out = drawn.unionByName(refill).drop("_r", "per_bucket", "leftover")
    return out.orderBy("_h", id_col, "bucket").limit(target_total).drop("_h")


def export_labels(sample: DataFrame) -> DataFrame:
    """The label sheet: ids, texts cut to 300 characters, empty label and notes."""
    return sample.select(
        "change_id", "ticker", "anchor", F.col("y_old").alias("year_old"), F.col("y_new").alias("year_new"),
        "similarity", F.substring(F.coalesce("old_text", F.lit("")), 1, 300).alias("old_text"),
        F.substring(F.coalesce("new_text", F.lit("")), 1, 300).alias("new_text"), "classification",
        F.lit("").alias("your_label"), F.lit("").alias("notes"))
