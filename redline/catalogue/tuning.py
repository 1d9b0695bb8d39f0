"""Threshold grid, held-out split and label samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from redline.catalogue import register
from redline.catalogue.views import DOCS_SQL, documents, table
from redline.operators import tuning as TU

# Similarity stands in as a function of text length; quality and toxicity stand in for the label.
_LABELS_SQL = """labelled AS (SELECT doc_id, (n_chars % 1000) / 1000.0 AS similarity,
  CASE WHEN toxic = 1 THEN 'modified_major' WHEN quality = 1 THEN 'unchanged' ELSE 'modified_minor' END AS label
  FROM labels JOIN documents USING (doc_id))"""


def _labels(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return table(spark, sf_dir, "labels").join(d, "doc_id").select(
        "doc_id", ((F.col("n_chars") % 1000) / 1000.0).alias("similarity"),
        F.when(F.col("toxic") == 1, "modified_major").when(F.col("quality") == 1, "unchanged")
        .otherwise("modified_minor").alias("label"))


def _scores_sql(grid):
    values = ",".join(f"({i},{u}e0,{m}e0)" for i, (u, m) in enumerate(grid))
    return f"""grid(grid_order, unchanged, minor) AS (VALUES {values}),
said AS (SELECT g.*, label, CASE WHEN similarity >= unchanged THEN 'unchanged' WHEN similarity >= minor THEN 'modified_minor'
    WHEN similarity >= 0 THEN 'modified_major' ELSE 'modified_minor' END AS p FROM labelled CROSS JOIN grid g),
sums AS (SELECT grid_order, unchanged, minor, count(*) FILTER (p = label) AS tp, count(*) FILTER (p <> label) AS wrong FROM said GROUP BY ALL),
scores AS (SELECT grid_order, unchanged, minor, tp, tp / (tp + wrong) AS micro_precision, tp / (tp + wrong) AS micro_recall,
  CASE WHEN tp = 0 THEN 0.0 ELSE tp / (tp + wrong) END AS micro_f1 FROM sums)"""


@register("threshold_grid", f"""WITH {_LABELS_SQL}, {_scores_sql(TU.default_grid())}
SELECT unchanged, minor, round(micro_precision, 9) AS micro_precision, round(micro_recall, 9) AS micro_recall,
       round(micro_f1, 9) AS micro_f1 FROM scores""")
def threshold_grid(spark, sf_dir):
    out = TU.evaluate_grid(_labels(spark, sf_dir), TU.default_grid())
    return out.select("unchanged", "minor", *[F.round(f"micro_{m}", 9).alias(f"micro_{m}") for m in ("precision", "recall", "f1")])


@register("threshold_classes", f"""WITH {_LABELS_SQL}, {_scores_sql([(0.95, 0.81)])},
cls(c) AS (VALUES ('unchanged'), ('modified_minor'), ('modified_major'))
SELECT c AS class, count(*) FILTER (p = c AND label = c) AS tp, count(*) FILTER (p = c AND label <> c) AS fp,
       count(*) FILTER (p <> c AND label = c) AS fn FROM said CROSS JOIN cls GROUP BY c""")
def threshold_classes(spark, sf_dir):
    out = TU.evaluate_grid(_labels(spark, sf_dir), [(0.95, 0.81)])
    per = F.array(*[F.struct(F.lit(c).alias("class"), *[F.col(f"{c}_{x}").alias(x) for x in ("tp", "fp", "fn")])
                    for c in TU.CLASSES])
    return out.select(F.explode(per).alias("x")).select("x.*")


@register("holdout_split", f"""WITH {_LABELS_SQL},
r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || '|42'), doc_id) - 1 AS rn, count(*) OVER () AS n FROM labelled)
SELECT doc_id, rn < greatest(10, n // 5) AS held_out FROM r""")
def holdout_split(spark, sf_dir):
    train, test = TU.holdout_split(_labels(spark, sf_dir), "doc_id")
    return train.select("doc_id", F.lit(False).alias("held_out")).unionByName(test.select("doc_id", F.lit(True).alias("held_out")))


_RECORDS_SQL = f"""{DOCS_SQL}, records AS (SELECT ticker, anchor, 'FY2021' AS y_old, fiscal_year AS y_new,
  'c' || format('{{:06d}}', doc_id) AS change_id, (n_chars % 1000) / 1000.0 AS similarity,
  list_element(['unchanged', 'modified_minor', 'modified_major', 'added', 'removed'], CAST(doc_id % 5 AS INT) + 1) AS classification
  FROM docs)"""


def _records(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.select("ticker", "anchor", F.lit("FY2021").alias("y_old"), F.col("fiscal_year").alias("y_new"),
                    F.concat(F.lit("c"), F.format_string("%06d", "doc_id")).alias("change_id"),
                    ((F.col("n_chars") % 1000) / 1000.0).alias("similarity"),
                    F.get(F.array(*[F.lit(c) for c in ("unchanged", "modified_minor", "modified_major", "added", "removed")]),
                          (F.col("doc_id") % 5).cast("int")).alias("classification"),
                    F.col("text").alias("old_text"), F.col("text").alias("new_text"))


_SAMPLE_SQL = f"""{_RECORDS_SQL},
combos AS (SELECT count(DISTINCT (anchor, y_new)) AS k FROM records),
quota AS (SELECT greatest(1, 500 // k) AS q FROM combos),
hashed AS (SELECT *, md5(change_id || '|42') AS h FROM records),
b AS (SELECT *, unnest(list_filter([CASE WHEN classification = 'unchanged' THEN 'unchanged' END,
    CASE WHEN classification <> 'unchanged' AND similarity >= 0.8 AND similarity < 0.95 THEN 'modified_minor' END,
    CASE WHEN classification <> 'unchanged' AND similarity < 0.8 THEN 'modified_major' END,
    CASE WHEN classification = 'added' THEN 'added' END, CASE WHEN classification = 'removed' THEN 'removed' END],
    lambda x: x IS NOT NULL)) AS bucket FROM hashed),
ns AS (SELECT anchor, y_new, bucket, count(*) AS n FROM b GROUP BY ALL),
per AS (SELECT anchor, y_new, greatest(1, any_value(q) // count(*)) AS per_bucket FROM ns CROSS JOIN quota GROUP BY ALL),
lefts AS (SELECT anchor, y_new, any_value(per_bucket) AS per_bucket, any_value(q) - sum(least(n, per_bucket)) AS leftover
          FROM ns JOIN per USING (anchor, y_new) CROSS JOIN quota GROUP BY ALL),
d AS (SELECT *, row_number() OVER (PARTITION BY anchor, y_new, bucket ORDER BY h, change_id) AS r FROM b),
x AS (SELECT *, 'refill' AS bucket, row_number() OVER (PARTITION BY anchor, y_new ORDER BY h, change_id) AS r
      FROM hashed WHERE classification <> 'unchanged'),
drawn AS (SELECT change_id, bucket, h FROM d JOIN lefts USING (anchor, y_new) WHERE r <= per_bucket
  UNION ALL SELECT change_id, bucket, h FROM x JOIN lefts USING (anchor, y_new) WHERE r <= leftover)
SELECT change_id, bucket FROM drawn ORDER BY h, change_id, bucket LIMIT 500"""


@register("stratified_sample", f"WITH {_SAMPLE_SQL}")
def stratified_sample(spark, sf_dir):
    return TU.stratified_sample(_records(spark, sf_dir), target_total=500, combo=("anchor", "y_new")).select("change_id", "bucket")


@register("label_sheet", f"""WITH {_RECORDS_SQL} SELECT change_id, ticker, anchor, y_old AS year_old, y_new AS year_new, similarity,
  substr(text, 1, 300) AS old_text, substr(text, 1, 300) AS new_text, classification, '' AS your_label, '' AS notes
FROM records JOIN documents ON 'c' || format('{{:06d}}', doc_id) = change_id""")
def label_sheet(spark, sf_dir):
    return TU.export_labels(_records(spark, sf_dir))
