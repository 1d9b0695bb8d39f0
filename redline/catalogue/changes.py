"""Year-over-year changes of the versioned corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from redline import dims
from redline.catalogue import ORACLES, register
from redline.catalogue.views import DOCS_SQL, FILING_YEARS, documents, table
from redline.operators import changes as C
from redline.operators import matching as M
from redline.operators import pairing as P
from redline.operators import responses as R
from redline.operators import stats as S
from redline.operators.ranking import BLOCK, rank_within
from redline.plans.change_report import align_corpus, diff_corpus

SEP = "\n"  # the documents carry one paragraph per line

# ---- pairing ------------------------------------------------------------------------------------------

_YP_SQL = """yp AS (SELECT * FROM (
  SELECT ticker, fiscal_year AS y_old, lead(fiscal_year) OVER (PARTITION BY ticker ORDER BY fiscal_year) AS y_new
  FROM (SELECT DISTINCT ticker, fiscal_year FROM docs)) WHERE y_new IS NOT NULL)"""


@register("year_pairs", f"WITH {DOCS_SQL}, {_YP_SQL} SELECT * FROM yp")
def year_pairs(spark, sf_dir):
    return P.year_pairs(documents(spark, sf_dir))


@register("section_pairs", f"""WITH {DOCS_SQL}, {_YP_SQL},
sec AS (SELECT ticker, fiscal_year, anchor, count(*) AS n FROM docs GROUP BY ALL),
o AS (SELECT yp.*, anchor, n FROM yp JOIN sec ON sec.ticker = yp.ticker AND fiscal_year = y_old),
n AS (SELECT yp.*, anchor, n FROM yp JOIN sec ON sec.ticker = yp.ticker AND fiscal_year = y_new)
SELECT ticker, y_old, y_new, anchor, coalesce(o.n, 0) AS n_old, coalesce(n.n, 0) AS n_new,
       CASE WHEN o.n IS NULL THEN 'added' WHEN n.n IS NULL THEN 'removed' ELSE 'both' END AS status
FROM o FULL JOIN n USING (ticker, y_old, y_new, anchor)""")
def section_pairs(spark, sf_dir):
    return P.section_pairs(documents(spark, sf_dir))


_PARAS_SQL = f"""{DOCS_SQL}, {_YP_SQL},
lines AS (
  SELECT ticker, fiscal_year, anchor, doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS ord,
         trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13)) AS text FROM docs),
paras AS (
  SELECT *, row_number() OVER (PARTITION BY ticker, fiscal_year, anchor ORDER BY doc_id, ord) - 1 AS idx
  FROM lines WHERE text <> '')"""


def _paras(spark, sf_dir):
    return P.explode_paragraphs(documents(spark, sf_dir), "doc_id", SEP)


@register("paragraphs", f"WITH {_PARAS_SQL} SELECT ticker, fiscal_year, anchor, idx, doc_id, text FROM paras")
def paragraphs(spark, sf_dir):
    return _paras(spark, sf_dir)


@register("exact_matches_across_years", f"""WITH {_PARAS_SQL},
o AS (SELECT yp.ticker, y_old, y_new, anchor, text, count(*) AS n_old, min(idx) AS first_old_idx
      FROM yp JOIN paras p ON p.ticker = yp.ticker AND fiscal_year = y_old GROUP BY ALL),
n AS (SELECT yp.ticker, y_old, y_new, anchor, text, count(*) AS n_new, min(idx) AS first_new_idx
      FROM yp JOIN paras p ON p.ticker = yp.ticker AND fiscal_year = y_new GROUP BY ALL)
SELECT * FROM o JOIN n USING (ticker, y_old, y_new, anchor, text)""")
def exact_matches_across_years(spark, sf_dir):
    paras = _paras(spark, sf_dir).drop("doc_id")
    return P.exact_matches(P.paired_sides(paras, P.year_pairs(documents(spark, sf_dir))))


# ---- text alignment: hashed token vectors, one-to-one matching, classes ------------------------------------

_WALK_SQL = """walk AS (
  SELECT *, false AS hit FROM cand
  UNION ALL
  SELECT {k}, oi, ni, s, hit FROM (
    SELECT *, max(CAST(hit AS INT)) OVER (PARTITION BY {k}, oi) AS od,
              max(CAST(hit AS INT)) OVER (PARTITION BY {k}, ni) AS nd FROM (
      SELECT {k}, oi, ni, s,
        row_number() OVER (PARTITION BY {k}, oi ORDER BY s DESC, ni) = 1 AND
        row_number() OVER (PARTITION BY {k}, ni ORDER BY s DESC, oi) = 1 AS hit
      FROM walk WHERE NOT hit)) WHERE hit OR (od = 0 AND nd = 0))"""

_TEXT_CAND_SQL = f"""{_PARAS_SQL},
toks AS (
  SELECT ticker, fiscal_year, anchor, idx, CAST('0x' || substr(md5(tok), 1, 2) AS INT) % 128 AS slot, count(*) AS n
  FROM (SELECT ticker, fiscal_year, anchor, idx, unnest(string_split(text, ' ')) AS tok FROM paras)
  WHERE tok <> '' GROUP BY ALL),
vec AS (SELECT *, n / sqrt(sum(n * n) OVER (PARTITION BY ticker, fiscal_year, anchor, idx)) AS w FROM toks),
cand AS (
  SELECT o.ticker, y_old, y_new, o.anchor, o.idx AS oi, n.idx AS ni, round(sum(o.w * n.w), 9) AS s
  FROM yp JOIN vec o ON o.ticker = yp.ticker AND o.fiscal_year = y_old
  JOIN vec n ON n.ticker = yp.ticker AND n.fiscal_year = y_new AND n.anchor = o.anchor AND n.slot = o.slot
  GROUP BY ALL HAVING round(sum(o.w * n.w), 9) >= 0.5)"""
_TEXT_ALIGN_SQL = f"""{_TEXT_CAND_SQL}, {_WALK_SQL.format(k='ticker, y_old, y_new, anchor')},
old_side AS (SELECT yp.ticker, y_old, y_new, anchor, idx AS oi, text FROM yp JOIN paras p
             ON p.ticker = yp.ticker AND fiscal_year = y_old),
new_side AS (SELECT yp.ticker, y_old, y_new, anchor, idx AS ni, text FROM yp JOIN paras p
             ON p.ticker = yp.ticker AND fiscal_year = y_new),
hits AS (SELECT ticker, y_old, y_new, anchor, oi, ni, s FROM walk WHERE hit),
aligned AS (
  SELECT ticker, y_old, y_new, anchor, 'matched' AS kind, oi AS old_idx, ni AS new_idx, s AS similarity,
         o.text AS old_text, n.text AS new_text
  FROM hits JOIN old_side o USING (ticker, y_old, y_new, anchor, oi)
  JOIN new_side n USING (ticker, y_old, y_new, anchor, ni)
  UNION ALL
  SELECT ticker, y_old, y_new, anchor, 'added', -1, ni, 0.0, '', text
  FROM new_side ANTI JOIN hits USING (ticker, y_old, y_new, anchor, ni)
  UNION ALL
  SELECT ticker, y_old, y_new, anchor, 'removed', oi, -1, 0.0, text, ''
  FROM old_side ANTI JOIN hits USING (ticker, y_old, y_new, anchor, oi))"""

# Number rules in SQL for texts without units, signs and citations: what the generated documents hold.
_CLASS_SQL = """CASE WHEN kind <> 'matched' THEN kind WHEN similarity >= 0.95 THEN 'unchanged'
  WHEN similarity >= 0.81 THEN 'modified_minor' WHEN similarity >= 0.60 THEN 'modified_major'
  ELSE 'modified_minor' END"""


def _records(spark, sf_dir, with_words=False):
    """Change records of the corpus; classes by similarity and text guard."""
    return diff_corpus(documents(spark, sf_dir), "doc_id", SEP, with_words=with_words)


def _aligned(spark, sf_dir, texts_out=True, **out):
    return align_corpus(documents(spark, sf_dir), "doc_id", SEP, texts_out=texts_out, **out)[0]


@register("text_alignment", f"WITH RECURSIVE {_TEXT_ALIGN_SQL} SELECT ticker, y_old, y_new, anchor, kind, old_idx, "
                            "new_idx, similarity FROM aligned")
def text_alignment(spark, sf_dir):
    return _aligned(spark, sf_dir, texts_out=False)


_RECORDS_SQL = f"""{_TEXT_ALIGN_SQL}, classed AS (SELECT *, {_CLASS_SQL} AS classification FROM aligned)"""


@register("diff_records")
def diff_records(spark, sf_dir):
    return _records(spark, sf_dir, with_words=True).select(
        *P.PAIR, "change_id", "change_seq", "classification", "similarity", "old_idx", "new_idx", "old_text",
        "new_text", F.col("word_delta.added").alias("words_added"), F.col("word_delta.removed").alias("words_removed"),
        F.col("numeric_guard.pct").alias("guard_pct"))


def _by_similarity(rows):
    return rows.withColumn("classification", F.when(
        F.col("kind") == "matched", C.classify_similarity(F.col("similarity"))).otherwise(F.col("kind")))


def _similarity_records(spark, sf_dir, texts_out=True):
    """Records classified by similarity alone, the part SQL can follow exactly."""
    return _by_similarity(_aligned(spark, sf_dir, texts_out))


CHARS = ("old_chars", "new_chars")


def _sized_records(spark, sf_dir):
    """The same records with the lengths of their texts in place of the texts: all that churn needs."""
    return _by_similarity(_aligned(spark, sf_dir, texts_out=False, chars_out=True))


_CHURN_SQL = """coalesce(
  sum(greatest(length(old_text), length(new_text))) FILTER (classification NOT IN ('unchanged', 'added', 'removed'))
  / nullif(sum(greatest(length(old_text), length(new_text))) FILTER (classification NOT IN ('added', 'removed')), 0), 0)"""


@register("section_churn", f"""WITH RECURSIVE {_RECORDS_SQL}
SELECT ticker, anchor, y_old, y_new, round({_CHURN_SQL}, 6) AS churn, count(*) AS n_records
FROM classed GROUP BY ALL""")
def section_churn(spark, sf_dir):
    return S.churn(_sized_records(spark, sf_dir), ["ticker", "anchor", "y_old", "y_new"], lengths=CHARS).withColumn(
        "churn", F.round("churn", 6))


@register("section_churn_matrix", f"""WITH RECURSIVE {_RECORDS_SQL},
c AS (SELECT ticker, anchor, y_new, round({_CHURN_SQL}, 2) AS churn FROM classed GROUP BY ALL)
SELECT ticker, anchor, """ + ", ".join(f"coalesce(max(churn) FILTER (y_new = '{y}'), 0) AS {y}" for y in FILING_YEARS[1:])
          + " FROM c GROUP BY ALL")
def section_churn_matrix(spark, sf_dir):
    return S.churn_matrix(_sized_records(spark, sf_dir), FILING_YEARS[1:], CHARS)


@register("section_stats", f"""WITH RECURSIVE {_RECORDS_SQL},
c AS (SELECT ticker, anchor, y_old, y_new, round({_CHURN_SQL}, 4) AS churn, count(*) AS n FROM classed GROUP BY ALL),
np AS (SELECT ticker, count(*) AS n_pairs FROM (SELECT DISTINCT ticker, y_old, y_new FROM classed) GROUP BY ticker)
SELECT ticker, anchor, anchor AS section_name, CAST(sum(n) AS BIGINT) AS n_records, max(churn) AS max_churn,
       round(sum(churn) / any_value(n_pairs), 4) AS avg_churn
FROM c JOIN np USING (ticker) GROUP BY ticker, anchor HAVING sum(n) >= 8""")
def section_stats(spark, sf_dir):
    return S.reported_sections(S.section_stats(_sized_records(spark, sf_dir), lengths=CHARS))


@register("top_churn", f"""WITH RECURSIVE {_RECORDS_SQL},
c AS (SELECT ticker, anchor, y_old, y_new, round({_CHURN_SQL}, 4) AS churn FROM classed GROUP BY ALL),
m AS (SELECT ticker, anchor, max(churn) AS max_churn FROM c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY max_churn DESC, anchor) AS rank FROM m)
SELECT * FROM r WHERE rank <= 2""")
def top_churn(spark, sf_dir):
    return S.top_churn(S.section_stats(_sized_records(spark, sf_dir), lengths=CHARS), 2).select(
        "ticker", "anchor", "max_churn", "rank")


@register("classification_rollup", f"""WITH RECURSIVE {_RECORDS_SQL}
SELECT y_old, y_new, classification, count(*) AS n FROM classed
GROUP BY GROUPING SETS ((y_old, y_new, classification), (classification))""")
def classification_rollup(spark, sf_dir):
    return S.classification_counts(_similarity_records(spark, sf_dir, texts_out=False), ["y_old", "y_new"])


@register("class_breakdown", f"""WITH RECURSIVE {_RECORDS_SQL},
c AS (SELECT classification, count(*) AS n FROM classed GROUP BY ALL)
SELECT list_position({dims.CLASSES!r}, classification) - 1 AS class_order, classification,
       CASE classification WHEN 'unchanged' THEN 'Unchanged' WHEN 'modified_minor' THEN 'Minor revision'
         WHEN 'modified_major' THEN 'Major revision' WHEN 'added' THEN 'Newly added' ELSE 'Removed' END AS label,
       n, round(n / sum(n) OVER () * 100, 1) AS pct FROM c""")
def class_breakdown(spark, sf_dir):
    return S.breakdown(_similarity_records(spark, sf_dir, texts_out=False))


@register("change_stats")
def change_stats(spark, sf_dir):
    """Counts need no numbering, and the text guard reads pairs alone that look unchanged and yet differ."""
    return S.change_stats(C.classify(_aligned(spark, sf_dir, alike=dims.UNCHANGED_AT)))


@register("change_ids", f"""WITH RECURSIVE {_RECORDS_SQL}, stems AS (
  SELECT *, ticker || '-' || anchor || '-' || y_old || '-' || y_new AS stem FROM classed),
seqs AS (SELECT ticker, anchor, y_old, y_new, old_idx, new_idx, classification, stem,
  row_number() OVER (PARTITION BY ticker, y_old, y_new, anchor
    ORDER BY CASE kind WHEN 'matched' THEN 0 WHEN 'added' THEN 1 ELSE 2 END, -similarity,
             CASE kind WHEN 'added' THEN new_idx ELSE old_idx END) - 1 AS seq
  FROM stems WHERE classification <> 'unchanged')
SELECT ticker, anchor, y_old, y_new, old_idx, new_idx, seq AS change_seq,
       stem || '-' || format('{{:03d}}', seq) AS change_id FROM seqs
UNION ALL
SELECT ticker, anchor, y_old, y_new, old_idx, new_idx, NULL, stem FROM stems WHERE classification = 'unchanged'""")
def change_ids(spark, sf_dir):
    rows, bounded = align_corpus(documents(spark, sf_dir), "doc_id", SEP, texts_out=False)
    rows = _by_similarity(rows)
    return C.assign_change_ids(rows, bounded_sections=bounded).select(
        "ticker", "anchor", "y_old", "y_new", "old_idx", "new_idx", "change_seq", "change_id")


def _cut_sql(c):
    """A text cut to 500 characters at the last blank."""
    return (f"CASE WHEN length({c}) <= 500 THEN {c} WHEN strpos(reverse(substr({c}, 1, 500)), ' ') BETWEEN 1 AND 499 "
            f"THEN substr({c}, 1, 500 - strpos(reverse(substr({c}, 1, 500)), ' ')) ELSE substr({c}, 1, 500) END")


@register("batches", f"""WITH RECURSIVE {_RECORDS_SQL}, seqs AS (
  SELECT *, row_number() OVER (PARTITION BY ticker, y_old, y_new, anchor
    ORDER BY CASE kind WHEN 'matched' THEN 0 WHEN 'added' THEN 1 ELSE 2 END, -similarity,
             CASE kind WHEN 'added' THEN new_idx ELSE old_idx END) - 1 AS seq
  FROM classed WHERE classification <> 'unchanged')
SELECT ticker, y_old, y_new, anchor, ticker || '-' || anchor || '-' || y_old || '-' || y_new || '-' || format('{{:03d}}', seq) AS change_id,
       seq AS change_seq, seq // 5 AS batch_no, classification, {_cut_sql("old_text")} AS old_text, {_cut_sql("new_text")} AS new_text
FROM seqs""")
def batches(spark, sf_dir):
    rows, bounded = align_corpus(documents(spark, sf_dir), "doc_id", SEP)
    return R.assign_batches(C.assign_change_ids(_by_similarity(rows), bounded_sections=bounded))


@register("change_ids_by_block", ORACLES["change_ids"])
def change_ids_by_block(spark, sf_dir):
    """The same numbering block by block, the way of sections too large for one task."""
    from redline.session import cut_lineage
    rows = cut_lineage(_by_similarity(_aligned(spark, sf_dir, texts_out=False)))
    return C.assign_change_ids(rows).select(
        "ticker", "anchor", "y_old", "y_new", "old_idx", "new_idx", "change_seq", "change_id")


@register("word_delta_multiset", f"""WITH RECURSIVE {_RECORDS_SQL},
m AS (SELECT * FROM classed WHERE kind = 'matched' AND old_text <> new_text),
t AS (SELECT ticker, anchor, y_old, y_new, old_idx, unnest(string_split(old_text, ' ')) AS token, -1 AS s FROM m
      UNION ALL SELECT ticker, anchor, y_old, y_new, old_idx, unnest(string_split(new_text, ' ')), 1 FROM m),
net AS (SELECT ticker, anchor, y_old, y_new, old_idx, token, sum(s) AS net FROM t WHERE token <> '' GROUP BY ALL)
SELECT ticker, anchor, y_old, y_new, old_idx, token, CAST(greatest(net, 0) AS BIGINT) AS n_added,
       CAST(greatest(-net, 0) AS BIGINT) AS n_removed FROM net WHERE net <> 0""")
def word_delta_multiset(spark, sf_dir):
    rows = _similarity_records(spark, sf_dir).filter("kind = 'matched' AND old_text <> new_text")
    return C.word_delta_multiset(rows, ["ticker", "anchor", "y_old", "y_new", "old_idx"], token="[^ ]+")


# ---- given vectors: label = section, even ids = old version, odd ids = new version -----------------------------

VEC_KEYS = ["label"]
VEC_FLOOR, VEC_UNCHANGED, VEC_MINOR, VEC_MAJOR = 0.15, 0.35, 0.25, 0.15


def _vector_sides(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("side", F.col("vec_id") % 2)
    # positions need ids only and are counted block by block; the vectors join back by id
    placed = rank_within(e.select("label", "side", "vec_id"), ["label", "side"], [F.col("vec_id")], "idx",
                         levels=[F.floor(F.col("vec_id") / BLOCK)])
    e = e.select("vec_id", F.col("embedding").cast("array<double>").alias("vector")).join(placed.hint("merge"), "vec_id")
    return tuple(e.filter(F.col("side") == s).select("label", "idx", "vector", "vec_id") for s in (0, 1))


_VEC_SQL = f"""sides AS (
  SELECT label, vec_id, vec_id % 2 AS side, CAST(embedding AS DOUBLE[]) AS v,
         row_number() OVER (PARTITION BY label, vec_id % 2 ORDER BY vec_id) - 1 AS idx FROM embeddings),
cand AS (
  SELECT o.label, o.idx AS oi, n.idx AS ni, round(list_dot_product(o.v, n.v), 9) AS s
  FROM sides o JOIN sides n ON o.label = n.label AND o.side = 0 AND n.side = 1
  WHERE round(list_dot_product(o.v, n.v), 9) >= {VEC_FLOOR})"""


@register("candidate_pairs", f"WITH {_VEC_SQL} SELECT label, oi AS old_idx, ni AS new_idx, s AS similarity FROM cand")
def candidate_pairs(spark, sf_dir):
    return M.candidate_pairs(*_vector_sides(spark, sf_dir), VEC_FLOOR, VEC_KEYS)


_VEC_MATCH_SQL = f"""{_VEC_SQL}, {_WALK_SQL.format(k='label')},
hits AS (SELECT label, oi, ni, s FROM walk WHERE hit),
aligned AS (
  SELECT label, 'matched' AS kind, oi AS old_idx, ni AS new_idx, s AS similarity FROM hits
  UNION ALL SELECT label, 'added', -1, idx, 0.0 FROM sides s ANTI JOIN hits h ON s.label = h.label AND s.idx = h.ni
            WHERE side = 1
  UNION ALL SELECT label, 'removed', idx, -1, 0.0 FROM sides s ANTI JOIN hits h ON s.label = h.label AND s.idx = h.oi
            WHERE side = 0)"""


@register("greedy_match", f"WITH RECURSIVE {_VEC_MATCH_SQL} SELECT * FROM aligned")
def greedy_match(spark, sf_dir):
    return M.align(*_vector_sides(spark, sf_dir), VEC_FLOOR, VEC_KEYS)


@register("greedy_match_distributed", f"WITH RECURSIVE {_VEC_MATCH_SQL} SELECT * FROM aligned")
def greedy_match_distributed(spark, sf_dir):
    """The same matching by rounds of tile products, the path of sections too large for one task."""
    return M.align(*_vector_sides(spark, sf_dir), VEC_FLOOR, VEC_KEYS, max_cells=0)


@register("classify_similarity", f"""WITH RECURSIVE {_VEC_MATCH_SQL}
SELECT label, old_idx, new_idx, similarity, CASE WHEN similarity >= {VEC_UNCHANGED} THEN 'unchanged'
  WHEN similarity >= {VEC_MINOR} THEN 'modified_minor' WHEN similarity >= {VEC_MAJOR} THEN 'modified_major'
  ELSE 'modified_minor' END AS classification FROM aligned WHERE kind = 'matched'""")
def classify_similarity(spark, sf_dir):
    return greedy_match(spark, sf_dir).filter("kind = 'matched'").select(
        "label", "old_idx", "new_idx", "similarity",
        C.classify_similarity(F.col("similarity"), VEC_UNCHANGED, VEC_MINOR, VEC_MAJOR).alias("classification"))


# ---- ordered token difference: sizes of a shortest edit script, by furthest-reaching paths in SQL -----------------------

@register("word_delta_sizes", f"""WITH RECURSIVE {_TEXT_ALIGN_SQL},
m AS MATERIALIZED (
  SELECT row_number() OVER () AS p, * FROM (
    SELECT ticker, y_old, y_new, anchor, old_idx,
           regexp_extract_all(old_text, '[\\pL\\pM\\pN\\p{{Pc}}]+|[^\\pL\\pM\\pN\\p{{Pc}}\\s]+') AS o,
           regexp_extract_all(new_text, '[\\pL\\pM\\pN\\p{{Pc}}]+|[^\\pL\\pM\\pN\\p{{Pc}}\\s]+') AS n
    FROM aligned WHERE kind = 'matched' AND old_text <> new_text)),
equal AS (
  SELECT a.p, a.x - b.y AS k, a.x FROM (SELECT p, unnest(o) AS t, generate_subscripts(o, 1) - 1 AS x FROM m) a
  JOIN (SELECT p, unnest(n) AS t, generate_subscripts(n, 1) - 1 AS y FROM m) b ON a.p = b.p AND a.t = b.t),
snake AS MATERIALIZED (
  SELECT p, k, x, max(x) OVER (PARTITION BY p, k, island) + 1 AS stop FROM (
    SELECT *, x - row_number() OVER (PARTITION BY p, k ORDER BY x) AS island FROM equal)),
path AS (
  SELECT m.p, 0 AS d, 0 AS k, coalesce(s.stop, 0) AS x, len(o) AS n_o, len(n) AS n_n,
         coalesce(s.stop, 0) = len(o) AND len(o) = len(n) AS done
  FROM m LEFT JOIN snake s ON s.p = m.p AND s.k = 0 AND s.x = 0
  UNION ALL
  SELECT f.p, f.d, f.k, coalesce(s.stop, f.x), f.n_o, f.n_n,
         coalesce(bool_or(coalesce(s.stop, f.x) = f.n_o AND f.k = f.n_o - f.n_n) OVER (PARTITION BY f.p), false)
  FROM (SELECT p, d + 1 AS d, k + dk AS k, max(x + dx) AS x, n_o, n_n
        FROM path, (VALUES (1, 1), (-1, 0)) step(dk, dx)
        WHERE NOT done AND x + dx <= n_o AND x + dx - k - dk <= n_n GROUP BY p, d, k + dk, n_o, n_n) f
  LEFT JOIN snake s ON s.p = f.p AND s.k = f.k AND s.x = f.x),
script AS (SELECT p, max(d) AS d FROM path GROUP BY p)
SELECT ticker, y_old, y_new, anchor, old_idx, (d + len(n) - len(o)) // 2 AS n_added, (d - len(n) + len(o)) // 2 AS n_removed
FROM m JOIN script USING (p)""")
def word_delta_sizes(spark, sf_dir):
    """Tokens that the shortest edit script of every matched pair adds and removes, over whole texts."""
    rows = _aligned(spark, sf_dir).filter("kind = 'matched' AND old_text <> new_text")
    return C.word_delta(rows).select("ticker", "y_old", "y_new", "anchor", "old_idx",
                                     F.size("word_delta.added").cast("long").alias("n_added"),
                                     F.size("word_delta.removed").cast("long").alias("n_removed"))
