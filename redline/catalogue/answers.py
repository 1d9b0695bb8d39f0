"""Answer routing, numbers, votes, model responses, evidence and citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from redline import dims
from redline.catalogue import register
from redline.catalogue.views import documents, table
from redline.functions import answers as A
from redline.functions import numbers as N
from redline.operators import evaluation as E
from redline.operators import evidence as EV
from redline.operators import responses as R
from redline.operators import stats as S
from redline.operators.once import compute_once

# ---- routing: assistant turns, reworded so that every route occurs -------------------------------------------

_SAID_SQL = """said AS (SELECT conv_id, turn, list_element(['corpus', 'abstain', 'web'], CAST(turn % 3 AS INT) + 1) AS expected_route,
  CASE (conv_id + turn) % 6 WHEN 1 THEN text || ' This is NOT MENTIONED.' WHEN 2 THEN text || ' Source: Web'
    WHEN 3 THEN '' WHEN 4 THEN 'I cannot find it [web] ' || text ELSE text END AS answer
  FROM conversations WHERE role = 'assistant'),
pred AS (SELECT *, CASE (conv_id + turn) % 6 WHEN 1 THEN 'abstain' WHEN 2 THEN 'web' WHEN 4 THEN 'web' ELSE 'corpus' END AS p FROM said)"""


def _said(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    m = (F.col("conv_id") + F.col("turn")) % 6
    text = F.col("text")
    return t.select("conv_id", "turn", F.get(F.array(F.lit("corpus"), F.lit("abstain"), F.lit("web")),
                                             (F.col("turn") % 3).cast("int")).alias("expected_route"),
                    F.when(m == 1, F.concat(text, F.lit(" This is NOT MENTIONED.")))
                    .when(m == 2, F.concat(text, F.lit(" Source: Web"))).when(m == 3, "")
                    .when(m == 4, F.concat(F.lit("I cannot find it [web] "), text)).otherwise(text).alias("answer"))


@register("answer_route", f"""WITH {_SAID_SQL}
SELECT conv_id, turn, CASE WHEN answer = '' THEN 'wrong' WHEN p = expected_route THEN 'correct'
         ELSE 'wrong(' || p || '->' || expected_route || ')' END AS route_result,
       answer = '' OR (conv_id + turn) % 6 IN (1, 4) AS abstains FROM pred""")
def answer_route(spark, sf_dir):
    return _said(spark, sf_dir).select("conv_id", "turn", A.route_result(F.col("answer"), F.col("expected_route")).alias(
        "route_result"), A.is_abstention(F.col("answer")).alias("abstains"))


@register("chosen_answer", f"""WITH {_SAID_SQL}, c AS (
  SELECT *, expected_route = 'web' AND (answer = '' OR (conv_id + turn) % 6 IN (1, 4)) AS fall FROM pred)
SELECT conv_id, turn, CASE WHEN NOT fall THEN answer WHEN conv_id % 2 = 0 THEN 'Found. [source: web]' ELSE 'See SOURCE: WEB' END AS answer,
       CASE WHEN fall THEN 'web' ELSE 'rag' END AS provenance FROM c""")
def chosen_answer(spark, sf_dir):
    second = F.when(F.col("conv_id") % 2 == 0, "Found.  ").otherwise("See SOURCE: WEB")
    return _said(spark, sf_dir).select("conv_id", "turn", A.choose_answer(
        F.col("answer"), second, F.col("expected_route")).alias("c")).select("conv_id", "turn", "c.*")


@register("answer_numbers", """WITH n AS (SELECT conv_id, turn, CASE WHEN conv_id BETWEEN 1900 AND 2099
      THEN [CAST(conv_id || '.' || turn AS DOUBLE) * 1e6, turn, turn / 100.0]
      ELSE [CAST(conv_id || '.' || turn AS DOUBLE) * 1e6, turn, turn / 100.0, 0.0 - conv_id * 1e3] END AS numbers
    FROM conversations)
SELECT conv_id, turn, generate_subscripts(numbers, 1) - 1 AS pos, unnest(numbers) AS number FROM n""")
def answer_numbers(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    c, n = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    text = F.concat(F.lit("Sales came to $"), c, F.lit("."), n, F.lit(" million, up "), n, F.lit("%, against ("), c,
                    F.lit(") elsewhere. "), F.col("text"), F.lit("\nCitations: [chunk 12, 7]"))
    return t.select("conv_id", "turn", F.posexplode(N.extract_numbers(text, F.lit(1e3))).alias("pos", "number"))


@register("numeric_signal", """WITH v AS (SELECT doc_id, doc_id % 97 + 1e0 AS a, (doc_id * 7) % 89 + 1e0 AS b, 100e0 AS c,
    100e0 + doc_id % 60 AS d FROM documents),
m AS (SELECT *, abs(b - a) / a AS m1, abs(d - c) / c AS m2 FROM v)
SELECT doc_id, CASE WHEN m1 >= m2 THEN a ELSE c END AS "old", CASE WHEN m1 >= m2 THEN b ELSE d END AS "new",
       round(greatest(m1, m2), 4) AS pct FROM m
WHERE greatest(m1, m2) >= 0.2 AND NOT ((a = b AND c = d) OR (a = d AND b = c))""")
def numeric_signal(spark, sf_dir):
    i = F.col("doc_id")
    words = F.regexp_replace("text", "[^a-zA-Z\n ]", "")

    def text(x, y):
        return F.concat(F.lit("Units "), x.cast("string"), F.lit(" and "), y.cast("string"), F.lit(". "),
                        F.regexp_replace(words, "(?i)loss|deficit|decrease|decline|negative|chunk", "x"))

    rows = documents(spark, sf_dir).select("doc_id", text(i % 97 + 1, F.lit(100)).alias("old_text"),
                                           text((i * 7) % 89 + 1, 100 + i % 60).alias("new_text"))
    numbers = compute_once(rows, o=N.extract_numbers(F.col("old_text")), n=N.extract_numbers(F.col("new_text")))
    moves = compute_once(numbers.select("doc_id", "o", "n"), s=N.move_signal(F.col("o"), F.col("n")))
    return moves.filter("s IS NOT NULL").select("doc_id", "s.*")


@register("document_numbers")
def document_numbers(spark, sf_dir):
    """Every number of every whole document."""
    return documents(spark, sf_dir).select("doc_id", N.extract_numbers(F.col("text")).alias("numbers"))


@register("majority_vote", """SELECT source, 2 * count(*) FILTER (quality = 1) > count(*) AS faithful,
  count(DISTINCT quality) > 1 AS disagreement, count(*) AS n_votes FROM labels JOIN documents USING (doc_id) GROUP BY source""")
def majority_vote(spark, sf_dir):
    votes = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return E.majority_vote(votes.withColumn("verdict", F.col("quality") == 1), ["source"])


@register("read_time", """SELECT source, CAST(sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) AS BIGINT) AS word_count,
  greatest(1, CAST(round_even(sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) / 220, 0) AS INT)) AS read_time
FROM documents GROUP BY source""")
def read_time(spark, sf_dir):
    return S.read_time(documents(spark, sf_dir).withColumnRenamed("ticker", "source"), ["source"])


# ---- interpretations: one per document, its language standing for a section -------------------------------------

_ANCHORS = {"en": "item1a_risk", "fr": "item7_mdna", "de": "item3_legal", "es": "item1_business"}
_CHAPTER = {"en": "risk", "fr": "mdna", "de": "legal", "es": "business"}


def _case(mapping):
    return "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


_INTERP_SQL = f"""interps AS (SELECT source AS ticker, {_case(_ANCHORS)} AS anchor, {_case(_CHAPTER)} AS chapter,
  'FY' || CAST(2021 + (doc_id // 20) % 4 AS VARCHAR) AS y_old, 'FY' || CAST(2022 + (doc_id // 20) % 4 AS VARCHAR) AS y_new,
  doc_id, source || '-' || {_case(_ANCHORS)} || '-' || format('{{:03d}}', doc_id) AS change_id,
  list_element(['material', 'notable', 'boilerplate'], CAST(doc_id % 3 AS INT) + 1) AS materiality,
  doc_id % 11 = 0 AS unvalidated, text AS summary FROM documents)"""


def _interpretations(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    anchor = F.create_map(*[F.lit(v) for kv in _ANCHORS.items() for v in kv])[F.col("lang")]
    year = (i / 20).cast("bigint") % 4
    return d.select(
        F.col("source").alias("ticker"), anchor.alias("anchor"), F.concat(F.lit("FY"), 2021 + year).alias("y_old"),
        F.concat(F.lit("FY"), 2022 + year).alias("y_new"), "doc_id",
        F.concat("source", F.lit("-"), anchor, F.lit("-"), F.format_string("%03d", i)).alias("change_id"),
        F.get(F.array(F.lit("material"), F.lit("notable"), F.lit("boilerplate")), (i % 3).cast("int")).alias("materiality"),
        (i % 11 == 0).alias("unvalidated"), F.col("text").alias("summary"),
        F.lit(None).cast("string").alias("why_it_matters"), F.lit("").alias("old_quote"), F.lit("").alias("new_quote"))


_POOL_SQL = f"""{_INTERP_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY ticker, chapter
    ORDER BY CASE materiality WHEN 'material' THEN 0 ELSE 1 END, y_new, doc_id) AS rank
  FROM interps WHERE NOT unvalidated AND materiality IN ('material', 'notable')),
pool AS (SELECT *, 'E' || CAST(rank AS VARCHAR) AS label FROM ranked WHERE rank <= 40)"""


@register("evidence_pool", f"WITH {_POOL_SQL} SELECT ticker, chapter, label, change_id, materiality, y_new FROM pool")
def evidence_pool(spark, sf_dir):
    return EV.evidence_pool(_interpretations(spark, sf_dir)).select("ticker", "chapter", "label", "change_id", "materiality", "y_new")


_NAMES_SQL = "CASE anchor " + " ".join(f"WHEN '{a}' THEN '{dims.SECTION_NAMES[a]}'" for a in _ANCHORS.values()) + " END"


@register("evidence_block", f"""WITH {_POOL_SQL}
SELECT ticker, chapter, string_agg('[' || label || '] ' || {_NAMES_SQL} || ' · ' || y_old || ' -> ' || y_new || chr(10) ||
  '  what changed: ' || summary, chr(10) || chr(10) ORDER BY rank) AS text FROM pool GROUP BY ticker, chapter""")
def evidence_block(spark, sf_dir):
    return EV.evidence_block(EV.evidence_pool(_interpretations(spark, sf_dir)))


# A chapter text cites two labels per evidence row: the row's number in reverse and one that may not exist.
_CITES_SQL = f"""{_POOL_SQL}, cites AS (
  SELECT ticker, chapter, 2 * rank AS pos, 'E' || CAST((rank * 7) % 30 + 1 AS VARCHAR) AS label FROM pool
  UNION ALL SELECT ticker, chapter, 2 * rank + 1, 'E' || CAST(rank * 2 AS VARCHAR) FROM pool),
firsts AS (SELECT ticker, chapter, label, min(pos) AS pos FROM cites GROUP BY ALL),
notes AS (SELECT f.ticker, f.chapter, f.label, p.change_id, row_number() OVER (PARTITION BY f.ticker, f.chapter ORDER BY f.pos) AS n
  FROM firsts f JOIN pool p USING (ticker, chapter, label))"""


def _cited(spark, sf_dir):
    pool = EV.evidence_pool(_interpretations(spark, sf_dir))
    mark = F.concat(F.lit("Up [E"), ((F.col("rank") * 7) % 30 + 1).cast("string"), F.lit("] and [E"),
                    (F.col("rank") * 2).cast("string"), F.lit("]."))
    texts = pool.groupBy("ticker", "chapter").agg(F.array_sort(F.collect_list(F.struct("rank", mark.alias("m")))).alias("ms"))
    return texts.select("ticker", "chapter", F.array_join(F.transform("ms", lambda x: x["m"]), " ").alias("text")), pool


@register("citations", f"WITH {_CITES_SQL} SELECT ticker, chapter, n, label, change_id FROM notes")
def citations(spark, sf_dir):
    return EV.resolve_citations(*_cited(spark, sf_dir), ["ticker", "chapter"])


@register("renumbered_citations", f"""WITH {_CITES_SQL}
SELECT p.ticker, p.chapter, string_agg('Up ' || coalesce('[' || CAST(a.n AS VARCHAR) || ']', '') || ' and ' ||
  coalesce('[' || CAST(b.n AS VARCHAR) || ']', '') || '.', ' ' ORDER BY rank) AS text
FROM pool p LEFT JOIN notes a ON a.ticker = p.ticker AND a.chapter = p.chapter AND a.label = 'E' || CAST((p.rank * 7) % 30 + 1 AS VARCHAR)
LEFT JOIN notes b ON b.ticker = p.ticker AND b.chapter = p.chapter AND b.label = 'E' || CAST(p.rank * 2 AS VARCHAR)
GROUP BY p.ticker, p.chapter""")
def renumbered_citations(spark, sf_dir):
    texts, pool = _cited(spark, sf_dir)
    keys = ["ticker", "chapter"]
    return EV.renumber_citations(texts, EV.resolve_citations(texts, pool, keys), keys)


@register("materiality_counts", f"""WITH {_INTERP_SQL}
SELECT ticker, count(*) FILTER (NOT unvalidated AND materiality = 'material') AS material,
  count(*) FILTER (NOT unvalidated AND materiality = 'notable') AS notable,
  count(*) FILTER (NOT unvalidated AND materiality = 'boilerplate') AS boilerplate, count(*) FILTER (unvalidated) AS unvalidated,
  count(*) FILTER (NOT unvalidated AND materiality <> 'boilerplate') AS surfaced FROM interps GROUP BY ticker""")
def materiality_counts(spark, sf_dir):
    return S.materiality_counts(_interpretations(spark, sf_dir), ["ticker"])


@register("validation_rate", f"""WITH {_INTERP_SQL}
SELECT ticker, anchor, count(*) FILTER (NOT unvalidated) AS n_valid, count(*) AS n_total FROM interps GROUP BY ALL""")
def validation_rate(spark, sf_dir):
    return S.validation_rate(_interpretations(spark, sf_dir), ["ticker", "anchor"])


# ---- responses: batches of five documents answered as JSON, with every kind of fault ---------------------------------
# Document d: d mod 10 = 0 is left out, 1 quotes text that is not there, 2 has an unknown type, 3 an unknown
# materiality; batches whose number ends in 9 time out. The retry repairs faults 1 and leaves the others as they were.

RK = ["ticker"]


def _changes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    # per source, documents are numbered by their position: doc_id counts sources round robin
    return d.select(F.col("source").alias("ticker"), "doc_id", (F.col("doc_id") / 100).cast("bigint").alias("batch_no"),
                    F.concat("source", F.lit("-"), F.format_string("%03d", F.col("doc_id") + 1)).alias("change_id"),
                    F.col("text").alias("old_text"), F.reverse("text").alias("new_text"))


def _quote(text):
    """Twenty characters from a place anywhere in the text that depends on the document."""
    at = F.pmod(F.col("doc_id") * 7919, F.greatest(F.length(text) - 20, F.lit(1))) + 1
    return F.substring(F.col(text), at.cast("int"), F.lit(20))


def _response_text(changes, retry):
    m = F.col("doc_id") % 10
    quote = F.when((m == 1) & F.lit(not retry), "no such words").otherwise(_quote("old_text"))
    item = F.to_json(F.struct(
        "change_id", F.when(m == 2, "improved").otherwise("expanded").alias("change_type"),
        F.when(m == 3, "huge").otherwise("notable").alias("materiality"), F.lit("s").alias("summary"),
        F.lit("w").alias("why_it_matters"), quote.alias("old_quote"), _quote("new_text").alias("new_quote")))
    # a batch holds five documents
    items = changes.filter(m != 0).groupBy("ticker", "batch_no").agg(
        F.array_join(F.array_sort(F.collect_list(item)), ",").alias("items"))
    b = F.col("batch_no") % 3
    text = F.when(F.col("batch_no") % 10 == 9, "[TIMEOUT] no answer").when(
        b == 0, F.concat(F.lit("```json\n["), F.col("items"), F.lit("]\n```"))).when(
        b == 1, F.concat(F.lit("Here it is: ["), F.col("items"), F.lit("] as asked."))).otherwise(
        F.concat(F.lit("["), F.col("items"), F.lit("]")))
    return items.select("ticker", "batch_no", text.alias("text"))


_RESPONSE_SQL = """c AS (SELECT source AS ticker, doc_id, doc_id // 100 AS b, doc_id % 10 AS m,
  source || '-' || format('{:03d}', doc_id + 1) AS change_id FROM documents),
state AS (SELECT *, b % 10 = 9 AS lost, m = 0 AS silent FROM c WHERE (ticker, b) IN (SELECT (ticker, b) FROM c WHERE m <> 0)
          UNION ALL SELECT *, false, true FROM c WHERE (ticker, b) NOT IN (SELECT (ticker, b) FROM c WHERE m <> 0))"""


@register("reconciled_responses", f"""WITH {_RESPONSE_SQL}
SELECT ticker, change_id, CASE WHEN lost OR silent THEN 'reworded' WHEN m = 2 THEN 'improved' ELSE 'expanded' END AS change_type,
  CASE WHEN lost OR silent THEN 'boilerplate' WHEN m = 3 THEN 'huge' ELSE 'notable' END AS materiality,
  CASE WHEN lost THEN 'LLM call failed: [TIMEOUT] no answer' WHEN silent THEN 'LLM did not interpret this change' ELSE 's' END AS summary,
  lost OR silent OR m IN (2, 3) AS unvalidated, NOT lost AND NOT silent AND m = 1 AS validated_on_retry,
  CASE WHEN lost OR silent THEN NULL WHEN m = 2 THEN 'invalid change_type: improved' WHEN m = 3 THEN 'invalid materiality: huge' END AS validation_error
FROM state""")
def reconciled_responses(spark, sf_dir):
    changes = _changes(spark, sf_dir)
    first, retry = _response_text(changes, False), _response_text(changes, True).filter("NOT startswith(text, '[TIMEOUT]')")
    return R.reconcile(changes, first, changes, retry, RK).select(
        "ticker", "change_id", "change_type", "materiality", "summary", "unvalidated", "validated_on_retry", "validation_error")


@register("validated_responses", """WITH c AS (SELECT source || '-' || format('{:03d}', doc_id + 1) AS change_id, doc_id % 10 AS m
  FROM documents WHERE doc_id % 10 <> 0 AND (doc_id // 100) % 10 <> 9)
SELECT change_id, m NOT IN (1, 2, 3) AS ok, CASE m WHEN 1 THEN 'old_quote not in old_text: ''no such words'''
  WHEN 2 THEN 'invalid change_type: improved' WHEN 3 THEN 'invalid materiality: huge' END AS error FROM c""")
def validated_responses(spark, sf_dir):
    changes = _changes(spark, sf_dir)
    rows = _response_text(changes, False).select(F.explode(R.parse_responses(F.col("text"))).alias("r")).select("r.*")
    return R.validate_responses(rows, changes).select("change_id", "ok", "error")


@register("vote_report", """WITH v AS (SELECT source, 2 * count(*) FILTER (quality = 1) > count(*) AS f, count(DISTINCT quality) > 1 AS d
  FROM labels JOIN documents USING (doc_id) GROUP BY source)
SELECT count(*) AS judged, count(*) FILTER (f) AS faithful, count(*) FILTER (d) AS disagreed FROM v""")
def vote_report(spark, sf_dir):
    return E.vote_report(majority_vote(spark, sf_dir))


@register("guarded_evidence", f"""WITH {_POOL_SQL}
SELECT ticker, chapter, label, change_id, CASE WHEN doc_id % 5 = 0 THEN doc_id / 100.0 END AS guard_pct FROM pool""")
def guarded_evidence(spark, sf_dir):
    rows = _interpretations(spark, sf_dir)
    guard = F.struct(F.lit("text").alias("source"), (F.col("doc_id") / 100.0).alias("pct"))
    diffs = rows.select("change_id", F.when(F.col("doc_id") % 5 == 0, guard).alias("numeric_guard"))
    pool = EV.evidence_pool(rows)
    return R.attach_guard(pool, diffs).select("ticker", "chapter", "label", "change_id", F.col("numeric_guard.pct").alias("guard_pct"))


@register("cited_scale", """WITH h AS (SELECT conv_id, turn + 1 AS rank, CASE WHEN turn % 2 = 1 THEN conv_id % 4 * 1000e0 END AS table_scale FROM conversations)
SELECT conv_id, min_by(table_scale, rank) FILTER (rank <= 3 AND table_scale <> 0) AS table_scale FROM h GROUP BY conv_id""")
def cited_scale(spark, sf_dir):
    hits = table(spark, sf_dir, "conversations").select(
        "conv_id", (F.col("turn") + 1).alias("rank"), F.when(F.col("turn") % 2 == 1, F.col("conv_id") % 4 * 1000.0).alias("table_scale"))
    return E.cited_scale(hits, ["conv_id"])
