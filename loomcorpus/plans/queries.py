"""The engine's own queries over the tables of a folder, and their SQL.

Stand-ins: documents are sections (source, lang), embeddings are index rows (label as category), labels
are judge scores and expectation flags, pages are book chapters, events are the request log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcorpus.functions import text as T
from loomcorpus.operators import cells, chunk, index, judge, label, metrics, report, retrieve
from loomcorpus.plans import evaluate
from loomcorpus.providers import batch_numbers, completed, embedded, overlap_judge
from loomcorpus.sources import acquire, html, pdf, rst
from loomcorpus.sources.shared import shared_dir
from loomcorpus.sources.shared import stored as stored_frame

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
K, MOST, OVERLAP = 10, 120, 20


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def sections(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select(
        F.col("doc_id").alias("doc_ord"), "text", F.col("lang").alias("source_type"), F.col("source").alias("source_name"), F.concat("source", F.lit(".rst")).alias("original_path"), F.array("lang").alias("section_hierarchy")
    )


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def asked(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: rows whose id is divisible by 20."""
    return vectors(spark, d).filter("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")


def ranked(spark: SparkSession, d: str, k: int = K) -> DataFrame:
    return retrieve.topk(vectors(spark, d), asked(spark, d), k)


def truth(spark: SparkSession, d: str) -> DataFrame:
    """For each query the three smallest ids of its label; labels 0 and 1 have none."""
    w = "row_number() OVER (PARTITION BY label ORDER BY chunk_id)"
    low = vectors(spark, d).filter("label > 1").selectExpr("chunk_id", "label", f"{w} AS r").filter("r <= 3")
    return asked(spark, d).select("query_id", "label").join(F.broadcast(low), "label").select("query_id", "chunk_id")  # three ids a label


_RANK = """
q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e, label FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id AS chunk_id, list_cosine_similarity(q.e, v.embedding::DOUBLE[]) AS c FROM q, embeddings v{where}),
r AS (SELECT query_id, chunk_id, greatest(0, least(1, c)) AS score, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, chunk_id) AS rank FROM s QUALIFY rank <= {k})"""
_TRUTH = """,
low AS (SELECT vec_id, label FROM embeddings WHERE label > 1 QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 3),
w AS (SELECT query_id, vec_id AS chunk_id FROM q JOIN low USING (label)),
m AS (SELECT q.query_id, q.label, count(w.chunk_id) AS n, count(r.chunk_id) AS h, min(r.rank) AS first FROM q LEFT JOIN w USING (query_id) LEFT JOIN r ON r.query_id = w.query_id AND r.chunk_id = w.chunk_id GROUP BY ALL),
p AS (SELECT query_id, label, CASE WHEN n > 0 THEN h / n END AS recall, CASE WHEN n > 0 THEN coalesce(1.0 / first, 0) END AS rr, n FROM m)"""


def _rank(k: int = K, where: str = "") -> str:
    return "WITH " + _RANK.format(k=k, where=where)


def _out(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


@query("q_topk_cosine", _rank() + " SELECT query_id, rank::INT AS rank, chunk_id, round(score, 6) AS score FROM r")
def q_topk(spark, d):
    return _out(ranked(spark, d))


@query("q_topk_filtered", _rank(5, " WHERE v.label IN (2, 3)") + " SELECT query_id, rank::INT AS rank, chunk_id, round(score, 6) AS score FROM r")
def q_topk_filtered(spark, d):
    return _out(retrieve.topk(retrieve.source_filter(vectors(spark, d), "label", [2, 3]), asked(spark, d), 5))


def _cells(spark, d, **more):
    path = shared_dir(spark)
    cells.build(vectors(spark, d), path)
    return _out(cells.search(spark, path, asked(spark, d), K, **more))


@query("q_topk_cells")
def q_topk_cells(spark, d):
    """The approximate index over all vectors: as many cells and candidates as it has measured that it needs."""
    return _cells(spark, d)


@query("q_cells_filtered", _rank(where=" WHERE v.label IN (2, 3)") + " SELECT query_id, rank::INT AS rank, chunk_id, round(score, 6) AS score FROM r")
def q_cells_filtered(spark, d):
    """The approximate index with all cells and candidates taken, and so exact, of two labels."""
    return _cells(spark, d, where=F.col("label").isin(2, 3), probes=1 << 30, candidates=1 << 30)


@query("q_score_bands", _rank() + " SELECT query_id, rank::INT AS rank, CASE WHEN round(score, 6) >= 0.8 THEN 'high' WHEN round(score, 6) >= 0.65 THEN 'medium' ELSE 'low' END AS band FROM r")
def q_bands(spark, d):
    return _out(ranked(spark, d)).select("query_id", "rank", T.band(F.col("score"), 0.8, 0.65).alias("band"))


def _metrics(spark, d):
    return metrics.per_query(ranked(spark, d), truth(spark, d), asked(spark, d), K)


@query("q_recall_mrr_per_query", _rank() + _TRUTH + " SELECT query_id, round(recall, 6) AS recall_at_k, round(rr, 6) AS mrr, 10::INT AS k, n::BIGINT AS num_relevant FROM p")
def q_metrics(spark, d):
    return _metrics(spark, d).withColumns({"recall_at_k": F.round("recall_at_k", 6), "mrr": F.round("mrr", 6)})


@query("q_macro_means", _rank() + _TRUTH + " SELECT round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr, count(recall) AS n FROM p")
def q_macro(spark, d):
    return metrics.macro_means(_metrics(spark, d)).withColumns({"recall": F.round("recall", 6), "mrr": F.round("mrr", 6)})


@query("q_metric_gate_nulls", _rank() + _TRUTH + " SELECT count(*) AS n, count(*) - count(recall) AS n_null FROM p")
def q_gate(spark, d):
    return _metrics(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("recall_at_k").isNull()).alias("n_null"))


@query("q_mrr_by_category", _rank() + _TRUTH + " SELECT label, count(*) AS n, round(coalesce(avg(rr), 0), 6) AS mrr, round(coalesce(avg(recall), 0), 6) AS recall FROM p GROUP BY label")
def q_by_category(spark, d):
    rows = _metrics(spark, d).join(asked(spark, d).select("query_id", "label"), "query_id")
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.avg("mrr"), F.lit(0.0)), 6).alias("mrr"), F.round(F.coalesce(F.avg("recall_at_k"), F.lit(0.0)), 6).alias("recall"))


@query("q_recall_by_category", _rank() + _TRUTH + """, h AS (SELECT w.query_id, count_if(r.rank <= 5) AS h5, count_if(r.rank <= 10) AS h10 FROM w LEFT JOIN r ON r.query_id = w.query_id AND r.chunk_id = w.chunk_id GROUP BY ALL)
SELECT label, count_if(n > 0)::BIGINT AS n, round(coalesce(avg(rr), 0), 6) AS mrr, round(coalesce(avg(coalesce(h5, 0) / nullif(n, 0)), 0), 6) AS recall_5, round(coalesce(avg(coalesce(h10, 0) / nullif(n, 0)), 0), 6) AS recall_10 FROM p LEFT JOIN h USING (query_id) GROUP BY label""")
def q_recall_by_category(spark, d):
    rows = metrics.by_category(ranked(spark, d), truth(spark, d), asked(spark, d), "label", K)
    return rows.withColumns({c: F.round(c, 6) for c in ("mrr", "recall_5", "recall_10")})


@query("q_recall_at_ks", _rank() + _TRUTH + """, ks AS (SELECT unnest([1, 3, 5, 10]) AS k),
x AS (SELECT k, w.query_id, count(r.chunk_id) / count(*) AS f FROM ks, w LEFT JOIN r ON r.query_id = w.query_id AND r.chunk_id = w.chunk_id AND r.rank <= k GROUP BY ALL)
SELECT k::INT AS k, round(avg(f), 6) AS recall FROM x GROUP BY k""")
def q_ks(spark, d):
    return metrics.recall_at_ks(ranked(spark, d), truth(spark, d), [1, 3, 5, 10]).withColumn("recall", F.round("recall", 6))


_SENT = r"""list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda z: regexp_replace(z, '^\s+|\s+$', '', 'g')), lambda z: z <> '')"""
_TOK = r"len(list_filter(regexp_split_to_array({0}, '\s+'), lambda z: z <> ''))"


@query("q_sentence_split", f"SELECT doc_id, i::INT AS pos, s AS sentence FROM (SELECT doc_id, unnest({_SENT}) AS s, unnest(range(len({_SENT}))) AS i FROM documents)")
def q_sentences(spark, d):
    return t(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


@query("q_token_count", f"SELECT doc_id, {_TOK.format('text')}::INT AS tokens FROM documents")
def q_tokens(spark, d):
    return t(spark, d, "documents").select("doc_id", T.token_count(F.col("text")).alias("tokens"))


def _pack_sql(overlap: int) -> str:
    return rf"""
WITH RECURSIVE a AS (SELECT doc_id, {_SENT} AS s FROM documents),
b AS (SELECT doc_id, s, list_transform(s, lambda z: {_TOK.format('z')}) AS n FROM a),
f AS (
  SELECT doc_id, 0 AS i, 1 AS st, 0::BIGINT AS t, NULL::VARCHAR AS e1, NULL::VARCHAR AS e2 FROM b
  UNION ALL
  SELECT doc_id, i + 1,
    CASE WHEN big THEN i + 2 WHEN spill THEN carry ELSE st END,
    CASE WHEN big THEN 0 WHEN spill THEN coalesce(list_sum(n[carry:i]), 0) + n[i + 1] ELSE t + n[i + 1] END::BIGINT,
    CASE WHEN (big OR spill) AND st <= i THEN array_to_string(s[st:i], ' ') END,
    CASE WHEN big THEN s[i + 1] END
  FROM (SELECT *, n[i + 1] > {MOST} AS big, t + n[i + 1] > {MOST} AS spill,
          coalesce(list_min(list_filter(range(st, i + 1), lambda j: coalesce(list_sum(n[j:i]), 0) <= {overlap})), i + 1) AS carry
        FROM f JOIN b USING (doc_id) WHERE i < len(s))),
o AS (
  SELECT doc_id, i * 2 AS o, e1 AS chunk FROM f WHERE e1 IS NOT NULL
  UNION ALL SELECT doc_id, i * 2 + 1, e2 FROM f WHERE e2 IS NOT NULL
  UNION ALL SELECT doc_id, i * 2 + 2, array_to_string(s[st:], ' ') FROM f JOIN b USING (doc_id) WHERE i = len(s) AND st <= i)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1)::INT AS pos, chunk FROM o"""


@query("q_chunk_pack", _pack_sql(0))
def q_pack(spark, d):
    return t(spark, d, "documents").select("doc_id", F.posexplode(chunk.packed(T.atoms(F.col("text")), MOST, 0)).alias("pos", "chunk"))


@query("q_chunk_overlap", _pack_sql(OVERLAP))
def q_overlap(spark, d):
    return t(spark, d, "documents").select("doc_id", F.posexplode(chunk.packed(T.atoms(F.col("text")), MOST, OVERLAP)).alias("pos", "chunk"))


_OCC = "SELECT doc_id, source || '.rst' AS path, lang AS section, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1 AS occurrence FROM documents"


@query("q_occurrence", f"SELECT doc_id, occurrence::INT AS occurrence FROM ({_OCC})")
def q_occurrence(spark, d):
    return _placed(spark, d).select("doc_id", "occurrence")


def _placed(spark, d):
    rows = sections(spark, d).drop("text").withColumn("section_path", chunk.section_path(F.col("section_hierarchy"), F.col("source_name")))
    return chunk.with_occurrence(rows).withColumnRenamed("doc_ord", "doc_id")


@query("q_chunk_ids", f"SELECT doc_id, left(md5(path || '::' || section || '::' || occurrence), 8) AS path_hash FROM ({_OCC})")
def q_ids(spark, d):
    return _placed(spark, d).select("doc_id", chunk.path_hash(F.col("original_path"), F.col("section_path"), F.col("occurrence")).alias("path_hash"))


@query("q_id_uniqueness", f"""SELECT chunk_id, count(*) AS n, numbered FROM (SELECT path || '::' || section || '::' || occurrence AS chunk_id, true AS numbered FROM ({_OCC}) UNION ALL SELECT path || '::' || section, false FROM ({_OCC}))
GROUP BY chunk_id, numbered HAVING count(*) > 1""")
def q_unique(spark, d):
    """Ids that repeat: none with the occurrence number, many without it."""
    rows = _placed(spark, d)
    path = F.concat_ws("::", "original_path", "section_path")
    numbered = chunk.repeated_ids(rows.select(F.concat_ws("::", path, F.col("occurrence").cast("string")).alias("chunk_id"))).withColumn("numbered", F.lit(True))
    return numbered.unionByName(chunk.repeated_ids(rows.select(path.alias("chunk_id"))).withColumn("numbered", F.lit(False)))


def _counted(spark, d):
    return sections(spark, d).select("source_type", "source_name", T.token_count(F.col("text")).alias("token_count"))


_COUNTED = f"c AS (SELECT lang AS source_type, source AS source_name, {_TOK.format('text')} AS n FROM documents)"


@query("q_ingest_summary", f"WITH {_COUNTED} SELECT coalesce(source_type, 'TOTAL') AS source_type, count(*) AS n, floor(sum(n) / count(*))::BIGINT AS mean_tokens, sum(n)::BIGINT AS tokens FROM c GROUP BY ROLLUP (source_type)")
def q_summary(spark, d):
    return report.ingest_summary(_counted(spark, d))


@query("q_corpus_table", f"""WITH {_COUNTED}, p AS (SELECT source_type, count(DISTINCT source_name) AS files, count(*) AS chunks, sum(n)::BIGINT AS tokens FROM c GROUP BY source_type),
u AS (SELECT * FROM p UNION ALL SELECT 'TOTAL', sum(files)::BIGINT, sum(chunks)::BIGINT, sum(tokens)::BIGINT FROM p) SELECT source_type, files, chunks, round_even(tokens / chunks, 0) AS mean_tokens, tokens FROM u""")
def q_corpus(spark, d):
    return report.corpus_table(_counted(spark, d))


@query("q_source_sizes", "SELECT coalesce(source, 'TOTAL') AS source, count(*) AS files, sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents GROUP BY ROLLUP (source)")
def q_sizes(spark, d):
    return report.source_sizes(t(spark, d, "documents").select("source", F.octet_length("text").alias("bytes")))


@query("q_incremental_new", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q_new(spark, d):
    return index.missing(t(spark, d, "documents").select("doc_id", "source"), t(spark, d, "labels"), "doc_id")


@query("q_upsert", "SELECT doc_id, quality, toxic FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en') UNION ALL SELECT doc_id, -1 AS quality, 0 AS toxic FROM documents WHERE lang = 'en'")
def q_upsert(spark, d):
    new = t(spark, d, "documents").filter("lang = 'en'").select("doc_id", F.lit(-1).alias("quality"), F.lit(0).alias("toxic"))  # a delivery of English rows
    return index.upserted(t(spark, d, "labels").select("doc_id", "quality", "toxic"), new, "doc_id")


@query("q_resume", "SELECT d.doc_id AS id, source FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.toxic = 0 WHERE l.doc_id IS NULL")
def q_resume(spark, d):
    done = t(spark, d, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "failed").alias("error"))
    return index.remaining(t(spark, d, "documents").select(F.col("doc_id").alias("id"), "source"), done, retry_errors=True)


@query("q_rate_window", """WITH w AS (SELECT event_id, user_id, epoch_us(ts) AS u, length(props) AS n FROM events)
SELECT event_id, count(*) OVER x AS n_window, (sum(n) OVER x)::BIGINT AS tokens_window, count(*) OVER x > 3 OR sum(n) OVER x > 30 AS breach FROM w WINDOW x AS (PARTITION BY user_id ORDER BY u RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)""")
def q_rate(spark, d):
    log = t(spark, d, "events").select("event_id", F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), F.length("props").alias("tokens"))
    return report.rate_window(log, 86400, 3, 30).select("event_id", "n_window", "tokens_window", "breach")


_ANSWER = "text || CASE WHEN conv_id % 3 = 0 THEN ' [1, ' || turn || '] and [2].' WHEN conv_id % 3 = 1 THEN ' I CANNOT answer [x] [0].' ELSE '' END"


def answers(spark, d):
    mark = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit(" [1, "), F.col("turn").cast("string"), F.lit("] and [2]."))).when(F.col("conv_id") % 3 == 1, F.lit(" I CANNOT answer [x] [0].")).otherwise(F.lit(""))
    return t(spark, d, "conversations").select("conv_id", "turn", F.concat("text", mark).alias("answer"))


@query("q_citations", f"""SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_transform(flatten(list_transform(regexp_extract_all({_ANSWER}, '\\[(\\d+(?:,\\s*\\d+)*)\\]', 1), lambda m: regexp_split_to_array(m, ',\\s*'))), lambda z: z::INT))), ',') AS cited FROM conversations""")
def q_citations(spark, d):
    return answers(spark, d).select("conv_id", "turn", F.array_join(T.citations(F.col("answer")).cast("array<string>"), ",").alias("cited"))


@query("q_abstain_flag", f"""SELECT conv_id, turn, regexp_matches({_ANSWER}, '(?i)does not contain enough information|cannot answer|can[''’]t answer|unable to answer|not enough information|insufficient (context|information)') AS abstained FROM conversations""")
def q_abstain(spark, d):
    return answers(spark, d).select("conv_id", "turn", T.abstained(F.col("answer")).alias("abstained"))


@query("q_cited_sources", _rank(5) + ", c AS (SELECT query_id, unnest([1, (query_id // 20 % 7)::INT, 3]) AS rank FROM q WHERE query_id // 20 % 4 <> 1) SELECT DISTINCT r.query_id, r.rank::INT AS rank, chunk_id FROM r JOIN (SELECT DISTINCT * FROM c) c ON c.query_id = r.query_id AND c.rank = r.rank")
def q_cited(spark, d):
    """Every fourth answer abstains, and so cites nothing."""
    i = F.floor(F.col("query_id") / 20)
    made = asked(spark, d).select("query_id", F.array(F.lit(1), (i % 7).cast("int"), F.lit(3)).alias("citations_used"), (i % 4 == 1).alias("abstained"))
    return retrieve.cited(ranked(spark, d, 5), made).select("query_id", "rank", "chunk_id")


@query("q_context_block", _rank(3) + " SELECT query_id, string_agg('[' || rank || '] Source: ' || source || ' | Section: ' || lang || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context FROM r JOIN documents ON doc_id = chunk_id GROUP BY query_id")
def q_context(spark, d):
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("source_name"), F.col("lang").alias("section_path"))
    hits = ranked(spark, d, 3).join(docs, "chunk_id")
    return retrieve.context(hits)


@query("q_json_extract", "SELECT event_id, json_extract_string(props, '$.k')::DOUBLE AS k FROM events")
def q_json(spark, d):
    raw = F.concat(F.lit("Here: ```json\n"), F.col("props"), F.lit("\n``` done"))
    return t(spark, d, "events").select("event_id", F.try_variant_get(T.judge_json(raw), "$.k", "double").alias("k"))


@query("q_score_coerce", "SELECT event_id, CASE WHEN v <= 0.25 THEN 0.0 WHEN v <= 0.75 THEN 0.5 ELSE 1.0 END::DOUBLE AS score FROM (SELECT event_id, json_extract_string(props, '$.k')::DOUBLE / 100 AS v FROM events)")
def q_coerce(spark, d):
    return t(spark, d, "events").select("event_id", T.faith_score((F.get_json_object("props", "$.k").cast("double") / 100).cast("string")).alias("score"))


def results(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return t(spark, d, "labels").join(docs, "doc_id").select(F.col("doc_id").alias("id"), F.col("lang").alias("category"), (F.col("toxic") == 1).alias("should_abstain"), (F.col("quality") == 0).alias("abstained"), (F.col("n_chars") % 5 + 1).alias("rag"), F.when(F.col("doc_id") % 7 != 0, F.col("n_chars") % 4 + 1).alias("base"), "quality")


_RES = "WITH x AS (SELECT doc_id AS id, lang AS category, toxic = 1 AS should_abstain, quality = 0 AS abstained, n_chars % 5 + 1 AS rag, CASE WHEN doc_id % 7 <> 0 THEN n_chars % 4 + 1 END AS base, quality FROM labels JOIN documents USING (doc_id))"


@query("q_score_distribution", _RES + " SELECT rag AS score, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS pct FROM x GROUP BY rag")
def q_distribution(spark, d):
    return report.distribution(results(spark, d).select(F.col("rag").alias("score")), "score")


@query("q_category_means", _RES + " SELECT category, count(*) AS n, round(avg(base), 6) AS mean, count(*) - count(base) AS n_null FROM x GROUP BY category")
def q_means(spark, d):
    return report.category_means(results(spark, d), "base").withColumn("mean", F.round("mean", 6))


@query("q_unsupported_count", _RES + " SELECT category, count_if(base IS NULL) AS unsupported FROM x GROUP BY category")
def q_unsupported(spark, d):
    claims = F.when(F.col("base").isNull(), F.array(F.lit("claim"))).otherwise(F.array().cast("array<string>"))
    return report.unsupported(results(spark, d).withColumn("unsupported_claims", claims))


@query("q_abstention_prf", _RES + """, c AS (SELECT count_if(should_abstain AND abstained) AS tp, count_if(NOT should_abstain AND abstained) AS fp, count_if(should_abstain AND NOT abstained) AS fn, count_if(should_abstain = abstained) / count(*) AS acc FROM x),
r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS q FROM c)
SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(p, 6) AS precision, round(q, 6) AS recall, round(CASE WHEN p + q = 0 THEN 0 ELSE 2 * p * q / (p + q) END, 6) AS f1, round(acc, 6) AS accuracy FROM r""")
def q_prf(spark, d):
    return report.abstention_scores(results(spark, d))


@query("q_abstention_cells", _RES + " SELECT category, count_if(should_abstain AND abstained)::BIGINT AS right_abstain, count_if(NOT should_abstain AND abstained)::BIGINT AS false_abstain, count_if(should_abstain AND NOT abstained)::BIGINT AS missed_abstain, count_if(NOT should_abstain AND NOT abstained)::BIGINT AS answered FROM x GROUP BY category")
def q_cells(spark, d):
    return report.abstention_cells(results(spark, d))


@query("q_ablation_table", _RES + " SELECT coalesce(category, 'OVERALL') AS category, count(*) AS n, round(avg(rag), 2) AS rag, round(avg(base), 2) AS base, round(avg(rag) - avg(base), 2) AS delta FROM x WHERE base IS NOT NULL GROUP BY ROLLUP (category)")
def q_ablation(spark, d):
    return report.ablation_table(results(spark, d))


@query("q_ablation_delta", _RES + " SELECT id, rag - base AS delta FROM x WHERE base IS NOT NULL")
def q_delta(spark, d):
    return results(spark, d).filter("base IS NOT NULL").select("id", (F.col("rag") - F.col("base")).alias("delta"))


@query("q_delta_trios", _RES + ", y AS (SELECT id, rag - base AS delta FROM x WHERE base IS NOT NULL) (SELECT id, delta, 'top' AS side FROM y ORDER BY delta DESC, id LIMIT 3) UNION ALL (SELECT id, delta, 'bottom' AS side FROM y ORDER BY delta, id DESC LIMIT 3)")
def q_trios(spark, d):
    return report.delta_extremes(results(spark, d))


@query("q_label_status", "SELECT count(*) AS total, count_if(quality = 1)::BIGINT AS labelled, count_if(quality IS NOT NULL AND quality <> 1 AND toxic = 1)::BIGINT AS abstain, count_if(quality IS NULL OR (quality <> 1 AND toxic <> 1))::BIGINT AS unlabelled FROM documents LEFT JOIN labels USING (doc_id)")
def q_status(spark, d):
    rows = t(spark, d, "documents").select("doc_id").join(t(spark, d, "labels"), "doc_id", "left")
    has, ab = F.coalesce(F.col("quality") == 1, F.lit(False)), F.coalesce((F.col("quality") != 1) & (F.col("toxic") == 1), F.lit(False))
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(has).alias("labelled"), F.count_if(ab).alias("abstain"), F.count_if(~has & ~ab).alias("unlabelled"))


@query("q_category_counts", "SELECT lang, count(*) AS n FROM documents GROUP BY lang ORDER BY lang")
def q_counts(spark, d):
    return report.category_counts(t(spark, d, "documents"), "lang").orderBy("lang")


@query("q_sample_rows", """WITH r AS (SELECT doc_id, quality, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS n FROM labels)
SELECT doc_id, quality FROM r WHERE place IN (0, n // 2, n - 1)""")
def q_sample(spark, d):
    """Of labels, whose ids have gaps."""
    return report.sample_positions(t(spark, d, "labels").select("doc_id", "quality"), "doc_id")


@query("q_previews", "SELECT doc_id, replace(left(text, 200), chr(10), ' ') || CASE WHEN length(text) > 200 THEN '...' ELSE '' END AS short, replace(left(text, 300), chr(10), ' ') || '...' AS long FROM documents")
def q_previews(spark, d):
    return t(spark, d, "documents").select("doc_id", T.preview(F.col("text"), 200).alias("short"), T.preview(F.col("text"), 300, always=True).alias("long"))


@query("q_links", "SELECT page_id, 'https://example.org/c' || page_id || '.html' || CASE WHEN page_id % 2 = 0 THEN ' https://example.org/sub/index.html' ELSE '' END AS links FROM pages")
def q_links(spark, d):
    """Pages, which have no chapter links of their own, with a menu of links in all quotations: chapters, index pages, anchors, other hosts."""
    menu = F.concat(
        F.lit('<a href="c'), F.col("page_id").cast("string"), F.lit('.html">one</a><a class=x href=\'landing-page.html\'>two</a><a href="http://x.html"></a><a href="#a.html"></a><link href="no.html"><A HREF=\'c'), F.col("page_id").cast("string"),
        F.lit(".html'>again</A><a href=index.html>three</a><a href='c1.pdf'>four</a>"), F.when(F.col("page_id") % 2 == 0, F.lit('<a href="sub/index.html">five</a>')).otherwise(F.lit("")),
    )
    return t(spark, d, "pages").select("page_id", F.concat("html", menu).alias("html")).select("page_id", F.array_join(html.links(), " ").alias("links"))


@query("q_slug", r"SELECT p_partkey, left(regexp_replace(trim(lower(regexp_replace(p_name, '[^\w\s-]', '', 'g'))), '[\s_-]+', '_', 'g'), 60) AS slug FROM part")
def q_slug(spark, d):
    return t(spark, d, "part").select("p_partkey", T.slug_ascii(F.col("p_name")).alias("slug"))


@query("q_section_runs", r"""WITH l AS (SELECT doc_id, i - 1 AS pos, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
h AS (SELECT *, length(trim(line)) >= 3 AND regexp_matches(trim(line), '^(?:[A-Z]|\d+)(?:\.\d+)*\.?\s{1,4}[A-Z]') AS h FROM l),
s AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM h)
SELECT doc_id, section::BIGINT AS section, max(trim(line)) FILTER (h) AS heading, md5(regexp_replace(string_agg(line, '' ORDER BY pos) FILTER (NOT h), '\s+', '', 'g')) AS letters
FROM s GROUP BY ALL HAVING regexp_matches(string_agg(line, '' ORDER BY pos) FILTER (NOT h), '\S')""")
def q_runs(spark, d):
    """Documents as files of one page, in one size of type."""
    docs = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file"), "text")
    lines = docs.select("file", F.lit(1).alias("page"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    chars = docs.select("file", F.lit(1).alias("page"), F.lit(0).alias("char_no"), F.lit(0.0).alias("top"), F.lit(10.0).alias("size"), F.lit(" ").alias("text"))
    rows = pdf.pdf_sections(lines, chars)
    return rows.select(F.col("file").cast("long").alias("doc_id"), F.col("section_no").alias("section"), F.get("section_hierarchy", F.lit(1)).alias("heading"), F.md5(F.regexp_replace("text", r"\s+", "")).alias("letters"))


@query("q_slug_accents", r"SELECT doc_id, left(regexp_replace(trim(lower(regexp_replace(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g'), '[^\w\s-]', '', 'g')), ' ' || chr(9) || chr(10) || chr(13)), '[\s_-]+', '_', 'g'), 60) AS slug FROM documents")
def q_slug_accents(spark, d):
    return t(spark, d, "documents").select("doc_id", T.slug(F.col("text")).alias("slug"))


#: Of pages, without tags and white space: h is the page without an unfinished tag, scripts, styles, menu and footer.
_PAGES = r"""WITH p AS (SELECT page_id, regexp_replace(html, '<[^>]*$', '') AS h FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(h, '<script>.*?</script>|<style>.*?</style>', '', 'gs'), '<nav>.*?(</nav>|$)', '', 's'), '<footer>.*$', '', 's') AS h FROM p)"""
_LETTERS = r"""regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace({0}, '<!--(.*?)-->', '\1', 'g'), '<[^>]*>', '', 'g'), '&amp;?', '&', 'g'), '&quot;', '"'), '\s+', '', 'g')"""


@query("q_html_sections", _PAGES + rf""",
c AS (SELECT page_id, regexp_replace(h, '^.*?<body>', '', 's') AS h FROM b),
s AS (
  SELECT page_id, 0 AS k, page_id::VARCHAR AS path, split_part(h, '<h1>', 1) AS x FROM c
  UNION ALL SELECT page_id, 1, regexp_extract(h, '<h1>(.*?)(</h1>|$)', 1, 's'), CASE WHEN contains(h, '</h1>') THEN split_part(h, '</h1>', 2) ELSE '' END FROM c),
u AS (SELECT page_id, k, replace(regexp_replace(trim(path), '&amp;?', '&', 'g'), '&quot;', '"') AS path, {_LETTERS.format("x")} AS letters FROM s)
SELECT page_id::VARCHAR AS page, (row_number() OVER (PARTITION BY page_id ORDER BY k) - 1)::INT AS section_no, path AS section_path, letters FROM u WHERE letters <> ''""")
def q_html(spark, d):
    pages = t(spark, d, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("text"))
    rows = html.html_sections(pages, mode="heading")
    return rows.select(F.col("doc_ord.original_path").alias("page"), F.col("doc_ord.section_no").alias("section_no"), F.array_join("section_hierarchy", " > ").alias("section_path"), F.regexp_replace("text", r"\s+", "").alias("letters"))


@query("q_html_text", _PAGES + f" SELECT page_id::VARCHAR AS page, letters FROM (SELECT page_id, {_LETTERS.format('h')} AS letters FROM b) WHERE letters <> ''")
def q_html_text(spark, d):
    pages = t(spark, d, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("text"))
    return html.html_texts(pages).select(F.col("original_path").alias("page"), F.regexp_replace("text", r"\s+", "").alias("letters"))


_INLINE = "text"
for _pattern, _to in rst.INLINE:
    _INLINE = f"regexp_replace({_INLINE}, '{_pattern}', '{_to}', 'g')"


@query("q_rst_sections", rf"""WITH f AS (SELECT doc_id, split_part(text, chr(10), 1) AS first, substr(text, length(split_part(text, chr(10), 1)) + 2) AS text FROM documents)
SELECT doc_id::VARCHAR AS original_path, trim(first) AS section_path, md5(regexp_replace({_INLINE}, '\s+', '', 'g')) AS letters FROM f WHERE trim({_INLINE}, ' ' || chr(10)) <> ''""")
def q_rst(spark, d):
    """Documents as files whose first line is underlined."""
    first = F.substring_index("text", "\n", 1)
    body = F.concat(first, F.lit("\n"), F.repeat(F.lit("="), F.greatest(F.length(first), F.lit(2))), F.lit("\n"), F.expr("substr(text, length(substring_index(text, '\\n', 1)) + 2)"))
    rows = rst.sectioned(t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), body.alias("text")), rst.sections, "docs", "docs")
    return rows.select("original_path", F.array_join("section_hierarchy", " > ").alias("section_path"), F.md5(F.regexp_replace("text", r"\s+", "")).alias("letters"))


@query("q_heading_lines", r"""WITH f AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), r AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM f),
h AS (SELECT doc_id, i, trim(l[i]) AS line FROM r WHERE regexp_matches(l[i], '[^\x20\x09-\x0D]'))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS heading_no, line AS title, ['=', '-', '~'][1 + ((i - 1) % 3)::INT] AS rule FROM h""")
def q_heading_lines(spark, d):
    """Documents with a rule under every line that has words, in three kinds in turn: all of them are headings."""
    rules = F.array(F.lit("="), F.lit("-"), F.lit("~"))
    ruled = F.transform(F.split("text", "\n", -1), lambda x, i: F.when(x.rlike(r"[^\x20\x09-\x0D]"), F.concat(x, F.lit("\n"), F.repeat(F.get(rules, i % 3), F.greatest(F.length(x), F.lit(2))))).otherwise(F.lit("")))
    rows = rst.heading_rows(t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.array_join(ruled, "\n").alias("text")))
    return rows.select(F.col("path").cast("long").alias("doc_id"), "heading_no", "title", "rule")


@query("q_token_batches", rf"""WITH RECURSIVE c AS (SELECT doc_id, source, {_TOK.format('text')} AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
b AS (
  SELECT doc_id, source, n, i, 0 AS batch, n::BIGINT AS total FROM c WHERE i = 1
  UNION ALL
  SELECT c.doc_id, c.source, c.n, c.i, CASE WHEN total > 0 AND total + c.n > 5000 THEN batch + 1 ELSE batch END, CASE WHEN total > 0 AND total + c.n > 5000 THEN c.n ELSE total + c.n END::BIGINT FROM b JOIN c ON c.source = b.source AND c.i = b.i + 1)
SELECT doc_id, batch::INT AS batch FROM b""")
def q_token_batches(spark, d):
    """Documents of each source in batches of 5000 words."""
    rows = t(spark, d, "documents").select("doc_id", "source", T.token_count(F.col("text")).alias("n"))
    return batch_numbers(rows, "source", "doc_id", "n", 5000).select("doc_id", "batch")


_CHUNKS = _pack_sql(OVERLAP).replace("FROM documents)", f"FROM documents WHERE {_TOK.format('text')} > {MOST})", 1)


@query("q_chunks", f"""{_CHUNKS.replace("SELECT doc_id, (row_number()", "SELECT * FROM (SELECT doc_id, (row_number()", 1).replace("SELECT * FROM (SELECT doc_id, (row_number()", ", k AS (SELECT doc_id, (row_number()", 1)} WHERE trim(chunk) <> ''),
w AS (SELECT doc_id, pos, chunk FROM k UNION ALL SELECT doc_id, 0, text FROM documents WHERE {_TOK.format('text')} <= {MOST}),
x AS (SELECT w.*, count(*) OVER (PARTITION BY w.doc_id) AS total, source, lang, left(md5(path || '::' || section || '::' || occurrence), 8) AS hash FROM w JOIN documents USING (doc_id) JOIN ({_OCC}) USING (doc_id))
SELECT source || '::' || lang || '::' || hash || '::' || pos AS chunk_id, pos::INT AS chunk_index, total::INT AS total_chunks_in_section, {_TOK.format('chunk')}::INT AS token_count, md5(chunk) AS digest FROM x""")
def q_chunks(spark, d):
    """Sections to chunks with ids."""
    return chunk.chunk_documents(sections(spark, d), MOST, OVERLAP).select("chunk_id", "chunk_index", "total_chunks_in_section", "token_count", F.md5("text").alias("digest"))


#: The offline embedder's vector of a text: words hashed to signed places, divided by the length, all in single precision.
_EMBED = r"""list_transform(range(64), lambda d: coalesce(list_sum(list_transform(list_filter(list_transform(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'), lambda w: ('0x' || md5(w)[1:16])::UBIGINT), lambda h: h % 64 = d), lambda h: CASE WHEN h >= 9223372036854775808 THEN 1 ELSE -1 END)), 0))"""
_UNIT = "list_transform({0}, lambda x: (x::FLOAT / greatest(sqrt(list_inner_product({0}::DOUBLE[], {0}::DOUBLE[])), CASE WHEN len(list_filter({0}, lambda y: y <> 0)) = 0 THEN 1 ELSE 0 END)::FLOAT)::FLOAT)"


@query("q_ingest", SQL["q_chunks"].replace("md5(chunk) AS digest FROM x", f"{_UNIT.format('e')} AS embedding FROM (SELECT *, {_EMBED.format('chunk')} AS e FROM x)"))
def q_ingest(spark, d):
    """Sections to embedded chunks."""
    return embedded(chunk.chunk_documents(sections(spark, d), MOST, OVERLAP)).select("chunk_id", "chunk_index", "total_chunks_in_section", "token_count", "embedding")


@query("q_answer", rf"""WITH d AS (SELECT doc_id, text, source, lang, {_UNIT.format('e')}::DOUBLE[] AS v FROM (SELECT *, {_EMBED.format('text')} AS e FROM documents)),
b AS (SELECT item_id, text, {_UNIT.format('e')}::DOUBLE[] AS v FROM (SELECT *, {_EMBED.format('text')} AS e FROM benchmark)),
r AS (SELECT item_id, b.text AS question, d.*, row_number() OVER (PARTITION BY item_id ORDER BY round(list_inner_product(b.v, d.v), 9) DESC, doc_id) AS rank FROM b, d QUALIFY rank <= 5),
c AS (SELECT item_id, question, string_agg('[' || rank || '] Source: ' || source || ' | Section: ' || lang || chr(10) || text, chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'Question: ' || question AS prompt FROM r GROUP BY item_id, question),
a AS (SELECT item_id, prompt, regexp_extract(prompt, '(?s)\[1\] Source: [^\n]*\n(.*?[.!?])(?:\s|$)', 1) AS first FROM c),
o AS (SELECT *, CASE WHEN first <> '' THEN trim(first, ' ' || chr(10) || chr(9) || chr(13)) || ' [1]' ELSE 'The provided context does not contain enough information to answer this question.' END AS answer FROM a)
SELECT item_id AS query_id, answer, NULL::VARCHAR AS error, 'offline' AS model, {_TOK.format('prompt')}::BIGINT AS input_tokens, {_TOK.format('answer')}::BIGINT AS output_tokens,
  list_sort(list_distinct(list_transform(flatten(list_transform(regexp_extract_all(answer, '\[(\d+(?:,\s*\d+)*)\]', 1), lambda m: regexp_split_to_array(m, ',\s*'))), lambda z: z::INT))) AS citations_used,
  regexp_matches(answer, '(?i)does not contain enough information|cannot answer|can[''’]t answer|unable to answer|not enough information|insufficient (context|information)') AS abstained FROM o""")
def q_answer(spark, d):
    """Benchmark texts as questions over whole documents: embed, retrieve, answer, post-process."""
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("source_name"), F.col("lang").alias("section_path"))
    asks = stored_frame(embedded(t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), input_type="query"), "asks")
    hits = retrieve.hit_rows(retrieve.topk(embedded(docs), asks, 5), docs)
    prompt = F.concat("context", F.lit("\n\n---\n\nQuestion: "), "text").alias("prompt")
    out = completed(retrieve.context(hits).join(asks.select("query_id", "text"), "query_id").select("query_id", prompt))
    return out.select("*", T.citations(F.col("answer")).alias("citations_used"), T.abstained(F.col("answer")).alias("abstained"))


def questions(spark, d):
    """Benchmark texts as golden questions: some to abstain from, some without truth."""
    i = F.col("item_id")
    return t(spark, d, "benchmark").select(
        i.cast("string").alias("id"), F.concat(F.lit("c"), (i % 3).cast("string")).alias("category"), F.col("text").alias("question"),
        F.when(i % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(i.cast("string"))).alias("ground_truth_chunk_ids"), F.col("text").alias("reference_answer"),
        (i % 5 == 0).alias("should_abstain"), F.when(i % 2 == 0, "seen").alias("notes"),
    )


def shown(spark, d):
    """What a labeller saw: two hits for each question."""
    rows = questions(spark, d).select(F.col("id").alias("query_id"), F.col("question").alias("text"), F.explode(F.array(F.lit(1), F.lit(2))).alias("rank"))
    return rows.select("*", F.concat("query_id", F.lit("-"), F.col("rank").cast("string")).alias("chunk_id"), (F.lit(0.5) / F.col("rank")).alias("score"), F.lit("docs").alias("source_type"), F.lit("s").alias("source_name"), F.lit("p").alias("section_path"))


_QUESTIONS = """WITH q AS (SELECT item_id::VARCHAR AS id, item_id AS i, 'c' || item_id % 3 AS category, text AS question, CASE WHEN item_id % 4 = 0 THEN [] ELSE [item_id::VARCHAR] END AS gt, item_id % 5 = 0 AS ab, CASE WHEN item_id % 2 = 0 THEN 'seen' END AS notes FROM benchmark)"""


@query("q_label_candidates", _QUESTIONS + " SELECT id, category FROM q WHERE NOT ab AND len(gt) = 0")
def q_label_candidates(spark, d):
    return label.candidates(questions(spark, d)).select("id", "category")


@query("q_golden_status", _QUESTIONS + " SELECT count(*) AS total, count_if(len(gt) > 0)::BIGINT AS labelled, count_if(ab)::BIGINT AS abstain, (count(*) - count_if(len(gt) > 0) - count_if(ab))::BIGINT AS unlabelled FROM q")
def q_golden_status(spark, d):
    return label.status(questions(spark, d))


@query("q_label_replies", _QUESTIONS + """, r AS (SELECT *, ['n', '1, 2', 's', '3', ' 2 ', '1,x'][1 + i % 6] AS reply FROM q)
SELECT id, CASE WHEN reply = 'n' THEN 'should_abstain' ELSE category END AS category, ab OR reply = 'n' AS should_abstain,
  CASE i % 6 WHEN 0 THEN '' WHEN 1 THEN id || '-1,' || id || '-2' WHEN 4 THEN id || '-2' WHEN 5 THEN id || '-1' ELSE array_to_string(gt, ',') END AS truth,
  CASE WHEN reply = 'n' THEN trim(coalesce(notes, '') || ' [reclassified as should_abstain during labeling]') ELSE notes END AS notes FROM r""")
def q_label_replies(spark, d):
    reply = F.get(F.array(*(F.lit(x) for x in ("n", "1, 2", "s", "3", " 2 ", "1,x"))), (F.col("id").cast("int") % 6))
    out = label.labelled(questions(spark, d), shown(spark, d), questions(spark, d).select("id", reply.alias("reply")))
    return out.select("id", "category", "should_abstain", F.array_join("ground_truth_chunk_ids", ",").alias("truth"), "notes")


@query("q_label_dump", _QUESTIONS + """, h AS (SELECT id, unnest([1, 2]) AS rank, question FROM q),
b AS (SELECT id, string_agg('[' || rank || '] score=' || printf('%.3f', 0.5 / rank) || ' type=docs source=s' || chr(10) || '    Section: p' || chr(10) || '    Chunk ID: ' || id || '-' || rank || chr(10) || '    Preview: ' || replace(left(question, 400), chr(10), ' ') || CASE WHEN length(question) > 400 THEN '...' ELSE '' END || chr(10), chr(10) ORDER BY rank) AS body FROM h GROUP BY id)
SELECT id, repeat('=', 64) || chr(10) || 'QUESTION ID: ' || id || chr(10) || 'CATEGORY: ' || category || chr(10) || 'QUESTION: ' || question || CASE WHEN notes <> '' THEN chr(10) || 'NOTES: ' || notes ELSE '' END || chr(10) || chr(10) || 'RETRIEVED CHUNKS:' || chr(10) || body || repeat('=', 64) || chr(10) AS value
FROM q JOIN b USING (id) WHERE NOT ab AND len(gt) = 0""")
def q_label_dump(spark, d):
    return label.dump(label.candidates(questions(spark, d)), shown(spark, d))


def replies(spark, d):
    """Judge replies: fenced objects with a number, every third cut off, every fifth failed."""
    k = F.get_json_object("props", "$.k").cast("double") / 100
    whole = F.concat(F.lit('```json\n{"faithfulness_score": '), k.cast("string"), F.lit(', "unsupported_claims": ["a", "b"], "reasoning": "r", "score": '), (F.col("event_id") % 5 + 1).cast("string"), F.lit(', "reason": "w", "label": "answered"}\n```'))
    return t(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.left(whole, F.lit(20))).otherwise(whole).alias("raw"), F.when(F.col("event_id") % 5 == 0, "late").alias("error"), (F.col("user_id") % 2 == 0).alias("did"), (F.col("event_id") % 7 == 0).alias("should"))


@query("q_judge_faithfulness", """SELECT event_id, CASE WHEN ok THEN CASE WHEN v <= 0.25 THEN 0.0 WHEN v <= 0.75 THEN 0.5 ELSE 1.0 END END::DOUBLE AS score, CASE WHEN error IS NULL THEN CASE WHEN ok THEN 2 ELSE 0 END END::INT AS claims, CASE WHEN error IS NULL THEN CASE WHEN ok THEN 'r' ELSE 'parse_error' END END AS reasoning, error
FROM (SELECT event_id, json_extract_string(props, '$.k')::DOUBLE / 100 AS v, event_id % 3 <> 0 AND event_id % 5 <> 0 AS ok, CASE WHEN event_id % 5 = 0 THEN 'late' END AS error FROM events)""")
def q_judge_faithfulness(spark, d):
    rows = replies(spark, d).select("event_id", judge.faithfulness(F.col("raw"), F.col("error")).alias("f"))
    claims = F.when(F.col("f.unsupported_claims").isNotNull(), F.size("f.unsupported_claims"))
    return rows.select("event_id", F.col("f.faithfulness_score").alias("score"), claims.alias("claims"), F.col("f.reasoning").alias("reasoning"), F.col("f.error").alias("error"))


@query("q_judge_quality", "SELECT event_id, CASE WHEN event_id % 3 <> 0 AND event_id % 5 <> 0 THEN event_id % 5 + 1 END::INT AS score, CASE WHEN event_id % 5 = 0 THEN 'late' WHEN event_id % 3 = 0 THEN 'parse_failed' END AS error FROM events")
def q_judge_quality(spark, d):
    rows = replies(spark, d).select("event_id", judge.quality(F.col("raw"), F.col("error")).alias("q"))
    return rows.select("event_id", F.col("q.score").alias("score"), F.col("q.error").alias("error"))


@query("q_judge_abstention", "SELECT event_id, (user_id % 2 = 0) = (event_id % 7 = 0) AS correct, CASE WHEN event_id % 3 <> 0 THEN 'answered' END AS label, NOT event_id % 7 = 0 AND NOT user_id % 2 = 0 AS judged FROM events")
def q_judge_abstention(spark, d):
    rows = replies(spark, d).select("event_id", judge.abstention(F.col("raw"), F.col("error"), F.col("did"), F.col("should")).alias("a"), judge.gate(F.col("should"), F.col("did")).alias("judged"))
    return rows.select("event_id", F.col("a.correct").alias("correct"), F.col("a.label").alias("label"), "judged")


@query("q_false_abstentions", f"""SELECT conv_id, turn FROM conversations WHERE role <> 'system' AND regexp_matches({_ANSWER}, '(?i)does not contain enough information|cannot answer|can[''’]t answer|unable to answer|not enough information|insufficient (context|information)')""")
def q_false_abstentions(spark, d):
    """An answer is expected of every turn but the system's."""
    expected = t(spark, d, "conversations").select("conv_id", "turn", (F.col("role") == "system").alias("should_abstain"))
    rows = answers(spark, d).withColumn("abstained", T.abstained(F.col("answer"))).join(expected, ["conv_id", "turn"])
    return report.false_abstentions(rows).select("conv_id", "turn")


@query("q_block_quote", "SELECT item_id, '> ' || replace(text, chr(10), chr(10) || '> ') AS quoted FROM benchmark")
def q_block_quote(spark, d):
    return t(spark, d, "benchmark").select("item_id", T.quoted(F.col("text")).alias("quoted"))


@query("q_ordinal_names", "SELECT page_id, printf('%02d', row_number() OVER (ORDER BY page_id)) || '-' || regexp_replace(regexp_extract(rtrim(url, '/'), '[^/]*$'), '\\.html$', '') || '.html' AS name FROM pages")
def q_ordinal_names(spark, d):
    """All pages in order of id under ordinal names."""
    number = report.placed(t(spark, d, "pages").select("page_id", "url"), "page_id").withColumn("place", (F.col("place") + 1).cast("string"))
    return number.select("page_id", acquire.ordinal_names(F.col("place"), F.col("url")).alias("name"))


def _embedded_docs(spark, d):
    return embedded(_docs(spark, d))


def _docs(spark, d):
    return t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "text", F.col("source").alias("source_name"), F.col("lang").alias("section_path"))


def _evaluated(spark, d):
    return evaluate.run(questions(spark, d), _embedded_docs(spark, d), judge_call=overlap_judge, texts_of=_docs(spark, d))


_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
_SHARE = "len(list_filter({0}, lambda w: list_contains({1}, w))) / greatest(1, len({0}))"


@query("q_eval_run", rf"""{_QUESTIONS}, d AS (SELECT doc_id::VARCHAR AS chunk_id, text, source, lang, {_UNIT.format('e')}::DOUBLE[] AS v FROM (SELECT *, {_EMBED.format('text')} AS e FROM documents)),
b AS (SELECT id, {_UNIT.format('e')}::DOUBLE[] AS v FROM (SELECT id, {_EMBED.format('question')} AS e FROM q)),
r AS (SELECT id, chunk_id, text, source, lang, greatest(0, least(1, list_inner_product(b.v, d.v))) AS score, row_number() OVER (PARTITION BY id ORDER BY round(list_inner_product(b.v, d.v), 9) DESC, chunk_id) AS rank FROM b, d QUALIFY rank <= 10),
l AS (SELECT id, list(chunk_id ORDER BY rank) AS ids, list(round(score, 4) ORDER BY rank) AS scores, string_agg('[' || rank || '] Source: ' || source || ' | Section: ' || lang || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context,
  string_agg('[' || rank || '] ' || source || ' | ' || lang || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS whole, string_agg('[' || rank || '] ' || source || ' | ' || lang || chr(10) || left(text, 400), chr(10) || chr(10) ORDER BY rank) AS short FROM r GROUP BY id),
a AS (SELECT *, regexp_extract(context || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'Question: ' || question, '(?s)\[1\] Source: [^
]*
(.*?[.!?])(?:\s|$)', 1) AS first FROM q JOIN l USING (id)),
o AS (SELECT *, CASE WHEN first <> '' THEN trim(first, ' ' || chr(10) || chr(9) || chr(13)) || ' [1]' ELSE 'The provided context does not contain enough information to answer this question.' END AS answer FROM a),
p AS (SELECT *, regexp_matches(answer, '(?i)does not contain enough information|cannot answer|can[''’]t answer|unable to answer|not enough information|insufficient (context|information)') AS abstained, {_WORDS.format('answer')} AS w, {_WORDS.format('whole')} AS ww, {_WORDS.format('short')} AS ws FROM o),
g AS (SELECT *, {_SHARE.format('w', 'ww')} AS f, {_SHARE.format('w', 'ws')} AS k, NOT ab AND NOT abstained AS judged FROM p)
SELECT id, category, ab AS should_abstain, NULL::VARCHAR AS error, ids AS retrieved_chunk_ids, scores AS top_scores, CASE WHEN NOT ab AND len(gt) > 0 THEN coalesce(1.0 / nullif(list_position(ids, gt[1]), 0), 0) END::DOUBLE AS mrr, abstained,
  list_sort(list_distinct(list_transform(flatten(list_transform(regexp_extract_all(answer, '\[(\d+(?:,\s*\d+)*)\]', 1), lambda m: regexp_split_to_array(m, ',\s*'))), lambda z: z::INT))) AS citations_used,
  abstained = ab AS abstention_correct, CASE WHEN judged THEN CASE WHEN f > 0.8 THEN 1.0 WHEN f > 0.4 THEN 0.5 ELSE 0.0 END END::DOUBLE AS faithfulness, CASE WHEN judged THEN 1 + round_even(4 * k, 0) END::INT AS quality FROM g""")
def q_eval_run(spark, d):
    """Benchmark texts as questions over whole documents: retrieval, metrics, answers and all judges."""
    out = _evaluated(spark, d)
    return out.select(
        "id", "category", "should_abstain", "error", "retrieved_chunk_ids", "top_scores", F.col("retrieval_metrics.mrr").alias("mrr"), "abstained", "citations_used", F.col("judge_abstention.correct").alias("abstention_correct"),
        F.col("judge_faithfulness.faithfulness_score").alias("faithfulness"), F.col("judge_quality.score").alias("quality"),
    )


def stored(spark, d):
    """Result rows with every kind of gap, made from labels and documents."""
    i, n = F.col("doc_id"), F.col("n_chars")
    rows = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return rows.select(
        i.cast("string").alias("id"), F.when(i % 13 != 0, F.col("lang")).alias("category"), F.when(i % 11 == 0, "late").alias("error"),
        F.when(i % 7 != 0, F.struct(F.when(i % 3 != 0, (n % 5) / 4).alias("recall_at_k"), F.when(i % 3 != 0, 1.0 / (n % 4 + 1)).alias("mrr"))).alias("retrieval_metrics"),
        F.when(i % 5 != 0, F.struct((F.col("toxic") == F.col("quality")).alias("correct"))).alias("judge_abstention"), F.when(i % 4 != 0, F.struct(((n % 3) / 2).alias("faithfulness_score"))).alias("judge_faithfulness"),
        F.when(i % 6 != 0, F.struct((n % 5 + 1).alias("score"))).alias("judge_quality"), n.alias("input_tokens"), F.when(i % 2 == 0, n % 100).alias("output_tokens"),
    )


_STORED = """WITH x AS (SELECT CASE WHEN doc_id % 13 <> 0 THEN lang END AS category, doc_id % 11 = 0 AS failed, CASE WHEN doc_id % 7 <> 0 AND doc_id % 3 <> 0 THEN n_chars % 5 / 4 END AS recall, CASE WHEN doc_id % 7 <> 0 AND doc_id % 3 <> 0 THEN 1 / (n_chars % 4 + 1) END AS mrr,
  CASE WHEN doc_id % 5 <> 0 THEN (toxic = quality)::INT END AS correct, CASE WHEN doc_id % 4 <> 0 THEN n_chars % 3 / 2 END AS faith, CASE WHEN doc_id % 6 <> 0 THEN n_chars % 5 + 1 END AS quality, n_chars, CASE WHEN doc_id % 2 = 0 THEN n_chars % 100 END AS out FROM labels JOIN documents USING (doc_id))"""


@query("q_eval_summary", _STORED + """ SELECT count(*) AS n, count_if(failed)::BIGINT AS errors, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(correct), 6) AS abstention_accuracy, round(avg(faith), 6) AS faithfulness, round(avg(quality), 6) AS quality,
sum(n_chars)::BIGINT AS input_tokens, sum(out)::BIGINT AS output_tokens FROM x""")
def q_eval_summary(spark, d):
    rows = report.eval_summary(stored(spark, d))
    return rows.withColumns({c: F.round(c, 6) for c in ("recall", "mrr", "abstention_accuracy", "faithfulness", "quality")})


@query("q_category_summary", _STORED + " SELECT coalesce(category, 'unknown') AS category, count(*) AS n, round(avg(recall), 3) AS recall, round(avg(mrr), 3) AS mrr, round(avg(faith), 2) AS faithfulness, round(avg(quality), 2) AS quality FROM x GROUP BY category")
def q_category_summary(spark, d):
    return report.category_summary(stored(spark, d))


@query("q_ablation_run", _QUESTIONS + f""" SELECT id, category, 3::INT AS rag, CASE WHEN NOT ab THEN 1 END::INT AS base,
CASE WHEN NOT ab THEN 'From memory: ' || right('{evaluate.PLAIN_RULES}' || chr(10) || chr(10) || 'Question: ' || question, 40) END AS no_rag_answer FROM q""")
def q_ablation_run(spark, d):
    """Questions answered without retrieval and judged; their scores beside those with retrieval."""
    base = questions(spark, d).select("*", F.lit(3).alias("rag"))
    out = evaluate.ablated(base, lambda p: f"From memory: {p[-40:]}", overlap_judge)
    return out.select("id", "category", "rag", F.col("no_rag_quality.score").alias("base"), "no_rag_answer")


#: A document's words in one line, and what is left of them without inline markup.
_LINE = r"trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0b\f\r]+', ' ', 'g'))"


def _one_line(c: str = "text"):
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[ \t\n\x0b\f\r]+", " "))


def _letters(c: str = "text"):
    return F.md5(F.regexp_replace(c, r"\s+", ""))


@query("q_rst_nested", rf"""WITH f AS (SELECT doc_id, lang, {_INLINE} AS body FROM (SELECT doc_id, lang, {_LINE} AS text FROM documents)),
s AS (SELECT doc_id, body, 'Doc ' || doc_id AS a, lang, unnest(range(4)) AS k FROM f)
SELECT doc_id::VARCHAR AS original_path, k::INT AS section_no, a || ['', ' > Part ' || lang, ' > Part ' || lang || ' > Deep', ' > Part two'][k + 1] AS section_path, md5(regexp_replace(body, '\s+', '', 'g')) AS letters FROM s WHERE trim(body) <> ''""")
def q_rst_nested(spark, d):
    """Documents as files with a title between rules, headings of two levels below it, and directives whose bodies go."""
    body, title = _one_line(), F.concat(F.lit("Doc "), F.col("doc_id").cast("string"))
    part = F.concat(F.lit("Part "), F.col("lang"))
    rule = lambda c, mark: F.repeat(F.lit(mark), F.length(c))
    text = F.concat_ws(
        "\n", rule(title, "="), title, rule(title, "="), F.lit(""), body, F.lit(""), F.lit(".. note::"), F.lit(""), F.lit("   Not in the text."), F.lit(""), part, rule(part, "-"), F.lit(""), body, F.lit("\nDeep\n~~~~\n"), body, F.lit(""),
        F.lit(".. _label:"), F.lit(""), F.lit("Part two\n--------\n"), body,
    )
    rows = rst.sectioned(t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), text.alias("text")), rst.sections, "docs", "docs")
    return rows.select("original_path", F.col("doc_ord.section_no").alias("section_no"), F.array_join("section_hierarchy", " > ").alias("section_path"), _letters().alias("letters"))


@query("q_rst_plain", rf"""SELECT 'files/' || doc_id || '.rst' AS original_path, doc_id::VARCHAR AS section_path, md5(regexp_replace({_INLINE}, '\s+', '', 'g')) AS letters FROM (SELECT doc_id, {_LINE} AS text FROM documents) WHERE trim({_INLINE}) <> ''""")
def q_rst_plain(spark, d):
    """Files without a heading are one section, named by the file."""
    files = t(spark, d, "documents").select(F.format_string("files/%d.rst", "doc_id").alias("path"), _one_line().alias("text"))
    return rst.sectioned(files, rst.sections, "docs", "docs").select("original_path", F.array_join("section_hierarchy", " > ").alias("section_path"), _letters().alias("letters"))


@query("q_code_fences", f"""WITH s AS (SELECT doc_id, list_concat({_SENT}, ['```x = f(1). y? z!```'], {_SENT}) AS a FROM documents)
SELECT doc_id, (i - 1)::INT AS pos, a[i] AS atom FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM s)""")
def q_code_fences(spark, d):
    """A fenced block between two copies of a text is one atom, whatever ends of sentences it has."""
    whole = F.concat("text", F.lit("```x = f(1). y? z!```"), "text")
    return t(spark, d, "documents").select("doc_id", F.posexplode(T.atoms(whole)).alias("pos", "atom"))


@query("q_html_nested", rf"""WITH f AS (SELECT doc_id, regexp_replace({_LINE}, '\s+', '', 'g') AS x FROM documents),
s AS (SELECT doc_id, x, unnest(range(4)) AS k FROM f)
SELECT doc_id::VARCHAR AS page, ['Title', 'Title > Sub Part', 'Title > In', 'Section'][k + 1] AS section_path, md5(CASE k WHEN 0 THEN x || 'In' || x ELSE x END) AS letters FROM s WHERE x <> '' OR k = 0""")
def q_html_nested(spark, d):
    """Documents as pages of section elements: a heading of its own, one from its id, one inside a div (whose text is its parent's too), one without either."""
    own = F.concat(F.lit("<p>"), F.replace(F.replace(F.replace(_one_line(), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("</p>"))
    page = F.concat(
        F.lit("<html><body><nav>menu</nav><main><section id='x'><h2> Title # </h2>"), own, F.lit("<section id='sub-part'>"), own, F.lit("</section><div><section><h3>In</h3>"), own, F.lit("</section></div></section><section>"), own,
        F.lit("</section></main></body></html>"),
    )
    rows = html.html_sections(t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), page.alias("text")))
    return rows.select(F.col("original_path").alias("page"), F.array_join("section_hierarchy", " > ").alias("section_path"), _letters().alias("letters"))


@query("q_pdf_sizes", r"""WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents),
l AS (SELECT doc_id, 0 AS pos, 'Big title ' || doc_id AS line, len(x) >= 2 AS large FROM t UNION ALL SELECT doc_id, unnest(range(1, len(x) + 1)), unnest(x), false FROM t),
h AS (SELECT *, large OR (length(trim(line)) >= 3 AND regexp_matches(trim(line), '^(?:[A-Z]|\d+)(?:\.\d+)*\.?\s{1,4}[A-Z]')) AS h FROM l),
s AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM h)
SELECT doc_id, section::BIGINT AS section, max(trim(line)) FILTER (h) AS heading, md5(regexp_replace(string_agg(line, '' ORDER BY pos) FILTER (NOT h), '\s+', '', 'g')) AS letters
FROM s GROUP BY ALL HAVING regexp_matches(string_agg(line, '' ORDER BY pos) FILTER (NOT h), '\S')""")
def q_pdf_sizes(spark, d):
    """Documents under a title of a larger size; where the title is as frequent as the text, its size counts as the text's."""
    docs = t(spark, d, "documents").filter("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("file"), F.concat(F.lit("Big title "), F.col("doc_id").cast("string"), F.lit("\n"), "text").alias("text"))
    lines = docs.select("file", F.lit(1).alias("page"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    chars = lines.select("file", "page", F.col("line_no").alias("char_no"), F.col("line_no").cast("double").alias("top"), F.when(F.col("line_no") == 0, 18.0).otherwise(10.0).alias("size"), F.col("line").alias("text"))
    rows = pdf.pdf_sections(lines, chars)
    return rows.select(F.col("file").cast("long").alias("doc_id"), F.col("section_no").alias("section"), F.get("section_hierarchy", F.lit(1)).alias("heading"), _letters().alias("letters"))
