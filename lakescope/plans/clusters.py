"""Clustering queries over the vectors and over feeds of documents.

A feed is the documents of one source and language seen as a table; its distinct
words are the columns.
"""

from pyspark.sql import functions as F

from lakescope.operators import clustering, domains
from lakescope.plans.lake import ENTITY_LAKE_SQL, entity_lake
from lakescope.plans.registry import query, table
from lakescope.session import cut_lineage


PLACES = 1 << 32  # more than a text can have words


def feeds(spark, sf_dir):
    """Column rows of the feeds; a word's ordinal is its first place in the feed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    places = docs.groupBy("source", "lang").agg(F.min("doc_id").alias("table_pos"))
    words = docs.select(
        "source",
        "lang",
        F.posexplode(F.split("text", r"\s+")).alias("at", "word"),
        (F.col("doc_id") * PLACES).alias("base"),
    ).filter("word <> ''")
    first = words.groupBy("source", "lang", "word").agg(F.min(F.col("base") + F.col("at")).alias("ordinal"))
    # a catalog is a stored table: the jobs read it several times
    rows = first.join(places, ["source", "lang"]).select(
        F.col("source").alias("source_id"),
        F.concat(F.lit("feed"), F.col("table_pos").cast("string"), F.lit("Rows")).alias("table_name"),
        "table_pos",
        "ordinal",
        F.col("word").alias("column_name"),
        F.lit("string").alias("dtype"),
        F.lit(None).cast("string").alias("comment"),
    )
    return cut_lineage(rows)


_FEEDS = r"""
places AS (SELECT source, lang, min(doc_id) AS table_pos FROM documents GROUP BY ALL),
words AS (SELECT source, lang, doc_id * 4294967296 + nth - 1 AS place, word FROM (
    SELECT doc_id, source, lang, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS nth
    FROM (SELECT *, string_split_regex(text, '\s+') AS ws FROM documents)) WHERE word <> ''),
feed AS (SELECT source AS source_id, 'feed' || table_pos || 'Rows' AS table_name, table_pos, min(place) AS ordinal, word AS column_name
         FROM words JOIN places USING (source, lang) GROUP BY source, lang, table_pos, word)"""


def _tokens_sql(lake: str) -> str:
    return rf"""
named AS (SELECT DISTINCT table_pos, source_id, table_name, -1::BIGINT AS ordinal, table_name AS n FROM {lake}
          UNION ALL SELECT table_pos, source_id, table_name, ordinal, column_name FROM {lake}),
pieces AS (SELECT *, list_filter(string_split(lower(regexp_replace(regexp_replace(n, '([a-z])([A-Z])', '\1_\2', 'g'), '[-\s]+', '_', 'g')), '_'),
                          lambda t: length(t) > 1) AS ts FROM named),
tok AS (SELECT table_pos, source_id, table_name, ordinal, unnest(ts) AS term, unnest(range(len(ts))) AS idx FROM pieces)"""


@query(
    "name_tokens",
    f"WITH {_FEEDS}, {_tokens_sql('feed')} SELECT source_id, table_name, ordinal, idx, term FROM tok",
)
def name_tokens(spark, sf_dir):
    return domains.tokens(feeds(spark, sf_dir)).select("source_id", "table_name", "ordinal", "idx", "term")


_IDF = """
tf AS (SELECT table_pos, term, count(*) AS tf FROM tok GROUP BY ALL),
idf AS (SELECT term, count(*) AS df, ln(((SELECT count(DISTINCT table_pos) FROM tok) + 1)::DOUBLE / (count(*) + 1)) AS idf
        FROM tf GROUP BY 1)"""


@query("token_idf", f"WITH {_FEEDS}, {_tokens_sql('feed')}, {_IDF} SELECT term, df, round(idf, 8) AS idf FROM idf")
def token_idf(spark, sf_dir):
    cols = feeds(spark, sf_dir)
    counts = domains.term_counts(domains.tokens(cols))
    n = cols.select("table_pos").distinct().count()
    return domains.idf(counts, n).withColumn("idf", F.round("idf", 8))


@query(
    "tfidf_vectors",
    f"""WITH {_FEEDS}, {_tokens_sql("feed")}, {_IDF}, w AS (SELECT table_pos, term, tf * idf AS w FROM tf JOIN idf USING (term) WHERE tf * idf <> 0)
    SELECT table_pos AS id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY table_pos)), 8) AS w FROM w""",
)
def tfidf_vectors(spark, sf_dir):
    cols = feeds(spark, sf_dir)
    counts = domains.term_counts(domains.tokens(cols))
    n = cols.select("table_pos").distinct().count()
    return domains.tfidf(counts, domains.idf(counts, n)).withColumn("w", F.round("w", 8))


@query(
    "cosine_distance_pairs",
    """SELECT a.vec_id AS a, b.vec_id AS b, round(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 8) AS distance
    FROM embeddings a JOIN embeddings b ON b.vec_id IN (a.vec_id + 1, a.vec_id + 7, a.vec_id * 2 + 3)""",
)
def cosine_distance_pairs(spark, sf_dir):
    """Distances of requested pairs: each vector with three others."""
    vecs = table(spark, sf_dir, "embeddings")
    others = F.explode(F.array_distinct(F.array(F.col("vec_id") + 1, F.col("vec_id") + 7, F.col("vec_id") * 2 + 3)))
    ids = vecs.select(F.col("vec_id").alias("b"))
    wanted = vecs.select(F.col("vec_id").alias("a"), others.alias("b")).join(ids, "b")
    return clustering.vector_pair_distances(vecs, "vec_id", "embedding", wanted.select("a", "b")).withColumn("distance", F.round("distance", 8))


@query(
    "average_distances",
    """SELECT a.label AS a, b.label AS b,
      round(avg(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 8) AS distance
    FROM embeddings a JOIN embeddings b ON a.label < b.label GROUP BY ALL""",
)
def average_distances(spark, sf_dir):
    """Average-linkage distance between labelled groups, from their sum vectors."""
    vecs = table(spark, sf_dir, "embeddings")
    feats = clustering.vector_features(vecs, "vec_id", "embedding")
    labels = vecs.select(F.col("vec_id").alias("id"), "label")
    return clustering.cluster_distances(feats, labels).withColumn("distance", F.round("distance", 8))


@query(
    "silhouette",
    """WITH e AS (SELECT vec_id AS i, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    d AS (SELECT a.i, a.label AS own, b.label AS other, sum(1 - list_cosine_similarity(a.v, b.v)) AS s, count(*) AS n
          FROM e a JOIN e b ON a.i <> b.i GROUP BY ALL),
    p AS (SELECT i, coalesce(max(s / n) FILTER (WHERE own = other), 0) AS a, min(s / n) FILTER (WHERE own <> other) AS b FROM d GROUP BY 1)
    SELECT 10 AS k, round(avg(CASE WHEN greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 8) AS silhouette FROM p""",
)
def silhouette(spark, sf_dir):
    vecs = table(spark, sf_dir, "embeddings")
    feats = clustering.vector_features(vecs, "vec_id", "embedding")
    labels = vecs.select(F.col("vec_id").alias("id"), F.lit(10).alias("k"), "label")
    return clustering.silhouettes(feats, labels).withColumn("silhouette", F.round("silhouette", 8))


# Average linkage by its definition: all pairs of clusters, the closest merged, older clusters first on ties.
# Rows of kind p are pairs of clusters by age, rows of kind m say which cluster an item is in.
_LINKAGE = f"""WITH RECURSIVE {_FEEDS}, {_tokens_sql("feed")}, {_IDF},
raw AS (SELECT table_pos, term, tf * idf AS w FROM tf JOIN idf USING (term) WHERE tf * idf <> 0),
unit AS (SELECT table_pos AS id, term, w / sqrt(sum(w * w) OVER (PARTITION BY table_pos)) AS w FROM raw),
it AS (SELECT table_pos AS id, row_number() OVER (ORDER BY table_pos) - 1 AS r FROM places),
size AS (SELECT count(*) AS n FROM it),
dots AS (SELECT a.id AS ia, b.id AS ib, sum(a.w * b.w) AS dot FROM unit a JOIN unit b USING (term) GROUP BY ALL),
gaps AS (SELECT a.id AS ia, b.id AS ib, a.r AS ra, b.r AS rb, 1 - coalesce(dot, 0) AS d
         FROM it a JOIN it b ON a.id <> b.id LEFT JOIN dots ON ia = a.id AND ib = b.id),
lk AS (
  (SELECT 0::BIGINT AS step, 'p' AS kind, ra AS x, rb AS y, d, 1::DOUBLE AS nx, 1::DOUBLE AS ny FROM gaps WHERE ra < rb
   UNION ALL SELECT 0, 'm', id, r, 0, 0, 0 FROM it)
  UNION ALL
  (WITH best AS (SELECT x AS bx, y AS yy, nx AS bn, ny AS yn FROM lk WHERE kind = 'p' ORDER BY round(d, 12), x, y LIMIT 1)
   SELECT step + 1, kind, x, y, d, nx, ny FROM lk, best WHERE kind = 'p' AND x NOT IN (bx, yy) AND y NOT IN (bx, yy)
   UNION ALL
   SELECT step + 1, 'p', CASE WHEN x IN (bx, yy) THEN y ELSE x END AS k, n + step,
     sum(d * CASE WHEN x = bx OR y = bx THEN bn ELSE yn END) / any_value(bn + yn), any_value(CASE WHEN x IN (bx, yy) THEN ny ELSE nx END), any_value(bn + yn)
   FROM lk, best, size WHERE kind = 'p' AND ((x IN (bx, yy)) <> (y IN (bx, yy))) GROUP BY step, n, k
   UNION ALL
   SELECT step + 1, 'm', x, CASE WHEN y IN (bx, yy) THEN n + step ELSE y END, 0, 0, 0 FROM lk, best, size WHERE kind = 'm')),
cuts AS (SELECT id, k, dense_rank() OVER (PARTITION BY k ORDER BY root) - 1 AS label FROM (
  SELECT x AS id, n - step AS k, min(x) OVER (PARTITION BY step, y) AS root FROM lk, size WHERE kind = 'm' AND n - step BETWEEN 2 AND least(n // 2, 20))),
away AS (SELECT c.id, c.k, c.label AS own, o.label AS other, avg(d) AS d FROM cuts c JOIN cuts o ON c.k = o.k AND c.id <> o.id
         JOIN gaps ON ia = c.id AND ib = o.id GROUP BY ALL),
point AS (SELECT id, k, coalesce(max(d) FILTER (WHERE own = other), 0) AS a, coalesce(min(d) FILTER (WHERE own <> other), 0) AS b FROM away GROUP BY ALL),
sil AS (SELECT k, avg(CASE WHEN greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM point GROUP BY 1)
"""


def _linked_feeds(spark, sf_dir):
    feats, items = domains.features(feeds(spark, sf_dir))
    feats, items = cut_lineage(feats), cut_lineage(items)
    return feats, items, clustering.average_linkage(feats, items)


@query(
    "average_linkage",
    _LINKAGE
    + """, ages AS (SELECT step, y, min(x) AS name FROM lk WHERE kind = 'm' GROUP BY ALL),
    picked AS (SELECT * FROM lk WHERE kind = 'p' QUALIFY row_number() OVER (PARTITION BY step ORDER BY round(d, 12), x, y) = 1)
    SELECT least(p.name, q.name) AS a, greatest(p.name, q.name) AS b, round(d, 8) AS height, picked.step
    FROM picked JOIN ages p ON p.step = picked.step AND p.y = picked.x JOIN ages q ON q.step = picked.step AND q.y = picked.y""",
)
def average_linkage(spark, sf_dir):
    """All merges of the feeds: which two clusters, at what distance."""
    _, _, history = _linked_feeds(spark, sf_dir)
    return history.select("a", "b", F.round("height", 8).alias("height"), "step")


@query("cut_at_k", _LINKAGE + "SELECT id, k, label FROM cuts")
def cut_at_k(spark, sf_dir):
    _, items, history = _linked_feeds(spark, sf_dir)
    return clustering.cut(history, items, clustering.cluster_counts(items.count())).select("id", "k", "label")


def _linked_vectors(spark, sf_dir):
    vecs = table(spark, sf_dir, "embeddings")
    items = cut_lineage(vecs.select(F.col("vec_id").alias("id")))
    return items, clustering.average_linkage(cut_lineage(clustering.vector_features(vecs, "vec_id", "embedding")), items)


@query("average_linkage_vectors")
def average_linkage_vectors(spark, sf_dir):
    """All merges of the whole embeddings table."""
    _, history = _linked_vectors(spark, sf_dir)
    return history.select("a", "b", F.round("height", 8).alias("height"), "round", "step")


@query("cut_at_k_vectors")
def cut_at_k_vectors(spark, sf_dir):
    items, history = _linked_vectors(spark, sf_dir)
    return clustering.cut(history, items, clustering.cluster_counts(items.count())).select("id", "k", "label")


@query("choose_k", _LINKAGE + "SELECT k, round(silhouette, 8) AS silhouette FROM sil")
def choose_k(spark, sf_dir):
    """Silhouette of every cut of the feeds."""
    feats, items, history = _linked_feeds(spark, sf_dir)
    labels = clustering.cut(history, items, clustering.cluster_counts(items.count()))
    return clustering.silhouettes(feats, labels).withColumn("silhouette", F.round("silhouette", 8))


@query(
    "cluster_features",
    f"""WITH {_FEEDS}, {_tokens_sql("feed")}, {_IDF}
    SELECT 'vectors' AS kind, CAST(sum(len(list_filter(embedding, lambda x: x <> 0))) AS BIGINT) AS n FROM embeddings
    UNION ALL SELECT 'tfidf', count(*) FROM tf JOIN idf USING (term) WHERE tf * idf <> 0""",
)
def cluster_features(spark, sf_dir):
    """Vectors for the customers that all have one; TF-IDF where some lack one."""
    vecs = table(spark, sf_dir, "embeddings").select(
        F.lit("v").alias("source_id"),
        F.concat(F.lit("item"), F.col("vec_id").cast("string")).alias("table_name"),
        F.col("embedding").alias("vector"),
        F.col("vec_id").alias("table_pos"),
    )
    cols = vecs.select(
        "source_id", "table_name", "table_pos", F.lit(0).cast("bigint").alias("ordinal"), F.lit("id").alias("column_name")
    )
    whole, _ = domains.features(cols, vecs)
    partial, _ = domains.features(feeds(spark, sf_dir), vecs)
    return whole.agg(F.count(F.lit(1)).alias("n")).select(F.lit("vectors").alias("kind"), "n").unionByName(
        partial.agg(F.count(F.lit(1)).alias("n")).select(F.lit("tfidf").alias("kind"), "n")
    )


_LABELS = """
mem AS (SELECT DISTINCT table_pos, source_id, table_name, CAST(CASE source_id WHEN 'crm' THEN 0 WHEN 'sales' THEN 1 ELSE 2 END AS INT) AS label FROM elake),
terms AS (SELECT label, term, count(*) AS tf, min((table_pos, ordinal, idx)) AS seen FROM tok JOIN mem USING (table_pos) GROUP BY ALL)"""
_LAKE = f"WITH {ENTITY_LAKE_SQL}, {_tokens_sql('elake')}, {_LABELS}"


def _members(cols):
    label = F.when(F.col("source_id") == "crm", 0).when(F.col("source_id") == "sales", 1).otherwise(2)
    return cols.select("source_id", "table_name", "table_pos").distinct().withColumn("label", label)


@query(
    "domain_names",
    _LAKE
    + """, s AS (SELECT label, term, round(tf * ln(4.0::DOUBLE / (count(*) OVER (PARTITION BY term) + 1)), 12) AS score, seen FROM terms),
    r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, seen) AS rn FROM s)
    SELECT label, string_agg(term, '_' ORDER BY rn) AS domain_name FROM r WHERE rn <= 3 GROUP BY 1""",
)
def domain_names(spark, sf_dir):
    cols = entity_lake(spark, sf_dir)
    return domains.domain_names(domains.domain_terms(domains.tokens(cols), _members(cols)), 3)


@query(
    "domain_keywords",
    _LAKE
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY tf DESC, seen) AS rn FROM terms)
    SELECT label, string_agg(term, '|' ORDER BY rn) AS keywords FROM r WHERE rn <= 5 GROUP BY 1""",
)
def domain_keywords(spark, sf_dir):
    cols = entity_lake(spark, sf_dir)
    out = domains.domain_keywords(domains.domain_terms(domains.tokens(cols), _members(cols)))
    return out.withColumn("keywords", F.array_join("keywords", "|"))


@query(
    "domain_id",
    _LAKE + " SELECT label, left(sha256(string_agg(table_name, '|' ORDER BY table_name)), 16) AS domain_id FROM mem GROUP BY 1",
)
def domain_id(spark, sf_dir):
    return domains.domain_ids(_members(entity_lake(spark, sf_dir)))


@query(
    "single_domain",
    _LAKE
    + """, t AS (SELECT term, sum(tf) AS tf, min(seen) AS seen FROM terms GROUP BY 1),
    r AS (SELECT term, row_number() OVER (ORDER BY tf DESC, seen) AS rn FROM t)
    SELECT (SELECT left(sha256(string_agg(table_name, '|' ORDER BY table_name)), 16) FROM mem) AS domain_id,
      (SELECT string_agg(term, '_' ORDER BY rn) FROM r WHERE rn <= 3) AS domain_name,
      (SELECT string_agg(term, '|' ORDER BY rn) FROM r WHERE rn <= 5) AS keywords, (SELECT count(*) FROM mem) AS table_count""",
)
def single_domain(spark, sf_dir):
    found, _ = domains.single_domain(entity_lake(spark, sf_dir))
    return found.select("domain_id", "domain_name", F.array_join("keywords", "|").alias("keywords"), "table_count")


@query(
    "business_domains",
    _LINKAGE
    + """, best AS (SELECT max_by(k, (round(silhouette, 12), -k)) AS k FROM sil HAVING max(round(silhouette, 12)) >= 0.25),
    mem AS (SELECT table_pos, source_id, table_name, coalesce(c.label, 0) AS label, (SELECT count(*) FROM best) = 0 AS single
            FROM (SELECT DISTINCT table_pos, source_id, table_name FROM feed) LEFT JOIN (SELECT * FROM cuts JOIN best USING (k)) c ON c.id = table_pos),
    terms AS (SELECT label, any_value(single) AS single, term, count(*) AS tf, min((table_pos, ordinal, idx)) AS seen
              FROM tok JOIN mem USING (table_pos) GROUP BY label, term),
    s AS (SELECT *, round(tf * ln(((SELECT max(label) FROM mem) + 2)::DOUBLE / (count(*) OVER (PARTITION BY term) + 1)), 12) AS score FROM terms),
    r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY tf DESC, seen) AS often,
                 row_number() OVER (PARTITION BY label ORDER BY CASE WHEN single THEN tf ELSE score END DESC, seen) AS told FROM s),
    titles AS (SELECT label, string_agg(term, '_' ORDER BY told) FILTER (WHERE told <= 3) AS domain_name, string_agg(term, '|' ORDER BY often) FILTER (WHERE often <= 5) AS keywords FROM r GROUP BY 1),
    ids AS (SELECT label, left(sha256(string_agg(table_name, '|' ORDER BY table_name)), 16) AS domain_id, count(*) AS table_count FROM mem GROUP BY 1)
    SELECT domain_id, domain_name, keywords, table_count FROM ids JOIN titles USING (label)""",
)
def business_domains(spark, sf_dir):
    found, _ = domains.discover(feeds(spark, sf_dir))
    return found.select("domain_id", "domain_name", F.array_join("keywords", "|").alias("keywords"), "table_count")


@query(
    "domain_report",
    _LAKE
    + """, n AS (SELECT label, count(*) AS table_count FROM mem WHERE source_id IN ('crm', 'sales') GROUP BY 1)
    SELECT 'domain ' || label AS domain_name, source_id, table_name, table_count FROM mem JOIN n USING (label) WHERE source_id = 'sales'
    UNION ALL SELECT 'unclustered', source_id, table_name, 0 FROM mem WHERE source_id = 'procurement'""",
)
def domain_report(spark, sf_dir):
    cols = entity_lake(spark, sf_dir)
    tables = cols.select("source_id", "table_name", "table_pos").distinct()
    members = _members(cols).filter("source_id <> 'procurement'")
    named = members.select("label").distinct().select(
        "label",
        F.concat(F.lit("domain "), F.col("label").cast("string")).alias("domain_name"),
        F.array().cast("array<string>").alias("keywords"),
        F.lit(0).alias("table_count"),
    )
    shown = domains.report(named, members, "sales").select("domain_name", "source_id", "table_name", "table_count")
    rest = domains.unclustered(tables, members).select(
        F.lit("unclustered").alias("domain_name"), "source_id", "table_name", F.lit(0).alias("table_count")
    )
    return shown.unionByName(rest)
