"""The registered queries of this subpackage and, where SQL can say it, their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakescope.llm import decontamination, exact_dedup, fingerprints, html_text, infill, jaccard_join, licenses, packing, quality, resampling, secrets, token_counts, urls
from lakescope.session import cut_lineage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # fixed: goes with the vocabulary

# The host rules of the page filter.
URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.expr(decontamination.covered("spans"))
    out = found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_spans(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), TOKENIZER, PATTERN)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.near_clusters(table(spark, sf_dir, "documents")), cluster="cluster")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = cut_lineage(quality.features(table(spark, sf_dir, "documents")))
    model = quality.fit(stats, quality.training(table(spark, sf_dir, "labels")))
    out = quality.scored(stats, model)
    return out.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES).select("page.page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.findings(table(spark, sf_dir, "documents"), path="doc_id")
    base = F.expr("filter(findings, f -> f.rank < 3)")
    listed = {k: F.concat_ws(",", F.transform(v, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"]))) for k, v in (("base", base), ("all", F.col("findings")))}
    return found.select(
        F.col("path").alias("doc_id"),
        *[F.size(F.expr(f"filter(findings, f -> f.kind = '{k}')")).cast("bigint").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(listed["base"], 256).alias("base_sha256"),
        listed["all"].alias("spans"),
        F.col("blob").alias("blob_sha256"),
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.lookup(exact_dedup.build(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(table(spark, sf_dir, "pages")).select("page.page_id", "page.url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.with_neighbours(table(spark, sf_dir, "documents"))
    own, edited, after = F.col("hashes"), F.col("edited_hashes"), F.col("next_hashes")
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprints.fingerprint(own).alias("fingerprint"),
        fingerprints.fingerprint(edited).alias("edited_fingerprint"),
        fingerprints.containment(own, edited).alias("near_edited"),
        fingerprints.containment(own, after).alias("near_next"),
        fingerprints.resemblance(own, edited).alias("jaccard_edited"),
        fingerprints.resemblance(own, after).alias("jaccard_next"),
    )


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = infill.restore(infill.infill(table(spark, sf_dir, "documents")))
    return forms.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_license_scan,
        op3_ngram_jaccard,
        op4_token_counts,
        op5_best_fit_packing,
        op6_quality,
        op7_url_filter,
        op8_secret_scan,
        op9_exact_dedup,
        op10_main_text,
        op11_fingerprints,
        op12_infill,
        op13_resampling,
    )
}

_FOLD = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _FOLD.format("text") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPLIT = "list_filter(string_split_regex(" + _FOLD + r", '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_TERM = "CAST(regexp_matches(judged, '(^|[^\\p{{L}}\\p{{N}}]){}($|[^\\p{{L}}\\p{{N}}])') AS INTEGER)"
_RULE = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{{i}}}" for i, (_, h, p) in sorted(enumerate(URL_RULES), key=lambda r: -len(r[1][1] + r[1][2])))
_POLY = f"list_reduce(list_prepend(0::BIGINT, r), lambda x, y: (x * {{}} + y) % {fingerprints.MODULUS})"

ORACLES = {
    "op1_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS k
       FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(s)),
hits AS (SELECT DISTINCT doc_id, s, n, item_id FROM dw JOIN bw USING (n, k)),
cov AS (SELECT doc_id, count(DISTINCT s + i) AS n_hit FROM (SELECT DISTINCT doc_id, s, n FROM hits), unnest(range(0, n)) AS u(i) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op3_ngram_jaccard": f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex({_FOLD.format("text")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 3], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS t(s) WHERE len(w) > 0),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.b FROM reach r JOIN edges e ON r.y = e.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(y) FROM reach WHERE x = d.doc_id) AS component_id FROM d LEFT JOIN size USING (doc_id)""",
    "op7_url_filter": f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS whole FROM pages),
r AS (SELECT *, contains(whole, '://') AS has, CASE WHEN contains(whole, '://') THEN substr(whole, instr(whole, '://') + 3) ELSE '' END AS rest FROM u),
p AS (SELECT page_id, {_FOLD.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
      {_FOLD.format("regexp_extract(CASE WHEN has THEN rest ELSE whole END, '^([^?#]*)', 1)")} AS judged FROM r),
c AS (SELECT *, {" + ".join(_TERM.format(t) for t in urls.STRICT)} AS n_strict, {" + ".join(_TERM.format(t) for t in urls.SOFT)} AS n_soft FROM p)
SELECT page_id, host, path, CASE {_RULE.format(*[f"'{h}{p}'" for _, h, p in URL_RULES])} END AS rule,
       CASE {_RULE.format(*[f"'{v}'" for v, _, _ in URL_RULES])} WHEN n_strict > 0 OR n_soft >= {urls.MIN_SOFT} THEN 'block' ELSE 'allow' END AS verdict,
       n_strict, n_soft
FROM c""",
    "op9_exact_dedup": f"""
WITH t AS (SELECT doc_id, sha256({_FOLD.format("text")}) AS text_sha256 FROM documents),
g AS (SELECT *, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size FROM t WINDOW w AS (PARTITION BY text_sha256))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
    "op11_fingerprints": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
nx AS (SELECT *, coalesce(lead(t) OVER w, first_value(t) OVER w) AS after,
              coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS after_id FROM d WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
ed AS (SELECT doc_id, after_id, n, t, left(t, n - n // 2) || left(after, n // 2) AS e FROM nx),
tx AS (SELECT doc_id, 'own' AS kind, {_SPLIT.format("t")} AS w FROM ed UNION ALL SELECT doc_id, 'edited', {_SPLIT.format("e")} FROM ed),
hw AS (SELECT doc_id, kind, list_transform(w, lambda x: CAST('0x' || left(md5(x), 8) AS BIGINT)) AS h, least({fingerprints.K}, len(w)) AS k FROM tx WHERE len(w) > 0),
sh AS (SELECT doc_id, kind, h[s:s + k - 1] AS r FROM hw, unnest(range(1, len(h) - k + 2)) AS u(s)),
hs AS (SELECT DISTINCT doc_id, kind, ({_POLY.format(fingerprints.BASES[0])} << 31) | {_POLY.format(fingerprints.BASES[1])} AS v FROM sh),
kept AS (SELECT doc_id, kind, v FROM (SELECT *, min(v) OVER (PARTITION BY doc_id, kind) AS low FROM hs) WHERE v < {fingerprints.LIMIT} OR v = low),
fp AS (SELECT doc_id, kind, list(v) AS vs, string_agg(lpad(lower(hex(v)), 16, '0'), '' ORDER BY v) AS f FROM kept GROUP BY ALL),
j AS (SELECT ed.doc_id, n, e, coalesce(a.vs, []) AS a, coalesce(b.vs, []) AS b, coalesce(c.vs, []) AS c, coalesce(a.f, '') AS fa, coalesce(b.f, '') AS fb
      FROM ed LEFT JOIN fp a ON a.doc_id = ed.doc_id AND a.kind = 'own' LEFT JOIN fp b ON b.doc_id = ed.doc_id AND b.kind = 'edited' LEFT JOIN fp c ON c.doc_id = after_id AND c.kind = 'own'),
m AS (SELECT *, len(list_intersect(a, b)) AS ab, len(list_intersect(a, c)) AS ac FROM j)
SELECT doc_id, n AS n_chars, sha256(e) AS edited_sha256, fa AS fingerprint, fb AS edited_fingerprint,
       CASE WHEN len(a) > 0 THEN ab / len(a) WHEN len(b) > 0 THEN 0 ELSE 1 END::DOUBLE AS near_edited,
       CASE WHEN len(a) > 0 THEN ac / len(a) WHEN len(c) > 0 THEN 0 ELSE 1 END::DOUBLE AS near_next,
       CASE WHEN len(a) + len(b) > 0 THEN ab / (len(a) + len(b) - ab) ELSE 1 END::DOUBLE AS jaccard_edited,
       CASE WHEN len(a) + len(c) > 0 THEN ac / (len(a) + len(c) - ac) ELSE 1 END::DOUBLE AS jaccard_next
FROM m""",
    "op12_infill": """
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents),
c AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS c2,
             CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
                  WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
s AS (SELECT *, least(c1, c2) AS p, greatest(c1, c2) AS q, substr(x, 1, least(c1, c2)) AS a,
             substr(x, least(c1, c2) + 1, greatest(c1, c2) - least(c1, c2)) AS b, substr(x, greatest(c1, c2) + 1) AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256,
       sha256(x) AS restored_sha256
FROM s""",
    "op13_resampling": f"""
WITH RECURSIVE tab AS (SELECT i AS byte, 0 AS bits, i AS c FROM range(256) AS r(i)
  UNION ALL SELECT byte, bits + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM tab WHERE bits < 8),
dw AS (SELECT doc_id, unnest({_WORDS}) AS w FROM documents),
bw AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
vocab AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
crc AS (SELECT w, x, 1 AS pos, 4294967295::BIGINT AS c FROM vocab
  UNION ALL SELECT w, x, pos + 2, xor(tab.c, crc.c >> 8) FROM crc JOIN tab ON bits = 8 AND byte = xor(crc.c & 255, CAST('0x' || substr(x, pos, 2) AS BIGINT)) WHERE pos < length(x)),
hashed AS (SELECT w, xor(c, 4294967295) % 10000 AS bucket FROM crc WHERE pos > length(x)),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN hashed USING (w) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN hashed USING (w) GROUP BY 1),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT count(*) FROM dw) + 10000) / ((s + 1) * ((SELECT count(*) FROM bw) + 10000)))) AS BIGINT) AS g FROM s LEFT JOIN t USING (bucket)),
per AS (SELECT doc_id, count(*) AS n, CAST(sum(g) AS BIGINT) AS weight FROM dw JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY 1),
sc AS (SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
         + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('2024:' || d.doc_id), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
       FROM documents d LEFT JOIN per USING (doc_id)),
rk AS (SELECT *, n_features >= 20 AS able, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n_features >= 20) AS many FROM sc)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND r <= 10 * many // 100 THEN r END AS rank FROM rk""",
}
