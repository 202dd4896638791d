"""The registered queries of this subpackage, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat_template, collision_ann, collocations, line_dedup, lm_score, mixing, ngram_join, packing, reply_trees, sentence_spans, topk, toxicity, url_filter, whitening
from .shared import documents

WEIGHTS = [1, 2, 3]
MOST_COPIES = 3.0
LISTED_HOSTS = r"(^|\.)ads-track\."


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_top_k(spark, sf_dir):
    return topk.exact_top_k(_table(spark, sf_dir, "embeddings"))


def op2_mix_sources(spark, sf_dir):
    mix = mixing.copies(documents(spark, sf_dir), WEIGHTS, MOST_COPIES)
    return mix.select("doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op3_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.jaccard_components(documents(spark, sf_dir), width=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op4_url_filters(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    listed = pages.where(url_filter.host_of(F.col("url")).rlike(LISTED_HOSTS)).select(url_filter.canonical(F.col("url")).alias("canonical_url"))
    return url_filter.judge(pages, listed)


def tokenizer_files() -> dict:
    import public_tokenizers

    return {"file": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op5_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir), **tokenizer_files())


def op6_approximate_neighbours(spark, sf_dir):
    return collision_ann.approximate_neighbours(_table(spark, sf_dir, "embeddings"))


def op7_lm_scoring(spark, sf_dir):
    return lm_score.score_documents(documents(spark, sf_dir))


def op8_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return toxicity.scored(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op9_line_dedup(spark, sf_dir):
    out = line_dedup.delete_repeats(documents(spark, sf_dir))
    runs = F.transform("runs", lambda x: F.concat(x["first"].cast("string"), F.lit("-"), x["last"].cast("string")))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.array_join(runs, ",").alias("runs"), "kept_text")


def op10_substring_dedup(spark, sf_dir):
    return sentence_spans.remove_repeats(documents(spark, sf_dir))


def op11_reply_trees(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))], rows.schema)
    out = reply_trees.read_back(reply_trees.formatted(reply_trees.threads(rows.unionByName(probe))))
    return out.withColumnRenamed("tree", "conv_id").drop("path")


def op12_embedding_whitening(spark, sf_dir):
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_phrase_collocations(spark, sf_dir):
    return collocations.collocations(documents(spark, sf_dir))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_exact_top_k, op2_mix_sources, op3_ngram_jaccard_join, op4_url_filters, op5_packing, op6_approximate_neighbours,
                                   op7_lm_scoring, op8_toxicity, op9_line_dedup, op10_substring_dedup, op11_reply_trees, op12_embedding_whitening,
                                   op13_phrase_collocations, pipeline)}

WORD = r"[^\x20\x09-\x0D]+"

SQL = {}

SQL["op1_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
  FROM v AS q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0 AND len(q.e) = len(v.e))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) AS t WHERE rank <= 5"""

SQL["op2_mix_sources"] = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(source, '') AS src, source IS NULL AS no_source,
    CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
    (CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|mix'), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM documents),
p AS (SELECT no_source, src, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, (row_number() OVER (ORDER BY no_source, src) - 1) % 3 + 1 AS weight, source_size * 3.0e0 AS cap FROM p),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, no_source, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, no_source, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT no_source, src, source_size, least(cap, weight * max(CASE WHEN cap >= weight * level THEN level END) OVER ()) AS target FROM l),
e AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0e0) ELSE 0 END AS e FROM d JOIN t USING (no_source, src)),
f AS (SELECT *, CAST(floor(e) AS BIGINT) AS whole, e - floor(e) AS frac FROM e),
g AS (SELECT *, target - sum(whole * size) OVER (PARTITION BY no_source, src) AS remaining FROM f),
h AS (SELECT doc_id, coalesce(sum(size) OVER (PARTITION BY no_source, src ORDER BY (u / (1 - u)) / (frac / (1 - frac)), u, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g WHERE frac > 0)
SELECT g.doc_id, source, size, source_size, target, whole + CASE WHEN frac > 0 AND 2 * before + size <= 2 * remaining THEN 1 ELSE 0 END AS copies,
  (whole + CASE WHEN frac > 0 AND 2 * before + size <= 2 * remaining THEN 1 ELSE 0 END) * size AS taken
FROM g LEFT JOIN h ON g.doc_id = h.doc_id"""

SQL["op3_ngram_jaccard_join"] = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 3], ' ') END AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0) AS x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_in FROM s AS a JOIN s AS b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * both_in >= 85 * (x.n + y.n - both_in)),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, l.b FROM reach AS r JOIN link AS l ON r.seen = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents AS d LEFT JOIN n USING (doc_id)
JOIN (SELECT node, min(seen) AS component_id FROM reach GROUP BY node) AS c ON c.node = d.doc_id"""

_HOST = r"coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_filter.RULES)
SQL["op4_url_filters"] = rf"""
WITH a AS (
  SELECT page_id, {_HOST} AS host, coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path,
    regexp_replace(regexp_replace(coalesce(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), ''), '(^|&)(utm_[a-z]*|ref)=[^&]*', '', 'g'), '^&', '') AS q FROM pages),
b AS (SELECT *, CASE WHEN regexp_replace(host, '^www\.', '') = '' THEN '' ELSE
    regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS canonical_url FROM a),
listed AS (SELECT DISTINCT canonical_url FROM b WHERE regexp_matches(host, '(^|\.)ads-track\.') AND canonical_url <> ''),
r AS (SELECT * FROM (VALUES {_RULES}) AS t(rule_host, rule_path, rule_verdict)),
j AS (SELECT b.*, rule_host || rule_path AS rule, rule_verdict, listed.canonical_url IS NOT NULL AS listed
  FROM b LEFT JOIN listed ON b.canonical_url = listed.canonical_url
  LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, canonical_url, listed
FROM j QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) = 1"""

LINE_SQL = rf"""
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM {{docs}}),
m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1 AS idx FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
g AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY idx) AS after FROM m),
two AS (SELECT doc_id, idx FROM (SELECT doc_id, idx, row_number() OVER (PARTITION BY line, after ORDER BY doc_id, idx) AS k FROM g WHERE after IS NOT NULL) AS x WHERE k > 1),
one AS (SELECT doc_id, idx FROM (SELECT doc_id, idx, row_number() OVER (PARTITION BY line ORDER BY doc_id, idx) AS k FROM m
  WHERE len(regexp_extract_all(line, '{WORD}')) >= 50) AS x WHERE k > 1),
gone AS (SELECT doc_id, idx FROM two UNION SELECT doc_id, idx + 1 FROM two UNION SELECT doc_id, idx FROM one),
runs AS (SELECT doc_id, min(idx) AS a, max(idx) AS b FROM (SELECT doc_id, idx, idx - row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS grp FROM gone) AS x GROUP BY doc_id, grp),
cuts AS (SELECT runs.doc_id, x.no AS a, y.no AS b, runs.a AS first, runs.b AS last FROM runs JOIN m AS x ON x.doc_id = runs.doc_id AND x.idx = runs.a JOIN m AS y ON y.doc_id = runs.doc_id AND y.idx = runs.b),
kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY no) AS kept FROM l WHERE NOT EXISTS (SELECT 1 FROM cuts WHERE cuts.doc_id = l.doc_id AND no BETWEEN cuts.a AND cuts.b) GROUP BY l.doc_id)"""

SQL["op9_line_dedup"] = "WITH " + LINE_SQL.replace("{docs}", "documents") + """
SELECT d.doc_id, coalesce(x.n, 0) AS n_lines, coalesce(y.n, 0) AS n_removed, coalesce(y.runs, '') AS runs, CASE WHEN text IS NOT NULL THEN coalesce(kept.kept, '') END AS kept_text
FROM documents AS d LEFT JOIN (SELECT doc_id, count(*) AS n FROM m GROUP BY doc_id) AS x ON x.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, CAST(sum(last - first + 1) AS BIGINT) AS n, string_agg(first || '-' || last, ',' ORDER BY first) AS runs FROM cuts GROUP BY doc_id) AS y ON y.doc_id = d.doc_id
LEFT JOIN kept ON kept.doc_id = d.doc_id"""

_NAMES = chat_template.NAMES
_ESCAPED = rf"regexp_replace({{0}}, '([<\[])(\\*){_NAMES}', '\1\\\2\3', 'g')"
_KEY = "turn NULLS LAST, role, md5(text)"
SQL["op11_reply_trees"] = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) AS t),
f AS (SELECT *, length({_ESCAPED.format('text')}) + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 9
    ELSE 19 + length({_ESCAPED.format('role')}) END AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY {_KEY})) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY {_KEY}) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(chars) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id"""

SQL["op13_phrase_collocations"] = r"""
WITH p AS (SELECT lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, text FROM documents)),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (
  SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) AS t(k) WHERE len(ws) >= k)),
n AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
cut AS (SELECT c.lang, c.phrase, a, i, x.f AS l, y.f AS r, CAST((2000000 * CAST(a AS HUGEINT)) // (x.f + y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS i FROM c) AS c
  JOIN f AS x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:i], ' ') JOIN f AS y ON y.lang = c.lang AND y.phrase = array_to_string(ws[i + 1:], ' ')),
s AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
inside AS (SELECT lang, sub, max(a) AS most FROM (SELECT lang, a, array_to_string(ws[i:i + m - 1], ' ') AS sub FROM (
  SELECT *, unnest(range(1, k - m + 2)) AS i FROM c, (VALUES (2), (3)) AS t(m) WHERE m < k)) GROUP BY ALL),
kept AS (SELECT s.* FROM s LEFT JOIN inside ON s.lang = inside.lang AND s.phrase = sub WHERE most IS NULL OR 100 * CAST(most AS HUGEINT) < 80 * CAST(a AS HUGEINT))
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) AS k JOIN n USING (lang) WHERE rank <= 2000"""
