"""The registered queries of the training-data operators: thin digests of what the operators return."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, exact_dedup, license_scan, ngram_join, pii, pivot_index, prefix_trie, sharding, token_counts, toxicity, url_filters, whitening

TOKENIZER = "byte_bpe_50k.json"
SHARD_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict, glob of every page; not in any order."""
    return url_filters.filter_urls(table(spark, sf_dir, "pages"), url_filters.BASE_RULES + url_filters.OWN_RULES)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    out = bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.encode(ids, "UTF-8"), 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document."""
    out = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    at = F.transform("places", lambda x: x["pos"])
    return out.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"), F.concat_ws(",", "base_labels").alias("base_labels"), F.concat_ws(",", "labels").alias("labels"), "score")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document; the cache starts empty, so all distinct texts are misses."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def _span_list(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def _count_of(kind: str) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document."""
    out = pii.find_pii(table(spark, sf_dir, "documents"))
    n = [_count_of(k).alias(f"n_{k}") for k in pii.BASE_KINDS]
    return out.select("doc_id", *n, F.sha2(F.encode(_span_list(F.col("base")), "UTF-8"), 256).alias("base_sha256"), _span_list(F.col("spans")).alias("spans"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learned from labels of rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    machine = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score_toxicity(docs, machine)
    return out.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, depth, shard, shard_bytes, oversize of every document, for shards of SHARD_BYTES."""
    return sharding.assign_shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document: 3-word shingles, links from 90 %."""
    return ngram_join.join_components(table(spark, sf_dir, "documents")).drop("fp")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, similarity, start of every document and benchmark item that a window of it is similar to."""
    return decontamination.find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node of the rebuilt conversations' trie."""
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_near_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector: links from a cosine of 0.9."""
    return pivot_index.near_duplicates(table(spark, sf_dir, "embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every whole vector and each of 16 components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def _rules_sql() -> str:
    """Base rules, the longest first, then the method's own globs."""
    base = sorted((r for r in url_filters.BASE_RULES), key=lambda r: -len(r.text))
    fits = lambda r: (h := r.text.split("/", 1)[0]) and f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '/{r.text.split('/', 1)[1]}')"
    globs = {r.text: f"regexp_matches(canonical, '{_glob_regex(r.text)}')" for r in url_filters.OWN_RULES}
    case = lambda base_of, glob_of, last: "CASE " + " ".join([f"WHEN {fits(r)} THEN {base_of(r)}" for r in base] + [f"WHEN {globs[r.text]} THEN {glob_of(r)}" for r in url_filters.OWN_RULES]) + f" ELSE {last} END"
    rule = case(lambda r: f"'{r.text}'", lambda r: "NULL", "NULL")
    verdict = case(lambda r: f"'{r.verdict}'", lambda r: f"'{r.verdict}'", "'allow'")
    glob = case(lambda r: "NULL", lambda r: f"'{r.text}'", "NULL")
    return f"""
WITH cut AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path
  FROM pages), joined AS (SELECT *, '.' || host || path AS canonical FROM cut)
SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict, {glob} AS glob FROM joined"""


def _glob_regex(glob: str) -> str:
    return "^" + glob.replace("**", "\x00").replace("*", "[^/]*").replace("\x00", "(?s:.*)").replace("(?s:.[^/]*)", "(?s:.*)") + "$"


OP6_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.text) AS text_sha256
FROM t JOIN g ON t.text = g.text"""


def _licenses_sql() -> str:
    """The positional votes of all licence words, with IDF over all documents, and key phrases of what they propose."""
    templates, common = license_scan.TEMPLATES, license_scan.FUNCTION_WORDS
    postings = [(name, w, k) for name, (text, _) in templates.items() for k, w in enumerate(text.split()) if w not in common]
    keys = [(name, p) for name, (_, phrases) in templates.items() for p in phrases]
    rows = lambda of: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in of)
    vocabulary = rows((w,) for w in sorted({w for _, w, _ in postings}))
    runs = {len(p.split()) for p in [*license_scan.BASE_PHRASES, *[p for _, p in keys]]}
    run = lambda n: "SELECT doc_id, pos, " + " || ' ' || ".join(["word"] + [f"lead(word, {k}) OVER w" for k in range(1, n)]) + " AS phrase FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY pos)"
    return f"""
WITH cut AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS list FROM documents),
words AS (SELECT doc_id, unnest(list) AS word, unnest(generate_series(0, len(list) - 1)) AS pos FROM cut),
runs AS ({" UNION ALL ".join(map(run, sorted(runs)))}),
base AS (SELECT * FROM runs JOIN (VALUES {rows(license_scan.BASE_PHRASES.items())}) b(phrase, label) USING (phrase)),
of_base AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id),
postings AS (SELECT * FROM (VALUES {rows(postings)}) p(name, word, k)),
df AS (SELECT v.word, count(DISTINCT w.doc_id) AS n FROM (VALUES {vocabulary}) v(word) LEFT JOIN words w USING (word) GROUP BY v.word),
idf AS (SELECT word, ln(((SELECT count(*) FROM documents) + 1) / (n + 1)) + 1e-6 AS idf FROM df),
mass AS (SELECT name, sum(idf) AS mass FROM postings JOIN idf USING (word) GROUP BY name),
agreed AS (SELECT doc_id, name, pos - k AS shift, sum(idf / mass) AS score FROM words JOIN postings USING (word) JOIN idf USING (word) JOIN mass USING (name) GROUP BY ALL),
scored AS (SELECT doc_id, name, round(max(score), 6) AS score FROM agreed GROUP BY ALL),
own AS (SELECT DISTINCT doc_id, CASE name {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in license_scan.LABELS.items())} ELSE name END AS label
        FROM scored JOIN (VALUES {rows(keys)}) k(name, phrase) USING (name) JOIN runs USING (doc_id, phrase) WHERE score >= {license_scan.LEAST_SCORE}),
labels AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM own UNION SELECT doc_id, label FROM base) GROUP BY doc_id)
SELECT doc_id, CAST(len(list) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, least(1.0, coalesce((SELECT max(score) FROM scored s WHERE s.doc_id = cut.doc_id), 0.0)) AS score
FROM cut LEFT JOIN of_base USING (doc_id) LEFT JOIN labels USING (doc_id)"""


OP9_SQL = """
WITH RECURSIVE cut AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM cut),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
few AS (SELECT t FROM each GROUP BY t HAVING count(*) > 1),
shared AS (SELECT doc_id, n, t FROM each JOIN few USING (t)),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM shared a JOIN shared b ON a.t = b.t AND a.doc_id <> b.doc_id AND a.n * 100 >= b.n * 90 AND b.n * 100 >= a.n * 90
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c.component_id FROM sets JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)"""

OP8_SQL = f"""
WITH t AS (SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
f AS (SELECT doc_id, n_bytes, h, d.depth, h >> (60 - d.depth) AS over FROM t, LATERAL (SELECT unnest(generate_series(0, 60)) AS depth) d),
s AS (SELECT depth, over, sum(n_bytes) AS held, min(h) = max(h) AS one FROM f GROUP BY depth, over),
p AS (SELECT f.doc_id, f.n_bytes, f.depth, f.over, s.held, row_number() OVER (PARTITION BY f.doc_id ORDER BY f.depth) AS k FROM f JOIN s USING (depth, over) WHERE s.held <= {SHARD_BYTES} OR s.one)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(depth AS INTEGER) AS depth, depth || ':' || over AS shard, CAST(held AS BIGINT) AS shard_bytes, held > {SHARD_BYTES} AS oversize
FROM p WHERE k = 1"""

OP11_SQL = """
WITH RECURSIVE raw AS (
  SELECT conv_id AS c, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, length(coalesce(text, '')) AS len FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, c - c % 100 AS base, k, len, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) AS i FROM raw),
crc AS (
  SELECT DISTINCT c, CAST(c AS VARCHAR) AS s, 0 AS b, CAST(4294967295 AS BIGINT) AS v FROM own
  UNION ALL
  SELECT c, s, b + 1, CASE WHEN w % 2 = 1 THEN xor(w >> 1, CAST(3988292384 AS BIGINT)) ELSE w >> 1 END
  FROM (SELECT c, s, b, CASE WHEN b % 8 = 0 THEN xor(v, CAST(ascii(s[b // 8 + 1]) AS BIGINT)) ELSE v END AS w FROM crc WHERE b < 8 * length(s)) x),
convs AS (SELECT c, c - c % 100 AS base, xor(v, CAST(4294967295 AS BIGINT)) % 6 AS h FROM crc WHERE b = 8 * length(s)),
taken AS (
  SELECT convs.c, 0 AS part, own.i, own.k, own.len FROM convs JOIN own ON own.c = convs.base AND own.i <= h
  UNION ALL
  SELECT convs.c, 1, own.i, own.k, own.len FROM convs JOIN own ON own.c = convs.c AND own.i > h),
seqs AS (SELECT convs.c, coalesce(list(k ORDER BY part, i) FILTER (k IS NOT NULL), []) AS ks, list(len ORDER BY part, i) FILTER (k IS NOT NULL) AS ls FROM convs LEFT JOIN taken ON taken.c = convs.c GROUP BY convs.c),
walks AS (SELECT c, ks, ls, unnest(generate_series(0, len(ks))) AS d FROM seqs),
nodes AS (SELECT ks[1:d] AS p, d, min(c) AS conv_id, count(*) AS n, CASE WHEN d = 0 THEN 0 ELSE any_value(ls[d]) END AS len, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(ks) = d) AS ends FROM walks GROUP BY ks[1:d], d),
kids AS (SELECT p[1:d - 1] AS p, count(*) AS m FROM nodes WHERE d > 0 GROUP BY p[1:d - 1]),
own_sums AS (SELECT nodes.*, coalesce(m, 0) AS m FROM nodes LEFT JOIN kids ON kids.p = nodes.p),
ups AS (SELECT p, m, n, len, unnest(generate_series(0, d)) AS a FROM own_sums),
sums AS (SELECT p[1:a] AS p, sum(CASE WHEN m = 0 THEN 1 ELSE 0 END) AS leaves, sum((n - 1) * len) AS saved FROM ups GROUP BY p[1:a])
SELECT o.conv_id, CAST(o.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, CAST(o.n AS BIGINT) AS n_convs, CAST(o.m AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(o.ends, '')) AS ends_sha256
FROM own_sums o JOIN sums ON sums.p = o.p LEFT JOIN nodes up ON o.d > 0 AND up.p = o.p[1:o.d - 1]"""

OP12_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c"""

ORACLE_SQL = {"op1_url_filters": _rules_sql(), "op3_license_scans": _licenses_sql(), "op6_exact_dedup": OP6_SQL, "op8_sharding": OP8_SQL, "op9_ngram_jaccard_join": OP9_SQL, "op11_prefix_trie": OP11_SQL, "op12_near_embeddings": OP12_SQL}

QUERIES = {f.__name__: f for f in (op1_url_filters, op2_bpe, op3_license_scans, op4_token_counts, op5_pii, op6_exact_dedup, op7_toxicity, op8_sharding, op9_ngram_jaccard_join, op10_decontamination, op11_prefix_trie, op12_near_embeddings, op13_whitening)}
