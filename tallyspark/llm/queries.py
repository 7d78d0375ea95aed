"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, stage_table, table
from . import decontaminate, exact_dedup, lexical_search, license_scan, merge_dropout, merkle, ngram_join, secret_scan, suffix_dedup, suffix_trees, toxicity, url_rules, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn
    return register


@query()
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents")).drop("kinds", "starts", "ends")


@query()
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document and benchmark item found in it."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op3_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and what decoding them gives."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return merge_dropout.decode_documents(merge_dropout.encode_documents(docs), keep=True).select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"))


@query("""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
           FROM pages),
     f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS o FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN o = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN o <> page_id THEN o END AS refers_to FROM f
""")
def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive_table(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return found.selectExpr("CAST(key AS long) AS page_id", "payload_bytes", "payload_digest", "record_type",
                            "CAST(refers_to AS long) AS refers_to")


@query()
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query("""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
     g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
""")
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_report(table(spark, sf_dir, "documents"))


@query()
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


@query()
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                                    lambda cells: stage_table(cells, "toxic-cells")).drop("cell")


@query()
def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


#: The rules of the query.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@query("""
WITH u AS (SELECT page_id, url, strpos(url, '://') AS s FROM pages),
     p AS (SELECT page_id, CASE WHEN s > 0 THEN substr(url, s + 3) END AS rest FROM u),
     h AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1),
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
     r(rh, rp, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
                  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
     m AS (SELECT page_id, host, path, rh || rp AS rule, verdict,
                  row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rh) + length(rp) DESC) AS k
           FROM h JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT h.page_id, h.host, h.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM h LEFT JOIN m ON m.k = 1 AND m.page_id = h.page_id AND m.host = h.host AND m.path = h.path
""")
def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def _tree_sql(name: str, group: str, nodes: str) -> str:
    """CTEs of a tree over ``nodes`` (group, pos, h): ``name`` all nodes, ``name_runs`` the runs of its parents, ``name_top`` the tops."""
    return f"""
     {name} AS (SELECT {group}, 0 AS lvl, pos, h FROM {nodes} UNION ALL
           SELECT {group}, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos))
           FROM (SELECT *, count(*) OVER (PARTITION BY {group}) AS c FROM {name}) WHERE c > 1 GROUP BY {group}, lvl, pos // 3),
     {name}_top AS (SELECT {group}, max(lvl) AS height, arg_max(h, lvl) AS top FROM {name} GROUP BY {group}),
     {name}_runs AS (SELECT {group} AS run_group, lvl AS run_lvl, pos // 3 AS run, list(h ORDER BY pos) AS hs
           FROM {name} JOIN {name}_top USING ({group}) WHERE lvl < height GROUP BY {group}, lvl, pos // 3)"""


def _climb_sql(name: str, group: str, lanes: str, runs: str) -> str:
    """Folds ``lanes`` (doc_id, group, pos, h, proof) through ``runs`` level by level."""
    return f"""
     {name} AS (SELECT doc_id, {group}, 0 AS lvl, pos, h, proof FROM {lanes} UNION ALL
           SELECT doc_id, {group}, lvl + 1, pos // 3, sha256(list_aggregate(hs[:(pos % 3)] || [h] || hs[(pos % 3 + 2):], 'string_agg', '')),
                  proof || coalesce(list_aggregate(hs[:(pos % 3)] || hs[(pos % 3 + 2):], 'string_agg', ''), '')
           FROM {name} JOIN {runs} ON run_group = {group} AND run_lvl = lvl AND run = pos // 3)"""


def _leaf_sql(text: str) -> str:
    fields = ["doc_id", "source", "lang", "n_chars", text]
    return "sha256(concat(" + ", ".join(f"coalesce(octet_length(encode(CAST({f} AS VARCHAR))) || ':' || CAST({f} AS VARCHAR), '-')" for f in fields) + "))"


@query(f"""
WITH RECURSIVE
     crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
                lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS words),
     d AS (SELECT doc_id, coalesce('s' || source, 'n') AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos,
                  {_leaf_sql('text')} AS leaf, {_leaf_sql("replace(text, chr(10), '')")} AS other,
                  xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
                      lambda c, x: xor(c >> 8, words[(xor(c, x) & 255) + 1])), 4294967295) % 2 = 0 AS tampered FROM documents, crc),
     leaves AS (SELECT g, pos, leaf AS h FROM d), {_tree_sql('node', 'g', 'leaves')},
     sub AS (SELECT 0 AS o, g, row_number() OVER (ORDER BY g) - 1 AS pos, top AS h FROM node_top), {_tree_sql('forest', 'o', 'sub')},
     lanes AS (SELECT doc_id, g, pos, CASE WHEN tampered THEN other ELSE leaf END AS h, '' AS proof FROM d),
     {_climb_sql('inner_fold', 'g', 'lanes', 'node_runs')},
     upper_lanes AS (SELECT doc_id, o, sub.pos, f.h, proof FROM inner_fold f JOIN node_top USING (g) JOIN sub USING (g) WHERE lvl = height),
     {_climb_sql('outer_fold', 'o', 'upper_lanes', 'forest_runs')}
SELECT doc_id, leaf, node_top.top AS subroot, forest_top.top AS root, sha256(proof) AS proof_sha256, f.h AS folded_root, f.h = forest_top.top AS verified
FROM outer_fold f JOIN forest_top USING (o) JOIN d USING (doc_id) JOIN node_top USING (g) WHERE f.lvl = forest_top.height
""")
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document folded into the manifest, half of them without their line ends."""
    chosen = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return merkle.audit(table(spark, sf_dir, "documents"), {"text": F.when(chosen, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))})


@query(r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word,
                  generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM documents),
     s AS (SELECT *, string_agg(word, ' ') OVER f AS win, count(*) OVER f AS width
           FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
     r AS (SELECT doc_id, i, word, width = 35 AND count(*) OVER (PARTITION BY win) > 1 AS starts FROM s),
     g AS (SELECT doc_id, i, word, max(CAST(starts AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) = 1 AS gone FROM r),
     k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k USING (doc_id)
""")
def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_trees.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query(r"""
WITH c AS (SELECT 'abcdefghijklmnopqrstuvwxyz' AS lo, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' AS re),
     d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, up, lo), re)) AS term FROM documents, c),
     q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, up, lo), re)) AS term FROM benchmark, c),
     n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
     s AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM n),
     p AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
     w AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
           FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
     i AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * nn) // ll))) AS impact
           FROM p JOIN w USING (term) JOIN n USING (doc_id), s),
     r AS (SELECT item_id, doc_id, CAST(sum(times * impact) AS BIGINT) AS score
           FROM (SELECT item_id, term, count(*) AS times FROM q GROUP BY item_id, term) JOIN i USING (term) GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM r WHERE score > 0 QUALIFY rank <= 20
""")
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
