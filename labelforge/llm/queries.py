"""The registered query of each operator, with production parameters, over its
whole table; and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    alignment, byte_bpe, decontaminate, exact_dedup, jaccard_join, licenses, line_dedup, quality, substring_dedup, token_counts,
    url_templates, warc, whitening,
)
from .common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of benchmark items."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, bad): the label of the document whose number ends the page's
    path; toxic or of low quality is bad."""
    number = F.regexp_extract(url_templates.path_of(F.col("url")), r"/([0-9]{1,18})[^/0-9]*/?$", 1)
    shown = table(spark, sf_dir, "pages").select("page_id", F.when(number != "", number).cast("bigint").alias("doc_id"))
    bad = F.greatest(F.col("toxic"), 1 - F.col("quality")).alias("bad")
    return shown.join(table(spark, sf_dir, "labels").select("doc_id", bad), "doc_id").select("page_id", "bad")


def op2_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on every page's url."""
    return url_templates.judge_urls(table(spark, sf_dir, "pages"), page_labels(spark, sf_dir)).drop("bad_share")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that recur in others."""
    out = line_dedup.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by byte_bpe_50k.json."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by byte_bpe_multi_50k.tiktoken, and back."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, decoded=True).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to WARC archives and read back."""
    return warc.round_trip(spark, table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of 0.85 or more."""
    return jaccard_join.similar_groups(table(spark, sf_dir, "documents")).drop("node")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices of every document."""
    found = licenses.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["first_word"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and robust outliers over every document."""
    return quality.judge(table(spark, sf_dir, "documents")).drop("n_lines")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 50-word windows cut from every document but the first."""
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts, and the document of each that stays."""
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable embedding on the first 16 components."""
    out = whitening.whiten(table(spark, sf_dir, "embeddings"))
    entry = F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "e")
    return out.select("vec_id", "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"), "identity_error", entry).select(
        "vec_id", (F.col("k") + 1).alias("component"), "n", "deviation", F.col("e.whitened").alias("whitened"),
        F.col("e.explained").alias("explained"), "identity_error")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens by two tokenizers, aligned."""
    return alignment.score_links(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                 public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_url_templates": op2_url_templates,
    "op3_line_dedup": op3_line_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_warc": op6_warc,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_licenses": op8_licenses,
    "op9_quality": op9_quality,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_whitening": op12_whitening,
    "op13_alignment": op13_alignment,
}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_SPACED_WORDS = r"'[^\x20\x09-\x0D]+'"



def _sql_op2() -> str:
    """The rules and the template tree in SQL, one pair of expressions a level."""
    t = url_templates
    rule = verdict = "NULL"
    for kind, h, p in sorted(t.RULES, key=lambda r: len(r[1]) + len(r[2])):
        fits = f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
        rule = f"CASE WHEN {fits} THEN '{h}{p}' ELSE {rule} END"
        verdict = f"CASE WHEN {fits} THEN '{kind}' ELSE {verdict} END"
    d = t.DEPTH
    levels = []
    for i in range(d):
        levels.append(f"""
        child{i} AS (SELECT host, template, segments[{i + 1}] AS seg, sum(n) AS n, sum(labelled) AS labelled, sum(bad) AS bad
                     FROM tree{i} WHERE len(segments) > {i} GROUP BY ALL),
        node{i} AS (SELECT host, template, count(*) AS branches, sum(n) AS all_n, sum(labelled) AS all_labelled, sum(bad) AS all_bad
                    FROM child{i} GROUP BY ALL),
        stat{i} AS (SELECT *, all_bad / nullif(all_labelled, 0) AS pooled, all_labelled - labelled AS others FROM child{i} JOIN node{i} USING (host, template)),
        named{i} AS (SELECT host, template, seg, CASE WHEN branches > 1 AND ((branches >= {t.WIDE} AND n * branches < all_n)
                     OR labelled = 0 OR others = 0 OR pooled = 0 OR pooled = 1
                     OR abs(bad / nullif(labelled, 0) - (all_bad - bad) / nullif(others, 0))
                        <= {t.Z_MERGE} * sqrt(pooled * (1 - pooled) * (1 / nullif(labelled, 0) + 1 / nullif(others, 0)))) THEN '<*>' ELSE seg END AS part
                     FROM stat{i}),
        tree{i + 1} AS (SELECT t.host, segments, t.template || coalesce('/' || part, '') AS template, n, labelled, bad
                        FROM tree{i} t LEFT JOIN named{i} k ON t.host = k.host AND t.template = k.template AND seg = segments[{i + 1}])""")
    return rf"""
        WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{t._UPPER}', '{t._LOWER}') AS host,
                          coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        r AS (SELECT *, {rule} AS rule, {verdict} AS by_rule, string_split(regexp_replace(path, '^/', ''), '/') AS parts FROM u),
        s AS (SELECT page_id, host, path, rule, by_rule,
                     [regexp_replace(regexp_replace(x, '[0-9a-fA-F-]*[0-9][0-9a-fA-F-]*', '<*>', 'g'), '(?:<\*>[^.<]*)*<\*>', '<*>', 'g')
                      FOR x IN CASE WHEN len(parts) > {d} THEN list_concat(parts[1:{d - 1}], [array_to_string(parts[{d}:], '/')]) ELSE parts END] AS segments
              FROM r),
        l AS (SELECT page_id, max(greatest(toxic, 1 - quality)) AS bad FROM (SELECT page_id, regexp_extract(path, '/([0-9]{{1,18}})[^/0-9]*/?$', 1) AS number FROM u) k
              JOIN labels ON number <> '' AND doc_id = TRY_CAST(number AS BIGINT) WHERE greatest(toxic, 1 - quality) IS NOT NULL GROUP BY page_id),
        tree0 AS (SELECT host, segments, '' AS template, count(*) AS n, count(bad) AS labelled, coalesce(sum(bad), 0) AS bad
                  FROM s LEFT JOIN l USING (page_id) WHERE by_rule IS NULL GROUP BY ALL),{",".join(levels)},
        prior AS (SELECT coalesce(sum(bad) / nullif(sum(labelled), 0), 0) AS p FROM tree{d}),
        hosts AS (SELECT host, (sum(bad) + {t.SMOOTH} * (SELECT p FROM prior)) / (sum(labelled) + {t.SMOOTH}) AS host_share FROM tree{d} GROUP BY host),
        leaf AS (SELECT host, template, (sum(bad) + {t.SMOOTH} * any_value(host_share)) / (sum(labelled) + {t.SMOOTH}) AS share
                 FROM tree{d} JOIN hosts USING (host) GROUP BY ALL)
        SELECT page_id, host, path, rule, CASE WHEN by_rule IS NULL THEN template END AS template,
               coalesce(by_rule, CASE WHEN share > {t.REJECT} THEN 'block' ELSE 'allow' END) AS verdict
        FROM s LEFT JOIN (SELECT host, segments, template, share FROM tree{d} JOIN leaf USING (host, template)) k USING (host, segments)"""


def _sql_op3() -> str:
    t = line_dedup
    shares = " ".join(f"WHEN c >= {share} * held THEN {i}" for i, share in enumerate(t.SHARES))
    return rf"""
        WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS n
                   FROM documents WHERE text IS NOT NULL),
        w AS (SELECT *, regexp_extract_all(body, {_SPACED_WORDS}) AS w FROM l),
        t AS (SELECT *, len(w) || ' ' || array_to_string([regexp_replace(x, '[0-9]+', '#', 'g') FOR x IN w[1:{t.LEAD}]], ' ') AS leaf FROM w WHERE len(w) > 0),
        h AS (SELECT *, count(*) OVER (PARTITION BY leaf) AS held FROM t),
        k AS (SELECT doc_id, n, leaf, held, unnest(w) AS token, generate_subscripts(w, 1) AS place FROM h WHERE held >= {t.MIN_DOCS}),
        c AS (SELECT *, count(*) OVER (PARTITION BY leaf, place, token) AS c FROM k),
        v AS (SELECT *, CASE WHEN c < {t.MIN_DOCS} THEN NULL WHEN regexp_matches(token, '[0-9]') THEN {len(t.SHARES) + 1} {shares} ELSE {len(t.SHARES)} END AS level FROM c),
        p AS (SELECT doc_id, n, leaf, list(token ORDER BY place) AS tokens, list(level ORDER BY place) AS levels,
                     list_sort(list(level) FILTER (WHERE level IS NOT NULL)) AS known, CAST(ceil(CAST({t.MIN_CONSTANT} AS DOUBLE) * count(*)) AS BIGINT) AS need
              FROM v GROUP BY doc_id, n, leaf),
        named AS (SELECT doc_id, n, leaf || chr(10) || array_to_string([CASE WHEN coalesce(levels[i] <= known[need], false) THEN tokens[i] ELSE '<*>' END
                         FOR i IN range(1, len(tokens) + 1)], ' ') AS key, {t.MIN_DOCS} AS docs_needed FROM p WHERE len(known) >= need
                  UNION ALL
                  SELECT doc_id, n, chr(10) || chr(10) || regexp_replace(array_to_string(w, ' '), '[0-9]+', '#', 'g'), {t.LONG_DOCS} FROM t
                  WHERE len([x FOR x IN w IF NOT regexp_matches(x, '[0-9]')]) >= {t.LONG}),
        seen AS (SELECT key, docs_needed, min((doc_id, n)) AS first_of, count(DISTINCT text) AS docs FROM named JOIN documents USING (doc_id) GROUP BY ALL),
        gone AS (SELECT DISTINCT doc_id, n FROM named JOIN seen USING (key, docs_needed) WHERE docs >= docs_needed AND (doc_id, n) <> first_of),
        kept AS (SELECT doc_id, string_agg(body, chr(10) ORDER BY n) AS t, count(*) AS c FROM l ANTI JOIN gone USING (doc_id, n) GROUP BY doc_id),
        total AS (SELECT doc_id, count(*) AS c FROM l GROUP BY doc_id)
        SELECT documents.doc_id, coalesce(total.c, 0) AS n_lines, coalesce(total.c, 0) - coalesce(kept.c, 0) AS n_dropped,
               CASE WHEN text IS NOT NULL THEN sha256(coalesce(t, '')) END AS text_sha256
        FROM documents LEFT JOIN total USING (doc_id) LEFT JOIN kept USING (doc_id)"""


ORACLE_SQL = {
    "op3_line_dedup": _sql_op3(),
    "op2_url_templates": _sql_op2(),
    "op1_decontaminate": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, {_PLAIN_WORDS}) AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all({_LOWERED}, {_PLAIN_WORDS}) AS w FROM benchmark),
        item AS (SELECT item_id, least(10, len(w)) AS size, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM b WHERE len(w) > 0),
        win AS (SELECT DISTINCT item_id, size, array_to_string(w[k : k + size - 1], ' ') AS run FROM item),
        place AS (SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS k FROM d, (SELECT DISTINCT size FROM win) WHERE len(w) >= size),
        spot AS (SELECT doc_id, size, k, array_to_string(w[k : k + size - 1], ' ') AS run FROM place),
        hit AS (SELECT doc_id, item_id, k, spot.size AS size FROM spot JOIN win ON spot.run = win.run AND spot.size = win.size),
        covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM hit) GROUP BY doc_id),
        named AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
                  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
        SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op7_jaccard_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, {_SPACED_WORDS}) AS w FROM documents),
        runs AS (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS k FROM d WHERE len(w) > 0),
        sh AS (SELECT DISTINCT doc_id, md5(array_to_string(w[k : k + 3], ' ')) AS s FROM runs),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s GROUP BY ALL),
        link AS (SELECT a, b FROM pair JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
        reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
        least_of AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_of ON least_of.a = d.doc_id""",
    "op10_substring_dedup": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED_WORDS}) AS w FROM documents),
        starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM d WHERE len(w) >= 50),
        win AS (SELECT doc_id, k, md5(array_to_string(w[k : k + 49], ' ')) AS run FROM starts),
        first_of AS (SELECT run, min(doc_id) AS m FROM win GROUP BY run),
        gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS p FROM win JOIN first_of USING (run) WHERE m < doc_id),
        word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
        kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS c FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(c, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op6_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
        f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT d.page_id, payload_bytes, d.payload_digest,
               CASE WHEN d.page_id > f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN d.page_id > f.first_id THEN f.first_id END AS refers_to
        FROM d LEFT JOIN f USING (payload_digest)""",
    "op11_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
}
