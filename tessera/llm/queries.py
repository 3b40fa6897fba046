"""The registered queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import small_batches, staged, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.decontaminate import decontaminated

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminated(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


SQL["op9_decontaminate"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS win FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, dw.i, dw.n, item FROM dw JOIN bw USING (win, n)),
hw AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM hits) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw ON hw.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id
"""


@query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.langid import held_out, identified, learned

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identified(docs.select("doc_id", "text"), learned(docs, ~held_out()))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.simhash import as_hex, grouped

    out = grouped(table(spark, sf_dir, "documents"))
    return out.select("doc_id", as_hex("fingerprint").alias("fingerprint"), "component_id")


@query
def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.html import extracted

    out = extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.warc import read, written

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    kind = pages.schema["page_id"].dataType
    out = read(written(pages))
    return out.select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind))


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.repair import read, written

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read(written(docs, vocabulary("word_bpe_49k.json"))).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.pieces import encoded

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encoded(docs, vocabulary("piece_bpe_32k.model"), ids=False, checks=True)
    with small_batches(spark):
        return staged(out.select("doc_id", "pieces.n_pieces", F.col("pieces.crc32").alias("ids_crc32"), "pieces.round_trip"), "pieces")


@query
def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.spotsigs import edited, fingerprint, likeness, signatures

    out = edited(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sigs", signatures("edited").alias("edited_sigs"), "next_sigs")
    prints = fingerprint("sigs").alias("fingerprint"), fingerprint("edited_sigs").alias("edited_fingerprint")
    return out.select("doc_id", "n_chars", "edited_sha256", *prints, likeness("sigs", "edited_sigs").alias("near_edited"), likeness("sigs", "next_sigs").alias("near_next"))


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    from tessera.llm.tokencounts import counted

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = counted(docs, vocabulary("byte_bpe_50k.tiktoken"), PATTERN).select("doc_id", F.posexplode("sections").alias("section", "s"))
    return out.select("doc_id", F.col("section").cast("bigint"), F.col("s.start"), F.col("s.end"), F.col("s.n_tokens").cast("bigint").alias("n_tokens"))


@query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.shared import scratch
    from tessera.llm.sharding import compacted

    docs = table(spark, sf_dir, "documents")
    store = compacted(docs, scratch(spark, "store"), F.pmod(F.xxhash64("doc_id"), F.lit(16)))
    return store.read().select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"), "lang", "source", "n_chars")


SQL["op6_sharding"] = "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, sha256(text) AS text_sha256, lang, source, n_chars FROM documents"


def _spots_sql(source: str) -> str:
    """(k, t, s): keys, texts and signature lists of a query that gives k and t."""
    from tessera.llm.spotsigs import COMMON

    stop = "[" + ", ".join(f"'{w}'" for w in sorted(set(COMMON))) + "]"
    mark = lambda *parts: f"substr(md5(concat_ws(' ', {', '.join(parts)})), 1, 16)"
    return f"""SELECT k, t, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN CASE WHEN t = '' THEN [] ELSE [{mark("t")}] END
        WHEN len(c) = 0 OR len(c) = len(w) THEN list_concat([{mark("''", "w[1]", "w[2]")}], list_transform(range(1, len(w) + 1), lambda i: {mark("w[i]", "w[i + 1]", "w[i + 2]")}))
        ELSE list_concat([{mark("''", "w[c[1]]", "w[c[2]]")}], flatten(list_transform(range(1, len(c) + 1),
            lambda j: list_transform(range(coalesce(c[j - 1], 0) + 1, c[j]), lambda p: {mark("w[p]", "w[c[j]]", "w[c[j + 1]]")})))) END)) AS s
        FROM (SELECT *, list_filter(range(1, len(w) + 1), lambda i: NOT list_contains({stop}, w[i])) AS c
        FROM (SELECT k, t, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]+') AS w FROM ({source})))"""


SQL["op10_spotsigs"] = f"""
WITH d AS (SELECT doc_id AS k, coalesce(text, '') AS t FROM documents),
n AS (SELECT k, t, coalesce(lead(k) OVER (ORDER BY k), min(k) OVER ()) AS nk, coalesce(lead(t) OVER (ORDER BY k), first_value(t) OVER (ORDER BY k)) AS nt FROM d),
e AS (SELECT k, substr(t, 1, length(t) - length(t) // 2) || substr(nt, 1, length(t) // 2) AS t FROM n),
ds AS ({_spots_sql("FROM d")}),
es AS ({_spots_sql("FROM e")}),
a AS (SELECT n.k, length(n.t) AS n_chars, es.t AS edited, ds.s AS x, es.s AS y, ns.s AS z FROM n JOIN ds ON ds.k = n.k JOIN es ON es.k = n.k JOIN ds ns ON ns.k = n.nk),
j AS (SELECT *, len(list_intersect(x, y)) AS xy, len(list_intersect(x, z)) AS xz FROM a)
SELECT k AS doc_id, CAST(n_chars AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, array_to_string(x, '') AS fingerprint, array_to_string(y, '') AS edited_fingerprint,
CASE WHEN len(x) + len(y) = 0 THEN 1.0::DOUBLE ELSE xy / (len(x) + len(y) - xy) END AS near_edited, CASE WHEN len(x) + len(z) = 0 THEN 1.0::DOUBLE ELSE xz / (len(x) + len(z) - xz) END AS near_next FROM j
"""

SQL["op2_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS x FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (strpos('0123456789abcdef', substr(x, i, 1)) - 1) + 1, 4)), '') AS bits FROM h),
g AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT)
+ 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT) + 1 AS INT), 1)), '') AS payload_digest FROM b)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = min(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN page_id <> min(page_id) OVER w THEN min(page_id) OVER w END AS refers_to FROM g WINDOW w AS (PARTITION BY x, n)
"""
