"""The named queries of this subpackage over the given tables, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerspark.llm import (
    bottomk, bpe_trie, gear, html_blocks, line_chunks, mcd, mixing, multi_index, ppm_text, spelling, term_scan, tiles, warc,
)
from ledgerspark.llm.base import arrow_rows, materialize, table
from ledgerspark.storage import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def bpe_digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each document."""
    arrow_rows(docs.sparkSession, 1000)
    both = bpe_trie.decode(bpe_trie.encode(docs, TOKENIZER), TOKENIZER)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


@query("op1_html_blocks")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark, 500)
    found = html_blocks.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


_CHUNK_SQL = f"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
     l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM t),
     w AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n,
                  CAST('0x' || left(md5(line), 8) AS BIGINT) % {line_chunks.MODULUS} AS x
           FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
     m AS (SELECT *, (x + 31 * coalesce(lag(x) OVER (PARTITION BY doc_id ORDER BY n), 0)) % {line_chunks.MODULUS} % {line_chunks.DIVISOR} = 0
                     OR n = max(n) OVER (PARTITION BY doc_id) AS mark FROM w),
     p AS (SELECT *, coalesce(max(CASE WHEN mark THEN n END)
                     OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS last_mark FROM m),
     e AS (SELECT doc_id, i AS last, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY n) + 1, 0) AS first
           FROM p WHERE mark OR (n - last_mark) % {line_chunks.MAX_LINES} = 0),
     c AS (SELECT e.doc_id, e.first, e.last, string_agg(l.line, chr(10) ORDER BY l.i) AS body,
                  count(*) FILTER (WHERE regexp_matches(l.line, '[^\\x20\\x09-\\x0D]')) AS worded
           FROM e JOIN l ON l.doc_id = e.doc_id AND l.i BETWEEN e.first AND e.last GROUP BY ALL),
     g AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, first) AS copy
           FROM c WHERE worded >= {line_chunks.MIN_LINES} AND length(body) >= {line_chunks.MIN_CHARS}),
     r AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.doc_id IS NULL) AS text,
                  count(g.doc_id) AS removed_lines
           FROM l LEFT JOIN g ON g.copy > 1 AND g.doc_id = l.doc_id AND l.i BETWEEN g.first AND g.last GROUP BY l.doc_id)
SELECT r.doc_id, coalesce(r.text, '') AS text, removed_lines, length(d.text) - length(coalesce(r.text, '')) AS removed_chars
FROM r JOIN documents d USING (doc_id)
"""


@query("op3_line_chunks", _CHUNK_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_chunks.dedup_lines(docs)


@query("op4_bpe_trie")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def fifth_held_out(id_col: str = "doc_id"):
    """The documents that the language model does not learn from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 1


@query("op5_ppm")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark, 2000)
    return ppm_text.score(table(spark, sf_dir, "documents"), fifth_held_out())


@query("op6_bottom_k")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark, 1000)
    found = bottomk.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


@query("op7_mcd_outliers")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = mcd.judge(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return judged.drop("n_lines", "distance")


@query("op8_gear_chunks")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark, 1000)
    return gear.dedup_substrings(table(spark, sf_dir, "documents"))


@query(
    "op9_block_tiles",
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
                  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
            s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
                  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
            r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
       SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20""",
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.nearest(table(spark, sf_dir, "embeddings"), "id % 20 = 0", 20)


#: Targets of the mixing query: half of all tokens, at most two epochs.
SHARE, EPOCHS, SEED = 0.5, 2, 7
DOMAIN_WEIGHTS = {"d0": 2.0, "d1": 1.0, "d2": 4.0}
LANGUAGE_WEIGHTS = {"en": 3.0, "es": 4.0}
SOURCE_WEIGHTS = {"src3": 2.0, "src7": 0.5}


def domain_of(source_col: str = "source"):
    """The tables have no domain; sources are dealt to four by their number, those without one form a fifth (null)."""
    number = F.regexp_extract(source_col, "([0-9]+)$", 1).try_cast("int")
    return F.concat(F.lit("d"), (number % 4).cast("string"))


def mixed(docs: DataFrame, share: float = SHARE) -> DataFrame:
    return mixing.mix(docs, domain_of(), share, EPOCHS, (DOMAIN_WEIGHTS, LANGUAGE_WEIGHTS, SOURCE_WEIGHTS), SEED)


def _case(column: str, weights: dict[str, float]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in weights.items()) + " ELSE 1e0 END"


def _level_sql(depth: int) -> str:
    """Budgets of one level of the tree, from those of the level above."""
    keys = [f"l{i}" for i in range(depth + 1)]
    up, name = ", ".join(keys[:-1]), keys[-1]
    part = f"PARTITION BY {up}" if up else ""
    filled = f"OVER ({part} ORDER BY supply / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    source = (
        f"(SELECT {', '.join(keys)}, sum(supply) AS supply, max(w{depth}) AS weight, sum(avail) AS avail FROM tree GROUP BY ALL) n "
    )
    total = (
        f"JOIN b{depth - 1} u ON " + " AND ".join(f"n.{k} IS NOT DISTINCT FROM u.{k}" for k in keys[:-1])
        if up
        else "CROSS JOIN (SELECT least((SELECT sum(avail) FROM leaves) * {share}e0, (SELECT sum(supply) FROM tree)) AS budget) u"
    ).replace("{share}", str(SHARE))
    return f"""
     n{depth} AS (SELECT n.*, u.budget AS total FROM {source} {total}),
     f{depth} AS (SELECT *, sum(supply) {filled} + supply / weight * (sum(weight) OVER ({part}) - sum(weight) {filled}) <= total AS is_full
                  FROM n{depth}),
     b{depth} AS (SELECT {', '.join(keys)}, avail,
                  CASE WHEN is_full THEN CAST(supply AS DOUBLE)
                       ELSE (total - coalesce(sum(CASE WHEN is_full THEN supply END) OVER ({part}), 0)) * weight
                            / sum(CASE WHEN NOT is_full THEN weight END) OVER ({part}) END AS budget FROM f{depth}),"""


ORACLES["op10_tree_mixing"] = f"""
WITH d AS (SELECT doc_id, 'd' || CAST(CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 4 AS VARCHAR) AS l0, lang AS l1, source AS l2,
                  len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS n FROM documents),
     leaves AS (SELECT l0, l1, l2, CAST(sum(n) AS DOUBLE) AS avail FROM d GROUP BY ALL),
     tree AS (SELECT *, avail * {EPOCHS} AS supply, {_case('l0', DOMAIN_WEIGHTS)} AS w0, {_case('l1', LANGUAGE_WEIGHTS)} AS w1,
                     {_case('l2', SOURCE_WEIGHTS)} AS w2 FROM leaves WHERE avail > 0),
     {_level_sql(0)}{_level_sql(1)}{_level_sql(2)}
     q AS (SELECT *, CAST(least(floor(budget / avail), {EPOCHS}) AS BIGINT) AS whole FROM b2),
     o AS (SELECT d.*, q.whole, CAST(floor(q.budget) AS BIGINT) - q.whole * CAST(q.avail AS BIGINT) AS rest,
                  CAST('0x' || left(md5('{SEED}:' || q.whole || ':' || d.doc_id), 15) AS BIGINT) AS place
           FROM d JOIN q ON d.l0 IS NOT DISTINCT FROM q.l0 AND d.l1 IS NOT DISTINCT FROM q.l1 AND d.l2 IS NOT DISTINCT FROM q.l2),
     r AS (SELECT *, sum(n) OVER (PARTITION BY l0, l1, l2 ORDER BY place, doc_id) <= rest AND rest > 0 AS taken FROM o)
SELECT doc_id, l0 AS domain, l1 AS lang, l2 AS source, CAST(n AS BIGINT) AS n_tokens, whole + CASE WHEN taken THEN 1 ELSE 0 END AS copies
FROM r WHERE whole + CASE WHEN taken THEN 1 ELSE 0 END > 0
"""


@query("op10_tree_mixing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "domain", "lang", "source", "n_tokens", "copies")


@query(
    "op2_warc_captures",
    """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
            h AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS holder FROM p)
       SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
              CASE WHEN n >= 1000 AND holder <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
              CASE WHEN n >= 1000 AND holder <> page_id THEN holder END AS refers_to FROM h""",
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc-archives")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    # The result asks for digest and size of each payload that is read back, so these travel instead of the payload.
    records = warc.read_archives(spark, path).withColumns({"sha1": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    records = materialize(records.drop("payload"), "warc-records")
    captures = warc.assemble(records, ("type", "refers_to", "payload_digest", "sha1", "size"))
    field = lambda name: F.get("metadata", F.lit(0))["fields"][name].cast("long")
    rows = captures.select(
        "capture_id",
        field("pageId").alias("page_id"),
        F.coalesce(field("payloadLength"), F.col("capture.size")).alias("payload_bytes"),
        F.when(F.col("capture.type") == "response", F.col("capture.sha1"))
        .otherwise(F.regexp_replace("capture.payload_digest", "^sha1:", ""))
        .alias("payload_digest"),
        F.col("capture.type").alias("record_type"),
        F.col("capture.refers_to").alias("target"),
    )
    rows = materialize(rows, "warc-captures")
    # Pages by their records: a revisit names the record, the result the page.
    pages = rows.where("record_type = 'response'").select(F.col("capture_id").alias("target"), F.col("page_id").alias("refers_to"))
    return rows.join(pages, "target", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(
    "op11_multi_index",
    """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
                            WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
            l AS (SELECT a.vec_id, b.vec_id AS other FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
                  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
            r AS (SELECT vec_id, vec_id AS reached FROM embeddings UNION SELECT r.vec_id, l.other FROM r JOIN l ON l.vec_id = r.reached),
            c AS (SELECT vec_id, min(reached) AS component_id FROM r GROUP BY vec_id),
            n AS (SELECT vec_id, count(*) AS n_links FROM l GROUP BY vec_id)
       SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
       FROM c LEFT JOIN n USING (vec_id)""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = multi_index.near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


_TERM = "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@query(
    "op12_term_scan",
    f"""WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, {_LOWER}), {_TERM})) AS term FROM documents),
             f AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
             n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
             t AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_words FROM n),
             i AS (SELECT item_id, term, count(*) AS times FROM (
                     SELECT item_id, unnest(regexp_extract_all(translate(text, {_LOWER}), {_TERM})) AS term FROM benchmark) GROUP BY ALL),
             w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, t GROUP BY term, n_docs),
             s AS (SELECT item_id, f.doc_id,
                          CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_words)))) AS BIGINT) AS score
                   FROM f JOIN i USING (term) JOIN w USING (term) JOIN n ON n.doc_id = f.doc_id, t GROUP BY item_id, f.doc_id),
             r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 20""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_scan.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 20)


#: DuckDB has no CRC-32; the table of its byte steps follows from the polynomial by eight shifts.
_CRC_SQL = """bits AS (SELECT b, b AS x, 0 AS k FROM range(256) t(b)
               UNION ALL SELECT b, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, k + 1 FROM bits WHERE k < 8),
             crc AS (SELECT list(x ORDER BY b) AS steps FROM bits WHERE k = 8)"""
_HASH_SQL = """xor(4294967295, list_reduce(list_transform(range(len(h) // 2), lambda i: CAST('0x' || h[2 * i + 1 : 2 * i + 2] AS BIGINT)),
                    lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1]), 4294967295))"""


@query(
    "op13_bit_sliced",
    f"""WITH RECURSIVE {_CRC_SQL},
             a AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, {_LOWER}), '[a-z\u00C0-\u00FF]+')) AS run FROM documents),
             b AS (SELECT doc_id, run, count(*) AS n, lower(hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run))) AS h FROM a GROUP BY ALL),
             k AS (SELECT run, n, {_HASH_SQL} AS hash FROM b, crc),
             s AS (SELECT CASE WHEN hash % 97 = 0 THEN left(run, CAST(hash % length(run) AS INT)) || substring(run, CAST(hash % length(run) AS INT) + 2)
                               ELSE run END AS word, n FROM k),
             v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM s WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
             e AS (SELECT word, n, i, left(word, CAST(i AS INT)) || substring(word, CAST(i AS INT) + 2) AS rest
                   FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
             p AS (SELECT x.word, y.word AS other, y.n FROM e x JOIN e y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
                   UNION SELECT e.word, v.word, v.n FROM e JOIN v ON v.word = e.rest
                   UNION SELECT v.word, e.word, e.n FROM e JOIN v ON v.word = e.rest),
             m AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS best, max(n) AS best_n FROM p GROUP BY word),
             f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * n THEN best END AS form,
                          CASE WHEN best_n >= 2 * n THEN best_n END AS form_n FROM v LEFT JOIN m USING (word)),
             c AS (SELECT word, word AS root, form FROM f UNION ALL SELECT c.word, f.word, f.form FROM c JOIN f ON f.word = c.form)
        SELECT f.word, f.form, c.root, f.n, n_near, form_n FROM f JOIN c ON c.word = f.word AND c.form IS NULL""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents")))
