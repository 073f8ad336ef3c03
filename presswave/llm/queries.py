"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswave.llm import exact_dedup, fill_middle, html_extract, language_id, line_dedup, near_dedup, packing, permutation_index, prefix_trie, quality, quotes, sentencepiece_codec, warc
from presswave.storage import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(table(spark, sf_dir, "conversations"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "evidence", "host_mean", "path_mean", "posterior", "kept")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece_codec.roundtrip(table(spark, sf_dir, "documents"), model)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("n_chunks")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = materialize(prefix_trie.ordered_turns(table(spark, sf_dir, "conversations")), "turns")
    return prefix_trie.prefix_trie(*prefix_trie.grafted(turns))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_middle.fill_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    restored = fill_middle.restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", restored["sha256"].alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_permutation_index, op2_quotation_linking, op3_quality_classifier, op4_line_dedup, op5_text_density, op6_packing, op7_sentencepiece, op8_exact_dedup, op9_warc, op10_bagminhash, op11_prefix_trie, op12_language_id, op13_fill_middle)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_line_dedup": """
            WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
            l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
            k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
            r AS (SELECT key, max(doc_id) AS keep_doc FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
            f AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.keep_doc AS gone FROM k LEFT JOIN r USING (key))
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
                   sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
            FROM f GROUP BY doc_id""",
        "op8_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER t AS keep_id, count(*) OVER t AS group_size, doc_id = max(doc_id) OVER t AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW t AS (PARTITION BY coalesce(text, ''))""",
        "op2_quotation_linking": """
            WITH t AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
            b AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM t),
            m AS (SELECT row_number() OVER () AS id, conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations),
            l AS (SELECT id, conv_id, turn, pos, line, length(regexp_replace(regexp_extract(line, '^(?:\\s*>)+'), '[^>]', '', 'g')) AS level, regexp_replace(line, '^(?:\\s*>)+', '') AS body
                  FROM (SELECT id, conv_id, turn, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM m)),
            k AS (SELECT *, CASE WHEN level = 0 AND trim(body) = '' THEN -1 ELSE level END AS kind, coalesce(lead(level) OVER (PARTITION BY id ORDER BY pos), 0) AS next_level FROM l),
            n AS (SELECT *, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY id ORDER BY pos) THEN 1 ELSE 0 END AS starts FROM k),
            g AS (SELECT *, sum(starts) OVER (PARTITION BY id ORDER BY pos) AS run FROM n),
            p AS (SELECT conv_id, turn, level, pos, 0 AS whole, body FROM g
                  UNION ALL SELECT conv_id, turn, min(level), -1, 1, string_agg(body, ' ' ORDER BY pos) FROM g GROUP BY id, conv_id, turn, run),
            h AS (SELECT DISTINCT conv_id, turn, level, pos, whole, lower(trim(regexp_replace(body, '\\s+', ' ', 'g'))) AS body FROM p WHERE trim(body) <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL),
            o AS (SELECT conv_id, body, min(turn) AS origin FROM h WHERE level = 0 GROUP BY ALL),
            q AS (SELECT h.*, CASE WHEN o.origin < h.turn THEN o.origin END AS origin FROM h LEFT JOIN o USING (conv_id, body) WHERE level > 0),
            a AS (SELECT conv_id, turn, count(*) FILTER (WHERE whole = 0) AS quoted, count(*) FILTER (WHERE whole = 0 AND origin IS NOT NULL) AS linked,
                  arg_min(origin, (level, -whole, pos)) FILTER (WHERE origin IS NOT NULL) AS parent FROM q GROUP BY ALL),
            u AS (SELECT id, trim(string_agg(body, chr(10) ORDER BY pos) FILTER (WHERE level = 0 AND NOT (regexp_matches(body, '(?i)\\bwrote:\\s*$') AND next_level > 0))) AS text FROM k GROUP BY id)
            SELECT m.conv_id, m.turn, m.role, coalesce(a.parent, b.before) AS reply_to,
                   CASE WHEN m.conv_id IS NOT NULL AND m.turn IS NOT NULL THEN dense_rank() OVER (PARTITION BY m.conv_id ORDER BY coalesce(a.parent, b.before) NULLS FIRST, m.turn) END AS place,
                   coalesce(a.quoted, 0) AS quoted, coalesce(a.linked, 0) AS linked, coalesce(u.text, '') AS text
            FROM m JOIN u USING (id) LEFT JOIN b ON m.conv_id = b.conv_id AND m.turn = b.turn LEFT JOIN a ON m.conv_id = a.conv_id AND m.turn = a.turn""",
        "op9_warc": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS body, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS owner FROM pages),
            x AS (SELECT *, list_transform(range(40), lambda i: strpos('0123456789abcdef', substr(sha1(body), i + 1, 1)) - 1) AS n FROM p),
            y AS (SELECT *, list_transform(range(160), lambda i: (n[i // 4 + 1] >> (3 - i % 4)) & 1) AS bits FROM x)
            SELECT page_id, octet_length(encode(body)) AS payload_bytes,
                   list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * bits[5 * i + 1] + 8 * bits[5 * i + 2] + 4 * bits[5 * i + 3] + 2 * bits[5 * i + 4] + bits[5 * i + 5], 1)), 'string_agg', '') AS payload_digest,
                   CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> owner THEN owner END AS refers_to
            FROM y""",
        "op11_prefix_trie": """
            WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                              row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
                       FROM conversations WHERE conv_id IS NOT NULL),
            c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY pos) AS own FROM t GROUP BY conv_id),
            crc AS (SELECT n, list_reduce([n::UBIGINT] || range(8)::UBIGINT[], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END) AS e FROM range(256) r(n)),
            tab AS (SELECT list(e ORDER BY n) AS e FROM crc),
            h AS (SELECT conv_id, xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::UBIGINT), lambda x, y: xor(x >> 8, tab.e[((xor(x, y) & 255) + 1)::BIGINT])), 4294967295::UBIGINT) % 9 AS h FROM c, tab),
            r AS (SELECT c.conv_id, coalesce(b.own, [])[1:h.h] || c.own[h.h + 1:] AS seq FROM c JOIN h USING (conv_id) LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 5),
            p AS (SELECT conv_id, d AS depth, seq[1:d] AS seq, d = len(seq) AS ends FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM r)),
            n AS (SELECT depth, seq, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM p GROUP BY ALL),
            u AS (SELECT seq[1:depth - 1] AS parent, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
            f AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * octet_length(encode(seq[-1].text)) ELSE 0 END AS saved FROM n LEFT JOIN u ON u.parent = n.seq),
            s AS (SELECT top, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM (SELECT seq[1:d] AS top, n_children, saved FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM f)) GROUP BY top)
            SELECT f.conv_id, f.depth, o.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
            FROM f JOIN s ON s.top = f.seq LEFT JOIN f o ON f.depth > 0 AND o.seq = f.seq[1:f.depth - 1]""",
        "op13_fill_middle": """
            WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
            u AS (SELECT *, string_split(text, chr(10)) AS parts, len(text) - len(replace(text, chr(10), '')) + CASE WHEN text = '' OR suffix(text, chr(10)) THEN 0 ELSE 1 END AS n FROM t),
            h AS (SELECT *, list_transform([1, 9, 17, 25], lambda k: ('0x' || substr(x, k, 8))::BIGINT) AS h FROM u),
            a AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS low, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS high,
                         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
            c AS (SELECT *, array_to_string(parts[1:low], chr(10)) || CASE WHEN low > 0 AND low < len(parts) THEN chr(10) ELSE '' END AS before,
                         array_to_string(parts[1:high], chr(10)) || CASE WHEN high > 0 AND high < len(parts) THEN chr(10) ELSE '' END AS until FROM a),
            g AS (SELECT *, substr(until, len(before) + 1) AS middle, substr(text, len(until) + 1) AS rest FROM c)
            SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN len(before) END AS prefix_chars, CASE WHEN form <> 'plain' THEN len(middle) END AS middle_chars,
                   sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || before || '<S>' || rest || '<M>' || middle ELSE '<S>' || rest || '<P>' || before || '<M>' || middle END) AS output_sha256,
                   sha256(text) AS restored_sha256 FROM g""",
    }
