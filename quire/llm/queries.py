"""Registered queries of the operators in this subpackage, with their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import conversations, decontaminate, jaccard_join, langid, merkle, minmax_dedup, packing, pii, quality, substring_dedup, token_store, warc, winnowing
from quire.llm.common import crc_bucket, read_table


TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeated_spans(read_table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(read_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_store.stored_tokens(read_table(spark, sf_dir, "documents"), tokenizer=TOKENIZER, end_id=1)
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(crc_bucket("doc_id", 3) != 1), max_rows=20_000)
    return quality.score(docs, model).select("doc_id", (crc_bucket("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(crc_bucket("doc_id", 4) != 2), per_language=400)
    return langid.predict(docs, model).select("doc_id", (crc_bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "accepted")


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.fingerprints(read_table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read_table(spark, sf_dir, "documents")).drop("masked")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer=TOKENIZER, capacity=4096, end_id=2)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(read_table(spark, sf_dir, "documents"), shingle_words=4, num=85, den=100)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations")
    return conversations.summary(conversations.damaged(rows), rows)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampering(read_table(spark, sf_dir, "documents"))


def op13_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), shingle_words=2, num=80, den=100)


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_warc": op2_warc,
    "op3_token_binary": op3_token_binary,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_language_id": op5_language_id,
    "op6_winnowing": op6_winnowing,
    "op7_pii": op7_pii,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_packing": op9_packing,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_minmax_dedup": op13_minmax_dedup,
}

#: Unsigned crc32 of the ASCII text ``{}`` (bit by bit; a DuckDB expression).
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, c: list_reduce(list_prepend(xor(crc, c), range(8)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)))"""

SQL = {
    "op2_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
k AS (SELECT d, max(page_id) AS kept FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN page_id < kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < kept THEN kept END AS refers_to
FROM p LEFT JOIN k USING (d)
""",
    "op8_benchmark_decontamination": r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM dw),
sh AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM iw),
n AS (SELECT item_id, count(*) AS n_item FROM sh GROUP BY item_id)
SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*) / n_item AS containment
FROM ds JOIN sh USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING 5 * count(*) >= 4 * n_item
""",
    "op10_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 4 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT s FROM sh GROUP BY s HAVING count(*) > 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sh a JOIN common USING (s) JOIN sh b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.other) AS component_id
FROM documents d JOIN reach r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY ALL
""",
    "op11_conversation_repair": rf"""
WITH RECURSIVE given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hit AS (SELECT *, {_CRC32.format("k")} % 20 AS f FROM given),
damage AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
         CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM hit, range(2) r(copy) WHERE f <> 0 AND (copy = 0 OR f = 3)),
told AS (SELECT *, sha256(octet_length(encode(role)) || ':' || role || ':' || text) AS h, left(role, 1) AS init FROM damage),
laid AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, h) AS k FROM told),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again, lag(init) OVER (PARTITION BY conv_id ORDER BY k) || init AS pair,
         NOT regexp_matches(text, '[^ 	-
]') AS blank, regexp_matches(text, '[.!?][ 	-
]*\z') AS ended FROM laid),
t AS (SELECT conv_id, turn, role, text, k, init, pair, blank, NOT blank AND again AS dup, NOT blank AND NOT again AND NOT ended AS cut FROM seen),
faults AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate,
         count(*) FILTER (cut) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM t GROUP BY conv_id),
g(x, sign, y) AS (VALUES ('', 's', 's'), ('', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')),
one AS (SELECT x, y FROM g WHERE sign <> 's'),
ins AS (SELECT DISTINCT x, x AS y, 0 AS c, '' AS a FROM g UNION ALL SELECT x, y, 3, 'I' FROM one UNION ALL SELECT p.x, q.y, 6, 'II' FROM one p JOIN one q ON p.y = q.x),
ways AS (SELECT conv_id, k, i.x, i.y, i.c + 4 AS c, i.a || 'D' AS a FROM t, ins i
  UNION ALL SELECT conv_id, k, i.x, g.y, i.c + (CASE WHEN cut THEN 3 ELSE 0 END), i.a || 'K' FROM t, ins i, g WHERE NOT blank AND NOT dup AND g.x = i.y AND g.sign = init
  UNION ALL SELECT conv_id, k, i.x, g.y, i.c + 3 + (CASE WHEN cut THEN 3 ELSE 0 END), i.a || 'R' FROM t, ins i, g WHERE NOT blank AND NOT dup AND g.x = i.y AND g.sign <> 's'),
dp(conv_id, k, x, b) AS (SELECT conv_id, 0::BIGINT, '', {{'c': 0, 'a': ''}} FROM faults
  UNION ALL SELECT dp.conv_id, dp.k + 1, w.y, min({{'c': dp.b.c + w.c, 'a': dp.b.a || w.a}}) FROM dp JOIN ways w ON w.conv_id IS NOT DISTINCT FROM dp.conv_id AND w.k = dp.k + 1 AND w.x = dp.x
            GROUP BY dp.conv_id, dp.k, w.y),
best AS (SELECT dp.conv_id, min({{'c': dp.b.c + i.c, 'a': dp.b.a || i.a}}) AS b FROM dp JOIN faults f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.n = dp.k JOIN ins i ON i.x = dp.x
         WHERE i.y IN ('', 'a') GROUP BY dp.conv_id),
signs AS (SELECT conv_id, unnest(string_split(b.a, '')) AS sign, unnest(range(length(b.a))) AS i, length(replace(b.a, 'D', '')) % 2 AS odd FROM best WHERE b.a <> ''),
spots AS (SELECT *, count(*) FILTER (sign <> 'I') OVER w AS k, count(*) FILTER (sign <> 'D') OVER w - odd AS place FROM signs WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
mended AS (SELECT s.conv_id, sha256(string_agg(CASE WHEN sign = 'K' THEN t.role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN sign = 'I' THEN '' ELSE t.text END, chr(10) ORDER BY i)) AS h
           FROM spots s LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND t.k = s.k WHERE sign <> 'D' GROUP BY s.conv_id)
SELECT c.conv_id, coalesce(f.gaps, 0) AS gaps, coalesce(f.blank, 0) AS blank, coalesce(f.duplicate, 0) AS duplicate, coalesce(f.truncated, 0) AS truncated, coalesce(f.illegal, 0) AS illegal,
       coalesce(best.b.c, 0)::BIGINT AS cost, coalesce(best.b.a, '') AS audit, coalesce(mended.h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN mended ON mended.conv_id IS NOT DISTINCT FROM c.conv_id
""",
    "op12_merkle_manifest": rf"""
WITH RECURSIVE f AS (SELECT doc_id, lang, n_chars, coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
         || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head, coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail,
       coalesce({_CRC32.format("doc_id::VARCHAR")} % 7 = 0, false) AS bad FROM documents),
l AS (SELECT doc_id, lang, sha256(head || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
       CASE WHEN bad THEN sha256(head || coalesce(length((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) END AS changed FROM f),
b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS total FROM l),
t(lang, lv, i, h, total) AS (SELECT lang, 0, pos, leaf, total FROM b
  UNION ALL SELECT lang, lv + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(total) + 1) // 2 FROM t WHERE total > 1 GROUP BY lang, lv, i // 2),
s AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS spot FROM t WHERE total = 1),
u(lv, i, h, total) AS (SELECT 0, spot, subroot, (SELECT count(*) FROM s) FROM s
  UNION ALL SELECT lv + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(total) + 1) // 2 FROM u WHERE total > 1 GROUP BY lv, i // 2),
d AS (SELECT b.*, s.subroot, s.spot, (SELECT h FROM u WHERE total = 1) AS root FROM b JOIN s ON b.lang IS NOT DISTINCT FROM s.lang),
p AS (SELECT d.lang, d.pos, t.lv, (d.pos >> t.lv) & 1 AS place, o.h FROM d JOIN t ON d.lang IS NOT DISTINCT FROM t.lang AND t.i = d.pos >> t.lv AND t.total > 1
        LEFT JOIN t o ON o.lang IS NOT DISTINCT FROM t.lang AND o.lv = t.lv AND o.i = xor(t.i, 1)
  UNION ALL SELECT d.lang, d.pos, 1000 + u.lv, (d.spot >> u.lv) & 1, o.h FROM d JOIN u ON u.i = d.spot >> u.lv AND u.total > 1 LEFT JOIN u o ON o.lv = u.lv AND o.i = xor(u.i, 1)),
q AS (SELECT lang, pos, list(place ORDER BY lv) AS places, list(coalesce(h, '') ORDER BY lv) AS hs FROM p GROUP BY lang, pos),
w AS (SELECT d.doc_id, d.leaf, d.subroot, d.root, coalesce(d.changed, d.leaf) AS start, coalesce(q.places, []) AS places, coalesce(q.hs, []) AS hs
      FROM d LEFT JOIN q ON d.lang IS NOT DISTINCT FROM q.lang AND d.pos = q.pos),
r(doc_id, leaf, subroot, root, places, hs, k, v) AS (SELECT doc_id, leaf, subroot, root, places, hs, 1, start FROM w
  UNION ALL SELECT doc_id, leaf, subroot, root, places, hs, k + 1, sha256(CASE WHEN places[k] = 1 THEN hs[k] || v ELSE v || hs[k] END) FROM r WHERE k <= len(hs))
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(hs, '')) AS proof_sha256, v AS folded_root, v = root AS verified FROM r WHERE k > len(hs)
""",
    "op13_minmax_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 2 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
often AS (SELECT s, count(*) AS f FROM sh GROUP BY s HAVING count(*) > 1),
ranked AS (SELECT doc_id, n, sh.s, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(f, 1), sh.s) AS r FROM sh JOIN n USING (doc_id) LEFT JOIN often USING (s)),
heads AS (SELECT doc_id, n, s FROM ranked WHERE r <= n - ceil(0.8 * n) + 1),
pairs AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM heads a JOIN heads b USING (s) WHERE a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
shared AS (SELECT a, b, count(*) AS k FROM pairs JOIN sh x ON x.doc_id = a JOIN sh y ON y.doc_id = b AND y.s = x.s GROUP BY a, b),
half AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.other) AS component_id, d.doc_id = min(r.other) AS kept
FROM documents d JOIN reach r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id, n.n
""",
}
