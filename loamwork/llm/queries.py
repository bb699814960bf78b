"""Registered queries of the training-data operators, and their SQL where there is any."""

from __future__ import annotations

from .common import table


def op1_pii_surrogates(spark, sf_dir):
    from .pii import with_surrogates

    return with_surrogates(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark, sf_dir):
    from .suffix_dedup import remove_repeated_bytes

    return remove_repeated_bytes(table(spark, sf_dir, "documents")).drop("spans")


def op3_substring_dedup(spark, sf_dir):
    from .substring_dedup import remove_repeated_passages

    return remove_repeated_passages(table(spark, sf_dir, "documents")).drop("spans")


def op4_quality_crf(spark, sf_dir):
    from .quality_crf import judge

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("content_words", "n_lines")


def op5_url_filter(spark, sf_dir):
    from .url_filter import filter_urls

    return filter_urls(table(spark, sf_dir, "pages")).drop("score")


def op6_simhash(spark, sf_dir):
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_token_file(spark, sf_dir):
    from .token_file import token_table

    return token_table(table(spark, sf_dir, "documents"))


def op8_mixing(spark, sf_dir):
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).drop("repeats")


def op9_secret_scan(spark, sf_dir):
    from .secret_scan import scan

    return scan(table(spark, sf_dir, "documents"))


def op10_fm_index(spark, sf_dir):
    from .fm_index import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op11_spelling_variants(spark, sf_dir):
    from .spelling import variants

    return variants(table(spark, sf_dir, "documents"))


def op12_byte_bpe(spark, sf_dir):
    from .byte_bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark, sf_dir):
    from .importance import ranked

    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_pii_surrogates, op2_suffix_dedup, op3_substring_dedup, op4_quality_crf, op5_url_filter, op6_simhash, op7_token_file, op8_mixing, op9_secret_scan, op10_fm_index, op11_spelling_variants, op12_byte_bpe, op13_importance_resampling)}

OP10_SQL = r"""
WITH w AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS x FROM benchmark),
n AS (SELECT DISTINCT item_id, x[i:i + least(len(x), 13) - 1] AS win FROM (SELECT item_id, x, unnest(range(1, greatest(len(x) - 12, 1) + 1)) AS i FROM w WHERE len(x) > 0)),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS x FROM documents),
k AS (SELECT DISTINCT len(win) AS size FROM n),
p AS (SELECT doc_id, x, size, unnest(range(1, len(x) - size + 2)) AS i FROM d, k),
h AS (SELECT p.doc_id, p.i, p.size, n.item_id FROM p JOIN n ON p.x[p.i:p.i + p.size - 1] = n.win),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, len(x)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(x), false) AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""


OP2_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
n AS (SELECT doc_id, x, (length(x) // 2)::BIGINT AS n FROM d),
w AS (SELECT doc_id, i, md5(substr(x, 2 * i - 1, 200)) AS h FROM (SELECT doc_id, x, unnest(range(1, n - 98)) AS i FROM n WHERE n >= 100)),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 100)) AS p FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS rn FROM w) WHERE rn > 1),
c AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (new) AS n_spans FROM (SELECT doc_id, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 1, true) AS new FROM g) GROUP BY doc_id),
k AS (SELECT b.doc_id, string_agg(substr(b.x, 2 * b.p - 1, 2), '' ORDER BY b.p) AS kept FROM (SELECT doc_id, x, unnest(range(1, n + 1)) AS p FROM n WHERE doc_id IN (SELECT doc_id FROM c)) b ANTI JOIN g ON g.doc_id = b.doc_id AND g.p = b.p GROUP BY b.doc_id)
SELECT n.doc_id, n.n AS n_bytes, coalesce(c.n_removed, 0)::BIGINT AS n_removed, coalesce(c.n_spans, 0)::BIGINT AS n_spans,
       sha256(CASE WHEN c.doc_id IS NULL THEN unhex(n.x) ELSE unhex(coalesce(k.kept, '')) END) AS kept_sha256
FROM n LEFT JOIN c ON c.doc_id = n.doc_id LEFT JOIN k ON k.doc_id = n.doc_id"""

OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS rn FROM w) WHERE rn > 1),
c AS (SELECT doc_id, count(*) AS n_removed FROM g GROUP BY doc_id),
b AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT b.doc_id, string_agg(word, ' ' ORDER BY b.p) AS kept FROM b ANTI JOIN g ON g.doc_id = b.doc_id AND g.p = b.p GROUP BY b.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id"""


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes in DuckDB SQL; the table comes from the polynomial."""
    steps = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        steps.append(x)
    octets = f"list_transform(range(1, strlen({text}) + 1), lambda i: ('0x' || substr(hex(encode({text})), 2 * i - 1, 2))::BIGINT)"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, ({steps}::BIGINT[])[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


LOW_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11_SQL = rf"""
WITH RECURSIVE r AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all({LOW_SQL}, '[a-z\x{{C0}}-\x{{FF}}]{{7,}}')) AS run FROM documents) GROUP BY 1, 2),
h AS (SELECT run, k, {crc32_sql("t")} AS h FROM (SELECT run, k, doc_id || ':' || run AS t FROM r)),
w AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM h),
v AS (SELECT word, sum(k)::BIGINT AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
d AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT a.word AS u, b.word AS v FROM d a JOIN d b ON a.cut = b.cut AND a.i = b.i AND length(a.word) = length(b.word) AND a.word <> b.word
      UNION SELECT d.word, v.word FROM d JOIN v ON v.word = d.cut UNION SELECT v.word, d.word FROM d JOIN v ON v.word = d.cut),
c AS (SELECT u, count(*) AS n_near, min_by(x.word, (-x.n, x.word)) AS best, max(x.n) AS m FROM p JOIN v x ON x.word = p.v GROUP BY u),
f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 10 * v.n THEN best END AS form, CASE WHEN m >= 10 * v.n THEN m END AS form_n FROM v LEFT JOIN c ON c.u = v.word),
s AS (SELECT word, word AS root, 0 AS step FROM f UNION ALL SELECT s.word, f.form, step + 1 FROM s JOIN f ON f.word = s.root WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, max_by(root, step) AS root FROM s GROUP BY word) USING (word)"""

OP13_SQL = rf"""
WITH t AS (SELECT 'd' AS side, doc_id, row_number() OVER () AS r, text FROM documents UNION ALL SELECT 'b', NULL, row_number() OVER (), text FROM benchmark),
w AS (SELECT side, r, doc_id, coalesce(regexp_extract_all({LOW_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS x FROM t),
g AS (SELECT side, r, f, count(*) AS k FROM (SELECT side, r, unnest(x) AS f FROM w UNION ALL SELECT side, r, x[i] || ' ' || x[i + 1] FROM (SELECT side, r, x, unnest(range(1, len(x))) AS i FROM w)) GROUP BY ALL),
b AS (SELECT f, {crc32_sql("f")} % 10000 AS bucket FROM (SELECT DISTINCT f FROM g)),
n AS (SELECT bucket, coalesce(sum(k) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(k) FILTER (side = 'b'), 0)::DOUBLE AS t FROM g JOIN b USING (f) GROUP BY bucket),
a AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM n),
e AS (SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain FROM n, a),
m AS (SELECT r, sum(k) AS n_features, sum(k * gain) AS total FROM g JOIN b USING (f) JOIN e USING (bucket) WHERE side = 'd' GROUP BY r),
o AS (SELECT w.doc_id, len(x) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0)::BIGINT AS weight,
      ('0x' || left(sha256('7:' || w.doc_id), 8))::BIGINT AS h FROM w LEFT JOIN m USING (r) WHERE side = 'd'),
c AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM o),
q AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (n_words >= 20) OVER () AS fits FROM c)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * fits // 100 THEN place END AS rank FROM q"""


def _oracles() -> dict[str, str]:
    from . import mixing

    return {"op2_suffix_dedup": OP2_SQL, "op3_substring_dedup": OP3_SQL, "op8_mixing": mixing.oracle(), "op10_fm_index": OP10_SQL, "op11_spelling_variants": OP11_SQL, "op13_importance_resampling": OP13_SQL}


ORACLES: dict[str, str] = _oracles()
