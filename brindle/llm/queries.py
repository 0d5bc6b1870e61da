"""The registered query of each operator, with production parameters over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, cotrain, decontam, dialogues, html, mixing, pieces, resample, secrets, simhash, substring, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_rotated_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op2_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.qualities(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_simhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = simhash.classes(table(spark, sf_dir, "documents"))
    return made.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op5_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_line_block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op7_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_toxic_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.severities(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))


def op10_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over one ledger: the first scans every blob, the second finds none unseen and joins the findings to all paths."""
    docs, ledger = table(spark, sf_dir, "documents"), secrets.fresh_ledger(spark)
    ledger.extend(docs)
    return secrets.digest(secrets.scan_all(docs, ledger))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogues.repair(table(spark, sf_dir, "conversations"))


def op13_sentencepiece_ids(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """``model``: the path of the vocabulary on every executor; by default the public one of 32,000 pieces."""
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    made = pieces.encoded(table(spark, sf_dir, "documents"), model)
    return made.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(pieces.written(F.col("ids")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


_MIX_SQL = """
WITH src AS (SELECT source, sum(coalesce(length(text), 0))::DOUBLE AS units FROM documents GROUP BY source),
raw AS (SELECT *, CASE WHEN units > 0 THEN pow(units, 0.5) ELSE 0.0 END AS raw FROM src),
rate AS (SELECT source, CASE WHEN units > 0 THEN (SELECT sum(units) FROM raw) * (raw / (SELECT sum(raw) FROM raw)) / units ELSE 0.0 END AS rate FROM raw),
part AS (SELECT source, greatest(ceil(rate / 256.0), 1)::INT AS parts, rate / greatest(ceil(rate / 256.0), 1)::INT AS m FROM rate),
pmf AS (SELECT source, parts, k, exp(-m + k * ln(CASE WHEN m > 0 THEN m ELSE 1 END) - lgamma(k + 1)) * CASE WHEN m > 0 OR k = 0 THEN 1 ELSE 0 END AS p
        FROM part, LATERAL (SELECT unnest(generate_series(0, ceil(m + 12 * sqrt(m) + 30)::BIGINT)) AS k)),
cdf AS (SELECT source, parts, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM pmf),
drawn AS (SELECT d.*, coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, ''))) AS who, p.parts, i,
          ('0x' || substr(md5('count|7|' || coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, ''))) || '|' || i), 1, 13))::BIGINT / 4503599627370496.0 AS u
          FROM documents d JOIN part p ON d.source IS NOT DISTINCT FROM p.source, LATERAL (SELECT unnest(generate_series(1, p.parts)) AS i)),
counted AS (SELECT doc_id, any_value(text) AS text, any_value(lang) AS lang, any_value(source) AS source, any_value(n_chars) AS n_chars, who, sum(n) AS n
            FROM (SELECT *, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM drawn.source AND c <= u) AS n FROM drawn) GROUP BY doc_id, who)
SELECT doc_id, text, lang, source, n_chars, copy::INT AS copy, ('0x' || substr(md5('order|7|' || who || '|' || copy), 1, 13))::BIGINT AS shuffle_key
FROM counted, LATERAL (SELECT unnest(generate_series(1, n::BIGINT)) AS copy)
"""

_SECRET_SQL = r"""
WITH src AS (SELECT doc_id, translate(coalesce(text, ''), chr(1) || chr(2) || chr(3), chr(4) || chr(4) || chr(4)) AS t FROM documents),
rule(ord, kind, pat, least) AS (VALUES
  (0, 'assign', '((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?)([A-Za-z0-9+/_.=-]+)', 8),
  (1, 'access', '()(AKIA[A-Z0-9]+)', 16), (2, 'hex', '()([0-9a-f]+)', 32),
  (3, 'pem', '()(-----BEGIN [A-Z ]*PRIVATE KEY-----)', 1), (4, 'prefixed', '()((?:ghp|gho|xoxb|xoxp|sk_live)[_-][A-Za-z0-9_-]{16,})', 20)),
part AS (SELECT doc_id, ord, kind, least, x, i FROM src, rule,
         LATERAL (SELECT unnest(string_split(regexp_replace(t, pat, chr(1) || '\1' || chr(2) || '\2' || chr(3), 'g'), chr(1))) AS x,
                         generate_subscripts(string_split(regexp_replace(t, pat, chr(1) || '\1' || chr(2) || '\2' || chr(3), 'g'), chr(1)), 1) AS i)),
placed AS (SELECT *, coalesce(sum(CASE WHEN i = 1 THEN length(x) ELSE length(x) - 2 END) OVER (PARTITION BY doc_id, ord ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM part),
hit AS (SELECT doc_id, ord, kind, s::BIGINT AS s, (s + strpos(x, chr(3)) - 2)::BIGINT AS e FROM placed WHERE i > 1 AND strpos(x, chr(3)) - 2 - (strpos(x, chr(2)) - 1) >= least),
agg AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (ord < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS spans FROM hit GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN agg USING (doc_id)
"""

_NEIGHBOUR_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

_CONTAIN_SQL = r"""
WITH item AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D!-/:-@\[-`{-~]+'), lambda x: x <> '') AS w FROM benchmark),
ish AS (SELECT DISTINCT item_id, least(len(w), 5) AS n, array_to_string(w[p:p + least(len(w), 5) - 1], ' ') AS s
        FROM item, LATERAL (SELECT unnest(generate_series(1, len(w) - least(len(w), 5) + 1)) AS p) WHERE len(w) > 0),
size AS (SELECT item_id, count(*) AS n_item FROM ish GROUP BY item_id),
doc AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D!-/:-@\[-`{-~]+'), lambda x: x <> '') AS w FROM documents),
dsh AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + n - 1], ' ') AS s, n
        FROM doc, (SELECT DISTINCT n FROM ish) AS l, LATERAL (SELECT unnest(generate_series(1, len(w) - n + 1)) AS p)),
shared AS (SELECT doc_id, item_id, count(*) AS shared FROM dsh JOIN ish USING (s, n) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, shared::INT AS shared, n_item::INT AS item_shingles, shared / n_item AS containment
FROM shared JOIN size USING (item_id) WHERE shared >= ceil(0.8 * n_item)
"""

_WINDOW_SQL = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS s FROM doc, LATERAL (SELECT unnest(generate_series(1, len(w) - 49)) AS p)),
firsts AS (SELECT s, min(doc_id) AS first FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, q FROM (SELECT doc_id, unnest(generate_series(p, p + 49)) AS q FROM win JOIN firsts USING (s) WHERE doc_id > first)),
per AS (SELECT doc_id, list(q) AS qs FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, w, coalesce(qs, []) AS qs FROM doc LEFT JOIN per USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, len(qs)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN len(qs) = 0 THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(qs, i)) END, ' ')) AS kept_sha256 FROM kept
"""

#: CRC-32 of the bytes of s, by the table of its polynomial.
_CRC_SQL = """
poly AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) AS c FROM range(256) AS r(i))),
crc AS MATERIALIZED (SELECT s, xor(list_reduce(list_transform(range(0, octet_length(encode(s))), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
                                               lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295::BIGINT), 4294967295) AS crc
        FROM (SELECT s, hex(encode(s)) AS h FROM strings), poly)
"""

_RESAMPLE_SQL = rf"""
WITH txt AS MATERIALIZED (SELECT row_number() OVER () AS i, doc_id, coalesce(text, '') AS text FROM documents),
tok AS MATERIALIZED (SELECT i, doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
        FROM (SELECT * FROM txt UNION ALL SELECT -row_number() OVER (), NULL, coalesce(text, '') FROM benchmark)),
run AS MATERIALIZED (SELECT i, unnest(list_concat(w, list_transform(range(1, len(w)), lambda p: w[p] || ' ' || w[p + 1]))) AS s FROM tok),
strings AS (SELECT DISTINCT s FROM run), {_CRC_SQL.strip()},
hit AS MATERIALIZED (SELECT i, crc % 10000 AS b, count(*) AS n FROM run JOIN crc USING (s) GROUP BY ALL),
tot AS (SELECT sum(n) FILTER (i > 0)::DOUBLE AS ss, coalesce(sum(n) FILTER (i < 0), 0)::DOUBLE AS tt FROM hit),
cnt AS (SELECT b, coalesce(sum(n) FILTER (i > 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (i < 0), 0)::DOUBLE AS t FROM hit GROUP BY b),
gain AS (SELECT b, floor(1000 * ln((t + 1) * (ss + 10000) / ((s + 1) * (tt + 10000))))::BIGINT AS gain FROM cnt, tot),
per AS (SELECT i, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS g FROM hit JOIN gain USING (b) WHERE i > 0 GROUP BY i),
scr AS (SELECT i, doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce((g - ((g % n) + n) % n) // n, 0)::BIGINT AS weight,
        floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS noise FROM tok LEFT JOIN per USING (i) WHERE i > 0),
pos AS (SELECT i, row_number() OVER (ORDER BY weight + noise DESC, doc_id NULLS LAST, i) AS rank FROM scr WHERE n_words >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight, weight + noise AS score, CASE WHEN rank <= 25 * (SELECT count(*) FROM pos) // 100 THEN rank END::BIGINT AS rank FROM scr LEFT JOIN pos USING (i)
"""

def _then(state: str, cost: str, edit: str, when: str = "true") -> str:
    return f"CASE WHEN {state} IS NOT NULL AND {when} THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}'}} END"


def _inserted(of: dict[int, str]) -> dict[str, str]:
    """What an insert makes of the states that it leads to; applied twice, no more inserts in a row are worth their cost."""
    j1 = f"least({of[1]}, {_then(of[0], '5', 'I')}, {_then(of[2], '5', 'I')}, {_then(of[3], '5', 'I')})"
    j2 = f"least({of[2]}, {_then(of[1], '5', 'I')})"
    return {"j1": j1, "j2": j2}


def _repair_sql() -> str:
    """The cheapest edits row by row: a conversation's row holds the best (cost, edits) of each of four states, so ties go to the least prefix."""
    go, keep = "NOT gone", lambda r: f"NOT gone AND m = '{r}'"
    base = {
        0: _then("n0", "2", "D"),
        1: f"least({_then('n1', '2', 'D')}, " + ", ".join(f"{_then(f'n{i}', 'x', 'K', keep('u'))}, {_then(f'n{i}', '1 + x', 'R', go)}" for i in (0, 2, 3)) + ")",
        2: f"least({_then('n2', '2', 'D')}, {_then('n1', 'x', 'K', keep('a'))}, {_then('n1', '1 + x', 'R', go)})",
        3: f"least({_then('n3', '2', 'D')}, {_then('n0', 'x', 'K', keep('s'))})",
    }
    step = ", ".join(f"{e} AS b{i}" for i, e in base.items())
    first = _inserted({i: f"b{i}" for i in range(4)})
    last = f"b0 AS n0, least(j1, {_then('j2', '5', 'I')}) AS n1, least(j2, {_then('j1', '5', 'I')}) AS n2, b3 AS n3"
    none = "NULL::STRUCT(c INTEGER, a VARCHAR)"
    return rf"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
strings AS (SELECT DISTINCT s FROM raw), {_CRC_SQL.strip()},
dmg AS (SELECT conv_id, turn, CASE WHEN crc % 20 = 4 THEN 'user' ELSE role END AS role, CASE crc % 20 WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE crc % 20 WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM raw JOIN crc USING (s)),
sn AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS seen, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS said FROM dmg),
rw AS MATERIALIZED (SELECT conv_id, turn, role, text, row_number() OVER w AS pos, CASE WHEN said = '' THEN '_' WHEN seen THEN '=' ELSE '' END AS fault, said <> '' AND NOT seen AND right(said, 1) NOT IN ('.', '!', '?') AS cut,
        lag(left(role, 1)) OVER w || left(role, 1) AS pair FROM sn WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seen)),
mk AS MATERIALIZED (SELECT conv_id, pos, fault <> '' AS gone, CASE WHEN cut THEN 5 ELSE 0 END AS x, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS m FROM rw),
dp AS (
SELECT conv_id, 0::BIGINT AS pos, {{'c': 0, 'a': ''}} AS n0, {{'c': 5, 'a': 'I'}} AS n1, {{'c': 10, 'a': 'II'}} AS n2, {none} AS n3 FROM (SELECT DISTINCT conv_id FROM rw)
UNION ALL SELECT conv_id, pos, {last} FROM (SELECT *, {first['j1']} AS j1, {first['j2']} AS j2 FROM (SELECT d.conv_id, k.pos, {step} FROM dp d JOIN mk k ON k.conv_id IS NOT DISTINCT FROM d.conv_id AND k.pos = d.pos + 1))),
best AS (SELECT dp.conv_id, least(n0, n2) AS z FROM dp JOIN (SELECT conv_id, max(pos) AS pos FROM rw GROUP BY 1) l ON l.conv_id IS NOT DISTINCT FROM dp.conv_id AND l.pos = dp.pos),
ed AS (SELECT conv_id, i, e, count(*) FILTER (e <> 'I') OVER (PARTITION BY conv_id ORDER BY i) AS pos FROM (SELECT conv_id, unnest(range(1, length(z.a) + 1)) AS i, z.a[unnest(range(1, length(z.a) + 1))] AS e FROM best)),
ou AS (SELECT ed.conv_id, i, e, CASE WHEN e <> 'I' THEN role END AS role, CASE WHEN e = 'I' THEN '' ELSE text END AS text, row_number() OVER (PARTITION BY ed.conv_id ORDER BY i) AS k
       FROM ed LEFT JOIN rw ON rw.conv_id IS NOT DISTINCT FROM ed.conv_id AND rw.pos = ed.pos AND e <> 'I' WHERE e <> 'D'),
sy AS (SELECT conv_id, bool_or(k = 1 AND e = 'K' AND left(role, 1) = 's')::INT AS s FROM ou GROUP BY 1),
rp AS (SELECT ou.conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (k - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i)) AS sha FROM ou JOIN sy ON sy.conv_id IS NOT DISTINCT FROM ou.conv_id GROUP BY 1),
ct AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = '_') AS blank, count(*) FILTER (fault = '=') AS duplicate, count(*) FILTER (cut) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rw GROUP BY 1)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(z.c, 0)::BIGINT AS cost, coalesce(z.a, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN ct ON ct.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN rp ON rp.conv_id IS NOT DISTINCT FROM c.conv_id
"""


_OPERATORS = (op1_rotated_bit_neighbours, op2_cotrained_quality, op3_poisson_mixing, op4_simhash_classes, op5_benchmark_containment, op6_line_block_text, op7_repeated_windows, op8_toxic_severity, op9_warc_derivatives, op10_secret_ledger,
              op11_importance_resampling, op12_conversation_repair, op13_sentencepiece_ids)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _OPERATORS}
ORACLES: dict[str, str] = {"op1_rotated_bit_neighbours": _NEIGHBOUR_SQL, "op3_poisson_mixing": _MIX_SQL, "op5_benchmark_containment": _CONTAIN_SQL, "op7_repeated_windows": _WINDOW_SQL, "op10_secret_ledger": _SECRET_SQL, "op11_importance_resampling": _RESAMPLE_SQL, "op12_conversation_repair": _repair_sql()}
