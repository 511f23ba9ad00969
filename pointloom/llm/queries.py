"""The operators over their whole tables, under the names the driver runs."""

from __future__ import annotations

from ..session import scratch_path, table
from . import bpe, decontaminate, lm, multi_index, packing, pii, repair, rollup, secrets, simhash, toxicity, warc
from .common import documents


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary lies; the file itself is never part of the repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_bpe_encode_decode(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "text")
    return bpe.digests(docs, tokenizer_path(), more=bpe.frequent_words(docs))


def op1_benchmark_leaks(spark, sf_dir):
    return decontaminate.leaks(documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op3_pii_spans(spark, sf_dir):
    return pii.scan(documents(spark, sf_dir, "doc_id", "text"))


def op4_token_rollups(spark, sf_dir):
    return rollup.corpus_totals(documents(spark, sf_dir, "doc_id", "source", "lang", "text"),
        rollup.Rollup(spark, scratch_path(spark, "rollup")), tokenizer_path())


def op5_lm_score(spark, sf_dir):
    return lm.scores(documents(spark, sf_dir, "doc_id", "text"))


def op6_embedding_near_dedup(spark, sf_dir):
    return multi_index.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op7_secret_scan(spark, sf_dir):
    return secrets.scan(documents(spark, sf_dir, "doc_id", "text"))


def op8_warc_round_trip(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(documents(spark, sf_dir, "doc_id", "text"))


def op10_toxicity_ftrl(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.predictions(documents(spark, sf_dir, "doc_id", "text"), labels)


def op11_best_fit_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir, "doc_id", "text"), tokenizer_path())


def op12_conversation_repair(spark, sf_dir):
    return repair.repair(repair.damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


#: All pairs; the query reaches the same links where its recall is one, as on the driver's tables.
OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) > 0
),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b),
n AS (SELECT a, count(DISTINCT b) AS n FROM p GROUP BY a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""
OP8_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body)::BIGINT AS n, sha1(body) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(0, 160, 5), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (('0x' || substr(h || '0000', 1 + i // 4, 3))::INT >> (7 - i % 4)) % 32, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""


#: The edits as one step of a recursion over the turns: of what leads to a state the least (cost, audit) stays. CRC-32 by its table.
OP12_SQL = r"""
WITH RECURSIVE
crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
  lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
damage AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_prepend(4294967295,
  list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 20 AS k FROM conversations, crc),
turns AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM damage WHERE k <> 0
  UNION ALL SELECT conv_id, turn, role, text FROM damage WHERE k = 3),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM turns),
copies AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS copy FROM placed),
faults AS (SELECT *, left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS p,
  CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN copy > 1 THEN 'duplicate'
    WHEN regexp_matches(text, '[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM copies),
edits(q, letter, r, t, c, who) AS (VALUES (0, 'D', NULL, 0, 2, NULL), (1, 'D', NULL, 1, 2, NULL), (2, 'D', NULL, 2, 2, NULL), (3, 'D', NULL, 3, 2, NULL),
  (0, 'K', 's', 1, 0, NULL), (0, 'K', 'u', 2, 0, NULL), (1, 'K', 'u', 2, 0, NULL), (3, 'K', 'u', 2, 0, NULL), (2, 'K', 'a', 3, 0, NULL),
  (0, 'R', NULL, 2, 1, 'user'), (1, 'R', NULL, 2, 1, 'user'), (3, 'R', NULL, 2, 1, 'user'), (2, 'R', NULL, 3, 1, 'assistant')),
inserts(q, t, c, letters, more) AS (VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 5, 'I', ['user:']),
  (1, 2, 5, 'I', ['user:']), (3, 2, 5, 'I', ['user:']), (2, 3, 5, 'I', ['assistant:']), (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 3, 10, 'II', ['user:', 'assistant:'])),
ways(conv_id, i, q, best) AS (
  SELECT conv_id, 0::BIGINT, t, {'c': c, 'a': letters, 'l': more} FROM (SELECT DISTINCT conv_id FROM faults), inserts WHERE q = 0
  UNION ALL
  SELECT w.conv_id, f.i, n.t, min({'c': w.best.c + e.c + n.c + CASE WHEN e.letter <> 'D' AND f.fault = 'truncated' THEN 5 ELSE 0 END, 'a': w.best.a || e.letter || n.letters,
    'l': list_concat(list_concat(w.best.l, CASE WHEN e.letter = 'D' THEN []::VARCHAR[] ELSE [coalesce(e.who, f.role) || ':' || f.text] END), n.more)})
  FROM ways w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1
  JOIN edits e ON e.q = w.q AND (e.letter = 'D' OR f.fault NOT IN ('blank', 'duplicate')) AND (e.r IS NULL OR e.r = f.r) JOIN inserts n ON n.q = e.t
  GROUP BY ALL),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (p IS NOT NULL AND p || r NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM faults GROUP BY conv_id),
found AS (SELECT s.conv_id, min(w.best) AS best FROM sums s JOIN ways w ON w.conv_id IS NOT DISTINCT FROM s.conv_id AND w.i = s.n WHERE w.q IN (0, 3) GROUP BY s.conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(array_to_string(coalesce(best.l, []::VARCHAR[]), chr(10))) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN found f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def pii_base_counts(spark, sf_dir):
    """The counts of op3's base patterns, which SQL can follow."""
    return op3_pii_spans(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


PII_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS e,
  regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS i, regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+') AS c,
  regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]') AS p FROM d),
n AS (SELECT doc_id, e, i, list_filter(list_transform(c, lambda x: regexp_replace(x, '[^0-9]', '', 'g')), lambda x: len(x) BETWEEN 14 AND 19) AS c,
  list_transform(p, lambda x: len(regexp_replace(x, '[^0-9]', '', 'g'))) AS p FROM m)
SELECT doc_id, len(e)::BIGINT AS n_email,
  len(list_filter(i, lambda x: list_bool_and(list_transform(string_split(x, '.'), lambda y: coalesce(try_cast(y AS HUGEINT) <= 255, false)))))::BIGINT AS n_ip,
  len(list_filter(c, lambda x: list_sum(list_transform(range(0, len(x)), lambda k: CASE WHEN k % 2 = 0 THEN substr(x, len(x) - k, 1)::INT
    ELSE substr(x, len(x) - k, 1)::INT * 2 - CASE WHEN substr(x, len(x) - k, 1)::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0))::BIGINT AS n_card,
  len(list_filter(p, lambda x: x BETWEEN 10 AND 15))::BIGINT AS n_phone FROM n
"""


def secret_base_counts(spark, sf_dir):
    """The counts of op7's base patterns, which SQL can follow."""
    return op7_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


SECRETS_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, len(list_filter(regexp_extract_all(t, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: len(x) >= 6))::BIGINT AS n_assign,
  len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: len(x) >= 20))::BIGINT AS n_access,
  len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: len(x) >= 24))::BIGINT AS n_hex FROM d
"""


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    more = ("pii_base_counts", "secret_base_counts", "pipeline")
    return {k: v for k, v in globals().items() if k in more or k.startswith("op") and callable(v)}


def oracle_sql() -> dict:
    return {"op6_embedding_near_dedup": OP6_SQL, "op8_warc_round_trip": OP8_SQL, "op12_conversation_repair": OP12_SQL, "pii_base_counts": PII_SQL, "secret_base_counts": SECRETS_SQL}
