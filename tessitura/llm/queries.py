"""The registered queries of the training-data operators and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm import chat, decontaminate, divergence, langid, ngram_join, packing, quality, sentencepieces, simhash, token_counts, toxicity, turn_repair, warc
from tessitura.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(table(spark, sf_dir, "pages"), min_bytes=0)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotations(table(spark, sf_dir, "conversations"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), n=4, threshold="0.85")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.edit_sensitivity(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), window=1024, end=0)


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = sentencepieces.decoded(sentencepieces.encoded(table(spark, sf_dir, "documents"), model), model)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return turn_repair.repair_audit(conversations, turn_repair.damaged(conversations))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"), least=3, ranks=200)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_warc, op3_chat, op4_decontamination, op5_quality, op6_ngram_join, op7_token_counts, op8_language_id, op9_simhash, op10_packing, op11_sentencepiece, op12_turn_repair, op13_divergence)}
#: A digest in base32 from its hexadecimal digits, five of them at a time.
BASE32 = "array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, i * 5 + 1, 5))::BIGINT >> s) & 31) + 1), 1)), '')), '')"
SQL_WARC = f"""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS h FROM pages), f AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS first FROM p)
    SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, {BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, true AS valid FROM f"""
SQL_CHAT = """WITH t AS (SELECT conv_id, turn, regexp_replace(regexp_replace(coalesce(role, 'unknown'), '\\s+', '_', 'g'), '<\\|(im_start|im_end)\\|>', '<|_\\1_|>', 'g') AS who, regexp_replace(coalesce(text, ''), '<\\|(im_start|im_end)\\|>', '<| \\1 |>', 'g') AS body FROM conversations),
    p AS (SELECT DISTINCT conv_id, who AS perspective FROM t WHERE who <> 'system'),
    m AS (SELECT t.conv_id, perspective, turn, who, body, CASE WHEN who = perspective THEN 'assistant' WHEN who = 'system' THEN who ELSE 'user' END AS role FROM t JOIN p ON t.conv_id = p.conv_id),
    h AS (SELECT *, '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || who ELSE '' END || chr(10) AS head FROM m), r AS (SELECT *, head || body || '<|im_end|>' || chr(10) AS rendered FROM h),
    s AS (SELECT *, row_number() OVER w - 1 AS position, (sum(length(rendered)) OVER w)::BIGINT AS till FROM r WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, who))
    SELECT conv_id, perspective, turn, position, role, CASE WHEN role = 'user' THEN who END AS name, rendered, till - length(rendered) AS start,
    CASE WHEN who = perspective THEN till - length(rendered) + length(head) END AS mask_start, CASE WHEN who = perspective THEN till END AS mask_end FROM s"""
SQL_JOIN = """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [len(w) || ':' || array_to_string(w, ' ')] ELSE [] END)) AS s FROM w),
    e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s), l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
    r AS (SELECT doc_id, doc_id AS t FROM s UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.t = l.a), c AS (SELECT doc_id, min(t) AS component_id FROM r GROUP BY 1)
    SELECT s.doc_id, len(s)::BIGINT AS n_shingles, component_id, CASE WHEN len(s) > 0 THEN count(*) OVER (PARTITION BY s) ELSE 1 END::BIGINT AS n_class FROM s JOIN c ON s.doc_id = c.doc_id"""
CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i: unicode(substr(k, i::INT, 1))::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"


def _repair_sql() -> str:
    """A recursion over each conversation's rows with the cheapest ways to four places, without blocks."""

    def add(state: str, cost: str, letter: str) -> str:
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}'}}"

    far = "{'c': 1000000000::BIGINT, 'a': ''}"
    user = f"least(u, {add('b', '2', 'I')}, {add('s', '2', 'I')}, {add('a', '2', 'I')})"

    def arrive(old: str, role: str, best: str, given: str | None) -> str:
        rest = f", CASE WHEN must THEN {far} ELSE {add(best, '2 + extra', given)} END" if given else ""
        return f"least({add(old, '3', 'D')}, CASE WHEN NOT must AND role = '{role}' THEN {add(best, 'extra', 'K')} ELSE {far} END{rest}) AS {role}"

    inserted = f"SELECT * REPLACE ({user} AS u), least(a, {add(user, '2', 'J')}) AS a2"
    return f"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
    f AS (SELECT *, {CRC32} % 20 AS fate FROM k), d AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy FROM f WHERE fate <> 0),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ink FROM d),
    e AS (SELECT *, CASE WHEN ink = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate' WHEN right(ink, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    coalesce(lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS illegal FROM o),
    t AS (SELECT conv_id, n, left(role, 1) AS role, fault IN ('blank', 'duplicate') AS must, (fault = 'truncated')::BIGINT AS extra FROM e),
    r AS (SELECT DISTINCT conv_id, 0::BIGINT AS n, {{'c': 0::BIGINT, 'a': ''}} AS b, {far} AS s, {far} AS u, {far} AS a FROM e UNION ALL
    SELECT conv_id, n, {add('b', '3', 'D')} AS b, {arrive('s', 's', 'b', None)}, {arrive('u', 'u', 'least(b, s, a2)', 'R')}, {arrive('a2', 'a', 'u', 'S')}
    FROM (SELECT i.* EXCLUDE (n), t.n, t.role, t.must, t.extra FROM ({inserted} FROM r) i JOIN t ON t.conv_id IS NOT DISTINCT FROM i.conv_id AND t.n = i.n + 1)),
    z AS (SELECT conv_id, least(b, a2) AS best FROM ({inserted} FROM r QUALIFY n = max(n) OVER (PARTITION BY conv_id))),
    w AS (SELECT conv_id, generate_subscripts(e, 1) AS n, unnest(e) AS edits FROM (SELECT conv_id, regexp_extract_all(best.a, '[IJ]*[DKRS](?:[IJ]+$)?') AS e FROM z)),
    l AS (SELECT e.conv_id, n, array_to_string(list_transform(list_filter(regexp_extract_all(edits, '.'), lambda x: x <> 'D'), lambda x: CASE x WHEN 'I' THEN 'user:' WHEN 'J' THEN 'assistant:' WHEN 'R' THEN 'user:' || text WHEN 'S' THEN 'assistant:' || text ELSE role || ':' || text END), chr(10)) AS line
    FROM e JOIN w USING (n) WHERE e.conv_id IS NOT DISTINCT FROM w.conv_id AND edits <> 'D'), h AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY n) AS whole FROM l GROUP BY conv_id),
    g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE illegal) AS illegal FROM e GROUP BY conv_id), i AS (SELECT DISTINCT conv_id FROM conversations)
    SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
    coalesce(best.c, 0)::BIGINT AS cost, coalesce(translate(best.a, 'JS', 'IR'), '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
    FROM i LEFT JOIN g ON i.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN z ON i.conv_id IS NOT DISTINCT FROM z.conv_id LEFT JOIN h ON i.conv_id IS NOT DISTINCT FROM h.conv_id"""


SQL_DIVERGENCE = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
    k AS (SELECT lang, term FROM d GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3), v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1), g AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
    c AS (SELECT d.lang, d.source, d.term, count(*) AS n FROM d JOIN k ON d.lang = k.lang AND d.term = k.term GROUP BY 1, 2, 3),
    f AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    p AS (SELECT f.*, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY f.lang, source) + v) AS p, sum(n) OVER (PARTITION BY f.lang, term) AS ln, sum(n) OVER (PARTITION BY f.lang) AS lt, v FROM f JOIN v ON f.lang = v.lang),
    q AS (SELECT *, 1 + (1000000000::HUGEINT * (ln + 1)) // (lt + v) AS q FROM p),
    x AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
    y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
    UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM q WHERE n > 0 AND p > q)
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM y QUALIFY part = 'pair' OR rank <= 200"""
ORACLES: dict[str, str] = {"op2_warc": SQL_WARC, "op3_chat": SQL_CHAT, "op6_ngram_join": SQL_JOIN, "op12_turn_repair": _repair_sql(), "op13_divergence": SQL_DIVERGENCE}
