"""The queries of the numbered operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_records import token_digest

    return token_digest(spark, table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op2_spaced_seed_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_multi_index_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import shared_dir
    from .warc import read_warc, write_warc

    out = shared_dir(spark, "warc")
    read = read_warc(write_warc(table(spark, sf_dir, "pages"), out), out, with_payload=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_text

    found = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit_toxicity, predict_toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return predict_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels"))).drop("text")


#: Conversation -7: texts that hold other templates' control strings and a backslash.
HOSTILE = r"\### Assistant: </turn> ok"


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import conversation_digest, format_conversations

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = spark.createDataFrame([(-7, 0, "user", HOSTILE), (-7, 1, "assistant", HOSTILE)], turns.schema)
    return conversation_digest(format_conversations(turns.unionByName(hostile)))


OP8_SQL = r"""
WITH turns AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, NULL, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, NULL, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, length(role) + length(text) + length('<turn >') + 1 + length('</turn>') + 1
    + length(regexp_replace(role || text, '[^\\<>]', '', 'g')) AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id, lone
"""


def _op2_sql() -> str:
    """Windows as tuples of words instead of hashes, every hit's diagonal laid out word by word."""
    from .decontaminate import MASKS

    span = max(map(len, MASKS))
    runs = {m: [k for k, c in enumerate(m) if c == "1"] for m in MASKS}
    whole = lambda n: ", ".join(f"w{k}" for k in range(n))
    of = lambda t, keys: " UNION ALL ".join([f"SELECT {keys}, p, '{m}' AS m, [{', '.join(f'w{k}' for k in at)}] AS seed FROM {t} WHERE w{span - 1} IS NOT NULL" for m, at in runs.items()] + [f"SELECT {keys}, p, '{n}' AS m, [{whole(n)}] AS seed FROM {t} WHERE w{n - 1} IS NOT NULL" + f" AND n = {n}" * (t == "item_runs") for n in range(1, span)])
    leads = ", ".join(f"lead(x, {k}) OVER o AS w{k}" for k in range(span))
    return f"""
WITH raw AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM benchmark),
items AS (SELECT w, len(w) AS n, min(item_id) AS item_id, row_number() OVER () AS i FROM raw WHERE len(w) > 0 GROUP BY w),
docs AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
item_words AS (SELECT i, n, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS p FROM items),
doc_words AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS p FROM docs),
item_runs AS (SELECT i, n, p, {leads} FROM item_words WINDOW o AS (PARTITION BY i ORDER BY p)),
doc_runs AS (SELECT r, p, {leads} FROM doc_words WINDOW o AS (PARTITION BY r ORDER BY p)),
item_seeds AS ({of('item_runs', 'i')}),
doc_seeds AS ({of('doc_runs', 'r')}),
hits AS (SELECT DISTINCT r, i, d.p - s.p AS position FROM doc_seeds d JOIN item_seeds s USING (m, seed)),
laid AS (SELECT h.r, h.i, h.position, s.p AS k, CASE WHEN d.x = s.x THEN 1 ELSE -2 END AS s FROM hits h JOIN item_words s USING (i) LEFT JOIN doc_words d ON d.r = h.r AND d.p = h.position + s.p),
walked AS (SELECT *, sum(s) OVER o AS upto FROM laid WINDOW o AS (PARTITION BY r, i, position ORDER BY k)),
stretched AS (SELECT *, upto - least(0, min(upto) OVER (PARTITION BY r, i, position ORDER BY k)) AS stretch FROM walked),
scored AS (SELECT r, i, position, count(*) AS item_words, count(*) FILTER (s = 1) AS matched, max(stretch) AS score FROM stretched GROUP BY ALL),
leaked AS (SELECT doc_id, item_id, position, item_words, matched, greatest(score, 0) AS score FROM scored JOIN docs USING (r) JOIN items USING (i) WHERE matched >= 0.7 * item_words OR score >= 10)
SELECT doc_id, item_id, CAST(position AS BIGINT) AS position, CAST(item_words AS BIGINT) AS item_words, CAST(matched AS BIGINT) AS matched, CAST(score AS BIGINT) AS score
FROM leaked QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY score DESC, matched DESC, position) = 1
"""


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack, token_pieces

    return pack(token_pieces(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import fit_language_model, held_out, predict_language

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predict_language(docs.select("doc_id", "text"), fit_language_model(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dialogue import damage, repair_digest

    return repair_digest(damage(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


def _op11_sql() -> str:
    """The costs to the end of each grammar state as strings of cost and audit, row by row from a conversation's end."""
    add = lambda n, letter, of: f"(lpad(CAST(CAST(left({of}, 9) AS BIGINT) + {n} AS VARCHAR), 9, '0') || '{letter}' || substr({of}, 10))"
    stays = lambda cond, n, letter, of: f"CASE WHEN free AND {cond} THEN CASE WHEN late THEN {add(n + 1, letter, of)} ELSE {add(n, letter, of)} END ELSE '~' END"
    to_user = ", ".join((stays("x = 'u'", 0, "K", "qu"), stays("true", 2, "R", "qu")))
    to_assistant = ", ".join((stays("x = 'a'", 0, "K", "qa"), stays("true", 2, "R", "qa")))
    to_system = stays("x = 's'", 0, 'K', 'qs')
    return rf"""
WITH RECURSIVE octets AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, s: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
named AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(name, ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS k FROM named, octets),
damaged AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM keyed),
convs AS (SELECT conv_id, row_number() OVER () AS g FROM (SELECT DISTINCT conv_id FROM conversations)),
placed AS (SELECT g, turn, role, text, left(role, 1) AS x, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM damaged JOIN convs ON damaged.conv_id IS NOT DISTINCT FROM convs.conv_id),
judged AS (SELECT *, lag(x) OVER (PARTITION BY g ORDER BY i) AS x_before, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE 'fine' END AS fault FROM placed),
stats AS (SELECT g, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND x_before || x NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY g),
walk AS (
  SELECT g, n AS i, '000000000' AS q0, '000000004II' AS qs, '000000002I' AS qu, '000000000' AS qa FROM stats
  UNION ALL
  SELECT g, i, least(z, {add(2, 'I', 'u')}), least(s, {add(2, 'I', 'u')}), u, a FROM (
    SELECT g, i, z, s, least(b, {add(2, 'I', 'e')}) AS u, least(e, {add(2, 'I', 'b')}) AS a FROM (
      SELECT g, w.i - 1 AS i, least({add(3, 'D', 'q0')}, {to_system}, {to_user}) AS z, least({add(3, 'D', 'qs')}, {to_user}) AS s, least({add(3, 'D', 'qu')}, {to_assistant}) AS b, least({add(3, 'D', 'qa')}, {to_user}) AS e
      FROM walk w JOIN (SELECT g, i, x, fault IN ('fine', 'truncated') AS free, fault = 'truncated' AS late FROM judged) r USING (g, i) WHERE w.i > 0))),
best AS (SELECT g, CAST(left(q0, 9) AS BIGINT) AS cost, substr(q0, 10) AS audit FROM walk WHERE i = 0),
edits AS (SELECT g, generate_subscripts(string_split(audit, ''), 1) AS j, unnest(string_split(audit, '')) AS e FROM best WHERE audit <> ''),
located AS (SELECT g, j, e, count(*) FILTER (e <> 'I') OVER o AS i, count(*) FILTER (e <> 'D') OVER o AS place FROM edits WINDOW o AS (PARTITION BY g ORDER BY j)),
kept AS (SELECT l.g, l.place, l.e, r.role, CASE WHEN e = 'I' THEN '' ELSE r.text END AS text, max(CASE WHEN place = 1 AND e = 'K' AND x = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.g) AS opened FROM located l LEFT JOIN judged r USING (g, i) WHERE e <> 'D'),
hashed AS (SELECT g, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (place - opened) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY place)) AS repaired_sha256 FROM kept GROUP BY g)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM convs LEFT JOIN stats USING (g) LEFT JOIN best USING (g) LEFT JOIN hashed USING (g)
"""


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


#: All n-grams written out and counted; a candidate is looked for in longer ones as a string between blanks.
OP12_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM worded, (SELECT unnest(range(1, 6)) AS size) WHERE len(w) >= size)),
counts AS (SELECT lang, phrase, size, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
totals AS (SELECT lang, count(*) AS n FROM grams WHERE size = 1 GROUP BY lang),
cuts AS (SELECT *, array_to_string(w[1 : k], ' ') AS left_part, array_to_string(w[k + 1 :], ' ') AS right_part FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, size)) AS k FROM counts WHERE size > 1)),
scored AS (SELECT c.lang, c.phrase, c.size, c.a, k, l.a AS l, r.a AS r, n, CAST(CAST(1000 AS HUGEINT) * c.a * n // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = c.left_part JOIN counts r ON r.lang = c.lang AND r.phrase = c.right_part JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
alone AS (SELECT * FROM lowest s WHERE NOT EXISTS (SELECT 1 FROM counts b WHERE b.lang = s.lang AND b.size > s.size AND 100 * b.a >= 100 * s.a AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM alone QUALIFY rank <= 2000
"""


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


#: Targets by the water level among sources in the order of their limits, documents by running sums in the order of their hashes.
OP13_SQL = r"""
WITH docs AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, CAST('0x' || left(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 15) AS BIGINT) AS h FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM docs GROUP BY source),
weighed AS (SELECT *, [1, 5, 2][place % 3 + 1] AS weight, sum(source_size) OVER () AS total FROM sources),
levels AS (SELECT *, row_number() OVER o AS j, 3 * total - 2 * coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS among FROM weighed WINDOW o AS (ORDER BY 2.0 * source_size / weight, place)),
level AS (SELECT * FROM levels WHERE rest * weight <= 4 * source_size * among ORDER BY j LIMIT 1),
aims AS (SELECT s.source, s.source_size, CASE WHEN s.j < l.j THEN CAST(2 * s.source_size AS DOUBLE) ELSE CAST(l.rest * s.weight AS DOUBLE) / CAST(2 * l.among AS DOUBLE) END AS target FROM levels s, level l),
budgets AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM aims),
hashes AS (SELECT source, h, sum(size) AS s, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM docs GROUP BY source, h),
chosen AS (SELECT a.source, h, source_size, target, CAST(whole AS BIGINT) + CASE WHEN target - whole * source_size > 0 AND (upto <= target - whole * source_size OR upto - s <= target - whole * source_size AND 2 * (target - whole * source_size) > 2 * (upto - s) + s) THEN 1 ELSE 0 END AS copies FROM hashes k JOIN budgets a ON a.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken FROM docs d JOIN chosen c ON d.source IS NOT DISTINCT FROM c.source AND d.h = c.h
"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_token_records, op2_spaced_seed_leaks, op3_multi_index_near_dedup, op4_ngram_jaccard_join, op5_warc, op6_main_text, op7_toxicity_chain, op8_chat_formatting, op9_best_fit_packing, op10_language_id, op11_conversation_repair, op12_phrase_collocations, op13_source_mixing)}


def oracle_sql() -> dict[str, str]:
    return {"op2_spaced_seed_leaks": _op2_sql(), "op8_chat_formatting": OP8_SQL, "op11_conversation_repair": _op11_sql(), "op12_phrase_collocations": OP12_SQL, "op13_source_mixing": OP13_SQL}
