"""The operators' queries over the whole tables, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from lodestar.llm import bpe, chat, collocations, decontaminate, html_extract, langid, license_scan, media, packing, quality, simhash, vector_codes, warc
from lodestar.llm.columns import table


def op1_decontamination(spark, sf_dir):
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_language(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


#: A conversation whose texts look like a template's control strings.
TRICKY = [(-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]


def op4_chat(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(TRICKY, "conv_id bigint, turn bigint, role string, text string"))
    return chat.digests(chat.examples(rows))


def op5_warc(spark, sf_dir):
    return warc.archive(table(spark, sf_dir, "pages"))


def op6_html(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op7_quality(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_license(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op9_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op10_media(spark, sf_dir):
    return media.media_columns(table(spark, sf_dir, "documents"))


def op11_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark, sf_dir):
    return vector_codes.encode(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_simhash, op3_language, op4_chat, op5_warc, op6_html, op7_quality, op8_license, op9_bpe, op10_media, op11_collocations, op12_packing, op13_vector_codes)}

WINDOWS = decontaminate.WINDOW


def _escapes(value: str) -> str:
    """SQL for the number of characters that escaping adds."""
    marks = ("\\", "<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    return " + ".join(f"(length({value}) - length(replace({value}, '{m}', ''))) // {len(m)}" for m in marks)


SQL = {
    "op1_decontamination": f"""
WITH doc AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM documents),
item AS (SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
wins AS (SELECT DISTINCT item_id, ws[s + 1 : s + least(len(ws), {WINDOWS})] AS w FROM (SELECT item_id, ws, unnest(range(greatest(len(ws) - {WINDOWS} + 1, 1))) AS s FROM item WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT len(w) AS size FROM wins),
starts AS (SELECT doc_id, s, size, ws[s + 1 : s + size] AS w FROM (SELECT doc_id, ws, size, unnest(range(len(ws) - size + 1)) AS s FROM doc JOIN sizes ON len(ws) >= size)),
hits AS (SELECT doc_id, s, size, item_id FROM starts JOIN wins USING (w)),
places AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(s, s + size)) AS place FROM (SELECT DISTINCT doc_id, s, size FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(places.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(places.n, 0) > 0 AND {decontaminate.SHARE} * coalesce(places.n, 0) >= len(ws) AS contaminated
FROM doc LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op4_chat": f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES {", ".join(f"({c}, {t}, '{r}', '{x}')" for c, t, r, x in TRICKY)})),
sized AS (SELECT *, {len(chat.TURN + chat.SAYS + chat.END)} + length(role) + length(text) + {_escapes("role")} + {_escapes("text")} AS size FROM turns),
upto AS (SELECT *, sum(size) OVER o AS upto, lead(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS NULL AS final FROM sized
  WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (role = 'assistant' OR final)::BIGINT AS formatted_chars,
  count(*) FILTER (role = 'assistant' OR final)::BIGINT AS n_examples
FROM upto GROUP BY conv_id
""",
    "op5_warc": """
WITH keyed AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
owned AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS owner FROM keyed)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(h, 1 + (5 * i) // 4, 2))::INTEGER >> (3 - (5 * i) % 4)::INTEGER) & 31)), 1)), '') AS payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM owned
""",
    "op8_license": license_scan.oracle(),
    "op11_collocations": collocations.oracle(),
    "op13_vector_codes": vector_codes.oracle(),
}
