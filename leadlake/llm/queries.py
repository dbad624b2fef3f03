"""The ten operators over their whole tables, with the parameters meant for production, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leadlake.llm import chat, decontaminate, exactdedup, langid, linededup, mixing, neardup, quality, tokens, urlfilter
from leadlake.sources.tables import read_table


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name) if name in ("documents", "pages") else spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_spans(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.repeated_lines(_read(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(_read(spark, sf_dir, "pages"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_duplicates(_read(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train(docs, _read(spark, sf_dir, "labels")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_read(spark, sf_dir, "documents"), epochs=mixing.EPOCHS)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(chat.pack_turns(_read(spark, sf_dir, "conversations")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_prefixes(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_near_duplicates, op2_decontamination, op3_line_dedup, op4_url_filter, op5_language_id, op6_exact_dedup, op7_quality, op8_mixing, op9_chat_format, op10_token_counts)}


_WORD = r"[0-9A-Za-z\x{C0}-\x{1FFF}\x{2070}-\x{2FFF}\x{3040}-\x{10FFFF}]+"
_GAP = r"[^0-9A-Za-z\x{C0}-\x{1FFF}\x{2070}-\x{2FFF}\x{3040}-\x{10FFFF}]*"

_EIGHT = ", ".join(f"lead(word, {k}) OVER d AS w{k}" for k in range(1, decontaminate.PHRASE))
_NAMES = ["word", *(f"w{k}" for k in range(1, decontaminate.PHRASE))]

# phrases are joined on as many words as they have, one equality a word; no list of a whole text is carried along its words
_SPANS = rf"""
WITH pieces AS (
  SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) - 1 AS nth FROM (SELECT doc_id, regexp_extract_all(text, '{_GAP}{_WORD}') AS p FROM documents)
), words AS (
  SELECT doc_id, nth, length(piece) AS width, regexp_extract(piece, '{_WORD}') AS raw, lower(regexp_extract(piece, '{_WORD}')) AS word FROM pieces
), items AS (
  SELECT item_id, regexp_extract_all(lower(text), '{_WORD}') AS w FROM benchmark WHERE len(regexp_extract_all(lower(text), '{_WORD}')) > 0
), phrases AS (
  SELECT DISTINCT w[k : k + {decontaminate.PHRASE} - 1] AS p FROM (SELECT w, unnest(generate_series(1, greatest(1, len(w) - {decontaminate.PHRASE} + 1))) AS k FROM items)
), grams AS (
  SELECT doc_id, nth, word, {_EIGHT} FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY nth)
), hits AS (
  {" UNION ALL ".join(f"SELECT g.doc_id, g.nth AS a, g.nth + {n} AS b FROM grams g JOIN (SELECT p FROM phrases WHERE len(p) = {n}) x ON " + " AND ".join(f"g.{_NAMES[k]} = x.p[{k + 1}]" for k in range(n)) for n in range(1, decontaminate.PHRASE + 1))}
), marked AS (
  SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM hits
), grouped AS (
  SELECT doc_id, min(a) AS a, max(b) AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM marked) GROUP BY doc_id, g
), placed AS (
  SELECT w.doc_id, nth, sum(width) OVER (PARTITION BY w.doc_id ORDER BY nth) AS stop, length(raw) AS own FROM words w WHERE w.doc_id IN (SELECT doc_id FROM hits)
)
SELECT g.doc_id, g.a AS first_word, g.b AS end_word, CAST(f.stop - f.own AS BIGINT) AS start, CAST(l.stop AS BIGINT) AS stop
FROM grouped g JOIN placed f ON f.doc_id = g.doc_id AND f.nth = g.a JOIN placed l ON l.doc_id = g.doc_id AND l.nth = g.b - 1
"""

_LINES = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE doc_id IS NOT NULL
), refs AS (
  SELECT doc_id, line_no, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS line FROM lines
), counted AS (
  SELECT doc_id, line_no, count(*) OVER (PARTITION BY line) AS refs, first_value(doc_id) OVER w AS first_doc, first_value(line_no) OVER w AS first_line
  FROM refs WHERE line <> '' WINDOW w AS (PARTITION BY line ORDER BY doc_id, line_no)
)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, first_doc, CAST(first_line AS INTEGER) AS first_line, refs FROM counted WHERE doc_id <> first_doc OR line_no <> first_line
"""

_EXACT = """
SELECT doc_id, group_id, group_size, doc_id = group_id AS kept FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS group_id, count(*) OVER (PARTITION BY text) AS group_size
  FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)) WHERE group_size > 1
"""

_URL_BLOCKED = "len(list_filter(string_split_regex(regexp_extract(key, '^([^/?:]*)', 1), '[.\\-]'), lambda x: x IN (" + ", ".join(f"'{w}'" for w in urlfilter.BLOCK_WORDS) + "))) > 0"


def _sql_key(url: str) -> str:
    host = rf"regexp_replace(lower(regexp_extract({url}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.', '')"
    port = rf"regexp_replace(regexp_extract({url}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?[^/?#:]*(:[0-9]+)', 1), '^:(80|443)$', '')"
    rest = rf"regexp_extract({url}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*([^#]*)', 1)"
    path = f"regexp_replace(regexp_extract({rest}, '^([^?]*)', 1), '/+$', '')"
    kept = rf"array_to_string(list_filter(string_split(regexp_extract({rest}, '\?(.*)$', 1), '&'), lambda x: NOT regexp_matches(x, '^{urlfilter.TRACKING}(=.*)?$')), '&')"
    return f"{host} || {port} || {path} || CASE WHEN {kept} = '' THEN '' ELSE '?' || {kept} END"


# pages here say nothing of themselves, so the edges are those of mobile hosts; what pages say is covered by tests/llm
_URLS = f"""
WITH RECURSIVE keyed AS (SELECT page_id, url, {_sql_key("trim(url)")} AS key FROM pages),
edges AS (SELECT DISTINCT key AS u, regexp_replace(key, '^(amp|m|mobile|touch)\\.', '') AS v FROM keyed WHERE regexp_matches(key, '^(amp|m|mobile|touch)\\.[^/?:]*\\.')),
ways AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
reach(node, low) AS (SELECT u, u FROM ways UNION SELECT b.v, r.low FROM reach r JOIN ways b ON b.u = r.node),
groups AS (SELECT node, min(low) AS component FROM reach GROUP BY 1),
nodes AS (SELECT key FROM keyed WHERE key IS NOT NULL UNION SELECT node FROM groups),
bad AS (SELECT DISTINCT component FROM groups JOIN nodes n ON n.key = groups.node WHERE {_URL_BLOCKED}),
told AS (SELECT k.*, coalesce(g.component, k.key) AS component, coalesce(key <> '' AND {_URL_BLOCKED}, false) AS own, g.component IN (SELECT component FROM bad) AS alias FROM keyed k LEFT JOIN groups g ON g.node = k.key)
SELECT page_id, url, key, component, CASE WHEN own OR coalesce(alias, false) THEN 'block' ELSE 'pass' END AS decision, CASE WHEN own THEN 'blocked' WHEN coalesce(alias, false) THEN 'alias of a blocked URL' ELSE '' END AS reason FROM told
"""

_CHAT = r"""
WITH clean AS (
  SELECT conv_id, turn, role, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body, lower(trim(role)) AS plain FROM conversations WHERE conv_id IS NOT NULL
), kept AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(turn, -1), coalesce(role, ''), coalesce(text, '')) - 1 AS turn,
    CASE WHEN plain IS NULL OR plain = '' THEN 'user' WHEN plain IN ('human', 'prompter', 'customer') THEN 'user' WHEN plain IN ('gpt', 'bot', 'model', 'chatgpt', 'ai') THEN 'assistant'
      WHEN plain = 'developer' THEN 'system' WHEN plain = 'function' THEN 'tool' ELSE plain END AS role, body AS text
  FROM clean WHERE body <> ''
), every AS (
  SELECT conv_id, CAST(turn AS INTEGER) AS turn, role, text FROM kept
  UNION ALL SELECT DISTINCT conv_id, CAST(NULL AS INTEGER), NULL, NULL FROM conversations WHERE conv_id IS NOT NULL AND conv_id NOT IN (SELECT conv_id FROM kept)
)
SELECT conv_id, left(sha256('turns' || chr(10) || 'turns[]' || chr(10) || 'turns[].role' || chr(10) || 'turns[].text' || chr(10) || 'turns[].turn'), 16) AS fingerprint, 'turns' AS layout, turn, role, text FROM every
"""


def oracle_sql() -> dict[str, str]:
    """Where SQL can't say it (signatures, fitted models, seeded draws, a tokenizer), tests hold a brute-force version."""
    return {"op2_decontamination": _SPANS, "op3_line_dedup": _LINES, "op4_url_filter": _URLS, "op6_exact_dedup": _EXACT, "op9_chat_format": _CHAT}
