"""All queries of the conversation engine, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.functions import redaction, text
from parlance.operators import activity, evidence, filtering, merging, rendering, report, routing
from parlance.operators import markdown_blocks as markdown
from parlance.schema import ExportOptions
from parlance.sources.conversations import SPEAKERS, base_conversations, messages_from_clipboard, messages_from_turns, read_table, spread

VERSION, CAPTURED_AT = "1.0.0", "2026-01-01T00:00:00.000Z"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "conversations")


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages_from_turns(_turns(spark, sf_dir))


def _headers(messages: DataFrame) -> DataFrame:
    title = F.concat(F.lit("Conversation "), F.col("conv_id").cast("string"))
    return base_conversations(messages.select("conv_id").distinct().withColumn("title", title), CAPTURED_AT)


def message_text_hash(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", F.sha2("text", 256).alias("text_hash"))


def stable_id(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", text.fnv1a(F.col("text")).alias("id_number"))


def compact_ws(spark, sf_dir):
    return spread(read_table(spark, sf_dir, "documents")).select("doc_id", text.compact_whitespace(F.col("text")).alias("text"))


def slugify_titles(spark, sf_dir):
    return read_table(spark, sf_dir, "part").select("p_partkey", text.slugify(F.col("p_name")).alias("slug"))


def anonymize_url(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", text.anonymous_url(F.col("url")).alias("url"))


def describe_page(spark, sf_dir):
    kind = routing.page_kind(F.col("url"))
    return read_table(spark, sf_dir, "pages").select("page_id", kind.alias("kind"), routing.page_state(kind).alias("state"), routing.provider(F.col("url")).alias("provider"))


def redact_email(spark, sf_dir):
    return spread(read_table(spark, sf_dir, "documents")).select("doc_id", redaction.redact_email(F.col("text")).alias("text"))


def redact_keys(spark, sf_dir):
    return spread(read_table(spark, sf_dir, "documents")).select("doc_id", redaction.redact_keys(F.col("text")).alias("text"))


def redact_all(spark, sf_dir):
    return spread(read_table(spark, sf_dir, "documents")).select("doc_id", redaction.redact_text(F.col("text")).alias("text"))


def interim_flags(spark, sf_dir):
    return _messages(spark, sf_dir).select("conv_id", "msg_idx", filtering.interim_flag().alias("interim"))


def drop_interim(spark, sf_dir):
    kept = filtering.apply_export_options(_messages(spark, sf_dir), ExportOptions(collapse_intermediate=False, redact_secrets=False))
    return kept.select("conv_id", "msg_idx", "role")


def export_markdown(spark, sf_dir):
    messages = _messages(spark, sf_dir)
    return rendering.quick_markdown(messages, _headers(messages), VERSION)


def export_json(spark, sf_dir):
    messages = _messages(spark, sf_dir)
    return rendering.export(messages, _headers(messages), "json", ExportOptions(redact_secrets=False), VERSION)


def clipboard_split(spark, sf_dir):
    line = F.concat_ws(": ", "role", "text")
    whole = _turns(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("t")))).alias("x"))
    found = messages_from_clipboard(whole.select("conv_id", F.array_join(F.transform("x", lambda i: i["t"]), "\n").alias("text")))
    return found.select("conv_id", "msg_idx", "role", F.col("content")[0]["text"].alias("text"))


def activity_split(spark, sf_dir):
    """Turns with an activity line and, twice, a document chip about them; assistant turns are taken apart."""
    turns = _turns(spark, sf_dir)
    chip = F.concat(F.lit("Plan "), F.col("turn").cast("string"), F.lit("\n\nDokument · MD"))
    made = F.concat_ws("\n\n", F.concat(F.lit("Thought for "), F.col("turn").cast("string"), F.lit("s.")), "text", chip, chip)
    split = activity.separate_activity(messages_from_turns(turns.withColumn("text", made)))
    return split.select("conv_id", "msg_idx", "role", "kind", F.col("content")[0]["text"].alias("text"))


def capture_report(spark, sf_dir):
    return report.capture_report(_messages(spark, sf_dir)).drop("min_id", "max_id", "ids_increase")  # turns have no provider ids


def select_and_edit(spark, sf_dir):
    """What people and assistants said, with long messages edited to their first hundred characters."""
    messages = _messages(spark, sf_dir)
    selection = messages.where(F.col("role") != "system").select("conv_id", F.col("id").alias("msg_id"))
    edits = messages.select("conv_id", F.col("id").alias("msg_id"), F.substring(F.col("content")[0]["text"], 1, 100).alias("markdown"))
    out = filtering.apply_edits(filtering.select_messages(messages, selection), edits)
    return out.select("conv_id", "msg_idx", F.col("content")[0]["text"].alias("text"))


def _windows_of_four():
    return F.sequence(F.greatest(F.floor(F.col("turn") / 2) - 1, F.lit(0)), F.floor(F.col("turn") / 2)).cast("array<int>")


def merge_windows(spark, sf_dir):
    """Conversations cut into windows of four turns that overlap by two, then merged again."""
    turns = _turns(spark, sf_dir)
    rows = turns.withColumn("snapshot_seq", F.explode(_windows_of_four()))
    place = F.row_number().over(Window.partitionBy("conv_id", "snapshot_seq").orderBy("turn"))
    identity = F.concat(F.lit("p"), F.col("turn").cast("string"))
    null = F.lit(None)
    snapshots = rows.select("conv_id", "snapshot_seq", place.alias("msg_idx"), "role", null.cast("string").alias("kind"), identity.alias("provider_id"), F.concat_ws(":", F.lit("message"), "role", identity).alias("key"), "text", null.cast("double").alias("top"))
    return merging.merge_snapshots(snapshots).select("conv_id", "msg_idx", "role", "text")


def merge_repeated_texts(spark, sf_dir):
    """The windows of ``merge_windows`` without ids: equal texts are told apart by their positions on the page."""
    turns = _turns(spark, sf_dir).withColumn("text", F.concat(F.lit("continue "), "role"))
    rows = turns.withColumn("snapshot_seq", F.explode(_windows_of_four()))
    place = F.row_number().over(Window.partitionBy("conv_id", "snapshot_seq").orderBy("turn"))
    null = F.lit(None).cast("string")
    key = F.concat_ws(":", F.lit("message"), "role", F.sha2("text", 256))
    snapshots = rows.select("conv_id", "snapshot_seq", place.alias("msg_idx"), "role", null.alias("kind"), null.alias("provider_id"), key.alias("key"), "text", (F.col("turn") * 70.0).alias("top"))
    return merging.merge_snapshots(snapshots).select("conv_id", "msg_idx", "id", "role", "text")


def evidence_manifest(spark, sf_dir):
    messages = filtering.apply_export_options(_messages(spark, sf_dir))
    headers = _headers(messages)
    found = evidence.manifest(evidence.evidence_files(messages, headers, VERSION), headers, VERSION, CAPTURED_AT)
    return found.select("conv_id", F.col("hashes")["transcript.md"].alias("markdown_sha256"), F.size("hashes").alias("n_files"))


def _by_role(turns: DataFrame) -> DataFrame:
    """Turns numbered anew with those of a role together, so that runs of assistant turns exist."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("role", "turn")) - 1
    return turns.withColumn("turn", place)


def interim_runs(spark, sf_dir):
    """Interim flags where the assistant's turns stand together."""
    return messages_from_turns(_by_role(_turns(spark, sf_dir))).select("conv_id", "msg_idx", "role", filtering.interim_flag().alias("interim"))


def without_interim_runs(spark, sf_dir):
    """What is left if interim replies are dropped, where the assistant's turns stand together."""
    kept = filtering.apply_export_options(messages_from_turns(_by_role(_turns(spark, sf_dir))), ExportOptions(collapse_intermediate=False, redact_secrets=False))
    return kept.select("conv_id", "msg_idx", "role", F.col("content")[0]["text"].alias("text"))


def folded_markdown(spark, sf_dir):
    """Markdown of conversations whose assistant turns stand together: all but the last are folded."""
    messages = messages_from_turns(_by_role(_turns(spark, sf_dir)))
    return rendering.quick_markdown(messages, _headers(messages), VERSION)


#: Hosts and odd addresses that the pages of ``route_pages`` get in turn.
_ADDRESSES = (*(f"https://{h}/c/1?x=y" for h, _, _ in routing.PROVIDERS), *(f"http://a.{h}:8080/" for h, _, _ in routing.PROVIDERS), "https://notpoe.com/", "https://poe.com.example.org/", f"https://{routing.RESTRICTED_HOST}/x", "chrome://settings", "file:///tmp/x", "no address", "")


def route_pages(spark, sf_dir):
    """Pages whose addresses are those of each provider, of subdomains, of look-alikes, restricted, invalid or missing, in turn."""
    place = F.pmod(F.col("page_id"), F.lit(len(_ADDRESSES) + 2)).cast("int")
    url = F.when(place < len(_ADDRESSES), F.get(F.array(*(F.lit(x) for x in _ADDRESSES)), place)).when(place == len(_ADDRESSES), F.col("url"))
    pages = read_table(spark, sf_dir, "pages").select("page_id", url.alias("url"))
    kind = routing.page_kind(F.col("url"))
    return pages.select("page_id", kind.alias("kind"), routing.page_state(kind).alias("state"), routing.provider(F.col("url")).alias("provider"), F.coalesce(routing.page_label(F.col("url")), F.lit("")).alias("label"))


def route_by_rules(spark, sf_dir):
    """Pages routed by rules that their own hosts give: hosts of several pages, and domains of several hosts."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    host = F.lower(F.try_parse_url("url", F.lit("HOST")))
    named = pages.select(host.alias("host"), F.regexp_extract(host, "[^.]+\\.[^.]+$", 0).alias("domain")).where(F.col("host") != "")
    often = named.groupBy("host").count().where(F.col("count") > 1).select(F.col("host").alias("suffix"), F.lit("host").alias("provider"))
    wide = named.distinct().where(F.col("domain") != "").groupBy("domain").count().where(F.col("count") > 1).select(F.col("domain").alias("suffix"), F.lit("domain").alias("provider"))
    return routing.with_rules(pages, often.unionByName(wide)).select("page_id", F.coalesce("rule", F.lit("")).alias("rule"), "provider")


def markdown_blocks(spark, sf_dir):
    """Blocks of all documents, with every second sentence made an item of a list and every fourth line a heading."""
    made = F.regexp_replace(F.regexp_replace("text", "\\. (\\w+ \\w+)", ".\n\n$1"), "\\n\\n([^\\n]*)\\n\\n([^\\n]*)", "\n- $1\n\n## $2\n\n")
    return markdown.markdown_blocks(spread(read_table(spark, sf_dir, "documents").select("doc_id", made.alias("text"))))


def evidence_manifest_json(spark, sf_dir):
    """The manifest of every conversation as it is written."""
    messages = filtering.apply_export_options(_messages(spark, sf_dir))
    headers = _headers(messages)
    return evidence.manifest(evidence.evidence_files(messages, headers, VERSION), headers, VERSION, CAPTURED_AT).select("conv_id", "manifest")


_FLAGS = f"SELECT *, role = 'assistant' AND coalesce(lead(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'assistant', false) AS interim FROM conversations"
_MARKDOWN = rf"""
WITH f AS ({_FLAGS}), r AS (SELECT *, coalesce(sum((NOT interim)::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM f),
q AS (SELECT *, CASE WHEN role = 'assistant' THEN text ELSE array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN trim(x) = '' THEN '>' ELSE '> ' || x END), chr(10)) END AS shown FROM r),
g AS (SELECT conv_id, run, count(*) FILTER (WHERE interim AND text <> '') AS n, string_agg(text || chr(10), chr(10) ORDER BY turn) FILTER (WHERE interim AND text <> '') AS folded,
  max(shown || chr(10)) FILTER (WHERE NOT interim AND text <> '') AS shown, count(*) AS c FROM q GROUP BY 1, 2),
p AS (SELECT conv_id, run, c, concat_ws(chr(10), CASE WHEN n > 0 THEN '<details><summary>' || n || ' previous message' || CASE WHEN n = 1 THEN '' ELSE 's' END || '</summary>' || chr(10) || chr(10) || folded || chr(10) || '</details>' || chr(10) END, shown) AS t FROM g),
w AS (SELECT conv_id, sum(c) AS c, string_agg(t, chr(10) ORDER BY run) FILTER (WHERE t <> '') AS body FROM p GROUP BY 1)
SELECT conv_id, 'conversation-' || conv_id || '.md' AS filename,
  regexp_replace(regexp_replace(concat_ws(chr(10), '---', 'schema_version: "1.0"', 'provider: "generic"', 'title: "Conversation ' || conv_id || '"', 'captured_at: "{CAPTURED_AT}"', 'message_count: "' || c || '"', 'extension_version: "{VERSION}"', '---' || chr(10), '# Conversation ' || conv_id, '', body), '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'), '\s+$', '') || chr(10) AS content FROM w
"""
_PROVIDER = " ".join(f"WHEN host = '{h}' OR ends_with(host, '.{h}') THEN '{p}'" for h, _, p in routing.PROVIDERS)
_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]*)', 1))"

QUERIES = {f.__name__: f for f in (
    message_text_hash, stable_id, compact_ws, slugify_titles, anonymize_url, describe_page, redact_email, redact_keys, redact_all, interim_flags, drop_interim,
    export_markdown, export_json, clipboard_split, activity_split, capture_report, select_and_edit, merge_windows, merge_repeated_texts, evidence_manifest,
    interim_runs, without_interim_runs, folded_markdown, route_pages, route_by_rules, markdown_blocks, evidence_manifest_json,
)}

ORACLES = {
    "message_text_hash": "SELECT conv_id, turn, sha256(text) AS text_hash FROM conversations",
    "stable_id": "SELECT conv_id, turn, list_reduce(list_transform(string_split(text, ''), lambda c: unicode(c)::BIGINT), lambda h, c: (xor(h, c) * 16777619::BIGINT) & 4294967295, 2166136261::BIGINT) AS id_number FROM conversations",
    "compact_ws": r"SELECT doc_id, trim(regexp_replace(text, '[\x09-\x0D \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+', ' ', 'g')) AS text FROM documents",
    "slugify_titles": r"SELECT p_partkey, coalesce(nullif(left(regexp_replace(regexp_replace(regexp_replace(lower(p_name), 'https?://', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 72), ''), 'conversation') AS slug FROM part",
    "anonymize_url": rf"SELECT page_id, CASE WHEN url ~ '^https?://.*' THEN regexp_extract(url, '^(https?)://', 1) || '://' || {_HOST} || coalesce(nullif(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), ''), '/') ELSE '' END AS url FROM pages",
    "describe_page": rf"""WITH p AS (SELECT page_id, coalesce(url, '') AS url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, {_HOST} AS host FROM pages),
        k AS (SELECT *, CASE {_PROVIDER} END AS found FROM p),
        t AS (SELECT *, CASE WHEN url = '' OR scheme = '' THEN 'unknown' WHEN scheme NOT IN ('http', 'https') OR host = '{routing.RESTRICTED_HOST}' THEN 'restricted' WHEN found IS NOT NULL THEN 'provider' ELSE 'web' END AS kind FROM k)
        SELECT page_id, kind, CASE kind WHEN 'web' THEN 'warning' WHEN 'restricted' THEN 'error' ELSE 'ready' END AS state, coalesce(found, 'generic') AS provider FROM t""",
    "redact_email": r"SELECT doc_id, regexp_replace(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b', '[redacted-email]', 'g') AS text FROM documents",
    "redact_keys": r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\b(?:AKIA|ASIA)[0-9A-Z]{16}\b', '[redacted-aws-key]', 'g'),
        '\b(?:sk|rk|pk|xox[baprs]|ghp|github_pat)_[A-Za-z0-9_-]{16,}\b', '[redacted-token]', 'g'), '\b[A-Za-z0-9_-]{32,}\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}\b', '[redacted-token]', 'g'),
        '(?i)\b(api[_-]?key|token|secret|password)\s*[:=]\s*["'']?[^"''\s,;]{8,}', '\1=[redacted-secret]', 'g') AS text FROM documents""",
    "interim_flags": f"SELECT conv_id, turn::INT AS msg_idx, interim FROM ({_FLAGS})",
    "drop_interim": f"SELECT conv_id, turn::INT AS msg_idx, role FROM ({_FLAGS}) WHERE NOT interim",
    "export_markdown": _MARKDOWN,
    "clipboard_split": rf"""WITH w AS (SELECT conv_id, string_agg(concat_ws(': ', role, text), chr(10) ORDER BY turn) AS t FROM conversations GROUP BY 1),
        b AS (SELECT conv_id, list_filter(list_transform(string_split(regexp_replace(t, '(?i)\n((?:{SPEAKERS})\s*:)', chr(1) || '\1', 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l,
          list_filter(list_transform(string_split_regex(t, '\n{{2,}}'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS q FROM w),
        r AS (SELECT conv_id, i - 1 AS i, (CASE WHEN len(l) > 1 THEN l ELSE q END)[i] AS t, len(l) > 1 AS labelled FROM b, unnest(range(1, CASE WHEN len(l) > 1 THEN len(l) ELSE len(q) END + 1)) AS u(i)),
        p AS (SELECT conv_id, i, labelled AND regexp_matches(t, '^[^:\n]{{1,24}}\s*:') AS has, t, lower(regexp_extract(t, '^([^:\n]{{1,24}}?)\s*:', 1)) AS label FROM r)
        SELECT conv_id, i::INT AS msg_idx, CASE WHEN has AND regexp_matches(label, 'user|you|human') THEN 'user' WHEN has AND regexp_matches(label, 'assistant|chatgpt|claude|ai') THEN 'assistant' WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END AS role,
          regexp_replace(CASE WHEN has THEN substr(t, instr(t, ':') + 1) ELSE t END, '^\s+|\s+$', '', 'g') AS text FROM p""",
    "activity_split": """WITH c AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, 'Thought for ' || turn || 's' AS a, 'Plan ' || turn AS p, text FROM conversations),
        m AS (SELECT conv_id, turn, 0 AS n, role, 'activity' AS kind, a || chr(10) || 'Artefakt: ' || p AS text FROM c WHERE role = 'assistant'
          UNION ALL SELECT conv_id, turn, 1, role, NULL, text FROM c WHERE role = 'assistant' AND trim(text) <> ''
          UNION ALL SELECT conv_id, turn, 1, role, NULL, concat_ws(chr(10) || chr(10), a || '.', text, p, 'Dokument · MD', p, 'Dokument · MD') FROM c WHERE role <> 'assistant')
        SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, n) - 1)::INT AS msg_idx, role, kind, text FROM m""",
    "capture_report": """SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE role = 'user') AS n_user, count(*) FILTER (WHERE role = 'assistant') AS n_assistant,
        count(*) - count(DISTINCT (role, text)) AS n_duplicates, count(*) FILTER (WHERE text = '') AS n_empty, min(turn)::INT AS first_idx, max(turn)::INT AS last_idx,
        count(*) = max(turn) - min(turn) + 1 AS contiguous, 0::BIGINT AS n_activity, 0::BIGINT AS n_documents, 0::BIGINT AS n_with_id, left(arg_min(text, turn), 50) AS first_text, left(arg_max(text, turn), 50) AS last_text FROM conversations GROUP BY conv_id""",
    "select_and_edit": "SELECT conv_id, turn::INT AS msg_idx, left(text, 100) AS text FROM conversations WHERE role <> 'system'",
    "merge_windows": "SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS msg_idx, role, text FROM conversations",
    "merge_repeated_texts": "SELECT conv_id, (row_number() OVER w - 1)::INT AS msg_idx, 'message-' || (row_number() OVER w) AS id, role, 'continue ' || role AS text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "export_json": rf"""WITH m AS (SELECT conv_id, turn, '    {{' || chr(10) || '      "role": ' || to_json(role) || ',' || chr(10) || '      "content": ' || to_json(text) || ',' || chr(10) || '      "metadata": {{' || chr(10) ||
        '        "index": ' || turn || ',' || chr(10) || '        "visibleTextHash": "' || sha256(text) || '"' || chr(10) || '      }}' || chr(10) || '    }}' AS j FROM conversations)
        SELECT conv_id, 'conversation-' || conv_id || '.json' AS filename, concat_ws(chr(10), '{{', '  "title": "Conversation ' || conv_id || '",', '  "provider": "generic",', '  "url": "",', '  "captured_at": "{CAPTURED_AT}",',
        '  "extension_version": "{VERSION}",', '  "message_count": ' || count(*) || ',', '  "messages": [', string_agg(j, ',' || chr(10) ORDER BY turn), '  ]', '}}') AS content FROM m GROUP BY conv_id""",
    "evidence_manifest": f"SELECT conv_id, sha256(content) AS markdown_sha256, 2 AS n_files FROM ({_MARKDOWN})",
}

_ROLES_TOGETHER = "FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY role, turn) - 1 AS turn, role, text FROM conversations)"
_LABEL = " ".join(f"WHEN host = '{h}' OR ends_with(host, '.{h}') THEN '{n}'" for h, n, _ in routing.PROVIDERS)
_ROUTED = f"FROM (SELECT page_id, CASE {' '.join(f'WHEN page_id % {len(_ADDRESSES) + 2} = {i} THEN {x!r}' for i, x in enumerate(_ADDRESSES))} WHEN page_id % {len(_ADDRESSES) + 2} = {len(_ADDRESSES)} THEN url END AS url FROM pages)"
ORACLES |= {
    "interim_runs": f"SELECT conv_id, turn::INT AS msg_idx, role, interim FROM ({_FLAGS.replace('FROM conversations', _ROLES_TOGETHER)})",
    "without_interim_runs": f"SELECT conv_id, turn::INT AS msg_idx, role, text FROM ({_FLAGS.replace('FROM conversations', _ROLES_TOGETHER)}) WHERE NOT interim",
    "folded_markdown": _MARKDOWN.replace("FROM conversations", _ROLES_TOGETHER),
    "route_pages": ORACLES["describe_page"].replace("FROM pages)", f"{_ROUTED})").replace(f"CASE {_PROVIDER} END AS found", f"CASE {_PROVIDER} END AS found, CASE {_LABEL} END AS label").replace(
        "coalesce(found, 'generic') AS provider", "coalesce(found, 'generic') AS provider, CASE WHEN kind = 'provider' THEN label ELSE '' END AS label"
    ),
    "route_by_rules": rf"""WITH p AS (SELECT page_id, coalesce({_HOST}, '') AS host FROM pages),
        d AS (SELECT host, regexp_extract(host, '[^.]+\.[^.]+$') AS domain FROM p WHERE host <> ''),
        r AS (SELECT host AS suffix, 'host' AS named FROM d GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT domain, 'domain' FROM d WHERE domain <> '' GROUP BY 1 HAVING count(DISTINCT host) > 1),
        u AS (SELECT suffix, min(named) AS named FROM r GROUP BY 1),
        m AS (SELECT host, arg_max(suffix, length(suffix)) AS rule, arg_max(named, length(suffix)) AS named FROM (SELECT DISTINCT host FROM d) JOIN u ON host = suffix OR ends_with(host, '.' || suffix) GROUP BY 1)
        SELECT page_id, coalesce(rule, '') AS rule, coalesce(named, CASE {_PROVIDER} END, 'generic') AS provider FROM p LEFT JOIN m USING (host)""",
    "evidence_manifest_json": rf"""WITH m AS (SELECT conv_id, sha256(content) AS md FROM ({_MARKDOWN})), j AS (SELECT conv_id, sha256(content) AS js FROM ({ORACLES["export_json"]}))
        SELECT conv_id, array_to_string(['{{', '  "schema_version": "1.0",', '  "original_page_included": false,', '  "source": {{', '    "provider": "generic",', '    "url": "",', '    "title": "Conversation ' || conv_id || '",',
          '    "captured_at": "{CAPTURED_AT}"', '  }},', '  "extension_version": "{VERSION}",', '  "artifacts": [],', '  "generated_at": "{CAPTURED_AT}",', '  "exported_formats": [', '    "transcript.md",', '    "conversation.json"', '  ],',
          '  "hashes": {{', '    "transcript.md": "' || md || '",', '    "conversation.json": "' || js || '"', '  }}', '}}'], chr(10)) AS manifest FROM m JOIN j USING (conv_id)""",
}
