"""The registered queries as SQL for another engine.

Written from the tables' definitions, not from the operators: traces are derived
from event columns instead of parsed text, answers from document columns instead
of JSON. ``statements`` prefixes each query with the common table expressions
that it names.
"""

from __future__ import annotations

import re

TIME = "'%Y-%m-%d %H:%M:%S.%f'"
SPACE = (
    r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}"
    r"\x{205F}\x{3000}\x{FEFF}]"
)


def _trim(text: str) -> str:
    return rf"regexp_replace({text}, '\A{SPACE}+|{SPACE}+\z', '', 'g')"


def _text(time: str) -> str:
    return f"strftime({time}, {TIME})"


def _words(text: str) -> str:
    return rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+')"


_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"


def _shown(html: str) -> str:
    """Text up to the end of its block, without tags; the entities of the tables."""
    text = rf"regexp_replace({html}, '(?is)</(?:title|h[1-6]|p|li|ul|ol|nav|article)\s*>.*', '')"
    text = f"regexp_replace({text}, '<[^>]*>', ' ', 'g')"
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        text = f"replace({text}, '&{name};', '{char}')"
    return _trim(text)


_OPEN = r"(?:^|[^\p{L}\p{N}])"
_SHUT = r"(?:[^\p{L}\p{N}]|$)"


def _intent(question: str) -> str:
    cases = (
        (rf"^(?:and|what about|why|same for){_SHUT}", "follow_up"),
        (rf"{_OPEN}(?:response|reject) +codes?{_SHUT}", "response_code"),
        (rf"{_OPEN}(?:mti|iso ?8583|fld|de-?[0-9]+|fields? +[0-9]+){_SHUT}", "message_field"),
        (rf"{_OPEN}hsm{_SHUT}", "hsm_command"),
        (rf"{_OPEN}(?:how|steps?|procedures?){_SHUT}", "procedure"),
        (rf"{_OPEN}examples?{_SHUT}", "example"),
    )
    whens = " ".join(f"WHEN regexp_matches(lower({question}), '{p}') THEN '{name}'" for p, name in cases)
    return f"CASE {whens} ELSE 'concept' END"


def _hex(number: str) -> str:
    return f"lpad(lower(hex({number})), 24, '0')"


def _item(number: str, *items: str) -> str:
    listed = ", ".join(f"'{i}'" for i in items)
    return f"([{listed}])[({number}) % {len(items)} + 1]"


VIEWS = {
    "msg": f"""
        SELECT conv_id, turn, lpad(lower(hex(conv_id)), 16, '0') || lpad(lower(hex(turn)), 8, '0') AS id,
               {_hex("conv_id")} AS conversation_id, role, text AS content,
               TIMESTAMP '2024-01-01' + to_seconds(conv_id * 60 + turn) AS created_at
        FROM conversations""",
    "head": """
        SELECT m.conversation_id AS id, any_value(m.conv_id) AS conv_id,
               max(CASE WHEN length(o.content) > 40
                        THEN substr(o.content, 1, 40) || '…' ELSE o.content END) AS title,
               CASE WHEN any_value(m.conv_id) % 5 = 0 THEN NULL
                    WHEN any_value(m.conv_id) % 2 = 1 THEN 'log'
                    ELSE 'documentation' END AS agent,
               min(m.created_at) AS created_at, max(m.created_at) AS updated_at
        FROM msg m LEFT JOIN (
            SELECT conv_id, turn, content FROM msg WHERE role = 'user'
            QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1
        ) o ON o.conv_id = m.conv_id
        GROUP BY m.conversation_id""",
    "incoming": f"""
        SELECT id, role, content, created_at + INTERVAL 1 DAY AS created_at,
               CASE conv_id % 10 WHEN 3 THEN 'bad-' || substr(conversation_id, 6)
                                 WHEN 7 THEN {_hex("conv_id + 10000000")}
                                 ELSE conversation_id END AS conversation_id
        FROM msg""",
    "posted": """
        SELECT i.*, CASE WHEN role NOT IN ('user', 'assistant') THEN 422
                         WHEN NOT regexp_full_match(conversation_id, '[0-9a-fA-F]{24}') THEN 400
                         WHEN NOT EXISTS (SELECT 1 FROM msg m
                                          WHERE m.conversation_id = i.conversation_id) THEN 404
                         ELSE 201 END AS status
        FROM incoming i""",
    "removal": f"""
        SELECT conv_id, CASE WHEN count_if(role = 'system') > 0 THEN {_hex("conv_id")}
                    WHEN conv_id % 5 = 0 THEN 'bad-' || substr({_hex("conv_id")}, 6)
                    ELSE {_hex("conv_id + 10000000")} END AS requested_id
        FROM conversations GROUP BY conv_id""",
    "creation": f"""
        SELECT conv_id, substr(text, 1, ([0, 1, 40, 100, 101])[conv_id % 5 + 1]) AS title,
               {_item("conv_id", "documentation", "log", "other")} AS agent
        FROM conversations WHERE turn = 0""",
    "created": """
        SELECT *, CASE WHEN length(title) BETWEEN 1 AND 100 THEN 201 ELSE 422 END AS status,
               CASE WHEN length(title) BETWEEN 1 AND 100
                    THEN substr(sha256(conv_id || '|' || title || '|2024-01-01 00:00:00'), 1, 24)
                    ELSE '' END AS id
        FROM creation""",
    "upload": f"""
        SELECT doc_id, doc_id // 3 AS request_id, doc_id % 3 AS ordinal,
               {_item("doc_id // 3", "documentation", "log")} AS agent,
               'application/' || {_item("doc_id", "pdf", "doc", "docx", "xls", "xlsx", "txt", "log")} AS content_type,
               n_chars * 2000 AS size,
               CASE WHEN doc_id % 20 = 0 THEN ''
                    WHEN doc_id % 20 = 1 THEN 'noext' || doc_id
                    WHEN doc_id % 20 = 2 THEN 'tool' || doc_id || '.EXE'
                    WHEN doc_id % 20 = 3 THEN 'x' || doc_id || '.'
                    WHEN doc_id % 4 = 0 THEN upper('doc' || doc_id || '.v1.' || {_item("doc_id", "pdf", "doc", "docx", "xls", "xlsx", "txt", "log")})
                    ELSE 'doc' || doc_id || '.v1.' || {_item("doc_id", "pdf", "doc", "docx", "xls", "xlsx", "txt", "log")}
               END AS filename
        FROM documents""",
    "checked": """
        SELECT *, CASE doc_id % 20
                    WHEN 0 THEN 'A file does not have a valid filename.'
                    WHEN 1 THEN 'File extension missing for ' || filename || '.'
                    WHEN 2 THEN 'Unsupported file type: .exe'
                    WHEN 3 THEN 'Unsupported file type: .'
                    ELSE '' END AS error
        FROM upload""",
    "failed": """
        SELECT request_id, arg_min(error, ordinal) AS error FROM checked
        WHERE error <> '' GROUP BY request_id""",
    "answer": """
        SELECT doc_id, text AS summary,
               CASE WHEN doc_id % 11 = 0 OR doc_id % 7 = 0 THEN []
                    ELSE string_split(text, chr(10)) END AS story,
               ([  'info', 'warning', 'error', 'critical'])[doc_id % 4 + 1] AS severity,
               'issue ' || doc_id AS title,
               CASE WHEN doc_id % 2 = 0 THEN 'detail ' || doc_id ELSE '' END AS detail,
               source, CASE WHEN doc_id % 3 = 0 THEN '' ELSE CAST(doc_id % 90 AS VARCHAR) END AS page
        FROM documents WHERE doc_id % 50 <> 49""",
    "tx": """
        SELECT event_id, ts, lpad(CAST(event_id AS VARCHAR), 19, '0') AS rrn, event_id % 16 = 5 AS stray,
               '400000******' || right(lpad(CAST(user_id AS VARCHAR), 12, '0'), 4) AS card,
               (event_id * 37) % 4000 AS lat,
               CASE WHEN event_type = 'error' THEN 'rev'
                    WHEN event_type = 'signup' AND event_id % 3 = 0 THEN 'lone'
                    WHEN event_type = 'purchase' AND event_id % 5 = 0 THEN 'decl'
                    ELSE 'ok' END AS path,
               event_id % 4 = 0 AS asked, event_id % 4 = 0 AND event_id % 20 <> 0 AS replied,
               CASE WHEN event_id % 28 = 0 THEN '15' ELSE '00' END AS rc
        FROM events""",
    "card": """
        SELECT *, CASE WHEN path = 'lone' THEN '' WHEN path = 'decl' THEN '05' ELSE '00' END AS code,
               CASE WHEN path = 'rev' AND event_id % 2 = 0 THEN '00' ELSE '' END AS rev_code,
               CASE WHEN path IN ('rev', 'decl') OR (replied AND rc <> '00') THEN 'ERROR'
                    WHEN path = 'lone' THEN 'UNKNOWN' ELSE 'OK' END AS status,
               1 + stray::BIGINT + (path <> 'lone')::BIGINT + (path = 'rev')::BIGINT + asked::BIGINT + replied::BIGINT AS n_lines
        FROM tx""",
    "entry": """
        SELECT rrn, ts AS moment, 0 AS rank, '0100' AS kind, card, '000000' AS proc, '' AS code,
               '' AS hsm_code, '' AS xid, '' AS rc, 'authorize' AS function,
               'Authorization was requested (MTI 0100).' AS sentence FROM card
        UNION ALL
        SELECT rrn, ts + to_milliseconds(lat), 1, '0110', '', '', code, '', '', '', 'respond',
               'The issuer answered with response code ' || code || '.' FROM card WHERE path <> 'lone'
        UNION ALL
        SELECT rrn, ts + to_milliseconds(2), 2, 'HSM>', '', '', '', 'CA', '1', '', 'hsm_command',
               'Security module was sent command CA.' FROM card WHERE asked
        UNION ALL
        SELECT rrn, ts + to_milliseconds(3), 3, 'HSM<', '', '', '', 'CB', '1', rc, 'hsm_reply',
               'Security module returned ' || rc || '.' FROM card WHERE replied
        UNION ALL
        SELECT rrn, ts + to_milliseconds(5000), 4, '0400', '', '', rev_code, '', '', '', 'reverse',
               'The authorization was reversed (MTI 0400).' FROM card WHERE path = 'rev'
        UNION ALL
        SELECT rrn, ts - INTERVAL 1 SECOND, 1, '0110', '', '', '05', '', '', '', 'respond',
               'The issuer answered with response code 05.' FROM card WHERE stray""",
    "broken": """
        SELECT rrn, '' AS xid, 'R1' AS rule, 'error' AS severity,
               'Missing DE-39 in reversal message' AS title,
               'Copy the response code into the reversal.' AS advice
        FROM card WHERE path = 'rev' AND rev_code = ''
        UNION ALL
        SELECT rrn, '', 'R2', 'warning', 'Response latency above threshold',
               'Check the route between acquirer and issuer.'
        FROM card WHERE path <> 'lone' AND lat > 3000
        UNION ALL
        SELECT rrn, '1', 'R3', 'warning', 'Security module command without reply',
               'Check that the security module is reachable.'
        FROM card WHERE asked AND NOT replied
        UNION ALL
        SELECT rrn, '1', 'R4', 'error', 'Security module returned an error',
               'Look up the return code of the security module.'
        FROM card WHERE replied AND rc <> '00'""",
    "told": """
        SELECT rrn, string_agg(sentence, ' ' ORDER BY moment, rank) AS story
        FROM entry GROUP BY rrn""",
    "line": f"""
        SELECT doc_id, source, unit_no, unit FROM (
            SELECT doc_id, source, unnest(string_split(text, chr(10))) AS unit,
                   generate_subscripts(string_split(text, chr(10)), 1) AS unit_no
            FROM documents) WHERE length({_trim("unit")}) > 0""",
    # Pages without what is not shown, every opening tag of a block as a mark, its
    # name and a second mark.
    "marked": rf"""
        SELECT page_id AS doc_id, url AS source,
               lower(regexp_extract(html, '(?is)<html\b[^>]*?\slang\s*=\s*["'']?([A-Za-z0-9-]+)', 1)) AS lang,
               regexp_replace(regexp_replace(html, '{_HIDDEN}', ' ', 'g'),
                   '(?i)<(title|h|p|li)[1-6]?(?:[\s/][^>]*)?>', chr(1) || '\1' || chr(2), 'g') AS html
        FROM pages""",
    "block": f"""
        SELECT doc_id, source, lang, unit_no - 1 AS unit_no,
               CASE lower(string_split(b, chr(2))[1]) WHEN 'title' THEN 'title' WHEN 'h' THEN 'heading'
                    WHEN 'p' THEN 'paragraph' ELSE 'item' END AS part,
               {_shown("string_split(b, chr(2))[2]")} AS unit FROM (
            SELECT doc_id, source, lang, unnest(string_split(html, chr(1))) AS b,
                   generate_subscripts(string_split(html, chr(1)), 1) AS unit_no
            FROM marked) WHERE unit_no > 1""",
    "corpus": f"SELECT doc_id, {_words('text')} AS words FROM documents",
    "posting": """
        SELECT doc_id, n_words, token, count(*) AS tf
        FROM (SELECT doc_id, len(words) AS n_words, unnest(words) AS token FROM corpus)
        GROUP BY ALL""",
    "lexrank": f"""
        SELECT item_id, doc_id, rank FROM (
            SELECT item_id, doc_id,
                   row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
            FROM (
                SELECT q.item_id, p.doc_id, round(sum(
                    ln(1 + (n.docs - d.df + 0.5) / (d.df + 0.5)) * p.tf * 2.2
                    / (p.tf + 1.2 * (0.25 + 0.75 * p.n_words / n.mean))), 6) AS score
                FROM (SELECT DISTINCT item_id, unnest({_words("text")}) AS token FROM benchmark) q
                JOIN posting p USING (token)
                JOIN (SELECT token, count(*) AS df FROM posting GROUP BY token) d USING (token),
                     (SELECT count(*) AS docs, avg(len(words)) AS mean FROM corpus) n
                GROUP BY q.item_id, p.doc_id)
        ) WHERE rank <= 10""",
    "piece": """
        SELECT kind || ':' || lpad(CAST(doc_id AS VARCHAR), 19, '0') || ':' || lpad(CAST(unit_no AS VARCHAR), 19, '0') AS unit_key,
               kind, doc_id, source, unit_no, unit
        FROM (SELECT 'document' AS kind, doc_id, source, unit_no, unit FROM line
              UNION ALL
              SELECT 'page', doc_id, source, unit_no, unit FROM block WHERE length(unit) > 0)""",
    "piecewords": f"SELECT unit_key, {_words('unit')} AS words FROM piece",
    "pieceposting": """
        SELECT unit_key, n_words, token, count(*) AS tf
        FROM (SELECT unit_key, len(words) AS n_words, unnest(words) AS token FROM piecewords)
        GROUP BY ALL""",
    "piecerank": f"""
        SELECT item_id, unit_key, rank FROM (
            SELECT item_id, unit_key,
                   row_number() OVER (PARTITION BY item_id ORDER BY score DESC, unit_key) AS rank
            FROM (
                SELECT q.item_id, p.unit_key, round(sum(
                    ln(1 + (n.docs - d.df + 0.5) / (d.df + 0.5)) * p.tf * 2.2
                    / (p.tf + 1.2 * (0.25 + 0.75 * p.n_words / n.mean))), 6) AS score
                FROM (SELECT DISTINCT item_id, unnest({_words("text")}) AS token FROM benchmark) q
                JOIN pieceposting p USING (token)
                JOIN (SELECT token, count(*) AS df FROM pieceposting GROUP BY token) d USING (token),
                     (SELECT count(*) AS docs, avg(len(words)) AS mean FROM piecewords) n
                GROUP BY q.item_id, p.unit_key)
        ) WHERE rank <= 3""",
    "vecrank": """
        SELECT item_id, vec_id, rank FROM (
            SELECT item_id, vec_id,
                   row_number() OVER (PARTITION BY item_id ORDER BY score DESC, vec_id) AS rank
            FROM (
                SELECT b.item_id, v.vec_id,
                       round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
                FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id
                JOIN embeddings v ON v.vec_id <> b.item_id)
        ) WHERE rank <= 10""",
    "ruleword": f"""
        SELECT DISTINCT rule, unnest({_words("title")}) AS token
        FROM (VALUES ('R1', 'Missing DE-39 in reversal message'),
                     ('R2', 'Response latency above threshold'),
                     ('R3', 'Security module command without reply'),
                     ('R4', 'Security module returned an error')) t(rule, title)""",
    "rulebest": """
        SELECT rule, doc_id FROM (
            SELECT q.rule, p.doc_id, round(sum(
                ln(1 + (n.docs - d.df + 0.5) / (d.df + 0.5)) * p.tf * 2.2
                / (p.tf + 1.2 * (0.25 + 0.75 * p.n_words / n.mean))), 6) AS score
            FROM ruleword q JOIN posting p USING (token)
            JOIN (SELECT token, count(*) AS df FROM posting GROUP BY token) d USING (token),
                 (SELECT count(*) AS docs, avg(len(words)) AS mean FROM corpus) n
            GROUP BY q.rule, p.doc_id)
        QUALIFY row_number() OVER (PARTITION BY rule ORDER BY score DESC, doc_id) = 1""",
}

QUERIES = {
    "conversation_history": f"""
        SELECT id, title, coalesce(agent, 'documentation') AS agent,
               {_text("created_at")} AS created_at, {_text("updated_at")} AS updated_at
        FROM (SELECT * FROM head ORDER BY head.updated_at DESC, id LIMIT 100)""",
    "conversation_lookup": """
        SELECT requested_id,
               CASE WHEN NOT regexp_full_match(requested_id, '[0-9a-fA-F]{24}') THEN 400
                    WHEN h.id IS NULL THEN 404 ELSE 200 END AS status,
               coalesce(title, '') AS title,
               CASE WHEN h.id IS NULL THEN '' ELSE coalesce(agent, 'documentation') END AS agent
        FROM (SELECT DISTINCT conversation_id AS requested_id FROM incoming) r
        LEFT JOIN head h ON h.id = r.requested_id""",
    "conversation_create_status": """
        SELECT conv_id, title, agent, '2024-01-01 00:00:00.000000' AS created_at,
               status, id, agent AS stored_agent FROM created""",
    "message_timeline": f"""
        SELECT conversation_id, position, id, role, content, 0::BIGINT AS n_attachments,
               {_text("created_at")} AS created_at
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY created_at, id) AS position
              FROM msg) WHERE position <= 500""",
    "message_groups": """
        SELECT conversation_id, count(*) + 1 AS n_messages,
               string_agg(role || ':' || content, '|' ORDER BY created_at, id)
               || '|assistant:The backend request failed.' AS messages
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY created_at, id) AS position
              FROM msg) WHERE position <= 500 GROUP BY conversation_id""",
    "message_append_status": """
        SELECT id, conversation_id, role, status,
               CASE status WHEN 400 THEN 'Invalid conversation ID'
                           WHEN 404 THEN 'Conversation not found' ELSE '' END AS detail
        FROM posted""",
    "conversation_touch": f"""
        SELECT h.id, {_text("h.created_at")} AS created_at,
               {_text("coalesce(max(p.created_at), any_value(h.updated_at))")} AS updated_at
        FROM head h LEFT JOIN posted p ON p.conversation_id = h.id AND p.status = 201
        GROUP BY h.id, h.created_at""",
    "conversation_delete_cascade": """
        SELECT 'conversation' AS kind, id FROM head
        WHERE id NOT IN (SELECT requested_id FROM removal)
        UNION ALL
        SELECT 'message', id FROM msg
        WHERE conversation_id NOT IN (SELECT requested_id FROM removal)""",
    "conversation_delete_status": """
        SELECT requested_id,
               CASE WHEN requested_id LIKE 'bad-%' THEN 400
                    WHEN count(m.id) = 0 THEN 404 ELSE 204 END AS status,
               count(m.id) AS deleted_messages
        FROM removal r LEFT JOIN msg m ON m.conversation_id = r.requested_id
        GROUP BY requested_id, r.conv_id""",
    "orphan_messages": """
        SELECT id, conversation_id, role FROM incoming
        WHERE conversation_id NOT IN (SELECT id FROM head)""",
    "agent_lookup": """
        SELECT id, agent,
               CASE agent WHEN 'documentation' THEN 'Documentation Agent'
                          WHEN 'log' THEN 'Log Analysis Agent' ELSE '' END AS agent_name,
               CASE agent
                 WHEN 'documentation' THEN 'Analyze technical specifications (PDF, Word and Excel) and answer questions based on their content.'
                 WHEN 'log' THEN 'Analyze authorization logs, reconstruct transaction flows, detect non-conformities and provide diagnostic recommendations.'
                 ELSE '' END AS agent_description,
               CASE agent WHEN 'log' THEN 'Activity' ELSE 'FileText' END AS icon
        FROM (SELECT id, coalesce(agent, 'documentation') AS agent FROM head
              UNION ALL SELECT id, agent FROM created WHERE status = 201)""",
    "latest_roles": """
        SELECT conversation_id, arg_max(role, created_at) AS role
        FROM msg GROUP BY conversation_id""",
    "conversation_memory": f"""
        SELECT m.conversation_id, m.id, {_text("m.created_at")} AS created_at,
               count(p.id) AS n_previous,
               coalesce(string_agg(p.role || ': ' || p.content, chr(10) ORDER BY p.turn), '') AS context
        FROM msg m LEFT JOIN msg p ON p.conv_id = m.conv_id AND p.turn BETWEEN m.turn - 3 AND m.turn - 1
        GROUP BY m.conversation_id, m.id, m.created_at""",
    "conversation_memory_state": f"""
        SELECT conversation_id, {_text("max(created_at)")} AS updated_at,
               string_agg(role || ': ' || content, chr(10) ORDER BY turn) AS context
        FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS newest FROM msg)
        WHERE turn > newest - 3 GROUP BY conversation_id""",
    "question_intent": rf"""
        SELECT id, conversation_id, question,
               CASE WHEN regexp_matches(lower(question), '^(?:and|what about|why|same for){_SHUT}') THEN 'follow_up'
                    WHEN regexp_matches(lower(question), '{_OPEN}(?:response|reject) +codes?{_SHUT}') THEN 'response_code'
                    WHEN regexp_matches(lower(question), '{_OPEN}(?:mti|iso ?8583|fld|de-?[0-9]+|fields? +[0-9]+){_SHUT}') THEN 'message_field'
                    WHEN regexp_matches(lower(question), '{_OPEN}hsm{_SHUT}') THEN 'hsm_command'
                    WHEN regexp_matches(lower(question), '{_OPEN}(?:how|steps?|procedures?){_SHUT}') THEN 'procedure'
                    WHEN regexp_matches(lower(question), '{_OPEN}examples?{_SHUT}') THEN 'example'
                    ELSE 'concept' END AS intent
        FROM (SELECT id, conversation_id, {_trim("content")} AS question FROM msg WHERE role = 'user')
        WHERE length(question) > 0""",
    "resolved_question": rf"""
        SELECT id, conversation_id, intent,
               CASE WHEN intent = 'follow_up' AND before IS NOT NULL
                    THEN before || chr(10) || question ELSE question END AS resolved
        FROM (SELECT *, lag(question) OVER (PARTITION BY conversation_id ORDER BY created_at, id) AS before
              FROM (SELECT id, conversation_id, created_at, question,
               CASE WHEN regexp_matches(lower(question), '^(?:and|what about|why|same for){_SHUT}') THEN 'follow_up'
                    WHEN regexp_matches(lower(question), '{_OPEN}(?:response|reject) +codes?{_SHUT}') THEN 'response_code'
                    WHEN regexp_matches(lower(question), '{_OPEN}(?:mti|iso ?8583|fld|de-?[0-9]+|fields? +[0-9]+){_SHUT}') THEN 'message_field'
                    WHEN regexp_matches(lower(question), '{_OPEN}hsm{_SHUT}') THEN 'hsm_command'
                    WHEN regexp_matches(lower(question), '{_OPEN}(?:how|steps?|procedures?){_SHUT}') THEN 'procedure'
                    WHEN regexp_matches(lower(question), '{_OPEN}examples?{_SHUT}') THEN 'example'
                    ELSE 'concept' END AS intent
        FROM (SELECT id, conversation_id, created_at, {_trim("content")} AS question FROM msg WHERE role = 'user')
        WHERE length(question) > 0))""",
    "chat_request_status": """
        SELECT conv_id, agent, title AS question,
               CASE WHEN agent NOT IN ('documentation', 'log') THEN 'agent'
                    WHEN length(title) < 1 THEN 'question' ELSE '' END AS fault,
               CASE WHEN agent NOT IN ('documentation', 'log') OR length(title) < 1 THEN 422 ELSE 200 END AS status
        FROM creation""",
    "question_summary": f"""
        SELECT conv_id, {_item("conv_id", "documentation", "log")} AS agent,
               CASE conv_id % 2 WHEN 1 THEN 'Analyzed the provided trace.'
                    ELSE 'Reviewed the available documentation to answer: "' || text || '".' END AS summary
        FROM conversations WHERE turn = 0""",
    "document_sizes": """
        SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS size FROM documents""",
    "upload_file_errors": """
        SELECT request_id, ordinal, filename,
               CASE WHEN doc_id % 20 = 0 THEN '.'
                    WHEN doc_id % 20 = 1 THEN '.' || filename
                    ELSE '.' || lower(string_split(filename, '.')[-1]) END AS extension, error
        FROM checked""",
    "upload_batch_status": """
        SELECT c.request_id, c.agent, CASE WHEN any_value(f.error) IS NULL THEN 200 ELSE 400 END AS status,
               coalesce(any_value(f.error), 'Files received successfully') AS detail,
               CASE WHEN any_value(f.error) IS NULL THEN count(*) ELSE 0 END AS n_files,
               CAST(CASE WHEN any_value(f.error) IS NULL THEN sum(c.size) ELSE 0 END AS BIGINT) AS total_size
        FROM checked c LEFT JOIN failed f USING (request_id) GROUP BY c.request_id, c.agent""",
    "upload_request_status": """
        SELECT request_id, agent, CASE WHEN agent = 'other' THEN 422 ELSE status END AS status,
               CASE WHEN agent = 'other' THEN 'agent' ELSE detail END AS detail,
               CASE WHEN agent = 'other' OR status = 400 THEN 0 ELSE n_files END AS n_files,
               CAST(CASE WHEN agent = 'other' OR status = 400 THEN 0 ELSE total_size END AS BIGINT) AS total_size
        FROM (SELECT c.request_id, (['documentation', 'log', 'other'])[c.request_id % 3 + 1] AS agent,
                     CASE WHEN any_value(f.error) IS NULL THEN 200 ELSE 400 END AS status,
                     coalesce(any_value(f.error), 'Files received successfully') AS detail,
                     count(*) AS n_files, sum(c.size) AS total_size
              FROM checked c LEFT JOIN failed f USING (request_id) GROUP BY c.request_id)""",
    "upload_manifest": """
        SELECT request_id, agent, 0::BIGINT AS page,
               string_agg(filename || ':' || content_type || ':' || size, '|' ORDER BY ordinal) AS files
        FROM upload WHERE request_id NOT IN (SELECT request_id FROM failed)
        GROUP BY request_id, agent""",
    "attachment_lists": """
        SELECT request_id, 0::BIGINT AS page,
               coalesce(string_agg(CASE WHEN ordinal <> request_id % 3
                                        THEN filename || ':' || size || ':' || content_type END, '|' ORDER BY ordinal), '') AS attachments
        FROM upload WHERE request_id NOT IN (SELECT request_id FROM failed)
        GROUP BY request_id""",
    "upload_size_split": """
        SELECT request_id, ordinal, size,
               CASE WHEN size < 1024 THEN size || ' B'
                    WHEN size < 1048576 THEN ((size * 10 + 512) // 1024) // 10 || '.'
                         || ((size * 10 + 512) // 1024) % 10 || ' KB'
                    ELSE ((size * 100 + 524288) // 1048576) // 100 || '.'
                         || lpad(CAST(((size * 100 + 524288) // 1048576) % 100 AS VARCHAR), 2, '0') || ' MB'
               END AS size_text,
               CASE WHEN size > 20971520 THEN 'rejected' ELSE 'accepted' END AS outcome
        FROM upload""",
    "upload_size_messages": """
        SELECT request_id, 0::BIGINT AS page,
               'The following files exceed 20 MB: ' || string_agg(filename, ', ' ORDER BY ordinal) AS message
        FROM upload WHERE size > 20971520 GROUP BY request_id""",
    "answer_sections": """
        SELECT doc_id, 'summary' AS section, 1 AS step, summary AS line FROM answer WHERE summary <> ''
        UNION ALL
        SELECT doc_id, 'story', generate_subscripts(story, 1), unnest(story) FROM answer
        UNION ALL
        SELECT doc_id, 'issues', 1, title FROM answer
        UNION ALL
        SELECT doc_id, 'references', 1, source || CASE page WHEN '' THEN '' ELSE ' p.' || page END
        FROM answer""",
    "answer_quarantine": """
        SELECT doc_id, '{"summary":' AS malformed FROM documents WHERE doc_id % 50 = 49""",
    "answer_validation": """
        SELECT doc_id, faults, CASE WHEN faults = '' THEN 200 ELSE 422 END AS status
        FROM (SELECT doc_id, CASE WHEN doc_id % 50 = 49 THEN 'body'
                     ELSE concat_ws(',', CASE WHEN text IS NULL THEN 'summary' END,
                                    CASE WHEN doc_id % 4 = 3 THEN 'issues' END,
                                    CASE WHEN source IS NULL THEN 'references' END) END AS faults
              FROM documents)""",
    "answer_variant_paths": """
        SELECT doc_id, coalesce(summary, '') AS summary, coalesce(severity, '') AS severity,
               coalesce(a.source, '') AS source, coalesce(page, '') AS page
        FROM documents LEFT JOIN answer a USING (doc_id)""",
    "answer_issues": """
        SELECT doc_id, 1::BIGINT AS step, CASE severity WHEN 'critical' THEN 'info' ELSE severity END AS severity,
               title, detail FROM answer""",
    "answer_references": """
        SELECT doc_id, 1::BIGINT AS step, source,
               CASE page WHEN '' THEN '' ELSE 'p.' || page END AS page_label FROM answer""",
    "error_messages": """
        SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'd' || event_id
                              WHEN 1 THEN 'm' || event_id WHEN 2 THEN 'm' || event_id
                              ELSE 'An unexpected backend error occurred.' END AS message
        FROM events""",
    "trace_parse": f"""
        SELECT {_text("moment")} AS ts, kind, rrn, card, proc AS processing_code,
               code AS response_code, hsm_code, xid, rc AS hsm_return FROM entry""",
    "trace_transactions": f"""
        SELECT rrn, card, '000000' AS processing_code, {_text("ts")} AS request_ts,
               CASE path WHEN 'lone' THEN '' ELSE {_text("ts + to_milliseconds(lat)")} END AS response_ts,
               code AS response_code,
               CASE path WHEN 'rev' THEN {_text("ts + to_milliseconds(5000)")} ELSE '' END AS reversal_ts,
               rev_code AS reversal_code,
               CASE path WHEN 'lone' THEN '' ELSE CAST(lat AS VARCHAR) END AS latency_ms, status, n_lines
        FROM card""",
    "trace_status_counts": """
        SELECT status, count(*) AS n_transactions, CAST(sum(n_lines) AS BIGINT) AS n_lines
        FROM card GROUP BY status""",
    "trace_summary": """
        SELECT n_entries, n_transactions, n_issues,
               format('Analyzed {:,} log entries in {:,} transactions and found {:,} non-conformities.',
                      n_entries, n_transactions, n_issues) AS summary
        FROM (SELECT (SELECT count(*) FROM entry) AS n_entries,
                     (SELECT count(*) FROM card) AS n_transactions,
                     (SELECT count(*) FROM broken) AS n_issues)""",
    "trace_story": f"""
        SELECT rrn, row_number() OVER (PARTITION BY rrn ORDER BY moment, rank) AS step,
               {_text("moment")} AS ts, function, sentence FROM entry""",
    "hsm_exchanges": f"""
        SELECT rrn, '1' AS xid, 'CA' AS command, {_text("ts + to_milliseconds(2)")} AS command_ts,
               CASE WHEN replied THEN 'CB' ELSE '' END AS reply,
               CASE WHEN replied THEN {_text("ts + to_milliseconds(3)")} ELSE '' END AS reply_ts,
               CASE WHEN replied THEN rc ELSE '' END AS hsm_return
        FROM card WHERE asked""",
    "trace_inconsistencies": "SELECT rrn, xid, rule, severity, title FROM broken",
    "response_code_meaning": """
        SELECT rrn, kind, code AS response_code,
               CASE kind WHEN '0100' THEN 'authorization request'
                         WHEN '0110' THEN 'authorization response'
                         WHEN '0400' THEN 'reversal request' ELSE '' END AS kind_meaning,
               CASE code WHEN '00' THEN 'approved' WHEN '05' THEN 'declined' ELSE '' END AS response_meaning
        FROM entry""",
    "trace_report": """
        SELECT rrn, 1::BIGINT AS first_step, card, status, code AS response_code, n_lines,
               coalesce((SELECT string_agg(rule, ',' ORDER BY rule) FROM broken b WHERE b.rrn = c.rrn), '') AS rules,
               story
        FROM card c JOIN told USING (rrn)""",
    "structured_answer": """
        SELECT rrn AS conversation_id, 1::BIGINT AS first_step, 'log' AS agent,
               'Transaction ' || rrn || ' has status ' || status || ' after ' || n_lines || ' log entries.' AS summary,
               story,
               coalesce(b.issues, '') AS issues, coalesce(b.advice, '') AS recommendations
        FROM card JOIN told USING (rrn)
        LEFT JOIN (SELECT rrn, string_agg(severity || ':' || title, '|' ORDER BY rule) AS issues,
                          string_agg(advice, '|' ORDER BY rule) AS advice
                   FROM broken GROUP BY rrn) b USING (rrn)""",
    "structured_answer_evidence": """
        SELECT c.rrn AS conversation_id, 1::BIGINT AS first_step,
               coalesce(i.issues, '') AS issues, coalesce(s.sources, '') AS sources
        FROM card c
        LEFT JOIN (SELECT rrn, string_agg(title || coalesce(':See document ' || doc_id || ', ' || coalesce(source, '') || '.', ''),
                                          '|' ORDER BY rule) AS issues
                   FROM broken LEFT JOIN rulebest USING (rule) LEFT JOIN documents USING (doc_id)
                   GROUP BY rrn) i USING (rrn)
        LEFT JOIN (SELECT rrn, string_agg(source, '|' ORDER BY first) AS sources
                   FROM (SELECT rrn, coalesce(source, '') AS source, min(rule) AS first
                         FROM broken JOIN rulebest USING (rule) JOIN documents USING (doc_id) GROUP BY 1, 2)
                   GROUP BY rrn) s USING (rrn)""",
    "report_roundtrip": f"""
        SELECT f.format, c.rrn, card, {_text("ts")} AS request_ts, status, n_lines,
               coalesce((SELECT string_agg(rule, ',' ORDER BY rule) FROM broken b WHERE b.rrn = c.rrn), '') AS rules,
               story
        FROM card c JOIN told USING (rrn), (VALUES ('json'), ('txt')) f(format)""",
    "section_topk": """
        SELECT item_id, rank, kind, doc_id, coalesce(source, '') AS source, unit_no, unit
        FROM piecerank JOIN piece USING (unit_key)""",
    "documentation_answer": f"""
        SELECT b.item_id, 'documentation' AS agent, {_intent(_trim("b.text"))} AS intent,
               'Reviewed the available documentation to answer: "' || b.text || '".' AS summary,
               coalesce(t.story, '') AS story, coalesce(s.sources, '') AS sources, coalesce(t.citations, '') AS citations
        FROM benchmark b
        LEFT JOIN (SELECT item_id, string_agg(unit, chr(10) ORDER BY rank) AS story,
                          string_agg(kind || ':' || doc_id || ':' || unit_no, '|' ORDER BY rank) AS citations
                   FROM piecerank JOIN piece USING (unit_key) GROUP BY item_id) t USING (item_id)
        LEFT JOIN (SELECT item_id, string_agg(source, '|' ORDER BY first) AS sources
                   FROM (SELECT item_id, coalesce(source, '') AS source, min(rank) AS first
                         FROM piecerank JOIN piece USING (unit_key) GROUP BY 1, 2)
                   GROUP BY item_id) s USING (item_id)""",
    "content_units": """
        SELECT doc_id, source, unit_no, unit, '' AS lang, 'line' AS part, 'document' AS kind FROM line
        UNION ALL
        SELECT doc_id, source, unit_no, unit, lang, part, 'page' FROM block WHERE length(unit) > 0""",
    "document_sections": rf"""
        SELECT doc_id, source, n - 1 AS section_no,
               CASE WHEN n = 1 THEN '' ELSE {_shown("string_split(part, chr(1))[1]")} END AS title,
               len(string_split(part, chr(1) || 'p' || chr(2))) - 1 AS n_paragraphs,
               len(string_split(part, chr(1) || 'li' || chr(2))) - 1 AS n_items
        FROM (SELECT doc_id, source, unnest(string_split(html, chr(1) || 'h' || chr(2))) AS part,
                     generate_subscripts(string_split(html, chr(1) || 'h' || chr(2)), 1) AS n FROM marked)""",
    "document_facts": r"""
        SELECT doc_id, source, kind, unnest(found) AS value, generate_subscripts(found, 1) AS fact_no
        FROM (SELECT doc_id, source, 'number' AS kind,
                     regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)?') AS found FROM documents
              UNION ALL
              SELECT doc_id, source, 'email',
                     regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') FROM documents
              UNION ALL
              SELECT doc_id, source, 'url',
                     regexp_extract_all(text, 'https?://[^ \t\r\n<>"]+') FROM documents)""",
    "function_catalog": f"""
        SELECT key, count(*) AS n_units, count(DISTINCT doc_id) AS n_documents,
               min(doc_id) AS first_doc_id,
               arg_min(unit_no, (doc_id, unit_no)) AS first_unit_no
        FROM (SELECT doc_id, unit_no, {_words("unit")}[1] AS key FROM line)
        WHERE key IS NOT NULL GROUP BY key""",
    "lexical_topk": "SELECT item_id, doc_id, rank FROM lexrank",
    "vector_topk": "SELECT item_id, vec_id, rank FROM vecrank",
    "vector_widths": """
        SELECT coalesce(len(e.embedding), -1) AS width, count(*) AS n_passages,
               count(*) FILTER (WHERE e.vec_id IN (SELECT item_id FROM benchmark)) AS n_questions
        FROM embeddings e GROUP BY 1""",
    "evidence_fusion": """
        SELECT item_id, doc_id, lexical_rank, vector_rank, rank, coalesce(source, '') AS source
        FROM (
            SELECT item_id, doc_id, coalesce(CAST(l AS VARCHAR), '') AS lexical_rank,
                   coalesce(CAST(v AS VARCHAR), '') AS vector_rank,
                   row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
            FROM (
                SELECT item_id, doc_id, max(l) AS l, max(v) AS v,
                       round(coalesce(1.0::DOUBLE / (60 + max(l)), 0)
                             + coalesce(1.0::DOUBLE / (60 + max(v)), 0), 9) AS score
                FROM (SELECT item_id, doc_id, rank AS l, NULL AS v FROM lexrank
                      UNION ALL SELECT item_id, vec_id, NULL, rank FROM vecrank)
                GROUP BY item_id, doc_id)
        ) LEFT JOIN documents USING (doc_id) WHERE rank <= 10""",
    "anomaly_evidence": """
        SELECT rrn, xid, rule, coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id, coalesce(source, '') AS source
        FROM broken LEFT JOIN rulebest USING (rule) LEFT JOIN documents USING (doc_id)""",
    "stream_message_append": f"""
        SELECT id, conversation_id, role, content, {_text("created_at")} AS created_at
        FROM posted WHERE status = 201""",
    "stream_conversation_touch": f"""
        SELECT h.id, {_text("h.created_at")} AS created_at,
               {_text("coalesce(max(p.created_at), any_value(h.updated_at))")} AS updated_at
        FROM head h LEFT JOIN posted p ON p.conversation_id = h.id AND p.status = 201
        GROUP BY h.id, h.created_at""",
    "stream_trace_pairing": f"""
        SELECT rrn, {_text("ts")} AS request_ts,
               CASE path WHEN 'rev' THEN {_text("ts + to_milliseconds(5000)")} ELSE '' END AS reversal_ts,
               CASE path WHEN 'rev' THEN 'stream' ELSE 'none' END AS found
        FROM card""",
}


def _named(sql: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"\b(?:FROM|JOIN|,)\s+{v}\b", sql)]


def statements() -> dict[str, str]:
    """Each query with the views that it needs, in order of definition."""
    complete = {}
    for name, sql in QUERIES.items():
        needed, pending = set(), _named(sql)
        while pending:
            view = pending.pop()
            if view not in needed:
                needed.add(view)
                pending += _named(VIEWS[view])
        parts = [f"{v} AS ({VIEWS[v]})" for v in VIEWS if v in needed]
        prefix = f"WITH {', '.join(parts)} " if parts else ""
        complete[name] = prefix + sql.strip()
    return complete
