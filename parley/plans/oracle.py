"""The registered queries again, in plain SQL over the test tables.

``VIEWS`` are building blocks; ``sql`` puts the ones a statement uses in front of it.
They share no code with the Spark side, so agreement is evidence.
"""

from __future__ import annotations

import re

T0 = "TIMESTAMP '2024-01-01 00:00:00'"
NOW = "TIMESTAMP '2024-06-01 12:00:00'"

# ECMAScript white space, as a regular-expression class and as characters to trim.
WS = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_CODES = [9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
_CHARS = "||".join(f"chr({c})" for c in _CODES)
DOT = r"[^\n\r\x{2028}\x{2029}]"
LISTED = rf"\A(?:[0-9]+\.|[-*]){WS}+({DOT}*)\z"

# The wording of prompts, file errors and status rows, here and in the views
# below; stated again so that the SQL stands alone.
SYSTEM = (
    "You are a friendly and helpful study buddy who helps students learn and understand complex topics. "
    "Provide clear, concise, and encouraging responses."
)


def trim(c: str) -> str:
    return f"trim({c}, {_CHARS})"


def stamp(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def or_else(*options: str) -> str:
    *head, last = options
    return "COALESCE(" + ", ".join([f"NULLIF({h}, '')" for h in head] + [last]) + ")"


def title(base: str) -> str:
    return f"substring({base}, 1, 50) || CASE WHEN length({base}) > 50 THEN '...' ELSE '' END"


VIEWS = {
    "v_messages": f"""
        SELECT conv_id * 1000 + turn AS id, conv_id AS session_id, conv_id % 10 AS user_id, role,
               text AS content, {T0} + to_minutes(conv_id * 60 + turn) AS created_at
        FROM conversations""",
    "v_sessions": f"""
        SELECT DISTINCT conv_id AS id, conv_id % 10 AS user_id,
               CASE WHEN conv_id % 11 = 0 THEN NULL WHEN conv_id % 7 = 0 THEN '' ELSE 'New Chat' END AS title,
               {T0} + to_hours(conv_id) AS created_at, {T0} + to_hours(conv_id) AS updated_at
        FROM conversations""",
    "v_incoming": """
        SELECT id, CASE WHEN id % 1000 = 4 THEN session_id + 1000000 ELSE session_id END AS session_id,
               CASE id % 1000 WHEN 3 THEN user_id + 1 WHEN 6 THEN NULL ELSE user_id END AS user_id,
               CASE WHEN session_id % 3 = 0 THEN '' ELSE 'user' || user_id || '@example.com' END AS email,
               role, CASE WHEN id % 1000 = 5 THEN '' ELSE content END AS content, created_at
        FROM v_messages""",
    "v_status": """
        SELECT m.*, CASE WHEN m.user_id IS NULL THEN 401
                         WHEN m.session_id IS NULL OR COALESCE(m.role, '') = '' OR COALESCE(m.content, '') = '' THEN 400
                         WHEN s.id IS NULL THEN 404
                         WHEN m.role NOT IN ('user', 'assistant') THEN 500
                         ELSE 200 END AS status
        FROM v_incoming m LEFT JOIN v_sessions s ON s.id = m.session_id AND s.user_id = m.user_id""",
    "v_title_changes": """
        SELECT id, CASE WHEN id % 4 = 3 THEN user_id + 1 ELSE user_id END AS user_id,
               CASE id % 4 WHEN 1 THEN COALESCE(NULLIF(title, ''), 'Untitled chat') WHEN 2 THEN '   '
                           WHEN 3 THEN 'Wrong ' || id ELSE ' Chat ' || id END AS title
        FROM v_sessions""",
    "v_title_edits": """
        SELECT id, user_id, title, 1 AS seq FROM v_title_changes
        UNION ALL SELECT id, user_id, 'Again ' || id, 2 FROM v_title_changes WHERE id % 5 = 0""",
    "v_session_requests": """
        SELECT id AS request_id, CASE WHEN id % 8 = 7 THEN NULL ELSE user_id END AS user_id,
               's' || id % 10 || '@example.com' AS email, title, CASE WHEN id % 3 = 0 THEN NULL ELSE id END AS update_id
        FROM v_title_changes""",
    "v_session_delete_keys": """
        SELECT CASE WHEN id % 5 IN (2, 4) THEN id + 1000000 ELSE id END AS id,
               CASE WHEN id % 5 IN (1, 3) THEN user_id + 1 ELSE user_id END AS user_id
        FROM v_sessions""",
    "v_replies": r"""
        SELECT id, replace(content, chr(10), CASE WHEN session_id % 2 = 0 THEN chr(10) || '* '
                                                  ELSE chr(10) || '1. **x** ' END) AS content
        FROM v_messages""",
    "v_profiles": f"""
        SELECT c_custkey AS id, replace(lower(c_name), '#', '') || '@example.com' AS email,
               CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment END AS first_name,
               CAST(NULL AS VARCHAR) AS last_name, CAST(c_custkey % 60 AS INTEGER) AS age,
               CAST(NULL AS VARCHAR) AS gender, CAST(NULL AS VARCHAR) AS grade_year,
               {T0} AS created_at, {T0} AS updated_at
        FROM customer""",
    "v_signups": """
        SELECT c_custkey AS id, replace(lower(c_name), '#', '') || '@example.com' AS email,
               '{"first_name":"' || c_mktsegment || '","last_name":"'
               || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'Name ' || c_custkey END || '"'
               || CASE c_custkey % 7 WHEN 0 THEN ',"age":"' || c_custkey % 60 || '"' WHEN 1 THEN ',"age":""'
                    WHEN 2 THEN '' WHEN 3 THEN ',"age":"12abc"' WHEN 4 THEN ',"age":"-5"'
                    WHEN 5 THEN ',"age":"99999999999"' ELSE ',"age":' || c_custkey % 60 END
               || CASE c_custkey % 5 WHEN 0 THEN ',"gender":null' WHEN 1 THEN '' ELSE ',"gender":"other"' END
               || ',"grade_year":"' || (c_custkey % 12 + 1) || '"}' AS user_metadata
        FROM customer""",
    "v_profile_changes": """
        SELECT CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_custkey % 7 = 6 THEN o_custkey + 1000000 ELSE o_custkey END AS id,
               CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'o' || o_orderkey || '@example.com' END AS email,
               o_orderkey AS seq,
               CASE o_orderkey % 10 WHEN 0 THEN 'upsert' WHEN 1 THEN 'upsert' WHEN 2 THEN 'delete' ELSE 'update' END AS op
        FROM orders""",
    "v_profile_delete_keys": """
        SELECT CASE WHEN c_custkey % 10 IN (1, 2) THEN c_custkey ELSE c_custkey + 1000000 END AS id FROM customer""",
    "v_dirty_profiles": """
        SELECT * EXCLUDE (copy) REPLACE (CASE id % 50 WHEN 10 THEN 'customer000000000@example.com' WHEN 20 THEN NULL
                                                      ELSE email END AS email)
        FROM (SELECT *, unnest(CASE WHEN id % 50 = 30 THEN [1, 2] ELSE [1] END) AS copy FROM v_profiles)""",
    "v_dirty_sessions": """
        SELECT * REPLACE (CASE id % 9 WHEN 0 THEN NULL WHEN 1 THEN user_id + 5000000 ELSE user_id END AS user_id,
                          CASE WHEN id % 13 = 0 THEN NULL ELSE created_at END AS created_at)
        FROM v_sessions""",
    "v_dirty_messages": """
        SELECT id, CASE WHEN id % 1000 = 7 THEN session_id + 9000000 ELSE session_id END AS session_id,
               CASE WHEN id % 1000 = 2 AND session_id % 4 = 0 THEN user_id + 5000000 ELSE user_id END AS user_id,
               role, CASE WHEN id % 17 = 0 THEN NULL ELSE content END AS content, created_at
        FROM v_messages""",
    "v_files": """
        SELECT doc_id // 8 AS batch_id, doc_id % 8 AS pos,
               'doc' || doc_id || (['.txt', '.MD', '.csv', '.json', '.js', '.ts', '.py', '.java', '.html', '.css', '.pdf',
                                   '.docx', '.png', '.JPG', '.jpeg', '.webp', '.gif', '.bmp', '.zip'])[doc_id % 19 + 1] AS name,
               CASE doc_id % 13 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'application/pdf'
                    WHEN 2 THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
                    WHEN 3 THEN 'image/tiff' WHEN 4 THEN NULL ELSE '' END AS mime, n_chars * 4096 AS size,
               CASE WHEN doc_id % 17 = 0 THEN ' ' || chr(9) || chr(10) || ' ' ELSE text END AS text,
               (doc_id // 8) % 3 AS pending, doc_id % 23 = 5 AS failed,
               CASE WHEN doc_id % 4 = 1 THEN '' ELSE 'data:image/jpeg;base64,' || doc_id END AS data_url
        FROM documents""",
    "v_examined": f"""
        SELECT *, CASE kind WHEN 'too_large' THEN 'file is too large (max 8MB).'
                            WHEN 'unsupported' THEN 'unsupported file type.'
                            ELSE CASE WHEN failed THEN 'unreadable file or processing failed.'
                                      WHEN kind = 'image' THEN NULL WHEN content <> '' THEN NULL
                                      WHEN kind = 'text' THEN 'text file appears empty or unreadable.'
                                      ELSE 'could not extract readable text from ' || upper(kind) || '.' END END AS fault
        FROM (SELECT *, substring({trim('text')}, 1, 8000) AS content,
                     CASE WHEN size > 8388608 THEN 'too_large'
                          WHEN mime LIKE 'text/%' OR regexp_matches(lower(name), '\\.(txt|md|csv|json|js|ts|py|java|html|css)$') THEN 'text'
                          WHEN mime = 'application/pdf' OR lower(name) LIKE '%.pdf' THEN 'pdf'
                          WHEN mime LIKE '%wordprocessingml.document' OR lower(name) LIKE '%.docx' THEN 'docx'
                          WHEN mime LIKE 'image/%' OR regexp_matches(lower(name), '\\.(png|jpe?g|webp|gif|bmp)$') THEN 'image'
                          ELSE 'unsupported' END AS kind,
                     row_number() OVER (PARTITION BY batch_id ORDER BY pos) AS slot
              FROM v_files)
        WHERE slot <= greatest(0, 6 - pending)""",
    "v_errors": """
        SELECT batch_id, pos, CASE WHEN kind IN ('too_large', 'unsupported') THEN kind WHEN failed THEN 'failed'
                                   WHEN kind = 'text' THEN 'empty_text' WHEN kind = 'pdf' THEN 'empty_pdf' ELSE 'empty_docx' END AS code,
               name || ': ' || fault AS message
        FROM v_examined WHERE fault IS NOT NULL
        UNION ALL
        SELECT batch_id, -1, 'over_cap', 'Only 6 attachments are allowed.'
        FROM v_files GROUP BY batch_id HAVING count(*) > greatest(0, 6 - max(pending))""",
    "v_attachments": """
        SELECT doc_id // 6 AS session_id, doc_id AS pos,
               CASE WHEN img THEN 'image' ELSE 'text' END AS type,
               CASE WHEN doc_id % 9 = 0 THEN NULL ELSE 'doc' || doc_id END AS name,
               CASE WHEN img THEN NULL WHEN doc_id % 17 = 0 THEN '' ELSE text END AS content,
               CASE WHEN NOT img THEN NULL WHEN doc_id % 4 = 1 THEN '' ELSE 'data:image/jpeg;base64,' || doc_id END AS dataUrl
        FROM (SELECT *, (doc_id // 6) % 2 = 0 AND doc_id % 7 = 5 AS img FROM documents)""",
    "v_first_turns": """
        SELECT session_id, min(id) AS id FROM v_messages WHERE role = 'user' GROUP BY session_id""",
    "v_request_files": """
        SELECT f.id AS request_id, a.* EXCLUDE (session_id) FROM v_first_turns f JOIN v_attachments a USING (session_id)""",
    "v_first_names": "SELECT request_id, arg_min(COALESCE(name, ''), pos) AS name FROM v_request_files GROUP BY request_id",
    "v_file_counts": "SELECT request_id, count(*) AS n FROM v_request_files GROUP BY request_id",
    "v_drafts": """
        SELECT m.id, m.session_id, m.user_id, m.created_at,
               CASE WHEN (m.session_id + m.id % 1000) % 6 = 5 THEN ' ' || chr(9) || ' ' ELSE m.content END AS text,
               COALESCE(c.n, 0) AS n_files
        FROM v_messages m LEFT JOIN v_file_counts c ON c.request_id = m.id WHERE m.role = 'user'""",
    "v_outgoing": f"""
        SELECT id, session_id, created_at, text, n_files,
               {or_else(trim('text'), "'Please analyze the attached file(s) and summarize the key points clearly.'")} AS message,
               {or_else(trim('text'), "'[Sent ' || n_files || ' attachment(s)] Please analyze the attached files.'")} AS shown
        FROM v_drafts WHERE {trim('text')} <> '' OR n_files > 0""",
    "v_references": f"""
        SELECT request_id, count(*) AS n_texts,
               string_agg('(' || k || ') ' || {or_else('name', "'Attachment'")} || ':' || chr(10) || substring(content, 1, 8000),
                          chr(10) || chr(10) ORDER BY k) AS block
        FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY pos) AS k
              FROM v_request_files WHERE type = 'text' AND content <> '')
        GROUP BY request_id""",
    "v_images": f"""
        SELECT request_id, count(*) AS n_images, string_agg({or_else('name', "'image'")}, ', ' ORDER BY pos) AS names,
               string_agg(dataUrl, ' ' ORDER BY pos) AS urls
        FROM v_request_files WHERE type = 'image' AND dataUrl <> '' GROUP BY request_id""",
    "v_requests": """
        SELECT o.id AS request_id, o.session_id, o.created_at,
               o.message || CASE WHEN r.n_texts > 0 THEN chr(10) || chr(10) || 'Attached references:' || chr(10) || r.block
                                 ELSE '' END AS user_text,
               COALESCE(i.n_images, 0) AS n_images, COALESCE(i.names, '') AS names, COALESCE(i.urls, '') AS urls
        FROM v_outgoing o LEFT JOIN v_references r ON r.request_id = o.id LEFT JOIN v_images i ON i.request_id = o.id""",
    "v_assistant": """
        SELECT id - 1 AS request_id, session_id AS conv, content FROM v_messages WHERE role = 'assistant'""",
    "v_responses": """
        SELECT request_id, 'primary' AS attempt,
               CASE WHEN conv % 6 IN (0, 1) THEN CASE WHEN conv % 12 = 0 THEN '{"error":{}}'
                                                      ELSE '{"error":{"message":"model overloaded"}}' END
                    WHEN conv % 10 = 2 THEN '{"choices":[{"message":{"content":""}}]}'
                    WHEN conv % 15 = 14 THEN '<html>bad gateway</html>'
                    ELSE CAST(json_object('choices', json_array(json_object('message', json_object('content', content))))
                              AS VARCHAR) END AS body
        FROM v_assistant
        UNION ALL
        SELECT request_id, 'fallback', body
        FROM (SELECT request_id,
                     CASE WHEN conv % 18 = 0 THEN '{"error":{"message":"still down"}}'
                          WHEN conv % 6 = 0 THEN CAST(json_object('choices', json_array(json_object('message',
                               json_object('content', ' Fallback: ' || content)))) AS VARCHAR) END AS body
              FROM v_assistant)
        WHERE body IS NOT NULL""",
    "v_read": f"""
        SELECT request_id, attempt,
               CASE WHEN j IS NULL THEN 'unreadable' WHEN json_extract(j, '$.error') IS NOT NULL THEN 'error' ELSE 'ok' END AS state,
               CASE WHEN j IS NULL THEN 'Internal server error'
                    WHEN json_extract(j, '$.error') IS NOT NULL
                    THEN {or_else("json_extract_string(j, '$.error.message')", "'API Error'")}
                    ELSE {or_else(trim("json_extract_string(j, '$.choices[0].message.content')"), "'No response received'")} END AS text
        FROM (SELECT request_id, attempt, CASE WHEN json_valid(body) THEN body END AS j FROM v_responses)""",
    "v_outcomes": """
        SELECT request_id,
               CASE WHEN again AND f_state IS NULL THEN 'fallback'
                    WHEN again THEN CASE WHEN f_state = 'ok' THEN 'answer' ELSE 'error' END
                    WHEN p_state IS NULL THEN 'pending'
                    WHEN p_state = 'ok' THEN 'answer' ELSE 'error' END AS outcome,
               CASE WHEN again THEN f_text ELSE p_text END AS text
        FROM (SELECT r.request_id, p.state AS p_state, p.text AS p_text, f.state AS f_state, f.text AS f_text,
                     r.n_images > 0 AND COALESCE(p.state, '') = 'error' AS again
              FROM v_requests r
              LEFT JOIN v_read p ON p.request_id = r.request_id AND p.attempt = 'primary'
              LEFT JOIN v_read f ON f.request_id = r.request_id AND f.attempt = 'fallback')""",
    "v_lines": rf"""
        SELECT message_id, line_no, line, regexp_matches(line, '{LISTED}') AS is_list,
               CASE WHEN regexp_matches(line, '{LISTED}') THEN regexp_extract(line, '{LISTED}', 1) ELSE line END AS item
        FROM (SELECT message_id, line_no, {trim('raw')} AS line
              FROM (SELECT id AS message_id, unnest(lines) AS raw, generate_subscripts(lines, 1) AS line_no
                    FROM (SELECT id, string_split({trim(
                        rf"regexp_replace(regexp_replace(regexp_replace(replace(content, chr(13)||chr(10), chr(10)), "
                        rf"'{WS}+([0-9]+\.{WS}+\*\*)', chr(10) || '\1', 'g'), "
                        rf"'{WS}+\*{WS}+', chr(10) || '- ', 'g'), "
                        rf"'\n{{3,}}', chr(10) || chr(10), 'g')")}, chr(10)) AS lines
                          FROM v_replies)))
        WHERE line <> ''""",
    "v_items": """
        SELECT message_id, block_no, CASE WHEN is_list THEN 'list' ELSE 'paragraph' END AS kind,
               row_number() OVER (PARTITION BY message_id, block_no ORDER BY line_no) - 1 AS item_no, item AS text
        FROM (SELECT *, sum(opens) OVER (PARTITION BY message_id ORDER BY line_no) - 1 AS block_no
              FROM (SELECT *, CASE WHEN is_list AND lag(is_list) OVER (PARTITION BY message_id ORDER BY line_no)
                                   THEN 0 ELSE 1 END AS opens FROM v_lines))""",
    "v_events": """
        SELECT event_id, user_id, epoch_us(ts) AS us, ts, event_type = 'signup' AS force,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
        FROM events""",
    "v_constraints": """
        SELECT 'profiles' AS "table", 'not_null:email' AS constraint_name, CAST(id AS VARCHAR) AS key, 'is null' AS detail
        FROM v_dirty_profiles WHERE email IS NULL
        UNION ALL SELECT 'chat_sessions', 'not_null:user_id', CAST(id AS VARCHAR), 'is null' FROM v_dirty_sessions WHERE user_id IS NULL
        UNION ALL SELECT 'chat_sessions', 'not_null:created_at', CAST(id AS VARCHAR), 'is null' FROM v_dirty_sessions WHERE created_at IS NULL
        UNION ALL SELECT 'chat_messages', 'not_null:content', CAST(id AS VARCHAR), 'is null' FROM v_dirty_messages WHERE content IS NULL
        UNION ALL SELECT 'profiles', 'unique:id', CAST(id AS VARCHAR), CAST(count(*) AS VARCHAR) FROM v_dirty_profiles GROUP BY id HAVING count(*) > 1
        UNION ALL SELECT 'profiles', 'unique:email', email, CAST(count(*) AS VARCHAR) FROM v_dirty_profiles WHERE email IS NOT NULL GROUP BY email HAVING count(*) > 1
        UNION ALL SELECT 'chat_sessions', 'unique:id', CAST(id AS VARCHAR), CAST(count(*) AS VARCHAR) FROM v_dirty_sessions GROUP BY id HAVING count(*) > 1
        UNION ALL SELECT 'chat_messages', 'unique:id', CAST(id AS VARCHAR), CAST(count(*) AS VARCHAR) FROM v_dirty_messages GROUP BY id HAVING count(*) > 1
        UNION ALL SELECT 'chat_sessions', 'foreign_key:user_id->profiles', CAST(user_id AS VARCHAR), CAST(count(*) AS VARCHAR)
        FROM v_dirty_sessions WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT id FROM v_profiles) GROUP BY user_id
        UNION ALL SELECT 'chat_messages', 'foreign_key:user_id->profiles', CAST(user_id AS VARCHAR), CAST(count(*) AS VARCHAR)
        FROM v_dirty_messages WHERE user_id NOT IN (SELECT id FROM v_profiles) GROUP BY user_id
        UNION ALL SELECT 'chat_messages', 'foreign_key:session_id->chat_sessions', CAST(session_id AS VARCHAR), CAST(count(*) AS VARCHAR)
        FROM v_dirty_messages WHERE session_id NOT IN (SELECT id FROM v_sessions) GROUP BY session_id
        UNION ALL SELECT 'chat_messages', 'check:role', CAST(id AS VARCHAR), role FROM v_dirty_messages WHERE role NOT IN ('user', 'assistant')""",
}


def sql(statement: str) -> str:
    """The statement with the views it uses, directly or through other views."""
    needed: list[str] = []

    def add(text: str) -> None:
        for name in re.findall(r"\bv_[a-z_]+\b", text):
            if name in VIEWS and name not in needed:
                add(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    add(statement)
    if not needed:
        return statement
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in needed) + "\n" + statement
