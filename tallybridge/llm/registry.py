"""The queries of this folder, and their DuckDB statements where SQL can express them."""

from __future__ import annotations

from .chat_format import op5_chat_format
from .conversation_repair import op11_conversation_repair
from .embedding_dedup import op2_embedding_near_dedup
from .language_id import op8_language_id
from .license_scan import op6_license_scan
from .lm_score import op4_lm_score
from .mixing import op3_mixing
from .order_minhash import op10_order_minhash
from .packing import op1_best_fit_packing
from .simhash import op7_simhash_near_dedup
from .token_alignment import op13_token_alignment
from .token_counts import op9_token_counts
from .token_files import op12_token_files

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_mixing": op3_mixing,
    "op4_lm_score": op4_lm_score,
    "op5_chat_format": op5_chat_format,
    "op6_license_scan": op6_license_scan,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_language_id": op8_language_id,
    "op9_token_counts": op9_token_counts,
    "op10_order_minhash": op10_order_minhash,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_token_files": op12_token_files,
    "op13_token_alignment": op13_token_alignment,
}



def _repair_sql() -> str:
    """The parse as a fold over rows: a list of the four places that initials can lead to (start, s, u, a), each with its cost in nine digits and then its audit, so that texts
    compare as (cost, audit). Three steps for each row: insertions up to u, those up to a, the row's own edits."""
    more = lambda x, cost, edit: f"(CASE WHEN {x} = '~' THEN '~' ELSE lpad(((substr({x}, 1, 9))::BIGINT + {cost})::VARCHAR, 9, '0') || substr({x}, 10) || '{edit}' END)"
    late = "(CASE WHEN upper(e[1]) = e[1] THEN 1 ELSE 0 END)"
    keep = lambda x, initial: f"(CASE WHEN lower(e[1]) = '{initial}' THEN {more(x, f'0 + {late}', 'K')} ELSE '~' END)"
    anew = lambda x: f"(CASE WHEN e[1] = 'd' THEN '~' ELSE {more(x, f'2 + {late}', 'R')} END)"
    gone = lambda k: more(f"v[{k}]", 3, "D")
    to_u = f"[v[1], v[2], least(v[3], {more('v[1]', 2, 'I')}, {more('v[2]', 2, 'I')}, {more('v[4]', 2, 'I')}), v[4]]"
    to_a = f"[v[1], v[2], v[3], least(v[4], {more('v[3]', 2, 'I')})]"
    u = ", ".join(f"{f('v[' + str(k) + ']', *a)}" for k in (1, 2, 4) for f, a in ((keep, ("u",)), (anew, ())))
    row = f"[{gone(1)}, least({gone(2)}, {keep('v[1]', 's')}), least({gone(3)}, {u}), least({gone(4)}, {keep('v[3]', 'a')}, {anew('v[3]')})]"
    step = f"CASE e[1] WHEN '#' THEN {to_u} WHEN '$' THEN {to_a} ELSE {row} END"
    bits = "flatten(list_transform(range(length(k)), lambda i: [ord(k[i + 1])::BIGINT, -1, -1, -1, -1, -1, -1, -1]))"
    taken = lambda x: f"(CASE WHEN b < 0 THEN {x} ELSE xor({x}, b) END)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda c, b: xor({taken('c')} >> 1, ({taken('c')} & 1) * 3988292384)), 4294967295)"
    given = "(CASE WHEN t[1] = 'u' THEN 'assistant' ELSE 'user' END)"  # t: the place, the row, the lines
    at = lambda x: f"{x}[t[2]::BIGINT]"
    said = f"(CASE e[1] WHEN 'I' THEN {given} || ':' WHEN 'R' THEN {given} || ':' || {at('texts')} ELSE {at('roles')} || ':' || {at('texts')} END)"
    place = f"(CASE WHEN e[1] = 'K' THEN {at('roles')}[1] ELSE {given}[1] END)"
    line = f"CASE WHEN e[1] = 'D' THEN [t[1], (t[2]::BIGINT + 1)::VARCHAR, t[3]] ELSE [{place}, (t[2]::BIGINT + CASE WHEN e[1] = 'I' THEN 0 ELSE 1 END)::VARCHAR, t[3] || CASE WHEN t[1] = '' THEN '' ELSE chr(10) END || {said}] END"
    return f"""
        WITH keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
        hit AS (SELECT conv_id, turn, role, text, {crc} % 20 AS kind FROM keyed),
        own AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM hit WHERE kind <> 0),
        ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again FROM own),
        judged AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN again THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\\z') THEN 't' ELSE '' END AS fault, lag(role) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM ordered),
        coded AS (SELECT *, CASE WHEN fault IN ('b', 'd') THEN 'd' WHEN fault = 't' THEN upper(initial) ELSE initial END AS code FROM (SELECT *, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'x' END AS initial FROM judged)),
        listed AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
            count(*) FILTER (n > 1 AND before[1] || role[1] NOT IN ('su', 'ua', 'au')) AS illegal, list(code ORDER BY n) AS codes, list(role ORDER BY n) AS roles, list(text ORDER BY n) AS texts FROM coded GROUP BY conv_id),
        parsed AS (SELECT *, list_reduce(list_prepend(['000000000', '~', '~', '~'], flatten(list_transform(list_append(codes, ''), lambda c: CASE WHEN c = '' THEN [['#'], ['$']] ELSE [['#'], ['$'], [c]] END))), lambda v, e: {step}) AS v FROM listed),
        ended AS (SELECT *, (substr(least(v[1], v[4]), 1, 9))::BIGINT AS cost, substr(least(v[1], v[4]), 10) AS audit FROM parsed),
        replayed AS (SELECT *, list_reduce(list_prepend(['', '1', ''], list_transform(range(length(audit)), lambda i: [audit[i + 1]])), lambda t, e: {line})[3] AS lines FROM ended)
        SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN replayed ON c.conv_id IS NOT DISTINCT FROM replayed.conv_id"""


ORACLE_SQL: dict[str, str] = {
    "op11_conversation_repair": _repair_sql(),
    "op2_embedding_near_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
        ok AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        links AS MATERIALIZED (SELECT p.vec_id AS a, q.vec_id AS b FROM ok p JOIN ok q ON p.vec_id <> q.vec_id AND len(p.e) = len(q.e) WHERE list_cosine_similarity(p.e, q.e) >= 0.95),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
        component AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1), degree AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN component USING (vec_id) LEFT JOIN degree USING (vec_id)""",
    "op5_chat_format": """
        WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '<||') AS text, coalesce(floor(turn / 256), -1)::BIGINT AS block FROM conversations),
        people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
        headed AS (SELECT t.*, perspective, CASE WHEN speaker = 'system' THEN '<|system|>' || chr(10) WHEN speaker = perspective THEN '<|assistant|>' || chr(10)
            ELSE '<|user name=' || replace(replace(replace(replace(replace(speaker, '%', '%25'), '<', '%3C'), '|', '%7C'), '>', '%3E'), chr(10), '%0A') || '|>' || chr(10) END AS head FROM t JOIN people ON t.conv_id IS NOT DISTINCT FROM people.conv_id),
        said AS (SELECT *, head || text || '<|end|>' || chr(10) AS piece FROM headed),
        placed AS (SELECT *, sum(length(piece)) OVER (PARTITION BY conv_id, perspective, block ORDER BY turn NULLS FIRST, speaker, text ROWS UNBOUNDED PRECEDING) AS stop FROM said),
        blocks AS (SELECT conv_id, perspective, block, count(*) AS n_turns, string_agg(piece, '' ORDER BY turn NULLS FIRST, speaker, text) AS rendered, coalesce(sum(stop - (stop - length(piece) + length(head))) FILTER (speaker = perspective), 0)::BIGINT AS n_masked,
            coalesce(string_agg((stop - length(piece) + length(head))::BIGINT || '-' || stop::BIGINT, ',' ORDER BY turn NULLS FIRST, speaker, text) FILTER (speaker = perspective), '') AS mask FROM placed GROUP BY ALL)
        SELECT conv_id, perspective, block, coalesce(sum(n_turns) OVER w, 0)::BIGINT AS first_turn, n_turns, coalesce(sum(length(rendered)) OVER w, 0)::BIGINT AS start, length(rendered)::BIGINT AS n_chars, sha256(rendered) AS rendered_sha256, mask, n_masked
        FROM blocks WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
}
