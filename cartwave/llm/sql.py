"""Check SQL of the operators, and of the pipeline's stages, that SQL can express."""

from __future__ import annotations

from cartwave.llm import decontaminate as d

OP4 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
q AS (SELECT *, octet_length(payload) AS size, max(page_id) OVER (PARTITION BY payload) AS first FROM p),
r AS (SELECT *, size >= 1000 AND first IS NOT NULL AND page_id IS DISTINCT FROM first AS again FROM q)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to
FROM r
"""

# over all turns of a conversation in the order of the operator
OP6 = r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), e AS (
    SELECT *, length(role) + length(text) + 16 AS marks,
           length(text) - length(replace(text, '\', '')) AS slashes,
           length(text) - length(regexp_replace(text, '<(/?turn)', '\1', 'g')) AS controls
    FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), ''))
           AS loss_sha256,
       CAST(sum(marks + slashes + controls) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

OP12 = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
    SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units,
           [CAST('0x' || substr(h, 1, 8) AS BIGINT), CAST('0x' || substr(h, 9, 8) AS BIGINT)] AS cuts,
           CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 100 OR text = '' OR contains(text, '<P>') OR contains(text, '<S>')
               OR contains(text, '<M>') AS plain,
           CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 50 AS spm
    FROM d
), c AS (
    SELECT *, least(cuts[1] % (len(units) + 1), cuts[2] % (len(units) + 1)) AS a, greatest(cuts[1] % (len(units) + 1), cuts[2] % (len(units) + 1)) AS b
    FROM u
), p AS (
    SELECT *, array_to_string(list_slice(units, 1, a), '') AS prefix, array_to_string(list_slice(units, a + 1, b), '') AS middle,
           array_to_string(list_slice(units, b + 1, len(units)), '') AS suffix
    FROM c
)
SELECT doc_id, CAST(len(units) AS BIGINT) AS n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
       CASE WHEN NOT plain THEN length(prefix) END AS prefix_chars, CASE WHEN NOT plain THEN length(middle) END AS middle_chars,
       sha256(CASE WHEN plain THEN text WHEN spm THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
                   ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

OP13 = r"""
WITH d AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
           min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
    FROM documents
), l AS (
    SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), f AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, {
        'A': len(words) < 200,
        'B': 100 * len(list_distinct(words)) < 50 * len(words),
        'C': 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text),
        'D': regexp_matches(text, '[#$%&*|]'),
        'E': coalesce(d.doc_id > least, false)
    } AS x
    FROM d LEFT JOIN l ON d.doc_id = l.doc_id
), g AS (
    SELECT part, good, toxic, (CASE WHEN x.A THEN 'A' ELSE '' END || CASE WHEN x.B THEN 'B' ELSE '' END || CASE WHEN x.C THEN 'C' ELSE '' END
           || CASE WHEN x.D THEN 'D' ELSE '' END || CASE WHEN x.E THEN 'E' ELSE '' END) AS failed, count(*) AS n
    FROM f GROUP BY ALL
), k AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k), o AS (
    SELECT a.k || b.k || c.k || d.k || e.k AS filter_order FROM k a, k b, k c, k d, k e
    WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5
), s AS (
    SELECT filter_order, step, filter_order[step] AS own, substr(filter_order, 1, step - 1) AS earlier
    FROM o, (SELECT unnest(range(1, 6)) AS step)
), t AS (
    SELECT part, filter_order, step, own, n, good, toxic, contains(failed, own) AS fails, failed = own AS only_this,
           regexp_matches(failed, '[' || earlier || '-]') AS gone
    FROM g, s
), r AS (
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, own,
           sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS redundant, sum(CASE WHEN only_this THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN NOT gone AND fails AND good THEN n ELSE 0 END) AS good_lost,
           sum(CASE WHEN NOT gone AND fails AND toxic THEN n ELSE 0 END) AS toxic_lost
    FROM t GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
"""


def _marked() -> str:
    signs = d._NUMBER + d._NAME + d._UNIT
    out = f"translate(coalesce(text, ''), '{signs}', '   ')"
    for _, pattern, new in d.STEPS:
        for i in range(1, 5):
            new = new.replace(f"${i}", f"\\{i}")
        out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
    return f"lower({out})"


_SLOT = f"[{d._NUMBER}{d._NAME}{d._UNIT}]"
_PLAIN = f"regexp_replace(m, '({d._NUMBER})[0-9.,]*[0-9]|([{d._NAME}{d._UNIT}])\\p{{L}}+', '\\1\\2', 'g')"


def _windows(key: str, rows: str) -> str:
    """(key, n windows, place, template words, words) of each window."""
    return f"""
    SELECT {key}, n, pos, list_slice(tokens, pos, pos + {d.WINDOW - 1}) AS template, list_slice(words, pos, pos + {d.WINDOW - 1}) AS words
    FROM (
        SELECT {key}, tokens, words, greatest(1, len(tokens) - {d.WINDOW - 1}) AS n, unnest(range(1, greatest(1, len(tokens) - {d.WINDOW - 1}) + 1)) AS pos
        FROM (SELECT {key}, regexp_extract_all({_PLAIN}, '{_SLOT}|\\p{{L}}+|\\p{{N}}+') AS tokens, regexp_extract_all(m, '{d.TOKEN}') AS words
              FROM ({rows}))
        WHERE len(tokens) > 0
    )"""


OP3 = f"""
WITH item AS ({_windows("item_id, m", f"SELECT DISTINCT item_id, {_marked()} AS m FROM benchmark")}),
doc AS ({_windows("doc_id, text", f"SELECT DISTINCT doc_id, coalesce(text, '') AS text, {_marked()} AS m FROM documents")}),
hit AS (
    SELECT doc_id, text, item_id, m, i.n, i.pos AS item_at, doc.pos - i.pos AS shift, i.words AS theirs, doc.words AS mine,
           i.words = doc.words AS same
    FROM doc JOIN item i ON doc.template = i.template
    WHERE i.words = doc.words OR len(list_filter(i.words, lambda w: NOT regexp_matches(w, '^{_SLOT}'))) >= {d.WORDS}
), slot AS (
    SELECT doc_id, text, item_id, m, shift, theirs[k] AS their_word, mine[k] AS my_word
    FROM (SELECT *, unnest(range(1, len(theirs) + 1)) AS k FROM hit) WHERE regexp_matches(theirs[k], '^{_SLOT}')
), broken AS (
    SELECT DISTINCT doc_id, text, item_id, m, shift
    FROM slot GROUP BY doc_id, text, item_id, m, shift, their_word HAVING count(DISTINCT my_word) > 1
), kept AS (
    SELECT * FROM hit h WHERE NOT EXISTS (
        SELECT 1 FROM broken b WHERE b.doc_id IS NOT DISTINCT FROM h.doc_id AND b.text = h.text
            AND b.item_id IS NOT DISTINCT FROM h.item_id AND b.m = h.m AND b.shift = h.shift)
)
SELECT doc_id, item_id, count(DISTINCT item_at) AS hits, n AS windows, CASE WHEN bool_and(same_any) THEN 'copy' ELSE 'template' END AS kind
FROM (SELECT *, bool_and(same) OVER (PARTITION BY doc_id, text, item_id, m, item_at) AS same_any FROM kept)
GROUP BY doc_id, text, item_id, m, n HAVING count(DISTINCT item_at) >= n * {d.COVERAGE}
"""
