"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

ORACLES = {
    "op1_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce("text", '')) AS size,
                   regexp_replace(coalesce("text", ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
            FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY norm ORDER BY size DESC, doc_id)""",
    "op10_chat_formatting": r"""
        WITH m AS (
            SELECT conv_id, turn, role, row_number() OVER (
                       PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(coalesce("text", ''))) - 1 AS position,
                   list_transform(string_split(regexp_replace(coalesce("text", ''), '\r\n?', chr(10), 'g'), chr(10)), lambda x: {
                       'level': length(regexp_replace(regexp_extract(x, '^[ \t]*(>[ \t]*)+'), '[^>]', '', 'g')),
                       'content': regexp_replace(x, '^[ \t]*(>[ \t]*)+', '')}) AS lines
            FROM conversations),
        b AS (
            SELECT *, regexp_replace(array_to_string(list_transform(
                          list_filter(lines, lambda x: x.level = 0), lambda x: x.content), chr(10)),
                      '\A[ \t\n]+|[ \t\n]+\z', '', 'g') AS body,
                   list_filter(range(1, len(lines) + 1), lambda i: lines[i].level > 0
                       AND (i = 1 OR lines[greatest(i - 1, 1)].level <> lines[i].level)) AS firsts,
                   list_filter(range(1, len(lines) + 1), lambda i: lines[i].level > 0
                       AND (i = len(lines) OR lines[least(i + 1, len(lines))].level <> lines[i].level)) AS lasts
            FROM m),
        p AS (
            SELECT conv_id, position, unnest(range(1, len(firsts) + 1)) AS passage, firsts, lasts, lines FROM b),
        t AS (
            SELECT conv_id, position, passage, lines[firsts[passage]].level AS level, array_to_string(list_transform(
                       lines[firsts[passage]:lasts[passage]], lambda x: x.content), chr(10)) AS body
            FROM p),
        every AS (
            SELECT conv_id, position, 0 AS passage, 0 AS level, body FROM b UNION ALL
            SELECT conv_id, position, passage, level, body FROM t),
        units AS (
            SELECT DISTINCT conv_id, position, passage, level, trim(lower(regexp_replace(u, '[ \t\n]+', ' ', 'g'))) AS unit
            FROM (SELECT *, unnest([body] || regexp_split_to_array(body, '\n[ \t]*\n') || string_split(body, chr(10))) AS u FROM every)),
        origin AS (
            SELECT conv_id, md5(unit) AS hash, min(position) AS original FROM units
            WHERE level = 0 AND unit <> '' GROUP BY ALL),
        met AS (
            SELECT q.conv_id, q.position, passage, level, original, sum(length(unit)) AS size
            FROM units q JOIN origin o ON q.conv_id IS NOT DISTINCT FROM o.conv_id AND md5(unit) = hash
            WHERE level > 0 AND original < q.position GROUP BY ALL),
        linked AS (
            SELECT conv_id, position, passage, level, max({'size': size, 'original': original}) AS best FROM met GROUP BY ALL),
        replies AS (
            SELECT conv_id, position, count(*) AS n_linked, max(best) FILTER (level = 1) AS best FROM linked GROUP BY ALL)
        SELECT b.conv_id, turn, role, b.position,
               coalesce(best.original, CASE WHEN b.position > 0 THEN b.position - 1 END) AS reply_to,
               CAST(len(firsts) AS BIGINT) AS n_quotes, coalesce(n_linked, 0) AS n_linked, body,
               '<|im_start|>' || regexp_replace(coalesce(role, ''), '<(\\*)\|(im_start|im_end)\|>', '<\1\\|\2|>', 'g') || chr(10) ||
                   regexp_replace(body, '<(\\*)\|(im_start|im_end)\|>', '<\1\\|\2|>', 'g') || '<|im_end|>' || chr(10) AS chat
        FROM b LEFT JOIN replies r ON b.conv_id IS NOT DISTINCT FROM r.conv_id AND b.position = r.position""",
    "op11_collocations": r"""
        WITH d AS (
            SELECT coalesce(lang, 'und') AS lang,
                   translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS shown
            FROM documents),
        pieces AS (SELECT lang, unnest(regexp_split_to_array(shown, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
        occurrences AS (
            SELECT lang, k AS size, unnest(list_transform(range(1, len(words) - k + 2),
                   lambda i: array_to_string(words[i:i + k - 1], ' '))) AS phrase
            FROM w, (VALUES (1), (2), (3)) s(k) WHERE len(words) >= k),
        f AS (SELECT lang, size, phrase, CAST(count(*) AS HUGEINT) AS f FROM occurrences GROUP BY ALL),
        n AS (SELECT lang, sum(f) AS n FROM f WHERE size = 1 GROUP BY lang),
        c AS (SELECT lang, size, phrase, f, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10),
        inner_ AS (
            SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, f FROM c WHERE size = 3),
        longest AS (SELECT lang, phrase, max(f) AS f FROM inner_ GROUP BY ALL),
        left_ AS (
            SELECT c.* FROM c LEFT JOIN longest t USING (lang, phrase) WHERE t.f IS NULL OR 100 * t.f < 50 * c.f),
        cut AS (
            SELECT lang, phrase, f AS a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
            FROM left_, (VALUES (1), (2)) s(k) WHERE k < size),
        scored AS (
            SELECT cut.lang, cut.phrase, a, k, x.f AS l, y.f AS r, (1000000 * a * a) // (x.f * y.f) AS score
            FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = head JOIN f y ON y.lang = cut.lang AND y.phrase = tail),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM best)
        SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
               CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
        FROM ranked JOIN n USING (lang) WHERE rank <= 2000""",
    "op12_fill_middle": r"""
        WITH d AS (
            SELECT doc_id, coalesce("text", '') AS shown, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hash,
                   regexp_extract_all(coalesce("text", ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
            FROM documents),
        h AS (
            SELECT *, len(units) AS n, CAST('0x' || hash[1:8] AS BIGINT) AS h1, CAST('0x' || hash[9:16] AS BIGINT) AS h2,
                   CAST('0x' || hash[17:24] AS BIGINT) AS h3, CAST('0x' || hash[25:32] AS BIGINT) AS h4
            FROM d),
        p AS (
            SELECT *, array_to_string(units[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS prefix,
                   array_to_string(units[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS middle,
                   array_to_string(units[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS suffix,
                   CASE WHEN shown = '' OR regexp_matches(shown, '<[PSM]>') OR h3 % 100 >= 50 THEN 'plain'
                        WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
            FROM h)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN shown WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(shown) AS restored_sha256
        FROM p""",
    "op13_fingerprints": r"""
        WITH d AS (
            SELECT doc_id, coalesce("text", '') AS own, coalesce(lead("text") OVER w, first_value("text") OVER w, '') AS following
            FROM documents WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
        e AS (SELECT *, own[:length(own) - length(own) // 2] || following[:length(own) // 2] AS changed FROM d),
        texts AS (
            SELECT doc_id, 'own' AS kind, own AS shown FROM e UNION ALL SELECT doc_id, 'changed', changed FROM e
            UNION ALL SELECT doc_id, 'following', following FROM e),
        lines AS (
            SELECT DISTINCT doc_id, kind, trim(line) AS line
            FROM (SELECT doc_id, kind, unnest(regexp_split_to_array(shown, '[\n\r]+')) AS line FROM texts) WHERE trim(line) <> ''),
        digests AS (SELECT doc_id, kind, CAST('0x' || md5(line)[1:15] AS BIGINT) AS x FROM lines),
        checked AS (SELECT *, CAST('0x' || md5(CAST(x AS VARCHAR))[1:15] AS BIGINT) AS c FROM digests),
        cells AS (
            SELECT doc_id, kind, k * 16 + ((x >> (4 * k)) & 15) AS cell, count(*) AS n, bit_xor(x) AS x, bit_xor(c) AS c
            FROM checked, (VALUES (0), (1), (2)) s(k) GROUP BY ALL),
        every AS (
            SELECT doc_id, kind, cell FROM (SELECT doc_id, kind FROM texts), (SELECT unnest(range(48)) AS cell)),
        prints AS (
            SELECT doc_id, kind, string_agg(CASE WHEN n IS NULL THEN '' ELSE
                       lower(to_hex(n) || '.' || to_hex(x) || '.' || to_hex(c)) END, ' ' ORDER BY cell) AS print
            FROM every LEFT JOIN cells USING (doc_id, kind, cell) GROUP BY ALL),
        sizes AS (SELECT doc_id, kind, count(*) AS n FROM digests GROUP BY ALL),
        common AS (
            SELECT doc_id, b.kind, count(*) AS n FROM digests a JOIN digests b USING (doc_id, x)
            WHERE a.kind = 'own' AND b.kind <> 'own' GROUP BY ALL),
        near AS (
            SELECT t.doc_id, t.kind, CASE WHEN coalesce(a.n, 0) + coalesce(b.n, 0) = 0 THEN 1.0 ELSE
                       CAST(coalesce(m.n, 0) AS DOUBLE) / (coalesce(a.n, 0) + coalesce(b.n, 0) - coalesce(m.n, 0)) END AS near
            FROM texts t LEFT JOIN sizes a ON a.doc_id = t.doc_id AND a.kind = 'own'
            LEFT JOIN sizes b ON b.doc_id = t.doc_id AND b.kind = t.kind
            LEFT JOIN common m ON m.doc_id = t.doc_id AND m.kind = t.kind)
        SELECT e.doc_id, length(own) AS n_chars, sha256(changed) AS edited_sha256, p.print AS fingerprint,
               q.print AS edited_fingerprint, x.near AS near_edited, y.near AS near_next
        FROM e JOIN prints p ON p.doc_id = e.doc_id AND p.kind = 'own' JOIN prints q ON q.doc_id = e.doc_id AND q.kind = 'changed'
        JOIN near x ON x.doc_id = e.doc_id AND x.kind = 'changed' JOIN near y ON y.doc_id = e.doc_id AND y.kind = 'following'""",
}
