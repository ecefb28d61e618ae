"""DuckDB SQL of the queries that SQL can express."""

# The template's lengths: <turn>, a line feed after the role, </turn> and a line feed.
PREFIX_TARGETS = r"""
WITH said AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), written AS (
    SELECT *, 15 + length(regexp_replace(replace(replace(role, '&', '&a'), chr(10), '&n'), '<(\\*)(/?turn)', '<\\\1\2', 'g'))
        + length(regexp_replace(text, '<(\\*)(/?turn)', '<\\\1\2', 'g')) AS chars
    FROM said
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
        count(*) OVER (PARTITION BY conv_id) AS turns,
        sum(chars) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS upto
    FROM written
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(upto) FILTER (role = 'assistant' OR place = turns) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""

# Lines end after a line feed; a hex group is read as a number.
INFILLING = r"""
WITH drawn AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex FROM documents
), cut AS (
    SELECT doc_id, text, CASE WHEN text = '' THEN [] ELSE regexp_extract_all(text, '[^\n]*\n|[^\n]+') END AS units,
        text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') AS plain,
        [CAST('0x' || substr(hex, 8 * k + 1, 8) AS BIGINT) for k in range(4)] AS h
    FROM drawn
), placed AS (
    SELECT *, len(units) AS n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS a,
        greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS b
    FROM cut
), parts AS (
    SELECT doc_id, text, n, CASE WHEN plain OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
        array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix
    FROM placed
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form != 'plain' THEN length(prefix) END AS prefix_chars,
    CASE WHEN form != 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM parts
"""

# CRC-32 is linear: the register after a byte follows from a table of 256, and after n more
# bytes it is the exclusive or of what each of its bits becomes. Words are folded byte by
# byte once each, runs are joined from them.
IMPORTANCE = r"""
WITH RECURSIVE bits(b, step, x) AS (
    SELECT b, 0, b FROM range(256) t(b)
    UNION ALL SELECT b, step + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END FROM bits WHERE step < 8
), steps AS (
    SELECT list(x ORDER BY b) AS tab FROM bits WHERE step = 8
), texts AS (
    SELECT 'corpus' AS side, row_number() OVER () AS row, doc_id, text FROM documents
    UNION ALL SELECT 'target', row_number() OVER (), NULL, text FROM benchmark
), said AS (
    SELECT side, row, doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') END AS words
    FROM texts
), runs AS (
    SELECT side, row, unnest(list_concat(words, [words[i] || ' ' || words[i + 1] for i in range(1, len(words))],
        [words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] for i in range(1, len(words) - 1)])) AS run
    FROM said
), kinds AS (
    SELECT run, count(*) FILTER (side = 'corpus') AS s, count(*) FILTER (side = 'target') AS t FROM runs GROUP BY run
), spelt AS (
    SELECT run, s, t, hex(encode(run)) AS digits FROM kinds
), hashed AS (
    SELECT run, s, t, xor(list_reduce([CAST('0x' || substr(digits, 2 * i + 1, 2) AS BIGINT) for i in range(len(digits) // 2)],
        lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) % 10000 AS bucket
    FROM spelt, steps
), buckets AS (
    SELECT bucket, sum(s) AS s, sum(t) AS t FROM hashed GROUP BY bucket
), totals AS (
    SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM buckets
), gains AS (
    SELECT run, CAST(floor(1000 * ln((CAST(b.t AS DOUBLE) + 1) * (CAST(s_all AS DOUBLE) + 10000)
        / ((CAST(b.s AS DOUBLE) + 1) * (CAST(t_all AS DOUBLE) + 10000)))) AS BIGINT) AS gain
    FROM hashed JOIN buckets b USING (bucket), totals
), weighed AS (
    SELECT row, count(*) AS n_features, sum(gain) AS weight FROM runs JOIN gains USING (run) WHERE side = 'corpus' GROUP BY row
), scored AS (
    SELECT doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
        CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
    FROM said LEFT JOIN weighed USING (row) WHERE side = 'corpus'
), summed AS (
    SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM scored
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS eligible FROM summed
)
SELECT doc_id, n_words, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * eligible // 100 THEN place END AS rank FROM ranked
"""
