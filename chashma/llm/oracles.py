"""The same results in SQL, where SQL can express them over whole tables."""

from __future__ import annotations

from chashma.llm import leaks, lookalikes

#: Lists of words as TESTDATA.md defines a word; then one row for each ten words in a row.
_WORDS = "regexp_extract_all(regexp_replace(lower({0}), '[''`´‘’ʻʼ]', '', 'g'), '[\\p{{L}}\\p{{N}}]+')"
_GRAMS = """(SELECT id, array_to_string(w[i : i + 9], ' ') AS gram FROM (SELECT id, w, unnest(range(1, len(w) - 8)) AS i FROM (SELECT {id} AS id, {words} AS w FROM {table}) WHERE len(w) >= 10))"""
_PAIRS = f"""SELECT DISTINCT d.id AS doc_id, e.id AS item_id FROM {_GRAMS.format(id="doc_id", words=_WORDS.format("text"), table="documents")} d
    JOIN {_GRAMS.format(id="item_id", words=_WORDS.format("text"), table="eval_items")} e ON d.gram = e.gram"""

_ELIGIBLE = """SELECT source_record_id AS id, min(part_number) AS part FROM validation_documents
    WHERE source_record_id IS NOT NULL AND part_number IS NOT NULL AND part_allocated_documents >= 1 AND sampling_weight > 0 AND isfinite(sampling_weight) GROUP BY 1"""
_SHORT = f"""WITH e AS ({_ELIGIBLE}), n AS (SELECT floor(count(*) / 3)::BIGINT AS n FROM e), c AS (SELECT part, count(*) AS available FROM e GROUP BY 1)
    SELECT t.part_number, t.target_permille, t.min_documents, n.n, coalesce(c.available, 0) AS available,
        greatest(t.min_documents, (t.target_permille * n.n + 999) // 1000) AS wanted, (t.target_permille * n.n) // 1000 AS base, (t.target_permille * n.n) % 1000 AS rest
    FROM sampling_targets t CROSS JOIN n LEFT JOIN c ON c.part = t.part_number"""
#: What is lacking is handed out in rounds: each round gives every category with room its share of targets of what is left, up to its room.
_QUOTAS = f"""WITH RECURSIVE s AS ({_SHORT}),
    i AS (SELECT *, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, part_number) <= sum(rest) OVER () // 1000 THEN 1 ELSE 0 END AS ideal FROM s),
    f AS (SELECT *, least(available, greatest(ideal, min_documents))::BIGINT AS q FROM i),
    g AS (SELECT *, (n - sum(q) OVER ())::BIGINT AS gap, CASE WHEN target_permille > 0 THEN available - q ELSE 0 END AS room FROM f),
    r AS (SELECT 0 AS round, part_number, target_permille AS w, room, 0.0::DOUBLE AS has, greatest(gap, 0)::DOUBLE AS pot FROM g
        UNION ALL SELECT round + 1, part_number, w, room, least(room, has + gift), pot - sum(least(room, has + gift) - has) OVER ()
        FROM (SELECT *, CASE WHEN room - has > 1e-9 THEN pot * w / sum(CASE WHEN room - has > 1e-9 THEN w ELSE 0 END) OVER () ELSE 0 END AS gift FROM r WHERE round < 60)),
    t AS (SELECT part_number, room, CASE WHEN abs(has - round(has)) < 1e-6 THEN round(has) ELSE has END AS has FROM r WHERE round = 60),
    u AS (SELECT part_number, floor(has)::BIGINT AS low, has - floor(has) AS spare, sum(has) OVER () AS all_given FROM t),
    v AS (SELECT part_number, low + CASE WHEN spare > 0 AND row_number() OVER (ORDER BY round(spare, 9) DESC, part_number) <= round(all_given - sum(low) OVER ()) THEN 1 ELSE 0 END AS taken FROM u),
    b AS (SELECT *, greatest(0, q - least(min_documents, available)) AS above FROM g),
    a AS (SELECT *, sum(above) OVER () AS all_above, least(-gap, sum(above) OVER ()) AS back FROM b),
    m AS (SELECT *, CASE WHEN back > 0 THEN (above * back) // all_above ELSE 0 END AS low, CASE WHEN back > 0 THEN (above * back) % all_above ELSE 0 END AS spare FROM a),
    x AS (SELECT *, low + CASE WHEN row_number() OVER (ORDER BY spare DESC, part_number) <= back - sum(low) OVER () AND above > low THEN 1 ELSE 0 END AS given FROM m),
    y AS (SELECT x.*, (CASE WHEN gap >= 0 THEN q + taken ELSE q - given END)::BIGINT AS quota FROM x JOIN v USING (part_number))
    SELECT part_number, target_permille::BIGINT AS permille, min_documents::BIGINT AS floor, n, available, ideal::BIGINT AS ideal, wanted::BIGINT AS wanted, quota, least(quota, available) AS drawn,
        greatest(0, wanted - quota)::BIGINT AS missing, available - quota AS "left", greatest(0, wanted - available)::BIGINT AS shortfall FROM y"""
_KEYED = f"""SELECT id, part, ('0x' || substr(md5('42|' || id), 1, 15))::BIGINT AS sample_key FROM ({_ELIGIBLE})"""

_REDUCED = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_CLASSES = f"""WITH r AS (SELECT 'seen_texts' AS table_name, text_id AS key, text_value AS text, max(occurrence_count) AS o FROM seen_texts WHERE text_value IS NOT NULL GROUP BY ALL
        UNION ALL SELECT 'duplicate_index', first_source_record_id, digest, max(occurrence_count) FROM duplicate_index WHERE digest IS NOT NULL GROUP BY ALL),
    p AS (SELECT *, {_REDUCED.format("text")} AS w, [x for x in string_split_regex(text, '[;|\\n\\r\\x0B\\x0C\\x{{85}}\\x{{2028}}\\x{{2029}}]') if regexp_matches(x, '[^\\s\\pZ]')] AS parts FROM r),
    c AS (SELECT table_name, key, o, w, CASE WHEN len(parts) > 1 AND len([x for x in parts if regexp_matches(x, '(?s)^[\\s\\pZ]*[^:\\s\\pZ][^:]*:.*[^\\s\\pZ]')]) = len(parts)
        THEN list_sort([{_REDUCED.format("x[1 : instr(x, ':')]")} || ':' || {_REDUCED.format("x[instr(x, ':') + 1 :]")} for x in parts]) END AS t FROM p),
    a AS (SELECT *, min(key) OVER (PARTITION BY table_name, w) AS k1 FROM c),
    b AS (SELECT *, CASE WHEN t IS NULL THEN k1 ELSE min(k1) OVER (PARTITION BY table_name, t) END AS k2 FROM a),
    z AS (SELECT *, min(k2) OVER (PARTITION BY table_name, w) AS k3 FROM b)"""

#: All pairs that share a word, so it is slow on large tables; it shows what the blocks must not lose.
_SIMILAR = f"""WITH r AS (SELECT DISTINCT 'seen_texts' AS table_name, text_id AS key, text_value AS text FROM seen_texts UNION SELECT DISTINCT 'duplicate_index', first_source_record_id, text_preview FROM duplicate_index),
    w AS (SELECT table_name, key, list_distinct({_WORDS.format("text")}) AS words FROM r WHERE text IS NOT NULL),
    l AS (SELECT * FROM w WHERE len(words) >= 15),
    u AS (SELECT table_name, key, len(words) AS n, unnest(words) AS word FROM l),
    p AS (SELECT a.table_name, a.key AS key_a, b.key AS key_b, count(*) AS shared, any_value(a.n + b.n) AS n FROM u a JOIN u b ON a.table_name = b.table_name AND a.word = b.word AND a.key < b.key GROUP BY 1, 2, 3)
    SELECT table_name, key_a, key_b FROM p WHERE shared * 4 >= 3 * (n - shared)"""

#: Classes of pairs: each round a row takes the smallest key it is linked to.
_GROUPS = f"""WITH RECURSIVE p AS MATERIALIZED (SELECT * FROM ({_SIMILAR})), e AS MATERIALIZED (SELECT table_name, key_a AS a, key_b AS b FROM p UNION ALL SELECT table_name, key_b, key_a FROM p),
    r AS (SELECT DISTINCT table_name, a AS key, a AS low FROM e UNION SELECT e.table_name, e.b, r.low FROM r JOIN e ON e.table_name = r.table_name AND e.a = r.key WHERE r.low < e.b),
    g AS (SELECT table_name, key, min(low) AS group_key FROM r GROUP BY 1, 2),
    c AS (SELECT DISTINCT table_name, key, md5(array_to_string(list_sort(list_distinct({_WORDS.format("text")})), ' ')) AS class FROM (SELECT 'seen_texts' AS table_name, text_id AS key, text_value AS text FROM seen_texts UNION SELECT 'duplicate_index', first_source_record_id, text_preview FROM duplicate_index) WHERE text IS NOT NULL),
    d AS (SELECT e.table_name, e.a AS key, count(DISTINCT y.class) FILTER (WHERE x.class != y.class) AS links FROM e JOIN c x ON x.table_name = e.table_name AND x.key = e.a JOIN c y ON y.table_name = e.table_name AND y.key = e.b GROUP BY 1, 2)
    SELECT g.table_name, g.key, g.group_key, count(*) OVER (PARTITION BY g.table_name, g.group_key) AS group_rows, d.links FROM g JOIN d ON d.table_name = g.table_name AND d.key = g.key"""

#: The form itself is SQL, so it is the same here; what is checked is everything around it.
_LOOKS = """(SELECT 'routing_signal_audit' AS table_name, sample_id AS key, sentence_text AS text, NULL::VARCHAR AS stored_sha256 FROM routing_signal_audit
    UNION ALL SELECT 'validation_documents', document_sample_id, normalized_text, normalized_text_sha256 FROM validation_documents UNION ALL SELECT 'seen_texts', text_id::VARCHAR, text_value, NULL FROM seen_texts)"""
_LOOKING = f"(SELECT DISTINCT table_name, key, text, skeleton FROM {lookalikes.forms_of(_LOOKS)} WHERE text IS NOT NULL AND key IS NOT NULL)"
_SEVERAL = f"(SELECT table_name, skeleton FROM {_LOOKING} GROUP BY 1, 2 HAVING count(DISTINCT text) > 1)"

#: Runs of equal words along each diagonal: places less their number along the diagonal are equal within a run.
_RUNS = f"""(WITH d AS (SELECT doc_id AS id, {_WORDS.format("text")} AS w FROM documents), e AS (SELECT item_id AS id, {_WORDS.format("text")} AS w FROM eval_items), p AS ({_PAIRS}),
    x AS (SELECT id, unnest(w) AS word, unnest(range(len(w))) AS place FROM d WHERE id IN (SELECT doc_id FROM p)), y AS (SELECT id, unnest(w) AS word, unnest(range(len(w))) AS place FROM e),
    m AS (SELECT p.doc_id, p.item_id, x.place - y.place AS diagonal, x.place FROM p JOIN x ON x.id = p.doc_id JOIN y ON y.id = p.item_id AND y.word = x.word),
    r AS (SELECT *, place - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY place) AS run FROM m)
    SELECT doc_id, item_id, max(n) AS longest_run FROM (SELECT doc_id, item_id, diagonal, run, count(*) AS n FROM r GROUP BY ALL) GROUP BY 1, 2)"""

#: All stretches of ten and more words from an equal to an equal word with three quarters equal: of each diagonal the one with the largest sum, the last, the longest. The longest run is that of all diagonals on which a mask fits.
_OVERLAPS = f"""WITH x AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS dp FROM (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents)), y AS (SELECT item_id, unnest(w) AS word, unnest(range(len(w))) AS ip FROM (SELECT item_id, {_WORDS.format("text")} AS w FROM eval_items)),
    m AS (SELECT doc_id, item_id, dp - ip AS diagonal, ip FROM x JOIN y USING (word)), g AS (SELECT *, row_number() OVER w AS k FROM m WINDOW w AS (PARTITION BY doc_id, item_id, diagonal ORDER BY ip) QUALIFY count(*) OVER (PARTITION BY doc_id, item_id, diagonal) >= 8),
    s AS (SELECT a.doc_id, a.item_id, a.diagonal, a.ip AS a, b.ip AS b, b.k - a.k + 1 AS n FROM g a JOIN g b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND a.diagonal = b.diagonal AND b.ip >= a.ip + 9 WHERE 4 * (b.k - a.k + 1) >= 3 * (b.ip - a.ip + 1)),
    t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY 4 * n - 3 * (b - a + 1) DESC, b DESC, a) = 1), o AS (SELECT doc_id, item_id, max({{'w': b - a + 1, 'n': n, 'd': a + diagonal, 'i': a}}) AS z FROM t GROUP BY 1, 2),
    h AS (SELECT doc_id, item_id, diagonal, list(ip) AS p FROM m GROUP BY 1, 2, 3 HAVING count(*) >= 6 AND (doc_id, item_id) IN (SELECT (doc_id, item_id) FROM o)), d AS (SELECT doc_id, item_id, diagonal FROM h WHERE len([a for a in p if {" OR ".join(f"list_has_all(p, [{', '.join(f'a + {i}' for i in mask)}])" for mask in leaks.MASKS)}]) > 0),
    v AS (SELECT *, ip - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY ip) AS part FROM m SEMI JOIN d USING (doc_id, item_id, diagonal)),
    r AS (SELECT doc_id, item_id, max(c) AS longest_run FROM (SELECT doc_id, item_id, diagonal, part, count(*) AS c FROM v GROUP BY ALL) GROUP BY 1, 2)
    SELECT o.doc_id, o.item_id, r.longest_run::INT AS longest_run, z.w::INT AS overlap_words, z.n::INT AS matched_words, z.d::INT AS doc_word, z.i::INT AS item_word FROM o JOIN r ON r.doc_id = o.doc_id AND r.item_id = o.item_id"""

_BLANK = r"[\t-\r\x1C-\x1F\x{85}\p{Z}]"
_tokens = lambda text: f"regexp_extract_all({text}, '[^{_BLANK[1:-1]}]+')"
_ENDING = ".!?…。！？।؟．»\"”"
#: The counts behind the shares; what is learnt (how likely letters are, and so the kind) is left out.
_MEASURES = rf"""WITH r AS (SELECT DISTINCT sample_id, nfc_normalize(sentence_text) AS t FROM routing_signal_audit WHERE sample_id IS NOT NULL AND sentence_text IS NOT NULL), k AS (SELECT list(DISTINCT lower(word)) AS known FROM common_words WHERE word IS NOT NULL),
    w AS (SELECT sample_id, t, length(t) AS chars, {_tokens('t')} AS tok, [lower(x) for x in regexp_extract_all(t, '[\p{{L}}\p{{M}}\p{{N}}''`´‘’ʻʼ]+')] AS words, [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^{_BLANK[1:-1]}]')] AS lines, known FROM r, k),
    c AS (SELECT *, len(tok) AS tokens, coalesce(list_sum([length(x) for x in tok]), 0) AS solid, len(words) AS n, len(lines) AS l, [regexp_replace(x, '{_BLANK}+$', '') for x in lines] AS ends, [{_tokens('x')}[1] for x in lines] AS heads, len(regexp_extract_all(t, '\pL')) AS letters FROM w),
    m AS (SELECT sample_id, chars, n, letters, coalesce(list_sum([length(x) for x in words]), 0) AS word_chars, solid, tokens, l, len(regexp_extract_all(t, '\p{{Nd}}')) AS digits, len(regexp_extract_all(t, '\p{{Lu}}')) AS capitals,
        len(regexp_extract_all(t, '[^\p{{L}}\p{{M}}\p{{N}}{_BLANK[1:-1]}.,:;!?…''"`´‘’ʻʼ«»“”„()\-–—。，！？：；、।؟،]')) AS symbols, len([x for x in words if list_contains(known, x)]) AS common, len([i for i in range(2, n + 1) if words[i] = words[i - 1]]) AS repeated,
        len([x for x in ends if contains('{_ENDING}', right(x, 1)) OR contains('{_ENDING}', coalesce(nullif(right(regexp_replace(x, '[»"”’'')\]）］]+$', ''), 1), ''), '~'))]) AS ended, len([x for x in heads if regexp_matches(x, '^(\(?[0-9]{{1,3}}[.)]|\(?[a-zа-я]\)|[•*▪◦‣·\-–—])$')]) AS bullets,
        len([x for x in tok if regexp_matches(x, '^[+\-]?\p{{Nd}}[\p{{Nd}}.,]*%?[;,.]?$') AND NOT regexp_matches(x, '^\(?\p{{Nd}}{{1,3}}[.)]$')]) AS numbers, len(regexp_extract_all(array_to_string(words, ' '), '[a-zß-ɏ]')) AS latin, len(regexp_extract_all(array_to_string(words, ' '), '[Ѐ-ԯ]')) AS cyrillic FROM c)
    SELECT sample_id, chars::BIGINT AS char_count, n::BIGINT AS word_count, letters::BIGINT AS letter_count, {", ".join(f"round(CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0 END, 6) AS {name}" for name, a, b in (
        ("mean_word_length", "word_chars", "n"), ("symbol_ratio", "symbols", "solid"), ("digit_ratio", "digits", "solid"), ("uppercase_ratio", "capitals", "letters"), ("ended_line_ratio", "ended", "l"), ("common_word_ratio", "common", "n"), ("repeated_word_ratio", "repeated", "n"),
        ("bullet_line_ratio", "bullets", "l"), ("number_token_ratio", "numbers", "tokens"), ("latin_ratio", "latin", "letters"), ("cyrillic_ratio", "cyrillic", "letters")))} FROM m"""

SQL = {
    "p4_measures": _MEASURES,
    "p3_groups": _GROUPS,
    "p7_found": f"SELECT DISTINCT a.table_name, a.key AS key_a, b.key AS key_b FROM {_LOOKING} a JOIN {_LOOKING} b ON a.table_name = b.table_name AND a.skeleton = b.skeleton AND a.key < b.key AND a.text != b.text",
    "p7_classes": f"""SELECT table_name, key, class_key, class_rows, class_texts FROM (SELECT DISTINCT table_name, skeleton, key FROM {_LOOKING}) l
        JOIN (SELECT table_name, skeleton, min(key) AS class_key, count(DISTINCT key) AS class_rows, count(DISTINCT text) AS class_texts FROM {_LOOKING} WHERE (table_name, skeleton) IN (SELECT (table_name, skeleton) FROM {_SEVERAL}) GROUP BY 1, 2) c USING (table_name, skeleton)""",
    "p7_forms": f"SELECT DISTINCT table_name, key, form, sha256(form) AS form_sha256, stored_sha256, sha256(skeleton) AS look_sha256, form != text AS changed FROM (SELECT DISTINCT table_name, key, text, stored_sha256, form, skeleton FROM {lookalikes.forms_of(_LOOKS)})",
    "p9_leaked_items": f"SELECT i.item_id, i.split, i.task, count(*) AS documents, max(longest_run)::INT AS longest_run FROM eval_items i JOIN {_RUNS} r ON r.item_id = i.item_id GROUP BY 1, 2, 3",
    "p3_found": _SIMILAR,
    "p2_found": f"{_CLASSES} SELECT table_name, k3 AS key_a, key AS key_b FROM z WHERE k3 != key",
    "p2_records": f"{_CLASSES} SELECT table_name, k3 AS key, count(*) AS records, sum(coalesce(o, 0))::BIGINT AS occurrence_count FROM z GROUP BY 1, 2",
    "p1_found": f"SELECT part_number FROM ({_SHORT}) WHERE available < wanted",
    "p1_quotas": _QUOTAS,
    "p1_sample": f"""SELECT id AS source_record_id, part AS part_number, sample_key
        FROM (SELECT k.*, row_number() OVER (PARTITION BY part ORDER BY sample_key, id) AS place, q.quota FROM ({_KEYED}) k JOIN ({_QUOTAS}) q ON k.part = q.part_number) WHERE place <= quota""",
    "p9_found": _PAIRS,
    "p9_overlaps": _OVERLAPS,
    "p8_round_trip": "SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents",
}
