"""SQL of the pieces that several queries are made of, for DuckDB. RE2 has no look-around; the blanks are those Java and Python know."""

from __future__ import annotations

from chashma.functions import text as T
from chashma.operators import segment as G
from chashma.operators import typos as Y

B = r"[\t-\r\x{85}\p{Z}]"
SOLID = "[^" + B[1:-1] + "]"
LAT = "A-Za-zÀ-ɏḀ-ỿ"
CYR = "Ѐ-ԯⷠ-ⷿꙀ-ꚟ"
#: What does not belong to a word, as `\b` sees it.
OUTSIDE = r"[^\p{L}\p{M}\p{Nd}\p{Pc}\p{Nl}]"


def N(pattern: str, text: str = "text") -> str:
    """How often a pattern matches."""
    return rf"len(regexp_extract_all({text}, '{pattern}'))"


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def one_of(values) -> str:
    return "(" + ", ".join(quoted(v) for v in sorted(values)) + ")"


def gap_sql(name: str, text: str) -> str:
    word, alone = (T.HIGH_GAPS | T.AMBIGUOUS_GAPS)[name]
    ahead = f"([{LAT}]|{alone})" if alone else f"[{LAT}]"
    return rf"len(regexp_extract_all({text}, '(?i)(^|[^{LAT}]){r'[ \t]+'.join(word.split())}{ahead}'))"


def gaps_sql(names, text: str) -> str:
    return "(" + " + ".join(gap_sql(n, text) for n in names) + ")"


def stripped(text: str) -> str:
    return rf"regexp_replace({text}, '^{B}+|{B}+$', '', 'g')"


def one_apostrophe(text: str, marks: str = "`´ʻʼ‘’") -> str:
    return f"regexp_replace({text}, '[{marks}]', '''', 'g')"


def plain_tokens(text: str) -> str:
    """Lower-cased words of ASCII letters and apostrophes."""
    return f"regexp_extract_all(lower({one_apostrophe(text)}), '[A-Za-z'']+')"


def flags(named: dict[str, str]) -> str:
    """The names whose condition holds, sorted."""
    return "list_sort([x for x in [" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in named.items()) + "] if x IS NOT NULL])"


def preview(text: str) -> str:
    return rf"replace(replace(replace(replace({text}, '\', '\\'), chr(13), '\r'), chr(10), '\n'), chr(9), '\t')"


def context(text: str, start: str, stop: str, around: int) -> str:
    low, high = f"greatest(0, {start} - {around})", f"least(length({text}), {stop} + {around})"
    return f"(CASE WHEN {low} > 0 THEN '…' ELSE '' END || {preview(f'substr({text}, {low} + 1, {high} - {low})')} || CASE WHEN {high} < length({text}) THEN '…' ELSE '' END)"


# ---- sentences, as a subquery: ends with their rules, and each sentence is the ends since the last one that splits
_WORD = r"A-Za-zÀ-ÖØ-öø-ÿʻʼ‘’''"
_CLOSE = r"""["»”’)\]}]*"""
_ORDINAL = G.ORDINALS.replace("'", "''").replace(r"\s", B)
_INITIAL = rf"(^|{B})([A-Z]|Sh|SH|Ch|CH|O[''ʻʼ‘’]|G[''ʻʼ‘’])\.{B}+{_ORDINAL}$"


def segments(table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """(rec, i, t, sentence_text, a, b, marks, method, flags, sentence_id) of the sentences of a table."""
    lowercase_next = rf"regexp_matches(substr(t, stop + 1), '^[{B[1:-1]}{_CLOSE[1:-2]}]*\p{{Ll}}')"
    return rf"""(WITH d AS (SELECT {key} AS rec, {text} AS t FROM {table} WHERE {text} IS NOT NULL),
    p AS (SELECT rec, t, unnest(x) AS piece, generate_subscripts(x, 1) AS i FROM (SELECT rec, t, regexp_extract_all(t, '(?s)[^.!?…]*[.!?…]+{_CLOSE}') AS x FROM d)),
    e AS (SELECT *, (sum(length(piece)) OVER (PARTITION BY rec ORDER BY i))::BIGINT AS stop, regexp_extract(piece, '(?s)^[^.!?…]*([.!?…]+)', 1) AS marks FROM p),
    f AS (SELECT *, stop - length(piece) + length(regexp_extract(piece, '(?s)^[^.!?…]*')) AS pos, left(marks, 1) AS mark FROM e),
    g AS (SELECT *, regexp_extract(left(t, pos), '[{_WORD}]+$') AS bef, regexp_extract(substr(t, pos + 2), '^{_CLOSE}{B}*([{_WORD}]+)', 1) AS fol, regexp_extract(substr(t, stop + 1), '^{_CLOSE}{B}*([{_WORD}]+)', 1) AS bey, {lowercase_next} AS low FROM f),
    h AS (SELECT *, CASE WHEN suffix(lower(bef), 'inchi') THEN substr(t, greatest(0, pos - 200) + 1, least(pos, 200)) ELSE '' END AS near FROM g),
    k AS (SELECT *, CASE
        WHEN mark = '.' AND fol != '' AND (regexp_matches(bef, '^\p{{Lu}}$') OR (lower(bef) IN {one_of(G.LETTER_PAIRS)} AND regexp_matches(bef, '^\p{{Lu}}'))) THEN ['INITIAL_BOUNDARY_PROTECTED', 'SHORT_TOKEN_BEFORE_PERIOD']
        WHEN mark = '.' AND length(bef) >= 2 AND lower(fol) IN {one_of(G.DOMAINS)} THEN ['DOTTED_NAME_OR_DOMAIN_PROTECTED']
        WHEN mark = '.' AND lower(bef) IN {one_of(G.ABBREVIATIONS)} THEN ['ABBREVIATION_BOUNDARY_PROTECTED']
        WHEN mark = '.' AND regexp_matches(fol, '^\p{{Ll}}') AND regexp_matches(near, '{_INITIAL}') THEN ['ROMAN_EXPANSION_INITIAL_PROTECTED', 'SUSPICIOUS_ORDINAL_PERIOD_PROTECTED']
        WHEN mark = '.' AND fol != '' AND regexp_matches(near, '(?i){_ORDINAL}$') AND (lower(fol) IN {one_of(G.SUFFIXES)} OR (regexp_matches(fol, '\p{{Lu}}') AND NOT regexp_matches(fol, '\p{{Ll}}'))) THEN ['SUSPICIOUS_ORDINAL_PERIOD_PROTECTED']
        WHEN lower(bey) IN {one_of(G.SPEECH)} THEN ['QUOTE_OR_SPEECH_CONTINUATION']
        WHEN mark IN ('?', '!') AND low THEN ['LOWERCASE_AFTER_TERMINAL', 'LOWERCASE_AFTER_STRONG_PUNCTUATION_PROTECTED'] ELSE []::VARCHAR[] END AS kept FROM h),
    l AS (SELECT *, coalesce(sum((len(kept) = 0)::INT) OVER (PARTITION BY rec ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS grp FROM k),
    m AS (SELECT rec, grp, any_value(t) AS t, flatten(list(kept)) AS kept, max(stop) FILTER (len(kept) = 0) AS stop, any_value(marks) FILTER (len(kept) = 0) AS marks, any_value(low) FILTER (len(kept) = 0) AS low FROM l GROUP BY rec, grp),
    n AS (SELECT rec, t, coalesce(lag(stop) OVER (PARTITION BY rec ORDER BY grp), 0) AS start, stop, marks, 'RULE_TERMINAL_PUNCTUATION' AS method, list_concat(kept, CASE WHEN low THEN ['LOWERCASE_AFTER_TERMINAL'] ELSE []::VARCHAR[] END) AS flags FROM m WHERE stop IS NOT NULL
        UNION ALL SELECT d.rec, d.t, coalesce(x.stop, 0), length(d.t), '', 'TRAILING_FRAGMENT', list_concat(coalesce(y.kept, []::VARCHAR[]), ['NO_TERMINAL_PUNCTUATION'])
        FROM d LEFT JOIN (SELECT rec, max(stop) AS stop FROM m GROUP BY 1) x ON x.rec = d.rec LEFT JOIN (SELECT rec, kept FROM m WHERE stop IS NULL) y ON y.rec = d.rec WHERE coalesce(x.stop, 0) < length(d.t)),
    o AS (SELECT *, substr(t, start + 1, stop - start) AS raw FROM n),
    q AS (SELECT *, start + length(raw) - length(regexp_replace(raw, '^{B}+', '')) AS a, start + length(regexp_replace(raw, '{B}+$', '')) AS b FROM o),
    r AS (SELECT *, substr(t, a + 1, b - a) AS sentence_text, row_number() OVER (PARTITION BY rec ORDER BY start) - 1 AS i, list_sort(list_distinct(list_concat(flags, CASE WHEN b - a >= {G.LONG} THEN ['VERY_LONG_SEGMENT'] ELSE []::VARCHAR[] END))) AS named FROM q WHERE a < b)
    SELECT rec, i, t, sentence_text, a, b, marks, method, named AS flags, len([x for x in named if x IN {one_of(G.REVIEW)}]) > 0 AS review,
        printf('s3v1-%d-%04d-', rec, i) || left(sha256(concat_ws(chr(10), {quoted(G.VERSION)}, rec, i, a, b, sentence_text)), 16) AS sentence_id FROM r)"""


# ---- damage and rules
SHAPES = {
    "LONG_TOKEN": "length(w) >= 14", "LONG_TOKEN_WITH_APOSTROPHE": "length(w) >= 12 AND contains(w, '''')", "CONSONANT_CLUSTER": "regexp_matches(w, '[b-df-hj-np-tv-xz]{5}')", "TRIPLE_LETTER": f"regexp_matches(w, '{'|'.join(c * 3 for c in 'abcdefghijklmnopqrstuvwxyz')}')",
    "LETTER_W": "contains(w, 'w')", "C_WITHOUT_H": "regexp_matches(w, 'c([^h]|$)')",
}


def some(words: str, condition: str) -> str:
    return f"len([w for w in {words} if {condition}]) > 0"


DOUBLED = "length(w) >= 11 AND len([k for k in range(3, length(w) // 2 + 1) if left(w, k) = substr(w, k + 1, k)]) > 0"


def broken_spacing(text: str) -> str:
    trimmed = rf"""[regexp_replace(w, '^[.,;:!?()\[\]{{}}"]+|[.,;:!?()\[\]{{}}"]+$', '', 'g') for w in string_split_regex(lower({one_apostrophe(text)}), '{B}+')]"""
    pairs = f"list_zip({trimmed}, ({trimmed})[2:])"
    return f"""len([p for p in {pairs} if coalesce((length(p[1]) >= 3 AND p[2] IN {one_of(T.CUT_ENDINGS)}) OR (length(p[1]) BETWEEN 2 AND 5 AND regexp_matches(p[2], '^({'|'.join(T.SHORT_ENDINGS)})')), false)]) > 0"""


def following(text: str, at: str) -> str:
    behind = f"regexp_extract(substr({text}, {at} + 1), '(?s)^{B}*(.)', 1)"
    return rf"CASE WHEN {behind} = '' THEN 'END' WHEN regexp_matches({behind}, '\p{{Lu}}') THEN 'UPPER' WHEN regexp_matches({behind}, '\p{{Ll}}') THEN 'LOWER' WHEN regexp_matches({behind}, '\p{{Nd}}') THEN 'DIGIT' ELSE 'OTHER' END"


def spaced_letters(text: str, least: int = 3) -> str:
    return rf"regexp_matches({text}, '(^|{OUTSIDE})(\p{{L}}{B}){{{least},}}\p{{L}}($|{OUTSIDE})')"


def apostrophe_defects(text: str) -> dict[str, str]:
    t = one_apostrophe(text)
    return {
        "DOUBLED": f"contains({t}, '''''')", "LEADING": rf"regexp_matches({t}, '(^|{B})''\p{{L}}')", "TRAILING": rf"regexp_matches({t}, '\p{{L}}''({B}|$)')",
        "SPACE_BEFORE": rf"regexp_matches({t}, '\p{{L}} ''\p{{L}}')", "SPACE_AFTER": rf"regexp_matches({t}, '\p{{L}}'' \p{{Ll}}')",
    }


def starts_lowercase(text: str) -> str:
    return rf"""regexp_matches({text}, '^[{B[1:-1]}"''“‘«(\[{{]*\p{{Ll}}')"""


def repeated_ngram(words: str, n: int) -> str:
    """Whether `n` words in a row occur twice among a list of words."""
    grams = f"[array_to_string({words}[i : i + {n - 1}], ' ') for i in range(1, greatest(2, len({words}) - {n - 2}))]"
    return f"(len({words}) > {n} AND len(list_distinct({grams})) < len({grams}))"


ENDS = T.ENDS_SENTENCE.replace("'", "''")


def signals(text: str) -> dict[str, str]:
    """Of a stripped text; the names of the operators' signals."""
    lu, le = N(r"\p{Lu}", text), N(r"\pL", text)
    return {
        "mixed_latin_cyrillic": f"regexp_matches({text}, '[{LAT}]') AND regexp_matches({text}, '[{CYR}]')", "no_terminal_punctuation": f"NOT regexp_matches({text}, '{ENDS}')", "starts_lowercase": starts_lowercase(text), "repeated_blanks": rf"regexp_matches({text}, '[ \t]{{2,}}')",
        "line_break": f"contains({text}, chr(10))", "replacement_character": f"contains({text}, chr(65533))", "apostrophe_gap": f"{gaps_sql(T.HIGH_GAPS, text)} > 0", "case_merge": rf"regexp_matches({text}, '\p{{Ll}}\p{{Lu}}')", "spaced_letters": spaced_letters(text),
        "many_digits": f"{N(r'\p{Nd}', text)} > 0.2 * length({text})", "url_or_mail": rf"regexp_matches({text}, '(?i)https?://|www\.|\S+@\S+\.\S+')", "bullet": rf"regexp_matches({text}, '^[-•*▪–]\s')", "repeated_signs": rf"regexp_matches({text}, '!{{4,}}|\?{{4,}}|\.{{4,}}|,{{4,}}')",
        "bracket_imbalance": f"length(replace({text}, '(', '')) != length(replace({text}, ')', ''))", "very_long": f"length({text}) >= 400", "capitals": f"{lu} > 0.6 * {le} AND length({text}) > 12",
    }


def strict(profile, rows: str, text: str, *beside: str) -> str:
    """(…beside, reasons) of the rows of a relation under a profile."""
    named = {
        "TOO_FEW_WORDS": f"words < {profile.words[0]}", "TOO_MANY_WORDS": f"words > {profile.words[1]}", "TOO_SHORT": f"solid < {profile.solid_chars[0]}", "TOO_LONG": f"solid > {profile.solid_chars[1]}", "FEW_LETTERS": f"letters < {profile.least_letters} * solid", "MANY_SIGNS": f"signs > {profile.most_signs} * solid",
        "DOES_NOT_END_PLAINLY": f"NOT suffix(st, {quoted(profile.must_end)})", "CASE_MERGE": r"regexp_matches(st, '\p{Ll}\p{Lu}')", "SPACED_LETTERS": spaced_letters("st"), "APOSTROPHE_DEFECT": "(" + " OR ".join(apostrophe_defects("st").values()) + ")", "STARTS_LOWERCASE": starts_lowercase("st"),
        "REPEATED_PHRASE": "len(list_distinct(pairs)) < len(pairs)", "APOSTROPHE_GAP": f"{gaps_sql(T.HIGH_GAPS, 'st')} > 0",
    }
    if not profile.commas:
        named["HAS_COMMA"] = "contains(st, ',')"
    if not profile.digits:
        named["HAS_DIGIT"] = r"regexp_matches(st, '\p{Nd}')"
    if profile.shapes:
        tokens = plain_tokens("st")
        named |= {f"{n}_SHAPE": some(tokens, SHAPES[n]) for n in T.TOKEN_SHAPES}
        named |= {"DOUBLED_TOKEN": some(tokens, DOUBLED), "REPEATED_VOWEL": some(tokens, "regexp_matches(w, 'aa|ee|ii|oo|uu')"), "REPEATED_TRIPLE": repeated_ngram("tok", 3), "BROKEN_SPACING": broken_spacing("st"), "ACRONYM": some(r"regexp_extract_all(st, '[\p{L}\p{M}\p{Nd}\p{Pc}\p{Nl}]+')", r"regexp_matches(w, '^\p{Lu}{2,}$')")}
    kept = ", ".join(beside)
    letters_marks = T.WORD_CLASSES["letters_marks"].replace("'", "''")
    return rf"""(SELECT {kept}, CASE WHEN coalesce(length(st), 0) = 0 THEN ['EMPTY'] ELSE {flags(named)} END AS reasons
        FROM (SELECT *, [tok[j] || ' ' || tok[j + 1] for j in range(1, len(tok))] AS pairs, {N(SOLID, "st")} AS solid, {N(letters_marks, one_apostrophe("st"))} AS words, {N(r"\pL", "st")} AS letters, {N(r"[^\pL\p{Nd}" + B[1:-1] + "]", "st")} AS signs
        FROM (SELECT *, [w for w in {plain_tokens("st")} if length(w) >= 2] AS tok FROM (SELECT *, {stripped(text)} AS st FROM {rows}))))"""


# ---- typing errors
def typo_words(rows: str) -> str:
    """(sentence_id, target, k, start, surface, prefix, core, suffix, fit) of the words of (sentence_id, target)."""
    pattern = rf"(?s)^({Y.OPENING})(.*?)({Y.CLOSING})\z".replace("'", "''")
    return rf"""(WITH s AS (SELECT sentence_id, target, regexp_extract_all(target, '{SOLID}+') AS x, string_split_regex(target, '{SOLID}+') AS g FROM {rows} WHERE target IS NOT NULL),
    w AS (SELECT sentence_id, target, x[k] AS surface, (k - 1)::INT AS k, (list_sum([length(y) for y in g[1:k]]) + coalesce(list_sum([length(y) for y in x[1:k - 1]]), 0))::INT AS start FROM (SELECT *, unnest(range(1, len(x) + 1)) AS k FROM s)),
    c AS (SELECT *, regexp_extract(surface, '{pattern}', 1) AS prefix, regexp_extract(surface, '{pattern}', 2) AS core, regexp_extract(surface, '{pattern}', 3) AS suffix FROM w)
    SELECT *, length(core) >= 2 AND NOT regexp_matches(core, '^\d+\z') AND regexp_matches(core, '[A-Za-zÀ-ÿʻʼ‘’''`-]') AS fit FROM c)"""


def _first(old: str, new: str) -> str:
    o = quoted(old)
    return f"CASE WHEN contains(core, {o}) THEN left(core, instr(core, {o}) - 1) || {quoted(new)} || substr(core, instr(core, {o}) + {len(old)}) END"


_HALF, _SWAP = "(length(core) // 2)", "greatest(1, length(core) // 2 - 1)"
_SWAPPED = f"substr(core, 1, {_SWAP}) || substr(core, {_SWAP} + 2, 1) || substr(core, {_SWAP} + 1, 1) || substr(core, {_SWAP} + 3)"
_DOUBLED = f"substr(core, 1, {_HALF} + 1) || substr(core, {_HALF} + 1)"
_SHORTENED = f"substr(core, 1, {_HALF}) || substr(core, {_HALF} + 2)"
_PARTED = f"substr(core, 1, {_HALF}) || ' ' || substr(core, {_HALF} + 1)"


def typo_variants(words: str) -> str:
    """(…, priority, rule, family, corrupted) of each fit word and rule that changes it; equal results once, by the first rule."""
    marks = Y.MARKS.replace("'", "''")
    rules = [
        (1, "apostrophe_drop", "apostrophe", f"CASE WHEN regexp_matches(core, '[{marks}]') THEN regexp_replace(core, '[{marks}]', '', 'g') END"), (1, "apostrophe_ascii_to_backtick", "apostrophe", "replace(core, '''', '`')"), (2, "apostrophe_ascii_to_curly_left", "apostrophe", "replace(core, '''', '‘')"),
        (2, "apostrophe_to_ascii", "apostrophe", "regexp_replace(core, '[‘’ʻʼ`]', '''', 'g')"), *((2, rule, "phonetic" if rule.startswith("phonetic") else "apostrophe", _first(old, new)) for old, new, rule in Y.SIMPLER),
        (3, "drop_last_char", "deletion", "CASE WHEN length(core) >= 4 THEN left(core, length(core) - 1) END"), (3, "drop_middle_char", "deletion", f"CASE WHEN length(core) >= 5 THEN {_SHORTENED} END"), (3, "duplicate_middle_char", "insertion", f"CASE WHEN length(core) >= 3 THEN {_DOUBLED} END"),
        (4, "duplicate_last_char_short_token", "insertion", "CASE WHEN length(core) BETWEEN 2 AND 4 THEN core || right(core, 1) END"), (3, "swap_inner_chars", "transposition", f"CASE WHEN length(core) >= 4 AND {_SWAP} + 1 < length(core) THEN {_SWAPPED} END"), (5, "split_word_middle", "spacing", f"CASE WHEN length(core) >= 7 THEN {_PARTED} END"),
    ]
    told = ", ".join(f"{{'at': {i}, 'priority': {p}, 'rule': '{r}', 'family': '{f}', 'corrupted': {c}}}" for i, (p, r, f, c) in enumerate(rules))
    return f"""(SELECT * EXCLUDE (v), v.priority AS priority, v.rule AS rule, v.family AS family, v.corrupted AS corrupted FROM (SELECT *, unnest([{told}]) AS v FROM {words} WHERE fit) WHERE v.corrupted IS NOT NULL AND v.corrupted != '' AND v.corrupted != core
        QUALIFY row_number() OVER (PARTITION BY sentence_id, k, v.corrupted ORDER BY v.at) = 1)"""


def typo_rows(variants: str, most: int) -> str:
    return f"""(SELECT printf('v11-%s-%03d-%02d', sentence_id, k, turn) AS row_id, sentence_id, target, left(target, start) || prefix || corrupted || suffix || substr(target, start + length(surface) + 1) AS input, k AS token_index, start AS token_start_char, (start + length(surface))::INT AS token_end_char,
        core AS clean_token, corrupted AS corrupted_token, prefix || corrupted || suffix AS error_word, surface AS correction, family AS typo_family, rule AS typo_rule, (turn + 1)::INT AS variant_rank
        FROM (SELECT *, row_number() OVER (PARTITION BY sentence_id, k ORDER BY priority, sha256('42|' || sentence_id || '|' || k || '|' || rule), rule) - 1 AS turn FROM {variants}) WHERE turn < {most})"""


def typo_sweep(words: str) -> str:
    made = {
        "apostrophe_drop": "replace(core, '''', '')", "apostrophe_ascii_to_backtick": "replace(core, '''', '`')", "phonetic_sh": f"coalesce({_first('sh', 's')}, {_first('Sh', 'S')})", "phonetic_ch": f"coalesce({_first('ch', 'c')}, {_first('Ch', 'C')})", "drop_last": "CASE WHEN length(core) >= 4 THEN left(core, length(core) - 1) END",
        "drop_inner": f"CASE WHEN length(core) >= 5 THEN {_SHORTENED} END", "duplicate_inner": f"CASE WHEN length(core) >= 4 THEN {_DOUBLED} END", "swap_inner": f"CASE WHEN length(core) >= 4 THEN {_SWAPPED} END", "split_word": f"CASE WHEN length(core) >= 7 THEN {_PARTED} END", "duplicate_last_char_fallback": "CASE WHEN length(core) >= 2 THEN core || right(core, 1) END",
    }
    told = ", ".join(f"{{'rule': '{r}', 'family': '{f}', 'corrupted': {made[r]}}}" for r, f in Y.SWEEP.items())
    return f"""SELECT sentence_id, k AS token_index, surface, core, fit AS eligible, v.rule AS rule, v.family AS family, v.corrupted AS corrupted
        FROM (SELECT *, CASE WHEN fit THEN fits[1 + ('0x' || left(sha256('42|' || sentence_id || '|' || k), 8))::BIGINT % greatest(1, len(fits))] END AS v FROM (SELECT *, [v for v in [{told}] if v.corrupted IS NOT NULL AND v.corrupted != '' AND v.corrupted != core] AS fits FROM {words}))"""
