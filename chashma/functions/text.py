"""Column functions over one text: shape, script, signs of damage, tokens. All are built-in expressions; lengths count code points.

Null text gives null (counts and flags too, unless said otherwise); empty text is a text without anything in it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes, rules and marks that results depend on.
LATIN = r"A-Za-zÀ-ɏḀ-ỿ"
LATIN_CLASS = rf"[{LATIN}]"
CYRILLIC_CLASS = r"[Ѐ-ԯⷠ-ⷿꙀ-ꚟ]"
APOSTROPHES = {
    "U+0027_APOSTROPHE": "'",
    "U+0060_GRAVE_ACCENT": "`",
    "U+00B4_ACUTE_ACCENT": "´",
    "U+02BB_MODIFIER_LETTER_TURNED_COMMA": "ʻ",
    "U+02BC_MODIFIER_LETTER_APOSTROPHE": "ʼ",
    "U+2018_LEFT_SINGLE_QUOTATION_MARK": "‘",
    "U+2019_RIGHT_SINGLE_QUOTATION_MARK": "’",
}
APOSTROPHE_CHARS = "'`´ʻʼ‘’"
SUSPICIOUS = {
    "U+00A0_NO_BREAK_SPACE": " ",
    "U+00AD_SOFT_HYPHEN": "­",
    "U+200B_ZERO_WIDTH_SPACE": "​",
    "U+200C_ZERO_WIDTH_NON_JOINER": "‌",
    "U+200D_ZERO_WIDTH_JOINER": "‍",
    "U+202F_NARROW_NO_BREAK_SPACE": " ",
    "U+2060_WORD_JOINER": "⁠",
    "U+FEFF_ZERO_WIDTH_NO_BREAK_SPACE_OR_BOM": "﻿",
    "U+FFFD_REPLACEMENT_CHARACTER": "�",
}
#: Words with a gap where an apostrophe letter was lost: the parts before the gaps, and what has to follow.
HIGH_GAPS = {"BO_L_PATTERN": ("bo l", ""), "E_LON_PATTERN": ("e lon", r"s?\b"), "KO_R_PATTERN": ("ko r", ""), "MA_LUM_PATTERN": ("ma lum", r"\b"), "O_T_PATTERN": ("o t", ""), "QO_L_PATTERN": ("qo l", ""), "TO_G_R_PATTERN": ("to g r", "")}
AMBIGUOUS_GAPS = {"O_Q_PATTERN": ("o q", ""), "O_Z_PATTERN": ("o z", "")}
CREDIT_MARKERS = {
    "MANBA": r"\bmanba\s*:",
    "MATBUOT_XIZMATI": r"\bmatbuot\s+xizmati\b",
    "AXBOROT_XIZMATI": r"\baxborot\s+xizmati\b",
    "XABAR_BERDI": r"\bxabar\s+berdi\b",
    "XALQ_SOZI": rf"\bxalq\s+so[{APOSTROPHE_CHARS}]zi\b",
    "UZA": rf"\b(?:uza|o[{APOSTROPHE_CHARS}]za)\b",
    "MILLIY_AXBOROT_AGENTLIGI": r"\bmilliy\s+axborot\s+agentligi\b",
    "GAZETA_OR_GAZETASI": r"\bgazeta(?:si)?\b",
    "ARXIV_SURAT": r"\barxiv\s+(?:surat|fotosurat|foto)\b",
    "FOTO_CREDIT": r"\b(?:foto|surat)\s*:",
    "MUALLIF": r"\bmuallif\s*:",
    "MUXBIR": r"\b(?:muxbirimiz|muxbir)\b",
}
#: What a record that is only a credit looks like as a whole: a source, a picture, a press service, a newspaper at its end.
WHOLE_CREDITS = (
    r"(?i)^manba\s*:\s*[^\n]{1,180}\z",
    r"(?i)^(?:arxiv\s+)?(?:surat|fotosurat|foto)(?:\s*:\s*[^\n]{1,100})?\.?\z",
    r"(?i)^(?:(?:[A-ZА-ЯЁ][^\n]{0,80})\s+)?(?:matbuot\s+xizmati|axborot\s+xizmati)\.?\z",
    rf"(?i)(?:\bxalq\s+so[{APOSTROPHE_CHARS}]zi|\b(?:uza|o[{APOSTROPHE_CHARS}]za)|\b[^\n]{{1,80}}\s+gazeta(?:si)?)\.?\z",
)
ENDS_SENTENCE = r"""[.!?…]["'’”)\]]*\s*$"""
UZBEK_WORD = r"[A-Za-zʻʼ‘’'`]+"
WORD_CLASSES = {
    "segmenter": r"[A-Za-zÀ-ÖØ-öø-ÿʻʼ‘’']+",
    "plain": r"[A-Za-z']+",
    "letters": r"[\p{L}]+",
    "letters_marks": r"[\p{L}\p{M}'ʻʼ‘’`]+",
    "blank_separated": r"\S+",
}


def strip(text: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def preview(text: Column, limit: int) -> Column:
    """The first `limit` characters, control marks escaped, an ellipsis if more follows."""
    shown = F.replace(F.replace(F.replace(F.replace(F.left(text, F.lit(limit)), F.lit("\\"), F.lit("\\\\")), F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
    return F.concat(shown, F.when(F.length(text) > limit, F.lit("…")).otherwise(F.lit("")))


def context(text: Column, start: Column, stop: Column, around: int) -> Column:
    """The characters `around` a span (zero-based, half open), with ellipses where text was left out."""
    low, high = F.greatest(F.lit(0), start - around), F.least(F.length(text), stop + around)
    cut = F.substring(text, low + 1, high - low)
    return F.concat(F.when(low > 0, F.lit("…")).otherwise(F.lit("")), preview(cut, 1 << 30), F.when(high < F.length(text), F.lit("…")).otherwise(F.lit("")))


def occurrences(text: Column, piece: str) -> Column:
    """How often a piece of text occurs, without a pattern."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))) / len(piece)).cast("int")


def char_count(text: Column) -> Column:
    return F.length(text)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def line_count(text: Column) -> Column:
    return occurrences(text, "\n") + 1


def script_label(text: Column) -> Column:
    """By code ranges: which of Latin and Cyrillic letters there are."""
    latin, cyrillic = text.rlike(LATIN_CLASS), text.rlike(CYRILLIC_CLASS)
    return (
        F.when(text.isNull(), None)
        .when(latin & cyrillic, "MIXED_LATIN_CYRILLIC")
        .when(latin, "LATIN")
        .when(cyrillic, "CYRILLIC")
        .when(text.rlike(r"\p{L}"), "OTHER_ALPHABETIC")
        .otherwise("NO_ALPHABETIC_CHARACTERS")
    )


def letter_scripts(text: Column) -> Column:
    """Struct of letter counts by Unicode script, and the label they give."""
    latin, cyrillic, letters = (F.regexp_count(text, F.lit(p)) for p in (r"[\p{IsLatin}&&\p{L}]", r"[\p{IsCyrillic}&&\p{L}]", r"\p{L}"))
    other = letters - latin - cyrillic
    label = F.when(letters == 0, "NO_LETTERS").when(letters == latin, "LATIN").when(letters == cyrillic, "CYRILLIC").when(other == 0, "LATIN_CYRILLIC_MIXED").when(other == letters, "OTHER_SCRIPT").otherwise("MULTISCRIPT_OTHER")
    return F.struct(latin.alias("latin"), cyrillic.alias("cyrillic"), other.alias("other"), F.when(text.isNotNull(), label).alias("label"))


def suspicious_counts(text: Column) -> list[Column]:
    """One count for each named character, and one for control characters other than tab and line breaks."""
    return [*(occurrences(text, c).alias(name) for name, c in SUSPICIOUS.items()), F.regexp_count(text, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]")).alias("CONTROL_CHARACTERS")]


def apostrophe_counts(text: Column) -> list[Column]:
    return [occurrences(text, c).alias(name) for name, c in APOSTROPHES.items()]


def boundary_flags(text: Column) -> list[Column]:
    """Eleven booleans on blanks at the ends and inside."""
    first, last = F.left(text, F.lit(1)), F.right(text, F.lit(1))
    named = {
        "leading_blank": first.rlike(r"(?U)^\s"),
        "trailing_blank": last.rlike(r"(?U)^\s"),
        "starts_with_space": text.startswith(" "),
        "starts_with_tab": text.startswith("\t"),
        "starts_with_newline": text.startswith("\n"),
        "ends_with_space": text.endswith(" "),
        "ends_with_tab": text.endswith("\t"),
        "ends_with_newline": text.endswith("\n"),
        "one_trailing_space": F.right(text, F.lit(2)).rlike(r"(?U)^\S \z"),
        "several_trailing_spaces": text.endswith("  "),
        "repeated_blanks": text.rlike(r"[ \t]{2,}"),
    }
    return [c.alias(n) for n, c in named.items()]


def flags(*named: tuple[str, Column]) -> Column:
    """The names whose condition holds, sorted; conditions that are null do not hold."""
    return F.array_sort(F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in named)), lambda x: x.isNotNull()))


def quality_flags(text: Column) -> Column:
    return flags(
        ("EMPTY", ~text.rlike(r"(?U)\S")),
        ("LEADING_OR_TRAILING_BLANK", F.left(text, F.lit(1)).rlike(r"(?U)^\s") | F.right(text, F.lit(1)).rlike(r"(?U)^\s")),
        ("REPEATED_BLANKS", text.rlike(r"[ \t]{2,}")),
        ("TAB", text.contains("\t")),
        ("NEWLINE", text.contains("\n")),
        ("CONTROL", text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]")),
        ("INVISIBLE", text.rlike("[­​-‏⁠﻿]")),
        ("REPLACEMENT", text.contains("�")),
        ("NO_BREAK_SPACE", text.contains(" ")),
        ("MIXED_SCRIPT", text.rlike(LATIN_CLASS) & text.rlike(CYRILLIC_CLASS)),
    )


def blank_runs(text: Column) -> Column:
    """Runs of two or more blanks, spelt as `<SPACE><TAB>`."""
    spell = lambda r: F.array_join(F.transform(F.split(r, ""), lambda c: F.when(c == " ", F.lit("<SPACE>")).when(c == "\t", F.lit("<TAB>")).otherwise(F.lit(""))), "")
    return F.transform(F.regexp_extract_all(text, F.lit(r"[ \t]{2,}"), F.lit(0)), spell)


def _gap_pattern(name: str) -> str:
    word, alone = (HIGH_GAPS | AMBIGUOUS_GAPS)[name]
    follows = rf"[{LATIN}]" + (f"|{alone}" if alone else "")
    return rf"(?i)(?<![{LATIN}]){r'[ \t]+'.join(word.split())}(?={follows})"


#: One pass that nearly all texts fail: the first letters of any rule, a gap, a letter that goes on with one of them.
_ANY_GAP = rf"(?i)(?<![{LATIN}])(?:bo|ko|ma|qo|to|e|o)[ \t]+[glrtqz](?:[{LATIN} \t]|$|\b)"


def gap_possible(text: Column) -> Column:
    return text.rlike(_ANY_GAP)


def gap_count(text: Column, name: str) -> Column:
    return F.regexp_count(text, F.lit(_gap_pattern(name)))


def gap_counts(text: Column, names) -> Column:
    """Matches of all named rules together."""
    total = F.lit(0)
    for n in names:
        total = total + gap_count(text, n)
    return F.when(gap_possible(text), total).otherwise(F.when(text.isNotNull(), 0))


def gap_rules_found(text: Column, names) -> Column:
    return F.when(gap_possible(text), flags(*((n, text.rlike(_gap_pattern(n))) for n in names))).otherwise(F.array().cast("array<string>"))


#: A character for a place, and one for signs beyond the basic plane, each of which then is one element of a split text.
PLACE, _OTHER = "\ue000", "\ue001"


def places(text: Column, pattern: str, mark: str) -> Column:
    """Zero-based offsets of the matches of a pattern whose replacement by `mark` begins with the place's character and is as long as the match. Linear in the text: nothing is summed up or appended."""
    marked = F.regexp_replace(F.regexp_replace(text, rf"[\x{{10000}}-\x{{10FFFF}}{PLACE}]", _OTHER), pattern, mark)
    return F.filter(F.transform(F.split(marked, ""), lambda c, i: F.when(c == PLACE, i)), lambda i: i.isNotNull())


def gap_spans(text: Column, names) -> Column:
    """Array of (start, stop, rule, fragment), sorted."""

    def spans(name: str) -> Column:
        word, _ = (HIGH_GAPS | AMBIGUOUS_GAPS)[name]
        # the first letter gives way to the place's character
        first, rest = r"[ \t]+".join(word.split())[0], r"[ \t]+".join(word.split())[1:]
        starts = places(text, _gap_pattern(name).replace(first + rest, f"{first}({rest})"), PLACE + "$1")
        found = F.regexp_extract_all(text, F.lit(_gap_pattern(name)), F.lit(0))
        return F.zip_with(starts, found, lambda a, m: F.struct(a.alias("start"), (a + F.length(m)).alias("stop"), F.lit(name).alias("rule"), m.alias("fragment")))

    none = F.array().cast("array<struct<start:int,stop:int,rule:string,fragment:string>>")
    return F.when(gap_possible(text), F.array_sort(F.concat(*(spans(n) for n in names)))).otherwise(F.when(text.isNotNull(), none))


def gap_status(high: Column, ambiguous: Column) -> Column:
    return F.when((high > 0) & (ambiguous > 0), "MIXED_CONFIDENCE_REVIEW_REQUIRED").when(high > 0, "HIGH_CONFIDENCE_REVIEW_REQUIRED").when(ambiguous > 0, "AMBIGUOUS_REVIEW_REQUIRED")


def per_thousand(count: Column, chars: Column) -> Column:
    return F.round(F.when(chars > 0, count * 1000.0 / chars).otherwise(0.0), 6)


def credit_markers(text: Column) -> Column:
    return flags(*((n, text.rlike(f"(?i){p}")) for n, p in CREDIT_MARKERS.items()))


def name_like(text: Column) -> Column:
    """Two to four words of letters, each in capitals or with one capital first."""
    words = F.split(F.regexp_replace(strip(text), r"[.!?…]+\z", ""), r"(?U)\s+")
    mark = rf"[{APOSTROPHE_CHARS}\-]"
    ok = lambda w: w.rlike(rf"^[{LATIN}][{LATIN}{APOSTROPHE_CHARS}\-]*\z") & F.regexp_replace(w, mark, "").rlike(r"^(\p{Lu}+|\p{Lu}[^\p{Lu}]*)\z")
    return (F.size(words) >= 2) & (F.size(words) <= 4) & F.forall(words, ok)


def standalone_credit(text: Column, limit: int = 220) -> Column:
    """A short record that only tells a source, an archive picture, a press service or a byline."""
    t = strip(text)
    any_whole = t.rlike(WHOLE_CREDITS[0])
    for pattern in WHOLE_CREDITS[1:]:
        any_whole = any_whole | t.rlike(pattern)
    marked = text.rlike("(?i)" + CREDIT_MARKERS["FOTO_CREDIT"]) | text.rlike("(?i)" + CREDIT_MARKERS["MUALLIF"])
    short = (F.length(t) > 0) & (F.length(t) <= limit) & (occurrences(t, "\n") <= 2)
    return short & (any_whole | marked | (name_like(text) & t.rlike(ENDS_SENTENCE)))


def short_role(text: Column, limit: int = 120) -> Column:
    t = strip(text)
    return F.when(F.length(t) <= limit, F.when(standalone_credit(text) | (name_like(text) & t.rlike(ENDS_SENTENCE)), "SHORT_CREDIT_LIKE").when(t.rlike(ENDS_SENTENCE), "SHORT_SENTENCE_LIKE").otherwise("SHORT_FRAGMENT_OR_UNKNOWN"))


def boilerplate_reasons(text: Column) -> Column:
    words = word_count(text)
    return flags(("SHORT_RECORD", (F.length(text) <= 120) & (words <= 15)), ("SOURCE_OR_CREDIT_MARKER", F.size(credit_markers(text)) > 0), ("PERSON_NAME_LIKE", name_like(text) & (words <= 6)))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


#: Which marks the maps to one apostrophe know.
APOSTROPHE_MAPS = {"six": "`´ʻʼ‘’", "five": "`ʻʼ‘’", "three": "ʻ‘’"}


def one_apostrophe(text: Column, marks: str = APOSTROPHE_MAPS["six"]) -> Column:
    """Apostrophe-like marks as the ASCII one."""
    return F.translate(text, marks, "'" * len(marks))


def tokens(text: Column, kind: str = "segmenter") -> Column:
    return F.regexp_extract_all(text, F.lit(WORD_CLASSES[kind]), F.lit(0))


def ratios(text: Column) -> list[Column]:
    """Shares of letters, digits and punctuation among the characters that are no blanks; 0 if there are none."""
    solid = F.regexp_count(text, F.lit(r"(?U)\S"))
    share = lambda p: F.round(F.when(solid > 0, F.regexp_count(text, F.lit(p)) / solid).otherwise(0.0), 6)
    return [share(r"\p{L}").alias("letter_ratio"), share(r"\p{Nd}").alias("digit_ratio"), share(r"(?U)[^\p{L}\p{Nd}\s]").alias("sign_ratio")]


def letter_ratio_of_all(text: Column) -> Column:
    """The share of letters among all characters, blanks too."""
    return F.round(F.when(F.length(text) > 0, F.regexp_count(text, F.lit(r"\p{L}")) / F.length(text)).otherwise(0.0), 6)


def vowel_ratio(token: Column) -> Column:
    return F.when(F.length(token) > 0, F.regexp_count(token, F.lit("(?i)[aeiou]")) / F.length(token)).otherwise(0.0)


def ocr_like(token: Column) -> Column:
    """A long token that is hard to say: odd share of vowels, five consonants in a row or a letter three times."""
    ratio = vowel_ratio(token)
    return (F.length(token) >= 8) & (((F.length(token) >= 14) & ((ratio < 0.22) | (ratio > 0.72))) | token.rlike("(?i)[b-df-hj-np-tv-z]{5}") | token.rlike(r"(?i)(\p{L})\1\1"))


def foreign_like(token: Column) -> Column:
    low = F.lower(token)
    return (F.length(token) >= 4) & (low.contains("w") | (low.contains("c") & ~low.contains("ch")) | low.rlike("(tion|ing|ness|ment|able)$"))


TOKEN_SHAPES = ("LONG_TOKEN", "LONG_TOKEN_WITH_APOSTROPHE", "CONSONANT_CLUSTER", "TRIPLE_LETTER", "LETTER_W", "C_WITHOUT_H")


def token_shape_flags(text: Column) -> Column:
    """Which odd shapes the tokens of a text have."""
    words = tokens(F.lower(one_apostrophe(text)), "plain")
    has = lambda f: F.exists(words, f)
    return flags(
        ("LONG_TOKEN", has(lambda w: F.length(w) >= 14)),
        ("LONG_TOKEN_WITH_APOSTROPHE", has(lambda w: (F.length(w) >= 12) & w.contains("'"))),
        ("CONSONANT_CLUSTER", has(lambda w: w.rlike("[b-df-hj-np-tv-xz]{5}"))),
        ("TRIPLE_LETTER", has(lambda w: w.rlike(r"([a-z])\1\1"))),
        ("LETTER_W", has(lambda w: w.contains("w"))),
        ("C_WITHOUT_H", has(lambda w: w.rlike("c(?!h)"))),
    )


def repeated_ngram(text: Column, n: int) -> Column:
    """Whether `n` words in a row occur twice."""
    words = F.filter(tokens(F.lower(one_apostrophe(text)), "plain"), lambda w: F.length(w) >= 2)
    grams = words
    for k in range(2, n + 1):  # arrays side by side: inside of a function of an index the words would be found anew for each
        grams = F.zip_with(grams, F.slice(words, k, 1 << 30), lambda a, b: F.concat(a, F.lit(" "), b))
    grams = F.filter(grams, lambda g: g.isNotNull())
    return (F.size(words) > n) & (F.size(F.array_distinct(grams)) < F.size(grams))


def doubled_token(text: Column, least: int = 11, safe: tuple[str, ...] = ()) -> Column:
    """Whether a token begins with a piece of three or more letters said twice."""
    words = tokens(F.lower(one_apostrophe(text)), "plain")
    return F.exists(words, lambda w: (F.length(w) >= least) & w.rlike(r"^(.{3,})\1") & ~w.isin(list(safe) or [""]))


def case_merge(text: Column) -> Column:
    """A capital right behind a small letter."""
    return text.rlike(r"\p{Ll}\p{Lu}")


def spaced_letters(text: Column, least: int = 3) -> Column:
    """Single letters with blanks between."""
    return text.rlike(rf"(?U)(?:\b\p{{L}}\s){{{least},}}\p{{L}}\b")


def acronym_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\b\p{Lu}{2,}\b"))


def apostrophe_defects(text: Column) -> Column:
    t = one_apostrophe(text)
    return flags(("DOUBLED", t.contains("''")), ("LEADING", t.rlike(r"(?U)(?:^|\s)'\p{L}")), ("TRAILING", t.rlike(r"(?U)\p{L}'(?:\s|$)")), ("SPACE_BEFORE", t.rlike(r"\p{L} '\p{L}")), ("SPACE_AFTER", t.rlike(r"\p{L}' \p{Ll}")))


def repeated_vowel(text: Column, safe: tuple[str, ...] = ()) -> Column:
    return F.exists(tokens(F.lower(one_apostrophe(text)), "plain"), lambda w: w.rlike(r"([aeiou])\1") & ~w.isin(list(safe) or [""]))


def mostly_numbers(text: Column, number_words: list[str]) -> Column:
    """Five or more tokens, at least 55 % of them number words or digits."""
    words = F.split(F.lower(one_apostrophe(strip(text))), r"(?U)\s+")
    hits = F.size(F.filter(words, lambda w: w.isin(number_words) | w.rlike(r"^\d+$")))
    return (F.size(words) >= 5) & (hits >= 0.55 * F.size(words))


def anchors(text: Column, terms: list[str]) -> Column:
    """How many of the terms stand in a text, each once."""
    return F.size(F.array_intersect(tokens(F.lower(one_apostrophe(text)), "plain"), F.array(*map(F.lit, terms))))


def near_miss(a: Column, b: Column) -> Column:
    """Different by one inserted, deleted or replaced character, or equal."""
    return F.levenshtein(a, b, 1) >= 0


def trigrams(token: Column) -> Column:
    padded = F.concat(F.lit("^"), token, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(padded) - 2)), lambda i: F.substring(padded, i, F.lit(3)))


def foreign_evidence(text: Column, lists: dict[str, list[str]], strong: int = 3, possible: int = 1) -> Column:
    """How many words of each list of foreign markers a text has, and what that makes of it: STRONG, POSSIBLE or NONE."""
    words = F.array_distinct(tokens(F.lower(one_apostrophe(text)), "plain"))
    hits = {name: F.size(F.array_intersect(words, F.array(*map(F.lit, terms)))) for name, terms in lists.items()}
    most = F.greatest(*hits.values(), F.lit(0))
    return F.struct(*(c.alias(n) for n, c in hits.items()), F.when(most >= strong, "STRONG").when(most >= possible, "POSSIBLE").otherwise("NONE").alias("evidence"))


def short_utterance(text: Column) -> Column:
    """A clean short saying: one to four words of letters, 4 to 40 characters, no digits, no odd signs, ended or not."""
    t = strip(text)
    words = word_count(t)
    return (words >= 1) & (words <= 4) & (F.length(t) >= 4) & (F.length(t) <= 40) & ~t.rlike(r"\p{Nd}") & t.rlike(rf"^[\p{{L}}\p{{M}}{APOSTROPHE_CHARS}\-]+(?: [\p{{L}}\p{{M}}{APOSTROPHE_CHARS}\-]+)*[.!?…]*$")


#: Endings that stand alone behind a word they were cut from, and those that show it behind a short word.
CUT_ENDINGS = ("ning", "ni", "ga", "da", "dan", "gi", "gina", "lik", "ligi", "lar", "lari", "siz", "miz", "dir", "chi", "cha", "kor", "xona", "bop", "dek", "day", "dagi")
SHORT_ENDINGS = ("lik", "ning", "dagi", "dan", "ga", "da", "ni", "siz", "miz", "chi", "cha")


def broken_spacing(text: Column) -> Column:
    """Whether a word is followed by an ending of its own: one that stands alone behind three or more characters, or that begins the word behind two to five."""
    words = F.transform(F.split(F.lower(one_apostrophe(text)), r"(?U)\s+"), lambda w: F.regexp_replace(w, r"^[.,;:!?()\[\]{}\"]+|[.,;:!?()\[\]{}\"]+$", ""))
    pairs = F.zip_with(words, F.slice(words, 2, 1 << 30), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def cut(p: Column) -> Column:
        size = F.length(p["a"])
        return (size >= 3) & p["b"].isin(*CUT_ENDINGS) | (size >= 2) & (size <= 5) & p["b"].rlike("^(" + "|".join(SHORT_ENDINGS) + ")")

    return F.exists(pairs, lambda p: F.coalesce(cut(p), F.lit(False)))


def format_characters(text: Column) -> Column:
    """Characters of the categories Cf and Cc, other than tab and line breaks, and the replacement character, as `U+XXXX`."""
    found = F.regexp_extract_all(text, F.lit(r"[\p{Cf}\p{Cc}�&&[^\t\n\r]]"), F.lit(0))
    return F.transform(found, lambda c: F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(c)), 4, "0")))


def starts_lowercase(text: Column) -> Column:
    """Behind opening quotes, brackets and blanks."""
    return text.rlike(r"""(?U)^[\s"'“‘«(\[{]*\p{Ll}""")


def following_class(text: Column, at: Column) -> Column:
    """What stands behind a place, blanks aside: END, UPPER, LOWER, DIGIT or OTHER."""
    behind = F.regexp_extract(F.substring(text, at + 1, F.length(text)), r"(?Us)^\s*(.)", 1)
    return F.when(behind == "", "END").when(behind.rlike(r"\p{Lu}"), "UPPER").when(behind.rlike(r"\p{Ll}"), "LOWER").when(behind.rlike(r"\p{Nd}"), "DIGIT").otherwise("OTHER")


def parse_bool(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.isin("true", "1", "yes", "y", "t"), True).when(low.isin("false", "0", "no", "n", "f"), False)


def parse_float(text: Column) -> Column:
    """Numbers, percentages as shares, yes and no as 1 and 0; anything else, NaN and infinity are null."""
    low = F.lower(F.trim(text))
    number = F.when(low.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?$"), low.try_cast("double"))
    share = F.when(low.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)%$"), F.regexp_replace(low, "%$", "").try_cast("double") / 100)
    return F.coalesce(number, share, F.when(low.isin("true", "yes"), 1.0).when(low.isin("false", "no"), 0.0))


def parse_int(text: Column) -> Column:
    """Whole numbers, also written as a decimal with zeros behind the point; anything else is null."""
    low = F.trim(text)
    return F.when(low.rlike(r"^[+-]?\d+(\.0*)?$"), F.regexp_replace(low, r"\.0*$", "").try_cast("bigint"))


def parse_list(text: Column) -> Column:
    """Items of a list written as a literal (`['A', "B"]`) or with `|`, `,` or `;`, sorted and once each; none for blanks, `NONE` and `[]`."""
    parts = F.transform(F.split(F.regexp_replace(text, r"[\[\]()'\"{}]", ""), r"[|,;]"), strip)
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: (x != "") & (F.upper(x) != "NONE"))))


def percent(part: Column, whole: Column, digits: int = 6) -> Column:
    """0 where there is no whole."""
    return F.round(F.when(whole > 0, part * 100.0 / whole).otherwise(0.0), digits)


def record_of_sentence(sentence_id: Column) -> Column:
    return F.regexp_extract(sentence_id, r"^s3v1-(\d+)-", 1).try_cast("bigint")


def compact(text: Column, limit: int) -> Column:
    """One line of at most `limit` characters."""
    line = strip(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(line) > limit, F.concat(F.left(line, F.lit(limit - 1)), F.lit("…"))).otherwise(line)


def human_size(size: Column) -> Column:
    step = F.least(F.lit(4), F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / F.log(F.lit(1024.0)))).cast("int")
    return F.format_string("%.2f %s", F.round(size / F.pow(F.lit(1024.0), step), 2), F.element_at(F.array(*map(F.lit, ("B", "KiB", "MiB", "GiB", "TiB"))), step + 1))


def first_named(columns: list[str], *candidates: str) -> Column:
    """The first non-empty value among the candidate columns that exist (letter case aside); null if none does."""
    have = {c.lower(): c for c in columns}
    there = [F.nullif(F.trim(F.col(have[c.lower()]).cast("string")), F.lit("")) for c in candidates if c.lower() in have]
    return F.coalesce(*there) if there else F.lit(None).cast("string")
