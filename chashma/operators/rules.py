"""Rules as data: each gives a reason for a row; a row without reasons is selected. Profiles are thresholds for one set of rules.

Word lists are parameters, not code. Columns are built once and evaluated in one projection.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chashma.functions import text as T


@dataclass(frozen=True)
class Profile:
    """Thresholds of a plain, short sentence of prose."""

    name: str
    words: tuple[int, int] = (6, 16)
    solid_chars: tuple[int, int] = (30, 120)
    least_letters: float = 0.78
    most_signs: float = 0.08
    commas: bool = False
    digits: bool = False
    must_end: str = "."
    #: Whether the shapes of single words count too.
    shapes: bool = False


STRICT = Profile("strict")
WIDE = Profile("wide", words=(7, 18), solid_chars=(45, 165), commas=True, most_signs=0.12)
SHORT = replace(STRICT, name="short", words=(3, 8), solid_chars=(12, 60))
CAREFUL = replace(STRICT, name="careful", shapes=True)


_FEATURES = "f_"


def with_features(df: DataFrame, text_col: str) -> DataFrame:
    """What the rules of all profiles look at, once for each row, as columns that begin with `f_`."""
    out = df.withColumn("f_text", T.strip(F.col(text_col)))
    t = F.col("f_text")
    out = out.withColumn("f_words_of", T.tokens(F.lower(T.one_apostrophe(t)), "plain"))
    words = F.filter("f_words_of", lambda w: F.length(w) >= 2)
    out = out.withColumn("f_pairs", F.zip_with(words, F.slice(words, 2, 1 << 30), lambda a, b: F.concat_ws(" ", a, b)))
    return out.withColumns(
        {
            "f_solid": F.regexp_count(t, F.lit(r"(?U)\S")), "f_words": F.regexp_count(T.one_apostrophe(t), F.lit(T.WORD_CLASSES["letters_marks"])), "f_letters": F.regexp_count(t, F.lit(r"\p{L}")), "f_signs": F.regexp_count(t, F.lit(r"(?U)[^\p{L}\p{Nd}\s]")),
            "f_case_merge": T.case_merge(t), "f_spaced": T.spaced_letters(t), "f_apostrophe": F.size(T.apostrophe_defects(t)) > 0, "f_lower": T.starts_lowercase(t), "f_gap": T.gap_counts(t, T.HIGH_GAPS) > 0, "f_comma": t.contains(","), "f_digit": t.rlike(r"\p{Nd}"),
            "f_shapes": T.token_shape_flags(t), "f_doubled": T.doubled_token(t), "f_vowels": T.repeated_vowel(t), "f_triples": T.repeated_ngram(t, 3), "f_broken": T.broken_spacing(t), "f_acronyms": T.acronym_count(t),
            "f_repeat": F.size(F.array_distinct(F.filter("f_pairs", lambda p: p.contains(" ")))) < F.size(F.filter("f_pairs", lambda p: p.contains(" "))),
        }
    )


def reasons(profile: Profile, blocked: list[str] | None = None) -> Column:
    """Why a sentence (with its features) is not plain prose under a profile; sorted, empty if it is. Null and blank text has the one reason EMPTY."""
    c = F.col
    named = [
        ("TOO_FEW_WORDS", c("f_words") < profile.words[0]), ("TOO_MANY_WORDS", c("f_words") > profile.words[1]), ("TOO_SHORT", c("f_solid") < profile.solid_chars[0]), ("TOO_LONG", c("f_solid") > profile.solid_chars[1]),
        ("FEW_LETTERS", c("f_letters") < profile.least_letters * c("f_solid")), ("MANY_SIGNS", c("f_signs") > profile.most_signs * c("f_solid")), ("DOES_NOT_END_PLAINLY", ~c("f_text").endswith(profile.must_end)), ("CASE_MERGE", c("f_case_merge")),
        ("SPACED_LETTERS", c("f_spaced")), ("APOSTROPHE_DEFECT", c("f_apostrophe")), ("STARTS_LOWERCASE", c("f_lower")), ("REPEATED_PHRASE", c("f_repeat")), ("APOSTROPHE_GAP", c("f_gap")),
    ]
    if not profile.commas:
        named.append(("HAS_COMMA", c("f_comma")))
    if not profile.digits:
        named.append(("HAS_DIGIT", c("f_digit")))
    if profile.shapes:
        named += [(f"{n}_SHAPE", F.array_contains("f_shapes", n)) for n in T.TOKEN_SHAPES]
        named += [("DOUBLED_TOKEN", c("f_doubled")), ("REPEATED_VOWEL", c("f_vowels")), ("REPEATED_TRIPLE", c("f_triples")), ("BROKEN_SPACING", c("f_broken")), ("ACRONYM", c("f_acronyms") > 0)]
    if blocked:
        named.append(("BLOCKED_WORD", F.arrays_overlap("f_words_of", F.array(*map(F.lit, blocked)))))
    return F.when(F.coalesce(F.length("f_text"), F.lit(0)) == 0, F.array(F.lit("EMPTY"))).otherwise(T.flags(*named))


def select(df: DataFrame, text_col: str, profiles: tuple[Profile, ...]) -> DataFrame:
    """A reasons column and a selected column for each profile."""
    out = with_features(df, text_col).withColumns({f"reasons_{p.name}": reasons(p) for p in profiles})
    out = out.withColumns({f"selected_{p.name}": F.size(f"reasons_{p.name}") == 0 for p in profiles})
    return out.drop(*(c for c in out.columns if c.startswith(_FEATURES)))


def route_by(levels: dict[str, dict[str, Column]], default: str) -> tuple[Column, Column]:
    """(decision, reasons): the first level of which any rule holds, with the names of its rules that hold; `default` and no reasons if none does."""
    told = {name: T.flags(*rules.items()) for name, rules in levels.items()}
    decision, why = F.lit(default), F.array().cast("array<string>")
    for name, reasons_of in reversed(told.items()):
        decision, why = F.when(F.size(reasons_of) > 0, F.lit(name)).otherwise(decision), F.when(F.size(reasons_of) > 0, reasons_of).otherwise(why)
    return decision, why


def route(usable: Column, harmful: Column, repairable: Column) -> Column:
    """The first that applies: reject, quarantine (unknown), repair, take."""
    return F.when(harmful, "REJECT").when(usable.isNull(), "QUARANTINE").when(~usable, "QUARANTINE").when(repairable, "REPAIRABLE_USABLE").otherwise("DIRECT_HEALTHY")


def signals(text: Column) -> list[Column]:
    """Boolean signals of damage or format, as columns named `signal_…`."""
    t = T.strip(text)
    named = {
        "mixed_latin_cyrillic": t.rlike(T.LATIN_CLASS) & t.rlike(T.CYRILLIC_CLASS), "no_terminal_punctuation": ~t.rlike(T.ENDS_SENTENCE), "starts_lowercase": T.starts_lowercase(t), "repeated_blanks": t.rlike(r"[ \t]{2,}"), "line_break": t.contains("\n"),
        "replacement_character": t.contains("�"), "apostrophe_gap": T.gap_counts(t, T.HIGH_GAPS) > 0, "case_merge": T.case_merge(t), "spaced_letters": T.spaced_letters(t), "many_digits": F.regexp_count(t, F.lit(r"\p{Nd}")) > 0.2 * F.length(t),
        "url_or_mail": t.rlike(r"(?i)https?://|www\.|\S+@\S+\.\S+"), "bullet": t.rlike(r"^[-•*▪–]\s"), "repeated_signs": t.rlike(r"([!?.,])\1{3,}"), "bracket_imbalance": T.occurrences(t, "(") != T.occurrences(t, ")"), "very_long": F.length(t) >= 400,
        "capitals": (F.regexp_count(t, F.lit(r"\p{Lu}")) > 0.6 * F.regexp_count(t, F.lit(r"\p{L}"))) & (F.length(t) > 12),
    }
    return [F.coalesce(c, F.lit(False)).alias(f"signal_{n}") for n, c in named.items()]


SIGNALS = [f"signal_{n}" for n in "mixed_latin_cyrillic no_terminal_punctuation starts_lowercase repeated_blanks line_break replacement_character apostrophe_gap case_merge spaced_letters many_digits url_or_mail bullet repeated_signs bracket_imbalance very_long capitals".split()]


def stripped_roots(tokens: DataFrame, vocabulary: DataFrame, suffixes: list[str]) -> DataFrame:
    """(token, root): tokens whose longest suffix leaves a known root of more than three characters. Candidates are exploded and joined with the vocabulary."""
    cut = F.array(*(F.when(F.col("token").endswith(s), F.struct(F.lit(-len(s)).alias("order"), F.expr(f"left(token, length(token) - {len(s)})").alias("root"))) for s in suffixes))
    candidates = tokens.select("token", F.explode(F.filter(cut, lambda x: x.isNotNull())).alias("c")).where("length(c.root) > 3")
    known = vocabulary.select(F.col("token").alias("known"))
    return candidates.join(known, F.col("c.root") == F.col("known")).groupBy("token").agg(F.min("c").alias("m")).select("token", "m.root")


def trigram_coverage(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The share of a token's letter trigrams that known tokens have."""
    known = vocabulary.select(F.explode(T.trigrams(F.col("token"))).alias("gram")).distinct().withColumn("is_known", F.lit(1))
    grams = tokens.select("token", F.explode(T.trigrams(F.col("token"))).alias("gram"))
    return grams.join(known, "gram", "left").groupBy("token").agg(F.round(F.count("is_known") / F.count("*"), 6).alias("coverage"))


def near_misses(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, known): pairs at edit distance one. Both sides are joined on what is left if one character is dropped, so no pair is tried in vain."""

    def drops(df: DataFrame, name: str) -> DataFrame:
        cut = F.concat(F.array(F.col("token")), F.transform(F.sequence(F.lit(1), F.length("token")), lambda i: F.concat(F.substring(F.col("token"), F.lit(1), i - 1), F.substring(F.col("token"), i + 1, F.length("token")))))
        return df.where("length(token) > 0").withColumn("rests", F.array_distinct(cut)).select(F.col("token").alias(name), F.explode("rests").alias("rest"))

    pairs = drops(tokens, "token").join(drops(vocabulary, "known"), "rest").where("token != known").select("token", "known").distinct()
    return pairs.where(T.near_miss(F.col("token"), F.col("known")))
