"""Per-document text statistics that tell prose from lists, tables and junk.

A text is cut into chunks of about `CHUNK` characters, at single blanks or line breaks outside of tags. Of each chunk the
counts are taken together with the state at both ends: the unfinished first and last line, the classes of
the first and last token and the prints of the first and last word. `merge` joins two neighbouring
partials, is associative and corrects what the cut hid (a line, a pair of tokens, a repeated word), so that
partials of one document merge in a tree: each level is an aggregation over at most `FAN` neighbours. The
result is that of the uncut text at any size of chunks. A text within one chunk, as nearly all are, is a tree of one.

How likely letters follow each other is counted over the whole texts of all keys; it tells random letters from words. A word counts once for each
text. What is kept is a number for each pair of letters.

Defined cases: a null text gives null statistics and no kind; an empty or blank text counts nothing and is
junk; rows delivered twice count once; other columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from math import log

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: `SAMPLE_CHARS` is for operators that learn from a sample (see `sample`); nothing here does.
CHUNK, SAMPLE_CHARS = 1 << 20, 20_000
#: Partials merged in one step of the tree, and the most characters a value can have, which bounds the steps: two for chunks of `CHUNK`.
FAN, MOST_CHARS = 64, 1 << 31
#: From fewer letter pairs nothing is learnt, and the rule on unlikely letters rests.
LEAST_PAIRS = 5000

#: Additive counts of a chunk, in this order.
COUNTS = (
    "chars", "letters", "uppercase", "digits", "blanks", "symbols", "frames", "tabs", "semicolons", "vowels", "latin", "cyrillic",
    "words", "word_chars", "common_words", "repeated_words", "letter_pairs", "pair_bits",
    "tokens", "numbers", "enumerators", "pipes", "tags", "codes", "number_pairs", "amounts", "prices", "wide_gaps",
    "lines", "ended_lines", "bullet_lines", "cell_lines",
)
_AT = {n: i for i, n in enumerate(COUNTS)}
#: A line in the making: whether it has text, class of its first token, whether its last character ends a sentence, semicolons, tabs.
_LINE = 5

_TOKEN = regex.compile(r"\S+")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}'`´‘’ʻʼ]+")
_FRAMES = regex.compile(r"[─-▟]")
_SYMBOL = regex.compile(r"[^\p{L}\p{M}\p{N}\p{Z}\s.,:;!?…'\"`´‘’ʻʼ«»“”„()\-–—。，！？：；、।؟،]")
#: ASCII signs that are symbols or begin tags; most texts have none.
_SIGNS = regex.compile(r"[#$%&*+/<=>@\\^_{|}~\[\]]")
_TAG = regex.compile(r"</?[A-Za-z][^<>]{0,200}>|&#?\w{2,8};")
_VOWELS = frozenset("aeiouyаеёиоуыэюяўіұүөәӣӯıöüâîûʻ")
_ENDS = frozenset(".!?…。！？।؟．»\"”")
_CLOSERS = "»\"”’')］）)]"
NUMBER, ENUMERATOR, BULLET, DASH, COLON, PIPE, OTHER = 1, 2, 3, 4, 5, 6, 0
_NUMBER = regex.compile(r"[+\-]?\d[\d.,  ]*%?[;,.]?$")
_ENUMERATOR = regex.compile(r"\(?\d{1,3}[.)]$|\(?[a-zа-я]\)$")
_CODE = regex.compile(r"(?=.*\d)(?=.*[A-Za-z])[A-Za-z0-9+/=%_\-]{16,}$|[+/=%A-Za-z0-9]{24,}$")
_GAP = regex.compile(r"(?<=\S)[  ]{2,}(?=\d)")


def token_class(token: str) -> int:
    if token in "•*▪◦‣·-–—":
        return BULLET if token in "•*▪◦‣·" else DASH
    if token == "|":
        return PIPE
    if _ENUMERATOR.match(token):
        return ENUMERATOR
    if _NUMBER.match(token):
        return NUMBER
    return COLON if token[-1] == ":" else OTHER


def text_print(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word) >> 1


def word_counts(texts: Iterable[str], counts: Counter | None = None) -> Counter:
    """In how many texts each word is: it counts once for each text, so that a text of one repeated word teaches little."""
    counts = Counter() if counts is None else counts
    for t in texts:
        counts.update({m.group() for m in _WORD.finditer(t.lower())})
    return counts


def letter_pairs(words: Counter) -> Counter:
    """How often each letter stands behind another, with the blanks around a word."""
    pairs: Counter = Counter()
    for w, n in words.items():
        if w.isalpha():
            for a, b in zip(" " + w, w + " "):
                pairs[a + b] += n
    return pairs


class Letters:
    """Log probabilities of a letter after another, learnt from texts, for words of one script."""

    FLOOR = -9.0

    def __init__(self, table: dict[str, float], common: frozenset[str]):
        self.table, self.common = table, common
        self.known: dict[str, tuple] = {}
        self.classes: dict[str, int] = {}

    @classmethod
    def learn(cls, texts: list[str], common: list[str]) -> Letters:
        return cls.of(letter_pairs(word_counts(texts)), common)

    @classmethod
    def of(cls, pairs: dict[str, int], common: list[str]) -> Letters:
        """From how often each pair of letters was met. A rare pair is no less likely than one that was not met, however many texts there are."""
        first: Counter = Counter()
        for p, n in pairs.items():
            first[p[0]] += n
        known = {p: max(cls.FLOOR, log(n / first[p[0]])) for p, n in pairs.items() if n > 2} if sum(pairs.values()) >= LEAST_PAIRS else {}
        return cls(known, frozenset(w.lower() for w in common if w))

    def bits(self, word: str) -> tuple[int, float]:
        """Letter pairs of a word in lower case, and the sum of their log probabilities."""
        table = self.table
        letters = "".join(c for c in word if c.isalpha()) if table else ""
        return (len(letters) + 1, sum(table.get(a + b, self.FLOOR) for a, b in zip(" " + letters, letters + " "))) if letters else (0, 0.0)

    def word(self, raw: str) -> tuple:
        """(print, length, common, letter pairs, their bits, letters, capitals, digits, vowels, Latin, Cyrillic); words are few, so they are kept."""
        got = self.known.get(raw)
        if got is None:
            low = raw.lower()
            size, bits = self.bits(low)
            got = (
                text_print(low), len(low), low in self.common, size, bits, sum(map(str.isalpha, raw)), sum(map(str.isupper, raw)), sum(map(str.isdigit, raw)),
                sum(map(_VOWELS.__contains__, low)), sum("a" <= c <= "z" or "ß" <= c <= "ɏ" for c in low), sum("Ѐ" <= c <= "ԯ" for c in low),
            )
            if len(raw) < 64:
                if len(self.known) > 300_000:
                    self.known.clear()
                self.known[raw] = got
        return got

    def token(self, raw: str) -> int:
        got = self.classes.get(raw)
        if got is None:
            got = token_class(raw)
            if len(raw) < 64:
                if len(self.classes) > 300_000:
                    self.classes.clear()
                self.classes[raw] = got
        return got


def partial(text: str, letters: Letters) -> list:
    """[counts, first line, last line, newline seen, first token, last token, first word, last word] of a chunk."""
    n = [0.0] * len(COUNTS)
    n[_AT["chars"]] = len(text)
    tokens = _TOKEN.findall(text)
    words = _WORD.findall(text)
    n[_AT["blanks"]] = len(text) - sum(map(len, tokens))
    if not text.isascii() or _SIGNS.search(text):
        symbols = len(_SYMBOL.findall(text))
        if symbols:  # frames are among them
            n[_AT["symbols"]] = symbols
            n[_AT["frames"]] = len(_FRAMES.findall(text))
        if "<" in text or "&" in text:
            n[_AT["tags"]] = len(_TAG.findall(text))
    n[_AT["tabs"]] = text.count("\t")
    n[_AT["semicolons"]] = text.count(";")
    first_word = last_word = 0
    word_chars = common = repeated = pairs = letters_n = capitals = digits = vowels = latin = cyrillic = 0
    bits = 0.0
    for w in words:
        mark, size, known, pair_n, pair_bits, l, u, d, v, la, cy = letters.word(w)
        if mark == last_word:
            repeated += 1
        first_word, last_word = first_word or mark, mark
        word_chars += size
        common += known
        pairs += pair_n
        bits += pair_bits
        letters_n += l
        capitals += u
        digits += d
        vowels += v
        latin += la
        cyrillic += cy
    for name, value in zip(("words", "word_chars", "common_words", "repeated_words", "letter_pairs", "pair_bits", "letters", "uppercase", "digits", "vowels", "latin", "cyrillic"), (len(words), word_chars, common, repeated, pairs, bits, letters_n, capitals, digits, vowels, latin, cyrillic)):
        n[_AT[name]] = value
    if "  " in text or "\xa0" in text:
        n[_AT["wide_gaps"]] = len(_GAP.findall(text))
    first = last = -1
    for t in tokens:
        k = letters.token(t)
        if k or last:
            _count_pair(n, last, k)
        first, last = k if first < 0 else first, k
        if k == NUMBER:
            n[_AT["numbers"]] += 1
        elif k == ENUMERATOR:
            n[_AT["enumerators"]] += 1
        elif k == PIPE:
            n[_AT["pipes"]] += 1
        elif k == OTHER and len(t) >= 16 and _CODE.match(t):
            n[_AT["codes"]] += 1
    n[_AT["tokens"]] = len(tokens)
    lines = [_line(x) for x in text.split("\n")]
    for x in lines[1:-1]:
        _count_line(n, x)
    return [n, lines[0], lines[-1], len(lines) > 1, first, last, first_word, last_word]


def _line(text: str) -> list:
    got = _TOKEN.search(text)
    end = text.rstrip()
    return [int(got is not None), token_class(got.group()) if got else -1, int(bool(end) and (end[-1] in _ENDS or end.rstrip(_CLOSERS)[-1:] in _ENDS)), text.count(";"), text.count("\t")]


def _join_lines(a: list, b: list) -> list:
    return [a[0] | b[0], a[1] if a[0] else b[1], b[2] if b[0] else a[2], a[3] + b[3], a[4] + b[4]]


def _count_line(n: list, line: list) -> None:
    if line[0]:
        n[_AT["lines"]] += 1
        n[_AT["ended_lines"]] += line[2]
        n[_AT["bullet_lines"]] += line[1] in (BULLET, ENUMERATOR, DASH)
        n[_AT["cell_lines"]] += line[3] >= 2 or line[4] >= 1


def _count_pair(n: list, a: int, b: int) -> None:
    if b == NUMBER:
        if a == NUMBER:
            n[_AT["number_pairs"]] += 1
        elif a == DASH:
            n[_AT["amounts"]] += 1
        elif a == COLON:
            n[_AT["prices"]] += 1


def merge(a: list, b: list) -> list:
    """The partial of two neighbouring stretches of text; associative. Cuts go through no token, so what they hid is a line, a pair of tokens or a repeated word."""
    n = [x + y for x, y in zip(a[0], b[0])]
    if a[5] >= 0 and b[4] >= 0:
        _count_pair(n, a[5], b[4])
    if a[7] and a[7] == b[6]:
        n[_AT["repeated_words"]] += 1
    # without a line break in a stretch its only line is both its first and its last
    joined = _join_lines(a[2], b[1])
    first = a[1] if a[3] else joined
    last = b[2] if b[3] else joined
    if a[3] and b[3]:
        _count_line(n, joined)
    pick = lambda x, y, none: x if x != none else y
    return [n, first, last, a[3] or b[3], pick(a[4], b[4], -1), pick(b[5], a[5], -1), pick(a[6], b[6], 0), pick(b[7], a[7], 0)]


def finish(state: list) -> dict[str, float]:
    """The counts of a whole text."""
    n = list(state[0])
    _count_line(n, state[1])
    if state[3]:
        _count_line(n, state[2])
    return dict(zip(COUNTS, n))


#: Fixed thresholds of the rules.
LOW_LETTERS, HIGH_REPEAT, LOW_VOWELS, UNLIKELY = 0.5, 0.6, 0.36, -3.9


def kind(c: dict[str, float]) -> str:
    """`junk`, `table`, `list` or `prose`, from the counts of a text."""
    solid = max(1.0, c["chars"] - c["blanks"])
    words, tokens = max(1.0, c["words"]), max(1.0, c["tokens"])
    if c["letters"] + c["digits"] == 0:
        return "junk"
    if c["frames"] >= 4 or c["pipes"] >= 2 and c["numbers"] >= 1 or c["pipes"] >= 3:
        return "table"
    if c["tags"] >= 2 and c["tags"] * 4 >= c["words"] or c["codes"] and c["codes"] * 2 >= tokens:
        return "junk"
    if c["cell_lines"] >= 2 and c["cell_lines"] >= c["lines"] - 1 and not c["ended_lines"] or c["tabs"] >= 2 and c["numbers"] >= 2 and not c["ended_lines"]:
        return "table"
    if c["number_pairs"] >= 2 and c["numbers"] * 2 >= tokens or c["wide_gaps"] >= 2 and c["numbers"] * 2 >= tokens:
        return "table"
    if c["words"] >= 4 and c["repeated_words"] >= HIGH_REPEAT * (words - 1):
        return "junk"
    if c["symbols"] > 0.2 * solid:
        return "junk"
    if c["bullet_lines"] >= 2 and c["bullet_lines"] >= c["lines"] - 1 or c["enumerators"] >= 3:
        return "list"
    if c["amounts"] >= 2 and c["amounts"] * 9 >= tokens or c["prices"] >= 2 and c["prices"] * 6 >= tokens:
        return "list"
    if c["latin"] >= 12 and c["latin"] >= 0.9 * c["letters"] and c["letter_pairs"]:
        likely = c["pair_bits"] / c["letter_pairs"]
        if likely < UNLIKELY or likely < UNLIKELY + 0.5 and c["vowels"] < LOW_VOWELS * c["letters"] and not c["common_words"]:
            return "junk"
    return "prose"


def marks_as_letters(text: str) -> str:
    """Composed form: vowel signs of Indic scripts count as letters."""
    return unicodedata.normalize("NFC", text)


def count_text(text: str, letters: Letters) -> dict[str, float]:
    return finish(partial(text, letters))


#: Where a text may be cut: behind a single blank or line break between two tokens.
_CUT = regex.compile(r"(?<=\S)[ \n](?=\S)")
_BRACKET = regex.compile(r"[<>]")


def chunks(text: str, size: int) -> list[str]:
    """Pieces of about `size` characters, cut at the first place behind that where no token, gap or tag is cut in two; a text without such a place stays whole."""
    out, at = [], 0
    while len(text) - at > size:
        # an open tag reaches at most 203 characters
        cut = next((m.end() for m in _CUT.finditer(text, at + size) if not (open_ := _BRACKET.findall(text, max(at, m.end() - 203), m.end())) or open_[-1] == ">"), None)
        if cut is None:
            break
        out.append(text[at:cut])
        at = cut
    out.append(text[at:])
    return out


_STATE = "key string, print bigint, chunk int, of int, counts array<double>, head array<int>, tail array<int>, broken boolean, tokens array<int>, prints array<bigint>"
_STATE_NAMES = [x.split()[0] for x in _STATE.split(", ")]
_KINDS = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int64())]


def _rows(states: list[tuple]) -> pa.RecordBatch:
    flat = [(k, p, i, of, s[0], s[1], s[2], s[3], [s[4], s[5]], [s[6], s[7]]) for k, p, i, of, s in states]
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in flat], _KINDS[j]) for j in range(10)], _STATE_NAMES)


def _partials(held, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters(*held.value)
        for batch in batches:
            states = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = chunks(marks_as_letters(text), size)
                mark = text_print(text)
                states += [(key, mark, i, len(parts), partial(p, letters)) for i, p in enumerate(parts)]
            yield _rows(states)

    return run


def _merge_group(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
    state = None
    for r in rows:
        one = [r["counts"], r["head"], r["tail"], r["broken"], *r["tokens"], *r["prints"]]
        state = one if state is None else merge(state, one)
    return pa.Table.from_batches([_rows([(rows[0]["key"], rows[0]["print"], rows[0]["chunk"] // FAN, -(-rows[0]["of"] // FAN), state)])])


def sample(df: DataFrame, columns: list[Column], key: Column, rows: int) -> list:
    """One row for each of the `rows` distinct keys with the smallest hashes, in their order; of rows with one key that with the smallest values. Only hashes are sorted.

    The caller bounds the characters of a text with `sample_text`, so what comes to the driver has a bound.
    """
    h = F.xxhash64(key)
    edge = df.select(h.alias("h")).distinct().orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    if edge is None:
        return []
    picked = df.where(h <= F.lit(edge)).groupBy(h.alias("h")).agg(F.min(F.struct(*columns)).alias("r")).collect()
    return [r["r"] for r in sorted(picked, key=lambda r: r["h"])]


def sample_text(column: str, chars: int = SAMPLE_CHARS) -> Column:
    """A text to learn from: at most `chars` characters of it. Texts that are judged are read whole."""
    return F.left(F.col(column), F.lit(chars)).alias(column)


def once(df: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """The text of each key, `text`, to learn from; of rows with one key the smallest text."""
    rows = df.where(F.col(key_col).isNotNull() & (F.length(text_col) > 0))
    return rows.groupBy(F.col(key_col).alias("key")).agg(F.min(text_col).alias("text")).select("text")


#: Distinct words, groups and the like that a task counts before it passes its counts on.
HELD = 500_000


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: Counter = Counter()
    for batch in batches:
        for text in batch.column(0):
            word_counts([text.as_py()], words)
            if len(words) > HELD:
                yield counted(letter_pairs(words))
                words.clear()
    yield counted(letter_pairs(words))


def counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["item", "n"])


def learn(df: DataFrame, key_col: str, text_col: str, common: list[str]) -> Letters:
    """Letters from the whole text of each key; the driver gets one row for each pair of letters."""
    pairs = once(df, key_col, text_col).mapInArrow(_pairs, "item string, n bigint").groupBy("item").agg(F.sum("n").alias("n"))
    return Letters.of({r["item"]: r["n"] for r in pairs.collect()}, common)


KIND_NAMES = ("prose", "list", "table", "junk")


_DONE = "key string, print bigint, code int, " + ", ".join(f"{n} double" for n in COUNTS)


def _done(keys, prints, counts: list[dict[str, float]]) -> pa.RecordBatch:
    m = np.array([list(c.values()) for c in counts], dtype=np.float64).reshape(len(counts), len(COUNTS))
    codes = pa.array([KIND_NAMES.index(kind(c)) for c in counts], pa.int32())
    return pa.RecordBatch.from_arrays([keys, prints, codes, *(pa.array(m[:, j]) for j in range(len(COUNTS)))], ["key", "print", "code", *COUNTS])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        states = batch.select(["counts", "head", "tail", "broken"]).to_pylist()
        yield _done(batch.column("key"), batch.column("print"), [finish([r["counts"], r["head"], r["tail"], r["broken"]]) for r in states])


def _whole(held):
    """Partial and finish of texts that are all within one chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters(*held.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield _done(batch.column(0), pa.array(map(text_print, texts), pa.int64()), [count_text(marks_as_letters(t), letters) for t in texts])

    return run


def statistics(df: DataFrame, key_col: str, text_col: str, letters: Letters, chunk: int = CHUNK) -> DataFrame:
    """One row for each key with a text: its kind and its counts. Of rows with one key that with the smallest print of its text counts.

    A text within one chunk is settled where it is read; of longer ones the chunks' partials are merged in a tree of aggregations, whose
    groups have at most `FAN` rows. Texts are not shuffled: rows delivered twice are counted twice and the results are reduced to one, column by column, so that unused ones are pruned.
    """
    held = df.sparkSession.sparkContext.broadcast((letters.table, letters.common))
    rows = df.where(F.col(key_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(key_col).cast("string").alias("key"), F.col(text_col).alias("text"))
    size = F.length("text")
    states = rows.where(size > chunk).mapInArrow(_partials(held, chunk), _STATE)
    # a row delivered twice gives its chunks twice
    states = states.dropDuplicates(["key", "print", "chunk"])
    parts = MOST_CHARS // chunk
    while parts > 1:
        parts = -(-parts // FAN)
        states = states.groupBy("key", "print", F.floor(F.col("chunk") / FAN).alias("branch")).applyInArrow(_merge_group, _STATE)
    done = rows.where(size <= chunk).mapInArrow(_whole(held), _DONE).unionAll(states.mapInArrow(_finish, _DONE))
    one = done.groupBy("key").agg(*(F.min_by(n, "print").alias(n) for n in ("code", *COUNTS)))
    return one.select("key", F.element_at(F.array(*map(F.lit, KIND_NAMES)), F.col("code") + 1).alias("kind"), *COUNTS)


def ratios(stats: DataFrame) -> DataFrame:
    """The shares asked for, rounded to six digits; of texts without words or lines they are 0."""
    share = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    c = F.col
    solid = c("chars") - c("blanks")
    return stats.select(
        "key", "kind", c("chars").cast("bigint").alias("char_count"), c("words").cast("bigint").alias("word_count"), c("letters").cast("bigint").alias("letter_count"),
        share(c("word_chars"), c("words")).alias("mean_word_length"), share(c("symbols"), solid).alias("symbol_ratio"), share(c("digits"), solid).alias("digit_ratio"),
        share(c("uppercase"), c("letters")).alias("uppercase_ratio"), share(c("ended_lines"), c("lines")).alias("ended_line_ratio"), share(c("common_words"), c("words")).alias("common_word_ratio"),
        share(c("repeated_words"), c("words")).alias("repeated_word_ratio"), share(c("bullet_lines"), c("lines")).alias("bullet_line_ratio"), share(c("numbers"), c("tokens")).alias("number_token_ratio"),
        share(c("latin"), c("letters")).alias("latin_ratio"), share(c("cyrillic"), c("letters")).alias("cyrillic_ratio"),
    )
