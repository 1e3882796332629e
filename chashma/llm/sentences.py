"""Sentences of texts in spaced and spaceless scripts, as offsets into the text.

Every place where a sentence may end is a node of a lattice: a run of terminators with the quotes and
brackets that close behind it, or, in spaceless scripts, a blank between two words. An edge is a sentence from
one node to a later one. A node's price tells what stands before and behind it (abbreviation, initial,
title, number, capital, blank, reporting words) and in how many quotations it lies; an edge's price, whether it is
more than a conjunction before dots. Opening and closing quotes are matched over the whole text, and a mark without a match counts for nothing.
A quotation with words of its sentence before or behind it has no end inside, however long it is; in one that stands
alone an end costs `INSIDE`. The cheapest path gives the sentences.

Spaceless scripts: a dictionary of the corpus' frequent character groups gives a word lattice, the best path
through it gives words; how often a word opens and ends a sentence or follows closed speech decides at blanks and behind closing quotes.
Groups and words are counted over the whole texts of all keys that have such a script; the driver gets the groups met `LEAST` times and more.

Defined cases: null, empty and blank texts have no sentence; lists, tables and junk are split by the same rules, and marked as no prose; text without a letter or digit after the last end belongs to
the sentence before; a text without ends is one sentence; offsets count code points; texts are read whole.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from math import log

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chashma.llm import quality
from chashma.llm.quality import Letters, count_text, counted, learn, marks_as_letters, once, text_print
from chashma.llm.quality import kind as kind_of
from chashma.llm.scripts import settle

#: A group of characters met less often is no word of its own.
LEAST = 5
_HAN = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
_RUN = regex.compile(rf"[{_HAN}]+")
#: For Spark: has every text of `_HAN`, and some others.
_MAYBE_SPACELESS = r"[\u0E00-\u1FFF\u2E80-\x{10FFFF}]"
_END = regex.compile(rf"[.!?…।॥؟。！？．｡]+(?:[»”\"'’)\]）］」』›]|“(?![\p{{L}}\p{{N}}]))*|(?<=[{_HAN}])[ \t\n　]+(?=[{_HAN}])")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}'`´‘’ʻʼ‐‑-]+")
_INVISIBLE = regex.compile(r"\p{Cf}")
_TEXT = regex.compile(r"[\p{L}\p{N}]")
_MARKS = regex.compile(r"['`´‘’ʻʼ‐‑-]")
_OPENING = "«“„\"‘'‹「『(（[—–- "
#: Closing quotes, and what may have opened them; `“` also opens.
_CLOSES = {"»": "«", "”": "“„", "“": "„", "」": "「", "』": "『", "›": "‹"}
_QUOTE = regex.compile(r"[«»“”„「」『』‹›\"]")
_ALONE = frozenset(".!?…।॥؟。！？．｡;\n")
_HARD = "।॥؟。！？｡"
_SPACELESS = regex.compile(rf"[{_HAN}]")

# Abbreviations by what may stand behind them, in lower case and without marks.
#: Always more of the sentence follows.
TITLES = frozenset("prof dots dotsent akad проф дотс доц доцент акад mr mrs ms dr vs st jr fig no gen col sgt rev hon им ул д кв тел qar қар sayin av dok gov sen rep inc ltd co dr-r".split())
#: More follows unless a new sentence is plain; a capital may be a name.
UNITS = frozenset("e.g i.e y yil г гг й sh ш t т mln млн mlrd млрд ming тыс kv кв sm см km км kg кг m м b б bet бет стр гл n р ж ғ қ а э ч v viloyat".split())
#: May end a sentence, if a capital follows.
LISTS = frozenset("h.k ҳ.к х.к b т.д т.п т.е др проч etc vb v.b vs.b p.m a.m руб сум so'm сўм ва ҳ.к u.s".split()) - {"b", "ва"}
#: Conjunctions that may stand alone before dots.
CONJUNCTIONS = frozenset(
    "va ammo lekin biroq chunki garchi bundan tashqari shuning uchun shu sababli natijada balki yoki hamda demak ва аммо лекин бироқ чунки гарчи бундан ташқари шунинг учун шу сабабли натижада балки ёки ҳамда демак "
    "но а и однако зато потому что поэтому или да and but because so or yet however however ve ama fakat çünkü ancak veya және бірақ өйткені сондықтан вале аммо зеро чунки пас".split()
)
_SHORT = 5


def _plain(word: str) -> str:
    return settle(word).lower().strip("'-‐‑")


STARTS, OTHERS, FINALS, INNER = "s", "o", "f", "i"


def count_groups(text: str, grams: Counter) -> None:
    """Adds the groups of one to four characters in the runs of a text."""
    for m in _RUN.finditer(text):
        r = m.group()
        for n in (1, 2, 3, 4):
            grams.update(r[i : i + n] for i in range(len(r) - n + 1))


class Gaps:
    """What words do at sentence ends in spaceless scripts, counted in texts."""

    def __init__(self, words: dict[str, float], opens: dict[str, float], ends: dict[str, float]):
        self.words, self.opens, self.ends = words, opens, ends

    @classmethod
    def learn(cls, texts: list[str]) -> Gaps:
        grams, places = Counter(), Counter()
        for t in texts:
            count_groups(t, grams)
        self = cls.of_groups(grams)
        for t in texts:
            self.count_places(t, places)
        return self.with_places(places)

    @classmethod
    def of_groups(cls, grams: dict[str, int]) -> Gaps:
        """From how often each character was met, and each group of two to four that was met `LEAST` times or more."""
        total = sum(n for g, n in grams.items() if len(g) == 1) or 1
        # a group is a word if its characters meet far more often than by chance
        words = {}
        for g, n in grams.items():
            if len(g) == 1 or n >= LEAST and log(n / total) > 0.9 * sum(log(grams[c] / total) for c in g) + len(g) - 1:
                words[g] = log(n / total) - 0.5
        return cls(words, {}, {})

    def count_places(self, text: str, places: Counter) -> None:
        """Adds the words of a text, each behind a sign for its place: first of a sentence or not, last or not."""
        for m in _RUN.finditer(text):
            spelt = self.segment(m.group())
            at = m.start()
            while at and text[at - 1].isspace():
                at -= 1
            before, behind = text[at - 1 : at] if at else "", text[m.end() : m.end() + 1]
            places[(STARTS if not before or before in "。！？!?.．" else OTHERS) + spelt[0]] += 1
            places.update(OTHERS + w for w in spelt[1:])
            places[(FINALS if behind and behind in "。！？!?.．" else INNER) + spelt[-1]] += 1
            places.update(INNER + w for w in spelt[:-1])

    def with_places(self, places: dict[str, int]) -> Gaps:
        share = lambda a, b: {p[1:]: log((places.get(a + p[1:], 0) + 0.5) / (places.get(b + p[1:], 0) + 0.5)) for p in places if p[0] in a + b}
        return Gaps(self.words, share(STARTS, OTHERS), share(FINALS, INNER))

    def segment(self, run: str) -> list[str]:
        """The best path through the lattice of known words."""
        n = len(run)
        best, back = [0.0] + [-1e9] * n, [0] * (n + 1)
        for i in range(n):
            for k in range(1, min(4, n - i) + 1):
                score = self.words.get(run[i : i + k], -18.0 if k == 1 else None)
                if score is not None and best[i] + score > best[i + k]:
                    best[i + k], back[i + k] = best[i] + score, i
        out, i = [], n
        while i:
            out.append(run[back[i] : i])
            i = back[i]
        return out[::-1]

    def opening(self, text: str) -> float:
        m = regex.match(rf"[«“„「『\"\s]*([{_HAN}]{{1,12}})", text)
        return self.opens.get(self.segment(m.group(1))[0], -0.5) if m else -1.0

    def ending(self, text: str) -> float:
        m = regex.search(rf"([{_HAN}]{{1,12}})\W*$", text)
        return self.ends.get(self.segment(m.group(1))[-1], -0.5) if m else -1.0


def _node(text: str, start: int, stop: int, gaps: Gaps) -> float | None:
    """Price of ending a sentence at text[start:stop]; negative if likely, None if out of the question."""
    run = text[start:stop]
    ahead = _INVISIBLE.sub("", text[stop : stop + 60])
    body = ahead.lstrip()
    blank = len(body) < len(ahead)
    if not run.strip():  # a blank between words of a spaceless script
        return 1.5 - gaps.ending(text[max(0, start - 14) : start]) - gaps.opening(text[stop : stop + 14])
    signs = run.rstrip("»”“\"'’)]）］」』›")
    closed = run[len(signs) :]
    quoted = any(c in "»”“\"」』›" for c in closed)
    inner = body.lstrip(_OPENING)
    first = inner[:1]
    dash = body[:1] in "—–" or body[:2] == "- "
    if _SPACELESS.match(first) or _SPACELESS.search(text[max(0, start - 1) : start]):
        if not any(c in "。！？!?.．｡…" for c in signs):
            return None
        return -0.4 - gaps.opening(text[stop : stop + 14]) if quoted and _SPACELESS.match(first) else -4.0
    upper, lower, digit = first.isupper(), first.islower(), first.isdigit()
    caseless = first.isalpha() and not upper and not lower
    if dash and (quoted or lower):
        return None
    if any(c in _HARD for c in signs):
        return None if quoted and lower else -4.0
    if not (upper or lower or digit or caseless):
        return None
    if quoted and lower:
        return None
    dots = signs.endswith("...") or "…" in signs or signs.endswith("..")
    if any(c in "!?" for c in signs):
        if not blank and not (upper and text[max(0, start - 1) : start].isalpha()) and not closed:
            return None
        return -2.0 if lower else -3.5
    if dots:
        return (-2.0 if lower else -3.0) if blank or upper else None
    # a single full stop (also full-width)
    m = regex.search(r"[^\s«“„\"(\[]+$", text[max(0, start - 30) : start])
    word = _plain(m.group()) if m else ""
    raw = m.group() if m else ""
    tail = word.rpartition(".")[2] if "." in word else word
    follows = _WORD.match(inner)
    after = follows.group() if follows else ""
    if not blank and not closed:
        # a lost blank: a word before, a capitalised word behind
        letters = _MARKS.sub("", after)
        whole = len(letters) > 1 and (letters[1].islower() or letters.isupper()) or len(letters) == 1 and inner[len(after) : len(after) + 1].isspace()
        if upper and whole and len(tail) > 2 and _MARKS.sub("", tail).isalpha() and "." not in word and raw[-1].islower() and word not in TITLES | UNITS:
            return -2.0
        if word in LISTS and upper and whole:
            return -1.0
        return None
    if word in TITLES or tail in TITLES and "." in word and word not in LISTS:
        return None
    if regex.fullmatch(r"\p{Lu}|Sh|Ch|Sh'|O['ʻ‘’`]|G['ʻ‘’`]|Ш|Ч|Ю|Я|Yo|Yu|Ya|Ts|[\p{Lu}](\.\p{Lu})+", settle(raw)):
        return None
    listed = word in LISTS
    if listed or tail in UNITS or word in UNITS or regex.search(r"\d[-‐‑]?\p{L}{1,2}$", raw):
        if closed or lower or digit or dash:
            return None
        return -2.0 if listed else 2.0
    if start < 20 and word.isdigit() and not text[:start].rstrip(word).strip():
        return None  # a number that opens the text
    if ")" in closed and lower:
        return None
    if lower:
        return -1.5
    return -4.0


#: Characters of a sentence that its edge price looks at, and what an end costs inside a quotation that stands alone.
HEAD, INSIDE = 120, 1.0


def quotations(text: str) -> list[tuple[int, int, bool]]:
    """(opening mark, closing mark, whether words of its sentence stand before or behind it) of each matched quotation."""
    held: list[tuple[str, int]] = []
    out = []
    for m in _QUOTE.finditer(text):
        mark, at = m.group(), m.start()
        if mark == '"':
            blank_before, blank_behind = not text[at - 1 : at].strip() if at else True, not text[at + 1 : at + 2].strip()
            opened = '"' if any(q == '"' for q, _ in held) and not (blank_before and not blank_behind) else ""
            if not opened and blank_behind:
                continue  # closes nothing, as the mark of an inch
        else:
            opened = next((q for q, _ in reversed(held) if q in _CLOSES.get(mark, "")), "")
            if not opened and mark in _CLOSES and mark != "“":
                continue
        if not opened:
            held.append((mark, at))
            continue
        while (top := held.pop())[0] != opened:
            pass
        out.append((top[1], at, _embedded(text, top[1], at)))
    return out


def _embedded(text: str, start: int, stop: int) -> bool:
    """Whether a quotation is part of a sentence that goes on outside of it."""
    before = text[:start].rstrip(" \t") if start < 200 else text[start - 200 : start].rstrip(" \t")
    if before and before[-1] not in _ALONE and before[-1] not in "»”」』›)]\"":
        return True
    behind = text[stop + 1 : stop + 60].lstrip(" \t")
    return bool(behind) and (behind[0] in ",،，—–:" or behind[:2] == "- " or behind[0].islower())


def nodes_of(text: str, gaps: Gaps) -> list[tuple[int, float]]:
    """(offset, price) of the places where a sentence may end, with both ends of the text."""
    nodes = [(0, 0.0)]
    for m in _END.finditer(text):
        price = _node(text, m.start(), m.end(), gaps)
        if price is not None and _TEXT.search(text, m.end()):
            nodes.append((m.end(), price))
    pairs = quotations(text) if len(nodes) > 1 else ()
    if pairs:
        stops = [stop for stop, _ in nodes]
        inside, shut = [0] * (len(nodes) + 1), [0] * (len(nodes) + 1)
        for a, b, embedded in pairs:
            change = shut if embedded else inside
            change[bisect_right(stops, a)] += 1
            change[bisect_right(stops, b)] -= 1
        depth = [*zip(accumulate(inside), accumulate(shut))]
        nodes = [(stop, price + INSIDE * depth[i][0]) for i, (stop, price) in enumerate(nodes) if not i or not depth[i][1]]
    return [*nodes, (len(text), 0.0)]


def starts(text: str, gaps: Gaps) -> list[int]:
    """Offsets of the first characters of all sentences of a text."""
    nodes = nodes_of(text, gaps)
    best, back = [0.0] + [1e9] * (len(nodes) - 1), [0] * len(nodes)
    far, near = (1e9, 0), 0  # the best of the nodes whose whole head lies behind
    for j in range(1, len(nodes)):
        stop, price = nodes[j]
        while nodes[near][0] + HEAD <= stop and near < j:
            far = min(far, (best[near] + _edge(text[nodes[near][0] : nodes[near][0] + HEAD]), near))
            near += 1
        found = far
        for i in range(near, j):
            if best[i] < found[0]:
                cost = best[i] + _edge(text[nodes[i][0] : stop])
                if cost < found[0]:
                    found = cost, i
        best[j], back[j] = found[0] + price, found[1]
    cuts, j = [], len(nodes) - 1
    while j:
        j = back[j]
        cuts.append(nodes[j][0])
    out = []
    for at in reversed(cuts):
        while at < len(text) and (text[at].isspace() or _INVISIBLE.match(text[at])):
            at += 1
        if at < len(text):
            out.append(at)
    return out


def _edge(head: str) -> float:
    """Price of a sentence for its first words: none, or a conjunction before dots and nothing more."""
    words = _WORD.findall(head)
    if not words:
        return 6.0
    end = head.rstrip()
    return 6.0 if len(words) <= _SHORT and (end.endswith("...") or end.endswith("…")) and _plain(words[0]) in CONJUNCTIONS else 0.0


def _counts(count):
    """Sums over the texts of a task; `count` adds those of one text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                count(text.as_py(), counts)
                if len(counts) > quality.HELD:
                    yield counted(counts)
                    counts.clear()
        yield counted(counts)

    return run


def learn_gaps(df: DataFrame, key_col: str, text_col: str) -> Gaps:
    """Gaps from the whole text of each key; two passes over the texts that may be in a spaceless script."""
    texts = once(df.where(F.col(text_col).rlike(_MAYBE_SPACELESS)), key_col, text_col)

    def summed(count) -> DataFrame:
        return texts.mapInArrow(_counts(count), "item string, n bigint").groupBy("item").agg(F.sum("n").alias("n"))

    of_groups = Gaps.of_groups({r["item"]: r["n"] for r in summed(count_groups).where((F.length("item") == 1) | (F.col("n") >= LEAST)).collect()})
    held = df.sparkSession.sparkContext.broadcast(of_groups.words)
    return of_groups.with_places({r["item"]: r["n"] for r in summed(lambda text, places: Gaps(held.value, {}, {}).count_places(text, places)).collect()})


def _split(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = held.value
        gaps, letters = Gaps(*value["gaps"]), Letters(*value["letters"])
        for batch in batches:
            keys, prints, prose, spans = batch.column(0), [], [], []
            for text in batch.column(1).to_pylist():
                prints.append(text_print(text))
                prose.append(bool(text.strip()) and kind_of(count_text(marks_as_letters(text), letters)) == "prose")
                at = starts(text, gaps) if prose[-1] or not value["prose_only"] else []
                spans.append([{"start_char": a, "end_char": a + len(text[a:b].rstrip())} for a, b in zip(at, at[1:] + [len(text)])])
            columns = [keys, pa.array(prints, pa.int64()), pa.array(prose, pa.bool_()), pa.array(spans, pa.list_(pa.struct([("start_char", pa.int32()), ("end_char", pa.int32())])))]
            names = ["key", "print", "prose", "spans"]
            if batch.num_columns > 2:
                columns, names = [*columns, batch.column(2)], [*names, "text"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def sentences(df: DataFrame, key_col: str, text_col: str, with_text: bool = True, prose_only: bool = False) -> DataFrame:
    """One row for each sentence of each text (or of prose only): its number and offsets, whether its text is prose, and its own text unless that is not asked for.

    Rows delivered twice count once, with the smallest print of a text; without `with_text` only offsets are shuffled for it.
    """
    letters, gaps = learn(df, key_col, text_col, []), learn_gaps(df, key_col, text_col)
    held = df.sparkSession.sparkContext.broadcast({"gaps": (gaps.words, gaps.opens, gaps.ends), "letters": (letters.table, letters.common), "prose_only": prose_only})
    rows = df.where(F.col(key_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(key_col).cast("string").alias("key"), F.col(text_col).alias("text"), *([F.col(text_col).alias("kept")] if with_text else []))
    spans = "array<struct<start_char:int,end_char:int>>"
    found = rows.mapInArrow(_split(held), f"key string, print bigint, prose boolean, spans {spans}" + ", text string" * with_text)
    told = F.struct("prose", "spans", *(["text"] if with_text else []))
    one = found.groupBy("key").agg(F.min_by(told, "print").alias("r"))
    each = one.select("key", "r.prose", *(["r.text"] if with_text else []), F.posexplode("r.spans").alias("sentence", "s"))
    own = [F.substring("text", F.col("s.start_char") + 1, F.col("s.end_char") - F.col("s.start_char")).alias("text")] if with_text else []
    return each.select("key", "prose", "sentence", "s.*", *own)
