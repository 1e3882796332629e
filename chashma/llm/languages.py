"""The language of each text and of each segment of a mixed one, by cross-parsing entropy.

Of each language a suffix automaton is built from running labelled sentences. A text is parsed into the fewest phrases
that stand in a language's text, longest match first and over the borders of words; the language that needs the fewest
phrases, each weighed with the bits that tell its place in the learnt text, wins. Words that begin with a capital inside a
sentence are names and are left out of the parse. A phrase's cost lies where the phrase begins, so each word has a cost in each
language, and over the words of a text the cheapest path through the languages, with a price for each change, gives its segments;
a segment counts if it is a clause: enough words and enough phrases saved. The parse begins anew every `PIECE` words.

The automata are arrays, built once and sent to the workers; all texts of a batch are parsed side by side.

Training: all labelled rows. Labels are often wrong, so a sentence may teach a language only if its common words agree with the label
and, as the sentences are in two halves, the fit of the other half does. Of each word of a language that sentence is learnt which
has the smallest print of those that may teach, so a model knows every word, grows with the vocabulary and not with the rows, and a text delivered twice changes nothing.

Defined cases: null, empty and wordless texts are `und` with confidence 1; a label's script suffix and letter case do
not matter, blank, `und` and `xx` are no label; rows delivered twice count once; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, log2

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chashma.llm import quality
from chashma.llm.quality import Letters, count_text, learn, marks_as_letters, text_print
from chashma.llm.quality import kind as kind_of
from chashma.llm.scripts import settle
from chashma.llm.sentences import TITLES

PIECE, LANES = 64, 4096
SWITCH, LEAST_WORDS, LEAST_GAIN, MOST_COST = 3.0, 3, 3.5, 4.0
#: What costs 1: the bits of a place in 60,000 characters.
UNIT = log2(60_002)
UNKNOWN = "und"
NO_LABEL = ("", "und", "xx")
_TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}\p{Cf}'`´‘’ʻʼʹ′]+")
_SPACELESS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")
_LETTER = regex.compile(r"\p{L}")
_BEFORE_DOT = regex.compile(r"(?<!\p{L})(\p{L}+)\.$")
_OPENS = frozenset(".!?…।؟。！？．:\n\"«“")


class Automaton:
    """Suffix automaton of a text: all of its substrings, in time and space linear in its length, as arrays.

    A state with one way out has its character in `only` and the next state in `then`; one with several has a row of `table`, or,
    in a text of more than `WIDE` characters, whose rows are long and nearly empty, its ways in `ways` at the sorted `keys`.
    """

    WIDE = 256

    def __init__(self, text: str):
        nxt: list[dict[str, int]] = [{}]
        link, size, last = [-1], [0], 0
        for c in text:
            cur = len(nxt)
            nxt.append({})
            size.append(size[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if size[p] + 1 == size[q]:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    size.append(size[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        letters = sorted(set(text))
        code = {c: k + 1 for k, c in enumerate(letters)}
        #: Code of each character; 0 for those that the text does not have, which no state leads on with.
        self.codes = np.zeros(1 << 16, np.uint16)
        plain = [c for c in letters if ord(c) < 0xFFFF]
        self.codes[[ord(c) for c in plain]] = [code[c] for c in plain]
        self.only, self.then, self.row = np.zeros(len(nxt), np.uint16), np.full(len(nxt), -1, np.int32), np.zeros(len(nxt), np.int32)
        many = [s for s, out in enumerate(nxt) if len(out) != 1 or s == 0]
        self.row[many] = np.arange(1, len(many) + 1)
        self.width, self.root = len(letters) + 1, np.full(len(letters) + 1, -1, np.int32)
        for c, to in nxt[0].items():
            self.root[code[c]] = to
        if len(letters) <= self.WIDE:
            self.table = np.full((len(many) + 1, self.width), -1, np.int32)
            for k, s in enumerate(many):
                for c, to in nxt[s].items():
                    self.table[k + 1, code[c]] = to
        else:
            self.table = None
            keys = np.fromiter(((k + 1) * self.width + code[c] for k, s in enumerate(many) for c in nxt[s]), np.int64)
            order = np.argsort(keys)
            self.keys, self.ways = keys[order], np.fromiter((to for s in many for to in nxt[s].values()), np.int32)[order]
        for s, out in enumerate(nxt):
            if len(out) == 1 and s:
                ((c, to),) = out.items()
                self.only[s], self.then[s] = code[c], to

    def _ways(self, row: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Where the states of these rows lead to with these characters, -1 for nowhere."""
        if self.table is not None:
            return self.table.ravel()[row * self.width + c]
        key = row.astype(np.int64) * self.width + c
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ways[at], -1)

    def begins(self, codes: np.ndarray, at: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Where phrases begin in stretches `codes[at : at + lens]`, the longest of which come first: positions in `codes`."""
        found = []
        state = np.zeros(len(at), np.int32)
        for t in range(int(lens[0]) if len(lens) else 0):
            live = int(np.searchsorted(-lens, -t, "left"))  # stretches longer than t
            place, s = at[:live] + t, state[:live]
            c = codes[place]
            row = self.row[s]
            to = np.where(row > 0, self._ways(row, c), np.where(self.only[s] == c, self.then[s], -1))
            # a phrase also begins behind a character that the text does not have
            new = (to < 0) | (s == 0)
            found.append(place[new])
            state[:live] = np.maximum(np.where(to < 0, self.root[c], to), 0)
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def phrases(self, text: str) -> int:
        """Fewest phrases of the learnt text, or single unknown characters, that make up `text`."""
        codes = self.codes[[min(ord(c), 0xFFFF) for c in text]]
        return len(self.begins(codes, np.zeros(1, np.int64), np.array([len(codes)]))) if text else 0


def _settled(raw: str, kept: dict[str, tuple[str, bool, bool]]) -> tuple[str, bool, bool]:
    """(word in lower case, whether it counts, whether it begins with a capital); kept, as words repeat."""
    got = kept.get(raw)
    if got is None:
        word = settle(raw)
        low = word.lower().strip("'")
        got = (low if _LETTER.search(word) else "", len(word) > 1, word[:1].isupper())
        if len(raw) < 64:
            if len(kept) > 300_000:
                kept.clear()
            kept[raw] = got
    return got


def _shortened(before: str) -> bool:
    """Whether a text ends with an initial or a title, behind which a name stands."""
    m = _BEFORE_DOT.search(before)
    return bool(m) and (len(m.group(1)) == 1 and m.group(1).isupper() or m.group(1).lower() in TITLES)


def tokens(text: str, kept: dict | None = None) -> list[tuple[int, int, str, bool]]:
    """(start, end, word, counts): words of a text; spaceless scripts in pieces of four; names do not count."""
    out, kept = [], {} if kept is None else kept
    lower = not text.isupper()
    spaceless = not text.isascii() and _SPACELESS.search(text)
    for m in _TOKEN.finditer(text):
        raw, at = m.group(), m.start()
        if spaceless and _SPACELESS.search(raw):
            out += [(at + i, at + min(i + 4, len(raw)), raw[i : i + 4], True) for i in range(0, len(raw), 4)]
            continue
        word, counts, capital = _settled(raw, kept)
        if not word:
            continue
        if capital and lower:
            before = text[max(0, at - 40) : at].rstrip(" \t ([{")
            counts = counts and not (before and (before[-1] not in _OPENS or before[-1] == "." and _shortened(before)))
        out.append((at, m.end(), word, counts))
    return out


def label_of(label: str | None) -> str | None:
    """`uz` of `uz-Latn` or `UZ`; none of blank, `und` or `xx`."""
    short = (label or "").strip().lower().replace("_", "-").partition("-")[0]
    return None if short in NO_LABEL else short


def running(words: list[str]) -> tuple[str, list[int]]:
    """A text as it is parsed, and where each word with the blank before it begins; pieces of spaceless scripts have no blanks between them."""
    parts, at, size, bare = [], [], 0, False
    for w in words:
        spaceless = not w.isascii() and bool(_SPACELESS.match(w))
        part = w if spaceless and bare else " " + w
        at.append(size)
        parts.append(part)
        size += len(part)
        bare = spaceless
    return "".join(parts) + " " * bool(parts), at


class Model:
    def __init__(self, texts: dict[str, str]):
        self.languages = sorted(texts)
        self.automata = [Automaton(texts[l]) for l in self.languages]
        # the bits of a place in the learnt text, however long it is, in the unit that the prices are in
        self.weights = np.array([log2(len(texts[l]) + 2) / UNIT for l in self.languages])
        self.settled: dict[str, tuple[str, bool, bool]] = {}

    def costs(self, words: list[list[str]]) -> list[np.ndarray]:
        """Weighted phrases that begin in each word of each text, in each language, above the cheapest, at most `MOST_COST`."""
        spelt, starts, lens, firsts, sizes = [], [], [], [], []
        size = 0
        for text in words:
            for lo in range(0, len(text), PIECE):
                line, at = running(text[lo : lo + PIECE])
                spelt.append(line)
                firsts += [size + a for a in at]
                starts.append(size)
                lens.append(len(line))
                size += len(line)
            sizes.append(len(text))
        if not size:
            return [np.zeros((n, len(self.languages))) for n in sizes]
        points = np.minimum(np.frombuffer("".join(spelt).encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF).astype(np.int32)
        lens, starts, firsts = np.array(lens), np.array(starts), np.array(firsts)
        order = np.argsort(-lens, kind="stable")
        word_of = np.zeros(size, np.int32)
        word_of[firsts[1:]] = 1
        word_of = np.cumsum(word_of)
        # in a language without any letter of a stretch each character is a phrase
        alone, letters = np.bincount(word_of, minlength=len(firsts)), points != 32
        all_of = np.zeros((len(firsts), len(self.languages)))
        for j, a in enumerate(self.automata):
            codes = a.codes[points]
            meets = np.logical_or.reduceat((codes > 0) & letters, starts)
            some = order[meets[order]]
            begun = [a.begins(codes, starts[some[lo : lo + LANES]], lens[some[lo : lo + LANES]]) for lo in range(0, len(some), LANES)]
            counts = np.bincount(word_of[np.concatenate(begun)], minlength=len(firsts)) if begun else np.zeros(len(firsts))
            all_of[:, j] = np.where(meets[np.searchsorted(starts, firsts, "right") - 1], counts, alone)
        all_of *= self.weights
        all_of = np.minimum(all_of - all_of.min(axis=1, keepdims=True), MOST_COST)
        return np.split(all_of, np.cumsum(sizes)[:-1])

    def segments(self, text: str) -> list[tuple[int, int, str, float, int]]:
        return self.segments_of([text])[0]

    def segments_of(self, texts: list[str]) -> list[list[tuple[int, int, str, float, int]]]:
        """Of each text (start, end, language, confidence, counting words) of the stretches of one language; stretches too short for a clause join a neighbour."""
        words = [tokens(t, self.settled) for t in texts]
        costs = self.costs([[w for _, _, w, counts in some if counts] for some in words])
        n, sums = len(self.languages), np.zeros((len(texts), len(self.languages)))
        for i, own in enumerate(costs):
            if len(own):
                own.sum(axis=0, out=sums[i])
        if not n:
            return [[] for _ in texts]
        best = sums.argmin(axis=1)
        least = sums[np.arange(len(texts)), best]
        sure = 1 / np.exp(np.maximum(least[:, None] - sums, -50.0)).sum(axis=1)
        out = []
        for some, own, j, low, confidence in zip(words, costs, best.tolist(), least.tolist(), sure.tolist()):
            if not some:
                out.append([])
            elif low <= SWITCH:  # no path with a change in it is cheaper
                out.append([(some[0][0], some[-1][1], self.languages[j], confidence, len(own))])
            else:
                out.append(self._path(some, own))
        return out

    def _path(self, words: list[tuple[int, int, str, bool]], own: np.ndarray) -> list[tuple[int, int, str, float, int]]:
        n = len(self.languages)
        told, zero = iter(own.tolist()), [0.0] * n
        rows = [next(told) if counts else zero for _, _, _, counts in words]
        total, back = list(rows[0]), []
        for row in rows[1:]:
            best = min(range(n), key=total.__getitem__)
            change = total[best] + SWITCH
            step = [j if total[j] <= change else best for j in range(n)]
            total = [min(total[j], change) + row[j] for j in range(n)]
            back.append(step)
        path = [min(range(n), key=total.__getitem__)]
        for step in reversed(back):
            path.append(step[path[-1]])
        path.reverse()
        spans: list[list[int]] = []
        for i, j in enumerate(path):
            if spans and spans[-1][2] == j:
                spans[-1][1] = i + 1
            else:
                spans.append([i, i + 1, j])
        if len(spans) > 1:
            kept = [s for s in spans if self._clause(rows, words, s, spans)]
            if not kept:
                kept = [[0, len(words), min(range(n), key=lambda j: sum(r[j] for r in rows))]]
            kept[0][0], kept[-1][1] = 0, len(words)
            for a, b in zip(kept, kept[1:]):
                a[1] = b[0]
            spans = [kept[0]]
            for s in kept[1:]:
                if s[2] == spans[-1][2]:
                    spans[-1][1] = s[1]
                else:
                    spans.append(s)
        out = []
        for a, b, j in spans:
            sums = [sum(r[k] for r in rows[a:b]) for k in range(n)]
            confidence = 1 / sum(exp(max(-50.0, min(50.0, sums[j] - s))) for s in sums)
            out.append((words[a][0], words[b - 1][1], self.languages[j], confidence, sum(w[3] for w in words[a:b])))
        return out

    def _clause(self, rows, words, span, spans) -> bool:
        a, b, j = span
        others = {s[2] for s in spans if s[2] != j}
        gain = min(sum(r[k] - r[j] for r in rows[a:b]) for k in others) if others else 99.0
        return sum(w[3] for w in words[a:b]) >= LEAST_WORDS and gain >= LEAST_GAIN


_INNER = regex.compile(r"[.!?…。！？।؟].*[\p{L}]|[«»\"“”]", regex.S)


#: Prints have 63 bits; the first one tells the half of a sentence.
_HALF = 62


class Teachers:
    """Which texts may teach a language: single sentences of prose whose common words agree with the label."""

    def __init__(self, common: dict[str, set[str]], letters: Letters):
        self.common, self.letters = common, letters
        self.of: dict[str, list[str]] = {}
        for lang, known in common.items():
            for w in known:
                self.of.setdefault(w, []).append(lang)
        self.settled: dict[str, tuple[str, bool, bool]] = {}

    def words(self, text: str) -> list[str]:
        return [w for _, _, w, counts in tokens(text, self.settled) if counts]

    def voted(self, text: str, label: str | None) -> tuple[str, list[str]] | None:
        """(language, words) of a text whose common words agree with its label."""
        lang = label_of(label)
        if lang not in self.common or _INNER.search(text):
            return None
        words = self.words(text)
        votes = dict.fromkeys(self.common, 0)
        for w in words:
            if not w.isascii() and _SPACELESS.search(w):
                for l, known in self.common.items():
                    votes[l] += any(c in w for c in known)
            else:
                for l in self.of.get(w, ()):
                    votes[l] += 1
        return (lang, words) if votes[lang] and all(votes[lang] > v for l, v in votes.items() if l != lang) else None

    def prose(self, text: str) -> bool:
        return kind_of(count_text(marks_as_letters(text), self.letters)) == "prose"


_FIRST = "lang string, word string, half int, print bigint, text string"


def _firsts(held, wanted=None):
    """Of each language, word and half the first text that may teach it, by its print.

    With `wanted`, (words of each language, the fit of each half): of these words only, texts that the fit of the other half agrees with, and both halves together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        teachers = Teachers(held.value["common"], Letters(*held.value["letters"]))
        only, fits = wanted.value if wanted else (None, None)
        first: dict[tuple[str, str, int], tuple[int, str]] = {}

        def lacking(lang: str, words: list[str], half: int, mark: int) -> list[tuple[str, str, int]]:
            some = {w for w in words if w in only[lang]} if only else set(words) - teachers.common[lang]
            return [k for w in some if mark < first.get(k := (lang, w, half), (1 << 63,))[0]]

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"lang": l, "word": w, "half": h, "print": p, "text": t} for (l, w, h), (p, t) in first.items()], _FIRST_TYPE)

        for batch in batches:
            found = []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if only and not _may_hold(text, only.get(label_of(label)), teachers.settled):
                    continue
                got = teachers.voted(text, label)
                if got:
                    found.append((text_print(text), text, *got))
            # small prints first, as what is behind them need not be judged
            found.sort(key=lambda x: x[0])
            if only:
                found = [x for x in found if lacking(x[2], x[3], 0, x[0]) and teachers.prose(x[1])]
                agreed = _agree(fits, found)
            for i, (mark, text, lang, words) in enumerate(found):
                half = 0 if only else mark >> _HALF
                if (new := lacking(lang, words, half, mark)) and (agreed[i] if only else teachers.prose(text)):
                    first.update(dict.fromkeys(new, (mark, text)))
            if len(first) > quality.HELD:
                yield told()
                first.clear()
        yield told()

    return run


_FIRST_TYPE = pa.schema([("lang", pa.string()), ("word", pa.string()), ("half", pa.int32()), ("print", pa.int64()), ("text", pa.string())])


def _may_hold(text: str, words: set[str] | None, kept: dict) -> bool:
    """Whether a text may hold one of the words; true of some that do not."""
    return bool(words) and (not text.isascii() and bool(_SPACELESS.search(text)) or any(_settled(raw, kept)[0] in words for raw in _TOKEN.findall(text)))


def _agree(fits: list[Model], found: list[tuple[int, str, str]]) -> list[bool]:
    """Whether the fit of the other half finds the language of each (print, text, language, ...), and no other."""
    out = [False] * len(found)
    for half in (0, 1):
        own = [i for i, x in enumerate(found) if x[0] >> _HALF == half]
        for i, parts in zip(own, fits[1 - half].segments_of([found[i][1] for i in own])):
            out[i] = {p[2] for p in parts} == {found[i][2]}
    return out


def _reduced(rows: DataFrame, run) -> list[tuple[int, str, str, int, list[str]]]:
    """(print, text, language, half, words that it is the first of), by print; the driver gets at most one text for each word of a language and half."""
    each = rows.mapInArrow(run, _FIRST).groupBy("lang", "word", "half").agg(F.min(F.struct("print", "text")).alias("r"))
    return sorted(tuple(r) for r in each.groupBy("r.print", "r.text", "lang", "half").agg(F.collect_list("word")).select("print", "text", "lang", "half", "collect_list(word)").collect())


def _lines(chosen: set[tuple[int, str, str]], teachers: Teachers) -> dict[str, str]:
    """Running text of each language; the frequent words, each once, are known of every language."""
    lines = {l: ["".join(f" {w}" for w in sorted(known)) + " "] for l, known in teachers.common.items()}
    for _, text, lang in sorted(chosen):
        lines[lang].append(running(teachers.words(text))[0])
    return {l: "".join(x) for l, x in lines.items()}


def train(rows: DataFrame, common: dict[str, set[str]], letters: Letters) -> dict[str, str]:
    """Running text of each language from all rows of `text` and `label`: of each word the first sentence that may teach it, and that the fit of the other half agrees with."""
    send = rows.sparkSession.sparkContext.broadcast
    held, teachers = send({"common": common, "letters": (letters.table, letters.common)}), Teachers(common, letters)
    firsts = _reduced(rows, _firsts(held))
    fits = [Model(_lines({x[:3] for x in firsts if x[3] == half}, teachers)) for half in (0, 1)]
    chosen, words, missed = set(), set(), {l: set() for l in common}
    for x, agreed in zip(firsts, _agree(fits, firsts)):
        # the first half comes first
        new = [w for w in x[4] if (x[2], w) not in words]
        words.update((x[2], w) for w in new)
        if new and agreed:
            chosen.add(x[:3])
        elif new:
            missed[x[2]].update(new)
    if any(missed.values()):  # of these all sentences are asked
        chosen |= {x[:3] for x in _reduced(rows, _firsts(held, send((missed, fits))))}
    return _lines(chosen, teachers)


def fit(df: DataFrame, words: DataFrame, key_col: str, text_col: str, label_col: str) -> dict:
    """What workers need: learnt text of each language, and of prose (see quality). `words` has (lang, word) of frequent words."""
    common: dict[str, set[str]] = {}
    for r in words.where("lang IS NOT NULL AND word IS NOT NULL").collect():
        common.setdefault(r["lang"], set()).add(settle(r["word"]).lower())
    letters = learn(df, key_col, text_col, [w for ws in common.values() for w in ws])
    rows = df.where(F.col(key_col).isNotNull() & (F.length(text_col) > 0) & F.col(label_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(label_col).alias("label"))
    return {"model": Model(train(rows, common, letters)), "letters": (letters.table, letters.common)}


_PARTS = "array<struct<segment:int,start_char:int,end_char:int,lang:string,confidence:double,words:int>>"
_PART_TYPE = pa.list_(pa.struct([("segment", pa.int32()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("words", pa.int32())]))


def _judge(held, prose_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, letters = held.value["model"], Letters(*held.value["letters"])
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            prose = [bool(t) and kind_of(count_text(marks_as_letters(t), letters)) == "prose" for t in texts]
            asked = [i for i, p in enumerate(prose) if p or not prose_only]
            parts: list[list] = [[]] * len(texts)
            for i, found in zip(asked, model.segments_of([texts[i] for i in asked])):
                found = found or [(0, len(texts[i]), UNKNOWN, 1.0, 0)]
                parts[i] = [{"segment": k, "start_char": a, "end_char": b, "lang": lang, "confidence": c, "words": n} for k, (a, b, lang, c, n) in enumerate(found)]
            labels = pa.array([label_of(x) for x in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(text_print, texts), pa.int64()), labels, pa.array(prose, pa.bool_()), pa.array(parts, _PART_TYPE)], ["key", "print", "label", "prose", "parts"])

    return run


def segments(df: DataFrame, words: DataFrame, key_col: str, text_col: str, label_col: str, prose_only: bool = False) -> DataFrame:
    """One row for each segment of each text (or of prose only): where it is, its language and a confidence; a text without words has one, `und`.

    Texts are not shuffled: rows delivered twice are judged twice and their results reduced to one, that of the smallest print of a text.
    """
    held = df.sparkSession.sparkContext.broadcast(fit(df, words, key_col, text_col, label_col))
    rows = df.where(F.col(key_col).isNotNull()).select(F.col(key_col).cast("string").alias("key"), F.col(text_col).alias("text"), F.col(label_col).alias("label"))
    judged = rows.mapInArrow(_judge(held, prose_only), f"key string, print bigint, label string, prose boolean, parts {_PARTS}")
    one = judged.groupBy("key").agg(F.min_by(F.struct("label", "prose", "parts"), F.struct("print", "label")).alias("r"))
    return one.select("key", "r.label", "r.prose", F.inline("r.parts"))


def languages(parts: DataFrame) -> DataFrame:
    """One row for each text and language in it."""
    by = parts.groupBy("key", "lang").agg(F.max("confidence").alias("confidence"), F.sum("words").alias("words"), F.first("label").alias("label"), F.first("prose").alias("prose"))
    count = parts.groupBy("key").agg(F.count_distinct("lang").alias("languages"))
    return by.join(count, "key")


def relabelled(parts: DataFrame) -> DataFrame:
    """Of prose in one language that whose label is missing or names another; of mixed prose every language."""
    told = parts.where("prose AND lang != 'und'")
    return languages(told).where("languages > 1 OR label IS NULL OR label != lang")
