"""Texts decoded with a wrong character encoding, wholly or in a stretch: found, and restored where nothing was lost.

A chain says how a text was garbled: written as E, read as D, perhaps twice. A multinomial classifier
over hashed byte pairs is trained on a bounded sample of the corpus, garbled synthetically by every
chain; `sample_texts` bounds it, and `SAMPLE_CHARS` the characters of each. All texts are scored whole: the byte pairs of each word give its odds of
being garbled at all; of texts with a word in doubt every chain is inverted word by word, the likeliest first, and a
word counts only if it decodes strictly and the result is likelier as clean text. A restored text is judged again, so that
stretches garbled by different chains are restored one after the other. Where characters
were lost, what is left of multi-byte sequences is counted, and the text is found but not restored.

Defined cases: null and empty texts are not garbled; correct foreign words, signs and accents do not
decode strictly and are no cases; each input row is judged by itself, so repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chashma.llm.quality import sample, sample_text

SAMPLE_TEXTS = 400
HASH_BITS = 16
#: Written as, read as; a longer tuple is a chain of two wrong readings.
CHAINS = (
    *(("utf-8", d) for d in ("latin-1", "cp1252", "cp1251", "koi8-r", "cp866", "cp437", "mac-roman", "cp1254", "cp850", "iso8859-5", "mac-cyrillic", "iso8859-9", "cp1250", "koi8-u")),
    ("utf-8", "cp1252", "utf-8", "cp1252"), ("utf-8", "latin-1", "utf-8", "latin-1"), ("utf-8", "cp1251", "utf-8", "cp1251"), ("utf-8", "latin-1", "utf-8", "cp1252"), ("utf-8", "cp1252", "utf-8", "latin-1"),
    *(("cp1251", d) for d in ("latin-1", "cp1252", "koi8-r", "cp866", "mac-cyrillic", "iso8859-5", "mac-roman", "cp437")),
    *(("koi8-r", d) for d in ("cp1251", "latin-1", "cp1252", "cp866", "iso8859-5", "mac-cyrillic")),
    *(("cp866", d) for d in ("cp1251", "latin-1", "cp1252", "koi8-r", "cp437", "mac-cyrillic")),
    *(("iso8859-5", d) for d in ("cp1251", "latin-1", "cp1252", "koi8-r")),
    *(("mac-cyrillic", d) for d in ("cp1251", "latin-1", "cp1252")),
    *(("cp1254", d) for d in ("latin-1", "cp1251", "cp1250")),
)
#: Odds of a word from which a text is classified; between one-byte encodings, where any byte decodes: the gain of a word, of all its words, and their number.
DOUBT, WORD_GAIN, LEAST_GAIN, LEAST_WORDS = 1.5, 5.0, 25.0, 3
#: Of one-byte encodings, so many likeliest chains may gain anywhere in a text; the words of all others have to stand close together.
LIKELY = 6
LOST = "�"
RESULT = "doc_id bigint, chain string, words int, lost int, restored string"


def _readings() -> dict[str, tuple[list[str], dict[str, int]]]:
    """Of each one-byte encoding: byte -> character, also for undefined bytes (as browsers do), and back."""
    out = {}
    for name in {x for chain in CHAINS for x in chain if x != "utf-8"}:
        chars = []
        for b in range(256):
            try:
                chars.append(bytes([b]).decode(name))
            except UnicodeDecodeError:
                chars.append(chr(b))
        out[name] = (chars, {c: b for b, c in reversed(list(enumerate(chars)))})
    return out


def garble(text: str, chain: tuple[str, ...], readings: dict) -> str:
    for k in range(0, len(chain), 2):
        raw = text.encode("utf-8", "ignore") if chain[k] == "utf-8" else bytes(readings[chain[k]][1].get(c, 63) for c in text)
        text = "".join(map(readings[chain[k + 1]][0].__getitem__, raw))
    return text


def _pairs(raw: bytes) -> np.ndarray:
    """Byte pairs, hashed into `HASH_BITS` bits."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    return (b[:-1] << 8 | b[1:]) & np.uint32((1 << HASH_BITS) - 1)


def _counts(text: str) -> np.ndarray:
    return np.bincount(_pairs((" " + text + " ").encode("utf-8", "ignore")), minlength=1 << HASH_BITS).astype(np.float64)


def _logs(counts: np.ndarray) -> np.ndarray:
    counts = counts + 0.02
    return np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def train(texts: list[str]) -> np.ndarray:
    """Log probabilities of byte pairs: row 0 for clean text, then one row for each chain.

    The sample holds garbled texts too; those that a first fit finds are taken out of the clean row.
    """
    readings = _readings()
    # only words that change tell something of a chain
    words = " ".join(w for t in texts if not t.isascii() for w in t.split() if not w.isascii())
    rows = [sum((_counts(t) for t in texts), np.zeros(1 << HASH_BITS)), *(_counts(garble(words, chain, readings)) for chain in CHAINS)]
    judge = Judge(_logs(np.array(rows)))
    for t in texts:
        if not t.isascii() and judge.judge(t):
            rows[0] -= _counts(t)
    return _logs(np.maximum(np.array(rows), 0))


def _plausible(c: str) -> bool:
    """Characters that a restored text may hold."""
    o = ord(c)
    return o < 0x80 or 0xA0 <= o < 0x180 or 0x2B9 <= o < 0x2BD or 0x384 <= o < 0x460 or c in "ҒғҚқҢңҮүҰұҲҳҶҷҺһӘәӢӣӨөӮӯҐґҷ" or 0x600 <= o < 0x6FF or 0x900 <= o < 0x980 or 0x2000 <= o < 0x2070 or 0x20A0 <= o < 0x2200 or 0x3000 <= o < 0x30FF or 0x4E00 <= o < 0xA000 or 0xFE00 <= o < 0xFE10 or 0xFF00 <= o < 0xFF66 or 0x1F000 <= o < 0x1FB00 or 0x2600 <= o < 0x27C0


#: First two bytes of punctuation, signs, emoji and Devanagari, which show a sequence even if it is cut.
CUT = {(0xE2, 0x80), (0xE2, 0x84), (0xE2, 0x82), (0xF0, 0x9F), (0xE0, 0xA4), (0xE0, 0xA5), (0xEF, 0xBF), (0xEF, 0xB8)}
_LATIN, _CYRILLIC, _LETTERS = regex.compile(r"\p{Latin}"), regex.compile(r"\p{Cyrillic}"), regex.compile(r"\p{L}")


_BLANKS = regex.compile(r"([ \t\n\r]+)")


def _spelt(word: str, new: str) -> bool:
    """Whether a restored word is one: at least three letters, of one script, in place of signs that are no word of three or more."""
    return len(_LETTERS.findall(new)) >= 3 and not (_LATIN.search(new) and _CYRILLIC.search(new))


def _walk(raw: list[int]) -> tuple[int, int, int]:
    """Of bytes (-1: unknown) as UTF-8: whole sequences, cut ones that still show two bytes, other errors."""
    whole = cut = wrong = i = 0
    while i < len(raw):
        b = raw[i]
        n = 1 if 0 <= b < 0x80 else 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
        if n == 1 or b == -1:
            i += 1
            continue
        j = i + 1
        while n and j < len(raw) and j < i + n and 0x80 <= raw[j] < 0xC0:
            j += 1
        if n and j == i + n:
            try:
                fits = _plausible(bytes(raw[i:j]).decode("utf-8"))
            except UnicodeDecodeError:
                fits = False
            whole, wrong = whole + fits, wrong + (not fits)
        elif n > 2 and j > i + 1 and (b, raw[i + 1]) in CUT:
            cut += 1
        elif n and j < len(raw) and raw[j] == -1:
            cut += 0  # a lost byte explains it, but shows nothing
        else:
            wrong += 1
        i = j
    return whole, cut, wrong


class Judge:
    """The classifier and the inversion of chains, as each Python worker holds them."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.readings = _readings()
        chains = table[1:]
        top = chains.max(axis=0)
        self.odds = (top + np.log(np.exp(chains - top).mean(axis=0)) - table[0]).astype(np.float32)
        self.kept: tuple[dict[str, float], dict[str, float]] = {}, {}

    def _keep(self, which: int, word: str, value: float) -> float:
        """Scores of words are kept, as words repeat."""
        kept = self.kept[which]
        if len(kept) > 200_000:
            kept.clear()
        kept[word] = value
        return value

    def doubt(self, word: str) -> float:
        """The odds of a word being garbled."""
        got = self.kept[0].get(word)
        return got if got is not None else self._keep(0, word, float(self.odds[_pairs((" " + word + " ").encode("utf-8", "ignore"))].sum()))

    def clean(self, word: str) -> float:
        """How likely as clean text; capitals alone make no word unlikely."""
        got = self.kept[1].get(word)
        if got is not None:
            return got
        score = lambda w: float(self.table[0][_pairs((" " + w + " ").encode("utf-8", "ignore"))].sum())
        low = word.lower()
        return self._keep(1, word, max(score(word), score(low)) if low != word else score(word))

    def invert(self, word: str, chain: tuple[str, ...]) -> tuple[str | None, int, int]:
        """(restored, sequences seen, errors); restored is None unless every byte decodes strictly."""
        seen = wrong = 0
        for k in range(len(chain) - 2, -1, -2):
            back, written = self.readings[chain[k + 1]][1], chain[k]
            raw = [back.get(c, -1) for c in word]
            if written != "utf-8":
                if -1 in raw:
                    return None, 0, 1
                word = "".join(map(self.readings[written][0].__getitem__, raw))
                continue
            if -1 not in raw:
                try:
                    new = bytes(raw).decode("utf-8")
                    seen = sum(map(lambda c: not c.isascii(), new))
                    word = new
                    continue
                except UnicodeDecodeError:
                    pass
            whole, cut, wrong = _walk(raw)
            return None, whole + cut, wrong + sum(c != LOST for c, b in zip(word, raw) if b == -1)
        return word, seen, 0

    def judge(self, text: str) -> tuple[str, int, int, str | None] | None:
        """(chains joined by ` + `, garbled words, of them not restorable, restored text) or None."""
        chains, good, lost, now, seen = [], 0, 0, text, {text}
        while got := self.one_chain(now):
            chains.append(got[0])
            good, lost, now = good + got[1], lost + got[2], got[3]
            if now is None or now in seen:
                break
            seen.add(now)
        return (" + ".join(chains), good, lost, now) if chains else None

    def one_chain(self, text: str) -> tuple[str, int, int, str | None] | None:
        """The chain that gains most: its name, garbled words, of them not restorable, text without it; or None."""
        doubtful = [w for w in _words(text) if not w.isascii() and self.doubt(w) > 0]
        if not doubtful:
            return None
        distinct = sorted(set(doubtful))
        pairs, many = np.unique(_pairs((" " + " ".join(distinct) + " ").encode("utf-8", "ignore")), return_counts=True)
        scores = self.table[1:, pairs] @ many.astype(np.float32)
        best = None
        # every chain is tried, as clean words in doubt may outweigh the garbled ones; the order decides between equal gains
        for rank, k in enumerate(np.argsort(-scores, kind="stable").tolist()):
            chain = CHAINS[k]
            wide = chain[0] == "utf-8"
            gain, good, lost, changed, steps = 0.0, 0, 0, {}, {}
            for word in distinct:
                new, seen, wrong = self.invert(word, chain)
                steps[word] = -WORD_GAIN * (new != word)
                if new is not None:
                    if new == word or not all(map(_plausible, new)) or wide and not seen:
                        continue
                    more = self.clean(new) - self.clean(word)
                    if not wide and (more < WORD_GAIN or not _spelt(word, new)):
                        continue
                    if more > 0 and not (word.isalpha() and not _LETTERS.search(new)):
                        gain, good = gain + more, good + 1
                        changed[word] = new
                        steps[word] = more
                elif wide and seen and (seen > 2 * wrong if LOST in word else not wrong):
                    gain, lost = gain + 4.0 * seen, lost + 1
            if not wide and (good < LEAST_WORDS or gain < LEAST_GAIN) or wide and good + lost == 0 or gain < 4:
                continue
            # in a long text any chain gains here and there by chance
            if not wide and rank >= LIKELY and not self.in_stretch(text, chain, steps):
                continue
            # the longer chain explains more; at equal words the gain decides
            key = (gain, good)
            if best is None or key > best[0]:
                best = (key, chain, good, lost, changed)
        if best is None:
            return None
        _, chain, good, lost, changed = best
        return ">".join(chain), good, lost, None if lost else self.restore(text, chain, changed)

    def in_stretch(self, text: str, chain: tuple[str, ...], steps: dict[str, float]) -> bool:
        """Whether enough words gain close together, where every word that the chain would change for nothing counts against it."""
        total, good = 0.0, set()
        for word in _words(text):
            if word.isascii():
                continue
            if word not in steps:  # a word not in doubt
                steps[word] = -WORD_GAIN * (self.invert(word, chain)[0] != word)
            total += steps[word]
            if total <= 0:
                total, good = 0.0, set()
            elif steps[word] > 0:
                good.add(word)
                if total >= LEAST_GAIN and len(good) >= LEAST_WORDS:
                    return True
        return False

    def restore(self, text: str, chain: tuple[str, ...], changed: dict[str, str]) -> str:
        """The accepted words inverted; between them, at most three words apart, also those that tell too little alone, and next to them those that gain at all."""
        parts = _BLANKS.split(text)
        sure = [k for k in range(0, len(parts), 2) if parts[k] in changed]
        sure_set = set(sure)
        done = set(sure)
        for a, b in zip(sure, sure[1:]):
            if b - a <= 8:
                for k in range(a + 2, b, 2):
                    if k not in done and not parts[k].isascii() and (new := self.invert(parts[k], chain)[0]) is not None:
                        parts[k] = new
                        done.add(k)
        for k in sure:
            for step in (-2, 2):
                j = k + step
                while 0 <= j < len(parts) and j not in done and not parts[j].isascii():
                    new = self.invert(parts[j], chain)[0]
                    if new is None or self.clean(new) <= self.clean(parts[j]):
                        break
                    parts[j] = new
                    done.add(j)
                    j += step
        return "".join(changed[p] if k in sure_set else p for k, p in enumerate(parts))


def _words(text: str) -> list[str]:
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def _find(table, doubt: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(table.value)
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = [i for i, t in enumerate(texts) if t and not t.isascii()]
            out = []
            for lo in range(0, len(at), 2000):
                some = at[lo : lo + 2000]
                raws = [texts[i].encode("utf-8", "ignore") for i in some]
                joined = b" " + b" ".join(raws) + b" "
                flat = np.frombuffer(joined, np.uint8)
                odds = judge.odds[_pairs(joined)]
                starts = np.flatnonzero((flat[:-1] == 32) | (flat[:-1] == 10) | (flat[:-1] == 9) | (flat[:-1] == 13))
                # only words with a byte over 0x7F can be garbled
                high = np.add.reduceat((flat[:-1] > 127).astype(np.int32), starts)
                doubtful = (np.add.reduceat(odds, starts) > doubt) & (high > 0)
                ends = np.cumsum([len(r) + 1 for r in raws])
                for d in np.unique(np.searchsorted(ends, starts[doubtful], "right")).tolist():
                    text = texts[some[d]]
                    if got := judge.judge(text):
                        out.append((docs[some[d]], *got))
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], kinds[j]) for j in range(5)], ["doc_id", "chain", "words", "lost", "restored"])

    return run


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_texts: int = SAMPLE_TEXTS) -> np.ndarray:
    """Train on at most `sample_texts` texts, those with the smallest hashes of their ids."""
    return train([r[0] for r in sample(df.where(F.length(text_col) > 0), [sample_text(text_col)], F.col(id_col), sample_texts)])


def find_garbled(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_texts: int = SAMPLE_TEXTS, doubt: float = DOUBT) -> DataFrame:
    """One row for each garbled text: its chain, garbled words, how many of them lost characters, and the restored text if none did."""
    table = df.sparkSession.sparkContext.broadcast(fit(df, id_col, text_col, sample_texts))
    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_find(table, doubt), RESULT)
