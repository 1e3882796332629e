"""Words as they were meant: full-width forms, invisible characters and look-alike letters of another script undone."""

from __future__ import annotations

import unicodedata

import regex

from chashma.llm.lookalikes import ASCII, BLANKS, FULL_WIDTH, LOOK_ALIKES

_INVISIBLE = regex.compile(r"[\p{Cf}\p{Mn}&&[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯ㅤ︀-️﻿]]", regex.V1)
_MARKS = "`´‘’ʻʼʹ′＇｀"
_PLAIN = str.maketrans(FULL_WIDTH + BLANKS + _MARKS, ASCII + " " * len(BLANKS) + "'" * len(_MARKS))


def _tables() -> tuple[dict[int, str], dict[int, str]]:
    """To Latin letters, and to Cyrillic ones."""
    latin, cyrillic = {}, {}
    for entry in LOOK_ALIKES.split():
        to, _, alike = entry.partition(":")
        if to in "ЁёЇї":
            latin[ord(to)], cyrillic[ord(alike)] = alike, to
            continue
        russian = [c for c in alike if "Ѐ" <= c <= "ԯ"]
        for c in alike:
            latin[ord(c)] = to
        if russian:
            cyrillic[ord(to)] = russian[0]
            for c in alike:
                if c not in russian:
                    cyrillic[ord(c)] = russian[0]
    return latin, cyrillic


_TO_LATIN, _TO_CYRILLIC = _tables()


def settle(word: str) -> str:
    """A word in one script and in plain marks: that of the letters which have no look-alike, else of the majority."""
    if word.isascii():
        return word
    word = unicodedata.normalize("NFC", _INVISIBLE.sub("", word.translate(_PLAIN)).replace("ﬁ", "fi").replace("ﬂ", "fl"))
    latin = cyrillic = sure_latin = sure_cyrillic = other = 0
    for c in word:
        if "Ѐ" <= c <= "ԯ":
            cyrillic += 1
            sure_cyrillic += ord(c) not in _TO_LATIN
        elif "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ɏ":
            latin += 1
            sure_latin += ord(c) not in _TO_CYRILLIC
        elif "Ͱ" <= c <= "Ͽ":
            other += 1
    if other or (latin and cyrillic):
        if (sure_latin, latin) > (sure_cyrillic, cyrillic):
            return word.translate(_TO_LATIN)
        return word.translate(_TO_CYRILLIC) if cyrillic else word.translate(_TO_LATIN)
    return word
