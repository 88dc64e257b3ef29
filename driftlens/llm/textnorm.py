"""Undoing disguises of words, for scorers that read words. Runs inside Arrow batches."""

from __future__ import annotations

import re
import unicodedata

#: Fixed table: Cyrillic and Greek letters that look like Latin ones.
LOOKALIKES = str.maketrans(
    "абсдеёгіјкӏмнопрԛѕтуѵԝхуᴢАВСЕНІЈКМОРЅТУХαβεηικμνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
    "abcdeerijklmhonpqstyvwxyzABCEHIJKMOPSTYXabenikuvoptuxABEZHIKMNOPTYX",
)
#: Fixed table: signs written for letters.
LEET = str.maketrans("013457$@!|+89", "oieastsailtbg")
INVISIBLE = re.compile("[­​-‏⁠﻿]")
SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:([ .\-_*·])[^\W\d_])(?:\1[^\W\d_])+(?![^\W_])")
TOKEN = re.compile(r"[^\W_]+(?:[@$!|+*'’][^\W_]+|[@$|+*](?=[^\W_]))*[@$*]?|[@$*!]+[^\W_][\w@$!|+*]*")
REPEAT = re.compile(r"(.)\1\1+")
WORDISH = re.compile(r"[a-z]")


def fold(text: str) -> str:
    """Lower case, compatibility forms, no accents, no invisible characters, Latin letters for their doubles."""
    if not text.isascii():
        text = INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).translate(LOOKALIKES)
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
        text = text.replace("ß", "ss").replace("ẞ", "ss").replace("œ", "oe").replace("æ", "ae")
    return text.lower()


def join_spaced(text: str) -> str:
    """Words whose letters stand apart (i d i o t, i.d.i.o.t) made whole."""
    return SPACED.sub(lambda m: m.group(0).replace(m.group(1), ""), text)


class Words:
    """Words of folded text, with signs for letters, masked letters and drawn-out letters undone.

    ``known`` are the words that a masked or drawn-out word may stand for.
    """

    LIMIT = 100_000

    def __init__(self, known: dict[str, float]) -> None:
        self.known = known
        self.masked: dict[str, str] = {}
        for w in sorted(known, key=lambda w: (known[w], w)):  # the weightiest word wins
            if len(w) > 2:
                for i in range(len(w)):
                    self.masked[w[:i] + "*" + w[i + 1 :]] = w
        self.cache: dict[str, tuple[str, ...]] = {}

    def _plain(self, raw: str) -> tuple[str, ...]:
        w = raw
        if not w.isalpha():
            if not WORDISH.search(w) or w.isdigit():
                # signs and digits alone are a word only where they spell one: $h1+
                w = w.translate(LEET)
                return (w,) if w in self.known and not raw.isdigit() else ()
            if w.endswith(("'", "’")):
                w = w[:-1]
            w = w.replace("’", "'")
            if "'" in w:
                return tuple(x for part in w.split("'") for x in self._plain(part))
            bare = w.translate(LEET)
            if "!" in w and bare not in self.known:  # an exclamation mark after all
                return tuple(x for part in w.split("!") if part for x in self._plain(part))
            if "*" in bare:
                w = self.masked.get(bare) or self.masked.get(bare.rstrip("*")) or bare.replace("*", "")
            elif bare.isalpha():
                w = bare
                if w not in self.known and "l" not in w and "1" in raw:
                    other = raw.replace("1", "l").translate(LEET)
                    w = other if other in self.known else w
            else:
                w = re.sub(r"[^a-z0-9]", "", bare)
        if w not in self.known and REPEAT.search(w):
            one, two = REPEAT.sub(r"\1", w), REPEAT.sub(r"\1\1", w)
            w = two if two in self.known else one
        return (w,) if w else ()

    def __call__(self, folded: str) -> list[str]:
        out: list[str] = []
        cache = self.cache
        for raw in TOKEN.findall(folded):
            got = cache.get(raw)
            if got is None:
                if len(cache) > self.LIMIT:
                    cache.clear()
                got = cache[raw] = self._plain(raw)
            out += got
        return out
