"""One consistent form for texts that look the same.

The character table is made from Unicode properties: compatibility forms that
a reader cannot tell apart are replaced by their NFKC form, invisible
characters go, every kind of space becomes one space, and letters of another
script that share their shape with a Latin letter or a Han character become
that letter. Raised, lowered, circled characters and fractions stay as they
are, because a reader sees the difference; case and accents stay too.
"""

import functools
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Shapes shared across scripts, as pairs "foreign, familiar".
LOOKALIKES = """
аa еe ѕs іi јj оo рp сc уy хx һh ԁd ԛq ԝw ӏl ԍG
АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ԌG ԚQ ԜW ҮY
οo νv ϲc ϳj
ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC
օo սu հh ոn
カ力 ロ口 ニ二 エ工 ハ八 ト卜 タ夕 ー一
"""
_KEPT_TAGS = ("<super>", "<sub>", "<circle>", "<fraction>")
_INVISIBLE = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]


def _visible_form(ch: str) -> str:
    """Compatibility decomposition that stops at characters whose tag shows a visible difference."""
    tag, *parts = unicodedata.decomposition(ch).split(" ")
    if not tag or tag in _KEPT_TAGS:
        return ch
    if not tag.startswith("<"):
        parts = [tag, *parts]
    out = "".join(_visible_form(chr(int(p, 16))) for p in parts)
    return ch if out.startswith(" ") else out


@functools.lru_cache(1)
def char_table() -> dict[int, str]:
    """Code point to replacement, for ``str.translate``."""
    table: dict[int, str] = {}
    pairs = {p[0]: p[1] for p in LOOKALIKES.split()}
    for cp in [*range(0x80, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200), *range(0x2F800, 0x2FA20)]:
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if cat == "Cf":
            table[cp] = ""
        elif cat == "Zs":
            table[cp] = " "
        elif cat in ("Zl", "Zp"):
            table[cp] = "\n"
        elif cat not in ("Cn", "Cs", "Co"):
            out = "".join(pairs.get(c, c) for c in unicodedata.normalize("NFC", _visible_form(ch)))
            if out != ch:
                table[cp] = out
    for cp in _INVISIBLE:
        table[cp] = ""
    table.update({0x09: " ", 0x0B: " ", 0x0C: " ", 0x85: "\n"})
    for cp in [*range(0x00, 0x09), *range(0x0E, 0x20), *range(0x7F, 0x85), *range(0x86, 0xA0)]:
        table[cp] = ""
    table.update({ord(a): b for a, b in pairs.items()})
    return table


def _mapped(text: str) -> str:
    # taken apart first, so that a look-alike letter is found under its accent
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(char_table()))


#: What a character becomes that may join with its neighbours; no mapped text holds it.
_JOINS = "\x00"


def _may_join(ch: str) -> bool:
    return unicodedata.category(ch)[0] == "M" or unicodedata.combining(ch) > 0 or "\u1100" <= ch <= "\u11ff" or "\ua960" <= ch <= "\ua97f" or "\ud7b0" <= ch <= "\ud7ff"


class _Alone(dict):
    """Code point to what ``form`` makes of a character by itself, filled as characters are met."""

    def __init__(self, form):
        super().__init__()
        self.form = form

    def __missing__(self, cp: int) -> str:
        ch = chr(cp)
        out = _mapped(ch)
        # a capital sigma's small form depends on what follows
        self[cp] = _JOINS if ch == "\u03a3" or any(map(_may_join, ch + out)) else self.form(out)
        return self[cp]


_ALONE = _Alone(lambda out: out)
_ALONE_LETTERS = _Alone(lambda out: "".join(c for c in out.lower() if c.isalnum()))


def same_look(text: str) -> str:
    """The consistent form of one text."""
    out = text.translate(_ALONE)
    # only texts with marks that join need normalisation as a whole
    return (_mapped(text) if _JOINS in out else out).strip()


_DROP, _LONG, _NEW, _SEVERAL = 0x110000, 0x110001, 0x110002, 0x110003


class _Batch:
    """A form of many texts at once: characters that stand for one by themselves are looked up in an array."""

    def __init__(self, alone: _Alone, whole):
        self.alone, self.whole = alone, whole
        self.table = np.full(0x110000, _NEW, dtype=np.uint32)
        # characters that become several: all those, and where each one's begin and end
        self.several, self.bounds = np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)

    def _learn(self, codes: np.ndarray) -> None:
        for cp in np.unique(codes).tolist():
            out = self.alone[cp]
            if len(out) > 1:
                self.table[cp] = _SEVERAL + len(self.bounds) - 1
                self.several = np.append(self.several, np.array([ord(c) for c in out], dtype=np.uint32))
                self.bounds = np.append(self.bounds, len(self.several))
            else:
                self.table[cp] = _LONG if out == _JOINS else ord(out) if out else _DROP

    def _spread(self, mapped: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that become several, replaced by them, and where the texts end then."""
        places = np.flatnonzero(mapped >= _SEVERAL)
        if not len(places):
            return mapped, ends
        which = mapped[places] - _SEVERAL
        n = self.bounds[which + 1] - self.bounds[which]
        counts = np.ones(len(mapped), dtype=np.int64)
        counts[places] = n
        after = np.concatenate([[0], np.cumsum(counts)])
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        mapped = np.repeat(mapped, counts)
        mapped[np.repeat(after[places], n) + inner] = self.several[np.repeat(self.bounds[which], n) + inner]
        return mapped, after[ends]

    def __call__(self, texts: list[str]) -> list[str]:
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        mapped = self.table[codes]
        if (new := mapped == _NEW).any():
            self._learn(codes[new])
            mapped = self.table[codes]
        mapped, ends = self._spread(mapped, np.cumsum(lengths))
        kept = np.concatenate([[0], np.cumsum(mapped < _DROP)])[ends]
        slow = np.unique(np.searchsorted(ends, np.flatnonzero(mapped == _LONG), "right"))
        joined = mapped[mapped < _DROP].tobytes().decode("utf-32-le", "surrogatepass")
        out, at = [], 0
        for end in kept.tolist():
            out.append(joined[at:end])
            at = end
        for k in slow.tolist():
            out[k] = self.whole(texts[k])
        return out


_look_batch, _letters_batch = _Batch(_ALONE, same_look), _Batch(_ALONE_LETTERS, lambda text: letters_and_digits(text))


def same_looks(texts: list[str]) -> list[str]:
    """:func:`same_look` of each text."""
    return [t.strip() for t in _look_batch(texts)]


def letters_and_digits_of(texts: list[str]) -> list[str]:
    """:func:`letters_and_digits` of each text."""
    return _letters_batch(texts)


@F.pandas_udf(T.StringType())
def _same_look(texts: pd.Series) -> pd.Series:
    held = texts.notna().to_numpy()
    out = np.full(len(texts), None, dtype=object)
    out[held] = same_looks(texts[held].tolist())
    return pd.Series(out)


def consistent(text: Column) -> Column:
    """Column form of :func:`same_look`; null stays null, a blank text becomes ''."""
    return _same_look(text)


def letters_and_digits(text: str) -> str:
    """Consistent form in lower case with only letters (of any script) and digits kept."""
    out = text.translate(_ALONE_LETTERS)
    return "".join(c for c in _mapped(text).lower() if c.isalnum()) if _JOINS in out else out
