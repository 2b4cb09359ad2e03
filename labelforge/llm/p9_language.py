"""Problem 9: the language of each document and of each stretch of a mixed one.

Every language gets a zstandard dictionary of raw sentences. A sentence is
encoded with each dictionary that knows most of its letters (others can't
shrink it); the smallest encoding names the language, unless the runner-up, or
without one the encoding without a dictionary, is nearly as small. That leaves
it undecided and part of the stretch around it.

The dictionaries are made from a bounded sample of labelled documents
(``SAMPLE_DOCS`` per language, sentences from all over each up to
``SAMPLE_CHARS``, ``DICT_BYTES`` kept).
As labels may be wrong and documents mixed, each sampled sentence first goes to
the language among whose sampled documents its words are most at home.
"""

import collections
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LANGUAGES = ("zh", "en", "ja", "es", "ko", "fr", "de", "pt", "ru")
# Other names of the languages (ISO 639-2 and English and own names).
NAMES = {
    "zho": "zh", "chi": "zh", "cmn": "zh", "chinese": "zh", "中文": "zh", "汉语": "zh", "eng": "en", "english": "en", "jpn": "ja", "jp": "ja", "japanese": "ja", "日本語": "ja",
    "spa": "es", "spanish": "es", "español": "es", "kor": "ko", "kr": "ko", "korean": "ko", "한국어": "ko", "fra": "fr", "fre": "fr", "french": "fr", "français": "fr",
    "deu": "de", "ger": "de", "german": "de", "deutsch": "de", "por": "pt", "portuguese": "pt", "português": "pt", "rus": "ru", "russian": "ru", "русский": "ru",
}

#: The labelled sample that the dictionaries are fitted on; everything else sees all documents whole.
SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES = 150, 3000, 48_000
#: Level of the encodings.
LEVEL = 1
#: A dictionary knows a letter if it is so large a part of the dictionary's letters; it is used if it knows this part of what the best one knows.
KNOWN_LETTER, KNOWN_PART = 0.0005, 0.5
#: The runner-up's encoding must be larger by this part of the smallest.
MARGIN = 0.04
#: A sentence that says less than this (see :func:`_weight`) starts no stretch of its own.
LEAST_WEIGHT = 16
#: Sentences remembered by a task, as forums repeat themselves.
MEMORY = 200_000

# a full stop ends a sentence before a space or the end, and between letters unless it looks like an abbreviation
_END = re.compile(r"[。！？!?…\n]+|\.(?=\s|$)|(?<=[^\W\d_A-Z])\.(?=[^\W\d_a-z])")
_ASIDE = re.compile(r"[（(][^（）()\n]{0,60}[）)]|“[^”\n]{0,40}”|「[^」\n]{0,40}」|\{[^{}]*\}|\[[^\[\]]*\]")
# an aside that is a sentence by itself: it ends inside the brackets, and the text before it had ended
_STOP = re.compile(r"[。！？!?…\n.]\s*$")
_CJK = "　-鿿가-힯豈-﫿"


def label_language(label: Column) -> Column:
    """The language a label names, without region, script and case; null if it names none of the nine."""
    head = F.lower(F.element_at(F.split(F.trim(label), "[-_ ]"), 1))
    other = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    return F.when(head.isin(*LANGUAGES), head).otherwise(F.try_element_at(other, head))


def _aside(m: re.Match) -> str:
    found, before = m.group(), m.string[max(0, m.start() - 4) : m.start()]
    if found[0] in "（(“「" and _STOP.search(found[1:-1]) and (not m.start() or _STOP.search(before)):
        return f" {found[1:-1]} "
    return " " * len(found)


def sentences(text: str) -> list[tuple[int, int, str]]:
    """Start, end and wording of each sentence; asides, quoted terms and JSON are not part of the wording."""
    out, at = [], 0
    # an aside may hold marks that end no sentence of the text
    shown = _ASIDE.sub(_aside, text)
    for m in [*_END.finditer(shown), None]:
        end = m.end() if m else len(text)
        wording = " ".join(shown[at:end].split())
        if any(c.isalpha() for c in wording):
            out.append((at, end, wording))
        at = end
    return out


_NO_LETTER, _WIDE = re.compile(r"[\W\d_]+"), re.compile("[⺀-鿿가-힯]+")


def _weight(wording: str) -> int:
    """About how much a sentence says: a Han, kana or Hangul character counts as three letters."""
    letters = _NO_LETTER.sub("", wording)
    return len(letters) + 2 * (len(letters) - len(_WIDE.sub("", letters)))


def _words(wording: str) -> set[str]:
    low = wording.lower()
    words = set(re.findall(r"[^\W\d_]+", re.sub(f"[{_CJK}]", " ", low)))
    for run in re.findall(f"[{_CJK}]+", low):
        words.update(run[k : k + 2] for k in range(len(run) - 1))
    return words


def _mixed(wording: str) -> bool:
    """Whether Latin words beyond a name or two stand beside another script."""
    return bool(re.search("[Ѐ-ӿ぀-鿿가-힯]", wording)) and len(re.findall("[a-zß-ÿ]{2,}", wording)) > 3


def fit_dictionaries(sample: list[tuple[str, str]]) -> dict[str, bytes]:
    """Raw dictionaries from (labelled language, text); wrong labels are outvoted word by word."""
    held = [(lang, wording) for lang, text in sample for _, _, wording in sentences(text) if _weight(wording) >= 12 and not _mixed(wording)]
    place = {lang: k for k, lang in enumerate(LANGUAGES)}
    assigned = np.array([place[lang] for lang, _ in held], dtype=np.int64)
    vocabulary: dict[str, int] = {}
    words = [[vocabulary.setdefault(w, len(vocabulary)) for w in _words(wording)] for _, wording in held]
    of = np.repeat(np.arange(len(held)), [len(ws) for ws in words])
    ids = np.array([w for ws in words for w in ws], dtype=np.int64)
    for _ in range(3):
        size = np.bincount(assigned, minlength=len(LANGUAGES))
        counts = np.zeros((len(LANGUAGES), len(vocabulary)))
        np.add.at(counts, (assigned[of], ids), 1)
        scores = np.full((len(LANGUAGES), len(held)), -np.inf)
        for k in np.flatnonzero(size):
            # a sentence doesn't speak for itself
            own = (assigned[of] == k).astype(float)
            scores[k] = np.bincount(of, np.log((counts[k][ids] - own + 0.02) / (size[k] - own + 1)), minlength=len(held))
        best = scores.max(axis=0, initial=-np.inf)
        stays = scores[assigned, np.arange(len(held))] >= best
        assigned = np.where(stays, assigned, scores.argmax(axis=0))
    assigned = [LANGUAGES[k] for k in assigned]
    out = {}
    for lang in LANGUAGES:
        own = list(dict.fromkeys(w for a, (_, w) in zip(assigned, held, strict=True) if a == lang))
        kept = b""
        for w in own:
            if len(kept) < DICT_BYTES:
                kept += w.encode() + b"\n"
        if kept:
            out[lang] = kept.ljust(16)
    return out


def encoder(raw: bytes) -> zstandard.ZstdCompressor:
    """Encodes with a raw-content dictionary."""
    data = zstandard.ZstdCompressionDict(raw.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False)


class Classifier:
    """Names a sentence's language by the dictionary that encodes it smallest."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.encoders = {lang: encoder(raw) for lang, raw in dictionaries.items()}
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.letters = {lang: self._letters(raw.decode("utf-8", "ignore")) for lang, raw in dictionaries.items()}
        self.known: dict[str, tuple[str | None, float, int]] = {}

    @staticmethod
    def _letters(text: str) -> set[str]:
        counts = collections.Counter(_NO_LETTER.sub("", text.lower()))
        return {c for c, n in counts.items() if n >= KNOWN_LETTER * counts.total()}

    def __call__(self, wording: str) -> tuple[str | None, float, int]:
        """Language, confidence from 0 to 1, and weight; no language if the margin is narrow or too little is said."""
        if wording not in self.known:
            if len(self.known) >= MEMORY:
                self.known.clear()
            weight = _weight(wording)
            self.known[wording] = (*self.decide(wording), weight) if weight >= LEAST_WEIGHT else (None, 0.0, weight)
        return self.known[wording]

    def decide(self, wording: str) -> tuple[str | None, float]:
        letters = set(_NO_LETTER.sub("", wording.lower()))
        knows = {lang: len(letters & own) for lang, own in self.letters.items()}
        most = max(knows.values(), default=0)
        if not most:
            return None, 0.0
        data = wording.encode("utf-8", "ignore")
        size = lambda encoder: max(1, len(encoder.compress(data)) - 8)
        ranked = sorted((size(self.encoders[lang]), lang) for lang, n in knows.items() if n >= KNOWN_PART * most)
        best, lang = ranked[0]
        other = ranked[1][0] if len(ranked) > 1 else size(self.plain)
        return (lang if other >= (1 + MARGIN) * best else None), max(0.0, 1 - best / other)

    def foreign_to(self, wording: str, home: str) -> bool | None:
        """Whether another language's dictionary encodes a wording clearly smaller than that of ``home``; null if neither is clearly smaller."""
        if home not in self.encoders:
            return None
        letters = set(_NO_LETTER.sub("", wording.lower()))
        knows = {lang: len(letters & own) for lang, own in self.letters.items()}
        most = max(knows.values())
        data = wording.encode("utf-8", "ignore")
        size = lambda encoder: max(1, len(encoder.compress(data)) - 8)
        own = size(self.encoders[home])
        others = [size(self.encoders[lang]) for lang, n in knows.items() if lang != home and most and n >= KNOWN_PART * most]
        other = min(others) if others else size(self.plain)
        return True if others and (1 + MARGIN) * other <= own else False if (1 + MARGIN) * own <= other else None

    def stretches(self, text: str) -> list[tuple[str, float, int, int]]:
        """Language, confidence and place of each longest run of sentences in one language."""
        runs: list[list] = []  # language, sum of confidence by weight, weight, start, end
        pending = None
        for start, end, wording in sentences(text):
            lang, sure, weight = self(wording)
            if lang is None:
                if runs:
                    runs[-1][4] = end
                elif pending is None:
                    pending = start
                continue
            if runs and runs[-1][0] == lang:
                runs[-1][1] += sure * weight
                runs[-1][2] += weight
                runs[-1][4] = end
            else:
                runs.append([lang, sure * weight, weight, start if pending is None else pending, end])
                pending = None
        if not runs:
            # nothing but short or doubtful sentences: they are judged together, by the same margin
            lang, sure = self.decide(" ".join(w for _, _, w in sentences(text)))
            return [(lang, sure, 0, len(text))] if lang else []
        return [(lang, total / weight, start, end) for lang, total, weight, start, end in runs]


@F.pandas_udf(T.StringType())
def _spread(texts: pd.Series) -> pd.Series:
    """Sentences from all over a text, evenly spaced, up to about SAMPLE_CHARS in all."""

    def spread(text: str) -> str:
        every = math.ceil(len(text) / SAMPLE_CHARS)
        return "\n".join(w for _, _, w in sentences(text)[::every])[: 2 * SAMPLE_CHARS]

    return texts.map(spread, na_action="ignore")


def fit(documents: DataFrame) -> dict[str, bytes]:
    """Dictionaries from at most SAMPLE_DOCS labelled documents of each language, whatever the input."""
    labelled = documents.select("doc_id", "text", label_language(F.col("lang")).alias("known")).where("known is not null and length(text) > 10")
    # a window with a limit: each task keeps SAMPLE_DOCS of a language before the shuffle
    order = Window.partitionBy("known").orderBy(F.xxhash64("doc_id"), "doc_id")
    few = labelled.withColumn("k", F.row_number().over(order)).where(F.col("k") <= SAMPLE_DOCS).select("known", "k", _spread("text").alias("text"))
    return fit_dictionaries([(r["known"], r["text"]) for r in few.orderBy("known", "k").collect()])


SCHEMA = "doc_id bigint, label string, seg_no int, lang string, confidence double, start int, end int"


def languages(documents: DataFrame) -> DataFrame:
    """Language and confidence of every document or, if mixed, of each stretch.

    ``label`` is the language the document's label names. ``seg_no`` is 0 for
    a document in one language and counts from 1 in a mixed one; ``start`` and
    ``end`` are offsets in code points. A text that is null, blank or without
    a decided sentence gets ``lang`` null, confidence 0. Repeated rows stay.
    """
    dictionaries = fit(documents)

    def classify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classifier = Classifier(dictionaries)
        for frame in frames:
            rows = []
            for doc_id, text, label in zip(frame["doc_id"], frame["text"], frame["label"], strict=True):
                runs = classifier.stretches(text) if isinstance(text, str) else []
                size = len(text) if isinstance(text, str) else 0
                if not runs:
                    rows.append((doc_id, label, 0, None, 0.0, 0, size))
                elif len(runs) == 1:
                    rows.append((doc_id, label, 0, runs[0][0], round(runs[0][1], 4), 0, size))
                else:
                    rows += [(doc_id, label, k, lang, round(sure, 4), a, b) for k, (lang, sure, a, b) in enumerate(runs, 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "label", "seg_no", "lang", "confidence", "start", "end"])

    return documents.select("doc_id", "text", label_language(F.col("lang")).alias("label")).mapInPandas(classify, SCHEMA)


def corrections(found: DataFrame) -> DataFrame:
    """Stretches of mixed documents, and documents whose label is missing or names another language."""
    wrong = F.col("label").isNull() | (F.col("label") != F.col("lang"))
    return found.where("lang is not null").where((F.col("seg_no") > 0) | wrong).select("doc_id", "seg_no", "lang")
