"""Problem 3: answers that do not answer their prompt, with the type of defect.

* A copy is told by compression: with the prompt as a zstandard dictionary it
  shrinks to almost nothing.
* A refusal is prose without a label that is encoded smaller with a dictionary
  of refusals than with one of ordinary prose. Both are fitted on a bounded
  sample of the answers: ``REFUSAL_SAMPLE`` that decline in one of the fixed
  wordings, as many prompts and as much prose beside labels. A whole Chinese
  answer that names no label and triages nothing is a refusal in any wording.
* Another language is told by the dictionaries of problem 9: one of them encodes
  what the answer says (values of its label object and its prose, never keys)
  clearly smaller than the Chinese one, which also holds ``HOME_SAMPLE`` label
  texts in Chinese script and the ordinary prose above. A few words that no dictionary shrinks are
  judged by their script.
* Cut answers are told by the automaton and the terminal contexts of problem 5.

One defect is given, the first of empty, copy, refusal, truncated,
other_language that holds; an answer that only looks unfinished because it is a
refusal or a copy is no cut one.
"""

import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelforge import constants
from labelforge.llm import p5_cutoff, p9_language
from labelforge.session import cut_lineage

#: An answer is a copy if, given the prompt, it takes at most this part of its own compressed size,
COPY_RATIO = 0.5
#: and if it gives back at least this part of the prompt: so much is left of the prompt's own size once the answer is known.
COPY_SHARE = 0.5
#: Answers that decline, and prompts and whole answers, on which the refusal and the ordinary dictionary are fitted; and bytes kept of each.
REFUSAL_SAMPLE, REFUSAL_BYTES = 2000, 64_000
#: Label texts whose values are added to the Chinese dictionary, and bytes kept of them.
HOME_SAMPLE, HOME_BYTES = 2000, 32_000
#: The ordinary encoding of a refusal must be larger by this part.
REFUSAL_MARGIN = 0.05

# Ways of declining, and wordings that use the same words without declining.
REFUSALS = re.compile(
    "无法(?:根据|回答|提供|给出|判断|处理|协助|为您|帮)|不能(?:提供|回答|给出|判断|协助|为您|帮|作答|透露)|不便(?:透露|回答|提供|评价|告知)|不方便(?:对|回答|透露|提供|评价)"
    "|没有(?:资格|权限|能力)|没有办法|没法(?:回答|提供|给出)|未获授权|无权|请?恕(?:我|本|难)|难以(?:回答|作答|判断|提供)|拒绝(?:给出|回答|提供|作答)|不予(?:处理|回答|受理|作答|分诊)"
    "|超出了?.{0,6}(?:能力|范围|权限)|帮不(?:上|了)|不(?:作|做)(?:分诊|回答|评价|答复|判断)|不(?:回应|作答|受理)|(?:暂不|不)支持|给不(?:出|了)|到此为止|请勿据此|不会(?:回答|提供)|另请|爱莫能助"
)
REFUSALS_ABROAD = re.compile(r"\b(?:i (?:can(?:no|')t|am (?:not able|unable)|won't)|unable to|not able to (?:help|provide)|cannot (?:help|provide|answer|assist))\b", re.I)
# Words that go with every language: control tokens and fences.
_SHELL = re.compile(r"```(?:json)?|<\|[A-Za-z_]+\|>|</?s>|\[(?:EOS|PAD|UNK)\]")
_LABEL_KEYS = {"department", "urgency", "symptoms"}


def _strings(value) -> list[str]:
    """Every string value inside a decoded JSON value; keys don't count."""
    if isinstance(value, str):
        return [value]
    if isinstance(value, dict):
        return [s for v in value.values() for s in _strings(v)]
    if isinstance(value, list):
        return [s for v in value for s in _strings(v)]
    return []


_SHOWN = re.compile(r"[A-Za-z0-9一-鿿]")


def _visible(text: str) -> str:
    if _SHOWN.search(text):
        return text
    return "".join(c for c in text if not c.isspace() and unicodedata.category(c) not in ("Cf", "Cc", "Mn", "Zs"))


# where a JSON value may start: an object or list that goes on like one, or a text or null in front
_VALUE = re.compile(r"\{(?=\s*[\"}])|\[(?=\s*[\"{\[\]\d])|^(?:\"|null)")


def parts(text: str) -> tuple[str, list, str]:
    """An answer's body without shells, the JSON values in it, and its prose."""
    body = _SHELL.sub(" ", text).strip()
    if body[:1] == "{" and body[-1:] == "}":
        try:
            return body, [json.loads(body)], ""
        except ValueError:
            pass
    values, prose, at = [], [], 0
    decoder = json.JSONDecoder(strict=False)
    for m in _VALUE.finditer(body):
        if m.start() < at:
            continue
        start = m.start()
        try:
            value, end = decoder.raw_decode(body, start)
        except ValueError:
            continue
        prose.append(body[at:start])
        values.append(value)
        at = end
    prose.append(body[at:])
    return body, values, " ".join(p for p in prose if p.strip())


def _folded(text: str) -> str:
    return re.sub(r"[\W_]+", "", unicodedata.normalize("NFKC", text).lower())


def _size_given(text: bytes, known: bytes) -> int:
    """Compressed size of a text with another as dictionary, without the nine bytes that a frame takes by itself."""
    raw = zstandard.ZstdCompressionDict(known.ljust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return len(zstandard.ZstdCompressor(level=3, dict_data=raw, write_content_size=False).compress(text)) - 9


_PLAIN = zstandard.ZstdCompressor(level=3, write_content_size=False)


def is_copy(said: str, prompt: str) -> bool:
    """Whether what was said gives back the prompt, by compression of each with the other as dictionary."""
    a, b = _folded(prompt).encode("utf-8", "ignore"), _folded(said).encode("utf-8", "ignore")
    if not a or not b:
        return False
    plain = max(1, len(_PLAIN.compress(b)) - 9)
    if _size_given(b, a) > COPY_RATIO * plain:
        return False
    # a short quote of the prompt shrinks as well, but leaves most of the prompt untold
    return _size_given(a, b) <= (1 - COPY_SHARE) * max(1, len(_PLAIN.compress(a)) - 9)


# Latin words that any language may hold: short abbreviations, words with digits, and units; beside Han also names.
_WORD = re.compile(r"[A-Za-zÀ-ɏ0-9][A-Za-zÀ-ɏ0-9_\-]*")
_UNITS = {"mg", "ml", "cm", "mm", "kg", "bpm", "min", "h", "vs"}
#: Longest all-capital word that is an abbreviation in any wording.
ABBREVIATION = 4


def _without_abbreviation(m: re.Match) -> str:
    word = m.group()
    return " " if word in _UNITS or any(c.isdigit() for c in word) or word.isupper() and len(word) <= ABBREVIATION else word


def _without_name(m: re.Match) -> str:
    word = m.group()
    return " " if word in _UNITS or any(c.isupper() or c.isdigit() for c in word) else word


_HAN, _KANA, _LATIN = re.compile("[一-鿿㐀-䶿]"), re.compile("[ぁ-ヺ]"), re.compile("[A-Za-zÀ-ɏ]")
_REST = re.compile("[一-鿿㐀-䶿ぁ-ヿ\x00-ɏ\u2000-\u206f\u3000-\u303f\uff00-\uffef]")


_KEY = re.compile(r'"\w*"?\s*:|\\u[0-9a-fA-F]{0,4}|\\')


def is_foreign(said: list[str], languages: p9_language.Classifier | None = None) -> bool:
    """Whether the wording of prose and values is not Chinese: by language dictionaries, and by script where these can't tell."""
    if languages is not None:
        wording = " ".join(" ".join(_WORD.sub(_without_name if _HAN.search(s) else _without_abbreviation, _KEY.sub(" ", s)) for s in said).lower().split())
        if any(c.isalpha() for c in wording) and (foreign := languages.foreign_to(wording, "zh")) is not None:
            return foreign
    return _foreign_script(said)


def _foreign_script(said: list[str]) -> bool:
    """Another script, or Latin words beyond names and abbreviations.

    A capital makes a name only beside Han characters in the same text; a value
    without any may be in title case or German.
    """
    names = " ".join(_WORD.sub(_without_name if _HAN.search(s) else _without_abbreviation, s) if _LATIN.search(s) else s for s in said)
    han, kana, latin = len(_HAN.findall(names)), len(_KANA.findall(names)), len(_LATIN.findall(names))
    other = sum(c.isalpha() and c > "ɐ" and not "⺀" <= c <= "⿟" for c in _REST.sub("", names))
    if kana >= 2 and kana * 8 > han:
        return True
    if other > 2 and other > han:
        return True
    # a Han character says about as much as two or three Latin letters
    return latin > 3 and latin > 3 * han


def _joined(texts: list[str], most: int) -> bytes:
    kept = b""
    for t in dict.fromkeys(texts):
        if len(kept) < most:
            kept += t.encode("utf-8", "ignore") + b"\n"
    return kept


class Refusals:
    """Tells refusals by the smaller of two encodings."""

    def __init__(self, refusals: list[str], ordinary: list[str]):
        self.encoders = [p9_language.encoder(_joined(texts, REFUSAL_BYTES)) for texts in (refusals, ordinary)] if refusals and ordinary else []

    def __call__(self, text: str) -> bool:
        if not self.encoders:
            return False
        data = text.encode("utf-8", "ignore")
        declining, ordinary = (max(1, len(e.compress(data)) - 8) for e in self.encoders)
        return (1 + REFUSAL_MARGIN) * declining <= ordinary


def _declines(text: str) -> bool:
    return bool(REFUSALS.search(text) or REFUSALS_ABROAD.search(text))


def _names_label(value: dict) -> bool:
    """Whether an object's department or urgency is one, right or wrong; an object without both may name symptoms."""
    department, urgency = (value.get(k) for k in ("department", "urgency"))
    if department is None and urgency is None:
        return any(_visible(s) for s in _strings(value.get("symptoms")))
    return urgency in constants.URGENCIES or isinstance(department, str) and "科" in department


def _labelled(body: str, values: list) -> bool:
    """Whether an answer names a label, in an object or in prose; "cannot tell" in the place of one is none."""
    objects = [v for v in values if isinstance(v, dict) and _LABEL_KEYS & v.keys()]
    if objects:
        return any(map(_names_label, objects))
    return bool(re.search("(?:科室|紧急程度|症状)\\s*[：:]|\"department\"", body))


def _own_words(prose: str, strings: list[str]) -> str:
    """What an answer says without what it quotes, which tells nothing about its own intent."""
    return re.sub("“[^”]*”|「[^」]*」|\"[^\"]*\"", "", prose) + " " + " ".join(strings)


def fit_refusals(answers: DataFrame) -> tuple[list[str], list[str]]:
    """Own words of REFUSAL_SAMPLE declining answers, and as many prompts and prose beside labels."""
    some = lambda rows, column: [r[0] for r in rows.orderBy(F.xxhash64("key")).limit(REFUSAL_SAMPLE).select(column).collect()]
    declining = F.col("response").rlike(REFUSALS.pattern) & ~F.col("response").contains("department")
    read = [parts(t) for t in some(answers.where(declining), "response")]
    refusals = [w for body, values, prose in read if not _labelled(body, values) and _declines(w := _own_words(prose, [s for v in values for s in _strings(v)]))]
    beside = [prose for _, _, prose in map(parts, some(answers.where(F.col("response").rlike(r"\}\s*[^\s`}]{4}")), "response")) if prose.strip() and not _declines(prose)]
    return [w.strip() for w in refusals], beside + some(answers.where("prompt is not null"), "prompt")


def defect_of(text: str | None, prompt: str | None, languages: p9_language.Classifier | None = None, refusals: Refusals | None = None) -> str:
    """empty, copy, refusal, foreign (other_language) and declining (refusal) unless a structure was left open, silent (refusal unless it was cut in any way) or ''."""
    if text is None or not _visible(text):
        return "empty"
    body, values, prose = parts(text)
    strings = [s for v in values for s in _strings(v)]
    said = " ".join([prose, *strings])
    if not any(c.isalnum() for c in _visible(said)) and not (prose.strip() and "{" in prose):
        return "empty"
    if prompt and is_copy(said, prompt):
        return "copy"
    labelled = _labelled(body, values)
    if not labelled and _declines(own := _own_words(prose, strings)):
        return "refusal"
    if is_foreign([prose, *strings], languages):
        return "foreign"
    if not labelled:
        return "declining" if refusals is not None and refusals(own) else "silent"
    return ""


def _judge(dictionaries: dict[str, bytes], examples: tuple[list[str], list[str]]):
    @F.pandas_udf(T.StringType())
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        # lower case on both sides: a value in title case is the same word
        languages = p9_language.Classifier({lang: raw.decode("utf-8", "ignore").lower().encode() for lang, raw in dictionaries.items()}) if dictionaries else None
        refusals = Refusals(*examples)
        for text, prompt in batches:
            yield pd.Series([defect_of(t, p, languages, refusals) for t, p in zip(text, prompt, strict=True)], dtype=object)

    return judge


def defective(answers: DataFrame, labels: DataFrame, dictionaries: dict[str, bytes] | None = None) -> DataFrame:
    """``table_name, record_id, defect`` of defective ``answers`` (table_name, record_id, source, prompt, response).

    ``dictionaries`` are those of :func:`p9_language.fit`; without them languages
    are told by script. Null prompts allow every defect but copy; repeated rows
    are judged each.
    """
    keyed = answers.select(F.struct("table_name", "record_id").alias("key"), "source", "prompt", "response")
    refusals, ordinary = fit_refusals(keyed)
    dictionaries = dict(dictionaries or {})
    if "zh" in dictionaries:
        own = labels.select(F.col("label")).where("label is not null").orderBy(F.xxhash64("label")).limit(HOME_SAMPLE).collect()
        # labels taken from answers may be in another language themselves
        said = [s for r in own for v in parts(r["label"])[1] if not _foreign_script([s := " ".join(_strings(v))])]
        dictionaries["zh"] += _joined(said, HOME_BYTES) + _joined(ordinary, HOME_BYTES)
    judge = _judge(dictionaries, (refusals, ordinary))
    judged = cut_lineage(keyed.select("key", judge("response", "prompt").alias("d")).where("d <> ''"))
    settled = judged.where("d not in ('foreign', 'declining', 'silent')").select("key", F.col("d").alias("defect"))
    cut = p5_cutoff.cut_keys(keyed, labels)
    # an unknown ending says little in another language or after a refusal, an open structure says all
    named = F.when(F.col("d") == "foreign", "other_language").otherwise("refusal").alias("defect")
    leaning = judged.where("d in ('foreign', 'declining')").join(cut.where("structural"), "key", "left_anti").select("key", named)
    silent = judged.where("d = 'silent'").join(cut, "key", "left_anti").select("key", F.lit("refusal").alias("defect"))
    known = settled.union(leaning)
    truncated = cut.join(known.select("key"), "key", "left_anti").select("key", F.lit("truncated").alias("defect"))
    return known.union(silent).union(truncated).select("key.table_name", "key.record_id", "defect")


def answers_of(predictions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Answers of both tables with their prompts; the user message is the prompt of a pair."""
    user = F.try_element_at(F.filter("conversations", lambda m: m["from"].isin("human", "user")), F.lit(-1))["value"]
    a = predictions.select(F.lit("predictions").alias("table_name"), F.col("pred_id").alias("record_id"), "source", F.col("input").alias("prompt"), "response")
    b = pairs.select(F.lit("dpo_train_2").alias("table_name"), F.col("pair_id").alias("record_id"), F.col("_source").alias("source"), user.alias("prompt"), F.col("rejected.value").alias("response"))
    return a.union(b)
