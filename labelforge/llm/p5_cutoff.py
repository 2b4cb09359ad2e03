"""Problem 5: texts that were cut at a limit or in transfer.

A stack automaton reads every text once: brackets, quotes and escapes of JSON,
paired quotes and brackets of prose, code fences, control tokens and broken
characters. Whatever is still open at the end means that the text was cut, a
closed structure with nothing behind it that it was not.

Prose that ends without a terminator is judged by terminal contexts, counted
over all texts: how the last segment starts and ends, or its last list item,
must be closed by a terminator often enough against how often it is left open,
in all answers and in those of the same source. Else the ending must be a habit
of its source, the baseline of its unterminated answers. Neither excuses an
answer at the length at which its source's answers pile up unfinished.
"""

import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelforge.session import cut_lineage

# Marks that end a sentence, and pairs of marks in prose.
TERMINATORS = "。！？!?.…～~”』」’"
PAIRS = {"“": "”", "‘": "’", "「": "」", "『": "』", "（": "）", "(": ")", "【": "】", "《": "》"}
_SPLIT = r"[。！？!?…\n；;}]|\.(?=\s|$)"
_LABEL = r"^\s*[^，、,。：]{1,4}：\s*"
_CONTROL = re.compile(r"(?:<\|[a-zA-Z_]+\|>|</s>|<s>|\s)+$")
_CONTROL_CUT = re.compile(r"<(?:\||\|[a-zA-Z_]+\|?|/|/?s)?$")

#: Characters kept of a segment's start and of its end.
START, END = 3, 4
#: An unterminated ending is a habit of a source from this share of its answers, and this count, on.
#: An ending that so many sources leave open more than once is a habit of all if it has this share and count over all answers.
HABIT_SHARE, HABIT_COUNT, HABIT_SOURCES = 0.001, 5, 2
#: A context excuses endings if it is closed at least so often for each that is open; from HABIT_COUNT open ones of a source on also by its rates.
CLOSED_RATE = 0.5
#: The greatest length of a source is a limit if so many answers have it and this part of them is unfinished, some of them
#: in the middle of a structure or in different ways (one ending alone is a habit).
LIMIT_COUNT, LIMIT_SHARE = 5, 0.5

WHOLE, CUT, ASK = 0, 1, 2


def _open_at_end(text: str) -> tuple[bool, int]:
    """Whether anything is open at the end, and where the last JSON value ended."""
    stack: list[str] = []
    json_depth, in_string, escaped, last, closed = 0, "", False, "", 0
    for i, c in enumerate(text):
        if in_string:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == in_string:
                in_string = ""
                last = c
            continue
        if json_depth:
            if c == '"' or (c == "'" and last in "[{:,"):
                in_string = c
            elif c in "{[":
                stack.append("}" if c == "{" else "]")
                json_depth += 1
            elif c in "}]" and stack[-1] == c:
                stack.pop()
                json_depth -= 1
                closed = i + 1
            if not c.isspace():
                last = c
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
            json_depth, last = 1, c
        elif c in PAIRS:
            stack.append(PAIRS[c])
        elif stack and c == stack[-1]:
            stack.pop()
    return bool(stack or in_string), closed


def last_segment(prose: str) -> tuple[str, str, str, str]:
    """Start, last clause's start, end and last list item of the last segment of a text."""
    labelled = [s for s in re.split(_SPLIT, prose) if s.strip()][-1]
    segment = re.sub(_LABEL, "", labelled).strip()
    item = re.split("[、，,：]", segment)[-1].strip() if "、" in segment or "症状" in labelled[:6] else ""
    return segment[:START], re.split("[，,]", segment)[-1].strip()[:START], segment[-END:], item


def scan(text: str | None, prompt: str | None = None) -> tuple[int, str, str, str, str]:
    """Verdict and, for ASK, the parts of the open segment by :func:`last_segment`.

    Null, empty and blank texts are whole: they were not cut but never there.
    """
    if text is None:
        return WHOLE, "", "", "", ""
    body = text.rstrip()
    if not body:
        return WHOLE, "", "", "", ""
    if body[0] in "{[\"n":
        # the common case, a whole JSON value, needs no automaton
        try:
            json.loads(body)
            return WHOLE, "", "", "", ""
        except ValueError:
            pass
    if body[-1] == "�" or 0xD800 <= ord(body[-1]) < 0xE000 or body.count("```") % 2 or _CONTROL_CUT.search(body):
        return CUT, "", "", "", ""
    body = _CONTROL.sub("", body)
    is_open, closed = _open_at_end(body)
    if is_open:
        return CUT, "", "", "", ""
    closed = max(closed, body.rfind("```") + 3 if "```" in body else 0)
    tail = body[closed:].strip()
    if not tail or tail[-1] in TERMINATORS or not any(c.isalnum() for c in body):
        return WHOLE, "", "", "", ""
    if prompt and len(body) > 0.6 * len(prompt):
        a, b = (re.sub(r"[\W_]+", "", x[-40:]) for x in (prompt, body))
        if a and a[-8:] in b[-16:]:
            return WHOLE, "", "", "", ""
    if tail[-1] in "，、：,:":
        return CUT, "", "", "", ""
    return ASK, *last_segment(tail)


_PARTS = ["start", "clause", "end", "item"]
_scan_type = T.StructType([T.StructField("verdict", T.IntegerType()), *(T.StructField(p, T.StringType()) for p in _PARTS)])


@F.pandas_udf(_scan_type)
def _scan(text: pd.Series, prompt: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([scan(t, p) for t, p in zip(text, prompt, strict=True)], columns=["verdict", *_PARTS])


_CLOSED = re.compile(r"[。！？!?…\n；;}.](?=[^。！？!?…\n；;}.]*$)")
_OBJECT = re.compile(r"\{.*\}", re.S)
_CLAUSES = re.compile(r"[，,。！？!?；;：:（）\n]")
_ITEMS = re.compile(r"([^、，。：；]+)(?=[、。])")
_SPLITTER, _LABELLED = re.compile(_SPLIT), re.compile(_LABEL)

#: Contexts that a task counts before it sends them.
KEPT = 500_000


def _plain_object(text: str) -> bool:
    """Whether a text is one flat object, perhaps fenced, without prose."""
    body = text.strip("`json \n\t\r")
    return body[:1] == "{" and body[-1:] == "}" and body.count("{") == 1


def _closed_parts(text: str) -> Iterator[tuple[str, str, str]]:
    """Start, last clause's start and end of each segment of a text, its JSON taken out."""
    for segment in _SPLITTER.split(_OBJECT.sub("\n", text) + "\n"):
        if len(segment) > 1 and (clean := _LABELLED.sub("", segment).strip()):
            yield clean[:START], re.split("[，,]", clean)[-1].strip()[:START], clean[-END:]


def _found_in(response: str | None, prompt: str | None) -> Iterator[tuple[str, str, str, str]]:
    if response and not _plain_object(response):
        ends = _CLOSED.search(response)
        if ends:
            for start, clause, end in _closed_parts(response[: ends.end()]):
                yield "a", start, clause, end
        if "、" in response:
            for item in _ITEMS.findall(response):
                if item := item.strip():
                    yield "i", item, "", ""
    if prompt:
        for start, _, end in _closed_parts(prompt):
            yield "p", start, "", end
        for clause in _CLAUSES.split(prompt):
            if clause:
                yield "c", "", clause.strip()[:START], clause[-END:]


def _counted(found: Iterator[Iterator], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Counts of what each frame holds, summed over the task's frames while they stay few."""
    total: Counter = Counter()

    def sent() -> pd.DataFrame:
        out = pd.DataFrame([(*key, n) for key, n in total.items()], columns=[*columns, "n"])
        total.clear()
        return out

    for keys in found:
        total.update(keys)
        if len(total) >= KEPT:
            yield sent()
    if total:
        yield sent()


def _contexts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``kind, start, clause, end, n``: a (closed segment of an answer), p (segment of a prompt), c (clause of a prompt), i (list item in prose)."""
    return _counted(((key for r, p in zip(f["response"], f["prompt"], strict=True) for key in _found_in(r, p)) for f in frames), ["kind", "start", "clause", "end"])


def _symptoms(label: str | None) -> Iterator[tuple[str]]:
    try:
        value = json.loads(label) if label else None
    except ValueError:
        return
    symptoms = value.get("symptoms") if isinstance(value, dict) else None
    for item in symptoms if isinstance(symptoms, list) else []:
        if isinstance(item, str) and (item := item.strip()):
            yield (item,)


def _label_items(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``item, n``: symptoms of whole label objects that have a list of them, without blank ones and what is no string."""
    return _counted(((key for label in f["label"] for key in _symptoms(label)) for f in frames), ["item"])


def _excused(ask: DataFrame, closed: DataFrame, sizes: DataFrame, *key: str) -> DataFrame:
    """``of`` and ``key`` of the endings whose context is closed often enough; ``closed`` has ``key`` and ``n``."""
    opened = ask.groupBy("of", *key).agg(F.count("*").alias("open")).join(sizes, "of")
    # few rows share a key: one for each source
    opened = opened.withColumn("open_in_all", F.sum("open").over(Window.partitionBy(*key)))
    often = (F.col("n") >= CLOSED_RATE * F.col("open_in_all")) & ((F.col("open") < HABIT_COUNT) | (F.col("n") * F.col("answers") >= CLOSED_RATE * F.col("open") * F.col("all_answers")))
    return closed.join(opened, list(key)).where(often).select("of", *key)


def cut_keys(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """``key, structural`` of cut responses among ``texts`` (key, source, prompt, response).

    ``structural`` tells whether something was left open, or only the ending is unknown.

    ``key`` identifies a row; repeated rows are judged alike, each on its own.
    A null prompt or source is allowed. ``labels`` has whole label objects as
    text in a column ``label``; an empty frame is allowed.

    An answer's last segment is a context only if a terminator closes it; a
    prompt's always is, as prompts are no answers and were not cut. The last
    clause of an answer counts only if no prompt holds it: answers quote
    clauses of their prompts in the middle of sentences.
    """
    # a null source is a source of its own
    of = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("of")
    scanned = cut_lineage(texts.select("key", of, F.length("response").alias("size"), _scan("response", "prompt").alias("s")).select("key", "of", "size", "s.*").where(F.col("verdict") != WHOLE))
    # most texts are settled by the automaton; only the rest meets the contexts
    ask = scanned.where(F.col("verdict") == ASK)
    seen = cut_lineage(texts.select("response", "prompt").mapInPandas(_contexts, "kind string, start string, clause string, end string, n bigint").groupBy("kind", "start", "clause", "end").agg(F.sum("n").alias("n")))
    segments = seen.where("kind in ('a', 'p')").groupBy("start", "end").agg(F.sum("n").alias("n"))
    asked = seen.where("kind = 'c'").select("clause", "end").distinct()
    clauses = seen.where("kind = 'a'").groupBy("clause", "end").agg(F.sum("n").alias("n")).join(asked, ["clause", "end"], "left_anti")
    # an ending outside a list has item '', which no item may excuse
    items = labels.select("label").mapInPandas(_label_items, "item string, n bigint").union(seen.where("kind = 'i'").select("start", "n")).where("item <> ''").groupBy("item").agg(F.sum("n").alias("n"))

    lengths = texts.groupBy(of, F.length("response").alias("size")).agg(F.count("*").alias("at"))
    sizes = cut_lineage(lengths.groupBy("of").agg(F.sum("at").alias("answers"), F.max(F.struct("size", "at")).alias("longest")))
    sizes = sizes.select("of", "answers", "longest", F.sum("answers").over(Window.partitionBy(F.lit(1))).alias("all_answers"))
    ways = F.count_if(F.col("verdict") == CUT) + F.when(F.min("end") < F.max("end"), 1).otherwise(0)
    open_at = scanned.groupBy("of", "size").agg(F.count("*").alias("open"), ways.alias("ways")).where("ways > 0")
    limits = sizes.join(open_at, "of").where((F.col("size") == F.col("longest.size")) & (F.col("longest.at") >= LIMIT_COUNT) & (F.col("open") >= LIMIT_SHARE * F.col("longest.at"))).select("of", "size")
    habits = ask.groupBy("of", "end").agg(F.count("*").alias("n")).join(sizes, "of").where((F.col("n") >= HABIT_COUNT) & (F.col("n") >= HABIT_SHARE * F.col("answers"))).select("of", "end")

    at_limit = ask.join(limits, ["of", "size"], "left_semi")
    common = ask.groupBy("of", "end").agg(F.count("*").alias("n")).groupBy("end").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 1).alias("sources"))
    common = common.where((F.col("sources") >= HABIT_SOURCES) & (F.col("n") >= HABIT_COUNT))
    total = sizes.agg(F.max("all_answers").alias("all_answers"))
    everywhere = common.join(F.broadcast(total), F.col("n") >= HABIT_SHARE * F.col("all_answers")).select("end")
    doubtful = ask.join(limits, ["of", "size"], "left_anti").join(habits, ["of", "end"], "left_anti").join(everywhere, "end", "left_anti")
    for closed, *key in ((segments, "start", "end"), (clauses, "clause", "end"), (items, "item")):
        doubtful = doubtful.join(_excused(ask, closed, sizes, *key), ["of", *key], "left_anti")
    return scanned.where(F.col("verdict") == CUT).select("key", F.lit(True).alias("structural")).union(at_limit.select("key").union(doubtful.select("key")).select("key", F.lit(False)))
