"""Problem 2: free-typed values mapped to the entries of a reference list.

Distinct values only are looked at. Each is brought to a plain form (look-alike
characters, traditional characters, inner spaces and list marks removed) and
stripped of additions such as severity, duration or a desk. Apart from a count
with a unit of time, additions are found in the data: an affix seen beside
several entries of the field, then those seen beside an entry once one such
affix is gone. What is a name, or a single character of one, is no addition.

What is left is looked up in BK-trees over the names of the entries, under the
Damerau-Levenshtein distance (with transpositions anywhere, so that it is a
metric). The list is split into shards of about ``SHARD_SIZE`` names; every shard
returns all names within the threshold and the shards' winners are merged.
"""

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelforge.functions import jsonx
from labelforge.llm import lookalike
from labelforge.session import broadcast_few, cut_lineage

#: Names per BK-tree; a longer list becomes more shards, not a larger broadcast.
SHARD_SIZE = 5000
#: Least number of tasks that the distinct values of a shard are split into, and values in one beyond that.
BUCKETS, BUCKET_VALUES = 24, 50_000
#: Different entries beside which an affix must have been seen to be an addition, and the share of the field's entries;
#: for affixes of several characters, and for a single one, which a slip of the keyboard makes more easily.
LONG_ENTRIES, LONG_SHARE, SHORT_ENTRIES, SHORT_SHARE = 2, 0.01, 3, 0.05
#: Cores whose neighbours a task remembers.
KNOWN = 200_000
#: Longest affix and longest duration, in characters.
MAX_AFFIX, MAX_DURATION = 8, 16

# A count and a unit of time or frequency, as an addition.
DURATION = r"[0-9一二两三四五六七八九十半数几多]+个?(?:小时|天|日|周|月|年|次|回)(?:有余|余|多|以上|左右|了)?"
# Characters of opposite meaning; a value that differs from a name only in these means something else.
OPPOSITES = ["内外", "上下", "左右", "高低", "多少", "升降", "快慢", "冷热", "软硬", "男女"]


def simplified_table(spark: SparkSession) -> dict[int, str]:
    """Traditional to simplified Han characters, from the ICU data that Spark ships (bounded by the script)."""
    icu = spark._jvm.com.ibm.icu.text.Transliterator.getInstance("Traditional-Simplified")
    chars = [chr(c) for c in range(0x4E00, 0xA000)]
    # separated, so that no rule for words of several characters applies
    out = icu.transliterate(" ".join(chars)).split(" ")
    return {ord(a): b for a, b in zip(chars, out, strict=True) if a != b and len(b) == 1}


def pinyin_table(spark: SparkSession) -> dict[str, str]:
    """Han characters to their reading without tone, from the same data."""
    icu = spark._jvm.com.ibm.icu.text.Transliterator.getInstance("Han-Latin; NFD; [:Mn:] Remove; NFC")
    chars = [chr(c) for c in range(0x4E00, 0xA000)]
    out = icu.transliterate("\n".join(chars)).split("\n")
    return {a: b.strip() for a, b in zip(chars, out, strict=True) if b.strip() and b.strip() != a}


def distance(a: str, b: str) -> int:
    """Damerau-Levenshtein distance with unrestricted transpositions (a metric)."""
    if a == b:
        return 0
    if set(a).isdisjoint(b):
        # nothing to keep or to swap
        return max(len(a), len(b))
    last: dict[str, int] = {}
    far = len(a) + len(b)
    h = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        h[i + 1][1] = i
    for j in range(len(b) + 1):
        h[1][j + 1] = j
    for i in range(1, len(a) + 1):
        hit, above, here = 0, h[i], h[i + 1]
        for j in range(1, len(b) + 1):
            i1, j1 = last.get(b[j - 1], 0), hit
            cost = 1
            if a[i - 1] == b[j - 1]:
                cost, hit = 0, j
            best = above[j] + cost
            if here[j] < best:
                best = here[j] + 1
            if above[j + 1] < best:
                best = above[j + 1] + 1
            if i1 and j1 and (swap := h[i1][j1] + (i - i1 - 1) + 1 + (j - j1 - 1)) < best:
                best = swap
            here[j + 1] = best
        last[a[i - 1]] = i
    return h[len(a) + 1][len(b) + 1]


class BKTree:
    """Names by distance to their parent; the triangle inequality prunes a search."""

    def __init__(self, names: list[str]):
        self.root: tuple[str, dict] | None = None
        for name in names:
            if self.root is None:
                self.root = (name, {})
                continue
            node = self.root
            while (d := distance(name, node[0])) and d in node[1]:
                node = node[1][d]
            if d:
                node[1][d] = (name, {})

    def within(self, text: str, most: int) -> Iterator[tuple[str, int]]:
        """Every name at a distance of at most ``most``."""
        todo = [self.root] if self.root else []
        while todo:
            name, children = todo.pop()
            d = distance(text, name)
            if d <= most:
                yield name, d
            todo.extend(child for k, child in children.items() if d - most <= k <= d + most)


def threshold(text: str) -> int:
    """Edits allowed in a text: none in one character, one up to seven, then two."""
    return 0 if len(text) < 2 else 1 if len(text) < 8 else 2


_MARKS = " \t\n.,;:!?、。-_*#·【】[]{}<>《》「」“”\"'()/~"


def _plain(text: str, simplified: dict[int, str]) -> str:
    out = lookalike.same_look(text).translate(simplified)
    out = re.sub(r"^[\s【\[(-]*(?:[0-9]{1,2}[.、)])+\s*", "", out)
    return "".join(out.split())


def plain_udf(simplified: dict[int, str]):
    @F.pandas_udf(T.StringType())
    def plain(values: pd.Series) -> pd.Series:
        return values.map(lambda v: _plain(v, simplified), na_action="ignore")

    return plain


_NUMBER = re.compile(r"[0-9]{1,2}[.、)]")
_DURATION = re.compile(DURATION + "$")


def cores(text: str, prefixes: set[str], suffixes: set[str], longest: int) -> list[str]:
    """The text and what additions taken off its ends leave, if at most ``longest`` characters, longest first.

    Beginnings and ends are stripped apart and then combined, so a text of any
    length is looked at once from each side.
    """
    starts, ends = set(), set()
    todo = [0]
    while todo:
        a = todo.pop()
        while a < len(text) and text[a] in _MARKS:
            a += 1
        if a in starts or a >= len(text):
            continue
        starts.add(a)
        todo += [a + n for n in range(1, MAX_AFFIX + 1) if text[a : a + n] in prefixes]
        if m := _NUMBER.match(text, a):
            todo.append(m.end())
    todo = [len(text)]
    while todo:
        b = todo.pop()
        while b > 0 and text[b - 1] in _MARKS:
            b -= 1
        if b in ends or b <= 0:
            continue
        ends.add(b)
        todo += [b - n for n in range(1, MAX_AFFIX + 1) if text[max(0, b - n) : b] in suffixes]
        if m := _DURATION.search(text[max(0, b - MAX_DURATION) : b]):
            todo.append(b - len(m.group()))
    ordered = sorted(ends)
    found = {text[a:b] for a in starts for b in ordered[bisect.bisect_right(ordered, a) : bisect.bisect_right(ordered, a + longest)]}
    return sorted(found, key=lambda t: (-len(t), t))


def _parts(plain: DataFrame) -> DataFrame:
    """``field, side, name, affix``: every way to take a prefix or a suffix off a value; marks around an affix are no part of it."""
    n = F.length("plain")
    # an affix is short, so a value of any length has few cuts
    places = F.array_distinct(F.concat(F.sequence(F.lit(1), F.least(F.lit(MAX_AFFIX), n - 1)), F.sequence(F.greatest(F.lit(1), n - MAX_AFFIX), n - 1)))
    cuts = plain.where(n > 1).select("field", "plain", F.explode(places).alias("cut"))
    head, tail = F.substring("plain", 1, F.col("cut")), F.expr("substring(plain, cut + 1)")
    parts = cuts.select("field", F.explode(F.array(F.struct(F.lit("suffix").alias("side"), head.alias("name"), tail.alias("affix")), F.struct(F.lit("prefix").alias("side"), tail.alias("name"), head.alias("affix")))).alias("p")).select("field", "p.*")
    return parts.where(F.length("affix") <= MAX_AFFIX).withColumn("affix", F.btrim("affix", F.lit(_MARKS))).where("affix <> ''")


def learned_additions(plain: DataFrame, names: DataFrame) -> DataFrame:
    """``field, side, affix`` of the additions; ``plain`` has one row per distinct ``field, plain``.

    The parts of each value are joined with the names by equality, so no value
    meets every name. Two rounds: the second also sees each value without one
    addition of the first.
    """
    fields = names.groupBy("field").agg(F.countDistinct("term_id").alias("all_entries"))
    letters = names.select("field", F.explode(F.split("name", "")).alias("affix")).distinct()

    def round_of(values: DataFrame) -> DataFrame:
        seen = _parts(values).join(broadcast_few(names), ["field", "name"]).groupBy("field", "side", "affix").agg(F.countDistinct("term_id").alias("entries")).join(broadcast_few(fields), "field")
        single = F.length("affix") == 1
        least = F.when(single, F.greatest(F.lit(SHORT_ENTRIES), SHORT_SHARE * F.col("all_entries"))).otherwise(F.greatest(F.lit(LONG_ENTRIES), LONG_SHARE * F.col("all_entries")))
        often = seen.where(F.col("entries") >= least).select("field", "side", "affix")
        often = often.join(names.select("field", F.col("name").alias("affix")), ["field", "affix"], "left_anti")
        return often.join(letters, ["field", "affix"], "left_anti").select("field", "side", "affix")

    first = cut_lineage(round_of(plain))
    shorter = _parts(plain).join(broadcast_few(first), ["field", "side", "affix"]).select("field", F.btrim("name", F.lit(_MARKS)).alias("plain"))
    return cut_lineage(first.union(round_of(plain.union(shorter).distinct())).distinct())


def _opposite(text: str, name: str) -> bool:
    diff = [(a, b) for a, b in zip(text, name, strict=False) if a != b]
    return len(text) == len(name) and len(diff) == 1 and any(set(diff[0]) == set(p) for p in OPPOSITES)


class _Field:
    """Names and additions of one field in one shard."""

    def __init__(self, head: pd.DataFrame, pinyin: dict[str, str]):
        names, affixes = head[head["kind"] == "name"], head[head["kind"] == "affix"]
        self.ids = dict(zip(names["text"], names["term_id"].astype(int), strict=True))
        self.tree = BKTree(list(self.ids))
        self.longest = max(map(len, self.ids), default=0)
        self.prefixes, self.suffixes = ({*affixes.loc[affixes["side"] == side, "text"]} for side in ("prefix", "suffix"))
        self.pinyin = pinyin
        self.known: dict[tuple[str, int], list[tuple[int, int, int, int]]] = {}

    def _sound(self, text: str) -> str:
        return "".join(self.pinyin.get(c, c) for c in text)

    def near(self, core: str, most: int) -> list[tuple[int, int, int, int]]:
        """``term_id, distance, heard, moved`` of every name within the distance that means no opposite."""
        if (core, most) not in self.known:
            if len(self.known) >= KNOWN:
                self.known.clear()
            # among names equally far, one that sounds the same is meant, then one of the same characters
            self.known[core, most] = [
                (self.ids[name], d, int(self._sound(core) != self._sound(name)), int(sorted(core) != sorted(name)))
                for name, d in self.tree.within(core, most)
                if not (d and _opposite(core, name))
            ]
        return self.known[core, most]

    def search(self, plain: str) -> list[tuple[int, int, int, int, int]]:
        """All names near a core of the value; if a core is a name itself, only such."""
        # a core beyond the longest name by more than its threshold is near none: the distance is at least the difference in length
        found = cores(plain, self.prefixes, self.suffixes, self.longest + threshold("x" * 99))
        # at distance 0 is the name itself
        hits = [(*hit, k) for k, core in enumerate(found) if core in self.ids for hit in self.near(core, 0)]
        return hits or [(*hit, k) for k, core in enumerate(found) for hit in self.near(core, threshold(core))]


def lookup(values: DataFrame, names: DataFrame, additions: DataFrame, spark: SparkSession) -> DataFrame:
    """``field, plain, term_id``: the entry meant by each distinct plain value, -1 for none."""
    pinyin = pinyin_table(spark)

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A task's rows start with the names and additions of its shard; the values come after them."""
        head: list[pd.DataFrame] = []
        fields: dict[str, _Field] | None = None
        for frame in frames:
            is_value = frame["kind"] == "value"
            if not is_value.all():
                head.append(frame[~is_value])
            if not is_value.any():
                continue
            if fields is None:
                fields = {f: _Field(part, pinyin) for f, part in pd.concat(head).groupby("field")} if head else {}
            rows = []
            for field, plain in zip(frame.loc[is_value, "field"], frame.loc[is_value, "text"], strict=True):
                if field in fields:
                    rows += [(field, plain, *hit) for hit in fields[field].search(plain)]
            yield pd.DataFrame(rows, columns=["field", "plain", "term_id", "d", "heard", "moved", "k"])

    # the list is fixed; more names than a shard holds become more shards
    shards = max(1, -(-names.count() // SHARD_SIZE))
    every = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    plain = values.select("field", "plain").distinct()
    buckets = max(BUCKETS, -(-values.count() // BUCKET_VALUES))
    all_buckets = F.transform(every(buckets), lambda b: F.col("shard") * buckets + b)
    own_shard = F.pmod(F.xxhash64("field", "name"), F.lit(shards)).cast("int")

    def row(kind: str, text: str, term_id: Column, side: Column, to: Column) -> list:
        return ["field", F.lit(kind).alias("kind"), F.col(text).alias("text"), term_id.cast("bigint").alias("term_id"), side.alias("side"), F.explode(to.cast("array<int>")).alias("cell")]

    name_rows = names.select("field", "name", "term_id", own_shard.alias("shard")).select(row("name", "name", F.col("term_id"), F.lit(""), all_buckets))
    affix_rows = additions.select(row("affix", "affix", F.lit(-1), F.col("side"), every(shards * buckets)))
    bucket = F.pmod(F.xxhash64("plain"), F.lit(buckets))
    value_rows = plain.select(row("value", "plain", F.lit(-1), F.lit(""), F.transform(every(shards), lambda s: s * buckets + bucket)))
    cells = name_rows.union(affix_rows).union(value_rows).repartitionById(shards * buckets, "cell").sortWithinPartitions(F.col("kind") == "value")
    found = cut_lineage(cells.select("field", "kind", "text", "term_id", "side").mapInPandas(search, "field string, plain string, term_id bigint, d int, heard int, moved int, k int"))
    # an entry must win alone: the nearest, then the same sound, then the same characters, then the longest core
    best = found.withColumn("rank", F.struct("d", "heard", "moved", "k"))
    top = best.groupBy("field", "plain").agg(F.min("rank").alias("rank"))
    won = best.join(top, ["field", "plain", "rank"]).groupBy("field", "plain").agg(F.countDistinct("term_id").alias("n"), F.min("term_id").alias("term_id"))
    return plain.join(won.where("n = 1").select("field", "plain", "term_id"), ["field", "plain"], "left").select("field", "plain", F.coalesce("term_id", F.lit(-1).cast("bigint")).alias("term_id"))


def typed_values(rows: DataFrame, id_col: str = "raw_id", output: str = "output") -> DataFrame:
    """``raw_id, field, pos, value`` of string departments (pos 0) and symptoms (from 1).

    Only outputs that are one JSON object once a code fence and blanks around it
    are gone; null outputs, values that are no strings and other keys give no row.
    """
    read = jsonx.settled(rows.select(F.col(id_col).alias("raw_id"), output), o=jsonx.object_map(jsonx.strip_fences(F.col(output), eos_tokens=False))).where("o is not null")
    value = lambda field, pos, v: F.struct(F.lit(field).alias("field"), pos.cast("int").alias("pos"), jsonx.string_value(v).alias("value"))
    items = F.coalesce(jsonx.array_items(F.try_element_at("o", F.lit("symptoms"))), F.array().cast("array<variant>"))
    typed = F.concat(F.array(value("department", F.lit(0), F.try_element_at("o", F.lit("department")))), F.transform(items, lambda v, i: value("symptoms", i + 1, v)))
    return read.select("raw_id", F.inline(typed)).where("value is not null")


def reference_names(terms: DataFrame) -> DataFrame:
    """``field, name, term_id``: terms and aliases in plain form; a name of two entries is dropped."""
    plain = plain_udf(simplified_table(terms.sparkSession))
    names = terms.select("field", "term_id", F.explode(F.concat(F.array("term"), F.coalesce("aliases", F.array()))).alias("name"))
    names = names.withColumn("name", plain("name")).where("name <> ''").distinct()
    return names.groupBy("field", "name").agg(F.min("term_id").alias("term_id"), F.count("*").alias("n")).where("n = 1").drop("n")


def map_values(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """``raw_id, field, pos, value, term_id`` for every typed value that is no term itself; -1 where none is meant."""
    spark = rows.sparkSession
    plain = plain_udf(simplified_table(spark))
    canonical = terms.select("field", F.col("term").alias("value"))
    typed = typed_values(rows).join(broadcast_few(canonical), ["field", "value"], "left_anti")
    typed = cut_lineage(typed)
    distinct = cut_lineage(typed.groupBy("field", "value").agg(F.count("*").alias("n")).withColumn("plain", plain("value")))
    names = cut_lineage(reference_names(terms))
    additions = learned_additions(distinct.select("field", "plain").distinct(), names)
    found = lookup(distinct, names, additions, spark)
    meant = distinct.join(found, ["field", "plain"]).select("field", "value", "term_id")
    return typed.join(meant, ["field", "value"]).select("raw_id", "field", F.col("pos").cast("int").alias("pos"), "value", "term_id")
