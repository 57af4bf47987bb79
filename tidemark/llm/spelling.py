"""Spelling variants: words one inserted, deleted or replaced letter apart, and the form each belongs to.

The words of a vocabulary form a trie, and read backwards a second one. Every node of both
has a number. A word with the letter at place i left out is then the pair (node of the
letters before i, node of the letters after i), and a word cut at place i the pair of the
two halves. Words that differ in one replaced letter share the pair that skips it; a word
with one letter more shares its skip pair with the cut of the shorter word. So every near
pair meets under one integer pair, and nothing else does. A pair is held by at most one
word per letter of the alphabet and one cut word, whatever the vocabulary: near words are
counted, and the most frequent of them found, inside that pair without listing them two by
two. In a run of equal letters only the first is left out when a word is compared with a
shorter one, so no near word counts twice.

Nodes down to ``HEAD`` letters are numbered by their letters; deeper ones are counted off
while the sorted words of one head stream by, holding only the path of the last word.

Null texts have no words, a null key counts as the empty text, rows that are repeated count
again, an empty table gives no words. Words of any length are taken whole; a word's work
and memory grow with its length. Other columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.materialize import materialize

from .text import lower_ascii

#: Letters a word is made of, all below U+0100.
LETTERS = "[A-Za-z\\u00C0-\\u00FF]"
#: Letters a trie node is numbered by itself; also what words are dealt by.
HEAD = 6
#: Kinds of rows: a word cut in two, a letter left out that opens a run of equal ones, any other left out.
CUT, FIRST, LATER = 0, 1, 2
#: Rows handed on at a time.
ROWS = 1 << 17


def runs(docs: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """``key`` and ``word`` of every run of at least ``least`` letters, A-Z lower-cased."""
    found = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))
    each = docs.select(F.col(f"`{key}`").cast("string").alias("key"), F.explode(found).alias("run"))
    return each.select("key", F.when(F.col("run").rlike("[A-Z]"), lower_ascii(F.col("run"))).otherwise(F.col("run")).alias("word"))


def misspelt(key: Column, word: Column, every: int = 199) -> Column:
    """The word, or, for one in ``every`` by its digest with the key, the word without one letter."""
    digest = F.crc32(F.concat(F.coalesce(key, F.lit("")), F.lit(":"), word))
    place = (digest % F.length(word)).cast("int")
    short = F.concat(F.substring(word, F.lit(1), place), F.substring(word, place + 2, F.length(word)))
    return F.when(digest % every == 0, short).otherwise(word)


def vocabulary(words: DataFrame, least: int = 6, least_n: int = 5) -> DataFrame:
    """``word`` and its number ``n`` of rows, for words of at least ``least`` letters and ``least_n`` rows."""
    long = words.filter(F.length("word") >= least)
    return long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_n)


def _path(words, last: str, nodes: list[int], base: int):
    """For sorted words the list of node numbers of all their prefixes, the empty one first."""
    for word in words:
        same, most = 0, min(len(word), len(last))
        while same < most and word[same] == last[same]:
            same += 1
        nodes = nodes[: same + 1]
        for depth in range(same + 1, len(word) + 1):
            if depth <= HEAD:
                if word[depth - 1] > "\xff":
                    raise ValueError(f"letter above U+00FF in {word!r}")
                nodes.append(nodes[-1] << 8 | ord(word[depth - 1]))
            else:
                base -= 1
                nodes.append(base)
        last = word
        yield word, nodes, base


def _dealt(words: DataFrame, column: str, *more: str) -> DataFrame:
    """Words of one head in one partition, sorted; the number of partitions is fixed, as nodes carry it."""
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return words.repartition(parts, F.substring(column, 1, HEAD)).sortWithinPartitions(column).select(column, *more)


def numbered(words: DataFrame) -> DataFrame:
    """Adds ``head`` and ``seq``, which together order words by code points, and ``before``:
    the node numbers of the prefixes of lengths 0, 1, and so on."""

    def run(batches):
        start = base = -1 - (TaskContext.get().partitionId() << 40)
        last, nodes = "", [0]
        seq = 0
        for batch in batches:
            heads, paths = [], []
            for last, nodes, base in _path(batch.column("word").to_pylist(), last, nodes, base):
                heads.append(nodes[min(HEAD, len(last))])
                paths.append(nodes)
            order = pa.array(range(seq, seq + len(heads)), pa.int64())
            seq += len(heads)
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("n"), pa.array(heads, pa.int64()), order, pa.array(paths, pa.list_(pa.int64()))],
                ["word", "n", "head", "seq", "before"],
            )
        assert start - base < 1 << 40

    return _dealt(words, "word", "n").mapInArrow(run, "word string, n long, head long, seq long, before array<long>")


def pairs(nodes: DataFrame) -> DataFrame:
    """One row per word and integer pair: ``before``, ``after``, ``kind`` and the word's n, head and seq."""

    def run(batches):
        base = -1 - (TaskContext.get().partitionId() << 40)
        last, nodes = "", [0]
        names = ["before", "after", "kind", "n", "head", "seq"]
        types = [pa.int64(), pa.int64(), pa.int8(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            out = [[] for _ in names]
            rows = zip(*(batch.column(c).to_pylist() for c in ("before", "n", "head", "seq")))
            path = _path(batch.column("back").to_pylist(), last, nodes, base)
            for (before, n, head, seq), (last, nodes, base) in zip(rows, path):
                after = nodes[::-1]
                size = len(last)
                out[0] += before
                out[0] += before[:-1]
                out[1] += after
                out[1] += after[1:]
                word = last[::-1]
                out[2] += [CUT] * (size + 1)
                out[2] += [FIRST, *(LATER if a == b else FIRST for a, b in zip(word, word[1:]))]
                for column, value in zip(out[3:], (n, head, seq)):
                    column += [value] * (2 * size + 1)
                if len(out[0]) >= ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)
                    out = [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    back = nodes.withColumn("back", F.reverse("word"))
    schema = "before long, after long, kind byte, n long, head long, seq long"
    return _dealt(back, "back", "before", "n", "head", "seq").mapInArrow(run, schema)


def near(held: DataFrame) -> DataFrame:
    """Per word (``head``, ``seq``) with near words: how many, and the most frequent as ``best``.

    ``best`` is (-n, head, seq), smallest first: of equal counts the first in code-point order.
    """
    word = F.struct((-F.col("n")).alias("less"), "head", "seq")
    kind = F.col("kind")
    whole = (
        Window.partitionBy("before", "after")
        .orderBy((kind == CUT).cast("int"), F.col("n").desc(), "head", "seq")
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    left_out = F.count_if(kind != CUT).over(whole)
    opening = F.count_if(kind == FIRST).over(whole)
    cut = F.min(F.when(kind == CUT, word)).over(whole)
    first, second = F.first(word).over(whole), F.nth_value(word, 2).over(whole)
    shared = held.select(
        "head", "seq", kind, word.alias("word"), left_out.alias("left_out"), opening.alias("opening"), cut.alias("cut"),
        first.alias("first"), second.alias("second"), F.min(F.when(kind == FIRST, word)).over(whole).alias("opens"),
    )
    others = F.when(F.col("left_out") > 1, F.when(F.col("first") == F.col("word"), F.col("second")).otherwise(F.col("first")))
    shorter = F.when(kind == FIRST, F.col("cut"))
    found = shared.select(
        "head",
        "seq",
        F.when(kind == CUT, F.col("opening")).otherwise(F.col("left_out") - 1 + shorter.isNotNull().cast("long")).alias("n_near"),
        F.when(kind == CUT, F.col("opens")).otherwise(F.least(others, shorter)).alias("best"),
    )
    return found.filter(F.col("n_near") > 0).groupBy("head", "seq").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def _ends(links: DataFrame) -> DataFrame:
    """Follow (head, seq) -> form to its end: what is followed doubles every round."""
    while True:
        on = links.select(F.col("id").alias("form"), F.col("form").alias("further"))
        step = links.join(on, "form", "left").select("id", F.coalesce("further", "form").alias("form"), F.col("further").isNotNull().alias("moved"))
        step = materialize(step)
        links = step.drop("moved")
        if step.filter("moved").isEmpty():
            return links


def grouped(words: DataFrame, factor: int = 5) -> DataFrame:
    """For each ``word`` with count ``n`` its number of near words, its form and its root.

    The form is the most frequent near word, if that is at least ``factor`` times as
    frequent; the root is where following forms ends, the word itself if it has none.
    Words must be unique.
    """
    nodes = materialize(numbered(words))
    found = nodes.select("word", "n", "head", "seq").join(near(pairs(nodes)), ["head", "seq"], "left")
    best = F.col("best")
    found = materialize(
        found.select(
            F.struct("head", "seq").alias("id"),
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(-best["less"] >= factor * F.col("n"), F.struct(best["head"], best["seq"])).alias("form"),
        )
    )
    links = found.filter(F.col("form").isNotNull()).select("id", "form")
    ends = _ends(links).select("id", F.col("form").alias("end"))
    named = found.select(F.col("id").alias("form"), F.col("word").alias("form_word"), F.col("n").alias("form_n"))
    last = found.select(F.col("id").alias("end"), F.col("word").alias("end_word"))
    linked = found.filter(F.col("form").isNotNull()).join(named, "form").join(ends, "id").join(last, "end")
    free = found.filter(F.col("form").isNull())
    none = F.lit(None)
    return linked.select("word", F.col("form_word").alias("form"), F.col("end_word").alias("root"), "n", "n_near", "form_n").unionByName(
        free.select("word", none.cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", none.cast("long").alias("form_n"))
    )
