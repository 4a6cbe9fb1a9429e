"""Spelling variants of a corpus' words by an index of variable-length grams.

Words are counted over whole texts. Grams of LEAST to MOST letters are counted over the words (each between two marks for its
start and end); a gram too frequent to choose by is replaced by its extensions, one rare enough is not extended, which prunes the
dictionary. A word is cut into variable grams: at each place the longest gram of the dictionary (else the shortest length), left
out where an earlier gram covers it.

One inserted, deleted or replaced letter changes a bounded number of a word's grams, worked out for each word: the most, over
all places, of the grams that cross the edit, that a longer gram before it could replace, or that a gram across it could
cover. Two words one edit apart share all others at the same distance from the start or the end, so among as many of the
rarest grams as can be affected and one more, both have one in common. Only these are listed, by gram, place and length; the
lists are merged into pairs, which are verified letter by letter. Words whose every gram may be affected are few and short; they meet each other by the strings that one deletion
leaves, which is exact as well.

The dictionary is broadcast. It holds at most FREQUENT frequent grams' extensions and the shortest grams, whatever the corpus:
beyond that, the frequency at which a gram is extended rises.

A word's form is its near word with the largest count (the first in code-point order of equals), if that is at least twice its
own; forms at least double the count, so roots are found in rounds that double the steps. A null text has no words and a null
doc_id is an empty text in the key. Repeated rows count as often as they occur. Columns but doc_id and text are not read.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import texts_of, written

#: Lengths of grams, and the marks of a word's start and end.
LEAST, MOST, START, END = 2, 4, "^", "$"
#: Occurrences over which a gram is extended, at least, and grams that are extended, at most.
FREQUENCY, FREQUENT = 64, 30_000


def word_counts(docs: DataFrame, least_length: int = 5, least_count: int = 3, one_in: int = 97) -> DataFrame:
    """word and n: runs of letters, A-Z lower-cased, one in so many (by document and run) with a letter deleted."""
    run = F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z\\u00C0-\\u00FF]+"), F.lit(0))).alias("run")
    ascii_only = F.octet_length("run") == F.length("run")
    lower = F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", string.ascii_uppercase, string.ascii_lowercase))
    runs = texts_of(docs).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run).where(F.length("run") >= least_length).select("id", lower.alias("run"))
    runs = runs.withColumn("h", F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8")))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % one_in == 0, shorter).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


class Dictionary:
    """Counted grams, and what a word's edits can change in its variable grams."""

    def __init__(self, counts: dict[str, int], frequency: int):
        self.counts = counts
        self.long = {g for g, n in counts.items() if len(g) > LEAST and (len(g) == MOST or n <= frequency)}
        self.heads = {g[:k] for g in self.long for k in range(1, len(g))}
        self.tails = {g[k:] for g in self.long for k in range(1, len(g))}

    def grams(self, word: str) -> list[tuple[int, str]]:
        """(place, gram) of a marked word."""
        out, covered, long = [], 0, self.long
        for p in range(len(word) - LEAST + 1):
            for q in range(MOST, LEAST, -1):
                g = word[p : p + q]
                if len(g) == q and g in long:
                    break
            else:
                g = word[p : p + LEAST]
            if p + len(g) > covered:
                covered = p + len(g)
                out.append((p, g))
        return out

    def affected(self, word: str, grams: list[tuple[int, str]]) -> int:
        """The most grams of a marked word that one edit between the marks can change."""
        spans = [(p, p + len(g)) for p, g in grams]
        size = len(word)
        # From which place on grams before an edit at i may grow across it; up to which end grams behind i may be covered.
        grows = [next((p for p in range(max(0, i - MOST + 1), i) if word[p:i] in self.heads), i) for i in range(size + 1)]
        covers = [next((i + e for e in range(min(MOST - 1, size - i), 0, -1) if word[i : i + e] in self.tails), i) for i in range(size + 1)]
        most = 0
        for i in range(1, size):
            before = sum(1 for p, e in spans if p < grows[i] and e <= i)
            for behind in (i, i + 1):  # an insertion before i; a replacement or deletion of i
                if behind < size:
                    most = max(most, len(spans) - before - sum(1 for p, e in spans if p >= behind and e > covers[behind]))
        return most

    def cut(self, word: str) -> tuple[list[tuple[int, str]], bool]:
        """The rarest grams of which every near word must share one; whether there may be none."""
        marked = f"{START}{word}{END}"
        grams = self.grams(marked)
        affected = self.affected(marked, grams)
        return sorted(grams, key=lambda x: (self.counts.get(x[1], 0), x[1], x[0]))[: affected + 1], affected >= len(grams)


def gram_dictionary(words: DataFrame, frequency: int = FREQUENCY, frequent: int = FREQUENT) -> Dictionary:
    """The pruned dictionary of words."""
    marked = F.concat(F.lit(START), "word", F.lit(END))
    places = F.sequence(F.lit(1), F.length("m") - LEAST + 1)
    of_place = lambda p: F.transform(F.sequence(F.lit(LEAST), F.least(F.lit(MOST), F.length("m") - p + 1)), lambda q: F.substring(F.col("m"), p, q))
    gram = F.explode(F.flatten(F.transform(places, of_place))).alias("gram")
    counts = written(words.select(marked.alias("m")).select(gram).groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram-counts")
    total = counts.where(F.length("gram") < MOST).agg(F.sum("n")).first()[0] or 0
    frequency = max(frequency, total // frequent)
    parents = counts.where((F.length("gram") < MOST) & (F.col("n") > frequency)).select(F.col("gram").alias("head"))
    extended = counts.where(F.length("gram") > LEAST).join(parents, F.expr("substring(gram, 1, length(gram) - 1)") == F.col("head"), "left_semi")
    shortest = counts.where(F.length("gram") == LEAST)
    return Dictionary({r["gram"]: r["n"] for r in shortest.unionByName(extended).toLocalIterator()}, frequency)


def near_pairs(words: DataFrame) -> DataFrame:
    """a and b: the words (distinct rows of words) that differ by one inserted, deleted or replaced letter, a before b by length and letters."""
    shared = words.sparkSession.sparkContext.broadcast(gram_dictionary(words))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, grams, places, bare = [], [], [], []
            for i, w in enumerate(b.column(0).to_pylist()):
                first, open_end = shared.value.cut(w)
                of += [i] * len(first)
                bare += [open_end] * len(first)
                places += [p for p, _ in first]
                grams += [g for _, g in first]
            yield pa.record_batch([b.column(0).take(pa.array(of, pa.int64())), pa.array(grams, pa.string()), pa.array(places, pa.int32()), pa.array(bare, pa.bool_())], ["word", "gram", "place", "bare"])

    index = written(words.select("word").mapInArrow(cut, "word string, gram string, place int, bare boolean"), "gram-index")
    # Lists by gram, place and length. An edit before the gram moves it by one in the longer word.
    listed = lambda move, more: F.xxhash64("gram", F.col("place") + move, F.length("word") + more)
    lists = index.select(listed(0, 0).alias("key"), F.col("word").alias("b"))
    probes = index.select(F.explode(F.array(listed(0, 0), listed(0, 1), listed(1, 1))).alias("key"), F.col("word").alias("a"))
    first = (F.length("a") < F.length("b")) | (F.length("a") == F.length("b")) & (F.col("a") < F.col("b"))
    near = first & (F.length("b") - F.length("a") <= 1) & (F.levenshtein("a", "b", 1) == 1)
    merged = probes.join(lists, "key").where(near).select("a", "b")
    # Words whose every gram an edit may change.
    word = F.col("word")
    left = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    rest = index.where("bare").select("word").distinct().select("word", F.explode(F.array_distinct(F.concat(F.array(word), left))).alias("rest"))
    met = rest.select(word.alias("a"), "rest").join(rest.select(word.alias("b"), "rest"), "rest").where(near).select("a", "b")
    return merged.unionByName(met).distinct()


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word."""
    words = written(word_counts(docs), "spelling-words")
    pairs = near_pairs(words)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("m")), "b")
    of = counted.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("b").alias("b"))).alias("best"))
    near = words.join(of.withColumnRenamed("a", "word"), "word", "left")
    strong = -F.col("best.m") >= 2 * F.col("n")
    table = near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.b")).alias("form"), F.when(strong, -F.col("best.m")).alias("form_n"))
    table = written(table, "spelling-forms")
    steps = table.select("word", F.coalesce("form", "word").alias("to"))
    while True:
        # A table of all words, each with the word twice as many steps on.
        on = steps.select(F.col("word").alias("to"), F.col("to").alias("next"))
        moved = written(steps.join(on, "to").select("word", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")), "spelling-steps")
        steps = moved.select("word", "to")
        if moved.where("moved").isEmpty():
            break
    return table.join(steps.withColumnRenamed("to", "root"), "word").select("word", "form", "root", "n", "n_near", "form_n")
