"""Licence statements in texts: fixed phrases, and an exact set-similarity join with templates.

Words are runs of digits, letters and non-ASCII characters, A-Z in lower case. The base
counts places where a phrase's words stand consecutively, anywhere in a text. The join finds
every text block (line) that holds at least `threshold` of a template's distinct words:

* template words are ordered by how many blocks of the whole corpus hold them, rarest first;
* prefix: with n words and a = ceil(threshold * n) to share, one of the template's first
  n - a + 1 words is among the first m - a + 1 of the m template words that a block holds;
* length: m is at least a;
* position: from the first shared word on, both have words enough left to reach a;
* what is left is verified by the exact overlap.

The templates are a fixed list in this module, so their table has a fixed size. Defined
results: null or empty text has no words and score 0; repeated rows each have a row, a null
id included; a very long line is one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.common import write_stage

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Short licence statements, as commonly written; fixed values.
TEMPLATES = [
    ("agpl-3.0", "licensed under the gnu affero general public license version 3"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd-3-clause", "licensed under the bsd 3 clause license"),
    ("cc-by-4.0", "licensed under creative commons attribution 4 0 international license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc0-1.0", "dedicated to the public domain under cc0 1 0 universal"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("lgpl-3.0", "licensed under the gnu lesser general public license version 3"),
    ("mit", "released under the mit license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license version 2 0"),
    ("proprietary", "all rights reserved"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def spaced(text: Column) -> Column:
    """The words of a text, a space before and after each."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(text, NOT_WORD, " ")), F.lit(" "))


def spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def phrase_places(docs: DataFrame) -> DataFrame:
    """Add n_words, n_base, first_word, last_word and base (labels) to rows with a column `low`."""
    w = F.col("spaced")
    n_words = F.when(w == "  ", F.lit(0)).otherwise(spaces(w) - 1).cast("long")
    firsts, lasts, counts, labels = [], [], [], []
    for phrase, label in PHRASES.items():
        p = f" {phrase} "
        has = F.contains(w, F.lit(p))
        at, back = F.instr(w, p), F.instr(F.reverse(w), p[::-1])
        firsts.append(F.when(has, spaces(F.substr(w, F.lit(1), at - 1))))
        lasts.append(F.when(has, n_words - spaces(F.substr(F.reverse(w), F.lit(1), back - 1)) - len(phrase.split())))
        counts.append(F.when(has, F.regexp_count(w, F.lit(f"(?= {phrase} )"))).otherwise(0))
        labels.append(F.when(has, F.lit(label)))
    return docs.withColumn("spaced", spaced(F.col("low"))).select(
        "*", n_words.alias("n_words"), sum(counts, F.lit(0)).cast("long").alias("n_base"), F.least(*firsts).cast("long").alias("first_word"),
        F.greatest(*lasts).cast("long").alias("last_word"), F.array_compact(F.array(*labels)).alias("base")).drop("spaced")


def held_words(words: list[str], line: Column) -> Column:
    """The template words that a line holds."""
    return F.array_intersect(F.array(*[F.lit(w) for w in words]), F.split(spaced(line), " "))


class Templates:
    """Word sets of the templates, what each must share, and their common vocabulary."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        self.sets = {label: sorted(set(text.split())) for label, text in templates}
        self.share = {label: -(-round(threshold * 1000) * len(ws) // 1000) for label, ws in self.sets.items()}
        self.words = sorted({w for ws in self.sets.values() for w in ws})
        self.least = min(self.share.values())

    def blocks(self, low: Column) -> Column:
        """The held words of each line that holds at least as many as some template must share."""
        return F.filter(F.transform(F.split(low, "\n"), lambda line: held_words(self.words, line)), lambda h: F.size(h) >= self.least)

    def frequencies(self, docs: DataFrame) -> dict[str, int]:
        """In how many lines of all texts each word stands; at most the templates' words."""
        lines = docs.select(F.explode(F.split("low", "\n")).alias("line"))
        each = lines.select(F.explode(held_words(self.words, F.col("line"))).alias("w"))
        return {r["w"]: r["n"] for r in each.groupBy("w").agg(F.count("*").alias("n")).collect()}


def template_blocks(rows: DataFrame, t: Templates, df: dict[str, int]) -> DataFrame:
    """row, label, containment of every block of the rows (row, blocks) that meets the threshold for a template."""
    order = sorted(t.words, key=lambda w: (df.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    prefixes = []
    for label, ws in t.sets.items():
        own = sorted(ws, key=rank.get)
        prefixes += [(w, label, i, len(own), t.share[label], own) for i, w in enumerate(own[:len(own) - t.share[label] + 1])]
    index = rows.sparkSession.createDataFrame(prefixes, "w string, label string, i int, n int, a int, own array<string>")
    in_order = F.filter(F.array(*[F.lit(w) for w in order]), lambda w: F.array_contains("held", w))
    blocks = rows.select("row", F.posexplode("blocks").alias("block", "held")).select("row", "block", in_order.alias("held"))
    probe = blocks.select("row", "block", "held", F.posexplode("held").alias("j", "w"))
    m = F.size("held")
    met = probe.join(index, "w").where((m >= F.col("a")) & (F.col("j") <= m - F.col("a")))
    met = met.groupBy("row", "block", "label").agg(F.min("i").alias("i"), F.min("j").alias("j"), F.first("n").alias("n"), F.first("a").alias("a"),
                                                   F.first("own").alias("own"), F.first("held").alias("held"))
    met = met.where(F.least(F.col("n") - F.col("i"), F.size("held") - F.col("j")) >= F.col("a"))
    shared = F.size(F.array_intersect("own", "held"))
    return met.where(shared >= F.col("a")).select("row", "label", (shared / F.col("n")).alias("containment"))


def scan(docs: DataFrame, threshold: float = 0.92, templates: list[tuple[str, str]] | None = None,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row of `docs`.

    score is the largest containment of a template in a block that meets the threshold, 1 if
    a phrase stands in the text, else 0.
    """
    low = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), low.alias("low"))
    t = Templates(templates or TEMPLATES, threshold)
    base = phrase_places(rows).withColumn("blocks", t.blocks(F.col("low"))).drop("low")
    base = write_stage(base.withColumn("row", F.monotonically_increasing_id()), "licence-rows")
    found = template_blocks(base.where(F.size("blocks") > 0), t, t.frequencies(rows))
    found = found.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    out = base.join(found, "row", "left")
    none = F.array().cast("array<string>")

    def joined(c):
        return F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("base")).alias("base_labels"),
                      joined(F.concat("base", F.coalesce("more", none))).alias("labels"),
                      F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))
