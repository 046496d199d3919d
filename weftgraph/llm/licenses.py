"""License scan by diagonal voting, in DataFrame operations only.

Each document's rolling word pairs are exploded with their positions and joined to the template
positions of the same pair. A match votes for the diagonal (document position less template
position); diagonals that lie near each other (words put in or left out) are merged. A merged region is then
verified: its longest chain of matches in the order of both the text and the template, consecutive ones at most
``NEAR`` diagonals apart, says which share of the template's pairs stands there; a pair counts once. A phrase
stands where its diagonal has every vote. The join compares the pairs themselves, not only
their hashes, so every vote is verified.

Defined results: null or empty text has no words, no label and score 0; rows that repeat an id are
scanned each on their own; a very long text is one row of words, exploded as it is read; other columns are not read;
an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: (phrase, label): counted wherever all words stand consecutively.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: (label, template): found where a chain of matches holds COVERAGE of the word pairs; of fewer than eight pairs, all.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license"),
    ("reserved", "all rights reserved"),
    ("released-mit", "released under the mit license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
#: Share of a template's pairs that a chain must hold, and how far apart diagonals of consecutive matches may lie.
COVERAGE, NEAR = 0.875, 3
_MARK = "\0"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_rows(base=None, templates=None) -> list[tuple[str, int, int, int, bool, str]]:
    """(pair, template number, position, pairs in all, whether it is a base phrase, label)."""
    known = [(t, label, True) for t, label in (BASE if base is None else base)] + [(t, label, False) for label, t in (TEMPLATES if templates is None else templates)]
    out = [(_MARK, -1, 0, 1, False, "")]
    for number, (text, label, is_base) in enumerate(known):
        w = text.split()
        out += [(f"{a} {b}", number, i, len(w) - 1, is_base, label) for i, (a, b) in enumerate(zip(w, w[1:], strict=False))]
    return out


def _literal(x) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'").replace("\0", "\\0") + "'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x)


def _templates(spark: SparkSession, base, templates) -> DataFrame:
    rows = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in template_rows(base, templates))
    return spark.sql(f"SELECT *, xxhash64(pair) AS h FROM VALUES {rows} AS t(pair, template, tpos, pairs, is_base, label)")


def word_list(text: F.Column) -> F.Column:
    """A-Z in lower case, cut at all ASCII but letters and digits."""
    plain = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(plain) == F.char_length(plain), F.lower(plain)).otherwise(F.translate(plain, _UPPER, _LOWER))
    return F.array_remove(F.split(low, WORD_BREAKS), "")


def votes(docs: DataFrame, base=None, templates=None) -> DataFrame:
    """(row, doc_id, template, diagonal, at: template positions that voted, ...) of each document; the mark's diagonal is the word count."""
    cut = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), word_list(F.col("text")).alias("w"))
    pairs = F.zip_with("w", F.slice("w", F.lit(2), F.size("w")), lambda a, b: F.concat_ws(" ", a, b))
    gram = cut.select("row", "doc_id", F.posexplode(F.concat(pairs, F.array(F.lit(_MARK)))).alias("pos", "gram")).withColumn("h", F.xxhash64("gram"))
    met = gram.join(F.broadcast(_templates(docs.sparkSession, base, templates)), "h").filter(F.col("gram") == F.col("pair"))
    return met.groupBy("row", "doc_id", "template", "is_base", "label", "pairs", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.collect_set("tpos").alias("at"))


def chain(matches: F.Column, pairs: F.Column) -> F.Column:
    """Matches (pos, tpos) of the longest chain: both rise, and consecutive ones lie at most NEAR diagonals apart."""

    def add(state, x):
        # What lies further back than a template reaches can't be a link's other end.
        recent = F.filter(state["recent"], lambda r: r["pos"] >= x["pos"] - pairs - NEAR)
        before = F.filter(recent, lambda r: (r["tpos"] < x["tpos"]) & (r["pos"] < x["pos"]) & (F.abs((x["pos"] - x["tpos"]) - (r["pos"] - r["tpos"])) <= NEAR))
        best = F.coalesce(F.array_max(F.transform(before, lambda r: r["best"])), F.lit(0)) + 1
        return F.struct(F.concat(recent, F.array(F.struct(x["pos"].alias("pos"), x["tpos"].alias("tpos"), best.alias("best")))).alias("recent"), F.greatest(state["most"], best).alias("most"))

    start = F.struct(F.array().cast("array<struct<pos:int,tpos:int,best:int>>").alias("recent"), F.lit(0).alias("most"))
    return F.aggregate(F.array_sort(matches), start, add)["most"]


def spans(docs: DataFrame, base=None, templates=None) -> DataFrame:
    """Neighbouring diagonals taken together and verified: ``first`` (start word) and ``share`` (0 to 1) of each template's regions."""
    one = Window.partitionBy("row", "doc_id", "template").orderBy("diagonal")
    near = F.when(F.col("is_base"), 0).otherwise(NEAR)
    v = votes(docs, base, templates)
    v = v.withColumn("group", F.sum(F.when(F.col("diagonal") - F.lag("diagonal").over(one) <= near, 0).otherwise(1)).over(one))
    matches = F.transform("at", lambda t: F.struct((F.col("diagonal") + t).alias("pos"), t.alias("tpos")))
    merged = v.groupBy("row", "doc_id", "template", "is_base", "label", "pairs", "group").agg(F.min("diagonal").alias("first"), F.flatten(F.collect_list(matches)).alias("matches"))
    length = F.when(F.col("is_base") | (F.size("matches") < 2), F.size("matches")).otherwise(chain(F.col("matches"), F.col("pairs")))
    return merged.select("row", "doc_id", "template", "is_base", "label", "first", (length / F.col("pairs")).alias("share"))


def scan(docs: DataFrame, base=None, templates=None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of ``docs``."""
    s = spans(docs, base, templates)
    real, whole = F.col("template") >= 0, F.col("is_base") & (F.col("share") == 1.0)
    found = whole | (real & ~F.col("is_base") & (F.col("share") >= coverage))
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    return s.groupBy("row", "doc_id").agg(
        F.max(F.when(~real, F.col("first"))).cast("long").alias("n_words"), F.count_if(whole).alias("n_base"), F.min(F.when(whole, F.col("first"))).cast("long").alias("first_word"), F.max(F.when(whole, F.col("first"))).cast("long").alias("last_word"),
        listed(whole).alias("base_labels"), listed(found).alias("labels"), F.coalesce(F.max(F.when(real, F.col("share"))), F.lit(0.0)).alias("score"),
    ).drop("row")
