"""License scans: an exact set-similarity join of text blocks against license templates.

A block is a window of the document's words; windows overlap by half and are
twice as long as the longest template, so any run of words that could match a
template lies in one of them.  The tokens of a block or template are its
distinct word pairs.  A block matches a template if it contains at least
``threshold`` of the template's tokens.

The join is exact and never compares all pairs:

* tokens that are in no template can't match and are left out at once;
* length filter: a block needs at least ceil(threshold * m) tokens for a
  template of m tokens;
* tokens are ordered by how many blocks have them, over the whole corpus, the
  rarest first; a match must share a token in the template's first
  m - required + 1 tokens (prefix filter), and the first shared one must leave
  enough tokens behind it on both sides (positional filter);
* what is left is counted in full.

The template side is a parameter of fixed size, so its postings are given to
every task; blocks are never gathered.

Defined cases: null and empty texts have no words, no labels and score 0;
repeated rows give the same answer each; rows that share a document id but not
its text are answered by (id, hash of text); an empty table gives no rows.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.text import table
from tillroll.storage import written

#: Fixed values of the query: phrases whose words stand consecutively, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Sentences by which common licenses are granted.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "gnu general public license as published by the free software foundation either version 3 of the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
]
THRESHOLD = 0.85
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.translate(_LOWER)) if text else []


def pairs(ws: list[str]) -> list[tuple[str, str]]:
    return list(dict.fromkeys(zip(ws, ws[1:])))


def required(size: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * size - 1e-9))


DOC = "doc_id long, text_hash long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, blocks array<struct<at:int,tokens:array<int>>>"


def read_blocks(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: words, phrase places, and the blocks that have enough template tokens."""
    wanted = [(tuple(words(p)), label) for p, label in phrases.items()]
    ids: dict[tuple[str, str], int] = {}
    for _, t in templates:
        for pair in pairs(words(t)):
            ids.setdefault(pair, len(ids))
    half = max(len(words(t)) for _, t in templates)
    least = min(required(len(pairs(words(t))), threshold) for _, t in templates)
    firsts: dict[tuple[str, str], list] = {}
    for phrase, label in wanted:
        firsts.setdefault(phrase[:2], []).append((phrase, label))

    def one(text):
        ws = words(text)
        places, labels, blocks = [], set(), {}
        token = ids.get
        for i, pair in enumerate(zip(ws, ws[1:])):
            if (k := token(pair)) is not None:
                for b in (i // half - 1, i // half):
                    # A pair belongs to a block only with both of its words.
                    if b >= 0 and i + 1 < (b + 2) * half:
                        blocks.setdefault(b, set()).add(k)
            if pair in firsts:
                for phrase, label in firsts[pair]:
                    if tuple(ws[i : i + len(phrase)]) == phrase:
                        places.append(i)
                        labels.add(label)
        kept = [{"at": b * half, "tokens": sorted(t)} for b, t in sorted(blocks.items()) if len(t) >= least]
        return len(ws), len(places), min(places, default=None), max(places, default=None), sorted(labels), kept

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()),
             pa.list_(pa.struct([("at", pa.int32()), ("tokens", pa.list_(pa.int32()))]))]
    names = ["doc_id", "text_hash", "n_words", "n_base", "first_word", "last_word", "base_labels", "blocks"]

    def scan(batches):
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                rows = [one(t.as_py()) for t in part.column(2)]
                cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(scan, DOC)


def containment_join(blocks: DataFrame, sets: list[tuple[str, list[int]]], threshold: float) -> DataFrame:
    """Blocks (key columns, tokens array<int>) with each set they contain to the threshold: label, score."""
    spark = blocks.sparkSession
    # One row per template token: how many blocks have it.  The order holds for the whole corpus.
    freq = {r[0]: r[1] for r in blocks.select(F.explode("tokens").alias("t")).groupBy("t").count().collect()}
    rank = {t: i for i, t in enumerate(sorted({t for _, s in sets for t in s}, key=lambda t: (freq.get(t, 0), t)))}
    postings = []
    for n, (label, tokens) in enumerate(sets):
        ordered = sorted(rank[t] for t in tokens)
        need = required(len(ordered), threshold)
        postings += [(t, n, label, i, need, ordered) for i, t in enumerate(ordered[: len(ordered) - need + 1])]
    right = spark.createDataFrame(postings, "t int, template int, label string, at_t int, need int, wanted array<int>")
    order = F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])
    keys = [c for c in blocks.columns if c != "tokens"]
    left = blocks.withColumn("ranked", F.sort_array(F.transform("tokens", lambda t: order[t])))
    probes = left.select(*keys, "ranked", F.posexplode("ranked").alias("at_b", "t"))
    # At most one posting per template token: the right side has a fixed, small size.
    met = probes.join(F.broadcast(right), "t").where(
        (F.size("ranked") >= F.col("need"))
        & (1 + F.least(F.size("ranked") - F.col("at_b") - 1, F.size("wanted") - F.col("at_t") - 1) >= F.col("need"))
    )
    shared = F.size(F.array_intersect("ranked", "wanted"))
    return met.where(shared >= F.col("need")).select(*keys, "label", (shared / F.size("wanted")).alias("score"))


def license_scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, word and phrase figures, labels of both kinds and the best containment found."""
    ids: dict[tuple[str, str], int] = {}
    sets = [(label, [ids.setdefault(p, len(ids)) for p in pairs(words(t))]) for label, t in templates]
    read = written(read_blocks(docs, phrases, templates, threshold), "license-blocks")
    blocks = read.select("doc_id", "text_hash", F.inline("blocks")).distinct()
    found = (
        containment_join(blocks, sets, threshold)
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set("label").alias("found"), F.max("score").alias("best"))
        .select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h"), "found", "best")
    )
    out = read.drop("blocks").join(found, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("text_hash") == F.col("__h")), "left")
    both = F.array_sort(F.array_union("base_labels", F.coalesce("found", F.array().cast("array<string>"))))
    score = F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.size("base_labels") > 0, 1.0).otherwise(0.0))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.concat_ws(",", "base_labels").alias("base_labels"), F.concat_ws(",", both).alias("labels"), score.alias("score"),
    )


def op2_licenses(spark, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
