"""License scans by diagonal voting.

Templates are word sequences: short names of licenses, and notices and grants
of whole licenses.  Every rolling k-gram hash of a text (2 words for names, 4
for longer templates) is joined to the places of the same gram in the
templates.  A gram at word p that stands at word t of a template votes for the
diagonal p - t.  A name stands where one diagonal has all of its grams.  For a
longer template, diagonals close to one another (words were put in or left out)
are merged.  The merged span is then verified: each place of the template counts
once, and only where its words stand after those of the place before; a span
counts if that is enough of the template's grams, and their share is its score.

The templates are fixed, so their grams are a fixed small table: the scan of
the texts drops grams that no template has (the join's semi-join part, done
next to the hashing) and compares the words of those that it keeps, so votes
are never false.  What is left is joined, voted on and merged by Spark, spread
by document.

Nulls and empty texts have no words, no labels and score 0.  Repeated rows get
a result each, whatever their id; an empty table gives an empty result.  Very
long texts are hashed whole, one at a time; other columns, of whatever name, are
not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .words import ALNUM, Words, pieces, word_hashes, words_of

#: Names of licenses and their labels.
NAMES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Wording of public licenses and of the notices that go with them.
WORDING = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "apache": "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "lgpl": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
}

#: Grams of templates up to MOST_NAME words, and of longer ones.
NAME_GRAM, LONG_GRAM, MOST_NAME = 2, 4, 4
#: Diagonals this near to one another are merged; a merged span needs this share of a template's grams.
NEAR, SHARE = 6, 0.5


def templates() -> list[tuple[str, str, list[bytes], bool]]:
    """(template, label, words, is_name)."""
    out = [(f"name:{p}", label, words_of(p.encode(), ALNUM), True) for p, label in NAMES.items()]
    return out + [(f"text:{label}", label, words_of(t.encode(), ALNUM), False) for label, t in WORDING.items()]


def _grams():
    """Rows (gram, template, place, n_grams), and the words of each gram by its hash."""
    from .words import grams

    rows, words = [], {}
    for name, _, ws, is_name in templates():
        k = NAME_GRAM if is_name else LONG_GRAM
        h = grams(word_hashes(ws), k).view(np.int64).tolist()
        for i, g in enumerate(h):
            rows.append((g, name, i, len(h)))
            words.setdefault(g, []).append(ws[i : i + k])
    return rows, words


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """uid, doc_id, n_words and hits: the grams of a text that some template has, with their places."""
    _, words = _grams()
    sets = {k: np.array(sorted(g for g, w in words.items() if len(w[0]) == k), np.int64) for k in (NAME_GRAM, LONG_GRAM)}

    def run(batches):
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = shared.texts(batch)
            keys = batch.column("doc_id")
            for lo, hi in pieces(texts):
                w = Words(texts[lo:hi], ALNUM)
                hits = [[] for _ in range(hi - lo)]
                for k, known in sets.items():
                    h, ok = w.grams(k)
                    h = h.view(np.int64)
                    at = np.flatnonzero(ok & (known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h))
                    doc = np.searchsorted(w.first, at, "right") - 1
                    for i, d, g in zip(at.tolist(), doc.tolist(), h[at].tolist(), strict=True):
                        if [w.buf[a:b] for a, b in zip(w.start[i : i + k].tolist(), w.end[i : i + k].tolist(), strict=True)] in words[g]:
                            hits[d].append({"gram": g, "pos": i - int(w.first[d])})
                yield {"uid": np.arange(uid, uid + hi - lo), "doc_id": keys[lo:hi], "n_words": np.diff(w.first), "hits": hits}
                uid += hi - lo

    schema = "uid long, doc_id long, n_words long, hits array<struct<gram:long,pos:long>>"
    want = shared.arrow_schema(docs.sparkSession, schema)

    def rows(batches):
        import pyarrow as pa

        for out in run(batches):
            yield pa.RecordBatch.from_pydict(out, schema=want)

    return shared.written(shared.keyed(docs, key, text).mapInArrow(rows, schema), "license-scan")


def vote(scanned: DataFrame) -> DataFrame:
    """Spans (uid, template, label, is_name, start, votes, share) of templates in scanned texts."""
    spark = scanned.sparkSession
    rows, _ = _grams()
    places = F.broadcast(spark.createDataFrame(rows, "gram long, template string, place long, n_grams long"))  # fixed: the templates' grams
    about = F.broadcast(spark.createDataFrame([(n, label, is_name) for n, label, _, is_name in templates()], "template string, label string, is_name boolean"))
    hits = scanned.where(F.size("hits") > 0).select("uid", F.explode("hits").alias("h")).select("uid", "h.gram", "h.pos")
    voted = hits.join(places, "gram").withColumn("diagonal", F.col("pos") - F.col("place"))
    diagonals = voted.groupBy("uid", "template", "n_grams", "diagonal").agg(F.count(F.lit(1)).alias("votes")).join(about, "template")
    names = diagonals.where("is_name and votes = n_grams").select("uid", "template", "label", "is_name", F.col("diagonal").alias("start"), "votes", F.lit(1.0).alias("share"))
    along = Window.partitionBy("uid", "template").orderBy("diagonal")
    groups = (
        diagonals.where("not is_name")
        .withColumn("fresh", (F.col("diagonal") - F.lag("diagonal").over(along) > NEAR).cast("int"))
        .withColumn("group", F.sum(F.coalesce("fresh", F.lit(1))).over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .select("uid", "template", "diagonal", "group")
    )
    # each place of the template counts once in a group, however often its words are repeated
    held = voted.join(groups, ["uid", "template", "diagonal"]).groupBy("uid", "template", "n_grams", "group", "place").agg(F.min("pos").alias("pos"))
    spans = held.groupBy("uid", "template", "n_grams", "group").agg(F.array_sort(F.collect_list(F.struct("place", "pos"))).alias("at"), F.min("pos").alias("start"))
    # verified: places whose words stand after those of the template's place before (at most a template's grams in an array)
    forward = F.aggregate("at", F.struct(F.lit(0).alias("n"), F.lit(-1).cast("long").alias("pos")), lambda acc, x: F.struct((acc["n"] + F.when(x["pos"] > acc["pos"], 1).otherwise(0)).alias("n"), x["pos"].alias("pos")), lambda acc: acc["n"])
    sure = spans.withColumn("votes", forward.cast("long")).withColumn("share", F.col("votes") / F.col("n_grams")).where(F.col("share") >= SHARE).join(about, "template")
    return names.unionByName(sure.select(*names.columns))


def licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document."""
    scanned = scan(docs, key, text)
    base = F.when(F.col("is_name"), F.col("start"))
    by_doc = vote(scanned).groupBy("uid").agg(
        F.count(base).alias("n_base"),
        F.min(base).alias("first_word"),
        F.max(base).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("is_name"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
    )
    return scanned.select("uid", "doc_id", "n_words").join(by_doc, "uid", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
