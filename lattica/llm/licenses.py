"""License scan by diagonal voting: word k-grams joined to template positions, voted by offset, merged and verified."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import TERM, materialize

# The phrases of the base scan.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Wording of public licences and of their usual notices. A mark before a word: the k-gram that begins there must stand.
MARK = "!"
TEMPLATES: dict[str, str] = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights "
    "to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit",
    "licensed under the !apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-2",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-2",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-3",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software "
    "for any purpose including commercial applications and to alter it and redistribute it freely": "zlib",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license": "boost",
    "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "this program is free software you can redistribute it and or modify it under the terms of the !gnu general public license as published by the free software foundation either !version 2 of the license or at your option any later version": "gpl-2",
    "this program is free software you can redistribute it and or modify it under the terms of the !gnu general public license as published by the free software foundation either !version 3 of the license or at your option any later version": "gpl-3",
    "this library is free software you can redistribute it and or modify it under the terms of the !gnu lesser general public license as published by the free software foundation": "lgpl",
    "this program is free software you can redistribute it and or modify it under the terms of the !gnu affero general public license as published by the free software foundation": "agpl",
    "!gnu general public !license version 2": "gpl-2",
    "!gnu general public !license version 3": "gpl-3",
    "!gnu lesser general public license": "lgpl",
    "!gnu affero general public license": "agpl",
    "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl-2",
    "!mozilla public !license version 2": "mpl-2",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at": "epl-2",
    "!eclipse public !license version 2": "epl-2",
    "this work is licensed under a creative commons !attribution 4 0 international license": "cc-by",
    "this work is licensed under a creative commons !attribution sharealike 4 0 international license": "cc-by-sa",
    "this work is licensed under a creative commons !attribution noncommercial 4 0 international license": "cc-by-nc",
    "creative !commons attribution 4 0 international": "cc-by",
    "creative !commons attribution sharealike 4 0 international": "cc-by-sa",
    "creative !commons attribution noncommercial 4 0 international": "cc-by-nc",
    "creative commons zero v1 0 universal": "cc0",
    "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work": "cc0",
}

K = 3
#: k-grams of all templates up to which their table is broadcast, and up to which texts are sifted by a set of them before the join; beyond, the join does it all.
BROADCAST_UP_TO, SIFTED_UP_TO = 1_000_000, 20_000


def _table(spark: SparkSession, templates: list[tuple[str, str, bool]]) -> tuple[DataFrame, list[int]]:
    """(gram, w, t, at, m, must, label, base), the k-grams of the templates with the places that must stand, and the distinct hashes."""
    grams = []
    for t, (phrase, label, base) in enumerate(templates):
        marked = [x for x in phrase.lower().split() if re.search(TERM, x)]
        words = re.findall(TERM, phrase.lower())
        if len(words) < K:
            raise ValueError(f"a template needs {K} words: {phrase!r}")
        must = [i for i, x in enumerate(marked) if x.startswith(MARK)]
        for at in range(len(words) - K + 1):
            row = [F.lit(t).alias("t"), F.lit(at).alias("at"), F.lit(len(words)).alias("m"), F.array(*[F.lit(i) for i in must]).cast("array<int>").alias("must"), F.lit(label).alias("label"), F.lit(base).alias("base")]
            grams.append(F.struct(*row, F.array(*[F.lit(w) for w in words[at : at + K]]).alias("w")))
    table = spark.range(1).select(F.explode(F.array(*grams)).alias("g")).select("g.*")
    table = table.withColumn("gram", F.xxhash64(*[F.get("w", F.lit(i)) for i in range(K)]))
    hashes = [r.gram for r in table.select("gram").distinct().collect()] if len(grams) <= SIFTED_UP_TO else []
    return (F.broadcast(table) if len(grams) <= BROADCAST_UP_TO else table), hashes


def lowered(text: Column) -> Column:
    """Words as from lower-casing A-Z only, for comparisons with ASCII words.

    lower() also changes other letters, to letters that aren't ASCII; the one exception, the Kelvin
    sign, is put out of the way first. It is many times faster than translate().
    """
    return F.lower(F.replace(text, F.lit("K"), F.lit("�")))


def candidates(docs: DataFrame, hashes: list[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_words, grams): of each text the k-grams (pos, gram, w) whose hash is one of ``hashes``, or all if there are none; a written table, so texts are split once."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.regexp_extract_all(lowered(text), F.lit(TERM), F.lit(0)).alias("words"))
    n = F.size("words")
    gram = lambda i: F.struct(i.alias("pos"), F.xxhash64(*[F.get("words", i + j) for j in range(K)]).alias("gram"))
    grams = F.when(n >= K, F.transform(F.sequence(F.lit(0), n - K), gram))
    if hashes:
        grams = F.filter(grams, lambda x: x.gram.isin(hashes))
    grams = F.transform(grams, lambda x: F.struct(x.pos.alias("pos"), x.gram.alias("gram"), F.slice("words", x.pos + 1, K).alias("w")))
    return materialize(rows.select("doc_id", "text_hash", n.cast("long").alias("n_words"), grams.alias("grams")), "grams")


def _templates(docs: DataFrame, templates: dict[str, str] | None, base: dict[str, str] | None) -> tuple[DataFrame, list[int]]:
    base, templates = BASE if base is None else base, TEMPLATES if templates is None else templates
    return _table(docs.sparkSession, [(p, x, True) for p, x in base.items()] + [(p, x, False) for p, x in templates.items()])


def license_spans(docs: DataFrame, templates: dict[str, str] | None = None, base: dict[str, str] | None = None, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, label, base, start, stop, score): verified places of templates, words counted from 0.

    The hashes of all word k-grams are joined to the template positions that have them and
    the words are compared; each hit votes for its diagonal (text position less template position).
    From each diagonal on, those up to a quarter of the template further are merged, as insertions
    leave them. Such a span is verified if its hits cover ``least`` of the template's words, and every
    k-gram that the template marks; of neighbouring spans of a template the best is given, the first
    among equals. Base phrases must stand whole, word by word. Rows of one doc_id and text are one row here.
    """
    table, hashes = _templates(docs, templates, base)
    return _spans(candidates(docs, hashes, id_col, text_col), table, least)


def _spans(found: DataFrame, table: DataFrame, least: float) -> DataFrame:
    rows = found.where("size(grams) > 0").select("doc_id", "text_hash", F.explode("grams").alias("x")).select("doc_id", "text_hash", "x.pos", "x.gram", F.col("x.w").alias("v"))
    hits = rows.join(table, "gram").where(F.col("v") == F.col("w"))
    key = ["doc_id", "text_hash", "t", "m", "must", "label", "base"]
    diagonals = hits.groupBy(*key, (F.col("pos") - F.col("at")).cast("long").alias("diagonal")).agg(F.collect_set("at").alias("ats"))
    diagonals = materialize(diagonals, "diagonals", found.count())  # two branches read it
    whole = F.size("ats") == F.col("m") - K + 1
    exact = diagonals.where(whole & F.col("base")).select("doc_id", "text_hash", "label", "base", F.col("diagonal").cast("int").alias("start"), (F.col("diagonal") + F.col("m")).cast("int").alias("stop"), F.lit(1.0).alias("score"))
    # a template of m words reaches over m // 4 + 2 diagonals; the frame of the longest template is cut to each one's own
    reach = F.expr("m div 4 + 2")
    along = Window.partitionBy("doc_id", "text_hash", "t").orderBy("diagonal")
    widest = diagonals.where("not base").agg(F.max("m")).first()[0] or 0
    near = F.collect_list(F.struct("diagonal", "ats")).over(along.rangeBetween(0, widest // 4 + 2))
    long = diagonals.where("not base").withColumn("near", near)
    long = long.withColumn("near", F.filter("near", lambda x: x.diagonal <= F.col("diagonal") + reach))
    ats = F.array_distinct(F.flatten(F.transform("near", lambda x: x.ats)))
    places = F.flatten(F.transform("near", lambda x: F.transform(x.ats, lambda a: a + x.diagonal)))
    long = long.select(*key, "diagonal", ats.alias("ats"), F.array_min(places).alias("start"), (F.array_max(places) + K).alias("stop"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + K - 1)))))
    long = long.withColumn("score", covered / F.col("m")).where((F.col("score") >= least) & (F.size(F.array_except("must", "ats")) == 0))
    long = long.withColumn("span", F.sum(F.when(F.col("diagonal") - F.lag("diagonal").over(along) <= reach, 0).otherwise(1)).over(along))
    best = long.groupBy(*key, "span").agg(F.max_by(F.struct("start", "stop", "score"), F.struct("score", -F.col("diagonal"))).alias("b"))
    return exact.unionByName(best.select("doc_id", "text_hash", "label", "base", F.col("b.start").cast("int").alias("start"), F.col("b.stop").cast("int").alias("stop"), F.col("b.score").alias("score")))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, base: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row per row of ``docs``.

    n_base: places of base phrases; first_word and last_word: their least and greatest start, else
    null; base_labels and labels: distinct, sorted, comma-joined, empty if there are none; score:
    the best verified share of a template, 0 without any. Null texts count as empty; repeated rows give
    repeated rows; an empty table gives none; other columns are not read.
    """
    table, hashes = _templates(docs, templates, base)
    rows = candidates(docs, hashes, id_col, text_col)
    spans = _spans(rows, table, least)
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = spans.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(
        F.count_if("base").alias("n_base"), F.min(F.expr("if(base, start, null)")).alias("first_word"), F.max(F.expr("if(base, start, null)")).alias("last_word"),
        labels(F.expr("if(base, label, null)")).alias("base_labels"), labels("label").alias("labels"), F.max("score").alias("score"),
    )
    both = rows.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    return both.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).cast("double").alias("score"),
    )
