"""License scans by sentence rules.

Texts are cut into sentences, sentences are normalised (lower case, runs of other than letters and digits to one space)
and looked up among known licence sentences. The identifiers found, in text order, are matched against rules, each an
ordered sequence of identifiers that names a licence. Rules must match without another known sentence between; of
matches in one place a rule whose sequence holds another's is reported alone.

Sentences are cut in two ways, as notices stand on lines of their own while full texts wrap: at line ends, and at blank
lines only. Each way gives its own sequence of identifiers.

Only texts with a word of ``HINT`` are cut, as every rule has a sentence with one (``check_rules``). Everything is
DataFrame functions; the sentence and rule tables are joined, so any number of rules works.

Defined cases: null and empty texts have no licence; rows with the same doc_id and text are one finding; repeated notices count
in n_matches; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HINT = r"(?i)licen[sc]e|warrant|permission|redistribut|public domain"
# A line of comment marks alone is blank, and ; at the begin of a line is such a mark.
STOP = r"(?:(?<=[.!?:])|(?<=[^\n];))[\x20\t\r\n]+|\n[\x20\t\r]*(?:[/#*;%\-]+[\x20\t\r]*)?\n\s*"
LINE_STOP = r"(?<=[.!?;:])[\x20\t\r\n]+|\n"
OTHER = r"[^\p{L}\p{N}]+"

# Sentences of public licences and notices.
SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "apache-licensed": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-may-not": "you may not use this file except in compliance with the License.",
    "apache-obtain": "You may obtain a copy of the License at",
    "apache-short": "Licensed under the Apache License, Version 2.0.",
    "gpl-free": "This program is free software:",
    "gpl-3-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl-3-short": "This work is licensed under the GNU General Public License, version 3.",
    "mpl-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-nc-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-short": "Licensed under CC BY 4.0.",
    "unlicense-free": "This is free and unencumbered software released into the public domain.",
}
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is"]),
    ("MIT", ["mit-released"]),
    ("MIT", ["mit-licensed"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("ISC", ["isc-grant"]),
    ("Apache-2.0", ["apache-licensed", "apache-may-not", "apache-obtain"]),
    ("Apache-2.0", ["apache-short"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-3-terms", "gpl-hope"]),
    ("GPL-3.0", ["gpl-3-short"]),
    ("MPL-2.0", ["mpl-subject"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-short"]),
    ("CC-BY-4.0", ["cc-by-short"]),
    ("Unlicense", ["unlicense-free"]),
]


def check_rules(sentences: dict[str, str], rules: list[tuple[str, list[str]]]) -> None:
    """Refuse rules that the hint would miss or that name unknown sentences."""
    for name, ids in rules:
        if not ids or not set(ids) <= sentences.keys() or not any(re.search(HINT, sentences[i]) for i in ids):
            raise ValueError(f"Rule for {name} needs known sentences, one of them with a hint word: {ids}")


def normalised(sentence):
    return F.trim(F.regexp_replace(F.lower(sentence), OTHER, " "))


def known_tables(spark: SparkSession, sentences: dict[str, str], rules: list[tuple[str, list[str]]]) -> tuple[DataFrame, DataFrame]:
    """(sentence, id) normalised, one row for each part that the sentence cutter makes of a sentence; and
    (rule, licence, ids, n), with the ids of the parts and the number of sentences."""
    check_rules(sentences, rules)
    parts = {i: [(f"{i}#{k}" if k else i, x) for k, x in enumerate(re.split(STOP, text))] for i, text in sentences.items()}
    known = spark.createDataFrame([x for p in parts.values() for x in p], "id string, text string")
    given = [(k, name, [x for i in ids for x, _ in parts[i]], len(ids)) for k, (name, ids) in enumerate(rules)]
    given = spark.createDataFrame(given, "rule int, licence string, ids array<string>, n int")
    return known.select(normalised(F.col("text")).alias("sentence"), "id"), given


def sentence_ids(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, text_hash, way, ids): known sentences of each text in order, cut in either way."""
    cut = docs.where(F.col("text").rlike(HINT)).select("doc_id", "text", F.xxhash64("text").alias("text_hash")).distinct()
    ways = F.array(*[F.struct(F.lit(k).alias("way"), F.split("text", stop, -1).alias("parts")) for k, stop in enumerate((LINE_STOP, STOP))])
    each = cut.select("doc_id", "text_hash", F.explode(ways).alias("w")).select("doc_id", "text_hash", "w.way", F.posexplode("w.parts").alias("place", "part"))
    found = each.withColumn("sentence", normalised(F.col("part"))).join(known, "sentence").select("doc_id", "text_hash", "way", "place", "id")
    # A text's known sentences are bounded by the text, which was one row before.
    listed = found.groupBy("doc_id", "text_hash", "way").agg(F.array_sort(F.collect_list(F.struct("place", "id"))).alias("l"))
    return listed.select("doc_id", "text_hash", "way", F.transform("l", lambda x: x["id"]).alias("found"))


def scan_licenses(docs: DataFrame, sentences: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """One row per text and licence: doc_id, licence, n_matches (places that a rule of it matches), n_sentences (of the
    longest)."""
    known, given = known_tables(docs.sparkSession, SENTENCES if sentences is None else sentences, RULES if rules is None else rules)
    texts = sentence_ids(docs, known)
    heads = texts.select("doc_id", "text_hash", "way", "found", F.posexplode("found").alias("at", "first"))
    joined = heads.join(given.withColumn("first", F.get("ids", F.lit(0))), "first")
    hits = joined.where(F.slice("found", F.col("at") + 1, F.size("ids")) == F.col("ids"))
    place = ["doc_id", "text_hash", "way", "at"]
    longest = hits.groupBy(*place).agg(F.max_by(F.struct("licence", "n"), F.struct(F.size("ids"), -F.col("rule"))).alias("b"))
    per_way = longest.groupBy("doc_id", "text_hash", "way", "b.licence").agg(F.count(F.lit(1)).alias("m"), F.max("b.n").alias("n"))
    return per_way.groupBy("doc_id", "text_hash", "licence").agg(
        F.max("m").cast("long").alias("n_matches"), F.max("n").cast("long").alias("n_sentences")
    ).drop("text_hash")
