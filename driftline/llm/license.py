"""Licence scans with DataFrame functions only.

Lines with a telling word are compared with one-sentence templates by sparse TF-IDF cosine, and
paragraphs, leading comments and whole texts with the licences' usual headers, SPDX tags and full
texts; each distinct one is scored once.  A file has the licence of its best match.  Licence files speak for their directory, and
a file without a licence of its own inherits that of the nearest ancestor directory, found by a join
of the file's ancestor paths with the licensed directories.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from functools import cache, reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import spool

#: Fixed texts: usual notices of common licences.
TEMPLATES = (
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License, CC BY 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, all copyright is waived: CC0 1.0 Universal public domain dedication."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
_GNU = "This {what} is free software{sep} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation{sep2} either version {v} of the License, or (at your option) any later version."
_WARRANTY = "This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details. You should have received a copy of the GNU {kind}General Public License along with this {what}. If not, see https://www.gnu.org/licenses/."
#: (licence, kind, version, what) of the GNU notices.
_GNU_KINDS = (("GPL-2.0", "", "2", "program"), ("GPL-3.0", "", "3", "program"), ("AGPL-3.0", "Affero ", "3", "program"), ("LGPL-2.1", "Lesser ", "2.1", "library"), ("LGPL-3.0", "Lesser ", "3", "library"))
#: Notices that take a paragraph or more at the head of a file.
HEADERS = (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", 'Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MIT", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file or at https://opensource.org/licenses/MIT."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    *((name, _GNU.format(what=what, kind=kind, v=v, sep=":", sep2=",") + more.format(what=what, kind=kind)) for name, kind, v, what in _GNU_KINDS for more in ("", " " + _WARRANTY)),
)
#: Tags besides the licences' own names.
TAGS = tuple((f"{n}", f"{n}-{k}") for n in ("AGPL-3.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0") for k in ("only", "or-later"))
#: Paragraphs, comments and texts without any of these are not compared with headers, tags and full texts, which all hold some.
TERMS = r"(?i)licen[cs]|copyright|spdx|permission|redistribution|public domain"
#: Lines of a leading comment, and blank ones.
COMMENT = r"^\s*(?:$|#|//|/\*|\*|--|;|%|<!--|\.\.|dnl\b|REM\b)"
TOKEN = r"[a-z0-9]+(?:\.[0-9]+)*"


def weights() -> list[tuple[int, str, str, float, float]]:
    """(template, licence, token, idf, unit weight): each template's normalised TF-IDF vector."""
    bags = [Counter(re.findall(TOKEN, text.lower())) for _, text in TEMPLATES]
    seen = Counter(t for bag in bags for t in bag)
    idf = {t: math.log((1 + len(bags)) / (1 + n)) + 1 for t, n in seen.items()}
    out = []
    for k, ((name, _), bag) in enumerate(zip(TEMPLATES, bags)):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in bag.items()))
        out += [(k, name, t, idf[t], n * idf[t] / norm) for t, n in sorted(bag.items())]
    return out


@cache
def _vectors() -> list[dict[str, float]]:
    """Per template its tokens' weights."""
    out: dict[int, dict[str, float]] = {}
    for k, _, token, _, w in weights():
        out.setdefault(k, {})[token] = w
    return list(out.values())


@cache
def line_gate() -> str:
    """A pattern of the templates' telling words: all but those that other lines are full of too."""
    held = {t for v in _vectors() for t in v} - COMMON
    return r"(?i)(?<![a-z0-9])(?:" + "|".join(re.escape(t) for t in sorted(held)) + r")(?![a-z0-9])"


@cache
def needed(threshold: float) -> list[tuple[list[str], int]]:
    """Per template its tokens and how many of them a line at ``threshold`` must hold: no cosine exceeds the norm of the shared ones."""
    out = []
    for vector in _vectors():
        mass, least = 0.0, 0
        for w in sorted(vector.values(), reverse=True):
            if mass >= (threshold - 1e-6) ** 2:
                break
            mass += w * w
            least += 1
        out.append((sorted(vector), least))
    return out


def may_match(line: Column, threshold: float) -> Column:
    """Whether a line may be at ``threshold`` or above.

    It has a telling word; of some template, as many words as :func:`needed`; and enough mass in words that templates
    have (each weighed as the rarest is) against those that none has, as no cosine exceeds the former's share.
    """
    every = sorted({t for names, _ in needed(threshold) for t in names})
    most, share = max(i for *_, i, _ in weights()), (threshold - 1e-6) ** 2

    def enough(tokens: Column) -> Column:
        known = F.array_intersect(tokens, F.array(*map(F.lit, every)))
        times = F.aggregate(known, F.lit(0), lambda acc, t: acc + F.pow(F.size(F.filter(tokens, lambda x: x == t)), F.lit(2)).cast("int"))
        strange = F.size(F.array_distinct(tokens)) - F.size(known)
        shared = [F.size(F.array_intersect(known, F.array(*map(F.lit, names)))) >= least for names, least in needed(threshold)]
        return (times * most**2 * (1 - share) >= strange * UNSEEN**2 * share) & reduce(lambda x, y: x | y, shared)

    tokens = F.regexp_extract_all(F.lower(line), F.lit(TOKEN), F.lit(0))
    return F.when(line.rlike(line_gate()), F.exists(F.array(tokens), enough)).otherwise(False)


#: A fixed list: the templates' words that other lines are full of.  A line of these alone names no licence and is not compared.
COMMON = frozenset("this is of the in under and a by any or with to it at are into all for without use 1.0 2.0 4.0 2 3 v free work person code source public program files form forms copy charge purpose general version terms subject fee possible extent law library international domain binary software documentation associated".split())
#: Of tokens that no template has.
UNSEEN = math.log(1 + len(TEMPLATES)) + 1


def _values(rows) -> str:
    quote = lambda x: f"'{x}'" if isinstance(x, str) else f"CAST({x!r} AS DOUBLE)" if isinstance(x, float) else str(x)
    return ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


def score_lines(lines: DataFrame, threshold: float) -> DataFrame:
    """(line, licence, score): the best template of each line of ``lines(line)`` at ``threshold`` or above."""
    spark = lines.sparkSession
    table = weights()
    vectors = spark.sql(f"SELECT * FROM VALUES {_values((k, n, t, w) for k, n, t, _, w in table)} AS t(template, licence, token, w)")
    idf = spark.sql(f"SELECT * FROM VALUES {_values(sorted({(t, i) for _, _, t, i, _ in table}))} AS t(token, idf)")
    # both tables are fixed: some two hundred rows
    counts = lines.select("line", F.explode(F.regexp_extract_all(F.lower("line"), F.lit(TOKEN), F.lit(0))).alias("token")).groupBy("line", "token").agg(F.count("*").alias("n"))
    part = counts.join(F.broadcast(idf), "token", "left").withColumn("x", F.col("n") * F.coalesce("idf", F.lit(UNSEEN)))
    norms = part.groupBy("line").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = part.join(F.broadcast(vectors), "token").groupBy("line", "template", "licence").agg(F.sum(F.col("x") * F.col("w")).alias("dot"))
    scored = dots.join(norms, "line").select("line", "licence", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).filter(F.col("score") >= threshold)
    best = scored.groupBy("line").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b"))
    return best.select("line", F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("score"))


@cache
def block_templates() -> tuple[tuple[str, str], ...]:
    """(licence, text) of what paragraphs, headers and whole files are compared with."""
    full = tuple((f.stem, f.read_text()) for f in sorted((Path(__file__).parent / "licences").glob("*.txt")))
    names = sorted({n for n, _ in TEMPLATES + HEADERS + full})
    tags = tuple((n, f"SPDX-License-Identifier: {tag}") for n, tag in (*((n, n) for n in names), *TAGS))
    return HEADERS + full + tags


@cache
def _block_weights() -> tuple[str, float]:
    """JSON of (token, idf, templates, unit weights), and the idf of tokens that no template has."""
    bags = [Counter(re.findall(TOKEN, text.lower())) for _, text in block_templates()]
    seen = Counter(t for bag in bags for t in bag)
    idf = {t: math.log((1 + len(bags)) / (1 + n)) + 1 for t, n in seen.items()}
    rows = {t: {"token": t, "idf": i, "k": [], "w": []} for t, i in idf.items()}
    for k, bag in enumerate(bags):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in bag.items()))
        for t, n in bag.items():
            rows[t]["k"].append(k)
            rows[t]["w"].append(round(n * idf[t] / norm, 12))
    return json.dumps([rows[t] for t in sorted(rows)]), math.log(1 + len(bags)) + 1


def blocks(text: Column) -> Column:
    """A text's paragraphs (cut at lines without letters or digits), its leading comment and the whole of it, as far as they hold a term."""
    lines = F.split(text, "\n")
    code = F.array_position(F.transform(lines, lambda x: ~x.rlike(COMMENT)), True).cast("int")
    head = F.when(code == 0, text).otherwise(F.array_join(F.slice(lines, F.lit(1), F.greatest(code - 1, F.lit(0))), "\n"))
    for opens, closes in (("/*", "*/"), ("<!--", "-->"), ('"""', '"""')):
        start = F.ltrim(text)
        head = F.when(start.startswith(opens), F.substring_index(F.substr(start, F.lit(len(opens) + 1)), closes, 1)).otherwise(head)
    every = F.concat(F.split(text, r"\n[^a-zA-Z0-9\n]*\n"), F.array(head, text))
    return F.filter(F.array_distinct(every), lambda x: x.rlike(TERMS))


def score_blocks(found: DataFrame, threshold: float) -> DataFrame:
    """(key, licence, score): the best template of each block of ``found(key, block)`` at ``threshold`` or above."""
    table, unseen = _block_weights()
    schema = "array<struct<token string, idf double, k array<int>, w array<double>>>"
    vectors = found.sparkSession.range(1).select(F.inline(F.from_json(F.lit(table), schema)))
    counts = found.select("key", F.explode(F.regexp_extract_all(F.lower("block"), F.lit(TOKEN), F.lit(0))).alias("token")).groupBy("key", "token").agg(F.count("*").alias("n"))
    # fixed: some two thousand tokens
    part = counts.join(F.broadcast(vectors), "token", "left").withColumn("x", F.col("n") * F.coalesce("idf", F.lit(unseen)))
    known = F.col("idf").isNotNull()
    square = F.col("x") * F.col("x")
    bags = part.groupBy("key").agg(F.sqrt(F.sum(square)).alias("norm"), F.sum(F.when(known, square).otherwise(0.0)).alias("most"), F.collect_list(F.when(known, F.struct("x", "k", "w"))).alias("bag"))
    # no cosine exceeds the share of the tokens that templates have
    near = bags.filter(F.sqrt("most") >= (threshold - 1e-6) * F.col("norm")).select("key", "norm", F.inline("bag"))
    dots = near.select("key", "norm", "x", F.inline(F.arrays_zip("k", "w"))).groupBy("key", "norm", "k").agg(F.sum(F.col("x") * F.col("w")).alias("dot"))
    names = F.array(*[F.lit(n) for n, _ in block_templates()])
    scored = dots.select("key", F.get(names, F.col("k")).alias("licence"), F.round(F.col("dot") / F.col("norm"), 6).alias("score")).filter(F.col("score") >= threshold)
    best = scored.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b"))
    return best.select("key", F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("score"))


def scan(files: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Licences of ``files(file_id, path, text, is_licence_file, ...)``.

    Returns file_id, path, licence, score, how (header, inherited or none) and from_directory (of an
    inherited licence).  Among a file's lines, paragraphs, leading comment and whole text the best score wins, then the licence's name; among a
    directory's licence files likewise.

    ``is_licence_file`` may be null: then a file speaks for its directory if it has a licence and at
    most five lines.  A null text is empty; a null path is in no directory and inherits nothing.  Rows that
    share file_id and path are told apart by their texts, equal rows have equal results; ties are settled as said, and
    very long lines and texts are read whole.  An empty table gives no rows.  Other columns are not read.

    Files are read once; what follows works on those parts that can match.
    """
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<string>")
    lines = F.when(text.rlike(line_gate()), F.array_distinct(F.filter(F.split(text, "\n"), lambda x: may_match(x, threshold)))).otherwise(none)
    parts = F.when(text.rlike(TERMS), blocks(text)).otherwise(none)
    files = files.select("file_id", "path", F.sha2(text, 256).alias("name"), F.coalesce("is_licence_file", F.size(F.split(text, "\n")) <= 5).alias("speaks"), lines.alias("lines"), parts.alias("parts"))
    files = spool(files, "files")
    lines = files.select("name", F.explode("lines").alias("line"))
    best = score_lines(lines.select("line").distinct(), threshold)
    parts = files.select("name", F.explode("parts").alias("block")).withColumn("key", F.sha2("block", 256))
    whole = score_blocks(parts.select("key", "block").distinct(), threshold)
    matches = lines.join(best, "line").drop("line").unionByName(parts.drop("block").join(whole, "key").drop("key"))
    own = matches.groupBy("name").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b")).select("name", F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("score"))
    steps = F.split("path", "/")
    directory = F.array_join(F.slice(steps, F.lit(1), F.greatest(F.size(steps) - 1, F.lit(0))), "/")
    known = files.drop("lines", "parts").join(own, "name", "left").withColumn("directory", directory)
    # per directory one row: (minus score, licence) of its best licence file
    parents = known.filter("licence is not null and speaks and path is not null").groupBy("directory").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("given"))
    # directories, not files, look their ancestors up: however many files one holds, it is one row
    inner = F.split("directory", "/")
    depth = F.when(F.col("directory") == "", 0).otherwise(F.size(inner))
    above = known.filter("licence is null and path is not null").select("directory").distinct().select("directory", F.explode(F.sequence(F.lit(0), depth)).alias("depth"))
    above = above.withColumn("ancestor", F.array_join(F.slice(inner, F.lit(1), F.col("depth")), "/"))
    nearest = above.join(parents.withColumnRenamed("directory", "ancestor"), "ancestor").groupBy("directory").agg(F.max_by(F.struct("ancestor", "given"), "depth").alias("n"))
    joined = known.join(nearest, "directory", "left").withColumn("n", F.when(F.col("licence").isNull(), F.col("n")))
    how = F.when(F.col("licence").isNotNull(), "header").when(F.col("n").isNotNull(), "inherited").otherwise("none")
    return joined.select("file_id", "path", F.coalesce("licence", "n.given.licence").alias("licence"), F.coalesce(F.col("score"), -F.col("n.given.s")).alias("score"), how.alias("how"), F.col("n.ancestor").alias("from_directory"))


def oracle(threshold: float = 0.6) -> str:
    """DuckDB SQL of the query op4 over ``documents``, written for whole tables by itself."""
    table = weights()
    token = TOKEN.replace("'", "''")
    return f"""
WITH f AS (
  SELECT doc_id, coalesce(source, 'unknown') AS a, coalesce(lang, 'unknown') AS b, coalesce(text, '') AS text FROM documents
), l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM f
), v(template, licence, token, w) AS (VALUES {_values((k, n, t, w) for k, n, t, _, w in table)}
), i(token, idf) AS (VALUES {_values(sorted({(t, i) for _, _, t, i, _ in table}))}
), c AS (
  SELECT line, token, count(*) AS n FROM (SELECT line, unnest(regexp_extract_all(lower(line), '{token}')) AS token FROM (SELECT DISTINCT line FROM l)) GROUP BY ALL
), x AS (SELECT line, token, n * coalesce(idf, {UNSEEN!r}::DOUBLE) AS x FROM c LEFT JOIN i USING (token)
), s AS (
  SELECT line, licence, round(sum(x * w) / any_value(norm), 6) AS score
  FROM x JOIN v USING (token) JOIN (SELECT line, sqrt(sum(x * x)) AS norm FROM x GROUP BY line) USING (line) GROUP BY line, template, licence
), o AS (
  SELECT doc_id, licence, score FROM l JOIN s USING (line) WHERE score >= {threshold}
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, licence) = 1
), g AS (
  SELECT a, b, licence, score FROM f JOIN o USING (doc_id) WHERE len(string_split(text, chr(10))) <= 5
  QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY score DESC, licence) = 1
)
SELECT doc_id, coalesce(o.licence, g.licence) AS licence, coalesce(o.score, g.score) AS score,
  CASE WHEN o.licence IS NOT NULL THEN 'header' WHEN g.licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS how,
  CASE WHEN o.licence IS NULL AND g.licence IS NOT NULL THEN f.a || '/' || f.b END AS from_directory
FROM f LEFT JOIN o USING (doc_id) LEFT JOIN g ON f.a = g.a AND f.b = g.b
"""
