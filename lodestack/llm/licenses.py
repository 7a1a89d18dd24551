"""Licence scan: TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest directory.

DataFrame functions only. Every line of a file can be a header, and so can every sentence of a line. A line that has none of a template's trigger terms cannot
reach the threshold (the other terms hold too little of the template's norm, by Cauchy-Schwarz), so only lines with a
trigger are taken apart into terms, and of these only lines that can reach the threshold are shuffled; nothing that could
match is left out.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import materialise, read_table

#: Fixed texts that announce a licence: one line of a header, or the sentence that licence files are known by.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-1.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("Proprietary", "All rights reserved."),
)
#: What tells licences of near wording apart: terms that a line must have, and terms that it must not have.
NEEDS = {"GPL-2.0": "2", "GPL-3.0": "3", "AGPL-3.0": "affero", "LGPL-2.1": "lesser 2", "LGPL-3.0": "lesser 3", "MPL-2.0": "mozilla", "CC-BY-NC-ND-4.0": "cc nc nd", "CC-BY-NC-SA-4.0": "cc nc sa", "CC-BY-NC-4.0": "cc nc", "CC-BY-ND-4.0": "cc nd", "CC-BY-SA-4.0": "cc sa", "CC-BY-4.0": "cc", "Proprietary": "rights reserved"}
LACKS = {"GPL-1.0-or-later": "lesser library affero", "GPL-2.0": "lesser library affero 3", "GPL-3.0": "lesser library affero 2", "CC-BY-NC-4.0": "nd sa", "CC-BY-ND-4.0": "nc", "CC-BY-SA-4.0": "nc", "CC-BY-4.0": "nc nd sa", "Proprietary": "not no some"}
#: Distinct terms that a line must share with a template: a single word, which may be one of another language, is no notice.
SHARED = 2
#: A tag that names its licence outright.
TAG = r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9][A-Za-z0-9.+-]*)"
#: Names without a version, and reserved rights, count only if nothing else matches.
RESERVED, GENERIC = "Proprietary", "GPL-1.0-or-later"
THRESHOLD = 0.6
#: A file whose licence lines make up this share of its bytes, or that has such a name, speaks for its directory.
FILE_SHARE = 0.5
FILE_NAMES = r"(?i)/(un)?licen[cs]e[^/]*$|/copying[^/]*$|/notice[^/]*$"
TERM = "[a-z0-9]+"
#: What ends a sentence within a line.
STOP = "[.;!?][ \t]+"
#: Words that are common in any text, the commonest first.
COMMON = tuple("the of and or are to in is it for as with by at this an be all any not can you may on a that from under which 0 1 2 3 4 v work file free code met deal".split())


def terms(text: str) -> Counter:
    return Counter(re.findall(TERM, re.sub("[A-Z]+", lambda m: m[0].lower(), text)))


class Weights:
    """TF-IDF of the templates: idf(t) = ln((1 + T) / (1 + df(t))) + 1 over the T templates; unknown terms have df 0, common words are in all."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD):
        self.names = [n for n, _ in templates]
        counts = [terms(t) for _, t in templates]
        df = Counter(t for c in counts for t in c)
        self.unknown = math.log(1 + len(templates)) + 1
        self.idf = {t: 1.0 if t in COMMON else math.log((1 + len(templates)) / (1 + n)) + 1 for t, n in df.items()}
        raw = [{t: n * self.idf[t] for t, n in c.items()} for c in counts]
        norms = [math.sqrt(sum(w * w for w in r.values())) for r in raw]
        self.unit = [{t: w / n for t, w in r.items()} for r, n in zip(raw, norms, strict=True)]
        self.triggers = sorted({t for u in self.unit for t in self._triggers(u, threshold)})

    @staticmethod
    def _triggers(unit: dict[str, float], threshold: float) -> list[str]:
        """All terms but common words, as many of these as weigh less than the threshold together."""
        left, free = 0.0, set()
        for t in COMMON:
            if t in unit and left + unit[t] ** 2 < threshold * threshold * 0.999:
                free.add(t)
                left += unit[t] ** 2
        return [t for t in unit if t not in free]


def _terms(text: str) -> Column:
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lowered, F.lit(f"({TERM})"), F.lit(1))


def _enough(weights: Weights, threshold: float) -> Column:
    """Whether the line can reach the threshold, by its terms taken one by one.

    With x the weight of each occurrence, the norm of the line is at least the root of the sum of x squared (they are
    equal if no term repeats), so the sum of x times the template's weight over that root bounds the cosine from above.
    One expression, evaluated where the line is: what goes on to the shuffle are lines that are nearly licences.
    """
    steps = {t: [x * x, *[x * u.get(t, 0.0) for u in weights.unit]] for t, x in weights.idf.items()}
    vectors = F.from_json(F.lit(json.dumps(steps)), "map<string, array<double>>")
    other = F.array(F.lit(weights.unknown**2), *[F.lit(0.0)] * len(weights.unit))
    zeros = F.array(*[F.lit(0.0)] * (1 + len(weights.unit)))
    return F.aggregate(_terms("line"), zeros, lambda held, t: F.zip_with(held, F.coalesce(F.try_element_at(vectors, t), other), lambda a, b: a + b), lambda held: F.array_max(F.slice(held, 2, len(weights.unit))) >= threshold * 0.999 * F.sqrt(held[0]))


def _told(name: str) -> Column:
    """Whether a line has the terms that the licence needs and none that speak against it, from columns h_term."""
    out = F.lit(True)
    for t in NEEDS.get(name, "").split():
        out = out & F.col(f"h_{t}")
    for t in LACKS.get(name, "").split():
        out = out & ~F.col(f"h_{t}")
    return out


def tagged_lines(files: DataFrame) -> DataFrame:
    """The same for lines with a tag, whose licence is what the tag says: score 1, template -1."""
    lines = files.where(F.contains("text", F.lit("SPDX-License-Identifier:"))).select("path", "tid", F.octet_length("text").alias("bytes"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    found = lines.withColumn("license", F.regexp_extract("line", TAG, 1)).where("license <> ''")
    return found.select("path", "tid", "bytes", "line_no", F.octet_length("line").alias("line_bytes"), F.lit(1.0).alias("score"), F.lit(-1).alias("template"), "license")


def scored_lines(files: DataFrame, weights: Weights, threshold: float = THRESHOLD) -> DataFrame:
    """(path, tid, bytes, line_no, line_bytes, score, template): lines, or sentences of them, that reach the threshold with their
    best template; line_bytes is the size of what does."""
    spark = files.sparkSession
    telling = sorted({t for text in (*NEEDS.values(), *LACKS.values()) for t in text.split()})
    has_trigger = rf"(?i)(?<![a-z0-9])({'|'.join(weights.triggers)})(?![a-z0-9])"
    whole = F.col("path").rlike(FILE_NAMES)
    # a licence file is one unit, whatever its lines, and each line and each two lines are others: a full text is far longer
    # than a template, and its title may have the version on the next line; a sentence is one, as other words dilute a line
    cut = F.split("text", "\n")
    twos = F.zip_with(F.slice(cut, 1, F.size(cut) - 1), F.slice(cut, 2, F.size(cut)), lambda a, b: F.concat(a, F.lit(" "), b))
    units = F.when(whole, F.concat(F.array("text"), cut, twos)).otherwise(cut)
    lines = files.where(F.col("text").rlike(has_trigger)).select("path", "tid", F.octet_length("text").alias("bytes"), F.posexplode(units).alias("line_no", "line")).where(F.col("line").rlike(has_trigger))
    sentences = F.filter(F.split("line", STOP), lambda x: (x != F.col("line")) & x.rlike(has_trigger))
    lines = lines.select("path", "tid", "bytes", "line_no", F.posexplode(F.concat(F.array("line"), sentences)).alias("part", "line")).where(_enough(weights, threshold))
    key = ["path", "tid", "bytes", "line_no", "part", "line_bytes"]
    tf = lines.select("path", "tid", "bytes", "line_no", "part", F.octet_length("line").alias("line_bytes"), F.explode(_terms("line")).alias("term")).groupBy(*key, "term").count()
    rows = [(t, weights.idf[t], *[u.get(t, 0.0) for u in weights.unit]) for t in sorted(weights.idf)]
    vocabulary = spark.createDataFrame(rows, "t string, idf double, " + ", ".join(f"w{k} double" for k in range(len(weights.unit))))
    weighed = tf.join(F.broadcast(vocabulary), F.col("term") == F.col("t"), "left").withColumn("x", F.col("count") * F.coalesce("idf", F.lit(weights.unknown)))
    sums = weighed.groupBy(*key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), *[F.sum(F.col("x") * F.coalesce(f"w{k}", F.lit(0.0))).alias(f"d{k}") for k in range(len(weights.unit))], *[F.count_if(F.col(f"w{k}") > 0).alias(f"c{k}") for k in range(len(weights.unit))], *[F.bool_or(F.col("term") == t).alias(f"h_{t}") for t in telling])
    best = F.greatest(*[F.struct(F.when(_told(name) & (F.col(f"c{k}") >= SHARED), F.round(F.col(f"d{k}") / F.col("norm"), 9)).otherwise(0.0).alias("score"), F.lit(-k).alias("k")) for k, name in enumerate(weights.names)])
    out = sums.select(*key, best.alias("b")).where(F.col("b.score") >= threshold)
    return out.select(*key[:4], "line_bytes", F.col("b.score").alias("score"), (-F.col("b.k")).alias("template"))


def _dir(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), F.lit(""))


def _ancestors(directory: Column) -> Column:
    """The directory itself and those above it, deepest first; the root is the empty string."""
    parts = F.split(directory, "/")
    above = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.concat_ws("/", F.slice(parts, 1, n)))
    return F.array_distinct(F.concat(above, F.array(F.lit(""))))


def scan(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``files`` (path, text): path, license, score, origin, license_path, tid.

    origin: ``header`` (the best line or sentence of the file itself; equal scores: a tag, the first template, then the first
    line), ``directory`` (the licence file in the nearest directory at or above the file's), or ``none``. A licence file has
    its own header, so it is of origin ``header``. As many notices reserve rights next to a licence, ``RESERVED`` is the
    licence of a file only if nothing else matches, and so is ``GENERIC``. Where a directory has several licence files, the best score counts, then
    the least path. Null paths have headers but no directory; null and empty texts have no header but inherit. tid tells
    rows with one path and different texts apart. An empty table gives an empty result.
    """
    weights = Weights(threshold=threshold)
    own = files.select("path", "text", F.xxhash64("text").alias("tid"))
    named = F.element_at(F.array(*map(F.lit, weights.names)), F.col("template") + 1)
    lines = materialise(scored_lines(own, weights, threshold).withColumn("license", named).unionByName(tagged_lines(own)), "license_lines")
    top = F.max(F.struct((~F.col("license").isin(RESERVED, GENERIC)).alias("named"), "score", -F.col("template"), -F.col("line_no"), "license")).alias("x")
    # a line and its sentences are counted once
    each = lines.groupBy("path", "tid", "bytes", "line_no").agg(top, F.max("line_bytes").alias("most"))
    headers = each.groupBy("path", "tid", "bytes").agg(F.max("x").alias("x"), F.sum("most").alias("covered"))
    headers = materialise(headers.select("path", "tid", "bytes", "covered", "x.license", "x.score"), "headers")
    speaks = F.col("path").rlike(FILE_NAMES) | (F.col("covered") >= FILE_SHARE * F.col("bytes"))
    best = F.min(F.struct(-F.col("score"), F.col("path"), F.col("license"))).alias("x")
    at = headers.where("path IS NOT NULL").where(speaks).select(_dir(F.col("path")).alias("at"), "path", "license", "score").groupBy("at").agg(best)
    at = at.select("at", F.col("x.license").alias("dir_license"), (-F.col("x.col1")).alias("dir_score"), F.col("x.path").alias("dir_path"))
    folders = own.where("path IS NOT NULL").select(_dir(F.col("path")).alias("folder")).distinct()
    up = folders.select("folder", F.posexplode(_ancestors(F.col("folder"))).alias("steps", "above"))
    nearest = up.join(at, F.col("above") == F.col("at")).groupBy("folder").agg(F.min(F.struct("steps", "dir_license", "dir_score", "dir_path")).alias("x"))
    nearest = materialise(nearest.select("folder", "x.dir_license", "x.dir_score", "x.dir_path"), "inherited")
    h = headers.select(F.col("path").alias("p"), F.col("tid").alias("t"), "license", "score")
    named_files = own.select("path", "tid", _dir(F.col("path")).alias("here")).join(h, F.col("path").eqNullSafe(F.col("p")) & (F.col("tid") == F.col("t")), "left")
    both = named_files.join(nearest, F.col("here") == F.col("folder"), "left")
    origin = F.when(F.col("license").isNotNull(), "header").when(F.col("dir_license").isNotNull(), "directory").otherwise("none")
    return both.select(
        "path", F.coalesce("license", "dir_license").alias("license"), F.when(F.col("license").isNotNull(), F.col("score")).otherwise(F.col("dir_score")).alias("score"), origin.alias("origin"), F.when(F.col("license").isNotNull(), F.col("path")).otherwise(F.col("dir_path")).alias("license_path"), "tid"
    )


def document_path() -> Column:
    """A tree for documents: the digits of doc_id but the last are directories under source, so short numbers lie above long ones."""
    digits = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return F.concat(F.coalesce("source", F.lit("null")), F.lit("/"), F.regexp_replace(F.expr("substring(coalesce(cast(doc_id AS string), 'null'), 1, length(coalesce(cast(doc_id AS string), 'null')) - 1)"), "(.)", "$1/"), digits, F.lit(".txt"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file of the tree of ``document_path``. Null and empty texts have no header but inherit; repeated
    rows stay; very long texts are scanned whole; ties go to the first template, then line; an empty table gives none."""
    docs = read_table(spark, sf_dir, "documents").select(document_path().alias("path"), "text")
    found = scan(docs).drop("tid")
    return found.withColumn("doc_id", F.regexp_extract("path", r"/(-?\d+)\.txt$", 1).try_cast("long"))


def _literals(rows: list[tuple]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(repr(float(v)) if isinstance(v, float) else str(v) if isinstance(v, int) else f"'{v}'" for v in r) + ")" for r in rows)


def _sql(weights: Weights, threshold: float = THRESHOLD) -> str:
    """The query in plain joins: every term of every line and sentence, without triggers or bounds.

    Files of ``document_path`` end in digits and .txt, so none has a licence file's name.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    needs, lacks = ([set(table.get(n, "").split()) for n in weights.names] for table in (NEEDS, LACKS))
    parts = [(k, t, float(u.get(t, 0.0)), int(t in needs[k]), int(t in lacks[k])) for k, u in enumerate(weights.unit) for t in sorted({*u, *needs[k], *lacks[k]})]
    digits = "coalesce(CAST(doc_id AS VARCHAR), 'null')"
    return f"""
WITH template(k, license, needs) AS ({_literals([(k, n, len(needs[k])) for k, n in enumerate(weights.names)])}),
part(k, term, w, need, lack) AS ({_literals(parts)}),
idf(term, idf) AS ({_literals(sorted(weights.idf.items()))}),
files AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, coalesce(text, '') AS text, coalesce(source, 'null') || '/'
    || regexp_replace(substring({digits}, 1, length({digits}) - 1), '(.)', '\\1/', 'g') || {digits} || '.txt' AS path
  FROM documents),
lines AS (
  SELECT rid, unnest(range(len(cut))) AS line_no, unnest(cut) AS line
  FROM (SELECT rid, string_split(text, chr(10)) AS cut FROM files)),
units AS (
  SELECT rid, line_no, 0 AS part, line FROM lines
  UNION ALL
  SELECT rid, line_no, unnest(range(1, len(cut) + 1)), unnest(cut)
  FROM (SELECT rid, line_no, regexp_split_to_array(line, '{STOP}') AS cut FROM lines) WHERE len(cut) > 1),
tf AS MATERIALIZED (
  SELECT rid, line_no, part, term, count(*) AS n
  FROM (SELECT rid, line_no, part, unnest(regexp_extract_all(translate(line, '{upper}', '{upper.lower()}'), '{TERM}')) AS term FROM units)
  GROUP BY ALL),
norms AS (
  SELECT rid, line_no, part, sqrt(sum(pow(n * coalesce(idf, {weights.unknown!r}), 2))) AS norm
  FROM tf LEFT JOIN idf USING (term) GROUP BY ALL),
dots AS (
  SELECT rid, line_no, part, k, sum(n * coalesce(idf, {weights.unknown!r}) * w) AS dot, sum(need) AS has, sum(lack) AS against, count_if(w > 0) AS shared
  FROM tf JOIN part p USING (term) LEFT JOIN idf USING (term) GROUP BY rid, line_no, tf.part, k),
scored AS (
  SELECT rid, line_no, part, k, license, round(dot / norm, 9) AS score
  FROM dots JOIN norms USING (rid, line_no, part) JOIN template USING (k)
  WHERE has = needs AND against = 0 AND shared >= {SHARED} AND round(dot / norm, 9) >= {threshold}),
best AS (
  SELECT rid, line_no, part, k, license, score FROM scored
  QUALIFY row_number() OVER (PARTITION BY rid, line_no, part ORDER BY score DESC, k) = 1),
found AS MATERIALIZED (
  SELECT rid, line_no, strlen(line) AS bytes, k, license, score FROM best JOIN units USING (rid, line_no, part)
  UNION ALL
  SELECT rid, line_no, strlen(line), -1, regexp_extract(line, '{TAG}', 1), 1.0 FROM lines WHERE regexp_extract(line, '{TAG}', 1) <> ''),
covered AS (
  SELECT rid, sum(most) AS covered FROM (SELECT rid, line_no, max(bytes) AS most FROM found GROUP BY ALL) GROUP BY rid),
headers AS MATERIALIZED (
  SELECT rid, path, license, score, covered >= {FILE_SHARE} * strlen(text) AS speaks
  FROM found JOIN covered USING (rid) JOIN files USING (rid)
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY license IN ('{RESERVED}', '{GENERIC}'), score DESC, k, line_no, license DESC) = 1),
folders AS (
  SELECT regexp_replace(path, '/[^/]*$', '') AS folder, license, score, path FROM headers WHERE speaks
  QUALIFY row_number() OVER (PARTITION BY regexp_replace(path, '/[^/]*$', '') ORDER BY score DESC, path, license) = 1),
above AS (
  SELECT rid, unnest([array_to_string(up[1:n], '/') FOR n IN range(1, len(up))]) AS folder
  FROM (SELECT rid, string_split(path, '/') AS up FROM files)),
nearest AS (
  SELECT rid, license, score, path FROM above JOIN folders USING (folder)
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length(folder) DESC) = 1)
SELECT f.path, coalesce(h.license, n.license) AS license, coalesce(h.score, n.score) AS score,
  CASE WHEN h.rid IS NOT NULL THEN 'header' WHEN n.rid IS NOT NULL THEN 'directory' ELSE 'none' END AS origin,
  CASE WHEN h.rid IS NOT NULL THEN f.path ELSE n.path END AS license_path,
  TRY_CAST(nullif(regexp_extract(f.path, '/(-?[0-9]+)[.]txt$', 1), '') AS BIGINT) AS doc_id
FROM files f LEFT JOIN headers h USING (rid) LEFT JOIN nearest n USING (rid)
"""


OP3_SQL = _sql(Weights())
