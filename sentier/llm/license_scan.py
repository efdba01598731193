"""Licence scan: sparse TF-IDF cosine to templates, then inheritance by path.

Every line of every file is a possible header, and every whole file a possible
licence file. Both become sparse vectors: a term is present or not and weighs
its inverse document frequency over all files; terms outside the templates'
vocabulary weigh as terms that no file has. A line whose share of vocabulary
terms is below the squared threshold can't reach it (each vocabulary term
weighs at most as much as another one), so it is dropped before any join; the
rest meet the templates in a join on terms. The best template at or above the
threshold is the header's licence (ties: template id, then first line).

Files that are still without a licence are searched for *wordings*: the notices
inside longer lines or wrapped over several, usual headers, licences' titles,
openings and whole texts (``license_texts``). A wording of n words meets the
windows of n words (titles: the lines) of a file by the same cosine. A window at
the threshold holds one of the wording's anchors, its heaviest terms that weigh
more than the rest may lack, so only windows around anchors are formed, in files
that hold enough of the wording's terms; windows of long wordings start at every
sixteenth of their length. The match of most weight times cosine wins: a whole
licence goes before its first sentence. An SPDX tag is a header of its own and goes before all
wordings (the first tag of a file; known ids by their template, others and
expressions as written). A file that reaches ``FILE_COSINE`` to a whole text, or
opens as a licence does, is a licence file.

A file whose whole text reaches ``FILE_COSINE``, or that is named like a licence
file and has a licence of its own, states the licence of its directory. A file
without a header takes that of the nearest ancestor directory: distinct
directories are expanded to their ancestors and joined on the path, so the work
grows with directories and depth, not with pairs.

Defined results: a null text has no licence of its own; a null path lies in the
root directory; equal paths are files of their own; two licence files in one
directory: higher cosine, then smaller template id; extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentier.llm.license_texts import HEADERS, KEYS, OPENINGS, TEXTS, TITLES
from sentier.llm.shared import stored

COSINE = 0.8
FILE_COSINE = 0.6
LICENSE_NAME = r"(?i)^(licen[cs]e|copying|notice)(\.[a-z]+)?$"

SPDX = (r"(?i:SPDX-License-Identifier):[ \t]*(\(?[A-Za-z0-9][A-Za-z0-9.+-]*\)?"
        r"(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(?[A-Za-z0-9][A-Za-z0-9.+-]*\)?)*)")
OPENING_WORDS = 100

# Usual one-line licence notices.
NOTICES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This work is licensed under the Mozilla Public License, Version 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def templates(spark: SparkSession, notices: dict[str, str] | None = None) -> DataFrame:
    return spark.createDataFrame(sorted((notices or NOTICES).items()), "template string, text string")


def terms(text: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(F.lower(text), "[^a-z0-9]+")), "")


def wordings() -> list[tuple[str, str, str, str]]:
    """(template, kind, keys, text) of what is searched for in windows."""
    return ([(k, "words", KEYS[k], v) for k, v in sorted(NOTICES.items())]
            + [(k, kind, KEYS[k], v) for kind, listed in (("line", TITLES), ("words", HEADERS)) for k, v in listed]
            + [(k, kind, "", v) for kind, listed in (("opening", OPENINGS), ("text", TEXTS)) for k, v in listed])


def _words(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def _vocabulary(model: DataFrame) -> list[str]:
    """The templates' terms; as bounded as the list of templates."""
    return [r[0] for r in model.select(F.explode(terms(F.col("text")))).distinct().orderBy("col").collect()]


def _own_licenses(files: DataFrame, model: DataFrame, cosine: float, file_cosine: float) -> DataFrame:
    """(row, whole, template, cosine, line): each line's and file's best match."""
    vocabulary = _vocabulary(model)
    vocab = F.array(*[F.lit(t) for t in vocabulary])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    counted = files.select(F.explode_outer(F.array_intersect(terms(text), vocab)).alias("term"), F.lit(1).alias("one"))
    n = files.count()
    df = {r[0]: r[1] for r in counted.where("term IS NOT NULL").groupBy("term").count().collect()}
    weight = lambda d: F.log((F.lit(1.0) + n) / (F.lit(1.0) + d)) + 1.0
    idf = files.sparkSession.createDataFrame([(t, float(df.get(t, 0))) for t in vocabulary], "term string, df double")
    idf = idf.select("term", (weight(F.col("df")) * weight(F.col("df"))).alias("w2"))
    rare = weight(F.lit(0.0)) * weight(F.lit(0.0))

    def candidates(df: DataFrame, least: float) -> DataFrame:
        # p of m distinct terms in the vocabulary bound the squared cosine by p / m
        t = df.withColumn("t", terms(F.col("line_text"))).withColumn("hit", F.array_intersect("t", vocab))
        return (t.where((F.size("hit") > 0) & (F.size("hit") >= F.size("t") * least * least))
                .select("row", "whole", "line", "hit", (F.size("t") - F.size("hit")).alias("others")))

    lines = (files.select("row", F.posexplode(F.split(text, "\n")).alias("line", "line_text"))
             .withColumn("whole", F.lit(False)))
    wholes = files.select("row", F.lit(0).alias("line"), text.alias("line_text")).withColumn("whole", F.lit(True))
    found = candidates(lines, cosine).unionByName(candidates(wholes, file_cosine))
    hits = found.select("row", "whole", "line", "others", F.explode("hit").alias("term")).join(F.broadcast(idf), "term")
    norm = hits.groupBy("row", "whole", "line", "others").agg(
        F.sort_array(F.collect_set(F.struct("term", "w2"))).alias("v"))
    # one row per template term; the list of templates bounds it
    cells = model.select("template", F.explode(terms(F.col("text"))).alias("term")).join(F.broadcast(idf), "term")
    model_norm = cells.groupBy("template").agg(F.sum("w2").alias("m2"))
    size = F.aggregate("v", F.lit(0.0), lambda a, x: a + x["w2"]) + F.col("others") * rare
    dots = (norm.withColumn("n2", size).select("row", "whole", "line", "n2", F.explode("v.term").alias("term"))
            .join(F.broadcast(cells), "term").groupBy("row", "whole", "line", "n2", "template")
            .agg(F.sum("w2").alias("dot")).join(F.broadcast(model_norm), "template"))
    cos = F.round(F.col("dot") / F.sqrt(F.col("n2") * F.col("m2")), 6)
    scored = dots.withColumn("cosine", cos).where(F.col("cosine") >= F.when(F.col("whole"), file_cosine).otherwise(cosine))
    best = F.min(F.struct(-F.col("cosine"), F.col("template"), F.col("line")))
    return (scored.groupBy("row", "whole").agg(best.alias("b"))
            .select("row", "whole", F.col("b.template").alias("template"), (-F.col("b.col1")).alias("cosine"),
                    F.col("b.line").alias("line")))


def _spdx(files: DataFrame) -> DataFrame:
    """(row, whole, template, cosine, line) of files with an SPDX tag."""
    said = F.regexp_replace(F.element_at(F.regexp_extract_all("text", F.lit(SPDX), F.lit(1)), 1), r"\.+$", "")
    said = F.when(said.rlike(r"\s"), said).otherwise(F.regexp_replace(said, r"[()]", ""))
    plain = F.lower(F.regexp_replace(said, r"(?i)(-only|-or-later|\+)$", ""))
    known = F.create_map(*[F.lit(x) for k in KEYS for x in (k.lower(), k)])
    tagged = files.where(F.col("text").rlike(SPDX))
    return tagged.select("row", F.lit(False).alias("whole"), F.coalesce(known[plain], said).alias("template"),
                         F.lit(1.0).alias("cosine"), F.lit(0).alias("line"))


def _worded(files: DataFrame, own: DataFrame, cosine: float, file_cosine: float,
            listed: list[tuple[str, str, str, str]]) -> DataFrame:
    """(row, whole, template, cosine, line) of files that are not in ``own``, by
    SPDX tag or wording."""
    spark = files.sparkSession
    vocabulary = sorted({w for x in listed for w in _words(x[3])})
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    n = files.count()
    counted = files.select(F.explode(F.array_intersect(terms(text), F.array(*[F.lit(t) for t in vocabulary]))).alias("term"))
    df = {r[0]: r[1] for r in counted.groupBy("term").count().collect()}
    w2 = {t: (math.log((1.0 + n) / (1.0 + df.get(t, 0))) + 1.0) ** 2 for t in vocabulary}
    rare = (math.log(1.0 + n) + 1.0) ** 2
    specs, cells, wanted = [], [], set()
    for i, (template, kind, keys, said) in enumerate(listed):
        words = _words(said)
        own_terms = sorted(set(words), key=lambda t: (-w2[t], t))
        m2 = math.fsum(w2[t] for t in own_terms)
        least = min(cosine, file_cosine) if kind in ("opening", "text") else cosine
        anchors, held = [], 0.0
        while anchors != own_terms and held <= (1.0 - least * least) * m2 * (1 + 1e-9):
            held += w2[own_terms[len(anchors)]]
            anchors.append(own_terms[len(anchors)])
        wanted.update(anchors)
        specs.append((i, template, kind, keys.split(), len(words), max(1, len(words) // 16), m2, least, anchors))
        cells += [(i, t, w2[t]) for t in own_terms]
    specs = F.broadcast(spark.createDataFrame(specs, "id int, template string, kind string, keys array<string>, "
                                              "size int, step int, m2 double, least double, anchors array<string>"))
    cells = F.broadcast(spark.createDataFrame(cells, "id int, term string, w2 double"))
    idf = F.broadcast(spark.createDataFrame(sorted(w2.items()), "term string, w2 double"))

    open_files = files.withColumn("text", text).where(
        F.arrays_overlap(terms(F.col("text")), F.array(*[F.lit(t) for t in sorted(wanted)]))
        | F.col("text").rlike(SPDX))
    left = stored(open_files.dropDuplicates(["row"]).join(own.select("row").distinct(), "row", "left_anti"), "unlicensed")
    tags = _spdx(left)
    rest = left.join(tags.select("row"), "row", "left_anti")
    # a window reaches the cosine only in a file that holds enough of the wording's weight
    able = (rest.select("row", F.explode(terms(F.col("text"))).alias("term")).join(cells, "term")
            .groupBy("row", "id").agg(F.sum("w2").alias("held")).join(specs, "id")
            .where("held * 1.000000001 >= least * least * m2"))
    # tokens keep their order and repeats; lines are pieces of their own
    tokens = lambda c: F.array_remove(F.split(F.lower(c), "[^a-z0-9]+"), "")
    tried = able.drop("held").join(rest, "row").withColumn("w", tokens(F.col("text")))
    # starts (from 1) of the windows that hold an anchor, on the wording's grid
    at = F.expr("filter(transform(w, (x, i) -> if(array_contains(anchors, x), i, -1)), i -> i >= 0)")
    starts = F.expr("array_distinct(flatten(transform(anchored, i -> transform(sequence("
                    "cast(greatest(i - size + 1, 0) div step as int), cast(i div step as int)), k -> k * step + 1))))")
    pieces = F.expr("transform(starts, s -> named_struct('line', s, 'whole', false, 't', array_distinct(slice(w, s, size))))")
    lines = F.expr("transform(split(text, '\n'), (x, i) -> named_struct('line', cast(i as int), 'whole', false, "
                   "'t', array_remove(array_distinct(split(lower(x), '[^a-z0-9]+')), '')))")
    lines = F.filter(lines, lambda p: F.arrays_overlap(p["t"], F.col("anchors")))
    full = F.expr("array(named_struct('line', 0, 'whole', true, 't', array_distinct(w)))")
    got = ["row", "id", "template", "kind", "keys", "m2"]
    windows = (tried.where("kind <> 'line'").withColumn("anchored", at).withColumn("starts", starts)
               .select(*got, F.explode(pieces).alias("p")))
    titles = tried.where("kind = 'line'").select(*got, F.explode(lines).alias("p"))
    wholes = tried.where("kind = 'text'").select(*got, F.explode(full).alias("p"))
    found = (windows.unionByName(titles).unionByName(wholes).select(*got, "p.*")
             .where(F.size(F.array_except("keys", "t")) == 0))
    weighed = (found.select(*got, "line", "whole", F.explode("t").alias("term"))
               .join(idf.withColumnRenamed("w2", "all2"), "term", "left").join(cells, ["id", "term"], "left")
               .groupBy("row", "id", "template", "kind", "m2", "line", "whole")
               .agg(F.sum(F.coalesce("all2", F.lit(rare))).alias("n2"), F.sum(F.coalesce("w2", F.lit(0.0))).alias("dot")))
    scored = weighed.withColumn("cosine", F.round(F.col("dot") / F.sqrt(F.col("n2") * F.col("m2")), 6))
    scored = scored.where(F.col("cosine") >= F.when(F.col("whole"), file_cosine).otherwise(cosine))
    scored = scored.withColumn("whole", F.col("whole") | ((F.col("kind") == "opening") & (F.col("line") <= OPENING_WORDS)))
    best = F.min(F.struct(-F.round(F.col("dot") * F.col("cosine"), 6), -F.col("cosine"), F.col("template"), F.col("line")))
    return tags.unionByName(
        scored.groupBy("row", "whole").agg(best.alias("b"))
        .select("row", "whole", F.col("b.template").alias("template"), (-F.col("b.col2")).alias("cosine"),
                F.col("b.line").alias("line")))


def scan_licenses(files: DataFrame, model: DataFrame, cosine: float = COSINE, file_cosine: float = FILE_COSINE) -> DataFrame:
    """``files`` (file_id, path, text) to (file_id, path, license, how, cosine,
    from_dir): how is header, file, inherited or none."""
    path = F.coalesce(F.col("path"), F.lit("/"))
    # a file is known by its id, path and text; equal rows share their licence
    row = F.md5(F.concat_ws("|", F.coalesce(F.col("file_id").cast("string"), F.lit("~")), path,
                            F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    files = files.select(F.col("file_id"), F.col("path"), F.col("text"), row.alias("row"),
                         F.regexp_replace(path, "/[^/]*$", "").alias("dir"), F.element_at(F.split(path, "/"), -1).alias("name"))
    own = stored(_own_licenses(files.select("row", "text"), model, cosine, file_cosine), "notices")
    own = own.unionByName(_worded(files.select("row", "text"), own, cosine, file_cosine, wordings()))
    best = own.groupBy("row").agg(
        F.min_by(F.struct("template", "cosine", "whole"), F.struct(F.col("whole"), -F.col("cosine"))).alias("h"),
        F.max("whole").alias("is_file"))
    slim = files.select("file_id", "path", "row", "dir", "name").join(best, "row", "left")
    stated = (slim.where(F.col("is_file") | (F.col("h").isNotNull() & F.col("name").rlike(LICENSE_NAME)))
              .groupBy("dir").agg(F.min(F.struct(-F.col("h.cosine"), F.col("h.template"))).alias("s"))
              .select(F.col("dir").alias("up"), F.col("s.template").alias("template")))
    parts = F.split("dir", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    nearest = (slim.select("dir").distinct().withColumn("up", F.explode(ups)).join(stated, "up")
               .groupBy("dir").agg(F.max_by(F.struct("up", "template"), F.length("up")).alias("a")))
    out = slim.join(nearest, "dir", "left")
    how = (F.when(F.coalesce(F.col("is_file"), F.lit(False)), "file").when(F.col("h").isNotNull(), "header")
           .when(F.col("a").isNotNull(), "inherited").otherwise("none"))
    return out.select("file_id", "path", F.coalesce("h.template", "a.template").alias("license"), how.alias("how"),
                      F.col("h.cosine").alias("cosine"),
                      F.when(how == "inherited", F.concat(F.col("a.up"), F.lit("/"))).alias("from_dir"))
