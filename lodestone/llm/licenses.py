"""License scans: TF-IDF cosine of licence files and headers to templates, then inheritance by path.

DataFrame operations only. Headers are the lines and paragraphs of every text;
equal ones are scored once, whatever their number, and directories are resolved
once each, so neither a common licence nor a large directory makes a hot group.
Full texts of licences are in the folder templates, public texts as published.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lodestone.shared import Scratch

# The usual wordings of licence headers and short forms.
HEADERS: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Apache License Version 2.0, January 2004",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    ),
    "MIT": (
        "Released under the MIT License.",
        "The MIT License (MIT)",
        "MIT License",
        "This project is licensed under the MIT License, see the LICENSE file for details.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    ),
    "BSD-2-Clause": (
        "Redistributed under the BSD 2-Clause License.",
        "BSD 2-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    "BSD-3-Clause": (
        "Redistributed under the BSD 3-Clause License.",
        "BSD 3-Clause License",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "ISC": ("ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    ),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "Mozilla Public License Version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0.", "CC0 1.0 Universal"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Proprietary": ("All rights reserved.", "Copyright. All rights reserved.", "Copyright (c) All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited."),
}
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense)(\.[a-z]+)?$"
LINE = r"\r\n|\r|\n"
#: What stands between paragraphs: lines without a letter or digit.
PARAGRAPH = r"(?:\r\n|\r|\n)(?:[^\p{L}\p{N}\r\n]*(?:\r\n|\r|\n))+"
#: Words that most texts have: a header is never told by these as long as others are enough.
COMMON = ("the of and to in is that it for was on are as with this be by at or from have an not you which can has under any all if one will your may do so its a use no but their we they he she his her").split()
#: What a template is compared to; an SPDX line is read and not compared.
HEADER, FILE, SPDX = 0, 1, 2
SPDX_MARK = "SPDX-License-Identifier:"
SPDX_ID = r"[A-Za-z0-9][A-Za-z0-9.+-]*"
#: Ids joined by AND and OR, in any brackets, each WITH an exception or not.
SPDX_EXPRESSION = rf"{SPDX_MARK}[ \t]*(\(*[ \t]*{SPDX_ID}(?:[ \t]+WITH[ \t]+{SPDX_ID})?[ \t)]*(?:(?:AND|OR)[ \t(]+{SPDX_ID}(?:[ \t]+WITH[ \t]+{SPDX_ID})?[ \t)]*)*)"
SPDX_EXCEPTION = rf"[ \t]WITH[ \t]+{SPDX_ID}"
SPDX_LATER = r"(-only|-or-later|\+)$"
SPDX_WORDS = ("AND", "OR", "NONE", "NOASSERTION")
#: Counts as so many matched terms: what a file says of itself comes before likeness.
SPDX_TERMS = 1000.0
#: The license of wordings that stand beside others in any file: it counts where nothing else is found.
LAST = "Proprietary"


def _network_text(gpl: str) -> str:
    """The Affero licence's text from the general one's: its name, and its own thirteenth section."""
    section = """  13. Remote Network Interaction; Use with the GNU General Public License.

  Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge, through some standard or customary means of facilitating copying of software.  This Corresponding Source shall include the Corresponding Source for any work covered by version 3 of the GNU General Public License that is incorporated pursuant to the following paragraph.

  Notwithstanding any other provision of this License, you have permission to link or combine any covered work with a work licensed under version 3 of the GNU General Public License into a single combined work, and to convey the resulting work.  The terms of this License will continue to apply to the part which is the covered work, but the work with which it is combined will remain governed by version 3 of the GNU General Public License.

"""
    own = re.sub(r"GNU (General Public License|GENERAL PUBLIC LICENSE)", lambda m: "GNU " + ("Affero " if m[1][1] == "e" else "AFFERO ") + m[1], gpl)
    return re.sub(r" *13\. Use with the GNU Affero.*?(?=^ *14\. )", lambda _: section, own, flags=re.S | re.M)


def _attribution_text(share: str) -> str:
    """The attribution licence's text from the share-alike one's: without its name's second part and the paragraphs on sharing alike."""
    own = [x for x in re.split(r"\n\s*\n", share) if not re.search(r"BY-SA|ShareAlike\.$|Adapter's License (means|You apply must)|ShareAlike\.\s", x)]
    return re.sub(r"[- ]ShareAlike| and ShareAlike", "", "\n\n".join(own))


@lru_cache(maxsize=1)
def templates() -> list[tuple[int, str, str]]:
    """(what it is compared to, license, wording): headers and full texts."""
    out = [(HEADER, name, text) for name, texts in sorted(HEADERS.items()) for text in texts]
    folder = Path(__file__).parent / "templates"
    full = {path.stem: path.read_text(encoding="utf-8") for path in folder.glob("*.txt")}
    full |= {"AGPL-3.0": _network_text(full["GPL-3.0"]), "CC-BY-4.0": _attribution_text(full["CC-BY-SA-4.0"])}
    return out + [(FILE, name, text) for name, text in sorted(full.items())]


def _vectors(own: list[tuple[int, str, str]]) -> tuple[list[dict[str, float]], dict[str, float]]:
    """Unit vectors of the templates, and the IDF of their terms."""
    counts: list[dict[str, int]] = []
    for _, _, text in own:
        tf: dict[str, int] = {}
        for term in re.findall(TERM, text.lower()):
            tf[term] = tf.get(term, 0) + 1
        counts.append(tf)
    df: dict[str, int] = {}
    for tf in counts:
        for term in tf:
            df[term] = df.get(term, 0) + 1
    idf = {term: math.log((1 + len(own)) / (1 + n)) + 1 for term, n in df.items()}
    out = []
    for tf in counts:
        v = {term: (1 + math.log(n)) * idf[term] for term, n in tf.items()}
        length = math.sqrt(sum(x * x for x in v.values()))
        out.append({term: x / length for term, x in v.items()})
    return out, idf


def unknown_idf(n: int) -> float:
    return math.log((1 + n) / (1 + n / 10)) + 1


def telling_terms(own: list[tuple[int, str, str]], at_least: float) -> list[str]:
    """Terms of which every wording that is as like a header as at_least has one.

    Of each header terms go, common and short ones first, as long as what goes
    is together shorter than at_least: a wording with only these has a smaller
    cosine.
    """
    vectors, idf = _vectors(own)
    out = set()
    for (kind, _, _), v in zip(own, vectors, strict=True):
        gone = 0.0
        for term in sorted(v, key=lambda t: (t not in COMMON, len(t), idf[t], t)) if kind == HEADER else ():
            if gone + v[term] ** 2 < (at_least - 1e-5) ** 2:
                gone += v[term] ** 2
            else:
                out.add(term)
    return sorted(out)


def _could_match(wording: Column, own: list[tuple[int, str, str]], at_least: float) -> Column:
    """Whether a wording's cosine to a header can be at_least.

    Of the wording's vector, a is the length in terms that headers have and b
    that in terms that no template has; of a header's unit vector, s is the
    length in the terms that both have. The cosine is s * a / sqrt(a*a + b*b)
    at most.
    """
    vectors, idf = _vectors(own)
    shapes = [v for (kind, _, _), v in zip(own, vectors, strict=True) if kind == HEADER]
    table = F.array(*[F.struct(F.array(*[F.lit(t) for t in v]).alias("terms"), F.array(*[F.lit(x * x) for x in v.values()]).alias("squares")) for v in shapes])
    names = sorted({t for v in shapes for t in v})
    known, weights = F.array(*[F.lit(t) for t in names]), F.array(*[F.lit(idf[t]) for t in names])
    every = F.array(*[F.lit(t) for t in sorted(idf)])
    unknown = unknown_idf(len(own)) ** 2

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)

    def measured(terms: Column) -> Column:
        return F.struct(terms.alias("terms"), F.array_intersect(terms, known).alias("known"), (F.size(F.array_except(terms, every)) * unknown).alias("b"))

    def weighed(w: Column) -> Column:
        times = lambda t: 1 + F.log(F.size(F.filter(w["terms"], lambda x: x == t)))
        a = total(F.transform(w["known"], lambda t: F.pow(times(t) * F.element_at(weights, F.array_position(known, t).cast("int")), F.lit(2.0))))
        return F.struct(w["known"].alias("known"), a.alias("a"), w["b"].alias("b"))

    def near(w: Column, shape: Column) -> Column:
        shared = total(F.zip_with(shape["terms"], shape["squares"], lambda t, x: F.when(F.array_contains(w["known"], t), x).otherwise(0.0)))
        return shared * w["a"] >= (at_least**2 - 1e-5) * (w["a"] + w["b"])

    # What a wording has is found once and bound, not for every term of the table.
    steps = F.transform(F.transform(F.array(_terms(wording)), measured), weighed)
    return F.exists(steps, lambda w: (F.size(w["known"]) > 0) & F.exists(table, lambda shape: near(w, shape)))


def _any_of(terms: list[str]) -> str:
    """A pattern that finds any of the terms, tried by their first letters."""
    by: dict[str, list[str]] = {}
    for t in terms:
        by.setdefault(t[0], []).append(re.escape(t[1:]))
    return "(?<![a-z0-9])(?:" + "|".join(f"{a}(?:{'|'.join(rest)})" for a, rest in sorted(by.items())) + ")(?![a-z0-9])"


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), 1)


def _template_terms(spark: SparkSession, own: list[tuple[int, str, str]]) -> DataFrame:
    """(template, kind, license, term, weight, idf): the templates' vectors, a row for each term."""
    vectors, idf = _vectors(own)
    rows = [(i, kind, name, term, weight, idf[term]) for i, ((kind, name, _), v) in enumerate(zip(own, vectors, strict=True)) for term, weight in v.items()]
    names = (("template", T.IntegerType()), ("kind", T.IntegerType()), ("license", T.StringType()), ("term", T.StringType()), ("weight", T.DoubleType()), ("idf", T.DoubleType()))
    return spark.createDataFrame(rows, T.StructType([T.StructField(n, t) for n, t in names]))


def wording_id(c: str) -> Column:
    """128 bits of a wording, which stand for it in shuffles."""
    return F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.col(c), F.lit(1)).alias("b"))


def scored_texts(texts: DataFrame, *, at_least: float = 0.7) -> DataFrame:
    """(kind, wid, license, similarity, matched) of the distinct (kind, wording, wid) that are like a template of that kind: the likest, all licenses that tie; matched is the similarity times the wording's distinct terms.

    A term weighs (1 + ln of its count) * IDF; terms that no template has, such
    as names and years, weigh as those of a tenth of the templates. The vectors
    of the templates are broadcast: they are fixed and small. Null wordings have
    no terms.
    """
    own = templates()
    vectors = _template_terms(texts.sparkSession, own)
    lines = texts.groupBy("kind", "wid").agg(F.first("wording").alias("wording"))
    tf = lines.select("kind", "wid", F.explode(_terms(F.col("wording"))).alias("term")).groupBy("kind", "wid", "term").agg((1 + F.log(F.count("*"))).alias("tf"))
    idf = vectors.select("term", "idf").distinct()
    tf = tf.join(F.broadcast(idf), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(unknown_idf(len(own))))).drop("idf")
    norms = tf.groupBy("kind", "wid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.count("*").alias("terms"))
    dots = tf.join(F.broadcast(vectors.select("template", "kind", "license", "term", "weight")), ["kind", "term"]).groupBy("kind", "wid", "template", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    near = dots.join(norms, ["kind", "wid"]).withColumn("similarity", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("similarity") >= at_least)
    best = near.groupBy("kind", "wid").agg(F.max("similarity").alias("most"))
    tied = near.join(best, ["kind", "wid"]).where("similarity = most").groupBy("kind", "wid", "license").agg(F.max("similarity").alias("similarity"), F.max("terms").alias("terms"))
    return tied.select("kind", "wid", "license", "similarity", (F.col("similarity") * F.col("terms")).alias("matched"))


def spdx_licenses(text: Column) -> Column:
    """The distinct licenses that a text's SPDX lines name, without exceptions and `only` or `later`."""
    named = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(SPDX_EXPRESSION), 1), lambda e: F.regexp_extract_all(F.regexp_replace(e, SPDX_EXCEPTION, ""), F.lit(f"({SPDX_ID})"), 1)))
    return F.array_distinct(F.transform(F.filter(named, lambda x: ~x.isin(*SPDX_WORDS)), lambda x: F.regexp_replace(x, SPDX_LATER, "")))


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan_licenses(docs: DataFrame, path: Column, *, id_col: str = "doc_id", text_col: str = "text", at_least: float = 0.7) -> DataFrame:
    """One row per row of docs: doc_id, path, license, similarity, licenses, found.

    Of every row, each line and each paragraph (between blank lines) of the
    whole text is compared to the header templates; a row whose path names a
    licence file is compared to the full texts as a whole too. Only wordings are
    scored that share enough of a header's terms for its cosine to be reached:
    no other can be like enough, so nothing is lost.
    SPDX lines are read as expressions of ids. license is the likeliest: one of
    an SPDX line, then of a full text, then of headers; of several the one whose
    wordings have most matched terms in the row, then by name. licenses has all,
    sorted: of licenses that share a wording only the likeliest. A reservation
    of rights (`Proprietary`) counts where nothing else is found.
    found is 'own', or 'inherited' where the nearest directory at or above the
    row's that holds a licence file gave it, or null.

    Null or empty text has no licence of its own; a null path belongs to no
    directory. Ids are of any type and only handed on. Repeated rows are each
    given. Of several licence files in a directory the likeliest counts. Other
    columns are ignored. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "licenses")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), path.cast("string").alias("path"), text.alias("text"))
    key = F.struct(F.xxhash64("doc_id", "path", "text").alias("a"), F.xxhash64("text", F.lit(1), "path", F.lit(1), "doc_id").alias("b"))
    own = own.withColumn("key", key).withColumn("is_file", F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False)))
    telling = F.lower("wording").rlike(_any_of(telling_terms(templates(), at_least)))
    hopeful = own.where(F.lower("text").rlike(_any_of(telling_terms(templates(), at_least))))
    wordings = F.array_union(F.split("text", LINE), F.split("text", PARAGRAPH))
    headers = hopeful.select("key", "path", "is_file", F.lit(HEADER).alias("kind"), F.explode(F.array_distinct(F.transform(wordings, lambda w: F.trim(w)))).alias("wording")).where(telling)
    headers = headers.where(_could_match(F.col("wording"), templates(), at_least))
    files = own.where("is_file").select("key", "path", "is_file", F.lit(FILE).alias("kind"), F.col("text").alias("wording"))
    claims = scratch.write(headers.unionByName(files).withColumn("wid", wording_id("wording")), "claims")
    scored = scratch.write(scored_texts(claims, at_least=at_least), "scored")
    stated = own.where(F.col("text").contains(SPDX_MARK)).select("key", "path", "is_file", F.lit(SPDX).alias("kind"), F.explode(spdx_licenses(F.col("text"))).alias("license"))
    stated = stated.select("kind", wording_id("license").alias("wid"), "key", "path", "is_file", "license", F.lit(1.0).alias("similarity"), F.lit(SPDX_TERMS).alias("matched"))
    claims = claims.drop("wording").join(scored, ["kind", "wid"]).unionByName(stated)
    totals = claims.groupBy("key", "license").agg(F.round(F.sum("matched"), 3).alias("total"))
    claims = scratch.write(claims.join(totals, ["key", "license"]), "told")
    of_wording = claims.groupBy("key", "kind", "wid").agg(F.min(F.struct((-F.col("total")).alias("t"), F.col("license").alias("license"))).alias("m"))
    sets = of_wording.groupBy("key").agg(F.sort_array(F.collect_set("m.license")).alias("all"))
    sets = sets.select("key", F.when(F.size("all") > 1, F.array_remove("all", LAST)).otherwise(F.col("all")).alias("own_licenses"))
    order = F.struct((F.col("license") == LAST).alias("last"), (-F.col("kind")).alias("k"), (-F.col("total")).alias("t"), (-F.col("similarity")).alias("s"), F.col("license").alias("license"))
    best = claims.groupBy("key").agg(F.min(order).alias("best"), F.first("path").alias("file_path"), F.first("is_file").alias("is_file")).join(sets, "key")
    best = scratch.write(best.select("key", F.col("best.license").alias("own_license"), (-F.col("best.s")).alias("own_similarity"), "own_licenses", "file_path", "is_file"), "best")
    held = best.where("is_file").groupBy(folder_of(F.col("file_path")).alias("above")).agg(F.min(F.struct((-F.col("own_similarity")).alias("s"), F.col("own_license").alias("license"))).alias("b"))
    held = held.select("above", F.col("b.license").alias("up_license"), (-F.col("b.s")).alias("up_similarity"))
    folders = own.where("path is not null").select(folder_of(F.col("path")).alias("folder")).distinct()
    parts = F.split("folder", "/")
    above = folders.select("folder", F.explode(F.sequence(F.lit(0), F.when(F.col("folder") == "", 0).otherwise(F.size(parts)))).alias("depth"), parts.alias("parts"))
    above = above.select("folder", "depth", F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("above"))
    nearest = above.join(held, "above").groupBy("folder").agg(F.max_by(F.struct("up_license", "up_similarity"), "depth").alias("up"))
    nearest = scratch.write(nearest.select("folder", "up.*"), "nearest")
    scratch.drop("claims", "scored", "told")
    rows = own.select("doc_id", "path", "key", folder_of(F.col("path")).alias("folder")).join(best.select("key", "own_license", "own_similarity", "own_licenses"), "key", "left").join(nearest, "folder", "left")
    return rows.select(
        "doc_id",
        "path",
        F.coalesce("own_license", "up_license").alias("license"),
        F.coalesce("own_similarity", "up_similarity").alias("similarity"),
        F.coalesce(F.col("own_licenses"), F.when(F.col("up_license").isNotNull(), F.array("up_license")), F.array().cast("array<string>")).alias("licenses"),
        F.when(F.col("own_license").isNotNull(), "own").when(F.col("up_license").isNotNull(), "inherited").alias("found"),
    )
