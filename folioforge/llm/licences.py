"""Licence scans by a trained paragraph classifier, in DataFrame operations only.

A paragraph ends at a blank line, or at a line end after a sentence's end; other line
ends are wraps and join. Features are word n-grams (one to three words) of the templates,
sparse: one counts only if it holds a word outside a list of common ones. Each family has
a logistic regression of its own, fitted in the dual: the Gram matrix of the examples
comes from a join, a fold over it takes the gradient steps, and the weights follow by a
second join. A paragraph's family is the best one.

Whether it counts as unknown is calibrated on notices and other sentences that the fit
doesn't see: a family's cut lies half way between the least score of its own and the
largest of the others, or at the latter if they overlap. A prediction above the cut is
confirmed by comparison with the family's templates: with one of them the paragraph
shares `SHARED` of the shorter one's word pairs and, if the template has words that no
other family's have, one of these; and it holds fewer words that only some one other family
has than words that only its own has, none, or as many and a score `MARGIN` over
the cut.

A paragraph is judged if it holds a template's word outside `PLAIN`, or a pair of plain words
that the examples hold, such as "under mit". Others are unknown by definition, with the score
of the largest bias, below all cuts; documents that have only such aren't taken apart.

Defined results: a null or empty text has no paragraphs, no licences and family
`unknown` with score 0; of families with equal scores the first by name counts, of
paragraphs the confirmed one, then the larger score, then the later name; a text of any
length is taken apart whole; rows that repeat an id, or have none, are rows of their own
(equal rows give equal results); extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.llm.common import discard, materialize

STEPS, RATE, RIDGE = 50, 0.4, 0.01
SHARED, MARGIN = 0.5, 0.1
PARAGRAPH = r"\n(?:[ \t\r]*\n)+|(?<=[.!?:;])[ \t\r]*\n"

# Public notices of licence families, to learn from.
TEMPLATES = {
    "MIT": [
        "MIT License",
        "This project is licensed under the MIT License - see the LICENSE file for details",
        "Distributed under the terms of the MIT license.",
        "Released under MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "This project is licensed under the Apache License 2.0 - see the LICENSE file for details",
        "Apache License Version 2.0, January 2004",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, without warranties or conditions of any kind",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "Licensed under the GNU General Public License version 2",
        "Distributed under the GNU General Public License v3.0 (GPL)",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Lesser General Public License version 2.1",
        "Distributed under the GNU Lesser GPL v3 (LGPL)",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "AGPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Affero General Public License version 3",
        "Distributed under the GNU Affero GPL v3 (AGPL)",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "BSD": [
        "This project is licensed under the BSD 3-Clause License",
        "Distributed under the new BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "This project is licensed under the ISC License",
        "Distributed under the terms of the ISC license.",
        "SPDX-License-Identifier: ISC",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
        "Licensed under the Mozilla Public License, Version 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "Licensed under the Eclipse Public License, Version 2.0",
        "Distributed under the Eclipse Public License v1.0 (EPL)",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "CC-BY": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Available under CC BY 4.0",
        "Text is licensed under the Creative Commons Attribution License",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC-BY-SA": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Available under CC BY-SA 4.0",
        "Text is licensed under the Creative Commons Attribution-ShareAlike License",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "CC-BY-NC": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Available under CC BY-NC 4.0",
        "Attribution-NonCommercial: you may not use the material for commercial purposes",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "CC-BY-ND": [
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "Available under CC BY-ND 4.0",
        "Attribution-NoDerivatives: if you remix or transform the material, you may not distribute the modified material",
        "SPDX-License-Identifier: CC-BY-ND-4.0",
    ],
    "public-domain": [
        "To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
        "This work has been dedicated to the public domain",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "proprietary": [
        "This software is proprietary and confidential.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "No part of this publication may be reproduced or transmitted in any form without the prior written permission of the publisher.",
        "All rights reserved. Proprietary and confidential; do not distribute without a commercial license agreement.",
    ],
}
# Paragraphs that use the same words but grant nothing, or name a licence of
# none of the families, to learn from.
OTHERS = [
    "He lost his driving license last year.",
    "The software was released in spring and the public liked it.",
    "Permission to enter was granted by the general.",
    "A copy of the letter is at the foundation.",
    "Version 2.0 of the program adds a new file browser.",
    "The Apache helicopter landed near the source of the river.",
    "Copyright law is taught in the second year.",
    "The commercial license of the pub was renewed.",
    "MIT researchers published a work on international law.",
    "Under the terms of the agreement the material must be returned.",
    "Free copies are distributed in the public library.",
    "This notice was included in the documentation of the house.",
    "The creative work was done in common.",
    "They obtained the binary form of the file.",
    "Conditions in the field were met with a disclaimer.",
    "Version 3 was published by the general public.",
    "You can use it under water.",
    "The GNU is an animal of the plains.",
    "Attribution of the painting is not certain; the identifier is missing.",
    "The eclipse was seen in the north without any warranty of clear skies.",
    "The lesser known author waived the fee for the publication.",
    "Fishing is strictly prohibited without a license.",
    "Licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 license",
    "Published under CC BY-NC-SA 3.0",
    "Licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 3.0 license",
    "Published under CC BY-NC-ND 3.0",
]
# Other notices and sentences, to calibrate the cuts on.
TUNING = {
    "MIT": ["The code is available under the MIT license.", "Released under an MIT licence; see LICENSE (MIT License).", "to any person obtaining a copy of this software, free of charge, to deal in the Software"],
    "Apache-2.0": ["The code is available under the Apache License, Version 2.0", "Released under the Apache 2.0 license."],
    "GPL": ["The code is available under the GNU General Public License, version 3", "Released under the terms of the GNU GPL, the General Public License"],
    "LGPL": ["The code is available under the GNU Lesser General Public License", "Released under the GNU LGPL, the Lesser General Public License"],
    "AGPL": ["The code is available under the GNU Affero General Public License", "Released under the GNU AGPL, the Affero General Public License"],
    "BSD": ["The code is available under the 3-clause BSD license", "Redistribution in source and binary forms, with or without modification, is permitted"],
    "ISC": ["The code is available under the ISC license", "Permission to use, copy, modify and distribute this software with or without fee is granted"],
    "MPL-2.0": ["The code is available under the Mozilla Public License 2.0", "This file is subject to the terms of the Mozilla Public License (MPL)"],
    "EPL-2.0": ["The code is available under the Eclipse Public License 2.0", "Released under the terms of the Eclipse Public License (EPL)"],
    "CC-BY": ["Text available under a Creative Commons Attribution 4.0 license", "Published under CC BY 4.0"],
    "CC-BY-SA": ["Text available under a Creative Commons Attribution-ShareAlike 3.0 license", "Published under CC BY-SA 3.0"],
    "CC-BY-NC": ["Text available under a Creative Commons Attribution-NonCommercial 3.0 license", "Published under CC BY-NC 3.0"],
    "CC-BY-ND": ["Text available under a Creative Commons Attribution-NoDerivatives 3.0 license", "Published under CC BY-ND 3.0"],
    "public-domain": ["The author has dedicated this work to the public domain under CC0 1.0", "This software is released into the public domain and unencumbered"],
    "proprietary": ["This document is proprietary and confidential", "Unauthorized copying or reproduction is strictly prohibited without prior written permission"],
    "unknown": [
        "Licensed under the Boost Software License, Version 1.0",
        "This project is licensed under the zlib License",
        "Released under the Artistic License 2.0",
        "Available under the European Union Public Licence 1.2",
        "Work under an Attribution-NonCommercial-ShareAlike 4.0 International licence",
        "Available under CC BY-NC-SA 4.0",
        "Available under CC BY-NC-ND 4.0",
        "Published under the GNU Free Documentation License",
        "The license of the new library is a matter of public debate.",
        "A commercial pilot may not use the material without a copy of the form.",
        "Software of this kind is distributed with the source in most years.",
        "The conditions of the agreement were published by the foundation.",
    ],
}
# Words too common to make a feature.
COMMON = ("a", "an", "all", "and", "any", "are", "as", "at", "be", "been", "by", "can", "for", "form", "from", "has", "have", "he", "his", "in", "into", "is", "it", "its", "last", "list", "may", "must", "near", "new", "not", "of", "on", "or", "other", "should", "that", "the", "their", "they", "this", "to", "use", "used", "v", "was", "were", "with", "year", "you", "your", "work", "file", "program", "source", "software", "copy", "general", "public")
# Words of the templates that are common elsewhere, in other languages or as
# numbers: they make features, but a lone one doesn't get a paragraph judged.
PLAIN = (*COMMON, "mit", "nd", "no", "do", "if", "one", "under", "without", "available", "0", "1", "2", "3", "4", "29")


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, "[^a-z0-9]+"), "")


def grams(w: Column, n: int) -> Column:
    """Runs of n words; each step zips with the words one place on, so nothing is looked
    up or sliced by element."""
    out = w
    for k in range(1, n):
        out = F.zip_with(out, F.slice(w, k + 1, 1 << 30), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)))
    return F.filter(out, lambda g: g.isNotNull())


def features(w: Column) -> Column:
    """Words outside PLAIN, and runs of two and three words that have one outside COMMON."""
    run = lambda g: ~F.forall(F.split(g, " "), lambda x: x.isin(*COMMON))
    alone = F.filter(w, lambda x: ~x.isin(*COMMON))
    return F.array_distinct(F.concat(alone, F.filter(F.concat(grams(w, 2), grams(w, 3)), run)))


def paired(w: Column, pairs: list[str]) -> Column:
    """Does one of the pairs stand in the words? Only words that may open one are joined to the next."""
    opens = sorted({p.split(" ")[0] for p in pairs})
    found = F.zip_with(w, F.slice(w, 2, 1 << 30), lambda a, b: F.when(a.isin(*opens) & b.isNotNull(), F.concat_ws(" ", a, b).isin(*pairs)))
    return F.exists(found, lambda x: F.coalesce(x, F.lit(False)))


def literal(spark: SparkSession, rows: list[tuple[str, str]], names: str) -> DataFrame:
    quoted = ", ".join("(" + ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {quoted} AS t({names})")


class Model:
    """Weights, cuts and templates, all of sizes fixed by the templates."""

    def __init__(self, spark: SparkSession, templates: dict[str, list[str]] | None = None, others: list[str] | None = None, tuning: dict[str, list[str]] | None = None):
        templates, others, tuning = templates or TEMPLATES, others or OTHERS, tuning or TUNING
        known = [(f, t) for f, texts in templates.items() for t in texts]
        rows = literal(spark, known + [("unknown", t) for t in others], "family, text")
        whole = rows.select("family", words(F.col("text")).alias("w"))
        # Besides each whole paragraph: without its last word.
        shapes = F.array(F.col("w"), F.expr("slice(w, 1, greatest(size(w) - 1, 1))"))
        fits = whole.select("family", F.explode(shapes).alias("w")).where("size(w) > 1")
        fits = fits.select("family", F.xxhash64("family", "w").alias("id"), features(F.col("w")).alias("grams")).where("size(grams) > 0").dropDuplicates(["id"])
        sparse = lambda df: df.select("id", F.explode("grams").alias("gram"), (1 / F.sqrt(F.size("grams").cast("double"))).alias("x"))
        fits = materialize(fits, "licence-examples")
        near = sparse(fits).alias("p").join(sparse(fits).alias("q"), F.col("p.gram") == F.col("q.gram")).groupBy(F.col("p.id").alias("i"), F.col("q.id").alias("j")).agg(F.sum(F.col("p.x") * F.col("q.x")).alias("dot"))
        ids = fits.select("id")
        full = ids.select(F.col("id").alias("i")).crossJoin(ids.select(F.col("id").alias("j"))).join(near, ["i", "j"], "left")  # examples only: a fixed number
        matrix = full.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", F.coalesce("dot", F.lit(0.0)).alias("dot")))), lambda s: s["dot"] + 0.3).alias("row"))
        matrix = matrix.join(fits.select(F.col("id").alias("i"), "family"), "i").agg(F.array_sort(F.collect_list(F.struct("i", "row", F.col("family").alias("is")))).alias("m"))
        families = literal(spark, [(f, "") for f in templates], "family, none").select("family")
        fold = f"""aggregate(sequence(1, {STEPS}), transform(m, r -> 0D), (a, t) ->
            zip_with(m, a, (r, v) -> v + {RATE} * (IF(r.is = family, 1D, 0D)
              - 1 / (1 + exp(-aggregate(zip_with(r.row, a, (x, y) -> x * y), 0D, (s, z) -> s + z))) - {RIDGE} * v)))"""
        dual = families.crossJoin(matrix).select("family", F.explode(F.expr(f"zip_with(m, {fold}, (r, v) -> struct(r.i AS id, v AS a))")).alias("s")).select("family", "s.*")
        dual = materialize(dual, "licence-dual")  # the fold is dear: it runs once
        self.weights = materialize(sparse(fits).join(dual, "id").groupBy("gram", "family").agg(F.sum(F.col("x") * F.col("a")).alias("weight")), "licence-weights")
        self.bias = materialize(dual.groupBy("family").agg((0.3 * F.sum("a")).alias("bias")), "licence-bias")
        discard(fits, dual)
        tuned = literal(spark, [(f, t) for f, texts in tuning.items() for t in texts], "truth, text")
        tuned = self.scored(tuned.select(F.xxhash64("text").alias("id"), "truth", features(words(F.col("text"))).alias("grams")), ["id", "truth"])
        own = F.coalesce(F.min(F.when(F.col("truth") == F.col("family"), F.col("p"))), F.lit(0.5))
        other = F.coalesce(F.max(F.when(F.col("truth") != F.col("family"), F.col("p"))), F.lit(0.0))
        self.cuts = materialize(tuned.groupBy("family").agg(F.greatest((own + other) / 2, other).alias("cut")), "licence-cuts")
        of = literal(spark, known, "family, text").select("family", words(F.col("text")).alias("w"))
        spread = of.select("family", F.explode("w").alias("word")).where(~F.col("word").isin(*COMMON)).distinct()
        spread = spread.groupBy("word").agg(F.collect_set("family").alias("of"))
        rare = spread.where("size(of) = 1").agg(F.collect_set("word").alias("rare"))
        marks = spread.where("size(of) = 1").agg(F.collect_list(F.struct(F.col("of")[0].alias("family"), "word")).alias("marks"))
        one = of.join(rare).join(marks)  # one row each
        each = one.select("family", F.array_distinct(grams(F.col("w"), 2)).alias("pairs"), F.array_intersect("w", "rare").alias("rare"), "marks")
        packed = each.groupBy("family").agg(F.collect_list(F.struct("pairs", "rare")).alias("templates"), F.first("marks").alias("marks"))
        packed = packed.withColumn("others", F.expr("array_distinct(transform(filter(marks, m -> m.family <> family), m -> m.family))"))
        named = lambda x: F.expr(f"transform(filter(marks, m -> m.family = {x}), m -> m.word)")
        self.templates = materialize(packed.select("family", "templates", named("family").alias("own"), F.expr("transform(others, o -> transform(filter(marks, m -> m.family = o), m -> m.word))").alias("foreign")), "licence-templates")
        self.base = self.bias.agg(F.max(1 / (1 + F.exp(-F.col("bias"))))).first()[0]
        split = lambda t: "".join(c if c.isascii() and c.isalnum() else " " for c in t.lower()).split()
        self.vocabulary = sorted({w for _, t in known for w in split(t)} - set(PLAIN))
        runs = {p for t in [*(t for _, t in known), *others] for p in itertools.pairwise(split(t))}
        self.pairs = sorted(" ".join(p) for p in runs if set(p) <= set(PLAIN) and not set(p) <= set(COMMON))

    def scored(self, paragraphs: DataFrame, keys: list[str]) -> DataFrame:
        """family and p of each paragraph (keys and grams) for each family it shares a gram with."""
        ones = paragraphs.select(*keys, F.explode("grams").alias("gram"))
        sums = ones.join(F.broadcast(self.weights), "gram").groupBy(*keys, "family").agg(F.sum("weight").alias("f"), F.count("*").alias("n"))
        known = F.sqrt(F.greatest(F.max("n").over(Window.partitionBy(*keys)), F.lit(4)).cast("double"))  # grams that the model knows; a lone one isn't a notice
        return sums.withColumn("x", 1 / known).join(F.broadcast(self.bias), "family").select(*keys, "family", (1 / (1 + F.exp(-(F.col("f") * F.col("x") + F.col("bias"))))).alias("p"))


def paragraphs(docs: DataFrame, model: Model) -> DataFrame:
    """k1, k2, par, family, p, licence (family or unknown) and confirmed of each paragraph
    that holds a feature word, or a learned pair of plain words."""
    either = lambda w: F.arrays_overlap(w, F.array(*map(F.lit, model.vocabulary))) | paired(w, model.pairs)
    parts = docs.select("k1", "k2", "text").where(F.exists(F.array(words(F.col("text"))), either))
    parts = parts.select("k1", "k2", F.posexplode(F.split("text", PARAGRAPH)).alias("par", "body")).select("k1", "k2", "par", words(F.col("body")).alias("w"))
    parts = materialize(parts.where(either(F.col("w"))).distinct(), "licence-paragraphs")
    best = model.scored(parts.select("k1", "k2", "par", features(F.col("w")).alias("grams")), ["k1", "k2", "par"])
    first = best.withColumn("n", F.row_number().over(Window.partitionBy("k1", "k2", "par").orderBy(F.desc("p"), "family"))).where("n = 1").select("k1", "k2", "par", "family", "p")
    judged = parts.join(first, ["k1", "k2", "par"]).join(F.broadcast(model.cuts), "family").where("p > cut").join(F.broadcast(model.templates), "family")
    own = F.array(F.array_distinct(grams(F.col("w"), 2)))  # bound once as a lambda's variable
    has = lambda x: F.size(F.array_intersect(F.col("w"), x))
    share = lambda o, t: F.size(F.array_intersect(o, t)) / F.greatest(F.lit(1.0), F.least(F.size(o), F.size(t)).cast("double"))
    alike = F.exists(own, lambda o: F.exists("templates", lambda t: (share(o, t["pairs"]) >= SHARED) & ((has(t["rare"]) > 0) | (F.size(t["rare"]) == 0))))
    foreign = F.coalesce(F.array_max(F.transform("foreign", has)), F.lit(0))
    judged = judged.where(alike & ((foreign == 0) | (foreign < has(F.col("own"))) | ((foreign == has(F.col("own"))) & (F.col("p") > F.col("cut") + MARGIN)))).select("k1", "k2", "par", F.lit(True).alias("confirmed"))
    out = first.join(judged, ["k1", "k2", "par"], "left").withColumn("confirmed", F.coalesce("confirmed", F.lit(False)))
    return out.select("k1", "k2", "par", "family", F.round("p", 6).alias("p"), "confirmed", F.when(F.col("confirmed"), F.col("family")).otherwise("unknown").alias("licence"))


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_paragraphs, n_licensed, licences (sorted, comma-joined), family and score
    of the best confirmed paragraph (unknown: of the best one) of each row."""
    spark = docs.sparkSession
    model = model or Model(spark)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63) + 1)).alias("k1"), F.xxhash64(text).alias("k2"))
    judged = paragraphs(rows, model)
    order = F.struct("confirmed", "p", "licence")
    marks = judged.groupBy("k1", "k2").agg(F.sum(F.col("confirmed").cast("long")).alias("n"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("found"), F.max(order).alias("best"))
    parts = F.when(F.length("text") > 0, F.size(F.split("text", PARAGRAPH))).otherwise(0)
    out = rows.select("doc_id", "k1", "k2", parts.cast("long").alias("n_paragraphs")).join(marks, ["k1", "k2"], "left")
    base = F.when(F.col("n_paragraphs") > 0, F.lit(round(model.base, 6))).otherwise(0.0)
    return out.select("doc_id", "n_paragraphs", F.coalesce("n", F.lit(0)).cast("long").alias("n_licensed"), F.coalesce("found", F.lit("")).alias("licences"), F.coalesce(F.col("best.licence"), F.lit("unknown")).alias("family"), F.coalesce(F.col("best.p"), base).alias("score"))
