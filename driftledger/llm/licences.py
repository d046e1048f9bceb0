"""Licence scans: a trained classifier of paragraphs, confirmed by comparison with templates. DataFrame operations only.

A paragraph is a run of lines without a blank one; its lines are read as one sequence of words, without the marks of comments.
Features are the word pairs and triples that the licence templates hold and ordinary paragraphs hardly do. A multinomial
logistic regression over licence families and an unknown class learns from templates with words left out and from a bounded
sample of the corpus' own paragraphs; a temperature, fitted on rows kept back, calibrates its probabilities. Enough of a
template must be found in one stretch of a paragraph, and its family is reported where it is more likely than not in that
stretch, so that a paragraph may have several families.

Texts are exploded to word pairs and joined with the broadcast pairs of the templates, a table no larger than these, so that
only n-grams of licences are stored, placed against the templates and aggregated.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

#: Sentences by which licences are granted or named, and the paragraphs of the short licences and of the usual notices.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "This project is licensed under the terms of the MIT license"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("bsd", "Licensed under the BSD 3-Clause License"),
    ("bsd", "Released under the BSD License"),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Licensed under the ISC License"),
    ("isc", "SPDX-License-Identifier: ISC"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "Released under the GNU General Public License, version 2"),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("gpl", "SPDX-License-Identifier: GPL-2.0-only"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "Licensed under the GNU Lesser General Public License, version 2.1"),
    ("lgpl", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("agpl", "Licensed under the GNU Affero General Public License, version 3"),
    ("agpl", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "Licensed under the Mozilla Public License, version 2.0"),
    ("mpl-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("epl", "made available under the terms of the Eclipse Public License"),
    ("epl", "SPDX-License-Identifier: EPL-2.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc0", "Released under CC0 1.0 Universal Public Domain Dedication"),
    ("cc0", "SPDX-License-Identifier: CC0-1.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("proprietary", "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited"),
    ("apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "See the License for the specific language governing permissions and limitations under the License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."),
    ("lgpl", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("lgpl", "You should have received a copy of the GNU Lesser General Public License along with this library"),
    ("agpl", "See the GNU Affero General Public License for more details."),
    ("agpl", "You should have received a copy of the GNU Affero General Public License along with this program."),
    ("mpl-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("zlib", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required."),
    ("zlib", "SPDX-License-Identifier: Zlib"),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("bsl-1.0", "SPDX-License-Identifier: BSL-1.0"),
)

#: licences' identifiers on the public SPDX list, and their names, by family.
NAMES: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = (
    ("mit", ("MIT",), ("MIT License", "Expat License")),
    ("apache-2.0", ("Apache-2.0",), ("Apache License 2.0", "Apache License Version 2.0", "Apache 2.0 License", "Apache Software License 2.0")),
    ("bsd", ("BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "0BSD"), ("BSD 2-Clause License", "BSD 3-Clause License", "New BSD License", "Simplified BSD License", "Modified BSD License")),
    ("gpl", ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"), ("GNU General Public License", "GNU GPL v2", "GNU GPL v3", "GNU GPL version 2", "GNU GPL version 3")),
    ("lgpl", ("LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"), ("GNU Lesser General Public License", "GNU Library General Public License", "GNU LGPL v2.1", "GNU LGPL v3")),
    ("agpl", ("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"), ("GNU Affero General Public License", "GNU AGPL v3", "GNU AGPL version 3")),
    ("mpl-2.0", ("MPL-1.1", "MPL-2.0"), ("Mozilla Public License", "Mozilla Public License 2.0")),
    ("epl", ("EPL-1.0", "EPL-2.0"), ("Eclipse Public License", "Eclipse Public License 2.0", "Eclipse Public License v 1.0")),
    ("cddl", ("CDDL-1.0", "CDDL-1.1"), ("Common Development and Distribution License",)),
    ("eupl", ("EUPL-1.1", "EUPL-1.2"), ("European Union Public Licence", "European Union Public License")),
    ("artistic", ("Artistic-1.0", "Artistic-2.0"), ("Artistic License", "Artistic License 2.0")),
    ("wtfpl", ("WTFPL",), ("Do What The Fuck You Want To Public License",)),
    ("isc", ("ISC",), ("ISC License",)),
    ("zlib", ("Zlib",), ("zlib License", "zlib libpng License")),
    ("unlicense", ("Unlicense",), ("The Unlicense",)),
    ("cc0", ("CC0-1.0",), ("CC0 1.0 Universal", "Creative Commons Zero")),
    ("cc-by", ("CC-BY-3.0", "CC-BY-4.0"), ("Creative Commons Attribution 4.0 International", "Creative Commons Attribution 3.0 Unported", "CC-BY 4.0", "CC BY 3.0")),
    ("cc-by-sa", ("CC-BY-SA-3.0", "CC-BY-SA-4.0"), ("Creative Commons Attribution-ShareAlike 4.0 International", "Creative Commons Attribution-ShareAlike 3.0 Unported", "CC-BY-SA 4.0", "CC BY-SA 3.0")),
    ("cc-by-nc", ("CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0"), ("Creative Commons Attribution-NonCommercial 4.0 International", "CC-BY-NC 4.0")),
    ("cc-by-nd", ("CC-BY-ND-4.0",), ("Creative Commons Attribution-NoDerivatives 4.0 International", "CC BY-ND 4.0")),
    ("bsl-1.0", ("BSL-1.0",), ("Boost Software License",)),
    ("busl", ("BUSL-1.1",), ("Business Source License",)),
    ("ofl", ("OFL-1.1",), ("SIL Open Font License", "Open Font License 1.1")),
    ("postgresql", ("PostgreSQL",), ("PostgreSQL License", "PostgreSQL Licence")),
    ("python", ("PSF-2.0", "Python-2.0"), ("Python Software Foundation License", "PSF License Agreement")),
    ("openssl", ("OpenSSL",), ("OpenSSL License",)),
    ("ms-pl", ("MS-PL",), ("Microsoft Public License",)),
    ("ms-rl", ("MS-RL",), ("Microsoft Reciprocal License",)),
    ("ncsa", ("NCSA",), ("University of Illinois NCSA Open Source License", "NCSA License")),
    ("afl", ("AFL-3.0",), ("Academic Free License",)),
    ("osl", ("OSL-3.0",), ("Open Software License",)),
    ("upl", ("UPL-1.0",), ("Universal Permissive License",)),
    ("gfdl", ("GFDL-1.3-only", "GFDL-1.3-or-later"), ("GNU Free Documentation License",)),
    ("odbl", ("ODbL-1.0",), ("Open Database License", "Open Data Commons Open Database License")),
    ("sspl", ("SSPL-1.0",), ("Server Side Public License",)),
    ("elastic", ("Elastic-2.0",), ("Elastic License 2.0",)),
    ("ruby", ("Ruby",), ("Ruby License",)),
    ("vim", ("Vim",), ("Vim License",)),
)


def notices() -> tuple[tuple[str, str], ...]:
    """(family, text): how a licence is usually named, by its name and by its identifier, alone or after another in an expression."""
    by_name = ("{}", "under the {}", "under the terms of the {}", "subject to the {}")
    by_id = ("SPDX-License-Identifier: {}", "License: {}", "licensed under {}", "license = {}")
    in_turn = ("SPDX-License-Identifier: {} OR {}", "SPDX-License-Identifier: {} AND {}")
    out = [(family, form.format(name)) for family, _, own in NAMES for name in own for form in by_name]
    out += [(family, form.format(key)) for family, keys, _ in NAMES for key in keys for form in by_id]
    # the second of an expression stands after an operator, whatever is first
    out += [(family, form.format("", key).split(": ")[1].strip()) for family, keys, _ in NAMES for key in keys for form in in_turn if "-" in key or key.isupper()]
    return tuple(dict.fromkeys(out))


#: Sentences with words of licences that grant none.
OTHERS: tuple[str, ...] = (
    "She lost her driving licence and asked the office for a new one.",
    "The general public was not admitted to the library.",
    "Version 2.0 of the program is free of charge for any person.",
    "The work is under way and will be released in version 3.",
    "He was licensed as a pilot under the old rules.",
    "The public licence fee pays for the terms of the broadcast.",
    "Copies of the file are kept in the source and in binary form.",
    "The attribution of the painting to a common artist is disputed.",
)

UNKNOWN = "unknown"
#: Stretches of the corpus' paragraphs that the unknown class is learned from, in expectation.
SAMPLE_PARAGRAPHS = 4_000
#: Examples made of each template of SHORT words or more, with words left out, and of each shorter one, as it is.
VARIANTS, SHORT_VARIANTS, SHORT = 60, 6, 7
#: Words of a stretch that the unknown class is learned from; words in a row that tell a template from other texts.
STRETCH, RUN = 64, 6


def words(text: Column) -> Column:
    """The text's lower-case words of letters and digits, with the dots, hyphens and plus signs inside them."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[.+-][\p{L}\p{N}]+)*"), F.lit(0))


def grams(w: Column) -> Column:
    """The pairs and triples of neighbouring words, with their repeats."""
    pairs = F.zip_with(w, F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b)))
    triples = F.zip_with(pairs, F.slice(w, F.lit(3), F.greatest(F.size(w) - 2, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b)))
    return F.filter(F.concat(pairs, triples), lambda g: g.isNotNull())


def paragraphs(text: Column) -> Column:
    """The text's runs of lines without a blank one."""
    return F.filter(F.split(text, r"(?:\r\n|\n|\r(?!\n))[ \t\f]*(?:\r\n|\n|\r)"), lambda p: p.rlike(r"\S"))


@dataclass(frozen=True)
class LicenceModel:
    """weights: gram, w (one for each class); templates: gram, template (its number), family, n (its words), size (its
    different grams), offset (a row for each place of a gram). Both as small as TEMPLATES."""

    classes: tuple[str, ...]
    bias: tuple[float, ...]
    temperature: float
    weights: DataFrame
    templates: DataFrame


def _templates(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([*TEMPLATES, *notices()], "family string, text string")
    return rows.withColumn("words", words(F.col("text"))).withColumn("grams", F.array_distinct(grams(F.col("words"))))


def _placed_templates(spark: SparkSession, vocabulary: list[str]) -> DataFrame:
    """LicenceModel.templates, of the grams in vocabulary."""
    known, rows = set(vocabulary), []
    for number, (family, text) in enumerate((*TEMPLATES, *notices())):
        w = _template_words(text)
        own = [(" ".join(w[k : k + n]), k) for n in (2, 3) for k in range(len(w) - n + 1)]
        own = [(g, k) for g, k in own if g in known]
        rows += [(g, number, family, len(w), len({g for g, _ in own}), k) for g, k in own]
    return spark.createDataFrame(rows, "gram string, template int, family string, n int, size int, offset int")


def _template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+(?:[.+-][^\W_]+)*", text.lower())


def _runs() -> list[str]:
    """The runs of RUN words of the templates, and shorter templates as a whole."""
    each = [_template_words(t) for _, t in TEMPLATES]
    return sorted({" ".join(w[k : k + RUN]) for w in each for k in range(max(1, len(w) - RUN + 1))})


def _examples(spark: SparkSession, docs: DataFrame, text_col: str, sample: int) -> DataFrame:
    """(label, grams, kept_back): templates with words left out and others around them, and stretches of paragraphs of no
    licence."""
    short = F.size("words") < SHORT
    made = _templates(spark).select("family", "words", "text").withColumn("variant", F.explode(F.sequence(F.lit(0), F.when(short, SHORT_VARIANTS - 1).otherwise(VARIANTS - 1))))
    draw = lambda *of: F.pmod(F.xxhash64("text", "variant", *of), F.lit(100))
    lost = F.filter(F.col("words"), lambda w, i: (F.col("variant") == 0) | short | (F.pmod(F.xxhash64("text", "variant", w, i), F.lit(100)) >= F.pmod(F.col("variant"), F.lit(4)) * 6))
    made = made.withColumn("w", lost).withColumn("w", F.when((draw(F.lit("cut")) < 30) & ~short, F.slice("w", F.lit(1), F.greatest(F.lit(3), F.size("w") * 2 / 3).cast("int"))).otherwise(F.col("w")))
    made = made.select(F.col("family").alias("label"), F.array_distinct(grams(F.col("w"))).alias("grams"), (draw(F.lit("part")) < 25).alias("kept_back"))
    texts = docs.select(F.col(text_col).alias("text")).where("text is not null")
    n = texts.agg(F.sum(F.ceil(F.length("text") / 400))).first()[0] or 1  # stretches, about
    share = F.lit(sample / n)
    line = texts.select(F.posexplode(paragraphs(F.col("text"))).alias("k", "p"))
    line = line.where(F.pmod(F.xxhash64("p", "k"), F.lit(1 << 30)) < share * (1 << 30)).select("p")
    line = line.unionByName(spark.createDataFrame([(o,) for o in OTHERS for _ in range(4)], "p string"))
    line = line.select(words(F.col("p")).alias("w")).where(F.size("w") > 0)
    # a sampled paragraph that holds a run of a template is no example of the unknown class
    runs = _runs()
    lengths = sorted({len(r.split()) for r in runs})
    runs_of = lambda n: F.transform("w", lambda _, i: F.array_join(F.slice("w", i + 1, F.lit(n)), " "))
    own = F.concat(*map(runs_of, lengths))
    line = line.join(F.broadcast(spark.createDataFrame([(runs,)], "runs array<string>")), F.arrays_overlap(own, "runs"), "left_anti")
    line = line.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 1, F.lit(STRETCH)), lambda k: F.slice("w", k + 1, F.lit(STRETCH)))).alias("w"))
    line = line.select(F.array_distinct(grams(F.col("w"))).alias("grams"), (F.pmod(F.xxhash64("w"), F.lit(4)) == 0).alias("kept_back"))
    return made.unionByName(line.select(F.lit(UNKNOWN).alias("label"), "grams", "kept_back"))


def train(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE_PARAGRAPHS) -> LicenceModel:
    """The classifier, its unknown class learned from about sample stretches of docs, of paragraphs picked by a hash.

    Without any text the unknown class has the fixed sentences only.
    """
    spark = docs.sparkSession
    rows = stored(_examples(spark, docs, text_col, sample), "licence-examples")
    classes = [*sorted({f for f, _ in (*TEMPLATES, *notices())}), UNKNOWN]
    n = rows.where(F.col("label") == UNKNOWN).count()
    common = rows.where(F.col("label") == UNKNOWN).select(F.explode("grams").alias("gram")).groupBy("gram").count().where(F.col("count") > max(2.0, 0.002 * n))
    templates = _templates(spark)
    vocabulary = templates.select(F.explode("grams").alias("gram")).distinct().join(common, "gram", "left_anti")
    vocabulary = sorted(r[0] for r in vocabulary.collect())  # as many as the templates have at most
    number = F.create_map(*[F.lit(x) for k, c in enumerate(classes) for x in (c, float(k))])
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features")
    # some thousand rows, read again and again
    data = vectors.setBinary(True).transform(rows.coalesce(2).withColumn("y", number[F.col("label")]))
    fitted = LogisticRegression(labelCol="y", family="multinomial", regParam=3e-4, maxIter=80).fit(data.where("not kept_back"))
    matrix, bias = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    weights = spark.createDataFrame([(g, [float(x) for x in matrix[:, k]]) for k, g in enumerate(vocabulary)], "gram string, w array<double>")
    # the temperature with the least log loss on the rows kept back
    tried = [0.25 * 1.2**k for k in range(20)]
    odds = fitted.transform(data.where("kept_back").select("y", "features")).select(F.col("y").cast("int").alias("y"), vector_to_array("rawPrediction").alias("o"))
    odds = odds.withColumn("o", F.transform("o", lambda o: o - F.get("o", F.col("y")))).select("o", F.explode(F.array(*map(F.lit, tried))).alias("t"))
    loss = F.log(F.aggregate("o", F.lit(0.0), lambda total, o: total + F.exp(o / F.col("t"))))
    losses = odds.groupBy("t").agg(F.avg(loss).alias("loss")).collect()
    best = min(losses, key=lambda r: (r["loss"], r["t"]))["t"] if losses else tried[0]
    return LicenceModel(tuple(classes), tuple(float(b) for b in bias), best, weights, _placed_templates(spark, vocabulary))


def _hits(docs: DataFrame, model: LicenceModel, id_col: str, text_col: str) -> DataFrame:
    """(row, id, paragraph, pos, gram): the model's n-grams in docs and the places of their first words; for every row one
    more at paragraph 0. row numbers the rows of docs."""
    mark, spark = "\x00", docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    each = rows.select("row", "id", F.posexplode(F.concat(F.array(F.lit(mark)), F.coalesce(paragraphs(F.col("text")), F.array()))).alias("paragraph", "p"))
    each = each.select("row", "id", "paragraph", F.when(F.col("p") == mark, F.array(F.lit(mark), F.lit(mark))).otherwise(words(F.col("p"))).alias("w"))
    after = lambda k: F.slice("w", F.lit(k), F.greatest(F.size("w") - k + 1, F.lit(0)))
    each = each.select("row", "id", "paragraph", F.col("w").alias("a"), after(2).alias("b"), after(3).alias("c"))
    # outer, as the optimiser would else compute the words a second time to find the empty ones
    each = each.select("row", "id", "paragraph", F.posexplode_outer(F.arrays_zip("a", "b", "c")).alias("pos", "s")).select("row", "id", "paragraph", "pos", "s.a", "s.b", "s.c")
    known = [r[0] for r in model.weights.select("gram").collect()]  # as many as the templates have at most
    pairs = sorted({tuple(g.split(" ")[:2]) for g in known} | {(mark, mark)})
    each = each.where("b is not null").join(F.broadcast(spark.createDataFrame(pairs, "a string, b string")), ["a", "b"])
    each = each.select("row", "id", "paragraph", "pos", F.explode(F.array(F.concat_ws(" ", "a", "b"), F.concat(F.col("a"), F.lit(" "), F.col("b"), F.lit(" "), F.col("c")))).alias("gram"))
    return each.join(F.broadcast(spark.createDataFrame([(g,) for g in [*known, f"{mark} {mark}"]], "gram string")), "gram")


def licence_paragraphs(docs: DataFrame, model: LicenceModel, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, covered: float = 0.7) -> DataFrame:
    """(row, id_col, paragraph, family, probability, template_share): the confirmed families of each paragraph, and for every
    row one more with a null paragraph, so that rows without a licence are there too. row numbers the rows of docs.

    A family is confirmed where a stretch of the paragraph shares covered of the n-grams of one of its templates or more, in
    about their places, no other family's template that lies over it fits better, and it is the stretch's likeliest class,
    with a calibrated probability of least or more. Null and empty texts have no paragraphs.
    """
    hits = stored(_hits(docs, model, id_col, text_col), "licence-hits")
    real = hits.where("paragraph > 0")
    # hits whose place less that in the template differs little are of one copy of it; each is in two windows of this difference
    placed = real.join(F.broadcast(model.templates), "gram").withColumn("room", F.greatest(F.lit(4), F.ceil(F.col("n") / 3)))
    at = F.floor((F.col("pos") - F.col("offset")) / F.col("room"))
    placed = placed.withColumn("window", F.explode(F.array(at - 1, at)))
    key = ["row", "id", "paragraph", "template", "family", "window"]
    found = placed.groupBy(*key).agg(F.count_distinct("gram").alias("shared"), F.max("size").alias("size"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    place = ["template_share", "shared", "first", "last"]
    found = found.withColumn("template_share", F.col("shared") / F.col("size")).where(F.col("template_share") >= covered).select(*key, *place)
    # the classes of each stretch, by all of the model's n-grams in it; blocks of places keep the join to its neighbourhood
    block = lambda c: F.floor(F.col(c) / STRETCH)
    blocks = F.explode(F.sequence(block("first"), block("last"))).alias("block")
    inside = found.select("*", blocks).join(real.select("row", "paragraph", "pos", "gram", block("pos").alias("block")), ["row", "paragraph", "block"])
    inside = inside.where("pos between first and last").select(*key, *place, "gram").distinct()
    total = F.aggregate(F.collect_list("w"), F.array(*map(F.lit, model.bias)), lambda all, w: F.zip_with(all, w, lambda a, b: a + b))
    odds = inside.join(F.broadcast(model.weights), "gram").groupBy(*key, *place).agg(F.transform(total, lambda o: o / model.temperature).alias("logits"))
    odds = odds.withColumn("top", F.array_max("logits"))
    odds = odds.withColumn("likeliest", F.get(F.array(*map(F.lit, model.classes)), F.array_position("logits", F.col("top")).cast("int") - 1))
    odds = odds.withColumn("probability", 1 / F.aggregate("logits", F.lit(0.0), lambda total, o: total + F.exp(o - F.col("top"))))
    odds = stored(odds.select(*key, *place, "likeliest", "probability"), "licence-stretches")
    # where templates of two families lie over each other, the better one counts
    other = odds.select("row", "paragraph", F.col("family").alias("_family"), *[F.col(c).alias(f"_{c}") for c in place], blocks)
    both = F.least("last", "_last") - F.greatest("first", "_first") + 1
    better = F.struct("_template_share", "_shared") > F.struct(F.col("template_share").alias("_template_share"), F.col("shared").alias("_shared"))
    beaten = odds.select("*", blocks).join(other, ["row", "paragraph", "block"]).where((F.col("family") != F.col("_family")) & better & (3 * both > F.col("last") - F.col("first") + 1))
    own = [c for c in key if c != "id"]  # which may be null
    odds = odds.join(beaten.select(*own).distinct(), own, "left_anti")
    confirmed = odds.where((F.col("likeliest") == F.col("family")) & (F.col("probability") >= least))
    confirmed = confirmed.groupBy("row", "id", "paragraph", "family").agg(F.max("probability").alias("probability"), F.max("template_share").alias("template_share"))
    none = lambda c: F.lit(None).cast(confirmed.schema[c].dataType).alias(c)
    every = hits.where("paragraph = 0").select("row", "id", *map(none, ("paragraph", "family", "probability", "template_share")))
    return every.unionByName(confirmed).withColumnRenamed("id", id_col)


def scan(docs: DataFrame, model: LicenceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, family (of its likeliest licence paragraph, null for none), families (all, sorted and
    comma-joined), n_paragraphs (with a licence; one with two families counts twice), probability. Repeated rows come back as often as they came."""
    each = licence_paragraphs(docs, model, id_col, text_col)
    return each.groupBy("row", id_col).agg(
        F.max_by("family", F.struct("probability", "family")).alias("family"),
        F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"),
        F.count("family").alias("n_paragraphs"),
        F.max("probability").alias("probability"),
    ).drop("row")
