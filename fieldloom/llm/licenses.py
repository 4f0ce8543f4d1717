"""License scans, in DataFrame operations only: MinHash bands over overlapping text windows retrieve templates, exact shingle
containment verifies them.

Texts are lower-cased and cut into words of letters and digits; a shingle is SHINGLE words. Templates are cut into
windows at every start, texts into overlapping ones; a window's bands are its minima under BANDS[size] orders of the
shingle hashes, one row a band, so windows of similarity J share a band with probability 1 - (1 - J)^bands:

 * a template of 32 shingles or more has windows of 16. Texts have windows of 16 at every eighth shingle, so one at least
   lies inside any passage of 23. A text that holds `THRESHOLD` = 0.8 of a template in place holds 0.8 of one of
   these, J >= 2/3: with 8 bands it is found with probability 0.9998 in that window alone;
 * one of 4 to 31 has windows of 4, in texts at every start. 0.8 of it holds four shingles in a row, J = 1: found for certain;
 * a shorter one has windows of 1, their own minimum, in texts at every start: found for certain.

Only rows with a retrieved band go on, with their shingle hashes, under a row number; all others, and all texts, stay where
they are. Retrieved (row, template) pairs are verified: at least 0.8 of the template's distinct shingles
occur in the text. The library is what the caller states on the driver; about one band key for each of its words travels
with the plan.

Defined results: a null or empty text matches nothing; a text or template shorter than a shingle is one shingle, its
whole word sequence; a template without words is ignored; repeated rows give their matches each; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import materialised

SHINGLE, THRESHOLD = 5, 0.8
#: Bands of the windows of each size, and from how many shingles on a template has windows of that size.
BANDS, FROM = {1: 1, 4: 4, 16: 8}, {1: 0, 4: 4, 16: 32}
STEP = 8
#: Orders of hashes: each flips other leading bits, so that minima are taken at places far from each other.
ORDERS = [(k << 61 | (0x1B873593CC9E2D51 * (k + 1)) % (1 << 61)) - (1 << 63) for k in range(8)]
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Notices of common licences, as their stewards publish them.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
}


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """Binds a value for an expression that uses it many times, so that it is computed once a row."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def shingles_of(words: Column) -> Column:
    """Hashes of all shingles, in order; at least one unless there are no words."""
    n = F.size(words)
    last = F.greatest(n - (SHINGLE - 1), F.lit(1))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(words, i, SHINGLE)))).otherwise(F.array().cast("array<bigint>"))


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """template, all: its shingles' hashes in order."""
    rows = F.array(*(F.struct(F.lit(k).alias("template"), F.lit(v).alias("text")) for k, v in templates.items()))
    x = spark.range(1).select(F.explode(rows).alias("t")).select("t.template", shingles_of(words_of(F.col("t.text"))).alias("all"))
    return x.filter(F.size("all") > 0)


def templates_in(spark: SparkSession, folder: str) -> dict[str, str]:
    """The text files of a folder as templates, named after the files: a bounded library."""
    files = spark.read.text(folder, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), "value")
    return {r["name"]: r["value"] for r in files.collect()}


def flipped(hashes: Column, band: int) -> Column:
    return F.transform(hashes, lambda x: x.bitwiseXOR(F.lit(ORDERS[band])))


def windows_at(starts: Column, size: int) -> Column:
    return F.transform(starts, lambda i: F.slice("all", i, size))


def ahead(x: Column, k: int) -> Column:
    """The lesser of each element and the one k places on."""
    return F.zip_with(x, F.slice(x, k + 1, F.size(x)), lambda a, b: F.least(a, b))


def minima(hashes: Column, size: int, band: int) -> Column:
    """The minima of one order over the windows of one size: at every start, for 16 at every eighth."""
    if size == 1:
        return hashes
    if size == 4:
        return let(let(flipped(hashes, band), lambda x: ahead(x, 1)), lambda x: ahead(x, 2))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(hashes) - (size - STEP)), F.lit(STEP))
    return let(flipped(hashes, band), lambda x: F.transform(starts, lambda i: F.array_min(F.slice(x, i, size))))


def band_table(table: DataFrame) -> DataFrame:
    """template, size, band, least: the minimum of every band of every window of the templates."""
    parts = []
    for size, bands in BANDS.items():
        last = min((f for f in FROM.values() if f > FROM[size]), default=1 << 31)
        own = table.filter(F.size("all").between(FROM[size], last - 1))
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - (size - 1)))
        own = own.select("template", F.explode(windows_at(starts, size)).alias("window"))
        for band in range(bands):
            least = F.get("window", F.lit(0)) if size == 1 else F.array_min(flipped(F.col("window"), band))
            parts.append(own.select("template", F.lit(size).alias("size"), F.lit(band).alias("band"), least.alias("least")))
    return reduce(DataFrame.unionByName, parts).distinct()


def key_of(size: Column, band: Column, least: Column) -> Column:
    return F.xxhash64(size, band, least)


def retrieved(docs: DataFrame, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that share a band with a template (row, doc_id, hashes), and their (row, template) pairs."""
    bands = band_table(table)
    sets: dict[tuple[int, int], set[int]] = {(size, band): set() for size, n in BANDS.items() for band in range(n)}
    for r in bands.collect():
        sets[r["size"], r["band"]].add(r["least"])

    def of_band(hashes: Column, size: int, band: int) -> Column:
        hit = F.filter(minima(hashes, size, band), lambda x: x.isin(*sets[size, band]))
        return F.transform(hit, lambda x: key_of(F.lit(size), F.lit(band), x))

    def shared(hashes: Column) -> Column:
        parts = [of_band(hashes, size, band) for (size, band), own in sets.items() if own]
        return F.array_distinct(F.concat(*parts)) if parts else F.array().cast("array<bigint>")

    def kept(hashes: Column) -> Column:
        return let(shared(hashes), lambda k: F.when(F.size(k) > 0, F.struct(hashes.alias("hashes"), k.alias("keys"))))

    found = let(words_of(F.col("text")), lambda w: let(shingles_of(w), kept))
    rows = docs.select("doc_id", found.alias("f")).filter(F.col("f").isNotNull())
    rows = materialised(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "f.hashes", "f.keys"))
    bands = bands.select("template", key_of(F.col("size"), F.col("band"), F.col("least")).alias("key")).distinct()
    pairs = rows.select("row", F.explode("keys").alias("key")).join(bands, "key").select("row", "template").distinct()
    return rows.drop("keys"), pairs


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, template, containment (share of the template's distinct shingles that the text has) and
    first_word (number of the word at which the first of them starts), for every match."""
    table = template_table(docs.sparkSession, TEMPLATES if templates is None else templates)
    rows, pairs = retrieved(docs, table)
    shingles = table.select("template", F.explode("all").alias("s")).distinct()
    sizes = shingles.groupBy("template").agg(F.count("*").alias("of"))
    words = pairs.join(rows, "row").select("row", "template", "doc_id", F.posexplode("hashes").alias("at", "s"))
    met = words.join(shingles, ["template", "s"]).groupBy("row", "template", "doc_id", "s").agg(F.min("at").alias("at"))
    met = met.groupBy("row", "template", "doc_id").agg(F.count("*").alias("n"), F.min("at").cast("int").alias("first_word"))
    share = F.col("n") / F.col("of")
    return met.join(sizes, "template").select("doc_id", "template", share.alias("containment"), "first_word").filter(F.col("containment") >= THRESHOLD)
