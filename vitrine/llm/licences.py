"""Licence scans by sentence rules.

Texts are normalised to lower-case ASCII letters and digits with single spaces, which joins wrapped
lines and takes away comment marks, quotes and punctuation. Known licence sentences are recognised
as word sequences, so neither a copyright line nor an address or a project's name beside a
sentence hides it; each maps to its identifier. The identifiers of a document, in order and without
what is unknown between them, are matched against ordered rules: a rule applies where its
identifiers follow one another, unless only within those of a longer rule that applies there. Where two known
sentences begin at one word, the longer one counts; a reference behind "not" is a sentence of its own, which no rule asks for.

SPDX tags are read apart from the words, as whole expressions: each identifier in one counts if it is known, old forms by
their present name, and an unknown one, such as a longer form of a known one, does not.

The tables of sentences and rules are DataFrames (``sentences_table``, ``rules_table``), of at most
``MOST`` rows together: they become part of the plan, so the whole scan is one pass without a
shuffle. Texts that hold none of the ``MARKS``, one of which is in every known sentence, are left
at once.

Main path: DataFrame functions only.

Cases: a null or empty text has no sentences and no row; a rule that applies twice gives one row;
rules of one licence are rows of their own; repeated rows give repeated findings; other columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST = 10_000
#: Every known sentence holds one of these.
MARKS = ("licen", "software", "copyright", "domain", "redistribut", "gpl")

#: Sentences of public licences, or what of them does not change with names and years.
SENTENCES: dict[str, str] = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-asis": "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the License)",
    "apache-header-granted": "licenses this file to you under the Apache License, Version 2.0 (the License)",
    "apache-may-not": "you may not use this file except in compliance with the License",
    "apache-unless": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or conditions of any kind, either express or implied",
    "apache-grant": "each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license",
    "apache-patents": "each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (except as stated in this section) patent license",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-endorse": "contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-grant-and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "isc-asis": "the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "zlib-asis": "This software is provided as-is, without any express or implied warranty",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "boost-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software",
    "gpl-2-later": "is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl-3-later": "is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-2-only": "is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "gpl-3-only": "is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation",
    "lgpl-21-later": "is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl-3-later": "is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl-3-later": "is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-received": "You should have received a copy of the GNU General Public License along with",
    "lgpl-received": "You should have received a copy of the GNU Lesser General Public License along with",
    "agpl-received": "You should have received a copy of the GNU Affero General Public License along with",
    "gpl-3-preamble": "The GNU General Public License is a free, copyleft license for software and other kinds of works",
    "mpl-2-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "epl-2-header": "made available under the terms of the Eclipse Public License 2.0",
    "epl-2-header-v": "made available under the terms of the Eclipse Public License v2.0",
    "cc0-dedicated": "dedicated to the public domain under CC0 1.0",
    "cc0-waived": "has waived all copyright and related or neighboring rights to this work",
    "unlicense-released": "This is free and unencumbered software released into the public domain",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
}

#: (rule, licence, its sentences in order)
RULES: list[tuple[str, str, list[str]]] = [
    ("mit-text", "MIT", ["mit-grant", "mit-notice", "mit-asis"]),
    ("apache-2-header", "Apache-2.0", ["apache-header", "apache-may-not", "apache-unless"]),
    ("apache-2-header-granted", "Apache-2.0", ["apache-header-granted", "apache-may-not", "apache-unless"]),
    ("apache-2-text", "Apache-2.0", ["apache-grant", "apache-patents"]),
    ("bsd-2-text", "BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("bsd-3-text", "BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("bsd-4-text", "BSD-4-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse"]),
    ("isc-text", "ISC", ["isc-grant", "isc-asis"]),
    ("isc-text-and", "ISC", ["isc-grant-and", "isc-asis"]),
    ("0bsd-text", "0BSD", ["0bsd-grant", "isc-asis"]),
    ("zlib-text", "Zlib", ["zlib-asis", "zlib-grant"]),
    ("boost-1-text", "BSL-1.0", ["boost-grant"]),
    ("gpl-2-header", "GPL-2.0-or-later", ["gpl-2-later"]),
    ("gpl-3-header", "GPL-3.0-or-later", ["gpl-3-later"]),
    ("gpl-2-only-header", "GPL-2.0-only", ["gpl-2-only"]),
    ("gpl-3-only-header", "GPL-3.0-only", ["gpl-3-only"]),
    ("lgpl-21-header", "LGPL-2.1-or-later", ["lgpl-21-later"]),
    ("lgpl-3-header", "LGPL-3.0-or-later", ["lgpl-3-later"]),
    ("agpl-3-header", "AGPL-3.0-or-later", ["agpl-3-later"]),
    ("gpl-3-text", "GPL-3.0-only", ["gpl-3-preamble"]),
    ("mpl-2-header", "MPL-2.0", ["mpl-2-header"]),
    ("epl-2-header", "EPL-2.0", ["epl-2-header"]),
    ("epl-2-header-v", "EPL-2.0", ["epl-2-header-v"]),
    ("cc0-reference", "CC0-1.0", ["cc0-dedicated"]),
    ("cc0-waiver", "CC0-1.0", ["cc0-waived"]),
    ("unlicense-text", "Unlicense", ["unlicense-released", "unlicense-anyone"]),
    ("unlicense-reference", "Unlicense", ["unlicense-released"]),
]

#: Licences as sentences call them.
NAMES: dict[str, list[str]] = {
    "MIT": ["the MIT License", "an MIT license", "the terms of the MIT license"],
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "the 2-Clause BSD License"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "the 3-Clause BSD License"],
    "ISC": ["the ISC License"],
    "BSL-1.0": ["the Boost Software License, Version 1.0"],
    "GPL-2.0-only": ["the GNU General Public License, version 2", "the GNU GPL v2", "the GPLv2"],
    "GPL-3.0-only": ["the GNU General Public License, version 3", "the GNU GPL v3", "the GPLv3"],
    "LGPL-2.1-only": ["the GNU Lesser General Public License, version 2.1", "the LGPLv2.1"],
    "LGPL-3.0-only": ["the GNU Lesser General Public License, version 3", "the LGPLv3"],
    "AGPL-3.0-only": ["the GNU Affero General Public License, version 3", "the AGPLv3"],
    "MPL-2.0": ["the Mozilla Public License 2.0", "the Mozilla Public License, version 2.0"],
    "EPL-2.0": ["the Eclipse Public License 2.0"],
}
#: What follows a name that stands for the later versions too.
LATER = ["or later", "or any later version", "or (at your option) any later version"]
#: Names without an article, and how two licences are offered at once.
BARE = {"MIT": ["MIT", "either MIT license"], "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "either of Apache License, Version 2.0", "either the Apache License, Version 2.0"], "BSD-3-Clause": ["BSD-3-Clause"], "BSD-2-Clause": ["BSD-2-Clause"], "ISC": ["ISC"], "MPL-2.0": ["MPL 2.0"]}
OFFERED = {"MIT": ["or MIT license", "or the MIT license"], "Apache-2.0": ["or Apache License, Version 2.0", "or the Apache License, Version 2.0"]}
#: Identifiers of the common licences, as SPDX writes them.
SPDX = """
    0BSD AFL-3.0 Apache-1.0 Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 Beerware BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-3-Clause-LBNL BSD-4-Clause BSL-1.0
    CC0-1.0 CDDL-1.0 CDDL-1.1 CDLA-Permissive-2.0 CECILL-2.1 CPL-1.0 curl ECL-2.0 EFL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 FTL HPND ICU IJG ISC JSON libpng-2.0 libtiff LPPL-1.3c MIT MIT-0 MIT-CMU
    MPL-1.0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA NTP ODbL-1.0 OFL-1.1 OpenSSL OSL-3.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 Ruby Unicode-3.0 Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1
""".split()
#: Licences with versions of which later ones may be allowed.
FAMILIES = {"GPL": ["1.0", "2.0", "3.0"], "LGPL": ["2.0", "2.1", "3.0"], "AGPL": ["1.0", "3.0"], "GFDL": ["1.1", "1.2", "1.3"]}
#: The parts of Creative Commons licences.
COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
VERBS = ("licensed", "released", "distributed", "available")


#: An expression behind a tag, up to what can't belong to it.
_ID = r"\(*[A-Za-z0-9][A-Za-z0-9.+-]*\)*"
TAG = rf"(?i:SPDX-License-Identifier)[ \t]*:[ \t]*({_ID}(?:[ \t]+(?:AND|OR|WITH|and|or|with)[ \t]+{_ID})*)"
#: What parts the identifiers of an expression; exceptions go with their licence.
BETWEEN = r"[ \t]+(?:WITH|with)[ \t]+[^ \t]+|[ \t]+(?:AND|OR|and|or)[ \t]+"


def identifiers() -> dict[str, str]:
    """Lower-case SPDX identifiers with their present form; of those that are out of date the one that took their place."""
    known = {name.lower(): name for name in [*SPDX, *(f"CC-{parts}-{version}" for parts in COMMONS for version in ("1.0", "2.0", "2.5", "3.0", "4.0"))]}
    for family, versions in FAMILIES.items():
        for version in versions:
            plain = f"{family}-{version}"
            for form, present in (("", "-only"), ("-only", "-only"), ("+", "-or-later"), ("-or-later", "-or-later")):
                known[f"{plain}{form}".lower()] = f"{plain}{present}"
    return known


def normal(sentence: str) -> str:
    """A sentence as texts are normalised."""
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def references() -> tuple[dict[str, str], list[tuple[str, str, list[str]]]]:
    """Sentences that refer to a licence by a verb and its name, or by its identifier, and a rule for each."""
    named = {licence: list(names) for licence, names in NAMES.items()}
    for licence, names in NAMES.items():
        if licence.endswith("-only"):
            named[licence.replace("-only", "-or-later")] = [f"{name} {later}" for name in names for later in LATER]
    for licence, names in BARE.items():
        named[licence] = named[licence] + names
    for parts, long in COMMONS.items():
        for version in ("3.0", "4.0"):
            named[f"CC-{parts}-{version}"] = [f"CC {parts} {version}", f"a Creative Commons {long} {version} {'International' if version == '4.0' else 'Unported'} License"]
    sentences, rules = {}, []
    for licence, names in named.items():
        texts = [f"{verb} under {name}" for name in names for verb in VERBS] + OFFERED.get(licence, [])
        for k, text in enumerate((t for t in texts if any(m in t.lower() for m in MARKS)), 1):
            key = f"{licence.lower()}-reference-{k}"
            sentences[key] = text
            rules.append((key, licence, [key]))
            if text.startswith(VERBS):
                sentences[f"not-{key}"] = f"not {text}"
    return sentences, rules


def sentences_table(spark: SparkSession) -> DataFrame:
    """(id, sentence) of the sentences known here."""
    return spark.createDataFrame(list({**SENTENCES, **references()[0]}.items()), "id string, sentence string")


def rules_table(spark: SparkSession) -> DataFrame:
    """(rule, licence, ids) of the rules known here."""
    return spark.createDataFrame([*RULES, *references()[1]], "rule string, licence string, ids array<string>")


def normalised(text: Column) -> Column:
    """A text as words of lower-case letters and digits, a space before and after each."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), F.lit(" "))


def any_of(sentences: list[str]) -> str:
    """A regular expression of word sequences; of several that begin at one word the longest."""
    tree: dict = {}
    for sentence in sentences:
        node = tree
        for word in sentence.split():
            node = node.setdefault(word, {})
        node[""] = {}

    def text(node: dict) -> str:
        """The words that may follow, each with the space before it."""
        tails = [f" {word}{text(below)}" for word, below in sorted(node.items()) if word]
        if not tails:
            return ""
        joined = tails[0] if len(tails) == 1 else f"(?:{'|'.join(tails)})"
        return f"(?:{joined})?" if "" in node else joined

    return f"{text(tree)}(?= )"


def scan(documents: DataFrame, sentences: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    """(doc_id, licence, rule, sentence_ids): a row for each rule that a document's sentences match.

    ``sentences`` (id, sentence) and ``rules`` (rule, licence, ids) replace the tables known here.
    ``sentence_ids`` are the document's identifiers in order, joined by a comma. Identifiers in SPDX tags are rows of the rule
    ``spdx-tag``, each once for a document.
    """
    spark = documents.sparkSession
    known = {normal(r["sentence"]): r["id"] for r in (sentences if sentences is not None else sentences_table(spark)).orderBy("id").limit(MOST + 1).collect()}
    own_rules = (rules if rules is not None else rules_table(spark)).orderBy("rule").limit(MOST + 1).collect()
    if len(known) + len(own_rules) > MOST:
        raise ValueError(f"sentences and rules are part of the plan: at most {MOST} of them")
    unmarked = [s for s in known if not any(m in s for m in MARKS)]
    if unmarked or not known or not own_rules:
        raise ValueError(f"sentences without any of {MARKS}: {unmarked}" if unmarked else "no sentences or no rules")
    ids = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    marked = documents.select("doc_id", "text").where(F.lower("text").rlike("|".join(MARKS)))
    present = F.create_map(*[F.lit(x) for pair in identifiers().items() for x in pair])
    expressions = F.regexp_extract_all("text", F.lit(TAG), F.lit(1))
    tags = F.flatten(F.transform(expressions, lambda e: F.split(F.lower(F.translate(e, "()", "")), BETWEEN)))
    tagged = F.array_distinct(F.filter(F.transform(tags, lambda t: F.try_element_at(present, F.btrim(t))), lambda x: x.isNotNull()))
    found = marked.select("doc_id", F.regexp_extract_all(normalised(F.col("text")), F.lit(any_of(list(known))), F.lit(0)).alias("s"), tagged.alias("tagged")).where("size(s) > 0 OR size(tagged) > 0")
    named = found.select("doc_id", "tagged", F.array_join(F.transform("s", lambda s: F.element_at(ids, F.btrim(s))), ",").alias("sentence_ids"))
    table = F.array(*[F.struct(F.lit(r["rule"]).alias("rule"), F.lit(r["licence"]).alias("licence"), F.lit(f",{','.join(r['ids'])},").alias("seq")) for r in own_rules])
    listed = F.concat(F.lit(","), F.col("sentence_ids"), F.lit(","))
    hits = named.withColumn("hits", F.filter(table, lambda r: F.contains(listed, r["seq"])))
    # a rule within a longer one counts where it stands outside of that one too
    within = lambda r: F.exists("hits", lambda o: (F.length(o["seq"]) > F.length(r["seq"])) & F.contains(o["seq"], r["seq"]) & ~F.contains(F.replace(listed, o["seq"], F.lit(",;,")), r["seq"]))
    own = F.transform(F.filter("hits", lambda r: ~within(r)), lambda r: F.struct(r["licence"].alias("licence"), r["rule"].alias("rule")))
    by_tag = F.transform("tagged", lambda t: F.struct(t.alias("licence"), F.lit("spdx-tag").alias("rule")))
    return hits.select("doc_id", "sentence_ids", F.explode(F.concat(own, by_tag)).alias("r")).select("doc_id", "r.licence", "r.rule", "sentence_ids")
