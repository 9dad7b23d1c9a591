"""Licence recognition by sentence rules; DataFrame operations only, one pass, no shuffle.

A text is cut into sentences twice: by line, and by paragraph with its lines joined (for wrapped licence texts). Each
normalised sentence that equals a known one becomes its identifier; the identifiers of a text, in order, are matched
against the ordered rules: a rule is found where its identifiers follow each other among the text's known sentences, in
either sequence (a title, an address or a copyright line between them doesn't count). References to a licence by name or
by SPDX tag are sentences made from rules.

Defined results: a null, empty or licence-free text has n_known 0, empty lists and class 'none'; repeated rows each get a
row; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Licences in order of precedence, their classes, and the names by which texts refer to them.
LICENCES = [
    ("MIT", "permissive", ["mit license"]),
    ("MIT-0", "permissive", ["mit no attribution license"]),
    ("Apache-2.0", "permissive", ["apache license version 2.0", "apache license 2.0", "apache 2.0 license", "apache license v2.0", "apache 2.0"]),
    ("BSD-2-Clause", "permissive", ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license"]),
    ("BSD-3-Clause", "permissive", ["bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license"]),
    ("0BSD", "permissive", ["zero clause bsd license"]),
    ("ISC", "permissive", ["isc license"]),
    ("Zlib", "permissive", ["zlib license"]),
    ("BSL-1.0", "permissive", ["boost software license version 1.0", "boost software license 1.0"]),
    ("NCSA", "permissive", ["university of illinois ncsa open source license"]),
    ("PostgreSQL", "permissive", ["postgresql license"]),
    ("Python-2.0", "permissive", ["python software foundation license version 2"]),
    ("Artistic-2.0", "permissive", ["artistic license 2.0"]),
    ("AFL-3.0", "permissive", ["academic free license version 3.0"]),
    ("MS-PL", "permissive", ["microsoft public license"]),
    ("Unlicense", "public-domain", ["unlicense"]),
    ("CC0-1.0", "public-domain", ["cc0 1.0", "cc0 1.0 universal license"]),
    ("GPL-2.0", "copyleft", ["gnu general public license version 2", "gnu general public license v2.0", "gnu general public license v2", "gnu gpl v2", "gnu gplv2", "gplv2", "gpl v2", "gpl 2.0", "gplv2 license"]),
    ("GPL-3.0", "copyleft", ["gnu general public license version 3", "gnu general public license v3.0", "gnu general public license v3", "gnu gpl v3", "gnu gplv3", "gplv3", "gpl v3", "gpl 3.0", "gplv3 license"]),
    ("LGPL-2.1", "copyleft", ["gnu lesser general public license version 2.1", "gnu lesser general public license v2.1", "gnu lgpl v2.1", "lgplv2.1", "lgpl v2.1"]),
    ("LGPL-3.0", "copyleft", ["gnu lesser general public license version 3", "gnu lesser general public license v3.0", "gnu lgpl v3", "lgplv3", "lgpl v3", "lgpl 3.0"]),
    ("AGPL-3.0", "copyleft", ["gnu affero general public license version 3", "gnu affero general public license v3.0", "gnu agpl v3", "agplv3", "agpl v3", "agpl 3.0"]),
    ("MPL-2.0", "copyleft", ["mozilla public license version 2.0", "mozilla public license 2.0"]),
    ("EPL-2.0", "copyleft", ["eclipse public license version 2.0", "eclipse public license 2.0"]),
    ("EUPL-1.2", "copyleft", ["european union public licence version 1.2", "european union public license version 1.2"]),
    ("CDDL-1.0", "copyleft", ["common development and distribution license version 1.0"]),
    ("OFL-1.1", "copyleft", ["sil open font license version 1.1"]),
    ("GFDL-1.3", "copyleft", ["gnu free documentation license version 1.3"]),
    ("CC-BY-SA-4.0", "copyleft", ["cc by sa 4.0", "creative commons attribution sharealike 4.0 international license"]),
    ("CC-BY-SA-3.0", "copyleft", ["cc by sa 3.0", "creative commons attribution sharealike 3.0 unported license"]),
    ("CC-BY-4.0", "permissive", ["cc by 4.0", "creative commons attribution 4.0 international license"]),
    ("CC-BY-3.0", "permissive", ["cc by 3.0", "creative commons attribution 3.0 unported license"]),
    ("CC-BY-NC-4.0", "noncommercial", ["cc by nc 4.0", "creative commons attribution noncommercial 4.0 international license"]),
    ("CC-BY-NC-SA-4.0", "noncommercial", ["cc by nc sa 4.0", "creative commons attribution noncommercial sharealike 4.0 international license"]),
    ("CC-BY-ND-4.0", "no-derivatives", ["cc by nd 4.0", "creative commons attribution noderivatives 4.0 international license"]),
    ("CC-BY-NC-ND-4.0", "noncommercial", ["cc by nc nd 4.0", "creative commons attribution noncommercial noderivatives 4.0 international license"]),
    ("BUSL-1.1", "source-available", ["business source license 1.1"]),
    ("BSD", "permissive", ["bsd license"]),  # which of them isn't said
]

#: Sentences that refer to a licence by name, after normalising. The bare name counts where it says 'licen'.
REFERENCES = [
    "licensed under {}",
    "licensed under the {}",
    "licensed under a {}",
    "license {}",
    "this work is licensed under {}",
    "this work is licensed under a {}",
    "this work is licensed under the {}",
    "this project is licensed under the {}",
    "this project is licensed under the {} see the license file for details",
    "{} see license",
    "licensed under the {} the license",
    "licensed under {} the license",
    "this file is licensed under the {}",
    "this software is licensed under the {}",
    "this program is licensed under the {}",
    "this code is licensed under the {}",
    "available under the {} license",
    "dual licensed under the {}",
]
RELEASES = ["{}", "the {}", "under the {}", "released under the {}", "distributed under the {}", "this software is released under the {}", "this project is released under the {}", "this code is released under the {}", "available under the {}"]

#: Sentences of licence texts and notices after normalising, by identifier.
SENTENCES = {
    "mit-name": "the mit license mit",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-grant-0": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-asis": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "apache2-grant": "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license",
    "apache2-copy": "you may obtain a copy of the license at",
    "apache2-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2-see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl21-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version",
    "gpl2-only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2 of the license",
    "gpl2-only-short": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "lgpl3-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl3-program": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-see": "see the gnu lesser general public license for more details",
    "apache2-title": "apache license version 2.0 january 2004 http www.apache.org licenses",
    "gpl2-title": "gnu general public license version 2 june 1991",
    "gpl3-title": "gnu general public license version 3 29 june 2007",
    "agpl3-title": "gnu affero general public license version 3 19 november 2007",
    "lgpl21-title": "gnu lesser general public license version 2.1 february 1999",
    "lgpl3-title": "gnu lesser general public license version 3 29 june 2007",
    "gpl-copying": "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    "epl2-title": "eclipse public license v 2.0",
    "cc0-title": "cc0 1.0 universal",
    "cc0-code": "creative commons legal code cc0 1.0 universal",
    "bsd-holders": "neither the name of the nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "agpl-see": "see the gnu affero general public license for more details",
    "bsd-redist": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "mpl2-form": "this source code form is subject to the terms of the mozilla public license v",
    "mpl2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "isc-asis": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "zlib-asis": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost-name": "distributed under the boost software license version 1.0",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "reserved": "all rights reserved",
}

#: Rules in order of precedence: licence, identifiers that follow each other among a text's known sentences.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-asis", "mit-liability"]),
    ("MIT-0", ["mit-grant-0", "mit-asis", "mit-liability"]),
    ("Apache-2.0", ["apache2-grant", "apache2-copy", "apache2-basis", "apache2-see"]),
    ("GPL-3.0", ["gpl3-free", "gpl-hope", "gpl-see"]),
    ("GPL-2.0", ["gpl2-free", "gpl-hope", "gpl-see"]),
    ("AGPL-3.0", ["agpl3-free", "gpl-hope", "agpl-see"]),
    ("BSD-3-Clause", ["bsd-redist", "bsd-source", "bsd-binary", "bsd-name"]),
    ("BSD-2-Clause", ["bsd-redist", "bsd-source", "bsd-binary"]),
    ("ISC", ["isc-grant", "isc-asis"]),
    ("0BSD", ["0bsd-grant", "isc-asis"]),
    ("Zlib", ["zlib-asis", "zlib-grant"]),
    ("MPL-2.0", ["mpl2-form", "mpl2-copy"]),
    ("LGPL-3.0", ["lgpl3-free", "gpl-hope", "lgpl-see"]),
    ("LGPL-3.0", ["lgpl3-program", "gpl-hope", "lgpl-see"]),
    ("BSD-3-Clause", ["bsd-redist", "bsd-source", "bsd-binary", "bsd-holders"]),
    ("MIT", ["mit-grant"]),
    ("MIT", ["mit-name"]),
    ("Apache-2.0", ["apache2-grant"]),
    ("GPL-3.0", ["gpl3-free"]),
    ("GPL-2.0", ["gpl2-free"]),
    ("AGPL-3.0", ["agpl3-free"]),
    ("LGPL-2.1", ["lgpl21-free"]),
    ("ISC", ["isc-grant"]),
    ("Zlib", ["zlib-grant"]),
    ("MPL-2.0", ["mpl2-form"]),
    ("BSL-1.0", ["boost-name"]),
    ("Unlicense", ["unlicense-free"]),
    ("GPL-2.0", ["gpl2-only"]),
    ("GPL-2.0", ["gpl2-only-short"]),
    ("LGPL-3.0", ["lgpl3-free"]),
    ("LGPL-3.0", ["lgpl3-program"]),
    ("Apache-2.0", ["apache2-title"]),
    ("GPL-2.0", ["gpl2-title"]),
    ("GPL-3.0", ["gpl3-title"]),
    ("AGPL-3.0", ["agpl3-title"]),
    ("LGPL-2.1", ["lgpl21-title"]),
    ("LGPL-3.0", ["lgpl3-title"]),
    ("EPL-2.0", ["epl2-title"]),
    ("CC0-1.0", ["cc0-title"]),
    ("CC0-1.0", ["cc0-code"]),
]


def normal(text: str) -> str:
    """As scan() normalises a sentence."""
    return re.sub("[^a-z0-9.!?]+", " ", text.lower()).strip(" ")


def known_sentences() -> dict[str, str]:
    """Identifiers by sentence: those of the texts, and of references to licences by name and by SPDX tag (licence/number)."""
    out = {s: k for k, s in SENTENCES.items()}
    for licence, _, names in LICENCES:
        found = [f"spdx license identifier {normal(licence)}{end}" for end in ("", " only", " orlater")]
        found += [t.format(n) for n in names for t in REFERENCES]
        found += [t.format(n) for n in names if "licen" in n for t in RELEASES]
        for k, s in enumerate(found):
            out.setdefault(s, f"{licence}/{k}")
    return out


KNOWN = known_sentences()
_CLASS = {licence: kind for licence, kind, _ in LICENCES}
#: What a rule or a reference finds: its rank, licence and class, so that their order is the order of precedence.
_BY_RULE = [f"{k:03d}|{licence}|{_CLASS[licence]}" for k, (licence, _) in enumerate(RULES)]
_BY_NAME = {licence: f"{len(RULES) + k:03d}|{licence}|{kind}" for k, (licence, kind, _) in enumerate(LICENCES)}

#: Every known sentence holds one of these, so a text without any of them has no known sentence.
ANCHORS = ("licen", "software", "copyright", "redistribut", "program", "rights", "mpl", "gpl", "cc0")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPDX = "spdx license identifier "
#: A colon before a list ends a sentence, and an item's number or letter is none of its words.
_LISTS = (r":([ \t\r]*\n[ \t/#*;%-]*\(?(?:[0-9]{1,2}|[a-z])[.)][ \t])", ".$1")
_NUMBERS = (r"(^|\n[ \t\r/#*;%-]*\n|[.;,:][ \t\r]*\n)[ \t/#*;%-]*\(?(?:[0-9]{1,2}|[a-z])[.)][ \t]+", "$1")
_ENDS = r"[.!?]+( |\n|$)|\n"


def _known(text: Column) -> Column:
    """Identifiers of the known sentences of normalised text, in order."""
    cut = F.transform(F.split(text, _ENDS), lambda s: F.trim(s))
    # the licences of an SPDX expression are sentences of their own
    each = lambda s: F.transform(F.split(F.substring(s, F.lit(len(SPDX) + 1), F.length(s)), " (or|and|with) "), lambda x: F.concat(F.lit(SPDX), F.trim(x)))
    cut = F.flatten(F.transform(cut, lambda s: F.when(s.startswith(SPDX), each(s)).otherwise(F.array(s))))
    sentences = F.filter(cut, lambda s: s.isin(list(KNOWN)))
    numbers = F.create_map(*(F.lit(x) for pair in KNOWN.items() for x in pair))
    return F.transform(sentences, lambda s: F.element_at(numbers, s))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: the id, n_known, sentence_ids (by line; by paragraph where those are more), licences, license_class."""
    lower = F.replace(F.translate(F.col("_text"), _UPPER, _LOWER), F.lit("-or-later"), F.lit(" orlater"))
    lower = F.regexp_replace(F.regexp_replace(lower, *_LISTS), *_NUMBERS)
    plain = F.regexp_replace(lower, r"[^a-z0-9.!?\n]+", " ")
    joined = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("_plain"), r" *\n( *\n)+ *", ". "), r"\n", " "), " +", " ")
    has = F.col("_text").rlike("(?i)" + "|".join(ANCHORS))
    none = F.array().cast("array<string>")
    df = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")).select(id_col, F.when(has, plain).alias("_plain"))
    df = df.select(id_col, F.coalesce(F.when(F.col("_plain").isNotNull(), _known(F.col("_plain"))), none).alias("_lines"), F.coalesce(F.when(F.col("_plain").isNotNull(), _known(joined)), none).alias("_paras"))
    sequence = lambda c: F.concat(F.lit(","), F.array_join(c, ","), F.lit(","))
    hit = lambda ids: F.contains(sequence(F.col("_lines")), F.lit("," + ",".join(ids) + ",")) | F.contains(sequence(F.col("_paras")), F.lit("," + ",".join(ids) + ","))
    by_rule = F.filter(F.array(*(F.when(hit(ids), F.lit(mark)) for (_, ids), mark in zip(RULES, _BY_RULE, strict=True))), lambda x: x.isNotNull())
    marks = F.create_map(*(F.lit(x) for pair in _BY_NAME.items() for x in pair))
    by_name = F.transform(F.filter(F.concat("_lines", "_paras"), lambda i: F.contains(i, F.lit("/"))), lambda i: F.element_at(marks, F.substring_index(i, "/", 1)))
    part = lambda x, k: F.element_at(F.split(x, "[|]"), k)
    ids = F.when(F.size("_paras") > F.size("_lines"), F.col("_paras")).otherwise(F.col("_lines"))
    df = df.select(id_col, F.size(ids).cast("long").alias("n_known"), F.array_join(ids, ",").alias("sentence_ids"), F.array_sort(F.concat(by_rule, by_name)).alias("_found"))
    return df.select(id_col, "n_known", "sentence_ids", F.array_join(F.array_distinct(F.transform("_found", lambda x: part(x, 2))), ",").alias("licences"), F.coalesce(part(F.try_element_at("_found", F.lit(1)), 3), F.lit("none")).alias("license_class"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    known = ", ".join(f"('{k}', '{s}')" for s, k in KNOWN.items())
    rules = ", ".join(f"({k}, '{licence}', ',{','.join(ids)},')" for k, (licence, ids) in enumerate(RULES))
    licences = ", ".join(f"({len(RULES) + k}, '{licence}', '{kind}')" for k, (licence, kind, _) in enumerate(LICENCES))
    lists, numbers = (x[0].replace("'", "''") for x in (_LISTS, _NUMBERS))
    return f"""
WITH known(id, sentence) AS (VALUES {known}), rules(rank, licence, ids) AS (VALUES {rules}), licences(rank, licence, class) AS (VALUES {licences}),
d AS (SELECT row_number() OVER () AS r, doc_id, replace(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '-or-later', ' orlater') AS t FROM documents),
t AS (SELECT r, regexp_replace(regexp_replace(regexp_replace(t, '{lists}', '.\\1', 'g'), '{numbers}', '\\1', 'g'), '[^a-z0-9.!?\n]+', ' ', 'g') AS t FROM d),
b AS (SELECT r, 0 AS way, t FROM t UNION ALL SELECT r, 1, regexp_replace(regexp_replace(regexp_replace(t, ' *\n( *\n)+ *', '. ', 'g'), '\n', ' ', 'g'), ' +', ' ', 'g') FROM t),
c AS (SELECT r, way, unnest(s) AS s, unnest(range(len(s))) AS i FROM (SELECT r, way, regexp_split_to_array(t, '[.!?]+( |\n|$)|\n') AS s FROM b)),
e AS (SELECT r, way, i, unnest(p) AS s, unnest(range(len(p))) AS j FROM (SELECT r, way, i, CASE WHEN trim(s, ' ') LIKE '{SPDX}%' THEN list_transform(regexp_split_to_array(substr(trim(s, ' '), {len(SPDX) + 1}), ' (or|and|with) '), lambda x: '{SPDX}' || trim(x, ' ')) ELSE [trim(s, ' ')] END AS p FROM c)),
f AS (SELECT r, way, id, i, j FROM e JOIN known ON sentence = s),
w AS (SELECT r, way, count(*) AS n, string_agg(id, ',' ORDER BY i, j) AS ids FROM f GROUP BY r, way),
m AS (SELECT r, coalesce(max(n), 0) AS n, arg_max(ids, n * 2 - way) AS ids FROM w GROUP BY r),
hits AS (SELECT r, rules.rank, rules.licence FROM w JOIN rules ON contains(',' || w.ids || ',', rules.ids) UNION ALL SELECT r, rank, licence FROM f JOIN licences ON id LIKE '%/%' AND split_part(id, '/', 1) = licence),
least AS (SELECT r, licence, min(rank) AS rank FROM hits GROUP BY r, licence),
found AS (SELECT r, string_agg(licence, ',' ORDER BY rank) AS licences, arg_min(licence, rank) AS first FROM least GROUP BY r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_known, coalesce(ids, '') AS sentence_ids, coalesce(found.licences, '') AS licences, coalesce(class, 'none') AS license_class
FROM d LEFT JOIN m USING (r) LEFT JOIN found USING (r) LEFT JOIN licences ON licences.licence = first
"""


SQL = _sql()
