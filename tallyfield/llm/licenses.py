"""Licence scans by sentence rules: known sentences get ids, ordered ids give a licence.

A text is normalised, with a mark kept at every sentence end and line break. A known licence
sentence is found where its words follow each other, whatever signs, comment marks and line
breaks stand between, and where it begins and ends at a mark: on one line, wrapped, or
with a colon or a blank line inside. A rule is a sequence of sentence ids; it holds where they follow each other in the
text in that order, other sentences between them or not. Rules are tried in their order: the
more sentences a rule asks for, the earlier it stands, and a sentence that an earlier
rule has used does not count for a later one.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, lower_ascii, text_of

#: Known licence sentences, normalised, by id.
SENTENCES = {
    "mit-released": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache-2-licensed": "licensed under the apache license version 2 0",
    "apache-2-use": "you may not use this file except in compliance with the license",
    "apache-2-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "gpl-3-work": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "cc-by-4": "licensed under cc by 4 0",
    "cc-by-sa-4": "licensed under cc by sa 4 0",
    "cc-by-nc-4": "licensed under cc by nc 4 0",
    "bsd-terms": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-warranty": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "zlib-warranty": "this software is provided as is without any express or implied warranty",
    "zlib-liability": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "unlicense-release": "this is free and unencumbered software released into the public domain",
    "unlicense-free": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "cc0-deed": "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law including all related and neighboring rights to the extent allowed by law",
    "mpl-2-subject": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "gpl-2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "lgpl-21-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl-3-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "bsl-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
}
#: Other wordings of known sentences, normalised, and the ids of what they say.
WORDINGS = {
    "licensed under the apache license version 2 0 the license": ("apache-2-licensed",),
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": ("apache-2-licensed", "apache-2-use"),
    "you may obtain a copy of the license at https www apache org licenses license 2 0": ("apache-2-copy",),
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": ("mpl-2-copy",),
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": ("lgpl-3-free",),
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software": ("zlib-warranty", "zlib-liability"),
}
#: Licence and the ids that its rule asks for, in order.
RULES = [
    ("BSD-3-Clause", ("bsd-terms", "bsd-source", "bsd-binary", "bsd-names")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("Zlib", ("zlib-warranty", "zlib-liability", "zlib-grant")),
    ("BSD-2-Clause", ("bsd-terms", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache-2-licensed", "apache-2-use", "apache-2-copy")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-warranty")),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("Unlicense", ("unlicense-release", "unlicense-free")),
    ("MPL-2.0", ("mpl-2-subject", "mpl-2-copy")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-2.0-or-later", ("gpl-2-free",)),
    ("LGPL-2.1-or-later", ("lgpl-21-free",)),
    ("LGPL-3.0-or-later", ("lgpl-3-free",)),
    ("AGPL-3.0-or-later", ("agpl-3-free",)),
    ("BSL-1.0", ("bsl-grant",)),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant",)),
    ("Unlicense", ("unlicense-release",)),
    ("MPL-2.0", ("mpl-2-subject",)),
    ("CC0-1.0", ("cc0-deed",)),
    ("GPL-3.0-only", ("gpl-3-work",)),
    ("Apache-2.0", ("apache-2-licensed",)),
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-licensed",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
]
#: SPDX identifiers of common licences and the names, normalised, that notices give them.
NAMES = {
    "MIT": ("mit license",), "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache 2 0 license"), "BSD-2-Clause": ("bsd 2 clause license", "simplified bsd license"),
    "BSD-3-Clause": ("bsd 3 clause license", "new bsd license", "modified bsd license"), "ISC": ("isc license",), "Zlib": ("zlib license",), "0BSD": ("zero clause bsd license",),
    "GPL-2.0-only": ("gnu general public license version 2", "gnu general public license v2 0", "gnu gpl version 2 license"), "GPL-3.0-only": ("gnu general public license version 3", "gnu general public license v3 0", "gnu gpl version 3 license"),
    "GPL-2.0-or-later": ("gnu general public license version 2 or later", "gnu general public license v2 0 or later"), "GPL-3.0-or-later": ("gnu general public license version 3 or later", "gnu general public license v3 0 or later"),
    "LGPL-2.1-only": ("gnu lesser general public license version 2 1",), "LGPL-3.0-only": ("gnu lesser general public license version 3",),
    "LGPL-2.1-or-later": ("gnu lesser general public license version 2 1 or later",), "LGPL-3.0-or-later": ("gnu lesser general public license version 3 or later",),
    "AGPL-3.0-only": ("gnu affero general public license version 3",), "AGPL-3.0-or-later": ("gnu affero general public license version 3 or later",),
    "MPL-1.1": ("mozilla public license version 1 1",), "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license 2 0"), "EPL-1.0": ("eclipse public license version 1 0", "eclipse public license 1 0"),
    "EPL-2.0": ("eclipse public license version 2 0", "eclipse public license 2 0"), "CDDL-1.0": ("common development and distribution license version 1 0",), "CPL-1.0": ("common public license version 1 0",),
    "EUPL-1.2": ("european union public license version 1 2", "european union public licence version 1 2"), "BSL-1.0": ("boost software license version 1 0", "boost software license 1 0"),
    "Artistic-2.0": ("artistic license 2 0", "artistic license version 2 0"), "PostgreSQL": ("postgresql license",), "Python-2.0": ("python software foundation license version 2",), "PHP-3.01": ("php license version 3 01",),
    "Unlicense": ("unlicense",), "WTFPL": ("do what the fuck you want to public license",), "CC0-1.0": ("cc0 1 0 universal license", "creative commons zero v1 0 universal license"),
    "CC-BY-3.0": ("creative commons attribution 3 0 unported license",), "CC-BY-4.0": ("creative commons attribution 4 0 international license",), "CC-BY-SA-3.0": ("creative commons attribution sharealike 3 0 unported license",),
    "CC-BY-SA-4.0": ("creative commons attribution sharealike 4 0 international license",), "CC-BY-NC-4.0": ("creative commons attribution noncommercial 4 0 international license",),
    "CC-BY-ND-4.0": ("creative commons attribution noderivatives 4 0 international license",), "CC-BY-NC-SA-4.0": ("creative commons attribution noncommercial sharealike 4 0 international license",),
    "CC-BY-NC-ND-4.0": ("creative commons attribution noncommercial noderivatives 4 0 international license",), "OFL-1.1": ("sil open font license version 1 1",), "MS-PL": ("microsoft public license",),
    "MS-RL": ("microsoft reciprocal license",), "NCSA": ("university of illinois ncsa open source license",), "OSL-3.0": ("open software license version 3 0",), "AFL-3.0": ("academic free license version 3 0",),
    "UPL-1.0": ("universal permissive license version 1 0",), "ECL-2.0": ("educational community license version 2 0",), "BlueOak-1.0.0": ("blue oak model license 1 0 0",), "MulanPSL-2.0": ("mulan permissive software license version 2",),
}
#: What stands before such a name in a notice.
OPENINGS = (
    "licensed under the", "released under the", "distributed under the", "this work is licensed under the", "this work is licensed under a", "this work is licensed under", "this project is licensed under the",
    "this software is licensed under the", "this program is licensed under the", "this file is licensed under the", "this library is licensed under the", "this code is licensed under the",
)
for _id, _names in NAMES.items():
    # an identifier is the sentence, its notices are other wordings of it
    SENTENCES[f"named-{_id}"] = f"spdx license identifier {re.sub('[^a-z0-9]+', ' ', _id.lower())}"
    RULES.append((_id, (f"named-{_id}",)))
for _id, _names in NAMES.items():
    WORDINGS |= {_s: (f"named-{_id}",) for _s in (f"{_o} {_n}" for _o in OPENINGS for _n in _names) if _s not in WORDINGS and _s not in SENTENCES.values()}
#: Every known sentence has one of these words, so a text without them needs no cutting.
MARK = "(?i)licen[cs]|permi|software|distribut|warrant|copyright"
#: A known sentence may begin and end where . ! ? or : stands before white space, and at every line break.
ENDS = r"[.!?:]+[ \t\r]|[\n\x0B\f]"


def normal(text: Column) -> Column:
    """Lower-case ASCII letters and digits; one line break where sentences may end, first and last too, and one space for everything else."""
    marked = F.regexp_replace(F.concat(F.lit("\n"), lower_ascii(text), F.lit("\n")), ENDS, "\n")
    return F.regexp_replace(F.regexp_replace(marked, "[^a-z0-9\n]+", " "), " ?\n[ \n]*", "\n")


def known_pattern(sentences: Iterable[str]) -> str:
    """A pattern for any of the sentences in a normal text, the longest first."""
    longest = sorted(sentences, key=len, reverse=True)
    return "(?<=\n)(?:" + "|".join(s.replace(" ", "[ \n]") for s in longest) + ")(?=\n)"


def holding(ids: list[str]) -> list[str]:
    """The licences whose rules hold for the ids of a text.

    For each rule one pass: the next id that the rule waits for is taken where it first comes; once all have come they are used up, and the rule
    begins anew behind them.
    """
    left, found = ids, []
    for name, rule in RULES:
        if not set(rule) <= set(left):
            continue
        used, waiting = set(), []
        for at, i in enumerate(left):
            if i == rule[len(waiting)]:
                waiting.append(at)
                if len(waiting) == len(rule):
                    used.update(waiting)
                    waiting = []
        if used:
            found.append(name)
            left = [i for at, i in enumerate(left) if at not in used]
    return list(dict.fromkeys(found))


def recognised(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, sentence_ids, n_sentences, licenses; one row for every row.

    sentence_ids: the ids of known sentences in the order of the text, comma-joined;
    n_sentences their number; licenses: the licences whose rules hold, in the order of
    the rules, each once, comma-joined.

    Null and empty texts have none. Texts are read whole, however many sentences they hold. Null ids and repeated rows
    stay. Ties, such as one text that holds for two rules, go to the earlier rule. An empty table gives an empty result. Other
    columns are not looked at, whatever their names.
    """
    text = text_of()
    wordings = {v: (k,) for k, v in SENTENCES.items()} | WORDINGS
    known = F.create_map(*[x for s, ids in wordings.items() for x in (F.lit(s), F.array(*map(F.lit, ids)))])
    met = F.regexp_extract_all(normal(text), F.lit(known_pattern(wordings)), F.lit(0))
    said = F.flatten(F.transform(met, lambda s: known[F.translate(s, "\n", " ")]))
    ids = F.when(text.rlike(MARK), said).otherwise(F.array().cast("array<string>"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(1).to_pylist()
            columns = [[",".join(i) for i in held], list(map(len, held)), [",".join(holding(i)) if i else "" for i in held]]
            arrays = [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string()), strict=True)]]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "sentence_ids", "n_sentences", "licenses"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    with batches_of(docs.sparkSession):
        return docs.select(F.col("doc_id"), ids.alias("ids")).mapInArrow(judge, f"doc_id {kind}, sentence_ids string, n_sentences long, licenses string")
