"""License scans: the digest of a canonical text is looked up among those of known licences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import once

# Known licence texts and notices. Their wording is the licences' own.
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "GPL-3.0-only": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
}
TITLES = {"MIT": ["", "MIT License", "The MIT License", "The MIT License (MIT)"], "ISC": ["", "ISC License"], "0BSD": ["", "Zero-Clause BSD", "BSD Zero Clause License"],
          "BSD-2-Clause": ["", "BSD 2-Clause License"], "BSD-3-Clause": ["", "BSD 3-Clause License"]}
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{third}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": BSD.format(third=""),
    "BSD-3-Clause": BSD.format(third="\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"),
}
# Licences too long to print here, by the MD5 digest, the length and the first word of their canonical form; the whole text, and
# where there is an appendix on how to apply it, the text up to the end of its terms. Made by ``digests`` from the texts that a
# Debian system keeps in /usr/share/common-licenses.
DIGESTS = [
    ("Apache-2.0", "77e1a2c8e9671a8095fa8108104daeae", 9882, "apache"),
    ("Apache-2.0", "2907559bf696d33fdfdc7da57023e979", 8838, "apache"),
    ("Apache-2.0", "d44d7dd7bb33c43e91c9d5e48b1d489e", 8866, "apache"),
    ("Artistic-1.0-Perl", "a8b0fb0c6e43a3b36bdc159e59dbfd1e", 5833, "the"),
    ("CC0-1.0", "93a180096f6cfcf2c0dd24f75c2eec48", 6692, "creative"),
    ("GFDL-1.2", "7a0a547ecac612b526676be523eacf80", 19583, "gnu"),
    ("GFDL-1.3", "7132e8380bc59358f27c3129a2136bf1", 22018, "gnu"),
    ("GPL-1.0", "6c44f968a690a3e902f11333ecd8e064", 11703, "gnu"),
    ("GPL-1.0", "f9bdbdf2be484ced90e5d8d884a7bed9", 9388, "gnu"),
    ("GPL-1.0", "78f3b35da3d393ee93ecfeb7d20907e6", 9416, "gnu"),
    ("GPL-2.0", "8e4925da11f68cc625b11b0a628fdcc5", 17118, "gnu"),
    ("GPL-2.0", "b73af68d56407814bb0960dcc4125f3d", 14456, "gnu"),
    ("GPL-2.0", "42f2f51f3e726d001525877e3528c3d0", 14484, "gnu"),
    ("GPL-3.0", "893b546131650d9a719d89640734881d", 33336, "gnu"),
    ("GPL-3.0", "23151dc8ae9f8042b7aa47fd209754e1", 30870, "gnu"),
    ("GPL-3.0", "b8acc12664436f494f82c29349f2a2b5", 30898, "gnu"),
    ("LGPL-2.0", "543c19e388c6e446f590fe18d12f757d", 24067, "gnu"),
    ("LGPL-2.0", "97832943be1e344d51af5aee1b658e4f", 22249, "gnu"),
    ("LGPL-2.0", "c396ba2f94537628797123bc12cd2d6e", 22277, "gnu"),
    ("LGPL-2.1", "b0e7e38dcad323959e0a8b93558f57d3", 25154, "gnu"),
    ("LGPL-2.1", "eaf6afb73fc860a002bfbccbe6f07ce7", 23337, "gnu"),
    ("LGPL-2.1", "3054b3781b1af43f906dc753acad15ee", 23365, "gnu"),
    ("LGPL-3.0", "b31b7335bc37919e8cdd79154e04d88d", 7104, "gnu"),
    ("MPL-1.1", "4ed6600fcf5321eb9dcd2181cde18632", 22447, "mozilla"),
    ("MPL-2.0", "b5b7a0cf4994910cd0204fba4637d6ec", 14341, "mozilla"),
    ("BSD-3-Clause-UC", "ddcd765ed0a3236bf96e15f76c36983a", 1361, "redistribution"),
]
# Spellings that count as equal.
SPELLINGS = {
    "licence": "license", "licenced": "licensed", "sublicence": "sublicense", "organisation": "organization", "organisations": "organizations",
    "authorised": "authorized", "favour": "favor", "favourable": "favorable", "honour": "honor", "labour": "labor", "programme": "program",
    "recognised": "recognized", "utilisation": "utilization", "fulfil": "fulfill", "merchantibility": "merchantability", "noncommercial": "non commercial",
    "acknowledgement": "acknowledgment", "judgement": "judgment", "whilst": "while", "https": "http", "v2": "version 2", "v3": "version 3",
}
# A copyright line, and a line of a licence's own wording that begins with that word.
COPYRIGHT = r"(?i)^[^a-z0-9]*(?:copyright\b|\(c\)\s*(?:copyright\b|[0-9])|©|all rights reserved[^a-z0-9]*$)"
WORDING = r"(?i)^[^a-z0-9]*copyright\s+(?:holders?|owners?|notices?|licen[cs]es?|laws?|and|or|in|on|is|of|for|to|as|interests?|statements?|terms?|treaty|disclaimers?|status|protection)\b"


def spelled(text: str) -> str:
    return " ".join(SPELLINGS.get(w, w) for w in text.split(" "))


def dropped(line: F.Column) -> F.Column:
    return line.rlike(COPYRIGHT) & ~line.rlike(WORDING)


def canonical(line: F.Column) -> F.Column:
    """Words of ASCII letters and digits in lower case, parted by single spaces; nothing of a copyright line."""
    words = F.trim(F.lower(F.regexp_replace(line, "[^A-Za-z0-9]+", " ")))
    return F.when(dropped(line), "").otherwise(words)


def whole(lines: F.Column) -> F.Column:
    """The canonical form of an entire text is that of its lines, one after the other."""
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def respelled(words: F.Column) -> F.Column:
    """One spelling for each of the equivalent ones, in a canonical text."""
    out = F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" "))
    for a, b in SPELLINGS.items():
        out = F.replace(out, F.lit(f" {a} "), F.lit(f" {b.replace(' ', '  ')} "))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def plain(text: str) -> str:
    """The canonical form of a whole text, in Python: for the table of known digests."""
    import re

    lines = [x for x in text.split("\n") if not re.match(COPYRIGHT, x) or re.match(WORDING, x)]
    return spelled(spelled(re.sub("[^A-Za-z0-9]+", " ", " ".join(lines)).lower().strip()))


def digests(texts: list[tuple[str, str]]) -> list[tuple[str, str, int, str]]:
    """``(license_id, digest, length, first)`` of the canonical form of each text; first is its first word."""
    from hashlib import md5

    return [(name, md5(c.encode()).hexdigest(), len(c), c.split(" ")[0]) for name, c in ((name, plain(text)) for name, text in texts)]


def listed(extra: dict[str, list[str]] | None = None) -> list[tuple[str, str, int, str]]:
    """The known licences with those in ``extra``, each digest once; a digest of two licences has the first id."""
    titled = [(k, f"{title}\n{t}") for k, t in TEXTS.items() for title in TITLES[k]]
    texts = [(k, t) for k, v in NOTICES.items() for t in v] + titled + [(k, t) for k, v in (extra or {}).items() for t in v]
    found: dict[str, tuple[str, str, int, str]] = {}
    for row in sorted([*DIGESTS, *digests(texts)]):
        found.setdefault(row[1], row)
    return list(found.values())


KNOWN = "license_id string, digest string, length int, first string"


def known(spark, extra: dict[str, list[str]] | None = None) -> DataFrame:
    """``(license_id, digest, length, first)`` of the known licences and those in ``extra``."""
    return spark.createDataFrame(listed(extra), KNOWN)


def first_word(text: F.Column) -> F.Column:
    return F.lower(F.regexp_extract(text, "[A-Za-z0-9]+", 0))


def scan(docs: DataFrame, extra: dict[str, list[str]] | None = None, table: DataFrame | None = None) -> DataFrame:
    """Licences in documents: ``(doc_id, unit, line, license_id)``.

    A text is a licence if its canonical form has the digest of a known one: the entire document (unit 'document', line
    null), or an entire line of it (unit 'line', line from 0), such as a notice. The known licences are a short list that
    is part of the program (with ``extra``, texts of the caller's), or the rows of ``table(license_id, digest, length, first)``, as
    ``digests`` makes them. Up to 100,000 of them are broadcast; beyond that the join is by digest. Documents are not shuffled.

    Only texts that begin with the first word of a known one, or with a spelling of it, can be equal to it: the canonical
    form of others is not made. A document of one line gives both units. Null and empty texts, and lines without words, match
    nothing. Texts of any length are read whole. Repeated rows are returned each. A null doc_id is returned as null. An empty
    table gives none. Extra columns are ignored.
    """
    rows = listed(extra) if table is None else None
    table = known(docs.sparkSession, extra) if table is None else table.select("license_id", "digest", "length", "first")
    few = rows is not None or table.count() <= 100_000
    firsts = {r[3] for r in rows} if rows else {r.first for r in table.select("first").distinct().toLocalIterator()}
    begins = sorted(firsts | {a for a, b in SPELLINGS.items() if b.split(" ")[0] in firsts})
    if not begins:
        return docs.sparkSession.createDataFrame([], "doc_id long, unit string, line int, license_id string")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n").alias("lines"))
    each = base.select("doc_id", F.posexplode("lines").alias("line", "x")).where(first_word(F.col("x")).isin(begins))
    each = once(each.select("doc_id", F.lit("line").alias("unit"), "line", "x"), c=canonical(F.col("x")))
    head = F.get(F.filter("lines", lambda x: x.rlike("[A-Za-z0-9]") & ~dropped(x)), F.lit(0))
    entire = base.where(first_word(head).isin(begins)).select("doc_id", F.lit("document").alias("unit"), F.lit(None).cast("int").alias("line"), "lines")
    entire = once(entire, c=whole(F.transform("lines", canonical)))
    units = each.drop("x").unionByName(entire.drop("lines")).select("doc_id", "unit", "line", F.md5(respelled(F.col("c")).cast("binary")).alias("digest"))
    table = table.select("digest", "license_id")
    return units.join(F.broadcast(table) if few else table, "digest").select("doc_id", "unit", "line", "license_id")
