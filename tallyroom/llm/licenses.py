"""Operator 8: licence scan by canonical digests.

A text is brought to a canonical form: lower case, copyright and title lines
dropped, punctuation and white space made one space, equivalent spellings made
one. The SHA-256 of the canonical form of an entire text is joined to the
digests of the known licences. Known licences come as a table (license_id,
text, digest): short texts stand here as text, long ones by the digest of
their canonical form (`digests_of` makes such rows from files). The same join on
single lines, of which none is dropped, finds notices inside longer documents.

Defined results: null and empty texts have the digest of the empty text and
match nothing, also where a known text is empty; where known texts have equal
canonical forms, the smallest license_id counts; each row of the documents
gives one row, also where rows repeat; a text counts whole, however long; an
empty table gives an empty table; input columns named as a result column are
replaced, all others pass through. Only digests are shuffled, and no text.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_clashes, slices, stage

# Equivalent spellings (word, the word it stands for).
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"),
    ("cancelled", "canceled"), ("catalogue", "catalog"), ("centre", "center"), ("copyright owner", "copyright holder"), ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"), ("licenced", "licensed"), ("maximise", "maximize"), ("modelled", "modeled"),
    ("modelling", "modeling"), ("noncommercial", "non commercial"), ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"), ("programme", "program"),
    ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"), ("sublicence", "sublicense"), ("sub license", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("https", "http"), ("per cent", "percent"),
)

# Notices that stand on a line of their own.
NOTICES = (
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."), ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."), ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."), ("Proprietary", "All rights reserved."),
)

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_AS_IS_SHORT = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_NO_LIABILITY = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'


def _bulleted(terms: str) -> str:
    return re.sub(r"(?m)^\d\. ", "* ", terms)


# Entire public licence texts.
LICENSES = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _AS_IS),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _NO_LIABILITY),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _NO_LIABILITY),
    ("BSD-2-Clause", _BSD + _BSD_END), ("BSD-3-Clause", _BSD + _BSD3 + _BSD_END),
    ("BSD-2-Clause", _bulleted(_BSD) + _BSD_END), ("BSD-3-Clause", _bulleted(_BSD + _BSD3) + _BSD_END),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
    ("MIT-0", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.\n\n" + _AS_IS),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n" + _AS_IS_SHORT + "\n\nFor more information, please refer to <https://unlicense.org/>"),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n" + _AS_IS_SHORT),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004\n\nEveryone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.\n\nDO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n\n0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("X11", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE X CONSORTIUM BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nExcept as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the X Consortium."),
)

# Digests of the canonical forms of long public licences.
DIGESTS = (
    ("Apache-2.0", "4580e5390400d27df89edd0617548ac0e66eaa029f6e07cf98aac9cd100b3a37"),
    ("Apache-2.0", "67e6c9864a42fc797b7f0244a9e5402dbe5d51fd1cbfdbca4f454f8892ab077d"),
    ("Apache-2.0", "0b8c1a9e0ec99ab3b27e123e667fe4843df4dd7e6c667ccdc634dd6878c5dd6c"),
    ("Artistic-1.0", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GPL-1.0", "ec8a6b7d70e9f225b63d3962ed5b4721373f5535d7b967a06722b0d621f6892a"),
    ("GPL-1.0", "af30c0af27b90ec812acdb040f3dcc944a87cd893456690efe35063f39e3eeeb"),
    ("GPL-1.0", "74d0cd23803c9754c36f6ca0e1af411b418ed6b6564e757472bf0d870a1b5d1b"),
    ("GPL-2.0", "331b500eb3c5ee796906547305df82fff4a35b3aa03c1d3ea84d32078292b2e6"),
    ("GPL-2.0", "c67cc53030ae25fe2e2f0143b59060eca5ad89da8d2beca1445641234d29fc88"),
    ("GPL-2.0", "1551b61aa183f987ecceedd8966ec1e9b2da3848f8862c2adedc0d82f41904ca"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("GPL-3.0", "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0", "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6"),
    ("MPL-2.0", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
    ("MPL-2.0", "2cec6f733aa157c2d0b72e9669f75ca354f332218fcb5a3a885931f385272a04"),
    ("CC0-1.0", "a142ae38742c8c4c35f5fa19e0a40ebfa60fc38535daf9c570ca3d7e012e1e32"),
    ("Apache-2.0 WITH LLVM-exception", "b2de461c4fdb30b132aea95bc17cbd6d498477c19fc1f84cee5f08e49b9a9148"),
    ("Unicode-3.0", "53113a39b79251016cf92b8348f303cee44e4faee1f232536754abc669dd32c8"),
)

#: Lines that carry names and years, not terms.
COPYRIGHT_LINE = r"^[ \t#*/;-]*(copyright[ \t]*(\(c\)|©|:|[0-9<\[{]|by ).*|copyright\b.*\b(19|20)[0-9][0-9]\b.*|copyright .*\b(authors|contributors|developers|foundation|inc|llc|ltd|gmbh|corporation|university)\b\.?( all rights reserved\.?)?[ \t*/#]*|\(c\).*|©.*|copr\..*|portions copyright.*|all rights reserved\.?[ \t*/#]*|spdx-license-identifier.*)$"
TITLE_LINE = r"^[ \t#*/;-]*(the )?(mit|isc|zlib|bsd|simplified bsd|new bsd|modified bsd|0bsd|zero-clause bsd|2-clause bsd|3-clause bsd|bsd 2-clause|bsd 3-clause|bsd zero clause)( \"?(simplified|new|revised|modified)\"?)? (license|licence)( \((mit|isc|zlib|bsd|0bsd|expat)\))?:?[ \t]*$"

_drop = re.compile(f"({COPYRIGHT_LINE})|({TITLE_LINE})")
#: What a line that can be dropped holds: lines without any of these need no closer look.
_marks = re.compile(r"copyr|copr\.|\(c\)|©|reserved|spdx|licen[cs]e")
_word = re.compile(r"[^\W_]+")
_one = {a: b for a, b in SPELLINGS if " " not in a}
_two = sorted((f" {a} ", f" {b} ") for a, b in SPELLINGS if " " in a)


def _pairs(form: str) -> str:
    """The form with spellings of two words made one; neighbours share no space."""
    for a, b in _two:
        if a.strip() in form:
            form = f" {form} ".replace(" ", "  ").replace(a.replace(" ", "  ")[1:-1], b.replace(" ", "  ")[1:-1]).replace("  ", " ").strip()
    return form


def canonical_forms(text: str | None) -> tuple[str, list[str]]:
    """The canonical form of an entire text and those of its lines."""
    t = (text or "").lower()
    if "\r" in t:
        t = t.replace("\r\n", "\n").replace("\r", "\n")
    raw = t.split("\n")
    find, same = _word.findall, _one.get
    lines = [" ".join([same(w, w) for w in find(x)]) for x in raw]
    if _marks.search(t):
        kept = [f for x, f in zip(raw, lines) if f and not (_marks.search(x) and _drop.match(x))]
    else:
        kept = [f for f in lines if f]
    return _pairs(" ".join(kept)), [_pairs(f) for f in lines]


def digest(form: str) -> str:
    return hashlib.sha256(form.encode()).hexdigest()


def digests_of(texts: dict[str, str]) -> list[tuple[str, str]]:
    """(license_id, digest) of entire texts, and of each less what follows its terms (the end mark, how to apply them)."""
    out = []
    for name, text in texts.items():
        whole = [text]
        for at in re.finditer(r"(?i)end of terms and conditions|(appendix:\s*)?how to apply (these terms|the apache license) to your", text):
            whole += [text[: at.start()], text[: at.end()]] if at[0][0] in "eE" else [text[: at.start()]]
        out += [(name, digest(canonical_forms(t)[0])) for t in whole]
    return list(dict.fromkeys(out))


def known_licenses(spark: SparkSession, extra: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    rows = [(*r, None) for r in (*LICENSES, *NOTICES, *extra)] + [(a, None, d) for a, d in DIGESTS]
    return spark.createDataFrame(rows, "license_id string, text string, digest string")


def _digests(batches, columns: list[str], text: str):
    for batch in batches:
        for part in slices(batch, text):
            found = [digest(canonical_forms(t)[0]) for t in part.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(found, pa.string())], names=[*columns, "digest"])


def _line_digests(batches, columns: list[str], text: str):
    """A row for each line with a word: the given columns, its position and its digest."""
    for batch in batches:
        for part in slices(batch, text):
            row, pos, found = [], [], []
            for k, t in enumerate(part.column(text).to_pylist()):
                for j, form in enumerate(canonical_forms(t)[1]):
                    if form:
                        row.append(k)
                        pos.append(j)
                        found.append(digest(form))
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in columns), pa.array(pos, pa.int64()), pa.array(found, pa.string())], names=[*columns, "__pos", "__d"])


def scan_licenses(docs: DataFrame, known: DataFrame, *, text: str = "text") -> DataFrame:
    """docs with digest, license_id (of the entire text, null if unknown), n_notices (lines that are a known text) and notices (their ids, sorted, once each, joined by commas)."""
    docs = drop_clashes(docs, ["digest", "license_id", "n_notices", "notices"])
    listed = known.where("license_id IS NOT NULL").select("license_id", "text", F.col("digest").alias("known") if "digest" in known.columns else F.lit(None).cast("string").alias("known"))
    formed = listed.mapInArrow(lambda it: _digests(it, ["license_id", "known"], "text"), "license_id string, known string, digest string")
    formed = formed.select("license_id", F.coalesce("known", "digest").alias("__d"))
    single = listed.where("known IS NULL").mapInArrow(lambda it: _line_digests(it, ["license_id", "text"], "text"), "license_id string, text string, __pos long, __d string")
    single = single.where(~F.col("text").contains("\n")).select("license_id", "__d")

    def table(rows: DataFrame) -> DataFrame:
        return stage(rows.where(F.col("__d") != F.sha2(F.lit(b""), 256)).groupBy("__d").agg(F.min("license_id").alias("__id")))

    keys = {"__t1": F.xxhash64(F.lit(8), text), "__t2": F.xxhash64(F.col(text), F.lit(8))}
    lines = docs.select(F.col(text).alias("__text")).withColumns({"__t1": F.xxhash64(F.lit(8), "__text"), "__t2": F.xxhash64(F.col("__text"), F.lit(8))})
    lines = lines.mapInArrow(lambda it: _line_digests(it, ["__t1", "__t2"], "__text"), "__t1 long, __t2 long, __pos long, __d string")
    hits = lines.join(table(single), "__d").groupBy(*keys).agg(F.collect_set(F.struct("__pos", "__id")).alias("__hits"))
    keyed = docs.withColumns(keys)
    names = [c for c in keyed.columns if c != text]
    own = keyed.mapInArrow(lambda it: _digests(it, [*names, text], text), T.StructType([*(keyed.schema[c] for c in [*names, text]), T.StructField("digest", T.StringType())]))
    own = own.join(table(formed), F.col("digest") == F.col("__d"), "left").join(hits, list(keys), "left")
    ids = F.array_sort(F.array_distinct(F.transform("__hits", lambda h: h["__id"])))
    return own.select(*docs.columns, "digest", F.col("__id").alias("license_id"), F.coalesce(F.size("__hits"), F.lit(0)).cast("long").alias("n_notices"), F.coalesce(F.array_join(ids, ","), F.lit("")).alias("notices"))
