"""License scans by sentence rules.

A text is cut into sentences, each sentence is normalised (lower case, runs of other characters than a-z and 0-9 become one
space) and mapped to the identifier of a known licence sentence. The identifiers, in text order, are matched against the
ordered rules of the licences: a rule holds where its identifiers occur in order, other known sentences between them
allowed. The text is cut in two ways, as licences come wrapped or not: every line end is a break, or only blank lines are.

Rules are of two kinds: phrases that name a licence (made from names and phrases), and the sentences of notices and of excerpts
of licence texts in their order. Of short licences all sentences are known, and whether a text has them all is told beside.

Only DataFrame functions run on the main path, in one pass without shuffle; the tables of sentences and rules are literals.
Whether a sentence is a known one is asked of a hash set, so the table may be long.

Defined results: null and empty texts have no sentences and no licences (empty strings); repeated sentences repeat their
identifier; rows that repeat are repeated, and a null doc_id is one like any other; a text of any length is one row; U+0001 in a
text ends a sentence; a text of signs alone, or with a million known sentences or none that ends, takes linear time; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import _base

# Identifiers of SPDX and the names that licences go by.
NAMES: dict[str, list[str]] = {
    "MIT": ["MIT License", "MIT/Expat License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 License"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3"],
    "GPL-3.0-or-later": ["GNU General Public License, version 3 or later", "GNU General Public License v3.0 or later", "GPLv3+"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2"],
    "GPL-2.0-or-later": ["GNU General Public License, version 2 or later", "GNU General Public License v2.0 or later", "GPLv2+"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPLv2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPLv3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPLv3"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"],
    "ISC": ["ISC License"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "EPL-2.0": ["Eclipse Public License, Version 2.0", "Eclipse Public License 2.0"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["CC0 1.0", "Creative Commons CC0 1.0 Universal"],
    "Unlicense": ["Unlicense"],
    "Zlib": ["zlib License"],
    "WTFPL": ["WTFPL"],
}
PHRASES = ["Released under the {}", "Licensed under the {}", "Distributed under the {}", "This project is licensed under the {}", "This project is licensed under the terms of the {}", "This work is licensed under the {}"]
#: Phrases for names that go without an article.
BARE = ["Licensed under {}", "Released under {}", "This work is licensed under a {}", "This work is licensed under {}"]

# Known sentences by licence; a rule is the order in which one licence lists them.
RULES: dict[str, list[list[str]]] = {
    "MIT": [
        ["Released under the MIT License"],
        ["Licensed under the MIT License"],
        ["This project is licensed under the terms of the MIT license"],
        ["SPDX-License-Identifier: MIT"],
        [
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
            'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
        ],
    ],
    "Apache-2.0": [
        ["Licensed under the Apache License, Version 2.0"],
        ["Released under the Apache License, Version 2.0"],
        ["SPDX-License-Identifier: Apache-2.0"],
        [
            'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License',
            "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        ],
        [
            'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License',
            "See the License for the specific language governing permissions and limitations under the License",
        ],
    ],
    "GPL-3.0": [
        ["This work is licensed under the GNU General Public License, version 3"],
        ["Licensed under the GNU General Public License, version 3"],
        ["SPDX-License-Identifier: GPL-3.0-only"],
    ],
    "GPL-3.0-or-later": [
        ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
        ["SPDX-License-Identifier: GPL-3.0-or-later"],
    ],
    "GPL-2.0-or-later": [
        ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"],
        ["SPDX-License-Identifier: GPL-2.0-or-later"],
    ],
    "LGPL-2.1-or-later": [
        ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"],
    ],
    "AGPL-3.0-or-later": [
        ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    ],
    "BSD-3-Clause": [
        [
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
            "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        ],
        ["SPDX-License-Identifier: BSD-3-Clause"],
    ],
    "BSD-2-Clause": [
        [
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
        ],
        ["SPDX-License-Identifier: BSD-2-Clause"],
    ],
    "ISC": [
        ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
        ["SPDX-License-Identifier: ISC"],
    ],
    "MPL-2.0": [
        [
            "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
            "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
        ],
        ["SPDX-License-Identifier: MPL-2.0"],
    ],
    "CC-BY-NC-4.0": [["Licensed under CC BY-NC 4.0"], ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"]],
    "CC-BY-4.0": [["Licensed under CC BY 4.0"], ["This work is licensed under a Creative Commons Attribution 4.0 International License"]],
    "CC-BY-SA-4.0": [["Licensed under CC BY-SA 4.0"], ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"]],
    "CC0-1.0": [["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"], ["SPDX-License-Identifier: CC0-1.0"]],
    "Unlicense": [["This is free and unencumbered software released into the public domain"]],
    "Zlib": [["Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software", "This notice may not be removed or altered from any source distribution"]],
    "All-Rights-Reserved": [["All rights reserved"]],
}

# Excerpts of licence texts, sentences that stand in this order and tell one licence from another.
EXCERPTS: dict[str, list[str]] = {
    "MIT": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    ],
    "Apache-2.0": [
        "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
        '"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document',
        '"Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License',
        '"You" (or "Your") shall mean an individual or Legal Entity exercising permissions granted by this License',
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form",
        "This License does not grant permission to use the trade names, trademarks, service marks, or product names of the Licensor, except as required for reasonable and customary use in describing the origin of the Work and reproducing the content of the NOTICE file",
        "END OF TERMS AND CONDITIONS",
    ],
    "GPL-3.0": [
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works",
        "The licenses for most software and other practical works are designed to take away your freedom to share and change the works",
        '"This License" refers to version 3 of the GNU General Public License',
    ],
    "GPL-2.0": [
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed",
        "The licenses for most software are designed to take away your freedom to share and change it",
        "By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users",
        "This License applies to any program or other work which contains a notice placed by the copyright holder saying it may be distributed under the terms of this General Public License",
    ],
    "LGPL-3.0": [
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed",
        "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below",
        'As used herein, "this License" refers to version 3 of the GNU Lesser General Public License, and the "GNU GPL" refers to version 3 of the GNU General Public License',
    ],
    "AGPL-3.0": [
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed",
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software",
        '"This License" refers to version 3 of the GNU Affero General Public License',
    ],
    "MPL-2.0": [
        '"Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software',
        '"Covered Software" means Source Code Form to which the initial Contributor has attached the notice in Exhibit A, the Executable Form of such Source Code Form, and Modifications of such Source Code Form, in each case including portions thereof',
        '"Larger Work" means a work that combines Covered Software with other material, in a separate file or files, that is not Covered Software',
        '"License" means this document',
    ],
    "BSD-3-Clause": [
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',
    ],
    "ISC": [
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS',
    ],
    "BSL-1.0": [
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    ],
    "WTFPL": ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE", "You just DO WHAT THE FUCK YOU WANT TO"],
}

# All sentences of short licences, from the grant to the end, in their order.
WHOLE: dict[str, list[str]] = {
    "MIT": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS',
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty",
        "In no event will the authors be held liable for any damages arising from the use of this software",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software",
        "If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software",
        "This notice may not be removed or altered from any source distribution",
    ],
    "BSL-1.0": [
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT',
        "IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain",
        "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors",
        "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
        "IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    ],
    "WTFPL": [
        "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
        "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed",
        "TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION",
        "You just DO WHAT THE FUCK YOU WANT TO",
    ],
}
WHOLE["BSD-3-Clause"] = [*WHOLE["BSD-2-Clause"][:3], "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", *WHOLE["BSD-2-Clause"][3:]]

for _name in [*NAMES, *EXCERPTS]:
    RULES.setdefault(_name, [])
for _name, _own in NAMES.items():
    RULES[_name] += [[f"SPDX-License-Identifier: {_name}"], *([p.format(n)] for n in _own for p in (*PHRASES, *BARE))]
for _name, _text in EXCERPTS.items():
    RULES[_name].append(_text)

#: Marks a break between sentences.
MARK = "\x01"
#: Ends of sentences, with every line end, and with blank lines only; the same in Java and RE2.
LINES = r"[.!?]+[ \t\r]*\n|[.!?]+[ \t\r]+|\n"
FLOW = r"[.!?]+[ \t\r]*\n|[.!?]+[ \t\r]+|\n[ \t\r]*\n"
#: In lower-cased text capitals are free: one stands for a break of FLOW, one for a line end. FLOW again, as Java finds it faster.
BREAK, LINE = "Z", "Y"
#: A run of signs is tried once, at its first sign, so a text of any signs takes linear time.
FLOW_JAVA = r"(?<![.!?])[.!?]++(?:[ \t\r]+\n?|\n)|\n[ \t\r]*\n"


def normalise(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip(" ")


def _pieces(sentence: str) -> list[str]:
    """A known sentence with a full stop and a space inside is several sentences of a text."""
    return [p for p in (normalise(x) for x in re.split(LINES, sentence)) if p]


#: Known sentences; the identifier is the place, from 1.
SENTENCES: list[str] = list(dict.fromkeys(p for rules in (*RULES.values(), list(WHOLE.values())) for rule in rules for s in rule for p in _pieces(s)))


def rule_ids(rule: list[str]) -> list[int]:
    return [SENTENCES.index(p) + 1 for s in rule for p in _pieces(s)]


def license_pattern(rules: list[list[str]]) -> str:
    """For RE2: matches a sequence ",1,5,7," that has the identifiers of one of the rules in order."""
    return "|".join("(?:,[0-9]+)*".join(f",{i}" for i in rule_ids(r)) + "," for r in rules)


def holds(ids: str, rules: list[list[str]]) -> str:
    """Spark SQL: whether the identifiers in column `ids`, in text order, have those of one of the rules in order. A rule of several is
    followed by a fold that counts how many it has met, only where all occur; a regular expression over the identifiers would recurse in
    Java. As text, since an expression of some thousand literals is parsed faster than it is put together."""
    known = [rule_ids(r) for r in rules]
    listed = lambda r: f"array({', '.join(f'{i}L' for i in r)})"
    met = [f"CASE WHEN size(array_except({listed(r)}, {ids})) = 0 THEN aggregate({ids}, 0, (n, i) -> if(i = get({listed(r)}, n), n + 1, n)) = {len(r)} ELSE false END" for r in known if len(r) > 1]
    ones = [r[0] for r in known if len(r) == 1]
    return " OR ".join([*([f"arrays_overlap({ids}, {listed(ones)})"] if ones else []), *met])


def sentences(text: Column) -> tuple[Column, Column]:
    """The normalised sentences of a text with breaks as in LINES, and as in FLOW; empty ones left out. FLOW's breaks are LINES'
    without single line ends, so a text is marked once."""
    plain = F.regexp_replace(F.lower(text), FLOW_JAVA, BREAK)
    for sign, other in (("\n", LINE), (MARK, BREAK), ("_", " ")):
        plain = F.replace(plain, F.lit(sign), F.lit(other))
    plain = F.regexp_replace(plain, r"\W+", " ")  # ASCII, so letters and digits are all that is left
    cut = lambda c, breaks: F.filter(F.transform(F.split(c, breaks), lambda s: F.trim(s)), lambda s: s != "")
    return cut(plain, f"[{BREAK}{LINE}]"), cut(F.regexp_replace(plain, f" ?{LINE}[ {LINE}]*", " "), BREAK)


def _ids(found: str) -> Column:
    """Identifiers of the known sentences in column `found`; these are of a-z, 0-9 and spaces."""
    known = ", ".join(f"'{s}'" for s in SENTENCES)
    return F.expr(f"transform(filter({found}, s -> s IN ({known})), s -> array_position(array({known}), s))")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, line_ids and flow_ids (identifiers in order), licenses (names in table order), and whole_texts (those of
    them that stand there with all their sentences)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines, flow = sentences(text)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lines.alias("lines"), flow.alias("flow"))
    out = out.select("doc_id", F.size("lines").cast("long").alias("n_sentences"), _ids("lines").alias("line_ids"), _ids("flow").alias("flow_ids"))
    held = lambda rules: ", ".join(f"if({holds('line_ids', r)} OR {holds('flow_ids', r)}, '{n}', null)" for n, r in rules.items())
    names = lambda rules: F.expr(f"if(size(line_ids) > 0 OR size(flow_ids) > 0, array_compact(array({held(rules)})), cast(array() AS array<string>))")
    return out.select("*", names(RULES).alias("licenses"), names({n: [w] for n, w in WHOLE.items()}).alias("whole_texts"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(_base.table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_sentences", F.array_join(F.col("line_ids").cast("array<string>"), ",").alias("line_ids"),
        F.array_join(F.col("flow_ids").cast("array<string>"), ",").alias("flow_ids"), F.array_join("licenses", ",").alias("licenses"), F.size("licenses").cast("long").alias("n_licenses"),
        F.array_join("whole_texts", ",").alias("whole_texts"),
    )


def _oracle() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    known = "[" + ", ".join(q(s) for s in SENTENCES) + "]"
    raw = lambda r: q(r)  # noqa: E731  RE2 reads the same escapes
    cut = lambda b: f"list_filter(list_transform(string_split(regexp_replace(regexp_replace(lower(coalesce(text, '')), {raw(b)}, chr(1), 'g'), '[^a-z0-9\\x01]+', ' ', 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '')"
    ids = lambda c: f"list_filter(list_transform({c}, lambda x: coalesce(list_position({known}, x), 0)), lambda x: x > 0)"
    held = lambda rules: ", ".join(f"CASE WHEN regexp_matches(',' || line_ids || ',', {raw(p)}) OR regexp_matches(',' || flow_ids || ',', {raw(p)}) THEN {q(n)} END" for n, p in ((n, license_pattern(r)) for n, r in rules.items()))
    return f"""
WITH s AS (SELECT doc_id, {cut(LINES)} AS l, {cut(FLOW)} AS f FROM documents),
i AS (SELECT doc_id, len(l) AS n_sentences, array_to_string({ids('l')}, ',') AS line_ids, array_to_string({ids('f')}, ',') AS flow_ids FROM s),
h AS (SELECT *, list_filter([{held(RULES)}], lambda x: x IS NOT NULL) AS held, list_filter([{held({n: [w] for n, w in WHOLE.items()})}], lambda x: x IS NOT NULL) AS whole FROM i)
SELECT doc_id, n_sentences, line_ids, flow_ids, array_to_string(held, ',') AS licenses, len(held) AS n_licenses, array_to_string(whole, ',') AS whole_texts FROM h
"""


ORACLE = _oracle()
