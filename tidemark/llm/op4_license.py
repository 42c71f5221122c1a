"""License scan: ordered signature rules behind a keyword prefilter.

A few hundred regexes: sentences of the license texts, and the ways in which texts cite a license by name, id or
address. Each has a priority and keywords without which it can't match: they are read off the parsed regex (literal runs
that every match holds, cut at white space, which may be any), so the prefilter loses no match, however a text is wrapped.
One Aho-Corasick pass over the lower-cased text finds the keywords present; only rules whose keywords are all present run.
Overlapping detections are resolved by priority: a detection whose interval
lies inside that of a better one (higher priority, then longer, then earlier, then rule order) goes.

Edge cases: a null or empty text has no words and no labels, score 0. Repeated rows give repeated
results. Texts are scanned whole. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import bisect
import re
from functools import lru_cache
from re import _parser
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import map_arrow, text_or_empty

WORD = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
GAP = rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
IS_WORD = np.array([not (i <= 0x2F or 0x3A <= i <= 0x60 or 0x7B <= i <= 0x7F) for i in range(256)])
#: The base phrases and their labels.
BASE = {b"mit license": "mit", b"apache license": "apache", b"general public license": "gpl"}
BASE_RE = re.compile(b"(?<!%b)(?:%b)(?!%b)" % (WORD, b"|".join(b"(%b)" % GAP.join(p.split()) for p in BASE), WORD))
BASE_LABELS = tuple(BASE.values())

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections string"


#: Most keywords of a rule.
KEYWORDS = 4


class Rule(NamedTuple):
    label: str
    priority: int
    keywords: tuple[str, ...]
    pattern: str
    confidence: float


#: label: (SPDX ids, names as regexes, addresses as regexes). Text is lower case.
FAMILIES: dict[str, tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]] = {
    "mit": (("mit",), (r"mit", r"expat", r"x11"), (r"opensource\.org/licenses?/mit",)),
    "mit-0": (("mit-0",), (r"mit no attribution",), (r"github\.com/aws/mit-0",)),
    "apache": (("apache-2.0", "apache-1.1", "apache-1.0"), (r"apache(?: software)?", r"asl ?2(?:\.0)?"), (r"apache\.org/licenses/license-2\.0",)),
    "gpl": (("gpl-2.0", "gpl-2.0-only", "gpl-2.0-or-later", "gpl-3.0", "gpl-3.0-only", "gpl-3.0-or-later", "gpl-1.0"), (r"gnu general public", r"general public", r"(?:gnu )?gpl ?(?:v|version )?[123]?(?:\.0)?\+?"), (r"gnu\.org/licenses/gpl", r"gnu\.org/copyleft/gpl")),
    "lgpl": (("lgpl-2.0", "lgpl-2.1", "lgpl-2.1-only", "lgpl-2.1-or-later", "lgpl-3.0", "lgpl-3.0-only", "lgpl-3.0-or-later"), (r"gnu (?:lesser|library) general public", r"(?:gnu )?lgpl ?(?:v|version )?[23]?(?:\.[01])?\+?"), (r"gnu\.org/licenses/lgpl", r"gnu\.org/copyleft/lesser")),
    "agpl": (("agpl-3.0", "agpl-3.0-only", "agpl-3.0-or-later"), (r"gnu affero general public", r"affero general public", r"(?:gnu )?agpl ?(?:v|version )?3?(?:\.0)?\+?"), (r"gnu\.org/licenses/agpl",)),
    "gfdl": (("gfdl-1.1", "gfdl-1.2", "gfdl-1.3"), (r"gnu free documentation", r"gfdl"), (r"gnu\.org/licenses/fdl", r"gnu\.org/copyleft/fdl")),
    "bsd-2-clause": (("bsd-2-clause", "bsd-2-clause-patent", "bsd-2-clause-views"), (r"bsd 2[- ]clause", r"2[- ]clause bsd", r"two[- ]clause bsd", r"simplified bsd", r"freebsd"), (r"opensource\.org/licenses?/bsd-2-clause",)),
    "bsd-3-clause": (("bsd-3-clause", "bsd-3-clause-clear", "bsd-3-clause-lbnl"), (r"bsd 3[- ]clause", r"3[- ]clause bsd", r"three[- ]clause bsd", r"new bsd", r"modified bsd", r"revised bsd"), (r"opensource\.org/licenses?/bsd-3-clause",)),
    "bsd-4-clause": (("bsd-4-clause",), (r"bsd 4[- ]clause", r"4[- ]clause bsd", r"original bsd"), ()),
    "bsd": (("0bsd", "bsd-1-clause"), (r"bsd(?:[- ]style)?", r"berkeley software distribution"), (r"opensource\.org/licenses?/bsd-license",)),
    "isc": (("isc",), (r"isc", r"internet systems consortium"), (r"opensource\.org/licenses?/isc",)),
    "mpl": (("mpl-1.0", "mpl-1.1", "mpl-2.0", "mpl-2.0-no-copyleft-exception"), (r"mozilla public", r"mpl ?(?:v|version )?[12](?:\.[01])?"), (r"mozilla\.org/(?:en-us/)?mpl", r"mozilla\.org/media/mpl")),
    "epl": (("epl-1.0", "epl-2.0"), (r"eclipse public", r"epl ?(?:v|version )?[12](?:\.0)?"), (r"eclipse\.org/(?:legal/epl|org/documents/epl)",)),
    "edl": ((), (r"eclipse distribution",), (r"eclipse\.org/org/documents/edl",)),
    "cddl": (("cddl-1.0", "cddl-1.1"), (r"common development and distribution", r"cddl ?(?:v|version )?1?(?:\.[01])?"), (r"opensource\.org/licenses?/cddl",)),
    "cpl": (("cpl-1.0",), (r"common public",), (r"opensource\.org/licenses?/cpl",)),
    "ipl": (("ipl-1.0",), (r"ibm public",), (r"opensource\.org/licenses?/ipl",)),
    "artistic": (("artistic-1.0", "artistic-1.0-perl", "artistic-2.0"), (r"artistic", r"perl artistic"), (r"opensource\.org/licenses?/artistic", r"perlfoundation\.org/artistic")),
    "boost": (("bsl-1.0",), (r"boost software",), (r"boost\.org/license_1_0",)),
    "zlib": (("zlib", "zlib-acknowledgement"), (r"zlib(?:/libpng)?",), (r"opensource\.org/licenses?/zlib", r"zlib\.net/zlib_license")),
    "libpng": (("libpng", "libpng-2.0"), (r"libpng",), (r"libpng\.org/pub/png/src/libpng-license",)),
    "unlicense": (("unlicense",), (r"(?:the )?unlicense",), (r"unlicense\.org",)),
    "wtfpl": (("wtfpl",), (r"wtfpl", r"do what the f\S+ you want to public"), (r"wtfpl\.net",)),
    "cc0": (("cc0-1.0",), (r"cc0(?: 1\.0)?(?: universal)?", r"creative commons zero"), (r"creativecommons\.org/publicdomain/zero",)),
    "cc-by": (("cc-by-1.0", "cc-by-2.0", "cc-by-2.5", "cc-by-3.0", "cc-by-4.0"), (r"creative commons attribution(?: [1234]\.[05])?(?: international| unported| generic)?", r"cc[- ]by(?: [1234]\.[05])?"), (r"creativecommons\.org/licenses/by/",)),
    "cc-by-sa": (("cc-by-sa-2.0", "cc-by-sa-2.5", "cc-by-sa-3.0", "cc-by-sa-4.0"), (r"creative commons attribution[- ]share ?alike(?: [1234]\.[05])?(?: international| unported)?", r"cc[- ]by[- ]sa(?: [1234]\.[05])?"), (r"creativecommons\.org/licenses/by-sa/",)),
    "cc-by-nc": (("cc-by-nc-2.0", "cc-by-nc-3.0", "cc-by-nc-4.0"), (r"creative commons attribution[- ]non-?commercial(?: [1234]\.[05])?(?: international| unported)?", r"cc[- ]by[- ]nc(?: [1234]\.[05])?"), (r"creativecommons\.org/licenses/by-nc/",)),
    "cc-by-nd": (("cc-by-nd-3.0", "cc-by-nd-4.0"), (r"creative commons attribution[- ]no ?deriv(?:ative)?s?", r"cc[- ]by[- ]nd(?: [1234]\.[05])?"), (r"creativecommons\.org/licenses/by-nd/",)),
    "cc-by-nc-sa": (("cc-by-nc-sa-3.0", "cc-by-nc-sa-4.0"), (r"creative commons attribution[- ]non-?commercial[- ]share ?alike", r"cc[- ]by[- ]nc[- ]sa(?: [1234]\.[05])?"), (r"creativecommons\.org/licenses/by-nc-sa/",)),
    "cc-by-nc-nd": (("cc-by-nc-nd-3.0", "cc-by-nc-nd-4.0"), (r"creative commons attribution[- ]non-?commercial[- ]no ?deriv(?:ative)?s?", r"cc[- ]by[- ]nc[- ]nd(?: [1234]\.[05])?"), (r"creativecommons\.org/licenses/by-nc-nd/",)),
    "public-domain": ((), (r"public domain dedication",), (r"creativecommons\.org/publicdomain/mark",)),
    "odbl": (("odbl-1.0",), (r"open database", r"odbl"), (r"opendatacommons\.org/licenses/odbl",)),
    "odc-by": (("odc-by-1.0",), (r"open data commons attribution",), (r"opendatacommons\.org/licenses/by",)),
    "pddl": (("pddl-1.0",), (r"open data commons public domain dedication(?: and)?",), (r"opendatacommons\.org/licenses/pddl",)),
    "ofl": (("ofl-1.0", "ofl-1.1"), (r"sil open font", r"open font"), (r"scripts\.sil\.org/ofl", r"openfontlicense\.org")),
    "python": (("psf-2.0", "python-2.0"), (r"python software foundation", r"psf"), (r"python\.org/psf/license", r"docs\.python\.org/\S*license")),
    "postgresql": (("postgresql",), (r"postgresql",), (r"postgresql\.org/about/licen[cs]e",)),
    "php": (("php-3.0", "php-3.01"), (r"php",), (r"php\.net/license",)),
    "ruby": (("ruby",), (r"ruby(?:'s)?",), (r"ruby-lang\.org/\S*license",)),
    "openssl": (("openssl",), (r"openssl", r"ssleay"), (r"openssl\.org/source/license",)),
    "eupl": (("eupl-1.1", "eupl-1.2"), (r"european union public", r"eupl ?(?:v|version )?1?(?:\.[12])?"), (r"joinup\.ec\.europa\.eu/\S*eupl",)),
    "cecill": (("cecill-2.0", "cecill-2.1", "cecill-b", "cecill-c"), (r"cecill(?:-[bc])?",), (r"cecill\.info",)),
    "mspl": (("ms-pl",), (r"microsoft public", r"ms-pl"), (r"opensource\.org/licenses?/ms-pl",)),
    "msrl": (("ms-rl",), (r"microsoft reciprocal", r"ms-rl"), (r"opensource\.org/licenses?/ms-rl",)),
    "afl": (("afl-2.1", "afl-3.0"), (r"academic free",), (r"opensource\.org/licenses?/afl",)),
    "osl": (("osl-2.1", "osl-3.0"), (r"open software",), (r"opensource\.org/licenses?/osl",)),
    "ncsa": (("ncsa",), (r"university of illinois(?:/ncsa)? open source", r"ncsa open source"), (r"opensource\.org/licenses?/ncsa",)),
    "upl": (("upl-1.0",), (r"universal permissive",), (r"opensource\.org/licenses?/upl",)),
    "busl": (("busl-1.1",), (r"business source",), (r"mariadb\.com/bsl",)),
    "sspl": (("sspl-1.0",), (r"server side public",), (r"mongodb\.com/licensing/server-side-public-license",)),
    "elastic": (("elastic-2.0",), (r"elastic",), (r"elastic\.co/licensing/elastic-license",)),
    "mulan": (("mulanpsl-1.0", "mulanpsl-2.0"), (r"mulan permissive software", r"mulan psl"), (r"license\.coscl\.org\.cn/mulanpsl",)),
    "openrail": ((), (r"(?:creativeml )?open ?rail(?:-[ms+]+)?", r"responsible ai"), (r"huggingface\.co/\S*license",)),
}

#: Phrases of the license texts themselves: label, regex.
BODIES: tuple[tuple[str, str], ...] = (
    ("mit", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("mit", r"use, copy, modify, merge, publish, distribute, sublicense"),
    ("mit", r"the above copyright notice and this permission notice shall be included"),
    ("isc", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose"),
    ("bsd", r"redistribution and use in source and binary forms,? with or without modification"),
    ("bsd-3-clause", r"neither the name of .{1,80} may be used to endorse or promote"),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software"),
    ("bsd-2-clause", r"redistributions of source code must retain the above copyright notice, this list of conditions"),
    ("apache", r"you may not use this (?:file|work|software) except in compliance with the license"),
    ("apache", r"distributed on an \"?as is\"? basis, without warranties or conditions of any kind"),
    ("gpl", r"redistribute it and/or modify it under the terms of the gnu general public license"),
    ("gpl", r"distributed in the hope that it will be useful, but without any warranty"),
    ("lgpl", r"under the terms of the gnu lesser general public license"),
    ("agpl", r"under the terms of the gnu affero general public license"),
    ("gfdl", r"with no invariant sections, no front-cover texts"),
    ("mpl", r"this source code form is subject to the terms of the mozilla public license"),
    ("zlib", r"altered source versions must be plainly marked as such"),
    ("zlib", r"the origin of this software must not be misrepresented"),
    ("boost", r"machine-executable object code generated by a source language processor"),
    ("unlicense", r"free and unencumbered software released into the public domain"),
    ("wtfpl", r"you just do what the f\S+ you want to"),
    ("public-domain", r"(?:released|placed|dedicated|put) (?:in|into|to) the public domain"),
    ("public-domain", r"(?:is|are) (?:hereby )?in the public domain"),
    ("ofl", r"with reserved font names?"),
    ("cc0", r"waived all copyright and related"),
    ("cc-by", r"under a creative commons attribution"),
    ("artistic", r"distribute (?:verbatim copies of )?the standard version"),
    ("epl", r"this program and the accompanying materials are made available under the terms of the eclipse"),
    ("postgresql", r"the above copyright notice and this paragraph and the following two paragraphs appear in all copies"),
    ("ncsa", r"neither the names of .{1,80} nor the names of its contributors"),
    ("mit", r"the software is provided \"?as is\"?,? without warranty of any kind, express or implied"),
    ("mit", r"to deal in the software without restriction, including without limitation the rights"),
    ("mit", r"in no event shall the authors or copyright holders be liable for any claim"),
    ("mit", r"to permit persons to whom the software is furnished to do so"),
    ("mit", r"except as contained in this notice, the names? of .{1,80} shall not be used in advertising"),
    ("mit-0", r"to permit persons to whom the software is furnished to do so\. the software is provided"),
    ("isc", r"the software is provided \"?as is\"? and (?:the author|isc|.{1,40}) disclaims all warranties"),
    ("isc", r"provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", r"loss of use, data or profits, whether in an action of contract, negligence or other tortious action"),
    ("0bsd", r"permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted\. the software"),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice, this list of conditions"),
    ("bsd", r"this software is provided by the (?:copyright holders?|regents|authors?)(?: and contributors)? \"?as is\"? and any express or implied warranties"),
    ("bsd", r"procurement of substitute goods or services; loss of use, data, or profits"),
    ("bsd", r"even if advised of the possibility of such damage"),
    ("bsd-3-clause", r"names? of (?:its|the|any|other) contributors may (?:not )?be used to endorse or promote products"),
    ("bsd-3-clause", r"no express or implied licenses to any party's patent rights are granted"),
    ("bsd-4-clause", r"must display the following acknowledge?ment: this product includes software developed by"),
    ("bsd-4-clause", r"this product includes software developed by the university of california"),
    ("bsd-2-clause", r"the views and conclusions contained in the software and documentation are those of the authors"),
    ("apache", r"terms and conditions for use, reproduction, and distribution"),
    ("apache", r"perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license"),
    ("apache", r"unless required by applicable law or agreed to in writing, software distributed under the license"),
    ("apache", r"see the license for the specific language governing permissions and limitations"),
    ("apache", r"licensed to the apache software foundation \(asf\) under one or more contributor license agreements"),
    ("apache", r"a copy of the attribution notices contained within such notice file"),
    ("apache", r"appendix: how to apply the apache license to your work"),
    ("apache", r"this product includes software developed by the apache software foundation"),
    ("gpl", r"everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("gpl", r"either version [123](?: of the license)?,? or \(at your option\) any later version"),
    ("gpl", r"you should have received a copy of the gnu general public license along with"),
    ("gpl", r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl", r"the gnu general public license is a free, copyleft license for software"),
    ("gpl", r"how to apply these terms to your new programs"),
    ("gpl", r"terms and conditions for copying, distribution and modification"),
    ("gpl", r"this program is free software[:;,] you can redistribute it"),
    ("gpl", r"you must cause the modified files to carry prominent notices stating that you changed the files"),
    ("gpl", r"the \"?corresponding source\"? for a work in object code form means"),
    ("gpl", r"you may convey verbatim copies of the program's source code as you receive it"),
    ("gpl", r"as a special exception, .{1,120} gives? (?:you )?permission to link"),
    ("gpl", r"gcc runtime library exception"),
    ("gpl", r"classpath exception"),
    ("lgpl", r"this library is free software[:;,] you can redistribute it"),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public license along with"),
    ("lgpl", r"a work that uses the library"),
    ("lgpl", r"the object code form of an application may incorporate material from a header file"),
    ("lgpl", r"incorporates the terms and conditions of version 3 of the gnu general public license"),
    ("agpl", r"remote network interaction; use with the gnu general public license"),
    ("agpl", r"your modified version must prominently offer all users interacting with it remotely"),
    ("agpl", r"you should have received a copy of the gnu affero general public license along with"),
    ("agpl", r"ensure cooperation with the community in the case of network server software"),
    ("gfdl", r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", r"the purpose of this license is to make a manual, textbook, or other functional and useful document"),
    ("gfdl", r"a copy of the license is included in the section entitled"),
    ("mpl", r"if a copy of the mpl was not distributed with this file, you can obtain one at"),
    ("mpl", r"this source code form is \"?incompatible with secondary licenses\"?"),
    ("mpl", r"the contents of this file are subject to the mozilla public license"),
    ("mpl", r"the original code is .{1,80}\. the initial developer of the original code is"),
    ("mpl", r"alternatively, the contents of this file may be used under the terms of either"),
    ("epl", r"all rights reserved\. this program and the accompanying materials"),
    ("epl", r"any use, reproduction or distribution of the program constitutes recipient's acceptance of this agreement"),
    ("epl", r"the accompanying program is provided under the terms of this eclipse public license"),
    ("edl", r"eclipse distribution license ?-? ?v ?1\.0"),
    ("cddl", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl", r"when distributing covered code, include this cddl header in each file"),
    ("cpl", r"the accompanying program is provided under the terms of this common public license"),
    ("ipl", r"the accompanying program is provided under the terms of this ibm public license"),
    ("artistic", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic", r"you may distribute the programs of this package in object code or executable form"),
    ("artistic", r"this is free software; you can redistribute it and/or modify it under the same terms as (?:the )?perl"),
    ("artistic", r"the copyright holder maintains some semblance of artistic control"),
    ("boost", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("boost", r"distributed under the boost software license, version 1\.0"),
    ("zlib", r"this software is provided 'as-is', without any express or implied warranty"),
    ("zlib", r"permission is granted to anyone to use this software for any purpose, including commercial applications"),
    ("zlib", r"this notice may not be removed or altered from any source distribution"),
    ("libpng", r"the contributing authors and group 42, inc\. disclaim all warranties"),
    ("libpng", r"permission is hereby granted to use, copy, modify, and distribute this source code"),
    ("unlicense", r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("unlicense", r"in jurisdictions that recognize copyright laws, the author or authors of this software dedicate"),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document"),
    ("cc0", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0", r"to the extent possible under law, .{1,120} has waived"),
    ("cc0", r"affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives"),
    ("cc-by", r"you must give appropriate credit, provide a link to the license, and indicate if changes were made"),
    ("cc-by", r"by exercising the licensed rights \(defined below\), you accept and agree to be bound"),
    ("cc-by-sa", r"if you remix, transform, or build upon the material, you must distribute your contributions under the same license"),
    ("cc-by-nc", r"you may not use the material for commercial purposes"),
    ("cc-by-nd", r"if you remix, transform, or build upon the material, you may not distribute the modified material"),
    ("odbl", r"this .{1,80} is made available under the open database license"),
    ("odbl", r"any rights in individual contents of the database are licensed under the database contents license"),
    ("odc-by", r"is made available under the open data commons attribution license"),
    ("pddl", r"is made available under the public domain dedication and license"),
    ("ofl", r"this font software is licensed under the sil open font license"),
    ("ofl", r"neither the font software nor any of its individual components, in original or modified versions, may be sold by itself"),
    ("python", r"this license agreement is between the python software foundation"),
    ("python", r"psf is making python available to licensee on an \"?as is\"? basis"),
    ("postgresql", r"permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement"),
    ("php", r"this product includes php software, freely available from"),
    ("php", r"products derived from this software may not be called \"?php\"?"),
    ("ruby", r"you may make and give away verbatim copies of the source form of the software without restriction"),
    ("openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("openssl", r"this product includes cryptographic software written by eric young"),
    ("eupl", r"licensed under the eupl,? version 1\.[0-2]"),
    ("eupl", r"this european union public licence \(the \"?eupl\"?\) applies to the work"),
    ("cecill", r"this software is governed by the cecill(?:-[bc])? license under french law"),
    ("mspl", r"this license governs use of the accompanying software\. if you use the software, you accept this license"),
    ("afl", r"licensed under the academic free license version"),
    ("osl", r"licensed under the open software license version"),
    ("ncsa", r"to deal with the software without restriction, including without limitation the rights"),
    ("upl", r"the above copyright notice and either this complete permission notice or at a minimum a reference to the upl must be included"),
    ("busl", r"the licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use"),
    ("busl", r"on the change date, or the fourth anniversary of the first publicly available distribution"),
    ("sspl", r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic", r"you may not provide the software to third parties as a hosted or managed service"),
    ("mulan", r"you can use this software according to the terms and conditions of the mulan psl"),
    ("openrail", r"use restrictions as referenced in paragraph 5"),
    ("openrail", r"you agree not to use the model or derivatives of the model"),
    ("public-domain", r"this (?:work|file|software|code|document) has been (?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", r"no copyright is claimed in the united states"),
    ("public-domain", r"works? of the (?:united states|u\.s\.) government"),
    ("proprietary", r"for internal use only"),
    ("proprietary", r"may not be (?:copied|reproduced|distributed|disclosed)(?:,? (?:or|and) \w+)* without (?:the )?(?:prior |express |written )*(?:consent|permission)"),
    ("proprietary", r"this software is the confidential and proprietary information of"),
    ("proprietary", r"no part of this (?:publication|work|document|book) may be reproduced"),
    ("proprietary", r"you may not reverse engineer, decompile,? or disassemble"),
    ("proprietary", r"trade secrets? of .{1,60} and (?:is|are) protected"),
    ("proprietary", r"all rights reserved"),
    ("proprietary", r"proprietary and confidential"),
    ("proprietary", r"unauthori[sz]ed (?:copying|use|reproduction|distribution)"),
    ("proprietary", r"end[- ]user licen[cs]e agreement"),
    ("copyright", r"copyright (?:\(c\)|©|by)? ?(?:19|20)\d\d"),
    ("copyright", r"\(c\) ?(?:19|20)\d\d"),
    ("copyright", r"© ?(?:19|20)\d\d"),
    ("unknown-license", r"licen[cs]ed under (?:the )?terms"),
    ("unknown-license", r"under the terms of the licen[cs]e"),
    ("unknown-license", r"see (?:the )?licen[cs]e(?:\.(?:txt|md))?(?: file)? for"),
)


#: Runs of white space that are longer than any rule needs (several repeats may stand side by side, each with a character of its own),
#: and how many characters are left of them: the first ones and the last.
RUNS, LEFT = re.compile(r"(\s{5})\s+(\s)"), 6


def spaced(pattern: str) -> str:
    """The pattern with its spaces as any white space."""
    return pattern.replace("[- ]", r"[-\s]").replace(" ?", r"\s*").replace(" ", r"\s+").replace(".{", r"[\s\S]{")


def literal_runs(tree) -> list[str]:
    """Strings that every match of a parsed regex holds; what may be absent or vary ends a run and adds none."""
    runs = [""]
    for op, arg in tree:
        if op is _parser.LITERAL:
            runs[-1] += chr(arg)
        elif op is _parser.SUBPATTERN:
            runs += ["", *literal_runs(arg[3]), ""]
        elif op is _parser.MAX_REPEAT and arg[0] > 0:
            runs += ["", *literal_runs(arg[2]), ""]
        else:
            runs.append("")
    return [r for r in runs if r]


def keywords(pattern: str) -> tuple[str, ...]:
    """The longest few of the strings that the pattern provably needs."""
    return tuple(sorted(set(literal_runs(_parser.parse(pattern))), key=lambda r: (-len(r), r))[:KEYWORDS])


def rule(label: str, priority: int, pattern: str, confidence: float) -> Rule:
    return Rule(label, priority, keywords(pattern), pattern, confidence)


def rules() -> list[Rule]:
    """All rules in order. The families' names give one rule for each way a text cites a license."""
    out = []
    for label, (ids, names, addresses) in FAMILIES.items():
        for spdx in ids:
            out.append(rule(label, 100, rf"spdx-license-identifier\s*:\s*\(?(?:[\w.+-]+ (?:or|and) )*{re.escape(spdx)}(?![\w+-]|\.\w)", 1.0))
        for name in names:
            name = spaced(name)
            out.append(rule(label, 80, rf"(?<!\w)(?:licen[cs]ed|released|distributed|published|available|covered)\s+(?:under|by)\s+(?:the\s+|an?\s+)?(?:terms\s+of\s+the\s+)?{name}\s+(?:public\s+)?licen[cs]e(?:,?\s+(?:version|v\.?)\s*\d+(?:\.\d+)?)?(?!\w)", 0.95))
            out.append(rule(label, 60, rf"(?<!\w){name}\s+(?:public\s+)?licen[cs]e(?:,?\s+(?:version|v\.?)\s*\d+(?:\.\d+)?)?(?!\w)", 0.8))
            out.append(rule(label, 50, rf"(?<!\w)licen[cs]e\s*[:=]\s*[\"']?{name}(?!\w)", 0.75))
        for address in addresses:
            out.append(rule(label, 70, rf"(?<!\w){address}", 0.9))
    for label, body in BODIES:
        weak = label in ("copyright", "unknown-license", "proprietary")
        out.append(rule(label, 20 if weak else 90, (r"(?<!\w)" if body[0].isalpha() else "") + spaced(body), 0.3 if weak else 0.9))
    return out


class Scanner:
    """The compiled rules and the automaton of their keywords."""

    def __init__(self, ordered: list[Rule]):
        self.rules = ordered
        self.compiled = [re.compile(r.pattern) for r in ordered]
        keys = sorted({k for r in ordered for k in r.keywords})
        number = {k: i for i, k in enumerate(keys)}
        self.needs = [frozenset(number[k] for k in r.keywords) for r in ordered]
        self.by_key: dict[int, list[int]] = {}
        for i, need in enumerate(self.needs):
            # A rule is looked at when its rarest keyword (the longest) is there.
            self.by_key.setdefault(max(need, key=lambda n: (len(keys[n]), n)), []).append(i)
        self.automaton = ahocorasick.Automaton()
        for k, i in number.items():
            self.automaton.add_word(k, i)
        self.automaton.make_automaton()

    def detections(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, rule) in *text* (lower case), suppressed ones left out, by start.

        Rules see a run of white space with LEFT characters at most, so that repeats of white space have no more than that to
        try, however long the run; places are those of *text*.
        """
        narrow = RUNS.sub(r"\1\2", text)
        return in_place(text, self.narrow_detections(narrow)) if len(narrow) < len(text) else self.narrow_detections(narrow)

    def narrow_detections(self, text: str) -> list[tuple[int, int, int]]:
        present = {i for _, i in self.automaton.iter(text)}
        if not present:
            return []
        found = [
            (m.start(), m.end(), i)
            for k in present
            for i in self.by_key.get(k, ())
            if self.needs[i] <= present
            for m in self.compiled[i].finditer(text)
            if m.end() > m.start()
        ]
        return suppress(found, [r.priority for r in self.rules])


def in_place(text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Places in *text* of detections in the same text with short runs of white space."""
    if not found:
        return found
    after, shift, total = [0], [0], 0  # from each narrow place on, what the runs before it add
    for m in RUNS.finditer(text):
        after.append(m.start() - total + LEFT - 1)
        total += m.end() - m.start() - LEFT
        shift.append(total)
    wide = lambda p: p + shift[bisect.bisect_right(after, p) - 1]
    return [(wide(a), wide(b - 1) + 1, i) for a, b, i in found]


def suppress(found: list[tuple[int, int, int]], priority: list[int]) -> list[tuple[int, int, int]]:
    """Drop each detection whose interval lies inside that of a better one.

    The accepted intervals that lie in no other form a staircase (starts and ends both rise), so one
    bisection tells whether some accepted interval holds the next one: O(n log n) for n detections.
    """
    starts: list[int] = []
    ends: list[int] = []
    kept = []
    for s, e, i in sorted(found, key=lambda d: (-priority[d[2]], d[0] - d[1], d[0], d[2])):
        at = bisect.bisect_right(starts, s) - 1
        if at >= 0 and ends[at] >= e:
            continue
        kept.append((s, e, i))
        low = bisect.bisect_left(starts, s)
        high = bisect.bisect_right(ends, e)
        starts[low:max(low, high)], ends[low:max(low, high)] = [s], [e]
    return sorted(kept)


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner(rules())


def scan_one(raw: bytes) -> tuple:
    """One text's row: words, base phrases, labels and score."""
    low = raw.lower()  # of bytes: A-Z alone
    mask = IS_WORD[np.frombuffer(low, dtype=np.uint8)] if low else np.zeros(0, bool)
    begins = mask.copy()
    begins[1:] &= ~mask[:-1]
    n_words = int(np.count_nonzero(begins))
    n_base, first, last, base = 0, None, None, set()
    if b"license" in low:
        places = [(m.start(), BASE_LABELS[m.lastindex - 1]) for m in BASE_RE.finditer(low)]
        if places:
            at = np.searchsorted(np.flatnonzero(begins), [p for p, _ in places])
            n_base, first, last, base = len(places), int(at[0]), int(at[-1]), {x for _, x in places}
    s = scanner()
    found = s.detections(low.decode("utf-8", "replace"))
    labels = base | {s.rules[i].label for _, _, i in found}
    score = max([0.5 if base else 0.0, *(s.rules[i].confidence for _, _, i in found)])
    spans = ",".join(f"{s.rules[i].label}:{a}:{b}" for a, b, i in found)
    return n_words, n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, spans


def scan(docs: DataFrame) -> DataFrame:
    """License labels of every document: see the module's docstring; detections are label:start:end in code points."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [scan_one(x) for x in batch.column(1).cast(pa.binary()).to_pylist()]
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True))], names=names)

    return map_arrow(text_or_empty(docs), run, SCHEMA)
