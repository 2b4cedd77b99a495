"""Signature rules of the license scan, written by hand.

``NAMES`` has a line for each license: its label (the SPDX identifier in lower case), the keywords that gate its rules
(a text must hold all of them; ``/`` is between alternatives, and a keyword of several words asks for each of the
words), and a pattern of its name. Three rules come from each line, from the strongest: the
SPDX tag, the grant ("licensed under the ..."), and the bare mention. ``SIGNATURES`` has patterns of the license texts
and notices themselves, which outrank all three. Texts are in lower case; a blank in a pattern stands for any space.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# Labels, keywords and name patterns of published licenses.
NAMES = r"""
mit | licen,mit/expat | (?:mit|expat) (?:open source )?licen[sc]e
mit-0 | mit,-0/attribution | mit(?:-0| no attribution)(?: licen[sc]e)?
x11 | x11 | x11 licen[sc]e
apache-1.0 | apache,1.0 | apache (?:software )?licen[sc]e,?(?: version| v\.?)? ?1\.0
apache-1.1 | apache,1.1 | apache (?:software )?licen[sc]e,?(?: version| v\.?)? ?1\.1
apache-2.0 | apache,2.0 | apache(?: software)?(?: licen[sc]e)?,?(?: version| v\.?|-)? ?2\.0(?: licen[sc]e)?
apache | apache,licen | apache (?:software )?licen[sc]e
bsd-1-clause | bsd,clause | (?:1|one)[- ]clause bsd(?: licen[sc]e)?|bsd[- ]1[- ]clause(?: licen[sc]e)?
bsd-2-clause | bsd | (?:2|two)[- ]clause bsd(?: licen[sc]e)?|bsd[- ]2[- ]clause(?: licen[sc]e)?|(?:simplified|freebsd) bsd licen[sc]e
bsd-3-clause | bsd | (?:3|three)[- ]clause bsd(?: licen[sc]e)?|bsd[- ]3[- ]clause(?: licen[sc]e)?|(?:new|modified|revised) bsd licen[sc]e
bsd-4-clause | bsd | (?:4|four)[- ]clause bsd(?: licen[sc]e)?|bsd[- ]4[- ]clause(?: licen[sc]e)?|original bsd licen[sc]e
0bsd | bsd | zero[- ]clause bsd(?: licen[sc]e)?|bsd zero[- ]clause(?: licen[sc]e)?|0bsd
bsd | bsd,licen | bsd(?:-style| style)? licen[sc]e
gpl-1.0 | gpl/general public,1 | (?:gnu )?(?:gpl|general public licen[sc]e),?(?: version| v\.?|-)? ?v?1(?:\.0)?\b
gpl-2.0 | gpl/general public,2 | (?:gnu )?(?:gpl|general public licen[sc]e),?(?: version| v\.?|-)? ?v?2(?:\.0)?\b
gpl-3.0 | gpl/general public,3 | (?:gnu )?(?:gpl|general public licen[sc]e),?(?: version| v\.?|-)? ?v?3(?:\.0)?\b
gpl | general public | (?:gnu )?general public licen[sc]e
lgpl-2.0 | lesser/library,2.0 | (?:gnu )?(?:library|lesser) general public licen[sc]e,?(?: version| v\.?)? ?2\.0
lgpl-2.1 | lgpl/lesser,2.1 | (?:gnu )?(?:lgpl|lesser general public licen[sc]e),?(?: version| v\.?|-)? ?v?2\.1
lgpl-3.0 | lgpl/lesser,3 | (?:gnu )?(?:lgpl|lesser general public licen[sc]e),?(?: version| v\.?|-)? ?v?3(?:\.0)?\b
lgpl | general public | (?:gnu )?(?:lesser|library) general public licen[sc]e
agpl-1.0 | affero | affero general public licen[sc]e,?(?: version| v\.?)? ?1(?:\.0)?\b
agpl-3.0 | agpl/affero,3 | (?:gnu )?(?:agpl|affero general public licen[sc]e),?(?: version| v\.?|-)? ?v?3(?:\.0)?\b
agpl | affero | (?:gnu )?affero general public licen[sc]e
gfdl | documentation | (?:gnu )?free documentation licen[sc]e
gfdl-1.2 | documentation,1.2 | (?:gnu )?free documentation licen[sc]e,?(?: version| v\.?)? ?1\.2
gfdl-1.3 | documentation,1.3 | (?:gnu )?free documentation licen[sc]e,?(?: version| v\.?)? ?1\.3
mpl-1.0 | mozilla,1.0 | mozilla public licen[sc]e,?(?: version| v\.?)? ?1\.0
mpl-1.1 | mozilla,1.1 | mozilla public licen[sc]e,?(?: version| v\.?)? ?1\.1
mpl-2.0 | mozilla,2.0 | mozilla public licen[sc]e,?(?: version| v\.?)? ?2\.0
mpl | mozilla | mozilla public licen[sc]e
epl-1.0 | eclipse,1.0 | eclipse public licen[sc]e,?(?: -)?(?: version| v\.?)? ?1\.0
epl-2.0 | eclipse,2.0 | eclipse public licen[sc]e,?(?: -)?(?: version| v\.?)? ?2\.0
epl | eclipse | eclipse public licen[sc]e
edl-1.0 | eclipse,distribution | eclipse distribution licen[sc]e
cpl-1.0 | common public | common public licen[sc]e
ipl-1.0 | ibm public | ibm public licen[sc]e
cddl-1.0 | cddl/common development | (?:common development and distribution licen[sc]e|cddl)(?: \(cddl\))?,?(?: version| v\.?|-)? ?1\.0
cddl-1.1 | cddl/common development | (?:common development and distribution licen[sc]e|cddl)(?: \(cddl\))?,?(?: version| v\.?|-)? ?1\.1
cddl | common development | common development and distribution licen[sc]e
isc | isc | isc licen[sc]e
zlib | zlib | zlib(?:/libpng)? licen[sc]e
libpng | libpng | libpng licen[sc]e
bsl-1.0 | boost | boost software licen[sc]e
unlicense | unlicen | (?:the )?unlicen[sc]e
wtfpl | what the f | do what the f\w+ you want to public licen[sc]e
cc0-1.0 | cc0/cc zero | (?:creative commons )?(?:cc0|cc zero)(?: 1\.0)?(?: universal)?
cc-by-1.0 | cc/creative commons,1.0 | (?:creative commons |cc[- ])(?:attribution|by)[- ]1\.0
cc-by-2.0 | cc/creative commons,2.0 | (?:creative commons |cc[- ])(?:attribution|by)[- ]2\.0
cc-by-2.5 | cc/creative commons,2.5 | (?:creative commons |cc[- ])(?:attribution|by)[- ]2\.5
cc-by-3.0 | cc/creative commons,3.0 | (?:creative commons attribution|cc[- ]by)[- ]3\.0
cc-by-4.0 | cc/creative commons,4.0 | (?:creative commons attribution|cc[- ]by)[- ]4\.0
cc-by-sa-2.0 | cc/creative commons,2.0 | (?:creative commons attribution[- ]share[- ]?alike|cc[- ]by[- ]sa)[- ]2\.0
cc-by-sa-2.5 | cc/creative commons,2.5 | (?:creative commons attribution[- ]share[- ]?alike|cc[- ]by[- ]sa)[- ]2\.5
cc-by-sa-3.0 | cc/creative commons,3.0 | (?:creative commons attribution[- ]share[- ]?alike|cc[- ]by[- ]sa)[- ]3\.0
cc-by-sa-4.0 | cc/creative commons,4.0 | (?:creative commons attribution[- ]share[- ]?alike|cc[- ]by[- ]sa)[- ]4\.0
cc-by-nc-2.0 | cc/creative commons,2.0 | (?:creative commons attribution[- ]non[- ]?commercial|cc[- ]by[- ]nc)[- ]2\.0
cc-by-nc-3.0 | cc/creative commons,3.0 | (?:creative commons attribution[- ]non[- ]?commercial|cc[- ]by[- ]nc)[- ]3\.0
cc-by-nc-4.0 | cc/creative commons,4.0 | (?:creative commons attribution[- ]non[- ]?commercial|cc[- ]by[- ]nc)[- ]4\.0
cc-by-nd-4.0 | cc/creative commons,4.0 | (?:creative commons attribution[- ]no[- ]?deriv\w+|cc[- ]by[- ]nd)[- ]4\.0
cc-by-nc-sa-3.0 | cc/creative commons,3.0 | (?:creative commons attribution[- ]non[- ]?commercial[- ]share[- ]?alike|cc[- ]by[- ]nc[- ]sa)[- ]3\.0
cc-by-nc-sa-4.0 | cc/creative commons,4.0 | (?:creative commons attribution[- ]non[- ]?commercial[- ]share[- ]?alike|cc[- ]by[- ]nc[- ]sa)[- ]4\.0
cc-by-nc-nd-4.0 | cc/creative commons,4.0 | (?:creative commons attribution[- ]non[- ]?commercial[- ]no[- ]?deriv\w+|cc[- ]by[- ]nc[- ]nd)[- ]4\.0
cc | creative commons | creative commons licen[sc]e
artistic-1.0 | artistic,1.0 | (?:perl )?artistic licen[sc]e,?(?: version| v\.?)? ?1\.0
artistic-2.0 | artistic,2.0 | artistic licen[sc]e,?(?: version| v\.?)? ?2\.0
artistic | artistic | artistic licen[sc]e
psf-2.0 | python | python software foundation licen[sc]e
python-2.0 | python | python licen[sc]e,?(?: version)? 2\.0
ruby | ruby | ruby(?:'s)? licen[sc]e
php-3.01 | php | php licen[sc]e(?:,? version 3\.01)?
zpl-2.1 | zope | zope public licen[sc]e
w3c | w3c | w3c(?: software)?(?: notice and)? licen[sc]e
openssl | openssl | openssl licen[sc]e
ofl-1.1 | open font | (?:sil )?open font licen[sc]e
eupl-1.1 | european,1.1 | european union public licen[sc]e,?(?: version| v\.?)? ?1\.1
eupl-1.2 | european,1.2 | european union public licen[sc]e,?(?: version| v\.?)? ?1\.2
eupl | european union public | european union public licen[sc]e
osl-3.0 | open software | open software licen[sc]e,?(?: version| v\.?)? ?3\.0
afl-3.0 | academic free | academic free licen[sc]e
ecl-2.0 | educational | educational community licen[sc]e
upl-1.0 | universal permissive | universal permissive licen[sc]e
ms-pl | microsoft public | microsoft public licen[sc]e
ms-rl | microsoft reciprocal | microsoft reciprocal licen[sc]e
ncsa | ncsa | (?:university of illinois/)?ncsa(?: open source)? licen[sc]e
postgresql | postgresql | postgresql licen[sc]e
sleepycat | sleepycat | sleepycat licen[sc]e
qpl-1.0 | q public | q public licen[sc]e
apsl-2.0 | apple public | apple public source licen[sc]e
nasa-1.3 | nasa | nasa open source agreement
lppl-1.3c | latex project | latex project public licen[sc]e
vim | vim | vim licen[sc]e
curl | curl | curl licen[sc]e
icu | icu | icu licen[sc]e
unicode | unicode | unicode(?:,? inc\.?)? licen[sc]e
ijg | jpeg group | independent jpeg group(?:'s)? licen[sc]e
ftl | freetype | freetype(?: project)? licen[sc]e
imagemagick | imagemagick | imagemagick licen[sc]e
beerware | beer | beer-?ware licen[sc]e
json | json | json licen[sc]e
sspl-1.0 | server side | server side public licen[sc]e
busl-1.1 | business source | business source licen[sc]e
elastic-2.0 | elastic | elastic licen[sc]e(?: 2\.0)?
commons-clause | commons clause | commons clause(?: licen[sc]e condition)?
odbl-1.0 | open database | (?:odc )?open database licen[sc]e
odc-by-1.0 | open data commons | open data commons attribution licen[sc]e
pddl-1.0 | open data commons | open data commons public domain dedication(?: and licen[sc]e)?
cdla-permissive-2.0 | community data | community data licen[sc]e agreement
openrail | rail | (?:bigscience )?open ?rail(?:-m|\+\+)?(?: licen[sc]e)?
hippocratic-2.1 | hippocratic | hippocratic licen[sc]e
mulanpsl-2.0 | mulan | mulan (?:permissive software|psl) licen[sc]e
blueoak-1.0.0 | blue oak | blue oak model licen[sc]e
parity-7.0.0 | parity public | parity public licen[sc]e
cecill-2.1 | cecill | cecill(?:-[bc])?(?: free software)? licen[sc]e
nposl-3.0 | non-profit | non-profit open software licen[sc]e
watcom-1.0 | watcom | sybase open watcom public licen[sc]e
"""

# Label, keyword and pattern of what the licenses and their notices say.
SIGNATURES = r"""
mit | permission is hereby granted | permission is hereby granted, free of charge, to any person obtaining a copy of this software
mit | the software is provided | the software is provided ["'`]*as is["'`]*, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability
isc | permission to use, copy | permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted
bsd | redistribution and use | redistribution and use in source and binary forms, with or without modification, are permitted
bsd-3-clause | endorse or promote | neither the name of .{0,80} nor the names of its contributors may be used to endorse or promote products
bsd-4-clause | advertising materials | all advertising materials mentioning features or use of this software must display
apache-2.0 | apache.org/licenses | https?://www\.apache\.org/licenses/license-2\.0
apache-2.0 | you may not use this file | you may not use this file except in compliance with the license
gpl | free software foundation | it under the terms of the gnu general public license as published by the free software foundation
gpl-2.0 | either version 2 | either version 2 of the license, or \(at your option\) any later version
gpl-3.0 | either version 3 | either version 3 of the license, or \(at your option\) any later version
gpl | gnu.org/licenses | see <?https?://www\.gnu\.org/licenses/?>?
lgpl | lesser general public | it under the terms of the gnu lesser general public license as published by
agpl | affero general public | it under the terms of the gnu affero general public license as published by
mpl-2.0 | mozilla public license | this source code form is subject to the terms of the mozilla public license
epl-2.0 | eclipse.org/legal | https?://www\.eclipse\.org/legal/epl-2\.0
epl-1.0 | eclipse.org/legal | https?://www\.eclipse\.org/legal/epl-v10\.html
bsl-1.0 | boost.org/license | https?://www\.boost\.org/license_1_0\.txt
zlib | altered source versions | altered source versions must be plainly marked as such, and must not be misrepresented
unlicense | unencumbered software | this is free and unencumbered software released into the public domain
wtfpl | just do what the f | you just do what the f\w+ you want to
cc0-1.0 | publicdomain/zero | creativecommons\.org/publicdomain/zero/1\.0
cc-by-4.0 | licenses/by/4.0 | creativecommons\.org/licenses/by/4\.0
cc-by-3.0 | licenses/by/3.0 | creativecommons\.org/licenses/by/3\.0
cc-by-sa-4.0 | licenses/by-sa/4.0 | creativecommons\.org/licenses/by-sa/4\.0
cc-by-sa-3.0 | licenses/by-sa/3.0 | creativecommons\.org/licenses/by-sa/3\.0
cc-by-nc-4.0 | licenses/by-nc/4.0 | creativecommons\.org/licenses/by-nc/4\.0
cc-by-nc-sa-4.0 | licenses/by-nc-sa/4.0 | creativecommons\.org/licenses/by-nc-sa/4\.0
cc-by-nc-nd-4.0 | licenses/by-nc-nd/4.0 | creativecommons\.org/licenses/by-nc-nd/4\.0
ofl-1.1 | scripts.sil.org | scripts\.sil\.org/ofl
beerware | buy me a beer | (?:can|may) buy me a beer in return
public-domain | public domain | (?:is|are|been) (?:hereby )?(?:placed|released|dedicated|put)(?: in)?(?:to)? the public domain
public-domain | public domain | this (?:work|file|code|software|text|document) is in the public domain
proprietary | all rights reserved | (?:copyright|\(c\)|©)[^\n]{0,80}all rights reserved
proprietary | confidential | (?:proprietary and confidential|confidential and proprietary)
proprietary | without the prior written | may not be (?:reproduced|copied|distributed)[^\n]{0,80}without the prior written (?:permission|consent)
"""

#: Priority and score of the kinds of rule; a match inside one of a higher priority is suppressed.
KINDS = {"signature": (4, 1.0), "tag": (3, 1.0), "grant": (2, 0.9), "mention": (1, 0.6)}
TAG = r"spdx-license-identifier: ?(?:\(? ?[\w.+-]+ (?:and|or|with) )*\(? ?{id}(?:-only|-or-later|\+)?(?![\w.+-])"
GRANT = r"(?:licen[sc]ed|released|distributed|available|provided|published|covered|offered|shared) (?:\w+ ){{0,3}}(?:under|by) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:{name})"
GRANT_WORDS, TAG_WORD = "under/by", "spdx-license-identifier"


@dataclass(frozen=True)
class Rule:
    order: int
    label: str
    kind: str
    #: All of these, each as any of its alternatives, each as all of its words.
    keywords: tuple[tuple[tuple[str, ...], ...], ...]
    pattern: str

    @property
    def priority(self) -> int:
        return KINDS[self.kind][0]

    @property
    def score(self) -> float:
        return KINDS[self.kind][1]


def _spaces(pattern: str) -> str:
    """A blank, outside of classes, matches any run of space."""
    parts = re.split(r"(\[[^\]]*\])", pattern)
    return "".join(p.replace(" ", r"\s") if p.startswith("[") else p.replace(" ?", r"\s*").replace(" ", r"\s+") for p in parts)


def _table(text: str) -> list[list[str]]:
    return [[x.strip() for x in line.split(" | ", 2)] for line in text.strip().splitlines()]


def _gate(*keywords: str) -> tuple[tuple[tuple[str, ...], ...], ...]:
    return tuple(tuple(tuple(choice.split()) for choice in k.split("/")) for k in keywords)


def rules() -> list[Rule]:
    """All rules in order, the strongest kinds first."""
    found = [(label, "signature", (keyword,), pattern) for label, keyword, pattern in _table(SIGNATURES)]
    found = [(label, kind, (tuple((tuple(k[0].split()),)),), pattern) for label, kind, k, pattern in found]
    names = [(label, k.split(","), pattern) for label, k, pattern in _table(NAMES)]
    found += [(label, "tag", _gate(TAG_WORD, label), TAG.format(id=re.escape(label))) for label, _, _ in names]
    found += [(label, "grant", _gate(*keys, GRANT_WORDS), GRANT.format(name=pattern)) for label, keys, pattern in names]
    found += [(label, "mention", _gate(*keys), rf"(?:{pattern})") for label, keys, pattern in names]
    return [Rule(k, label, kind, gate, rf"(?<!\w){_spaces(pattern)}" if kind != "signature" else _spaces(pattern)) for k, (label, kind, gate, pattern) in enumerate(found)]
