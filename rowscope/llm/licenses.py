"""License scans by ordered signature rules.

Each rule has a label, a regex over the text's words, keywords that gate it, a priority and a weight.  The words are
joined by single spaces, so a rule sees the same string whatever punctuation stands between.  One pass of an automaton
finds the keywords, and a rule runs only where one of its own occurs.  Among detections, one that lies inside another of higher priority, or of equal priority
and greater length, is suppressed.  The base phrases are found in all texts and always stay.

Input columns with the names of results give way to these.  Null and empty texts have no words and no detections.  Whole texts are read, and equal texts get equal results.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rowscope.llm.common import lower_az, map_text, raw, strings, texts, words_of

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP = np.ones(256, bool)
_GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    keywords: tuple[str, ...]
    priority: int
    weight: float


# License families as (label, words of the name, versions).  Names and versions are public.
FAMILIES = [
    ("apache", "apache(?: software)?", "1 0|1 1|2 0|2"),
    ("mpl", "mozilla public|mpl", "1 0|1 1|2 0|2"),
    ("epl", "eclipse public|epl", "1 0|2 0"),
    ("cddl", "common development and distribution|cddl", "1 0|1 1"),
    ("cpl", "common public|cpl", "1 0"),
    ("eupl", "european union public|eupl", "1 0|1 1|1 2"),
    ("osl", "open software|osl", "1 0|2 0|2 1|3 0"),
    ("afl", "academic free|afl", "1 1|1 2|2 0|2 1|3 0"),
    ("artistic", "artistic", "1 0|2 0"),
    ("ofl", "sil open font|open font|ofl", "1 0|1 1"),
    ("zpl", "zope public|zpl", "1 1|2 0|2 1"),
    ("lppl", "latex project public|lppl", "1 0|1 1|1 2|1 3"),
    ("php", "php", "3 0|3 01"),
    ("psf", "python software foundation|psf", "2"),
    ("bsl", "boost software|bsl", "1 0"),
    ("upl", "universal permissive|upl", "1 0"),
    ("ecl", "educational community|ecl", "1 0|2 0"),
    ("odbl", "open database|odbl", "1 0"),
    ("fdl", "gnu free documentation|gfdl|fdl", "1 1|1 2|1 3"),
    ("lgpl", "(?:gnu )?(?:lesser|library) general public|lgpl", "2 0|2 1|2|3 0|3"),
    ("agpl", "(?:gnu )?affero general public|agpl", "1 0|3 0|3"),
    ("gpl", "(?:gnu )?general public|gnu gpl|gpl", "1 0|2 0|2|3 0|3"),
]
# Creative Commons elements.
CC_PARTS = {"by": "attribution", "by sa": "attribution share ?alike", "by nd": "attribution no ?deriv(?:s|atives)", "by nc": "attribution non ?commercial", "by nc sa": "attribution non ?commercial share ?alike", "by nc nd": "attribution non ?commercial no ?deriv(?:s|atives)"}
CC_VERSIONS = "1 0|2 0|2 5|3 0|4 0"
# Signatures that are not a family with versions: (label, words, keyword, priority, weight).
SINGLE = [
    ("mit", "mit license|mit licence|mit licensed|expat license|licensed under (?:the )?mit", "licen", 60, 0.9),
    ("mit", "spdx licen[sc]e identifier mit", "spdx", 90, 1.0),
    ("isc", "spdx licen[sc]e identifier isc", "spdx", 90, 1.0),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby granted", 70, 0.95),
    ("bsd", "bsd license|bsd licence|bsd style|bsd licensed|berkeley software distribution", "bsd|berkeley", 50, 0.8),
    ("bsd-2-clause", "(?:2|two) clause bsd|bsd (?:2|two) clause|simplified bsd|freebsd license", "bsd", 60, 0.9),
    ("bsd-3-clause", "(?:3|three) clause bsd|bsd (?:3|three) clause|new bsd|revised bsd|modified bsd", "bsd", 60, 0.9),
    ("bsd-4-clause", "(?:4|four) clause bsd|bsd (?:4|four) clause|original bsd", "bsd", 60, 0.9),
    ("bsd", "redistribution and use in source and binary forms", "redistribution", 65, 0.9),
    ("isc", "isc license|isc licence|licensed under (?:the )?isc", "licen", 60, 0.9),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use", 70, 0.95),
    ("zlib", "zlib license|zlib libpng license|zlib licence", "zlib", 60, 0.9),
    ("unlicense", "unlicense", "unlicense", 60, 0.9),
    ("wtfpl", "wtfpl|do what the fuck you want to public license", "wtfpl|do what", 60, 0.9),
    ("ms-pl", "microsoft public license|ms pl", "microsoft|ms pl", 60, 0.9),
    ("ms-rl", "microsoft reciprocal license|ms rl", "microsoft|ms rl", 60, 0.9),
    ("postgresql", "postgresql license", "postgresql", 60, 0.9),
    ("openssl", "openssl license", "openssl", 60, 0.9),
    ("ncsa", "university of illinois ncsa|ncsa open source license", "ncsa", 60, 0.9),
    ("cc0", "cc0|cc zero|creative commons zero|no rights reserved", "cc0|cc zero|commons zero|no rights", 65, 0.9),
    ("cc", "creative commons", "creative commons|creativecommons", 30, 0.6),
    ("public-domain", "public domain|domaine public|dominio público|gemeinfrei", "public domain|domaine public|dominio p|gemeinfrei", 40, 0.7),
    ("copyright", "copyright (?:c )?(?:19|20)\\d\\d", "copyright", 35, 0.6),
    ("copyright", "copyright", "copyright", 10, 0.3),
    ("reserved", "some rights reserved|tous droits réservés|todos los derechos reservados|alle rechte vorbehalten", "rights reserved|réservés|reservados|vorbehalten", 40, 0.8),
    ("no-warranty", "without warranty of any kind|without any warranty|as is without warrant(?:y|ies)", "warrant", 30, 0.5),
    ("proprietary", "proprietary and confidential|proprietary license|end user license agreement|eula", "proprietary|license agreement|eula", 50, 0.7),
    ("licensed", "licensed under|released under the|distributed under the terms|subject to the terms of", "licensed|released under|distributed under|subject to the", 5, 0.3),
]


# Signatures out of the texts and notices of public licenses: label, priority, weight, regex.
SIGNATURES = r"""
mit 70 .95 the above copyright notice and this permission notice shall be included in all copies
mit 40 .6 without restriction including without limitation the rights to use copy modify merge publish
mit 40 .6 to permit persons to whom the software is furnished to do so
mit 40 .6 the software is provided as is without warranty of any kind express or implied
mit 40 .6 in no event shall the authors or copyright holders be liable for any claim
mit-0 75 .95 mit no attribution(?: licen[sc]e)?
x11 70 .9 except as contained in this notice the names? of
x11 60 .9 x(?:11| consortium) licen[sc]e
bsd 65 .9 redistributions of source code must retain the above copyright notice
bsd 65 .9 redistributions in binary form must reproduce the above copyright notice
bsd-3-clause 70 .95 neither the names? of (?:\w+ ){1,12}may be used to endorse or promote products
bsd-4-clause 75 .95 all advertising materials mentioning features or use of this software must display
bsd 40 .6 this software is provided by the copyright holders and contributors as is
bsd 40 .6 in no event shall the copyright (?:holders?|owners?) or contributors be liable
bsd 45 .7 regents of the university of california
bsd-2-clause-views 75 .95 the views and conclusions contained in the software and documentation are those of the authors
0bsd 75 .95 zero clause bsd|bsd zero clause|0bsd
isc 72 .95 permission to use copy modify (?:and|or|and or) distribute this software (?:for any purpose|and its documentation)
hpnd 65 .9 historical permission notice and disclaimer
apache-2.0 75 .95 licensed under the apache licen[sc]e version 2
apache-2.0 45 .7 you may not use this file except in compliance with the license
apache-2.0 40 .6 unless required by applicable law or agreed to in writing
apache-2.0 80 .95 apache org licenses license 2 0
apache 60 .9 licensed to the apache software foundation
apache-1.1 60 .85 this product includes software developed by the apache (?:software foundation|group)
apache-2.0 40 .6 distributed on an as is basis without warranties or conditions of any kind
apache-2.0 45 .7 grant of patent license
apache-2.0 45 .7 grant of copyright license
apache-2.0-llvm 85 .95 apache(?: license)?(?: v2 0| version 2 0| 2 0)? with llvm exceptions?
gpl 60 .85 this (?:program|file|library|package) is free software you can redistribute it and or modify it
gpl 55 .85 under the terms of the gnu general public licen[sc]e
gpl 35 .6 as published by the free software foundation
gpl-2-or-later 70 .9 either version 2(?: \d)? of the licen[sc]e or at your option any later version
gpl-3-or-later 70 .9 either version 3(?: \d)? of the licen[sc]e or at your option any later version
gpl 60 .85 you should have received a copy of the gnu general public licen[sc]e
lgpl 62 .9 you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e
agpl 64 .9 you should have received a copy of the gnu affero general public licen[sc]e
gpl 30 .5 free software foundation inc (?:51 franklin|59 temple|675 mass)
gpl 55 .85 gnu org (?:licenses|copyleft) gpl
lgpl 57 .85 gnu org (?:licenses|copyleft) lgpl
agpl 57 .85 gnu org licenses agpl
fdl 57 .85 gnu org (?:licenses|copyleft) fdl
gpl 45 .7 everyone is permitted to copy and distribute verbatim copies of this license document
gpl 50 .8 the licenses for most software are designed to take away your freedom
gpl 40 .7 this is free software and you are welcome to redistribute it under certain conditions
gpl 35 .5 comes with absolutely no warranty
gpl-classpath 75 .9 classpath exception
gpl-gcc-exception 75 .9 gcc runtime library exception
gpl-linking-exception 70 .9 linking (?:this library|\w+) statically or dynamically with other modules
gpl-font-exception 70 .85 gpl font exception|font embedding exception
gpl-bison-exception 70 .85 bison exception|special exception (?:\w+ ){0,12}bison parser
gpl-autoconf-exception 70 .85 autoconf exception|configuration script generated by autoconf
gpl-openssl-exception 70 .85 openssl exception|permission to link (?:\w+ ){1,10}openssl
agpl 60 .85 remote network interaction
lgpl 50 .8 work that uses the library|works that use the library
gpl 45 .7 copyleft
mpl-2.0 75 .95 this source code form is subject to the terms of the mozilla public licen[sc]e
mpl-2.0 70 .9 mozilla org mpl 2 0
mpl-2.0 60 .9 incompatible with secondary licenses
mpl 65 .9 the contents of this file are subject to the mozilla public licen[sc]e
npl 60 .9 netscape public licen[sc]e
epl 70 .9 accompanying materials are made available under the terms of the eclipse public licen[sc]e
epl 65 .9 eclipse org legal epl
edl 65 .9 eclipse distribution licen[sc]e
cddl 70 .9 subject to the terms of the common development and distribution licen[sc]e
cpl 60 .9 ibm common public licen[sc]e
ipl 60 .9 ibm public licen[sc]e
lpl 60 .9 lucent public licen[sc]e
intel 60 .9 intel (?:open source|simplified software) licen[sc]e
nokia 60 .9 nokia open source licen[sc]e
spl 60 .9 sun public licen[sc]e
sissl 60 .9 sun industry standards source licen[sc]e
oracle-bcl 60 .9 (?:oracle|sun microsystems(?: inc)?) binary code licen[sc]e
otn 60 .9 oracle technology network licen[sc]e
ms-lpl 62 .9 microsoft limited public licen[sc]e
ms-eula 60 .9 microsoft software licen[sc]e terms
ms-shared 55 .8 microsoft shared source|microsoft reference source licen[sc]e
apsl 60 .9 apple public source licen[sc]e|apsl
interbase 60 .9 interbase public licen[sc]e
jabber 60 .9 jabber open source licen[sc]e
motosoto 60 .9 motosoto(?: open source)? licen[sc]e
naumen 60 .9 naumen public licen[sc]e
nethack 62 .9 nethack general public licen[sc]e
oclc 60 .9 oclc research public licen[sc]e
opengroup 60 .9 open group test suite licen[sc]e
ricoh 60 .9 ricoh source code public licen[sc]e
sleepycat 60 .9 sleepycat(?: public)? licen[sc]e
watcom 60 .9 sybase open watcom public licen[sc]e
vovida 60 .9 vovida software licen[sc]e
w3c 60 .9 w3c software (?:notice and (?:document )?)?licen[sc]e
w3c-doc 60 .9 w3c document licen[sc]e
wxwindows 62 .9 wxwindows library licen[sc]e
xnet 60 .9 x net licen[sc]e
zend 60 .9 zend(?: engine)? licen[sc]e
cnri-python 62 .9 cnri (?:open source )?(?:python )?licen[sc]e agreement
cwi 55 .85 stichting mathematisch centrum
python 55 .85 python licen[sc]e|licensed under the python
ruby 55 .85 ruby s licen[sc]e|ruby licen[sc]e
perl 60 .9 under the same terms as perl(?: \d| itself)?
vim 55 .85 vim licen[sc]e|vim is charityware
tcl 55 .85 tcl tk licen[sc]e|tcl licen[sc]e
lppl 60 .9 distributed (?:and or modified )?under the conditions of the latex project public licen[sc]e
openldap 60 .9 openldap public licen[sc]e
ssleay 60 .9 (?:original )?ssleay licen[sc]e|this product includes cryptographic software written by eric young
openssl 60 .9 this product includes software developed by the openssl project
php 60 .9 this product includes php(?: software)?|php net software
info-zip 60 .9 info zip licen[sc]e
libpng 60 .9 libpng licen[sc]e|png reference library
libtiff 60 .9 libtiff licen[sc]e|sam leffler and silicon graphics
ijg 60 .9 independent jpeg group|ijg licen[sc]e
curl 60 .9 curl licen[sc]e
bzip2 60 .9 bzip2 licen[sc]e
zlib 65 .9 this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib 50 .8 altered source versions must be plainly marked as such
ftl 60 .9 freetype (?:project )?licen[sc]e|portions of this software are copyright (?:\w+ ){0,6}the freetype project
imagemagick 60 .9 imagemagick licen[sc]e
jasper 60 .9 jasper (?:software )?licen[sc]e
json 70 .95 the software shall be used for good not evil
beerware 70 .95 beerware|beer ware licen[sc]e|you can buy me a beer in return
wtfpl 70 .95 do what the f\w* you want to
unlicense 75 .95 this is free and unencumbered software released into the public domain
unlicense 60 .8 anyone is free to copy modify publish use compile sell or distribute this software
cc0 75 .95 creativecommons org publicdomain zero
cc0 60 .9 waived all copyright and related or neighboring rights
pdm 65 .9 creativecommons org publicdomain mark|public domain mark
public-domain 45 .8 dedicated to the public domain|placed in the public domain|released into the public domain
artistic 60 .9 clarified artistic licen[sc]e|artistic licen[sc]e
blueoak 60 .9 blue oak model licen[sc]e
parity 60 .9 parity public licen[sc]e
prosperity 60 .9 prosperity public licen[sc]e
polyform 60 .9 polyform (?:noncommercial|small business|shield|strict|perimeter|internal use|free trial)(?: licen[sc]e)?
sspl 65 .95 server side public licen[sc]e|sspl
busl 65 .95 business source licen[sc]e|busl
elastic 60 .9 elastic licen[sc]e(?: 2 0)?
commons-clause 65 .95 commons clause
rsal 60 .9 redis source available licen[sc]e
confluent 60 .9 confluent community licen[sc]e
cockroach 60 .9 cockroach(?:db)? community licen[sc]e
timescale 60 .9 timescale licen[sc]e
fsl 60 .9 functional source licen[sc]e
hippocratic 60 .9 hippocratic licen[sc]e
anti-996 60 .9 anti 996 licen[sc]e
cecill-b 66 .9 cecill b
cecill-c 66 .9 cecill c
cecill 60 .9 cecill(?: free software)?(?: licen[sc]e)?
etalab 60 .9 licence ouverte(?: open licence)?|etalab
ogl 60 .9 open government licen[sc]e
crown 45 .8 crown copyright
dl-de-by 60 .9 datenlizenz deutschland|dl de by
odc-by 60 .9 open data commons attribution
pddl 60 .9 open data commons public domain dedication|pddl
odbl 60 .9 opendatacommons org licenses odbl
cdla 60 .9 community data licen[sc]e agreement|cdla (?:permissive|sharing)
fal 60 .9 free art licen[sc]e|licence art libre
dsl 60 .9 design science licen[sc]e
opl 60 .9 open publication licen[sc]e
fdl 60 .9 permission is granted to copy distribute and or modify this document
cdl 60 .9 common documentation licen[sc]e
ofl 65 .9 this font software is licensed under the sil open font licen[sc]e
bitstream-vera 60 .9 bitstream vera
ubuntu-font 60 .9 ubuntu font licen[sc]e
gust-font 60 .9 gust font (?:source )?licen[sc]e
ipa-font 60 .9 ipa font licen[sc]e
arphic 60 .9 arphic public licen[sc]e
adobe-glyph 55 .85 adobe glyph list licen[sc]e
stix 55 .85 stix fonts? licen[sc]e
cern-ohl 60 .9 cern open hardware licen[sc]e
tapr-ohl 60 .9 tapr open hardware licen[sc]e
solderpad 60 .9 solderpad hardware licen[sc]e
nasa 60 .9 nasa open source agreement
us-gov 50 .8 work of the united states government|not subject to copyright protection in the united states
mulan 60 .9 mulan (?:permissive software|public) licen[sc]e|mulan psl
openrail 60 .9 open ?rail(?: m)?(?: licen[sc]e)?|responsible ai licen[sc]e
llama 60 .9 llama (?:\d (?:\d )?)?community licen[sc]e
gemma 60 .9 gemma terms of use
simple 60 .9 simple public licen[sc]e
aal 60 .9 attribution assurance licen[sc]e
rpl 60 .9 reciprocal public licen[sc]e
nosl 60 .9 non profit open software licen[sc]e
frameworx 60 .9 frameworx open licen[sc]e
fair 55 .85 usage of the works is permitted provided that this instrument is retained
entessa 60 .9 entessa public licen[sc]e
eiffel 60 .9 eiffel forum licen[sc]e
datagrid 60 .9 eu datagrid software licen[sc]e
catosl 60 .9 computer associates trusted open source licen[sc]e
cua 60 .9 cua office public licen[sc]e
lbnl-bsd 60 .9 lawrence berkeley national labs bsd
miros 60 .9 miros licen[sc]e
multics 60 .9 multics licen[sc]e
ntp 60 .9 ntp licen[sc]e
oset 60 .9 oset public licen[sc]e
qpl 60 .9 q public licen[sc]e
rpsl 60 .9 realnetworks public source licen[sc]e
smlnj 60 .9 standard ml of new jersey
unicode 60 .9 unicode (?:inc )?licen[sc]e agreement|unicode terms of use
xfree86 60 .9 xfree86 licen[sc]e
ypl 60 .9 yahoo public licen[sc]e
zimbra 60 .9 zimbra public licen[sc]e
ecos 60 .9 ecos licen[sc]e
openpbs 60 .9 openpbs software licen[sc]e|torque software licen[sc]e
tmate 55 .85 tmate open source licen[sc]e
proprietary 45 .7 trade secrets? of|contains trade secrets
proprietary 50 .8 no part of this (?:publication|book|document|work|site|website) may be reproduced
proprietary 45 .7 may not be reproduced in any form
proprietary 50 .8 unauthori[sz]ed (?:copying|reproduction|distribution)(?: or (?:copying|reproduction|distribution))? of this
proprietary 40 .6 for internal use only
proprietary 40 .6 subject to (?:a|the terms of a) non disclosure agreement
proprietary 35 .6 by installing or using (?:this|the) software
shareware 40 .6 this (?:is|software is|program is) shareware
freeware 40 .6 this (?:is|software is|program is) freeware
permission 30 .5 (?:re)?printed with permission|used with permission
licensed 20 .5 licencié sous|publié sous(?: la)? licence|sous licence
licensed 20 .5 bajo(?: la| una)? licencia
licensed 20 .5 lizenziert unter|unter der lizenz
copyright 20 .4 droits d auteur|derechos de autor|urheberrechtlich geschützt
"""


def _keys(pattern: str) -> tuple[str, ...]:
    """For each alternative of a pattern the longest text that all its matches hold."""
    parts, depth, begin = [], 0, 0
    for i, c in enumerate(pattern):
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            parts.append(pattern[begin:i])
            begin = i + 1
    out = []
    for p in [*parts, pattern[begin:]]:
        while (q := re.sub(r"\([^()]*\)(?:\{[\d,]+\}|[?*])?", "\0", p)) != p:
            p = q
        p = re.sub(r"(?:\[[^]]*\]|\\\w|[^\\])(?:[?*]|\{0?,?\d*\})|\[[^]]*\]|\\\w[+]?", "\0", p)
        out.append(max(p.split("\0"), key=len).strip())
    return tuple(out)


def build_rules() -> list[Rule]:
    """All rules in order of priority: written signatures, and the names of families with their versions."""
    rules = [Rule(label, f"(?:{p})", tuple(k.split("|")), pr, w) for label, p, k, pr, w in SINGLE]
    for line in SIGNATURES.strip().splitlines():
        label, pr, w, p = line.split(" ", 3)
        rules.append(Rule(label, f"(?:{p})", _keys(p), int(pr), float(w)))
    for label, name, versions in FAMILIES:
        keys = tuple(re.sub(r"\(\?:.*?\)\??", "", n).strip() for n in name.split("|"))
        keys = tuple(k for k in keys if k) if "(?:" not in name else (label, "public", "apache")
        rules.append(Rule(label, rf"(?:{name})(?: public)? licen[sc]e", keys, 50, 0.8))
        for v in versions.split("|"):
            tag = f"{label}-{v.replace(' ', '.')}"
            rules.append(Rule(tag, rf"(?:{name})(?: licen[sc]e)?(?: v| version| v ?er)? ?{v}(?: only)?", keys, 70, 0.9))
            rules.append(Rule(f"{tag}-or-later", rf"(?:{name})(?: licen[sc]e)?(?: v| version)? ?{v}(?: \w+){{0,6}}? or (?:at your option )?(?:any )?later", keys, 80, 0.95))
            rules.append(Rule(tag, rf"spdx licen[sc]e identifier {label} {v}(?: only)?", ("spdx",), 90, 1.0))
    for parts, long in CC_PARTS.items():
        label = "cc-" + parts.replace(" ", "-")
        rules.append(Rule(label, rf"(?:cc {parts}|creative commons {long})(?: \d \d)?", ("cc by", "creative commons"), 50 + 2 * len(parts), 0.8))
        rules.append(Rule(label, rf"creativecommons org licenses {parts}(?: \d \d)?", ("creativecommons",), 60 + 2 * len(parts), 0.9))
        for v in CC_VERSIONS.split("|"):
            tag = f"{label}-{v.replace(' ', '.')}"
            rules.append(Rule(tag, rf"(?:cc {parts}|creative commons {long}) {v}", ("cc by", "creative commons"), 60 + 2 * len(parts), 0.9))
            rules.append(Rule(tag, rf"creativecommons org licenses {parts} {v}", ("creativecommons",), 80 + 2 * len(parts), 0.95))
    return sorted(rules, key=lambda r: (-r.priority, r.label, r.pattern))


@dataclass(frozen=True)
class Found:
    label: str
    first: int
    last: int
    priority: int
    weight: float


class Scanner:
    def __init__(self, rules: list[Rule] | None = None):
        self.rules = [(r, re.compile(rf"(?<! ){r.pattern}(?![^ ])".replace("(?<! )", "(?<![^ ])"))) for r in (rules or build_rules())]
        import ahocorasick

        self.keywords = ahocorasick.Automaton()
        for i, (r, _) in enumerate(self.rules):
            for k in r.keywords:
                self.keywords.add_word(k, (*self.keywords.get(k, ()), i))
        self.keywords.make_automaton()
        self.word = re.compile(WORD)
        self.base = [(label, re.compile(rf"(?<![^ ]){p}(?![^ ])")) for p, label in BASE.items()]

    def scan(self, lowered: str) -> tuple[list[Found], list[Found]]:
        """(base places, surviving detections) of a text whose A-Z are lowered; positions count words from 0."""
        line = " ".join(self.word.findall(lowered))
        gated = sorted({i for _, own in self.keywords.iter(line) for i in own})
        base = [(label, m) for label, p in self.base for m in p.finditer(line)]
        hits = [(r, m) for r, p in (self.rules[i] for i in gated) for m in p.finditer(line)]
        if not base and not hits:
            return [], []
        spaces = np.flatnonzero(np.fromiter(map(ord, line), np.uint32, len(line)) == 32)

        def at(m: re.Match) -> tuple[int, int]:
            a, b = np.searchsorted(spaces, [m.start(), m.end()])
            return int(a), int(b)

        return [Found(label, *at(m), 100, 0.8) for label, m in base], suppress([Found(r.label, *at(m), r.priority, r.weight) for r, m in hits])


def suppress(hits: list[Found]) -> list[Found]:
    """Drop a hit inside one of higher priority, or of equal priority and greater length (or the same span, earlier in order)."""
    ranked = sorted(set(hits), key=lambda h: (-h.priority, h.first - h.last, h.first, h.label))
    kept: list[Found] = []
    firsts: list[int] = []  # kept spans of which none holds another, by start and so by end
    ends: list[int] = []
    for h in ranked:
        i = bisect_right(firsts, h.first)
        if i and ends[i - 1] >= h.last:
            continue
        kept.append(h)
        i = bisect_left(firsts, h.first)
        j = bisect_right(ends, h.last)
        firsts[i : max(i, j)], ends[i : max(i, j)] = [h.first], [h.last]
    return sorted(kept, key=lambda h: (h.first, h.last, h.label))


def scan_documents(docs: DataFrame, text: str = "text", spans: bool = False) -> DataFrame:
    """All columns but the text, with word and place counts, labels, score and, if asked, each detection's span."""
    span = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))
    new = [("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()), ("base_labels", T.StringType()), ("labels", T.StringType()), ("score", T.DoubleType())]
    new += [("spans", span)] * spans
    taken = {n for n, _ in new}
    keep = [c for c in docs.columns if c != text and c not in taken]
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(n, t) for n, t in new)])
    state: list[Scanner] = []

    def run(batch: pa.RecordBatch) -> dict:
        if not state:
            state.append(Scanner())
        arr = texts(batch, text)
        buf, off = raw(arr)
        _, _, doc = words_of(buf, off, _GAP)
        out: dict[str, list] = {n: [] for n, _ in new[1:]}
        for low in strings(lower_az(buf), off):
            base, more = state[0].scan(low)
            firsts = [b.first for b in base]
            labels = {b.label for b in base}
            out["n_base"].append(len(base))
            out["first_word"].append(min(firsts, default=None))
            out["last_word"].append(max(firsts, default=None))
            out["base_labels"].append(",".join(sorted(labels)))
            out["labels"].append(",".join(sorted(labels | {m.label for m in more})))
            out["score"].append(1.0 - float(np.prod([1 - f.weight for f in [*base, *more]])) if base or more else 0.0)
            if spans:
                out["spans"].append([{"label": f.label, "first": f.first, "last": f.last} for f in [*base, *more]])
        return out | {"n_words": np.bincount(doc, minlength=len(arr))}

    return map_text(docs.select(*keep, text), text, run, schema)
