"""The rules of license scans: a table written by hand, in order of priority.

Each line is a rule: label, keyword, regular expression over a text's words in lower case with one space between.
The keyword is a word that every match has. Within a section rules have one priority and one confidence; an earlier
section overrules a later one.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    priority: int
    confidence: float
    regex: str  # from the space before its first word up to the space after its last


# Identifiers as in file headers and package manifests.
IDENTIFIERS = """
mit                  spdx        spdx license identifier mit
mit-0                spdx        spdx license identifier mit 0
apache-1.1           spdx        spdx license identifier apache 1 1
apache-2             spdx        spdx license identifier apache 2 0
gpl-1                spdx        spdx license identifier gpl 1 0(?: only| or later)?
gpl-2                spdx        spdx license identifier gpl 2 0(?: only| or later)?
gpl-3                spdx        spdx license identifier gpl 3 0(?: only| or later)?
lgpl-2               spdx        spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-2.1             spdx        spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-3               spdx        spdx license identifier lgpl 3 0(?: only| or later)?
agpl-3               spdx        spdx license identifier agpl 3 0(?: only| or later)?
bsd-2                spdx        spdx license identifier bsd 2 clause(?: patent)?
bsd-3                spdx        spdx license identifier bsd 3 clause(?: clear)?
bsd-4                spdx        spdx license identifier bsd 4 clause
0bsd                 spdx        spdx license identifier 0bsd
isc                  spdx        spdx license identifier isc
mpl-1.1              spdx        spdx license identifier mpl 1 1
mpl-2                spdx        spdx license identifier mpl 2 0(?: no copyleft exception)?
epl-1                spdx        spdx license identifier epl 1 0
epl-2                spdx        spdx license identifier epl 2 0
cddl-1               spdx        spdx license identifier cddl 1 [01]
artistic-2           spdx        spdx license identifier artistic 2 0
boost-1              spdx        spdx license identifier bsl 1 0
zlib                 spdx        spdx license identifier zlib
unlicense            spdx        spdx license identifier unlicense
wtfpl                spdx        spdx license identifier wtfpl
eupl-1.2             spdx        spdx license identifier eupl 1 2
ofl-1.1              spdx        spdx license identifier ofl 1 1
postgresql           spdx        spdx license identifier postgresql
python-2             spdx        spdx license identifier (?:python|psf) 2 0
openssl              spdx        spdx license identifier openssl
ms-pl                spdx        spdx license identifier ms pl
odbl-1               spdx        spdx license identifier odbl 1 0
gfdl                 spdx        spdx license identifier gfdl 1 [123](?: only| or later)?
cc0-1                spdx        spdx license identifier cc0 1 0
cc-by                spdx        spdx license identifier cc by [1-4] 0
cc-by-sa             spdx        spdx license identifier cc by sa [1-4] 0
cc-by-nd             spdx        spdx license identifier cc by nd [1-4] 0
cc-by-nc             spdx        spdx license identifier cc by nc [1-4] 0
cc-by-nc-sa          spdx        spdx license identifier cc by nc sa [1-4] 0
cc-by-nc-nd          spdx        spdx license identifier cc by nc nd [1-4] 0
mulan-2              spdx        spdx license identifier mulanpsl 2 0
bsl-1.1              spdx        spdx license identifier busl 1 1
sspl-1               spdx        spdx license identifier sspl 1 0
"""

# Sentences of the licenses themselves.
SENTENCES = """
mit                  obtaining   permission is hereby granted free of charge to any person obtaining a copy of this software
mit                  sublicense  to use copy modify merge publish distribute sublicense and or sell copies of the software
mit                  substantial the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0                deal        permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
isc                  fee         permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
0bsd                 fee         permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is
bsd                  binary      redistribution and use in source and binary forms with or without modification are permitted
bsd-2                source      redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd-3                endorse     (?:neither the name of .{1,80}|the name of .{1,80} may not) (?:nor the names of its contributors may )?be used to endorse or promote products
bsd-4                advertising all advertising materials mentioning features or use of this software must display
apache-2             unless      unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2             obtain      you may obtain a copy of the license at https? www apache org licenses license 2 0(?: txt)?
apache-1.1           apache      this product includes software developed by the apache software foundation
gpl                  redistribute this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl-2                foundation  as published by the free software foundation either version 2 of the license
gpl-2                foundation  as published by the free software foundation version 2
gpl-3                foundation  as published by the free software foundation either version 3 of the license
gpl-3                foundation  as published by the free software foundation version 3
lgpl                 redistribute this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl-2.1             foundation  as published by the free software foundation either version 2 1 of the license
lgpl-2.1             foundation  as published by the free software foundation version 2 1
agpl-3               affero      you should have received a copy of the gnu affero general public license
gpl                  received    you should have received a copy of the gnu general public license
lgpl                 received    you should have received a copy of the gnu (?:lesser|library) general public license
mpl-2                mozilla     this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1              mozilla     the contents of this file are subject to the mozilla public license version 1 1
epl-1                eclipse     made available under the terms of the eclipse public license v1 0
epl-2                eclipse     made available under the terms of the eclipse public license v?(?: )?2 0
cddl-1               distribution the contents of this file are subject to the terms of the common development and distribution license
boost-1              boost       distributed under the boost software license version 1 0
zlib                 altered     altered source versions must be plainly marked as such and must not be misrepresented
zlib                 warranty    this software is provided as is without any express or implied warranty in no event will the authors be held liable
unlicense            unencumbered this is free and unencumbered software released into the public domain
wtfpl                fuck        you just do what the fuck you want to
artistic-2           artistic    you may distribute your modified version as source .{1,80} artistic license
ofl-1.1              sil         this font software is licensed under the sil open font license version 1 1
python-2             psf         psf is making python available to licensee on an as is basis
openssl              openssl     this product includes software developed by the openssl project
ms-pl                reciprocal  this license governs use of the accompanying software .{1,120} reciprocal
odbl-1               database    this .{1,60} is made available under the open database license
gfdl                 invariant   with no invariant sections no front cover texts and no back cover texts
cc0-1                dedicated   the person who associated a work with this deed has dedicated the work to the public domain
cc-by                attribution you must give appropriate credit (?:.{0,60} )?attribution
public-domain        dedicate    (?:i|we) (?:hereby )?dedicate (?:this|the) (?:work|software|text|file) to the public domain
proprietary          disclose    you may not (?:use )?(?:copy )?(?:modify )?(?:or )?disclose (?:this|the) (?:software|document|information)
proprietary          unauthorized unauthorized (?:copying|use|reproduction)(?: or distribution)? of this (?:file|software|document|material)(?: via any medium)? is strictly prohibited
"""

# A license by name and version.
VERSIONED = """
apache-2             apache      apache license version 2(?: 0)?
apache-2             apache      apache license v?2(?: 0)?
apache-2             apache      apache public license (?:version )?2(?: 0)?
apache-2             apache      apache software license (?:version )?2(?: 0)?
apache-2             apache      apache (?:version )?2(?: 0)? licen[cs]ed?
apache-2             apache      licen[cs]ed under (?:the )?apache (?:version )?2(?: 0)?
apache-2             apachev2    apachev2
apache-1.1           apache      apache (?:software )?license (?:version )?1 1
apache-1             apache      apache (?:software )?license (?:version )?1 0
gpl-1                general     gnu general public licen[cs]e v(?:ersion )?1(?: 0)?
gpl-2                general     (?:gnu )?general public licen[cs]e v(?:ersion )?2(?: 0)?(?: only| or (?:any )?later(?: version)?)?
gpl-3                general     (?:gnu )?general public licen[cs]e v(?:ersion )?3(?: 0)?(?: only| or (?:any )?later(?: version)?)?
gpl-2                gpl         (?:gnu )?gpl v?(?:ersion )?2(?: 0)?(?: only| or later)?
gpl-3                gpl         (?:gnu )?gpl v?(?:ersion )?3(?: 0)?(?: only| or later)?
gpl-2                gplv2       (?:gnu )?gplv2(?: only| or later)?
gpl-3                gplv3       (?:gnu )?gplv3(?: only| or later)?
gpl-2                gpl2        (?:gnu )?gpl2
gpl-3                gpl3        (?:gnu )?gpl3
lgpl-2               library     gnu library general public licen[cs]e v(?:ersion )?2(?: 0)?
lgpl-2.1             lesser      (?:gnu )?lesser general public licen[cs]e v(?:ersion )?2 1(?: only| or later)?
lgpl-3               lesser      (?:gnu )?lesser general public licen[cs]e v(?:ersion )?3(?: 0)?(?: only| or later)?
lgpl-2.1             lgpl        (?:gnu )?lgpl v?(?:ersion )?2 1(?: only| or later)?
lgpl-2               lgpl        (?:gnu )?lgpl v?(?:ersion )?2 0
lgpl-3               lgpl        (?:gnu )?lgpl v?(?:ersion )?3(?: 0)?(?: only| or later)?
lgpl-2.1             lgplv2      (?:gnu )?lgplv2 1
lgpl-3               lgplv3      (?:gnu )?lgplv3
agpl-3               affero      (?:gnu )?affero general public licen[cs]e v(?:ersion )?3(?: 0)?(?: only| or later)?
agpl-3               agpl        (?:gnu )?agpl v?(?:ersion )?3(?: 0)?(?: only| or later)?
agpl-3               agplv3      (?:gnu )?agplv3
bsd-2                bsd         bsd 2 clause(?: simplified)?
bsd-2                bsd         (?:2|two) clause bsd
bsd-2                bsd         simplified bsd
bsd-2                freebsd     freebsd licen[cs]e
bsd-3                bsd         bsd 3 clause(?: new| revised)?
bsd-3                bsd         (?:3|three) clause bsd
bsd-3                bsd         (?:new|modified|revised) bsd
bsd-4                bsd         bsd 4 clause
bsd-4                bsd         (?:4|four) clause bsd
bsd-4                bsd         original bsd
0bsd                 zero        zero clause bsd
0bsd                 0bsd        0bsd
mpl-1.0              mozilla     mozilla public licen[cs]e v(?:ersion )?1 0
mpl-1.1              mozilla     mozilla public licen[cs]e v(?:ersion )?1 1
mpl-2                mozilla     mozilla public licen[cs]e v?(?:ersion )?2(?: 0)?
mpl-1.1              mpl         mpl v?(?:ersion )?1 1
mpl-2                mpl         mpl v?(?:ersion )?2(?: 0)?
epl-1                eclipse     eclipse public licen[cs]e v?(?:ersion )?1(?: 0)?
epl-2                eclipse     eclipse public licen[cs]e v?(?:ersion )?2(?: 0)?
epl-2                epl         epl v?2 0
edl-1                eclipse     eclipse distribution licen[cs]e (?:v )?1 0
cddl-1               cddl        cddl v?(?:ersion )?1(?: [01])?
cddl-1               distribution common development and distribution licen[cs]e (?:version )?1(?: [01])?
artistic-1           artistic    artistic licen[cs]e (?:version )?1(?: 0)?
artistic-2           artistic    artistic licen[cs]e v?(?:ersion )?2(?: 0)?
boost-1              boost       boost software licen[cs]e (?:version )?1(?: 0)?
eupl-1.1             eupl        eupl v?(?:ersion )?1 1
eupl-1.2             eupl        eupl v?(?:ersion )?1 2
eupl-1.2             european    european union public licen[cs]e (?:v|version )?1 2
ofl-1.1              font        (?:sil )?open font licen[cs]e (?:version )?1 1
python-2             python      python software foundation licen[cs]e (?:version )?2
zpl-2.1              zope        zope public licen[cs]e (?:version )?2 1
afl-3                academic    academic free licen[cs]e (?:version )?3 0
osl-3                open        open software licen[cs]e (?:version )?3 0
ecl-2                educational educational community licen[cs]e (?:version )?2 0
upl-1                universal   universal permissive licen[cs]e (?:version )?1 0
mulan-2              mulan       mulan permissive software licen[cs]e (?:version )?2
bsl-1.1              business    business source licen[cs]e (?:version )?1 1
sspl-1               server      server side public licen[cs]e (?:version )?1
odbl-1               database    open database licen[cs]e v?1 0
odc-by-1             commons     open data commons attribution licen[cs]e(?: v?1 0)?
pddl-1               domain      (?:open data commons )?public domain dedication and licen[cs]e(?: v?1 0)?
gfdl                 documentation gnu free documentation licen[cs]e (?:version )?1 [123]
cc0-1                cc0         cc0 (?:1 0|universal)(?: universal)?
cc-by                cc          cc by [1-4] 0
cc-by-sa             cc          cc by sa [1-4] 0
cc-by-nd             cc          cc by nd [1-4] 0
cc-by-nc             cc          cc by nc [1-4] 0
cc-by-nc-sa          cc          cc by nc sa [1-4] 0
cc-by-nc-nd          cc          cc by nc nd [1-4] 0
cc-by                creative    creative commons attribution [1-4] 0(?: international| unported| generic)?
cc-by-sa             creative    creative commons attribution share ?alike [1-4] 0(?: international| unported| generic)?
cc-by-nd             creative    creative commons attribution no ?deriv(?:ative)?s [1-4] 0(?: international| unported| generic)?
cc-by-nc             creative    creative commons attribution non ?commercial [1-4] 0(?: international| unported| generic)?
cc-by-nc-sa          creative    creative commons attribution non ?commercial share ?alike [1-4] 0(?: international| unported| generic)?
cc-by-nc-nd          creative    creative commons attribution non ?commercial no ?deriv(?:ative)?s [1-4] 0(?: international| unported| generic)?
cc-by                org         creativecommons org licenses by [1-4] 0
cc-by-sa             org         creativecommons org licenses by sa [1-4] 0
cc-by-nd             org         creativecommons org licenses by nd [1-4] 0
cc-by-nc             org         creativecommons org licenses by nc [1-4] 0
cc-by-nc-sa          org         creativecommons org licenses by nc sa [1-4] 0
cc-by-nc-nd          org         creativecommons org licenses by nc nd [1-4] 0
cc0-1                org         creativecommons org publicdomain zero 1 0
apache-2             org         apache org licenses license 2 0
mit                  org         opensource org licenses mit(?: license)?
gpl-2                org         gnu org licenses (?:old licenses )?gpl 2 0
gpl-3                org         gnu org licenses gpl 3 0
"""

# A license by its name alone.
NAMED = """
mit                  mit         (?:under|by|per) (?:the )?(?:terms of (?:the )?)?mit(?: x11| expat)? licen[cs]e
mit                  mit         mit(?: x11| expat)? licen[cs]ed?
mit                  mit         licen[cs]ed under (?:the )?mit
mit                  mit         licen[cs]e mit
mit                  expat       expat licen[cs]e
mit-0                mit         mit no attribution
mit-0                mit         mit 0 licen[cs]e
x11                  x11         x11 licen[cs]e
apache               apache      apache licen[cs]ed?
apache               apache      licen[cs]ed under (?:the )?apache
apache               asf         licen[cs]ed to the apache software foundation asf
gpl                  general     gnu general public licen[cs]e
gpl                  gpl         gnu gpl
gpl                  gpl         gpl licen[cs]ed?
gpl                  gpl         (?:under|licen[cs]e) (?:the )?gpl
lgpl                 lesser      gnu lesser general public licen[cs]e
lgpl                 library     gnu library general public licen[cs]e
lgpl                 lgpl        lgpl
agpl                 affero      (?:gnu )?affero general public licen[cs]e
agpl                 agpl        agpl
bsd                  bsd         bsd(?: style| like)? licen[cs]ed?
bsd                  bsd         (?:under|licen[cs]e) (?:the )?bsd
bsd-3                berkeley    berkeley software distribution licen[cs]e
isc                  isc         isc licen[cs]ed?
isc                  isc         (?:under|licen[cs]e) (?:the )?isc
mpl                  mozilla     mozilla public licen[cs]e
epl                  eclipse     eclipse public licen[cs]e
cddl                 cddl        cddl
cddl                 distribution common development and distribution licen[cs]e
artistic             artistic    (?:perl )?artistic licen[cs]e
boost-1              boost       boost software licen[cs]e
zlib                 zlib        zlib(?: libpng)? licen[cs]ed?
libpng               libpng      libpng licen[cs]e
unlicense            unlicense   (?:the )?unlicense
wtfpl                wtfpl       wtfpl
eupl                 european    european union public licen[cs]e
eupl                 eupl        eupl
ofl                  font        (?:sil )?open font licen[cs]e
postgresql           postgresql  postgresql licen[cs]e
python               python      python software foundation licen[cs]e
python-2             psf         psf licen[cs]e
openssl              openssl     openssl licen[cs]e
php-3                php         php licen[cs]e
ruby                 ruby        ruby licen[cs]e
ms-pl                microsoft   microsoft public licen[cs]e
ms-rl                microsoft   microsoft reciprocal licen[cs]e
odbl                 database    open database licen[cs]e
gfdl                 documentation gnu free documentation licen[cs]e
cc0-1                cc0         cc0
cc-by-nc             cc          cc by nc
cc-by-nc-sa          cc          cc by nc sa
cc-by-nc-nd          cc          cc by nc nd
cc-by-sa             cc          cc by sa
cc-by-nd             cc          cc by nd
cc-by                cc          cc by
cc                   creative    creative commons
cc                   creative    creative commons zero
cc-by                creative    creative commons attribution
cc-by-sa             creative    creative commons attribution share ?alike
cc-by-nd             creative    creative commons attribution no ?deriv(?:ative)?s
cc-by-nc             creative    creative commons attribution non ?commercial
cc-by-nc-sa          creative    creative commons attribution non ?commercial share ?alike
cc-by-nc-nd          creative    creative commons attribution non ?commercial no ?deriv(?:ative)?s
bsl                  business    business source licen[cs]e
sspl                 server      server side public licen[cs]e
elastic-2            elastic     elastic licen[cs]e
commons-clause       clause      commons clause
json                 json        json licen[cs]e
beerware             beerware    beerware(?: licen[cs]e)?
zope                 zope        zope public licen[cs]e
qpl                  q           q public licen[cs]e
vim                  vim         vim licen[cs]e
curl                 curl        curl licen[cs]e
ntp                  ntp         ntp licen[cs]e
"""

# Words that say something about use, but name no license.
HINTS = """
public-domain        domain      (?:in|into|to) the public domain
public-domain        domain      public domain (?:work|dedication|mark|text|book)
all-rights-reserved  reserved    all rights reserved
proprietary          proprietary proprietary and confidential
proprietary          proprietary proprietary (?:software|information|material|licen[cs]e)
proprietary          confidential confidential (?:information )?do not (?:distribute|copy|share)
proprietary          eula        (?:end user licen[cs]e agreement )?eula
proprietary          user        end user licen[cs]e agreement
non-commercial       commercial  (?:for )?non commercial (?:use|purposes) only
non-commercial       noncommercial (?:for )?noncommercial (?:use|purposes) only
research-only        research    (?:for )?research (?:use|purposes) only
academic-only        academic    (?:for )?academic (?:use|purposes) only
permission           permission  used (?:with|by) permission
permission           permission  may not be reproduced (?:.{0,60} )?without (?:.{0,40} )?permission
copyright            copyright   copyright c (?:19|20)[0-9]{2}
open-source          source      open source licen[cs]e
free-software        software    free software licen[cs]e
dual                 dual        dual licen[cs]ed?
"""

#: Sections in order of priority, and their confidence.
SECTIONS = ((IDENTIFIERS, 1.0), (SENTENCES, 0.95), (VERSIONED, 0.85), (NAMED, 0.7), (HINTS, 0.4))


def rules() -> list[Rule]:
    found = []
    for priority, (section, confidence) in enumerate(SECTIONS):
        for line in section.strip().splitlines():
            label, keyword, regex = line.split(maxsplit=2)
            found.append(Rule(label, keyword, priority, confidence, f" (?:{regex})(?= )"))
    return found
