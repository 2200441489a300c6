"""Signature rules for licence texts, notices and references.

A rule is a line `label | keywords | pattern`. Patterns are matched against a text's words,
A-Z lower-cased, with one space between them; a pattern begins and ends with whole words, and
a space inside parts two words. Each match holds at least one of the keywords as a word, so a
text without any need not be searched. Sections come in order of priority: what a text says of
itself by tag or address, names, sentences of licence texts and headers, and remarks that say
only that there is some licence. Rules within a section come in order too: of two that match
the same words the earlier counts.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    level: int
    number: int
    label: str
    keywords: tuple[str, ...]
    pattern: str


TAGS = """
mit-0 | spdx | spdx license identifier mit 0
mit | spdx | spdx license identifier mit
x11 | spdx | spdx license identifier x11
isc | spdx | spdx license identifier isc
0bsd | spdx | spdx license identifier 0bsd
bsd-4-clause | spdx | spdx license identifier bsd 4 clause(?: uc)?
bsd-3-clause-clear | spdx | spdx license identifier bsd 3 clause clear
bsd-3-clause | spdx | spdx license identifier bsd 3 clause
bsd-2-clause-patent | spdx | spdx license identifier bsd 2 clause patent
bsd-2-clause | spdx | spdx license identifier bsd 2 clause(?: views)?
bsd-source-code | spdx | spdx license identifier bsd source code
apache-2.0 | spdx | spdx license identifier apache 2 0
apache-1.1 | spdx | spdx license identifier apache 1 1
apache-1.0 | spdx | spdx license identifier apache 1 0
agpl-3.0-or-later | spdx | spdx license identifier agpl 3 0 or later
agpl-3.0-only | spdx | spdx license identifier agpl 3 0(?: only)?
lgpl-3.0-or-later | spdx | spdx license identifier lgpl 3 0 or later
lgpl-3.0-only | spdx | spdx license identifier lgpl 3 0(?: only)?
lgpl-2.1-or-later | spdx | spdx license identifier lgpl 2 1 or later
lgpl-2.1-only | spdx | spdx license identifier lgpl 2 1(?: only)?
lgpl-2.0-or-later | spdx | spdx license identifier lgpl 2 0 or later
lgpl-2.0-only | spdx | spdx license identifier lgpl 2 0(?: only)?
gpl-3.0-or-later | spdx | spdx license identifier gpl 3 0 or later
gpl-3.0-only | spdx | spdx license identifier gpl 3 0(?: only)?
gpl-2.0-with-classpath-exception | spdx | spdx license identifier gpl 2 0(?: only| or later)? with classpath exception 2 0
gpl-2.0-or-later | spdx | spdx license identifier gpl 2 0 or later
gpl-2.0-only | spdx | spdx license identifier gpl 2 0(?: only)?
gpl-1.0-or-later | spdx | spdx license identifier gpl 1 0 or later
gpl-1.0-only | spdx | spdx license identifier gpl 1 0(?: only)?
gfdl-1.3 | spdx | spdx license identifier gfdl 1 3(?: only| or later)?
gfdl-1.2 | spdx | spdx license identifier gfdl 1 2(?: only| or later)?
gfdl-1.1 | spdx | spdx license identifier gfdl 1 1(?: only| or later)?
mpl-2.0 | spdx | spdx license identifier mpl 2 0
mpl-1.1 | spdx | spdx license identifier mpl 1 1
mpl-1.0 | spdx | spdx license identifier mpl 1 0
epl-2.0 | spdx | spdx license identifier epl 2 0
epl-1.0 | spdx | spdx license identifier epl 1 0
eupl-1.2 | spdx | spdx license identifier eupl 1 2
eupl-1.1 | spdx | spdx license identifier eupl 1 1
cddl-1.1 | spdx | spdx license identifier cddl 1 1
cddl-1.0 | spdx | spdx license identifier cddl 1 0
cpl-1.0 | spdx | spdx license identifier cpl 1 0
artistic-2.0 | spdx | spdx license identifier artistic 2 0
artistic-1.0 | spdx | spdx license identifier artistic 1 0(?: perl| cl8)?
zlib | spdx | spdx license identifier zlib
libpng-2.0 | spdx | spdx license identifier libpng 2 0
bsl-1.0 | spdx | spdx license identifier bsl 1 0
unlicense | spdx | spdx license identifier unlicense
wtfpl | spdx | spdx license identifier wtfpl
psf-2.0 | spdx | spdx license identifier (?:psf 2 0|python 2 0(?: 1)?)
postgresql | spdx | spdx license identifier postgresql
ncsa | spdx | spdx license identifier ncsa
ofl-1.1 | spdx | spdx license identifier ofl 1 1(?: rfn| no rfn)?
ms-pl | spdx | spdx license identifier ms pl
ms-rl | spdx | spdx license identifier ms rl
unicode-dfs-2016 | spdx | spdx license identifier unicode (?:dfs 201[56]|3 0)
busl-1.1 | spdx | spdx license identifier busl 1 1
sspl-1.0 | spdx | spdx license identifier sspl 1 0
odbl-1.0 | spdx | spdx license identifier odbl 1 0
pddl-1.0 | spdx | spdx license identifier pddl 1 0
upl-1.0 | spdx | spdx license identifier upl 1 0
afl-3.0 | spdx | spdx license identifier afl 3 0
osl-3.0 | spdx | spdx license identifier osl 3 0
cecill-2.1 | spdx | spdx license identifier cecill 2 1
cc0-1.0 | spdx | spdx license identifier cc0 1 0
cc-by-nc-nd | spdx | spdx license identifier cc by nc nd [1-4] [05]
cc-by-nc-sa | spdx | spdx license identifier cc by nc sa [1-4] [05]
cc-by-nc | spdx | spdx license identifier cc by nc [1-4] [05]
cc-by-nd | spdx | spdx license identifier cc by nd [1-4] [05]
cc-by-sa | spdx | spdx license identifier cc by sa [1-4] [05]
cc-by | spdx | spdx license identifier cc by [1-4] [05]
mit | opensource | opensource org licenses? mit(?: license)?(?: php| html)?
isc | opensource | opensource org licenses? isc(?: license)?(?: txt)?
bsd-3-clause | opensource | opensource org licenses? bsd 3 clause
bsd-2-clause | opensource | opensource org licenses? bsd 2 clause
apache-2.0 | opensource | opensource org licenses? apache 2 0
mpl-2.0 | opensource | opensource org licenses? mpl 2 0
artistic-2.0 | opensource | opensource org licenses? artistic(?: license)? 2 0
zlib | opensource | opensource org licenses? zlib(?: license)?
ecl-2.0 | opensource | opensource org licenses? ecl 2 0
apache-2.0 | apache | (?:www )?apache org licenses license 2 0(?: txt| html)?
apache-1.1 | apache | (?:www )?apache org licenses license 1 1(?: txt)?
agpl-3.0 | gnu | (?:www )?gnu org licenses agpl(?: 3 0)?(?: html| txt)?
lgpl-3.0 | gnu | (?:www )?gnu org licenses lgpl 3 0(?: html| txt)?
lgpl-2.1 | gnu | (?:www )?gnu org licenses (?:old licenses )?lgpl 2 1(?: html| txt)?
gpl-3.0 | gnu | (?:www )?gnu org licenses gpl 3 0(?: html| txt)?
gpl-2.0 | gnu | (?:www )?gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?
gfdl | gnu | (?:www )?gnu org (?:licenses|copyleft) fdl(?: 1 [123])?(?: html| txt)?
mpl-2.0 | mozilla | (?:www )?mozilla org (?:en us )?mpl 2 0
mpl-1.1 | mozilla | (?:www )?mozilla org mpl mpl 1 1(?: html)?
epl-2.0 | eclipse | (?:www )?eclipse org (?:legal epl 2 0|legal epl v20)(?: html)?
epl-1.0 | eclipse | (?:www )?eclipse org legal epl v10(?: html)?
bsl-1.0 | boost | (?:www )?boost org license 1 0(?: txt)?
unlicense | unlicense | (?:www )?unlicense org
wtfpl | wtfpl | (?:www )?wtfpl net
ofl-1.1 | ofl | scripts sil org ofl
cc0-1.0 | creativecommons | creativecommons org publicdomain zero 1 0
cc-pdm-1.0 | creativecommons | creativecommons org publicdomain mark 1 0
cc-by-nc-nd | creativecommons | creativecommons org licenses by nc nd [1-4] [05]
cc-by-nc-sa | creativecommons | creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc | creativecommons | creativecommons org licenses by nc [1-4] [05]
cc-by-nd | creativecommons | creativecommons org licenses by nd [1-4] [05]
cc-by-sa | creativecommons | creativecommons org licenses by sa [1-4] [05]
cc-by | creativecommons | creativecommons org licenses by [1-4] [05]
odbl-1.0 | opendatacommons | opendatacommons org licenses odbl(?: 1 0)?
pddl-1.0 | opendatacommons | opendatacommons org licenses pddl(?: 1 0)?
odc-by-1.0 | opendatacommons | opendatacommons org licenses by(?: 1 0)?
"""

NAMES = """
mit-0 | attribution | mit no attribution(?: licen[cs]e)?
mit-modern-variant | variant | mit licen[cs]e modern variant
mit | licensed, released, distributed | (?:licensed|released|distributed) under (?:the )?(?:terms of the )?mit(?: licen[cs]e)?
mit | license, licence | (?:the )?mit licen[cs]e
mit | expat | (?:the )?expat licen[cs]e
mit | x11 | mit x11 licen[cs]e
x11 | x11 | (?:the )?x11 licen[cs]e
isc | isc | (?:the )?isc licen[cs]e
0bsd | bsd | (?:zero clause bsd|0 clause bsd|bsd zero clause)(?: licen[cs]e)?
bsd-4-clause | bsd | (?:(?:4|four) clause bsd|bsd (?:4|four) clause)(?: licen[cs]e)?
bsd-4-clause | bsd | (?:original|old) bsd licen[cs]e
bsd-3-clause-clear | bsd | clear bsd licen[cs]e
bsd-3-clause | bsd | (?:(?:3|three) clause bsd|bsd (?:3|three) clause)(?: licen[cs]e)?
bsd-3-clause | bsd | (?:new|modified|revised) bsd licen[cs]e
bsd-2-clause | bsd | (?:(?:2|two) clause bsd|bsd (?:2|two) clause)(?: licen[cs]e)?
bsd-2-clause | bsd, freebsd | (?:simplified bsd|freebsd) licen[cs]e
bsd | bsd | bsd style licen[cs]e
bsd | bsd | (?:licensed|released|distributed) under (?:the |a )?bsd(?: licen[cs]e)?
bsd | bsd | (?:the )?bsd licen[cs]e
apache-2.0 | apache | apache (?:software )?licen[cs]e (?:version |v )?2(?: 0)?
apache-2.0 | apache | apache 2(?: 0)?(?: licen[cs]ed?)?
apache-2.0 | apache | apache licen[cs]e v2(?: 0)?
apache-2.0 | asl | asl (?:version |v )?2 0
apache-1.1 | apache | apache (?:software )?licen[cs]e (?:version |v )?1 1
apache-1.0 | apache | apache (?:software )?licen[cs]e (?:version |v )?1 0
apache | apache | (?:the )?apache (?:software )?licen[cs]e
agpl-3.0-or-later | affero | (?:gnu )?affero general public licen[cs]e (?:version |v )?3(?: 0)? or (?:any )?later(?: version)?
agpl-3.0 | affero | (?:gnu )?affero general public licen[cs]e(?: version| v)? 3(?: 0)?
agpl-3.0 | agpl, agplv3 | (?:gnu )?(?:agplv3|agpl v3|agpl (?:version )?3(?: 0)?)
agpl | affero | (?:gnu )?affero general public licen[cs]e
agpl | agpl | (?:gnu )?agpl
lgpl-3.0 | lesser | (?:gnu )?lesser general public licen[cs]e (?:version |v )?3(?: 0)?(?: or (?:any )?later(?: version)?)?
lgpl-2.1 | lesser | (?:gnu )?lesser general public licen[cs]e (?:version |v )?2 1(?: or (?:any )?later(?: version)?)?
lgpl-2.0 | library, lesser | (?:gnu )?(?:library|lesser) general public licen[cs]e (?:version |v )?2(?: 0)?(?: or (?:any )?later(?: version)?)?
lgpl-3.0 | lgpl, lgplv3 | (?:gnu )?(?:lgplv3|lgpl v3|lgpl (?:version )?3(?: 0)?)
lgpl-2.1 | lgpl, lgplv2 | (?:gnu )?(?:lgplv2 1|lgpl v2 1|lgpl (?:version )?2 1)
lgpl-2.0 | lgpl, lgplv2 | (?:gnu )?(?:lgplv2|lgpl v2|lgpl (?:version )?2(?: 0)?)
lgpl | lesser, library | (?:gnu )?(?:lesser|library) general public licen[cs]e
lgpl | lgpl | (?:gnu )?lgpl
gpl-2.0-with-classpath-exception | classpath | (?:gnu )?(?:general public licen[cs]e|gpl) (?:version |v )?2(?: 0)? with (?:the )?classpath exception
gpl-3.0-or-later | public | (?:gnu )?general public licen[cs]e (?:version |v )?3(?: 0)? or (?:any )?later(?: version)?
gpl-2.0-or-later | public | (?:gnu )?general public licen[cs]e (?:version |v )?2(?: 0)? or (?:any )?later(?: version)?
gpl-1.0-or-later | public | (?:gnu )?general public licen[cs]e (?:version |v )?1(?: 0)? or (?:any )?later(?: version)?
gpl-3.0 | public | (?:gnu )?general public licen[cs]e (?:version |v )?3(?: 0)?
gpl-2.0 | public | (?:gnu )?general public licen[cs]e (?:version |v )?2(?: 0)?
gpl-1.0 | public | (?:gnu )?general public licen[cs]e (?:version |v )?1(?: 0)?
gpl-3.0-or-later | gpl, gplv3 | (?:gnu )?(?:gplv3|gpl v3|gpl (?:version )?3(?: 0)?) or (?:any )?later(?: version)?
gpl-2.0-or-later | gpl, gplv2 | (?:gnu )?(?:gplv2|gpl v2|gpl (?:version )?2(?: 0)?) or (?:any )?later(?: version)?
gpl-3.0 | gpl, gplv3 | (?:gnu )?(?:gplv3|gpl v3|gpl (?:version )?3(?: 0)?)
gpl-2.0 | gpl, gplv2 | (?:gnu )?(?:gplv2|gpl v2|gpl (?:version )?2(?: 0)?)
gpl | public | gnu (?:general )?public licen[cs]e
gpl | gpl | gnu gpl
gpl | gpl | (?:licensed|released|distributed) under (?:the )?(?:terms of the )?gpl
gpl | gpl | gpl (?:licen[cs]e|licensed|compatible)
gfdl-1.3 | documentation | (?:gnu )?free documentation licen[cs]e (?:version |v )?1 3
gfdl-1.2 | documentation | (?:gnu )?free documentation licen[cs]e (?:version |v )?1 2
gfdl-1.1 | documentation | (?:gnu )?free documentation licen[cs]e (?:version |v )?1 1
gfdl | documentation, gfdl | (?:(?:gnu )?free documentation licen[cs]e|gnu gfdl)
mpl-2.0 | mozilla | mozilla public licen[cs]e (?:version |v )?2(?: 0)?
mpl-1.1 | mozilla | mozilla public licen[cs]e (?:version |v )?1 1
mpl-1.0 | mozilla | mozilla public licen[cs]e (?:version |v )?1 0
mpl | mozilla | mozilla public licen[cs]e
mpl-2.0 | mpl | mpl (?:version |v )?2 0
epl-2.0 | eclipse | eclipse public licen[cs]e (?:version |v )?2(?: 0)?
epl-1.0 | eclipse | eclipse public licen[cs]e (?:version |v )?1(?: 0)?
epl | eclipse | eclipse public licen[cs]e
edl-1.0 | eclipse | eclipse distribution licen[cs]e(?: (?:version |v )?1 0)?
eupl-1.2 | european, eupl | (?:european union public licen[cs]e|eupl) (?:version |v )?1 2
eupl-1.1 | european, eupl | (?:european union public licen[cs]e|eupl) (?:version |v )?1 1
eupl | european | european union public licen[cs]e
cddl-1.1 | cddl, development | (?:common development and distribution licen[cs]e|cddl) (?:version |v )?1 1
cddl-1.0 | cddl, development | (?:common development and distribution licen[cs]e|cddl) (?:version |v )?1 0
cddl | development | common development and distribution licen[cs]e
cpl-1.0 | common | common public licen[cs]e(?: (?:version |v )?1 0)?
ibm-pl-1.0 | ibm | ibm public licen[cs]e(?: (?:version |v )?1 0)?
artistic-2.0 | artistic | artistic licen[cs]e (?:version |v )?2(?: 0)?
artistic-1.0 | artistic | (?:perl )?artistic licen[cs]e (?:version |v )?1(?: 0)?
artistic | artistic | (?:the )?artistic licen[cs]e
perl | perl | same terms as perl(?: itself)?
zlib | zlib | zlib(?: libpng)? licen[cs]e
libpng | libpng | (?:the )?libpng licen[cs]e
bsl-1.0 | boost | boost software licen[cs]e(?: (?:version |v )?1 0)?
unlicense | unlicense | (?:released|licensed|available) under the unlicense
wtfpl | wtfpl, wtf, want | (?:do what the f[a-z]* you want to public licen[cs]e|wtfpl(?: licen[cs]e)?|wtf public licen[cs]e)
psf-2.0 | python | python software foundation licen[cs]e(?: (?:version |v )?2)?
postgresql | postgresql | (?:the )?postgresql licen[cs]e
ncsa | ncsa | (?:university of illinois )?ncsa (?:open source )?licen[cs]e
ofl-1.1 | sil, ofl | (?:sil open font licen[cs]e|sil ofl)(?: (?:version |v )?1 1)?
ms-pl | microsoft | microsoft public licen[cs]e
ms-rl | microsoft | microsoft reciprocal licen[cs]e
ms-lpl | microsoft | microsoft limited public licen[cs]e
unicode-dfs-2016 | unicode | unicode (?:data files|licen[cs]e agreement|terms of use)
openssl | openssl | openssl licen[cs]e
php-3.01 | php | php licen[cs]e(?: (?:version |v )?3 0(?: )?1)?
ruby | ruby | (?:the )?ruby licen[cs]e
w3c | w3c | w3c (?:software (?:notice and )?)?licen[cs]e
curl | curl | (?:the )?curl licen[cs]e
ecl-2.0 | educational | educational community licen[cs]e(?: (?:version |v )?2 0)?
afl-3.0 | academic | academic free licen[cs]e(?: (?:version |v )?[123] [01])?
osl-3.0 | open | open software licen[cs]e(?: (?:version |v )?[123] [01])?
qpl-1.0 | qpl, public | q public licen[cs]e(?: (?:version |v )?1 0)?
cecill | cecill | cecill (?:b|c|free software licen[cs]e|licen[cs]e)
upl-1.0 | permissive | universal permissive licen[cs]e(?: (?:version |v )?1 0)?
blueoak-1.0.0 | blue | blue oak model licen[cs]e(?: 1 0 0)?
busl-1.1 | business | business source licen[cs]e(?: (?:version |v )?1 1)?
sspl-1.0 | sspl, side | (?:server side public licen[cs]e|sspl)(?: (?:version |v )?1(?: 0)?)?
elastic-2.0 | elastic | elastic licen[cs]e(?: (?:version |v )?2 0)?
commons-clause | commons | commons clause(?: licen[cs]e condition)?
polyform-noncommercial-1.0.0 | polyform | polyform noncommercial licen[cs]e(?: 1 0 0)?
beerware | beer, beerware | (?:the )?(?:beer ware|beerware) licen[cs]e
json | json | (?:the )?json licen[cs]e
odbl-1.0 | database | open (?:data commons open )?database licen[cs]e(?: (?:v|version )?1 0)?
odc-by-1.0 | commons | open data commons attribution licen[cs]e
pddl-1.0 | dedication | open data commons public domain dedication(?: and licen[cs]e)?
ogl-uk | government | open government licen[cs]e(?: (?:version |v)?[123] 0)?
cdla-permissive | community | community data licen[cs]e agreement permissive(?: (?:version )?[12] 0)?
cdla-sharing-1.0 | community | community data licen[cs]e agreement sharing(?: (?:version )?1 0)?
llama-community | llama | llama (?:(?:2|3|3 1|3 2|3 3) )?community licen[cs]e(?: agreement)?
openrail-m | openrail, rail, openrailm, railm | (?:creativeml |bigscience )?(?:openrail|open rail|rail)(?:m| m| plus plus m)? licen[cs]e
cc0-1.0 | cc0, zero | (?:cc0(?: 1 0)?(?: universal)?|creative commons zero)(?: public domain dedication)?
cc-by-nc-nd | noderivs, noderivatives, noderivative, derivs, derivatives, derivative | (?:creative commons )?attribution non(?: )?commercial no(?: )?deriv(?:s|atives|ative works)(?: [1-4] [05])?(?: international| unported| generic)?
cc-by-nc-nd | derivatives, works | creative commons attribution non commercial no derivat(?:ives|ive works)
cc-by-nc-sa | share, sharealike | (?:creative commons )?attribution non(?: )?commercial share(?: )?alike(?: [1-4] [05])?(?: international| unported| generic)?
cc-by-nc | noncommercial, commercial | creative commons attribution non(?: )?commercial(?: [1-4] [05])?(?: international| unported| generic)?
cc-by-nd | commons | creative commons attribution no(?: )?deriv(?:s|atives)(?: [1-4] [05])?(?: international| unported| generic)?
cc-by-sa | commons | creative commons attribution share(?: )?alike(?: [1-4] [05])?(?: international| unported| generic)?
cc-by | commons | creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?
cc-by-nc-nd | cc | cc by nc nd(?: [1-4] [05])?
cc-by-nc-sa | cc | cc by nc sa(?: [1-4] [05])?
cc-by-nc | cc | cc by nc(?: [1-4] [05])?
cc-by-nd | cc | cc by nd(?: [1-4] [05])?
cc-by-sa | cc | cc by sa(?: [1-4] [05])?
cc-by | cc | cc by [1-4] [05]
creative-commons | commons | (?:under )?(?:a |the )?creative commons licen[cs]e
"""

SENTENCES = """
mit | granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | permission | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | holders | in no event shall the authors or copyright holders be liable for any claim damages or other liability
isc | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd-3-clause | endorse | neither the name of [0-9a-z ]{1,80}? nor the names of its contributors may be used to endorse or promote products
bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd | redistribution, redistributions | redistribution and use in source and binary forms with or without modification are permitted
bsd | redistributions | redistributions of source code must retain the above copyright notice
bsd | redistributions | redistributions in binary form must reproduce the above copyright notice
apache-2.0 | compliance | you may not use this file except in compliance with the licen[cs]e
apache-2.0 | warranties | distributed under the licen[cs]e is distributed on an as is basis without warranties or conditions of any kind
apache-2.0 | contributor | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) licen[cs]e
gpl | redistribute | this (?:program|library|file) is free software you can redistribute it and or modify it under the terms of
gpl | merchantability | without even the implied warranty of merchantability or fitness for a particular purpose
gpl | received | you should have received a copy of the gnu (?:affero |lesser |library )?general public licen[cs]e
gpl | verbatim | everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document
agpl | notwithstanding | notwithstanding any other provision of this licen[cs]e if you modify the program your modified version must prominently offer all users interacting with it remotely
mpl-2.0 | mozilla | this source code form is subject to the terms of the mozilla public licen[cs]e
mpl-2.0 | obtain | if a copy of the mpl was not distributed with this file you can obtain one at
mpl-1.1 | contents | the contents of this file are subject to the mozilla public licen[cs]e
cddl | contents | the contents of this file are subject to the terms of the common development and distribution licen[cs]e
epl | accompanying | this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e
zlib | misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | altered | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
bsl-1.0 | permission | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
unlicense | unencumbered | this is free and unencumbered software released into the public domain
wtfpl | just | you just do what the f[a-z]* you want to
postgresql | permission | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement
ofl-1.1 | font | this font software is licensed under the sil open font licen[cs]e
cc0-1.0 | waived | to the extent possible under law [0-9a-z ]{1,80}? has waived all copyright and related or neighboring rights
cc-by | credit | you must give appropriate credit provide a link to the licen[cs]e and indicate if changes were made
cc-by-sa | remix | if you remix transform or build upon the material you must distribute your contributions under the same licen[cs]e
cc-by-nc | commercial | you may not use the material for commercial purposes
cc-by-nd | remix | if you remix transform or build upon the material you may not distribute the modified material
beerware | beer | you can buy me a beer in return
json | evil | the software shall be used for good not evil
gfdl | invariant | with no invariant sections no front cover texts and no back cover texts
public-domain | domain | (?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain | domain | this (?:file|work|code|software|text|document) is in the public domain
proprietary | reproduced | no part of this (?:publication|book|work|document) may be reproduced
proprietary | confidential | (?:proprietary and confidential|confidential and proprietary)
proprietary | prohibited | unauthorized (?:copying|reproduction|use|distribution) (?:of this file |of this work )?(?:via any medium )?is strictly prohibited
proprietary | reverse | you may not reverse engineer decompile or disassemble
"""

REMARKS = """
all-rights-reserved | reserved | all rights reserved
end-user-licence | user | end user licen[cs]e agreement
end-user-licence | eula | (?:the |this )?eula
unknown-licence | licensed, licenced | (?:is |are )?licen[cs]ed under(?: the| a| an)?(?: terms of)?(?: the)?(?: following)?
unknown-licence | license, licence | (?:see|read) (?:the )?(?:file )?licen[cs]e(?: md| txt)?(?: file)? for (?:details|more information|the full text)
unknown-licence | license, licence | (?:subject to|under|within) the (?:terms|conditions)(?: and conditions)? of (?:the|this|a|an|its) licen[cs]e
unknown-licence | license, licence | released under (?:an?|the|its own) (?:open source |free |free software |permissive |copyleft )?licen[cs]e
unknown-licence | license, licence | (?:open source|free software|public|software|copyleft|permissive) licen[cs]e
unknown-licence | spdx | spdx license identifier [0-9a-z]+
unknown-licence | licensor, licensee | the licens(?:or|ee) (?:grants|hereby grants|shall|may|agrees)
copyright-notice | copyright | copyright (?:c )?(?:19|20)[0-9][0-9]
non-commercial | commercial, noncommercial | (?:for )?non(?: )?commercial use only
non-commercial | commercial, noncommercial | not for commercial use
non-commercial | personal | for personal use only
redistribution-forbidden | redistribution | (?:no redistribution|redistribution (?:is )?(?:not permitted|prohibited|forbidden))
permission-granted | permission | (?:used|reprinted|reproduced) (?:with|by) (?:kind )?permission(?: of)?
patent-grant | patent | (?:royalty free|irrevocable) patent licen[cs]e
no-warranty | warranty | without warranty of any kind
no-warranty | warranties | without warranties or conditions of any kind
"""

SECTIONS = (TAGS, NAMES, SENTENCES, REMARKS)
CONFIDENCE = (1.0, 0.9, 0.7, 0.3)  # of a rule, by section


def parsed(sections: tuple[str, ...] = SECTIONS) -> list[Rule]:
    """The rules of the sections in order; a malformed line is an error."""
    rules = []
    for level, section in enumerate(sections):
        for line in filter(None, map(str.strip, section.splitlines())):
            label, keywords, pattern = (part.strip() for part in line.split(" | ", 2))
            rules.append(Rule(level, len(rules), label, tuple(k.strip() for k in keywords.split(",")), pattern))
    return rules
