"""Signature rules for licenses, written over a text's lower-case words joined by single spaces.

A line is: label | kind | keyword | pattern. The keyword must stand in the text as a word before the pattern is tried, so it is a word of all that the pattern
fits, or other lines have what is left. Kinds, from the
strongest: text (wording of a license), tag (a machine-readable identifier), notice (a grant by name), url, name
(a mention), hint. The order of lines breaks ties.
"""

from __future__ import annotations

from typing import NamedTuple

KINDS = {"text": (5, 1.0), "tag": (4, 0.99), "notice": (3, 0.95), "url": (2, 0.9), "name": (1, 0.8), "hint": (0, 0.4)}
G = r"(?:is |are |was |were |be )?(?:re)?(?:licensed|released|distributed|available|published|covered|provided|redistributed|shared)(?: and licensed)? (?:to you )?(?:under|by|with) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?"

_RULES = r"""
mit | text | permission | permission is hereby granted free of charge to any person obtaining a copy
mit | text | merge | to use copy modify merge publish distribute sublicense and or sell copies
mit | text | copyright | the above copyright notice and this permission notice shall be included in all copies or substantial portions
mit | tag | spdx | spdx license identifier mit
mit | tag | license | license (?:file |id |identifier )?mit
mit | notice | mit | {G}mit
mit | notice | mit | {G}mit licen[cs]e
mit | url | opensource | opensource org licen[cs]es? (?:php )?mit
mit | url | mit | mit licen[cs]e (?:org|com)
mit | url | choosealicense | choosealicense com licenses mit
mit | name | license | mit licen[cs]e
mit | name | licence | mit licence
mit | name | expat | expat licen[cs]e
mit | name | x11 | mit x11
mit-0 | tag | spdx | spdx license identifier mit 0
mit-0 | name | attribution | mit no attribution
x11 | tag | spdx | spdx license identifier x11
x11 | name | x11 | x11 licen[cs]e
x11 | text | consortium | the name of the x consortium shall not be used in advertising
isc | text | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | tag | spdx | spdx license identifier isc
isc | tag | license | license isc
isc | notice | isc | {G}isc(?: licen[cs]e)?
isc | url | opensource | opensource org licenses isc(?: license(?: txt)?)?
isc | name | isc | isc licen[cs]e
0bsd | tag | spdx | spdx license identifier 0bsd
0bsd | name | 0bsd | 0bsd
0bsd | name | bsd | (?:zero clause|free public) bsd(?: licen[cs]e)?
0bsd | name | clause | bsd (?:zero|0) clause(?: licen[cs]e)?
bsd-2-clause | text | redistributions | redistributions in binary form must reproduce the above copyright notice
bsd-2-clause | tag | spdx | spdx license identifier bsd 2 clause(?: patent)?
bsd-2-clause | tag | clause | bsd 2 clause
bsd-2-clause | name | bsd | (?:simplified|freebsd) bsd(?: licen[cs]e)?
bsd-2-clause | name | clause | (?:2|two) clause bsd(?: licen[cs]e)?
bsd-2-clause | url | opensource | opensource org licenses bsd 2 clause
bsd-3-clause | text | endorse | neither the name of .{1,120}? nor the names of its contributors may be used to endorse or promote products
bsd-3-clause | tag | spdx | spdx license identifier bsd 3 clause(?: clear| lbnl)?
bsd-3-clause | tag | clause | bsd 3 clause
bsd-3-clause | name | bsd | (?:new|revised|modified) bsd(?: licen[cs]e)?
bsd-3-clause | name | clause | (?:3|three) clause bsd(?: licen[cs]e)?
bsd-3-clause | url | opensource | opensource org licenses bsd 3 clause
bsd-4-clause | text | acknowledgement | all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-4-clause | tag | spdx | spdx license identifier bsd 4 clause(?: uc)?
bsd-4-clause | name | bsd | (?:original|old) bsd(?: licen[cs]e)?
bsd-4-clause | name | clause | (?:4|four) clause bsd(?: licen[cs]e)?
bsd | text | redistributions | redistributions of source code must retain the above copyright notice
bsd | text | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd | notice | bsd | {G}(?:a )?bsd(?: style)?(?: licen[cs]e)?
bsd | url | opensource | opensource org licenses bsd(?: license(?: php)?)?
bsd | name | bsd | bsd (?:style |like |type )?licen[cs]es?
apache-2.0 | text | apache | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2.0 | text | contributor | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent|except)
apache-2.0 | text | basis | distributed under the license is distributed on an as is basis without warranties or conditions of any kind
apache-2.0 | tag | spdx | spdx license identifier apache 2 0
apache-2.0 | tag | apache | license apache 2 0
apache-2.0 | notice | apache | {G}apache(?: software)?(?: licen[cs]e)? (?:version |v )?2(?: 0)?
apache-2.0 | url | apache | apache org licenses license 2 0(?: html| txt)?
apache-2.0 | url | opensource | opensource org licenses apache 2 0
apache-2.0 | name | apache | apache (?:software )?licen[cs]e (?:version |v )?2(?: 0)?
apache-2.0 | name | asl | asl (?:version )?2(?: 0)?
apache-2.0 | name | alv2 | alv2
apache-1.1 | tag | spdx | spdx license identifier apache 1 1
apache-1.1 | name | apache | apache (?:software )?licen[cs]e (?:version |v )?1 1
apache-1.1 | text | apache | products derived from this software may not be called apache
apache-1.0 | tag | spdx | spdx license identifier apache 1 0
apache-1.0 | name | apache | apache (?:software )?licen[cs]e (?:version |v )?1 0
apache | notice | apache | {G}apache licen[cs]e
apache | name | apache | apache (?:software )?licen[cs]e
gpl-2.0 | text | gpl | gpl version 2
gpl-2.0 | tag | spdx | spdx license identifier gpl 2 0(?: only)?
gpl-2.0 | tag | gpl | gpl 2 0 only
gpl-2.0 | notice | gnu | {G}gnu (?:general public licen[cs]e|gpl) (?:version |v )?2(?: 0)?
gpl-2.0 | name | gnu | gnu general public licen[cs]e (?:version |v )?2(?: 0)?
gpl-2.0 | name | general | general public licen[cs]e (?:version |v )2(?: 0)?
gpl-2.0 | name | gplv2 | gplv2
gpl-2.0 | name | gpl | gpl v ?2
gpl-2.0 | url | gnu | gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?
gpl-2.0-or-later | text | option | either version 2 of the license or at your option any later version
gpl-2.0-or-later | tag | spdx | spdx license identifier gpl 2 0 or later
gpl-2.0-or-later | name | gplv2 | gplv2 or later
gpl-3.0 | tag | spdx | spdx license identifier gpl 3 0(?: only)?
gpl-3.0 | tag | gpl | gpl 3 0 only
gpl-3.0 | notice | gnu | {G}gnu (?:general public licen[cs]e|gpl) (?:version |v )?3(?: 0)?
gpl-3.0 | name | gnu | gnu general public licen[cs]e (?:version |v )?3(?: 0)?
gpl-3.0 | name | general | general public licen[cs]e (?:version |v )3(?: 0)?
gpl-3.0 | name | gplv3 | gplv3
gpl-3.0 | name | gpl | gpl v ?3
gpl-3.0 | url | gnu | gnu org licenses gpl 3 0(?: html| txt)?
gpl-3.0-or-later | text | option | either version 3 of the license or at your option any later version
gpl-3.0-or-later | tag | spdx | spdx license identifier gpl 3 0 or later
gpl-3.0-or-later | name | gplv3 | gplv3 or later
gpl | text | redistribute | you can redistribute it and or modify it under the terms of the gnu general public license
gpl | text | gnu | you should have received a copy of the gnu general public license
gpl | notice | gpl | {G}(?:gnu )?gpl
gpl | notice | general | {G}gnu general public licen[cs]e
gpl | url | gnu | gnu org licenses gpl(?: html| txt)?
gpl | url | gnu | gnu org copyleft gpl(?: html)?
gpl | name | general | general public licen[cs]e
gpl | name | gnu | gnu gpl
gpl | name | gpl | gpl licen[cs]ed?
lgpl-2.0 | tag | spdx | spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-2.0 | name | library | (?:gnu )?library general public licen[cs]e(?: (?:version |v )?2(?: 0)?)?
lgpl-2.1 | text | lesser | gnu lesser general public license as published by the free software foundation either version 2 1
lgpl-2.1 | tag | spdx | spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-2.1 | name | lesser | (?:gnu )?lesser general public licen[cs]e (?:version |v )?2 1
lgpl-2.1 | name | lgpl | lgpl (?:version |v )?2 1
lgpl-2.1 | name | lgplv2 | lgplv2(?: 1)?
lgpl-2.1 | url | gnu | gnu org licenses (?:old licenses )?lgpl 2 1(?: html| txt)?
lgpl-3.0 | tag | spdx | spdx license identifier lgpl 3 0(?: only| or later)?
lgpl-3.0 | name | lesser | (?:gnu )?lesser general public licen[cs]e (?:version |v )?3(?: 0)?
lgpl-3.0 | name | lgpl | lgpl (?:version |v )?3(?: 0)?
lgpl-3.0 | name | lgplv3 | lgplv3
lgpl-3.0 | url | gnu | gnu org licenses lgpl 3 0(?: html| txt)?
lgpl | notice | lgpl | {G}(?:gnu )?lgpl
lgpl | name | lesser | (?:gnu )?lesser general public licen[cs]e
lgpl | name | lgpl | lgpl(?: licen[cs]e)?
agpl-3.0 | text | affero | gnu affero general public license as published by the free software foundation either version 3
agpl-3.0 | tag | spdx | spdx license identifier agpl 3 0(?: only| or later)?
agpl-3.0 | name | affero | (?:gnu )?affero general public licen[cs]e (?:version |v )?3(?: 0)?
agpl-3.0 | name | agplv3 | agplv3
agpl-3.0 | name | agpl | agpl (?:version |v )?3(?: 0)?
agpl-3.0 | url | gnu | gnu org licenses agpl 3 0(?: html| txt)?
agpl | notice | agpl | {G}(?:gnu )?agpl
agpl | name | affero | (?:gnu )?affero general public licen[cs]e
agpl | name | agpl | agpl(?: licen[cs]e)?
gfdl | text | documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl | tag | spdx | spdx license identifier gfdl 1 [123](?: only| or later)?
gfdl | name | documentation | (?:gnu )?free documentation licen[cs]e
gfdl | name | gfdl | gfdl
gpl-classpath | name | classpath | classpath exception
gpl-classpath | text | executable | as a special exception the copyright holders of this library give you permission to link this library with independent modules to produce an executable
mpl-2.0 | text | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0 | tag | spdx | spdx license identifier mpl 2 0(?: no copyleft exception)?
mpl-2.0 | name | mozilla | mozilla public licen[cs]e (?:version |v )?2(?: 0)?
mpl-2.0 | name | mpl | mpl (?:version |v )?2(?: 0)?
mpl-2.0 | url | mozilla | mozilla org (?:en us )?mpl 2 0
mpl-1.1 | text | mozilla | the contents of this file are subject to the mozilla public license version 1 1
mpl-1.1 | tag | spdx | spdx license identifier mpl 1 1
mpl-1.1 | name | mozilla | mozilla public licen[cs]e (?:version |v )?1 1
mpl-1.1 | name | mpl | mpl (?:version |v )?1 1
mpl | notice | mozilla | {G}mozilla public licen[cs]e
mpl | name | mozilla | mozilla public licen[cs]e
mpl | url | mozilla | mozilla org mpl
epl-1.0 | tag | spdx | spdx license identifier epl 1 0
epl-1.0 | name | eclipse | eclipse public licen[cs]e (?:version |v )?1(?: 0)?
epl-1.0 | url | eclipse | eclipse org legal epl v10(?: html)?
epl-2.0 | tag | spdx | spdx license identifier epl 2 0
epl-2.0 | name | eclipse | eclipse public licen[cs]e (?:version |v )?2(?: 0)?
epl-2.0 | url | eclipse | eclipse org legal epl (?:2 0|v20)(?: html)?
epl | notice | eclipse | {G}eclipse public licen[cs]e
epl | name | eclipse | eclipse public licen[cs]e
edl-1.0 | name | eclipse | eclipse distribution licen[cs]e(?: (?:version |v )?1 0)?
cddl-1.0 | tag | spdx | spdx license identifier cddl 1 [01]
cddl-1.0 | name | cddl | cddl(?: (?:version |v )?1 [01])?
cddl-1.0 | name | development | common development and distribution licen[cs]e
cpl-1.0 | tag | spdx | spdx license identifier cpl 1 0
cpl-1.0 | name | common | common public licen[cs]e(?: (?:version |v )?1 0)?
ibm-pl | name | ibm | ibm public licen[cs]e
apsl-2.0 | tag | spdx | spdx license identifier apsl 2 0
apsl-2.0 | name | apple | apple public source licen[cs]e
artistic-1.0 | tag | spdx | spdx license identifier artistic 1 0(?: perl| cl8)?
artistic-1.0 | name | artistic | artistic licen[cs]e (?:version |v )?1 0
artistic-2.0 | tag | spdx | spdx license identifier artistic 2 0
artistic-2.0 | name | artistic | artistic licen[cs]e (?:version |v )?2(?: 0)?
artistic | name | artistic | artistic licen[cs]e
artistic | text | perl | under the same terms as perl itself
bsl-1.0 | text | boost | boost software license version 1 0
bsl-1.0 | tag | spdx | spdx license identifier bsl 1 0
bsl-1.0 | name | boost | boost (?:software )?licen[cs]e
bsl-1.0 | url | boost | boost org license 1 0(?: txt)?
busl-1.1 | tag | spdx | spdx license identifier busl 1 1
busl-1.1 | name | business | business source licen[cs]e(?: (?:version |v )?1 1)?
elastic-2.0 | tag | spdx | spdx license identifier elastic 2 0
elastic-2.0 | name | elastic | elastic licen[cs]e(?: (?:version |v )?2(?: 0)?)?
sspl-1.0 | tag | spdx | spdx license identifier sspl 1 0
sspl-1.0 | name | server | server side public licen[cs]e
sspl-1.0 | name | sspl | sspl(?: v ?1)?
zlib | text | misrepresented | the origin of this software must not be misrepresented
zlib | text | permission | permission is granted to anyone to use this software for any purpose including commercial applications
zlib | tag | spdx | spdx license identifier zlib(?: acknowledgement)?
zlib | name | zlib | zlib(?: libpng)? licen[cs]e
libpng | tag | spdx | spdx license identifier libpng(?: 2 0)?
libpng | name | libpng | libpng licen[cs]e
unlicense | text | unencumbered | this is free and unencumbered software released into the public domain
unlicense | tag | spdx | spdx license identifier unlicense
unlicense | name | unlicense | (?:the )?unlicense
unlicense | url | unlicense | unlicense org
wtfpl | text | fuck | you just do what the fuck you want to
wtfpl | tag | spdx | spdx license identifier wtfpl
wtfpl | name | wtfpl | wtfpl
cc0-1.0 | text | waives | overtly fully permanently irrevocably and unconditionally waives
cc0-1.0 | tag | spdx | spdx license identifier cc0 1 0
cc0-1.0 | notice | cc0 | {G}cc0(?: 1 0)?(?: universal)?
cc0-1.0 | url | creativecommons | creativecommons org publicdomain zero 1 0
cc0-1.0 | name | cc0 | cc0(?: 1 0)?
cc0-1.0 | name | creative | creative commons zero
cc-pdm | url | creativecommons | creativecommons org publicdomain mark 1 0
public-domain | notice | domain | (?:released|dedicated|placed|donated) (?:in|into|to) the public domain
public-domain | name | domain | (?:in|into|to) the public domain
cc-by-1.0 | tag | spdx | spdx license identifier cc by 1 0
cc-by-2.0 | tag | spdx | spdx license identifier cc by 2 0
cc-by-2.5 | tag | spdx | spdx license identifier cc by 2 5
cc-by-3.0 | tag | spdx | spdx license identifier cc by 3 0
cc-by-3.0 | name | cc | cc by 3 0
cc-by-3.0 | url | creativecommons | creativecommons org licenses by 3 0
cc-by-3.0 | name | creative | creative commons attribution 3 0
cc-by-4.0 | tag | spdx | spdx license identifier cc by 4 0
cc-by-4.0 | notice | cc | {G}cc by 4 0
cc-by-4.0 | name | cc | cc by 4 0
cc-by-4.0 | url | creativecommons | creativecommons org licenses by 4 0
cc-by-4.0 | name | creative | creative commons attribution 4 0
cc-by-sa-3.0 | tag | spdx | spdx license identifier cc by sa 3 0
cc-by-sa-3.0 | name | cc | cc by sa 3 0
cc-by-sa-3.0 | url | creativecommons | creativecommons org licenses by sa 3 0
cc-by-sa-3.0 | name | creative | creative commons attribution share ?alike 3 0
cc-by-sa-4.0 | tag | spdx | spdx license identifier cc by sa 4 0
cc-by-sa-4.0 | notice | cc | {G}cc by sa 4 0
cc-by-sa-4.0 | name | cc | cc by sa 4 0
cc-by-sa-4.0 | url | creativecommons | creativecommons org licenses by sa 4 0
cc-by-sa-4.0 | name | creative | creative commons attribution share ?alike 4 0
cc-by-nd-4.0 | tag | spdx | spdx license identifier cc by nd 4 0
cc-by-nd-4.0 | name | cc | cc by nd 4 0
cc-by-nd-4.0 | url | creativecommons | creativecommons org licenses by nd 4 0
cc-by-nc-3.0 | tag | spdx | spdx license identifier cc by nc 3 0
cc-by-nc-3.0 | name | cc | cc by nc 3 0
cc-by-nc-3.0 | url | creativecommons | creativecommons org licenses by nc 3 0
cc-by-nc-4.0 | tag | spdx | spdx license identifier cc by nc 4 0
cc-by-nc-4.0 | notice | cc | {G}cc by nc 4 0
cc-by-nc-4.0 | name | cc | cc by nc 4 0
cc-by-nc-4.0 | url | creativecommons | creativecommons org licenses by nc 4 0
cc-by-nc-4.0 | name | creative | creative commons attribution non ?commercial 4 0
cc-by-nc-sa-3.0 | tag | spdx | spdx license identifier cc by nc sa 3 0
cc-by-nc-sa-3.0 | name | cc | cc by nc sa 3 0
cc-by-nc-sa-4.0 | tag | spdx | spdx license identifier cc by nc sa 4 0
cc-by-nc-sa-4.0 | name | cc | cc by nc sa 4 0
cc-by-nc-sa-4.0 | url | creativecommons | creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0 | tag | spdx | spdx license identifier cc by nc nd 4 0
cc-by-nc-nd-4.0 | name | cc | cc by nc nd 4 0
cc-by-nc-nd-4.0 | url | creativecommons | creativecommons org licenses by nc nd 4 0
cc-by | name | cc | cc by
cc-by-sa | name | cc | cc by sa
cc-by-nc | name | cc | cc by nc
cc-by-nd | name | cc | cc by nd
cc-by-nc-sa | name | cc | cc by nc sa
cc-by-nc-nd | name | cc | cc by nc nd
cc | notice | creative | {G}(?:a )?creative commons
cc | url | creativecommons | creativecommons org(?: licenses)?
cc | name | creative | creative commons(?: licen[cs]e)?
odbl-1.0 | tag | spdx | spdx license identifier odbl 1 0
odbl-1.0 | name | database | open database licen[cs]e
odbl-1.0 | name | odbl | odbl
odc-by-1.0 | name | odc | odc by(?: 1 0)?
odc-by-1.0 | name | commons | open data commons attribution licen[cs]e
pddl-1.0 | name | pddl | pddl(?: 1 0)?
python-2.0 | text | psf | psf hereby grants licensee a nonexclusive royalty free world wide license
python-2.0 | tag | spdx | spdx license identifier (?:python 2 0|psf 2 0)
python-2.0 | name | python | python software foundation licen[cs]e
python-2.0 | name | psf | psf licen[cs]e
ruby | tag | spdx | spdx license identifier ruby
ruby | name | ruby | ruby licen[cs]e
php-3.01 | tag | spdx | spdx license identifier php 3 01?
php-3.01 | name | php | php licen[cs]e(?: (?:version |v )?3 01?)?
openssl | tag | spdx | spdx license identifier openssl
openssl | name | openssl | openssl licen[cs]e
openssl | text | openssl | this product includes software developed by the openssl project
curl | tag | spdx | spdx license identifier curl
curl | name | curl | curl licen[cs]e
ncsa | tag | spdx | spdx license identifier ncsa
ncsa | name | ncsa | (?:university of illinois )?ncsa (?:open source )?licen[cs]e
postgresql | tag | spdx | spdx license identifier postgresql
postgresql | name | postgresql | postgresql licen[cs]e
vim | tag | spdx | spdx license identifier vim
vim | name | vim | vim licen[cs]e
ofl-1.1 | text | sil | this font software is licensed under the sil open font license version 1 1
ofl-1.1 | tag | spdx | spdx license identifier ofl 1 1(?: rfn| no rfn)?
ofl-1.1 | name | font | (?:sil )?open font licen[cs]e
ofl-1.1 | url | sil | scripts sil org ofl
eupl-1.2 | tag | spdx | spdx license identifier eupl 1 [12]
eupl-1.2 | name | european | european union public licen[cs]e
eupl-1.2 | name | eupl | eupl(?: (?:version |v )?1 [12])?
cecill-2.1 | tag | spdx | spdx license identifier cecill 2 [01]
cecill | name | cecill | cecill(?: (?:b|c))?(?: licen[cs]e)?
ms-pl | tag | spdx | spdx license identifier ms pl
ms-pl | name | microsoft | microsoft public licen[cs]e
ms-rl | tag | spdx | spdx license identifier ms rl
ms-rl | name | microsoft | microsoft reciprocal licen[cs]e
osl-3.0 | tag | spdx | spdx license identifier osl 3 0
osl-3.0 | name | open | open software licen[cs]e(?: (?:version |v )?3 0)?
afl-3.0 | tag | spdx | spdx license identifier afl 3 0
afl-3.0 | name | academic | academic free licen[cs]e
upl-1.0 | tag | spdx | spdx license identifier upl 1 0
upl-1.0 | name | universal | universal permissive licen[cs]e
mulan-2.0 | tag | spdx | spdx license identifier mulanpsl 2 0
mulan-2.0 | name | mulan | mulan (?:psl|permissive software licen[cs]e)
blueoak-1.0.0 | tag | spdx | spdx license identifier blueoak 1 0 0
blueoak-1.0.0 | name | oak | blue oak model licen[cs]e
hpnd | tag | spdx | spdx license identifier hpnd(?: sell variant)?
hpnd | name | historical | historical permission notice and disclaimer
w3c | tag | spdx | spdx license identifier w3c
w3c | name | w3c | w3c (?:software (?:notice and )?)?licen[cs]e
qpl-1.0 | name | qpl | qpl(?: 1 0)?
qpl-1.0 | name | public | q public licen[cs]e
sleepycat | name | sleepycat | sleepycat licen[cs]e
nasa-1.3 | name | nasa | nasa open source agreement
json | text | good | the software shall be used for good not evil
json | name | json | json licen[cs]e
beerware | text | beer | buy me a beer in return
beerware | name | beerware | beerware(?: licen[cs]e)?
beerware | name | beer | beer ware licen[cs]e
openrail | name | rail | (?:creativeml |bigscience )?open rail(?: m)?(?: licen[cs]e)?
openrail | name | openrail | openrail(?: m)?(?: licen[cs]e)?
llama | name | llama | llama \d(?: \d)? community licen[cs]e(?: agreement)?
commons-clause | text | commons | commons clause license condition
commons-clause | name | commons | commons clause
polyform | name | polyform | polyform (?:noncommercial|small business|shield|strict)(?: licen[cs]e)?
hippocratic | name | hippocratic | hippocratic licen[cs]e
proprietary | text | prior | (?:no part of this|may not be reproduced).{1,160}?without (?:the )?prior (?:written )?permission
proprietary | notice | rights | all rights reserved
proprietary | notice | confidential | proprietary and confidential
proprietary | name | user | end user licen[cs]e agreement
proprietary | name | eula | eula
unknown-license | hint | license | see (?:the )?(?:file )?license(?: file| txt| md)? for
unknown-license | hint | licensed | licensed under
unknown-license | hint | license | license agreement
unknown-license | hint | copyright | copyright (?:c )?(?:19|20)\d\d
unknown-license | hint | spdx | spdx license identifier
"""

#: Places of these always count, whatever else covers them.
BASE = [("mit", "license", "mit license"), ("apache", "license", "apache license"), ("gpl", "license", "general public license")]


class Rule(NamedTuple):
    label: str
    priority: int
    score: float
    keyword: str
    pattern: str
    base: bool


def rules() -> list[Rule]:
    """All rules in order, the base ones first."""
    out = [Rule(label, 1, 0.8, keyword, pattern, True) for label, keyword, pattern in BASE]
    for line in _RULES.strip().splitlines():
        label, kind, keyword, pattern = line.split(" | ")
        out.append(Rule(label, *KINDS[kind], keyword, pattern.replace("{G}", G), False))
    return out
