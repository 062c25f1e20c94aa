"""The ordered signatures of the license scan: one hand-written regular expression a line, behind its label.

They are matched against a text's words: letters and digits in lower case, joined by single
spaces, so ``GPL-3.0+`` reads ``gpl 3 0``. A match starts and ends at a word's edge. Tiers come
from the strongest down, and within a tier the more special rule stands first.
"""
from __future__ import annotations

#: ``tier: (priority, strength)``. Priority decides which of two overlapping detections stays, strength goes into the score.
TIERS = {"tag": (5, 0.95), "base": (4, 0.9), "notice": (3, 0.85), "name": (2, 0.7), "short": (1, 0.4)}

#: Machine-readable identifiers.
TAG = r"""
agpl-3 spdx licen[cs]e identifier agpl 3 0(?: only| or later)?
agpl-1 spdx licen[cs]e identifier agpl 1 0(?: only| or later)?
lgpl-2.1 spdx licen[cs]e identifier lgpl 2 1(?: only| or later)?
lgpl-2 spdx licen[cs]e identifier lgpl 2 0(?: only| or later)?
lgpl-3 spdx licen[cs]e identifier lgpl 3 0(?: only| or later)?
gpl-1 spdx licen[cs]e identifier gpl 1 0(?: only| or later)?
gpl-2 spdx licen[cs]e identifier gpl 2 0(?: only| or later)?
gpl-3 spdx licen[cs]e identifier gpl 3 0(?: only| or later)?
gfdl-1.1 spdx licen[cs]e identifier gfdl 1 1(?: only| or later)?
gfdl-1.2 spdx licen[cs]e identifier gfdl 1 2(?: only| or later)?
gfdl-1.3 spdx licen[cs]e identifier gfdl 1 3(?: only| or later)?
mit-0 spdx licen[cs]e identifier mit 0
mit spdx licen[cs]e identifier mit
apache-1 spdx licen[cs]e identifier apache 1 [01]
apache-2 spdx licen[cs]e identifier apache 2 0
bsd-4-clause spdx licen[cs]e identifier bsd 4 clause
bsd-3-clause spdx licen[cs]e identifier bsd 3 clause
bsd-2-clause spdx licen[cs]e identifier bsd 2 clause
0bsd spdx licen[cs]e identifier 0bsd
isc spdx licen[cs]e identifier isc
mpl-1 spdx licen[cs]e identifier mpl 1 [01]
mpl-2 spdx licen[cs]e identifier mpl 2 0
epl-1 spdx licen[cs]e identifier epl 1 0
epl-2 spdx licen[cs]e identifier epl 2 0
cddl-1 spdx licen[cs]e identifier cddl 1 [01]
cpl-1 spdx licen[cs]e identifier cpl 1 0
eupl spdx licen[cs]e identifier eupl 1 [0-2]
cc0 spdx licen[cs]e identifier cc0 1 0
cc-by-nc-sa spdx licen[cs]e identifier cc by nc sa [1-4] [05]
cc-by-nc-nd spdx licen[cs]e identifier cc by nc nd [1-4] [05]
cc-by-nc spdx licen[cs]e identifier cc by nc [1-4] [05]
cc-by-sa spdx licen[cs]e identifier cc by sa [1-4] [05]
cc-by-nd spdx licen[cs]e identifier cc by nd [1-4] [05]
cc-by spdx licen[cs]e identifier cc by [1-4] [05]
unlicense spdx licen[cs]e identifier unlicense
wtfpl spdx licen[cs]e identifier wtfpl
zlib spdx licen[cs]e identifier zlib
boost-1 spdx licen[cs]e identifier bsl 1 0
busl-1.1 spdx licen[cs]e identifier busl 1 1
artistic-1 spdx licen[cs]e identifier artistic 1 0
artistic-2 spdx licen[cs]e identifier artistic 2 0
ofl-1.1 spdx licen[cs]e identifier ofl 1 1
psf-2 spdx licen[cs]e identifier (?:psf|python) 2 0
postgresql spdx licen[cs]e identifier postgresql
odbl spdx licen[cs]e identifier odbl 1 0
pddl spdx licen[cs]e identifier pddl 1 0
odc-by spdx licen[cs]e identifier odc by 1 0
ms-pl spdx licen[cs]e identifier ms pl
ms-rl spdx licen[cs]e identifier ms rl
osl-3 spdx licen[cs]e identifier osl 3 0
afl-3 spdx licen[cs]e identifier afl 3 0
elastic-2 spdx licen[cs]e identifier elastic 2 0
sspl-1 spdx licen[cs]e identifier sspl 1 0
ncsa spdx licen[cs]e identifier ncsa
upl-1 spdx licen[cs]e identifier upl 1 0
vim spdx licen[cs]e identifier vim
mulan-2 spdx licen[cs]e identifier mulanpsl 2 0
blueoak-1 spdx licen[cs]e identifier blueoak 1 0 0
cecill-2 spdx licen[cs]e identifier cecill 2 [01]
"""

#: The phrases that the scan's contract fixes.
BASE = r"""
mit under the mit license
apache-2 apache license version 2
cc-by-nc cc by nc
"""

#: Sentences of the licenses themselves, and of the notices that they tell users to write.
NOTICE = r"""
agpl-3 under the terms of the gnu affero general public licen[cs]e(?: as published by the free software foundation)?(?: either)? version 3
lgpl-2.1 under the terms of the gnu lesser general public licen[cs]e(?: as published by the free software foundation)?(?: either)? version 2 1
lgpl-3 under the terms of the gnu lesser general public licen[cs]e(?: as published by the free software foundation)?(?: either)? version 3
lgpl-2 under the terms of the gnu library general public licen[cs]e(?: as published by the free software foundation)?(?: either)? version 2
gpl-2 under the terms of the gnu general public licen[cs]e(?: as published by the free software foundation)?(?: either)? version 2
gpl-3 under the terms of the gnu general public licen[cs]e(?: as published by the free software foundation)?(?: either)? version 3
gpl-1 under the terms of the gnu general public licen[cs]e(?: as published by the free software foundation)?(?: either)? version 1
agpl under the terms of the gnu affero general public licen[cs]e
lgpl under the terms of the gnu (?:lesser|library) general public licen[cs]e
gpl under the terms of the gnu general public licen[cs]e
gfdl permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e
gpl-3 the gnu general public licen[cs]e is a free copyleft licen[cs]e for software and other kinds of works
gpl-2 the licen[cs]es for most software are designed to take away your freedom to share and change it
agpl-3 specifically designed to ensure cooperation with the community in the case of network server software
apache-2 licensed under the apache licen[cs]e version 2 0 the licen[cs]e you may not use this file except in compliance with the licen[cs]e
apache-2 you may obtain a copy of the licen[cs]e at https? www apache org licen[cs]es licen[cs]e 2 0
apache-1 this product includes software developed by the apache (?:software foundation|group)
mit permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
isc permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
0bsd permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is
bsd-4-clause all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-3-clause neither the names? of (?:\S+ ){1,12}nor the names of (?:its|their|the) contributors may be used to endorse or promote products
bsd-2-clause redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd redistribution and use in source and binary forms with or without modification are permitted
bsd-clear subject to the limitations in the disclaimer below
mpl-2 this source code form is subject to the terms of the mozilla public licen[cs]e v(?:ersion)? ?2 0
mpl-1 the contents of this file are subject to the mozilla public licen[cs]e version 1 [01]
mpl-1 the contents of this file are subject to the netscape public licen[cs]e version 1 [01]
epl-1 this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e v1 0
epl-2 this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e (?:v ?)?2 0
edl-1 are made available under the terms of the eclipse distribution licen[cs]e v1 0
cddl-1 subject to the terms of the common development and distribution licen[cs]e
unlicense this is free and unencumbered software released into the public domain
unlicense anyone is free to copy modify publish use compile sell or distribute this software
wtfpl everyone is permitted to copy and distribute verbatim or modified copies of this licen[cs]e document and changing it is allowed as long as the name is changed
wtfpl you just do what the fuck you want to
zlib this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib altered source versions must be plainly marked as such and must not be misrepresented as being the original software
boost-1 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[cs]e
cc0 to the extent possible under law (?:\S+ ){1,12}waived all copyright and related or neighboring rights
cc-by-nc-sa this work is licensed under a creative commons attribution non ?commercial share ?alike
cc-by-nc-nd this work is licensed under a creative commons attribution non ?commercial no ?deriv(?:ative)?s
cc-by-nc this work is licensed under a creative commons attribution non ?commercial
cc-by-sa this work is licensed under a creative commons attribution share ?alike
cc-by-nd this work is licensed under a creative commons attribution no ?deriv(?:ative)?s
cc-by this work is licensed under a creative commons attribution
ofl-1.1 this font software is licensed under the sil open font licen[cs]e version 1 1
artistic the intent of this document is to state the conditions under which a package may be copied
psf-2 the python software foundation is granting you permission to make
psf-2 this licen[cs]e agreement is between the python software foundation
postgresql permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
beerware as long as you retain this notice you can do whatever you want with this stuff
x11 except as contained in this notice the names? of (?:\S+ ){1,12}shall not be used in advertising
ncsa permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction
openssl this product includes software developed by the openssl project for use in the openssl toolkit
ssleay this product includes cryptographic software written by eric young
json the software shall be used for good not evil
vim vim is charityware
elastic-2 you may not provide the software to third parties as a hosted or managed service
sspl-1 if you make the functionality of the program or a modified version available to third parties as a service
busl-1.1 the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
commons-clause the grant of rights under the licen[cs]e will not include and the licen[cs]e does not grant to you the right to sell the software
odbl this (?:\S+ ){1,4}is made available under the open database licen[cs]e
pddl this (?:\S+ ){1,4}is made available under the public domain dedication and licen[cs]e
ogl contains public sector information licensed under the open government licen[cs]e
ijg this software is based in part on the work of the independent jpeg group
freetype portions of this software are copyright (?:\S+ ){1,4}the freetype project
libpng this copy of the libpng notices is provided for your convenience
unicode copyright (?:\S+ ){0,4}unicode inc all rights reserved
public-domain i hereby (?:release|place|dedicate) this (?:work|code|file|software) (?:in|in ?to) the public domain
public-domain this (?:work|code|file|software) (?:is|has been) (?:placed|released|dedicated) (?:in|in ?to|to) the public domain
proprietary unauthori[sz]ed copying of this file via any medium is strictly prohibited
proprietary this (?:software|document|file) is (?:proprietary and confidential|confidential and proprietary)
proprietary no part of this (?:publication|book|work|document) may be reproduced
"""

#: Licenses called by their names.
NAME = r"""
agpl-3 gnu affero general public licen[cs]e (?:v|version )?3
agpl-1 affero general public licen[cs]e (?:v|version )?1
agpl gnu affero general public licen[cs]e
lgpl-2.1 gnu lesser general public licen[cs]e (?:v|version )?2 1
lgpl-3 gnu lesser general public licen[cs]e (?:v|version )?3
lgpl-2 gnu library general public licen[cs]e (?:v|version )?2
lgpl gnu (?:lesser|library) general public licen[cs]e
gpl-3 gnu general public licen[cs]e (?:v|version )?3
gpl-2 gnu general public licen[cs]e (?:v|version )?2
gpl-1 gnu general public licen[cs]e (?:v|version )?1
gpl gnu general public licen[cs]e
gfdl-1.1 gnu free documentation licen[cs]e (?:v|version )?1 1
gfdl-1.2 gnu free documentation licen[cs]e (?:v|version )?1 2
gfdl-1.3 gnu free documentation licen[cs]e (?:v|version )?1 3
gfdl gnu free documentation licen[cs]e
apache-2 apache (?:software )?licen[cs]e (?:v|version )?2(?: 0)?
apache-1 apache (?:software )?licen[cs]e (?:v|version )?1 [01]
apache-2 licensed under (?:the )?apache (?:software )?licen[cs]e (?:v|version )?2(?: 0)?
apache-2 asl 2 0
apache-2 apache org licen[cs]es licen[cs]e 2 0
mit-0 mit no attribution licen[cs]e
mit (?:released|licensed|distributed|available|published) under (?:the terms of )?(?:the )?mit licen[cs]e
mit the mit licen[cs]e(?: mit)?
mit mit style licen[cs]e
mit mit expat licen[cs]e
mit opensource org licen[cs]es mit
x11 x11 licen[cs]e
expat expat licen[cs]e
bsd-4-clause (?:4|four) clause bsd(?: licen[cs]e)?
bsd-4-clause bsd (?:4|four) clause(?: licen[cs]e)?
bsd-3-clause (?:3|three) clause bsd(?: licen[cs]e)?
bsd-3-clause bsd (?:3|three) clause(?: licen[cs]e)?
bsd-3-clause (?:new|modified|revised) bsd licen[cs]e
bsd-2-clause (?:2|two) clause bsd(?: licen[cs]e)?
bsd-2-clause bsd (?:2|two) clause(?: licen[cs]e)?
bsd-2-clause (?:simplified|freebsd) bsd licen[cs]e
bsd-4-clause original bsd licen[cs]e
0bsd zero clause bsd(?: licen[cs]e)?
bsd bsd style licen[cs]e
bsd (?:the|a) bsd licen[cs]e
isc (?:the )?isc licen[cs]e
mpl-2 mozilla public licen[cs]e (?:v|version )?2(?: 0)?
mpl-1 mozilla public licen[cs]e (?:v|version )?1 [01]
mpl mozilla public licen[cs]e
npl netscape public licen[cs]e
epl-2 eclipse public licen[cs]e (?:v ?|version )?2(?: 0)?
epl-1 eclipse public licen[cs]e (?:v ?|version )?1(?: 0)?
epl eclipse public licen[cs]e
edl-1 eclipse distribution licen[cs]e
cddl-1 common development and distribution licen[cs]e
cpl-1 common public licen[cs]e(?: version)? 1 0
ipl-1 ibm public licen[cs]e
eupl european union public licen[cs]e
cecill cecill (?:b |c )?(?:free software )?licen[cs]e
cc0 cc0 1 0 universal
cc0 creative commons zero
cc0 creativecommons org publicdomain zero
cc-by-nc-sa creativecommons org licen[cs]es by nc sa
cc-by-nc-nd creativecommons org licen[cs]es by nc nd
cc-by-nc creativecommons org licen[cs]es by nc
cc-by-sa creativecommons org licen[cs]es by sa
cc-by-nd creativecommons org licen[cs]es by nd
cc-by creativecommons org licen[cs]es by
cc-by-nc-sa (?:creative commons )?attribution non ?commercial share ?alike [1-4] [05]
cc-by-nc-nd (?:creative commons )?attribution non ?commercial no ?deriv(?:ative)?s [1-4] [05]
cc-by-nc (?:creative commons )?attribution non ?commercial [1-4] [05]
cc-by-sa (?:creative commons )?attribution share ?alike [1-4] [05]
cc-by-nd (?:creative commons )?attribution no ?deriv(?:ative)?s [1-4] [05]
cc-by creative commons attribution(?: licen[cs]e)?(?: [1-4] [05])?
cc-by-nc-sa cc by nc sa(?: [1-4] [05])?
cc-by-nc-nd cc by nc nd(?: [1-4] [05])?
cc-by-sa cc by sa(?: [1-4] [05])?
cc-by-nd cc by nd(?: [1-4] [05])?
cc-by cc by [1-4] [05]
unlicense unlicense org
unlicense the unlicense
wtfpl do what the fuck you want to public licen[cs]e
zlib zlib libpng licen[cs]e
zlib (?:the )?zlib licen[cs]e
libpng (?:the )?libpng licen[cs]e
boost-1 boost software licen[cs]e
busl-1.1 business source licen[cs]e
artistic-2 artistic licen[cs]e (?:v ?|version )?2(?: 0)?
artistic-1 artistic licen[cs]e (?:v ?|version )?1(?: 0)?
artistic (?:perl|the) artistic licen[cs]e
ofl-1.1 sil open font licen[cs]e(?: version 1 1)?
psf-2 python software foundation licen[cs]e
postgresql postgresql licen[cs]e
php-3 php licen[cs]e(?: version)? 3
ruby ruby licen[cs]e
zpl-2 zope public licen[cs]e
odbl open data ?base licen[cs]e
pddl public domain dedication and licen[cs]e
odc-by open data commons attribution licen[cs]e
ogl open government licen[cs]e
etalab licence ouverte
dl-de datenlizenz deutschland
ms-pl microsoft public licen[cs]e
ms-rl microsoft reciprocal licen[cs]e
osl open software licen[cs]e (?:v ?|version )?[123]
afl academic free licen[cs]e
ecl-2 educational community licen[cs]e
elastic-2 elastic licen[cs]e (?:v ?|version )?2(?: 0)?
sspl-1 server side public licen[cs]e
polyform polyform (?:noncommercial|small business|shield|strict|perimeter|free trial) licen[cs]e
commons-clause commons clause(?: licen[cs]e)? condition
ncsa university of illinois ncsa open source licen[cs]e
upl-1 universal permissive licen[cs]e
mulan-2 mulan (?:permissive software licen[cs]e|psl) v2
blueoak-1 blue oak model licen[cs]e
openrail (?:creativeml )?openrail(?: [msda])? licen[cs]e
openrail bigscience rail licen[cs]e
llama llama (?:[1-4] )?(?:[0-9] )?community licen[cs]e
rpl reciprocal public licen[cs]e
qpl q public licen[cs]e
sleepycat sleepycat licen[cs]e
beerware beerware licen[cs]e
openssl openssl licen[cs]e
json json licen[cs]e
vim vim licen[cs]e
w3c w3c software (?:notice and )?licen[cs]e
unicode unicode (?:terms of use|licen[cs]e agreement)
ofl open font licen[cs]e
lppl latex project public licen[cs]e
sisl sun industry standards source licen[cs]e
oset oset public licen[cs]e
nasa nasa open source agreement
"""

#: Short forms, which need a word beside them that speaks of licensing.
SHORT = r"""
agpl-3 agpl (?:v ?)?3(?: 0)?
agpl-3 agplv3(?: 0)?
lgpl-2.1 lgpl (?:v ?)?2 1
lgpl-2.1 lgplv2 1
lgpl-3 lgpl (?:v ?)?3(?: 0)?
lgpl-3 lgplv3(?: 0)?
gpl-3 gpl (?:v ?)?3(?: 0)?
gpl-3 gplv3(?: 0)?
gpl-2 gpl (?:v ?)?2(?: 0)?
gpl-2 gplv2(?: 0)?
mpl-2 mpl (?:v ?)?2 0
apache-2 apache 2 0
mit mit licensed
mit licensed under (?:the )?mit
bsd bsd licensed
gpl licensed under (?:the )?gpl
lgpl licensed under (?:the )?lgpl
agpl licensed under (?:the )?agpl
apache-2 licensed under (?:the )?apache 2(?: 0)?
apache licensed under (?:the )?apache licen[cs]e
cc0 licensed under (?:the )?cc0
cc0 cc0 licen[cs]ed?
gfdl licensed under (?:the )?gfdl
wtfpl licensed under (?:the )?wtfpl
public-domain released (?:in|in ?to) the public domain
public-domain dedicated to the public domain
all-rights-reserved all rights reserved
"""

SECTIONS = {"tag": TAG, "base": BASE, "notice": NOTICE, "name": NAME, "short": SHORT}
RULES: tuple[tuple[str, str, str], ...] = tuple(
    (tier, *line.split(" ", 1)) for tier, block in SECTIONS.items() for line in block.strip().split("\n"))
