"""Signatures of licenses, one rule a line: label | priority | keyword | regex over words joined by single blanks.

Every match holds the keyword. Among overlapping detections the higher priority wins: 95 the license's own sentences, 90
identifiers, 80 grants, 70 titles with a version, 60 titles, 50 notices and links, 40 relations, 20 weak hints.
"""

RULES = r"""
mit | 95 | hereby granted free | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | 95 | hereby granted free | permission is hereby granted free of charge to any person obtaining a copy
mit | 95 | without restriction | to deal in the software without restriction including without limitation the rights to use copy modify
mit | 95 | substantial portions | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | 95 | authors or copyright holders | in no event shall the authors or copyright holders be liable for any claim damages or other liability
mit-0 | 95 | permit persons | to permit persons to whom the software is furnished to do so the software is provided as is
mit | 90 | spdx | spdx license identifier mit
mit-0 | 90 | spdx | spdx license identifier mit 0
mit | 80 | under the mit | (?:licensed|released|distributed|available|published|provided|redistributed) under the mit(?: license| licence)?
mit | 80 | terms of the mit | under the terms of the mit(?: license| licence)?
mit | 60 | mit licen | (?:the )?mit licen[cs]ed?
mit | 60 | expat licen | (?:the )?expat licen[cs]e
mit-0 | 70 | mit no attribution | (?:the )?mit no attribution(?: licen[cs]e)?
mit | 50 | opensource org licenses mit | opensource org licenses mit(?: license)?(?: php)?
mit | 50 | license mit | license mit
x11 | 95 | x consortium shall not | the name of the x consortium shall not be used in advertising or otherwise to promote
x11 | 60 | x11 licen | (?:the )?x11 licen[cs]e
apache-2 | 70 | apache license version | (?:the )?apache license version 2(?: 0)?
apache-2 | 95 | except in compliance with the license | you may not use this file except in compliance with the license
apache-2 | 95 | without warranties or conditions | distributed on an as is basis without warranties or conditions of any kind
apache-2 | 95 | perpetual worldwide | grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license
apache-2 | 95 | prominent notices stating | you must cause any modified files to carry prominent notices stating that you changed the files
apache-2 | 90 | spdx | spdx license identifier apache 2 0
apache-1.1 | 90 | spdx | spdx license identifier apache 1 1
apache-2 | 80 | under the apache | (?:licensed|released|distributed|available|published) under the apache(?: software)? licen[cs]e(?: version)? (?:v ?)?2(?: 0)?
apache-2 | 80 | under apache | (?:licensed|released|distributed|available|published) under apache(?: licen[cs]e)?(?: version)? (?:v ?)?2(?: 0)?
apache | 60 | apache | (?:the )?apache(?: software)? licen[cs]ed?
apache-2 | 70 | apache | (?:the )?apache(?: software)?(?: licen[cs]e)?(?: version)? (?:v ?)?2 0(?: licen[cs]e)?
apache-1.1 | 70 | apache | (?:the )?apache(?: software)? licen[cs]e(?: version)? (?:v ?)?1 1
apache-1.1 | 95 | apache software foundation | this product includes software developed by the apache software foundation
apache-2 | 50 | apache org licenses | apache org licenses license 2 0
gpl | 95 | free software you can redistribute | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl | 95 | without any warranty | this program is distributed in the hope that it will be useful but without any warranty
gpl | 95 | gnu general public license along with | you should have received a copy of the gnu general public license along with this program
gpl-2 | 95 | either version 2 | gnu general public license as published by the free software foundation either version 2 of the license
gpl-3 | 95 | either version 3 | gnu general public license as published by the free software foundation either version 3 of the license
gpl-3 | 95 | protecting users | protecting users legal rights from anti circumvention law
gpl-3 | 95 | copyleft license for software | is a free copyleft license for software and other kinds of works
gpl-2 | 95 | applies to any program | this license applies to any program or other work which contains a notice placed by the copyright holder
gpl-1 | 90 | spdx | spdx license identifier gpl 1 0(?: only| or later)?
gpl-2 | 90 | spdx | spdx license identifier gpl 2 0(?: only| or later)?
gpl-3 | 90 | spdx | spdx license identifier gpl 3 0(?: only| or later)?
gpl-2 | 70 | general public license | (?:the )?(?:gnu )?general public license(?: version)? (?:v ?)?2(?: 0)?
gpl-3 | 70 | general public license | (?:the )?(?:gnu )?general public license(?: version)? (?:v ?)?3(?: 0)?
gpl-2 | 70 | gplv2 | (?:the )?gplv2(?: 0)?
gpl-3 | 70 | gplv3 | (?:the )?gplv3(?: 0)?
gpl-2 | 80 | under the gpl | (?:(?:licensed|released|distributed|available|published) )?under the gpl(?: version)? (?:v ?)?2(?: 0)?
gpl-3 | 80 | under the gpl | (?:(?:licensed|released|distributed|available|published) )?under the gpl(?: version)? (?:v ?)?3(?: 0)?
gpl | 60 | under the gpl | (?:licensed|released|distributed|available|published) under the gpl
gpl | 60 | under the gnu gpl | (?:licensed|released|distributed|available|published) under the gnu gpl
gpl-3 | 70 | gnu gpl | (?:the )?gnu gpl(?: version)? (?:v ?)?3(?: 0)?
gpl-2 | 70 | gnu gpl | (?:the )?gnu gpl(?: version)? (?:v ?)?2(?: 0)?
gpl | 60 | gnu general public licen | (?:the )?gnu general public licen[cs]e
gpl | 50 | gnu org licenses gpl | gnu org licenses gpl(?: [23] 0)?(?: html| txt)?
gpl | 50 | the gpl for | see the gpl for (?:more )?details
gpl | 40 | gpl compatible | gpl compatible
gpl-2-classpath | 95 | linking this library statically | linking this library statically or dynamically with other modules is making a combined work
gpl-2-classpath | 70 | classpath exception | (?:the )?(?:with )?(?:the )?classpath exception
lgpl | 95 | this library is free software | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl | 95 | lesser general public license along with | received a copy of the gnu lesser general public license along with this library
lgpl-2.1 | 90 | spdx | spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-3 | 90 | spdx | spdx license identifier lgpl 3 0(?: only| or later)?
lgpl-2.1 | 70 | lesser general public license | (?:the )?(?:gnu )?lesser general public license(?: version)? (?:v ?)?2 1
lgpl-3 | 70 | lesser general public license | (?:the )?(?:gnu )?lesser general public license(?: version)? (?:v ?)?3(?: 0)?
lgpl-2 | 70 | library general public license | (?:the )?(?:gnu )?library general public license(?: version)?(?: (?:v ?)?2(?: 0)?)?
lgpl-2.1 | 70 | lgplv2 | (?:the )?lgplv2(?: 1)?
lgpl-3 | 70 | lgplv3 | (?:the )?lgplv3(?: 0)?
lgpl-2.1 | 70 | lgpl | (?:the )?lgpl(?: version)? (?:v ?)?2 1
lgpl-3 | 70 | lgpl | (?:the )?lgpl(?: version)? (?:v ?)?3(?: 0)?
lgpl | 60 | lesser general public license | (?:the )?gnu lesser general public license
lgpl | 60 | lgpl | (?:the )?(?:gnu )?lgpl(?: licen[cs]ed?)?
agpl-3 | 95 | network server software | cooperation with the community in the case of network server software
agpl-3 | 95 | remotely through a computer network | interacting with it remotely through a computer network
agpl-3 | 90 | spdx | spdx license identifier agpl 3 0(?: only| or later)?
agpl-3 | 70 | affero general public license | (?:the )?(?:gnu )?affero general public license(?: version)? (?:v ?)?3(?: 0)?
agpl | 60 | affero general public license | (?:the )?(?:gnu )?affero general public license
agpl-3 | 70 | agplv3 | (?:the )?agplv3(?: 0)?
agpl-3 | 70 | agpl | (?:the )?agpl(?: version)? (?:v ?)?3(?: 0)?
agpl | 60 | agpl | (?:the )?(?:gnu )?agpl(?: licen[cs]ed?)?
gfdl | 95 | invariant sections | with no invariant sections no front cover texts and no back cover texts
gfdl-1.3 | 90 | spdx | spdx license identifier gfdl 1 [1-3](?: only| or later)?
gfdl | 60 | free documentation license | (?:the )?gnu free documentation license(?: version 1 [1-3])?
bsd | 95 | source and binary forms | redistribution and use in source and binary forms with or without modification are permitted
bsd-3 | 95 | neither the name | neither the name of (?:[^ ]+ ){1,12}nor the names of (?:its|their) contributors
bsd | 95 | following disclaimer | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd | 95 | following disclaimer | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd-4 | 95 | all advertising materials | all advertising materials mentioning features or use of this software must display the following
bsd-2-views | 95 | views and conclusions | the views and conclusions contained in the software and documentation are those of the authors
bsd-0 | 95 | with or without fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is
bsd-2 | 90 | spdx | spdx license identifier bsd 2 clause
bsd-3 | 90 | spdx | spdx license identifier bsd 3 clause
bsd-4 | 90 | spdx | spdx license identifier bsd 4 clause
bsd-0 | 90 | spdx | spdx license identifier 0bsd
bsd-2 | 70 | simplified bsd | (?:the )?simplified bsd(?: licen[cs]e)?
bsd-2 | 70 | freebsd licen | (?:the )?freebsd licen[cs]e
bsd-2 | 70 | clause | (?:the )?(?:bsd (?:2|two) clause|(?:2|two) clause bsd)(?: licen[cs]e)?
bsd-3 | 70 | clause | (?:the )?(?:bsd (?:3|three) clause|(?:3|three) clause bsd)(?: licen[cs]e)?
bsd-4 | 70 | clause | (?:the )?(?:bsd (?:4|four) clause|(?:4|four) clause bsd)(?: licen[cs]e)?
bsd-0 | 70 | clause | (?:the )?zero clause bsd(?: licen[cs]e)?
bsd-3 | 70 | modified bsd | (?:the )?modified bsd(?: licen[cs]e)?
bsd-3 | 70 | new bsd | (?:the )?new bsd licen[cs]e
bsd-3 | 70 | revised bsd | (?:the )?revised bsd(?: licen[cs]e)?
bsd-4 | 70 | original bsd | (?:the )?original bsd(?: licen[cs]e)?
bsd | 60 | bsd licen | (?:the )?bsd licen[cs]ed?
bsd | 40 | bsd style | bsd style(?: licen[cs]e)?
isc | 95 | copyright notice and this permission | provided that the above copyright notice and this permission notice appear in all copies
isc | 95 | for any purpose with or without fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided
isc | 90 | spdx | spdx license identifier isc
isc | 60 | isc licen | (?:the )?isc licen[cs]ed?
mpl-2 | 95 | source code form is subject | this source code form is subject to the terms of the mozilla public license(?: v 2 0)?
mpl-1.1 | 95 | subject to the mozilla | the contents of this file are subject to the mozilla public license version 1 1
mpl-2 | 95 | mozilla org mpl | you can obtain one at (?:https? )?mozilla org mpl 2 0
mpl-1.1 | 90 | spdx | spdx license identifier mpl 1 1
mpl-2 | 90 | spdx | spdx license identifier mpl 2 0
mpl-1.1 | 70 | mozilla public license | (?:the )?mozilla public license(?: version)? (?:v ?)?1 1
mpl-2 | 70 | mozilla public license | (?:the )?mozilla public license(?: version)? (?:v ?)?2(?: 0)?
mpl | 60 | mozilla public licen | (?:the )?mozilla public licen[cs]e
mpl-2 | 60 | under the mpl | under the mpl(?: version)? (?:v ?)?2(?: 0)?
epl-1 | 95 | eclipse public license v1 | made available under the terms of the eclipse public license v1(?: 0)?
epl-2 | 95 | eclipse public license v 2 | made available under the terms of the eclipse public license v 2 0
epl-1 | 90 | spdx | spdx license identifier epl 1 0
epl-2 | 90 | spdx | spdx license identifier epl 2 0
epl-1 | 70 | eclipse public license | (?:the )?eclipse public license(?: version)? (?:v ?)?1(?: 0)?
epl-2 | 70 | eclipse public license | (?:the )?eclipse public license(?: version)? (?:v ?)?2(?: 0)?
epl | 60 | eclipse public licen | (?:the )?eclipse public licen[cs]e
edl-1 | 60 | eclipse distribution license | eclipse distribution license(?: v ?1 0)?
eupl-1.2 | 95 | european union public | licensed under the european union public licen[cs]e
eupl-1.1 | 90 | spdx | spdx license identifier eupl 1 1
eupl-1.2 | 90 | spdx | spdx license identifier eupl 1 2
eupl-1.2 | 70 | eupl | (?:the )?eupl(?: version)? (?:v ?)?1 2
eupl-1.1 | 70 | eupl | (?:the )?eupl(?: version)? (?:v ?)?1 1
eupl | 60 | european union public | (?:the )?european union public licen[cs]e
cddl-1 | 95 | common development and distribution | subject to the terms of the common development and distribution license
cddl-1 | 90 | spdx | spdx license identifier cddl 1 [01]
cddl-1 | 70 | cddl | (?:the )?cddl(?: version)?(?: 1 [01])?
cddl-1 | 60 | common development and distribution | (?:the )?common development and distribution license(?: version)?(?: 1 [01])?
cpl-1 | 60 | common public license | (?:the )?common public license(?: version)?(?: 1 0)?
cpal-1 | 60 | common public attribution | (?:the )?common public attribution license(?: version)?(?: 1 0)?
ipl-1 | 60 | ibm public license | (?:the )?ibm public license(?: version)?(?: 1 0)?
osl-3 | 90 | spdx | spdx license identifier osl 3 0
osl-3 | 60 | open software license | (?:the )?open software license(?: version)?(?: 3 0)?
afl-3 | 90 | spdx | spdx license identifier afl 3 0
afl-3 | 60 | academic free license | (?:the )?academic free license(?: version)?(?: 3 0)?
zlib | 95 | altered source versions | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | 95 | origin of this software | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | 90 | spdx | spdx license identifier zlib
zlib | 60 | zlib | (?:the )?zlib(?: libpng)? licen[cs]e
libpng-2 | 60 | libpng licen | (?:the )?libpng licen[cs]e(?: version 2)?
boost-1 | 95 | boost software license | distributed under the boost software license version 1 0
boost-1 | 95 | machine executable object code | solely in the form of machine executable object code generated by a source language processor
boost-1 | 90 | spdx | spdx license identifier bsl 1 0
boost-1 | 60 | boost software license | (?:the )?boost software license(?: version)?(?: 1 0)?
busl-1.1 | 95 | non production use | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use
busl-1.1 | 90 | spdx | spdx license identifier busl 1 1
busl-1.1 | 60 | business source license | (?:the )?business source license(?: version)?(?: 1 1)?
sspl-1 | 90 | spdx | spdx license identifier sspl 1 0
sspl-1 | 60 | server side public license | (?:the )?server side public license(?: version)?(?: 1)?
elastic-2 | 95 | hosted or managed service | you may not provide the software to third parties as a hosted or managed service
elastic-2 | 60 | elastic license | (?:the )?elastic license(?: version)?(?: 2 0)?
unlicense | 95 | free and unencumbered | this is free and unencumbered software released into the public domain
unlicense | 95 | anyone is free to copy | anyone is free to copy modify publish use compile sell or distribute this software
unlicense | 90 | spdx | spdx license identifier unlicense
unlicense | 60 | unlicense | (?:the )?unlicense
wtfpl | 95 | what the fuck you want | you just do what the fuck you want to
wtfpl | 90 | spdx | spdx license identifier wtfpl
wtfpl | 60 | wtfpl | (?:the )?wtfpl
artistic-2 | 90 | spdx | spdx license identifier artistic 2 0
artistic-1 | 90 | spdx | spdx license identifier artistic 1 0(?: perl)?
artistic-2 | 70 | artistic license | (?:the )?artistic license(?: version)? 2(?: 0)?
artistic-1 | 70 | artistic license | (?:the )?artistic license(?: version)? 1(?: 0)?
artistic | 60 | artistic licen | (?:the )?artistic licen[cs]e
perl | 80 | same terms as perl | under the same terms as perl(?: itself| 5)?
python-2 | 95 | python software foundation | psf is making python available to licensee on an as is basis python software foundation
python-2 | 90 | spdx | spdx license identifier (?:python|psf) 2 0
python-2 | 60 | python software foundation license | (?:the )?python software foundation license(?: version)?(?: 2)?
python-2 | 60 | psf licen | (?:the )?psf licen[cs]e
postgresql | 90 | spdx | spdx license identifier postgresql
postgresql | 60 | postgresql licen | (?:the )?postgresql licen[cs]e
openssl | 95 | openssl toolkit | software developed by the openssl project for use in the openssl toolkit
openssl | 60 | openssl licen | (?:the )?openssl licen[cs]e
openssl | 95 | eric young | this product includes cryptographic software written by eric young
ofl-1.1 | 95 | reserved font name | no modified version of the font software may use the reserved font name
ofl-1.1 | 90 | spdx | spdx license identifier ofl 1 [01]
ofl-1.1 | 60 | open font license | (?:the )?(?:sil )?open font license(?: version)?(?: 1 1)?
ncsa | 90 | spdx | spdx license identifier ncsa
ncsa | 60 | ncsa | (?:the )?(?:university of illinois )?ncsa(?: open source)? licen[cs]e
vim | 60 | vim licen | (?:the )?vim licen[cs]e
php-3 | 95 | php software freely available | this product includes php software freely available from
php-3 | 90 | spdx | spdx license identifier php 3 0?1?
php-3 | 60 | php licen | (?:the )?php licen[cs]e(?: version)?(?: 3 01)?
ruby | 60 | ruby licen | (?:the )?ruby licen[cs]e
ruby | 80 | same terms as ruby | under the same terms as ruby(?: itself)?
tcl | 60 | tcl tk licen | (?:the )?tcl tk licen[cs]e
curl | 60 | curl licen | (?:the )?curl licen[cs]e
json | 95 | used for good not evil | the software shall be used for good not evil
beerware | 95 | buy me a beer | you can buy me a beer in return
beerware | 60 | beerware | (?:the )?beerware(?: licen[cs]e)?
ms-pl | 90 | spdx | spdx license identifier ms pl
ms-pl | 60 | microsoft public license | (?:the )?microsoft public license
ms-rl | 60 | microsoft reciprocal license | (?:the )?microsoft reciprocal license
w3c | 60 | w3c software | (?:the )?w3c software(?: and document)?(?: notice and)? licen[cs]e
unicode | 95 | unicode inc license | unicode inc license agreement data files and software
unicode | 90 | spdx | spdx license identifier unicode (?:dfs 201[56]|3 0)
icu | 60 | icu licen | (?:the )?icu licen[cs]e
blueoak-1 | 60 | blue oak model license | (?:the )?blue oak model license(?: 1 0 0)?
upl-1 | 60 | universal permissive license | (?:the )?universal permissive license(?: v ?1 0)?
cecill-2 | 60 | cecill | (?:the )?cecill(?: free software)? licen[cs]e(?: agreement)?
eiffel | 60 | eiffel forum license | (?:the )?eiffel forum license(?: version)?(?: 2)?
mulan-2 | 60 | mulan psl | (?:the )?mulan psl ?v?2?
cc0-1 | 95 | all copyright and related | has waived all copyright and related or neighboring rights
cc0-1 | 95 | affirmer hereby overtly | affirmer hereby overtly fully permanently irrevocably and unconditionally waives
cc0-1 | 90 | spdx | spdx license identifier cc0 1 0
cc0-1 | 70 | cc0 1 | (?:the )?cc0 1 0(?: universal)?
cc0-1 | 60 | creative commons | creative commons (?:cc0|zero)(?: 1 0)?(?: universal)?
cc-by | 90 | spdx | spdx license identifier cc by [1-4] [05]
cc-by-sa | 90 | spdx | spdx license identifier cc by sa [1-4] [05]
cc-by-nd | 90 | spdx | spdx license identifier cc by nd [1-4] [05]
cc-by-nc | 90 | spdx | spdx license identifier cc by nc [1-4] [05]
cc-by-nc-sa | 90 | spdx | spdx license identifier cc by nc sa [1-4] [05]
cc-by-nc-nd | 90 | spdx | spdx license identifier cc by nc nd [1-4] [05]
cc-by | 60 | creative commons | creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-sa | 70 | creative commons | (?:the )?creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-nd | 70 | creative commons | (?:the )?creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-nc | 70 | creative commons | (?:the )?creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-nc-sa | 75 | creative commons | creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-nc-nd | 75 | creative commons | creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by | 80 | under cc by | under cc by(?: [1-4] [05])?(?: licen[cs]e)?
cc-by-sa | 80 | cc by sa | (?:under )?cc by sa(?: [1-4] [05])?(?: licen[cs]e)?
cc-by-nd | 80 | cc by nd | (?:under )?cc by nd(?: [1-4] [05])?(?: licen[cs]e)?
cc-by-nc | 70 | cc by nc | (?:the )?cc by nc(?: [1-4] [05])?(?: licen[cs]e)?
cc-by-nc-sa | 80 | cc by nc sa | (?:under )?cc by nc sa(?: [1-4] [05])?(?: licen[cs]e)?
cc-by-nc-nd | 80 | cc by nc nd | (?:under )?cc by nc nd(?: [1-4] [05])?(?: licen[cs]e)?
cc-by | 50 | creativecommons org licenses by | creativecommons org licenses by [1-4] [05]
cc-by-sa | 50 | creativecommons org licenses by sa | creativecommons org licenses by sa [1-4] [05]
cc-by-nc | 50 | creativecommons org licenses by nc | creativecommons org licenses by nc [1-4] [05]
cc0-1 | 50 | creativecommons org publicdomain | creativecommons org publicdomain zero 1 0
cc-by-sa | 95 | remix transform or build upon | if you remix transform or build upon the material you must distribute your contributions under the same license
cc-by-nc | 95 | material for commercial purposes | you may not use the material for commercial purposes
cc-by-nd | 95 | may not distribute the modified | if you remix transform or build upon the material you may not distribute the modified material
odbl-1 | 95 | open database license | made available under the open database license
odbl-1 | 90 | spdx | spdx license identifier odbl 1 0
odbl-1 | 60 | odbl | (?:the )?odbl(?: 1 0)?
odbl-1 | 60 | open database license | (?:the )?open database license
odc-by-1 | 60 | open data commons attribution | open data commons attribution licen[cs]e(?: v ?1 0)?
pddl-1 | 60 | public domain dedication | (?:open data commons )?public domain dedication(?: and)? licen[cs]e
ogl-3 | 60 | open government licen | (?:the )?open government licen[cs]e(?: v ?3 0)?
llama-community | 60 | community license agreement | llama [23](?: [0-9])? community license agreement
openrail | 60 | openrail | (?:creativeml |bigscience )?openrail(?: [ms])?(?: licen[cs]e)?
openrail | 95 | use based restrictions | use based restrictions as referenced in paragraph 5
rail | 60 | responsible ai licen | (?:the )?responsible ai licen[cs]e
aladdin | 60 | aladdin free public license | (?:the )?aladdin free public license
commons-clause | 95 | without limiting other conditions | without limiting other conditions in the license the grant of rights under the license will not include
commons-clause | 60 | commons clause | (?:the )?commons clause(?: licen[cs]e condition)?
polyform | 60 | polyform | polyform (?:noncommercial|shield|strict|perimeter|small business)(?: license)?(?: 1 0 0)?
public-domain | 80 | public domain | (?:dedicated|released|placed|put) (?:in)?to the public domain
public-domain | 60 | the public domain | (?:is|are|lies) in the public domain
proprietary | 80 | proprietary and confidential | (?:this [^ ]+ is )?proprietary and confidential
proprietary | 80 | unauthorized copying | unauthorized copying of this (?:file|software|document)
proprietary | 60 | proprietary licen | (?:a )?proprietary licen[cs]e
non-commercial | 40 | commercial use only | (?:for )?non ?commercial use only
non-commercial | 40 | purposes only | for (?:academic|research|non ?profit) (?:research )?purposes only
evaluation | 40 | evaluation purposes only | for evaluation purposes only
dual | 40 | dual licensed | dual licensed (?:under|with|as)
all-rights-reserved | 20 | rights reserved | all rights reserved
copyright | 20 | copyright | copyright (?:c )?(?:19|20)[0-9]{2}
"""
