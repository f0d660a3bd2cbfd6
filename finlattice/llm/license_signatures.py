"""Hand-written license signatures, one per line: kind and pattern under the label they give.

Patterns are over normalised text: lower-case words with single spaces, all else being white space; `license`
also stands for `licence`.  Kinds, from the most to the least telling: `text` is wording of the license itself, `notice` a
header that files carry, `named` a sentence that grants or requires it by name, `mention` its name alone.
"""

SIGNATURES = r"""
[mit]
text    permission is hereby granted free of charge to any person obtaining a copy
text    to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software
text    and to permit persons to whom the software is furnished to do so subject to the following conditions
text    the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
text    the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
text    in no event shall the authors or copyright holders be liable for any claim damages or other liability
notice  licensed under the terms of the mit license
notice  use of this source code is governed by an mit style license
notice  this (?:source code|project|file|software|package) is (?:licensed|released|distributed|made available) under the mit license
notice  license mit(?= (?:c|copyright|author|url|version|homepage)\b)
named   mit licensed
named   the mit license mit
named   dual licensed under the mit
mention the mit license
[mit-x11]
text    except as contained in this notice the name of the x consortium shall not be used in advertising
text    except as contained in this notice the names? of the above copyright holders? shall not be used in advertising or otherwise to promote the sale
named   x11 style license
[mit-0]
named   mit no attribution
notice  licensed under the mit 0 license
[isc]
text    permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
text    provided that the above copyright notice and this permission notice appear in all copies
text    the software is provided as is and (?:the author|isc|internet systems consortium) disclaims all warranties with regard to this software
named   isc licensed
mention the isc license
[0bsd]
text    permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is
named   zero clause bsd
mention 0bsd license
[bsd]
text    redistribution and use in source and binary forms with or without modification are permitted
text    redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
text    redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
text    this software is provided by the (?:copyright holders|authors?|regents) and contributors as is and any express or implied warranties
text    in no event shall the (?:copyright (?:holder|owner)s?|regents|authors?) or contributors be liable for any direct indirect incidental special exemplary or consequential damages
notice  use of this source code is governed by a bsd style license
notice  licensed under the bsd license see
named   bsd licensed
mention the bsd license
[bsd-3-clause]
text    neither the names? of .{1,80}? nor the names of (?:its|their) contributors may be used to endorse or promote products
text    the names? of the authors? may not be used to endorse or promote products derived from this software
text    neither the name of the university nor the names of its contributors
notice  use of this source code is governed by a bsd 3 clause license
notice  licensed under the (?:new|modified|revised|3 clause) bsd license
named   new bsd license
mention bsd 3 clause
[bsd-2-clause]
text    the views and conclusions contained in the software and documentation are those of the authors and should not be interpreted as representing official policies
notice  use of this source code is governed by a bsd 2 clause license
named   simplified bsd license
mention bsd 2 clause
[bsd-4-clause]
text    all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
text    this product includes software developed by the university of california
mention original bsd license
[bsd-protection]
named   bsd protection license
[bsd-clear]
text    no express or implied licenses to any party s patent rights are granted by this license
named   clear bsd license
[apache-2]
text    apache license version 2 0 january 2004
text    terms and conditions for use reproduction and distribution 1 definitions
text    subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|except as stated)
text    if you institute patent litigation against any entity including a cross claim or counterclaim in a lawsuit alleging that the work
text    you must give any other recipients of the work or derivative works a copy of this license
text    you must cause any modified files to carry prominent notices stating that you changed the files
text    if the work includes a notice text file as part of its distribution
notice  you may not use this file except in compliance with the license you may obtain a copy of the license at
notice  licensed to the apache software foundation asf under one or more contributor license agreements
notice  unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
named   www apache org licenses license 2 0
named   apache 2 0 licensed
named   apache license v ?2(?: 0)?
mention apache 2 0 license
[apache-1.1]
text    the end user documentation included with the redistribution if any must include the following acknowledg(?:e)?ment
text    products derived from this software may not be called apache nor may apache appear in their name
named   apache software license version 1 1
[apache-1]
named   apache license version 1 0
text    this product includes software developed by the apache group for use in the apache http server project
[gpl-1-or-later]
notice  gnu general public license as published by the free software foundation either version 1 or at your option any later version
[gpl-2]
text    gnu general public license version 2 june 1991
text    the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu general public license is intended to guarantee
text    you must cause the modified files to carry prominent notices stating that you changed the files and the date of any change
text    you may not copy modify sublicense or distribute the program except as expressly provided under this license
text    activities other than copying distribution and modification are not covered by this license they are outside its scope
notice  gnu general public license version 2 as published by the free software foundation
notice  under the terms of the gnu general public license version 2 only
notice  this program is free software you can redistribute it and or modify it under the terms of version 2 of the gnu general public license
named   license gpl ?v?2(?! \d| or later)
[gpl-2-or-later]
notice  gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
notice  gnu general public license version 2 or at your option any later version
named   gpl ?v?2 or later
named   gplv2\+
[gpl-3]
text    gnu general public license version 3 29 june 2007
text    the gnu general public license is a free copyleft license for software and other kinds of works
text    you may convey verbatim copies of the program s source code as you receive it
text    no covered work shall be deemed part of an effective technological measure
text    the corresponding source for a work in object code form means all the source code needed to generate install and
text    each contributor grants you a non exclusive worldwide royalty free patent license under the contributor s essential patent claims
notice  gnu general public license as published by the free software foundation version 3 of the license
notice  under the terms of the gnu general public license version 3 only
named   license gpl ?v?3(?! \d| or later)
[gpl-3-or-later]
notice  gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
named   gpl ?v?3 or later
[gpl]
text    you should have received a copy of the gnu general public license along with this program
text    this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability
notice  module license gpl
named   (?:released|distributed|licensed) under the gpl
mention gnu gpl
[gpl-with-classpath-exception]
text    linking this library statically or dynamically with other modules is making a combined work based on this library
named   designates this particular file as subject to the classpath exception
named   classpath exception to the gpl
[gpl-with-gcc-exception]
named   under section 7 of gpl version 3 you are granted additional permissions described in the gcc runtime library exception
named   gcc runtime library exception version 3 1
[gpl-with-font-exception]
text    as a special exception if you create a document which uses this font and embed this font
[gpl-with-autoconf-exception]
text    as a special exception to the gnu general public license if you distribute this file as part of a program that contains a configuration script generated by autoconf
[gpl-with-linux-syscall-note]
text    this copyright does not cover user programs that use kernel services by normal system calls
[lgpl-2]
text    gnu library general public license version 2 june 1991
notice  gnu library general public license as published by the free software foundation either version 2 of the license
[lgpl-2.1]
text    gnu lesser general public license version 2 1 february 1999
text    this license the lesser general public license applies to some specially designated software packages typically libraries
text    a program that contains no derivative of any portion of the library but is designed to work with the library by being compiled or linked with it
notice  gnu lesser general public license as published by the free software foundation version 2 1
named   license lgpl ?v?2 1(?! or later)
[lgpl-2.1-or-later]
notice  gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
named   lgpl ?v?2 1 or later
[lgpl-3]
text    this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license
text    an application is any work that makes use of an interface provided by the library but which is not otherwise based on the library
named   license lgpl ?v?3(?! or later)
[lgpl-3-or-later]
notice  gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
[lgpl]
text    you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:library|program)
named   (?:released|distributed|licensed) under the lgpl
mention gnu lgpl
[agpl-3]
text    gnu affero general public license version 3 19 november 2007
text    if you modify the program your modified version must prominently offer all users interacting with it remotely through a computer network
notice  gnu affero general public license as published by the free software foundation version 3
named   license agpl ?v?3(?! or later)
[agpl-3-or-later]
notice  gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
[agpl]
text    you should have received a copy of the gnu affero general public license
mention gnu agpl
[gfdl]
text    the purpose of this license is to make a manual textbook or other functional and useful document free in the sense of freedom
notice  permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
text    with no invariant sections no front cover texts and no back cover texts
[mpl-1.1]
text    mozilla public license version 1 1 1 definitions
notice  the contents of this file are subject to the mozilla public license version 1 1 the license you may not use this file except in compliance
notice  the contents of this file may be used under the terms of either the gnu general public license version 2 or later the gpl or the gnu lesser general public license version 2 1
named   www mozilla org mpl mpl 1 1
[mpl-2]
text    mozilla public license version 2 0 1 definitions
notice  this source code form is subject to the terms of the mozilla public license v 2 0
notice  if a copy of the mpl was not distributed with this file you can obtain one at
text    incompatible with secondary licenses means a that the initial contributor has attached the notice
named   (?:www )?mozilla org mpl 2 0
[mpl]
text    software distributed under the license is distributed on an as is basis without warranty of any kind either express or implied see the license for the specific language governing rights and limitations
mention mozilla public license
[npl-1.1]
notice  the contents of this file are subject to the netscape public license version 1 1
[epl-1]
text    eclipse public license v 1 0 the accompanying program is provided under the terms of this eclipse public license
notice  accompanying materials are made available under the terms of the eclipse public license v ?1 0
named   www eclipse org legal epl v10
[epl-2]
text    eclipse public license v 2 0 the accompanying program is provided under the terms of this eclipse public license
notice  accompanying materials are made available under the terms of the eclipse public license v? ?2 0
named   www eclipse org legal epl (?:v20|2 0)
[edl-1]
named   eclipse distribution license v? ?1 0
named   www eclipse org org documents edl v10
[cpl-1]
text    the accompanying program is provided under the terms of this common public license
notice  made available under the terms of the common public license v? ?1 0
[ipl-1]
text    the accompanying program is provided under the terms of this ibm public license
[cddl-1]
text    common development and distribution license cddl version 1 0 1 definitions
notice  the contents of this file are subject to the terms of the common development and distribution license
notice  when distributing (?:the software|covered code) include this cddl header notice in each file
[cddl-1.1]
text    common development and distribution license cddl version 1 1
[eupl-1.1]
notice  licensed under the eupl version 1 1 or as soon they will be approved by the european commission
[eupl-1.2]
text    european union public license v 1 2 eupl
notice  licensed under the eupl version 1 2
text    the work means the work as defined below which is provided under the terms of this licen[cs]e any use of the work other than as authorised under this licence
[osl-3]
notice  licensed under the open software license version 3 0
[afl-3]
notice  licensed under the academic free license version 3 0
[afl-2.1]
notice  licensed under the academic free license version 2 1
[artistic-1]
text    the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control
named   under the same terms as perl itself
[artistic-2]
text    the artistic license 2 0 copyright c 2000 2006 the perl foundation
text    this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed
[bsl-1]
text    boost software license version 1 0 august 17th 2003
text    permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
notice  distributed under the boost software license version 1 0
named   www boost org license 1 0 txt
[busl-1.1]
text    the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
named   business source license 1 1
[sspl-1]
text    if you make the functionality of the program or a modified version available to third parties as a service you must make the service source code available
named   server side public license
[elastic-2]
text    you may not provide the software to third parties as a hosted or managed service where the service provides users with access to any substantial set of the features
named   elastic license 2 0
[commons-clause]
text    the grant of rights under the license will not include and the license does not grant to you the right to sell the software
named   commons clause license condition
[ofl-1.1]
text    sil open font license version 1 1 26 february 2007
text    the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects
notice  this font software is licensed under the sil open font license version 1 1
text    no modified version of the font software may use the reserved font name
named   scripts sil org ofl
[ofl-1]
notice  this font software is licensed under the sil open font license version 1 0
[php-3.01]
text    products derived from this software may not be called php nor may php appear in their name
notice  this source file is subject to version 3 01 of the php license
[php-3]
notice  this source file is subject to version 3 0 of the php license
[python-2]
text    python software foundation license version 2
text    psf hereby grants licensee a nonexclusive royalty free world wide license to reproduce analyze test perform and or display publicly
named   psf license agreement for python
[ruby]
text    you may make and give away verbatim copies of the source form of the software without restriction provided that you duplicate all of the original copyright notices
named   under the same terms as ruby
[zpl-2.1]
text    zope public license zpl version 2 1
notice  this software is subject to the provisions of the zope public license version 2 1
[zpl-2]
notice  this software is subject to the provisions of the zope public license version 2 0
[zlib]
text    this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
text    the origin of this software must not be misrepresented you must not claim that you wrote the original software
text    altered source versions must be plainly marked as such and must not be misrepresented as being the original software
named   zlib libpng license
[libpng]
text    the png reference library is supplied as is
text    permission is hereby granted to use copy modify and distribute this source code or portions hereof for any purpose without fee subject to the following restrictions 1 the origin of this source code
[libtiff]
text    permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee provided that i the above copyright notices
[ijg]
text    this software is based in part on the work of the independent jpeg group
[curl]
text    permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided
named   this software is licensed as described in the file copying which you should have received as part of this distribution the terms are also available at https curl
[openssl]
text    this product includes software developed by the openssl project for use in the openssl toolkit
text    the names openssl toolkit and openssl project must not be used to endorse or promote products
[ssleay]
text    this product includes cryptographic software written by eric young
[postgresql]
text    permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
text    in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages including lost profits
mention the postgresql license
[ntp]
text    permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted provided that the above copyright notice appears in all copies
[hpnd]
text    permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted provided that the above copyright notice
[ncsa]
text    to deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense
named   university of illinois ncsa open source license
notice  this file is distributed under the university of illinois open source license
[apache-2-with-llvm-exception]
notice  part of the llvm project under the apache license v2 0 with llvm exceptions
text    if in the event that combining or linking is done in accordance with the llvm exceptions
[unicode]
text    permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
named   unicode inc license agreement data files and software
[icu]
text    copyright c 1995 \d{4} international business machines corporation and others all rights reserved permission is hereby granted
[w3c]
text    permission to copy modify and distribute this (?:software|work) and its documentation with or without modification for any purpose and without fee or royalty is hereby granted
named   w3c software notice and license
[vim]
text    you can freely distribute unmodified copies of vim
named   the vim license
[tcl]
text    the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose provided that existing copyright notices are retained in all copies
[latex-lppl-1.3]
notice  this work may be distributed and or modified under the conditions of the latex project public license
text    the current maintainer of this work is
[wtfpl]
text    do what the fuck you want to public license terms and conditions for copying distribution and modification
text    0 you just do what the fuck you want to
[beerware]
text    as long as you retain this notice you can do whatever you want with this stuff if we meet some day and you think this stuff is worth it you can buy me a beer in return
named   the beer ?ware license
[unlicense]
text    this is free and unencumbered software released into the public domain
text    anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary
text    we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors
named   refer to http(?:s)? unlicense org
[cc0]
text    the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights
text    creative commons cc0 1 0 universal
text    to the extent possible under law(?: .{0,80}?)? has waived all copyright and related or neighboring rights
named   creativecommons org publicdomain zero 1 0
mention creative commons zero
mention cc0(?: 1 0)?
[public-domain]
text    (?:released|placed|dedicated|put) (?:in|into|to) the public domain
text    is hereby placed in the public domain
text    the authors? disclaims? copyright to this source code in place of a legal notice here is a blessing
named   this (?:file|code|work|software) is (?:in the )?public domain
named   no copyright is claimed
[cc-by]
text    you are free to share copy and redistribute the material in any medium or format and adapt
text    you must give appropriate credit provide a link to the license and indicate if changes were made
[cc-by-4]
named   creativecommons org licenses by 4 0
named   creative commons attribution 4 0 international
[cc-by-3]
named   creativecommons org licenses by 3 0
named   creative commons attribution 3 0 unported
[cc-by-sa]
text    if you remix transform or build upon the material you must distribute your contributions under the same license as the original
[cc-by-sa-4.0]
named   creativecommons org licenses by sa 4 0
[cc-by-sa-3.0]
named   creativecommons org licenses by sa 3 0
[cc-by-nc]
text    you may not use the material for commercial purposes
named   creativecommons org licenses by nc(?! (?:sa|nd))
[cc-by-nc-sa]
named   creativecommons org licenses by nc sa
[cc-by-nc-nd]
named   creativecommons org licenses by nc nd
[cc-by-nd]
text    if you remix transform or build upon the material you may not distribute the modified material
named   creativecommons org licenses by nd
[odbl-1]
text    this database is made available under the open database license
named   opendatacommons org licenses odbl
[odc-by-1]
text    this database is made available under the open data commons attribution license
named   opendatacommons org licenses by
[pddl-1]
named   public domain dedication and license pddl
named   opendatacommons org licenses pddl
[ogl-uk-3]
text    contains public sector information licensed under the open government license v3 0
[upl-1]
text    the universal permissive license upl version 1 0
text    subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data
[ms-pl]
text    this license governs use of the accompanying software if you use the software you accept this license
named   microsoft public license ms pl
[ms-rl]
named   microsoft reciprocal license ms rl
[ms-eula]
text    these license terms are an agreement between microsoft corporation or based on where you live one of its affiliates and you
[json]
text    the software shall be used for good not evil
[openrail-m]
text    you agree not to use the model or derivatives of the model in any way that violates any applicable national federal state local or international law
named   creativeml open ?rail m license
[llama-community]
named   llama \d(?: \d)? community license
text    is licensed under the llama \d(?: \d)? community license copyright
[gemma-terms]
named   gemma is provided under and subject to the gemma terms of use
[proprietary]
text    unauthorized copying of this file via any medium is strictly prohibited proprietary and confidential
text    this (?:software|document|file) contains confidential and proprietary information of
text    no part of this (?:publication|document|book|work) may be reproduced (?:stored|distributed|or transmitted)
text    this software is licensed not sold
text    you may not reverse engineer decompile or disassemble the software
text    your use of this software is governed by the end user license agreement
notice  (?:copyright|c) (?:\d{4} )?.{1,60}? all rights reserved
[see-license-file]
notice  see the license file (?:in the root of this repository )?for (?:details|license|more information)
notice  see license (?:txt|md) (?:file )?(?:in the project root )?for (?:license|full license|details|more)
notice  for license information please see
named   licensed under the terms (?:described|found) in the license file
[export-restricted]
text    this software may be subject to export control laws
[contributor-agreement]
named   contributor license agreement
named   developer certificate of origin
"""
