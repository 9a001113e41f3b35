"""License scans by ordered signature rules, in DataFrame operations alone.

A text is lower-cased (A to Z only), and its words are joined by single spaces. Rules are regular expressions over such words: sentences written out of licences'
bodies, notices and exceptions, and names by families, versions and sentence templates; a rule is tried only if one of its keywords is among the words. Of detections, one that lies inside another gives way to it,
and of equal intervals the one of higher priority stays.
"""

from __future__ import annotations

import json
from functools import reduce
from itertools import product
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base phrases, by their words, and labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: What isn't part of a word, in a text that may have upper case.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Families: label, keywords of which one must be there, names as patterns over words, versions ("" where it can be without).
FAMILIES = (
    ("apache", ("apache", "asl"), ("(?:the )?apache(?: software)?(?: license)?", "asl"), ("1", "1.1", "2", "")),
    ("mit", ("mit", "expat"), ("(?:the )?(?:mit|expat)(?: x11)? licen[cs]e",), ("",)),
    ("gpl", ("general", "gpl"), ("(?:the )?(?:gnu )?general public licen[cs]e", "(?:gnu )?gpl"), ("1", "2", "3", "")),
    ("lgpl", ("lesser", "library", "lgpl"), ("(?:the )?(?:gnu )?(?:lesser|library) general public licen[cs]e", "(?:gnu )?lgpl"), ("2", "2.1", "3", "")),
    ("agpl", ("affero", "agpl"), ("(?:the )?(?:gnu )?affero general public licen[cs]e", "(?:gnu )?agpl"), ("1", "3", "")),
    ("gfdl", ("documentation", "gfdl"), ("(?:the )?(?:gnu )?free documentation licen[cs]e", "gfdl"), ("1.1", "1.2", "1.3", "")),
    ("bsd-2-clause", ("bsd", "freebsd"), ("(?:the )?(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)(?: licen[cs]e)?",), ("",)),
    ("bsd-3-clause", ("bsd",), ("(?:the )?(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: licen[cs]e)?",), ("",)),
    ("bsd-4-clause", ("bsd",), ("(?:the )?(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)(?: licen[cs]e)?",), ("",)),
    ("bsd", ("bsd",), ("(?:the )?bsd(?: style)? licen[cs]e",), ("",)),
    ("mpl", ("mozilla", "mpl"), ("(?:the )?mozilla public licen[cs]e", "mpl"), ("1", "1.1", "2", "")),
    ("epl", ("eclipse", "epl"), ("(?:the )?eclipse public licen[cs]e", "epl"), ("1", "2", "")),
    ("cddl", ("cddl", "distribution"), ("(?:the )?common development and distribution licen[cs]e", "cddl"), ("1", "1.1", "")),
    ("eupl", ("union", "eupl"), ("(?:the )?european union public licen[cs]e", "eupl"), ("1", "1.1", "1.2", "")),
    ("osl", ("osl", "open"), ("(?:the )?open software licen[cs]e", "osl"), ("1", "2", "2.1", "3", "")),
    ("afl", ("academic", "afl"), ("(?:the )?academic free licen[cs]e", "afl"), ("1.1", "2", "2.1", "3", "")),
    ("artistic", ("artistic",), ("(?:the )?artistic licen[cs]e",), ("1", "2", "")),
    ("cc-by-nc-sa", ("cc", "creative"), ("cc by nc sa", "(?:the )?creative commons attribution non ?commercial share ?alike(?: licen[cs]e)?"), ("1", "2", "2.5", "3", "4", "")),
    ("cc-by-nc-nd", ("cc", "creative"), ("cc by nc nd", "(?:the )?creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)?(?: licen[cs]e)?"), ("1", "2", "2.5", "3", "4", "")),
    ("cc-by-nc", ("cc", "creative"), ("cc by nc", "(?:the )?creative commons attribution non ?commercial(?: licen[cs]e)?"), ("1", "2", "2.5", "3", "4", "")),
    ("cc-by-sa", ("cc", "creative"), ("cc by sa", "(?:the )?creative commons attribution share ?alike(?: licen[cs]e)?"), ("1", "2", "2.5", "3", "4", "")),
    ("cc-by-nd", ("cc", "creative"), ("cc by nd", "(?:the )?creative commons attribution no ?deriv(?:ative)?s(?: licen[cs]e)?"), ("1", "2", "2.5", "3", "4", "")),
    ("cc-by", ("cc", "creative"), ("cc by", "(?:the )?creative commons attribution(?: licen[cs]e)?"), ("1", "2", "2.5", "3", "4", "")),
    ("cc0", ("cc0", "zero", "cczero"), ("cc0", "(?:creative commons )?cc ?zero", "creative commons zero"), ("1", "")),
    ("isc", ("isc",), ("(?:the )?isc licen[cs]e",), ("",)),
    ("zlib", ("zlib", "libpng"), ("(?:the )?zlib(?: libpng)? licen[cs]e",), ("",)),
    ("boost", ("boost",), ("(?:the )?boost software licen[cs]e",), ("1", "")),
    ("unlicense", ("unlicense",), ("(?:the )?unlicense",), ("",)),
    ("wtfpl", ("wtfpl",), ("(?:the )?wtfpl",), ("1", "2", "")),
    ("ms-pl", ("microsoft",), ("(?:the )?microsoft public licen[cs]e",), ("",)),
    ("ms-rl", ("microsoft",), ("(?:the )?microsoft reciprocal licen[cs]e",), ("",)),
    ("psf", ("python", "psf"), ("(?:the )?python software foundation licen[cs]e", "(?:the )?psf licen[cs]e"), ("2", "")),
    ("postgresql", ("postgresql",), ("(?:the )?postgresql licen[cs]e",), ("",)),
    ("php", ("php",), ("(?:the )?php licen[cs]e",), ("3", "3.01", "")),
    ("openssl", ("openssl",), ("(?:the )?openssl licen[cs]e",), ("",)),
    ("ofl", ("sil", "ofl"), ("(?:the )?sil open font licen[cs]e", "ofl"), ("1", "1.1", "")),
    ("odbl", ("database", "odbl"), ("(?:the )?open (?:data commons open )?database licen[cs]e", "odbl"), ("1", "")),
    ("public-domain", ("public",), ("(?:the )?public domain",), ("",)),
    ("proprietary", ("rights", "proprietary"), ("all rights reserved", "proprietary(?: and confidential| licen[cs]e| software)"), ("",)),
)
#: Sentences of licences' bodies, headers, notices and exceptions, and names without versions: label, keywords of which one must be there, pattern over words.
SIGNATURES = (
    ("mit", ("permission",), "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", ("substantial",), "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("x11", ("advertising",), "except as contained in this notice the names? of [a-z0-9 ]{1,80}? shall not be used in advertising or otherwise to promote the sale"),
    ("isc", ("permission",), "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("0bsd", ("permission",), "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("0bsd", ("bsd", "0bsd"), "(?:bsd zero clause|zero clause bsd|0bsd)(?: licen[cs]e)?"),
    ("postgresql", ("permission",), "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("hpnd", ("permission",), "permission to use copy modify and distribute this software and its documentation for any purpose(?: and without fee)? is hereby granted"),
    ("boost-1", ("permission",), "permission is hereby granted free of charge to any person or organi[sz]ation obtaining a copy of the software and accompanying documentation covered by this licen[cs]e"),
    ("bsd", ("redistribution",), "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", ("redistributions",), "redistributions of source code must retain the above copyright notice this list of conditions"),
    ("bsd", ("redistributions",), "redistributions in binary form must reproduce the above copyright notice this list of conditions"),
    ("bsd-3-clause", ("endorse",), "neither the names? of [a-z0-9 ]{1,80}? nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4-clause", ("advertising",), "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("ncsa", ("ncsa", "illinois"), "(?:university of illinois )?ncsa open source licen[cs]e"),
    ("apache-2", ("applicable",), "unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis"),
    ("apache-2", ("apache",), "you may obtain a copy of the licen[cs]e at https? www apache org licenses licen[cs]e 2 0"),
    ("apache-1.1", ("redistribution",), "the end user documentation included with the redistribution if any must include the following acknowledge?ment"),
    ("gpl", ("general",), "you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation"),
    ("gpl", ("general",), "you should have received a copy of the gnu general public licen[cs]e along with"),
    ("lgpl", ("lesser", "library"), "you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e along with"),
    ("agpl", ("affero",), "you should have received a copy of the gnu affero general public licen[cs]e along with"),
    ("gpl", ("merchantability",), "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("classpath-exception", ("exception",), "as a special exception the copyright holders of this library give you permission to link this library with independent modules"),
    ("gcc-exception", ("exception",), "gcc runtime library exception"),
    ("bison-exception", ("exception",), "as a special exception you may create a larger work that contains part or all of the bison parser skeleton"),
    ("llvm-exception", ("exception", "exceptions"), "(?:llvm exceptions? to the apache 2 0 licen[cs]e|with llvm exceptions?)"),
    ("gfdl", ("documentation",), "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e"),
    ("mpl-2", ("mozilla",), "this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0"),
    ("mpl-1.1", ("mozilla",), "the contents of this file are subject to the mozilla public licen[cs]e version 1 1"),
    ("epl", ("eclipse",), "this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e"),
    ("cddl", ("distribution",), "the contents of this file are subject to the terms of the common development and distribution licen[cs]e"),
    ("zlib", ("liable",), "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", ("altered",), "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("unlicense", ("unencumbered",), "this is free and unencumbered software released into the public domain"),
    ("cc0", ("waived",), "has waived all copyright and related or neighbou?ring rights"),
    ("ofl-1.1", ("sil",), "this font software is licensed under the sil open font licen[cs]e version 1 1"),
    ("artistic", ("artistic", "intent"), "the intent of this document is to state the conditions under which a package may be copied"),
    ("openssl", ("openssl",), "this product includes software developed by the openssl project"),
    ("php", ("php",), "this product includes php software freely available from"),
    ("psf", ("psf",), "psf is making python available to licensee on an as is basis"),
    ("ms-pl", ("governs",), "this licen[cs]e governs use of the accompanying software if you use the software you accept this licen[cs]e"),
    ("w3c", ("licensee",), "by obtaining using and or copying this work you the licensee agree that you have read understood and will comply"),
    ("json", ("evil",), "the software shall be used for good not evil"),
    ("beerware", ("beer",), "if we meet some day and you think this stuff is worth it you can buy me a beer"),
    ("upl-1", ("universal",), "(?:the )?universal permissive licen[cs]e(?: v(?:ersion)? 1(?: 0)?)?"),
    ("bsl-1.1", ("business",), "(?:the )?business source licen[cs]e(?: (?:version )?1 1)?"),
    ("sspl-1", ("sspl", "server"), "(?:the )?(?:server side public licen[cs]e|sspl)(?: (?:version |v)?1)?"),
    ("elastic-2", ("elastic",), "(?:the )?elastic licen[cs]e(?: (?:version )?2(?: 0)?)?"),
    ("polyform", ("polyform",), "(?:the )?polyform (?:non ?commercial|shield|strict|small business|perimeter|free trial|internal use) licen[cs]e"),
    ("mulan-psl", ("mulan",), "(?:the )?mulan (?:psl|permissive software licen[cs]e)(?: v?2)?"),
    ("cecill", ("cecill",), "(?:the )?cecill(?: [abc])?(?: licen[cs]e)?"),
    ("zpl", ("zope",), "(?:the )?zope public licen[cs]e"),
    ("ibm-pl", ("ibm",), "(?:the )?ibm public licen[cs]e"),
    ("cpl", ("common",), "(?:the )?common public licen[cs]e(?: version 1(?: 0)?)?"),
    ("vim", ("vim",), "(?:the )?vim licen[cs]e"),
    ("ruby", ("ruby",), "(?:the )?ruby licen[cs]e"),
    ("proprietary", ("confidential",), "this (?:software|document|file) (?:is|contains) (?:the )?confidential(?: and proprietary)? information of"),
    ("proprietary", ("reproduced",), "no part of this (?:publication|document|work) may be reproduced"),
    ("proprietary", ("unauthorized", "unauthorised"), "unauthori[sz]ed copying of this file via any medium is strictly prohibited"),
)
#: More names, headers and sentences. Each holds one of HINTS whatever it leaves out, so its keywords needn't be looked for in every text.
NAMED = (
    ("apache-2", ("apache",), "licen[cs]ed to the apache software foundation asf under one or more contributor licen[cs]e agreements"),
    ("apache-2", ("apache",), "apache licen[cs]e version 2 0 january 2004"),
    ("apache-2", ("contributor",), "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[cs]e"),
    ("gpl-2", ("general",), "gnu general public licen[cs]e version 2 june 1991"),
    ("gpl-3", ("general",), "gnu general public licen[cs]e version 3 29 june 2007"),
    ("gpl", ("copyleft",), "the gnu general public licen[cs]e is a free copyleft licen[cs]e for software and other kinds of works"),
    ("gpl", ("freedom",), "the licen[cs]es for most software(?: and other practical works)? are designed to take away your freedom to share and change"),
    ("lgpl-2.1", ("lesser",), "gnu lesser general public licen[cs]e version 2 1 february 1999"),
    ("lgpl-3", ("lesser",), "gnu lesser general public licen[cs]e version 3 29 june 2007"),
    ("lgpl-2", ("library",), "gnu library general public licen[cs]e version 2 june 1991"),
    ("agpl-3", ("affero",), "gnu affero general public licen[cs]e version 3 19 november 2007"),
    ("gfdl-1.3", ("documentation",), "gnu free documentation licen[cs]e version 1 3 3 november 2008"),
    ("gfdl", ("invariant",), "with no invariant sections no front cover texts and no back cover texts a copy of the licen[cs]e is included"),
    ("mpl-2", ("mozilla",), "if a copy of the mpl was not distributed with this file you can obtain one at https? mozilla org mpl 2 0"),
    ("mpl", ("mozilla",), "incompatible with secondary licen[cs]es as defined by the mozilla public licen[cs]e"),
    ("epl", ("eclipse",), "the accompanying materials are provided under the terms of this eclipse public licen[cs]e"),
    ("cc-by", ("creativecommons",), "to view a copy of this licen[cs]e visit https? creativecommons org licenses by [0-9 ]+"),
    ("cc-by-sa", ("creativecommons",), "to view a copy of this licen[cs]e visit https? creativecommons org licenses by sa [0-9 ]+"),
    ("cc-by-nc", ("creativecommons",), "to view a copy of this licen[cs]e visit https? creativecommons org licenses by nc [0-9 ]+"),
    ("cc", ("creative",), "some rights reserved (?:under )?(?:a )?creative commons"),
    ("unlicense", ("unlicense",), "for more information please refer to https? unlicense org"),
    ("wtfpl", ("everyone",), "everyone is permitted to copy and distribute verbatim or modified copies of this licen[cs]e document and changing it is allowed"),
    ("gnu", ("everyone",), "everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document but changing it is not allowed"),
    ("font-exception", ("exception",), "(?:gpl font exception|font exception to the gnu general public licen[cs]e)"),
    ("autoconf-exception", ("autoconf",), "(?:autoconf (?:configure script )?exception to the (?:gnu )?general public licen[cs]e|autoconf exception public licen[cs]e)"),
    ("linux-syscall-note", ("syscall",), "(?:gpl 2 0|general public licen[cs]e) with linux syscall note"),
    ("openssl-exception", ("openssl",), "permission to link the code (?:of portions )?of this program with the openssl library (?:under|as stated in) (?:certain conditions|the licen[cs]e)"),
    ("apsl", ("apple",), "(?:the )?apple public source licen[cs]e"),
    ("blueoak", ("oak",), "(?:the )?blue oak model licen[cs]e"),
    ("bittorrent", ("bittorrent",), "(?:the )?bittorrent open source licen[cs]e"),
    ("cnri-python", ("cnri",), "(?:the )?cnri (?:open source )?(?:python )?licen[cs]e(?: agreement)?"),
    ("condor", ("condor",), "(?:the )?condor public licen[cs]e"),
    ("cpal-1", ("attribution",), "(?:the )?common public attribution licen[cs]e"),
    ("d-fsl", ("deutsche", "german"), "(?:the )?(?:deutsche freie software lizenz|german free software licen[cs]e)"),
    ("ecl-2", ("educational",), "(?:the )?educational community licen[cs]e"),
    ("efl", ("eiffel",), "(?:the )?eiffel forum licen[cs]e"),
    ("eu-datagrid", ("datagrid",), "(?:the )?eu datagrid software licen[cs]e"),
    ("fair", ("fair",), "(?:the )?fair licen[cs]e"),
    ("frameworx", ("frameworx",), "(?:the )?frameworx open licen[cs]e"),
    ("freetype", ("freetype",), "(?:the )?freetype (?:project )?licen[cs]e"),
    ("imagemagick", ("imagemagick",), "(?:the )?imagemagick licen[cs]e"),
    ("ijg", ("jpeg",), "(?:the )?independent jpeg group licen[cs]e"),
    ("info-zip", ("zip",), "(?:the )?info zip licen[cs]e"),
    ("intel", ("intel",), "(?:the )?intel (?:open source|simplified software) licen[cs]e"),
    ("ipa-font", ("ipa",), "(?:the )?ipa font licen[cs]e"),
    ("ipl-firebird", ("interbase",), "(?:the )?interbase public licen[cs]e"),
    ("lppl", ("latex",), "(?:the )?latex project public licen[cs]e"),
    ("lucent", ("lucent",), "(?:the )?lucent public licen[cs]e"),
    ("miros", ("miros",), "(?:the )?miros licen[cs]e"),
    ("motosoto", ("motosoto",), "(?:the )?motosoto (?:open source )?licen[cs]e"),
    ("multics", ("multics",), "(?:the )?multics licen[cs]e"),
    ("nasa", ("nasa",), "(?:the )?nasa open source (?:agreement )?licen[cs]e"),
    ("naumen", ("naumen",), "(?:the )?naumen public licen[cs]e"),
    ("nethack", ("nethack",), "(?:the )?nethack general public licen[cs]e"),
    ("nokia", ("nokia",), "(?:the )?nokia open source licen[cs]e"),
    ("ntp", ("ntp",), "(?:the )?ntp licen[cs]e"),
    ("oclc", ("oclc",), "(?:the )?oclc research public licen[cs]e"),
    ("ogl-uk", ("government",), "(?:the )?open government licen[cs]e"),
    ("opl", ("publication",), "(?:the )?open publication licen[cs]e"),
    ("openldap", ("openldap",), "(?:the )?openldap public licen[cs]e"),
    ("qpl", ("q", "qt"), "(?:the )?(?:q|qt) public licen[cs]e"),
    ("rpsl", ("realnetworks",), "(?:the )?realnetworks public source licen[cs]e"),
    ("rpl", ("reciprocal",), "(?:the )?reciprocal public licen[cs]e"),
    ("ricoh", ("ricoh",), "(?:the )?ricoh source code public licen[cs]e"),
    ("sgi-b", ("sgi",), "(?:the )?sgi free software licen[cs]e(?: b)?"),
    ("simpl", ("simple",), "(?:the )?simple public licen[cs]e"),
    ("sleepycat", ("sleepycat",), "(?:the )?sleepycat (?:public )?licen[cs]e"),
    ("sissl", ("sun",), "(?:the )?sun industry standards source licen[cs]e"),
    ("spl", ("sun",), "(?:the )?sun public licen[cs]e"),
    ("sugarcrm", ("sugarcrm",), "(?:the )?sugarcrm public licen[cs]e"),
    ("watcom", ("watcom",), "(?:the )?(?:sybase )?open watcom public licen[cs]e"),
    ("tcl", ("tcl",), "(?:the )?tcl(?: tk)? licen[cs]e"),
    ("tmate", ("tmate",), "(?:the )?tmate open source licen[cs]e"),
    ("unicode", ("unicode",), "(?:the )?unicode (?:inc )?licen[cs]e agreement(?: data files and software)?"),
    ("vovida", ("vovida",), "(?:the )?vovida software licen[cs]e"),
    ("wxwindows", ("wxwindows",), "(?:the )?wxwindows library licen[cs]e"),
    ("xfree86", ("xfree86",), "(?:the )?xfree86 (?:project )?licen[cs]e"),
    ("yahoo", ("yahoo",), "(?:the )?yahoo public licen[cs]e"),
    ("zend", ("zend",), "(?:the )?zend (?:engine )?licen[cs]e"),
    ("zimbra", ("zimbra",), "(?:the )?zimbra public licen[cs]e"),
    ("cern-ohl", ("cern",), "(?:the )?cern open hardware licen[cs]e"),
    ("tapr-ohl", ("tapr",), "(?:the )?tapr open hardware licen[cs]e"),
    ("solderpad", ("solderpad",), "(?:the )?solderpad hardware licen[cs]e"),
    ("cdla", ("data",), "(?:the )?community data licen[cs]e agreement(?: permissive| sharing)?"),
    ("odc-by", ("data",), "(?:the )?open data commons attribution licen[cs]e"),
    ("pddl", ("dedication",), "(?:the )?(?:open data commons )?public domain dedication and licen[cs]e"),
    ("llama", ("llama",), "(?:the )?llama [0-9 ]{0,4}community licen[cs]e(?: agreement)?"),
    ("openrail", ("openrail", "rail", "responsible"), "(?:the )?(?:(?:creativeml |bigscience )?(?:open )?rail(?: m)?|creativeml openrail m|openrail m?|responsible ai) licen[cs]e"),
    ("amazon", ("amazon",), "(?:the )?amazon software licen[cs]e"),
    ("commons-clause", ("commons",), "(?:the )?commons clause licen[cs]e(?: condition)?"),
    ("parity", ("parity",), "(?:the )?parity public licen[cs]e"),
    ("cal", ("autonomy",), "(?:the )?cryptographic autonomy licen[cs]e"),
    ("hippocratic", ("hippocratic",), "(?:the )?hippocratic licen[cs]e"),
    ("anti-996", ("996",), "(?:the )?anti 996 licen[cs]e"),
    ("proprietary", ("evaluation",), "licen[cs]ed for (?:internal )?evaluation (?:purposes )?only"),
    ("proprietary", ("transferable",), "(?:a )?(?:limited )?non exclusive non transferable (?:revocable )?licen[cs]e to use"),
    ("proprietary", ("eula", "user"), "end user licen[cs]e agreement"),
    ("shareware", ("shareware",), "(?:this )?shareware (?:version )?(?:is )?licen[cs]e[ds]?"),
    ("public-domain", ("dedicated",), "(?:has been )?dedicated to the public domain"),
    ("public-domain", ("placed",), "(?:has been |is )?placed in the public domain"),
)
#: More sentences of bodies and headers. Each holds one of HINTS too.
BODIES = (
    ("gpl", ("freedom",), "the licenses for most software(?: and other practical works)? are designed to take away your freedom to share and change"),
    ("gpl", ("incorporating",), "general public licen[cs]e does not permit incorporating your program into proprietary programs"),
    ("gpl-2", ("placed",), "this licen[cs]e applies to any program or other work which contains a notice placed by the copyright holder saying it may be distributed under the terms of this general public licen[cs]e"),
    ("gpl-2", ("signed",), "you are not required to accept this licen[cs]e since you have not signed it"),
    ("gpl-3", ("refers",), "this licen[cs]e refers to version 3 of the gnu general public licen[cs]e"),
    ("gpl-3", ("convey",), "each time you convey a covered work the recipient automatically receives a licen[cs]e from the original licensors"),
    ("gpl-3", ("accept",), "you are not required to accept this licen[cs]e in order to receive or run a copy of the program"),
    ("lgpl", ("lesser", "library"), "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e"),
    ("lgpl-2.1", ("designated",), "this licen[cs]e the lesser general public licen[cs]e applies to some specially designated software packages"),
    ("lgpl-3", ("incorporates",), "this version of the gnu lesser general public licen[cs]e incorporates the terms and conditions of version 3 of the gnu general public licen[cs]e"),
    ("agpl-3", ("affero",), "the gnu affero general public licen[cs]e is a free copyleft licen[cs]e for software and other kinds of works specifically designed to ensure cooperation with the community"),
    ("gfdl", ("textbook",), "the purpose of this licen[cs]e is to make a manual textbook or other functional and useful document free in the sense of freedom"),
    ("apache-2", ("perpetual",), "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[cs]e to reproduce prepare derivative works of publicly display"),
    ("apache-2", ("patent",), "perpetual worldwide non exclusive no charge royalty free irrevocable(?: except as stated in this section)? patent licen[cs]e to make have made use"),
    ("apache-2", ("trademarks",), "this licen[cs]e does not grant permission to use the trade names trademarks service marks or product names of the licensor"),
    ("apache-2", ("recipients",), "you must give any other recipients of the work or derivative works a copy of this licen[cs]e"),
    ("apache-2", ("limitations",), "see the licen[cs]e for the specific language governing permissions and limitations under the licen[cs]e"),
    ("mpl-2", ("licensable",), "each contributor hereby grants you a world wide royalty free non exclusive licen[cs]e under intellectual property rights other than patent or trademark licensable by such contributor"),
    ("mpl-2", ("incompatible",), "this source code form is incompatible with secondary licenses as defined by the mozilla public licen[cs]e"),
    ("epl-2", ("secondary",), "this source code may also be made available under the following secondary licenses when the conditions for such availability set forth in the eclipse public licen[cs]e"),
    ("epl", ("accompanying",), "the accompanying program is provided under the terms of this eclipse public licen[cs]e agreement"),
    ("cddl", ("opensolaris",), "you can obtain a copy of the licen[cs]e at (?:usr src opensolaris licen[cs]e|https? www opensolaris org os licensing)"),
    ("cc", ("creative",), "the work as defined below is provided under the terms of this creative commons public licen[cs]e"),
    ("cc-by-4", ("exercising",), "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution 4 0 international public licen[cs]e"),
    ("cc-by-sa-4", ("exercising",), "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution share ?alike 4 0 international public licen[cs]e"),
    ("cc0", ("affirmer",), "affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders all of affirmer s copyright and related rights"),
    ("unlicense", ("dedication",), "we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors"),
    ("ofl", ("stimulate",), "the goals of the open font licen[cs]e ofl are to stimulate worldwide development of collaborative font projects"),
    ("artistic-2", ("establishes",), "this licen[cs]e establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("wtfpl", ("verbatim",), "everyone is permitted to copy and distribute verbatim or modified copies of this licen[cs]e document and changing it is allowed as long as the name is changed"),
    ("eupl", ("eupl",), "licensed under the eupl (?:version 1 [12] )?or as soon they will be approved by the european commission subsequent versions of the eupl"),
    ("osl-3", ("sublicensable",), "licensor (?:hereby )?grants you a worldwide royalty free non exclusive sublicensable licen[cs]e for the duration of the copyright"),
    ("ms-pl", ("contribution",), "each contributor grants you a non exclusive worldwide royalty free copyright licen[cs]e to reproduce its contribution prepare derivative works of its contribution"),
    ("bsl-1.1", ("production",), "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("elastic-2", ("sublicensable",), "the licensor grants you a non exclusive royalty free worldwide non sublicensable non transferable licen[cs]e to use copy distribute make available"),
    ("psf", ("nonexclusive",), "psf hereby grants licensee a nonexclusive royalty free world wide licen[cs]e to reproduce analy[sz]e test perform and or display publicly"),
)
#: Confidence and priority of a signature.
SIGNED = (0.95, 9)
#: Templates: name, pattern around the licence, confidence, priority.
TEMPLATES = (
    ("identifier", "spdx licen[cs]e identifier {}", 1.0, 4),
    ("grant", "(?:licen[cs]ed|released|distributed|published|provided|available|free software|redistribute it(?: and or modify it)?) (?:to you )?under (?:the terms of )?(?:an? )?{}", 0.95, 3),
    ("under", "(?:under|subject to|governed by|terms of|conditions of|see) {}", 0.9, 2),
    ("name", "{}", 0.6, 1),
)
#: What a text must hold, lower-cased, to be looked at further: one of these, or a short name as a word of its own.
HINTS = ("licen", "gpl", "apache", "creative", "public", "rights", "proprietary", "bsd", "gfdl", "wtfpl", "cddl", "eupl", "odbl", "spdx", "lizenz")
SHORT = ("cc", "mpl", "epl", "osl", "ofl", "afl", "asl")
SHORT_WORD = r"(?<![0-9a-z])(?:cc0|cc[^0-9a-z]*(?:by|zero)|[me]pl|o[sf]l|a[fs]l)(?=v?[0-9]|[^a-z]|$)"


def rules() -> list[tuple[str, tuple[str, ...], str, float, int]]:
    """(label, keywords, pattern, confidence, priority) in order, one for each pattern: the signatures, then families by versions and templates."""
    made = [(label, words, f" {sentence}(?= )", *SIGNED) for label, words, sentence in (*SIGNATURES, *NAMED, *BODIES)]
    for (label, keywords, names, versions), version, (_, around, sure, priority) in ((f, v, t) for f, t in product(FAMILIES, TEMPLATES) for v in f[3]):
        number = " ".join(version.split(".")) + ("" if "." in version else "(?: 0)?")
        tail = rf"(?:(?: licen[cs]e)?(?: as published by [a-z ]{{1,40}}?)?(?: either)?(?: version| v)? ?v?{number})" if version else "(?: licen[cs]e)?"
        full = around.format(f"(?:{'|'.join(names)}){tail}")
        made.append((f"{label}-{version}" if version else label, keywords, f" {full}(?= )", sure, priority + (4 if version else 0)))
    return made


def count_words(text: Column) -> Column:
    joined = F.trim(F.regexp_replace(text, BETWEEN, " "))
    return F.when(joined == "", 0).otherwise(F.length(joined) - F.length(F.replace(joined, F.lit(" "), F.lit(""))) + 1).cast("long")


def _base(padded: Column, phrase: str) -> tuple[Column, Column, Column]:
    """(number of places, first word, last word) of a phrase in words that have a space before and after each."""
    parts = F.split(padded, rf" {phrase}(?= )", -1)
    spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    found = (F.size(parts) - 1).cast("long")
    last = spaces(padded) - 1 - (spaces(F.element_at(parts, -1)) - 1) - len(phrase.split())
    return found, F.when(found > 0, spaces(parts[0])).cast("long"), F.when(found > 0, last).cast("long")


def scan_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every whole text.

    n_base counts all places of base phrases, first_word and last_word are the least and greatest word at which one starts (null if none). labels has the
    base's and those of the rules, distinct, sorted and joined by commas; score is the confidence of the surest detection that stays, 0 if
    there is none. Null and empty texts have no words. Repeated rows stay; other columns aren't read.
    """
    docs = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    low = F.lower("text")  # may differ from the words' own lower case beyond ASCII; as a hint that only lets more through
    hints = sorted({*HINTS, *(w for _, words, _ in SIGNATURES for w in words)})
    gate = reduce(or_, (low.contains(w) for w in hints)) | (reduce(or_, (low.contains(w) for w in SHORT)) & low.rlike(SHORT_WORD))
    worded = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate("text", upper, lower), BETWEEN, " ")), F.lit(" "))
    held = docs.select("doc_id", count_words(F.col("text")).alias("n_words"), F.when(gate, worded).alias("words"))

    known = rules()
    keywords = sorted({w for r in known for w in r[1]}, key=lambda w: (-len(w), w))
    names = ("label", "keywords", "pattern", "sure", "priority")
    table = F.from_json(F.lit(json.dumps([dict(zip(names, r, strict=True)) for r in known])), "array<struct<label:string,keywords:array<string>,pattern:string,sure:double,priority:int>>")
    present = F.array_distinct(F.regexp_extract_all("words", F.lit(rf"(?<= )({'|'.join(keywords)})(?=(?:v?[0-9]+)? )"), F.lit(1)))
    held = held.withColumn("present", F.when(F.col("words").isNotNull(), present))
    held = held.withColumn("active", F.when(F.size("present") > 0, F.filter(table, lambda r: F.arrays_overlap("present", r["keywords"]))))
    found = F.transform("active", lambda r: F.struct(r.alias("r"), F.regexp_extract_all(F.col("words"), r["pattern"], F.lit(0)).alias("found")))
    held = held.withColumn("found", F.filter(found, lambda t: F.size(t["found"]) > 0))
    held = held.withColumn("tried", F.transform("found", lambda t: F.struct(t["r"]["label"].alias("label"), t["r"]["sure"].alias("sure"), t["r"]["priority"].alias("priority"), t["found"].alias("found"), F.split(F.col("words"), t["r"]["pattern"], -1).alias("parts"))))
    # the end of each detection: a running sum over the parts between and the detections themselves
    ends = """
        flatten(transform(tried, t -> transform(
            aggregate(zip_with(slice(t.parts, 1, size(t.found)), t.found, (p, f) -> struct(length(p) AS p, length(f) AS f)),
                cast(array() AS array<struct<p:int,f:int>>),
                (got, x) -> array_append(got, named_struct('p', coalesce(element_at(got, -1).p, 0) + x.p + x.f, 'f', x.f))),
            e -> named_struct('start', e.p - e.f, 'end', -e.p, 'priority', -t.priority, 'label', t.label, 'sure', t.sure))))"""
    ends = ends.replace("coalesce(element_at(got, -1).p, 0)", "if(size(got) = 0, 0, get(got, size(got) - 1).p)")
    held = held.withColumn("hits", F.array_sort(F.expr(ends)))
    # sorted by start, then the longest, then the highest priority: what ends no later than something before it lies inside that
    stay = """
        aggregate(hits, named_struct('reach', -1, 'labels', cast(array() AS array<string>), 'sure', 0D),
            (a, h) -> if(-h.end <= a.reach, a, named_struct('reach', -h.end, 'labels', array_union(a.labels, array(h.label)), 'sure', greatest(a.sure, h.sure))))"""
    held = held.withColumn("kept", F.expr(stay)).select("doc_id", "n_words", "words", "kept")
    found = {label: _base(F.col("words"), phrase) for phrase, label in BASE.items()}
    held = held.select("doc_id", "n_words", "kept", *(c.alias(f"b{k}{j}") for k, cells in enumerate(found.values()) for j, c in enumerate(cells)))
    count = sum((F.coalesce(F.col(f"b{k}0"), F.lit(0)) for k in range(len(found))), F.lit(0)).cast("long")
    base = F.array_compact(F.array(*(F.when(F.col(f"b{k}0") > 0, F.lit(label)) for k, label in enumerate(found))))
    labels = F.array_union(base, F.coalesce(F.col("kept.labels"), F.array().cast("array<string>")))
    return held.select(
        "doc_id",
        "n_words",
        count.alias("n_base"),
        F.least(*(F.col(f"b{k}1") for k in range(len(found)))).alias("first_word"),
        F.greatest(*(F.col(f"b{k}2") for k in range(len(found)))).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.when(count > 0, F.greatest(F.lit(0.9), F.coalesce("kept.sure", F.lit(0.0)))).otherwise(F.coalesce("kept.sure", F.lit(0.0))).alias("score"),
    )
