"""License scans with DataFrame functions: ordered signature rules behind a keyword prefilter.

Texts become lower-case words joined by single spaces. A text that holds none of the rules' keywords is done; this gate
is made from the rules, so it lets every text pass that one of them fits. In the others
each rule whose keyword occurs has its regex matched; a detection that lies within another one is suppressed, the
longer or, between equals, the earlier rule winning. All of it happens within the row: no join and no shuffle.

Rules detect different things: names, short names, header sentences and characteristic clauses of license texts,
identifiers in SPDX lines, notices. A citation before a name is part of the detection and gives its score. Priority is
the rules' order.

Cases: a text of any length is one row, its time grows with its length and the rules whose keywords occur; of equal
detections the earlier rule's stays; an empty table gives an empty table; a null text counts as empty; no words means no detections and score 0; repeated rows give repeated results;
other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import ALNUM_BREAK, ALNUM_WORD, alnum_words, any_case
from tracelake.llm.spans import match_spans

#: Base phrases and their labels.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: Label, keyword (words that every match holds, from the start of a word on), name as a regex over
#: lower-case words. Versions stand as single words.
NAMES = [
    ("Apache-2.0", "apache", r"(?:the )?apache (?:software )?license(?: version)?(?: v)? ?2(?: 0)?"),
    ("Apache-1.1", "apache", r"(?:the )?apache (?:software )?license(?: version)? 1 1"),
    ("Apache", "apache", r"(?:the )?apache (?:software )?license"),
    ("AGPL-3.0", "affero general public license", r"(?:the )?(?:gnu )?affero general public license(?: version)?(?: v)? ?3(?: 0)?"),
    ("LGPL-3.0", "lesser general public license", r"(?:the )?(?:gnu )?lesser general public license(?: version)?(?: v)? ?3(?: 0)?"),
    ("LGPL-2.1", "lesser general public license", r"(?:the )?(?:gnu )?lesser general public license(?: version)?(?: v)? ?2 1"),
    ("GPL-3.0", "gnu general public license", r"(?:the )?gnu general public license(?: version)?(?: v)? ?3(?: 0)?"),
    ("GPL-2.0", "gnu general public license", r"(?:the )?gnu general public license(?: version)?(?: v)? ?2(?: 0)?"),
    ("GPL", "general public license", r"(?:the )?(?:gnu )?general public license"),
    ("GFDL", "free documentation license", r"(?:the )?gnu free documentation license"),
    ("MIT", "mit license", r"(?:the )?mit license"),
    ("MIT", "expat license", r"(?:the )?expat license"),
    ("MIT", "x11", r"(?:the )?(?:mit )?x11 license"),
    ("BSD-3-Clause", "bsd", r"(?:the )?(?:new |modified |revised )?(?:bsd 3 clause|3 clause bsd)(?: license)?"),
    ("BSD-2-Clause", "bsd", r"(?:the )?(?:simplified )?(?:bsd 2 clause|2 clause bsd)(?: license)?"),
    ("BSD", "bsd", r"(?:the )?(?:new |modified |revised )?bsd license"),
    ("MPL-2.0", "mozilla public license", r"(?:the )?mozilla public license(?: version)?(?: v)? ?2(?: 0)?"),
    ("MPL-1.1", "mozilla public license", r"(?:the )?mozilla public license(?: version)? 1 1"),
    ("EPL-2.0", "eclipse public license", r"(?:the )?eclipse public license(?: version)?(?: v)? ?2(?: 0)?"),
    ("EPL-1.0", "eclipse public license", r"(?:the )?eclipse public license(?: version)?(?: v)? ?1(?: 0)?"),
    ("CDDL-1.0", "common development and distribution license", r"(?:the )?common development and distribution license"),
    ("ISC", "isc", r"(?:the )?isc license"),
    ("Zlib", "zlib", r"(?:the )?zlib(?: libpng)? license"),
    ("Unlicense", "unlicense", r"(?:the )?unlicense"),
    ("WTFPL", "wtfpl", r"(?:the )?wtfpl"),
    ("BSL-1.0", "boost software license", r"(?:the )?boost software license"),
    ("Artistic-2.0", "artistic license", r"(?:the )?artistic license(?: 2 0)?"),
    ("EUPL-1.2", "european union public", r"(?:the )?european union public licen[cs]e"),
    ("PSF-2.0", "python software foundation license", r"(?:the )?python software foundation license"),
    ("OFL-1.1", "sil open font license", r"(?:the )?sil open font license"),
    ("CC0-1.0", "cc0", r"(?:the )?(?:creative commons )?(?:zero |cc )?cc0(?: 1 0)?(?: universal)?"),
    ("CC-BY-NC-ND", "cc by", r"cc by nc nd(?: [1-4] [05])?"),
    ("CC-BY-NC-SA", "cc by", r"cc by nc sa(?: [1-4] [05])?"),
    ("CC-BY-NC", "cc by", r"cc by nc(?: [1-4] [05])?"),
    ("CC-BY-ND", "cc by", r"cc by nd(?: [1-4] [05])?"),
    ("CC-BY-SA", "cc by", r"cc by sa(?: [1-4] [05])?"),
    ("CC-BY", "cc by", r"cc by(?: [1-4] [05])?"),
    ("CC-BY-NC-SA", "creative commons attribution", r"(?:a )?creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported)?(?: license)?"),
    ("CC-BY-NC", "creative commons attribution", r"(?:a )?creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)?(?: license)?"),
    ("CC-BY-SA", "creative commons attribution", r"(?:a )?creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?(?: license)?"),
    ("CC-BY", "creative commons attribution", r"(?:a )?creative commons attribution(?: [1-4] [05])?(?: international| unported)?(?: license)?"),
    ("proprietary", "proprietary", r"(?:a )?proprietary (?:software )?licen[cs]e"),
]
#: Short names, header sentences and characteristic clauses of license texts; as in NAMES.
MORE = [
    ("AGPL-3.0", "agpl", r"agpl ?v? ?3(?: 0)?(?: only| or later)?"),
    ("LGPL-3.0", "lgpl", r"lgpl ?v? ?3(?: 0)?(?: only| or later)?"),
    ("LGPL-2.1", "lgpl", r"lgpl ?v? ?2 1(?: only| or later)?"),
    ("LGPL", "lgpl", r"lgpl"),
    ("GPL-3.0", "gpl", r"gpl ?v? ?3(?: 0)?(?: only| or later)?"),
    ("GPL-2.0", "gpl", r"gpl ?v? ?2(?: 0)?(?: only| or later)?"),
    ("GPL", "gpl", r"gpl"),
    ("Apache-2.0", "apache 2", r"apache 2(?: 0)?"),
    ("Apache-2.0", "apache license", r"(?:the )?apache (?:software )?license v(?:ersion )?2(?: 0)?"),
    ("MPL-2.0", "mpl", r"mpl ?v? ?2(?: 0)?"),
    ("MPL-1.1", "mpl", r"mpl ?v? ?1 1"),
    ("EPL-2.0", "epl", r"epl ?v? ?2(?: 0)?"),
    ("EPL-1.0", "epl", r"epl ?v? ?1 0"),
    ("CDDL-1.0", "cddl", r"cddl(?: ?v? ?1 0)?"),
    ("EUPL-1.2", "eupl", r"eupl(?: ?v? ?1 [12])?"),
    ("OFL-1.1", "ofl", r"ofl ?v? ?1 1"),
    ("MIT", "mit licensed", r"mit licensed"),
    ("MIT-0", "mit no attribution", r"mit no attribution(?: license)?"),
    ("0BSD", "0bsd", r"0bsd"),
    ("0BSD", "zero clause bsd", r"zero clause bsd(?: license)?"),
    ("BSD-4-Clause", "bsd 4 clause", r"bsd 4 clause(?: license)?"),
    ("BSD-4-Clause", "4 clause bsd", r"4 clause bsd(?: license)?"),
    ("CC-BY-NC-ND", "creative commons attribution", r"(?:a )?creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?:ative works)?(?: [1-4] [05])?(?: international| unported)?(?: license)?"),
    ("CC-BY-ND", "creative commons attribution", r"(?:a )?creative commons attribution no ?deriv(?:ative)?s?(?:ative works)?(?: [1-4] [05])?(?: international| unported)?(?: license)?"),
    ("CC0-1.0", "creative commons zero", r"creative commons zero(?: v?1 0)?(?: universal)?"),
    ("PSF-2.0", "psf license", r"(?:the )?psf license"),
    ("MS-PL", "microsoft public license", r"(?:the )?microsoft public license"),
    ("MS-RL", "microsoft reciprocal license", r"(?:the )?microsoft reciprocal license"),
    ("OSL-3.0", "open software license", r"(?:the )?open software license(?: v)?(?: version)?(?: 3 0)?"),
    ("AFL-3.0", "academic free license", r"(?:the )?academic free license(?: v)?(?: version)?(?: 3 0)?"),
    ("CPL-1.0", "common public license", r"(?:the )?common public license"),
    ("IPL-1.0", "ibm public license", r"(?:the )?ibm public license"),
    ("QPL-1.0", "q public license", r"(?:the )?q public license"),
    ("ZPL-2.1", "zope public license", r"(?:the )?zope public license"),
    ("APSL-2.0", "apple public source license", r"(?:the )?apple public source license"),
    ("NCSA", "ncsa open source license", r"(?:the )?(?:university of illinois )?ncsa open source license"),
    ("PostgreSQL", "postgresql license", r"(?:the )?postgresql license"),
    ("Vim", "vim license", r"(?:the )?vim license"),
    ("PHP-3.01", "php license", r"(?:the )?php license(?: version)?(?: 3 01)?"),
    ("Ruby", "ruby license", r"(?:the )?ruby license"),
    ("OpenSSL", "openssl license", r"(?:the )?openssl license"),
    ("CeCILL", "cecill", r"cecill"),
    ("ODbL-1.0", "open database license", r"(?:the )?open database license"),
    ("BUSL-1.1", "business source license", r"(?:the )?business source license(?: 1 1)?"),
    ("SSPL-1.0", "server side public license", r"(?:the )?server side public license"),
    ("Elastic-2.0", "elastic license", r"(?:the )?elastic license(?: v)?(?: ?2(?: 0)?)?"),
    ("GPL-3.0", "gnu general public license", r"(?:the )?gnu general public license as published by the free software foundation either version 3"),
    ("GPL-2.0", "gnu general public license", r"(?:the )?gnu general public license as published by the free software foundation either version 2"),
    ("LGPL-3.0", "gnu lesser general public license", r"(?:the )?gnu lesser general public license as published by the free software foundation either version 3"),
    ("LGPL-2.1", "gnu lesser general public license", r"(?:the )?gnu lesser general public license as published by the free software foundation either version 2 1"),
    ("AGPL-3.0", "gnu affero general public license", r"(?:the )?gnu affero general public license as published by the free software foundation either version 3"),
    ("MPL-2.0", "mozilla public license", r"(?:the )?mozilla public license v 2 0"),
    ("MIT", "permission is hereby granted free of charge", r"permission is hereby granted free of charge(?: to any person obtaining a copy)?"),
    ("MIT", "the above copyright notice and this permission notice", r"the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies"),
    ("BSL-1.0", "permission is hereby granted free of charge to any person or organization", r"permission is hereby granted free of charge to any person or organization(?: obtaining a copy)?"),
    ("BSD", "redistribution and use in source and binary forms", r"redistribution and use in source and binary forms(?: with or without modification)?"),
    ("BSD", "redistributions of source code must retain", r"redistributions of source code must retain the (?:above )?copyright notice"),
    ("BSD-3-Clause", "neither the name of", r"neither the name of(?: [^ ]+){1,20}? nor the names of (?:its|the|their|any)(?: [^ ]+){0,3}? contributors"),
    ("BSD-4-Clause", "all advertising materials mentioning", r"all advertising materials mentioning features or use of this software"),
    ("0BSD", "permission to use copy modify and", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("ISC", "permission to use copy modify and", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("HPND", "permission to use copy modify", r"permission to use copy modify(?: and)? distribute(?: and sell)? this software and its documentation for any purpose"),
    ("Zlib", "the origin of this software must not be misrepresented", r"the origin of this software must not be misrepresented"),
    ("Zlib", "altered source versions must be plainly marked", r"altered source versions must be plainly marked as such"),
    ("Apache-2.0", "you may not use this file except in compliance", r"you may not use this file except in compliance with the license"),
    ("Apache-2.0", "unless required by applicable law or agreed to in writing software", r"unless required by applicable law or agreed to in writing software distributed under the license"),
    ("Apache-2.0", "terms and conditions for use reproduction and distribution", r"terms and conditions for use reproduction and distribution"),
    ("GPL", "everyone is permitted to copy and distribute verbatim copies", r"everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("GPL-2.0", "the licenses for most software are designed to take away", r"the licenses for most software are designed to take away your freedom"),
    ("GPL-3.0", "the gnu general public license is a free copyleft license", r"the gnu general public license is a free copyleft license for software"),
    ("LGPL-2.1", "this license the lesser general public license", r"this license the lesser general public license applies to some"),
    ("LGPL-3.0", "this version of the gnu lesser general public license", r"this version of the gnu lesser general public license incorporates the terms"),
    ("AGPL-3.0", "the gnu affero general public license is a free copyleft license", r"the gnu affero general public license is a free copyleft license for software"),
    ("MPL-2.0", "this source code form is subject to the terms", r"this source code form is subject to the terms of the mozilla public license(?: v)? 2 0"),
    ("MPL-1.1", "the contents of this file are subject to the mozilla public license", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("Unlicense", "this is free and unencumbered software", r"this is free and unencumbered software released into the public domain"),
    ("WTFPL", "do what the fuck you want to", r"do what the fuck you want to(?: public license)?"),
    ("CC0-1.0", "to the extent possible under law", r"to the extent possible under law(?: [^ ]+){1,20}? waived all copyright"),
    ("Artistic-1.0", "the intent of this document is to state the conditions", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("OFL-1.1", "this font software is licensed under", r"this font software is licensed under the sil open font license"),
    ("PSF-2.0", "this license agreement is between the python software foundation", r"this license agreement is between the python software foundation"),
    ("OpenSSL", "this product includes software developed by the openssl project", r"this product includes software developed by the openssl project"),
    ("Beerware", "you can do whatever you want with this stuff", r"you can do whatever you want with this stuff"),
    ("JSON", "the software shall be used for good not evil", r"the software shall be used for good not evil"),
    ("PHP-3.01", "this product includes php software", r"this product includes php software"),
    ("NCSA", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with"),
]
#: Identifiers of the SPDX list; a rule finds each of them in an SPDX-License-Identifier line.
SPDX = (
    "0BSD AAL ADSL AFL-1.1 AFL-1.2 AFL-2.0 AFL-2.1 AFL-3.0 AGPL-1.0-only AGPL-1.0-or-later AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later AMDPLPA AML AMPAS "
    "ANTLR-PD APAFML APL-1.0 APSL-1.0 APSL-1.1 APSL-1.2 APSL-2.0 Abstyles Adobe-2006 Adobe-Glyph Afmparse Aladdin Apache-1.0 Apache-1.1 Apache-2.0 "
    "Artistic-1.0 Artistic-1.0-Perl Artistic-1.0-cl8 Artistic-2.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-2-Clause-Views BSD-3-Clause "
    "BSD-3-Clause-Attribution BSD-3-Clause-Clear BSD-3-Clause-LBNL BSD-3-Clause-Modification BSD-4-Clause BSD-4-Clause-UC BSD-Protection BSD-Source-Code "
    "BSL-1.0 BUSL-1.1 Bahyph Barr Beerware BitTorrent-1.0 BitTorrent-1.1 BlueOak-1.0.0 Borceux CAL-1.0 CATOSL-1.1 CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 "
    "CC-BY-4.0 CC-BY-NC-1.0 CC-BY-NC-2.0 CC-BY-NC-2.5 CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-ND-3.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-2.0 CC-BY-NC-SA-2.5 "
    "CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0 CC-BY-ND-3.0 CC-BY-ND-4.0 CC-BY-SA-1.0 CC-BY-SA-2.0 CC-BY-SA-2.5 CC-BY-SA-3.0 CC-BY-SA-4.0 CC-PDDC CC0-1.0 "
    "CDDL-1.0 CDDL-1.1 CDLA-Permissive-1.0 CDLA-Permissive-2.0 CDLA-Sharing-1.0 CECILL-1.0 CECILL-1.1 CECILL-2.0 CECILL-2.1 CECILL-B CECILL-C CERN-OHL-1.1 "
    "CERN-OHL-1.2 CERN-OHL-P-2.0 CERN-OHL-S-2.0 CERN-OHL-W-2.0 CNRI-Jython CNRI-Python CPAL-1.0 CPL-1.0 CPOL-1.02 CUA-OPL-1.0 Caldera ClArtistic "
    "Condor-1.1 Crossword CrystalStacker Cube D-FSL-1.0 DOC DSDP Dotseqn ECL-1.0 ECL-2.0 EFL-1.0 EFL-2.0 EPICS EPL-1.0 EPL-2.0 EUDatagrid EUPL-1.0 "
    "EUPL-1.1 EUPL-1.2 Elastic-2.0 Entessa ErlPL-1.1 Eurosym FSFAP FSFUL FSFULLR FTL Fair Frameworx-1.0 FreeImage GFDL-1.1-only GFDL-1.1-or-later "
    "GFDL-1.2-only GFDL-1.2-or-later GFDL-1.3-only GFDL-1.3-or-later GL2PS GPL-1.0 GPL-1.0-only GPL-1.0-or-later GPL-2.0 GPL-2.0-only GPL-2.0-or-later "
    "GPL-3.0 GPL-3.0-only GPL-3.0-or-later Giftware Glide Glulxe HPND HPND-sell-variant HaskellReport Hippocratic-2.1 IBM-pibs ICU IJG IPA IPL-1.0 ISC "
    "ImageMagick Imlib2 Info-ZIP Intel Interbase-1.0 JPNIC JSON JasPer-2.0 LAL-1.2 LAL-1.3 LGPL-2.0 LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 "
    "LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later LGPLLR LPL-1.0 LPL-1.02 LPPL-1.0 LPPL-1.1 LPPL-1.2 LPPL-1.3a LPPL-1.3c "
    "Latex2e Leptonica LiLiQ-P-1.1 LiLiQ-R-1.1 LiLiQ-Rplus-1.1 Libpng Linux-OpenIB MIT MIT-0 MIT-CMU MIT-advertising MIT-enna MIT-feh MITNFA MPL-1.0 "
    "MPL-1.1 MPL-2.0 MPL-2.0-no-copyleft-exception MS-PL MS-RL MTLL MirOS Motosoto MulanPSL-1.0 MulanPSL-2.0 Multics Mup NASA-1.3 NBPL-1.0 NCSA NGPL "
    "NLPL NOSL NPL-1.0 NPL-1.1 NPOSL-3.0 NRL NTP Naumen Net-SNMP NetCDF Newsletr Nokia Noweb OCCT-PL OCLC-2.0 ODC-By-1.0 ODbL-1.0 OFL-1.0 OFL-1.1 "
    "OGL-UK-2.0 OGL-UK-3.0 OGTSL OLDAP-2.7 OLDAP-2.8 OML OPL-1.0 OSET-PL-2.1 OSL-1.0 OSL-2.0 OSL-2.1 OSL-3.0 OpenSSL PDDL-1.0 PHP-3.0 PHP-3.01 "
    "PSF-2.0 Parity-7.0.0 Plexus PolyForm-Noncommercial-1.0.0 PolyForm-Small-Business-1.0.0 PostgreSQL Python-2.0 QPL-1.0 Qhull RHeCos-1.1 RPL-1.1 "
    "RPL-1.5 RPSL-1.0 RSA-MD RSCPL Ruby SAX-PD SCEA SGI-B-1.0 SGI-B-1.1 SGI-B-2.0 SHL-0.5 SISSL SMLNJ SMPPL SNIA SPL-1.0 SSPL-1.0 Saxpath Sendmail "
    "SimPL-2.0 Sleepycat Spencer-94 SugarCRM-1.1.3 TCL TCP-wrappers TMate TORQUE-1.1 TOSL UPL-1.0 Unicode-DFS-2015 Unicode-DFS-2016 Unicode-TOU "
    "Unlicense VOSTROM VSL-1.0 Vim W3C WTFPL Watcom-1.0 Wsuipa X11 XFree86-1.1 XSkat Xerox Xnet YPL-1.0 YPL-1.1 ZPL-1.1 ZPL-2.0 ZPL-2.1 Zed "
    "Zend-2.0 Zimbra-1.3 Zlib bzip2-1.0.6 curl diffmark dvipdfm eGenix gSOAP-1.3b gnuplot iMatix libpng-2.0 libtiff mpich2 psfrag psutils xinetd xpp zlib-acknowledgement"
)
#: What may stand before a name, and the score of a detection that it stands in, or else of a bare name.
CITATIONS = [
    ("(?:this (?:work|file|software|program|document|project|text) is )?(?:licensed|released|distributed) under ", 1.0),
    ("(?:available|published) under ", 0.95),
    ("(?:under the )?terms of ", 0.9),
]
BARE = 0.7
CITED = f"(?:{'|'.join(p for p, _ in CITATIONS)})?"
#: What stands before an identifier in an SPDX line, other identifiers bound by words such as OR among it; written out,
#: since Java's look-behinds take no repeated groups.
SPDX_LINE = r"\bspdx license identifier " + 3 * rf"(?:[^ ]{{1,30}} {5 * '(?:[^ ]{1,30} )?'}(?:or|and|with) )?"
#: Notices that name no license.
NOTICES = [
    ("all-rights-reserved", "all rights reserved", "all rights reserved", 0.9),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)[0-9][0-9]", 0.6),
    ("public-domain", "the public domain", "(?:dedicated to|placed in|released into) the public domain", 0.9),
    ("no-warranty", "as is without", "(?:provided )?as is without (?:any )?warranty", 0.6),
]


def spdx_words(name: str) -> str:
    return " ".join(re.findall("[a-z0-9]+", name.lower()))


def rules() -> list[tuple[str, str, str, float]]:
    """Label, keyword, regex and score of each rule, by falling priority; no two detect the same thing."""
    made = [(label, "spdx license identifier", rf"\b{(name := spdx_words(label))}(?<={SPDX_LINE}{name})(?: license)?\b", 1.0) for label in SPDX.split()]
    made += [(label, keyword, rf"\b{CITED}{name}\b", BARE) for label, keyword, name in NAMES + MORE]
    return made + [(label, keyword, rf"\b{p}\b", score) for label, keyword, p, score in NOTICES]


def gate() -> str:
    """What every text that a rule or base phrase fits must match as it stands: one of the keywords, with anything between its words."""
    words = sorted({r[1] for r in rules()} | {p for p, _ in BASE})
    first = [w for w in words if not any(w != x and w.startswith(x) for x in words)]
    rest = lambda c: "|".join(w[1:].replace(" ", any_case(ALNUM_BREAK)) for w in first if w[0] == c)
    return rf"(?i)(?<![A-Za-z0-9])(?:{'|'.join(f'{c}(?:{rest(c)})' for c in sorted({w[0] for w in first}))})"


def phrase_places(words: Column, phrase: str) -> Column:
    """Starts (from 0) of the places where the phrase's words stand one behind the other."""
    parts = phrase.split(" ")
    fits = lambda i: F.slice(words, i + 1, F.lit(len(parts))) == F.array(*map(F.lit, parts))
    last = F.size(words) - len(parts)
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), fits)).otherwise(F.array().cast("array<int>"))


def detections(plain: Column) -> Column:
    """What the rules find in a text of lower-case words, sorted by place: array of start, back (minus end), rank, label, score; unsuppressed."""
    by_keyword: dict[str, list[Column]] = {}
    for n, (label, k, p, s) in enumerate(rules()):
        needs = spdx_words(label) if SPDX_LINE in p else k
        by_keyword.setdefault(k, []).append(F.struct(F.lit(n).alias("rank"), F.lit(label).alias("label"), F.lit(needs).alias("needs"), F.lit(p).alias("pattern"), F.lit(s).alias("score")))
    table = F.array(*[F.struct(F.lit(k).alias("keyword"), F.array(*of).alias("rules")) for k, of in by_keyword.items()])
    near = F.flatten(F.transform(F.filter(table, lambda k: F.contains(plain, k["keyword"])), lambda k: F.filter(k["rules"], lambda r: F.contains(plain, r["needs"]))))

    def score(found: Column, bare: Column) -> Column:
        cited = bare
        for pattern, sure in reversed(CITATIONS):
            cited = F.when((bare == BARE) & found.rlike(f"^{pattern}"), sure).otherwise(cited)
        return cited

    def hit(r: Column, s: Column) -> Column:
        found = F.substring(plain, s["start"] + 1, s["end"] - s["start"])
        return F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), r["rank"].alias("rank"), r["label"].alias("label"), score(found, r["score"]).alias("score"))

    return F.array_sort(F.flatten(F.transform(near, lambda r: F.transform(match_spans(plain, r["pattern"]), lambda s: hit(r, s)))))


def unsuppressed(found: Column) -> Column:
    """Detections that lie in no earlier one of the sorted list: the ends only grow along those that stay."""
    kind = "array<struct<start:int,back:int,rank:int,label:string,score:double>>"
    empty = F.struct(F.lit(0).alias("end"), F.array().cast(kind).alias("out"))
    step = lambda s, d: F.when(-d["back"] > s["end"], F.struct((-d["back"]).alias("end"), F.concat(s["out"], F.array(d)).alias("out"))).otherwise(s)
    return F.aggregate(found, empty, step, lambda s: s["out"])


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with __n_words, __places (array of start, label of base phrases) and __found (detections that stay)."""
    gated = docs.withColumn("__n_words", F.coalesce(F.regexp_count(F.col(text), F.lit(any_case(ALNUM_WORD))), F.lit(0)).cast("bigint"))
    gated = gated.withColumn("__words", F.when(F.col(text).rlike(gate()), alnum_words(F.col(text))).otherwise(F.array().cast("array<string>")))
    plain = gated.withColumn("__plain", F.array_join("__words", " "))
    place = lambda phrase, label: F.transform(phrase_places(F.col("__words"), phrase), lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))
    nothing = F.array().cast("array<struct<start:int,back:int,rank:int,label:string,score:double>>")
    done = plain.withColumn("__places", F.concat(*[F.when(F.contains("__plain", F.lit(p)), place(p, label)).otherwise(F.array().cast("array<struct<start:int,label:string>>")) for p, label in BASE]))
    done = done.withColumn("__found", F.when(F.col("__plain") != "", unsuppressed(detections(F.col("__plain")))).otherwise(nothing))
    return done.drop("__words", "__plain")


def report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    starts = F.transform("__places", lambda p: p["start"].cast("bigint"))
    base = F.array_sort(F.array_distinct(F.transform("__places", lambda p: p["label"])))
    more = F.transform("__found", lambda d: d["label"])
    sure = F.coalesce(F.array_max(F.transform("__found", lambda d: d["score"])), F.lit(0.0))
    return scan(docs.select("doc_id", "text")).select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        F.size("__places").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, more))), ",").alias("labels"),
        F.greatest(sure, F.when(F.size("__places") > 0, 0.7).otherwise(0.0)).alias("score"),
    )
