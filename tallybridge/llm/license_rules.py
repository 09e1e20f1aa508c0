"""Signature rules for licences: ordered, each with a keyword that must be in the text before its pattern is tried.

A keyword is a part of one word that every match of the pattern has, so it never hides a match; where alternatives share none it is empty and
the pattern is always tried. Patterns are written for lower-cased text; a space stands for any white space, and gaps in sentences and names cross lines. Names of licences are crossed with the forms in which they are
mentioned, so the hundreds of rules follow from the tables below.
"""

from __future__ import annotations

from typing import NamedTuple

from . import _common as C


class Rule(NamedTuple):
    number: int
    label: str
    priority: int  # 0 is the strongest
    keyword: str
    pattern: str


#: Priorities, and the confidence in a text whose strongest detection has one.
TEXT, IDENTIFIER, GRANT, NAME, HINT = range(5)
CONFIDENCE = (1.0, 0.95, 0.9, 0.7, 0.3)

#: A text with none of these matches no rule: every match of every pattern has one of them. A space stands for any white space.
ANCHORS = (
    "licen", "copyright", "reserved", "public domain", "creative commons", "cc by", "cc-by", "cc0", "gpl", "wtfpl", "redistribution", "permission", "warrant", "proprietary", "source code form",
    "mozilla.org/", "eclipse.org/legal", "scripts.sil.org", "gnu.org/", "joinup.ec.europa.eu", "creativecommons.org",
)

#: Label, keyword, name, short identifier, web address. The identifier and the name are patterns; an empty address makes no rule.
LICENSES = [
    ("mit", "mit", r"mit(?:[ /-]x11)? licen[sc]e", r"mit", r"opensource\.org/licenses?/mit"),
    ("mit-0", "mit", r"mit no attribution(?: licen[sc]e)", r"mit-0", r"opensource\.org/licenses?/mit-0"),
    ("x11", "x11", r"x11 licen[sc]e", r"x11", ""),
    ("apache", "apache", r"apache(?: software)? licen[sc]e(?:,? (?:version |v)?[12](?:\.[01])?)?", r"apache-(?:1\.0|1\.1|2\.0)", r"apache\.org/licenses?"),
    ("gpl", "general", r"(?:gnu )?general public licen[sc]e(?:,? (?:version |v)?[123](?:\.0)?)?", r"gpl-[123]\.0(?:-only|-or-later|\+)?", r"gnu\.org/(?:licenses?|copyleft)/(?:old-licenses/)?gpl"),
    ("gpl", "gpl", r"\b(?:gnu )?gpl ?v?[ -]?[123](?:\.0)?\b", r"gpl[123]?", ""),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public licen[sc]e(?:,? (?:version |v)?[23](?:\.[01])?)?", r"lgpl-(?:2\.0|2\.1|3\.0)(?:-only|-or-later|\+)?", r"gnu\.org/(?:licenses?|copyleft)/(?:old-licenses/)?lgpl"),
    ("lgpl", "library", r"(?:gnu )?library general public licen[sc]e", r"lgpl-2\.0", ""),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[sc]e(?:,? (?:version |v)?[13](?:\.0)?)?", r"agpl-[13]\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses?/agpl"),
    ("gfdl", "documentation", r"(?:gnu )?free documentation licen[sc]e", r"gfdl-1\.[123](?:-only|-or-later)?", r"gnu\.org/(?:licenses?|copyleft)/fdl"),
    ("bsd-2-clause", "licen", r"(?:simplified|freebsd|2-clause|two-clause)(?: bsd)? licen[sc]e", r"bsd-2-clause", r"opensource\.org/licenses?/bsd-2-clause"),
    ("bsd-3-clause", "bsd", r"(?:new|modified|revised|3-clause|three-clause) bsd licen[sc]e", r"bsd-3-clause", r"opensource\.org/licenses?/bsd-3-clause"),
    ("bsd-4-clause", "bsd", r"(?:original|4-clause|four-clause) bsd licen[sc]e", r"bsd-4-clause", ""),
    ("0bsd", "bsd", r"(?:zero-clause|0-clause) bsd licen[sc]e", r"0bsd", ""),
    ("bsd", "bsd", r"bsd(?:-style)? licen[sc]e", r"bsd", ""),
    ("isc", "isc", r"isc licen[sc]e", r"isc", r"opensource\.org/licenses?/isc"),
    ("mpl", "mozilla", r"mozilla public licen[sc]e(?:,? (?:version |v)?[12]\.[01])?", r"mpl-(?:1\.0|1\.1|2\.0)", r"mozilla\.org/(?:mpl|en-us/mpl)"),
    ("epl", "eclipse", r"eclipse public licen[sc]e(?:,? (?:version |v)?[12]\.0)?", r"epl-[12]\.0", r"eclipse\.org/legal/epl"),
    ("cpl", "common", r"common public licen[sc]e", r"cpl-1\.0", ""),
    ("ipl", "ibm", r"ibm public licen[sc]e", r"ipl-1\.0", ""),
    ("cddl", "development", r"common development and distribution licen[sc]e", r"cddl-1\.[01]", ""),
    ("eupl", "european", r"european union public licen[sc]e", r"eupl-1\.[012]", r"joinup\.ec\.europa\.eu/.{0,40}eupl"),
    ("artistic", "artistic", r"artistic licen[sc]e(?: [12]\.0)?", r"artistic-[12]\.0", r"opensource\.org/licenses?/artistic"),
    ("boost", "boost", r"boost software licen[sc]e", r"bsl-1\.0", r"boost\.org/license"),
    ("zlib", "zlib", r"zlib(?:/libpng)? licen[sc]e", r"zlib", r"zlib\.net/zlib_license"),
    ("libpng", "libpng", r"libpng licen[sc]e", r"libpng(?:-2\.0)?", ""),
    ("openssl", "openssl", r"openssl licen[sc]e", r"openssl", ""),
    ("python", "python", r"python(?: software foundation)? licen[sc]e", r"(?:psf-2\.0|python-2\.0)", ""),
    ("php", "php", r"php licen[sc]e", r"php-3\.0?1?", ""),
    ("ruby", "ruby", r"ruby licen[sc]e", r"ruby", ""),
    ("perl", "perl", r"same terms as perl(?: itself)?.{0,40}licen[sc]e", r"perl", ""),
    ("postgresql", "postgresql", r"postgresql licen[sc]e", r"postgresql", ""),
    ("w3c", "w3c", r"w3c software(?: notice and)? licen[sc]e", r"w3c", ""),
    ("unicode", "unicode", r"unicode(?:,? inc\.)? licen[sc]e", r"unicode-(?:dfs-201[56]|3\.0)", ""),
    ("ncsa", "ncsa", r"(?:university of illinois/)?ncsa open source licen[sc]e", r"ncsa", ""),
    ("ofl", "font", r"(?:sil )?open font licen[sc]e", r"ofl-1\.[01]", r"scripts\.sil\.org/ofl"),
    ("odbl", "database", r"open database licen[sc]e", r"odbl-1\.0", r"opendatacommons\.org/licenses/odbl"),
    ("pddl", "dedication", r"public domain dedication and licen[sc]e", r"pddl-1\.0", r"opendatacommons\.org/licenses/pddl"),
    ("ms-pl", "microsoft", r"microsoft public licen[sc]e", r"ms-pl", ""),
    ("ms-rl", "reciprocal", r"microsoft reciprocal licen[sc]e", r"ms-rl", ""),
    ("sspl", "server", r"server side public licen[sc]e", r"sspl-1\.0", ""),
    ("busl", "business", r"business source licen[sc]e", r"busl-1\.1", ""),
    ("elastic", "elastic", r"elastic licen[sc]e", r"elastic-2\.0", ""),
    ("unlicense", "unlicense", r"the unlicense", r"unlicense", r"unlicense\.org"),
    ("wtfpl", "wtfpl", r"wtfpl", r"wtfpl", r"wtfpl\.net"),
    ("cc0", "cc0", r"cc0(?: 1\.0)?", r"cc0-1\.0", r"creativecommons\.org/publicdomain/zero"),
    ("cc-by-nc-nd", "nc", r"(?:cc[ -]by-nc-nd|creative commons attribution[ -]noncommercial[ -]noderivatives)(?: [1234]\.\d)?", r"cc-by-nc-nd-[1234]\.\d", r"creativecommons\.org/licenses/by-nc-nd"),
    ("cc-by-nc-sa", "nc", r"(?:cc[ -]by-nc-sa|creative commons attribution[ -]noncommercial[ -]sharealike)(?: [1234]\.\d)?", r"cc-by-nc-sa-[1234]\.\d", r"creativecommons\.org/licenses/by-nc-sa"),
    ("cc-by-nc", "nc", r"(?:cc[ -]by-nc|creative commons attribution[ -]noncommercial)(?: [1234]\.\d)?", r"cc-by-nc-[1234]\.\d", r"creativecommons\.org/licenses/by-nc/"),
    ("cc-by-nd", "", r"(?:cc[ -]by-nd|creative commons attribution[ -]noderivatives)(?: [1234]\.\d)?", r"cc-by-nd-[1234]\.\d", r"creativecommons\.org/licenses/by-nd"),
    ("cc-by-sa", "", r"(?:cc[ -]by-sa|creative commons attribution[ -]sharealike)(?: [1234]\.\d)?", r"cc-by-sa-[1234]\.\d", r"creativecommons\.org/licenses/by-sa"),
    ("cc-by", "", r"(?:cc[ -]by|creative commons attribution)(?: [1234]\.\d)?", r"cc-by-[1234]\.\d", r"creativecommons\.org/licenses/by/"),
    ("public-domain", "domain", r"(?:in|into|to) the public domain", r"public-domain", ""),
]

#: Form, priority, pattern; {name} and {id} come from the table above.
FORMS = [
    ("name", NAME, r"{name}"),
    ("grant", GRANT, r"(?:licen[sc]ed|released|distributed|available|provided|published|covered) (?:to you )?under (?:the )?(?:terms(?: and conditions)? of )?(?:the )?(?:an? )?{name}"),
    ("field", GRANT, r"\blicen[sc]e ?[:=] ?[\"']?(?:the )?(?:{id}|{name})(?![\w-])"),
    ("identifier", IDENTIFIER, r"spdx-licen[sc]e-identifier: ?\(?{id}(?![\w.-])"),
]

#: Label, priority, keyword, pattern of sentences that belong to one licence, or hint at terms.
SENTENCES = [
    ("mit", TEXT, "hereby", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("mit", TEXT, "substantial", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc", TEXT, "hereby", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", TEXT, "redistribution", r"redistribution and use in source and binary forms, with or without modification, are permitted provided"),
    ("bsd-2-clause", TEXT, "redistributions", r"redistributions of source code must retain the above copyright notice"),
    ("bsd-2-clause", TEXT, "redistributions", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", TEXT, "endorse", r"neither the names? of .{1,120}? may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", TEXT, "advertising", r"all advertising materials mentioning features or use of this software must display .{0,80}acknowledg.{0,20}copyright"),
    ("apache", TEXT, "applicable", r"unless required by applicable law or agreed to in writing, software distributed under the (?:apache )?licen[sc]e is distributed on an \"?as is\"? basis"),
    ("apache", TEXT, "compliance", r"you may not use this file except in compliance with the licen[sc]e"),
    ("apache", TEXT, "grant", r"grant of copyright licen[sc]e\. subject to the terms and conditions of this licen[sc]e"),
    ("apache", TEXT, "patent", r"grant of patent licen[sc]e\. subject to the terms and conditions of this licen[sc]e"),
    ("gpl", TEXT, "foundation", r"it under the terms of the gnu general public licen[sc]e as published by the free software foundation"),
    ("gpl", TEXT, "merchantability", r"without even the implied warranty of merchantability or fitness for a particular purpose\. see the gnu general public licen[sc]e"),
    ("gpl", TEXT, "received", r"you should have received a copy of the gnu general public licen[sc]e"),
    ("gpl", TEXT, "copyleft", r"the gnu general public licen[sc]e is a free, copyleft licen[sc]e"),
    ("lgpl", TEXT, "lesser", r"it under the terms of the gnu lesser general public licen[sc]e as published by"),
    ("lgpl", TEXT, "received", r"you should have received a copy of the gnu lesser general public licen[sc]e"),
    ("agpl", TEXT, "affero", r"it under the terms of the gnu affero general public licen[sc]e as published by"),
    ("agpl", TEXT, "received", r"you should have received a copy of the gnu affero general public licen[sc]e"),
    ("mpl", TEXT, "mozilla", r"this source code form is subject to the terms of the mozilla public licen[sc]e"),
    ("mpl", TEXT, "mpl", r"if a copy of the mpl was not distributed with this file.{0,120}source code form|source code form.{0,200}if a copy of the mpl was not distributed with this file"),
    ("epl", TEXT, "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e"),
    ("cddl", TEXT, "development", r"the contents of this file are subject to the terms of the common development and distribution licen[sc]e"),
    ("boost", TEXT, "boost", r"distributed under the boost software licen[sc]e, version 1\.0"),
    ("boost", TEXT, "machine-executable", r"permission is hereby granted, .{0,200}machine-executable object code"),
    ("zlib", TEXT, "implied", r"this software is provided 'as-is', without any express or implied warranty"),
    ("zlib", TEXT, "misrepresented", r"the origin of this software must not be misrepresented.{0,200}warrant"),
    ("unlicense", TEXT, "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", TEXT, "anyone", r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software.{0,400}public domain"),
    ("wtfpl", TEXT, "fuck", r"do what the fuck you want to public licen[sc]e"),
    ("cc0", TEXT, "dedicated", r"has dedicated the work to the public domain"),
    ("cc0", TEXT, "waiving", r"waiving all of (?:his|her|their) rights to the work worldwide under copyright"),
    ("cc-by", TEXT, "attribution", r"this work is licen[sc]ed under (?:a|the) creative commons attribution(?: [1234]\.\d)? (?:international|unported|generic) licen[sc]e"),
    ("cc-by-sa", TEXT, "sharealike", r"this work is licen[sc]ed under (?:a|the) creative commons attribution-sharealike(?: [1234]\.\d)?"),
    ("cc-by-nc", TEXT, "noncommercial", r"this work is licen[sc]ed under (?:a|the) creative commons attribution-noncommercial(?: [1234]\.\d)?"),
    ("python", TEXT, "python", r"psf is making python available to licensee on an \"as is\" basis"),
    ("openssl", TEXT, "openssl", r"redistributions of any form whatsoever must retain the following acknowledgment.{0,80}openssl"),
    ("php", TEXT, "php", r"redistributions of any form whatsoever must retain .{0,80}this product includes php"),
    ("artistic", TEXT, "artistic", r"everyone is permitted to copy and distribute verbatim copies of this licen[sc]e document.{0,200}artistic"),
    ("ofl", TEXT, "font", r"permission is hereby granted, .{0,80}the font software"),
    ("ncsa", TEXT, "deal", r"permission is hereby granted, .{0,200}to deal with the software without restriction"),
    ("w3c", TEXT, "w3c", r"permission to copy, modify, and distribute .{0,120}w3c"),
    ("postgresql", TEXT, "agreement", r"permission to use, copy, modify, and distribute .{0,120}without a written agreement is hereby granted"),
    ("elastic", TEXT, "hosted", r"you may not provide the software to third parties as a hosted or managed service.{0,200}licen[sc]e"),
    ("busl", TEXT, "effective", r"effective on the change date.{0,200}licen[sc]e"),
    ("public-domain", GRANT, "domain", r"(?:placed|released|dedicated|donated) (?:in|into|to) the public domain"),
    ("public-domain", GRANT, "domain", r"(?:author|authors|copyright holder) .{0,40}disclaims? copyright.{0,40}public domain"),
    ("proprietary", GRANT, "proprietary", r"(?:confidential and proprietary|proprietary and confidential)"),
    ("proprietary", GRANT, "prohibited", r"unauthori[sz]ed (?:copying|use|reproduction|distribution) .{0,120}strictly prohibited.{0,80}(?:copyright|permission)"),
    ("proprietary", GRANT, "written", r"without (?:the )?(?:express|prior) written (?:permission|consent of the copyright)"),
    ("rights-reserved", HINT, "reserved", r"all rights reserved"),
    ("rights-reserved", HINT, "reserved", r"some rights reserved"),
    ("copyright-notice", HINT, "copyright", r"copyright (?:\(c\)|©)? ?(?:19|20)\d\d"),
    ("copyright-notice", HINT, "copyright", r"\(c\) copyright (?:19|20)\d\d"),
    ("no-warranty", HINT, "warrant", r"without warrant(?:y|ies) of any kind"),
    ("no-warranty", HINT, "warrant", r"provided \"?as is\"?,? without (?:any )?warrant"),
    ("patent-grant", HINT, "patent", r"royalty-free,? (?:irrevocable )?patent licen[sc]e"),
    ("see-license", HINT, "licen", r"see (?:the )?(?:accompanying )?licen[sc]e(?:\.txt|\.md)?(?: file)?(?: for (?:details|more information))"),
]


#: What may stand between two words: white space of any kind and length, and after a line end the marks that begin a line of a comment.
_WITHIN_LINE = C.SPACE.replace(r"\s", r"\x20\t\x0B\f")
GAP = rf"(?:[{_WITHIN_LINE}]*+[\r\n][{C.SPACE}]*+(?:\*+|#+|//+|--+|;+|%+|>+|\|+)(?=[{C.SPACE}]))*[{C.SPACE}]+"


def _spaced(pattern: str) -> str:
    """The pattern with a gap (``GAP``) for each of its spaces, those in brackets included."""
    pattern = pattern.replace("[ /-]", "(?: |[/-])").replace("[ -]", "(?: |-)")
    return pattern.replace(" ?", f"(?:{GAP})?").replace(" ", GAP)


def rules() -> list[Rule]:
    """All rules, the stronger ones first."""
    across = lambda pattern: pattern.replace(".{", "(?s:.){")
    found = [(label, priority, keyword, across(pattern)) for label, priority, keyword, pattern in SENTENCES]
    for label, keyword, name, identifier, address in LICENSES:
        for form, priority, pattern in FORMS:
            known = keyword if form in ("name", "grant") else "licen"
            found.append((label, priority, known, pattern.replace("{name}", f"(?:{across(name)})").replace("{id}", f"(?:{identifier})")))
        if address:
            found.append((label, IDENTIFIER, address.split("/")[0].replace("\\", ""), address))
    found.sort(key=lambda r: r[1])
    return [Rule(n, label, priority, keyword, _spaced(pattern)) for n, (label, priority, keyword, pattern) in enumerate(found)]
