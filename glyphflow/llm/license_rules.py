"""Signature rules of licenses: names with versions in each of their forms, and what their texts, headers and notices say.

Texts are lower-cased words with one space around each, so "GPL-2.0+" reads " gpl 2 0 ". Every rule has a keyword that each of its
matches holds and that other texts rarely do; a group of rules of one keyword is looked at only where it stands.
"""

from __future__ import annotations

#: label, names as (keyword, expression), versions as (suffix of the label, expression). Acronyms may bear a version without "license".
FAMILIES = (
    ("mit", (("mit", "mit(?: x11| expat)?"), ("expat", "expat")), ()),
    ("apache", (("apache", "apache(?: software)?(?: foundation)?"), ("asl", "asl")), (("1.0", "1 0"), ("1.1", "1 1"), ("2", "2(?: 0)?"))),
    ("bsd", (("bsd", "(?:(?:new|modified|simplified|revised|original) )?bsd"),), (("2-clause", "2 clause"), ("3-clause", "3 clause"), ("4-clause", "4 clause"), ("0-clause", "(?:0|zero) clause"))),
    ("gpl", (("gpl", "(?:gnu )?gpl"), ("general public", "(?:gnu )?general public")), (("1", "1(?: 0)?"), ("2", "2(?: 0)?"), ("3", "3(?: 0)?"))),
    ("lgpl", (("lgpl", "(?:gnu )?lgpl"), ("lesser general public", "(?:gnu )?lesser general public"), ("library general public", "(?:gnu )?library general public")), (("2", "2(?: 0)?"), ("2.1", "2 1"), ("3", "3(?: 0)?"))),
    ("agpl", (("agpl", "(?:gnu )?agpl"), ("affero general public", "(?:gnu )?affero general public")), (("1", "1(?: 0)?"), ("3", "3(?: 0)?"))),
    ("gfdl", (("gfdl", "(?:gnu )?gfdl"), ("free documentation", "(?:gnu )?free documentation")), (("1.1", "1 1"), ("1.2", "1 2"), ("1.3", "1 3"))),
    ("mpl", (("mpl", "mpl"), ("mozilla public", "mozilla public")), (("1.0", "1 0"), ("1.1", "1 1"), ("2.0", "2(?: 0)?"))),
    ("epl", (("epl", "epl"), ("eclipse public", "eclipse public")), (("1.0", "1(?: 0)?"), ("2.0", "2(?: 0)?"))),
    ("cddl", (("cddl", "cddl"), ("common development and distribution", "common development and distribution")), (("1.0", "1 0"), ("1.1", "1 1"))),
    ("cpl", (("cpl", "cpl"), ("common public", "common public")), (("1.0", "1 0"),)),
    ("eupl", (("eupl", "eupl"), ("european union public", "european union public")), (("1.1", "1 1"), ("1.2", "1 2"))),
    ("artistic", (("artistic", "(?:perl )?artistic"),), (("1.0", "1 0"), ("2.0", "2(?: 0)?"))),
    ("bsl", (("boost", "boost(?: software)?"),), (("1.0", "1 0"),)),
    ("busl", (("business source", "business source"), ("busl", "busl")), (("1.1", "1 1"),)),
    ("ofl", (("ofl", "(?:sil )?ofl"), ("open font", "(?:sil )?open font")), (("1.0", "1 0"), ("1.1", "1 1"))),
    ("afl", (("academic free", "academic free"), ("afl", "afl")), (("2.1", "2 1"), ("3.0", "3(?: 0)?"))),
    ("osl", (("open software", "open software"),), (("2.1", "2 1"), ("3.0", "3(?: 0)?"))),
    ("upl", (("universal permissive", "universal permissive"),), (("1.0", "1 0"),)),
    ("ecl", (("educational community", "educational community"),), (("1.0", "1 0"), ("2.0", "2 0"))),
    ("odbl", (("odbl", "odbl"), ("open database", "open database")), (("1.0", "1 0"),)),
    ("odc-by", (("open data commons attribution", "open data commons attribution"),), (("1.0", "1 0"),)),
    ("wtfpl", (("wtfpl", "wtfpl"), ("what the fuck", "do what the fuck you want to public")), (("2", "2"),)),
    ("isc", (("isc", "isc"),), ()),
    ("zlib", (("zlib", "zlib(?: libpng)?"),), ()),
    ("libpng", (("libpng", "libpng"),), ()),
    ("python", (("python", "python(?: software foundation)?"), ("psf", "psf")), (("2", "2(?: 0)?"),)),
    ("postgresql", (("postgresql", "postgresql"),), ()),
    ("openssl", (("openssl", "openssl"),), ()),
    ("unlicense", (("unlicense", "unlicense"),), ()),
    ("ms-pl", (("microsoft public", "microsoft public"), ("ms pl", "ms pl")), ()),
    ("ms-rl", (("microsoft reciprocal", "microsoft reciprocal"), ("ms rl", "ms rl")), ()),
    ("ncsa", (("ncsa", "(?:university of illinois )?ncsa(?: open source)?"),), ()),
    ("x11", (("x11", "x11"),), ()),
    ("vim", (("vim", "vim"),), ()),
    ("ruby", (("ruby", "ruby"),), ()),
    ("php", (("php", "php"),), (("3.0", "3 0"), ("3.01", "3 01"))),
    ("qpl", (("q public", "q public"),), (("1.0", "1 0"),)),
    ("sspl", (("sspl", "sspl"), ("server side public", "server side public")), (("1", "1(?: 0)?"),)),
    ("elastic", (("elastic", "elastic"),), (("2.0", "2(?: 0)?"),)),
    ("polyform", (("polyform", "polyform(?: noncommercial| small business| perimeter| shield)?"),), (("1.0.0", "1 0 0"),)),
    ("cc0", (("cc0", "cc0"),), (("1.0", "1 0"),)),
    ("open-government", (("open government", "open government"),), (("1.0", "1 0"), ("2.0", "2 0"), ("3.0", "3 0"))),
    ("openrail", (("openrail", "(?:creativeml )?(?:bigscience )?openrail(?: m| s)?"),), ()),
)
#: Families whose names without "license" say little, and those of which a version may follow at once, as in "gplv3".
PLAIN = frozenset("mit expat apache asl bsd boost artistic isc zlib libpng python psf postgresql openssl vim ruby php x11 elastic ncsa".split())
ACRONYMS = frozenset("gpl lgpl agpl gfdl mpl epl cddl cpl eupl ofl afl odbl sspl busl asl wtfpl cc0".split())
LICENSE, TERMS, UNDER, VERSION, LATER = "licen[cs]e", "(?:the )?(?:terms of the )?", "(?:licen[cs]ed under (?:the )?(?:terms of the )?)?", "(?:(?: licen[cs]e)?(?: version| ver| v)? ?v?)", " (?:or (?:later|newer|above|at your option any later version|any later version))"
CC = ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd")
CC_WORDS = {"by": "attribution", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?(?: work)?s?", "nc": "non ?commercial"}

#: priority, label, keyword, expression, weight. What texts, headers and notices of licenses say.
NOTICES = (
    (1, "mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software", 0.9),
    (2, "mit", "permission is hereby granted", "permission is hereby granted free of charge", 0.7),
    (1, "mit", "the above copyright notice", "the above copyright notice and this permission notice shall be included in all", 0.8),
    (1, "mit", "the software is provided as is", "the software is provided as is without warranty of any kind express or implied", 0.6),
    (1, "isc", "permission to use copy modify", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 0.9),
    (1, "0bsd", "permission to use copy modify", "permission to use copy modify and or distribute this software for any purpose with or without fee", 0.6),
    (1, "hpnd", "permission to use copy modify", "permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose", 0.8),
    (1, "bsd", "redistribution and use in source", "redistribution and use in source and binary forms with or without modification are permitted", 0.9),
    (1, "bsd", "redistributions of source code", "redistributions of source code must retain the above copyright notice", 0.8),
    (0, "bsd-3-clause", "endorse or promote products", "(?:names? of|neither the name).{0,120}? may be used to endorse or promote products derived from this software", 0.85),
    (0, "bsd-4-clause", "all advertising materials", "all advertising materials mentioning features or use of this software must display", 0.9),
    (1, "zlib", "altered source versions", "altered source versions must be plainly marked as such and must not be misrepresented", 0.9),
    (1, "zlib", "the origin of this software", "the origin of this software must not be misrepresented", 0.85),
    (1, "bsl-1.0", "permission is hereby granted", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", 0.9),
    (0, "bsl-1.0", "boost org license", "(?:www )?boost org license 1 0 txt", 0.9),
    (0, "apache-2.0", "apache org licenses", "(?:www )?apache org licenses license 2 0", 0.95),
    (1, "apache", "you may not use this file", "you may not use this file except in compliance with the license", 0.75),
    (1, "apache", "unless required by applicable", "unless required by applicable law or agreed to in writing software distributed under the license", 0.8),
    (2, "apache", "subject to the terms and conditions of this license", "subject to the terms and conditions of this license each contributor hereby grants to you", 0.7),
    (1, "gpl", "this program is free software", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", 0.9),
    (0, "gpl-2-or-later", "either version 2 of the license", "either version 2 of the license or (?:at your option )?any later version", 0.85),
    (0, "gpl-3-or-later", "either version 3 of the license", "either version 3 of the license or (?:at your option )?any later version", 0.85),
    (0, "lgpl-2.1-or-later", "either version 2 1 of the license", "either version 2 1 of the license or (?:at your option )?any later version", 0.9),
    (1, "lgpl", "this library is free software", "this library is free software you can redistribute it and or modify it", 0.9),
    (2, "gpl", "without even the implied warranty", "without even the implied warranty of merchantability or fitness for a particular purpose", 0.6),
    (2, "gpl", "you should have received a copy", "you should have received a copy of the gnu (?:lesser |affero )?general public license", 0.7),
    (1, "gpl", "free software foundation", "published by the free software foundation", 0.6),
    (1, "gpl", "gnu org licenses", "(?:www )?gnu org licenses(?: gpl(?: \\d(?: \\d)?)?(?: html| txt)?)?", 0.8),
    (1, "gpl", "copyleft", "(?:strong |weak )?copyleft license", 0.4),
    (1, "mpl-2.0", "mozilla org mpl", "(?:if a copy of the mpl was not distributed with this file.{0,60}? )?mozilla org mpl 2 0", 0.95),
    (0, "mpl-2.0", "this source code form", "this source code form is subject to the terms of the mozilla public license v 2 0", 0.95),
    (1, "epl", "eclipse org legal", "(?:www )?eclipse org legal epl(?: v\\d+| 2 0| v10)?(?: html)?", 0.85),
    (1, "epl", "this program and the accompanying materials", "this program and the accompanying materials are made available under the terms of the eclipse public license", 0.9),
    (1, "cddl", "the contents of this file are subject", "the contents of this file are subject to the terms of the common development and distribution license", 0.9),
    (2, "mpl", "the contents of this file are subject", "the contents of this file are subject to the mozilla public license", 0.8),
    (1, "unlicense", "free and unencumbered software", "this is free and unencumbered software released into the public domain", 0.95),
    (1, "unlicense", "unlicense org", "unlicense org", 0.85),
    (1, "wtfpl", "you just do what the fuck", "you just do what the fuck you want to", 0.9),
    (1, "beerware", "beer ware license", "(?:the )?beer ware license", 0.9),
    (1, "beerware", "you can buy me a beer", "you can buy me a beer in return", 0.8),
    (1, "json", "shall be used for good not evil", "the software shall be used for good not evil", 0.9),
    (1, "ofl", "this font software is licensed", "this font software is licensed under the sil open font license", 0.95),
    (1, "ofl", "reserved font name", "with reserved font names?", 0.7),
    (1, "python", "psf hereby grants", "psf hereby grants licensee a nonexclusive royalty free world wide license", 0.9),
    (1, "openssl", "openssl toolkit", "this product includes software developed by the openssl project for use in the openssl toolkit", 0.9),
    (1, "ncsa", "developed by", "developed by.{0,80}? deal with the software without restriction", 0.6),
    (1, "php", "this product includes php", "this product includes php software freely available from", 0.9),
    (1, "cc0", "creativecommons org publicdomain", "creativecommons org publicdomain zero(?: 1 0)?", 0.95),
    (1, "cc0", "waives all copyright", "waives all copyright and related or neighboring rights", 0.6),
    (1, "cc0", "cc0", "(?:creative commons )?cc0(?: 1 0)?(?: universal)?", 0.8),
    (1, "cc-pdm", "creativecommons org publicdomain", "creativecommons org publicdomain mark(?: 1 0)?", 0.9),
    (1, "cc-pdm", "public domain mark", "public domain mark(?: 1 0)?", 0.7),
    (2, "creative-commons", "creative commons licen", "creative commons licen[cs]ed?", 0.5),
    (2, "creative-commons", "creativecommons org licenses", "creativecommons org licenses", 0.6),
    (1, "busl", "change license", "(?:change date.{0,80}? )?change license", 0.6),
    (1, "commons-clause", "commons clause", "commons clause(?: license condition)?(?: v ?1 0)?", 0.85),
    (1, "openrail", "use restriction", "use restrictions? (?:as )?(?:set forth )?in attachment a", 0.7),
    (1, "llama", "llama", "llama(?: \\d(?: \\d)?)? community license(?: agreement)?", 0.9),
    (1, "gemma", "gemma terms", "gemma terms of use", 0.85),
    (1, "proprietary", "proprietary and confidential", "proprietary and confidential", 0.7),
    (1, "proprietary", "unauthorized copying", "unauthorized copying of this (?:file|software|work)", 0.7),
    (1, "proprietary", "end user license", "end user license agreement", 0.6),
    (1, "proprietary", "may not be reproduced", "may not be reproduced (?:or )?(?:distributed )?.{0,60}?without (?:the )?(?:prior |express )?(?:written )?permission", 0.7),
    (1, "non-commercial", "non commercial", "for (?:personal and )?non commercial use only", 0.6),
    (1, "non-commercial", "noncommercial", "(?:for )?noncommercial (?:use|purposes) only", 0.6),
    (1, "crown-copyright", "crown copyright", "crown copyright(?: \\d{4})?", 0.7),
    (1, "us-government", "work of the united states government", "work of the united states government", 0.7),
    (2, "public-domain", "public domain", "(?:is |are |placed |released |dedicated )?(?:in|into|to) the public domain", 0.5),
    (2, "all-rights-reserved", "all rights reserved", "all rights reserved", 0.4),
    (2, "all-rights-reserved", "tous droits", "tous droits (?:réservés|reserves)", 0.4),
    (2, "all-rights-reserved", "alle rechte vorbehalten", "alle rechte vorbehalten", 0.4),
    (2, "all-rights-reserved", "todos los derechos reservados", "todos los derechos reservados", 0.4),
    (2, "some-rights-reserved", "some rights reserved", "some rights reserved", 0.4),
    (2, "unknown-license", "licen", "(?:dual )?licen[cs]ed under", 0.3),
    (2, "unknown-license", "released under the", "released under the (?:\\S+ ){1,4}licen[cs]e", 0.3),
    (2, "unknown-license", "see the licen", "see the licen[cs]e (?:file|for)", 0.3),
    (2, "unknown-license", "licen", "licen[cs]e agreement", 0.3),
    (2, "unknown-license", "open source licen", "open source licen[cs]e", 0.3),
    (2, "unknown-license", "copyright c", "copyright c (?:19|20)\\d\\d", 0.2),
)


def family_rules(label: str, names: tuple, versions: tuple) -> list[tuple[int, str, str, str, float]]:
    out = []
    for keyword, name in names:
        word = keyword.split()[-1]
        short = keyword in ACRONYMS
        out.append((1, label, keyword, f"{name} {LICENSE}", 0.7))
        out.append((1, label, keyword, f"licen[cs]ed under {TERMS}{name}(?: {LICENSE})?", 0.75))
        out.append((1, label, keyword, f"(?:available|distributed|released|published|provided) under {TERMS}{name}(?: {LICENSE})?", 0.7))
        out.append((1, label, keyword, f"{name} licen[cs]ed", 0.7))
        if keyword not in PLAIN and (short or word == "public"):
            out.append((1, label, keyword, name, 0.5))
        for suffix, version in versions:
            clause = "clause" in suffix
            own = f"{label}-{suffix}"
            tail = f" {version}(?: {LICENSE})?" if clause else f"{VERSION}{version}" if short else f"(?: {LICENSE})?(?: version| ver| v)? ?v?{version}"
            out.append((0, own, keyword, f"{UNDER}{name}{tail}", 0.9))
            if clause:
                out.append((0, own, keyword, f"{UNDER}{version} {name}(?: {LICENSE})?", 0.9))
            elif label in ("gpl", "lgpl", "agpl", "gfdl"):
                out.append((0, f"{own}-or-later", keyword, f"{UNDER}{name}{tail}{LATER}", 0.9))
    for suffix, version in (*versions, ("", "")):
        plain = label.replace("-", " ")
        mark = f" {suffix.replace('-', ' ').replace('.', ' ')}".rstrip() if suffix else ""
        mark = mark if not version or "clause" in suffix else f" {version}"
        own = f"{label}-{suffix}" if suffix else label
        out.append((0 if suffix else 1, own, f"spdx license identifier {plain}", f"spdx license identifier {plain}{mark}(?: only)?", 0.95))
        if label in ("gpl", "lgpl", "agpl", "gfdl") and suffix:
            out.append((0, f"{own}-or-later", f"spdx license identifier {plain}", f"spdx license identifier {plain}{mark} or later", 0.97))
    return out


def creative_commons() -> list[tuple[int, str, str, str, float]]:
    out = []
    for kind in CC:
        names, words = kind.split(), " ".join(CC_WORDS[x] for x in kind.split())
        for version in ("4 0", "3 0", "2 5", "2 0", "1 0", ""):
            tail = f"(?: licen[cs]e)? (?:v(?:ersion)? ?)?{version}" if version else ""
            label = "-".join(["cc", *names, *([version.replace(" ", ".")] if version else [])])
            priority, weight = (0, 0.9) if version else (1, 0.8)
            out.append((priority, label, f"cc {kind}", f"{UNDER}cc {kind}{tail}", weight))
            out.append((priority, label, "creative commons attribution", f"{UNDER}creative commons {words}{f'(?: international| unported| generic)?{tail}' if tail else ''}", weight))
            out.append((priority, label, "creativecommons org licenses", f"creativecommons org licenses {kind}{f' {version}' if version else ''}", weight + 0.05))
    return out


def all_rules(base: tuple[tuple[str, str], ...]) -> list[dict]:
    """The rules in order: priority 0 names a version or variant, 1 a family, 2 only a hint. Keywords and expressions are
    words; an expression ends where a word does."""
    out = [(0, label, phrase, phrase, 0.95) for label, phrase in base]
    out += creative_commons()
    for family in FAMILIES:
        out += family_rules(*family)
    out += NOTICES
    return [{"priority": p, "label": label, "keyword": f" {keyword}", "regex": f" (?:{regex})(?= )", "weight": w, "n": n} for n, (p, label, keyword, regex, w) in enumerate(out)]
