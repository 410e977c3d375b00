"""License scans: ordered signature rules over word-normalised texts, in built-in functions only.

A text's words (lower-cased, punctuation dropped) joined by single spaces are matched by a few
hundred signature rules. Each rule belongs to a keyword; one pass over the text finds the
keywords that occur, and only their rules run. Hits are intervals; a hit goes if another one
contains it and has a higher priority, or the same priority and a greater length, or is alike
and comes from an earlier rule. What stays gives labels and the score.

Everything stays within a row: no join, no shuffle, whatever the input's size. The rule table is
a constant of the program (its size is asserted), so it is a literal of the plan.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text
from .spans import match_spans

GAP_CLASS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
BASE_WEIGHT = 0.6


class Rule(NamedTuple):
    #: A word that every match contains.
    keyword: str
    label: str
    priority: int
    weight: float
    pattern: str


#: label, keyword, names, versions
FAMILIES = (
    ("apache", "apache", r"apache(?: software)?(?: license| licence)", ("1 0", "1 1", "2 0", "2")),
    ("mit", "mit", r"mit(?: style)? license", ()),
    ("mit", "expat", r"expat(?: style)? license", ()),
    ("mit-0", "mit", r"mit no attribution(?: license)?", ()),
    ("x11", "x11", r"x11 license", ()),
    ("bsd", "bsd", r"(?:new |simplified |modified |revised )?bsd(?: style)? license", ()),
    ("bsd", "bsd", r"bsd [0-4] clause(?: [a-z]+)? license", ()),
    ("bsd", "clause", r"[0-4] clause bsd license", ()),
    ("gpl", "gpl", r"(?:gnu )?gpl", ("1", "2", "2 0", "3", "3 0")),
    ("gpl", "general", r"(?:gnu )?general public license", ("1", "1 0", "2", "2 0", "3", "3 0")),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl", ("2", "2 0", "2 1", "3", "3 0")),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public license", ("2 1", "3", "3 0")),
    ("lgpl", "library", r"(?:gnu )?library general public license", ("2", "2 0")),
    ("agpl", "agpl", r"(?:gnu )?agpl", ("1", "3", "3 0")),
    ("agpl", "affero", r"(?:gnu )?affero general public license", ("1", "3", "3 0")),
    ("gfdl", "documentation", r"(?:gnu )?free documentation license", ("1 1", "1 2", "1 3")),
    ("mpl", "mpl", r"mpl", ("1 0", "1 1", "2 0")),
    ("mpl", "mozilla", r"mozilla public license", ("1 0", "1 1", "2 0")),
    ("epl", "eclipse", r"eclipse public license", ("1 0", "2 0")),
    ("cddl", "distribution", r"common development and distribution license", ("1 0", "1 1")),
    ("cddl", "cddl", r"cddl", ("1 0", "1 1")),
    ("cpl", "common", r"common public license", ("1 0",)),
    ("ipl", "ibm", r"ibm public license", ("1 0",)),
    ("artistic", "artistic", r"(?:perl )?artistic license", ("1 0", "2 0")),
    ("zlib", "zlib", r"zlib(?: libpng)? license", ()),
    ("libpng", "libpng", r"libpng license", ("2 0",)),
    ("isc", "isc", r"isc license", ()),
    ("boost", "boost", r"boost software license", ("1 0",)),
    ("unlicense", "unlicense", r"(?:the )?unlicense", ()),
    ("wtfpl", "wtfpl", r"wtfpl", ("2",)),
    ("python", "python", r"python software foundation license", ("2", "2 0")),
    ("postgresql", "postgresql", r"postgresql license", ()),
    ("openssl", "openssl", r"openssl license", ()),
    ("ofl", "font", r"(?:sil )?open font license", ("1 0", "1 1")),
    ("eupl", "eupl", r"eupl", ("1 0", "1 1", "1 2")),
    ("eupl", "european", r"european union public licen[cs]e", ("1 0", "1 1", "1 2")),
    ("osl", "software", r"open software license", ("1 0", "2 0", "2 1", "3 0")),
    ("afl", "academic", r"academic free license", ("1 2", "2 0", "2 1", "3 0")),
    ("ms-pl", "microsoft", r"microsoft public license", ()),
    ("ms-rl", "microsoft", r"microsoft reciprocal license", ()),
    ("odbl", "database", r"open (?:data commons open )?database license", ("1 0",)),
    ("pddl", "dedication", r"public domain dedication and license", ("1 0",)),
    ("bsl", "business", r"business source license", ("1 0", "1 1")),
    ("sspl", "server", r"server side public license", ("1",)),
    ("elastic", "elastic", r"elastic license", ("1 0", "2 0")),
    ("cc0", "cc0", r"cc0", ("1 0",)),
    ("cc0", "zero", r"creative commons zero", ("1 0",)),
)
#: suffix of the label, words of the long name, words of the short name
CREATIVE = (
    ("by", "attribution", "by"), ("by-sa", "attribution share ?alike", "by sa"), ("by-nd", "attribution no ?deriv(?:s|atives)", "by nd"),
    ("by-nc", "attribution non ?commercial", "by nc"), ("by-nc-sa", "attribution non ?commercial share ?alike", "by nc sa"), ("by-nc-nd", "attribution non ?commercial no ?deriv(?:s|atives)", "by nc nd"),
)
CREATIVE_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
#: Whole signatures: keyword, label, priority, weight, pattern
SIGNATURES = (
    ("granted", "mit", 90, 1.0, r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("purpose", "isc", 90, 0.9, r"permission to use copy modify and(?: or)? distribute this software for any purpose"),
    ("redistribution", "bsd", 90, 1.0, r"redistribution and use in source and binary forms with or without modification(?: are permitted)?"),
    ("contributors", "bsd", 80, 0.8, r"neither the name of (?:\S+ ){1,12}nor the names of its contributors"),
    ("warranty", "warranty-disclaimer", 20, 0.4, r"without warranty of any kind(?: express or implied)?"),
    ("warranty", "warranty-disclaimer", 20, 0.4, r"without any warranty"),
    ("merchantability", "warranty-disclaimer", 20, 0.4, r"warranty of merchantability or fitness for a particular purpose"),
    ("provided", "warranty-disclaimer", 15, 0.3, r"(?:software|work|material) is provided as is"),
    ("foundation", "gpl", 85, 0.9, r"published by the free software foundation"),
    ("redistribute", "gpl", 85, 0.9, r"you can redistribute it and or modify it under the terms of"),
    ("domain", "public-domain", 60, 0.8, r"(?:released|dedicated|placed) (?:in)?to the public domain"),
    ("domain", "public-domain", 50, 0.6, r"(?:is|are) in the public domain"),
    ("copyright", "copyright", 10, 0.3, r"copyright (?:c )?(?:19|20)\d\d"),
    ("copyright", "copyright", 12, 0.3, r"copyright (?:c )?(?:19|20)\d\d (?:19|20)\d\d"),
    ("copyrighted", "copyright", 10, 0.3, r"(?:this|the) (?:work|material|text|content|article) is copyrighted"),
    ("reserved", "reserved", 30, 0.6, r"all rights reserved"),
    ("reserved", "some-rights", 30, 0.5, r"some rights reserved"),
    ("proprietary", "proprietary", 70, 0.9, r"proprietary and confidential"),
    ("confidential", "proprietary", 65, 0.8, r"confidential and proprietary"),
    ("permission", "restricted", 60, 0.7, r"(?:may not|not) be (?:reproduced|copied|redistributed|republished)(?: \S+){0,8} without(?: \S+){0,6} permission"),
    ("unauthorized", "restricted", 60, 0.7, r"unauthorized (?:copying|use|reproduction|distribution) (?:of this \S+ )?is (?:strictly )?prohibited"),
    ("commercial", "non-commercial", 40, 0.6, r"for non commercial (?:use|purposes) only"),
    ("noncommercial", "non-commercial", 40, 0.6, r"for noncommercial (?:use|purposes) only"),
    ("attribution", "attribution", 25, 0.4, r"attribution required"),
    ("spdx", "spdx", 5, 0.5, r"spdx license identifier"),
    ("licensed", "licensed", 5, 0.3, r"licensed under(?: the)?"),
    ("released", "licensed", 5, 0.3, r"released under(?: the)?"),
    ("distributed", "licensed", 5, 0.3, r"distributed under(?: the terms of)?(?: the)?"),
)


#: More whole signatures, alike
CLAUSES = (
    ("copyright", "mit", 72, 0.8, r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("holders", "mit", 60, 0.6, r"in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("permission", "mit-modern", 70, 0.7, r"permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("redistributions", "bsd", 75, 0.8, r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("redistributions", "bsd", 75, 0.8, r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("advertising", "bsd-4-clause", 82, 0.9, r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("contributors", "bsd", 60, 0.6, r"this software is provided by the (?:copyright holders|regents) and contributors as is"),
    ("prior", "bsd", 65, 0.7, r"may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("compliance", "apache-2.0", 80, 0.9, r"you may not use this file except in compliance with the license"),
    ("perpetual", "apache-2.0", 78, 0.9, r"a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license"),
    ("basis", "apache-2.0", 55, 0.6, r"distributed on an as is basis without warranties or conditions of any kind"),
    ("notice", "apache-2.0", 62, 0.7, r"if the work includes a notice text file as part of its distribution"),
    ("acknowledgment", "apache-1.1", 66, 0.7, r"this product includes software developed by the apache software foundation(?: \S+){0,6} acknowledgment"),
    ("hope", "gpl", 70, 0.8, r"(?:is )?distributed in the hope that it will be useful"),
    ("received", "gpl", 72, 0.8, r"you should have received a copy of the gnu (?:general|lesser general|affero general|library general) public license"),
    ("copyleft", "gpl", 68, 0.7, r"gnu general public license(?: \S+){0,4} is a free copyleft license"),
    ("surrender", "gpl-3.0", 66, 0.7, r"to protect your rights we need to prevent others from denying you these rights or asking you to surrender (?:the rights|your freedoms)"),
    ("freedoms", "gpl-3.0", 66, 0.7, r"must pass on to the recipients the same freedoms"),
    ("preamble", "gpl", 64, 0.7, r"preamble the licenses for most software are designed to take away your freedom"),
    ("verbatim", "gpl", 50, 0.6, r"everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("exception", "gpl-classpath", 84, 0.9, r"as a special exception the copyright holders of this library give you permission to link this library with independent modules"),
    ("font", "gpl-font", 82, 0.9, r"as a special exception if you create a document which uses this font and embed this font"),
    ("combined", "lgpl", 66, 0.7, r"you may convey a combined work under terms of your choice"),
    ("library", "lgpl", 62, 0.7, r"a program that contains no derivative of any portion of the library but is designed to work with the library"),
    ("network", "agpl", 74, 0.9, r"your modified version must prominently offer all users interacting with it remotely through a computer network"),
    ("covered", "mpl", 70, 0.8, r"each contributor hereby grants you a world wide royalty free non exclusive license(?: \S+){0,20} covered software"),
    ("incompatible", "mpl-2.0", 72, 0.8, r"this source code form is incompatible with secondary licenses"),
    ("accompanying", "epl", 64, 0.7, r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("contents", "cddl", 68, 0.8, r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("contents", "mpl-1.1", 68, 0.8, r"the contents of this file are subject to the mozilla public license"),
    ("netscape", "npl", 66, 0.8, r"the contents of this file are subject to the netscape public license"),
    ("fee", "isc", 76, 0.8, r"for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("fee", "0bsd", 70, 0.7, r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software"),
    ("misrepresented", "zlib", 78, 0.9, r"the origin of this software must not be misrepresented"),
    ("altered", "zlib", 70, 0.8, r"altered source versions must be plainly marked as such"),
    ("arising", "zlib", 58, 0.6, r"in no event will the authors be held liable for any damages arising from the use of this software"),
    ("machine", "boost", 70, 0.8, r"solely in the form of machine executable object code generated by a source language processor"),
    ("unencumbered", "unlicense", 84, 1.0, r"this is free and unencumbered software released into the public domain"),
    ("compiled", "unlicense", 66, 0.7, r"anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary"),
    ("want", "wtfpl", 76, 0.9, r"you just do what the (?:fuck|f\S*) you want to"),
    ("beer", "beerware", 78, 0.9, r"(?:you can )?buy me a beer in return"),
    ("artistic", "artistic", 66, 0.7, r"terms of the perl artistic license"),
    ("package", "artistic", 62, 0.7, r"you may make and give away verbatim copies of the source form of the standard version of this package"),
    ("beopen", "python", 76, 0.9, r"beopen python open source license agreement(?: version 1)?"),
    ("psf", "python", 64, 0.7, r"psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("openssl", "openssl", 72, 0.8, r"this product includes software developed by the openssl project"),
    ("ssleay", "ssleay", 74, 0.9, r"this product includes cryptographic software written by eric young(?: \S+){0,3} ssleay"),
    ("ssleay", "ssleay", 74, 0.9, r"ssleay license"),
    ("reserved", "ofl", 64, 0.7, r"no modified version of the font software may use the reserved font name"),
    ("font", "ofl", 66, 0.8, r"the font software may be sold as part of a larger software package"),
    ("sil", "ofl-1.1", 70, 0.9, r"this font software is licensed under the sil open font license"),
    ("creative", "cc", 45, 0.6, r"(?:is )?licensed under a creative commons"),
    ("adaptation", "cc", 52, 0.6, r"an adaptation under the same license"),
    ("credit", "cc-by", 55, 0.7, r"you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("remix", "cc-by-sa", 58, 0.7, r"if you remix transform or build upon the material you must distribute your contributions under the same license"),
    ("remix", "cc-by-nd", 58, 0.7, r"if you remix transform or build upon the material you may not distribute the modified material"),
    ("commercial", "cc-by-nc", 56, 0.7, r"you may not use the material for commercial purposes"),
    ("waive", "cc0", 70, 0.9, r"(?:has waived|waive) all copyright and related or neighboring rights(?: \S+){0,4} waive"),
    ("waive", "cc0", 70, 0.9, r"waive all copyright and related rights"),
    ("dedicated", "cc0", 64, 0.8, r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("database", "odbl", 62, 0.8, r"made available under the open database license"),
    ("odc", "odc-by", 64, 0.8, r"(?:open data commons attribution license|odc by) odc"),
    ("odc", "odc-by", 64, 0.8, r"odc by(?: 1 0)?"),
    ("contains", "ogl", 66, 0.8, r"contains public sector information licensed under the open government licen[cs]e"),
    ("government", "ogl", 50, 0.7, r"open government licen[cs]e(?: v?\d(?: 0)?)?"),
    ("universal", "upl", 60, 0.8, r"universal permissive license(?: v? ?1 0)?"),
    ("mulan", "mulan", 60, 0.8, r"mulan (?:psl|permissive software license)(?: v?2)?"),
    ("licensor", "bsl-1.1", 68, 0.8, r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use"),
    ("clause", "commons-clause", 74, 0.9, r"(?:the )?commons clause license condition(?: v?1 0)?"),
    ("service", "sspl", 70, 0.8, r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("hosted", "elastic-2.0", 68, 0.8, r"you may not provide the software to third parties as a hosted or managed service"),
    ("polyform", "polyform", 66, 0.8, r"polyform (?:noncommercial|small business|shield|strict|perimeter) license(?: 1 0 0)?"),
    ("evil", "json", 82, 1.0, r"(?:the software )?shall be used for good not evil"),
    ("community", "llama", 56, 0.7, r"llama(?: [234])? community license agreement"),
    ("qt", "qpl", 60, 0.8, r"q public license(?: \S+){0,3} qt"),
    ("qt", "qpl", 60, 0.8, r"qt public license"),
    ("vim", "vim", 58, 0.7, r"vim license"),
    ("php", "php", 60, 0.8, r"php license(?: version)?(?: 3 0)?"),
    ("nasa", "nasa", 58, 0.7, r"nasa open source agreement(?: 1 3)?"),
    ("w3c", "w3c", 62, 0.8, r"w3c software (?:notice and )?(?:and document )?license"),
    ("unicode", "unicode", 62, 0.8, r"unicode (?:inc )?license agreement(?: data files and software)?"),
    ("curl", "curl", 56, 0.7, r"curl license"),
    ("zip", "info-zip", 58, 0.7, r"info zip license"),
    ("stanford", "libtiff", 58, 0.7, r"names of sam leffler and silicon graphics(?: \S+){0,9} stanford"),
    ("stanford", "libtiff", 58, 0.7, r"stanford university license"),
    ("icu", "icu", 56, 0.7, r"icu license"),
    ("historical", "hpnd", 60, 0.8, r"historical permission notice and disclaimer"),
    ("educational", "ecl", 60, 0.8, r"educational community license(?: version)?(?: 2 0)?"),
    ("latex", "lppl", 62, 0.8, r"latex project public license(?: version)?(?: 1 3c?)?"),
    ("publication", "opl", 58, 0.7, r"open publication license"),
    ("invariant", "fdl", 62, 0.8, r"with no invariant sections(?: no front cover texts)?"),
    ("agreement", "eula", 54, 0.7, r"end user license agreement"),
    ("install", "eula", 52, 0.6, r"by installing copying or otherwise using (?:the|this) (?:software|product)(?: \S+){0,6} install"),
    ("install", "eula", 52, 0.6, r"you may install and use one copy"),
    ("reverse", "proprietary", 62, 0.7, r"(?:may|shall) not reverse engineer(?: decompile or disassemble)?"),
    ("internal", "proprietary", 52, 0.6, r"for internal use only"),
    ("consent", "restricted", 60, 0.7, r"without the (?:prior |express |prior express )?written consent of"),
    ("transmitted", "restricted", 64, 0.8, r"no part of this (?:publication|book|work|document) may be reproduced(?: stored in a retrieval system)? or transmitted"),
    ("reprinted", "restricted", 54, 0.6, r"(?:reprinted|reproduced) with permission(?: \S+){0,4} reprinted"),
    ("reprinted", "restricted", 54, 0.6, r"reprinted with(?: the)? permission"),
    ("tous", "all-rights", 45, 0.6, r"tous droits (?:de reproduction )?reserves"),
    ("tous", "all-rights", 45, 0.6, r"tous droits r\S*serv\S*s"),
    ("alle", "all-rights", 45, 0.6, r"alle rechte vorbehalten"),
    ("todos", "all-rights", 45, 0.6, r"todos los derechos reservados"),
    ("educational", "educational", 38, 0.5, r"for (?:educational|research)(?: and (?:research|educational))? (?:use|purposes) only educational"),
    ("educational", "educational", 38, 0.5, r"for educational (?:use|purposes) only"),
    ("research", "research", 38, 0.5, r"for research (?:use|purposes) only"),
    ("evaluation", "evaluation", 42, 0.5, r"for evaluation (?:use|purposes) only"),
    ("royalty", "free-use", 40, 0.5, r"royalty free(?: license| use)?"),
    ("government", "public-domain", 52, 0.6, r"(?:is a )?work of the (?:united states|u s|us) government"),
    ("dual", "dual", 46, 0.6, r"dual licensed(?: under)?"),
    ("terms", "terms", 12, 0.2, r"terms of (?:use|service)(?: apply)?"),
    ("consequential", "disclaimer", 22, 0.4, r"(?:direct )?indirect incidental special exemplary or consequential damages"),
    ("noninfringement", "disclaimer", 24, 0.4, r"merchantability fitness for a particular purpose and noninfringement"),
    ("trademarks", "trademark", 20, 0.3, r"(?:are )?(?:registered )?trademarks (?:or registered trademarks )?of"),
    ("cla", "contributor", 40, 0.5, r"contributor license agreement(?: cla)? cla"),
)


def build_rules() -> list[Rule]:
    """All rules in order: whole signatures, then each family's grants, versions and bare names."""
    out = [Rule(*s) for s in (*SIGNATURES, *CLAUSES)]
    grant = r"(?:licensed|released|distributed|available|published)(?: to you)? under (?:the )?(?:terms of )?(?:the )?"
    for label, keyword, name, versions in FAMILIES:
        out.append(Rule(keyword, label, 50, 0.9, grant + name))
        out.append(Rule(keyword, label, 30, 0.6, name))
        out.append(Rule(keyword, label, 40, 0.8, rf"spdx license identifier {name}"))
        for v in versions:
            slug = v.replace(" ", ".")
            out.append(Rule(keyword, f"{label}-{slug}", 60, 1.0, rf"{grant}{name}(?: version| v)? {v}"))
            out.append(Rule(keyword, f"{label}-{slug}", 55, 0.9, rf"{name}(?: version| v)? {v}(?: or(?: \S+)? later)?"))
    for suffix, long, short in CREATIVE:
        for keyword, name in (("creative", f"creative commons {long}"), ("cc", f"cc {short}")):
            out.append(Rule(keyword, f"cc-{suffix}", 35, 0.7, name))
            for v in CREATIVE_VERSIONS:
                out.append(Rule(keyword, f"cc-{suffix}-{v.replace(' ', '.')}", 60, 1.0, rf"{name}(?: license)? {v}"))
    assert len(out) < 2000
    return out


RULES = build_rules()
KEYWORDS = sorted({r.keyword for r in RULES})


def _bounded(pattern: str) -> str:
    return rf"(?<= )(?:{pattern})(?= )"


def rule_table() -> Column:
    """All rules as one literal, so that planning doesn't grow with them."""
    rows = [[i, r.keyword, r.label, r.priority, r.weight, _bounded(r.pattern)] for i, r in enumerate(RULES)]
    named = [dict(zip(("n", "keyword", "label", "priority", "weight", "pattern"), r, strict=True)) for r in rows]
    return F.from_json(F.lit(json.dumps(named)), "array<struct<n:int,keyword:string,label:string,priority:int,weight:double,pattern:string>>")


def words_of(text: Column) -> Column:
    """Lower-casing beyond A-Z changes no phrase or rule, which are in ASCII, and no word's extent."""
    return F.filter(F.split(F.lower(text), GAP_CLASS), lambda w: w != "")


def hits(words: Column, named: Column) -> Column:
    """Hits that stay, as array<struct<start, end, n, label, priority, weight>>, places in the joined words.

    words, named: columns, so that they are computed once for all rules.
    """
    joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))

    def found(text: Column) -> Column:
        rules = F.filter(rule_table(), lambda r: F.array_contains(named, r["keyword"]))
        all_hits = F.flatten(F.transform(rules, lambda r: F.transform(match_spans(text, r["pattern"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), r["n"].alias("n"), r["label"].alias("label"), r["priority"].alias("priority"), r["weight"].alias("weight")))))
        return F.transform(F.array(all_hits), suppressed)[0]

    return F.transform(F.array(joined), found)[0]


def suppressed(all_hits: Column) -> Column:
    """Without those that a stronger hit contains."""

    def contains(b: Column, a: Column) -> Column:
        longer = (b["end"] - b["start"]) > (a["end"] - a["start"])
        stronger = (b["priority"] > a["priority"]) | ((b["priority"] == a["priority"]) & (longer | ((b["start"] == a["start"]) & (b["end"] == a["end"]) & (b["n"] < a["n"]))))
        return (b["start"] <= a["start"]) & (b["end"] >= a["end"]) & stronger

    return F.filter(all_hits, lambda a: ~F.exists(all_hits, lambda b: contains(b, a)))


def phrase_places(words: Column) -> Column:
    """array<struct<at, label>>: places of the base phrases, in words from 0."""
    def places(want: list[str], label: str) -> Column:
        def stands(i: Column) -> Column:
            out = F.lit(True)
            for j, w in enumerate(want):
                out = out & F.coalesce(F.get(words, i + j) == w, F.lit(False))
            return out

        at = F.filter(F.sequence(F.lit(0), F.size(words) - 1), stands)
        at = F.when(F.size(words) > 0, at).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))

    return F.concat(*(places(phrase.split(), label) for phrase, label in PHRASES))


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_words, n_base, first_word, last_word, base_labels, labels, score`` of every row.

    The score is one minus the product of what is missing from 1 in the weight of each label's
    strongest hit, base phrases counting ``BASE_WEIGHT``. A null or text without words has no
    words, labels or places and scores 0. Repeated rows each give a row; other columns are left
    out.
    """
    rows = docs.select(F.col(key), words_of(whole_text(F.col(text))).alias("_w"))
    first_words = F.array(*(F.lit(p.split()[0]) for p, _ in PHRASES))
    rows = rows.select(key, "_w", F.array_intersect("_w", F.array(*map(F.lit, KEYWORDS))).alias("_named"), F.arrays_overlap("_w", first_words).alias("_maybe"))
    rows = rows.select(
        key,
        F.size("_w").cast("long").alias("n_words"),
        F.when(F.col("_maybe"), phrase_places(F.col("_w"))).otherwise(F.array().cast("array<struct<at:bigint,label:string>>")).alias("_base"),
        F.when(F.size("_named") > 0, hits(F.col("_w"), F.col("_named"))).otherwise(F.array().cast("array<struct<start:int,end:int,n:int,label:string,priority:int,weight:double>>")).alias("_hits"),
    )
    base_labels = F.array_distinct(F.transform("_base", lambda b: b["label"]))
    labels = F.array_sort(F.array_union(base_labels, F.transform("_hits", lambda h: h["label"])))
    weight = lambda label: F.greatest(F.coalesce(F.array_max(F.transform(F.filter("_hits", lambda h: h["label"] == label), lambda h: h["weight"])), F.lit(0.0)), F.when(F.array_contains(base_labels, label), BASE_WEIGHT).otherwise(0.0))
    return rows.select(
        key, "n_words", F.size("_base").cast("long").alias("n_base"),
        F.array_min(F.transform("_base", lambda b: b["at"])).alias("first_word"),
        F.array_max(F.transform("_base", lambda b: b["at"])).alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        (F.lit(1.0) - F.aggregate(labels, F.lit(1.0), lambda a, label: a * (1 - weight(label)))).alias("score"),
    )
