"""License scans by ordered signature rules, with DataFrame functions only.

A rule is a regex over normalised text (lower-case words joined by single
spaces). A text is first gated by general license vocabulary, then a rule by its
own keyword, and only then its regex runs: matches are marked in the text by
control characters, which gives their word positions in one pass. Detections
overlap; one is suppressed if another with an equal or better priority contains
its interval (of equal ones the rule that stands first stays).

The rules are SIGNATURES, sentences of license texts, notices and deeds by hand,
and for each of FAMILIES the few forms in which a license is named.

Scale: narrow, no shuffle, no Python. Work per gated text is linear in its words
for each rule whose keyword it has.

Defined cases: null is the empty text with no words. Ids may be null or repeated:
every row is scanned on its own, other columns are left out. Texts of any length
are scanned whole.
"""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.shared import let, lower_ascii

#: Phrases whose places always count, with their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Label, keyword (a word sequence every match holds), regex of the name in normalised words.
FAMILIES = (
    ("agpl", "affero", "(?:gnu )?affero general public"),
    ("lgpl", "lesser general", "(?:gnu )?lesser general public"),
    ("lgpl", "library general", "(?:gnu )?library general public"),
    ("gpl", "general public", "(?:gnu )?general public"),
    ("gpl", "gpl", "(?:gnu )?gpl"),
    ("fdl", "free documentation", "(?:gnu )?free documentation"),
    ("mit", "mit", "(?:the )?mit"),
    ("mit", "expat", "expat"),
    ("apache", "apache", "apache(?: software)?"),
    ("bsd-2-clause", "2 clause", "(?:simplified )?bsd 2 clause|2 clause bsd"),
    ("bsd-3-clause", "3 clause", "(?:new )?bsd 3 clause|3 clause bsd"),
    ("bsd", "bsd", "(?:new |modified |simplified |original )?bsd"),
    ("mpl", "mozilla", "mozilla public"),
    ("epl", "eclipse", "eclipse public"),
    ("eupl", "european union", "european union public"),
    ("cddl", "common development", "common development and distribution"),
    ("cpl", "common public", "common public"),
    ("ipl", "ibm public", "ibm public"),
    ("isc", "isc", "isc"),
    ("zlib", "zlib", "zlib(?: libpng)?"),
    ("boost", "boost", "boost software"),
    ("artistic", "artistic", "(?:perl )?artistic"),
    ("python", "python", "python software foundation"),
    ("php", "php", "php"),
    ("postgresql", "postgresql", "postgresql"),
    ("openssl", "openssl", "openssl"),
    ("ofl", "open font", "(?:sil )?open font"),
    ("ms-pl", "microsoft public", "microsoft public"),
    ("ms-rl", "microsoft reciprocal", "microsoft reciprocal"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "do what the", "do what the f[a-z]+ you want to public"),
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-sa", "by nc sa", "(?:cc|creative commons) by nc sa"),
    ("cc-by-nc-nd", "by nc nd", "(?:cc|creative commons) by nc nd"),
    ("cc-by-nc", "by nc", "(?:cc|creative commons) by nc"),
    ("cc-by-sa", "by sa", "(?:cc|creative commons) by sa"),
    ("cc-by-nd", "by nd", "(?:cc|creative commons) by nd"),
    ("cc-by", "cc by", "cc by"),
    ("cc", "creative commons", "creative commons(?: attribution)?(?: noncommercial| non commercial)?(?: share ?alike| no ?derivatives| no ?derivs)?"),
    ("odbl", "open database", "open database"),
    ("pddl", "public domain dedication", "public domain dedication(?: and)?"),
    ("ecl", "educational community", "educational community"),
    ("afl", "academic free", "academic free"),
    ("osl", "open software", "open software"),
    ("qpl", "q public", "q public"),
    ("sspl", "server side public", "server side public"),
    ("busl", "business source", "business source"),
    ("elastic", "elastic", "elastic"),
    ("proprietary", "proprietary", "proprietary"),
)
VERSION = r"(?: (?:version |v )?v?[0-9]+(?: [0-9]+)?)?(?: or (?:any )?later(?: version)?)?"
#: Name of the form, regex with {n} for the name, priority (1 best), weight.
FORMS = (
    ("identifier", "spdx licen[sc]e identifier (?:{n})" + VERSION, 1, 1.0),
    ("grant", "(?:licen[sc]ed|released|distributed|available|published|provided|covered|redistribut[a-z]+) (?:under|by) (?:the )?(?:terms of )?(?:the )?(?:{n})(?: licen[sc]e)?" + VERSION, 1, 1.0),
    ("title", "(?:{n}) licen[sc]e" + VERSION, 2, 0.8),
)
#: Label, keyword, regex, priority, weight: what the texts themselves say.
SIGNATURES = (
    ("mit", "free of charge", "permission is hereby granted free of charge to any person obtaining a copy of (?:this|the) software and associated documentation files", 1, 1.0),
    ("mit", "deal in the software", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicen[sc]e and or sell copies", 1, 1.0),
    ("mit", "substantial portions", "the above copyright notice and this permission notice (?:[a-z]+ ){0,8}shall be included in all copies or substantial portions of the software", 1, 0.9),
    ("mit", "express or implied including", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", 2, 0.7),
    ("mit", "opensource org", "opensource org licenses mit(?: license(?: php)?)?", 1, 0.9),
    ("x11", "other dealings", "shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authori[sz]ation", 1, 1.0),
    ("boost", "any person or", "permission is hereby granted free of charge to any person or organi[sz]ation obtaining a copy of the software and accompanying documentation covered by this license", 1, 1.0),
    ("boost", "machine executable object", "unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor", 1, 0.9),
    ("json", "good not evil", "the software shall be used for good not evil", 1, 1.0),
    ("bsd", "source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?", 1, 1.0),
    ("bsd", "redistributions of source code", "redistributions of source code must retain the (?:above )?copyright notice(?: this list of conditions)?(?: and the following disclaimer)?", 1, 0.9),
    ("bsd", "redistributions in binary form", "redistributions in binary form must reproduce the (?:above )?copyright notice(?: this list of conditions)?(?: and the following disclaimer)?", 1, 0.9),
    ("bsd-3-clause", "endorse or promote products", "neither the names? of (?:[^ ]+ ){1,12}may be used to endorse or promote products derived from this software without (?:specific )?prior written permission", 1, 1.0),
    ("bsd-4-clause", "all advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 1, 1.0),
    ("bsd", "copyright holders and contributors", "this software is provided by the copyright holders and contributors as is and any express or implied warranties", 2, 0.8),
    ("bsd", "regents and contributors", "this software is provided by the regents and contributors as is and any express or implied warranties", 2, 0.8),
    ("isc", "with or without fee", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", 1, 1.0),
    ("0bsd", "with or without fee", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted the software is provided as is", 1, 1.0),
    ("isc", "the author disclaims", "the software is provided as is and the author disclaims all warranties with regard to this software", 2, 0.6),
    ("hpnd", "and its documentation", "permission to use copy modify (?:and )?(?:distribute|sell) (?:and sell )?this software and its documentation for any purpose (?:and )?(?:with or )?without fee is hereby granted provided", 1, 1.0),
    ("postgresql", "written agreement", "for any purpose without fee and without a written agreement is hereby granted", 1, 1.0),
    ("zlib", "held liable", "in no event will the authors? be held liable for any damages arising from the use of this software", 1, 0.9),
    ("zlib", "altered source", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 1, 1.0),
    ("zlib", "must not be misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", 1, 1.0),
    ("libpng", "png reference library", "the png reference library is supplied as is", 1, 1.0),
    ("ijg", "independent jpeg", "based in part on the work of the independent jpeg group", 1, 0.9),
    ("apache-2.0", "in compliance with the license", "you may not use this file except in compliance with the license(?: you may obtain a copy of the license at)?", 1, 1.0),
    ("apache-2.0", "agreed to in writing", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 1, 1.0),
    ("apache-2.0", "january 2004", "apache license version 2 0 january 2004", 1, 1.0),
    ("apache-2.0", "apache org", "apache org licenses license 2 0(?: (?:txt|html))?", 1, 1.0),
    ("apache-2.0", "reproduction and distribution", "terms and conditions for use reproduction and distribution", 2, 0.7),
    ("apache-1.1", "developed by the apache", "this product includes software developed by the apache (?:software foundation|group)", 1, 0.8),
    ("gpl", "general public", "under the terms of (?:version [123] of )?the gnu general public license(?: version [123])? as published by the free software foundation", 1, 1.0),
    ("gpl", "free software you can redistribute", "(?:this program|[^ ]+) is free software you can redistribute it and or modify it under the terms of the gnu general public license", 1, 1.0),
    ("gpl", "hope that it will be useful", "is distributed in the hope that it will be useful but without any warranty(?: without even the implied warranty of merchantability or fitness for a particular purpose)?", 2, 0.7),
    ("gpl", "should have received", "you should have received a copy of the gnu general public license along with (?:this|the) (?:program|software|file|package|[^ ]+)", 1, 0.9),
    ("gpl", "take away your freedom", "the licenses for most software(?: and other practical works)? are designed to take away your freedom to share and change (?:it|the works)", 1, 1.0),
    ("gpl", "free copyleft", "the gnu general public license is a free copyleft license for software and other kinds of works", 1, 1.0),
    ("gpl-2.0", "general public", "gnu general public license (?:version |v )?2(?: 0)?(?: june 1991)?", 2, 0.9),
    ("gpl-3.0", "general public", "gnu general public license (?:version |v )?3(?: 0)?(?: 29 june 2007)?", 2, 0.9),
    ("gpl", "verbatim copies", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", 2, 0.8),
    ("gpl", "gnu org", "gnu org licenses (?:old licenses )?gpl(?: [23] 0)?(?: (?:txt|html))?", 1, 0.9),
    ("gpl", "linking", "as a special exception (?:[^ ]+ ){1,25}linking", 3, 0.5),
    ("lgpl", "free software you can redistribute", "is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", 1, 1.0),
    ("lgpl", "should have received", "you should have received a copy of the gnu (?:lesser|library) general public license along with", 1, 0.9),
    ("lgpl", "lesser general", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license", 1, 1.0),
    ("lgpl", "gnu org", "gnu org licenses (?:old licenses )?lgpl(?: [23] [01])?(?: (?:txt|html))?", 1, 0.9),
    ("agpl", "affero general public", "under the terms of the gnu affero general public license(?: version 3)?(?: as published by the free software foundation)?", 1, 1.0),
    ("agpl", "ensure cooperation", "specifically designed to ensure cooperation with the community in the case of network server software", 1, 1.0),
    ("agpl", "interacting with it remotely", "prominently offer all users interacting with it remotely through a computer network", 1, 0.9),
    ("fdl", "free documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 1, 1.0),
    ("fdl", "front cover texts", "with no invariant sections no front cover texts and no back cover texts", 1, 0.9),
    ("gnu-all-permissive", "royalty provided", "copying and distribution of this file with or without modification are permitted in any medium without royalty provided the copyright notice and this notice are preserved", 1, 1.0),
    ("mpl-2.0", "source code form", "this source code form is subject to the terms of the mozilla public license(?: v(?:ersion)? 2 0)?", 1, 1.0),
    ("mpl-2.0", "copy of the mpl", "if a copy of the mpl was not distributed with this file you can obtain one at", 1, 1.0),
    ("mpl-1.1", "mozilla public", "the contents of this file are subject to the mozilla public license version 1 [01]", 1, 1.0),
    ("epl", "accompanying materials", "this program and the accompanying materials are made available under the terms of the eclipse public license", 1, 1.0),
    ("epl", "eclipse org", "eclipse org (?:legal|org documents) epl v ?(?:10|20|[12] 0)", 1, 0.9),
    ("cddl", "common development", "the contents of this file are subject to the terms of the common development and distribution license", 1, 1.0),
    ("eupl", "eupl", "licen[sc]ed under the eupl(?: version)?(?: 1 [012])?", 1, 1.0),
    ("cecill", "cecill", "(?:governed by|subject to|under) the (?:terms of the )?cecill(?: [abc])? licen[sc]e", 1, 1.0),
    ("artistic", "package may be copied", "the intent of this document is to state the conditions under which a package may be copied", 1, 1.0),
    ("perl", "same terms as perl", "redistribute it and or modify it under the same terms as perl(?: 5)?(?: [^ ]+ [^ ]+ programming language system)?(?: itself)?", 1, 1.0),
    ("ruby", "verbatim copies", "you may make and give away verbatim copies of the source form of the software without restriction", 1, 1.0),
    ("python", "python software foundation", "this license agreement is between the python software foundation", 1, 1.0),
    ("php", "php license", "this source file is subject to version [23] [0-9]+ of the php license", 1, 1.0),
    ("openssl", "openssl", "this product includes software developed by the openssl project", 1, 0.9),
    ("ofl", "font software", "this font software is licensed under the sil open font license", 1, 1.0),
    ("ofl", "reserved font", "no modified version of the font software may use the reserved font names?", 1, 0.9),
    ("ms-pl", "accept this license", "this license governs use of the accompanying software if you use the software you accept this license", 1, 0.9),
    ("ncsa", "ncsa", "university of illinois ncsa open source license", 1, 1.0),
    ("w3c", "w3c", "w3c software (?:and document )?notice and license", 1, 1.0),
    ("unicode", "unicode", "unicode inc license agreement data files and software", 1, 1.0),
    ("vim", "charityware", "vim is charityware you can use and copy it as much as you like", 1, 1.0),
    ("beerware", "beer ware", "the beer ware license", 1, 1.0),
    ("beerware", "whatever you want with this stuff", "as long as you retain this notice you can do whatever you want with this stuff", 1, 1.0),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 1, 1.0),
    ("unlicense", "anyone is free", "anyone is free to copy modify publish use compile sell or distribute this software", 1, 1.0),
    ("wtfpl", "you want to", "(?:you just )?do what the f[a-z]+ you want to(?: public license)?", 1, 1.0),
    ("cc0", "dedicated the work", "has dedicated the work to the public domain by waiving all of (?:his or her|their) rights to the work", 1, 1.0),
    ("cc0", "related or neighboring rights", "has waived all copyright and related or neighboring rights to", 1, 1.0),
    ("cc0", "publicdomain zero", "creativecommons org publicdomain zero 1 0", 1, 1.0),
    ("cc-by", "creative commons attribution", "licensed under (?:a |the )?creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)? licen[sc]e", 1, 1.0),
    ("cc-by-sa", "creative commons attribution", "licensed under (?:a |the )?creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)? licen[sc]e", 1, 1.0),
    ("cc-by-nc", "creative commons attribution", "licensed under (?:a |the )?creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)? licen[sc]e", 1, 1.0),
    ("cc-by-nd", "creative commons attribution", "licensed under (?:a |the )?creative commons attribution no ?deriv(?:ative)?s?(?:works)?(?: [1-4] [05])?(?: international| unported| generic)? licen[sc]e", 1, 1.0),
    ("cc-by-nc-sa", "creative commons attribution", "licensed under (?:a |the )?creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported| generic)? licen[sc]e", 1, 1.0),
    ("cc-by-nc-nd", "creative commons attribution", "licensed under (?:a |the )?creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?:works)?(?: [1-4] [05])?(?: international| unported| generic)? licen[sc]e", 1, 1.0),
    ("cc-by", "licenses by", "creativecommons org licenses by(?: [1-4] [05])", 1, 1.0),
    ("cc-by-sa", "licenses by sa", "creativecommons org licenses by sa(?: [1-4] [05])?", 1, 1.0),
    ("cc-by-nc", "licenses by nc", "creativecommons org licenses by nc(?: [1-4] [05])", 1, 1.0),
    ("cc-by-nd", "licenses by nd", "creativecommons org licenses by nd(?: [1-4] [05])?", 1, 1.0),
    ("cc-by-nc-sa", "licenses by nc sa", "creativecommons org licenses by nc sa(?: [1-4] [05])?", 1, 1.0),
    ("cc-by-nc-nd", "licenses by nc nd", "creativecommons org licenses by nc nd(?: [1-4] [05])?", 1, 1.0),
    ("cc-by", "medium or format", "you are free to share copy and redistribute the material in any medium or format", 1, 0.8),
    ("cc-by", "appropriate credit", "you must give appropriate credit provide a link to the license and indicate if changes were made", 1, 0.9),
    ("cc-by-sa", "same license as the original", "you must distribute your contributions under the same license as the original", 1, 1.0),
    ("cc-by-nc", "commercial purposes", "you may not use the (?:material|work) for commercial purposes", 1, 0.9),
    ("cc-by-nd", "modified material", "you may not distribute the modified material", 1, 1.0),
    ("odbl", "open data commons", "open data commons open database licen[sc]e", 1, 1.0),
    ("sspl", "as a service", "make the functionality of the program or a modified version available to third parties as a service", 1, 1.0),
    ("busl", "non production use", "the right to copy modify create derivative works redistribute and make non production use of the licensed work", 1, 1.0),
    ("elastic", "hosted or managed", "you may not provide the software to third parties as a hosted or managed service", 1, 1.0),
    ("commons-clause", "right to sell", "the license does not grant to you the right to sell the software", 1, 1.0),
    ("public-domain", "public domain", "(?:released|placed|dedicated|donated|put)(?: [a-z]+){0,3} (?:in|into|to) the public domain|is in the public domain", 2, 0.7),
    ("proprietary", "strictly prohibited", "unauthori[sz]ed (?:copying|use|distribution|reproduction) (?:[^ ]+ ){0,12}is strictly prohibited", 1, 0.9),
    ("proprietary", "confidential and proprietary", "is (?:the )?confidential and proprietary(?: information)? (?:of|to)", 1, 0.9),
    ("proprietary", "may be reproduced", "no part of this (?:publication|book|work|document|website|site) may be reproduced", 1, 0.8),
    ("proprietary", "not sold", "(?:software|product|work) is licensed not sold", 1, 0.9),
    ("proprietary", "user license agreement", "end user license agreement", 2, 0.7),
    ("all-rights-reserved", "all rights reserved", "all rights reserved", 3, 0.3),
)
#: No rule can match a text without one of these.
GATE = "licen[sc]|software|distribut|released|available|published|provided|covered|public|rights|cop(?:ies|ied|ying)|proprietary|commercial|notice|agreement|supplied|linking|remotely|invariant|eclipse|charityware|what the f|prohibited|reproduced|jpeg"
#: What stands between words.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_ON, _OFF = "\x01", "\x02"


@cache
def rules() -> tuple[tuple[str, str, str, int, float], ...]:
    """(label, keyword, regex, priority, weight) in order; the base phrases come first."""
    own = [(label, phrase, phrase, 2, 0.8) for phrase, label in BASE]
    made = [(label, word, form.format(n=name), priority, weight) for _, form, priority, weight in FORMS for label, word, name in FAMILIES]
    return (*own, *SIGNATURES, *made)


def _places(norm: Column, regex: Column) -> Column:
    """array<struct<start, end>> in words of the matches in ' w0 w1 ... '."""
    marked = F.regexp_replace(norm, F.concat(F.lit("(?<= )(?:"), regex, F.lit(")(?= )")), F.lit(f"{_ON}$0{_OFF}"))

    def spans(words: Column) -> Column:
        numbered = F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
        starts = F.transform(F.filter(numbered, lambda x: x.w.startswith(_ON)), lambda x: x.i - 1)
        ends = F.transform(F.filter(numbered, lambda x: x.w.endswith(_OFF)), lambda x: x.i)
        return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), e.alias("end")))

    return F.when(F.instr(marked, _ON) > 0, let(F.split(marked, " "), spans)).otherwise(F.expr("cast(array() as array<struct<start:int,end:int>>)"))


def _scan(norm: Column) -> Column:
    table = F.array(*(F.struct(F.lit(i).alias("order"), F.lit(a).alias("label"), F.lit(f" {k} ").alias("keyword"), F.lit(r).alias("regex"), F.lit(p).alias("priority"), F.lit(w).alias("weight")) for i, (a, k, r, p, w) in enumerate(rules())))
    hit = lambda r: F.transform(_places(norm, r.regex), lambda s: F.struct(s.start.alias("start"), (-s.end).alias("minus_end"), r.priority.alias("priority"), r.order.alias("order"), r.label.alias("label"), r.weight.alias("weight")))
    return F.array_sort(F.flatten(F.transform(F.filter(table, lambda r: F.contains(norm, r.keyword)), hit)))


_SPAN = "struct<start:int,minus_end:int,priority:int,order:int,label:string,weight:double>"


def _suppress(found: Column) -> Column:
    """Detections in order of start, longest first: one is contained if an end reached before, at its priority or better, is as far."""
    start = F.struct(*(F.lit(-1).alias(f"m{p}") for p in (1, 2, 3)), F.expr(f"cast(array() as array<{_SPAN}>)").alias("kept"))

    def step(acc: Column, d: Column) -> Column:
        reached = lambda p: reduce(F.greatest, [acc[f"m{q}"] for q in range(1, p + 1)]) if p > 1 else acc.m1
        inside = F.when(d.priority == 1, reached(1)).when(d.priority == 2, reached(2)).otherwise(reached(3)) >= -d.minus_end
        far = lambda p: F.when(d.priority == p, F.greatest(acc[f"m{p}"], -d.minus_end)).otherwise(acc[f"m{p}"]).alias(f"m{p}")
        return F.struct(far(1), far(2), far(3), F.when(inside, acc.kept).otherwise(F.concat(acc.kept, F.array(d))).alias("kept"))

    return F.aggregate(found, start, step, lambda acc: acc.kept)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base array<struct<start, label>>, detections array<struct<start, end, label, priority, weight>>."""
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), BREAK, " "))
    n_words = lambda w: F.when(w == "", F.lit(0)).otherwise(F.length(w) - F.length(F.replace(w, F.lit(" "), F.lit(""))) + 1)
    gated = lambda w: F.when(w.rlike(f"(?i){GATE}"), F.concat(F.lit(" "), lower_ascii(w), F.lit(" ")))
    head = docs.select("doc_id", let(words, lambda w: F.struct(n_words(w).cast("long").alias("n_words"), gated(w).alias("norm"))).alias("w"))
    found = F.when(F.col("w.norm").isNotNull(), let(F.col("w.norm"), _scan)).otherwise(F.expr(f"cast(array() as array<{_SPAN}>)"))
    base = lambda f: F.transform(F.filter(f, lambda d: d.order < len(BASE)), lambda d: F.struct(d.start.cast("long").alias("start"), d.label.alias("label")))
    kept = lambda f: F.transform(_suppress(f), lambda d: F.struct(d.start.cast("long").alias("start"), (-d.minus_end).cast("long").alias("end"), d.label.alias("label"), d.priority.alias("priority"), d.weight.alias("weight")))
    both = let(found, lambda f: F.struct(base(f).alias("base"), kept(f).alias("detections")))
    return head.select("doc_id", F.col("w.n_words").alias("n_words"), both.alias("d")).select("doc_id", "n_words", "d.base", "d.detections")


def license_digest(scanned: DataFrame) -> DataFrame:
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    starts = F.transform("base", lambda b: b.start)
    labels = F.transform("base", lambda b: b.label)
    return scanned.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(labels).alias("base_labels"), joined(F.concat(labels, F.transform("detections", lambda d: d.label))).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d.weight)), F.lit(0.0)).alias("score"), F.size("detections").cast("long").alias("n_detections"),
    )
