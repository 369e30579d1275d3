"""Operator 6: license scans by ordered signature rules, in built-in functions only."""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER

#: ASCII characters that are no part of a word.
GAPS = "".join(chr(c) for c in range(128) if not re.match("[0-9A-Za-z]", chr(c)))
GAP_REGEX = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
BASE_REGEX = "(?<= )(?:" + "|".join(p.replace(" ", " +") for p in BASE) + ")(?= )"

#: Hand-written names: label, keyword, and the name as it is written in words (a regex over lower-case words).
NAMES = [
    ("apache-1.1", "apache", r"apache (?:software )?(?:licen[cs]e )?(?:version |v)?1 1"),
    ("apache-2.0", "apache", r"apache (?:software )?(?:licen[cs]e )?(?:version |v)?2(?: 0)?"),
    ("artistic-1.0", "artistic", r"artistic (?:licen[cs]e )?(?:version |v)?1 0"),
    ("artistic-2.0", "artistic", r"artistic (?:licen[cs]e )?(?:version |v)?2 0"),
    ("agpl-3.0", "agpl", r"agpl ?(?:version |v)?3(?: 0)?"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public licen[cs]e (?:version |v)?3(?: 0)?"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd)"),
    ("bsd-3-clause", "bsd", r"(?:(?:new|revised|modified) bsd|bsd 3 clause|3 clause bsd|three clause bsd)"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)"),
    ("bsl-1.0", "boost", r"boost software licen[cs]e (?:version )?1 0"),
    ("busl-1.1", "business", r"business source licen[cs]e (?:version )?1 1"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-2.0", "cc", r"cc by 2 0"),
    ("cc-by-3.0", "cc", r"cc by 3 0"),
    ("cc-by-4.0", "cc", r"cc by 4 0"),
    ("cc-by-sa-3.0", "cc", r"cc by sa 3 0"),
    ("cc-by-sa-4.0", "cc", r"cc by sa 4 0"),
    ("cc-by-nc-4.0", "cc", r"cc by nc 4 0"),
    ("cc-by-nd-4.0", "cc", r"cc by nd 4 0"),
    ("cc-by-nc-sa-4.0", "cc", r"cc by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "cc", r"cc by nc nd 4 0"),
    ("cc-by-4.0", "creative", r"creative commons attribution 4 0(?: international)?"),
    ("cc-by-sa-4.0", "creative", r"creative commons attribution share ?alike 4 0(?: international)?"),
    ("cc-by-nc-4.0", "creative", r"creative commons attribution non ?commercial 4 0(?: international)?"),
    ("cddl-1.0", "cddl", r"cddl (?:version )?1 0"),
    ("cddl-1.1", "cddl", r"cddl (?:version )?1 1"),
    ("cecill-2.1", "cecill", r"cecill (?:version )?2 1"),
    ("ecl-2.0", "educational", r"educational community licen[cs]e (?:version )?2 0"),
    ("epl-1.0", "eclipse", r"eclipse public licen[cs]e (?:version |v)?1 0"),
    ("epl-2.0", "eclipse", r"eclipse public licen[cs]e (?:version |v)?2 0"),
    ("eupl-1.2", "eupl", r"eupl (?:version |v)?1 2"),
    ("gpl-2.0", "gpl", r"gpl ?(?:version |v)?2(?: 0)?"),
    ("gpl-3.0", "gpl", r"gpl ?(?:version |v)?3(?: 0)?"),
    ("gpl-2.0", "general", r"general public licen[cs]e (?:version |v)?2(?: 0)?"),
    ("gpl-3.0", "general", r"general public licen[cs]e (?:version |v)?3(?: 0)?"),
    ("isc", "isc", r"isc"),
    ("lgpl-2.1", "lgpl", r"lgpl ?(?:version |v)?2 1"),
    ("lgpl-3.0", "lgpl", r"lgpl ?(?:version |v)?3(?: 0)?"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public licen[cs]e (?:version |v)?2 1"),
    ("lgpl-3.0", "lesser", r"(?:gnu )?lesser general public licen[cs]e (?:version |v)?3(?: 0)?"),
    ("lppl-1.3c", "latex", r"latex project public licen[cs]e(?: (?:version )?1 3c)?"),
    ("mit", "mit", r"mit"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e (?:version |v)?1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[cs]e (?:version |v)?2 0"),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e"),
    ("odbl-1.0", "odbl", r"odbl(?: 1 0)?"),
    ("ofl-1.1", "sil", r"sil open font licen[cs]e(?: (?:version )?1 1)?"),
    ("postgresql", "postgresql", r"postgresql"),
    ("python-2.0", "python", r"python(?: software foundation)?(?: 2 0)?"),
    ("unlicense", "unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("zlib", "zlib", r"zlib"),
]
#: Hand-written ways a license is named: priority (smaller wins), score, second keyword, and the wording around the name.
FORMS = [
    (1, 1.0, "spdx", "spdx license identifier {}"),
    (2, 0.9, " under ", "(?:licensed|released|distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the )?{}(?: licen[cs]e)?"),
    (3, 0.8, "licen", "licen[cs]e (?:is )?(?:the )?{}(?: licen[cs]e)?"),
    (4, 0.6, "licen", "{} licen[cs](?:e|ed|ing)"),
]
#: Hand-written signatures of license texts and notices: priority, score, label, keyword, regex.
TEXTS = [
    # grants, conditions and disclaimers as the licenses word them
    (1, 1.0, "mit", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy"),
    (1, 1.0, "mit", "substantial", r"this permission notice shall be included in all copies or substantial portions of the software"),
    (1, 1.0, "mit", "restriction", r"deal in the software without restriction including without limitation the rights to use"),
    (1, 1.0, "x11", "consortium", r"name of the x consortium shall not be used in advertising"),
    (1, 1.0, "isc", "hereby", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    (1, 1.0, "isc", "sublicense", r"permission to use copy modify sublicense and or distribute this software for any purpose"),
    (1, 1.0, "hpnd", "hereby", r"permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted"),
    (1, 1.0, "bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    (1, 1.0, "bsd", "redistributions", r"redistributions of source code must retain the (?:above )?copyright notice"),
    (1, 1.0, "bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice"),
    (1, 1.0, "bsd-3-clause", "endorse", r"nor the names of (?:its|the) contributors may be used to endorse or promote products"),
    (1, 1.0, "bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    (1, 1.0, "apache-2.0", "apache", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    (1, 1.0, "apache-2.0", "apache", r"apache license version 2 0 january 2004"),
    (1, 1.0, "apache-2.0", "applicable", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    (1, 1.0, "apache-1.1", "apache", r"this product includes software developed by the apache software foundation"),
    (1, 1.0, "gpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    (1, 1.0, "lgpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e"),
    (1, 1.0, "agpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e"),
    (1, 1.0, "gpl", "received", r"you should have received a copy of the gnu general public licen[cs]e"),
    (1, 1.0, "lgpl", "received", r"you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e"),
    (1, 1.0, "agpl", "received", r"you should have received a copy of the gnu affero general public licen[cs]e"),
    (1, 1.0, "gpl-2.0-or-later", "either", r"general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e or at your option any later version"),
    (1, 1.0, "gpl-3.0-or-later", "either", r"general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version"),
    (1, 1.0, "lgpl-2.1-or-later", "either", r"general public licen[cs]e as published by the free software foundation either version 2 1 of the licen[cs]e or at your option any later version"),
    (1, 1.0, "gpl", "copyleft", r"the gnu general public licen[cs]e is a free copyleft licen[cs]e"),
    (1, 1.0, "gpl", "everyone", r"everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document"),
    (1, 1.0, "classpath-exception", "statically", r"linking this library statically or dynamically with other modules"),
    (1, 1.0, "gfdl", "invariant", r"with no invariant sections"),
    (1, 1.0, "mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0"),
    (1, 1.0, "mpl-1.1", "mozilla", r"contents of this file are subject to the mozilla public licen[cs]e version 1 1"),
    (1, 1.0, "npl-1.1", "netscape", r"contents of this file are subject to the netscape public licen[cs]e"),
    (1, 1.0, "epl", "eclipse", r"accompanying materials are made available under the terms of the eclipse public licen[cs]e"),
    (1, 1.0, "cddl", "distribution", r"subject to the terms of the common development and distribution licen[cs]e"),
    (1, 1.0, "zlib", "altered", r"altered source versions must be plainly marked as such"),
    (1, 1.0, "zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    (1, 1.0, "bsl-1.0", "boost", r"boost software licen[cs]e version 1 0 august 17(?:th)? 2003"),
    (1, 1.0, "unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    (1, 1.0, "wtfpl", "fuck", r"do what the fuck you want to public licen[cs]e"),
    (1, 1.0, "json", "evil", r"the software shall be used for good not evil"),
    (1, 1.0, "beerware", "beer", r"the beer ?ware licen[cs]e"),
    (1, 1.0, "perl", "perl", r"(?:under the )?same terms as perl itself"),
    (1, 1.0, "ruby", "ruby", r"same terms as ruby(?: itself)?"),
    (1, 1.0, "ofl-1.1", "font", r"this font software is licensed under the sil open font licen[cs]e"),
    (1, 1.0, "openssl", "openssl", r"this product includes software developed by the openssl project"),
    (1, 1.0, "busl-1.1", "licensor", r"(?:the )?licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use"),
    (1, 1.0, "commons-clause", "clause", r"commons clause licen[cs]e condition"),
    # names in full
    (2, 0.9, "gpl", "gnu", r"gnu general public licen[cs]e"),
    (2, 0.9, "lgpl", "gnu", r"gnu (?:lesser|library) general public licen[cs]e"),
    (2, 0.9, "agpl", "gnu", r"gnu affero general public licen[cs]e"),
    (2, 0.9, "gfdl", "gnu", r"gnu free documentation licen[cs]e"),
    (2, 0.9, "cc", "creative", r"creative commons licen[cs]e"),
    (2, 0.9, "cc0-1.0", "creative", r"creative commons zero"),
    (2, 0.9, "cc-by", "creative", r"creative commons attribution"),
    (2, 0.9, "cc-by-sa", "creative", r"creative commons attribution share ?alike"),
    (2, 0.9, "cc-by-nc", "creative", r"creative commons attribution non ?commercial"),
    (2, 0.9, "cc-by-nd", "creative", r"creative commons attribution no ?deriv(?:s|atives|ative works)"),
    (2, 0.9, "cc-by-nc-sa", "creative", r"creative commons attribution non ?commercial share ?alike"),
    (2, 0.9, "cc-by-nc-nd", "creative", r"creative commons attribution non ?commercial no ?deriv(?:s|atives|ative works)"),
    (2, 0.9, "cc-by", "creativecommons", r"creativecommons org licenses by"),
    (2, 0.9, "cc-by-sa", "creativecommons", r"creativecommons org licenses by sa"),
    (2, 0.9, "cc-by-nc", "creativecommons", r"creativecommons org licenses by nc"),
    (2, 0.9, "cc-by-nd", "creativecommons", r"creativecommons org licenses by nd"),
    (2, 0.9, "cc-by-nc-sa", "creativecommons", r"creativecommons org licenses by nc sa"),
    (2, 0.9, "cc-by-nc-nd", "creativecommons", r"creativecommons org licenses by nc nd"),
    (2, 0.9, "cc0-1.0", "creativecommons", r"creativecommons org publicdomain zero"),
    (2, 0.9, "public-domain", "creativecommons", r"creativecommons org publicdomain mark"),
    (2, 0.9, "apache-2.0", "apache", r"apache org licenses license 2 0"),
    (2, 0.9, "mit", "opensource", r"opensource org licenses mit"),
    (2, 0.9, "bsd", "opensource", r"opensource org licenses bsd"),
    (2, 0.9, "gpl", "gnu", r"gnu org licenses gpl"),
    (2, 0.9, "lgpl", "gnu", r"gnu org licenses lgpl"),
    (2, 0.9, "agpl", "gnu", r"gnu org licenses agpl"),
    (2, 0.9, "gfdl", "gnu", r"gnu org licenses fdl"),
    (2, 0.9, "mpl-2.0", "mozilla", r"mozilla org (?:en us )?mpl 2 0"),
    (2, 0.9, "epl", "eclipse", r"eclipse org legal epl"),
    (2, 0.9, "edl", "eclipse", r"eclipse distribution licen[cs]e"),
    (2, 0.9, "bsl-1.0", "boost", r"boost org licen[cs]e 1 0"),
    (2, 0.9, "unlicense", "unlicense", r"unlicense org"),
    (2, 0.9, "cddl", "distribution", r"common development and distribution licen[cs]e"),
    (2, 0.9, "cpl-1.0", "common", r"common public licen[cs]e(?: version)? 1 0"),
    (2, 0.9, "cpal-1.0", "common", r"common public attribution licen[cs]e"),
    (2, 0.9, "ipl-1.0", "ibm", r"ibm public licen[cs]e"),
    (2, 0.9, "npl", "netscape", r"netscape public licen[cs]e"),
    (2, 0.9, "spl", "sun", r"sun public licen[cs]e"),
    (2, 0.9, "apsl", "apple", r"apple public source licen[cs]e"),
    (2, 0.9, "ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e"),
    (2, 0.9, "osl", "open", r"open software licen[cs]e(?: version| v)? 3 0"),
    (2, 0.9, "afl", "academic", r"academic free licen[cs]e"),
    (2, 0.9, "artistic", "artistic", r"(?:perl|clarified) artistic licen[cs]e"),
    (2, 0.9, "php", "php", r"php licen[cs]e(?: version| v)? 3"),
    (2, 0.9, "psf", "psf", r"psf licen[cs]e"),
    (2, 0.9, "ncsa", "ncsa", r"(?:university of illinois )?ncsa open source licen[cs]e"),
    (2, 0.9, "openldap", "openldap", r"openldap public licen[cs]e"),
    (2, 0.9, "qpl", "public", r"q public licen[cs]e"),
    (2, 0.9, "zpl", "zope", r"zope public licen[cs]e"),
    (2, 0.9, "sleepycat", "sleepycat", r"sleepycat (?:public )?licen[cs]e"),
    (2, 0.9, "vim", "vim", r"vim licen[cs]e"),
    (2, 0.9, "w3c", "w3c", r"w3c software (?:notice and|and document) licen[cs]e"),
    (2, 0.9, "libpng", "libpng", r"libpng licen[cs]e"),
    (2, 0.9, "ftl", "freetype", r"freetype (?:project )?licen[cs]e"),
    (2, 0.9, "curl", "curl", r"curl licen[cs]e"),
    (2, 0.9, "unicode", "unicode", r"unicode (?:terms of use|licen[cs]e)"),
    (2, 0.9, "upl-1.0", "universal", r"universal permissive licen[cs]e"),
    (2, 0.9, "mulan", "mulan", r"mulan (?:permissive software|psl|public) licen[cs]e"),
    (2, 0.9, "blueoak", "oak", r"blue oak model licen[cs]e"),
    (2, 0.9, "rpl", "reciprocal", r"reciprocal public licen[cs]e"),
    (2, 0.9, "eupl", "european", r"european union public licen[cs]e"),
    (2, 0.9, "cecill", "cecill", r"cecill (?:b |c )?(?:free software )?licen[cs]e"),
    (2, 0.9, "sspl-1.0", "server", r"server side public licen[cs]e"),
    (2, 0.9, "elastic-2.0", "elastic", r"elastic licen[cs]e(?: version)? 2 0"),
    (2, 0.9, "polyform", "polyform", r"polyform (?:noncommercial|small business|strict|shield) licen[cs]e"),
    (2, 0.9, "hippocratic", "hippocratic", r"hippocratic licen[cs]e"),
    (2, 0.9, "openrail", "openrail", r"openrail(?: m)? licen[cs]e"),
    (2, 0.9, "nasa-1.3", "nasa", r"nasa open source agreement"),
    (2, 0.9, "ofl-1.1", "font", r"sil open font licen[cs]e"),
    (2, 0.9, "ufl", "font", r"ubuntu font licen[cs]e"),
    (2, 0.9, "odc-by", "commons", r"open data commons attribution licen[cs]e"),
    (2, 0.9, "odbl-1.0", "database", r"open database licen[cs]e"),
    (2, 0.9, "pddl-1.0", "dedication", r"public domain dedication and licen[cs]e"),
    (2, 0.9, "cdla-permissive", "community", r"community data licen[cs]e agreement permissive"),
    (2, 0.9, "cdla-sharing", "community", r"community data licen[cs]e agreement sharing"),
    (2, 0.9, "ogl", "government", r"open government licen[cs]e"),
    (2, 0.9, "etalab-2.0", "etalab", r"etalab (?:open )?licen[cs]e"),
    (2, 0.9, "public-domain", "domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    # notices
    (3, 0.7, "public-domain", "domain", r"public domain"),
    (3, 0.7, "reserved", "reserved", r"all rights reserved"),
    (3, 0.7, "some-reserved", "reserved", r"some rights reserved"),
    (3, 0.7, "public-domain", "reserved", r"no rights reserved"),
    (3, 0.7, "copyright", "copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}"),
    (3, 0.7, "crown-copyright", "crown", r"crown copyright"),
    (3, 0.7, "reserved", "reproduced", r"no part of this (?:publication|book|document|work) may be reproduced"),
    (3, 0.7, "reserved", "prohibited", r"unauthori[sz]ed (?:copying|use|reproduction|distribution) (?:of this file )?(?:is )?(?:strictly )?prohibited"),
    (3, 0.7, "non-commercial", "only", r"for (?:personal|non ?commercial|educational|research) use only"),
    (3, 0.7, "eula", "end", r"end user licen[cs]e agreement"),
    (3, 0.7, "dual", "dual", r"dual licen[cs]ed"),
    (3, 0.7, "open-source", "source", r"(?:under|with) an open source licen[cs]e"),
    (4, 0.5, "copyright", "copyright", r"copyright"),
    (4, 0.5, "copyright", "copyrighted", r"copyrighted (?:material|work|by)"),
    (4, 0.5, "permission", "permission", r"(?:used|reproduced|reprinted) (?:by|with) permission"),
    (4, 0.5, "proprietary", "proprietary", r"proprietary and confidential"),
    (4, 0.5, "proprietary", "proprietary", r"confidential and proprietary"),
    (4, 0.5, "proprietary", "trade", r"(?:contains|constitutes) trade secrets"),
    (4, 0.5, "proprietary", "internal", r"for internal use only"),
    (4, 0.4, "warranty", "warranty", r"without (?:any )?warranty of any kind"),
    (4, 0.4, "warranty", "warranty", r"without (?:even the|any) implied warranty"),
    (4, 0.4, "warranty", "warranties", r"without warranties or conditions of any kind"),
    (4, 0.4, "warranty", "liable", r"in no event (?:shall|will) the (?:authors?|copyright holders?)(?: or copyright holders?)? be (?:held )?liable"),
]
LEVELS = (1, 2, 3, 4)


def rules() -> list[tuple[int, int, float, str, str, str, str]]:
    """All rules in order: number, priority, score, label, keyword, second keyword, regex over words with single spaces.

    A rule's matches all hold its keyword at the start of a word, and the second anywhere.
    """
    named = [(p, s, label, word, more, form.format(name)) for (label, word, name), (p, s, more, form) in product(NAMES, FORMS)]
    # what is left of a regex without its groups is in every match
    sure = lambda regex: "licen" if "licen" in re.sub(r"\((?:[^()]|\([^()]*\))*\)\??", "", regex) else ""
    texts = [(p, s, label, word, sure(regex), regex) for p, s, label, word, regex in TEXTS]
    ordered = sorted([*texts, *named], key=lambda r: r[0])
    # of keywords that begin another the shortest does for both, so at most one stands at a place
    words = {r[3] for r in ordered}
    ordered = [(*r[:3], min((w for w in words if r[3].startswith(w)), key=len), *r[4:]) for r in ordered]
    return [(i, p, s, label, word, more, f"(?<= ){regex}(?= )") for i, (p, s, label, word, more, regex) in enumerate(ordered)]


def keyword_regex(table: list[tuple]) -> str:
    """All keywords at the start of a word, by their first letters, in one expression."""
    by_first: dict[str, list[str]] = {}
    for word in sorted({r[4] for r in table}):
        by_first.setdefault(word[0], []).append(word[1:])
    return "(?<= )(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by_first.items()) + ")"


def rule_table(spark: SparkSession) -> DataFrame:
    schema = "rule int, priority int, weight double, label string, keyword string, more string, regex string"
    return spark.createDataFrame(rules(), schema)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """License phrases, labels and a score for every whole text.

    Base places: the phrases of ``BASE`` as consecutive words.  Rules: a text is
    tried with the rules whose keyword begins one of its words and whose second
    keyword it holds, and every match is a detection.  Each rule's regex implies
    both, so no match is lost to them.  A detection is suppressed if it
    lies within one of smaller or equal priority number that starts earlier, or at the
    same word and is longer, or, for the same words, comes first in the rules.  Labels are the
    base labels and those of the detections left.  ``score`` is the largest score
    of these, 0.5 for base places alone, else 0.

    The rules (a few hundred, whatever the input) are broadcast; texts go through
    no shuffle, detections do, as single rows.  Returns one row per input row:
    ``doc_id``, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``,
    ``labels``, ``score``.  A null text counts as empty; rows with a null ``doc_id`` keep
    their own results; repeated rows each get theirs.  An empty table gives no rows;
    other columns are ignored.
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    words = F.concat(F.lit(" "), F.translate(text, UPPER + GAPS, LOWER + " " * len(GAPS)), F.lit(" "))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), words.alias("w"))

    label = "CASE substr(m, 1, 1) " + " ".join(f"WHEN '{p[0]}' THEN '{x}'" for p, x in BASE.items()) + " END"
    base = (
        rows.select("doc_id", "h", "w", F.regexp_count("w", F.lit("[^ ]+")).cast("long").alias("n_words"))
        .withColumn("found", F.regexp_extract_all("w", F.lit(BASE_REGEX), F.lit(0)))
        .withColumn("n_base", F.size("found").cast("long"))
        .select(
            "doc_id",
            "h",
            "n_words",
            "n_base",
            F.when(
                F.col("n_base") > 0,
                F.regexp_count(F.expr(f"substring(w, 1, regexp_instr(w, '{BASE_REGEX}') - 1)"), F.lit("[^ ]+")),
            ).cast("long").alias("first_word"),
            F.when(
                F.col("n_base") > 0,
                F.col("n_words")
                - F.regexp_count(F.element_at(F.split("w", BASE_REGEX, -1), -1), F.lit("[^ ]+"))
                - F.regexp_count(F.element_at("found", -1), F.lit("[^ ]+")),
            ).cast("long").alias("last_word"),
            F.expr(f"array_distinct(transform(found, m -> {label}))").alias("base"),
        )
    )

    table = rules()
    seconds = [F.when(F.contains("w", F.lit(k)), F.lit(k)) for k in sorted({r[5] for r in table} - {""})]
    even = F.concat(F.lit(" "), F.regexp_replace(F.translate(text, UPPER, LOWER), GAP_REGEX, " "), F.lit(" "))
    tried = (
        docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), even.alias("w"))
        .select("doc_id", "h", "w", F.explode(F.array_distinct(F.regexp_extract_all("w", F.lit(keyword_regex(table)), F.lit(0)))).alias("keyword"))
        .withColumn("mores", F.array_compact(F.array(F.lit(""), *seconds)))
        .join(F.broadcast(rule_table(docs.sparkSession)), "keyword")
        .where(F.expr("array_contains(mores, more)"))
    )
    hits = tried.withColumn("found", F.expr("regexp_extract_all(w, regex, 0)")).where("size(found) > 0")
    parts = hits.select(
        "doc_id", "h", "rule", "priority", "weight", "label",
        F.posexplode(F.arrays_zip("found", F.split("w", F.col("regex"), -1).alias("gap"))).alias("nth", "part"),
    ).where("part.found IS NOT NULL")
    along = Window.partitionBy("doc_id", "h", "rule").orderBy("nth")
    spans = (
        parts.withColumn("end", F.sum(F.expr("length(part.found) + length(part.gap)")).over(along))
        .withColumn("start", F.expr("end - length(part.found)"))
        .select("doc_id", "h", "rule", "priority", "weight", "label", "start", "end")
        .distinct()
    )
    before = (
        Window.partitionBy("doc_id", "h")
        .orderBy("start", F.desc("end"), "priority", "rule")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    reach = {f"p{p}": F.max(F.when(F.col("priority") <= p, F.col("end"))).over(before) for p in LEVELS}
    covered = F.coalesce(F.expr(f"CASE priority {' '.join(f'WHEN {p} THEN p{p}' for p in LEVELS)} END >= end"), F.lit(False))
    left = spans.withColumns(reach).where(~covered)
    told = left.groupBy("doc_id", "h").agg(F.collect_set("label").alias("more"), F.max("weight").alias("weight"))

    same = base["doc_id"].eqNullSafe(told["doc_id"]) & (base["h"] == told["h"])
    out = base.join(told, same, "left").select(base["*"], "more", "weight")
    none = F.array().cast("array<string>")
    join = lambda a: F.concat_ws(",", F.sort_array(a))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        join(F.col("base")).alias("base_labels"),
        join(F.array_union("base", F.coalesce("more", none))).alias("labels"),
        F.greatest(F.coalesce("weight", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)).alias("score"),
    )


def scan_sql() -> str:
    """The definition, every rule tried on every text: words stand between two spaces, so neighbouring matches don't meet."""

    def spaced(regex: str) -> str:
        inner = regex.removeprefix("(?<= )").removesuffix("(?= )")
        return " " + inner.replace(" ?", "\0").replace(" ", "  ").replace("\0", "(?:  )?") + " "

    table = ", ".join(f"({i}, {p}, {s}::DOUBLE, '{label}', '{spaced(regex)}')" for i, p, s, label, _, _, regex in rules())
    phrase = lambda p: " AND ".join(f"words[n + {k}] = '{w}'" for k, w in enumerate(p.split(), 1))
    base = " ".join(f"WHEN {phrase(p)} THEN '{label}'" for p, label in BASE.items())
    return f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{GAP_REGEX}'), lambda x: x <> '') AS words FROM documents),
w AS (SELECT doc_id, words, ' ' || array_to_string(words, '  ') || ' ' AS w FROM d),
rules(rule, priority, weight, label, regex) AS (VALUES {table}),
b AS (SELECT doc_id, n, CASE {base} END AS label FROM (SELECT doc_id, words, unnest(range(len(words))) AS n FROM d)),
places AS (SELECT doc_id, count(*) AS n_base, min(n) AS first_word, max(n) AS last_word, list(DISTINCT label) AS base FROM b WHERE label IS NOT NULL GROUP BY 1),
m AS (SELECT doc_id, rule, priority, weight, label, regexp_extract_all(w, regex) AS found, string_split_regex(w, regex) AS gaps FROM w, rules WHERE regexp_matches(w, regex)),
s AS (SELECT *, unnest(range(1, len(found) + 1)) AS nth FROM m),
spans AS (SELECT doc_id, rule, priority, weight, label, CAST(list_sum(list_transform(gaps[1:nth], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:nth - 1], lambda x: length(x))), 0) AS BIGINT) AS a, length(found[nth]) AS size FROM s),
e AS (SELECT *, a + size AS z FROM spans),
kept AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM e o WHERE o.doc_id = e.doc_id AND o.a <= e.a AND o.z >= e.z AND o.priority <= e.priority AND (o.a, -o.z, o.priority, o.rule) < (e.a, -e.z, e.priority, e.rule))),
told AS (SELECT doc_id, list(DISTINCT label) AS more, max(weight) AS weight FROM kept GROUP BY 1)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, coalesce(p.n_base, 0) AS n_base, p.first_word, p.last_word, coalesce(array_to_string(list_sort(p.base), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(p.base, t.more))), ','), '') AS labels, greatest(coalesce(t.weight, 0), CASE WHEN p.n_base > 0 THEN 0.5 ELSE 0 END)::DOUBLE AS score
FROM d LEFT JOIN places p USING (doc_id) LEFT JOIN told t USING (doc_id)
"""


SQL = scan_sql()
