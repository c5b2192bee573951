"""Operator 5: licence scans by sentence identifiers and ordered rules; DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, read

#: Verbs of a notice; what is denied ("is not licensed under") is no notice.
UNDER = r"(?<!not )(?<!never )(?<!longer )(?<!with a work )\b(?:(?:re|dual )?licen[cs]ed|released|(?:re)?distributed|available|provided|published|covered|governed|subject)(?: to you)? (?:under|by|to) (?:either )?(?:the )?(?:terms (?:and conditions )?of )?(?:either )?(?:the |an? )?"
END = r"(?= |$)"
GPL, LGPL, AGPL = (rf"(?:gnu )?(?:{name})" for name in (r"general public licen[cs]e(?: gpl)?|gpl", r"(?:lesser|library) general public licen[cs]e(?: lgpl)?|lgpl", r"affero general public licen[cs]e(?: agpl)?|agpl"))


def _gnu(name: str, version: str) -> str:
    """A GNU licence of a version, the number behind or before the name."""
    v = version.replace(".", " ")
    v = v if " " in v else rf"{v}(?: 0)?(?! \d)"
    return rf"(?:{name})(?: as published by the free software foundation)? ?(?:version |v ?)?{v}{END}|version {v} of the (?:{name})"


#: A licence, how a notice names it (regex over a sentence in normal form), and its SPDX identifier in normal form.
NAMES = (
    ("MIT", r"(?:x11 )?mit(?: expat| x11)? licen[cs]e|expat licen[cs]e|mit$", r"mit"),
    ("Apache-2.0", rf"apache(?: software)?(?: licen[cs]e)? (?:version |v ?)?2(?: 0)?{END}", r"apache 2 0"),
    ("GPL-2.0", _gnu(GPL, "2"), r"gpl 2 0"),
    ("GPL-3.0", _gnu(GPL, "3"), r"gpl 3 0"),
    ("LGPL-2.0", _gnu(LGPL, "2"), r"lgpl 2 0"),
    ("LGPL-2.1", _gnu(LGPL, "2.1"), r"lgpl 2 1"),
    ("LGPL-3.0", _gnu(LGPL, "3"), r"lgpl 3 0"),
    ("AGPL-3.0", _gnu(AGPL, "3"), r"agpl 3 0"),
    ("MPL-1.1", rf"(?:mozilla public licen[cs]e|mpl) (?:version |v ?)?1 1{END}", r"mpl 1 1"),
    ("MPL-2.0", rf"(?:mozilla public licen[cs]e|mpl) (?:version |v ?)?2 0{END}", r"mpl 2 0"),
    ("BSD-2-Clause", r"(?:bsd )?(?:2|two) clause (?:bsd|licen[cs]e)|bsd (?:2|two) clause|(?:simplified|freebsd) (?:bsd )?licen[cs]e", r"bsd 2 clause"),
    ("BSD-3-Clause", r"(?:bsd )?(?:3|three) clause (?:bsd|licen[cs]e)|bsd (?:3|three) clause|(?:new|modified|revised) bsd", r"bsd 3 clause"),
    ("BSD-4-Clause", r"(?:bsd )?(?:4|four) clause (?:bsd|licen[cs]e)|bsd (?:4|four) clause|original bsd", r"bsd 4 clause"),
    ("BSD", r"bsd(?: style)? licen[cs]e(?! (?:[234]|two|three|four) clause)", None),
    ("ISC", r"isc licen[cs]e|isc$", r"isc"),
    ("Zlib", r"zlib(?: libpng)? licen[cs]e", r"zlib"),
    ("BSL-1.0", r"boost software licen[cs]e", r"bsl 1 0"),
    ("EPL-1.0", rf"eclipse public licen[cs]e (?:version |v ?)?1 0{END}", r"epl 1 0"),
    ("EPL-2.0", rf"eclipse public licen[cs]e (?:version |v ?)?2 0{END}", r"epl 2 0"),
    ("Artistic-2.0", rf"artistic licen[cs]e (?:version |v ?)?2(?: 0)?{END}", r"artistic 2 0"),
    ("Unlicense", r"unlicen[cs]e", r"unlicense"),
    ("CC0-1.0", rf"cc0(?: 1 0)?{END}|(?:creative commons )?cc ?(?:0|zero){END}|creative commons zero", r"cc0 1 0"),
    *[
        (f"CC-{kind.upper()}-{version}.0", rf"(?:creative commons )?(?:cc )?(?:{kind.replace('-', ' ')}|{long})(?: (?:unported|international))?(?: (?:public )?licen[cs]e)?(?: cc {kind.replace('-', ' ')})? (?:version |v ?)?{version} 0{END}", f"cc {kind.replace('-', ' ')} {version} 0")
        for version in (3, 4)
        for kind, long in (
            ("by", "attribution"),
            ("by-sa", "attribution share ?alike"),
            ("by-nd", "attribution no ?deriv(?:ative)?s?"),
            ("by-nc", "attribution non ?commercial"),
            ("by-nc-sa", "attribution non ?commercial share ?alike"),
            ("by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s?"),
        )
    ],
)


def _notice(name: str) -> str:
    """Identifier of a licence's notice."""
    return {"Apache-2.0": "APACHE-2", "GPL-3.0": "GPL-3", "GPL-2.0": "GPL-2"}.get(name, name.upper().removesuffix(".0")) + "-NOTICE"


#: Identifiers and the regexes that find them in a sentence in normal form (lower case, words joined by one space), from the licences' texts and standard headers.
SENTENCES = (
    *[(_notice(name), rf"{UNDER}(?:{said})" + (rf"|spdx license identifier (?:[a-z0-9 ]+ (?:or|and) )?{spdx}(?! 0$| 0 |-){END}" if spdx else "")) for name, said, spdx in NAMES],
    # a second name in one notice: "either the MIT license or the Apache License, Version 2.0"
    *[(_notice(name), rf"{UNDER}.{{3,60}} (?:or|and) (?:the )?(?:{said})") for name, said, _ in NAMES if name in ("MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "MPL-2.0", "BSD-3-Clause")],
    ("MIT-TITLE", r"^(?:the )?mit license(?: mit)?(?: copyright .*)?$"),
    ("MIT-0-GRANT", r"^permission is hereby granted free of charge to any person obtaining a copy of this software\b.*to whom the software is furnished to do so$"),
    ("MIT-GRANT", r"permission is hereby granted free of charge to any person obtaining a copy of this software(?!.*furnished to do so$)"),
    ("BSL-GRANT", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("X11-NAMES", r"^except as contained in this notice the names? .* shall not be used in advertising or otherwise to promote"),
    ("AS-IS", r"the software is provided as is without warranty of any kind"),
    ("ISC-GRANT", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("0BSD-GRANT", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted$"),
    ("ISC-AS-IS", r"the software is provided as is and .* disclaims? all warranties"),
    ("BSD-GRANT", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("BSD-SOURCE", r"redistributions? of (?:the )?source code must retain the (?:above )?copyright notice"),
    ("BSD-BINARY", r"redistributions? in binary form must reproduce the (?:above )?copyright notice"),
    ("BSD-ADVERTISING", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("BSD-ENDORSE", r"\bneither the names? (?:of )?.* may be used to endorse or promote products|the names? (?:of )?.* may not be used to endorse or promote products"),
    ("APACHE-1-ACK", r"the end user documentation included with the redistribution if any must include the following acknowledge?ment"),
    ("BSD-AS-IS", r"this software is provided (?:by .*)?as is and any express(?:ed)? or implied warranties"),
    ("APACHE-2-TITLE", r"^apache license version 2 0 january 2004"),
    ("APACHE-COPY-AT", r"you may obtain a copy of the license at"),
    ("GPL-FREE", r"^this (?:program|library|file|software) is free software|is free software$"),
    ("AGPL-TERMS", r"under the terms of (?:version \d of )?the gnu affero general public license"),
    ("LGPL-TERMS", r"under the terms of (?:version \d of )?the gnu (?:lesser|library) general public license"),
    ("GPL-TERMS", r"under the terms of (?:version \d of )?the gnu general public license"),
    *[(f"VERSION-{v}", rf"(?:^(?:(?:either )?version|either version) |general public license (?:as published by the free software foundation )?(?:either )?version |the terms of version ){v.replace('.', ' ')}(?! \d){END}") for v in ("1", "2", "2.1", "3")],
    ("GPL-1-TITLE", r"^gnu general public license version 1 february 1989"),
    ("GPL-2-TITLE", r"^gnu general public license version 2 june 1991"),
    ("GPL-3-TITLE", r"^gnu general public license version 3 29 june 2007"),
    ("LGPL-2-TITLE", r"^gnu library general public license version 2 june 1991"),
    ("LGPL-2.1-TITLE", r"^gnu lesser general public license version 2 1 february 1999"),
    ("LGPL-3-TITLE", r"^gnu lesser general public license version 3 29 june 2007"),
    ("AGPL-3-TITLE", r"^gnu affero general public license version 3 19 november 2007"),
    ("GFDL-1.2-TITLE", r"^gnu free documentation license version 1 2"),
    ("GFDL-1.3-TITLE", r"^gnu free documentation license version 1 3"),
    ("MPL-1.1-TITLE", r"^mozilla public license version 1 1$"),
    ("MPL-2-TITLE", r"^mozilla public license version 2 0$"),
    ("MPL-1.1-HEADER", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("MPL-2-HEADER", r"this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0"),
    ("ARTISTIC-1-TITLE", r"^the artistic license(?: preamble)?$"),
    ("ARTISTIC-1-INTENT", r"^the intent of this document is to state the conditions under which a package may be copied"),
    ("ARTISTIC-2-TITLE", r"^(?:the )?artistic license 2 0"),
    ("ZLIB-GRANT", r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("UNLICENSE-TEXT", r"this is free and unencumbered software released into the public domain"),
    ("CC0-TITLE", r"^(?:creative commons )?cc0 1 0 universal"),
    ("CC0-WAIVER", r"affirmer hereby overtly fully permanently irrevocably and unconditionally waives"),
    *[(f"CC-{kind.upper().replace(' ', '-')}-4-TITLE", rf"^(?:creative commons )?{long} 4 0 international(?: (?:public license|creative commons).*)?$") for kind, long in (("by", "attribution"), ("by sa", "attribution sharealike"), ("by nd", "attribution noderivatives"), ("by nc", "attribution noncommercial"), ("by nc sa", "attribution noncommercial sharealike"), ("by nc nd", "attribution noncommercial noderivatives"))],
    ("PSF-GRANT", r"\bpsf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("ALL-RIGHTS", r"\ball rights reserved\b(?! are retained)"),
)

_GRANTS = "MIT-GRANT|MIT-0-GRANT|BSL-GRANT|ISC-GRANT|0BSD-GRANT|BSD-GRANT|ZLIB-GRANT"

#: A licence, and the identifiers that must follow one another (others may stand between, but not within one string of several). The first rule that matches a run of identifiers is named for it; every rule that matches counts.
RULES = (
    ("MIT", ("MIT-GRANT", "AS-IS(?! X11-NAMES )")),
    ("MIT", ("MIT-TITLE",)),
    ("X11", ("MIT-GRANT", "AS-IS X11-NAMES")),
    ("MIT-0", ("MIT-0-GRANT", "AS-IS")),
    ("BSL-1.0", ("BSL-GRANT",)),
    ("ISC", ("ISC-GRANT", "ISC-AS-IS")),
    ("0BSD", ("0BSD-GRANT", "ISC-AS-IS")),
    ("BSD-2-Clause", ("BSD-GRANT", "BSD-SOURCE BSD-BINARY(?! (?:BSD-ENDORSE|BSD-ADVERTISING|APACHE-1-ACK) )")),
    ("BSD-3-Clause", ("BSD-GRANT", "BSD-SOURCE BSD-BINARY BSD-ENDORSE")),
    ("BSD-4-Clause", ("BSD-GRANT", "BSD-SOURCE BSD-BINARY BSD-ADVERTISING BSD-ENDORSE")),
    ("Apache-1.1", ("BSD-GRANT", "BSD-SOURCE BSD-BINARY APACHE-1-ACK")),
    ("Apache-2.0", ("APACHE-2-NOTICE", "APACHE-COPY-AT")),
    ("Apache-2.0", ("APACHE-2-TITLE",)),
    *[(f"{kind}-{v if '.' in v else v + '.0'}", (f"{kind}-TERMS (?:GPL-FREE )?VERSION-{v}",)) for kind in ("GPL", "LGPL", "AGPL") for v in ("1", "2", "2.1", "3")],
    *[(f"{kind}-{v if '.' in v else v + '.0'}", (f"{kind}-{v}-TITLE",)) for kind, vs in (("GPL", "123"), ("LGPL", ("2", "2.1", "3")), ("AGPL", "3"), ("GFDL", ("1.2", "1.3"))) for v in vs],
    ("MPL-1.1", ("MPL-1.1-TITLE",)),
    ("MPL-1.1", ("MPL-1.1-HEADER",)),
    ("MPL-2.0", ("MPL-2-TITLE",)),
    ("MPL-2.0", ("MPL-2-HEADER",)),
    ("Artistic-1.0", ("ARTISTIC-1-TITLE", "ARTISTIC-1-INTENT")),
    ("Artistic-2.0", ("ARTISTIC-2-TITLE",)),
    ("PSF-2.0", ("PSF-GRANT",)),
    ("Zlib", ("ZLIB-GRANT",)),
    ("Unlicense", ("UNLICENSE-TEXT",)),
    ("CC0-1.0", ("CC0-TITLE",)),
    ("CC0-1.0", ("CC0-WAIVER",)),
    *[(f"CC-{kind}-4.0", (f"CC-{kind}-4-TITLE",)) for kind in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND")],
    *[(name, (_notice(name),)) for name, _, _ in NAMES],
    # the usual line above a permissive grant is no claim of its own
    ("Proprietary", (f"(?<!MPL-1.1-HEADER )(?<!MPL-1.1-HEADER APACHE-COPY-AT )ALL-RIGHTS(?! (?:ALL-RIGHTS )*(?:{_GRANTS}) )",)),
)

#: Every sentence with an identifier holds one of these, which lets other texts and sentences go at once.
SIGNS = ("licen", "rights", "permission", "redistribut", "released", "distributed", "available", "provided", "published", "covered", "governed", "subject", "version", "advertising", "endorse", "artistic", "intent", "free software", "unencumbered", "documentation", "cc0", "affirmer", "attribution", "is free", "psf")


def sentences(text: Column) -> Column:
    """Normalised sentences: A-Z lowered, every run of other signs than letters and digits one space.

    A sentence ends at a mark before white space or at a line without letters and digits; a single line break, comment
    signs behind it included, ends none. "v. 2.0" and the colon of an SPDX identifier end none either.
    """
    raw = F.split(ascii_lower(text), r"""(?:(?<![^a-z]v)(?<!license-identifier)[.!?;:]+["'”’)\]*_]*(?:[\x20\x09-\x0D]+|$)|\r?\n[^a-z0-9\n]*\n)""")
    return F.transform(raw, lambda s: F.trim(F.regexp_replace(s, r"[^a-z0-9]+", " ")))


def signed(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(s)) for s in dict.fromkeys(SIGNS)])


def scan(docs: DataFrame) -> DataFrame:
    """Adds sentence_ids (identifiers in text order) and licences (sorted names). Null and empty texts have none.

    A sentence may have several identifiers; they come in the order of SENTENCES, one that is found twice once.
    """
    of = lambda s: F.array_distinct(F.array_compact(F.array(*[F.when(s.rlike(r), F.lit(i)) for i, r in SENTENCES])))
    found = F.flatten(F.transform(F.filter(sentences(F.col("text")), signed), of))
    out = docs.withColumn("sentence_ids", F.when(signed(ascii_lower(F.col("text"))), found).otherwise(F.array().cast("array<string>")))
    line = F.concat(F.lit(" "), F.array_join("sentence_ids", " "), F.lit(" "))
    names = [F.when(line.rlike(" " + " (?:.* )?".join(ids) + " "), F.lit(name)) for name, ids in RULES]
    named = F.array_sort(F.array_distinct(F.array_compact(F.array(*names))))
    return out.withColumn("licences", F.when(F.size("sentence_ids") > 0, named).otherwise(F.array().cast("array<string>")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"), (F.size("licences") > 0).alias("has_licence")
    )
