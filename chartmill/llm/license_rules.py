"""Signature rules of the licence scan: one table of licences, three rule forms each."""

from __future__ import annotations

from typing import NamedTuple

# fixed values: label, gate word that every alternative contains, expressions for the name over lower-case words joined by single spaces
LICENSES = [
    ("0bsd", "bsd", r"0bsd|bsd 0 clause"),
    ("0bsd", "zero", r"(?:bsd )?zero clause(?: bsd)?"),
    ("afl-3.0", "academic", r"academic free(?: license)?(?: version)?(?: 3 0)?"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public(?: license)?(?: version)?(?: 3)?"),
    ("apache-1.1", "apache", r"apache(?: software)?(?: license)?(?: version)? 1 1"),
    ("apache-2.0", "apache", r"apache(?: software)?(?: license)?(?: version)?(?: 2(?: 0)?)?"),
    ("artistic-1.0", "artistic", r"artistic(?: license)?(?: version)? 1 0"),
    ("artistic-2.0", "artistic", r"artistic(?: license)?(?: version)?(?: 2 0)?"),
    ("beerware", "beer", r"beer ?ware"),
    ("blueoak-1.0.0", "oak", r"blue oak(?: model)?(?: license)?(?: 1 0 0)?"),
    ("bsd-1-clause", "bsd", r"(?:1|one) clause bsd|bsd (?:1|one) clause"),
    ("bsd-2-clause", "bsd", r"(?:2|two) clause bsd|bsd (?:2|two) clause|simplified bsd|freebsd"),
    ("bsd-3-clause", "bsd", r"(?:3|three) clause bsd|bsd (?:3|three) clause|(?:new|modified|revised) bsd"),
    ("bsd-4-clause", "bsd", r"(?:4|four) clause bsd|bsd (?:4|four) clause|(?:original|old) bsd"),
    ("bsl-1.0", "boost", r"boost(?: software)?(?: license)?(?: version)?(?: 1 0)?"),
    ("busl-1.1", "business", r"business source(?: license)?(?: version)?(?: 1 1)?"),
    ("c-uda-1.0", "computational", r"computational use of data(?: agreement)?(?: 1 0)?"),
    ("cc-by", "cc", r"cc by(?! (?:nc|nd|sa)\b)(?: [1-4] [05])?"),
    ("cc-by-nc", "cc", r"cc by nc(?! (?:nd|sa)\b)(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nd", "cc", r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-sa", "cc", r"cc by sa(?: [1-4] [05])?"),
    ("cc-by", "creative", r"creative commons attribution(?! (?:non|no|share))(?: [1-4] [05])?(?: international| unported| generic)?"),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial(?! (?:no|share))(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by-nc-nd", "creative", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "creative", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?"),
    ("cc-by-nd", "creative", r"creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?"),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc0-1.0", "zero", r"creative commons zero(?: v?1 0)?(?: universal)?"),
    ("cddl-1.0", "distribution", r"common development and distribution(?: license)?(?: version)?(?: 1 [01])?"),
    ("cddl-1.0", "cddl", r"cddl(?: 1 [01])?"),
    ("cdla-permissive-2.0", "community", r"community data license agreement permissive(?: version)?(?: [12] 0)?"),
    ("cdla-sharing-1.0", "community", r"community data license agreement sharing(?: version)?(?: 1 0)?"),
    ("cecill-2.1", "cecill", r"cecill(?: v?2 [01])?"),
    ("cecill-b", "cecill", r"cecill b"),
    ("cecill-c", "cecill", r"cecill c"),
    ("cpl-1.0", "common", r"common public(?: license)?(?: version)?(?: 1 0)?"),
    ("ecl-2.0", "educational", r"educational community(?: license)?(?: version)?(?: 2 0)?"),
    ("efl-2.0", "eiffel", r"eiffel forum(?: license)?(?: version)?(?: [12])?"),
    ("elastic-2.0", "elastic", r"elastic(?: license)(?: version)?(?: 2 0)?"),
    ("epl-1.0", "eclipse", r"eclipse public(?: license)?(?: version)?(?: v)? 1 0"),
    ("epl-2.0", "eclipse", r"eclipse public(?: license)?(?: version)?(?: v)?(?: 2 0)?"),
    ("eupl-1.2", "european", r"european union public(?: licen[cs]e)?(?: v(?:ersion)?)?(?: 1 [12])?"),
    ("fdl-1.3", "documentation", r"(?:gnu )?free documentation(?: license)?(?: version)?(?: 1 [123])?"),
    ("gpl", "gpl", r"(?:gnu )?gpl"),
    ("gpl-1.0", "gpl", r"(?:gnu )?gpl ?v?1(?: 0)?"),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl ?v?2(?: 0)?(?: only| or later)?"),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl ?v?3(?: 0)?(?: only| or later)?"),
    ("gpl", "general", r"(?<!lesser )(?<!library )(?<!affero )(?:gnu )?(?<!lesser )(?<!library )(?<!affero )general public(?: license)?"),
    ("gpl-2.0", "general", r"(?:gnu )?(?<!lesser )(?<!library )(?<!affero )general public(?: license)?(?: as published by the free software foundation)?(?: either)?(?: version)? (?:v ?)?2(?: 0)?"),
    ("gpl-3.0", "general", r"(?:gnu )?(?<!lesser )(?<!library )(?<!affero )general public(?: license)?(?: as published by the free software foundation)?(?: either)?(?: version)? (?:v ?)?3(?: 0)?"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public(?: license)?(?: version)? (?:v ?)?2(?: 1)?"),
    ("lgpl-2.0", "library", r"(?:gnu )?library general public(?: license)?(?: version)?(?: 2(?: 0)?)?"),
    ("lgpl-3.0", "lesser", r"(?:gnu )?lesser general public(?: license)?(?: version)?(?: (?:v ?)?3(?: 0)?)?"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl(?: ?v?[23](?: [01])?)?"),
    ("hpnd", "historical", r"historical permission notice and disclaimer"),
    ("imagemagick", "imagemagick", r"imagemagick"),
    ("ipl-1.0", "ibm", r"ibm public(?: license)?(?: version)?(?: 1 0)?"),
    ("isc", "isc", r"isc"),
    ("jpl", "jabber", r"jabber open source"),
    ("llama", "llama", r"llama(?: [234])?(?: [123])?(?: community)?"),
    ("lppl-1.3", "latex", r"latex project public(?: license)?(?: version)?(?: 1 3[ac]?)?"),
    ("miros", "miros", r"miros"),
    ("mit", "mit", r"mit"),
    ("mit", "expat", r"expat"),
    ("mit-0", "mit", r"mit (?:0|no attribution)"),
    ("mpl-1.1", "mozilla", r"mozilla public(?: license)?(?: version)?(?: v)? 1 [01]"),
    ("mpl-2.0", "mozilla", r"mozilla public(?: license)?(?: version)?(?: v)?(?: 2 0)?"),
    ("ms-pl", "microsoft", r"microsoft public"),
    ("ms-rl", "microsoft", r"microsoft reciprocal"),
    ("mulan-2.0", "mulan", r"mulan(?: permissive software)?(?: license)?(?: v(?:ersion)?)?(?: ?2)?"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)?"),
    ("nposl-3.0", "profit", r"non profit open software(?: license)?(?: 3 0)?"),
    ("odbl-1.0", "database", r"open (?:data commons open )?database(?: license)?(?: v?1 0)?"),
    ("odbl-1.0", "odbl", r"odbl(?: 1 0)?"),
    ("odc-by-1.0", "commons", r"open data commons attribution(?: license)?(?: v?1 0)?"),
    ("ofl-1.1", "font", r"(?:sil )?open font(?: license)?(?: version)?(?: 1 1)?"),
    ("openrail", "rail", r"(?:creative ml |bigscience )?(?:open)? ?rail(?: m)?"),
    ("openssl", "openssl", r"openssl(?: ssleay)?"),
    ("osl-3.0", "software", r"open software(?: license)?(?: version)?(?: v)?(?: [123] [01])?"),
    ("pddl-1.0", "dedication", r"(?:open data commons )?public domain dedication and(?: license)?"),
    ("php-3.01", "php", r"php(?: license)?(?: version)?(?: 3 01?)?"),
    ("polyform-nc", "polyform", r"polyform non ?commercial(?: license)?(?: 1 0 0)?"),
    ("postgresql", "postgresql", r"postgresql"),
    ("psf-2.0", "python", r"python(?: software foundation)?(?: license)?(?: version)?(?: 2)?"),
    ("qpl-1.0", "public", r"q public(?: license)?(?: version)?(?: 1 0)?"),
    ("rpl-1.5", "reciprocal", r"reciprocal public(?: license)?(?: version)?(?: 1 [15])?"),
    ("ruby", "ruby", r"ruby"),
    ("sleepycat", "sleepycat", r"sleepycat"),
    ("sspl-1.0", "server", r"server side public(?: license)?(?: version)?(?: v?1)?"),
    ("unicode", "unicode", r"unicode(?: data files and software)?"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("upl-1.0", "universal", r"universal permissive(?: license)?(?: version)?(?: 1 0)?"),
    ("vim", "vim", r"vim"),
    ("w3c", "w3c", r"w3c(?: software notice and)?"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("wtfpl", "want", r"do what the fuck you want to public"),
    ("x11", "x11", r"x11"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("zpl-2.1", "zope", r"zope public(?: license)?(?: version)?(?: 2 [01])?"),
]
# fixed values: rules that stand for themselves, with priority and weight
NOTICES = [
    ("reserved", "reserved", r"all rights(?: are)? reserved", 2, 0.6),
    ("reserved", "reserved", r"(?:some|no) rights reserved", 2, 0.4),
    ("copyright", "copyright", r"copyright(?: c)? (?:19|20)\d\d(?: (?:19|20)\d\d)?", 2, 0.6),
    ("copyright", "copyright", r"copyright (?:held|owned) by", 1, 0.5),
    ("public-domain", "domain", r"(?:released|dedicated|placed|put) (?:in ?to|to|in) the public domain", 3, 1.0),
    ("public-domain", "domain", r"in the public domain", 2, 0.7),
    ("proprietary", "proprietary", r"proprietary and confidential", 2, 0.8),
    ("proprietary", "permission", r"may not be (?:reproduced|copied|distributed)(?: \S+){0,8} without(?: \S+){0,4} permission", 2, 0.8),
    ("mit", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy", 3, 1.0),
    ("bsd-3-clause", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted", 3, 1.0),
    ("isc", "hereby", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 3, 1.0),
    ("zlib", "provided", r"this software is provided as is without any express or implied warranty", 3, 1.0),
]


class Rule(NamedTuple):
    label: str
    keyword: str
    pattern: str
    priority: int
    weight: float


def rules() -> list[Rule]:
    """Each licence as a grant, as a named licence and as a tag; then the notices.

    A grant outranks a tag, a tag a name. Names that are everyday words count
    only beside a word of licensing.
    """
    out = []
    for label, gate, name in LICENSES:
        out += [
            Rule(label, gate, rf"(?:licensed|licenced|released|distributed|available|published|provided|offered|shared|covered) (?:under|by|subject to)(?: the)?(?: terms of)?(?: the| an?)? ?(?:{name})(?: licen[cs]e)?", 3, 1.0),
            Rule(label, gate, rf"(?:spdx licen[cs]e identifier|licen[cs]e|licence type) (?:{name})(?: only| or later)?", 2, 0.9),
            Rule(label, gate, rf"(?:{name}) (?:public )?licen[cs]e(?: v(?:ersion)? ?\d(?: \d)?)?", 1, 0.7),
        ]
    # names that stand for nothing else need no word of licensing beside them
    alone = {"gpl", "general", "cc", "cc0", "creative", "affero", "lesser", "lgpl", "mozilla", "eclipse", "wtfpl", "want", "unlicense"}
    out += [Rule(label, gate, rf"(?:{name})", 1, 0.7) for label, gate, name in LICENSES if gate in alone]
    return out + [Rule(*n) for n in NOTICES]
