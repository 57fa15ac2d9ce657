"""License detection by ordered signature rules.

A text becomes its words, lower-cased and joined by single blanks.  Rules are regexes over
that form; each names a keyword that all its matches hold, and only documents that hold a
keyword, and in them only the words around it, ever meet a regex.  At each place of a keyword,
each of its rules is tried on a match that covers this very place, so every occurrence counts.
Overlapping detections are resolved by priority and containment: a detection is dropped if
its interval lies inside one of a stronger priority, or inside a longer one of the same
priority.

Everything is DataFrame code.  Rules are a small table of fixed size that is broadcast;
candidate words are found by exploding only the texts that pass the keyword filter.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.llm.common import ascii_lower, stored

#: Put before the place of a keyword that a match has to cover; no word holds it.
MARK = "\x01"
#: Priorities: 1 identifiers and full grants, 2 notices, 3 names, 4 mentions.
CONFIDENCE = {0: 0.9, 1: 0.98, 2: 0.95, 3: 0.85, 4: 0.5}
#: Phrases that always count, wherever their words stand next to each other.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: label | keyword | priority | regex over the normalised words, one rule a line.
RULES = r"""
apache-2.0|apache|1|spdx license identifier apache 2 0
apache-2.0|apache|1|licensed under (the )?apache (software )?license (version|v) ?2( 0)?
apache-2.0|apache|2|(released|distributed|available|provided|published) under (the )?(terms of the )?apache (software )?license (version )?2( 0)?
apache-2.0|apache|2|apache license version 2 0 january 2004
apache-2.0|apache|2|www apache org licenses license 2 0
apache-2.0|apache|3|apache (software )?(license|licence) (version )?v?2( 0)?
apache-2.0|apache|3|apache 2 0 (license|licence)
apache-2.0|apache|3|apl 2 0 apache
apache-1.1|apache|1|spdx license identifier apache 1 1
apache-1.1|apache|2|the apache software license version 1 1
apache-1.1|apache|3|apache (software )?license (version )?1 1
apache-1.0|apache|1|spdx license identifier apache 1 0
apache-1.0|apache|3|apache (software )?license (version )?1 0
apache|apache|4|apache (software )?(license|licence)
apache|apache|4|apache (style|like|compatible) (license|licence)
mit|mit|1|spdx license identifier mit
mit|mit|1|(released|licensed|distributed|available|provided|published) under (the )?(terms of the )?mit (license|licence)
mit|expat|1|(released|licensed|distributed|available|provided|published) under (the )?(terms of the )?expat (license|licence)
mit|permission|1|permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit|permission|2|the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit|mit|2|(this|the) (software|project|code|work|package|library) is (licensed|released|distributed) under (the )?mit
mit|mit|2|opensource org licenses mit
mit|mit|2|license mit
mit|mit|3|(the )?mit (license|licence)
mit|expat|3|expat (license|licence)
mit|mit|4|mit (style|like) (license|licence)
mit-0|mit|1|spdx license identifier mit 0
mit-0|mit|3|mit no attribution( license)?
x11|x11|1|spdx license identifier x11
x11|x11|3|(mit )?x11 (license|licence)
gpl-3.0-or-later|gpl|1|spdx license identifier gpl 3 0 or later
gpl-3.0-only|gpl|1|spdx license identifier gpl 3 0 only
gpl-2.0-or-later|gpl|1|spdx license identifier gpl 2 0 or later
gpl-2.0-only|gpl|1|spdx license identifier gpl 2 0 only
gpl-3.0|gpl|1|spdx license identifier gpl 3 0
gpl-2.0|gpl|1|spdx license identifier gpl 2 0
gpl-3.0-or-later|general|1|gnu general public license as published by the free software foundation either version 3 of the license or (at your option )?any later version
gpl-2.0-or-later|general|1|gnu general public license as published by the free software foundation either version 2 of the license or (at your option )?any later version
gpl-3.0|gnu|1|licensed under (the )?(terms of the )?gnu general public (license|licence) (version|v) ?3
gpl-2.0|gnu|1|licensed under (the )?(terms of the )?gnu general public (license|licence) (version|v) ?2
gpl-3.0|gnu|2|(released|distributed|available|provided|published) under (the )?(terms of the )?gnu (gpl|general public (license|licence)) (version |v)?3
gpl-2.0|gnu|2|(released|distributed|available|provided|published) under (the )?(terms of the )?gnu (gpl|general public (license|licence)) (version |v)?2
gpl-3.0|gnu|3|gnu general public (license|licence) (version |v)?3( 0)?
gpl-2.0|gnu|3|gnu general public (license|licence) (version |v)?2( 0)?
gpl-1.0|gnu|3|gnu general public (license|licence) (version |v)?1( 0)?
gpl-3.0|gpl|3|(gnu )?gpl (version )?v?3( 0)?
gpl-2.0|gpl|3|(gnu )?gpl (version )?v?2( 0)?
gpl-3.0|gplv3|3|gplv3
gpl-2.0|gplv2|3|gplv2
gpl|gnu|4|gnu general public (license|licence)
gpl|gnu|4|gnu gpl
gpl|gpl|4|gpl (license|licence|licensed|compatible)
gpl|gpl|4|(released|licensed|distributed|available) under (the )?gpl
gpl|free|2|under the terms of the gnu general public license as published by the free software foundation
gpl|warranty|2|without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license
lgpl-3.0|lgpl|1|spdx license identifier lgpl 3 0( only| or later)?
lgpl-2.1|lgpl|1|spdx license identifier lgpl 2 1( only| or later)?
lgpl-2.0|lgpl|1|spdx license identifier lgpl 2 0( only| or later)?
lgpl-3.0|lesser|1|gnu lesser general public license as published by the free software foundation either version 3
lgpl-2.1|lesser|1|gnu lesser general public license as published by the free software foundation either version 2 1
lgpl-3.0|lesser|2|gnu lesser general public (license|licence) (version |v)?3
lgpl-2.1|lesser|2|gnu lesser general public (license|licence) (version |v)?2 1
lgpl-2.0|library|2|gnu library general public (license|licence) (version |v)?2
lgpl-3.0|lgpl|3|lgpl (version )?v?3
lgpl-2.1|lgpl|3|lgpl (version )?v?2 1
lgpl|lesser|3|gnu lesser general public (license|licence)
lgpl|library|3|gnu library general public (license|licence)
lgpl|lgpl|4|lgpl (license|licence|licensed)
lgpl|lgpl|4|(released|licensed|distributed|available) under (the )?lgpl
agpl-3.0|agpl|1|spdx license identifier agpl 3 0( only| or later)?
agpl-3.0|affero|1|gnu affero general public license as published by the free software foundation either version 3
agpl-3.0|affero|2|gnu affero general public (license|licence) (version |v)?3
agpl-3.0|agpl|3|agpl (version )?v?3
agpl|affero|3|gnu affero general public (license|licence)
agpl|agpl|4|agpl (license|licence|licensed)
gfdl-1.3|documentation|1|gnu free documentation license (version )?1 3
gfdl-1.2|documentation|1|gnu free documentation license (version )?1 2
gfdl-1.1|documentation|1|gnu free documentation license (version )?1 1
gfdl|documentation|3|gnu free documentation (license|licence)
gfdl|gfdl|3|gfdl
bsd-3-clause|bsd|1|spdx license identifier bsd 3 clause
bsd-2-clause|bsd|1|spdx license identifier bsd 2 clause
bsd-4-clause|bsd|1|spdx license identifier bsd 4 clause
0bsd|0bsd|1|spdx license identifier 0bsd
bsd-3-clause|redistribution|1|redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-3-clause|endorse|2|may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause|advertising|2|all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-3-clause|bsd|2|(3|three) clause bsd (license|licence)
bsd-2-clause|bsd|2|(2|two) clause bsd (license|licence)
bsd-4-clause|bsd|2|(4|four) clause bsd (license|licence)
bsd-3-clause|bsd|2|bsd (3|three) clause
bsd-2-clause|bsd|2|bsd (2|two) clause
bsd-3-clause|bsd|2|(new|modified|revised) bsd (license|licence)
bsd-2-clause|bsd|2|(simplified|freebsd) bsd (license|licence)
bsd-4-clause|bsd|2|original bsd (license|licence)
0bsd|bsd|2|(0|zero) clause bsd
bsd|bsd|2|(released|licensed|distributed|available|provided|published) under (the )?(terms of the )?bsd (license|licence)
bsd|bsd|3|bsd (license|licence)
bsd|bsd|4|bsd (style|like) (license|licence)
isc|isc|1|spdx license identifier isc
isc|isc|2|(released|licensed|distributed|available) under (the )?isc (license|licence)
isc|permission|1|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc|isc|3|isc (license|licence)
mpl-2.0|mpl|1|spdx license identifier mpl 2 0
mpl-1.1|mpl|1|spdx license identifier mpl 1 1
mpl-2.0|mozilla|1|subject to the terms of the mozilla public license v ?2 0
mpl-1.1|mozilla|1|subject to the mozilla public license version 1 1
mpl-2.0|mozilla|2|(released|licensed|distributed|available) under (the )?(terms of the )?mozilla public (license|licence) (version |v)?2
mpl-2.0|mozilla|3|mozilla public (license|licence) (version |v)?2( 0)?
mpl-1.1|mozilla|3|mozilla public (license|licence) (version |v)?1 1
mpl-1.0|mozilla|3|mozilla public (license|licence) (version |v)?1 0
mpl|mozilla|4|mozilla public (license|licence)
mpl-2.0|mpl|3|mpl (version )?v?2( 0)?
epl-2.0|epl|1|spdx license identifier epl 2 0
epl-1.0|epl|1|spdx license identifier epl 1 0
epl-2.0|eclipse|2|eclipse public (license|licence) (version |v)?2( 0)?
epl-1.0|eclipse|2|eclipse public (license|licence) (version |v)?1( 0)?
epl|eclipse|3|eclipse public (license|licence)
edl-1.0|eclipse|2|eclipse distribution (license|licence)
cddl-1.1|cddl|1|spdx license identifier cddl 1 1
cddl-1.0|cddl|1|spdx license identifier cddl 1 0
cddl-1.1|distribution|2|common development and distribution (license|licence) (version |v)?1 1
cddl-1.0|distribution|2|common development and distribution (license|licence) (version |v)?1 0
cddl|distribution|3|common development and distribution (license|licence)
cddl|cddl|3|cddl
cpl-1.0|common|2|common public (license|licence) (version )?1 0
cpl|common|3|common public (license|licence)
ipl-1.0|ibm|2|ibm public (license|licence)
eupl-1.2|eupl|1|spdx license identifier eupl 1 2
eupl-1.1|eupl|1|spdx license identifier eupl 1 1
eupl-1.2|european|2|european union public (license|licence) (version |v)?1 2
eupl-1.1|european|2|european union public (license|licence) (version |v)?1 1
eupl|european|3|european union public (license|licence)
eupl|eupl|3|eupl
artistic-2.0|artistic|1|spdx license identifier artistic 2 0
artistic-2.0|artistic|2|artistic (license|licence) (version )?2( 0)?
artistic-1.0|artistic|2|artistic (license|licence) (version )?1( 0)?
artistic|artistic|3|artistic (license|licence)
perl|perl|3|same terms as perl( itself)?
psf-2.0|python|2|python software foundation (license|licence) (version )?2
psf|python|3|python software foundation (license|licence)
python-2.0|python|2|python (license|licence) (version )?2( 0)?
php-3.01|php|2|php (license|licence) (version )?3 01
php-3.0|php|2|php (license|licence) (version )?3( 0)?
php|php|3|php (license|licence)
ruby|ruby|3|ruby (license|licence)
zlib|zlib|1|spdx license identifier zlib
zlib|zlib|2|zlib (libpng )?(license|licence)
zlib|warranty|1|this software is provided as is without any express or implied warranty in no event will the authors be held liable
libpng|libpng|3|libpng (license|licence)
bsl-1.0|boost|1|distributed under the boost software license version 1 0
bsl-1.0|bsl|1|spdx license identifier bsl 1 0
bsl-1.0|boost|3|boost software (license|licence)
bsl-1.1|business|2|business source (license|licence) (version )?1 1
bsl|business|3|business source (license|licence)
sspl-1.0|sspl|1|spdx license identifier sspl 1 0
sspl-1.0|server|3|server side public (license|licence)
elastic-2.0|elastic|2|elastic (license|licence) (version )?2( 0)?
elastic|elastic|3|elastic (license|licence)
unlicense|unlicense|1|spdx license identifier unlicense
unlicense|unencumbered|1|free and unencumbered software released into the public domain
unlicense|unlicense|3|(the )?unlicense
wtfpl|wtfpl|3|wtfpl
wtfpl|public|3|do what the [a-z]+ you want to public (license|licence)
cc0-1.0|cc0|1|spdx license identifier cc0 1 0
cc0-1.0|cc0|2|cc0 1 0( universal)?
cc0-1.0|creative|2|creative commons (zero|cc0|public domain dedication)
cc0-1.0|cc0|3|cc0
cc-by-4.0|cc|1|spdx license identifier cc by 4 0
cc-by-sa-4.0|cc|1|spdx license identifier cc by sa 4 0
cc-by-nc-4.0|cc|1|spdx license identifier cc by nc 4 0
cc-by-nc-nd-4.0|cc|1|(licensed under )?(a )?cc by nc nd 4 0
cc-by-nc-sa-4.0|cc|1|(licensed under )?(a )?cc by nc sa 4 0
cc-by-nc-4.0|cc|2|(licensed under )?(a )?cc by nc 4 0
cc-by-nd-4.0|cc|2|(licensed under )?(a )?cc by nd 4 0
cc-by-sa-4.0|cc|2|(licensed under )?(a )?cc by sa 4 0
cc-by-4.0|cc|3|(licensed under )?(a )?cc by 4 0
cc-by-nc-nd-3.0|cc|1|(licensed under )?(a )?cc by nc nd 3 0
cc-by-nc-sa-3.0|cc|1|(licensed under )?(a )?cc by nc sa 3 0
cc-by-nc-3.0|cc|2|(licensed under )?(a )?cc by nc 3 0
cc-by-nd-3.0|cc|2|(licensed under )?(a )?cc by nd 3 0
cc-by-sa-3.0|cc|2|(licensed under )?(a )?cc by sa 3 0
cc-by-3.0|cc|3|(licensed under )?(a )?cc by 3 0
cc-by-nc-nd|cc|3|cc by nc nd
cc-by-nc-sa|cc|3|cc by nc sa
cc-by-nc|cc|4|cc by nc
cc-by-nd|cc|4|cc by nd
cc-by-sa|cc|4|cc by sa
cc-by-4.0|creative|2|creative commons attribution 4 0( international)?
cc-by-sa-4.0|creative|1|creative commons attribution share ?alike 4 0( international)?
cc-by-nc-4.0|creative|1|creative commons attribution non ?commercial 4 0( international)?
cc-by-nd-4.0|creative|1|creative commons attribution no ?deriv(ative)?s 4 0( international)?
cc-by-nc-sa-4.0|creative|1|creative commons attribution non ?commercial share ?alike 4 0( international)?
cc-by-nc-nd-4.0|creative|1|creative commons attribution non ?commercial no ?deriv(ative)?s 4 0( international)?
cc-by-3.0|creative|2|creative commons attribution 3 0
cc-by-sa-3.0|creative|1|creative commons attribution share ?alike 3 0
cc-by-nc-3.0|creative|1|creative commons attribution non ?commercial 3 0
cc-by-sa|creative|3|creative commons attribution share ?alike
cc-by-nc|creative|3|creative commons attribution non ?commercial
cc-by|creative|4|creative commons attribution
cc|creative|4|creative commons (license|licence)
cc-by-4.0|creativecommons|2|creativecommons org licenses by 4 0
cc-by-sa-4.0|creativecommons|2|creativecommons org licenses by sa 4 0
cc-by-nc-4.0|creativecommons|2|creativecommons org licenses by nc 4 0
cc-by-nd-4.0|creativecommons|2|creativecommons org licenses by nd 4 0
cc-by-nc-sa-4.0|creativecommons|2|creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0|creativecommons|2|creativecommons org licenses by nc nd 4 0
cc-by-sa-3.0|creativecommons|2|creativecommons org licenses by sa 3 0
cc-by-3.0|creativecommons|2|creativecommons org licenses by 3 0
cc0-1.0|creativecommons|2|creativecommons org publicdomain zero 1 0
odbl-1.0|odbl|1|spdx license identifier odbl 1 0
odbl-1.0|database|2|open (data commons open )?database (license|licence)
odc-by-1.0|open|2|open data commons attribution (license|licence)
pddl-1.0|open|2|open data commons public domain dedication
ofl-1.1|ofl|1|spdx license identifier ofl 1 1
ofl-1.1|sil|2|sil open font (license|licence)( version 1 1)?
ofl-1.1|open|3|open font (license|licence)
openssl|openssl|3|openssl (license|licence)
ogl-3.0|open|2|open government (license|licence) (version |v)?3( 0)?
ogl|open|3|open government (license|licence)
ms-pl|microsoft|2|microsoft public (license|licence)
ms-rl|microsoft|2|microsoft reciprocal (license|licence)
afl-3.0|academic|2|academic free (license|licence) (version |v)?3( 0)?
afl|academic|3|academic free (license|licence)
osl-3.0|open|2|open software (license|licence) (version |v)?3( 0)?
osl|open|3|open software (license|licence)
upl-1.0|universal|2|universal permissive (license|licence)
ncsa|ncsa|2|(university of illinois )?ncsa (open source )?(license|licence)
w3c|w3c|2|w3c software (notice and )?(license|licence)
postgresql|postgresql|2|postgresql (license|licence)
vim|vim|3|vim (license|licence)
tcl|tcl|3|tcl tk (license|licence)
curl|curl|3|curl (license|licence)
ecl-2.0|educational|2|educational community (license|licence)( version)? 2( 0)?
apsl-2.0|apple|2|apple public source (license|licence)
json|evil|2|the software shall be used for good not evil
json|json|3|json (license|licence)
beerware|beer|3|beer ware (license|licence)
beerware|beerware|3|beerware (license|licence)
beerware|beerware|4|beerware
openrail|rail|2|open rail (m )?(license|licence)
openrail|openrail|2|openrail (m )?(license|licence)
openrail|responsible|2|responsible ai (m )?(license|licence)
openrail|openrail|3|openrail( m)?
llama|llama|2|llama ([0-9]+ )?([0-9]+ )?community (license|licence)
public-domain|domain|2|(released|placed|dedicated) (in|into|to) the public domain
public-domain|domain|4|public domain
proprietary|rights|3|all rights reserved
proprietary|proprietary|3|proprietary and confidential
proprietary|proprietary|4|proprietary (license|licence|software)
commercial|commercial|4|commercial (license|licence)
"""


def _place(keyword: str, regex: str) -> int | None:
    """Where the regex holds the keyword as a word outside of groups; groups count as blanks."""
    plain = regex
    while (inner := re.sub(r"\([^()]*\)\??", lambda m: " " * len(m[0]), plain)) != plain:
        plain = inner
    found = re.search(rf"(?<![^ ]){re.escape(keyword)}(?![^ ])", plain)
    return found and found.start()


def rules(text: str = RULES) -> list[tuple[str, str, int, str]]:
    """(label, keyword, priority, regex) in order.

    A rule whose regex does not hold its keyword as a word outside of groups, or repeats what
    may hold a blank, has matches that the scan could not find, and raises.
    """
    out = []
    for line in text.strip().splitlines():
        label, keyword, priority, regex = line.split("|", 3)
        if _place(keyword, regex) is None or re.search(r"[*{^$]|[^\]]\+", regex):
            raise ValueError(f"cannot look for {line!r} by its keyword")
        out.append((label, keyword, int(priority), regex))
    return out


def marked(keyword: str, regex: str) -> tuple[str, int, int]:
    """The regex with its keyword at the mark, and the words it may take before and after."""
    at = _place(keyword, regex)
    return rf"(?<![^ ])(?:{regex[:at]}{MARK}{regex[at:]})(?![^ ])", regex.count(" ", 0, at), regex.count(" ", at)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule_text: str = RULES, base: dict[str, str] = BASE) -> tuple[DataFrame, DataFrame]:
    """Scans every text; returns (documents, detections).

    ``documents``: one row per input row: ``id_col``, ``n_words``, ``n_base``,
    ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``, ``n_rules``
    (detections left after suppression).  ``detections``: ``id_col``, ``label``,
    ``priority``, ``start``, ``n_words`` (in words, from 0); priority 0 is a base phrase,
    which nothing suppresses.

    Null or empty text has no words and no labels (empty strings, score 0, null places).
    Rows are scanned one by one, so null and repeated ids are no matter; detections of
    equal interval and priority are all kept; other columns are ignored; an empty table
    gives empty results.
    """
    spark = docs.sparkSession
    parsed = rules(rule_text)
    table = [(k, p, *marked(k, x), label, False) for label, k, p, x in parsed] + [(phrase.split()[0], 0, *marked(phrase.split()[0], phrase), label, True) for phrase, label in base.items()]
    keywords = sorted({r[0] for r in table})
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rule = spark.sql("SELECT * FROM VALUES " + ",".join(f"({quote(k)},{p},{quote(x)},{quote(label)})" for k, p, x, _, _, label, _ in table) + " AS t(word, priority, regex, label)")
    reach = {k: (max(r[3] for r in table if r[0] == k), max(r[4] for r in table if r[0] == k)) for k in keywords}
    reach = spark.sql("SELECT * FROM VALUES " + ",".join(f"({quote(k)},{x},{y})" for k, (x, y) in reach.items()) + " AS t(word, before, after)")

    words = F.filter(F.split(ascii_lower(F.col(text_col)), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words.alias("words"))
    some = F.arrays_overlap("words", F.expr("array(" + ",".join(map(quote, keywords)) + ")"))
    rows = stored(rows.select("row", "id", F.size("words").cast("long").alias("n_words"), F.when(some, F.col("words")).alias("words")), "words")

    at = rows.where("words is not null").select("row", "id", "words", F.posexplode("words").alias("at", "word")).join(F.broadcast(reach), "word")
    begin = F.greatest(F.col("at") - F.col("before"), F.lit(0))
    ahead = F.array_join(F.slice("words", begin + 1, F.col("at") - begin), " ")
    here = F.concat(F.lit(MARK), F.array_join(F.slice("words", F.col("at") + 1, F.col("after") + 1), " "))
    near = F.when(F.col("at") > begin, F.concat(ahead, F.lit(" "), here)).otherwise(here)
    hit = at.select("row", "id", "word", begin.alias("begin"), near.alias("near")).join(F.broadcast(rule), "word")
    hit = hit.withColumn("found", F.regexp_instr("near", F.col("regex"))).where("found > 0")
    match = F.regexp_substr("near", F.col("regex"))
    blanks = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    start = F.col("begin") + blanks(F.substring(F.col("near"), F.lit(1), F.col("found") - 1))
    hit = hit.select("row", "id", "label", "priority", start.cast("long").alias("start"), (blanks(match) + 1).cast("long").alias("n"))
    hit = hit.distinct()

    order = W.partitionBy("row").orderBy("start", F.desc("n"), "priority").rowsBetween(W.unboundedPreceding, -1)
    spans = hit.where("priority > 0").groupBy("row", "id", "start", "n", "priority").agg(F.collect_set("label").alias("labels"))
    levels = sorted({p for _, _, p, _ in parsed})
    end = F.col("start") + F.col("n")
    covered = F.coalesce(*[F.when(F.col("priority") == p, F.max(F.when(F.col("priority") <= p, end)).over(order) >= end) for p in levels], F.lit(False)) if levels else F.lit(False)
    kept = spans.withColumn("covered", covered).where("not covered").select("row", "id", F.explode("labels").alias("label"), "priority", "start", "n")
    kept = stored(kept.unionByName(hit.where("priority = 0")), "licenses")

    is_base = F.col("priority") == 0
    sure = F.coalesce(*[F.when(F.col("priority") == p, F.lit(c)) for p, c in CONFIDENCE.items()])
    by_row = kept.groupBy("row").agg(
        F.count(F.when(is_base, 1)).alias("n_base"),
        F.min(F.when(is_base, F.col("start"))).alias("first_word"),
        F.max(F.when(is_base, F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(is_base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max(sure).alias("score"),
        F.count(F.when(~is_base, 1)).alias("n_rules"),
    )
    # Texts without a keyword go straight through; only the others are joined.
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    plain = rows.where("words is null").select("id", "n_words", zero.alias("n_base"), none.alias("first_word"), none.alias("last_word"), F.lit("").alias("base_labels"), F.lit("").alias("labels"), F.lit(0.0).alias("score"), zero.alias("n_rules"))
    found = rows.where("words is not null").select("row", "id", "n_words").join(by_row, "row", "left")
    found = found.select("id", "n_words", F.coalesce("n_base", zero).alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("n_rules", zero).alias("n_rules"))
    documents = plain.unionByName(found).withColumnRenamed("id", id_col)
    return documents, kept.select(F.col("id").alias(id_col), "label", "priority", "start", F.col("n").alias("n_words"))
