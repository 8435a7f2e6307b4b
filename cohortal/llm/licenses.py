"""Licence recognition by sentences: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNDER = (
    r"(?:(?:[a-z0-9]+ ){0,6}(?:is|are) )?(?:(?:dual|dually|multi|triple|jointly|also|made) )?(?:released|licensed|distributed|available|provided|governed) (?:under|by) "
    r"(?:(?:either|both|any|one)(?: of)? )?(?:the )?(?:terms (?:and conditions )?of )?(?:either (?:of )?)?(?:the |an? )?"
)
TERMS = r"(?:.* is free software )?you (?:can|may) redistribute it and or modify it under the terms of the gnu "
FSF = r"(?: gpl| lgpl| agpl)? as published by the free software foundation"
# Identifiers of licence sentences and how each starts, as a pattern over the
# normalised sentence (lower case, letters and digits only, one space between). The first that
# fits names the sentence; further words may follow, except where a pattern ends with $.
SENTENCES = (
    ("ApacheVer2", UNDER + r"apache(?: software)?(?: license)? (?:version |v ?)?2(?: 0)?|(?:the )?apache license (?:version |v ?)?2(?: 0)?|spdx apache (?:license )?(?:version |v ?)?2(?: 0)?"),
    ("ApacheReleased", UNDER + r"apache(?: software)?(?: license|$)|spdx apache"),
    ("ApacheObtain", r"you may obtain a copy of the license at"),
    ("ApacheMayNot", r"you may not use this (?:file|work|software) except in compliance with the license"),
    ("ApacheAsIs", r"unless required by applicable law or agreed to in writing"),
    ("MITReleased", UNDER + r"(?:mit|expat|x11)(?: style)?(?: open source)?(?: licenses?|$)|(?:the )?mit license(?: mit)?$|(?:the )?mit license license mit|spdx (?:mit|expat)"),
    ("BoostPermission", r"permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("BoostVer1", UNDER + r"(?:boost software license|bsl)|boost software license(?: version)? 1 0|spdx bsl 1 0"),
    ("MITPermission", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("MITNotice", r"the above copyright notice and this permission notice shall be included"),
    ("MITAsIs", r"the software is provided as is without warranty"),
    ("ISCReleased", UNDER + r"isc license|(?:the )?isc license(?: isc)?$|spdx isc"),
    ("ISCPermission", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("ISCAsIs", r"the software is provided as is and the author disclaims all warranties"),
    ("AGPLTerms3", TERMS + r"affero general public license" + FSF + r" (?:either )?version 3"),
    ("AGPLTerms", TERMS + r"affero general public license" + FSF + r"$"),
    ("AGPLVer3", UNDER + r"(?:gnu )?(?:affero general public license|agpl) ?(?:version |v ?)?3|gnu affero general public license version 3|spdx agpl 3 0"),
    ("LGPLTerms3", TERMS + r"lesser general public license" + FSF + r" (?:either )?version 3"),
    ("LGPLTerms21", TERMS + r"lesser general public license" + FSF + r" (?:either )?version 2 1"),
    ("LGPLTerms", TERMS + r"(?:lesser|library) general public license" + FSF + r"$"),
    ("LGPLVer3", UNDER + r"(?:gnu )?(?:lesser general public license|lgpl) ?(?:version |v ?)?3|gnu lesser general public license version 3|spdx lgpl 3 0"),
    ("LGPLVer21", UNDER + r"(?:gnu )?(?:lesser general public license|lgpl) ?(?:version |v ?)?2 1|gnu lesser general public license version 2 1|spdx lgpl 2 1"),
    ("GPLTerms3", TERMS + r"general public license" + FSF + r" (?:either )?version 3"),
    ("GPLTerms2", TERMS + r"general public license" + FSF + r" (?:either )?version 2"),
    ("GPLTerms", TERMS + r"general public license" + FSF + r"$"),
    ("Either3", r"either version 3(?: 0)? of the license"),
    ("Either21", r"either version 2 1 of the license"),
    ("Either2", r"either version 2(?: 0)? of the license"),
    ("GPLVer3", UNDER + r"(?:gnu )?(?:general public license|gpl) ?(?:version |v ?)?3|gnu general public license version 3|spdx gpl 3 0"),
    ("GPLVer2", UNDER + r"(?:gnu )?(?:general public license|gpl) ?(?:version |v ?)?2|gnu general public license version 2|spdx gpl 2 0"),
    ("GPLWarranty", r"(?:this|the|it) (?:[a-z]+ )?is distributed in the hope that it will be useful"),
    ("GPLTitle", r"gnu general public license$"),
    ("MPLVer2", r"(?:this source code form is subject to the terms of the )?mozilla public license (?:v|version) ?2 0|" + UNDER + r"(?:mozilla public license|mpl) ?(?:version |v ?)?2(?: 0)?|spdx mpl 2 0"),
    ("BSD4Released", UNDER + r"(?:bsd 4 clause|4 clause bsd|original bsd)(?: license|$)|spdx bsd 4 clause"),
    ("BSDAdvertising", r"all advertising materials mentioning features or use of this software must display"),
    ("BSD3Released", UNDER + r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd)(?: license|$)|(?:the )?(?:bsd 3 clause|3 clause bsd) license|spdx bsd 3 clause"),
    ("BSD2Released", UNDER + r"(?:bsd 2 clause|2 clause bsd|simplified bsd)(?: license|$)|(?:the )?(?:bsd 2 clause|2 clause bsd) license|spdx bsd 2 clause"),
    ("BSDReleased", UNDER + r"bsd(?: style)?(?: licenses?|$)|spdx bsd(?: license)?$"),
    ("BSDRedistribute", r"redistribution and use in source and binary forms"),
    ("BSDSource", r"redistributions of source code must retain the above copyright notice"),
    ("BSDBinary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("BSDNames", r"neither the names? of|the names? of .* may not be used to endorse or promote"),
    ("BSDAsIs", r"this software is provided by .* as is"),
    ("CCBYNCSA", UNDER + r"(?:cc by nc sa|creative commons attribution noncommercial sharealike)|spdx cc by nc sa"),
    ("CCBYNCND", UNDER + r"(?:cc by nc nd|creative commons attribution noncommercial noderivs|creative commons attribution noncommercial noderivatives)|spdx cc by nc nd"),
    ("CCBYNC", UNDER + r"(?:cc by nc|creative commons attribution noncommercial)|spdx cc by nc"),
    ("CCBYSA", UNDER + r"(?:cc by sa|creative commons attribution sharealike)|spdx cc by sa"),
    ("CCBYND", UNDER + r"(?:cc by nd|creative commons attribution noderivs|creative commons attribution noderivatives)|spdx cc by nd"),
    ("CCBY", UNDER + r"(?:cc by|creative commons attribution)|spdx cc by"),
    ("CC0", UNDER + r"(?:cc0|creative commons zero)|no rights reserved|spdx cc0"),
    ("ZlibPermission", r"permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("ZlibOrigin", r"the origin of this software must not be misrepresented"),
    ("ZlibReleased", UNDER + r"zlib(?: libpng)?(?: license|$)|(?:the )?zlib license$|spdx zlib"),
    ("EPLVer2", UNDER + r"(?:eclipse public license|epl) ?(?:version |v ?)?2|eclipse public license (?:version |v ?)?2|spdx epl 2 0"),
    ("EPLVer1", UNDER + r"(?:eclipse public license|epl) ?(?:version |v ?)?1|eclipse public license (?:version |v ?)?1|spdx epl 1 0"),
    ("CDDLVer11", r"(?:the contents of this file are subject to the terms of the |" + UNDER + r")?cddl(?: license)?(?: cddl)? (?:version |v ?)?1 1|spdx cddl 1 1"),
    ("CDDLVer1", r"(?:the contents of this file are subject to the terms of the |" + UNDER + r")?cddl(?: license)?(?: cddl)? (?:version |v ?)?1|spdx cddl 1 0"),
    ("CDDL", r"the contents of this file are subject to the terms of the cddl|" + UNDER + r"cddl"),
    ("WTFPL", r"do what the f[a-z ]{1,5} you want to public license|(?:" + UNDER + r")?(?:the )?wtfpl|spdx wtfpl"),
    ("Unlicense", r"this is free and unencumbered software released into the public domain|spdx unlicense"),
    ("PublicDomain", r".*(?:released into|in) the public domain$"),
    ("AllRights", r"all rights reserved$"),
    ("Copyright", r"(?:copyright|c)(?: c)? [0-9]{4}"),
)
# Ordered rules. A rule whose sentences stand in this order, at most GAP others between two
# of them, names a licence of the text; the first that does is its main one.
RULES = (
    ("Apache-2.0", ("ApacheVer2",)),
    ("Apache-2.0", ("ApacheMayNot", "ApacheAsIs")),
    ("Apache", ("ApacheReleased",)),
    ("MIT", ("MITPermission", "MITNotice")),
    ("MIT", ("MITReleased",)),
    ("ISC", ("ISCPermission",)),
    ("ISC", ("ISCReleased",)),
    ("AGPL-3.0", ("AGPLTerms3",)),
    ("AGPL-3.0", ("AGPLTerms", "Either3")),
    ("AGPL-3.0", ("AGPLVer3",)),
    ("LGPL-3.0", ("LGPLTerms3",)),
    ("LGPL-3.0", ("LGPLTerms", "Either3")),
    ("LGPL-3.0", ("LGPLVer3",)),
    ("LGPL-2.1", ("LGPLTerms21",)),
    ("LGPL-2.1", ("LGPLTerms", "Either21")),
    ("LGPL-2.1", ("LGPLVer21",)),
    ("GPL-3.0", ("GPLTerms3",)),
    ("GPL-3.0", ("GPLTerms", "Either3")),
    ("GPL-3.0", ("GPLVer3",)),
    ("GPL-2.0", ("GPLTerms2",)),
    ("GPL-2.0", ("GPLTerms", "Either2")),
    ("GPL-2.0", ("GPLVer2",)),
    ("GPL", ("GPLTerms", "GPLWarranty")),
    ("GPL", ("GPLTitle",)),
    ("MPL-2.0", ("MPLVer2",)),
    ("BSD-4-Clause", ("BSDRedistribute", "BSDAdvertising")),
    ("BSD-4-Clause", ("BSD4Released",)),
    ("BSD-3-Clause", ("BSDRedistribute", "BSDNames")),
    ("BSD-3-Clause", ("BSD3Released",)),
    ("BSD-2-Clause", ("BSDRedistribute",)),
    ("BSD-2-Clause", ("BSD2Released",)),
    ("BSD", ("BSDReleased",)),
    ("CC-BY-NC-SA", ("CCBYNCSA",)),
    ("CC-BY-NC-ND", ("CCBYNCND",)),
    ("CC-BY-NC", ("CCBYNC",)),
    ("CC-BY-SA", ("CCBYSA",)),
    ("CC-BY-ND", ("CCBYND",)),
    ("CC-BY", ("CCBY",)),
    ("CC0-1.0", ("CC0",)),
    ("Zlib", ("ZlibPermission", "ZlibOrigin")),
    ("Zlib", ("ZlibReleased",)),
    ("BSL-1.0", ("BoostPermission",)),
    ("BSL-1.0", ("BoostVer1",)),
    ("EPL-2.0", ("EPLVer2",)),
    ("EPL-1.0", ("EPLVer1",)),
    ("CDDL-1.1", ("CDDLVer11",)),
    ("CDDL-1.0", ("CDDLVer1",)),
    ("CDDL", ("CDDL",)),
    ("WTFPL", ("WTFPL",)),
    ("Unlicense", ("Unlicense",)),
    ("Public-Domain", ("PublicDomain",)),
    ("Proprietary", ("AllRights",)),
)
GAP = 8
#: A text, and a sentence, without one of these is none of the above.
HINT = r"licen[sc]e|copyright|\(c\)|rights\s+reserved|permission|warrant|redistribut|public\s+domain|neither\s+the|names?\s+of|free\s+software|under\s+(?:the\s+)?(?:cc|creative|mpl|gnu|a?gpl|lgpl)|software\s+is\s+provided|wtfpl|governed\s+by|under\s+(?:the\s+)?(?:cddl|epl|zlib)"
SENTENCE_HINT = HINT.replace(r"\s+", " ").replace(r"\(c\)", "^c [0-9]") + "|either version|spdx|misrepresented|advertising materials|cddl"
# Words that a licence's sentence starts with: a line with one of these starts anew.
OPENING = (
    r"licensed|released|distributed under|available under|(?:the )?mit license|(?:the )?isc license|apache license|gnu |mozilla public|"
    r"permission is hereby|permission to use|the above copyright|the software is provided|"
    r"this (?:work|program|file|project|software|code|library|source code form) is|it is licensed|you may (?:not use this|obtain a copy)|"
    r"unless required|redistributions? (?:and use|of source|in binary)|neither the name|copyright (?:\(c\)|[0-9©])|\(c\) [0-9]|all rights|no rights|spdx"
)
#: Replacements before the text is split, in this order; group 1 and 2 stay. Without lookarounds, so that any engine can do them.
STEPS = (
    (r"\r\n?", "\n", 0),
    (r"(^|\n)[ \t]*(?:#+|//+!?|/\*+|\*+/?|;+|--+|%+|>+|<!--|[-•][ \t])[ \t]*", "", 1),  # comment marks
    (r"[ \t]*(?:\*/|-->)", "", 0),
    (r"licenc(e[sd]?[^a-z])", r"licens\1", 1),
    (r"common[ \t\n]+development[ \t\n]+and[ \t\n]+distribution", "cddl", 0),
    (r"spdx-license-identifier:[ \t]*([^\n]*)", "\n\nspdx \1\n\n", 1),
    (r"[\"']?license[\"']?[ \t]*[:=][ \t]*[\"']([^\"'\n]*)[\"']", "\n\nspdx \1\n\n", 1),  # fields of package files
    (r"\n[ \t]*license[ \t]*:[ \t]*((?:mit|apache|bsd|l?gpl|agpl|mpl|isc|epl|cddl|zlib|bsl|cc0|cc-by|unlicense|wtfpl)[^\n]*)", "\n\nspdx \1\n\n", 1),
    (r"([^a-z0-9])v\.[ \t\n]*([0-9])", r"\1v \2", 2),
    (r"([^a-z](?:the|under|of|by|is|are|a|an|and|or|to|in|this))[ \t]*\n[ \t]*", r"\1 ", 1),  # such a line goes on
    (rf"\n[ \t]*({OPENING})", "\n\n\1", 1),
    (r"(public[ \t\n]+domain|rights[ \t\n]+reserved)[ \t]*\n", "\1\n\n", 1),
)
# A sentence ends at a blank line, and at . ! ? ; : before white space.
SPLIT = r"\n[ \t]*\n|[.!?;:]+[\"')\]]*[ \t\n]+"
# What lists several licences: an expression after spdx, or the names after the wording of UNDER.
EXPRESSION, NAMED = "^spdx ", f"^{UNDER}"
OPERATOR = " (?:or|and) "
LISTED, BETWEEN = f"{NAMED}.*{OPERATOR}", r" (?:and or|and|or) (?:(?:the|under|a|an|optionally|alternatively) ){0,2}"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def replacement(to: str, groups: int, mark: str) -> str:
    """What a step puts in place of a match: its groups by the engine's mark for them."""
    if groups and not to:
        return f"{mark}1"
    for k in range(1, groups + 1):
        to = to.replace(chr(k), f"{mark}{k}").replace(f"\\{k}", f"{mark}{k}")
    return to


def anchored(pattern: str) -> str:
    """Start of the sentence, whole words."""
    return f"^(?:{pattern})(?: |$)"


#: Marks a licence that a sentence names after another one.
ALSO = "+"


def one_each(normal: Column) -> Column:
    """A sentence that names several licences as one for each; those after the first are marked."""

    def of(start: str, to: str, between: str) -> Column:
        names = F.split(F.regexp_replace(normal, start, ""), between)
        return F.transform(names, lambda n, k: F.concat(F.when(k > 0, ALSO).otherwise(""), F.lit(to), n))

    expression = F.when(normal.rlike(EXPRESSION), of(EXPRESSION, "spdx ", OPERATOR))
    return expression.when(normal.rlike(LISTED), of(NAMED, "licensed under ", BETWEEN)).otherwise(F.array(normal))


def sentences(text: Column) -> Column:
    """Normalised sentences of a text as an array, one for each licence named; empty without a licence's words."""
    t = F.translate(text, UPPER, LOWER)
    for pattern, to, groups in STEPS:
        t = F.regexp_replace(t, pattern, replacement(to, groups, "$"))
    normal = F.transform(F.split(t, SPLIT), lambda s: F.regexp_replace(F.btrim(F.regexp_replace(s, r"[^a-z0-9]+", " ")), r"^[0-9]+ ", ""))
    some = F.flatten(F.transform(F.filter(normal, lambda s: s != ""), one_each))
    return F.when(text.rlike("(?i)" + HINT), some).otherwise(F.array().cast("array<string>"))


def sentence_id(normal: Column) -> Column:
    """The identifier of a normalised sentence; ``_`` for one that is none of a licence's."""
    found = F.lit("_")
    for name, pattern in reversed(SENTENCES):
        found = F.when(normal.rlike(anchored(pattern)), F.lit(name)).otherwise(found)
    return F.when(normal.rlike(SENTENCE_HINT), found).otherwise(F.lit("_"))


def in_order(names: tuple[str, ...]) -> str:
    """A rule as a pattern over identifiers between commas."""
    return f"(?:[^,]+,){{0,{GAP}}}".join(f"{',' if k == 0 else ''}{s}," for k, s in enumerate(names))


def scan_licenses(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Map normalised sentences to identifiers and match their sequence against ordered rules.

    One row per input row: ``doc_id``, ``n_sentences`` (recognised ones), ``sentence_ids`` (in
    text order, comma-joined), ``licenses`` (all licences whose rule matches, in rule order,
    comma-joined) and ``license`` (that of the first rule that matches; null if none). Of several licences
    that one sentence names, only the first can be the main one.

    Comment marks are stripped and wrapped lines joined: a sentence ends at a blank line, at a
    mark, and where a line starts a licence's wording. Sentences of one rule have to stand near
    each other, so that two licences far apart do not make a third. A sentence or expression that
    names several licences (``A OR B``, "either of A or B", "dual-licensed under A and B") counts once for
    each; British spelling is read as American.

    Only DataFrame functions and no shuffle: each text is filtered by a cheap pattern, split
    and normalised within its row. Null and empty texts have no sentence. Repeated rows and
    null ids stay, other columns are not read, an empty table gives an empty result.
    """
    named = lambda s: F.struct(s.startswith(ALSO).alias("also"), sentence_id(F.ltrim(s, F.lit(ALSO))).alias("id"))
    rows = docs.select(F.col(id).alias("doc_id"), F.transform(sentences(F.coalesce(F.col(text), F.lit(""))), named).alias("found"))
    joined = lambda ids: F.concat(F.lit(","), F.array_join(ids, ","), F.lit(","))
    rows = rows.select(
        "doc_id",
        F.filter("found.id", lambda x: x != "_").alias("own"),
        joined(F.col("found.id")).alias("ids"),
        F.when(F.exists("found", lambda x: x["also"]), joined(F.transform("found", lambda x: F.when(x["also"], "_").otherwise(x["id"])))).alias("lead"),
    )
    matched = F.array_compact(F.array(*[F.when(F.col("ids").rlike(in_order(seq)), F.lit(name)) for name, seq in RULES]))
    first = F.coalesce(*[F.when(F.col("lead").rlike(in_order(seq)), F.lit(name)) for name, seq in RULES])
    none = F.array().cast("array<string>")
    rows = rows.withColumn("m", F.when(F.size("own") > 0, F.array_distinct(matched)).otherwise(none))
    return rows.select(
        "doc_id",
        F.size("own").cast("long").alias("n_sentences"),
        F.array_join("own", ",").alias("sentence_ids"),
        F.array_join("m", ",").alias("licenses"),
        F.coalesce(first, F.get("m", F.lit(0))).alias("license"),
    )


def oracle(table: str = "documents") -> str:
    """The same in DuckDB SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    t = f"translate(x, '{UPPER}', '{LOWER}')"
    for pattern, to, groups in STEPS:
        t = f"regexp_replace({t}, {q(pattern)}, {q(replacement(to, groups, chr(92)))}, 'g')"
    case = " ".join(f"WHEN regexp_matches(s, {q(anchored(p))}) THEN {q(n)}" for n, p in SENTENCES)
    rules = ", ".join(f"CASE WHEN regexp_matches(ids, {q(in_order(seq))}) THEN {q(name)} END" for name, seq in RULES)
    return f"""
WITH given AS (SELECT doc_id, coalesce(text, '') AS x FROM {table}),
hinted AS (SELECT doc_id, CASE WHEN regexp_matches(x, {q("(?i)" + HINT)}) THEN {t} ELSE '' END AS t FROM given),
parts AS (SELECT doc_id, list_transform(string_split_regex(t, {q(SPLIT)}),
  lambda s: regexp_replace(trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')), '^[0-9]+ ', '')) AS n FROM hinted),
each AS (
  SELECT doc_id, flatten(list_transform(list_filter(n, lambda s: s <> ''), lambda s:
    CASE WHEN regexp_matches(s, {q(EXPRESSION)}) THEN list_transform(string_split_regex(regexp_replace(s, {q(EXPRESSION)}, ''), {q(OPERATOR)}), lambda m, k: CASE WHEN k > 1 THEN '+' ELSE '' END || 'spdx ' || m)
      WHEN regexp_matches(s, {q(LISTED)}) THEN list_transform(string_split_regex(regexp_replace(s, {q(NAMED)}, ''), {q(BETWEEN)}), lambda m, k: CASE WHEN k > 1 THEN '+' ELSE '' END || 'licensed under ' || m)
      ELSE [s] END)) AS n FROM parts),
marked AS (SELECT doc_id, list_transform(n, lambda s: s[1] = '+') AS also, list_transform(n, lambda s: ltrim(s, '+')) AS n FROM each),
named AS (
  SELECT doc_id, also, list_transform(n, lambda s: CASE WHEN NOT regexp_matches(s, {q(SENTENCE_HINT)}) THEN '_' {case} ELSE '_' END) AS l
  FROM marked),
seq AS (SELECT doc_id, list_filter(l, lambda y: y <> '_') AS own, ',' || array_to_string(l, ',') || ',' AS ids,
  ',' || array_to_string(list_transform(l, lambda y, k: CASE WHEN also[k] THEN '_' ELSE y END), ',') || ',' AS lead FROM named),
hit AS (SELECT *, CASE WHEN len(own) > 0 THEN list_filter([{rules}], lambda z: z IS NOT NULL) ELSE [] END AS m,
  list_filter([{rules.replace("(ids,", "(lead,")}], lambda z: z IS NOT NULL)[1] AS main FROM seq)
SELECT doc_id, CAST(len(own) AS BIGINT) AS n_sentences, coalesce(array_to_string(own, ','), '') AS sentence_ids,
       coalesce(array_to_string(list_filter(m, lambda v, i: list_position(m, v) = i), ','), '') AS licenses, coalesce(main, m[1]) AS license
FROM hit"""
