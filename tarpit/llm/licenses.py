"""Licence scans by sentence rules.

A text is split into sentences, each is normalised (lower case, runs of other
characters than ASCII letters and digits as one space) and mapped to the identifier
of a known licence sentence. The sequence of identifiers is then matched against
licence rules in their order, the longest texts first; what a rule matches is used
up, so one document can have several licences and a full text isn't reported as its
parts again. Sentences that speak of licences but are unknown are counted.

All of it is an expression over a row: no shuffle and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Cue words over normalised sentences; every pattern of ``SENTENCES`` needs one.
CUES = (r"licen[sc]|copyright|permission|warrant|redistribut|\bas is\b|public domain|spdx|liable|endorse|derivative|all rights reserved"
        r"|creative commons|\bcc by\b|\bcc0\b|attribution (?:noncommercial|sharealike|noderiv)")
#: The same over raw texts: whatever normalising turns into a space may stand between the
#: words. Only saves work, a text without it has no sentence with a cue.
RAW_CUES = "(?i)" + CUES.replace(r"|\b", "|(?<![a-z0-9])").replace(r"\b", "(?![a-z0-9])").replace(" ", "[^a-z0-9]+")
_WHITE = r"\x20\x09\x0B-\x0D"
_GAP = rf"[{_WHITE}*#/>-]*"
_START = (r"copyright (?:\(c\)|©|[0-9])|spdx-|permission (?:is hereby|to use)|the above copyright notice and|(?:licensed|released) under"
          r"|redistributions? (?:and use|of source|in binary)|neither the name|th(?:e|is) software is provided|in no event|all rights reserved")
#: A lower-cased text becomes one with the character 1 between its sentences, in these steps
#: (pattern, replacement). Every pattern starts at a line feed, a stop or a fixed word and
#: takes what it reads, so the time is linear. Written for Java's and RE2's common syntax.
STEPS = (
    (r"\x01", " "),
    # a line that only names the MIT licence, and lines that start a known sentence
    (rf"\n{_GAP}((?:the )?mit licen[sc]e)[\x20\x09\x0D]*(?:\n|\z)", "\x01$1\x01"),
    (rf"\n{_GAP}({_START})", "\x01$1"),
    # the end of a line with a copyright, an identifier or a licence's name
    (r"((?:copyright (?:\(c\)|©|[0-9])|spdx-license-identifier)[^\n\x01]*)(?:[\n\x01]|\z)", "$1\x01"),
    (r"((?:^|[^a-z0-9])mit licen[sc]e|all rights reserved)[\x20\x09\x0D]*\n", "$1\x01"),
    # blank lines; other lines are wrapped and go on, whatever they start with
    (rf"\n{_GAP}\n", "\x01"),
    (rf"\n{_GAP}", " "),
    # no stop: after "v." and at a semicolon before "either" or "without even"
    (r"(^|[^a-z0-9])v\.", "$1v "),
    (rf"\x3B[{_WHITE}]+(either|without[{_WHITE}]+even)", " $1"),
    (rf"""[.!?\x3B]["')\]]*[{_WHITE}]+""", "\x01"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Known sentences, as patterns over normalised sentences, first match
# counts. Written for Java's and RE2's common syntax.
SENTENCES = (
    ("spdx-mit", r"spdx license identifier mit\b"),
    ("spdx-apache2", r"spdx license identifier apache 2 0\b"),
    ("spdx-bsd3", r"spdx license identifier bsd 3 clause\b"),
    ("spdx-bsd2", r"spdx license identifier bsd 2 clause\b"),
    ("spdx-gpl2", r"spdx license identifier gpl 2 0\b"),
    ("spdx-gpl3", r"spdx license identifier gpl 3 0\b"),
    ("spdx-lgpl", r"spdx license identifier lgpl\b"),
    ("spdx-agpl3", r"spdx license identifier agpl 3 0\b"),
    ("spdx-mpl2", r"spdx license identifier mpl 2 0\b"),
    ("spdx-isc", r"spdx license identifier isc\b"),
    ("spdx-cc0", r"spdx license identifier cc0 1 0\b"),
    ("mit-grant", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit-notice", r"the above copyright notice and this permission notice shall be included"),
    ("as-is-software", r"^the software is provided as is"),
    ("as-is-holders", r"^this software is provided by .* as is"),
    ("isc-grant", r"permission to use copy modify and ?or distribute this software for any purpose"),
    ("bsd-grant", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-source", r"redistributions of source code must retain the above copyright notice"),
    ("bsd-binary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-endorse", r"^neither the name of .* may be used to endorse or promote"),
    ("no-liability", r"^in no event shall .* be liable"),
    ("apache2-by", r"licensed under the apache license version 2 0"),
    ("apache2-may-not", r"you may not use this file except in compliance with the license"),
    ("apache2-as-is", r"distributed under the license is distributed on an as is basis"),
    ("agpl3-by", r"gnu affero general public license"),
    ("lgpl-by", r"gnu (?:lesser|library) general public license"),
    ("gpl-or-later", r"gnu general public license .*either version [23] of the license or at your option any later"),
    ("gpl2-by", r"gnu general public license,? (?:v|version )2\b"),
    ("gpl3-by", r"gnu general public license,? (?:v|version )3\b"),
    ("gpl-warranty", r"without even the implied warranty of merchantability or fitness"),
    ("gpl-by", r"gnu general public license"),
    ("mpl2-by", r"mozilla public license v(?:ersion)? ?2 0"),
    ("epl2-by", r"eclipse public license v(?:ersion)? ?2 0"),
    ("cc-by-nc-nd", r"\bcc by nc nd\b|attribution noncommercial noderivatives|attribution noncommercial noderivs"),
    ("cc-by-nc-sa", r"\bcc by nc sa\b|attribution noncommercial sharealike"),
    ("cc-by-nc", r"\bcc by nc\b|attribution noncommercial"),
    ("cc-by-sa", r"\bcc by sa\b|attribution sharealike"),
    ("cc-by-nd", r"\bcc by nd\b|attribution noderivatives|attribution noderivs"),
    ("cc-by", r"\bcc by\b|creative commons attribution"),
    ("cc0", r"\bcc0\b|creative commons zero"),
    ("mit-by", r"\b(?:under|released under|licensed under|distributed under) the mit licen[sc]e\b|^(?:the )?mit licen[sc]e$"),
    ("bsd-by", r"\b(?:under|released under|licensed under|distributed under) (?:the|a) (?:[23] clause )?bsd(?: style)? licen[sc]e\b"),
    ("public-domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain"),
    ("rights", r"all rights reserved"),
    ("copyright", r"^(?:c )?copyright (?:c )?(?:by )?\S"),
)
# Licence rules over the sequence of identifiers, in order; an identifier
# is between slashes, other known sentences may stand between those of a rule.
_ANY = r"(?:[^/]*/)*?"
RULES = (
    ("MIT", f"/mit-grant/{_ANY}mit-notice/{_ANY}as-is-software/"),
    ("BSD-3-Clause", f"/bsd-grant/{_ANY}bsd-source/{_ANY}bsd-binary/{_ANY}bsd-endorse/(?:as-is-holders/)?(?:no-liability/)?"),
    ("BSD-2-Clause", f"/bsd-grant/{_ANY}bsd-source/{_ANY}bsd-binary/(?:as-is-holders/)?(?:no-liability/)?"),
    ("ISC", f"/isc-grant/(?:{_ANY}as-is-software/)?"),
    ("Apache-2.0", f"/apache2-by/(?:apache2-may-not/)?(?:{_ANY}apache2-as-is/)?"),
    ("Apache-2.0", r"/spdx-apache2/"),
    ("AGPL-3.0", r"/(?:agpl3-by|spdx-agpl3)/(?:gpl-warranty/)?"),
    ("LGPL", r"/(?:lgpl-by|spdx-lgpl)/(?:gpl-warranty/)?"),
    ("GPL-2.0", r"/(?:gpl2-by|spdx-gpl2)/(?:gpl-warranty/)?"),
    ("GPL-3.0", r"/(?:gpl3-by|spdx-gpl3)/(?:gpl-warranty/)?"),
    ("GPL-or-later", r"/gpl-or-later/(?:gpl-warranty/)?(?:gpl-by/)?"),
    ("GPL", r"/gpl-by/(?:gpl-warranty/)?"),
    ("MPL-2.0", r"/(?:mpl2-by|spdx-mpl2)/"),
    ("EPL-2.0", r"/epl2-by/"),
    ("CC-BY-NC-ND", r"/cc-by-nc-nd/"),
    ("CC-BY-NC-SA", r"/cc-by-nc-sa/"),
    ("CC-BY-NC", r"/cc-by-nc/"),
    ("CC-BY-SA", r"/cc-by-sa/"),
    ("CC-BY-ND", r"/cc-by-nd/"),
    ("CC-BY", r"/cc-by/"),
    ("CC0-1.0", r"/(?:cc0|spdx-cc0)/"),
    ("BSD-3-Clause", r"/spdx-bsd3/"),
    ("BSD-2-Clause", r"/spdx-bsd2/"),
    ("ISC", r"/spdx-isc/"),
    ("BSD", r"/bsd-by/"),
    ("MIT", r"/(?:mit-by|spdx-mit)/"),
    ("Public-Domain", r"/public-domain/"),
    ("Proprietary", r"/rights/"),
)


def sentences(text: Column) -> Column:
    """Normalised sentences that hold a cue word."""
    marked = F.translate(text, _UPPER, _LOWER)
    for pattern, to in STEPS:
        marked = F.regexp_replace(marked, pattern, to)
    parts = F.transform(F.split(marked, "\x01"), lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")))
    return F.filter(parts, lambda s: s.rlike(CUES))


def _identifier(sentence: Column) -> Column:
    out = F.when(sentence.rlike(SENTENCES[0][1]), SENTENCES[0][0])
    for name, pattern in SENTENCES[1:]:
        out = out.when(sentence.rlike(pattern), name)
    return out


def scan(text: Column) -> Column:
    """Struct of ``sequence`` (array of identifiers), ``licenses`` (array, in the order of
    the rules, without repeats) and ``n_unknown`` (sentences with a cue but unknown)."""
    state = "struct<rest:string,found:array<string>>"

    def apply(acc: Column, rule: Column) -> Column:
        hit = F.regexp_like(acc["rest"], rule["pattern"])
        # the slash that ends a match starts the next one
        return F.when(hit, F.struct(F.regexp_replace(acc["rest"], rule["pattern"], F.lit("/")).alias("rest"),
                                    F.concat(acc["found"], F.array(rule["name"])).alias("found"))).otherwise(acc)

    rules = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("pattern")) for n, p in RULES])

    def matched(ids: Column) -> Column:
        known = F.filter(ids, lambda i: i.isNotNull())
        start = F.struct(F.concat(F.lit("/"), F.array_join(known, "/"), F.lit("/")).alias("rest"), F.array().cast("array<string>").alias("found")).cast(state)
        found = F.when(F.size(known) > 0, F.aggregate(rules, start, lambda a, r: apply(a, r).cast(state))["found"]).otherwise(F.array().cast("array<string>"))
        return F.struct(known.alias("sequence"), F.array_distinct(found).alias("licenses"), (F.size(ids) - F.size(known)).cast("long").alias("n_unknown"))

    ids = F.when(text.rlike(RAW_CUES), F.transform(sentences(text), _identifier)).otherwise(F.array().cast("array<string>"))
    return F.element_at(F.transform(F.array(ids), matched), 1)


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, sentences and licenses (comma-joined), n_unknown.

    Null and empty texts have none. Rows are independent: repeated ids or rows give a row
    each, null ids stay null, an empty table gives an empty table; other columns are left
    out. The time is linear in the text, whatever its length and its runs of blanks. Of
    patterns that match a sentence, and of rules that match a sequence, the first counts.
    """
    found = docs.select(F.col(id_col).alias("doc_id"), scan(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("s"))
    return found.select("doc_id", F.array_join("s.sequence", ",").alias("sentences"), F.array_join("s.licenses", ",").alias("licenses"), "s.n_unknown")


def _sql() -> str:
    """The scan in DuckDB, by the same patterns."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    cases = " ".join(f"WHEN regexp_matches(s, {q(p)}) THEN {q(n)}" for n, p in SENTENCES)
    steps, last = [], "seq"
    for k, (name, pattern) in enumerate(RULES):
        steps.append(f"r{k} AS (SELECT * EXCLUDE (rest, found), CASE WHEN regexp_matches(rest, {q(pattern)}) THEN regexp_replace(rest, {q(pattern)}, '/', 'g') ELSE rest END AS rest, "
                     f"CASE WHEN regexp_matches(rest, {q(pattern)}) THEN list_append(found, {q(name)}) ELSE found END AS found FROM {last})")
        last = f"r{k}"
    marked = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
    for pattern, to in STEPS:
        to = " || chr(1) || ".join(f"'{x}'" for x in to.replace("$", "\\").split("\x01"))
        marked = f"regexp_replace({marked}, {q(pattern)}, {to}, 'g')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
n AS (SELECT rid, list_filter(list_transform(string_split({marked}, chr(1)), lambda s: trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'))),
                              lambda s: regexp_matches(s, {q(CUES)})) AS ss FROM d),
i AS (SELECT rid, list_transform(ss, lambda s: CASE {cases} END) AS ids FROM n),
k AS (SELECT rid, list_filter(ids, lambda x: x IS NOT NULL) AS known, len(ids) AS cues FROM i),
seq AS (SELECT rid, known, cues, '/' || array_to_string(known, '/') || '/' AS rest, []::VARCHAR[] AS found FROM k),
{", ".join(steps)},
f AS (SELECT rid, known, cues, list_filter(found, lambda x, pos: list_position(found, x) = pos) AS found FROM {last})
SELECT doc_id, coalesce(array_to_string(known, ','), '') AS sentences, coalesce(array_to_string(found, ','), '') AS licenses,
       (cues - len(known))::BIGINT AS n_unknown
FROM d JOIN f USING (rid)
"""


LICENSE_SQL = _sql()
