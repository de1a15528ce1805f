"""License scans by sentence rules (DataFrame functions only).

A text is cut into sentences, each normalised (lower case, runs of other
characters than letters and digits as one space) and mapped to the identifier of
a known licence sentence. What a text holds of them, in order, is a sequence of
identifiers, against which the ordered rules are tried; the first rule that fits
names the licence.

Two things in a sentence are slots. A holder's name ('neither the name of ... nor')
counts as 'the copyright holder'. The names of licences (``NAMES``) are replaced by
marks, so that any sentence that puts something under one or several of them
('licensed under L', 'dual licensed under either L or L at your option') is one known
sentence, ``Under``, with the licences it names; several of them are alternatives.
An SPDX tag is read as it stands: its expression, of whatever identifiers with OR, AND
and WITH, is the licence; the expressions of several tags hold together.

Sentences end at ``. ! ? ; :`` before white space. A text is read three ways: lines
end sentences too; line ends are spaces, but blank lines (also behind the ``*`` of a
comment) and copyright lines end a paragraph; all line ends are spaces. Marks inside
known sentences ('v. 2.0', 'Foundation; either') end none. Of readings that the same
rule fits the first counts.

``license`` names what comes first of: SPDX tags, alternatives, rules. ``licenses`` are
all that the text names, of each family (BSD, GPL 3, ...) the first rule that fits.

Only texts that hold one of ``TRIGGERS`` are cut. Each is part of one word, so a
raw text holds it however its words are spaced or wrapped; every known sentence
holds one, so nothing is lost (a test asserts it on raw texts). All is one expression
over a row: one scan, nothing shuffled or joined. ``OP5_SQL`` is the same function.

Defined cases: null and empty texts hold nothing; equal rows (doc_id and text)
give equal results; an empty table gives an empty result; other columns are not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from amity.llm.common import documents

#: Known licence sentences, normalised, and their identifiers.
SENTENCES = (
    ("licensed under the apache license version 2 0", "Apache2Short"),
    ("licensed under the apache license version 2 0 the license", "Apache2Short"),
    ("you may not use this file except in compliance with the license", "Apache2Comply"),
    ("you may obtain a copy of the license at", "LicenseAt"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is "
     "distributed on an as is basis without warranties or conditions of any kind either express or implied", "Apache2AsIs"),
    ("see the license for the specific language governing permissions and limitations under the license", "Apache2See"),
    ("released under the mit license", "MITShort"),
    ("licensed under the mit license", "MITShort"),
    ("this project is licensed under the mit license", "MITShort"),
    ("the mit license", "MITShort"),
    ("mit license", "MITShort"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction including without limitation the "
     "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
     "persons to whom the software is furnished to do so subject to the following conditions", "MITPermission"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions "
     "of the software", "MITNotice"),
    ("the software is provided as is without warranty of any kind express or implied including but not limited to the "
     "warranties of merchantability fitness for a particular purpose and noninfringement", "MITAsIs"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
     "granted provided that the above copyright notice and this permission notice appear in all copies", "ISCPermission"),
    ("permission to use copy modify and distribute this software for any purpose with or without fee is hereby "
     "granted provided that the above copyright notice and this permission notice appear in all copies", "ISCPermission"),
    ("permission to use copy modify and distribute this software and its documentation for any purpose with or without "
     "fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
     "ISCPermission"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met", "BSDGrant"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following "
     "disclaimer", "BSDSource"),
    ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
     "following disclaimer in the documentation and or other materials provided with the distribution", "BSDBinary"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
     "products derived from this software without specific prior written permission", "BSDEndorse"),
    ("licensed under the bsd 3 clause license", "BSD3Short"),
    ("licensed under the bsd 2 clause license", "BSD2Short"),
    ("this work is licensed under the gnu general public license version 3", "GPL3Short"),
    ("licensed under the gnu general public license version 3", "GPL3Short"),
    ("licensed under the gnu general public license version 2", "GPL2Short"),
    ("this work is licensed under the gnu general public license version 2", "GPL2Short"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
     "license as published by the free software foundation either version 3 of the license or at your option any "
     "later version", "GPL3Grant"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
     "free software foundation either version 3 of the license or at your option any later version", "GPL3Grant"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
     "free software foundation either version 2 of the license or at your option any later version", "GPL2Grant"),
    ("this program is distributed in the hope that it will be useful but without any warranty without even the implied "
     "warranty of merchantability or fitness for a particular purpose", "GPLHope"),
    ("without even the implied warranty of merchantability or fitness for a particular purpose", "GPLImplied"),
    ("see the gnu general public license for more details", "GPLSee"),
    ("you should have received a copy of the gnu general public license along with this program", "GPLCopy"),
    ("you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by "
     "the free software foundation either version 2 1 of the license or at your option any later version", "LGPL21Grant"),
    ("licensed under the gnu lesser general public license version 3", "LGPL3Short"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "MPL2"),
    ("licensed under the mozilla public license version 2 0", "MPL2"),
    ("licensed under cc by 4 0", "CCBY4"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "CCBY4"),
    ("licensed under cc by sa 4 0", "CCBYSA4"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "CCBYSA4"),
    ("licensed under cc by nc 4 0", "CCBYNC4"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "CCBYNC4"),
    ("licensed under cc by nd 4 0", "CCBYND4"),
    ("licensed under cc0 1 0", "CC0"),
    ("this is free and unencumbered software released into the public domain", "Unlicense"),
    ("released into the public domain", "PublicDomain"),
    ("all rights reserved", "AllRights"),
)
#: Names of licences in a normalised sentence, longer ones first, and
#: the licence.
NAMES = (
    (r"(?:the )?gnu lesser general public license(?: version| v) ?2 1(?: or (?:at your option )?(?:any )?later(?: version)?)", "LGPL-2.1-or-later"),
    (r"(?:the )?gnu lesser general public license(?: version| v) ?2 1", "LGPL-2.1-only"),
    (r"(?:the )?(?:gnu lesser general public license(?: version| v) ?3|lgpl ?v? ?3)(?: 0)?", "LGPL-3.0-only"),
    (r"(?:the )?gnu affero general public license(?: version| v) ?3(?: 0)?", "AGPL-3.0-only"),
    (r"(?:the )?(?:gnu general public license(?: version| v) ?3|gpl ?v? ?3)(?: 0)?(?: or (?:at your option )?(?:any )?later(?: version)?)", "GPL-3.0-or-later"),
    (r"(?:the )?(?:gnu general public license(?: version| v) ?3|gpl ?v? ?3)(?: 0)?(?: only)?", "GPL-3.0-only"),
    (r"(?:the )?(?:gnu general public license(?: version| v) ?2|gpl ?v? ?2)(?: 0)?(?: or (?:at your option )?(?:any )?later(?: version)?)", "GPL-2.0-or-later"),
    (r"(?:the )?(?:gnu general public license(?: version| v) ?2|gpl ?v? ?2)(?: 0)?(?: only)?", "GPL-2.0-only"),
    (r"(?:the )?apache(?: software)? license(?: version)?(?: v)? ?2(?: 0)?|(?:the )?apache ?2(?: 0)?(?: license)?", "Apache-2.0"),
    (r"(?:the )?mozilla public license(?: version)?(?: v)? ?2(?: 0)?|(?:the )?mpl ?2(?: 0)?", "MPL-2.0"),
    (r"(?:the )?(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd)(?: license)?", "BSD-3-Clause"),
    (r"(?:the )?(?:bsd 2 clause|2 clause bsd|simplified bsd)(?: license)?", "BSD-2-Clause"),
    (r"(?:the )?mit(?: license)?", "MIT"),
    (r"(?:the )?isc license", "ISC"),
)
#: Ordered rules, a pattern over ``,id,id,``, the licence and its
#: family. A gap of other identifiers between two that a rule names is ``,(\w+,)*``.
RULES = (
    (r",BSDGrant,(\w+,)*BSDSource,(\w+,)*BSDBinary,(\w+,)*BSDEndorse,", "BSD-3-Clause", "BSD"),
    (r",BSDGrant,(\w+,)*BSDSource,(\w+,)*BSDBinary,", "BSD-2-Clause", "BSD"),
    (r",MITPermission,(\w+,)*MITNotice,", "MIT", "MIT"),
    (r",ISCPermission,", "ISC", "ISC"),
    (r",GPL3Grant,(\w+,)*(GPLHope|GPLImplied|GPLSee|GPLCopy),", "GPL-3.0-or-later", "GPL3"),
    (r",GPL2Grant,(\w+,)*(GPLHope|GPLImplied|GPLSee|GPLCopy),", "GPL-2.0-or-later", "GPL2"),
    (r",LGPL21Grant,", "LGPL-2.1-or-later", "LGPL2"),
    (r",Apache2Short,", "Apache-2.0", "Apache"),
    (r",Apache2Comply,(\w+,)*Apache2AsIs,", "Apache-2.0", "Apache"),
    (r",GPL3Short,", "GPL-3.0-only", "GPL3"),
    (r",GPL2Short,", "GPL-2.0-only", "GPL2"),
    (r",GPL3Grant,", "GPL-3.0-or-later", "GPL3"),
    (r",GPL2Grant,", "GPL-2.0-or-later", "GPL2"),
    (r",LGPL3Short,", "LGPL-3.0-only", "LGPL3"),
    (r",MPL2,", "MPL-2.0", "MPL"),
    (r",MITShort,", "MIT", "MIT"),
    (r",BSD3Short,", "BSD-3-Clause", "BSD"),
    (r",BSD2Short,", "BSD-2-Clause", "BSD"),
    (r",CCBYNC4,", "CC-BY-NC-4.0", "CC"),
    (r",CCBYSA4,", "CC-BY-SA-4.0", "CC"),
    (r",CCBYND4,", "CC-BY-ND-4.0", "CC"),
    (r",CCBY4,", "CC-BY-4.0", "CC"),
    (r",CC0,", "CC0-1.0", "CC0"),
    (r",Unlicense,", "Unlicense", "public"),
    (r",PublicDomain,", "public-domain", "public"),
    *[(rf",Under_L{i}_,", name, f"named{i}") for i, (_, name) in enumerate(NAMES)],
    (r",BSDEndorse,", "BSD-3-Clause", "BSD"),
    (r",MITAsIs,", "MIT", "MIT"),
    (r",AllRights,", "proprietary", "reserved"),
)
TRIGGERS = ("licen", "permission", "redistribut", "copyright", "warrant", "reserved", "domain", "gpl")
SENTENCE_END = r"[.!?;:]+(?:\s+|$)"
OTHER = r"[^a-z0-9]+"
#: Marks before white space inside known sentences; they do not end one.
INNER_MARKS = ((r"(\bmozilla[^a-z0-9]+public[^a-z0-9]+license[^a-z0-9]+v)\.(\s+2\.0)", 2),
               (r"(\bneither[^a-z0-9]+the[^a-z0-9]+names?[^a-z0-9]+of[^.!?;:]{1,100})\.([^a-z0-9]+nor\b)", 2),
               (r"(\bfree[^a-z0-9]+software[^a-z0-9]+foundation)[;:]([^a-z0-9]+either\b)", 2))
#: A line without a letter or digit, and a copyright line: ends of a paragraph.
BLANK_LINE = r"\n[^\p{L}\p{N}\n]*\n"
COPYRIGHT_LINE = r"(?m)^([^\p{L}\p{N}\n]*(?:copyright\s*(?:\(c\)|©|[0-9]{4})|\(c\)\s*[0-9]{4}|©)[^\n]*)$"
HOLDER = (r"^(.* )?neither the names? of .+ nor the names of (?:its|the|their) contributors may",
          "neither the name of the copyright holder nor the names of its contributors may")
#: A sentence that puts something under licences, after their names became marks.
MARKED = r"L[0-9]+_"
UNDER = (r"\b(?:licensed|licenced|released|distributed|available|published|provided|use)\b.* under (?:the )?(?:terms of )?(?:the )?"
         r"(?:either |any |both )?(?:of )?(L[0-9]+_(?:(?: or| and| either| of)* L[0-9]+_)*)")
#: An SPDX tag and its expression as written.
SPDX_ID = r"\(?[A-Za-z0-9][A-Za-z0-9.+-]*\)?"
SPDX = (r"(?i:\bspdx[^A-Za-z0-9]{1,3}license[^A-Za-z0-9]{1,3}identifier)\s*[:=]?\s*"
        rf"({SPDX_ID}(?:\s+(?:OR|AND|WITH)\s+{SPDX_ID})*)")
READINGS = 3


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(sentence, OTHER, " "))


def _known() -> Column:
    """Map of the known sentences."""
    return F.create_map(*[F.lit(x) for sentence, name in dict(SENTENCES).items() for x in (sentence, name)])


def _identifier(known: Column, sentence: Column) -> Column:
    """Identifier of a normalised sentence, null for an unknown one."""
    marked = F.regexp_replace(sentence, *HOLDER)
    exact = F.try_element_at(known, marked)
    for i, (name, _) in enumerate(NAMES):
        marked = F.regexp_replace(marked, rf"\b(?:{name})(?: license)?\b", f"L{i}_")
    group = F.regexp_extract(marked, UNDER, 1)
    under = F.when(group != "", F.concat(F.lit("Under_"), F.array_join(F.regexp_extract_all(group, F.lit(MARKED), F.lit(0)), "")))
    return F.coalesce(exact, F.when(sentence.contains("under"), under))


def _sentences(low: Column) -> list[Column]:
    """The three readings of a lower-cased text, as arrays of raw sentences."""
    for pattern, _ in INNER_MARKS:
        low = F.regexp_replace(low, pattern, "$1 $2")
    return [F.split(low, SENTENCE_END + r"|\n"),
            F.split(F.regexp_replace(low, COPYRIGHT_LINE, "\n\n$1\n\n"), SENTENCE_END + "|" + BLANK_LINE),
            F.split(F.replace(low, F.lit("\n"), F.lit(" ")), SENTENCE_END)]


def _likely(text: Column) -> Column:
    held = F.lit(False)
    for t in TRIGGERS:
        held = held | text.contains(t)
    return held


def _rule(ids: Column) -> Column:
    """Number of the first rule that fits; the number of rules if none does."""
    rule = F.lit(len(RULES))
    for i, (pattern, _, _) in reversed(list(enumerate(RULES))):
        rule = F.when(ids.rlike(pattern), F.lit(i)).otherwise(rule)
    return F.when(ids == ",,", F.lit(len(RULES))).otherwise(rule)


def _all_that_fit(ids: Column) -> Column:
    """Names by rules, of each family the first that fits."""
    fits, names = {}, []
    for pattern, name, family in RULES[:-1]:
        now = ids.rlike(pattern)
        names.append(F.when(now & ~fits[family] if family in fits else now, F.lit(name)))
        fits[family] = fits[family] | now if family in fits else now
    found = F.filter(F.array(*names), lambda x: x.isNotNull())
    last = F.when(ids.rlike(RULES[-1][0]), F.array(F.lit(RULES[-1][1]))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(found) > 0, found).otherwise(last)


def license_scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, license (null: none found), licenses (all that
    are named, comma-joined), sequence (the identifiers of the reading that a rule
    fitted first, else of the first), n_sentences (known sentences of that
    reading and SPDX tags)."""
    low = F.lower("text")
    tags = F.when(F.instr(low, "spdx") > 0, F.array_distinct(F.transform(
        F.regexp_extract_all("text", F.lit(SPDX), F.lit(1)), lambda x: F.regexp_replace(x, r"\s+", " "))))
    df = docs.select("doc_id", F.coalesce(tags, F.array().cast("array<string>")).alias("spdx"),
                     F.when(_likely(low), low).alias("low"))
    known = _known()
    for r, cut in enumerate(_sentences(F.col("low")), start=1):
        likely = F.filter(cut, _likely)
        ids = F.filter(F.transform(likely, lambda x: _identifier(known, normalised(x))), lambda x: x.isNotNull())
        df = df.withColumn(f"ids{r}", F.coalesce(F.concat(F.lit(","), F.array_join(ids, ","), F.lit(",")), F.lit(",,")))
    rules = [F.struct(_rule(F.col(f"ids{r}")).alias("rule"), F.lit(r).alias("reading"), F.col(f"ids{r}").alias("ids"))
             for r in range(1, READINGS + 1)]
    # of readings without a rule, the first that holds a known sentence
    silent = F.when(F.col("best.rule") == len(RULES), F.coalesce(
        *[F.when(F.col(f"ids{r}") != ",,", F.col(f"ids{r}")) for r in range(1, READINGS + 1)], F.lit(",,"))).otherwise(F.col("best.ids"))
    df = df.withColumn("best", F.least(*rules)).withColumn("ids", silent)
    several = F.regexp_extract("ids", r"Under_(L[0-9]+_(?:L[0-9]+_)+)", 1)
    names = F.array(*[F.lit(name) for _, name in NAMES])
    named = F.transform(F.regexp_extract_all(several, F.lit("L([0-9]+)_"), F.lit(1)), lambda i: F.get(names, i.cast("int")))
    either = F.when(several != "", F.array_join(F.array_distinct(named), " OR "))
    df = df.withColumn("either", either)
    first = F.get(F.array(*[F.lit(name) for _, name, _ in RULES]), F.col("best.rule"))
    alternatives = F.when(F.col("either").isNotNull(), F.array("either")).otherwise(F.array().cast("array<string>"))
    every = F.array_distinct(F.concat("spdx", alternatives, _all_that_fit(F.col("ids"))))
    shown = F.trim(F.translate("ids", ",", " "))
    return df.select(
        "doc_id", F.coalesce(F.when(F.size("spdx") > 0, F.array_join("spdx", " AND ")), "either", first).alias("license"),
        F.array_join(every, ", ").alias("licenses"), shown.alias("sequence"),
        (F.size("spdx") + F.size(F.filter(F.split(shown, " "), lambda x: x != ""))).cast("long").alias("n_sentences"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir).select("doc_id", "text"))


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = "map {" + ", ".join(f"{quote(s)}: {quote(i)}" for s, i in dict(SENTENCES).items()) + "}"
    likely = lambda x: "(" + " or ".join(f"contains({x}, {quote(t)})" for t in TRIGGERS) + ")"
    marks = "low"
    for pattern, _ in INNER_MARKS:
        marks = f"regexp_replace({marks}, {quote(pattern)}, '\\1 \\2', 'g')"
    cuts = [f"string_split_regex(m, {quote(SENTENCE_END + chr(124) + chr(92) + 'n')})",
            f"string_split_regex(regexp_replace(m, {quote(COPYRIGHT_LINE)}, chr(10) || chr(10) || '\\1' || chr(10) || chr(10), 'g'), "
            f"{quote(SENTENCE_END + '|' + BLANK_LINE)})",
            f"string_split_regex(replace(m, chr(10), ' '), {quote(SENTENCE_END)})"]
    unions = " union all ".join(
        f"select doc_id, {r} as reading, unnest({cut}) as raw, generate_subscripts({cut}, 1) as pos from marked"
        for r, cut in enumerate(cuts, start=1))
    slots = "held"
    for i, (name, _) in enumerate(NAMES):
        slots = f"regexp_replace({slots}, {quote(f'{chr(92)}b(?:{name})(?: license)?{chr(92)}b')}, 'L{i}_', 'g')"
    rules = " ".join(f"when regexp_matches(ids, {quote(p)}) then {i}" for i, (p, _, _) in enumerate(RULES))
    firsts = " ".join(f"when {i} then {quote(n)}" for i, (_, n, _) in enumerate(RULES))
    names = "[" + ", ".join(quote(n) for _, n in NAMES) + "]"
    fits, every = {}, []
    for pattern, name, family in RULES[:-1]:
        before = "".join(f" and not regexp_matches(ids, {quote(p)})" for p in fits.setdefault(family, []))
        every.append(f"case when regexp_matches(ids, {quote(pattern)}){before} then {quote(name)} end")
        fits[family].append(pattern)
    return f"""
with marked as (
  select doc_id, {marks} as m from (select doc_id, lower(text) as low from documents) where {likely('low')}),
cut as ({unions}),
norm as (
  select doc_id, reading, pos, trim(regexp_replace(raw, {quote(OTHER)}, ' ', 'g')) as s from cut where {likely('raw')}),
held as (select *, regexp_replace(s, {quote(HOLDER[0])}, {quote(HOLDER[1])}, 'g') as held from norm),
slotted as (
  select *, case when contains(s, 'under') then regexp_extract({slots}, {quote(UNDER)}, 1) else '' end as grp
  from held),
found as (
  select doc_id, reading, pos, coalesce(element_at({known}, held)[1],
         case when grp <> '' then 'Under_' || array_to_string(regexp_extract_all(grp, {quote(MARKED)}), '') end) as id
  from slotted),
sequences as (
  select doc_id, reading, ',' || string_agg(id, ',' order by pos) || ',' as ids from found where id is not null group by doc_id, reading),
ruled as (select *, case {rules} else {len(RULES)} end as rule from sequences),
best as (select *, row_number() over (partition by doc_id order by rule, reading) as k from ruled),
tagged as (
  select doc_id, list_distinct(tags) as some, list_filter(tags, lambda x, i: list_position(tags, x) = i) as spdx
  from (select doc_id, case when contains(lower(text), 'spdx') then
               list_transform(regexp_extract_all(text, {quote(SPDX)}, 1), lambda x: regexp_replace(x, '\\s+', ' ', 'g')) else [] end as tags
        from documents)),
per as (
  select t.doc_id, coalesce(spdx, []) as spdx, coalesce(ids, ',,') as ids, coalesce(rule, {len(RULES)}) as rule,
         regexp_extract(coalesce(ids, ''), 'Under_(L[0-9]+_(?:L[0-9]+_)+)', 1) as several
  from tagged t left join best b on b.doc_id = t.doc_id and b.k = 1),
alt as (
  select *, case when several <> '' then list_transform(regexp_extract_all(several, 'L([0-9]+)_', 1), lambda x: {names}[x::int + 1]) end as alts,
         list_filter([{', '.join(every)}], lambda x: x is not null) as fit
  from per),
out as (
  select *, array_to_string(list_filter(alts, lambda x, i: list_position(alts, x) = i), ' OR ') as either,
         case when len(fit) > 0 then fit when regexp_matches(ids, {quote(RULES[-1][0])}) then [{quote(RULES[-1][1])}] else [] end as fitting
  from alt),
joined as (
  select *, list_concat(list_concat(spdx, case when several <> '' then [either] else [] end), fitting) as named from out)
select doc_id,
       case when len(spdx) > 0 then array_to_string(spdx, ' AND ') when several <> '' then either
            else case rule {firsts} end end as license,
       array_to_string(list_filter(named, lambda x, i: list_position(named, x) = i), ', ') as licenses,
       trim(replace(ids, ',', ' ')) as sequence,
       (len(spdx) + len(list_filter(string_split(trim(replace(ids, ',', ' ')), ' '), lambda x: x <> '')))::bigint as n_sentences
from joined
"""


OP5_SQL = _oracle()
