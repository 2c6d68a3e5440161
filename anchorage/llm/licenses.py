"""Operator 10 - license scans by ordered signature rules, in DataFrame functions alone.

A text is lower-cased and falls into words (runs of ASCII letters, digits and characters beyond
ASCII); joined by single blanks they are what rules are matched against. A rule is a regular
expression with a keyword (and for a family's rules the words of its names) that each of its matches
contains, a label and a priority. A text that
holds no rule's gate word is done; in the others only the rules whose keyword stands in the text are
run. Matches are sorted by start, longest first; one inside another is dropped (of equal ones the
higher priority stays), and of two that overlap the one with the higher priority stays, else the
first.

Cases: a null or empty text has no words, no labels and score 0; a repeated row is scanned alike; a
null doc_id is kept; an empty table gives no rows; other columns are ignored; very long texts are
scanned whole, in one fold over their matches that keeps the last match and the labels so far.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: License families - label, names in normalised words, versions.
FAMILIES = (
    ("mit", "mit|expat|x11", ()),
    ("apache", "apache", ("1 0", "1 1", "2 0")),
    ("gpl", "gnu general public|gnu gpl|gpl", ("1", "2", "3", "1 0", "2 0", "3 0")),
    ("lgpl", "gnu lesser general public|gnu library general public|lesser gpl|lgpl", ("2", "3", "2 0", "2 1", "3 0")),
    ("agpl", "gnu affero general public|affero general public|affero gpl|agpl", ("1", "3", "1 0", "3 0")),
    ("gfdl", "gnu free documentation|gfdl", ("1 1", "1 2", "1 3")),
    ("bsd", "bsd|new bsd|modified bsd|simplified bsd|revised bsd|berkeley software distribution", ()),
    ("bsd-2-clause", "bsd 2 clause|2 clause bsd|two clause bsd|freebsd", ()),
    ("bsd-3-clause", "bsd 3 clause|3 clause bsd|three clause bsd", ()),
    ("bsd-4-clause", "bsd 4 clause|4 clause bsd|original bsd", ()),
    ("0bsd", "0bsd|zero clause bsd|bsd zero clause", ()),
    ("mpl", "mozilla public|mpl", ("1 0", "1 1", "2 0")),
    ("epl", "eclipse public|epl", ("1 0", "2 0")),
    ("cddl", "common development and distribution|cddl", ("1 0", "1 1")),
    ("cpl", "common public|cpl", ("1 0",)),
    ("ipl", "ibm public", ("1 0",)),
    ("eupl", "european union public|eupl", ("1 0", "1 1", "1 2")),
    ("isc", "isc|internet systems consortium", ()),
    ("zlib", "zlib|zlib libpng", ()),
    ("libpng", "libpng|png reference library", ("1", "2")),
    ("artistic", "artistic|perl artistic", ("1 0", "2 0")),
    ("bsl", "boost software|bsl", ("1 0",)),
    ("busl", "business source|busl", ("1 1",)),
    ("sspl", "server side public|sspl", ("1",)),
    ("elastic", "elastic", ("1 0", "2 0")),
    ("unlicense", "unlicense|the unlicense", ()),
    ("wtfpl", "wtfpl|do what the fuck you want to public", ("2",)),
    ("cc0", "cc0|creative commons zero|cc zero", ("1 0",)),
    ("cc-by", "cc by|creative commons attribution", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", "cc by sa|creative commons attribution share ?alike", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", "cc by nc|creative commons attribution non ?commercial", ("2 0", "3 0", "4 0")),
    ("cc-by-nd", "cc by nd|creative commons attribution no ?derivatives", ("2 0", "3 0", "4 0")),
    ("cc-by-nc-sa", "cc by nc sa|creative commons attribution non ?commercial share ?alike", ("3 0", "4 0")),
    ("cc-by-nc-nd", "cc by nc nd|creative commons attribution non ?commercial no ?derivatives", ("3 0", "4 0")),
    ("ofl", "sil open font|open font|ofl", ("1 0", "1 1")),
    ("odbl", "open database|odbl", ("1 0",)),
    ("odc-by", "open data commons attribution|odc by", ("1 0",)),
    ("pddl", "open data commons public domain dedication|pddl", ("1 0",)),
    ("psf", "python software foundation|psf", ("2",)),
    ("php", "php", ("3 0", "3 01")),
    ("ruby", "ruby", ()),
    ("w3c", "w3c software|w3c", ()),
    ("ms-pl", "microsoft public|ms pl", ()),
    ("ms-rl", "microsoft reciprocal|ms rl", ()),
    ("afl", "academic free|afl", ("2 0", "2 1", "3 0")),
    ("osl", "open software|osl", ("1 0", "2 0", "2 1", "3 0")),
    ("ncsa", "university of illinois ncsa|ncsa", ()),
    ("postgresql", "postgresql", ()),
    ("openssl", "openssl", ()),
    ("qpl", "q public|qpl", ("1 0",)),
    ("upl", "universal permissive|upl", ("1 0",)),
    ("mulan", "mulan psl|mulan permissive software", ("1", "2")),
    ("beerware", "beer ?ware", ()),
    ("json", "json", ()),
    ("curl", "curl", ()),
    ("openrail", "openrail|open rail|responsible ai", ()),
)

#: Sentences of license texts - label, keyword, pattern.
SENTENCES = (
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy(?: of this software)?"),
    ("mit", "the above copyright notice", "the above copyright notice and this permission notice shall be included in all copies"),
    ("mit", "without warranty of any kind", "the software is provided as is without warranty of any kind"),
    ("isc", "permission to use", "permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "neither the name", "neither the name of (?:the |its )?[^ ]+(?: [^ ]+){0,12} may be used to endorse or promote"),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software must display"),
    ("gpl", "free software", "this program is free software you can redistribute it and or modify it under the terms"),
    ("gpl", "you should have received", "you should have received a copy of the gnu general public license"),
    ("lgpl", "free software", "this library is free software you can redistribute it and or modify it under the terms"),
    ("lgpl", "lesser", "you should have received a copy of the gnu lesser general public license"),
    ("agpl", "affero", "you should have received a copy of the gnu affero general public license"),
    ("gpl", "either version", "either version 2 (?:of the license )?or at your option any later version"),
    ("apache-2.0", "apache org licenses", "(?:http|https)? ?www apache org licenses license 2 0"),
    ("apache-2.0", "you may not use this file", "you may not use this file except in compliance with the license"),
    ("mpl-2.0", "mozilla org mpl", "mozilla org mpl 2 0"),
    ("mpl", "source code form", "this source code form is subject to the terms of the mozilla public license"),
    ("epl", "eclipse public license", "made available under the terms of the eclipse public license"),
    ("zlib", "altered source versions", "altered source versions must be plainly marked as such"),
    ("zlib", "without any express or implied", "provided as is without any express or implied warranty"),
    ("bsl-1.0", "boost software license", "distributed under the boost software license version 1 0"),
    ("unlicense", "public domain", "this is free and unencumbered software released into the public domain"),
    ("public-domain", "public domain", "(?:released|dedicated|placed) (?:in|in to|into|to) the public domain"),
    ("proprietary", "all rights reserved", "all rights reserved"),
    ("proprietary", "proprietary and confidential", "proprietary and confidential"),
    ("proprietary", "unauthorized copying", "unauthorized copying of this file(?: via any medium)? is strictly prohibited"),
    ("cc-by", "creativecommons org licenses", "creativecommons org licenses by [1-4] 0"),
    ("cc-by-sa", "creativecommons org licenses", "creativecommons org licenses by sa [1-4] 0"),
    ("cc-by-nc", "creativecommons org licenses", "creativecommons org licenses by nc [1-4] 0"),
    ("cc0", "creativecommons org publicdomain", "creativecommons org publicdomain zero 1 0"),
    ("gpl", "gnu org licenses", "www gnu org licenses gpl(?: html)?"),
    ("lgpl", "gnu org licenses", "www gnu org licenses lgpl(?: html)?"),
    ("wtfpl", "do what the fuck", "you just do what the fuck you want to"),
    ("ofl", "font software", "this font software is licensed under the sil open font license"),
)


def rules() -> list[dict]:
    """The rules in order: sentences, then for each family and version the forms in which it is named."""
    out = []

    def add(label, keyword, pattern, priority, names=()):
        out.append({"label": label, "keyword": keyword, "names": list(names), "pattern": f"(?<= )(?:{pattern})(?= )", "priority": priority})

    for label, keyword, pattern in SENTENCES:
        add(label, keyword, pattern, 90)
    for label, names, versions in FAMILIES:
        name = f"(?:{names})"
        plain = [max(n.replace(" ?", " ").split(), key=len) for n in names.split("|")]
        add(label, "licen", rf"(?:dual |re)?licen[sc]ed under (?:the )?(?:terms of the )?{name}(?: licen[sc]e)?", 70, plain)
        add(label, "licen", rf"{name} licen[sc]e(?: agreement)?", 50, plain)
        add(label, "licen", rf"licen[sc]e(?: type)?(?: is)? {name}", 40, plain)
        add(label, "spdx", rf"spdx license identifier {label.replace('-', ' ')}(?: only| or later)?", 95)
        for version in versions:
            dotted = f"{label}-{version.replace(' ', '.')}"
            add(dotted, "licen", rf"(?:licen[sc]ed under (?:the )?(?:terms of the )?)?{name} licen[sc]e (?:version |v )?v?{version}", 80, plain)
            add(dotted, version, rf"{name} (?:version |v )?v?{version}", 60, plain)
    return out


RULES = rules()
#: A text without any of these words' beginnings meets no rule.
GATES = ("licen", "copyright", "spdx", "warrant", "redistribut", "public domain", "permission", "rights reserved", "unauthorized", "proprietary", "free software", "creativecommons", "gnu org", "mozilla", "eclipse", "apache", "altered source", "font software", "what the fuck", "materials mentioning", "neither the name", "source code form", "either version", "you may not use", *(n for _, names, versions in FAMILIES if versions for n in names.replace(" ?", " ").split("|")))

_RULE_TYPE = "array<struct<label:string,keyword:string,names:array<string>,pattern:string,priority:int>>"
_NO_MATCH = "cast(null as struct<start:int,stop:int,priority:int,label:string>)"


def _places(padded: Column, phrase: str) -> tuple[Column, Column, Column]:
    """Number of places of a phrase's words, and the first and last word it starts at."""
    doubled = F.replace(padded, F.lit(" "), F.lit("  "))
    wide = f" {phrase.replace(' ', '  ')} "
    n = ((F.length(doubled) - F.length(F.replace(doubled, F.lit(wide), F.lit("")))) / len(wide)).cast("long")
    word = lambda upto: F.length(upto) - F.length(F.replace(upto, F.lit(" "), F.lit(""))) - 1
    first = F.locate(f" {phrase} ", padded)
    back = F.locate(f" {phrase} "[::-1], F.reverse(padded))
    last = F.length(padded) - back - len(phrase)
    return n, word(F.substring(padded, F.lit(1), first)).cast("long"), word(F.substring(padded, F.lit(1), last)).cast("long")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    body = F.trim(F.regexp_replace(F.lower("text"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    rows = rows.select("doc_id", body.alias("body"))
    n_words = F.when(F.col("body") == "", F.lit(0)).otherwise(F.length("body") - F.length(F.replace("body", F.lit(" "), F.lit(""))) + 1)
    gate = F.lit(False)
    for word in dict.fromkeys(GATES):
        if not any(word != g and g in word for g in GATES):
            gate = gate | F.contains("body", F.lit(word))
    # the text goes on only where a rule may match
    rows = rows.select("doc_id", n_words.cast("long").alias("n_words"), F.when(gate, F.concat(F.lit(" "), "body", F.lit(" "))).alias("padded"))

    known = F.from_json(F.lit(json.dumps(RULES)), _RULE_TYPE)
    tried = F.filter(known, lambda r: F.contains(F.col("padded"), r["keyword"]) & ((F.size(r["names"]) == 0) | F.exists(r["names"], lambda n: F.contains(F.col("padded"), n))))
    rows = rows.withColumn("tried", F.when(F.col("padded").isNotNull(), tried))
    # the matches of a rule: pieces between them and their own lengths add up to their places
    matches = F.expr(
        """flatten(transform(tried, r -> if(regexp_like(padded, r.pattern),
             aggregate(
               zip_with(split(padded, r.pattern, -1), regexp_extract_all(padded, r.pattern, 0), (g, m) -> named_struct('gap', length(g), 'size', length(m))),
               named_struct('at', 0, 'found', cast(array() as array<struct<start:int,longest:int,rank:int,stop:int,priority:int,label:string>>)),
               (acc, x) -> if(x.size is null, acc, named_struct('at', acc.at + x.gap + x.size,
                 'found', array_append(acc.found, named_struct('start', acc.at + x.gap, 'longest', -(acc.at + x.gap + x.size), 'rank', -r.priority,
                                                               'stop', acc.at + x.gap + x.size, 'priority', r.priority, 'label', r.label)))),
               acc -> acc.found),
             cast(array() as array<struct<start:int,longest:int,rank:int,stop:int,priority:int,label:string>>))))"""
    )
    rows = rows.withColumn("matches", F.when(F.size("tried") > 0, F.sort_array(matches)))
    fold = F.expr(
        f"""aggregate(matches,
             named_struct('last', {_NO_MATCH}, 'labels', cast(array() as array<string>), 'n', 0L, 'best', 0),
             (acc, x) -> case
               when acc.last is null or x.start >= acc.last.stop then named_struct(
                 'last', named_struct('start', x.start, 'stop', x.stop, 'priority', x.priority, 'label', x.label),
                 'labels', if(acc.last is null, acc.labels, array_union(acc.labels, array(acc.last.label))),
                 'n', acc.n + if(acc.last is null, 0L, 1L), 'best', greatest(acc.best, coalesce(acc.last.priority, 0)))
               when x.stop > acc.last.stop and x.priority > acc.last.priority then named_struct(
                 'last', named_struct('start', x.start, 'stop', x.stop, 'priority', x.priority, 'label', x.label),
                 'labels', acc.labels, 'n', acc.n, 'best', acc.best)
               else acc end,
             acc -> named_struct('labels', if(acc.last is null, acc.labels, array_union(acc.labels, array(acc.last.label))),
               'n', acc.n + if(acc.last is null, 0L, 1L), 'best', greatest(acc.best, coalesce(acc.last.priority, 0))))"""
    )
    rows = rows.withColumn("kept", F.when(F.size("matches") > 0, fold))
    total, firsts, lasts, labels = F.lit(0).cast("long"), [], [], []
    for phrase, label in sorted(BASE, key=lambda b: b[1]):
        n, first, last = _places(F.col("padded"), phrase)
        here = F.coalesce(F.contains("padded", F.lit(f" {phrase} ")), F.lit(False))
        total = total + F.when(here, n).otherwise(F.lit(0).cast("long"))
        firsts.append(F.when(here, first))
        lasts.append(F.when(here, last))
        labels.append(F.when(here, F.lit(label)))
    base = F.array_compact(F.array(*labels))
    every = F.array_sort(F.array_union(base, F.coalesce(F.col("kept.labels"), F.array().cast("array<string>"))))
    sure = F.greatest(F.coalesce(F.col("kept.best"), F.lit(0)), F.when(F.size(base) > 0, F.lit(50)).otherwise(F.lit(0)))
    return rows.select(
        "doc_id", "n_words", total.alias("n_base"), F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), (sure / 100.0).cast("double").alias("score"),
        F.coalesce(F.col("kept.n"), F.lit(0).cast("long")).alias("n_detections"),
    )


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License detections of all documents."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
