"""License scans: known licence sentences become identifiers, ordered rules over identifiers name the licences."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusmill.session import compute_once

#: Known sentences, normalised (lower case, words joined by one space, no marks but those inside words).
SENTENCES: dict[str, str] = {
    "licensed under the apache license version 2.0": "apache-2.0-notice",
    "you may not use this file except in compliance with the license": "apache-2.0-terms",
    "you may obtain a copy of the license at": "apache-2.0-copy",
    "released under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit-grant",
    "the software is provided as is without warranty of any kind": "mit-warranty",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0-notice",
    "this program is free software": "gpl-free",
    "you can redistribute it and/or modify it under the terms of the gnu general public license": "gpl-terms",
    "either version 3 of the license or at your option any later version": "gpl-3.0-or-later",
    "licensed under cc by-nc 4.0": "cc-by-nc-4.0-notice",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd-grant",
    "redistributions of source code must retain the above copyright notice": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used": "bsd-name",
}

#: Whole sentences of the standard texts, or long parts of them, normalised: so long that they count at any place of a paragraph.
FULL_SENTENCES: dict[str, str] = {
    "licensed under the apache license version 2.0 the license": "apache-2.0-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
    " the software to deal in the software without restriction including without limitation the rights to use copy modify merge"
    " publish distribute sublicense and/or sell copies of the software and to permit persons to whom the software is furnished to do"
    " so subject to the following conditions": "mit-grant",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of"
    " merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "this program is free software": "gpl-free",
    "you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software"
    " foundation": "gpl-terms",
    "either version 3 of the license or at your option any later version": "gpl-3.0-or-later",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following"
    " conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in"
    " the documentation and/or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived"
    " from this software without specific prior written permission": "bsd-name",
    "neither the name of the university nor the names of its contributors may be used to endorse or promote products derived"
    " from this software without specific prior written permission": "bsd-name",
}

#: Rules in order of rank: a licence holds where its identifiers occur in this order (others may lie between).
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("GPL-3.0-or-later", ("gpl-free", "gpl-terms", "gpl-3.0-or-later")),
    ("GPL-3.0-only", ("gpl-3.0-notice",)),
    ("Apache-2.0", ("apache-2.0-notice",)),
    ("Apache-2.0", ("apache-2.0-terms", "apache-2.0-copy")),
    ("MIT", ("mit-grant", "mit-warranty")),
    ("MIT", ("mit-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4.0-notice",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
)


def paragraphs(text: str) -> Column:
    """Normalised text: sentences end with a form feed, their lines with a line feed.

    Cut after ``.``, ``!``, ``?``, ``:``, ``;`` before white space, and at blank lines; other line ends may lie within a sentence.
    """
    pieces = F.split(F.lower(F.col(text)), r"[.!?:;]+(?:\s|\z)|\n\s*\n")
    words = F.transform(pieces, lambda s: F.trim(F.regexp_replace(s, r"[^a-z0-9./+\n-]+", " ")))
    lines = F.transform(words, lambda s: F.when(F.contains(s, F.lit("\n")), F.regexp_replace(s, r" *\n *", "\n")).otherwise(s))
    return F.concat(F.lit("\f"), F.array_join(lines, "\f"), F.lit("\f"))


def _places(run: str, flat: str, known: Mapping[str, str], full: Mapping[str, str]) -> Column:
    """Known sentences of ``run`` as structs (at, upto, id): ``known`` from a line's or sentence's start to such an end, ``full`` from word to word.

    ``flat`` is ``run`` with its lines joined. Of sentences within a longer one only the longer one is given.
    """
    wanted = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(i).alias("id"), F.lit(ends).alias("ends"))
                       for table, ends in ((known, "\f\n"), (full, "\f\n ")) for s, i in table.items()])

    def places(k: Column) -> Column:
        size = F.length(k["s"])
        gaps = F.transform(F.split(F.col(flat), F.concat(F.lit(r"\Q"), k["s"], F.lit(r"\E"))), lambda x: F.length(x))
        starts = F.aggregate(gaps, F.array().cast("array<int>"), lambda a, x: F.concat(a, F.array(
            F.coalesce(F.try_element_at(a, F.lit(-1)) + size, F.lit(1)) + x)))  # the last one is the end of the text
        bounded = F.filter(F.slice(starts, 1, F.size(starts) - 1), lambda at: F.contains(k["ends"], F.substring(run, at - 1, F.lit(1)))
                           & F.contains(k["ends"], F.substring(run, at + size, F.lit(1))))
        return F.transform(bounded, lambda at: F.struct(at.alias("at"), (at + size).alias("upto"), k["id"].alias("id")))

    return F.array_sort(F.flatten(F.transform(F.filter(wanted, lambda k: F.contains(F.col(flat), k["s"])), places)))


def in_order(found: str, wanted: Sequence[str]) -> Column:
    """Whether ``found`` (array) has the wanted identifiers as a subsequence: each one after the place of the one before."""
    steps = F.array(*[F.lit(w) for w in wanted])
    # The state counts how many of the wanted ones were met so far.
    met = F.aggregate(found, F.lit(0), lambda n, x: n + (F.get(steps, n).eqNullSafe(x)).cast("int"))
    return met == len(wanted)


def scan_licenses(docs: DataFrame, text: str = "text", known: Mapping[str, str] = SENTENCES,
                  rules: Sequence[tuple[str, Sequence[str]]] = RULES, full: Mapping[str, str] = FULL_SENTENCES) -> DataFrame:
    """``docs`` without ``text``, plus ``sentence_ids`` (known sentences in order), ``licenses`` (sorted, distinct) and ``n_licenses``.

    Every known sentence is looked for in a whole text, also where its lines are wrapped: those of ``known`` must fill a sentence
    or whole lines of it, those of ``full`` may have other words before and behind them in their paragraph. Both are
    part of the plan, so the scan is a projection: no shuffle and no Python. Null and empty texts have no sentence and no licence;
    rows are never dropped; repeated rows get equal results; columns with the names of results are replaced. An empty table stays empty.
    """
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in (text, "sentence_ids", "licenses", "n_licenses")]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = compute_once(docs.select(*keep, body.alias("__text")), {"__run": paragraphs("__text")})
    rows = compute_once(rows.drop("__text"), {"__flat": F.replace("__run", F.lit("\n"), F.lit(" "))})
    rows = compute_once(rows, {"__places": _places("__run", "__flat", known, full)}).drop("__run", "__flat")
    outer = F.filter("__places", lambda x: ~F.exists("__places", lambda y: (y["at"] <= x["at"]) & (y["upto"] >= x["upto"])
                                                     & (y["upto"] - y["at"] > x["upto"] - x["at"])))
    # A sentence that both tables hold is met twice at its place.
    rows = compute_once(rows, {"sentence_ids": F.transform(F.array_distinct(outer), lambda x: x["id"])}).drop("__places")
    named = F.array(*[F.when(in_order("sentence_ids", wanted), F.lit(name)) for name, wanted in rules])
    licenses = F.array_sort(F.array_distinct(F.filter(named, lambda x: x.isNotNull())))
    return rows.withColumn("licenses", F.when(F.size("sentence_ids") > 0, licenses).otherwise(F.array().cast("array<string>"))).withColumn(
        "n_licenses", F.size("licenses").cast("long"))
