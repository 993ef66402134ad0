"""License scans by sentence rules, with DataFrame functions only.

Each text is split into sentences at full stops and blank lines, so a sentence may be wrapped over lines. Sentences are
normalised and searched for what licences say, with any subject before it, and the resulting sequence of identifiers is matched against ordered rules; the first rule that fits names
the licence; an SPDX identifier names itself. Everything happens inside one row, so the scan has no shuffle at all.

Defined cases: a null or empty text has no sentence and no licence; texts are scanned whole; repeated rows
are scanned one by one; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UNDER = r"(?<!not )(?:released|licen[sc]ed|distributed|published|available|modify it) under (?:(?:the |a )?(?:terms(?: and conditions)?|conditions) of )?(?:the |a |an )?"
_GPL = _UNDER + r"(?:gnu )?(?:general public licen[sc]e|gpl)(?: gpl)?(?: as published by the free software foundation)?(?: either)? ?(?:version |v ?)?"
_CC4 = r"(?! (?:nc|nd|sa|non ?commercial|no ?deriv\w*|share ?alike|(?:licen[sc]e )?(?:version )?[123] [0-9])\b)"
#: Sentence identifier, and a pattern within a normalised sentence (lower case, words parted by one space).
SENTENCES = (
    ("spdx", r"spdx licen[sc]e identifier [a-z0-9]+"),
    ("apache2", _UNDER + r"apache (?:software )?licen[sc]e (?:version |v ?)?2 0"),
    ("mit", _UNDER + r"(?:mit|expat) licen[sc]e"),
    ("mitgrant", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("gpl3", _GPL + r"3(?: 0)?"),
    ("gpl2", _GPL + r"2(?: 0)?"),
    ("gplany", r"this (?:program|work|software|library) is free software .*gnu general public licen[sc]e"),
    ("orlater", r"any later version"),
    ("lgpl", _UNDER + r"gnu (?:lesser|library) general public licen[sc]e"),
    ("bsdredist", r"redistribution and use in source and binary forms"),
    ("bsdnames", r"neither the names? of .*may be used to endorse"),
    ("ccbync", _UNDER + r"(?:cc by nc|creative commons attribution non ?commercial)" + _CC4),
    ("ccbysa", _UNDER + r"(?:cc by sa|creative commons attribution share ?alike)" + _CC4),
    ("ccby", _UNDER + r"(?:cc by|creative commons attribution)" + _CC4),
    ("mpl2", rf"(?:subject to the terms of the |{_UNDER})mozilla public licen[sc]e (?:mpl )?(?:version |v ?)?2 0"),
    ("rights", r"all rights reserved"),
    ("nowarranty", r"(?:this|the) software is provided .*as is"),
)
#: Licence and a pattern over the sequence of identifiers, each followed by a comma; in order. An SPDX identifier comes before them.
RULES = (
    ("GPL-3.0-or-later", r"gpl3,(\w+,)*orlater,"),
    ("GPL-3.0", r"gpl3,"),
    ("GPL-2.0-or-later", r"gpl2,(\w+,)*orlater,"),
    ("GPL-2.0", r"gpl2,"),
    ("GPL", r"gplany,"),
    ("LGPL", r"lgpl,"),
    ("Apache-2.0", r"apache2,"),
    ("MIT", r"mit,|mitgrant,(\w+,)*nowarranty,|mitgrant,"),
    ("BSD-3-Clause", r"bsdredist,(\w+,)*bsdnames,"),
    ("BSD-2-Clause", r"bsdredist,"),
    ("CC-BY-NC-4.0", r"ccbync,"),
    ("CC-BY-SA-4.0", r"ccbysa,"),
    ("CC-BY-4.0", r"ccby,"),
    ("MPL-2.0", r"mpl2,"),
    ("Proprietary", r"rights,"),
)
#: A sentence of any licence holds one of these; the others need no look-up.
HINT = r"licen[sc]|spdx|permission|software|reserved|redistribution|later|endorse|\bunder\b"
#: Lines without a letter or digit part sentences, and marks at a word's end but for that of "v. 2"; a single line end does not.
END = r"\n(?:[^\p{L}\p{N}\n]*\n)+|(?<![^\p{L}\p{N}][vV])[.!?](?=\s|$)"
_NAME = r"\(*[A-Za-z0-9][A-Za-z0-9.+:-]*\)*"
SPDX = rf"(?i)spdx[\s-]+licen[sc]e[\s-]+identifier\s*:?\s*({_NAME}(?:[ \t]+(?-i:OR|AND|WITH)[ \t]+{_NAME})*)"


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), r"[^a-z0-9]+", " "))


def sentence_ids(sentence: Column) -> Column:
    """Identifiers of all that a sentence says, in the order of SENTENCES."""
    said = F.array(*(F.when(sentence.rlike(f"(?:^| )(?:{pattern})(?: |$)"), F.lit(name)) for name, pattern in SENTENCES))
    return F.filter(said, lambda s: s.isNotNull())


def spdx(text: Column) -> Column:
    """First SPDX identifier or expression of a text, without marks around it."""
    got = F.rtrim(F.regexp_extract(text, SPDX, 1), F.lit(".:"))
    return F.when(got.contains("("), got).otherwise(F.rtrim(got, F.lit(").:")))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (of licences: a sentence that says two things counts for both), sentence_ids (in order, joined by commas) and license (null: none)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    parts = F.filter(F.split(text, END), lambda s: F.lower(s).rlike(HINT))
    known = F.flatten(F.transform(parts, lambda s: sentence_ids(normalised(s))))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.array_join(F.transform(known, lambda s: F.concat(s, F.lit(","))), "").alias("ids"), spdx(text).alias("spdx"))
    name = F.lit(None).cast("string")
    for licence, pattern in reversed(RULES):
        name = F.when(F.col("ids").rlike(rf"(^|,)({pattern})"), licence).otherwise(name)
    name = F.when(F.col("spdx") != "", F.col("spdx")).otherwise(name)
    commas = F.length("ids") - F.length(F.regexp_replace("ids", ",", ""))
    return found.select("doc_id", commas.cast("long").alias("n_sentences"), F.rtrim("ids", F.lit(",")).alias("sentence_ids"), name.alias("license"))
