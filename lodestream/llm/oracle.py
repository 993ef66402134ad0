"""DuckDB SQL for the operators that SQL can express; the others are held against brute force in the tests."""

from __future__ import annotations

from .url_filter import LAST
from .url_filter import RULES as URL_RULES

#: Of op2's SQL, which knows one-line phrases only; license_scan has the rules for whole licence texts.
SENTENCES = (
    ("spdx", r"spdx license identifier .+"),
    ("apache2", r"licensed under the apache license( version)? 2 0( the license)?"),
    ("mit", r"(released|licensed|distributed) under (the )?(terms of the )?mit license"),
    ("mitgrant", r"permission is hereby granted free of charge to any person obtaining a copy .*"),
    ("gpl3", r"(this work is licensed|licensed|released|distributed) under the gnu general public license version 3( 0)?"),
    ("gpl2", r"(this work is licensed|licensed|released|distributed) under the gnu general public license version 2( 0)?"),
    ("gplany", r"this (program|work) is free software .*gnu general public license.*"),
    ("orlater", r"(or at your option any later version|.* any later version)"),
    ("lgpl", r"(this work is licensed|licensed|released|distributed) under the gnu lesser general public license.*"),
    ("bsdredist", r"redistribution and use in source and binary forms .*"),
    ("bsdnames", r"neither the name of .* may be used to endorse .*"),
    ("ccbync", r"licensed under (a )?(cc by nc|creative commons attribution noncommercial)( 4 0)?( international)?( license)?"),
    ("ccbysa", r"licensed under (a )?(cc by sa|creative commons attribution sharealike)( 4 0)?( international)?( license)?"),
    ("ccby", r"licensed under (a )?(cc by|creative commons attribution)( 4 0)?( international)?( license)?"),
    ("mpl2", r".*subject to the terms of the mozilla public license v(ersion)? ?2 0.*"),
    ("rights", r"(.* )?all rights reserved"),
    ("nowarranty", r"(this|the) software is provided .*as is.*"),
)
RULES = (
    ("SPDX", r"spdx,"),
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
HINT = r"licen[sc]|spdx|permission|software|rights reserved|redistribution|later version|endorse"

_WORD = r"[^\x20\x09-\x0D]+"


def _components(vertices: str, links: str) -> str:
    """component of each id of ``vertices`` (id); ``links`` (a, b) holds each link both ways."""
    return f"reach AS (SELECT id, id AS c FROM ({vertices}) UNION SELECT l.b, r.c FROM reach r JOIN {links} l ON l.a = r.id), comp AS (SELECT id, min(c) AS component_id FROM reach GROUP BY id)"


def _op1() -> str:
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
links AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
{_components("SELECT vec_id AS id FROM embeddings", "links")}
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN comp ON comp.id = e.vec_id"""


def _case(column: str, pairs, otherwise: str = "NULL", whole: bool = False) -> str:
    return "CASE " + " ".join(f"WHEN {f'regexp_full_match({column}, ' if whole else f'regexp_matches({column}, '}'{p}') THEN '{n}'" for n, p in pairs) + f" ELSE {otherwise} END"


def _op2() -> str:
    # RE2 has no look-ahead: a mark is first moved to a line end of its own
    return rf"""
WITH parts AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '[.;:!?](\s)', chr(10) || '\1', 'g'), '[.;:!?]$', chr(10)), chr(10))) AS s,
  generate_subscripts(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '[.;:!?](\s)', chr(10) || '\1', 'g'), '[.;:!?]$', chr(10)), chr(10)), 1) AS pos FROM documents),
norm AS (SELECT doc_id, pos, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) AS s FROM parts WHERE regexp_matches(lower(s), '{HINT}')),
known AS (SELECT doc_id, pos, {_case("s", SENTENCES, whole=True)} AS k FROM norm),
seq AS (SELECT doc_id, count(k) AS n, string_agg(k, ',' ORDER BY pos) AS ids FROM known WHERE k IS NOT NULL GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(ids, '') AS sentence_ids, {_case("coalesce(ids || ',', '')", [(n, f"(^|,)({p})") for n, p in RULES])} AS license
FROM documents d LEFT JOIN seq USING (doc_id)"""


def _op3() -> str:
    by_length = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [(f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))", h + p, says) for says, h, p in by_length]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {c} THEN '{s}'" for c, _, s in fits) + " END"
    return rf"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, {rule} AS rule, {verdict} AS said, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '[0-9]') OR length(s) > 32 THEN '*' || regexp_extract(s, '(\.[A-Za-z]{{1,5}})$', 1) ELSE s END) AS seg FROM p),
shapes AS (SELECT host, seg, count(said) AS n, count(*) FILTER (said = 'block') AS k FROM r GROUP BY host, seg),
steps AS (SELECT host, seg, n, i, seg[1:i] AS prefix FROM (SELECT *, unnest(range(1, len(seg) + 1)) AS i FROM shapes)),
branches AS (SELECT host, prefix FROM steps GROUP BY host, prefix HAVING sum(n) > 0),
reached AS (SELECT host, seg, max(i) AS known FROM steps JOIN branches USING (host, prefix) GROUP BY host, seg),
named AS (SELECT s.*, list_concat(seg[1:coalesce(known, 0)], list_transform(range(coalesce(known, 0), len(seg)), lambda i: '*?')) AS names FROM shapes s LEFT JOIN reached USING (host, seg)),
tree AS (SELECT host, seg, n, k, array_to_string(list_transform(names, lambda x: '/' || x), '') AS template FROM named),
nodes AS (SELECT host, template, sum(n) AS n, sum(k) AS k, CASE WHEN sum(n) > 0 AND sum(n) < 20 AND regexp_matches(template, '{LAST}') THEN regexp_replace(template, '{LAST}', '\1/*?~\3') END AS kin FROM tree GROUP BY host, template),
few AS (SELECT host, kin, sum(k) / sum(n) AS p FROM nodes WHERE kin IS NOT NULL GROUP BY ALL),
alike AS (SELECT nodes.*, CASE WHEN abs(k / n - p) <= 1.96 * sqrt(p * (1 - p) / n) THEN nodes.kin ELSE template END AS t FROM nodes LEFT JOIN few ON few.host = nodes.host AND few.kin = nodes.kin),
pooled AS (SELECT host, t, sum(n) AS n, sum(k) AS k FROM alike GROUP BY ALL),
hosts AS (SELECT host, (sum(k) + 1) / (sum(n) + 2) AS prior FROM pooled GROUP BY host),
bad AS (SELECT host, t, (k + 10 * prior) / (n + 10) >= 0.8 AND n >= 20 AS bad FROM pooled JOIN hosts USING (host))
SELECT page_id, r.host, path, rule, coalesce(said, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict
FROM r JOIN tree ON r.host = tree.host AND r.seg = tree.seg JOIN alike ON alike.host = tree.host AND alike.template = tree.template JOIN bad ON bad.host = alike.host AND bad.t = alike.t"""


def _op5() -> str:
    return rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 3.0::DOUBLE * sum(size) AS most, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS weight FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS pos,
  (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
l AS (SELECT arg_min(level, pos) AS level FROM o WHERE level * weight <= most),
t AS (SELECT source, source_size, coalesce(least(most, l.level * weight), most) AS target FROM o LEFT JOIN l ON true),
r AS (SELECT *, CASE WHEN source_size > 0 THEN least(3.0, target / source_size) ELSE 0 END AS rate FROM t),
u AS (SELECT d.*, source_size, target, rate, ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
k AS (SELECT range AS k, range / 64.0::DOUBLE AS turn FROM range(64)),
sums AS (SELECT source, k, turn, any_value(target) AS target, any_value(source_size) * floor(any_value(rate)) + coalesce(sum(size) FILTER (u + turn - floor(u + turn) < rate - floor(rate)), 0) AS taken FROM u, k GROUP BY source, k, turn),
best AS (SELECT source, turn FROM sums QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(taken - target), k) = 1)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u + turn - floor(u + turn) < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM u JOIN best ON u.source IS NOT DISTINCT FROM best.source"""


def _op7() -> str:
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
links AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
{_components("SELECT doc_id AS id FROM documents", "links")}
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN comp ON comp.id = d.doc_id"""


def _op8() -> str:
    return rf"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
win AS (SELECT doc_id, i, w[i:i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
again AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2, i + 3, i + 4]) AS p FROM again) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM w) WHERE regexp_matches(l, '{_WORD}') GROUP BY doc_id),
c AS (SELECT w.doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS k FROM f WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT sum(k) / sum(n) AS m, greatest(var_pop(k / n) - avg(k / n * (1 - k / n) / n), 0) AS v FROM h),
s AS (SELECT m, CASE WHEN v <= m * (1 - m) / 1001 THEN 1000 ELSE greatest(1, m * (1 - m) / v - 1) END AS s FROM p),
v AS (SELECT source, (k + m * s) / (n + s) <= 0.5 OR n < 20 AS good FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(good, true) AS kept FROM f LEFT JOIN v USING (source)"""


def _op12() -> str:
    # every row is asked at every step of every order: no cells
    return rf"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
  100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(first < w.doc_id, false)] AS f FROM w LEFT JOIN l USING (doc_id)),
a AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM a, a b, a c, a d, a e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, list_transform(range(1, step), lambda i: ascii(filter_order[i]) - 64) AS before, (ascii(filter_order[step]) - 64) AS own FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM o)),
r AS (SELECT part, filter_order, step, own, good, toxic, f[own] AS fails, len(list_filter(before, lambda i: f[i])) > 0 AS gone, len(list_filter(f, lambda x: x)) AS n FROM f, s),
g AS (SELECT part, filter_order, step, own, count(*) FILTER (NOT gone AND NOT fails) AS kept, count(*) FILTER (NOT gone AND fails) AS removed, count(*) FILTER (gone AND fails) AS redundant,
  count(*) FILTER (fails AND n = 1) AS unique_fails, count(*) FILTER (NOT gone AND fails AND good) AS good_lost, count(*) FILTER (NOT gone AND fails AND toxic) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM g"""


def _op13() -> str:
    return """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5"""


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_near_dedup": _op1(), "op2_license_scan": _op2(), "op3_url_filter": _op3(), "op5_mixing": _op5(), "op7_ngram_jaccard_join": _op7(), "op8_quality_rules": _op8(), "op12_filter_interaction_audit": _op12(), "op13_hard_negative_mining": _op13()}
