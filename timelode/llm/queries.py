"""The queries of the training-data operators, under their fixed contracts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, exact_dedup, license_scan, minmax_dedup, mixing, ngram_join, packing, pii, prefix_trie, quality_classifier, quality_rules, secret_scan, sharding
from .common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source", "repeats")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.annotate(docs, field, keep=["doc_id"])


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents")))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source stands for a host, its documents of one language for a path."""
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    found = quality_classifier.classify(docs, model, F.col("source"), F.col("lang"))
    return found.withColumnsRenamed({"host": "source", "path": "lang"})


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), [1.0] * 40).withColumn("law", F.lit("key"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source stands for an owner, its documents of one language for a repository."""
    return secret_scan.scan(table(spark, sf_dir, "documents"), F.col("source"), F.struct("source", "lang"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = prefix_trie.turn_units(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(prefix_trie.rebuilt(units))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def op13_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op")}


OP2 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
near AS (
  SELECT a, b, c = x.n AND c = y.n AS equal FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE c >= CAST(0.8 AS DOUBLE) * (x.n + y.n - c) - 1e-9),
reach AS (SELECT a, b FROM near UNION SELECT r.a, e.b FROM reach r JOIN near e ON e.a = r.b)
SELECT d.doc_id,
       least(d.doc_id, (SELECT min(b) FROM reach WHERE a = d.doc_id)) AS class_id,
       least(d.doc_id, (SELECT min(b) FROM near WHERE a = d.doc_id AND equal)) AS copy_id,
       1 + (SELECT count(*) FROM near WHERE a = d.doc_id AND equal) AS n_copies,
       (SELECT count(*) FROM near WHERE a = d.doc_id) AS n_links
FROM d
"""

OP13 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
near AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT a, b FROM near UNION SELECT r.a, e.b FROM reach r JOIN near e ON e.a = r.b),
found AS (SELECT d.doc_id, least(d.doc_id, (SELECT min(b) FROM reach WHERE a = d.doc_id)) AS component_id FROM d)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM found LEFT JOIN n USING (doc_id)
"""

OP9 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) = 1 AS kept,
       text_sha256
FROM d
"""


#: Every node as a prefix of a path of digests; sums over all ancestors of each node. DuckDB has no
#: crc32: its bits are worked out one by one.
OP11 = r"""
WITH t AS (
  SELECT conv_id, turn, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS unit,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(unit, 32), words) AS p FROM t),
ids AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(
    list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
turns AS (
  SELECT i.conv_id, 0 AS side, p, unit, words FROM ids i JOIN o ON o.conv_id = i.base WHERE p <= h
  UNION ALL SELECT i.conv_id, 1, p, unit, words FROM ids i JOIN o ON o.conv_id = i.conv_id WHERE p > h),
deep AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(unit, '') OVER w AS path, words FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY side, p)),
m AS (SELECT conv_id, depth, path, words FROM deep UNION ALL SELECT conv_id, 0, '', 0 FROM ids),
nodes AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n, any_value(words) AS words FROM m GROUP BY path, depth),
kids AS (SELECT left(path, (depth - 1) * 64) AS path, count(*) AS kids FROM nodes WHERE depth > 0 GROUP BY 1),
ends AS (SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS sha FROM (SELECT conv_id, max_by(path, depth) AS path FROM m GROUP BY conv_id) GROUP BY path),
sums AS (
  SELECT left(path, above * 64) AS path, count(*) FILTER (WHERE leaf) AS leaves, sum(saved) AS saved
  FROM (SELECT n.path, (n - 1) * words AS saved, kids IS NULL AS leaf, unnest(range(0, depth + 1)) AS above FROM nodes n LEFT JOIN kids USING (path)) GROUP BY 1)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(kids, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(sha, sha256('')) AS ends_sha256
FROM nodes n LEFT JOIN nodes up ON up.depth = n.depth - 1 AND up.path = left(n.path, (n.depth - 1) * 64) LEFT JOIN kids ON kids.path = n.path LEFT JOIN ends ON ends.path = n.path JOIN sums ON sums.path = n.path
"""

#: Every block against every template, and every place against every phrase. Written out from the
#: statement of the task, so that nothing is shared with the operator.
OP4 = r"""
WITH texts(t, label, body) AS (VALUES
  (0, 'apache', 'licensed under the apache license, version 2.0'),
  (1, 'apache', 'you may not use this file except in compliance with the license. you may obtain a copy of the license at'),
  (2, 'apache', 'unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an as is basis, without warranties or conditions of any kind'),
  (3, 'bsd', 'redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met'),
  (4, 'bsd', 'redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer'),
  (5, 'bsd', 'neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission'),
  (6, 'cc-by', 'this work is licensed under a creative commons attribution 4.0 international license'),
  (7, 'gpl', 'this work is licensed under the gnu general public license, version 3'),
  (8, 'gpl', 'you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation'),
  (9, 'gpl', 'you should have received a copy of the gnu general public license along with this program'),
  (10, 'isc', 'permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted'),
  (11, 'mit', 'released under the mit license'),
  (12, 'mit', 'permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files'),
  (13, 'mit', 'to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software'),
  (14, 'mit', 'the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software'),
  (15, 'mpl', 'this source code form is subject to the terms of the mozilla public license, v. 2.0'),
  (16, 'mpl', 'if a copy of the mpl was not distributed with this file, you can obtain one at'),
  (17, 'unlicense', 'this is free and unencumbered software released into the public domain'),
  (18, 'unlicense', 'anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary')),
inorder AS (SELECT t, label, regexp_extract_all(body, '[a-z0-9]+') AS ws FROM texts),
templates AS (SELECT t, label, list_distinct(ws) AS words, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS pairs FROM inorder),
phrases(label, words) AS (VALUES ('mit', ['mit', 'license']), ('apache', ['apache', 'license']), ('gpl', ['general', 'public', 'license'])),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
blocks AS (
  SELECT doc_id, w[b:b + 63] AS own
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 31), 32)) AS b FROM d)),
met AS (SELECT doc_id, label, words, pairs, own, len(list_intersect(words, own)) / CAST(len(words) AS DOUBLE) AS share FROM blocks, templates),
best AS (
  SELECT doc_id, label, max(share) AS share FROM met
  WHERE share >= CAST(0.8 AS DOUBLE) - 1e-9 AND len(list_intersect(pairs, list_transform(range(1, len(own)), lambda i: own[i] || ' ' || own[i + 1]))) >= CASE WHEN len(words) < 10 THEN len(pairs) ELSE ceil(len(pairs) / 2.0) END
  GROUP BY ALL),
places AS (
  SELECT doc_id, label, i - 1 AS place
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), phrases WHERE w[i:i + len(words) - 1] = words),
base AS (SELECT doc_id, count(*) AS n, min(place) AS lo, max(place) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY doc_id),
every AS (SELECT doc_id, label, share FROM best UNION ALL SELECT doc_id, label, CAST(1 AS DOUBLE) FROM places),
found AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM every GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word,
       coalesce(base.labels, '') AS base_labels, coalesce(found.labels, '') AS labels, coalesce(score, CAST(0 AS DOUBLE)) AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)
"""

#: The kinds of secrets as the task states them, then the added ones: name, pattern, group of the
#: value, its least length, what it must hold.
SECRETS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6, ()),
    ("access", "AKIA[A-Z0-9]+", 0, 20, ()),
    ("hex", "[0-9a-f]+", 0, 24, ()),
    ("bearer", r"(?i:bearer)\x20+([A-Za-z0-9._~+/=-]{20,})", 1, 20, ("[0-9]",)),
    ("forge", "gh[oprsu]_[A-Za-z0-9]{30,}", 0, 34, ()),
    ("chat", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15, ()),
    ("block", "[A-Za-z0-9+/]{32,}={0,2}", 0, 32, ("[0-9]", "[a-z]", "[A-Z]")),
)


def _op10() -> str:
    """Places from the pieces and matches before; kinds one after the other."""
    raw, steps = [], []
    for i, (name, pattern, group, least, needs) in enumerate(SECRETS):
        pattern = pattern.replace("'", "''")
        good = " AND ".join([f"length(v) >= {least}", *(f"regexp_matches(v, '{p}')" for p in needs)])
        raw.append(f"""SELECT rid, {i} AS ord, '{name}' AS kind, p0 AS start, p0 + length(m) AS stop, v FROM (
  SELECT rid, ms[i] AS m, vs[i] AS v, CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS p0
  FROM (SELECT rid, ms, vs, ps, unnest(range(1, len(ms) + 1)) AS i FROM (
    SELECT rid, regexp_extract_all(t, '{pattern}') AS ms, regexp_extract_all(t, '{pattern}', {group}) AS vs, string_split_regex(t, '{pattern}') AS ps FROM d WHERE regexp_matches(t, '{pattern}')))
  WHERE length(ms[i]) >= 6) WHERE {good}""")
        if i >= 3:
            before = "base" if i == 3 else f"upto{i - 1}"
            steps.append(f"""upto{i} AS (SELECT * FROM {before} UNION ALL SELECT * FROM raw r WHERE ord = {i} AND NOT EXISTS (SELECT 1 FROM {before} b WHERE b.rid = r.rid AND b.start < r.stop AND r.start < b.stop))""")
    listed = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, lang, coalesce(text, '') AS t FROM documents),
raw AS ({" UNION ALL ".join(raw)}),
base AS (SELECT * FROM raw WHERE ord < 3),
{", ".join(steps)},
held AS (SELECT DISTINCT v, source, lang FROM upto6 JOIN d USING (rid)),
owners AS (SELECT v, source, count(*) AS n FROM held GROUP BY v, source),
owned AS (SELECT v, count(*) AS owners, CAST(sum(n) AS BIGINT) AS repositories FROM owners GROUP BY v),
judged AS (SELECT u.*, owners, repositories, owners >= 3 OR (owners = 2 AND repositories >= 6) AS copied FROM upto6 u JOIN owned USING (v)),
per AS (
  SELECT rid, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
         {listed} FILTER (WHERE ord < 3) AS base, {listed} FILTER (WHERE ord < 3 OR NOT copied) AS spans,
         count(*) FILTER (WHERE NOT copied) AS n_live, count(*) FILTER (WHERE copied) AS n_copied, max(owners) AS most_owners, max(repositories) AS most_repositories
  FROM judged GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied,
       coalesce(most_owners, 0) AS most_owners, coalesce(most_repositories, 0) AS most_repositories
FROM d LEFT JOIN per USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_join": OP2, "op4_license_scan": OP4, "op9_exact_dedup": OP9, "op10_secret_scan": _op10(), "op11_prefix_trie": OP11, "op13_minmax_dedup": OP13}
