"""Queries opN_<name> over the driver's tables, each by its operator with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_pairs, collocations, decontaminate, jaccard, language, licenses, merkle, pieces, quality, revisits, secrets, substrings, tokens


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer's file; read where it is, never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents")).drop("longest_repeat")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_report(table(spark, sf_dir, "documents"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_digests(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=2)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op9_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisits.revisit_report(table(spark, sf_dir, "pages"))


def op10_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op11_byte_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_pairs.byte_digests(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_manifest(table(spark, sf_dir, "documents"))


def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op2_license_scan: its columns but those of the method's own labels and score."""
    return op2_license_scan(spark, sf_dir).drop("labels", "score")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}
    return {k: found[k] for k in sorted(found, key=lambda k: int(k[2:].split("_")[0]))} | {"license_phrases": license_phrases}


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_scan": OP1, "license_phrases": PHRASES, "op3_substring_dedup": OP3, "op4_quality_rules": OP4, "op8_jaccard_join": OP8, "op9_revisits": OP9, "op12_collocations": OP12, "op13_merkle_manifest": OP13}


def _secret_sql() -> str:
    """Spans of a kind from what lies between its matches; a UNION ALL part a kind."""
    either = lambda words: "(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in words) + ")"
    names = either(["password", "passwd", "secret", "token", "api_?key"])
    kinds = [
        ("assign", names + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
        ("access", "AKIA[A-Z0-9]+", 0, 16),
        ("hex", "[0-9a-f]+", 0, 32),
        ("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
        ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
        ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
        ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 1),
        ("bearer", either(["bearer"]) + r"\x20+[A-Za-z0-9._~+/-]{16,}=*", 0, 1),
        ("url_password", r"[a-z]{2,10}://[A-Za-z0-9._-]{1,64}:[^\x09-\x0D :@/]{3,64}@[A-Za-z0-9.-]+", 0, 1),
    ]
    found = " UNION ALL ".join(f"SELECT r, {k} AS k, '{kind}' AS kind, {least} AS least, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS hits, regexp_extract_all(t, '{p}', {g}) AS parts FROM d" for k, (kind, p, g, least) in enumerate(kinds))
    listed = "string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({found}),
each AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM found),
span AS (
  SELECT r, k, kind, a, a + length(hits[i]) AS b FROM (
    SELECT *, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a FROM each WHERE length(parts[i]) >= least)
), by_doc AS (
  SELECT r, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex, {listed} FILTER (WHERE k < 3) AS base, {listed} AS spans, count(*) AS n_spans FROM span GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_spans, 0) AS n_spans FROM d LEFT JOIN by_doc ON by_doc.r = d.r
"""


OP1 = _secret_sql()
#: Windows of 400 bytes by their digest; runs of those that stand twice, and what is left between them.
PHRASES = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), runs AS (
  SELECT r, unnest(range(len(w))) AS place, unnest(w) AS a, unnest(w[2:] || ['']) AS b, unnest(w[3:] || ['', '']) AS c, unnest(w[4:] || ['', '', '']) AS e FROM d WHERE len(w) > 0
), found AS (
  SELECT r, place, CASE WHEN (a, b, c, e) = ('gnu', 'general', 'public', 'license') THEN 'gpl' WHEN (a, b) = ('apache', 'license') THEN 'apache' WHEN (a, b) = ('cc', 'by') THEN 'cc-by' WHEN (a, b) = ('mit', 'license') THEN 'mit' END AS label FROM runs
), by_doc AS (
  SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM found WHERE label IS NOT NULL GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels FROM d LEFT JOIN by_doc ON by_doc.r = d.r
"""

OP3 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, strlen(t) AS n, hex(encode(t)) AS h FROM documents),
w AS (SELECT r, i, md5_number(substr(h, CAST(2 * i + 1 AS BIGINT), 800)) AS m FROM (SELECT r, h, unnest(range(0, n - 399)) AS i FROM d WHERE n >= 400)),
again AS (SELECT r, i FROM w QUALIFY count(*) OVER (PARTITION BY m) > 1),
run AS (SELECT r, min(i) AS a, max(i) + 400 AS b FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM again)) GROUP BY r, g),
part AS (SELECT r, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS a, a AS b FROM run UNION ALL SELECT d.r, coalesce(t.b, 0), d.n FROM d LEFT JOIN (SELECT r, max(b) AS b FROM run GROUP BY r) t ON t.r = d.r),
kept AS (SELECT part.r, string_agg(substr(h, CAST(2 * a + 1 AS BIGINT), CAST(2 * (b - a) AS BIGINT)), '' ORDER BY a) AS h FROM part JOIN d ON d.r = part.r GROUP BY part.r),
sums AS (SELECT r, sum(b - a) AS removed, count(*) AS spans FROM run GROUP BY r),
word AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS l FROM d),
passage AS (SELECT r, i FROM (SELECT r, i, md5_number(array_to_string(list_slice(l, i, i + 50), ' ')) AS m FROM (SELECT r, l, unnest(range(1, len(l) - 49)) AS i FROM word WHERE len(l) >= 51)) QUALIFY count(*) OVER (PARTITION BY m) > 1),
words AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 51)) AS j FROM passage) GROUP BY r)
SELECT doc_id, d.n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256, coalesce(words.n, 0) AS n_repeat_words
FROM d JOIN kept ON kept.r = d.r LEFT JOIN sums ON sums.r = d.r LEFT JOIN words ON words.r = d.r
"""


#: A word lies in a repeat of at least 8 words if and only if an 8-word window around it stands twice in its document, and a repeat
#: of more than 100 words is there if and only if a 101-word window stands twice.
OP4 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT unnest([3, 8, 101]) AS k),
win AS (SELECT doc_id, k, i, md5(array_to_string(list_slice(w, i, i + k - 1), ' ')) AS h FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, k)),
dup AS (SELECT doc_id, k, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k, h) > 1),
cov AS (SELECT doc_id, k, count(DISTINCT j) AS n FROM (SELECT doc_id, k, unnest(range(i, i + k)) AS j FROM dup) GROUP BY doc_id, k),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines,
    coalesce(c3.n, 0) AS n_repeat_words, coalesce(c8.n, 0) AS n_covered_words, c101.n IS NOT NULL AS long_repeat
  FROM d LEFT JOIN lines ON lines.doc_id = d.doc_id LEFT JOIN cov c3 ON c3.doc_id = d.doc_id AND c3.k = 3 LEFT JOIN cov c8 ON c8.doc_id = d.doc_id AND c8.k = 8 LEFT JOIN cov c101 ON c101.doc_id = d.doc_id AND c101.k = 101
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_covered_words <= 30 * n_words AND NOT long_repeat AS kept, n_covered_words
FROM m
"""
OP8 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' ')))) END AS g FROM d
), c AS (
  SELECT min(doc_id) AS c, g, len(g) AS n FROM s WHERE len(g) > 0 GROUP BY g
), e AS (
  SELECT c, n, unnest(g) AS x FROM c
), p AS (
  SELECT a.c AS a, b.c AS b FROM e a JOIN e b ON a.x = b.x AND a.c < b.c AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), both_ AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r(c, o) AS (SELECT c, c FROM c UNION SELECT r.c, both_.b FROM r JOIN both_ ON both_.a = r.o)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, coalesce(k.least, s.doc_id) AS component_id FROM s LEFT JOIN c ON c.g = s.g LEFT JOIN (SELECT c, min(o) AS least FROM r GROUP BY c) k ON k.c = c.c
"""
OP9 = r"""
WITH a AS (
  SELECT page_id, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages
), b AS (
  SELECT page_id, html, bare,
    list_sort(list_filter(string_split(regexp_extract(bare, '^[^?]*\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_'))) AS query
  FROM a
), c AS (
  SELECT page_id, html, '"' || substr(sha256(coalesce(html, '')), 1, 16) || '"' AS tag,
    regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^.*@', ''), ':(80|443)$', ''), '^www\.', '')
      || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '')
      || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END AS key
  FROM b
), d AS (
  SELECT r.page_id, r.key, r.tag, max(f.page_id) AS answer FROM c r LEFT JOIN c f ON f.key = r.key AND f.page_id < 2 * r.page_id GROUP BY ALL
), e AS (
  SELECT d.*, f.tag AS stored, f.html AS body,
    CASE WHEN answer IS NULL THEN 'orphan' WHEN d.page_id % 7 = 0 THEN 'unvalidated' WHEN d.tag = f.tag THEN 'resolved' ELSE 'mismatch' END AS outcome
  FROM d LEFT JOIN c f ON f.page_id = d.answer
)
SELECT page_id, key AS canonical_url, outcome, coalesce(answer, -1) AS answer_page_id,
  CASE WHEN outcome = 'resolved' THEN 'content-length=' || strlen(coalesce(body, '')) || ';date=' || 2 * page_id || ';etag=' || CASE WHEN page_id % 5 = 0 THEN 'W/' ELSE '' END || tag || ';x-cache=hit' END AS headers,
  CASE WHEN outcome = 'resolved' THEN sha256(body) END AS body_sha256
FROM e
"""
#: Phrases of all lengths by slices of the pieces' words; both shorter ones of a phrase of equal count are left out.
OP12 = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM t)),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
g AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest(range(1, 6)) AS k))),
f AS (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
over AS (SELECT lang, phrase, max(n) AS n FROM (SELECT lang, n, unnest([array_to_string(w[1:k - 1], ' '), array_to_string(w[2:k], ' ')]) AS phrase FROM c WHERE k > 2) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN over ON over.lang = c.lang AND over.phrase = c.phrase WHERE over.n IS NULL OR over.n < c.n),
cut AS (SELECT lang, phrase, n AS a, w, k, unnest(range(1, k)) AS i FROM kept),
side AS (SELECT cut.lang, cut.phrase, a, i, l.n AS l, r.n AS r, total.n AS n, CAST(1000 * CAST(a AS HUGEINT) * total.n // (CAST(l.n AS HUGEINT) * r.n) AS BIGINT) AS score
  FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = array_to_string(w[1:i], ' ') JOIN f r ON r.lang = cut.lang AND r.phrase = array_to_string(w[i + 1:cut.k], ' ') JOIN total ON total.lang = cut.lang),
best AS (SELECT * FROM side QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best) WHERE rank <= 2000
"""
#: Levels of both trees by recursion; siblings of a row are the other nodes of its run on each level that isn't the last.
OP13 = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS id, doc_id, source, coalesce(strlen(source) || ':' || source, '-') AS key, 
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS fixed,
    text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents
), crc AS (
  SELECT id, c AS crc FROM (SELECT id, string_split(CAST(doc_id AS VARCHAR), '') AS b FROM d), LATERAL (SELECT list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(b, lambda x: CAST(ascii(x) AS BIGINT))), lambda s, x: {fold}) AS c)
), leaf AS (
  SELECT d.id, doc_id, source, key, sha256(fixed || coalesce(strlen(text) || ':' || text, '-')) AS leaf, CASE WHEN xor(crc, 4294967295) % 5 = 0 AND text IS NOT NULL THEN sha256(fixed || strlen(low) || ':' || low) END AS changed FROM d JOIN crc ON crc.id = d.id
), node(lvl, key, pos, n, h) AS (
  SELECT CAST(0 AS INT), key, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1, count(*) OVER (PARTITION BY key), leaf FROM leaf
  UNION ALL SELECT lvl + 1, key, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM node WHERE n > 1 GROUP BY lvl, key, pos // 16, (n + 15) // 16
), sub AS (
  SELECT s.key, node.lvl AS levels, node.h, row_number() OVER (ORDER BY s.source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM node JOIN (SELECT DISTINCT key, source FROM leaf) s ON s.key = node.key WHERE node.n = 1
), top(lvl, pos, n, h) AS (
  SELECT CAST(0 AS INT), pos, n, h FROM sub UNION ALL SELECT lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl, pos // 16, (n + 15) // 16
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaf
), side AS (
  SELECT id, lvl, coalesce(string_agg(h, '' ORDER BY spot) FILTER (WHERE spot < own), '') AS a, coalesce(string_agg(h, '' ORDER BY spot) FILTER (WHERE spot > own), '') AS b FROM (
    SELECT id, node.lvl, node.h, node.pos AS spot, placed.pos // CAST(16 ** node.lvl AS BIGINT) AS own FROM placed JOIN node ON node.key = placed.key AND node.n > 1 AND node.pos // 16 = placed.pos // CAST(16 ** (node.lvl + 1) AS BIGINT)
    UNION ALL SELECT id, levels + top.lvl, top.h, top.pos, sub.pos // CAST(16 ** top.lvl AS BIGINT) FROM placed JOIN sub ON sub.key = placed.key JOIN top ON top.n > 1 AND top.pos // 16 = sub.pos // CAST(16 ** (top.lvl + 1) AS BIGINT)) GROUP BY id, lvl
), fold(id, lvl, h) AS (
  SELECT id, CAST(0 AS INT), coalesce(changed, leaf) FROM placed UNION ALL SELECT fold.id, fold.lvl + 1, sha256(a || h || b) FROM fold JOIN side ON side.id = fold.id AND side.lvl = fold.lvl
), root AS (SELECT h FROM top WHERE n = 1)
SELECT doc_id, leaf, sub.h AS subroot, root.h AS root, sha256(coalesce(p.proof, '')) AS proof_sha256, f.h AS folded_root, f.h = root.h AS verified
FROM placed JOIN sub ON sub.key = placed.key JOIN root ON true LEFT JOIN (SELECT id, string_agg(a || b, '' ORDER BY lvl) AS proof FROM side GROUP BY id) p ON p.id = placed.id JOIN (SELECT id, arg_max(h, lvl) AS h FROM fold GROUP BY id) f ON f.id = placed.id
"""


def _crc_step() -> str:
    """The CRC-32 of a state s with the byte x added: eight steps of the polynomial."""
    out = "xor(s, x)"
    for _ in range(8):
        out = f"list_transform([{out}], lambda y: xor(y >> 1, CASE WHEN y & 1 = 1 THEN 3988292384 ELSE 0 END))[1]"
    return out


OP13 = OP13.replace("{fold}", _crc_step())
