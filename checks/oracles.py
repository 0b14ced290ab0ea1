"""The results of ``queries.QUERIES`` in DuckDB SQL over the same tables."""

from __future__ import annotations

from checks.base import (
    DIMENSION,
    DOCUMENTS_SQL,
    ORIENTED_SQL,
    PAIRS_SQL,
    UNEVEN_DIMENSION,
    values_sql,
)

# What Python's str.strip() removes, as a regex class
WHITESPACE = (
    r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)
STRIP_PATTERN = rf"\A{WHITESPACE}|{WHITESPACE}\z"

IDS = "lang_pair, ord, source_id, target_id, source_lang, target_lang"

# md5 of both texts
MD5S = "md5(source_text) AS source_md5, md5(target_text) AS target_md5"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '{STRIP_PATTERN}', '', 'g')"


def line(text: str) -> str:
    """A text as it comes back from a line file."""
    return strip(f"regexp_replace({text}, '[\\r\\n]+', ' ', 'g')")


def dim(codes: list[str]) -> str:
    rows = [(c, i) for i, c in enumerate(codes)]
    return (
        values_sql("dim", "script_code, i", rows)
        + """, bases AS (
  SELECT split_part(script_code, '_', 1) AS code, count(*) AS n_match,
         min_by(script_code, i) AS script_code
  FROM dim GROUP BY 1)"""
    )


_FILES = (
    ORIENTED_SQL
    + f""", stored AS (
  SELECT lang_pair, 'train' AS split, ord,
         split_part(lang_pair, '-', 1) AS source_lang, split_part(lang_pair, '-', 2) AS target_lang,
         {line("CASE WHEN lang_pair LIKE 'eng-%' THEN source_text ELSE target_text END")} AS source_text,
         {line("CASE WHEN lang_pair LIKE 'eng-%' THEN target_text ELSE source_text END")} AS target_text
  FROM oriented)"""
)

_STORE = (
    PAIRS_SQL
    + """, store AS (
  SELECT *, CASE WHEN lang_pair = 'deu-eng' THEN 'test' WHEN ord % 10 = 0 THEN 'val'
                 ELSE 'train' END AS split
  FROM pairs)"""
)

_CATALOG = """names AS (
  SELECT DISTINCT unnest([lang || '-' || replace(source, 'src', ''), lang || '-' || source, source])
         AS lang_pair FROM documents),
catalog AS (
  SELECT lang_pair, split_part(lang_pair, '-', 1) AS a, split_part(lang_pair, '-', 2) AS b
  FROM names
  WHERE len(string_split(lang_pair, '-')) = 2 AND length(split_part(lang_pair, '-', 1)) <= 3
    AND length(split_part(lang_pair, '-', 2)) <= 3),
existing AS (
  SELECT DISTINCT lang || '-' || replace(source, 'src', '') AS lang_pair
  FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND quality = 0)),
numbers AS (
  SELECT DISTINCT replace(source, 'src', '') AS code
  FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0))"""

_INTERLEAVED = (
    PAIRS_SQL
    + """, sizes AS (SELECT lang_pair, count(*) AS n FROM pairs GROUP BY 1),
turns AS (
  SELECT lang_pair, row_number() OVER (ORDER BY lang_pair) - 1 AS turn,
         count(*) OVER () AS k, min(n) OVER () AS rounds FROM sizes),
mixed AS (
  SELECT ord * k + turn AS pos, pairs.* FROM pairs JOIN turns USING (lang_pair) WHERE ord < rounds)"""
)


def shuffled(source: str, block: str, seed: int = 42) -> str:
    """A new ``pos`` for every row of ``source``, kept as ``old_pos``."""
    return f"""blocked AS (SELECT *, pos // {block} AS blk FROM {source}),
shuffled AS (
  SELECT * EXCLUDE (pos, blk), pos AS old_pos,
         row_number() OVER (ORDER BY blk, md5('{seed}-' || pos::VARCHAR), pos) - 1 AS pos
  FROM blocked)"""


_POSITIONS = "numbered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents)"

_CACHE = """rows AS (
  SELECT doc_id AS ord, text AS source_text, lang || ' ' || source AS translation FROM documents)"""

_KNOWN = (
    _POSITIONS
    + ", "
    + _CACHE
    + """, known AS (
  SELECT source_text, max_by(translation, ord) AS translation FROM rows
  WHERE ord IN (SELECT doc_id FROM labels) GROUP BY 1),
found AS (
  SELECT pos, doc_id, text, known.translation, known.source_text IS NOT NULL AS hit
  FROM numbered LEFT JOIN known ON numbered.text = known.source_text)"""
)

_TOKENS = (
    _POSITIONS
    + """, rows AS (
  SELECT pos, list_transform(string_split(text, ' '), lambda w: length(w)) AS ids,
         list_transform(string_split(text, chr(10)), lambda w: length(w)) AS labels
  FROM numbered)"""
)


def joined(values: str) -> str:
    return f"array_to_string({values}, ',')"


_SEGMENTS = (
    DOCUMENTS_SQL
    + r""", words AS (
  SELECT h.doc_id AS seg, h.lang,
         list_filter(regexp_split_to_array(h.text, '[ \t\r\n]+'), lambda x: x <> '') AS h,
         list_filter(regexp_split_to_array(r.text, '[ \t\r\n]+'), lambda x: x <> '') AS r
  FROM docs h JOIN docs r ON h.lang = r.lang AND h.ord - 1 = r.ord),
starts AS (
  SELECT seg, lang, n, 1 AS is_h, h AS w, unnest(range(1, len(h) - n + 2)) AS i
  FROM words, (VALUES (1), (2), (3), (4)) o(n)
  UNION ALL
  SELECT seg, lang, n, 0 AS is_h, r AS w, unnest(range(1, len(r) - n + 2)) AS i
  FROM words, (VALUES (1), (2), (3), (4)) o(n)),
grams AS (
  SELECT seg, lang, n, array_to_string(w[i:i + n - 1], ' ') AS gram, sum(is_h) AS h, sum(1 - is_h) AS r
  FROM starts GROUP BY ALL),
sums AS (
  SELECT lang, n, sum(least(h, r))::BIGINT AS matches, sum(h)::BIGINT AS total,
         sum(r)::BIGINT AS ref FROM grams GROUP BY 1, 2),
counted AS (
  SELECT lang, n, matches, total,
         (SELECT total FROM sums s WHERE s.lang = o.lang AND s.n = 1) AS hyp_len,
         (SELECT ref FROM sums s WHERE s.lang = o.lang AND s.n = 1) AS ref_len
  FROM sums o)"""
)


def _training(dimension: list[str]) -> str:
    return f"""WITH {ORIENTED_SQL}, {dim(dimension)},
kept AS (
  SELECT o.* REPLACE ('eng_Latn' AS source_lang, b.script_code AS target_lang)
  FROM oriented o JOIN bases b ON b.code = o.target_lang AND b.n_match = 1),
stored AS (SELECT count(*) AS n FROM kept),
dense AS MATERIALIZED (
  SELECT * REPLACE (row_number() OVER (PARTITION BY lang_pair ORDER BY ord) - 1 AS ord)
  FROM kept WHERE score >= 0.5),
sizes AS (SELECT lang_pair, count(*) AS n FROM dense GROUP BY 1),
turns AS (
  SELECT lang_pair, row_number() OVER (ORDER BY lang_pair) - 1 AS turn,
         count(*) OVER () AS k, min(n) OVER () AS rounds FROM sizes),
mixed AS (
  SELECT ord * k + turn AS pos, dense.* FROM dense JOIN turns USING (lang_pair) WHERE ord < rounds),
{shuffled("mixed", "(SELECT greatest(1, n // 4) FROM stored)")}
SELECT pos, lang_pair, source_id, target_id, source_lang, target_lang, {MD5S} FROM shuffled"""


def _first_rows(n: str) -> str:
    """Interleaved rows of which each pair gives the first ``n``."""
    return f"""sizes AS (SELECT lang_pair, least(count(*), {n}) AS n FROM oriented GROUP BY 1),
turns AS (
  SELECT lang_pair, row_number() OVER (ORDER BY lang_pair) - 1 AS turn,
         count(*) OVER () AS k, min(n) OVER () AS rounds FROM sizes),
mixed AS (
  SELECT ord * k + turn AS pos, oriented.* FROM oriented JOIN turns USING (lang_pair) WHERE ord < rounds),
{shuffled("mixed", "(SELECT greatest(1, count(*) // 4) FROM pairs)")}"""


_RECODED = f"""WITH {ORIENTED_SQL}, {dim(UNEVEN_DIMENSION)},
recoded AS (
  SELECT o.* REPLACE ('eng_Latn' AS source_lang, b.script_code AS target_lang)
  FROM oriented o JOIN bases b ON b.code = o.target_lang AND b.n_match = 1)"""

_WIDE = (
    DOCUMENTS_SQL
    + """, sides AS (
  SELECT p.ord, 'eng_Latn' AS source_lang, t.code || '_Latn' AS target_lang,
         e.text AS source_text, o.text AS target_text
  FROM (SELECT DISTINCT ord FROM docs) p CROSS JOIN (VALUES ('deu'), ('spa'), ('fra')) t(code)
  LEFT JOIN docs e ON e.ord = p.ord AND e.code = 'eng'
  LEFT JOIN docs o ON o.ord = p.ord AND o.code = t.code)"""
)

_SPACE = "chr(12288) || chr(8195) || chr(28) || chr(9) || chr(160) || ' '"

ORACLES = {
    "aligned_files": f"WITH {_FILES} SELECT lang_pair, split, ord, source_lang, target_lang, {MD5S} FROM stored",
    "aligned_report": f"""WITH {DOCUMENTS_SQL}, n AS (SELECT code, count(*) AS n FROM docs GROUP BY 1)
SELECT least('eng', o.code) || '-' || greatest('eng', o.code) AS lang_pair, 'train' AS split,
       e.n AS n_src, o.n AS n_trg, least(e.n, o.n) AS n_pairs, abs(e.n - o.n) AS n_unmatched
FROM n e JOIN n o ON e.code = 'eng' AND o.code <> 'eng'""",
    "ingest_resume": f"WITH {_FILES} SELECT lang_pair, split, ord, {MD5S} FROM stored",
    "stored_catalog": f"WITH {_STORE} SELECT DISTINCT lang_pair, split FROM store",
    "read_stored_split": f"""WITH {_STORE} SELECT lang_pair, ord, {MD5S} FROM store
WHERE split = 'train' AND lang_pair IN ('deu-eng', 'eng-fra')""",
    "skipped_pairs": f"""WITH {_STORE} SELECT lang_pair FROM store GROUP BY 1
HAVING NOT bool_or(split = 'train')""",
    "split_report": f"""WITH {PAIRS_SQL}, s AS (
  SELECT lang_pair, CASE ord % 10 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split
  FROM pairs)
SELECT lang_pair, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits, count(*) AS n
FROM s GROUP BY 1""",
    "write_ordered": f"WITH {_INTERLEAVED} SELECT pos, pos AS file_pos, lang_pair, {MD5S} FROM mixed",
    "score_files": f"WITH {PAIRS_SQL} SELECT lang_pair, ord, score FROM pairs",
    "catalog_filter": f"""WITH {_CATALOG} SELECT lang_pair FROM catalog
WHERE lang_pair NOT IN (SELECT lang_pair FROM existing) AND 'en' IN (a, b)
  AND (a IN ('1', '12', '3') OR b IN ('1', '12', '3'))""",
    "catalog_filter_substring": f"""WITH {_CATALOG} SELECT lang_pair FROM catalog
WHERE lang_pair NOT IN (SELECT lang_pair FROM existing) AND contains(lang_pair, 'e')
  AND (contains(lang_pair, '1') OR contains(lang_pair, '3'))""",
    "catalog_counts": f"""WITH {_CATALOG} SELECT count(*) AS n_pairs,
  count(*) FILTER (lang_pair IN (SELECT lang_pair FROM existing)) AS n_skipped,
  count(*) FILTER (lang_pair NOT IN (SELECT lang_pair FROM existing)) AS n_left FROM catalog""",
    "catalog_semi": f"""WITH {_CATALOG} SELECT lang_pair FROM catalog
WHERE a IN (SELECT code FROM numbers) OR b IN (SELECT code FROM numbers)""",
    "catalog_semi_substring": f"""WITH {_CATALOG} SELECT lang_pair FROM catalog
WHERE EXISTS (SELECT 1 FROM numbers WHERE contains(lang_pair, code))""",
    "uncovered_codes": f"""WITH {_CATALOG} SELECT DISTINCT replace(source, 'src', '') AS code FROM documents
WHERE replace(source, 'src', '') NOT IN (
  SELECT unnest(string_split(lang_pair, '-')) FROM existing)""",
    "other_side": f"""WITH {_CATALOG} SELECT lang_pair, CASE WHEN a = 'en' THEN b ELSE a END AS other,
  replace(replace(lang_pair, 'e', ''), '-', '') AS rest FROM catalog""",
    "code_match": f"""WITH {DOCUMENTS_SQL}, {dim(UNEVEN_DIMENSION)}
SELECT docs.code, coalesce(n_match, 0) AS n_match,
       CASE coalesce(n_match, 0) WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'ambiguous' END AS status,
       count(*) AS n_docs
FROM docs LEFT JOIN bases USING (code) GROUP BY 1, 2, 3""",
    "prefix_match": f"""WITH {dim(UNEVEN_DIMENSION)}, n AS (
  SELECT lang AS code, count(*) AS n_docs FROM documents GROUP BY 1)
SELECT code, count(script_code) OVER (PARTITION BY code) AS n_match, script_code, n_docs
FROM n LEFT JOIN dim ON starts_with(script_code, code)""",
    "covered_codes": f"""WITH {DOCUMENTS_SQL}, {dim(UNEVEN_DIMENSION)}
SELECT script_code FROM bases WHERE n_match = 1 AND code IN (SELECT code FROM docs)""",
    "matching_codes": f"""WITH {DOCUMENTS_SQL}, {dim(UNEVEN_DIMENSION)}
SELECT code FROM bases WHERE code IN (SELECT code FROM docs)""",
    "iso_lookup": f"""WITH {DOCUMENTS_SQL}, {values_sql("iso", "a3, a2", [("deu", "de"), ("eng", "en"), ("spa", None)])}
SELECT code, CASE WHEN a3 IS NULL THEN 'Invalid ISO 639-3 code: ' || code
                  WHEN a2 IS NULL THEN 'No ISO 639-1 code for ' || code ELSE a2 END AS iso639_1,
       count(*) AS n_docs
FROM docs LEFT JOIN iso ON a3 = code GROUP BY 1, 2""",
    "missing_langs": _RECODED
    + " SELECT DISTINCT target_lang AS lang FROM recoded WHERE target_lang NOT IN ('eng_Latn', 'fra_Latn')",
    "langs_used": _RECODED + " SELECT DISTINCT target_lang AS lang FROM recoded",
    "zip_pairs": f"WITH {PAIRS_SQL} SELECT {IDS}, {MD5S} FROM pairs",
    "strip_text": f"""WITH s AS (SELECT doc_id, {strip(f"{_SPACE} || text || {_SPACE}")} AS t FROM documents)
SELECT doc_id, md5(t) AS md5, length(t) AS n FROM s""",
    "orient_pairs": f"WITH {ORIENTED_SQL} SELECT {IDS}, {MD5S} FROM oriented",
    "recode_pairs": _RECODED + f" SELECT {IDS}, {MD5S} FROM recoded",
    "directions": f"""WITH {ORIENTED_SQL}
SELECT {IDS}, 'eng->X' AS objective_id, {MD5S} FROM oriented UNION ALL
SELECT lang_pair, ord, target_id, source_id, target_lang, source_lang, 'X->eng', md5(target_text),
       md5(source_text) FROM oriented""",
    "attach_scores": f"WITH {PAIRS_SQL} SELECT lang_pair, ord, source_id, score, {MD5S} FROM pairs",
    "score_filter": f"""WITH {PAIRS_SQL} SELECT lang_pair, ord, source_id, score, {MD5S} FROM pairs
WHERE score >= 0.95 AND ord % 11 <> 3""",
    "score_counts": f"""WITH {PAIRS_SQL} SELECT lang_pair, count(*) AS n,
  count(*) FILTER (score >= 0.95 AND ord % 11 <> 3) AS n_kept FROM pairs GROUP BY ROLLUP (lang_pair)""",
    "pair_counts": f"WITH {PAIRS_SQL} SELECT lang_pair, count(*) AS n FROM pairs GROUP BY ROLLUP (lang_pair)",
    "eval_exclude": f"""WITH {PAIRS_SQL} SELECT {IDS}, {MD5S} FROM pairs
WHERE source_lang NOT IN ('fra', 'zho') AND target_lang NOT IN ('fra', 'zho')""",
    "flat_filter": f"""WITH {PAIRS_SQL} SELECT source_id, target_id, source_lang || '_Latn' AS source_lang,
  target_lang || '_Latn' AS target_lang, {MD5S} FROM pairs
WHERE source_lang = 'eng' AND target_lang IN ('fra', 'spa')""",
    "read_flat": f"""WITH {PAIRS_SQL} SELECT fmt, source_lang || '_Latn' AS source_lang,
  target_lang || '_Latn' AS target_lang, {MD5S} FROM pairs, (VALUES ('parquet'), ('json')) f(fmt)
WHERE source_lang = 'eng'""",
    "flat_filter_literal": f"""WITH {PAIRS_SQL} SELECT source_id, target_id,
  source_lang || '_Latn' AS source_lang, target_lang || '_Latn' AS target_lang, {MD5S} FROM pairs
WHERE source_lang = 'eng' AND contains('xdeu_Latn,fra_Latn', target_lang || '_Latn')""",
    "wide_eval": f"WITH {_WIDE} SELECT ord, source_lang, target_lang, {MD5S} FROM sides",
    "head_per_pair": f"""WITH {PAIRS_SQL}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang_pair ORDER BY ord) AS place FROM pairs)
SELECT {IDS}, {MD5S} FROM ranked WHERE place <= 40""",
    "dense_renumber": f"""WITH {PAIRS_SQL} SELECT lang_pair, ord AS old_ord,
  row_number() OVER (PARTITION BY lang_pair ORDER BY ord) - 1 AS ord, {MD5S} FROM pairs WHERE score >= 0.5""",
    "interleave": f"WITH {_INTERLEAVED} SELECT pos, lang_pair, ord, {MD5S} FROM mixed",
    "interleave_empty_key": f"""WITH {PAIRS_SQL}, two AS (SELECT * FROM pairs WHERE lang_pair <> 'eng-spa')
SELECT 2 * ord + (lang_pair = 'eng-fra')::INT AS pos, lang_pair, ord, {MD5S} FROM two
WHERE ord < (SELECT min(n) FROM (SELECT count(*) AS n FROM two GROUP BY lang_pair))""",
    "union_languages": f"WITH {PAIRS_SQL} SELECT {IDS}, {MD5S} FROM pairs",
    "block_shuffle": f"""WITH {_INTERLEAVED},
{shuffled("mixed", "(SELECT greatest(1, count(*) // 4) FROM mixed)")}
SELECT pos, old_pos, lang_pair, ord, {MD5S} FROM shuffled""",
    "batches": f"""WITH {_POSITIONS} SELECT pos // 32 AS batch_id, count(*) AS n, min(pos) AS first_pos,
  max(pos) AS last_pos, md5(string_agg(text, '|' ORDER BY pos)) AS md5 FROM numbered GROUP BY 1""",
    "teacher_batches": f"""WITH {_POSITIONS} SELECT pos // 32 AS batch_id, pos, doc_id, md5(text) AS md5 FROM numbered
WHERE pos < (SELECT count(*) // 32 * 32 FROM numbered)""",
    "cache_dedup": f"""WITH {_CACHE} SELECT md5(source_text) AS source_md5,
  max_by(translation, ord) AS translation, max(ord) AS ord FROM rows GROUP BY source_text""",
    "cache_dedup_literal": f"""WITH {_CACHE}, firsts AS (
  SELECT translation, min_by(source_text, ord) AS source_text, min(ord) AS ord FROM rows GROUP BY 1)
SELECT md5(source_text) AS source_md5, max_by(translation, ord) AS translation
FROM firsts GROUP BY source_text""",
    "cache_lookup": f"WITH {_KNOWN} SELECT pos, doc_id, translation, hit FROM found",
    "cache_misses": f"WITH {_KNOWN} SELECT pos, doc_id FROM found WHERE NOT hit",
    "cache_misses_batch": f"""WITH {_KNOWN} SELECT pos, doc_id FROM found
WHERE pos // 2 IN (SELECT pos // 2 FROM found WHERE NOT hit)""",
    "teacher_apply": f"""WITH {_KNOWN} SELECT pos, doc_id,
  md5(CASE WHEN hit THEN translation ELSE 't:' || text END) AS target_md5 FROM found""",
    "teacher_apply_batch": f"""WITH {_KNOWN}, cut AS (
  SELECT * FROM found WHERE pos < (SELECT count(*) // 32 * 32 FROM found)),
again AS (
  SELECT DISTINCT text FROM cut WHERE pos // 32 IN (SELECT pos // 32 FROM cut WHERE NOT hit))
SELECT pos, doc_id, md5(CASE WHEN text IN (SELECT text FROM again) THEN 't:' || text
                             ELSE translation END) AS target_md5 FROM cut""",
    "cache_store": f"""WITH {_POSITIONS}, runs AS (
  SELECT text, min(CASE WHEN pos % 3 = 0 THEN 0 ELSE 1 END) AS ord FROM numbered GROUP BY 1)
SELECT ord, md5(text) AS source_md5, md5('t:' || text) AS target_md5 FROM runs""",
    "cache_tsv": f"""WITH {_POSITIONS} SELECT pos AS ord,
  md5(regexp_replace(text, '[\\t\\r\\n]+', ' ', 'g')) AS source_md5, lang || ' ' || source AS translation
FROM numbered WHERE doc_id % 7 <> 0""",
    "cache_bad_lines": "SELECT count(*) AS n_lines, count(*) FILTER (doc_id % 7 = 0) AS n_bad FROM documents",
    "truncate_ids": f"WITH {_TOKENS} SELECT pos, len(ids[1:128]) AS n, {joined('ids[1:128]')} AS ids FROM rows",
    "pad_batch": f"""WITH {_TOKENS}, longest AS (
  SELECT *, pos // 8 AS batch_id, max(len(ids)) OVER (PARTITION BY pos // 8) AS a,
         max(len(labels)) OVER (PARTITION BY pos // 8) AS b FROM rows)
SELECT pos, batch_id, a AS n,
  md5({joined("ids || list_transform(range(a - len(ids)), lambda x: 0)")}) AS ids_md5,
  md5({joined("list_transform(ids, lambda x: 1) || list_transform(range(a - len(ids)), lambda x: 0)")}) AS mask_md5,
  md5({joined("labels || list_transform(range(b - len(labels)), lambda x: -100)")}) AS labels_md5
FROM longest""",
    "mask_after_eos": f"""WITH {_TOKENS}, cut AS (
  SELECT pos, ids, CASE WHEN list_contains(ids, 7) THEN len(ids) - list_position(list_reverse(ids), 7) + 1
                        ELSE len(ids) END AS k FROM rows)
SELECT pos, len(ids) AS n,
  md5({joined("list_transform(ids, lambda v, i: CASE WHEN i > k THEN -100 ELSE v END)")}) AS ids_md5 FROM cut""",
    "bleu_counts": f"WITH {_SEGMENTS} SELECT lang, n, matches, total, hyp_len, ref_len FROM counted",
    "corpus_bleu": f"""WITH {_SEGMENTS} SELECT lang, round(CASE WHEN min(matches) = 0 THEN 0 ELSE
  100 * exp(avg(ln(matches::DOUBLE / total)) + CASE WHEN max(hyp_len) >= max(ref_len) THEN 0
            ELSE 1 - max(ref_len)::DOUBLE / max(hyp_len) END) END, 6) AS score
FROM counted GROUP BY 1""",
    "stream_normalize": f"""WITH {ORIENTED_SQL}, {dim(UNEVEN_DIMENSION)}
SELECT lang_pair, CASE WHEN lang_pair = 'deu-eng' THEN 'test' WHEN ord % 10 = 0 THEN 'val'
                       ELSE 'train' END AS split, ord, 'eng_Latn' AS source_lang,
       b.script_code AS target_lang, {MD5S}
FROM oriented o JOIN bases b ON b.code = o.target_lang AND b.n_match = 1""",
    "stream_flat": f"""WITH {PAIRS_SQL} SELECT source_lang || '_Latn' AS source_lang,
  target_lang || '_Latn' AS target_lang, {MD5S} FROM pairs
WHERE source_lang = 'eng' AND target_lang IN ('fra', 'spa')""",
    "stream_ingest": f"""WITH {_STORE} SELECT lang_pair, split, ord, source_lang, target_lang, {MD5S}
FROM store WHERE lang_pair <> 'eng-fra'""",
    "training_rows": _training(DIMENSION),
    "training_rows_uneven": _training(UNEVEN_DIMENSION),
    "eval_rows": f"""WITH {_WIDE}, heads AS (SELECT * FROM sides WHERE ord < 40),
sizes AS (SELECT target_lang, count(*) AS n FROM heads GROUP BY 1),
turns AS (
  SELECT target_lang, row_number() OVER (ORDER BY target_lang) - 1 AS turn, count(*) OVER () AS k,
         min(n) OVER () AS rounds FROM sizes)
SELECT ord * k + turn AS pos, source_lang, target_lang, {MD5S}
FROM heads JOIN turns USING (target_lang) WHERE ord < rounds""",
    "flat_training_rows": f"""WITH {PAIRS_SQL}, kept AS (
  SELECT source_id, target_id, source_lang || '_Latn' AS source_lang, target_lang || '_Latn' AS target_lang,
         source_text, target_text, row_number() OVER (ORDER BY target_id) - 1 AS pos
  FROM pairs WHERE source_lang = 'eng' AND target_lang IN ('fra', 'spa')),
{shuffled("kept", "(SELECT greatest(1, count(*) // 4) FROM kept)")}
SELECT pos, source_id, target_id, source_lang, target_lang, {MD5S} FROM shuffled""",
    "training_first": f"""WITH {ORIENTED_SQL}, {_first_rows("20")}
SELECT pos, lang_pair, source_id, target_id, {MD5S} FROM shuffled""",
    "training_teacher": f"""WITH {ORIENTED_SQL}, {_first_rows("count(*)")}, {_CACHE}, known AS (
  SELECT source_text, max_by(translation, ord) AS translation FROM rows
  WHERE ord IN (SELECT doc_id FROM labels) GROUP BY 1)
SELECT pos, lang_pair, source_id, target_id, md5(s.source_text) AS source_md5,
       md5(coalesce(k.translation, 't:' || s.source_text)) AS target_md5
FROM shuffled s LEFT JOIN known k USING (source_text)
WHERE pos < (SELECT count(*) // 8 * 8 FROM shuffled)""",
    "training_sizes": f"""WITH {PAIRS_SQL} SELECT count(*) AS n_stored,
  count(*) FILTER (score >= 0.5) AS n_effective FROM pairs""",
    "code_requests": f"""WITH {PAIRS_SQL} SELECT lang_pair, count(*) AS n FROM pairs
WHERE lang_pair <> 'eng-spa' GROUP BY 1""",
    "drop_script": _RECODED + " SELECT lang_pair, ord, split_part(target_lang, '_', 1) AS base FROM recoded",
    "aligned_gz": f"WITH {_FILES} SELECT lang_pair, split, ord, source_lang, target_lang, {MD5S} FROM stored",
    "uneven_report": f"""WITH {PAIRS_SQL}, n AS (
  SELECT lang_pair, count(*) AS n_src, count(*) FILTER (lang_pair <> 'deu-eng') AS n_trg FROM pairs GROUP BY 1)
SELECT lang_pair, 'train' AS split, n_src, n_trg, least(n_src, n_trg) AS n_pairs, n_src - n_trg AS n_unmatched FROM n""",
    "stream_then_ingest": f"WITH {_FILES} SELECT lang_pair, split, ord, {MD5S} FROM stored",
    "stream_two_sources": f"""WITH {_STORE} SELECT lang_pair, split, ord, {MD5S} FROM store
WHERE lang_pair <> 'eng-spa'""",
    "stream_lost_checkpoint": f"WITH {_STORE} SELECT lang_pair, split, ord, {MD5S} FROM store",
    "ingest_override": f"""WITH {_FILES}, now AS (
  SELECT lang_pair, split, ord, source_text,
         CASE WHEN lang_pair = 'deu-eng' THEN target_text ELSE 'older' END AS target_text
  FROM stored WHERE lang_pair <> 'eng-spa') SELECT lang_pair, split, ord, {MD5S} FROM now""",
    "dev_files": f"""WITH {PAIRS_SQL}, made(lang_pair, split, third) AS (VALUES
  ('deu-eng', 'val', 0), ('eng-fra', 'val', 1), ('eng-fra', 'train', 0), ('eng-spa', 'val', 2), ('eng-spa', 'train', 0)),
lines AS (
  SELECT lang_pair, split, ord // 3 AS ord, {line("source_text")} AS source_text, {line("target_text")} AS target_text
  FROM pairs JOIN made USING (lang_pair) WHERE ord % 3 = third)
SELECT lang_pair, split, ord, {MD5S} FROM lines""",
    "requested_codes": _RECODED + " SELECT DISTINCT split_part(target_lang, '_', 1) AS code FROM recoded",
    "orient_literal": f"""WITH {PAIRS_SQL} SELECT lang_pair, ord,
  CASE WHEN source_lang = 'deu' THEN source_id ELSE target_id END AS source_id,
  CASE WHEN source_lang = 'deu' THEN target_id ELSE source_id END AS target_id,
  CASE WHEN source_lang = 'deu' THEN source_lang ELSE target_lang END AS source_lang,
  CASE WHEN source_lang = 'deu' THEN target_lang ELSE source_lang END AS target_lang,
  md5(CASE WHEN source_lang = 'deu' THEN source_text ELSE target_text END) AS source_md5,
  md5(CASE WHEN source_lang = 'deu' THEN target_text ELSE source_text END) AS target_md5
FROM pairs""",
    "teacher_restart": f"""WITH {DOCUMENTS_SQL} SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, doc_id,
  md5(text) AS target_md5, true AS kept FROM documents""",
    "cache_levels": """WITH firsts AS (SELECT text, min(doc_id) AS id FROM documents GROUP BY 1),
runs AS (SELECT text, unnest([id % 10, id % 7]) AS run FROM firsts),
last AS (SELECT text, max(run) AS run FROM runs GROUP BY 1)
SELECT md5(text) AS source_md5, md5(run || ':' || text) AS target_md5, run AS ord FROM last""",
    "flat_languages": f"""WITH {PAIRS_SQL}, {dim(UNEVEN_DIMENSION)}, asked AS (
  SELECT DISTINCT target_lang AS code FROM pairs WHERE target_lang <> 'eng'),
roles AS (
  SELECT script_code, 'anchor' AS role FROM bases WHERE code = 'eng'
  UNION ALL SELECT script_code, 'covered' FROM bases JOIN asked USING (code) WHERE n_match = 1
  UNION ALL SELECT d.script_code, 'ambiguous' FROM dim d JOIN bases b ON b.code = split_part(d.script_code, '_', 1)
  JOIN asked a ON a.code = b.code WHERE b.n_match > 1)
SELECT script_code, role FROM roles""",
}
