"""SQL of the corpus operators that need more than a few lines of it."""

from __future__ import annotations

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
# The crc32 of bytes, by the usual table of 256 remainders.
_CRC_TABLE = r"""
        crc_table AS (
          SELECT list_transform(range(256), lambda b: list_reduce([b] || range(8), lambda a, i: xor(a >> 1, 3988292384 * (a & 1)))) AS crc_of),"""


def _crc(nbytes: str) -> str:
    return f"xor(list_reduce([4294967295] || {nbytes}, lambda a, b: xor(a >> 8, crc_of[(xor(a, b) & 255) + 1])), 4294967295)"


_NGRAM_JACCARD = rf"""
        WITH RECURSIVE words AS (
          SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        sets AS (
          SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                         ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
          FROM words),
        shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
        links AS (
          SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reached(doc_id, other) AS (
          SELECT x, y FROM edges UNION SELECT r.doc_id, e.y FROM reached r JOIN edges e ON r.other = e.x),
        least_of AS (SELECT doc_id, min(other) AS low FROM reached GROUP BY doc_id)
        SELECT doc_id, len(s) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id FROM sets LEFT JOIN least_of USING (doc_id)"""


_SPELLING_VARIANTS = rf"""
        WITH RECURSIVE {_CRC_TABLE}
        runs AS (
          SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS key, run
          FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWERED}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 7),
        coded AS (
          SELECT run, flatten(list_transform(string_split(key, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)]
                   ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)) AS bytes FROM runs),
        hashed AS (SELECT run, {_crc('bytes')} AS h FROM coded, crc_table),
        words AS (
          SELECT word, count(*) AS n FROM (
            SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word FROM hashed)
          WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
        shorter AS (
          SELECT word, n, i, substr(word, 1, CAST(i AS INT)) || substr(word, CAST(i AS INT) + 2) AS rest
          FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
        near AS (
          SELECT a.word AS word, b.word AS other, b.n AS other_n FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
          UNION SELECT s.word, w.word, w.n FROM shorter s JOIN words w ON s.rest = w.word
          UNION SELECT w.word, s.word, s.n FROM shorter s JOIN words w ON s.rest = w.word),
        best AS (
          SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
        forms AS (
          SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n
          FROM words LEFT JOIN best USING (word)),
        ways(word, here) AS (
          SELECT word, word FROM forms UNION ALL SELECT w.word, f.form FROM ways w JOIN forms f ON w.here = f.word AND f.form IS NOT NULL),
        roots AS (SELECT w.word, w.here AS root FROM ways w JOIN forms f ON w.here = f.word AND f.form IS NULL)
        SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)"""


def _field(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


_MERKLE_MANIFEST = rf"""
        WITH RECURSIVE {_CRC_TABLE}
        leaves AS (
          SELECT doc_id, lang, {_leaf('n_chars')} AS leaf, {_leaf('(n_chars + 1)')} AS changed,
                 {_crc("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(unicode(c) AS BIGINT))")} % 7 = 0 AS tampered
          FROM documents, crc_table),
        placed AS (
          SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
        nodes(lang, level, place, n, h) AS (
          SELECT lang, 0, place, n, leaf FROM placed
          UNION ALL SELECT lang, level + 1, place // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY place)) FROM nodes WHERE n > 1 GROUP BY lang, level, place // 2, n),
        subroots AS (
          SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS top_place, count(*) OVER () AS top_n FROM nodes WHERE n = 1),
        top(level, place, n, h) AS (
          SELECT 0, top_place, top_n, subroot FROM subroots
          UNION ALL SELECT level + 1, place // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY place)) FROM top WHERE n > 1 GROUP BY level, place // 2, n),
        heights AS (SELECT lang, max(level) AS height FROM nodes GROUP BY lang),
        steps AS (
          SELECT lang, 0 AS tree, level, place, n, h FROM nodes WHERE n > 1
          UNION ALL SELECT NULL, 1, level, place, n, h FROM top WHERE n > 1),
        folded(doc_id, leaf, lang, tree, level, place, n, h, path) AS (
          SELECT doc_id, leaf, lang, 0, 0, place, n, CASE WHEN tampered AND changed IS NOT NULL THEN changed ELSE leaf END, '' FROM placed
          UNION ALL
          SELECT f.doc_id, f.leaf, f.lang, f.tree + CAST(f.n = 1 AS INT), CASE WHEN f.n = 1 THEN 0 ELSE f.level + 1 END,
                 CASE WHEN f.n = 1 THEN r.top_place ELSE f.place // 2 END, CASE WHEN f.n = 1 THEN r.top_n ELSE (f.n + 1) // 2 END,
                 CASE WHEN f.n = 1 THEN f.h WHEN s.h IS NULL THEN sha256(f.h) WHEN f.place % 2 = 0 THEN sha256(f.h || s.h) ELSE sha256(s.h || f.h) END,
                 f.path || CASE WHEN f.n = 1 THEN '' ELSE coalesce(s.h, '') END
          FROM folded f JOIN subroots r ON f.lang IS NOT DISTINCT FROM r.lang
          LEFT JOIN steps s ON s.tree = f.tree AND (f.tree = 1 OR s.lang IS NOT DISTINCT FROM f.lang) AND s.level = f.level AND s.place = xor(f.place, 1) AND f.n > 1
          WHERE f.n > 1 OR f.tree = 0)
        SELECT f.doc_id, f.leaf, r.subroot, t.h AS root, sha256(f.path) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
        FROM folded f JOIN subroots r ON f.lang IS NOT DISTINCT FROM r.lang, (SELECT h FROM top WHERE n = 1) t
        WHERE f.tree = 1 AND f.n = 1"""


ORACLES = {"op11_ngram_jaccard": _NGRAM_JACCARD, "op12_spelling_variants": _SPELLING_VARIANTS, "op13_merkle_manifest": _MERKLE_MANIFEST}
