"""DuckDB SQL for the operators that SQL can express on whole tables."""

WORD = r"[^\x20\x09-\x0D]+"

LINE_DEDUP = rf"""
WITH line AS (
  SELECT doc_id, pos, line, len(regexp_extract_all(line, '{WORD}')) AS words
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
), seq AS (
  SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS upto FROM line WHERE words > 0
), win AS (
  SELECT doc_id,
    string_agg(line, chr(10)) OVER o AS body_o, sum(words) OVER o AS n_o, min(pos) OVER o AS a_o, max(pos) OVER o AS b_o,
    string_agg(line, chr(10)) OVER c AS body_c, sum(words) OVER c AS n_c, min(pos) OVER c AS a_c, max(pos) OVER c AS b_c
  FROM (SELECT *, upto - words AS ahead FROM seq)
  WINDOW o AS (PARTITION BY doc_id ORDER BY ahead RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING),
         c AS (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)
), both_ways AS (
  SELECT doc_id, body_o AS body, a_o AS a, b_o AS b FROM win WHERE n_o >= 50
  UNION SELECT doc_id, body_c, a_c, b_c FROM win WHERE n_c >= 50
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(a, b)) AS pos FROM (
    SELECT doc_id, a, b, row_number() OVER (PARTITION BY body ORDER BY doc_id, a) AS rn FROM both_ways) WHERE rn > 1
), cut AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL) AS text,
         count(*) AS n_lines, count(g.pos) AS n_removed
  FROM line l LEFT JOIN gone g USING (doc_id, pos) GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(c.text, '') END AS text,
       coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN cut c USING (doc_id)
"""

MIXING = rf"""
WITH RECURSIVE placed AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 9))::BIGINT AS place
  FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM placed GROUP BY source
), level AS (
  SELECT *, 3.0 * source_size <= w * ((SELECT sum(source_size) FROM totals) - coalesce(sum(3.0 * source_size) OVER (ORDER BY 3.0 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY 3.0 * source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS is_full
  FROM totals
), target AS (
  SELECT source, source_size, CASE WHEN is_full THEN 3.0 * source_size ELSE least(3.0 * source_size, w * ((SELECT sum(source_size) FROM level) - coalesce((SELECT sum(3.0 * source_size) FROM level WHERE is_full), 0)) / (SELECT sum(w) FROM level WHERE NOT is_full)) END::DOUBLE AS target
  FROM level
), budget AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies,
         target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size AS rest
  FROM target
), run AS (
  SELECT source, place, words, sum(words) OVER (PARTITION BY source ORDER BY place) AS upto
  FROM (SELECT source, place, sum(size) AS words FROM placed GROUP BY source, place)
), chosen AS (
  SELECT r.source, r.place, upto <= rest OR (upto - words <= rest AND 2 * (rest - (upto - words)) > words) AS more
  FROM run r JOIN budget b ON r.source IS NOT DISTINCT FROM b.source
)
SELECT p.doc_id, p.size, b.source_size, b.target, (p.size * (b.copies + CASE WHEN c.more THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed p JOIN budget b ON p.source IS NOT DISTINCT FROM b.source
JOIN chosen c ON c.source IS NOT DISTINCT FROM p.source AND c.place = p.place
"""

QUALITY_RULES = rf"""
WITH w AS (
  SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents
), n AS (
  SELECT doc_id, text, words, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         length(regexp_replace(coalesce(text, ''), '[^A-Z]', '', 'g')) AS n_upper,
         length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS n_letters,
         length(regexp_replace(coalesce(text, ''), '[^!]', '', 'g')) AS n_exclaim
  FROM w
), lines AS (
  SELECT doc_id, count(*) AS n_lines, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
  WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id
), pos AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3
), gram AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS many FROM pos
), cover AS (
  SELECT doc_id, count(DISTINCT i + j)::BIGINT AS n_repeat_words FROM gram, (VALUES (0), (1), (2)) v(j) WHERE many > 1 GROUP BY doc_id
), f AS (
  SELECT n.doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         n_upper, n_letters, n_exclaim, coalesce(n_lines, 0) AS n_lines
  FROM n LEFT JOIN lines USING (doc_id) LEFT JOIN cover USING (doc_id)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols > 0.25 * n_words OR n_upper > 0.6 * greatest(n_letters, 1) OR n_exclaim > 0.3 * n_words
            OR n_dup_lines > 0.5 * n_lines OR word_chars < 1.5 * n_words OR word_chars > 25 * n_words) AS kept
FROM b
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE) for x in embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

RANKED = rf"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS w
  FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
), size AS (
  SELECT id, doc_id, len(w)::BIGINT AS n FROM d WHERE len(w) > 0
), s AS (
  SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM size
), tf AS (
  SELECT id, term, count(*)::BIGINT AS tf FROM (SELECT id, unnest(w) AS term FROM d) GROUP BY id, term
), asked AS (
  SELECT item_id, term, count(*)::BIGINT AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark) GROUP BY item_id, term
), weight AS (
  SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term), s
), total AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weight USING (term) JOIN size USING (id), s GROUP BY item_id, id, doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM total WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""

PHRASES = rf"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), cut AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM piece
), gram AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM cut, (VALUES (1), (2), (3)) v(k))
), f AS (
  SELECT lang, k, phrase, count(*)::BIGINT AS f FROM gram GROUP BY lang, k, phrase HAVING count(*) >= 10
), size AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM cut GROUP BY lang
), half AS (
  SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS c FROM f WHERE k > 1
), both_parts AS (
  SELECT h.lang, h.phrase, h.a, h.c, x.f AS l, y.f AS r, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM half h JOIN f x ON x.lang = h.lang AND x.phrase = array_to_string(w[: c], ' ')
  JOIN f y ON y.lang = h.lang AND y.phrase = array_to_string(w[c + 1 :], ' ')
), best AS (
  SELECT * FROM both_parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), inside AS (
  SELECT lang, phrase, max(f) AS longest FROM (
    SELECT lang, f, unnest([array_to_string(string_split(phrase, ' ')[: 2], ' '), array_to_string(string_split(phrase, ' ')[2 :], ' ')]) AS phrase FROM f WHERE k = 3
  ) GROUP BY lang, phrase
), ranked AS (
  SELECT lang, phrase, a, l, r, n, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM best LEFT JOIN inside USING (lang, phrase) JOIN size USING (lang) WHERE longest IS NULL OR 100 * longest < 50 * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
