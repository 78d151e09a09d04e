"""Oracle SQL (DuckDB dialect) for every query with a SQL equivalent.

Tables ``documents labels customer supplier region events ...`` are views
over the same parquet files.  ``JOURNALS`` repeats, in SQL, the derivation
of :func:`trailspark.sources.tables.journals`.
"""

from __future__ import annotations

JOURNALS = """
journals AS (
  SELECT j.*,
    array_to_string(list_transform(range(1, 2 + (j.topic + 1) % 4),
        lambda i: 'w' || CAST(j.topic AS VARCHAR) || '_' || CAST(i AS VARCHAR)), ', ') AS topic_words
  FROM (
    SELECT d.doc_id AS journal_id,
      d.text AS journal_story,
      'hiker' || CAST(d.doc_id % 37 AS VARCHAR) AS trail_name,
      CASE WHEN d.doc_id % 23 = 0 THEN NULL WHEN d.doc_id % 11 = 0 THEN 'No Club' ELSE d.source END AS trail_club,
      CASE WHEN d.doc_id % 41 = 0 THEN NULL ELSE 'shelter' || CAST(d.doc_id % 50 AS VARCHAR) END AS location_name,
      CASE WHEN d.doc_id % 29 = 0 THEN CAST(-1 AS DOUBLE) ELSE 34.0 + CAST(d.doc_id % 50 AS DOUBLE) / 4.0 END AS latitude,
      CASE WHEN d.doc_id % 29 = 0 THEN CAST(-1 AS DOUBLE) ELSE -84.0 + CAST(d.doc_id % 50 AS DOUBLE) / 4.0 END AS longitude,
      CASE WHEN d.doc_id % 13 = 0 THEN NULL ELSE 'ST' || CAST(d.doc_id % 14 AS VARCHAR) END AS state,
      CASE WHEN d.doc_id % 31 = 0 THEN NULL WHEN d.doc_id % 43 = 0 THEN 'zzz 05, Sat'
           ELSE strftime(DATE '2016-01-01' + CAST((d.doc_id * 7) % 366 AS INTEGER), '%b %d, %a') END AS date_text,
      CAST((d.doc_id // 50) % (2 + (d.doc_id % 50) % 8) - 1 AS INTEGER) AS topic,
      CASE WHEN lb.doc_id IS NULL THEN NULL WHEN lb.toxic = 1 THEN 'anger' WHEN lb.quality = 1 THEN 'joy'
           ELSE 'sadness' END AS label
    FROM documents d LEFT JOIN labels lb ON lb.doc_id = d.doc_id
  ) j
),
located AS (SELECT * FROM journals WHERE trail_club IS DISTINCT FROM 'No Club')
"""


def _with(body: str, extra: str = "") -> str:
    return "WITH " + JOURNALS + (("," + extra) if extra else "") + "\n" + body


SQL: dict[str, str] = {}

SQL["location_top3_words"] = _with("""
SELECT location_name, string_agg(topic_words, ', ' ORDER BY rn) AS top_topics
FROM (
  SELECT *, row_number() OVER (PARTITION BY location_name ORDER BY counts DESC, topic, topic_words) AS rn
  FROM (SELECT location_name, topic, topic_words, count(*) AS counts FROM located
        WHERE location_name IS NOT NULL GROUP BY location_name, topic, topic_words) g
) r WHERE rn <= 3 GROUP BY location_name
""")

SQL["location_topic_share"] = _with("""
SELECT location_name, topic, n, n / sum(n) OVER (PARTITION BY location_name) AS share
FROM (SELECT location_name, topic, count(*) AS n FROM located WHERE location_name IS NOT NULL
      GROUP BY location_name, topic) g
""")

SQL["location_top5_padded"] = _with("""
SELECT location_name, topic, n, share, rank FROM (
  SELECT location_name, topic, n, share,
         CAST(row_number() OVER (PARTITION BY location_name ORDER BY share DESC, topic) AS INTEGER) AS rank
  FROM (
    SELECT l.location_name, t.topic, coalesce(g.n, 0) AS n,
           coalesce(g.n / sum(g.n) OVER (PARTITION BY l.location_name), 0.0) AS share
    FROM (SELECT DISTINCT location_name FROM located WHERE location_name IS NOT NULL) l
    CROSS JOIN (SELECT DISTINCT topic FROM located WHERE location_name IS NOT NULL) t
    LEFT JOIN (SELECT location_name, topic, count(*) AS n FROM located WHERE location_name IS NOT NULL
               GROUP BY location_name, topic) g
      ON g.location_name = l.location_name AND g.topic = t.topic
  ) dense
) r WHERE rank <= 5
""")

SQL["few_topics_report"] = _with("""
SELECT location_name, count(DISTINCT topic) AS n_topics FROM located
WHERE topic <> -1 AND location_name IS NOT NULL GROUP BY location_name HAVING count(DISTINCT topic) < 5
""")

SQL["location_top3_entries"] = _with("""
SELECT t.location_name, t.latitude, t.longitude, t.top_topics, e.journal_id, e.journal_entry
FROM (
  SELECT location_name, latitude, longitude, string_agg(topic_words, ', ' ORDER BY rn) AS top_topics,
         list(topic) AS topics
  FROM top GROUP BY location_name, latitude, longitude
) t
JOIN (SELECT location_name, topic, journal_id, coalesce(journal_story, 'None') AS journal_entry
      FROM located WHERE location_name IS NOT NULL) e
  ON e.location_name = t.location_name AND list_contains(t.topics, e.topic)
""", """
top AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY location_name
                                 ORDER BY counts DESC, latitude, longitude, topic, topic_words) AS rn
    FROM (SELECT location_name, latitude, longitude, topic, topic_words, count(*) AS counts FROM located
          WHERE location_name IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL
          GROUP BY ALL) g
  ) r WHERE rn <= 3
)""")

SQL["location_entries_wide"] = _with("""
SELECT t.location_name, t.latitude, t.longitude, t.top_topics, c.number_of_journals,
       t.s[1] AS journal_entry_1, t.s[2] AS journal_entry_2, t.s[3] AS journal_entry_3,
       t.s[4] AS journal_entry_4, t.s[5] AS journal_entry_5
FROM (
  SELECT location_name, latitude, longitude, string_agg(topic_words, ', ' ORDER BY rn) AS top_topics,
         list(journal_story ORDER BY rn) AS s
  FROM (SELECT *, row_number() OVER (PARTITION BY location_name
                   ORDER BY counts DESC, latitude, longitude, topic, topic_words, journal_story) AS rn FROM g) r
  WHERE rn <= 3 GROUP BY location_name, latitude, longitude
) t JOIN (SELECT location_name, latitude, longitude, count(*) AS number_of_journals FROM g GROUP BY ALL) c
  USING (location_name, latitude, longitude)
""", """
g AS (SELECT location_name, latitude, longitude, topic, topic_words, journal_story, count(*) AS counts
      FROM located WHERE location_name IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL
        AND journal_story IS NOT NULL
      GROUP BY ALL)""")

_Q5_COLS = ",\n".join(
    [f"w[{i}] AS topic_{i}_words" if j == 0 else f"s[{j}] AS topic_{i}_journal_entry_{j}"
     for i in range(1, 4) for j in range(0, 6)])

SQL["location_first_n"] = _with(f"""
SELECT label, location_name, latitude, longitude,
{_Q5_COLS}
FROM (
  SELECT label, location_name, latitude, longitude,
         list(topic_words ORDER BY pos) FILTER (WHERE pos <= 3) AS w,
         list(journal_story ORDER BY pos) AS s
  FROM (SELECT *, row_number() OVER (PARTITION BY label, location_name, latitude, longitude
                                     ORDER BY journal_id) AS pos
        FROM located WHERE label IS NOT NULL AND location_name IS NOT NULL
          AND latitude IS NOT NULL AND longitude IS NOT NULL) r
  WHERE pos <= 5 GROUP BY label, location_name, latitude, longitude
) a
""")

_Q6_COLS = ",\n".join(
    [f"max(CASE WHEN topic_rank = {i} THEN topic_words END) AS topic_{i}_words" if j == 0 else
     f"max(CASE WHEN topic_rank = {i} THEN e[{j}] END) AS topic_{i}_entry_{j}"
     for i in range(1, 4) for j in range(0, 6)])

SQL["coordinate_top3_entries"] = _with(f"""
SELECT label, latitude, longitude,
{_Q6_COLS}
FROM (
  SELECT t.label, t.latitude, t.longitude, t.topic_rank, coalesce(w.topic_words, '') AS topic_words,
         (SELECT list(journal_story ORDER BY journal_id) FROM (
             SELECT journal_story, journal_id FROM base b
             WHERE b.label = t.label AND b.latitude = t.latitude AND b.longitude = t.longitude AND b.topic = t.topic
             ORDER BY journal_id LIMIT 5)) AS e
  FROM (SELECT * FROM (
          SELECT label, latitude, longitude, topic,
                 row_number() OVER (PARTITION BY label, latitude, longitude ORDER BY count(*) DESC, topic) AS topic_rank
          FROM base GROUP BY label, latitude, longitude, topic) x WHERE topic_rank <= 3) t
  LEFT JOIN (SELECT topic, min(topic_words) AS topic_words FROM base GROUP BY topic) w ON w.topic = t.topic
) p GROUP BY label, latitude, longitude
""", """
base AS (SELECT * FROM journals WHERE latitude IS DISTINCT FROM -1
         AND label IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL AND topic IS NOT NULL)""")

SQL["emotion_location_summary"] = _with("""
SELECT s.label, s.location_name AS location, s.number_of_journals,
       w.w[1] AS topic_1_words, w.w[2] AS topic_2_words, w.w[3] AS topic_3_words,
       e.s[1] AS journal_entry_1, e.s[2] AS journal_entry_2, e.s[3] AS journal_entry_3,
       e.s[4] AS journal_entry_4, e.s[5] AS journal_entry_5
FROM (SELECT label, location_name, count(*) AS number_of_journals FROM base GROUP BY ALL
      HAVING count(*) >= 2) s
LEFT JOIN (
  SELECT label, location_name, list(replace(topic_words, ', ', ' ') ORDER BY rn) AS w FROM (
    SELECT label, location_name, topic, min(topic_words) AS topic_words,
           row_number() OVER (PARTITION BY label, location_name ORDER BY count(*) DESC, topic) AS rn
    FROM base GROUP BY label, location_name, topic) r
  WHERE rn BETWEEN 2 AND 4 GROUP BY ALL) w USING (label, location_name)
LEFT JOIN (
  SELECT label, location_name, list(journal_story ORDER BY pos) AS s FROM (
    SELECT label, location_name, journal_story,
           row_number() OVER (PARTITION BY label, location_name ORDER BY journal_id) AS pos FROM base) r
  WHERE pos <= 5 GROUP BY ALL) e USING (label, location_name)
""", """
base AS (SELECT * FROM journals WHERE label IS NOT NULL AND location_name IS NOT NULL)""")

SQL["club_topic_freq"] = _with("""
SELECT trail_club, topic, count, rank, format('Topic {:d}: {:d}', topic, count) AS line FROM (
  SELECT trail_club, topic, count(*) AS count,
         CAST(row_number() OVER (PARTITION BY trail_club ORDER BY count(*) DESC, topic) AS INTEGER) AS rank
  FROM journals WHERE trail_club IS NOT NULL AND topic IS NOT NULL GROUP BY trail_club, topic) r
""")

SQL["club_dominant_topic"] = _with("""
SELECT d.trail_club, d.topic, d.club_count, o.overall_count, d.club_count - o.overall_count AS difference,
       d.club_count / o.overall_count AS share_of_topic, 2 * d.club_count > o.overall_count AS uniquely_frequent
FROM (SELECT trail_club, topic, club_count FROM (
        SELECT *, row_number() OVER (PARTITION BY trail_club ORDER BY club_count DESC, topic) AS rn
        FROM (SELECT trail_club, topic, count(*) AS club_count FROM base GROUP BY ALL) c) r WHERE rn = 1) d
JOIN (SELECT topic, count(*) AS overall_count FROM base GROUP BY topic) o USING (topic)
""", """
base AS (SELECT * FROM journals WHERE trail_club IS NOT NULL AND topic IS NOT NULL)""")

_ABOVE = """
share AS (SELECT trail_club, topic, n, n / sum(n) OVER (PARTITION BY trail_club) AS share
          FROM (SELECT trail_club, topic, count(*) AS n FROM journals
                WHERE trail_club IS NOT NULL AND topic IS NOT NULL GROUP BY ALL) g),
mean AS (SELECT topic, sum(share) / (SELECT count(DISTINCT trail_club) FROM share) AS mean_share
         FROM share GROUP BY topic),
hits AS (SELECT s.trail_club, s.topic, s.n, s.share, m.mean_share FROM share s JOIN mean m USING (topic)
         WHERE s.share > m.mean_share)"""

SQL["club_above_average"] = _with("SELECT trail_club, topic, n, share, mean_share FROM hits", _ABOVE)

SQL["club_above_average_lists"] = _with("""
SELECT c.trail_club, coalesce(h.topics, CAST([] AS INTEGER[])) AS topics
FROM (SELECT DISTINCT trail_club FROM journals WHERE trail_club IS NOT NULL) c
LEFT JOIN (SELECT trail_club, list(topic ORDER BY topic) AS topics FROM hits GROUP BY trail_club) h USING (trail_club)
""", _ABOVE)

SQL["topic_chart_rows"] = _with("""
SELECT g.trail_club, coalesce(a.n_topics, 0) AS n_topics, coalesce(a.lines, '') AS lines
FROM (SELECT DISTINCT trail_club FROM hits WHERE trail_club IS DISTINCT FROM 'No Club') g
LEFT JOIN (
  SELECT trail_club, count(*) AS n_topics, string_agg(line, '<br>' ORDER BY -nw, topic) AS lines FROM (
    SELECT h.trail_club, h.topic, len(wl) AS nw, format('Topic {:d}: {}', h.topic, array_to_string(wl, ', ')) AS line
    FROM hits h LEFT JOIN (
      SELECT topic, CASE WHEN len(string_split(w, ', ')) >= 3 THEN string_split(w, ', ') ELSE [] END AS wl
      FROM (SELECT topic, min(topic_words) AS w FROM journals GROUP BY topic) x) t USING (topic)
    WHERE h.trail_club IS DISTINCT FROM 'No Club' AND h.topic NOT IN (-1, 0)) l
  GROUP BY trail_club) a USING (trail_club)
""", _ABOVE)

# ---------------------------------------------------------------------------
# prep / geo / time

SQL["scan_filter_no_club"] = _with("SELECT journal_id, trail_club, location_name FROM located")
SQL["filter_latitude_sentinel"] = _with(
    "SELECT journal_id, latitude, longitude FROM journals WHERE latitude IS DISTINCT FROM -1")
SQL["drop_missing_any"] = _with("""
SELECT journal_id, location_name, trail_club, label FROM journals
WHERE location_name IS NOT NULL AND trail_club IS NOT NULL AND label IS NOT NULL""")
SQL["state_not_null"] = _with("SELECT journal_id, state FROM journals WHERE state IS NOT NULL")
SQL["crop_first_n"] = _with(
    "SELECT journal_id, trail_name, location_name FROM journals ORDER BY journal_id LIMIT 500")
SQL["split_label_counts"] = _with(
    "SELECT label, count(*) AS rows FROM journals WHERE label IS NOT NULL GROUP BY label")
SQL["combine_by_name"] = """
SELECT c_custkey AS id, c_name AS name, c_acctbal AS acctbal, c_mktsegment AS segment,
       CAST(NULL AS INTEGER) AS nationkey, 0 AS source_no FROM customer
UNION ALL
SELECT s_suppkey, s_name, s_acctbal, NULL, s_nationkey, 1 FROM supplier
"""

_POSTS = """
posts AS (SELECT c_custkey AS post_id, c_name AS trail_name, c_acctbal AS latitude FROM customer),
shelters AS (SELECT s_name AS shelter_name, s_acctbal AS latitude FROM supplier),
clubs AS (SELECT r_name AS trail_club, r_regionkey AS club_order,
                 CASE WHEN r_regionkey = 2 THEN r_regionkey * 2000.0 + 1500.0 ELSE r_regionkey * 2000.0 - 1000.0 END AS lat_start,
                 CASE WHEN r_regionkey = 2 THEN r_regionkey * 2000.0 - 1000.0 ELSE r_regionkey * 2000.0 + 1500.0 END AS lat_end
          FROM region),
assigned AS (
  SELECT p.*, (SELECT c.trail_club FROM clubs c WHERE c.lat_start <= p.latitude AND p.latitude <= c.lat_end
               ORDER BY c.club_order LIMIT 1) AS club
  FROM posts p)
"""

SQL["shelter_match"] = "WITH " + _POSTS + """
SELECT p.post_id, p.trail_name, p.latitude, s.shelter_name AS location_name
FROM posts p JOIN shelters s ON CAST(round_even(p.latitude, 0) AS BIGINT) = CAST(round_even(s.latitude, 0) AS BIGINT)
"""
SQL["shelter_unmatched"] = "WITH " + _POSTS + """
SELECT p.trail_name, p.latitude FROM posts p
WHERE NOT EXISTS (SELECT 1 FROM shelters s
                  WHERE CAST(round_even(p.latitude, 0) AS BIGINT) = CAST(round_even(s.latitude, 0) AS BIGINT))
"""
SQL["club_first_match"] = "WITH " + _POSTS + """
SELECT post_id, trail_name, latitude, coalesce(club, '') AS trail_club FROM assigned"""
SQL["club_unassigned"] = "WITH " + _POSTS + """
SELECT post_id, trail_name, latitude FROM assigned WHERE club IS NULL AND latitude IS NOT NULL"""
SQL["club_fill"] = "WITH " + _POSTS + """
SELECT post_id, trail_name, latitude, coalesce(nullif(trim(club), ''), 'No Club') AS trail_club FROM assigned"""

SQL["year_dated_rows"] = """
SELECT o_orderkey AS row_id, o_totalprice AS latitude, CAST(o_custkey AS DOUBLE) AS longitude,
       strftime(o_orderdate, '%b %d, %a') || ', ' || CAST(year(o_orderdate) AS VARCHAR) AS date_text,
       CAST(year(o_orderdate) AS VARCHAR) AS year
FROM orders WHERE o_totalprice IS NOT NULL AND o_custkey IS NOT NULL
"""

_PARSE = """
parsed AS (
  SELECT journal_id, date_text,
    CASE WHEN m.mon IS NOT NULL AND list_contains(['mon','tue','wed','thu','fri','sat','sun'], m.dow)
         THEN try_strptime('2016-' || CAST(m.mon AS VARCHAR) || '-' || m.dd, '%Y-%m-%d')::DATE END AS date
  FROM (SELECT journal_id, date_text,
          list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'],
                        lower(regexp_extract(date_text, '^([A-Za-z]{3})\\s+(\\d{1,2}),\\s+([A-Za-z]{3})$', 1))) AS mon,
          regexp_extract(date_text, '^([A-Za-z]{3})\\s+(\\d{1,2}),\\s+([A-Za-z]{3})$', 2) AS dd,
          lower(regexp_extract(date_text, '^([A-Za-z]{3})\\s+(\\d{1,2}),\\s+([A-Za-z]{3})$', 3)) AS dow
        FROM journals) m
)"""
SQL["date_parse_rejects"] = _with(
    "SELECT journal_id, date_text FROM parsed WHERE date_text IS NOT NULL AND date IS NULL", _PARSE)
SQL["journal_dates"] = _with("SELECT journal_id, date_text, date FROM parsed", _PARSE)

SQL["weekly_sentiment"] = """
WITH w AS (SELECT CAST(date_trunc('week', ts) AS DATE) + 6 AS week_end, value FROM events WHERE ts IS NOT NULL),
a AS (SELECT week_end, avg(value) AS avg_sentiment FROM w GROUP BY week_end),
cal AS (SELECT CAST(unnest(generate_series(min(week_end), max(week_end), INTERVAL 7 DAY)) AS DATE) AS week_end FROM a)
SELECT cal.week_end, a.avg_sentiment FROM cal LEFT JOIN a USING (week_end)
"""

# ---------------------------------------------------------------------------
# cleaning

_WS = (r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
       r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+")
_WORD = r"[\p{L}\p{N}_]{2,}"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}|{_WS}$', '', 'g')"


def _blank_null(x: str) -> str:
    return f"nullif({_strip(x)}, '')"


def _stop_cte(version: int) -> str:
    return f"""
bw AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{_WORD}')) AS word FROM benchmark),
extras AS (SELECT word FROM bw WHERE length(word) <= {3 if version == 1 else 2}),
stop AS (
  SELECT word, min_by(g, g * 1e12 + k) AS g, min_by(k, g * 1e12 + k) AS k FROM (
    SELECT trail_name AS word, 0 AS g, CAST(min(journal_id) AS DOUBLE) AS k FROM journals
    WHERE trail_name IS NOT NULL GROUP BY trail_name
    UNION ALL SELECT word, 1, 0.0 FROM extras) u
  GROUP BY word),
stoparr AS (SELECT list(word ORDER BY g, k, word) AS w FROM stop),
vocab AS (SELECT word FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '{_WORD}')) AS word
                            FROM documents WHERE lang = 'en') t GROUP BY word HAVING count(*) >= 2),
toks AS (SELECT journal_id, unnest(t) AS tok, generate_subscripts(t, 1) AS pos FROM (
           SELECT journal_id, string_split_regex({_strip('journal_story')}, '{_WS}') AS t FROM journals
           WHERE journal_story IS NOT NULL AND {_strip('journal_story')} <> '') x)"""


def _replace_all(x: str) -> str:
    return f"list_reduce(list_prepend({x}, (SELECT w FROM stoparr)), lambda acc, w: replace(acc, w, ''))"


SQL["stop_list"] = _with("SELECT word, g, k FROM stop", _stop_cte(1))
SQL["clean_substring"] = _with(f"""
SELECT journal_id, CASE WHEN journal_story IS NULL THEN NULL ELSE {_blank_null(_replace_all('journal_story'))} END
       AS journal_story FROM journals""", _stop_cte(2))
SQL["clean_dict_substring"] = _with(f"""
SELECT j.journal_id, CASE WHEN j.journal_story IS NULL THEN NULL
                          ELSE {_blank_null(_replace_all("coalesce(c.s, '')"))} END AS journal_story
FROM journals j LEFT JOIN (
  SELECT journal_id, string_agg(tok, ' ' ORDER BY pos) AS s FROM toks
  WHERE lower(tok) IN (SELECT word FROM vocab) GROUP BY journal_id) c USING (journal_id)""", _stop_cte(2))
SQL["clean_tokens"] = _with(f"""
SELECT j.journal_id, CASE WHEN j.journal_story IS NULL THEN NULL ELSE {_blank_null('c.s')} END AS journal_story
FROM journals j LEFT JOIN (
  SELECT journal_id, string_agg(tok, ' ' ORDER BY pos) AS s FROM toks
  WHERE lower(tok) IN (SELECT word FROM vocab) AND lower(tok) NOT IN (SELECT word FROM stop)
  GROUP BY journal_id) c USING (journal_id)""", _stop_cte(1))
SQL["valid_story_mask"] = _with("""
SELECT j.journal_id, j.journal_story IS NOT NULL AND coalesce(v.ok, false) AS valid
FROM journals j LEFT JOIN (
  SELECT DISTINCT journal_id, true AS ok FROM toks WHERE lower(tok) NOT IN (SELECT word FROM stop)) v USING (journal_id)
""", _stop_cte(1))

SQL["json_required_key"] = """
SELECT event_id, coalesce(list_contains(json_keys(props), 'k'), false) AS valid
FROM events"""
SQL["json_flatten"] = """
SELECT event_id, event_type, TRY_CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"""

# ---------------------------------------------------------------------------
# topics / language

_TERMS = _stop_cte(1) + f""",
terms AS (SELECT source, term, count(*) AS tf FROM (
            SELECT source, unnest(regexp_extract_all(lower(text), '{_WORD}')) AS term FROM documents
            WHERE source IS NOT NULL) t
          WHERE term NOT IN (SELECT word FROM stop) GROUP BY source, term),
weights AS (SELECT t.source, t.term, t.tf * ln(1 + (SELECT sum(tf) / count(DISTINCT source) FROM terms) / f.f) AS weight
            FROM terms t JOIN (SELECT term, sum(tf) AS f FROM terms GROUP BY term) f USING (term)),
ranked AS (SELECT source, term, weight,
                  CAST(row_number() OVER (PARTITION BY source ORDER BY weight DESC, term) AS INTEGER) AS rank
           FROM weights)"""

SQL["term_counts"] = _with("SELECT source, term, tf FROM terms", _TERMS)
SQL["topic_words_ctfidf"] = _with("SELECT source, term, weight, rank FROM ranked WHERE rank <= 10", _TERMS)
SQL["topic_bar"] = _with("""
SELECT r.source, s.topic_rank, r.rank AS word_rank, r.term AS word, r.weight
FROM ranked r JOIN (SELECT source, CAST(row_number() OVER (ORDER BY count(*) DESC, source) AS INTEGER) AS topic_rank
                    FROM documents WHERE source IS NOT NULL GROUP BY source QUALIFY topic_rank <= 10) s USING (source)
WHERE r.rank <= 5""", _TERMS)

SQL["topic_similarity"] = """
WITH c AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS m FROM (
             SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings
             WHERE label IS NOT NULL) t GROUP BY label, pos),
n AS (SELECT label, sqrt(sum(m * m)) AS norm FROM c GROUP BY label)
SELECT a.label AS topic_a, b.label AS topic_b, sum(a.m * b.m) / (na.norm * nb.norm) AS similarity
FROM c a JOIN c b ON a.pos = b.pos JOIN n na ON na.label = a.label JOIN n nb ON nb.label = b.label
GROUP BY a.label, b.label, na.norm, nb.norm
"""

SQL["detect_language"] = r"""
WITH g AS (
  SELECT doc_id, lang, s, length(s) AS len FROM (
    SELECT doc_id, lang, ' ' || trim(regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g')) || ' ' AS s FROM documents) x),
grams AS (SELECT doc_id, lang, substring(s, i, 3) AS gram
          FROM (SELECT doc_id, lang, s, unnest(range(1, len - 1)) AS i FROM g WHERE len >= 4) y),
nd AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
counts AS (SELECT lang, gram, count(*) AS c FROM grams WHERE lang IS NOT NULL GROUP BY lang, gram),
v AS (SELECT count(DISTINCT gram) AS v FROM counts),
langs AS (SELECT t.lang, ln(1.0 / (t.n + v.v)) AS base, ln(d.d / (SELECT count(*) FROM documents WHERE lang IS NOT NULL)) AS prior, t.n
          FROM (SELECT lang, sum(c) AS n FROM counts GROUP BY lang) t
          JOIN (SELECT lang, count(*) AS d FROM documents WHERE lang IS NOT NULL GROUP BY lang) d USING (lang), v),
profile AS (SELECT c.lang, c.gram, ln((c.c + 1.0) / (l.n + v.v)) - ln(1.0 / (l.n + v.v)) AS delta
            FROM counts c JOIN langs l USING (lang), v),
s AS (SELECT gr.doc_id, p.lang, sum(p.delta) AS d FROM grams gr JOIN profile p USING (gram) GROUP BY gr.doc_id, p.lang),
best AS (SELECT s.doc_id, s.lang FROM s JOIN langs l USING (lang) JOIN nd USING (doc_id)
         QUALIFY row_number() OVER (PARTITION BY s.doc_id ORDER BY l.prior + nd.n * l.base + s.d DESC, s.lang) = 1)
SELECT d.doc_id, b.lang AS lang_pred, coalesce(b.lang = 'en', false) AS is_english
FROM documents d LEFT JOIN best b USING (doc_id)
"""

# ---------------------------------------------------------------------------
# Q3 / Q4 per label

SQL["location_top3_entries_by_label"] = _with("""
SELECT t.label, t.location_name, t.latitude, t.longitude, t.top_topics, e.journal_id, e.journal_entry
FROM (
  SELECT label, location_name, latitude, longitude, string_agg(topic_words, ', ' ORDER BY rn) AS top_topics,
         list(topic) AS topics
  FROM top GROUP BY label, location_name, latitude, longitude
) t
JOIN (SELECT label, location_name, topic, journal_id, coalesce(journal_story, 'None') AS journal_entry
      FROM located WHERE location_name IS NOT NULL AND label IS NOT NULL) e
  ON e.label = t.label AND e.location_name = t.location_name AND list_contains(t.topics, e.topic)
""", """
top AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY label, location_name
                                 ORDER BY counts DESC, latitude, longitude, topic, topic_words) AS rn
    FROM (SELECT label, location_name, latitude, longitude, topic, topic_words, count(*) AS counts FROM located
          WHERE label IS NOT NULL AND location_name IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL
          GROUP BY ALL) g
  ) r WHERE rn <= 3
)""")

SQL["location_entries_wide_by_label"] = _with("""
SELECT t.label, t.location_name, t.latitude, t.longitude, t.top_topics, c.number_of_journals,
       t.s[1] AS journal_entry_1, t.s[2] AS journal_entry_2, t.s[3] AS journal_entry_3,
       t.s[4] AS journal_entry_4, t.s[5] AS journal_entry_5
FROM (
  SELECT label, location_name, latitude, longitude, string_agg(topic_words, ', ' ORDER BY rn) AS top_topics,
         list(journal_story ORDER BY rn) AS s
  FROM (SELECT *, row_number() OVER (PARTITION BY label, location_name
                   ORDER BY counts DESC, latitude, longitude, topic, topic_words, journal_story) AS rn FROM g) r
  WHERE rn <= 3 GROUP BY label, location_name, latitude, longitude
) t JOIN (SELECT label, location_name, latitude, longitude, count(*) AS number_of_journals FROM g GROUP BY ALL) c
  USING (label, location_name, latitude, longitude)
""", """
g AS (SELECT label, location_name, latitude, longitude, topic, topic_words, journal_story, count(*) AS counts
      FROM located WHERE label IS NOT NULL AND location_name IS NOT NULL AND latitude IS NOT NULL
        AND longitude IS NOT NULL AND journal_story IS NOT NULL
      GROUP BY ALL)""")

SQL["term_counts_bigrams"] = _with(f"""
SELECT source, term, count(*) AS tf FROM (
  SELECT source, unnest(list_concat(t, CASE WHEN len(t) >= 2 THEN
           list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) ELSE [] END)) AS term
  FROM (SELECT source, list_filter(regexp_extract_all(lower(text), '{_WORD}'),
                                   lambda x: NOT list_contains(sw.w, x)) AS t
        FROM documents, (SELECT list(word) AS w FROM stop) sw WHERE source IS NOT NULL) a) b
GROUP BY source, term""", _stop_cte(1))

SQL["missing_values_report"] = _with("""
SELECT "column", nulls, rows FROM (
  SELECT count(*) AS rows,
         count(*) - count(journal_story) AS journal_story, count(*) - count(trail_club) AS trail_club,
         count(*) - count(location_name) AS location_name, count(*) - count(label) AS label,
         count(*) - count(state) AS state, count(*) - count(date_text) AS date_text
  FROM journals) a
UNPIVOT (nulls FOR "column" IN (journal_story, trail_club, location_name, label, state, date_text))""")

SQL["small_groups_report"] = _with("""
SELECT label, location_name, count(*) AS entries FROM journals
WHERE label IS NOT NULL AND location_name IS NOT NULL GROUP BY label, location_name HAVING count(*) < 2""")

SQL["location_chart_rows"] = _with("""
SELECT g.location_name, coalesce(a.n_topics, 0) AS n_topics, coalesce(a.lines, '') AS lines
FROM (SELECT DISTINCT location_name FROM top5 WHERE location_name IS DISTINCT FROM 'No Club') g
LEFT JOIN (
  SELECT location_name, count(*) AS n_topics, string_agg(line, '<br>' ORDER BY -nw, rank) AS lines FROM (
    SELECT h.location_name, h.rank, len(wl) AS nw, format('Topic {:d}: {}', h.topic, array_to_string(wl, ', ')) AS line
    FROM top5 h LEFT JOIN (
      SELECT topic, CASE WHEN len(string_split(w, ', ')) >= 3 THEN string_split(w, ', ') ELSE [] END AS wl
      FROM (SELECT topic, min(topic_words) AS w FROM located GROUP BY topic) x) t USING (topic)
    WHERE h.location_name IS DISTINCT FROM 'No Club' AND h.topic NOT IN (-1, 0)) l
  GROUP BY location_name) a USING (location_name)
""", """
top5 AS (
  SELECT location_name, topic, rank FROM (
    SELECT location_name, topic,
           row_number() OVER (PARTITION BY location_name ORDER BY share DESC, topic) AS rank
    FROM (
      SELECT l.location_name, t.topic,
             coalesce(g.n / sum(g.n) OVER (PARTITION BY l.location_name), 0.0) AS share
      FROM (SELECT DISTINCT location_name FROM located WHERE location_name IS NOT NULL) l
      CROSS JOIN (SELECT DISTINCT topic FROM located WHERE location_name IS NOT NULL) t
      LEFT JOIN (SELECT location_name, topic, count(*) AS n FROM located WHERE location_name IS NOT NULL
                 GROUP BY location_name, topic) g
        ON g.location_name = l.location_name AND g.topic = t.topic) d) r
  WHERE rank <= 5)""")

# ---------------------------------------------------------------------------
# T16 sentiment: naive Bayes over whole texts; blank stories are not scored

_SENTIMENT = rf"""
lab AS (
  SELECT d.doc_id, CAST(2 + l.quality - 2 * l.toxic AS INTEGER) AS cls, d.text FROM documents d JOIN labels l USING (doc_id)
  WHERE d.text IS NOT NULL AND l.quality IS NOT NULL AND l.toxic IS NOT NULL),
counts AS (SELECT cls, gram, count(*) AS c FROM (
  SELECT cls, unnest(regexp_extract_all(lower(text), '{_WORD}')) AS gram FROM lab) x GROUP BY cls, gram),
v AS (SELECT count(DISTINCT gram) AS v FROM counts),
classes AS (
  SELECT t.cls, ln(1.0 / (t.n + v.v)) AS base, ln(d.d / (SELECT count(*) FROM lab)) AS prior, t.n
  FROM (SELECT cls, sum(c) AS n FROM counts GROUP BY cls) t JOIN (SELECT cls, count(*) AS d FROM lab GROUP BY cls) d USING (cls), v),
profile AS (
  SELECT c.cls, c.gram, ln((c.c + 1.0) / (l.n + v.v)) - ln(1.0 / (l.n + v.v)) AS delta FROM counts c JOIN classes l USING (cls), v),
story AS (
  SELECT journal_id, unnest(regexp_extract_all(lower(journal_story), '{_WORD}')) AS gram FROM journals
  WHERE {_blank_null('journal_story')} IS NOT NULL),
nd AS (SELECT journal_id, count(*) AS n FROM story GROUP BY journal_id),
sums AS (SELECT s.journal_id, p.cls, sum(p.delta) AS d FROM story s JOIN profile p USING (gram) GROUP BY s.journal_id, p.cls),
scored AS (
  SELECT nd.journal_id, l.cls AS sentiment FROM nd CROSS JOIN classes l
  LEFT JOIN sums ON sums.journal_id = nd.journal_id AND sums.cls = l.cls
  QUALIFY row_number() OVER (PARTITION BY nd.journal_id ORDER BY l.prior + nd.n * l.base + coalesce(sums.d, 0) DESC, l.cls) = 1)
"""

SQL["sentiment_score"] = _with("""
SELECT journal_id, sentiment FROM journals LEFT JOIN scored USING (journal_id)
""", _SENTIMENT)

SQL["sentiment_weekly"] = _with("""
, w AS (SELECT CAST(date_trunc('week', date) AS DATE) + 6 AS week_end, sentiment FROM parsed LEFT JOIN scored USING (journal_id) WHERE date IS NOT NULL),
a AS (SELECT week_end, avg(sentiment) AS avg_sentiment FROM w GROUP BY week_end),
cal AS (SELECT CAST(unnest(generate_series(min(week_end), max(week_end), INTERVAL 7 DAY)) AS DATE) AS week_end FROM a)
SELECT cal.week_end, a.avg_sentiment FROM cal LEFT JOIN a USING (week_end)
""", _PARSE.rstrip() + "," + _SENTIMENT)

# ---------------------------------------------------------------------------
# Raw text beside the cleaned one

SQL["clean_keep_raw"] = _with("""
SELECT journal_id, journal_story AS journal_story_raw, cleaned AS journal_story FROM journals LEFT JOIN (
  SELECT journal_id, """ + _blank_null("string_agg(tok, ' ' ORDER BY pos)") + """ AS cleaned FROM toks
  WHERE lower(tok) IN (SELECT word FROM vocab) AND lower(tok) NOT IN (SELECT word FROM stop)
  GROUP BY journal_id) c USING (journal_id)""", _stop_cte(1))

SQL["shelter_match_2dp"] = "WITH " + _POSTS + """
SELECT p.post_id, p.trail_name, CAST(p.latitude AS DOUBLE) / 700 AS latitude, s.shelter_name AS location_name
FROM posts p JOIN shelters s
  ON CAST(round(CAST(p.latitude AS DOUBLE) / 700 * 100) AS BIGINT) = CAST(round(CAST(s.latitude AS DOUBLE) / 700 * 100) AS BIGINT)
"""

# ---------------------------------------------------------------------------
# T10 / T15 over given cluster columns

SQL["topic_label_given"] = """
WITH s AS (SELECT label, count(*) AS n, min(vec_id) AS f FROM embeddings WHERE label IS NOT NULL GROUP BY label HAVING count(*) >= 45),
r AS (SELECT label, CAST(row_number() OVER (ORDER BY n DESC, f) - 1 AS INTEGER) AS topic FROM s)
SELECT vec_id, e.label, CASE WHEN e.label IS NOT NULL THEN coalesce(topic, -1) END AS topic FROM embeddings e LEFT JOIN r ON r.label = e.label
"""
SQL["topic_per_group_given"] = """
WITH s AS (SELECT source, lang, count(*) AS n, min(doc_id) AS f FROM documents
           WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY source, lang HAVING count(*) >= 5),
r AS (SELECT source, lang, CAST(row_number() OVER (PARTITION BY source ORDER BY n DESC, f) - 1 AS INTEGER) AS topic FROM s)
SELECT doc_id, d.source, d.lang, CASE WHEN d.source IS NOT NULL AND d.lang IS NOT NULL THEN coalesce(topic, -1) END AS topic
FROM documents d LEFT JOIN r ON r.source = d.source AND r.lang = d.lang
"""
SQL["topic_group_skipped"] = _with("""
SELECT trail_club, count(*) AS rows FROM journals WHERE trail_club IS NOT NULL GROUP BY trail_club HAVING count(*) < 60
""")

SQL["journal_dates_strict"] = _with("""
SELECT journal_id, date_text, CASE WHEN month(date) = 2 AND day(date) = 29 THEN NULL ELSE date END AS date FROM parsed
""", _PARSE)
SQL["json_nested_flatten"] = """
SELECT event_id, value AS lat, CAST(user_id AS DOUBLE) AS lon, event_type AS timezone,
  CASE WHEN event_id % 5 <> 0 THEN event_id END AS dt, CASE WHEN event_id % 5 <> 0 THEN value END AS temp,
  CASE WHEN event_id % 5 <> 0 AND event_id % 3 <> 0 THEN user_id END AS weather_id,
  CASE WHEN event_id % 5 <> 0 AND event_id % 3 <> 0 THEN event_type END AS weather_main
FROM events
"""

SQL["attribution_chain"] = "WITH " + _POSTS + """
SELECT a.post_id, a.trail_name, a.latitude, s.shelter_name AS location_name, a.club AS trail_club
FROM assigned a LEFT JOIN shelters s ON CAST(round_even(a.latitude, 0) AS BIGINT) = CAST(round_even(s.latitude, 0) AS BIGINT)
WHERE a.latitude IS NOT NULL AND coalesce(trim(a.club), '') <> ''
"""


def _lloyd(points: str, keys: str, k: int, rounds: int) -> str:
    """K-means of every group of ``points`` (keys, id, v) written out round by round; the last assignment is ``assigned``."""
    best = """
SELECT {keys}, id, v, cluster FROM (
  SELECT p.*, c.cluster, row_number() OVER (PARTITION BY id ORDER BY list_dot_product(p.v, c.c) - list_dot_product(c.c, c.c) / 2 DESC, c.cluster) AS r
  FROM points p JOIN c{i} c USING ({keys})) WHERE r = 1"""
    out = f"""points AS MATERIALIZED ({points}),
c0 AS MATERIALIZED (
  SELECT {keys}, r - 1 AS cluster, v AS c FROM (
    SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY md5(CAST(id AS VARCHAR)), id) AS r FROM points) WHERE r <= {k}),"""
    for i in range(rounds):
        out += f"""
a{i} AS MATERIALIZED ({best.format(keys=keys, i=i)}),
m{i} AS (SELECT {keys}, cluster, list(m ORDER BY i) AS m FROM (
  SELECT {keys}, cluster, i, avg(x) AS m FROM (SELECT {keys}, cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{i}) GROUP BY ALL) GROUP BY ALL),
c{i + 1} AS MATERIALIZED (SELECT {keys}, cluster, coalesce(m, c) AS c FROM c{i} LEFT JOIN m{i} USING ({keys}, cluster)),"""
    return out + f"""
assigned AS MATERIALIZED ({best.format(keys=keys, i=rounds)}),
sizes AS (SELECT {keys}, cluster, count(*) AS n, min(id) AS f FROM assigned GROUP BY ALL HAVING count(*) >= 2),
ids AS (SELECT {keys}, cluster, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, f) - 1 AS INTEGER) AS topic FROM sizes),
labelled AS (SELECT {keys}, id, coalesce(topic, -1) AS topic FROM assigned LEFT JOIN ids USING ({keys}, cluster))"""


def _group_points(keys: str, source: str, least: int) -> str:
    return f"""
  SELECT {keys}, journal_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM {source} JOIN (SELECT vec_id, embedding FROM embeddings) ON vec_id = journal_id
  WHERE {" AND ".join(f"{k.strip()} IS NOT NULL" for k in keys.split(","))}
  QUALIFY count(*) OVER (PARTITION BY {keys}) >= {least}"""


SQL["topic_per_group_vectors"] = _with("""
SELECT id AS journal_id, trail_club, topic FROM labelled
""", _lloyd(_group_points("trail_club", "journals", 10), "trail_club", 3, 4))
SQL["emotion_location_vectors"] = _with("""
SELECT label, location_name, topic, count(*) AS n_journals, min(id) AS first_journal FROM labelled GROUP BY ALL
""", _lloyd(_group_points("label, location_name", "journals", 2), "label, location_name", 3, 4))

_MERGES = """
WITH RECURSIVE dims AS (
  SELECT label AS topic, i, avg(x) AS m FROM (
    SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE label IS NOT NULL) GROUP BY ALL),
mean AS (SELECT topic, list(m ORDER BY i) AS m FROM dims GROUP BY topic),
t AS (
  SELECT topic, m, n, f FROM mean JOIN (SELECT label AS topic, count(*) AS n, min(vec_id) AS f FROM embeddings GROUP BY label) USING (topic)),
s(step, topic, size, first, v, members, gone, into_topic, sim) AS (
  SELECT 0, topic, CAST(n AS DOUBLE), f, [x / sqrt(list_dot_product(m, m)) for x in m], [topic], NULL::INTEGER, NULL::INTEGER, NULL::DOUBLE FROM t
  UNION ALL
  SELECT s.step + 1, s.topic, CASE WHEN s.topic = q.keep THEN q.size ELSE s.size END, CASE WHEN s.topic = q.keep THEN q.first ELSE s.first END,
    CASE WHEN s.topic = q.keep THEN q.v ELSE s.v END, CASE WHEN s.topic = q.keep THEN q.members ELSE s.members END, q.gone, q.keep, q.sim
  FROM s, (
    SELECT k.topic AS keep, g.topic AS gone, k.size + g.size AS size, least(k.first, g.first) AS first, list_concat(k.members, g.members) AS members,
      [(k.v[i] * k.size + g.v[i] * g.size) / (k.size + g.size) for i in range(1, len(k.v) + 1)] AS v, list_dot_product(k.v, g.v) AS sim
    FROM s k JOIN s g ON k.topic <> g.topic AND (k.size > g.size OR k.size = g.size AND (k.first < g.first OR k.first = g.first AND k.topic < g.topic))
    ORDER BY sim DESC, least(k.topic, g.topic), greatest(k.topic, g.topic) LIMIT 1) q
  WHERE s.topic <> q.gone)
"""
SQL["topic_hierarchy_given"] = _MERGES + """
SELECT DISTINCT CAST(step AS INTEGER) AS step, CAST(gone AS INTEGER) AS topic, CAST(into_topic AS INTEGER) AS "into", sim AS similarity FROM s WHERE step > 0
"""
SQL["topic_reduce_given"] = _MERGES + """,
ends AS (
  SELECT topic AS cluster, unnest(members) AS label FROM s WHERE step = (SELECT greatest(0, count(*) - 4) FROM t)),
ranked AS (
  SELECT cluster, CAST(row_number() OVER (ORDER BY count(*) DESC, min(vec_id)) - 1 AS INTEGER) AS new FROM embeddings JOIN ends USING (label) GROUP BY cluster)
SELECT vec_id, new AS topic FROM embeddings JOIN ends USING (label) JOIN ranked USING (cluster)
"""

SQL["topic_density_given"] = """
WITH RECURSIVE raw AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
u AS (SELECT vec_id, [c / sqrt(list_dot_product(x, x)) for c in x] AS v FROM raw),
near AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.v, b.v) AS cos FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.v, b.v) >= 0.35),
core AS MATERIALIZED (SELECT a AS vec_id FROM near GROUP BY a HAVING count(*) + 1 >= 5),
links AS MATERIALIZED (SELECT a, b FROM near WHERE a IN (SELECT vec_id FROM core) AND b IN (SELECT vec_id FROM core)),
reach(node, seen) AS (SELECT vec_id, vec_id FROM core UNION SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.seen),
known AS (SELECT node AS vec_id, min(seen) AS cluster FROM reach GROUP BY node),
border AS (
  SELECT a AS vec_id, first(b ORDER BY cos DESC, b) AS core FROM near
  WHERE a NOT IN (SELECT vec_id FROM core) AND b IN (SELECT vec_id FROM core) GROUP BY a),
placed AS (SELECT vec_id, cluster FROM known UNION ALL SELECT border.vec_id, cluster FROM border JOIN known ON known.vec_id = border.core),
ids AS (SELECT cluster, CAST(row_number() OVER (ORDER BY count(*) DESC, min(vec_id)) - 1 AS INTEGER) AS topic FROM placed GROUP BY cluster)
SELECT vec_id, coalesce(topic, -1) AS topic FROM raw LEFT JOIN placed USING (vec_id) LEFT JOIN ids USING (cluster)
"""
SQL["csv_round_trip"] = "SELECT doc_id, sha256(text) AS story_sha256, CAST(length(text) AS BIGINT) AS n_chars, lang FROM documents"
SQL["csv_row_index"] = _with("SELECT row_number() OVER (ORDER BY journal_id) - 1 AS row_index, journal_id, trail_name, state FROM journals")
SQL["csv_folder_union"] = """
SELECT 0 AS source_no, CAST(c_custkey AS BIGINT) AS id, c_name AS name, CAST(c_acctbal AS DOUBLE) AS acctbal, c_mktsegment AS segment, CAST(NULL AS BIGINT) AS nationkey
FROM customer
UNION ALL SELECT 1, CAST(s_suppkey AS BIGINT), s_name, CAST(s_acctbal AS DOUBLE), NULL, CAST(s_nationkey AS BIGINT) FROM supplier
"""
SQL["year_dated_files"] = SQL["year_dated_rows"]
SQL["split_label_files"] = _with("""
SELECT label, count(*) AS rows, min(journal_id) AS first_id, max(journal_id) AS last_id, count(trail_club) AS with_club
FROM journals WHERE label IS NOT NULL GROUP BY label
""")
SQL["location_entry_cells"] = "WITH long AS (" + SQL["location_top3_entries"] + """),
placed AS (
  SELECT *, CAST(floor((sum(strlen(journal_entry) + 3) OVER (PARTITION BY location_name, latitude, longitude, top_topics ORDER BY journal_id, journal_entry
    ROWS UNBOUNDED PRECEDING) - strlen(journal_entry) - 3) / 65536) AS BIGINT) AS chunk FROM long WHERE journal_entry IS NOT NULL)
SELECT location_name, latitude, longitude, top_topics, chunk, count(*) AS n_entries, sha256(string_agg(journal_entry, ' | ' ORDER BY journal_id, journal_entry)) AS entries_sha256
FROM placed GROUP BY ALL
"""
SQL["score_argmax"] = "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS best FROM embeddings"
SQL["valid_english_story"] = f"""
SELECT journal_id, valid AND is_english AS valid
FROM ({SQL["valid_story_mask"].replace("lower(tok) NOT IN", "tok NOT IN")}) v JOIN ({SQL["detect_language"]}) l ON l.doc_id = v.journal_id
"""
SQL["topic_assign_given"] = _with(f"""
SELECT journal_id, trail_club, coalesce(e.label, -1) AS topic, coalesce(words, '') AS topic_words
FROM journals LEFT JOIN (SELECT vec_id, label FROM embeddings) e ON vec_id = journal_id LEFT JOIN words ON words.topic = coalesce(e.label, -1)
""", _stop_cte(1) + f""",
cleaned AS ({SQL["clean_dict_substring"]}),
terms AS (
  SELECT topic, term, count(*) AS tf FROM (
    SELECT label AS topic, unnest(regexp_extract_all(lower(journal_story), '{_WORD}')) AS term
    FROM cleaned JOIN (SELECT vec_id, label FROM embeddings) e ON vec_id = journal_id WHERE label IS NOT NULL) t
  WHERE term NOT IN (SELECT word FROM stop) GROUP BY ALL),
weights AS (
  SELECT t.topic, t.term, t.tf * ln(1 + (SELECT sum(tf) / count(DISTINCT topic) FROM terms) / f.f) AS weight
  FROM terms t JOIN (SELECT term, sum(tf) AS f FROM terms GROUP BY term) f USING (term)),
words AS (
  SELECT topic, string_agg(term, ', ' ORDER BY weight DESC, term) AS words FROM (
    SELECT * FROM weights QUALIFY row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) <= 10) r GROUP BY topic)""")
