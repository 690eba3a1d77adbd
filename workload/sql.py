"""Shared pieces of the reference SQL."""

from cuesheet.functions.wordlists import INTENSITY_WORDS, PRONOUNS, STOP_WORDS


def word_set(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


STOP, INTENSE, PRON = word_set(STOP_WORDS), word_set(INTENSITY_WORDS), word_set(PRONOUNS)
SPACES = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
TOKEN = rf"[\p{{L}}\p{{M}}\p{{N}}_]+|[^\p{{L}}\p{{M}}\p{{N}}_{SPACES}]"
TERM = r"[\p{L}\p{M}\p{N}_]{2,}"

LINES = """lines AS (
  SELECT doc_id, pos, trim(raw) AS line FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS pos
    FROM documents) WHERE trim(raw) <> '')"""
TOKENS = f"""tokens AS (SELECT doc_id, pos, unnest(regexp_extract_all(lower(line), '{TOKEN}')) AS tok FROM lines)"""


def tfidf(stop: bool) -> str:
    keep = f"WHERE term NOT IN ({STOP})" if stop else ""
    return f"""{LINES},
terms AS (SELECT * FROM (SELECT doc_id, pos, unnest(regexp_extract_all(lower(line), '{TERM}')) AS term FROM lines) {keep}),
tf AS (SELECT doc_id, pos, term, count(*) AS tf FROM terms GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY ALL),
df AS (SELECT doc_id, term, count(*) AS df FROM tf GROUP BY ALL),
w AS (SELECT tf.doc_id, tf.pos, tf.term, tf.tf * (ln((1.0 + n.n) / (1.0 + df.df)) + 1) AS w
      FROM tf JOIN df USING (doc_id, term) JOIN n USING (doc_id)),
norm AS (SELECT doc_id, pos, sqrt(sum(w * w)) AS len FROM w GROUP BY ALL),
u AS (SELECT w.doc_id, w.pos, w.term, w.w / norm.len AS weight FROM w JOIN norm USING (doc_id, pos))"""


KEYWORDS = tfidf(True) + """,
scored AS (SELECT doc_id, term, round(sum(weight), 9) AS score FROM u GROUP BY ALL),
keywords AS (SELECT * FROM (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank
             FROM scored) WHERE rank <= 10)"""
REPETITION = """pairs AS (SELECT a.doc_id, a.pos AS p, b.pos AS q FROM u a JOIN u b ON a.doc_id = b.doc_id AND a.term = b.term AND a.pos < b.pos
          GROUP BY ALL HAVING sum(a.weight * b.weight) > 0.95),
repetition AS (SELECT n.doc_id, CASE WHEN n.n < 2 THEN 0.0 ELSE count(p.p) / (n.n * (n.n - 1) / 2.0) END AS repetition_rate
               FROM n LEFT JOIN pairs p ON n.doc_id = p.doc_id GROUP BY n.doc_id, n.n)"""

# word lexicons, derived by a rule from the words of the benchmark table
WORDS = "words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark)"
POLARITY = "polarity AS (SELECT word, ((length(word) * 7) % 21 - 10) / 10.0::DOUBLE AS polarity FROM words)"
EMOTIONS = """emotions AS (
  SELECT word, 'anger' AS emotion, CASE WHEN length(word) % 2 = 0 THEN 1 ELSE 0 END AS value FROM words UNION ALL
  SELECT word, 'fear', CASE WHEN length(word) % 3 = 0 THEN 1 ELSE 0 END FROM words UNION ALL
  SELECT word, 'joy', CASE WHEN length(word) % 5 = 0 THEN 1 ELSE 0 END FROM words UNION ALL
  SELECT word, 'trust', 1 FROM words WHERE left(word, 1) IN ('a', 'e', 'i', 'o', 'u'))"""
TAGS = """tags AS (SELECT word,
  ['NOUN', 'VERB', 'VERB', 'ADJ', 'PRON', 'AUX'][length(word) % 6 + 1] AS class,
  ['NN', 'VBD', 'VBZ', 'JJ', 'PRP', 'MD'][length(word) % 6 + 1] AS tag FROM words)"""
LINE_POLARITY = """line_polarity AS (
  SELECT l.doc_id, l.pos, coalesce(avg(p.polarity), 0) AS polarity
  FROM lines l LEFT JOIN tokens t ON l.doc_id = t.doc_id AND l.pos = t.pos LEFT JOIN polarity p ON t.tok = p.word GROUP BY ALL)"""
EMOTION_SUMS = """hits AS (SELECT d.doc_id, e.emotion, sum(e.value) AS s
  FROM (SELECT DISTINCT doc_id, tok FROM tokens) d JOIN emotions e ON d.tok = e.word GROUP BY ALL),
emo AS (SELECT l.doc_id,
  coalesce(sum(s) FILTER (emotion = 'anger') / nullif(sum(s), 0), 0.0) AS emotion_anger,
  coalesce(sum(s) FILTER (emotion = 'fear') / nullif(sum(s), 0), 0.0) AS emotion_fear,
  coalesce(sum(s) FILTER (emotion = 'joy') / nullif(sum(s), 0), 0.0) AS emotion_joy,
  coalesce(sum(s) FILTER (emotion = 'trust') / nullif(sum(s), 0), 0.0) AS emotion_trust
  FROM (SELECT DISTINCT doc_id FROM lines) l LEFT JOIN hits USING (doc_id) GROUP BY l.doc_id)"""
GRAMMAR = """tagged AS (SELECT t.doc_id, g.class, g.tag FROM tokens t LEFT JOIN tags g ON t.tok = g.word),
grammar AS (SELECT doc_id, count(*) AS n,
  count(*) FILTER (class = 'NOUN') AS noun, count(*) FILTER (class = 'VERB') AS verb, count(*) FILTER (class = 'ADJ') AS adj,
  count(*) FILTER (class = 'PRON') AS pron,
  count(*) FILTER (tag IN ('VBD', 'VBN')) AS past, count(*) FILTER (tag IN ('VB', 'VBP', 'VBZ', 'VBG')) AS present,
  count(*) FILTER (tag = 'MD') AS future FROM tagged GROUP BY doc_id),
shares AS (SELECT doc_id, nullif(noun, 0) / n AS pos_noun, nullif(verb, 0) / n AS pos_verb, nullif(adj, 0) / n AS pos_adjective,
  pron / n AS pronoun_usage,
  CASE WHEN past + present + future = 0 THEN 0.0 ELSE nullif(past, 0) / (past + present + future) END AS tense_past,
  CASE WHEN past + present + future = 0 THEN 0.0 ELSE nullif(present, 0) / (past + present + future) END AS tense_present,
  CASE WHEN past + present + future = 0 THEN 0.0 ELSE nullif(future, 0) / (past + present + future) END AS tense_future
  FROM grammar)"""


def line_clusters(k: int = 5, rounds: int = 40) -> str:
    """Lloyd's rounds on the term weights of the distinct lines of every document, until ``rounds`` are done.

    The first k distinct lines are the first centers. More rounds than any document needs to settle change nothing.
    """
    return f"""WITH RECURSIVE {tfidf(False)},
keyed AS (SELECT l.doc_id, l.pos, coalesce(string_agg(tf.term || ':' || tf.tf, ' ' ORDER BY tf.term), '') AS key
          FROM lines l LEFT JOIN tf ON l.doc_id = tf.doc_id AND l.pos = tf.pos GROUP BY l.doc_id, l.pos),
prof AS (SELECT doc_id, min(pos) AS pos, count(*) AS copies FROM keyed GROUP BY doc_id, key),
big AS (SELECT doc_id FROM prof GROUP BY doc_id HAVING sum(copies) >= {k}),
items AS (SELECT p.*, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS turn FROM prof p JOIN big USING (doc_id)),
vecs AS (SELECT i.doc_id, i.pos, i.copies, u.term, u.weight AS w FROM items i JOIN u ON u.doc_id = i.doc_id AND u.pos = i.pos),
labels AS (
  SELECT 0 AS round, doc_id, pos, turn AS cluster FROM items WHERE turn < {k}
  UNION ALL
  SELECT round, doc_id, pos, cluster FROM (
    WITH now AS (SELECT * FROM labels),
    size AS (SELECT n.doc_id, n.cluster, sum(i.copies) AS n FROM now n JOIN items i ON n.doc_id = i.doc_id AND n.pos = i.pos GROUP BY ALL),
    center AS (SELECT n.doc_id, n.cluster, v.term, sum(v.copies * v.w) / any_value(s.n) AS c
               FROM now n JOIN vecs v ON n.doc_id = v.doc_id AND n.pos = v.pos JOIN size s ON s.doc_id = n.doc_id AND s.cluster = n.cluster GROUP BY ALL),
    bias AS (SELECT s.doc_id, s.cluster, -coalesce(sum(c.c * c.c), 0) / 2 AS b FROM size s LEFT JOIN center c ON c.doc_id = s.doc_id AND c.cluster = s.cluster GROUP BY ALL),
    met AS (SELECT v.doc_id, v.pos, c.cluster, sum(v.w * c.c) AS s FROM vecs v JOIN center c ON c.doc_id = v.doc_id AND c.term = v.term GROUP BY ALL),
    score AS (SELECT i.doc_id, i.pos, b.cluster, round(b.b + coalesce(m.s, 0), 9) AS s FROM items i JOIN bias b ON b.doc_id = i.doc_id
              LEFT JOIN met m ON m.doc_id = i.doc_id AND m.pos = i.pos AND m.cluster = b.cluster)
    SELECT (SELECT max(round) + 1 FROM now) AS round, doc_id, pos, cluster FROM score
    WHERE (SELECT max(round) FROM now) < {rounds}
    QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY s DESC, cluster) = 1)),
found AS (SELECT l.doc_id, l.cluster, sum(i.copies) AS size FROM labels l JOIN items i ON l.doc_id = i.doc_id AND l.pos = i.pos WHERE round = {rounds} GROUP BY ALL),
shares AS (SELECT doc_id, count(*) AS num_clusters, max(size) / sum(size) AS dominant_cluster_ratio FROM found GROUP BY doc_id)
SELECT n.doc_id, coalesce(s.num_clusters, n.n)::BIGINT AS num_clusters, coalesce(s.dominant_cluster_ratio, 1.0)::DOUBLE AS dominant_cluster_ratio
FROM n LEFT JOIN shares s USING (doc_id)"""
