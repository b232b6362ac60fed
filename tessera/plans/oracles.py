"""DuckDB SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

POSTINGS = """postings AS (
  SELECT l_partkey AS label_id, l_orderkey AS image_id, q / sum(q) OVER (PARTITION BY l_orderkey) AS prob
  FROM (SELECT l_orderkey, l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY ALL))"""
QUERY = """query AS (
  SELECT DISTINCT l_orderkey AS query_id, 2 - l_linenumber % 2 AS clause_no, l_partkey AS label_id FROM lineitem WHERE l_orderkey % 100 = 0)"""
SCORES = f"""{POSTINGS}, {QUERY},
sizes AS (SELECT query_id, count(DISTINCT clause_no) AS k FROM query GROUP BY ALL),
sums AS (SELECT query_id, clause_no, image_id, sum(prob) AS s FROM query JOIN postings USING (label_id) GROUP BY ALL),
scores AS (SELECT query_id, image_id, product(s) AS score FROM sums JOIN sizes USING (query_id) GROUP BY query_id, image_id, k HAVING count(*) = k)"""
ONE_CLAUSE = """one AS (
  SELECT image_id AS query_id, row_number() OVER (PARTITION BY image_id ORDER BY prob DESC, label_id) AS position, label_id FROM postings WHERE image_id % 100 = 0)"""
IDF = """idf AS (SELECT label_id, ln(max(s) OVER () / s + 1) AS idf FROM (SELECT label_id, sum(prob) AS s FROM postings GROUP BY ALL))"""
GRAPH = """types AS (SELECT p_type, 3000 + row_number() OVER (ORDER BY p_type) AS type_id FROM (SELECT DISTINCT p_type FROM part)),
leaf AS (SELECT p_partkey, 1000000 + p_partkey AS synset_id, p_name, p_brand, p_type, p_size, 2000 + CAST(regexp_extract(p_brand, '(\\d+)', 1) AS BIGINT) AS brand_id, type_id FROM part JOIN types USING (p_type)),
edges AS (SELECT brand_id AS parent, synset_id AS child FROM leaf UNION ALL SELECT type_id, synset_id FROM leaf
  UNION ALL SELECT DISTINCT 1, brand_id FROM leaf UNION ALL SELECT DISTINCT 1, type_id FROM leaf),
groups AS (SELECT DISTINCT brand_id AS synset_id, p_brand AS name FROM leaf UNION ALL SELECT DISTINCT type_id, p_type FROM leaf),
labels AS (SELECT p_partkey AS label_id, synset_id, p_name AS name, p_type AS description FROM leaf
  UNION ALL SELECT NULL, synset_id, name, '' FROM groups UNION ALL SELECT NULL, 1, 'everything', '')"""
EVALUATION = f"""{POSTINGS}, {ONE_CLAUSE}, {IDF},
cfg AS (SELECT t, n FROM (VALUES (0.0::DOUBLE), (0.05), (0.1)) a(t), (VALUES (1), (2), (3)) b(n)),
ql AS (SELECT query_id, n, label_id, count(*) OVER (PARTITION BY query_id, n) AS labels FROM one, (VALUES (1), (2), (3)) b(n) WHERE position <= n),
ev AS (SELECT t, ql.n, query_id, image_id, round(sum(prob), 6) AS plain, round(sum(CASE WHEN labels > 1 THEN prob * idf ELSE prob END), 6) AS idf
  FROM ql JOIN postings USING (label_id) JOIN idf USING (label_id) JOIN cfg ON cfg.n = ql.n AND prob >= t GROUP BY ALL),
sc AS (SELECT 'plain t' || CAST(t AS VARCHAR) || ' n' || n AS config, query_id, image_id, plain AS score FROM ev
  UNION ALL SELECT 'idf t' || CAST(t AS VARCHAR) || ' n' || n, query_id, image_id, idf FROM ev),
configs AS (SELECT kind || ' t' || CAST(t AS VARCHAR) || ' n' || n AS config FROM cfg, (VALUES ('plain'), ('idf')) k(kind)),
placed AS (SELECT config, query_id, image_id, row_number() OVER (PARTITION BY config, query_id ORDER BY score DESC, image_id) AS rank FROM sc),
ranks AS (SELECT configs.config, q.query_id, q.query_id AS target_id, rank FROM configs CROSS JOIN (SELECT DISTINCT query_id FROM one) q
  LEFT JOIN placed ON placed.config = configs.config AND placed.query_id = q.query_id AND placed.image_id = q.query_id)"""
POSITIONS = f"""{POSTINGS},
placed AS (SELECT image_id, label_id, row_number() OVER (PARTITION BY image_id ORDER BY prob DESC, label_id) AS position FROM postings),
chosen AS (SELECT DISTINCT l_orderkey AS image_id, l_partkey AS label_id FROM lineitem WHERE l_returnflag = 'R'),
positions AS (SELECT * FROM placed SEMI JOIN chosen USING (image_id, label_id))"""
SUBMISSIONS = """sub AS (
  SELECT user_id % 7 AS team, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS task,
    CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS DOUBLE) AS t, event_id % 40 AS cluster, event_type = 'purchase' AS correct FROM events)"""
AD_HOC = f"""{SUBMISSIONS},
pool AS (SELECT task, count(DISTINCT cluster) AS pool FROM sub WHERE correct GROUP BY ALL),
adhoc AS (SELECT team, sub.task, coalesce(CASE WHEN count_if(correct) > 0 THEN count_if(correct) / (count_if(correct) + count_if(NOT correct) / 2.0) * count(DISTINCT CASE WHEN correct THEN cluster END) / any_value(pool) END, 0.0) AS score
  FROM sub LEFT JOIN pool ON pool.task = sub.task GROUP BY team, sub.task)"""
DAILY = """daily AS (SELECT event_type, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY ALL),
s AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i FROM daily)"""
VECTORS = """v AS (SELECT vec_id AS image_id, label AS class_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS f FROM embeddings),
u AS (SELECT image_id, class_id, list_transform(f, lambda x: x / sqrt(list_inner_product(f, f))) AS f FROM v)"""
MEANS = f"""{VECTORS},
mean AS (SELECT class_id, pos, avg(x) AS x FROM (SELECT class_id, unnest(f) AS x, unnest(range(len(f))) AS pos FROM v) GROUP BY ALL),
cls AS (SELECT class_id, list(x ORDER BY pos) AS f FROM mean GROUP BY ALL)"""
BOXES = """box AS (SELECT image_id, x1, y1, x1 + q * 6 AS x2, y1 + q * 3 AS y2, score FROM (SELECT l_orderkey AS image_id, CAST(l_partkey * 37 % 1200 AS DOUBLE) AS x1, CAST(l_suppkey * 53 % 680 AS DOUBLE) AS y1, l_quantity AS q, l_extendedprice / 10000 - l_discount * 20 AS score FROM lineitem))"""


def uniform(key: str, seed: str) -> str:
    return f"(CAST('0x' || substr(md5({key} || '-{seed}'), 1, 8) AS BIGINT) / 4294967296.0)"


def drawn(name: str, source: str, weight: str, key: str, seed: str) -> str:
    """A draw of three by weight from source (image_id, label_id, ...)."""
    return f"""{name} AS (SELECT image_id, draw, label_id FROM (SELECT image_id, label_id, row_number() OVER (PARTITION BY image_id ORDER BY ln({uniform(key, seed)} + 1e-12) / {weight} DESC, label_id) AS draw FROM {source} WHERE {weight} > 0) WHERE draw <= 3)"""


ROUNDED = f"""{POSTINGS}, rounded AS (SELECT label_id, image_id, round(prob, 6) AS prob FROM postings)"""
SHARES = """shares AS (SELECT position, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM positions GROUP BY ALL)"""
TWO = f"""{POSTINGS}, {QUERY},
one AS (SELECT query_id, image_id, sum(prob) AS score FROM query JOIN postings USING (label_id) WHERE clause_no = 1 GROUP BY ALL),
two AS (SELECT query_id, image_id, sum(prob) AS score FROM query JOIN postings USING (label_id) WHERE clause_no = 2 GROUP BY ALL)"""
PAIR = f"""{TWO},
pair AS (SELECT a.query_id, a.image_id, round(a.score * max(b.score), 6) AS score FROM one a JOIN two b ON a.query_id = b.query_id AND b.image_id BETWEEN a.image_id AND a.image_id + 4 GROUP BY a.query_id, a.image_id, a.score)"""

def feedback(rounds: int, shown: int, closest: int, config: str) -> str:
    """Tables ranks1.. of (query_id, round, rank, gap) under a prefix: choose from what is shown, rank all by what is chosen, stop at gap 0."""
    p = config
    out = [f"""{p}show0 AS (SELECT query_id, image_id FROM start WHERE rank <= {shown}), {p}act1 AS (SELECT image_id AS query_id FROM u WHERE image_id % 100 = 0)"""]
    for i in range(1, rounds + 1):
        out.append(f"""{p}pick{i} AS (SELECT query_id, image_id FROM (SELECT s.query_id, s.image_id, row_number() OVER (PARTITION BY s.query_id ORDER BY round(1 - list_cosine_similarity(x.f, t.f), 9), s.image_id) AS place
    FROM {p}show{i - 1} s JOIN {p}act{i} USING (query_id) JOIN v x ON x.image_id = s.image_id JOIN v t ON t.image_id = s.query_id) WHERE place <= {closest}),
  {p}away{i} AS (SELECT k.query_id, u.image_id, round(sum(1 - list_inner_product(q.f, u.f)), 9) AS distance FROM {p}pick{i} k JOIN u q ON q.image_id = k.image_id, u GROUP BY ALL),
  {p}all{i} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, image_id) AS rank, min(distance) OVER (PARTITION BY query_id) AS least FROM {p}away{i}),
  {p}ranks{i} AS (SELECT query_id, {i} AS round, rank, greatest(0, round(distance - least, 8)) AS gap FROM {p}all{i} WHERE image_id = query_id),
  {p}show{i} AS (SELECT query_id, image_id FROM {p}all{i} WHERE rank <= {shown}), {p}act{i + 1} AS (SELECT query_id FROM {p}ranks{i} WHERE gap > 0)""")
    every = " UNION ALL ".join(f"SELECT * FROM {p}ranks{i}" for i in range(1, rounds + 1))
    out.append(f"""{p}done AS ({every}),
  {p}last AS (SELECT query_id, max(round) AS last, arg_max(rank, round) AS rank, arg_max(gap, round) AS gap FROM {p}done GROUP BY ALL),
  {p}full AS (SELECT * FROM {p}done UNION ALL SELECT query_id, r, rank, gap FROM (SELECT *, unnest(range(last + 1, {rounds + 1})) AS r FROM {p}last))""")
    return ",\n".join(out)


START = f"""{VECTORS},
start AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, image_id) AS rank FROM (
  SELECT t.image_id AS query_id, u.image_id, round(1 - list_inner_product(q.f, u.f), 9) AS distance
  FROM u t JOIN u q ON q.image_id = (t.image_id * 7 + 13) % (SELECT count(*) FROM u), u WHERE t.image_id % 100 = 0))"""

SUPPLIERS = """postings AS (
  SELECT l_suppkey AS label_id, l_orderkey AS image_id, q / sum(q) OVER (PARTITION BY l_orderkey) AS prob
  FROM (SELECT l_orderkey, l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY ALL)),
query AS (SELECT DISTINCT l_orderkey AS query_id, l_suppkey AS label_id FROM lineitem WHERE l_orderkey % 100 = 0 AND l_linenumber <= 2)"""


def lloyd(rounds: int) -> str:
    """Tables c0.. (cluster, centre) and a (image_id, f, cluster): rounds from the first four vectors."""
    near = lambda i: f"SELECT image_id, any_value(f) AS f, min({{'d': round(list_sum(list_transform(list_zip(f, centre), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9), 'c': cluster}}).c AS cluster FROM v, c{i} GROUP BY image_id"
    out = ["c0 AS (SELECT image_id AS cluster, f AS centre FROM v WHERE image_id < 4)"]
    for i in range(rounds):
        out.append(f"""a{i} AS ({near(i)}),
  m{i} AS (SELECT cluster, list(x ORDER BY pos) AS centre FROM (SELECT cluster, pos, avg(x) AS x FROM (SELECT cluster, unnest(f) AS x, unnest(range(len(f))) AS pos FROM a{i}) GROUP BY ALL) GROUP BY cluster),
  c{i + 1} AS (SELECT * FROM m{i} UNION ALL SELECT * FROM c{i} ANTI JOIN m{i} USING (cluster))""")
    return ",\n".join([*out, f"a AS ({near(rounds)})"])


def axes(rounds: int) -> str:
    """Tables one, two (pos, x): two axes after rounds of orthogonal iteration on the covariance of v."""
    unit = lambda t: f"SELECT pos, x / sqrt(sum(x * x) OVER ()) AS x FROM {t}"
    times = lambda t: f"SELECT i AS pos, sum(c * x) AS x FROM cov JOIN {t} ON {t}.pos = j GROUP BY i"
    signed = lambda t: f"SELECT pos, x * (SELECT sign(x) FROM {t} ORDER BY round(abs(x), 9) DESC, pos LIMIT 1) AS x FROM {t}"
    out = ["""e AS (SELECT image_id, unnest(f) AS x, unnest(range(len(f))) AS pos FROM v), mu AS (SELECT pos, avg(x) AS m FROM e GROUP BY ALL),
  cov AS (SELECT xy.i, xy.j, s / (SELECT count(*) FROM v) - a.m * b.m AS c FROM (SELECT p.pos AS i, q.pos AS j, sum(p.x * q.x) AS s FROM e p JOIN e q USING (image_id) GROUP BY ALL) xy JOIN mu a ON a.pos = xy.i JOIN mu b ON b.pos = xy.j),
  u0 AS (SELECT pos, 1.0::DOUBLE AS x FROM mu), w0 AS (SELECT pos, CASE WHEN pos % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0 END AS x FROM mu)"""]
    for i in range(1, rounds + 1):
        out.append(f"""ur{i} AS ({times(f"u{i - 1}")}), u{i} AS ({unit(f"ur{i}")}), wr{i} AS ({times(f"w{i - 1}")}),
  wo{i} AS (SELECT r.pos, r.x - (SELECT sum(p.x * q.x) FROM wr{i} p JOIN u{i} q USING (pos)) * u.x AS x FROM wr{i} r JOIN u{i} u USING (pos)), w{i} AS ({unit(f"wo{i}")})""")
    return ",\n".join([*out, f"one AS ({signed(f'u{rounds}')}), two AS ({signed(f'w{rounds}')})"])


ORACLES = {
    "rank_frames": f"""WITH {POSTINGS}, {QUERY}, {IDF},
      sizes AS (SELECT query_id, count(DISTINCT clause_no) AS k FROM query GROUP BY ALL),
      sums AS (SELECT query_id, clause_no, image_id, sum(prob * idf) AS s FROM query JOIN postings USING (label_id) JOIN idf USING (label_id) GROUP BY ALL),
      scores AS (SELECT query_id, image_id, product(s) AS score FROM sums JOIN sizes USING (query_id) GROUP BY query_id, image_id, k HAVING count(*) = k),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, image_id) AS rank FROM scores)
      SELECT query_id, image_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 70""",
    "brand_query": f"""WITH {POSTINGS}, {IDF},
      q AS (SELECT p_partkey AS label_id, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 1 ELSE 2 END AS clause_no FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4')),
      sums AS (SELECT clause_no, image_id, sum(prob * idf) AS s FROM q JOIN postings USING (label_id) JOIN idf USING (label_id) GROUP BY ALL)
      SELECT image_id, round(score, 6) AS score FROM (SELECT image_id, product(s) AS score FROM sums GROUP BY ALL HAVING count(*) = 2 ORDER BY score DESC, image_id LIMIT 70)""",
    "expand_query": f"""WITH {GRAPH}, q AS (SELECT * FROM leaf WHERE p_partkey % 100 = 0)
      SELECT p_partkey AS query_id, CAST(0 AS BIGINT) AS clause_no, p_partkey AS label_id FROM q
      UNION ALL SELECT q.p_partkey, 1, b.p_partkey FROM q JOIN leaf b ON b.brand_id = q.brand_id""",
    "closure_down": f"""WITH RECURSIVE {GRAPH},
      reach(start_id, node, depth) AS (SELECT DISTINCT parent, parent, 0 FROM edges UNION SELECT start_id, child, depth + 1 FROM reach JOIN edges ON parent = node),
      best AS (SELECT start_id, node, min(depth) AS depth FROM reach GROUP BY ALL)
      SELECT start_id, CAST(depth AS INT) AS depth, count(*) AS nodes FROM best GROUP BY ALL""",
    "closure_up": f"""WITH RECURSIVE {GRAPH},
      reach(start_id, node, depth) AS (SELECT synset_id, synset_id, 0 FROM leaf UNION SELECT start_id, parent, depth + 1 FROM reach JOIN edges ON child = node)
      SELECT start_id, node, CAST(min(depth) AS INT) AS depth FROM reach GROUP BY start_id, node""",
    "build_labels": f"""WITH {GRAPH}, c AS (SELECT *, row_number() OVER (ORDER BY synset_id) - 1 AS label FROM leaf WHERE p_size >= 25)
      SELECT label AS label_id, synset_id, p_name AS names, 0 AS n_hyponyms, brand_id || ',' || type_id AS hypernyms FROM c
      UNION ALL SELECT NULL, brand_id, p_brand, CAST(count(*) AS INT), '1' FROM c GROUP BY brand_id, p_brand
      UNION ALL SELECT NULL, type_id, p_type, CAST(count(*) AS INT), '1' FROM c GROUP BY type_id, p_type
      UNION ALL SELECT NULL, 1, 'everything', CAST(count(DISTINCT brand_id) + count(DISTINCT type_id) AS INT), '' FROM c""",
    "cluster_subgraph": f"""WITH {GRAPH}
      SELECT p_size AS cluster, synset_id AS node, 2 AS n_parents, true AS is_class, false AS is_root FROM leaf
      UNION ALL SELECT DISTINCT p_size, brand_id, 1, false, false FROM leaf UNION ALL SELECT DISTINCT p_size, type_id, 1, false, false FROM leaf
      UNION ALL SELECT DISTINCT p_size, 1, 0, false, true FROM leaf""",
    "label_file": f"""WITH {GRAPH}
      SELECT p_partkey AS label_id, synset_id, p_name AS names, 0 AS n_hyponyms, 2 AS n_hypernyms, p_type AS description, CAST(len(string_split(p_name, ' ')) AS INT) AS min_words, 'leaf' AS kind FROM leaf
      UNION ALL SELECT NULL, synset_id, replace(name, '#', '-'), 0, 1, '', CAST(len(string_split(name, ' ')) AS INT), 'hypernym_only' FROM groups
      UNION ALL SELECT NULL, 1, 'everything', CAST(count(*) AS INT), 0, '', 1, 'hypernym_only' FROM groups""",
    "label_names": f"""WITH {POSTINGS}, best AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY prob DESC, label_id) AS i FROM postings)
      SELECT image_id, label_id, round(prob, 6) AS prob, p_name AS name FROM best LEFT JOIN part ON p_partkey = label_id WHERE i = 1""",
    "label_children": f"""WITH {GRAPH} SELECT CAST(1 AS BIGINT) AS synset_id, string_agg(name, ',' ORDER BY synset_id) AS children FROM groups""",
    "names_to_synsets": f"""WITH {GRAPH} SELECT name, CAST(count(DISTINCT synset_id) AS INT) AS n, min(synset_id) AS first FROM labels GROUP BY ALL""",
    "search_synsets": f"""WITH {GRAPH}, chosen AS (SELECT synset_id FROM leaf WHERE p_size < 10)
      SELECT text, synset_id, name AS names, synset_id IN (SELECT synset_id FROM chosen) AS selected FROM labels, (VALUES ('ring'), ('!red ring')) t(text)
      WHERE CASE WHEN text[1] = '!' THEN name = text[2:] ELSE contains(name, text) END""",
    "label_set": f"""WITH {GRAPH} SELECT synset_id FROM labels""",
    "remap_categories": """SELECT p_partkey AS file_id, 'n' || lpad(regexp_extract(p_brand, '(\\d+)', 1), 8, '0') || '.places2.' || p_brand AS folder FROM part""",
    "postings_file": f"""WITH {POSTINGS} SELECT label_id, image_id, round(prob, 6) AS prob FROM postings JOIN part ON p_partkey = label_id WHERE p_brand = 'Brand#7'""",
    "query_log": """SELECT l_orderkey AS target_id, CAST(count(*) AS INT) AS n_terms, CAST(sum(f) AS INT) AS n_children FROM (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber % 2 AS f FROM lineitem) GROUP BY ALL""",
    "detections_json": f"""WITH {BOXES} SELECT lpad(CAST(image_id AS VARCHAR), 7, '0') || '.jpg' AS file, count(*) AS boxes, round(sum(score), 6) AS prob, round(sum(x2), 6) AS w FROM box GROUP BY ALL""",
    "class_eligibility": """SELECT 'n' || lpad(CAST(l_partkey AS VARCHAR), 8, '0') AS synset, count(*) AS images FROM lineitem GROUP BY l_partkey HAVING count(*) BETWEEN 25 AND 35""",
    "sharded": """WITH r AS (SELECT p_brand, CAST(floor((row_number() OVER (ORDER BY p_brand, p_partkey) - 1) / ceil((SELECT count(*) FROM part) / 7)) AS BIGINT) AS shard FROM part),
      x AS (SELECT * FROM r UNION ALL SELECT p_brand, -1 FROM r WHERE shard = 3)
      SELECT shard, count(*) AS n, min(p_brand) AS first, max(p_brand) AS last FROM x GROUP BY ALL""",
    "saved_ranks": f"""WITH {EVALUATION} SELECT query_id, rank, config FROM ranks WHERE config IN ('plain t0.0 n1', 'plain t0.0 n2')""",
    "dense_ids": """SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) - 1 AS image_id FROM orders""",
    "threshold_scores": f"""WITH {VECTORS} SELECT image_id, label_id, round(prob, 6) AS prob FROM (SELECT image_id, unnest(range(len(f))) AS label_id, unnest(list_transform(f, lambda x: x * x)) AS prob FROM v) WHERE prob >= 0.01""",
    "threshold_report": f"""WITH {POSTINGS}, per AS (SELECT t AS threshold, image_id, count(*) AS n FROM postings, (VALUES (0.0::DOUBLE), (0.1), (0.25)) a(t) WHERE prob >= t GROUP BY ALL)
      SELECT threshold, CAST(sum(n) AS BIGINT) AS entries, count(*) AS images, round(avg(n), 6) AS mean_labels FROM per GROUP BY ALL""",
    "quantize": f"""WITH {POSTINGS} SELECT prob, count(*) AS n FROM (SELECT round_even(prob * 255, 0) AS prob FROM postings) WHERE prob > 0 AND prob >= 25.5 GROUP BY ALL""",
    "invert": f"""WITH {POSTINGS} SELECT label_id, count(*) AS n FROM postings GROUP BY ALL""",
    "label_sums": f"""WITH {POSTINGS} SELECT label_id, round(sum(prob), 6) AS sum_prob FROM postings GROUP BY ALL""",
    "text_idf": """WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS word FROM documents),
      c AS (SELECT doc_id, word, count(*) AS n FROM w WHERE word <> '' GROUP BY ALL),
      p AS (SELECT word, n / sum(n) OVER (PARTITION BY doc_id) AS prob FROM c),
      s AS (SELECT word, sum(prob) AS s FROM p GROUP BY ALL)
      SELECT word, round(ln(max(s) OVER () / (s + 1e-5) + 1), 6) AS idf FROM s""",
    "cooccurrence": f"""WITH {POSTINGS} SELECT a.label_id AS label_i, b.label_id AS label_j, round(sum(a.prob * b.prob), 9) AS sum_xy FROM postings a JOIN postings b ON a.image_id = b.image_id AND a.label_id <= b.label_id GROUP BY ALL""",
    "covariance": f"""WITH {POSTINGS}, n AS (SELECT count(DISTINCT image_id) AS n FROM postings), s AS (SELECT label_id, sum(prob) AS s FROM postings GROUP BY ALL),
      c AS (SELECT a.label_id AS label_i, b.label_id AS label_j, sum(a.prob * b.prob) AS xy FROM postings a JOIN postings b ON a.image_id = b.image_id AND a.label_id <= b.label_id GROUP BY ALL)
      SELECT label_i, label_j, round((xy / n - si.s / n * (sj.s / n)) * 1e6, 4) AS cov FROM c JOIN s si ON si.label_id = label_i JOIN s sj ON sj.label_id = label_j, n""",
    "idf": f"""WITH {POSTINGS}, s AS (SELECT label_id, sum(prob) AS c FROM postings GROUP BY ALL), m AS (SELECT max(c) AS m FROM s)
      SELECT label_id, round(ln(m / c) + 1, 6) AS idf, 'app' AS mode FROM s, m UNION ALL SELECT label_id, round(ln(m / (c + 1e-5) + 1), 6), 'smoothed' FROM s, m UNION ALL SELECT label_id, round(ln(m / c + 1), 6), 'paper' FROM s, m""",
    "image_distribution": f"""WITH {POSTINGS} SELECT label_id, image_id, round(prob / sum(prob) OVER (PARTITION BY image_id), 9) AS prob FROM postings""",
    "label_positions": f"""WITH {POSTINGS} SELECT image_id, label_id, CAST(position AS INT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY prob DESC, label_id) AS position FROM postings) WHERE position <= 5""",
    "target_ranks": f"""WITH {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, image_id) AS rank FROM scores)
      SELECT q.query_id, q.query_id AS target_id, rank FROM (SELECT DISTINCT query_id FROM query) q LEFT JOIN r ON r.query_id = q.query_id AND r.image_id = q.query_id""",
    "result_status": f"""WITH {SCORES} SELECT q.query_id, count(image_id) AS results, CASE WHEN count(image_id) = 0 THEN 'empty' ELSE 'found' END AS status FROM (SELECT DISTINCT query_id FROM query) q LEFT JOIN scores USING (query_id) GROUP BY ALL""",
    "query_lengths": """SELECT count(*) AS queries, round(avg(n), 6) AS mean_labels, max(n) AS longest FROM (
      SELECT query_id, count(*) AS n FROM (SELECT DISTINCT l_orderkey AS query_id, l_linenumber % 2, l_partkey FROM lineitem) GROUP BY ALL)""",
    "two_images": f"""WITH {PAIR} SELECT query_id, image_id, score FROM pair""",
    "rank_two_images": f"""WITH {PAIR}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, image_id) AS rank FROM pair)
      SELECT q.query_id, q.query_id AS target_id, rank FROM (SELECT DISTINCT query_id FROM query) q LEFT JOIN r ON r.query_id = q.query_id AND r.image_id = q.query_id""",
    "sliding_max": """SELECT o_custkey, o_orderkey, o_totalprice, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS forward_max FROM orders""",
    "fused": f"""WITH {TWO}, m AS (SELECT 1 AS modality, * FROM one UNION ALL SELECT 2, * FROM two),
      e AS (SELECT query_id, modality, min(score) AS lo, max(score) AS hi FROM m GROUP BY ALL)
      SELECT query_id, image_id, round(sum(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END), 9) AS score FROM m JOIN e USING (query_id, modality) GROUP BY ALL""",
    "filtered_by_model": f"""WITH {TWO} SELECT query_id, image_id, round(score, 6) AS score FROM one SEMI JOIN (SELECT * FROM two WHERE score >= 0.25) t USING (query_id, image_id)""",
    "routed": """WITH p AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'returned' ELSE 'kept' END AS source_name, l_partkey AS label_id, l_orderkey AS image_id, sum(l_quantity) / 50 AS prob FROM lineitem GROUP BY ALL),
      q AS (SELECT DISTINCT l_orderkey AS query_id, l_partkey AS label_id, CASE WHEN l_orderkey % 200 = 0 THEN 'returned' ELSE 'kept' END AS source_name FROM lineitem WHERE l_orderkey % 100 = 0),
      s AS (SELECT source_name, query_id, image_id, sum(prob) AS score FROM q JOIN p USING (source_name, label_id) GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY source_name, query_id ORDER BY score DESC, image_id) AS rank FROM s)
      SELECT source_name, query_id, image_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10""",
    "rank_targets": f"""WITH {EVALUATION} SELECT config, query_id, target_id, rank FROM ranks""",
    "rank_curve": f"""WITH {EVALUATION}, per AS (SELECT config, rank, count(*) AS n FROM ranks GROUP BY ALL),
      c AS (SELECT config, rank, sum(n) OVER (PARTITION BY config ORDER BY rank NULLS LAST ROWS UNBOUNDED PRECEDING) AS sofar, sum(n) OVER (PARTITION BY config) AS total FROM per)
      SELECT config, rank, round(sofar / total * 100, 6) AS percent FROM c WHERE rank IS NOT NULL""",
    "exponential_fit": f"""WITH {EVALUATION} SELECT config, round(count(*) / sum(rank), 6) AS rate FROM ranks WHERE rank IS NOT NULL GROUP BY ALL""",
    "position_distribution": f"""WITH {POSITIONS} SELECT CAST(position AS INT) AS position, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM positions GROUP BY ALL""",
    "hit_histograms": f"""WITH {POSITIONS}, rounded AS (SELECT label_id, image_id, round(prob, 6) AS prob FROM postings),
      {drawn("d", "rounded", "prob", "image_id || ':' || label_id", "7").replace("draw <= 3", "draw <= 5")},
      rplaced AS (SELECT image_id, label_id, row_number() OVER (PARTITION BY image_id ORDER BY prob DESC, label_id) AS position FROM rounded),
      rand AS (SELECT * FROM rplaced SEMI JOIN d USING (image_id, label_id)),
      h AS (SELECT position, count(*) AS n FROM positions GROUP BY ALL), hr AS (SELECT position, count(*) AS n FROM rand GROUP BY ALL),
      t AS (SELECT position, count(*) AS n FROM (SELECT image_id, min(position) AS position FROM positions GROUP BY ALL) GROUP BY ALL),
      tr AS (SELECT position, count(*) AS n FROM (SELECT image_id, min(position) AS position FROM rand GROUP BY ALL) GROUP BY ALL),
      p AS (SELECT position FROM h UNION SELECT position FROM hr)
      SELECT CAST(p.position AS INT) AS position, coalesce(h.n, 0) AS hits, coalesce(t.n, 0) AS top_hits, coalesce(hr.n, 0) AS hits_rand, coalesce(tr.n, 0) AS top_hits_rand
      FROM p LEFT JOIN h USING (position) LEFT JOIN t USING (position) LEFT JOIN hr USING (position) LEFT JOIN tr USING (position)""",
    "accuracy": f"""WITH {POSTINGS}, p AS (SELECT image_id, label_id, row_number() OVER (PARTITION BY image_id ORDER BY prob DESC, label_id) AS position, min(label_id) OVER (PARTITION BY image_id) AS truth FROM postings)
      SELECT k, round(avg(CASE WHEN position <= k THEN 100.0 ELSE 0 END), 6) AS percent FROM p, (VALUES (1), (2), (5)) a(k) WHERE label_id = truth GROUP BY ALL""",
    "patch_accuracy": """WITH n AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY ALL),
      m AS (SELECT l_orderkey AS image_id, l_partkey AS label_id, sum(l_quantity) / n AS prob FROM lineitem JOIN n USING (l_orderkey) GROUP BY l_orderkey, l_partkey, n),
      p AS (SELECT image_id, label_id, row_number() OVER (PARTITION BY image_id ORDER BY prob DESC, label_id) AS position, min(label_id) OVER (PARTITION BY image_id) AS truth FROM m)
      SELECT k, round(avg(CASE WHEN position <= k THEN 100.0 ELSE 0 END), 6) AS percent FROM p, (VALUES (1), (2), (5)) a(k) WHERE label_id = truth GROUP BY ALL""",
    "group_counts": """SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL""",
    "exponential_average": f"""WITH RECURSIVE {DAILY},
      e(event_type, i, day, smooth) AS (SELECT event_type, i, day, n FROM s WHERE i = 1 UNION ALL SELECT s.event_type, s.i, s.day, e.smooth * 0.9 + s.n * (1 - 0.9) FROM e JOIN s ON s.event_type = e.event_type AND s.i = e.i + 1)
      SELECT event_type, CAST(day AS INT) AS day, round(smooth, 6) AS smooth FROM e""",
    "box_average": f"""WITH {DAILY} SELECT event_type, CAST(day AS INT) AS day, round(avg(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING), 6) AS smooth FROM s""",
    "monotone_average": f"""WITH RECURSIVE {DAILY},
      e(event_type, i, day, y, rest) AS (SELECT event_type, i, day, n, 0.0::DOUBLE FROM s WHERE i = 1
        UNION ALL SELECT s.event_type, s.i, s.day, least(s.n + e.rest, e.y), s.n + e.rest - least(s.n + e.rest, e.y) FROM e JOIN s ON s.event_type = e.event_type AND s.i = e.i + 1)
      SELECT event_type, CAST(day AS INT) AS day, round(y / sum(y) OVER (PARTITION BY event_type), 6) AS smooth FROM e""",
    "suggest": f"""WITH {GRAPH},
      t AS (SELECT text, trim(regexp_extract(text, '([^+*]*)$', 1)) AS term FROM (VALUES ('red'), ('widget'), ('econ'), ('small bo'), ('zzz'), ('gear+bolt'), ('ring*'), ('re')) a(text)),
      m AS (SELECT text, term, synset_id, name, description, lower(name) AS low, CAST((length(name) - length(replace(lower(name), term, ''))) / length(term) AS INT) AS name_hits,
        CAST((length(description) - length(replace(lower(description), term, ''))) / length(term) AS INT) AS description_hits FROM labels, t WHERE term <> '' AND (contains(lower(name), term) OR contains(lower(description), term))),
      b AS (SELECT *, CASE WHEN NOT contains(low, term) THEN 0 WHEN low = term THEN 10 WHEN starts_with(low, term || ',') THEN 5 WHEN starts_with(low, term) AND NOT contains(low, ',') THEN 4 WHEN starts_with(low, term) THEN 2 WHEN contains(low, ' ' || term) THEN 1 ELSE 0 END AS bonus FROM m),
      r AS (SELECT *, (bonus + name_hits) * 2.0 / len(string_split(name, ' ')) + description_hits AS relevance FROM b)
      SELECT text, synset_id, name, round(CAST(relevance AS DOUBLE), 6) AS relevance, name_hits, description_hits, bonus, regexp_replace(name, '(' || term || ')', '$~START~$\\1$~END~$', 'gi') AS marked, CAST(rank AS INT) AS rank
      FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY relevance DESC, synset_id) AS rank FROM r) WHERE rank <= 50""",
    "suggest_children": f"""WITH {GRAPH},
      m AS (SELECT synset_id, p_name AS name, p_type AS description, CAST((length(p_name) - length(replace(lower(p_name), 're', ''))) / 2 AS INT) AS name_hits, CAST((length(p_type) - length(replace(lower(p_type), 're', ''))) / 2 AS INT) AS description_hits FROM leaf WHERE brand_id = 2003),
      b AS (SELECT *, CASE WHEN starts_with(name, 're') THEN 4 WHEN contains(name, ' re') THEN 1 ELSE 0 END AS bonus FROM m)
      SELECT synset_id, name, round(CAST((bonus + name_hits) * 2.0 / len(string_split(name, ' ')) + description_hits AS DOUBLE), 6) AS relevance, name_hits, description_hits, bonus, regexp_replace(name, '(re)', '$~START~$\\1$~END~$', 'gi') AS marked FROM b""",
    "class_means": f"""WITH {MEANS} SELECT CAST(class_id AS BIGINT) AS class_id, CAST(pos AS INT) AS pos, round(x, 6) AS x FROM mean""",
    "nearest": f"""WITH {VECTORS}, d AS (SELECT q.image_id AS query_id, u.image_id, round(1 - list_inner_product(q.f, u.f), 9) AS distance FROM u q, u WHERE q.image_id % 100 = 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, image_id) AS rank FROM d)
      SELECT query_id, image_id, round(distance, 6) + 0.0 AS distance, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10""",
    "knn_rank": f"""WITH {VECTORS}, d AS (SELECT q.image_id // 100 * 100 AS query_id, u.image_id, round(sum(1 - list_inner_product(q.f, u.f)), 9) AS distance FROM u q, u WHERE q.image_id % 100 IN (0, 1) GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, image_id) AS rank, min(distance) OVER (PARTITION BY query_id) AS least FROM d)
      SELECT query_id, image_id AS target_id, rank, round(distance - least, 6) AS gap FROM r WHERE image_id = query_id + 2""",
    "pairwise": f"""WITH {VECTORS} SELECT a.image_id AS a, b.image_id AS b, round(list_distance(a.f, b.f), 6) AS distance FROM v a JOIN v b ON a.image_id <> b.image_id WHERE a.image_id % 100 = 0""",
    "distance_summary": f"""WITH {VECTORS}, d AS (SELECT 1 - list_cosine_similarity(a.f, b.f) AS d FROM v a JOIN v b ON a.image_id <> b.image_id WHERE a.image_id % 100 = 0) SELECT round(min(d), 6) AS least, round(max(d), 6) AS most, count(*) AS pairs FROM d""",
    "distance_quantiles": f"""WITH {VECTORS}, d AS (SELECT 1 - list_cosine_similarity(a.f, b.f) AS d FROM v a JOIN v b ON a.image_id <> b.image_id WHERE a.image_id % 100 = 0),
      q AS (SELECT quantile_cont(d, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q FROM d)
      SELECT i / 10 AS share, round(distance, 6) AS distance FROM (SELECT unnest(range(11)) AS i, unnest(q) AS distance FROM q)""",
    "histogram": """WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS n FROM orders), w AS (SELECT *, (hi - lo) / 200 AS w FROM e)
      SELECT CAST(least(199, floor((o_totalprice - lo) / w)) AS INT) AS bin, round(lo + least(199, floor((o_totalprice - lo) / w)) * w, 4) AS low, count(*) AS n, round(count(*) / (w.n * w) * 1e6, 6) AS density FROM orders, w GROUP BY 1, 2, w.n, w""",
    "sample_ids": f"""WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders), c AS (SELECT count(*) AS n FROM orders),
      q AS (SELECT query_id, CAST(floor({uniform("query_id", "7a")} * n) AS BIGINT) AS place, n, CAST(floor({uniform("query_id", "7b")} * 5) AS BIGINT) AS more FROM range(1000) r(query_id), c)
      SELECT query_id, a.o_orderkey AS image_id, b.o_orderkey AS second_id FROM q JOIN o a ON a.place = q.place JOIN o b ON b.place = least(q.place + more, n - 1)""",
    "draw_labels": f"""WITH {ROUNDED}, {drawn("d", "rounded", "prob", "image_id || ':' || label_id", "7")} SELECT image_id, CAST(draw AS INT) AS draw, label_id FROM d""",
    "draw_positions": f"""WITH {POSITIONS}, {SHARES}, w AS (SELECT image_id, label_id, position, share FROM placed JOIN shares USING (position)), {drawn("d", "w", "share", "image_id || ':' || position", "7")}
      SELECT image_id, CAST(draw AS INT) AS draw, label_id FROM d""",
    "draw_mixed": f"""WITH {POSITIONS}, {SHARES}, rounded AS (SELECT label_id, image_id, round(prob, 6) AS prob FROM postings), heads AS (SELECT DISTINCT image_id FROM postings WHERE {uniform("image_id", "7m")} < 0.5),
      a AS (SELECT * FROM rounded SEMI JOIN heads USING (image_id)), rp AS (SELECT image_id, label_id, row_number() OVER (PARTITION BY image_id ORDER BY prob DESC, label_id) AS position FROM rounded ANTI JOIN heads USING (image_id)),
      w AS (SELECT image_id, label_id, position, share FROM rp JOIN shares USING (position)),
      {drawn("da", "a", "prob", "image_id || ':' || label_id", "7")}, {drawn("db", "w", "share", "image_id || ':' || position", "7")}
      SELECT image_id, CAST(draw AS INT) AS draw, label_id FROM da UNION ALL SELECT image_id, CAST(draw AS INT), label_id FROM db""",
    "query_prefixes": f"""WITH {ROUNDED}, {drawn("d", "rounded", "prob", "image_id || ':' || label_id", "7")} SELECT length, CAST(draw AS INT) AS draw, count(*) AS n FROM d, (VALUES (1), (2), (3)) l(length) WHERE draw <= length GROUP BY ALL""",
    "split_classes": """WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
      SELECT p_brand, p_partkey FROM r WHERE rn > round(n * 0.2::DOUBLE) AND rn <= round(n * 0.2::DOUBLE) + round(n * 0.5::DOUBLE)""",
    "first_per_class": """SELECT CAST(label AS BIGINT) AS class_id, vec_id AS image_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings) WHERE i <= 10""",
    "filter_boxes": """SELECT CAST(floor(l_quantity / 25) AS INT) AS scale, l_linenumber AS template, count(*) AS n FROM lineitem
      WHERE 1 / (1 + exp(-(l_extendedprice / 20000 - 2))) > 0.5 AND (floor(l_quantity / 25) > 0 OR l_linenumber < 6) GROUP BY ALL""",
    "decode_boxes": """WITH r AS (SELECT l_orderkey AS image_id, (l_partkey % 160) * 8 - 1 + 24 * l_discount AS cx, (l_suppkey % 90) * 8 - 1 + 32 * l_tax AS cy, 24 * exp(l_discount) AS w, 32 * exp(l_tax) AS h, CAST(1 + l_linenumber % 3 AS DOUBLE) AS s, l_quantity AS score FROM lineitem)
      SELECT image_id, round((cx - w / 2) / s, 6) AS x1, round((cy - h / 2) / s, 6) AS y1, round((cx + w / 2) / s, 6) AS x2, round((cy + h / 2) / s, 6) AS y2, score FROM r""",
    "occupancy": f"""WITH {BOXES},
      c AS (SELECT image_id, CAST(least(31, floor(x1 / 1280 * 32)) AS INT) AS a, CAST(least(31, floor(x2 / 1280 * 32)) AS INT) AS b, CAST(least(17, floor(y1 / 720 * 18)) AS INT) AS p, CAST(least(17, floor(y2 / 720 * 18)) AS INT) AS q FROM box),
      r AS (SELECT image_id, a, b, unnest(range(p, q + 1)) AS y FROM c), cells AS (SELECT DISTINCT image_id, y, x FROM (SELECT image_id, y, unnest(range(a, b + 1)) AS x FROM r))
      SELECT image_id, CAST(y AS INT) AS word_no, CAST(sum(CAST(1 AS BIGINT) << (31 - x)) AS BIGINT) AS bits FROM cells GROUP BY ALL""",
    "known_item_scores": f"""WITH {SUBMISSIONS}, f AS (SELECT team, task, min(t) AS found FROM sub WHERE correct GROUP BY ALL)
      SELECT team, CAST(sub.task AS INT) AS task, round(coalesce(greatest(0.0, 50 + 50 * (86400 - any_value(found)) / 86400 - 10 * count_if(NOT correct AND t < found)), 0.0), 6) AS score FROM sub LEFT JOIN f USING (team, task) GROUP BY team, sub.task""",
    "ad_hoc_scores": f"""WITH {AD_HOC} SELECT team, CAST(task AS INT) AS task, round(score, 6) AS score FROM adhoc""",
    "overall_scores": f"""WITH {AD_HOC}, s AS (SELECT team, CASE WHEN max(score) OVER (PARTITION BY task) > 0 THEN score / max(score) OVER (PARTITION BY task) * 100 ELSE 0.0 END AS s FROM adhoc) SELECT team, round(avg(s), 6) AS score FROM s GROUP BY ALL""",
    "sketch_scores": """WITH p AS (SELECT l_orderkey AS image_id, CAST(l_partkey % 20 AS DOUBLE) AS px, CAST(l_suppkey % 15 AS DOUBLE) AS py, l_quantity * 2 AS l, l_discount * 1000 AS a, l_tax * 1000 AS b FROM lineitem),
      r AS (SELECT * FROM (VALUES (1, 1, 5.0, 5.0, 4.0, 3.0, 50.0, 40.0, 40.0, 'any'), (1, 2, 12.0, 8.0, 6.0, 4.0, 80.0, 10.0, 20.0, 'all'), (2, 1, 10.0, 7.0, 9.0, 6.0, 20.0, 60.0, 60.0, 'all')) v(query_id, region_no, cx, cy, rx, ry, l, a, b, mode)),
      m AS (SELECT query_id, region_no, mode, image_id, sqrt((p.l - r.l)**2 + (p.a - r.a)**2 + (p.b - r.b)**2) AS away FROM p, r WHERE ((px - cx) / rx)**2 + ((py - cy) / ry)**2 <= 1),
      e AS (SELECT query_id, image_id, CASE WHEN mode = 'any' THEN min(away) ELSE avg(away) END AS d FROM m GROUP BY query_id, region_no, mode, image_id)
      SELECT CAST(query_id AS BIGINT) AS query_id, image_id, round(CAST(-sum(d) AS DOUBLE), 6) AS score FROM e GROUP BY ALL""",
    "score_images": f"""WITH {VECTORS} SELECT image_id, round(list_sum(f), 6) AS total, CAST(list_position(f, list_max(f)) - 1 AS BIGINT) AS best FROM v""",
    "percentile_clip": """SELECT o_orderkey, round(greatest(0.0, least(1.0, o_totalprice / (SELECT quantile_cont(o_totalprice, 0.99) FROM orders))), 6) AS o_totalprice FROM orders""",
    "closest_shown": f"""WITH {START}, {feedback(1, 50, 3, "a")} SELECT query_id, image_id FROM apick1""",
    "relevance_feedback": f"""WITH {START}, {feedback(3, 50, 3, "a")} SELECT query_id, query_id AS target_id, CAST(round AS INT) AS round, rank, round(gap, 6) AS gap FROM afull""",
    "feedback_grid": f"""WITH {START}, {feedback(2, 20, 1, "a")}, {feedback(2, 50, 3, "b")}
      SELECT '20:1 ' || round || 'x' AS config, query_id, CAST(round AS INT) AS round, rank FROM afull UNION ALL SELECT '50:3 ' || round || 'x', query_id, round, rank FROM bfull""",
    "non_maximum_suppression": f"""WITH RECURSIVE {BOXES},
      r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, x1, y1, x2, y2) AS i, count(*) OVER (PARTITION BY image_id) AS n FROM box),
      fold AS (SELECT image_id, i, n, [{{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'score': score}}] AS kept FROM r WHERE i = 1
        UNION ALL SELECT r.image_id, r.i, r.n, CASE WHEN len(list_filter(kept, lambda a: greatest(0, least(a.x2, r.x2) - greatest(a.x1, r.x1)) * greatest(0, least(a.y2, r.y2) - greatest(a.y1, r.y1))
          > 0.1 * ((a.x2 - a.x1) * (a.y2 - a.y1) + (r.x2 - r.x1) * (r.y2 - r.y1) - greatest(0, least(a.x2, r.x2) - greatest(a.x1, r.x1)) * greatest(0, least(a.y2, r.y2) - greatest(a.y1, r.y1))))) = 0
          THEN list_append(kept, {{'x1': r.x1, 'y1': r.y1, 'x2': r.x2, 'y2': r.y2, 'score': r.score}}) ELSE kept END FROM fold JOIN r ON r.image_id = fold.image_id AND r.i = fold.i + 1)
      SELECT image_id, b.x1 AS x1, b.y1 AS y1, b.x2 AS x2, b.y2 AS y2, b.score AS score FROM (SELECT image_id, unnest(kept) AS b FROM fold WHERE i = n)""",
    "find_patterns": """WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS c, unnest(range(length(text))) AS i FROM documents),
      g AS (SELECT doc_id, i, c || lead(c, 1, '') OVER w || lead(c, 2, '') OVER w || lead(c, 3, '') OVER w AS g FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
      p AS (SELECT unnest(['the', 'th', 'tion', 'anan', 'é']) AS pattern)
      SELECT doc_id AS text_id, pattern, count(*) AS hits, CAST(min(i) AS INT) AS first, CAST(sum(i) AS BIGINT) AS total FROM g JOIN p ON starts_with(g, pattern) GROUP BY ALL""",
    "annotations_table": f"""WITH {POSTINGS} SELECT image_id, CAST(count(*) AS INT) AS n_labels, round(CAST(CAST(max(prob) AS FLOAT) AS DOUBLE), 5) AS best FROM postings GROUP BY ALL""",
    "scores_table": """SELECT vec_id AS image_id, round(list_sum(list_transform(embedding, lambda x: CAST(CAST(x AS FLOAT) * CAST(x AS FLOAT) AS DOUBLE))), 4) AS sum_scores,
      round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS sum_features FROM embeddings""",
    "label_sums_table": f"""WITH {POSTINGS} SELECT label_id, round(sum(prob), 6) AS sum_prob FROM postings GROUP BY ALL""",
    "synset_ids_file": """SELECT p_partkey AS synset_id FROM part WHERE p_partkey % 7 <> 0""",
    "category_mapping_file": """SELECT '/p/part_' || p_partkey AS category, printf('n%08d', p_size) AS synset FROM part""",
    "listed_files": """SELECT * FROM (SELECT CAST(p_size AS BIGINT) AS p_size, CAST(sum(length(CAST(p_partkey AS VARCHAR)) + 1) AS BIGINT) AS bytes, row_number() OVER (ORDER BY CAST(p_size AS VARCHAR) || '/') - 1 AS image_id FROM part WHERE p_size NOT IN (3, 4) GROUP BY p_size)""",
    "rank_curves_file": """SELECT round(c_custkey * 1 / 1000, 3) AS Rank1, round(c_custkey * 2 / 1000, 3) AS Rank2, round(c_custkey * 3 / 1000, 3) AS Rank3, round(c_custkey * 4 / 1000, 3) AS Rank4, round(c_acctbal / 10000, 4) AS Percentage FROM customer""",
    "model_labels": """SELECT p_partkey AS label_id, p_partkey + 1000000 AS synset_id, p_name AS names FROM part""",
    "ordered_labels": """SELECT l_orderkey AS query_id, 2 - l_linenumber % 2 AS clause_no, l_partkey AS label_id, min(l_linenumber) AS first_position FROM lineitem GROUP BY ALL""",
    "postings_by_label": f"""WITH {POSTINGS} SELECT label_id, image_id, round(prob, 6) AS prob FROM postings WHERE label_id IN (7, 50, 101)""",
    "shuffled": f"""SELECT o_orderkey, row_number() OVER (ORDER BY {uniform("o_orderkey", "7")}, o_orderkey) - 1 AS place FROM orders""",
    "top_page": f"""WITH {SUPPLIERS}, {IDF},
      s AS (SELECT query_id, image_id, sum(prob * idf) AS score FROM query JOIN postings USING (label_id) JOIN idf USING (label_id) GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, image_id) AS rank FROM s)
      SELECT query_id, image_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 70""",
    "lists_sought": f"""WITH {POSTINGS} SELECT label_id, image_id, round(prob, 6) AS prob FROM postings JOIN part ON p_partkey = label_id WHERE p_brand = 'Brand#7'""",
    "nearest_by_cells": f"""WITH {VECTORS}, d AS (SELECT q.image_id AS query_id, u.image_id, round(1 - list_inner_product(q.f, u.f), 9) AS distance FROM u q, u WHERE q.image_id % 100 = 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, image_id) AS rank FROM d)
      SELECT query_id, image_id, round(distance, 6) + 0.0 AS distance, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10""",
    "find_words": """WITH w AS (SELECT DISTINCT lower(w) AS pattern FROM (SELECT unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS w FROM benchmark) WHERE length(w) BETWEEN 5 AND 6),
      p AS (SELECT doc_id, lower(text) AS t, unnest(range(length(text))) AS i FROM documents),
      g AS (SELECT doc_id, i, substr(t, i + 1, 5) AS g FROM p UNION ALL SELECT doc_id, i, substr(t, i + 1, 6) FROM p)
      SELECT pattern, count(*) AS hits, count(DISTINCT doc_id) AS texts, CAST(sum(i) AS BIGINT) AS total FROM g JOIN w ON g = pattern AND length(g) = length(pattern) GROUP BY ALL""",
    "two_images_wide": f"""WITH {TWO} SELECT a.query_id, a.image_id, round(a.score * max(b.score), 6) AS score FROM one a JOIN two b ON a.query_id = b.query_id AND b.image_id BETWEEN a.image_id AND a.image_id + 499 GROUP BY a.query_id, a.image_id, a.score""",
    "box_corners": """SELECT l_orderkey, l_linenumber, round(l_partkey % 1280 - l_quantity / 2, 6) AS x1, round(l_suppkey % 720 - l_tax * 100 / 2, 6) AS y1, round(l_partkey % 1280 + l_quantity / 2, 6) AS x2, round(l_suppkey % 720 + l_tax * 100 / 2, 6) AS y2 FROM lineitem""",
    "sketched_quantiles": """SELECT i / 10 AS share, true AS within FROM range(11) r(i)""",
    "dense_cooccurrence": f"""WITH {VECTORS}, e AS (SELECT image_id, unnest(range(len(f))) AS l, unnest(list_transform(f, lambda x: x * x)) AS s FROM v)
      SELECT a.l AS label_i, b.l AS label_j, round(sum(a.s * b.s), 9) AS sum_xy FROM e a JOIN e b ON a.image_id = b.image_id AND a.l <= b.l GROUP BY ALL""",
    "lloyd_clusters": f"""WITH {VECTORS}, {lloyd(3)} SELECT image_id, cluster FROM a""",
    "cluster_members": f"""WITH {VECTORS}, {lloyd(3)} SELECT cluster, string_agg(CAST(image_id AS VARCHAR), ',' ORDER BY image_id) AS members FROM a GROUP BY ALL""",
    "axes_places": f"""WITH {VECTORS}, {lloyd(3)}, {axes(5)},
      r AS (SELECT 'vector' AS kind, image_id AS id, f FROM v UNION ALL SELECT 'centre', cluster, centre FROM c3),
      p AS (SELECT kind, id, unnest(f) AS x, unnest(range(len(f))) AS pos FROM r)
      SELECT kind, id, round(sum((p.x - m) * one.x), 6) AS x, round(sum((p.x - m) * two.x), 6) AS y FROM p JOIN mu USING (pos) JOIN one USING (pos) JOIN two USING (pos) GROUP BY kind, id""",
}
ORACLES["samples_once"] = ORACLES["sample_ids"]
