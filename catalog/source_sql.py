"""The SQL the source queries are checked against."""

from __future__ import annotations

from catalog.graph_sql import GRAPH, tokens
from catalog.source_texts import counts_sql, edges_sql, symbols_sql

KEY = "CAST(o_orderkey AS VARCHAR)"

ROUTES = f"""
WITH routes AS (
  SELECT 'root/o' || {KEY} || '/urls.py' AS path, 'a' || {KEY} || '/' AS url,
         'django: a' || {KEY} || '/ → a' || {KEY} || '/' AS signature, 'python' AS language
  FROM orders WHERE o_orderkey % 4 = 0
  UNION ALL
  SELECT 'root/o' || {KEY} || '/urls.py', 'b' || {KEY} || '/', 'django: b' || {KEY} || '/ → unknown', 'python'
  FROM orders WHERE o_orderkey % 4 = 0
  UNION ALL
  SELECT 'root/o' || {KEY} || '/app.py', '/f' || {KEY}, 'flask: /f' || {KEY}, 'python'
  FROM orders WHERE o_orderkey % 4 = 1
  UNION ALL
  SELECT 'root/o' || {KEY} || '/app.py', '/g' || {KEY}, 'fastapi: /g' || {KEY}, 'python'
  FROM orders WHERE o_orderkey % 4 = 1
  UNION ALL
  SELECT 'root/o' || {KEY} || '/web.js', '/x' || {KEY}, 'express: /x' || {KEY} || ' → show', 'typescript'
  FROM orders WHERE o_orderkey % 4 = 2
  UNION ALL
  SELECT 'root/o' || {KEY} || '/web.js', '/y' || {KEY}, 'express: /y' || {KEY} || ' → handler', 'typescript'
  FROM orders WHERE o_orderkey % 4 = 2
)
SELECT path || ':route:' || url AS id, path AS file_path, url AS name, 'route' AS kind, signature,
       CAST(0 AS INTEGER) AS line_start, CAST(0 AS INTEGER) AS line_end,
       CAST(NULL AS VARCHAR) AS parent_id, language, '{{}}' AS metadata FROM routes"""

FILE = f"'/repo/src/o' || {KEY} || '.ts'"
INDEXED = f"""
WITH defs AS (
  SELECT {FILE} AS file_path, 'Order' || {KEY} AS name, 'class' AS kind, o_orderkey AS k, 1 AS nth,
         'own' || {KEY} AS symbol FROM orders
  UNION ALL
  SELECT {FILE}, 'Order' || {KEY} || '.total', 'method', o_orderkey, 2, 'total' || {KEY} FROM orders
  UNION ALL
  SELECT {FILE}, 'buyer' || o_custkey, 'function', o_orderkey, 3, 'buyer' || o_custkey FROM orders
  UNION ALL
  SELECT {FILE}, 'flag' || o_orderstatus, 'symbol', o_orderkey, 4, 'flag' || o_orderstatus FROM orders
  UNION ALL
  SELECT {FILE}, 'Extra' || {KEY}, 'class', o_orderkey, 5, 'extra' || {KEY} FROM orders
),
targets AS (
  SELECT symbol, arg_max(file_path || ':' || name, k * 10 + nth) AS target_id,
         arg_max(kind, k * 10 + nth) AS kind
  FROM defs GROUP BY symbol
),
refs AS (
  SELECT {FILE} AS file_path, 'buyer' || o_custkey AS symbol, 1 AS times FROM orders
  UNION ALL SELECT {FILE}, 'flag' || o_orderstatus, 1 FROM orders
  UNION ALL SELECT {FILE}, 'own' || {KEY}, 2 FROM orders
),
links AS (
  SELECT r.file_path, t.target_id, r.times,
         CASE WHEN t.target_id = '/repo/src/o0.ts:Order0' OR t.kind IN ('function', 'method') THEN 'calls'
              WHEN t.kind = 'symbol' THEN 'imports' ELSE 'references' END AS kind
  FROM refs r JOIN targets t ON r.symbol = t.symbol
)"""

SYMBOL = """CASE p_partkey % 10
  WHEN 0 THEN 's a/`f.py`/Part' || p_partkey || '#'
  WHEN 1 THEN 's a/`f.py`/Part' || p_partkey || '#size().'
  WHEN 2 THEN 's a/Part' || p_partkey || '#size().(unit)'
  WHEN 3 THEN 'local ' || p_partkey
  WHEN 4 THEN 's a/`make' || p_partkey || '`().'
  WHEN 5 THEN 's a/make' || p_partkey || '().inner'
  WHEN 6 THEN 's a/make' || p_partkey || '(+1).'
  WHEN 7 THEN 's a/value' || p_partkey || '`'
  WHEN 8 THEN 's a/dir' || p_partkey || '/'
  ELSE 's a/Part' || p_partkey || '#deep#name.' END"""

CACHE_KEY = "substr(sha256(c_mktsegment || '/' || c_name || ':main'), 1, 16)"

RUNS = """
logs AS (
  SELECT user_id AS run, event_id AS seq,
         CASE event_type WHEN 'purchase' THEN 'step_finish' WHEN 'click' THEN 'tool_use' ELSE 'text' END AS type,
         CASE WHEN event_type <> 'signup' THEN CAST(floor(epoch(ts)) AS DOUBLE) END AS stamp,
         CAST(floor(value) AS DOUBLE) AS cost, CAST(json_extract(props, '$.k') AS BIGINT) AS k
  FROM events
),
runs AS (
  SELECT run,
         coalesce(sum(CASE WHEN type = 'step_finish' THEN cost END), 0) AS cost,
         CAST(coalesce(sum(CASE WHEN type = 'step_finish' THEN k * 100 END), 0) AS BIGINT) AS tokens,
         count(*) FILTER (type = 'tool_use') AS tool_calls,
         coalesce(arg_max(stamp, seq) FILTER (stamp IS NOT NULL)
                  - arg_min(stamp, seq) FILTER (stamp IS NOT NULL), 0) AS time_seconds,
         CAST(coalesce(sum(CASE WHEN type = 'step_finish' THEN k END), 0) AS BIGINT) AS cache_reads
  FROM logs GROUP BY run
)"""

MEDIANS = f"""
WITH {RUNS},
long AS (
  SELECT CASE WHEN run % 3 = 0 THEN 'with' ELSE 'without' END AS arm, metric, value FROM (
    SELECT run, 'cost' AS metric, CAST(cost AS DOUBLE) AS value FROM runs
    UNION ALL SELECT run, 'tokens', CAST(tokens AS DOUBLE) FROM runs
    UNION ALL SELECT run, 'tool_calls', CAST(tool_calls AS DOUBLE) FROM runs
    UNION ALL SELECT run, 'time_seconds', CAST(time_seconds AS DOUBLE) FROM runs
    UNION ALL SELECT run, 'cache_reads', CAST(cache_reads AS DOUBLE) FROM runs)
),
medians AS (
  SELECT arm, metric, CASE WHEN count(*) % 2 = 1 THEN median(value)
         ELSE floor(median(value) * 100) / 100 END AS median
  FROM long GROUP BY arm, metric
)"""


def shown(v: str) -> str:
    whole = f"CAST(round_even({v}, 0) AS BIGINT)"
    return f"""CASE metric
  WHEN 'cost' THEN printf('$%.2f', {v})
  WHEN 'time_seconds' THEN printf('%dm %02ds', {whole} // 60, {whole} % 60)
  WHEN 'tool_calls' THEN CAST({whole} AS VARCHAR)
  ELSE CASE WHEN {whole} >= 1000000 THEN printf('%.1fM', floor({whole} / 1000000 * 10) / 10)
            WHEN {whole} >= 1000 THEN printf('%.1fk', floor({whole} / 1000 * 10) / 10)
            ELSE CAST({whole} AS VARCHAR) END END"""


COSINE = (
    "round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / "
    "(sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * "
    "sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])){extra})), {digits})"
)


def cosine(digits: int, extra: str = "") -> str:
    text = COSINE.replace("{digits}", str(digits))
    if not extra:
        return text.replace("{extra}", "")
    return text.replace(
        "sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])){extra})",
        f"sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) + {extra})",
    )


ORACLES = {
    "parse_symbols": symbols_sql(),
    "parse_edges": edges_sql(),
    "index_counts": counts_sql(),
    "page_script_calls": r"""
WITH calls AS (
  SELECT page_id, unnest(regexp_extract_all(
    regexp_replace(regexp_extract(html, '(?s)<script>(.*?)</script>', 1), '"[^"]*"', '', 'g'),
    '([A-Za-z_]\w*)\(', 1)) AS target_id
  FROM pages
)
SELECT target_id, count(*) AS times, count(DISTINCT page_id) AS pages FROM calls GROUP BY target_id""",
    "tree_filter": """
WITH files AS (
  SELECT ['src', 'lib/node_modules', 'app/.git/hooks', 'dist', 'web/src', 'builds'][doc_id % 6 + 1] AS folder,
         doc_id % 11 AS ext
  FROM documents
),
kept AS (
  SELECT CASE ext WHEN 0 THEN 'python' WHEN 2 THEN 'typescript' WHEN 3 THEN 'typescript' WHEN 4 THEN 'go'
              WHEN 6 THEN 'c' WHEN 9 THEN 'scala' WHEN 10 THEN 'kotlin' END AS language
  FROM files WHERE folder IN ('src', 'web/src', 'builds')
)
SELECT language, count(*) AS files FROM kept WHERE language IS NOT NULL GROUP BY language""",
    "framework_detect": """
SELECT unnest(['django', 'flask', 'fastapi', 'express']) AS framework
WHERE (SELECT count(*) FROM orders) > 0""",
    "route_extract": ROUTES,
    "scip_nodes": INDEXED + """
SELECT DISTINCT file_path || ':' || name AS id, file_path, name, kind, '' AS signature,
       CAST(0 AS INTEGER) AS line_start, CAST(0 AS INTEGER) AS line_end,
       CAST(NULL AS VARCHAR) AS parent_id, 'typescript' AS language, '{}' AS metadata
FROM defs WHERE file_path || ':' || name <> '/repo/src/o0.ts:Order0'""",
    "scip_edges": INDEXED + """
SELECT DISTINCT file_path AS source_id, target_id, kind, file_path, CAST(0 AS INTEGER) AS line_number FROM links""",
    "scip_counts": INDEXED + """
SELECT (SELECT count(DISTINCT file_path || ':' || name) FROM defs
        WHERE file_path || ':' || name <> '/repo/src/o0.ts:Order0') AS nodes_added,
       (SELECT CAST(sum(times) AS BIGINT) FROM links) AS references_resolved""",
    "scip_symbol_parse": f"""
SELECT p_partkey, {SYMBOL} AS symbol,
  CASE p_partkey % 10 WHEN 0 THEN 'Part' || p_partkey WHEN 1 THEN 'Part' || p_partkey || '.size'
    WHEN 4 THEN 'make' || p_partkey WHEN 5 THEN 'make' || p_partkey WHEN 6 THEN 'make' || p_partkey
    WHEN 7 THEN 'value' || p_partkey WHEN 9 THEN 'Part' || p_partkey || '.deep#name' END AS name,
  CASE p_partkey % 10 WHEN 0 THEN 'class' WHEN 1 THEN 'method' WHEN 4 THEN 'function' WHEN 5 THEN 'method'
    WHEN 6 THEN 'function' WHEN 7 THEN 'symbol' WHEN 9 THEN 'method' END AS kind
FROM part""",
    "git_url_parse": """
WITH urls AS (
  SELECT p_partkey, p_partkey % 8 AS n, replace(lower(p_type), ' ', '-') AS own, 'repo' || p_partkey AS repo
  FROM part
),
parsed AS (
  SELECT p_partkey,
    CASE WHEN n IN (0, 1, 2, 3) THEN 'github' WHEN n IN (4, 7) THEN 'gitlab' WHEN n = 5 THEN 'bitbucket' END AS platform,
    CASE WHEN n = 7 THEN 'gitlab' WHEN n <> 6 THEN own END AS owner,
    CASE WHEN n <> 6 THEN repo END AS name,
    CASE n WHEN 2 THEN 'dev' WHEN 4 THEN 'v1' WHEN 6 THEN NULL ELSE 'main' END AS branch,
    CASE n WHEN 2 THEN 'src/a b' WHEN 5 THEN 'lib' END AS subpath
  FROM urls
)
SELECT *, CASE WHEN platform = 'github' THEN
  'https://api.github.com/repos/' || owner || '/' || name || '/zipball/' || branch ELSE '' END AS archive_url
FROM parsed""",
    "head_commit": """
SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN substr(md5(CAST(p_partkey AS VARCHAR)), 1, 10) END AS "commit"
FROM part""",
    "repo_cache_hits": f"""
SELECT {CACHE_KEY} AS key, c_mktsegment AS owner, c_name AS name, 'main' AS branch,
       c_custkey % 2 = 1 AND c_custkey IN (SELECT o_custkey FROM orders) AS hit
FROM customer""",
    "repo_cache_expired": f"""
WITH kept AS (
  SELECT {CACHE_KEY} AS key, max(o_orderdate) AS written, sum(floor(o_totalprice)) AS bytes
  FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1
)
SELECT key, CAST(bytes AS BIGINT) AS bytes FROM kept
WHERE epoch(TIMESTAMP '2001-01-01 00:00:00') - epoch(written) > 365 * 86400""",
    "dependency_nodes": """
SELECT '/src/' || n_name || '.py:' || l || n_nationkey AS id, '/src/' || n_name || '.py' AS file_path,
       l || n_nationkey AS name, CASE WHEN n_regionkey % 2 = 0 THEN 'class' ELSE 'symbol' END AS kind,
       '' AS signature, CAST(n_nationkey AS INTEGER) AS line_start,
       CAST(n_nationkey + 5 AS INTEGER) AS line_end, CAST(NULL AS VARCHAR) AS parent_id,
       'python' AS language, '{}' AS metadata
FROM nation, (VALUES ('a'), ('b')) AS letters(l)""",
    "dependency_edges": f"""
WITH files AS (SELECT '/src/o' || {KEY} || '.py' AS f, {KEY} AS k, o_custkey, o_orderstatus FROM orders)
SELECT f AS source_id, 'os.path' AS target_id, 'imports' AS kind, f AS file_path, CAST(0 AS INTEGER) AS line_number FROM files
UNION ALL SELECT f, 'run' || o_custkey, 'calls', f, 0 FROM files
UNION ALL SELECT f || ':f' || k, 'g', 'calls', f, 0 FROM files
UNION ALL SELECT f || ':f' || k, 'm.' || o_orderstatus, 'imports', f, 0 FROM files""",
    "run_totals": f"WITH {RUNS} SELECT * FROM runs",
    "run_medians": f"{MEDIANS} SELECT * FROM medians",
    "run_savings": f"""
{MEDIANS},
wide AS (
  SELECT metric, max(median) FILTER (arm = 'with') AS w, max(median) FILTER (arm = 'without') AS wo
  FROM medians GROUP BY metric
)
SELECT metric, {shown("w")} AS with_tool, {shown("wo")} AS without_tool,
       CASE WHEN wo = 0 THEN 'N/A' ELSE printf('%.1f%% ↓', (1.0 - floor(w / wo * 10.0) / 10.0) * 100) END AS savings
FROM wide""",
    "order_medians": """
SELECT l_returnflag, CASE WHEN count(*) % 2 = 1 THEN median(l_quantity)
       ELSE floor(median(l_quantity) * 100) / 100 END AS median
FROM lineitem GROUP BY l_returnflag""",
    "similar_topk": f"""
SELECT a.vec_id, {cosine(6)} AS similarity
FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
ORDER BY {cosine(9)} DESC, a.vec_id LIMIT 20""",
    "similar_nodes": f"""
{GRAPH}
SELECT n.id, n.name, n.kind, {cosine(6, "0.25")} AS similarity
FROM embeddings a JOIN nodes n ON n.id = 'part:' || a.vec_id,
     (SELECT embedding FROM embeddings WHERE vec_id = 7) q
ORDER BY {cosine(9, "0.25")} DESC, n.id LIMIT 10""",
    "embedding_texts": f"{GRAPH} SELECT id AS node_id, name || ': ' || signature AS text FROM nodes",
    "embed_symbols": f"""
{GRAPH},
texts AS (SELECT id AS node_id, unnest({tokens("name || ': ' || signature")}) AS word FROM nodes)
SELECT node_id, CAST(CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) % 384 AS INTEGER) AS place,
       CAST(count(*) AS DOUBLE) AS weight
FROM texts GROUP BY 1, 2""",
}
