"""The SQL each graph query is checked against."""

from __future__ import annotations

# The graph of the relational tables, as in symbolweave.sources.tables.
NODES = """
nodes AS MATERIALIZED (
  SELECT 'region:' || r_regionkey AS id, 'region/all.sql' AS file_path, r_name AS name,
         'interface' AS kind, 'region ' || r_name AS signature,
         CAST(r_regionkey AS INTEGER) AS line_start, CAST(r_regionkey AS INTEGER) AS line_end,
         CAST(NULL AS VARCHAR) AS parent_id, 'python' AS language, '{}' AS metadata
  FROM region
  UNION ALL
  SELECT 'nation:' || n_nationkey, 'nation/' || n_regionkey || '.sql', n_name, 'class',
         'nation ' || n_name, CAST(n_nationkey AS INTEGER), CAST(n_nationkey AS INTEGER),
         'region:' || n_regionkey, 'python', '{}'
  FROM nation
  UNION ALL
  SELECT 'supplier:' || s_suppkey, 'supplier/' || s_nationkey || '.sql', s_name, 'function',
         'supplier ' || s_name, CAST(s_suppkey AS INTEGER), CAST(s_suppkey AS INTEGER),
         'nation:' || s_nationkey, 'go', '{}'
  FROM supplier
  UNION ALL
  SELECT 'customer:' || c_custkey, 'customer/' || c_mktsegment || '.sql', c_name, 'function',
         c_name || ' buys ' || c_mktsegment, CAST(c_custkey AS INTEGER), CAST(c_custkey AS INTEGER),
         'nation:' || c_nationkey, 'typescript', '{"segment": "' || c_mktsegment || '"}'
  FROM customer
  UNION ALL
  SELECT 'orders:' || o_orderkey, 'orders/' || o_orderpriority || '.sql', 'Order#' || o_orderkey,
         'method', 'order status ' || o_orderstatus, CAST(o_orderkey AS INTEGER),
         CAST(o_orderkey AS INTEGER), 'customer:' || o_custkey, 'python',
         '{"status": "' || o_orderstatus || '"}'
  FROM orders
  UNION ALL
  SELECT 'part:' || p_partkey, 'part/' || p_brand || '.sql', p_name, 'symbol',
         p_type || ' ' || p_brand || ' size ' || p_size, CAST(p_partkey AS INTEGER),
         CAST(p_partkey AS INTEGER), NULL, 'go', '{"brand": "' || p_brand || '"}'
  FROM part
)"""

EDGES = """
edge_rows AS (
  SELECT 'nation:' || n_nationkey AS source_id, 'region:' || n_regionkey AS target_id,
         'references' AS kind, 'nation/' || n_regionkey || '.sql' AS file_path,
         CAST(n_nationkey AS INTEGER) AS line_number
  FROM nation
  UNION ALL
  SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'references',
         'supplier/' || s_nationkey || '.sql', CAST(s_suppkey AS INTEGER) FROM supplier
  UNION ALL
  SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'references',
         'customer/' || c_mktsegment || '.sql', CAST(c_custkey AS INTEGER) FROM customer
  UNION ALL
  SELECT 'orders:' || o_orderkey, 'customer:' || o_custkey, 'calls',
         'orders/' || o_orderpriority || '.sql', CAST(o_orderkey AS INTEGER) FROM orders
  UNION ALL
  SELECT 'orders:' || o_orderkey, 'customer:' || o_custkey, 'references',
         'orders/' || o_orderpriority || '.sql', CAST(o_orderkey AS INTEGER)
  FROM orders WHERE o_orderstatus = 'F'
  UNION ALL
  SELECT 'customer:' || o_custkey, 'orders:' || o_orderkey, 'references',
         'orders/' || o_orderpriority || '.sql', CAST(o_orderkey AS INTEGER)
  FROM orders WHERE o_orderpriority = '1-URGENT'
  UNION ALL
  SELECT 'orders:' || l_orderkey, 'part:' || l_partkey, 'calls', 'lineitem.sql',
         CAST(l_linenumber AS INTEGER) FROM lineitem
  UNION ALL
  SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'imports', 'lineitem.sql',
         CAST(l_linenumber AS INTEGER) FROM lineitem
),
edges AS MATERIALIZED (
  SELECT source_id, target_id, kind, max(file_path) AS file_path, max(line_number) AS line_number
  FROM edge_rows GROUP BY source_id, target_id, kind
)"""

GRAPH = f"WITH {NODES}, {EDGES}"
RECURSIVE = f"WITH RECURSIVE {NODES}, {EDGES}"
NODE_COLUMNS = (
    "n.id, n.file_path, n.name, n.kind, n.signature, n.line_start, n.line_end, "
    "n.parent_id, n.language, n.metadata"
)

IN_DEGREE = "indeg AS (SELECT target_id AS id, count(*) AS edge_count FROM edges GROUP BY target_id)"
RANKED = f"""
{GRAPH}, {IN_DEGREE},
ranked AS (
  SELECT n.*, coalesce(d.edge_count, 0) AS edge_count
  FROM nodes n LEFT JOIN indeg d ON n.id = d.id
  ORDER BY edge_count DESC, n.name, n.id LIMIT @limit
)"""


def histogram(table: str, column: str) -> str:
    return f"{GRAPH} SELECT {column}, count(*) AS cnt FROM {table} GROUP BY {column}"


def folded(table: str, column: str) -> str:
    return (
        f"(SELECT string_agg({column} || '=' || c, ',' ORDER BY {column}) "
        f"FROM (SELECT {column}, count(*) AS c FROM {table} GROUP BY {column}))"
    )


def reach(start: str, depth: int, near: str, far: str) -> str:
    """Level-by-level reach with settled ids; level 1 must not be the start."""
    steps = [f"""
level1 AS (
  SELECT e.{far} AS id, min(e.kind) AS edge_kind, 1 AS hop
  FROM edges e JOIN nodes n ON n.id = e.{far}
  WHERE e.{near} = '{start}' AND e.{far} <> '{start}' GROUP BY e.{far}
), seen1 AS (SELECT id FROM level1)"""]
    for k in range(2, depth + 1):
        steps.append(f"""
level{k} AS (
  SELECT e.{far} AS id, min(e.kind) AS edge_kind, {k} AS hop
  FROM edges e JOIN level{k - 1} p ON e.{near} = p.id JOIN nodes n ON n.id = e.{far}
  WHERE e.{far} NOT IN (SELECT id FROM seen{k - 1}) GROUP BY e.{far}
), seen{k} AS (SELECT id FROM seen{k - 1} UNION SELECT id FROM level{k})""")
    union = " UNION ALL ".join(f"SELECT * FROM level{k}" for k in range(1, depth + 1))
    return (
        f"{GRAPH}, {', '.join(steps)} SELECT {NODE_COLUMNS}, r.edge_kind, r.hop "
        f"FROM ({union}) r JOIN nodes n ON n.id = r.id"
    )


def walk(start: str, depth: int, near: str, far: str) -> str:
    return f"""
{RECURSIVE},
walk AS (
  SELECT source_id, target_id, kind, 0 AS depth FROM edges WHERE {near} = '{start}'
  UNION
  SELECT e.source_id, e.target_id, e.kind, w.depth + 1
  FROM edges e JOIN walk w ON e.{near} = w.{far} WHERE w.depth < {depth}
)"""


def label(end: str, alias: str) -> str:
    return f"coalesce({alias}.name || ' (' || {alias}.kind || ')', w.{end}) AS {end[:-3]}_label"


def impact_walk(depth: int) -> str:
    """Level sets of the two-way walk, each level from the one before."""
    steps = ["""
walk0 AS (SELECT source_id, target_id, kind FROM edges
          WHERE source_id = 'customer:0' OR target_id = 'customer:0')"""]
    for k in range(1, depth + 1):
        steps.append(f"""
walk{k} AS (
  SELECT source_id, target_id, kind FROM edges WHERE source_id IN (SELECT target_id FROM walk{k - 1})
  UNION
  SELECT source_id, target_id, kind FROM edges WHERE target_id IN (SELECT source_id FROM walk{k - 1})
)""")
    union = " UNION ALL ".join(f"SELECT *, {k} AS depth FROM walk{k}" for k in range(depth + 1))
    return f"{GRAPH}, {', '.join(steps)}, walk AS ({union})"


def tokens(column: str, fold: bool = True) -> str:
    base = f"strip_accents(lower({column}))" if fold else f"lower({column})"
    return (
        f"list_filter(string_split_regex({base}, '[^\\p{{L}}\\p{{N}}\\p{{Co}}]+'), "
        f"lambda w: w <> '')"
    )


def ranked_search(
    counts: dict[str, str], having: str, scored: list[str], kind: str | None = None,
    limit: int = 20, source: str = "nodes", columns=("name", "signature", "metadata"),
    fold: bool = True, prefix: str = GRAPH, out: str | None = None,
) -> str:
    """BM25 over word lists: ``counts`` names each phrase's occurrences."""
    lists = ", ".join(f"{tokens(c, fold)} AS w_{c}" for c in columns)
    length = " + ".join(f"len(w_{c})" for c in columns)
    freq = ", ".join(f"{expr} AS {name}" for name, expr in counts.items())
    held = ", ".join(f"sum(CASE WHEN {n} > 0 THEN 1 ELSE 0 END) AS n_{n}" for n in counts)
    idf = lambda n: (
        f"CASE WHEN ln((total - n_{n} + 0.5) / (n_{n} + 0.5)) <= 0 THEN 1e-6 "
        f"ELSE ln((total - n_{n} + 0.5) / (n_{n} + 0.5)) END"
    )
    score = " + ".join(
        f"({idf(n)}) * ({n} * 2.2) / ({n} + 1.2 * (0.25 + 0.75 * length / average))" for n in scored
    )
    where = f"({having})" + (f" AND kind = '{kind}'" if kind else "")
    picked = out or (
        "id, file_path, name, kind, signature, line_start, line_end, parent_id, language, metadata"
    )
    return f"""
{prefix},
words AS (SELECT *, {lists} FROM {source}),
counted AS (SELECT *, {length} AS length, {freq} FROM words),
corpus AS (SELECT count(*)::DOUBLE AS total, avg(length) AS average, {held} FROM counted),
hits AS (SELECT counted.*, CAST({score} AS DOUBLE) AS exact FROM counted, corpus WHERE {where}),
best AS (SELECT * FROM hits ORDER BY round(exact, 9) DESC, id LIMIT {limit})
SELECT {picked}, round(exact, 6) AS score FROM best"""


def word_count(word: str, columns=("name", "signature", "metadata"), prefix: bool = False) -> str:
    test = f"starts_with(w, '{word}')" if prefix else f"w = '{word}'"
    return "(" + " + ".join(f"len(list_filter(w_{c}, lambda w: {test}))" for c in columns) + ")"


def phrase_count(words: list[str], prefix: bool = False) -> str:
    """Occurrences of consecutive words, summed over the three columns."""
    tests = []
    for i, w in enumerate(words):
        last = prefix and i == len(words) - 1
        item = "w_{c}[i + %d]" % i
        tests.append(f"starts_with({item}, '{w}')" if last else f"{item} = '{w}'")
    one = "len(list_filter(range(1, len(w_{c}) - %d + 2), lambda i: %s))" % (len(words), " AND ".join(tests))
    return "(" + " + ".join(one.replace("{c}", c) for c in ("name", "signature", "metadata")) + ")"


# The graph after a merge of changed rows, and then without a file.
MERGED = f"""{GRAPH},
merged_nodes AS (
  SELECT id, CASE WHEN moved THEN 'again/part.sql' ELSE file_path END AS file_path,
         CASE WHEN moved THEN 'renewed ' || name ELSE name END AS name, kind,
         CASE WHEN moved THEN 'small ring of ' || signature ELSE signature END AS signature,
         line_start, line_end, parent_id, language, metadata
  FROM (SELECT *, file_path = 'part/Brand#1.sql' AS moved FROM nodes)
  UNION ALL
  SELECT 'again:' || line_start, 'again/region.sql', name, kind, signature, line_start, line_end, parent_id, language, metadata
  FROM nodes WHERE kind = 'interface'
),
merged_edges AS (
  SELECT source_id, target_id, kind, CASE WHEN again THEN 'again/supplier.sql' ELSE file_path END AS file_path,
         line_number + CASE WHEN again THEN 1 ELSE 0 END AS line_number
  FROM (SELECT *, starts_with(source_id, 'supplier:') AS again FROM edges)
),
left_nodes AS (SELECT * FROM merged_nodes WHERE file_path <> 'orders/1-URGENT.sql'),
gone AS (SELECT id FROM merged_nodes WHERE file_path = 'orders/1-URGENT.sql'),
left_edges AS (
  SELECT * FROM merged_edges
  WHERE source_id NOT IN (SELECT id FROM gone) AND target_id NOT IN (SELECT id FROM gone)
)"""

HITS_FOR_CALLERS = ranked_search(
    {"f0": word_count("ring"), "f1": word_count("brand"), "f2": word_count("1")},
    "f0 > 0 AND f1 > 0 AND f2 > 0", ["f0", "f1", "f2"], limit=10,
)


def first_five(near: str, far: str, name: str) -> str:
    return f"""
{name}_pairs AS (
  SELECT h.id AS hit, e.{far} AS other, min(e.kind) AS edge_kind
  FROM found h JOIN edges e ON e.{near} = h.id WHERE e.{far} <> h.id GROUP BY h.id, e.{far}
),
{name}_placed AS (
  SELECT p.hit, o.name || ' (' || p.edge_kind || ')' AS label,
         row_number() OVER (PARTITION BY p.hit ORDER BY o.name, o.id) AS place
  FROM {name}_pairs p JOIN nodes o ON o.id = p.other
),
{name}_side AS (
  SELECT hit, string_agg(label, '; ' ORDER BY place) AS {name} FROM {name}_placed
  WHERE place <= 5 GROUP BY hit
)"""


DELETE_1_URGENT = "(SELECT id FROM nodes WHERE file_path = 'orders/1-URGENT.sql')"

CHANGES = """
changes AS (
  SELECT 'user/' || user_id || '.py' AS path, event_id, ts,
         CASE event_type WHEN 'signup' THEN 'created' WHEN 'purchase' THEN 'deleted'
              ELSE 'modified' END AS op
  FROM events
)"""

ORACLES = {
    "saved_nodes": f"{GRAPH} SELECT * FROM nodes",
    "saved_edges": f"{GRAPH} SELECT * FROM edges",
    "node_rankings": RANKED.replace("@limit", "50") + " SELECT * FROM ranked",
    "file_summary": f"""
{GRAPH}
SELECT * FROM (SELECT n.file_path AS file, count(DISTINCT n.id) AS symbols,
       (SELECT count(*) FROM edges e WHERE e.file_path = n.file_path) AS edges,
       string_agg(DISTINCT n.kind, ',' ORDER BY n.kind) AS kinds
FROM nodes n GROUP BY n.file_path) ORDER BY symbols + edges DESC, file LIMIT 20""",
    "top_symbols": f"""
{GRAPH},
ends AS (SELECT source_id AS id FROM edges UNION ALL
         SELECT target_id FROM edges WHERE target_id <> source_id),
deg AS (SELECT id, count(*) AS refs FROM ends GROUP BY id)
SELECT n.name, n.kind, n.file_path AS file, n.line_start AS line,
       substr(n.signature, 1, 120) AS sig, coalesce(d.refs, 0) AS refs
FROM nodes n LEFT JOIN deg d ON n.id = d.id ORDER BY refs DESC, n.name, n.id LIMIT 20""",
    "kind_histogram": histogram("nodes", "kind"),
    "edge_kind_histogram": histogram("edges", "kind"),
    "language_histogram": histogram("nodes", "language"),
    "validate_report": f"""
{GRAPH}
SELECT (SELECT count(DISTINCT file_path) FROM nodes) AS total_files,
       (SELECT count(*) FROM nodes) AS total_nodes,
       (SELECT count(*) FROM edges) AS total_edges,
       {folded("nodes", "kind")} AS by_kind,
       {folded("edges", "kind")} AS by_edge_kind,
       {folded("nodes", "language")} AS by_language,
       (SELECT count(*) FROM nodes WHERE parent_id IS NOT NULL) AS nodes_with_parent,
       (SELECT count(*) FROM nodes WHERE parent_id IS NOT NULL
          AND parent_id NOT IN (SELECT id FROM nodes)) AS orphan_parent_refs""",
    "status": f"""
{GRAPH}
SELECT 'healthy' AS status, (SELECT count(*) FROM nodes) AS nodes,
       (SELECT count(*) FROM edges) AS edges, 'available' AS fts""",
    "orphan_parents": f"""
{GRAPH}, kept AS (SELECT * FROM nodes WHERE file_path <> 'customer/BUILDING.sql')
SELECT parent_id, count(*) AS children FROM kept
WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM kept) GROUP BY parent_id""",
    "ranked_context": RANKED.replace("@limit", "30") + """
SELECT upper(substr(kind, 1, 1)) || lower(substr(kind, 2)) AS kind_title, name, signature,
       file_path, line_start, edge_count AS "references" FROM ranked""",
    "resolve_edges": f"""
{GRAPH}, bare AS (
  SELECT e.source_id, n.name AS target_id, e.kind, e.file_path, e.line_number
  FROM edges e JOIN nodes n ON n.id = e.target_id
), named AS (
  SELECT regexp_extract(name, '[^.:/]+$') AS short, min(id) AS meant FROM nodes GROUP BY 1 HAVING count(*) = 1
), resolved AS (
  SELECT b.source_id, CASE WHEN k.id IS NOT NULL THEN b.target_id ELSE coalesce(n.meant, b.target_id) END AS target_id,
         b.kind, b.file_path, b.line_number
  FROM bare b LEFT JOIN nodes k ON k.id = b.target_id LEFT JOIN named n ON n.short = b.target_id AND n.short <> ''
)
SELECT source_id, target_id, kind, file_path, line_number FROM resolved
QUALIFY row_number() OVER (PARTITION BY source_id, target_id, kind ORDER BY file_path, line_number) = 1""",
    "node_lookup": f"{GRAPH} SELECT * FROM nodes WHERE id = 'customer:0'",
    "nodes_by_file": f"{GRAPH} SELECT * FROM nodes WHERE file_path = 'orders/1-URGENT.sql'",
    "metadata_map": f"""
{GRAPH}
SELECT id, json_extract_string(metadata, '$.segment') AS segment,
       json_extract_string(metadata, '$.status') AS status,
       json_extract_string(metadata, '$.brand') AS brand FROM nodes""",
    "graph_export_nodes": f"""
{GRAPH} SELECT id, name, kind, file_path AS file, line_start AS line, signature FROM nodes""",
    "graph_export_edges": f"{GRAPH} SELECT source_id AS source, target_id AS target, kind FROM edges",
    "upsert_nodes_last_wins": f"""
{GRAPH},
arriving AS (
  SELECT 'orders:' || l_orderkey AS id, 'lineitem/' || l_returnflag || '.sql' AS file_path,
         'Item#' || l_linenumber AS name, 'method' AS kind,
         l_returnflag || ' ' || l_linestatus AS signature,
         CAST(l_linenumber AS INTEGER) AS line_start, CAST(l_linenumber AS INTEGER) AS line_end,
         CAST(NULL AS VARCHAR) AS parent_id, 'python' AS language, '{{}}' AS metadata,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_partkey DESC,
           l_suppkey DESC, l_linenumber DESC, l_returnflag || ' ' || l_linestatus DESC) AS place
  FROM lineitem
)
SELECT * FROM nodes WHERE id NOT IN (SELECT id FROM arriving)
UNION ALL
SELECT * EXCLUDE (place) FROM arriving WHERE place = 1""",
    "upsert_edges_last_wins": f"""
{GRAPH},
arriving AS (SELECT source_id, target_id, kind, max(line_number) AS line_number FROM edge_rows
             WHERE file_path = 'lineitem.sql' GROUP BY source_id, target_id, kind)
SELECT e.source_id, e.target_id, e.kind,
       CASE WHEN a.kind IS NULL THEN e.file_path ELSE 'again/' || a.line_number END AS file_path,
       coalesce(a.line_number, e.line_number) AS line_number
FROM edges e LEFT JOIN arriving a
  ON e.source_id = a.source_id AND e.target_id = a.target_id AND e.kind = a.kind""",
    "insert_absent": f"""
{GRAPH}, kept AS (SELECT * FROM nodes WHERE file_path <> 'part/Brand#1.sql')
SELECT * FROM kept
UNION ALL
SELECT 'part:' || l_partkey, 'lineitem.sql', 'Part#' || l_partkey, 'symbol', '',
       CAST(min(l_linenumber) AS INTEGER), CAST(min(l_linenumber) AS INTEGER), NULL, 'go', '{{}}'
FROM lineitem WHERE 'part:' || l_partkey NOT IN (SELECT id FROM kept) GROUP BY l_partkey""",
    "delete_file_nodes": f"{GRAPH} SELECT * FROM nodes WHERE file_path <> 'orders/1-URGENT.sql'",
    "delete_file_edges": f"""
{GRAPH} SELECT * FROM edges
WHERE source_id NOT IN {DELETE_1_URGENT} AND target_id NOT IN {DELETE_1_URGENT}""",
    "callers_d1": reach("nation:0", 1, "target_id", "source_id"),
    "callers_d2": reach("nation:0", 2, "target_id", "source_id"),
    "callees_d1": reach("orders:0", 1, "source_id", "target_id"),
    "callees_d3": reach("customer:0", 3, "source_id", "target_id"),
    "impact_d3": f"""
{RECURSIVE},
arcs AS MATERIALIZED (SELECT source_id AS near, target_id AS far FROM edges UNION
                      SELECT target_id, source_id FROM edges),
near AS (
  SELECT 'customer:0' AS id, 0 AS depth
  UNION
  SELECT a.far, r.depth + 1 FROM near r JOIN arcs a ON a.near = r.id JOIN nodes n ON n.id = a.far
  WHERE r.depth < 3
),
first AS (SELECT id, min(depth) AS depth FROM near GROUP BY id)
SELECT {NODE_COLUMNS}, f.depth FROM first f JOIN nodes n ON n.id = f.id WHERE f.depth > 0""",
    "trace_path": f"""
{RECURSIVE},
path AS (
  SELECT source_id, target_id, 0 AS depth, [source_id, target_id] AS steps
  FROM edges WHERE source_id = 'orders:0'
  UNION ALL
  SELECT e.source_id, e.target_id, p.depth + 1, list_append(p.steps, e.target_id)
  FROM edges e JOIN path p ON e.source_id = p.target_id
  WHERE p.depth < 15 AND e.target_id <> p.source_id
)
SELECT depth, array_to_string(steps, ' → ') AS path_str FROM path
WHERE target_id = 'region:0' ORDER BY depth, steps LIMIT 1""",
    "trace_closed": f"""
{RECURSIVE},
path AS (
  SELECT source_id, target_id, 0 AS depth, [source_id, target_id] AS steps
  FROM edges WHERE source_id = 'customer:0'
  UNION ALL
  SELECT e.source_id, e.target_id, p.depth + 1, list_append(p.steps, e.target_id)
  FROM edges e JOIN path p ON e.source_id = p.target_id
  WHERE p.depth < 15 AND e.target_id <> p.source_id
)
SELECT depth, array_to_string(steps, ' → ') AS path_str FROM path
WHERE target_id = 'customer:0' ORDER BY depth, steps LIMIT 1""",
    "trace_far": """
WITH RECURSIVE walk(k, depth, path) AS (
  SELECT 2::BIGINT, -1, ['part:2']
  UNION ALL
  SELECT w.k + s.ahead, w.depth + 1, list_append(w.path, 'part:' || (w.k + s.ahead))
  FROM walk w, (SELECT unnest([1, 3]) AS ahead) s
  WHERE w.depth < 15 AND w.k + s.ahead <= 33 AND w.k IN (SELECT p_partkey FROM part)
)
SELECT depth, array_to_string(path, ' → ') AS path_str FROM walk WHERE k = 33 ORDER BY depth, path LIMIT 1""",
    "trace_ring": """
SELECT (count(*) - 1)::INTEGER AS depth,
       string_agg('supplier:' || s_suppkey, ' → ' ORDER BY s_suppkey) || ' → supplier:0' AS path_str
FROM supplier WHERE s_suppkey < 8""",
    "trace_edges": f"""
{RECURSIVE},
path AS (
  SELECT source_id, target_id, kind, file_path, line_number, 0 AS depth, [source_id] AS steps
  FROM edges WHERE source_id = 'orders:0'
  UNION
  SELECT e.source_id, e.target_id, e.kind, e.file_path, e.line_number, p.depth + 1,
         list_append(p.steps, e.source_id)
  FROM edges e JOIN path p ON e.source_id = p.target_id WHERE p.depth < 10
)
SELECT source_id, target_id, kind, file_path, line_number, depth,
       array_to_string(steps, ' -> ') AS path_str
FROM path WHERE target_id = 'region:0' ORDER BY depth, steps, kind LIMIT 20""",
    "callers_edges": walk("supplier:0", 1, "target_id", "source_id") + f"""
SELECT w.*, {label("source_id", "s")} FROM walk w LEFT JOIN nodes s ON s.id = w.source_id""",
    "callees_edges": walk("customer:0", 3, "source_id", "target_id") + f"""
SELECT w.*, {label("target_id", "t")} FROM walk w LEFT JOIN nodes t ON t.id = w.target_id""",
    "impact_edges": impact_walk(2) + f"""
SELECT w.source_id, w.target_id, w.kind, w.depth, {label("source_id", "s")}, {label("target_id", "t")}
FROM walk w LEFT JOIN nodes s ON s.id = w.source_id LEFT JOIN nodes t ON t.id = w.target_id""",
    "impact_names": impact_walk(2) + """,
ends AS (SELECT depth, source_id AS id FROM walk UNION SELECT depth, target_id FROM walk),
named AS (
  SELECT e.depth, n.name, n.kind, n.file_path, n.line_start,
         row_number() OVER (PARTITION BY e.depth, n.name ORDER BY n.id) AS place
  FROM ends e JOIN nodes n ON n.id = e.id
)
SELECT depth, name, kind, file_path, line_start FROM named WHERE place = 1""",
    "symbols_with_callers": HITS_FOR_CALLERS.replace("\nSELECT id, file_path", ",\nfound AS (SELECT id, file_path")
    + f"""),
{first_five("target_id", "source_id", "called_by")},
{first_five("source_id", "target_id", "calls")}
SELECT f.id, f.name, f.kind, f.file_path AS file, f.line_start AS line,
       substr(f.signature, 1, 120) AS sig, coalesce(b.called_by, '') AS called_by,
       coalesce(c.calls, '') AS calls
FROM found f LEFT JOIN called_by_side b ON b.hit = f.id LEFT JOIN calls_side c ON c.hit = f.id""",
    "search_blank": f"{GRAPH} SELECT * FROM nodes WHERE kind = 'symbol' ORDER BY name, id LIMIT 20",
    "search_and": ranked_search(
        {"f0": word_count("small"), "f1": word_count("ring")}, "f0 > 0 AND f1 > 0", ["f0", "f1"]),
    "search_or": ranked_search(
        {"f0": word_count("widget"), "f1": word_count("building")}, "f0 > 0 OR f1 > 0", ["f0", "f1"]),
    "search_not": ranked_search(
        {"f0": word_count("widget"), "f1": word_count("red"), "f2": word_count("economy")},
        "f0 > 0 AND NOT (f1 > 0 AND f2 > 0)", ["f0"]),
    "search_phrase": ranked_search(
        {"f0": phrase_count(["brand", "1", "size"]), "f1": word_count("eco", ("signature",), True)},
        "f0 > 0 AND f1 > 0", ["f0", "f1"]),
    "search_kind": ranked_search({"f0": word_count("machinery")}, "f0 > 0", ["f0"], kind="function"),
    "search_prefix": ranked_search(
        {"f0": word_count("red"), "f1": word_count("wid", prefix=True)}, "f0 > 0 AND f1 > 0",
        ["f0", "f1"], kind="symbol", limit=50),
    "search_members": f"""
{GRAPH}, words AS (SELECT *, {tokens("name || ' ' || signature || ' ' || metadata")} AS w FROM nodes)
SELECT * EXCLUDE (w) FROM words
WHERE list_contains(w, 'status') AND list_contains(w, 'f') AND kind = 'method' ORDER BY id LIMIT 20""",
    "search_scanned": ranked_search(
        {"f0": word_count("widget"), "f1": word_count("building")}, "f0 > 0 OR f1 > 0", ["f0", "f1"]),
    "search_after_merge": ranked_search(
        {"f0": word_count("renewed"), "f1": word_count("small"), "f2": word_count("ring")},
        "f0 > 0 OR (f1 > 0 AND f2 > 0)", ["f0", "f1", "f2"], limit=40, source="merged_nodes", prefix=MERGED),
    "search_after_delete": ranked_search(
        {"f0": phrase_count(["order", "status"]), "f1": word_count("re", prefix=True)},
        "f0 > 0 OR f1 > 0", ["f0", "f1"], limit=40, source="left_nodes", prefix=MERGED),
    "index_twice_nodes": f"{MERGED} SELECT * FROM merged_nodes",
    "index_twice_edges": f"{MERGED} SELECT * FROM merged_edges",
    "delete_file_stored": f"{MERGED} SELECT * FROM left_nodes",
    "delete_file_stored_edges": f"{MERGED} SELECT * FROM left_edges",
    "rankings_after_changes": f"""{MERGED},
degrees AS (SELECT target_id AS id, count(*) AS edge_count FROM left_edges GROUP BY target_id)
SELECT n.*, coalesce(d.edge_count, 0) AS edge_count FROM left_nodes n LEFT JOIN degrees d ON d.id = n.id
ORDER BY edge_count DESC, n.name, n.id LIMIT 50""",
    "moved_file_nodes": f"{MERGED} SELECT * FROM merged_nodes WHERE file_path IN ('part/Brand#1.sql', 'again/part.sql')",
    "search_like_words": f"""
{GRAPH} SELECT * FROM nodes
WHERE name ILIKE '%find%' OR name ILIKE '%widget%' OR name ILIKE '%ring%' ORDER BY id LIMIT 30""",
    "explore_grouped": f"""
{GRAPH}, hits AS (SELECT * FROM nodes WHERE name ILIKE '%brand#1%' OR file_path ILIKE '%brand#1%'
                  ORDER BY id LIMIT 50)
SELECT file_path, min(id) AS first_id,
       string_agg(name || ' (' || kind || ') :' || line_start, chr(10) ORDER BY id) AS entries
FROM hits GROUP BY file_path""",
    "context_by_file": "WITH hits2 AS (" + ranked_search(
        {"f0": word_count("widget"), "f1": word_count("machinery"), "f2": word_count("nation")}, "f0 > 0 OR f1 > 0 OR f2 > 0",
        ["f0", "f1", "f2"], limit=40).replace("round(exact, 6) AS score", "round(exact, 9) AS score") + """)
SELECT string_split(file_path, '/')[-1] AS file, count(*) AS symbols,
       string_agg('  `' || name || '` (' || kind || ')' || CASE WHEN signature <> '' THEN
         ' — `' || trim(replace(substr(signature, 1, 80), chr(10), ' ')) || '`' ELSE '' END,
         chr(10) ORDER BY score DESC, id) AS lines
FROM hits2 GROUP BY 1""",
    "search_documents": ranked_search(
        {"f0": word_count("license", ("text",)), "f1": word_count("released", ("text",)),
         "f2": word_count("the", ("text",))},
        "f0 > 0 OR f1 > 0 OR f2 > 0", ["f0", "f1", "f2"], limit=50,
        source="(SELECT doc_id AS id, text FROM documents)", columns=("text",), fold=False,
        prefix="WITH unused AS (SELECT 1)", out="id"),
    "debounce_changes": f"""
WITH {CHANGES},
marked AS (
  SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 21600000000 THEN 1 ELSE 0 END AS fresh
  FROM changes WINDOW w AS (PARTITION BY path ORDER BY ts, event_id)
),
bursts AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts, event_id) AS burst FROM marked)
SELECT path, arg_max(op, (ts, event_id)) AS op, min(epoch_us(ts)) AS first_us,
       max(epoch_us(ts)) AS last_us, count(*) AS events
FROM bursts GROUP BY path, burst""",
    "apply_changes": f"""
{GRAPH}, {CHANGES},
batches AS (
  SELECT path, day(ts) % 2 AS batch, arg_max(op, (ts, event_id)) AS op,
         arg_max(event_id, (ts, event_id)) AS event_id, bool_or(op IN ('modified', 'deleted')) AS cleared
  FROM changes GROUP BY 1, 2
),
written AS (SELECT path, batch, event_id FROM batches WHERE op <> 'deleted'),
kept AS (
  SELECT w.* FROM written w
  WHERE NOT EXISTS (SELECT 1 FROM batches b WHERE b.path = w.path AND b.batch > w.batch AND b.cleared)
)
SELECT * FROM nodes
UNION ALL
SELECT path || ':f' || event_id, path, 'f' || event_id, 'function',
       'def f' || event_id || '(): run()', 1, 2, NULL, 'python', '{{}}' FROM kept""",
    "apply_changes_edges": f"""
{GRAPH}, {CHANGES},
batches AS (SELECT path, day(ts) % 2 AS batch, arg_max(op, (ts, event_id)) AS op FROM changes GROUP BY 1, 2)
SELECT * FROM edges
UNION ALL
SELECT DISTINCT path, 'run', 'calls', path, 2 FROM batches WHERE op <> 'deleted'""",
    "bad_records": f"""
WITH {CHANGES},
told AS (SELECT c.*, e.event_type = 'error' AS broken FROM changes c JOIN events e ON e.event_id = c.event_id),
batches AS (
  SELECT path, (day(ts) % 2)::BIGINT AS batch, arg_max(op, (ts, event_id)) AS op, arg_max(broken, (ts, event_id)) AS broken
  FROM told GROUP BY 1, 2
),
last AS (SELECT path, arg_max(op, batch) AS op, arg_max(broken, batch) AS broken, max(batch) AS batch FROM batches GROUP BY path)
SELECT path, op, 'no text' AS error, batch FROM last WHERE broken AND op <> 'deleted'""",
    "stream_changes": """
WITH c AS (SELECT DISTINCT c_custkey // 100 AS k FROM customer), s AS (SELECT DISTINCT s_suppkey // 100 AS k FROM supplier)
SELECT 'src/c' || k || '.py' AS path, 'created' AS op, 1::BIGINT AS snapshot FROM c
UNION ALL SELECT 'src/c' || k || '.py', CASE k % 3 WHEN 0 THEN 'deleted' ELSE 'modified' END, 2 FROM c WHERE k % 3 < 2
UNION ALL SELECT 'src/s' || k || '.py', 'created', 2 FROM s""",
    "watched_nodes": """
WITH f AS (
  SELECT 'c' || c_custkey AS name, 'c' || c_custkey // 100 || '.py' AS file, c_custkey AS key, c_custkey // 100 AS k FROM customer
  UNION ALL SELECT 's' || s_suppkey, 's' || s_suppkey // 100 || '.py', s_suppkey, -1 FROM supplier
  UNION ALL SELECT 'more' || k, 'c' || k || '.py', 9223372036854775807, k
  FROM (SELECT DISTINCT c_custkey // 100 AS k FROM customer) WHERE k % 3 = 1
)
SELECT name, file, 'function' AS kind, (2 * row_number() OVER (PARTITION BY file ORDER BY key) - 1)::INTEGER AS line_start
FROM f WHERE k < 0 OR k % 3 > 0""",
}
