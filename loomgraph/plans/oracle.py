"""Oracle SQL of the table queries, for DuckDB over the same tables."""

from __future__ import annotations

TRADE = """flows AS (
  SELECT c_nationkey AS source, s_nationkey AS target, count(*) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY 1, 2),
edges AS (SELECT source, target FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, target) AS place FROM flows) WHERE place <= 2)"""
WALKS = """walks AS (
  SELECT source AS first, [source, target] AS members FROM edges WHERE target > source
  UNION ALL
  SELECT first, list_append(members, target) FROM walks JOIN edges ON source = members[-1] WHERE target > first AND NOT list_contains(members, target)),
loops AS (SELECT members FROM walks JOIN edges ON source = members[-1] AND target = first)"""
DEGREES = """degrees AS (
  SELECT n_nationkey AS node, coalesce(i, 0)::INT AS in_degree, coalesce(o, 0)::INT AS out_degree FROM nation
  LEFT JOIN (SELECT target, count(*) AS i FROM edges GROUP BY 1) ON target = n_nationkey
  LEFT JOIN (SELECT source, count(*) AS o FROM edges GROUP BY 1) ON source = n_nationkey)"""
CENTRALITY = """steps AS (
  SELECT n_nationkey AS s, n_nationkey AS v, 0 AS k FROM nation
  UNION ALL
  SELECT s, target, k + 1 FROM steps JOIN edges ON source = v WHERE k < 10),
walked AS (SELECT s, v, k, count(*)::DOUBLE AS paths FROM steps GROUP BY ALL),
near AS (SELECT s, v, min(k) AS k, arg_min(paths, k) AS paths FROM walked GROUP BY s, v),
pairs AS (
  SELECT a.v AS node, sum(a.paths * b.paths / c.paths) AS total
  FROM near a JOIN near b ON a.v = b.s JOIN near c ON c.s = a.s AND c.v = b.v AND c.k = a.k + b.k
  WHERE a.s <> a.v AND b.s <> b.v AND a.s <> b.v GROUP BY 1),
central AS (SELECT n_nationkey AS node, round(coalesce(total, 0) / (24 * 23), 6) AS centrality FROM nation LEFT JOIN pairs ON node = n_nationkey)"""
ROLE = "CASE WHEN in_degree = 0 AND out_degree > 0 THEN 'entry' WHEN in_degree = 0 THEN 'dead' ELSE 'none' END"
ISSUES = """issues AS (
  SELECT doc_id AS file, 'high' AS severity, 'low_quality' AS issue_type, 0 AS detector FROM labels WHERE quality = 0 AND doc_id IN (SELECT doc_id FROM documents)
  UNION ALL SELECT doc_id, 'medium', 'toxic', 1 FROM labels WHERE toxic = 1 AND doc_id IN (SELECT doc_id FROM documents)
  UNION ALL SELECT doc_id, 'low', 'too_short', 2 FROM documents WHERE n_chars < 200)"""
PIVOT = """pivoted AS (
  SELECT file, high, medium, low, 3 * high + 2 * medium + low AS weight FROM (
    SELECT file, count_if(severity = 'high')::INT AS high, count_if(severity = 'medium')::INT AS medium, count_if(severity = 'low')::INT AS low FROM issues GROUP BY 1))"""
PATH = r"regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://', ''), '/+$', '')"
NAMED = rf"""named AS (SELECT page_id, path, split_part(path, '/', -1) AS name FROM (SELECT page_id, {PATH} AS path FROM pages)),
parts AS (SELECT *, CASE WHEN regexp_matches(name, '^.+\.[^.]+$') THEN regexp_extract(name, '\.[^.]+$') ELSE '' END AS ext FROM named)"""
LINKS = """links AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS l FROM pages),
hrefs AS (SELECT page_id, unnest(range(len(l)))::INT AS pos, unnest(l) AS href FROM links),
words AS (SELECT *, split_part(href, '/', -1) AS word FROM hrefs)"""
RISK = """lines AS (
  SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS centrality, count(DISTINCT l_orderkey) AS in_degree,
    count_if(l_returnflag = 'R') AS weight, count(DISTINCT l_partkey) AS complexity FROM lineitem GROUP BY 1),
base AS (
  SELECT s_suppkey, s_acctbal < 0 AS failed, coalesce(centrality, 0) AS centrality, coalesce(in_degree, 0) AS in_degree, coalesce(weight, 0) AS weight,
    coalesce(complexity, 0) AS complexity FROM supplier LEFT JOIN lines ON l_suppkey = s_suppkey),
tops AS (SELECT coalesce(nullif(max(centrality), 0), 1)::DOUBLE AS c, coalesce(nullif(max(in_degree), 0), 1)::DOUBLE AS n, coalesce(nullif(max(weight), 0), 1)::DOUBLE AS w,
  coalesce(nullif(max(complexity), 0), 1)::DOUBLE AS x FROM base),
scored AS (
  SELECT *, round(greatest(0, least(1, 0.3::DOUBLE * centrality / c + 0.2::DOUBLE * in_degree / n + 0.25::DOUBLE * weight / w + CASE WHEN failed THEN 0.15::DOUBLE ELSE 0 END
    + 0.1::DOUBLE * complexity / x)), 6) AS risk_score, round(centrality / c, 6) AS factor FROM base, tops),
banded AS (SELECT *, CASE WHEN risk_score >= 0.55 THEN 'high' WHEN risk_score >= 0.25 THEN 'medium' ELSE 'low' END AS level FROM scored)"""
COUNT = "(length(text) - length(replace(text, '{0}', ''))) // length('{0}')"


def _counts(*words: str) -> str:
    return " + ".join(COUNT.format(w) for w in words)


FOREST = """forest AS (
  SELECT 'r' || r_regionkey AS node, 0 AS level FROM region UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation UNION ALL SELECT 'c' || c_custkey, 2 FROM customer)"""

SCORES = f"""SELECT doc_id, (CASE lang WHEN 'en' THEN {_counts('the ', 'and ')} WHEN 'fr' THEN {_counts('le ', 'de ')} WHEN 'de' THEN {_counts('der ', 'die ')} ELSE {_counts('el', 'la')} END)::INT AS score
      FROM documents"""
TREE = f"""paths AS (SELECT DISTINCT {PATH} AS id, string_split({PATH}, '/') AS p FROM pages),
folders AS (SELECT DISTINCT array_to_string(p[1:k], '/') AS id FROM (SELECT p, unnest(range(1, len(p))) AS k FROM paths)),
tree AS (SELECT '__root__' AS id, 'root' AS type UNION ALL SELECT id, 'folder' FROM folders UNION ALL SELECT id, 'file' FROM paths),
hung AS (SELECT id, CASE WHEN contains(id, '/') THEN regexp_replace(id, '/[^/]*$', '') ELSE '__root__' END AS parent FROM tree WHERE type <> 'root')"""

ORACLE_SQL = {
    "resolve_edges": f"WITH {TRADE} SELECT source, target FROM edges",
    "degrees": f"WITH {TRADE}, {DEGREES} SELECT node, in_degree, out_degree FROM degrees",
    "entry_dead": f"""WITH {TRADE}, {DEGREES} SELECT node, CASE WHEN in_degree = 0 AND out_degree > 0 THEN 'entry' WHEN in_degree = 0 THEN 'dead' WHEN n_regionkey = 0 THEN 'entry' ELSE 'none' END AS role
      FROM degrees JOIN nation ON n_nationkey = node""",
    "edge_highlight": f"""WITH RECURSIVE {TRADE}, {WALKS}, on_loop AS (SELECT DISTINCT unnest(members) AS node FROM loops)
      SELECT source, target, CASE WHEN source = 0 OR target = 0 THEN 'highlight' WHEN source IN (SELECT node FROM on_loop) OR target IN (SELECT node FROM on_loop) THEN 'circular' ELSE 'regular' END AS class FROM edges""",
    "node_summaries": f"""WITH {TRADE}, {DEGREES} SELECT node, concat_ws('  ', '[' || n_regionkey || ']', 'risk=' || CASE WHEN in_degree >= 5 THEN 'high' ELSE 'low' END,
      CASE WHEN {ROLE} = 'entry' THEN 'entry-point' END, CASE WHEN {ROLE} = 'dead' THEN 'dead-file' END, CASE WHEN in_degree >= 8 THEN 'circular-dep' END, 'in=' || in_degree || ' out=' || out_degree) AS line
      FROM degrees JOIN nation ON n_nationkey = node""",
    "cycles": f"WITH RECURSIVE {TRADE}, {WALKS} SELECT list_aggregate(members, 'string_agg', ',') AS members, len(members)::INT AS length FROM loops",
    "in_cycle_flag": f"WITH RECURSIVE {TRADE}, {WALKS} SELECT n_nationkey AS node, n_nationkey IN (SELECT unnest(members) FROM loops) AS flag FROM nation",
    "ancestors": f"""WITH RECURSIVE {TRADE}, up AS (SELECT target AS root, source AS node FROM edges UNION SELECT root, source FROM up JOIN edges ON target = node)
      SELECT n_nationkey AS root, count(node) AS n_impacts, coalesce(string_agg(node, ',' ORDER BY node), '') AS impacts
      FROM nation LEFT JOIN up ON root = n_nationkey AND node <> root GROUP BY 1""",
    "betweenness": f"WITH RECURSIVE {TRADE}, {CENTRALITY} SELECT node, centrality FROM central",
    "most_central": f"WITH RECURSIVE {TRADE}, {CENTRALITY} SELECT node, centrality FROM central ORDER BY centrality DESC, node LIMIT 1",
    "topo_levels": f"WITH {FOREST} SELECT node, level FROM forest",
    "level_layout": f"""WITH {FOREST} SELECT node, level, round((row_number() OVER (PARTITION BY level ORDER BY node) - 1 - count(*) OVER (PARTITION BY level) / 2) * 2
      / count(*) OVER (PARTITION BY level), 6) AS x, round(1 - level / 2, 6) AS y FROM forest""",
    "impact_lookup": f"""WITH {TRADE} SELECT n_nationkey AS node, coalesce((SELECT string_agg(source, ',' ORDER BY source) FROM edges WHERE target = n_nationkey), '') AS dependents,
      coalesce((SELECT string_agg(target, ',' ORDER BY target) FROM edges WHERE source = n_nationkey), '') AS dependencies FROM nation""",
    "ego_network": f"WITH {TRADE} SELECT source, target FROM edges WHERE source = 0 OR target = 0",
    "edge_class": f"""WITH RECURSIVE {TRADE}, {WALKS}, on_loop AS (SELECT DISTINCT unnest(members) AS node FROM loops)
      SELECT source, target, CASE WHEN source IN (SELECT node FROM on_loop) OR target IN (SELECT node FROM on_loop) THEN 'circular' ELSE 'regular' END AS class FROM edges""",
    "trim_topk": f"""WITH RECURSIVE {TRADE}, {DEGREES}, {CENTRALITY}, top AS (
      SELECT node FROM degrees JOIN central USING (node) ORDER BY 10 * centrality + in_degree + CASE WHEN in_degree = 0 AND out_degree > 0 THEN 5 ELSE 0 END DESC, node LIMIT 10)
      SELECT source, target FROM edges WHERE source IN (SELECT node FROM top) AND target IN (SELECT node FROM top)""",
    "node_meta": f"""WITH RECURSIVE {TRADE}, {DEGREES}, {CENTRALITY}, {WALKS} SELECT node, n_name AS name, r_name AS region, in_degree, out_degree, centrality, {ROLE} AS role,
      node IN (SELECT unnest(members) FROM loops) AS is_circular FROM degrees JOIN central USING (node) JOIN nation ON n_nationkey = node JOIN region ON r_regionkey = n_regionkey""",
    "lang_distribution": "SELECT lang, count(*) AS n, round(count(*) * 100 / sum(count(*)) OVER (), 1) AS pct FROM documents GROUP BY 1",
    "category_counts": """SELECT CASE WHEN split_part(p_type, ' ', 1) IN ('STANDARD', 'SMALL') THEN 'source' WHEN split_part(p_type, ' ', 1) IN ('MEDIUM', 'LARGE') THEN 'config'
      WHEN split_part(p_type, ' ', 1) = 'ECONOMY' THEN 'assets' ELSE 'other' END AS bucket, count(*) AS n FROM part GROUP BY 1""",
    "size_filter_scan": "SELECT doc_id, n_chars FROM documents WHERE n_chars <= 5000",
    "line_count": r"""SELECT doc_id, (len(string_split(t, chr(10))) - CASE WHEN t = '' OR t LIKE '%' || chr(10) THEN 1 ELSE 0 END)::INT AS lines
      FROM (SELECT doc_id, regexp_replace(text, '\r\n?', chr(10), 'g') AS t FROM documents)""",
    "scan_summary": "SELECT count(*) AS total, sum(n_chars) AS total_size, count(DISTINCT lang) AS n_langs FROM documents",
    "folder_tree": f"""WITH {NAMED}, split AS (SELECT string_split(path, '/') AS p FROM named)
      SELECT DISTINCT array_to_string(p[1:k], '/') AS folder FROM (SELECT p, unnest(range(1, len(p))) AS k FROM split)""",
    "path_parts": f"WITH {NAMED} SELECT page_id, name, ext, left(name, length(name) - length(ext)) AS stem, len(string_split(path, '/'))::INT AS depth FROM parts",
    "link_extract": f"WITH {LINKS} SELECT page_id, pos, href FROM hrefs",
    "js_import_names": f"""WITH {LINKS} SELECT page_id, coalesce(string_agg('.' || href, ',' ORDER BY pos) FILTER (pos % 2 = 0), '') AS relative, count(*) FILTER (pos % 2 = 1)::INT AS n_packages
      FROM pages LEFT JOIN hrefs USING (page_id) GROUP BY 1""",
    "link_dedup": f"WITH {LINKS} SELECT page_id, len(l)::INT AS n_links, len(list_distinct(l))::INT AS n_distinct FROM links",
    "stem_last_wins": "SELECT p_name, max(p_partkey) AS p_partkey FROM part GROUP BY 1",
    "issue_union": f"WITH {ISSUES} SELECT * FROM issues",
    "issue_detectors": rf"""WITH RECURSIVE {TRADE}, {WALKS}, {LINKS}, frequent AS (
      SELECT w FROM (SELECT unnest(list_distinct(regexp_split_to_array(text, '[ \t\n\r\f\v]+'))) AS w FROM documents) GROUP BY w HAVING count(*) >= 100)
      SELECT 'high' AS severity, 'syntax_error' AS issue_type, doc_id::VARCHAR AS file, (toxic + 1)::INT AS line, 0 AS detector FROM labels WHERE quality <> 1
      UNION ALL SELECT 'high', 'circular_dependency', member::VARCHAR, NULL, 1 FROM (SELECT unnest(members) AS member FROM loops)
      UNION ALL SELECT 'low', 'isolated_file', c_custkey::VARCHAR, NULL, 2 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
      UNION ALL SELECT 'medium', 'excessive_dependencies', l_orderkey::VARCHAR, NULL, 3 FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) >= 7
      UNION ALL SELECT 'low', 'missing_import', page_id::VARCHAR, NULL, 5 FROM words
        WHERE word NOT IN ('the', 'The', 'of', 'and', 'de', 'la', 'le', 'der', 'die', 'el') AND word NOT IN (SELECT w FROM frequent)""",
    "severity_counts": f"""WITH {ISSUES} SELECT severity, console, count(file) AS n FROM (VALUES ('high', 'ERROR'), ('medium', 'WARNING'), ('low', 'INFO')) d(severity, console)
      LEFT JOIN issues USING (severity) GROUP BY 1, 2""",
    "issue_pivot": f"WITH {ISSUES}, {PIVOT} SELECT * FROM pivoted",
    "unpivot_dashboard": f"""WITH {ISSUES} SELECT category, count(file) AS count, d.severity FROM (VALUES ('low_quality', 'high'), ('toxic', 'medium'), ('too_short', 'low')) d(category, severity)
      LEFT JOIN issues ON issue_type = category GROUP BY 1, 3""",
    "excessive_deps": "SELECT l_orderkey, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 7",
    "unused_anti_contains": f"""WITH {LINKS}, w AS (SELECT DISTINCT word FROM words WHERE length(word) > 2)
      SELECT word FROM w WHERE NOT EXISTS (SELECT 1 FROM documents WHERE contains(text, word))""",
    "missing_import_anti": rf"""WITH {LINKS}, frequent AS (
      SELECT w FROM (SELECT unnest(list_distinct(regexp_split_to_array(text, '[ \t\n\r\f\v]+'))) AS w FROM documents) GROUP BY w HAVING count(*) >= 100)
      SELECT page_id, href FROM words WHERE word NOT IN ('the', 'The', 'of', 'and', 'de', 'la', 'le', 'der', 'die', 'el') AND word NOT IN (SELECT w FROM frequent)""",
    "failed_files": "SELECT event_id FROM events WHERE event_type = 'error' OR (user_id % 3 <> 0 AND value < 1.0)",
    "keyword_complexity": f"""SELECT doc_id, score, CASE WHEN score <= 5 THEN 'low' WHEN score <= 15 THEN 'medium' ELSE 'high' END AS level FROM (
      SELECT doc_id, (CASE lang WHEN 'en' THEN {_counts('the ', 'and ')} WHEN 'fr' THEN {_counts('le ', 'de ')} WHEN 'de' THEN {_counts('der ', 'die ')} ELSE {_counts('el', 'la')} END)::INT AS score
      FROM documents)""",
    "risk_score": f"WITH {RISK} SELECT s_suppkey, risk_score, level FROM banded",
    "risk_reasons": f"""WITH {RISK}, told AS (SELECT s_suppkey, level, concat_ws('; ',
        CASE WHEN factor > 0.5 THEN 'High graph centrality — critical bridge in dependency network' WHEN factor > 0.2 THEN 'Moderate centrality — several files route through this' END,
        CASE WHEN in_degree >= 5 THEN in_degree || ' files depend on this — failure has wide impact' WHEN in_degree >= 2 THEN in_degree || ' files depend on this' END,
        CASE WHEN weight > 0 THEN weight || ' high-severity issue(s) detected' END,
        CASE WHEN failed THEN 'Failed execution/compile check' END,
        CASE WHEN complexity > 20 THEN 'High complexity score (' || complexity || ') — difficult to maintain' WHEN complexity > 10 THEN 'Moderate complexity (' || complexity || ')' END) AS t FROM banded)
      SELECT s_suppkey, CASE WHEN t = '' THEN 'Low overall risk — ' || level || ' dependency footprint' ELSE t END AS reasons FROM told""",
    "high_risk_top5": f"WITH {RISK} SELECT s_suppkey, risk_score FROM banded WHERE level = 'high' ORDER BY risk_score DESC, s_suppkey LIMIT 5",
    "risk_counts": f"WITH {RISK} SELECT count_if(level = 'high') AS high, count_if(level = 'medium') AS medium, count_if(level = 'low') AS low FROM banded",
    "relevance_topk": f"""WITH {ISSUES}, {PIVOT}, rows AS (
      SELECT doc_id, doc_id = 7 AS is_focus, contains('what is wrong with src3/doc23 and src5/doc25?', lower(source || '/doc' || doc_id)) AS is_mentioned, coalesce(weight, 0) * 5.0::DOUBLE AS base
      FROM documents LEFT JOIN pivoted ON file = doc_id),
    scored AS (SELECT *, base + CASE WHEN is_mentioned THEN 20 ELSE 0 END + CASE WHEN is_focus THEN 25 ELSE 0 END AS score FROM rows),
    top AS (SELECT * FROM (SELECT * FROM scored ORDER BY score DESC, doc_id LIMIT 8) WHERE score > 0),
    ranked AS (SELECT doc_id, score, 1 AS a, -score AS b, doc_id AS c FROM top UNION ALL
      SELECT doc_id, score, 0, CASE WHEN is_focus THEN 0 ELSE -1 END, -doc_id FROM scored WHERE (is_focus OR is_mentioned) AND doc_id NOT IN (SELECT doc_id FROM top))
    SELECT doc_id, score FROM ranked ORDER BY a, b, c LIMIT 8""",
    "intents": """SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN 'error' WHEN 1 THEN 'risk' WHEN 2 THEN 'dependency' WHEN 3 THEN 'entry' WHEN 4 THEN 'complexity' ELSE 'general' END AS intents
      FROM conversations""",
    "last_n_history": "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 6",
    "confidence_parse": r"""SELECT conv_id, turn, CASE WHEN regexp_matches(a, '[Cc]onfidence:\s*(\d{1,3})\s*%') THEN least(regexp_extract(a, '[Cc]onfidence:\s*(\d{1,3})\s*%', 1)::INT, 100) END AS confidence,
      length(regexp_replace(regexp_replace(a, '\n?[Cc]onfidence:\s*\d{1,3}\s*%\s*$', ''), '\s+$', ''))::INT AS stripped
      FROM (SELECT conv_id, turn, text || chr(10) || 'Confidence: ' || (turn * 40) || CASE WHEN turn % 3 = 2 THEN '' ELSE '%' END AS a FROM conversations)""",
    "token_estimate": "SELECT conv_id, (sum(length(text)) + 500)::BIGINT // 4 AS tokens FROM conversations GROUP BY 1",
    "snippet_truncate": "SELECT doc_id, CASE WHEN length(text) > 800 THEN left(text, 800) || chr(10) || '… (truncated)' ELSE text END AS snippet FROM documents",
    "bytes_humanised": """SELECT doc_id, CASE WHEN n_chars = 0 THEN '0 B' WHEN n_chars < 1024 THEN printf('%.1f B', n_chars::DOUBLE)
      WHEN n_chars < 1048576 THEN printf('%.1f KB', floor(n_chars / 1024 * 10 + 0.5) / 10) ELSE printf('%.1f MB', floor(n_chars / 1048576 * 10 + 0.5) / 10) END AS size FROM documents""",
    "structure_edges": f"""WITH {TREE} SELECT parent AS source, id AS target, 'structure' AS type FROM hung""",
    "capped_nodes": f"""WITH {TREE}, counted AS (SELECT id, type, (SELECT count(*) FROM hung h WHERE h.id = n.id) AS n_in FROM tree n)
      SELECT * FROM counted WHERE type <> 'file' UNION ALL SELECT * FROM (SELECT * FROM counted WHERE type = 'file' ORDER BY n_in DESC, id LIMIT 20)""",
    "collapsed_hidden": f"""SELECT page_id FROM (SELECT page_id, string_split(regexp_replace({PATH}, '^[^/]+/', ''), '/') AS p FROM pages) WHERE NOT (len(p) > 1 AND p[1] IN ('en', 'de'))""",
    "path_search": "SELECT page_id FROM pages WHERE contains(lower(url), 'example.org/en')",
    "execution_console": """SELECT CASE WHEN event_type = 'error' THEN 'ERROR' WHEN user_id % 7 = 0 THEN 'WARNING' WHEN user_id % 3 <> 0 AND value < 1.0 THEN 'ERROR' ELSE 'INFO' END AS level,
      event_id::VARCHAR AS file, CASE WHEN event_type = 'error' THEN 'Compile failed — error' WHEN user_id % 7 = 0 THEN 'Execution timed out after 3s'
      WHEN user_id % 3 <> 0 AND value < 1.0 THEN 'Runtime error — ' || event_type ELSE 'Compile check passed' END AS message, CASE WHEN event_type = 'error' THEN 1 END AS line FROM events""",
    "node_sizes": f"""WITH RECURSIVE {TRADE}, {CENTRALITY} SELECT node, round(350 + centrality / coalesce(nullif(max(centrality) OVER (), 0), 1) * 1800, 3) AS size FROM central""",
    "confidence_bands": "SELECT conv_id, turn, CASE WHEN turn * 15 >= 80 THEN 'green' WHEN turn * 15 >= 50 THEN 'yellow' ELSE 'red' END AS band FROM conversations",
    "complexity_shares": f"""SELECT doc_id, round(score * 100 / greatest(max(score) OVER (), 1), 1) AS share FROM ({SCORES})""",
    "complexity_counts": f"SELECT count_if(score > 15) AS high, count_if(score > 5 AND score <= 15) AS medium, count_if(score <= 5) AS low FROM ({SCORES})",
    "file_nodes": r"""SELECT source || '/' || doc_id AS id, lang AS language, CASE WHEN n_chars > 3000 THEN 'high' WHEN lang <> 'fr' THEN 'medium' ELSE 'low' END AS risk,
      (len(string_split(t, chr(10))) - CASE WHEN t = '' OR t LIKE '%' || chr(10) THEN 1 ELSE 0 END)::INT AS lines, CASE WHEN lang <> 'fr' THEN 'medium' END AS complexity_level,
      lang = 'de' AS is_entry, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS is_circular
      FROM (SELECT *, regexp_replace(text, '\r\n?', chr(10), 'g') AS t FROM documents)""",
    "script_facts": """SELECT p_partkey, 'scope' || p_partkey || ',./p' || p_partkey || ',lib,dyn' AS js_imports, 'f' || p_partkey || ',g' || p_partkey AS js_functions,
'com' AS java_imports, 'm' || p_partkey AS java_functions FROM part""",
    "error_classes": """WITH e AS (SELECT event_id, user_id % 5 AS u, 400 + event_id % 30 AS code FROM events)
SELECT event_id, CASE WHEN u = 4 OR code = 401 THEN 'auth' WHEN u = 0 OR code = 429 THEN 'rate_limit' WHEN u = 1 OR code = 404 THEN 'model' WHEN u = 2 THEN 'connection' ELSE 'other' END AS kind FROM e""",
    "language_shares": """SELECT lang AS language, count(*) AS n, round(count(*) * 100 / (SELECT count(*) FROM documents), 1) AS share, (SELECT count(*) FROM documents) AS total_files,
(SELECT sum(n_chars) FROM documents)::BIGINT AS total_size FROM documents GROUP BY lang""",
    "answer_parts": """SELECT conv_id, turn, split_part(text, chr(10), 1) || ' ' AS content, turn / 8 AS confidence FROM conversations WHERE text IS NOT NULL""",
    "relevance_by_intent": f"""WITH {ISSUES}, {PIVOT}, rows AS (SELECT d.*, coalesce(weight, 0) AS w, least(n_chars, 20000) / 20000 AS risk, doc_id % 10 / 10 AS central
      FROM documents d LEFT JOIN pivoted ON file = doc_id), i AS (SELECT unnest(['error', 'risk', 'dependency', 'entry', 'complexity', 'unused', 'general']) AS intent)
    SELECT doc_id, intent, round(CASE intent WHEN 'error' THEN w * 5.0::DOUBLE + CASE WHEN lang = 'de' THEN 8 ELSE 0 END WHEN 'risk' THEN risk * 15
      WHEN 'dependency' THEN CASE WHEN lang = 'fr' THEN 10 ELSE 0 END + doc_id % 5 * 0.5::DOUBLE + doc_id % 3 * 0.3::DOUBLE WHEN 'entry' THEN CASE WHEN lang = 'es' THEN 12 ELSE 0 END
      WHEN 'complexity' THEN n_chars % 100 * 0.2::DOUBLE WHEN 'unused' THEN doc_id % 2 * 4 ELSE 0 END + risk * 3 + central * 5, 6) AS score FROM rows, i""",
    "legend": "SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL",
    "graph_counts": f"""WITH RECURSIVE {TRADE}, {WALKS} SELECT (SELECT count(*) FROM nation) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, count(*) AS n_cycles,
      (SELECT count(DISTINCT m) FROM (SELECT unnest(members) AS m FROM loops)) AS n_on_cycles FROM loops""",
    "cycle_texts": f"""WITH RECURSIVE {TRADE}, {WALKS}, texts AS (SELECT members, list_aggregate(list_append(members, members[1]), 'string_agg', ' → ') AS t FROM loops)
      SELECT unnest(members)::VARCHAR AS file, 'Circular dependency: ' || t AS message, 'high' AS severity, len(members)::INT AS length FROM texts""",
    "partner_lines": """WITH p AS (SELECT DISTINCT a.n_name AS source, b.n_name AS target FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
      JOIN supplier ON s_suppkey = l_suppkey JOIN nation a ON a.n_nationkey = s_nationkey JOIN nation b ON b.n_nationkey = c_nationkey),
    d AS (SELECT source, count(*) AS n, array_to_string(list(target ORDER BY target)[1:4], ', ') AS t FROM p GROUP BY source)
    SELECT n_name AS rel_path, '  ' || CASE WHEN n_regionkey = 0 THEN '↺' ELSE '·' END || ' ' || n_name || ' (region ' || n_regionkey || ')'
      || CASE WHEN n > 0 THEN '  → ' || t || CASE WHEN n > 4 THEN ' +' || (n - 4) ELSE '' END ELSE '' END AS line FROM nation LEFT JOIN d ON source = n_name""",
    "first_entries": """SELECT (SELECT string_agg(p_name, ',' ORDER BY p_partkey) FROM (SELECT * FROM part WHERE p_size < 10 ORDER BY p_partkey LIMIT 6)) AS small,
      (SELECT string_agg(p_name, ',' ORDER BY p_retailprice DESC, p_partkey) FROM (SELECT * FROM part WHERE p_size >= 10 ORDER BY p_retailprice DESC, p_partkey LIMIT 5)) AS dear""",
}
