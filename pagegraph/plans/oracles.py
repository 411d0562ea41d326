"""The same rules as SQL, as named steps; ``sql`` puts the steps that a query needs before it."""

from __future__ import annotations

import re

STEPS = {
    "doc_pages": "SELECT doc_id, unnest(range(1, greatest(1, (coalesce(length(text), 0) + 1599) // 1600) + 1))::INT AS page_number FROM documents",
    "body_glyphs": """SELECT doc_id, (g // 1600 + 1)::INT AS page_number, g AS seq, ch AS text, CASE WHEN g // 40 = 0 THEN 16.0 ELSE 10.0 END::DOUBLE AS size,
        (50 + 260 * ((g // 800) % 2) + 5 * (g % 40))::DOUBLE AS x0, (60 + 14 * ((g // 40) % 20) + 3 * least(1, ((g // 40) % 20) // 5) + 30 * (((g // 40) % 20) // 10))::DOUBLE AS top, false AS turned
        FROM (SELECT doc_id, unnest(string_split(t, '')) AS ch, unnest(range(0, length(t))) AS g FROM (SELECT doc_id, translate(coalesce(text, ''), chr(10), ' ') AS t FROM documents)) WHERE ch <> ' '""",
    "extra_glyphs": """SELECT doc_id, page_number, base + k AS seq, substr(s, k::INT, 1) AS text, size::DOUBLE AS size, (CASE kind WHEN 'side' THEN 580 ELSE 50 + 5 * k END)::DOUBLE AS x0,
        (CASE kind WHEN 'head' THEN 45 WHEN 'foot' THEN 770 ELSE 300 + 5 * k END)::DOUBLE AS top, kind = 'side' AS turned
        FROM (SELECT *, unnest(range(1, length(s) + 1)) AS k FROM (SELECT doc_id, page_number, 'head' AS kind, 'Confidential ' || page_number AS s, 8.0 AS size, 1000000000 AS base FROM doc_pages
            UNION ALL SELECT doc_id, page_number, 'foot', 'Page ' || page_number, 8.0, 2000000000 FROM doc_pages UNION ALL SELECT doc_id, page_number, 'side', 'Side', 9.0, 3000000000 FROM doc_pages WHERE doc_id % 10 = 0)) WHERE substr(s, k::INT, 1) <> ' '""",
    "glyphs": "SELECT *, x0 + 4.5 AS x1, top + size AS bottom, 4.5::DOUBLE AS width, 612.0::DOUBLE AS page_width, 792.0::DOUBLE AS page_height FROM (SELECT * FROM body_glyphs UNION ALL SELECT * FROM extra_glyphs)",
    "safe_glyphs": "SELECT *, CASE WHEN turned THEN round(degrees(atan2(1.0, 0.0)), 1) ELSE 0.0 END::DOUBLE AS angle FROM glyphs WHERE top > 0.05 * page_height AND top < 0.95 * page_height",
    "norm_glyphs": """SELECT *, CASE WHEN angle = 0 THEN x0 ELSE nx - width / 2 END AS nx0, CASE WHEN angle = 0 THEN x1 ELSE nx + width / 2 END AS nx1,
        CASE WHEN angle = 0 THEN top ELSE ny - abs(bottom - top) / 2 END AS ntop, CASE WHEN angle = 0 THEN bottom ELSE ny + abs(bottom - top) / 2 END AS nbottom
        FROM (SELECT *, (x0 + x1) / 2 * cos(radians(-angle)) - (top + bottom) / 2 * sin(radians(-angle)) AS nx, (x0 + x1) / 2 * sin(radians(-angle)) + (top + bottom) / 2 * cos(radians(-angle)) AS ny FROM safe_glyphs)""",
    "kept_glyphs": "SELECT * FROM norm_glyphs g WHERE NOT EXISTS (SELECT 1 FROM layout_boxes b WHERE b.doc_id = g.doc_id AND b.page_number = g.page_number AND g.x0 BETWEEN b.x0 AND b.x1 AND g.top >= b.top AND g.bottom <= b.bottom)",
    "layout_boxes": "SELECT doc_id, page_number, 300.0 AS x0, 200.0 AS top, 420.0 AS x1, 260.0 AS bottom FROM doc_pages WHERE page_number % 2 = 0",
    "size_counts": "SELECT doc_id, page_number, angle, round(size, 1) AS s, count(*) AS c, min(seq) AS f FROM kept_glyphs GROUP BY ALL",
    "page_modes": "SELECT doc_id, page_number, angle, s AS mode_size FROM size_counts QUALIFY row_number() OVER (PARTITION BY doc_id, page_number, angle ORDER BY c DESC, f) = 1",
    "metrics": """SELECT k.doc_id, k.page_number, k.angle, any_value(mode_size) AS mode_size, avg(abs(bottom - top)) AS avg_height, coalesce(stddev_samp(round(size, 1)), 0) AS sd_size, count(*) AS n_glyphs, min(seq) AS first_seq
        FROM kept_glyphs k JOIN page_modes m ON m.doc_id = k.doc_id AND m.page_number = k.page_number AND m.angle = k.angle GROUP BY ALL""",
    "thresholds": "SELECT *, CASE WHEN sd_size > 0.5 THEN mode_size + 1.3 * sd_size ELSE mode_size * 1.15 END AS heading_threshold FROM metrics",
    "histogram": """SELECT b.doc_id, b.page_number, b.x, count(g.x0) AS n FROM (SELECT doc_id, page_number, unnest(range(0, 612)) AS x FROM (SELECT DISTINCT doc_id, page_number FROM safe_glyphs)) b
        LEFT JOIN (SELECT doc_id, page_number, x0, unnest(range(greatest(0, trunc(x0)::INT), least(612, trunc(x1)::INT + 1))) AS x FROM safe_glyphs) g ON g.doc_id = b.doc_id AND g.page_number = b.page_number AND g.x = b.x GROUP BY ALL""",
    "smooth": "SELECT *, avg(n) OVER (PARTITION BY doc_id, page_number ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM histogram",
    "gutter_runs": "SELECT doc_id, page_number, min(x) AS g0, max(x) + 1 AS g1 FROM (SELECT *, x - row_number() OVER (PARTITION BY doc_id, page_number ORDER BY x) AS k FROM smooth WHERE v < 0.1) GROUP BY doc_id, page_number, k",
    "gutters": "SELECT r.* FROM gutter_runs r JOIN (SELECT doc_id, page_number, avg(x1 - x0) AS w FROM safe_glyphs GROUP BY ALL) a USING (doc_id, page_number) WHERE g1 < 612 AND g1 - g0 > 2 * w",
    "line_glyphs": """SELECT *, sum(brk) OVER (PARTITION BY doc_id, page_number, angle ORDER BY ntop, nx0, seq) AS line FROM (SELECT k.*, avg_height, heading_threshold, first_seq,
        CASE WHEN abs(ntop - lag(ntop) OVER (PARTITION BY k.doc_id, k.page_number, k.angle ORDER BY ntop, nx0, seq)) < 0.3 * avg_height THEN 0 ELSE 1 END AS brk
        FROM kept_glyphs k JOIN thresholds t ON t.doc_id = k.doc_id AND t.page_number = k.page_number AND t.angle = k.angle)""",
    "line_boxes": "SELECT doc_id, page_number, angle, line, min(ntop) AS lt, max(nbottom) AS lb, any_value(avg_height) AS h, count(*) AS n FROM line_glyphs GROUP BY ALL",
    "line_slices": """SELECT *, sum(brk) OVER (PARTITION BY doc_id, page_number, angle ORDER BY line) AS slice FROM (SELECT *, CASE WHEN lt - lag(lb) OVER (PARTITION BY doc_id, page_number, angle ORDER BY line) < 1.3 * h THEN 0 ELSE 1 END AS brk FROM line_boxes)""",
    "slice_glyphs": "SELECT g.*, s.slice FROM line_glyphs g JOIN line_slices s ON s.doc_id = g.doc_id AND s.page_number = g.page_number AND s.angle = g.angle AND s.line = g.line",
    "slice_boxes": "SELECT doc_id, page_number, angle, slice, min(nx0) AS a, max(nx1) AS b, count(*) AS n FROM slice_glyphs GROUP BY ALL",
    "central": "SELECT s.*, min(g0) AS g0, arg_min(g1, g0) AS g1 FROM slice_boxes s JOIN gutters g ON g.doc_id = s.doc_id AND g.page_number = s.page_number AND a < g0 AND g1 < b AND g0 < a + (b - a) / 2 AND a + (b - a) / 2 < g1 GROUP BY ALL",
    "column_glyphs": """SELECT * FROM (SELECT g.*, CASE WHEN c.g0 IS NULL THEN 0 WHEN g.nx1 <= c.g0 THEN 1 WHEN g.nx0 >= c.g1 THEN 2 END AS column_id FROM slice_glyphs g
        LEFT JOIN central c ON c.doc_id = g.doc_id AND c.page_number = g.page_number AND c.angle = g.angle AND c.slice = g.slice) WHERE column_id IS NOT NULL""",
    "block_glyphs": """SELECT *, sum(opens) OVER w AS block, CASE WHEN opens = 0 AND abs(ntop - p_top) < 0.4 * size AND nx0 - p_x1 > 0.16 * size THEN ' ' || text ELSE text END AS piece, row_number() OVER w AS rank
        FROM (SELECT *, CASE WHEN p_top IS NULL OR ntop - p_bottom > 0.5 * p_size OR abs(size - p_size) > 1.5 THEN 1 ELSE 0 END AS opens
        FROM (SELECT *, lag(ntop) OVER w AS p_top, lag(nbottom) OVER w AS p_bottom, lag(size) OVER w AS p_size, lag(nx1) OVER w AS p_x1 FROM column_glyphs WINDOW w AS (PARTITION BY doc_id, page_number, angle, slice, column_id ORDER BY ntop, nx0, seq)))
        WINDOW w AS (PARTITION BY doc_id, page_number, angle, slice, column_id ORDER BY ntop, nx0, seq)""",
    "blocks": """SELECT doc_id, page_number, angle, slice, column_id, block, trim(string_agg(piece, '' ORDER BY rank)) AS text, avg(size) AS font_size, CASE WHEN avg(size) >= any_value(heading_threshold) THEN 'heading' ELSE 'paragraph' END AS type,
        min(first_seq) AS first_seq, min(x0) AS x0, min(top) AS top, max(x1) AS x1, max(bottom) AS bottom, min(ntop) AS ntop, max(nbottom) AS nbottom FROM block_glyphs GROUP BY ALL""",
    "merge_runs": """SELECT b.doc_id, b.page_number, b.angle, b.slice, b.column_id, b.block, 1::HUGEINT AS run, b.font_size AS head, b.nbottom AS tail, b.type FROM blocks b WHERE block = 1
        UNION ALL SELECT b.doc_id, b.page_number, b.angle, b.slice, b.column_id, b.block, CASE WHEN ok THEN run ELSE run + 1 END, CASE WHEN ok THEN head ELSE b.font_size END, b.nbottom, b.type
        FROM (SELECT b.*, r.run, r.head, b.type = r.type AND abs(b.ntop - r.tail) < 0.8 * r.head AS ok FROM merge_runs r JOIN blocks b ON b.doc_id = r.doc_id AND b.page_number = r.page_number AND b.angle = r.angle AND b.slice = r.slice AND b.column_id = r.column_id AND b.block = r.block + 1) b""",
    "merged": """SELECT b.doc_id, b.page_number, b.angle, b.slice, b.column_id, r.run, min(b.block) AS block, replace(string_agg(b.text, chr(1) ORDER BY b.block), chr(1), ' ') AS text, any_value(b.type) AS type, arg_min(b.font_size, b.block) AS font_size,
        min(b.x0) AS x0, min(b.top) AS top, max(b.x1) AS x1, max(b.bottom) AS bottom, arg_min(b.top, b.block) AS head_top, min(b.first_seq) AS first_seq
        FROM blocks b JOIN merge_runs r ON b.doc_id = r.doc_id AND b.page_number = r.page_number AND b.angle = r.angle AND b.slice = r.slice AND b.column_id = r.column_id AND b.block = r.block GROUP BY b.doc_id, b.page_number, b.angle, b.slice, b.column_id, r.run""",
    "ordered": "SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY CASE WHEN column_id = 0 THEN 999 ELSE column_id END, head_top, first_seq, slice, column_id, block) AS ord FROM merged",
    "li": "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS seq FROM lineitem",
    "shapes": """SELECT l_orderkey AS doc_id, 1 AS page_number, seq, 8 * l_quantity AS x0, (l_partkey % 700)::DOUBLE AS top, 8 * l_quantity + 10 + l_suppkey % 60 AS x1, (l_partkey % 700 + 10 + 15 * l_linenumber)::DOUBLE AS bottom, CASE WHEN seq % 2 = 1 THEN 'xobject' ELSE 'vector' END AS tag FROM li
        UNION ALL SELECT DISTINCT l_orderkey, 1, 1000, 0.0, 45.0, 612.0, 790.0, 'xobject' FROM lineitem WHERE l_orderkey % 50 = 0""",
    "tabs": """SELECT l_orderkey AS doc_id, list_concat([['part', 'supp', 'qty', 'flag']], list([l_partkey::VARCHAR, l_suppkey::VARCHAR, CASE WHEN l_discount = 0 THEN '' ELSE l_quantity::INT::VARCHAR END, l_returnflag] ORDER BY seq)) AS data FROM li GROUP BY 1
        UNION ALL SELECT p_size + 1000000000, list([p_name, p_brand] ORDER BY p_partkey) FROM part GROUP BY 1""",
    "item_lines": "SELECT doc_id, unnest(range(0, len(s))) AS l, unnest(s) AS text FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)",
    "item_pages": "SELECT DISTINCT doc_id, (l // 6 + 1)::INT AS page_number FROM item_lines",
    "items": """SELECT doc_id, (l // 6 + 1)::INT AS page_number, (l % 6 + 1)::INT AS ord, CASE WHEN l % 5 = 4 THEN 'image' WHEN l % 4 = 0 THEN 'heading' ELSE 'paragraph' END AS type, CASE WHEN l % 5 = 4 THEN NULL ELSE text END AS text,
        CASE WHEN l % 5 = 4 THEN NULL WHEN l % 4 = 0 THEN 16 - (l % 7) * 0.25 ELSE 10 + (l % 3) * 0.25 END::DOUBLE AS font_size, (50 + 260 * (l % 2))::DOUBLE AS x0, (60 + 30 * (l % 6))::DOUBLE AS top, (290 + 260 * (l % 2))::DOUBLE AS x1, (80 + 30 * (l % 6))::DOUBLE AS bottom,
        CASE WHEN l % 5 = 4 THEN 'Image_Cluster_p' || (l // 6 + 1) || '_' || l END AS metadata FROM item_lines
        UNION ALL SELECT doc_id, page_number, 0, 'paragraph', 'Confidential ' || page_number, 8.0, 50.0, 40.0, 200.0, 52.0, NULL FROM item_pages
        UNION ALL SELECT doc_id, page_number, 10, 'paragraph', 'See Figure ' || (5 * page_number + 4), 10.0, 50.0, 250.0, 290.0, 262.0, NULL FROM item_pages WHERE page_number % 2 = 1""",
    "normed": "SELECT *, regexp_replace(regexp_replace(coalesce(text, ''), '\\p{Nd}+', '', 'g'), '^\\s+|\\s+$', '', 'g') AS zone FROM items",
    "zones": "SELECT z.doc_id, zone, n FROM (SELECT doc_id, zone, count(*) AS n FROM normed WHERE type <> 'image' AND length(zone) BETWEEN 1 AND 99 GROUP BY ALL) z JOIN (SELECT doc_id, count(*) AS p FROM item_pages GROUP BY 1) p ON p.doc_id = z.doc_id WHERE p >= 3 AND n >= 0.8 * p",
    "doc_sizes": "SELECT doc_id, font_size, count(*) AS c, min((page_number, ord)) AS f FROM items WHERE type <> 'image' GROUP BY ALL",
    "doc_high": "SELECT m.doc_id, mode_size + 1.5 * coalesce(sd, 0) AS threshold FROM (SELECT doc_id, font_size AS mode_size FROM doc_sizes QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, f) = 1) m JOIN (SELECT doc_id, stddev_samp(font_size) AS sd FROM items WHERE type <> 'image' GROUP BY 1) s USING (doc_id)",
    "typed": "SELECT i.*, CASE WHEN type <> 'image' AND (type = 'heading' OR coalesce(font_size, 0) >= threshold) THEN 'heading' ELSE type END AS node_type FROM items i JOIN doc_high USING (doc_id)",
    "heads": "SELECT doc_id, page_number, ord, coalesce(font_size, 0) AS f, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY ord) AS k FROM typed WHERE node_type = 'heading'",
    "stack": """SELECT doc_id, page_number, k, ord, NULL::INT AS parent_ord, [ord] AS os, [f] AS fs FROM heads WHERE k = 1
        UNION ALL SELECT doc_id, page_number, k, ord, os[p], list_append(os[1:p], ord), list_append(fs[1:p], f) FROM (SELECT h.doc_id, h.page_number, h.k, h.ord, h.f, s.os, s.fs,
            coalesce(list_max(list_transform(range(1, len(s.fs) + 1), lambda j: CASE WHEN h.f < s.fs[j] - 0.5 THEN j ELSE 0 END)), 0) AS p FROM stack s JOIN heads h ON h.doc_id = s.doc_id AND h.page_number = s.page_number AND h.k = s.k + 1)""",
    "bodies": "SELECT * FROM (SELECT doc_id, page_number, ord, node_type, last_value(CASE WHEN node_type = 'heading' THEN ord END IGNORE NULLS) OVER (PARTITION BY doc_id, page_number ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent_ord FROM typed) WHERE node_type <> 'heading'",
    "node_text": "SELECT *, coalesce(text, '') AS raw, CASE WHEN node_type = 'paragraph' THEN regexp_replace(coalesce(text, ''), '([\\p{L}\\p{N}_]+)-\\s*\\n\\s*([\\p{L}\\p{N}_]+)', '\\1\\2', 'g') ELSE coalesce(text, '') END AS healed FROM typed",
    "nodes": """SELECT doc_id, node_type || '_' || substr(sha256(doc_id || '/' || page_number || '/' || ord), 1, 16) AS node_id, node_type AS t, CASE WHEN raw = '' THEN '[' || type || ']' WHEN healed <> raw THEN healed ELSE substr(raw, 1, 5000) END AS c,
        page_number, ord, NULL::INT AS num, font_size, round_even(x0, 0)::INT AS b0, round_even(top, 0)::INT AS b1, round_even(x1, 0)::INT AS b2, round_even(bottom, 0)::INT AS b3 FROM node_text
        UNION ALL SELECT doc_id, 'page_' || substr(sha256(doc_id || '/' || page_number), 1, 16), 'page', 'Page ' || page_number, page_number, 0, page_number, NULL, NULL, NULL, NULL, NULL FROM item_pages
        UNION ALL SELECT DISTINCT doc_id, 'root_' || substr(sha256(doc_id::VARCHAR), 1, 16), 'root', 'Document', 0, 0, NULL, NULL, NULL, NULL, NULL, NULL FROM item_pages""",
    "own_edges": "SELECT doc_id, page_number, ord, parent_ord, 'contains' AS r, 'heading' AS node_type FROM stack UNION ALL SELECT doc_id, page_number, ord, parent_ord, 'body_text', node_type FROM bodies",
    "edges": """SELECT doc_id, page_number, ord, CASE WHEN parent_ord IS NULL THEN 'page_' || substr(sha256(doc_id || '/' || page_number), 1, 16) ELSE 'heading_' || substr(sha256(doc_id || '/' || page_number || '/' || parent_ord), 1, 16) END AS f,
        node_type || '_' || substr(sha256(doc_id || '/' || page_number || '/' || ord), 1, 16) AS t, r FROM own_edges
        UNION ALL SELECT doc_id, page_number, 0, 'root_' || substr(sha256(doc_id::VARCHAR), 1, 16), 'page_' || substr(sha256(doc_id || '/' || page_number), 1, 16), 'contains' FROM item_pages""",
    "tree": """SELECT doc_id, node_id, t, c, []::STRUCT(top INT, page INT, ord INT)[] AS path, 0 AS level FROM nodes WHERE t = 'root'
        UNION ALL SELECT n.doc_id, n.node_id, n.t, n.c, list_append(path, {'top': coalesce(b1, 0), 'page': e.page_number, 'ord': e.ord}), level + 1 FROM tree p JOIN edges e ON e.doc_id = p.doc_id AND e.f = p.node_id JOIN nodes n ON n.doc_id = e.doc_id AND n.node_id = e.t""",
    "g_nodes": """SELECT 'r' || r_regionkey AS node_id, 'page' AS t, r_name AS c FROM region UNION ALL SELECT 'n' || n_nationkey, 'heading', n_name FROM nation UNION ALL SELECT 'c' || c_custkey, 'paragraph', c_name FROM customer UNION ALL SELECT 'root', 'root', 'Document'""",
    "g_edges": """SELECT 'root' AS f, 'r' || r_regionkey AS t, 'contains' AS r FROM region UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, 'contains' FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'body_text' FROM customer WHERE c_custkey % 50 <> 0""",
    "heal_pages": """SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page_number, o_orderkey % 3 <> 0 AS single, o_orderkey % 5 <> 0 AS first_is_table,
        CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 2 = 0 ELSE o_orderkey % 5 <> 0 END AS last_is_table, o_orderkey % 7 = 0 AS cols, o_orderkey % 2 AS header, 2 + o_orderkey % 4 AS n FROM orders""",
    "heal_pairs": """SELECT a.doc_id, a.page_number, a.single, a.n + b.n - CASE WHEN a.header = b.header THEN 1 ELSE 0 END AS n_rows, a.header = b.header AS header_dropped, coalesce(a.last_is_table AND b.first_is_table AND a.cols = b.cols, false) AS c
        FROM heal_pages a LEFT JOIN heal_pages b ON b.doc_id = a.doc_id AND b.page_number = a.page_number + 1""",
    "heal_walk": """SELECT *, c AS merged FROM heal_pairs WHERE page_number = 1
        UNION ALL SELECT p.*, p.c AND NOT (p.single AND w.merged) FROM heal_walk w JOIN heal_pairs p ON p.doc_id = w.doc_id AND p.page_number = w.page_number + 1""",
}


def sql(query: str) -> str:
    """``query`` with the steps that it and they refer to, in order."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in sorted(set(re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", text))):
            if name in STEPS and name not in need and name not in seen:
                seen.add(name)
                visit(STEPS[name])
                need.append(name)

    seen: set[str] = set()
    visit(query)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({STEPS[n]})" for n in need) + f"\n{query}" if need else query
