"""Graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions.numeric import r6
from corvane.operators import graph
from corvane.queries.registry import query
from corvane.queries.views import Tables

BASE = "https://example.org/abs/"
ROUNDS = 5


def rounds_sql(rounds: int = ROUNDS) -> str:
    """CTEs r0..rn and ``ranks``: the iteration unrolled."""
    steps = ["outdeg AS MATERIALIZED (SELECT src, count(*) AS od FROM clean_edges GROUP BY src)",
             "r0 AS MATERIALIZED (SELECT id, CAST(1.0 AS DOUBLE) AS rank FROM vertices)"]
    for i in range(rounds):
        steps.append(f"""r{i + 1} AS MATERIALIZED (
            SELECT v.id, 0.15 + 0.85 * coalesce(g.s, 0) AS rank FROM vertices v LEFT JOIN (
              SELECT e.dst, sum(r.rank / o.od) AS s FROM clean_edges e JOIN r{i} r ON r.id = e.src
              JOIN outdeg o ON o.src = e.src GROUP BY e.dst) g ON g.dst = v.id)""")
    steps.append(f"""ranks AS MATERIALIZED (
        SELECT id, rank * (SELECT count(*) / sum(rank) FROM r{rounds}) AS rank FROM r{rounds})""")
    return ", ".join(steps)


def rank_sql(tolerance: float = 1e-4) -> str:
    """CTEs ``rounds`` and ``ranks``: rounds until no rank moves by ``tolerance`` or more."""
    return f"""outdeg AS MATERIALIZED (SELECT src, count(*) AS od FROM clean_edges GROUP BY src),
        rounds(i, id, rank, old) AS (
          SELECT 0, id, CAST(1.0 AS DOUBLE), CAST(1000.0 AS DOUBLE) FROM vertices
          UNION ALL
          SELECT v.i + 1, v.id, 0.15 + 0.85 * coalesce(g.s, 0), v.rank FROM rounds v LEFT JOIN (
            SELECT e.dst, sum(r.rank / o.od) AS s FROM clean_edges e JOIN rounds r ON r.id = e.src
            JOIN outdeg o ON o.src = e.src GROUP BY e.dst) g ON g.dst = v.id
          WHERE (SELECT max(abs(rank - old)) FROM rounds) >= {tolerance}),
        settled AS MATERIALIZED (SELECT id, rank FROM rounds WHERE i = (SELECT max(i) FROM rounds)),
        ranks AS MATERIALIZED (SELECT id, rank * (SELECT count(*) / sum(rank) FROM settled) AS rank FROM settled)"""


def label_sql(rounds: int = 5, edges: str = "sym_edges", ids: str = "vertices") -> str:
    steps = [f"l0 AS MATERIALIZED (SELECT id, id AS label FROM {ids})"]
    for i in range(rounds):
        steps.append(f"""l{i + 1} AS MATERIALIZED (
            SELECT p.id, coalesce(b.label, p.label) AS label FROM l{i} p LEFT JOIN (
              SELECT dst, label FROM (
                SELECT e.dst, l.label, row_number() OVER (PARTITION BY e.dst ORDER BY count(*) DESC, l.label) AS rn
                FROM {edges} e JOIN l{i} l ON l.id = e.src GROUP BY e.dst, l.label) WHERE rn = 1) b ON b.dst = p.id)""")
    steps.append(f"labels AS MATERIALIZED (SELECT * FROM l{rounds})")
    return ", ".join(steps).replace("labels AS", "comm AS")


def core_sql(edges: str, k: int, rounds: int = 8) -> str:
    """CTEs k0..kn of symmetric edges after repeated pruning."""
    steps = [f"k0 AS MATERIALIZED (SELECT src, dst FROM {edges} UNION SELECT dst, src FROM {edges})"]
    for i in range(rounds):
        steps.append(f"""k{i + 1} AS MATERIALIZED (
            SELECT src, dst FROM k{i} WHERE src IN (SELECT src FROM k{i} GROUP BY src HAVING count(*) >= {k})
              AND dst IN (SELECT src FROM k{i} GROUP BY src HAVING count(*) >= {k}))""")
    steps.append(f"core AS MATERIALIZED (SELECT DISTINCT src AS id FROM k{rounds})")
    return ", ".join(steps)


def top_sql(n: int) -> str:
    return f"""top AS MATERIALIZED (SELECT id, rank FROM ranks ORDER BY round(rank, 9) DESC, id LIMIT {n}),
        inside AS MATERIALIZED (SELECT src, dst FROM clean_edges WHERE src IN (SELECT id FROM top)
                                AND dst IN (SELECT id FROM top))"""


IN_LABEL = "concat(t.id, ' (in=', coalesce(i.d, 0), ')')"


def attributes_sql(nodes: str, edges: str, extra: str = "", label: str = IN_LABEL) -> str:
    return f"""SELECT t.id, round(t.rank, 6) AS rank, {extra} CAST(coalesce(i.d, 0) AS BIGINT) AS in_degree,
        CAST(coalesce(o.d, 0) AS BIGINT) AS out_degree, CAST(coalesce(c.label, -1) AS BIGINT) AS community,
        {label} AS viz_label, concat('{BASE}', t.id) AS url
      FROM {nodes} t LEFT JOIN (SELECT dst, count(*) AS d FROM {edges} GROUP BY dst) i ON i.dst = t.id
      LEFT JOIN (SELECT src, count(*) AS d FROM {edges} GROUP BY src) o ON o.src = t.id
      LEFT JOIN comm c ON c.id = t.id"""


def links_of(t: Tables):
    """Distinct citations, written once for queries that analyse them in several ways."""
    return graph.distinct_links(t.citations())


@query("G01_vertices", "SELECT id FROM vertices")
def _(t):
    return graph.vertices(t.citations())


@query("G01_numbered_vertices", """
    SELECT id, CAST(row_number() OVER (ORDER BY id) - 1 AS BIGINT) AS vid
    FROM (SELECT src AS id FROM order_links UNION SELECT dst FROM order_links)""")
def _(t):
    return graph.numbered_vertices(t.order_links())


@query("J08_numbered_edges", """
    WITH n AS (SELECT id, CAST(row_number() OVER (ORDER BY id) - 1 AS BIGINT) AS vid FROM vertices)
    SELECT a.vid AS src_vid, b.vid AS dst_vid FROM citations c JOIN n a ON a.id = c.src JOIN n b ON b.id = c.dst""")
def _(t):
    return graph.numbered_edges(t.citations(), graph.numbered_vertices(t.citations()))


@query("G02_clean_edges", "SELECT src, dst FROM clean_edges")
def _(t):
    return graph.clean_edges(t.citations())


@query("G03_symmetric_edges", "SELECT src, dst FROM sym_edges")
def _(t):
    return graph.symmetric(t.citations())


@query("G04_graph_size", """
    SELECT CAST((SELECT count(*) FROM vertices) AS BIGINT) AS n_vertices, CAST(count(*) AS BIGINT) AS n_edges FROM clean_edges""")
def _(t):
    return graph.graph_size(t.citations())


@query("G05_top_degrees", """
    (SELECT 'out' AS kind, src AS id, CAST(count(*) AS BIGINT) AS degree FROM clean_edges GROUP BY src ORDER BY degree DESC, id LIMIT 20)
    UNION ALL
    (SELECT 'in', dst AS id, CAST(count(*) AS BIGINT) AS degree FROM clean_edges GROUP BY dst ORDER BY degree DESC, id LIMIT 20)""")
def _(t):
    edges = graph.clean_edges(t.citations())
    out = graph.top_degrees(edges, "src").select(F.lit("out").alias("kind"), "id", "degree")
    return out.union(graph.top_degrees(edges, "dst").select(F.lit("in"), "id", "degree"))


DEGREE_SQL = """SELECT CAST(d AS BIGINT) AS degree, CAST(count(*) AS BIGINT) AS n
    FROM (SELECT dst, count(*) AS d FROM clean_edges GROUP BY dst) GROUP BY d"""


@query("A26_in_degree_distribution", DEGREE_SQL)
def _(t):
    return graph.degree_distribution(graph.clean_edges(t.citations()))


@query("G11_mean_in_degree", """
    SELECT round(avg(d), 6) AS mean_degree, CAST(count(*) AS BIGINT) AS n_vertices
    FROM (SELECT dst, count(*) AS d FROM clean_edges GROUP BY dst)""")
def _(t):
    return graph.mean_degree(graph.clean_edges(t.citations())).withColumn("mean_degree", r6(F.col("mean_degree")))


def component_sql(sym: str) -> str:
    return f"""
    WITH RECURSIVE reach(id, c) AS (
      SELECT DISTINCT src, src FROM {sym}
      UNION SELECT e.dst, r.c FROM reach r JOIN {sym} e ON e.src = r.id WHERE r.c < e.dst)
    """


@query("G06_components", component_sql("order_sym") + "SELECT id, min(c) AS component FROM reach GROUP BY id")
def _(t):
    return graph.connected_components(t.order_links())


@query("G06_largest_components", component_sql("order_sym") + """
    SELECT component, CAST(count(*) AS BIGINT) AS size FROM (SELECT id, min(c) AS component FROM reach GROUP BY id)
    GROUP BY component ORDER BY size DESC, component LIMIT 10""")
def _(t):
    return graph.group_sizes(graph.connected_components(t.order_links()), "component")


@query("G06_components_dense", component_sql("sym_edges") + """
    SELECT v.id, coalesce(min(c), v.id) AS component FROM vertices v LEFT JOIN reach r ON r.id = v.id GROUP BY v.id""")
def _(t):
    return graph.connected_components(t.citations())


@query("G07_page_rank_rounds", f"WITH {rounds_sql()} SELECT id, round(rank, 6) AS rank FROM ranks")
def _(t):
    return graph.page_rank(links_of(t), iterations=ROUNDS).select("id", r6(F.col("rank")).alias("rank"))


@query("G07_page_rank", f"WITH {rank_sql()} SELECT id, round(rank, 6) AS rank FROM ranks ORDER BY round(ranks.rank, 9) DESC, id LIMIT 10")
def _(t):
    return graph.top_ranked(graph.page_rank(links_of(t)), 10).select("id", r6(F.col("rank")).alias("rank"))


CORNERS = """e AS MATERIALIZED (SELECT src AS a, dst AS b FROM sym_edges WHERE src < dst),
         tri AS MATERIALIZED (SELECT x.a, x.b, y.b AS c FROM e x JOIN e y ON x.b = y.a JOIN e z ON z.a = x.a AND z.b = y.b),
         corner AS (SELECT a AS id FROM tri UNION ALL SELECT b FROM tri UNION ALL SELECT c FROM tri)"""


@query("G08_triangles", f"""WITH {CORNERS}
    SELECT v.id, CAST(count(c.id) AS BIGINT) AS triangles FROM vertices v LEFT JOIN corner c ON c.id = v.id GROUP BY v.id""")
def _(t):
    return graph.triangle_counts(t.citations())


@query("G09_label_propagation", f"WITH {label_sql()} SELECT id, label FROM comm")
def _(t):
    return graph.label_propagation(links_of(t))


@query("G09_communities", f"""WITH {label_sql(edges='order_sym', ids='(SELECT DISTINCT src AS id FROM order_sym)')}
    SELECT label, CAST(count(*) AS BIGINT) AS size FROM comm GROUP BY label ORDER BY size DESC, label LIMIT 10""")
def _(t):
    return graph.group_sizes(graph.label_propagation(graph.distinct_links(t.order_links())), "label")


@query("G09_community_members", f"""WITH {label_sql()}
    SELECT id, label FROM comm WHERE label = (SELECT label FROM comm GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)
    ORDER BY id LIMIT 5""")
def _(t):
    return graph.largest_community_members(graph.label_propagation(links_of(t))).select("id", "label")


def distance_sql(sym: str, edges: str, hops: int) -> str:
    return f"""
    WITH RECURSIVE dist(id, d) AS (
      (SELECT dst, 0 FROM {edges} GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1)
      UNION SELECT e.dst, d + 1 FROM dist JOIN {sym} e ON e.src = dist.id WHERE d < {hops})
    """


@query("G10_distances", distance_sql("sym_edges", "clean_edges", 5) +
       "SELECT id, CAST(min(d) AS BIGINT) AS distance FROM dist GROUP BY id")
def _(t):
    return graph.distances(t.citations(), graph.most_cited(graph.clean_edges(t.citations())))


@query("G10_distances_sparse", distance_sql("order_sym", "order_links", 40) +
       "SELECT id, CAST(min(d) AS BIGINT) AS distance FROM dist GROUP BY id")
def _(t):
    return graph.distances(t.order_links(), graph.most_cited(t.order_links()))


@query("G10_distance_summary", distance_sql("sym_edges", "clean_edges", 5) + """
    SELECT CAST(count(*) AS BIGINT) AS reachable, CAST(max(d) AS BIGINT) AS max_hops, round(avg(d), 6) AS mean_hops
    FROM (SELECT id, min(d) AS d FROM dist GROUP BY id)""")
def _(t):
    found = graph.distances(t.citations(), graph.most_cited(graph.clean_edges(t.citations())))
    return graph.distance_summary(found).withColumn("mean_hops", r6(F.col("mean_hops")))


@query("G10_distance_histogram", distance_sql("sym_edges", "clean_edges", 5) + """
    SELECT CAST(d AS BIGINT) AS distance, CAST(count(*) AS BIGINT) AS n
    FROM (SELECT id, min(d) AS d FROM dist GROUP BY id) GROUP BY d ORDER BY d LIMIT 30""")
def _(t):
    found = graph.distances(t.citations(), graph.most_cited(graph.clean_edges(t.citations())))
    return graph.distance_histogram(found)


@query("G12_k_core", f"WITH {core_sql('sym_edges', 20, 20)} SELECT id FROM core")
def _(t):
    return graph.k_core(t.citations(), 20)


@query("J10_induced_edges", f"WITH {rank_sql()}, {top_sql(40)} SELECT src, dst FROM inside")
def _(t):
    links = links_of(t)
    return graph.induced(graph.clean_edges(links), graph.top_ranked(graph.page_rank(links), 40))


@query("G13_community_nodes", f"WITH {rank_sql()}, {label_sql()}, {top_sql(20)} " + attributes_sql("top", "clean_edges"))
def _(t):
    links = links_of(t)
    nodes, _ = graph.community_map(links, graph.page_rank(links), graph.label_propagation(links))
    return nodes.withColumn("rank", r6(F.col("rank")))


@query("J09_node_attributes", f"WITH {rank_sql()}, {label_sql()}, {top_sql(100)} " + attributes_sql("top", "clean_edges"))
def _(t):
    links = links_of(t)
    top = graph.top_ranked(graph.page_rank(links), 100)
    nodes = graph.node_attributes(top, graph.clean_edges(links), graph.label_propagation(links), BASE)
    return nodes.withColumn("rank", r6(F.col("rank")))


@query("G14_backbone_nodes", f"""WITH {rank_sql()}, {label_sql()}, {top_sql(60)}, {core_sql('inside', 2)},
    cedges AS MATERIALIZED (SELECT src, dst FROM inside WHERE src IN (SELECT id FROM core) AND dst IN (SELECT id FROM core)),
    ctop AS (SELECT id, rank FROM top WHERE id IN (SELECT id FROM core)) """ + attributes_sql("ctop", "cedges"))
def _(t):
    links = links_of(t)
    nodes, _ = graph.backbone(links, graph.page_rank(links), graph.label_propagation(links), n=60)
    return nodes.withColumn("rank", r6(F.col("rank")))


@query("G14_backbone_edges", f"""WITH {rank_sql()}, {top_sql(60)}, {core_sql('inside', 2)}
    SELECT src, dst FROM inside WHERE src IN (SELECT id FROM core) AND dst IN (SELECT id FROM core)""")
def _(t):
    links = links_of(t)
    own = graph.vertices(links).withColumn("label", F.col("id"))
    _, edges = graph.backbone(links, graph.page_rank(links), own, n=60)
    return edges


BRIDGE_SQL = f"""WITH {rank_sql()}, {label_sql()}, {top_sql(40)},
    near AS (SELECT src AS id, dst AS other FROM inside UNION SELECT dst, src FROM inside),
    seen AS (SELECT n.id, count(DISTINCT c.label) AS k FROM near n JOIN comm c ON c.id = n.other GROUP BY n.id),
    btop AS (SELECT t.id, t.rank, coalesce(s.k, 0) AS nc, coalesce(s.k, 0) * t.rank AS score
             FROM top t LEFT JOIN seen s ON s.id = t.id) """


@query("G15_bridge_nodes", BRIDGE_SQL + attributes_sql(
    "btop", "clean_edges", "CAST(t.nc AS BIGINT) AS neighbour_communities, round(t.score, 6) AS bridge_score,",
    "concat(t.id, ' (nComm=', t.nc, ', bScore=', printf('%.3f', t.score), ')')"))
def _(t):
    links = links_of(t)
    nodes, _ = graph.bridges(links, graph.page_rank(links), graph.label_propagation(links))
    return nodes.withColumns({c: r6(F.col(c)) for c in ("rank", "bridge_score")})


@query("G15_top_bridges", BRIDGE_SQL + """
    SELECT id, round(score, 6) AS bridge_score FROM btop WHERE nc > 0 ORDER BY round(score, 9) DESC, id LIMIT 20""")
def _(t):
    links = links_of(t)
    nodes, _ = graph.bridges(links, graph.page_rank(links), graph.label_propagation(links))
    return graph.top_bridges(nodes).withColumn("bridge_score", r6(F.col("bridge_score")))


def status_names(t: Tables):
    return t.orders.select(F.concat(F.lit("st."), "o_orderstatus").alias("category_id"),
                           F.concat(F.lit("status "), "o_orderstatus").alias("pretty_name")).distinct()


@query("G16_report_rows", f"""
    WITH {rank_sql()}, {label_sql()}, {CORNERS}, wanted AS (
      (SELECT 'out' AS list, src AS id FROM clean_edges GROUP BY src ORDER BY count(*) DESC, src LIMIT 20)
      UNION ALL (SELECT 'in', dst FROM clean_edges GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 20)
      UNION ALL (SELECT 'rank', id FROM ranks ORDER BY round(rank, 9) DESC, id LIMIT 10)
      UNION ALL (SELECT 'triangles', c.id FROM corner c GROUP BY c.id ORDER BY count(*) DESC, c.id LIMIT 5)
      UNION ALL (SELECT 'community', id FROM comm WHERE label = (
        SELECT label FROM comm GROUP BY label ORDER BY count(*) DESC, label LIMIT 1) ORDER BY id LIMIT 5)
      UNION ALL (SELECT 'source', dst FROM clean_edges GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1)),
    named AS (SELECT p.id, string_agg(coalesce(m.pretty_name, p.c), '; ' ORDER BY p.pos) AS pretty FROM (
        SELECT id, unnest(string_split(categories, ' ')) AS c,
               generate_subscripts(string_split(categories, ' '), 1) AS pos FROM dated_papers) p
      LEFT JOIN (SELECT concat('st.', o_orderstatus) AS category_id, min(concat('status ', o_orderstatus)) AS pretty_name
                 FROM orders GROUP BY 1) m ON m.category_id = p.c GROUP BY p.id)
    SELECT w.list, w.id, d.title, a.names AS authors, n.pretty AS pretty_categories, substring(d.update_date, 1, 4) AS year
    FROM wanted w LEFT JOIN dated_papers d ON d.id = w.id LEFT JOIN named n ON n.id = w.id
    LEFT JOIN (SELECT id, string_agg(DISTINCT author, ', ' ORDER BY author) AS names FROM paper_authors GROUP BY id) a ON a.id = w.id""")
def _(t):
    """Every list of the report, and the authors."""
    links = links_of(t)
    edges = graph.clean_edges(links)
    lists = {"out": graph.top_degrees(edges, "src"), "in": graph.top_degrees(edges, "dst"),
             "rank": graph.top_ranked(graph.page_rank(links), 10),
             "triangles": graph.top_triangles(graph.triangle_counts(links)),
             "community": graph.largest_community_members(graph.label_propagation(links)),
             "source": graph.most_cited(edges)}
    return graph.report_rows(lists, t.dated_papers(), status_names(t), t.paper_authors())


@query("G13_community_edges", f"WITH {rank_sql()}, {top_sql(20)} SELECT src, dst, 'Directed' AS type FROM inside")
def _(t):
    links = links_of(t)
    _, edges = graph.community_map(links, graph.page_rank(links), graph.vertices(links).withColumn("label", F.col("id")))
    return edges.withColumn("type", F.lit("Directed"))


@query("G15_bridge_edges", f"WITH {rank_sql()}, {top_sql(40)} SELECT src, dst, 'Directed' AS type FROM inside")
def _(t):
    links = links_of(t)
    _, edges = graph.bridges(links, graph.page_rank(links), graph.vertices(links).withColumn("label", F.col("id")))
    return edges.withColumn("type", F.lit("Directed"))
