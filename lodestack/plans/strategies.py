"""Queries of the retrieval strategies: entities, relations and chunks of every query vector."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.operators import context as cx
from lodestack.operators import search as s
from lodestack.operators import strategies as st
from lodestack.operators.graph import canonical
from lodestack.operators.keyvalue import latest
from lodestack.plans import tables as t
from lodestack.plans.book import Book
from lodestack.plans.searching import BM25_SQL
from lodestack.session import cut_all, table

book = Book()
K, MOST, E_TOKENS, R_TOKENS = 8, 5, 150, 400


def store(spark, sf) -> st.Store:
    chunks = latest(t.chunks(spark, sf).filter("content IS NOT NULL"), ["id"], [F.col("workspace")]).select(
        F.col("id").alias("chunk_id"), "content", F.coalesce("file_path", F.lit("unknown_source")).alias("file_path"), "full_doc_id", "chunk_order_index"
    )
    p = F.col("properties")
    nodes = table(spark, sf, "knowledge_graph_node").groupBy(F.col("id").alias("label")).agg(
        F.min(F.lower(F.coalesce(p["entity_type"], F.lit("UNKNOWN")))).alias("type"), F.max(p["description"]).alias("description")
    )
    rows = canonical(t.relation_rows(spark, sf).withColumn("description", F.col("content")))
    edges = rows.groupBy("src", "tgt").agg(F.count(F.lit(1)).cast("double").alias("weight"), F.min("description").alias("description"))
    pair = edges.select("src", "tgt", F.concat("src", "tgt").alias("label"))
    rel = pair.join(t.stub_vectors(spark, sf, pair), "label").select("src", "tgt", "embedding").distinct()
    links = rows.select("src", "tgt", "ord", F.explode("source_ids").alias("chunk_id")).filter("chunk_id <> ''")
    of_nodes = links.select(F.explode(F.array("src", "tgt")).alias("label"), "chunk_id", "ord").groupBy("label", "chunk_id").agg(F.min("ord").alias("ord"))
    # As tables that a knowledge base has stored; the strategies read them many times.
    return st.Store(*cut_all(
        t.stub_vectors(spark, sf, t.nodes(spark, sf)), rel, t.stub_vectors(spark, sf, chunks.select(F.col("chunk_id").alias("label"))).withColumnRenamed("label", "chunk_id"),
        nodes, edges, chunks, of_nodes, links.groupBy("src", "tgt", "chunk_id").agg(F.min("ord").alias("ord")),
    ))


def options(**more) -> st.Options:
    return st.Options(top_k=K, chunk_top_k=K, entity_tokens=E_TOKENS, relation_tokens=R_TOKENS, total_tokens=1000, max_related=MOST, **more)


def terms(spark, sf):
    """Words of every query: those of one of the five fixed ones."""
    ids = t.query_vectors(spark, sf).select("query_id", (F.floor(F.col("query_id") / 20) % 5).alias("fixed"))
    return ids.join(F.broadcast(t.query_terms(spark).withColumnRenamed("query_id", "fixed")), "fixed").select("query_id", "term")


def questions(spark, sf):
    return terms(spark, sf).groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("term")), " ").alias("question"))


def rows_of(found: st.Found):
    """All results as query_id, what, key, rank, source."""
    none = F.lit(None).cast("string").alias("source")
    parts = []
    if found.entities is not None:
        parts.append(found.entities.select("query_id", F.lit("entity").alias("what"), F.col("label").alias("key"), "rank", none))
    if found.relations is not None:
        parts.append(found.relations.select("query_id", F.lit("relation").alias("what"), F.concat_ws("<SEP>", "src", "tgt").alias("key"), "rank", none))
    if found.chunks is not None:
        tag = F.concat("source", "frequency", F.lit("/"), "order").alias("source")
        parts.append(found.chunks.select("query_id", F.lit("chunk").alias("what"), F.col("chunk_id").alias("key"), "rank", tag))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


SIM = "round(list_cosine_similarity(embedding::DOUBLE[], query::DOUBLE[]), 12)"


def _dense_sql(name: str, source: str, key: str, order: str, k: int = K) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT query_id, {key}, row_number() OVER (PARTITION BY query_id ORDER BY {SIM} DESC, {order}) AS rank FROM {source}, query_vectors) WHERE rank <= {k})"""


STORE_SQL = ",\n".join([
    """chunk_rows AS (SELECT id AS label, content, coalesce(file_path, 'unknown_source') AS file_path, full_doc_id, chunk_order_index
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY workspace) AS rn FROM chunks WHERE content IS NOT NULL) WHERE rn = 1)""",
    """node_data AS (SELECT id AS label, min(lower(coalesce(properties['entity_type'], 'UNKNOWN'))) AS type, max(properties['description']) AS description FROM knowledge_graph_node GROUP BY id)""",
    """edge_data AS (SELECT least(src, tgt) AS src, greatest(src, tgt) AS tgt, count(*)::DOUBLE AS weight, min(content) AS description FROM
  (SELECT source_id AS src, target_id AS tgt, content FROM relations WHERE source_id <> target_id) GROUP BY 1, 2)""",
    t.stub_sql("nodes", "entity_vectors"), "pairs AS (SELECT src, tgt, src || tgt AS label FROM edges)", t.stub_sql("pairs", "pair_vectors"),
    "relation_vectors AS (SELECT DISTINCT src, tgt, embedding FROM pairs JOIN pair_vectors USING (label))", t.stub_sql("chunk_rows", "chunk_vectors"),
    _dense_sql("entity_hits", "entity_vectors", "label", "label"), _dense_sql("relation_hits", "relation_vectors", "src, tgt", "src, tgt"),
    _dense_sql("chunk_hits", "chunk_vectors", "label AS chunk_id", "label"),
    """source_rows AS (SELECT least(src, tgt) AS src, greatest(src, tgt) AS tgt, ord, unnest(source_ids) AS chunk_id FROM (SELECT src AS src, tgt AS tgt, ord, source_ids FROM relation_rows WHERE src <> tgt)),
entity_chunks AS (SELECT label, chunk_id, min(ord) AS ord FROM (SELECT src AS label, chunk_id, ord FROM source_rows UNION ALL SELECT tgt, chunk_id, ord FROM source_rows) WHERE chunk_id <> '' GROUP BY 1, 2),
relation_chunks AS (SELECT src, tgt, chunk_id, min(ord) AS ord FROM source_rows WHERE chunk_id <> '' GROUP BY 1, 2, 3)""",
])
# Local: the hits' nodes, and their edges by PageRank on each query's own graph, 200 rounds of it.
LOCAL_SQL = """local_entities AS (SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM entity_hits JOIN node_data USING (label)),
lg AS (SELECT query_id, least(a, b) AS src, greatest(a, b) AS tgt, max(weight) AS w, min(rank) AS hit FROM local_entities JOIN links ON label = a GROUP BY 1, 2, 3),
lb AS (SELECT query_id, src AS a, tgt AS b, w FROM lg UNION ALL SELECT query_id, tgt, src, w FROM lg),
lw AS (SELECT query_id, a AS label, sum(w) AS total FROM lb GROUP BY 1, 2),
ln AS (SELECT query_id, label, max(anchor) AS anchor FROM (SELECT query_id, label, 1 AS anchor FROM local_entities UNION ALL SELECT query_id, label, 0 FROM lw) GROUP BY 1, 2),
lp AS (SELECT query_id, label, anchor, total, (1 + 9e0 * anchor) / sum(1 + 9e0 * anchor) OVER (PARTITION BY query_id) AS p FROM ln LEFT JOIN lw USING (query_id, label)),
ld AS (SELECT query_id, coalesce(sum(p) FILTER (WHERE total IS NULL), 0e0) AS d FROM lp GROUP BY 1),
lj AS (SELECT query_id, label, anchor, p * (0.15e0 + 0.85e0 * 0.15e0 * d / (1 - 0.85e0 * d)) AS jump FROM lp JOIN ld USING (query_id)),
ls AS (SELECT lb.query_id, lb.a, lb.b, lb.w / lw.total AS share, lj.jump FROM lb JOIN lw ON lw.query_id = lb.query_id AND lw.label = lb.a JOIN lj ON lj.query_id = lb.query_id AND lj.label = lb.b),
pr AS (SELECT 0 AS i, query_id, label, jump AS r FROM lj UNION ALL
  SELECT x.i + 1, ls.query_id, ls.b, max(ls.jump) + 0.85e0 * sum(x.r * ls.share) FROM pr x JOIN ls ON x.query_id = ls.query_id AND x.label = ls.a WHERE x.i < 200 GROUP BY x.i, ls.query_id, ls.b),
ranks AS (SELECT query_id, label, r, anchor FROM pr JOIN lj USING (query_id, label) WHERE i = 200),
local_smart AS (SELECT lg.query_id, src, tgt, hit, (a.r + b.r) * CASE WHEN a.anchor + b.anchor = 2 THEN 2e0 ELSE 1e0 END AS smart FROM lg
  JOIN ranks a ON a.query_id = lg.query_id AND a.label = src JOIN ranks b ON b.query_id = lg.query_id AND b.label = tgt),
local_relations AS (SELECT query_id, src, tgt, smart, row_number() OVER (PARTITION BY query_id ORDER BY round(smart, 9) DESC, hit, src, tgt) AS rank FROM local_smart)"""
GLOBAL_SQL = """global_relations AS (SELECT query_id, src, tgt, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM relation_hits JOIN edge_data USING (src, tgt)),
global_entities AS (SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY k) AS rank FROM
  (SELECT query_id, label, min(k) AS k FROM (SELECT query_id, src AS label, rank * 2 AS k FROM global_relations UNION ALL SELECT query_id, tgt, rank * 2 + 1 FROM global_relations) GROUP BY 1, 2) JOIN node_data USING (label))"""
HYBRID_SQL = """hybrid_entities AS (SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY k) AS rank FROM
  (SELECT query_id, label, min(k) AS k FROM (SELECT query_id, label, rank * 2 AS k FROM local_entities UNION ALL SELECT query_id, label, rank * 2 + 1 FROM global_entities) GROUP BY 1, 2)),
hybrid_relations AS (SELECT query_id, src, tgt, row_number() OVER (PARTITION BY query_id ORDER BY k) AS rank FROM
  (SELECT query_id, src, tgt, min(k) AS k FROM (SELECT query_id, src, tgt, rank * 2 AS k FROM local_relations UNION ALL SELECT query_id, src, tgt, rank * 2 + 1 FROM global_relations) GROUP BY 1, 2, 3))"""


def _json_sql(fields: dict[str, str]) -> str:
    return " || ".join([("'{" if i == 0 else "', ") + f"\"{name}\": ' || to_json(coalesce({c}, 'UNKNOWN'))" for i, (name, c) in enumerate(fields.items())]) + " || '}'"


def _budget_sql(name: str, source: str, data: str, key: str, fields: dict[str, str], budget: int) -> str:
    return f"""{name} AS (SELECT query_id, {key}, rank FROM (SELECT query_id, {key}, rank, sum(length({_json_sql(fields)})::DOUBLE / 4) OVER (PARTITION BY query_id ORDER BY rank) AS used
  FROM {source} JOIN {data} USING ({key})) WHERE used <= {budget})"""


def _picked_sql(name: str, met: str) -> str:
    """Chunks picked by vector, by weight for queries for which that gives none; met has query_id, rank, chunk_id, ord."""
    return f"""{name}_first AS (SELECT query_id, chunk_id, count(DISTINCT rank) AS frequency, min((rank, ord)) AS spot FROM ({met}) GROUP BY 1, 2),
{name}_many AS (SELECT query_id, count(DISTINCT rank) AS n FROM ({met}) GROUP BY 1),
{name}_vector AS (SELECT query_id, chunk_id, frequency, rank FROM (SELECT query_id, chunk_id, frequency, n, row_number() OVER (PARTITION BY query_id ORDER BY {SIM} DESC, chunk_id) AS rank
  FROM {name}_first JOIN {name}_many USING (query_id) JOIN chunk_vectors ON label = chunk_id JOIN query_vectors USING (query_id)) WHERE rank <= floor(n * {MOST} / 2e0)),
{name}_weight AS (SELECT query_id, chunk_id, frequency, rank FROM (SELECT query_id, chunk_id, frequency, row_number() OVER (PARTITION BY query_id ORDER BY spot[1], frequency DESC, spot[2], chunk_id) AS rank
  FROM {name}_first) WHERE rank <= {MOST}),
{name} AS (SELECT * FROM {name}_vector UNION ALL SELECT * FROM {name}_weight WHERE query_id NOT IN (SELECT query_id FROM {name}_vector))"""


def _merged_sql(lists: list[tuple[str, str]]) -> str:
    parts = " UNION ALL ".join(
        f"SELECT query_id, chunk_id, '{tag}' AS tag, {i} AS turn, {'frequency' if tag in 'ER' else '1'} AS frequency, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank "
        f"FROM {source} WHERE chunk_id IN (SELECT label FROM chunk_rows)" for i, (tag, source) in enumerate(lists)
    )
    return f"""lists AS ({parts}),
merged AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY k) AS rank, tag || frequency || '/' || o AS source FROM
  (SELECT query_id, chunk_id, min(rank * {len(lists)} + turn) AS k, arg_max(tag, turn) AS tag, arg_max(frequency, turn) AS frequency, arg_max(rank, turn) AS o FROM lists GROUP BY 1, 2))"""


VIEWS = ("chunks", "nodes", "relation_rows", "edges", "links", "query_vectors")
TERMS_SQL = "fixed_" + t.SQL["query_terms"] + ",\nquery_terms AS (SELECT v.query_id, term FROM query_vectors v JOIN fixed_query_terms f ON f.query_id = v.query_id // 20 % 5)"
CHUNK_BM25 = BM25_SQL.replace("FROM documents", "FROM (SELECT label AS doc_id, content AS text FROM chunk_rows)").replace("rank <= 20", f"rank <= {K}")
FUSED_SQL = TERMS_SQL + ",\n" + CHUNK_BM25 + f""",
fused AS (SELECT query_id, chunk_id, sum(1e0 / (60e0 + rank)) AS score, min(rank) AS best FROM
  (SELECT query_id, chunk_id, rank FROM chunk_hits UNION ALL SELECT query_id, doc_id, rank FROM sparse) GROUP BY 1, 2),
fused_hits AS (SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, best, chunk_id) AS rank FROM fused) WHERE rank <= {K})"""


def strategy_sql(kind: str, first: str | None = None, final: str | None = None) -> str:
    """The SQL of a strategy over the graph: entities, relations and merged chunks."""
    parts = [STORE_SQL, LOCAL_SQL if kind in ("local", "hybrid") else "", GLOBAL_SQL if kind in ("global", "hybrid") else "", HYBRID_SQL if kind == "hybrid" else ""]
    parts.append(_budget_sql("be", f"{kind}_entities", "node_data", "label", {"entity": "label", "type": "type", "description": "description"}, E_TOKENS))
    parts.append(_budget_sql("br", f"{kind}_relations", "edge_data", "src, tgt", {"entity1": "src", "entity2": "tgt", "description": "description"}, R_TOKENS))
    parts.append(_picked_sql("pe", "SELECT query_id, rank, chunk_id, ord FROM be JOIN entity_chunks USING (label)"))
    parts.append(_picked_sql("rl", "SELECT query_id, rank, chunk_id, ord FROM br JOIN relation_chunks USING (src, tgt) WHERE (query_id, chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM pe)"))
    lists = [("E", "pe"), ("R", "rl")]
    if first:
        lists.insert(0, ("C", first))
    if first == "fused_hits":
        parts.append(FUSED_SQL)
    parts.append(_merged_sql(lists))
    rows = """SELECT query_id, 'entity' AS what, label AS key, rank, NULL AS source FROM be UNION ALL SELECT query_id, 'relation', src || '<SEP>' || tgt, rank, NULL FROM br
UNION ALL SELECT query_id, 'chunk', chunk_id, rank, source FROM merged"""
    return t.cte(*VIEWS, extra=",\n".join(p for p in parts if p)).replace("WITH ", "WITH RECURSIVE ", 1) + (final or rows)


PLAIN = t.cte(*VIEWS, extra=STORE_SQL)


@book.query("strategy_naive", PLAIN + "SELECT query_id, 'chunk' AS what, chunk_id AS key, rank, 'C1/' || rank AS source FROM chunk_hits")
def strategy_naive(spark, sf):
    return rows_of(st.strategy("naive")(store(spark, sf), t.query_vectors(spark, sf), options()))


@book.query("strategy_local", strategy_sql("local"))
def strategy_local(spark, sf):
    return rows_of(st.strategy("local")(store(spark, sf), t.query_vectors(spark, sf), options()))


@book.query("smart_edges", t.cte(*VIEWS, extra=STORE_SQL + ",\n" + LOCAL_SQL).replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT query_id, src, tgt, round(smart, 6) AS smart_rank, rank FROM local_relations")
def smart_edges(spark, sf):
    """All edges of the hit entities by PageRank on each query's graph."""
    found = st.local(store(spark, sf), t.query_vectors(spark, sf), options())
    return found.relations.select("query_id", "src", "tgt", F.round("smart_rank", 6).alias("smart_rank"), "rank")


@book.query("node_hits", PLAIN.rstrip() + """,
 degree_of AS (SELECT a AS label, count(*) AS degree FROM links GROUP BY 1)
SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, coalesce(degree, 0) AS degree, type, description FROM entity_hits JOIN node_data USING (label) LEFT JOIN degree_of USING (label)""")
def node_hits(spark, sf):
    """The hit entities with node and degree, in order."""
    sto = store(spark, sf)
    return st.with_nodes(sto, st.dense_entities(sto, t.query_vectors(spark, sf), K))


@book.query("edge_hits", PLAIN + "SELECT query_id, src, tgt, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, weight, description FROM relation_hits JOIN edge_data USING (src, tgt)")
def edge_hits(spark, sf):
    sto = store(spark, sf)
    return st.with_edges(sto, st.dense_relations(sto, t.query_vectors(spark, sf), K))


@book.query("strategy_global", strategy_sql("global"))
def strategy_global(spark, sf):
    return rows_of(st.strategy("global")(store(spark, sf), t.query_vectors(spark, sf), options()))


@book.query("strategy_hybrid", strategy_sql("hybrid"))
def strategy_hybrid(spark, sf):
    return rows_of(st.strategy("hybrid")(store(spark, sf), t.query_vectors(spark, sf), options()))


@book.query("strategy_mix", strategy_sql("hybrid", "chunk_hits"))
def strategy_mix(spark, sf):
    return rows_of(st.strategy("mix")(store(spark, sf), t.query_vectors(spark, sf), options()))


NEIGHBOUR_SQL = """asked AS (SELECT query_id, list_distinct(list(term)) AS q FROM query_terms GROUP BY 1),
wanted AS (SELECT query_id, full_doc_id, rank, step, chunk_order_index + step AS idx FROM fused_hits JOIN chunk_rows ON label = chunk_id, (VALUES (1), (2)) v(step) WHERE rank <= 5),
nearby AS (SELECT query_id, c.label AS chunk_id, min((rank, step)) AS f FROM wanted w JOIN chunk_rows c ON c.full_doc_id = w.full_doc_id AND c.chunk_order_index = w.idx
  WHERE (query_id, c.label) NOT IN (SELECT (query_id, chunk_id) FROM merged) GROUP BY 1, 2),
pool AS (SELECT query_id, chunk_id, rank, source FROM merged UNION ALL SELECT query_id, chunk_id, m.most + n, 'N1/' || (m.most + n) FROM
  (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY f[1], f[2], chunk_id) AS n FROM nearby) JOIN (SELECT query_id, max(rank) AS most FROM merged GROUP BY 1) m USING (query_id)),
scored AS (SELECT query_id, chunk_id, rank, source, len(list_intersect(q, list_distinct(regexp_extract_all(lower(content), '[\\p{L}\\p{N}_]+'))))::DOUBLE / len(q) AS score
  FROM pool JOIN chunk_rows ON label = chunk_id JOIN asked USING (query_id)),
kept AS (SELECT * FROM (SELECT query_id, chunk_id, source, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS rank FROM scored) WHERE rank <= """ + f"{K})"


@book.query("strategy_hybrid_mix", strategy_sql("hybrid", "fused_hits", ",\n" + NEIGHBOUR_SQL + """
SELECT query_id, 'entity' AS what, label AS key, rank, NULL AS source FROM be UNION ALL SELECT query_id, 'relation', src || '<SEP>' || tgt, rank, NULL FROM br
UNION ALL SELECT query_id, 'chunk', chunk_id, rank, source FROM kept""").replace("\n,\n", ",\n"))
def strategy_hybrid_mix(spark, sf):
    """The whole plan: dense and sparse chunks fused, those of the graph and the neighbours, reranked by shared words."""
    plan = st.strategy("hybrid_mix")
    return rows_of(plan(store(spark, sf), t.query_vectors(spark, sf), options(rerank=s.overlap_score), questions(spark, sf), terms(spark, sf)))


@book.query("weighted_polling", t.cte(*VIEWS, extra=STORE_SQL + ",\n" + _picked_sql("pe", "SELECT query_id, rank, chunk_id, ord FROM entity_hits JOIN entity_chunks USING (label)"))
            + "SELECT query_id, chunk_id, frequency, rank FROM pe_weight")
def weighted_polling(spark, sf):
    """Chunks of the hit entities in the entities' order, the most shared first."""
    sto = store(spark, sf)
    hits = st.dense_entities(sto, t.query_vectors(spark, sf), K)
    return st.picked_by_weight(st.related_chunks(hits, ["label"], sto.entity_chunks), MOST)


@book.query("vector_pick", t.cte(*VIEWS, extra=STORE_SQL + ",\n" + _picked_sql("pe", "SELECT query_id, rank, chunk_id, ord FROM entity_hits JOIN entity_chunks USING (label)"))
            + "SELECT query_id, chunk_id, frequency, rank FROM pe")
def vector_pick(spark, sf):
    """Chunks of the hit entities that are nearest to the query by their stored vectors, by weight where there are none."""
    sto, queries = store(spark, sf), t.query_vectors(spark, sf)
    hits = st.dense_entities(sto, queries, K)
    return st.picked(st.related_chunks(hits, ["label"], sto.entity_chunks), sto, queries, options())


@book.query("context_render", PLAIN.rstrip() + """,
 used AS (SELECT query_id, rank, content, file_path, sum(length(content)::DOUBLE / 4) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM chunk_hits JOIN chunk_rows ON label = chunk_id),
 fit AS (SELECT * FROM used WHERE used <= 800),
 cited AS (SELECT query_id, file_path, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, min(rank)) AS ref FROM fit WHERE file_path <> '' AND file_path <> 'unknown_source' GROUP BY 1, 2),
 blocks AS (SELECT query_id, rank, '<chunk reference_id="' || coalesce(ref::VARCHAR, '') || '">' || chr(10) || content || chr(10) || '</chunk>' AS block FROM fit LEFT JOIN cited USING (query_id, file_path)),
 listed AS (SELECT query_id, string_agg('[' || ref || '] ' || file_path, chr(10) ORDER BY ref) AS refs FROM cited GROUP BY 1)
SELECT query_id, 'Chunks:' || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY rank) || coalesce(chr(10) || chr(10) || 'References:' || chr(10) || max(refs), '') AS context
FROM blocks LEFT JOIN listed USING (query_id) GROUP BY query_id""")
def context_render(spark, sf):
    """The chunks of the plain strategy within a budget, tagged with the number of their file, and the list of files."""
    sto = store(spark, sf)
    return st.contexts(st.strategy("naive")(sto, t.query_vectors(spark, sf), options()), sto, options())


@book.query("subquery_merge", PLAIN + """,
 rows_ AS (SELECT query_id // 20 % 2 AS question_id, query_id AS sub, 'chunk' AS what, chunk_id AS key, rank FROM chunk_hits
   UNION ALL SELECT query_id // 20 % 2, query_id, 'entity', label, rank FROM entity_hits UNION ALL SELECT query_id // 20 % 2, query_id, 'relation', src || '<SEP>' || tgt, rank FROM relation_hits),
 first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, what, key ORDER BY sub, rank) AS n FROM rows_) WHERE n = 1),
 paths AS (SELECT question_id, file_path, row_number() OVER (PARTITION BY question_id ORDER BY min((sub, rank))) AS ref FROM rows_ JOIN chunk_rows ON label = key WHERE what = 'chunk' AND file_path <> '' GROUP BY 1, 2)
SELECT question_id, what, key, row_number() OVER (PARTITION BY question_id, what ORDER BY sub, rank) AS position, ref AS reference_id
FROM first LEFT JOIN (SELECT label AS key, file_path FROM chunk_rows) c ON what = 'chunk' AND c.key = first.key LEFT JOIN paths USING (question_id, file_path)""".replace("SELECT question_id, what, key,", "SELECT question_id, what, first.key AS key,").lstrip("\n"))
def subquery_merge(spark, sf):
    """Chunks, entities and relations of several sub-queries as one list a question, files numbered anew by first appearance."""
    sto, queries = store(spark, sf), t.query_vectors(spark, sf)
    pair = F.concat_ws("<SEP>", "src", "tgt")
    parts = [(st.dense_chunks(sto, queries, K), "chunk", F.col("chunk_id")), (st.dense_entities(sto, queries, K), "entity", F.col("label")), (st.dense_relations(sto, queries, K), "relation", pair)]
    rows = None
    for hits, what, key in parts:
        part = hits.select((F.floor(F.col("query_id") / 20) % 2).alias("question_id"), F.col("query_id").alias("sub"), F.lit(what).alias("what"), key.alias("key"), "rank")
        rows = part if rows is None else rows.unionByName(part)
    paths = sto.chunks.select(F.lit("chunk").alias("what"), F.col("chunk_id").alias("key"), "file_path")
    return cx.merged_queries(rows.join(paths, ["what", "key"], "left"))
