"""The registered queries over the shared tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import strings, vectors
from .operators import factors, graph, keyed, learning, similarity, steady, topics, trees, words
from .plans import iterate, tables
from .sources import dumps, text

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- words and keyed state

_WORDS = "SELECT unnest(regexp_split_to_array(text, '[^-a-zA-Z0-9_]')) AS word FROM documents"


@query(f"SELECT word, count(*) AS n FROM ({_WORDS}) WHERE word <> '' GROUP BY word ORDER BY n DESC, word LIMIT 10")
def word_count_topk(spark, d):
    return words.word_count_topk(_t(spark, d, "documents"), "text", 10)


@query(f"SELECT word, count(*) AS n FROM ({_WORDS}) WHERE word LIKE 'th%' GROUP BY word ORDER BY n DESC, word LIMIT 20")
def topk_with_key_filter(spark, d):
    counts = words.word_counts(_t(spark, d, "documents"), "text")
    return keyed.top(counts, 20, "word", "n", F.col("word").startswith("th"))


def _events(spark, d):
    return _t(spark, d, "events").where("value is not null").select(F.col("user_id").alias("key"), "value", "event_id", "event_type")


@query("SELECT user_id AS key, round(sum(value), 4) AS value FROM events WHERE value IS NOT NULL GROUP BY user_id")
def kv_fold_sum(spark, d):
    return keyed.fold(_events(spark, d), F.sum).withColumn("value", F.round("value", 4))


@query("SELECT user_id AS key, bit_xor(event_id) AS value FROM events GROUP BY user_id")
def kv_fold_custom(spark, d):
    """A fold by a function of the user's."""
    return keyed.fold_with(_t(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("value")), lambda a, b: a ^ b)


@query("SELECT user_id AS key, round(product(1 + abs(value) / 1000), 6) AS value FROM events WHERE value IS NOT NULL GROUP BY user_id")
def kv_fold_product(spark, d):
    deltas = _events(spark, d).select("key", (1 + F.abs("value") / 1000).alias("value"))
    return keyed.fold(deltas, F.product).withColumn("value", F.round("value", 6))


@query(f"SELECT word, row_number() OVER (ORDER BY word) - 1 AS index FROM (SELECT DISTINCT word FROM ({_WORDS}) WHERE word <> '')")
def vocabulary(spark, d):
    return words.vocabulary(words.word_counts(_t(spark, d, "documents"), "text"))


@query("SELECT user_id AS key, max(value) AS value FROM events WHERE value IS NOT NULL GROUP BY user_id")
def kv_fold_max(spark, d):
    return keyed.fold(_events(spark, d), F.max)


@query("SELECT key, event_id, value FROM (SELECT user_id AS key, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS r FROM events WHERE value IS NOT NULL) WHERE r = 1")
def kv_argmin(spark, d):
    return keyed.smallest_error(_events(spark, d), "key", "event_id", "value")


@query("SELECT user_id AS key, string_agg(event_type, '|' ORDER BY event_type) AS kinds FROM events WHERE value IS NOT NULL GROUP BY user_id")
def kv_concat(spark, d):
    lists = keyed.concat_lists(_events(spark, d).select("key", F.array("event_type").alias("value")))
    return lists.select("key", F.array_join("value", "|").alias("kinds"))


@query("""
WITH latest AS (
  SELECT user_id AS key, event_id % 2 AS half, value FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY event_id DESC) AS r FROM events WHERE value IS NOT NULL) WHERE r = 1
), old AS (SELECT key, value FROM latest WHERE half = 0), new AS (SELECT key, value FROM latest WHERE half = 1 AND key % 3 = 0),
put AS (SELECT coalesce(n.key, o.key) AS key, coalesce(n.value, o.value) AS value FROM old o FULL JOIN new n ON n.key = o.key),
cas AS (SELECT p.key, CASE WHEN o.key % 5 = 0 AND o.value = p.value THEN 0.0::DOUBLE ELSE p.value END AS value FROM put p LEFT JOIN old o ON o.key = p.key)
SELECT key, value FROM cas WHERE key % 7 <> 0
""")
def kv_put_cas_remove(spark, d):
    latest = _events(spark, d).groupBy("key", (F.col("event_id") % 2).alias("half")).agg(F.max_by("value", "event_id").alias("value"))
    old = latest.where("half = 0").select("key", "value")
    state = keyed.put(old, latest.where("half = 1 and key % 3 = 0").select("key", "value"))
    changes = old.where("key % 5 = 0").select("key", F.lit(0.0).alias("value"), keyed.token(F.col("value")).alias("token"))
    return keyed.remove_where(keyed.compare_and_set(state, changes), F.col("key") % 7 == 0)


@query("""
WITH wanted AS (SELECT DISTINCT user_id AS key FROM events WHERE user_id % 4 = 0 UNION SELECT -1)
SELECT w.key, s.value FROM wanted w JOIN (SELECT user_id AS key, max(value) AS value FROM events WHERE value IS NOT NULL GROUP BY user_id) s ON s.key = w.key
""")
def kv_multi_get(spark, d):
    wanted = _t(spark, d, "events").where("user_id % 4 = 0").select(F.col("user_id").alias("key")).distinct().unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("key")))
    return keyed.get_many(keyed.fold(_events(spark, d), F.max), wanted)


@query("SELECT p_name AS key, p_size AS value FROM part WHERE p_size >= 12 AND NOT (p_name LIKE '%3') ")
def key_predicates(spark, d):
    state = _t(spark, d, "part").select(F.col("p_name").alias("key"), F.col("p_size").alias("value"))
    return keyed.remove_where(keyed.select_where(state, F.col("value") >= 12), F.col("key").endswith("3"))


@query("SELECT label AS key, pos - 1 AS pos, round(sum(x), 4) AS total FROM (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY ALL")
def vector_fold(spark, d):
    folded = keyed.fold_vectors(_t(spark, d, "embeddings").select(F.col("label").alias("key"), F.col("embedding").cast("array<double>").alias("value")))
    return folded.select("key", F.posexplode("value").alias("pos", "x")).select("key", F.col("pos").cast("long").alias("pos"), F.round("x", 4).alias("total"))


@query("SELECT count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_quantity * l_discount), 4) AS discounted FROM lineitem")
def all_reduce(spark, d):
    rows = _t(spark, d, "lineitem").select(F.lit(1).cast("long").alias("n"), F.col("l_quantity").alias("quantity"), (F.col("l_quantity") * F.col("l_discount")).alias("discounted"))
    out = iterate.all_sum(rows, "n", "quantity", "discounted")
    return out.select("n", F.round("quantity", 2).alias("quantity"), F.round("discounted", 4).alias("discounted"))


@query("SELECT key FROM (SELECT c_nationkey AS key FROM customer UNION SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def set_operations(spark, d):
    held = iterate.gather_distinct([_t(spark, d, "customer").select(F.col("c_nationkey").alias("key")), _t(spark, d, "supplier").select(F.col("s_nationkey").alias("key"))])
    return keyed.remove(held, _t(spark, d, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("key")))


# ---- functions and formats


@query("""
SELECT p_partkey, list_filter(regexp_split_to_array(p_type, '[ A]'), lambda x: x <> '')[1] AS first_part,
  array_to_string(list_filter(string_split(p_name, ' '), lambda x: x <> ''), 'orz') AS joined,
  starts_with(p_type, 'S') AS begins, suffix(p_type, 'L') AS ends,
  string_split(p_brand, '#')[1] AS prefix, string_split(p_brand, '#')[-1] AS suffix FROM part
""")
def string_functions(spark, d):
    parts = strings.split_any(F.col("p_name"), " ")
    return _t(spark, d, "part").select(
        "p_partkey", F.get(strings.split_any(F.col("p_type"), " A"), F.lit(0)).alias("first_part"), strings.join(parts, "orz").alias("joined"),
        F.col("p_type").startswith("S").alias("begins"), F.col("p_type").endswith("L").alias("ends"),
        strings.key_prefix(F.col("p_brand"), "#").alias("prefix"), strings.key_suffix(F.col("p_brand"), "#").alias("suffix"),
    )


_E = "embedding::DOUBLE[64]"


@query(f"""
WITH q AS (SELECT {_E} AS q FROM embeddings WHERE vec_id = 0), e AS (SELECT vec_id, {_E} AS v, q FROM embeddings, q)
SELECT vec_id, round(array_inner_product(v, q), 6) AS dot, round(sqrt(array_inner_product(v, v)), 6) AS norm, round(array_distance(v, q), 6) AS distance,
  round(1 / (1 + exp(-array_inner_product(v, q))), 6) AS sigmoid, round(-1 / (1 + exp(array_inner_product(v, q))), 6) AS slope,
  round(greatest(0.5::DOUBLE, least(1.0::DOUBLE, array_inner_product(v, q))), 6) AS clipped FROM e
""")
def vector_functions(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", vectors.as_doubles(F.col("embedding")).alias("v"))
    both = e.crossJoin(F.broadcast(e.where("vec_id = 0").select(F.col("v").alias("q"))))  # one row
    dot = vectors.dot(F.col("v"), F.col("q"))
    out = {"dot": dot, "norm": vectors.norm(F.col("v")), "distance": vectors.distance(F.col("v"), F.col("q")), "sigmoid": vectors.sigmoid(dot), "slope": vectors.logistic_slope(F.lit(1.0), dot), "clipped": vectors.clip(dot, 0.5, 1.0)}
    return both.select("vec_id", *(F.round(x, 6).alias(n) for n, x in out.items()))


@query("""
SELECT c_custkey, printf('%d%s%d', c_custkey, chr(9), c_nationkey) AS whole, printf('%s%s%.6f', c_name, chr(9), c_acctbal) AS real,
  printf('%d%s%.6f|%.6f', c_custkey, chr(9), c_acctbal, c_acctbal) AS listed, printf('%d%s%d:%.6f', c_custkey, chr(9), c_nationkey, c_acctbal) AS weighted FROM customer
""")
def dump_lines(spark, d):
    c = _t(spark, d, "customer")
    balance = F.col("c_acctbal")
    pairs = F.array(F.struct(F.col("c_nationkey").alias("id"), balance.alias("w")))
    return c.select(
        "c_custkey", dumps.pair_line(F.col("c_custkey"), F.col("c_nationkey").cast("string")).alias("whole"), dumps.pair_line(F.col("c_name"), dumps.fixed(balance)).alias("real"),
        dumps.list_line(F.col("c_custkey"), F.array(balance, balance)).alias("listed"), dumps.weighted_list_line(F.col("c_custkey"), pairs).alias("weighted"),
    )


@query("SELECT o_custkey, dense_rank() OVER (ORDER BY o_custkey) - 1 AS index FROM (SELECT DISTINCT o_custkey FROM orders)")
def index_mapping(spark, d):
    return text.index_of(_t(spark, d, "orders"), "o_custkey", parts=8)


_CELLS = "SELECT o_custkey AS src, l_partkey AS dst, l_quantity AS w FROM orders JOIN lineitem ON l_orderkey = o_orderkey"


def _cells(spark, d):
    joined = _t(spark, d, "orders").join(_t(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select(F.col("o_custkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_quantity").alias("w"))


@query(f"""
WITH c AS ({_CELLS}), r AS (SELECT src, dense_rank() OVER (ORDER BY src) - 1 AS i FROM (SELECT DISTINCT src FROM c)),
k AS (SELECT dst, dense_rank() OVER (ORDER BY dst) - 1 AS j FROM (SELECT DISTINCT dst FROM c))
SELECT i, j, sum(w) AS v FROM c JOIN r USING (src) JOIN k USING (dst) GROUP BY i, j
""")
def sparse_matrix_load(spark, d):
    return text.sparse_matrix(_cells(spark, d))[0]


@query("""
SELECT 'line' AS kind, l_orderkey::VARCHAR AS src, l_partkey::VARCHAR AS dst, l_quantity AS w FROM lineitem
UNION ALL SELECT 'mixed', l_orderkey::VARCHAR, l_partkey::VARCHAR, l_quantity FROM lineitem
""")
def lines_organize(spark, d):
    li = _t(spark, d, "lineitem")
    short = F.concat(F.col("l_orderkey").cast("string"), F.lit(" "), F.col("l_partkey").cast("string"), F.lit(":"), F.col("l_quantity").cast("string"))
    long = F.concat_ws("|", "l_orderkey", "l_partkey", "l_quantity")
    plain = li.select(F.when(F.col("l_linenumber") % 2 == 0, short).otherwise(long).alias("value"))
    listed = li.groupBy("l_orderkey").agg(F.collect_list(F.concat_ws(":", "l_partkey", "l_quantity")).alias("items")).select(F.concat_ws(" ", "l_orderkey", F.array_join("items", " ")).alias("value"))
    parsed = [df.select(text.tokens(F.col("value"), " |").alias("t")) for df in (plain, listed)]
    both = text.edges(parsed[0], "t").withColumn("kind", F.lit("line")).unionByName(text.edges(parsed[1], "t", mix=True).withColumn("kind", F.lit("mixed")))
    return both.select("kind", "src", "dst", "w")


# ---- graphs

_TRADE = """
trade AS (SELECT src, dst, w FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS r FROM (
  SELECT c_nationkey AS src, s_nationkey AS dst, sum(l_quantity) AS w FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL)) WHERE r <= 3)
"""


def _trade(spark, d):
    """From each customers' nation to the three suppliers' nations with the largest quantities."""
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    by_customer = li.join(_t(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    nations = by_customer.join(_t(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(_t(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    flows = nations.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.sum("q").alias("w"))
    return similarity.top_per_key(flows, "src", "w", "dst", 3).select("src", "dst", "w")


_ALIKE = f"alike AS (SELECT a.vec_id AS src, b.vec_id AS dst FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND array_cosine_similarity(a.{_E}, b.{_E}) >= 0.3)"
_BOTH = "links AS (SELECT src, dst FROM alike UNION SELECT dst, src FROM alike)"


def _alike(spark, d):
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"))
    return similarity.similar(e, e, id_col="id", vec="features", least=0.3).where("i < j").select(F.col("i").alias("src"), F.col("j").alias("dst"))


@query(f"""
WITH {_TRADE}, ends AS (SELECT src AS id, 1 AS o, 0 AS i FROM trade UNION ALL SELECT dst, 0, 1 FROM trade), deg AS (SELECT id, sum(o) AS o, sum(i) AS i FROM ends GROUP BY id)
SELECT (SELECT count(*) FROM deg) AS v, (SELECT count(*) FROM trade) AS e, floor((SELECT count(*) FROM trade) / (SELECT count(*) FROM deg))::DOUBLE AS avg_degree,
  (SELECT max(greatest(o, i)) FROM deg)::BIGINT AS max_degree, (SELECT count(*) FROM trade WHERE src = dst) AS selfloops
""")
def graph_stats_directed(spark, d):
    return graph.directed_stats(_trade(spark, d))


@query(f"WITH {_ALIKE}, {_BOTH}, deg AS (SELECT src, count(*) AS n FROM links GROUP BY src) SELECT count(*) AS v, (SELECT count(*) FROM alike) AS e, 2.0::DOUBLE * (SELECT count(*) FROM alike) / count(*) AS avg_degree, max(n) AS max_degree, 0::BIGINT AS selfloops FROM deg")
def graph_stats_undirected(spark, d):
    return graph.undirected_stats(_alike(spark, d))


@query(f"""
WITH c AS (SELECT DISTINCT src, dst FROM ({_CELLS}))
SELECT count(DISTINCT src) AS v, count(*) AS e, (SELECT max(n) FROM (SELECT count(*) AS n FROM c GROUP BY src)) AS max_out, (SELECT max(n) FROM (SELECT count(*) AS n FROM c GROUP BY dst)) AS max_in,
  count(*)::DOUBLE / count(DISTINCT src) AS avg_out FROM c
""")
def graph_stats_bipartite(spark, d):
    return graph.bipartite_stats(_cells(spark, d).select("src", "dst").distinct())


@query(f"WITH {_TRADE} SELECT id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT src AS id, 1 AS o, 0 AS i FROM trade UNION ALL SELECT dst, 0, 1 FROM trade) GROUP BY id")
def vertex_degrees(spark, d):
    return graph.degrees(_trade(spark, d))


@query(f"""
WITH RECURSIVE {_ALIKE}, {_BOTH}, everything AS (SELECT DISTINCT src AS id FROM links),
walk(id, dist) AS (SELECT min(id), 0 FROM everything UNION SELECT dst, dist + 1 FROM walk JOIN links ON src = id WHERE dist < 30),
near AS (SELECT id, min(dist) AS dist FROM walk GROUP BY id)
SELECT e.id, n.dist, (SELECT min(p.id) FROM near p JOIN links l ON l.src = p.id WHERE l.dst = e.id AND p.dist = n.dist - 1) AS parent FROM everything e LEFT JOIN near n ON n.id = e.id
""")
def bfs_hops(spark, d):
    from .plans.tables import store

    links, _ = store(graph.both_ways(_alike(spark, d)), "alike")
    return graph.bfs(links, links.agg(F.min("src")).first()[0])


@query(f"""
WITH RECURSIVE {_ALIKE}, {_BOTH}, reach(id, other) AS (SELECT DISTINCT src, src FROM links UNION SELECT r.id, l.dst FROM reach r JOIN links l ON l.src = r.other)
SELECT id, min(other) AS component FROM reach GROUP BY id
""")
def connected_components(spark, d):
    return graph.connected_components(_alike(spark, d))


def _rank_sql(edges: str, n: int) -> str:
    out = [f"WITH {_TRADE}, {edges}, outs AS (SELECT src, count(*) AS links FROM g GROUP BY src), r0 AS (SELECT src AS id, 1.0::DOUBLE / (SELECT count(*) FROM outs) AS rank FROM outs)"]
    for k in range(n):
        out.append(f"r{k + 1} AS (SELECT r.id, 0.15::DOUBLE + 0.85::DOUBLE * coalesce(s.got, 0) AS rank FROM r{k} r LEFT JOIN (SELECT g.dst AS id, sum(p.rank / o.links) AS got FROM g JOIN r{k} p ON p.id = g.src JOIN outs o ON o.src = g.src GROUP BY g.dst) s ON s.id = r.id)")
    return ", ".join(out) + f" SELECT id, round(rank, 6) AS rank FROM r{n}"


@query(_rank_sql("g AS (SELECT src, dst FROM trade)", 5))
def pagerank(spark, d):
    return graph.pagerank(_trade(spark, d), 5).withColumn("rank", F.round("rank", 6))


_PURCHASES = f"g AS MATERIALIZED (SELECT DISTINCT src, dst FROM (SELECT 2 * src AS src, 2 * dst + 1 AS dst FROM ({_CELLS}) UNION ALL SELECT 2 * dst + 1, 2 * src FROM ({_CELLS})))"


@query(_rank_sql(_PURCHASES, 3))
def pagerank_purchases(spark, d):
    """Over customers and the parts they bought, each linked with the other."""
    cells = _cells(spark, d).select((2 * F.col("src")).alias("src"), (2 * F.col("dst") + 1).alias("dst")).distinct()
    return graph.pagerank(cells.unionByName(graph.reverse(cells)), 3).withColumn("rank", F.round("rank", 6))


_OPEN = "few AS (SELECT src, dst FROM trade WHERE src < 20), g AS (SELECT src::BIGINT AS src, dst::BIGINT AS dst FROM few UNION SELECT dst, 2147483648 FROM few WHERE dst NOT IN (SELECT src FROM few))"


@query(_rank_sql(_OPEN, 3))
def pagerank_with_sinks(spark, d):
    e = _trade(spark, d).where("src < 20").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    return graph.pagerank(graph.close_sinks(e), 3).withColumn("rank", F.round("rank", 6))


@query(f"WITH RECURSIVE {_TRADE}, reach(id, other) AS (SELECT src, src FROM trade UNION SELECT dst, dst FROM trade UNION SELECT r.id, t.src FROM reach r JOIN trade t ON t.dst = r.other) SELECT id, max(other) AS value FROM reach GROUP BY id")
def max_vertex_value(spark, d):
    return graph.max_vertex_value(_trade(spark, d))


@query(f"WITH RECURSIVE {_TRADE}, up AS (SELECT src, dst FROM trade WHERE src < dst), walk(id, level) AS (SELECT src, 0 FROM up UNION SELECT dst, 0 FROM up UNION SELECT u.dst, level + 1 FROM walk JOIN up u ON u.src = id) SELECT id, max(level) AS level FROM walk GROUP BY id")
def topological_levels(spark, d):
    return graph.topological_levels(_trade(spark, d).where("src < dst"))


@query(f"WITH RECURSIVE {_TRADE}, up AS (SELECT src, dst FROM trade WHERE src < dst), walk(id, level) AS (SELECT src, 0 FROM up UNION SELECT dst, 0 FROM up UNION SELECT u.dst, level + 1 FROM walk JOIN up u ON u.src = id), l AS (SELECT id, max(level) AS level FROM walk GROUP BY id) SELECT id, row_number() OVER (ORDER BY level, id) - 1 AS position FROM l")
def topological_order(spark, d):
    return graph.topological_order(_trade(spark, d).where("src < dst"))


@query(f"WITH RECURSIVE {_ALIKE}, {_BOTH}, reach(id, other) AS (SELECT DISTINCT src, src FROM links UNION SELECT r.id, l.dst FROM reach r JOIN links l ON l.src = r.other) SELECT id, dense_rank() OVER (ORDER BY component) - 1 AS number FROM (SELECT id, min(other) AS component FROM reach GROUP BY id)")
def component_numbers(spark, d):
    return graph.component_numbers(graph.connected_components(_alike(spark, d)))


@query(f"WITH RECURSIVE {_TRADE}, reach(id) AS (SELECT min(src) FROM trade UNION SELECT t.dst FROM reach r JOIN trade t ON t.src = r.id) SELECT id FROM reach")
def reachable(spark, d):
    e = _trade(spark, d)
    return graph.reachable(e, e.agg(F.min("src")).first()[0])


# ---- similarity


def _vectors(spark, d):
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"), "label")


def _cosine_sql(a: str, b: str, k: int, least: float) -> str:
    return f"""
SELECT i, j, round(sim, 6) AS sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS rank FROM (
  SELECT a.vec_id AS i, b.vec_id AS j, round(array_cosine_similarity(a.{_E}, b.{_E}), 9) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
  WHERE {a} AND {b} AND array_cosine_similarity(a.{_E}, b.{_E}) >= {least})) WHERE rank <= {k}"""


@query(_cosine_sql("true", "true", 5, 0.2))
def cosine_topk_self(spark, d):
    e = _vectors(spark, d)
    return similarity.cosine_topk(e, e, 5, 0.2).withColumn("sim", F.round("sim", 6)).withColumn("rank", F.col("rank").cast("long"))


@query(_cosine_sql("a.label = 0", "b.label <> 0", 5, 0.0))
def cosine_topk_ab(spark, d):
    e = _vectors(spark, d)
    return similarity.cosine_topk(e.where("label = 0"), e.where("label <> 0"), 5, 0.0).withColumn("sim", F.round("sim", 6)).withColumn("rank", F.col("rank").cast("long"))


_RATINGS = "SELECT o_custkey AS \"user\", l_partkey AS item, max(1 + l_quantity::BIGINT % 5)::DOUBLE AS rating FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL"


def _ratings(spark, d):
    cells = _cells(spark, d)
    return cells.groupBy(F.col("src").alias("user"), F.col("dst").alias("item")).agg(F.max(1 + F.col("w").cast("long") % 5).cast("double").alias("rating"))


_SPARSE = f"""
r AS ({_RATINGS}), n AS (SELECT "user", sqrt(sum(rating * rating)) AS size FROM r GROUP BY 1), s AS (
  SELECT a."user" AS i, b."user" AS j, round(sum(a.rating / x.size * (b.rating / y.size)), 9) AS sim FROM r a JOIN r b ON a.item = b.item AND a."user" <> b."user"
  JOIN n x ON x."user" = a."user" JOIN n y ON y."user" = b."user" GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS rank FROM s WHERE sim >= 0.001 QUALIFY rank <= 10)"""


@query(f"WITH {_SPARSE} SELECT i, j, round(sim, 6) AS sim, rank FROM top")
def sparse_cosine_topk(spark, d):
    found = similarity.sparse_cosine_topk(_ratings(spark, d).toDF("src", "dst", "w"), 10, 0.001)
    return found.select("i", "j", F.round("sim", 6).alias("sim"), F.col("rank").cast("long").alias("rank"))


@query(f"""
WITH {_SPARSE}, grid AS (SELECT t.i AS u, t.rank, o.item, o.rating, t.sim, v.rating AS theirs FROM top t JOIN r o ON o."user" = t.i LEFT JOIN r v ON v."user" = t.j AND v.item = o.item WHERE t.rank >= 2),
run AS (SELECT u, rank, rating, sum(CASE WHEN theirs IS NOT NULL THEN sim ELSE 0 END) OVER w AS dd, sum(CASE WHEN theirs IS NOT NULL THEN sim * theirs ELSE 0 END) OVER w AS tt FROM grid WINDOW w AS (PARTITION BY u, item ORDER BY rank)),
pre AS (SELECT u, rank, round(sum(CASE WHEN dd <> 0 THEN pow(rating - tt / dd, 2) ELSE 0 END), 9) AS residual FROM run GROUP BY ALL),
seen AS (SELECT *, max((residual <> 0)::INT) OVER (PARTITION BY u ORDER BY rank) AS started FROM pre),
best AS (SELECT u, rank AS size, residual FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY residual, rank) AS o FROM seen WHERE started = 1) WHERE o = 1),
last AS (SELECT u, arg_max(residual, rank) AS base_residual FROM pre GROUP BY u)
SELECT m.i AS "user", coalesce(b.size, m.n) AS size, round(coalesce(b.residual, 0), 6) AS residual, round(coalesce(l.base_residual, 0), 6) AS base_residual
FROM (SELECT i, count(*) AS n FROM top GROUP BY i) m LEFT JOIN best b ON b.u = m.i LEFT JOIN last l ON l.u = m.i
""")
def adjust_ktop(spark, d):
    ratings, _ = tables.store(_ratings(spark, d), "ratings")
    sims = similarity.sparse_cosine_topk(ratings.toDF("src", "dst", "w"), 10, 0.001)
    out = similarity.neighbourhood_sizes(ratings, sims, 2)
    return out.select("user", F.col("size").cast("long").alias("size"), F.round("residual", 6).alias("residual"), F.round("base_residual", 6).alias("base_residual"))


@query(f"""
WITH q AS (SELECT {_E} AS q FROM embeddings WHERE vec_id = 0)
SELECT vec_id AS id, round(array_inner_product({_E}, q), 6) AS score FROM embeddings, q WHERE vec_id >= 5 AND label <> 3 ORDER BY round(array_inner_product({_E}, q), 9) DESC, vec_id LIMIT 10
""")
def mips_topk(spark, d):
    e = _vectors(spark, d)
    q = [float(x) for x in e.where("id = 0").first()["features"]]
    found = similarity.inner_product_topk(e, q, 10, black=e.where("id < 5").select("id"), white=e.where("label <> 3").select("id"))
    return found.withColumn("score", F.round("score", 6))


@query(f"""
WITH q AS (SELECT {_E} AS q FROM embeddings WHERE vec_id = 1)
SELECT vec_id AS id, round(array_inner_product({_E}, q), 6) AS score FROM embeddings, q ORDER BY round(array_inner_product({_E}, q), 9) DESC, vec_id LIMIT 10
""")
def mips_balls(spark, d):
    e = _vectors(spark, d)
    q = [float(x) for x in e.where("id = 1").first()["features"]]
    return similarity.BallIndex.build(e, 16).search(q, 10).withColumn("score", F.round("score", 6))


# ---- learners


def _kmeans_sql(n: int, final: str) -> str:
    out = [f"WITH e AS (SELECT vec_id AS id, {_E}::DOUBLE[] AS v FROM embeddings), c0 AS (SELECT row_number() OVER (ORDER BY id) - 1 AS c, v FROM (SELECT * FROM e ORDER BY id LIMIT 10))"]
    for k in range(n):
        out.append(f"a{k} AS (SELECT id, v, c FROM (SELECT e.id, e.v, c.c, row_number() OVER (PARTITION BY e.id ORDER BY list_distance(e.v, c.v), c.c) AS r FROM e, c{k} c) WHERE r = 1)")
        out.append(f"c{k + 1} AS (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN (SELECT c, list(x ORDER BY pos) AS v FROM (SELECT c, pos, avg(x) AS x FROM (SELECT c, generate_subscripts(v, 1) AS pos, unnest(v) AS x FROM a{k}) GROUP BY ALL) GROUP BY c) m ON m.c = c.c)")
    return ", ".join(out) + " " + final


@query(_kmeans_sql(3, "SELECT id, c AS cluster FROM a2"))
def kmeans_assign(spark, d):
    return learning.kmeans(_vectors(spark, d), 10, 3)[0]


@query(_kmeans_sql(3, "SELECT c AS cluster, pos - 1 AS pos, round(x, 6) AS x FROM (SELECT c, generate_subscripts(v, 1) AS pos, unnest(v) AS x FROM c3)"))
def kmeans_centers(spark, d):
    centres = learning.kmeans(_vectors(spark, d), 10, 3)[1]
    rows = [(c, p, float(x)) for c, row in enumerate(centres) for p, x in enumerate(row)]
    return spark.createDataFrame(rows, "cluster long, pos long, x double").withColumn("x", F.round("x", 6))


@query(_kmeans_sql(2, "SELECT c AS cluster, list(id ORDER BY id) AS ids FROM a1 GROUP BY c"))
def kmeans_groups(spark, d):
    return learning.members(learning.kmeans(_vectors(spark, d), 10, 2)[0], parts=1).select("cluster", "ids")


@query(_kmeans_sql(2, "SELECT a.c AS cluster, count(*) AS n, round(max(list_distance(a.v, k.v)), 6) AS radius FROM a1 a JOIN c2 k ON k.c = a.c GROUP BY a.c"))
def kmeans_radii(spark, d):
    e = _vectors(spark, d)
    return learning.radii(e, *learning.kmeans(e, 10, 2)).withColumn("radius", F.round("radius", 6))


def _labelled(spark, d):
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"), (F.col("label") == 0).cast("double").alias("label"))


_LABELLED = "e AS MATERIALIZED (SELECT vec_id AS id, list_prepend(1.0::DOUBLE, embedding::DOUBLE[]) AS x, CASE WHEN label = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM embeddings)"
_ZEROS = "SELECT list_transform(range(65), lambda j: 0.0::DOUBLE) AS t"
_RATE, _DECAY = "0.002::DOUBLE", "0.0004::DOUBLE"  # alpha, and 2 alpha beta


def _weights_sql(table: str) -> str:
    return f"SELECT pos - 1 AS pos, round(w, 6) AS weight FROM (SELECT generate_subscripts(t, 1) AS pos, unnest(t) AS w FROM {table})"


def _descent_sql(n: int) -> str:
    out = [f"WITH {_LABELLED}, t0 AS ({_ZEROS})"]
    for k in range(n):
        out.append(f"g{k} AS MATERIALIZED (SELECT pos, sum(err * v) AS g, count(*) AS n FROM (SELECT err, generate_subscripts(x, 1) AS pos, unnest(x) AS v FROM (SELECT x, y - 1 / (1 + exp(-list_inner_product(x, t))) AS err FROM e, t{k})) GROUP BY pos)")
        out.append(f"t{k + 1} AS MATERIALIZED (SELECT list(t[pos] + {_RATE} * g - {_DECAY} * n * t[pos] ORDER BY pos) AS t FROM g{k}, t{k})")
    return ", ".join(out) + " " + _weights_sql(f"t{n}")


def _mixing_sql(rounds: int, shards: int, *, logistic: bool, batches: int = 1, mean: bool = True) -> str:
    """Descent row by row on each shard, the changes put together: one recursive walk for each meeting."""
    out = [f"WITH RECURSIVE {_LABELLED}, r AS MATERIALIZED (SELECT id % {shards} AS shard, (id // {shards}) % {batches} AS batch, row_number() OVER (PARTITION BY id % {shards}, (id // {shards}) % {batches} ORDER BY id) AS i, x, y FROM e), t0 AS MATERIALIZED ({_ZEROS})"]
    k = 0
    for _ in range(rounds):
        for b in range(batches):
            a = "list_inner_product(s.t, r.x)"
            h = f"1 / (1 + exp(-{a}))" if logistic else a
            step = f"SELECT s.shard, s.i + 1 AS i, s.t AS t, r.x AS x, r.y - {h} AS err FROM s{k} s JOIN r ON r.shard = s.shard AND r.batch = {b} AND r.i = s.i + 1"
            out.append(f"s{k}(shard, i, t) AS (SELECT DISTINCT shard, 0::BIGINT, t FROM r, t{k} WHERE batch = {b} UNION ALL SELECT shard, i, list_transform(range(1, 66), lambda j: t[j] + {_RATE} * err * x[j] - {_DECAY} * t[j]) FROM ({step}))")
            moved = f"SELECT pos, {'avg' if mean else 'sum'}(v - u) AS m, any_value(u) AS u FROM (SELECT generate_subscripts(l.t, 1) AS pos, unnest(l.t) AS v, unnest(t{k}.t) AS u FROM (SELECT arg_max(t, i) AS t FROM s{k} GROUP BY shard) l, t{k}) GROUP BY pos"
            out.append(f"t{k + 1} AS MATERIALIZED (SELECT list(u + m ORDER BY pos) AS t FROM ({moved}))")
            k += 1
    return ", ".join(out) + " " + _weights_sql(f"t{k}")


def _coordinates_sql(n: int, step: str, data: str) -> str:
    """Coordinate steps over doubled weights; ``step`` is the change of weight k + 1, with v = w+ - w-, place and sign."""
    now = "SELECT t, w, t % 128 AS k, t % 64 + 1 AS place, CASE WHEN t % 128 < 64 THEN 1 ELSE -1 END AS sign, list_transform(range(1, 65), lambda j: w[j] - w[j + 64]) AS v FROM s WHERE t < " + str(n)
    return f"""
WITH RECURSIVE {_LABELLED}, {data}, s(t, w) AS (SELECT 0, list_transform(range(128), lambda j: 0.0::DOUBLE) UNION ALL
  SELECT t + 1, list_transform(range(1, 129), lambda j: CASE WHEN j = k + 1 THEN w[j] + greatest(-w[j], c) ELSE w[j] END) FROM (SELECT *, {step} AS c FROM ({now}), d))
SELECT p - 1 AS pos, round(w[p] - w[p + 64], 6) AS weight FROM s, range(1, 65) u(p) WHERE t = {n}"""


_GRAM = """
x AS (SELECT id, y, generate_subscripts(f, 1) AS i, unnest(f) AS v FROM (SELECT id, y, x[2:65] AS f FROM e)),
d AS MATERIALIZED (SELECT (SELECT list(g ORDER BY i) FROM (SELECT i, list(g ORDER BY j) AS g FROM (SELECT a.i, b.i AS j, sum(a.v * b.v) AS g FROM x a JOIN x b USING (id) GROUP BY ALL) GROUP BY i)) AS xx,
  (SELECT list(g ORDER BY i) FROM (SELECT i, sum(v * y) AS g FROM x GROUP BY i)) AS xy, (SELECT count(*) FROM e) AS n)"""
_LISTS = "d AS MATERIALIZED (SELECT list(x[2:65] ORDER BY id) AS xs, list(CASE WHEN y = 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END ORDER BY id) AS ys, count(*) AS n FROM e)"


def _weights(spark, theta):
    return spark.createDataFrame([(j, float(w)) for j, w in enumerate(theta)], "pos long, weight double").withColumn("weight", F.round("weight", 6))


@query(_descent_sql(3))
def logreg_dgd(spark, d):
    return _weights(spark, learning.logistic_gradient_descent(_labelled(spark, d), 3))


_THETA = [(j * 7 % 11 - 5) / 20 for j in range(65)]
_THETA_SQL = "(SELECT list_transform(range(65), lambda j: (j * 7 % 11 - 5) / 20.0::DOUBLE) AS t)"


@query(f"WITH {_LABELLED}, p AS (SELECT y, 1 / (1 + exp(-list_inner_product(x, t))) AS h FROM e, {_THETA_SQL}) SELECT round(avg(CASE WHEN y = 1 THEN -ln(h) ELSE -ln(1 - h) END), 6) AS loss FROM p")
def logreg_loss(spark, d):
    return learning.logistic_loss(_labelled(spark, d), _THETA).withColumn("loss", F.round("loss", 6))


@query(f"WITH {_LABELLED} SELECT id, label, round(1 / (1 + exp(-list_inner_product(x, t))), 6) AS prediction FROM (SELECT id, x, y AS label FROM e), {_THETA_SQL}")
def logreg_predict(spark, d):
    return learning.logistic_predictions(_labelled(spark, d), _THETA).select("id", "label", F.round("prediction", 6).alias("prediction"))


@query(f"WITH {_LABELLED} SELECT round(avg(pow(list_inner_product(x, t) - y, 2)), 6) AS loss FROM e, {_THETA_SQL}")
def ridge_loss(spark, d):
    return learning.squared_loss(_labelled(spark, d), _THETA).withColumn("loss", F.round("loss", 6))


@query(_mixing_sql(2, 4, logistic=True))
def logreg_ipm(spark, d):
    return _weights(spark, learning.logistic_mixing(_labelled(spark, d), 2))


@query(_mixing_sql(1, 4, logistic=True, batches=8, mean=False))
def logreg_downpour(spark, d):
    return _weights(spark, learning.logistic_downpour(_labelled(spark, d), 1))


@query(_mixing_sql(1, 1, logistic=True))
def logreg_agd(spark, d):
    return _weights(spark, learning.logistic_sequential(_labelled(spark, d), 1))


@query(_mixing_sql(2, 4, logistic=False))
def ridge_ipm(spark, d):
    return _weights(spark, learning.ridge_mixing(_labelled(spark, d), 2))


@query(_coordinates_sql(200, "-(0.5::DOUBLE + sign * (list_inner_product(xx[place], v) - xy[place])) / n", _GRAM))
def lasso_cd(spark, d):
    return _weights(spark, learning.lasso(_labelled(spark, d), 0.5, 200))


@query(_coordinates_sql(80, "-4 * (0.5::DOUBLE + sign * list_sum(list_transform(range(1, n + 1), lambda i: -ys[i] / (1 + exp(ys[i] * list_inner_product(xs[i], v))) * xs[i][place]))) / n", _LISTS))
def logreg_l1_cd(spark, d):
    return _weights(spark, learning.logistic_l1(_labelled(spark, d), 0.5, 80))


@query("SELECT i - 1 AS i, j - 1 AS j, round(sum(x * y), 4) AS v FROM (SELECT e, generate_subscripts(e, 1) AS i, unnest(e) AS x FROM (SELECT embedding::DOUBLE[] AS e FROM embeddings)), LATERAL (SELECT generate_subscripts(e, 1) AS j, unnest(e) AS y) GROUP BY ALL")
def gram_matrix(spark, d):
    xx, _, _ = learning.gram(_vectors(spark, d))
    return spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(xx) for j, v in enumerate(row)], "i long, j long, v double").withColumn("v", F.round("v", 4))


@query()
def svd_singular_values(spark, d):
    values, _ = factors.singular_values(_vectors(spark, d), 10)
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "k long, value double").withColumn("value", F.round("value", 6))


@query("""
WITH x AS (SELECT vec_id, generate_subscripts(e, 1) AS i, unnest(e) AS v FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)),
g1 AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM x a JOIN x b USING (vec_id) GROUP BY ALL), g2 AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM g1 a JOIN g1 b ON b.i = a.j GROUP BY ALL),
n AS (SELECT count(*)::DOUBLE AS n FROM embeddings)
SELECT power, round(total / pow((SELECT n FROM n), power), 9) AS total FROM (
  SELECT 1 AS power, sum(v) FILTER (i = j) AS total FROM g1 UNION ALL SELECT 2, sum(v * v) FROM g1
  UNION ALL SELECT 3, sum(a.v * b.v) FROM g1 a JOIN g2 b ON b.i = a.i AND b.j = a.j UNION ALL SELECT 4, sum(v * v) FROM g2)
""")
def svd_power_sums(spark, d):
    """Sums of even powers of all singular values, which are traces of powers of the products of columns."""
    rows = _vectors(spark, d)
    values, n = factors.singular_values(rows, 64)[0], rows.count()
    return spark.createDataFrame([(p, round(float((values**2 / max(n, 1)) @ (values**2 / max(n, 1)) ** (p - 1)), 9)) for p in range(1, 5)], "power int, total double")


@query(f"WITH c AS (SELECT src AS i, dst AS m, sum(w) AS x FROM ({_CELLS}) GROUP BY ALL), h AS (SELECT p_partkey AS m, k AS j, (p_partkey * (k + 1) % 7)::DOUBLE AS y FROM part, range(3) r(k)) SELECT i, j, sum(x * y) AS v FROM c JOIN h USING (m) GROUP BY i, j")
def matrix_multiply(spark, d):
    a = _cells(spark, d).groupBy(F.col("src").alias("i"), F.col("dst").alias("j")).agg(F.sum("w").alias("v"))
    h = _t(spark, d, "part").select(F.col("p_partkey").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("j")).withColumn("v", (F.col("i") * (F.col("j") + 1) % 7).cast("double"))
    return factors.multiply(a, h)


# ---- recommendation


def _made_up(ids: DataFrame, id_col: str, shift: int) -> DataFrame:
    """Factors and biases by arithmetic on ids."""
    i = F.col(id_col) + shift
    return ids.select(F.col(id_col).alias("id"), F.array((i % 7) / 10.0, (i % 11) / 10.0).alias("factors"), ((i % 5) / 10.0).alias("bias"))


def _mf_sql(final: str) -> str:
    return f"""
WITH r AS ({_RATINGS}), p AS (SELECT "user", item, rating, CASE WHEN "user" % 10 = 0 OR item % 10 = 0 THEN 3.0::DOUBLE ELSE greatest(1.0::DOUBLE, least(5.0::DOUBLE,
  3.0::DOUBLE + ("user" % 5) / 10.0::DOUBLE + ((item + 3) % 5) / 10.0::DOUBLE + (("user" % 7) / 10.0::DOUBLE * (((item + 3) % 7) / 10.0::DOUBLE) + ("user" % 11) / 10.0::DOUBLE * (((item + 3) % 11) / 10.0::DOUBLE)))) END AS prediction FROM r)
{final}"""


def _mf(spark, d):
    r = _ratings(spark, d)
    users = _made_up(r.select("user").distinct().where("user % 10 <> 0"), "user", 0)
    items = _made_up(r.select("item").distinct().where("item % 10 <> 0"), "item", 3)
    return r, users, items


@query(_mf_sql('SELECT "user", item, rating, round(prediction, 6) AS prediction FROM p'))
def mf_predict(spark, d):
    return factors.predict(*_mf(spark, d), 3.0).withColumn("prediction", F.round("prediction", 6))


@query(_mf_sql("SELECT count(*) AS n, round(sqrt(sum(pow(rating - prediction, 2)) / count(*)), 6) AS rmse FROM p"))
def mf_rmse(spark, d):
    return factors.rmse(*_mf(spark, d), 3.0).withColumn("rmse", F.round("rmse", 6))


@query()
def mf_train(spark, d):
    users, _, _ = factors.train(_ratings(spark, d), 4, 1)
    return users.select("id", F.transform("factors", lambda x: F.round(x, 6)).alias("factors"), F.round("bias", 6).alias("bias"))


@query(f"SELECT \"user\", item, rating - 3 - (item % 5) / 10.0::DOUBLE AS rating, substr(item::VARCHAR, -1) IN ('0', '1', '2') AS held FROM ({_RATINGS}) WHERE item % 5 <> 0")
def debias_and_split(spark, d):
    r = _ratings(spark, d)
    bias = r.select("item").distinct().withColumn("bias", (F.col("item") % 5) / 10.0)
    train, held = factors.split_by_last_digit(factors.debias(r, bias, 3.0))
    return train.withColumn("held", F.lit(False)).unionByName(held.withColumn("held", F.lit(True))).select("user", "item", "rating", "held")


_ALS = f"""
WITH r AS ({_RATINGS}), f AS (SELECT "user", item, rating, 0.1::DOUBLE + (item % 7) / 10.0::DOUBLE AS a, 0.2::DOUBLE + (item % 11) / 10.0::DOUBLE AS b FROM r),
s AS (SELECT "user", sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * rating) AS ar, sum(b * rating) AS br FROM f WHERE item % 3 <> 0 GROUP BY 1),
w AS (SELECT "user", lam, ((bb + lam) * ar - ab * br) / ((aa + lam) * (bb + lam) - ab * ab) AS x, ((aa + lam) * br - ab * ar) / ((aa + lam) * (bb + lam) - ab * ab) AS y FROM s, (SELECT unnest([0.1::DOUBLE, 1.0::DOUBLE]) AS lam))"""


def _als(spark, d):
    r = _ratings(spark, d)
    items = r.select(F.col("item").alias("id")).distinct().withColumn("factors", F.array(0.1 + (F.col("id") % 7) / 10.0, 0.2 + (F.col("id") % 11) / 10.0))
    return r.where("item % 3 <> 0"), r.where("item % 3 = 0"), items


@query(_ALS + ' SELECT "user", lam AS lambda, round(x, 6) AS x, round(y, 6) AS y FROM w')
def als_half_step(spark, d):
    train, _, items = _als(spark, d)
    solved = factors.als_half_step(train, items, [0.1, 1.0], 2)
    return solved.select("user", "lambda", F.round(F.col("factors")[0], 6).alias("x"), F.round(F.col("factors")[1], 6).alias("y"))


@query(_ALS + """, e AS (SELECT lam, item % 3 = 0 AS held, pow(rating - (x * a + y * b), 2) AS e FROM f JOIN w USING ("user"))
SELECT lam AS lambda, count(*) FILTER (NOT held) AS train_n, round(sqrt(sum(e) FILTER (NOT held) / count(*) FILTER (NOT held)), 6) AS train_rmse, count(*) FILTER (held) AS validation_n, round(sqrt(sum(e) FILTER (held) / count(*) FILTER (held)), 6) AS validation_rmse FROM e GROUP BY lam
""")
def als_validate(spark, d):
    train, held, items = _als(spark, d)
    out = factors.als_validate(train, held, items, [0.1, 1.0], 2)
    return out.withColumns({c: F.round(c, 6) for c in ("train_rmse", "validation_rmse")})


def _tree(spark, d):
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return e.where("id % 10 <> 0"), e.where("id % 10 = 0")


@query("""
WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), u AS (SELECT * FROM e WHERE id % 10 <> 0), t AS (SELECT * FROM e WHERE id % 10 = 0),
s AS (SELECT t.id AS item, u.id AS uid, u.v, list_inner_product(u.v, t.v) >= 0 AS likes FROM u, t),
p AS (SELECT item, likes, uid, generate_subscripts(v, 1) AS pos, unnest(v) AS x FROM s),
m AS (SELECT item, likes, pos, sum(x * x) - sum(x) * sum(x) / count(*) AS err, count(*) AS n FROM p GROUP BY ALL),
g AS (SELECT item, coalesce(max(n) FILTER (likes), 0)::BIGINT AS l, coalesce(max(n) FILTER (NOT likes), 0)::BIGINT AS h, sum(err) AS error FROM m GROUP BY item)
SELECT item, l AS likes, h AS hates, round(error, 6) AS error FROM g WHERE least(l, h) > 0 AND greatest(l, h) // least(l, h) < 3
""")
def dtree_root_splits(spark, d):
    users, items = _tree(spark, d)
    found = trees.split_errors(users.withColumn("node", F.lit(1)), items)
    return found.select("item", "likes", "hates", F.round("error", 6).alias("error"))


def _tree_sql(levels: int) -> str:
    out = ["WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), t AS MATERIALIZED (SELECT * FROM e WHERE id % 10 = 0), u1 AS MATERIALIZED (SELECT * FROM e WHERE id % 10 <> 0)"]
    for n in range(1, 1 << levels):
        if n > 1:
            out.append(f"u{n} AS MATERIALIZED (SELECT u.* FROM u{n // 2} u, k{n // 2} k JOIN t ON t.id = k.item WHERE (list_inner_product(u.v, t.v) >= 0) = {'false' if n % 2 else 'true'})")
        used = " UNION ALL ".join(f"SELECT item FROM k{m}" for m in range(1, n)) or "SELECT -1"
        out.append(f"""m{n} AS (SELECT item, likes, sum(x * x) - sum(x) * sum(x) / count(*) AS err, count(*) AS n FROM (SELECT item, likes, generate_subscripts(v, 1) AS pos, unnest(v) AS x FROM (SELECT t.id AS item, u.v, list_inner_product(u.v, t.v) >= 0 AS likes FROM u{n} u, t)) GROUP BY item, likes, pos),
g{n} AS (SELECT item, coalesce(max(n) FILTER (likes), 0) AS l, coalesce(max(n) FILTER (NOT likes), 0) AS h, round(sum(err), 9) AS error FROM m{n} GROUP BY item),
k{n} AS MATERIALIZED (SELECT item FROM g{n} WHERE least(l, h) > 0 AND greatest(l, h) // least(l, h) < 3 AND item NOT IN ({used}) ORDER BY error, item LIMIT 1)""")
    rows = " UNION ALL ".join(f"SELECT {n}::BIGINT AS node, (SELECT item FROM k{n}) AS item, (SELECT count(*) FROM u{n}) AS n_users, p AS pos, coalesce((SELECT avg(v[p + 1]) FROM u{n}), 0) AS mean FROM range(64) r(p)" for n in range(1, 1 << levels))
    return ", ".join(out) + f" SELECT node, item, n_users, pos, round(mean, 6) AS mean FROM ({rows})"


@query(_tree_sql(3))
def dtree_rec(spark, d):
    users, items = _tree(spark, d)
    built = trees.build(users, items, 3).select("node", "item", "n_users", F.posexplode("mean").alias("pos", "mean"))
    return built.select("node", "item", "n_users", F.col("pos").cast("long").alias("pos"), F.round("mean", 6).alias("mean"))


@query()
def lda_gibbs(spark, d):
    state = topics.gibbs(_t(spark, d, "documents"), 5, 2)
    return topics.topic_words(state, 0.01, 10).withColumn("phi", F.round("phi", 9))


def _steady_sql(rounds: int) -> str:
    out = [f"WITH RECURSIVE {_TRADE}, a AS MATERIALIZED (SELECT src AS i, dst AS j, w / (SELECT sum(w) FROM trade) AS a FROM trade), l AS MATERIALIZED (SELECT i, sum(a) AS p FROM a GROUP BY i), r AS MATERIALIZED (SELECT j, sum(a) AS p FROM a GROUP BY j), x0 AS MATERIALIZED (SELECT j, p AS x FROM r)"]
    for k in range(rounds):
        out.append(f"""f{k} AS MATERIALIZED (SELECT i, j, l.p, a, a * x AS flow, sum(a * x) OVER (PARTITION BY i) AS total FROM a JOIN x{k} USING (j) JOIN l USING (i)),
q{k} AS MATERIALIZED (SELECT j, r.p * 0.99995::DOUBLE AS aim FROM (SELECT j, sum(p * flow / total) AS q FROM f{k} GROUP BY j) JOIN r USING (j) WHERE q <> 0 AND q < r.p * 0.9999::DOUBLE),
h{k} AS MATERIALIZED (SELECT j, any_value(aim) AS aim, list(p * a ORDER BY i) AS c, list(a ORDER BY i) AS a, list(total - flow ORDER BY i) AS rest FROM f{k} JOIN q{k} USING (j) GROUP BY j),
n{k}(j, n, x, done) AS (SELECT j, 0, x, false FROM x{k} JOIN h{k} USING (j) UNION ALL
  SELECT j, n + 1, CASE WHEN abs(f) <= 1e-10::DOUBLE OR s = 0 THEN x ELSE x - f / s END, abs(f) <= 1e-10::DOUBLE OR s = 0 FROM (
    SELECT z.j, n, x, list_sum(list_transform(range(1, len(c) + 1), lambda i: c[i] * x / (a[i] * x + rest[i]))) - aim AS f, list_sum(list_transform(range(1, len(c) + 1), lambda i: c[i] * rest[i] / pow(a[i] * x + rest[i], 2))) AS s
    FROM n{k} z JOIN h{k} USING (j) WHERE NOT done AND n < 100)),
x{k + 1} AS MATERIALIZED (SELECT x{k}.j, coalesce(m.x, x{k}.x) AS x FROM x{k} LEFT JOIN (SELECT j, arg_max(x, n) AS x FROM n{k} GROUP BY j) m ON m.j = x{k}.j)""")
    return ", ".join(out) + f" SELECT j, round(x, 6) AS score FROM x{rounds}"


@query(_steady_sql(5))
def steady_state(spark, d):
    e = _trade(spark, d)
    total = e.agg(F.sum("w").alias("total"))
    edges = e.crossJoin(F.broadcast(total)).select(F.col("src").alias("i"), F.col("dst").alias("j"), (F.col("w") / F.col("total")).alias("a"))  # one row
    left = edges.groupBy("i").agg(F.sum("a").alias("p"))
    right = edges.groupBy("j").agg(F.sum("a").alias("p"))
    return steady.solve(left, right, edges, rounds=5).withColumn("score", F.round("score", 6))
