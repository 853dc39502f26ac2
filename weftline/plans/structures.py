"""Queries on graphs, events, partitions and chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import parse as P
from weftline.functions.keys import norm_key
from weftline.operators import graph as G
from weftline.operators import integrity as I
from weftline.operators import joins as J
from weftline.operators import windows as W
from weftline.plans.problems import _sql_key as k
from weftline.plans.registry import Registry
from weftline.sources.files import schema_profile, sql_statements
from weftline.sources.sinks import from_sarif, to_bill, to_sarif
from weftline.sources.tables import table
from weftline.streaming import events as S

registry = Registry()
query = registry.query

#: An edge list derived from keys: each supplier calls two others, with a weight.
_EDGES = """n AS (SELECT count(*) AS n FROM supplier), e AS (SELECT s_suppkey AS src, s_suppkey * 3 % n + 1 AS dst, CAST(s_suppkey % 7 + 1 AS DOUBLE) AS w FROM supplier, n UNION ALL SELECT s_suppkey, s_suppkey * 5 % n + 2, CAST(s_suppkey % 3 + 2 AS DOUBLE) FROM supplier, n WHERE s_suppkey % 3 = 0)"""


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select("s_suppkey")
    with_n = s.join(F.broadcast(s.agg(F.count(F.lit(1)).alias("n"))))
    first = with_n.select(F.col("s_suppkey").alias("src"), (F.col("s_suppkey") * 3 % F.col("n") + 1).alias("dst"), (F.col("s_suppkey") % 7 + 1).cast("double").alias("w"))
    second = with_n.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("src"), (F.col("s_suppkey") * 5 % F.col("n") + 2).alias("dst"), (F.col("s_suppkey") % 3 + 2).cast("double").alias("w"))
    return first.unionByName(second)


_RING = """n AS (SELECT count(*) AS n FROM nation), e AS (SELECT n_nationkey AS src, CAST(n_nationkey * 3 % n AS INTEGER) AS dst, CAST(n_nationkey % 7 + 1 AS DOUBLE) AS w FROM nation, n)"""


def _ring(spark: SparkSession, sf: str) -> DataFrame:
    """A small edge list with cycles: each nation calls another."""
    s = table(spark, sf, "nation").select("n_nationkey")
    n = F.broadcast(s.agg(F.count(F.lit(1)).alias("n")))
    return s.join(n).select(F.col("n_nationkey").alias("src"), (F.col("n_nationkey") * 3 % F.col("n")).cast("int").alias("dst"), (F.col("n_nationkey") % 7 + 1).cast("double").alias("w"))


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    """What each supplier knows: its nation."""
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"), F.concat(F.lit("nation-"), F.col("s_nationkey").cast("string")).alias("fact"))


def _start(spark: SparkSession, *nodes: int) -> DataFrame:
    return spark.createDataFrame([(n,) for n in nodes], "node long")


@query(f"WITH RECURSIVE {_EDGES}, r AS (SELECT CAST(2 AS BIGINT) AS node, 0 AS hops UNION SELECT e.dst, r.hops + 1 FROM r JOIN e ON r.node = e.src WHERE r.hops < 100) SELECT node, CAST(min(hops) AS INTEGER) AS hops FROM r GROUP BY node")
def graph_reachable(spark: SparkSession, sf: str) -> DataFrame:
    """G-1: breadth-first reachability with the least number of edges."""
    return G.reachable(_edges(spark, sf), _start(spark, 2)).whole()


@query(f"WITH RECURSIVE {_EDGES}, r AS (SELECT CAST(4 AS BIGINT) AS node UNION SELECT e.src FROM r JOIN e ON r.node = e.dst) SELECT node FROM r")
def graph_impact(spark: SparkSession, sf: str) -> DataFrame:
    """G-3: everything that depends on a node."""
    return G.impacted(_edges(spark, sf), _start(spark, 4)).whole().select("node")


@query(
    f"""WITH RECURSIVE {_EDGES}, r AS (SELECT CAST(2 AS BIGINT) AS node, [CAST(2 AS BIGINT)] AS path UNION ALL SELECT e.dst, list_append(r.path, e.dst) FROM r JOIN e ON r.node = e.src WHERE NOT list_contains(r.path, e.dst) AND len(r.path) < 60),
    m AS (SELECT node, min(len(path)) AS k FROM r GROUP BY node) SELECT r.node, array_to_string(min(r.path), '>') AS path FROM r JOIN m ON r.node = m.node AND len(r.path) = m.k GROUP BY r.node"""
)
def graph_shortest_paths(spark: SparkSession, sf: str) -> DataFrame:
    """G-2: a shortest path to every reachable node."""
    return G.shortest_paths(_edges(spark, sf), _start(spark, 2)).whole().select("node", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query()
def graph_least_costs(spark: SparkSession, sf: str) -> DataFrame:
    """G-12: least sums of weights; tested against a plain algorithm."""
    return G.least_costs(_edges(spark, sf), _start(spark, 2), "w").whole()


@query(
    f"""WITH RECURSIVE {_EDGES}, a AS (SELECT DISTINCT src AS x, dst AS y FROM e UNION SELECT DISTINCT dst, src FROM e), r AS (SELECT x AS node, x AS other FROM a UNION SELECT r.node, a.y FROM r JOIN a ON r.other = a.x) SELECT node, min(other) AS component FROM r GROUP BY node"""
)
def graph_components(spark: SparkSession, sf: str) -> DataFrame:
    """Connected components without direction."""
    return G.components(_edges(spark, sf)).whole()


@query(
    f"""WITH RECURSIVE {_RING}, nodes AS (SELECT src AS x FROM e UNION SELECT dst FROM e), r AS (SELECT x AS a, x AS b FROM nodes UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src) SELECT f.a AS node, min(f.b) AS component FROM r f JOIN r g ON f.a = g.b AND f.b = g.a GROUP BY f.a"""
)
def graph_strong_components(spark: SparkSession, sf: str) -> DataFrame:
    """G-4: cycles as strongly connected components, on the small graph of nations that SQL can check."""
    return G.strong_components(_ring(spark, sf)).whole()


@query()
def graph_strong_components_all(spark: SparkSession, sf: str) -> DataFrame:
    """G-4: strongly connected components of the edges of all suppliers; tested against brute force."""
    return G.strong_components(_edges(spark, sf)).whole()


@query(f"WITH RECURSIVE {_EDGES}, r AS (SELECT CAST(2 AS BIGINT) AS node, [CAST(2 AS BIGINT)] AS path UNION ALL SELECT e.dst, list_append(r.path, e.dst) FROM r JOIN (SELECT DISTINCT src, dst FROM e) e ON r.node = e.src WHERE NOT list_contains(r.path, e.dst) AND len(r.path) < 6) SELECT array_to_string(path, '>') AS path FROM r WHERE len(path) > 1")
def graph_bounded_paths(spark: SparkSession, sf: str) -> DataFrame:
    """G-14: all simple paths of up to six nodes."""
    return G.bounded_paths(_edges(spark, sf), _start(spark, 2), 6).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query(
    f"""WITH RECURSIVE {_EDGES}, r AS (SELECT s_suppkey AS node, 'nation-' || s_nationkey AS fact FROM supplier WHERE s_suppkey <= 3 UNION SELECT e.dst, r.fact FROM r JOIN e ON r.node = e.src) SELECT node, fact FROM r"""
)
def graph_propagation(spark: SparkSession, sf: str) -> DataFrame:
    """G-5 to G-9: facts of three suppliers carried along edges to a fixpoint, which SQL can check."""
    return G.propagate(_facts(spark, sf).where("node <= 3"), _edges(spark, sf)).whole()


@query()
def graph_propagation_all(spark: SparkSession, sf: str) -> DataFrame:
    """G-5 to G-9: the facts of all suppliers carried along edges to a fixpoint; tested against brute force."""
    return G.propagate(_facts(spark, sf), _edges(spark, sf)).whole()


@query(
    f"""WITH {_EDGES} SELECT 'missing node' AS problem, CAST(x AS VARCHAR) AS item FROM (SELECT src AS x FROM e UNION SELECT dst FROM e) WHERE x NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT 'repeated edge', src || '->' || dst FROM e GROUP BY src, dst HAVING count(*) > 1"""
)
def graph_integrity(spark: SparkSession, sf: str) -> DataFrame:
    """G-15: nodes and edges that contradict each other."""
    return G.integrity(table(spark, sf, "supplier").select("s_suppkey"), _edges(spark, sf))


@query(
    f"""WITH RECURSIVE {_EDGES}, r AS (SELECT CAST(2 AS BIGINT) AS node, 0 AS hops UNION SELECT e.dst, r.hops + 1 FROM r JOIN e ON r.node = e.src WHERE r.hops < 100), m AS (SELECT node, min(hops) AS hops FROM r GROUP BY node)
    SELECT s_suppkey AS supplier, CASE WHEN m.node IS NULL THEN 'no-path' WHEN s_suppkey % 2 = 0 THEN 'gated' ELSE 'open' END AS grade, CAST(m.hops AS INTEGER) AS hops FROM supplier LEFT JOIN m ON s_suppkey = m.node"""
)
def graph_grades(spark: SparkSession, sf: str) -> DataFrame:
    """G-11: reachability folded onto rows; unknown stays apart from unreachable."""
    near = G.reachable(_edges(spark, sf), _start(spark, 2)).whole()
    joined = table(spark, sf, "supplier").join(near, F.col("s_suppkey") == F.col("node"), "left")
    return joined.select(F.col("s_suppkey").alias("supplier"), F.when(F.col("node").isNull(), "no-path").when(F.col("s_suppkey") % 2 == 0, "gated").otherwise("open").alias("grade"), "hops")


_EV = "ev AS (SELECT event_id, user_id, event_type, ts, value, CAST(props ->> '$.k' AS INTEGER) AS k FROM events)"


@query(
    """WITH g AS (SELECT user_id, event_type, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS gap FROM events), m AS (SELECT *, avg(gap / 1e6) OVER (PARTITION BY user_id, event_type) AS mean FROM g)
    SELECT user_id, event_type, count(*) AS events, round(avg(gap / 1e6), 4) AS mean_gap, round(avg(abs(gap / 1e6 - mean)) / avg(gap / 1e6), 4) AS jitter FROM m GROUP BY ALL HAVING count(*) >= 6 AND avg(gap / 1e6) > 0"""
)
def beacon_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """W-7: mean gap and jitter of the events of a key."""
    return W.gap_profile(table(spark, sf, "events"), ["user_id", "event_type"], "ts").select("user_id", "event_type", "events", F.round("mean_gap", 4).alias("mean_gap"), F.round("jitter", 4).alias("jitter"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS events, round(sum(value), 2) AS value FROM events GROUP BY ALL")
def hourly_events(spark: SparkSession, sf: str) -> DataFrame:
    """R-7: tumbling windows."""
    out = table(spark, sf, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 2).alias("value"))
    return out.select(F.col("w.start").alias("start"), "event_type", "events", "value")


@query(
    """WITH s AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS b, user_id FROM events), x AS (SELECT unnest([b, b - INTERVAL 30 MINUTE]) AS start, user_id FROM s) SELECT start, count(*) AS events, count(DISTINCT user_id) AS users FROM x GROUP BY start"""
)
def sliding_events(spark: SparkSession, sf: str) -> DataFrame:
    """R-7: hours that begin every thirty minutes."""
    out = table(spark, sf, "events").groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("events"), F.countDistinct("user_id").alias("users"))
    return out.select(F.col("w.start").alias("start"), "events", "users")


@query(
    """WITH f AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM f)
    SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS events FROM s GROUP BY user_id, n"""
)
def user_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """R-7: sessions that end after thirty minutes without an event."""
    out = table(spark, sf, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("events"))
    return out.select("user_id", "start", "last", "events")


@query(f"WITH {_EV} SELECT event_type, count(*) AS events, CAST(sum(k) AS BIGINT) AS total, max(k) AS most FROM ev GROUP BY event_type")
def event_properties(spark: SparkSession, sf: str) -> DataFrame:
    """S-24: values out of JSON."""
    rows = table(spark, sf, "events").select("event_type", F.get_json_object("props", "$.k").try_cast("int").alias("k"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("k").alias("total"), F.max("k").alias("most"))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS signup FROM events")
def carried_signups(spark: SparkSession, sf: str) -> DataFrame:
    """W-11: the last signup of the user so far."""
    rows = table(spark, sf, "events").withColumn("s", F.when(F.col("event_type") == "signup", F.col("event_id")))
    return W.carry_forward(rows, "s", ["user_id"], ["ts", "event_id"], "signup").select("event_id", "signup")


@query(
    """SELECT p.event_id, max(c.ts) AS clicked FROM (SELECT * FROM events WHERE event_type = 'purchase') p LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND c.ts <= p.ts GROUP BY p.event_id"""
)
def purchase_clicks(spark: SparkSession, sf: str) -> DataFrame:
    """As-of join: the last click before each purchase."""
    rows = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    clicks = rows.where("event_type = 'click'").select("user_id", "ts", F.col("ts").alias("clicked"))
    return J.as_of(rows.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), clicks, "user_id", "ts", "clicked", name="seen").select("event_id", F.col("seen").alias("clicked"))


@query(
    """WITH v AS (SELECT event_id AS id, user_id, epoch_us(ts) / 1e6 AS a, epoch_us(ts) / 1e6 + value * 10 AS b FROM events WHERE event_type = 'view') SELECT x.user_id, x.id AS a, y.id AS b FROM v x JOIN v y ON x.user_id = y.user_id AND x.id < y.id AND x.a < y.b AND y.a < x.b"""
)
def overlapping_views(spark: SparkSession, sf: str) -> DataFrame:
    """J-22: pairs of intervals of a user that overlap."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = table(spark, sf, "events").where("event_type = 'view'").select("event_id", "user_id", seconds.alias("s"), (seconds + F.col("value") * 10).alias("e"))
    return J.overlapping(rows, "user_id", "event_id", "s", "e", width=3600.0)


@query(
    """WITH l AS (SELECT user_id, event_id, event_type, ts FROM events) SELECT a.event_id AS signup, min(b.event_id) AS purchase FROM (SELECT * FROM l WHERE event_type = 'signup') a JOIN (SELECT * FROM l WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR
    WHERE NOT EXISTS (SELECT 1 FROM l c WHERE c.event_type = 'error' AND c.user_id = a.user_id AND c.ts > a.ts AND c.ts < b.ts) GROUP BY a.event_id"""
)
def clean_purchases(spark: SparkSession, sf: str) -> DataFrame:
    """J-15: an order of two rows with the absence of a third between, by the time of the last error instead of a second join."""
    rows = table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    errors = rows.where("event_type = 'error'").select("user_id", "ts", F.col("ts").alias("failed"))
    buys = J.as_of(rows.where("event_type = 'purchase'").select("user_id", "event_id", "ts"), errors, "user_id", "ts", "failed", name="last_error")
    hours = (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).alias("h")
    signs = rows.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("signup"), hours, F.col("ts").alias("since"))
    near = J.near(signs, buys.select("user_id", F.col("event_id").alias("purchase"), hours.alias("h2"), F.col("ts").alias("bought"), "last_error"), "user_id", "h", 6, other="h2")
    # an error at the very time of the purchase lies not between; the error before it may
    return near.where((F.col("bought") > F.col("since")) & (F.col("last_error").isNull() | (F.col("last_error") <= F.col("since")) | (F.col("last_error") >= F.col("bought")))).groupBy("signup").agg(F.min("purchase").alias("purchase"))


@query("SELECT doc_id, CAST(CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 16 AS INTEGER) AS shard FROM documents")
def shard_plan(spark: SparkSession, sf: str) -> DataFrame:
    """X-1: shards by hash."""
    return table(spark, sf, "documents").select("doc_id", I.shard_of(F.col("doc_id").cast("string"), 16).alias("shard"))


@query(
    """WITH p AS (SELECT CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 16 AS shard, coalesce(length(text), 0) AS cost FROM documents), s AS (SELECT shard, sum(cost) AS c, max(cost) AS m FROM p GROUP BY shard)
    SELECT CAST(sum(c) AS BIGINT) AS total, CAST(max(c) AS BIGINT) AS largest, CAST(greatest(max(m), ceil(sum(c) / 16)) AS BIGINT) AS floor, round(max(c) / (sum(c) / 16), 4) AS imbalance FROM s"""
)
def shard_balance(spark: SparkSession, sf: str) -> DataFrame:
    """X-1: how even the shards are."""
    plan = table(spark, sf, "documents").select(I.shard_of(F.col("doc_id").cast("string"), 16).alias("shard"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("cost"))
    return I.balance(plan, "shard", "cost", 16).select("total", "largest", "floor", F.round("imbalance", 4).alias("imbalance"))


@query()
def longest_first_plan(spark: SparkSession, sf: str) -> DataFrame:
    """X-1, W-15: costliest first to the lightest shard (sequential by nature; tested for cover and bound)."""
    return I.longest_first(table(spark, sf, "documents").select("doc_id", F.length("text").alias("n")), "doc_id", "n", 16)


@query(f"WITH p AS (SELECT {k('run_id')} AS item FROM runs WHERE status = 'complete'), own AS (SELECT item, count(*) AS k FROM p WHERE item IS NOT NULL GROUP BY item), w AS (SELECT DISTINCT {k('run_id')} AS w FROM findings WHERE {k('run_id')} IS NOT NULL) SELECT CASE WHEN item IS NULL THEN 'missing' WHEN w IS NULL THEN 'foreign' ELSE 'duplicate' END AS problem, coalesce(item, w) AS item FROM own FULL OUTER JOIN w ON item = w WHERE item IS NULL OR w IS NULL OR k > 1")
def cover_check(spark: SparkSession, sf: str) -> DataFrame:
    """X-2, X-3: whether rows cover what is asked exactly once."""
    plan = table(spark, sf, "runs").where("status = 'complete'").select(norm_key("run_id").alias("item")).where("item is not null")
    wanted = table(spark, sf, "findings").select(norm_key("run_id").alias("w0")).where("w0 is not null")
    return I.cover_problems(plan, "item", wanted, "w0")


@query(
    """WITH c AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq, CAST(o_orderkey AS VARCHAR) AS payload FROM orders) SELECT o_custkey, min(seq) + 1 AS first_broken FROM c WHERE seq % 11 = 0 AND EXISTS (SELECT 1 FROM c d WHERE d.o_custkey = c.o_custkey AND d.seq = c.seq + 1) GROUP BY o_custkey"""
)
def chain_verification(spark: SparkSession, sf: str) -> DataFrame:
    """X-5, X-6: the first broken link of each chain; chains are built from orders and every eleventh link is damaged."""
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    seq = W.occurrence(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], "seq").select("o_custkey", F.col("seq").cast("long").alias("seq"), F.col("o_orderkey").cast("string").alias("payload"))
    whole = W._over(["o_custkey"], ["seq"])
    # each link hashes the payload before it; a damaged link is one whose follower names another digest
    linked = seq.withColumn("digest", F.sha2(F.concat_ws("|", F.lit("x"), "payload"), 256)).withColumn("previous", F.coalesce(F.lag("digest").over(whole), F.lit("")))
    damaged = linked.withColumn("previous", F.when(F.col("seq") % 11 == 1, F.when(F.col("seq") > 1, F.lit("damaged")).otherwise(F.col("previous"))).otherwise(F.col("previous")))
    before = F.coalesce(F.lag("digest").over(whole), F.lit(""))
    return damaged.withColumn("bad", F.col("previous") != before).where("bad").groupBy("o_custkey").agg(F.min("seq").alias("first_broken"))


@query(
    f"""WITH s AS (SELECT {k('root_digest')} AS root, row_id, CAST(findings AS BIGINT) AS seq, semantic_digest FROM runs WHERE findings IS NOT NULL AND {k('root_digest')} IS NOT NULL),
    t AS (SELECT *, max(seq) OVER w AS top, max(ROW(seq, semantic_digest)) OVER w AS known FROM s WINDOW w AS (PARTITION BY root ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT row_id, CASE WHEN top IS NULL OR seq > top THEN 'accepted' WHEN seq < top THEN 'rollback' WHEN semantic_digest = known[2] THEN 'repeated' ELSE 'equivocation' END AS verdict FROM t"""
)
def snapshot_acceptance(spark: SparkSession, sf: str) -> DataFrame:
    """X-10: numbers that must not fall, and must not name two contents."""
    rows = table(spark, sf, "runs").select(norm_key("root_digest").alias("root"), "row_id", F.col("findings").cast("long").alias("seq"), "semantic_digest").where("seq is not null and root is not null")
    return I.acceptance(rows, ["root"], "row_id", "seq", "semantic_digest").select("row_id", "verdict")


_DEPS = "dep AS (SELECT p_partkey AS id, 'pkg' || p_partkey % 40 AS name, (p_size % 5) || '.' || (p_partkey % 9) || '.' || (p_partkey % 4) AS version FROM part), adv(name, spec, id2) AS (VALUES ('pkg3', '<2.5.0', 'A1'), ('pkg7', '>=1.0.0,<3.2.1', 'A2'), ('pkg11', '<0.5.0 || >=3.0.0', 'A3'), ('pkg3', '=4.3.3', 'A4'))"
_ADVISORIES = [("pkg3", "<2.5.0", "A1"), ("pkg7", ">=1.0.0,<3.2.1", "A2"), ("pkg11", "<0.5.0 || >=3.0.0", "A3"), ("pkg3", "=4.3.3", "A4")]
_VER = "[CAST(x AS BIGINT) for x in string_split({0}, '.')]"


@query(
    f"""WITH {_DEPS}, v AS (SELECT id, name, {_VER.format('version')} AS ver FROM dep) SELECT id, id2 AS advisory FROM v JOIN adv USING (name) WHERE (id2 = 'A1' AND ver < [2, 5, 0]) OR (id2 = 'A2' AND ver >= [1, 0, 0] AND ver < [3, 2, 1]) OR (id2 = 'A3' AND (ver < [0, 5, 0] OR ver >= [3, 0, 0])) OR (id2 = 'A4' AND ver = [4, 3, 3])"""
)
def version_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """J-7, S-22: packages whose version meets an advisory's range, joined on the name."""
    p = F.col("p_partkey")
    deps = table(spark, sf, "part").select(p.alias("id"), F.concat(F.lit("pkg"), (p % 40).cast("string")).alias("name"), F.concat_ws(".", (F.col("p_size") % 5).cast("string"), (p % 9).cast("string"), (p % 4).cast("string")).alias("version"))
    feed = F.broadcast(spark.createDataFrame(_ADVISORIES, "n string, spec string, advisory string"))
    return deps.join(feed, F.col("name") == F.col("n")).where(P.in_range(F.col("version"), F.col("spec"))).select("id", "advisory")


@query(
    """SELECT c.call, r.route FROM (SELECT '/' || lower(n_name) || '/' || n_nationkey AS call FROM nation) c JOIN (VALUES ('/france/{id}'), ('/:any/3'), ('/<x>/{y}'), ('/germany')) r(route) ON (r.route = '/france/{id}' AND c.call LIKE '/france/%') OR (r.route = '/:any/3' AND c.call LIKE '/%/3') OR r.route = '/<x>/{y}'"""
)
def route_matches(spark: SparkSession, sf: str) -> DataFrame:
    """J-27: addresses and the templates they fit."""
    calls = table(spark, sf, "nation").select(F.concat(F.lit("/"), F.lower("n_name"), F.lit("/"), F.col("n_nationkey").cast("string")).alias("call"))
    routes = spark.createDataFrame([("/france/{id}",), ("/:any/3",), ("/<x>/{y}",), ("/germany",)], "route string")
    return J.wildcard_paths(calls, "call", routes, "route")


@query(
    """WITH o AS (SELECT p_name, count(*) AS n, min(p_partkey) AS m FROM part GROUP BY p_name), w AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' x' ELSE p_name END AS name FROM part) SELECT id, CASE WHEN n IS NULL THEN 'unlinked' WHEN n = 1 THEN 'linked' ELSE 'ambiguous' END AS state, CASE WHEN n = 1 THEN m END AS match FROM w LEFT JOIN o ON name = p_name"""
)
def name_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """J-20, J-23, J-29, G-10: names resolved only where exactly one candidate exists."""
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    wanted = part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" x"))).otherwise(F.col("p_name")).alias("name"))
    return J.unique_match(wanted, "id", "name", part, "p_partkey", "p_name")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS events, round(sum(value), 2) AS value FROM events GROUP BY ALL")
def stream_hourly_events(spark: SparkSession, sf: str) -> DataFrame:
    """R-7: the tumbling windows as a stream that runs to the end of its files; complete mode, so no window stays open."""
    out = S.to_table(S.hourly(S.read_events(spark, sf)), "complete")
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "events", "value")


@query("SELECT count(*) AS events, count(DISTINCT user_id) AS users FROM events")
def stream_distinct_events(spark: SparkSession, sf: str) -> DataFrame:
    """R-7: repeated events dropped within the watermark."""
    return S.to_table(S.distinct_events(S.read_events(spark, sf)), "append").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("user_id").alias("users"))


@query("SELECT user_id, count(*) AS events, round(CASE WHEN count(*) > 1 THEN (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / (count(*) - 1) END, 4) AS mean_gap FROM events GROUP BY user_id")
def stream_gap_state(spark: SparkSession, sf: str) -> DataFrame:
    """R-5: gaps kept as state of each user."""
    return S.to_table(S.gap_state(S.read_events(spark, sf)), "update").select("user_id", "events", F.round("mean_gap", 4).alias("mean_gap"))


@query("SELECT p.event_id AS purchase, c.event_id AS click FROM events p JOIN events c ON p.user_id = c.user_id AND c.ts <= p.ts AND c.ts >= p.ts - INTERVAL 1 HOUR WHERE p.event_type = 'purchase' AND c.event_type = 'click'")
def stream_click_join(spark: SparkSession, sf: str) -> DataFrame:
    """R-7: two streams joined with time bounds."""
    return S.to_table(S.clicks_before_purchases(S.read_events(spark, sf)), "append")


@query("SELECT rule_id AS rule, path, CAST(line AS INTEGER) AS line, CASE WHEN upper(trim(severity)) IN ('CRITICAL', 'HIGH') THEN 'error' WHEN upper(trim(severity)) = 'MEDIUM' THEN 'warning' ELSE 'note' END AS level FROM code_findings WHERE rule_id IS NOT NULL AND path IS NOT NULL AND line IS NOT NULL")
def sarif_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-3: findings to reports and back."""
    rows = table(spark, sf, "code_findings").where("rule_id is not null and path is not null and line is not null")
    rows = rows.select(F.col("category").alias("run"), F.col("rule_id").alias("rule"), "path", "line", F.upper(F.trim("severity")).alias("sev"), F.col("description").alias("message"))
    return from_sarif(to_sarif(rows, "weftline"), "sarif").select("rule", "path", "line", "level")


@query("""SELECT p_brand AS project, '{"bomFormat":"CycloneDX","specVersion":"1.5","version":1,"components":[' || string_agg('{"type":"library","name":"' || name || '","version":"' || v || '"}', ',' ORDER BY name, v) || ']}' AS bill
    FROM (SELECT DISTINCT p_brand, 'pkg' || p_partkey % 7 AS name, CAST(p_size % 3 AS VARCHAR) AS v FROM part) GROUP BY p_brand""")
def component_bills(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-4: a bill of components for each project."""
    deps = table(spark, sf, "part").select(F.col("p_brand").alias("project"), F.concat(F.lit("pkg"), (F.col("p_partkey") % 7).cast("string")).alias("name"), (F.col("p_size") % 3).cast("string").alias("version"))
    return to_bill(deps, "project")


@query("SELECT table_name AS \"table\", column_index AS position, column_name AS \"column\" FROM (SELECT 'lineitem' AS table_name, CAST(ordinality - 1 AS INTEGER) AS column_index, column_name FROM (SELECT unnest(['l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_quantity', 'l_extendedprice', 'l_discount', 'l_tax', 'l_returnflag', 'l_linestatus', 'l_shipdate']) AS column_name, unnest(range(1, 12)) AS ordinality))")
def table_profile(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-10: the columns of a table without reading a row."""
    return schema_profile(table(spark, sf, "lineitem"), "lineitem").select("table", "position", "column")


@query()
def sql_scan(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-11: statements in SQL texts by what they do."""
    blobs = table(spark, sf, "blobs").where("payload is not null").select("row_id", "payload")
    return sql_statements(blobs, "row_id", "payload")
