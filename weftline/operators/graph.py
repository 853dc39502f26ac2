"""Graph operators as semi-naive loops: each round joins only what the round before added, and cuts its lineage.

Every loop ends by itself, as each round must add something; a bound may be set, and then the loop says whether it came to its end, so a
result that stopped early is never taken for a whole one.

What one task can hold (`ONE_TASK` edges) is worked out there, in time linear in its edges, so that long chains cost no rounds; larger
graphs go round by round. A loop with a bound always goes round by round, as its bound counts rounds.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import cut, ship

#: Edges that one task may hold. A chain of twice as many took 600 MB of its worker.
ONE_TASK = 1 << 19
#: Tasks that may each get a copy of the edges.
MOST_COPIES = 64


@dataclass
class Fixpoint:
    """The rows, the rounds it took (a task that works out the whole is one), and whether nothing was left to add."""

    rows: DataFrame
    rounds: int
    converged: bool

    def whole(self) -> DataFrame:
        """The rows of a loop that came to an end; one that its bound stopped is an error."""
        if not self.converged:
            raise RuntimeError(f"not converged after {self.rounds} rounds")
        return self.rows


def grown(known: DataFrame, fresh: DataFrame, rounds: int) -> DataFrame:
    """Both together. The parts are cut already, so their union is cut itself only every eighth round, and into no more partitions than an exchange has."""
    both = known.unionByName(fresh)
    return cut(both.coalesce(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")))) if rounds % 8 == 0 else both


def reachable(edges: DataFrame, sources: DataFrame, *, src: str = "src", dst: str = "dst", max_rounds: int | None = None) -> Fixpoint:
    """node, hops: everything reachable from `sources` (one column), with the least number of edges. Cycles end by themselves."""
    links = edges.select(F.col(src).alias("_s"), F.col(dst).alias("_d")).where("_s is not null and _d is not null").distinct()
    seen = cut(sources.select(F.col(sources.columns[0]).alias("node")).where("node is not null").distinct().withColumn("hops", F.lit(0)))
    if max_rounds is None:
        links = cut(links)
        if links.count() + seen.count() <= ONE_TASK:
            return Fixpoint(_reached(links, seen), 1, True)
    frontier, rounds = seen, 0
    while max_rounds is None or rounds < max_rounds:
        rounds += 1
        found = frontier.join(links, F.col("node") == F.col("_s")).select(F.col("_d").alias("node")).distinct()
        fresh = cut(found.join(seen.select(F.col("node").alias("_n")), F.col("node") == F.col("_n"), "left_anti").withColumn("hops", F.lit(rounds)))
        if fresh.isEmpty():
            return Fixpoint(seen, rounds, True)
        seen, frontier = grown(seen, fresh, rounds), fresh
    return Fixpoint(seen, rounds, False)


def walk(links: dict, starts: list) -> dict:
    """Node -> least number of edges from any of `starts`; links: node -> the nodes behind its edges."""
    hops, front, n = dict.fromkeys(starts, 0), starts, 0
    while front:
        n += 1
        front = list(dict.fromkeys(d for x in front for d in links.get(x, ()) if d not in hops))
        hops.update(dict.fromkeys(front, n))
    return hops


def _reached(links: DataFrame, starts: DataFrame) -> DataFrame:
    """What `reachable` gives, worked out in one task."""
    ship(links.sparkSession)
    schema = starts.select("node").unionByName(links.select(F.col("_d").alias("node"))).withColumn("hops", F.lit(0)).schema
    kind = schema["node"].dataType

    def solve(edges: pa.Table, sources: pa.Table) -> pa.Table:
        found = walk(_behind(edges), sources["node"].to_pylist())
        return pa.table({"node": pa.array(found.keys(), sources.schema.field("node").type), "hops": pa.array(found.values(), pa.int32())})

    edges = links.select(F.col("_s").cast(kind).alias("s"), F.col("_d").cast(kind).alias("d"), F.lit(0).alias("_p"))
    return cut(edges.groupBy("_p").cogroup(starts.select(F.col("node").cast(kind).alias("node"), F.lit(0).alias("_p")).groupBy("_p")).applyInArrow(solve, schema))


def _behind(edges: pa.Table) -> dict:
    """Node -> the nodes behind its edges (s, d)."""
    out: dict = {}
    for s, d in zip(edges["s"].to_pylist(), edges["d"].to_pylist(), strict=True):
        out.setdefault(s, []).append(d)
    return out


def impacted(edges: DataFrame, changed: DataFrame, *, src: str = "src", dst: str = "dst", max_rounds: int | None = None) -> Fixpoint:
    """Everything that depends on `changed`: reachability against the direction of the edges."""
    return reachable(edges, changed, src=dst, dst=src, max_rounds=max_rounds)


def shortest_paths(edges: DataFrame, sources: DataFrame, *, src: str = "src", dst: str = "dst", max_rounds: int | None = None) -> Fixpoint:
    """node, path: the shortest path from any source; of equal ones the least in order."""
    links = edges.select(F.col(src).alias("_s"), F.col(dst).alias("_d")).where("_s is not null and _d is not null").distinct()
    seen = cut(sources.select(F.col(sources.columns[0]).alias("node")).distinct().withColumn("path", F.array("node")))
    frontier, rounds = seen, 0
    while max_rounds is None or rounds < max_rounds:
        rounds += 1
        found = frontier.join(links, F.col("node") == F.col("_s")).select(F.col("_d").alias("node"), F.concat("path", F.array("_d")).alias("path")).groupBy("node").agg(F.min("path").alias("path"))
        fresh = cut(found.join(seen.select(F.col("node").alias("_n")), F.col("node") == F.col("_n"), "left_anti"))
        if fresh.isEmpty():
            return Fixpoint(seen, rounds, True)
        seen, frontier = grown(seen, fresh, rounds), fresh
    return Fixpoint(seen, rounds, False)


def least_costs(edges: DataFrame, sources: DataFrame, weight: str, *, src: str = "src", dst: str = "dst", max_rounds: int | None = None) -> Fixpoint:
    """node, cost: least sum of weights (not negative) from any source; only nodes whose cost fell are looked at again."""
    links = edges.select(F.col(src).alias("_s"), F.col(dst).alias("_d"), F.col(weight).cast("double").alias("_w"))
    best = cut(sources.select(F.col(sources.columns[0]).alias("node")).distinct().withColumn("cost", F.lit(0.0)))
    frontier, rounds = best, 0
    while max_rounds is None or rounds < max_rounds:
        rounds += 1
        found = frontier.join(links, F.col("node") == F.col("_s")).groupBy(F.col("_d").alias("node")).agg(F.min(F.col("cost") + F.col("_w")).alias("cost"))
        known = best.select(F.col("node").alias("_n"), F.col("cost").alias("_c"))
        fresh = cut(found.join(known, F.col("node") == F.col("_n"), "left").where(F.col("_c").isNull() | (F.col("cost") < F.col("_c"))).select("node", "cost"))
        if fresh.isEmpty():
            return Fixpoint(best, rounds, True)
        best, frontier = cut(best.unionByName(fresh).groupBy("node").agg(F.min("cost").alias("cost"))), fresh
    return Fixpoint(best, rounds, False)


def components(edges: DataFrame, *, src: str = "src", dst: str = "dst", max_rounds: int | None = None) -> Fixpoint:
    """node, component: connected components without direction, named by their least node.

    Each round a node takes the least label around it and then the label of that label, so chains shorten quickly.
    """
    both = edges.select(F.col(src).alias("_a"), F.col(dst).alias("_b")).where("_a is not null and _b is not null")
    both = cut(both.unionByName(both.select(F.col("_b").alias("_a"), F.col("_a").alias("_b"))).distinct())
    labels = cut(both.groupBy(F.col("_a").alias("node")).agg(F.least(F.min("_a"), F.min("_b")).alias("component")))
    rounds = 0
    while max_rounds is None or rounds < max_rounds:
        rounds += 1
        around = both.join(labels, F.col("_b") == F.col("node")).groupBy("_a").agg(F.min("component").alias("_m"))
        step = labels.join(around, F.col("node") == F.col("_a")).select("node", F.least("component", "_m").alias("component"), F.col("component").alias("_old"))
        jump = step.select(F.col("node").alias("_j"), F.col("component").alias("_jc"))
        fresh = cut(step.join(jump, F.col("component") == F.col("_j"), "left").select("node", F.least("component", F.coalesce("_jc", "component")).alias("component"), "_old"))
        moved = fresh.where(F.col("component") != F.col("_old")).isEmpty()
        labels = fresh.drop("_old")
        if moved:
            return Fixpoint(labels, rounds, True)
    return Fixpoint(labels, rounds, False)


def _least_label(nodes: DataFrame, links: DataFrame, max_rounds: int | None) -> DataFrame:
    """node, label: the least label among a node and all that reach it along `links` (s, d).

    A label is (hash of a node, node). Whatever reaches a label's node reaches all that carry the label, so a node also takes
    the label of its label's node, and distances halve every round.
    """
    marks = cut(nodes.select("node", F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("n")).alias("label")))
    rounds = 0
    while max_rounds is None or rounds < max_rounds:
        rounds += 1
        pushed = links.join(marks, F.col("s") == F.col("node")).groupBy(F.col("d").alias("_d")).agg(F.min("label").alias("_p"))
        step = marks.join(pushed, F.col("node") == F.col("_d"), "left").select("node", F.least("label", F.coalesce("_p", "label")).alias("label"), F.col("label").alias("_old"))
        jump = step.select(F.col("node").alias("_j"), F.col("label").alias("_l"))
        fresh = cut(step.join(jump, F.col("label.n") == F.col("_j"), "left").select("node", F.least("label", F.coalesce("_l", "label")).alias("label"), "_old"))
        still = fresh.where("label <> _old").isEmpty()
        marks = fresh.drop("_old")
        if still:
            return marks
    raise RuntimeError(f"labels not settled after {max_rounds} rounds")


def least_members(links: list[tuple]) -> dict:
    """Node -> least node of its strongly connected component, of all nodes of `links` (Tarjan's algorithm without recursion)."""
    out: dict = {}
    for s, d in links:
        out.setdefault(s, []).append(d)
        out.setdefault(d, [])
    order: dict = {}
    low, found, stack = {}, {}, []
    for root in out:
        if root in order:
            continue
        order[root] = low[root] = len(order)
        stack.append(root)
        path = [(root, iter(out[root]))]
        while path:
            node, rest = path[-1]
            for d in rest:
                if d not in order:
                    order[d] = low[d] = len(order)
                    stack.append(d)
                    path.append((d, iter(out[d])))
                    break
                if d not in found:
                    low[node] = min(low[node], order[d])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[node])
                if low[node] == order[node]:
                    members = []
                    while not members or members[-1] != node:
                        members.append(stack.pop())
                    found.update(dict.fromkeys(members, min(members)))
    return found


def strong_components(edges: DataFrame, *, src: str = "src", dst: str = "dst", max_rounds: int | None = None) -> Fixpoint:
    """node, component: strongly connected components, named by their least node.

    A piece of the graph that one task can hold is worked out in a task. Of larger pieces, in each round every node learns the least label
    that reaches it and the least that it reaches. Where both are the same the node lies in the component of that label's node and is done.
    A component never holds nodes with different pairs of labels, so only edges inside a pair stay, which cuts the rest to smaller pieces:
    the number of rounds is logarithmic in expectation.
    """
    links = cut(edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).where("s is not null and d is not null").distinct())
    ends = lambda of: of.select(F.col("s").alias("node")).unionByName(of.select(F.col("d").alias("node"))).distinct()
    left_nodes = cut(ends(links))
    at_most = max(1, left_nodes.rdd.getNumPartitions())
    left, done, rounds = cut(links.where("s <> d").withColumn("piece", F.lit(0).cast("long"))), left_nodes.limit(0).select("node", F.col("node").alias("root")), 0
    while (max_rounds is None or rounds < max_rounds) and not left_nodes.isEmpty():
        rounds += 1
        if max_rounds is None:
            sizes = cut(left.groupBy("piece").agg(F.count(F.lit(1)).alias("_n")))
            fit = sizes.where(F.col("_n") <= ONE_TASK)
            tasks = 4 * (fit.agg(F.sum("_n")).first()[0] or 0) // ONE_TASK + 1
            solved = _in_tasks(left.join(fit.select("piece"), "piece"), tasks, done.schema)
            left = cut(left.join(fit.select("piece"), "piece", "left_anti"))
            alone = left_nodes.join(ends(left), "node", "left_anti").join(solved.select("node"), "node", "left_anti").select("node", F.col("node").alias("root"))
            done = cut(done.unionByName(solved).unionByName(alone).coalesce(at_most))
            left_nodes = cut(ends(left))
            if left_nodes.isEmpty():
                break
        before = _least_label(left_nodes, left, max_rounds).select("node", F.col("label.n").alias("f"))
        after = _least_label(left_nodes, left.select(F.col("d").alias("s"), F.col("s").alias("d")), max_rounds).select(F.col("node").alias("_n"), F.col("label.n").alias("b"))
        pairs = cut(before.join(after, F.col("node") == F.col("_n")).select("node", "f", "b"))
        done = cut(done.unionByName(pairs.where("f = b").select("node", F.col("f").alias("root"))).coalesce(at_most))
        rest = pairs.where("f <> b")
        a, b = rest.select(F.col("node").alias("_a"), F.col("f").alias("fa"), F.col("b").alias("ba")), rest.select(F.col("node").alias("_b"), F.col("f").alias("fb"), F.col("b").alias("bb"))
        # pieces of which the hash is the same go to one task, which keeps them apart by their edges
        left = cut(left.join(a, F.col("s") == F.col("_a")).join(b, F.col("d") == F.col("_b")).where("fa = fb and ba = bb").select("s", "d", F.xxhash64("fa", "ba").alias("piece")))
        left_nodes = cut(rest.select("node"))
    names = done.groupBy("root").agg(F.min("node").alias("component"))
    return Fixpoint(done.join(names, "root").select("node", "component"), rounds, left_nodes.isEmpty())


def _in_tasks(links: DataFrame, tasks: int, schema) -> DataFrame:
    """node, root: least nodes of components of links (s, d, piece); each piece lies in one of the tasks."""
    ship(links.sparkSession)
    kind = schema["node"].dataType

    def solve(rows: pa.Table) -> pa.Table:
        found = least_members(list(zip(rows["s"].to_pylist(), rows["d"].to_pylist(), strict=True)))
        return pa.table({"node": pa.array(found.keys(), rows.schema.field("s").type), "root": pa.array(found.values(), rows.schema.field("s").type)})

    return cut(links.select(F.col("s").cast(kind).alias("s"), F.col("d").cast(kind).alias("d"), F.pmod(F.xxhash64("piece"), F.lit(tasks)).alias("_p")).groupBy("_p").applyInArrow(solve, schema))


def bounded_paths(edges: DataFrame, sources: DataFrame, max_nodes: int, *, src: str = "src", dst: str = "dst") -> DataFrame:
    """path: every simple path from a source with 2 to `max_nodes` nodes, its beginnings included."""
    links = edges.select(F.col(src).alias("_s"), F.col(dst).alias("_d")).distinct()
    front = sources.select(F.array(sources.columns[0]).alias("path"))
    out = None
    for _ in range(max_nodes - 1):
        front = cut(front.join(links, F.element_at("path", -1) == F.col("_s")).where(~F.array_contains("path", F.col("_d"))).select(F.concat("path", F.array("_d")).alias("path")))
        out = front if out is None else out.unionByName(front)
    return out


def propagate(facts: DataFrame, edges: DataFrame, *, max_rounds: int | None = None) -> Fixpoint:
    """node, fact: facts carried along edges (src, dst) to a fixpoint, at most `max_rounds` rounds where that is set."""
    known = cut(facts.select("node", "fact").distinct())
    if max_rounds is None:
        edges = cut(edges.select("src", "dst").distinct())
        n, kinds = edges.count(), known.select("fact").distinct().count()
        # a task has facts of its own and all edges; its rows are at most its facts times the nodes
        if n + known.count() <= ONE_TASK and (tasks := 1 + n * kinds // (2 * ONE_TASK)) <= MOST_COPIES:
            return Fixpoint(_carried(known, edges, tasks), 1, True)
    frontier, rounds = known, 0
    while max_rounds is None or rounds < max_rounds:
        rounds += 1
        found = frontier.join(edges.select("src", "dst"), F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "fact").distinct()
        old = known.select(F.col("node").alias("_n"), F.col("fact").alias("_f"))
        fresh = cut(found.join(old, F.col("node").eqNullSafe(F.col("_n")) & F.col("fact").eqNullSafe(F.col("_f")), "left_anti"))
        if fresh.isEmpty():
            return Fixpoint(known, rounds, True)
        known, frontier = grown(known, fresh, rounds), fresh
    return Fixpoint(known, rounds, False)


def _carried(known: DataFrame, edges: DataFrame, tasks: int) -> DataFrame:
    """What `propagate` gives, each fact worked out whole in one of the tasks."""
    ship(known.sparkSession)
    schema = known.unionByName(edges.select(F.col("dst").alias("node"), F.lit(None).alias("fact"))).schema
    kind = schema["node"].dataType

    def solve(links: pa.Table, rows: pa.Table) -> pa.Table:
        behind, starts, nodes, facts = _behind(links), {}, [], []
        for node, fact in zip(rows["node"].to_pylist(), rows["fact"].to_pylist(), strict=True):
            starts.setdefault(fact, []).append(node)
        for fact, own in starts.items():
            found = walk(behind, own)
            nodes += found
            facts += [fact] * len(found)
        return pa.table({"node": pa.array(nodes, rows.schema.field("node").type), "fact": pa.array(facts, rows.schema.field("fact").type)})

    copies = edges.where("src is not null").select(F.col("src").cast(kind).alias("s"), F.col("dst").cast(kind).alias("d"), F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("_p"))
    parts = known.select(F.col("node").cast(kind).alias("node"), "fact", F.pmod(F.xxhash64("fact"), F.lit(tasks)).cast("int").alias("_p"))
    return cut(copies.groupBy("_p").cogroup(parts.groupBy("_p")).applyInArrow(solve, schema))


def integrity(nodes: DataFrame, edges: DataFrame, *, src: str = "src", dst: str = "dst") -> DataFrame:
    """problem, item: repeated nodes, edges whose ends are no nodes, repeated edges."""
    node = nodes.columns[0]
    own = nodes.select(F.col(node).cast("string").alias("_n"))
    twice = own.groupBy("_n").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(F.lit("repeated node").alias("problem"), F.col("_n").alias("item"))
    ends = edges.select(F.explode(F.array(F.col(src).cast("string"), F.col(dst).cast("string"))).alias("item")).distinct()
    missing = ends.join(own, F.col("item") == F.col("_n"), "left_anti").select(F.lit("missing node").alias("problem"), "item")
    again = edges.groupBy(F.concat_ws("->", F.col(src).cast("string"), F.col(dst).cast("string")).alias("item")).agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(F.lit("repeated edge").alias("problem"), "item")
    return twice.unionByName(missing).unionByName(again)


def spanning_forest(edges: DataFrame, weight: str, *, src: str = "src", dst: str = "dst", max_rounds: int | None = None) -> Fixpoint:
    """src, dst, weight: a lightest spanning forest of the edges taken without direction; equal weights by src, then dst.

    In each round every tree takes its lightest edge to another one, so the number of trees at least halves.
    """
    links = cut(edges.select(F.col(src).alias("s"), F.col(dst).alias("d"), F.col(weight).cast("double").alias("w")).where("s <> d and w is not null").select(F.least("s", "d").alias("s"), F.greatest("s", "d").alias("d"), "w").groupBy("s", "d").agg(F.min("w").alias("w")))
    tree = links.select(F.col("s").alias("node")).unionByName(links.select(F.col("d").alias("node"))).distinct().withColumn("c", F.col("node"))
    chosen, rounds = links.limit(0), 0
    while max_rounds is None or rounds < max_rounds:
        rounds += 1
        a, b = tree.select(F.col("node").alias("_a"), F.col("c").alias("ca")), tree.select(F.col("node").alias("_b"), F.col("c").alias("cb"))
        between = links.join(a, F.col("s") == F.col("_a")).join(b, F.col("d") == F.col("_b")).where("ca <> cb").select("s", "d", "w", "ca", "cb")
        best = between.select("s", "d", "w", F.explode(F.array("ca", "cb")).alias("c")).groupBy("c").agg(F.min(F.struct("w", "s", "d")).alias("e"))
        fresh = cut(best.select("e.s", "e.d", "e.w").distinct())
        if fresh.isEmpty():
            return Fixpoint(chosen.select(F.col("s").alias("src"), F.col("d").alias("dst"), F.col("w").alias("weight")), rounds, True)
        chosen = cut(chosen.unionByName(fresh))
        joined = components(chosen, src="s", dst="d").whole().select(F.col("node").alias("_n"), "component")
        tree = cut(tree.join(joined, F.col("node") == F.col("_n"), "left").select("node", F.coalesce("component", "c").alias("c")))
    return Fixpoint(chosen.select(F.col("s").alias("src"), F.col("d").alias("dst"), F.col("w").alias("weight")), rounds, False)
