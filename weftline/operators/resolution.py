"""Names, references and requirements resolved against what there is: in a fixed order of preference, and only where the answer is unique.

Each step is a join by equality on keys of its own; requests are reduced to distinct ones first, so a name that a
third of all rows use is resolved once.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.session import ship


def _unique(names: DataFrame, key: list[str], value: str, out: str) -> DataFrame:
    """The only value of each key; keys with several are left out."""
    return names.groupBy(*key).agg(F.countDistinct(value).alias("_n"), F.min(value).alias(out)).where("_n = 1").drop("_n")


def resolve_calls(calls: DataFrame, definitions: DataFrame, aliases: DataFrame) -> DataFrame:
    """module, callee, target, how: what a name that a module calls stands for.

    `calls`: module, callee. `definitions`: name (module and path within, between dots). `aliases`: module, alias,
    stands_for. In this order: the name in its own module (`own`), the only definition of its last part there
    (`module`), what an alias of its first part stands for, or the only definition with that last part below the alias's
    outermost module (`alias`), the only definition of the last part anywhere (`global`); else '' (`none`). Null modules
    and callees resolve to nothing; repeated calls come out once.
    """
    last = lambda c: F.regexp_extract(c, r"([^.]*)$", 1)
    first = lambda c: F.substring_index(c, ".", 1)
    asked = calls.select("module", "callee").where("module is not null and callee is not null and callee <> ''").distinct()
    asked = asked.withColumns({"_own": F.concat_ws(".", "module", "callee"), "_short": last(F.col("callee")), "_head": first(F.col("callee"))})
    asked = asked.withColumn("_tail", F.expr("substring(callee, length(_head) + 2)"))
    named = definitions.select("name").where("name is not null").distinct()
    names = named.select("name", first(F.col("name")).alias("_m"), last(F.col("name")).alias("_s"))
    exact = lambda column, out: named.select(F.col("name").alias(out), F.lit(True).alias(f"{out}_is"))
    in_module = _unique(names, ["_m", "_s"], "name", "_one")
    anywhere = _unique(names, ["_s"], "name", "_any").withColumnRenamed("_s", "_as")
    known = aliases.select(F.col("module").alias("_am"), F.col("alias").alias("_aa"), "stands_for").groupBy("_am", "_aa").agg(F.min("stands_for").alias("stands_for"))
    step = asked.join(exact("_own", "_x"), F.col("_own") == F.col("_x"), "left")
    step = step.join(in_module, (F.col("module") == F.col("_m")) & (F.col("_short") == F.col("_s")), "left").drop("_m", "_s")
    step = step.join(known, (F.col("module") == F.col("_am")) & (F.col("_head") == F.col("_aa")), "left")
    step = step.withColumn("_by", F.when(F.col("stands_for").isNotNull(), F.concat_ws(".", "stands_for", F.when(F.col("_tail") != "", F.col("_tail")))))
    step = step.withColumns({"_root": first(F.col("stands_for")), "_bs": last(F.col("_by"))})
    step = step.join(exact("_by", "_y"), F.col("_by") == F.col("_y"), "left")
    step = step.join(in_module.select(F.col("_m").alias("_rm"), F.col("_s").alias("_rs"), F.col("_one").alias("_below")), (F.col("_root") == F.col("_rm")) & (F.col("_bs") == F.col("_rs")), "left")
    step = step.join(anywhere, F.col("_short") == F.col("_as"), "left")
    how = F.when(F.col("_x").isNotNull(), "own").when(F.col("_one").isNotNull(), "module").when(F.col("_y").isNotNull() | F.col("_below").isNotNull(), "alias").when(F.col("_any").isNotNull(), "global").otherwise("none")
    return step.select("module", "callee", F.coalesce("_x", "_one", "_y", "_below", "_any", F.lit("")).alias("target"), how.alias("how"))


def resolve_imports(imports: DataFrame, files: DataFrame, endings: list[str]) -> DataFrame:
    """path, specifier, target: the file that a relative import names.

    `imports`: path, specifier (beginning with a dot). `files`: path. Candidates in this order: the place itself with no ending,
    with each of `endings`, then index files with each of them. Specifiers that leave the tree or name no file are left
    out; others than relative ones too.
    """
    asked = imports.select("path", "specifier").where("path is not null and specifier like '.%'").distinct()
    parts = F.filter(F.split(F.concat_ws("/", F.when(F.col("path").contains("/"), F.regexp_replace("path", r"/[^/]*$", "")), "specifier"), "/"), lambda p: (p != "") & (p != "."))
    # a step up takes the last part away; one too many makes the place null for good
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda at, p: F.when(p != "..", F.concat(at, F.array(p))).when(F.size(at) > 0, F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0)))))
    tries = ["", *endings, *[f"/index{e}" for e in endings]]
    placed = asked.withColumn("_base", F.array_join(walked, "/")).where("_base is not null")
    options = placed.select("path", "specifier", "_base", F.posexplode(F.array(*[F.lit(t) for t in tries])).alias("_at", "_ending")).withColumn("_place", F.concat("_base", "_ending"))
    found = options.join(files.select(F.col("path").alias("_file")).distinct(), F.col("_place") == F.col("_file"))
    return found.groupBy("path", "specifier").agg(F.min(F.struct("_at", "_file"))["_file"].alias("target"))


def link_evidence(evidence: DataFrame, targets: DataFrame) -> DataFrame:
    """evidence, state, target: `linked` where exactly one target fits, `ambiguous` with several, `unlinked` with none.

    `evidence`: evidence, ref, locator. `targets`: target, locator. A ref names a target by itself; without one that exists the
    locator decides. Nulls fit nothing.
    """
    known = targets.select(F.col("target").alias("_t")).where("_t is not null").distinct()
    at = targets.where("locator is not null and target is not null").groupBy(F.col("locator").alias("_l")).agg(F.countDistinct("target").alias("_n"), F.min("target").alias("_m"))
    both = evidence.select("evidence", "ref", "locator").join(known, F.col("ref") == F.col("_t"), "left").join(at, F.col("locator") == F.col("_l"), "left")
    n = F.when(F.col("_t").isNotNull(), 1).otherwise(F.coalesce("_n", F.lit(0)))
    state = F.when(n == 1, "linked").when(n > 1, "ambiguous").otherwise("unlinked")
    return both.select("evidence", state.alias("state"), F.when(n == 1, F.coalesce("_t", "_m")).alias("target"))


def reachability_grades(findings: DataFrame, paths: DataFrame, entry_points: DataFrame) -> DataFrame:
    """finding, grade, paths, hops: what the paths from entry points say of each finding.

    `findings`: finding, project. `paths`: finding, gated, hops. `entry_points`: project. `behind authentication` if all paths to the
    finding are gated, `unauthenticated` if any is not (an unknown gate is none); without a path `no path` where the project has entry points,
    and `unknown` where it has none, as nothing was learned.
    """
    reached = paths.where("finding is not null").groupBy(F.col("finding").alias("_f")).agg(F.count(F.lit(1)).alias("paths"), F.bool_and(F.coalesce("gated", F.lit(False))).alias("_gated"), F.min("hops").alias("hops"))
    entered = entry_points.select(F.col("project").alias("_p")).where("_p is not null").distinct()
    both = findings.select("finding", "project").join(reached, F.col("finding") == F.col("_f"), "left").join(entered, F.col("project") == F.col("_p"), "left")
    grade = F.when(F.col("_gated"), "behind authentication").when(F.col("paths").isNotNull(), "unauthenticated").when(F.col("_p").isNotNull(), "no path").otherwise("unknown")
    return both.select("finding", grade.alias("grade"), F.coalesce("paths", F.lit(0)).alias("paths"), "hops")


def adjudicate(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """finding, class, reasons: supported, contested or insufficient.

    `findings`: finding. `evidence`: finding, source, stance ('support' or 'contest'; others decide nothing). Anything that contests, or a
    source that says both, makes a finding contested.
    """
    said = evidence.where("stance in ('support', 'contest')").groupBy(F.col("finding").alias("_f"), "source").agg(F.bool_or(F.col("stance") == "support").alias("_s"), F.bool_or(F.col("stance") == "contest").alias("_c"))
    per = said.groupBy("_f").agg(F.bool_or("_s").alias("_s"), F.bool_or("_c").alias("_c"), F.bool_or(F.col("_s") & F.col("_c")).alias("_both"))
    both = findings.select("finding").distinct().join(per, F.col("finding") == F.col("_f"), "left")
    s, c, x = (F.coalesce(n, F.lit(False)) for n in ("_s", "_c", "_both"))
    reasons = F.concat_ws(",", F.when(c, "contesting evidence"), F.when(x, "contradiction"), F.when(~s & ~c, "no decisive evidence"), F.when(s, "supporting evidence"))
    return both.select("finding", F.when(c, "contested").when(s, "supported").otherwise("insufficient").alias("class"), reasons.alias("reasons"))


def gap_rows(counts: dict[str, DataFrame]) -> DataFrame:
    """gap, n: the one-row counts (column n) that are not 0."""
    out = None
    for name, one in counts.items():
        row = one.select(F.lit(name).alias("gap"), F.col("n").cast("long").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out.where("n > 0")


def eligible(workers: DataFrame, shifts: DataFrame) -> DataFrame:
    """shift, worker: who has the role of a shift and is there for all of it.

    `workers`: worker, roles (array), hours (map from day to [from, to]). `shifts`: shift, role (null: anyone), day, start, end. The join is by role and
    day, the hours are a predicate on its rows.
    """
    there = workers.select("worker", "roles", F.explode("hours").alias("_day", "_h"))
    roles = there.select("worker", "_day", "_h", F.explode(F.concat("roles", F.array(F.lit("")))).alias("_role"))
    asked = shifts.select("shift", F.coalesce("role", F.lit("")).alias("_asked"), "day", "start", "end")
    both = asked.join(roles, (F.col("_asked") == F.col("_role")) & (F.col("day") == F.col("_day")))
    return both.where((F.col("start") >= F.col("_h")[0]) & (F.col("end") <= F.col("_h")[1])).select("shift", "worker").distinct()


def assign_shifts(workers: DataFrame, shifts: DataFrame, *, site: str = "site", cap: float = 0.0) -> DataFrame:
    """site, shift, worker, cost: shifts filled one after another (by day and start), each by the workers of least priority number, hours so far and rate.

    `workers`: site, worker, roles, hours, rate, most, priority. `shifts`: site, shift, role, day, start, end, least, most. Nobody works two shifts at
    once, over their hours, or beyond `cap` of a site's cost (0: none). A shift with fewer than `least` gets a row with a null worker. Sites
    are independent, and one site is one task by nature of the rule; equal workers go by name, equal shifts by theirs.
    """
    ship(workers.sparkSession)

    def fill(key: tuple, staff: pa.Table, work: pa.Table) -> pa.Table:
        own = [r | {"used": 0.0, "busy": []} for r in staff.to_pylist()]
        rows, spent = [], 0.0
        for s in sorted(work.to_pylist(), key=lambda r: (r["day"], r["start"], str(r["shift"]))):
            length, filled = max(s["end"] - s["start"], 0), 0
            for w in sorted(own, key=lambda r: (r["priority"], r["used"], r["rate"], str(r["worker"]))):
                if filled >= s["most"]:
                    break
                hours = dict(w["hours"] or []).get(s["day"])
                fits = (not s["role"] or s["role"] in (w["roles"] or [])) and hours and hours[0] <= s["start"] and s["end"] <= hours[1]
                if not fits or w["used"] + length > w["most"] or any(a < s["end"] and s["start"] < b for d, a, b in w["busy"] if d == s["day"]) or cap and spent + length * w["rate"] > cap:
                    continue
                w["used"] += length
                w["busy"].append((s["day"], s["start"], s["end"]))
                spent += length * w["rate"]
                rows.append((str(s["shift"]), str(w["worker"]), round(length * w["rate"], 2)))
                filled += 1
            if filled < s["least"]:
                rows.append((str(s["shift"]), None, None))
        return pa.table({"site": pa.array([str(key[0].as_py())] * len(rows), pa.string()), "shift": pa.array([r[0] for r in rows], pa.string()), "worker": pa.array([r[1] for r in rows], pa.string()), "cost": pa.array([r[2] for r in rows], pa.float64())})

    return workers.groupBy(site).cogroup(shifts.groupBy(site)).applyInArrow(fill, "site string, shift string, worker string, cost double")


@F.udf(T.DoubleType(), useArrow=True)
def sequence_ratio(a: str, b: str) -> float:
    """The matching-blocks similarity of two texts, without regard to case; null where one is null."""
    return None if a is None or b is None else SequenceMatcher(None, a.lower(), b.lower()).ratio()


def edit_similarity(a: Column, b: Column) -> Column:
    """1 minus the edit distance over the longer length: the same kind of measure in generated code."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def squat_forms(name: Column) -> Column:
    """The names that a look-alike of a package may stand for."""
    cut_s = F.when((F.length(name) > 3) & name.endswith("s"), F.regexp_replace(name, "s$", "")).otherwise(name)
    cut_py = F.when(name.startswith("py"), F.replace(name, F.lit("py"), F.lit(""))).otherwise(name)
    forms = [F.replace(name, F.lit("-"), F.lit("_")), F.replace(name, F.lit("_"), F.lit("-")), F.replace(name, F.lit("-"), F.lit("")), F.replace(name, F.lit("_"), F.lit("")), F.concat(name, F.lit("s")), cut_s]
    return F.array(*forms, F.concat(F.lit("python-"), name), F.concat(F.lit("py"), name), F.concat(name, F.lit("-python")), F.concat(name, F.lit("-py")), F.replace(name, F.lit("python"), F.lit("")), cut_py)


def look_alikes(packages: DataFrame, package: str, popular: list[str], *, least: float = 0.85) -> DataFrame:
    """package, popular, rule, similarity: names that are nearly, derived from or part of a popular one.

    `popular` is a fixed list; every distinct package is compared with it in one projection, without a join.
    """
    own = packages.select(F.regexp_replace(F.lower(F.col(package)), "-", "_").alias("package")).where("package is not null").distinct()
    pairs = own.select("package", F.explode(F.array(*[F.lit(p.lower().replace("-", "_")) for p in popular])).alias("popular")).where("package <> popular")
    a, b = F.col("package"), F.col("popular")
    near = F.when(edit_similarity(a, b) >= least, F.struct(F.lit("similar").alias("rule"), F.round(edit_similarity(a, b), 4).alias("similarity")))
    form = F.when(F.array_contains(squat_forms(a), b), F.struct(F.lit("derived").alias("rule"), F.lit(0.95).alias("similarity")))
    part = F.when((F.length(a) > 3) & (F.length(b) > 3) & (F.contains(a, b) | F.contains(b, a)) & (F.abs(F.length(a) - F.length(b)) <= 3), F.struct(F.lit("part").alias("rule"), F.lit(0.7).alias("similarity")))
    return pairs.select("package", "popular", F.explode(F.filter(F.array(near, form, part), lambda x: x.isNotNull())).alias("r")).select("package", "popular", "r.rule", "r.similarity")


def expand_catalog(profiles: DataFrame, sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """rule, language, profile, source, sink: every source of a profile with every sink of its language; the catalog is what the sizes of its lists make it."""
    rows = profiles.join(sources, "profile").join(sinks, "language")
    return rows.select(F.concat_ws("-", "profile", "source", "sink").alias("rule"), "language", "profile", "source", "sink")


def rule_matches(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """rule, row, name: facts that meet a rule of a pack.

    `rules`: rule, kind, names (array), cwes (array, null: any). `facts`: row, kind, name, cwe. Rules are data: each is unfolded to its names and
    joined by kind and name.
    """
    unfolded = rules.select("rule", F.col("kind").alias("_k"), F.explode("names").alias("_n"), "cwes")
    met = facts.join(unfolded, (F.col("kind") == F.col("_k")) & (F.col("name") == F.col("_n")))
    return met.where(F.col("cwes").isNull() | F.array_contains("cwes", F.col("cwe"))).select("rule", "row", "name")


def pack_errors(rules: DataFrame, fixtures: DataFrame) -> DataFrame:
    """rule, problem: rules of a pack that may not be used: no positive or negative fixture, or one that comes out wrong.

    `fixtures`: rule, positive, kind, name, cwe.
    """
    hit = rule_matches(fixtures.select(F.struct("rule", "positive", "kind", "name", "cwe").alias("row"), "kind", "name", "cwe"), rules).where("rule = row.rule").select("row").distinct().select("row.*", F.lit(True).alias("_hit"))
    keys = ["rule", "positive", "kind", "name", "cwe"]
    checked = fixtures.alias("f").join(hit.alias("h"), [F.col(f"f.{c}").eqNullSafe(F.col(f"h.{c}")) for c in keys], "left").select(*[F.col(f"f.{c}").alias(c) for c in keys], F.coalesce("_hit", F.lit(False)).alias("_hit"))
    per = checked.groupBy(F.col("rule").alias("_r")).agg(
        F.coalesce(F.bool_or("positive"), F.lit(False)).alias("_p"), F.coalesce(F.bool_or(~F.col("positive")), F.lit(False)).alias("_q"), F.bool_or(F.col("positive") & ~F.col("_hit")).alias("_missed"), F.bool_or(~F.col("positive") & F.col("_hit")).alias("_wrong")
    )
    no = lambda c: ~F.coalesce(c, F.lit(False))
    problems = F.array(F.when(no(F.col("_p")), "no positive fixture"), F.when(no(F.col("_q")), "no negative fixture"), F.when(F.col("_missed"), "positive fixture missed"), F.when(F.col("_wrong"), "negative fixture met"))
    return rules.select("rule").join(per, F.col("rule") == F.col("_r"), "left").select("rule", F.explode(F.filter(problems, lambda x: x.isNotNull())).alias("problem"))


def ranked_split(df: DataFrame, group: str, seed: int, share: float = 0.8) -> DataFrame:
    """`df` with `part`: the groups in the order of a hash of seed and name, the first `share` of them for train.

    The cut is at a rank, so it is exact at every size. Ranks come from counts per hash prefix and the order inside one prefix; no task
    sorts all groups. Rows without group are left out.
    """
    names = df.select(F.col(group).alias("_g")).where("_g is not null").distinct().withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}\t"), F.col("_g").cast("string")), 256)).withColumn("_x", F.substring("_h", 1, 3))
    sizes = names.groupBy(F.col("_x").alias("_y")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_y", (F.sum("_n").over(Window.orderBy("_y")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    ranked = names.withColumn("_in", F.row_number().over(Window.partitionBy("_x").orderBy("_h", "_g"))).join(before, F.col("_x") == F.col("_y"))
    parts = ranked.select("_g", F.when(F.col("_before") + F.col("_in") <= F.floor(F.col("_all") * share), "train").otherwise("test").alias("part"))
    return df.join(parts, F.col(group) == F.col("_g")).drop("_g")


def local_flows(code: DataFrame, row: str, text: str, sources: list[str], sinks: list[str], cleaners: list[str]) -> DataFrame:
    """row, line, sink: calls of a sink that get a value which a source gave, line after line.

    An assignment makes its name carry what its right side has (a source call or a name that carries) and takes it away otherwise; a
    cleaner around the argument stops it. Each text begins anew, and so does each function that starts at the left margin.
    """
    import re

    ship(code.sparkSession)
    call = lambda names: re.compile(r"(?<![\w.])(?:" + "|".join(map(re.escape, names)) + r")\s*\(")
    source, cleaner = call(sources), call(cleaners)
    sink = re.compile(r"(?<![\w.])(" + "|".join(map(re.escape, sinks)) + r")\s*\((.*)")
    assign, word = re.compile(r"^\s*([A-Za-z_]\w*)\s*=(?!=)\s*(.*)$"), re.compile(r"[A-Za-z_]\w*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, lines, met = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                carried: set[str] = set()
                for n, line in enumerate((t or "").split("\n"), 1):
                    if line.startswith("def "):
                        carried = set()
                    if m := sink.search(line):
                        argument = m.group(2)
                        if not cleaner.match(argument.lstrip()) and (source.search(argument) or carried & set(word.findall(argument))):
                            at.append(i)
                            lines.append(n)
                            met.append(m.group(1))
                    if m := assign.match(line):
                        value = m.group(2)
                        gives = not cleaner.match(value) and (source.search(value) or carried & set(word.findall(value)))
                        (carried.add if gives else carried.discard)(m.group(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(lines, pa.int32()), pa.array(met, pa.string())], names=[row, "line", "sink"])

    return code.select(row, text).mapInArrow(run, f"{row} {dict(code.dtypes)[row]}, line int, sink string")


def perceptron(rows: list[tuple[dict[str, float], int]], *, rounds: int = 5) -> tuple[dict[str, float], list[tuple[int, int, int, int]]]:
    """Weights, and a ledger (round, row, said, was) of every mistake that changed them.

    Each change depends on all before, so it runs on the driver over a bounded sample of labelled rows (features, 1 or -1); it ends
    early after a round without a mistake.
    """
    weights: dict[str, float] = {}
    ledger: list[tuple[int, int, int, int]] = []
    for r in range(rounds):
        mistakes = 0
        for i, (features, was) in enumerate(rows):
            said = 1 if sum(weights.get(k, 0.0) * v for k, v in features.items()) > 0 else -1
            if said != was:
                mistakes += 1
                ledger.append((r, i, said, was))
                for k, v in features.items():
                    weights[k] = weights.get(k, 0.0) + was * v
        if not mistakes:
            break
    return weights, ledger
