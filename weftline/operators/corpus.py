"""Operators on collections of texts: rule scans, weights, duplicates, splits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as T


def scan_lines(df: DataFrame, row: str, text: str, rules: list[tuple[str, str]]) -> DataFrame:
    """row, line_no, rule for every line that meets a rule (name, pattern).

    All patterns are tried on a line in one projection; lines are never joined with the rules.
    """
    per_line = df.select(row, F.posexplode(F.split(F.col(text), "\n")).alias("_at", "_line"))
    hits = F.filter(F.array(*[F.when(F.col("_line").rlike(pattern), F.lit(name)) for name, pattern in rules]), lambda r: r.isNotNull())
    return per_line.select(row, (F.col("_at") + 1).alias("line_no"), F.explode(hits).alias("rule"))


def tf_idf(df: DataFrame, row: str, words: Column) -> DataFrame:
    """row, word, weight: term share times ln((N + 1) / (df + 1)) + 1."""
    per = df.select(row, F.explode(words).alias("word")).groupBy(row, "word").agg(F.count(F.lit(1)).alias("n"))
    length = per.groupBy(F.col(row).alias("_r")).agg(F.sum("n").alias("len"))
    seen = per.groupBy(F.col("word").alias("_w")).agg(F.count(F.lit(1)).alias("df"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    idf = F.log((F.col("_total") + 1) / (F.col("df") + 1)) + 1
    return per.join(length, F.col(row) == F.col("_r")).join(seen, F.col("word") == F.col("_w")).join(F.broadcast(total)).select(row, "word", (F.col("n") / F.col("len") * idf).alias("weight"))


def duplicate_groups(df: DataFrame, row: str, text: Column) -> DataFrame:
    """row, group, copies: rows with equal text share the smallest row as group; null texts are left out."""
    keyed = df.select(row, F.sha2(text, 256).alias("_h")).where(F.col("_h").isNotNull())
    groups = keyed.groupBy("_h").agg(F.min(row).alias("group"), F.count(F.lit(1)).alias("copies"))
    return keyed.join(groups, "_h").select(row, "group", "copies")


def shared_windows(df: DataFrame, row: str, text: Column, size: int) -> DataFrame:
    """row, first, last: maximal runs of lines that lie in windows of `size` lines which another row has too.

    Windows are matched by hash through one aggregation; no pairs of rows are formed. Lines count from 1.
    """
    cut = F.transform(T.lines(text), lambda x: T.collapse(x))
    windows = df.select(row, F.posexplode(T.ngrams(cut, size, "\n")).alias("_at", "_w")).select(row, F.col("_at").cast("long").alias("_at"), F.xxhash64("_w").alias("_h"), F.md5("_w").alias("_m"))
    shared = windows.groupBy("_h", "_m").agg(F.min(row).alias("_a"), F.max(row).alias("_b")).where("_a <> _b").select("_h", "_m")
    starts = windows.join(shared, ["_h", "_m"], "left_semi").select(row, "_at").distinct()
    # windows that touch or overlap belong to one run
    w = Window.partitionBy(row).orderBy("_at")
    fresh = F.when(F.col("_at") - F.lag("_at").over(w) <= size, 0).otherwise(1)
    runs = starts.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(row, "_run").agg((F.min("_at") + 1).alias("first"), (F.max("_at") + size).alias("last")).drop("_run")


def split_variants(source: Column) -> Column:
    """flawed, fixed of a text with blocks `#ifndef OMITBAD` and `#ifndef OMITGOOD` to their `#endif`; null unless it has both."""
    block = lambda name: rf"(?s)#ifndef {name}\b(.*?)#endif[ \t]*(?:/\*[^\n]*?\*/)?"
    without = lambda gone, kept: F.regexp_replace(F.regexp_replace(source, block(gone), ""), block(kept), "$1")
    both = source.rlike(block("OMITBAD")) & source.rlike(block("OMITGOOD"))
    return F.when(both, F.struct(without("OMITGOOD", "OMITBAD").alias("flawed"), without("OMITBAD", "OMITGOOD").alias("fixed")))


def weighted_cosines(df: DataFrame, row: str, words: Column, patterns: DataFrame, *, least: float) -> DataFrame:
    """row, pattern, score of pairs with a cosine of term weights of `least` or more (to four places). `patterns`: pattern, text; a short list, broadcast.

    A term weighs its count times ln((N + 1) / (df + 1)) + 1; terms that no row has weigh their count. Only terms of patterns reach the join;
    the lengths of the rows come from one aggregation.
    """
    per = df.select(row, F.explode(words).alias("word")).groupBy(row, "word").agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    seen = per.groupBy(F.col("word").alias("_w")).agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(total)).select("_w", (F.log((F.col("_total") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    own = per.join(seen, F.col("word") == F.col("_w")).select(row, "word", (F.col("n") * F.col("idf")).alias("x"))
    terms = patterns.select("pattern", F.explode(T.words(F.col("text"))).alias("t")).groupBy("pattern", "t").agg(F.count(F.lit(1)).alias("n"))
    weights = terms.join(seen, F.col("t") == F.col("_w"), "left").select("pattern", "t", (F.col("n") * F.coalesce("idf", F.lit(1.0))).alias("y"))
    lengths = weights.groupBy(F.col("pattern").alias("_p")).agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("_lp"))
    norm = own.groupBy(F.col(row).alias("_r")).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("_l"))
    dots = own.join(F.broadcast(weights), F.col("word") == F.col("t")).groupBy(row, "pattern").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    scored = dots.join(norm, F.col(row) == F.col("_r")).join(F.broadcast(lengths), F.col("pattern") == F.col("_p")).select(row, "pattern", F.round(F.col("dot") / F.col("_l") / F.col("_lp"), 4).alias("score"))
    return scored.where(F.col("score") >= least)


def near_duplicates(df: DataFrame, row: str, text: Column, *, words: int = 5, least: float = 0.8, shingles: Column | None = None) -> DataFrame:
    """row, group, links: row's class of equal shingle sets, and the number of other classes with a similarity of `least` or more.

    Similarity is the Jaccard measure of word shingles. Rows with the same set form one class, so copies are never paired.
    Two similar sets share a shingle among the rarest |S| - ceil(least |S|) + 1 of each, hence only those are joined, by their hash and within
    neighbouring steps of size. Sizes must fit, and so must 256 bits of each set: every shingle turns over one bit, so the bits in which two sets
    differ are never more than the shingles in which they do. Every candidate is then verified on its whole sets. Texts without a shingle stand alone.
    """
    sets = df.select(row, F.array_sort(F.array_distinct(T.ngrams(T.words(text), words) if shingles is None else shingles)).alias("_s"))
    keyed = sets.withColumn("_k", F.when(F.size("_s") > 0, F.sha2(F.array_join("_s", "\n"), 256)))
    members = keyed.where("_k is not null").groupBy("_k").agg(F.min(row).alias("group"), F.any_value("_s").alias("_s"))
    placed = members.select("group", F.explode("_s").alias("_t")).select("group", F.xxhash64("_t").alias("_t"))
    frequency = placed.groupBy("_t").agg(F.count(F.lit(1)).alias("_f"))
    # the low bits of the hash choose one bit of four words
    bits = [F.bit_xor(F.expr(f"if(shiftright(_t, 6) & 3 = {i}, shiftleft(1L, cast(_t & 63 as int)), 0L)")).alias(f"_w{i}") for i in range(4)]
    ranked = placed.join(frequency, "_t").groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("_f", "_t"))), lambda x: x["_t"]).alias("_o"), *bits)
    n = F.size("_o")
    # a step is a little more than log(1 / least), so that sizes that fit lie in the same step or the next
    step = F.floor(F.log(n.cast("double")) / max(-math.log(least) * (1 + 1e-6), 1e-3))
    prefix = ranked.select("group", n.alias("_n"), step.alias("_z"), *[f"_w{i}" for i in range(4)], F.explode(F.slice("_o", F.lit(1), (n - F.ceil(n * least - 1e-9) + 1).cast("int"))).alias("_t"))
    side = lambda x, z: prefix.select(F.col("group").alias(x), F.col("_n").alias(f"_n{x}"), z.alias(f"_z{x}"), F.col("_t").alias(f"_t{x}"), *[F.col(f"_w{i}").alias(f"_w{i}{x}") for i in range(4)])
    a, b = side("a", F.col("_z")), side("b", F.explode(F.array(F.col("_z"), F.col("_z") - 1)))
    smaller = (F.col("_na") < F.col("_nb")) | ((F.col("_na") == F.col("_nb")) & (F.col("a") < F.col("b")))
    differ = sum((F.bit_count(F.col(f"_w{i}a").bitwiseXOR(F.col(f"_w{i}b"))) for i in range(1, 4)), F.bit_count(F.col("_w0a").bitwiseXOR(F.col("_w0b"))))
    fits = smaller & (F.col("_na") >= least * F.col("_nb")) & (differ * (1 + least) <= (F.col("_na") + F.col("_nb")) * (1 - least) + 1e-6)
    pairs = a.join(b, (F.col("_ta") == F.col("_tb")) & (F.col("_za") == F.col("_zb")) & fits).select("a", "b").distinct()
    own = members.select("group", "_s")
    checked = pairs.join(own.select(F.col("group").alias("a"), F.col("_s").alias("_x")), "a").join(own.select(F.col("group").alias("b"), F.col("_s").alias("_y")), "b")
    common = F.size(F.array_intersect("_x", "_y"))
    similar = checked.where(common >= least * (F.size("_x") + F.size("_y") - common)).select("a", "b")
    links = similar.select(F.explode(F.array("a", "b")).alias("_g")).groupBy("_g").agg(F.count(F.lit(1)).alias("links"))
    classes = keyed.select(row, "_k").join(members.select("_k", "group"), "_k", "left").select(row, F.coalesce("group", row).alias("group"))
    return classes.join(links, F.col("group") == F.col("_g"), "left").select(row, "group", F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def group_split(df: DataFrame, group: str, seed: str, share: int = 80) -> DataFrame:
    """`df` with `part`: train or test by a hash of seed and group, so a group never lies in both. `share`: percent for train."""
    bits = F.conv(F.substring(F.sha2(F.concat_ws("\t", F.lit(seed), F.col(group).cast("string")), 256), 1, 8), 16, 10).cast("long")
    return df.withColumn("part", F.when(F.pmod(bits, F.lit(100)) < share, "train").otherwise("test"))


def joined_texts(df: DataFrame, key: str, order: list[str], text: str, *, per: int = 256) -> DataFrame:
    """key, chunk, parts, missing, text: the texts of each key with at least two rows, joined by newlines in `order`.

    A chunk holds `per` parts, so a hot key never makes one huge row; the chunks of a key, joined by newlines in their order, are its whole
    text. missing: parts of the key without text; as the whole can't be read then, its text is null.
    """
    sizes = df.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col(text).isNull()).alias("missing")).where("_n >= 2")
    placed = df.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).select(key, "_i", F.floor(F.col("_i") / per).alias("chunk"), F.col(text).alias("_t"))
    chunks = placed.groupBy(key, "chunk").agg(F.count(F.lit(1)).alias("parts"), F.array_sort(F.collect_list(F.struct("_i", "_t"))).alias("_a"))
    joined = F.array_join(F.transform("_a", lambda x: x["_t"]), "\n")
    return chunks.join(sizes, F.col(key) == F.col("_k")).select(key, "chunk", "parts", "missing", F.when(F.col("missing") == 0, joined).alias("text"))


def fuse_ranks(hits: DataFrame, url: str, query: str, rank: str, overlap: str) -> DataFrame:
    """url, score, queries of hits from several searches: max(0, 120 - 3 rank) + 8 overlap + 5 for https, folded in the order of query and rank.

    A further query adds 18; every further hit leaves the greater of both scores, plus 4. With m hits of scores s1, s2, ... the hits of a query
    turn a score x into max(x + 18 + 4 m, max(sk + 4 (m - k + 1))), and the first query of an address into the greater of s1 + 4 (m - 1) and the
    same maximum from k = 2 on. So a query is folded by an aggregation, and the score is the greatest such maximum plus what the later queries
    add: the hits of an address are never held in one row.
    """
    own = F.greatest(F.lit(0), 120 - 3 * F.col(rank)) + 8 * F.col(overlap) + F.when(F.col(url).startswith("https:"), 5).otherwise(0)
    hit = hits.select(url, F.col(query).cast("string").alias("q"), F.col(rank).alias("r"), own.cast("long").alias("s"))
    placed = hit.withColumn("k", F.row_number().over(Window.partitionBy(url, "q").orderBy("r", "s")))
    first = F.min(F.when(F.col("k") == 1, F.col("s"))).alias("s1")
    per = placed.groupBy(url, "q").agg(F.count(F.lit(1)).alias("m"), first, F.max(F.when(F.col("k") > 1, F.col("s") - 4 * F.col("k"))).alias("rest"))
    base = F.greatest(F.col("s1") + 4 * F.col("m") - F.when(F.col("n") == 1, 4).otherwise(0), F.col("rest") + 4 * F.col("m") + 4)
    later = F.coalesce(F.sum(18 + 4 * F.col("m")).over(Window.partitionBy(url).orderBy(F.desc("q")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    scored = per.withColumn("later", later).withColumn("n", F.row_number().over(Window.partitionBy(url).orderBy("q")))
    return scored.groupBy(url).agg(F.max(base + F.col("later")).alias("score"), F.count("q").alias("queries"))


def disagreements(passages: DataFrame, row: str, source: str, words: str, numbers: str, negated: str, *, best: str, top: int = 40, shared: int = 4) -> DataFrame:
    """a, b, kind: pairs among the `top` best passages from different sources that share words but differ in numbers or negation.

    The list is short by definition, so its pairs are formed; ties in `best` go to the smaller row.
    """
    short = passages.orderBy(F.desc(best), row).limit(top)
    a = short.select(F.col(row).alias("a"), F.col(source).alias("sa"), F.col(words).alias("wa"), F.col(numbers).alias("na"), F.col(negated).alias("xa"))
    b = short.select(F.col(row).alias("b"), F.col(source).alias("sb"), F.col(words).alias("wb"), F.col(numbers).alias("nb"), F.col(negated).alias("xb"))
    both = a.join(F.broadcast(b), (F.col("a") < F.col("b")) & (F.col("sa") != F.col("sb"))).where(F.size(F.array_intersect("wa", "wb")) >= shared)
    differ = (F.size("na") > 0) & (F.size("nb") > 0) & (F.array_sort("na") != F.array_sort("nb"))
    return both.select("a", "b", F.when(differ, "numbers").when(F.col("xa") != F.col("xb"), "negation").alias("kind")).where("kind is not null")
