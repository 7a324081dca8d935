"""The link ladder: remembered decisions, exact names, configured schemas, similarity; it never guesses."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.session import cut, dealt

# Type precedence among equal names, and the thresholds of the similarity rung.
PRECEDENCE = ["view", "gold_table", "silver_table", "bronze_table"]
AUTO, PENDING = 0.92, 0.60
#: Rarest tokens of an item by which its first candidates are found.
SEEDS = 8
#: Items of at most so many characters are first tried with what is two characters away.
SHORT = 20


def _precedence():
    return F.array_position(F.array(*map(F.lit, PRECEDENCE)), F.col("node_type"))


def exact_match(items: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, target): the node of the item's schema and name that comes first by type, then id."""
    n = nodes.where(F.col("node_type").isin(PRECEDENCE)).select(F.lower("schema_name").alias("schema_name"), F.lower("name").alias("name"), "id", _precedence().alias("p"))
    i = items.select("key", F.lower("schema_name").alias("schema_name"), F.lower("name").alias("name"))
    return i.join(n.hint("merge"), ["schema_name", "name"]).groupBy("key").agg(F.min(F.struct("p", "id")).alias("m")).select("key", F.col("m.id").alias("target"))


def config_rule_match(items: DataFrame, nodes: DataFrame, mappings: DataFrame) -> DataFrame:
    """(key, target): the same over the schemas that the item's model is mapped to; the first mapping with a hit wins."""
    tried = items.join(mappings, "model").select(F.struct("key", "pos").alias("key"), mappings["schema_name"].alias("schema_name"), "name")
    hits = exact_match(tried, nodes)
    return hits.groupBy(F.col("key.key").alias("key")).agg(F.min_by("target", F.col("key.pos")).alias("target"))


@F.pandas_udf(T.DoubleType())
def similarity(needle: pd.Series, candidate: pd.Series) -> pd.Series:
    """Ratio of matching blocks; the order of the arguments matters."""
    m, out = difflib.SequenceMatcher(), []
    for a, b in zip(needle, candidate, strict=True):
        m.set_seqs(a or "", b or "")
        out.append(m.ratio())
    return pd.Series(out, dtype="float64")


def _numbered(grams: Column) -> Column:
    """The grams of a text, each with how often it stood before, so that sets of them count what two texts share."""
    return F.transform(grams, lambda g, i: F.concat(g, F.lit("\x01"), F.size(F.filter(F.slice(grams, F.lit(1), i), lambda x: x == g)).cast("string")))


def _profiles(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, len, ones, twos): characters and pairs of neighbouring ones, numbered."""
    n = F.length(text)
    ones = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(F.col(text), i, F.lit(1)))
    twos = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substr(F.col(text), i, F.lit(2)))
    none = F.array().cast("array<string>")
    r = rows.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), n.alias("len"), F.when(n > 0, ones).otherwise(none).alias("o"), F.when(n > 1, twos).otherwise(none).alias("t"))
    return r.select("key", "text", "len", _numbered(F.col("o")).alias("ones"), _numbered(F.col("t")).alias("twos"))


def _most(i: str, c: str) -> Column:
    """What no ratio exceeds of two profiles. M characters in matching blocks are among those that both hold; and as two
    blocks have at least one unmatched character between them, in either text, they keep M - (T - 2 M) - 1 neighbours, T
    being both lengths, so that M is at most a third of T + 1 and the neighbours that both hold."""
    total = F.col(f"{i}.len") + F.col(f"{c}.len")
    one, two = (F.size(F.array_intersect(F.col(f"{i}.{x}"), F.col(f"{c}.{x}"))) for x in ("ones", "twos"))
    return F.when(total > 0, 2.0 * F.least(one, F.floor((two + total + 1) / 3)) / total).otherwise(1.0)


def _tokens(profiles: DataFrame) -> DataFrame:
    """(token, key): the inverted index of profiles, one row for each character and pair."""
    return profiles.select(F.explode(F.concat("ones", "twos")).alias("token"), "key")


def _rarest_first(profiles: DataFrame, index: DataFrame) -> DataFrame:
    """The profiles with their tokens, those first that the fewest texts of the index hold."""
    held = index.groupBy("token").agg(F.count("*").alias("n"))
    of = profiles.select("key", F.explode(F.concat("ones", "twos")).alias("token")).join(held, "token", "left")
    token = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")
    pair = F.length(F.substring_index("token", "\x01", 1)) == 2
    by_kind = of.groupBy("key").agg(F.array_sort(F.collect_list(F.when(~pair, token))).alias("r1"), F.array_sort(F.collect_list(F.when(pair, token))).alias("r2"))
    return profiles.join(by_kind, "key", "left")


def _meeting(wanted: DataFrame, candidates: DataFrame, index: DataFrame) -> DataFrame:
    """(i, c) of profiles: every candidate whose ratio with an item may reach the item's ``floor`` (over 0).

    A ratio of at least f leaves so many shared characters, or pairs if f is over two thirds, that a candidate holds one of
    the item's rarest tokens: of n tokens of which m must be shared, one of the n - m + 1 rarest. Only these are looked up.
    """
    f, n = F.col("floor"), F.col("len")
    total = n + F.ceil(n * f / (2 - f) - 1e-9)  # with the shortest candidate that may reach it
    pairs_shared, chars_shared = F.ceil(1.5 * f * total - total - 1 - 1e-9), F.ceil(f * total / 2 - 1e-9)
    by_pairs = (1.5 * f >= 1) & (pairs_shared >= 1)
    rarest = lambda tokens, m: F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - F.greatest(m, F.lit(1)) + 1, F.lit(0)).cast("int"))
    looked_up = F.when(by_pairs, rarest(F.col("r2"), pairs_shared)).otherwise(rarest(F.col("r1"), chars_shared))
    probes = wanted.select("key", "len", "floor", F.explode(F.transform(looked_up, lambda x: x["token"])).alias("token"))
    met = probes.join(index.withColumnRenamed("key", "target"), "token").select("key", "target").distinct()
    both = met.join(wanted.select("key", "floor", F.struct("len", "text", "ones", "twos").alias("i")), "key").join(candidates.select(F.col("key").alias("target"), F.struct("len", "text", "ones", "twos").alias("c")), "target")
    short = 2 * F.least("i.len", "c.len") >= F.col("floor") * (F.col("i.len") + F.col("c.len")) - 1e-9
    return both.where(short & (_most("i", "c") >= F.col("floor") - 1e-9))


def fuzzy_scores(items: DataFrame, candidates: DataFrame, least: float) -> DataFrame:
    """(key, target, score) of items (key, needle) and candidates (target, qualified) whose ratio reaches ``least`` (over 0)."""
    if least <= 0:
        raise ValueError("use best_candidates for scores without a bound")
    i, c = cut(_profiles(items, "key", "needle")), cut(_profiles(candidates, "target", "qualified"))
    index = _tokens(c)
    pairs = _meeting(_rarest_first(i, index).withColumn("floor", F.lit(float(least))), c, index)
    empty = i.where("len = 0").select("key", "len").join(c.where("len = 0").select(F.col("key").alias("target"), "len"), "len").select("key", "target", F.lit(1.0).alias("score"))
    return pairs.select("key", "target", similarity("i.text", "c.text").alias("score")).where(F.col("score") >= least).unionByName(empty)


def _less_two(rows: DataFrame, kept: list[str], text: str) -> DataFrame:
    """(…, less, gone): each text of at most ``SHORT`` + 2 characters without none, one or two of them, and how many went."""
    t, n = F.col(text), F.length(text)
    without = lambda x, p: F.concat(F.substr(x, F.lit(1), p - 1), F.substr(x, p + 1, F.length(x)))
    less = lambda p, gone: F.struct(p.alias("less"), F.lit(gone).alias("gone"))
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    one = F.transform(places, lambda p: without(t, p))
    # the second one that goes stands before the first
    two = F.flatten(F.transform(places, lambda p: F.transform(F.slice(places, F.lit(1), p - 1), lambda q: without(without(t, p), q))))
    every = F.concat(F.array(less(t, 0)), F.transform(F.array_distinct(one), lambda x: less(x, 1)), F.transform(F.array_distinct(two), lambda x: less(x, 2)))
    return rows.where(n <= SHORT + 2).select(*kept, F.explode(every).alias("v")).select(*kept, "v.less", "v.gone")


def _two_away(items: DataFrame, candidates: DataFrame) -> DataFrame:
    """(key, target, needle, qualified) of short items (key, needle) and all candidates (target, qualified) that become one
    text when two characters go, of either or of both; texts that several items or candidates share meet once."""
    short = items.where(F.length("needle") <= SHORT)
    a, b = (_less_two(df.select(c).distinct(), [c], c) for df, c in ((short, "needle"), (candidates, "qualified")))
    met = dealt(a, "less").join(dealt(b.withColumnRenamed("gone", "gone_too"), "less").hint("merge"), "less").where("gone + gone_too <= 2").select("needle", "qualified").distinct()
    return met.join(short.select("key", "needle").hint("merge"), "needle").join(candidates.select("target", "qualified").hint("merge"), "qualified").select("key", "target", "needle", "qualified")


def _kth_ratio(pairs: DataFrame, k: int) -> DataFrame:
    """(key, floor): the k-th best ratio of each key's pairs, 0 of fewer."""
    scored = pairs.select("key", similarity("needle", "qualified").alias("s"))
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("s")))
    return scored.withColumn("r", place).groupBy("key").agg(F.coalesce(F.max(F.when(F.col("r") == k, F.col("s"))), F.lit(0.0)).alias("floor"))


def compared_pairs(items: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """(key, target, needle, qualified): the pairs that the matcher has to see to know the k best candidates of each item.

    Short items meet what is two characters away first (``_two_away``). Of a pair that is three or more away, at most the
    item's n characters match, of 2 n + 3: an item whose k-th ratio is over 2 n / (2 n + 3) by then is done. All others are
    looked up in the index (``_indexed_pairs``).
    """
    needles = cut(items.where("needle is not null").select("key", "needle"))
    names = cut(candidates.where("qualified is not null").select("target", "qualified"))
    near = cut(_two_away(needles, names))
    n = F.length("needle")
    done = cut(needles.join(_kth_ratio(near, k).hint("merge"), "key").where(F.col("floor") > 2 * n / (2 * n + 3) + 1e-9).select("key"))
    rest = cut(needles.join(done.hint("merge"), "key", "left_anti"))
    near = near.join(done.hint("merge"), "key", "left_semi")
    return near if rest.isEmpty() else near.unionByName(_indexed_pairs(rest, names, k))


def _indexed_pairs(items: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """The same pairs by an index of characters and pairs.

    The candidates with most rare tokens in common come first; their k-th ratio is a floor, and ``_meeting`` finds what may
    reach it. An item without k candidates of some ratio gets those of the least ids, whose ratio is 0.
    """
    i, c = cut(_profiles(items, "key", "needle")), cut(_profiles(candidates, "target", "qualified"))
    index = cut(_tokens(c))
    ranked = cut(_rarest_first(i, index))
    texts = c.select(F.col("key").alias("target"), F.col("text").alias("qualified"), F.col("len").alias("lc"))
    least = texts.orderBy("target").limit(k)  # k rows
    begin = ranked.select("key", "text", "len", F.explode(F.slice(F.array_sort(F.filter(F.concat("r1", "r2"), lambda x: x["n"] > 0)), 1, SEEDS)).alias("x")).select("key", "text", "len", "x.token")
    shared = begin.join(index.withColumnRenamed("key", "target"), "token").groupBy("key", "target").agg(F.first("text").alias("needle"), F.first("len").alias("len"), F.count("*").alias("n"))
    order = F.row_number().over(Window.partitionBy("key").orderBy(F.desc(F.col("n") / (F.col("len") + F.col("lc"))), "target"))
    near = shared.join(texts, "target").withColumn("r", order).where(F.col("r") <= k).select("key", "target", "needle", "qualified")
    seeds = cut(near.unionByName(ranked.select("key", F.col("text").alias("needle")).join(F.broadcast(least.drop("lc")), F.lit(True)).select("key", "target", "needle", "qualified")).distinct())
    floor = _kth_ratio(seeds, k)
    # a floor of 0 leaves what shares a character; of texts without characters only equal ones have a ratio
    wanted = ranked.join(floor, "key").withColumn("floor", F.greatest("floor", F.lit(1e-6)))
    met = _meeting(wanted, c, index).select("key", "target", F.col("i.text").alias("needle"), F.col("c.text").alias("qualified"))
    empty = wanted.where("len = 0").select("key", F.col("text").alias("needle")).join(F.broadcast(texts.where("lc = 0").orderBy("target").limit(k).drop("lc")), F.lit(True))
    return met.unionByName(seeds).unionByName(empty.select("key", "target", "needle", "qualified")).distinct()


def best_candidates(items: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """(key, target, score, rank) of the k best of all candidates for each item, whatever their scores.

    Items (key, needle) and candidates (target, qualified) are lists of names; rows without a text take no part.
    """
    pairs = compared_pairs(items, candidates, k)
    return top_candidates(pairs.select("key", "target", similarity("needle", "qualified").alias("score")), k)


def top_candidates(scores: DataFrame, k: int = 10) -> DataFrame:
    """The k best candidates of each item, ties to the lesser id."""
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "target"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def best_and_runner_up(ranked: DataFrame) -> DataFrame:
    """(key, target, score, runner_up) of ranked candidates: the best one and the next score (0 if there is none)."""
    two = ranked.where(F.col("rank") <= 2)
    return two.groupBy("key").agg(F.min_by("target", "rank").alias("target"), F.max("score").alias("score"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.lit(0.0)).alias("runner_up"))


def ladder(items: DataFrame, decisions: DataFrame, exact: DataFrame, rule: DataFrame, fuzzy: DataFrame | None = None) -> DataFrame:
    """(key, target, method): each item on the first rung that holds it.

    ``decisions`` (key, target, signature): a changed signature sends the item to review; a null target marks it external.
    A decision without a signature is compared by ``legacy`` (items) with ``published`` (decisions), where both have it.
    """
    for df, c in ((items, "legacy"), (decisions, "published")):
        if c not in df.columns:
            if df is items:
                items = items.withColumn(c, F.lit(None).cast("string"))
            else:
                decisions = decisions.withColumn(c, F.lit(None).cast("string"))
    d = decisions.select("key", F.col("target").alias("d_target"), F.col("signature").alias("d_signature"), F.col("published").alias("d_published"), F.lit(True).alias("decided"))
    by_key = lambda df: df.hint("merge")  # noqa: E731  as many as items, and small only when packed
    out = items.join(by_key(d), "key", "left").join(by_key(exact.withColumnRenamed("target", "e_target")), "key", "left").join(by_key(rule.withColumnRenamed("target", "r_target")), "key", "left")
    decided = F.coalesce("decided", F.lit(False))
    signed = F.col("d_signature").isNotNull()
    stale = decided & ((signed & ~F.col("d_signature").eqNullSafe(F.col("signature"))) | (~signed & F.coalesce(F.col("d_published") != F.col("legacy"), F.lit(False))))
    rungs = [
        (stale, F.lit(None), "review"),
        (decided & F.col("d_target").isNull(), F.lit(None), "external"),
        (decided, F.col("d_target"), "cache"),
        (F.col("e_target").isNotNull(), F.col("e_target"), "exact"),
        (F.col("r_target").isNotNull(), F.col("r_target"), "rule"),
    ]
    if fuzzy is not None:
        out = out.join(by_key(fuzzy.select("key", F.col("target").alias("f_target"), "score", "runner_up")), "key", "left")
        rungs.append(((F.col("score") >= AUTO) & (F.col("score") > F.col("runner_up")), F.col("f_target"), "fuzzy"))
        rungs.append((F.col("score") >= PENDING, F.lit(None), "pending"))
    target, method = F.lit(None).cast("string"), F.lit("unresolved")
    for when, to, name in reversed(rungs):
        target, method = F.when(when, to).otherwise(target), F.when(when, F.lit(name)).otherwise(method)
    return out.select("key", target.alias("target"), method.alias("method"))


def prune_decisions(decisions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Decisions whose target is no node any more."""
    return decisions.where("target is not null").join(nodes.select(F.col("id").alias("target")), "target", "left_anti")


def unmatched_decisions(decisions: DataFrame, items: DataFrame, nodes: DataFrame) -> DataFrame:
    """Decisions of nodes that exist (the key up to '#') which no item uses."""
    own = decisions.withColumn("id", F.substring_index("key", "#", 1))
    return own.join(nodes.select("id"), "id", "left_semi").join(items.select("key"), "key", "left_anti")


def source_signatures(sources: DataFrame) -> DataFrame:
    """(table_id, qualified, signature): the hash of the sorted definitions of each table's source of one name."""
    return sources.groupBy("table_id", "qualified").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("definition")), ",").cast("binary"), 256).alias("signature"))


def decision_warnings(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """(file, message, category) of used decisions whose source changed, or that carry no signature to tell."""
    j = items.join(decisions.select("key", F.col("signature").alias("d_signature")), "key")
    changed = F.col("d_signature").isNotNull() & ~F.col("d_signature").eqNullSafe(F.col("signature"))
    category = F.when(changed, "cache_source_changed").when(F.col("d_signature").isNull(), "cache_source_unverified")
    text = F.when(changed, "the source changed since it was linked").otherwise("the link carries no signature of its source")
    return j.select(F.col("key").alias("file"), text.alias("message"), category.alias("category")).where("category is not null")


def carried_reviews(reviews: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(open, retired) of review markers (key, since) after a run (key, target, method): an item that is still in review or
    pending keeps its old marker, a new one gets none yet, and markers of settled or vanished items retire."""
    waiting = results.where(F.col("method").isin("review", "pending")).select("key", "method")
    return waiting.join(reviews, "key", "left").select("key", "method", "since"), reviews.join(waiting, "key", "left_anti")
