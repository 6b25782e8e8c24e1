"""Record curation: duplicates, timelines, proposals, grounding, breaker, quotes, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreforge.functions.text import merge_key


def merge_groups(entities: DataFrame) -> DataFrame:
    """key, survivor (smallest id), losers and size of groups of two or more that share a non-empty merge key.

    ``entities`` has id (string), name, kind and summary.
    """
    keyed = entities.withColumn("key", merge_key(F.col("name"))).where("key != ''")
    return (
        keyed.groupBy("key").agg(
            F.min("id").alias("survivor"), F.count("*").alias("n"), F.countDistinct("kind").alias("kinds"),
            F.countDistinct(F.coalesce("summary", F.lit(""))).alias("summaries"), F.max(F.length(F.coalesce("summary", F.lit("")))).alias("longest"),
        ).where("n > 1")
    )


def disposition() -> Column:
    """What becomes of a merge group; summaries that are all empty do not agree."""
    return F.when(F.col("kinds") > 1, "type_conflict").when((F.col("summaries") > 1) | (F.col("longest") == 0), "summary_mismatch").otherwise("auto_merge")


def timeline(events: DataFrame, *others: DataFrame) -> DataFrame:
    """Union of rows (id, at_ms, kind, source)."""
    out = events
    for other in others:
        out = out.unionByName(other)
    return out


def page(rows: DataFrame, limit: int, before: tuple[int, str] | None = None, kind: str | None = None) -> DataFrame:
    """Newest first, at most 500, from behind a cursor (at_ms, id)."""
    if before is not None:
        at, ident = before
        rows = rows.where((F.col("at_ms") < at) | ((F.col("at_ms") == at) & (F.col("id") < ident)))
    if kind is not None:
        rows = rows.where(F.col("kind") == kind)
    return rows.orderBy(F.desc("at_ms"), F.desc("id")).limit(max(1, min(500, limit)))


KINDS = ("synthesized", "approved", "rejected", "healed", "imported", "exported")


def event_kind(kind: Column) -> Column:
    return F.when(kind.isin(*KINDS), kind).otherwise("other")


def breaker(counts: DataFrame) -> DataFrame:
    """Verdict over live, doomed, spent and tripped: all of it goes or nothing.

    The budget is five per cent of the live rows, rounded up, but ten at least.
    """
    budget = F.greatest(F.ceil(F.col("live") * 0.05), F.lit(10)).cast("long")
    verdict = (
        F.when(F.col("tripped") | (F.col("spent") >= budget), "tripped")
        .when((F.col("live") > 0) & (F.col("doomed") >= F.col("live")), "full_population")
        .when(F.col("doomed") > budget - F.col("spent"), "budget").otherwise("allowed")
    )
    return counts.withColumn("budget", budget).withColumn("verdict", verdict)


#: Leading words of quotes that are put into the plan; of more quotes they meet the texts in a join.
PLANNED_QUOTES = 20_000


def quotes(items: DataFrame, texts: DataFrame, short: int = 60, k: int = 6) -> DataFrame:
    """Where quotes (id, quote) stand in texts (doc, text): state and, if unique, the doc.

    Both sides are normalised and padded.  A whole match in one text is a hit, in several ambiguous.  Else, for
    quotes of ``short`` characters or more, the prefix of ``short`` decides; if several have it and the quote has over
    twice as many, the suffix.  A text can only hold a quote if it holds the quote's leading words, at most ``k``, so
    each text looks for hashes of those among its own and is compared only with the quotes that it finds.  Empty
    quotes match nothing.
    """
    q = items.select("id", merge_key(F.col("quote")).alias("q")).where("q != ''").withColumn("qw", F.split("q", " "))
    # the last word of a prefix may be cut, so look for whole words that lie inside it
    whole = F.size(F.split(F.substring(F.col("q"), 1, short), " ")) - F.when(F.length("q") > short, 1).otherwise(0)
    q = q.withColumn("n", F.greatest(F.lit(1), F.least(F.lit(k), whole))).select("id", "q", "n", F.xxhash64(F.slice("qw", 1, F.col("n"))).alias("head"))
    keys = q.select("n", "head").distinct()
    sizes = sorted(r["n"] for r in keys.select("n").distinct().collect())  # at most k
    if not sizes:
        return items.limit(0).select("id", F.lit("none").alias("state"), F.lit(None).cast("long").alias("doc"))
    planned = [r["head"] for r in keys.select("head").limit(PLANNED_QUOTES + 1).collect()]
    t = texts.select("doc", merge_key(F.col("text")).alias("t")).where("t != ''").select("doc", "t", F.split("t", " ").alias("w"))
    heads = F.flatten(F.array(*(_heads(n) for n in sizes)))
    if len(planned) <= PLANNED_QUOTES:
        heads = F.filter(heads, lambda h: h.isin(planned))
    met = t.select("doc", "t", F.array_distinct(heads).alias("heads")).select("doc", F.concat(F.lit(" "), "t", F.lit(" ")).alias("t"), F.explode_outer("heads").alias("head"))  # outer: no filter on what is exploded is pushed below and repeats its work
    space = F.lit(" ")
    full = F.col("t").contains(F.concat(space, "q", space))
    prefix = (F.length("q") >= short) & F.col("t").contains(F.concat(space, F.substring(F.col("q"), 1, short)))
    suffix = (F.length("q") > 2 * short) & F.col("t").contains(F.concat(F.expr(f"right(q, {short})"), space))
    flags = met.join(q, "head").select("id", "doc", full.alias("full"), prefix.alias("prefix"), (prefix & suffix).alias("both"))
    n = flags.groupBy("id").agg(
        *(F.count_if(c).alias(f"n_{c}") for c in ("full", "prefix", "both")), *(F.min(F.when(F.col(c), F.col("doc"))).alias(f"d_{c}") for c in ("full", "prefix", "both"))
    )
    found = items.select("id").distinct().join(n, "id", "left")
    state = (
        F.when(F.col("n_full") == 1, "full").when(F.col("n_full") > 1, "ambiguous").when(F.col("n_prefix") == 1, "prefix")
        .when((F.col("n_prefix") > 1) & (F.col("n_both") == 1), "suffix").when(F.col("n_prefix") > 1, "ambiguous").otherwise("none")
    )
    doc = F.when(F.col("n_full") == 1, F.col("d_full")).when(F.coalesce(F.col("n_full"), F.lit(0)) > 1, None).when(F.col("n_prefix") == 1, F.col("d_prefix")).when(F.col("n_both") == 1, F.col("d_both"))
    return found.select("id", state.alias("state"), doc.alias("doc"))


def _heads(n: int) -> Column:
    """Hashes of every ``n`` words in a row."""
    last = F.size("w") - (n - 1)
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(F.col("w"), i, F.lit(n))))).otherwise(F.array().cast("array<bigint>"))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], last_wins: bool = True) -> DataFrame:
    """Rows of both by key: the new row of a key replaces the old one, or is ignored."""
    keep, more = (new, old) if last_wins else (old, new)
    return keep.unionByName(more.join(keep.select(*keys), list(keys), "left_anti"))


def promoted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, role and state after new rows (key, role) meet a table: unknown keys go in, and a trigger takes the place of evidence."""
    both = old.select(key, F.col("role").alias("was")).join(new.select(key, F.col("role").alias("comes")), key, "full_outer")
    up = (F.col("was") == "evidence") & (F.col("comes") == "trigger")
    role = F.when((F.col("was") == "trigger") | (F.col("comes") == "trigger"), "trigger").otherwise("evidence")
    return both.select(key, role.alias("role"), F.when(F.col("was").isNull(), "inserted").when(up, "promoted").otherwise("kept").alias("state"))


def confirmation_queue(facts: DataFrame, evidence: DataFrame, denials: DataFrame, now: int) -> DataFrame:
    """One row per live, stable fact that nobody confirmed: its first evidence, unless that one is denied; age in days.

    The first evidence is chosen before denials are looked at.
    """
    first = evidence.groupBy("fact").agg(F.min(F.struct("doc", "hash")).alias("e"))
    waiting = facts.where("deleted_at IS NULL AND status = 'stable' AND confidence != 'confirmed'").join(first, "fact")
    rows = waiting.select("fact", F.col("e.doc").alias("doc"), F.col("e.hash").alias("hash"), F.expr(f"({now} - created) div 86400").alias("age_days"))
    return rows.join(denials.select("doc", "hash", "fact"), ["doc", "hash", "fact"], "left_anti").select("fact", "doc", "age_days")


def grounding(facts: DataFrame, evidence: DataFrame, live: DataFrame) -> DataFrame:
    """fact and grounded: held or pending facts, and facts without references, count as grounded; else one live hash must be cited."""
    cited = evidence.join(live.select("hash").distinct().withColumn("alive", F.lit(1)), "hash", "left").groupBy("fact").agg(F.count("*").alias("refs"), F.count("alive").alias("alive"))
    grounded = F.col("held") | F.col("refs").isNull() | (F.col("alive") > 0)
    return facts.join(cited, "fact", "left").select("fact", grounded.alias("grounded"))
