"""Mixing sources to target weights: temperature mixing realised as budgeted block permutations.

With token shares p_s, the weights are p_s^t / sum p^t. The exponent t in [0, 1] is bisected: the
largest t whose weights reach `target_entropy` (as a share of log n; entropy falls as t grows), or
the smallest t at which no source is repeated more than `max_repeats` times (repeats fall as t
grows towards 1, where all sources are used equally often), or both, the repetition limit first. A
source's budget is weight x total budget, in tokens.

A budget is spent in epochs. Each epoch is one permutation of the source's blocks (documents dealt
into blocks of about `block_tokens` tokens by the hash of the id), and of the documents inside a
block; a document is taken in an epoch while the tokens before it are below the budget. Position sums
come in three steps, over chapters (the blocks of one beginning of the order's key, `CHAPTERS` of them), over the blocks
of a chapter and inside a block. Blocks are never limited in number, so none grows with its source, and no
window holds a whole source or all of its blocks.

All steps are DataFrame expressions; only the few numbers of one bisection step reach the driver.

Defined results: a source's null name is a group of its own. Null or empty texts have 0 tokens: they
are never taken, and a source without tokens has weight 0 and no row. An empty table gives no
rows. Repeated rows are told apart by the text's hash; rows equal in both are taken together. An
unreachable target gives the nearer end of [0, 1]. Extra columns are not carried.
"""

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textscore.operators.joins import lookup_join
from textscore.sources.work import materialise

STEPS = 16
# A chapter is a beginning of this many hex digits of a block's key: 4,096 chapters.
CHAPTER_DIGITS = 3
CHAPTERS = 16 ** CHAPTER_DIGITS


def token_count(text):
    """Words: runs of characters other than space and 0x09-0x0D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_totals(sizes):
    """(source, tokens, documents) of the sources that have tokens."""
    return (sizes.groupBy("source").agg(F.sum("n").alias("tokens"), F.count("*").alias("documents"))
            .filter(F.col("tokens") > 0))


def _grid(low, high, steps=STEPS):
    return [low + (high - low) * k / steps for k in range(steps + 1)]


def _measure(totals, total, budget, exponents):
    """Per exponent: the entropy of the weights and the most often any source is repeated."""
    log_share = F.log(F.col("tokens") / F.lit(float(total)))
    at = F.explode(F.array(*[F.lit(float(t)) for t in exponents])).alias("t")
    rows = totals.select("tokens", log_share.alias("lp"), at)
    raised = F.exp(F.col("t") * F.col("lp"))
    found = (rows.groupBy("t").agg(
        F.sum(raised).alias("z"), F.sum(raised * F.col("t") * F.col("lp")).alias("s"),
        F.max(raised / F.col("tokens")).alias("r")).collect())
    return {f["t"]: (math.log(f["z"]) - f["s"] / f["z"], budget * f["r"] / f["z"]) for f in found}


def find_exponent(totals, budget=None, target_entropy=None, max_repeats=None, tolerance=1e-6):
    """The exponent, its total tokens and its budget; `totals` is read once per narrowing."""
    whole = totals.agg(F.sum("tokens"), F.count("*")).first()
    total, sources = whole[0] or 0, whole[1]
    budget = total if budget is None else budget
    if not total or sources < 2:
        return 1.0, total, budget

    def bisect(good, low, high, at_top):
        """The end of the run of good exponents that starts at `low` (at_top) or ends at `high`."""
        seen = _measure(totals, total, budget, [low, high])
        if good(seen[high]) and at_top or not at_top and not good(seen[high]):
            return high
        if at_top and not good(seen[low]) or not at_top and good(seen[low]):
            return low
        while high - low > tolerance:
            grid = _grid(low, high)
            seen = _measure(totals, total, budget, grid)
            if at_top:
                last = max(i for i, t in enumerate(grid) if i == 0 or good(seen[t]))
                last = min(last, len(grid) - 2)
                low, high = grid[last], grid[last + 1]
            else:
                first = min(i for i, t in enumerate(grid) if i == len(grid) - 1 or good(seen[t]))
                first = max(first, 1)
                low, high = grid[first - 1], grid[first]
        return low if at_top else high

    least = 0.0
    if max_repeats is not None:
        least = bisect(lambda m: m[1] <= max_repeats, 0.0, 1.0, False)
    if target_entropy is None:
        return (least if max_repeats is not None else 1.0), total, budget
    floor = target_entropy * math.log(sources)
    return bisect(lambda m: m[0] >= floor, least, 1.0, True), total, budget


def weights(totals, exponent, total, budget):
    """`totals` with `weight`, `budget` (tokens, rounded) and `repeats`."""
    raised = F.exp(F.lit(exponent) * F.log(F.col("tokens") / F.lit(float(total or 1))))
    norm = totals.agg(F.sum(raised).alias("z")).first()["z"] or 1.0
    share = raised / F.lit(norm)
    return (totals.withColumn("weight", F.round(share, 12))
            .withColumn("budget", F.round(F.col("weight") * F.lit(float(budget or 0))).cast("long"))
            .withColumn("repeats", F.col("budget") / F.col("tokens")))


def _rank(*parts):
    """A fixed pseudo-random key: the MD5 of the parts."""
    return F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def block_of(doc_id, blocks):
    """The block of a document: 60 bits of the MD5 of its id, modulo the number of blocks."""
    return F.pmod(F.conv(F.substring(_rank(doc_id), 1, 15), 16, 10).cast("long"), blocks)


def mix(docs, text="text", key="doc_id", source="source", budget=None, target_entropy=0.95,
        max_repeats=4.0, block_tokens=100_000):
    """(doc_id, source, epoch, block, n_tokens, start): one row per document and epoch taken.

    `start` is the number of the source's tokens taken before it; order by (source, start) to read
    a source in its mixed order.
    """
    name = F.col(f"`{source}`").cast("string")
    sizes = materialise(docs.select(
        F.col(f"`{key}`").alias("doc_id"),
        F.when(name.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), name)).alias("source"),
        F.xxhash64(F.col(f"`{text}`")).alias("copy"),
        token_count(F.col(f"`{text}`")).alias("n")), "mix-sizes")
    totals = materialise(source_totals(sizes), "mix-totals")
    exponent, total, budget = find_exponent(totals, budget, target_entropy, max_repeats)
    blocks = F.ceil(F.col("tokens") / F.lit(block_tokens))
    plan = weights(totals, exponent, total, budget).select(
        "source", "tokens", "budget",
        F.greatest(blocks, F.lit(1)).alias("blocks"),
        F.ceil(F.col("budget") / F.col("tokens")).alias("epochs"))
    placed = (lookup_join(sizes.filter("n > 0"), plan, "source", "inner", spread=["doc_id"])
              .withColumn("block", block_of(F.col("doc_id"), F.col("blocks"))))
    held = (placed.groupBy("source", "block").agg(
        F.sum("n").alias("held"), F.max("tokens").alias("tokens"), F.max("budget").alias("budget"),
        F.max("epochs").alias("epochs"))
        .filter("epochs > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)))
        .withColumn("order", _rank(F.col("source"), F.col("block"), F.col("epoch")))
        .withColumn("chapter", F.substring("order", 1, CHAPTER_DIGITS)))
    earlier = (Window.partitionBy("source", "epoch").orderBy("chapter")
               .rowsBetween(Window.unboundedPreceding, -1))
    chapters = (held.groupBy("source", "epoch", "chapter").agg(F.sum("held").alias("size"))
                .withColumn("opens", F.coalesce(F.sum("size").over(earlier), F.lit(0))).drop("size"))
    ahead = (Window.partitionBy("source", "epoch", "chapter").orderBy("order", "block")
             .rowsBetween(Window.unboundedPreceding, -1))
    starts = (held.join(chapters, ["source", "epoch", "chapter"])
              .withColumn("before", F.coalesce(F.sum("held").over(ahead), F.lit(0)) + F.col("opens")
                          + F.col("epoch") * F.col("tokens"))
              .filter("before < budget").select("source", "block", "epoch", "before", "budget"))
    inside = (Window.partitionBy("source", "block", "epoch").orderBy("rank", "doc_id", "copy")
              .rowsBetween(Window.unboundedPreceding, -1))
    return (placed.select("doc_id", "source", "copy", "n", "block").join(starts, ["source", "block"])
            .withColumn("rank", _rank(F.col("doc_id"), F.col("epoch")))
            .withColumn("start", F.coalesce(F.sum("n").over(inside), F.lit(0)) + F.col("before"))
            .filter("start < budget")
            .select("doc_id", F.when(F.col("source") != "", F.substring("source", 2, 1 << 30)).alias("source"),
                    "epoch", "block", F.col("n").alias("n_tokens"), "start"))


def oracle(target_entropy=0.95, max_repeats=4.0, block_tokens=100_000, narrowings=5):
    """The same in SQL: every narrowing of the exponent is a table of one row."""
    steps = ["""
    sizes AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS source,
                     len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n FROM documents),
    totals AS (SELECT source, sum(n)::BIGINT AS tokens FROM sizes GROUP BY 1 HAVING sum(n) > 0),
    whole AS (SELECT sum(tokens)::DOUBLE AS total, count(*) AS sources FROM totals)"""]

    def measure(name, grid):
        steps.append(f"""
    {name} AS (SELECT t, ln(z) - s / z AS entropy, total * r / z AS repeats, sources FROM (
      SELECT t, any_value(total) AS total, any_value(sources) AS sources,
             sum(exp(t * lp)) AS z, sum(exp(t * lp) * t * lp) AS s, max(exp(t * lp) / tokens) AS r
      FROM ({grid}), (SELECT tokens, ln(tokens / total) AS lp, total, sources FROM totals, whole)
      GROUP BY t))""")

    def narrow(name, start, good, at_top):
        steps.append(f"{name}0 AS ({start})")
        for k in range(narrowings):
            old = f"{name}{k}"
            measure(f"{old}_m", f"SELECT low + (high - low) * i / 16 AS t FROM {old}, range(17) AS g(i)")
            ranked = f"(SELECT t, {good} AS good, row_number() OVER (ORDER BY t) - 1 AS i FROM {old}_m)"
            if at_top:
                pick = "least(coalesce(max(i) FILTER (good), 0), 15)"
            else:
                pick = "greatest(coalesce(min(i) FILTER (good), 16), 1) - 1"
            steps.append(f"""
    {name}{k + 1} AS (SELECT max(t) FILTER (i = spot) AS low, max(t) FILTER (i = spot + 1) AS high
      FROM {ranked}, (SELECT {pick} AS spot FROM {ranked}))""")

    measure("ends_r", "SELECT 0.0::DOUBLE AS t UNION ALL SELECT 1.0::DOUBLE")
    narrow("r", "SELECT 0.0::DOUBLE AS low, 1.0::DOUBLE AS high", f"repeats <= {max_repeats}", False)
    steps.append(f"""
    least_t AS (SELECT CASE WHEN NOT bool_or(t = 1 AND repeats <= {max_repeats}) THEN 1.0
                            WHEN bool_or(t = 0 AND repeats <= {max_repeats}) THEN 0.0
                            ELSE (SELECT high FROM r{narrowings}) END::DOUBLE AS t FROM ends_r)""")
    enough = f"entropy >= {target_entropy} * ln(sources)"
    measure("ends_e", "SELECT t FROM least_t UNION SELECT 1.0::DOUBLE")
    narrow("e", "SELECT t AS low, 1.0::DOUBLE AS high FROM least_t", enough, True)
    steps.append(f"""
    chosen AS (SELECT CASE WHEN any_value(sources) < 2 OR bool_or(t = 1 AND {enough}) THEN 1.0
                           WHEN NOT bool_or(t = (SELECT t FROM least_t) AND {enough}) THEN (SELECT t FROM least_t)
                           ELSE (SELECT low FROM e{narrowings}) END::DOUBLE AS t FROM ends_e),
    raised AS (SELECT source, tokens, total, exp(t * ln(tokens / total)) AS x FROM totals, whole, chosen),
    plan AS (SELECT source, tokens, round(round(x / (SELECT sum(x) FROM raised), 12) * total)::BIGINT AS budget,
                    greatest(ceil(tokens / {float(block_tokens)}), 1)::BIGINT AS blocks FROM raised),
    placed AS (SELECT doc_id, source, n, tokens, budget, ceil(budget / tokens)::BIGINT AS epochs,
                      ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT % blocks AS block
               FROM sizes JOIN plan USING (source) WHERE n > 0),
    held AS (SELECT source, block, tokens, budget, unnest(range(epochs)) AS epoch, sum(n) AS held
             FROM placed GROUP BY source, block, tokens, budget, epochs),
    starts AS (SELECT source, block, epoch, budget, epoch * tokens + coalesce(sum(held) OVER (
                 PARTITION BY source, epoch ORDER BY md5(source || ':' || block || ':' || epoch), block
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM held),
    taken AS (SELECT doc_id, p.source, epoch, block, n, s.budget, before + coalesce(sum(n) OVER (
                 PARTITION BY p.source, block, epoch ORDER BY md5(doc_id || ':' || epoch), doc_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
              FROM placed p JOIN starts s USING (source, block) WHERE before < s.budget)""")
    return f"""WITH {",".join(steps)}
    SELECT doc_id, CASE WHEN source <> '' THEN substr(source, 2) END AS source, epoch::BIGINT AS epoch,
           block::BIGINT AS block, n::BIGINT AS n_tokens, start::BIGINT AS start
    FROM taken WHERE start < budget"""
