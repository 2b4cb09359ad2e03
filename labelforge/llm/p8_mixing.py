"""Problem 8: documents of several sources combined to target shares of all tokens.

The total is the largest that lets every source give its share within its
repeats. A source first gives as many complete epochs as fit into its budget;
the rest is drawn by Efraimidis-Spirakis sampling: every document gets an
exponential key divided by its quality weight, and the documents with the
smallest keys are taken while their summed tokens stay within the budget.

The sum is distributed: keys fall into bins of their logarithm, whole bins of a
source are taken by their sums, and only the bin in which the budget ends is
sorted. Whatever the weights, a bin holds at most about 0.37 * ln 2 / KEY_STEPS
of a source's documents (0.025 %).
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelforge.llm import tokens
from labelforge.session import cut_lineage

SEED = 20240917
#: Bins of keys for each doubling of the key; about 60 doublings are possible.
KEY_STEPS = 1024


def quality(text: Column) -> Column:
    """Weight of a document, from 0.05 to 1: sentences that don't repeat, and enough of them to say something."""
    sentences = F.filter(F.split(text, r"[。！？!?\n]|\.\s"), lambda s: F.length(s) > 1)
    total = F.greatest(F.size(sentences), F.lit(1))
    fresh = F.size(F.array_distinct(sentences)) / total
    return F.greatest(F.lit(0.05), fresh * F.least(F.lit(1.0), F.sqrt(F.length(text) / 400.0)))


def _key(seed: int) -> Column:
    """A uniform number in (0, 1) that depends on the document alone."""
    h = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(seed)), 11)
    return (h.cast("double") + 0.5) / float(1 << 53)


def mix(documents: DataFrame, targets: DataFrame, seed: int = SEED, vocabulary: str = tokens.VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """Chosen documents with their repeats, and the report per source.

    Documents of other or null sources, and texts without tokens, are not
    chosen. A source without documents, or with a share or repeats of 0, gives
    nothing and does not hold the others back. Shares are divided by their sum.
    Repeated rows of a document are documents of their own.
    """
    wanted = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    sized = documents.select("doc_id", "source", "text").join(F.broadcast(wanted.select("source")), "source").select("doc_id", "source", tokens.token_count(F.col("text"), vocabulary).alias("tokens"), (-F.log(_key(seed)) / quality(F.col("text"))).alias("key"))
    sized = cut_lineage(sized.where("tokens > 0").withColumn("key_bin", F.floor(KEY_STEPS * F.log2(F.greatest(F.col("key"), F.lit(1e-300)))).cast("int")))
    bins = cut_lineage(sized.groupBy("source", "key_bin").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")))
    held = bins.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs"))
    # everything per source is as small as the fixed list of targets
    plan = wanted.join(held, "source", "left").na.fill({"tokens": 0, "docs": 0})
    gives = (F.col("tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    every = Window.partitionBy(F.lit(1))
    plan = plan.withColumn("share", F.col("target_share") / F.sum("target_share").over(every)).withColumn("total", F.min(F.when(gives, F.col("tokens") * F.col("max_repeats") / F.col("share"))).over(every))
    plan = plan.withColumn("budget", F.when(gives, F.floor(F.least(F.col("share") * F.col("total"), (F.col("tokens") * F.col("max_repeats")).cast("double")) + 1e-6)).otherwise(0))
    plan = plan.withColumn("epochs", F.when(gives, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0)).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))
    plan = cut_lineage(plan)
    before = bins.select("source", "key_bin", (F.sum("tokens").over(Window.partitionBy("source").orderBy("key_bin")) - F.col("tokens")).alias("before"), F.col("tokens").alias("bin_tokens"))
    state = before.join(F.broadcast(plan.select("source", "epochs", "rest")), "source")
    state = state.select("source", "key_bin", "epochs", "rest", "before", F.when(F.col("before") + F.col("bin_tokens") <= F.col("rest"), "in").when(F.col("before") >= F.col("rest"), "out").otherwise("edge").alias("state"))
    placed = sized.join(F.broadcast(state), ["source", "key_bin"])
    # one bin of a source at most is sorted
    running = F.sum("tokens").over(Window.partitionBy("source", "key_bin").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    edge = placed.where("state = 'edge'").withColumn("extra", (F.col("before") + running <= F.col("rest")).cast("int"))
    rest = placed.where("state <> 'edge'").withColumn("extra", (F.col("state") == "in").cast("int"))
    out = edge.unionByName(rest).select("doc_id", "source", "tokens", (F.col("epochs") + F.col("extra")).cast("int").alias("repeats")).where("repeats > 0")
    return out, plan


def shares(chosen: DataFrame, plan: DataFrame) -> DataFrame:
    """Target and actual share of every source of the target list."""
    got = chosen.groupBy("source").agg(F.count("*").alias("chosen_docs"), F.sum(F.col("tokens") * F.col("repeats")).alias("chosen_tokens"), F.max("repeats").alias("most_repeats"))
    table = plan.join(got, "source", "left").na.fill({"chosen_docs": 0, "chosen_tokens": 0, "most_repeats": 0})
    total = F.sum("chosen_tokens").over(Window.partitionBy(F.lit(1)))
    return table.select("source", F.col("share").alias("target_share"), F.coalesce(F.round(F.try_divide(F.col("chosen_tokens"), total), 6), F.lit(0.0)).alias("actual_share"), "max_repeats", "most_repeats", F.col("docs").alias("available_docs"), "chosen_docs", F.col("tokens").alias("available_tokens"), "chosen_tokens")
