"""Message histories: budgets of tokens, buffers, reply chains. Rows (conv, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from braidwork.functions.text import words


def greedy(messages: DataFrame, budget: int, assistant_weight: int = 2) -> DataFrame:
    """(conv, turn): the newest messages that fit; one that does not is skipped and older ones are still tried.

    Needs a column ``tokens``. Empty texts are dropped first. A conversation is
    folded as one array, newest first: the rule depends on all later choices.
    """
    cost = F.col("tokens") * F.when(F.col("role") == "assistant", assistant_weight).otherwise(1)
    rows = messages.where(F.length("text") > 0).groupBy("conv").agg(F.reverse(F.array_sort(F.collect_list(F.struct("turn", cost.cast("long").alias("cost"))))).alias("m"))

    def step(a, x):
        fits = a["used"] + x["cost"] <= budget
        return F.struct(F.when(fits, a["used"] + x["cost"]).otherwise(a["used"]).alias("used"), F.when(fits, F.array_append(a["kept"], x["turn"])).otherwise(a["kept"]).alias("kept"))

    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("kept"))
    return rows.select("conv", F.explode(F.aggregate("m", start, step, lambda a: a["kept"])).alias("turn"))


def prefix(messages: DataFrame, budget: int) -> DataFrame:
    """Newest messages up to the first that does not fit: a running sum, as tokens are not negative."""
    used = F.sum("tokens").over(W.partitionBy("conv").orderBy(F.desc("turn")).rowsBetween(W.unboundedPreceding, 0))
    return messages.withColumn("used", used).where(F.col("used") <= budget)


def last_n(messages: DataFrame, n: int, with_newest: bool = True) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("conv").orderBy(F.desc("turn")))
    low = 0 if with_newest else 1
    return messages.withColumn("_r", rank).where((F.col("_r") > low) & (F.col("_r") <= n + low)).drop("_r")


def without_first(messages: DataFrame, n: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("conv").orderBy("turn"))
    return messages.withColumn("_r", rank).where(F.col("_r") > n).drop("_r")


def without_last(messages: DataFrame, n: int) -> DataFrame:
    """Without the newest ``n``; 0 removes none."""
    rank = F.row_number().over(W.partitionBy("conv").orderBy(F.desc("turn")))
    return messages.withColumn("_r", rank).where(F.col("_r") > n).drop("_r")


def spoken(messages: DataFrame) -> DataFrame:
    """Messages of all roles but "system"; those without a role are plain texts and stay."""
    return messages.where(F.coalesce("role", F.lit("")) != "system")


def history(nodes: DataFrame) -> DataFrame:
    """(conv, texts): the texts of all nodes (conv, id, parent, ordinal, text) but roots, in order of ordinal and id."""
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "id", "text")))
    return nodes.where("parent IS NOT NULL").groupBy("conv").agg(F.transform(ordered, lambda x: x["text"]).alias("texts"))


def texts(nodes: DataFrame) -> DataFrame:
    """(conv, texts): the texts of all nodes that are not empty."""
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "id", "text")))
    return nodes.where(F.length("text") > 0).groupBy("conv").agg(F.transform(ordered, lambda x: x["text"]).alias("texts"))


def story(segments_: DataFrame, paragraph: str = "\n\n", delimiter: str = "\n", special: bool = True) -> DataFrame:
    """(run, story) of segments (run, n, segment), appended in order.

    In special mode the title of a part ("**Part 1: ...") goes: what follows
    its last ": " stays, ended by a paragraph. Other segments end with the
    paragraph they have, or else get the delimiter.
    """
    s = F.col("segment")
    bare = lambda c: F.regexp_replace(c, f"[{paragraph}]+$", "")
    titled = (s.contains("**Part") | s.contains("** Part")) & s.contains(": ")
    tail = F.element_at(F.split(s, ": "), -1)
    by_rule = F.when(titled, F.concat(bare(tail), F.lit(paragraph))).when(s.endswith(paragraph), F.concat(bare(s), F.lit(paragraph))).otherwise(F.concat(s, F.lit(delimiter)))
    rows = segments_.withColumn("s", by_rule if special else s)
    return rows.groupBy("run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "s"))), lambda x: x["s"]), "").alias("story"))


def predefined(prompts: DataFrame, system: str, opening: str, closing: str, answer: str) -> DataFrame:
    """(conv, pos, role, text): four messages for each prompt (conv, prompt): system, the opening, the prompt with ``closing`` on a line of its own, the begun answer."""
    m = [("system", F.lit(system)), ("user", F.lit(opening)), ("user", F.concat("prompt", F.lit("\n" + closing))), ("assistant", F.lit(answer))]
    return prompts.select("conv", F.posexplode(F.array(*[F.struct(F.lit(r).alias("role"), t.alias("text")) for r, t in m])).alias("pos", "x")).select("conv", "pos", "x.role", "x.text")


def chosen(options: DataFrame, last: DataFrame) -> DataFrame:
    """(run, option): of each run's options (run, pos, option) the first that is not the one used ``last`` (run, option), else none."""
    used = last.select("run", F.col("option").alias("used"))
    fresh = options.join(used, "run", "left").where(~F.col("option").eqNullSafe(F.col("used")))
    return fresh.groupBy("run").agg(F.min_by("option", "pos").alias("option"))


#: Roles and the names that a buffer shows.
SPEAKERS = (("user", "Human"), ("assistant", "AI"), ("system", "System"))


def speaker(role: Column) -> Column:
    """The name of a role; an unknown role raises an error."""
    out = F.raise_error(F.concat(F.lit("unknown role: "), role)).cast("string")
    for key, name in reversed(SPEAKERS):
        out = F.when(role == key, F.lit(name)).otherwise(out)
    return out


def novelty(messages: DataFrame) -> DataFrame:
    """(conv, turn, novelty): each message (conv, turn, text) against all texts before it, as ``functions.text.novelty`` defines it.

    Distinct words are counted where they come first in a conversation, so
    what a turn compares with is a running count and no copy of the history.
    """
    rows = messages.select("conv", "turn", "text")
    each = rows.select("conv", "turn", F.explode(words(F.lower("text"))).alias("word"))
    seen = each.groupBy("conv", "turn", "word").agg(F.count("*").alias("times"))
    seen = seen.withColumn("fresh", F.col("turn") == F.min("turn").over(W.partitionBy("conv", "word")))
    counts = seen.groupBy("conv", "turn").agg(F.count("*").alias("n"), F.sum("times").alias("size"), F.count_if("fresh").alias("fresh"))
    before = W.partitionBy("conv").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    running = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(0))).over(before), F.lit(0))
    j = rows.join(counts, ["conv", "turn"], "left").withColumns({"m": running("fresh"), "k": running("size"), "n": F.coalesce("n", F.lit(0))})
    overlap = F.col("n") - F.coalesce("fresh", F.lit(0))
    both = F.col("n") + F.col("m")
    damp = F.greatest(1 - F.col("k") / 5, F.lit(0.2)) * F.greatest(F.col("n") / 5, F.lit(0.2))
    value = (1 - 2 * overlap / F.greatest(both, F.lit(1))) * damp
    return j.select("conv", "turn", F.when(both == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))).alias("novelty"))


def buffer(messages: DataFrame) -> DataFrame:
    """(conv, buffer): "name: text" lines in order."""
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat(speaker(F.col("role")), F.lit(": "), F.col("text")).alias("line"))))
    return messages.groupBy("conv").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("buffer"))


def reply_chain(pairs: DataFrame, system: str) -> DataFrame:
    """Rows (conv, pos, role, text) from pairs (conv, n, prompt, response): the system message once, then of each pair the response before the prompt."""
    first = pairs.select("conv").distinct().select("conv", F.lit(-1).cast("long").alias("n"), F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("text"))).alias("m"))
    rest = pairs.select("conv", F.col("n").cast("long").alias("n"), F.array(F.struct(F.lit("assistant").alias("role"), F.col("response").alias("text")), F.struct(F.lit("user").alias("role"), F.col("prompt").alias("text"))).alias("m"))
    rows = first.unionByName(rest).select("conv", "n", F.posexplode("m").alias("k", "x"))
    return rows.select("conv", (F.row_number().over(W.partitionBy("conv").orderBy("n", "k")) - 1).alias("pos"), "x.role", "x.text")


def segments(tokens: DataFrame, delimiter: str) -> DataFrame:
    """(run, n, segment) from tokens (run, seq, token): the batch twin of the streaming segmenter.

    The buffer takes each token; if it then holds the delimiter, the trimmed
    text before the first is emitted, at most one per token, and the rest
    stays. What is left at the end, if not blank, is the last segment.
    """
    rows = tokens.where(F.col("token").isNotNull()).groupBy("run").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "token"))), lambda x: x["token"]).alias("t"))
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")

    def step(a, token):
        text = F.concat(a["open"], token)
        at = F.instr(text, F.lit(delimiter))
        return F.struct(
            F.when(at > 0, F.substring(text, at + len(delimiter), F.length(text))).otherwise(text).alias("open"),
            F.when(at > 0, F.array_append(a["out"], strip(F.substring(text, F.lit(1), at - 1)))).otherwise(a["out"]).alias("out"),
        )

    start = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("out"))
    last = lambda a: F.when(strip(a["open"]) != "", F.array_append(a["out"], strip(a["open"]))).otherwise(a["out"])
    return rows.select("run", F.posexplode(F.aggregate("t", start, step, last)).alias("n", "segment"))
