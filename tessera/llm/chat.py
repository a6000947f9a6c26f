"""Chat formatting of reply trees, in DataFrame operations only.

Messages point to the message they answer. Self-joins that double their reach (one, two, four ...
replies up) give every message its depth, its root and the score of its path; messages that have
reached their root ask no more, and the few that are still rising are counted and, up to ``FEW``,
sent to the others in place of a shuffle of all. Leaves are ranked per root by that score and the best
branches are chosen. A root with one leaf is all path; for the others the same jump tables, taken
from the longest to the shortest, collect the messages on each chosen path. Only then do texts join. Each
path becomes one conversation: a control mark opens and closes each turn, and inside texts a
backslash precedes every backslash and every character a mark begins with, so that no text can form
a mark and reading back is exact. The loss mask lists the code points of assistant texts.

Defined results: null text and null role count as empty; messages without a tree id are left out; ties between branches go to the longer one,
then to the smaller leaf; messages whose ancestors form a circle belong to no path; a message
whose parent is not in the table is a root; repeated rows are separate turns (chains number
their rows by turn, role, text); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.shared import keep, table

OPEN, END = "### ", " </turn>\n"
ASSISTANT = "assistant"
#: Jump tables at most: paths of up to 2**MAX_LEVELS messages; more only in circles.
MAX_LEVELS = 40
#: Rows up to this number (some 100 bytes each) are broadcast; more are joined by shuffle.
FEW = 200_000


def escaped(c: Column) -> Column:
    r"""A backslash before each of \ # < (the characters that marks begin with)."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"([\\#<])", r"\\$1")


def escaped_role(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"([\\#<:])", r"\\$1")


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def chains(messages: DataFrame, tree: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Linear conversations as trees: each turn answers the one before it."""
    order = W.partitionBy("tree").orderBy("turn", "role", "text")
    named = messages.select(F.col(tree).alias("tree"), F.col(turn).alias("turn"), "role", "text")
    rows = named.select("tree", F.row_number().over(order).cast("bigint").alias("node"), "role", "text")
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def climb(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, node, root, depth, total) of all messages that reach a root, and the jump tables."""
    known = nodes.select("tree", F.col("node").alias("parent"))
    real = nodes.join(known.withColumn("found", F.lit(True)), ["tree", "parent"], "left")
    state, _ = keep(real.select("tree", "node", F.when(F.col("found"), F.col("parent")).alias("jump"), F.col("node").alias("root"), F.when(F.col("found"), 1).otherwise(0).cast("bigint").alias("depth"), F.coalesce("score", F.lit(0.0)).alias("total")), "reply-jumps")
    done, rising, jumps = state.where("jump IS NULL"), state.where("jump IS NOT NULL"), []
    while len(jumps) < MAX_LEVELS and (n := rising.count()):  # messages that have reached their root join no more
        jumps.append(rising.select("tree", "node", "jump"))
        up = done.unionByName(rising).select("tree", F.col("node").alias("jump"), F.col("jump").alias("_jump"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), F.col("total").alias("_total"))
        far = up.join(F.broadcast(rising) if n <= FEW else rising, ["tree", "jump"])
        far = far.select("tree", "node", F.col("_jump").alias("jump"), F.col("_root").alias("root"), (F.col("depth") + F.col("_depth")).alias("depth"), (F.col("total") + F.col("_total")).alias("total"))
        state, _ = keep(far, "reply-jumps")
        done, rising = done.unionByName(state.where("jump IS NULL")), state.where("jump IS NOT NULL")
    return done.drop("jump"), jumps


def paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, rank, node, depth): the messages of the best root-to-leaf paths of every root."""
    placed, jumps = climb(nodes.select("tree", "node", "parent", "score"))
    parents = nodes.where("parent IS NOT NULL").select("tree", F.col("parent").alias("node")).distinct()
    leaves, _ = keep(placed.join(parents, ["tree", "node"], "left_anti"), "reply-leaves")
    of_root = leaves.groupBy("tree", "root").agg(F.count("*").alias("n"), F.min("node").alias("leaf"))
    alone = of_root.where("n = 1").select("tree", "root", "leaf", F.lit(1).alias("rank"))
    out = placed.join(alone, ["tree", "root"]).select("tree", "leaf", "rank", "node", "depth")
    forks, _ = keep(of_root.where("n > 1").select("tree", "root"), "reply-forks")
    if forks.isEmpty():
        return out
    best = W.partitionBy("tree", "root").orderBy(F.desc("total"), F.desc("depth"), "node")
    chosen = leaves.join(forks, ["tree", "root"]).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= branches)
    on_path = chosen.select("tree", F.col("node").alias("leaf"), "rank", "node")
    for jump in reversed(jumps):
        on_path = on_path.unionByName(on_path.join(jump, ["tree", "node"]).select("tree", "leaf", "rank", F.col("jump").alias("node")))
        if len(jumps) > 4:  # long paths: cut the lineage that would double with every level
            on_path, _ = keep(on_path, "reply-paths")
    return out.unionByName(on_path.join(placed.select("tree", "node", "depth"), ["tree", "node"]).select("tree", "leaf", "rank", "node", "depth"))


def format_paths(nodes: DataFrame, branches: int = 1, texts: DataFrame | None = None) -> DataFrame:
    """(tree, leaf, rank, formatted, loss): one conversation per chosen path; loss holds the
    spans [start, end) in code points of assistant texts, as they stand in ``formatted``. ``texts`` (tree, node, role,
    text): where ``nodes`` is given without them; dealt by tree, they are not dealt again while paths are few."""
    texts = (nodes if texts is None else texts).select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), escaped_role(F.col("role")).alias("shown"), escaped(F.col("text")).alias("text"))
    turn = F.struct("depth", "node", "role", "shown", "text")
    chosen, _ = keep(paths(nodes, branches), "reply-paths")
    chosen = F.broadcast(chosen) if chosen.count() <= FEW else chosen  # numbers only: the texts stay where they are
    grouped = texts.join(chosen, ["tree", "node"]).groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    head = lambda t: F.concat(F.lit(OPEN), t["shown"], F.lit(": "))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(head(t), t["text"], F.lit(END))), "")

    def place(acc, t):
        start = acc["at"] + F.char_length(head(t))
        end = start + F.char_length(t["text"])
        mine = F.when(t["role"] == ASSISTANT, F.concat(acc["loss"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(acc["loss"])
        return F.struct((end + len(END)).alias("at"), mine.alias("loss"))

    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start: int, end: int>>)").alias("loss"))
    return grouped.select("tree", "leaf", "rank", formatted.alias("formatted"), F.aggregate("turns", zero, place, lambda a: a["loss"]).alias("loss"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    turns = F.slice(F.split(formatted, END), 1, F.size(F.split(formatted, END)) - 1)

    def one(t):
        shown = F.regexp_extract(t, r"(?s)^### ((?:[^:\\]|\\.)*+): ", 1)
        return F.struct(unescaped(shown).alias("role"), unescaped(F.substr(t, F.char_length(shown) + len(OPEN) + 3)).alias("text"))

    return F.transform(turns, one)


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, as it was before formatting."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


PROBE = r"\### Assistant: </turn> ok"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id bigint, turn bigint, role string, text string")
    every = every.unionByName(probe)
    # the numbers of a chain do not depend on its texts, so these are dealt once, by tree, when paths are known
    plain = every.select("conv_id", "turn", *(F.lit(None).cast("string").alias(c) for c in ("role", "text")))
    nodes, _ = keep(chains(plain).select("tree", "node", "parent", "score"), "chat-nodes")
    out, _ = keep(format_paths(nodes, texts=chains(every)), "chat-formatted")
    read = out.select("tree", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss")).alias("learned"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(F.col("tree").alias("conv_id"), F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("learned").cast("bigint").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.char_length("formatted").cast("bigint").alias("formatted_chars"))


ORACLE = r"""
WITH every AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
shown AS (SELECT *, regexp_replace(text, '([\\#<])', '\\\1', 'g') AS safe, regexp_replace(role, '([\\#<:])', '\\\1', 'g') AS label FROM every),
joined AS (
  SELECT conv_id, count(*) AS n, sum(length(safe) + length(label) + 15) AS chars,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS learned
  FROM shown GROUP BY conv_id)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(n AS BIGINT) AS n_turns, sha256(said) AS turns_sha256,
       CAST(length(learned) AS BIGINT) AS loss_chars, sha256(learned) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM joined"""
