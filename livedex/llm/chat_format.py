"""Chat formatting of reply trees, with DataFrame functions only.

Messages are nodes with a parent; each path from a root to a leaf is a branch.  Self-joins enumerate the paths in a
logarithmic number of rounds: in round k every node knows its 2^k-th ancestor, so joining the nodes with themselves on
that ancestor doubles the reach.  Summed on the way are the depth and the score of the path; each leaf then knows its
root, and branches are ranked by mean score.  The chosen leaves walk back with the same pointers, the longest first, so
a path's nodes also come in a logarithmic number of joins.  Only then are texts joined and turns put together.

Template (control strings are fixed values of this format): a system turn is <<SYS>>text<</SYS>>, a user turn
[INST]text[/INST], an assistant turn <s>text</s>, and a turn of any other role [ROLE]role[TEXT]text[/ROLE].  Inside
roles and texts, a backslash is doubled and a control string gets a backslash after its first character, so no text can
look like a turn, and parsing gives every text back.  The loss mask covers what stands between <s> and </s>.

Defined results: a null text or role is empty; a message whose parent is null or missing is a root; messages on a
cycle have no root and belong to no path; of messages with the same id and parent, each is formatted (ties by role and
text); an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Role -> what opens and closes its turn.
TURNS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE]", "[TEXT]", "[/ROLE]")
#: First character and rest of the control strings, by the first character.
_CONTROL = (("<", "/?s>|</?SYS>>"), ("\\[", "/?INST\\]|/?ROLE\\]|TEXT\\]"))


def escaped(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, "|".join(f"{first}(?={rest})" for first, rest in _CONTROL), "$0\\\\")


def unescaped(text: Column) -> Column:
    # Doubled backslashes come in even runs, so one backslash between a first character and a rest is an escape.
    plain = F.regexp_replace(text, "|".join(f"(?<={first})\\\\(?={rest})" for first, rest in _CONTROL), "")
    return F.replace(plain, F.lit("\\\\"), F.lit("\\"))


def opening(role: Column) -> Column:
    out = F.concat(F.lit(OTHER[0]), escaped(role), F.lit(OTHER[1]))
    for name, (start, _) in TURNS.items():
        out = F.when(role == name, F.lit(start)).otherwise(out)
    return out


def closing(role: Column) -> Column:
    out = F.lit(OTHER[2])
    for name, (_, end) in TURNS.items():
        out = F.when(role == name, F.lit(end)).otherwise(out)
    return out


def ancestors(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Pointers of each round (id, up: the 2^k-th ancestor), and every rooted node's (id, top: its root, depth, score).

    `nodes` has unique ids, parents that exist or are null, and scores.  Depth and score cover the nodes from the one
    named up to, and without, `up`.
    """
    n = nodes.count()
    columns = ("id", "up", "top", "depth", "score")
    state = cut(nodes.select("id", F.col("parent").alias("up"), F.col("id").alias("top"), F.lit(1).cast("long").alias("depth"), F.col("score").cast("double").alias("score")))
    rounds: list[DataFrame] = []
    while True:
        ended, going = state.where("up IS NULL"), state.where("up IS NOT NULL")
        if going.isEmpty() or 1 << len(rounds) > n:  # whatever is left then stands on a cycle
            return rounds, ended.select("id", "top", "depth", "score")
        rounds.append(going.select("id", "up"))
        above = state.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("top").alias("top2"), F.col("depth").alias("depth2"), F.col("score").alias("score2"))
        further = going.drop("top").join(above, "up").select(
            "id", F.col("up2").alias("up"), F.col("top2").alias("top"), (F.col("depth") + F.col("depth2")).alias("depth"), (F.col("score") + F.col("score2")).alias("score")
        )
        state = cut(ended.select(*columns).unionByName(further))


def branches(nodes: DataFrame, per_tree: int = 1) -> tuple[list[DataFrame], DataFrame]:
    """The pointers, and (leaf, root, branch: rank from 1, depth) of the `per_tree` best branches: highest mean score, then longest, then least leaf."""
    rounds, rooted = ancestors(nodes)
    leaves = rooted.join(nodes.select(F.col("parent").alias("id")).where("id IS NOT NULL").distinct(), "id", "left_anti")
    best = Window.partitionBy("top").orderBy((F.col("score") / F.col("depth")).desc(), F.col("depth").desc(), "id")
    chosen = leaves.withColumn("branch", F.row_number().over(best)).where(F.col("branch") <= per_tree)
    return rounds, chosen.select(F.col("id").alias("leaf"), F.col("top").alias("root"), "branch", "depth")


def paths(nodes: DataFrame, per_tree: int = 1) -> DataFrame:
    """(leaf, root, branch, id, step) of every node on a chosen path; step is 0 at the root."""
    rounds, chosen = branches(nodes, per_tree)
    walk = chosen.select("leaf", "root", "branch", F.col("leaf").alias("id"), (F.col("depth") - 1).alias("step"))
    for k in range(len(rounds) - 1, -1, -1):  # every distance to the leaf is one sum of distinct powers of two
        higher = walk.join(rounds[k], "id").select("leaf", "root", "branch", F.col("up").alias("id"), (F.col("step") - (1 << k)).alias("step"))
        walk = walk.unionByName(higher)
        if k % 3 == 0:
            walk = cut(walk)
    return walk


def formatted(messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """One row per chosen branch of messages (id, parent, role, text, score): root, leaf, branch, formatted, loss_spans.

    `formatted` is the conversation's text; `loss_spans` are the (start, length) of its parts under the loss mask, in
    code points.
    """
    messages = cut(messages.select("id", "parent", "role", "text", "score").where("id IS NOT NULL"))
    nodes = cut(messages.groupBy("id").agg(F.min("parent").alias("parent"), F.max("score").alias("score")))
    # Only replies look for their parent: roots have none, and would all meet under one key.
    replies = nodes.where("parent IS NOT NULL").join(nodes.select(F.col("id").alias("parent"), F.lit(True).alias("found")), "parent", "left")
    replies = replies.select("id", F.when(F.col("found"), F.col("parent")).alias("parent"), "score")
    nodes = cut(nodes.where("parent IS NULL").select("id", "parent", "score").unionByName(replies))
    walk = paths(nodes, per_tree)
    turns = messages.select("id", "role", "text")
    turns = turns.select(
        "id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("plain"), opening(F.coalesce("role", F.lit(""))).alias("head"), escaped(F.col("text")).alias("body"), closing(F.coalesce("role", F.lit(""))).alias("tail")
    )
    path = Window.partitionBy("leaf", "root", "branch").orderBy("step", "role", "plain").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("head") + F.length("body") + F.length("tail")
    rows = walk.join(turns, "id").withColumn("place", F.row_number().over(path)).withColumn("end", F.sum(size).over(path))
    span = F.when(F.col("role") == "assistant", F.struct((F.col("end") - F.length("tail") - F.length("body")).cast("long").alias("start"), F.length("body").cast("long").alias("length")))
    grouped = rows.groupBy("leaf", "root", "branch").agg(
        F.array_sort(F.collect_list(F.struct("place", F.concat("head", "body", "tail").alias("turn")))).alias("turns"), F.array_sort(F.collect_list(span)).alias("loss_spans")
    )
    return grouped.select("root", "leaf", "branch", F.array_join(F.col("turns.turn"), "").alias("formatted"), "loss_spans")


def parsed(text: Column) -> Column:
    """The turns of a formatted conversation, as an array of (role, text)."""
    ends = "|".join(f"\\Q{end}\\E" for end in [*(e for _, e in TURNS.values()), OTHER[2]])
    parts = F.filter(F.split(text, f"(?<={ends})"), lambda t: t != "")

    def turn(part: Column) -> Column:
        inner = F.substring(part, F.lit(len(OTHER[0]) + 1), F.length(part) - len(OTHER[0]) - len(OTHER[2]))
        role, body = F.substring_index(inner, OTHER[1], 1), F.substring(inner, F.length(F.substring_index(inner, OTHER[1], 1)) + len(OTHER[1]) + 1, F.length(inner))
        for name, (start, end) in TURNS.items():
            here = F.startswith(part, F.lit(start))
            body = F.when(here, F.substring(part, F.lit(len(start) + 1), F.length(part) - len(start) - len(end))).otherwise(body)
            role = F.when(here, F.lit(name)).otherwise(role)
        return F.struct(unescaped(role).alias("role"), unescaped(body).alias("text"))

    return F.transform(parts, turn)


def loss_text(text: Column) -> Column:
    """All text under the loss mask, unescaped, in order, with nothing between."""
    start, end = TURNS["assistant"]
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(f"(?s)\\Q{start}\\E(.*?)\\Q{end}\\E"), F.lit(1)), unescaped), "")


def conversation_trees(conversations: DataFrame) -> DataFrame:
    """Messages of linear conversations: each turn replies to the one before (rows by turn; ties by role and text).

    The score is constant, so a conversation's only branch is chosen.  Rows without conv_id form one conversation.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("n", F.row_number().over(order))
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    return rows.select(
        F.concat(key, F.lit(":"), F.col("n")).alias("id"), F.when(F.col("n") > 1, F.concat(key, F.lit(":"), F.col("n") - 1)).alias("parent"), "role", "text", F.lit(1.0).alias("score"), "conv_id"
    )


def digests(conversations: DataFrame) -> DataFrame:
    """Formats linear conversations and reads the result back: turns and loss text, as digests."""
    messages = conversation_trees(conversations)
    out = formatted(messages)
    kind = conversations.schema["conv_id"].dataType
    key = F.substring("root", F.lit(2), F.length("root") - 3)  # = id :1
    out = out.select(F.when(F.startswith("root", F.lit("=")), key).cast(kind).alias("conv_id"), "formatted", "loss_spans", parsed(F.col("formatted")).alias("turns"), loss_text(F.col("formatted")).alias("loss"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The digests in DuckDB's SQL over `conversations`, for the columns that don't depend on the template's escapes.
ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, regexp_replace(regexp_replace(replace(text, '\', '\\'),
    '(<)(/?s>|</?SYS>>)', '\1\\\2', 'g'), '(\[)(/?INST\]|/?ROLE\]|TEXT\])', '\1\\\2', 'g') AS body FROM turns
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(body) + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 19 + length(role) END)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""
