"""Quotation linking: who answers whom, from the passages that messages quote; built-in functions alone.

Lines that begin with ``>`` are quoted, one level for each. Normalised lines are hashed; a quoted line belongs to the
earliest message of the conversation that has it as its own. A message replies to the one it quotes most at the lowest
level, else to the one before it. Runs of messages that quote nothing follow the last that did; these runs form the
tree of replies, and their path orders a conversation by replies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyward.llm.common import staged, table

BLOCK = 512  # turns that meet in one task
_PREFIX = r"^(?:\s*>)+"
_ATTRIBUTION = r"(?i)^\s*(on|am|le|el)\b.*\b(wrote|schrieb|écrit|escribió)\s*:\s*$"


def parsed(text: Column) -> Column:
    """level, body and norm of each line of a whole text (null: none)."""
    lines = F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")

    def line(x: Column) -> Column:
        prefix = F.regexp_extract(x, _PREFIX, 0)
        body = F.regexp_replace(x, _PREFIX + r"\s?", "")
        return F.struct(
            F.length(F.regexp_replace(prefix, "[^>]", "")).alias("level"),
            body.alias("body"),
            F.lower(F.trim(F.regexp_replace(body, r"\s+", " "))).alias("norm"),
        )

    return F.transform(lines, line)


def own_text(lines: Column) -> Column:
    """The lines a message does not quote, without lines that only name whom it quotes."""
    kept = F.filter(lines, lambda x: (x.level == 0) & ~x.body.rlike(_ATTRIBUTION))
    return F.trim(F.array_join(F.transform(kept, lambda x: x.body), "\n"))


def links(messages: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to, n_linked (quoted lines found) of messages whose quotes are found in earlier ones."""
    lines = messages.select("conv_id", "turn", F.explode("lines").alias("line")).where("line.norm <> ''")
    lines = lines.select("conv_id", "turn", "line.level", F.md5("line.norm").alias("hash"))
    # One row for each distinct line of a conversation, so repeats collapse before they are joined.
    quoted = lines.where("level > 0").groupBy("conv_id", "turn", "level", "hash").agg(F.count("*").alias("n"))
    sources = lines.where("level = 0").groupBy("conv_id", "hash").agg(F.min("turn").alias("source"))
    votes = quoted.join(sources, ["conv_id", "hash"]).where("source < turn")
    votes = votes.groupBy("conv_id", "turn", "level", "source").agg(F.sum("n").alias("n"))
    best = F.max(F.struct((-F.col("level")).alias("level"), "n", "source")).alias("best")
    return votes.groupBy("conv_id", "turn").agg(best, F.sum("n").alias("n_linked")).select(
        "conv_id", "turn", F.col("best.source").alias("reply_to"), "n_linked"
    )


def _runs(messages: DataFrame) -> DataFrame:
    """messages with before (the turn before) and start (the turn that begins its run), by blocks of turns."""
    at = F.floor(F.col("turn") / BLOCK).alias("block")
    begins = F.when(F.col("reply_to").isNotNull(), F.col("turn"))
    blocked = messages.select("*", at)
    blocks = blocked.groupBy("conv_id", "block").agg(
        F.max("turn").alias("last"), F.min("turn").alias("first"), F.max(begins).alias("begun")
    )
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(
        "conv_id",
        "block",
        F.max("last").over(earlier).alias("latest"),
        F.max("begun").over(earlier).alias("begun"),
        F.coalesce(F.min("first").over(earlier), "first").alias("opening"),
    )
    inside = Window.partitionBy("conv_id", "block").orderBy("turn")
    so_far = inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    strictly = inside.rangeBetween(Window.unboundedPreceding, -1)
    local = blocked.select("*", F.max("turn").over(strictly).alias("near"), F.max(begins).over(so_far).alias("own"))
    same = (local.conv_id.eqNullSafe(carried.conv_id)) & (local.block.eqNullSafe(carried.block))
    return local.join(carried, same, "left").select(
        *(local[c] for c in messages.columns),
        F.coalesce(local.near, carried.latest).alias("before"),
        F.coalesce(local.own, carried.begun, carried.opening).alias("start"),
    )


def _name(turn: Column) -> Column:
    return F.lpad(turn.cast("string"), 12, "0")


def _paths(runs: DataFrame) -> DataFrame:
    """conv_id, start, path, depth of runs that begin with a quote: pointer jumping over the runs they answer."""
    of = runs.select("conv_id", F.col("turn").alias("reply_to"), F.col("start").alias("up")).distinct()
    quoting = runs.where("reply_to is not null and turn = start").select("conv_id", "start", "reply_to").distinct()
    tree = quoting.join(of, ["conv_id", "reply_to"]).select("conv_id", "start", "up")
    # up is the next run to look at, or null once the path starts at a run that answers none.
    tree = tree.select("conv_id", "start", "up", _name(F.col("start")).alias("path"), F.lit(1).alias("depth"))
    while True:
        tree = staged(tree, "paths")
        if tree.where("up is not null").isEmpty():
            return tree
        over = tree.select(
            "conv_id", F.col("start").alias("up"), F.col("up").alias("next"), F.col("path").alias("head"), F.col("depth").alias("more")
        )
        joined = tree.join(over, ["conv_id", "up"], "left")
        top = F.col("up").isNotNull() & F.col("more").isNull()
        tree = joined.select(
            "conv_id",
            "start",
            F.col("next").alias("up"),
            F.concat_ws(".", F.when(top, _name(F.col("up"))), "head", "path").alias("path"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
        )


def reply_ordered(conversations: DataFrame) -> DataFrame:
    """Conversations without quotes, in the order of replies.

    conversations: conv_id, turn, role, text; other columns are ignored. One row per message: conv_id, turn, role,
    reply_to (turn), n_quoted, n_linked (quoted lines, and those found), path, depth (of the run in the tree of replies),
    body (without quotes). Rows are sorted by conv_id, path and turn. Null and empty texts have an empty body;
    messages without a turn or conversation link to nothing; repeated rows are kept, a repeated turn counts as one place
    in the order. An empty table gives no rows.
    """
    messages = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        parsed(F.col("text")).alias("lines"),
    )
    linked = links(messages)
    bodies = messages.select(
        "conv_id",
        "turn",
        "role",
        F.size(F.filter("lines", lambda x: x.level > 0)).cast("long").alias("n_quoted"),
        own_text(F.col("lines")).alias("body"),
    ).join(linked, ["conv_id", "turn"], "left")
    runs = staged(_runs(bodies), "runs")
    told = runs.join(_paths(runs), ["conv_id", "start"], "left")
    return told.select(
        "conv_id",
        "turn",
        "role",
        F.coalesce("reply_to", "before").alias("reply_to"),
        "n_quoted",
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.coalesce("path", _name(F.col("start"))).alias("path"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        "body",
    ).orderBy("conv_id", "path", "turn")


def op7_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations in the order of replies, without quotes."""
    return reply_ordered(table(spark, sf_dir, "conversations"))


OP7_SQL = r"""
WITH RECURSIVE parsed AS (
  SELECT rowid AS id, conv_id, turn, role, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM (SELECT row_number() OVER () AS rowid, * FROM conversations)
), lines AS (
  SELECT *, length(regexp_replace(regexp_extract(line, '^(?:\s*>)+'), '[^>]', '', 'g')) AS level,
    regexp_replace(line, '^(?:\s*>)+\s?', '') AS body
  FROM parsed
), norms AS (
  SELECT *, lower(trim(regexp_replace(body, '\s+', ' ', 'g'))) AS norm FROM lines
), sources AS (
  SELECT conv_id, norm, min(turn) AS source FROM norms WHERE level = 0 AND norm <> '' GROUP BY ALL
), votes AS (
  SELECT n.conv_id, n.turn, n.level, s.source, count(*) AS n
  FROM norms n JOIN sources s ON s.conv_id = n.conv_id AND s.norm = n.norm AND s.source < n.turn
  WHERE n.level > 0 GROUP BY ALL
), linked AS (
  SELECT conv_id, turn, arg_max(source, {'l': -level, 'n': n, 's': source}) AS reply_to, sum(n) AS n_linked
  FROM votes GROUP BY ALL
), bodies AS (
  SELECT id, conv_id, turn, any_value(role) AS role, count(*) FILTER (WHERE level > 0) AS n_quoted,
    trim(coalesce(string_agg(body, chr(10) ORDER BY place) FILTER (WHERE level = 0 AND NOT regexp_matches(body,
      '(?i)^\s*(on|am|le|el)\b.*\b(wrote|schrieb|écrit|escribió)\s*:\s*$')), ''), ' ') AS body
  FROM lines GROUP BY id, conv_id, turn
), runs AS (
  SELECT b.*, l.reply_to, coalesce(l.n_linked, 0) AS n_linked,
    max(b.turn) OVER (PARTITION BY b.conv_id ORDER BY b.turn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
    coalesce(max(CASE WHEN l.reply_to IS NOT NULL THEN b.turn END) OVER (PARTITION BY b.conv_id ORDER BY b.turn),
      min(b.turn) OVER (PARTITION BY b.conv_id)) AS start
  FROM bodies b LEFT JOIN linked l USING (conv_id, turn)
), tree AS (
  SELECT DISTINCT r.conv_id, r.start, lpad(r.start::VARCHAR, 12, '0') AS path, 0 AS depth
  FROM runs r WHERE NOT EXISTS (SELECT 1 FROM linked l WHERE l.conv_id = r.conv_id AND l.turn = r.start)
  UNION ALL
  SELECT r.conv_id, r.start, t.path || '.' || lpad(r.start::VARCHAR, 12, '0'), t.depth + 1
  FROM tree t JOIN (SELECT DISTINCT q.conv_id, q.start, s.start AS up
    FROM runs q JOIN runs s ON s.conv_id = q.conv_id AND s.turn = q.reply_to WHERE q.turn = q.start) r
  ON r.conv_id = t.conv_id AND r.up = t.start
)
SELECT r.conv_id, r.turn, r.role, coalesce(r.reply_to, r.prev) AS reply_to, r.n_quoted, r.n_linked::BIGINT AS n_linked,
  t.path, t.depth::BIGINT AS depth, r.body
FROM runs r JOIN tree t ON t.conv_id = r.conv_id AND t.start = r.start
"""
