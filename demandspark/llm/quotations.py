"""Quotation linking: replies are tied to the messages they quote, and quotes are taken out.

A line's quote level is the number of ``>`` before its text. Neighbouring quoted lines of one level are
a passage. Passages and their lines are normalised (ASCII lower case, white space collapsed) and joined by
SHA-256 to what other messages say themselves: their unquoted passages (parted by empty lines), lines
and whole texts. An original is an earlier turn of the same conversation, the latest such one; else the
first message of any other conversation that says it. A message replies to the original of its
least nested linked passage. Threads follow from the replies inside a conversation: a message belongs to
the thread of what it replies to, and ``conv_id, thread, turn`` is an order in which every reply
follows its original and threads stay together. All of it is DataFrame and SQL functions.

Of other conversations the join meets the first messages of the two smallest that say a key, found by
pre-aggregation: one of them is not the quoter's own. So a phrase in a third of all messages makes no
pairs across conversations. Threads are found by pointer jumping on message keys, no conversation is gathered.

Defined cases: a null text is an empty message. Rows that repeat ``conv_id`` and ``turn`` keep their own
text and links, and share the thread of the one with the smallest original. Messages
without quotes reply to nothing and start a thread. A message without ``conv_id`` neither quotes nor is
quoted: where it was said is not known. Lines that normalise to nothing link nothing. Empty tables give
empty results, further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandspark.llm.tables import SPACES, stored

MARKS = r"^[\x20\x09]*(?:>[\x20\x09]?)+"
ASCII = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TURN_BITS = 10


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, *ASCII), f"[{SPACES}]+", " "))


def passages(text: Column) -> Column:
    """Runs of lines of one quote level: ``level``, ``lines``. Empty lines part unquoted passages."""
    lines = F.transform(
        F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n", -1),
        lambda line: F.struct(
            F.regexp_count(F.regexp_extract(line, MARKS, 0), F.lit(">")).alias("level"),
            F.regexp_replace(line, MARKS, "").alias("body"),
        ),
    )

    def runs(lines):
        at = lambda i: F.get(lines, i)
        starts = F.filter(
            F.sequence(F.lit(0), F.size(lines) - 1),
            lambda i: (i == 0) | (at(i)["level"] != at(i - 1)["level"]) | (F.trim(at(i)["body"]) == ""),
        )
        return named(starts, lambda starts: F.transform(starts, lambda i, n: F.struct(
            at(i)["level"].alias("level"),
            F.transform(
                F.slice(lines, i + 1, F.coalesce(F.get(starts, n + 1), F.size(lines)) - i), lambda line: line["body"]
            ).alias("lines"),
        )))

    return named(lines, runs)


def named(value: Column, use) -> Column:
    """``use(value)`` where ``value`` is worked out once a row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def units(rows: DataFrame, quoted: bool) -> DataFrame:
    """Hashes of passages and of their lines (own ones: of the whole message, too)."""
    chosen = F.filter("passages", lambda p: (p["level"] > 0) if quoted else (p["level"] == 0))
    exploded = rows.withColumn("p", F.explode(chosen))
    both = F.concat(F.array(F.array_join("p.lines", " ")), F.col("p.lines"))
    if not quoted:
        both = F.concat(both, F.array("own"))
    each = exploded.select(
        "conv_id", "turn", "copy", F.col("p.level").alias("level"),
        F.explode(F.array_distinct(F.transform(both, normalised))).alias("said"),
    )
    return each.where("said <> ''").select("conv_id", "turn", "copy", "level", F.sha2("said", 256).alias("hash"))


def linked(messages: DataFrame) -> DataFrame:
    """One row per message: ``conv_id, turn, role, text`` (without quotes), ``n_quotes, max_level``,
    ``reply_conv, reply_turn`` (null: none), ``thread`` (turn that starts it) and ``depth`` in it."""
    rows = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("copy", F.xxhash64("role", "text"))
    rows = rows.withColumn("passages", passages(F.col("text")))
    own = F.array_join(F.flatten(F.transform(F.filter("passages", lambda p: p["level"] == 0), lambda p: p["lines"])), "\n")
    own = F.regexp_replace(F.regexp_replace(own, r"\n{3,}", "\n\n"), f"^[{SPACES}]+|[{SPACES}]+$", "")
    rows = stored(rows.withColumn("own", own), "messages")

    said = units(rows.where("own <> ''"), quoted=False)
    quotes = stored(units(rows, quoted=True).distinct(), "quotes")
    said = stored(said.join(quotes.select("hash").distinct(), "hash", "left_semi"), "said")
    near = latest_earlier(quotes, said)
    # other conversations: the first messages of the two that come first, so one is not the quoter's own
    firsts = said.groupBy("hash", "conv_id").agg(F.min("turn").alias("turn"))
    place = F.row_number().over(Window.partitionBy("hash").orderBy(F.col("conv_id").asc_nulls_last()))
    firsts = firsts.withColumn("place", place).where("place <= 2")  # Spark cuts each task's groups to two before the exchange
    pick = lambda k: F.min(F.when(F.col("place") == k, F.struct("conv_id", "turn")))
    far = firsts.groupBy("hash").agg(pick(1).alias("first"), pick(2).alias("second"))
    found = quotes.join(near, ["conv_id", "turn", "hash"], "left").join(far, "hash", "left")
    away = lambda c: F.when(F.col(f"{c}.conv_id") != F.col("conv_id"), F.col(c))
    elsewhere = F.coalesce(away("first"), away("second"))
    origin = F.when(F.col("from_turn").isNotNull(), F.struct("conv_id", F.col("from_turn").alias("turn"))).otherwise(elsewhere)
    replies = found.withColumn("origin", origin).where("origin IS NOT NULL").groupBy("conv_id", "turn", "copy").agg(
        F.min(F.struct("level", (F.col("origin.conv_id") != F.col("conv_id")).alias("away"),
                       (-F.col("origin.turn")).alias("late"), "origin")).alias("best")
    )
    replies = stored(
        replies.select("conv_id", "turn", "copy", F.col("best.origin.conv_id").alias("reply_conv"), F.col("best.origin.turn").alias("reply_turn")),
        "replies",
    )
    heads = threads(replies)
    keys = ["conv_id", "turn", "copy"]
    answered = replies.select(*(F.col(k).alias(f"r_{k}") for k in keys), "reply_conv", "reply_turn")
    result = rows.join(answered, [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in keys], "left")
    heads = heads.select(F.col("conv_id").alias("t_conv"), F.col("turn").alias("t_turn"), "thread", "depth")
    result = result.join(heads, (F.col("conv_id") == F.col("t_conv")) & (F.col("turn") == F.col("t_turn")), "left")
    quoted = F.filter("passages", lambda p: p["level"] > 0)
    return result.select(
        "conv_id", "turn", "role", F.col("own").alias("text"),
        F.size(quoted).cast("long").alias("n_quotes"),
        F.coalesce(F.array_max(F.transform("passages", lambda p: p["level"])), F.lit(0)).cast("long").alias("max_level"),
        "reply_conv", "reply_turn",
        F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
    )


def latest_earlier(quotes: DataFrame, said: DataFrame) -> DataFrame:
    """``conv_id, turn, hash, from_turn``: the latest earlier turn of the conversation that says what a turn quotes.

    Turns are cut into blocks of ``2 ** TURN_BITS``: a window looks back inside its block, another one over
    one row a block, so a phrase that a conversation keeps quoting makes no pairs and no long window."""
    asked = quotes.select("conv_id", "turn", "hash", F.lit(None).cast("long").alias("says")).distinct()
    stated = said.select("conv_id", "turn", "hash", F.col("turn").alias("says")).distinct()
    events = asked.unionByName(stated).where("conv_id IS NOT NULL AND turn IS NOT NULL")
    events = events.withColumn("block", F.shiftright("turn", TURN_BITS))
    key = ["conv_id", "hash"]
    before = (Window.unboundedPreceding, -1)
    blocks = Window.partitionBy(*key).orderBy("block").rowsBetween(*before)
    carried = events.groupBy(*key, "block").agg(F.max("says").alias("last")).withColumn("carried", F.max("last").over(blocks))
    # at one turn the quote comes before what is said, so a turn does not answer itself
    inside = Window.partitionBy(*key, "block").orderBy("turn", F.col("says").asc_nulls_first()).rowsBetween(*before)
    found = events.withColumn("inside", F.max("says").over(inside)).where("says IS NULL")
    found = found.join(carried.select(*key, "block", "carried"), [*key, "block"])
    found = found.withColumn("from_turn", F.coalesce("inside", "carried")).where("from_turn IS NOT NULL")
    return found.select("conv_id", "turn", "hash", "from_turn")


def threads(replies: DataFrame) -> DataFrame:
    """``conv_id, turn, thread, depth`` of all messages that reply inside their conversation.

    Each round a message's pointer jumps to its target's, so the rounds grow with the log of the
    longest chain. Every target lies before its message, so there are no circles."""
    links = replies.where("conv_id = reply_conv").groupBy("conv_id", "turn").agg(F.min("reply_turn").alias("thread"))
    links = stored(links.withColumn("depth", F.lit(1).cast("long")), "threads")
    while True:
        further = links.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("next"), F.col("depth").alias("more"))
        joined = links.join(further, ["conv_id", "thread"], "left")
        if not joined.where("next IS NOT NULL").limit(1).count():
            return links
        links = stored(joined.select(
            "conv_id", "turn", F.coalesce("next", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")
        ), "threads")


def conversations(messages: DataFrame) -> DataFrame:
    """The messages that still say something once quotes are gone, in reply order."""
    return linked(messages).where("text <> ''").orderBy("conv_id", "thread", "turn")


_SAID = r"trim(regexp_replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ')"

LINKED_SQL = rf"""
WITH RECURSIVE messages AS (
  SELECT row_number() OVER () AS k, conv_id, turn, role, regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') AS t FROM conversations),
lines AS (
  SELECT k, i, len(marks) - len(replace(marks, '>', '')) AS level, line[len(marks) + 1:] AS body FROM (
    SELECT k, i, line, regexp_extract(line, '^[\x20\x09]*(?:>[\x20\x09]?)+') AS marks FROM (
      SELECT k, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM messages))),
marked AS (
  SELECT *, sum(CAST(NOT coalesce(level = before AND trim(body, ' ') <> '', false) AS int)) OVER (PARTITION BY k ORDER BY i) AS p
  FROM (SELECT *, lag(level) OVER (PARTITION BY k ORDER BY i) AS before FROM lines)),
passages AS (SELECT k, p, any_value(level) AS level, string_agg(body, ' ' ORDER BY i) AS joined, list(body ORDER BY i) AS bodies FROM marked GROUP BY k, p),
owns AS (
  SELECT k, regexp_replace(regexp_replace(string_agg(body, chr(10) ORDER BY i) FILTER (level = 0), '\n{{3,}}', chr(10) || chr(10), 'g'),
    '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS own, max(level) AS max_level FROM lines GROUP BY k),
base AS (
  SELECT m.*, coalesce(own, '') AS own, max_level, (SELECT count(*) FROM passages p WHERE p.k = m.k AND p.level > 0) AS n_quotes
  FROM messages m JOIN owns USING (k)),
units AS (
  SELECT DISTINCT k, level, said FROM (
    SELECT k, level, {_SAID.format('joined')} AS said FROM passages
    UNION ALL SELECT k, level, {_SAID.format('body')} FROM marked
    UNION ALL SELECT k, 0, {_SAID.format('own')} FROM base) WHERE said <> ''),
quoted AS (SELECT DISTINCT k, conv_id, turn, level, said FROM units JOIN base USING (k) WHERE level > 0),
said AS (SELECT DISTINCT conv_id, turn, said FROM units JOIN base USING (k) WHERE level = 0 AND own <> ''),
near AS (
  SELECT q.k, q.said, max(s.turn) AS from_turn FROM quoted q JOIN said s ON q.conv_id = s.conv_id AND q.said = s.said AND s.turn < q.turn GROUP BY q.k, q.said),
far AS (SELECT said, conv_id AS far_conv, min(turn) AS far_turn FROM said WHERE conv_id IS NOT NULL GROUP BY said, conv_id),
elsewhere AS (
  SELECT q.k, q.said, min(far_conv) AS far_conv, arg_min(far_turn, far_conv) AS far_turn
  FROM (SELECT DISTINCT k, conv_id, said FROM quoted) q JOIN far ON far.said = q.said AND far_conv <> q.conv_id GROUP BY q.k, q.said),
origins AS (
  SELECT q.k, q.level, from_turn IS NULL AS away, CASE WHEN from_turn IS NULL THEN far_conv ELSE q.conv_id END AS reply_conv,
    coalesce(from_turn, far_turn) AS reply_turn
  FROM quoted q LEFT JOIN near USING (k, said) LEFT JOIN elsewhere USING (k, said) WHERE from_turn IS NOT NULL OR far_conv IS NOT NULL),
replies AS (SELECT k, reply_conv, reply_turn FROM (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY level, away, -reply_turn, reply_conv) AS place FROM origins) WHERE place = 1),
links AS (SELECT conv_id, turn, min(reply_turn) AS up FROM replies JOIN base USING (k) WHERE conv_id = reply_conv GROUP BY conv_id, turn),
climb(conv_id, turn, thread, depth) AS (
  SELECT conv_id, turn, up, 1 FROM links
  UNION ALL SELECT c.conv_id, c.turn, l.up, c.depth + 1 FROM climb c JOIN links l ON l.conv_id = c.conv_id AND l.turn = c.thread),
tops AS (SELECT conv_id, turn, arg_max(thread, depth) AS thread, max(depth) AS depth FROM climb GROUP BY conv_id, turn)
SELECT b.conv_id, b.turn, role, own AS text, n_quotes, CAST(max_level AS bigint) AS max_level, reply_conv, reply_turn,
  coalesce(thread, b.turn) AS thread, CAST(coalesce(depth, 0) AS bigint) AS depth
FROM base b LEFT JOIN replies USING (k) LEFT JOIN tops t ON t.conv_id = b.conv_id AND t.turn = b.turn
"""
