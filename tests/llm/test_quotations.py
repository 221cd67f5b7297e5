import random
import re

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from demandspark.llm import quotations as op

SCHEMA = "conv_id long, turn long, role string, text string"


def chat(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.selectExpr("*", "turn AS copy", "text AS own", "conv_id AS level", "role AS hash", "turn AS thread")


def found(spark, rows):
    return {(r.conv_id, r.turn): r for r in op.linked(chat(spark, rows)).collect()}


def test_levels_links_and_threads(spark):
    got = found(spark, [
        (1, 0, "user", "Hello there.\n\nHow do I  sort\na list?"),
        (1, 1, "assistant", "> how do i sort A LIST?\nUse sorted."),
        (1, 2, "user", "> > How do I sort\n> > a list?\n> Use sorted.\n\nThanks\n"),
        (1, 3, "user", ">Hello there.\nHi"),
        (1, 4, "user", "unrelated"),
        (2, 0, "user", "> Use sorted.\nseen elsewhere"),
        (2, 1, "user", "> never said\nfoo"),
        (3, 0, "user", None),
        (3, 1, "user", "> "),
    ])
    assert [got[1, t]["text"] for t in range(4)] == ["Hello there.\n\nHow do I  sort\na list?", "Use sorted.", "Thanks", "Hi"]
    link = lambda k: (got[k].reply_conv, got[k].reply_turn)
    assert link((1, 1)) == (1, 0) and link((1, 2)) == (1, 1) and link((1, 3)) == (1, 0)
    assert link((1, 4)) == (None, None) and link((2, 0)) == (1, 1) and link((2, 1)) == (None, None)
    assert [(got[1, t].thread, got[1, t].depth) for t in range(5)] == [(0, 0), (0, 1), (0, 2), (0, 1), (4, 0)]
    assert (got[1, 2].n_quotes, got[1, 2].max_level) == (2, 2)
    assert got[3, 0]["text"] == got[3, 1]["text"] == "" and got[3, 1].reply_turn is None
    order = [(r.conv_id, r.turn) for r in op.conversations(chat(spark, [(1, 0, "u", "a"), (1, 1, "u", "b"), (1, 2, "u", "> a\nc")])).collect()]
    assert order == [(1, 0), (1, 2), (1, 1)]


def brute(rows):
    """Links by looking every quote up in every earlier message."""

    def clean(text):
        return re.sub("[\x20\x09-\x0d]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text)).strip(" ")

    def parse(text):
        runs = []
        for line in (text or "").split("\n"):
            marks = re.match(r"^[ \t]*(?:>[ \t]?)+", line)
            level, body = (marks[0].count(">"), line[marks.end() :]) if marks else (0, line)
            if runs and runs[-1][0] == level and body.strip(" "):
                runs[-1][1].append(body)
            else:
                runs.append((level, [body]))
        return runs

    says, out = {}, {}
    for conv, turn, _, text in rows:
        runs = [r for r in parse(text) if r[0] == 0]
        own = "\n".join(line for _, lines in runs for line in lines)
        said = {clean(own)} | {clean(" ".join(lines)) for _, lines in runs} | {clean(x) for _, lines in runs for x in lines}
        says[conv, turn] = said - {""}
    for conv, turn, _, text in rows:
        best = []
        for level, lines in parse(text):
            for unit in {clean(" ".join(lines)), *map(clean, lines)} - {""} if level else ():
                near = [t for (c, t), s in says.items() if c == conv and t < turn and unit in s]
                first = min(((c, t) for (c, t), s in says.items() if unit in s and c != conv), default=None)
                if near:
                    best.append((level, False, -max(near), (conv, max(near))))
                elif first:
                    best.append((level, True, -first[1], first))
        out[conv, turn] = min(best)[3] if best else (None, None)
    return out


def test_against_brute_force(spark):
    rng = random.Random(9)
    phrases = ["thanks", "How do I sort a list?", "use sorted", "it works", "Why?", "see above", "no"]
    rows = []
    for conv in range(25):
        for turn in range(rng.randrange(1, 8)):
            lines = []
            for _ in range(rng.randrange(5)):
                lines.append("> " * rng.choice([0, 0, 1, 1, 2]) + rng.choice(phrases).replace(" ", rng.choice([" ", "  "])) * rng.choice([1, 1, 0]))
            rows.append((conv, turn, "user", "\n".join(lines)))
    got = found(spark, rows)
    assert {k: (r.reply_conv, r.reply_turn) for k, r in got.items()} == brute(rows)
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"])  # noqa: F841
    sql = sorted(duckdb.connect().execute(op.LINKED_SQL).fetchall())
    assert sql == sorted(map(tuple, got.values()))


def test_other_conversations_when_the_quoters_own_comes_first(spark):
    rows = [
        (1, 0, "user", "> ask me\nask me"),  # says what it quotes in the same turn
        (1, 1, "user", "> later on\nhm"), (1, 2, "user", "later on"),  # repeats a quote in a later turn
        (2, 3, "user", "ask me"), (2, 5, "user", "ask me"), (3, 0, "user", "ask me"),
        (4, 0, "user", "> ask me\nwhy"),
        (5, 0, "user", "> only here\nso"), (5, 1, "user", "only here"),  # nobody else says it
        (9, 4, "user", "later on"),
    ]
    got = {k: (r.reply_conv, r.reply_turn) for k, r in found(spark, rows).items()}
    assert got[1, 0] == (2, 3) and got[1, 1] == (9, 4) and got[4, 0] == (1, 0) and got[5, 0] == (None, None)
    rng = random.Random(4)
    phrases = [f"phrase {k}" for k in range(6)]
    rows = [(c, t, "user", f"> {rng.choice(phrases)}\n{rng.choice(phrases)}") for c in range(12) for t in range(3)]
    for (conv, turn), r in found(spark, rows).items():
        quote = next(x for c, t, _, x in rows if (c, t) == (conv, turn)).split("\n")[0][2:]
        says = [(c, t) for c, t, _, x in rows if x.split("\n")[1] == quote]
        earlier = [k for k in says if k[0] == conv and k[1] < turn]
        others = [k for k in says if k[0] != conv]
        want = max(earlier) if earlier else min(others, default=(None, None))
        assert (r.reply_conv, r.reply_turn) == want


def test_a_phrase_everybody_says_and_quotes(spark):
    rows = [(c, t, "user", "common phrase" if t == 0 else "> common phrase\nand more") for c in range(300) for t in range(3)]
    got = found(spark, rows)
    assert all((got[c, t].reply_conv, got[c, t].reply_turn, got[c, t].thread) == (c, 0, 0) for c in range(300) for t in (1, 2))


def test_long_reply_chain_and_repeated_rows(spark):
    rows = [(1, t, "user", f"line {t}" + (f"\n> line {t - 1}" if t else "")) for t in range(70)] + [(1, 3, "user", "other"), (1, 3, "user", "other")]
    got = op.linked(chat(spark, rows)).collect()
    assert len(got) == 72
    depth = {r.turn: r.depth for r in got if r.turn != 3}
    assert depth == {t: t for t in range(70) if t != 3}


def test_given_table_native_and_empty(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    got = op.linked(df)
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().executedPlan().toString())
    trimmed = df.select("conv_id", "turn", "role", "text")
    assert got.count() == trimmed.count()
    assert op.linked(df.where(F.lit(False))).collect() == []


def test_sql_agrees_where_the_quoters_own_conversation_comes_first(spark):
    import duckdb

    rows = [
        (1, 0, "user", "> ask me\n\nask me"), (2, 3, "user", "ask me"), (2, 4, "bot", "> ask me\n\nyes"), (3, 1, "user", "ask me"),
        (None, 1, "user", "> ask me\n\nhello there"), (4, 0, "user", "> hello there"), (None, 2, "user", "> hello there"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = op.linked(df)
    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype({"conv_id": "Int64"}))
    cursor = con.execute(op.LINKED_SQL)
    names = [d[0] for d in cursor.description]
    want = sorted((tuple(r[names.index(c)] for c in found.columns) for r in cursor.fetchall()), key=repr)
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    assert got == want
    links = {(r.conv_id, r.turn): (r.reply_conv, r.reply_turn) for r in found.collect()}
    assert links[1, 0] == (2, 3) and links[2, 4] == (2, 3)
    # a message without a conversation neither quotes nor is quoted
    assert links[None, 1] == links[None, 2] == links[4, 0] == (None, None)


def test_latest_earlier_across_blocks_of_turns(spark):
    rng = random.Random(4)
    turns = [-3000, -1, 0, 1, 1023, 1024, 1025, 5000, 2**40]
    rows = [(c, t, rng.choice(["say", "> say", "> say\nsay", "other"])) for c in (1, 2, None) for t in turns]
    rows += [(1, t, "> say") for t in range(2000, 2010)] + [(1, None, "say"), (1, None, "> say")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string").selectExpr("*", "text AS hash")
    quotes = df.where("text LIKE '>%'").withColumn("hash", F.lit("say"))
    said = df.where("text LIKE '%say' AND text <> '> say'").withColumn("hash", F.lit("say"))
    got = {(r.conv_id, r.turn): r.from_turn for r in op.latest_earlier(quotes, said).collect()}
    want = {}
    for c, t, text in rows:
        says = [u for d, u, x in rows if d == c and u is not None and t is not None and u < t and x in ("say", "> say\nsay")]
        if c is not None and text.startswith(">") and says:
            want[c, t] = max(says)
    assert got == want and len(want) > 8


def test_many_lines_part_in_linear_time(spark):
    text = "\n".join("> quoted" if i % 2 else f"said {i}" for i in range(40_000))
    df = spark.createDataFrame([(text,), ("",), ("a\n\n> b\n> c\n>> d\n",)], "text string").select(op.passages(F.col("text")).alias("p"))
    long, empty, short = (r.p for r in df.collect())
    assert len(long) == 40_000 and long[39_999].asDict(True) == {"level": 1, "lines": ["quoted"]}
    assert [(p.level, p.lines) for p in empty] == [(0, [""])]
    assert [(p.level, p.lines) for p in short] == [(0, ["a"]), (0, [""]), (1, ["b", "c"]), (2, ["d"]), (0, [""])]
