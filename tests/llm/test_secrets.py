import hashlib
import re

import duckdb
from samples import clashing, documents, empty

from demandspark.llm import secrets as op

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)


def base(text):
    """The spans as the task words them: first all matches, then those too short dropped."""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)


def brute(doc, text):
    own = base(text or "")
    more = [
        (m.start(), n, r.kind, m.end())
        for n, r in enumerate(op.RULES) if n >= len(op.BASE) for m in re.finditer(r.pattern, text or "")
    ]
    count = lambda k: sum(s[2] == k for s in own)
    digest = hashlib.sha256(joined(own).encode()).hexdigest()
    return doc, count("assign"), count("access"), count("hex"), digest, joined(sorted(own + more))


def test_queries_of_expressions():
    q = lambda p: sorted(sorted(s) for s in op.trigram_query(p))
    assert q("abcd") == [["abc", "bcd"]]
    assert q("abc|xyz") == [["abc"], ["xyz"]]
    assert q("[0-9a-f]{32,}") == [[]] and q("ab+c") == [[]] and q("(abc)?") == [[]]
    assert q("(?:abc)+d*") == [["abc"]]
    assert q("api_?key") == [["_ke", "api", "i_k", "key", "pi_"], ["api", "ike", "key", "pik"]]
    assert q(op.BASE[1].pattern) == [["aki", "kia"]]
    _, scans = op.queries(op.RULES)
    assert scans == ["hex"]


def more_texts():
    return [
        "token=secret:abcdefgh", "api-key=abcdefgh1", "APIKEY :  'abcdefg' Api_Key\"=\"abcdefgh", "AKIA" + "A" * 11, "AKIA" + "A" * 12,
        "a" * 32 + "g" + "f" * 31, "F" * 40, "password=" * 9 + "x", "ſecret=abcdefgh toKen=abcdefgh", "token=" + "x" * 20_000, "ghp_" + "Z" * 35,
    ]


def test_against_brute_force(spark):
    docs = documents(spark)
    extra = spark.createDataFrame([(20_000 + k, t) for k, t in enumerate(more_texts())], "doc_id long, text string")
    docs = docs.unionByName(clashing(extra), allowMissingColumns=True)
    got = sorted(map(tuple, op.secrets(docs).collect()), key=repr)
    assert got == sorted((brute(r["doc_id"], r["text"]) for r in docs.collect()), key=repr)
    assert sum(r[1] for r in got) > 3 and sum(r[3] for r in got) > 2


def test_sql_says_the_same(spark):
    docs = documents(spark, long_words=500)
    pandas = docs.select("doc_id", "text").toPandas()  # noqa: F841
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM pandas")
    assert sorted(con.execute(op.SECRETS_SQL).fetchall(), key=repr) == sorted(map(tuple, op.secrets(docs).collect()), key=repr)


def test_no_python_on_the_executors(spark):
    plan = op.secrets(documents(spark, long_words=50))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_table(spark):
    assert op.secrets(empty(spark)).collect() == []
