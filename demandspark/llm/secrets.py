"""Secret scans through a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams that every match must
contain: literal runs give conjunctions, alternatives give disjunctions (:func:`trigram_query`). The
index holds, for the trigrams that the rules ask for, the documents that have them (lower case).
Postings are intersected per conjunct; only documents that pass are verified by the expression itself.
Rules without a mandatory trigram scan every text. All of it is DataFrame and SQL functions.

Defined cases: a null text counts as empty and has no spans. Equal rows are scanned one by one.
Spans count code points, the end excluded; matches of one rule do not overlap, those of different
rules may. Empty tables give empty results, further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandspark.llm.tables import ids_and_texts, stored

#: More alternatives than this end a literal run.
MOST_STRINGS = 48


@dataclass(frozen=True)
class Rule:
    """``pattern`` means the same in Java, Python and RE2. Matches count if ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=8,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    # runs of hexadecimal digits are maximal, so a shorter run holds no match of this either
    Rule("hex", r"[0-9a-f]{32,}", least=32),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)
RULES = BASE + MORE

Query = list[frozenset[str]]  # any of the sets, all of a set's trigrams


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def simplest(query: Query) -> Query:
    """Without sets that include another one; a set without trigrams makes the query always true."""
    sets = sorted(set(query), key=lambda s: (len(s), sorted(s)))
    kept: Query = []
    for s in sets:
        if not any(k <= s for k in kept):
            kept.append(s)
    return kept


def both(a: Query, b: Query) -> Query:
    return simplest([x | y for x in a for y in b])


def _strings(token) -> set[str] | None:
    """All strings that one parsed element can match, if they are few."""
    kind, value = token
    if kind is op.LITERAL:
        return {chr(value).lower()}
    if kind is op.IN:
        found: set[str] = set()
        for k, v in value:
            if k is op.LITERAL:
                found.add(chr(v).lower())
            elif k is op.RANGE and v[1] - v[0] < MOST_STRINGS:
                found |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None
        return found if len(found) <= MOST_STRINGS // 4 else None
    if kind is op.SUBPATTERN:
        return _sequence_strings(value[-1])
    if kind is op.BRANCH:
        each = [_sequence_strings(b) for b in value[1]]
        return None if any(e is None for e in each) else set().union(*each)
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[1] == 1:
        inner = _sequence_strings(value[2])
        return None if inner is None else inner | ({""} if value[0] == 0 else set())
    return None


def _sequence_strings(tokens) -> set[str] | None:
    out = {""}
    for t in tokens:
        more = _strings(t)
        if more is None or len(out) * len(more) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def _query(tokens) -> Query:
    query, run = [frozenset()], {""}
    for t in tokens:
        more = _strings(t)
        if more is not None and len(run) * len(more) <= MOST_STRINGS:
            run = {a + b for a in run for b in more}
            continue
        query, run = both(query, simplest([trigrams(s) for s in run])), {""}
        kind, value = t
        if more is not None:
            run = more
        elif kind is op.SUBPATTERN:
            query = both(query, _query(value[-1]))
        elif kind is op.BRANCH:
            query = both(query, simplest([s for b in value[1] for s in _query(b)]))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] > 0:
            query = both(query, _query(value[2]))
    return both(query, simplest([trigrams(s) for s in run]))


def trigram_query(pattern: str) -> Query:
    """Sets of lower-case trigrams: a text with a match has all trigrams of at least one of them.
    A query with an empty set holds for any text."""
    return _query(list(parser.parse(pattern)))


def queries(rules: tuple[Rule, ...]) -> tuple[list[tuple[str, int, str, int]], list[str]]:
    """Rows (kind, conjunct, trigram, trigrams of the conjunct), and the kinds that scan every text."""
    rows, scans = [], []
    for rule in rules:
        query = trigram_query(rule.pattern)
        if frozenset() in query:
            scans.append(rule.kind)
        else:
            rows += [(rule.kind, n, t, len(s)) for n, s in enumerate(query) for t in sorted(s)]
    return rows, scans


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return ids_and_texts(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))


def index(texts: DataFrame, wanted: list[str]) -> DataFrame:
    """Postings ``trigram, doc_id, mark`` of the wanted trigrams, stored."""
    grams = F.filter(F.array(*map(F.lit, wanted)), lambda g: F.contains(F.col("low"), g))
    rows = texts.select("doc_id", "mark", F.lower("text").alias("low"))
    return stored(rows.select(F.explode(grams).alias("trigram"), "doc_id", "mark"), "trigram-index")


def candidates(postings: DataFrame, query: list[tuple[str, int, str, int]]) -> DataFrame:
    """``doc_id, mark, kinds``: the rules whose query a document satisfies."""
    spark: SparkSession = postings.sparkSession
    terms = spark.createDataFrame(query, "kind string, conjunct int, trigram string, needed int")  # as long as the rules
    met = postings.join(F.broadcast(terms), "trigram").groupBy("doc_id", "mark", "kind", "conjunct", "needed")
    met = met.agg(F.size(F.collect_set("trigram")).alias("found")).where("found = needed")
    return met.groupBy("doc_id", "mark").agg(F.collect_set("kind").alias("kinds"))


def spans_of(text: Column, rule: Rule) -> Column:
    """``start, end`` of the rule's matches: lengths of what lies between them, summed up."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    judged = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    between = F.split(text, rule.pattern, -1)
    rows = F.zip_with(
        F.arrays_zip(between.alias("gap"), found.alias("whole")), judged, lambda z, g: F.struct(z["gap"], z["whole"], g.alias("part"))
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def merge(done, row):
        begin = done["at"] + F.length(row["gap"])
        end = begin + F.coalesce(F.length(row["whole"]), F.lit(0))
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(
            end.alias("at"), F.when(F.length(row["part"]) >= rule.least, F.concat(done["spans"], span)).otherwise(done["spans"]).alias("spans")
        )

    none = F.array().cast("array<struct<start:int,end:int>>")
    return F.when(F.regexp_like(text, pattern), F.aggregate(rows, start, merge)["spans"]).otherwise(none)


def _named(n: int, kind: str):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("rule"), F.lit(kind).alias("kind"), s["end"].alias("end"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``spans`` (kind number, kind, start, end; by start, then rule) of every row."""
    texts = keyed(docs, id_col, text_col)
    query, scans = queries(rules)
    kinds = F.lit(None).cast("array<string>")
    rows = texts.withColumn("kinds", kinds)
    if query:
        found = candidates(index(texts, sorted({q[2] for q in query})), query)
        found = found.select(F.col("doc_id").alias("found_id"), F.col("mark").alias("found_mark"), "kinds")
        rows = texts.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("mark") == F.col("found_mark")), "left")
    parts = []
    for n, rule in enumerate(rules):
        spans = spans_of(F.col("text"), rule)
        if rule.kind not in scans:
            none = F.array().cast("array<struct<start:int,end:int>>")
            spans = F.when(F.array_contains("kinds", rule.kind), spans).otherwise(none)
        parts.append(F.transform(spans, _named(n, rule.kind)))
    return rows.select("doc_id", F.array_sort(F.concat(*parts)).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secrets(docs: DataFrame) -> DataFrame:
    """Counts and hash of the base rules' spans, and all spans, of every row of ``docs``."""
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    base = [r.kind for r in BASE]
    return scan(docs).select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(listed(of(*base)), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def _kind_sql(n: int, rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
    SELECT k, {n} AS rule, '{rule.kind}' AS kind, begin_at, begin_at + length(whole[i]) AS end_at FROM (
      SELECT k, whole, part, i, list_sum([length(g) FOR g IN gaps[1:i]]) + coalesce(list_sum([length(w) FOR w IN whole[1:i - 1]]), 0) AS begin_at
      FROM (SELECT k, whole, part, gaps, unnest(range(1, len(whole) + 1)) AS i FROM (
        SELECT k, regexp_extract_all(t, '{pattern}', 0) AS whole, regexp_extract_all(t, '{pattern}', {rule.group}) AS part,
          string_split_regex(t, '{pattern}') AS gaps
        FROM rows WHERE regexp_matches(t, '{pattern}'))))
    WHERE length(part[i]) >= {rule.least}"""


SECRETS_SQL = f"""
WITH rows AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({" UNION ALL ".join(_kind_sql(n, r) for n, r in enumerate(RULES))}),
joined AS (SELECT k, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || begin_at || ':' || end_at, ',' ORDER BY begin_at, rule) FILTER (rule < {len(BASE)}) AS base,
  string_agg(kind || ':' || begin_at || ':' || end_at, ',' ORDER BY begin_at, rule) AS spans
  FROM spans GROUP BY k)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM rows LEFT JOIN joined USING (k)
"""
