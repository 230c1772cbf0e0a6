"""Weak supervision over quality rules, in DataFrame operations only.

Every rule votes good (+1), bad (-1) or abstains (0) on a document.  A rule's accuracy is a table of six shares: how often
it votes each way, and abstains, on good and on bad documents.  These tables and the share of good documents come from
expectation-maximisation over the table of vote patterns, which has at most 3**7 rows however many documents there are.
A prior worth STRENGTH documents gives each table its start and keeps shares above 0; nothing is clamped or fixed.
A document's verdict is its posterior probability of being good.

Defined results: null and empty texts have no words; ``base_failed`` is then true (fewer than 50 words).  Texts of any length
are counted whole; windows whose hashes collide are compared word by word.  Repeated rows are scored one by one and equal
votes (ties) give equal posteriors; a posterior equal to the threshold keeps.  An empty table gives no rows.  Other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, materialise, table

SYMBOLS = "#*$%&|<>"
RULES = ("symbols", "lines", "repeats", "word_length", "shouting", "capitals", "sentences")
ITERATIONS = 30
#: The prior: share of good documents, and shares of bad votes, abstentions and good votes on good and on bad documents, worth
#: so many documents.  A bad vote is rare on good documents; bad documents need not fail every rule.
PRIOR, GOOD, BAD, STRENGTH = 0.8, (0.02, 0.33, 0.65), (0.3, 0.3, 0.4), 10.0


def _count_of(text, letters: str):
    rest = text
    for c in letters:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return (F.octet_length(text) - F.octet_length(rest)).cast("long")


def _united(places: str) -> str:
    """Words in the union of the 3-word windows at an array of places."""
    return f"aggregate(array_sort({places}), struct(0L AS n, -3L AS last), (a, p) -> struct(a.n + least(3L, p - a.last) AS n, p AS last), a -> a.n)"


def _repeats() -> str:
    """Words inside 3-word windows that occur twice or more: sort hashed windows with their places in the low bits and keep
    neighbours that agree.  Where neighbours agree in hash but not in their words, windows are sorted by their words."""
    hashed = lambda i, j: f"shiftright({i}, bits) = shiftright({j}, bits)"
    same = lambda i, j: " AND ".join(f"words[int({i} & low) + {k}] = words[int({j} & low) + {k}]" for k in range(3))
    clash = f"exists(sequence(1, size(grams) - 1), i -> {hashed('grams[i]', 'grams[i - 1]')} AND NOT ({same('grams[i]', 'grams[i - 1]')}))"
    quick = f"transform(filter(grams, (k, i) -> (i > 0 AND {hashed('k', 'grams[i - 1]')}) OR (i < size(grams) - 1 AND {hashed('k', 'grams[i + 1]')})), k -> k & low)"
    ordered = "sort_array(transform(slice(words, 1, size(words) - 2), (w, i) -> struct(w AS a, words[i + 1] AS b, words[i + 2] AS c, bigint(i) AS i)))"
    equal = lambda j: f"(k.a = s[{j}].a AND k.b = s[{j}].b AND k.c = s[{j}].c)"
    plain = f"flatten(transform(array({ordered}), s -> transform(filter(s, (k, i) -> (i > 0 AND {equal('i - 1')}) OR (i < size(s) - 1 AND {equal('i + 1')})), k -> k.i)))"
    return f"CASE WHEN n_words < 4 THEN 0L WHEN {clash} THEN {_united(plain)} ELSE {_united(quick)} END"


def statistics(docs: DataFrame) -> DataFrame:
    """One row per row of docs, with the counts the rules look at."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", text.alias("text"))
    d = d.withColumn("words", F.filter(F.split("text", SPACE), lambda w: w != ""))
    d = d.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.withColumn("n_words", F.size("words").cast("long"))
    d = d.withColumn("bits", F.expr("CAST(greatest(1, ceil(log2(n_words + 1))) AS INT)"))
    d = d.withColumn("low", F.expr("shiftleft(1L, bits) - 1"))
    d = d.withColumn("grams", F.expr("CASE WHEN n_words < 4 THEN array() ELSE sort_array(transform(slice(words, 1, size(words) - 2), (w, i) -> shiftleft(xxhash64(w, words[i + 1], words[i + 2]), bits) | i)) END"))
    return d.select(
        "doc_id",
        "n_words",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _count_of(F.col("text"), SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.expr(_repeats()).alias("n_repeat_words"),
        _count_of(F.col("text"), "!").alias("n_marks"),
        (F.octet_length("text") - F.octet_length(F.regexp_replace("text", "[A-Z]+", ""))).cast("long").alias("n_capitals"),
        _count_of(F.col("text"), ".").alias("n_stops"),
    )


def _vote(bad: str, good: str) -> str:
    return f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END"


#: Integer arithmetic only, so that every engine votes alike.
VOTES = {
    "symbols": _vote("10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    "lines": _vote("n_dup_lines >= 3 AND 2 * n_dup_lines > n_lines", "n_lines >= 2 AND n_dup_lines = 0"),
    "repeats": _vote("100 * n_repeat_words > 35 * n_words", "100 * n_repeat_words <= 10 * n_words"),
    "word_length": _vote("word_chars < 2 * n_words OR word_chars > 14 * n_words", "word_chars >= 3 * n_words AND word_chars <= 10 * n_words"),
    "shouting": _vote("10 * n_marks > n_words", "50 * n_marks <= n_words"),
    "capitals": _vote("2 * n_capitals > word_chars", "200 * n_capitals >= word_chars AND 5 * n_capitals <= word_chars"),
    "sentences": _vote("5 * (n_symbols + n_marks) > n_words OR n_words > 400 * (n_stops + 1)", "50 * (n_symbols + n_marks) <= n_words AND n_words <= 40 * n_stops AND n_words >= 3 * n_stops"),
}


def _step(p: str) -> str:
    """One round's posteriors as an expression over `t`, an array of (votes array, count), and parameters `p`."""
    like = lambda table: f"aggregate(sequence(0, {len(RULES) - 1}), 1.0D, (a, r) -> a * {p}.{table}[3 * r + x.v[r] + 1])"
    q = f"({p}.prior * {like('good')}) / ({p}.prior * {like('good')} + (1.0D - {p}.prior) * {like('bad')})"
    return f"transform(t, x -> named_struct('v', x.v, 'n', x.n, 'q', {q}))"


def fit(votes: DataFrame) -> dict:
    """EM over the pattern table (at most 3**7 rows) inside one expression; columns v_<rule> to the prior and, for good and for
    bad documents, each rule's shares of (bad votes, abstentions, good votes)."""
    names = ", ".join(f"v_{r}" for r in RULES)
    patterns = votes.groupBy(*[f"v_{r}" for r in RULES]).agg(F.count("*").cast("double").alias("n"))
    one = patterns.agg(F.sort_array(F.collect_list(F.expr(f"struct(array({names}) AS v, n)"))).alias("t"))
    total = lambda weight: f"aggregate(s, 0.0D, (a, x) -> a + x.n * {weight})"
    voted = lambda weight: f"aggregate(s, 0.0D, (a, x) -> a + CASE WHEN x.v[j DIV 3] = j % 3 - 1 THEN x.n * {weight} ELSE 0.0D END)"
    start = lambda shares: "array(" + ", ".join(f"{x}D" for x in shares * len(RULES)) + ")"
    table_ = lambda shares, weight: f"transform(sequence(0, {3 * len(RULES) - 1}), j -> ({STRENGTH}D * {start(shares)}[j] + {voted(weight)}) / ({STRENGTH}D + {total(weight)}))"
    update = f"""aggregate(sequence(1, {ITERATIONS}),
        named_struct('prior', {PRIOR}D, 'good', {start(GOOD)}, 'bad', {start(BAD)}),
        (p, i) -> transform(array({_step('p')}), s -> named_struct(
            'prior', ({STRENGTH * PRIOR}D + {total('x.q')}) / ({STRENGTH}D + {total('1.0D')}),
            'good', {table_(GOOD, 'x.q')}, 'bad', {table_(BAD, '(1.0D - x.q)')}))[0])"""
    row = one.where("size(t) > 0").select(F.expr(update).alias("p")).first()
    row = row["p"] if row else {"prior": PRIOR, "good": GOOD * len(RULES), "bad": BAD * len(RULES)}  # no document to learn from
    tables = {k: {r: tuple(row[k][3 * i : 3 * i + 3]) for i, r in enumerate(RULES)} for k in ("good", "bad")}
    return {"prior": row["prior"], **tables}


def posterior(model: dict):
    """Probability that a document with columns v_<rule> is good."""
    def like(kind):
        out = F.lit(1.0)
        for r in RULES:
            bad, none, good = model[kind][r]
            v = F.col(f"v_{r}")
            out = out * F.when(v == 0, none).when(v == 1, good).otherwise(bad)
        return out

    good, bad = F.lit(model["prior"]) * like("good"), F.lit(1.0 - model["prior"]) * like("bad")
    return good / (good + bad)


def apply(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Counts, votes, posterior and verdict for every row of docs."""
    stats = materialise(statistics(docs))
    votes = stats.select("*", *[F.expr(e).alias(f"v_{r}") for r, e in VOTES.items()])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    model = fit(votes.where(~failed))
    quality = posterior(model)
    return votes.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (quality >= threshold)).alias("kept"),
        F.round(quality, 4).alias("quality"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    w = "list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\x0C\\r]+'), lambda x: x <> '')"
    votes = ", ".join(f"{e} AS v_{r}" for r, e in VOTES.items())
    sides = ("bad", "none", "good")
    like = lambda p, kind: " * ".join(f"CASE v_{r} WHEN 0 THEN {p}.{kind}_{r}_none WHEN 1 THEN {p}.{kind}_{r}_good ELSE {p}.{kind}_{r}_bad END" for r in RULES)
    q = lambda p: f"({p}.prior * {like(p, 'good')}) / ({p}.prior * {like(p, 'good')} + (1.0 - {p}.prior) * {like(p, 'bad')})"
    kinds = (("good", GOOD, "q"), ("bad", BAD, "(1.0 - q)"))
    steps = [f"m0 AS (SELECT {PRIOR}::DOUBLE AS prior, " + ", ".join(f"{x}::DOUBLE AS {kind}_{r}_{side}" for kind, shares, _ in kinds for r in RULES for side, x in zip(sides, shares, strict=True)) + ")"]
    for i in range(ITERATIONS):
        tables = ", ".join(
            f"({STRENGTH} * {x} + sum(CASE WHEN v_{r} = {v} THEN n * {weight} ELSE 0.0 END)) / ({STRENGTH} + sum(n * {weight})) AS {kind}_{r}_{side}"
            for kind, shares, weight in kinds
            for r in RULES
            for v, side, x in zip((-1, 0, 1), sides, shares, strict=True)
        )
        steps.append(f"m{i + 1} AS MATERIALIZED (SELECT ({STRENGTH * PRIOR} + sum(n * q)) / ({STRENGTH} + sum(n)) AS prior, {tables} FROM (SELECT t.*, {q('p')} AS q FROM patterns t, m{i} p))")
    names = ", ".join(f"v_{r}" for r in RULES)
    return f"""
    WITH base AS (
      SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS text, {w} AS words,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\x0C\\r]')) AS lines
      FROM documents),
    grams AS (SELECT rn, unnest(range(1, len(words) - 1)) AS i, words FROM base WHERE len(words) > 3),
    g AS (SELECT rn, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM grams),
    d AS (SELECT rn, i, count(*) OVER (PARTITION BY rn, a, b, c) AS k FROM g),
    r AS (SELECT rn, sum(least(3, nxt - i)) AS n FROM (SELECT rn, i, coalesce(lead(i) OVER (PARTITION BY rn ORDER BY i), i + 3) AS nxt FROM d WHERE k > 1) GROUP BY rn),
    stats AS (
      SELECT base.doc_id, len(words)::BIGINT AS n_words, len(list_aggregate(list_concat([''], words), 'string_agg', ''))::BIGINT AS word_chars,
             (len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
             (len(text) - len(replace(text, '!', '')))::BIGINT AS n_marks, (len(text) - len(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_capitals,
             (len(text) - len(replace(text, '.', '')))::BIGINT AS n_stops
      FROM base LEFT JOIN r USING (rn)),
    votes AS (SELECT *, {votes} FROM stats),
    patterns AS MATERIALIZED (SELECT {names}, count(*)::DOUBLE AS n FROM votes WHERE NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) GROUP BY ALL),
    {', '.join(steps)}
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed,
           NOT failed AND quality >= 0.5 AS kept, round(quality, 4) AS quality
    FROM (SELECT v.*, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS failed, {q('p')} AS quality FROM votes v, m{ITERATIONS} p)"""


QUERIES = {"op1_quality_rules": query}
ORACLES = {"op1_quality_rules": _oracle()}
