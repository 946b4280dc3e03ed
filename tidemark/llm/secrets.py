"""Secret scans: named patterns, and character Markov models of random strings and of ordinary identifiers.

The patterns give the base spans: a value that is assigned to a telling name, an access key, a long run of
hexadecimal digits. The models find what no pattern names. Both are of the first order over ``ALPHABET``:
one learns how characters follow each other in random strings, from what the patterns label as secret, the
other in ordinary identifiers, from the other tokens of the same texts. Each pair of characters has the log
of the ratio of its two chances, as a whole number of thousandths of a nat, so that a token's sum is exact
whatever the order of adding. A token of ``min_token`` characters or more is a secret if its sum reaches
``least`` and its mean reaches ``mean``. Values of telling names are left to the patterns, and so is a token
that is one whole access key or run of digits; every other token is judged, and never takes a base span away.

The models learn from about ``sample_docs`` documents, drawn by a hash of id and text. Add-one smoothing over
all pairs keeps random strings of other alphabets than the labelled ones likelier under the first model,
and with nothing to learn from, both models are alike and nothing is added.

All is DataFrame functions: matches and the gaps between them come from one pattern each, places are running
sums of their lengths in blocks, in time that is nearly linear in the text's length.

Edge cases: a null text is an empty one. Very long texts and tokens are scanned whole. Rows with null or
repeated ids, and repeated rows, give a row each. Spans that start together are ordered by kind. An empty
table gives an empty result. Further columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import table

#: Identifiers are joined by these in any way: pairs with one of them tell nothing.
JOINTS = "/_.=-"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
RUN = "[A-Za-z0-9+/_.=-]"
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A greedy run that is too short holds no long one, so the least lengths can stand in these two patterns.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")  #: in the order of spans that start together
MIN_VALUE = 8  #: characters of an assigned value
BLOCK = 256  #: lengths that are added up at a time


@dataclass(frozen=True)
class Rules:
    min_token: int = 16  #: shorter tokens are never judged by the models
    min_learned: int = 8  #: shorter tokens aren't learned from as identifiers
    max_learned: int = 64  #: nor are longer ones, which nobody has named anything by
    least: int = 12_000  #: thousandths of a nat: the log of the odds against a token's being a secret beforehand
    mean: int = 500  #: the same for each pair of the token
    sample_docs: int = 10_000  #: documents to learn from, about


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def tokens_pattern(least: int) -> str:
    """Whole runs of so many characters, and what is assigned to telling names, with the run that the name ends."""
    assign = ASSIGN.removeprefix("(?i)")
    names, value = assign[: assign.index(")") + 1].replace("(", "(?:"), assign[assign.index(")") + 1 :]
    return rf"(?i:{names}{value})|(?<!{RUN}){RUN}{{{least},}}(?i:(?<={names}){value})?"


def named(token: Column) -> Column:
    """Is a match of tokens_pattern the patterns' alone to judge?"""
    return token.rlike(ASSIGN) | token.rlike(f"^(?:{ACCESS}|{HEX})$")


def running(x: Column) -> Column:
    """The sums of the numbers up to each place, itself included."""
    upto = lambda y: F.aggregate(y, F.array(F.lit(0).cast("long")), lambda a, v: F.concat(a, F.array(F.element_at(a, -1) + v)))
    blocks = lambda y: F.transform(F.sequence(F.lit(0), F.floor((F.size(y) - 1) / BLOCK).cast("int")), lambda k: F.slice(y, k * BLOCK + 1, BLOCK))
    within = lambda y: F.transform(blocks(y), lambda b: let(upto(b), lambda s: F.slice(s, F.lit(2), F.size(b))))
    before = lambda w: F.slice(upto(F.transform(w, lambda s: F.element_at(s, -1))), F.lit(1), F.size(w))
    return let(x, lambda y: let(within(y), lambda w: F.flatten(F.zip_with(w, before(w), lambda s, o: F.transform(s, lambda v: v + o)))))


def spans(kind: str, gaps: Column, matches: Column, keep: Callable[[Column], Column] | None = None) -> Column:
    """start, kind (its number) and end of the matches to keep. gaps: what lies before, between and behind the matches."""
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: (F.length(g) + F.length(m)).cast("long"))
    span = lambda m, e: F.struct((e - F.length(m)).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), e.alias("end"), (F.lit(True) if keep is None else keep(m)).alias("keep"))
    found = F.filter(F.zip_with(matches, running(steps), span), lambda s: s["keep"])
    none = F.expr("CAST(array() AS array<struct<start: bigint, kind: int, end: bigint>>)")
    return F.when(F.size(matches) == 0, none).otherwise(F.transform(found, lambda s: F.struct(s["start"], s["kind"], s["end"])))


def _codes(token: Column) -> Column:
    return F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)


def _pair(codes: Column, i: Column) -> Column:
    return F.get(codes, i - 1) * len(ALPHABET) + F.get(codes, i)


def learned(docs: DataFrame, rules: Rules = Rules(), doc: str = "doc_id", text: str = "text") -> DataFrame:
    """random (of which model), pair, n: how often each pair of characters was met."""
    upto = int(2**32 * rules.sample_docs / max(1, docs.count()))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", docs[doc].cast("string"), docs[text])), 1, 8), 16, 10).cast("long")
    t = docs.filter(draw < upto).select(docs[text].alias("t"))
    values = F.filter(F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= MIN_VALUE)
    secret = F.concat(values, F.regexp_extract_all("t", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("t", F.lit(HEX), F.lit(0)))
    other = F.filter(F.regexp_extract_all("t", F.lit(tokens_pattern(rules.min_learned)), F.lit(0)), lambda m: (F.length(m) <= rules.max_learned) & ~named(m))
    both = F.array(*[F.struct(F.lit(r).alias("random"), x.alias("tokens")) for r, x in ((True, secret), (False, other))])
    tokens = t.select(F.explode(both).alias("x")).select("x.random", F.explode("x.tokens").alias("token"))
    pairs = tokens.select("random", F.explode(let(_codes(F.col("token")), lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: _pair(c, i)))).alias("pair"))
    return pairs.groupBy("random", "pair").agg(F.count("*").alias("n"))


def weights(counts: DataFrame) -> list[int]:
    """The log ratio of each pair, in thousandths of a nat: as many numbers as ALPHABET has pairs."""
    k = len(ALPHABET)
    grid = counts.sparkSession.range(k * k).select(F.col("id").cast("int").alias("pair"))
    n = counts.groupBy("pair").agg(*[F.coalesce(F.sum(F.when(F.col("random") == r, F.col("n"))), F.lit(0)).alias(c) for c, r in (("r", True), ("i", False))])
    rows = grid.join(n, "pair", "left").na.fill(0).withColumn("a", F.floor(F.col("pair") / k))
    sums = rows.groupBy("a").agg(F.sum("r").alias("ra"), F.sum("i").alias("ia"))
    ratio = F.log((F.col("r") + 1) / (F.col("ra") + k)) - F.log((F.col("i") + 1) / (F.col("ia") + k))
    joints = [ALPHABET.index(c) for c in JOINTS]
    weight = F.when(F.col("a").isin(joints) | (F.col("pair") % k).isin(joints), 0).otherwise(F.round(1000 * ratio))
    return [x["w"] for x in rows.join(sums, "a").select("pair", weight.cast("int").alias("w")).orderBy("pair").collect()]


def find(docs: DataFrame, weights: list[int], rules: Rules = Rules(), doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base and spans: arrays of start, kind (its number in KINDS) and end, in code points, in their order; a row for each row."""
    table_ = F.expr(f"CAST(split('{','.join(map(str, weights))}', ',') AS array<int>)")
    rows = docs.select(docs[doc].alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("t"))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "markov": tokens_pattern(rules.min_token)}
    rows = rows.select("*", *[F.regexp_extract_all("t", F.lit(p), F.lit(0)).alias(k) for k, p in patterns.items()])
    rows = rows.select("*", *[F.when(F.size(k) > 0, F.split("t", p)).alias(f"{k}_gaps") for k, p in patterns.items()]).drop("t")

    def secret(token: Column) -> Column:
        total = lambda c: F.aggregate(F.sequence(F.lit(1), F.size(c) - 1), F.lit(0).cast("long"), lambda a, i: a + F.get(table_, _pair(c, i)))
        sure = let(let(_codes(token), total), lambda s: (s >= rules.least) & (s >= rules.mean * (F.length(token) - 1)))
        return ~named(token) & sure

    keep = {"assign": lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= MIN_VALUE, "markov": secret}
    rows = rows.select("doc_id", *[spans(k, F.col(f"{k}_gaps"), F.col(k), keep.get(k)).alias(k) for k in KINDS])
    rows = rows.select("doc_id", F.array_sort(F.concat("assign", "access", "hex")).alias("base"), "markov")
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", "markov")).alias("spans"))


def written(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, rules: Rules = Rules(), doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (as text) and n_markov: a row for each row."""
    found = find(docs, weights(learned(docs, rules, doc, text)), rules, doc, text)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), count("markov"))


def op13_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """The SQL, for the rules as they stand. Its engine has no look-behind: there, a run comes with the assignment that follows its name, and such matches are left out either way."""
    r = Rules()
    letters = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    names = "(?:" + "|".join(letters(x) for x in ("password", "passwd", "secret", "token", "api_?key")) + ")"
    assign = rf"{names}[\"'']?\x20*[:=]\x20*[\"'']?({RUN}+)".replace(r"\"", '"')
    tokens = lambda least: rf"{RUN}*{assign}|{RUN}{{{least},}}"
    named = f"(regexp_matches(m, '{assign}') OR regexp_full_match(m, '{ACCESS}|{HEX}'))"
    spans = lambda kind, p, keep: f"""
      SELECT doc_id, {KINDS.index(kind)} AS kind, m, stop - length(m) AS start, stop FROM (
        SELECT doc_id, unnest(x) AS m, unnest(list_transform(range(1, len(x) + 1), lambda i: list_sum(list_transform(g[1:i], lambda y: length(y))) + list_sum(list_transform(x[1:i], lambda y: length(y))))) AS stop
        FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS x, string_split_regex(t, '{p}') AS g FROM d)) WHERE {keep}"""  # noqa: E731
    text = lambda of: f"string_agg({of[0]}kind_name || ':' || start || ':' || stop, ',' ORDER BY start, kind)"
    k = len(ALPHABET)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, text FROM documents),
taught AS (SELECT t FROM d WHERE text IS NOT NULL AND CAST('0x' || substr(md5(concat_ws(':', doc_id, text)), 1, 8) AS BIGINT) < (SELECT floor(4294967296 * {r.sample_docs} / greatest(1, count(*))) FROM d)),
tokens AS (
  SELECT true AS random, m FROM (SELECT unnest(regexp_extract_all(t, '{assign}', 1)) AS m FROM taught) WHERE length(m) >= {MIN_VALUE}
  UNION ALL SELECT true, unnest(regexp_extract_all(t, '{ACCESS}')) FROM taught
  UNION ALL SELECT true, unnest(regexp_extract_all(t, '{HEX}')) FROM taught
  UNION ALL SELECT false, m FROM (SELECT unnest(regexp_extract_all(t, '{tokens(r.min_learned)}')) AS m FROM taught) WHERE length(m) <= {r.max_learned} AND NOT {named}),
pairs AS (SELECT random, substr(m, i, 1) AS a, substr(m, i + 1, 1) AS b FROM (SELECT random, m, unnest(range(1, length(m))) AS i FROM tokens)),
n AS (SELECT a, b, count(*) FILTER (WHERE random) AS r, count(*) FILTER (WHERE NOT random) AS i FROM pairs GROUP BY a, b),
abc AS (SELECT unnest(string_split('{ALPHABET}', '')) AS c),
grid AS (SELECT x.c AS a, y.c AS b, coalesce(r, 0) AS r, coalesce(i, 0) AS i FROM abc x CROSS JOIN abc y LEFT JOIN n ON n.a = x.c AND n.b = y.c),
weights AS (
  SELECT a, b, CASE WHEN contains('{JOINTS}', a) OR contains('{JOINTS}', b) THEN 0
    ELSE CAST(round(1000 * (ln((r + 1) / (sum(r) OVER w + {k})) - ln((i + 1) / (sum(i) OVER w + {k})))) AS BIGINT) END AS w FROM grid WINDOW w AS (PARTITION BY a)),
assign AS ({spans("assign", assign, f"length(regexp_extract(m, '{assign}', 1)) >= {MIN_VALUE}")}),
access AS ({spans("access", ACCESS, "true")}),
hex AS ({spans("hex", HEX, "true")}),
judged AS ({spans("markov", tokens(r.min_token), f"NOT {named}")}),
score AS (
  SELECT m, sum(w) AS s FROM (SELECT m, substr(m, i, 1) AS a, substr(m, i + 1, 1) AS b FROM (SELECT m, unnest(range(1, length(m))) AS i FROM (SELECT DISTINCT m FROM judged)))
  JOIN weights USING (a, b) GROUP BY m),
markov AS (SELECT j.* FROM judged j JOIN score USING (m) WHERE s >= {r.least} AND s >= {r.mean} * (length(m) - 1)),
spans AS (
  SELECT *, ['assign', 'access', 'hex', 'markov'][kind + 1] AS kind_name
  FROM (SELECT * FROM assign UNION ALL SELECT * FROM access UNION ALL SELECT * FROM hex UNION ALL SELECT * FROM markov)),
found AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex, count(*) FILTER (WHERE kind = 3) AS n_markov,
         {text(["CASE WHEN kind < 3 THEN "]).replace("|| stop", "|| stop END")} AS base, {text([""])} AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_markov, 0) AS n_markov,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN found USING (doc_id)"""


ORACLE = _oracle()
