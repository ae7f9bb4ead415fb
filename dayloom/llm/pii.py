"""Personal data: base patterns, and bootstrapped contextual extraction on top of them.

DataFrame and SQL functions only. Base entities (email, ip, card, phone) are found by regular
expressions whose loops are possessive, so that no text makes them backtrack or recurse. They
are the seeds. Every token with a digit or an @ in the corpus is an instance; the words in front
of it together with its character classes form its lexical pattern. (No seed has neither, so a
token without them, such as a plain name, never stands in a pattern that a seed supports.) Tokens
that are long, or that quotes and brackets cut, are split at punctuation. On the graph of patterns and
instances, in turn, a pattern's confidence is the mean score of its instances (damped for few),
and an instance's score is 1 if it is a seed, else how likely one of its patterns is right
(noisy or). After ROUNDS rounds, instances of patterns that are confident and that enough
different seeds support are identifiers no base pattern knows; each place where they stand
behind such a pattern becomes a span of kind ``identifier``, unless a base span covers it.

Distribution: one pass over the texts writes spans and instances, narrow rows; the graph is a
table of distinct (pattern, instance) pairs, aggregated before every shuffle. Sums by pattern are
combined before the shuffle; a pattern that a third of all tokens share is one key of two joins of
narrow rows, both sides of which are written tables, so that Spark's adaptive skew join splits it.

Edge cases: null text is empty: no spans, the digest of an empty string. Very long texts and texts of
very many tokens take time in proportion (times the logarithm of their tokens). Rows that repeat a
doc_id are kept apart by a hash of their text; equal rows get equal results. Empty tables give
empty tables; extra columns are ignored by ``find_private``, kept by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from dayloom.llm.common import Scratch

# The contract's patterns, with possessive loops; a look behind keeps a run of characters from
# being tried from each of its places (\G: the place where the last match ended).
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TAGS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "identifier": "[ID]"}
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
# A piece of a token: characters of identifiers with single dots between them, a digit or @ among them.
PIECE = r"(?<![A-Za-z0-9_%+@#~-])(?<![A-Za-z0-9_%+@#~-]\.)(?:[A-Za-z_%+#~-]++\.?)*+[0-9@](?:\.?[A-Za-z0-9_%+@#~-])*+"
VALUE = r"^([^=:]*+[=:]++)?([\"'(\[<]*+)([^\"'()\[\]<>]+?)([\"')\]>,.;:!?]*)$"
LONGEST_TOKEN = 120  # longer ones are split into pieces
LONGEST_CONTEXT = 80  # characters; a longer context is known by its hash
LEAST_VALUE = 4  # shorter tokens identify nobody
ROUNDS = 3
LEAST_SEEDS = 3
CONFIDENT = 0.8
DAMPING = 1.0


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """From the last digit: every second one doubled, less 9 beyond 9; a multiple of 10."""
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255))
    n = F.length(_digits(m))
    if kind == "phone":
        return (n >= 10) & (n <= 15)
    return F.when((n >= 14) & (n <= 19), _luhn(_digits(m))).otherwise(False)


def _holds(kind: str, text: Column) -> Column:
    """A cheap test that every text with a match passes."""
    return {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "ip": F.rlike(text, F.lit(r"[0-9]\.[0-9]")), "card": F.rlike(text, F.lit(r"[0-9][\x20-]?[0-9]"))}[kind]


def _running(values: Column, add=lambda x, y: x + y) -> Column:
    """Running sums (or other totals) of an array, by doubling: each step adds what lies 2^e places
    before. An array of n takes log2(n) steps over n values."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values))).cast("int"))
    back = lambda a, i, e: F.get(a, i - F.pow(F.lit(2), e).cast("int"))
    return F.aggregate(steps, values, lambda a, e: F.transform(a, lambda x, i: F.coalesce(add(x, back(a, i, e)), x)))


def _places(text: Column, pattern: str, found: Column) -> Column:
    """Spans (start, end, m, before) of the matches: running sums over the lengths of the matches and
    of what lies between them. before: the last two words in front."""
    parts = F.split(text, pattern, -1)
    empty = F.expr("cast(array() as array<struct<start:int,end:int,m:string,before:string>>)")
    pairs = F.zip_with(F.slice(parts, F.lit(1), F.size(found)), found, lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    ends = _running(F.transform(pairs, lambda x: F.length(x["p"]) + F.length(x["m"])))

    def span(x: Column, end: Column) -> Column:
        before = F.substring_index(F.rtrim(F.regexp_replace(x["p"], r"\s+", " ")), " ", -2)
        return F.struct((end - F.length(x["m"])).alias("start"), end.alias("end"), x["m"].alias("m"), before.alias("before"))

    return F.when(F.size(found) > 0, F.zip_with(pairs, ends, span)).otherwise(empty)


def _kind_filter(kind: str):
    return lambda s: _valid(kind, s["m"])


def _token_spans(text: Column) -> Column:
    has = F.rlike(text, F.lit("[0-9@]"))
    found = F.when(has, F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))).otherwise(F.array().cast("array<string>"))

    def pieces(t: Column) -> Column:
        """Of a token that is no single value; the words in front of a piece may be in the token."""
        inner = _places(t["m"], PIECE, F.regexp_extract_all(t["m"], F.lit(PIECE), F.lit(0)))
        said = lambda s: F.regexp_replace(s["before"], r"[^\p{L}\p{N}]+", " ")
        before = lambda s, i: F.when(F.trim(said(s)) != "", said(s)).when(i == 0, t["before"]).otherwise(F.lit(""))
        moved = lambda s, i: F.struct((t["start"] + s["start"]).alias("start"), (t["start"] + s["end"]).alias("end"), s["m"].alias("m"), before(s, i).alias("before"))
        return F.transform(inner, moved)

    whole = lambda t: (F.length(t["m"]) <= LONGEST_TOKEN) & F.rlike(t["m"], F.lit(VALUE))
    return F.flatten(F.transform(_places(text, TOKEN, found), lambda t: F.when(whole(t), F.array(t)).otherwise(pieces(t))))


def base_spans(text: Column) -> dict[str, Column]:
    """Spans (start, end) of the valid base matches by kind."""
    found = {k: F.when(_holds(k, text), F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0))).otherwise(F.array().cast("array<string>")) for k in KINDS}
    return {k: F.transform(F.filter(_places(text, PATTERNS[k], found[k]), _kind_filter(k)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in KINDS}


def prepare(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, key (of the row's text), base spans by kind, and tokens with a digit or @. One pass."""
    rows = df.select("doc_id", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("text", F.length("text")))
    rows = rows.select("doc_id", "key", *[c.alias(k) for k, c in base_spans(F.col("text")).items()], _token_spans(F.col("text")).alias("tokens"))
    return rows.withColumn("tokens", _with_reach(F.col("tokens"), F.concat(*[F.col(k) for k in KINDS])))


def _with_reach(tokens: Column, base: Column) -> Column:
    """Adds to each token the greatest end of the base spans that begin before its own end. Both are put
    in one order, so that many tokens and many spans cost no product."""
    at = F.concat(F.transform(tokens, lambda t: F.struct(t["end"].alias("at"), F.lit(0).alias("end"))), F.transform(base, lambda s: F.struct(s["start"].alias("at"), s["end"].alias("end"))))
    ends = _running(F.transform(F.array_sort(at), lambda x: F.struct(x["end"].alias("reach"), (x["end"] == 0).alias("token"))), lambda x, y: F.when(y.isNotNull(), F.struct(F.greatest(x["reach"], y["reach"]).alias("reach"), x["token"].alias("token"))))
    reach = F.when(F.size(base) > 0, F.transform(F.filter(ends, lambda x: x["token"]), lambda x: x["reach"])).otherwise(F.transform(tokens, lambda t: F.lit(0)))
    return F.zip_with(tokens, reach, lambda t, r: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["m"].alias("m"), t["before"].alias("before"), r.alias("reach")))


def instances(prepared: DataFrame) -> DataFrame:
    """One row a token: doc_id, key, start, end, value, pattern, seed."""
    rows = prepared.where(F.size("tokens") > 0).select("doc_id", "key", F.explode("tokens").alias("t"))
    part = lambda i: F.regexp_extract(F.col("t.m"), VALUE, i)
    rows = rows.select("doc_id", "key", "t", part(1).alias("inner"), F.length(F.concat(part(1), part(2))).alias("skip"), part(3).alias("value"))
    rows = rows.where((F.length("value") >= LEAST_VALUE) & F.rlike("value", F.lit("[0-9@]")))
    rows = rows.withColumn("start", F.col("t.start") + F.col("skip")).withColumn("end", F.col("start") + F.length("value"))
    words = F.split(F.trim(F.lower("t.before")), r"\s+")
    last, second = F.element_at(words, -1), F.coalesce(F.try_element_at(words, F.lit(-2)), F.lit(""))
    context = F.when(F.col("inner") != "", F.lower("inner")).when(F.rlike(last, F.lit(r"^\W+$")), F.concat_ws(" ", second, last)).otherwise(last)
    context = F.when(F.length(context) > LONGEST_CONTEXT, F.hex(F.xxhash64(context))).otherwise(context)
    shape = F.when(F.contains("value", F.lit("@")), "at").when(F.rlike("value", F.lit("[A-Za-z]")), "mixed").otherwise("number")
    seed = F.col("t.reach") > F.col("start")  # a base span has a part of the value
    return rows.select("doc_id", "key", "start", "end", "value", F.concat_ws(" ", context, shape).alias("pattern"), seed.alias("seed"))


def bootstrap(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, confidence, seeds) of the confident patterns. The graph has one row for each
    distinct (pattern, value); ``found`` is a written table."""
    edges = found.groupBy("pattern", "value").agg(F.max(F.col("seed").cast("double")).alias("seed"))
    scratch = Scratch(found.sparkSession)
    edges = scratch.put(edges, "edges")
    scored = edges.withColumn("score", F.col("seed"))
    for _ in range(rounds):
        # written, so that both sides of the join come from a shuffle and Spark can split a pattern that very many values share
        patterns = scratch.put(scored.groupBy("pattern").agg((F.sum("score") / (F.count("*") + F.lit(DAMPING))).alias("confidence"), F.sum("seed").alias("seeds")), "patterns")
        # log(1 - confidence) sums to the log of how likely every pattern of a value is wrong
        wrong = edges.join(patterns, "pattern").groupBy("value").agg(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence")))).alias("wrong"), F.max("seed").alias("known"))
        values = wrong.select("value", F.greatest("known", 1 - F.exp("wrong")).alias("score"))
        scored = scratch.put(edges.join(values, "value"), "scores")
    patterns = scored.groupBy("pattern").agg((F.sum("score") / (F.count("*") + F.lit(DAMPING))).alias("confidence"), F.sum("seed").alias("seeds"))
    return patterns.where((F.col("confidence") >= CONFIDENT) & (F.col("seeds") >= LEAST_SEEDS))


def discovered(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, key, added): the spans that confident patterns add, by row of the input."""
    confident = Scratch(found.sparkSession).put(bootstrap(found, rounds).select("pattern", "confidence"), "confident")
    rows = found.where(~F.col("seed")).join(confident, "pattern")
    return rows.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "end", "value")).alias("added"))


def find_private(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_identifier, base_sha256, spans."""
    scratch = Scratch(docs.sparkSession)
    prepared = scratch.put(prepare(docs, text), "private")
    found = scratch.put(instances(prepared), "instances")
    added = discovered(found).select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "added").dropDuplicates(["d", "k"])
    base = _ordered()
    rows = prepared.drop("tokens").join(added, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    more = _identifiers("added")
    rows = rows.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.size(more).cast("long").alias("n_identifier"), base.alias("base"), F.array_sort(F.concat(base, more)).alias("all"))
    return rows.select("doc_id", *[f"n_{k}" for k in KINDS], "n_identifier", F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("all").alias("spans"))


def _identifiers(added: str) -> Column:
    none = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")
    return F.transform(F.coalesce(added, none), lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), s["end"].alias("end")))


def _numbered(kind: str, spans: Column) -> Column:
    i = KINDS.index(kind)
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end")))


def _ordered() -> Column:
    return F.array_sort(F.concat(*[_numbered(k, F.col(k)) for k in KINDS]))


def _joined(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, "identifier")])
    return F.array_join(F.transform(F.col(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _rewritten(text: Column, spans: Column) -> Column:
    """The text with ``spans`` (start, kind, end; sorted) replaced by tags. Overlapping ones give way
    to one tag, that of the longest among those that start first; all else stays as it is."""
    tags = F.array(*[F.lit(TAGS[k]) for k in (*KINDS, "identifier")])
    least = lambda x, y: F.when(y.isNotNull(), F.greatest(x, y))
    reached = _running(F.transform(spans, lambda s: s["end"]), least)  # the end of all spans so far
    placed = F.transform(spans, lambda s, i: F.struct(F.coalesce(F.get(reached, i - 1), F.lit(0)).alias("at"), s["start"].alias("start"), s["kind"].alias("kind")))
    parts = F.transform(F.filter(placed, lambda s: s["start"] >= s["at"]), lambda s: F.concat(F.substring(text, s["at"] + 1, s["start"] - s["at"]), F.get(tags, s["kind"])))
    rest = F.substring(text, F.array_max(F.transform(spans, lambda s: s["end"])) + 1, F.length(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(parts, ""), rest)).otherwise(text)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with private spans, those of ``find_private``, replaced by tags; other columns as they were."""
    scratch = Scratch(docs.sparkSession)
    prepared = scratch.put(prepare(docs, text), "private")
    found = scratch.put(instances(prepared), "instances")
    scratch.drop(prepared)
    added = scratch.put(discovered(found).select(F.col("doc_id").alias("__d"), F.col("key").alias("__k"), F.col("added").alias("__added")).dropDuplicates(["__d", "__k"]), "added")
    scratch.drop(found)
    said = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.withColumn("__key", F.xxhash64(said, F.length(said)))
    rows = rows.join(added, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__key") == F.col("__k")), "left")
    base = base_spans(F.col(text).cast("string"))
    spans = F.concat(*[_numbered(k, base[k]) for k in KINDS], _identifiers("__added"))
    # of those that start at one place, the longest first
    spans = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"), s["end"].alias("end"))))
    rows = rows.withColumn("__spans", F.when(F.col(text).isNotNull(), spans))
    return rows.withColumn(text, _rewritten(F.col(text), F.col("__spans"))).select(*docs.columns)


def op3_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_private(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
