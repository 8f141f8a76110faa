"""Operator 6: personal data by pattern, and by bootstrapped contextual extraction.

Base spans come from one pattern for each kind, with a check of each match.  They are the seeds: the two
words before a seed, the word before it and the word after it are its lexical patterns.  Identifier-like tokens that
no seed covers are candidates, with patterns of their own.  Rounds over the graph of patterns and
instances follow: a pattern's confidence is the scored share of its uses, in all texts, that introduce an
instance, less for few instances; a candidate takes the best confidence among its patterns;
candidates of high score are seeds of the next round.  Accepted candidates are added as spans of their
pattern's kind.

All of it is DataFrame work.  A text is matched once; only spans, contexts and instances move on.  Uses of
patterns are counted over all texts, in a pass that runs only where a pattern is trusted without it.
Places of matches are sums over lengths of parts, made in blocks, so a text costs time in proportion to its length.

A candidate is a token of 6 to 40 characters with a digit (`CANDIDATE`), and a pattern is read from the `CONTEXT_CHARS`
characters next to a span: a parameter of the method, as longer tokens are hashes and keys rather than identifiers.
Base spans have no such limit.

The patterns are written with possessive quantifiers and starts that no match can straddle: same matches
as the plain ones, without backtracking or deep stacks on long runs.

Defined results: a null text is empty and has no spans; a very long text is searched whole; spans are in code points,
end exclusive; base spans of different kinds may overlap; of patterns with equal confidence the kind that comes last in the
alphabet wins; repeated rows get equal results; an empty table has no rows; extra columns are ignored by `find`, kept by `redact`.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stash

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Without these a text has no match of the kind.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: A token that may be an identifier: has a digit, no blank, 6 to 40 characters.
CANDIDATE = r"(?<![A-Za-z0-9._%+@:/-])(?=[A-Za-z._%+@:/-]{0,38}[0-9])[A-Za-z0-9+][A-Za-z0-9._%+@:/-]{4,38}[A-Za-z0-9](?![A-Za-z0-9._%+@:/-]*[A-Za-z0-9])"
#: Patterns that are sent to all tasks at most.
SENT = 100_000
SIGN, PLAIN = "\u0001", "\u0003"
ROUNDS = 3
#: A pattern is trusted with this confidence, from at least so many different instances.
CONFIDENCE, SUPPORT = 0.6, 4
CONTEXT_CHARS = 48
SPAN = "struct<kind:string,start:int,end:int,patterns:array<string>,instance:string>"
#: Elements that a scan appends to one array.
SCAN = 128


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def value(d: Column, i: Column) -> Column:
        twice = d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def _valid(kind: str | None, x: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike(r"^([0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])\z"))
    if kind == "card":
        return F.when(F.length(_digits(x)).between(16, 19), _luhn(_digits(x))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(x)).between(8, 15)
    return F.lit(True)


def bind(value: Column, use) -> Column:
    """`use(value)`, with the value worked out once however often it is named."""
    return F.transform(F.array(value), use)[0]


def _before(values: Column, op, zero: Column) -> Column:
    """For each value what `op` makes of all before it; in blocks, as an array that grows is copied with each element."""

    def block(x: Column, start: Column) -> Column:
        state = F.struct(start.alias("now"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(x, state, lambda a, v: F.struct(op(a["now"], v).alias("now"), F.concat(a["out"], F.array(a["now"])).alias("out")), lambda a: a["out"])

    def scan(x: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(x), F.lit(1)), F.lit(SCAN))
        parts = F.transform(starts, lambda i: F.slice(x, i, SCAN))
        return bind(parts, lambda p: bind(block(F.transform(p, lambda v: F.aggregate(v, zero, op)), zero), lambda first: F.flatten(F.transform(p, lambda v, i: block(v, F.get(first, i))))))

    return bind(values, scan)


def _words(text: Column) -> Column:
    """Lower case, without marks."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _patterns(before: Column, after: Column) -> Column:
    """Up to three patterns: the two words in front, the word in front, the word behind."""
    two = F.regexp_extract(before, r"(?:^|\s)(\S+\s+\S+)\s*\z", 1)
    one = F.regexp_extract(before, r"(?:^|\s)(\S+)\s*\z", 1)
    behind = F.regexp_extract(after, r"^\s*(\S+)(?:\s|\z)", 1)
    named = F.transform(F.array(two, one, behind), lambda x, i: F.when(F.length(_words(x)) > 0, F.when(i == 2, F.concat(F.lit("_ "), _words(x))).otherwise(F.concat(_words(x), F.lit(" _")))))
    return F.array_distinct(F.filter(named, lambda x: x.isNotNull()))


def matches(text: Column, kind: str | None, pattern: str) -> Column:
    """Valid matches, leftmost first, as array<SPAN>; the text is cut at marks set around each match."""
    parts = F.split(F.regexp_replace(F.translate(text, SIGN, PLAIN), pattern, f"{SIGN}$0{SIGN}"), SIGN)

    def spans(p: Column) -> Column:
        def span(x: Column, i: Column, at: Column) -> Column:
            fits = (i % 2 == 1) & _valid(kind, x)
            around = _patterns(F.right(F.get(p, i - 1), F.lit(CONTEXT_CHARS)), F.left(F.get(p, i + 1), F.lit(CONTEXT_CHARS)))
            return F.when(fits, F.struct(F.lit(kind).cast("string").alias("kind"), F.get(at, i).alias("start"), (F.get(at, i) + F.length(x)).alias("end"), around.alias("patterns"), x.alias("instance")))

        places = _before(F.transform(p, F.length), lambda a, v: a + v, F.lit(0))
        return F.filter(bind(places, lambda at: F.transform(p, lambda x, i: span(x, i, at))), lambda s: s.isNotNull())

    may = text.contains(NEEDS[kind]) if kind in NEEDS else F.lit(True)
    if kind != "email":
        may = may & text.rlike("[0-9]")
    return F.when(may, bind(parts, spans)).otherwise(F.array().cast(f"array<{SPAN}>"))


def base_spans(text: Column) -> Column:
    return F.concat(*(matches(text, k, PATTERNS[k]) for k in KINDS))


def candidates(text: Column, base: Column) -> Column:
    """Identifier-like tokens that touch no base span."""

    def apart(spans: Column) -> Column:
        return F.filter(matches(text, None, CANDIDATE), lambda c: ~F.exists(spans, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))

    return bind(F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"))), apart)


def extract(docs: DataFrame) -> DataFrame:
    """row, doc_id, mark (hash of the text), base and cand spans, without the text; written to the shared folder."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("base", base_spans(F.col("text")))
    rows = rows.withColumn("cand", candidates(F.col("text"), F.col("base")))
    return stash(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("mark"), "base", "cand"))


def pattern_uses(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern, uses: how often the words of each of `patterns` (the two next to the span) stand in the texts, whatever is beside them.

    Words meet the patterns before any shuffle where these are at most `SENT`, which is counted first."""
    front, words = F.col("pattern").endswith(" _"), F.split(F.regexp_replace("pattern", "^_ | _$", ""), " ")
    wanted = patterns.select("pattern").distinct().select("pattern", F.when(front, F.element_at(words, -1)).otherwise(F.element_at(words, 1)).alias("word"), F.when(front & (F.size(words) > 1), F.element_at(words, -2)).alias("ahead"))
    if wanted.limit(SENT + 1).count() <= SENT:
        wanted = F.broadcast(wanted)
    plain = F.split(F.trim(F.regexp_replace(F.lower(F.col("text").cast("string")), r"[^\p{L}\p{N}]+", " ")), " ")
    said = docs.where("text is not null").select(F.explode(bind(plain, lambda w: F.transform(w, lambda x, i: F.struct(x.alias("word"), F.when(i > 0, F.get(w, i - 1)).alias("before"))))).alias("x")).select("x.*")
    return said.join(wanted, "word").where("ahead is null or ahead = before").groupBy("pattern").agg(F.count("*").alias("uses"))


def confidences(edges: DataFrame, uses: DataFrame | None) -> DataFrame:
    """pattern, kind, confidence of patterns that introduce candidates, where it reaches `CONFIDENCE` with `SUPPORT` instances."""
    totals = edges.groupBy("pattern").agg(F.sum("n").alias("all"), F.count_if(~F.col("seed")).alias("open"))
    by_kind = edges.where("kind is not null").groupBy("pattern", "kind").agg(F.sum(F.col("score") * F.col("n")).alias("hits"), F.count_if(F.col("score") >= CONFIDENCE).alias("instances"))
    told = by_kind.where(F.col("instances") >= SUPPORT).join(totals.where("open > 0"), "pattern")
    told = told.join(uses, "pattern", "left") if uses is not None else told.withColumn("uses", F.lit(0))
    share = F.col("hits") / F.greatest("all", F.coalesce("uses", F.lit(0))) * (1 - 1 / (1 + F.col("instances")))
    return told.select("pattern", "kind", share.alias("confidence")).where(F.col("confidence") >= CONFIDENCE)


def trusted_patterns(docs: DataFrame, rows: DataFrame, rounds: int = ROUNDS) -> DataFrame | None:
    """pattern, kind, confidence of trusted patterns that introduce candidates; None if there are none."""
    seen = rows.select(F.explode(F.concat("base", "cand")).alias("s")).select(F.explode("s.patterns").alias("pattern"), "s.instance", "s.kind")
    edges = seen.groupBy("pattern", "instance", "kind").agg(F.count("*").alias("n"))
    edges = stash(edges.withColumn("score", F.when(F.col("kind").isNotNull(), 1.0).otherwise(0.0)).withColumn("seed", F.col("kind").isNotNull()))
    trusted, uses = None, None
    for _ in range(rounds):
        # Uses are counted of those patterns only that would be trusted without them.
        likely = confidences(edges, uses).select("pattern")
        fresh = stash(likely if uses is None else likely.join(uses, "pattern", "left_anti"))
        if fresh.limit(1).count():
            counted = stash(pattern_uses(docs, fresh))
            uses = counted if uses is None else uses.unionByName(counted)
        good = stash(confidences(edges, uses))
        if not good.limit(1).count():
            break
        trusted = good
        best = edges.where("not seed").select("pattern", "instance").join(good, "pattern").groupBy("instance").agg(F.max(F.struct("confidence", "kind")).alias("best"))
        edges = stash(edges.where("seed").unionByName(edges.where("not seed").join(best, "instance", "left").select("pattern", "instance", F.coalesce("best.kind", "kind").alias("kind"), "n", F.coalesce("best.confidence", "score").alias("score"), "seed")))
    return trusted


def discovered(rows: DataFrame, trusted: DataFrame) -> DataFrame:
    """row and more: spans that trusted patterns add, by row."""
    found = rows.where(F.size("cand") > 0).select("row", F.explode("cand").alias("s")).select("row", "s.start", "s.end", F.explode("s.patterns").alias("pattern"))
    best = trusted.groupBy("pattern").agg(F.max(F.struct("confidence", "kind")).alias("b"))
    told = found.join(best, "pattern").groupBy("row", "start", "end").agg(F.max("b").alias("b"))
    return told.groupBy("row").agg(F.collect_list(F.struct(F.col("b.kind").alias("kind"), "start", "end")).alias("more"))


def with_spans(rows: DataFrame, trusted: DataFrame | None) -> DataFrame:
    """The rows of `extract` with base spans without contexts, and with `every`: those and the added ones."""
    plain = rows.withColumn("base", F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    if trusted is None:
        return plain.withColumn("every", F.col("base"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return plain.join(discovered(rows, trusted), "row", "left").withColumn("every", F.concat("base", F.coalesce("more", none)))


def _is_kind(kind: str, span: Column) -> Column:
    return span["kind"] == kind


def _order(spans: Column) -> Column:
    """By kind as listed, then place."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    return F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(rank(s).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of base spans, and all spans, for every row of `docs`."""
    rows = extract(docs)
    every = with_spans(rows, trusted_patterns(docs, rows))
    counts = [F.size(F.filter("base", partial(_is_kind, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return every.select("doc_id", *counts, F.sha2(F.array_join(_order(F.col("base")), ","), 256).alias("base_sha256"), F.array_join(_order(F.col("every")), ",").alias("spans"))


def _cut(text: Column, spans: Column) -> Column:
    """The text with every span, or run of overlapping spans, replaced by its first kind's name."""

    def pieces(s: Column) -> Column:
        def piece(x: Column, reached: Column) -> Column:
            return F.when(x["start"] >= reached, F.concat(F.substr(text, reached + 1, x["start"] - reached), F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise("")

        reached = _before(F.transform(s, lambda x: x["end"]), lambda a, v: F.greatest(a, v), F.lit(0))
        last = F.array_max(F.transform(s, lambda x: x["end"]))
        return F.concat(bind(reached, lambda r: F.array_join(F.transform(s, lambda x, i: piece(x, F.get(r, i))), "")), F.substr(text, last + 1, F.length(text)))

    return bind(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))), pieces)


def redact(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with personal data replaced by the name of its kind; other columns stay.

    Spans depend on the text alone, so they meet the rows by id and text hash; those of at most `SENT` rows with as many spans, which are counted first, go to all tasks."""
    rows = extract(docs)
    spans = with_spans(rows, trusted_patterns(docs, rows)).where(F.size("every") > 0).dropDuplicates(["doc_id", "mark"])
    spans = stash(spans.select(F.col("doc_id").alias("_husk_id"), F.col("mark").alias("_husk_mark"), F.col("every").alias("_husk_spans")))
    discard(rows)
    size = spans.agg(F.count("*").alias("rows"), F.sum(F.size("_husk_spans")).alias("spans")).first()
    if max(size.rows, size.spans or 0) <= SENT:
        spans = F.broadcast(spans)
    text = F.col("text").cast("string")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_husk_id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("_husk_mark"))
    changed = F.when(F.col("_husk_spans").isNotNull(), _cut(text, F.col("_husk_spans"))).otherwise(text)
    return docs.join(spans, same, "left").select(*(changed.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns))
