"""Personal data: fixed patterns, then bootstrapped contextual extraction. DataFrame functions only.

The base finds e-mail addresses, IP addresses, card and phone numbers by their form. Those spans seed the bootstrap,
together with tokens whose form alone marks them as keys (32 hexadecimal digits or more, letters and digits both).
Each seed is an instance, and so is every other token with a digit or an at sign. Its lexical patterns are the two
words before it, the one before, the one after, and the one before together with the one after; the ends of the text
count as words, letters as lower case, runs of digits as one 0. Tokens inside a span are part of that instance and none
of their own.

Over the graph of all patterns and instances, a pattern's confidence is the sum of its instances' scores, each as often
as it occurs there, divided by how often the pattern occurs around any token whatever (and ``SHRINK`` more). So words
that stand before all sorts of words are no patterns, however many seeds happen to follow them. Each round admits the
patterns that hold ``MIN_SEEDS`` instances found so far, be they seeds or discovered in earlier rounds, and whose
confidence is ``ADMIT``; a new instance's score is the chance that not all its admitted patterns err (of those that
look at the words before it the best counts, and of those that look at the word after), so what one pattern discovers
can make the next pattern confident. Tokens that don't look like identifiers keep score 0, seeds score 1. After the
rounds, instances above the threshold are reported with kind ``id`` wherever one of their confident patterns holds
them. A key-like seed is reported on the same terms: its form alone is not enough.

Texts are read twice: for spans and candidates, cut as a table without texts, and for the occurrences of the
candidates' patterns, picked out by a table of ``SLOTS`` bits before anything is exploded. Patterns and instances are
aggregated before each join, so a pattern that a third of all rows share costs each task one row. Repetitions in the
expressions are possessive: Java then neither recurses nor backtracks over long runs. They find what the plain forms
find.

Defined results: null and empty texts have no spans. Repeated rows are searched each by itself. Very long texts are
searched whole; positions are summed in an array, in time that grows with the square of one text's matches. Added spans
do not overlap base spans; they stand in order of their start. Without seeds nothing is added. Equal confidences need
no order. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import cut

KINDS = ("email", "ip", "card", "phone")
# After a match ends, the next may begin at once (\G); else it begins where a run of its characters does.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9][0-9]?)"
# A word, and ahead of it another word, a token with a digit or an at sign, and perhaps a word after that.
_WS, _WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
_NEAR = rf"(?<!{_WORD})({_WORD}++){_WS}++(?=({_WORD}++)({_WS}++)((?:(?![0-9@]){_WORD})*+[0-9@]{_WORD}*+)(?:{_WS}++({_WORD}++))?+)"
_CORE = r"[A-Za-z0-9](?:.*[A-Za-z0-9])?"

# Two words that stand for the start of a text, and one for its end.
_START, _END = "\x02 \x02 ", "\x03"
_KEY = r"^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]{32,}$"

ROUNDS, SHRINK, MIN_SEEDS, ADMIT, THRESHOLD = 3, 1.0, 3, 0.5, 0.75
#: Bits of the table of candidates' patterns.
SLOTS = 1 << 20
SPANS = "array<struct<start:int,end:int,s:string>>"


def matches(text: Column, pattern: str) -> Column:
    """All matches as array of (start, end, s) in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.filter(F.zip_with(F.split(text, pattern, -1), found, lambda gap, m: F.struct(gap.alias("gap"), m.alias("m"))), lambda x: x["m"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["m"].alias("s")))).alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def base_spans(text: Column) -> dict[str, Column]:
    """By kind, the spans of the fixed patterns. Matches that fail their test are dropped, without another try."""
    card, phone = lambda x: _digits(x["s"]), lambda x: F.length(_digits(x["s"]))
    none = F.array().cast(SPANS)
    digit = text.rlike("[0-9]")
    return {
        "email": F.when(text.contains("@"), matches(text, _EMAIL)).otherwise(none),
        "ip": F.when(digit, F.filter(matches(text, _IP), lambda x: x["s"].rlike(rf"^(?:{_BYTE}\.){{3}}{_BYTE}$"))).otherwise(none),
        "card": F.when(digit, F.filter(matches(text, _CARD), lambda x: F.length(card(x)).between(13, 19) & F.call_function("luhn_check", card(x)))).otherwise(none),
        "phone": F.when(text.contains("+"), F.filter(matches(text, _PHONE), lambda x: phone(x).between(9, 15))).otherwise(none),
    }


def _general(words: Column) -> Column:
    return F.regexp_replace(F.lower(words), "[0-9]+", "0")


def patterns(two: Column, one: Column, after: Column) -> Column:
    """The patterns of a place in a text, as 64-bit hashes, by the words before it and the one after."""
    return F.array(F.xxhash64(F.lit("two"), two, one), F.xxhash64(F.lit("one"), one), F.xxhash64(F.lit("after"), after), F.xxhash64(F.lit("around"), one, after))


def candidates(text: Column) -> Column:
    """Tokens with a digit or an at sign as array of (start, end, token, patterns, instance).

    ``start`` and ``end`` are those of the instance, without the outer punctuation; ``token`` is where the token starts.
    """
    led = F.concat(F.lit(_START), text)
    near = matches(led, _NEAR)
    group = lambda k: F.regexp_extract_all(led, F.lit(_NEAR), F.lit(k))
    rows = F.arrays_zip(near.alias("m"), group(1).alias("w1"), group(2).alias("w2"), group(3).alias("gap"), group(4).alias("token"), group(5).alias("w3"))

    def one(x: Column) -> Column:
        core = F.regexp_extract(x["token"], rf"(?s){_CORE}", 0)
        token = x["m"]["end"] + F.length(x["w2"]) + F.length(x["gap"]) - len(_START)
        begin = token + F.instr(x["token"], core) - 1
        after = F.when(x["w3"] == "", F.lit(_END)).otherwise(_general(x["w3"]))
        return F.struct(
            begin.cast("int").alias("start"), (begin + F.length(core)).cast("int").alias("end"), token.cast("int").alias("token"),
            patterns(_general(x["w1"]), _general(x["w2"]), after).alias("patterns"), core.alias("instance"),
        )

    return F.when(text.rlike("[0-9@]"), F.transform(rows, one)).otherwise(F.array().cast("array<struct<start:int,end:int,token:int,patterns:array<bigint>,instance:string>>"))


def occurrences(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """(pattern, total): how often each pattern of ``edges`` occurs around any token of the texts; and some other patterns,
    which share a bit with one of them."""
    spark = docs.sparkSession
    bit = lambda h: F.pmod(h, F.lit(SLOTS))
    at = edges.select(bit(F.col("pattern")).alias("at"))
    found = at.groupBy(F.shiftright("at", 6).cast("long").alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
    every = spark.range(SLOTS >> 6).join(F.broadcast(found), F.col("id") == F.col("slot"), "left")  # SLOTS / 64 rows at most
    table = every.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))), lambda x: x["bits"]).alias("wanted"))
    words = F.split(F.concat(F.lit(_START), F.regexp_replace(_general(F.col("text")), rf"^{_WS}++|{_WS}++$", ""), F.lit(" " + _END)), rf"{_WS}++")
    rows = docs.select(words.alias("w")).where(F.size("w") > 3).join(F.broadcast(table))  # one row
    here = F.flatten(F.transform(F.sequence(F.lit(3), F.size("w") - 1), lambda i: patterns(F.element_at("w", i - 2), F.element_at("w", i - 1), F.element_at("w", i + 1))))
    marked = lambda h: F.getbit(F.element_at("wanted", (F.shiftright(bit(h), 6) + 1).cast("int")), (bit(h) % 64).cast("int")) == 1
    return rows.select(F.explode(F.filter(here, marked)).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("total"))


def bootstrap(edges: DataFrame, totals: DataFrame) -> DataFrame:
    """(pattern, instance) of discovered instances and the confident patterns they stand in.

    ``edges``: pattern, after (1 or 0: whether it looks at the word after only), instance, n, seed (2 for a base span, 1
    for a key, else 0), plausible (1 or 0); each pair once. ``totals``: pattern, total.
    """
    live = cut(edges.join(totals, "pattern"), "edges")
    seeds = live.where("seed > 0").select("instance", F.lit(1.0).alias("score")).distinct()
    scores = seeds
    admitted = None
    for _ in range(ROUNDS):
        scored = live.join(scores, "instance", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        confidence = scored.groupBy("pattern").agg((F.sum(F.col("score") * F.col("n")) / (F.max("total") + F.lit(SHRINK))).alias("confidence"), F.count_if(F.col("score") >= THRESHOLD).alias("found"))
        admitted = cut(confidence.where((F.col("found") >= MIN_SEEDS) & (F.col("confidence") >= ADMIT)).select("pattern", "confidence"), "patterns")
        backed = live.where("plausible = 1").join(admitted, "pattern").groupBy("instance", "after").agg(F.max("confidence").alias("confidence"))
        fresh = backed.groupBy("instance").agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence")))))).alias("score"))
        scores = cut(seeds.unionByName(fresh).groupBy("instance").agg(F.max("score").alias("score")), "scores")
    kept = scores.where(F.col("score") >= THRESHOLD).select("instance")
    strong = admitted.where(F.col("confidence") >= THRESHOLD).select("pattern")
    return live.where("seed < 2 and plausible = 1").join(kept, "instance").join(strong, "pattern").select("pattern", "instance")


def find(docs: DataFrame) -> DataFrame:
    """For each row doc_id, an array of (start, end, s) for each base kind, and ``id``, those that the bootstrap adds."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = cut(rows.select("row", "doc_id", *(c.alias(k) for k, c in base_spans(F.col("text")).items()), candidates(F.col("text")).alias("near")), "spans")
    base = F.concat(*KINDS)
    held = F.filter(F.col("base"), lambda b: (b["start"] < F.col("c.end")) & (F.col("c.token") < b["end"]))
    each = rows.where(F.size("near") > 0).select("row", base.alias("base"), F.explode("near").alias("c")).where("c.instance != ''")
    each = each.select("row", "c.*", held.alias("held")).where(~F.exists("held", lambda b: b["start"] < F.col("token")))
    seed = F.when(F.size("held") > 0, 2).when(F.col("instance").rlike(_KEY), 1).otherwise(0)
    instance = F.when(F.size("held") > 0, F.get("held", F.lit(0))["s"]).otherwise(F.col("instance"))
    each = each.select("row", "start", "end", F.posexplode("patterns").alias("kind", "pattern"), instance.alias("instance"), seed.alias("seed"))
    form = (F.length("instance") >= 6) & (F.length(F.regexp_replace("instance", "[^0-9]", "")) >= 4)
    edges = each.groupBy("pattern", "instance").agg(F.max((F.col("kind") == 2).cast("int")).alias("after"), F.count("*").alias("n"), F.max("seed").alias("seed"), F.max(form.cast("int")).alias("plausible"))
    edges = cut(edges, "graph")
    new = bootstrap(edges, occurrences(docs.select(text.alias("text")), edges)).select(F.col("pattern").alias("p"), F.col("instance").alias("i"))
    hits = each.where("seed < 2").join(new, (F.col("pattern") == F.col("p")) & (F.col("instance") == F.col("i")))
    hits = hits.groupBy(F.col("row").alias("r")).agg(F.array_sort(F.collect_set(F.struct("start", "end", F.col("instance").alias("s")))).alias("id"))
    out = rows.drop("near").join(hits, F.col("row") == F.col("r"), "left")
    return out.withColumn("id", F.coalesce("id", F.array().cast(SPANS))).drop("row", "r")


def joined(found: DataFrame, kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` of all spans, by kind and start, comma-joined."""

    def named(k: str) -> Column:
        return F.transform(k, lambda x: F.concat(F.lit(f"{k}:"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string")))

    return F.array_join(F.concat(*map(named, kinds)), ",")
