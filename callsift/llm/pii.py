"""Personal data by fixed patterns and bootstrapped contextual extraction, in DataFrame functions only.

Four kinds are found by their form. These base spans, and long hexadecimal secrets, are the seeds of a
bootstrap over one graph of lexical patterns and instances, which has two sorts of edges:

- Every mention of the form word, sign, value ("token = b44e15...") links the pattern of the word in
  lower case and its sign with the value, ordinary words included. A value ends before a further word
  and sign, and mentions may overlap, so each of several chained assignments is an edge.
- Every seed and every other identifier-like candidate is linked with the one, two and three words
  before it and with the word after it, whatever stands between.

A pattern's confidence for a kind is the share of its distinct instances known to be of that kind, the
ordinary words in the place of an instance included. For words around an instance these are counted
only for patterns that are confident without them, as they can make no pattern more confident.
Patterns that are confident and have enough support make their other identifier-like instances known,
these support further patterns, and so on until no new instance appears. All identifier-like instances
of the patterns that are confident in the end become spans beside the base ones.

Positions count code points. They come from the lengths of the parts between matches, as Spark gives
matches without positions.

What is looked at: a mention's word has at most 31 characters, its value at least 4. The words around a
candidate are those in the 120 characters before it and the 60 behind it; a word that reaches beyond is
taken from there. To be discovered, a value needs 6 characters and an at sign or 3 digits; base spans have
no such limits.

Defined results: null and empty texts have no spans; rows equal in doc_id and text get the same spans,
each; spans of different kinds may overlap and all are reported; an empty table gives no rows. Only
doc_id and text are read, and `redacted` replaces only text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsift.plans.once import computed_once
from callsift.plans.sizing import lookup_side
from callsift.session import settle

# Possessive forms of the base patterns: they match the same texts without going back, and a match
# that cannot begin earlier in a run of its characters is only tried at the run's start.
EMAIL = (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
SECRET = r"^[0-9A-Fa-f]{32,}$"
MENTION = r"""(?<![\p{L}\p{N}_])(\p{L}[\p{L}\p{N}_]{0,30}+)(["'\x20]{0,2}+[:=#]["'\x20:=#]{0,3}+)"""
# The value after a mention's sign: it ends before a further word and sign that have a value.
VALUE = r"""(?:(?!(?<![\p{L}\p{N}_])\p{L}[\p{L}\p{N}_]{0,30}+[:=#]["'\x20:=#]{0,3}+[^\s"',;]{4})[^\s"',;]){4,}+"""
TAIL = r"[.!?)\]}>&]+$"
# A number in groups, or a run of such characters with a digit or an at sign in it.
PART = r"[\p{L}\p{N}_@.%+/-]"
NUMBER = r"\+?+[0-9](?:[\x20().-]{0,2}+[0-9])++(?![._%+/-]*+[\p{L}\p{N}_@])"
CANDIDATE = rf"(?<!{PART})(?:{NUMBER}|(?:(?![0-9@]){PART})*+[0-9@]{PART}*+)"
WORD = r"[\p{L}\p{N}_]+"
BEFORE, AFTER = 120, 60  # characters in which the words around a candidate are looked for
WORDS_BEFORE = 3
WORD_BITS = 1 << 16
FIRST_LOOK, WIDER = 4_096, 16
CONFIDENT = 0.6
SUPPORT = 3

MENTIONS = "array<struct<start:int,text:string,pattern:string>>"
CANDIDATES = "array<struct<start:int,text:string,before:string,after:string>>"
SPANS = "array<struct<start:int,end:int,text:string>>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def valid_ip(text: Column) -> Column:
    def small(part: Column) -> Column:
        held = F.regexp_replace(part, "^0+(?=.)", "")
        return F.when(F.length(held) <= 3, held.cast("int") <= 255).otherwise(False)

    return F.forall(F.split(text, r"\."), small)


def valid_card(text: Column) -> Column:
    """16 to 19 digits whose sum, every second digit from the right doubled, ends in 0."""
    digits = F.reverse(_digits(text))

    def part(i: Column) -> Column:
        digit = F.substr(digits, i, F.lit(1)).cast("int")
        doubled = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return F.when(i % 2 == 0, doubled).otherwise(digit)

    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + part(i)
    )
    return F.when(F.length(digits).between(16, 19), total % 10 == 0).otherwise(False)


def valid_phone(text: Column) -> Column:
    return F.length(_digits(text)).between(8, 15)


def spans(text: Column, pattern: str, valid: Callable[[Column], Column], likely: Column) -> Column:
    """Start, end and text of all valid matches, from left to right; only looked for where `likely`."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(found.alias("found"), F.split(text, pattern, -1).alias("gap"))
    nothing = F.array().cast(SPANS)
    start = F.struct(F.lit(0).alias("at"), nothing.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["found"]), F.lit(0))
        span = F.array(F.struct(begin.alias("start"), end.alias("end"), x["found"].alias("text")))
        kept = F.when(x["found"].isNotNull() & valid(x["found"]), F.concat(acc["out"], span))
        return F.struct(end.alias("at"), kept.otherwise(acc["out"]).alias("out"))

    listed = F.aggregate(zipped, start, step, lambda acc: acc["out"])
    return F.when(likely, listed).otherwise(nothing)


def mentions_in(text: Column) -> Column:
    """Start and text of the value and pattern of every mention; a value may hold further mentions."""
    whole = MENTION + f"(?=({VALUE}))"
    zipped = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(whole), F.lit(0)).alias("found"),
        F.regexp_extract_all(text, F.lit(whole), F.lit(3)).alias("value"),
        F.split(text, whole, -1).alias("gap"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(MENTIONS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x["gap"]) + F.coalesce(F.length(x["found"]), F.lit(0))
        sign = F.regexp_extract(x["found"], "[:=#]", 0)
        word = F.regexp_extract(x["found"], rf"^{WORD}", 0)
        mention = F.array(F.struct(
            end.alias("start"), F.regexp_replace(x["value"], TAIL, "").alias("text"),
            F.concat(F.lower(word), sign).alias("pattern"),
        ))
        kept = F.when(x["found"].isNotNull(), F.concat(acc["out"], mention))
        return F.struct(end.alias("at"), kept.otherwise(acc["out"]).alias("out"))

    sign = text.contains(":") | text.contains("=") | text.contains("#")
    listed = F.aggregate(zipped, start, step, lambda acc: acc["out"])
    return F.when(sign, listed).otherwise(F.array().cast(MENTIONS))


def candidates_in(text: Column) -> Column:
    """Start and text of everything that may be an identifier, and the text before and after it, in
    which an earlier candidate is only a 0."""
    gap = F.split(text, CANDIDATE, -1)
    zipped = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("found"), gap.alias("gap"),
        F.transform(F.slice(gap, 2, F.size(gap)), lambda g: F.left(g, F.lit(AFTER))).alias("next"),
    )
    start = F.struct(
        F.lit(0).alias("at"), F.lit("").alias("tail"), F.array().cast(CANDIDATES).alias("out")
    )

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        tail = F.right(F.concat(acc["tail"], F.right(x["gap"], F.lit(BEFORE))), F.lit(BEFORE))
        own = F.regexp_replace(x["found"], "^[._%/-]+", "")
        held = F.array(F.struct(
            (begin + F.length(x["found"]) - F.length(own)).alias("start"),
            F.regexp_replace(own, TAIL, "").alias("text"), tail.alias("before"),
            x["next"].alias("after"),
        ))
        return F.struct(
            (begin + F.coalesce(F.length(x["found"]), F.lit(0))).alias("at"),
            F.concat(tail, F.lit(" 0 ")).alias("tail"),
            F.when(x["found"].isNotNull() & (F.length(own) > 2), F.concat(acc["out"], held))
            .otherwise(acc["out"]).alias("out"),
        )

    listed = F.aggregate(zipped, start, step, lambda acc: acc["out"])
    return F.when(text.rlike("[0-9@]"), listed).otherwise(F.array().cast(CANDIDATES))


def base_spans(text: Column) -> dict[str, Column]:
    digit = text.rlike("[0-9]")
    return {
        "email": spans(text, EMAIL, lambda t: F.lit(True), text.contains("@")),
        "ip": spans(text, IP, valid_ip, text.contains(".") & digit),
        "card": spans(text, CARD, valid_card, text.rlike("[0-9](?:[\x20-]?[0-9]){15}")),
        "phone": spans(text, PHONE, valid_phone, text.contains("+") & digit),
    }


def examined(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, the base spans of each kind, all mentions and candidates, from one pass over the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    named = docs.select("doc_id", text.alias("text"))
    return computed_once(
        named, **base_spans(F.col("text")), mentions=mentions_in(F.col("text")),
        candidates=candidates_in(F.col("text")), text_key=F.xxhash64("text"),
    ).drop("text")


def words(text: Column) -> Column:
    """All words in lower case, numbers in them as 0."""
    plain = F.regexp_replace(F.lower(text), "[0-9]+", "0")
    return F.regexp_extract_all(plain, F.lit(WORD), F.lit(0))


def words_around(c: Column) -> Column:
    """The patterns of a candidate: one to three words before it, and the word after it."""
    def last(n: int) -> Column:
        few = F.slice(words(c["before"]), -n, n)
        return F.when(F.size(words(c["before"])) >= n, F.concat(F.array_join(few, " "), F.lit(" _")))

    after = F.concat(F.lit("_ "), F.get(words(c["after"]), F.lit(0)))
    return F.array_compact(F.array(*[last(n) for n in range(1, WORDS_BEFORE + 1)], after))


def mentions_of(found: DataFrame) -> DataFrame:
    """One row per edge of the graph and place: doc_id, text_key, pattern, value key, place of the value,
    its kind if a base span begins where it does (of a candidate: in it) or it has the form of a secret,
    whether it looks like an identifier, and whether it is held by a base span."""
    assigned = F.transform("mentions", lambda m: F.struct(
        m["start"].alias("start"), m["text"].alias("text"), F.array(m["pattern"]).alias("patterns"),
        F.lit(1).alias("width"),
    ))
    around = F.transform("candidates", lambda c: F.struct(
        c["start"].alias("start"), c["text"].alias("text"), words_around(c).alias("patterns"),
        F.length(c["text"]).alias("width"),
    ))
    each = found.filter((F.size("mentions") > 0) | (F.size("candidates") > 0)).select(
        "doc_id", "text_key", *KINDS, F.explode(F.concat(assigned, around)).alias("m")
    ).select("doc_id", "text_key", *KINDS, "m.*")
    start, end = F.col("start"), F.col("start") + F.col("width")
    begins = [
        F.when(F.exists(kind, lambda s: (s["start"] >= start) & (s["start"] < end)), F.lit(kind))
        for kind in KINDS
    ]
    whole = start + F.length("text")
    inside = reduce(lambda a, b: a | b, [
        F.exists(kind, lambda s: (s["start"] < whole) & (s["end"] > start)) for kind in KINDS
    ])
    secret = F.when(F.col("text").rlike(SECRET), F.lit("secret"))
    identifier = (F.length("text") >= 6) & (
        F.col("text").contains("@") | (F.length(_digits(F.col("text"))) >= 3)
    )
    told = computed_once(
        each, value=F.md5("text"), end=whole, kind=F.coalesce(*begins, secret), identifier=identifier,
        held=inside,
    ).filter((F.col("width") == 1) | F.col("identifier") | F.col("kind").isNotNull())
    return told.select(
        "doc_id", "text_key", F.explode("patterns").alias("pattern"), "value", "start", "end", "kind",
        "identifier", "held",
    )


def asked_bits(words_asked: DataFrame) -> Column:
    """Which remainders modulo WORD_BITS the hashes of the words `w` have, as one array of longs: a table of
    a fixed size for a look in the row."""
    at = F.pmod(F.xxhash64("w"), F.lit(WORD_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))
    held = words_asked.select(F.floor(at / 64).alias("word"), bit.alias("bit"))
    every = words_asked.sparkSession.range(WORD_BITS // 64).select(
        F.col("id").alias("word"), F.lit(0).cast("long").alias("bit")
    )
    words_of = held.unionByName(every).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    ordered = F.array_sort(F.collect_list(F.struct("word", "bits")))
    return words_of.agg(F.transform(ordered, lambda s: s["bits"])).scalar()


def may_be_asked(bits: Column, word: Column) -> Column:
    """Whether a word may be in a table of `asked_bits`; null counts as no."""
    at = F.pmod(F.xxhash64(word), F.lit(WORD_BITS))
    held = F.call_function("bit_get", F.get(bits, F.floor(at / 64).cast("int")), (at % 64).cast("int"))
    return word.isNotNull() & (held == 1)


def ordinary(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, n_ordinary): the distinct ordinary words in the place of an instance, for those of
    `patterns` that are words around one, over all texts.

    One pass over the texts: words whose neighbour can't be the nearest word of a pattern are left out in
    the row, before anything is built for them, and only the others make edges.
    """
    asked = patterns.filter(around(F.col("pattern"))).select("pattern").distinct()
    parts = F.split("pattern", " ")
    nearest = F.when(F.endswith("pattern", F.lit(" _")), F.element_at(parts, -2)).otherwise(parts[1])
    marked = F.regexp_replace(F.coalesce("text", F.lit("")), CANDIDATE, " 0 ")
    bits = asked_bits(asked.select(nearest.alias("w")).distinct())
    read = computed_once(docs.select("text"), w=words(marked)).select("w", bits.alias("_bits"))
    near = F.transform("w", lambda word: may_be_asked(F.col("_bits"), word))
    held = computed_once(read.filter(F.size("w") > 0), near=near).filter(F.exists("near", lambda hit: hit))
    places = F.filter(
        F.sequence(F.lit(0), F.size("w") - 1),
        lambda i: (F.coalesce(F.get("near", i - 1), F.lit(False)) | F.coalesce(
            F.get("near", i + 1), F.lit(False))) & ~F.contains(F.get("w", i), F.lit("0")),
    )

    def edge(i: Column) -> Column:
        def last(n: int) -> Column:
            few = F.slice("w", F.greatest(i - n + 1, F.lit(1)), n)
            return F.when(i >= n, F.concat(F.array_join(few, " "), F.lit(" _")))

        after = F.concat(F.lit("_ "), F.get("w", i + 1))
        patterns_of = F.array(*[last(n) for n in range(1, WORDS_BEFORE + 1)], after)
        return F.struct(F.get("w", i).alias("word"), F.array_compact(patterns_of).alias("patterns"))

    each = held.select(F.explode(places).alias("i"), "w")
    edges = each.select(edge(F.col("i")).alias("e")).select(
        "e.word", F.explode("e.patterns").alias("pattern")
    )
    found = edges.join(lookup_side(asked), "pattern", "left_semi").distinct()
    return found.groupBy("pattern").agg(F.count("*").alias("n_ordinary"))


def around(pattern: Column) -> Column:
    """Whether a pattern is words around an instance, not a word and a sign."""
    return F.endswith(pattern, F.lit(" _")) | F.startswith(pattern, F.lit("_ "))


def confident(edges: DataFrame, plain: DataFrame | None = None) -> DataFrame:
    """(pattern, kind) of the patterns confident in one kind, over distinct (pattern, value) edges and
    the numbers of ordinary words in `plain`."""
    kinds = (*KINDS, "secret")
    counts = edges.groupBy("pattern").agg(
        F.count("*").alias("total"),
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in kinds],
    )
    if plain is not None:
        more = F.col("total") + F.coalesce("n_ordinary", F.lit(0))
        counts = counts.join(plain, "pattern", "left").withColumn("total", more)
    best = F.greatest(*[
        F.struct(F.col(f"n_{k}").alias("n"), F.lit(k).alias("kind")) for k in kinds
    ])
    return counts.select("pattern", "total", best.alias("best")).filter(
        (F.col("best.n") >= SUPPORT) & (F.col("best.n") >= CONFIDENT * F.col("total"))
    ).select("pattern", F.col("best.kind").alias("found"))


def bootstrapped(edges: DataFrame, known: DataFrame, plain: DataFrame | None = None) -> DataFrame:
    """The confident patterns once no new instance appears. Every round but the last makes at least one
    more instance known, so the rounds come to an end."""
    while True:
        spread = edges.join(known, "value", "left").select(
            "pattern", "value", F.coalesce("kind", "learned").alias("kind"), "identifier"
        )
        patterns = settle(confident(spread, plain), "patterns")
        told = spread.filter(F.col("identifier") & F.col("kind").isNull()).join(patterns, "pattern")
        news = settle(told.groupBy("value").agg(F.min("found").alias("learned")), "news")
        if news.isEmpty():
            return patterns
        known = settle(known.unionByName(news), "known")


def learned_patterns(mentions: DataFrame, docs: DataFrame) -> DataFrame:
    """(pattern, found) after bootstrapping over the graph of patterns and instances."""
    edges = settle(mentions.groupBy("pattern", "value").agg(
        F.min("kind").alias("kind"), F.max("identifier").alias("identifier")
    ), "edges")
    known = settle(
        edges.filter(F.col("kind").isNotNull()).groupBy("value").agg(F.min("kind").alias("learned")),
        "known",
    )
    hopeful = bootstrapped(edges, known)
    asked = hopeful.filter(around(F.col("pattern"))).select("pattern")
    if asked.isEmpty():
        return hopeful
    totals = edges.join(asked, "pattern", "left_semi").groupBy("pattern").agg(F.count("*").alias("all"))
    left, plain = unrefuted(docs, settle(totals, "asked"))
    kept = hopeful.filter(~around(F.col("pattern"))).select("pattern").unionByName(left.select("pattern"))
    return bootstrapped(edges.join(kept, "pattern", "left_semi"), known, plain)


def looks(docs: DataFrame, first: int = FIRST_LOOK, wider: int = WIDER) -> Iterator[DataFrame]:
    """Growing parts of the table, by a hash: about `first` rows, each time `wider` times as many, at last
    all rows."""
    n, size = docs.count(), first
    while size < n:
        at = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(n))
        yield docs.filter(at < size)
        size *= wider
    yield docs


def unrefuted(docs: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Those of the (pattern, all) `asked` that ordinary words in their place don't rule out, and the numbers
    of these words over all texts.

    A pattern with more ordinary words than even an instance of the right kind in every place would allow is
    ruled out, whatever else is found. Common words are so after a look at few texts, and are not looked
    for in more of them; what is left in the end was counted in all.
    """
    left, seen = asked, None
    for part in looks(docs):
        seen = settle(ordinary(part, left), "ordinary")
        together = F.col("all") + F.coalesce("n_ordinary", F.lit(0))
        still = left.join(seen, "pattern", "left").filter(F.col("all") >= CONFIDENT * together)
        left = settle(still.select("pattern", "all"), "asked")
        if left.isEmpty():
            break
    return left, seen


def discovered(mentions: DataFrame, patterns: DataFrame) -> DataFrame:
    """doc_id, text_key and the spans that confident patterns add, as kind:start:end structs."""
    fresh = F.col("identifier") & ~(around(F.col("pattern")) & F.col("held"))
    hits = mentions.filter(fresh).join(patterns, "pattern")
    span = F.struct(F.col("found").alias("kind"), "start", "end")
    grouped = hits.select("doc_id", "text_key", span.alias("s")).distinct().groupBy("doc_id", "text_key")
    return grouped.agg(F.sort_array(F.collect_list("s")).alias("added"))


def joined_spans(kinds: dict[str, Column]) -> Column:
    """kind:start:end of all spans by kind, then start, with commas between."""
    def shown(kind: str) -> Callable[[Column], Column]:
        return lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"])

    lists = [F.transform(held, shown(kind)) for kind, held in kinds.items()]
    return F.array_join(F.concat(*lists), ",")


def found_spans(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, text_key, the base spans by kind, and `added`, what the method adds.

    Added spans that equal a base span are left out.
    """
    found = settle(examined(docs), "examined")
    mentions = settle(mentions_of(found), "mentions")
    added = discovered(mentions, learned_patterns(mentions, docs)).select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "added"
    )
    base = found.drop("mentions", "candidates")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    joined = base.join(added, same, "left")

    def is_base(s: Column) -> Column:
        return reduce(lambda a, b: a | b, [
            (s["kind"] == k) & F.exists(k, lambda b: (b["start"] == s["start"]) & (b["end"] == s["end"]))
            for k in KINDS
        ])

    fresh = F.filter(
        F.coalesce("added", F.array().cast("array<struct<kind:string,start:int,end:int>>")),
        lambda s: ~is_base(s),
    )
    return joined.select("doc_id", "text_key", *KINDS, fresh.alias("added"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base spans by kind, their digest, and all spans."""
    held = found_spans(docs)
    base = joined_spans({k: F.col(k) for k in KINDS})

    def of_kind(kind: str) -> Column:
        own = F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
        more = F.transform(
            F.filter("added", lambda s: s["kind"] == kind),
            lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")),
        )
        return F.sort_array(F.concat(own, more))

    more = F.filter("added", lambda s: s["kind"] == "secret")
    return held.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(base, 256).alias("base_sha256"),
        joined_spans({**{k: of_kind(k) for k in KINDS}, "secret": more}).alias("spans"),
    )


def redacted(docs: DataFrame) -> DataFrame:
    """`docs` with every span in text replaced by its kind in brackets; overlapping spans become one."""
    held = settle(found_spans(docs), "spans")

    def of_kind(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: entry(s, F.lit(kind)))

    def entry(s: Column, kind: Column) -> Column:
        return F.struct(s["start"].alias("start"), (-s["end"]).alias("less_end"), kind.alias("kind"))

    added = F.transform("added", lambda s: entry(s, s["kind"]))
    every = F.sort_array(F.concat(*[of_kind(k) for k in KINDS], added))
    hit = held.select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), every.alias("_spans")
    ).filter(F.size("_spans") > 0).distinct()
    # In order of start, the longest first; a span that begins inside another only lengthens it.
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    text = F.col("text")

    def step(acc: Column, s: Column) -> Column:
        mark = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        gap = F.substr(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        fresh = s["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], -s["less_end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], F.array(gap, mark))).otherwise(acc["out"]).alias("out"),
        )

    rebuilt = F.aggregate(
        F.col("_spans"), begin, step,
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1, F.length(text))),
    )
    keyed = docs.withColumn("_text", F.xxhash64(F.coalesce("text", F.lit(""))))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_key"))
    joined = keyed.join(hit, same, "left")
    return joined.withColumn("text", F.when(F.col("_spans").isNotNull(), rebuilt).otherwise(text)).select(
        *docs.columns
    )
