"""Personal data by fixed forms, and more of it by bootstrapped lexical patterns.

Four forms (e-mail and IP addresses, card and phone numbers) are found exactly as stated and seed
the rest. A *pattern* is the two words before an identifier, an *instance* a string that looks like one
without having a stated form (an address without a dot, digits without a plus sign or with a wrong
check digit, ...). Patterns and instances are the two sides of a graph. A pattern is trusted by the
share of what follows its words anywhere in the corpus that is an identifier; an instance by the
trusted patterns that it follows. Both are scored in turns, so that instances found by one pattern
can make another one trusted, which finds more.

Everything is a DataFrame expression: matches and places come from ``regexp_extract_all`` and ``split``,
whose parts alternate. The regular expressions are written with possessive quantifiers, which match the
same but neither recurse nor go back: texts of any length pass in linear time. Texts are read twice and
never shuffled; the graph holds one row for each different word pair and instance.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from haulscope.llm import common
from haulscope.operators.joins import join_measured
from haulscope.session import settle

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

# The stated forms. The same matches as without possessive quantifiers and look-behind:
# a leftmost match starts where a run of its characters starts, or where the last match has ended.
LOCAL = r"A-Za-z0-9._%+-"
FORMS = (
    rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
# What looks like an identifier: an address written out, an address of eight groups, seven digits and
# more with up to two separators between. A stated form that starts here is taken in one piece.
LIKE = "|".join(
    (
        rf"(?<![{LOCAL}])[{LOCAL}]++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++"
        r"(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?)[A-Za-z0-9-]++)*+",
        FORMS[PHONE],
        r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}+(?:::?[0-9A-Fa-f]{1,4}+){3,7}+",
        r"(?<![0-9A-Za-z])[0-9](?:[\x20().-]{0,2}+[0-9]){6,}+",
    )
)
# Up to 255 in each of four parts, whatever the zeros before.
BYTES = r"\A(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{0,2})(?:\.(?!\z)|\z)){4}\z"

# A pattern takes this many different instances at least, at any size of the input. So patterns have no
# upper number, and are broadcast only where they have been measured.
SUPPORT = 5
# Score from which patterns and instances are trusted.
TRUSTED = 0.8
TURNS = 3
# Characters before a match in which the two words are looked for.
REACH = 64
# Partial sums are taken over so many matches at a time.
BLOCK = 128

_SPANS = "array<struct<start:int,kind:int,end:int,value:string,left:string,spaced:boolean>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sums(lengths: Column) -> Column:
    """Sums of all elements before each one: over blocks, and inside the block."""
    zero = F.lit(0)

    def add(part: Column) -> Column:
        return F.aggregate(part, zero, lambda a, x: a + x)

    blocks = F.transform(
        F.sequence(zero, F.floor((F.size(lengths) - 1) / BLOCK).cast("int")),
        lambda b: add(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))),
    )

    def at(before: Column) -> Column:
        return F.transform(
            lengths,
            lambda _, i: F.get(before, F.floor(i / BLOCK).cast("int"))
            + add(F.slice(lengths, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK)),
        )

    return _let(
        blocks, lambda b: _let(F.transform(b, lambda _, i: add(F.slice(b, F.lit(1), i))), at)
    )


def _spans(text: Column, pattern: str, gate: Column, kind: Callable[[Column, Column], Column], keep) -> Column:
    """Leftmost matches that do not overlap: start, kind, end, value, left (what stands before)."""
    none = F.array().cast(_SPANS)

    def placed(values: Column, between: Column) -> Column:
        lengths = F.transform(values, lambda v, i: F.char_length(F.get(between, i)) + F.char_length(v))

        def span(before: Column) -> Column:
            def one(value: Column, i: Column) -> Column:
                piece = F.get(between, i)
                start = F.get(before, i) + F.char_length(piece)
                window = F.right(F.concat(F.lit(" "), piece), F.lit(REACH))
                return F.struct(
                    start.alias("start"),
                    kind(value, F.get(between, i + 1)).alias("kind"),
                    (start + F.char_length(value)).alias("end"),
                    value.alias("value"),
                    context(window).alias("left"),
                    window.rlike(r"[\x20\x09-\x0D]\z").alias("spaced"),
                )

            return F.transform(values, one)

        return F.filter(_let(_let(lengths, _sums), span), keep)

    found = F.when(gate, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return _let(
        found,
        lambda values: F.when(F.size(values) == 0, none).otherwise(
            _let(F.split(text, pattern, -1), lambda between: placed(values, between))
        ),
    )


def context(window: Column) -> Column:
    """The last two words of what stands before a match, in lower case; empty if there are not two."""
    gap = r"[\x20\x09-\x0D]"
    two = F.regexp_extract(window, rf"{gap}([^\x20\x09-\x0D]+{gap}+[^\x20\x09-\x0D]+){gap}*+\z", 1)
    return F.lower(F.regexp_replace(two, f"{gap}+", " "))


def digits(value: Column) -> Column:
    return F.translate(value, "+ ().-", "")


def luhn(number: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    doubled = F.translate(number, "0123456789", "0246813579")
    size = F.char_length(number)
    total = F.aggregate(
        F.sequence(F.lit(1), size),
        F.lit(0),
        lambda a, i: a
        + F.substring(F.when((size - i) % 2 == 0, number).otherwise(doubled), i, F.lit(1)).cast("int"),
    )
    return total % 10 == 0


def _is_card(value: Column) -> Column:
    number = value.rlike(r"\A[0-9\x20-]++\z") & _between(value, 12, 19)
    return F.when(number, luhn(digits(value))).otherwise(False)


def _between(value: Column, least: int, most: int) -> Column:
    return F.char_length(digits(value)).between(least, most)


def base_spans(text: Column) -> Column:
    """Spans of the four stated forms, each kind by itself, by start and kind."""
    has_digit = text.rlike("[0-9]")
    checks = (
        (F.contains(text, F.lit("@")), lambda s: F.lit(True)),
        (has_digit, lambda s: s["value"].rlike(BYTES)),
        (has_digit, lambda s: _is_card(s["value"])),
        (F.contains(text, F.lit("+")), lambda s: _between(s["value"], 9, 15)),
    )
    parts = [
        _spans(text, form, gate, lambda v, rest, k=k: F.lit(k), keep)
        for k, (form, (gate, keep)) in enumerate(zip(FORMS, checks, strict=True))
    ]
    return F.array_sort(F.concat(*parts))


# Kinds that an instance may be of, as bits.
_BITS = tuple(1 << k for k in range(4))


def _possible(value: Column, rest: Column) -> Column:
    """Bits of the kinds that a string may be of; 0 if it has a stated form or goes on behind."""
    address = value.rlike(r"@|\((?i:at)\)|\[(?i:at)\]")
    number = value.rlike(r"\A[0-9]")
    stated = (
        value.rlike(rf"\A[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++\z")
        | value.startswith("+")
        | value.rlike(BYTES)
        | _is_card(value)
    )
    sized = F.when(_between(value, 12, 19), _BITS[CARD]).otherwise(0) + F.when(
        _between(value, 7, 15), _BITS[PHONE]
    ).otherwise(0)
    bits = (
        F.when(stated | rest.rlike(r"\A[A-Za-z0-9]"), 0)
        .when(address, _BITS[EMAIL])
        .when(F.contains(value, F.lit(":")), _BITS[IP])
        .when(number, sized)
        .otherwise(0)
    )
    return bits.cast("int")


def instances(text: Column) -> Column:
    """Strings that look like identifiers and have no stated form; ``kind`` holds bits of kinds."""
    gate = text.rlike(r"[0-9@]|\(at\)|\[at\]|:")
    return _spans(text, LIKE, gate, _possible, lambda s: s["kind"] > 0)


def _name(value: Column) -> Column:
    """What stands for an identifier: in lower case, numbers without their separators."""
    return F.when(value.rlike(r"\A[+0-9][0-9\x20().-]*+\z"), digits(value)).otherwise(F.lower(value))


# --- the graph --------------------------------------------------------------------------------


def _graph(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (left, kind, name, seed), one row each, and per pattern what follows its words."""

    def occurrences(column: str, bits: Column, seed: bool) -> DataFrame:
        each = rows.select(F.explode(column).alias("s")).where(F.col("s.left") != "")
        return each.select(
            F.col("s.left").alias("left"),
            bits.alias("bits"),
            _name(F.col("s.value")).alias("name"),
            F.lit(seed).alias("seed"),
            F.col("s.spaced").cast("bigint").alias("spaced"),
        )

    shift = F.expr("shiftleft(1, s.kind)")
    both = occurrences("base", shift, True).unionByName(occurrences("like", F.col("s.kind"), False))
    # Pre-aggregated: a name or a word pair of very many occurrences is a row for each other side.
    pairs = both.groupBy("left", "name", "bits", "seed").agg(F.sum("spaced").alias("followed"))
    pairs = common.written(pairs, "pii-pairs")
    kinds = F.filter(F.array(*[F.lit(k) for k in range(4)]), lambda k: F.getbit("bits", k) == 1)
    lefts = pairs.groupBy("left").agg(
        F.count_distinct("name").alias("names"), F.sum("followed").alias("followed")
    )
    patterns = settle(lefts.where(F.col("names") >= SUPPORT))
    # Of these, those that can be trusted for a kind if nothing else follows their words, and that have an
    # instance of the kind to find: no other pattern can change a result.
    per_kind = join_measured(pairs, patterns, "left", "inner")
    per_kind = per_kind.select("left", "names", F.explode(kinds).alias("kind"), "name", "seed")
    per_kind = per_kind.groupBy("left", "kind", "names").agg(
        F.count_distinct("name").alias("n"), F.count(F.when(~F.col("seed"), 1)).alias("unseen")
    )
    useful = (F.col("n") >= SUPPORT * TRUSTED) & (F.col("n") >= TRUSTED * F.col("names")) & (F.col("unseen") > 0)
    useful = per_kind.where(useful).select("left").distinct()
    patterns = settle(join_measured(patterns, useful, "left", "left_semi"))
    edges = join_measured(pairs, patterns.select("left"), "left", "inner")
    edges = edges.select("left", F.explode(kinds).alias("kind"), "name", "seed")
    edges = edges.groupBy("left", "kind", "name").agg(F.max("seed").alias("seed"))
    return common.written(edges, "pii-edges"), patterns


def _occurrences_of(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """How often the words of each pattern stand in the corpus (left, n)."""
    words = common.words(F.lower("text"))
    n = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = _let(
        words,
        lambda w: F.zip_with(
            F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))),
            F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))),
            lambda a, b: F.concat(a, F.lit(" "), b),
        ),
    )
    each = docs.where(n > 0).select(F.explode(pairs).alias("left"))
    each = join_measured(each, patterns.select("left"), "left", "inner")
    return each.groupBy("left").agg(F.count("*").alias("n"))


def scores(edges: DataFrame, patterns: DataFrame, turns: int = TURNS) -> tuple[DataFrame, DataFrame]:
    """Trusted patterns (left, kind, score) and trusted instances (kind, name, score) after some turns.

    ``patterns`` has left and ``follows``, the number of different things that follow its words. A
    pattern's score for a kind is the sum of the scores of its instances over that number; an
    instance's is 1 - product (1 - score) over its trusted patterns; seeds have 1 and keep it.
    """
    seeded = F.col("seed").cast("double").alias("score")
    scored = edges.select("left", "kind", "name", "seed", seeded)
    trusted = found = None
    for _ in range(turns):
        sums = scored.groupBy("left", "kind").agg(F.sum("score").alias("weight"))
        sums = join_measured(sums, patterns.select("left", "follows"), "left", "inner")
        score = (F.col("weight") / F.col("follows")).alias("score")
        kept = sums.where((F.col("weight") >= SUPPORT * TRUSTED) & (F.col("weight") >= TRUSTED * F.col("follows")))
        trusted = settle(kept.select("left", "kind", F.least(score, F.lit(1.0)).alias("score")))
        unseen = join_measured(edges.where(~F.col("seed")), trusted, ["left", "kind"], "inner")
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))))
        found = unseen.groupBy("kind", "name").agg((1 - doubt).alias("score"))
        found = settle(found.where(F.col("score") >= TRUSTED))
        again = join_measured(edges, found.withColumnRenamed("score", "now"), ["kind", "name"], "left")
        now = F.when(F.col("seed"), 1.0).otherwise(F.coalesce("now", F.lit(0.0)))
        scored = again.select("left", "kind", "name", "seed", now.alias("score"))
    return trusted, found


# --- documents --------------------------------------------------------------------------------


def find(docs: DataFrame) -> DataFrame:
    """All documents with ``base`` and ``added``: arrays of start, kind (place in ``KINDS``), end.

    Places are code points, the end exclusive. ``base`` holds the stated forms, each kind's leftmost
    matches that pass its check, by start and kind; kinds may overlap each other. ``added`` holds the
    instances that trusted patterns have found, none of which overlaps one of ``base``; where an instance
    is trusted as two kinds, the higher score counts, then the first of ``KINDS``. NULL and
    empty texts have no spans. Texts are searched whole. Repeated rows and copies have the same
    spans each, and count as one instance in the graph; their words count each. Other columns pass
    through but ``text``; those named ``base`` or ``added`` are replaced. An empty table gives no rows.
    """
    docs = common.spare(docs, "base", "added")
    text = F.coalesce("text", F.lit(""))
    narrow = [c for c in docs.columns if c.lower() != "text"]
    own = F.struct(*narrow).alias("own")
    rows = docs.select(own, base_spans(text).alias("base"), instances(text).alias("like"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = common.written(rows, "pii-spans")

    edges, patterns = _graph(rows)
    counted = _occurrences_of(docs, patterns)
    bare = F.greatest(F.coalesce("n", F.lit(0)) - F.col("followed"), F.lit(0))
    patterns = settle(
        join_measured(patterns, counted, "left", "left").select("left", (F.col("names") + bare).alias("follows"))
    )
    _, found = scores(edges, patterns)
    best = F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind")
    kinds = found.groupBy("name").agg(best)

    each = rows.where(F.size("like") > 0).select("row", F.explode("like").alias("s"))
    each = each.select("row", "s.start", "s.end", _name(F.col("s.value")).alias("name"))
    hits = join_measured(each, kinds, "name", "inner")
    span = F.struct(F.col("start"), F.col("kind"), F.col("end"))
    added = hits.groupBy("row").agg(F.collect_list(span).alias("more"))
    joined = join_measured(rows.drop("like"), added, "row", "left")
    slim = "array<struct<start:int,kind:int,end:int>>"
    base = F.transform("base", lambda s: F.struct(s["start"], s["kind"], s["end"])).cast(slim)
    free = F.filter(
        F.coalesce("more", F.array().cast(slim)),
        lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])),
    )
    return joined.select("own.*", base.alias("base"), F.array_sort(free).cast(slim).alias("added"))


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined, in the order given."""
    names = F.array(*[F.lit(k) for k in KINDS])
    parts = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"]))
    return F.array_join(parts, ",")


# --- the registered query ---------------------------------------------------------------------


def _count(kind: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind))


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.read(spark, folder, "documents").select("doc_id", "text")
    found = find(docs)
    counts = [_count(k).cast("bigint").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    everything = F.array_sort(F.concat("base", "added"))
    return found.select(
        "doc_id",
        *counts,
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(everything).alias("spans"),
    )
