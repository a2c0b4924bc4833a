"""Personal data by weak supervision, in DataFrame functions only.

Candidate spans come from strict patterns (kept as they are: ``BASE``) and from
loose ones that also match what people write to dodge the strict ones
(``name [at] host dot com``, ``1[.]2[.]3[.]4``, national phone numbers, dotted
card groups). Labelers vote yes, no or abstain on every candidate: the shape, a
checksum, a gazetteer (top-level domains, calling prefixes, issuer digits,
reserved networks) and the words to the left and right. Expectation maximisation
over the counts of vote patterns estimates how reliable each labeler is per kind
and how likely each pattern is a true span; a logistic regression on the votes and
on span features is trained on those probabilities and decides about the loose
spans.

No pattern matches a line break, none backtracks over a run twice (runs are
possessive and start where the run starts), and what compares spans with each other
is one pass over them sorted (``running``), so the time is about linear in the text.
Patterns, labelers and the span classifier run per row in one pass; only vote
pattern counts, at most 4 * 3 * 3^5 * 6 rows whatever the input, are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

KINDS = ("email", "ip", "card", "phone")
OPEN, CLOSE, OTHER = "\uE000", "\uE001", "\uE002"

#: Strict patterns, written so that Java finds the same leftmost matches without
#: trying a run of word characters from each of its positions.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+\x20?(?:@|[\[({]\x20?(?:at|AT|@)\x20?[\])}])"
             r"\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.(?!\x20)|[\[({]\x20?(?:dot|DOT|\.)\x20?[\])}]|(?<=\x20)(?:dot|DOT)(?=\x20))\x20?[A-Za-z0-9-]{1,63}+){1,6}+"
             r"|(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+\x20(?:at|AT)\x20[A-Za-z0-9-]{1,63}+(?:\x20(?:dot|DOT)\x20[A-Za-z0-9-]{1,63}+){1,6}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)|\x20\.\x20)[0-9]{1,3}){3}(?![0-9.])",
    "card": r"(?<![0-9./_-])[0-9]{4}(?:[./_]|\x20-\x20|\x20{2})[0-9]{4}(?:[./_]|\x20-\x20|\x20{2})[0-9]{4}(?:[./_]|\x20-\x20|\x20{2})[0-9]{4}(?![0-9./_-])",
    "phone": r"(?<![0-9A-Za-z+.,/-])(?:00[1-9][0-9]{0,2}[\x20.-]?)?\(?[0-9]{2,4}\)?[\x20.-]{1,2}[0-9]{3,4}[\x20.-][0-9]{3,5}(?![0-9A-Za-z.-])",
}
CONTEXT_CHARS = 32
#: Masked texts are read in chunks of so many code points.
CHUNK_CHARS = 1024

# Gazetteers and cue words of the labelers.
TOP_LEVEL = ("com org net edu gov mil int info biz io co me app dev name eu uk us ca au nz de at ch fr be nl lu es pt it gr "
             "se no dk fi is ie pl cz sk hu ro bg hr si rs ua ru tr il in cn jp kr tw hk sg my th vn id ph br mx ar cl pe za "
             "ng ke eg ma")
CUES = {
    "email": "mail contact kontakt correo courriel write schreib reach",
    "ip": "ip host server address adresse login client addr",
    "card": "card karte tarjeta carte visa mastercard amex credit kredit payment",
    "phone": "phone call tel telefon mobile fax cell dial whatsapp sms ring number",
}
AGAINST = {
    "email": "price costs",
    "ip": "version release section chapter v",
    "card": "isbn order serial token hash id",
    "phone": "isbn version date order serial no nr",
}
LABELERS = ("shape", "checksum", "gazetteer", "left", "right")
ROUNDS = 20
#: What a labeler is taken to do before any data: chance of a no, nothing and a yes
#: about a true span (a false one: in reverse), worth as many spans as PRIOR_SPANS.
PRIOR_VOTES = {-1: 0.1, 0: 0.4, 1: 0.5}
PRIOR_SPANS = 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array of longs by an associative function: in blocks of the square
    root of their number, as an array grows by a copy of itself."""
    def total(v: Column) -> Column:
        return F.aggregate(v, F.array().cast("array<bigint>"), lambda a, x: F.concat(
            a, F.array(F.coalesce(combine(F.try_element_at(a, F.lit(-1)), x), x))))

    def joined(parts: Column) -> Column:
        return let(total(F.transform(parts, lambda p: F.element_at(p, -1))), lambda ends: F.flatten(F.transform(
            parts, lambda p, i: F.when(i == 0, p).otherwise(F.transform(p, lambda x: combine(F.element_at(ends, F.greatest(i, F.lit(1))), x))))))

    def blocks(v: Column) -> Column:
        return let(F.ceil(F.sqrt(F.size(v))).cast("int"), lambda size: let(F.transform(
            F.sequence(F.lit(0), F.floor((F.size(v) - 1) / size).cast("int")), lambda b: total(F.slice(v, b * size + 1, size))), joined))

    return let(values, lambda v: F.when(F.size(v) > 0, blocks(v)).otherwise(v))


def spans(text: Column, pattern: str) -> Column:
    """Array of struct(start, stop, found, left, right) of the leftmost matches;
    positions in code points, ``left`` and ``right`` the text next to the match as
    far as the neighbouring matches, ``CONTEXT_CHARS`` at most."""
    marked = F.split(F.regexp_replace(text, pattern, OPEN + "$0" + CLOSE), OPEN)
    pieces = lambda parts: F.transform(parts, lambda p, i: F.struct(
        F.when(i == 0, F.lit("")).otherwise(F.substring_index(p, CLOSE, 1)).alias("found"),
        F.substring_index(p, CLOSE, -1).alias("rest")))

    def located(parts: Column) -> Column:
        lengths = F.transform(parts, lambda p: (F.length(p["found"]) + F.length(p["rest"])).cast("long"))

        def with_ends(ends: Column) -> Column:
            def one(p: Column, i: Column) -> Column:  # i of the piece before
                start = F.element_at(ends, i + 1)
                return F.struct(start.alias("start"), (start + F.length(p["found"])).alias("stop"), p["found"].alias("found"),
                                F.right(F.element_at(parts, i + 1)["rest"], F.lit(CONTEXT_CHARS)).alias("left"),
                                F.left(p["rest"], F.lit(CONTEXT_CHARS)).alias("right"))

            return F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), one)

        return let(running(lengths, lambda a, b: a + b), with_ends)

    return let(marked, lambda parts: F.when(F.size(parts) > 1, let(pieces(parts), located)))


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(number)
    digit = lambda i: F.ascii(F.substr(number, n - i + 1, F.lit(1))) - 48  # noqa: E731  the i-th from the right
    worth = lambda i: F.when(i % 2 == 1, digit(i)).otherwise(2 * digit(i) - F.when(digit(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + worth(i)) % 10 == 0


def valid(kind: str, found: Column) -> Column:
    """The test that a strict match of the kind must pass."""
    if kind == "ip":
        return F.forall(F.split(found, "[.]"), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})?$"))
    n = F.length(digits(found))
    if kind == "card":
        return n.between(13, 19) & F.when(n.between(13, 19), luhn(digits(found))).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


#: A cheap test that a text can hold a match at all.
MAY = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9]"),
    "phone": lambda t: t.contains("+"),
}
MAY_LOOSE = {
    "email": lambda t: t.rlike(r"[\[({@]|\x20(?:dot|DOT)\x20"),
    "ip": lambda t: t.rlike(r"[0-9](?:\[|\(|\x20\.)"),
    "card": lambda t: t.rlike(r"[0-9]{4}(?:[./_]|\x20-\x20|\x20\x20)[0-9]{4}"),
    "phone": lambda t: t.rlike(r"[0-9]\)?[\x20.-]{1,2}[0-9]{3}"),
}
_SPAN = "array<struct<start:bigint,stop:bigint,found:string,left:string,right:string>>"


def _found(text: Column, kind: str, patterns: dict, may: dict) -> Column:
    none = F.array().cast(_SPAN)
    return F.coalesce(F.when(may[kind](text), spans(text, patterns[kind])), none)


def clean(text: Column) -> Column:
    """Null as empty; the two characters that mark matches become a third, so positions stay."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t.contains(OPEN) | t.contains(CLOSE), F.translate(t, OPEN + CLOSE, OTHER * 2)).otherwise(t)


def _words(text: Column, words: str) -> Column:
    return F.lower(text).rlike(r"(?:^|[^a-z])(?:" + "|".join(words.split()) + r")[a-z]{0,4}[^a-z]*$")


def votes(kind: str, s: Column) -> dict[str, Column]:
    """1 yes, -1 no, 0 abstain of every labeler about one span."""
    found, d = s["found"], digits(s["found"])
    n = F.length(d)
    yes, no, none = F.lit(1), F.lit(-1), F.lit(0)
    if kind == "email":
        shape = F.when(found.rlike(r"[@\[({]"), yes).when(found.rlike(r"(?i)\x20at\x20.*\x20dot\x20"), none).otherwise(no)
        checksum = F.when(found.rlike(r"^[._%+-]|\.\.|[0-9.]+$"), no).otherwise(none)
        last = F.lower(F.regexp_extract(found, r"([A-Za-z0-9-]+)$", 1))
        gazetteer = F.when(last.isin(*TOP_LEVEL.split()), yes).otherwise(no)
    elif kind == "ip":
        parts = F.split(F.trim(F.regexp_replace(found, "[^0-9]+", " ")), " ")
        shape = F.when(found.contains(" "), no).otherwise(yes)
        checksum = F.when(F.forall(parts, lambda p: p.rlike("^(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$")), yes).otherwise(no)
        gazetteer = F.when(F.element_at(parts, 1).isin("0", "127", "255"), no).otherwise(none)
    elif kind == "card":
        shape = F.when(found.rlike(r"^[0-9]+$|^([0-9]{4})(\D+)[0-9]{4}\2[0-9]{4}\2[0-9]{4}$"), yes).otherwise(no)
        checksum = F.when(luhn(d), yes).otherwise(no)
        gazetteer = F.when(d.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|62)"), yes).otherwise(no)
    else:
        shape = F.when(found.rlike(r"^\+|^00|\(|^[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}$"), yes).otherwise(no)
        checksum = F.when(~n.between(9, 15) | found.rlike(r"^(?:19|20)[0-9]{2}[ .-]|^97[89]"), no).otherwise(yes)
        gazetteer = F.when(found.rlike(r"^(?:\+|00)[1-9]"), yes).when(found.rlike(r"^\(?0?[2-9]"), none).otherwise(no)
    left = F.when(_words(s["left"], CUES[kind]), yes).when(_words(s["left"], AGAINST[kind]), no).otherwise(none)
    right = F.when(F.lower(s["right"]).rlike(r"^\s?(?:%|px\b|kg\b|km\b|cm\b|mm\b|eur\b|usd\b|=|\()"), no).otherwise(none)
    return dict(zip(LABELERS, (shape, checksum, gazetteer, left, right)))


def found_spans(text: Column) -> Column:
    """Struct of ``base``, the valid strict spans, ``failed``, strict matches that
    fail their test, and ``loose``, the matches of the loose patterns."""
    def of(kind: str, patterns: dict, may: dict) -> Column:
        return F.transform(_found(text, kind, patterns, may), lambda s: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), *[s[c].alias(c) for c in ("start", "stop", "found", "left", "right")]))

    def strict(kind: str) -> Column:
        return F.transform(of(kind, BASE, MAY), lambda s: s.withField("valid", valid(kind, s["found"])))

    def split(every: Column) -> Column:
        def near(s: Column) -> Column:  # not just a number, nor groups of four digits
            return (F.when(s["kind"] == KINDS.index("card"), F.length(digits(s["found"])) >= 13)
                    .when(s["kind"] == KINDS.index("ip"), s["found"].rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$")).otherwise(True))

        return F.struct(F.filter(every, lambda s: s["valid"]).alias("base"), F.filter(every, lambda s: ~s["valid"] & near(s)).alias("failed"))

    return F.struct(let(F.flatten(F.array(*map(strict, KINDS))), split).alias("strict"),
                    F.flatten(F.array(*[of(k, LOOSE, MAY_LOOSE) for k in KINDS])).alias("loose"))


def described(s: Column) -> Column:
    """A span with its votes and features in place of its text."""
    def of(kind: str) -> Column:
        return F.struct(*[v.cast("int").alias(k) for k, v in votes(kind, s).items()])

    by_kind = reduce(lambda rest, k: F.when(s["kind"] == k, of(KINDS[k])).otherwise(rest), range(len(KINDS) - 1), of(KINDS[-1]))
    return F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), by_kind.alias("votes"),
        F.when(s["stop"] - s["start"] < 16, 0).when(s["stop"] - s["start"] < 24, 1).otherwise(2).alias("long"),
        (F.right(s["left"], F.lit(1)).rlike("[A-Za-z0-9]") | F.left(s["right"], F.lit(1)).rlike("[A-Za-z0-9]")).cast("int").alias("glued"))


def candidates(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with ``_base``, ``_failed`` and ``_loose`` (loose spans that touch no
    strict match): arrays of (kind, start, stop, votes, long, glued)."""
    out = docs.withColumn("_clean", clean(F.col(f"`{text_col}`"))).withColumn("_both", found_spans(F.col("_clean")))
    fields = ("kind", "start", "stop", "found", "left", "right")
    one = lambda s: F.struct(*[s[c].alias(c) for c in fields])

    def apart(strict: Column, loose: Column) -> Column:
        """The loose spans that touch no strict one: of those that start before a span stops,
        none stops after it starts. One pass over starts of strict and stops of loose spans."""
        events = F.sort_array(F.concat(
            F.transform(loose, lambda s: F.struct(s["stop"].alias("at"), F.lit(0).alias("strict"), F.lit(0).cast("long").alias("to"), one(s).alias("span"))),
            F.transform(strict, lambda s: F.struct(s["start"].alias("at"), F.lit(1).alias("strict"), s["stop"].alias("to"), one(s).alias("span")))))
        free = lambda e: let(running(F.transform(e, lambda x: x["to"]), F.greatest), lambda reach: F.filter(
            e, lambda x, i: (x["strict"] == 0) & (F.element_at(reach, i + 1) <= x["span"]["start"])))
        return F.when((F.size(strict) > 0) & (F.size(loose) > 0), F.transform(let(events, free), lambda x: x["span"])).otherwise(F.transform(loose, one))

    apart = apart(F.concat(F.transform("_both.strict.base", one), F.transform("_both.strict.failed", one)), F.col("_both.loose"))
    return (out.withColumn("_base", F.transform("_both.strict.base", described))
            .withColumn("_failed", F.transform("_both.strict.failed", described))
            .withColumn("_loose", F.transform(apart, described)).drop("_both", "_clean"))


def vote_counts(found: DataFrame) -> DataFrame:
    """Candidates by kind, origin (1 strict and valid, -1 strict and failed, 0 loose),
    votes and features: a bounded table, summed before the shuffle."""
    def of(name: str, origin: int) -> Column:
        return F.transform(name, lambda s: s.withField("origin", F.lit(origin)))

    return (found.select(F.explode(F.concat(of("_base", 1), of("_failed", -1), of("_loose", 0))).alias("s"))
            .groupBy("s.kind", "s.origin", *[F.col(f"s.votes.{k}").alias(k) for k in LABELERS], F.col("s.long").alias("long"), F.col("s.glued").alias("glued"))
            .agg(F.count("*").alias("n")))


def reliabilities(counts: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Expectation maximisation over vote pattern counts, per kind.

    Strict spans are known, true if valid and false if failed, and show how
    reliable each labeler is; the truth of loose spans is estimated. Returns the counts with ``truth``, the probability that such a span is true, and
    per kind ``share``, that of loose spans, and ``weight``: by labeler and vote (no,
    nothing, yes) the logarithm of how much likelier a true span gets that vote than
    a false one. The first guess is the majority of the votes; the prior keeps rare
    kinds sensible and every chance between 0 and 1. One array holds the patterns of
    a kind (a bounded number), and the rounds are an aggregate over it.
    """
    cells = F.array(*[F.lit(3 * k + 2) + F.col(name) for k, name in enumerate(LABELERS)])  # of 1 to 15, as votes are -1 to 1
    by_kind = counts.groupBy("kind").agg(F.collect_list(F.struct(
        F.col("n").cast("double").alias("n"), "origin", cells.alias("cells"), *LABELERS, "long", "glued")).alias("patterns"))
    size = 3 * len(LABELERS)

    def chance(p: Column, state: Column) -> Column:
        odds = F.aggregate(p["cells"], state["bias"], lambda a, c: a + F.element_at(state["weight"], c))
        return F.when(p["origin"] == 0, 1 / (1 + F.exp(-odds))).otherwise((p["origin"] + 1) / 2)

    def maximise(parts: Column) -> Column:
        """parts: (yes, no, cells, loose) of each pattern."""
        def total(of: Column, field: str) -> Column:
            return F.aggregate(of, F.lit(0.0), lambda a, p: a + p[field])

        def weight(c: Column, yes: Column, no: Column) -> Column:
            own = F.filter(parts, lambda p: F.array_contains(p["cells"], c))
            prior = F.array(*[F.lit(PRIOR_SPANS * PRIOR_VOTES[v]) for v in (-1, 0, 1)])
            at = (c - 1) % 3
            return (F.log((total(own, "yes") + F.element_at(prior, at + 1)) / (yes + PRIOR_SPANS))
                    - F.log((total(own, "no") + F.element_at(prior, 3 - at)) / (no + PRIOR_SPANS)))

        loose = F.filter(parts, lambda p: p["loose"])
        return let(F.struct(total(parts, "yes").alias("yes"), total(parts, "no").alias("no")), lambda t: F.struct(
            F.log((total(loose, "yes") + 1) / (total(loose, "no") + 1)).alias("bias"),
            F.transform(F.sequence(F.lit(1), F.lit(size)), lambda c: weight(c, t["yes"], t["no"])).alias("weight")))

    def step(state: Column, _: Column) -> Column:
        parts = F.transform("patterns", lambda p: let(chance(p, state), lambda c: F.struct(
            (p["n"] * c).alias("yes"), (p["n"] * (1 - c)).alias("no"), p["cells"].alias("cells"), (p["origin"] == 0).alias("loose"))))
        return let(parts, maximise)

    guess = F.struct(F.lit(0.0).alias("bias"), F.array(*[F.lit(1.5 * v) for _ in LABELERS for v in (-1, 0, 1)]).alias("weight"))
    fitted = by_kind.withColumn("state", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), guess, step))
    known = F.transform("patterns", lambda p: p.withField("truth", chance(p, F.col("state"))))
    return fitted.select("kind", (1 / (1 + F.exp(-F.col("state.bias")))).alias("share"), F.col("state.weight").alias("weight"),
                         F.explode(known).alias("p")).select(
        "kind", "share", "weight", "p.origin", *[F.col(f"p.{k}").alias(k) for k in LABELERS], "p.long", "p.glued", F.col("p.n").cast("long").alias("n"), "p.truth")


def _features(kind: Column, votes_of: Callable[[str], Column], long: Column, glued: Column) -> list[Column]:
    one_hot = [((kind == k) & (votes_of(name) == v)).cast("double") for k in range(len(KINDS)) for name in LABELERS for v in (-1, 1)]
    return [*one_hot, *[(kind == k).cast("double") for k in range(1, len(KINDS))], (long == 1).cast("double"),
            (long == 2).cast("double"), glued.cast("double")]


def span_classifier(labeled: DataFrame) -> list[float] | None:
    """Intercept and weights of a logistic regression on votes and features; None
    without candidates.

    A vote pattern counts with its probability, and with the square root of its
    count, so that the strict spans, nearly all of the data, don't drown the rest.
    Imagined spans of each kind on which all labelers agree anchor both ends."""
    if labeled.isEmpty():
        return None
    agreed = labeled.sparkSession.range(len(KINDS)).select(
        F.col("id").cast("int").alias("kind"), F.explode(F.array(F.lit(-1), F.lit(1))).alias("v")).select(
        "kind", *[F.col("v").alias(k) for k in LABELERS], F.lit(0).alias("long"), F.lit(0).alias("glued"),
        F.lit(PRIOR_SPANS).cast("long").alias("n"), (F.col("v") > 0).cast("double").alias("truth"))
    cols = _features(F.col("kind"), F.col, F.col("long"), F.col("glued"))
    flat = labeled.select(*agreed.columns).union(agreed).select(*[c.alias(f"f{i}") for i, c in enumerate(cols)], "n", "truth")
    rows = flat.withColumn("label", F.explode(F.array(F.lit(0.0), F.lit(1.0)))).withColumn(
        "weight", F.sqrt("n") * F.when(F.col("label") == 1, F.col("truth")).otherwise(1 - F.col("truth"))).filter("weight > 0").coalesce(1)
    ready = VectorAssembler(inputCols=[f"f{i}" for i in range(len(cols))], outputCol="features").transform(rows)
    model = LogisticRegression(weightCol="weight", regParam=1e-3, maxIter=30, standardization=False).fit(ready)
    return [float(model.intercept), *map(float, model.coefficients)]


def fit(found: DataFrame) -> list[float] | None:
    """Reliabilities and span classifier of a table with ``_base`` and ``_loose``."""
    from ..operators.common import materialize
    counts = materialize(vote_counts(found), "votes").coalesce(1)  # bounded: see the module's docstring
    return span_classifier(materialize(reliabilities(counts), "votes"))


def accepted(weights: list[float] | None) -> Column:
    """The loose spans that the classifier takes, without those that overlap an earlier one."""
    if weights is None:
        return F.slice(F.col("_loose"), F.lit(1), F.lit(0))

    def chance(s: Column) -> Column:
        cols = _features(s["kind"], lambda k: s["votes"][k], s["long"], s["glued"])
        return reduce(lambda a, b: a + b, [c * w for c, w in zip(cols, weights[1:])], F.lit(weights[0]))

    good = F.sort_array(F.transform(F.filter("_loose", lambda s: chance(s) >= 0), lambda s: F.struct(
        s["start"].alias("start"), (-s["stop"]).alias("less"), s["kind"].alias("kind"), s.alias("span"))))
    first = let(good, lambda g: let(running(F.transform(g, lambda x: -x["less"]), F.greatest), lambda reach: F.filter(
        g, lambda x, i: (i == 0) | (F.element_at(reach, F.greatest(i, F.lit(1))) <= x["start"]))))
    return F.when(F.size("_loose") > 0, F.transform(first, lambda x: x["span"])).otherwise(F.col("_loose"))


def _listed(spans_: Column) -> Column:
    """kind:start:stop by kind, then start, comma-joined."""
    ordered = F.sort_array(F.transform(spans_, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))))
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"], s["stop"])), ",")


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, counts and digest of the strict spans, and all
    spans. Null and empty texts have none. The texts are read twice, once to count
    votes and once to decide; nothing but vote counts is shuffled."""
    found = candidates(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text")
    weights = fit(found)

    def count(k: int) -> Column:
        return F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    n = map(count, range(len(KINDS)))
    return found.select("doc_id", *n, F.sha2(_listed(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
                        _listed(F.concat("_base", accepted(weights))).alias("spans"))


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs``, all rows and columns, with every span replaced by its kind in angle
    brackets (``<EMAIL>``); spans that overlap become one. Other texts, null
    included, stay as they are."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    held = docs.select(F.struct(*own).alias("_row"), F.col(f"`{text_col}`").alias("_text"))
    found = candidates(held, "_text")
    weights = fit(candidates(held.select("_text"), "_text"))
    ordered = F.sort_array(F.transform(F.concat("_base", accepted(weights)), lambda s: F.struct(
        s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    found = found.withColumn("_spans", ordered).withColumn("_n", F.size("_spans"))
    # a span that starts before an earlier one stops joins it
    reach = running(F.transform("_spans", lambda s: s["stop"]), F.greatest)
    label = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    # the text in chunks, as a place in a long text is found by reading up to it
    chunks = F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{CHUNK_CHARS}}}"), F.lit(0))
    found = found.withColumn("_reach", F.when(F.col("_n") > 0, reach)).withColumn("_chunks", F.when(F.col("_n") > 0, chunks))

    def between(start: Column, stop: Column) -> Column:
        """The text from one place to another that isn't before it."""
        first, last = (F.floor(x / CHUNK_CHARS).cast("int") for x in (start, stop))
        return F.substr(F.array_join(F.slice("_chunks", first + 1, last - first + 1), ""), start - first * CHUNK_CHARS + 1, stop - start)

    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.element_at("_reach", F.greatest(i, F.lit(1)))).cast("int")
    piece = F.transform("_spans", lambda s, i: F.when(s["start"] >= before(i), F.concat(
        between(before(i), s["start"].cast("int")), F.element_at(label, s["kind"] + 1))).otherwise(""))
    last = F.element_at("_reach", -1).cast("int")
    masked = F.when(F.col("_n") > 0, F.concat(F.array_join(piece, ""), F.substr(F.col("_text"), last + 1, F.length("_text")))).otherwise(
        F.col("_text"))
    return found.select(*[(masked if c == text_col else F.col("_row").getField(c)).alias(c) for c in docs.columns])
