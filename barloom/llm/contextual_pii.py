"""Personal data: strict patterns give seeds, their contexts give lexical patterns, and
patterns that nearly always hold identifiers find others which no strict pattern matches.

DataFrame functions only. A regular expression cuts a text into what it matches and what lies between, so
places are running sums of lengths, and the words around a match are at the edges of its neighbours.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.tables import discard, looked_up, saved

KINDS = ("email", "ip", "card", "phone")
#: The strict forms. Possessive runs and starts at the edge of a run (or of the match before) find the
#: same matches as the plain forms, in time that grows with the text and not its square.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text with any match holds, of any form; and what it holds for a strict form to match.
ANY_HINT = "[0-9@]"
HINT = {
    "email": "@",
    "ip": r"[0-9]\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){15}",
    "phone": r"\+[0-9]",
}
#: Anything that might identify somebody: a token with @, groups of hex digits between
#: colons with a decimal one among them, digits with up to two separators between them.
LOOSE = (
    r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)*+"
    r"|(?<![0-9A-Za-z:])(?=[A-Fa-f:]*[0-9])[0-9A-Fa-f]{1,4}(?:::?[0-9A-Fa-f]{1,4}){2,7}+"
    r"|(?<![0-9])[0-9]++(?:[().:/\x20-]{1,2}[0-9]++)*+"
)
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
#: Code points on either side of a match that may hold words of its context.
CONTEXT = 48
#: Different seeds that a pattern must have seen.
LEAST_SEEDS = 3
#: A pattern counts if it is at least so sure, an identifier is reported if it is.
SURE_PATTERN = 0.6
SURE_IDENTIFIER = 0.8
ROUNDS = 3

_MARKER, _LOOSE = -1, len(KINDS)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Does a string of at most 19 digits pass the Luhn check? Zeros before it change nothing."""
    padded = F.lpad(digits, 19, "0")
    doubled = F.translate(padded, "0123456789", "0246813579")
    places = [F.substring(doubled if (19 - i) % 2 else padded, i, 1).cast("int") for i in range(1, 20)]
    return reduce(lambda a, b: a + b, places) % 10 == 0


def holds(kind: Column, match: Column) -> Column:
    """Does a match of the strict form of a kind (its number) meet what the form cannot say?"""
    digits = _digits(match)
    n = F.length(digits)
    return (
        F.when(kind == 0, F.lit(True))
        .when(kind == 1, match.rlike(rf"^{PART}(?:\.{PART}){{3}}$"))
        .when(kind == 2, F.when(n.between(16, 19), luhn(digits)).otherwise(F.lit(False)))
        .when(kind == 3, n.between(8, 15))
        .otherwise(F.lit(False))
    )


def could_be(match: Column) -> list[Column]:
    """For each kind: might a loose match be one, by its letters and digits alone?"""
    n = F.length(_digits(match))
    number = ~match.contains("@") & ~match.rlike("[A-Fa-f]|::")
    return [
        match.contains("@"),
        ~match.contains("@") & (match.rlike("::|[A-Fa-f]|(?::.*){2}") | match.rlike(r"^[0-9]+(?:\.[0-9]+){3}$")),
        number & n.between(13, 19),
        number & n.between(7, 15),
    ]


_FOUND = "array<struct<kind:int,pos:int,gap:int,match:string,before:string,after:string>>"


def _found(text: Column, kind: int, form: str) -> Column:
    """array(struct(kind, pos, gap, match, before, after)) of the matches in a text."""
    between = F.transform(
        F.split(text, form, -1),
        lambda p: F.struct(F.length(p).alias("gap"), F.right(p, F.lit(CONTEXT)).alias("tail"), F.left(p, F.lit(CONTEXT)).alias("head")),
    )
    pieces = F.array(F.struct(between.alias("between"), F.regexp_extract_all(text, F.lit(form), F.lit(0)).alias("matches")))

    def placed(both: Column) -> Column:
        # piece i lies before match i, the next one behind it
        return F.transform(
            both["matches"],
            lambda m, i: F.struct(
                F.lit(kind).alias("kind"),
                i.alias("pos"),
                F.get(both["between"], i)["gap"].alias("gap"),
                m.alias("match"),
                F.get(both["between"], i)["tail"].alias("before"),
                F.get(both["between"], i + 1)["head"].alias("after"),
            ),
        )

    # a lambda, so that the text is cut once and not for every use of its pieces
    return F.flatten(F.transform(pieces, placed))


def matches(docs: DataFrame) -> DataFrame:
    """(row, doc_id, kind, start, stop, match, before, after): a marker row of kind -1 for every
    text, all strict matches that hold, and the loose ones (kind 4) that meet none of them."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    base = docs.select(F.monotonically_increasing_id().alias("row"), docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"))
    none = F.lit(None).cast("string")
    marker = F.array(
        F.struct(
            F.lit(_MARKER).alias("kind"), F.lit(0).alias("pos"), F.lit(0).alias("gap"), none.alias("match"), none.alias("before"), none.alias("after")
        )
    ).cast(_FOUND)
    nothing = F.array().cast(_FOUND)
    every = [F.when(F.col("text").rlike(HINT[name]), _found(F.col("text"), k, STRICT[name])).otherwise(nothing) for k, name in enumerate(KINDS)]
    found = F.concat(marker, *every, _found(F.col("text"), _LOOSE, LOOSE))
    cut = base.select("row", "doc_id", F.inline(F.when(F.col("text").rlike(ANY_HINT), found).otherwise(marker)))
    hits = saved(cut, "pii-cut")
    one = hits.where(F.col("kind") >= 0).repartition("row")
    length = F.length("match")
    upto = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = one.withColumn("stop", F.sum(F.col("gap") + length).over(upto)).withColumn("start", F.col("stop") - length)
    at = at.withColumn("strict", F.col("kind") < _LOOSE).where(~F.col("strict") | holds(F.col("kind"), F.col("match")))
    # does a strict match reach into a loose one from the left, or begin inside it?
    left = Window.partitionBy("row").orderBy("start", F.desc("strict")).rowsBetween(Window.unboundedPreceding, -1)
    right = Window.partitionBy("row").orderBy(F.desc("start"), "strict").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when(F.col("strict"), F.col("stop"))).over(left)
    begin = F.min(F.when(F.col("strict"), F.col("start"))).over(right)
    at = at.withColumn("reach", reach).withColumn("begin", begin)
    clear = (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("begin") >= F.col("stop"), F.lit(True)))
    columns = ["row", "doc_id", "kind", "start", "stop", "match", "before", "after"]
    blank = [F.lit(None).cast(t).alias(c) for c, t in zip(columns[3:], ("long", "long", "string", "string", "string"))]
    markers = hits.where(F.col("kind") == _MARKER).select("row", "doc_id", "kind", *blank)
    placed = at.where(F.col("strict") | clear).withColumn("start", F.col("start").cast("long")).withColumn("stop", F.col("stop").cast("long"))
    out = saved(markers.union(placed.select(*columns)), "pii-matches")
    discard(hits)
    return out


def edges(found: DataFrame) -> DataFrame:
    """(pattern, name, kind): different identifiers in their different contexts.

    Patterns are the word before, the two words before, the word behind, and both sides. An
    identifier is named by its digits, or by its small letters if it has an @ or a letter.
    """
    word = lambda c, form: F.nullif(F.regexp_extract(F.lower(c), form, 1), F.lit(""))
    near, two = word(F.col("before"), r"(\S+)\s*$"), word(F.col("before"), r"(\S+\s+\S+)\s*$")
    behind = word(F.col("after"), r"^\s*(\S+)")
    forms = F.array(
        F.concat(F.lit("< "), near),
        F.concat(F.lit("<< "), two),
        F.concat(F.lit("> "), behind),
        F.concat(F.lit("<> "), near, F.lit(" "), behind),
    )
    each = found.where(F.col("kind") >= 0).select(F.explode(F.filter(forms, lambda f: f.isNotNull())).alias("pattern"), named().alias("name"), "kind")
    return each.groupBy("pattern", "name", "kind").agg(F.count("*").alias("times"))


def named() -> Column:
    return F.when(F.col("match").rlike("[@A-Za-z]"), F.lower("match")).otherwise(_digits(F.col("match")))


def discover(found: DataFrame, rounds: int = ROUNDS, least_seeds: int = LEAST_SEEDS) -> DataFrame:
    """(name, kind, sure): loose matches that contexts of strict ones vouch for.

    A pattern is as sure of a kind as the share of its identifiers that are of that kind:
    strict ones count fully, loose ones by how sure their own patterns are of them, and all
    other numbers and tokens in the same context count against it. An identifier is as
    sure as its patterns are together. Both are computed in turn, a fixed number of ``rounds``, on the graph
    of different (pattern, identifier) pairs, so repeated texts add no weight. Only patterns with
    ``least_seeds`` different strict ones take part.
    """
    graph = saved(edges(found), "pii-edges")
    seeds = [F.count(F.when(F.col("kind") == k, 1)).alias(str(k)) for k in range(len(KINDS))]
    patterns = graph.groupBy("pattern").agg(F.count("*").alias("total"), *seeds)
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(str(k)).alias("seeds")) for k in range(len(KINDS)))))
    strong = patterns.select("pattern", "total", kinds.alias("k")).select("pattern", "total", "k.kind", "k.seeds").where(F.col("seeds") >= least_seeds)
    strong = strong.withColumn("open", F.concat_ws(" ", "kind", "pattern"))
    strong = saved(strong, "pii-strong")
    # an identifier is named without its separators, so shapes are told from the matches
    shaped = found.where(F.col("kind") == _LOOSE).select(named().alias("name"), F.array(*(F.when(fit, F.lit(k)) for k, fit in enumerate(could_be(F.col("match"))))).alias("fits"))
    shaped = shaped.select("name", F.explode(F.filter("fits", lambda k: k.isNotNull())).alias("as")).distinct()
    loose = graph.where(F.col("kind") == _LOOSE).select("pattern", "name")
    loose = saved(loose.join(shaped, "name").select(F.concat_ws(" ", "as", "pattern").alias("open"), F.concat_ws(" ", "as", "name").alias("who"), "as", "name"), "pii-loose")
    by_open = loose.groupBy("open").agg(F.count("*").alias("held"))
    live = strong.join(by_open, "open").select("open", "held", "total", "seeds")
    live = saved(live, "pii-live")
    near = saved(
        looked_up(loose, live.select("open", "held", F.lit(True).alias("live")), "open", "held").where("live").select("open", "who", "as", "name"), "pii-near"
    )
    sure = None
    for _ in range(rounds):
        state = live.withColumn("extra", F.lit(0.0))
        if sure is not None:
            who = near.groupBy("who").agg(F.count("*").alias("held")).join(sure.select("who", "sure"), "who")
            extra = looked_up(near, who, "who", "held").where("sure is not null").groupBy("open").agg(F.sum("sure").alias("extra"))
            state = live.join(extra, "open", "left").select(*live.columns, F.coalesce("extra", F.lit(0.0)).alias("extra"))
        share = (F.col("seeds") + F.col("extra")) / (F.col("total") + 1)
        state = state.select("open", "held", share.alias("share")).where(F.col("share") >= SURE_PATTERN)
        met = looked_up(near, state, "open", "held").where("share is not null")
        later = met.groupBy("who", "as", "name").agg((1 - F.exp(F.sum(F.log1p(-F.col("share"))))).alias("sure"))
        later = saved(later, "pii-sure")
        if sure is not None:
            discard(sure)
        sure = later
    best = sure.where(F.col("sure") >= SURE_IDENTIFIER).groupBy("name").agg(F.max(F.struct("sure", (-F.col("as")).alias("k"))).alias("m"))
    out = saved(best.select("name", (-F.col("m.k")).alias("kind"), F.col("m.sure").alias("sure")), "pii-discovered")
    for table in (graph, strong, loose, live, near, sure):
        discard(table)
    return out


def _is_kind(k: int):
    return lambda span: span["kind"] == k


def _listed(spans: Column) -> Column:
    """kind:start:stop of sorted spans, with commas between."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string")))
    )


def personal_data(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found) of every row.

    The counts and ``base_sha256`` are of the strict matches; ``spans`` holds these and the ``n_found`` that
    contexts add, as kind:start:stop in code points, by kind, then start. Null texts count as empty;
    repeated rows stay, a null doc_id is one like any other; an empty table gives no rows. Other columns are left aside.

    Only matches and a few words around them are shuffled, never texts. Identifiers and contexts that
    a third of all rows share are one row of the graph, and joins back to their rows broadcast them.
    """
    found = matches(docs)
    new = discover(found, rounds)
    loose = saved(found.where(F.col("kind") == _LOOSE).select("row", "doc_id", "start", "stop", named().alias("name")), "pii-loose-rows")
    held = loose.groupBy("name").agg(F.count("*").alias("held")).join(new.select("name", "kind"), "name")
    added = looked_up(loose, held, "name", "held").where("kind is not null").select("row", "doc_id", "kind", "start", "stop", F.lit(True).alias("added"))
    strict = found.where(F.col("kind") < _LOOSE).select("row", "doc_id", "kind", "start", "stop", F.lit(False).alias("added"))
    span = F.when(F.col("kind") >= 0, F.struct("kind", "start", "stop", "added"))
    texts = strict.union(added).groupBy("row").agg(F.min("doc_id").alias("doc_id"), F.sort_array(F.collect_list(span)).alias("every"))
    texts = texts.withColumn("base", F.filter("every", lambda s: ~s["added"]))
    counts = [F.size(F.filter("base", _is_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return texts.select(
        "doc_id",
        *counts,
        F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("every")).alias("spans"),
        (F.size("every") - F.size("base")).cast("long").alias("n_found"),
    )
