"""Personal data by candidate gradient boosting, in Spark's own functions only.

Base patterns find e-mail addresses, IPv4 addresses, card and phone numbers. Broader
generators then propose further spans, which may overlap each other and the base ones:
addresses written with "(at)" and "[dot]", addresses and numbers with other separators,
IPv6, phone numbers without a plus. Boosted trees judge each candidate by its format
(digits, separators, checksum, ...) and its context (the words before, the characters
around it); a threshold for each kind, calibrated for precision, selects. Base spans
always stay; a selected span that overlaps a base one is left out, and of selected spans that
overlap each other, taken from left to right, the better stays. In running text the trees mostly
recover what the base patterns drop: a phone number and a card number with one space
between them make one base match of too many digits, which fails.

All of a document is done in its row: matches come from regexp_extract_all, their places
from the lengths of the pieces that split leaves, so nothing is shuffled. Patterns are
written with possessive quantifiers and start only where a run starts, so they take time
in proportion to the text. What runs over all spans of a text (places, overlaps, redaction)
is folded in chunks of the root of their number, since a fold that lengthens one array
copies it at each step. The trees are fitted with numpy on the driver from some thousand
sentences that a seeded generator makes, measured by the same expressions.

Defined cases: a null text counts as empty and has no spans (redact() leaves it null); null
ids and repeated rows are returned as they are; an empty table gives an empty result;
other columns are ignored by find() and kept by redact().
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexshift.llm import boosting

KINDS = ("email", "ip", "card", "phone")
#: At a place where a run of such characters starts, or where the last match ended.
_LOCAL = r"(?:(?<![A-Za-z0-9._%+-])|\G)"
BASE = {
    "email": _LOCAL + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OPEN, _SHUT = r"[\[({<]\x20?", r"\x20?[\])}>]"
_DOMAIN = r"[A-Za-z0-9-]++"
BROAD = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:"
    rf"\x20?(?:{_OPEN}(?:at|AT|@){_SHUT}|@)\x20?{_DOMAIN}(?:\x20?(?:{_OPEN}(?:dot|DOT|\.){_SHUT}|\.)\x20?{_DOMAIN})+"
    rf"|\x20(?:at|AT)\x20{_DOMAIN}(?:\x20(?:dot|DOT)\x20{_DOMAIN})+)",
    "ip": rf"(?<![0-9A-Za-z.:])(?:[0-9]{{1,3}}(?:(?:{_OPEN}(?:dot|\.){_SHUT}|\x20dot\x20|\x20?\.\x20?)[0-9]{{1,3}}){{3}}|[0-9A-Fa-f]{{1,4}}(?:::?[0-9A-Fa-f]{{1,4}}){{2,7}}+)(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}+|[0-9]{4}(?:[\x20._/-]{1,2}[0-9]{3,6}){2,4}?)(?![0-9A-Za-z]|[._/-][0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:(?:(?:\+|00)[0-9]{1,3}[\x20.-]?)?\(?[0-9]{3}\)?[\x20./-]?[0-9]{3}[\x20.-]?[0-9]{4}|(?:\+|00)[0-9]{2}(?:[\x20.-]?[0-9]{2,4}){3,4}|0[0-9]{1,4}[\x20/-][0-9]{5,8}|0[0-9](?:[\x20.-][0-9]{2}){4})(?![0-9A-Za-z])",
}
#: Cheap tests that every match of a pattern's kind passes, before the pattern itself runs.
NEEDS = {
    "email": r"@|(?i:\bat\b)[^A-Za-z0-9]{1,3}[A-Za-z0-9-]{1,63}[^A-Za-z0-9]{1,3}(?i:dot\b)|(?i:[\[({<]\x20?at)",
    "ip": r"[0-9][^0-9\n]{0,8}[.t:]|[0-9A-Fa-f]:",
    "card": r"[0-9]",
    "phone": r"[0-9]",
}
CONTEXT = {
    "email": r"mail|contact|write to|reach|courriel|correo|kontakt",
    "ip": r"\bip\b|address|host|server|adresse|direcci",
    "card": r"card|visa|credit|payment|karte|carte|tarjeta",
    "phone": r"phone|tel\b|t[eé]l\b|tel[.:]|call|fax|mobile|cell|telefon|móvil|llama",
}
AGAINST = r"order|invoice|isbn|version|serial|\bid\b|ref\b|page|section|chapter|\bno\b|date|build|score|total"
TOP_LEVEL = r"(?i)\b(?:com|org|net|edu|gov|info|io|de|fr|es|eu|uk)$"
FEATURES = ("kind", "digits", "size", "marks", "distinct_digits", "luhn", "brackets", "spelled", "keyword", "against", "inside", "largest", "top_level", "mark_kinds", "letters", "plus", "zero", "groups", "longest", "beside")
PRECISION, ROUNDS, EXAMPLES, SEED = 0.99, 24, 3000, 11
SPAN = "struct<start:bigint,end:bigint,kind:int,m:string,pre:string,post:string>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if a string of digits passes the Luhn check."""
    twice = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(digits, -i, F.lit(1)).try_cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return (F.length(digits) > 0) & (F.aggregate(twice, F.lit(0), lambda a, x: a + F.floor(x / 10).cast("int") + x % 10) % 10 == 0)


def _octet(part: Column) -> Column:
    short = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return (F.length(short) <= 3) & (F.coalesce(short.try_cast("int"), F.lit(999)) <= 255)


def _valid(kind: str):
    """The check that a base match must pass."""
    if kind == "email":
        return lambda m: F.lit(True)
    if kind == "ip":
        return lambda m: F.forall(F.split(m, r"\."), _octet)
    if kind == "card":
        return lambda m: F.length(_digits(m)).between(13, 19) & luhn(_digits(m))
    return lambda m: F.length(_digits(m)).between(9, 15)


def _matches(text: Column, needs: Column, pattern: str) -> Column:
    return F.when(needs, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _bound(value: Column, f) -> Column:
    """f(value) with the value made once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _folded(items: Column, kind: str, start: Column, step, end=None) -> Column:
    """The arrays that step(state, x) -> (state, array<kind>) gives for all items, one after another, then end(state)'s.

    Chunks of the root of the items' number are folded one by one, so that no long array is copied at each item."""
    none = F.array().cast(f"array<{kind}>")

    def inner(state, x):
        now, made = step(state["s"], x)
        return F.struct(now.alias("s"), F.concat(state["out"], made).alias("out"))

    def outer(state, chunk):
        done = F.aggregate(chunk, F.struct(state["s"].alias("s"), none.alias("out")), inner)
        return _bound(done, lambda d: F.struct(d["s"].alias("s"), F.concat(state["out"], F.array(d["out"])).alias("out")))

    begin = F.struct(start.alias("s"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    whole = lambda s: F.flatten(s["out"]) if end is None else F.concat(F.flatten(s["out"]), end(s["s"]))
    return _bound(items, lambda every: F.when(F.size(every) > 0, F.aggregate(_parts(every), begin, outer, whole)).otherwise(none))


def _parts(items: Column) -> Column:
    """An array cut into chunks of the root of its size."""
    side = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(items).cast("double"))).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(items) / side).cast("int") - 1), lambda c: F.slice(items, c * side + 1, side))


def _placed(found: Column, gaps: Column, kind: str, valid) -> Column:
    """Matches, and the pieces of text between them, to spans: start and end (code points, end exclusive),
    the match, and what stands around it."""
    around = F.transform(found, lambda m, i: F.struct(m.alias("m"), F.element_at(gaps, i + 1).alias("before"), F.element_at(gaps, i + 2).alias("after")))

    def step(at, x):
        start = at + F.length(x["before"])
        end = start + F.length(x["m"])
        beside = F.right(x["before"], F.lit(40)).alias("pre"), F.left(x["after"], F.lit(8)).alias("post")
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(KINDS.index(kind)).alias("kind"), x["m"].alias("m"), *beside)
        return end, F.when(valid(x["m"]), F.array(span)).otherwise(F.array().cast(f"array<{SPAN}>"))

    return F.when(F.size(found) > 0, _folded(around, SPAN, F.lit(0).cast("long"), step)).otherwise(F.array().cast(f"array<{SPAN}>"))


def _features(c: Column) -> list[Column]:
    """What the trees see of a candidate."""
    one = lambda x: F.when(x, 1.0).otherwise(0.0)
    m, digits = c["m"], _digits(c["m"])
    known = F.lit(False)
    for i, k in enumerate(KINDS):
        known = F.when(c["kind"] == i, F.lower(c["pre"]).rlike(CONTEXT[k])).otherwise(known)
    parts = F.transform(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0)), lambda x: F.coalesce(x.try_cast("int"), F.lit(10**6)).cast("double"))
    ways = {
        "kind": c["kind"],
        "digits": F.length(digits),
        "size": F.length(m),
        "marks": F.regexp_count(m, F.lit("[^A-Za-z0-9]")),
        "distinct_digits": F.size(F.array_distinct(F.split(digits, "(?<=[0-9])(?=[0-9])"))),
        "luhn": F.when(F.length(digits).between(12, 19), one(luhn(digits))).otherwise(0.0),
        "brackets": F.regexp_count(m, F.lit(r"[\[({<]")),
        "spelled": F.regexp_count(m, F.lit(r"(?i)\b(?:at|dot)\b")),
        "keyword": one(known),
        "against": one(F.lower(c["pre"]).rlike(AGAINST)),
        "inside": one(c["pre"].rlike(r"[0-9A-Za-z.,/-]$")) + one(c["post"].rlike(r"^(?:[0-9A-Za-z/-]|[.,][0-9])")),
        "largest": F.coalesce(F.array_max(parts), F.lit(0.0)),
        "top_level": one(m.rlike(TOP_LEVEL)),
        "mark_kinds": F.size(F.array_distinct(F.regexp_extract_all(m, F.lit("[^A-Za-z0-9]+"), F.lit(0)))),
        "letters": F.regexp_count(m, F.lit("[A-Za-z]")),
        "plus": one(m.startswith("+")) + one(m.startswith("00")),
        "zero": one(m.rlike(r"^\(?0")),
        "groups": F.size(parts),
        "longest": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(m, F.lit("[0-9A-Za-z]+"), F.lit(0)), F.length)), F.lit(0)),
        "beside": one(c["pre"].rlike(r"[0-9]\x20$")) + one(c["post"].rlike(r"^\x20[0-9+(]")),
    }
    return [ways[n].cast("double").alias(n) for n in FEATURES]


def _candidates(rows: DataFrame) -> DataFrame:
    """Adds, for each kind, _base_<kind> (spans), and _seen (candidates of all kinds with their features), to rows with _text."""
    names, text = rows.columns, F.col("_text")
    rows = rows.withColumns({f"_needs_{k}": text.rlike(NEEDS[k]) for k in KINDS})
    rows = rows.withColumns(
        {f"_match_{k}": _matches(text, F.col(f"_needs_{k}"), BASE[k]) for k in KINDS} | {f"_broad_{k}": _matches(text, F.col(f"_needs_{k}"), BROAD[k]) for k in KINDS}
    )
    between = lambda found, pattern: F.when(F.size(found) > 0, F.split(text, pattern, -1))
    rows = rows.withColumns({f"_gaps_{k}": between(f"_match_{k}", BASE[k]) for k in KINDS} | {f"_wide_{k}": between(f"_broad_{k}", BROAD[k]) for k in KINDS})
    base = lambda k: F.transform(_placed(F.col(f"_match_{k}"), F.col(f"_gaps_{k}"), k, _valid(k)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    near = F.concat(*[_placed(F.col(f"_broad_{k}"), F.col(f"_wide_{k}"), k, lambda m: F.lit(True)) for k in KINDS])
    rows = rows.select(*names, *[base(k).alias(f"_base_{k}") for k in KINDS], near.alias("_near"))
    seen = F.transform("_near", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), *_features(c)))
    return rows.select(*names, *[f"_base_{k}" for k in KINDS], seen.alias("_seen"))


def examples(n: int = EXAMPLES, seed: int = SEED) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Sentences and their true spans (kind, start, end), from a seeded generator."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioubcdfglmnprst") for _ in range(rng.randint(2, 9)))
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))

    def card(good: bool) -> str:
        body = rng.choice("3456") + digits(14)
        fits = [c for c in "0123456789" if _plain_luhn(body + c) == good]
        return body + rng.choice(fits)

    def grouped(number: str) -> str:
        mark = rng.choice([".", "_", "/", "  ", "--", " ", "-"])
        return mark.join(number[i : i + 4] for i in range(0, len(number), 4))

    def email() -> str:
        at, dot = rng.choice([(" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), ("(at)", "."), (" [at] ", "."), (" @ ", "."), ("{at}", "{dot}"), ("<at>", "."), (" AT ", " DOT "), ("@", " . ")])
        ends = [["com"], ["org"], ["net"], ["de"], ["fr"], ["es"], ["io"], ["info"], ["co", "uk"], ["edu"]]
        return word() + rng.choice(["", "." + word(), digits(2), "_" + word(), "-" + digits(1)]) + at + dot.join([word(), *rng.choice([[], [], [word()]]), *rng.choice(ends)])

    def ip() -> str:
        kind = rng.random()
        if kind < 0.25:
            return ":".join(hexes(rng.randint(1, 4)) for _ in range(8))
        if kind < 0.5:
            left, right = rng.randint(1, 3), rng.randint(1, 4)
            return rng.choice(["2001", "fe80", "fd" + hexes(2), "2a0" + hexes(1)]) + "".join(":" + hexes(rng.randint(2, 4)) for _ in range(left)) + ":" + "".join(":" + hexes(rng.randint(1, 4)) for _ in range(right))
        return rng.choice(["[.]", "(.)", "[dot]", " dot ", "(dot)", "{.}"]).join(str(rng.randint(1, 255)) for _ in range(4))

    def north() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"{a}/{b}-{c}", f"({a}){b}-{c}"])

    def phone() -> str:
        pairs = " ".join(digits(2) for _ in range(4))
        return rng.choice([north(), north(), f"00{rng.randint(1, 99)} {north()}", f"0{rng.randint(1, 9)} {pairs}", f"0{rng.randint(1, 9)} {pairs}".replace(" ", "."), f"0{digits(3)}/{digits(6)}", f"0{digits(2)} {digits(7)}", f"0033 {rng.randint(1, 9)}{digits(1)} {digits(2)} {digits(2)} {digits(3)}"])

    def dialled() -> str:
        return rng.choice(["+1 ", "+1-", "+44 ", "+34 "]) + north()

    def merged() -> list[tuple[str, str | None]]:
        """Numbers side by side, which base patterns take for one."""
        some = [("phone", dialled()), ("card", card(True)), (None, ".".join(str(rng.randint(1, 255)) for _ in range(4))), (None, card(False)), (None, digits(rng.randint(1, 6)))]
        rng.shuffle(some)
        return [(text, kind) for kind, text in some[: rng.randint(2, 3)]]

    true = {
        "email": (email, ["e-mail", "mail me:", "contact", "write to", "", word(), "correo:", "reach us"]),
        "ip": (ip, ["ip", "server", "host address", "", "from ip", "adresse", word(), "ping"]),
        "card": (lambda: grouped(card(True)), ["card", "visa", "credit card:", "payment by", "", "karte", word()]),
        "phone": (phone, ["phone", "tel.", "call", "fax:", "mobile", "telefon", "téléphone", "móvil"]),
    }
    false = [
        lambda: f"{word()} was at {word()} . {word()}",
        lambda: f"{word()} @ {word()}. {word()}",
        lambda: f"{word()} at {word()} dot {word()}",
        lambda: f"section {rng.randint(1, 9)}. {rng.randint(1, 40)}. {rng.randint(1, 40)}. {rng.randint(1, 40)}",
        lambda: f"list {rng.randint(1, 9)} . {rng.randint(300, 999)} . {rng.randint(300, 999)} . {rng.randint(1, 40)}",
        lambda: f"order {grouped(card(False))}",
        lambda: f"serial {digits(4)}-{digits(4)}-{digits(4)}-{digits(4)}",
        lambda: grouped(card(False)),
        lambda: f"{word()} {card(False)} {word()}",
        lambda: f"ref {digits(4)}/{digits(3)}/{digits(6)}",
        lambda: f"order {digits(10)}",
        lambda: f"{word()} {digits(rng.randint(13, 19))}",
        lambda: f"total {digits(3)} {digits(3)} {digits(4)}",
        lambda: f"invoice no {digits(3)}-{digits(3)}-{digits(4)}",
        lambda: f"{word()} {digits(10)} {word()}",
        lambda: f"id {digits(3)}.{digits(3)}.{digits(4)}",
        lambda: f"isbn 978-{digits(3)}-{digits(4)}",
        lambda: f"{word()} {rng.randint(0, 23):02}:{rng.randint(0, 59):02}:{rng.randint(0, 59):02}",
        lambda: f"at {rng.randint(0, 23):02}:{rng.randint(0, 59):02}:{rng.randint(0, 59):02}:{digits(2)}",
        lambda: f"mac {':'.join(hexes(2) for _ in range(6))}",
        lambda: f"scores {rng.randint(0, 9)}:{rng.randint(0, 9)}:{rng.randint(0, 9)}:{rng.randint(0, 9)}",
        lambda: f"part 0{digits(2)}-{digits(7)}",
        lambda: f"page 0{digits(3)}/{digits(6)}",
        lambda: f"rate 0{rng.randint(1, 9)} {' '.join(digits(2) for _ in range(4))} of {word()}",
    ]
    out = []
    for i in range(n):
        text, spans = " ".join(word() for _ in range(rng.randint(1, 6))) + " ", []
        pieces: list[tuple[str, str | None]]
        if i % 5 == 0:
            pieces = merged()
        elif i % 5 in (1, 2):
            kind = KINDS[i // 5 % 4]
            make, words = true[kind]
            text = f"{text}{rng.choice(words)}".rstrip() + " "
            pieces = [(make(), kind)]
        else:
            pieces = [(false[i // 5 * 2 % len(false) - i % 5 % 2](), None)]
        for k, (piece, kind) in enumerate(pieces):
            text += " " * bool(k)
            if kind:
                spans.append((kind, len(text), len(text) + len(piece)))
            text += piece
        out.append((text + rng.choice(["", ".", ",", " "]) + " " + " ".join(word() for _ in range(rng.randint(1, 5))), spans))
    return out


def _plain_luhn(number: str) -> bool:
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(number)))) % 10 == 0


_MODELS: dict = {}


def model(spark: SparkSession, n: int = EXAMPLES, seed: int = SEED, precision: float = PRECISION) -> tuple[boosting.Boosted, dict[str, float]]:
    """The trees and each kind's threshold. A third of the examples calibrates the thresholds."""
    if (n, seed, precision) not in _MODELS:
        made = examples(n, seed)
        rows = spark.range(1).select(F.posexplode(F.split(F.lit("\n".join(t for t, _ in made)), "\n")).alias("at", "_text"))
        seen = _candidates(rows).select("at", "_seen").collect()
        x, y, at, kinds = [], [], [], []
        for row in seen:
            truth = set(made[row["at"]][1])
            for c in row["_seen"]:
                kind = KINDS[int(c["kind"])]
                x.append([c[f] for f in FEATURES])
                y.append((kind, c["start"], c["end"]) in truth)
                at.append(row["at"])
                kinds.append(kind)
        x, y, at, kinds = np.array(x), np.array(y, float), np.array(at), np.array(kinds)
        held = at % 6 >= 4
        trees = boosting.fit(x[~held], y[~held], ROUNDS)
        margin = trees.margin(x)
        _MODELS[n, seed, precision] = trees, {k: boosting.threshold(margin[held & (kinds == k)], y[held & (kinds == k)], precision) for k in KINDS}
    return _MODELS[n, seed, precision]


def spans(rows: DataFrame, seed: int = SEED, precision: float = PRECISION) -> DataFrame:
    """rows with _text to the same with _base_<kind> (spans: start, end) and _more (kind, start, end, score, limit)."""
    trees, limits = model(rows.sparkSession, seed=seed, precision=precision)
    names = rows.columns
    score = trees.sql([f"c.{f}" for f in FEATURES])
    limit = "CASE c.kind " + " ".join(f"WHEN {i} THEN {min(limits[k], 1e9):.9e}D" for i, k in enumerate(KINDS)) + " END"
    scored = F.expr(f"transform(_seen, c -> named_struct('start', c.start, 'end', c.end, 'kind', int(c.kind), 'score', {score}, 'limit', {limit}))")
    rows = _candidates(rows).withColumn("_chosen", F.filter(scored, lambda c: c["score"] >= c["limit"]))
    # A base span stands before a chosen one of the same start.
    base = [F.transform(f"_base_{k}", lambda b: F.struct(b["start"].alias("start"), F.lit(False).alias("new"), b["end"].alias("end"), F.lit(0).alias("kind"), F.lit(0.0).alias("score"), F.lit(0.0).alias("limit"))) for k in KINDS]
    new = F.transform("_chosen", lambda c: F.struct(c["start"].alias("start"), F.lit(True).alias("new"), c["end"].alias("end"), c["kind"].alias("kind"), c["score"].alias("score"), c["limit"].alias("limit")))
    rows = rows.withColumn("_line", F.when(F.size("_chosen") > 0, F.array_sort(F.concat(*base, new))).otherwise(F.array().cast(f"array<{_LINE}>")))
    return rows.select(*names, *[f"_base_{k}" for k in KINDS], _apart(F.col("_line")).alias("_more"))


_LINE = "struct<start:bigint,new:boolean,end:bigint,kind:int,score:double,limit:double>"


def _apart(line: Column) -> Column:
    """Of base and chosen spans, by their starts, the chosen ones that stay: those that overlap no base span, and the better of two."""
    nothing = F.array().cast(f"array<{_LINE}>")
    start = F.struct(F.lit(0).cast("long").alias("taken"), nothing.alias("last"))  # where base spans end; the last one, if it may stay

    def step(s, x):
        last, new = F.get(s["last"], F.lit(0)), x["new"]
        meets = (F.size(s["last"]) > 0) & (last["end"] > x["start"])
        covered = new & (x["start"] < s["taken"])
        beaten = meets & new & (last["score"] >= x["score"])
        left = F.when(covered | beaten, s["last"]).when(new, F.array(x)).when(meets, nothing).otherwise(s["last"])
        now = F.struct(F.when(new, s["taken"]).otherwise(F.greatest(s["taken"], x["end"])).alias("taken"), left.alias("last"))
        return now, F.when(new & ~covered & ~meets, s["last"]).otherwise(nothing)

    return _folded(line, _LINE, start, step, lambda s: s["last"])


def _both(i: int) -> Column:
    """A kind's base spans and those that the trees chose, in order."""
    more = F.transform(F.filter("_more", lambda a: a["kind"] == i), lambda a: F.struct(a["start"].alias("start"), a["end"].alias("end")))
    return F.array_sort(F.concat(F.col(f"_base_{KINDS[i]}"), more))


def _joined(of) -> Column:
    """kind:start:end of all kinds' spans, comma-joined; of: gives a kind's spans by its number."""

    def named(i):
        return F.transform(of(i), lambda s: F.concat_ws(":", F.lit(KINDS[i]), s["start"].cast("string"), s["end"].cast("string")))

    return F.array_join(F.concat(*map(named, range(len(KINDS)))), ",")


def find(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, text) to doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans."""
    rows = spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text")), **how)
    return rows.select(
        "doc_id",
        *[F.size(f"_base_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_joined(lambda i: F.col(f"_base_{KINDS[i]}")), 256).alias("base_sha256"),
        _joined(_both).alias("spans"),
    )


_CUT = "struct<at:bigint,start:bigint,end:bigint,tag:string>"


def _disjoint(spans: Column) -> Column:
    """Sorted spans (start, end, tag) to what is cut out of the text: overlapping spans as one, with the first's tag; at: where the piece before it starts."""
    nothing = F.array().cast(f"array<{_CUT}>")
    start = F.struct(F.lit(0).cast("long").alias("at"), nothing.alias("open"))

    def step(s, x):
        last = F.get(s["open"], F.lit(0))
        meets = (F.size(s["open"]) > 0) & (last["end"] > x["start"])
        longer = F.struct(last["at"].alias("at"), last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), last["tag"].alias("tag"))
        fresh = F.struct(F.coalesce(last["end"], F.lit(0).cast("long")).alias("at"), x["start"].alias("start"), x["end"].alias("end"), x["tag"].alias("tag"))
        return F.struct(s["at"].alias("at"), F.array(F.when(meets, longer).otherwise(fresh)).alias("open")), F.when(meets, nothing).otherwise(s["open"])

    return _folded(spans, _CUT, start, step, lambda s: s["open"])


def _chunked(cuts: Column) -> Column:
    """Cuts in chunks, each with the part of the text that it covers."""
    whole = F.transform(_parts(cuts), lambda p: F.struct(F.get(p, F.lit(0))["at"].alias("start"), F.element_at(p, -1)["end"].alias("end"), p.alias("cuts")))
    return F.when(F.size(cuts) > 0, whole)


def redact(docs: DataFrame, **how) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets (overlapping spans as one, by the first's); n_chars follows."""
    rows = spans(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text")), **how)

    def tagged(i):
        return F.transform(_both(i), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{KINDS[i].upper()}]").alias("tag")))

    rows = rows.withColumn("_all", F.array_sort(F.concat(*map(tagged, range(len(KINDS))))))
    rows = rows.withColumn("_cuts", _disjoint(F.col("_all")))
    rows = rows.withColumn("_chunks", _chunked(F.col("_cuts")))
    piece = lambda text, a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))

    def cleaned(c):
        """A chunk's part of the text, cut out once, with its spans replaced."""
        inside = lambda text: F.transform(c["cuts"], lambda x: F.concat(piece(text, x["at"] - c["start"], x["start"] - c["start"]), x["tag"]))
        return F.array_join(F.flatten(F.transform(F.array(piece(F.col("_text"), c["start"], c["end"])), inside)), "")

    last = F.element_at("_cuts", -1)["end"]
    rest = F.substring(F.col("_text"), (last + 1).cast("int"), F.length("_text"))
    clean = F.when(F.size("_cuts") > 0, F.concat(F.array_join(F.transform("_chunks", cleaned), ""), rest)).otherwise(F.col("_row.text"))
    rows = rows.withColumn("_clean", clean)
    changed = {"text": F.col("_clean")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size("_all") > 0, F.length("_clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return rows.select(*[changed.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
