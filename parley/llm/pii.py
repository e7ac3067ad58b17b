"""Operator 8: personal data by scored candidate spans, in DataFrame functions only.

The base rules find emails, IP addresses, card numbers (Luhn) and phone numbers. Wider generators propose further, possibly
overlapping spans of the same kinds. Each candidate has format features (digits, separators, brackets, Luhn, parts over
255, literal signs) and one of context (a telling word before it). Candidates of the whole corpus are counted by kind and
features, where the base rules' own finds are the positive examples; boosted trees of depth two are fitted to these counts
(a few thousand lines at most, as every feature is clipped) and written back as a SQL expression. A candidate beside the
base spans is kept from the score on at which nine tenths of the candidates of its kind above it are positive.

Defined cases: a null or empty text has no spans; a repeated doc_id is a document a row; a null doc_id is kept; an empty
table gives no rows; other columns are ignored. Offsets are code points, ends exclusive; texts have fewer than 2^28 of them.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

KINDS = ("email", "ip", "card", "phone")
#: The base rules. Possessive repeats and look-behinds keep matching linear and change no match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,7}",
    "card": r"(?<![0-9])[0-9]++(?:[\x20./-][0-9]++)*+",
    "phone": r"\+?\(?(?<![0-9])[0-9][\x20().0-9-]{7,24}[0-9]",
}
#: What a text must hold for a kind's rules to be run over it.
NEEDS = {"email": "@|[\\[(]at[\\])]", "ip": "[0-9]\\.[0-9]", "card": "[0-9]", "phone": "[0-9]"}
CONTEXT = r"(?i)(mail|e-mail|phone|tel|call|mobile|fax|card|visa|account|host|address|ip)[^A-Za-z]{0,4}$"
FEATURES = ("digits", "signs", "brackets", "luhn", "large", "literal", "context", "size")
ROUNDS, RATE, PRECISION = 24, 0.3, 0.9
#: Log-odds that an added span has at least.
SURE = 1.0
#: Values that are joined one by one, and characters of a page of a text.
STEP, PAGE = 256, 1024


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    """Luhn's sum over the digits of x is a multiple of 10."""
    numbers = F.transform(F.filter(F.split(F.reverse(_digits(x)), ""), lambda c: c != ""), lambda c: F.ascii(c) - 48)
    doubled = F.transform(numbers, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    n = F.length(_digits(x))
    if kind == "card":
        return F.when(n.between(14, 19), _luhn(x)).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    if kind == "ip":
        return _small_parts(x)
    return F.lit(True)


def _small_parts(x: Column) -> Column:
    return F.forall(F.split(x, "\\."), lambda p: p.rlike("^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _before(values: Column, join, zero: int) -> Column:
    """For each place of an array of integers what join makes of all values before it. Sums of blocks come first, so a value
    is joined with those of its own block only."""

    def fold(xs: Column, start: Column) -> Column:
        return F.aggregate(xs, start, join)

    def starts(blocks: Column) -> Column:
        return _let(F.transform(blocks, lambda b: fold(b, F.lit(zero))), lambda sums: F.transform(sums, lambda _, k: fold(F.slice(sums, 1, k), F.lit(zero))))

    def within(z: Column) -> Column:
        return F.transform(z["block"], lambda _, i: fold(F.slice(z["block"], 1, i), z["start"]))

    def whole(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / STEP).cast("int")), lambda k: F.slice(v, k * STEP + 1, STEP))
        return _let(blocks, lambda b: F.flatten(F.transform(F.arrays_zip(b.alias("block"), starts(b).alias("start")), within)))

    return _let(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(F.array().cast("array<int>")))


def _pages(text: Column) -> Column:
    """The text in pieces of PAGE characters, as a place deep in a long string is only found by walking there."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0))


def _cut(pages: Column, start: Column, end: Column) -> Column:
    """The characters from start to end of a text in pages."""
    piece = lambda k: F.substring(F.get(pages, k), F.greatest(start - k * PAGE, F.lit(0)) + 1, F.least(end, (k + 1) * PAGE) - F.greatest(start, k * PAGE))
    return F.when(end > start, F.array_join(F.transform(F.sequence(F.floor(start / PAGE).cast("int"), F.floor((end - 1) / PAGE).cast("int")), piece), "")).otherwise("")


def _reach(own: Column, others: Column) -> Column:
    """For each of own the largest end among those of others that begin before it ends: larger than its start if they overlap."""
    begins = F.transform(others, lambda o: F.struct(o["start"].alias("pos"), F.lit(1).alias("late"), o["end"].alias("reach"), F.lit(-1).alias("place")))
    asks = F.transform(own, lambda m, i: F.struct(m["end"].alias("pos"), F.lit(0).alias("late"), F.lit(0).alias("reach"), i.alias("place")))

    def answers(events: Column) -> Column:
        reach = _before(F.transform(events, lambda e: e["reach"]), lambda a, x: F.greatest(a, x), 0)
        asked = F.filter(F.arrays_zip(events.alias("e"), reach.alias("r")), lambda z: z["e"]["place"] >= 0)
        return F.transform(F.array_sort(F.transform(asked, lambda z: F.struct(z["e"]["place"].alias("place"), z["r"].alias("r")))), lambda z: z["r"])

    return F.when(F.size(others) > 0, _let(F.array_sort(F.concat(begins, asks)), answers)).otherwise(F.transform(own, lambda m: F.lit(0)))


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """array<struct<start, end, span>> of all matches: lengths of what lies between them give their places."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.transform(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit")), lambda p: F.struct(F.length(p["gap"]).alias("gap"), F.coalesce(p["hit"], F.lit("")).alias("hit")))

    def placed(pairs: Column) -> Column:
        at = _before(F.transform(pairs, lambda p: p["gap"] + F.length(p["hit"])), lambda a, x: a + x, 0)
        begin = lambda z: z["at"] + z["p"]["gap"]
        return F.transform(F.arrays_zip(pairs.alias("p"), at.alias("at")), lambda z: F.struct(begin(z).alias("start"), (begin(z) + F.length(z["p"]["hit"])).alias("end"), z["p"]["hit"].alias("span")))

    found = F.filter(_let(sizes, placed), lambda m: m["end"] > m["start"])
    return F.when(text.rlike(NEEDS[kind]), found).otherwise(F.array().cast("array<struct<start:int,end:int,span:string>>"))


def _features(pages: Column, kind: str, m: Column) -> Column:
    span, signs = m["span"], F.regexp_replace(m["span"], "[A-Za-z0-9]", "")
    before = _cut(pages, F.greatest(m["start"] - 24, F.lit(0)), m["start"])
    whole = {
        "digits": F.least(F.length(_digits(span)), F.lit(20)), "signs": F.least(F.length(signs), F.lit(8)), "brackets": F.length(F.regexp_replace(signs, "[^(\\[]", "")) > 0,
        "luhn": F.when(F.length(_digits(span)).between(12, 20), _luhn(span)).otherwise(False) if kind == "card" else F.lit(False), "large": ~_small_parts(span) if kind == "ip" else F.lit(False),
        "literal": span.contains("@"), "context": before.rlike(CONTEXT), "size": F.least(F.floor(F.length(span) / 4), F.lit(12)),
    }
    return F.struct(F.lit(KINDS.index(kind)).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), *[whole[f].cast("int").alias(f) for f in FEATURES])


def spans(docs: DataFrame) -> DataFrame:
    """docs with `base` and `wide`: arrays of base spans, and of all proposed spans with their features, `own` (it overlaps a base
    span of its kind) and `reach` (as _reach() gives it for all base spans)."""
    text, least = F.col("text"), {"email": 0, "ip": 4, "card": 13, "phone": 9}

    def both(kind: str) -> Column:
        base = F.filter(_matches(text, kind, BASE[kind]), lambda m: _valid(kind, m["span"]))
        base = F.transform(base, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end")))
        wide = F.filter(_matches(text, kind, WIDE[kind]), lambda m: F.length(_digits(m["span"])).between(least[kind], 40))

        def described(w: Column) -> Column:
            return _let(F.when(F.size(w) > 0, _pages(text)).otherwise(F.array().cast("array<string>")), lambda pages: F.transform(w, lambda m: _features(pages, kind, m)))

        return F.struct(base.alias("base"), _let(wide, described).alias("wide"))

    def apart(m: Column) -> Column:
        """The place of a span where each kind has a stretch to itself, so that kinds never overlap."""
        return F.struct(*[(m[c] + m["kind"] * (1 << 28)).alias(c) for c in ("start", "end")])

    found = docs.withColumns({f"found_{k}": both(k) for k in KINDS})
    found = found.withColumns({"base": F.array_sort(F.concat(*[F.col(f"found_{k}.base") for k in KINDS])), "wide": F.concat(*[F.col(f"found_{k}.wide") for k in KINDS])}).drop(*[f"found_{k}" for k in KINDS])
    own = _reach(F.transform("wide", apart), F.transform("base", apart))
    each = F.arrays_zip(F.col("wide").alias("m"), _reach(F.col("wide"), F.col("base")).alias("r"), own.alias("o"))
    return found.withColumn("wide", F.transform(each, lambda z: z["m"].withField("own", (z["o"] > apart(z["m"])["start"]).cast("int")).withField("reach", z["r"])))


def boosted(x: np.ndarray, positive: np.ndarray, total: np.ndarray) -> tuple[float, list]:
    """Trees of depth two, (feature, cut, ((feature, cut, low, high), (feature, cut, low, high))), for counted rows."""
    prior = float(np.log((positive.sum() + 1) / (total.sum() - positive.sum() + 1)))
    score, trees = np.full(len(x), prior), []
    cuts = [(f, c) for f in range(x.shape[1]) for c in np.unique(x[:, f])[:-1].tolist()]

    def leaf(mask, g, h):
        return float(g[mask].sum() / (h[mask].sum() + 1.0))

    def split(mask, g, h):
        best = (-1.0, 0, 0)
        for f, c in cuts:
            left = mask & (x[:, f] <= c)
            right = mask & ~left
            gain = sum(g[m].sum() ** 2 / (h[m].sum() + 1.0) for m in (left, right))
            if gain > best[0] + 1e-12:
                best = (gain, f, c)
        return best[1], best[2]

    for _ in range(ROUNDS if cuts else 0):
        p = 1 / (1 + np.exp(-score))
        g, h = positive - total * p, total * p * (1 - p)
        f, c = split(np.ones(len(x), bool), g, h)
        sides = []
        for mask in (x[:, f] <= c, x[:, f] > c):
            f2, c2 = split(mask, g, h)
            low, high = mask & (x[:, f2] <= c2), mask & (x[:, f2] > c2)
            values = RATE * leaf(low, g, h), RATE * leaf(high, g, h)
            score[low] += values[0]
            score[high] += values[1]
            sides.append((f2, c2, *values))
        trees.append((f, c, tuple(sides)))
    return prior, trees


def _raw(x: np.ndarray, model) -> np.ndarray:
    prior, trees = model
    out = np.full(len(x), prior)
    for f, c, sides in trees:
        for mask, (f2, c2, low, high) in zip((x[:, f] <= c, x[:, f] > c), sides, strict=True):
            out += np.where(mask, np.where(x[:, f2] <= c2, low, high), 0)
    return out


def _expression(model, m: Column) -> Column:
    names = ("kind", *FEATURES)
    prior, trees = model

    def side(s) -> Column:
        return F.when(m[names[s[0]]] <= s[1], F.lit(s[2])).otherwise(F.lit(s[3]))

    return reduce(lambda a, b: a + b, [F.when(m[names[f]] <= c, side(s[0])).otherwise(side(s[1])) for f, c, s in trees], F.lit(prior))


def fit(found: DataFrame) -> tuple[tuple, dict[int, float]]:
    """Trees and the threshold of each kind, from the counts of all candidates by kind and features."""
    each = found.select(F.explode("wide").alias("m"))
    counted = each.groupBy(*[F.col(f"m.{c}").alias(c) for c in ("kind", *FEATURES)]).agg(F.count("*").alias("n"), F.sum("m.own").alias("p")).collect()
    if not counted:
        return (0.0, []), {}
    x = np.array([[r[c] for c in ("kind", *FEATURES)] for r in sorted(counted)], float)
    n, p = (np.array([r[c] for r in sorted(counted)], float) for c in "np")
    model = boosted(x, p, n)
    score, least = _raw(x, model), {}
    for kind in range(len(KINDS)):
        mine = np.flatnonzero(x[:, 0] == kind)
        mine = mine[np.argsort(-score[mine], kind="stable")]
        sure = np.cumsum(p[mine]) >= PRECISION * np.cumsum(n[mine])
        if sure.any():
            least[kind] = max(SURE, float(score[mine[np.flatnonzero(sure)[-1]]]) - 1e-9)
    return model, least


def _chosen(found: DataFrame) -> DataFrame:
    """`all` (base and added spans in order) in place of `wide`."""
    model, least = fit(found)
    score = lambda m: _expression(model, m)
    enough = lambda m: reduce(lambda a, b: a | b, [(m["kind"] == k) & (score(m) >= F.lit(t)) for k, t in least.items()], F.lit(False))
    extra = F.transform(F.filter("wide", lambda m: (m["reach"] <= m["start"]) & enough(m)), lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end")))

    def alone(x: Column, kind: int) -> Column:
        """Those of a kind that none of an earlier kind overlaps; spans of one kind don't overlap."""
        own, earlier = F.filter(x, lambda m: m["kind"] == kind), F.filter(x, lambda m: m["kind"] < kind)
        return F.transform(F.filter(_let(own, lambda o: F.arrays_zip(o.alias("m"), _let(earlier, lambda e: _reach(o, e)).alias("r"))), lambda z: z["r"] <= z["m"]["start"]), lambda z: z["m"])

    added = F.when(F.size("extra") > 0, F.concat(F.filter("extra", lambda m: m["kind"] == 0), *[alone(F.col("extra"), k) for k in range(1, len(KINDS))])).otherwise(F.col("extra"))
    return found.withColumn("extra", extra).withColumn("all", F.array_sort(F.concat("base", added))).drop("wide", "extra")


def _joined(col: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(col, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _clean(docs: DataFrame, *keep: str) -> DataFrame:
    return docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans, n_spans (of all) for every row of docs (doc_id, text)."""
    found = _chosen(C.materialize(spans(_clean(docs, F.col("doc_id").cast("long").alias("doc_id"))).drop("text"), "spans"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("all").alias("spans"), F.size("all").cast("long").alias("n_spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """All rows and columns of docs with every span of the text replaced by its kind in angle brackets; null stays null."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    found = spans(docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    found = C.materialize(found.drop("text"), "spans").withColumn("text", F.coalesce(F.col("row.text").cast("string"), F.lit("")))
    found = _chosen(found)

    def piece(pages: Column, z: Column) -> Column:
        """What stands between the spans before and this one, and its label unless they cover its start."""
        return F.concat(_cut(pages, z["at"], F.greatest(z["s"]["start"], z["at"])), F.when(z["s"]["start"] >= z["at"], F.element_at(names, z["s"]["kind"] + 1)).otherwise(""))

    def whole(pages: Column, marked: Column) -> Column:
        rest = _cut(pages, F.array_max(F.transform(marked, lambda s: s["end"])), F.length("text"))
        each = F.arrays_zip(marked.alias("s"), _before(F.transform(marked, lambda s: s["end"]), lambda a, x: F.greatest(a, x), 0).alias("at"))
        return F.concat(F.array_join(F.transform(each, lambda z: piece(pages, z)), ""), rest)

    clean = _let(_pages(F.col("text")), lambda pages: whole(pages, F.col("all")))
    text = F.when(F.col("row.text").isNotNull(), F.when(F.size("all") > 0, clean).otherwise(F.col("text")))
    return found.select(*[text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
