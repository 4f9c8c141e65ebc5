"""Personal data: overlapping candidate spans, scored by gradient-boosted trees, cut at calibrated thresholds.

Four base kinds (email, ip, card, phone) are found by fixed patterns and checks and always stay. High-recall
generators propose looser spans; boosted trees over format and context features score them; a span is added if
its score reaches its kind's threshold and it overlaps neither a base span nor an added span of better score. Everything
that touches documents is built-in column functions, one row in, one row out, without a shuffle. The trees are
fitted on the driver on a bounded sample (``SAMPLE_SPANS`` contexts) and ``GENERIC_SPANS`` fixed spans, and become
conditional expressions.

Patterns are written so that the engine's matcher neither recurses nor rescans: possessive quantifiers, and a
match begins only where a run of its characters begins or the previous match ended. Both leave the matches of
the plain patterns as they are.

Defined cases: null text counts as empty and has no spans; texts of any length are scanned whole; repeated
rows are scanned each on its own; an empty table gives an empty result; without a base span in the sample
the fixed spans alone teach. Columns of the input that bear the name of a result column are replaced.
"""

from __future__ import annotations

import random
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baseloom.llm.registry import let, once, query, table

KINDS = ("email", "ip", "card", "phone")
# Bound of the base spans, with 32 characters of context on either side, that the fit reads.
SAMPLE_SPANS = 3000
# Spans in fixed contexts that every fit reads too, so that small or mostly obfuscated tables are learnt for as well.
GENERIC_SPANS = 120
CONTEXT = 32

_SPAN = "struct<s:int,e:int,k:int,t:string>"
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold for a kind's pattern to match at all.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
# Generators of looser spans. Each begins at the edge of a run, as above.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+(?: ?(?:@|[(\[{]at[)\]}]) ?[A-Za-z0-9-]{2,63}+(?:(?:\.| ?[(\[{]dot[)\]}] ?| dot )[A-Za-z0-9-]{2,63}+)++| at [A-Za-z0-9-]{2,63}+(?: dot [A-Za-z0-9-]{2,63}+)++)",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}+:){4,7}+[0-9A-Fa-f]{1,4}+(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}[\x20./_-][0-9]{4,6}[\x20./_-][0-9]{4,5}(?:[\x20./_-][0-9]{3,4})?(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])(?:00|0|1)?[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20./-]?[0-9]{3,4}[\x20./-][0-9]{3,4}(?![0-9A-Za-z])",
}
WIDE_NEEDS = {
    "email": r"@|[(\[{]at[)\]}]| at [A-Za-z0-9-]++ dot ",
    "ip": ":[0-9A-Fa-f]{1,4}:",
    "card": r"[0-9]{4}[\x20./_-][0-9]{4}",
    "phone": r"[0-9]{3}[\x20./-][0-9]{3}",
}

_BLOCK = 64


def _running_starts(lengths: Column) -> Column:
    """Sum of all earlier elements, per element; in blocks, so that long lists stay cheap."""

    def plus(a, x):
        return F.struct((a["n"] + x).alias("n"), F.concat(a["v"], F.array(a["n"])).alias("v"))

    def running(values, start):
        zero = F.struct(start.cast("int").alias("n"), F.array().cast("array<int>").alias("v"))
        return F.aggregate(values, zero, plus, lambda a: a["v"])

    def blocked(v):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _BLOCK).cast("int")), lambda b: F.slice(v, b * _BLOCK + 1, _BLOCK))
        def ahead(parts):
            sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x))
            return F.flatten(F.zip_with(parts, running(sums, F.lit(0)), lambda p, at: running(p, at)))
        return let(blocks, ahead)

    return F.when(F.size(v := lengths) == 0, F.array().cast("array<int>")).otherwise(let(v, blocked))


def _found(text: Column, pattern: str, needs: str, kind: int, check=None) -> Column:
    """All matches with their places in code points, from the texts between the matches."""
    none = F.array().cast(f"array<{_SPAN}>")

    def spans(found):
        gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.greatest(F.size(found), F.lit(1))), lambda g: F.length(g))

        def with_gaps(gap):
            each = F.zip_with(gap, found, lambda g, m: g + F.length(m))
            starts = _running_starts(each)
            placed = F.zip_with(
                F.zip_with(starts, gap, lambda s, g: s + g),
                found,
                lambda s, m: F.struct(s.alias("s"), (s + F.length(m)).alias("e"), F.lit(kind).alias("k"), m.alias("t")),
            )
            placed = F.filter(placed, lambda p: check(p["t"])) if check else placed
            return placed.cast(f"array<{_SPAN}>")

        return F.when(F.size(found) == 0, none).otherwise(let(gaps, with_gaps))

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.rlike(needs), let(matches, spans)).otherwise(none)


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a text of digits passes the Luhn check."""

    def add(a, i):
        d = F.ascii(F.substring(digits, F.length(digits) - i, F.lit(1))) - 48
        return a + F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _card_ok(t: Column) -> Column:
    return let(_digits(t), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False))


_OCTET = "0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
CHECKS = {
    "email": None,
    "ip": lambda t: t.rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"),
    "card": _card_ok,
    "phone": lambda t: F.length(_digits(t)).between(9, 15),
}


def base_spans(text: Column) -> Column:
    """Spans of the four base kinds, by start, then kind."""
    each = [_found(text, BASE[k], NEEDS[k], n, CHECKS[k]) for n, k in enumerate(KINDS)]
    return F.sort_array(F.transform(F.concat(*each), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["t"].alias("t"))))


def candidates(text: Column) -> Column:
    """Overlapping spans of the generators: the looser patterns, and base matches whose check failed."""
    each = [_found(text, WIDE[k], WIDE_NEEDS[k], n) for n, k in enumerate(KINDS)]
    each += [_found(text, BASE[k], NEEDS[k], n, lambda t, ok=CHECKS[k]: ~ok(t)) for n, k in enumerate(KINDS) if CHECKS[k]]
    return F.array_distinct(F.concat(*each))


CUES = {
    "cue_mail": r"(?i)e-?mail|contact|write to|courriel|correo|@",
    "cue_phone": r"(?i)\b(?:tel|phone|call|fax|mobile|cell|telefon|whatsapp)",
    "cue_card": r"(?i)\b(?:card|visa|mastercard|amex|credit|karte|tarjeta|carte)",
    "cue_host": r"(?i)\b(?:ip|host|server|address|login)\b",
    "cue_number": r"(?i)\b(?:version|order|invoice|page|pages|isbn|no\.|nr\.|id|ref|pp\.)\W*$",
}


def features(span: Column, text: Column) -> dict[str, Column]:
    """Format and context features of one candidate; all are doubles."""
    t = span["t"]
    before = F.substring(text, F.greatest(span["s"] - CONTEXT, F.lit(0)) + 1, F.least(span["s"], F.lit(CONTEXT)))
    after = F.substring(text, span["e"] + 1, F.lit(1))
    digits = _digits(t)
    out = {
        "kind": span["k"],
        "length": F.length(t),
        "digits": F.length(digits),
        "separators": F.length(F.regexp_replace(t, r"[0-9A-Za-z]", "")),
        "dots": F.length(t) - F.length(F.translate(t, ".", "")),
        "brackets": F.length(t) - F.length(F.translate(t, "()[]{}", "")),
        "spaces": F.length(t) - F.length(F.translate(t, " ", "")),
        "letters": F.length(F.regexp_replace(t, r"[^A-Za-z]", "")),
        "last_letters": F.length(F.regexp_extract(t, r"([A-Za-z]*)$", 1)),
        "luhn": F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False),
        "area_555": t.rlike(r"\([0-9]{3}\)[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}$"),
        "four_groups": t.rlike(r"^[0-9]{4}(?:[^0-9][0-9]{4}){3}$"),
        "date_like": t.rlike(r"(?:19|20)[0-9]{2}|^[0-3]?[0-9][./-][0-1]?[0-9][./-]"),
        "marked_at": t.rlike(r"\(at\)|\[at\]|\{at\}|@"),
        "marked_dot": t.rlike(r"\(dot\)|\[dot\]|\{dot\}|\."),
        "after_word": after.rlike("[0-9A-Za-z_]"),
        "before_sign": before.rlike(r"[#$€£=/_.,-]$"),
    } | {n: before.rlike(p) for n, p in CUES.items()}
    return {n: c.cast("double") for n, c in out.items()}


@dataclass
class Trees:
    """Boosted trees: each is a nested tuple (feature, cut, left, right) with floats as leaves."""

    bias: float = 0.0
    trees: list = field(default_factory=list)
    thresholds: dict[int, float] = field(default_factory=dict)

    def score(self, f: dict[str, Column]) -> Column:
        def node(tree):
            if isinstance(tree, float):
                return F.lit(tree)
            name, cut, low, high = tree
            return F.when(f[name] <= F.lit(cut), node(low)).otherwise(node(high))

        total = F.lit(self.bias)
        for tree in self.trees:
            total = total + node(tree)
        return total


def _tree(x, names, grad, hess, rows, depth, cuts):
    """One regression tree by second-order gain."""
    g, h = grad[rows].sum(), hess[rows].sum()
    best = (1e-6, None)
    if depth and len(rows) >= 20:
        for j, name in enumerate(names):
            v = x[rows, j]
            for cut in cuts[name]:
                low = v <= cut
                if 5 <= low.sum() <= len(rows) - 5:
                    gl, hl = grad[rows][low].sum(), hess[rows][low].sum()
                    gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                    if gain > best[0]:
                        best = (gain, (name, float(cut), low))
    if best[1] is None:
        return float(-0.3 * g / (h + 1))
    name, cut, low = best[1]
    return (name, cut, _tree(x, names, grad, hess, rows[low], depth - 1, cuts), _tree(x, names, grad, hess, rows[~low], depth - 1, cuts))


def _apply(tree, columns, n):
    if isinstance(tree, float):
        return np.full(n, tree)
    name, cut, low, high = tree
    return np.where(columns[name] <= cut, _apply(low, columns, n), _apply(high, columns, n))


def boost(x: np.ndarray, y: np.ndarray, names: list[str], rounds: int = 16, depth: int = 3, precision: float = 0.99) -> Trees:
    """Gradient boosting on two thirds of the rows; thresholds per kind calibrated on the other third.

    A kind's threshold is the lowest score at which the precision on the calibration rows is at least
    ``precision``; a kind that reaches it nowhere adds nothing.
    """
    fit = np.arange(len(y)) % 3 > 0
    cuts = {n: (lambda u: (u[:-1] + u[1:]) / 2)(np.unique(np.quantile(x[:, j], np.linspace(0, 1, 17)))) for j, n in enumerate(names)}
    rate = y[fit].mean()
    out = Trees(bias=float(np.log((rate + 1e-3) / (1 - rate + 1e-3))))
    columns, total = {n: x[:, j] for j, n in enumerate(names)}, np.full(len(y), out.bias)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        tree = _tree(x, names, p - y, p * (1 - p), np.flatnonzero(fit), depth, cuts)
        out.trees.append(tree)
        total += _apply(tree, columns, len(y))
    for k in range(len(KINDS)):
        held = ~fit & (columns["kind"] == k)
        order = np.argsort(-total[held], kind="stable")
        score, right = total[held][order], y[held][order]
        share = np.cumsum(right) / np.arange(1, len(right) + 1)
        last = np.r_[score[1:] != score[:-1], True] if len(score) else np.zeros(0, bool)
        good = np.flatnonzero(last & (share >= precision))
        if len(good):
            out.thresholds[k] = float(score[good[-1]])
    return out


def _variants(kind: str, span: str, rng: random.Random) -> list[tuple[str, int]]:
    """Looser spellings of a base span (1), and numbers or words of like shape that are none (0)."""
    d = [c for c in span if c.isdigit()]
    r = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == "email":
        name, _, host = span.partition("@")
        at, dot = rng.choice([("(at)", "(dot)"), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" at ", " dot "), (" [at] ", "."), ("{at}", " dot ")])
        words = [rng.choice(("look", "was", "meet", "stay", "here")), rng.choice(("home", "night", "last", "the")), rng.choice(("end", "table", "place"))]
        return [(name + at + host.replace(".", dot), 1), (f"{words[0]} (at) {words[1]}.{words[2]}", 0), (f"{words[0]} @ {words[1]}.{words[2]}", 0), (f"{words[0]} at {words[1]} dot {words[2]} dot {words[1]}", 0)]
    if kind == "ip":
        six = ":".join("%x" % rng.randrange(4096, 65536) for _ in range(8))
        return [(six, 1), (":".join(r(2) for _ in range(rng.randrange(5, 8))), 0)]
    if kind == "card":
        groups = ["".join(d[i : i + 4]) for i in range(0, len(d), 4)]
        sep = rng.choice("./_")
        false = sep.join(r(4) for _ in range(4))
        return [(sep.join(groups), 1), (f"{r(4)}{sep}{r(4)}{sep}{r(4)}", 0), *([] if _passes(false) else [(false, 0)])]
    last = "".join(d[-10:])
    area, mid, end = last[:3], last[3:6], last[6:]
    form = rng.choice([f"({area}) {mid}-{end}", f"({area}) {mid} {end}", f"{area}-{mid}-{end}", f"1-{area}-{mid}-{end}", f"{area}.{mid}.{end}"])
    year = rng.randrange(1900, 2030)
    return [(form, 1), (f"{r(2)}-{year}-{r(4)}", 0), (f"{year} {rng.randrange(100, 999)} {r(3)}", 0), (f"{r(3)} {r(3)} {r(3)}", 0)]


def _passes(text: str) -> bool:
    d = [int(c) for c in text if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def _generic(n: int = GENERIC_SPANS) -> list[dict]:
    """Fixed base spans (k, t) of all kinds in turn, with the text to their left and right."""
    rng = random.Random(11)
    r = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    words = "please send the list to our office today and ask about your order or write it down here for them we can be reached at any time".split()
    out = []
    for i in range(n):
        kind = KINDS[i % len(KINDS)]
        if kind == "email":
            t = f"{rng.choice(words)}.{rng.choice(words)}{r(2)}@{rng.choice(('mail', 'post', 'office'))}.example.{rng.choice(('com', 'org', 'net'))}"
        elif kind == "ip":
            t = ".".join(str(rng.randrange(256)) for _ in range(4))
        elif kind == "card":
            head = "4" + r(14)
            t = next(head + d for d in "0123456789" if _passes(head + d))
        else:
            t = f"+1 ({rng.randrange(200, 1000)}) {rng.randrange(200, 1000)}-{r(4)}"
        text = [" ".join(rng.choice(words) for _ in range(6))[:CONTEXT] for _ in range(2)]
        out.append({"k": KINDS.index(kind), "t": t, "l": text[0] + " ", "r": " " + text[1]})
    return out


def learn(documents: DataFrame, limit: int = SAMPLE_SPANS) -> Trees:
    """Fit the trees. Base spans of the corpus, chosen by hash, and fixed ones give contexts and texts; each is respelt loosely,
    and joined by shapes that are no personal data, half of them with a cue word; the generators then propose
    candidates in these short texts, and a candidate is right if it covers the respelt span."""
    spark = documents.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    spans = (
        once(documents.select("text").where(F.col("text").rlike("[0-9]")), "b", base_spans(text))
        .where(F.size("b") > 0)
        .select("text", F.get(F.col("b"), F.pmod(F.xxhash64("text"), F.size("b")).cast("int")).alias("x"))
        .select(
            F.col("x.k").alias("k"),
            F.col("x.t").alias("t"),
            F.substring(F.col("text"), F.greatest(F.col("x.s") - CONTEXT, F.lit(0)) + 1, F.least(F.col("x.s"), F.lit(CONTEXT))).alias("l"),
            F.substring(F.col("text"), F.col("x.e") + 1, F.lit(CONTEXT)).alias("r"),
        )
        .where(F.length("t") <= 128)
        .orderBy(F.xxhash64("k", "t", "l", "r"), "k", "t", "l", "r")
        .limit(limit)
        .collect()
    )
    spans += _generic()
    rng, rows = random.Random(7), []
    cues = {"email": "email ", "ip": "ip ", "card": "card ", "phone": "call "}
    for s in spans:
        for kind in (KINDS[s["k"]], rng.choice(("phone", "card", "email", "ip"))):
            source = s["t"] if kind == KINDS[s["k"]] else {"email": "ab.12@mail.example.com", "ip": "", "card": "4" + "0" * 15, "phone": "+1 (555) 555-0100"}[kind]
            for variant, right in _variants(kind, source, rng):
                cue = cues[kind] if rng.random() < 0.4 else rng.choice(("order ", "version ", "", "", "")) if not right else ""
                left = s["l"].rstrip() + " " + cue
                rows.append((len(rows), left + variant + " " + s["r"].lstrip(), len(left), len(left) + len(variant), right))
    frame = spark.createDataFrame(rows, "i long, text string, a int, z int, y int")
    frame = once(frame, "c", candidates(F.col("text"))).select("i", "text", "a", "z", "y", F.explode("c").alias("c"))
    frame = frame.where((F.col("c.s") < F.col("z")) & (F.col("c.e") > F.col("a")))
    names = list(features(F.col("c"), F.col("text")))
    right = ((F.col("y") == 1) & (F.col("c.s") <= F.col("a") + 1) & (F.col("c.e") >= F.col("z"))).cast("double")
    got = frame.select("i", right.alias("y"), F.array(*features(F.col("c"), F.col("text")).values()).alias("x")).collect()
    got.sort(key=tuple)
    if not got:
        return Trees()
    return boost(np.array([g["x"] for g in got]), np.array([g["y"] for g in got]), names)


def find(documents: DataFrame, trees: Trees, text: str = "text") -> DataFrame:
    """The input with ``base`` and ``added``: arrays of spans (s, k, e, t), ends exclusive, k the kind's number."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    out = once(documents, "base", base_spans(body))
    none_type = "array<struct<s:int,k:int,e:int,t:string,p:double>>"
    none = F.array().cast(none_type)
    if not trees.thresholds:
        return once(out, "added", none)

    def overlaps(a, b):
        return (a["s"] < b["e"]) & (b["s"] < a["e"])

    def scored(c):
        cut = F.lit(None).cast("double")
        for k, value in trees.thresholds.items():
            cut = F.when(c["k"] == k, F.lit(value)).otherwise(cut)
        return F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"), c["t"].alias("t"), trees.score(features(c, body)).alias("p"), cut.alias("cut"))

    def rank(x):
        return F.struct((-x["p"]).alias("p"), x["s"].alias("s"), (-x["e"]).alias("e"), x["k"].alias("k"))

    def choose(pair):
        good = F.filter(F.transform(pair["c"], scored), lambda x: x["p"] >= x["cut"])
        ranked = F.array_sort(F.transform(good, lambda x: F.struct(rank(x).alias("rank"), *[x[n].alias(n) for n in ("s", "k", "e", "t", "p")])))
        plain = F.transform(ranked, lambda x: F.struct(*[x[n].alias(n) for n in ("s", "k", "e", "t", "p")])).cast(none_type)
        # Best first: one that overlaps an added span is dropped, and bars no other.
        added = F.aggregate(plain, none, lambda a, x: F.when(F.exists(a, lambda y: overlaps(x, y)), a).otherwise(F.concat(a, F.array(x))))
        return F.array_sort(added)

    free = F.filter(candidates(body), lambda c: ~F.exists(F.col("base"), lambda b: overlaps(b, c)))
    out = once(out, "free_candidates", free)
    added = F.when(F.size("free_candidates") == 0, none).otherwise(choose({"c": F.col("free_candidates")}))
    return once(out, "added", added).drop("free_candidates")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span, in order and without overlaps, replaced by its kind in brackets."""
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(
        spans,
        start,
        lambda a, x: F.when(x["s"] < a["at"], a).otherwise(
            F.struct(x["e"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, x["s"] - a["at"]), F.get(names, x["k"])).alias("out"))
        ),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))),
    )


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def count_kind(spans: Column, kind: int) -> Column:
    """Number of spans of one kind. The function has one argument: a second would be given the place in the array."""
    return F.size(F.filter(spans, lambda x: x["k"] == kind))


@query("op4_pii")
def op4_pii(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    out = find(docs, learn(docs))
    base, narrow = F.col("base"), lambda a: F.transform(a, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    return out.select(
        "doc_id",
        *[count_kind(base, n).cast("long").alias(f"n_{k}") for n, k in enumerate(KINDS)],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.sort_array(F.concat(narrow(base), narrow(F.col("added"))))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
