"""Personal data in whole texts, natively: high-recall generators propose overlapping spans, boosted trees
score them by format and context, and calibrated thresholds select what is redacted.

The base patterns (email, ip, card, phone) are always selected. The generators propose more: written-out addresses,
runs of digits with separators, account numbers, colon-separated addresses. A span proposed by them is
added if the trees' score passes its kind's threshold and it neither overlaps a base span nor lies
within another added one.

The trees are gradient-boosted here (ROUNDS of DEPTH) from SAMPLES made-up lines with a fixed seed, whose
features come from the very expressions that score documents; half of the lines set the thresholds, at the
least score from which on PRECISION of the proposals are personal. Everything that touches documents is a native
expression on the row, so no document leaves its task.

Patterns are written with possessive repeats and start only where a run starts (or the last match ended), which changes no match
but keeps the work linear in long runs.

Defined results: null text counts as empty; positions are code points, the end exclusive; texts of any
length are searched whole; repeated rows get equal results; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import random
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sortloom.llm.common import between, bound, matches, pieces, scan, table

KINDS = ("email", "ip", "card", "phone", "address", "number", "account", "hosts")
#: Per kind: what a text must hold (a literal, or a pattern), the pattern, and characters that separate its digits.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Generators: at least seven digits in a run; other people's ways of writing an address; account numbers; groups of hexadecimal digits.
NUMBER = r"[+(]?[0-9][0-9().\x20/-]{5,}[0-9]"
ADDRESS = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|\x20at\x20|@)\x20?[A-Za-z0-9-]++\x20?(?:\(dot\)|\[dot\]|\x20dot\x20|\.)\x20?[A-Za-z]{2,}+"
ACCOUNT = r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?\b"
HOSTS = r"(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}"
GENERATORS = {"address": ("@|\\((?:at)\\)|\\[at\\]|\\x20dot\\x20", ADDRESS), "number": ("[0-9][0-9().\\x20/-]{5}", NUMBER), "account": ("[A-Z]{2}[0-9]{2}\\x20?[A-Z0-9]{4}", ACCOUNT), "hosts": ("[0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{1,4}[:-]", HOSTS)}
CONTEXT = 28
HELPFUL = r"phone|t[eé]l(?:[eé]f|\b)|call|mobile|cell|\bring\b|dial|text me|sms|fax|whatsapp|llam|appel|ruf|number|handy|m[oó]vil|portable|card|visa|iban|account|konto|cuenta|compte|ssn|social security|passport|mail|contact|reach|ip\b|address|host|mac\b|numéro|nummer|número"
HARMFUL = r"version|isbn|issn|order|invoice|page|chapter|section|article|serial|commit|sha|hash|doi|total|sum|price|ratio|score|time|date|year|lines?\b|id\b"
FEATURES = ("length", "digits", "letters", "groups", "longest", "plus", "luhn", "at", "dots", "spaces", "dashes", "helpful", "harmful", "joined", "repeat", "date")
SAMPLES, ROUNDS, DEPTH, RATE, PRECISION, SEED = 4000, 28, 3, 0.3, 0.97, 11


# ---- native spans --------------------------------------------------------------------------------------------


def none() -> Column:
    return F.expr("cast(array() as array<struct<s: int, e: int, v: string>>)")


def digits_of(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]+", "")


def luhn(digits: Column) -> Column:
    """Whether the digits pass Luhn's check. Twice a digit, less 9 if over 9, at every second from the right."""
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        F.lit(0),
        lambda acc, i: acc + F.element_at(F.array(*[F.array(*map(F.lit, row)) for row in ((0, 1, 2, 3, 4, 5, 6, 7, 8, 9), (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))]), 1 + ((n - i) % 2).cast("int"))[F.coalesce(F.substr(digits, i, F.lit(1)).try_cast("int"), F.lit(0))],
    )
    return (n > 0) & (total % 10 == 0)


def base_spans(text: Column) -> dict[str, Column]:
    parts = lambda x: F.split(x["v"], r"\.", -1)
    return {
        "email": F.when(F.contains(text, F.lit("@")), matches(text, EMAIL)).otherwise(none()),
        "ip": F.when(F.rlike(text, F.lit(r"[0-9]\.[0-9]++\.[0-9]")), F.filter(matches(text, IP), lambda x: F.forall(parts(x), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False))))).otherwise(none()),
        "card": F.when(F.rlike(text, F.lit(r"[0-9](?:[\x20-]?+[0-9]){11}")), F.filter(matches(text, CARD), lambda x: F.length(digits_of(x["v"])).between(12, 19) & luhn(digits_of(x["v"])))).otherwise(none()),
        "phone": F.when(F.contains(text, F.lit("+")), F.filter(matches(text, PHONE), lambda x: F.length(digits_of(x["v"])).between(9, 15))).otherwise(none()),
    }


# ---- proposals, features and trees ---------------------------------------------------------------------------


def feature_struct(cut: Column, x: Column) -> Column:
    """Of a match x, in a text cut into pieces."""
    v, s, e = x["v"], x["s"], x["e"]
    digits = digits_of(v)
    near = F.lower(between(cut, F.greatest(s - CONTEXT, F.lit(0)), s))
    beside = F.concat(between(cut, F.greatest(s - 1, F.lit(0)), s), F.lit("\n"), between(cut, e, e + 1))
    runs = F.filter(F.split(v, "[^0-9]+", -1), lambda r: r != "")
    values = {
        "length": F.length(v), "digits": F.length(digits), "letters": F.length(F.regexp_replace(v, "[^A-Za-z]+", "")), "groups": F.size(runs),
        "longest": F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)), "plus": F.rlike(v, F.lit(r"^[+(]")), "luhn": F.length(digits).between(12, 19) & luhn(digits),
        "at": F.rlike(v, F.lit("@|at")), "dots": F.length(v) - F.length(F.translate(v, ".", "")), "spaces": F.length(v) - F.length(F.translate(v, " ", "")),
        "dashes": F.length(v) - F.length(F.translate(v, "-:", "")), "helpful": F.rlike(near, F.lit(HELPFUL)), "harmful": F.rlike(near, F.lit(HARMFUL)),
        "joined": F.rlike(beside, F.lit(r"[\p{L}0-9_$%#=/]")), "repeat": F.rlike(v, F.lit(r"([0-9])\1{5}")), "date": F.rlike(v, F.lit(r"^(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|^[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)?[0-9]{2}\b")),
    }
    return F.struct(*[values[f].cast("int").alias(f) for f in FEATURES])


def proposals(text: Column) -> Column:
    """array<struct<k, s, e, f>>: kind, place and features of every span that a generator proposes."""
    empty = F.expr(f"cast(array() as array<struct<k: int, s: int, e: int, f: struct<{', '.join(f'{x}: int' for x in FEATURES)}>>>)")

    def of_kind(k: int, pattern: str) -> Column:
        of = lambda cut: F.transform(matches(text, pattern), lambda x: F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e"), feature_struct(cut, x).alias("f")))
        return bound(pieces(text), of)

    return F.concat(*[F.when(F.rlike(text, F.lit(sign)), of_kind(KINDS.index(kind), pattern)).otherwise(empty) for kind, (sign, pattern) in GENERATORS.items()])


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> tuple | float:
    """A tree (feature, threshold, left, right) for gradients g and curvatures h; at the leaves a step."""
    leaf = round(float(-g.sum() / (h.sum() + 1.0)), 9)
    if depth == 0 or len(g) < 20:
        return leaf
    best, whole = (1e-3, -1, 0), g.sum() ** 2 / (h.sum() + 1.0)
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        gs, hs, v = np.cumsum(g[order]), np.cumsum(h[order]), x[order, j]
        cut = np.flatnonzero(v[1:] > v[:-1])
        if len(cut):
            gain = gs[cut] ** 2 / (hs[cut] + 1) + (gs[-1] - gs[cut]) ** 2 / (hs[-1] - hs[cut] + 1) - whole
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = float(gain[i]), j, int(v[cut[i]])
    if best[1] < 0:
        return leaf
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], _grow(x[low], g[low], h[low], depth - 1), _grow(x[~low], g[~low], h[~low], depth - 1)


def _value(tree: tuple | float, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    j, cut, low, high = tree
    return np.where(x[:, j] <= cut, _value(low, x), _value(high, x))


def _as_column(tree: tuple | float, f: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    j, cut, low, high = tree
    return F.when(f[FEATURES[j]] <= cut, _as_column(low, f)).otherwise(_as_column(high, f))


def _line(r: random.Random) -> tuple[str, list[tuple[int, int]]]:
    """A made-up line and the places of personal data in it."""
    word = lambda: "".join(r.choice(("an", "er", "th", "on", "re", "la", "que", "ie", "st", "ou", "de", "mi")) for _ in range(r.randint(1, 4)))
    prose = lambda n: " ".join(word() + r.choice(("", "", "", ",", ".")) for _ in range(r.randint(1, n)))
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def valid(n: int) -> str:
        x = r.choice("3456") + d(n - 2)
        return next(x + c for c in "0123456789" if sum(sum(divmod(int(v) * (1 + k % 2), 10)) for k, v in enumerate(reversed(x + c))) % 10 == 0)

    def card() -> str:
        x, sep = valid(16), r.choice((" ", "-", "", "."))
        return sep.join(x[i : i + 4] for i in range(0, 16, 4))

    phone = lambda: r.choice((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(3)}/{d(7)}", f"0{d(2)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+{d(2)} {d(3)} {d(6)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"{d(2)} {d(3)} {d(2)} {d(2)}", f"{d(2)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(4)} {d(6)}", f"1-{d(3)}-{d(3)}-{d(4)}", f"({d(4)}) {d(3)} {d(4)}", f"0{d(3)} {d(8)}", f"{d(3)}-{d(4)} {d(3)}"))
    asked = lambda: r.choice(("call ", "call us at ", "phone: ", "Tel ", "Tel. ", "mobile ", "fax ", "Fax: ", "contact ", "my number is ", "ring me on ", "cell is ", "dial ", "text me at ", "whatsapp ", "Telefon ", "Handy: ", "rufen Sie ", "llame al ", "teléfono ", "appelez le ", "tél. ", "the number: ", "reach us on ", "phone number ", ""))
    name = lambda: r.choice((word(), f"{word()}{d(2)}", f"{word()}.{word()}", f"{word()}.{d(2)}", f"{word()[0]}.{word()}", f"{word()}_{word()}"))
    ends = lambda: r.choice(("com", "org", "net", "de", "fr", "es", "edu", "io", "info"))
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    personal = (
        lambda: (asked(), phone()), lambda: (asked(), phone()), lambda: (r.choice(("card ", "visa ", "")), card()), lambda: (r.choice(("SSN ", "social security ", "ssn: ")), f"{d(3)}-{d(2)}-{d(4)}"),
        lambda: (r.choice(("mail ", "reach ", "contact ", "write to ", "")), f"{name()}{r.choice((' (at) ', '(at)', '[at]', ' [at] '))}{word()}{r.choice((' (dot) ', '[dot]', ' dot ', '.'))}{ends()}"),
        lambda: (r.choice(("mail ", "reach ", "contact ", "write to ")), f"{name()} at {word()} dot {ends()}"),
        lambda: (r.choice(("IBAN ", "Konto ", "account ", "")), f"DE{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}"), lambda: (r.choice(("IBAN ", "")), f"FR{d(23)}"),
        lambda: (r.choice(("host ", "ip ", "address ", "")), ":".join(hexes(4) for _ in range(8))), lambda: (r.choice(("mac ", "host ")), ":".join(hexes(2) for _ in range(6))),
    )
    harmless = (
        lambda: d(16), lambda: d(r.randint(8, 20)), lambda: d(r.randint(20, 80)), lambda: " ".join(d(r.randint(1, 4)) for _ in range(r.randint(6, 30))), lambda: f"{r.randint(1900, 2030)}-{d(2)}-{d(2)}", lambda: f"{d(2)}.{d(2)}.{r.randint(1900, 2030)}", lambda: f"version {d(1)}.{d(2)}.{d(4)}.{d(3)}", lambda: f"ISBN 978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", lambda: f"ISBN {d(10)}",
        lambda: f"order {d(10)}", lambda: f"invoice {d(4)}-{d(6)}", lambda: f"id {d(12)}", lambda: f"pages {d(3)}-{d(3)}", lambda: f"{d(3)} {d(3)} {d(3)}", lambda: f"total {d(3)}.{d(3)}.{d(3)}", lambda: f"{d(2)}/{d(2)}/{r.randint(1900, 2030)} {d(2)}", lambda: f"doi 10.{d(4)}/{d(6)}.{d(3)}",
        lambda: f"12:30:45:{d(2)}:{d(2)} time", lambda: f"token = {hexes(40)}", lambda: f"{d(1)}.{d(6)} {d(1)}.{d(5)}", lambda: f"commit {hexes(12)}", lambda: f"look at the dot on {word()} at {word()} dot {word()}", lambda: f"AB12 CDEF{d(4)} section", lambda: f"{d(4)} {d(4)} {d(4)} {d(4)}",
        lambda: f"hash {':'.join(hexes(2) for _ in range(20))}", lambda: f"ratio {d(3)}/{d(5)}", lambda: f"{d(4)}-{d(4)} {d(4)}-{d(4)}", lambda: f"MM{d(2)} ABCD EFGH IJKL {word()}",
    )
    head, tail = (prose(6) + " " if r.random() < 0.8 else ""), " " + prose(6)
    if r.random() < 0.5:
        a, v = r.choice(personal)()
        return head + a + v + tail, [(len(head + a), len(head + a + v))]
    return head + r.choice(harmless)() + tail, []


_models: dict[int, tuple[list, dict[int, float]]] = {}


@cache
def lines(samples: int = SAMPLES, seed: int = SEED) -> list[tuple[str, list[tuple[int, int]]]]:
    r = random.Random(seed)
    return [_line(r) for _ in range(samples)]


def trained(spark: SparkSession) -> tuple[list, dict[int, float]]:
    """(trees, threshold of each kind's score)."""
    if SEED in _models:
        return _models[SEED]
    made = lines()
    text = json.dumps([{"i": i, "t": t} for i, (t, _) in enumerate(made)])
    rows = spark.range(1).select(F.explode(F.from_json(F.lit(text), "array<struct<i: int, t: string>>")).alias("x")).select("x.i", "x.t")
    got = rows.select("i", F.explode(proposals(F.col("t"))).alias("p")).select("i", "p.k", "p.s", "p.e", "p.f.*").orderBy("i", "k", "s").collect()
    x = np.array([[r[f] for f in FEATURES] for r in got], float)
    kinds = np.array([r["k"] for r in got])
    y = np.array([any(min(r["e"], e) - max(r["s"], s) >= 0.8 * max(e - s, r["e"] - r["s"]) for s, e in made[r["i"]][1]) for r in got], float)
    fit = np.array([r["i"] % 2 == 0 for r in got])
    trees, score = [], np.zeros(len(x))
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(x[fit], (p - y)[fit], (p * (1 - p))[fit], DEPTH)
        trees.append(tree)
        score = score + RATE * _value(tree, x)
    limits = {}
    for k in range(4, len(KINDS)):
        own = ~fit & (kinds == k)
        order = np.argsort(-score[own], kind="stable")
        hits = np.cumsum(y[own][order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(hits >= PRECISION)
        limits[k] = max(0.0, float(score[own][order][good[-1]]) - 1e-6) if len(good) else float("inf")
    _models[SEED] = trees, limits
    return trees, limits


SPAN = "struct<s: int, k: int, e: int>"


def apart(spans: Column, base: Column) -> Column:
    """The spans (by start) that overlap none of base: a scan to the right knows how far base spans reach, one to the left where the next begins."""
    named = lambda x, own: F.struct(x["s"].alias("s"), F.lit(own).alias("own"), x["e"].alias("e"), x["k"].alias("k"))
    both = F.sort_array(F.concat(F.transform(base, lambda x: named(x, 0)), F.transform(spans, lambda x: named(x, 1))))
    kind = "struct<s: int, own: int, e: int, k: int, hit: boolean>"
    marked = lambda x, hit: F.struct(x["s"].alias("s"), x["own"].alias("own"), x["e"].alias("e"), x["k"].alias("k"), hit.alias("hit"))
    right = scan(both, F.lit(-1), kind, lambda reach, x: (F.when(x["own"] == 0, F.greatest(reach, x["e"])).otherwise(reach), marked(x, reach > x["s"])))
    left = scan(F.reverse(right), F.lit(2**31 - 1), kind, lambda begin, x: (F.when(x["own"] == 0, x["s"]).otherwise(begin), marked(x, x["hit"] | (begin < x["e"]))))
    free = F.filter(F.reverse(left), lambda x: (x["own"] == 1) & ~x["hit"])
    return F.transform(free, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))


def score_of(trees: list, f: Column) -> Column:
    """What the trees add up to for features f."""
    return sum((_as_column(t, f) for t in trees), F.lit(0.0)) * RATE


def picked_spans(spark: SparkSession, text: Column, base: Column) -> Column:
    """array<struct<s, k, e>>: proposals over their kind's threshold and outside base spans."""
    trees, limits = trained(spark)
    limit = F.array(*[F.lit(limits[k]) for k in sorted(limits)])
    good = F.filter(proposals(text), lambda x: score_of(trees, x["f"]) >= F.element_at(limit, x["k"] - 3))
    spans = F.transform(good, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    return bound(spans, lambda found: F.when((F.size(found) > 0) & (F.size(base) > 0), apart(found, base)).otherwise(found))


def outermost(spans: Column) -> Column:
    """Those that lie within no other; of equal ones the first kind's."""
    # By start, longest first: a span lies within an earlier one if one of these ends at or after its end.
    order = F.transform(F.sort_array(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("n"), x["k"].alias("k")))), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), (-x["n"]).alias("e")))
    kept = scan(order, F.lit(-1), SPAN, lambda reach, x: (F.greatest(reach, x["e"]), F.when(x["e"] > reach, x)))
    return F.filter(kept, lambda x: x.isNotNull())


def with_spans(docs: DataFrame) -> DataFrame:
    """docs (with a column text), and base and spans: array<struct<s, k, e>> by start, then kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    empty = F.expr("cast(array() as array<struct<s: int, k: int, e: int>>)")

    def numbered(i: int, x: Column) -> Column:
        return F.transform(x, lambda m: F.struct(m["s"].alias("s"), F.lit(i).alias("k"), m["e"].alias("e")))

    found = [numbered(i, x) for i, x in enumerate(base_spans(text).values())]
    sign = F.rlike(text, F.lit("[0-9@]|\\((?:at)\\)|\\[at\\]|\\x20dot\\x20|[0-9A-Fa-f]{2}[:-]"))
    rows = docs.withColumn("base", F.when(F.rlike(text, F.lit("[0-9@+]")), F.sort_array(F.concat(*found))).otherwise(empty))
    rows = rows.withColumn("picked", F.when(sign, picked_spans(docs.sparkSession, text, F.col("base"))).otherwise(empty))
    return rows.withColumn("spans", F.when(F.size("picked") > 0, F.sort_array(F.concat("base", outermost(F.col("picked"))))).otherwise(F.col("base"))).drop("picked")


def written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def find_personal(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of each row's whole text."""
    rows = with_spans(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.k = {i})) as bigint) as n_{k}") for i, k in enumerate(KINDS[:4])]
    return rows.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets; overlapping spans by the first one's. Other columns stay."""
    rows = with_spans(docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")))
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    # Each span with the place where the text that is still to be written begins; spans that begin before it are passed over.
    step = lambda at, x: (F.greatest(at, x["e"]), F.when(x["s"] >= at, F.struct(at.alias("at"), x["s"].alias("s"), x["k"].alias("k"))))
    cuts = F.filter(scan(F.col("spans"), F.lit(0), "struct<at: int, s: int, k: int>", step), lambda x: x.isNotNull())
    end = F.array_max(F.transform("spans", lambda x: x["e"]))
    whole = bound(pieces(F.col("text")), lambda cut: F.concat(F.array_join(F.transform(cuts, lambda x: F.concat(between(cut, x["at"], x["s"]), tags[x["k"]])), ""), between(cut, end, F.length("text"))))
    text = F.when(F.size("spans") > 0, whole).otherwise(F.col("text"))
    return rows.select(*[text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(table(spark, sf_dir, "documents"))
