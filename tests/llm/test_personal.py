import hashlib
import re
import time

import numpy as np
from pyspark.sql import functions as F

from sortloom.llm import personal as P
from tests.llm.helpers import both, empty, odd

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(int(v) * (1 + k % 2), 10)) for k, v in enumerate(reversed(digits))) % 10 == 0


def brute(text):
    out = []
    for i, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            v = m.group()
            d = re.sub(r"[^0-9]", "", v)
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in v.split(".")) or kind == "card" and 12 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                out.append((m.start(), i, m.end(), kind))
    return sorted(out)


def test_base_equals_brute_force(spark):
    more = [(1, "4111111111111111 " * 60), (2, "a.b@c@d.e@f.g.h-i..j@k.l"), (3, "1.2.3.4.5.6.7.8 256.1.1.1 00000000001.2.3.4 " * 3), (4, "+1234567890 +1 (2) 3-4.5+6789012345 +49"), (5, "1-1 1--1 4111-1111-1111-1111-"), (6, "x" * 30000 + "@a.b " + "9" * 5000)]
    docs = both(spark, 1000).select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = sorted((tuple(r) for r in P.find_personal(docs).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256").collect()), key=str)
    want = []
    for r in docs.collect():
        b = brute(r["text"])
        sha = hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in b).encode()).hexdigest()
        want.append((r["doc_id"], *(sum(x[3] == k for x in b) for k in PATTERNS), sha))
    assert got == sorted(want, key=str)


def test_spans_hold_the_base_and_no_overlap_with_it(spark):
    docs = both(spark, 400)
    text = {}
    for r in docs.collect():
        text.setdefault(r["doc_id"], r["text"])
    for r in P.find_personal(docs).where("doc_id is not null").collect():
        spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r["spans"].split(",") if x)]
        base = {(k, s, e) for s, _, e, k in brute(text[r["doc_id"]])}
        assert base <= set(spans)
        for k, s, e in set(spans) - base:
            assert k in P.KINDS[4:] and not any(a < e and s < b for _, a, b in base)


def test_held_out_lines(spark):
    """Made-up lines of another seed: most personal data is found, little else is."""
    made = P.lines(600, 99)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(made)], "doc_id long, text string")
    hit = missed = wrong = 0
    for r in P.find_personal(docs).collect():
        spans = [tuple(map(int, x.split(":")[1:])) for x in r["spans"].split(",") if x]
        for s, e in made[r["doc_id"]][1]:
            found = any(a < e and s < b for a, b in spans)
            hit, missed = hit + found, missed + (not found)
        wrong += any(not any(a < e and s < b for s, e in made[r["doc_id"]][1]) for a, b in spans)
    assert hit / (hit + missed) > 0.8 and wrong < 0.1 * 300, (hit, missed, wrong)


def test_redaction(spark):
    text = "é mail bob.1@x.example.com, ip 10.0.0.1; card 4111 1111 1111 1111. +1 (555) 555-0100 end"
    docs = spark.createDataFrame([(1, text, "keep"), (2, None, "x"), (3, "clean text, 12 apples", "y")], "doc_id long, text string, spans string")
    got = {r["doc_id"]: r for r in P.redacted(docs).collect()}
    assert got[1]["text"] == "é mail [EMAIL], ip [IP]; card [CARD]. [PHONE] end"
    assert (got[1]["spans"], got[2]["text"], got[3]["text"]) == ("keep", None, "clean text, 12 apples")
    assert P.redacted(docs).columns == docs.columns


def test_no_python_on_executors(spark):
    plan = P.find_personal(both(spark, 10))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


#: Lines of other making than the model's own: text with personal data between braces, and text without.
WRITTEN = [
    "Please ring our office on {(020) 555-0199} before noon.", "My cell is {415-555-0134}, text me.", "Tel. {0711 4455667}", "Fax: {030/1234567} (evenings)", "you can phone {555.867.5309} any time", "mobile {07700 900123}",
    "Her social security number, {078-05-1120}, was printed.", "SSN: {219-09-9999}", "Contact {jane.doe (at) example (dot) org} for help", "write to {m.mustermann[at]firma.de} please", "mail {anna at uni dot edu} today", "reach me: {bob42(at)mail.net}",
    "Kontonummer IBAN {DE44 5001 0517 5407 3249 31}", "transfer to {GB29 NWBK 6016 1331 9268 19} now", "IBAN: {FR1420041010050500013M02606}", "device mac {00:1B:44:11:3A:B7} seen", "MAC {00-14-22-01-23-45}", "host {2001:0db8:85a3:0000:0000:8a2e:0370:7334} is up",
    "ip {fe80:0000:0000:0000:0202:b3ff:fe1e:8329}", "Call us at {1-800-555-0175}!", "llame al {91 555 12 34 56}", "appelez le {01 45 67 89 01}", "Visa card {4012.8888.8888.1881} expires soon", "fax number {(0221) 555 4433}", "whatsapp {0151 23456789}",
    "under {0341 9876543} you get our shop", "text me at {202 555 0143}", "ring {(0161) 496 0000} and ask for Ann", "die Nummer lautet {089 12 34 56 78}", "Mi móvil es {612 34 56 78}", "send it to {press(at)paper.co}", "ask {k.lee [at] lab dot edu}", "card no. {5500-0000-0000-0004}",
    "contact {sales [at] shop [dot] com}", "my number is {212 555 0187}", "phone {+49 (0) 89 / 12345-678}", "tel {555-0142 881}", "mobile: {06 12 34 56 78}",
]
HARMLESS = [
    "The meeting on 2021-03-04 took 45 minutes.", "version 10.4.22.1034 is out", "chapter 12, pages 340-355", "invoice 2019-004512 was paid", "a total of 1.250.000 copies", "ISBN 978-3-16-148410-0", "order 1234567890", "we met at noon at the dot on the map",
    "the score was 3-2 (5-4)", "about 300 000 people", "commit 9f2c1b7a", "see doi 10.1000/182.2020", "between 1990 and 2005", "ratio 16:9 at 60 frames", "lines 100-2000", "at 12:30:45 sharp", "12 apples and 7 pears", "price 1.999.00 in 2020",
]


def test_recall_on_lines_of_other_making(spark):
    rows = [(i, re.sub("[{}]", "", t)) for i, t in enumerate(WRITTEN + HARMLESS)]
    got = {r["doc_id"]: [tuple(map(int, x.split(":")[1:])) for x in r["spans"].split(",") if x] for r in P.find_personal(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    missed = [t for i, t in enumerate(WRITTEN) if not any(a < t.index("}") - 1 and t.index("{") < b for a, b in got[i])]
    wrong = [t for i, t in enumerate(HARMLESS) if got[i + len(WRITTEN)]]
    assert len(missed) <= 0.1 * len(WRITTEN) and len(wrong) <= 3, (missed, wrong)


def plain_spans(text, trees, limits, proposed):
    """All spans, pair by pair, from features of every proposal (kind, start, end, features)."""
    base = [(s, k, e) for s, k, e, _ in brute(text)]

    def score(f):
        total = 0.0
        for t in trees:
            total += float(P._value(t, np.array([f], float))[0])
        return total * P.RATE

    good = [(s, k, e) for k, s, e, f in proposed if score(f) >= limits[k] and not any(a < e and s < b for a, _, b in base)]
    stays = [x for x in good if not any((y[0], -y[2], y[1]) < (x[0], -x[2], x[1]) and y[0] <= x[0] and x[2] <= y[2] for y in good)]
    return sorted(base + stays)


def test_spans_equal_brute_force(spark):
    made = [(20000 + i, t) for i, (t, _) in enumerate(P.lines(300, 5))] + [(21000 + i, re.sub("[{}]", "", t)) for i, t in enumerate(WRITTEN + HARMLESS)]
    made += [(22000, " ".join(t for _, t in made)), (22001, "1.2.3.4 555 123 4567, a@b.cd at x dot yz; 4111 1111 1111 1111 9" * 3), (22002, "x" * 700 + " call 555-123-4567 " + "é" * 600 + " a (at) b.com")]
    docs = spark.createDataFrame(made, "doc_id long, text string").unionByName(both(spark, 150).select("doc_id", "text").where("doc_id is not null").dropDuplicates(["doc_id"]))
    trees, limits = P.trained(spark)
    proposed = {}
    for r in docs.select("doc_id", F.explode(P.proposals(F.coalesce("text", F.lit("")))).alias("p")).collect():
        proposed.setdefault(r["doc_id"], []).append((r["p"]["k"], r["p"]["s"], r["p"]["e"], list(r["p"]["f"])))
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in P.find_personal(docs).collect():
        want = plain_spans(text[r["doc_id"]], trees, limits, proposed.get(r["doc_id"], []))
        assert r["spans"] == ",".join(f"{P.KINDS[k]}:{s}:{e}" for s, k, e in want)
    # The features of context are those of the text around, wherever a piece of it ends.
    for d, each in proposed.items():
        low = text[d]
        for _, s, e, f in each:
            f = dict(zip(P.FEATURES, f, strict=True))
            assert f["length"] == e - s and f["digits"] == len(re.findall("[0-9]", low[s:e])) and f["helpful"] == bool(re.search(P.HELPFUL, low[max(0, s - P.CONTEXT) : s].lower()))


def test_time_grows_with_the_text(spark):
    """20,000 matches of several kinds in one text, and redaction; twice as many take no more than about twice as long."""
    line, seconds = "ab@cd.ef 10.0.0.1 call 0123/456 7890, a at b dot com ", []
    P.trained(spark)
    for n in (100, 5000, 10000):
        docs = spark.createDataFrame([(1, line * n)], "doc_id long, text string")
        at = time.perf_counter()
        row = P.find_personal(docs).first()
        assert (row["n_email"], row["n_ip"]) == (n, n) and row["spans"].count(",") == 4 * n - 1
        assert P.redacted(docs).first()["text"].startswith("[EMAIL] [IP] call [NUMBER], [ADDRESS] [EMAIL]")
        seconds.append(time.perf_counter() - at)
    assert seconds[2] < 60 and seconds[2] - seconds[0] < 3 * (seconds[1] - seconds[0]) + 3, seconds


def test_odd_and_no_rows(spark):
    assert P.find_personal(empty(spark)).count() == 0 and P.find_personal(odd(spark)).count() == odd(spark).count()
    assert P.redacted(odd(spark)).count() == odd(spark).count()
