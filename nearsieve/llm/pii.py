"""Personal data in whole texts, by rules and by boosted trees over candidates.

Base rules find e-mail addresses, IPv4 addresses, card numbers and phone
numbers. Generators with high recall propose further spans of each kind, which
may overlap: addresses with a spelled-out at and dot, digit groups of any
plausible length and separators, quads with bracketed dots. Trees score each
from its format and the words around it, and a threshold per kind, calibrated
on rows that were held out of the fit, selects the spans that are added.

The trees are fitted in numpy on SEEDS generated rows of known label, a fixed
number; all work on the corpus is DataFrame expressions of one narrow stage.
"""

from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearsieve.llm.boosting import fit, threshold
from nearsieve.llm.env import read_table

KINDS = ["email", "ip", "card", "phone"]
SEEDS, PRECISION, CONTEXT = 2400, 0.98, 24

_LOCAL = "[A-Za-z0-9._%+-]"
#: Equal to the base rules, in a form that neither backtracks over a long run nor recurses on it.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?=\.[A-Za-z0-9-])(?:[A-Za-z0-9-]|\.(?=[A-Za-z0-9-]))++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text that lacks this holds no match of the rule.
_NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
GENERATORS = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+(?:@|\x20?[(\[]at[)\]]\x20?|\x20at\x20)[A-Za-z0-9-]{{1,63}}+(?:(?:\.|\x20?[(\[]dot[)\]]\x20?|\x20dot\x20)[A-Za-z0-9-]{{1,63}}+){{1,8}}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:(?:\.|\x20?\[\.\]\x20?)[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])(?<![0-9][\x20.-])[0-9](?:[\x20.-]?[0-9]){11,18}(?![\x20.-]?[0-9])",
    "phone": r"(?<![0-9+(])(?:\+|\()?[0-9](?:[\x20().-]{0,2}[0-9]){6,14}(?![\x20().-]{0,2}[0-9])",
}
_GENERATES = {"email": r"@|\bat[)\]\x20]", "ip": r"[0-9](?:\.|\x20?\[\.\]\x20?)[0-9]", "card": "[0-9]", "phone": "[0-9]"}


def located(text: Column, pattern: str, needs: str) -> Column:
    """``array<struct<start, end, raw>>`` of all leftmost non-overlapping matches, in code points."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("raw"))
    kind = "struct<at:int,found:array<struct<start:int,end:int,raw:string>>>"
    zero = F.from_json(F.lit('{"at":0,"found":[]}'), kind)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["raw"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["raw"].alias("raw")))
        return F.struct(F.coalesce(end, start).alias("at"), F.when(x["raw"].isNull(), acc["found"]).otherwise(F.concat(acc["found"], one)).alias("found"))

    none = F.from_json(F.lit("[]"), "array<struct<start:int,end:int,raw:string>>")
    return F.when(text.rlike(needs), F.aggregate(parts, zero, step, lambda acc: acc["found"])).otherwise(none)


def digits(raw: Column) -> Column:
    return F.regexp_replace(raw, "[^0-9]", "")


def small_parts(raw: Column) -> Column:
    """All numbers of a dotted quad are at most 255."""
    bare = F.transform(F.split(raw, r"[^0-9]+"), lambda x: F.regexp_replace(x, "^0+", ""))
    return F.forall(bare, lambda x: (F.length(x) < 3) | ((F.length(x) == 3) & (x <= "255")))


_KEEPS = {
    "email": lambda raw: F.lit(True),
    "ip": small_parts,
    "card": lambda raw: F.call_function("luhn_check", digits(raw)),
    "phone": lambda raw: F.length(digits(raw)).between(9, 15),
}


def base_spans(text: Column) -> dict[str, Column]:
    def kept(kind: str) -> Column:
        return F.filter(located(text, BASE[kind], _NEEDS[kind]), lambda x: _KEEPS[kind](x["raw"]))

    return {k: kept(k) for k in KINDS}


def features(raw: Column, before: Column, after: Column, other: Column) -> dict[str, Column]:
    """Integers of a candidate's format and of the text around it; ``other``: it shares characters with a base span of another kind."""
    d, near = digits(raw), F.lower(before)
    count = lambda s: F.length(raw) - F.length(F.translate(raw, s, ""))
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    return {
        "n_digits": F.length(d),
        "n_chars": F.length(raw),
        "n_groups": F.size(F.split(raw, "[^0-9]+")),
        "n_dots": count("."),
        "n_gaps": count(" -"),
        "n_brackets": count("()[]"),
        "plus": flag(raw.startswith("+")),
        "luhn": flag(F.call_function("luhn_check", d)),
        "brand": F.coalesce(F.substring(d, 1, 1).try_cast("int"), F.lit(-1)),
        "small_parts": flag(small_parts(raw)),
        "at_sign": flag(raw.contains("@")),
        "other": flag(other),
        "ending": F.length(F.regexp_extract(raw, "([A-Za-z]+)$", 1)),
        "fours": flag(raw.rlike(r"^[0-9]{4}([\x20.-]?[0-9]{4}){2,}")),
        "three_four": flag(raw.rlike(r"[0-9]{3}[\x20.-][0-9]{4}$")),
        "dated": flag(raw.rlike(r"(^|[^0-9])(19|20)[0-9]{2}[.-](0[1-9]|1[0-2])[.-]")),
        "glued": flag(before.rlike(r"[\p{L}\p{N}_/=#.-]$")) + flag(after.rlike(r"^[\p{L}\p{N}_/=-]")),
        "says_card": flag(near.rlike(r"\b(card|visa|master|amex|credit|debit|karte|tarjeta|carte)")),
        "says_phone": flag(near.rlike(r"\b(phone|tel|call|mobile|fax|cell|whatsapp|sms)")),
        "says_mail": flag(near.rlike(r"\b(e-?mail|contact|write to|reach)")),
        "says_host": flag(near.rlike(r"\b(ip|host|server|address|login from|ping)\b")),
        "says_other": flag(near.rlike(r"\b(order|invoice|isbn|version|ver|v|release|serial|sku|part|page|section|chapter|issue|build|total|price|look|meet|arrived)\b")),
    }


def seeds(count: int = SEEDS, seed: int = 5) -> list[dict]:
    """Generated candidates of known label, from formats of personal data and of what resembles it."""
    r = random.Random(seed)
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randint(3, 8)))
    spaced = lambda s, size, sep: sep.join(s[i : i + size] for i in range(0, len(s), size))

    def luhn(n: int, good: bool) -> str:
        s = r.choice("3456") + num(n - 2)
        t = sum(sum(divmod(int(c) * (2 if i % 2 == 0 else 1), 10)) for i, c in enumerate(reversed(s)))
        check = -t % 10
        return s + str(check if good else (check + r.randint(1, 9)) % 10)

    plain = lambda: r.choice([word() + " ", word() + " " + word() + ", ", word() + ". "])
    says = lambda *w: r.choice(w) + r.choice([" ", ": ", " is ", " no. ", " number "])
    out = []
    for i in range(count):
        kind, yes = KINDS[i % 4], (i // 4) % 2
        before, after = plain(), r.choice([" ", ". ", ", ", "\n"])
        if kind == "email":
            at, dot = r.choice([("@", "."), (" at ", " dot "), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", ".")])
            end = r.choice(["com", "org", "net", "de", "io", "example"])
            if yes:
                raw, before = f"{word()}{r.choice(['', '.' + word(), num(2)])}{at}{word()}{dot}{end}", r.choice([before, says("email", "contact", "write to")])
            else:
                raw = r.choice([f"{word()} at {word()}.{word().capitalize()}", f"{word()}@{num(1)}.{num(1)}.{num(1)}", f"{word()} at {word()}.{num(2)}", f"look at {word()}.{num(3)}"])
        elif kind == "ip":
            if yes:
                sep = r.choice([".", "[.]", " [.] "])
                raw, before = sep.join(str(r.randint(1, 255)) for _ in range(4)), r.choice([before, says("server", "host", "ip")])
            else:
                raw, before = r.choice([(".".join(num(3) for _ in range(4)), plain()), (".".join(num(1) for _ in range(4)), says("version", "release", "build", "section")), (".".join(str(r.randint(256, 999)) for _ in range(4)), plain())])
        elif kind == "card":
            if yes:
                raw = luhn(r.choice([15, 16, 16, 16, 19]), r.random() < 0.8)
                raw, before = r.choice([raw, spaced(raw, 4, " "), spaced(raw, 4, "-"), spaced(raw, 4, ".")]), r.choice([before, says("card", "visa", "credit card")])
                if raw.isdigit() and "card" not in before and "visa" not in before:
                    raw = luhn(16, True)
            else:
                raw, before = r.choice([(num(r.randint(12, 19)), says("order", "serial", "invoice", "sku")), ("978" + num(10), says("isbn")), (num(r.randint(12, 14)), plain()), (luhn(16, False), plain()), (f"20{num(2)}-0{r.randint(1, 9)}-1{num(1)} 1{num(1)}-{num(2)}-{num(2)}", plain()), (num(16), word() + "="), (f"{num(3)}-{num(4)} {num(3)}.{num(3)}.{num(2)}.{num(3)}", plain() + "+1 (" + num(3) + ") ")])
        else:
            if yes:
                n = num(3), num(3), num(4)
                raw = r.choice(["+1 ({}) {}-{}", "({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "+44 {} {} {}", "{} {} {}"]).format(*n)
                before = r.choice([before, says("phone", "tel", "call", "mobile")]) if raw[0] in "+(" else says("phone", "tel", "call", "mobile", "fax")
                if r.random() < 0.15:
                    raw, before = num(10), says("phone", "tel", "call")
            else:
                raw, before = r.choice([(num(r.randint(7, 15)), plain()), (num(10), says("order", "invoice", "isbn")), (f"20{num(2)}-0{r.randint(1, 9)}-1{num(1)}", plain()), (f"{num(3)}.{num(3)}.{num(3)}", says("version", "total")), (f"{num(3)}-{num(4)}", says("part", "page")), (f"{num(2)}.{num(3)}.{num(3)}.{num(2)}", plain()), (spaced(num(12), 4, " "), plain())])
        out.append({"kind": kind, "raw": raw, "before": before[-CONTEXT:], "after": after, "other": int(not yes and r.random() < 0.4), "label": yes})
    return out


def fitted(spark: SparkSession) -> dict[str, tuple[str, float]]:
    """The trees of each kind as SQL over a struct ``f``, and the threshold of their sum.

    Seeds go through the same feature expressions as the corpus; every third
    is held out of the fit and calibrates the threshold.
    """
    rows = seeds()
    table = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), "array<struct<kind:string,raw:string,before:string,after:string,other:int,label:int>>")).alias("s")).select("s.*")
    given = features(F.col("raw"), F.col("before"), F.col("after"), F.col("other"))
    names = list(given)
    found = table.select("kind", "label", *[c.cast("int").alias(n) for n, c in given.items()]).collect()  # SEEDS rows
    out = {}
    for kind in KINDS:
        own = [r for r in found if r["kind"] == kind]
        x, y = np.array([[r[n] for n in names] for r in own]), np.array([r["label"] for r in own])
        held = np.arange(len(y)) % 3 == 2
        trees = fit(x[~held], y[~held], names)
        out[kind] = trees.sql("x.f."), threshold(trees.score(x[held]), y[held], PRECISION)
    return out


_SPAN = "array<struct<kind:string,start:int,end:int>>"


def with_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``pii_base`` and ``pii_spans``: arrays of ``(kind, start, end)``, by kind as in
    KINDS, then start. Offsets are code points, the end exclusive.

    Base spans are always among pii_spans; an added span overlaps no base span
    of its own kind. A null or empty text has two empty arrays. Rows and all
    other columns stay as they are (columns of these two names are replaced).
    """
    models = fitted(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.drop("pii_base", "pii_spans")
    own = {f"_base_{k}": c for k, c in base_spans(text).items()}
    found = docs.select("*", *[c.alias(n) for n, c in own.items()], *[located(text, GENERATORS[k], _GENERATES[k]).alias(f"_more_{k}") for k in KINDS])
    base, every = [], []

    def described(kind: str) -> Column:
        def meets(x: Column, k: str) -> Column:
            return F.exists(F.col(f"_base_{k}"), lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))

        new = F.filter(F.col(f"_more_{kind}"), lambda x: ~meets(x, kind))

        def one(x: Column) -> Column:
            before = F.substring(text, F.greatest(x["start"] - CONTEXT + 1, F.lit(1)), F.least(x["start"], F.lit(CONTEXT)))
            other = F.array_contains(F.array(*[meets(x, k) for k in KINDS if k != kind]), True)
            given = features(x["raw"], before, F.substring(text, x["end"] + 1, F.lit(8)), other)
            return F.struct(x["start"].alias("start"), x["end"].alias("end"), F.struct(*[c.cast("int").alias(n) for n, c in given.items()]).alias("f"))

        return F.transform(new, one)

    def named(spans: Column, kind: str) -> Column:
        return F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    found = found.withColumns({f"_given_{k}": described(k) for k in KINDS})
    for k in KINDS:
        trees, least = models[k]
        chosen = F.expr(f"filter(_given_{k}, x -> {trees} >= {least if np.isfinite(least) else 1e300!r}D)")
        added = named(F.when(F.size(f"_given_{k}") > 0, chosen).otherwise(F.col(f"_given_{k}")), k)
        base.append(named(F.col(f"_base_{k}"), k))
        every.append(F.array_sort(F.concat(named(F.col(f"_base_{k}"), k), added)))
    found = found.withColumns({"pii_base": F.concat(*base).cast(_SPAN), "pii_spans": F.concat(*every).cast(_SPAN)})
    return found.select(*docs.columns, "pii_base", "pii_spans")


def _is(kind: str):
    return lambda x: x["kind"] == kind


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its text replaced by ``[KIND]``; n_chars, if a column, follows.

    Spans that overlap are replaced together under the name of the first.
    Texts without spans, null ones too, are unchanged.
    """
    spans = F.array_sort(F.transform("pii_spans", lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("upto"), x["kind"].alias("kind"))))
    text = F.col("text")

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        put = F.when(x["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], gap, F.lit("["), F.upper(x["kind"]), F.lit("]")))
        return F.struct(F.greatest(acc["at"], -x["upto"]).alias("at"), put.alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    marked = with_spans(docs).withColumn("text", F.when(F.size("pii_spans") > 0, whole).otherwise(text))
    if "n_chars" in docs.columns:
        marked = marked.withColumn("n_chars", F.when(F.size("pii_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return marked.select(docs.columns)


def op5_pii(spark, sf_dir: str) -> DataFrame:
    found = with_spans(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.filter("pii_base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("pii_base")), 256).alias("base_sha256"), listed(F.col("pii_spans")).alias("spans"))
