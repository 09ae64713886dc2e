"""URL filter: rules first, then a ratio of two character language models.

URLs that a rule decides are the accepted and the rejected examples. For each
class a Markov model predicts every character from up to four before it; a
context's own counts are mixed with the next shorter context's by Witten-Bell
weights, so the order varies with what has been seen. A URL's score is the
difference of its two log likelihoods a character. The cut between allow and
block is the one that separates best the examples that were held out of the
counts. Everything is DataFrame expressions; counts cover all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearsieve.llm.env import cut, read_table

#: (verdict, rule); the longest rule that fits wins.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
ORDER = 4
UNIT = 1_000_000  # scores are whole millionths of a nat, so that sums don't depend on their order
SMALL = 400_000  # models of up to this many rows, of under 100 bytes each, are broadcast
HELD = 5  # every fifth example calibrates
ALPHABET = 256.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The rule that decides and its verdict; nulls where none fits."""
    which = verdict = None
    for say, rule in sorted(rules, key=lambda x: (-len(x[1]), x[1])):
        own, _, start = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + start)
        which = F.when(fits, rule) if which is None else which.when(fits, rule)
        verdict = F.when(fits, say) if verdict is None else verdict.when(fits, say)
    return which, verdict


def grams(url: Column, order: int = ORDER) -> Column:
    """Every character of ``^^^^url$`` with the ``order`` before it."""
    chars = F.concat(F.array(*[F.lit("^")] * order), F.filter(F.split(F.coalesce(url, F.lit("")), ""), lambda x: x != ""), F.array(F.lit("$")))

    def runs(chars: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(chars) - order - 1), lambda i: F.concat(*[F.get(chars, i + j) for j in range(order + 1)]))

    # a lambda over an array of one: the characters are split once, not for each gram
    return F.get(F.transform(F.array(chars), runs), F.lit(0))


def down(a: Column, b: Column) -> Column:
    """a / b in whole numbers, rounded down; b is positive."""
    return ((a - F.pmod(a, b)) / b).cast("long")


@dataclass
class Model:
    table: DataFrame  # gram, score
    rows: int
    threshold: int

    def scored(self, urls: DataFrame) -> DataFrame:
        """``url, score`` of distinct ``urls(url)``: millionths of a nat a character, rounded down."""
        table = F.broadcast(self.table) if self.rows <= SMALL else self.table
        each = urls.select("url", F.explode(grams(F.col("url"))).alias("gram")).join(table, "gram")
        return each.groupBy("url").agg(down(F.sum("score"), F.count("*")).alias("score"))


def _scores(counts: DataFrame, order: int) -> DataFrame:
    """``gram, score`` from ``gram, acc, rej``, shortest contexts first."""
    below = None
    for k in range(order + 1):
        key = F.substring("gram", order + 1 - k, k + 1)
        level = counts.groupBy(key.alias("g")).agg(F.sum("acc").alias("acc"), F.sum("rej").alias("rej"))
        level = level.withColumn("ctx", F.substring("g", 1, k))
        sums = level.groupBy("ctx").agg(*[f(c).alias(f"{n}_{c}") for c in ("acc", "rej") for n, f in (("n", F.sum), ("t", lambda c: F.count_if(F.col(c) > 0)))])
        level = level.join(sums, "ctx")
        if below is None:
            level = level.withColumns({f"low_{c}": F.lit(1 / ALPHABET) for c in ("acc", "rej")})
        else:
            level = level.withColumn("h", F.substring("g", 2, k)).join(below, "h")
        p = {c: F.when(F.col(f"n_{c}") == 0, F.col(f"low_{c}")).otherwise((F.col(c) + F.col(f"t_{c}") * F.col(f"low_{c}")) / (F.col(f"n_{c}") + F.col(f"t_{c}"))) for c in ("acc", "rej")}
        below = level.select(F.col("g").alias("h"), p["acc"].alias("low_acc"), p["rej"].alias("low_rej"))
    return below.select(F.col("h").alias("gram"), F.round((F.log("low_acc") - F.log("low_rej")) * UNIT).cast("long").alias("score"))


def learn(urls: DataFrame, order: int = ORDER) -> Model:
    """Fit on all distinct ``urls(url, verdict)``; verdict is null where no rule decides."""
    example = F.pmod(F.xxhash64("url"), F.lit(HELD)) != 0
    each = urls.select(F.explode(grams(F.col("url"), order)).alias("gram"), (example & (F.col("verdict") == "allow")).alias("a"), (example & (F.col("verdict") == "block")).alias("b"))
    counts = cut(each.groupBy("gram").agg(F.count_if("a").alias("acc"), F.count_if("b").alias("rej")), "grams")
    table = cut(_scores(counts, order), "model")
    model = Model(table, table.count(), 0)
    held = urls.filter(~example & F.col("verdict").isNotNull())  # only these are scored for the calibration
    judged = model.scored(held.select("url")).join(held, "url")
    bins = F.greatest(F.lit(-8000), F.least(F.lit(8000), down(F.col("score"), F.lit(UNIT // 1000))))
    found = judged.groupBy(bins.cast("int").alias("bin")).agg(F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("b")).collect()  # 16,001 rows at most
    model.threshold = calibrate([(r.bin, r.a, r.b) for r in found]) * (UNIT // 1000)
    return model


def calibrate(bins: list[tuple[int, int, int]]) -> int:
    """The bin from which on URLs are allowed: best mean of the two classes' accuracy, ties to
    the one nearest zero. 0 unless both classes have examples."""
    allow, block = sum(x[1] for x in bins), sum(x[2] for x in bins)
    if not allow or not block:
        return 0
    best, right, wrong = (-1.0, 0, 0), allow, 0
    for b, a, r in [*sorted(bins), (8001, 0, 0)]:
        best = max(best, ((right / allow + wrong / block) / 2, -abs(b), b))
        right, wrong = right - a, wrong + r
    return best[2]


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every row of ``pages(page_id, url)``.

    host and path of a null url, or one without ``://``, are empty; such urls,
    like all that no rule fits, are judged by the models. score is the models'
    in nats a character. Each different url is scored once. With no examples
    of a class all scores are 0 or the cut is 0. Repeated rows and null
    page_ids stay; an empty table gives no rows; other columns are ignored.
    """
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(url, F.lit("")).alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.withColumns({"host": host, "path": path})
    which, said = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": which, "said": said})
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as given, so that grams are made by many tasks
    urls = cut(rows.select("url", F.col("said").alias("verdict")).distinct().repartition(parts, "url"), "urls")
    model = learn(urls)
    scored = cut(model.scored(urls.select("url")), "scores")  # of all urls, as the score is a column of the result
    verdict = F.coalesce("said", F.when(F.col("score") >= model.threshold, "allow").otherwise("block"))
    return rows.join(scored, "url").select("page_id", "host", "path", "rule", verdict.alias("verdict"), (F.col("score") / UNIT).alias("score"))


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages").select("page_id", "url"))
