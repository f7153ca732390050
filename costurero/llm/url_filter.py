"""URL filters: rules by host and path, and a logistic regression on hashed character n-grams for all other URLs.

Host and path give n-grams of their own (letters folded to lower case, runs of digits to one 0, host and path closed by
marks), hashed into buckets; a URL counts each bucket once. The regression is fitted by full-batch gradient descent inside
one expression: two folds alternate, one over the labelled URLs (their errors) and one over the buckets (their weights).
Only DataFrame functions are used, and judging URLs moves no row.

Defined cases: a null URL, or one without `://`, has an empty host and path and is judged by the bias alone, which allows;
repeated rows are judged each by itself; an empty table gives no rows; without labelled URLs of both kinds all is allowed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from costurero.llm.common import prepare

#: The rules of the contract, as (verdict, host and path). A small list: a deployment's longer one is its parameter too.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: What the labelled table is made of: words that name unwanted hosts, words that name others, and the forms of both.
UNWANTED = """
adult adults xxx porn sexcam nude escort hookup casino casinos slots poker roulette jackpot betting bets bet gamble lotto
pills pill pharma meds viagra cialis steroids spam spammy linkfarm farm-links ads ad adserver adclick popup banner track tracker
tracking pixel-track click-bait clicks payday loans cheap-loans free-money win-money prize winner cracked warez keygen torrents
replica fake-id cheap-pills free-spins adult-video casino-bonus spam-links ads-click bets-online
""".split()
WANTED = """
library museum school college university theatre theory weather garden kitchen recipes travel nature history science journal
gazette times tribune review letters notes essays gallery concert orchestra football tennis cycling hiking climbing bakery
market bridge harbour village county parish council hospital clinic nursing engineer mechanics physics chemistry biology
thunder thorn thistle mother father brother earth health wealth north south thread theme nation station motion action
ocean forest river winter summer autumn spring painter pottery archive records census atlas maps geology mineral fossil
""".split()
HOSTS = ("{}.example.com", "www.{}.org", "{}-online.info", "blog.{}.example.org", "my{}.net")
PATHS = ("/", "/en/0", "/de/0.html", "/post/0/")


@dataclass(frozen=True)
class Settings:
    """N-grams of `shortest` to `longest` characters in `buckets`; `rounds` of descent at `rate`, weights shrunk by `decay`.

    `share` is the share of unwanted URLs to expect where URLs are judged, whatever it is in the labelled table; a URL is
    blocked if its probability reaches `least`. Weights (a double per bucket) are all that leaves the executors.
    """

    shortest: int = 3
    longest: int = 5
    buckets: int = 1 << 14
    rounds: int = 80
    rate: float = 1.0
    decay: float = 1e-4
    share: float = 0.25
    least: float = 0.5


def labelled(spark: SparkSession) -> DataFrame:
    """The default table: (url, blocked), every word in every form."""
    words = [F.struct(F.lit(w).alias("w"), F.lit(b).alias("blocked")) for ws, b in ((UNWANTED, 1), (WANTED, 0)) for w in ws]
    one = spark.range(1).select(F.inline(F.array(*words)))
    urls = one.select("w", "blocked", F.posexplode(F.array(*map(F.lit, HOSTS))).alias("i", "host"))
    path = F.get(F.array(*map(F.lit, PATHS)), (F.col("i") + F.length("w")) % len(PATHS))
    return urls.select(F.concat(F.lit("https://"), F.replace("host", F.lit("{}"), F.col("w")), path).alias("url"), "blocked")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL; both empty without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def grams(host: Column, path: Column, s: Settings) -> Column:
    """The distinct buckets of a URL's n-grams, in order; none where host and path are empty."""
    marked = F.concat(F.lit("^"), host, F.lit("$"), path, F.lit("|"))
    folded = F.lower(F.regexp_replace(marked, "[0-9]+", "0"))

    def of(text: Column, n: int) -> Column:
        last = F.length(text) - n
        places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.substring(text, i + 1, F.lit(n)))

    def bucket(gram: Column) -> Column:
        return (F.conv(F.right(F.md5(gram.cast("binary")), F.lit(8)), 16, 10).cast("bigint") % s.buckets).cast("int")

    pieces = F.transform(F.array(folded), lambda t: F.concat(*[of(t, n) for n in range(s.shortest, s.longest + 1)]))
    found = F.array_sort(F.array_distinct(F.transform(F.flatten(pieces), bucket)))
    return F.when((host == "") & (path == ""), F.array().cast("array<int>")).otherwise(found)


def fit(table: DataFrame, s: Settings = Settings()) -> list[float]:
    """Weights of the buckets and, last, the bias; empty unless both labels occur.

    The labelled table is small by contract. It becomes one row: the URLs with their buckets, in the order of the URLs so
    that a rerun sums alike, and for every bucket the URLs that hold it.
    """
    host, path = host_and_path(F.col("url"))
    rows = table.where("url IS NOT NULL AND blocked IN (0, 1)").groupBy("url").agg(F.max("blocked").cast("double").alias("y"))
    one = rows.agg(F.array_sort(F.collect_list(F.struct("url", "y", grams(host, path, s).alias("b")))).alias("all"))
    urls = one.select(F.posexplode("all").alias("i", "u")).select(F.struct("i", "u.y", "u.b").alias("u"))
    holders = urls.select(F.explode("u.b").alias("b"), "u.i").groupBy("b").agg(F.array_sort(F.collect_list("i")).alias("at"))
    buckets = table.sparkSession.range(s.buckets).select(F.col("id").cast("int").alias("b")).join(holders, "b", "left")
    lists = buckets.select(F.struct("b", F.coalesce("at", F.array().cast("array<int>")).alias("at")).alias("v"))
    both = urls.unionByName(lists, allowMissingColumns=True)
    row = both.agg(F.array_sort(F.collect_list("u")).alias("urls"), F.array_sort(F.collect_list("v")).alias("lists"))
    unwanted = F.aggregate("urls", F.lit(0.0), lambda t, u: t + u["y"])
    both_kinds = (unwanted > 0) & (unwanted < F.size("urls"))
    found = row.select(F.when(both_kinds, descent(s)).alias("w"), unwanted.alias("bad"), F.size("urls").alias("n")).first()
    if found["w"] is None:
        return []
    shift = math.log(s.share / (1 - s.share)) - math.log(found["bad"] / (found["n"] - found["bad"]))
    return [*found["w"][:-1], found["w"][-1] + shift]


def descent(s: Settings) -> Column:
    """All rounds as one fold over the row of `fit`.

    The state is the weights (bias last) and the URLs' errors. Odd steps take the errors from the weights, even ones the
    weights from the errors, so that neither is computed anew inside the other's loop.
    """
    added = lambda values, at: F.aggregate(values, F.lit(0.0), lambda t, i: t + F.get(at, i))
    bias = F.lit(s.buckets)

    def errors(w: Column) -> Column:
        return F.transform("urls", lambda u: u["y"] - 1 / (1 + F.exp(-(F.get(w, bias) + added(u["b"], w)))))

    def weights(w: Column, e: Column) -> Column:
        step = F.lit(s.rate) / F.size("urls")
        moved = F.transform("lists", lambda v: F.get(w, v["b"]) * (1 - s.decay) + step * added(v["at"], e))
        return F.concat(moved, F.array(F.get(w, bias) + step * F.aggregate(e, F.lit(0.0), lambda t, x: t + x)))

    start = F.struct(
        F.array_repeat(F.lit(0.0), s.buckets + 1).alias("w"), F.transform("urls", lambda u: u["y"]).alias("e")
    )

    def step(state: Column, k: Column) -> Column:
        w, e = state["w"], state["e"]
        odd = F.struct(w.alias("w"), errors(w).alias("e"))
        return F.when(k % 2 == 1, odd).otherwise(F.struct(weights(w, e).alias("w"), e.alias("e")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(2 * s.rounds)), start, step, lambda state: state["w"])


def constant(numbers: list[float]) -> Column:
    """Numbers as one constant of the plan; as many as the settings name."""
    return F.split(F.lit(",".join(map(repr, numbers))), ",").cast("array<double>")


def odds(host: Column, path: Column, weights: list[float], s: Settings = Settings()) -> Column:
    """Probability that a URL is unwanted; 0 without weights."""
    if not weights:
        return F.lit(0.0)
    table = constant(weights)
    total = F.aggregate(grams(host, path, s), F.lit(weights[-1]), lambda t, b: t + F.get(table, b))
    return 1 / (1 + F.exp(-total))


def matched(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null without one. Of equally long ones the longer host wins."""
    rule = verdict = None
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1].find("/"), r[1]), reverse=True):
        own, slash, start = text.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + start))
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    if rule is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return rule, verdict


def judge(pages: DataFrame, weights: list[float], rules=RULES, s: Settings = Settings()) -> DataFrame:
    """One row per page: `page_id, host, path, rule, verdict, odds`; the rule decides, else the regression (odds null if a rule did)."""
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    told = parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    told = told.withColumn("odds", F.when(F.col("rule").isNull(), odds(F.col("host"), F.col("path"), weights, s)))
    learned = F.when(F.col("odds") >= s.least, "block").otherwise("allow")
    return told.select("page_id", "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"), "odds")


def report(pages: DataFrame, table: DataFrame | None = None, rules=RULES, s: Settings = Settings()) -> DataFrame:
    """Fit on the labelled table (the default one if none is given) and judge every page."""
    prepare(pages.sparkSession)
    weights = fit(labelled(pages.sparkSession) if table is None else table, s)
    return judge(pages, weights, rules, s).drop("odds")
