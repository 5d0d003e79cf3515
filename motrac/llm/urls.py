"""URL filter: rules first, then naive Bayes over segmented host and path words.

A rule names a host and the beginning of a path; it fits that host and all its
subdomains, and the longest rule that fits decides. Any other url is judged by
its words: names that are written together are divided by a unigram model and a
Viterbi search, and a multinomial naive Bayes model over the words decides.

The unigram counts are those of the seeds and of all runs of letters in the urls
themselves, by the number of hosts they are met on, over all rows; seeds that are
written together are none. Counts are a table and stay one: the parts of each
distinct run meet it in a join, so no word is too long or too rare to be known.
A part that is looked for inside a longer run has at most LABEL letters, as a
host's label has; a longer word is known where it stands alone. Each distinct run
is divided once, and its weight goes to the urls that have it.
The naive Bayes model is trained on the seeds, labelled names written here, as
no table says which urls are bad, and the rules name places, not words.

Edge cases: a null url, or one without "://", has an empty host and path, fits no
rule and is allowed by the method (no words, the prior decides); repeated rows
are judged each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motrac.llm.common import materialize, spread_join

#: The most letters of a host's label.
LABEL = 63
#: What an unknown word costs for each letter, and the log odds of block before any word is seen.
LETTER, PRIOR = 2.5, -1.0
#: Weights and scores are added as whole numbers of these parts, in any order the same.
PARTS = 10**9
Rule = tuple[str, str, str]
RULES: list[Rule] = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

#: Labelled names that the naive Bayes model learns from.
SEEDS: dict[str, str] = {
    "block": """cheap pills|online pharmacy|buy viagra|discount meds|casino win|casino bonus|free bets|sports betting|bet now|poker slots|jackpot lottery|win cash prize
        spam farm|link farm|seo links|buy backlinks|ads track|ad tracker|click ads|pop ads|banner ads|adult cams|hot singles|xxx videos|porn tube|sex chat|payday loan
        fast loans|crypto doubler|free crypto|get rich quick|replica watches|cheap replica|weight loss pills|miracle diet|free download crack|warez keygen|torrent free movies|free gift cards|claim prize|phishing login""",
    "allow": """news daily|city news|world report|science journal|open library|public library|university press|school portal|museum archive|history museum|weather service|health clinic
        garden guide|cooking recipes|travel guide|book reviews|music theory|film festival|art gallery|local government|research institute|data center|software docs|developer docs|open source
        code review|math notes|physics lectures|language course|dictionary words|wiki pages|encyclopedia article|blog posts|photo journal|sports club|football results|bike repair|home garden|community forum|parish church""",
}


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The text of the longest fitting rule and its verdict; null where none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def seed_names(kind: str) -> list[list[str]]:
    return [n.split() for n in re.split(r"[|\n]\s*", SEEDS[kind])]


def _written_together(word: str, names: frozenset[str]) -> bool:
    """Whether the word is two or more of the names and no name itself."""
    ends = [True] + [False] * len(word)
    for i in range(1, len(word) + 1):
        ends[i] = any(ends[j] and word[j:i] in names for j in range(i))
    return ends[-1] and word not in names


@lru_cache
def seeds() -> tuple[dict[str, float], dict[str, float]]:
    """Unigram weights of the seeds' words, and their log odds of block against allow by multinomial naive Bayes."""
    counts = {k: Counter(w for n in seed_names(k) for w in n) for k in SEEDS}
    weights = {w: 20.0 * (counts["block"][w] + counts["allow"][w]) for w in counts["block"].keys() | counts["allow"].keys()}
    size = {k: sum(c.values()) for k, c in counts.items()}
    log_odds = {w: math.log((counts["block"][w] + 1) / (size["block"] + len(weights))) - math.log((counts["allow"][w] + 1) / (size["allow"] + len(weights))) for w in weights}
    return weights, log_odds


def divide(run: str, parts: list[tuple[int, int, float]], unknown: float) -> list[str]:
    """The likeliest words of a run of letters, given (start, end, cost) of its known parts; of equal ones that with the longer last word.

    An unknown word costs unknown and LETTER for each letter; the cheapest place
    for it to begin is carried along, so the work grows with the parts alone.
    """
    ending: dict[int, list[tuple[int, float]]] = {}
    for i, j, c in parts:
        ending.setdefault(j, []).append((i, c))
    best, back, start = [0.0], [0], (0.0, 0)
    for j in range(1, len(run) + 1):
        here = min([(start[0] + unknown + LETTER * j, start[1]), *((best[i] + c, i) for i, c in ending.get(j, []))])
        best.append(here[0])
        back.append(here[1])
        start = min(start, (here[0] - LETTER * j, j))
    out, j = [], len(run)
    while j:
        out.append(run[back[j] : j])
        j = back[j]
    return out[::-1]


def _runs(*columns: str) -> Column:
    return F.filter(F.split(F.lower(F.concat_ws(" ", *columns)), "[^a-z]+"), lambda w: w != "")


def unigrams(hosts: DataFrame) -> DataFrame:
    """(word, weight in PARTS) of the seeds and of all runs of letters in (host, path) rows.

    A run counts by the logarithm of the hosts it is met on; long ones are more
    likely several words, so a run's length divides its count. Seeds written
    together are no word however often they are met.
    """
    weights = seeds()[0]
    names = frozenset(weights)
    together = F.udf(lambda w: _written_together(w, names), "boolean")
    met = hosts.select("host", F.explode(_runs("host", "path")).alias("word")).distinct().groupBy("word").agg(F.count("*").alias("n"))
    own = met.where(~together("word")).select("word", F.round(F.log1p("n") / F.length("word") * PARTS).cast("long").alias("weight"))
    given = hosts.sparkSession.createDataFrame([(w, round(v * PARTS)) for w, v in sorted(weights.items())], "word string, weight long")
    return own.unionByName(given).groupBy("word").agg(F.sum("weight").alias("weight"))


def divided(runs: DataFrame, words: DataFrame) -> DataFrame:
    """(run, words, score): each distinct run of letters with its likeliest words and the sum of their log odds in PARTS.

    runs has a column run; words is (word, weight) and should be a written table.
    """
    total = (words.agg(F.sum("weight")).first()[0] or 0) / PARTS
    unknown = math.log(total) + 1 if total else 1.0
    n = F.length("run")
    lengths = F.transform(F.sequence(F.lit(1), n), lambda i: F.sequence(F.lit(1), F.least(F.lit(LABEL), n - i + 1)))
    parts = F.flatten(F.transform(lengths, lambda ks, i: F.transform(ks, lambda k: F.struct(i.alias("i"), k.alias("k")))))
    whole = F.when(n > LABEL, F.array(F.struct(F.lit(0).alias("i"), n.alias("k")))).otherwise(F.array().cast("array<struct<i:int,k:int>>"))
    placed = runs.select("run", F.explode(F.concat(parts, whole)).alias("p")).select("run", F.col("p.i").alias("i"), F.col("p.k").alias("k"), F.substring("run", F.col("p.i") + 1, F.col("p.k")).alias("word"))
    keyed = materialize(placed.groupBy("word").agg(F.count("*").alias("n")).join(words, "word"), "url-parts")
    found = spread_join(placed, keyed, "word", "n").groupBy("run").agg(F.collect_list(F.struct("i", (F.col("i") + F.col("k")).alias("j"), "weight")).alias("parts"))
    log_odds = seeds()[1]

    @F.arrow_udf("words array<string>, score long")
    def judge(runs: pa.Array, parts: pa.Array) -> pa.Array:
        words = [divide(r, [(p["i"], p["j"], -math.log(p["weight"] / PARTS / total)) for p in own or []], unknown) for r, own in zip(runs.to_pylist(), parts.to_pylist())]
        scores = [sum(round(log_odds.get(w, 0.0) * PARTS) for w in own) for own in words]
        return pa.StructArray.from_arrays([pa.array(words, pa.list_(pa.string())), pa.array(scores, pa.int64())], names=["words", "score"])

    every = runs.join(found, "run", "left")
    return every.select("run", judge("run", "parts").alias("s")).select("run", "s.words", "s.score")


def judge(urls: DataFrame, rules: list[Rule] | None = None, id_col: str = "page_id", url_col: str = "url", prior: float = PRIOR) -> DataFrame:
    """One row per url: page_id, host, path, rule, verdict, and the method's score where no rule fits."""
    url = F.col(f"`{url_col}`").cast("string")
    rows = urls.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    # A path is empty or begins with a slash, and a host has none, so both together name the pair.
    rows = materialize(rows.withColumn("place", F.concat("host", "path")), "urls")
    places = materialize(rows.groupBy("place", "host", "path").agg(F.count("*").alias("n")), "url-places")
    words = materialize(unigrams(places), "url-words")
    met = places.select("place", F.explode(_runs("host", "path")).alias("run"))
    runs = materialize(met.groupBy("run").agg(F.count("*").alias("met")), "url-runs")
    scored = materialize(divided(runs, words).join(runs, "run").select("run", "met", "score"), "url-scores")
    sums = spread_join(met, scored.where("score <> 0"), "run", "met").groupBy("place").agg(F.sum("score").alias("sum"))
    places = materialize(places.join(sums, "place", "left").select("place", "n", (F.lit(prior) + F.coalesce("sum", F.lit(0)) / PARTS).alias("score")), "url-sums")
    rows = spread_join(rows, places, "place", "n")
    rule, verdict = longest_rule(F.col("host"), F.col("path"), RULES if rules is None else rules)
    rows = rows.withColumn("rule", rule).withColumn("ruled", verdict)
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), F.when(F.col("rule").isNull(), F.col("score")).alias("score"))
