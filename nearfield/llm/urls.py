"""URL verdicts: allow and block rules, and for the rest naive Bayes over segmented host and path tokens."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, reliable, small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words are looked up by so many first letters; longer ones are then compared whole.
KEY = 24


class UrlRule(NamedTuple):
    verdict: str
    host: str
    path: str


RULES = (
    UrlRule("block", "com", "/en/"),
    UrlRule("allow", "example.com", "/en/7"),
    UrlRule("allow", "net", "/de/"),
    UrlRule("block", "example.net", "/de/8"),
    UrlRule("block", "org", "/es/"),
)

#: Labelled names and paths that the classifier is trained on.
BLOCK_SEEDS = """
cheap-pills/buy spam-farm/offers casino-bonus/free-spins online-casino/jackpot adult-dating/tonight hot-singles/chat
xxx-videos/free porn-tube/watch payday-loans/instant fast-cash/apply viagra-store/order cheap-watches/replica
replica-bags/sale free-money/claim win-prize/lottery crypto-double/profit bet-sports/odds poker-room/bonus
warez-crack/keygen serial-key/download torrent-pirate/movies click-bait/shocking link-farm/backlinks seo-spam/buy-links
essay-writers/cheap diet-pills/lose-weight fake-passport/buy stolen-cards/dumps phish-login/verify malware-host/exe
free-ringtones/download escort-girls/city gamble-win/slots spam-mail/lists bulk-followers/buy nude-cams/live
""".split()
ALLOW_SEEDS = """
city-library/catalogue open-science/articles school-district/calendar garden-club/plants history-museum/exhibits
blog-travel/notes weather-station/forecast recipe-book/soups daily-news/world river-trust/reports music-academy/courses
public-health/advice math-forum/questions code-docs/reference book-review/novels mountain-guide/trails town-council/minutes
local-theatre/programme bird-watch/species www-university/research m-encyclopedia/history language-learning/grammar
astronomy-society/observations train-timetable/routes law-journal/issues film-archive/posts physics-notes/lectures
cycling-club/events farm-market/produce bakery-stories/bread charity-fund/projects parents-group/meetings
photo-diary/albums chess-club/games kids-science/experiments nature-reserve/visits
""".split()


def tokens_of(text: str) -> list[str]:
    return re.findall(r"[a-z]+", text.lower())


class NaiveBayes:
    """Multinomial naive Bayes with add-one smoothing; tokens that training never saw say nothing."""

    def __init__(self, block: list[list[str]], allow: list[list[str]]) -> None:
        b, a = Counter(t for x in block for t in x), Counter(t for x in allow for t in x)
        known = b.keys() | a.keys()
        nb, na = sum(b.values()) + len(known), sum(a.values()) + len(known)
        self.odds = {t: math.log((b[t] + 1) / nb) - math.log((a[t] + 1) / na) for t in known}
        self.prior = math.log(len(block) / len(allow))

    def score(self, tokens: list[str]) -> float:
        return sum(self.odds.get(t, 0.0) for t in tokens)


def seed_model() -> NaiveBayes:
    return NaiveBayes(*[[tokens_of(x) for x in seeds] for seeds in (BLOCK_SEEDS, ALLOW_SEEDS)])


def segment(name: str, count: Callable[[str], int], total: int, longest: int | None = None) -> list[str]:
    """The most likely words whose concatenation is ``name``, under unigram probabilities ``count / total``.

    An unseen word has the probability ``1 / total / 10 ** length``, which favours few long unknown words. ``longest``:
    length of the longest word that may be counted. Of equally likely splits the one with the longer last word wins.
    """
    best: list[tuple[float, int]] = [(0.0, 0)]
    ten, unseen = math.log(10), -math.log(total)
    ahead, start = 0.0, 0  # of all places so far, the one from which an unseen word is likeliest
    for end in range(1, len(name) + 1):
        p, begin = ahead + unseen - end * ten, start
        for b in range(max(0, end - (longest or end)), end):
            if n := count(name[b:end]):
                q = best[b][0] + math.log(n / total)
                if q > p or q == p and b < begin:
                    p, begin = q, b
        best.append((p, begin))
        if p + end * ten > ahead:
            ahead, start = p + end * ten, end
    words, end = [], len(name)
    while end:
        begin = best[end][1]
        words.append(name[begin:end])
        end = begin
    return words[::-1]


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null where none does."""
    text = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, r.host + r.path).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def unigrams(pages: DataFrame) -> DataFrame:
    """``word, n`` over all pages: words of titles, of paths, and of host names where a hyphen already parts them."""
    title = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"<title>([^<]*)</title>", 1)) if "html" in pages.columns else F.lit("")
    parted = F.array_join(F.filter(F.split(host_of(F.col("url")), r"\."), lambda x: x.contains("-")), "-")
    words = pages.select(F.explode(F.split(F.concat_ws(" ", title, F.lower(path_of(F.col("url"))), parted), "[^a-z]+")).alias("word"))
    return words.where("word != ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def host_scores(hosts: DataFrame, words: DataFrame, model: NaiveBayes) -> DataFrame:
    """``host, host_score``: the names of each host (without the top-level label) are segmented and scored.

    A name is scored once, however many hosts have it. Its substrings of up to ``KEY`` letters are joined with the words
    that begin so, and the words never have to fit into one place.
    """
    named = hosts.select("host", F.explode(F.slice(F.split("host", r"\."), 1, F.greatest(F.size(F.split("host", r"\.")) - 1, F.lit(1)))).alias("label"))
    named = reliable(named.select("host", F.explode(F.split("label", "[^a-z]+")).alias("name")).where("name != ''"))
    seeds = hosts.sparkSession.createDataFrame(sorted(Counter(t for s in BLOCK_SEEDS + ALLOW_SEEDS for t in tokens_of(s)).items()), "word string, n long")
    words = reliable(words.unionByName(seeds).groupBy("word").agg(F.sum("n").alias("n")))
    total = words.agg(F.sum("n")).first()[0]
    names = named.select("name").distinct()
    cut = names.withColumn("b", F.explode(F.sequence(F.lit(1), F.length("name"))))
    cut = cut.withColumn("key", F.explode(F.expr(f"transform(sequence(1, least({KEY}, length(name) - b + 1)), k -> substring(name, b, k))"))).select("name", "key").distinct()
    met = cut.join(words.withColumn("key", F.left("word", F.lit(KEY))), "key").where((F.length("word") <= KEY) | F.contains("name", "word")).groupBy("name").agg(F.collect_list(F.concat_ws(":", "word", F.col("n").cast("string"))).alias("met"))
    odds = model.odds

    def start() -> Callable[..., tuple]:
        def scored(name: str, met: list[str] | None) -> tuple:
            counts = {w: int(n) for w, _, n in (x.partition(":") for x in met or ())}
            found = segment(name, lambda w: counts.get(w, 0), total, max(map(len, counts), default=1))
            return " ".join(found), sum(odds.get(t, 0.0) for t in found)

        return scored

    shape = T.StructType([T.StructField("segments", T.StringType()), T.StructField("score", T.DoubleType())])
    scored = map_texts(names.join(met, "name", "left"), start, shape, text="name", also=("met",), keep_text=True)
    return named.join(scored, "name").groupBy("host").agg(F.round(F.sum("score"), 9).alias("host_score"))


def judge_urls(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, model: NaiveBayes | None = None, id_col: str = "page_id") -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every page.

    The longest rule that fits decides; without one the classifier does: block if the log-odds of the segmented host
    words and of the path's words exceed zero. A null url, or one without ``://``, has an empty host and path and is
    allowed; repeated rows get equal results; an empty table gives no rows; other columns than the id, url and html
    play no part.
    """
    model = model or seed_model()
    need = pages.select(F.col(id_col).alias("page_id"), "url", *["html"] * ("html" in pages.columns))
    split = need.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hosts = reliable(split.select("host").distinct())
    scores = reliable(host_scores(hosts, unigrams(need), model))
    odds = model.odds

    def start() -> Callable[[str], tuple]:
        return lambda path: (round(sum(odds.get(t, 0.0) for t in re.findall(r"[a-z]+", path.lower())), 9),)

    parted = map_texts(split, start, T.StructType([T.StructField("path_score", T.DoubleType())]), text="path", keep_text=True)
    joined = parted.join(small(scores, scores.count()), "host", "left")
    score = F.lit(model.prior) + F.col("path_score") + F.coalesce("host_score", F.lit(0.0))
    text, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return joined.select("page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, F.when(score > 0, "block").otherwise("allow")).alias("verdict"), F.round(score, 6).alias("score"))
