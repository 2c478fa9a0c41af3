"""Operator 6: URL filters from segmented host names.

Rules come first: the longest rule (host and path together) that fits decides.  Other URLs are
judged by a multinomial naive Bayes over the words of host and path, where names written
together are split by a Viterbi search over unigram word probabilities.

Unigrams are counted over the host and path tokens of all pages and over the words of their html
(where there is that column).  A token that more frequent words make up is no word of its own, and
the table holds the ``vocabulary`` most frequent tokens of at most ``LONGEST`` letters, since every
worker has it.  Other letters keep their place in the segmentation (a run of them is one unknown word).

There are no labels: ``EXAMPLES``, a few words by class, are the prior, and the classes are then
learned from all pages by expectation maximisation.  In the first round a URL without an example word
is allowed and the others count for both classes by their odds; every further round judges all pages
with the words learned so far, so that words which stand in bad URLs come to tell the class and the
common words of all URLs come to say nothing.  A word's probability in a class is a mean of that
among the examples and that among the pages.  Subdomain labels (``SUBDOMAINS``) before the domain say
what serves a page, not what it is about, and are left out of the odds.  Rules are about places, not
words, so what they decide teaches nothing.

Defined results: a null URL and one without ``://`` have an empty host and path, no rule and the
verdict allow; so has a URL none of whose words is known.  Long URLs are read whole.  Repeated rows
count and are judged each; null page_ids stay; extra columns are ignored; no rows give none.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: (host, path prefix, verdict).
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]

#: Training rows: words of host names and paths, by class.
EXAMPLES = {
    "block": """
        casino win jackpot | best casino bonus win | online casino slots | poker win cash | free slots spins
        betting odds win | lucky casino jackpot | casino royal win money | bingo cash bonus | sport betting tips
        adult video xxx | hot porn tube | sex cam live | nude girls cam | xxx porn free
        cheap viagra pills | buy pills online | pharmacy discount pills | diet pills fast | cheap meds pharmacy
        free crack download | warez serial keygen | torrent crack full | keygen crack free | pirate movie torrent
        payday loan fast cash | easy credit loan | get rich quick money | earn money fast | crypto double money
        win free prize | claim prize winner | lottery winner cash | free gift card win | spam offer click
        ads track click | ad tracker banner | tracking pixel beacon | popup ads adserver | doubleclick adclick ads
        adult dating cam | adult sex shop | escort adult chat | erotic adult nude | gambling bets roulette
        free bets bookie | blackjack roulette jackpot | spam farm links | link farm seo | malware virus exploit
        phishing scam login | fake replica watches | cheap replica bags | spyware trojan botnet | viagra cialis cheap
    """,
    "allow": """
        city news today | world news daily | local weather report | national health service | science journal articles
        open source project docs | python library reference | code repository home | developer blog posts | linux wiki help
        university research papers | school learning math | history museum archive | public library catalog | art gallery guide
        cooking recipes home | garden plants guide | travel city guide | train travel times | book reviews blog
        music festival program | football club results | chess club lessons | family health advice | language learning course
        shop contact about page | government tax forms | bank customer service | company product support | job search career
        mobile phone reviews | computer hardware test | photo camera blog | film review archive | forum questions answers
    """,
}


#: Labels before a domain that name a service.
SUBDOMAINS = frozenset("www m blog mobile amp web wap cdn static img images media api app shop store news mail en de fr es".split())
#: Letters of the longest word, and those of the shortest part of a made-up token.
LONGEST, SHORTEST = 24, 3


def _made_up(token: str, n: int, words: dict[str, int]) -> bool:
    """Whether words at least as frequent, of ``SHORTEST`` letters or more, make up the token."""
    whole = [True] + [False] * len(token)
    for i in range(SHORTEST, len(token) + 1):
        whole[i] = any(whole[j] and words.get(token[j:i], 0) >= n for j in range(i - SHORTEST + 1))
    return whole[-1]


def _rows(text: str) -> list[list[str]]:
    return [part.split() for line in text.splitlines() for part in line.split("|") if part.strip()]


#: Share of a class's word probabilities that comes from pages, and what an unseen word has.
LEARNED, UNSEEN = 0.5, 1e-4
#: Example words are at least this share of all unigrams; names up to this length are remembered.
SEEDED, REMEMBERED = 1e-5, 256


class UrlModel:
    """Unigram word probabilities and class probabilities of words.

    ``counts`` are unigram counts; ``learned`` are the (block, allow) counts of words in pages.
    """

    def __init__(self, examples: dict[str, str] = EXAMPLES, counts: dict[str, int] | None = None, learned: dict[str, tuple[float, float]] | None = None, sizes: tuple[float, float] | None = None, urls: tuple[float, float] | None = None):
        rows = {c: _rows(t) for c, t in examples.items()}
        words = {c: Counter(w for r in rs for w in r) for c, rs in rows.items()}
        self.seeds = frozenset(w for c in words.values() for w in c)
        least = max(1.0, SEEDED * sum((counts or {}).values()))
        unigrams = {w: max(least, words["block"][w] + words["allow"][w]) for w in self.seeds}
        for w, n in sorted((counts or {}).items(), key=lambda x: (len(x[0]), x[0])):
            if w in self.seeds or (len(w) <= LONGEST and not _made_up(w, n, unigrams)):
                unigrams[w] = unigrams.get(w, 0) + n
        total = sum(unigrams.values())
        self.cost = {w: math.log(n / total) for w, n in unigrams.items()}
        self.unknown = -math.log(total)  # and a price for each letter of an unknown word
        self.letter = -math.log(12.0)
        self.longest = max(map(len, unigrams))
        ways = tuple(sum(words[c].values()) for c in ("block", "allow"))
        share = LEARNED if learned else 0.0
        sizes = sizes or (1.0, 1.0)

        def chance(w: str, side: int) -> float:
            seen = learned[w][side] / max(sizes[side], 1e-9) if learned and w in learned else 0.0
            return (1 - share) * words[("block", "allow")[side]][w] / ways[side] + share * seen + UNSEEN

        self.odds = {w: math.log(chance(w, 0) / chance(w, 1)) for w in self.seeds | set(learned or ())}
        block, allow = urls or (len(rows["block"]), len(rows["allow"]))
        self.prior = math.log((block + 1) / (allow + 1))
        self._memo: dict[str, tuple[str, ...]] = {}

    def segment(self, name: str) -> tuple[str, ...]:
        """The likeliest words of a concatenated name (Viterbi over unigrams).

        A place is reached by a word (state 0), or inside a run of unknown letters (state 1), which pays
        for a word once and for every letter.
        """
        known = self._memo.get(name)
        if known is not None:
            return known
        by_word, by_run, came, state, run_state = [0.0], [-math.inf], [0], [0], [0]
        for i in range(1, len(name) + 1):
            top = (-math.inf, 0, 0)
            for j in range(max(0, i - self.longest), i):
                cost = self.cost.get(name[j:i])
                if cost is not None:
                    s = int(by_run[j] > by_word[j])
                    top = max(top, ((by_run if s else by_word)[j] + cost, j, s))
            begin, on = by_word[i - 1] + self.unknown + self.letter, by_run[i - 1] + self.letter
            by_word.append(top[0])
            came.append(top[1])
            state.append(top[2])
            by_run.append(max(begin, on))
            run_state.append(int(on > begin))
        out, i, s = [], len(name), int(by_run[-1] > by_word[-1])
        while i > 0:
            j = came[i]
            before = state[i]
            if s:
                j = i
                while run_state[j]:
                    j -= 1
                j, before = j - 1, 0
            out.append(name[j:i])
            i, s = j, before
        words = tuple(reversed(out))
        if len(name) <= REMEMBERED:
            if len(self._memo) > 100_000:
                self._memo.clear()
            self._memo[name] = words
        return words

    def words(self, host: str, path: str) -> list[str]:
        """Words of a URL that may tell its class: the host without subdomains that serve, and the path."""
        labels = host.split(".")
        while len(labels) > 2 and labels[0] in SUBDOMAINS:
            labels = labels[1:]
        return [w for token in re.findall(r"[a-z]+", f"{'.'.join(labels)} {path.lower()}") for w in self.segment(token)]

    def log_odds(self, words: list[str]) -> float:
        """Log odds of block over allow; without a known word, a clear allow."""
        known = [self.odds[w] for w in words if w in self.odds]
        return self.prior + sum(known) if known else -math.inf


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None)
    for name, prefix, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):  # the longest is asked first
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def token_counts(cut: DataFrame, vocabulary: int) -> dict[str, int]:
    """Counts of the ``vocabulary`` most frequent letter runs of (host, path), over all rows; words of ``html`` (where
    there is that column) count too, if they have ``SHORTEST`` letters."""
    runs = F.regexp_extract_all(F.lower(F.concat_ws(" ", "host", "path")), F.lit("([a-z]+)"))
    tokens = cut.select(F.explode(runs).alias("token"))
    if "html" in cut.columns:
        said = F.split(F.lower(F.regexp_replace("html", r"(?s)<(script|style).*?</\1>|<[^<>]*>", " ")), "[^a-z]+")
        tokens = tokens.unionByName(cut.select(F.explode(said).alias("token")).where(F.length("token") >= SHORTEST))
    counts = tokens.where(F.length("token") <= LONGEST).groupBy("token").count().orderBy(F.desc("count"), "token").limit(vocabulary)
    return {r["token"]: r["count"] for r in counts.toLocalIterator()}


def learn(cut: DataFrame, counts: dict[str, int], vocabulary: int, rounds: int = 2, examples: dict[str, str] = EXAMPLES) -> UrlModel:
    """A model whose classes are learned from all rows of ``cut`` (host, path) by expectation maximisation."""
    import pandas as pd

    model = UrlModel(examples, counts)
    for k in range(rounds):

        def expected(frames, model=model, first=k == 0):
            for frame in frames:
                sums: dict[str, list[float]] = {}
                for host, path in zip(frame.host, frame.path):
                    words = model.words(host, path)
                    by_seed = not first or any(w in model.seeds for w in words)
                    p = 1 / (1 + math.exp(-max(-50.0, min(50.0, model.log_odds(words))))) if by_seed and words else 0.0
                    for w in (*words, ""):  # the empty word counts URLs
                        mine = sums.setdefault(w, [0.0, 0.0])
                        mine[0] += p
                        mine[1] += 1 - p
                yield pd.DataFrame([(w, *v) for w, v in sums.items()], columns=["word", "block", "allow"])

        masses = cut.select("host", "path").mapInPandas(expected, "word string, block double, allow double").groupBy("word").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"))
        masses = common.materialize(masses, "words")
        url = masses.where("word = ''").first()
        sizes = masses.where("word <> ''").agg(F.sum("block"), F.sum("allow")).first()
        kept = masses.where("word <> ''").orderBy(F.desc(F.col("block") + F.col("allow")), "word").limit(vocabulary)
        learned = {r["word"]: (r["block"], r["allow"]) for r in kept.toLocalIterator()}
        if url is None or not learned:
            break
        model = UrlModel(examples, counts, learned, (sizes[0], sizes[1]), (url["block"], url["allow"]))
    return model


def judge(pages: DataFrame, rules=RULES, vocabulary: int = 100_000) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_log_odds) of every row of ``pages`` (page_id, url, and html if there is any)."""
    common.ship(pages.sparkSession)
    html = [F.coalesce("html", F.lit("")).alias("html")] if "html" in pages.columns else []
    cut = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), *html)
    model = learn(cut, token_counts(cut, vocabulary), vocabulary)
    ruled = cut.select("page_id", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("by_rule"))

    @F.pandas_udf("double")
    def log_odds(host, path):
        import pandas as pd

        return pd.Series([model.log_odds(model.words(h, p)) for h, p in zip(host, path)], dtype="float64")

    scored = ruled.withColumn("block_log_odds", log_odds("host", "path"))
    verdict = F.coalesce("by_rule.verdict", F.when(F.col("block_log_odds") > 0, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", F.col("by_rule.rule").alias("rule"), verdict.alias("verdict"), "block_log_odds")
