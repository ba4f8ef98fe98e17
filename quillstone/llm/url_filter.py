"""URL filter: host and path rules first, then naive Bayes on the words that a host's concatenated name is made of.

A host label such as `cheappillsonline` is cut into words by unigram Viterbi over a lexicon of word frequencies taken from a public tokenizer's
vocabulary, whose merge order ranks words by frequency. Multinomial naive Bayes, fitted on the labelled example URLs below, scores the words of
host and path together. Words that no example has say nothing, so a URL without known words keeps the prior, which allows it.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: (verdict, host, path): fixed values of the default rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Labelled training URLs, written for this filter.
BLOCKED = """casino-win.example/bonus freecasinobonus.example/slots onlinepokerroom.example/play bestsportsbetting.example/odds cheap-pills.example/buy
buycheappills.example/order discountviagra.example/pharmacy onlinepharmacypills.example/cheap win-lottery.example/prize jackpotslots.example/casino
hotadultvideos.example/xxx sexcamlive.example/adult xxxporntube.example/free pornmovies.example/sex escortgirls.example/dating
quickpaydayloan.example/apply cashloanfast.example/credit earnmoneyfast.example/rich getrichquick.example/money replicawatches.example/cheap
warezcrack.example/keygen torrentcrack.example/serial freekeygen.example/download weightlosspills.example/diet miracledietpills.example/weight
gamblingbonus.example/roulette casinoroulette.example/win betwin.example/casino cheapreplica.example/buy spamoffer.example/free spamfarm.example/links linkfarm.example/spam""".split()
ALLOWED = """news.example/world dailynews.example/article citylibrary.example/books universityresearch.example/paper openscience.example/journal
schoolhomework.example/history blog.example/post travelguide.example/city cookingrecipes.example/food gardenplants.example/guide
weatherreport.example/today musicfestival.example/events moviereviews.example/film softwaredocs.example/manual docs.example/reference
wiki.example/article historymuseum.example/art healthservice.example/advice publictransport.example/map government.example/law
www.example/about m.example/help forum.example/topic shop.example/product sportsclub.example/team photography.example/gallery
mathlectures.example/course languagecourse.example/lesson localbusiness.example/contact communityproject.example/volunteer""".split()
#: Share of URLs that the method would block before it has seen a word.
PRIOR_BLOCK = 0.2


def lexicon(path: str) -> dict[str, float]:
    """Log probabilities of the lower-case words in a byte-level BPE vocabulary, by Zipf's law on their ranks."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    ranks: dict[str, int] = {}
    for piece, rank in vocab.items():
        word = piece.removeprefix("Ġ").lower()
        if piece[0] == "Ġ" and re.fullmatch("[a-z]{2,}", word):
            ranks[word] = min(rank, ranks.get(word, rank))
    total = sum(1 / (r + 10) for r in ranks.values())
    return {w: math.log(1 / (r + 10) / total) for w, r in ranks.items()}


def segment(name: str, words: dict[str, float], longest: int = 24, letter: float = -14.0) -> list[str]:
    """The likeliest words that make up a name of letters; a letter outside all words costs `letter`."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(name) + 1):
        options = [(best[start][0] + words[name[start:end]], start) for start in range(max(0, end - longest), end) if name[start:end] in words]
        best.append(max([*options, (best[end - 1][0] + letter, end - 1)]))
    out, end = [], len(name)
    while end:
        start = best[end][1]
        out.append(name[start:end])
        end = start
    return out[::-1]


def split_url(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


#: Letters of names whose words are remembered.
MEMO_LETTERS = 2_000_000


class Judge:
    def __init__(self, words: dict[str, float], rules=RULES, prior: float = PRIOR_BLOCK):
        self.words, self.memo, self.held = words, {}, 0
        self.rules = sorted(rules, key=lambda r: -len(r[1] + r[2]))
        counts = {k: Counter(t for url in urls for t in self.tokens(*split_url(f"http://{url}"))) for k, urls in (("block", BLOCKED), ("allow", ALLOWED))}
        known = counts["block"].keys() | counts["allow"].keys()
        totals = {k: sum(c.values()) + len(known) for k, c in counts.items()}
        self.odds = {t: math.log((counts["block"][t] + 1) / totals["block"]) - math.log((counts["allow"][t] + 1) / totals["allow"]) for t in known}
        self.prior = math.log(prior / (1 - prior))

    def tokens(self, host: str, path: str) -> list[str]:
        """Words of host and path. The last label, a public suffix, and numbers say nothing about a site."""
        out = []
        for name in re.findall("[a-z]+", ".".join(host.split(".")[:-1]) + " " + path.lower()):
            if name not in self.memo:
                if self.held > MEMO_LETTERS:
                    self.memo.clear()
                    self.held = 0
                self.memo[name] = segment(name, self.words)
                self.held += len(name)
            out += self.memo[name]
        return out

    def rule(self, host: str, path: str):
        return next((r for r in self.rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])), None)

    def block_probability(self, host: str, path: str) -> float:
        odds = self.prior + sum(self.odds.get(t, 0.0) for t in self.tokens(host, path))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


_judges: dict = {}


def judge_urls(pages: DataFrame, vocabulary_path: str, id_col: str = "page_id", url_col: str = "url", rules=RULES, threshold: float = 0.5) -> DataFrame:
    """One row a page: page_id, host, path, rule (of the longest rule that fits, else null), verdict, block_probability, words.

    A null url or one without `://` has an empty host and path; no rule fits it and the prior allows it. Rows are independent: no shuffle.
    """
    ship(pages.sparkSession)
    schema = pa.schema([("page_id", pa.int64()), *[(c, pa.string()) for c in ("host", "path", "rule", "verdict")], ("block_probability", pa.float64()), ("words", pa.list_(pa.string()))])

    def run(batches):
        if (vocabulary_path, rules) not in _judges:
            _judges[vocabulary_path, rules] = Judge(lexicon(vocabulary_path), rules)
        judge = _judges[vocabulary_path, rules]
        for batch in batches:
            rows = []
            for page, url in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), strict=True):
                host, path = split_url(url)
                rule, p = judge.rule(host, path), judge.block_probability(host, path)
                rows.append((page, host, path, rule and rule[1] + rule[2], rule[0] if rule else "block" if p > threshold else "allow", p, judge.tokens(host, path)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    base = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"))
    return base.mapInArrow(run, "page_id bigint, host string, path string, rule string, verdict string, block_probability double, words array<string>")
