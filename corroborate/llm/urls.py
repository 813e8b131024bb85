"""URL filter: rules for hosts and paths, and for the rest a word model.

Names in hosts and paths are run together (``freebets``), so each is split
into words first: the most probable split under a unigram model (Viterbi),
whose counts are those of the words in all pages. Multinomial naive Bayes then
compares the words of host and path under two distributions: *allow* is that
of all pages' words, *block* is an even mixture of a list of words that name
unwanted sites and that same background. So a word that is not in the list
counts slightly towards allow, and a listed word the more towards block the
rarer it is in pages.

Size: the counts of all words stay in Spark. Rows are dealt to chunks of a few
thousand urls; the pieces of a chunk's names are joined to the counts, and the
chunk is judged with the shares of those pieces that are words.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from corroborate.llm.common import add_columns, fresh_names, received, send, slices, without
from corroborate.session import cut_lineage

#: Share of a listed word that no page has: that of one word in all pages, and this at most.
LEAST_SHARE = 1e-5
#: Letters of a piece of a name that is looked up among known words. Whole names are looked up at any length.
LONGEST_WORD = 24
#: Log probability of a piece that is no known word, and of each of its letters.
UNKNOWN, UNKNOWN_LETTER = -14.0, -2.5
#: A chunk of rows that are judged together: bytes of urls, rows, bytes of all columns (one row at least).
CHUNK_URL_BYTES, CHUNK_ROWS, CHUNK_BYTES = 1 << 17, 4096, 1 << 24
#: Pieces of a chunk that are held at once to leave out repeated ones.
PIECES_HELD = 200_000

# Rules (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

# Words that name unwanted sites.
UNWANTED = """
adult adults ads adserver anal babes bet bets betting bingo bitcoin bonus bonuses boobs bride brides cams camgirl cash casino casinos
cheap cialis clickbait cracked crypto dating deal deals detox diet drugs ero erotic escort escorts fake fetish free gamble gambling
farm girls hack hacked hentai hookup hot jackpot keygen keno kinky levitra loan loans lottery lotto lucky milf mortgage naked
nude nudes payday pharma pharmacy phish phishing pills pirate poker porn porno pron replica roulette rx scam sex sexy
shemale singles slot slots spam sportsbook sluts strip swinger teens torrent torrents track tracker tracking tramadol viagra vpn wager warez
webcam win winner xanax xxx
""".split()

_LETTERS = re.compile(r"[^\W\d_]+")
_UPPER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host in lower case (A-Z) and path; both empty for null and without ``://``."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return host.translate(_UPPER), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def names(host: str, path: str) -> list[str]:
    """The runs of letters in all labels of a host and in a path."""
    return _LETTERS.findall(f"{host} {path.translate(_UPPER)}")


class Rules:
    """Look-up by host and its parent domains."""

    def __init__(self, rules=RULES):
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for host, path, verdict in rules:
            self.by_host.setdefault(host, []).append((path, verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest rule (host and path together) that fits, and its verdict."""
        best = None
        while host:
            for prefix, verdict in self.by_host.get(host, ()):
                if path.startswith(prefix) and (best is None or len(host + prefix) > len(best[0])):
                    best = (host + prefix, verdict)
            host = host.partition(".")[2]
        return best


@dataclass
class WordModel:
    """Log probabilities of words in pages, and what each unwanted word tells.

    With ``counts`` (word, n) and their ``total``, ``log_share`` has the listed
    words only; ``judge_urls`` looks up the others.
    """

    log_share: dict[str, float]
    unwanted: tuple[str, ...] = tuple(UNWANTED)
    block_share: float = 0.05  # prior of unwanted sites
    counts: DataFrame | None = None
    total: int = 0
    evidence: dict[str, float] = field(init=False)

    def __post_init__(self):
        floor = math.log(LEAST_SHARE)
        self.evidence = {}
        for word in self.unwanted:
            background = math.exp(self.log_share.get(word, floor))
            listed = 0.5 / len(self.unwanted) + 0.5 * background
            self.evidence[word] = math.log(listed / background)
            self.log_share.setdefault(word, floor)
        self.other = math.log(0.5)
        self.prior = math.log(self.block_share / (1 - self.block_share))
        self.cache: dict[str, list[str]] = {}

    def with_counts(self, found: dict[str, int]) -> WordModel:
        """This model with the shares of the given words, for use in a task."""
        shares = {w: math.log(n / self.total) for w, n in found.items()}
        return replace(self, log_share=shares | self.log_share, counts=None)

    def segment(self, name: str) -> list[str]:
        """The most probable split of a name; of equal ones the one with the longest last word.

        A piece that is no known word costs more the longer it is, but less
        than its letters one by one, so unknown names stay whole, whatever
        their length. Known pieces have ``LONGEST_WORD`` letters at most, or are the whole name.
        """
        if name in self.cache:
            return self.cache[name]
        best, back = [0.0], [0]
        ahead = (0.0, 0)  # where an unknown piece best begins: its cost is in proportion to its length
        for end in range(1, len(name) + 1):
            choices = [(ahead[0] + UNKNOWN + UNKNOWN_LETTER * end, ahead[1])]
            for start in range(max(0, end - LONGEST_WORD), end):
                known = self.log_share.get(name[start:end])
                if known is not None:
                    choices.append((best[start] + known, -start))
            if end == len(name) and name in self.log_share:
                choices.append((self.log_share[name], 0))
            score, start = max(choices)
            best.append(score)
            back.append(-start)
            ahead = max(ahead, (score - UNKNOWN_LETTER * end, -end))
        words, end = [], len(name)
        while end:
            words.append(name[back[end] : end])
            end = back[end]
        if len(self.cache) > 50_000:
            self.cache.clear()
        self.cache[name] = words[::-1]
        return self.cache[name]

    def words(self, host: str, path: str) -> list[str]:
        """Words of host (all labels) and path."""
        return [w for part in names(host, path) for w in self.segment(part)]

    def block_probability(self, words: list[str]) -> float:
        if not words:
            return self.block_share
        score = self.prior + sum(self.evidence.get(w, self.other) for w in words)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, score))))


def count_words(pages: DataFrame, html: str = "html") -> DataFrame:
    """(word, n) over the texts of all pages: letters only, lower-cased; tags, scripts and styles left out."""
    plain = F.regexp_replace(F.col(html).cast("string"), r"(?is)<(script|style)\b.*?</\1>|<[^>]*>", " ")
    words = F.regexp_extract_all(F.lower(plain), F.lit(r"\p{L}++"), F.lit(0))
    return pages.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def train(pages: DataFrame, html: str = "html") -> WordModel:
    """Word counts over all pages. Without any page the model knows the listed words only."""
    counts = cut_lineage(count_words(pages, html))
    total = counts.agg(F.sum("n")).first()[0] or 0
    if not total:
        return WordModel({})
    seen = {r["word"]: r["n"] / total for r in counts.filter(F.col("word").isin(UNWANTED)).collect()}
    shares = {w: math.log(seen.get(w, min(LEAST_SHARE, 1 / total))) for w in UNWANTED}
    return WordModel(shares, counts=counts, total=total)


SCHEMA = "host string, path string, rule string, words array<string>, block_probability double, verdict string"


def judge_urls(pages: DataFrame, model: WordModel, url: str = "url", rules=RULES) -> DataFrame:
    """All rows of ``pages`` with host, path, rule, words, block_probability and verdict.

    A rule fits its host and all subdomains if the path starts with its path;
    the longest decides. Without one the verdict is ``block`` if the model's
    probability is over one half. A null url, and one without ``://``, has an
    empty host and path, no rule and the verdict ``allow``. Columns of
    ``pages`` with one of these names are replaced; repeated rows are judged
    each on its own.
    """
    sent = send(pages.sparkSession, replace(model, counts=None))
    if model.counts is None:
        return add_columns(pages, url, SCHEMA, lambda: _judge(received(sent), rules))
    new = Ty._parse_datatype_string(SCHEMA).fields
    read, chunk = fresh_names(pages, "_read", "_chunk")
    kept = pages.select(*without(pages, *(f.name for f in new)), F.col(f"`{url}`").cast("string").alias(read))
    # Stored, so that pieces and rows have the same chunks.
    rows = cut_lineage(in_chunks(kept, chunk))
    pieces = rows.select(F.col(f"`{chunk}`").alias("chunk"), F.col(f"`{read}`").alias("url"))
    pieces = pieces.mapInArrow(_pieces, "chunk bigint, word string")
    found = pieces.join(model.counts, "word").select("chunk", "word", "n")
    out = Ty.StructType([*kept.schema.fields[:-1], *new])

    def judge(part, words):
        known = dict(zip(words.column("word").to_pylist(), words.column("n").to_pylist()))
        compute = _judge(received(sent).with_counts(known), rules)
        made = compute(part.column(part.num_columns - 2))
        return pa.Table.from_arrays([*part.columns[:-2], *made], names=out.names)

    return rows.groupBy(f"`{chunk}`").cogroup(found.groupBy("chunk")).applyInArrow(judge, out)


def in_chunks(df: DataFrame, chunk: str) -> DataFrame:
    """``df``, whose last column is the url, with the number of each row's chunk."""

    def run(batches):
        first, n = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            rows = max(1, min(CHUNK_ROWS, batch.num_rows * CHUNK_BYTES // max(1, batch.nbytes)))
            for part in slices(batch, batch.num_columns - 1, CHUNK_URL_BYTES, rows):
                number = pa.array([first + n] * part.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, number], names=[*part.schema.names, chunk])
                n += 1

    return df.mapInArrow(run, Ty.StructType([*df.schema.fields, Ty.StructField(chunk, Ty.LongType())]))


def _pieces(batches):
    """(chunk, word) for all pieces, up to the longest word, of the names in urls; nearly without repeated ones."""

    def made(number, held):
        return pa.RecordBatch.from_arrays(
            [pa.array([number] * len(held), pa.int64()), pa.array(list(held), pa.string())], names=["chunk", "word"]
        )

    number, held, done = None, set(), set()
    for batch in batches:
        for at, address in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if at != number:
                if held:
                    yield made(number, held)
                number, held, done = at, set(), set()
            for name in names(*split_url(address)):
                if name in done:
                    continue
                if len(done) < PIECES_HELD:
                    done.add(name)
                held.add(name)
                for start in range(len(name)):
                    held.update(name[start:end] for end in range(start + 1, min(len(name), start + LONGEST_WORD) + 1))
                    if len(held) > PIECES_HELD:
                        yield made(number, held)
                        held = set()
    if held:
        yield made(number, held)


def _judge(words: WordModel, rules):
    """The function of an array of urls to the arrays of the new columns."""
    table = Rules(rules)

    def one(address: str | None):
        host, path = split_url(address)
        rule = table.find(host, path)
        split = words.words(host, path)
        p = words.block_probability(split)
        verdict = rule[1] if rule else "block" if p > 0.5 else "allow"
        return host, path, rule[0] if rule else None, split, p, verdict

    kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.float64(), pa.string()]

    def compute(urls) -> list[pa.Array]:
        columns = list(zip(*map(one, urls.to_pylist()))) or [()] * len(kinds)
        return [pa.array(c, kind) for c, kind in zip(columns, kinds)]

    return compute
