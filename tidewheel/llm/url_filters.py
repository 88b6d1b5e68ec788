"""URL filters: host rules first, then logistic regression on hashed character n-grams of host and path.

The model is trained on the driver from a small labelled URL table (that of
``labelled_urls`` or the caller's, at most ``MAX_LABELLED`` rows). Its weights
are a fixed ``2**BITS`` floats, so what goes to the executors does not grow
with the data.

Defined cases: a null URL, or one without ``://``, has an empty host and path,
fits no rule and is judged by the model's bias alone; of fitting rules the
longest wins, as host and path prefix together, and of equally long ones that
of the longer host; URLs of any length are judged whole; repeated rows are
judged each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import common

BITS = 15
GRAMS = (3, 4, 5)
MAX_LABELLED = 20_000

#: Rules of the registered query: a host, then a path prefix.
RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}

# Words of the small labelled table (fixed values): what unwanted sites call themselves, by theme, with sections of such
# sites, and what ordinary ones do.
THEMES = {
    "betting": ("casino bet betting bingo poker roulette jackpot slots lotto lottery wager gamble gambling blackjack sportsbook", "play-now signup-bonus spin odds live-dealer"),
    "adult": ("adult porn sex xxx erotic nude webcam escort hentai fetish hookup nsfw", "cams hot-girls uncensored-clips dating-now"),
    "drugs": ("pills viagra cialis pharma steroids xanax painkiller weightloss", "buy-online no-prescription order-now cheap-meds"),
    "money": ("loan payday lender quickcash forex bitcoin doubler getrich prize giveaway sweepstake lucky", "claim-prize apply-now instant-cash you-won"),
    "spam": ("spam backlink linkbuilding clickbait autoblog follower-boost trafficbot articlespin", "submit-link exchange-links buy-followers"),
    "malware": ("warez crack keygen hacktool cheatcode exploit malware phish trojan botnet", "free-download/setup.exe verify-account/login serial-key"),
    "ads": ("ads adserver banner popup popunder tracker tracking pixel beacon affiliate adclick", "click track/pixel.gif adframe redirect-out"),
    "fakes": ("replica counterfeit knockoff fakeid diploma-mill", "luxury-replica outlet-sale copy-watches"),
}
FLAVOURS = "online best top super 24 now club zone world hub vip direct king mega city my the bonus free cheap win shop".split()
PLAIN = (
    "library museum university science history weather recipe garden travel news wiki archive journal school council hospital railway bakery cycling astronomy "
    "poetry theatre gazette research music maps biology physics chemistry maths literature language dictionary sport football tennis village county river mountain "
    "forest market farmer trail running photo camera film cinema book reader writer paper review design studio engineering software linux code developer docs forum "
    "help support store family kids health clinic doctor dental church charity community energy solar water bank insurance law court police fire government ministry "
    "parliament embassy tourism hotel restaurant coffee kitchen wine flower animal bird ocean climate essex sussex middlesex scunthorpe analytics transaction"
).split()
SECTIONS = "news articles wiki docs about contact events products category blog archive 2021/05 people help gallery reports".split()
LANGUAGES = "en fr de es it pt nl".split()
_STARTS = "b br c ch cl d dr f fl g gr h j k l m n p pl pr r s sh sl st t th tr v w y z".split()
_VOWELS = "a e i o u ai ea ie oo ou".split()
_ENDS = ["", "", "", "n", "r", "s", "l", "t", "nd", "st", "ck", "ng", "rn", "ld"]
_SUFFIXES = "example.com example.net example.org com net org info eu".split()


def labelled_urls(rows: int = 6000, seed: int = 11) -> list[tuple[str, int]]:
    """The small labelled table: hosts and paths put together from the words above and from invented names, 1 for unwanted.

    Either label may have a neutral path, and an invented host whose path is
    that of an unwanted site is unwanted, so hosts and paths both carry the label.
    Some rows have no host; they are wanted.
    """
    rng = np.random.default_rng(seed)
    pick = lambda of: of[int(rng.integers(0, len(of)))]
    themes = list(THEMES.values())

    def invented() -> str:
        return "".join(pick(_STARTS) + pick(_VOWELS) + pick(_ENDS) for _ in range(int(rng.integers(2, 4))))

    def joined(a: str, b: str) -> str:
        a, b = (a, b) if rng.random() < 0.5 else (b, a)
        return a + pick(["-", ""]) + b

    def neutral() -> str:
        number = str(int(rng.integers(1, 100_000)))
        return pick([f"/{pick(LANGUAGES)}/{number}", f"/{pick(LANGUAGES)}/{number}/", f"/{pick(LANGUAGES)}/{number}.html", "/", "", f"/{pick(SECTIONS)}/{number}", f"/{pick(SECTIONS)}/{invented()}-{invented()}", f"/{pick(LANGUAGES)}/{invented()}"])

    out = []
    for i in range(rows):
        words, sections = pick(themes)
        bad, section = pick(words.split()), f"/{pick(sections.split())}/{int(rng.integers(1, 10_000))}"
        kind = i % 8
        if kind == 0:
            host, path, label = joined(bad, pick(FLAVOURS)), neutral(), 1
        elif kind == 1:
            host, path, label = pick([bad, joined(bad, pick(words.split()))]), pick([section, neutral()]), 1
        elif kind == 2:
            host, path, label = joined(bad, pick([invented(), pick(PLAIN)])), neutral(), 1
        elif kind == 3:
            host, path, label = invented(), section, int(rng.random() < 0.98)
        elif kind == 4:
            host, path, label = joined(pick(PLAIN), pick([pick(PLAIN), pick(FLAVOURS), invented()])), neutral(), 0
        elif kind in (5, 6):
            host, path, label = pick([invented(), joined(invented(), invented())]), neutral(), 0
        else:
            host, path, label = pick(PLAIN), neutral(), 0
        out.append((f"http{pick(['', 's'])}://{pick(['', '', 'www.', 'www.', 'm.', 'blog.', 'shop.'])}{host}.{pick(_SUFFIXES)}{path}{pick(['', '', '?page=2', '#top'])}", label))
    return out + [("", 0)] * (rows // 50)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return common.ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def split_url(url: str) -> tuple[str, str]:
    """The same for one URL of the labelled table."""
    _, there, rest = url.partition("://")
    if not there:
        return "", ""
    for c in "?#":
        rest = rest.partition(c)[0]
    host, slash, path = rest.partition("/")
    return host.translate(str.maketrans(common.UPPER, common.LOWER)), slash + path


_MARKS = re.compile(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def grams(host: str, path: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the distinct hashed n-grams and their values. Host and path have n-grams of their own, each part of length 1; all ASCII marks are one."""
    mask, buckets, values = (1 << bits) - 1, [], []
    for part, text in ((b"h", host), (b"p", path)):
        if text:
            raw, own = _MARKS.sub(b"|", b"|" + text.encode().lower() + b"|"), set()
            for k in GRAMS:
                own.update(zlib.crc32(raw[i : i + k], part[0]) & mask for i in range(len(raw) - k + 1))
            buckets += sorted(own)
            values += [1 / max(1, len(own)) ** 0.5] * len(own)
    return np.array(buckets, dtype=np.int64), np.array(values)


@functools.lru_cache(maxsize=8)
def train(labelled: tuple[tuple[str, int], ...], bits: int = BITS, l2: float = 0.1, steps: int = 400, rate: float = 0.08) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the logistic loss; label 1 is block. Buckets that no labelled URL has keep weight 0."""
    if len(labelled) > MAX_LABELLED:
        raise ValueError(f"the labelled table has more than {MAX_LABELLED} rows")
    rows = [grams(*split_url(u), bits) for u, _ in labelled]
    used, at = np.unique(np.concatenate([*[r[0] for r in rows], np.zeros(0, dtype=np.int64)]), return_inverse=True)
    owner, x = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows]), np.concatenate([*[r[1] for r in rows], np.zeros(0)])
    y = np.array([label for _, label in labelled], dtype=float)
    w = np.zeros(len(used) + 1)  # the bias last
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1 if rows else 0):
        wrong = 1 / (1 + np.exp(-(np.bincount(owner, weights=w[at] * x, minlength=len(rows)) + w[-1]))) - y
        g = np.append(np.bincount(at, weights=wrong[owner] * x, minlength=len(used)) + l2 * w[:-1], wrong.sum()) / len(rows)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    full = np.zeros(1 << bits, dtype=np.float32)
    full[used] = w[:-1]
    return full, float(w[-1])


def longest_rule(host: str, path: str, hosts: dict[str, list[str]]) -> str | None:
    """hosts: the rules' path prefixes by host, longest first."""
    best = None
    while host:
        for prefix in hosts.get(host, ()):
            if path.startswith(prefix):
                best = max(best or "", host + prefix, key=len)  # of equal ones the first, whose host is longer
                break
        host = host.partition(".")[2]
    return best


def url_filter(pages: DataFrame, rules: dict[str, str], labelled: Iterable[tuple[str, int]] | None = None, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """(id, host, path, rule, verdict, score): score is the model's probability of block, verdict the longest fitting rule's or else the model's."""
    weights, bias = train(tuple(labelled_urls() if labelled is None else labelled))
    sent = pages.sparkSession.sparkContext.broadcast(weights)
    hosts: dict[str, list[str]] = {}
    for rule in sorted(rules, key=len, reverse=True):
        h, slash, p = rule.partition("/")
        hosts.setdefault(h, []).append(slash + p)

    @F.arrow_udf("struct<rule string, score double>")
    def judge(host: pa.Array, path: pa.Array) -> pa.Array:
        w, found, scores = sent.value, [], []
        for h, p in zip(host.to_pylist(), path.to_pylist(), strict=True):
            g, x = grams(h, p)
            scores.append(float(1 / (1 + np.exp(-(w[g] @ x + bias)))))
            found.append(longest_rule(h, p, hosts))
        return pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(scores, pa.float64())], ["rule", "score"])

    verdicts = F.create_map(*[F.lit(x) for kv in rules.items() for x in kv]) if rules else None
    url = F.col(url_col).cast("string")
    out = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    out = out.withColumn("judged", judge.asNondeterministic()("host", "path"))
    ours = verdicts[F.col("judged.rule")] if rules else F.lit(None).cast("string")
    model = F.when(F.col("judged.score") >= threshold, "block").otherwise("allow")
    return out.select(id_col, "host", "path", F.col("judged.rule").alias("rule"), F.coalesce(ours, model).alias("verdict"), F.col("judged.score").alias("score"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(common.table(spark, sf_dir, "pages"), RULES)
