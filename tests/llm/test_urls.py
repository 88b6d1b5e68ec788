"""URL filters: rules against brute force, and the model on hosts and paths that its table does not hold."""

import random

import duckdb
import numpy as np

from tidewheel.llm import url_filters

HELD_OUT = "royal-bingo viagra loan-shark gambling-site betting-tips lottery-spins porn-tube fast-payday poker24 pharma-direct bitcoin-giveaway sex-chat slots-room banner-net warez-land replica-store".split()
ORDINARY = "sussex-farm middlesex-council free-library adelaide-arts trackandfield oldtown-rowing chess-in-schools botanic-garden bookbinders nordic-choir tramways limestone-caves harbour-pilots".split()


def scorer(table):
    weights, bias = url_filters.train(tuple(table))

    def score(url):
        at, x = url_filters.grams(*url_filters.split_url(url))
        return float(1 / (1 + np.exp(-(weights[at] @ x + bias))))

    return score


def test_held_out_hosts_and_paths():
    table = url_filters.labelled_urls()
    score = scorer(table)
    known = {p for u, _ in table for p in url_filters.split_url(u)[0].split(".")}
    names = [r[0] for r in duckdb.sql("select distinct url from '/root/testdata/sf0.01/pages.parquet' where url like '%://%'").fetchall()]
    assert not known & {url_filters.split_url(u)[0].split(".")[-3] for u in names}
    held = [n for n in HELD_OUT if n not in known]
    assert len(held) > 10
    assert np.mean([score(f"http://www.{n}.example.org/en/77") >= 0.5 for n in held]) >= 0.8  # 13 of 15 as measured
    assert np.mean([score(f"http://www.{n}.example.org/en/77") >= 0.5 for n in ORDINARY]) <= 0.1
    known -= set("www m blog shop example com net org info eu".split())
    other = [(u, y) for u, y in url_filters.labelled_urls(2000, 77) if u and not known & set(url_filters.split_url(u)[0].split("."))]
    assert len(other) > 1000
    got = np.array([score(u) >= 0.5 for u, _ in other])
    y = np.array([label for _, label in other])
    assert got[y == 1].mean() > 0.9 and got[y == 0].mean() < 0.02
    # The path alone tells, too.
    assert score("http://mirlowan.example.net/casino/signup-bonus/17") > score("http://mirlowan.example.net/wiki/17") + 0.2
    assert score("") < 0.5


def test_rules_equal_brute_force(spark):
    rng = random.Random(6)
    parts, paths = ["a", "b", "com", "example", "net", "ba"], ["/", "/en/", "/en/7", "/de/8", "", "/e"]
    rules = {".".join(rng.sample(parts, rng.randint(1, 3))) + rng.choice(paths): rng.choice(["block", "allow"]) for _ in range(60)}
    urls = [f"http://{'.'.join(rng.choice(parts) for _ in range(rng.randint(1, 4)))}{rng.choice(paths)}{rng.choice(['', 'x', '?q=/en/', '#/en/7'])}" for _ in range(400)]
    urls += [None, "", "://", "x://", "HTTP://A.Com/en/", "a.com/en/", "http://" + "a." * 5000 + "com/en/" + "7" * 20000] + urls[:5]

    def rule(host, path):
        def fits(r):
            h, slash, p = r.partition("/")
            return (host == h or host.endswith("." + h)) and path.startswith(slash + p)

        return max((r for r in rules if fits(r)), key=lambda r: (len(r), len(r.partition("/")[0])), default=None)

    got = url_filters.url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string"), rules).collect()
    score = scorer(url_filters.labelled_urls())
    assert len(got) == len(urls)
    for r in got:
        host, path = url_filters.split_url(urls[r.page_id] or "")
        want = rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, want)
        assert abs(r.score - score(urls[r.page_id] or "")) < 1e-6
        assert r.verdict == (rules[want] if want else "block" if r.score >= 0.5 else "allow")
