"""Verdicts over pages that link across hosts: a solved linear system, and the query's SQL."""

import random

import duckdb
import numpy as np
import pandas as pd

from gridloom.llm import oracles, urlgraph

PAGES = "page_id long, url string, html string"


def pages(n=120, seed=5):
    """Hosts in a ring of short links with random far ones, hosts without links, a chain of 40 to a blocked host."""
    draw = random.Random(seed)
    hosts = [f"h{i}.{draw.choice(['org', 'com', 'net', 'net'])}" for i in range(n)] + [f"chain{i}.net" for i in range(40)] + ["end.com"]
    rows = []
    for i, h in enumerate(hosts[:n]):
        for _ in range(draw.randrange(1, 4)):
            to = [hosts[(i + draw.randrange(1, 4)) % n], draw.choice(hosts[:n])] if i % 7 else []
            rows.append((len(rows), f"https://{h}{draw.choice(['/fr/a', '/de/b', '/x', '/es/'])}", "".join(f'<a href="//{t}/p">' for t in to)))
    for i in range(40):
        rows.append((len(rows), f"http://chain{i}.net/", f'<a href="http://{hosts[n + i + 1]}/">'))
    return [*rows, (len(rows), "http://end.com/de/", ""), (len(rows) + 1, None, None)]


def walk(links, seeds):
    """Ranks of a walk with returns from hosts without links, from the linear system."""
    names = sorted({h for e in links for h in e} | {h for h, w in seeds.items() if w})
    at = {h: i for i, h in enumerate(names)}
    step = np.zeros((len(names), len(names)))
    for (s, d), k in links.items():
        step[at[d], at[s]] += k
    sums = step.sum(axis=0)
    v = np.array([seeds.get(h, 0.0) for h in names])
    step = np.where(sums > 0, step / np.where(sums > 0, sums, 1), (v / v.sum())[:, None])
    return dict(zip(names, np.linalg.solve(np.eye(len(names)) - 0.85 * step, 0.15 * v)))


def test_scores_solve_the_walks_equations_and_verdicts_equal_the_sql(spark):
    rows = pages()
    df = spark.createDataFrame(rows, PAGES)
    got = {r.host: r for r in urlgraph.host_scores(df).collect()}
    links = {(r.src, r.dst): r.n for r in urlgraph.host_links(df).collect()}
    judged = urlgraph.verdicts(df).collect()
    by_host = {}
    for r in judged:
        if r.host:
            by_host.setdefault(r.host, []).append(r.verdict if r.rule else "")
    seeds = {k: {h: v.count(k) / len(v) for h, v in by_host.items()} for k in ("allow", "block")}
    trust, distrust = walk(links, seeds["allow"]), walk({(d, s): k for (s, d), k in links.items()}, seeds["block"])
    assert got["chain5.net"].distrust > 0 and got["chain5.net"].blocked
    for h, r in got.items():
        assert abs(r.trust - trust.get(h, 0)) < 1e-4 and abs(r.distrust - distrust.get(h, 0)) < 1e-4
    for r in judged:
        share = distrust.get(r.host, 0) - urlgraph.BLOCK_SHARE * (trust.get(r.host, 0) + distrust.get(r.host, 0))
        if not r.rule and abs(share) > 1e-4:
            assert r.verdict == ("block" if share > 0 else "allow"), r
    assert sum(not r.rule and r.verdict == "block" for r in judged) > 10
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]))
    want = con.execute(oracles.urls()).fetchdf()
    assert sorted(zip(want["page_id"], want["verdict"])) == sorted((r.page_id, r.verdict) for r in judged)
