import math
from collections import defaultdict

import numpy as np
import pytest

from gridloom.llm import embdedup, urlgraph
from tests.llm.test_texts import components

VECTORS = "vec_id long, embedding array<float>, label int"


def plain(rows):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    dims = max((len(v) for _, v in ok), default=1)
    unit = [(i, np.pad(v, (0, dims - len(v))) / np.linalg.norm(v)) for i, v in ok]
    links = [(a, b) for a in range(len(unit)) for b in range(a + 1, len(unit)) if float(unit[a][1] @ unit[b][1]) >= 0.9 - 1e-12]
    degree = defaultdict(int)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    group = components(links, range(len(unit)))
    least = {}
    for k, (i, _) in enumerate(unit):
        least[group[k]] = min(i, least.get(group[k], i))
    return sorted((i, degree[k], least[group[k]]) for k, (i, _) in enumerate(unit))


@pytest.mark.parametrize("block", [embdedup.BLOCK, 60])
def test_links_equal_all_pairs(spark, block):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    copies = [(10_000 + i, rows[7][1]) for i in range(90)]
    got = embdedup.neighbours(table.unionByName(spark.createDataFrame([(*c, 0) for c in copies], VECTORS)), block=block).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == plain(rows + copies)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 0.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 0.0, 0.0]), (9, [0.0, 1.0]), (-3, [-0.0, 1.0]), (None, [1.0, 0.0])]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embdedup.neighbours(spark.createDataFrame([(*r, 0) for r in rows], VECTORS)).collect() if r.vec_id is not None)
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8)]
    assert got == sorted([(-3, 1, -3, True), (1, 2, 1, True), (2, 2, 1, False), *alone, (9, 1, -3, False), (9, 2, 1, False)])
    assert embdedup.neighbours(spark.createDataFrame([], VECTORS)).count() == 0


def test_threshold_is_exact():
    a, b = np.array([1.0, 0.0]), np.array([0.9, math.sqrt(1 - 0.81)])
    assert embdedup.exact_link(np.array([9.0, 0.0]).tobytes(), np.array([9.0, 0.0]).tobytes(), 0.9)
    assert embdedup.exact_link(a.tobytes(), b.tobytes(), 0.9) == (float(b[0]) ** 2 * 100 >= 81 * (float(b[0]) ** 2 + float(b[1]) ** 2))
    assert not embdedup.exact_link(a.tobytes(), (-b).tobytes(), 0.9)


PAGES = "page_id long, url string, html string"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:end], rest[end:]
    stop = min([path.index(c) for c in "?#" if c in path], default=len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path[:stop]


def rule(host, path):
    fit = [(len(h + p), h + p, k) for k, h, p in urlgraph.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


ODD = ["http://A.Example.ORG/es/x?q#f", "x://example.org/en/12", "//no", None, "", "https://sub.com#/fr/", "a://b://com/fr/", "h://ÄÉ.com/de/ü\nx", "h://notcom/fr/", "h://com", "h://com/fr/?a/de/", "h://org", "h://example.org/en/2", "h://u.net?x"]


def test_hosts_paths_and_rules(spark):
    real = [(r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    rows = real + [(1000 + i, u, None) for i, u in enumerate(ODD)] + [(1000, ODD[0], "again"), (None, "h://com/de/", "")]
    got = urlgraph.verdicts(spark.createDataFrame(rows, PAGES)).collect()
    want = sorted((str(i), *split(u), rule(*split(u))[0] or "") for i, u, _ in rows)
    assert sorted((str(r.page_id), r.host, r.path, r.rule or "") for r in got) == want
    assert all(r.verdict == rule(r.host, r.path)[1] for r in got if r.rule)
    assert all(r.verdict in ("allow", "block") for r in got)


def test_distrust_flows_back_and_trust_forward(spark):
    link = lambda *hosts: "".join(f"<a href='https://{h}/x'>" for h in hosts)
    rows = [
        (1, "http://bad.com/de/1", ""),
        (2, "http://farm.net/1", link("bad.com", "bad.com")),
        (3, "http://good.org/1", link("friend.net")),
        (4, "http://friend.net/1", link("good.org")),
        (5, "http://alone.net/1", link("alone.net")),
        (6, "http://far.net/1", link("farm.net")),
        (7, "http://mixed.net/", link("good.org", "bad.com")),
    ]
    got = {r.page_id: r.verdict for r in urlgraph.verdicts(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "block", 7: "block"}


def test_ranks_equal_plain_iteration(spark):
    edges = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "a", 1), ("d", "c", 3)]
    hosts = {"a": 0.0, "b": 0.0, "c": 0.0, "d": 1.0}
    found = urlgraph.rank(spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame(list(hosts.items()), "host string, good double"), "good")
    out = defaultdict(int)
    for s, _, n in edges:
        out[s] += n
    base = {h: 0.15 * w for h, w in hosts.items()}
    now = dict(base)
    for _ in range(500):
        now = {h: base[h] + sum(0.85 * n / out[s] * now[s] for s, d, n in edges if d == h) for h in hosts}
    assert {r.host: pytest.approx(r.rank, abs=2e-6) for r in found.collect()} == {h: x for h, x in now.items() if x}


def test_no_pages(spark):
    assert urlgraph.verdicts(spark.createDataFrame([], PAGES)).count() == 0
