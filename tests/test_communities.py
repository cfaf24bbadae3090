"""Communities by modularity against a plain restatement, and what holds for every result."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from textloom.operators import communities


def graph_of(seed, n, groups, inside, between):
    """Edges of a graph of planted groups, with repeats, loops and both directions."""
    rng = random.Random(seed)
    out = []
    for _ in range(n * inside):
        a = rng.randrange(n)
        b = rng.randrange(n // groups) * groups + a % groups
        out.append((a, b))
    out += [(rng.randrange(n), rng.randrange(n)) for _ in range(n * between // 2)]
    return out


def links_of(edges):
    links = defaultdict(dict)
    for a, b in edges:
        if a != b:
            links[a][b] = links[b][a] = 1
    return links


def plain_settle(k, c, links, total, single):
    while True:
        kc, members = defaultdict(int), defaultdict(int)
        for u in k:
            kc[c[u]] += k[u]
            members[c[u]] += 1
        asked = []
        for u in k:
            if single and members[c[u]] > 1:
                continue
            toward = defaultdict(int)
            for v, w in links[u].items():
                toward[c[v]] += w
            mine = total * toward.get(c[u], 0) - k[u] * (kc[c[u]] - k[u])
            some = [(-(total * w - k[u] * kc[t]), t) for t, w in toward.items() if t != c[u]]
            if some and -min(some)[0] > mine:
                asked.append((min(some)[0] + mine, u, c[u], min(some)[1], toward[min(some)[1]], toward.get(c[u], 0)))
        asked.sort()
        gives = {}
        for _, _, own, target, _, _ in asked:
            gives.setdefault(own, True)
            gives.setdefault(target, False)
        entered, gone, moved = defaultdict(int), defaultdict(int), {}
        for _, u, own, target, w, w_own in asked:
            if gives[own] and not gives[target]:
                if total * (w - w_own) - k[u] * (kc[target] + entered[target] - (kc[own] - k[u] - gone[own])) > 0:
                    moved[u] = target
                entered[target] += k[u]
                gone[own] += k[u]
        if not moved:
            return c
        c = c | moved


def parts_of(nodes, links):
    """The smallest id that each node reaches."""
    found = {}
    for s in sorted(nodes):
        if s not in found:
            front = [s]
            found[s] = s
            while front:
                for v in links[front.pop()]:
                    if v not in found:
                        found[v] = s
                        front.append(v)
    return found


def worth(label, links, total):
    q = defaultdict(int)
    k = defaultdict(int)
    for u, to in links.items():
        k[label[u]] += sum(to.values())
        q[label[u]] += total * sum(w for v, w in to.items() if label[v] == label[u])
    return {c: q[c] - k[c] ** 2 for c in q}


def plain(edges):
    first = links_of(edges)
    total = sum(len(x) for x in first.values())
    links, k, of = first, {u: len(x) for u, x in first.items()}, {u: u for u in first}
    c = {u: u for u in k}
    while True:
        c = plain_settle(k, c, links, total, False)
        within = {u: {v: w for v, w in links[u].items() if c[v] == c[u]} for u in k}
        r = plain_settle(k, {u: u for u in k}, within, total, True)
        if all(r[u] == u for u in k):
            break
        of = {i: r[u] for i, u in of.items()}
        up, strength, lead = defaultdict(dict), defaultdict(int), {}
        for u in k:
            strength[r[u]] += k[u]
            lead[r[u]] = c[u]
            for v, w in links[u].items():
                if r[u] != r[v]:
                    up[r[u]][r[v]] = up[r[u]].get(r[v], 0) + w
        links, k, c = up, dict(strength), lead
    label = {i: c[u] for i, u in of.items()}
    label = parts_of(label, {u: [v for v in x if label[v] == label[u]] for u, x in first.items()})
    whole = parts_of(label, first)
    split, alone = worth(label, first, total), worth(whole, first, total)
    sums = defaultdict(int)
    for x in {(label[i], whole[i]) for i in label}:
        sums[x[1]] += split[x[0]]
    return {i: whole[i] if alone[whole[i]] > sums[whole[i]] else label[i] for i in label}


def frames(spark, n, edges):
    return spark.createDataFrame([(i,) for i in range(n)], "id int"), spark.createDataFrame(edges, "src int, dst int")


@pytest.mark.parametrize("seed, groups, inside, between", [(1, 10, 4, 1), (2, 25, 1, 1)])
def test_equal_to_a_plain_restatement(spark, seed, groups, inside, between):
    edges = graph_of(seed, 500, groups, inside, between)
    entities, table = frames(spark, 505, edges)
    want = plain(edges)
    got = {r.id: (r.community, r.size) for r in communities.by_modularity(entities, table.repartition(3), least=1).collect()}
    assert {i: c for i, (c, _) in got.items()} == {i: want.get(i, i) for i in range(505)}
    links = links_of(edges)
    total = sum(len(x) for x in links.values())
    assert sum(worth(want, links, total).values()) >= sum(worth(parts_of(links, links), links, total).values())
    inner = {u: [v for v in x if want[v] == want[u]] for u, x in links.items()}
    assert parts_of(want, inner) == want  # each community is connected, and named by its smallest id
    if groups == 10:  # the planted groups are found
        assert len({want[i] for i in want}) < 15 and sum(want[i] % 10 == i % 10 for i in want) > 450


def test_few_movers_for_each_round_settle_too(spark):
    edges = [(0, i) for i in range(1, 60)] + [(100, i) for i in range(101, 160)] + [(0, 100)]
    got = {r.id: r.community for r in communities.by_modularity(*frames(spark, 160, edges), movers=1).collect()}
    assert got == {i: 0 if i < 60 else 100 for i in [*range(60), *range(100, 160)]}


def test_one_round_takes_all_that_gain(spark):
    """However many ask for one community; in shares of work, of which a community has several, as in one."""
    want = {i: 1499 for i in range(1499)} | {i: 3499 for i in range(2000, 3499)}
    links = communities.undirected(spark.range(3500), spark.createDataFrame([*want.items()], "src long, dst long"))
    nodes = links.groupBy("u").agg(F.sum("w").alias("k")).withColumn("c", F.col("u"))
    for share in (500, communities.MOVERS):
        with communities._tables(spark) as kept:
            label = communities.settle(nodes, links, 2 * len(want), kept, rounds=1, movers=share)
            assert {r.u: r.c for r in label.collect()} == want | {1499: 1499, 3499: 3499}


def test_edges_that_do_not_count(spark):
    entities, none = frames(spark, 3, [(0, 0), (1, 99), (None, 2)])
    assert communities.by_modularity(entities, none).count() == 0
    assert {tuple(r) for r in communities.by_modularity(entities, none, least=1).collect()} == {(i, i, 1) for i in range(3)}
    assert communities.by_modularity(entities.limit(0), none.limit(0), least=1).count() == 0
    one = communities.by_modularity(*frames(spark, 3, [(0, 1), (1, 0), (0, 1)]))
    assert {tuple(r) for r in one.collect()} == {(0, 0, 2), (1, 0, 2)}
    links = communities.undirected(*frames(spark, 4, [(0, 1), (2, 3)]))
    assert communities.modularity(spark.createDataFrame([(0, 0), (1, 0), (2, 2), (3, 2)], "id int, community int"), links) == 0.5


def test_rounds_broadcast_no_table(spark):
    """What grows with the graph doesn't pass through the driver, however small its tables are on disk."""
    links = communities.undirected(spark.range(40), spark.createDataFrame(graph_of(3, 40, 4, 4, 1), "src long, dst long"))
    nodes = links.groupBy("u").agg(F.sum("w").alias("k")).withColumn("c", F.col("u"))
    total = links.agg(F.sum("w")).first()[0]
    moved = communities.moves(nodes, links, total, lambda df: df)
    worth = communities.contributions(nodes.select(F.col("u").alias("id"), F.col("c").alias("community")), links, total)
    for df in (links, moved, worth):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_links_are_joined_once_for_all_that_reads_them(spark, monkeypatch):
    """The checks' links, the links inside communities and the components are tables before they are read again and again."""
    from textloom.operators import communities, graph
    from textloom.plans import queries

    read = []
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for module in (graph, communities):
        real = module.connected
        monkeypatch.setattr(module, "connected", lambda links, *a, real=real, **k: read.append(plan(links)) or real(links, *a, **k))
    worth = communities.modularity
    monkeypatch.setattr(communities, "modularity", lambda labels, links: read.extend([plan(labels), plan(links)]) or worth(labels, links))
    rows = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("d", "f"), ("f", "f"), ("a", None), ("x", "a")]
    nodes = spark.createDataFrame([(c,) for c in "abcdefg"] + [(None,), ("a",)], "id string")
    edges = spark.createDataFrame(rows, "src string, dst string")
    monkeypatch.setattr(queries, "_entities", lambda *_: nodes)
    monkeypatch.setattr(queries, "_edges", lambda *_: edges)
    assert [tuple(r) for r in queries.QUERIES["graph_modularity_checks"](spark, "").collect()] == [(6, 0, True)]
    assert len(read) == 8 and not any("Join" in p for p in read)
