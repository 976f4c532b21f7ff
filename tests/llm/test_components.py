import random

from relevanta.llm.components import connected_components


def test_components_of_random_links(spark):
    rng = random.Random(11)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(200 + i, 201 + i) for i in range(30)] + [(300, 300 + i) for i in range(1, 40)] + [(5, 5)]
    parent = {i: i for e in links for i in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: top(i) for i in parent if any(top(j) == top(i) for j in parent if j != i)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []
