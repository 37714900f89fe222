import random
import re

from inkwell.llm import nearjoin as N

from .conftest import sentence


def grams(t):
    w = re.findall(r"\w+", (t or "").lower())
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """doc order number -> (links, smallest id of its group)"""
    sets = [grams(t) for _, t in rows]
    n, links, root = len(rows), [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(n):
            if i != j and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    first = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            first[find(i)] = min(d, first.get(find(i), d))
    return sorted((-1 if d is None else d, links[i], -1 if not sets[i] and d is None else first.get(find(i), -1))
                  for i, (d, _) in enumerate(rows))


def got(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_links, -1 if r.class_id is None else r.class_id)
                  for r in df.collect())


def edited(rnd, words, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"new{rnd.randrange(10 ** 6)}"
    return " ".join(words)


def test_prefix_length_meets_the_recall():
    d = N.prefix_length()
    assert 1 < d < N.LONGEST and 1 - (1 - 0.8 ** d) ** N.TREES >= N.RECALL > 1 - (1 - 0.8 ** (d + 1)) ** N.TREES
    assert N.prefix_length(threshold=0.99) == N.LONGEST and N.prefix_length(threshold=0.01) == 1


def test_messy_rows(spark, messy, nothing):
    assert got(N.join(messy)) == brute([(r.doc_id, r.text) for r in messy.collect()])
    assert N.join(nothing).count() == 0 and N.one_of_each(nothing).count() == 0


def test_near_copies_around_the_threshold_in_blocks(spark, monkeypatch):
    rnd = random.Random(11)
    rows, i = [], 0
    for _ in range(6):
        words = sentence(rnd, 200, 5000).split()
        for _ in range(25):
            rows.append((i, edited(rnd, words, rnd.randint(0, 6))))
            i += 1
    rows += [(1000 + k, sentence(rnd, 60, 5000)) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert got(N.join(df)) == want
    monkeypatch.setattr(N, "BLOCK_CLASSES", 4)             # many units a component
    assert got(N.join(df)) == want


def test_one_row_of_each_group_stays(spark, messy):
    left = N.one_of_each(messy)
    assert left.columns == messy.columns
    kept = sorted((-1 if r.doc_id is None else r.doc_id, (r.text or "")[:5]) for r in left.collect())
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    bare = [x for x in rows if not grams(x[1])]
    groups = {c for _, _, c in got(N.join(messy.where("text is not null"))) if c >= 0}
    assert {d for d, _ in kept if d >= 0} >= groups - {2, 3} and not {2, 3} & {d for d, _ in kept}
    assert len(kept) == len(bare) + len({x for x in rows if grams(x[1])}) - 2       # 1, 2 (twice) and 3 are one group


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(str(k), str(k + 1)) for k in range(100, 180)] + [("x", "x"), ("y", "z")], "a string, b string")
    found = {r.node: r.root for r in N.components(edges, "t").collect()}
    assert {found[str(k)] for k in range(100, 181)} == {"100"} and found["z"] == "y"
