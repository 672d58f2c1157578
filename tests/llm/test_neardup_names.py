import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import components, metric, names, neardup


def test_trie_join_equals_all_pairs():
    g = np.random.default_rng(2)
    base = g.integers(0, 256, (40, 16), dtype=np.uint8)
    near = base.copy()
    for row in near:
        for b in g.integers(0, 128, 12):
            row[b >> 3] ^= 1 << (b & 7)
    bits = np.concatenate([base, near, base[:5]])
    sizes = g.integers(20, 90, len(bits))
    d = np.bitwise_count(bits[:, None] ^ bits[None]).sum(2, dtype=int)
    for t in (0.6, 0.8):
        rate = (1 - t) / (1 + t)
        ok = d <= rate * (sizes[:, None] + sizes[None]) + 1e-9
        want = {(i, j) for i in range(len(bits)) for j in range(i + 1, len(bits)) if ok[i, j]}
        assert {tuple(sorted(p)) for p in neardup.trie_join(bits, sizes, t).tolist()} == want
        cross = neardup.trie_join(bits[:45], sizes[:45], t, (bits[45:], sizes[45:]))
        assert {(i, j + 45) for i, j in cross.tolist()} == {p for p in want if p[0] < 45 <= p[1]}
        counts = neardup.Walked()
        neardup.trie_join(bits, sizes, t, walked=counts)
        every = len(bits) * (len(bits) - 1) // 2
        assert counts.leaves == len(want) and counts.pruned > 0 and counts.nodes < 40 * every
        edges = np.array([0, 40, 43, 43, 80, len(bits)])
        cells = {tuple(sorted(p)) for p in neardup.forest_join(bits, sizes, edges, t).tolist()}
        assert cells == {p for p in want if np.searchsorted(edges, p[0], "right") == np.searchsorted(edges, p[1], "right")}
    assert len(neardup.trie_join(bits[:0], sizes[:0], 0.6)) == 0 and len(neardup.trie_join(bits[:1], sizes[:1], 0.6)) == 0


def brute(records, k, t):
    runs = lambda s: frozenset(tuple(w[i : i + k]) for w in [re.findall("[a-z0-9]+", (s or "").lower())] for i in range(len(w) - k + 1))
    r = [(kind, i, runs(s)) for kind, i, s in records if i is not None and runs(s)]
    return sorted({(a[0], min(a[1], b[1]), max(a[1], b[1])) for x, a in enumerate(r) for b in r[x + 1 :] if a[0] == b[0] and a[1] != b[1] and len(a[2] & b[2]) >= t * len(a[2] | b[2]) - 1e-12})


@pytest.mark.parametrize(("k", "t", "block"), [(3, 0.6, 512), (5, 0.8, 2)])
def test_pairs_equal_brute_force(spark, rows, k, t, block):
    r = random.Random(11)
    vocab = [f"w{i}" for i in range(400)]
    records = []
    for i in range(40):
        w = [r.choice(vocab) for _ in range(r.choice([4, 30, 120]))]
        records.append(("chunk", f"a{i}", " ".join(w)))
        for v in range(3):
            e = list(w)
            for _ in range(v * 2):
                e[r.randrange(len(e))] = r.choice(vocab)
            records.append(("chunk" if v else "abstract", f"b{i}-{v}", ("  ".join(e)).upper()))
    records += [("chunk", "n", None), ("chunk", "e", ""), ("chunk", "s", "one two"), ("chunk", None, records[0][2]), ("chunk", "a1", records[4][2]), records[0], ("chunk", "long", "word " * 40_000)]
    df = spark.createDataFrame(records, "kind string, id string, text string").withColumns({"c1": F.lit(1), "label": F.lit("clash")}).repartition(3)
    found = neardup.NearDuplicates(df, k=k, threshold=t, block=block)
    assert sorted(map(tuple, neardup.id_pairs(found).collect())) == brute(records, k, t)


def test_copies_are_one_class_and_empty_tables_pass(spark):
    text = "the same words again and again in every copy of the record"
    df = spark.createDataFrame([("chunk", f"i{i}", text) for i in range(300)], "kind string, id string, text string").repartition(4)
    found = neardup.NearDuplicates(df, k=3, threshold=0.6)
    assert found.membership.select("c1", "c2").distinct().count() == 1 and found.links.count() == 0
    assert neardup.id_pairs(found).count() == 300 * 299 // 2
    assert neardup.id_pairs(neardup.NearDuplicates(df.limit(0))).count() == 0


def damerau(a, b):
    """The textbook recursion of the unrestricted distance."""
    far, last = len(a) + len(b), {}
    d = {(-1, -1): far}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = far, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = far, j
    for i in range(1, len(a) + 1):
        col = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), col
            same = a[i - 1] == b[j - 1]
            if same:
                col = j
            d[i, j] = min(d[i - 1, j - 1] + (not same), d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return d[len(a), len(b)]


def test_the_distance_is_the_unrestricted_one_and_a_metric():
    r = random.Random(4)
    s = ["".join(r.choice("abcé") for _ in range(r.randint(0, 7))) for _ in range(60)]
    pairs = [(r.choice(s), r.choice(s)) for _ in range(600)] + [("ca", "abc"), ("", ""), ("ab", "ba")]
    got = metric.distances([a for a, _ in pairs], [b for _, b in pairs])
    assert got.tolist() == [damerau(a, b) for a, b in pairs]
    x, y, z = (s[i::3] for i in range(3))
    n = min(map(len, (x, y, z)))
    assert (metric.distances(x[:n], z[:n]) <= metric.distances(x[:n], y[:n]) + metric.distances(y[:n], z[:n])).all()


@pytest.mark.parametrize(("radius", "block"), [(1, 2000), (2, 5)])
def test_radius_join_equals_all_pairs(spark, radius, block):
    r = random.Random(8)
    keys = sorted({"".join(r.choice("abcd") for _ in range(r.randint(0, 8))) for _ in range(250)})
    df = spark.createDataFrame([(k,) for k in keys] + [(None,), (keys[3],)], "key string").withColumn("cell", F.lit("clash"))
    got = sorted((x["a"], x["b"], x["distance"]) for x in metric.radius_join(df, radius, pivots=6, block=block).collect())
    left, right = zip(*[(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :]], strict=True)
    d = metric.distances(left, right)
    assert got == sorted((a, b, int(k)) for a, b, k in zip(left, right, d, strict=True) if k <= radius)
    assert metric.radius_join(df.limit(0), radius).count() == 0


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("Dr. Tomasz-Edward Stuntilind†", ("person", "tomasz-edward", "stuntilind", "")),
        ("Tradissen, Timothy H.", ("person", "timothy", "tradissen", "h")),
        ("Delmaberg FM", ("person", "f", "delmaberg", "m")),
        ("D. K. Brulmopta", ("person", "d", "brulmopta", "k")),
        ("C Rifisti", ("person", "c", "rifisti", "")),
        ("A.-A. Bibayan", ("person", "a-a", "bibayan", "")),
        ("Elina  Klánopta", ("person", "elina", "klanopta", "")),
        ("The Huntafeld Lab. of Remote Sensing", ("institution", "#lab remo sens", "huntafeld", "")),
        ("Laboratory for Energy Systems, Pakuvoux", ("institution", "#lab ener syst", "pakuvoux", "")),
        ("Huntafeld Laboratory f. Remo. Sens.", ("institution", "#lab remo sens", "huntafeld", "")),
    ],
)
def test_reading_names(name, want):
    assert names.read(name)[:4] == want


def test_what_is_no_name():
    assert [names.read(x) for x in ("et al.", "", "-", "*")] == [None] * 4


def test_spellings_of_one_person_are_linked_and_others_are_not(spark):
    same = [
        ["Margaret Drulomann", "Drulomann, Margaret", "MARGARET DRULOMANN", "Peggy Drulomann", "Margaret Drulomann*", "Margret Drulomann", "Margaret Drülomann", "Margaret Drulomamn", "M. Drulomann"],
        ["Maria Fofizzo", "Fofizzo Maria"],
        ["Mario Fofizzo", "Fofizzo, Mario"],
        ["Linh Travushima", "Travushima, Linh"],
        ["Linh Ravushima"],
        ["Katalini Institute for Computational Biology", "Katalini Inst. of Comp. Biol.", "KATALINI INSTITUTE FOR COMPUTATIONAL BIOLOGY"],
        ["Katalini Institute for Marine Robotics"],
    ]
    filler = [f"{g} {s}" for g in ("Margaret", "Maria", "Mario", "Linh") for s in ("Hanodte", "Belukov", "Zantova", "Kiromez", "Pudrella")]
    rows_ = [(n, 3) for group in same for n in group] + [(n, 1) for n in filler] + [("et al.", 9), (None, 1), ("Margaret Drulomann", 5)]
    e = names.NameLinks(spark.createDataFrame(rows_, "name string, n int").withColumn("entity", F.lit("clash")))
    got = {tuple(r) for r in names.name_pairs(e.entities).collect()}
    want = {(min(a, b), max(a, b)) for g in same for a in g for b in g if a != b}
    assert got == want
    c = {r["name"]: r["n_spellings"] for r in names.clusters(e.entities).collect()}
    assert c["Peggy Drulomann"] == 9 and "et al." not in c
    assert names.NameLinks(spark.createDataFrame([], "name string, n int")).entities.count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    r = random.Random(seed)
    edges = [(f"n{r.randrange(60):02}", f"n{r.randrange(60):02}") for _ in range(35)] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(40)] + [("x", "x"), ("x", None)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {n: find(n) for n in list(root)}
    assert components.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_groups_give_every_record_once(spark):
    base = [f"w{i}" for i in range(60)]
    texts = {"a": base, "b": [*base[:-1], "x"], "c": [*base[:-2], "y", "x"], "d": list(reversed(base)), "e": base}
    found = neardup.NearDuplicates(spark.createDataFrame([("chunk", k, " ".join(v)) for k, v in texts.items()], "kind string, id string, text string"))
    got = {x["id"]: x for x in neardup.groups(found).collect()}
    assert len({got[k]["group_id"] for k in "abce"}) == 1 and got["d"]["group_id"] != got["a"]["group_id"] and got["a"]["class_id"] == got["e"]["class_id"]
    assert got["a"]["n_links"] == 2 and got["d"]["n_links"] == 0 and len(got) == 5
