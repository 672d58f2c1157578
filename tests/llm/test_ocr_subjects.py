import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import ocr, subjects


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("Page 12 of 30", (None, "page # of #", True, 0)), ("- 7 -", (None, "- # -", True, 0)), ("[41]", (None, "[#]", True, 0)), ("p. 5", (None, "p. #", True, 0)), ("17", (None, "#", True, 0)), ("– 24 –", (None, "– # –", True, 0)),
        ("Boberson et al.", ("boberson et al.", None, False, 2)), ("12    Boberson et al.", ("boberson et al.", "#", True, 2)), ("28 | Chapter 2", (None, "# | chapter #", True, 0)), ("Preprint. Under review.", ("preprint. under review.", None, False, 2)),
        ("ON GRAPH SEARCH WITH", ("on graph search with", None, False, 1)), ("FENSEG2: STAGE OF MODELS    24", ("fenseg#: stage of models", "#", True, 1)), ("Towards calibrated partial  ·  Boberson", ("towards calibrated partial · boberson", None, False, 2)),
        ("Deep Retrieval Networks   42", ("deep retrieval networks", "#", True, 0)), ("ALGORITHM 1", (None, "algorithm #", False, 0)), ("Smith et al. held. It was so", (None, None, False, 0)),
        ("| dev | 3 |", (None, None, False, 0)), ("|---|---|", (None, None, False, 0)), ("after 84 folds.", (None, None, False, 0)), ("", (None, None, False, 0)), ("- item one", (None, None, False, 0)), ("3. Results", (None, None, False, 0)),
    ],
)
def test_what_could_be_an_edge_line(line, want):
    assert ocr.edge_parts(line) == want


GOOD = "We compared the clinical harness model with another window and found that frequent trade-offs remained stable after small changes"


def corpus(spark, extra):
    rows = [(f"g{i}", GOOD + f" in run {i}.") for i in range(60)]
    return spark.createDataFrame(rows + extra, "chunk_id string, text string").withColumns({"word": F.lit("clash"), "n": F.lit(1)})


def test_damage_and_repair(spark):
    extra = [
        ("h", "We compared the clin-\nical harness model"), ("h2", "We compared the clin¬\n12    Boberson et al.\nical harness model"), ("c", "frequent trade-\noffs remained stable"), ("m", "the cliriical harness"), ("m2", "the hamess and vvindow"),
        ("mh", "with anotber clin­\nica1 model"), ("p", "We found\nPage 3\nanother window"), ("w", "We compared\nthe model"), ("t", "| a-b | 1 |\n| c | 2 |"), ("n", None), (None, "x"), ("e", ""), ("o", "small pre-\nand large changes"), ("m", "the cliriical harness"), ("new", "QuixGrapb found"),
    ]
    s = ocr.ScanNoise(corpus(spark, extra))
    got = sorted(map(tuple, s.damage.collect()))
    assert got == sorted([("h", "hyphen_break"), ("h2", "hyphen_break"), ("h2", "page_number"), ("h2", "running_header"), ("m", "misread_char"), ("m2", "misread_char"), ("mh", "hyphen_break"), ("mh", "misread_char"), ("p", "page_number")])
    text = {r["chunk_id"]: r["text"] for r in s.repaired.collect()}
    assert text["h"] == text["h2"] == "We compared the clinical harness model" and text["m2"] == "the harness and window" and text["mh"] == "with another clinical model" and text["p"] == "We found another window"
    assert set(text) == {"h", "h2", "m", "m2", "mh", "p"}


BODY = ["The result of the first study was shown by Smith et al.", "and it holds in general.", "RELATED WORK", "Preprint servers have changed how results spread", "over the last years in", "2019", "and after.", "Chapter 3", "The last part of the work."]


def test_body_lines_stay(spark):
    text = "\n".join(BODY)
    s = ocr.ScanNoise(spark.createDataFrame([(f"b{i}", f"p{i}", text + f" Case {i}.") for i in range(5)], "chunk_id string, paper_id string, text string"))
    assert s.damage.count() == 0 and s.edges.count() == 0
    assert all(line in ocr.repair(text, {}) for line in BODY)


def test_edge_lines_are_known_by_repetition_and_place(spark):
    r = random.Random(2)
    word = lambda: r.choice(GOOD.lower().split())
    line = lambda: " ".join(word() for _ in range(9))
    rows, want = [], set()
    for p, head in (("p1", "Journal of Applied Graph Methods"), ("p2", "Deep Retrieval Networks   {n}"), ("p3", "A Title Nobody Else Has")):
        for c in range(4):
            lines = [line() for _ in range(6)]
            lines.insert(3, head.format(n=40 + c))
            if c == 2:
                lines.insert(4, "Page 7")
                want.add((f"{p}:{c}", "page_number"))
            rows.append((f"{p}:{c}", p, "\n".join(lines)))
            want |= {(f"{p}:{c}", "running_header")} | ({(f"{p}:{c}", "page_number")} if "{n}" in head else set())
    rows.append(("h1", "p9", line() + ".\nRELATED WORK\n" + line()))
    rows.append(("t", "p8", "Towards Metric Joins\n" + line() + "\n" + line()))
    papers = spark.createDataFrame([("p8", "Towards Metric Joins: A Study", ["A. Nob"]), ("p7", None, None)], "paper_id string, title string, authors array<string>")
    df = spark.createDataFrame(rows + rows[:3], "chunk_id string, paper_id string, text string").repartition(3)
    got = {tuple(x) for x in ocr.ScanNoise(df, papers).damage.collect()}
    assert got == want | {("t", "running_header")}
    text = {x["chunk_id"]: x["text"] for x in ocr.ScanNoise(df, papers).repaired.collect()}
    assert not any("Journal" in t or "Networks" in t or "Page" in t or "\n" in t for t in text.values()) and set(text) == {c for c, _ in got}


def test_repaired_texts_equal_the_planted_originals(spark):
    """Originals are damaged in known ways; the repair must give them back, word for word."""
    r = random.Random(12)
    vocab = [w.lower() for w in GOOD.split() if "-" not in w and len(w) > 4]
    rows, original, kinds = [(f"g{i}", "pg", f"{GOOD}.") for i in range(80)], {}, {}
    for i in range(60):
        words = [r.choice(vocab) for _ in range(40)]
        clean = " ".join(words).capitalize() + "."
        broken, kind = list(words), set()
        broken[0] = broken[0].capitalize()
        at = r.randrange(2, 8)
        good, bad = next((g, b) for g, b in ocr.CONFUSIONS if g in words[at] and len(g) == 1)
        broken[at] = words[at].replace(good, bad, 1)
        lines = [" ".join(broken[k : k + 8]) for k in range(0, 40, 8)]
        kind.add("misread_char")
        if i % 2:
            w = words[16]
            lines[1] += " " + w[:3] + r.choice("-¬")
            lines[2] = w[3:] + " " + " ".join(broken[17:24])
            kind.add("hyphen_break")
        if i % 3 == 0:
            lines.insert(2, f"Page {i}")
            kind.add("page_number")
        if i % 5 == 0:
            lines.insert(2, "Boberson et al.")
            kind.add("running_header")
        rows.append((f"d{i}", "pd", "\n".join(lines) + "."))
        original[f"d{i}"], kinds[f"d{i}"] = clean, kind
    s = ocr.ScanNoise(spark.createDataFrame(rows, "chunk_id string, paper_id string, text string").repartition(4))
    damage: dict[str, set] = {}
    for c, k in s.damage.collect():
        damage.setdefault(c, set()).add(k)
    found = sum(len(damage.get(c, set()) & k) for c, k in kinds.items()) / sum(map(len, kinds.values()))
    right = sum(len(damage[c] & kinds.get(c, set())) for c in damage) / sum(map(len, damage.values()))
    text = {x["chunk_id"]: x["text"] for x in s.repaired.collect()}
    assert found >= 0.99 and right >= 0.99
    assert sum(text.get(c) == t for c, t in original.items()) >= 0.95 * len(original)


def test_empty_table_has_no_damage(spark):
    s = ocr.ScanNoise(spark.createDataFrame([], "chunk_id string, text string"))
    assert s.damage.count() == 0 and s.repaired.count() == 0


def test_corrections_equal_brute_force(spark):
    r = random.Random(6)
    right = ["".join(r.choice("abcdehilmnorstuwg") for _ in range(r.randint(3, 8))) for _ in range(60)]
    words = {w: 500 + i for i, w in enumerate(right)}
    for w in right:
        a, b = r.choice(ocr.CONFUSIONS)
        if a in w:
            words.setdefault(w.replace(a, b, 1), 2)
    got = {x["word"]: x["right"] for x in ocr.corrections(spark.createDataFrame([(w, n, 0) for w, n in words.items()], "word string, n bigint, n_joined bigint")).collect()}
    want = {}
    for w, n in words.items():
        c = {w[:i] + a + w[i + len(b) :] for a, b in ocr.CONFUSIONS for i in range(len(w)) if w.startswith(b, i)}
        c = [(words[v], v) for v in c if v in words and words[v] >= 20 * n and v.isalpha() and len(v) >= 3]
        if c:
            want[w] = max(c)[1]
    assert got == want and want


def test_repair_keeps_paragraphs_and_lists():
    assert ocr.repair("One line\ngoes on.\n\nNext one.\n- item\n- other", {}) == "One line goes on.\n\nNext one.\n- item\n- other"
    assert ocr.repair("", {}) == ""
    assert ocr.repair("a trade-\noff and Vvindow", {"vvindow": "window"}, {"tradeoff": "-"}) == "a trade-off and Window"


TERMS = {"sport": ["goal keeper", "match referee", "tennis serve", "league table"], "law": ["court ruling", "contract clause", "legal brief", "appeal hearing"], "climate": ["sea ice", "flood map", "carbon flux", "storm surge"]}
PLAIN = "several stable reports remained open after many small and careful runs".split()


def sentence(r, area):
    w = [r.choice(PLAIN) for _ in range(8)]
    if area:
        w.insert(r.randrange(8), r.choice(TERMS[area]))
    return " ".join(w).capitalize() + "."


def documents(r, n):
    out = []
    for d in range(n):
        mix_ = r.choice([["sport"] * 8, ["law"] * 8, ["climate"] * 8, ["sport"] * 5 + ["law"] * 3, ["climate"] * 7 + ["law"], [None] * 8, ["law"] * 4 + [None] * 4])
        mix_ = list(mix_)
        r.shuffle(mix_)
        out.append((d, " ".join(sentence(r, a) for a in mix_), {a for a in mix_ if a and mix_.count(a) >= 2}))
    return out


def test_areas_on_held_out_documents(spark):
    r = random.Random(9)
    docs = documents(r, 600)
    df = spark.createDataFrame([(d, t) for d, t, _ in docs] + [(9001, None), (9002, "")], "doc_id bigint, text string").withColumn("subject_code", F.lit("clash")).repartition(3)
    labels = spark.createDataFrame([(d, a) for d, _, s in docs[:200] for a in s] + [(5, "nonsense"), (77777, "law")], "doc_id bigint, subject_code string")
    feats = subjects.featurize(df, 1 << 12)
    model = subjects.fit(feats, labels.unionByName(labels.limit(20)), list(TERMS), rounds=1, buckets=1 << 12)
    found = subjects.classify(feats, model)
    got: dict[int, set] = {}
    for x in found.collect():
        got.setdefault(x["doc_id"], set()).add(x["subject_code"])
    held = [(got.get(d, set()), s) for d, _, s in docs[200:]]
    assert np.mean([a == b for a, b in held]) > 0.95
    comp = {x["subject_code"]: x["n_documents"] for x in subjects.composition(found, df.drop("subject_code"), spark.createDataFrame([(a,) for a in TERMS], "subject_code string")).collect()}
    assert comp["(none)"] == 602 - len(got) and comp["law"] == sum("law" in s for s in got.values())


def test_without_labels_or_documents_there_are_no_areas(spark):
    df = spark.createDataFrame([(1, "A tennis serve was open.")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, subject_code string")
    for part in (df, df.limit(0)):
        feats = subjects.featurize(part, 256)
        assert subjects.classify(feats, subjects.fit(feats, none, list(TERMS), buckets=256)).count() == 0


def test_sentences():
    t = "# Title\n\nOne line\nwraps here. Two is here!\n\n> quoted line\n> goes on.\n* item one.\n* item two.\nVersion 4.7\n한국어 문장이다. 둘째 문장."
    assert subjects.sentences(t) == ["One line wraps here.", "Two is here!", "quoted line goes on.", "item one.", "item two.", "Version 4.7 한국어 문장이다.", "둘째 문장."]
    assert subjects.sentences('{"prompt": "First one here.\\nSecond one here.", "answer": "Third."}')[:2] == ["First one here.", "Second one here."]
    assert subjects.sentences(None) == [] and subjects.sentences("") == []
