"""The Jaccard join and decontamination against brute force."""

import random
import re

import pytest

from siltstone.llm import jaccard_join as J
from siltstone.llm.components import connected_components
from siltstone.llm.decontamination import consistent, contaminated, decontaminate

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {k: k + 32 for k in range(65, 91)}


def sets_of(rows, width=5):
    out = {}
    for i, t in rows:
        w = tuple(WORD.findall((t or "").translate(LOWER)))
        out[i] = frozenset(w[k : k + width] for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([w] if w else [])
    return out


def brute(rows, percent=80):
    sets = sets_of(rows)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def fixture(seed, families=6, copies=14):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    common = [rng.choice(words) for _ in range(40)]
    texts = []
    for _ in range(families):
        base = [rng.choice(words) for _ in range(rng.randint(6, 90))]
        if rng.random() < 0.5:
            base += common
        for _ in range(rng.randint(1, copies)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                t[rng.randrange(len(t))] = rng.choice(words) + rng.choice(["", "x"])
            texts.append(rng.choice([" ", "\n", " \t"]).join(t).replace("w1", "W1"))
    texts += ["", " \n", "one", "One", "one two", "one two three four five", "a b c d", "a b c d"]
    rng.shuffle(texts)
    return [(k * 3, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("seed,small", [(1, False), (2, True), (3, True)])
def test_components_equal_brute_force(spark, monkeypatch, seed, small):
    if small:  # buckets, hubs and blocks instead of plain pairs
        monkeypatch.setattr(J, "PAIRS_UP_TO", 2)
        monkeypatch.setattr(J, "BLOCK", 3)
        monkeypatch.setattr(J, "BLOCK_WORDS", 100)
        monkeypatch.setattr(J, "PARTNERS", 2)
    rows = fixture(seed)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, g string, n int").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.jaccard_components(df).collect()}
    assert got == brute(rows)


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (7, None), (8, "A b c  d e f"), (9, "word " * 3000)], "doc_id long, text string")
    got = sorted((tuple(r) for r in J.jaccard_components(df).select("doc_id", "n_shingles", "component_id").collect()), key=repr)
    assert got == sorted([(None, 2, None), (5, 2, 5), (5, 2, 5), (7, 0, 7), (8, 2, 5), (9, 1, 9)], key=repr)
    assert J.jaccard_components(df.where("doc_id = 100")).count() == 0


def test_repeated_rows_and_several_texts_of_an_id(spark):
    """A thousand equal rows of one id are one text; an id with two texts links by either."""
    a, b = "one two three four five six seven eight nine ten eleven twelve", "red green blue black white grey pink brown gold teal plum lime"
    rows = [(1, a)] * 1000 + [(2, a + " more"), (3, a), (3, b), (4, b + " sand"), (5, "other words that are not alike at all in any way")] + [(5, "other words that are not alike at all in any way")] * 3
    got = {(r["doc_id"], r["component_id"]) for r in J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5)}


@pytest.mark.parametrize("percent", [50, 100])
def test_other_similarities_equal_brute_force(spark, monkeypatch, percent):
    monkeypatch.setattr(J, "PAIRS_UP_TO", 2)
    monkeypatch.setattr(J, "BLOCK", 4)
    rows = fixture(7, families=4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()}
    assert got == brute(rows, percent)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 99), (99, 100), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(links).collect()}
    assert got == {**{k: 0 for k in range(41)}, 99: 99, 100: 99}


BENCH = [
    (1, "A train leaves Paris at 9 am and travels 120 km in 2 hours to reach the city of Lyon before noon today"),
    (2, "how many apples are left when seven of the red ones are eaten by the children in the garden"),
    (3, "too short"),
    (4, "five words are in here"),
    (5, None),
    (6, "how many apples are left when seven of the red ones are eaten by the children in the garden"),
]
DOCS = [
    (10, "Intro text. " + BENCH[0][1] + " and more."),
    (11, "Here a train leaves Berlin at 7 am and travels 300 km in 4 hours to reach the city of Munich before noon today."),
    (12, "We know a train leaves Paris at 9 am and travels 120 km in 2 hours to reach the city of Paris before noon today"),
    (13, "How many APPLES are left, when seven of the red ones are eaten by the children in the garden?"),
    (14, "nothing to see in this clean text about apples and trains that reach the city before noon"),
    (15, None),
    (16, ""),
    (17, "so five words are in here and more"),
    (18, "how many apples are left when seven"),
]


def test_decontamination(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in DOCS] * 2, "doc_id long, text string, item_id int")
    items = spark.createDataFrame(BENCH, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in contaminated(docs, items).collect()}
    assert got == {(10, 1): "exact", (11, 1): "reparameterised", (13, 2): "exact", (17, 4): "exact"}
    assert {r["doc_id"] for r in decontaminate(docs, items).collect()} == {12, 14, 15, 16, 18}
    assert contaminated(docs.limit(0), items).count() == 0 and contaminated(docs, items.limit(0)).count() == 0


def test_every_planted_passage_is_found(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    grams = {}
    for r in items.collect():
        w = WORD.findall(r["text"].lower())
        for k in range(len(w) - 7):
            grams.setdefault(tuple(w[k : k + 8]), set()).add((r["item_id"], len(w) - 7))
    want = set()
    for r in docs.collect():
        w, hits = WORD.findall((r["text"] or "").lower()), {}
        for g in {tuple(w[k : k + 8]) for k in range(len(w) - 7)}:
            for item in grams.get(g, ()):
                hits[item] = hits.get(item, 0) + 1
        want |= {r["doc_id"] for (_, n), h in hits.items() if h >= 0.6 * n}
    assert want <= {r["doc_id"] for r in contaminated(docs, items).collect()}


MARIA = "Maria has 12 apples in her basket. Maria gives 5 apples to Tom. Maria then buys 7 more apples. How many apples does Maria have left?"


def found(spark, texts, items):
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return docs, bench, sorted(((r["doc_id"], r["item_id"], r["kind"], r["n_matched"], r["n_windows"]) for r in contaminated(docs, bench).collect()), key=repr)


def test_names_that_open_sentences(spark):
    other = MARIA.replace("Maria", "John").replace("Tom", "Anna").replace("12", "30").replace("5", "8").replace("7", "9")
    got = found(spark, [(1, MARIA), (2, other), (3, MARIA.lower())], [(1, MARIA)])[2]
    assert {(i, kind) for i, _, kind, _, _ in got} >= {(1, "exact"), (2, "reparameterised")}
    assert all(m == n for i, _, _, m, n in got if i < 3)


def test_new_numbers_may_coincide(spark):
    same = MARIA.replace("12", "30").replace("5", "8").replace("7", "8")
    assert [x[:3] for x in found(spark, [(1, same)], [(1, MARIA)])[2]] == [(1, 1, "reparameterised")]


def test_one_other_value_costs_its_windows_only(spark):
    tail = MARIA.replace("does Maria have", "does Peter have")
    ((i, _, _, matched, whole),) = found(spark, [(1, tail)], [(1, MARIA)])[2]
    assert i == 1 and whole / 2 <= matched < whole


def test_rows_and_items_without_ids(spark):
    other = BENCH[1][1]
    docs, bench, got = found(spark, [(None, MARIA), (None, "clean words"), (None, other), (4, "clean too")], [(None, MARIA), (2, other)])
    assert [x[:3] for x in got] == [(None, 2, "exact"), (None, None, "exact")]
    assert sorted(r["text"] for r in decontaminate(docs, bench).collect()) == ["clean too", "clean words"]


TRAIN = "the blue train with seven open wagons carries {0} heavy boxes of apples over the long bridge then it comes back at night and carries the same {0} heavy boxes of apples over the short bridge to the old harbour"


def test_a_contradiction_stays_one_behind_an_inserted_word(spark):
    """One value stands for one value over the whole match: neither in place nor behind inserted words may 5 be 7 first and 9 later."""
    item = [(1, TRAIN.format(5))]
    half = TRAIN.index(" then it comes")
    seven, nine = TRAIN.format(7), TRAIN.format(9)
    texts = [(1, seven), (2, seven[:half] + nine[half:]), (3, seven[:half] + " and" + nine[half:]), (4, seven[:half] + " and" + seven[half:]), (5, seven + " . " + nine), (6, seven[:half] + " and quickly " + nine[half:] + " " + TRAIN.format(5))]
    docs, bench, got = found(spark, texts, item)
    n = {i: m / w for i, _, _, m, w in got}
    whole = got[0][4]
    full = {r["doc_id"]: r["n_matched"] for r in contaminated(docs, bench, coverage_percent=1).collect()}
    assert full[1] == whole and full[5] == whole and full[6] == whole and set(n) >= {1, 4, 5, 6}
    # the side with more windows stays, the other's windows with the value go
    assert full[2] < whole and full[3] <= full[2] and full[3] < full[4]
    assert {i: kind for i, _, kind, _, _ in got}[6] == "exact"


def test_runs_of_number_words_are_one_number(spark):
    item = "a farmer sells 120 melons on the market and keeps 15 melons for the winter days at home"
    other = item.replace("120", "one hundred and twenty").replace("15", "twenty one")
    got = found(spark, [(1, other), (2, other.replace("and keeps", "and and keeps")), (3, "one and two"), (4, item)], [(1, item)])[2]
    assert [x[:3] for x in got if x[0] != 2] == [(1, 1, "reparameterised"), (4, 1, "exact")]
    assert found(spark, [(1, other)], [(1, other)])[2][0][2] == "exact"


def test_windows_of_few_words_match_with_their_values(spark):
    sums = "12 7 19 , 30 4 26 and 9 8 7 6 5 so 41 3 2 11 60 12"
    docs = [(1, "see " + sums + " there"), (2, "see " + re.sub(r"\d+", lambda m: str(int(m[0]) + 100), sums) + " there")]
    assert [x[:3] for x in found(spark, docs, [(1, sums)])[2]] == [(1, 1, "exact")]
    # items that differ in their values only are one template, and each is looked for
    both = found(spark, [(1, sums), (2, sums.replace("30", "31"))], [(1, sums), (2, sums.replace("30", "31"))])[2]
    assert {x[0] for x in both} == {1, 2}


def problems(spark, sf, seed=5):
    """Word problems of the benchmark's words, and re-parameterised copies: other numbers and names, an inserted and a left-out word."""
    rng = random.Random(seed)
    names = [f"{a}{b}" for a in ("Ma", "Jo", "Li", "Pe") for b in ("rion", "tter", "sanna", "kobus")]
    items, copies = [], []
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        words = [w.lower().strip(".,;:!?") for w in r["text"].split()]
        marks = {k: rng.choice("NNP") for k in rng.sample(range(2, len(words) - 2), max(2, len(words) // 10))}
        people = rng.sample(names, 4)

        def written(numbers, who):
            return ["".join((str(numbers[k]) if m == "N" else who[k % 2]) if (m := marks.get(k)) else w) for k, w in enumerate(words)]

        items.append((r["item_id"], " ".join(written({k: rng.randint(2, 99) for k in marks}, people[:2]))))
        new = written({k: rng.randint(2, 99) for k in marks}, people[2:])
        new.insert(len(new) // 2, "also")
        del new[len(new) // 4]
        copies.append((r["item_id"], "some words before it . " + " ".join(new) + " . and some words behind it"))
    return items, copies


def test_recall_of_reparameterised_copies(spark, sf):
    items, copies = problems(spark, "/root/testdata/sf0.01")
    docs, bench = spark.createDataFrame(copies, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(docs, bench).collect()}
    hits = sum((i, i) in got for i, _ in items)
    assert hits >= 0.9 * len(items) and all(a == b for a, b in got)


def plain_match(text, item, window=8):
    """Windows by hand over words without sentence starts: numbers and inner capitals are slots; the votes of docs as the module states them."""

    def tokens(t):
        words = t.split()
        return [("#" if w.isdigit() else "@" if w[0].isupper() and k else w.lower().strip("."), w) for k, w in enumerate(words)]

    def wins(t):
        x = tokens(t)
        return [(k, tuple(a for a, _ in x[k : k + window]), [(a, w) for a, w in x[k : k + window] if a in "#@"]) for k in range(len(x) - window + 1) if 2 * sum(a not in "#@" for a, _ in x[k : k + window]) >= window]

    mine, first = wins(item), {}
    for k, key, slots in mine:
        first.setdefault(key, (k, slots))
    pairs = sorted((k - first[key][0], key, tuple(zip(first[key][1], slots))) for k, key, slots in wins(text) if key in first)
    regions = []
    for x in pairs:
        if not regions or x[0] - regions[-1][-1][0] > max(len(first) // 2, 1):
            regions.append([])
        regions[-1].append(x)
    best = 0
    for r in regions:
        votes = {}
        for _, key, ps in set(r):
            for b, d in set(ps):
                votes.setdefault(b, {}).setdefault(d, set()).add((key, ps))
        if any(sorted(map(len, v.values()))[-2:] and len(v) > 1 and sorted(map(len, v.values()))[-1] == sorted(map(len, v.values()))[-2] for v in votes.values()):
            return None  # a tie: decided by hashes
        to = {b: max(v, key=lambda d: len(v[d])) for b, v in votes.items()}
        good = [x for x in r if all(to[b] == d for b, d in x[2])]
        names = {p for x in good for p in x[2] if p[0][0] == "@"}
        best = max(best, len({x[1] for x in good}) if len({d for _, d in names}) == len(names) else 0)
    return best, len(first)


def test_matches_equal_plain_ones(spark, sf):
    items, copies = problems(spark, sf, 9)
    rng = random.Random(2)
    texts = [(i, re.sub(r"\d+", lambda m: m[0] if rng.random() < 0.6 else str(rng.randint(2, 9)), t.replace(" . ", " ")) if i % 2 else dict(items)[i]) for i, t in copies]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["n_matched"], r["n_windows"]) for r in contaminated(docs, bench, coverage_percent=1).collect()}
    seen = 0
    for i, t in texts:
        want = plain_match(t, dict(items)[i])
        if want is not None and want[0]:
            seen += 1
            assert got[i, i] == want
    assert seen > 0.6 * len(texts)


def test_decontamination_of_long_and_repeated_texts(spark):
    item = [(1, TRAIN.format(5))]
    docs = spark.createDataFrame([(1, "word " * 40_000 + TRAIN.format(8) + " word" * 40_000), (2, (TRAIN.format(6) + " ") * 300), (3, "x" * 500_000)] + [(4, TRAIN.format(3))] * 50, "doc_id long, text string")
    got = {(r["doc_id"], r["kind"]) for r in contaminated(docs, spark.createDataFrame(item, "item_id long, text string")).collect()}
    assert got == {(1, "reparameterised"), (2, "reparameterised"), (4, "reparameterised")}


def test_the_best_region_need_not_be_the_one_with_most_windows(spark):
    """A run of ten windows (17 words) with one value hides no copy with another value whose six windows cover 48 of 60 words."""
    words = [f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)]
    item = [w if k % 6 else "5" for k, w in enumerate(words)]
    run = [w if w != "5" else "7" for w in item[:17]]
    broken = [f"odd{chr(97 + k // 9)}" if k % 9 == 8 else "9" if w == "5" else w for k, w in enumerate(item)]
    far = [f"far{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(100)]
    got = found(spark, [(1, " ".join(run + far + broken)), (2, " ".join(broken)), (3, " ".join(run))], [(1, " ".join(item))])[2]
    assert [x[0] for x in got] == [1, 2]


def test_votes_for_single_values_hide_no_consistent_windows():
    """Each value by its votes gives 2 -> 22 and 4 -> 40, which no window holds together; three windows hold 2 -> 20 and 4 -> 40."""
    pairs = [((2, 20), (4, 40))] * 3 + [((2, 22), (4, 44))] * 2 + [((2, 22), (4, 46))] * 2
    wins = [(0, k, (8 * k, 8 * k + 8), p) for k, p in enumerate(pairs)]
    assert [w[0] for w in consistent(wins, 20, 24)] == [0, 1, 2]
    assert consistent(wins, 20, 25) == []
    # a name without a value of its own: the region is left out whole, as before
    paris = [(0, k, (k, k + 8), ((3, 31),)) for k in range(10)] + [(0, k, (k, k + 8), ((5, 31),)) for k in range(10, 14)]
    assert consistent(paris, 14, 10) == []
