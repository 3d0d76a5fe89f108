"""Leaked items, re-parameterised ones, and texts that only look like them."""

import random

from marketloom.llm import decontaminate as D

ITEM = "A shop sells 12 apples to Maria for 3 dollars each and then Maria gives 12 of them to her brother Tom before lunch"
SHORT = "How many kilometres lie between the two old stone towers"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, key int").repartition(2)


def found(spark, rows, items=((1, ITEM), (2, SHORT))):
    bench = spark.createDataFrame(list(items), "item_id long, text string")
    return {r.doc_id: r.item_ids for r in D.leaks(docs(spark, rows), bench).collect()}


def test_leaks(spark):
    other = ITEM.replace("12", "70").replace("Maria", "Ada").replace("Tom", "Ben").replace("3 dollars", "9 euros")
    torn = other.replace("Ada gives", "Eve gives").replace("70 of", "71 of")
    rows = [(1, "Before. " + ITEM + ". After it all."), (2, "x y z\n" + other.replace(" ", "\t  ") + "!"), (3, torn), (4, None), (5, ""), (6, "words of prose " * 500),
            (7, ITEM[:45]), (8, SHORT), (9, "So, " + SHORT.upper()), (10, "prose " * 4000 + other), (None, other), (12, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15"),
            (13, ITEM.replace("apples", "pears"))]
    assert found(spark, rows) == {1: [1], 2: [1], 8: [2], 9: [2], 10: [1], None: [1], 13: [1]}


RIVER = "Which river flows through Paris?"
SUMS = "Compute 12 + 7 * 3 - 5 / 2 and add 19 then 4 and 8 to get 31"
KEEPER = "The keeper of the lighthouse near Paris sold old lamps to the traders and kept the rest"
TOM = "Tom buys seven red pears at market. Tom pays the old grocer in coins. Tom gives two pears away."


def test_short_number_heavy_and_capitalised_copies(spark):
    items = ((1, ITEM), (2, SHORT), (3, RIVER), (4, SUMS), (5, KEEPER))
    rows = [(1, "They asked: " + RIVER + " Nobody knew."), (2, "Now " + SUMS + "."), (3, "So, " + SHORT.upper()), (4, "So " + SHORT.title()),
            (5, "x " + ITEM.upper() + " y"), (6, "SEE " + ITEM.upper().replace("12", "70")), (7, "Which river flows through Rome?"), (8, KEEPER.title()),
            (9, "which river flows by paris"), (10, "Compute 12 + 7 and add 4")]
    assert found(spark, rows, items) == {1: [3], 2: [4], 3: [2], 4: [2], 5: [1], 6: [1], 8: [5]}


def test_values_of_other_lengths_and_sentence_openers(spark):
    items = ((5, KEEPER), (6, TOM), (7, ITEM))
    rows = [(1, KEEPER.replace("Paris", "New York")), (2, "Well. " + KEEPER.replace("Paris", "Upper New York").replace("The keeper", "the keeper")),
            (3, TOM.replace("Tom", "Anna")), (4, TOM.replace("Tom", "Anna Maria Smith")), (5, TOM.replace("Tom pays", "Ben pays").replace("Tom", "Anna")),
            (6, ITEM.replace("Maria", "Anna Lee").replace("3 dollars", "9").replace("12", "5 kg")), (7, KEEPER.replace("old lamps", "very old lamps")),
            (8, (ITEM.replace("Maria", "Ada") + ". ") * 3 + ITEM.replace("Maria", "Eve"))]
    assert found(spark, rows, items) == {1: [5], 2: [5], 3: [6], 4: [6], 6: [7], 7: [5], 8: [7]}


NAMES = {"latin": ["Anna", "Jean Paul", "Maria de Lourdes".replace(" de", ""), "Özlem", "Łukasz"], "cyrillic": ["Рита", "Иван Петров", "Ольга"], "greek": ["Ελένη", "Νίκος Παππάς"]}
SPOKEN = ["two", "seven", "twelve", "ninety", "twenty one", "three hundred", "zwölf", "trente", "cuarenta", "cinq"]
MEASURES = ["5 kg", "70 miles", "3 litres", "12 cm", "9 euros"]
KINDS = ("digits", "number words", "latin", "cyrillic", "greek", "units", "all")


def parameterised(r, kind):
    """An item's template, and two fillings that differ in what the kind says."""
    plain = [w for w in ("the old farmer carried baskets along a narrow road before evening while others waited near gate and nobody asked why it took so long to "
                         "reach town again after heavy rain had washed away most of that wooden bridge").split()]
    words = [r.choice(plain) for _ in range(r.randrange(24, 36))]
    many = r.randrange(2, 4)
    slots = sorted(r.sample(range(3, len(words) - 2), many))
    own = ["{%d}" % (i % 2) for i in range(many)]
    for at, s in zip(slots, own):
        words[at] = s
    text = " ".join(words)

    def fill(which):
        values = []
        for i in range(2):
            use = which if which != "all" else ("digits", r.choice(("latin", "cyrillic")))[i]
            values.append({"digits": lambda: str(r.randrange(2, 9000)), "number words": lambda: r.choice(SPOKEN), "units": lambda: r.choice(MEASURES)}.get(
                use, lambda: r.choice(NAMES[use]))())
        return text.format(*values) if len(set(values)) == 2 else fill(which)

    first = {"number words": "digits", "units": "units", "all": "all"}.get(kind, kind)
    first = "latin" if first in NAMES else first
    item, copy = fill(first), fill(kind)
    return (item, copy) if item != copy else parameterised(r, kind)


def test_recall_on_reparameterised_items(spark):
    """At least nine in ten of each kind; texts made of the same words in another order hold nothing."""
    r = random.Random(12)
    items, rows, kinds = [], [], {}
    for kind in KINDS:
        for _ in range(60):
            item, copy = parameterised(r, kind)
            n = len(items)
            items.append((n, item))
            rows.append((n, "It was said: " + copy + " and so on."))
            kinds[n] = kind
            shuffled = copy.split()
            r.shuffle(shuffled)
            rows.append((100_000 + n, " ".join(shuffled)))
    got = found(spark, rows, items)
    recall = {k: sum(n in got.get(n, []) for n in kinds if kinds[n] == k) / 60 for k in KINDS}
    assert min(recall.values()) >= 0.9, recall
    assert sum(len([i for i in hits if i != d]) for d, hits in got.items()) == 0, got
    print("recall", recall)


def test_inconsistent_slots_are_no_leak(spark):
    text = ITEM.replace("to Maria", "to Ada").replace("then Maria", "then Eve")
    assert found(spark, [(1, text)]) == {}


def test_given_passages_against_plain_search(spark, sf):
    documents, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {r.doc_id: r.item_ids for r in D.leaks(documents, bench).collect()}
    items = {r.item_id: " ".join(r.text.split()) for r in bench.collect()}
    whole = {}
    for r in documents.collect():
        flat = " ".join((r.text or "").split())
        if hits := sorted(i for i, t in items.items() if t in flat):
            whole[r.doc_id] = hits
    assert whole and all(set(hits) <= set(got[d]) for d, hits in whole.items())
    r = random.Random(1)
    extra = sorted(set(got) - set(whole))
    for d in r.sample(extra, min(5, len(extra))):  # any other shares a long run of words with its item
        words = documents.where(f"doc_id = {d}").first().text.split()
        runs = {tuple(w.strip(".,").lower() for w in words[i:i + 8]) for i in range(len(words))}
        item = [w.strip(".,").lower() for w in items[got[d][0]].split()]
        assert any(tuple(item[i:i + 8]) in runs for i in range(len(item)))


def test_clean_keeps_all_columns(spark):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    left = D.clean(docs(spark, [(1, ITEM), (2, "fine"), (2, "fine"), (None, None)]), bench)
    assert left.columns == ["doc_id", "text", "key"] and sorted(map(str, (r.doc_id for r in left.collect()))) == ["2", "2", "None"]


def test_nothing(spark):
    none, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert D.leaks(none, bench).count() == 0 and found(spark, [(1, ITEM)], [(9, "")]) == {}
