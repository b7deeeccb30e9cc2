import random

import pytest

from fringe.llm import decontam

ITEM = "Alice has 3 red apples and 5 km of rope. How many apples does Alice need to buy if she wants 3 more boxes for the trip?"


def documents():
    rng = random.Random(2)
    filler = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet"]) + str(rng.randrange(40)) for _ in range(n))
    same = ITEM.replace("Alice", "Bob").replace("3", "7").replace("5", "12")
    odd = ITEM.replace("Alice has", "Bob has").replace("does Alice", "does Carl").replace("has 3", "has 7").replace("wants 3", "wants 8")
    return [
        (1, f"{filler(30)} {ITEM} {filler(30)}"), (2, f"{filler(300)} {same}"), (3, odd), (4, ITEM.lower()), (5, " ".join(ITEM.split()[:12])), (6, filler(50)), (7, None), (8, ""), (None, ITEM), (1, f"{filler(3)} {ITEM}"),
        (9, "x " * 100_000 + ITEM),
    ]


def test_leaks_are_found_with_the_template(spark):
    docs = spark.createDataFrame([(i, t, 0) for i, t in documents()], "doc_id long, text string, item_id int")
    benchmark = spark.createDataFrame([(10, ITEM), (10, ITEM), (11, "Too short"), (12, None), (13, ""), (14, "what is the capital of the country where the river ends")], "item_id long, text string")
    got = decontam.find_leaks(docs, benchmark).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.item_id) for r in got) == [(False, 1, 10), (False, 1, 10), (False, 2, 10), (False, 4, 10), (False, 9, 10), (True, 0, 10)]
    left = decontam.without_leaks(docs, benchmark)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [3, 5, 6, 7, 8]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_leaks(docs, none).count() == 0 and decontam.without_leaks(docs, none).count() == 1
    assert decontam.find_leaks(docs.limit(0), spark.createDataFrame([(1, ITEM)], "item_id long, text string")).count() == 0


def leak_of(text, item):
    """Whether an item leaks into a text, without any index: all windows of the text against the item's."""
    everything = lambda hashes: hashes == hashes
    found = {x.form: x for x in decontam.find_hits([text], everything, [1, 2, 3, 4, 5])[0]}
    return int(any(x.form in found and decontam._leaks_in(*decontam.compare(found[x.form], x)) for x in decontam.describe([item])[0]))


def test_template_and_values():
    values = []
    assert decontam.template("Anna paid $5.50 for 3 km, x4", "names", values).split() == [b"\x02", b"paid", b"\x03", b"\x01", b"for", b"\x01", b"\x03", b"x", b"\x01"]
    assert values == ["anna", "$", "5.50", "3", "km", "4"]


def test_inconsistent_twins_do_not_hide_a_leak():
    same = ITEM.replace("Alice", "Bob").replace("3", "7").replace("5", "12")
    odd = ITEM.replace("Alice has", "Bob has").replace("does Alice", "does Carl").replace("has 3", "has 7").replace("wants 3", "wants 8")
    cut = " ".join(same.split()[:-2])  # without its last words
    longer = same.replace("red", "big red")
    stray = "how many apples does Dora need to buy if she wants 9 more boxes"
    far = " ".join(["filler"] * 200)
    leaks = lambda text: leak_of(text, ITEM)
    for true in (same, cut, longer):
        for text in (true, f"{true} {odd}", f"{odd} {true}", f"{odd} {true} {odd}", f"{odd} {far} {true}", f"{true} {far} {odd}", f"{odd} {far} {true} {far} {odd}", f"{true} {stray}", f"{stray} {true}"):
            assert leaks(text) == 1, text
    assert leaks(f"{odd} {odd}") == leaks(f"{odd} {far} {odd}") == leaks(f"{stray} {odd}") == 0


def test_short_items_are_found_verbatim(spark):
    benchmark = [(20, "What is 17 + 25?"), (21, "12 * 3 = 36"), (22, "Bob Anna 3 4 5 6 Carl Dora 7"), (23, "?!"), (24, None), (25, "フランスの首都は？"), (26, "1.5 kg")]
    docs = [
        (1, "Some text. what is  17 + 25 Answer: 42"), (2, "What is 17 - 25?"), (3, "What is 17 + 26?"), (4, "so 12*3=36, and 12 * 3 = 36 again"), (5, "bob anna 3 4 5 6 carl dora 7"),
        (6, "Bob Anna 3 4 5 6 Carl Dora 8"), (7, "?! 23"), (8, "問題：フランスの首都はどこ"), (9, "1.5 kg or 1,5 kg"), (10, "1 5 kg"), (11, None), (12, "What is 17"),
    ]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(benchmark, "item_id long, text string")
    got = decontam.find_leaks(docs, items).collect()
    assert sorted((r.doc_id, r.item_id, r.form) for r in got) == [(1, 20, "verbatim"), (4, 21, "verbatim"), (5, 22, "verbatim"), (8, 25, "verbatim"), (9, 26, "verbatim")]
    assert sorted(r.doc_id for r in decontam.without_leaks(docs, items).collect()) == [2, 3, 6, 7, 10, 11, 12]


def test_slots_are_filled_one_to_one():
    item = "Anna gave 4 pens to Bob and 9 books to Carl before the bus left the old station at noon"
    assert leak_of(item.replace("Anna", "Dora").replace("Bob", "Emil").replace("Carl", "Fritz").replace("4", "8").replace("9", "5"), item) == 1
    assert leak_of(item.replace("Anna", "Dora").replace("Bob", "Dora").replace("Carl", "Dora").replace("4", "5").replace("9", "5"), item) == 0


def test_as_every_document_against_every_item(spark):
    """Brute force over a small corpus in which passages are copied, changed, cut and shared by many documents."""
    rng = random.Random(9)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "te", "Va", "Zo") for b in ("n", "st", "re", "dum", "x")]
    text = lambda n: " ".join(rng.choice(words) if rng.random() < 0.8 else str(rng.randrange(9)) for _ in range(n))
    items = [(k, text(rng.randrange(3, 30))) for k in range(40)]
    items += [(100 + k, items[5][1].replace("3", str(k))) for k in range(20)] + [(5, items[6][1]), (None, items[7][1])]
    docs = []
    for k in range(120):
        body = items[rng.randrange(40)][1].split() if rng.random() < 0.8 else []
        for _ in range(rng.randrange(4)):
            if body:
                body[rng.randrange(len(body))] = text(1)
        docs.append((k, f"{text(20)} {' '.join(body[rng.randrange(2) :])} {text(rng.randrange(20))}"))
    docs += [(1000 + k, f"{items[5][1]} {k}") for k in range(60)] + [docs[0], docs[0]]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id or -1) for r in decontam.find_leaks(table, benchmark).collect())
    want = sorted((i, j) for i, t in docs for j in {j or -1 for j, item in items if leak_of(t, item)})
    assert got == want and len(want) > 100
    bad = {i for i, _ in want}
    clash = table.withColumns({"id": table.doc_id, "leak_digest": table.doc_id})
    left = decontam.without_leaks(clash, benchmark)
    assert left.columns == clash.columns and sorted(r.doc_id for r in left.collect()) == sorted(i for i, _ in docs if i not in bad)


UNITED = "A train leaves the station at 60 miles per hour and another leaves forty minutes later, how many hours until they meet"


@pytest.mark.parametrize(
    "text",
    [
        UNITED.upper(),
        UNITED.title(),
        UNITED.replace("miles", "Miles").replace("minutes", "Minutes").replace("hours", "Hours"),
        UNITED.replace("60", "ninety").replace("forty", "25"),
        UNITED.replace("60", "seventy-five").replace("forty", "two hundred"),
    ],
    ids=["capitals", "title", "units", "in words", "compound words"],
)
def test_units_in_any_case_and_numbers_in_words(spark, text):
    docs = spark.createDataFrame([(1, f"before it {text} and after"), (2, "A train is late again and nobody at the station knows how many minutes it will be")], "doc_id long, text string")
    items = spark.createDataFrame([(7, UNITED)], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, items).collect()] == [(1, 7)]


def test_clean_rows_keep_clashing_names(spark):
    docs = spark.createDataFrame([(1, UNITED, 1, 2), (2, None, 3, 4), (None, "nothing of it", 5, 6), (None, UNITED, 7, 8)], "doc_id long, text string, leak_digest int, item_id int")
    items = spark.createDataFrame([(7, UNITED)], "item_id long, text string")
    out = decontam.without_leaks(docs, items)
    assert out.columns == docs.columns and sorted(r.leak_digest for r in out.collect()) == [3, 5]


def test_numbers_in_words():
    words = (*decontam._ONES, *decontam._TEENS, *decontam._TENS)
    assert all(decontam._SPELLED.sub(decontam._in_digits, f"x {w} y") == f"x {decontam._IN_WORDS[w]} y" for w in words)
    for other in ("eine", "fen", "sen", "often", "tent", "one", "twotwo", "nein", "sine", "hundred"):
        assert decontam._SPELLED.sub(decontam._in_digits, f"x {other} y") == f"x {other} y"
    assert decontam._SPELLED.sub(decontam._in_digits, "Forty-Five or SIX hundred or twenty two thousand") == "45 or 600 or 22000"
