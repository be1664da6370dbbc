"""Leaks of benchmark items: copies that are mostly slots, and questions asked anew."""

from tremor.llm.decontaminate import Items, Rule


def found(item, *docs):
    items = Items([(1, item)], Rule())
    return [items.leaks(d) for d in docs]


def test_mostly_slots():
    item = "12 + 7 = 19, 5 + 8 = 13 and 4 + 9 = 13"
    same, other = found(item, f"It says {item} here", "It says 31 + 2 = 33, 6 + 1 = 7 and 8 + 3 = 11 here")
    assert [r[2] for r in same] == [1.0] and not other


ASKED = "Some people say that Bob Smith went to the market early and bought 5 kg of fine red potatoes there"


def test_values_of_other_lengths():
    docs = [ASKED.replace("Bob Smith", "Mary"), ASKED.replace("5 kg", "7kg"), ASKED.replace("5 kg", "twenty five kg"), ASKED.replace("Bob Smith", "Ann Mary Jones")]
    for r in found(ASKED, *docs):
        assert [x[2] for x in r] == [1.0]


def test_inserted_word():
    item = "wide rivers carry old boats past quiet towns while seven tired sailors sing about distant golden harbours and green hills"
    words = item.split()
    (more,), (less,), none = found(item, " ".join([*words[:10], "very", *words[10:]]), " ".join([*words[:9], *words[10:]]), "quiet " * 30)
    assert more[2] == 1.0 and less[2] == 0.95 and none == []


def test_name_at_start_of_sentences():
    item = "Tom has 5 apples. Tom buys 3 more apples. Tom gives 2 away. How many apples does he have?"
    same, lower = found(item, item.replace("Tom", "Bob"), item.replace("How", "how"))
    assert [r[2] for r in same] == [1.0] and same[0][5] == 3 and [r[2] for r in lower] == [1.0]
