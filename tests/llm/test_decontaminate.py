from collections import Counter, defaultdict

import numpy as np
import pytest

from meterlight.llm import decontaminate as dc

ITEMS = [
    (1, "A train leaves Boston at 9 and travels 120 km in 3 hours before it reaches the harbour town. How fast does the train travel on average?"),
    (2, "What is the name of the scientist who first described the long winter migration of the grey heron along the northern coast?"),
    (3, "too short"),
    (4, None),
    (4, ""),
    (None, "The gardener planted seven rows of beans beside the old wall and then watered every second row until the evening came."),
]
FILL = "Nothing in this paragraph has anything to do with questions, it only talks about the weather and the fields around the village. "
DOCS = [
    (1, FILL + ITEMS[0][1] + " " + FILL),
    (2, FILL + ITEMS[0][1].replace("Boston", "Madrid").replace("120", "450").replace("3 hours", "5 hours") + " " + FILL),
    (3, FILL * 3),
    (4, None),
    (5, ""),
    (6, FILL * 400 + ITEMS[1][1] + FILL * 400),
    (7, ITEMS[1][1]),
    (7, ITEMS[1][1]),
    (None, ITEMS[5][1]),
    (8, "A train leaves the station. How fast does a heron fly? Many gardeners plant beans."),
]


def brute(docs, items, window=dc.WINDOW, literal=dc.LITERAL, coverage=dc.COVERAGE, consistent=dc.CONSISTENT):
    """(doc index, item index) -> windows found, of the contaminated documents, by a loop over all pairs."""
    maker = dc.Templates(window, literal)

    def windows(text):
        hashes, at, slot = maker.windows(text)
        signed = slot.view(np.int64)
        return [(int(h), int(p), signed[p : p + window].tolist()) for h, p in zip(hashes, at, strict=True)]

    out = {}
    item_windows = []
    for _, text in items:
        first = {}
        for h, p, s in windows(text):
            first[h] = min(first.get(h, (p, s)), (p, s))
        item_windows.append(first)
    for d, (_, text) in enumerate(docs):
        own = windows(text)
        for i, known in enumerate(item_windows):
            hits = [(h, p - known[h][0], list(zip(known[h][1], s, strict=True))) for h, p, s in own if h in known]
            fillings = defaultdict(Counter)
            for _, shift, pairs in hits:
                fillings[shift].update(x for x in pairs if x[0])
            good = {}
            for shift, counts in fillings.items():
                best = defaultdict(lambda: (0, 0))
                for (value, filled), n in counts.items():
                    best[value] = max(best[value], (n, filled))
                if best:
                    agreeing = sum(n for n, _ in best.values()) / sum(counts.values())
                    different = len({filled for _, filled in best.values()}) / len(best)
                    good[shift] = agreeing >= consistent and different >= consistent
            found = {h for h, shift, _ in hits if good.get(shift, True)}
            if known and len(found) / len(known) >= coverage:
                out[d, i] = len(found)
    return out


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(i, t, "c", 3) for i, t in DOCS], "doc_id bigint, text string, hash string, position int")
    return docs, spark.createDataFrame(ITEMS, "item_id bigint, text string")


@pytest.mark.parametrize("block", [dc.BLOCK, 7])
def test_against_brute_force(tables, block):
    docs, items = tables
    got = {(r.id, r.item_id): (r.n_windows, r.reparameterised) for r in dc.contaminated(docs, items, block=block).collect()}
    expected = {(DOCS[d][0], ITEMS[i][0]): n for (d, i), n in brute(DOCS, ITEMS).items()}
    assert {k: n for k, (n, _) in got.items()} == expected
    assert set(expected) == {(1, 1), (2, 1), (6, 2), (7, 2), (None, None)}
    assert [got[k][1] for k in ((1, 1), (2, 1), (6, 2))] == [False, True, False]


def test_drop(tables):
    docs, items = tables
    kept = dc.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 8]
    assert dc.drop_contaminated(docs.where("false"), items).count() == 0
    assert dc.drop_contaminated(docs, items.where("false")).count() == len(DOCS)


def test_text_around_a_passage_does_not_hide_it(spark):
    """Words that begin the sentences of an item occur capitalised within sentences elsewhere in the document."""
    text = "Each farmer sells four baskets. Every basket holds nine apples. Some apples are sold twice. How many apples are sold today? Give the sum."
    names = "Tom takes five coins from the jar and Anna takes two. Later Tom gives Anna one coin back. Tom now counts what is left in the jar."
    other = names.replace("Tom", "Max").replace("Anna", "Eva")
    after = " He called it Each and Every, then Some, then How, then Give, and at last Later of the years."
    docs = [(1, text), (2, text + after), (3, after + " " + text), (4, names + after), (5, other + after), (6, after)]
    items = [(1, text), (2, names)]
    found = dc.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    got = {(r.id, r.item_id): (r.coverage, r.reparameterised) for r in found.collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 1), (4, 2), (5, 2)}
    assert got[1, 1] == got[2, 1] == got[3, 1] == (1.0, False)
    assert got[4, 2] == (1.0, False) and got[5, 2][1]
